"""Reading documents from files and writing parsed tables."""

from loomtext.sources.files import read_binary, read_parquet, read_texts, write_table

__all__ = ["read_binary", "read_parquet", "read_texts", "write_table"]
