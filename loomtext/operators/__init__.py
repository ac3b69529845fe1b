"""Grammars and how they run over columns."""

from loomtext.operators import grammar
from loomtext.operators.parse import could_start, parse_bytes, parse_column, parse_prefix

__all__ = ["could_start", "grammar", "parse_bytes", "parse_column", "parse_prefix"]
