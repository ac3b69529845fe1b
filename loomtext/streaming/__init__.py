"""Parsing inside Structured Streaming.

Every parse is a stateless expression of its row, so a streaming DataFrame takes it
unchanged; these helpers add what a long-running job needs.
"""

from loomtext.streaming.parse import parse_stream, sum_by_window

__all__ = ["parse_stream", "sum_by_window"]
