"""Formats as column functions and node tables."""

from loomtext.functions.csv import csv_record, csv_records, decode_record, decode_rows, decode_text
from loomtext.functions.http import http_request, http_response
from loomtext.functions.markdown import md_blocks, md_code, md_debug, md_frontmatter, md_has_marks, md_heading, md_image, md_inlines, md_link, md_parse, md_render
from loomtext.functions.text import text_from_ascii, text_from_utf8
from loomtext.functions.xml import xml_decl, xml_dsl, xml_nodes, xml_parse
from loomtext.functions.yaml import yaml_debug, yaml_nodes, yaml_parse, yaml_scalar_kind

__all__ = [
    "csv_record", "csv_records", "decode_record", "decode_rows", "decode_text", "http_request", "http_response", "md_blocks", "md_code", "md_debug", "md_frontmatter",
    "md_has_marks", "md_heading", "md_image", "md_inlines", "md_link", "md_parse", "md_render", "text_from_ascii", "text_from_utf8", "xml_decl", "xml_dsl", "xml_nodes", "xml_parse", "yaml_debug", "yaml_nodes", "yaml_parse", "yaml_scalar_kind",
]
