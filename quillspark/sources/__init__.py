"""Sources: files by path, and what their formats hold."""

from .datasource import register
from .files import extract, files, read, read_markdown, read_records, read_table, read_text

__all__ = ["extract", "files", "read", "read_markdown", "read_records", "read_table", "read_text", "register"]
