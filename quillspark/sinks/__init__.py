"""Sinks: rows to documents, one file for each key."""

from .files import documents, write_files

__all__ = ["documents", "write_files"]
