"""Files of many formats as one table of documents."""

from .reader import DOCUMENT, parse_files, read_documents, register

__all__ = ["DOCUMENT", "parse_files", "read_documents", "register"]
