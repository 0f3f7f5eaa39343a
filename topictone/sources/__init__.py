"""Sources: comment CSV, labelled CSV, text lines, parquet tables."""

from .comments import read_comments, read_labelled_csv, read_table, require_column
from .lines import read_lines

__all__ = ["read_comments", "read_labelled_csv", "read_table", "require_column", "read_lines"]
