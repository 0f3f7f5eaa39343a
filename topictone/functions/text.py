"""Text column expressions: blank test, strip, NULL handling, tokens.

All of them are JVM-side expressions (no Python in the row path).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DEFAULT_TOKENS, TokenConfig

# The characters Python's ``str.isspace`` treats as whitespace
# (and therefore ``str.strip`` removes).  Written with \x{..} escapes, which
# Java regular expressions and RE2 both accept, so the same class works in
# Spark and in the SQL oracle.
WHITESPACE_CLASS = (
    "[\\t\\n\\x0b\\x0c\\r\\x1c-\\x1f \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}"
    "\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
)
# Leading or trailing whitespace.
STRIP_PATTERN = f"^{WHITESPACE_CLASS}+|{WHITESPACE_CLASS}+$"
# A text is valid when it has at least one character outside the class.
NONBLANK_PATTERN = WHITESPACE_CLASS.replace("[", "[^", 1)

# Token pattern: a run of letters/digits that are not Han, or one Han character.
# ASCII is named first: a character's script is looked up only beyond it.
TOKEN_PATTERN = "[a-zA-Z0-9[\\p{L}\\p{N}&&[^\\p{IsHan}]]]+|[\\x{80}-\\x{10FFFF}&&\\p{IsHan}]"


def col_of(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_col(c: str | Column) -> Column:
    """``str.strip()`` with Python's notion of whitespace (``trim`` only
    removes U+0020)."""
    return F.regexp_replace(col_of(c), STRIP_PATTERN, "")


def is_valid_text(c: str | Column) -> Column:
    """Non-NULL and not blank after stripping."""
    c = col_of(c)
    return c.isNotNull() & c.rlike(NONBLANK_PATTERN)


def null_to_empty(c: str | Column) -> Column:
    return F.coalesce(col_of(c), F.lit(""))


def tokens(c: str | Column, cfg: TokenConfig = DEFAULT_TOKENS) -> Column:
    """Token array of a text; with ``cfg.max_length`` set, its first
    ``max_length`` tokens.

    A truncation happens on the array, before any explode.  A NULL text has
    no tokens.
    """
    text = null_to_empty(c)
    if cfg.lowercase:
        text = F.lower(text)
    toks = F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), 0)
    if cfg.max_length is None:
        return toks
    return F.slice(toks, 1, cfg.max_length)
