"""Text expressions. All are built-in Column expressions (JVM side, codegen)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letter/digit runs: the token definition used by embedding, token counts
# and the lexical checkers.
TOKEN_PATTERN = r"[\p{L}\p{N}]+"
# A sentence: a run of non-terminators closed by a terminator.
SENTENCE_PATTERN = r"[^.!?]+[.!?]"
# Any Unicode whitespace, plus the four separator controls that Python's
# str.split() also treats as whitespace.
UNICODE_WS = r"(?U)[\s\x{1c}-\x{1f}]+"
ASCII_WS = r"\s+"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def collapse_ws(c, unicode: bool = True) -> Column:
    """Split on whitespace, join with one space, trim (F2)."""
    return F.trim(F.regexp_replace(_c(c), UNICODE_WS if unicode else ASCII_WS, " "))


def strip_ws(c) -> Column:
    """Text without white space at either end, all kinds that Python's
    ``str.strip()`` takes off."""
    return F.regexp_replace(_c(c), r"(?U)\A[\s\x{1c}-\x{1f}]+|[\s\x{1c}-\x{1f}]+\z", "")


def tokens(c, lower: bool = True) -> Column:
    """Array of letter/digit runs, lower-cased by default."""
    x = F.lower(_c(c)) if lower else _c(c)
    return F.regexp_extract_all(x, F.lit(TOKEN_PATTERN), 0)


def token_count(c) -> Column:
    return F.size(tokens(c, lower=False)).cast("long")


def sentences(c) -> Column:
    return F.regexp_extract_all(_c(c), F.lit(SENTENCE_PATTERN), 0)


def match_form(c) -> Column:
    """Normal form for substring matching: lower case, collapsed whitespace."""
    return F.lower(collapse_ws(c, unicode=False))


def title_of(c, n: int = 80) -> Column:
    """Whitespace-collapsed text cut to ``n`` characters."""
    return F.substring(collapse_ws(c, unicode=False), 1, n)


def preview(c, n: int = 150) -> Column:
    """First ``n`` characters (P5)."""
    return F.substring(_c(c), 1, n)


def html_title(c) -> Column:
    return F.regexp_extract(_c(c), r"<title>(.*?)</title>", 1)
