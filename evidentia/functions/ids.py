"""Identifier, URL and date expressions of the feed normaliser."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def paper_id_from_url(c) -> Column:
    """Last path segment; when the part after its last dot holds a 'v',
    keep the text before the first 'v' (drops a version suffix)."""
    tail = F.element_at(F.split(_c(c), "/"), -1)
    last_dot_part = F.element_at(F.split(tail, r"\."), -1)
    return F.when(F.instr(last_dot_part, "v") > 0,
                  F.element_at(F.split(tail, "v"), 1)).otherwise(tail)


def https_url(c) -> Column:
    """Replace every http:// by https://."""
    return F.regexp_replace(_c(c), "http://", "https://")


def date_prefix(c) -> Column:
    """Date from the first ten characters of an ISO timestamp."""
    return F.to_date(F.substring(_c(c), 1, 10))


def iso_date(c) -> Column:
    return F.date_format(_c(c), "yyyy-MM-dd")


def author_list(c) -> Column:
    """Authors array of structs with a name -> 'a, b'; missing -> '' (F3)."""
    return F.coalesce(F.array_join(F.transform(_c(c), lambda a: a["name"]), ", "), F.lit(""))
