"""URL filter: rules by host suffix and path prefix, then a blocked Bloom
filter of listed canonical URLs in front of an exact hash join. Built-in
functions only."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.llm.bloom import blocks_for, bloom, mark

PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")),
                       string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Key of a listed page: host and path without a trailing slash; empty
    when there is no host."""
    return F.when(host != "", F.concat(host, F.regexp_replace(path, "/+$", "")))


def rule_name(host: str, path: str) -> str:
    return host + path


def rule_column(host: Column, path: Column, rules) -> Column:
    """(rule, verdict) of the longest rule that fits, else null. ``rules`` is
    a configured list of (verdict, host, path)."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(rule_name(h, p)).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def url_filter(pages: DataFrame, listed: DataFrame, rules, id_col: str = "page_id", url_col: str = "url",
               expected: int | None = None) -> DataFrame:
    """Verdict on every page: page_id, host, path, rule, verdict, listed.

    The longest fitting rule decides. Else the page is blocked if its
    canonical URL is in ``listed`` (column ``key``). The Bloom filter is
    sized by the list up to MAX_BLOCKS blocks, so the broadcast is at most
    4 MB; beyond that it passes more false hits, which the exact join
    removes. Only possible hits go to that join, by distinct key.

    Null url or one without ``://``: empty host and path, no rule, allowed.
    Null and repeated listed keys are harmless, repeated pages are judged
    each, an empty list blocks nothing. Other columns are ignored.
    """
    keys = listed.select("key").filter(F.col("key").isNotNull()).distinct()
    if expected is None:
        expected = keys.count()
    blocks = blocks_for(expected)
    filt = bloom(keys, blocks)
    url = F.col(url_col)
    judged = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    judged = judged.withColumn("r", rule_column(F.col("host"), F.col("path"), rules)).withColumn(
        "key", F.when(F.col("r").isNull(), canonical(F.col("host"), F.col("path"))))
    probed = mark(judged, F.col("key"), filt, "hit", blocks).withColumn("possible", F.when(F.col("hit"), F.col("key")))
    exact = probed.join(keys.select(F.col("key").alias("l_key")), F.col("possible") == F.col("l_key"), "left")
    is_listed = F.col("l_key").isNotNull()
    return exact.select(
        "page_id", "host", "path", F.col("r.rule").alias("rule"),
        F.coalesce("r.verdict", F.when(is_listed, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        is_listed.alias("listed"))
