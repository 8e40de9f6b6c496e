"""Connected components of a table of links, by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.scratch import Scratch
from evidentia.session import cut_lineage


def _signature(e: DataFrame):
    return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame, tables: Scratch | None = None) -> DataFrame:
    """``links`` (a, b) between nodes of any ordered type; returns (node,
    root), root the smallest node of the component, for every node of a link
    between two different nodes. Each round hangs all larger neighbours of a
    node on its smallest one, then all smaller ones; the rounds needed grow
    as the logarithm of the longest chain. Neighbourhoods are joined with
    one minimum per node, never gathered. The result is a written table, of
    ``tables`` if given."""
    e = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    held = Scratch(links.sparkSession)
    e = held.table(e, "links")
    before = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("m", "a").alias("m"))
        e = both.join(low, F.col("a") == F.col("n")).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = e.filter("a <> b").distinct()
        low = e.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "n")
        moved = e.join(low, F.col("a") == F.col("n"))
        e = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").unionByName(
            moved.select("a", F.col("m").alias("b"))).distinct()
        e = held.table(e, "links")
        now = _signature(e)
        if now == before:
            break
        before = now
    out = e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
    out = cut_lineage(out, "components") if tables is None else tables.table(out, "components")
    held.close()
    return out
