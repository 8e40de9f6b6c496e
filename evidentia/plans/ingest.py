"""The ingest job (S2 -> F1-F6 -> P1 -> T3 -> M1 -> S4/S5 -> S11) as one
function: feed files in, the corpus table upserted, a one-row summary out."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions.cost import EMBEDDING_MODEL, pricing_frame, with_cost
from evidentia.functions.embed import hashed_tf
from evidentia.operators import corpus as CO
from evidentia.schemas import PAPERS
from evidentia.session import cut_lineage
from evidentia.sources.feed import normalize_entries, read_feed


def builtin_document_embedder(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, embedding, n_tokens) with the built-in hashed model."""
    return hashed_tf(df, key, text).select(key, "embedding", "n_tokens")


def ingest(spark: SparkSession, feed_path: str, table_path: str, *, predicate: Column | str | None = None,
           max_results: int | None = 400, embed=builtin_document_embedder, clear: bool = False,
           embedding_model: str = EMBEDDING_MODEL) -> DataFrame:
    """Read the feed files at ``feed_path``, keep the entries on topic
    (``predicate``; None = the default topic, ``F.lit(True)`` = every
    entry), take the ``max_results`` newest (None = all), embed their text,
    and upsert them into the corpus table.

    Returns one row: fetched, affected, total_rows (null when nothing was
    fetched), tokens, cost_usd. With ``clear`` the table is emptied first
    and the ingest then goes on (E5). One ``ingested_at`` per run (E3)."""
    if max_results is not None and max_results < 1:
        raise ValueError("max_results must be at least 1, or None for all")
    if clear:
        CO.create_table_if_absent(spark, table_path)
        CO.clear_table(spark, table_path)
    entries = normalize_entries(read_feed(spark, feed_path), categories=True)
    entries = CO.topic_filter(entries, predicate)
    if max_results is not None:
        entries = entries.orderBy(F.desc("published_date"), F.asc("id")).limit(max_results)
    fetched = cut_lineage(entries.drop("categories"), "fetched")
    vec = embed(fetched.select("id", "abstract"), "id", "abstract")
    run_at = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    staged = (fetched.join(vec, "id", "left")
                     .withColumn("ingested_at", F.lit(run_at).cast("timestamp")))
    staged = cut_lineage(staged, "staged")            # embedding calls happen once
    n = staged.count()
    if n == 0:
        return spark.createDataFrame([(0, 0, None, 0, 0.0)],
                                     "fetched long, affected long, total_rows long, tokens long, cost_usd double")
    affected = CO.upsert_table(spark, table_path, staged.select(*PAPERS.fieldNames()))
    total = CO.read_table_at(spark, table_path).count()
    usage = staged.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).cast("long").alias("input_tokens")).select(
        F.lit(embedding_model).alias("model"), "input_tokens", F.lit(0).cast("long").alias("output_tokens"))
    return with_cost(usage, pricing_frame(spark)).select(
        F.lit(n).cast("long").alias("fetched"), F.lit(affected).cast("long").alias("affected"),
        F.lit(total).cast("long").alias("total_rows"), F.col("input_tokens").alias("tokens"),
        F.bround("cost_usd", 4).alias("cost_usd"))
