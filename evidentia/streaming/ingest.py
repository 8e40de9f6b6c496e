"""Continuous corpus ingest (R1): new files of staged corpus rows are
upserted micro-batch by micro-batch into the bucketed corpus table.

The table ends with the newest version of every key (largest ``ingested_at``,
ties by the rest of the row), however the files fall into micro-batches and
in whatever order they come: within a batch the newest version is taken, and
it replaces the stored row only if it is newer than that. A replayed file, or
a restarted query, therefore changes nothing.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.operators.corpus import fold_repeats, keep_last, merge_rows, read_table_at, upsert_table, write_table
from evidentia.schemas import PAPERS
from evidentia.session import checkpoint_dir, drop_path, stage
from evidentia.streaming.progress import ProgressLog


def start_stream_upsert(spark: SparkSession, source_dir: str, table_path: str, checkpoint: str,
                        files_per_trigger: int = 100, available_now: bool = True, listener=None):
    """Start the ingest stream; returns the StreamingQuery. ``listener`` (a
    ``ProgressLog``) is told when a batch starts, how many rows it brought and
    how many of them changed the table."""
    src = (spark.readStream.schema(PAPERS).option("maxFilesPerTrigger", files_per_trigger)
                .parquet(source_dir))

    def merge(batch: DataFrame, epoch_id: int) -> None:
        if listener is not None:
            listener.batch_started(epoch_id)
        b = batch.persist()          # the merge runs several actions on it; read from files, it needs no staging
        folded = None
        try:
            rows = fold_repeats(b)
            if rows is not b:
                rows, folded = stage(rows, "folded")
            seen, n = merge_rows(b.sparkSession, table_path, rows, newest_by="ingested_at")
            if listener is not None:
                listener.batch_done(epoch_id, seen, n)
        finally:
            b.unpersist()
            if folded:
                drop_path(b.sparkSession, folded)

    w = src.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def _delivered(spark: SparkSession, deliveries: list[DataFrame], folder: str):
    """Write one delivery after the other into ``folder``. The first one that
    comes again is read back from its files, not computed again."""
    first = None
    for i, rows in enumerate(deliveries):
        out = first if i and rows is deliveries[0] else rows
        out.select(*PAPERS.fieldNames()).write.mode("append").parquet(folder)
        if not i:
            first = spark.read.schema(PAPERS).parquet(folder)        # lists the files that are there now
        yield i


def replay_upsert(spark: SparkSession, target: DataFrame, source: DataFrame, replays: int = 3,
                  stale: DataFrame | None = None, files_per_trigger: int = 100) -> DataFrame:
    """Load ``target`` as the corpus table, stage ``source`` as ``replays``
    files (the same rows delivered again and again) and ``stale``, older
    versions of rows, after them; run the ingest stream to completion and
    return the final table. It equals the batch upsert of ``source``."""
    base = os.path.join(checkpoint_dir(spark), f"stream-upsert-{uuid.uuid4().hex}")
    table, staged, ckpt = (os.path.join(base, p) for p in ("table", "source", "checkpoint"))
    write_table(table, target)
    for _ in _delivered(spark, [source] * replays + ([] if stale is None else [stale]), staged):
        pass
    q = start_stream_upsert(spark, staged, table, ckpt, files_per_trigger)
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return read_table_at(spark, table).drop("bucket")


def logged_runs(spark: SparkSession, target: DataFrame, deliveries: list[DataFrame]) -> DataFrame:
    """Load ``target`` as the corpus table, then for each delivery write its
    rows into the stream's folder and run the stream to the end; the events of
    all runs as they stand in the progress table (R2): one "started" and one
    "progress" row per batch, one "done" or "error" row per run."""
    base = os.path.join(checkpoint_dir(spark), f"stream-log-{uuid.uuid4().hex}")
    table, staged, ckpt, events = (os.path.join(base, p) for p in ("table", "source", "checkpoint", "events"))
    write_table(table, target)
    log = ProgressLog(spark, events)
    for _ in _delivered(spark, deliveries, staged):
        q = start_stream_upsert(spark, staged, table, ckpt, files_per_trigger=1_000_000, listener=log)
        q.awaitTermination()
        log.run_done(q)
    return log.frame(spark)


def start_feed_ingest(spark: SparkSession, feed_dir: str, table_path: str, checkpoint: str,
                      embed=None, files_per_trigger: int = 1, available_now: bool = True):
    """Feed files -> normalise (F1-F6) -> embed -> upsert, as a stream.

    Each micro-batch is one ingest run: its rows share one ``ingested_at``
    (E3), and the vectors come from ``embed(df, key, text) -> (key,
    embedding)`` (built-in hashed vectors by default). Of entries that repeat
    an id in a batch, the one published last counts."""
    from evidentia.functions.embed import hashed_tf
    from evidentia.schemas import FEED_ENTRY
    from evidentia.sources.feed import normalize_entries
    embed = embed or (lambda df, key, text: hashed_tf(df, key, text).select(key, "embedding"))
    src = (spark.readStream.format("xml").option("rowTag", "entry").option("ignoreNamespace", "true")
                .option("maxFilesPerTrigger", files_per_trigger).schema(FEED_ENTRY).load(feed_dir))

    def run(batch: DataFrame, epoch_id: int) -> None:
        import datetime as dt
        b = batch.persist()
        try:
            rows = keep_last(normalize_entries(b), order="published_date")
            vec = embed(rows.select("id", "abstract"), "id", "abstract")
            now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
            staged = rows.join(vec, "id", "left").withColumn("ingested_at", F.lit(now).cast("timestamp"))
            upsert_table(b.sparkSession, table_path, staged.select(*PAPERS.fieldNames()))
        finally:
            b.unpersist()

    w = src.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
