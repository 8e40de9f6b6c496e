"""Running usage and cost per day and tool over a stream of usage events
(R3). Usage is additive, so no state is kept: each micro-batch writes its
sums per event-time window under its epoch number (a replayed batch
overwrites its own sums), and a window's value is the sum over the epochs.
An event counts however late it comes."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions.cost import money_round, pricing_frame
from evidentia.operators.usage import events_as_usage, priced, usage_by_window
from evidentia.session import checkpoint_dir


def _file_stream(spark: SparkSession, path: str, schema, files_per_trigger: int) -> DataFrame:
    """A file stream over a folder, or over one file (read as a one-file glob
    inside its folder)."""
    r = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if path.endswith(".parquet") and not os.path.isdir(path):
        folder, name = os.path.split(path)
        return r.option("basePath", folder).parquet(os.path.join(folder, name[:-1] + "[" + name[-1] + "]"))
    return r.parquet(path)


def start_usage_stream(spark: SparkSession, events_path: str, out_path: str, checkpoint: str,
                       schema, duration: str = "1 day", files_per_trigger: int = 100):
    ev = _file_stream(spark, events_path, schema, files_per_trigger)

    def add(batch: DataFrame, epoch_id: int) -> None:
        u = priced(events_as_usage(batch.withColumn("ts", F.col("ts").cast("timestamp"))), pricing_frame(batch.sparkSession))
        usage_by_window(u, duration).write.mode("overwrite").parquet(os.path.join(out_path, f"epoch={epoch_id}"))

    return (ev.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
              .trigger(availableNow=True).start())


def window_totals(log: DataFrame) -> DataFrame:
    """The value of every (window, tool): the sum of all epochs' sums."""
    return log.groupBy("w", "tool").agg(
        F.sum("calls").cast("long").alias("calls"), F.sum("input_tokens").cast("long").alias("input_tokens"),
        F.sum("output_tokens").cast("long").alias("output_tokens"), F.sum("cost_usd").alias("cost_usd"))


def usage_by_day_stream(spark: SparkSession, events_path: str, files_per_trigger: int = 100) -> DataFrame:
    """Run the usage stream over the files at ``events_path`` to completion
    and return usage per day and tool (equal to the batch rollup)."""
    base = os.path.join(checkpoint_dir(spark), f"usage-stream-{uuid.uuid4().hex}")
    schema = spark.read.parquet(events_path).schema
    q = start_usage_stream(spark, events_path, os.path.join(base, "log"), os.path.join(base, "ckpt"), schema,
                           files_per_trigger=files_per_trigger)
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    u = window_totals(spark.read.parquet(os.path.join(base, "log")))
    return u.select(F.date_format(F.col("w.start"), "yyyy-MM-dd").alias("day"), "tool", "calls",
                    "input_tokens", "output_tokens", money_round("cost_usd", 6).alias("cost_usd"))
