"""Tables that an operator writes on the way and drops when they are used up."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession

from evidentia.session import drop_path, stage


class Scratch:
    """Written tables of one call, by name: writing a name again drops the
    table that had it, once the new one (which may read the old) is there."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[str, str] = {}

    def table(self, df: DataFrame, name: str) -> DataFrame:
        out, path = stage(df, name)
        old, self.paths[name] = self.paths.get(name), path
        if old:
            drop_path(self.spark, old)
        return out

    def drop(self, *names: str) -> None:
        for n in names:
            if n in self.paths:
                drop_path(self.spark, self.paths.pop(n))

    def close(self) -> None:
        """Drop every table; then have both garbage collectors run, so that
        Spark's cleaner drops the shuffle files and broadcasts that only they
        needed (it acts when the driver's objects for them are collected)."""
        self.drop(*list(self.paths))
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()
