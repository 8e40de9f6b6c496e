"""A ledger of paid model calls: no input is paid for twice.

A call is named by a hash of (step, model, input columns). Its answer, zero or
more rows, is appended to the ledger by the task that made the call, right
after the call and before the next one:

    <path>/step=<step>/<name>.parquet      answers of one batch of calls
    <path>/runs/                           one row per run: inputs, known, called

A run asks only for what the ledger does not hold, each distinct input once.
Batches are cut from a written table in a fixed order and named by their
calls, so a task that is started again finds the batches of the lost attempt
and goes on after them; a job that is started again finds everything answered
before it stopped. Lost is at most the one call that was under way.

Files are written aside and renamed, so a reader finds whole batches only.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import time
import uuid
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidentia.session import cut_lineage, drop_path, path_exists

CALL = [T.StructField("call", T.StringType()), T.StructField("model", T.StringType()),
        T.StructField("n_rows", T.LongType()), T.StructField("latency_ms", T.DoubleType()),
        T.StructField("called_at", T.TimestampType())]
RUN = "run string, step string, model string, inputs long, calls long, known long, called long, run_at timestamp"


@dataclass(frozen=True)
class Ledger:
    """The answers of one model step, under a folder that driver and executors share."""
    path: str
    step: str
    model: str

    @property
    def folder(self) -> str:
        return f"{self.path.rstrip('/')}/step={self.step}"

    def schema(self, rows: T.StructType) -> T.StructType:
        return T.StructType([*CALL, T.StructField("rows", T.ArrayType(rows))])

    def answers(self, spark: SparkSession, rows: T.StructType) -> DataFrame:
        """(call, model, n_rows, latency_ms, called_at, rows): one row per call.
        A call that stands in several files (a compaction that stopped
        half-way) counts once."""
        if not path_exists(spark, self.folder):
            return spark.createDataFrame([], self.schema(rows))
        return spark.read.schema(self.schema(rows)).parquet(self.folder).dropDuplicates(["call"])

    def compact(self, spark: SparkSession, rows: T.StructType) -> int:
        """Rewrite the many small files of the step as few; the number of files
        that went. The new files are there before the old ones go. Not to be
        run beside a run of the same step."""
        if not path_exists(spark, self.folder):
            return 0
        old = spark.read.schema(self.schema(rows)).parquet(self.folder).inputFiles()
        self.answers(spark, rows).write.mode("append").parquet(self.folder)
        for f in old:
            drop_path(spark, f)
        return len(old)


def calls(spark: SparkSession, path: str) -> DataFrame:
    """(step, call, model, n_rows, latency_ms, called_at) of every step's calls."""
    schema = T.StructType([*CALL, T.StructField("step", T.StringType())])
    return (spark.read.schema(schema).option("basePath", path).parquet(f"{path.rstrip('/')}/step=*")
                 .dropDuplicates(["step", "call"]))


def runs(spark: SparkSession, path: str) -> DataFrame:
    """One row per run through the ledger at ``path``."""
    return spark.read.schema(RUN).parquet(f"{path.rstrip('/')}/runs")


def call_name(ledger: Ledger, columns: list[str]):
    """Hash of step, model and the input columns."""
    return F.sha2(F.to_json(F.struct(F.lit(ledger.step).alias("_step"), F.lit(ledger.model).alias("_model"), *columns),
                            {"ignoreNullFields": "false"}), 256)


def _store(folder: str):
    """(file system, folder) as a task sees it."""
    from pyarrow import fs
    if "://" not in folder and not folder.startswith("file:"):
        return fs.LocalFileSystem(), folder
    if folder.startswith("file:"):
        return fs.LocalFileSystem(), "/" + folder[5:].lstrip("/")
    return fs.FileSystem.from_uri(folder)


def _append(store, root: str, name: str, table) -> None:
    import pyarrow.parquet as pq
    aside = f"{root}/.{name}-{uuid.uuid4().hex}"
    with store.open_output_stream(aside) as out:
        pq.write_table(table, out)
    store.move(aside, f"{root}/{name}")


def call_once(df: DataFrame, fn, schema: T.StructType, id_col: str, ledger: Ledger, call, paced,
              batch_size: int) -> DataFrame:
    """Rows of ``schema`` for every row of ``df``, through the ledger. ``fn``
    takes a pandas slice of ``df`` and returns rows that carry ``id_col``;
    ``call(fn, slice)`` makes one call under the call policy, ``paced(df, run,
    schema)`` runs the calling tasks and tells them when to call. Rows of ``df`` that differ only in
    ``id_col`` are one call, whose answer all of them get."""
    from pyspark.sql.pandas.types import to_arrow_schema
    spark = df.sparkSession
    inputs = [c for c in df.columns if c != id_col]
    rest = T.StructType([f for f in schema.fields if f.name != id_col])
    named = df.withColumn("_call", call_name(ledger, inputs))
    asked = cut_lineage(named.select(id_col, "_call"), "ledger-asked")
    before = ledger.answers(spark, rest).select(F.col("call").alias("_call"))
    open_calls = cut_lineage(asked.select("_call").distinct().join(before, "_call", "left_anti"), "ledger-open")
    n_open = open_calls.count()
    if n_open:
        todo = cut_lineage(named.join(open_calls, "_call", "left_semi").dropDuplicates(["_call"]), "ledger-todo")
        folder, model, columns = ledger.folder, ledger.model, df.columns
        arrow = to_arrow_schema(ledger.schema(rest))

        def run(batches, before_call):
            import pyarrow as pa
            from pyarrow import fs
            store, root = _store(folder)
            store.create_dir(root, recursive=True)
            made = 0
            for pdf in batches:
                for lo in range(0, len(pdf), batch_size):
                    part = pdf.iloc[lo:lo + batch_size].reset_index(drop=True)
                    name = hashlib.sha256("".join(part["_call"]).encode()).hexdigest() + ".parquet"
                    if store.get_file_info(f"{root}/{name}").type != fs.FileType.NotFound:
                        continue                                   # answered by an attempt that was lost
                    before_call()
                    began = time.monotonic()
                    out = call(fn, part[columns])
                    took = (time.monotonic() - began) * 1000 / len(part)
                    answers: dict = {str(i): [] for i in part[id_col]}
                    for row in [] if out is None else out.to_dict("records"):
                        answers[str(row[id_col])].append({f.name: row[f.name] for f in rest.fields})
                    now = dt.datetime.now(dt.timezone.utc)
                    records = [{"call": c, "model": model, "n_rows": len(answers[str(i)]), "latency_ms": took, "called_at": now,
                                "rows": answers[str(i)]} for c, i in zip(part["_call"], part[id_col])]
                    _append(store, root, name, pa.Table.from_pylist(records, schema=arrow))
                    made += len(part)
            yield pd.DataFrame({"made": [made]})

        paced(todo, run, "made long")
    answers = ledger.answers(spark, rest).select(F.col("call").alias("_call"), F.explode("rows").alias("r"))
    n_asked, n_calls = asked.count(), asked.select("_call").distinct().count()
    record = [(uuid.uuid4().hex, ledger.step, ledger.model, n_asked, n_calls, n_calls - n_open, n_open,
               dt.datetime.now(dt.timezone.utc))]
    spark.createDataFrame(record, RUN).coalesce(1).write.mode("append").parquet(f"{ledger.path.rstrip('/')}/runs")
    out = asked.join(answers, "_call").select(F.col(id_col).cast(schema[id_col].dataType).alias(id_col), "r.*")
    return out.select(*schema.fieldNames())
