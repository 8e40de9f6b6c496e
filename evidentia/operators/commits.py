"""One commit per table change.

A stored table is a folder of generations and a log of commits:

    <path>/gen=<id>/bucket=<n>/part-*.parquet    rows, written once, never changed
    <path>/_commits/<version>.json               which generation holds each bucket

A change writes its rows to a new generation and then publishes one small file
that names, for every bucket, the generations to read, the oldest first. Where a
key is in several, the newest counts (``live_rows``), so a change need not write
what it does not change. Until that file is
there readers see the old table, from then on the new one; a change that stops
anywhere leaves at worst a generation that no commit names. Publishing is a
rename that refuses an existing version, so of two writers that started from
the same version the second is told (``ConcurrentChangeError``) and nothing of
it is seen. Generations that only old versions name are removed by ``vacuum``.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass, field
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidentia.operators.sizing import broadcast_if_bounded
from evidentia.session import drop_path, path_exists

LOG = "_commits"
KEEP_VERSIONS = 3              # versions whose files stay readable after a change
ORPHAN_HOURS = 24.0            # a generation that no commit names is left alone for so long (a writer may be at it)


class ConcurrentChangeError(RuntimeError):
    """Another change was published since this one read the table."""


class Run(NamedTuple):
    gen: str                                             # generation
    age: int                                             # version that wrote it
    rows: int                                            # rows of the bucket in it


@dataclass(frozen=True)
class Commit:
    version: int
    buckets: int
    generations: dict = field(default_factory=dict)      # bucket with rows -> its runs, the oldest first
    rows: int | None = None                              # rows of the whole table

    def text(self) -> str:
        return json.dumps({"version": self.version, "buckets": self.buckets, "rows": self.rows,
                           "generations": {str(b): runs for b, runs in sorted(self.generations.items())}})

    @staticmethod
    def read(text: str) -> "Commit":
        d = json.loads(text)
        # a commit of an older kind names one generation a bucket
        runs = {int(b): [Run(g, 0, 0)] if isinstance(g, str) else [Run(*r) for r in g] for b, g in d["generations"].items()}
        return Commit(d["version"], d["buckets"], runs, d["rows"])

    def named(self) -> set:
        return {r.gen for runs in self.generations.values() for r in runs}


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def folder_names(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(name, time of last change in ms) of what lies in a folder; none if there is no folder."""
    if not path_exists(spark, path):
        return []
    fs, p = _fs(spark, path)
    return [(s.getPath().getName(), s.getModificationTime()) for s in fs.listStatus(p)]


def _log(path: str) -> str:
    return f"{path.rstrip('/')}/{LOG}"


def versions(spark: SparkSession, path: str) -> list[int]:
    """Published versions, the newest last."""
    return sorted(int(n[:-5]) for n, _ in folder_names(spark, _log(path)) if n.endswith(".json") and n[:-5].isdigit())


def _file(path: str, version: int) -> str:
    return f"{_log(path)}/{version:020d}.json"


def commit_at(spark: SparkSession, path: str, version: int | None = None) -> Commit | None:
    """The commit that readers follow now, or that of ``version``; None if the
    folder holds no table."""
    if version is None:
        known = versions(spark, path)
        if not known:
            return None
        version = known[-1]
    fs, p = _fs(spark, _file(path, version))
    stream = fs.open(p)
    try:
        return Commit.read(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def publish(spark: SparkSession, path: str, commit: Commit) -> None:
    """Make ``commit`` the newest version. Its text is written aside first, so
    a reader finds all of it or nothing; an existing version is never replaced."""
    jvm = spark.sparkContext._jvm
    fs, aside = _fs(spark, f"{_log(path)}/.{uuid.uuid4().hex}.tmp")
    out = fs.create(aside, False)
    try:
        out.write(bytearray(commit.text().encode()))
    finally:
        out.close()
    target = jvm.org.apache.hadoop.fs.Path(_file(path, commit.version))
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(getattr(jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
    try:
        context.rename(fs.makeQualified(aside), fs.makeQualified(target), options)
    except Exception as e:
        fs.delete(aside, False)
        if fs.exists(target):
            raise ConcurrentChangeError(f"version {commit.version} of {path} was published by another change") from e
        raise


def write_generation(path: str, rows: DataFrame) -> dict:
    """Write ``rows`` (with a ``bucket`` column) as a new generation; the
    buckets that got rows, with its name. Nothing is visible yet."""
    spark = rows.sparkSession
    gen = uuid.uuid4().hex
    folder = f"{path.rstrip('/')}/gen={gen}"
    rows.write.partitionBy("bucket").parquet(folder)
    return {int(n[7:]): gen for n, _ in folder_names(spark, folder) if n.startswith("bucket=")}


def live_rows(rows: DataFrame, ages: dict, key: str, few: bool) -> DataFrame:
    """``rows`` (with their ``gen``) without those whose key a later generation
    holds. Keys and ages alone are grouped. Unless there are ``few`` rows, the
    keys that come again are counted first: none, and no row is moved at all."""
    age = F.create_map(*[F.lit(x) for g, a in sorted(ages.items()) for x in (g, a)])[F.col("gen")]
    aged = rows.withColumn("_age", age)
    last = aged.groupBy(key).agg(F.min("_age").alias("_first"), F.max("_age").alias("_last")).filter("_first < _last").select(
        F.col(key).alias("_key"), "_last")
    n = None if few else last.count()
    if n == 0:
        return rows
    return aged.join(broadcast_if_bounded(last, n, row_bytes=56),
                     (F.col(key) == F.col("_key")) & (F.col("_age") < F.col("_last")), "left_anti")


def read_commit(spark: SparkSession, path: str, commit: Commit, schema: T.StructType,
                buckets: list[int] | None = None, key: str = "id", only: DataFrame | None = None,
                columns: list | None = None) -> DataFrame:
    """The rows of ``commit``, or of some of its buckets, or those whose key is
    in ``only``. Only folders that the commit names are listed or read; a filter
    on ``bucket`` prunes them. ``columns`` (the key among them) are made as the
    rows are read, so no more than these is moved."""
    root = path.rstrip("/")
    held = commit.generations if buckets is None else {b: commit.generations[b] for b in buckets if b in commit.generations}
    if not held:
        none = spark.createDataFrame([], schema)
        return none if columns is None else none.select(*columns)
    with_gen = T.StructType([*[f for f in schema.fields if f.name != "bucket"], T.StructField("gen", T.StringType()),
                             T.StructField("bucket", T.IntegerType())])
    paths = [f"{root}/gen={r.gen}/bucket={b}" for b, runs in sorted(held.items()) for r in runs]
    rows = spark.read.schema(with_gen).option("basePath", root).parquet(*paths)
    if only is not None:
        rows = rows.join(only, key, "left_semi")
    names = schema.fieldNames()
    if columns is not None:
        names = spark.createDataFrame([], schema).select(*columns).columns
        rows = rows.select(*columns, "gen")
    if any(len(runs) > 1 for runs in held.values()):
        rows = live_rows(rows, {r.gen: r.age for runs in held.values() for r in runs}, key, only is not None)
    return rows.select(*names)


def history(spark: SparkSession, path: str) -> DataFrame:
    """(version, rows, buckets, filled): one row per version that is kept."""
    known = [commit_at(spark, path, v) for v in versions(spark, path)]
    return spark.createDataFrame([(c.version, c.rows, c.buckets, len(c.generations)) for c in known],
                                 "version long, rows long, buckets long, filled long")


def vacuum(spark: SparkSession, path: str, keep: int = KEEP_VERSIONS, orphan_hours: float = ORPHAN_HOURS) -> int:
    """Remove the generations that none of the newest ``keep`` versions names,
    and the older commits; the number of generations removed. A generation
    that no commit ever named goes only after ``orphan_hours``."""
    known = versions(spark, path)
    if not known:
        return 0
    old, kept = known[:-keep], known[-keep:]
    live, dead = set(), set()
    for v in kept:
        live |= commit_at(spark, path, v).named()
    for v in old:
        dead |= commit_at(spark, path, v).named()
    limit = (time.time() - orphan_hours * 3600) * 1000
    gone = 0
    for name, changed in folder_names(spark, path):
        gen = name[4:]
        if name.startswith("gen=") and gen not in live and (gen in dead or changed < limit):
            drop_path(spark, f"{path.rstrip('/')}/{name}")
            gone += 1
    for v in old:
        drop_path(spark, _file(path, v))
    return gone
