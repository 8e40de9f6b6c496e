"""Session helpers: one place for the settings every job relies on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


# Sizing for a large cluster (hundreds of TB, ~1000 executors): scans split
# at 128 MB; shuffles start wide and AQE coalesces them towards ~128 MB per
# task, so a big shuffle never builds partitions that outgrow executor
# memory and a small one does not run thousands of empty tasks; skewed
# partitions above 256 MB are split. Joins are broadcast only on measured
# sizes (AQE, after the small side ran) or behind our own checked bounds,
# never on file-size estimates.
CLUSTER_DEFAULTS = {
    "spark.sql.files.maxPartitionBytes": str(128 << 20),
    "spark.sql.shuffle.partitions": "20000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(128 << 20),
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(256 << 20),
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 << 20),
}


def build_session(master: str | None = None, app: str = "evidentia",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """Local or cluster session with AQE, UTC and Arrow on and the UI off.

    On a cluster ``master`` is left to spark-submit; shuffle partitions are
    then sized by AQE from ``advisoryPartitionSizeInBytes``.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    elif not (master or "").startswith("local"):
        conf.update(CLUSTER_DEFAULTS)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``evidentia`` importable on every executor's Python workers
    (its Arrow/pandas stages run there): zip the package once per Spark
    context on the driver and distribute it with ``addPyFile``."""
    import zipfile
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    dest = os.path.join(tempfile.mkdtemp(prefix="evidentia-pkg-"), "evidentia.zip")  # driver-side build artifact
    with zipfile.ZipFile(dest, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(dest)
    _SHIPPED.add(key)


class NoSharedFolderError(RuntimeError):
    """``spark.checkpoint.dir`` must name shared storage on a cluster."""


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster the operator sets it to shared storage and we only read it;
    unset, we refuse to go on. Only a local master (tests) gets a scratch
    folder of its own.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise NoSharedFolderError("set spark.checkpoint.dir to a folder that driver and executors share")
        d = tempfile.mkdtemp(prefix="evidentia-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    # each call makes a folder; Spark may have put a scheme before the path
    if d.split("://")[-1].rstrip("/") not in (spark.sparkContext.getCheckpointDir() or ""):
        spark.sparkContext.setCheckpointDir(d)
    return d


def stage(df: DataFrame, name: str = "stage") -> tuple[DataFrame, str]:
    """``df`` written once as a parquet table in the shared checkpoint
    folder: (the table, its path)."""
    import uuid
    path = os.path.join(checkpoint_dir(df.sparkSession), f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def cut_lineage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once as a parquet table in the shared checkpoint folder
    and continue from the written table: one job, and the lineage before it
    is never re-run (a lost executor re-reads files instead). Never a
    localCheckpoint."""
    return stage(df, name)[0]


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` is there, on whatever store it names; errors are raised."""
    fs, p = _path(spark, path)
    return fs.exists(p)


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a folder that this library staged."""
    fs, p = _path(spark, path)
    fs.delete(p, True)


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))
