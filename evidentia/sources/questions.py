"""Question-set sources (S3) and question clean-up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions.text import strip_ws
from evidentia.operators.containment import contained_in
from evidentia.schemas import QUESTIONS
from evidentia.session import read_table

STATUSES = ("answerable", "partial", "unanswerable")


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with qid, question, expected_status, notes; no inference."""
    return spark.read.schema(QUESTIONS).json(path)


def clean_questions(q: DataFrame) -> DataFrame:
    """Strip the question of all white space around it and reject blank ones."""
    return q.withColumn("question", strip_ws("question")).filter(
        F.col("question").isNotNull() & (F.col("question") != ""))


def benchmark_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, doc_id): documents containing a benchmark item verbatim."""
    return contained_in(read_table(spark, sf_dir, "benchmark"),
                        read_table(spark, sf_dir, "documents"))


def fixture_questions(spark: SparkSession, sf_dir: str, truth: DataFrame | None = None) -> DataFrame:
    """Benchmark items as questions. answerable when some document contains
    the item verbatim, else unanswerable; every fifth item is relabelled
    partial (the fixture needs all three labels)."""
    b = read_table(spark, sf_dir, "benchmark")
    t = truth if truth is not None else benchmark_truth(spark, sf_dir)
    found = t.select(F.col("item_id").alias("qid")).distinct().withColumn("_found", F.lit(True))
    q = b.select(F.col("item_id").cast("long").alias("qid"), F.col("text").alias("question"))
    q = q.join(found, "qid", "left")
    status = (F.when(F.pmod(F.col("qid"), F.lit(5)) == 0, F.lit("partial"))
               .when(F.col("_found"), F.lit("answerable"))
               .otherwise(F.lit("unanswerable")))
    return q.select("qid", "question", status.alias("expected_status"), F.lit("").alias("notes"))
