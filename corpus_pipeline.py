"""Corpus pipeline: the stages that turn ``documents`` into a training mix.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir)
and returns the documents that go on. Every stage's result is written as
Parquet and read again as the next one's input. All stages but the last
return the columns of ``documents``; the last adds ``copy``, one row per copy
that the mix takes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evidentia.llm import decontaminate as D
from evidentia.llm import exact_dedup as X
from evidentia.llm import jaccard_join as J
from evidentia.llm import mixing as M
from evidentia.llm import quality as Q
from evidentia.llm.queries import quality_model
from evidentia.session import cut_lineage, read_table, ship_package

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
REJECT_BELOW = 0.5             # quality score under which a document goes


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    ship_package(spark)
    return Q.reject(docs.select(COLUMNS), quality_model(spark, sf_dir), REJECT_BELOW)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each group of equal normalised texts."""
    ship_package(spark)
    return X.exact_dedup(docs).select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each component of similar documents."""
    ship_package(spark)
    return J.near_dedup(docs).select(COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by benchmark items."""
    ship_package(spark)
    return D.decontaminate(docs, read_table(spark, sf_dir, "benchmark")).select(COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per copy of a document that the mix takes."""
    ship_package(spark)
    return M.mixed(docs)


STAGES = [("quality", quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup),
          ("decontaminate", decontaminate), ("mix", mix)]

# the classifier, the components and the sampling cannot be put as SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
