"""Corpus sources (S1) and the mapping of the test tables onto the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions.embed import hashed_tf
from evidentia.functions.text import title_of
from evidentia.schemas import PAPERS
from evidentia.session import read_table

# --- fixed values of the test-table mapping --------------------------------
FIXTURE_URL_PREFIX = "https://example.org/abs/"
FIXTURE_EPOCH = "2024-01-01"          # published_date = epoch + doc_id % 365 days
FIXTURE_INGESTED_AT = "2024-02-01 00:00:00"
# ---------------------------------------------------------------------------


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Scan a stored corpus with the fixed eight-column schema."""
    return spark.read.schema(PAPERS).parquet(path)


def documents_as_papers(docs: DataFrame) -> DataFrame:
    """documents(doc_id, text, source, ...) -> the seven scalar corpus columns."""
    return docs.select(
        F.col("doc_id").cast("string").alias("id"),
        title_of("text").alias("title"),
        F.col("source").alias("authors"),
        F.date_add(F.lit(FIXTURE_EPOCH).cast("date"), F.pmod(F.col("doc_id"), F.lit(365)).cast("int")).alias("published_date"),
        F.col("text").alias("abstract"),
        F.concat(F.lit(FIXTURE_URL_PREFIX), F.col("doc_id").cast("string")).alias("url"),
        F.col("doc_id"),
    )


def fixture_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus with stored vectors: documents left join embeddings on id.
    Documents without a vector keep a null embedding (excluded from search)."""
    docs = read_table(spark, sf_dir, "documents")
    emb = read_table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("doc_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    p = documents_as_papers(docs).join(emb, "doc_id", "left")
    return p.select(*[c for c in PAPERS.fieldNames() if c != "ingested_at"],
                    F.lit(FIXTURE_INGESTED_AT).cast("timestamp").alias("ingested_at"))


def hashed_corpus(spark: SparkSession, sf_dir: str, dims: int = 256) -> DataFrame:
    """(paper_id, embedding, n_tokens, nnz) for every document with a token,
    embedded with the built-in hashed term-frequency model over whole texts."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    v = hashed_tf(docs, "doc_id", "text", dims)
    return v.select(F.col("doc_id").cast("string").alias("paper_id"), "embedding", "n_tokens", "nnz")


def paper_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus columns search never needs (joined after top-k)."""
    return documents_as_papers(read_table(spark, sf_dir, "documents")).withColumnRenamed("id", "paper_id")
