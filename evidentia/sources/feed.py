"""Feed sources (S2): Atom feed files read in bulk with the built-in XML
source, and raw web pages, both normalised into corpus rows (F1-F6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions.ids import author_list, date_prefix, https_url, paper_id_from_url
from evidentia.functions.text import collapse_ws, html_title, title_of
from evidentia.schemas import FEED_ENTRY

TAG = r"<[^>]*>"


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """Atom entries (rowTag = entry) with a fixed schema; no inference."""
    return (spark.read.format("xml").option("rowTag", "entry")
                 .option("ignoreNamespace", "true").schema(FEED_ENTRY).load(path))


def normalize_entries(entries: DataFrame, categories: bool = False) -> DataFrame:
    """Feed entries -> (id, title, authors, published_date, abstract, url),
    plus the entry's category terms when asked (for the topic filter)."""
    cols = [
        paper_id_from_url("id").alias("id"),
        collapse_ws("title").alias("title"),
        author_list("author").alias("authors"),
        date_prefix("published").alias("published_date"),
        collapse_ws("summary").alias("abstract"),
        https_url("id").alias("url")]
    if categories:
        cols.append(F.coalesce(F.transform("category", lambda c: c["_term"]),
                               F.array().cast("array<string>")).alias("categories"))
    return entries.select(*cols)


def pages_as_entries(pages: DataFrame) -> DataFrame:
    """Web pages as feed entries: id from the URL, title from the title
    tag, text with tags removed, whitespace collapsed, https URL."""
    return pages.select(
        "page_id",
        paper_id_from_url("url").alias("id"),
        collapse_ws(html_title("html"), unicode=False).alias("title"),
        F.lit("").alias("authors"),
        collapse_ws(F.regexp_replace("html", TAG, " "), unicode=False).alias("abstract"),
        https_url("url").alias("url"))


def write_feed(docs: DataFrame, path: str) -> None:
    """Documents as an Atom feed: versioned id, two authors (source and
    language), a timestamp, one category per language."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("doc_id", F.lit(365)).cast("int"))
    docs.select(
        F.concat(F.lit("http://example.org/abs/"), F.col("doc_id").cast("string"), F.lit("v1")).alias("id"),
        title_of("text").alias("title"), F.col("text").alias("summary"),
        F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T12:00:00Z")).alias("published"),
        F.array(F.struct(F.col("source").alias("name")), F.struct(F.col("lang").alias("name"))).alias("author"),
        F.array(F.struct(F.col("lang").alias("_term"))).alias("category"),
    ).write.format("xml").option("rowTag", "entry").option("rootTag", "feed").save(path)
