"""Retrieval by id set (P3-P5, F6) and the per-question sources block (A1).

Late materialisation: search runs on (id, vector) only; the text columns
are joined afterwards, for the k hits per question. The hit set is bounded
by questions x k, so it is the broadcast side (checked), and the corpus
text is scanned once with no shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.functions.ids import iso_date
from evidentia.functions.text import preview, token_count
from evidentia.operators.sizing import broadcast_if_bounded

RETRIEVED_COLUMNS = ["qid", "rank", "paper_id", "title", "authors", "published_date",
                     "abstract", "url"]


def retrieve(hits: DataFrame, papers: DataFrame, hits_rows_bound: int | None = None) -> DataFrame:
    """(qid, rank, paper_id, title, authors, published_date ISO string,
    abstract, url) for the ids of each question's hits. Ids missing from the
    corpus are silently absent; a repeated id yields one row."""
    h = hits.select("qid", "rank", "paper_id").dropDuplicates(["qid", "paper_id"])
    h = broadcast_if_bounded(h, hits_rows_bound, row_bytes=48)
    cols = papers.select("paper_id", "title", "authors", "published_date", "abstract", "url")
    j = cols.join(h, "paper_id", "inner")
    return j.select("qid", "rank", "paper_id", "title", "authors",
                    iso_date("published_date").alias("published_date"), "abstract", "url")


def retrieve_ids(ids: DataFrame, papers: DataFrame, ids_rows_bound: int | None = None) -> DataFrame:
    """Single-request form: papers whose id is in ``ids(paper_id)``; a left
    semi join, so duplicates in the id list do not duplicate rows."""
    i = broadcast_if_bounded(ids.select("paper_id"), ids_rows_bound, row_bytes=40)
    return papers.join(i, "paper_id", "left_semi").select(
        "paper_id", "title", "authors", iso_date("published_date").alias("published_date"),
        "abstract", "url")


def previews(retrieved: DataFrame) -> DataFrame:
    """Preview form: six columns with the first 150 characters of the text."""
    return retrieved.select("qid", "rank", "paper_id", "title", "authors", "published_date", "url",
                            preview("abstract").alias("abstract_preview"))


def sources_block(questions: DataFrame, retrieved: DataFrame) -> DataFrame:
    """(qid, prompt): the claim writer's prompt, sources in rank order.
    Questions without retrieved papers get no prompt (no model call)."""
    entry = F.concat(F.lit("paper_id: "), F.col("paper_id"), F.lit("\ntitle: "), F.col("title"),
                     F.lit("\nabstract: "), F.col("abstract"))
    blocks = retrieved.groupBy("qid").agg(
        F.array_sort(F.collect_list(F.struct("rank", entry.alias("e")))).alias("_es"))
    block = F.array_join(F.transform("_es", lambda x: x["e"]), "\n\n")
    j = questions.select("qid", "question").join(blocks, "qid", "inner")
    prompt = F.concat(F.lit("Research question: "), F.col("question"),
                      F.lit("\n\nRetrieved abstracts:\n\n"), block)
    return j.select("qid", prompt.alias("prompt"))


def prompt_summary(prompts: DataFrame, col: str = "prompt") -> DataFrame:
    return prompts.select("qid", F.length(col).cast("long").alias("prompt_chars"),
                          F.md5(col).alias("prompt_md5"), token_count(col).alias("prompt_tokens"))
