"""Exact deduplication by content hash, with the bytes compared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHITE_SPACE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """Text with each run of white space replaced by one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE_SPACE, " ")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Rows are grouped by the 128-bit hash of the normalised text, combined
    before the shuffle, so only hashes and ids move. Only the texts of hashes
    that occur more than once are then grouped by their bytes (again combined
    before the shuffle, so a group of any size moves one text per task): two
    texts that share a hash but not their bytes stay apart. The smallest id
    of each group stays.

    Null text counts as empty. A null id is larger than any other. Of rows
    that repeat the kept id in one group, all are marked kept (they cannot be
    told apart by id). No rows in, no rows out. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("norm"))
    rows = rows.select("doc_id", "norm", F.unhex(F.md5("norm")).alias("hash"))
    hashes = rows.groupBy("hash").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("rows"))
    repeated = hashes.filter("rows > 1").select(F.col("hash").alias("r_hash"))
    same = (rows.join(repeated, F.col("hash") == F.col("r_hash"), "left_semi")
            .groupBy("hash", "norm").agg(F.min("doc_id").alias("keep"), F.count(F.lit(1)).alias("size"))
            .select(F.col("hash").alias("g_hash"), F.sha2("norm", 256).alias("g_sha"), "keep", "size"))
    marked = rows.select("doc_id", "hash", F.sha2("norm", 256).alias("text_sha256"))
    out = marked.join(same, (F.col("hash") == F.col("g_hash")) & (F.col("text_sha256") == F.col("g_sha")), "left")
    single = F.col("size").isNull()
    out = out.select("doc_id", F.when(single, F.col("doc_id")).otherwise(F.col("keep")).alias("keep_id"),
                     F.coalesce("size", F.lit(1)).cast("long").alias("group_size"), "text_sha256")
    return out.select("doc_id", "keep_id", "group_size",
                      F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` that stay, with all their columns. Rows that repeat
    both the id and the text of a kept row cannot be told from it and stay."""
    groups = exact_groups(docs, id_col, text_col).filter("not kept").select(
        F.col("doc_id").alias("drop_id"), F.col("text_sha256").alias("drop_sha")).distinct()
    sha = F.sha2(normalised(docs[text_col]), 256)
    return docs.join(groups, docs[id_col].eqNullSafe(groups["drop_id"]) & (sha == groups["drop_sha"]), "left_anti")
