"""Exact substring containment: which documents contain which passage
verbatim. One path at every size, built-in functions only.

A token of the passage that touches neither of its ends is a whole token of
any document that contains it, and two such tokens in a row stand in a row
there too. Each passage is keyed by the rarest of its inner token pairs (by
documents that hold the pair; of its inner tokens, if it has only one); a
passage with a pair that no document holds is contained nowhere. Documents
meet passages by key, and each candidate is decided on the text itself.

Only pairs that some passage has leave a document, each once per document.
Passages without an inner token (one or two tokens that touch the ends) are a
query set that is held against all documents in blocks of BLOCK texts, each
block one scan without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.operators.sizing import spread
from evidentia.session import cut_lineage

TOKEN = r"[\p{L}\p{N}]+"
BLOCK = 256                    # passages without an inner token that one scan looks for


def _tokens(text):
    return F.regexp_extract_all(text, F.lit(TOKEN), 0)


def _pairs(tokens):
    """Every two tokens in a row."""
    last = F.greatest(F.size(tokens) - 1, F.lit(0))
    return F.zip_with(F.slice(tokens, F.lit(1), last), F.slice(tokens, F.lit(2), last), lambda a, b: F.concat(a, F.lit(" "), b))


def _keyed(passages: DataFrame) -> DataFrame:
    """(i, keys) of the passages: inner token pairs, else inner tokens, else none."""
    inner = _tokens(F.regexp_replace(F.regexp_replace("t", rf"^{TOKEN}", ""), rf"{TOKEN}$", ""))
    p = passages.select("i", inner.alias("w"))
    return p.select("i", F.array_distinct(F.when(F.size("w") > 1, _pairs(F.col("w"))).otherwise(F.col("w"))).alias("keys"))


def _by_key(passages: DataFrame, keys: DataFrame, docs: DataFrame) -> DataFrame:
    """(i, d) of passages with an inner token."""
    wanted = keys.select("i", F.explode("keys").alias("key"))
    both = docs.select("d", _tokens("t").alias("w")).select(
        "d", F.explode(F.array_distinct(F.concat(_pairs(F.col("w")), "w"))).alias("key"))
    held = cut_lineage(both.join(wanted.select("key").distinct(), "key", "left_semi"), "passage-keys")
    seen = held.groupBy("key").agg(F.count(F.lit(1)).alias("docs"))
    docs_of = F.coalesce("docs", F.lit(0))
    rarest = wanted.join(seen, "key", "left").groupBy("i").agg(F.min(F.struct(docs_of.alias("docs"), "key")).alias("k"))
    found = rarest.filter(F.col("k.docs") > 0).select("i", F.col("k.key").alias("key")).join(held, "key").select("i", "d")
    return (found.join(passages.withColumnRenamed("t", "pt"), "i").join(docs, "d")
                 .filter(F.instr("t", F.col("pt")) > 0).select("i", "d").distinct())


def _by_block(passages: DataFrame, docs: DataFrame, block: int) -> DataFrame:
    """(i, d) of passages without an inner token: their distinct texts, block
    by block, against all documents."""
    texts = cut_lineage(passages.select("t").distinct().withColumn(
        "n", F.pmod(F.xxhash64("t"), F.lit(-(-passages.count() // block) or 1))), "edge-passages")
    found = None
    for r in texts.select("n").distinct().orderBy("n").collect():                     # one row per block
        part = [x["t"] for x in texts.filter(F.col("n") == r["n"]).collect()]         # about BLOCK short texts
        hits = docs.select("d", F.explode(F.filter(F.array(*map(F.lit, part)), lambda p: F.instr(F.col("t"), p) > 0)).alias("t"))
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        return passages.sparkSession.createDataFrame([], "i long, d long")
    return found.join(passages, "t").select("i", "d").distinct()


def contained_in(items: DataFrame, docs: DataFrame, *, item_key: str = "item_id",
                 item_text: str = "text", doc_key: str = "doc_id", doc_text: str = "text",
                 block: int = BLOCK) -> DataFrame:
    """(item_id, doc_id) for every document whose text contains the item text.
    Null or empty passages and null texts match nothing."""
    passages = items.select(F.col(item_key).cast("long").alias("i"), F.col(item_text).alias("t")).filter(F.length("t") > 0)
    texts = spread(docs.select(F.col(doc_key).cast("long").alias("d"), F.col(doc_text).alias("t")).filter("t is not null"))
    keys = cut_lineage(_keyed(passages), "passages")
    out = _by_key(passages, keys.filter(F.size("keys") > 0), texts)
    edge = keys.filter(F.size("keys") == 0).select("i")
    if not edge.isEmpty():
        out = out.unionByName(_by_block(passages.join(edge, "i", "left_semi"), texts, block))
    return out.select(F.col("i").alias(item_key), F.col("d").alias(doc_key))
