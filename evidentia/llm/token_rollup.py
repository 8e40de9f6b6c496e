"""Token counts kept by deltas: additive totals per source, language and
tokenizer version, changed by signed batches that can be replayed."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["source", "lang", "tokenizer"]
SCHEMA = "source string, lang string, tokenizer string, docs long, tokens long, batch string"

# --- fixed values: tokenizers that built-in functions can express -----------------
TOKENIZERS = {
    "space-1": r"[^\x20\x09-\x0D]+",
    "alnum-1": r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+",
}
# -----------------------------------------------------------------------------------


def count_tokens(text: Column, tokenizer: str) -> Column:
    """Number of tokens of a text; null has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(TOKENIZERS[tokenizer])).cast("long")


def counted(docs: DataFrame, tokenizers=tuple(TOKENIZERS)) -> DataFrame:
    """One row per document and tokenizer version: doc_id, source, lang,
    tokenizer, tokens. Each text is read once for all versions."""
    each = F.array(*[F.struct(F.lit(t).alias("tokenizer"), count_tokens(F.col("text"), t).alias("tokens")) for t in tokenizers])
    return docs.select("doc_id", "source", "lang", F.explode(each).alias("c")).select("doc_id", "source", "lang", "c.*")


def inserts(counts: DataFrame) -> DataFrame:
    return counts.select(*KEYS, F.lit(1).cast("long").alias("docs"), "tokens")


def deletes(counts: DataFrame) -> DataFrame:
    return counts.select(*KEYS, F.lit(-1).cast("long").alias("docs"), (-F.col("tokens")).alias("tokens"))


def revisions(before: DataFrame, after: DataFrame) -> DataFrame:
    """Old counts out, new ones in (also where the source or language changed)."""
    return deletes(before).unionByName(inserts(after))


class TokenRollup:
    """Totals as the sum of committed batches under ``path`` (shared storage).

    A batch is one folder, named by its id, holding its changes summed per
    key (combined before the shuffle; a source of any size is a few rows per
    task). ``commit`` writes it under a temporary name and renames it, so a
    batch is there as a whole or not at all; an id that is there already is
    left as it is, which makes replays harmless. Totals read every batch
    ever committed; batches are not folded.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _fs(self, *parts):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(os.path.join(self.path, *parts))
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def batches(self) -> list:
        """Ids of the committed batches, in order."""
        fs, p = self._fs()
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted(n[len("batch-"):] for n in names if n.startswith("batch-"))

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add ``changes`` (source, lang, tokenizer, docs, tokens) as batch
        ``batch``; False if it had been committed before. Null sources and
        languages are keys of their own; no changes make an empty batch."""
        fs, final = self._fs(f"batch-{batch}")
        if fs.exists(final):
            return False
        _, work = self._fs(f"_work-{batch}")
        sums = changes.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        sums.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(work.toString())
        if not fs.rename(work, final):
            raise OSError(f"batch {batch} could not be renamed")
        return True

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, docs, tokens over all committed batches;
        keys without documents and tokens are left out."""
        done = self.batches()
        if not done:
            return self.spark.createDataFrame([], SCHEMA).drop("batch")
        d = self.spark.read.schema(SCHEMA).parquet(*[self._fs(f"batch-{b}")[1].toString() for b in done])
        return d.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).filter(
            "docs <> 0 or tokens <> 0")
