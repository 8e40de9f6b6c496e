"""Word rarity: one bounded table of how often words occur in a corpus."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.words import blocks, byte_tables, words

SLOTS = 1 << 24                # one byte each: the broadcast is 16 MB whatever the corpus


def _count(slots: int, lower: bool):
    def run(batches):
        tables = byte_tables(True, lower)
        counts = None
        for b in blocks(batches, "text"):
            if counts is None:
                counts = np.zeros(slots, dtype=np.int32)
            slot = (words(b.column(0), tables).hash & np.uint64(slots - 1)).astype(np.int64)
            at, n = np.unique(slot, return_counts=True)
            counts[at] += n.astype(np.int32)
        if counts is not None:
            at = np.flatnonzero(counts)
            for lo in range(0, len(at), 1 << 16):
                part = at[lo:lo + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(counts[part].astype(np.int64))],
                                                 names=["slot", "n"])
    return run


def word_levels(docs: DataFrame, text_col: str = "text", lower: bool = True, slots: int = SLOTS):
    """Broadcast array of ``slots`` bytes. Entry ``hash % slots`` is 0 if the
    words of that slot occur once or never in the corpus, else
    floor(8 log2(occurrences)), 255 at most. Words that share a slot add up,
    so an entry never understates how often a word occurs: it is an upper
    bound on the frequency of the word and of any shingle that holds it.

    Counts cover every word of every text and are combined in each task and
    before the shuffle; at most ``slots`` numbers reach the driver."""
    counts = docs.select(F.col(text_col).alias("text")).mapInArrow(_count(slots, lower), "slot int, n long")
    totals = counts.groupBy("slot").agg(F.sum("n").alias("n")).filter("n > 1").select(
        "slot", F.least(F.floor(F.log2(F.col("n")) * 8), F.lit(255)).cast("short").alias("level")).toArrow()
    level = np.zeros(slots, dtype=np.uint8)
    level[totals.column("slot").to_numpy()] = totals.column("level").to_numpy()
    return docs.sparkSession.sparkContext.broadcast(level)
