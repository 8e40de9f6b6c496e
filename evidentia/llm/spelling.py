"""Spelling variants: words at one edit from each other, and the frequent form
that a rare variant stands for.

``near_words`` finds, for every word of a vocabulary, the words that differ by
exactly one inserted, deleted or replaced code point. Two such words share the
first half or the last half of the shorter one, so words meet in groups by
half; in a cell of groups a bit-sliced index holds one bitset of words per
(position, letter), and a query word runs through it letter by letter, with
word-parallel recurrences that carry the words met without error and those met
with one (replaced: same position, inserted: one further, deleted: one back).

Cells hold about CELL rows. A group of more than CELL words is cut into pieces
on both sides, each pair of pieces a cell of its own, so no group meets in one
task; what leaves a cell is one row per word (count and best near word), never
a pair.

Inputs and outputs: ``vocabulary`` takes documents and returns (word, n);
``spelling_groups`` takes any (word, n) and returns (word, n, n_near, form,
form_n, root). Cases: null or empty texts have no words; a null id counts as
empty in the key of a run; other columns are not looked at, whatever their
names; repeated words of a vocabulary are added up, null words and null counts
take no part; an empty vocabulary gives an empty result; a run of any length
is one word, kept whole.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.session import cut_lineage, drop_path, stage

CELL = 4096                    # words of a cell's index, and of its queries
# --- fixed values of the contract ---------------------------------------------------
LETTERS = r"A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_LENGTH, MIN_COUNT = 7, 2
DROP_EVERY = 31                # runs whose key's crc32 this divides lose one code point
FORM_RATIO = 10                # a form is this many times as frequent as its variant
# ------------------------------------------------------------------------------------


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): words of all texts with at least ``min_length`` code points
    and ``min_count`` occurrences. Words are the maximal runs of letters, A-Z
    lower-cased; a run whose key ``<id>:<run>`` has a crc32 that DROP_EVERY
    divides is taken without its code point crc32 % length. Counted per task
    before anything is shuffled."""
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id"),
                       F.explode(F.split(F.col(text_col), f"[^{LETTERS}]+")).alias("_run"))
    # a shorter run cannot give a word of min_length
    runs = runs.filter(F.length("_run") >= min_length).select("_id", F.translate("_run", UPPER, LOWER).alias("_run"))
    runs = runs.withColumn("_h", F.crc32(F.concat("_id", F.lit(":"), "_run").cast("binary")))
    at = (F.col("_h") % F.length("_run")).cast("int")
    cut = F.concat(F.substr("_run", F.lit(1), at), F.substr("_run", at + 2))
    word = F.when(F.col("_h") % DROP_EVERY == 0, cut).otherwise(F.col("_run"))
    return (runs.select(word.alias("word")).filter(F.length("word") >= min_length)
                .groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count))


# --- cells -----------------------------------------------------------------------------

def _halves(words: DataFrame) -> DataFrame:
    """Each word with the groups it belongs to: ``size`` is the length of the
    shorter word of the pairs met there, ``side`` the half that they share."""
    n = F.length("word")

    def groups(size, last):
        k = (size / 2).cast("int")
        first = F.substr("word", F.lit(1), k)
        # the last half of the shorter word: size - k letters at the end
        return [F.struct(size.cast("int").alias("size"), F.lit("first").alias("side"), first.alias("half"), F.lit("").alias("other")),
                F.struct(size.cast("int").alias("size"), F.lit("last").alias("side"),
                         F.substr("word", k + 1 + last, size - k).alias("half"), first.alias("other"))]

    # with words of its own length and one more, and with words one shorter
    both = F.array(*groups(n, F.lit(0)), *groups(n - 1, F.lit(1)))
    return words.select("word", "n", F.explode(both).alias("g")).select("word", "n", "g.*")


def _cells(halves: DataFrame, cell: int) -> DataFrame:
    """(cell, role, word, n, size, side, half, other); role: 0 both, 1 index, 2 query."""
    key = ["size", "side", "half"]
    sizes = halves.groupBy(*key).agg(F.count(F.lit(1)).alias("members"))
    total = halves.count()
    many = max(1, -(-total // cell))
    place = F.pmod(F.xxhash64(*key), F.lit(many))
    # words of a cell have lengths within a factor of two: a long word does not widen the index of short ones
    band = F.floor(F.log2(F.col("size") + 1))
    plain = F.concat_ws("/", band.cast("string"), place.cast("string"))
    sized = halves.join(sizes, key)
    small = sized.filter(F.col("members") <= cell).select(plain.alias("cell"), F.lit(0).alias("role"), "word", "n", *key, "other")
    large = sized.filter(F.col("members") > cell).withColumn("_parts", F.ceil(F.col("members") / cell).cast("int"))
    large = large.withColumn("_own", F.pmod(F.xxhash64("word", F.lit(1)), F.col("_parts")))
    every = large.withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))

    def piece(index, query):
        return F.concat_ws("/", "size", "side", "half", index.cast("string"), query.cast("string")).alias("cell")

    as_index = every.select(piece(F.col("_own"), F.col("_with")), F.lit(1).alias("role"), "word", "n", *key, "other")
    as_query = every.select(piece(F.col("_with"), F.col("_own")), F.lit(2).alias("role"), "word", "n", *key, "other")
    return small.unionByName(as_index).unionByName(as_query)


class SlicedIndex:
    """Bitsets of words by (position, letter), and by length."""

    def __init__(self, words: list[str]):
        self.count = len(words)
        self.slots = -(-self.count // 64)
        self.lengths = np.array([len(w) for w in words], dtype=np.int64)
        # utf-32 makes every code point one number
        points = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
        self.letters = np.unique(points)
        code = np.searchsorted(self.letters, points) + 1               # 0: a letter that no word has
        word = np.repeat(np.arange(self.count), self.lengths)
        start = np.cumsum(self.lengths) - self.lengths
        pos = np.arange(len(points)) - np.repeat(start, self.lengths)
        self.longest = int(self.lengths.max()) if self.count else 0
        self.bits = np.zeros((self.longest + 2, len(self.letters) + 1, self.slots), dtype=np.uint64)
        one = np.uint64(1) << (word % 64).astype(np.uint64)
        np.bitwise_or.at(self.bits, (pos, code, word // 64), one)
        self.of_length: dict[int, np.ndarray] = {}
        for n in np.unique(self.lengths).tolist():
            which = np.flatnonzero(self.lengths == n)
            row = np.zeros(self.slots, dtype=np.uint64)
            np.bitwise_or.at(row, which // 64, np.uint64(1) << (which % 64).astype(np.uint64))
            self.of_length[n] = row

    def near(self, queries: list[str], batch: int = 512):
        """(query, word) numbers of all pairs at exactly one edit."""
        found_q, found_w = [], []
        lengths = np.array([len(q) for q in queries], dtype=np.int64)
        none = np.zeros(self.slots, dtype=np.uint64)
        for n in np.unique(lengths).tolist():
            wanted = [self.of_length.get(n + d, none) for d in (-1, 0, 1)]
            if not any(w.any() for w in wanted):
                continue
            rows = np.flatnonzero(lengths == n)
            points = np.frombuffer("".join(queries[i] for i in rows).encode("utf-32-le"), dtype=np.uint32).reshape(len(rows), n)
            code = np.searchsorted(self.letters, points)
            known = self.letters[np.minimum(code, len(self.letters) - 1)] == points
            code = np.where(known, code + 1, 0)
            for lo in range(0, len(rows), batch):
                hits = self._run(code[lo:lo + batch], n, wanted)
                q, slot = np.nonzero(hits)
                if len(q):
                    bits = np.unpackbits(hits[q, slot].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                    k, bit = np.nonzero(bits)
                    found_q.append(rows[lo + q[k]])
                    found_w.append(slot[k] * 64 + bit)
        if not found_q:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(found_q), np.concatenate(found_w)

    def _run(self, code: np.ndarray, n: int, wanted):
        """The recurrences over the letters of queries of length ``n``."""
        shape = (len(code), self.slots)
        exact = np.full(shape, np.iinfo(np.uint64).max, dtype=np.uint64)
        replaced, inserted, deleted = (np.zeros(shape, dtype=np.uint64) for _ in range(3))
        blank = np.zeros(shape, dtype=np.uint64)

        def at(i, c):
            return self.bits[i, c] if 0 <= i < len(self.bits) else blank

        for i in range(n):
            c = code[:, i]
            same, further, back = at(i, c), at(i + 1, c), at(i - 1, c)
            inserted = (inserted | exact) & further        # the word has a letter more before this one
            deleted = (deleted & back) | exact             # the word lacks this letter
            replaced = (replaced & same) | (exact & ~same)
            exact = exact & same
        shorter, equal, longer = wanted
        return (deleted & shorter) | (replaced & equal) | ((inserted | exact) & longer)


def _search_cell(rows: pd.DataFrame) -> pd.DataFrame:
    """Count and best near word of each query word of one cell."""
    index = rows[rows["role"] != 2].reset_index(drop=True)
    query = rows[rows["role"] != 1].reset_index(drop=True)
    empty = pd.DataFrame({"word": pd.Series(dtype=object), "hits": pd.Series(dtype="int64"),
                          "near_n": pd.Series(dtype="int64"), "near": pd.Series(dtype=object)})
    if not len(index) or not len(query):
        return empty
    words = pd.Index(index["word"].unique())
    asked = pd.Index(query["word"].unique())
    q, w = SlicedIndex(list(words)).near(list(asked))
    if not len(q):
        return empty
    # pairs of words -> pairs of rows that are in one group
    pairs = pd.DataFrame({"word": asked.to_numpy()[q], "near": words.to_numpy()[w]})
    key = ["size", "side", "half"]
    left = pairs.merge(query[["word", "other", *key]], on="word")
    both = left.merge(index[["word", "n", "other", *key]].rename(columns={"word": "near", "n": "near_n", "other": "near_other"}),
                      on=["near", *key])
    shorter = np.minimum(both["word"].str.len(), both["near"].str.len())
    # each pair counts in one group: that of its shorter word, by the first half if they share it
    both = both[(shorter == both["size"]) & ((both["side"] == "first") | (both["other"] != both["near_other"]))]
    if not len(both):
        return empty
    both = both.sort_values(["word", "near_n", "near"], ascending=[True, False, True], kind="stable")
    best = both.groupby("word", sort=False).agg(hits=("near", "size"), near_n=("near_n", "first"), near=("near", "first"))
    out = best.reset_index()
    out["word"], out["near"] = out["word"].astype(object), out["near"].astype(object)
    return out[["word", "hits", "near_n", "near"]]


def near_words(words: DataFrame, cell: int = CELL) -> DataFrame:
    """(word, n_near, near, near_n) of the words of (word, n) that have a near
    word; ``near`` is the one of largest n (ties: smallest in code point order)."""
    cells = _cells(cut_lineage(_halves(words), "spelling-halves"), cell)
    found = cells.groupBy("cell").applyInPandas(_search_cell, "word string, hits long, near_n long, near string")
    best = F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("near")))
    return found.groupBy("word").agg(F.sum("hits").alias("n_near"), best.alias("b")).select(
        "word", "n_near", F.col("b.near").alias("near"), (-F.col("b.m")).alias("near_n"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): forms are followed to the last one by
    pointer doubling. A form is more frequent than its word, so there is no
    cycle, and the loop ends after log2 of the longest chain."""
    cur, path = stage(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = cur.select(F.col("word").alias("root"), F.col("root").alias("_root"))
        if cur.join(further, "root", "left_semi").isEmpty():
            return cur
        old = path
        cur, path = stage(cur.join(further, "root", "left").select("word", F.coalesce("_root", "root").alias("root")), "spelling-roots")
        drop_path(cur.sparkSession, old)


def spelling_groups(words: DataFrame, ratio: int = FORM_RATIO, cell: int = CELL) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of (word, n)."""
    words = words.filter(F.col("word").isNotNull() & F.col("n").isNotNull()).groupBy("word").agg(F.sum("n").alias("n"))
    words = cut_lineage(words, "spelling-words")
    has_form = F.col("near_n") >= F.lit(ratio) * F.col("n")
    out = words.join(near_words(words, cell), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(has_form, F.col("near")).alias("form"), F.when(has_form, F.col("near_n")).alias("form_n"))
    out = cut_lineage(out, "spelling-near")
    roots = _roots(out.filter(F.col("form").isNotNull()))
    return out.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
