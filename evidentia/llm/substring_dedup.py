"""Removal of word runs that an earlier document has, by recompression.

Every text is a row of words. In each round, maximal runs of one symbol and
then pairs of a "left" and a "right" symbol (sides come from the symbol's
hash) become one symbol named by a hash of its parts. Names and sides are
the same wherever they are made, so equal stretches of words get equal
symbols but near their ends. With each symbol goes the stretch of words
that decided it; a window that holds this whole stretch holds the symbol
wherever the window occurs.

Each window picks the rarest of the symbol groups that it holds, from the
highest round that gives any, and equal windows pick equal ones: windows
whose pick occurs in one document only cannot be repeated. The others'
windows are compared.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from evidentia.llm.bloom import bit_table, bloom, in_table, mark, possible
from evidentia.llm.exact_dedup import normalised
from evidentia.llm.rarity import SLOTS, word_levels
from evidentia.llm.scratch import Scratch
from evidentia.llm.words import blocks, byte_tables, fold, lists, mix, shingles, signed, words
from evidentia.session import cut_lineage

WINDOW = 13
HOT = 4096                     # texts of a pick beyond which its windows are combined in each task
_TOP = np.uint64(56)
LAST_ID = (1 << 63) - 1        # stands for a null id


def compress(sym, lo, hi, rare, row, salt: int):
    """One round over the symbols of a block: runs, then pairs. Returns the
    new symbols with the words [lo, hi) that decide each of them."""
    s1, s2, s3 = (np.uint64((0x9FB21C651E98DF25 * (3 * salt + i + 1)) % (1 << 64)) for i in range(3))
    n = len(sym)
    if not n:
        return sym, lo, hi, rare, row
    new = np.ones(n, dtype=bool)
    new[1:] = (sym[1:] != sym[:-1]) | (row[1:] != row[:-1])
    a = np.flatnonzero(new)
    length = np.diff(np.append(a, n))
    z = a + length - 1
    before, after = np.maximum(a - 1, 0), np.minimum(z + 1, n - 1)
    has_before = (a > 0) & (row[before] == row[a])
    has_after = (z < n - 1) & (row[after] == row[z])
    r_lo = np.where(has_before, lo[before], lo[a] - 1)
    r_hi = np.where(has_after, hi[after], hi[z] + 1)
    r_sym = np.where(length > 1, mix(sym[a] * s1 + length.astype(np.uint64) * s2), sym[a])
    r_rare, r_row = rare[a], row[a]
    m = len(r_sym)
    right = (mix(r_sym ^ s3) & np.uint64(1)).astype(bool)
    joined = np.zeros(m, dtype=bool)
    joined[:-1] = ~right[:-1] & right[1:] & (r_row[1:] == r_row[:-1])
    keep = np.ones(m, dtype=bool)
    keep[1:] = ~joined[:-1]
    nxt, prv = np.minimum(np.arange(m) + 1, m - 1), np.maximum(np.arange(m) - 1, 0)
    p_sym = np.where(joined, mix(r_sym * s2 + mix(r_sym[nxt] + s1)), r_sym)
    p_rare = np.where(joined, np.minimum(r_rare, r_rare[nxt]), r_rare)
    # a left symbol depends on its successor, a right one that stayed alone on its predecessor
    p_hi = np.where(~right & (r_row[nxt] == r_row), r_hi[nxt], r_hi)
    p_lo = np.where(right & (r_row[prv] == r_row), r_lo[prv], r_lo)
    return p_sym[keep], p_lo[keep], p_hi[keep], p_rare[keep], r_row[keep]


# Which symbols make a pick: (round, consecutive symbols), the first that a window holds. Each round takes words off
# both ends of what a window decides, so short windows serve best from early rounds: measured on 8 million words with
# windows of 13, ((1, 2), ...) gives 0.16 picks a word, ((2, 2), ...) 0.23, ((2, 3), ...) 0.30, for as few candidates.
GROUPS = ((1, 2), (2, 1), (1, 1))


def _group(state, size: int, salt: int):
    """``size`` consecutive symbols of a row as one: (rank and hash in one
    number, words [lo, hi) that decide it)."""
    sym, lo, hi, rare, row = state
    n = len(sym) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), lo[:0], hi[:0]
    at = np.flatnonzero(row[size - 1:] == row[:n])
    low = rare[at]
    for j in range(1, size):
        low = np.minimum(low, rare[at + j])
    key = (low.astype(np.uint64) << _TOP) | (fold([sym[at + j] for j in range(size)], salt) >> np.uint64(8))
    return key, lo[at], hi[at + size - 1]


def picks(w, rare, window: int):
    """(first word, hash, pick) of every window of a block that can be
    repeated: one that holds a word which occurs nowhere else cannot. The top
    byte of a pick is the rarity of its rarest word."""
    at, h = shingles(w, window, False)
    ok = rare[at] > 0
    for j in range(1, window):
        ok &= rare[at + j] > 0
    at, h = at[ok], h[ok]
    best = np.full(len(at), np.iinfo(np.uint64).max, dtype=np.uint64)
    open_ = np.ones(len(at), dtype=bool)
    levels = [(w.hash, np.arange(len(w.hash)), np.arange(len(w.hash)) + 1, rare, w.row)]
    for r in range(max(g[0] for g in GROUPS)):
        levels.append(compress(*levels[-1], r))
    for r, size in GROUPS:
        key, lo, hi = _group(levels[r], size, 100 * r + size)
        idx = np.flatnonzero(open_)
        if not len(idx) or not len(key):
            continue
        first = np.searchsorted(lo, at[idx], side="left")
        count = np.searchsorted(hi, at[idx] + window, side="right") - first
        got = best[idx]
        for j in range(int(max(0, count.max()))):
            has = count > j
            got[has] = np.minimum(got[has], key[first[has] + j])
        best[idx] = got
        open_[idx] = count <= 0
    # a window without a group of its own (one long run) stands for itself
    best[open_] = (np.uint64(255) << _TOP) | (h[open_] >> np.uint64(8))
    return at, h, best


def _rare(w, level):
    return level[(w.hash & np.uint64(len(level) - 1)).astype(np.int64)]


def _names(w, rows: int):
    """Per row: its words joined by one space, and the 128-bit name of that."""
    joined = [b" ".join(w.text(j) for j in range(w.ptr[i], w.ptr[i + 1])) for i in range(rows)]
    return joined, [hashlib.md5(t).digest() for t in joined]


def _tags(names) -> pa.Array:
    """31 bits of each name: they tell rows of one id apart."""
    first = np.frombuffer(b"".join(x[:8] for x in names), np.int64) if names else np.zeros(0, np.int64)
    return pa.array(first & 0x7FFFFFFF)


def _describe(levels, window: int):
    """Per row: id, name and tag of its words, their number, the hash of the
    text if nothing goes, and its distinct picks."""
    def run(batches):
        tables = byte_tables(True, False)
        for b in blocks(batches, "text"):
            rows = b.num_rows
            w = words(b.column(1), tables)
            at, _, pick = picks(w, _rare(w, levels.value), window)
            row = w.row[at]
            order = np.lexsort((pick, row))
            pick, row = pick[order], row[order]
            if len(pick):
                new = np.ones(len(pick), dtype=bool)
                new[1:] = (pick[1:] != pick[:-1]) | (row[1:] != row[:-1])
                pick, row = pick[new], row[new]
            ptr = np.searchsorted(row, np.arange(rows + 1))
            joined, names = _names(w, rows)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(names, pa.binary()), _tags(names), pa.array(w.counts.astype(np.int64)),
                 pa.array([hashlib.sha256(t).hexdigest() for t in joined], pa.string()), lists(signed(pick), ptr, pa.int64())],
                names=["doc_id", "name", "tag", "n_words", "sha", "picks"])
    return run


def _windows(levels, shared, hot, window: int):
    """Windows whose pick may be shared, one row per run of neighbours of one
    pick: (id, tag of the words and first word in one number, pick, whether
    very many texts have it, hashes of the windows)."""
    def run(batches):
        tables = byte_tables(True, False)
        for b in blocks(batches, "text"):
            w = words(b.column(1), tables)
            at, h, pick = picks(w, _rare(w, levels.value), window)
            mine = in_table(shared.value, pick)
            at, h, pick = at[mine], h[mine], pick[mine]
            row = w.row[at]
            new = np.ones(len(at), dtype=bool)
            new[1:] = (row[1:] != row[:-1]) | (pick[1:] != pick[:-1]) | (at[1:] != at[:-1] + 1)
            first = np.flatnonzero(new)
            f_at, f_row, f_pick = at[first], row[first], pick[first]
            place = (_tags(_names(w, b.num_rows)[1]).to_numpy()[f_row] << 32) | (f_at - w.ptr[f_row])
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(f_row)), pa.array(place), pa.array(signed(f_pick)),
                 pa.array(in_table(hot.value, f_pick)), lists(signed(h), np.append(first, len(at)), pa.int64())],
                names=["doc_id", "place", "pick", "hot", "wins"])
    return run


def _starts():
    """Columns of a repeated window: id, tag of the words, first word."""
    at = F.col("place") + F.col("step")
    return [F.col("doc_id").alias("s_id"), F.shiftright(at, 32).alias("s_tag"),
            at.bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("start")]


def _repeated(runs: DataFrame, held: Scratch) -> DataFrame:
    """(s_id, s_tag, start) of the windows that a smaller id has too; windows
    are equal if both pick and hash are. Runs of most picks meet once, by
    their pick, and give the smallest id of each window there. A pick of more
    than HOT texts would gather them in one task: its windows' smallest ids
    are combined in each task first, and joined by window."""
    cold = runs.filter("not hot").repartition("pick").select(
        "doc_id", "place", "pick", F.posexplode("wins").alias("step", "win"))
    low = F.min("doc_id").over(W.partitionBy("pick", "win"))
    few = cold.withColumn("low", low).filter("doc_id > low").select(*_starts())
    many = runs.filter("hot").select("doc_id", "place", "pick", F.posexplode("wins").alias("step", "win"))
    least = many.groupBy("pick", "win").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("top")).filter("low < top")
    least = held.table(least.select(F.col("pick").alias("l_pick"), F.col("win").alias("l_win"), "low"), "least-ids")
    more = many.join(least, (F.col("pick") == F.col("l_pick")) & (F.col("win") == F.col("l_win"))).filter(
        "doc_id > low").select(*_starts())
    return few.unionByName(more)


def _cut(window: int, keep_text: bool):
    def run(batches):
        tables = byte_tables(True, False)
        for b in blocks(batches, "text"):
            w = words(b.column(1), tables)
            tags = _tags(_names(w, b.num_rows)[1]).to_numpy()
            ids, tagged, removed, shas, kept = [], [], [], [], []
            for i in range(b.num_rows):
                if tags[i] != b.column(2)[i].as_py():
                    continue                             # another row of the same id
                n = int(w.ptr[i + 1] - w.ptr[i])
                s = np.unique(b.column(3)[i].values.to_numpy(zero_copy_only=False))
                depth = np.bincount(s, minlength=n + window) - np.bincount(s + window, minlength=n + window)[:n + window]
                out = np.cumsum(depth)[:n] > 0
                text = b" ".join(w.text(w.ptr[i] + j) for j in np.flatnonzero(~out))
                ids.append(b.column(0)[i].as_py())
                tagged.append(int(tags[i]))
                removed.append(int(out.sum()))
                shas.append(hashlib.sha256(text).hexdigest())
                kept.append(text.decode("utf-8") if keep_text else None)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(tagged, pa.int64()), pa.array(removed, pa.int64()),
                 pa.array(shas, pa.string()), pa.array(kept, pa.string())],
                names=["r_id", "r_tag", "n_removed", "kept_sha256", "kept_text"])
    return run


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                   slots: int = SLOTS, keep_text: bool = False, hot: int = HOT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_sha256
    (and kept_text with ``keep_text``, words joined by one space).

    Words that a window of ``window`` consecutive words covers go if the same
    words also stand in a row in a document with a smaller id; windows are
    judged on the input. Texts of equal words are one class: all but its
    smallest id lose everything (if they hold a window at all), and only that
    one is compared, so large groups of copies cost nothing. Only windows
    whose pick several classes have travel, as 64-bit hashes beside the 64
    bits of their pick, and both must agree. Texts are read where they lie;
    only those that lose words are shuffled.

    Null text has no words; a null id counts as the largest possible one, rows
    of one id never remove one another's words; no rows in, no rows out;
    other columns are ignored.
    """
    held = Scratch(docs.sparkSession)
    levels = word_levels(docs, text_col, False, slots)
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    last = F.coalesce("doc_id", F.lit(LAST_ID))
    src = given.withColumn("doc_id", last)
    described = given.mapInArrow(_describe(levels, window), "doc_id long, name binary, tag long, n_words long, sha string, "
                                 "picks array<long>")
    described = described.withColumn("no_id", F.col("doc_id").isNull()).withColumn("doc_id", last)
    rows = held.table(described.withColumn("row", F.monotonically_increasing_id()), "picks")     # numbers are fixed once written
    classes = rows.groupBy("name").agg(F.min(F.struct("doc_id", "row")).alias("head"))
    classes = held.table(classes.select(F.col("name").alias("c_name"), F.col("head.doc_id").alias("first_id"),
                                        F.col("head.row").alias("head_row")), "classes")
    heads = rows.filter(F.size("picks") > 0).select("row", "picks").join(
        classes.select("head_row"), F.col("row") == F.col("head_row"), "left_semi")
    shared = heads.select(F.explode("picks").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = held.table(shared, "shared")
    shared, common = bit_table(shared.select("key")), bit_table(shared.filter(F.col("n") > hot).select("key"))
    # texts of the classes' first rows: what surely is no later copy, and what the exact join leaves of the rest
    copies = held.table(rows.select("doc_id", "name").join(classes, F.col("name") == F.col("c_name")).filter(
        "doc_id > first_id").select(F.col("doc_id").alias("k_id"), F.col("name").alias("k_name")), "copies")
    marked = mark(src, F.col("doc_id"), bloom(copies.select(F.col("k_id").alias("key"))), "may_copy")
    name = F.unhex(F.md5(F.trim(normalised(F.col("text")))))
    rest = marked.filter("may_copy").withColumn("t_name", name).join(
        copies, (F.col("doc_id") == F.col("k_id")) & (F.col("t_name") == F.col("k_name")), "left_anti")
    firsts = marked.filter("not may_copy").select("doc_id", "text").unionByName(rest.select("doc_id", "text"))
    runs = held.table(firsts.mapInArrow(_windows(levels, shared, common, window),
                                        "doc_id long, place long, pick long, hot boolean, wins array<long>"), "windows")
    starts = _repeated(runs, held).groupBy("s_id", "s_tag").agg(F.collect_list("start").alias("starts"))
    starts = held.table(starts, "repeated-starts")
    held.drop("windows", "least-ids", "shared", "copies")
    losing = possible(src, F.col("doc_id"), starts.select(F.col("s_id").alias("key")))
    cut = losing.join(starts, F.col("doc_id") == F.col("s_id")).select("doc_id", "text", "s_tag", "starts").mapInArrow(
        _cut(window, keep_text), "r_id long, r_tag long, n_removed long, kept_sha256 string, kept_text string")
    cut = cut.dropDuplicates(["r_id", "r_tag"])          # repeated rows
    out = rows.select("doc_id", "no_id", "name", "tag", "n_words", "sha").join(classes, F.col("name") == F.col("c_name")).join(
        cut, (F.col("doc_id") == F.col("r_id")) & (F.col("tag") == F.col("r_tag")), "left")
    copy = (F.col("doc_id") > F.col("first_id")) & (F.col("n_words") >= window)
    empty = hashlib.sha256(b"").hexdigest()
    cols = [F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id"), "n_words",
            F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
            F.when(copy, F.lit(empty)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256")]
    if keep_text:
        cols.append(F.when(copy, F.lit("")).otherwise(F.col("kept_text")).alias("kept_text"))
    out = cut_lineage(out.select(*cols), "repeated-spans")
    held.close()
    return out
