"""Line deduplication by an exact set-similarity join."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from evidentia.llm.bloom import bit_table, in_table, possible
from evidentia.llm.jaccard_join import _compare, prefixes, ranked_sets, set_names, whole_sets
from evidentia.llm.rarity import SLOTS, word_levels
from evidentia.llm.scratch import Scratch
from evidentia.llm.words import Words, blocks, byte_tables, lists, signed, words
from evidentia.session import cut_lineage

WORDS = 5
PERCENT = 80
STEPS = (1, 16, 256, None)     # earliest lines of a token that later ones meet, step by step; last: all
LAST_ID = (1 << 63) - 1
_LINES = ("doc_id long, name binary, n_lines long, sha string, line array<int>, node array<binary>, tag array<long>, "
          "n array<long>, sig array<array<long>>, place array<array<short>>")


def _by_line(w: Words, first_byte: np.ndarray, rows: int):
    """The same words with lines as rows: (words, lines per row)."""
    breaks = np.flatnonzero(w.data == 10)
    per_row = np.diff(np.searchsorted(breaks, first_byte)) + 1
    base = np.concatenate([[0], np.cumsum(per_row)])
    line = np.searchsorted(breaks, w.start) - np.searchsorted(breaks, first_byte[:-1])[w.row] + base[w.row]
    ptr = np.searchsorted(line, np.arange(base[-1] + 1))
    return Words(line, w.start, w.end, w.hash, ptr, w.data), per_row, base


def _line_words(col: pa.Array, tables):
    """(texts as bytes, words by line, lines per row, first line per row)."""
    col = col.cast(pa.large_string())
    raw = [(t or "").encode("utf-8") for t in col.to_pylist()]
    edge = np.concatenate([[0], np.cumsum([len(t) for t in raw])])
    return raw, *_by_line(words(col, tables), edge, len(raw))


def _tags(names: pa.Array) -> np.ndarray:
    """First eight bytes of each 128-bit name."""
    return np.frombuffer(b"".join(x.as_py()[:8] for x in names), np.int64)


def _describe(levels, k: int, percent: int):
    """Per row: id, name and hash of the text, and of each line with words its
    number, its set's name and size, and its prefix tokens with their places."""
    def run(batches):
        tables = byte_tables(True, True)
        for b in blocks(batches, "text"):
            raw, w, per_row, base = _line_words(b.column(1), tables)
            key, row, ptr = ranked_sets(w, int(base[-1]), levels.value, k)
            sig, sig_ptr, place = prefixes(key, row, ptr, percent)
            n = np.diff(ptr)
            full = np.flatnonzero(n > 0)                 # blank lines take no part
            owner = np.searchsorted(base, full, side="right") - 1
            names = set_names(key, ptr).take(pa.array(full))
            sigs = lists(signed(sig), sig_ptr, pa.int64()).take(pa.array(full))
            places = lists(np.minimum(place, 32767).astype(np.int16), sig_ptr, pa.int16()).take(pa.array(full))
            off = pa.array(np.searchsorted(owner, np.arange(b.num_rows + 1)).astype(np.int32))
            wrap = lambda values: pa.ListArray.from_arrays(off, values)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([hashlib.md5(t).digest() for t in raw], pa.binary()),
                 pa.array([int(c) if t else 0 for c, t in zip(per_row, raw)], pa.int64()),
                 pa.array([hashlib.sha256(t).hexdigest() for t in raw], pa.string()),
                 wrap(pa.array((full - base[owner]).astype(np.int32))), wrap(names), wrap(pa.array(_tags(names))),
                 wrap(pa.array(n[full].astype(np.int64))), wrap(sigs), wrap(places)],
                names=["doc_id", "name", "n_lines", "sha", "line", "node", "tag", "n", "sig", "place"])
    return run


def _sets(levels, wanted, k: int):
    """Whole sets of the lines whose tag may be wanted."""
    def run(batches):
        tables = byte_tables(True, True)
        for b in blocks(batches, "text"):
            _, w, _, base = _line_words(b.column(1), tables)
            key, _, ptr = ranked_sets(w, int(base[-1]), levels.value, k)
            tag = _tags(set_names(key, ptr)) if len(ptr) > 1 else np.zeros(0, np.int64)
            use = (np.diff(ptr) > 0) & in_table(wanted.value, tag.view(np.uint64))
            at = np.flatnonzero(use)
            owner = np.searchsorted(base, at, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(owner)), pa.array((at - base[owner]).astype(np.int32)), pa.array(tag[at]),
                 whole_sets(key, ptr).take(pa.array(at))], names=["doc_id", "line", "tag", "keys"])
    return run


def _cut(keep_text: bool):
    def run(batches):
        for b in batches:
            shas, texts = [], []
            for i in range(b.num_rows):
                gone = set(b.column(3)[i].as_py())
                kept = "\n".join(x for j, x in enumerate(b.column(1)[i].as_py().split("\n")) if j not in gone)
                shas.append(hashlib.sha256(kept.encode("utf-8")).hexdigest())
                texts.append(kept if keep_text else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(shas, pa.string()), pa.array(texts, pa.string())],
                                             names=["r_id", "r_name", "kept_sha256", "kept_text"])
    return run


def _similar_later(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Nodes with an earlier similar node. ``members``: token, node, n, place,
    first (when the node first occurs). Lines that share a token meet; the
    sizes must allow the similarity (length filter), and so must what follows
    the token in both, were it their first common one (positional filter)."""
    gone, before, held = None, 0, Scratch(members.sparkSession)
    for step in STEPS:
        open_ = members
        if gone is not None:
            open_ = open_.join(gone.withColumnRenamed("node", "g_node"), F.col("node") == F.col("g_node"), "left_anti")
        p = members
        if step:
            turn = F.row_number().over(W.partitionBy("token").orderBy("first", "node"))
            p = members.withColumn("turn", turn).filter(F.col("turn") <= step).filter(F.col("turn") > before)
            before = step
        p = p.select(F.col("token").alias("p_token"), F.col("node").alias("b"), F.col("n").alias("nb"),
                     F.col("place").alias("p_place"), F.col("first").alias("p_first"))
        j = open_.join(p, F.col("token") == F.col("p_token")).filter(F.col("p_first") < F.col("first"))
        j = j.filter(F.least("n", "nb") * 100 >= F.greatest("n", "nb") * percent)
        # common >= t / (1 + t) * (n + nb); at most what stands from the token on
        most = F.least(F.col("n") - F.col("place"), F.col("nb") - F.col("p_place"))
        j = j.filter(most * (100 + percent) >= (F.col("n") + F.col("nb")) * percent)
        pairs = j.select(F.col("node").alias("a"), "b", F.col("n").alias("na"), "nb").distinct()
        dist = _compare(pairs, sets, held)
        if step is None and gone is None and not dist.take(1):
            break
        found = dist.filter(F.col("common") * 100 >= F.col("whole") * percent).select(F.col("a").alias("node")).distinct()
        gone = cut_lineage(found if gone is None else gone.unionByName(found).distinct(), "similar-lines")
        if step and not members.groupBy("token").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > step).take(1):
            break
    held.close()
    return gone


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WORDS, percent: int = PERCENT,
               slots: int = SLOTS, keep_text: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_lines, n_removed, kept_sha256
    (and kept_text with ``keep_text``).

    Lines end at newlines. A line's tokens are its distinct ``k``-word
    shingles (A-Z lower-cased; a shorter line is one token, a line without
    words has none and stays). A line goes if an earlier one, by (id, line
    number), has a Jaccard similarity of ``percent`` or more, judged on the
    input. Equal token sets are one class whose first line stays unless an
    earlier class is similar; classes meet by their rarest tokens, the
    earliest lines of a token first, and a line that has found one is not
    compared further.

    Null and empty texts have no lines; a null id is larger than any other;
    rows that repeat id and text do not remove one another's lines; no rows
    in, no rows out; other columns are ignored.
    """
    levels = word_levels(docs, text_col, True, slots)
    src = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("doc_id"), F.col(text_col).alias("text"))
    rows = cut_lineage(src.mapInArrow(_describe(levels, k, percent), _LINES), "lines")
    x = F.explode(F.arrays_zip("line", "node", "tag", "n", "sig", "place")).alias("x")
    lines = rows.select("doc_id", "name", x).select("doc_id", "name", "x.*")
    at = F.struct("doc_id", "line")
    first = lines.groupBy("node").agg(F.min(at).alias("first"), F.first("tag").alias("f_tag"), F.count(F.lit(1)).alias("rows"))
    first = cut_lineage(first.select(F.col("node").alias("f_node"), "first", "f_tag", "rows").withColumn(
        "cls", F.monotonically_increasing_id()), "first-lines")          # class numbers are fixed once written
    heads = lines.filter(F.size("sig") > 0).select("doc_id", "line", "node", "n", "sig", "place").join(
        first, (F.col("node") == F.col("f_node")) & (at == F.col("first")))
    spread = heads.select(F.col("cls").alias("node"), "n", "first", F.explode(F.arrays_zip("sig", "place")).alias("y")).select(
        "node", "n", "first", F.col("y.sig").alias("token"), F.col("y.place").cast("int").alias("place"))
    shared = cut_lineage(spread.groupBy("token").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select(
        F.col("token").alias("key")), "shared-tokens")
    members = cut_lineage(possible(spread, F.col("token"), shared).join(
        shared, F.col("token") == F.col("key"), "left_semi"), "line-tokens")
    # whole sets, only of lines that share a token
    needed = cut_lineage(first.join(members.select(F.col("node").alias("m_node")).distinct(),
                                    F.col("cls") == F.col("m_node"), "left_semi").select(
        F.col("cls").alias("node"), F.col("first.doc_id").alias("n_id"), F.col("first.line").alias("n_line"),
        F.col("f_tag").alias("n_tag")), "needed-lines")
    wanted = bit_table(needed.select(F.col("n_tag").alias("key")))
    asked = possible(src, F.col("doc_id"), needed.select(F.col("n_id").alias("key")))
    sets = asked.mapInArrow(_sets(levels, wanted, k), "doc_id long, line int, tag long, keys array<long>").join(
        needed, (F.col("doc_id") == F.col("n_id")) & (F.col("line") == F.col("n_line")) & (F.col("tag") == F.col("n_tag")))
    sets = cut_lineage(sets.select("node", "keys"), "line-sets")
    gone = _similar_later(members, sets, percent)
    known = first.join(gone.select(F.col("node").alias("g_node")), F.col("cls") == F.col("g_node"), "left").select(
        "f_node", "first", "rows", F.col("g_node").isNotNull().alias("similar")).filter("similar or rows > 1")
    known = cut_lineage(known, "known-lines")
    removed = possible(lines.select("doc_id", "name", "line", "node"), F.col("node"), known.select(F.col("f_node").alias("key")))
    removed = removed.join(known, F.col("node") == F.col("f_node")).filter(F.col("similar") | (at > F.col("first")))
    removed = removed.groupBy("doc_id", "name").agg(F.collect_set("line").alias("gone"))
    removed = cut_lineage(removed.select(F.col("doc_id").alias("g_id"), F.col("name").alias("g_name"), "gone"), "removed-lines")
    named = possible(src, F.col("doc_id"), removed.select(F.col("g_id").alias("key"))).withColumn(
        "text", F.coalesce("text", F.lit(""))).join(removed, F.col("doc_id") == F.col("g_id")).filter(
        F.unhex(F.md5("text")) == F.col("g_name"))
    cut = named.select("doc_id", "text", F.col("g_name").alias("name"), "gone").dropDuplicates(["doc_id", "name"]).mapInArrow(
        _cut(keep_text), "r_id long, r_name binary, kept_sha256 string, kept_text string")
    out = rows.select("doc_id", "name", "n_lines", "sha").join(
        removed.select("g_id", "g_name", F.size("gone").cast("long").alias("n_gone")),
        (F.col("doc_id") == F.col("g_id")) & (F.col("name") == F.col("g_name")), "left")
    out = out.join(cut, (F.col("doc_id") == F.col("r_id")) & (F.col("name") == F.col("r_name")), "left")
    cols = [F.when(F.col("doc_id") < LAST_ID, F.col("doc_id")).alias("doc_id"), "n_lines",
            F.coalesce("n_gone", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("kept_sha256", "sha").alias("kept_sha256")]
    return out.select(*cols, "kept_text") if keep_text else out.select(*cols)
