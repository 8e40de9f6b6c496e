"""Language-model scoring: a hierarchical Pitman-Yor model with restaurants
seated by Gibbs sampling.

A word is predicted in two steps. Its symbol (each of the ``VOCABULARY`` most
frequent words and the end of text are symbols of their own, all other words
share one of 256 by their last two bytes) is drawn in the restaurant of the
symbol before it, whose parent is the restaurant of the empty context over a
uniform base. The word is drawn within its symbol by its smoothed corpus count.

The dishes (preceding symbol, symbol) are a table that grows with the corpus
and is never gathered:

* Pairs are counted in each task, then by pair. A pair met once has one
  customer at one table whatever the sampling, so of those only the numbers
  per symbol stay, and the pairs that a held-out text asks for.
* A sweep is a Spark job. Each task seats the customers of its pairs, given
  the predictions of the parent and the tables of the restaurant after the
  last sweep; what leaves is the number of tables by context and by word. They
  are the sizes of the restaurants and the customers of the parent, one
  restaurant of at most as many dishes as there are symbols, seated in between.
* Predictions are averaged over the sweeps after the burn-in.

Texts are scored with arrays by symbol and the most frequent pairs. Their other
pairs are taken for pairs met once (training rows) or never (held-out rows),
and what that is wrong by comes from a join by pair.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.llm.bloom import bit_table, in_table
from evidentia.llm.scratch import Scratch
from evidentia.llm.words import blocks, byte_tables, lists, mix, signed, words
from evidentia.session import cut_lineage

VOCABULARY = 1 << 16           # words that are symbols of their own
GROUPS = 256                   # symbols that the other words share
FREQUENT = 1 << 20             # words whose counts are sent to every task; all others are joined
PAIRS_SENT = 1 << 20           # pairs whose seating is sent to every task; all others are joined
HELD = 1 << 21                 # tokens a task combines at once; an eighth of it: pairs seated at once
SWEEPS, BURN_IN = 6, 2
SMOOTH = 0.1
THETA = 1.0
EXACT_SEATS = 256              # customers of a dish seated one by one; beyond, the wait for a new table is drawn


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text is 0 modulo 10 (a null id has crc32 0)."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(10)) == 0


def _endings(w) -> np.ndarray:
    """0..255 from the last two bytes of each word."""
    z = w.data[w.end - 1].astype(np.uint64)
    y = np.where(w.end - w.start > 1, w.data[np.maximum(w.end - 2, 0)], 0).astype(np.uint64)
    return (mix(z * np.uint64(256) + y + np.uint64(0x2B)) & np.uint64(GROUPS - 1)).astype(np.int64)


def _count_words(batches):
    """Counts of the words of a task, merged whenever a million are held."""
    tables = byte_tables(True, True)
    held: list = []

    def merged():
        h, e, n = (np.concatenate(x) for x in zip(*held))
        u, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        return u, e[first], np.bincount(inverse, n).astype(np.int64)

    def out(x):
        for lo in range(0, len(x[0]), 1 << 16):
            part = slice(lo, lo + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(signed(x[0][part])), pa.array(x[1][part].astype(np.int32)),
                                              pa.array(x[2][part])], names=["word", "ending", "n"])
    for b in blocks(batches, "text"):
        w = words(b.column(0), tables)
        if len(w.hash):
            u, first, n = np.unique(w.hash, return_index=True, return_counts=True)
            held.append((u, _endings(w)[first], n))
        if sum(len(x[0]) for x in held) > 1 << 20:
            held[:] = [merged()]
            if len(held[0][0]) > 1 << 20:
                yield from out(held.pop())
    if held:
        yield from out(merged())


@dataclass(frozen=True)
class Symbols:
    """Symbols of words: 0.. for the words of ``top`` (hashes, sorted), then
    the end, then the groups."""
    top: np.ndarray

    @property
    def end(self) -> int:
        return len(self.top)

    @property
    def size(self) -> int:
        return len(self.top) + 1 + GROUPS

    def of(self, w) -> np.ndarray:
        sym = self.end + 1 + _endings(w)
        if len(self.top):
            at = np.minimum(np.searchsorted(self.top, w.hash), len(self.top) - 1)
            sym = np.where(self.top[at] == w.hash, at, sym)
        return sym

    def cells(self, w, rows: int):
        """(row, cell) of each token, the end of each text included, and the
        symbol of each word; a cell is (preceding symbol, symbol). Before a
        text stands an end."""
        ends = w.ptr[1:] + np.arange(rows)
        sym = np.full(len(w.hash) + rows, self.end, dtype=np.int64)
        own = np.ones(len(sym), dtype=bool)
        own[ends] = False
        of_words = sym[own] = self.of(w)
        before = np.concatenate([[self.end], sym[:-1]])    # what stands before a text is the end of the last one
        return np.repeat(np.arange(rows), w.counts + 1), before * self.size + sym, of_words


def _count_pairs(symbols):
    """Cells of a task's learnt texts with their numbers, and those of its
    held-out texts as asked; combined over HELD tokens at a time."""
    def run(batches):
        tables = byte_tables(True, True)
        parts, size = ([], []), 0

        def out():
            for asked, part in enumerate(parts):
                if part:
                    cell, n = np.unique(np.concatenate(part), return_counts=True)
                    part.clear()
                    for lo in range(0, len(cell), 1 << 16):
                        c = cell[lo:lo + (1 << 16)]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c), pa.array(np.zeros(len(c), np.int64) if asked else n[lo:lo + (1 << 16)]),
                             pa.array(np.full(len(c), bool(asked)))], names=["cell", "n", "asked"])
        for b in blocks(batches, "text"):
            row, cell, _ = symbols.value.cells(words(b.column(0), tables), b.num_rows)
            fresh = b.column(1).to_numpy(zero_copy_only=False)[row]
            parts[0].append(cell[~fresh])
            parts[1].append(cell[fresh])
            size += len(cell)
            if size > HELD:
                yield from out()
                size = 0
        yield from out()
    return run


def _tally(size: int):
    """Pairs that are seated go on as they are; of the others (met once, asked
    by no held-out text) the numbers per symbol, as cells below 0: -1 - symbol
    for the preceding one, -1 - size - symbol for the other."""
    def run(batches):
        once = np.zeros(2 * size, dtype=np.int64)
        for b in batches:
            cell, n, asked = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 2))
            keep = (n > 1) | (asked & (n > 0))
            alone = cell[~keep & (n > 0)]
            once[:size] += np.bincount(alone // size, minlength=size)
            once[size:] += np.bincount(alone % size, minlength=size)
            yield pa.RecordBatch.from_arrays([pa.array(cell[keep]), pa.array(n[keep])], names=["cell", "n"])
        at = np.flatnonzero(once)
        yield pa.RecordBatch.from_arrays([pa.array(-1 - at), pa.array(once[at])], names=["cell", "n"])
    return run


# --- Gibbs sampling ------------------------------------------------------------------

def reseat(customers, pull, discount: float, rng):
    """Number of tables per dish after its ``customers`` have been seated anew,
    one after another: with t tables after i customers, the next opens a table
    with weight ``pull`` (concentration times parent probability) against
    i - discount * t. After EXACT_SEATS customers, the number of customers
    until the next new table is drawn at once, from the ratio of gamma
    functions that the product of the single refusals is."""
    t = (customers > 0).astype(float)
    open_ = np.flatnonzero(customers > 1)
    for i in range(1, EXACT_SEATS):
        if not len(open_):
            return t
        a = pull[open_]
        t[open_] += rng.random(len(open_)) * (a + i - discount * t[open_]) < a
        open_ = open_[customers[open_] > i + 1]
    seat = np.full(len(open_), float(EXACT_SEATS))
    while len(open_):
        a = pull[open_]
        x = seat - discount * t[open_] + (a - 1.0) / 2.0
        wait = np.maximum(x, 0.5) * np.expm1(np.minimum(-np.log(1.0 - rng.random(len(open_))) / a, 34.0))
        seat = seat + np.floor(np.minimum(wait, 1e15)) + 1.0
        new = seat <= customers[open_]
        open_, seat = open_[new], seat[new]
        t[open_] += 1.0
    return t


def discount(one: float, two: float) -> float:
    """Discount of a level from its numbers of dishes with one and two customers."""
    return min(0.9, max(0.1, one / (one + 2 * two))) if one + two else 0.5


@dataclass
class Sweep:
    """What a sweep was seated from (tables per restaurant, the parent's
    predictions) and what it left."""
    number: int
    from_tables: np.ndarray
    from_parent: np.ndarray
    tables: np.ndarray | None = None
    parent: np.ndarray | None = None


@dataclass
class Model:
    """Restaurants by symbol: ``customers`` per context, the sweeps that
    predictions are averaged over, the discount of the pairs."""
    symbols: Symbols
    customers: np.ndarray
    discount: float
    sweeps: list = field(default_factory=list)

    def backing(self, cell: np.ndarray) -> np.ndarray:
        """What the parent adds to a pair's weight, averaged over the sweeps."""
        before, sym = cell // self.symbols.size, cell % self.symbols.size
        return sum((THETA + self.discount * x.tables[before]) * x.parent[sym] for x in self.sweeps) / len(self.sweeps)

    def weight(self, cell: np.ndarray) -> np.ndarray:
        """What a pair's weight and the parent's are divided by."""
        return THETA + self.customers[cell // self.symbols.size]


def seat_pairs(cell, n, sweep: Sweep, size: int, d: float):
    """Tables of each pair, its customers seated anew."""
    pull = (THETA + d * sweep.from_tables[cell // size]) * sweep.from_parent[cell % size]
    rng = np.random.default_rng([11, sweep.number, int(cell[0])])
    return reseat(n.astype(float), pull, d, rng)


def _runs(batches):
    """Batches of (cell, n) joined to runs of at least HELD / 8 rows."""
    parts, size = [], 0
    for b in batches:
        parts.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
        size += b.num_rows
        if size >= HELD // 8:
            yield tuple(np.concatenate(x) for x in zip(*parts))
            parts, size = [], 0
    if size:
        yield tuple(np.concatenate(x) for x in zip(*parts))


def _sweep(shared):
    """Tables of a task's pairs by preceding symbol and by symbol; before the
    first sweep, one of each pair."""
    def run(batches):
        sweep, size, d = shared.value
        by = np.zeros((2, size))
        for cell, n in _runs(batches):
            t = seat_pairs(cell, n, sweep, size, d) if sweep else np.ones(len(cell))
            by[0] += np.bincount(cell // size, t, minlength=size)
            by[1] += np.bincount(cell % size, t, minlength=size)
        at = np.flatnonzero(by.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(by[0, at]), pa.array(by[1, at])],
                                         names=["symbol", "as_context", "as_word"])
    return run


def _seated(shared):
    """Pairs with their weight beyond the parent's, averaged over the sweeps,
    and what a text's log10 probability gains by each when it was taken for a
    pair met once or never."""
    def run(batches):
        m = shared.value
        for cell, n in _runs(batches):
            t = sum(seat_pairs(cell, n, x, m.symbols.size, m.discount) for x in m.sweeps) / len(m.sweeps)
            own, parent = n - m.discount * t, m.backing(cell)
            gain = np.log10(own + parent)
            yield pa.RecordBatch.from_arrays(
                [pa.array(cell), pa.array(n), pa.array(own), pa.array(gain - np.log10(1.0 - m.discount + parent)),
                 pa.array(gain - np.log10(parent)), pa.array(signed(mix(cell.astype(np.uint64))))],
                names=["cell", "n", "own", "gain", "gain_held", "key"])
    return run


def _by_symbol(df: DataFrame, size: int, at: str, *values: str):
    """Sums per symbol as arrays: at most ``size`` rows."""
    got = df.groupBy(at).agg(*[F.sum(v).alias(v) for v in values]).toArrow()
    out = np.zeros((len(values), size))
    for k, v in enumerate(values):
        out[k, got.column(at).to_numpy()] = got.column(v).to_numpy()
    return out


def unigrams(customers: np.ndarray, rng) -> np.ndarray:
    """Predictions of the empty context, its customers seated over a uniform base."""
    d = discount(float((customers == 1).sum()), float((customers == 2).sum()))
    base = 1.0 / len(customers)
    t = (customers > 0).astype(float)
    for _ in range(2):                                 # the restaurant's size comes from the first seating
        t = reseat(customers, np.full(len(customers), (THETA + d * t.sum()) * base), d, rng)
    return (np.maximum(customers - d * t, 0.0) + (THETA + d * t.sum()) * base) / (THETA + customers.sum())


def fit(src: DataFrame, symbols: Symbols, sweeps: int, burn_in: int, held: Scratch) -> tuple[Model, DataFrame]:
    """The model and its table of seated pairs (cell, n, own, gain, gain_held,
    key), from rows of ``text`` and ``held_out``."""
    spark, size = src.sparkSession, symbols.size
    sent = spark.sparkContext.broadcast(symbols)
    counted = src.select("text", "held_out").mapInArrow(_count_pairs(sent), "cell long, n long, asked boolean").groupBy("cell").agg(
        F.sum("n").alias("n"), F.max("asked").alias("asked"))
    table = held.table(counted.mapInArrow(_tally(size), "cell long, n long"), "pairs")
    pairs = table.filter("cell >= 0")
    kind = F.floor((-1 - F.col("cell")) / F.lit(size))
    alone = table.filter("cell < 0").select(kind.alias("kind"), F.pmod(-1 - F.col("cell"), F.lit(size)).cast("int").alias("symbol"), "n")
    once = np.stack([_by_symbol(alone.filter(F.col("kind") == k), size, "symbol", "n")[0] for k in (0, 1)])
    customers = once[0] + _by_symbol(pairs.select(F.floor(F.col("cell") / F.lit(size)).cast("int").alias("symbol"), "n"),
                                     size, "symbol", "n")[0]
    few = pairs.agg(F.count(F.when(F.col("n") == 1, 1)), F.count(F.when(F.col("n") == 2, 1))).first()
    m = Model(symbols, customers, discount(float(once[0].sum() + few[0]), float(few[1])))
    rng = np.random.default_rng(7)

    def seat(sweep):
        shared = spark.sparkContext.broadcast((sweep, size, m.discount))
        by = once + _by_symbol(pairs.mapInArrow(_sweep(shared), "symbol int, as_context double, as_word double"),
                               size, "symbol", "as_context", "as_word")
        shared.unpersist()
        return by[0], unigrams(by[1], rng)
    tables, parent = seat(None)
    for number in range(sweeps):
        sweep = Sweep(number, tables, parent)
        tables, parent = sweep.tables, sweep.parent = seat(sweep)
        if number >= burn_in:
            m.sweeps.append(sweep)
    shared = spark.sparkContext.broadcast(m)
    seated = held.table(pairs.mapInArrow(_seated(shared), "cell long, n long, own double, gain double, gain_held double, key long"), "seated")
    held.drop("pairs")
    return m, seated


# --- scoring -----------------------------------------------------------------------------

def _score(shared, filt):
    def run(batches):
        tables = byte_tables(True, True)
        s = shared.value
        m, known, known_log = s["model"], s["words"], s["logs"]
        size = m.symbols.size
        for b in blocks(batches, "text"):
            rows = b.num_rows
            w = words(b.column(1), tables)
            fresh = b.column(2).to_numpy(zero_copy_only=False)
            row, cell, sym = m.symbols.cells(w, rows)
            # each pair once per text with its number
            u, times = np.unique(row * (size * size) + cell, return_counts=True)
            row, cell = u // (size * size), u % (size * size)
            own = np.where(fresh[row], 0.0, 1.0 - m.discount)
            at = np.minimum(np.searchsorted(s["cells"], cell), max(len(s["cells"]) - 1, 0))
            sent = s["cells"][at] == cell if len(s["cells"]) else np.zeros(len(cell), dtype=bool)
            own[sent] = s["own"][at[sent]]
            chain = np.bincount(row, times * np.log10((own + m.backing(cell)) / m.weight(cell)), minlength=rows)
            ask = ~sent & in_table(filt.value, mix(cell.astype(np.uint64)))
            ask_ptr = np.searchsorted(row[ask], np.arange(rows + 1))
            grouped = sym > m.symbols.end
            chain -= np.bincount(w.row[grouped], s["group_log"][sym[grouped]], minlength=rows)
            # a word of the vocabulary brings its count along, only the others are looked up
            logs, have = s["own_log"][sym], ~grouped
            look = w.hash[grouped]
            at = np.minimum(np.searchsorted(known, look), max(len(known) - 1, 0))
            got = (known[at] == look) if len(known) else np.zeros(len(look), dtype=bool)
            have[grouped] = got
            logs[grouped] = np.where(got, known_log[at], 0.0) if len(known) else 0.0
            plain = np.bincount(w.row, logs, minlength=rows) + np.log10(s["end_n"] + SMOOTH)
            chain += np.bincount(w.row[grouped], logs[grouped], minlength=rows)
            n_known = np.bincount(w.row[have], minlength=rows) + (s["end_n"] > 0)
            # words outside the sent table, once per text with their number
            r, h = w.row[~have], w.hash[~have]
            order = np.lexsort((h, r))
            r, h = r[order], h[order]
            new = np.ones(len(h), dtype=bool)
            new[1:] = (r[1:] != r[:-1]) | (h[1:] != h[:-1])
            first = np.flatnonzero(new)
            rare_times = np.diff(np.append(first, len(h)))
            ptr = np.searchsorted(r[first], np.arange(rows + 1))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array((w.counts + 1).astype(np.int64)), pa.array(n_known.astype(np.int64)),
                 pa.array(plain), pa.array(chain), lists(signed(h[first]), ptr, pa.int64()),
                 lists(rare_times.astype(np.int32), ptr, pa.int32()), lists(cell[ask], ask_ptr, pa.int64()),
                 lists(times[ask].astype(np.int32), ask_ptr, pa.int32())],
                names=["doc_id", "held_out", "n_tokens", "n_known", "plain", "chain", "rare", "times", "cells", "cell_times"])
    return run


def _most(table: DataFrame, limit: int) -> int:
    """The smallest ``n`` whose rows and all of larger ``n`` are at most ``limit``."""
    by = table.groupBy("n").agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("n")).limit(limit + 1).toArrow()
    kept = np.cumsum(by.column("rows").to_numpy()) <= limit
    return int(by.column("n").to_numpy()[kept].min()) if kept.any() else 1 << 62


def model_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT,
                 sweeps: int = SWEEPS, burn_in: int = BURN_IN, vocabulary: int = VOCABULARY,
                 pairs_sent: int = PAIRS_SENT) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score, score, perplexity.

    Tokens are the A-Z lower-cased words of the whole text and one end. The
    model learns from all rows that are not held out. ``base_score`` is the
    smoothed unigram log10 probability; ``score`` that of the model.

    Words travel as 64-bit hashes. The counts of at most ``frequent`` words
    and the seating of at most ``pairs_sent`` pairs are sent to all tasks; a
    text's other words and pairs are joined with their tables, and only their
    sums come back. Null and empty texts are one end. A null id is held out;
    repeated rows are scored each (and all learnt from); with nothing to learn
    from, the model is its uniform base; no rows in, no rows out; other
    columns are ignored.
    """
    spark = docs.sparkSession
    store = Scratch(spark)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn(
        "held_out", held_out(F.col("doc_id")))
    learn = src.filter(~F.col("held_out"))
    table = learn.select("text").mapInArrow(_count_words, "word long, ending int, n long").groupBy("word").agg(
        F.sum("n").alias("n"), F.first("ending").alias("ending"))
    table = store.table(table, "word-counts")
    end_n = learn.count()
    total = table.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    train_tokens, distinct = (total["n"] or 0) + end_n, total["v"] + (end_n > 0)
    floor = _most(table, frequent)
    sent = table.filter(F.col("n") >= floor).toArrow()
    word, count, ending = sent.column("word").to_numpy().view(np.uint64), sent.column("n").to_numpy(), sent.column("ending").to_numpy()
    order = np.argsort(word)
    word, count, ending = word[order], count[order], ending[order]
    own = np.zeros(len(word), dtype=bool)
    own[np.lexsort((word, -count))[:vocabulary]] = True
    symbols = Symbols(word[own])

    # words that share a symbol: the sent ones here, the others by ending
    group = _by_symbol(table.filter(F.col("n") < floor).select("ending", "n", F.lit(1).alias("v")), GROUPS, "ending", "n", "v")
    group[0] += np.bincount(ending[~own], count[~own], minlength=GROUPS)
    group[1] += np.bincount(ending[~own], minlength=GROUPS)
    group_log = np.concatenate([np.zeros(symbols.end + 1), np.log10(group[0] + SMOOTH * (group[1] + 1))])

    model, pairs = fit(src, symbols, sweeps, burn_in, store)
    pair_floor = _most(pairs, pairs_sent)
    top = pairs.filter(F.col("n") >= pair_floor).select("cell", "own").toArrow()
    cells = top.column("cell").to_numpy()
    order = np.argsort(cells)
    shared = spark.sparkContext.broadcast({
        "model": model, "words": word[~own], "logs": np.log10(count[~own] + SMOOTH), "end_n": end_n, "group_log": group_log,
        "own_log": np.concatenate([np.log10(count[own] + SMOOTH), np.zeros(1 + GROUPS)]),
        "cells": cells[order], "own": top.column("own").to_numpy()[order]})
    others = pairs.filter(F.col("n") < pair_floor)
    scored = src.mapInArrow(_score(shared, bit_table(others.select("key"))),
                            "doc_id long, held_out boolean, n_tokens long, n_known long, plain double, chain double, "
                            "rare array<long>, times array<int>, cells array<long>, cell_times array<int>")
    scored = store.table(scored.withColumn("row_id", F.monotonically_increasing_id()), "text-scores")   # ids are fixed once written

    rare = scored.select("row_id", F.explode(F.arrays_zip("rare", "times")).alias("x")).select(
        "row_id", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    counts = table.filter(F.col("n") < floor).select(F.col("word").alias("t_word"), "n")
    rare = rare.join(counts, F.col("word") == F.col("t_word"), "left").groupBy("row_id").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + F.lit(SMOOTH))).alias("rest"),
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("rest_known")).withColumnRenamed("row_id", "r_id")
    asked = scored.select("row_id", "held_out", F.explode(F.arrays_zip("cells", "cell_times")).alias("x")).select(
        "row_id", "held_out", F.col("x.cells").alias("cell"), F.col("x.cell_times").alias("cell_times"))
    gains = others.select(F.col("cell").alias("g_cell"), "gain", "gain_held")
    asked = asked.join(gains, F.col("cell") == F.col("g_cell")).groupBy("row_id").agg(
        F.sum(F.col("cell_times") * F.when(F.col("held_out"), F.col("gain_held")).otherwise(F.col("gain"))).alias("gained")
    ).withColumnRenamed("row_id", "a_id")
    out = scored.drop("rare", "times", "cells", "cell_times").join(rare, F.col("row_id") == F.col("r_id"), "left").join(
        asked, F.col("row_id") == F.col("a_id"), "left")
    rest = F.coalesce("rest", F.lit(0.0))
    score = F.col("chain") + rest + F.coalesce("gained", F.lit(0.0))
    spread = float(np.log10(train_tokens + SMOOTH * (distinct + 1)))
    out = cut_lineage(out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("rest_known", F.lit(0))).alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"),
        (F.col("plain") + rest - F.col("n_tokens") * F.lit(spread)).alias("base_score"), score.alias("score"),
        F.pow(F.lit(10.0), -score / F.col("n_tokens")).alias("perplexity")), "language-model")
    store.close()
    return out
