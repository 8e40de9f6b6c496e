"""N-gram Jaccard join in the metric space of shingle sets.

The Jaccard distance 1 - |A & B| / |A | B| is a metric. Regions of documents
that can be near one another are split around pivots until nothing is left
to compare:

* Documents without a common shingle are all at distance 1, so the first
  regions stand around shingles: a document belongs to those of its
  n - ceil(t n) + 1 rarest shingles, of which two documents at similarity t
  share at least one. A shingle is ranked by its rarest word (an upper
  bound on its own frequency); one whose rarest word occurs once has no
  other document and no region.
* Of each document that stands in a region, the shingles are counted that no
  other such document has. What it can have in common with any other is the
  rest, so a document of mostly own shingles stands in no region, and a pair
  meets only if both rests allow the similarity, and 512 parity marks of the
  sets, which differ in no more places than the sets do. Regions of the same
  members are one.
* In each region, documents are chosen as pivots, those of the fewest own
  shingles first (the middle of a group of near copies), and every member is
  compared with them. Members within the radius are linked.
* A region of many members that the pivots did not join up is split: each
  member belongs to the Voronoi cell of its nearest pivot, those far from
  all pivots to the rest; by the triangle inequality a near pair of two
  cells has each member inside a window around the other's pivot, and so
  boundary members are replicated. Cells are split in the same way, with
  new pivots; small ones go on with further pivots until all have met.
* A region whose members are connected already, or whose own members have
  all been pivots, is done; a member leaves that no size left there allows.

Sets travel as 64 bits a shingle (the rank of its rarest word and 56 bits of
its hash), and only those of documents in a region.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from evidentia.llm.bloom import blocks_for, bloom, mark, possible
from evidentia.llm.components import components
from evidentia.llm.rarity import SLOTS, word_levels
from evidentia.llm.scratch import Scratch
from evidentia.llm.words import blocks, byte_tables, lists, mix, shingles, signed, words
from evidentia.session import cut_lineage

WORDS = 5
PERCENT = 80                   # similarity in percent: whole numbers keep the bound exact
PIVOTS = 256                   # pivots of a region per round
LEAF = 1024                    # regions of more members beside the largest component are dealt into cells by distance
NO_ID = -(1 << 63)             # stands for a null id where keys are hashed
SHARE = 1 << 20                # shingles counted together, on average
MARKS = 8                      # 64-bit words of a set's parity marks
HAND = 1 << 20                 # shingles that a task deals out at once
_TOP = np.uint64(56)


def ranked_sets(w, rows: int, level, k: int):
    """Distinct ``k``-word shingles of each row of a block as numbers that
    sort by rarity first, then by hash: (numbers, their rows, first per row).
    The top byte is the rank of the shingle's rarest word."""
    at, h = shingles(w, k, True)
    per_word = np.append(level[(w.hash & np.uint64(len(level) - 1)).astype(np.int64)], np.full(k, 255, np.uint8))
    rare = per_word[at]
    for j in range(1, k):
        inside = (at + j < len(w.row)) & (w.row[np.minimum(at + j, max(len(w.row) - 1, 0))] == w.row[at])
        rare = np.minimum(rare, np.where(inside, per_word[at + j], 255))
    key = (rare.astype(np.uint64) << _TOP) | (h >> np.uint64(8))
    row = w.row[at]
    order = np.lexsort((key, row))
    key, row = key[order], row[order]
    if len(key):
        new = np.ones(len(key), dtype=bool)
        new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
        key, row = key[new], row[new]
    return key, row, np.searchsorted(row, np.arange(rows + 1))


def set_names(key, ptr) -> pa.Array:
    """128-bit name of each row's set."""
    rows = len(ptr) - 1
    full = np.diff(ptr) > 0
    name = np.zeros((rows, 2), np.uint64)
    if len(key):
        name[full, 0] = np.add.reduceat(mix(key), ptr[:-1][full])
        name[full, 1] = np.add.reduceat(mix(key ^ np.uint64(0x5851F42D4C957F2D)), ptr[:-1][full])
    return pa.array([x.tobytes() for x in name], type=pa.binary())


def prefixes(key, row, ptr, percent: int):
    """Prefix numbers of each row: (numbers, first per row, places in the
    row). Rows of similarity ``percent`` share one of their n - ceil(t n) + 1
    rarest numbers; those that occur in no other row are left out."""
    n = np.diff(ptr)
    length = n - (percent * n + 99) // 100 + 1
    place = np.arange(len(key)) - ptr[row]
    use = (place < length[row]) & (key >> _TOP > 0)
    return key[use], np.concatenate([[0], np.cumsum(np.bincount(row[use], minlength=len(n)))]), place[use]


def whole_sets(key, ptr) -> pa.Array:
    """The numbers of each row's set."""
    return lists(signed(key), ptr, pa.int64())


def _describe(levels, k: int, percent: int):
    """Per document: id, hash of the text, number of shingles, 128-bit name of
    the set, and the numbers and places of its regions."""
    def run(batches):
        tables = byte_tables(True, True)
        for b in blocks(batches, "text"):
            key, row, ptr = ranked_sets(words(b.column(1), tables), b.num_rows, levels.value, k)
            sig, sig_ptr, place = prefixes(key, row, ptr, percent)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(pa.int64()), b.column(2), pa.array(np.diff(ptr).astype(np.int64)), set_names(key, ptr),
                 lists(signed(sig), sig_ptr, pa.int64()), lists(place.astype(np.int32), sig_ptr, pa.int32())],
                names=["doc_id", "hash", "n", "name", "sig", "place"])
    return run


def _parity(key, ptr) -> np.ndarray:
    """MARKS words per row; a bit tells whether an odd number of the row's
    numbers hash to it. Of two sets, no more bits differ than numbers."""
    row = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))
    at = row * (64 * MARKS) + (key & np.uint64(64 * MARKS - 1)).astype(np.int64)
    odd = np.bincount(at, minlength=(len(ptr) - 1) * 64 * MARKS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _sets(levels, k: int):
    """Whole sets and parity marks of the texts whose set has the name that
    is asked for."""
    def run(batches):
        tables = byte_tables(True, True)
        for b in blocks(batches, "text"):
            key, _, ptr = ranked_sets(words(b.column(2), tables), b.num_rows, levels.value, k)
            right = pc.equal(set_names(key, ptr), b.column(1).cast(pa.binary()))
            bits = lists(_parity(key, ptr), np.arange(b.num_rows + 1) * MARKS, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), whole_sets(key, ptr), bits], names=["node", "keys", "bits"]).filter(right)
    return run


def _dealt(shares: int):
    """The numbers of sets, dealt by their hash to shares: 32 bits of each,
    with the nodes that they belong to and how many in a row are a node's;
    one row per share of at most HAND numbers (or one set)."""
    def run(batches):
        for b in batches:
            size = pc.list_value_length(b.column(1)).to_numpy(zero_copy_only=False)
            ends = np.cumsum(size)
            lo = 0
            while lo < b.num_rows:
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + HAND, side="right")))
                part = b.slice(lo, hi - lo)
                h = pc.list_flatten(part.column(1)).to_numpy(zero_copy_only=False).view(np.uint64)
                node = np.repeat(part.column(0).to_numpy(zero_copy_only=False), size[lo:hi])
                share = ((h >> np.uint64(32)) & np.uint64(0xFFFFFF)) % np.uint64(shares)
                order = np.argsort(share, kind="stable")
                share, node, bits = share[order], node[order], (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)[order].view(np.int32)
                new = np.ones(len(share), dtype=bool)
                new[1:] = share[1:] != share[:-1]
                first = np.flatnonzero(new)
                new[1:] |= node[1:] != node[:-1]
                run = np.flatnonzero(new)
                ptr = np.append(first, len(share))
                runs = np.searchsorted(run, ptr)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(share[first].astype(np.int32)), lists(node[run], runs, pa.int64()),
                     lists(np.diff(np.append(run, len(share))), runs, pa.int32()), lists(bits, ptr, pa.int32())],
                    names=["share", "nodes", "times", "bits"])
                lo = hi
    return run


def _own(table: pa.Table) -> pa.Table:
    """Of one share: how many numbers of each node no other node has."""
    node = np.repeat(pc.list_flatten(table.column("nodes")).to_numpy(), pc.list_flatten(table.column("times")).to_numpy())
    bits = pc.list_flatten(table.column("bits")).to_numpy()
    order = np.lexsort((node, bits))
    node, bits = node[order], bits[order]
    new = np.ones(len(bits), dtype=bool)
    new[1:] = bits[1:] != bits[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(bits)) - 1           # a set that came twice counts once
    got, n = np.unique(node[first[node[first] == node[last]]], return_counts=True)
    return pa.table({"node": pa.array(got, pa.int64()), "own": pa.array(n.astype(np.int64), pa.int64())})


def _own_counts(sets: DataFrame, numbers: int) -> DataFrame:
    """(node, own): at most as many numbers of a set as no other set has.
    Numbers that agree in the bits compared count as shared."""
    shares = max(1, min(1 << 24, numbers // SHARE))
    dealt = sets.mapInArrow(_dealt(shares), "share int, nodes array<long>, times array<int>, bits array<int>")
    return dealt.groupBy("share").applyInArrow(_own, "node long, own long").groupBy("node").agg(F.sum("own").alias("own"))


def _named(levels, k: int):
    """Ids, names of the sets and texts of documents."""
    def run(batches):
        tables = byte_tables(True, True)
        for b in blocks(batches, "text"):
            key, _, ptr = ranked_sets(words(b.column(1), tables), b.num_rows, levels.value, k)
            yield pa.RecordBatch.from_arrays([b.column(0), set_names(key, ptr), b.column(1).cast(pa.string())],
                                             names=["t_id", "t_name", "t_text"])
    return run


def _compare(pairs: DataFrame, sets: DataFrame, held: Scratch, node: str = "long") -> DataFrame:
    """Exact sizes of the intersections of ``pairs`` (a, b, na, nb). Only the
    sets that a pair may ask for are shuffled."""
    pairs = held.table(pairs, "pairs")
    n = pairs.count()
    if not n:
        return sets.sparkSession.createDataFrame([], f"a {node}, b {node}, na long, nb long, common long, whole long")
    both = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key")))
    sets = possible(sets, F.col("node"), both, blocks_for(2 * n))
    left = sets.select(F.col("node").alias("a"), F.col("keys").alias("ka"))
    right = sets.select(F.col("node").alias("b"), F.col("keys").alias("kb"))
    got = pairs.join(left, "a").join(right, "b").select(
        "a", "b", "na", "nb", F.size(F.array_intersect("ka", "kb")).cast("long").alias("common"))
    return held.table(got.withColumn("whole", F.col("na") + F.col("nb") - F.col("common")), "distances")


def _pairs(members: DataFrame, pivots: DataFrame, percent: int, links_only: bool) -> DataFrame:
    """Distinct pairs (a < b) of members and pivots of their region. Where
    only links matter, pairs are left out that are connected already, whose
    sizes rule a link out, or too few of whose shingles others have, or too
    many of whose parity marks differ, or whose
    shared shingle, were it the first one, stands too far back in either (a
    linked pair passes at its first). Where
    distances deal out cells, only those are left out whose sizes put the
    member beyond every window."""
    p = pivots.select(F.col("region").alias("p_region"), F.col("node").alias("pivot"), F.col("n").alias("pn"),
                      F.col("place").alias("p_place"), F.col("rest").alias("p_rest"), F.col("bits").alias("p_bits"), F.col("root").alias("p_root"))
    j = members.join(p, F.col("region") == F.col("p_region")).filter("node <> pivot")
    small, large = F.least("n", "pn"), F.greatest("n", "pn")
    bound = percent if links_only else max(0, 100 - 4 * (100 - percent))
    j = j.filter(small * 100 >= large * bound)
    if links_only:
        most = F.least(F.col("n") - F.col("place"), F.col("pn") - F.col("p_place"), "rest", "p_rest")
        apart = sum((F.bit_count(F.col("bits")[i].bitwiseXOR(F.col("p_bits")[i])) for i in range(1, MARKS)),
                    F.bit_count(F.col("bits")[0].bitwiseXOR(F.col("p_bits")[0])))
        j = j.filter("root <> p_root").filter(apart * (100 + percent) <= (F.col("n") + F.col("pn")) * (100 - percent)).filter(most * (100 + percent) >= (F.col("n") + F.col("pn")) * percent)
    first = F.col("node") < F.col("pivot")
    return j.select(F.when(first, F.col("node")).otherwise(F.col("pivot")).alias("a"),
                    F.when(first, F.col("pivot")).otherwise(F.col("node")).alias("b"),
                    F.when(first, F.col("n")).otherwise(F.col("pn")).alias("na"),
                    F.when(first, F.col("pn")).otherwise(F.col("n")).alias("nb")).distinct()


def _cells(members: DataFrame, pivots: DataFrame, dist: DataFrame, percent: int) -> DataFrame:
    """Members of regions dealt to the cells of the pivots, with replicas.

    With radius e = 1 - t: a member nearer than 3e to its nearest pivot is
    owned by that pivot's cell, any other by the rest. A member goes as a
    replica into the cell of every pivot within 4e that is not farther than
    its nearest one by more than 2e, one at 2e or more from its nearest pivot
    also into the rest: so each owner's cell holds whatever can be near it.
    Pivots have met every member and leave."""
    e = (100 - percent) / 100.0
    p = pivots.select(F.col("region").alias("p_region"), F.col("node").alias("pivot"))
    stay = members.join(p.select("p_region", F.col("pivot").alias("p_node")),
                        (F.col("region") == F.col("p_region")) & (F.col("node") == F.col("p_node")), "left_anti")
    d = dist.select("a", "b", (1.0 - F.col("common") / F.col("whole")).alias("d")).filter(F.col("d") <= 4 * e + 1e-9)
    d = d.select(F.col("a").alias("d_node"), F.col("b").alias("d_pivot"), "d").unionByName(
        d.select(F.col("b").alias("d_node"), F.col("a").alias("d_pivot"), "d"))
    near = stay.select("region", "node").join(p, F.col("region") == F.col("p_region")).join(
        d, (F.col("node") == F.col("d_node")) & (F.col("pivot") == F.col("d_pivot"))).select("region", "node", "pivot", "d")
    best = near.groupBy("region", "node").agg(F.min(F.struct("d", "pivot")).alias("best")).select(
        F.col("region").alias("b_region"), F.col("node").alias("b_node"), "best")
    m = stay.join(best, (F.col("region") == F.col("b_region")) & (F.col("node") == F.col("b_node")), "left")
    home = F.when(F.col("best.d") < 3 * e, F.col("best.pivot"))
    own = m.select(F.when(home.isNull(), F.xxhash64("region")).otherwise(F.xxhash64("region", home)).alias("cell"), "node", "n", "place", "rest", "bits", "owner")
    far = F.least(F.col("best.d") + 2 * e, F.lit(4 * e)) + 1e-9
    copies = m.join(near.select(F.col("region").alias("n_region"), F.col("node").alias("n_node"),
                                F.col("pivot").alias("other"), F.col("d").alias("other_d")),
                    (F.col("region") == F.col("n_region")) & (F.col("node") == F.col("n_node")))
    copies = copies.filter((F.col("other_d") <= F.when(home.isNull(), F.lit(4 * e + 1e-9)).otherwise(far))
                           & (home.isNull() | (F.col("other") != home)))
    copies = copies.select(F.xxhash64("region", "other").alias("cell"), "node", "n", "place", "rest", "bits", F.lit(False).alias("owner"))
    edge = m.filter(home.isNotNull() & (F.col("best.d") >= 2 * e - 1e-9)).select(
        F.xxhash64("region").alias("cell"), "node", "n", "place", "rest", "bits", F.lit(False).alias("owner"))
    return own.unionByName(copies).unionByName(edge).withColumnRenamed("cell", "region")


def similar_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WORDS,
                    percent: int = PERCENT, pivots: int = PIVOTS, leaf: int = LEAF, slots: int = SLOTS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id.

    Sets are the distinct ``k``-word shingles (A-Z lower-cased) of the whole
    text; a text of fewer words is one sequence; null or no words give an
    empty set, linked with nothing, whose component is its own id. Two
    documents are linked if 100 |A & B| >= percent |A | B|; a component is
    named by its smallest id. Equal sets are one class from the start (by a
    128-bit name), so copies are never compared. Repeated rows and ids are
    fine; a null id takes part and counts as larger than any other; no rows
    in, no rows out; other columns are ignored.
    """
    held = Scratch(docs.sparkSession)
    out = cut_lineage(_classes(docs, id_col, text_col, k, percent, pivots, leaf, slots, held).drop("name"), "similar-classes")
    held.close()
    return out


def _classes(docs: DataFrame, id_col, text_col, k, percent, pivots, leaf, slots, held: Scratch) -> DataFrame:
    """``similar_classes`` with the name of each row's set; reads tables of ``held``."""
    levels = word_levels(docs, text_col, True, slots)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    src = src.withColumn("hash", F.xxhash64("text"))
    described = src.mapInArrow(_describe(levels, k, percent),
                               "doc_id long, hash long, n long, name binary, sig array<long>, place array<int>")
    # a class is known by the row number of one of its rows, fixed once written
    rows = held.table(described.withColumn("row", F.monotonically_increasing_id()), "sets")
    classes = held.table(rows.groupBy("name").agg(F.min("row").alias("node"), F.min("doc_id").alias("first_id")), "classes")
    # one row of each class stands for it; only what may be another one is shuffled
    later = held.table(rows.select("row", "name").join(classes.select(F.col("name").alias("c_name"), "node"),
                                                       F.col("name") == F.col("c_name")).filter("row > node").select(
        F.col("row").alias("key")), "later")
    marked = mark(rows.filter(F.size("sig") > 0), F.col("row"), bloom(later), "may_later")
    heads = marked.filter("not may_later").unionByName(marked.filter("may_later").join(
        later, F.col("row") == F.col("key"), "left_anti")).drop("may_later")
    spread = heads.select(F.col("row").alias("node"), "n", F.explode(F.arrays_zip("sig", "place")).alias("x")).select(
        "node", "n", F.col("x.sig").alias("region"), F.col("x.place").alias("place"))
    shared = held.table(spread.groupBy("region").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select(
        F.col("region").alias("key")), "shared")
    members = held.table(possible(spread, F.col("region"), shared).join(
        shared, F.col("region") == F.col("key"), "left_semi"), "members")
    # whole sets, only of the documents that stand in a region: their texts are found first, which are shorter
    needed = held.table(heads.select("row", "doc_id", "hash", "name", "n").join(
        members.select(F.col("node").alias("m_node")).distinct(), F.col("row") == F.col("m_node"), "left_semi").select(
        F.col("row").alias("node"), F.col("doc_id").alias("n_id"), F.col("hash").alias("n_hash"), "name", "n"), "needed")
    asked = possible(src.withColumn("id_key", F.coalesce("doc_id", F.lit(NO_ID))), F.col("id_key"),
                     needed.select(F.coalesce("n_id", F.lit(NO_ID)).alias("key"))).select("doc_id", "hash", "text")
    asked = asked.join(needed, F.col("doc_id").eqNullSafe(F.col("n_id")) & (F.col("hash") == F.col("n_hash")))
    sets = held.table(asked.select("node", "name", "text").mapInArrow(_sets(levels, k), "node long, keys array<long>, bits array<long>"), "needed-sets")
    numbers = needed.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    rests = needed.select(F.col("node").alias("s_node"), F.col("n").alias("s_n")).join(
        _own_counts(sets, numbers), F.col("s_node") == F.col("node"), "left").select(
        "s_node", (F.col("s_n") - F.coalesce("own", F.lit(0))).alias("rest")).filter(F.col("rest") * 100 >= F.col("s_n") * percent)
    rests = rests.join(sets.groupBy("node").agg(F.first("bits").alias("bits")), F.col("s_node") == F.col("node")).drop("node")
    rests = held.table(rests, "rests")
    sets = held.table(possible(sets.drop("bits"), F.col("node"), rests.select(F.col("s_node").alias("key"))), "needed-sets")
    members = members.join(rests, F.col("node") == F.col("s_node")).drop("s_node")
    members = held.table(members, "members")
    # regions of the same members (the same number, the same sum of hashes: others would only join up) are one
    same = members.groupBy("region").agg(F.count(F.lit(1)).alias("rows"), F.bit_xor(F.xxhash64("node")).alias("sum")).filter(
        "rows > 1").select(F.col("region").alias("key"), F.xxhash64("rows", "sum").alias("group"))
    members = members.join(same, F.col("region") == F.col("key")).groupBy(F.col("group").alias("region"), "node").agg(
        F.first("n").alias("n"), F.min("place").alias("place"), F.first("rest").alias("rest"), F.first("bits").alias("bits")).withColumn("owner", F.lit(True))
    members = held.table(members, "members")
    held.drop("shared", "needed", "rests", "later")

    roots, wide = None, 1
    while True:
        if roots is None:
            m = members.withColumn("root", F.col("node"))
        else:
            r = roots.select(F.col("node").alias("r_node"), F.col("root").alias("r_root"))
            m = members.join(r, F.col("node") == F.col("r_node"), "left").withColumn(
                "root", F.coalesce("r_root", "node")).drop("r_node", "r_root")
        parts = m.groupBy("region", "root").agg(F.count(F.when(F.col("owner"), 1)).alias("own"), F.min("n").alias("low"))
        open_ = parts.groupBy("region").agg(F.count(F.lit(1)).alias("parts"), F.sum("own").alias("owners"),
                                            F.max("own").alias("most"), F.min("low").alias("low")).filter("parts > 1 and owners > 0")
        m = m.join(open_.select(F.col("region").alias("o_region"), (F.col("owners") - F.col("most")).alias("others"), "low"),
                   F.col("region") == F.col("o_region")).drop("o_region")
        # who cannot be linked with the smallest size there is can be linked with none
        m = held.table(m.filter(F.col("rest") * (100 + percent) >= (F.col("n") + F.col("low")) * percent).drop("low"), "open-regions")
        if not m.take(1):
            break
        # the first round asks only for links to one pivot, which joins up most regions
        crowded = (F.col("others") > leaf) if roots is not None else F.lit(False)
        # members of the region's smaller components first: once they have met all others, one component is left
        alike = F.count(F.lit(1)).over(W.partitionBy("region", "root")) if roots is not None else F.lit(1)
        turn = F.row_number().over(W.partitionBy("region").orderBy(
            "alike", (F.col("n") - F.col("rest")) / F.col("n"), F.xxhash64("node"), "node"))
        chosen = m.filter("owner").withColumn("alike", alike).withColumn("turn", turn).filter(
            F.col("turn") <= wide).drop("turn", "alike")
        chosen = held.table(chosen, "pivots")
        todo = _pairs(m.filter(~crowded), chosen.filter(~crowded), percent, True).unionByName(
            _pairs(m.filter(crowded), chosen.filter(crowded), percent, False)).distinct()
        dist = _compare(todo, sets, held)
        new = dist.filter(F.col("common") * 100 >= F.col("whole") * percent).select("a", "b")
        if roots is None or new.take(1):
            links = new if roots is None else roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(new)
            roots = components(links, held)
        plain = m.filter(~crowded).join(chosen.select(F.col("region").alias("p_region"), F.col("node").alias("p_node")),
                                        (F.col("region") == F.col("p_region")) & (F.col("node") == F.col("p_node")), "left_anti")
        cells = _cells(m.filter(crowded).select("region", "node", "n", "place", "rest", "bits", "owner"), chosen.filter(crowded), dist, percent)
        members = plain.select("region", "node", "n", "place", "rest", "bits", "owner").unionByName(cells.select(
            "region", "node", "n", "place", "rest", "bits", "owner"))
        members = held.table(members, "members")
        # four times as many pivots a round: links found in between leave fewer pairs of different components
        wide = min(4 * wide, pivots)
    if roots is None:
        found = classes.select(F.col("name").alias("f_name"), F.col("first_id").alias("component_id"))
    else:
        r = roots.select(F.col("node").alias("r_node"), "root")
        c = classes.join(r, F.col("node") == F.col("r_node"), "left").withColumn("root", F.coalesce("root", "node"))
        names = c.groupBy("root").agg(F.min("first_id").alias("component_id")).withColumnRenamed("root", "c_root")
        found = c.join(names, F.col("root") == F.col("c_root")).select(F.col("name").alias("f_name"), "component_id")
    out = rows.select("doc_id", F.col("n").alias("n_shingles"), "name").join(found, F.col("name") == F.col("f_name"))
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(
        F.coalesce("component_id", "doc_id")).alias("component_id"), "name")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WORDS, percent: int = PERCENT,
               pivots: int = PIVOTS, leaf: int = LEAF, slots: int = SLOTS) -> DataFrame:
    """Rows of ``docs`` that stay, with all their columns: of each component
    the rows with its smallest id (rows without an id stay). Of an id on
    several rows, only those go whose own text is in such a component."""
    held = Scratch(docs.sparkSession)
    found = _classes(docs, id_col, text_col, k, percent, pivots, leaf, slots, held)
    drop = cut_lineage(found.filter("doc_id <> component_id").select(
        F.col("doc_id").alias("drop_id"), F.col("name").alias("drop_name")).distinct(), "near-copies")
    held.close()
    ids = drop.groupBy("drop_id").agg(F.count(F.lit(1)).alias("names"))
    mine = docs[id_col].cast("long")
    # an id that stands on one row, as nearly all do, is decided by the id alone
    rows = possible(docs.select(mine.alias("r_id")), F.col("r_id"), drop.select(F.col("drop_id").alias("key")))
    twice = cut_lineage(rows.groupBy("r_id").agg(F.count(F.lit(1)).alias("rows")).join(
        ids, F.col("r_id") == F.col("drop_id")).filter("rows > 1").select("r_id"), "repeated-ids")
    once = drop.join(twice, F.col("drop_id") == F.col("r_id"), "left_anti").select("drop_id").distinct()
    out = docs.join(once, mine == once["drop_id"], "left_anti")
    if twice.isEmpty():
        return out
    levels = word_levels(docs, text_col, True, slots)
    text = out.join(twice, mine == twice["r_id"], "left_semi").select(mine.alias("doc_id"), F.col(text_col).alias("text")).distinct()
    named = text.mapInArrow(_named(levels, k), "t_id long, t_name binary, t_text string")
    gone = cut_lineage(named.join(drop, (F.col("t_id") == F.col("drop_id")) & (F.col("t_name") == F.col("drop_name")),
                                  "left_semi").select("t_id", F.md5("t_text").alias("t_md5")).distinct(), "near-copy-texts")
    return out.join(gone, (mine == gone["t_id"]) & (F.md5(docs[text_col]) == gone["t_md5"]), "left_anti")
