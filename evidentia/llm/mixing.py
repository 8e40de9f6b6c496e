"""Mixing sources to target weights by balanced (cube-method) sampling."""

from __future__ import annotations

import bisect
import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from evidentia.session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
GROUP_ROWS = 4096              # documents balanced together in one flight
WEIGHTS = (1, 2, 3)
MAX_COPIES = 3.0
SEED = 20240


def size_of(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def source_targets(totals: DataFrame, weights=WEIGHTS, max_copies: float = MAX_COPIES) -> DataFrame:
    """``totals`` (source, source_size, source_rows), one row per source, with
    ``target``: sources in code-point order, null last, take ``weights`` in
    turn and share the sum of all sizes; what a target would exceed
    ``max_copies`` times its source is shared anew by weight.

    A source is at its ceiling exactly if ceiling / weight is not above the
    common level, so one pass in that order finds the level. Works on one
    row per source."""
    everything = W.partitionBy()
    place = F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last()))
    t = totals.withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                                                 ((place - 1) % len(weights) + 1).cast("int")))
    t = t.withColumn("ceiling", F.col("source_size") * F.lit(float(max_copies)))
    by_ratio = everything.orderBy(F.col("ceiling") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, W.unboundedFollowing)
    t = t.withColumn("level", (F.sum("source_size").over(everything.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
                               - F.coalesce(F.sum("ceiling").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    # sources stand at their ceiling up to the first whose share at its own level is below it
    t = t.withColumn("under", F.when(F.col("level") * F.col("weight") < F.col("ceiling"), F.col("level")))
    level = F.first("under", ignorenulls=True).over(by_ratio.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    share = F.coalesce(level * F.col("weight"), F.col("ceiling"))
    return t.withColumn("target", F.least(share, F.col("ceiling"))).select(
        "source", "source_size", "source_rows", "target")


def flight(sizes, probs, us):
    """Flight phase over units with inclusion probabilities ``probs``, keeping
    sum(prob) and sum(prob * size): three undecided units are moved along the
    null space of those two totals until one reaches 0 or 1. ``us`` holds one
    uniform number per unit (the random side of each move). At most two units
    stay undecided."""
    p = list(probs)
    open_: list = []
    for k in range(len(p)):
        if not 0.0 < p[k] < 1.0:
            continue
        open_.append(k)
        while len(open_) == 3:
            a, b, c = open_
            u = (sizes[b] - sizes[c], sizes[c] - sizes[a], sizes[a] - sizes[b])
            if u == (0.0, 0.0, 0.0):
                u = (1.0, -1.0, 0.0)
            up = down = math.inf
            for j, x in zip(open_, u):
                if x > 0:
                    up, down = min(up, (1.0 - p[j]) / x), min(down, p[j] / x)
                elif x < 0:
                    up, down = min(up, p[j] / -x), min(down, (1.0 - p[j]) / -x)
            step = up if us[k] * (up + down) < down else -down
            for j, x in zip(open_, u):
                q = p[j] + step * x
                p[j] = 0.0 if q < 1e-9 else 1.0 if q > 1.0 - 1e-9 else q
            left = [j for j in open_ if 0.0 < p[j] < 1.0]
            open_ = left if len(left) < 3 else left[:2]
    return p


def land(sizes, probs, us):
    """Landing: the at most two undecided units take the choice of 0 or 1 that
    leaves the total of sizes nearest to what is due (ties: fewer units). Then
    one taken and one left unit change places if that brings the total nearer,
    which keeps the number of documents."""
    p = list(probs)
    open_ = [k for k in range(len(p)) if 0.0 < p[k] < 1.0]
    due = sum(p[k] * sizes[k] for k in open_)
    best = min(range(1 << len(open_)), key=lambda m: (abs(sum(sizes[k] for i, k in enumerate(open_) if m >> i & 1) - due),
                                                      bin(m).count("1"), m))
    for i, k in enumerate(open_):
        p[k] = float(best >> i & 1)
    miss = due - sum(p[k] * sizes[k] for k in open_)
    out = sorted((sizes[k], us[k], k) for k in range(len(p)) if p[k] == 0.0)
    change = (abs(miss), 0.0, None, None)
    for k in (k for k in range(len(p)) if p[k] == 1.0):
        at = bisect.bisect_left(out, (sizes[k] + miss,))
        for s, u, j in out[max(0, at - 1):at + 1]:
            change = min(change, (abs(miss - (s - sizes[k])), us[k] + u, k, j), key=lambda x: x[:2])
    if change[2] is not None and change[0] < abs(miss):
        p[change[2]], p[change[3]] = 0.0, 1.0
    return p


_SCHEMA = "row_key binary, source string, size double, u double, prob double, spot long"


def _fly(landing: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["u", "row_key"], kind="stable")
        sizes, us = pdf["size"].tolist(), pdf["u"].tolist()
        p = flight(sizes, pdf["prob"].tolist(), us)
        if landing:
            p = land(sizes, p, us)
        # plain object strings: a pandas string column may come in chunks, which Arrow's row batches refuse
        return pdf.assign(prob=p, source=pdf["source"].astype(object))[["row_key", "source", "size", "u", "prob", "spot"]]
    return run


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                weights=WEIGHTS, max_copies: float = MAX_COPIES, seed: int = SEED,
                group_rows: int = GROUP_ROWS) -> DataFrame:
    """Per row: doc_id, size, source_size, target, taken, copies.

    Each document is taken floor(target / source_size) times, and once more
    with the remaining probability, drawn by the cube method: groups of
    ``group_rows`` documents of one source are balanced on their number and
    their sizes (so a source of any size is spread over many tasks), the at
    most two undecided documents of each group form new groups, level by
    level, and the last two of a source are landed. Only (key, source, size)
    move, never texts. Reruns agree: order and draws come from hashes.

    Null text has size 0; a source of size 0 takes nothing; null is a source
    of its own. Rows equal in id, source and size are told apart by a running
    number. Empty in, empty out. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"),
                       size_of(F.col(text_col)).alias("size"))
    # equal rows are interchangeable: keep them as one row with a multiplicity, expanded where drawn
    rows = cut_lineage(rows.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("same")), "mix-sizes")
    rows = rows.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("same")))).drop("same")
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
    targets = cut_lineage(source_targets(totals, weights, max_copies), "mix-targets")
    t = targets.withColumnRenamed("source", "t_source")
    rows = rows.join(t, F.col("source").eqNullSafe(F.col("t_source")), "left").drop("t_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    key = F.struct("doc_id", "source", "size", "nth")
    rows = rows.withColumn("rate", rate).withColumn("row_key", F.unhex(F.md5(F.to_json(key)))).withColumn(
        "u", F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52)))
    rows = rows.withColumn("whole", F.floor(F.col("rate") + 1e-12)).withColumn(
        "prob", F.greatest(F.col("rate") - F.col("whole"), F.lit(0.0)))

    # level 0: groups of a source; undecided documents go on
    open_rows = rows.filter("prob > 0 and prob < 1").select(
        "row_key", "source", F.col("size").cast("double").alias("size"), "u", "prob",
        F.floor(F.col("u") * F.ceil(F.col("source_rows") / F.lit(group_rows))).alias("spot"))
    decided = []
    step = 0
    while open_rows.agg(F.max("spot")).first()[0]:
        groups = cut_lineage(open_rows.groupBy("source", "spot").applyInPandas(_fly(False), _SCHEMA), f"mix-level{step}")
        decided.append(groups.filter("prob = 0 or prob = 1"))
        # a group leaves at most two documents; group_rows / 2 groups' worth make the next group
        open_rows = groups.filter("prob > 0 and prob < 1").withColumn("spot", F.floor(F.col("spot") / F.lit(group_rows // 2)))
        step += 1
    decided.append(open_rows.groupBy("source").applyInPandas(_fly(True), _SCHEMA))
    drawn = decided[0]
    for d in decided[1:]:
        drawn = drawn.unionByName(d)
    drawn = drawn.select(F.col("row_key").alias("d_key"), F.col("prob").alias("drawn"))
    out = rows.join(drawn, F.col("row_key") == F.col("d_key"), "left")
    copies = (F.col("whole") + F.coalesce("drawn", F.lit(0.0))).cast("long")
    return out.select("doc_id", F.col("size").cast("long").alias("size"), "source",
                      F.col("source_size").cast("long").alias("source_size"), "target",
                      (copies * F.col("size")).cast("long").alias("taken"), copies.alias("copies"))


def mixed(docs: DataFrame, copy_col: str = "copy", **options) -> DataFrame:
    """``docs`` repeated as the mix takes them, with all their columns and,
    first, ``copy_col`` (1, 2, ...), which replaces a column of that name.
    Documents taken no time are left out."""
    cols = [c for c in docs.columns if c != copy_col]
    plan = mix_sources(docs, **options)
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    source_col = options.get("source_col", "source")
    # rows equal in id, source and size are interchangeable: number them on both sides
    nth = F.row_number().over(W.partitionBy("p_id", "p_source", "p_size").orderBy("p_order"))
    p = plan.select(F.col("doc_id").alias("p_id"), F.col("source").alias("p_source"), F.col("size").alias("p_size"),
                    F.col("copies").alias("p_order")).withColumn("p_nth", nth).withColumnRenamed("p_order", "p_copies")
    nth = F.row_number().over(W.partitionBy("d_id", "d_source", "d_size").orderBy("d_order"))
    d = docs.select(F.struct(*[docs[c] for c in cols]).alias("d_row"), docs[id_col].alias("d_id"),
                    docs[source_col].cast("string").alias("d_source"), size_of(docs[text_col]).alias("d_size"))
    d = d.withColumn("d_order", F.xxhash64(F.to_json("d_row"))).withColumn("d_nth", nth)
    j = d.join(p, F.col("d_id").eqNullSafe(F.col("p_id")) & F.col("d_source").eqNullSafe(F.col("p_source"))
               & (F.col("d_size") == F.col("p_size")) & (F.col("d_nth") == F.col("p_nth")))
    return j.filter("p_copies > 0").select(
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("p_copies"))).alias(copy_col), "d_row").select(copy_col, "d_row.*")
