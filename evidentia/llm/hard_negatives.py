"""Hard negatives: for each anchor its nearest rows of the same label, and for
each of these the nearest rows of other labels whose score lies within a
margin below it. Exact, by certified walks over shared lists.

Anchors are clustered by direction. In every task, and for every cluster, the
task's candidates are sorted once by an upper bound of their score with any
member: for a candidate at angle ``phi`` to the cluster's direction and members
within ``theta`` of it, |x| cos(max(0, phi - theta)). All members walk this one
list; a member stops when its length times the bound of the next candidate is
below what it already holds (or below its margin), which certifies that
nothing further on can enter. Thresholds are carried from list to list of a
task. What leaves a task is at most ``k`` rows per anchor (and positive), and a
window merges the tasks.

Anchors travel in loads of at most LOAD_BYTES, packed from whole clusters or
pieces of large ones: one load is on the driver and in a task at a time, and
each load is one scan of the rows without a shuffle of vectors.

Cases: rows with a null id, label, vector, a null or non-finite component, or a
component beyond LIMIT after scaling take no part. Vectors score only with
vectors of their own length. Rows that share an anchor's id are never its
positives or negatives; an id that is an anchor several times is one anchor,
with the smallest (label, vector); any other repeated row counts as often as
it is there. Ties go to the smaller id. An empty table, or one without anchors,
gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidentia.session import cut_lineage, stage

LOAD_BYTES = 16 << 20          # anchor vectors of one load
SHARD_BYTES = 32 << 20         # candidate vectors of one list
CHUNK = 2048                   # candidates looked at between two checks of the bound
CLUSTER_SAMPLE = 4096          # anchors that the cluster directions are fitted on, at most
MAX_CLUSTERS = 256
LIMIT = 1 << 24                # components are smaller: sums of products stay exact in 64 bits
_NONE = np.iinfo(np.int64).min // 4


def integer_rows(rows: DataFrame, id_col: str, label_col: str, vector_col: str, scale: int = 256) -> DataFrame:
    """(id, label, v): components as floor(scale * x), without the rows that take no part."""
    v = F.transform(F.col(vector_col), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    bad = F.exists(F.col(vector_col), lambda x: x.isNull() | F.isnan(x.cast("double"))
                   | (F.abs(F.lit(float(scale)) * x.cast("double")) >= LIMIT))
    return (rows.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & ~bad)
                .select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"),
                        v.cast("array<long>").alias("v")))


# --- anchors ---------------------------------------------------------------------------

def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def _directions(sample: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Spherical k-means on unit vectors, started on evenly spaced sample rows."""
    centre = sample[np.linspace(0, len(sample) - 1, k).astype(int)]
    for _ in range(rounds):
        own = np.argmax(sample @ centre.T, axis=1)
        total = np.zeros_like(centre)
        np.add.at(total, own, sample)
        fresh = _unit(total)
        centre = np.where(np.linalg.norm(fresh, axis=1, keepdims=True) > 0, fresh, centre)
    return centre


def _matrix(col: pa.Array, dims: int) -> np.ndarray:
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(col), dims)


def _clustered(anchors: DataFrame, dims: int, count: int) -> DataFrame:
    """Anchors of one vector length with their cluster (``piece``), cut so that a piece fits a load."""
    sample = anchors.sample(min(1.0, 1.2 * CLUSTER_SAMPLE / count), seed=7).limit(CLUSTER_SAMPLE).select("v").toArrow()
    vectors = _unit(_matrix(sample.column("v").combine_chunks(), dims)) if len(sample) else np.zeros((1, dims))
    centre = _directions(vectors, min(MAX_CLUSTERS, len(vectors), int(np.ceil(np.sqrt(count)))))

    def assign(batches):
        for b in batches:
            x = _unit(_matrix(b.column(2), dims))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.argmax(x @ centre.T, axis=1), type=pa.int64())],
                                             ["id", "label", "v", "cluster"])

    return anchors.mapInArrow(assign, "id long, label long, v array<long>, cluster long")


def _loads(anchors: DataFrame, dims: int, load_bytes: int):
    """Anchors of one vector length, load by load: lists of (ids, labels, vectors) per cluster."""
    room = max(1, load_bytes // max(8, 8 * dims))
    sizes = {r["cluster"]: r["count"] for r in anchors.groupBy("cluster").count().collect()}      # <= MAX_CLUSTERS rows
    pieces = [(c, p, -(-n // room)) for c, n in sorted(sizes.items()) for p in range(-(-n // room))]
    load, held = [], 0
    for c, p, of in pieces + [(None, 0, 1)]:
        n = sizes.get(c, 0) // of + 1
        if load and (c is None or held + n > room):
            pick = None
            for lc, lp, lof in load:
                one = (F.col("cluster") == lc) & (F.pmod(F.xxhash64("id"), F.lit(lof)) == lp)
                pick = one if pick is None else pick | one
            got = anchors.filter(pick).orderBy("id").toArrow()
            if len(got):
                cl = got.column("cluster").to_numpy()
                x = _matrix(got.column("v").combine_chunks(), dims)
                ids, labels = got.column("id").to_numpy(), got.column("label").to_numpy()
                yield [(ids[cl == k], labels[cl == k], x[cl == k]) for k in np.unique(cl)]
            load, held = [], 0
        load.append((c, p, of))
        held += n


# --- walks -------------------------------------------------------------------------------

class _Best:
    """The k best candidates of each slot: scores, ids, and what a candidate must reach."""

    def __init__(self, slots: int, k: int, floor: np.ndarray):
        self.k = k
        self.score = np.full((slots, k), _NONE, dtype=np.int64)
        self.id = np.full((slots, k), np.iinfo(np.int64).max, dtype=np.int64)
        self.floor = floor

    def threshold(self):
        return np.maximum(self.score[:, -1], self.floor)

    def offer(self, slots: np.ndarray, scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray) -> None:
        """``scores`` (slots x candidates); ``allowed`` says which pairs count."""
        last, last_id = self.score[slots, -1][:, None], self.id[slots, -1][:, None]
        better = (scores > last) | ((scores == last) & (ids[None, :] < last_id))
        row, col = np.nonzero(allowed & better & (scores >= self.floor[slots][:, None]))
        if not len(row):
            return
        touched = np.unique(row)
        s = np.concatenate([scores[row, col], self.score[slots[touched]].ravel()])
        i = np.concatenate([ids[col], self.id[slots[touched]].ravel()])
        r = np.concatenate([row, np.repeat(touched, self.k)])
        order = np.lexsort((i, -s, r))
        s, i, r = s[order], i[order], r[order]
        first = np.searchsorted(r, touched)
        take = first[:, None] + np.arange(self.k)[None, :]
        self.score[slots[touched]] = s[take]
        self.id[slots[touched]] = i[take]


class _Walker:
    """One load of anchors against the candidates of a task."""

    def __init__(self, clusters, k: int, positives=None, low: int = 0, high: int = 0):
        self.k, self.clusters, self.best = k, [], []
        for ids, labels, x in clusters:
            unit = _unit(x)
            direction = _unit(unit.sum(axis=0, keepdims=True))[0]
            length = np.linalg.norm(x, axis=1)
            real = length > 0
            theta = float(np.arccos(np.clip(unit[real] @ direction, -1, 1)).max()) if real.any() else 0.0
            self.clusters.append((ids, labels, x, direction, theta + 1e-6, length))
            if positives is None:                       # one slot per member
                self.best.append([(_Best(len(ids), k, np.full(len(ids), _NONE, dtype=np.int64)), None)])
                continue
            own = []
            for rank in range(max((len(positives.get(i, ())) for i in ids.tolist()), default=0)):
                top = np.array([positives.get(i, ())[rank] if rank < len(positives.get(i, ())) else -1 for i in ids.tolist()],
                               dtype=np.int64)
                # low * p <= 100 * s <= high * p; a negative p leaves no s
                floor = np.where(top >= 0, -(-low * top // 100), np.iinfo(np.int64).max // 4)
                own.append((_Best(len(ids), k, floor), np.where(top >= 0, high * top // 100, _NONE)))
            self.best.append(own)
        self.same = positives is None

    def walk(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray) -> None:
        norm = np.linalg.norm(x, axis=1)
        unit = _unit(x)
        exact = x.shape[1] == 0 or float(norm.max(initial=0)) * max((float(c[5].max(initial=0)) for c in self.clusters), default=0) < 2.0 ** 52
        for (aid, alabel, a, direction, theta, length), slots in zip(self.clusters, self.best):
            if not slots:
                continue
            phi = np.arccos(np.clip(unit @ direction, -1, 1))
            bound = norm * np.cos(np.maximum(0.0, phi - theta)) * (1 + 1e-9) + 1e-6
            order = np.argsort(-bound, kind="stable")
            active = np.arange(len(aid))
            for lo in range(0, len(order), CHUNK):
                need = np.min([b.threshold()[active] for b, _ in slots], axis=0)
                # the bound may be negative: then the shorter member has the larger one
                top = bound[order[lo]]
                active = active[~(np.where(top >= 0, length[active] * top, 0.0) < need)]
                if not len(active):
                    break
                part = order[lo:lo + CHUNK]
                if exact:
                    scores = (a[active] @ x[part].T).astype(np.int64)
                else:
                    scores = a[active].astype(np.int64) @ x[part].T.astype(np.int64)
                alike = alabel[active][:, None] == labels[part][None, :]
                allowed = (alike if self.same else ~alike) & (aid[active][:, None] != ids[part][None, :])
                for best, high in slots:
                    best.offer(active, scores, ids[part], allowed if high is None else allowed & (scores <= high[active][:, None]))

    def rows(self):
        """(anchor, positive's rank, id, score) of everything held."""
        for (aid, *_), slots in zip(self.clusters, self.best):
            for rank, (best, _) in enumerate(slots):
                row, col = np.nonzero(best.score > _NONE)
                yield aid[row], np.full(len(row), rank), best.id[row, col], best.score[row, col]


def _scan(rows: DataFrame, dims: int, make, shard_bytes: int) -> DataFrame:
    """Walk all rows of one vector length; (anchor, slot, id, score) of each task's best."""
    shard = max(CHUNK, shard_bytes // max(8, 8 * dims))

    def run(batches):
        walker, held, n = make(), [], 0

        def flush():
            ids, labels = (np.concatenate([h[k] for h in held]) for k in (0, 1))
            walker.walk(ids, labels, np.concatenate([h[2] for h in held]))

        for b in batches:
            for lo in range(0, b.num_rows, shard):
                s = b.slice(lo, shard)
                held.append((s.column(0).to_numpy(), s.column(1).to_numpy(), _matrix(s.column(2), dims)))
                n += s.num_rows
                if n >= shard:
                    flush()
                    held, n = [], 0
        if n:
            flush()
        for part in walker.rows():
            if len(part[0]):
                yield pa.RecordBatch.from_arrays([pa.array(p, type=pa.int64()) for p in part], ["anchor", "slot", "id", "score"])

    return rows.mapInArrow(run, "anchor long, slot long, id long, score long")


def _first(df: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), F.asc("id"))
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, is_anchor: Column, *, id_col: str = "vec_id", label_col: str = "label",
                   vector_col: str = "embedding", n_positives: int = 5, n_negatives: int = 5, low: int = 80,
                   high: int = 100, scale: int = 256, load_bytes: int = LOAD_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score): for every row with ``is_anchor`` (a condition on ``id``)
    and each of its ``n_positives`` best rows of the same label, the first
    ``n_negatives`` rows of another label with low * p <= 100 * s <= high * p."""
    spark = rows.sparkSession
    rows = integer_rows(rows, id_col, label_col, vector_col, scale)
    one = rows.filter(is_anchor).groupBy("id").agg(F.min(F.struct("label", "v")).alias("r"))
    anchors = cut_lineage(one.select("id", "r.label", "r.v"), "anchors")
    counts = {r["dims"]: r["count"] for r in anchors.groupBy(F.size("v").alias("dims")).count().collect()}    # one row per vector length
    parts = []
    for dims, count in sorted(counts.items()):
        same = rows.filter(F.size("v") == dims)
        grouped = cut_lineage(_clustered(anchors.filter(F.size("v") == dims), dims, count), "anchor-clusters")
        for load in _loads(grouped, dims, load_bytes):
            sent = spark.sparkContext.broadcast(load)              # <= LOAD_BYTES of vectors
            found = _scan(same, dims, lambda sent=sent: _Walker(sent.value, n_positives), shard_bytes)
            top, _ = stage(_first(found, n_positives).select("anchor", "id", "score", "rank"), "positives")
            held: dict = {}
            for r in top.orderBy("anchor", "rank").toLocalIterator():   # n_positives rows per anchor of the load
                held.setdefault(r["anchor"], []).append(r["score"])
            scores = spark.sparkContext.broadcast(held)
            near = _scan(same, dims, lambda sent=sent, scores=scores: _Walker(sent.value, n_negatives, scores.value, low, high), shard_bytes)
            positive = top.select("anchor", (F.col("rank") - 1).cast("long").alias("slot"), F.col("id").alias("positive_id"),
                                  F.col("score").alias("positive_score"))
            done = _first(near, n_negatives).join(positive, ["anchor", "slot"])
            parts.append(cut_lineage(done.select(
                F.col("anchor").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"),
                F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "negatives"))
    if not parts:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, "
                                         "positive_score long, negative_score long")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
