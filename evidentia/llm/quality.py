"""Quality classifier: a linear hinge-loss model on naive-Bayes-scaled n-gram
indicators (NB support vectors), trained by dual coordinate descent."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.words import blocks, byte_tables, fold, mix, words

BITS = 20                      # features are hashed into 2**BITS slots: the model is at most 4 MB
SAMPLE = 8192                  # labelled rows that the model is fitted on, at most
EPOCHS = 12
C = 1.0
SMOOTH = 1.0
BLEND = 0.9                    # share of the fitted weights; the rest is their mean magnitude
SCHEMA = "doc_id long, label int, features binary"


def features(w, bits: int = BITS):
    """(row, feature) of every distinct n-gram indicator of a block: words,
    word pairs, and one to three consecutive word shapes. A shape holds the
    length, the case, digits, the classes of both end bytes and whether the
    word repeats the one before."""
    n = len(w.hash)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = np.zeros(256, dtype=np.int64)            # 0 other ASCII, 1 lower, 2 upper, 3 digit, 4 non-ASCII
    kind[97:123], kind[65:91], kind[48:58], kind[128:] = 1, 2, 3, 4
    k = kind[w.data]
    length = w.end - w.start

    def share(which):
        total = np.concatenate([[0], np.cumsum(k == which)])
        return np.minimum(3, (4 * (total[w.end] - total[w.start])) // length)
    first, last = k[w.start], w.data[w.end - 1].astype(np.int64)
    last = np.where(k[w.end - 1] == 0, last, 200 + k[w.end - 1])
    again = np.zeros(n, dtype=np.int64)
    again[1:] = (w.hash[1:] == w.hash[:-1]) & (w.row[1:] == w.row[:-1])
    shape = np.minimum(length, 31)
    for part, size in ((first, 8), (last, 256), (share(2), 4), (share(3), 4), (share(0), 4), (again, 2)):
        shape = shape * size + part
    shape = mix(shape.astype(np.uint64) + np.uint64(0x51ED270B))
    coarse = mix(((share(2) * 4 + share(0)) * 2 + again).astype(np.uint64) + np.uint64(0x7F4A7C15))
    rows, found = [], []
    for seq, sizes, salt in ((w.hash, (1, 2), 1), (shape, (1, 2), 2), (coarse, (1, 3), 3)):
        for m in sizes:
            if n < m:
                continue
            at = np.flatnonzero(w.row[m - 1:] == w.row[:n - m + 1])
            rows.append(w.row[at])
            found.append(fold([seq[at + j] for j in range(m)], 16 * salt + m))
    key = (np.concatenate(rows) << bits) | (np.concatenate(found) & np.uint64((1 << bits) - 1)).astype(np.int64)
    key = np.unique(key)
    return key >> bits, key & ((1 << bits) - 1)


def _extract(bits: int):
    def run(batches):
        tables = byte_tables(True, False)
        for b in blocks(batches, "text"):
            row, f = features(words(b.column(2), tables), bits)
            ptr = np.searchsorted(row, np.arange(b.num_rows + 1))
            f = f.astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([f[ptr[i]:ptr[i + 1]].tobytes() for i in range(b.num_rows)], pa.binary())],
                names=["doc_id", "label", "features"])
    return run


def coordinate_descent(rows, ratio, y, cost, epochs: int, seed: int = 7):
    """min |w|^2 / 2 + sum cost_i max(0, 1 - y_i w.x_i) by dual coordinate
    descent. ``rows`` holds the feature indices of each example; its values
    are ``ratio`` there over the root of their number, and the last weight is
    that of a constant. Values are worked out when needed, not kept."""
    w = np.zeros(len(ratio) + 1)
    alpha = np.zeros(len(rows))
    scale = np.array([1.0 / np.sqrt(len(f) + 1.0) for f in rows])
    square = np.array([(float(ratio[f] @ ratio[f]) + 1.0) for f in rows]) * scale ** 2
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            f = rows[i]
            v = ratio[f]
            grad = y[i] * scale[i] * (float(w[f] @ v) + w[-1]) - 1.0
            new = min(max(alpha[i] - grad / square[i], 0.0), cost[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i] * scale[i]
                w[f] += step * v
                w[-1] += step
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-4:
            break
    return w


def _platt(margin, good):
    """Slope and offset of a logistic curve through held-back margins, with
    smoothed targets, by Newton steps."""
    pos, neg = good.sum(), (~good).sum()
    t = np.where(good, (pos + 1.0) / (pos + 2.0), 1.0 / (neg + 2.0))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1.0 / (1.0 + np.exp(-np.clip(a * margin + b, -35, 35)))
        d, h = p - t, np.maximum(p * (1 - p), 1e-9)
        ga, gb = (d * margin).sum() + 1e-3 * a, d.sum()
        haa, hab, hbb = (h * margin * margin).sum() + 1e-3, (h * margin).sum(), h.sum() + 1e-9
        det = haa * hbb - hab * hab
        sa, sb = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        a, b = a - sa, b - sb
        if abs(sa) + abs(sb) < 1e-9:
            break
    return a, b


def fit(sample, bits: int = BITS, epochs: int = EPOCHS):
    """Model from (label, feature indices) pairs in a fixed order: (weights
    per slot, slope, offset). A fifth of the sample calibrates the score.
    With one class only, the score is the smoothed share of label 1."""
    dims = 1 << bits
    y = np.array([1.0 if label else -1.0 for label, _ in sample])
    good = y > 0
    if not len(y) or good.all() or not good.any():
        share = (good.sum() + 1.0) / (len(y) + 2.0)
        return np.zeros(dims + 1, np.float32), 0.0, float(np.log(share / (1 - share)))
    count = {True: np.full(dims, SMOOTH), False: np.full(dims, SMOOTH)}
    held = np.arange(len(y)) % 5 == 4
    if good[~held].all() or not good[~held].any():
        held[:] = False
    for i in np.flatnonzero(~held):
        count[bool(good[i])][sample[i][1]] += 1
    ratio = np.log(count[True] / count[True].sum()) - np.log(count[False] / count[False].sum())
    rows = [f for _, f in sample]
    train = np.flatnonzero(~held)
    weight = {True: len(train) / (2.0 * good[train].sum()), False: len(train) / (2.0 * (~good[train]).sum())}
    w = coordinate_descent([rows[i] for i in train], ratio, y[train],
                           np.array([C * weight[bool(good[i])] for i in train]), epochs)
    mean = np.abs(w).sum() / (dims + 1)
    w = BLEND * w + (1 - BLEND) * mean * np.sign(w)
    check = np.flatnonzero(held) if held.any() and good[held].any() and not good[held].all() else train
    margin = np.array([(float(w[rows[i]] @ ratio[rows[i]]) + w[-1]) / np.sqrt(len(rows[i]) + 1.0) for i in check])
    slope, offset = _platt(margin, good[check])
    return (w * np.append(ratio, 1.0)).astype(np.float32), float(slope), float(offset)


def _score(model, bits: int):
    def run(batches):
        weights, slope, offset = model.value
        tables = byte_tables(True, False)
        for b in blocks(batches, "text"):
            row, f = features(words(b.column(1), tables), bits)
            n = np.bincount(row, minlength=b.num_rows) + 1
            margin = (np.bincount(row, weights[f].astype(float), minlength=b.num_rows) + weights[-1]) / np.sqrt(n)
            p = 1.0 / (1.0 + np.exp(-np.clip(slope * margin + offset, -35, 35)))
            rest = [b.column(i) for i in range(b.num_columns) if i != 1]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(p)], names=[*[b.schema.names[i] for i in range(b.num_columns) if i != 1], "score"])
    return run


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality", sample: int = SAMPLE, bits: int = BITS):
    """Broadcast model from labelled rows (``labels``: id, label 0 or 1). At
    most ``sample`` of them, those of the smallest id hashes, are used, so
    the model and the labelled texts gathered on the driver are bounded.
    Null or other labels and ids without a text are ignored; of repeated
    labels of an id the smallest counts."""
    spark = docs.sparkSession
    wanted = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(
        F.col(id_col).cast("long").alias("l_id")).agg(F.min(F.col(label_col)).cast("int").alias("label"))
    wanted = wanted.orderBy(F.xxhash64("l_id"), "l_id").limit(sample)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(
        F.broadcast(wanted), F.col("doc_id") == F.col("l_id")).select("doc_id", "label", "text")   # at most ``sample`` ids
    got = rows.mapInArrow(_extract(bits), SCHEMA).toArrow().sort_by([("doc_id", "ascending"), ("features", "ascending")])
    order = np.argsort(mix(got.column("doc_id").to_numpy().astype(np.uint64)), kind="stable")
    label, feats = got.column("label").to_pylist(), got.column("features")
    pairs = [(label[i], np.frombuffer(feats[int(i)].as_buffer(), np.int32)) for i in order]
    return spark.sparkContext.broadcast(fit(pairs, bits))


def score(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """doc_id and score (0 to 1, higher: label 1 likelier) of every row, from
    its whole text alone. Null and empty texts get the model's constant."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return src.mapInArrow(_score(model, bits), "doc_id long, score double")


def reject(docs: DataFrame, model, below: float, text_col: str = "text", bits: int = BITS) -> DataFrame:
    """Rows of ``docs`` whose score is not under ``below``, with all their
    columns, in one pass."""
    import pyarrow.compute as pc
    cols = docs.columns
    at = cols.index(text_col)

    def run(batches):
        for b in batches:
            one = pa.RecordBatch.from_arrays([pa.array(np.arange(b.num_rows)), b.column(at)], names=["row", "text"])
            for s in _score(model, bits)([one]):
                keep = s.filter(pc.greater_equal(s.column(1), below)).column(0)
                yield b.take(keep)
    return docs.select(cols).mapInArrow(run, docs.schema)
