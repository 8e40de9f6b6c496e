"""The kernel of all exact searches, and that no pair or row is copied for it."""

import numpy as np
from pyspark.sql import functions as F

from evidentia.operators import grid as GR
from evidentia.operators import search as SE
from evidentia.operators.ivf import build_index, list_topk
from evidentia.operators.search import knn
from tests.test_pq_index import hits
from tests.test_search import brute, data  # noqa: F401


def test_best_of_streamed_rows_and_few_compared(monkeypatch):
    """Rows in any batches, copies and ties included, give the k best; few pairs are compared exactly."""
    rng = np.random.default_rng(11)
    Q, D = rng.normal(size=(40, 6)), rng.normal(size=(9000, 6))
    D[3000:3400] = D[5]                              # many copies: the ids settle them
    Q[0] = D[5]
    ids = np.array([f"p{i}" for i in rng.permutation(9000)], dtype=object)
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    asked, merge = [], GR.merge_topk
    monkeypatch.setattr(GR, "merge_topk", lambda parts, k: asked.append(len(parts[1][0])) or merge(parts, k))
    best = GR.Nearest(unit(Q), 5, rows=700, queries=16)
    for lo in range(0, 9000, 2500):
        best.add(ids[lo:lo + 2500], unit(D[lo:lo + 2500]))
    got = {}
    for qi, pid, dist, key in best.best(step=7):
        for a, p in zip(qi, pid):
            got.setdefault(int(a), []).append(p)
    assert got == brute(Q, D, list(ids), 5)
    assert sum(asked) < 40 * 9000 / 50


def test_many_queries_scan_in_as_many_tasks_as_cores(spark, data, monkeypatch):  # noqa: F811  F5, F10
    Q, D, ids, corpus, queries = data
    wide = corpus.repartition(16)
    monkeypatch.setattr(SE, "MANY_HITS", 10)
    scan = SE._search_block(queries, wide, 5, "qid", "embedding", "paper_id", "embedding", 8)
    assert scan.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    assert hits(knn(queries, wide, 5)) == [(i, r + 1, p) for i, ps in brute(Q, D, ids, 5).items() for r, p in enumerate(ps)]


def test_lists_copy_no_row(spark, data):  # noqa: F811  F7
    """A row meets the queries of its list where it lies; blocks of queries give the same hits."""
    Q, D, ids, corpus, queries = data
    index = build_index(corpus, 6)
    q = queries.withColumnRenamed("embedding", "qv")
    for nprobe in (2, 6):
        one = list_topk(q, 20, index, 5, nprobe)
        plan = one._jdf.queryExecution().executedPlan().toString()
        assert "CoGroup" not in plan and "Generate" not in plan
        assert hits(one) == hits(list_topk(q, 20, index, 5, nprobe, max_block_bytes=500))
        near = {r.qid: set(r.near) for r in q.select("qid", F.col("qv")).mapInArrow(
            _near(spark, index, nprobe), "qid long, qv array<double>, near array<int>").collect()}
        lists = {r.paper_id: r.list_id for r in index.rows.collect()}
        for i, ps in brute(Q, D, ids, 300).items():
            assert [h[2] for h in hits(one) if h[0] == i] == [p for p in ps if lists[p] in near[i]][:5]


def _near(spark, index, nprobe):
    import pyarrow as pa
    from evidentia.operators.ivf import _nearest_fn
    return _nearest_fn(spark.sparkContext.broadcast(index.centroids), index.dims, nprobe, pa.string(), ["qid", "qv", "near"])
