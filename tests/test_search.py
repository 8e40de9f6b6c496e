"""Vector search: exact against numpy brute force; no score cut-off (E6);
null / wrong-length / zero-norm vectors excluded and counted (E7); the
inverted-list search equals brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.operators.ivf import ivf_knn, recall
from evidentia.operators.search import knn, search_one, vector_health


def brute(Q, D, ids, k):
    Qn = Q / np.linalg.norm(Q, axis=1, keepdims=True)
    Dn = D / np.linalg.norm(D, axis=1, keepdims=True)
    dist = np.round(1 - Qn @ Dn.T, 9)
    out = {}
    for i in range(len(Q)):
        order = sorted(range(len(D)), key=lambda j: (dist[i, j], ids[j]))
        out[i] = [ids[j] for j in order[:k]]
    return out


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    D = rng.normal(size=(300, 8))
    D[10] = D[11]                                    # exact copies tie; id breaks it
    Q = rng.normal(size=(20, 8))
    ids = [f"d{j}" for j in range(len(D))]
    corpus = spark.createDataFrame([(ids[j], D[j].tolist()) for j in range(len(D))],
                                   "paper_id string, embedding array<double>").repartition(5)
    queries = spark.createDataFrame([(i, Q[i].tolist()) for i in range(len(Q))], "qid long, embedding array<double>")
    return Q, D, ids, corpus, queries


def test_knn_matches_brute_force(spark, data):
    Q, D, ids, corpus, queries = data
    want = brute(Q, D, ids, 5)
    got = {}
    for r in knn(queries, corpus, 5).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append(r.paper_id)
    assert got == want


def test_large_query_side_goes_distributed(spark, data):
    Q, D, ids, corpus, queries = data
    a = knn(queries, corpus, 5).select("qid", "rank", "paper_id").collect()
    b = knn(queries, corpus, 5, max_block_bytes=8 * 8 * 3).select("qid", "rank", "paper_id").collect()
    assert sorted(a) == sorted(b)


def test_blocks_of_queries_shuffle_no_corpus_row(spark, data, monkeypatch):  # J1, W1
    """Each block is one scan without a shuffle; with few task groups the two merges give the same hits."""
    from evidentia.operators import search as SE
    Q, D, ids, corpus, queries = data
    plans, scan = [], SE._search_block

    def seen(*a, **kw):
        out = scan(*a, **kw)
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out
    monkeypatch.setattr(SE, "_search_block", seen)
    monkeypatch.setattr(SE, "TASK_GROUPS", 2)
    got = {}
    for r in knn(queries, corpus.repartition(7), 5, max_block_bytes=8 * 8 * 5).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append(r.paper_id)
    assert got == brute(Q, D, ids, 5) and len(plans) == 4
    monkeypatch.undo()
    from evidentia.session import cut_lineage
    one = SE._search_block(queries, cut_lineage(corpus), 5, "qid", "embedding", "paper_id", "embedding", 8)
    assert "Exchange" not in one._jdf.queryExecution().executedPlan().toString()


def test_k_rows_however_far(spark, data):  # E6
    Q, D, ids, corpus, queries = data
    far = spark.createDataFrame([(0, (-D[0]).tolist())], "qid long, embedding array<double>")
    assert knn(far, corpus, 7).count() == 7


def test_bad_vectors_excluded_and_counted(spark):  # E7
    rows = [("a", [1.0, 0.0]), ("b", None), ("c", [0.0, 0.0]), ("d", [1.0, 2.0, 3.0]), ("e", [0.0, 1.0])]
    corpus = spark.createDataFrame(rows, "paper_id string, embedding array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.1])], "qid long, embedding array<double>")
    assert [r.paper_id for r in knn(q, corpus, 5).orderBy("rank").collect()] == ["a", "e"]
    h = vector_health(corpus, dims=2).first()
    assert (h.total, h.null_vectors, h.wrong_length, h.zero_norm) == (5, 1, 1, 1)


def test_search_one(spark, data):
    Q, D, ids, corpus, queries = data
    one = spark.createDataFrame([(Q[3].tolist(),)], "embedding array<double>")
    assert [r.paper_id for r in search_one(one, corpus, 5).orderBy("rank").collect()] == brute(Q, D, ids, 5)[3]


@pytest.mark.parametrize("max_members,max_queries", [(20000, 2000), (7, 3)])
def test_ivf_over_all_lists_is_exact(spark, data, max_members, max_queries):
    """Looking into every list is exact, also with lists cut into tiny cells."""
    Q, D, ids, corpus, queries = data
    got = {}
    res = ivf_knn(queries, corpus, 5, nlists=6, nprobe=6, max_members=max_members, max_queries=max_queries)
    for r in res.orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append(r.paper_id)
    assert got == brute(Q, D, ids, 5)


def test_ivf_approximate_mode_reports_its_recall(spark, data):
    Q, D, ids, corpus, queries = data
    exact = knn(queries, corpus, 5)
    few = recall(ivf_knn(queries, corpus, 5, nlists=6, nprobe=1), exact).first()
    most = recall(ivf_knn(queries, corpus, 5, nlists=6, nprobe=5), exact).first()
    assert few.expected == 100 and 0 < few.recall <= most.recall <= 1.0 and most.recall >= 0.9


def test_ivf_recall_holds_on_many_lists(spark):
    from evidentia.queries import ivf_recall
    got = ivf_recall(spark, "/root/testdata/sf0.1").first()
    assert got.expected == 10000 and 0.9 <= got.recall <= 1.0
    assert got.exact_share <= 0.2


def test_recall_runs_the_exact_search_once(spark):
    """Its hits are counted and joined; the search behind them is not run for each (F2)."""
    ran = spark.sparkContext.accumulator(0)

    def search(parts):
        for p in parts:
            ran.add(len(p))
            yield p
    exact = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "qid long, paper_id string").coalesce(1).mapInPandas(
        search, "qid long, paper_id string")
    got = recall(spark.createDataFrame([(1, "a"), (2, "a"), (2, "c")], "qid long, paper_id string"), exact).first()
    assert (got.expected, got.found, round(got.recall, 4)) == (3, 2, 0.6667) and ran.value == 3


BAD = [("a", [1.0, 0.0]), ("b", None), ("c", [0.0, 0.0]), ("d", [1.0, 2.0, 3.0]), ("e", [0.0, 1.0]),
       ("f", [float("nan"), 1.0]), ("g", [float("inf"), 1.0])]


@pytest.mark.parametrize("bound", [1 << 20, 0])
def test_both_paths_follow_the_same_rules(spark, bound):
    """Wrong length, NaN, infinite, zero and null vectors on either side; ids as strings."""
    corpus = spark.createDataFrame(BAD, "paper_id string, embedding array<double>")
    q = spark.createDataFrame([("A1", [1.0, 0.1]), ("P1", [float("nan"), 0.0]), ("U1", None), ("Z", [0.0, 0.0])],
                              "qid string, embedding array<double>")
    got = [(r.qid, r.rank, r.paper_id) for r in knn(q, corpus, 5, max_block_bytes=bound).orderBy("qid", "rank").collect()]
    assert got == [("A1", 1, "a"), ("A1", 2, "e")]
    mixed = spark.createDataFrame([(1, [1.0, 0.1]), (2, [1.0])], "qid long, embedding array<double>")
    with pytest.raises(ValueError, match="different lengths"):
        knn(mixed, corpus, 5, max_block_bytes=bound)
    none = spark.createDataFrame([], "qid long, embedding array<double>")
    assert knn(none, corpus, 5, max_block_bytes=bound).collect() == []
    assert knn(q, corpus.limit(0), 5, max_block_bytes=bound).collect() == []


def test_search_one_takes_one_query(spark, data):
    from evidentia.operators.search import OneQueryError
    Q, D, ids, corpus, queries = data
    with pytest.raises(OneQueryError):
        search_one(queries.limit(2), corpus, 5)
    with pytest.raises(OneQueryError):
        search_one(queries.limit(0), corpus, 5)


def test_mixed_embedders_refused(spark):  # E23
    from evidentia.operators.search import MixedEmbeddersError
    c = spark.createDataFrame([("a", [1.0, 0.0], "m1"), ("b", [0.0, 1.0], "m2")],
                              "paper_id string, embedding array<double>, embedder string")
    q = spark.createDataFrame([(1, [1.0, 0.0], "m1")], "qid long, embedding array<double>, embedder string")
    with pytest.raises(MixedEmbeddersError):
        knn(q, c, 1)
    assert knn(q, c.filter("embedder = 'm1'"), 1).first().paper_id == "a"


def test_merge_topk_is_exact_over_chunks():
    from evidentia.operators.search import _merge_topk
    rng = np.random.default_rng(5)
    parts = []
    for _ in range(6):
        qi = rng.integers(0, 4, 30)
        ids = np.array([f"p{rng.integers(0, 50)}" for _ in range(30)], dtype=object)
        d = np.round(rng.random(30), 2)
        parts.append((qi, ids, d, d))
    once = _merge_topk(parts, 3)
    folded = _merge_topk([_merge_topk(parts[:3], 3), _merge_topk(parts[3:], 3)], 3)
    for a, b in zip(once, folded):
        assert list(a) == list(b)
    for q in range(4):                       # exactly the 3 best (distance, id) per query
        rows = sorted((d, p) for qq, p, d, _ in zip(*[np.concatenate([x[i] for x in parts]) for i in range(4)]) if qq == q)
        got = [(d, p) for qq, p, d, _ in zip(*once) if qq == q]
        assert got == rows[:3]


def test_search_question_text(spark):  # J2 from text, P6
    from evidentia.plans.answering import search_question
    from evidentia.sources.corpus import hashed_corpus, paper_texts
    from tests.conftest import SF_SMALL
    from evidentia.session import read_table
    doc = read_table(spark, SF_SMALL, "documents").orderBy("doc_id").first()
    res = search_question(spark, doc.text, hashed_corpus(spark, SF_SMALL).select("paper_id", "embedding"),
                          paper_texts(spark, SF_SMALL), 3).collect()
    assert [r.rank for r in res] == [1, 2, 3]
    assert res[0].score == 1.0 and res[0].title is not None       # a text finds itself (or an exact copy) first
    assert all(res[i].score >= res[i + 1].score for i in range(2))
