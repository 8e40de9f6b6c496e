"""The hashed embedder counts bounded slices and makes the buckets once."""

import numpy as np

from evidentia.functions import embed as EM


def test_slices_are_bounded_and_whole(monkeypatch):
    monkeypatch.setattr(EM, "SLICE_ROWS", 3)
    monkeypatch.setattr(EM, "SLICE_BUCKETS", 10)
    lens = np.array([1, 1, 1, 1, 9, 2, 40, 1, 10])
    got = list(EM._slices(lens))
    assert [x for lo, hi in got for x in range(lo, hi)] == list(range(len(lens)))
    assert all(hi - lo <= 3 and (hi - lo == 1 or lens[lo:hi].sum() <= 10) for lo, hi in got)
    assert list(EM._slices(lens[:0])) == []


def test_many_texts_of_a_batch(spark):
    """More rows than a slice holds, null and empty texts between them; no filter repeats the tokens."""
    texts = [None if i % 5 == 0 else "" if i % 7 == 0 else " ".join(f"w{j}" for j in range(i % 11 + 1)) for i in range(1500)]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string").coalesce(1)
    out = EM.hashed_tf(df, "i", "t")
    assert out._jdf.queryExecution().optimizedPlan().toString().count("md5") == 1
    got = {r.i: r for r in out.collect()}
    assert sorted(got) == [i for i, t in enumerate(texts) if t]
    for i, r in got.items():
        assert r.n_tokens == len(texts[i].split()) and abs(sum(x * x for x in r.embedding) - 1) < 1e-9
        assert r.nnz == sum(x > 0 for x in r.embedding) and len(r.embedding) == 256
