"""The corpus pipeline and the registered queries on small tables."""

import os
import random

import pytest

import __spark_entry__ as ENTRY
import corpus_pipeline as P
from evidentia.llm import queries as QU
from evidentia.session import cut_lineage, read_table
from tests.conftest import SF_SMALL
from tests.llm import brute as B

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Clean texts, junk, exact and near copies, benchmark passages, nulls."""
    rng = random.Random(9)
    vocab = ["w%d" % i for i in range(600)]
    clean = lambda n: " ".join(rng.choice(vocab) for _ in range(n)) + "."
    items = [(i, clean(30)) for i in range(6)]
    rows = []
    for i in range(160):
        kind = i % 8
        if kind == 1 and i > 8:
            t = rows[i - 1][1].replace(" ", "  ", 1)                       # exact copy but for white space
        elif kind == 2 and i > 8:
            t = rows[i - 2][1] + " extra"                                   # near copy
        elif kind == 3:
            t = " ".join([rng.choice(["SPAM!!", "BUY!!", "NOW!!"])] * rng.randint(20, 60))
        elif kind == 4:
            t = clean(40) + " " + rng.choice(items)[1] + " " + clean(40)    # holds a passage
        else:
            t = clean(rng.randint(30, 90))
        rows.append((i, t, "en", "s%d" % (i % 5), len(t)))
    rows += [(200, None, None, None, None), (201, "", "en", "s1", 0)]
    d = str(tmp_path_factory.mktemp("pipe"))
    spark.createDataFrame(rows, DOCS).write.parquet(os.path.join(d, "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(os.path.join(d, "benchmark.parquet"))
    labels = [(i, int(i % 8 != 3), 0) for i in range(120)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(os.path.join(d, "labels.parquet"))
    return d, items


def test_stages_against_plain_versions(spark, tables):
    d, items = tables
    assert [n for n, _ in P.STAGES] == ["quality", "exact_dedup", "near_dedup", "decontaminate", "mix"]
    docs = read_table(spark, d, "documents")
    stages = dict(P.STAGES)

    def step(name, df):
        out = stages[name](spark, df, d)
        if name != "mix":
            assert out.columns == docs.columns
        out = cut_lineage(out, "test")
        return out, {r.doc_id: r.text for r in out.collect()}
    before = {r.doc_id: r.text for r in docs.collect()}
    kept, rows = step("quality", docs)
    assert all(i in rows for i in before if i < 160 and i % 8 != 3) and not any(i in rows for i in range(160) if i % 8 == 3)

    first = {}
    for i in sorted(rows):
        first.setdefault(" ".join((rows[i] or "").split()), i)
    kept, exact = step("exact_dedup", kept)
    assert set(exact) == set(first.values())

    comp = B.similar(list(exact.items()))
    kept, near = step("near_dedup", kept)
    assert set(near) == {c for _, c in comp.values()} and len(near) < len(exact) < len(rows) < len(before)

    bad = {i for i, n, hit, _ in B.hits(list(near.items()), items) if hit and 20 * hit >= n}
    kept, clean = step("decontaminate", kept)
    assert bad and set(clean) == set(near) - bad

    mixed = stages["mix"](spark, kept, d).collect()
    sizes, per_doc = {}, {}
    for r in kept.collect():
        sizes[r.source] = sizes.get(r.source, 0) + len(B.SPACE_WORD.findall(r.text or ""))
    target = B.targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in mixed:
        taken[r.source] += len(B.SPACE_WORD.findall(r.text or ""))
        per_doc[r.doc_id] = per_doc.get(r.doc_id, 0) + 1
    assert set(per_doc) <= set(clean) and max(per_doc.values()) <= 3
    assert all(abs(taken[s] - target[s]) <= max(10, 0.03 * target[s]) for s in sizes)
    run = P.run(spark, d).collect()
    assert sorted(map(str, run)) == sorted(map(str, mixed))


def test_pipeline_over_empty_tables(spark, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([], DOCS).write.parquet(os.path.join(d, "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(os.path.join(d, "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(os.path.join(d, "labels.parquet"))
    assert P.run(spark, d).collect() == []


def test_every_operator_is_registered():
    names = set(ENTRY.queries())
    assert {int(n[2:].split("_")[0]) for n in names if n.startswith("op") and n[2].isdigit()} == set(range(1, 14))
    assert "pipeline" in names and set(QU.ORACLE) <= set(QU.QUERIES) <= names


def test_quality_query_on_held_out_labels(spark):
    got = QU.QUERIES["op4_quality"](spark, SF_SMALL)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    lab = {r.doc_id: r.quality for r in read_table(spark, SF_SMALL, "labels").collect()}
    rows = [r for r in got.collect() if r.held_out and r.doc_id in lab]
    assert len(rows) >= 10 and sum(r.predicted == lab[r.doc_id] for r in rows) >= 0.9 * len(rows)


def test_substring_query_against_plain_version(spark):
    rows = [(r.doc_id, r.text) for r in read_table(spark, SF_SMALL, "documents").collect()]
    got = sorted(map(tuple, QU.QUERIES["op7_substring_dedup"](spark, SF_SMALL).collect()))
    assert got == sorted(B.repeated(rows)) and sum(r[2] for r in got) > 0
