"""Upsert, clear and ingest rules."""

import datetime as dt
import os
import re
import uuid

import pytest
from pyspark.sql import functions as F

from evidentia.operators import corpus as CO
from evidentia.schemas import PAPERS
from evidentia.session import checkpoint_dir


def rows(spark, ids, text, ts):
    d = dt.date(2024, 1, 1)
    return spark.createDataFrame([(i, f"t{i}", "a", d, f"{text}{i}", f"https://u/{i}", [1.0, 0.0], ts) for i in ids],
                                 PAPERS)


def new_table(spark):
    return os.path.join(checkpoint_dir(spark), f"corpus-{uuid.uuid4().hex}")


def test_upsert_merge_semantics_and_idempotence(spark):
    path = new_table(spark)
    t1, t2 = dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 1)
    assert CO.upsert_table(spark, path, rows(spark, ["1", "2", "3"], "old", t1)) == 3
    src = rows(spark, ["2", "4"], "new", t2)
    assert CO.upsert_table(spark, path, src) == 2
    first = sorted((r.id, r.abstract, r.ingested_at) for r in CO.read_table_at(spark, path).collect())
    assert first == [("1", "old1", t1), ("2", "new2", t2), ("3", "old3", t1), ("4", "new4", t2)]   # E3
    CO.upsert_table(spark, path, src)                                        # replay: no change
    again = sorted((r.id, r.abstract, r.ingested_at) for r in CO.read_table_at(spark, path).collect())
    assert again == first


def test_duplicate_source_keys_rejected(spark):  # E2
    src = rows(spark, ["1", "1"], "x", dt.datetime(2024, 1, 1))
    with pytest.raises(CO.DuplicateKeyError):
        CO.upsert_table(spark, new_table(spark), src)


def test_upsert_counts(spark):  # S6
    t = rows(spark, ["1", "2", "3"], "a", dt.datetime(2024, 1, 1))
    s = rows(spark, ["3", "4"], "b", dt.datetime(2024, 1, 1))
    c = CO.upsert_counts(t, s).first()
    assert (c.updated, c.inserted, c.untouched, c.affected) == (1, 1, 2, 2)


def test_clear_keeps_schema_then_ingest(spark):  # S7, E5
    path = new_table(spark)
    CO.upsert_table(spark, path, rows(spark, ["1", "2"], "a", dt.datetime(2024, 1, 1)))
    assert CO.clear_table(spark, path) == 2
    df = CO.read_table_at(spark, path)
    assert df.count() == 0 and set(PAPERS.fieldNames()) <= set(df.columns)
    CO.upsert_table(spark, path, rows(spark, ["9"], "z", dt.datetime(2024, 1, 1)))
    assert CO.read_table_at(spark, path).count() == 1


def test_null_check_and_empty_summary(spark):  # S9, S11, E4
    df = spark.createDataFrame([("1", None), (None, "x")], "id string, title string")
    v = CO.null_violations(df, ["id", "title"]).first()
    assert (v.null_id, v.null_title, v.violations) == (1, 1, 2)
    empty = spark.createDataFrame([], "id string, n_tokens long")
    counts = spark.createDataFrame([(0, 0, 5, 0)], "updated long, inserted long, untouched long, affected long")
    s = CO.ingest_summary(empty, counts, spark.createDataFrame([("1",)], "id string")).first()
    assert (s.fetched, s.affected, s.total_rows, s.tokens, s.cost_usd) == (0, 0, None, 0, 0.0)


def test_limit_bounds():  # P10
    assert CO.check_limit(1) == 1 and CO.check_limit(2000) == 2000
    for bad in (0, 2001, -1):
        with pytest.raises(ValueError):
            CO.check_limit(bad)


def test_topic_predicate_default(spark):  # P1, P2
    df = spark.createDataFrame([("cs.SE", "Prompt  Engineering for CODE"), ("cs.SE", "prompt engineering only"),
                                ("q-bio", "prompt engineering code"), ("cs.AI", "LLM-generated code is ...")],
                               "categories string, abstract string")
    assert [r.categories for r in CO.topic_filter(df).collect()] == ["cs.SE", "cs.AI"]
    assert CO.topic_filter(df, "categories = 'q-bio'").count() == 1


def test_newest(spark):  # T3, T4
    df = spark.createDataFrame([(str(i), dt.date(2024, 1, 1 + i % 3)) for i in range(10)],
                               "id string, published_date date")
    top = [r.id for r in CO.newest(df, 4).collect()]
    assert top == ["2", "5", "8", "1"]
    assert [r.id for r in CO.newest(df, 2, start=2).collect()] == ["8", "1"]


def test_read_ids_prunes_buckets(spark):  # P3 on the stored table
    path = new_table(spark)
    CO.upsert_table(spark, path, rows(spark, [str(i) for i in range(50)], "a", dt.datetime(2024, 1, 1)))
    ids = spark.createDataFrame([("3",), ("3",), ("17",), ("missing",)], "id string")
    got = CO.read_ids(spark, path, ids, ids_rows_bound=4)
    assert sorted(r.id for r in got.collect()) == ["17", "3"]            # duplicates and unknown ids vanish
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan), plan


def test_required_columns_enforced(spark):  # S9
    bad = rows(spark, ["1"], "a", dt.datetime(2024, 1, 1)).withColumn("title", F.lit(None).cast("string"))
    with pytest.raises(CO.RequiredColumnError):
        CO.upsert_table(spark, new_table(spark), bad)


def test_topic_array_categories(spark):  # P1
    df = spark.createDataFrame([(["q-bio", "cs.SE"], "prompt engineering and code"), (["q-bio"], "prompt engineering code")],
                               "categories array<string>, abstract string")
    assert CO.topic_filter(df).count() == 1


def test_question_source_and_cleanup(spark):  # S3, P9
    import json
    from evidentia.sources.questions import clean_questions, read_questions
    path = os.path.join(checkpoint_dir(spark), f"q-{uuid.uuid4().hex}.jsonl")
    with open(path, "w") as f:
        for row in [{"qid": "A1", "question": "  What is x? \n", "expected_status": "answerable", "notes": "n"},
                    {"qid": "U1", "question": "\t\n", "expected_status": "unanswerable"},
                    {"qid": "P1", "question": "Why?", "expected_status": "partial", "extra": 1}]:
            f.write(json.dumps(row) + "\n")
    q = read_questions(spark, path)
    assert q.columns == ["qid", "question", "expected_status", "notes"]
    got = {r.qid: r.question for r in clean_questions(q).collect()}
    assert got == {"A1": "What is x?", "P1": "Why?"}


def test_question_file_with_string_ids_through_answer_and_evaluation(spark):  # S3, M7
    import json
    from evidentia.plans.answering import answer, evaluate
    from evidentia.sources.corpus import hashed_corpus, paper_texts
    from evidentia.sources.questions import clean_questions, read_questions
    from evidentia.session import read_table
    from tests.conftest import SF_SMALL
    doc = read_table(spark, SF_SMALL, "documents").filter("length(text) > 500").orderBy("doc_id").first()
    path = os.path.join(checkpoint_dir(spark), f"q-{uuid.uuid4().hex}.jsonl")
    with open(path, "w") as f:
        for qid, text, status in [("A1", doc.text[:400], "answerable"), ("U1", "zzz qqq xxx vvv?", "unanswerable")]:
            f.write(json.dumps({"qid": qid, "question": text, "expected_status": status, "notes": ""}) + "\n")
    a = answer(clean_questions(read_questions(spark, path)), hashed_corpus(spark, SF_SMALL).select("paper_id", "embedding"),
               paper_texts(spark, SF_SMALL))
    counts = {r.qid: r.claim_count for r in a.counts.collect()}
    assert set(counts) == {"A1", "U1"} and counts["A1"] > 0 and counts["U1"] == 0
    got = {r.qid: r.answerability_match for r in evaluate(a).results.collect()}
    assert got == {"A1": True, "U1": True}


def test_retrieve_by_ids(spark):  # P3, P4, F6 single-request form
    from evidentia.operators.retrieve import retrieve_ids
    papers = spark.createDataFrame([("a", "A", "x", dt.date(2024, 1, 2), "text a", "u/a", [1.0]),
                                    ("b", "B", "y", dt.date(2024, 1, 3), "text b", "u/b", [2.0])],
                                   "paper_id string, title string, authors string, published_date date, "
                                   "abstract string, url string, embedding array<double>")
    ids = spark.createDataFrame([("a",), ("a",), ("zz",)], "paper_id string")
    rows = retrieve_ids(ids, papers, ids_rows_bound=3).collect()
    assert [(r.paper_id, r.published_date) for r in rows] == [("a", "2024-01-02")]
    assert "embedding" not in rows[0].asDict()


def test_failed_read_never_empties_the_table(spark, monkeypatch):  # S9
    path = new_table(spark)
    CO.upsert_table(spark, path, rows(spark, [str(i) for i in range(50)], "a", dt.datetime(2024, 1, 1)))
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "static")
    try:
        with monkeypatch.context() as m:
            m.setattr(CO, "read_commit", lambda *a: (_ for _ in ()).throw(OSError("store is away")))
            with pytest.raises(OSError):
                CO.upsert_table(spark, path, rows(spark, ["1"], "b", dt.datetime(2024, 1, 2)))
        assert CO.read_table_at(spark, path).count() == 50
        CO.create_table_if_absent(spark, path)
        assert CO.read_table_at(spark, path).count() == 50
        CO.upsert_table(spark, path, rows(spark, ["1", "x"], "b", dt.datetime(2024, 1, 2)))     # any session mode
        assert CO.read_table_at(spark, path).count() == 51
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")


def test_bucket_count_is_kept_with_the_table(spark):  # S5, P3
    path = new_table(spark)
    t = dt.datetime(2024, 1, 1)
    CO.upsert_table(spark, path, rows(spark, [str(i) for i in range(200)], "a", t), buckets=8)
    assert CO.table_buckets(spark, path) == 8
    ids = spark.createDataFrame([(str(i),) for i in range(5)], "id string")
    assert CO.read_ids(spark, path, ids).count() == 5
    CO.upsert_table(spark, path, rows(spark, [str(i) for i in range(5)], "b", t))
    got = CO.read_table_at(spark, path)
    assert got.count() == 200 == got.select("id").distinct().count()
    with pytest.raises(CO.BucketCountError):
        CO.upsert_table(spark, path, rows(spark, ["1"], "b", t), buckets=16)
    assert CO.clear_counts(spark, path).first().asDict() == {"rows_before": 200, "deleted_rows": 200, "rows_after": 0}
    assert CO.table_buckets(spark, path) == 8
    assert CO.buckets_for(10) == 64 and CO.buckets_for(10 ** 9) == 500


def test_upsert_removes_its_staging(spark):  # S4
    held = checkpoint_dir(spark).replace("file:", "")
    staged = lambda: [d for d in os.listdir(held) if d.startswith(("staging-", "merged-"))]
    before = staged()
    CO.upsert_table(spark, new_table(spark), rows(spark, ["1", "2"], "a", dt.datetime(2024, 1, 1)))
    assert staged() == before


def test_checkpoint_folder_must_be_shared_on_a_cluster(spark, monkeypatch):
    from evidentia import session as SE

    class Conf:
        def get(self, *a):
            return None

    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()
    with pytest.raises(SE.NoSharedFolderError):
        SE.checkpoint_dir(Session())
