"""The ledger of paid calls and the pace of a job (M1-M5)."""

import os
import sys
import time
import uuid
from collections import Counter

import pandas as pd
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from evidentia.operators import ledger as LG
from evidentia.operators.models import (CallPolicy, EVALUATION_POLICY, INGEST_POLICY, Pace, claims_from, embed_with,
                                        map_model, verdicts_from)
from evidentia.session import checkpoint_dir, path_exists

# tasks get the helpers of this file with the functions that use them
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def folder(spark, name):
    d = os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")
    os.makedirs(d.replace("file:", ""))
    return d.replace("file:", "")


def noted(log, line):
    """One line appended in one write: calls of all tasks end up in one file."""
    fd = os.open(log, os.O_WRONLY | os.O_APPEND | os.O_CREAT)
    os.write(fd, (line + "\n").encode())
    os.close(fd)


def lines(log):
    return open(log).read().split("\n")[:-1] if os.path.exists(log) else []


def embedder(log, fail_at=None, die=False):
    def embed(texts, task):
        n = len(lines(log))
        for t in texts:
            noted(log, t)
        if fail_at is not None and n >= fail_at:
            if die:
                os.kill(os.getpid(), 9)              # the worker is gone, as with a lost executor
            raise RuntimeError("the service is down")
        return [[float(len(t))] for t in texts], [len(t) for t in texts]
    return embed


def docs(spark, n=40):
    rows = [(i, f"text {i % (n - 10)} " + "x" * (i % 3)) for i in range(n)] + [(900, None), (901, "")]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(5)


def vectors(df):
    return {int(r.doc_id): (list(r.embedding), r.n_tokens) for r in df.collect()}


@pytest.mark.parametrize("die", [False, True])
def test_a_job_that_stops_midway_calls_no_input_twice(spark, die):
    base, df = folder(spark, "ledger"), docs(spark)
    log, ledger = os.path.join(base, "log"), LG.Ledger(os.path.join(base, "led"), "embed", "m1")
    with pytest.raises(Exception):
        embed_with(df, "doc_id", "text", embedder(log, 7, die), batch_size=1, ledger=ledger).count()
    held = {r.call for r in LG.calls(spark, ledger.path).collect()}
    first = Counter(lines(log))
    # the calls that were under way (one per task at most) have no answer; all others have
    assert held and len(first) - len(held) <= 4
    got = vectors(embed_with(df, "doc_id", "text", embedder(log), batch_size=1, ledger=ledger))
    texts = {r.doc_id: r.text for r in df.collect() if r.text is not None}
    assert got == {i: ([float(len(t))], len(t)) for i, t in texts.items()}
    calls = Counter(lines(log))
    assert set(calls) == set(texts.values())
    assert sum(calls.values()) <= len(calls) + len(first) - len(held)
    again = vectors(embed_with(df, "doc_id", "text", embedder(log), batch_size=1, ledger=ledger))
    assert again == got and Counter(lines(log)) == calls
    last = LG.runs(spark, ledger.path).orderBy("run_at").collect()
    assert [(r.inputs, r.calls, r.called) for r in last][-1] == (41, len(calls), 0) and last[0].known == len(held)


def test_a_task_that_is_tried_again_goes_on_after_its_batches(spark):
    """The batches of a lost attempt are found by name, without the anti-join of a new run."""
    base, df = folder(spark, "ledger"), docs(spark)
    log, ledger = os.path.join(base, "log"), LG.Ledger(os.path.join(base, "led"), "embed-RETRIEVAL_DOCUMENT", "m1")
    embed_with(df, "doc_id", "text", embedder(log), batch_size=4, ledger=LG.Ledger(ledger.path, "embed", "m1")).count()
    calls = Counter(lines(log))
    kind = LG.T.StructType.fromDDL("key string, embedding array<double>, n_tokens long")
    seen = {}

    def paced(todo, run, schema):
        seen["made"] = sum(r.made for r in todo.repartition(spark.sparkContext.defaultParallelism)
                           .sortWithinPartitions("_call").mapInPandas(lambda b: run(b, lambda: None), schema).collect())

    # as if the run had not known of them when it began
    hidden = LG.Ledger.answers
    LG.Ledger.answers = lambda self, s, rows: s.createDataFrame([], self.schema(rows))
    try:
        src = df.select(F.col("doc_id").cast("string").alias("key"), F.col("text").alias("t")).filter("t is not null")
        LG.call_once(src, None, kind, "key", ledger, lambda f, p: pytest.fail("called"), paced, 4)
    finally:
        LG.Ledger.answers = hidden
    assert seen["made"] == 0 and Counter(lines(log)) == calls


def test_step_model_and_task_are_part_of_a_call(spark):
    base, df = folder(spark, "ledger"), spark.createDataFrame([(1, "same")], "doc_id long, text string")
    log = os.path.join(base, "log")
    for step, model, task in [("a", "m1", "RETRIEVAL_DOCUMENT"), ("a", "m2", "RETRIEVAL_DOCUMENT"), ("a", "m1", "RETRIEVAL_QUERY"),
                              ("b", "m1", "RETRIEVAL_DOCUMENT"), ("a", "m1", "RETRIEVAL_DOCUMENT")]:
        embed_with(df, "doc_id", "text", embedder(log), task=task, ledger=LG.Ledger(os.path.join(base, "led"), step, model)).count()
    assert len(lines(log)) == 4
    rows = LG.calls(spark, os.path.join(base, "led")).collect()
    assert {(r.step, r.model) for r in rows} == {("a-RETRIEVAL_DOCUMENT", "m1"), ("a-RETRIEVAL_DOCUMENT", "m2"),
                                                 ("a-RETRIEVAL_QUERY", "m1"), ("b-RETRIEVAL_DOCUMENT", "m1")}
    assert all(r.latency_ms >= 0 and r.n_rows == 1 and r.called_at is not None for r in rows)


def test_writer_and_checker_through_the_ledger(spark):
    """Answers of several rows, of none, and equal prompts of two questions."""
    base = folder(spark, "ledger")
    log = os.path.join(base, "log")
    prompts = spark.createDataFrame([(1, "q", "p1"), (2, "q", "p1"), (3, "q", "none")], "qid long, question string, prompt string")

    def write(pdf):
        noted(log, pdf["prompt"][0])
        if pdf["prompt"][0] == "none":
            return None
        q = int(pdf["qid"][0])
        return pd.DataFrame({"qid": [q, q], "claim_id": [7, 7], "text": ["a", "b"], "paper_ids": [["x"], []]})

    def check(pdf):
        noted(log, "check")
        return pd.DataFrame({"qid": [int(pdf["qid"][0])], "claim_id": [7], "supported": [True], "reasoning": ["r"]})

    for _ in range(2):
        claims = claims_from(prompts, write, ledger=LG.Ledger(os.path.join(base, "led"), "write", "m"))
        got = sorted((r.qid, r.claim_pos, r.claim_id, r.text, tuple(r.paper_ids)) for r in claims.collect())
        assert got == [(q, p, 7, t, i) for q in (1, 2) for p, t, i in [(1, "a", ("x",)), (2, "b", ())]]
        blocks = spark.createDataFrame([(1, "b1"), (2, "b2")], "qid long, block string")
        v = verdicts_from(blocks, check, ledger=LG.Ledger(os.path.join(base, "led"), "check", "m"))
        assert sorted((r.qid, r.claim_pos, r.supported) for r in v.collect()) == [(1, 1, True), (2, 1, True)]
    assert Counter(lines(log)) == {"p1": 1, "none": 1, "check": 2}


def test_compaction_keeps_every_answer(spark):
    base, df = folder(spark, "ledger"), docs(spark)
    log, ledger = os.path.join(base, "log"), LG.Ledger(os.path.join(base, "led"), "embed", "m")
    want = vectors(embed_with(df, "doc_id", "text", embedder(log), batch_size=2, ledger=ledger))
    calls = Counter(lines(log))
    stored = LG.Ledger(ledger.path, "embed-RETRIEVAL_DOCUMENT", "m")
    kind = LG.T.StructType.fromDDL("embedding array<double>, n_tokens long")
    files = stored.compact(spark, kind)
    assert files >= 10 and len(stored.answers(spark, kind).inputFiles()) < files
    assert vectors(embed_with(df, "doc_id", "text", embedder(log), batch_size=2, ledger=ledger)) == want
    assert Counter(lines(log)) == calls and not path_exists(spark, os.path.join(ledger.path, "step=none"))
    assert LG.Ledger(ledger.path, "none", "m").compact(spark, kind) == 0


def test_empty_input_calls_nothing(spark):
    base = folder(spark, "ledger")
    log, ledger = os.path.join(base, "log"), LG.Ledger(os.path.join(base, "led"), "embed", "m")
    assert embed_with(docs(spark).limit(0), "doc_id", "text", embedder(log), ledger=ledger).count() == 0
    assert lines(log) == [] and LG.runs(spark, ledger.path).first().called == 0
    with pytest.raises(ValueError):
        map_model(docs(spark), lambda p: p, "doc_id long", ledger=ledger)


def test_questions_and_documents_are_embedded_with_their_task(spark):
    from evidentia.operators.models import document_embedder, query_embedder
    from evidentia.plans.answering import search_question
    base = folder(spark, "task")
    log = os.path.join(base, "log")

    def embed(texts, task):
        noted(log, task)
        return [[1.0, float("b" in t)] for t in texts], [1] * len(texts)
    papers = spark.createDataFrame([("p1", "a"), ("p2", "b")], "paper_id string, title string")
    stored = document_embedder(embed, policy=CallPolicy(), ledger=LG.Ledger(os.path.join(base, "led"), "e", "m"))(papers, "paper_id", "title")
    found = search_question(spark, "b", stored.select("paper_id", "embedding"), papers, 1, query_embedder(embed)).collect()
    assert [r.paper_id for r in found] == ["p2"] and set(lines(log)) == {"RETRIEVAL_DOCUMENT", "RETRIEVAL_QUERY"}
    q = spark.createDataFrame([(5, "b")], "qid long, question string")
    assert query_embedder(embed)(q, "qid", "question").schema["qid"].dataType.simpleString() == "bigint"


# --- pace ----------------------------------------------------------------------------------

def test_ticks_are_used_once_and_never_early():
    a, b = Pace(1.0, 2, 0, 100.0), Pace(1.0, 2, 1, 100.0)
    now, ticks = 100.0, []
    for p, spent in [(a, 0.1), (a, 5.3), (a, 0.0)]:
        now += p.wait(now)
        ticks.append(now)
        now += spent
    assert ticks == [100.0, 102.0, 108.0]                    # own ticks are even; 104 and 106 went by
    assert 100.25 + b.wait(100.25) == 101.0 and 101.0 + b.wait(101.0) == 103.0


@pytest.mark.parametrize("callers", [1, 4])
def test_one_rate_for_the_whole_job(spark, callers):
    """Eight partitions, a measured rate: as many callers as there may be make no more calls."""
    log = os.path.join(folder(spark, "pace"), "log")

    def fn(pdf):
        noted(log, repr(time.time()))
        return pdf
    df = spark.range(24).repartition(8)
    policy = CallPolicy(min_interval=0.1, callers=callers)
    assert sorted(r.id for r in map_model(df, fn, "id long", batch_size=1, policy=policy).collect()) == list(range(24))
    t = sorted(map(float, lines(log)))
    assert len(t) == 24 and t[-1] - t[0] >= 0.1 * 23 - 0.05
    assert all(t[i + 10] - t[i] >= 0.1 * 10 - 0.08 for i in range(14))        # nowhere a burst


def test_pace_through_the_ledger_and_defaults(spark):
    base = folder(spark, "pace")
    log, ledger = os.path.join(base, "log"), LG.Ledger(os.path.join(base, "led"), "embed", "m")
    df = spark.createDataFrame([(i, f"t{i}") for i in range(12)], "doc_id long, text string")

    def embed(texts, task):
        noted(log, repr(time.time()))
        return [[1.0]] * len(texts), [1] * len(texts)
    policy = CallPolicy(min_interval=0.1, callers=3)
    assert embed_with(df, "doc_id", "text", embed, batch_size=1, policy=policy, ledger=ledger).count() == 12
    t = sorted(map(float, lines(log)))
    assert len(t) == 12 and t[-1] - t[0] >= 0.1 * 11 - 0.05
    assert (INGEST_POLICY.min_interval, EVALUATION_POLICY.min_interval) == (0.2, 2.0)
