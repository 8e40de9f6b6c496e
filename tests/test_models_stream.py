"""Call policy (M5), user-function embedder (M1, J9), containment, stream
progress (R2) and stream = batch (R1)."""

import os
import uuid

import pandas as pd
import pytest
from pyspark.sql import functions as F

from evidentia.operators.containment import contained_in
from evidentia.operators.models import CallPolicy, RateLimited, call_with_policy, embed_with, map_model
from evidentia.session import checkpoint_dir, read_table

from tests.conftest import SF_SMALL


def test_retry_waits_then_succeeds():
    waits, calls = [], []

    def fn(x):
        calls.append(x)
        if len(calls) < 4:
            raise RateLimited()
        return "ok"
    assert call_with_policy(fn, (1,), CallPolicy(), sleep=waits.append) == "ok"
    assert waits == [15.0, 30.0, 60.0]


def test_retry_gives_up_and_other_errors_raise():
    with pytest.raises(RateLimited):
        call_with_policy(lambda: (_ for _ in ()).throw(RateLimited()), (), CallPolicy(max_retries=2), sleep=lambda s: None)
    with pytest.raises(KeyError):
        call_with_policy(lambda: {}["x"], (), CallPolicy(), sleep=lambda s: None)


def test_map_model_slices(spark):
    df = spark.range(100).repartition(1)

    def fn(pdf):
        return pd.DataFrame({"n": [len(pdf)]})
    sizes = sorted(r.n for r in map_model(df, fn, "n long", batch_size=32).collect())
    assert sizes == [4, 32, 32, 32]


def test_user_embedder_keeps_keys(spark):
    docs = spark.createDataFrame([(i, "x" * i) for i in range(1, 50)], "doc_id long, text string").repartition(3)

    def embed(texts, task):
        assert task == "RETRIEVAL_DOCUMENT"
        return [[float(len(t)), 1.0] for t in texts], [len(t) for t in texts]
    out = embed_with(docs, "doc_id", "text", embed)
    got = {r.doc_id: (r.embedding[0], r.n_tokens) for r in out.collect()}
    assert got == {str(i): (float(i), i) for i in range(1, 50)}


def test_containment_matches_python(spark):
    items = read_table(spark, SF_SMALL, "benchmark")
    docs = read_table(spark, SF_SMALL, "documents")
    got = sorted((r.item_id, r.doc_id) for r in contained_in(items, docs).collect())
    it = [(r.item_id, r.text) for r in items.collect()]
    want = sorted((i, d.doc_id) for d in docs.collect() for i, t in it if t and t in (d.text or ""))
    assert got == want and len(got) > 0


def test_stream_upsert_progress(spark):
    import datetime as dt
    from evidentia.operators import corpus as CO
    from evidentia.schemas import PAPERS
    from evidentia.streaming.ingest import start_stream_upsert
    from evidentia.streaming.progress import progress_frame
    base = os.path.join(checkpoint_dir(spark), f"st-{uuid.uuid4().hex}")
    src = spark.createDataFrame([(str(i), "t", "a", dt.date(2024, 1, 1), f"x{i}", "u", None, dt.datetime(2024, 1, 1))
                                 for i in range(5)], PAPERS)
    for _ in range(2):
        src.coalesce(1).write.mode("append").parquet(os.path.join(base, "src"))
    q = start_stream_upsert(spark, os.path.join(base, "src"), os.path.join(base, "table"), os.path.join(base, "ck"))
    q.awaitTermination()
    assert CO.read_table_at(spark, os.path.join(base, "table")).count() == 5
    ev = progress_frame(spark, q).collect()
    assert ev[-1].status == "done"
    assert sum(e.input_rows or 0 for e in ev if e.status == "progress") == 10


def test_progress_log_on_the_upsert_stream_loses_nothing(spark):  # R2
    """The log is told by the stream itself; beyond what it holds, it writes."""
    import datetime as dt
    from evidentia.schemas import PAPERS
    from evidentia.streaming.ingest import start_stream_upsert
    from evidentia.streaming.progress import ProgressLog
    base = os.path.join(checkpoint_dir(spark), f"pl-{uuid.uuid4().hex}")
    src = spark.createDataFrame([(str(i), "t", "a", dt.date(2024, 1, 1), f"x{i}", "u", None, dt.datetime(2024, 1, 1))
                                 for i in range(5)], PAPERS)
    for _ in range(3):
        src.unionByName(src).coalesce(1).write.mode("append").parquet(os.path.join(base, "src"))     # repeats keys
    log = ProgressLog(spark, os.path.join(base, "log"))
    log.FLUSH = 2
    q = start_stream_upsert(spark, os.path.join(base, "src"), os.path.join(base, "table"), os.path.join(base, "ck"),
                            files_per_trigger=1, listener=log)
    q.awaitTermination()
    assert q.exception() is None and len(log.events) < 2
    got = sorted((r.batch_id, r.status, r.input_rows) for r in log.frame(spark).collect())
    assert [x for x in got if x[1] == "progress"] == [(i, "progress", 5) for i in range(3)]
    assert [x for x in got if x[1] == "started"] == [(i, "started", None) for i in range(3)]
    changed = sorted((r.batch_id, r.affected) for r in log.frame(spark).collect() if r.status == "progress")
    assert changed == [(0, 5), (1, 0), (2, 0)]               # the same rows again change nothing


FEED = """<?xml version="1.0" encoding="UTF-8"?>
<feed xmlns="http://www.w3.org/2005/Atom" xmlns:arxiv="http://arxiv.org/schemas/atom">
  <entry>
    <id>http://arxiv.org/abs/2508.01234v2</id>
    <published>2025-08-01T17:59:59Z</published>
    <title>Prompt   patterns
      for code</title>
    <summary>  Large language   models
       write code.  </summary>
    <author><name>A. One</name></author>
    <author><name>B. Two</name></author>
    <arxiv:primary_category term="cs.SE"/>
    <category term="cs.SE" scheme="http://arxiv.org/schemas/atom"/>
    <category term="cs.CL" scheme="http://arxiv.org/schemas/atom"/>
  </entry>
  <entry>
    <id>http://arxiv.org/abs/cs/0112017v1</id>
    <published>2001-12-14T00:00:00Z</published>
    <title>Old</title>
    <summary>Text.</summary>
    <author><name>C. Three</name></author>
  </entry>
</feed>
"""


def test_feed_xml_source(spark):  # S2, F1-F5
    from evidentia.sources.feed import normalize_entries, read_feed
    path = os.path.join(checkpoint_dir(spark), f"feed-{uuid.uuid4().hex}.xml")
    with open(path, "w") as f:
        f.write(FEED)
    rows = {r.id: r for r in normalize_entries(read_feed(spark, path)).collect()}
    a = rows["2508.01234"]
    assert a.title == "Prompt patterns for code" and a.abstract == "Large language models write code."
    assert a.authors == "A. One, B. Two" and str(a.published_date) == "2025-08-01"
    assert a.url == "https://arxiv.org/abs/2508.01234v2"
    assert rows["0112017"].authors == "C. Three"                   # E1
    from evidentia.operators.corpus import topic_filter
    cats = normalize_entries(read_feed(spark, path), categories=True)
    assert {r.id: r.categories for r in cats.collect()} == {"2508.01234": ["cs.SE", "cs.CL"], "0112017": []}
    on_topic = topic_filter(cats, None, text_col="abstract")
    assert [r.id for r in on_topic.collect()] == []           # no clause of the default topic holds


def test_result_sink_and_listener(spark):  # S10, R2
    import json
    from evidentia.plans.fixtures import fixture_evaluation
    from evidentia.plans.answering import write_results
    from evidentia.streaming.progress import ProgressLog
    from tests.conftest import SF_SMALL
    a, ev = fixture_evaluation(spark, SF_SMALL)
    out = os.path.join(checkpoint_dir(spark), f"eval-{uuid.uuid4().hex}")
    write_results(ev, out, "2026-12-02", {"judge": "lexical-judge"})
    qs = spark.read.json(os.path.join(out, "questions"))
    assert qs.count() == a.questions.count()
    run = spark.read.json(os.path.join(out, "run")).first()
    assert run.metrics.total_questions == a.questions.count() and run.models.judge == "lexical-judge"
    log = ProgressLog()
    spark.streams.addListener(log)
    try:
        base = os.path.join(checkpoint_dir(spark), f"ls-{uuid.uuid4().hex}")
        spark.range(7).write.parquet(os.path.join(base, "in"))
        q = (spark.readStream.schema("id long").parquet(os.path.join(base, "in")).writeStream
             .format("noop").option("checkpointLocation", os.path.join(base, "ck")).trigger(availableNow=True).start())
        q.awaitTermination()
        import time
        for _ in range(50):
            if any(e[2] == "done" for e in log.events):
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(log)
    ev_rows = log.frame(spark).collect()
    assert any(r.status == "progress" and r.input_rows == 7 for r in ev_rows)
    assert ev_rows[-1].status == "done"


def test_containment_of_any_passage(spark):
    """Passages without inner tokens, with one, repeated, of other scripts and of white space; several blocks."""
    import random
    rnd = random.Random(4)
    words = ["alpha", "be", "x", "été", "zwei3", "данные", "-", "a.b", "\n", "  "]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 30))) for _ in range(120)] + [None, "", "alpha"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    passages = [None, "", " ", "a", "alph", "be x", "été zwei3 данные", "lpha be", "x été zwei3 x", "none of these", "-", "b - ", "alpha"]
    for t in rnd.sample([t for t in texts if t and len(t) > 12], 40):
        a = rnd.randrange(len(t) - 10)
        passages.append(t[a:a + rnd.randint(1, 40)])
    passages += passages[-3:]
    items = spark.createDataFrame(list(enumerate(passages)), "item_id long, text string")
    want = sorted((i, d) for i, p in enumerate(passages) for d, t in enumerate(texts) if p and t and p in t)
    for block in (256, 4):
        got = sorted(map(tuple, contained_in(items, docs, block=block).collect()))
        assert got == want
    assert contained_in(items.limit(0), docs).count() == 0 == contained_in(items, docs.limit(0)).count()
    named = contained_in(items.withColumnRenamed("item_id", "p"), docs.withColumnRenamed("doc_id", "q"), item_key="p", doc_key="q")
    assert named.columns == ["p", "q"]


def test_user_model_steps_in_pipeline(spark):  # M2, M3 as user functions, P12
    from evidentia.operators import claims as C
    from evidentia.operators.models import claims_from, verdicts_from
    from evidentia.operators.retrieve import sources_block
    from evidentia.plans.answering import answer
    from evidentia.sources.corpus import hashed_corpus, paper_texts
    q = spark.createDataFrame([(1, "Ouréaux qui éoireeau de aiêç ére le."), (2, "Nothing.")],
                              "qid long, question string")

    def writer(pdf):      # one claim citing the first listed paper; none for question 2
        rows = []
        for qid, prompt in zip(pdf["qid"], pdf["prompt"]):
            if qid == 1:
                first = prompt.split("paper_id: ", 1)[1].split("\n", 1)[0]
                rows.append((qid, 7, "a claim", [first, "nope"]))
                rows.append((qid, 7, "again", [first]))
        return pd.DataFrame(rows, columns=["qid", "claim_id", "text", "paper_ids"])

    def checker(pdf):     # supports every claim it is shown, twice (last wins)
        rows = []
        for qid, block in zip(pdf["qid"], pdf["block"]):
            rows.append((qid, 7, False, "first look"))
            rows.append((qid, 7, True, "second look"))
        return pd.DataFrame(rows, columns=["qid", "claim_id", "supported", "reasoning"])

    def write_claims(questions, retrieved, hits):
        return claims_from(sources_block(questions, retrieved), writer)

    def check_support(claims, retrieved):
        return verdicts_from(C.claims_block(claims, retrieved), checker)

    a = answer(q, hashed_corpus(spark, SF_SMALL).select("paper_id", "embedding"), paper_texts(spark, SF_SMALL),
               k=3, write_claims=write_claims, check_support=check_support)
    st = {r.claim_pos: r for r in a.status.filter("qid = 1").collect()}
    assert st[1].claim_supported is False and st[1].unknown_ids == ["nope"]     # E9 beats the verdict
    assert st[2].claim_supported is True                                      # last verdict wins
    md = {r.qid: r.final_markdown for r in a.answers.collect()}
    assert md[1].startswith("## Findings\n\n- again [")
    from evidentia.operators.guardrail import EMPTY_ANSWER
    assert md[2] == EMPTY_ANSWER


def test_feed_ingest_stream(spark):  # R1 from feed files, E3
    from evidentia.operators import corpus as CO
    from evidentia.streaming.ingest import start_feed_ingest
    base = os.path.join(checkpoint_dir(spark), f"feed-{uuid.uuid4().hex}")
    os.makedirs(os.path.join(base, "feeds"))
    with open(os.path.join(base, "feeds", "a.xml"), "w") as f:
        f.write(FEED)
    second = FEED.replace("Large language", "Updated language").split("<entry>")
    with open(os.path.join(base, "feeds", "b.xml"), "w") as f:       # same first paper, new text
        f.write(second[0] + "<entry>" + second[1] + "</feed>\n")
    q = start_feed_ingest(spark, os.path.join(base, "feeds"), os.path.join(base, "table"), os.path.join(base, "ck"))
    q.awaitTermination()
    assert q.exception() is None
    rows = {r.id: r for r in CO.read_table_at(spark, os.path.join(base, "table")).collect()}
    assert set(rows) == {"2508.01234", "0112017"}
    assert len(rows["2508.01234"].embedding) == 256
    got = rows["2508.01234"].abstract
    assert got in ("Updated language models write code.", "Large language models write code.")


def test_batch_ingest_job(spark):  # S2 -> P1 -> T3 -> M1 -> S5 -> S11, E3, E4, E5
    from evidentia.operators import corpus as CO
    from evidentia.plans.ingest import ingest
    base = os.path.join(checkpoint_dir(spark), f"ing-{uuid.uuid4().hex}")
    os.makedirs(os.path.join(base, "feeds"))
    with open(os.path.join(base, "feeds", "a.xml"), "w") as f:
        f.write(FEED)
    table = os.path.join(base, "table")
    off = ingest(spark, os.path.join(base, "feeds"), table).first()                # no predicate: the default topic
    assert (off.fetched, off.affected, off.total_rows) == (0, 0, None)
    s = ingest(spark, os.path.join(base, "feeds"), table, predicate="true", max_results=None).first()
    assert (s.fetched, s.affected, s.total_rows) == (2, 2, 2) and s.tokens > 0
    assert s.cost_usd == round(s.tokens / 1e6 * 0.15, 4)
    s2 = ingest(spark, os.path.join(base, "feeds"), table, predicate="true", max_results=1).first()   # newest only, idempotent
    assert (s2.fetched, s2.affected, s2.total_rows) == (1, 1, 2)
    none = ingest(spark, os.path.join(base, "feeds"), table, predicate="array_contains(categories, 'q-bio')").first()
    assert (none.fetched, none.affected, none.total_rows) == (0, 0, None)                   # E4
    s3 = ingest(spark, os.path.join(base, "feeds"), table, predicate="array_contains(categories, 'cs.CL')",
                clear=True).first()                                                         # E5
    assert (s3.fetched, s3.total_rows) == (1, 1)
    assert [r.id for r in CO.read_table_at(spark, table).collect()] == ["2508.01234"]
