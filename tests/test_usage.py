"""Cost and usage rules."""

import math

from evidentia.functions.cost import billed_output, pricing_frame, with_cost
from evidentia.operators import compare as CMP
from evidentia.operators import usage as U


def test_unknown_model_costs_zero(spark):  # E24, J8
    u = spark.createDataFrame([("gemini-2.5-pro", 1_000_000, 100_000), ("nope", 5, 5), (None, 1, 1)],
                              "model string, input_tokens long, output_tokens long")
    got = {r.model: r.cost_usd for r in with_cost(u, pricing_frame(spark)).collect()}
    assert math.isclose(got["gemini-2.5-pro"], 1.25 + 1.0)
    assert got["nope"] == 0.0 and got[None] == 0.0


def test_billed_output_nulls(spark):  # F10
    df = spark.createDataFrame([(None, None), (3, None), (None, 4), (3, 4)], "v int, t int")
    assert [r.b for r in df.select(billed_output("v", "t").alias("b")).collect()] == [0, 3, 4, 7]


def test_orchestrator_row(spark):  # A9, E20
    turns = spark.createDataFrame([(1, 0, False, 10, None), (1, 1, True, None, 5), (2, 0, True, 0, 0)],
                                  "run_id long, turn long, model_turn boolean, prompt_tokens long, output_tokens long")
    rows = {r.run_id: r for r in U.orchestrator_usage(turns, pricing_frame(spark)).collect()}
    assert set(rows) == {1}                                  # all-zero run emits nothing
    assert (rows[1].input_tokens, rows[1].output_tokens, rows[1].model_turns) == (10, 5, 1)
    assert rows[1].latency_ms == 0.0


def test_cost_ratio_infinity(spark):  # E22, T5
    runs = spark.createDataFrame([(1, "a", 0.0), (1, "b", 0.02), (2, "a", 0.01), (2, "b", 0.03), (3, "a", 0.1)],
                                 "qid long, model string, cost_usd double")
    got = {r.qid: r for r in CMP.cost_ratio(runs, ["a", "b"]).collect()}
    assert set(got) == {1, 2}                                # exactly two models only
    assert got[1].cost_ratio == float("inf") and got[1].cheaper_model == "a"
    assert got[2].cost_ratio == 3.0 and got[2].pricier_model == "b"


def test_authoritative_answer_precedence(spark):  # T6, E19
    conv = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "ans"), (1, 2, "assistant", "\t\n"),
                                  (2, 0, "user", "only user"), (3, 0, "system", "sys")],
                                 "conv_id long, turn long, role string, text string")
    got = {r.conv_id: (r.answer_source, r.answer) for r in
           U.authoritative_answer(conv.select("conv_id").distinct(), conv).collect()}
    assert got[1] == ("validator", "ans")
    assert got[2] == ("fallback", "only user")
    assert got[3] == ("none", U.NO_ANSWER)


def test_trace_sequence_and_union(spark):  # W3, U3
    a = spark.createDataFrame([(1, "2024-01-01 00:00:02", "retrieve", 0, 0)],
                              "run_id long, ts string, tool string, input_tokens long, output_tokens long")
    b = spark.createDataFrame([(1, "2024-01-01 00:00:01", "search_corpus", 5, 0)],
                              "run_id long, ts string, tool string, input_tokens long, output_tokens long")
    t = U.concat_traces(a, b).orderBy("seq").collect()
    assert [(r.seq, r.tool) for r in t] == [(1, "search_corpus"), (2, "retrieve")]
    tot = U.trace_totals(U.concat_traces(a, b).withColumn("cost_usd", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(0.0))).first()
    assert (tot.input_tokens, tot.output_tokens) == (5, 0)


def test_skew_safe_row_number_matches_window(spark):
    from pyspark.sql import Window, functions as F
    # one run holds most rows
    df = spark.range(5000).select((F.when(F.col("id") % 10 < 7, 0).otherwise(F.col("id") % 13)).alias("run_id"),
                                  (F.col("id") * 7919 % 5003).alias("ts"), F.col("id").alias("event_id"))
    want = df.withColumn("seq", F.row_number().over(Window.partitionBy("run_id").orderBy("ts", "event_id")))
    got = U.skew_safe_row_number(df, "run_id", ["ts", "event_id"], "seq")
    assert sorted(map(tuple, got.select("event_id", "seq").collect())) == \
        sorted(map(tuple, want.select("event_id", "seq").collect()))


def test_step_trace_no_model_rows(spark):  # E21, U3
    from pyspark.sql import functions as F
    from evidentia.functions.cost import pricing_frame
    from evidentia.plans.answering import answer, step_trace
    q = spark.createDataFrame([(1, "alpha beta. gamma."), (2, "delta.")], "qid long, question string")
    vecs = spark.createDataFrame([], "paper_id string, embedding array<double>")
    papers = spark.createDataFrame([], "paper_id string, title string, authors string, published_date date, abstract string, url string")
    a = answer(q, vecs, papers, k=3)
    t = {(r.run_id, r.seq): r for r in step_trace(a, pricing_frame(spark)).collect()}
    assert [t[(1, s)].tool for s in (1, 2, 3, 4)] == ["search_corpus", "retrieve", "synthesize", "validate"]
    for s in (2, 3, 4):
        assert t[(1, s)].model is None and t[(1, s)].cost_usd == 0.0
    assert t[(1, 3)].output_summary == "0 claims (nothing retrieved)"
    assert t[(2, 4)].output_summary == "0 claims to validate (empty synthesis)"
    md = {r.qid: r.final_markdown for r in a.answers.collect()}
    from evidentia.operators.guardrail import EMPTY_ANSWER
    assert md == {1: EMPTY_ANSWER, 2: EMPTY_ANSWER}


def test_row_numbers_with_many_slices_and_null_keys(spark):  # W3
    """As many slices as a cluster has shuffle partitions; null keys; equal to a plain window."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F
    df = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.lit(None)).otherwise(F.col("id") % 5).alias("run_id"),
                                  F.pmod(F.xxhash64("id"), F.lit(997)).alias("ts"), F.col("id").alias("event_id"))
    got = U.skew_safe_row_number(df, "run_id", ["ts", "event_id"], "seq", slices=2000)
    w = Window.partitionBy("run_id").orderBy("ts", "event_id")
    want = df.withColumn("seq", F.row_number().over(w).cast("long"))
    assert sorted(got.select("event_id", "seq").collect()) == sorted(want.select("event_id", "seq").collect())


def test_usage_stream_counts_late_files(spark):  # R3
    """Files out of order, one per batch: the stream equals the batch rollup."""
    import os
    import uuid
    from pyspark.sql import functions as F
    from evidentia.session import checkpoint_dir, read_table
    from evidentia.streaming.usage import usage_by_day_stream
    from tests.conftest import SF_SMALL
    ev = read_table(spark, SF_SMALL, "events")
    path = os.path.join(checkpoint_dir(spark), f"late-{uuid.uuid4().hex}")
    for part in (3, 0, 2, 1):
        cut = F.ntile(4).over(__import__("pyspark.sql", fromlist=["Window"]).Window.orderBy(F.desc("ts"))) - 1
        ev.withColumn("part", cut).filter(F.col("part") == part).drop("part").coalesce(1).write.mode("append").parquet(path)
    got = usage_by_day_stream(spark, path, files_per_trigger=1)
    want = U.usage_by_day(U.priced(U.events_as_usage(ev), pricing_frame(spark)))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
