"""Usage and cost accounting: priced usage rows (J8, F10, F11), trace rows
(W3, F13, U3), totals per run (A8), model-turn usage (A9), the
authoritative answer of a run (T6) and usage per day and tool (R3, batch
twin of the streaming rollup).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions.cost import billed_output, money_round, money_sum, with_cost
from evidentia.functions.format import py_fixed
from evidentia.functions.text import strip_ws, token_count
from evidentia.session import cut_lineage

# --- fixed values --------------------------------------------------------------
NO_ANSWER = "(no final response produced. validate() may not have completed; see trace above)"
ORCHESTRATOR_MODEL = "gemini-3.7-flash"
# Test-table mapping of events onto tool calls: model used per event type
# ('error' runs a local checker that is not priced).
EVENT_MODELS = [
    ("click", "gemini-3.7-flash"),
    ("view", "gemini-embedding-001"),
    ("purchase", "gemini-3.1-pro-preview"),
    ("signup", "gemini-2.5-flash"),
    ("error", "local-checker"),
]
THINKING_MODULO = 5
# -------------------------------------------------------------------------------


def events_as_usage(events: DataFrame) -> DataFrame:
    """events -> usage rows: run = user, tool = event type, latency = value,
    input tokens = props.k, visible output tokens = floor(value), thinking
    tokens = event_id modulo THINKING_MODULO (billed with the visible ones)."""
    model = reduce(lambda acc, kv: acc.when(F.col("event_type") == kv[0], F.lit(kv[1])),
                   EVENT_MODELS[1:], F.when(F.col("event_type") == EVENT_MODELS[0][0], F.lit(EVENT_MODELS[0][1])))
    k = F.get_json_object("props", "$.k").cast("long")
    return events.select(
        F.col("user_id").alias("run_id"), "ts", "event_id", F.col("event_type").alias("tool"),
        F.concat(F.lit("k="), k.cast("string")).alias("input_summary"),
        F.concat(F.col("event_type"), F.lit(" value="), F.col("value").cast("string")).alias("output_summary"),
        model.alias("model"), k.alias("input_tokens"),
        billed_output(F.floor("value").cast("long"), F.pmod("event_id", F.lit(THINKING_MODULO))).alias("output_tokens"),
        F.col("value").alias("latency_ms"))


def priced(usage: DataFrame, pricing: DataFrame) -> DataFrame:
    """Add cost_usd; unknown model -> 0."""
    return with_cost(usage, pricing)


def sequence_runs(usage: DataFrame, order_cols=("ts", "event_id"), skew_safe: bool = True) -> DataFrame:
    """Number the rows of each run from 1 in call order.

    ``row_number() over (partition by run_id)`` puts a whole run in one task;
    one run may hold a third of all rows. The skew-safe form range-partitions
    by (run, order) instead, so a hot run is cut across many tasks, numbers
    rows inside each task, and adds per-task offsets from a small table of
    (task, run) counts (one row per task a run touches)."""
    if not skew_safe:
        w = Window.partitionBy("run_id").orderBy(*order_cols)
        return usage.withColumn("seq", F.row_number().over(w).cast("long"))
    return skew_safe_row_number(usage, "run_id", list(order_cols), "seq")


def skew_safe_row_number(df: DataFrame, key: str, order_cols: list[str], out: str,
                         slices: int | None = None) -> DataFrame:
    """row_number() over (partition by key order by order_cols), exact, with
    no group ever gathered into one task; order_cols must make the order
    total within a key. Null keys are one group.

    Rows are range-partitioned by (key, order) into ``slices`` (default: the
    shuffle partitions, merged by AQE where they are small) and written once
    with their slice, which fixes it whatever is recomputed later. Rows are
    numbered inside their (slice, key) group, and each group adds the row
    count of the same key's earlier slices, from a table with one row per
    (slice, key)."""
    cols = [F.col(key), *[F.col(c) for c in order_cols]]
    ranged = df.repartitionByRange(slices, *cols) if slices else df.repartitionByRange(*cols)
    s = cut_lineage(ranged.withColumn("_sl", F.spark_partition_id()), "row-slices")
    local = s.withColumn("_ln", F.row_number().over(Window.partitionBy("_sl", key).orderBy(*order_cols)))
    g = s.groupBy("_sl", key).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(key).orderBy("_sl").rowsBetween(Window.unboundedPreceding, -1)
    off = g.select(F.col("_sl").alias("_osl"), F.col(key).alias("_okey"),
                   F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    j = local.join(off, (F.col("_sl") == F.col("_osl")) & F.col(key).eqNullSafe(F.col("_okey")))
    return j.withColumn(out, (F.col("_off") + F.col("_ln")).cast("long")).drop("_sl", "_ln", "_off", "_osl", "_okey")


def concat_traces(*frames: DataFrame, order_col: str = "ts") -> DataFrame:
    """One trace from the usage frames of several steps, in call order.
    Calls of one moment keep the order of ``frames``, then of their tool and
    tokens, so the order is total."""
    tagged = [f.withColumn("_frame", F.lit(i)) for i, f in enumerate(frames)]
    u = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    ties = [c for c in ("tool", "input_tokens", "output_tokens", "event_id") if c in u.columns]
    return sequence_runs(u, (order_col, "_frame", *ties)).drop("_frame")


def trace_display(trace: DataFrame) -> DataFrame:
    """Display columns: model or '-', latency with no decimals, cost with
    five, output summary cut at 60 characters (F13), rounded as Python
    formats floats."""
    return trace.select(
        "run_id", "seq", "tool", F.coalesce("model", F.lit("-")).alias("model"),
        F.col("input_tokens").cast("string").alias("in_tok"),
        F.col("output_tokens").cast("string").alias("out_tok"),
        py_fixed("latency_ms", 0).alias("latency_ms"),
        py_fixed("cost_usd", 5).alias("cost_usd"),
        F.substring("output_summary", 1, 60).alias("output"))


def trace_totals(trace: DataFrame) -> DataFrame:
    """Per run: total input tokens, output tokens and cost."""
    return trace.groupBy("run_id").agg(
        F.sum("input_tokens").cast("long").alias("input_tokens"),
        F.sum("output_tokens").cast("long").alias("output_tokens"),
        money_round(money_sum("cost_usd"), 5).alias("cost_usd"))


def conversation_turn_usage(conversations: DataFrame) -> DataFrame:
    """Turns of a conversation as usage: the text of an assistant (model) turn
    is output tokens, that of every other role is prompt tokens
    (letter/digit runs). Only assistant turns are model turns."""
    t = token_count("text")
    model = F.coalesce(F.col("role") == "assistant", F.lit(False))
    return conversations.select(
        F.col("conv_id").alias("run_id"), "turn", model.alias("model_turn"),
        F.when(~model, t).otherwise(F.lit(0)).alias("prompt_tokens"),
        F.when(model, t).otherwise(F.lit(0)).alias("output_tokens"))


def orchestrator_usage(turns: DataFrame, pricing: DataFrame, model: str = ORCHESTRATOR_MODEL) -> DataFrame:
    """One usage row per run summing every model turn (nulls as 0), emitted
    only when either sum is non-zero; latency 0 (A9, E20)."""
    g = turns.groupBy("run_id").agg(
        F.sum(F.coalesce("prompt_tokens", F.lit(0))).cast("long").alias("input_tokens"),
        F.sum(F.coalesce("output_tokens", F.lit(0))).cast("long").alias("output_tokens"),
        F.count_if("model_turn").cast("long").alias("model_turns"))
    g = g.filter((F.col("input_tokens") > 0) | (F.col("output_tokens") > 0))
    g = g.select("run_id", F.lit("orchestrator").alias("tool"), F.lit(model).alias("model"),
                 "input_tokens", "output_tokens", "model_turns", F.lit(0.0).alias("latency_ms"))
    return with_cost(g, pricing)


def authoritative_answer(runs: DataFrame, conversations: DataFrame) -> DataFrame:
    """Per run: the newest non-blank validator (assistant) answer, else the
    newest non-blank user turn, else the fixed sentence (T6)."""
    nonblank = strip_ws("text") != ""
    g = conversations.groupBy("conv_id").agg(
        F.max_by("text", F.when((F.col("role") == "assistant") & nonblank, F.col("turn"))).alias("_a"),
        F.max_by("text", F.when((F.col("role") == "user") & nonblank, F.col("turn"))).alias("_u"))
    j = runs.select("conv_id").join(g, "conv_id", "left")
    src = (F.when(F.col("_a").isNotNull(), F.lit("validator"))
            .when(F.col("_u").isNotNull(), F.lit("fallback")).otherwise(F.lit("none")))
    return j.select("conv_id", src.alias("answer_source"),
                    F.coalesce("_a", "_u", F.lit(NO_ANSWER)).alias("answer"))


def usage_by_window(usage: DataFrame, duration: str = "1 day") -> DataFrame:
    """Usage and cost per event-time window and tool."""
    return usage.groupBy(F.window("ts", duration).alias("w"), "tool").agg(
        F.count(F.lit(1)).cast("long").alias("calls"),
        F.sum("input_tokens").cast("long").alias("input_tokens"),
        F.sum("output_tokens").cast("long").alias("output_tokens"),
        money_sum("cost_usd").alias("cost_usd"))


def usage_by_day(usage: DataFrame) -> DataFrame:
    u = usage_by_window(usage, "1 day")
    return u.select(F.date_format(F.col("w.start"), "yyyy-MM-dd").alias("day"), "tool", "calls",
                    "input_tokens", "output_tokens", money_round("cost_usd", 6).alias("cost_usd"))
