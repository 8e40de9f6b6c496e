"""Evaluation as aggregations: the independent judge (M4 default), claim
records (J7), answerability (A6, J11), per-question rollup (A7), grounding
metrics (A5), confusion cells (A13), the regression gate (P11), the nested
result sink (S10), report rows (F14), status counts (A14) and retrieval
quality against a truth table (A12).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.functions.cost import MONEY, money_round, money_sum
from evidentia.functions.format import py_fixed, py_percent
from evidentia.functions.text import match_form, token_count
from evidentia.operators.claims import claim_citations
from evidentia.operators.guardrail import last_verdict
from evidentia.operators.models import builtin_model


@builtin_model
def judge_check(claims: DataFrame, retrieved: DataFrame) -> DataFrame:
    """Built-in strict judge, blind to the support checker: a claim is
    grounded when its normalised text occurs verbatim in the normalised
    text of some retrieved paper it cites. One verdict per claim row."""
    docs = (retrieved.select("qid", "paper_id", "abstract")
                     .join(retrieved.select("paper_id", "abstract").dropDuplicates(["paper_id"])
                           .select("paper_id", match_form("abstract").alias("_norm")), "paper_id"))
    c = claim_citations(claims).select("qid", "claim_pos", "paper_id").dropDuplicates()
    m = (c.join(docs.select("qid", "paper_id", "_norm"), ["qid", "paper_id"])
          .join(claims.select("qid", "claim_pos", match_form("text").alias("_ct")), ["qid", "claim_pos"])
          .groupBy("qid", "claim_pos").agg(F.bool_or(F.instr("_norm", F.col("_ct")) > 0).alias("_g")))
    j = claims.join(m, ["qid", "claim_pos"], "left")
    g = F.coalesce(F.col("_g"), F.lit(False))
    reason = F.when(g, F.lit("stated verbatim in a cited source")).otherwise(F.lit("not stated in any cited source"))
    return j.select("qid", "claim_pos", "claim_id", g.alias("grounded"), reason.alias("reasoning"))


def claim_records(claims: DataFrame, validator_by_id: DataFrame, judge: DataFrame) -> DataFrame:
    """One record per claim row with both verdicts; a claim missing from
    either verdict map is False on that side (J7)."""
    jv = last_verdict(judge, ["grounded"])
    j = (claims.join(validator_by_id, ["qid", "claim_id"], "left")
               .join(jv, ["qid", "claim_id"], "left"))
    return j.select("qid", "claim_pos", "claim_id", F.col("text").alias("claim_text"), "paper_ids",
                    F.coalesce("validator_supported", F.lit(False)).alias("validator_supported"),
                    F.coalesce("grounded", F.lit(False)).alias("judge_grounded"))


def answerability(questions: DataFrame, counts: DataFrame) -> DataFrame:
    """answerable -> some claim supported; unanswerable -> none; else True."""
    j = questions.select("qid", "expected_status").join(counts, "qid", "left")
    s = F.coalesce(F.col("supported_count"), F.lit(0))
    match = (F.when(F.col("expected_status") == "answerable", s > 0)
              .when(F.col("expected_status") == "unanswerable", s == 0)
              .otherwise(F.lit(True)))
    return j.select("qid", "expected_status", F.coalesce("claim_count", F.lit(0)).cast("long").alias("claim_count"),
                    s.cast("long").alias("supported_count"),
                    F.coalesce("unsupported_count", F.lit(0)).cast("long").alias("unsupported_count"),
                    match.alias("answerability_match"))


def question_results(questions: DataFrame, counts: DataFrame, records: DataFrame,
                     judge_cost: DataFrame | None = None) -> DataFrame:
    """Per question: counts, answerability, judge cost and the nested claim
    records in claim order (A7)."""
    a = answerability(questions, counts)
    nested = records.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct(
        "claim_pos", F.col("claim_text").alias("text"), "paper_ids", "validator_supported",
        "judge_grounded"))).alias("_c"))
    claims = F.transform(F.coalesce("_c", F.array().cast(nested.schema["_c"].dataType)),
                         lambda x: F.struct(x["text"].alias("text"), x["paper_ids"].alias("paper_ids"),
                                            x["validator_supported"].alias("validator_supported"),
                                            x["judge_grounded"].alias("judge_grounded")))
    j = a.join(nested, "qid", "left").join(questions.select("qid", "question"), "qid")
    if judge_cost is not None:
        j = j.join(judge_cost.select("qid", "cost_usd"), "qid", "left")
        cost = F.coalesce("cost_usd", F.lit(0.0))
    else:
        cost = F.lit(0.0)
    return j.select("qid", "question", "expected_status", "claim_count", "supported_count",
                    "unsupported_count", "answerability_match", cost.alias("cost_usd"), claims.alias("claims"))


def _rate(num, den):
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def grounding_metrics(results: DataFrame, records: DataFrame) -> DataFrame:
    """One row of the eight metrics; every rate is 0.0 over an empty
    denominator, rates and cost rounded half-even to 4 places (A5).
    Question rows and claim rows are tagged and aggregated in one pass."""
    q = results.select(F.lit(True).alias("_isq"), F.col("answerability_match").alias("_am"),
                       F.col("cost_usd").alias("_c"), F.lit(None).cast("boolean").alias("_vs"),
                       F.lit(None).cast("boolean").alias("_jg"))
    c = records.select(F.lit(False).alias("_isq"), F.lit(None).cast("boolean").alias("_am"),
                       F.lit(None).cast("double").alias("_c"), F.col("validator_supported").alias("_vs"),
                       F.col("judge_grounded").alias("_jg"))
    m = q.unionByName(c).agg(
        F.count_if("_isq").alias("total_questions"),
        F.count_if(F.col("_isq") & F.col("_am")).alias("answerability_matches"),
        F.coalesce(money_sum("_c"), F.lit(0).cast(MONEY)).alias("_cost"),
        F.count_if(~F.col("_isq")).alias("total_claims"),
        F.count_if(F.col("_vs")).alias("_vs"),
        F.count_if(~F.col("_vs")).alias("_vu"),
        F.count_if(F.col("_vs") & ~F.col("_jg")).alias("_leak"),
        F.count_if(~F.col("_vs") & F.col("_jg")).alias("_fr"),
        F.count_if(F.col("_jg")).alias("_jg"))
    return m.select(
        F.col("total_questions").cast("long").alias("total_questions"),
        F.col("total_claims").cast("long").alias("total_claims"),
        F.bround(_rate(F.col("_leak"), F.col("_vs")), 4).alias("unsupported_claim_rate"),
        F.bround(_rate(F.col("_jg"), F.col("total_claims")), 4).alias("citation_accuracy"),
        F.bround(_rate(F.col("_fr"), F.col("_vu")), 4).alias("false_refusal_rate"),
        F.col("answerability_matches").cast("long").alias("answerability_matches"),
        F.bround(_rate(F.col("answerability_matches"), F.col("total_questions")), 4).alias("answerability_match_rate"),
        money_round("_cost", 4).alias("total_cost_usd"))


def claim_metrics(records: DataFrame) -> DataFrame:
    """Claim-level rates only (no question table)."""
    c = records.agg(
        F.count(F.lit(1)).alias("total_claims"),
        F.count_if("validator_supported").alias("_vs"),
        F.count_if(~F.col("validator_supported")).alias("_vu"),
        F.count_if(F.col("validator_supported") & ~F.col("judge_grounded")).alias("_leak"),
        F.count_if(~F.col("validator_supported") & F.col("judge_grounded")).alias("_fr"),
        F.count_if("judge_grounded").alias("_jg"))
    return c.select(
        F.col("total_claims").cast("long").alias("total_claims"),
        F.bround(_rate(F.col("_leak"), F.col("_vs")), 4).alias("unsupported_claim_rate"),
        F.bround(_rate(F.col("_jg"), F.col("total_claims")), 4).alias("citation_accuracy"),
        F.bround(_rate(F.col("_fr"), F.col("_vu")), 4).alias("false_refusal_rate"))


def verdict_confusion(records: DataFrame) -> DataFrame:
    return records.groupBy("validator_supported", "judge_grounded").agg(
        F.count(F.lit(1)).cast("long").alias("n"))


def gate(metrics: DataFrame, max_unsupported_rate: float | None = None,
         max_false_refusal_rate: float | None = None) -> DataFrame:
    """(metric, value, threshold, failed): fails when the rate is strictly
    above its threshold; an absent threshold never fails (P11)."""
    def row(name, thr):
        t = F.lit(thr).cast("double")
        v = F.col(name)
        return F.struct(F.lit(name).alias("metric"), v.alias("value"), t.alias("threshold"),
                        F.coalesce(v > t, F.lit(False)).alias("failed"))
    m = metrics.select(F.explode(F.array(row("unsupported_claim_rate", max_unsupported_rate),
                                         row("false_refusal_rate", max_false_refusal_rate))).alias("g"))
    return m.select("g.*")


def pct(c) -> F.Column:
    """0.1408 -> '14.1%' (Python's '.1%' format)."""
    return py_percent(c, 1)


def report_rows(metrics: DataFrame) -> DataFrame:
    """(metric, value) display strings of the metrics table."""
    m = metrics.select(F.explode(F.array(
        F.struct(F.lit("Unsupported-claim rate").alias("metric"), pct("unsupported_claim_rate").alias("value")),
        F.struct(F.lit("Citation accuracy").alias("metric"), pct("citation_accuracy").alias("value")),
        F.struct(F.lit("False-refusal rate").alias("metric"), pct("false_refusal_rate").alias("value")),
        F.struct(F.lit("Answerability-category match").alias("metric"),
                 F.concat(F.col("answerability_matches").cast("string"), F.lit("/"),
                          F.col("total_questions").cast("string"), F.lit(" ("),
                          pct("answerability_match_rate"), F.lit(")")).alias("value")),
        F.struct(F.lit("Judge cost (this run)").alias("metric"),
                 F.concat(F.lit("$"), py_fixed("total_cost_usd", 4)).alias("value")),
    )).alias("r"))
    return m.select(F.col("r")["metric"].alias("metric"), F.col("r")["value"].alias("value"))


def question_report_rows(results: DataFrame) -> DataFrame:
    return results.select("qid", "expected_status", "claim_count", "supported_count",
                          F.when(F.col("answerability_match"), F.lit("yes")).otherwise(F.lit("no")).alias("match"))


def status_counts(questions: DataFrame) -> DataFrame:
    return questions.groupBy("expected_status").agg(F.count(F.lit(1)).cast("long").alias("n"))


def judge_usage(block_tokens: DataFrame, judge: DataFrame, model: str) -> DataFrame:
    """(qid, model, input_tokens, output_tokens) of the judge call per
    question: the claims block in, the verdict reasonings out."""
    out = judge.groupBy("qid").agg(F.sum(token_count("reasoning")).cast("long").alias("output_tokens"))
    return block_tokens.select("qid", F.col("block_tokens").alias("input_tokens")).join(out, "qid", "left") \
        .select("qid", F.lit(model).alias("model"), "input_tokens",
                F.coalesce("output_tokens", F.lit(0)).cast("long").alias("output_tokens"))


def retrieval_quality(hits: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """recall@k and precision@k of search hits against a truth table
    (qid, paper_id); only questions with at least one true document count."""
    t = truth.select("qid", "paper_id").distinct()
    per_q = t.groupBy("qid").agg(F.count(F.lit(1)).alias("_rel"))
    got = (hits.filter(F.col("rank") <= k).select("qid", "paper_id")
               .join(t, ["qid", "paper_id"], "left_semi")
               .groupBy("qid").agg(F.count(F.lit(1)).alias("_hit")))
    j = per_q.join(got, "qid", "left").withColumn("_hit", F.coalesce("_hit", F.lit(0)))
    return j.agg(
        F.count(F.lit(1)).cast("long").alias("questions_with_truth"),
        F.count_if(F.col("_hit") > 0).cast("long").alias("questions_hit"),
        F.coalesce(F.sum("_hit"), F.lit(0)).cast("long").alias("relevant_retrieved"),
        F.coalesce(F.sum("_rel"), F.lit(0)).cast("long").alias("relevant_total"),
        F.bround(F.coalesce(F.avg(F.col("_hit") / F.col("_rel")), F.lit(0.0)), 4).alias("recall_at_k"),
        F.bround(_rate(F.sum("_hit"), F.count(F.lit(1)) * F.lit(k)), 4).alias("precision_at_k"))
