"""Rules E15-E18 and metric identities."""

from pyspark.sql import functions as F

from evidentia.operators import evaluate as E

CLAIMS = "qid long, claim_pos int, claim_id int, text string, paper_ids array<string>"


def test_missing_verdicts_are_false(spark):  # E15
    c = spark.createDataFrame([(1, 1, 1, "a", ["p"]), (1, 2, 2, "b", ["p"])], CLAIMS)
    v = spark.createDataFrame([(1, 1, True)], "qid long, claim_id int, validator_supported boolean")
    j = spark.createDataFrame([(1, 2, 2, True, "r")], "qid long, claim_pos int, claim_id int, grounded boolean, reasoning string")
    rec = {r.claim_id: r for r in E.claim_records(c, v, j).collect()}
    assert (rec[1].validator_supported, rec[1].judge_grounded) == (True, False)
    assert (rec[2].validator_supported, rec[2].judge_grounded) == (False, True)


def test_answerability_rules(spark):  # E16
    q = spark.createDataFrame([(1, "answerable"), (2, "unanswerable"), (3, "partial"), (4, "answerable")],
                              "qid long, expected_status string")
    c = spark.createDataFrame([(1, 2, 1, 1), (2, 1, 0, 1), (3, 0, 0, 0)],
                              "qid long, claim_count long, supported_count long, unsupported_count long")
    m = {r.qid: r.answerability_match for r in E.answerability(q, c).collect()}
    assert m == {1: True, 2: True, 3: True, 4: False}


def test_empty_denominators_give_zero(spark):  # E17
    res = spark.createDataFrame([], "answerability_match boolean, cost_usd double")
    rec = spark.createDataFrame([], "validator_supported boolean, judge_grounded boolean")
    m = E.grounding_metrics(res, rec).first()
    assert m.total_questions == 0 and m.total_claims == 0
    for k in ("unsupported_claim_rate", "citation_accuracy", "false_refusal_rate", "answerability_match_rate",
              "total_cost_usd"):
        assert m[k] == 0.0


def test_gate_strict(spark):  # E18
    m = spark.createDataFrame([(0.25, 0.5)], "unsupported_claim_rate double, false_refusal_rate double")
    g = {r.metric: r for r in E.gate(m, 0.25, 0.4).collect()}
    assert g["unsupported_claim_rate"].failed is False        # equal passes
    assert g["false_refusal_rate"].failed is True
    g2 = {r.metric: r.failed for r in E.gate(m, None, None).collect()}
    assert g2 == {"unsupported_claim_rate": False, "false_refusal_rate": False}


def test_label_metric_arithmetic(spark):
    from tests.conftest import SF_MID
    from evidentia.queries import label_metrics
    r = label_metrics(spark, SF_MID).first()
    assert r.total_claims == 399
    assert r.unsupported_claim_rate == round(49 / 348, 4)
    assert r.false_refusal_rate == round(42 / 51, 4)
    assert r.citation_accuracy == round(341 / 399, 4)


def test_confusion_cells_sum_to_claims(spark):
    from tests.conftest import SF_SMALL
    from evidentia.plans.fixtures import fixture_evaluation
    a, ev = fixture_evaluation(spark, SF_SMALL)
    n = ev.records.count()
    assert sum(r.n for r in E.verdict_confusion(ev.records).collect()) == n
    cnt = a.counts.agg(F.sum("claim_count").alias("c"), F.sum("supported_count").alias("s"),
                       F.sum("unsupported_count").alias("u")).first()
    assert cnt.c == cnt.s + cnt.u == n
    assert ev.metrics.first().total_claims == n


def test_run_evaluation_job(spark):  # S10 + P11 as one job
    import os, uuid
    from evidentia.plans.fixtures import fixture_answers
    from evidentia.plans.answering import run_evaluation
    from evidentia.session import checkpoint_dir
    from tests.conftest import SF_SMALL
    a = fixture_answers(spark, SF_SMALL)
    out = os.path.join(checkpoint_dir(spark), f"run-{uuid.uuid4().hex}")
    ev, gate = run_evaluation(a, out, "2026-12-02", {"judge": "lexical-judge"}, max_unsupported_rate=-1.0)
    assert spark.read.json(os.path.join(out, "questions")).count() == a.questions.count()
    failed = {r.metric: r.failed for r in gate.collect()}
    assert failed["unsupported_claim_rate"] is True and failed["false_refusal_rate"] is False
