"""Claims ranked by a model of the corpus."""

import math
import re

from evidentia.operators.ranking import corpus_model, ranked_claims

PAPERS = [("p1", "Prompt patterns change code quality. Prompt patterns change the code quality of models. Tests help."),
          ("p2", "The prompt matters. Zero shot prompt patterns lower defects in code."),
          ("p3", "Models of code quality differ."), ("p4", None), ("p5", "")]
QUESTIONS = [(1, "effect of prompt patterns on code quality"),
             (2, "effect of prompt patterns on soil moisture sensor calibration"), (3, ""), (4, None)]


def frames(spark):
    papers = spark.createDataFrame(PAPERS, "paper_id string, abstract string")
    q = spark.createDataFrame(QUESTIONS, "qid long, question string")
    r = [(i, n + 1, p, t) for i, _ in QUESTIONS for n, (p, t) in enumerate(PAPERS)]
    return papers, q, spark.createDataFrame(r, "qid long, rank int, paper_id string, abstract string")


def test_weights_follow_the_corpus(spark):
    papers, _, _ = frames(spark)
    words = spark.createDataFrame([("prompt",), ("code",), ("soil",), ("soil",)], "token string")
    w, n, mean = corpus_model(papers, words)
    got = {r.token: r.idf for r in w.collect()}
    df = {t: sum(t in re.findall(r"\w+", (a or "").lower()) for _, a in PAPERS) for t in ("prompt", "code", "soil")}
    assert n == 4 and got.keys() == df.keys()
    assert all(math.isclose(got[t], math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5))) for t in df)
    lengths = [len(set(s.lower().split())) for _, a in PAPERS for s in re.findall(r"[^.!?]+[.!?]", a or "")]
    assert math.isclose(mean, sum(lengths) / len(lengths))


def test_other_subjects_get_no_claims_and_repeats_are_left_out(spark):
    papers, q, r = frames(spark)
    got = [(x.qid, x.claim_id, x.text, x.paper_ids) for x in
           ranked_claims(q, r, papers, min_cover=0.4).orderBy("qid", "claim_pos").collect()]
    assert {g[0] for g in got} == {1}, got
    texts = [g[2] for g in got]
    # the longer sentence with the same words ranks first by its weight; the other adds nothing
    assert len({t for t in texts if t.startswith("Prompt patterns change")}) == 1
    assert [g[1] for g in got] == list(range(1, len(got) + 1)) and all(len(g[3]) == 1 for g in got)
    every = ranked_claims(q, r, papers, min_cover=0.0, min_novel=0)
    # min_cover 0 keeps sentences that hold some word of the question
    assert every.filter("qid = 1").count() >= len(got) and every.filter("qid in (3, 4)").count() == 0


def test_empty_tables(spark):
    papers, q, r = frames(spark)
    assert ranked_claims(q, r.limit(0), papers).collect() == []
    assert ranked_claims(q.limit(0), r, papers).collect() == []
    assert ranked_claims(q, r, papers.limit(0)).schema == ranked_claims(q, r, papers).schema
