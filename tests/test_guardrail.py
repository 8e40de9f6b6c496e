"""Rules E9-E14 of the verdict join and the answer text."""

from pyspark.sql import functions as F

from evidentia.operators import guardrail as G

RETRIEVED = [(1, 1, "p1", "https://u/p1", "text one"), (1, 2, "p2", "https://u/p2", "text two")]


def frames(spark, claims, verdicts):
    r = spark.createDataFrame(RETRIEVED, "qid long, rank int, paper_id string, url string, abstract string")
    c = spark.createDataFrame(claims, "qid long, claim_pos int, claim_id int, text string, paper_ids array<string>")
    v = spark.createDataFrame(verdicts, "qid long, claim_pos int, claim_id int, supported boolean, reasoning string")
    return c, v, r


def status(spark, claims, verdicts):
    c, v, r = frames(spark, claims, verdicts)
    return {x.claim_pos: x for x in G.claim_status(c, v, r).collect()}


def test_unknown_citation_beats_supported(spark):  # E9
    st = status(spark, [(1, 1, 1, "A.", ["p1", "zz", "zz"])], [(1, 1, 1, True, "ok")])
    s = st[1]
    assert s.claim_supported is False
    assert s.unknown_ids == ["zz", "zz"]            # citation order, repeats kept
    assert s.line == "- A. (cited [p1](https://u/p1) [zz] [zz], but ['zz', 'zz'] were never retrieved)"


def test_claim_citing_nothing(spark):  # E10
    st = status(spark, [(1, 1, 1, "B.", [])], [(1, 1, 1, True, "ok")])
    assert st[1].claim_supported is True
    assert st[1].line == "- B. "


def test_missing_verdict_not_checked(spark):  # E11
    st = status(spark, [(1, 1, 1, "C.", ["p2"])], [(1, 1, 99, True, "other")])
    assert st[1].claim_supported is False
    assert st[1].line == "- C. (cited [p2](https://u/p2): not checked)"


def answers(spark, claims, verdicts, qids=(1,)):
    c, v, r = frames(spark, claims, verdicts)
    q = spark.createDataFrame([(q,) for q in qids], "qid long")
    return {a.qid: a for a in G.final_answer(q, G.claim_status(c, v, r)).collect()}


def test_preface_and_empty_answer(spark):  # E12
    a = answers(spark, [(1, 1, 1, "D.", ["p1"])], [(1, 1, 1, False, "no")], qids=(1, 2))
    assert a[1].final_markdown.startswith(G.NO_SUPPORT_PREFACE + "\n\n## Could not verify")
    assert a[1].final_markdown.endswith("- D. (cited [p1](https://u/p1): no)\n")
    assert a[2].final_markdown == G.EMPTY_ANSWER             # no claims: no preface
    assert (a[2].supported_count, a[2].unsupported_count) == (0, 0)


def test_mixed_sections_order(spark):  # E13
    claims = [(1, 1, 1, "E1.", ["p1"]), (1, 2, 2, "E2.", ["p2"]), (1, 3, 3, "E3.", ["p1"])]
    verdicts = [(1, 1, 1, True, "y"), (1, 2, 2, False, "n"), (1, 3, 3, True, "y")]
    md = answers(spark, claims, verdicts)[1].final_markdown
    assert md == ("## Findings\n\n- E1. [p1](https://u/p1)\n- E3. [p1](https://u/p1)\n\n"
                  + G.GAPS_HEADER + "- E2. (cited [p2](https://u/p2): n)\n")
    assert G.NO_SUPPORT_PREFACE not in md


def test_repeated_claim_ids(spark):  # E14
    claims = [(1, 1, 7, "F1.", ["p1"]), (1, 2, 7, "F2.", ["p1"])]
    verdicts = [(1, 1, 7, False, "first"), (1, 2, 7, True, "last")]
    c, v, r = frames(spark, claims, verdicts)
    st = G.claim_status(c, v, r)
    rows = {x.claim_pos: x for x in st.collect()}
    assert rows[1].claim_supported and rows[2].claim_supported   # last verdict wins for both lines
    by_id = G.claim_supported_by_id(st).collect()
    assert len(by_id) == 1 and by_id[0].validator_supported is True


def test_support_check_threshold(spark):
    claims = [(1, 1, 1, "text one two", ["p1", "p2"]), (1, 2, 2, "nothing here", ["p1"]),
              (1, 3, 3, "text one", ["zz"])]
    c, _, r = frames(spark, claims, [])
    v = {x.claim_pos: x for x in G.support_check(c, r).collect()}
    assert v[1].supported is True and v[1].reasoning == "matched 3 of 3 claim tokens"
    assert v[2].supported is False
    assert v[3].supported is False                 # cited text never retrieved: no evidence


def test_parse_answer_and_citations(spark):
    md = "## Findings\n\n- a [x](https://u/x)\npara\n"
    df = spark.createDataFrame([(1, md)], "qid long, final_markdown string")
    lines = [(r.line_no, r.kind, r.section, r.text) for r in G.parse_answer(df).orderBy("line_no").collect()]
    assert lines[0] == (1, "header", "Findings", "Findings")
    assert lines[2] == (3, "bullet", "Findings", "a [x](https://u/x)")
    assert lines[3][1] == "paragraph"
    cites = G.parse_citations(df).collect()
    assert [(c.label, c.url) for c in cites] == [("x", "https://u/x")]
