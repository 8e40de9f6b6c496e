"""The grounding guardrail as joins: support check (M3 default), unknown
citations (J6), the verdict join (J5), citation rendering (F8), claim lines
(F9), per-answer counts (A3) and the final answer (A4, P12).

Unsupported claims are reported, never dropped: every claim row yields one
line, in the answer's "Could not verify" section when it is not supported.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions.text import strip_ws, tokens
from evidentia.operators.claims import claim_citations, py_list
from evidentia.operators.models import builtin_model

# --- fixed values: the answer texts ----------------------------------------
FINDINGS_HEADER = "## Findings\n\n"
GAPS_HEADER = ("## Could not verify\n\n"
               "The following claims were not supported by the retrieved source "
               "text and are reported as a gap rather than included above:\n\n")
NO_SUPPORT_PREFACE = ("The corpus does not contain enough directly supporting evidence "
                      "to answer this question with traceable citations.")
EMPTY_ANSWER = ("## Could not verify\n\n"
                "No claims could be synthesized from the retrieved papers for this "
                "question. The corpus does not appear to contain relevant coverage.\n")
NOT_CHECKED = "not checked"
# ---------------------------------------------------------------------------

DEFAULT_MIN_CONTAINMENT = 0.8


def doc_token_sets(retrieved: DataFrame) -> DataFrame:
    """(paper_id, tok): distinct lower-case tokens of every retrieved text,
    computed once per distinct paper however many questions retrieved it."""
    docs = retrieved.select("paper_id", "abstract").dropDuplicates(["paper_id"])
    return docs.select("paper_id", F.explode(F.array_distinct(tokens("abstract"))).alias("tok"))


@builtin_model
def support_check(claims: DataFrame, retrieved: DataFrame,
                  min_containment: float = DEFAULT_MIN_CONTAINMENT) -> DataFrame:
    """Built-in lexical support checker: a claim is supported when at least
    ``min_containment`` of its distinct tokens occur in the texts it cites
    that were retrieved. One verdict per claim row (qid, claim_pos)."""
    ct = claims.select("qid", "claim_pos", F.explode(F.array_distinct(tokens("text"))).alias("tok"))
    cited = (claim_citations(claims).select("qid", "claim_pos", "paper_id")
             .join(retrieved.select("qid", "paper_id"), ["qid", "paper_id"], "left_semi")
             .dropDuplicates())
    found = (ct.join(cited, ["qid", "claim_pos"])
               .join(doc_token_sets(retrieved), ["paper_id", "tok"], "left_semi")
               .select("qid", "claim_pos", "tok").distinct()
               .groupBy("qid", "claim_pos").agg(F.count(F.lit(1)).alias("_m")))
    total = F.size(F.array_distinct(tokens("text")))
    j = claims.join(found, ["qid", "claim_pos"], "left").withColumn("_m", F.coalesce("_m", F.lit(0)))
    supported = (total > 0) & (F.col("_m").cast("double") >= F.lit(min_containment) * total.cast("double"))
    reason = F.concat(F.lit("matched "), F.col("_m").cast("string"), F.lit(" of "),
                      total.cast("string"), F.lit(" claim tokens"))
    return j.select("qid", "claim_pos", "claim_id", supported.alias("supported"), reason.alias("reasoning"))


def last_verdict(verdicts: DataFrame, value_cols: list[str], order_col: str = "claim_pos") -> DataFrame:
    """One verdict per (qid, claim_id): the last one wins."""
    packed = F.struct(*value_cols)
    g = verdicts.groupBy("qid", "claim_id").agg(F.max_by(packed, F.col(order_col)).alias("_v"))
    return g.select("qid", "claim_id", *[F.col("_v")[c].alias(c) for c in value_cols])


def citation_render(claims: DataFrame, retrieved: DataFrame) -> DataFrame:
    """(qid, claim_pos, cite, unknown_ids): '[id](url)' for retrieved ids and
    '[id]' otherwise, joined by a space in citation order (F8); the ids never
    retrieved, in citation order with repeats kept (J6)."""
    r = retrieved.select("qid", "paper_id", "url")
    c = claim_citations(claims).join(r, ["qid", "paper_id"], "left")
    rendered = F.when(F.col("url").isNotNull(),
                      F.concat(F.lit("["), F.col("paper_id"), F.lit("]("), F.col("url"), F.lit(")"))
                      ).otherwise(F.concat(F.lit("["), F.col("paper_id"), F.lit("]")))
    g = c.groupBy("qid", "claim_pos").agg(
        F.array_sort(F.collect_list(F.struct("pos", rendered.alias("r"),
                                             F.col("url").isNull().alias("u"), "paper_id"))).alias("_cs"))
    return g.select(
        "qid", "claim_pos",
        F.array_join(F.transform("_cs", lambda x: x["r"]), " ").alias("cite"),
        F.transform(F.filter("_cs", lambda x: x["u"]), lambda x: x["paper_id"]).alias("unknown_ids"))


def claim_status(claims: DataFrame, verdicts: DataFrame, retrieved: DataFrame) -> DataFrame:
    """The verdict join (J5) and the claim line (F9), one row per claim row.

    Precedence: a cited id never retrieved makes the claim unsupported
    whatever the verdict; then a supported verdict; otherwise unsupported
    with the verdict's reasoning, or 'not checked' when there is none.
    Verdicts repeated for a claim id: the last one wins.
    """
    v = last_verdict(verdicts, ["supported", "reasoning"])
    cr = citation_render(claims, retrieved)
    j = (claims.join(cr, ["qid", "claim_pos"], "left")
               .join(v, ["qid", "claim_id"], "left"))
    cite = F.coalesce(F.col("cite"), F.lit(""))
    unknown = F.coalesce(F.col("unknown_ids"), F.array().cast("array<string>"))
    has_unknown = F.size(unknown) > 0
    supported = F.when(has_unknown, F.lit(False)).when(F.col("supported") == F.lit(True), F.lit(True)) \
                 .otherwise(F.lit(False))
    reason = F.coalesce(F.col("reasoning"), F.lit(NOT_CHECKED))
    line = (F.when(has_unknown, F.concat(F.lit("- "), F.col("text"), F.lit(" (cited "), cite, F.lit(", but "),
                                         py_list(unknown), F.lit(" were never retrieved)")))
             .when(supported, F.concat(F.lit("- "), F.col("text"), F.lit(" "), cite))
             .otherwise(F.concat(F.lit("- "), F.col("text"), F.lit(" (cited "), cite, F.lit(": "), reason, F.lit(")"))))
    return j.select("qid", "claim_pos", "claim_id", "text", "paper_ids", cite.alias("cite"),
                    unknown.alias("unknown_ids"), supported.alias("claim_supported"),
                    reason.alias("reason"), line.alias("line"))


def claim_supported_by_id(status: DataFrame) -> DataFrame:
    """(qid, claim_id, validator_supported): last claim row per id wins."""
    return status.groupBy("qid", "claim_id").agg(
        F.max_by("claim_supported", "claim_pos").alias("validator_supported"))


def answer_counts(questions: DataFrame, status: DataFrame) -> DataFrame:
    """(qid, claim_count, supported_count, unsupported_count), zeros for
    questions without claims (A3)."""
    g = status.groupBy("qid").agg(
        F.count(F.lit(1)).alias("claim_count"),
        F.count_if("claim_supported").alias("supported_count"),
        F.count_if(~F.col("claim_supported")).alias("unsupported_count"))
    j = questions.select("qid").join(g, "qid", "left")
    return j.select("qid", *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
                             for c in ("claim_count", "supported_count", "unsupported_count")])


def final_answer(questions: DataFrame, status: DataFrame) -> DataFrame:
    """(qid, final_markdown, supported_count, unsupported_count) for every
    question (A4). Findings first, then the gap section; the preface when
    nothing is supported; the fixed empty answer when there are no claims."""
    g = status.groupBy("qid").agg(
        F.array_sort(F.collect_list(F.struct("claim_pos", "claim_supported", "line"))).alias("_ls"))
    sup = F.transform(F.filter("_ls", lambda x: x["claim_supported"]), lambda x: x["line"])
    uns = F.transform(F.filter("_ls", lambda x: ~x["claim_supported"]), lambda x: x["line"])
    findings = F.when(F.size(sup) > 0, F.concat(F.lit(FINDINGS_HEADER), F.array_join(sup, "\n")))
    gaps = F.when(F.size(uns) > 0, F.concat(F.lit(GAPS_HEADER), F.array_join(uns, "\n")))
    preface = F.when(F.size(sup) == 0, F.lit(NO_SUPPORT_PREFACE))
    md = F.concat(F.concat_ws("\n\n", preface, findings, gaps), F.lit("\n"))
    a = g.select("qid", md.alias("md"), F.size(sup).cast("long").alias("s"), F.size(uns).cast("long").alias("u"))
    j = questions.select("qid").join(a, "qid", "left")
    return j.select("qid", F.coalesce("md", F.lit(EMPTY_ANSWER)).alias("final_markdown"),
                    F.coalesce("s", F.lit(0)).cast("long").alias("supported_count"),
                    F.coalesce("u", F.lit(0)).cast("long").alias("unsupported_count"))


# --- reading answers back (F15, F16) ----------------------------------------

CITATION_LINK = r"\[([^\]]+)\]\((https?://[^\s)]+)\)"


def parse_citations(answers: DataFrame, md_col: str = "final_markdown") -> DataFrame:
    """(qid, pos, label, url) for every '[label](http...)' link in an answer."""
    labels = F.regexp_extract_all(F.col(md_col), F.lit(CITATION_LINK), 1)
    urls = F.regexp_extract_all(F.col(md_col), F.lit(CITATION_LINK), 2)
    z = answers.select("qid", F.posexplode(F.arrays_zip(labels.alias("label"), urls.alias("url"))).alias("pos", "z"))
    return z.select("qid", (F.col("pos") + 1).cast("int").alias("pos"),
                    F.col("z")["label"].alias("label"), F.col("z")["url"].alias("url"))


def parse_answer(answers: DataFrame, md_col: str = "final_markdown") -> DataFrame:
    """Answer text to rows (qid, line_no, kind, section, text): '## ' header,
    '- ' bullet, blank, or paragraph; section = the last header so far."""
    lines = answers.select("qid", F.posexplode(F.split(F.col(md_col), "\n")).alias("i", "line"))
    kind = (F.when(F.col("line").startswith("## "), F.lit("header"))
             .when(F.col("line").startswith("- "), F.lit("bullet"))
             .when(strip_ws("line") == "", F.lit("blank"))
             .otherwise(F.lit("paragraph")))
    text = (F.when(F.col("line").startswith("## "), F.expr("substring(line, 4)"))
             .when(F.col("line").startswith("- "), F.expr("substring(line, 3)"))
             .otherwise(F.col("line")))
    w = Window.partitionBy("qid").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hdr = F.when(F.col("line").startswith("## "), F.expr("substring(line, 4)"))
    return lines.select("qid", (F.col("i") + 1).cast("int").alias("line_no"), kind.alias("kind"),
                        F.last(hdr, ignorenulls=True).over(w).alias("section"), text.alias("text"))
