"""Claim tables: the built-in claim writer (M2 default), claim evidence
and the per-question claims block a support checker reads (A2).

A claim row is (qid, claim_pos, claim_id, text, paper_ids). ``claim_pos`` is
the order in which the writer emitted the claims; ``claim_id`` is the
writer's own id and may repeat.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions.text import sentences, token_count, tokens


def py_list(ids_col) -> F.Column:
    """Render an array of id strings as a Python list literal: ['a', 'b']."""
    return F.concat(F.lit("["), F.array_join(F.transform(ids_col, lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", "),
                    F.lit("]"))


# --- fixed values of the built-in claim writer ----------------------------------
MIN_PERCENT = 60               # share of a sentence's tokens that the question must hold
# ----------------------------------------------------------------------------------


def extractive_claims(questions: DataFrame, retrieved: DataFrame, max_claims: int | None = None,
                      min_percent: int = MIN_PERCENT, min_top_score: float | None = None,
                      hits: DataFrame | None = None) -> DataFrame:
    """Built-in lexical claim writer: sentences of the retrieved texts.

    A sentence is a claim if at least ``min_percent`` of its distinct tokens
    (it has one at least) occur in the question. Claims come by the share,
    the largest first (ties: paper rank, then place in the text), each citing
    the paper it stands in (claim_id = claim_pos = 1, 2, ...); with
    ``max_claims`` only so many are kept. A question that no
    retrieved sentence addresses gets no claim, as does one whose best hit
    scores below ``min_top_score``."""
    r = retrieved
    if min_top_score is not None:
        if hits is None:
            raise ValueError("min_top_score needs the search hits")
        best = hits.groupBy("qid").agg(F.max("score").alias("_best")).filter(F.col("_best") >= F.lit(min_top_score))
        r = r.join(best.select("qid"), "qid", "left_semi")
    s = r.select("qid", "rank", "paper_id", F.posexplode(sentences("abstract")).alias("_p", "_s"))
    s = s.withColumn("_t", F.array_distinct(tokens("_s"))).filter(F.size("_t") > 0)
    q = questions.select("qid", F.array_distinct(tokens("question")).alias("_q"))
    j = s.join(q, "qid").withColumn("_o", F.size(F.array_intersect("_t", "_q")))
    j = j.filter(F.col("_o") * 100 >= F.size("_t") * min_percent)
    order = Window.partitionBy("qid").orderBy((F.col("_o").cast("double") / F.size("_t")).desc(), "rank", "_p", "paper_id")
    top = j.withColumn("claim_pos", F.row_number().over(order).cast("int"))
    if max_claims is not None:
        top = top.filter(F.col("claim_pos") <= max_claims)
    return top.select("qid", "claim_pos", F.col("claim_pos").alias("claim_id"), F.trim("_s").alias("text"),
                      F.array("paper_id").alias("paper_ids"))


def claim_citations(claims: DataFrame) -> DataFrame:
    """(qid, claim_pos, claim_id, pos, paper_id): one row per citation."""
    return claims.select("qid", "claim_pos", "claim_id",
                         F.posexplode("paper_ids").alias("pos", "paper_id"))


def claim_evidence(claims: DataFrame, retrieved: DataFrame) -> DataFrame:
    """Citations with the cited text when the id was retrieved (J4);
    ids never retrieved keep a null text."""
    r = retrieved.select("qid", "paper_id", "abstract", "url")
    return claim_citations(claims).join(r, ["qid", "paper_id"], "left")


def claims_block(claims: DataFrame, retrieved: DataFrame) -> DataFrame:
    """(qid, n_claims, block): what a support checker is shown, per question:
    each claim's id, text and cited ids, then the text of every cited id
    that was retrieved, claims joined by blank lines in claim order."""
    ev = claim_evidence(claims, retrieved)
    src = ev.filter(F.col("abstract").isNotNull()).groupBy("qid", "claim_pos").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(
            "pos", F.concat(F.lit("--- source text for "), F.col("paper_id"), F.lit(" ---\n"),
                            F.col("abstract")).alias("s")))), lambda x: x["s"]), "\n").alias("_src"))
    head = F.concat(F.lit("claim_id: "), F.col("claim_id").cast("string"), F.lit("\nclaim_text: "),
                    F.col("text"), F.lit("\ncited_paper_ids: "), py_list(F.col("paper_ids")), F.lit("\n"))
    per_claim = claims.join(src, ["qid", "claim_pos"], "left").select(
        "qid", "claim_pos", F.concat(head, F.coalesce(F.col("_src"), F.lit(""))).alias("b"))
    return per_claim.groupBy("qid").agg(
        F.count(F.lit(1)).alias("n_claims"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("claim_pos", "b"))),
                                 lambda x: x["b"]), "\n\n").alias("block"))


def _doc_tokens(retrieved: DataFrame) -> DataFrame:
    """(paper_id, _dt): token count of each distinct retrieved text, once."""
    return (retrieved.select("paper_id", "abstract").dropDuplicates(["paper_id"])
                     .select("paper_id", token_count("abstract").alias("_dt")))


def claims_block_tokens(claims: DataFrame, retrieved: DataFrame) -> DataFrame:
    """(qid, block_tokens): token count of ``claims_block`` without building
    it. Every part of the block is joined to the next by a newline, which
    is never part of a token, so counts add up: per claim its header, plus
    per retrieved citation the source line and the text (counted once per
    distinct text)."""
    cit = (claim_citations(claims).join(retrieved.select("qid", "paper_id"), ["qid", "paper_id"], "left_semi")
           .join(_doc_tokens(retrieved), "paper_id")
           .select("qid", (token_count(F.concat(F.lit("--- source text for "), F.col("paper_id"), F.lit(" ---")))
                           + F.col("_dt")).alias("_t")))
    head = F.concat(F.lit("claim_id: "), F.col("claim_id").cast("string"), F.lit("\nclaim_text: "),
                    F.col("text"), F.lit("\ncited_paper_ids: "), py_list(F.col("paper_ids")))
    heads = claims.select("qid", token_count(head).alias("_t"))
    return heads.unionByName(cit).groupBy("qid").agg(F.sum("_t").cast("long").alias("block_tokens"))


def prompt_tokens(questions: DataFrame, retrieved: DataFrame) -> DataFrame:
    """(qid, prompt_tokens): token count of the claim writer's prompt
    (``retrieve.sources_block``), added up part by part in the same way."""
    q = questions.join(retrieved.select("qid").distinct(), "qid", "left_semi").select(
        "qid", token_count(F.concat(F.lit("Research question: "), F.col("question"),
                                    F.lit("\n\nRetrieved abstracts:"))).alias("_t"))
    per = retrieved.join(_doc_tokens(retrieved), "paper_id").select(
        "qid", (token_count(F.concat(F.lit("paper_id: "), F.col("paper_id"), F.lit("\ntitle: "), F.col("title"),
                                     F.lit("\nabstract: "))) + F.col("_dt")).alias("_t"))
    return q.unionByName(per).groupBy("qid").agg(F.sum("_t").cast("long").alias("prompt_tokens"))
