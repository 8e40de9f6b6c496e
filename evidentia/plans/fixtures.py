"""The test tables mapped onto the engine's inputs (see FIXTURES.md §3).

corpus     documents (+ embeddings for stored vectors)
questions  benchmark items, labelled by verbatim containment
claims     the built-in writer's claims, with a fabricated citation added
           to every third claim so the unknown-citation rule is exercised
"""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions.cost import pricing_frame
from evidentia.operators import claims as C
from evidentia.operators import guardrail as G
from evidentia.operators.compare import ModelRun
from evidentia.operators.models import builtin_model
from evidentia.plans.answering import Answers, answer, evaluate
from evidentia.sources.corpus import hashed_corpus, paper_texts
from evidentia.sources.questions import benchmark_truth, fixture_questions

# --- fixed values of the fixture mapping ------------------------------------
FABRICATE_EVERY = 3
FABRICATED_OFFSET = 1_000_000
JUDGE_MODEL = "gemini-3.1-pro-preview"   # judge usage is priced as this model
K = 5
# usage of each pipeline step is priced as the default model of that step
STEP_MODELS = {"search_corpus": "gemini-embedding-001", "synthesize": "gemini-3.1-pro-preview",
               "validate": "gemini-3.7-flash", "orchestrator": "gemini-3.7-flash"}
# ---------------------------------------------------------------------------


def with_fabricated_citations(claims: DataFrame, every: int = FABRICATE_EVERY,
                              offset: int = FABRICATED_OFFSET) -> DataFrame:
    """Claims whose id is a multiple of ``every`` also cite an id that was
    never retrieved: first cited id + ``offset`` (``x`` + id if it is no number)."""
    one = F.element_at("paper_ids", 1)
    fake = F.coalesce((one.try_cast("long") + F.lit(offset)).cast("string"), F.concat(F.lit("x"), one))
    pids = F.when((F.pmod(F.col("claim_id"), F.lit(every)) == 0) & (F.size("paper_ids") > 0),
                  F.concat(F.col("paper_ids"), F.array(fake))).otherwise(F.col("paper_ids"))
    return claims.withColumn("paper_ids", pids)


@builtin_model
def fixture_writer(questions, retrieved, hits):
    return with_fabricated_citations(C.extractive_claims(questions, retrieved))


def fixture_model(name: str, min_percent: int, strictness: float) -> ModelRun:
    """A model that writes claims from sentences overlapping the question by
    ``min_percent`` and supports those whose tokens its sources hold."""
    @builtin_model
    def write(questions, retrieved):
        return with_fabricated_citations(C.extractive_claims(questions, retrieved, min_percent=min_percent))

    @builtin_model
    def check(claims, retrieved):
        return G.support_check(claims, retrieved, strictness)
    return ModelRun(name, write, check)


def fixture_answers(spark: SparkSession, sf_dir: str, persist: bool = True,
                    truth: DataFrame | None = None) -> Answers:
    questions = fixture_questions(spark, sf_dir, truth)
    return answer(questions, hashed_corpus(spark, sf_dir).select("paper_id", "embedding"),
                  paper_texts(spark, sf_dir), k=K, write_claims=fixture_writer, persist=persist)


def fixture_evaluation(spark: SparkSession, sf_dir: str, persist: bool = True):
    a = fixture_answers(spark, sf_dir, persist)
    return a, evaluate(a, judge_model=JUDGE_MODEL, pricing=pricing_frame(spark))


def truth_pairs(spark: SparkSession, sf_dir: str, truth: DataFrame | None = None) -> DataFrame:
    """(qid, paper_id) of documents that contain the question verbatim."""
    t = truth if truth is not None else benchmark_truth(spark, sf_dir)
    return t.select(F.col("item_id").alias("qid"), F.col("doc_id").cast("string").alias("paper_id"))
