"""The answer pipeline over a whole table of questions (M7):

questions -> embed (M1) -> top-k search (J1) -> retrieve (P3) -> claim writer
(M2) -> support checker (M3) -> verdict join (J5/J6) -> final answer (A4)

and the evaluation that follows it: judge (M4) -> records (J7) -> per
question results (A7) -> metrics (A5). Every step is a DataFrame function;
the model steps are replaceable callables with the same contract.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.functions.embed import hashed_tf
from evidentia.operators import claims as C
from evidentia.operators import evaluate as E
from evidentia.operators import guardrail as G
from evidentia.operators.retrieve import retrieve
from evidentia.operators.search import DEFAULT_K, knn
from evidentia.operators.sizing import spread
from evidentia.operators.models import builtin_model, is_builtin
from evidentia.session import cut_lineage

Embedder = Callable[[DataFrame, str, str], DataFrame]


def builtin_embedder(df: DataFrame, key: str, text: str) -> DataFrame:
    return hashed_tf(df, key, text).select(key, "embedding")


@dataclass
class Answers:
    questions: DataFrame
    hits: DataFrame
    retrieved: DataFrame
    claims: DataFrame
    verdicts: DataFrame
    status: DataFrame
    answers: DataFrame
    counts: DataFrame

    def unpersist(self) -> None:
        for f in (self.questions, self.hits, self.retrieved, self.claims, self.verdicts, self.status):
            f.unpersist()


def answer(questions: DataFrame, corpus_vectors: DataFrame, papers: DataFrame, *,
           k: int = DEFAULT_K, embed: Embedder = builtin_embedder,
           write_claims=None, check_support=None, persist: bool = True) -> Answers:
    """Answer every question. ``corpus_vectors(paper_id, embedding)`` must
    come from the same embedder as the questions; ``papers`` holds the text
    columns joined after top-k (late materialisation).

    Every intermediate table here is bounded by the question table (k hits,
    a few claims per question) and feeds several later steps, so with
    ``persist`` each is kept once (memory and disk). The output of a model
    step that is not one of the built-in lexical models (a paid call) is
    written once to the shared ``spark.checkpoint.dir`` instead, so a lost
    executor never repeats the calls; built-in steps are recomputed from
    lineage, which is cheap and deterministic."""
    keep = (lambda df: df.persist()) if persist else (lambda df: df)

    def after(step, df):
        if persist and not is_builtin(step):
            return cut_lineage(df, "model-output").persist()
        return keep(df)

    write_claims = write_claims or _extractive_writer
    check_support = check_support or G.support_check
    questions = keep(questions)
    n_q = questions.count()
    qv = embed(questions.select("qid", "question"), "qid", "question")
    hits = keep(knn(qv, corpus_vectors, k))
    # retrieved texts feed every lexical step; spread them over the cores
    # when the corpus scan that produced them was not (one big input file)
    retrieved = keep(spread(retrieve(hits, papers, hits_rows_bound=n_q * k)))
    claims = after(write_claims, write_claims(questions, retrieved, hits))
    verdicts = after(check_support, check_support(claims, retrieved))
    status = keep(G.claim_status(claims, verdicts, retrieved))
    answers = G.final_answer(questions, status)
    counts = G.answer_counts(questions, status)
    return Answers(questions, hits, retrieved, claims, verdicts, status, answers, counts)


@builtin_model
def _extractive_writer(questions, retrieved, hits):
    return C.extractive_claims(questions, retrieved)


@dataclass
class Evaluation:
    judge: DataFrame
    records: DataFrame
    results: DataFrame
    metrics: DataFrame


def evaluate(a: Answers, *, judge=None, judge_model: str = "lexical-judge",
             pricing: DataFrame | None = None, persist: bool = True) -> Evaluation:
    """Grade every claim with an independent judge and roll up the metrics.
    The judge's token usage is priced by ``judge_model`` (unknown -> 0).
    A judge that is not a built-in model has its verdicts written once,
    like the pipeline's model outputs."""
    judge = judge or E.judge_check
    jv = judge(a.claims, a.retrieved)
    if persist:
        jv = jv.persist() if is_builtin(judge) else cut_lineage(jv, "judge").persist()
    records = E.claim_records(a.claims, G.claim_supported_by_id(a.status), jv)
    cost = None
    if pricing is not None:
        from evidentia.functions.cost import with_cost
        usage = E.judge_usage(C.claims_block_tokens(a.claims, a.retrieved), jv, judge_model)
        cost = with_cost(usage, pricing).select("qid", "cost_usd")
    results = E.question_results(a.questions, a.counts, records, cost)
    metrics = E.grounding_metrics(results, records)
    return Evaluation(jv, records, results, metrics)


def nested_results(ev: Evaluation) -> DataFrame:
    """One row per question as written by the result sink."""
    return ev.results.select(F.col("qid").alias("id"), "expected_status", "claim_count",
                             "supported_count", "unsupported_count", "answerability_match", "claims")


def write_results(ev: Evaluation, path: str, run_date: str, models: dict[str, str]) -> None:
    """Nested evaluation output: questions as JSON lines under path/questions,
    and the one-row metrics/run header under path/run. Nothing is gathered
    on the driver."""
    nested_results(ev).write.mode("overwrite").json(f"{path}/questions")
    hdr = ev.metrics.select(F.lit(run_date).alias("run_date"),
                            F.struct(*[F.lit(v).alias(k) for k, v in models.items()]).alias("models"),
                            F.struct(*ev.metrics.columns).alias("metrics"))
    hdr.coalesce(1).write.mode("overwrite").json(f"{path}/run")


# Model names recorded per step when the caller gives none: the built-in
# lexical models (not in the price table, so they cost 0).
BUILTIN_STEP_MODELS = {"search_corpus": "hashed-tf-256", "synthesize": "extractive-writer",
                       "validate": "lexical-checker", "orchestrator": "fixed-order"}


def step_trace(a: Answers, pricing: DataFrame, k: int = DEFAULT_K, models: dict | None = None) -> DataFrame:
    """One trace per question (run_id = qid) with a row per step, in call
    order: search_corpus, retrieve, synthesize, validate, and last the
    orchestrator that hands out the answer (U3, W3). A step
    that needed no model call (nothing retrieved, no claims) still writes
    its row, with model null and cost 0 (E21)."""
    from evidentia.functions.cost import with_cost
    from evidentia.functions.text import token_count
    m = dict(BUILTIN_STEP_MODELS, **(models or {}))
    q = a.questions.select("qid", "question")
    n_hits = a.hits.groupBy("qid").agg(F.count(F.lit(1)).alias("_n"))
    n_ret = a.retrieved.groupBy("qid").agg(F.count(F.lit(1)).alias("_n"))
    n_cl = a.claims.groupBy("qid").agg(F.count(F.lit(1)).alias("_n"), F.sum(token_count("text")).alias("_out"))
    rs = a.verdicts.groupBy("qid").agg(F.sum(token_count("reasoning")).alias("_out"))
    cnt = a.counts
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")

    def row(df, step, tool, model, tin, tout, summary):
        return df.select(F.col("qid").alias("run_id"), F.lit(step).alias("step"), F.lit(tool).alias("tool"),
                         model.alias("model"), tin.cast("long").alias("input_tokens"),
                         tout.cast("long").alias("output_tokens"), summary.alias("output_summary"))

    search = row(q.join(n_hits, "qid", "left"), 1, "search_corpus", F.lit(m["search_corpus"]),
                 token_count("question"), F.lit(0), F.concat(z("_n").cast("string"), F.lit(" results")))
    retr = row(q.join(n_ret, "qid", "left"), 2, "retrieve", F.lit(None).cast("string"), F.lit(0), F.lit(0),
               F.concat(z("_n").cast("string"), F.lit(" papers")))
    has_papers = F.col("_n").isNotNull()
    syn_in = q.join(n_ret.select("qid", "_n"), "qid", "left").join(
        C.prompt_tokens(a.questions, a.retrieved), "qid", "left").join(
        n_cl.select("qid", F.col("_n").alias("_c"), "_out"), "qid", "left")
    synth = row(syn_in, 3, "synthesize", F.when(has_papers, F.lit(m["synthesize"])),
                F.when(has_papers, z("prompt_tokens")).otherwise(F.lit(0)),
                F.when(has_papers, z("_out")).otherwise(F.lit(0)),
                F.when(has_papers, F.concat(z("_c").cast("string"), F.lit(" claims")))
                 .otherwise(F.lit("0 claims (nothing retrieved)")))
    val_in = (cnt.join(C.claims_block_tokens(a.claims, a.retrieved), "qid", "left").join(rs, "qid", "left"))
    has_claims = F.col("claim_count") > 0
    valid = row(val_in, 4, "validate", F.when(has_claims, F.lit(m["validate"])),
                F.when(has_claims, z("block_tokens")).otherwise(F.lit(0)),
                F.when(has_claims, z("_out")).otherwise(F.lit(0)),
                F.when(has_claims, F.concat(F.col("supported_count").cast("string"), F.lit(" supported, "),
                                            F.col("unsupported_count").cast("string"), F.lit(" unsupported")))
                 .otherwise(F.lit("0 claims to validate (empty synthesis)")))
    last = row(q.join(a.answers.select("qid", "final_markdown"), "qid"), 5, "orchestrator", F.lit(m["orchestrator"]),
               token_count("question"), token_count("final_markdown"), F.lit("final answer"))
    u = search.unionByName(retr).unionByName(synth).unionByName(valid).unionByName(last)
    # every run has exactly these steps, so the call order is the step
    return with_cost(u, pricing).withColumn("seq", F.col("step").cast("long")).drop("step")


def run_evaluation(a: Answers, out_path: str, run_date: str, models: dict[str, str], *,
                   judge=None, judge_model: str = "lexical-judge", pricing: DataFrame | None = None,
                   max_unsupported_rate: float | None = None,
                   max_false_refusal_rate: float | None = None) -> tuple[Evaluation, DataFrame]:
    """The evaluation job: judge every claim, write the nested results
    (S10), and return the regression gate (P11) next to the evaluation.
    ``gate.filter('failed').count() > 0`` is the failing exit status."""
    ev = evaluate(a, judge=judge, judge_model=judge_model, pricing=pricing)
    write_results(ev, out_path, run_date, models)
    return ev, E.gate(ev.metrics, max_unsupported_rate, max_false_refusal_rate)


def search_question(spark, question: str, corpus_vectors: DataFrame, papers: DataFrame,
                    k: int = DEFAULT_K, embed: Embedder = builtin_embedder) -> DataFrame:
    """One question as text, the k best papers: (rank, paper_id, title,
    score), ordered by distance then id (J2, P6). The question's vector is
    made by the same embedder as the corpus's."""
    from evidentia.operators.search import search_one
    q = spark.createDataFrame([(0, question)], "qid long, question string")
    v = embed(q, "qid", "question").select("embedding")
    hits = search_one(v, corpus_vectors, k)
    titles = papers.select("paper_id", "title")
    return (titles.join(F.broadcast(hits), "paper_id")          # k rows
                  .select("rank", "paper_id", "title", "score").orderBy("rank"))
