"""Model comparison over one shared retrieval.

Retrieval is shared; each model writes its own claims, checks them, and
gets its own answer. The model list is a small parameter, not data.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.functions.cost import with_cost
from evidentia.functions.text import token_count
from evidentia.operators import claims as C
from evidentia.operators import guardrail as G
from evidentia.session import cut_lineage


@dataclass(frozen=True)
class ModelRun:
    """A priced model: its claim writer (questions, retrieved) -> claims, its
    support checker (claims, retrieved) -> verdicts, and, for a writer that
    measures it, ``latency`` (questions, retrieved) -> (qid, latency_ms).
    The built-in models make no calls, so their latency is 0."""
    name: str
    write_claims: Callable
    check_support: Callable
    latency: Callable | None = None


def _of_model(df: DataFrame, name) -> DataFrame:
    """Rows of one model (or of each, for a list): the run (qid, model) takes the place of the question id."""
    model = F.explode(F.array(*map(F.lit, name))) if isinstance(name, list) else F.lit(name)
    return df.withColumn("_model", model).withColumn("qid", F.struct("qid", F.col("_model").alias("model"))).drop("_model")


def model_runs(questions: DataFrame, retrieved: DataFrame, models: list[ModelRun], pricing: DataFrame) -> DataFrame:
    """Per (qid, model): claim_count, supported_count, unsupported_count,
    input_tokens, output_tokens, latency_ms, final_markdown, cost_usd.

    Each model writes its claims and checks them, and both are written once.
    From there on all models go through one plan, keyed by (qid, model): its
    size does not grow with the number of models. The retrieval is shared."""
    names = [m.name for m in models]
    if len(set(names)) < len(names):
        raise ValueError(f"repeated model names: {names}")
    made, checked, waits = [], [], []
    for m in models:
        claims = cut_lineage(m.write_claims(questions, retrieved), "model-claims")
        verdicts = m.check_support(claims, retrieved)
        made.append(_of_model(claims, m.name))
        checked.append(_of_model(verdicts, m.name))
        wait = questions.select("qid", F.lit(0.0).alias("latency_ms")) if m.latency is None else m.latency(questions, retrieved)
        waits.append(_of_model(wait.select("qid", "latency_ms"), m.name))
    union = lambda parts: reduce(lambda a, b: a.unionByName(b), parts)
    claims, verdicts, latency = union(made), cut_lineage(union(checked), "model-verdicts"), union(waits)
    asked = _of_model(questions.select("qid", "question"), names)
    sources = _of_model(retrieved.select("qid", "paper_id", "abstract", "url"), names)
    status = cut_lineage(G.claim_status(claims, verdicts, sources), "model-status")
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    prompt_in = _of_model(C.prompt_tokens(questions, retrieved), names).select("qid", F.col("prompt_tokens").alias("_pin"))
    r_out = verdicts.groupBy("qid").agg(F.sum(token_count("reasoning")).alias("_rout"))
    c_out = claims.groupBy("qid").agg(F.sum(token_count("text")).alias("_cout"))
    b_in = C.claims_block_tokens(claims, sources).select("qid", F.col("block_tokens").alias("_bin"))
    j = G.answer_counts(asked, status).join(G.final_answer(asked, status).select("qid", "final_markdown"), "qid")
    for part in (r_out, c_out, b_in, prompt_in, latency):
        j = j.join(part, "qid", "left")
    out = j.select("qid.qid", "qid.model", "claim_count", "supported_count", "unsupported_count",
                   (z("_pin") + z("_bin")).cast("long").alias("input_tokens"),
                   (z("_cout") + z("_rout")).cast("long").alias("output_tokens"), "latency_ms", "final_markdown")
    return with_cost(out, pricing)


def cost_ratio(runs: DataFrame, order: list[str]) -> DataFrame:
    """For questions run by exactly two models: the cheaper and the pricier
    model and the cost ratio pricier / cheaper (infinity when the cheaper
    one cost 0). Equal costs keep the given model order."""
    pos = F.array_position(F.array(*[F.lit(m) for m in order]), F.col("model"))
    g = runs.withColumn("_o", F.struct("cost_usd", pos.alias("p"))).groupBy("qid").agg(
        F.count(F.lit(1)).alias("_n"),
        F.min_by("model", "_o").alias("cheaper_model"), F.max_by("model", "_o").alias("pricier_model"),
        F.min("_o").alias("_lo"), F.max("_o").alias("_hi"))
    g = g.filter(F.col("_n") == 2)
    lo, hi = F.col("_lo.cost_usd"), F.col("_hi.cost_usd")
    ratio = F.when(lo == 0, F.lit(float("inf"))).otherwise(hi / lo)
    return g.select("qid", "cheaper_model", "pricier_model", F.bround(ratio, 4).alias("cost_ratio"))
