"""User functions for the model steps (M1-M5).

A model step is a plain Python callable over a pandas batch; Spark slices
the input into Arrow batches, one Python worker per partition calls the
function on ``batch_size`` rows at a time, and the rows it returns form the
output frame. Concurrency equals the number of partitions of the input
(repartition to raise or lower it). Empty inputs never reach the function:
callers filter them out first (no model call for nothing).

Call policy (M5): retry on rate limiting, ``max_retries`` attempts in all,
waiting base_wait * 2**attempt between them (15, 30, 60 s by default);
any other error propagates and fails the task. With a ``Ledger`` every answer
is kept as soon as it is there, so a task or job that is started again pays
for no input twice (``ledger.py``); without one, Spark's task retry re-runs
the calls of the task.

Pace: ``min_interval`` is the pause between the calls of the whole job, not
of a task. The calling tasks start together (a barrier stage) and share one
grid of ticks, the k-th of n tasks taking every n-th tick from the k-th on, so
the job makes at most one call per interval however many tasks there are.
"""

from __future__ import annotations

import contextlib
import time
from dataclasses import dataclass, field, replace
from typing import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidentia.operators.ledger import Ledger, call_once
from evidentia.session import cut_lineage


def builtin_model(fn):
    """Mark a step function as one of the built-in lexical models:
    deterministic and cheap, so its output may simply be recomputed from
    lineage after an executor loss. Steps without the mark are treated as
    paid model calls and their outputs are written once (lineage cut)."""
    fn._builtin_model = True
    return fn


def is_builtin(fn) -> bool:
    return bool(getattr(fn, "_builtin_model", False))


class RateLimited(Exception):
    """Raised by a model function when the service asks it to slow down."""


# --- fixed values of the default call policy --------------------------------------
ATTEMPTS = 4
FIRST_WAIT = 15.0              # seconds; each further wait is twice the last
EMBED_PAUSE = 0.2              # seconds between embedding calls of an ingest job
QUESTION_PAUSE = 2.0           # seconds between questions of an evaluation job
# -----------------------------------------------------------------------------------


@dataclass(frozen=True)
class CallPolicy:
    max_retries: int = ATTEMPTS        # attempts in all
    base_wait: float = FIRST_WAIT
    min_interval: float = 0.0          # seconds between the calls of the whole job
    callers: int | None = None         # tasks that call at the same time (none: MAX_CALLERS, or fewer cores)
    retry_on: tuple = field(default=(RateLimited,))

    @property
    def waits(self) -> list[float]:
        """Pauses between the attempts."""
        return [self.base_wait * 2 ** i for i in range(self.max_retries - 1)]


def call_with_policy(fn: Callable, args: tuple, policy: CallPolicy, sleep=time.sleep):
    """One attempt before each wait of the policy, then a last one whose
    error, whatever it is, is the caller's."""
    for pause in policy.waits:
        with contextlib.suppress(*policy.retry_on):
            return fn(*args)
        sleep(pause)
    return fn(*args)


MAX_CALLERS = 64               # calling tasks of a paced job: ticks are dealt to all of them
INGEST_POLICY = CallPolicy(min_interval=EMBED_PAUSE)
EVALUATION_POLICY = CallPolicy(min_interval=QUESTION_PAUSE)


class Pace:
    """The ticks of one caller: every ``callers``-th tick of the job's grid,
    from its own place on, each used once and none before its time."""

    def __init__(self, interval: float, callers: int, place: int, start: float):
        self.step, self.at = interval * callers, start + interval * place

    def wait(self, now: float) -> float:
        """Seconds until the next free tick, which is then taken."""
        if now > self.at:
            self.at += self.step * -(-(now - self.at) // self.step)
        pause, self.at = self.at - now, self.at + self.step
        return pause


def _paced(df: DataFrame, run: Callable, schema, policy: CallPolicy, write: bool) -> DataFrame:
    """Run ``run(batches, before_call)`` over ``df``; with a pace, in a barrier
    stage whose tasks share the grid. What a paced stage makes is written at
    once: a barrier stage cannot be part of just any plan."""
    if not policy.min_interval:
        if write:                       # the fixed order that names the batches of a ledger
            df = df.repartition(df.sparkSession.sparkContext.defaultParallelism).sortWithinPartitions("_call")
        out = df.mapInPandas(lambda b: run(b, lambda: None), schema)
        return cut_lineage(out, "model-output") if write else out
    interval = policy.min_interval
    callers = policy.callers or min(MAX_CALLERS, df.sparkSession.sparkContext.defaultParallelism)
    df = df.repartition(callers)
    if "_call" in df.columns:
        df = df.sortWithinPartitions("_call")

    def on_grid(batches):
        from pyspark import BarrierTaskContext
        ctx = BarrierTaskContext.get()
        start = max(float(t) for t in ctx.allGather(repr(time.time())))
        pace = Pace(interval, callers, ctx.partitionId(), start)
        yield from run(batches, lambda: time.sleep(pace.wait(time.time())))

    return cut_lineage(df.mapInPandas(on_grid, schema, barrier=True), "model-output")


def map_model(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: T.StructType | str,
              batch_size: int = 32, policy: CallPolicy = CallPolicy(), ledger: Ledger | None = None,
              id_col: str | None = None) -> DataFrame:
    """Apply ``fn`` to slices of ``batch_size`` rows; ``fn`` returns a pandas
    frame with the columns of ``schema`` (any number of rows). With ``ledger``
    each distinct input is called once, ever; the rows that ``fn`` returns then
    carry ``id_col``, the column that names a row of ``df``."""
    if ledger is not None:
        if id_col is None:
            raise ValueError("a ledger needs the column that names an input row")
        kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema

        return call_once(df, fn, kind, id_col, ledger, lambda f, part: call_with_policy(f, (part,), policy),
                         lambda todo, run, out: _paced(todo, run, out, policy, write=True), batch_size)

    def run(batches, before_call):
        for pdf in batches:
            for s in range(0, len(pdf), batch_size):
                before_call()
                out = call_with_policy(fn, (pdf.iloc[s:s + batch_size].reset_index(drop=True),), policy)
                if out is not None and len(out):
                    yield out

    return _paced(df, run, schema, policy, write=False)


EMBED_SCHEMA = "key string, embedding array<double>, n_tokens long"


def embed_with(df: DataFrame, key: str, text_col: str, embed: Callable, task: str = "RETRIEVAL_DOCUMENT",
               batch_size: int = 32, policy: CallPolicy = CallPolicy(), ledger: Ledger | None = None) -> DataFrame:
    """Embed a text column with a user function
    ``embed(texts: list[str], task: str) -> (vectors, token_counts)``.
    The key travels with its text in the same batch, so vectors are attached
    to the right row without relying on position across tasks (J9)."""
    def call(pdf: pd.DataFrame) -> pd.DataFrame:
        vecs, toks = embed(pdf["t"].tolist(), task)
        if len(vecs) != len(pdf):
            raise ValueError(f"embedder returned {len(vecs)} vectors for {len(pdf)} texts")
        return pd.DataFrame({"key": pdf["key"].astype(str), "embedding": [list(map(float, v)) for v in vecs],
                             "n_tokens": [int(t) for t in toks]})
    src = df.select(F.col(key).cast("string").alias("k"), F.col(text_col).alias("t")).filter(F.col("t").isNotNull())
    src = src.withColumnRenamed("k", "key")
    if ledger is not None:              # a query's vector is not a document's
        ledger = replace(ledger, step=f"{ledger.step}-{task}")
    return map_model(src, call, EMBED_SCHEMA, batch_size, policy, ledger, "key").withColumnRenamed("key", key)


def _embedder(embed: Callable, task: str, kw: dict) -> Callable:
    def run(df: DataFrame, key: str, text: str) -> DataFrame:
        out = embed_with(df, key, text, embed, task, **kw)
        return out.withColumn(key, F.col(key).cast(df.schema[key].dataType))
    return run


def document_embedder(embed: Callable, **kw) -> Callable:
    """``embed(texts, task)`` as the ``embed`` of an ingest job: documents are
    embedded with the document task. ``kw`` goes to ``embed_with``."""
    return _embedder(embed, "RETRIEVAL_DOCUMENT", kw)


def query_embedder(embed: Callable, **kw) -> Callable:
    """``embed(texts, task)`` as the ``embed`` of ``answer`` and
    ``search_question``: questions are embedded with the query task."""
    return _embedder(embed, "RETRIEVAL_QUERY", kw)


# columns that a step function returns beside the question id, whose type is that of its input
CLAIM_ROWS = "claim_id int, text string, paper_ids array<string>"
VERDICT_ROWS = "claim_id int, supported boolean, reasoning string"
JUDGE_ROWS = "claim_id int, grounded boolean, reasoning string"


def _rows(df: DataFrame, columns: str) -> str:
    return f"qid {df.schema['qid'].dataType.simpleString()}, claim_pos int, {columns}"


def claims_from(prompts: DataFrame, write: Callable[[pd.DataFrame], pd.DataFrame],
                batch_size: int = 1, policy: CallPolicy = CallPolicy(), ledger: Ledger | None = None) -> DataFrame:
    """Claim writer over one prompt row per question (qid, question, prompt).
    Returns claim rows; claim_pos is the order the writer emitted them in."""
    def call(pdf):
        out = write(pdf)
        if out is None or not len(out):
            return None
        out = out.copy()
        out["claim_pos"] = out.groupby("qid").cumcount() + 1
        return out[["qid", "claim_pos", "claim_id", "text", "paper_ids"]]
    return map_model(prompts, call, _rows(prompts, CLAIM_ROWS), batch_size, policy, ledger, "qid")


def verdicts_from(blocks: DataFrame, check: Callable[[pd.DataFrame], pd.DataFrame], schema: str = VERDICT_ROWS,
                  batch_size: int = 1, policy: CallPolicy = CallPolicy(), ledger: Ledger | None = None) -> DataFrame:
    """Support checker or judge over one claims block per question (qid,
    block); returns verdict rows in the order emitted (``vpos``). Repeated
    ids are kept; the verdict join keeps the last."""
    def call(pdf):
        out = check(pdf)
        if out is None or not len(out):
            return None
        out = out.copy()
        out["claim_pos"] = out.groupby("qid").cumcount() + 1
        return out
    return map_model(blocks, call, _rows(blocks, schema), batch_size, policy, ledger, "qid")
