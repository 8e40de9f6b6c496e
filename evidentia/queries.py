"""
test tables of ``sf_dir`` whole. Every computed column is aliased to the
name used by the matching oracle SQL."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions.cost import EMBEDDING_MODEL, pricing_frame, with_cost
from evidentia.functions.ids import https_url, paper_id_from_url
from evidentia.functions.text import collapse_ws, match_form, title_of, token_count
from evidentia.operators import claims as C
from evidentia.operators import compare as CMP
from evidentia.operators import corpus as CO
from evidentia.operators import evaluate as E
from evidentia.operators import guardrail as G
from evidentia.operators import ranking as R
from evidentia.operators import usage as U
from evidentia.operators.retrieve import previews, prompt_summary, sources_block
from evidentia.operators.search import knn, search_one, search_results
from evidentia.plans import fixtures as FX
from evidentia.plans.answering import evaluate, nested_results
from evidentia.session import checkpoint_dir, read_table, ship_package, table_path
from evidentia.sources.corpus import FIXTURE_INGESTED_AT, FIXTURE_URL_PREFIX, fixture_corpus, hashed_corpus
from evidentia.sources.feed import normalize_entries, pages_as_entries, read_feed, write_feed
from evidentia.sources.questions import clean_questions

_CACHE: dict = {}

# --- fixed values of the registered fixtures -----------------------------------
GATE_MAX_UNSUPPORTED = 0.25
GATE_MAX_FALSE_REFUSAL = None
# model, share of a sentence's tokens that makes it a claim (percent), strictness of the support check
COMPARE_MODELS = [("gemini-3.7-flash", 50, 0.8), ("gemini-3.1-pro-preview", 75, 0.9)]
UPSERT_INGESTED_AT = "2024-03-01 00:00:00"
STALE_INGESTED_AT = "2024-01-01 00:00:00"
TOPIC_CATEGORIES = ["en", "fr"]
TOPIC_CLAUSES = [("that", "with"), ("les", "des"), ("from the",)]
# --------------------------------------------------------------------------------


def _key(spark, sf):
    return (spark.sparkContext.applicationId, id(spark), sf.rstrip("/"))


def _truth(spark: SparkSession, sf: str):
    """Containment truth, scanned once and shared by the question labels
    and the retrieval-quality query."""
    k = ("truth",) + _key(spark, sf)
    if k not in _CACHE:
        from evidentia.sources.questions import benchmark_truth
        _CACHE[k] = benchmark_truth(spark, sf).persist()
    return _CACHE[k]


def _answers(spark: SparkSession, sf: str):
    k = ("answers",) + _key(spark, sf)
    if k not in _CACHE:
        _CACHE[k] = FX.fixture_answers(spark, sf, truth=_truth(spark, sf))
    return _CACHE[k]


def _evaluation(spark: SparkSession, sf: str):
    k = ("eval",) + _key(spark, sf)
    if k not in _CACHE:
        _CACHE[k] = evaluate(_answers(spark, sf), judge_model=FX.JUDGE_MODEL, pricing=pricing_frame(spark))
    return _CACHE[k]


def _ids(c):
    return F.array_join(c, ",")


# --- search -------------------------------------------------------------------------

def _stored_corpus(spark, sf):
    return fixture_corpus(spark, sf).select(F.col("id").alias("paper_id"), "embedding")


def vector_search(spark, sf):
    q = read_table(spark, sf, "embeddings").select(F.col("vec_id").alias("qid"), "embedding")
    hits = knn(q, _stored_corpus(spark, sf), FX.K)
    titles = fixture_corpus(spark, sf).select(F.col("id").alias("paper_id"), "title")
    return search_results(hits, titles, q.count() * FX.K)


def mean_embedding(spark, sf) -> DataFrame:
    e = read_table(spark, sf, "embeddings")
    m = e.select(F.posexplode("embedding").alias("i", "x")).groupBy("i").agg(
        F.avg(F.col("x").cast("double")).alias("m"))
    return m.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("embedding"))


def vector_search_one(spark, sf):
    return search_one(mean_embedding(spark, sf), _stored_corpus(spark, sf), FX.K).select("rank", "paper_id", "score")


def _vector_queries(spark, sf):
    return read_table(spark, sf, "embeddings").select(F.col("vec_id").alias("qid"), "embedding")


def vector_search_grid(spark, sf):
    """The path of large query tables, forced: blocks of queries, one scan of the corpus each."""
    q = _vector_queries(spark, sf)
    return knn(q, _stored_corpus(spark, sf), FX.K, max_block_bytes=q.count() * 64 * 8 // 3).select(
        "qid", "rank", "paper_id", "score")


def vector_search_ivf(spark, sf):
    """Inverted lists, looking into all of them (exact)."""
    from evidentia.operators.ivf import MAX_LISTS, ivf_knn
    return ivf_knn(_vector_queries(spark, sf), _stored_corpus(spark, sf), FX.K, nprobe=MAX_LISTS).select(
        "qid", "rank", "paper_id", "score")


def _kept_index(spark, sf):
    """The corpus index, written once per session and opened from its files."""
    from evidentia.operators.pq_index import open_index, write_index
    k = ("index",) + _key(spark, sf)
    if k not in _CACHE:
        path = os.path.join(checkpoint_dir(spark), f"index-{uuid.uuid4().hex}")
        _CACHE[k] = write_index(_stored_corpus(spark, sf), path).path
    return open_index(spark, _CACHE[k])


def vector_search_index(spark, sf):
    """The kept index, looking into all lists and comparing all ids exactly."""
    from evidentia.operators.ivf import MAX_LISTS
    from evidentia.operators.pq_index import search_index
    index = _kept_index(spark, sf)
    return search_index(_vector_queries(spark, sf), index, FX.K, nprobe=MAX_LISTS, rerank=max(1, index.rows.count())).hits.select(
        "qid", "rank", "paper_id", "score")


def ivf_recall(spark, sf):
    """Recall of the kept index for every stored vector, lists and ids per
    query as measured on a sample, and the share of all (query, vector) pairs
    whose vector was read for an exact distance."""
    from evidentia.operators.ivf import recall
    from evidentia.operators.pq_index import search_index
    q, index = _vector_queries(spark, sf), _kept_index(spark, sf)
    found = search_index(q, index, FX.K)
    pairs = max(1, q.count() * index.rows.count())
    share = found.compared.agg((F.count(F.lit(1)) / F.lit(pairs)).alias("exact_share"))
    return recall(found.hits, knn(q, _stored_corpus(spark, sf), FX.K)).join(share).select(
        "expected", "found", "recall", "exact_share", F.lit(found.nprobe).alias("nprobe"), F.lit(found.rerank).alias("rerank"))


def vector_health_q(spark, sf):
    """Vectors the search excludes, counted (E7): null, wrong length, zero norm."""
    from evidentia.operators.search import vector_health
    h = vector_health(_stored_corpus(spark, sf), "embedding", 64)
    return h.select(*[F.col(c).cast("long").alias(c) for c in h.columns])


def recall_at_k(spark, sf):
    a = _answers(spark, sf)
    return E.retrieval_quality(a.hits, FX.truth_pairs(spark, sf, _truth(spark, sf)), FX.K)


# --- retrieval and claims --------------------------------------------------------------

def retrieve(spark, sf):
    return _answers(spark, sf).retrieved.select("qid", "rank", "paper_id", "title", "authors",
                                                "published_date", "url", "abstract")


def retrieve_preview(spark, sf):
    return previews(_answers(spark, sf).retrieved)


def sources_block_q(spark, sf):
    a = _answers(spark, sf)
    s = prompt_summary(sources_block(a.questions, a.retrieved))
    # the additive count must agree with counting the built prompt
    t = C.prompt_tokens(a.questions, a.retrieved)
    return s.join(t.withColumnRenamed("prompt_tokens", "_t"), "qid", "left").select(
        "qid", "prompt_chars", "prompt_md5", F.coalesce("_t", F.lit(-1)).cast("long").alias("prompt_tokens"))


def synthesize(spark, sf):
    return _answers(spark, sf).claims.select("qid", "claim_id", "text", _ids(F.col("paper_ids")).alias("paper_ids"))


def synthesize_ranked(spark, sf):
    """Claims ranked by BM25 over the corpus, none where a question's rare words are missing."""
    a = _answers(spark, sf)
    return R.ranked_claims(a.questions, a.retrieved, read_table(spark, sf, "documents").select(F.col("text").alias("abstract"))).select(
        "qid", "claim_id", "text", _ids(F.col("paper_ids")).alias("paper_ids"), F.round("score", 6).alias("score"))


def claim_evidence(spark, sf):
    a = _answers(spark, sf)
    ev = C.claim_evidence(a.claims, a.retrieved)
    return ev.select("qid", "claim_id", (F.col("pos") + 1).cast("int").alias("pos"), "paper_id",
                     F.col("abstract").isNotNull().alias("retrieved"),
                     F.length("abstract").cast("long").alias("source_chars"))


def claims_block(spark, sf):
    a = _answers(spark, sf)
    b = C.claims_block(a.claims, a.retrieved)
    t = C.claims_block_tokens(a.claims, a.retrieved)
    return b.join(t, "qid", "left").select("qid", F.col("n_claims").cast("long").alias("n_claims"),
                    F.length("block").cast("long").alias("block_chars"), F.md5("block").alias("block_md5"),
                    F.coalesce("block_tokens", F.lit(-1)).cast("long").alias("block_tokens"))


# --- guardrail ------------------------------------------------------------------------------

def support_check(spark, sf):
    return _answers(spark, sf).verdicts.select("qid", "claim_id", "supported", "reasoning")


def unknown_citations(spark, sf):
    st = _answers(spark, sf).status
    return st.filter(F.size("unknown_ids") > 0).select("qid", "claim_id", _ids(F.col("unknown_ids")).alias("unknown_ids"))


def claim_verdicts(spark, sf):
    return _answers(spark, sf).status.select("qid", "claim_id", "claim_supported", "reason")


def citations_render(spark, sf):
    return _answers(spark, sf).status.select("qid", "claim_id", "cite")


def claim_lines(spark, sf):
    return _answers(spark, sf).status.select("qid", "claim_id", "line")


def answer_counts(spark, sf):
    return _answers(spark, sf).counts


def final_markdown(spark, sf):
    return _answers(spark, sf).answers.select("qid", "final_markdown")


def empty_answer(spark, sf):
    c = _answers(spark, sf).counts
    kind = (F.when(F.col("claim_count") == 0, F.lit("no_claims"))
             .when(F.col("supported_count") == 0, F.lit("gaps_only"))
             .when(F.col("unsupported_count") == 0, F.lit("findings_only"))
             .otherwise(F.lit("mixed")))
    return c.select("qid", "claim_count", kind.alias("answer_kind"))


def answer_questions(spark, sf):
    a = _answers(spark, sf)
    r = E.answerability(a.questions, a.counts)
    return a.answers.join(r.select("qid", "expected_status", "claim_count", "answerability_match"), "qid").select(
        "qid", "expected_status", "claim_count", "supported_count", "unsupported_count",
        "answerability_match", "final_markdown")


def citations_parse(spark, sf):
    return G.parse_citations(_answers(spark, sf).answers)


def answer_parse(spark, sf):
    return G.parse_answer(_answers(spark, sf).answers)


def orphan_keys(spark, sf):
    """Requested ids (labels) that the embedded corpus does not hold."""
    req = read_table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("paper_id")).distinct()
    known = fixture_corpus(spark, sf).filter(F.col("embedding").isNotNull()).select(F.col("id").alias("paper_id"))
    o = req.join(known, "paper_id", "left_anti")
    return o.select("paper_id", F.concat(F.lit("unknown paper_id '"), F.col("paper_id"), F.lit("'")).alias("error_message"))


# --- evaluation ----------------------------------------------------------------------------

def judge_check(spark, sf):
    return _evaluation(spark, sf).judge.select("qid", "claim_id", "grounded", "reasoning")


def eval_claim_records(spark, sf):
    r = _evaluation(spark, sf).records
    return r.select("qid", "claim_id", "claim_text", _ids(F.col("paper_ids")).alias("paper_ids"),
                    "validator_supported", "judge_grounded")


def answerability(spark, sf):
    a = _answers(spark, sf)
    return E.answerability(a.questions, a.counts)


def _claims_digest(c):
    return F.array_join(F.transform(c, lambda x: F.concat(
        F.when(x["validator_supported"], F.lit("S")).otherwise(F.lit("U")),
        F.when(x["judge_grounded"], F.lit("G")).otherwise(F.lit("N")))), ";")


def eval_questions(spark, sf):
    r = _evaluation(spark, sf).results
    return r.select("qid", "claim_count", "supported_count", "unsupported_count", "answerability_match",
                    F.bround("cost_usd", 6).alias("cost_usd"), _claims_digest(F.col("claims")).alias("claims_digest"))


def eval_metrics(spark, sf):
    return _evaluation(spark, sf).metrics


def verdict_confusion(spark, sf):
    return E.verdict_confusion(_evaluation(spark, sf).records)


def eval_gate(spark, sf):
    return E.gate(_evaluation(spark, sf).metrics, GATE_MAX_UNSUPPORTED, GATE_MAX_FALSE_REFUSAL)


def eval_nested(spark, sf):
    n = nested_results(_evaluation(spark, sf))
    return n.select("id", "expected_status", "claim_count", "supported_count", "unsupported_count",
                    "answerability_match", F.size("claims").cast("long").alias("n_claims"),
                    _claims_digest(F.col("claims")).alias("claims_digest"))


def eval_report(spark, sf):
    return E.report_rows(_evaluation(spark, sf).metrics)


def eval_report_questions(spark, sf):
    """Per-question report rows: id, expected, claims, supported, yes/no."""
    return E.question_report_rows(_evaluation(spark, sf).results)


def status_counts(spark, sf):
    return E.status_counts(_answers(spark, sf).questions)


def verdict_dedupe(spark, sf):
    """Judge verdicts emitted once per cited retrieved source; the last
    source's verdict wins for the claim."""
    a = _answers(spark, sf)
    docs = a.retrieved.select("paper_id", "abstract").dropDuplicates(["paper_id"]).select(
        "paper_id", match_form("abstract").alias("_n"))
    cit = C.claim_citations(a.claims).join(a.retrieved.select("qid", "paper_id"), ["qid", "paper_id"], "left_semi")
    rows = (cit.join(docs, "paper_id")
               .join(a.claims.select("qid", "claim_pos", match_form("text").alias("_t")), ["qid", "claim_pos"])
               .select("qid", "claim_id", "pos", (F.instr("_n", F.col("_t")) > 0).alias("grounded")))
    return G.last_verdict(rows, ["grounded"], order_col="pos")


def label_metrics(spark, sf):
    """Claim-level metric arithmetic on labels: supported = not toxic,
    grounded = quality."""
    lab = read_table(spark, sf, "labels")
    rec = lab.select((F.col("toxic") == 0).alias("validator_supported"), (F.col("quality") == 1).alias("judge_grounded"))
    return E.claim_metrics(rec)


# --- questions ---------------------------------------------------------------------------------

def questions_scan(spark, sf):
    return _answers(spark, sf).questions


def questions_clean(spark, sf):
    b = read_table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))
    return clean_questions(b)


# --- comparison ---------------------------------------------------------------------------------

def _compare(spark, sf):
    k = ("cmp",) + _key(spark, sf)
    if k not in _CACHE:
        a = _answers(spark, sf)
        _CACHE[k] = CMP.model_runs(a.questions, a.retrieved, [FX.fixture_model(*m) for m in COMPARE_MODELS], pricing_frame(spark))
    return _CACHE[k]


def model_compare(spark, sf):
    return _compare(spark, sf)


def cost_ratio(spark, sf):
    return CMP.cost_ratio(_compare(spark, sf), [m[0] for m in COMPARE_MODELS])


# --- corpus and ingest ---------------------------------------------------------------------------

def _target(spark, sf):
    """The stored corpus: every document, and every benchmark item."""
    b = read_table(spark, sf, "benchmark")
    extra = b.select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("id"), title_of("text").alias("title"),
                     F.lit("benchmark").alias("authors"), F.lit("2024-01-01").cast("date").alias("published_date"),
                     F.col("text").alias("abstract"),
                     F.concat(F.lit(FIXTURE_URL_PREFIX + "b"), F.col("item_id").cast("string")).alias("url"),
                     F.lit(None).cast("array<double>").alias("embedding"),
                     F.lit(FIXTURE_INGESTED_AT).cast("timestamp").alias("ingested_at"))
    return fixture_corpus(spark, sf).unionByName(extra)


def upsert_source(spark, sf) -> DataFrame:
    """Re-ingest of all documents with normalised text, and every web page
    as a new paper."""
    emb = read_table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"),
                                                     F.col("embedding").cast("array<double>").alias("embedding"))
    at = F.lit(UPSERT_INGESTED_AT).cast("timestamp").alias("ingested_at")
    # made before the join: a caller that needs no abstract moves no text
    d = read_table(spark, sf, "documents").select(
        "doc_id", F.col("doc_id").cast("string").alias("id"), title_of("text").alias("title"),
        F.col("source").alias("authors"),
        F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("doc_id", F.lit(365)).cast("int")).alias("published_date"),
        collapse_ws("text", unicode=False).alias("abstract"),
        F.concat(F.lit(FIXTURE_URL_PREFIX), F.col("doc_id").cast("string")).alias("url"))
    again = d.join(emb, "doc_id", "left").select("id", "title", "authors", "published_date", "abstract", "url", "embedding", at)
    e = pages_as_entries(read_table(spark, sf, "pages"))
    new = e.select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("id"), "title", "authors",
                   F.lit("2024-01-01").cast("date").alias("published_date"), "abstract", "url",
                   F.lit(None).cast("array<double>").alias("embedding"), at)
    return again.unionByName(new)


def _corpus_rows(df):
    return df.select("id", "title", F.length("abstract").cast("long").alias("abstract_chars"),
                     F.md5("abstract").alias("abstract_md5"), F.col("embedding").isNotNull().alias("has_embedding"),
                     F.date_format("ingested_at", "yyyy-MM-dd HH:mm:ss").alias("ingested_at"))


def corpus_upsert(spark, sf):
    src = upsert_source(spark, sf)
    return _corpus_rows(CO.upsert_frame(_target(spark, sf), src, source_rows_bound=src.count()))


def upsert_affected(spark, sf):
    src = upsert_source(spark, sf)
    return CO.upsert_counts(_target(spark, sf), src, source_rows_bound=src.count())


def _stale(spark, sf):
    """An older version of every stored row that is re-ingested, with another text."""
    src = upsert_source(spark, sf).withColumn("ingested_at", F.lit(STALE_INGESTED_AT).cast("timestamp"))
    known = _target(spark, sf).select("id")                  # new papers have no older version
    return src.withColumn("abstract", F.lit("stale")).join(known, "id", "left_semi")


def ingest_progress(spark, sf):
    """Events of three runs of the ingest stream: the re-ingest, the same
    again, and a stale delivery."""
    from evidentia.streaming.ingest import logged_runs
    src = upsert_source(spark, sf)
    ev = logged_runs(spark, _target(spark, sf), [src, src, _stale(spark, sf)])
    return ev.select("batch_id", "status", "input_rows", "affected")


def stream_upsert(spark, sf):
    """The re-ingest as a stream, delivered twice; then a stale delivery comes
    last: an older version of every row, with another text."""
    from evidentia.streaming.ingest import replay_upsert
    return _corpus_rows(replay_upsert(spark, _target(spark, sf), upsert_source(spark, sf), replays=2,
                                      stale=_stale(spark, sf), files_per_trigger=4))


def corpus_clear(spark, sf):
    """A written copy of the whole corpus is cleared and read again."""
    path = os.path.join(checkpoint_dir(spark), f"clear-{uuid.uuid4().hex}")
    CO.write_table(path, _target(spark, sf))
    return CO.clear_counts(spark, path)


def ingest_summary(spark, sf):
    src = upsert_source(spark, sf).withColumn("n_tokens", token_count("abstract"))
    t = _target(spark, sf)
    return CO.ingest_summary(src, CO.upsert_counts(t, src), CO.upsert_frame(t, src.drop("n_tokens")))


def corpus_scan(spark, sf):
    c = fixture_corpus(spark, sf)
    return c.select("id", "title", "authors", F.date_format("published_date", "yyyy-MM-dd").alias("published_date"),
                    "url", F.when(F.col("embedding").isNotNull(), F.size("embedding")).cast("int").alias("n_dims"),
                    F.date_format("ingested_at", "yyyy-MM-dd HH:mm:ss").alias("ingested_at"))


def corpus_count(spark, sf):
    return CO.corpus_count(fixture_corpus(spark, sf))


def corpus_null_check(spark, sf):
    return CO.null_violations(fixture_corpus(spark, sf), ["id", "title", "authors", "published_date",
                                                          "abstract", "url", "embedding", "ingested_at"])


def topic_filter(spark, sf):
    d = read_table(spark, sf, "documents")
    p = CO.topic_predicate("text", "lang", TOPIC_CATEGORIES, TOPIC_CLAUSES)
    return CO.topic_filter(d, p).select(F.col("doc_id").cast("string").alias("id"), "lang")


def newest_n(spark, sf):
    n = CO.newest(fixture_corpus(spark, sf), 400)
    return n.select("id", F.date_format("published_date", "yyyy-MM-dd").alias("published_date"))


def newest_page(spark, sf):
    n = CO.newest(fixture_corpus(spark, sf), 100, start=100)
    return n.select("id", F.date_format("published_date", "yyyy-MM-dd").alias("published_date"))


def embed_corpus(spark, sf):
    v = hashed_corpus(spark, sf)
    l1 = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)
    return v.select("paper_id", "n_tokens", "nnz", F.bround(l1, 6).alias("l1"))


def embed_tokens(spark, sf):
    v = hashed_corpus(spark, sf).agg(F.count(F.lit(1)).cast("long").alias("texts"),
                                     F.sum("n_tokens").cast("long").alias("input_tokens"))
    u = v.select("texts", "input_tokens", F.lit(0).cast("long").alias("output_tokens"),
                 F.lit(EMBEDDING_MODEL).alias("model"))
    return with_cost(u, pricing_frame(spark)).select("texts", "input_tokens", F.bround("cost_usd", 6).alias("cost_usd"))


def call_ledger(spark, sf):
    """Every document through a user embedder and the ledger, twice: what each
    run asked, knew and called, and what the answers add up to."""
    from evidentia.operators import ledger as LG
    from evidentia.operators.models import embed_with
    docs = read_table(spark, sf, "documents")
    ledger = LG.Ledger(os.path.join(checkpoint_dir(spark), f"ledger-{uuid.uuid4().hex}"), "embed", EMBEDDING_MODEL)

    def embed(texts, task):
        return [[float(len(t))] for t in texts], [len(t) for t in texts]

    sums = [embed_with(docs, "doc_id", "text", embed, ledger=ledger).agg(
        F.lit(i).alias("run"), F.count(F.lit(1)).alias("answers"), F.sum("n_tokens").alias("tokens")) for i in (1, 2)]
    held = LG.calls(spark, ledger.path).groupBy("step").agg(F.count(F.lit(1)).alias("held"))
    ran = LG.runs(spark, ledger.path).select("step", F.when(F.col("known") == 0, F.lit(1)).otherwise(F.lit(2)).alias("run"),
                                             "inputs", "calls", "known", "called")
    return ran.join(sums[0].unionByName(sums[1]), "run").join(held, "step").select(
        "run", "inputs", "calls", "known", "called", "answers", "tokens", "held")


# --- feed normalisation ------------------------------------------------------------------------

def normalize_id(spark, sf):
    p = read_table(spark, sf, "pages")
    return p.select("page_id", "url", paper_id_from_url("url").alias("paper_id"))


def normalize_url(spark, sf):
    p = read_table(spark, sf, "pages")
    return p.select("page_id", https_url("url").alias("url"))


def normalize_text(spark, sf):
    d = read_table(spark, sf, "documents")
    c = collapse_ws("text")
    return d.select("doc_id", F.length(c).cast("long").alias("chars"), F.md5(c).alias("text_md5"))


def feed_parse(spark, sf):
    e = pages_as_entries(read_table(spark, sf, "pages"))
    return e.select("page_id", "id", "title", "authors", "url",
                    F.length("abstract").cast("long").alias("abstract_chars"), F.md5("abstract").alias("abstract_md5"))


def feed_entries(spark, sf):
    """Every document written as an Atom entry, read back by the feed source
    and normalised: ids, authors, dates, categories."""
    path = os.path.join(checkpoint_dir(spark), f"feed-{uuid.uuid4().hex}")
    write_feed(read_table(spark, sf, "documents"), path)
    e = normalize_entries(read_feed(spark, path), categories=True)
    return e.select("id", "title", "authors", F.date_format("published_date", "yyyy-MM-dd").alias("published_date"), "url",
                    F.array_join("categories", ",").alias("categories"), F.md5("abstract").alias("abstract_md5"))


# --- usage ------------------------------------------------------------------------------------

def _usage(spark, sf):
    return U.priced(U.events_as_usage(read_table(spark, sf, "events")), pricing_frame(spark))


def usage_cost(spark, sf):
    return _usage(spark, sf).select("event_id", "run_id", "tool", "model", "input_tokens", "output_tokens",
                                    F.bround("cost_usd", 10).alias("cost_usd"))


def trace_rows(spark, sf):
    return U.trace_display(U.sequence_runs(_usage(spark, sf)))


def trace_totals(spark, sf):
    return U.trace_totals(_usage(spark, sf))


def turn_usage(spark, sf):
    c = read_table(spark, sf, "conversations")
    o = U.orchestrator_usage(U.conversation_turn_usage(c), pricing_frame(spark))
    return o.select("run_id", "input_tokens", "output_tokens", "model_turns", F.bround("cost_usd", 10).alias("cost_usd"))


def authoritative_answer(spark, sf):
    c = read_table(spark, sf, "conversations")
    return U.authoritative_answer(c.select("conv_id").distinct(), c)


def step_trace(spark, sf):
    """Per question, the four steps of the answer pipeline with tokens and
    cost (usage priced as the default models of each step)."""
    from evidentia.plans.answering import step_trace as trace
    t = trace(_answers(spark, sf), pricing_frame(spark), FX.K, FX.STEP_MODELS)
    return t.select("run_id", "seq", "tool", F.coalesce("model", F.lit("-")).alias("model"), "input_tokens",
                    "output_tokens", F.bround("cost_usd", 10).alias("cost_usd"), "output_summary")


def usage_by_day(spark, sf):
    return U.usage_by_day(_usage(spark, sf))


def usage_by_day_stream(spark, sf):
    from evidentia.streaming.usage import usage_by_day_stream as run
    return run(spark, table_path(sf, "events"))


def _in_utc(fn):
    """Queries compute days and windows on UTC wall-clock time; pin the
    session time zone (a no-op for sessions built by evidentia), and make
    the package importable on the executors."""
    def run(spark, sf):
        ship_package(spark)
        if spark.conf.get("spark.sql.session.timeZone") != "UTC":
            spark.conf.set("spark.sql.session.timeZone", "UTC")
        return fn(spark, sf)
    run.__name__ = fn.__name__
    run.__doc__ = fn.__doc__
    return run


QUERIES = {
    "answer_questions": answer_questions,
    "vector_search": vector_search,
    "vector_search_one": vector_search_one,
    "vector_search_grid": vector_search_grid,
    "vector_search_ivf": vector_search_ivf,
    "vector_search_index": vector_search_index,
    "ivf_recall": ivf_recall,
    "recall_at_k": recall_at_k,
    "vector_health": vector_health_q,
    "retrieve": retrieve,
    "retrieve_preview": retrieve_preview,
    "sources_block": sources_block_q,
    "synthesize": synthesize,
    "synthesize_ranked": synthesize_ranked,
    "claim_evidence": claim_evidence,
    "claims_block": claims_block,
    "support_check": support_check,
    "unknown_citations": unknown_citations,
    "claim_verdicts": claim_verdicts,
    "citations_render": citations_render,
    "claim_lines": claim_lines,
    "answer_counts": answer_counts,
    "final_markdown": final_markdown,
    "empty_answer": empty_answer,
    "citations_parse": citations_parse,
    "answer_parse": answer_parse,
    "orphan_keys": orphan_keys,
    "judge_check": judge_check,
    "eval_claim_records": eval_claim_records,
    "answerability": answerability,
    "eval_questions": eval_questions,
    "eval_metrics": eval_metrics,
    "verdict_confusion": verdict_confusion,
    "eval_gate": eval_gate,
    "eval_nested": eval_nested,
    "eval_report": eval_report,
    "eval_report_questions": eval_report_questions,
    "status_counts": status_counts,
    "verdict_dedupe": verdict_dedupe,
    "label_metrics": label_metrics,
    "questions_scan": questions_scan,
    "questions_clean": questions_clean,
    "model_compare": model_compare,
    "cost_ratio": cost_ratio,
    "corpus_scan": corpus_scan,
    "corpus_count": corpus_count,
    "corpus_null_check": corpus_null_check,
    "corpus_upsert": corpus_upsert,
    "upsert_affected": upsert_affected,
    "stream_upsert": stream_upsert,
    "ingest_progress": ingest_progress,
    "corpus_clear": corpus_clear,
    "ingest_summary": ingest_summary,
    "topic_filter": topic_filter,
    "newest_n": newest_n,
    "newest_page": newest_page,
    "embed_corpus": embed_corpus,
    "embed_tokens": embed_tokens,
    "call_ledger": call_ledger,
    "normalize_id": normalize_id,
    "normalize_url": normalize_url,
    "normalize_text": normalize_text,
    "feed_parse": feed_parse,
    "feed_entries": feed_entries,
    "usage_cost": usage_cost,
    "trace_rows": trace_rows,
    "trace_totals": trace_totals,
    "turn_usage": turn_usage,
    "authoritative_answer": authoritative_answer,
    "step_trace": step_trace,
    "usage_by_day": usage_by_day,
    "usage_by_day_stream": usage_by_day_stream,
}
QUERIES = {k: _in_utc(v) for k, v in QUERIES.items()}
