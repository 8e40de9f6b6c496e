"""Oracle SQL (DuckDB) for the registered queries.

Each query is rebuilt from the raw test tables with plain SQL (views
region ... conversations are registered by the checker). Shared steps are
named CTEs; ``sql(final, *ctes)`` pulls in every CTE a query needs, in
dependency order. Column names equal those of ``evidentia.queries``.
"""

from __future__ import annotations

import re

from evidentia.functions.cost import PRICES
from evidentia.operators import guardrail as G
from evidentia.operators import usage as U
from evidentia.plans import fixtures as FX
from evidentia.queries import (COMPARE_MODELS, GATE_MAX_FALSE_REFUSAL, GATE_MAX_UNSUPPORTED,
                               TOPIC_CATEGORIES, TOPIC_CLAUSES, UPSERT_INGESTED_AT)
from evidentia.sources.corpus import FIXTURE_INGESTED_AT, FIXTURE_URL_PREFIX

TOK = r"'[\p{L}\p{N}]+'"
NL = "chr(10)"


def lit(s: str) -> str:
    """A Python string as a DuckDB string expression (newlines via chr)."""
    parts = s.split("\n")
    q = ["'" + p.replace("'", "''") + "'" for p in parts]
    return "(" + f" || {NL} || ".join(q) + ")"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def ntok(x: str) -> str:
    return f"CAST(len(regexp_extract_all({x}, {TOK})) AS BIGINT)"


def pylist(x: str) -> str:
    return f"('[' || array_to_string(list_transform({x}, lambda e: '''' || e || ''''), ', ') || ']')"


def price(model_col: str, in_col: str, out_col: str) -> str:
    cases_in = " ".join(f"WHEN '{m}' THEN {float(i)!r}" for m, i, _ in PRICES)
    cases_out = " ".join(f"WHEN '{m}' THEN {float(o)!r}" for m, _, o in PRICES)
    return (f"COALESCE(CAST({in_col} AS DOUBLE) / 1e6 * (CASE {model_col} {cases_in} END) + "
            f"CAST({out_col} AS DOUBLE) / 1e6 * (CASE {model_col} {cases_out} END), 0.0)")


CTE: dict[str, str] = {}

CTE["papers"] = f"""
SELECT CAST(doc_id AS VARCHAR) AS paper_id, doc_id,
       substring({collapse('text')}, 1, 80) AS title, source AS authors,
       strftime(DATE '2024-01-01' + CAST(doc_id % 365 AS INTEGER), '%Y-%m-%d') AS published_date,
       text AS abstract, '{FIXTURE_URL_PREFIX}' || CAST(doc_id AS VARCHAR) AS url, lang
FROM documents"""

CTE["corpus"] = f"""
SELECT p.paper_id AS id, p.title, p.authors, p.published_date, p.abstract, p.url,
       CAST(e.embedding AS DOUBLE[]) AS embedding, TIMESTAMP '{FIXTURE_INGESTED_AT}' AS ingested_at
FROM papers p LEFT JOIN embeddings e ON e.vec_id = p.doc_id"""

CTE["truth"] = """
SELECT DISTINCT b.item_id AS qid, CAST(d.doc_id AS VARCHAR) AS paper_id
FROM benchmark b JOIN documents d ON length(b.text) > 0 AND contains(d.text, b.text)"""

CTE["questions"] = """
SELECT b.item_id AS qid, b.text AS question,
       CASE WHEN b.item_id % 5 = 0 THEN 'partial'
            WHEN b.item_id IN (SELECT qid FROM truth) THEN 'answerable'
            ELSE 'unanswerable' END AS expected_status, '' AS notes
FROM benchmark b"""

_TF = """
SELECT {key} AS id, CAST((('0x' || substr(md5(tok), 1, 8))::BIGINT % 256) AS INTEGER) AS b, count(*) AS c
FROM (SELECT {key}, unnest(regexp_extract_all(lower({text}), {tok})) AS tok FROM {src})
GROUP BY ALL"""
_VEC = """
SELECT ids.id, list(CAST(COALESCE(t.c, 0) AS DOUBLE) ORDER BY r.i) AS v
FROM (SELECT DISTINCT id FROM {tf}) ids CROSS JOIN range(256) r(i)
LEFT JOIN {tf} t ON t.id = ids.id AND t.b = r.i GROUP BY ids.id"""
CTE["dtf"] = _TF.format(key="doc_id", text="text", tok=TOK, src="documents")
CTE["dvec"] = _VEC.format(tf="dtf")
CTE["qtf"] = _TF.format(key="qid", text="question", tok=TOK, src="questions")
CTE["qvec"] = _VEC.format(tf="qtf")

_KNN = """
SELECT qid, CAST(rank AS INTEGER) AS rank, paper_id, dist, round_even(1.0 - dist, 4) AS score FROM (
  SELECT qid, paper_id, dist,
         row_number() OVER (PARTITION BY qid ORDER BY round(dist, 9), paper_id) AS rank
  FROM (SELECT q.{qk} AS qid, CAST(d.{dk} AS VARCHAR) AS paper_id,
               1.0 - list_cosine_similarity(q.{qv}, d.{dv}) AS dist
        FROM {qs} q CROSS JOIN {ds} d {where}))
WHERE rank <= {k}"""
CTE["hits"] = _KNN.format(qk="id", qv="v", dk="id", dv="v", qs="qvec", ds="dvec", where="", k=FX.K)

CTE["retrieved"] = """
SELECT h.qid, h.rank, h.paper_id, p.title, p.authors, p.published_date, p.abstract, p.url
FROM hits h JOIN papers p ON p.paper_id = h.paper_id"""

CTE["sent"] = f"""
SELECT x.qid, x.rank, x.paper_id, x.p, x.s, len(x.st) AS n, len(list_intersect(x.st, q.qt)) AS o
FROM (SELECT qid, rank, paper_id, s, p, list_distinct(regexp_extract_all(lower(s), {TOK})) AS st
      FROM (SELECT qid, rank, paper_id, unnest(ss) AS s, generate_subscripts(ss, 1) AS p
            FROM (SELECT qid, rank, paper_id, regexp_extract_all(abstract, '[^.!?]+[.!?]') AS ss FROM retrieved))) x
JOIN (SELECT qid, list_distinct(regexp_extract_all(lower(question), {TOK})) AS qt FROM questions) q ON q.qid = x.qid"""

_CLAIMS = """
SELECT qid, CAST(rn AS INTEGER) AS claim_pos, CAST(rn AS INTEGER) AS claim_id, trim(s) AS text,
       CASE WHEN rn % {every} = 0 THEN [paper_id, CAST(CAST(paper_id AS BIGINT) + {offset} AS VARCHAR)]
            ELSE [paper_id] END AS paper_ids
FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY CAST(o AS DOUBLE) / n DESC, rank, p, paper_id) AS rn
      FROM sent WHERE n > 0 AND o * 100 >= n * {percent})"""
CTE["claims"] = _CLAIMS.format(every=FX.FABRICATE_EVERY, offset=FX.FABRICATED_OFFSET, percent=60)

CTE["cit"] = """
SELECT qid, claim_pos, claim_id, unnest(paper_ids) AS paper_id, generate_subscripts(paper_ids, 1) AS pos
FROM claims"""

CTE["verdicts"] = f"""
SELECT c.qid, c.claim_pos, c.claim_id,
       (c.tot > 0 AND CAST(COALESCE(m.m, 0) AS DOUBLE) >= CAST(0.8 AS DOUBLE) * CAST(c.tot AS DOUBLE)) AS supported,
       'matched ' || CAST(COALESCE(m.m, 0) AS VARCHAR) || ' of ' || CAST(c.tot AS VARCHAR) || ' claim tokens' AS reasoning
FROM (SELECT *, len(list_distinct(regexp_extract_all(lower(text), {TOK}))) AS tot FROM claims) c
LEFT JOIN (
  SELECT ct.qid, ct.claim_pos, count(DISTINCT ct.tok) AS m
  FROM (SELECT DISTINCT qid, claim_pos, unnest(regexp_extract_all(lower(text), {TOK})) AS tok FROM claims) ct
  JOIN (SELECT DISTINCT c.qid, c.claim_pos, c.paper_id FROM cit c
        JOIN retrieved r ON r.qid = c.qid AND r.paper_id = c.paper_id) ci
    ON ci.qid = ct.qid AND ci.claim_pos = ct.claim_pos
  JOIN (SELECT DISTINCT paper_id, unnest(regexp_extract_all(lower(abstract), {TOK})) AS tok
        FROM (SELECT DISTINCT paper_id, abstract FROM retrieved)) rt
    ON rt.paper_id = ci.paper_id AND rt.tok = ct.tok
  GROUP BY ct.qid, ct.claim_pos) m ON m.qid = c.qid AND m.claim_pos = c.claim_pos"""

CTE["cr"] = """
SELECT qid, claim_pos,
       string_agg(CASE WHEN url IS NOT NULL THEN '[' || paper_id || '](' || url || ')'
                       ELSE '[' || paper_id || ']' END, ' ' ORDER BY pos) AS cite,
       list(paper_id ORDER BY pos) FILTER (WHERE url IS NULL) AS unknown_ids
FROM (SELECT cit.*, r.url FROM cit LEFT JOIN retrieved r ON r.qid = cit.qid AND r.paper_id = cit.paper_id)
GROUP BY qid, claim_pos"""

CTE["status"] = f"""
SELECT *,
  CASE WHEN len(unknown_ids) > 0
         THEN '- ' || text || ' (cited ' || cite || ', but ' || {pylist('unknown_ids')} || ' were never retrieved)'
       WHEN claim_supported THEN '- ' || text || ' ' || cite
       ELSE '- ' || text || ' (cited ' || cite || ': ' || reason || ')' END AS line
FROM (
  SELECT c.qid, c.claim_pos, c.claim_id, c.text, c.paper_ids, COALESCE(cr.cite, '') AS cite,
         COALESCE(cr.unknown_ids, CAST([] AS VARCHAR[])) AS unknown_ids,
         CASE WHEN len(COALESCE(cr.unknown_ids, CAST([] AS VARCHAR[]))) > 0 THEN false
              WHEN v.supported THEN true ELSE false END AS claim_supported,
         COALESCE(v.reasoning, '{G.NOT_CHECKED}') AS reason
  FROM claims c
  LEFT JOIN cr ON cr.qid = c.qid AND cr.claim_pos = c.claim_pos
  LEFT JOIN (SELECT qid, claim_id, arg_max(supported, claim_pos) AS supported,
                    arg_max(reasoning, claim_pos) AS reasoning FROM verdicts GROUP BY qid, claim_id) v
    ON v.qid = c.qid AND v.claim_id = c.claim_id)"""

CTE["answers"] = f"""
SELECT q.qid, COALESCE(a.md, {lit(G.EMPTY_ANSWER)}) AS final_markdown,
       CAST(COALESCE(a.s, 0) AS BIGINT) AS supported_count, CAST(COALESCE(a.u, 0) AS BIGINT) AS unsupported_count
FROM questions q LEFT JOIN (
  SELECT qid, s, u,
         concat_ws({NL} || {NL}, CASE WHEN sup IS NULL THEN {lit(G.NO_SUPPORT_PREFACE)} END,
                   {lit(G.FINDINGS_HEADER)} || sup, {lit(G.GAPS_HEADER)} || uns) || {NL} AS md
  FROM (SELECT qid,
               string_agg(line, {NL} ORDER BY claim_pos) FILTER (WHERE claim_supported) AS sup,
               string_agg(line, {NL} ORDER BY claim_pos) FILTER (WHERE NOT claim_supported) AS uns,
               count(*) FILTER (WHERE claim_supported) AS s, count(*) FILTER (WHERE NOT claim_supported) AS u
        FROM status GROUP BY qid)) a ON a.qid = q.qid"""

CTE["counts"] = """
SELECT q.qid, CAST(COALESCE(c.n, 0) AS BIGINT) AS claim_count, CAST(COALESCE(c.s, 0) AS BIGINT) AS supported_count,
       CAST(COALESCE(c.u, 0) AS BIGINT) AS unsupported_count
FROM questions q LEFT JOIN (
  SELECT qid, count(*) AS n, count(*) FILTER (WHERE claim_supported) AS s,
         count(*) FILTER (WHERE NOT claim_supported) AS u FROM status GROUP BY qid) c ON c.qid = q.qid"""

CTE["judge"] = f"""
SELECT c.qid, c.claim_pos, c.claim_id, COALESCE(g.g, false) AS grounded,
       CASE WHEN COALESCE(g.g, false) THEN 'stated verbatim in a cited source'
            ELSE 'not stated in any cited source' END AS reasoning
FROM claims c LEFT JOIN (
  SELECT ci.qid, ci.claim_pos, bool_or(strpos(nd.n, nc.t) > 0) AS g
  FROM (SELECT DISTINCT qid, claim_pos, paper_id FROM cit) ci
  JOIN (SELECT qid, paper_id FROM retrieved) r ON r.qid = ci.qid AND r.paper_id = ci.paper_id
  JOIN (SELECT DISTINCT paper_id, lower({collapse('abstract')}) AS n FROM retrieved) nd ON nd.paper_id = ci.paper_id
  JOIN (SELECT qid, claim_pos, lower({collapse('text')}) AS t FROM claims) nc
    ON nc.qid = ci.qid AND nc.claim_pos = ci.claim_pos
  GROUP BY ci.qid, ci.claim_pos) g ON g.qid = c.qid AND g.claim_pos = c.claim_pos"""

CTE["records"] = """
SELECT c.qid, c.claim_pos, c.claim_id, c.text AS claim_text, c.paper_ids,
       COALESCE(v.vs, false) AS validator_supported, COALESCE(j.g, false) AS judge_grounded
FROM claims c
LEFT JOIN (SELECT qid, claim_id, arg_max(claim_supported, claim_pos) AS vs FROM status GROUP BY qid, claim_id) v
  ON v.qid = c.qid AND v.claim_id = c.claim_id
LEFT JOIN (SELECT qid, claim_id, arg_max(grounded, claim_pos) AS g FROM judge GROUP BY qid, claim_id) j
  ON j.qid = c.qid AND j.claim_id = c.claim_id"""

CTE["answerab"] = """
SELECT q.qid, q.expected_status, c.claim_count, c.supported_count, c.unsupported_count,
       CASE WHEN q.expected_status = 'answerable' THEN c.supported_count > 0
            WHEN q.expected_status = 'unanswerable' THEN c.supported_count = 0
            ELSE true END AS answerability_match
FROM questions q JOIN counts c ON c.qid = q.qid"""

CTE["cblock"] = f"""
SELECT qid, count(*) AS n_claims, string_agg(b, {NL} || {NL} ORDER BY claim_pos) AS block FROM (
  SELECT c.qid, c.claim_pos,
         'claim_id: ' || CAST(c.claim_id AS VARCHAR) || {NL} || 'claim_text: ' || c.text || {NL} ||
         'cited_paper_ids: ' || {pylist('c.paper_ids')} || {NL} || COALESCE(s.src, '') AS b
  FROM claims c LEFT JOIN (
    SELECT ci.qid, ci.claim_pos,
           string_agg('--- source text for ' || ci.paper_id || ' ---' || {NL} || r.abstract, {NL} ORDER BY ci.pos) AS src
    FROM cit ci JOIN retrieved r ON r.qid = ci.qid AND r.paper_id = ci.paper_id
    GROUP BY ci.qid, ci.claim_pos) s ON s.qid = c.qid AND s.claim_pos = c.claim_pos)
GROUP BY qid"""

CTE["jcost"] = f"""
SELECT b.qid, {price(f"'{FX.JUDGE_MODEL}'", 'b.tin', 'COALESCE(o.tout, 0)')} AS cost_usd
FROM (SELECT qid, {ntok('block')} AS tin FROM cblock) b
LEFT JOIN (SELECT qid, sum({ntok('reasoning')}) AS tout FROM judge GROUP BY qid) o ON o.qid = b.qid"""

CTE["results"] = """
SELECT a.*, COALESCE(jc.cost_usd, 0.0) AS cost_usd, COALESCE(d.digest, '') AS claims_digest,
       CAST(COALESCE(d.n, 0) AS BIGINT) AS n_claims
FROM answerab a
LEFT JOIN jcost jc ON jc.qid = a.qid
LEFT JOIN (SELECT qid, count(*) AS n, string_agg(CASE WHEN validator_supported THEN 'S' ELSE 'U' END ||
                         CASE WHEN judge_grounded THEN 'G' ELSE 'N' END, ';' ORDER BY claim_pos) AS digest
           FROM records GROUP BY qid) d ON d.qid = a.qid"""

CTE["metrics"] = """
SELECT nq AS total_questions, nc AS total_claims,
       round_even(CASE WHEN vs > 0 THEN leak / vs ELSE 0.0 END, 4) AS unsupported_claim_rate,
       round_even(CASE WHEN nc > 0 THEN jg / nc ELSE 0.0 END, 4) AS citation_accuracy,
       round_even(CASE WHEN vu > 0 THEN fr / vu ELSE 0.0 END, 4) AS false_refusal_rate,
       am AS answerability_matches,
       round_even(CASE WHEN nq > 0 THEN CAST(am AS DOUBLE) / nq ELSE 0.0 END, 4) AS answerability_match_rate,
       CAST(round_even(cost, 4) AS DOUBLE) AS total_cost_usd
FROM (SELECT CAST(count(*) AS BIGINT) AS nq, CAST(count(*) FILTER (WHERE answerability_match) AS BIGINT) AS am,
             COALESCE(sum(CAST(cost_usd AS DECIMAL(38,10))), CAST(0 AS DECIMAL(38,10))) AS cost FROM results) q,
     (SELECT CAST(count(*) AS BIGINT) AS nc,
             CAST(count(*) FILTER (WHERE validator_supported) AS DOUBLE) AS vs,
             CAST(count(*) FILTER (WHERE NOT validator_supported) AS DOUBLE) AS vu,
             CAST(count(*) FILTER (WHERE validator_supported AND NOT judge_grounded) AS DOUBLE) AS leak,
             CAST(count(*) FILTER (WHERE NOT validator_supported AND judge_grounded) AS DOUBLE) AS fr,
             CAST(count(*) FILTER (WHERE judge_grounded) AS DOUBLE) AS jg FROM records) c"""

# --- usage ---------------------------------------------------------------------------
_MODEL_CASE = "CASE event_type " + " ".join(f"WHEN '{t}' THEN '{m}'" for t, m in U.EVENT_MODELS) + " END"
CTE["usage"] = f"""
SELECT event_id, user_id AS run_id, ts, event_type AS tool, model, input_tokens, output_tokens,
       value AS latency_ms, 'k=' || CAST(input_tokens AS VARCHAR) AS input_summary,
       event_type || ' value=' || CAST(value AS VARCHAR) AS output_summary,
       {price('model', 'input_tokens', 'output_tokens')} AS cost_usd
FROM (SELECT *, {_MODEL_CASE} AS model, CAST(json_extract_string(props, '$.k') AS BIGINT) AS input_tokens,
             CAST(floor(value) AS BIGINT) + event_id % 5 AS output_tokens FROM events)"""

# --- corpus maintenance -------------------------------------------------------------------
CTE["extra_rows"] = f"""
SELECT 'b' || CAST(item_id AS VARCHAR) AS id, substring({collapse('text')}, 1, 80) AS title, 'benchmark' AS authors,
       DATE '2024-01-01' AS published_date, text AS abstract,
       '{FIXTURE_URL_PREFIX}b' || CAST(item_id AS VARCHAR) AS url, CAST(NULL AS DOUBLE[]) AS embedding,
       TIMESTAMP '{FIXTURE_INGESTED_AT}' AS ingested_at FROM benchmark"""
CTE["target"] = """
SELECT id, title, abstract, embedding, ingested_at FROM corpus
UNION ALL SELECT id, title, abstract, embedding, ingested_at FROM extra_rows"""
CTE["src_rows"] = f"""
SELECT CAST(d.doc_id AS VARCHAR) AS id, substring({collapse('d.text')}, 1, 80) AS title,
       {collapse('d.text')} AS abstract, CAST(e.embedding AS DOUBLE[]) AS embedding, TIMESTAMP '{UPSERT_INGESTED_AT}' AS ingested_at
FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id
UNION ALL
SELECT 'p' || CAST(page_id AS VARCHAR), {collapse("regexp_extract(html, '<title>(.*?)</title>', 1)")},
       {collapse("regexp_replace(html, '<[^>]*>', ' ', 'g')")}, CAST(NULL AS DOUBLE[]), TIMESTAMP '{UPSERT_INGESTED_AT}'
FROM pages"""
CTE["upserted"] = """
SELECT * FROM target WHERE id NOT IN (SELECT id FROM src_rows)
UNION ALL SELECT * FROM src_rows"""

_CORPUS_ROWS = """
SELECT id, title, CAST(length(abstract) AS BIGINT) AS abstract_chars, md5(abstract) AS abstract_md5,
       embedding IS NOT NULL AS has_embedding, strftime(ingested_at, '%Y-%m-%d %H:%M:%S') AS ingested_at
FROM upserted"""

CTE["cmp"] = ""  # filled below


def _deps(body: str) -> set[str]:
    return {n for n in CTE if re.search(rf"\b{n}\b", body)}


def sql(final: str) -> str:
    """WITH <needed CTEs in dependency order> <final>."""
    order: list[str] = []

    def visit(name: str, stack=()):
        if name in order:
            return
        for d in sorted(_deps(CTE[name]) - {name}):
            visit(d, stack + (name,))
        order.append(name)

    for d in sorted(_deps(final)):
        visit(d)
    if not order:
        return final
    return "WITH " + ",\n".join(f"{n} AS ({CTE[n]})" for n in order) + "\n" + final


def _for_model(i: int, percent: int, strict: float) -> None:
    """The chain from claims to answers once more, for a model of its own."""
    chain = ["claims", "cit", "verdicts", "cr", "status", "answers", "counts", "cblock"]
    for name in chain:
        body = _CLAIMS.format(every=FX.FABRICATE_EVERY, offset=FX.FABRICATED_OFFSET, percent=percent) if name == "claims" else CTE[name]
        for other in chain:
            body = re.sub(rf"(?<=FROM ){other}\b|(?<=JOIN ){other}\b|\b{other}(?=\.[a-z*])", f"{other}_{i}", body)
        CTE[f"{name}_{i}"] = body.replace("CAST(0.8 AS DOUBLE)", f"CAST({strict!r} AS DOUBLE)")


def _compare_sql() -> str:
    prompt_tok = f"""(SELECT q.qid, {ntok("'Research question: ' || q.question || " + NL + " || " + NL + " || 'Retrieved abstracts:' || " + NL + " || " + NL + " || s.block")} AS pin
        FROM questions q JOIN (SELECT qid, string_agg('paper_id: ' || paper_id || {NL} || 'title: ' || title || {NL} || 'abstract: ' || abstract, {NL} || {NL} ORDER BY rank) AS block
                               FROM retrieved GROUP BY qid) s ON s.qid = q.qid)"""
    parts = []
    for i, (name, percent, strict) in enumerate(COMPARE_MODELS):
        _for_model(i, percent, strict)
        parts.append(f"""
  SELECT c.qid, '{name}' AS model, c.claim_count, c.supported_count, c.unsupported_count, a.final_markdown,
         COALESCE(b.bin, 0) AS bin, COALESCE(o.cout, 0) + COALESCE(r.rout, 0) AS tout
  FROM counts_{i} c JOIN answers_{i} a ON a.qid = c.qid
  LEFT JOIN (SELECT qid, {ntok('block')} AS bin FROM cblock_{i}) b ON b.qid = c.qid
  LEFT JOIN (SELECT qid, sum({ntok('text')}) AS cout FROM claims_{i} GROUP BY qid) o ON o.qid = c.qid
  LEFT JOIN (SELECT qid, sum({ntok('reasoning')}) AS rout FROM verdicts_{i} GROUP BY qid) r ON r.qid = c.qid""")
    runs = " UNION ALL ".join(parts)
    return f"""
SELECT u.qid, u.model, u.claim_count, u.supported_count, u.unsupported_count,
       CAST(COALESCE(p.pin, 0) + u.bin AS BIGINT) AS input_tokens, CAST(u.tout AS BIGINT) AS output_tokens,
       CAST(0 AS DOUBLE) AS latency_ms, u.final_markdown,
       {price('u.model', 'COALESCE(p.pin, 0) + u.bin', 'u.tout')} AS cost_usd
FROM ({runs}) u
LEFT JOIN {prompt_tok} p ON p.qid = u.qid"""


CTE["cmp"] = _compare_sql()


def _topic() -> str:
    t = f"lower({collapse('text')})"
    clauses = " OR ".join("(" + " AND ".join(f"strpos({t}, '{p.lower()}') > 0" for p in cl) + ")"
                          for cl in TOPIC_CLAUSES)
    cats = ", ".join(f"'{c}'" for c in TOPIC_CATEGORIES)
    return f"SELECT CAST(doc_id AS VARCHAR) AS id, lang FROM documents WHERE lang IN ({cats}) AND ({clauses})"


def _fmt_pct(x: str) -> str:
    return f"(printf('%.1f', {x} * 100.0) || '%')"


def _ids(x: str) -> str:
    return f"array_to_string({x}, ',')"


ORACLE: dict[str, str] = {
    "answer_questions": sql("""SELECT a.qid, x.expected_status, x.claim_count, a.supported_count, a.unsupported_count,
        x.answerability_match, a.final_markdown FROM answers a JOIN answerab x ON x.qid = a.qid"""),
    "vector_search": sql("SELECT h.qid, h.rank, h.paper_id, c.title, h.score FROM (" +
                         _KNN.format(qk="vec_id", qv="e", dk="id", dv="embedding",
                                     qs="(SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)",
                                     ds="corpus", where="WHERE d.embedding IS NOT NULL", k=FX.K) +
                         ") h JOIN corpus c ON c.id = h.paper_id"),
    "vector_search_one": sql(f"""
        SELECT CAST(row_number() OVER (ORDER BY round(dist, 9), paper_id) AS INTEGER) AS rank, paper_id,
               round_even(1.0 - dist, 4) AS score
        FROM (SELECT d.id AS paper_id, 1.0 - list_cosine_similarity(m.v, d.embedding) AS dist
              FROM corpus d, (SELECT list(x ORDER BY i) AS v FROM (
                   SELECT i, avg(CAST(x AS DOUBLE)) AS x FROM (
                     SELECT unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY i)) m
              WHERE d.embedding IS NOT NULL)
        QUALIFY rank <= {FX.K}"""),
    "recall_at_k": sql(f"""
        SELECT CAST(count(*) AS BIGINT) AS questions_with_truth, CAST(count(*) FILTER (WHERE hit > 0) AS BIGINT) AS questions_hit,
               CAST(COALESCE(sum(hit), 0) AS BIGINT) AS relevant_retrieved, CAST(COALESCE(sum(rel), 0) AS BIGINT) AS relevant_total,
               round_even(COALESCE(avg(CAST(hit AS DOUBLE) / rel), 0.0), 4) AS recall_at_k,
               round_even(CASE WHEN count(*) > 0 THEN CAST(sum(hit) AS DOUBLE) / (count(*) * {FX.K}) ELSE 0.0 END, 4) AS precision_at_k
        FROM (SELECT t.qid, count(*) AS rel, count(h.paper_id) AS hit FROM truth t
              LEFT JOIN hits h ON h.qid = t.qid AND h.paper_id = t.paper_id AND h.rank <= {FX.K} GROUP BY t.qid)"""),
    "vector_health": sql("""
        SELECT CAST(count(*) AS BIGINT) AS total,
               CAST(count(*) FILTER (WHERE embedding IS NULL) AS BIGINT) AS null_vectors,
               CAST(count(*) FILTER (WHERE embedding IS NOT NULL AND len(embedding) <> 64) AS BIGINT) AS wrong_length,
               CAST(count(*) FILTER (WHERE embedding IS NOT NULL AND len(embedding) = 64 AND
                    list_sum(list_transform(embedding, lambda x: COALESCE(x, 0) * COALESCE(x, 0))) = 0) AS BIGINT) AS zero_norm
        FROM corpus"""),
    "retrieve": sql("SELECT qid, rank, paper_id, title, authors, published_date, url, abstract FROM retrieved"),
    "retrieve_preview": sql("""SELECT qid, rank, paper_id, title, authors, published_date, url,
                               substring(abstract, 1, 150) AS abstract_preview FROM retrieved"""),
    "sources_block": sql(f"""
        SELECT qid, CAST(length(p) AS BIGINT) AS prompt_chars, md5(p) AS prompt_md5, {ntok('p')} AS prompt_tokens
        FROM (SELECT q.qid, 'Research question: ' || q.question || {NL} || {NL} || 'Retrieved abstracts:' || {NL} || {NL} || s.block AS p
              FROM questions q JOIN (SELECT qid, string_agg('paper_id: ' || paper_id || {NL} || 'title: ' || title || {NL} ||
                                      'abstract: ' || abstract, {NL} || {NL} ORDER BY rank) AS block FROM retrieved GROUP BY qid) s
              ON s.qid = q.qid)"""),
    "synthesize": sql(f"SELECT qid, claim_id, text, {_ids('paper_ids')} AS paper_ids FROM claims"),
    "claim_evidence": sql("""
        SELECT c.qid, c.claim_id, CAST(c.pos AS INTEGER) AS pos, c.paper_id, r.abstract IS NOT NULL AS retrieved,
               CAST(length(r.abstract) AS BIGINT) AS source_chars
        FROM cit c LEFT JOIN retrieved r ON r.qid = c.qid AND r.paper_id = c.paper_id"""),
    "claims_block": sql(f"SELECT qid, CAST(n_claims AS BIGINT) AS n_claims, CAST(length(block) AS BIGINT) AS block_chars, md5(block) AS block_md5, {ntok('block')} AS block_tokens FROM cblock"),
    "support_check": sql("SELECT qid, claim_id, supported, reasoning FROM verdicts"),
    "unknown_citations": sql(f"SELECT qid, claim_id, {_ids('unknown_ids')} AS unknown_ids FROM status WHERE len(unknown_ids) > 0"),
    "claim_verdicts": sql("SELECT qid, claim_id, claim_supported, reason FROM status"),
    "citations_render": sql("SELECT qid, claim_id, cite FROM status"),
    "claim_lines": sql("SELECT qid, claim_id, line FROM status"),
    "answer_counts": sql("SELECT * FROM counts"),
    "final_markdown": sql("SELECT qid, final_markdown FROM answers"),
    "empty_answer": sql("""SELECT qid, claim_count, CASE WHEN claim_count = 0 THEN 'no_claims'
                             WHEN supported_count = 0 THEN 'gaps_only' WHEN unsupported_count = 0 THEN 'findings_only'
                             ELSE 'mixed' END AS answer_kind FROM counts"""),
    "citations_parse": sql(r"""
        SELECT qid, CAST(pos AS INTEGER) AS pos, label, url FROM (
          SELECT qid, unnest(ls) AS label, unnest(us) AS url, generate_subscripts(ls, 1) AS pos FROM (
            SELECT qid, regexp_extract_all(final_markdown, '\[([^\]]+)\]\((https?://[^\s)]+)\)', 1) AS ls,
                        regexp_extract_all(final_markdown, '\[([^\]]+)\]\((https?://[^\s)]+)\)', 2) AS us FROM answers))"""),
    "answer_parse": sql("""
        SELECT qid, CAST(i AS INTEGER) AS line_no,
               CASE WHEN starts_with(line, '## ') THEN 'header' WHEN starts_with(line, '- ') THEN 'bullet'
                    WHEN trim(line) = '' THEN 'blank' ELSE 'paragraph' END AS kind,
               last_value(CASE WHEN starts_with(line, '## ') THEN substring(line, 4) END IGNORE NULLS)
                 OVER (PARTITION BY qid ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section,
               CASE WHEN starts_with(line, '## ') THEN substring(line, 4) WHEN starts_with(line, '- ') THEN substring(line, 3)
                    ELSE line END AS text
        FROM (SELECT qid, unnest(ls) AS line, generate_subscripts(ls, 1) AS i
              FROM (SELECT qid, string_split(final_markdown, chr(10)) AS ls FROM answers))"""),
    "orphan_keys": sql("""
        SELECT paper_id, 'unknown paper_id ''' || paper_id || '''' AS error_message
        FROM (SELECT DISTINCT CAST(doc_id AS VARCHAR) AS paper_id FROM labels)
        WHERE paper_id NOT IN (SELECT id FROM corpus WHERE embedding IS NOT NULL)"""),
    "judge_check": sql("SELECT qid, claim_id, grounded, reasoning FROM judge"),
    "eval_claim_records": sql(f"""SELECT qid, claim_id, claim_text, {_ids('paper_ids')} AS paper_ids,
                                  validator_supported, judge_grounded FROM records"""),
    "answerability": sql("SELECT * FROM answerab"),
    "eval_questions": sql("""SELECT qid, claim_count, supported_count, unsupported_count, answerability_match,
                             round_even(cost_usd, 6) AS cost_usd, claims_digest FROM results"""),
    "eval_metrics": sql("SELECT * FROM metrics"),
    "verdict_confusion": sql("""SELECT validator_supported, judge_grounded, CAST(count(*) AS BIGINT) AS n
                                FROM records GROUP BY ALL"""),
    "eval_gate": sql(f"""
        SELECT 'unsupported_claim_rate' AS metric, unsupported_claim_rate AS value,
               CAST({'NULL' if GATE_MAX_UNSUPPORTED is None else GATE_MAX_UNSUPPORTED} AS DOUBLE) AS threshold,
               COALESCE(unsupported_claim_rate > CAST({'NULL' if GATE_MAX_UNSUPPORTED is None else GATE_MAX_UNSUPPORTED} AS DOUBLE), false) AS failed
        FROM metrics UNION ALL
        SELECT 'false_refusal_rate', false_refusal_rate,
               CAST({'NULL' if GATE_MAX_FALSE_REFUSAL is None else GATE_MAX_FALSE_REFUSAL} AS DOUBLE),
               COALESCE(false_refusal_rate > CAST({'NULL' if GATE_MAX_FALSE_REFUSAL is None else GATE_MAX_FALSE_REFUSAL} AS DOUBLE), false)
        FROM metrics"""),
    "eval_nested": sql("""SELECT qid AS id, expected_status, claim_count, supported_count, unsupported_count,
                          answerability_match, n_claims, claims_digest FROM results"""),
    "eval_report": sql(f"""
        SELECT 'Unsupported-claim rate' AS metric, {_fmt_pct('unsupported_claim_rate')} AS value FROM metrics
        UNION ALL SELECT 'Citation accuracy', {_fmt_pct('citation_accuracy')} FROM metrics
        UNION ALL SELECT 'False-refusal rate', {_fmt_pct('false_refusal_rate')} FROM metrics
        UNION ALL SELECT 'Answerability-category match', CAST(answerability_matches AS VARCHAR) || '/' ||
              CAST(total_questions AS VARCHAR) || ' (' || {_fmt_pct('answerability_match_rate')} || ')' FROM metrics
        UNION ALL SELECT 'Judge cost (this run)', '$' || printf('%.4f', total_cost_usd) FROM metrics"""),
    "eval_report_questions": sql("""SELECT qid, expected_status, claim_count, supported_count,
                                    CASE WHEN answerability_match THEN 'yes' ELSE 'no' END AS match FROM results"""),
    "status_counts": sql("SELECT expected_status, CAST(count(*) AS BIGINT) AS n FROM questions GROUP BY ALL"),
    "verdict_dedupe": sql(f"""
        SELECT qid, claim_id, arg_max(g, pos) AS grounded FROM (
          SELECT ci.qid, ci.claim_id, ci.pos, strpos(lower({collapse('r.abstract')}), lower({collapse('c.text')})) > 0 AS g
          FROM cit ci JOIN retrieved r ON r.qid = ci.qid AND r.paper_id = ci.paper_id
          JOIN claims c ON c.qid = ci.qid AND c.claim_pos = ci.claim_pos)
        GROUP BY qid, claim_id"""),
    "label_metrics": sql("""
        SELECT CAST(n AS BIGINT) AS total_claims,
               round_even(CASE WHEN vs > 0 THEN leak / vs ELSE 0.0 END, 4) AS unsupported_claim_rate,
               round_even(CASE WHEN n > 0 THEN jg / n ELSE 0.0 END, 4) AS citation_accuracy,
               round_even(CASE WHEN vu > 0 THEN fr / vu ELSE 0.0 END, 4) AS false_refusal_rate
        FROM (SELECT count(*) AS n, CAST(count(*) FILTER (WHERE toxic = 0) AS DOUBLE) AS vs,
                     CAST(count(*) FILTER (WHERE toxic <> 0) AS DOUBLE) AS vu,
                     CAST(count(*) FILTER (WHERE toxic = 0 AND quality <> 1) AS DOUBLE) AS leak,
                     CAST(count(*) FILTER (WHERE toxic <> 0 AND quality = 1) AS DOUBLE) AS fr,
                     CAST(count(*) FILTER (WHERE quality = 1) AS DOUBLE) AS jg FROM labels)"""),
    "questions_scan": sql("SELECT * FROM questions"),
    "questions_clean": r"""SELECT item_id AS qid, regexp_replace(text, '^\s+|\s+$', '', 'g') AS question FROM benchmark
                           WHERE text IS NOT NULL AND NOT regexp_full_match(text, '\s*')""",
    "model_compare": sql("SELECT * FROM cmp"),
    "cost_ratio": sql(f"""
        SELECT qid, arg_min(model, o) AS cheaper_model, arg_max(model, o) AS pricier_model,
               round_even(CASE WHEN min(cost_usd) = 0 THEN CAST('inf' AS DOUBLE) ELSE max(cost_usd) / min(cost_usd) END, 4) AS cost_ratio
        FROM (SELECT *, (cost_usd, list_position([{", ".join(f"'{m}'" for m, *_ in COMPARE_MODELS)}], model)) AS o FROM cmp)
        GROUP BY qid HAVING count(*) = 2"""),
    "corpus_scan": sql("""SELECT id, title, authors, published_date, url, CAST(len(embedding) AS INTEGER) AS n_dims,
                          strftime(ingested_at, '%Y-%m-%d %H:%M:%S') AS ingested_at FROM corpus"""),
    "corpus_count": sql("SELECT CAST(count(*) AS BIGINT) AS n FROM corpus"),
    "corpus_null_check": sql("""
        SELECT CAST(count(*) FILTER (WHERE id IS NULL) AS BIGINT) AS null_id,
               CAST(count(*) FILTER (WHERE title IS NULL) AS BIGINT) AS null_title,
               CAST(count(*) FILTER (WHERE authors IS NULL) AS BIGINT) AS null_authors,
               CAST(count(*) FILTER (WHERE published_date IS NULL) AS BIGINT) AS null_published_date,
               CAST(count(*) FILTER (WHERE abstract IS NULL) AS BIGINT) AS null_abstract,
               CAST(count(*) FILTER (WHERE url IS NULL) AS BIGINT) AS null_url,
               CAST(count(*) FILTER (WHERE embedding IS NULL) AS BIGINT) AS null_embedding,
               CAST(count(*) FILTER (WHERE ingested_at IS NULL) AS BIGINT) AS null_ingested_at,
               CAST(count(*) FILTER (WHERE id IS NULL) + count(*) FILTER (WHERE title IS NULL) +
                    count(*) FILTER (WHERE authors IS NULL) + count(*) FILTER (WHERE published_date IS NULL) +
                    count(*) FILTER (WHERE abstract IS NULL) + count(*) FILTER (WHERE url IS NULL) +
                    count(*) FILTER (WHERE embedding IS NULL) + count(*) FILTER (WHERE ingested_at IS NULL) AS BIGINT) AS violations
        FROM corpus"""),
    "corpus_upsert": sql(_CORPUS_ROWS),
    "stream_upsert": sql(_CORPUS_ROWS),
    "call_ledger": """
WITH d AS (SELECT count(*) AS n, count(DISTINCT text) AS c, sum(len(text)) AS t FROM documents WHERE text IS NOT NULL)
SELECT r AS run, n AS inputs, c AS calls, CASE r WHEN 1 THEN 0 ELSE c END AS known, CASE r WHEN 1 THEN c ELSE 0 END AS called,
  n AS answers, CAST(t AS BIGINT) AS tokens, c AS held FROM d, (VALUES (1), (2)) v(r)""",
    "ingest_progress": """
WITH d AS (SELECT count(*) AS n FROM documents), p AS (SELECT count(*) AS n FROM pages), b(i) AS (VALUES (0), (1), (2))
SELECT CAST(i AS BIGINT) AS batch_id, 'started' AS status, CAST(NULL AS BIGINT) AS input_rows, CAST(NULL AS BIGINT) AS affected FROM b
UNION ALL SELECT CAST(i AS BIGINT), 'progress', d.n + CASE WHEN i < 2 THEN p.n ELSE 0 END, CASE WHEN i = 0 THEN d.n + p.n ELSE 0 END FROM b, d, p
UNION ALL SELECT NULL, 'done', NULL, NULL FROM b""",
    "upsert_affected": sql("""
        SELECT CAST(count(*) FILTER (WHERE t.id IS NOT NULL AND s.id IS NOT NULL) AS BIGINT) AS updated,
               CAST(count(*) FILTER (WHERE t.id IS NULL) AS BIGINT) AS inserted,
               CAST(count(*) FILTER (WHERE s.id IS NULL) AS BIGINT) AS untouched,
               CAST(count(*) FILTER (WHERE s.id IS NOT NULL) AS BIGINT) AS affected
        FROM (SELECT id FROM target) t FULL OUTER JOIN (SELECT id FROM src_rows) s ON s.id = t.id"""),
    "corpus_clear": sql("""SELECT CAST(count(*) AS BIGINT) AS rows_before, CAST(count(*) AS BIGINT) AS deleted_rows,
                           CAST(0 AS BIGINT) AS rows_after FROM target"""),
    "ingest_summary": sql(f"""
        SELECT s.fetched, CAST(CASE WHEN s.fetched > 0 THEN s.fetched ELSE 0 END AS BIGINT) AS affected,
               CASE WHEN s.fetched > 0 THEN u.total END AS total_rows, s.tokens,
               round_even(CAST(s.tokens AS DOUBLE) / 1e6 * 0.15, 4) AS cost_usd
        FROM (SELECT CAST(count(*) AS BIGINT) AS fetched, CAST(COALESCE(sum({ntok('abstract')}), 0) AS BIGINT) AS tokens FROM src_rows) s,
             (SELECT CAST(count(*) AS BIGINT) AS total FROM upserted) u"""),
    "topic_filter": _topic(),
    "newest_n": sql("SELECT id, published_date FROM corpus ORDER BY published_date DESC, id LIMIT 400"),
    "newest_page": sql("SELECT id, published_date FROM corpus ORDER BY published_date DESC, id LIMIT 100 OFFSET 100"),
    "embed_corpus": sql("""SELECT CAST(id AS VARCHAR) AS paper_id, CAST(sum(c) AS BIGINT) AS n_tokens, CAST(count(*) AS BIGINT) AS nnz,
                           round_even(sum(c) / sqrt(sum(c * c)), 6) AS l1 FROM dtf GROUP BY id"""),
    "embed_tokens": sql(f"""SELECT CAST(count(DISTINCT id) AS BIGINT) AS texts, CAST(sum(c) AS BIGINT) AS input_tokens,
                            round_even({price(f"'{'gemini-embedding-001'}'", 'sum(c)', '0')}, 6) AS cost_usd FROM dtf"""),
    "normalize_id": """
        SELECT page_id, url,
               CASE WHEN strpos(string_split(string_split(url, '/')[-1], '.')[-1], 'v') > 0
                    THEN string_split(string_split(url, '/')[-1], 'v')[1]
                    ELSE string_split(url, '/')[-1] END AS paper_id
        FROM pages""",
    "normalize_url": "SELECT page_id, replace(url, 'http://', 'https://') AS url FROM pages",
    "normalize_text": f"""SELECT doc_id, CAST(length({collapse('text')}) AS BIGINT) AS chars, md5({collapse('text')}) AS text_md5
                         FROM documents""",
    "feed_parse": f"""
        SELECT page_id,
               CASE WHEN strpos(string_split(string_split(url, '/')[-1], '.')[-1], 'v') > 0
                    THEN string_split(string_split(url, '/')[-1], 'v')[1]
                    ELSE string_split(url, '/')[-1] END AS id,
               {collapse("regexp_extract(html, '<title>(.*?)</title>', 1)")} AS title, '' AS authors,
               replace(url, 'http://', 'https://') AS url,
               CAST(length({collapse("regexp_replace(html, '<[^>]*>', ' ', 'g')")}) AS BIGINT) AS abstract_chars,
               md5({collapse("regexp_replace(html, '<[^>]*>', ' ', 'g')")}) AS abstract_md5
        FROM pages""",
    "feed_entries": f"""
        SELECT CAST(doc_id AS VARCHAR) AS id, {collapse(f"substring({collapse('text')}, 1, 80)")} AS title,
               source || ', ' || lang AS authors, strftime(DATE '2024-01-01' + CAST(doc_id % 365 AS INTEGER), '%Y-%m-%d') AS published_date,
               'https://example.org/abs/' || CAST(doc_id AS VARCHAR) || 'v1' AS url, lang AS categories,
               md5({collapse('text')}) AS abstract_md5
        FROM documents""",
    "usage_cost": sql("""SELECT event_id, run_id, tool, model, input_tokens, output_tokens,
                         round_even(cost_usd, 10) AS cost_usd FROM usage"""),
    "trace_rows": sql("""
        SELECT run_id, CAST(row_number() OVER (PARTITION BY run_id ORDER BY ts, event_id) AS BIGINT) AS seq, tool,
               COALESCE(model, '-') AS model, CAST(input_tokens AS VARCHAR) AS in_tok, CAST(output_tokens AS VARCHAR) AS out_tok,
               printf('%.0f', latency_ms) AS latency_ms, printf('%.5f', cost_usd) AS cost_usd, substring(output_summary, 1, 60) AS output
        FROM usage"""),
    "trace_totals": sql("""SELECT run_id, CAST(sum(input_tokens) AS BIGINT) AS input_tokens,
                           CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(round_even(sum(CAST(cost_usd AS DECIMAL(38,10))), 5) AS DOUBLE) AS cost_usd
                           FROM usage GROUP BY run_id"""),
    "turn_usage": f"""
        SELECT run_id, input_tokens, output_tokens, model_turns,
               round_even({price(f"'{U.ORCHESTRATOR_MODEL}'", 'input_tokens', 'output_tokens')}, 10) AS cost_usd
        FROM (SELECT conv_id AS run_id,
                     CAST(sum(CASE WHEN role <> 'assistant' THEN {ntok('text')} ELSE 0 END) AS BIGINT) AS input_tokens,
                     CAST(sum(CASE WHEN role = 'assistant' THEN {ntok('text')} ELSE 0 END) AS BIGINT) AS output_tokens,
                     CAST(count(*) FILTER (WHERE role = 'assistant') AS BIGINT) AS model_turns
              FROM conversations GROUP BY conv_id)
        WHERE input_tokens > 0 OR output_tokens > 0""",
    "authoritative_answer": f"""
        SELECT conv_id, CASE WHEN a IS NOT NULL THEN 'validator' WHEN u IS NOT NULL THEN 'fallback' ELSE 'none' END AS answer_source,
               COALESCE(a, u, {lit(U.NO_ANSWER)}) AS answer
        FROM (SELECT conv_id,
                     arg_max(text, turn) FILTER (WHERE role = 'assistant' AND NOT regexp_full_match(text, '\\s*')) AS a,
                     arg_max(text, turn) FILTER (WHERE role = 'user' AND NOT regexp_full_match(text, '\\s*')) AS u
              FROM conversations GROUP BY conv_id)""",
    "usage_by_day": sql("""
        SELECT strftime(time_bucket(INTERVAL 1 day, ts), '%Y-%m-%d') AS day, tool, CAST(count(*) AS BIGINT) AS calls,
               CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
               CAST(round_even(sum(CAST(cost_usd AS DECIMAL(38,10))), 6) AS DOUBLE) AS cost_usd
        FROM usage GROUP BY ALL"""),
}
_SM = FX.STEP_MODELS
ORACLE["step_trace"] = sql(f"""
SELECT run_id, CAST(step AS BIGINT) AS seq, tool, COALESCE(model, '-') AS model, input_tokens, output_tokens,
       round_even({price('model', 'input_tokens', 'output_tokens')}, 10) AS cost_usd, output_summary
FROM (
  SELECT q.qid AS run_id, 1 AS step, 'search_corpus' AS tool, '{_SM["search_corpus"]}' AS model,
         {ntok('q.question')} AS input_tokens, CAST(0 AS BIGINT) AS output_tokens,
         CAST(COALESCE(h.n, 0) AS VARCHAR) || ' results' AS output_summary
  FROM questions q LEFT JOIN (SELECT qid, count(*) AS n FROM hits GROUP BY qid) h ON h.qid = q.qid
  UNION ALL
  SELECT q.qid, 2, 'retrieve', NULL, CAST(0 AS BIGINT), CAST(0 AS BIGINT),
         CAST(COALESCE(r.n, 0) AS VARCHAR) || ' papers'
  FROM questions q LEFT JOIN (SELECT qid, count(*) AS n FROM retrieved GROUP BY qid) r ON r.qid = q.qid
  UNION ALL
  SELECT q.qid, 3, 'synthesize', CASE WHEN r.n IS NOT NULL THEN '{_SM["synthesize"]}' END,
         CASE WHEN r.n IS NOT NULL THEN CAST(COALESCE(p.pin, 0) AS BIGINT) ELSE 0 END,
         CASE WHEN r.n IS NOT NULL THEN CAST(COALESCE(c.cout, 0) AS BIGINT) ELSE 0 END,
         CASE WHEN r.n IS NOT NULL THEN CAST(COALESCE(c.n, 0) AS VARCHAR) || ' claims' ELSE '0 claims (nothing retrieved)' END
  FROM questions q LEFT JOIN (SELECT qid, count(*) AS n FROM retrieved GROUP BY qid) r ON r.qid = q.qid
  LEFT JOIN (SELECT q.qid, {ntok("'Research question: ' || q.question || chr(10) || chr(10) || 'Retrieved abstracts:' || chr(10) || chr(10) || s.block")} AS pin
             FROM questions q JOIN (SELECT qid, string_agg('paper_id: ' || paper_id || chr(10) || 'title: ' || title || chr(10) || 'abstract: ' || abstract, chr(10) || chr(10) ORDER BY rank) AS block
                                    FROM retrieved GROUP BY qid) s ON s.qid = q.qid) p ON p.qid = q.qid
  LEFT JOIN (SELECT qid, count(*) AS n, sum({ntok('text')}) AS cout FROM claims GROUP BY qid) c ON c.qid = q.qid
  UNION ALL
  SELECT c.qid, 4, 'validate', CASE WHEN c.claim_count > 0 THEN '{_SM["validate"]}' END,
         CASE WHEN c.claim_count > 0 THEN CAST(COALESCE(b.bin, 0) AS BIGINT) ELSE 0 END,
         CASE WHEN c.claim_count > 0 THEN CAST(COALESCE(v.rout, 0) AS BIGINT) ELSE 0 END,
         CASE WHEN c.claim_count > 0 THEN CAST(c.supported_count AS VARCHAR) || ' supported, ' ||
              CAST(c.unsupported_count AS VARCHAR) || ' unsupported' ELSE '0 claims to validate (empty synthesis)' END
  FROM counts c LEFT JOIN (SELECT qid, {ntok('block')} AS bin FROM cblock) b ON b.qid = c.qid
  LEFT JOIN (SELECT qid, sum({ntok('reasoning')}) AS rout FROM verdicts GROUP BY qid) v ON v.qid = c.qid
  UNION ALL
  SELECT q.qid, 5, 'orchestrator', '{_SM["orchestrator"]}', {ntok('q.question')}, {ntok('a.final_markdown')}, 'final answer'
  FROM questions q JOIN answers a ON a.qid = q.qid)""")
ORACLE["vector_search_ivf"] = sql(_KNN.format(qk="vec_id", qv="e", dk="id", dv="embedding",
                                              qs="(SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)",
                                              ds="corpus", where="WHERE d.embedding IS NOT NULL", k=FX.K)
                                  .replace("SELECT qid, CAST(rank AS INTEGER) AS rank, paper_id, dist,",
                                           "SELECT qid, CAST(rank AS INTEGER) AS rank, paper_id,"))
ORACLE["vector_search_grid"] = ORACLE["vector_search_ivf"]
ORACLE["vector_search_index"] = ORACLE["vector_search_ivf"]
ORACLE["usage_by_day_stream"] = ORACLE["usage_by_day"]

# claims ranked by BM25: k1 1.2, b 0.75, 0.3 of the question's weight, 40 percent new words
ORACLE["synthesize_ranked"] = sql(f"""SELECT qid, claim_id, text, paper_ids, round(score, 6) AS score FROM (
  WITH qw AS (SELECT DISTINCT qid, unnest(regexp_extract_all(lower(question), {TOK})) AS tok FROM questions),
  dw AS (SELECT tok, count(*) AS df FROM (
      SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), {TOK})) AS tok FROM documents) GROUP BY tok),
  size AS (SELECT count(text) AS n FROM documents),
  mean AS (SELECT avg(n) AS m FROM (
      SELECT len(list_distinct(regexp_extract_all(lower(s), {TOK}))) AS n
      FROM (SELECT unnest(regexp_extract_all(text, '[^.!?]+[.!?]')) AS s FROM documents)) WHERE n > 0),
  w AS (SELECT qw.qid, qw.tok, ln(1.0 + (size.n - COALESCE(dw.df, 0) + 0.5) / (COALESCE(dw.df, 0) + 0.5)) AS idf
        FROM qw CROSS JOIN size LEFT JOIN dw ON dw.tok = qw.tok),
  total AS (SELECT qid, sum(idf) AS total FROM w GROUP BY qid),
  se AS (SELECT qid, rank, paper_id, unnest(ss) AS s, generate_subscripts(ss, 1) AS p
         FROM (SELECT qid, rank, paper_id, regexp_extract_all(abstract, '[^.!?]+[.!?]') AS ss FROM retrieved)),
  sw AS (SELECT DISTINCT qid, rank, p, unnest(regexp_extract_all(lower(s), {TOK})) AS tok FROM se),
  got AS (SELECT sw.qid, sw.rank, sw.p, count(*) AS n, sum(w.idf) AS held
          FROM sw LEFT JOIN w ON w.qid = sw.qid AND w.tok = sw.tok GROUP BY ALL),
  near AS (SELECT got.qid, got.rank, got.p, got.n,
                  round(held * 2.2 / (1 + 1.2 * (1 - 0.75 + 0.75 * got.n / mean.m)), 9) AS score
           FROM got JOIN total ON total.qid = got.qid CROSS JOIN mean WHERE round(held / total.total, 9) >= 0.3),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, rank, p) AS turn FROM near),
  novel AS (SELECT qid, turn, count(*) AS novel FROM (
      SELECT r.qid, sw.tok, min(r.turn) AS turn
      FROM ranked r JOIN sw ON sw.qid = r.qid AND sw.rank = r.rank AND sw.p = r.p GROUP BY r.qid, sw.tok) GROUP BY ALL)
  SELECT r.qid, CAST(row_number() OVER (PARTITION BY r.qid ORDER BY r.turn) AS INTEGER) AS claim_id,
         trim(se.s) AS text, se.paper_id AS paper_ids, r.score
  FROM ranked r JOIN novel USING (qid, turn) JOIN se ON se.qid = r.qid AND se.rank = r.rank AND se.p = r.p
  WHERE r.turn = 1 OR novel.novel * 100 >= r.n * 40)""")
