"""Registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm import decontaminate as D
from evidentia.llm import exact_dedup as X
from evidentia.llm import hard_negatives as H
from evidentia.llm import jaccard_join as J
from evidentia.llm import language_model as LM
from evidentia.llm import line_dedup as L
from evidentia.llm import mixing as M
from evidentia.llm import quality as Q
from evidentia.llm import secrets as K
from evidentia.llm import spelling as P
from evidentia.llm import substring_dedup as S
from evidentia.llm import token_rollup as T
from evidentia.llm import url_filter as U
from evidentia.session import checkpoint_dir, cut_lineage, read_table, ship_package

# --- fixed values of the registered queries -------------------------------------
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
             ("allow", "com", "/fr/"), ("block", "com", "/de/")]
HELD_OUT = 2                   # op4: crc32(doc_id) mod 4 of rows whose labels are not learnt from
GOOD_SCORE = 0.7
# ----------------------------------------------------------------------------------


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    ship_package(spark)
    return read_table(spark, sf, "documents")


def op1_decontaminate(spark, sf):
    hits = D.benchmark_hits(_docs(spark, sf), read_table(spark, sf, "benchmark"))
    items = F.coalesce("hit_items", F.array().cast("array<string>"))
    return hits.select("doc_id", "n_words", "n_hit", F.size(items).cast("long").alias("n_items"),
                       F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
                       D.is_contaminated().alias("contaminated"))


def op2_mix(spark, sf):
    return M.mix_sources(_docs(spark, sf)).select("doc_id", "size", "source_size", "target", "taken")


def op3_line_dedup(spark, sf):
    return L.line_dedup(_docs(spark, sf))


def crc_rest(doc_id, modulo: int):
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulo))


def quality_model(spark, sf):
    """Fitted on labelled rows whose crc32(doc_id) mod 4 is not HELD_OUT."""
    labels = read_table(spark, sf, "labels").filter(crc_rest(F.col("doc_id"), 4) != HELD_OUT)
    return Q.train(_docs(spark, sf), labels)


def op4_quality(spark, sf):
    scored = Q.score(_docs(spark, sf), quality_model(spark, sf))
    held = F.coalesce(crc_rest(F.col("doc_id"), 4) == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score",
                         (F.col("score") >= GOOD_SCORE).cast("int").alias("predicted"))


def op5_near_dedup(spark, sf):
    return J.similar_classes(_docs(spark, sf))


def op6_exact_dedup(spark, sf):
    return X.exact_groups(_docs(spark, sf))


def op7_substring_dedup(spark, sf):
    return S.repeated_spans(_docs(spark, sf))


def op8_token_counts(spark, sf):
    """Four batches over all documents: insert everything; delete what is
    labelled toxic; re-count what is labelled bad without its digits; replay
    the deletes, which changes nothing."""
    docs, labels = _docs(spark, sf), read_table(spark, sf, "labels")
    counts = cut_lineage(T.counted(docs), "token-counts")
    roll = T.TokenRollup(spark, os.path.join(checkpoint_dir(spark), f"token-rollup-{uuid.uuid4().hex}"))
    roll.commit("0001", T.inserts(counts))
    toxic = labels.filter("toxic = 1").select("doc_id").distinct()
    bad = labels.filter("quality = 0 and toxic <> 1").select("doc_id").distinct()
    deleted = T.deletes(counts.join(toxic, "doc_id", "left_semi"))
    roll.commit("0002", deleted)
    # counted before the join, so that no text is shuffled
    again = T.counted(docs.withColumn("text", F.regexp_replace("text", "[0-9]+", "")))
    roll.commit("0003", T.revisions(counts.join(bad, "doc_id", "left_semi"), again.join(bad, "doc_id", "left_semi")))
    roll.commit("0002", deleted)
    return roll.totals()


def listed_urls(spark, sf) -> DataFrame:
    """The query's block list: canonical URLs of pages whose id is labelled toxic."""
    p = read_table(spark, sf, "pages").select("page_id", "url")
    bad = read_table(spark, sf, "labels").filter("toxic = 1").select("doc_id")
    return p.join(bad, p.page_id == bad.doc_id, "left_semi").select(
        U.canonical(U.host_of(F.col("url")), U.path_of(F.col("url"))).alias("key"))


def op9_url_filter(spark, sf):
    return U.url_filter(read_table(spark, sf, "pages"), listed_urls(spark, sf), URL_RULES)


def op10_language_model(spark, sf):
    return LM.model_scores(_docs(spark, sf))


def op11_secret_scan(spark, sf):
    found = K.find_secrets(_docs(spark, sf))
    base = [r.kind for r in K.BASE_RULES]

    def listed(spans):
        return F.array_join(F.transform(spans, K.span_key), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *[count(k) for k in base],
                        F.sha2(listed(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
                        listed(F.col("spans")).alias("spans"))


def op12_spelling_variants(spark, sf):
    return P.spelling_groups(P.vocabulary(_docs(spark, sf))).select("word", "form", "root", "n", "n_near", "form_n")


def op13_hard_negatives(spark, sf):
    ship_package(spark)
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return H.hard_negatives(read_table(spark, sf, "embeddings").withColumn("label", moved), F.col("id") % 100 == 0)


QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_mix, op3_line_dedup, op4_quality, op5_near_dedup,
                                   op6_exact_dedup, op7_substring_dedup, op8_token_counts, op9_url_filter,
                                   op10_language_model, op11_secret_scan, op12_spelling_variants,
                                   op13_hard_negatives)}

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'"
_SEP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _positions(k: int, kind: str, pattern: str, keep: str) -> str:
    """SQL of (doc_id, start, k, kind, end) of one rule: matches are marked
    with two characters that no text has, and positions are running sums."""
    quoted = pattern.replace("'", "''")
    return rf"""SELECT doc_id, r, start AS a, start + len(m) AS b, {k} AS k, '{kind}' AS kind FROM (
  SELECT doc_id, r, m, CAST(coalesce(sum(len(m) + len(rest)) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM (
    SELECT doc_id, r, i, CASE WHEN i = 1 THEN '' ELSE split_part(p, chr(57345), 1) END AS m,
      CASE WHEN i = 1 THEN p ELSE split_part(p, chr(57345), 2) END AS rest FROM (
      SELECT doc_id, r, unnest(ps) AS p, unnest(range(1, len(ps) + 1)) AS i FROM (
        SELECT doc_id, r, string_split(regexp_replace(t, '({quoted})', chr(57344) || '\1' || chr(57345), 'g'), chr(57344)) AS ps FROM d))))
WHERE m <> '' AND {keep}"""


_ASSIGN_NAME = ("(?:" + "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w)
                                 for w in ("password", "passwd", "secret", "token", "api_?key"))
                + r""")["']?\x20*[:=]\x20*["']?""")
_ASSIGN_VALUE = "[A-Za-z0-9+/_.=-]"
_SPANS = " UNION ALL ".join([
    _positions(1, "assign", _ASSIGN_NAME + _ASSIGN_VALUE + "+",
               f"regexp_full_match(m, '{(_ASSIGN_NAME + _ASSIGN_VALUE).replace(chr(39), chr(39) * 2)}{{12,}}')"),
    _positions(2, "access", "AKIA[A-Z0-9]+", "len(m) >= 18"),
    _positions(3, "hex", "[0-9a-f]+", "len(m) >= 16"),
    _positions(4, "pem", "-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----", "true"),
    _positions(5, "jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", "true")])

ORACLE = {
    "op1_decontaminate": rf"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text,''),{_AZ}), '{_SEP}'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, list_filter(regexp_split_to_array(translate(coalesce(text,''),{_AZ}), '{_SEP}'), lambda x: x <> '') AS w FROM benchmark),
iw AS (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM i WHERE len(w) > 0),
win AS (SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[s:s+12], ' ') AS t FROM iw),
lens AS (SELECT DISTINCT n FROM win),
dw AS (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS s FROM d, lens WHERE len(w) >= n),
h AS (SELECT dw.doc_id, dw.s, win.n, win.item FROM dw JOIN win ON win.n = dw.n AND win.t = array_to_string(dw.w[dw.s:dw.s+dw.n-1], ' ')),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM h) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)""",
    "op6_exact_dedup": r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t""",
    "op8_token_counts": r"""
WITH c AS (SELECT doc_id, source, lang, text, unnest(['space-1', 'alnum-1']) AS tokenizer FROM documents),
x AS (SELECT c.*, q.quality, q.toxic FROM c LEFT JOIN labels q USING (doc_id)),
k AS (SELECT source, lang, tokenizer, CASE WHEN quality = 0 AND toxic <> 1
    THEN regexp_replace(coalesce(text, ''), '[0-9]+', '', 'g') ELSE coalesce(text, '') END AS t
  FROM x WHERE coalesce(toxic, 0) <> 1)
SELECT source, lang, tokenizer, count(*) AS docs,
  CAST(sum(len(regexp_extract_all(t, CASE tokenizer WHEN 'space-1' THEN '[^\x20\x09-\x0D]+' ELSE '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+' END))) AS BIGINT) AS tokens
FROM k GROUP BY ALL""",
    "op9_url_filter": rf"""
WITH p AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), {_AZ}), '') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
k AS (SELECT *, CASE WHEN host <> '' THEN host || regexp_replace(path, '/+$', '') END AS key FROM p),
l AS (SELECT DISTINCT key FROM k WHERE page_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AND key IS NOT NULL),
r(verdict, h, q) AS (VALUES ('allow','org','/'), ('block','example.org','/es/'), ('block','example.org','/en/1'), ('allow','com','/fr/'), ('block','com','/de/')),
m AS (SELECT page_id, arg_max(r.h || r.q, length(r.h || r.q)) AS rule, arg_max(r.verdict, length(r.h || r.q)) AS v
  FROM p JOIN r ON (host = r.h OR suffix(host, '.' || r.h)) AND starts_with(path, r.q) GROUP BY page_id)
SELECT k.page_id, host, path, m.rule, coalesce(m.v, CASE WHEN l.key IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
  m.rule IS NULL AND l.key IS NOT NULL AS listed
FROM k LEFT JOIN m ON m.page_id = k.page_id LEFT JOIN l ON l.key = k.key""",
    "op11_secret_scan": rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents),
s AS ({_SPANS}),
x AS (SELECT r, count(*) FILTER (k = 1) AS n_assign, count(*) FILTER (k = 2) AS n_access, count(*) FILTER (k = 3) AS n_hex,
  string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, k) FILTER (k <= 3) AS base,
  string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, k) AS spans FROM s GROUP BY r)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN x USING (r)""",
    "op12_spelling_variants": rf"""
WITH RECURSIVE tab AS (SELECT list(v ORDER BY b) AS t FROM (SELECT b, list_reduce(list_prepend(CAST(b AS UINTEGER), CAST(range(8) AS UINTEGER[])),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(CAST(3988292384 AS UINTEGER), c >> 1) ELSE c >> 1 END) AS v FROM range(256) r(b))),
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')), {_AZ}) AS w FROM documents),
long AS (SELECT doc_id, w, count(*) AS c FROM runs WHERE len(w) >= 7 GROUP BY ALL),
hx AS (SELECT *, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w)) AS h FROM long),
crc AS (SELECT w, c, CAST(xor(list_reduce(list_prepend(CAST(4294967295 AS UINTEGER),
    list_transform(range(CAST(len(h) // 2 AS BIGINT)), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS UINTEGER))),
    lambda a, b: xor(t[1 + (xor(a, b) & 255)], a >> 8)), CAST(4294967295 AS UINTEGER)) AS BIGINT) AS k FROM hx, tab),
wd AS (SELECT CASE WHEN k % 31 = 0 THEN w[:k % len(w)] || w[k % len(w) + 2:] ELSE w END AS word, c FROM crc),
v AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM wd WHERE len(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
del AS (SELECT word, n, i, word[:i - 1] || word[i + 1:] AS x FROM (SELECT word, n, unnest(range(1, len(word) + 1)) AS i FROM v)),
near AS (SELECT a.word, b.word AS near, b.n FROM del a JOIN del b ON a.x = b.x AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM del a JOIN v b ON a.x = b.word
  UNION SELECT b.word, a.word, a.n FROM del a JOIN v b ON a.x = b.word),
best AS (SELECT word, count(*) AS n_near, max(n) AS top FROM near GROUP BY word),
form AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 10 * v.n THEN top END AS form_n,
  (SELECT min(near) FROM near x WHERE x.word = v.word AND x.n = best.top AND best.top >= 10 * v.n) AS form FROM v LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS root, form AS nxt FROM form
  UNION ALL SELECT c.word, c.nxt, f.form FROM chain c JOIN form f ON f.word = c.nxt)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM form f JOIN chain c ON c.word = f.word AND c.nxt IS NULL""",
    "op13_hard_negatives": r"""
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same,
    CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) QUALIFY row_number() OVER w <= 5""",
}
