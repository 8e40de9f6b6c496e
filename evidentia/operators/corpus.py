"""Corpus maintenance: idempotent upsert (S4-S6, U1), clear (S7), count
(S8), required-column check (S9), ingest summary (S11), newest-first
listing (T3, T4) and the topic predicate (P1, P2).

Storage layout for the table form: parquet in buckets, ``bucket =
pmod(xxhash64(id), B)``, and a log of commits that names the files of each
bucket (``commits.py``). An upsert writes its rows as a new generation, one more
run of the buckets its keys fall in; runs are merged only when they are small or
many (``runs_kept``). So its cost follows the size of the change, not of the
corpus, and it is seen as a whole or not at all.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidentia.functions.text import collapse_ws
from evidentia.operators.commits import (KEEP_VERSIONS, Commit, Run, commit_at, folder_names, publish, read_commit, vacuum,
                                         write_generation)
from evidentia.operators.sizing import broadcast_if_bounded
from evidentia.schemas import PAPERS, REQUIRED_PAPER_COLUMNS
from evidentia.session import drop_path, stage

DEFAULT_BUCKETS = 64
BUCKET_ROWS = 2_000_000        # rows per bucket that a table made from a sized source aims at
BUCKET_PARTS = 8               # tasks that write one bucket, at most
PART_ROWS = 10_000             # rows of a bucket from which on another task writes it too
SMALL_RUN = 1000               # a run of a bucket with fewer rows is merged with the next
RUNS = 16                      # runs of a bucket, at most
MAX_RESULTS_LIMIT = 2000       # bound of the interactive form; the batch job has none


class DuplicateKeyError(ValueError):
    pass


def check_limit(n: int, lo: int = 1, hi: int = MAX_RESULTS_LIMIT) -> int:
    """1 <= n <= hi, else ValueError (P10)."""
    if not isinstance(n, int) or n < lo or n > hi:
        raise ValueError(f"max_results must be between {lo} and {hi}, got {n!r}")
    return n


def duplicate_keys(source: DataFrame, key: str = "id") -> DataFrame:
    return source.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def require_unique(source: DataFrame, key: str = "id") -> None:
    """Staged rows must not repeat a key (a MERGE would be ambiguous)."""
    dup = duplicate_keys(source, key).limit(5).collect()
    if dup:
        raise DuplicateKeyError(f"duplicate source keys: {[r[key] for r in dup]}")


class RequiredColumnError(ValueError):
    pass


def require_columns(source: DataFrame, required: list[str] = REQUIRED_PAPER_COLUMNS) -> None:
    """Staged rows must have every required column (the load fails on a
    null in a REQUIRED field); one aggregate over the staged rows."""
    v = null_violations(source, required).first()
    bad = {c: v[f"null_{c}"] for c in required if v[f"null_{c}"]}
    if bad:
        raise RequiredColumnError(f"null values in required columns: {bad}")


def upsert_frame(target: DataFrame, source: DataFrame, key: str = "id",
                 source_rows_bound: int | None = None) -> DataFrame:
    """MERGE semantics as a frame: target rows without a source row stay,
    matched rows take every column from the source, new keys are inserted."""
    keys = broadcast_if_bounded(source.select(key), source_rows_bound, row_bytes=48)
    kept = target.join(keys, key, "left_anti")
    return kept.unionByName(source.select(*target.columns))


def upsert_counts(target: DataFrame, source: DataFrame, key: str = "id",
                  source_rows_bound: int | None = None) -> DataFrame:
    """(updated, inserted, untouched, affected): affected = updated + inserted,
    what the warehouse reports as DML-affected rows (S6).

    The staged keys are the small side: the target's keys are semi-joined
    against them (broadcast when their count bounds them), so the corpus is
    scanned once and never shuffled."""
    keys = source.select(key).distinct()
    bound = source_rows_bound if source_rows_bound is not None else None
    matched = target.select(key).join(broadcast_if_bounded(keys, bound, row_bytes=48), key, "left_semi")
    parts = (target.select(F.lit(1).alias("_t"), F.lit(0).alias("_s"), F.lit(0).alias("_m"))
             .unionByName(keys.select(F.lit(0).alias("_t"), F.lit(1).alias("_s"), F.lit(0).alias("_m")))
             .unionByName(matched.select(F.lit(0).alias("_t"), F.lit(0).alias("_s"), F.lit(1).alias("_m"))))
    c = parts.agg(F.sum("_t").alias("t"), F.sum("_s").alias("s"), F.sum("_m").alias("m"))
    return c.select(
        F.coalesce(F.col("m"), F.lit(0)).cast("long").alias("updated"),
        F.coalesce(F.col("s") - F.col("m"), F.lit(0)).cast("long").alias("inserted"),
        F.coalesce(F.col("t") - F.col("m"), F.lit(0)).cast("long").alias("untouched"),
        F.coalesce(F.col("s"), F.lit(0)).cast("long").alias("affected"))


def with_bucket(df: DataFrame, key: str = "id", buckets: int = DEFAULT_BUCKETS) -> DataFrame:
    return df.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))


TABLE_SCHEMA = T.StructType(PAPERS.fields + [T.StructField("bucket", T.IntegerType(), True)])


def read_table_at(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The stored corpus table as of its newest commit, or of ``version``."""
    return read_commit(spark, path, _commit(spark, path, version), TABLE_SCHEMA)


class BucketCountError(ValueError):
    pass


def _commit(spark: SparkSession, path: str, version: int | None = None) -> Commit:
    c = commit_at(spark, path, version)
    if c is None:
        raise BucketCountError(f"no corpus table at {path}")
    return c


def table_buckets(spark: SparkSession, path: str) -> int | None:
    """Bucket count stored with the table; None if there is no table."""
    c = commit_at(spark, path)
    return None if c is None else c.buckets


def buckets_for(rows: int) -> int:
    """Bucket count for a table expected to grow to ``rows`` rows."""
    return max(DEFAULT_BUCKETS, -(-rows // BUCKET_ROWS))


def create_table_if_absent(spark: SparkSession, path: str, buckets: int | None = None) -> int:
    """An empty corpus table with the fixed schema, if none exists.
    Returns the stored bucket count; a different one that is asked for is
    refused (ids would be looked for in the wrong bucket). Only a folder
    without commits makes a table: a failed read is raised, never taken for an
    absent table, and nothing that exists is overwritten. A creation or a first
    load that stopped before its commit has left nothing that counts, so it is
    simply done again; a folder with files of another kind is refused."""
    current = commit_at(spark, path)
    if current is None:
        foreign = [n for n, _ in folder_names(spark, path) if not n.startswith(("gen=", "_commits"))]
        if foreign:
            raise BucketCountError(f"{path} holds {foreign[:3]} but no commit")
        current = Commit(0, buckets or DEFAULT_BUCKETS, {}, 0)
        publish(spark, path, current)
    if buckets is not None and buckets != current.buckets:
        raise BucketCountError(f"table at {path} has {current.buckets} buckets, not {buckets}")
    return current.buckets


def _generation(path: str, rows: DataFrame, version: int, largest: int | None = None, key: str = "id") -> dict:
    """``rows`` written as a new generation: bucket -> its run, rows counted from
    the files. A bucket's rows are written by up to BUCKET_PARTS tasks (fewer
    where the ``largest`` bucket is known to be small), so no task holds a whole
    bucket."""
    parts = BUCKET_PARTS if largest is None else min(BUCKET_PARTS, -(-largest // PART_ROWS) or 1)
    part = F.pmod(F.xxhash64(F.col(key), F.lit(1)), F.lit(parts))
    held = {b: [Run(g, version, 0)] for b, g in write_generation(path, rows.repartition("bucket", part)).items()}
    written = read_commit(rows.sparkSession, path, Commit(0, 0, held), TABLE_SCHEMA)
    counts = {r["bucket"]: r["n"] for r in written.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {b: runs[0]._replace(rows=counts[b]) for b, runs in held.items()}


def runs_kept(runs: list[Run], rows: int) -> int:
    """How many of the runs of a bucket stay as they are when ``rows`` rows
    come; the others are merged with these. Small runs are; and where there
    would be more than RUNS, half of them at least, and as many more as are no
    larger than all after them. So a row is written again few times, whatever
    the number of changes."""
    keep = len(runs)
    while keep and runs[keep - 1].rows < SMALL_RUN:
        keep -= 1
        rows += runs[keep].rows
    if keep + 1 > RUNS:
        least = keep - RUNS // 2
        while keep and (keep > least or runs[keep - 1].rows <= rows):
            keep -= 1
            rows += runs[keep].rows
    return keep


def write_table(path: str, rows: DataFrame, buckets: int = DEFAULT_BUCKETS) -> None:
    """A new corpus table holding ``rows``; refuses a path that holds one. A
    write that stops half-way leaves no table, and can be done again."""
    spark = rows.sparkSession
    if commit_at(spark, path) is not None:
        raise FileExistsError(f"there is a table at {path}")
    held = _generation(path, with_bucket(rows.select(*PAPERS.fieldNames()), buckets=buckets), 0)
    publish(spark, path, Commit(0, buckets, {b: [r] for b, r in held.items()}, sum(r.rows for r in held.values())))


def keep_last(source: DataFrame, key: str = "id", order: str = "ingested_at") -> DataFrame:
    """One row per key: the last by ``order`` (ties: the largest row). For
    deliveries that repeat keys, where a batch load would be refused."""
    rest = [c for c in source.columns if c not in (key, order)]
    best = F.max(F.struct(F.col(order).alias("_order"), *rest)).alias("_last")
    return (source.groupBy(key).agg(best).select(key, "_last.*").withColumnRenamed("_order", order)
                  .select(*source.columns))


def fold_repeats(source: DataFrame, key: str = "id", order: str = "ingested_at") -> DataFrame:
    """As ``keep_last``, but only the rows of keys that come again are grouped."""
    again = source.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col(key).alias("_again"))
    n = again.count()
    if not n:
        return source
    keys = broadcast_if_bounded(again, n, row_bytes=48)
    same = F.col(key).eqNullSafe(F.col("_again"))
    return keep_last(source.join(keys, same, "left_semi"), key, order).unionByName(source.join(keys, same, "left_anti"))


def newer_rows(target: DataFrame, source: DataFrame, key: str = "id", order: str = "ingested_at") -> DataFrame:
    """The rows of ``source`` (one per key) that come after the stored row of
    their key: by ``order``, ties by the rest of the row as in ``keep_last``.
    Rows of new keys all count. Which of two versions is kept so never depends
    on the order in which they were delivered."""
    rest = [c for c in source.columns if c not in (key, order)]
    version = F.struct(F.col(order).alias("_order"), *rest)
    stored = target.select(F.col(key), version.alias("_stored"))
    late = source.withColumn("_version", version).join(stored, key, "left")
    return late.filter(F.col("_stored").isNull() | (F.col("_version") > F.col("_stored"))).select(*source.columns)


def _digest(columns: list[str]) -> Column:
    """SHA-256 of the columns: equal rows have equal ones."""
    return F.sha2(F.concat_ws(",", *[F.coalesce(F.sha2((F.col(c) if isinstance(PAPERS[c].dataType, T.StringType) else F.to_json(F.struct(c)))
                                                       .cast("binary"), 256), F.lit("-")) for c in columns]), 256)


def newer_keys(stored, source: DataFrame, key: str, order: str) -> tuple[DataFrame, int, int, int]:
    """The keys of ``newer_rows`` (as often as it returns a row), found from
    keys and ``order`` alone; other columns are read only where ``order`` ties, first
    as digests. ``stored`` gives the columns it is asked for. (keys, their number,
    pairs of a source and a stored row, these and the source rows without one)."""
    old = stored(key, F.col(order).alias("_old"), F.lit(True).alias("_held"))
    met = source.select(key, F.col(order).alias("_new")).join(old, key, "left")
    newer = F.col("_old").isNull() | (F.col("_new") > F.col("_old"))
    tie = F.col("_new") == F.col("_old")
    c = met.agg(F.count_if(newer).alias("newer"), F.count_if(tie).alias("ties"), F.count_if("_held").alias("pairs"),
                F.count_if(F.col("_held").isNull()).alias("fresh")).first()
    keys, n = met.filter(newer).select(key), c["newer"]
    if c["ties"]:
        rest = [x for x in source.columns if x not in (key, order, "bucket")]
        mine = source.select(key, F.col(order).alias("_at"), _digest(rest).alias("_mine"))
        theirs = stored(key, F.col(order).alias("_old"), _digest(rest).alias("_theirs"))
        other = mine.join(theirs, key).filter("_at = _old and _mine != _theirs").select(key).distinct().persist()
        m = other.count()
        if m:
            few = broadcast_if_bounded(other, m, row_bytes=48)
            won = newer_rows(stored(*source.columns).join(few, key, "left_semi").select(*source.columns).join(
                source.select(F.col(key).alias("_key"), F.col(order).alias("_at")),
                (F.col(key) == F.col("_key")) & (F.col(order) == F.col("_at")), "left_semi"),
                source.join(few, key, "left_semi"), key, order).select(key)
            keys, n = keys.unionByName(won), n + won.count()
        other.unpersist()
    return keys, n, c["pairs"], c["pairs"] + c["fresh"]


def merge_rows(spark: SparkSession, path: str, rows: DataFrame, key: str = "id", buckets: int | None = None,
               newest_by: str | None = None, keep_versions: int = KEEP_VERSIONS) -> tuple[int, int]:
    """``upsert_table`` of rows that are cheap to read again and do not repeat
    a key: (source rows, affected rows). Of the stored table keys and
    ``newest_by`` are read; rows are written once, with the runs that are merged."""
    paths = []
    by_bucket = lambda df: {r["bucket"]: r["n"] for r in df.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()}
    try:
        require_columns(rows)
        create_table_if_absent(spark, path, buckets)
        base = _commit(spark, path)
        src = with_bucket(rows, key, base.buckets)
        touched = by_bucket(src)                                 # <= buckets values
        delivered = affected = sum(touched.values())

        def stored(*columns):
            keys = broadcast_if_bounded(src.select(key), affected, row_bytes=48)
            return read_commit(spark, path, base, TABLE_SCHEMA, list(touched), key, keys, list(columns))

        replaced = None
        if newest_by and touched:
            keys, affected, replaced, pairs = newer_keys(stored, src, key, newest_by)
            if affected and not affected == pairs == delivered:
                taken = src.join(broadcast_if_bounded(keys, affected, row_bytes=48), key).select(*src.columns)
                src, at = stage(taken, "newer")
                paths.append(at)
                touched, replaced = by_bucket(src), None
        if not affected:
            return delivered, 0
        if replaced is None:
            replaced = stored(key).count()
        kept = {b: runs_kept(base.generations.get(b, []), n) for b, n in touched.items()}
        merged = {b: base.generations[b][k:] for b, k in kept.items() if k < len(base.generations.get(b, []))}
        out = src
        if merged:
            old = read_commit(spark, path, Commit(base.version, base.buckets, merged), TABLE_SCHEMA, key=key)
            out = upsert_frame(old.select(*src.columns), src, key, affected)
        largest = max(n + sum(r.rows for r in merged.get(b, [])) for b, n in touched.items())
        held = _generation(path, out, base.version + 1, largest, key)
        now = base.generations | {b: base.generations.get(b, [])[:kept[b]] + [held[b]] for b in touched}
        publish(spark, path, Commit(base.version + 1, base.buckets, now,
                                    None if base.rows is None else base.rows - replaced + affected))
        vacuum(spark, path, keep_versions)
    finally:
        for at in paths:
            drop_path(spark, at)
    return delivered, affected


def upsert_table(spark: SparkSession, path: str, source: DataFrame, key: str = "id",
                 buckets: int | None = None, newest_by: str | None = None,
                 keep_versions: int = KEEP_VERSIONS) -> int:
    """Upsert ``source`` into the corpus table at ``path``; returns the number
    of affected rows. Only the buckets the source touches are read; its rows are
    written once, as a new generation, and one commit makes them
    the table. A change that stops before it leaves the table as it was.
    Running it twice with the same source gives the same table.

    With ``newest_by`` a source row replaces a stored one only if it is the
    newer version (``newer_rows``); a delivery with nothing newer changes
    nothing and commits nothing."""
    # Stage the source once as a written table; the checks, the bucket
    # list and the merge all read the staged rows, so an expensive source
    # (embedding calls) is never recomputed
    staged, at = stage(source.select(*PAPERS.fieldNames()), "staging")
    try:
        require_unique(staged, key)
        return merge_rows(spark, path, staged, key, buckets, newest_by, keep_versions)[1]
    finally:
        drop_path(spark, at)


def read_ids(spark: SparkSession, path: str, ids: DataFrame, key: str = "id",
             ids_rows_bound: int | None = None) -> DataFrame:
    """Rows of the stored corpus whose id is in ``ids`` (P3 against the
    table). The ids' buckets, by the table's stored bucket count, become a
    partition filter, so only the files of touched buckets are listed and
    read; the id set is then a semi join (broadcast under its bound)."""
    base = _commit(spark, path)
    want = ids.select(F.col(key).alias("id")).distinct()
    touched = [r["bucket"] for r in with_bucket(want, buckets=base.buckets).select("bucket").distinct().collect()]
    t = read_commit(spark, path, base, TABLE_SCHEMA, touched).filter(F.col("bucket").isin(touched))
    return t.join(broadcast_if_bounded(want, ids_rows_bound, row_bytes=48), "id", "left_semi").drop("bucket")


def clear_table(spark: SparkSession, path: str, keep_versions: int = KEEP_VERSIONS) -> int:
    """Delete every row, keep the table, its schema and its bucket count: a
    commit that names no generation. Readers see all rows or none."""
    create_table_if_absent(spark, path)
    base = _commit(spark, path)
    n = read_commit(spark, path, base, TABLE_SCHEMA).count()
    publish(spark, path, Commit(base.version + 1, base.buckets, {}, 0))
    vacuum(spark, path, keep_versions)
    return n


def clear_counts(spark: SparkSession, path: str) -> DataFrame:
    """(rows_before, deleted_rows, rows_after) of really clearing the table
    at ``path`` and reading it again (S7)."""
    before = read_table_at(spark, path).count()
    deleted = clear_table(spark, path)
    after = corpus_count(read_table_at(spark, path))
    return after.select(F.lit(before).cast("long").alias("rows_before"), F.lit(deleted).cast("long").alias("deleted_rows"),
                        F.col("n").alias("rows_after"))


def corpus_count(corpus: DataFrame) -> DataFrame:
    return corpus.agg(F.count(F.lit(1)).cast("long").alias("n"))


def null_violations(df: DataFrame, required: list[str] = REQUIRED_PAPER_COLUMNS) -> DataFrame:
    """One row: null count of every required column, and their total."""
    cols = [F.count_if(F.col(c).isNull()).cast("long").alias(f"null_{c}") for c in required]
    out = df.agg(*cols)
    return out.withColumn("violations", reduce(lambda a, b: a + b, [F.col(f"null_{c}") for c in required]))


def newest(corpus: DataFrame, n: int = 400, start: int = 0) -> DataFrame:
    """Newest first (ties by id), rows start..start+n-1."""
    o = corpus.orderBy(F.desc("published_date"), F.asc("id"))
    if start:
        o = o.offset(start)
    return o.limit(n)


# --- topic predicate ----------------------------------------------------------

# fixed values: the default topic (three categories, twelve clauses; every
# clause is a conjunction of phrases that must all occur in the abstract).
DEFAULT_CATEGORIES = ["cs.SE", "cs.CL", "cs.AI"]
DEFAULT_CLAUSES = [
    ("prompt engineering", "code"),
    ("prompt pattern", "code"),
    ("chain-of-thought", "code generation"),
    ("chain of thought", "code generation"),
    ("few-shot prompting", "code generation"),
    ("in-context learning", "code generation"),
    ("code generation", "large language model"),
    ("code generation", "prompt"),
    ("code quality", "language model"),
    ("LLM-generated code",),
    ("cyclomatic complexity", "language model"),
    ("defect density", "code"),
]


def topic_predicate(text_col: str = "abstract", category_col: str | None = "categories",
                    categories=None, clauses=None) -> Column:
    """category in the set AND (one of the clauses holds), on lower-cased,
    whitespace-collapsed text. A string category column is one category."""
    categories = DEFAULT_CATEGORIES if categories is None else categories
    clauses = DEFAULT_CLAUSES if clauses is None else clauses
    t = F.lower(collapse_ws(text_col))
    body = reduce(lambda a, b: a | b,
                  [reduce(lambda x, y: x & y, [F.instr(t, p.lower()) > 0 for p in cl]) for cl in clauses])
    if category_col is None:
        return body
    return F.col(category_col).isin(list(categories)) & body


def topic_filter(df: DataFrame, predicate: Column | str | None = None, **kw) -> DataFrame:
    """Keep the rows on topic. ``predicate``: a Column, a SQL string, or None
    for the default topic. An array category column matches when any of
    its categories is in the set."""
    if predicate is None:
        cat = kw.get("category_col", "categories")
        if cat in df.columns and isinstance(df.schema[cat].dataType, T.ArrayType):
            cats = kw.pop("categories", None) or DEFAULT_CATEGORIES
            kw["category_col"] = None
            predicate = F.arrays_overlap(F.col(cat), F.array(*[F.lit(c) for c in cats])) & topic_predicate(**kw)
        else:
            predicate = topic_predicate(**kw)
    return df.filter(F.expr(predicate) if isinstance(predicate, str) else predicate)


def ingest_summary(source: DataFrame, counts: DataFrame, result: DataFrame,
                   token_col: str = "n_tokens", price_per_1m: float = 0.15) -> DataFrame:
    """One row: fetched, affected, total_rows, tokens, cost_usd (S11). An
    empty fetch reports total_rows null and touches nothing."""
    s = source.agg(F.count(F.lit(1)).cast("long").alias("fetched"),
                   F.coalesce(F.sum(token_col), F.lit(0)).cast("long").alias("tokens"))
    r = result.agg(F.count(F.lit(1)).cast("long").alias("_total"))
    # three single-row frames, stacked and folded into one row without a join
    rows = (s.select("fetched", "tokens", F.lit(None).cast("long").alias("affected"), F.lit(None).cast("long").alias("_total"))
             .unionByName(counts.select(F.lit(None).cast("long").alias("fetched"), F.lit(None).cast("long").alias("tokens"),
                                        F.col("affected"), F.lit(None).cast("long").alias("_total")))
             .unionByName(r.select(F.lit(None).cast("long").alias("fetched"), F.lit(None).cast("long").alias("tokens"),
                                   F.lit(None).cast("long").alias("affected"), "_total")))
    one = rows.agg(F.max("fetched").alias("fetched"), F.max("affected").alias("affected"),
                   F.max("_total").alias("_total"), F.max("tokens").alias("tokens"))
    return one.select(
        "fetched",
        F.when(F.col("fetched") > 0, F.col("affected")).otherwise(F.lit(0)).cast("long").alias("affected"),
        F.when(F.col("fetched") > 0, F.col("_total")).alias("total_rows"),
        F.when(F.col("fetched") > 0, F.col("tokens")).otherwise(F.lit(0)).cast("long").alias("tokens"),
        F.bround(F.col("tokens").cast("double") / F.lit(1e6) * F.lit(price_per_1m), 4).alias("cost_usd"))
