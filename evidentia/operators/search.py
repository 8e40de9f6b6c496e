"""Top-k cosine vector search for a whole table of queries.

Plan: the query side is bounded and checked (rows x dims x 8 bytes), then
shipped once to every executor as a broadcast variable. The corpus is never
shuffled: each task streams its Arrow batches of (id, vector), takes matrix
products of bounded cells and keeps only the k best per query
(``mapInArrow``, ``grid.Nearest``). The survivors (tasks x queries x k rows)
meet in one window ``row_number() <= k`` per query; with many queries there are
as many tasks as cores. No pair of (query, document) is ever materialised as a
row, and the work stays in BLAS.

Query sets above the broadcast bound go block by block: one block is on the
driver and in a task at a time, each is one scan of the corpus, and its hits
are merged in two steps and written before the next. The rules for vectors,
ties and results are the same.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidentia.operators.grid import CELL_QUERIES, CELL_ROWS, Nearest, RANK_DECIMALS, merge_topk as _merge_topk, usable  # noqa: F401
from evidentia.session import cut_lineage

DEFAULT_K = 5
# Upper bound for the broadcast query block (rows x dims x 8 bytes).
MAX_QUERY_BLOCK_BYTES = 256 << 20
TASK_GROUPS = 256              # groups of tasks whose hits of a block are merged first
MANY_HITS = 100_000            # hits of a task from which on a scan has no more tasks than cores
LIST_ROWS = 40_960             # rows that a task puts together before it goes through them list by list


def id_type(df: DataFrame, col: str) -> T.DataType:
    """Question ids stay what they are: whole numbers as long, others as string."""
    return T.LongType() if isinstance(df.schema[col].dataType, T.IntegralType) else T.StringType()


def hits_schema(qid: T.DataType) -> T.StructType:
    return T.StructType([
        T.StructField("qid", qid, False),
        T.StructField("paper_id", T.StringType(), False),
        T.StructField("distance", T.DoubleType(), False),
        T.StructField("dkey", T.DoubleType(), False),
    ])


def one_length(queries: DataFrame, vec: str) -> tuple[int, int]:
    """(number, length) of the query vectors; different lengths are refused."""
    st = queries.agg(F.count(F.lit(1)).alias("n"), F.min(F.size(vec)).alias("lo"), F.max(F.size(vec)).alias("hi")).first()
    if st["n"] and st["lo"] != st["hi"]:
        raise ValueError(f"query vectors of different lengths: {st['lo']} to {st['hi']}")
    return st["n"], st["hi"] or 0


def valid_vectors(df: DataFrame, vec: str, dims: int) -> DataFrame:
    """Rows whose vector is present and of the right length. Zero-norm rows
    are dropped inside the scan (their cosine is undefined)."""
    return df.filter(F.size(vec) == F.lit(dims))


def vector_health(df: DataFrame, vec: str = "embedding", dims: int | None = None) -> DataFrame:
    """Counts of vectors excluded from search: null, wrong length, zero norm."""
    sq = F.aggregate(F.col(vec), F.lit(0.0), lambda acc, x: acc + F.coalesce(x, F.lit(0.0)) * F.coalesce(x, F.lit(0.0)))
    wrong = (F.size(vec) != F.lit(dims)) if dims is not None else F.lit(False)
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col(vec).isNull()).alias("null_vectors"),
        F.count_if(F.col(vec).isNotNull() & wrong).alias("wrong_length"),
        F.count_if(F.col(vec).isNotNull() & ~wrong & (sq == 0)).alias("zero_norm"),
    )


class MixedEmbeddersError(ValueError):
    """Vectors of different embedders (or versions) cannot be compared."""


def check_one_embedder(queries: DataFrame, corpus: DataFrame, col: str = "embedder") -> None:
    """Refuse a search that would compare vectors of different embedders
    (E23). Applies when both sides carry the embedder's name; the check is
    one small aggregate per side (distinct names are few)."""
    if col not in queries.columns or col not in corpus.columns:
        return
    names = set()
    for df in (queries, corpus):
        names |= {r[0] for r in df.select(col).distinct().limit(3).collect()}
    if len(names) > 1:
        raise MixedEmbeddersError(f"vectors from different embedders: {sorted(map(str, names))}; "
                                  "re-embed the corpus with one model")


def search_results(hits: DataFrame, papers: DataFrame, hits_rows_bound: int | None = None) -> DataFrame:
    """Search projection (P6): (qid, rank, paper_id, title, score), titles
    joined after top-k."""
    from evidentia.operators.sizing import broadcast_if_bounded
    h = broadcast_if_bounded(hits.select("qid", "rank", "paper_id", "score"), hits_rows_bound, row_bytes=48)
    return papers.select("paper_id", "title").join(h, "paper_id").select("qid", "rank", "paper_id", "title", "score")


def _collect_block(queries: DataFrame, qkey: str, qvec: str, dims: int, qnear: str | None = None):
    """The (size-checked) query block as numpy arrays (ids, unit vectors,
    nearest lists if ``qnear`` names them), gathered through Arrow: no
    per-value Python objects on the driver."""
    tbl = queries.select(F.col(qkey).cast(id_type(queries, qkey)), F.col(qvec), *([qnear] if qnear else [])).toArrow()
    if tbl.num_rows == 0:
        return np.zeros(0, dtype=object), np.zeros((0, dims)), np.zeros((0, 0), dtype=np.int32) if qnear else None
    qids = tbl.column(0).to_numpy()
    Q = np.asarray(tbl.column(1).combine_chunks().flatten().to_numpy(zero_copy_only=False),
                   dtype=np.float64).reshape(len(qids), dims)
    near = tbl.column(2).combine_chunks().flatten().to_numpy().reshape(len(qids), -1) if qnear else None
    ok = usable(Q)
    return qids[ok], Q[ok] / np.linalg.norm(Q[ok], axis=1, keepdims=True), None if near is None else near[ok]


def _asking(near: np.ndarray):
    """list -> places of the queries that look into it."""
    flat = near.ravel()
    order = np.argsort(flat, kind="stable")
    places = (order // max(1, near.shape[1])).astype(np.int64)
    ends = np.cumsum(np.bincount(flat)) if len(flat) else np.zeros(0, dtype=np.int64)
    return lambda at: places[(ends[at - 1] if at else 0):ends[at]] if at < len(ends) else places[:0]


def _put_together(batches, rows: int):
    """Batches joined up to ``rows`` rows."""
    held, n = [], 0
    for rb in batches:
        held.append(rb)
        n += rb.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _topk_fn(bq, k: int, dims: int, qid: pa.DataType, rows: int = CELL_ROWS, block: int = CELL_QUERIES):
    """(id, vector[, list]) -> the k best of a task per query: of all rows, or
    of those in the lists that the query looks into."""
    def run(batches):
        qids, Q, near = bq.value
        if not len(Q):
            return
        found = Nearest(Q, k, rows, block)
        asking = None if near is None else _asking(near)
        for rb in (batches if near is None else _put_together(batches, LIST_ROWS)):
            if rb.num_rows == 0:
                continue
            ids = np.asarray(rb.column(0).to_pylist(), dtype=object)
            flat = rb.column(1).flatten().to_numpy(zero_copy_only=False)
            D = np.asarray(flat, dtype=np.float64).reshape(-1, dims)
            ok = usable(D)
            D = D[ok] / np.linalg.norm(D[ok], axis=1, keepdims=True)
            ids = ids[ok]
            if asking is None:
                found.add(ids, D)
                continue
            lists = rb.column(2).to_numpy()[ok]
            order = np.argsort(lists, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(lists[order])) + 1):
                if len(part):
                    found.add(ids[part], D[part], asking(int(lists[part[0]])))
        for qi, pid, dist, key in found.best():
            yield pa.RecordBatch.from_arrays(
                [pa.array(qids[qi].tolist(), qid), pa.array(pid.tolist(), pa.string()),
                 pa.array(dist, pa.float64()), pa.array(key, pa.float64())],
                schema=pa.schema([("qid", qid, False), ("paper_id", pa.string(), False),
                                  ("distance", pa.float64(), False), ("dkey", pa.float64(), False)]))
    return run


def _search_block(queries: DataFrame, corpus: DataFrame, k: int, qkey: str, qvec: str,
                  ckey: str, cvec: str, dims: int, sent: list | None = None, *, qnear: str | None = None,
                  clist: str | None = None, rows: int = CELL_ROWS, cell: int = CELL_QUERIES) -> DataFrame:
    """The k best of every task for a block of queries; ``sent`` gets its
    broadcast. With ``qnear`` and ``clist`` a query looks into its lists only."""
    spark = corpus.sparkSession
    block = _collect_block(queries, qkey, qvec, dims, qnear)
    bq = spark.sparkContext.broadcast(block)
    if sent is not None:
        sent.append(bq)
    scan = valid_vectors(corpus.select(F.col(ckey).cast("string").alias("paper_id"),
                                       F.col(cvec).cast("array<double>").alias("v"), *([clist] if qnear else [])), "v", dims)
    if len(block[0]) * k > MANY_HITS:          # each task returns so many rows
        scan = scan.coalesce(spark.sparkContext.defaultParallelism)
    kind = id_type(queries, qkey)
    return scan.mapInArrow(_topk_fn(bq, k, dims, pa.int64() if isinstance(kind, T.LongType) else pa.string(), rows, cell),
                           hits_schema(kind))


def _in_blocks(q: DataFrame, corpus: DataFrame, k: int, n: int, dims: int, ckey: str, cvec: str,
               block_bytes: int, row_bytes: int | None = None, **how) -> DataFrame:
    """Hits of a query table that is too large for one broadcast: block after
    block, each one scan of the corpus, whose rows are never shuffled. The hits
    of a block are merged in two steps, first those of groups of tasks, so that
    no window holds the hits of all tasks; they are written before the next
    block is gathered, and only one block is held at a time."""
    blocks = max(1, min(n, -(-n * (row_bytes or dims * 8) // max(1, block_bytes))))
    found = None
    for i in range(blocks):
        sent: list = []
        part = q.filter(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == i)
        hits = _search_block(part, corpus, k, "qid", "qv", ckey, cvec, dims, sent, **how)
        w = Window.partitionBy("qid", "_tasks").orderBy("dkey", "paper_id")
        merged = hits.withColumn("_tasks", F.pmod(F.spark_partition_id(), F.lit(TASK_GROUPS))).withColumn(
            "_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r", "_tasks")
        done = cut_lineage(merged, "block-hits")
        sent[0].destroy()
        found = done if found is None else found.unionByName(done)
    return found


def best_of(hits: DataFrame, k: int) -> DataFrame:
    """(qid, rank, paper_id, distance, score, dkey): the k best hits of each
    query. The limit works in each task before the shuffle and after it."""
    w = Window.partitionBy("qid").orderBy("dkey", "paper_id")
    ranked = hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return ranked.select("qid", F.col("rank").cast("int").alias("rank"), "paper_id", "distance",
                         F.bround(1.0 - F.col("distance"), 4).alias("score"), "dkey")


def knn(queries: DataFrame, corpus: DataFrame, k: int = DEFAULT_K, *,
        qkey: str = "qid", qvec: str = "embedding",
        ckey: str = "paper_id", cvec: str = "embedding",
        max_block_bytes: int = MAX_QUERY_BLOCK_BYTES) -> DataFrame:
    """(qid, rank, paper_id, distance, score, dkey) with the k nearest corpus
    rows per query, by cosine distance, ties by paper_id. There is no score
    cut-off: k rows come back however far away they are.

    Corpus vectors that are null, of another length, zero or not finite take
    no part; so do null, zero or not finite queries; queries of different
    lengths are refused. Queries beyond ``max_block_bytes`` go in blocks of
    that size, one scan of the corpus each, and give the same rows."""
    if k < 1:
        raise ValueError("k must be at least 1")
    check_one_embedder(queries, corpus)
    q = queries.select(F.col(qkey).cast(id_type(queries, qkey)).alias("qid"),
                       F.col(qvec).cast("array<double>").alias("qv")).filter(F.col("qv").isNotNull())
    q = cut_lineage(q, "queries")          # sized, then read again: computed once
    n, d = one_length(q, "qv")
    if n * d * 8 > max_block_bytes:
        return best_of(_in_blocks(q, corpus, k, n, d, ckey, cvec, max_block_bytes), k)
    return best_of(_search_block(q, corpus, k, "qid", "qv", ckey, cvec, d), k)


class OneQueryError(ValueError):
    """The single-query search was given another number of queries."""


def search_one(query: DataFrame, corpus: DataFrame, k: int = DEFAULT_K, *, qvec: str = "embedding",
               ckey: str = "paper_id", cvec: str = "embedding") -> DataFrame:
    """Single-query form: one vector in ``query`` (one row, else refused). The
    answer is a global order by (distance, id) and a limit
    (TakeOrderedAndProject)."""
    check_one_embedder(query, corpus)
    q = query.select(F.lit(0).cast("long").alias("qid"), F.col(qvec).cast("array<double>").alias("qv"))
    rows = q.limit(2).collect()
    if len(rows) != 1:
        raise OneQueryError(f"search_one takes one query row, got {'none' if not rows else 'several'}")
    if rows[0]["qv"] is None:
        raise OneQueryError("search_one takes a query with a vector")
    q = q.sparkSession.createDataFrame(rows, "qid long, qv array<double>")
    hits = _search_block(q, corpus, k, "qid", "qv", ckey, cvec, len(rows[0]["qv"]))
    top = hits.orderBy("dkey", "paper_id").limit(k)
    return top.select(F.row_number().over(Window.orderBy("dkey", "paper_id")).cast("int").alias("rank"),
                      "paper_id", "distance", F.bround(1.0 - F.col("distance"), 4).alias("score"))
