"""Built-in deterministic embedder (M1 default): hashed term frequencies.

Each lower-cased letter/digit token goes to bucket
``int(first 8 hex digits of md5(token), 16) % dims``; the vector is the
bucket counts divided by their L2 norm. It is a function of one row: tokens
and buckets are built-in expressions, and one numpy count per bounded slice of
an Arrow batch makes the unit vectors. Nothing is shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidentia.functions.text import tokens
from evidentia.operators.sizing import spread

DEFAULT_DIMS = 256
MODEL_NAME = "hashed-tf-256"


def bucket_of(tok: Column, dims: int = DEFAULT_DIMS) -> Column:
    return (F.conv(F.substring(F.md5(tok), 1, 8), 16, 10).cast("long") % F.lit(dims)).cast("int")


SLICE_ROWS = 512               # texts counted at once, at most
SLICE_BUCKETS = 1 << 20        # tokens counted at once, at most, but for one longer text


def _slices(lens: np.ndarray):
    """(from, to) of slices of at most SLICE_ROWS texts and SLICE_BUCKETS tokens."""
    ends, lo = np.cumsum(lens), 0
    while lo < len(lens):
        before = ends[lo - 1] if lo else 0
        hi = int(np.searchsorted(ends, before + SLICE_BUCKETS, side="right"))
        hi = min(max(hi, lo + 1), lo + SLICE_ROWS, len(lens))
        yield lo, hi
        lo = hi


def _vectors(dims: int, nkeys: int, names: list[str]):
    """(keys..., buckets) -> (keys..., unit vector, number of tokens, buckets
    in use): a worker holds an Arrow batch of buckets and the vectors of one slice."""
    def run(batches):
        for rb in batches:
            rb = rb.filter(pc.fill_null(pc.greater(pc.list_value_length(rb.column(nkeys)), 0), False))
            col = rb.column(nkeys)
            for lo, hi in _slices(np.diff(col.offsets.to_numpy())):
                part = col.slice(lo, hi - lo)
                lens = np.diff(part.offsets.to_numpy())
                cell = np.repeat(np.arange(hi - lo) * dims, lens) + part.flatten().to_numpy()
                m = np.bincount(cell, minlength=(hi - lo) * dims).reshape(hi - lo, dims).astype(np.float64)
                nnz = (m > 0).sum(axis=1)
                m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
                vec = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1, dtype=np.int32) * dims), pa.array(m.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [*(rb.column(i).slice(lo, hi - lo) for i in range(nkeys)), vec, pa.array(lens.astype(np.int64)),
                     pa.array(nnz.astype(np.int64))], names=names)
    return run


def hashed_tf(df: DataFrame, keys: list[str] | str, text_col: str,
              dims: int = DEFAULT_DIMS, out: str = "embedding") -> DataFrame:
    """(keys..., embedding array<double>, n_tokens, nnz) for every row whose
    text has at least one token. Texts without tokens have no vector (zero
    norm) and are absent: callers left-join to keep and count them."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    buckets = F.transform(tokens(text_col), lambda t: bucket_of(t, dims))
    rows = spread(df).select(*keys, buckets.alias("_b"))        # a filter on the buckets would make them twice
    schema = T.StructType([*(rows.schema[k] for k in keys), T.StructField(out, T.ArrayType(T.DoubleType())),
                           T.StructField("n_tokens", T.LongType()), T.StructField("nnz", T.LongType())])
    return rows.mapInArrow(_vectors(dims, len(keys), schema.fieldNames()), schema)
