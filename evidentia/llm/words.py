"""Vectorised words and word hashes of Arrow text columns.

Everything here works on one bounded block of rows inside a Spark task.
Separators are ASCII in every operator, so UTF-8 text is cut at byte level.
Null texts count as empty.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20          # text handled at once; one longer text is its own block
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_POW: list = [None, None]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads a 64-bit value over all its bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int):
    if _POW[0] is None or len(_POW[0]) < n:
        size = max(n, BLOCK_BYTES * 2)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for k, base in enumerate((_BASE, inverse)):
            x = np.full(size, base, dtype=np.uint64)
            x[0] = 1
            _POW[k] = np.multiply.accumulate(x)
    return _POW[0][:n], _POW[1][:n]


def byte_tables(white_space: bool, lower: bool):
    """(is a word byte, value of a byte). White-space words end at
    [\\x20\\x09-\\x0D]; the others hold only 0-9, a-z and non-ASCII."""
    word = np.ones(256, dtype=bool)
    if white_space:
        word[[32, *range(9, 14)]] = False
    else:
        word[:128] = False
        word[48:58] = word[97:123] = word[65:91] = True
    value = np.arange(256)
    if lower:
        value[65:91] += 32
    return word, mix((value + 1).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))


@dataclass
class Words:
    """Words of a block of rows: row number, byte span and 64-bit hash of
    each word, and ``ptr``, the first word of each row (rows + 1 entries)."""
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    ptr: np.ndarray
    data: np.ndarray

    @property
    def counts(self):
        return np.diff(self.ptr)

    def text(self, i: int) -> bytes:
        return self.data[self.start[i]:self.end[i]].tobytes()


def words(col: pa.Array, tables, newline: bool = False) -> Words:
    """Words of every text of ``col``."""
    is_word, value = tables
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_string()), "")
    n = len(col)
    off = np.frombuffer(col.buffers()[1], dtype=np.int64, count=n + 1 + col.offset)[col.offset:]
    buf = col.buffers()[2]
    data = np.frombuffer(buf, dtype=np.uint8)[off[0]:off[-1]] if buf is not None else np.zeros(0, np.uint8)
    off = off - off[0]
    if not len(data):
        z = np.zeros(0, dtype=np.int64)
        return Words(z, z, z, z.astype(np.uint64), np.zeros(n + 1, dtype=np.int64), data)
    inside = is_word[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    rows = np.flatnonzero(np.diff(off) > 0)
    first[off[rows]] = inside[off[rows]]
    last[off[rows + 1] - 1] = inside[off[rows + 1] - 1]
    start = np.flatnonzero(first)
    end = np.flatnonzero(last) + 1
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(value[data] * up[:-1], out=total[1:])
    h = mix((total[end] - total[start]) * down[start])
    ptr = np.searchsorted(start, off)
    row = np.repeat(np.arange(n), np.diff(ptr))
    return Words(row, start, end, h, ptr, data)


def fold(parts, length: int) -> np.ndarray:
    """Hash of word sequences given as equally long hash arrays."""
    acc = np.full(len(parts[0]), (length * 0xA0761D6478BD642F) % (1 << 64), dtype=np.uint64)
    for p in parts:
        acc = mix(acc * np.uint64(0x2545F4914F6CDD1D) + p)
    return acc


def shingles(w: Words, k: int, short: bool):
    """(position of the first word, hash) of every ``k`` consecutive words of
    one row; with ``short``, a row of fewer words, but not none, gives one."""
    n = len(w.hash)
    at = np.zeros(0, dtype=np.int64)
    h = np.zeros(0, dtype=np.uint64)
    if n >= k:
        at = np.flatnonzero(w.row[k - 1:] == w.row[:n - k + 1])
        if len(at) > (n - k + 1) // 2:
            h = fold([w.hash[j:n - k + 1 + j] for j in range(k)], k)[at]
        else:
            h = fold([w.hash[at + j] for j in range(k)], k)
    if short:
        c = w.counts
        for m in range(1, k):
            rows = np.flatnonzero(c == m)
            if len(rows):
                p = w.ptr[rows]
                at = np.concatenate([at, p])
                h = np.concatenate([h, fold([w.hash[p + j] for j in range(m)], m)])
    return at, h


def sorted_sets(row: np.ndarray, h: np.ndarray, rows: int):
    """Distinct hashes of each row, sorted: (hashes, first index per row)."""
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    if len(h):
        new = np.ones(len(h), dtype=bool)
        new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
        row, h = row[new], h[new]
    return h, np.searchsorted(row, np.arange(rows + 1)), row


def blocks(batches, column: str, limit: int = BLOCK_BYTES):
    """Cut Arrow batches into runs of rows of at most ``limit`` text bytes."""
    for b in batches:
        if not b.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(b.column(b.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
        total = np.cumsum(size.astype(np.int64))
        lo = 0
        while lo < b.num_rows:
            before = total[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(total, before + limit, side="right")))
            yield b.slice(lo, hi - lo)
            lo = hi


def lists(values: np.ndarray, ptr: np.ndarray, kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ptr.astype(np.int32)), pa.array(values, type=kind))


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
