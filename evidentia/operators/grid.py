"""The k best corpus rows for each query of a block, kept while rows stream by
(used by the search, the inverted lists and the kept index).

Rows meet queries in cells of a bounded number of queries and rows, one matrix
product each. A query keeps its k best rows so far; the product is taken in
single precision and only rows that may enter by it, error bound included, are
compared exactly. So a task holds O(queries x k), whatever it reads.
"""

from __future__ import annotations

import numpy as np

MAX_MEMBERS = 20000
MAX_QUERIES = 2000
# Distances are compared at this many decimals so that exact copies of a
# vector tie (and fall back to the id order) whatever the BLAS kernel did.
RANK_DECIMALS = 9
CELL_ROWS, CELL_QUERIES = 2048, 1024       # rows and queries of one product
FIRST_ROWS = 256               # rows of the first products, while queries have no k rows yet
EXACT_PAIRS = 1 << 16          # pairs compared exactly at once


def usable(m: np.ndarray) -> np.ndarray:
    """Rows of a matrix that have a direction: finite and not zero."""
    with np.errstate(invalid="ignore", over="ignore"):
        n = np.linalg.norm(m, axis=1)
    return np.isfinite(n) & (n > 0)


def merge_topk(parts, k: int):
    """Fold candidate chunks into the exact k best per query under the
    global order (distance key, id). Ids are compared only where keys tie."""
    qi, pid, dist, key = (np.concatenate([p[i] for p in parts]) for i in range(4))
    order = np.lexsort((key, qi))
    tied = (qi[order][1:] == qi[order][:-1]) & (key[order][1:] == key[order][:-1])
    if tied.any():
        order = np.lexsort((pid.astype(str), key, qi))
    qi, pid, dist, key = qi[order], pid[order], dist[order], key[order]
    first = np.searchsorted(qi, qi, side="left")
    keep = (np.arange(len(qi)) - first) < k
    return qi[keep], pid[keep], dist[keep], key[keep]


class Nearest:
    """The k best of the rows added so far for each query: ``Q`` holds unit vectors."""

    def __init__(self, Q: np.ndarray, k: int, rows: int = CELL_ROWS, queries: int = CELL_QUERIES):
        self.Q, self.k, self.seen = Q, k, 0
        self.rows, self.queries = max(1, min(rows, CELL_ROWS)), max(1, min(queries, CELL_QUERIES))
        self.q32 = Q.astype(np.float32)
        self.slack = np.float32((Q.shape[1] + 8) * 2.0 ** -23 + 10.0 ** -RANK_DECIMALS)    # of a product in single precision
        self.key = np.full((len(Q), k), np.inf)
        self.dist = np.full((len(Q), k), np.inf)
        self.pid = np.empty((len(Q), k), dtype=object)

    def add(self, ids: np.ndarray, D: np.ndarray, among: np.ndarray | None = None) -> None:
        """Rows (unit vectors) with their ids, for all queries or those at the places ``among``."""
        places = np.arange(len(self.Q)) if among is None else among
        if not len(ids) or not len(places):
            return
        order = np.argsort(ids.astype(str), kind="stable")      # places in a cell tie as ids do
        ids, D = ids[order], D[order]
        d32 = D.astype(np.float32)
        lo = 0
        while lo < len(ids):
            hi = min(len(ids), lo + min(self.rows, max(FIRST_ROWS, self.seen)))
            for at in range(0, len(places), self.queries):
                self._cell(places[at:at + self.queries], ids[lo:hi], D[lo:hi], d32[lo:hi], among is None)
            self.seen += hi - lo
            lo = hi

    def _cell(self, q, ids, D, d32, in_row: bool) -> None:
        k, m = self.k, len(ids)
        bound = self.key[q, k - 1]
        sim = (self.q32[q[0]:q[-1] + 1] if in_row else self.q32[q]) @ d32.T
        floor = (1.0 - bound).astype(np.float32) - self.slack
        some = np.isinf(bound)
        if some.any() and m > k:
            floor[some] = np.partition(sim[some], m - k, axis=1)[:, m - k] - 2 * self.slack
        hit = np.flatnonzero((sim >= floor[:, None]).ravel())
        del sim
        if not len(hit):
            return
        qi, ci = np.divmod(hit, m)
        dist = np.empty(len(hit))
        for s in range(0, len(hit), EXACT_PAIRS):
            e = slice(s, s + EXACT_PAIRS)
            dist[e] = 1.0 - np.einsum("ij,ij->i", self.Q[q[qi[e]]], D[ci[e]])
        key = np.round(dist, RANK_DECIMALS)
        near = key <= bound[qi]
        qi, ci, dist, key = qi[near], ci[near], dist[near], key[near]
        order = np.lexsort((ci, key, qi))
        qi = qi[order]
        best = np.arange(len(qi)) - np.searchsorted(qi, qi, side="left") < k
        order, qi = order[best], q[qi[best]]
        mine = np.unique(qi)
        a, b = np.nonzero(np.isfinite(self.key[mine]))
        old = (mine[a], self.pid[mine[a], b], self.dist[mine[a], b], self.key[mine[a], b])
        qi, pid, dist, key = merge_topk([old, (qi, ids[ci[order]], dist[order], key[order])], k)
        place = np.arange(len(qi)) - np.searchsorted(qi, qi, side="left")
        self.pid[qi, place], self.dist[qi, place], self.key[qi, place] = pid, dist, key

    def best(self, step: int = 1 << 16):
        """(place of the query, id, distance, key) of all that is kept, in parts."""
        for s in range(0, len(self.Q), step):
            a, b = np.nonzero(np.isfinite(self.key[s:s + step]))
            if len(a):
                yield s + a, self.pid[s + a, b], self.dist[s + a, b], self.key[s + a, b]
