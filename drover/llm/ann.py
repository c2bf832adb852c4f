"""Approximate nearest neighbours by collision counting: every shard keeps one
sorted array per random projection; windows centred on the query's projections
are widened by virtual rehashing; vectors that fall into enough windows are
verified on the original components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drover.llm.topk import merge_lists
from drover.llm.vectors import exact_scale, finite_vectors, query_rows, search_tiles

#: The smallest search radius: equal vectors lie within it whatever the rounding.
LEAST = 0.05
TILE_SCHEMA = "query_id bigint, vec_id bigint, score double, part int"


class CollisionCounting:
    """Search of one tile over ``projections`` sorted arrays.  At search radius R a
    window reaches ``width`` * R to either side of the query's projection, so a
    vector at distance R falls into it with the probability that a standard
    normal stays within ``width`` (0.85 for 1.45), whatever R is; vectors that
    fall into a share ``threshold`` of the windows are verified.  R grows by ``ratio``, but never beyond the k-th distance verified so far, and
    the search ends when ``k`` verified vectors lie within R (or all are
    verified).  It begins at a share ``begin`` of the k-th distance among
    ``probes`` rows of the shard, which are verified for each query."""

    dtype = np.float64

    def __init__(self, k: int, projections: int, width: float, threshold: float, probes: int, begin: float, ratio: float,
                 seed: int):
        self.k, self.m, self.seed, self.width = k, projections, seed, width
        self.need = max(1, int(np.ceil(threshold * projections)))
        self.probes, self.begin, self.ratio = probes, begin, ratio
        self.verified = self.rows = 0  # of all searches so far

    @staticmethod
    def empty() -> pa.Table:
        return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()),
                         "score": pa.array([], pa.float64()), "part": pa.array([], pa.int32())})

    def __call__(self, shard, ids, v, qids, q) -> pa.Table:
        v, q = exact_scale(v), exact_scale(q)
        nv, nq = np.sqrt((v * v).sum(axis=1)), np.sqrt((q * q).sum(axis=1))
        axes = np.random.default_rng([self.seed, v.shape[1]]).standard_normal((v.shape[1], self.m))
        proj = (v / nv[:, None]) @ axes
        centre = (q / nq[:, None]) @ axes
        order = np.ascontiguousarray(np.argsort(proj, axis=0, kind="stable").T)  # one sorted array per projection
        # the arrays one after another, so that one search finds all windows of a query
        far = 2 * (1 + np.abs(proj).max() + np.abs(centre).max())
        lines = (np.sort(proj, axis=0).T + far * np.arange(self.m)[:, None]).ravel()
        probes = np.linspace(0, len(ids) - 1, min(self.probes, len(ids))).astype(np.int64)
        out_q, out_v, out_s = [], [], []
        for i in range(len(q)):
            near, score = self._search(ids, v, nv, order, lines, far, probes, centre[i], qids[i], q[i], nq[i])
            out_q.append(np.full(len(near), qids[i]))
            out_v.append(ids[near])
            out_s.append(score)
        vec, score = np.concatenate(out_v), np.concatenate(out_s)
        return pa.table({"query_id": np.concatenate(out_q), "vec_id": vec, "score": score,
                         "part": np.full(len(vec), shard, np.int32)})

    def _windows(self, lines, far, centre, radius, n):
        """Bounds of the query-centred window in each sorted array."""
        base = np.arange(self.m)
        at = np.concatenate([np.maximum(centre - self.width * radius, -far / 2), np.minimum(centre + self.width * radius, far / 2)])
        place = np.searchsorted(lines, at + far * np.tile(base, 2)) - n * np.tile(base, 2)
        return place[: self.m], place[self.m:]

    def _kth(self, scores) -> float:
        """Distance of the k-th of the scores: cosine 1 - R^2/2 between unit vectors."""
        at = len(scores) - self.k
        return np.sqrt(max(0.0, 2 - 2 * np.partition(scores, at)[at])) if at >= 0 else np.inf

    def _search(self, ids, v, nv, order, lines, far, probes, centre, qid, q, nq):
        n, m, k = len(ids), self.m, self.k
        seen = ids == qid
        found = probes[~seen[probes]]
        seen[found] = True
        scores = (v[found] @ q) / (nv[found] * nq)
        counts, a, b = None, None, None  # collisions, and the windows counted so far
        kth = self._kth(scores)
        radius = max(LEAST, self.begin * min(kth, 2.0))
        while not seen.all():
            lo, hi = self._windows(lines, far, centre, radius, n)
            inside = int((hi - lo).sum())
            # virtual rehashing: only what the wider windows add is counted, or what
            # lies outside of them where that is less
            if n * m - inside < (inside if counts is None else inside - int((b - a).sum())):
                spans = [*((j, 0, x) for j, x in enumerate(lo)), *((j, x, n) for j, x in enumerate(hi))]
                counts = m - np.bincount(np.concatenate([order[j, x:y] for j, x, y in spans]), minlength=n)
            else:
                spans = zip(range(m), lo, hi) if counts is None else [*zip(range(m), lo, a), *zip(range(m), b, hi)]
                fresh = np.bincount(np.concatenate([order[j, x:y] for j, x, y in spans]), minlength=n)
                counts = fresh if counts is None else counts + fresh
            a, b = lo, hi
            new = np.flatnonzero((counts >= self.need) & ~seen)
            if len(new):
                seen[new] = True
                found = np.concatenate([found, new])
                scores = np.concatenate([scores, (v[new] @ q) / (nv[new] * nq)])
                kth = self._kth(scores)
            if kth <= radius:
                break
            radius = min(radius * self.ratio, kth)
        self.verified += len(found)
        self.rows += n
        best = np.lexsort((ids[found], -scores))[:k]
        return found[best], scores[best]


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding",
            projections: int = 80, width: float = 1.45, threshold: float = 0.8, probes: int = 128,
            begin: float = 0.8, ratio: float = 1.25, seed: int = 7, shard_rows: int = 1 << 14,
            block_rows: int = 1 << 12, fan_in: int = 8) -> DataFrame:
    """The ``k`` nearest vectors found by largest cosine (double precision) for
    each query row (id divisible by ``every``) among all rows but its own.

    Returns query_id, rank (from 1), vec_id, score; ties go to the smaller
    vec_id.  Every row is indexed.  Rows with a null id, and vectors that are
    null, zero or hold null or non-finite components take no part.  A repeated
    id is asked once, and all rows of that id count as the query's own;
    repeated rows of other ids are candidates each, found together (equal
    vectors fall into the same windows).  Vectors of different lengths are not
    compared; an empty table gives no rows; other columns are ignored."""
    rows = finite_vectors(vectors, id_col, vec_col).filter(F.exists("vec", lambda x: x != 0))
    parts = max(1, -(-rows.count() // shard_rows))
    fn = CollisionCounting(k, projections, width, threshold, probes, begin, ratio, seed)
    lists = search_tiles(rows, query_rows(rows, every), fn, TILE_SCHEMA, shard_rows, block_rows)
    return merge_lists(lists, k, parts, fan_in)
