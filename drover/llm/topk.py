"""Exact top-k search: tiled matrix products, a partial selection per tile and
a tree of merges of the per-query lists."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from drover.llm.vectors import finite_vectors, query_rows, search_tiles

TILE_SCHEMA = "query_id bigint, vec_id bigint, score bigint, part int"
_LOW = np.iinfo(np.int64).min
#: Products of one tile that are held at a time.
PRODUCTS = 1 << 21


def integer_products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Integer inner products, exact: double BLAS while every partial sum is
    below 2^53, 64-bit integers below 2^63, Python integers beyond (saturated
    to the range of a long)."""
    top = q.shape[1] * max(1, abs(int(q.max())), abs(int(q.min()))) * max(1, abs(int(v.max())), abs(int(v.min())))
    if top < 1 << 53:
        return (q.astype(np.float64) @ v.T.astype(np.float64)).astype(np.int64)
    if top < 1 << 63:
        return q @ v.T
    s = q.astype(object) @ v.T.astype(object)
    return np.clip(s, _LOW + 1, np.iinfo(np.int64).max).astype(np.int64)


class TileTopK:
    """One tile: products, then the k best of each query; ties at the k-th
    score are all looked at and go to the smaller id."""

    dtype = np.int64

    def __init__(self, k: int):
        self.k = k

    @staticmethod
    def empty() -> pa.Table:
        return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()),
                         "score": pa.array([], pa.int64()), "part": pa.array([], pa.int32())})

    def __call__(self, shard, ids, v, qids, q) -> pa.Table:
        step = max(1, PRODUCTS // len(ids))
        return pa.concat_tables([self._part(shard, ids, v, qids[i: i + step], q[i: i + step])
                                 for i in range(0, len(qids), step)])

    def _part(self, shard, ids, v, qids, q) -> pa.Table:
        s = integer_products(q, v)
        s[qids[:, None] == ids[None, :]] = _LOW  # the query's own row
        n, k = s.shape[1], self.k
        least = np.partition(s, n - k, axis=1)[:, n - k] if n > k else np.full(len(q), _LOW)
        r, c = np.nonzero((s >= least[:, None]) & (s > _LOW))
        score, vec = s[r, c], ids[c]
        order = np.lexsort((vec, -score, r))
        r, score, vec = r[order], score[order], vec[order]
        first = np.searchsorted(r, np.arange(len(q)))
        best = np.arange(len(r)) - first[r] < k
        return pa.table({"query_id": qids[r[best]], "vec_id": vec[best], "score": score[best],
                         "part": np.full(int(best.sum()), shard, np.int32)})


def merge_lists(lists: DataFrame, k: int, parts: int, fan_in: int) -> DataFrame:
    """Merge per-part top lists ``fan_in`` parts at a time until one list per
    query is left; returns query_id, rank, vec_id, score."""
    best = [F.col("score").desc(), F.col("vec_id")]
    while parts > 1:
        lists = lists.withColumn("part", F.floor(F.col("part") / fan_in).cast("int"))
        parts = -(-parts // fan_in)
        if parts > 1:
            w = Window.partitionBy("query_id", "part").orderBy(*best)
            lists = lists.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).drop("rank")
    w = Window.partitionBy("query_id").orderBy(*best)
    return lists.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k) \
        .select("query_id", "rank", "vec_id", "score")


def top_products(vectors: DataFrame, every: int = 20, k: int = 20, scale: float = 64.0, id_col: str = "vec_id",
                 vec_col: str = "embedding", shard_rows: int = 1 << 14, block_rows: int = 1 << 13,
                 fan_in: int = 8) -> DataFrame:
    """The ``k`` highest integer inner products of floor(scale * x) vectors for
    each query row (id divisible by ``every``) against every row but its own.

    Returns query_id, rank (from 1), vec_id, score; ties go to the smaller
    vec_id; fewer rows where there are fewer candidates.  Rows with a null id,
    a null vector, or null or non-finite components take no part.  A repeated
    id is asked once; all rows of that id count as the query's own; repeated
    rows of other ids are candidates each.  Vectors of different lengths are
    not compared; an empty table gives no rows; other columns are ignored."""
    rows = finite_vectors(vectors, id_col, vec_col) \
        .withColumn("vec", F.transform("vec", lambda x: F.floor(x.cast("double") * F.lit(scale))))
    parts = max(1, -(-rows.count() // shard_rows))
    lists = search_tiles(rows, query_rows(rows, every), TileTopK(k), TILE_SCHEMA, shard_rows, block_rows)
    return merge_lists(lists, k, parts, fan_in)
