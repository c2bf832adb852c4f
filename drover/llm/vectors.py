"""Vector tables in tiles of bounded size: (shard of vectors) x (block of queries)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def finite_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``id, vec`` of the rows that take part: id and vector not null, at least
    one component, none of them null or non-finite.  All other columns go."""
    v = F.col(vec_col)
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return df.filter(F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0)).filter(ok) \
        .select(F.col(id_col).cast("bigint").alias("id"), v.alias("vec"))


def query_rows(vectors: DataFrame, every: int) -> DataFrame:
    """The query rows: ids divisible by ``every``; a repeated id asks once, with
    its smallest vector."""
    return vectors.filter(F.col("id") % every == 0).groupBy("id").agg(F.min("vec").alias("vec"))


def by_dimension(column: pa.ChunkedArray, dtype) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) for each length of the list column."""
    arr = column.combine_chunks()
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.chunk(0) if arr.num_chunks else pa.array([], column.type)
    offsets = arr.offsets.to_numpy()
    flat = arr.values.to_numpy(zero_copy_only=False)
    lens = np.diff(offsets)
    for d in np.unique(lens):
        rows = np.flatnonzero(lens == d)
        yield rows, flat[offsets[rows][:, None] + np.arange(d)].astype(dtype)


def exact_scale(m: np.ndarray) -> np.ndarray:
    """Rows times a power of two that brings the largest component near 1: no
    rounding, and no overflow in the squares."""
    _, e = np.frexp(np.abs(m).max(axis=1))
    return np.ldexp(m, -e[:, None])


def search_tiles(vectors: DataFrame, queries: DataFrame, fn: Callable, schema: str,
                 shard_rows: int, block_rows: int) -> DataFrame:
    """Run ``fn(shard, ids, matrix, query_ids, query_matrix)`` on every tile.
    Vectors are dealt over shards of about ``shard_rows`` rows by a hash of id
    and row position (one id holding many rows is spread too), queries over
    blocks of about ``block_rows``; a task holds one shard and one block at a
    time, whatever the table's size."""
    shards = max(1, -(-vectors.count() // shard_rows))
    blocks = max(1, -(-queries.count() // block_rows))
    v = vectors.withColumn("s", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(shards)).cast("int")) \
        .withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    q = queries.select(F.col("id").alias("qid"), F.col("vec").alias("qvec")) \
        .withColumn("b", F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int")) \
        .withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def tile(key, left: pa.Table, right: pa.Table) -> pa.Table:
        parts, shard = [], key[0].as_py()
        if left.num_rows and right.num_rows:
            ids, qids = left.column("id").to_numpy(), right.column("qid").to_numpy()
            asked = {m.shape[1]: (rows, m) for rows, m in by_dimension(right.column("qvec"), fn.dtype)}
            for rows, m in by_dimension(left.column("vec"), fn.dtype):
                if m.shape[1] in asked:
                    qrows, qm = asked[m.shape[1]]
                    parts.append(fn(shard, ids[rows], m, qids[qrows], qm))
        return pa.concat_tables(parts) if parts else fn.empty()

    return v.groupBy("s", "b").cogroup(q.groupBy("s", "b")).applyInArrow(tile, schema)
