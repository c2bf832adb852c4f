"""Exact top-k and approximate nearest neighbours against brute force."""

import math

import numpy as np

from llm_fixtures import SF_SMALL
from drover.llm import ann, topk

SCHEMA = "vec_id bigint, embedding array<float>, rank string, score string"


def brute(rows, every, k, score):
    ok = [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = {}
    for q, a in ok:
        if q % every == 0 and q not in out:
            got = [(-score(a, b), i) for i, b in ok if i != q and len(a) == len(b)]
            out[q] = [(i, -s) for s, i in sorted(got)[:k]]
    return out


def ints(a, b):
    return sum(math.floor(64 * float(x)) * math.floor(64 * float(y)) for x, y in zip(a, b))


def collected(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


def test_top_products_equal_brute_force(spark):
    df = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    want = brute([(r["vec_id"], r["embedding"]) for r in df.collect()], 20, 20, ints)
    assert collected(topk.top_products(df, shard_rows=64, block_rows=8, fan_in=2)) == want
    assert collected(topk.top_products(df)) == want


def odd_rows():
    g = np.random.default_rng(1)
    rows = [(i, [float(np.float32(x)) for x in g.standard_normal(6)]) for i in range(1, 40)]
    rows += [(i, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]) for i in range(100, 160)]  # a third of the rows are one vector
    rows += [(40, None), (60, []), (80, [None] * 6), (None, [1.0] * 6), (20, [float("nan")] * 6),
             (161, [float("inf")] + [0.0] * 5), (162, [1.0, 2.0]), (180, [3.0, 4.0]), (200, [0.0] * 6)]
    return rows


def test_odd_vectors(spark):
    rows = [r for r in odd_rows()]
    df = spark.createDataFrame([(i, v, "r", "s") for i, v in rows], SCHEMA)
    assert collected(topk.top_products(df, k=7, shard_rows=16)) == brute(rows, 20, 7, ints)
    empty = spark.createDataFrame([], SCHEMA)
    assert topk.top_products(empty).count() == 0 and ann.nearest(empty).count() == 0


def cosine(a, b):
    return round(sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b)), 12)


def test_nearest_on_odd_vectors_takes_ties_by_id(spark):
    rows = [r for r in odd_rows() if r[0] != 200]
    df = spark.createDataFrame([(i, v, "r", "s") for i, v in odd_rows()], SCHEMA)
    got = collected(ann.nearest(df, every=20, k=5, shard_rows=16))
    want = brute(rows, 20, 5, cosine)
    assert got.keys() == want.keys()
    for q in (100, 120, 140):  # equal vectors: the smallest ids come first
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
    assert got[180] == [(162, got[180][0][1])]  # only one vector of that length


def test_large_and_small_components(spark):
    rows = [(50, [1e30, 0.0]), (1, [2e30, 1e20]), (2, [0.0, 1e-30]), (3, [-1e30, 0.0])]
    df = spark.createDataFrame([(i, v, "", "") for i, v in rows], SCHEMA)
    got = collected(ann.nearest(df))[50]
    assert [i for i, _ in got] == [1, 2, 3] and abs(got[0][1] - 1) < 1e-9 and abs(got[2][1] + 1) < 1e-9


def test_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r["vec_id"], np.array(r["embedding"], float)) for r in df.collect()]
    ids, m = np.array([i for i, _ in rows]), np.stack([v / np.linalg.norm(v) for _, v in rows])
    got, hit, n = collected(ann.nearest(df)), 0, 0
    for i, v in zip(ids, m):
        if i % 50 == 0:
            order = [x for x in ids[np.argsort(-(m @ v), kind="stable")] if x != i][:5]
            hit += len(set(order) & {x for x, _ in got[i]})
            n += 5
    assert hit / n >= 0.9
