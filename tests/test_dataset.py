"""Ordering, slicing and the split: invariants independent of partitioning."""

from pyspark.sql import functions as F

from drover.operators import curate as C
from drover.operators import dataset as DS


def test_global_index_independent_of_partitions(spark):
    # input order varies between executions (a random repartition), values do not
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 5000).alias("k"), F.lit("x").alias("pad")) \
        .repartition(13, F.rand())
    expect = list(range(1, 5001))
    for parts in (1, 3, 8, 17):
        rows = DS.global_index(df, ["k"], "idx", num_partitions=parts).orderBy("k").collect()
        assert [r.idx for r in rows] == expect
        assert [r.k for r in rows] == list(range(5000))


def test_batches_and_slice(spark):
    df = spark.range(0, 250).withColumnRenamed("id", "task_id")
    b = {r.task_id: r.batch for r in DS.assign_batches(df, 100).collect()}
    assert b[0] == 0 and b[99] == 0 and b[100] == 1 and b[249] == 2
    assert {r.task_id for r in DS.assign_batches(df, 0).collect()} == set(range(250))  # size >= 1
    s = sorted(r.task_id for r in DS.slice_tasks(df, 240, 50).collect())
    assert s == list(range(240, 250))


def test_split_disjoint_complete_and_deterministic(spark):
    tasks = spark.createDataFrame([(f"task_{i:06d}",) for i in range(300)], "task_id string")
    a = {r.task_id: r.split for r in DS.train_val_split(tasks, 40).collect()}
    b = {r.task_id: r.split for r in DS.train_val_split(tasks.repartition(7), 40).collect()}
    assert a == b and len(a) == 300
    assert sum(v == "validation" for v in a.values()) == 40
    every = {r.split for r in DS.train_val_split(tasks, 1000).collect()}
    assert every == {"validation"}


def test_failed_builds_removed_after_positions(spark):
    tasks = spark.createDataFrame([(f"t{i:03d}",) for i in range(50)], "task_id string")
    base = {r.task_id: r.split for r in DS.train_val_split(tasks, 10).collect()}
    val = [t for t, s in base.items() if s == "validation"]
    failed = spark.createDataFrame([(val[0],), (val[1],)], "task_id string")
    after = {r.task_id: r.split for r in DS.train_val_split(tasks, 10, failed=failed).collect()}
    assert sum(s == "validation" for s in after.values()) == 8  # not refilled


def test_seeded_shuffle_is_permutation(spark):
    tasks = spark.createDataFrame([(f"t{i}",) for i in range(100)], "task_id string")
    pos = [r.shuffle_position for r in DS.seeded_shuffle(tasks).collect()]
    assert sorted(pos) == list(range(1, 101))


def test_project_train_rows_nested(spark):
    df = spark.createDataFrame([("t1", "do x", "train")], "task_id string, description string, split string")
    r = DS.project_train_rows(df, "/root/tasks/", "sys", "600").collect()[0]
    assert r.prompt[0].role == "system" and r.prompt[1].content == "do x"
    assert r.reward_spec.ground_truth == "/root/tasks/t1" and r.extra_info.max_time == 600


def test_render_template(spark):
    import pytest
    df = spark.createDataFrame([("a{b}", "c")], "x string, y string")
    got = df.select(C.render_template("<{x}|{y}> {{lit}}", x="x", y="y")).collect()[0][0]
    assert got == "<a{b}|c> {lit}"  # values are never re-expanded
    with pytest.raises(KeyError):
        C.render_template("{missing}", x="x")


def test_stage_filters(spark):
    rows = [("a", " d ", " t ", "i", "f", "c"), ("b", None, "t", "i", "f", "c"), ("c", "d", "t", "", "f", "c"),
            ("d", "d", "t", "i", None, "c"), ("e", "d", "t", "i", "f", "")]
    df = spark.createDataFrame(rows, "task_id string, description string, truth string, initial_test string, "
                                     "final_test string, container_def string")
    rs = {r.task_id: r.reject_stage for r in C.filter_stage_survivors(df, keep_rejects=True).collect()}
    assert rs == {"a": None, "b": "template", "c": "initial_test", "d": "final_test", "e": "container_def"}
    y = {r.stage: r.n_rows for r in C.generation_yield(df).collect()}
    assert y == {"requested": 5, "template": 4, "initial_test": 3, "final_test": 2, "container_def": 1}
    s = C.generation_summary(C.filter_complete_bundles(df)).collect()[0]
    assert (s.requested, s.succeeded, s.success_rate) == (5, 1, 0.2)
    empty = C.generation_summary(C.filter_complete_bundles(df.limit(0))).collect()[0]
    assert empty.success_rate == 0.0


def test_sample_prompts_picks_by_hash(spark):
    from drover.operators.extract import sample_prompts
    reqs = spark.range(300).withColumnRenamed("id", "request_id")
    dims = {"category": (spark.createDataFrame([(f"c{i}",) for i in range(37)], "v string"), "v"),
            "complexity": (spark.createDataFrame([("lo",), ("hi",), ("lo",)], "v string"), "v"),
            "scenario": (spark.createDataFrame([(f"s{i}",) for i in range(5)], "v string"), "v")}
    a = sample_prompts(reqs, dims, 42).select("request_id", "category", "complexity", "scenario", "prompt")
    import hashlib
    values = {"category": sorted(f"c{i}" for i in range(37)), "complexity": ["hi", "lo"],
              "scenario": [f"s{i}" for i in range(5)]}
    for r in a.collect():
        for name, v in values.items():
            h = hashlib.md5(f"42:{r.request_id}:{name}".encode()).hexdigest()
            assert r[name] == v[int(h[:8], 16) % len(v)]
    assert a.select("complexity").distinct().count() == 2


def test_split_equals_a_sorted_list(spark):
    import hashlib
    names = [f"task_{i:05d}" for i in range(2000)]
    failed = spark.createDataFrame([("task_00007",), ("task_01234",)], "task_id string")
    got = {r.task_id: r.split for r in DS.train_val_split(
        spark.createDataFrame([(n,) for n in names], "task_id string"), 300, failed=failed).collect()}
    order = sorted(names, key=lambda n: (hashlib.md5(f"42:{n}".encode()).hexdigest(), n))
    want = {n: "validation" if i >= 1700 else "train" for i, n in enumerate(order)}
    assert got == {n: s for n, s in want.items() if n not in ("task_00007", "task_01234")}


def test_slices_are_sorted_and_exact(spark):
    df = spark.range(0, 3000).select((F.col("id") * 7 % 3000).alias("task_id"))
    assert [r.task_id for r in DS.slice_tasks(df, 250, 400).collect()] == list(range(250, 650))


def test_global_index_over_many_ranges_with_nulls(spark):
    df = spark.range(0, 3000).select(F.when(F.col("id") > 0, F.col("id")).alias("k"))
    rows = DS.global_index(df, ["k"], "idx", num_partitions=4096, total="n").collect()
    assert sorted((-1 if r.k is None else r.k, r.idx, r.n) for r in rows) == \
        [(-1, 1, 3000)] + [(i, i + 1, 3000) for i in range(1, 3000)]
    assert DS.global_index(df.limit(0), ["k"]).count() == 0


def test_prefix_sum_keeps_null_keys_and_spreads_a_hot_one(spark):
    df = spark.range(0, 4000).select(
        F.when(F.col("id") % 4 > 0, F.lit("hot")).when(F.col("id") % 8 == 0, F.lit("b")).alias("k"), F.col("id").alias("o"))
    got = DS.keyed_prefix_sum(df, "k", ["o"], F.lit(1), "s", inclusive=True, num_partitions=16).collect()
    seen: dict = {}
    for r in sorted(got, key=lambda r: r.o):
        seen[r.k] = seen.get(r.k, 0) + 1
        assert r.s == seen[r.k]
    assert len(got) == 4000 and seen == {"hot": 3000, "b": 500, None: 500}
