"""Returns to go, leaks, output paths, prompt space coverage, splits and slices
against plain computations, and the packed source."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from drover.operators import audit as A
from drover.operators import dataset as DS
from drover.operators import returns as RT
from drover.sources import files as S
from drover.sources import packed as P


# E6 -----------------------------------------------------------------------------
def plain_returns(rows, discount):
    by = defaultdict(list)
    for run, turn, r in rows:
        if run is not None and turn is not None:
            by[run].append((turn, r or 0.0))
    out = []
    for run, steps in by.items():
        g = 0.0
        for turn, r in sorted(steps, reverse=True):
            g = r + discount * g
            out.append((run, turn, r, g))
    mean = sum(x[3] for x in out) / len(out)
    dev = math.sqrt(sum((x[3] - mean) ** 2 for x in out) / len(out))
    return sorted((*x[:2], round(x[2], 6), round(x[3], 6), round((x[3] - mean) / dev if dev > 1e-12 else 0.0, 5)) for x in out)


@pytest.mark.parametrize("discount,width", [(1.0, 256), (0.9, 4), (0.5, 2), (0.0, 3), (1.0, 3)])
def test_returns_equal_a_plain_scan(spark, discount, width):
    r = random.Random(1)
    rows = [(run, t, r.choice([0.0, 1.0, -0.5, None])) for run in range(6) for t in range(1, r.randint(2, 12))]
    rows += [(7, t, float(t % 3)) for t in range(1000, 1150)] + [(8, t, 1.0) for t in (5, 9, 400)] + [(None, 1, 1.0), (9, None, 1.0), (7, 1149, 2.0)]
    df = spark.createDataFrame(rows, "run_id long, turn int, reward double")
    got = RT.returns_to_go(df, discount, width=width)
    assert got.columns == ["run_id", "turn", "reward", "return_to_go", "normalized"]
    assert sorted((x[0], x[1], round(x[2], 6), round(x[3], 6), round(x[4], 5) + 0.0) for x in got.collect()) == plain_returns(rows, discount)


def test_turns_of_long_runs_are_numbered_over_ranges(spark, tmpdir_path):
    from drover.plans import audit_queries as Q
    from drover.plans.fixtures import view
    r = random.Random(6)
    rows = [(r.choice([None, *range(40)]), r.choice([None, 1, 2]), r.randint(1, 3), 1, r.choice([None, 5.0]), None, r.choice(["R", "N", None]))
            for _ in range(3000)]
    spark.createDataFrame(rows + rows[:300], "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, "
                          "l_shipdate timestamp, l_returnflag string").write.parquet(f"{tmpdir_path}/lineitem.parquet")
    want, got = view(spark, tmpdir_path, "long_steps"), Q._long_steps(spark, tmpdir_path)
    key = lambda x: (str(x[0]), x[1], float(x[2]))
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))
    # no window over whole runs: each goes over a run's part of one range
    plan = got._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if " Window [" in line]
    assert windows and all("_pid#" in line for line in windows)


def test_returns_of_nothing_and_of_equal_steps(spark):
    empty = spark.createDataFrame([], "run_id long, turn int, reward double")
    assert RT.returns_to_go(empty).count() == 0
    same = spark.createDataFrame([(i, 1, 2.0) for i in range(5)], "run_id long, turn int, reward double")
    assert {(x.return_to_go, x.normalized) for x in RT.returns_to_go(same).collect()} == {(2.0, 0.0)}


# E1 -----------------------------------------------------------------------------
def plain_leak(truth, told, n):
    t, d = (truth or "").split(), (told or "").split()
    n = min(n, len(t))
    if not n:
        return 0, 0, None, 0
    grams = [" ".join(t[i: i + n]) for i in range(len(t) - n + 1)]
    public = {" ".join(d[i: i + n]) for i in range(len(d) - n + 1)}
    best = run = 0
    for g in grams:
        run = run + 1 if g in public else 0
        best = max(best, run)
    leaked = {g for g in grams if g in public}
    return len(set(grams)), len(leaked), len(leaked) / len(set(grams)), best + n - 1 if best else 0


def test_leaks_equal_brute_force(spark):
    r = random.Random(2)
    text = lambda k: " ".join(r.choice("ab c d e".split()) for _ in range(k))
    rows = [(f"t{i}", text(r.randint(0, 30)), text(r.randint(0, 60))) for i in range(60)]
    rows += [("same", "one two three four", "zero one two three four five"), ("short", "one two", "three one two"), ("null", None, "x"),
             ("null2", "a b c", None), ("blank", "  \n ", "x y")]
    df = spark.createDataFrame(rows, "task_id string, truth string, description string")
    got = {x.task_id: (x.n_grams, x.n_leaked, x.leak_ratio, x.longest_run) for x in A.detect_truth_leak(df, 3).collect()}
    assert got == {k: plain_leak(t, d, 3) for k, t, d in rows}
    assert got["same"] == (2, 2, 1.0, 4) and got["short"][3] == 2 and got["blank"] == (0, 0, None, 0)
    assert A.detect_truth_leak(df.limit(0)).count() == 0


def test_leaks_of_repeated_and_null_keys(spark):
    rows = [("a", "one two three four", "zero one two"), ("a", "one two three four", "one two three"), (None, "x y z", "x y z"),
            (None, "p q", "p q r"), (None, "p q r", "x y"), ("b", "u u u u u u", "u u u")]
    df = spark.createDataFrame(rows, "task_id string, truth string, description string")
    found = A.detect_truth_leak(df, 3)
    got = {x.task_id: (x.n_grams, x.n_leaked, x.longest_run) for x in found.collect()}
    assert got == {"a": (2, 1, 3), None: (3, 2, 3), "b": (1, 1, 6)}
    # the runs are made and moved once: no side of a join reads them again
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()


# E2 -----------------------------------------------------------------------------
def test_output_paths(spark):
    rows = [("a", "write /home/user/out/report.txt.", 'exists("/home/user/out")', "mkdir /srv/x"),
            ("b", "make /home/user/out and /srv/y", "stat /home/user/out/old.txt", "touch /srv/y /home/user"),
            ("c", "say /home/user/outer", "stat /home/user/out", None), ("d", None, "/etc/passwd", ""), (None, "/opt/z", "/opt/z", None),
            ("e", "/etc/app/conf", "/etc", "x/etc/app/conf ./etc/app")]
    df = spark.createDataFrame(rows, "task_id string, description string, initial_test string, container_def string")
    got = {tuple(x) for x in A.detect_output_paths(df).collect()}
    assert got == {("a", "/home/user/out/report.txt", "/home/user/out", "above", "initial_test"),
                   ("b", "/home/user/out", "/home/user/out/old.txt", "inside", "initial_test"), ("b", "/srv/y", "/srv/y", "same", "container_def"),
                   (None, "/opt/z", "/opt/z", "same", "initial_test"), ("e", "/etc/app/conf", "/etc", "above", "initial_test")}
    assert A.detect_output_paths(df.limit(0)).count() == 0


# E4 -----------------------------------------------------------------------------
@pytest.mark.parametrize("chunk", [1, 3, 1 << 16])
def test_gaps_are_the_empty_cells(spark, chunk):
    r = random.Random(3)
    dims = {"a": ["p", "q", "r"], "b": ["x", "y"], "c": ["k", "l", "m", "n"]}
    rows = [(r.choice(dims["a"]), r.choice(dims["b"]), r.choice(dims["c"])) for _ in range(9)] + [("p", "other", "k"), (None, "x", "k")]
    prompts = spark.createDataFrame(rows, "a string, b string, c string")
    tables = {d: spark.createDataFrame([(v,) for v in [*vs, vs[0], None]], f"{d} string") for d, vs in dims.items()}
    gaps = [tuple(x) for x in A.prompt_space_gaps(prompts, tables, chunk).collect()]
    cells = [(x, y, z) for x in dims["a"] for y in dims["b"] for z in dims["c"]]
    empty = [i for i, c in enumerate(cells) if c not in rows]
    assert sorted(i for lo, hi, n in gaps for i in range(lo, hi + 1)) == empty and all(hi - lo + 1 == n for lo, hi, n in gaps)
    assert all(hi + 1 not in empty and lo - 1 not in empty for lo, hi, _ in gaps)
    assert [tuple(x) for x in A.prompt_space_gaps(prompts.limit(0), tables, chunk).collect()] == [(0, 23, 24)]
    margins = {(x.a, x.b, x.c, x.margin): x.n for x in A.prompt_space_margins(prompts, ["a", "b", "c"]).collect()}
    assert margins[None, None, None, 7] == len(rows) and margins[None, "x", "k", 0] == 1
    assert margins["p", None, None, 3] == sum(x[0] == "p" for x in rows)


# W2 / W3 ------------------------------------------------------------------------
def test_deep_slices_equal_shallow_ones(spark, monkeypatch):
    keys = [None, None, "a", "b", "b", "b", "c", "d", "e", "e"]
    df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "task_id string, n int")
    ordered = sorted(keys, key=lambda k: (k is not None, k or ""))
    monkeypatch.setattr(DS, "DEEP_SLICE", -1)
    for start in range(12):
        for n in (1, 3, 20):
            assert [x.task_id for x in DS.slice_tasks(df, start, n).collect()] == ordered[start: start + n], (start, n)


@pytest.mark.parametrize("count", [0, 1, 7, 30, 100])
def test_split_sizes_and_order(spark, count):
    import hashlib
    ids = [f"t{i}" for i in range(30)]
    df = spark.createDataFrame([(k, "x") for k in ids], "task_id string, extra string")
    got = {x.task_id: x.split for x in DS.train_val_split(df, count).collect()}
    order = sorted(ids, key=lambda k: (hashlib.md5(f"42:{k}".encode()).hexdigest(), k))
    assert got == {k: "validation" if i >= len(ids) - count else "train" for i, k in enumerate(order)}
    assert DS.train_val_split(df.limit(0), count).count() == 0


# the packed source ----------------------------------------------------------------
def test_packs_follow_sizes():
    files = [(f"/r/t{i}/f", f"t{i}", "f", s) for i, s in enumerate([10] * 50 + [5000] + [10] * 50 + [400, 400, 400])]
    packs = P.packed(files, 1000, 5)
    assert [f for p in packs for f in p.files] == files
    assert all(sum(f[3] + 5 for f in p.files) <= 1000 or len(p.files) == 1 for p in packs) and len(packs) < 12


@pytest.fixture()
def tree(spark, tmpdir_path):
    names = ["task_1", "my-task-2", "Big_TASK_3", ".task_4", "__task_5", "other_6"]
    df = spark.createDataFrame([(n, f" about {n} ", "t", "test é", None, None) for n in names],
                               "task_id string, description string, truth string, initial_test string, final_test string, container_def string")
    S.export_task_directories(df, tmpdir_path)
    return tmpdir_path, names


@pytest.mark.parametrize("rule,count", [("prefix", 1), ("contains", 4), ("contains_ci", 5), ("not_hidden", 4)])
def test_name_rules_and_both_readers(spark, tree, rule, count):
    root, names = tree
    got = S.scan_task_bundles(spark, root, rule, packed=True)
    assert got.count() == count and {r.task_id for r in got.collect()} == {n for n in names if P.RULES[rule](n)}
    assert all(r.description == f"about {r.task_id}" and r.initial_test == "test é" and r.final_test is None for r in got.collect())
    if rule != "not_hidden":  # the text source never lists hidden folders
        plain = {r.task_id for r in S.scan_task_bundles(spark, root, rule).collect()}
        assert plain == {r.task_id for r in got.collect() if not r.task_id.startswith((".", "_"))}


def test_members_and_partitions(spark, tree):
    root, names = tree
    df = P.read_task_files(spark, root, "not_hidden", ["task.json", "solutions/*"], target_bytes=1)
    assert Counter(r.member for r in df.collect()) == {"task.json": 4, "solutions/summary.json": 4}
    assert df.rdd.getNumPartitions() == 8
    assert P.read_task_files(spark, root, "prefix", ["nothing"]).count() == 0
    with pytest.raises(Exception, match="unknown name rule"):
        P.read_task_files(spark, root, "no-such-rule").count()


def test_summaries_and_manifests_as_files(spark, tmpdir_path):
    s = spark.createDataFrame([("t1", "o3/x", 4, 1, {"4": 0.25}), ("t1", "m", 2, 0, {}), ("t2", "m", 1, 1, None)],
                              "task_id string, model string, num_runs int, num_success int, pass_at_k map<string,double>")
    S.write_solution_summaries(s, tmpdir_path)
    for packed in (True, False):
        got = {(r.task_id, r.model): (r.num_runs, r.num_success, r.pass_at_k) for r in S.scan_solution_summaries(spark, tmpdir_path, packed).collect()}
        assert got == {("t1", "o3_x"): (4, 1, {"4": 0.25}), ("t1", "m"): (2, 0, {}), ("t2", "m"): (1, 1, None)}
    rows = spark.range(2500).select(F.concat(F.lit("t"), "id").alias("task_id"), F.lit("do").alias("instruction"))
    S.write_task_manifest(rows, f"{tmpdir_path}/m", json_array=True)
    assert S.scan_task_manifest(spark, f"{tmpdir_path}/m/*.txt").select("task_id").distinct().count() == 2500
