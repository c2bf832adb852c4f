"""Trajectory operators: pass@k exactness, truncation, outcomes, pairing, tokens."""

from math import comb

from pyspark.sql import functions as F

from drover.operators import trajectory as TR


def test_pass_at_k_exact_and_monotone(spark):
    rows = [(f"t{n}_{c}", n, c) for n in (1, 2, 5, 16, 64, 128) for c in range(0, n + 1, max(1, n // 7))]
    df = spark.createDataFrame(rows, "task_id string, num_runs int, num_success int")
    got = TR.pass_at_k(df).collect()
    by_task = {}
    for r in got:
        n, c, k = r.num_runs, r.num_success, r.k
        exact = 0.0 if c == 0 else 1.0 - comb(n - c, k) / comb(n, k)
        assert abs(r.pass_at_k - exact) < 1e-12, (n, c, k)
        by_task.setdefault(r.task_id, []).append((k, r.pass_at_k))
    for vals in by_task.values():
        ps = [p for _, p in sorted(vals)]
        assert all(a <= b + 1e-15 for a, b in zip(ps, ps[1:]))
    assert len(got) == sum(n for _, n, _ in rows)


def test_pass_at_k_selected_keys(spark):
    df = spark.createDataFrame([("a", 3, 1), ("b", 8, 0)], "task_id string, num_runs int, num_success int")
    got = {(r.task_id, r.k): r.pass_at_k for r in TR.pass_at_k(df, ks=[4]).collect()}
    assert got == {("b", 4): 0.0}  # task a has no key 4 (lenient rule drops it)


def _turns(spark, rows):
    return spark.createDataFrame(rows, "run_id int, turn int, role string, content string")


def test_truncate_at_done_and_limit(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u"),
            (1, 2, "assistant", "<command>ls</command>"), (1, 3, "user", "out"),
            (1, 4, "assistant", "<action>done</action>"), (1, 5, "user", "ignored"),
            (1, 6, "assistant", "<command>late</command>"),
            (2, 0, "system", "s"), (2, 1, "user", "u")]
    rows += [(2, 2 + 2 * i, "assistant", f"<command>c{i}</command>") for i in range(4)]
    rows += [(2, 3 + 2 * i, "user", f"o{i}") for i in range(4)]
    kept = TR.truncate_at_done(_turns(spark, rows), max_actions=3)
    got = {(r.run_id, r.turn) for r in kept.collect()}
    assert got == {(1, 0), (1, 1), (1, 2), (1, 3), (1, 4),
                   (2, 0), (2, 1), (2, 2), (2, 3), (2, 4), (2, 5), (2, 6), (2, 7)}
    ended = {r.run_id: r.ended_by for r in kept.select("run_id", "ended_by").distinct().collect()}
    assert ended == {1: "done", 2: "max_actions"}


def test_pair_and_number_commands(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "<command>a</command>"),
            (1, 3, "user", "A"), (1, 4, "assistant", "nothing"), (1, 5, "user", "nudge"),
            (1, 6, "assistant", "<command></command>"), (1, 7, "assistant", "<command>b</command>")]
    pairs = {r.turn: r.observation for r in TR.pair_action_observation(_turns(spark, rows)).collect()}
    assert pairs == {2: "A", 4: "nudge", 6: None, 7: None}
    nums = {r.turn: r.command_no for r in TR.number_commands(TR.parse_actions(_turns(spark, rows))).collect()}
    assert nums == {2: 1, 4: None, 6: None, 7: 2}


def test_command_history_and_compaction(spark):
    long_out = "x" * 600
    rows = [(1, 0, "system", "s"), (1, 1, "user", "task"), (1, 2, "assistant", "<command>ls</command>"),
            (1, 3, "user", long_out), (1, 4, "assistant", "<command>pwd</command>"), (1, 5, "user", "/h"),
            (2, 0, "system", "s"), (2, 1, "user", "task2"), (2, 2, "assistant", "<action>done</action>")]
    hist = {r.run_id: r.history for r in TR.command_history(_turns(spark, rows)).collect()}
    assert set(hist) == {1}
    assert hist[1] == ("Here is a summary of commands and outputs from your previous attempts:\n\n"
                       "Command 1: ls\nOutput: " + "x" * 500 + "... [truncated]\n\n---\n\n"
                       "Command 2: pwd\nOutput: /h\n\nPlease continue from where you left off.")
    comp = {r.run_id: r.compacted_user for r in TR.compact_history(_turns(spark, rows), 0).collect()}
    assert comp[1] == "task\n\n" + hist[1] and comp[2] == "task2"


def test_token_totals(spark):
    rows = [(1, 0, "system", "a b"), (1, 1, "user", "c"), (1, 2, "assistant", "d e f"),
            (1, 3, "user", "g"), (1, 4, "assistant", "h")]
    r = TR.token_totals(_turns(spark, rows)).collect()[0]
    # input counted over the whole chat before each reply: (2+1) + (2+1+3+1)
    assert (r.n_input_tokens, r.n_output_tokens, r.n_episodes) == (10, 4, 2)


def test_episode_outcome_truth_table(spark):
    """All 7 terminal combinations of (done action, at max turns, late) plus a
    running episode; max_turns=2, max_time=100 s."""
    import datetime as dt
    t0 = dt.datetime(2024, 1, 1)
    s = lambda sec: t0 + dt.timedelta(seconds=sec)
    rows = [
        (1, 1, s(0), "done", True),                                       # done
        (2, 1, s(0), "command", True), (2, 2, s(10), "command", True),   # at max
        (3, 1, s(0), "command", True), (3, 2, s(200), "command", True),  # at max + late -> verified
        (4, 1, s(0), "command", True), (4, 2, s(200), "done", False),    # done + at max + late
        (5, 1, s(0), "command", True), (5, 2, s(5), "done", True),       # done + at max
        (6, 1, s(0), "command", True),                                    # running
    ]
    rows_late = [(7, 1, s(0), "invalid", True)]
    df = spark.createDataFrame(rows + rows_late, "run_id int, turn int, ts timestamp, action_type string, "
                                                 "verifier_passes boolean")
    got = {r.run_id: r for r in TR.episode_outcome(df, max_turns=2, max_time=100).collect()}
    assert got[1].end_turn == 1 and got[1].verified and got[1].reward == 1
    assert got[2].at_max_turns and got[2].verified and got[2].reward == 1
    assert got[3].at_max_turns and got[3].late and not got[3].timed_out and got[3].verified
    assert got[4].is_done_action and got[4].late and not got[4].timed_out and got[4].reward == 0
    assert got[5].is_done_action and got[5].at_max_turns and got[5].reward == 1
    assert got[6].end_turn is None and got[6].n_steps == 1

    # late done under the turn limit is not verified; late command also ends as timed out
    rows2 = [(8, 1, s(0), "command", True), (8, 2, s(500), "done", True),
             (9, 1, s(0), "command", True), (9, 2, s(500), "command", True), (9, 3, s(501), "done", True)]
    df2 = spark.createDataFrame(rows2, df.schema)
    got2 = {r.run_id: r for r in TR.episode_outcome(df2, max_turns=5, max_time=100).collect()}
    assert got2[8].timed_out and not got2[8].verified and got2[8].reward == 0
    assert got2[9].end_turn == 2 and got2[9].timed_out and got2[9].n_steps == 2


def test_wallclock_cutoff(spark):
    import datetime as dt
    t0 = dt.datetime(2024, 1, 1)
    rows = [(1, 1, t0, "command"), (1, 2, t0 + dt.timedelta(seconds=700), "command"),
            (1, 3, t0 + dt.timedelta(seconds=701), "done"),
            (2, 1, t0, "command"), (2, 2, t0, "done"), (3, 1, t0, "command")]
    df = spark.createDataFrame(rows, "run_id int, turn int, ts timestamp, action_type string")
    got = {r.run_id: (r.n_episodes, r.stop_reason) for r in TR.wallclock_cutoff(df, 64, 600).collect()}
    assert got == {1: (2, "time"), 2: (2, "done"), 3: (1, "running")}


def test_filter_solved_lenient_and_strict(spark):
    import pytest
    df = spark.createDataFrame([("a", 16, 2), ("b", 16, 0), ("c", 4, 4)], "task_id string, num_runs int, num_success int")
    assert sorted(r.task_id for r in TR.filter_solved_tasks(df, 16).collect()) == ["a"]
    with pytest.raises(Exception):
        TR.filter_solved_tasks(df, 16, strict=True).collect()
    assert sorted(r.task_id for r in TR.filter_solved_tasks(df.filter("task_id != 'c'"), 16, strict=True)
                  .collect()) == ["a"]


def test_skew_safe_running_counts_equal_plain(spark):
    from drover.plans.fixtures import view
    from conftest import SF_MID
    r = view(spark, SF_MID, "responses")
    # a hot run: one run replicated to hold most rows
    hot = r.filter("run_id = 3").withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(300)))) \
        .select(F.lit(-1).cast("bigint").alias("run_id"), (F.col("rep") * 100 + F.col("turn")).alias("turn"),
                "role", "content")
    data = r.unionByName(hot)
    for fn, cols in ((TR.number_turns, ["run_id", "turn", "turn_no"]),):
        a = sorted(tuple(x) for x in fn(data).select(cols).collect())
        b = sorted(tuple(x) for x in fn(data, skew_safe=True).select(cols).collect())
        assert a == b
    acts = TR.parse_actions(data)
    a = sorted(tuple(x) for x in TR.number_commands(acts).select("run_id", "turn", "command_no").collect())
    b = sorted(tuple(x) for x in TR.number_commands(acts, skew_safe=True).select("run_id", "turn", "command_no").collect())
    assert a == b
    a = sorted(tuple(x) for x in TR.token_totals(data).collect())
    b = sorted(tuple(x) for x in TR.token_totals(data, skew_safe=True).collect())
    assert a == b


def test_pass_at_k_skew_safe_equals_plain(spark):
    df = spark.createDataFrame([("hot", 5000, 37), ("a", 16, 3), ("b", 1, 0), ("c", 1030, 1030)],
                               "task_id string, num_runs int, num_success int")
    cols = ["task_id", "k", "pass_at_k"]
    a = sorted(tuple(r) for r in TR.pass_at_k(df).select(cols).collect())
    b = sorted(tuple(r) for r in TR.pass_at_k(df, skew_safe=True).select(cols).collect())
    assert a == b and len(a) == 5000 + 16 + 1 + 1030
