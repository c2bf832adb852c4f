"""Deadlines, resumed runs, session statistics, the results log and the framer,
each against a plain computation."""

import datetime as dt
import os
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from drover.functions import text as T
from drover.operators import framing as FR
from drover.streaming import episodes as EP
from drover.streaming import progress as PR
from drover.streaming.framing import Framer, parse_exit_code
from drover.streaming.replay import replay_as_stream, run_to_parquet

T0 = dt.datetime(2024, 1, 1)
MARKER = re.compile(T.MARKER_RE)


@pytest.fixture(autouse=True)
def few_partitions(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", old)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


# T3 -----------------------------------------------------------------------------
def plain_timeouts(rows, limit, until):
    """Characters with their arrival times, record by record."""
    out = set()
    for session in {r[0] for r in rows}:
        chunks = sorted(r[1:] for r in rows if r[0] == session)
        chars = [(c, ts) for _, ts, text in chunks for c in text or ""]
        start, last = min(ts for _, ts, _ in chunks), max(ts for _, ts, _ in chunks)
        held, line, n = [], [], 0

        def partial(deadline):
            text = "".join(c for c, ts in held + line if ts <= deadline)
            return re.sub("(?s)" + T.MARKER_RE + ".*$", "", text)[:500]

        for c, ts in chars:
            line.append((c, ts))
            if c != "\n":
                continue
            text = "".join(x for x, _ in line[:-1])
            if MARKER.search(text):
                deadline = start + dt.timedelta(seconds=limit)
                if ts > deadline:
                    out.add((session, n, partial(deadline), None, True))
                else:
                    body = "".join(x for x, _ in held) + text[:MARKER.search(text).start()]
                    out.add((session, n, body, parse_exit_code(text), False))
                start, held, line, n = ts, [], [], n + 1
            else:
                held, line = held + line, []
        deadline = start + dt.timedelta(seconds=limit)
        if (held or line) and "".join(x for x, _ in held + line).replace("\n", "") and (until or last) > deadline:
            out.add((session, n, partial(deadline), None, True))
    return out


def some_chunks(seed):
    r = random.Random(seed)
    rows = []
    for session in range(12):
        now = 0
        for seq in range(r.randint(1, 25)):
            now += r.choice([0, 1, 3, 8, 20])
            text = "".join(r.choice(["a", "bb ", "\n", "x" * 300, "\n__CMD_DONE__ab1__:0\n", "__CMD_DONE__ab1__:", "7\n", "z\n__CMD_DONE__0f__:1\n"])
                           for _ in range(r.randint(0, 4)))
            rows.append((session, seq, at(now), text if r.random() < 0.95 else None))
    return rows


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("skew_safe", [False, True])
def test_deadlines_equal_a_plain_walk(spark, seed, skew_safe):
    rows = some_chunks(seed)
    df = spark.createDataFrame(rows, "session_id long, seq long, ts timestamp, chunk string")
    for until in (None, at(150)):
        got = {tuple(r) for r in FR.command_timeouts(df, 10, until=until, skew_safe=skew_safe).collect()}
        want = plain_timeouts(rows, 10, until)
        assert got == want and any(r[4] for r in want) and not all(r[4] for r in want)


def test_a_command_that_never_returns(spark):
    rows = [(1, 0, at(0), "start\n"), (1, 1, at(9), "in time "), (1, 2, at(11), "too late"),  # past its deadline
            (2, 0, at(0), "quiet"),                                                     # past it only by ``until``
            (3, 0, at(0), "done\n__CMD_DONE__ab__:0\n"), (3, 1, at(60), ""),             # nothing pending
            (4, 0, at(0), "x" * 900), (4, 1, at(20), "y"), (5, 0, at(0), "a\n__CMD_DONE__ab__:"), (5, 1, at(30), "0\n")]
    df = spark.createDataFrame(rows, "session_id long, seq long, ts timestamp, chunk string")
    got = {(r.session_id, r.record_no): (r.output, r.exit_code, r.timed_out) for r in FR.command_timeouts(df, 10).collect()}
    assert got == {(1, 0): ("start\nin time ", None, True), (3, 0): ("done\n", 0, False), (4, 0): ("x" * 500, None, True),
                   (5, 0): ("a\n", None, True)}
    late = {r.session_id: r.output for r in FR.command_timeouts(df, 10, until=F.lit(at(100))).filter("timed_out").collect()}
    assert late == {1: "start\nin time ", 2: "quiet", 4: "x" * 500, 5: "a\n"}
    assert FR.command_timeouts(df.limit(0), 10).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "b\n", "\n", "__CMD_", "DONE__ab__:", "__CMD_DONE__ab__:1\n", "x\n__CMD_DONE__0__:2", "\n\n"]), max_size=12),
       st.integers(1, 5))
def test_framer_equals_lines_of_the_whole(parts, width):
    text = "".join(parts)
    framer, got = Framer(), []
    for i in range(0, len(text), width):
        got += framer.feed(text[i: i + width])
    want, body = [], []
    *lines, rest = text.split("\n")
    for line in lines:
        m = MARKER.search(line)
        if m:
            want.append(("\n".join([*body, line[:m.start()]]), parse_exit_code(line)))
            body = []
        else:
            body.append(line)
    assert got == want and framer.text() == "".join(x + "\n" for x in body) + rest
    assert Framer(framer.text()).text() == framer.text()


# T1 -----------------------------------------------------------------------------
STEPS = "run_id long, turn int, ts timestamp, action_type string, verifier_passes boolean, slice int"
H = 3600


def emitted(spark, rows, **options):
    spark.conf.set("spark.sql.shuffle.partitions", "1")  # one file a slice, so that each slice is a trigger
    df = spark.createDataFrame(rows, STEPS)
    stream = EP.stream_episodes(replay_as_stream(df, "slice", slices=1 + max(r[5] for r in rows)), max_turns=5, max_time=100 * H,
                                watermark="1 hour", **options)
    return run_to_parquet(stream, "episodes-test")


def test_a_resumed_run_goes_on(spark):
    rows = [(1, 1, at(0), "command", True, 0), (1, 2, at(H), "command", True, 0),
            (2, 1, at(0), "command", False, 0), (3, 1, at(0), "done", True, 0),
            (9, 1, at(10 * H), "command", True, 1),                  # moves the watermark for the next slice,
            (8, 1, at(11 * H), "command", True, 2),                  # in which 1 and 2 have been idle too long
            (1, 3, at(20 * H), "done", True, 3), (3, 2, at(20 * H), "done", True, 3),
            (9, 2, at(40 * H), "command", True, 4)]
    out = emitted(spark, rows, idle_timeout="2 hours")
    mine = [(r.n_steps, r.end_turn, r.goal_reached) for r in out.collect() if r.run_id == 1]
    assert sorted(mine, key=str) == [(2, None, None), (3, 3, True)]  # still running, then ended at its third turn
    assert [(r.end_turn, r.reward) for r in out.collect() if r.run_id == 3] == [(1, 1)]  # once
    last = {r.run_id: (r.n_steps, r.end_turn) for r in EP.latest_outcomes(out).collect()}
    assert last == {1: (3, 3), 2: (1, None), 3: (1, 1), 8: (1, None)}  # the stream ends before 9 is idle


def test_a_run_is_forgotten_after_its_retention(spark):
    rows = [(1, 1, at(0), "done", True, 0), (9, 1, at(100 * H), "command", True, 1), (9, 2, at(101 * H), "command", True, 2),
            (1, 1, at(102 * H), "done", False, 3), (9, 3, at(110 * H), "command", True, 4)]
    kept = emitted(spark, rows, idle_timeout="2 hours", retention="1000 hours").filter("run_id = 1 AND end_turn IS NOT NULL")
    gone = emitted(spark, rows, idle_timeout="2 hours", retention="50 hours").filter("run_id = 1 AND end_turn IS NOT NULL")
    assert kept.count() == 1 and gone.count() == 2


def test_steps_ahead_of_a_gap_wait(spark):
    rows = [(1, 2, at(H), "command", True, 0), (1, 4, at(3 * H), "done", True, 0), (2, 2, at(H), "command", True, 0),
            (1, 1, at(0.5 * H), "command", True, 1), (1, 3, at(2 * H), "command", True, 1), (9, 1, at(90 * H), "done", True, 2)]
    out = emitted(spark, rows, idle_timeout="2 hours")
    assert {r.run_id: (r.n_steps, r.end_turn) for r in EP.latest_outcomes(out).collect()} == {1: (4, 4), 2: (1, None), 9: (1, 1)}


def test_runs_share_calls_and_states(spark):
    r = random.Random(5)
    rows = [(run, t, at(t * H), "done" if t == ends else "command", run is not None and run % 2 == 0, min(3, (t + r.choice([0, 1])) // 2))
            for run in [None, *range(300)] for ends in [r.randint(2, 9)] for t in range(1, 7)]
    rows += [(1000, 1, at(200 * H), "command", True, 4)]
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    df = spark.createDataFrame(rows, STEPS)
    stream = EP.stream_episodes(replay_as_stream(df, "slice", slices=5), max_turns=5, max_time=100 * H, watermark="12 hours",
                                idle_timeout="20 hours", groups=4)
    q = stream.writeStream.format("memory").queryName("shared_states").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress) <= 4
    assert all(p["stateOperators"][0]["numRowsDroppedByWatermark"] == 0 for p in q.recentProgress)
    got = {x.run_id: (x.n_steps, x.end_turn, x.is_done_action, x.reward) for x in EP.latest_outcomes(spark.table("shared_states")).collect()}
    done = {(x[0], x[1]) for x in rows if x[3] == "done"}
    want = {}
    for run in [None, *range(300)]:
        end = next((t for t in range(1, 5) if (run, t) in done), 5)
        want[run] = (end, end, (run, end) in done, int(run is not None and run % 2 == 0))
    assert got == want


def test_stream_sessions_equal_batch_sessions(spark):
    r = random.Random(4)
    rows = [(run, 0, at(t), r.choice(["command", "done", "invalid"]), True, int((t + r.choice([0, 1800])) // (6 * H)))
            for run in range(20) for t in (r.uniform(0, 48 * H) for _ in range(30))]
    df = spark.createDataFrame(rows, STEPS)
    stream = EP.stream_step_sessions(replay_as_stream(df, "slice", slices=9), "1 hour", "2 hours")
    got = {tuple(x) for x in run_to_parquet(stream, "sessions-test").collect()}
    batch = {tuple(x) for x in EP.step_sessions(df, "1 hour").collect()}
    seen = max(x[2] for x in rows) - dt.timedelta(hours=2)
    assert got == {x for x in batch if x[2] <= seen} and 0 < len(got) < len(batch)
    late = df.filter("slice = 0").withColumn("slice", F.lit(9)).unionByName(df)  # the first slice again, far too late
    again = EP.stream_step_sessions(replay_as_stream(late, "slice", slices=10), "1 hour", "2 hours")
    assert {tuple(x) for x in run_to_parquet(again, "sessions-late").collect()} == got


# T5 -----------------------------------------------------------------------------
RESULTS = "task_name string, reward double, errors int, exit_code int, ts timestamp, slice int"


def deliver(spark, rows, root, checkpoint="ckpt"):
    df = spark.createDataFrame(rows, RESULTS)
    PR.stream_results_sink(replay_as_stream(df, "slice", slices=4), f"{root}/out", f"{root}/{checkpoint}") \
        .trigger(availableNow=True).start().awaitTermination()


def current(spark, root):
    return {r.task_name: (r.reward, r.exit_code) for r in PR.results_table(spark, f"{root}/out").collect()}


def test_one_row_a_task_however_late(spark, tmpdir_path):
    rows = [("a", 0.5, 0, 0, at(0), 0), ("b", None, None, 1, at(0), 0), ("a", 0.9, 0, 0, at(30 * H), 1),
            ("a", 0.1, 0, 3, at(H), 2), ("c", 1.0, 0, 0, at(2 * H), 2), ("c", 1.0, 0, 0, at(2 * H), 2), ("b", None, None, 1, at(500 * H), 3)]
    deliver(spark, rows, tmpdir_path)
    want = {"a": (0.9, 0), "b": (None, 1), "c": (1.0, 0)}
    assert current(spark, tmpdir_path) == want
    assert PR.results_table(spark, f"{tmpdir_path}/out").count() == 3
    last = PR.compact_results(spark, f"{tmpdir_path}/out")
    assert last == 3 and current(spark, tmpdir_path) == want and PR.compact_results(spark, f"{tmpdir_path}/out") == last
    # an epoch that runs again replaces its folder
    log = f"{tmpdir_path}/out/{PR.RESULT_LOG}"
    spark.createDataFrame([("d", 0.2, 0, 0, at(0))], RESULTS.rsplit(",", 1)[0]).write.mode("overwrite").parquet(f"{log}/epoch=4")
    spark.createDataFrame([("d", 0.3, 0, 0, at(0))], RESULTS.rsplit(",", 1)[0]).write.mode("overwrite").parquet(f"{log}/epoch=4")
    assert current(spark, tmpdir_path) == want | {"d": (0.3, 0)}


def test_unfinished_folders_are_not_read(spark, tmpdir_path):
    with pytest.raises(FileNotFoundError):
        PR.results_table(spark, f"{tmpdir_path}/out")
    deliver(spark, [("a", 0.5, 0, 0, at(0), 0)], tmpdir_path)
    os.makedirs(f"{tmpdir_path}/out/{PR.RESULT_BASE}/upto=9")  # a compaction that has not ended
    assert current(spark, tmpdir_path) == {"a": (0.5, 0)}
