"""T1: incremental episode outcomes on a stream of steps, and session statistics.

Each run's steps are processed in turn order by a stateful function
(``applyInPandasWithState``).  Steps that arrive ahead of a missing turn wait in
the state until the gap fills, so arrival order does not change the result.  A run
has two deadlines in event time:

- *idle*: no step for ``idle_timeout`` of event time.  The run is emitted as still
  running (null end) but not forgotten: if it resumes, its turns and its clock go
  on, and its end is emitted later.
- *forget*: after ``retention``, long after the idle timeout, its state goes.

So a run has at most one ended row, and perhaps running rows before it;
``latest_outcomes`` keeps one row a run.  State per run is bounded by the turn
limit: turns beyond it can't matter and are not kept.

A call of the function and its conversions cost some milliseconds, far more than a
run's few steps, so runs are dealt by hash over a fixed number of groups that share
a call and a state (a list of runs); a group's timeout is the next deadline of its
runs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT_SCHEMA = ("run_id BIGINT, n_steps INT, end_turn INT, is_done_action BOOLEAN, at_max_turns BOOLEAN, "
                 "late BOOLEAN, timed_out BOOLEAN, verified BOOLEAN, goal_reached BOOLEAN, reward INT")
# times are kept as microseconds since the epoch (UTC); nothing that crosses into
# Python is null, as a null would turn whole columns of numbers into floats
STATE_SCHEMA = ("runs ARRAY<STRUCT<run: BIGINT, no_run: BOOLEAN, next_turn: INT, start_us: BIGINT, closed: BOOLEAN, "
                "idle: BOOLEAN, last_ms: BIGINT, waiting: ARRAY<STRUCT<turn: INT, us: BIGINT, done: BOOLEAN, passes: BOOLEAN>>>>")
EMITTED_SCHEMA = "run BIGINT, no_run BOOLEAN, n_steps INT, ended BOOLEAN, done BOOLEAN, late BOOLEAN, passes BOOLEAN"
_EMITTED = [c.split()[0] for c in EMITTED_SCHEMA.split(", ")]
#: What a step without a time counts as: before all others.
_NO_TIME_US = -(1 << 63) // 1000
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Run:
    """Outcome of one run at its first terminal step (same rule as the batch
    ``episode_outcome``)."""

    __slots__ = ("nxt", "start", "closed", "idle", "last", "waiting")

    def __init__(self, nxt: int = 1, start: int = 0, closed: bool = False, idle: bool = False, last: int | None = None, waiting=()):
        self.nxt, self.start, self.closed, self.idle, self.last = nxt, start, closed, idle, last
        self.waiting = {w[0]: tuple(w) for w in waiting}

    def kept(self) -> tuple:
        return self.nxt, self.start, self.closed, self.idle, self.last, [self.waiting[t] for t in sorted(self.waiting)]

    def add(self, turn: int, us: int, done: bool, passes: bool, max_turns: int) -> None:
        self.idle = False  # both deadlines count from the last step
        self.last = us // 1000 if self.last is None else max(self.last, us // 1000)
        if not self.closed and self.nxt <= turn <= max_turns:
            self.waiting[turn] = (turn, us, done, passes)

    def advance(self, max_turns: int, limit_us: int) -> tuple | None:
        """Goes on to the first missing turn; what to emit if the run ends."""
        while not self.closed and self.nxt in self.waiting:
            turn, us, done, passes = self.waiting.pop(self.nxt)
            self.start = us if turn == 1 else self.start
            late = us - self.start > limit_us
            self.closed, self.nxt = done or turn >= max_turns or late, turn + 1
            if self.closed:
                self.waiting = {}
                return turn, True, done, late, passes
        return None


def _group_step(max_turns: int, max_time: float, idle_ms: int, retention_ms: int) -> Callable:
    """The function of the new steps of a group's runs, or of its timeout."""
    limit_us, retention_ms = int(max_time * 1_000_000), max(retention_ms, idle_ms + 1)

    def step(key, steps: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        runs = {(r[0], r[1]): _Run(*r[2:]) for r in state.get[0]} if state.exists else {}
        out, touched = [], {}
        if not state.hasTimedOut:
            for pdf in steps:
                for run, no_run, *one in zip(*(pdf[c].tolist() for c in ("run", "no_run", "turn", "us", "done", "passes"))):
                    if (run, no_run) not in runs:
                        runs[run, no_run] = _Run()
                    touched[run, no_run] = runs[run, no_run]
                    runs[run, no_run].add(*one, max_turns)
        for k, r in touched.items():
            if end := r.advance(max_turns, limit_us):
                out.append((*k, *end))
        now, deadlines = state.getCurrentWatermarkMs(), []
        for k, r in list(runs.items()):
            if not (r.closed or r.idle) and r.last + idle_ms < now:
                out.append((*k, r.nxt - 1 + len(r.waiting), False, False, False, False))
                r.idle = True
            if r.last + retention_ms < now:
                del runs[k]
            else:
                deadlines.append(r.last + (retention_ms if r.closed or r.idle else idle_ms))
        if runs:
            state.update(([(*k, *r.kept()) for k, r in runs.items()],))
            state.setTimeoutTimestamp(max(1, min(deadlines)))
        else:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=_EMITTED)

    return step


def _outcomes(emitted: DataFrame, max_turns: int) -> DataFrame:
    """Emitted rows with the columns of ``OUTPUT_SCHEMA``; those of a run that
    has not ended are null."""
    at_max = F.col("n_steps") >= max_turns
    timed_out = F.col("late") & ~at_max
    goal = ~timed_out & F.col("passes")
    ends = {"end_turn": F.col("n_steps"), "is_done_action": F.col("done"), "at_max_turns": at_max, "late": F.col("late"),
            "timed_out": timed_out, "verified": ~timed_out, "goal_reached": goal, "reward": goal.cast("int")}
    return emitted.select(F.when(~F.col("no_run"), F.col("run")).alias("run_id"), "n_steps",
                          *[F.when(F.col("ended"), c).alias(name) for name, c in ends.items()])


def _ms(interval: str) -> int:
    return int(pd.Timedelta(interval).total_seconds() * 1000)


def use_rocksdb(spark: SparkSession) -> None:
    """Keep the states of many runs in the RocksDB store, off the heap (read when a
    streaming query starts)."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)


def stream_episodes(steps: DataFrame, max_turns: int = 16, max_time: float = 600, watermark: str = "1 hour",
                    idle_timeout: str = "2 hours", retention: str = "30 days", groups: int = 1024) -> DataFrame:
    """Streaming episode outcomes from ``(run_id, turn, ts, action_type,
    verifier_passes)`` rows; output mode ``append``.  Steps later than the
    watermark are dropped by the engine.

    ``groups`` should grow with the number of runs kept at a time (some hundred
    runs a group) and stay the same over the life of a checkpoint."""
    use_rocksdb(steps.sparkSession)
    run = F.col("run_id").cast("bigint")
    s = steps.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark).select(
        F.pmod(F.xxhash64(run), F.lit(groups)).alias("part"), F.coalesce(run, F.lit(0)).alias("run"), run.isNull().alias("no_run"), "ts",
        F.coalesce(F.unix_micros("ts"), F.lit(_NO_TIME_US)).alias("us"), F.coalesce(F.col("turn"), F.lit(0)).cast("int").alias("turn"),
        F.coalesce(F.col("action_type") == "done", F.lit(False)).alias("done"),
        F.coalesce("verifier_passes", F.lit(False)).alias("passes"))
    emitted = s.groupBy("part").applyInPandasWithState(
        _group_step(max_turns, max_time, _ms(idle_timeout), _ms(retention)), EMITTED_SCHEMA, STATE_SCHEMA, "append",
        GroupStateTimeout.EventTimeTimeout)
    return _outcomes(emitted, max_turns)


def latest_outcomes(rows: DataFrame, run: str = "run_id") -> DataFrame:
    """One row a run of the rows that ``stream_episodes`` has emitted so far: its
    end if it has ended, else the running row with the most steps."""
    rest = [c for c in rows.columns if c != run]
    best = F.max_by(F.struct(*rest), F.struct(F.col("end_turn").isNotNull(), F.col("n_steps")))
    return rows.groupBy(run).agg(best.alias("r")).select(run, "r.*")


# statistics variant ---------------------------------------------------------------
def _session_stats(steps: DataFrame, gap: str, run: str, ts: str, action: str) -> DataFrame:
    w = F.session_window(F.col(ts), gap).alias("w")
    return steps.groupBy(run, w).agg(F.count(F.lit(1)).alias("n_steps"),
                                     F.count_if(F.col(action) == "command").alias("n_command"),
                                     F.count_if(F.col(action) == "done").alias("n_done"),
                                     F.count_if(F.col(action) == "invalid").alias("n_invalid")) \
        .select(run, F.col("w.start").alias("started"), F.col("w.end").alias("closes"),
                "n_steps", "n_command", "n_done", "n_invalid")


def step_sessions(steps: DataFrame, gap: str = "30 minutes", run: str = "run_id", ts: str = "ts",
                  action: str = "action_type") -> DataFrame:
    """Activity sessions of each run: steps less than ``gap`` apart, with the
    session's first step, the time at which it closes (its last step plus the
    gap) and counts by action."""
    return _session_stats(steps, gap, run, ts, action)


def stream_step_sessions(steps: DataFrame, gap: str = "30 minutes", watermark: str = "1 hour", run: str = "run_id",
                         ts: str = "ts", action: str = "action_type") -> DataFrame:
    """``step_sessions`` on a stream (output mode ``append``): a session is
    emitted once the watermark has passed its close; steps that arrive later than
    the watermark are dropped by the engine."""
    return _session_stats(steps.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark), gap, run, ts, action)
