"""Batch forms of the streaming operators (the streaming jobs are tested to be
equal to these on the same rows)."""

from __future__ import annotations

from drover.functions import text as T
from drover.operators import framing as FR
from drover.plans import duck as D
from drover.plans.fixtures import view, with_views
from drover.plans.registry import QUERIES, register
from drover.session import shared_path

_FRAMED = f"""
, c AS (SELECT session_id, seq, string_split(coalesce(chunk, ''), chr(10)) AS pieces FROM chunks),
c2 AS (SELECT *, coalesce(sum(len(pieces) - 1) OVER (PARTITION BY session_id ORDER BY seq
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb FROM c),
p AS (SELECT session_id, seq, nb, len(pieces) AS np, generate_subscripts(pieces, 1) AS j1,
             unnest(pieces) AS piece FROM c2),
lines AS (SELECT session_id, CAST(nb + j1 - 1 AS BIGINT) AS line_no, string_agg(piece, '' ORDER BY seq) AS line,
                 bool_or(j1 < np) AS terminated
          FROM p GROUP BY session_id, nb + j1 - 1),
f1 AS (SELECT *, (regexp_matches(line, {D.rx(T.MARKER_RE)}) AND terminated) AS is_marker FROM lines),
framed AS (SELECT *, CAST(coalesce(count(*) FILTER (WHERE is_marker) OVER (PARTITION BY session_id ORDER BY line_no
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS record_no FROM f1)
"""

_CODE_RE = T.MARKER_RE + r"([^:]*)\z"
_EXIT = f"TRY_CAST({D.py_strip(D.regexp_extract('line', _CODE_RE))} AS INTEGER)"


@register("frame_commands", with_views(_FRAMED + f"""
SELECT session_id, record_no,
       string_agg(CASE WHEN is_marker THEN {D.regexp_extract('line', '(?s)^(.*?)' + T.MARKER_RE)} ELSE line END,
                  chr(10) ORDER BY line_no) AS output,
       max(CASE WHEN is_marker THEN {_EXIT} END) AS exit_code
FROM framed GROUP BY session_id, record_no HAVING bool_or(is_marker)
""", "chunks"), ("T2", "F20"))
def q_frame_commands(spark, sf):
    return FR.frame_commands(view(spark, sf, "chunks"))


@register("pending_commands", with_views(_FRAMED + """
, last AS (SELECT session_id, count(*) FILTER (WHERE is_marker) AS n_finished, max(record_no) AS last_rec
          FROM framed GROUP BY session_id),
tail AS (SELECT f.session_id, sum(length(line)) + count(*) - 1 AS chars
         FROM framed f JOIN last l ON f.session_id = l.session_id
         WHERE f.record_no = l.last_rec AND NOT f.is_marker GROUP BY f.session_id)
SELECT l.session_id, l.n_finished, CAST(coalesce(t.chars, 0) AS BIGINT) AS tail_chars,
       coalesce(t.chars, 0) > 0 AS has_pending
FROM last l LEFT JOIN tail t ON l.session_id = t.session_id
""".replace("\n, ", ", ", 1), "chunks"), ("T2",))
def q_pending_commands(spark, sf):
    return FR.pending_commands(view(spark, sf, "chunks"))


_LIMIT_S, _UNTIL = 86_400, "2024-01-31 00:00:00"

# A record ends when the chunk that completes its marker line arrives, and begins
# where the one before it ended (the first at the session's first chunk).  The
# unfinished tail is the record after the last marker.
@register("command_timeouts", with_views(_FRAMED.replace("FROM chunks)", "FROM shell_chunks)") + f"""
, pieces AS (SELECT p.*, c.ts, f.record_no, f.is_marker, f.line AS whole
             FROM p JOIN shell_chunks c ON c.session_id = p.session_id AND c.seq = p.seq
             JOIN framed f ON f.session_id = p.session_id AND f.line_no = p.nb + p.j1 - 1),
recs AS (SELECT session_id, record_no, max(CASE WHEN is_marker AND j1 < np THEN ts END) AS end_ts,
                max(CASE WHEN is_marker THEN {_EXIT.replace('line', 'whole')} END) AS exit_code, bool_or(whole <> '') AS has_text
         FROM pieces GROUP BY 1, 2),
began AS (SELECT session_id, min(ts) AS first_ts FROM shell_chunks GROUP BY 1),
timed AS (SELECT r.*, coalesce(lag(end_ts) OVER (PARTITION BY r.session_id ORDER BY record_no), first_ts)
                      + INTERVAL {_LIMIT_S} SECOND AS deadline
          FROM recs r JOIN began b ON b.session_id = r.session_id),
late AS (SELECT *, CASE WHEN end_ts IS NULL THEN has_text AND TIMESTAMP '{_UNTIL}' > deadline ELSE end_ts > deadline END AS timed_out
         FROM timed),
texts AS (SELECT l.session_id, l.record_no,
                 string_agg(CASE WHEN is_marker THEN '' ELSE piece || CASE WHEN j1 < np THEN chr(10) ELSE '' END END, '' ORDER BY nb + j1, p.seq) ||
                 coalesce(max(CASE WHEN is_marker THEN {D.regexp_extract('whole', '(?s)^(.*?)' + T.MARKER_RE)} END), '') AS full_text,
                 coalesce(string_agg(piece || CASE WHEN j1 < np THEN chr(10) ELSE '' END, '' ORDER BY nb + j1, p.seq)
                          FILTER (WHERE p.ts <= deadline), '') AS come
          FROM late l JOIN pieces p ON p.session_id = l.session_id AND p.record_no = l.record_no GROUP BY 1, 2)
SELECT l.session_id, l.record_no,
       CASE WHEN timed_out THEN substr(regexp_replace(come, {D.rx('(?s)' + T.MARKER_RE + '.*$')}, ''), 1, 500) ELSE full_text END AS output,
       CASE WHEN NOT timed_out THEN exit_code END AS exit_code, timed_out
FROM late l JOIN texts t ON t.session_id = l.session_id AND t.record_no = l.record_no
WHERE end_ts IS NOT NULL OR timed_out
""".replace("\n, pieces", ", pieces", 1), "shell_chunks"), ("T3", "F25"))
def q_command_timeouts(spark, sf):
    return FR.command_timeouts(view(spark, sf, "shell_chunks"), _LIMIT_S, until=_UNTIL)


@register("frame_commands_table_function", QUERIES["frame_commands"].oracle, ("U4",))
def q_frame_commands_table_function(spark, sf):
    from drover.functions.sql import register_sql_functions
    register_sql_functions(spark)
    return spark.sql("SELECT * FROM frame_commands(TABLE({chunks}) PARTITION BY session_id ORDER BY seq)",
                     chunks=view(spark, sf, "chunks"))


# --- streaming operators run to completion over replayed, Spark-derived rows ----
from pyspark.sql import functions as F  # noqa: E402

from drover.operators import trajectory as TR  # noqa: E402
from drover.streaming import episodes as EP  # noqa: E402
from drover.streaming import framing as SFR  # noqa: E402
from drover.streaming import progress as PR  # noqa: E402
from drover.streaming.replay import replay_as_stream, run_to_parquet  # noqa: E402


def _oracle_of(name: str) -> str:
    from drover.plans.registry import QUERIES
    return QUERIES[name].oracle


_MAX_TURNS, _MAX_TIME, _DELAY_H, _IDLE_H = 16, 432_000, 12, 6

# Runs end at their first done, at turn 16 or after five days; a run that has not
# ended is reported once the watermark (12 hours behind the last step) has passed
# its last step by 6 hours.
_EPISODES = with_views(f"""
SELECT run_id, CAST(count(*) FILTER (WHERE turn <= coalesce(end_turn, {_MAX_TURNS})) AS INTEGER) AS n_steps, end_turn,
       max(is_done_action) FILTER (WHERE turn = end_turn) AS is_done_action,
       max(at_max_turns) FILTER (WHERE turn = end_turn) AS at_max_turns, max(late) FILTER (WHERE turn = end_turn) AS late,
       max(late AND NOT at_max_turns) FILTER (WHERE turn = end_turn) AS timed_out,
       max(at_max_turns OR NOT late) FILTER (WHERE turn = end_turn) AS verified,
       max((at_max_turns OR NOT late) AND verifier_passes) FILTER (WHERE turn = end_turn) AS goal_reached,
       CAST(max((at_max_turns OR NOT late) AND verifier_passes) FILTER (WHERE turn = end_turn) AS INTEGER) AS reward
FROM (SELECT *, min(turn) FILTER (WHERE is_done_action OR at_max_turns OR late) OVER (PARTITION BY run_id) AS end_turn,
             max(ts) OVER (PARTITION BY run_id) AS last_ts, max(ts) OVER () AS seen
      FROM (SELECT *, action_type = 'done' AS is_done_action, turn >= {_MAX_TURNS} AS at_max_turns,
                   epoch_us(ts) - epoch_us(first(ts) OVER (PARTITION BY run_id ORDER BY turn)) > {_MAX_TIME * 1_000_000} AS late
            FROM agent_steps) a) b
WHERE end_turn IS NOT NULL OR last_ts + INTERVAL {_DELAY_H + _IDLE_H} HOUR <= seen
GROUP BY run_id, end_turn
""", "agent_steps")


def _arriving(steps):
    """Five slices of six days.  Every fifth step comes up to twelve hours early
    or late against the others: the slices overlap in time, and turns arrive
    before the turns that go before them."""
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 - F.unix_timestamp(F.lit("2024-01-01 00:00:00").cast("timestamp"))
    shift = F.when(F.col("event_id") % 5 == 0, 43_200).otherwise(0)
    return steps.withColumn("slice", F.floor((at + shift) / 259_200).cast("int"))


@register("stream_episodes", _EPISODES, ("T1",))
def q_stream_episodes(spark, sf):
    steps = _arriving(view(spark, sf, "agent_steps")).drop("event_id")
    # shuffle partitions follow the size of the data, and so do the groups of runs
    groups = 64 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    stream = EP.stream_episodes(replay_as_stream(steps, "slice", slices=6), _MAX_TURNS, _MAX_TIME, f"{_DELAY_H} hours", f"{_IDLE_H} hours",
                                groups=groups)
    return EP.latest_outcomes(run_to_parquet(stream, "episodes"))


# sessions by gaps; the stream has emitted those that the watermark has passed
@register("stream_step_sessions", with_views(f"""
SELECT run_id, epoch_us(min(ts)) AS started, epoch_us(max(ts) + INTERVAL 8 HOUR) AS closes, count(*) AS n_steps,
       count(*) FILTER (WHERE action_type = 'command') AS n_command, count(*) FILTER (WHERE action_type = 'done') AS n_done,
       count(*) FILTER (WHERE action_type = 'invalid') AS n_invalid
FROM (SELECT *, sum(CASE WHEN ts < prev + INTERVAL 8 HOUR THEN 0 ELSE 1 END) OVER (PARTITION BY run_id ORDER BY ts, event_id) AS s
      FROM (SELECT *, lag(ts) OVER (PARTITION BY run_id ORDER BY ts, event_id) AS prev, max(ts) OVER () AS seen FROM agent_steps) a) b
GROUP BY run_id, s HAVING max(ts) + INTERVAL {8 + _DELAY_H} HOUR <= max(seen)
""", "agent_steps"), ("T1",))
def q_stream_step_sessions(spark, sf):
    steps = _arriving(view(spark, sf, "agent_steps")).drop("event_id")
    stream = EP.stream_step_sessions(replay_as_stream(steps, "slice", slices=6), "8 hours", f"{_DELAY_H} hours")
    done = run_to_parquet(stream, "sessions")
    return done.withColumns({c: F.unix_micros(c) for c in ("started", "closes")})


@register("stream_frame_commands", "SELECT *, false AS timed_out FROM (" + _oracle_of("frame_commands") + ") f",
          ("T2",))
def q_stream_frame_commands(spark, sf):
    chunks = view(spark, sf, "chunks").withColumn("slice", F.floor(F.col("seq") / 3))
    # slices arrive newest first: the framer buffers chunks until gaps fill
    return run_to_parquet(SFR.stream_frame_commands(replay_as_stream(chunks, "slice", order="reverse")), "frames")


@register("stream_progress", with_views("""
SELECT count(*) AS completed,
       count(*) FILTER (WHERE NOT coalesce(docker_build_success, false)) AS failed,
       count(*) FILTER (WHERE coalesce(docker_build_success, false)) AS succeeded
FROM conversion_results
""", "conversion_results"), ("T4",))
def q_stream_progress(spark, sf):
    res = view(spark, sf, "conversion_results").withColumn("slice", F.pmod(F.xxhash64("task_id"), F.lit(3)))
    return run_to_parquet(PR.stream_progress(replay_as_stream(res, "slice")), "progress", mode="complete")


@register("stream_summaries", _oracle_of("pass_at_k"), ("T6", "A2"))
def q_stream_summaries(spark, sf):
    runs = view(spark, sf, "runs").withColumn("slice", F.col("attempt") % 3)
    out, ckpt = shared_path(spark, "summaries-stream"), shared_path(spark, "summaries-ckpt")
    PR.stream_summaries(replay_as_stream(runs, "slice"), out, ckpt) \
        .trigger(availableNow=True).start().awaitTermination()
    got = PR.latest_summaries(spark, out)
    return got.select("task_id", "num_runs", "num_success", F.col("k").cast("int").alias("k"),
                      F.round("pass_at_k", 9).alias("pass_at_k"))


# every task's result is delivered three times, hours apart and in another order;
# the second delivery is the newest
@register("stream_results_sink", with_views("""
SELECT task_name, TRY_CAST(nullif(regexp_extract(log, 'Mean[: \\t\\x0b\\x0c\\r│]+([0-9.]+)', 1), '') AS DOUBLE) AS reward,
       TRY_CAST(nullif(regexp_extract(log, '│ Errors[ \\t\\x0b\\x0c\\r]+│[ \\t\\x0b\\x0c\\r]+([0-9]+)', 1), '') AS INTEGER) AS errors,
       2 AS exit_code, epoch_us(TIMESTAMP '2024-01-03 00:00:00') AS ts
FROM benchmark_logs
""", "benchmark_logs"), ("T5",))
def q_stream_results_sink(spark, sf):
    from drover.operators import funnel as FU
    scores = FU.benchmark_scores(view(spark, sf, "benchmark_logs"))
    sent = [scores.select("task_name", "reward", "errors", F.lit(code).alias("exit_code"),
                          F.lit(f"2024-01-{day:02d} 00:00:00").cast("timestamp").alias("ts"), F.lit(i).alias("slice"))
            for i, (code, day) in enumerate(((1, 1), (2, 3), (3, 2)))]
    out, ckpt = shared_path(spark, "results-stream"), shared_path(spark, "results-ckpt")
    PR.stream_results_sink(replay_as_stream(sent[0].unionByName(sent[1]).unionByName(sent[2]), "slice"), out, ckpt) \
        .trigger(availableNow=True).start().awaitTermination()
    return PR.results_table(spark, out).withColumn("ts", F.unix_micros("ts"))


# --- the skew-safe plans, checked against the same oracles ---------------------
@register("frame_commands_skew_safe", _oracle_of("frame_commands"), ("T2", "F20"))
def q_frame_commands_skew_safe(spark, sf):
    return FR.frame_commands(view(spark, sf, "chunks"), skew_safe=True)


@register("pass_at_k_skew_safe", _oracle_of("pass_at_k"), ("A1", "A2"))
def q_pass_at_k_skew_safe(spark, sf):
    out = TR.pass_at_k(TR.rollup_runs(view(spark, sf, "runs")), skew_safe=True)
    return out.select("task_id", "num_runs", "num_success", F.col("k").cast("int").alias("k"),
                      F.round("pass_at_k", 9).alias("pass_at_k"))
