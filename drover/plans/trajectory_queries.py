"""Named queries over attempts, turns and steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from drover.functions import text as T
from drover.operators import trajectory as TR
from drover.plans import duck as D
from drover.plans.fixtures import VIEWS, view, with_views
from drover.plans.registry import QUERIES, register

R9 = 9  # doubles are rounded to 9 places before hashing, in both engines

# --- A1 + A2 -------------------------------------------------------------------
_PASS_SQL = with_views(f"""
SELECT task_id, num_runs, num_success, k,
       round(CASE WHEN num_success <= 0 THEN 0.0
                  WHEN k > num_runs - num_success THEN 1.0
                  ELSE 1.0 - list_reduce(list_transform(range(num_runs - num_success + 1, num_runs + 1),
                                         lambda i: 1.0 - CAST(k AS DOUBLE) / CAST(i AS DOUBLE)),
                                         lambda a, b: a * b, 1.0) END, {R9}) AS pass_at_k
FROM (SELECT task_id, CAST(count(*) AS INTEGER) AS num_runs,
             CAST(sum(CASE WHEN coalesce(success, false) THEN 1 ELSE 0 END) AS INTEGER) AS num_success
      FROM runs GROUP BY task_id) r,
     LATERAL (SELECT CAST(unnest(range(1, num_runs + 1)) AS INTEGER) AS k) ks
""", "runs")


@register("pass_at_k", _PASS_SQL, ("A1", "A2"))
def q_pass_at_k(spark, sf):
    out = TR.pass_at_k(TR.rollup_runs(view(spark, sf, "runs")))
    return out.select("task_id", "num_runs", "num_success", F.col("k").cast("int").alias("k"),
                      F.round("pass_at_k", R9).alias("pass_at_k"))


@register("rollup_runs", with_views("""
SELECT task_id, CAST(count(*) AS INTEGER) AS num_runs,
       CAST(sum(CASE WHEN coalesce(success, false) THEN 1 ELSE 0 END) AS INTEGER) AS num_success
FROM runs GROUP BY task_id
""", "runs"), ("A1",))
def q_rollup_runs(spark, sf):
    return TR.rollup_runs(view(spark, sf, "runs"))


# --- R4 / F6 / F19 ---------------------------------------------------------------
@register("parse_actions", with_views(f"""
SELECT run_id, turn, {D.action_type('content')} AS action_type, {D.action_command('content')} AS command,
       coalesce(contains({D.action_command('content')}, '<<'), false) AS is_heredoc
FROM responses WHERE role = 'assistant'
""", "responses"), ("R4", "F6", "F19"))
def q_parse_actions(spark, sf):
    return TR.parse_actions(view(spark, sf, "responses")).select(
        "run_id", "turn", "action_type", "command", "is_heredoc")


@register("action_mix", with_views(f"""
SELECT run_id, count(*) AS n_replies,
       count(*) FILTER (WHERE t = 'command') AS n_command,
       count(*) FILTER (WHERE t = 'done') AS n_done,
       count(*) FILTER (WHERE t = 'invalid') AS n_invalid,
       count(*) FILTER (WHERE coalesce(contains(c, '<<'), false)) AS n_heredoc,
       round(CAST(count(*) FILTER (WHERE t = 'invalid') AS DOUBLE) / count(*), {R9}) AS invalid_rate
FROM (SELECT run_id, {D.action_type('content')} AS t, {D.action_command('content')} AS c
      FROM responses WHERE role = 'assistant') a
GROUP BY run_id
""", "responses"), ("R4",))
def q_action_mix(spark, sf):
    out = TR.action_mix(TR.parse_actions(view(spark, sf, "responses")))
    return out.withColumn("invalid_rate", F.round("invalid_rate", R9))


# --- W4 ----------------------------------------------------------------------------
@register("number_turns", with_views("""
SELECT run_id, turn, role,
       CAST(count(*) FILTER (WHERE role = 'assistant') OVER (PARTITION BY run_id ORDER BY turn
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS INTEGER) AS turn_no
FROM responses
""", "responses"), ("W4",))
def q_number_turns(spark, sf):
    return TR.number_turns(view(spark, sf, "responses")).select("run_id", "turn", "role", "turn_no")


# --- W5 ----------------------------------------------------------------------------
@register("number_commands", with_views(f"""
SELECT run_id, turn, t AS action_type,
       CASE WHEN is_cmd THEN CAST(count(*) FILTER (WHERE is_cmd) OVER (PARTITION BY run_id ORDER BY turn
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS INTEGER) END AS command_no
FROM (SELECT run_id, turn, {D.action_type('content')} AS t,
             ({D.action_type('content')} = 'command' AND coalesce({D.action_command('content')}, '') <> '') AS is_cmd
      FROM responses WHERE role = 'assistant') a
""", "responses"), ("W5",))
def q_number_commands(spark, sf):
    return TR.number_commands(TR.parse_actions(view(spark, sf, "responses"))).select(
        "run_id", "turn", "action_type", "command_no")


# --- W6 ----------------------------------------------------------------------------
_W6_BASE = f"""
numbered AS (
  SELECT run_id, turn, role, content,
         CAST(count(*) FILTER (WHERE role = 'assistant') OVER (PARTITION BY run_id ORDER BY turn
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS INTEGER) AS turn_no,
         (role = 'assistant' AND {D.action_type('content')} = 'done') AS is_done
  FROM responses),
cut AS (
  SELECT *, min(CASE WHEN is_done THEN turn_no END) OVER (PARTITION BY run_id) AS first_done FROM numbered),
marked AS (
  SELECT *, least(coalesce(first_done, {{m}}), {{m}}) AS cut,
         CASE WHEN first_done <= {{m}} THEN 'done'
              WHEN max(turn_no) OVER (PARTITION BY run_id) >= {{m}} THEN 'max_actions'
              ELSE 'incomplete' END AS ended_by FROM cut),
kept AS (
  SELECT * FROM marked
  WHERE turn_no < cut OR (turn_no = cut AND (role = 'assistant' OR ended_by <> 'done')))
"""


def _w6(max_actions: int) -> str:
    return _W6_BASE.replace("{m}", str(max_actions))


@register("truncate_at_done", with_views(f"""
, {_w6(16)}
SELECT run_id, turn, role, turn_no, ended_by FROM kept
""".replace("\n, ", ", ", 1), "responses"), ("W6",))
def q_truncate_at_done(spark, sf):
    return TR.truncate_at_done(view(spark, sf, "responses"), 16).select(
        "run_id", "turn", "role", "turn_no", "ended_by")


# --- X3 ----------------------------------------------------------------------------
@register("active_minus_done", with_views(f"""
, {_w6(16)},
ends AS (SELECT run_id, max(turn_no) AS last_turn, max(ended_by) AS ended_by
         FROM kept WHERE role = 'assistant' GROUP BY run_id)
SELECT CAST(t AS INTEGER) AS turn_no, count(*) AS n_started,
       count(*) FILTER (WHERE t < last_turn OR ended_by = 'incomplete') AS n_active_after
FROM ends, LATERAL (SELECT unnest(range(1, last_turn + 1)) AS t) x
GROUP BY t
""".replace("\n, ", ", ", 1), "responses"), ("X3",))
def q_active_minus_done(spark, sf):
    return TR.active_per_turn(view(spark, sf, "responses"), 16).select(
        F.col("turn_no").cast("int").alias("turn_no"), "n_started", "n_active_after")


# --- J7 ----------------------------------------------------------------------------
@register("pair_action_observation", with_views(f"""
SELECT run_id, turn, {D.action_type('content')} AS action_type, {D.action_command('content')} AS command,
       CASE WHEN nr = 'user' THEN nc END AS observation
FROM (SELECT *, lead(role) OVER (PARTITION BY run_id ORDER BY turn) AS nr,
             lead(content) OVER (PARTITION BY run_id ORDER BY turn) AS nc FROM responses) p
WHERE role = 'assistant'
""", "responses"), ("J7",))
def q_pair_action_observation(spark, sf):
    p = TR.pair_action_observation(view(spark, sf, "responses"))
    return p.select("run_id", "turn", T.action_type("content").alias("action_type"),
                    T.action_command("content").alias("command"), "observation")


# --- W9 / F23 ----------------------------------------------------------------------
_COMPACT_MIN_CHARS = 1500


@register("compact_history", with_views(f"""
, pos AS (
  SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY turn) AS p,
         lead(role) OVER (PARTITION BY run_id ORDER BY turn) AS nr,
         lead(content) OVER (PARTITION BY run_id ORDER BY turn) AS nc
  FROM responses),
acts AS (
  SELECT run_id, turn, {D.action_command('content')} AS cmd,
         coalesce(CASE WHEN nr = 'user' THEN nc END, '') AS obs
  FROM pos
  WHERE p > 2 AND role = 'assistant' AND {D.action_type('content')} = 'command'
    AND coalesce({D.action_command('content')}, '') <> ''),
blocks AS (
  SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY turn) AS n, cmd,
         CASE WHEN length(obs) > 500 THEN substr(obs, 1, 500) || {D.lit(T.HISTORY_CUT_MARK)} ELSE obs END AS o
  FROM acts),
hist AS (
  SELECT run_id, count(*) AS n_commands,
         {D.lit(T.HISTORY_HEADER)} || string_agg('Command ' || CAST(n AS VARCHAR) || ': ' || cmd || chr(10) || 'Output: ' || o,
                    {D.lit(T.HISTORY_SEPARATOR)} ORDER BY n) || {D.lit(T.HISTORY_FOOTER)} AS history
  FROM blocks GROUP BY run_id),
per_run AS (
  SELECT run_id, CAST(sum(length(content)) AS BIGINT) AS chat_chars,
         max(CASE WHEN p = 2 AND role = 'user' THEN content END) AS first_user
  FROM pos GROUP BY run_id)
SELECT r.run_id, r.chat_chars, coalesce(h.n_commands, 0) AS n_commands,
       CASE WHEN h.history IS NULL THEN coalesce(r.first_user, '')
            ELSE coalesce(r.first_user, '') || chr(10) || chr(10) || h.history END AS compacted_user
FROM per_run r LEFT JOIN hist h ON r.run_id = h.run_id
WHERE r.chat_chars > {_COMPACT_MIN_CHARS}
""".replace("\n, ", ", ", 1), "responses"), ("W9", "F23"))
def q_compact_history(spark, sf):
    return TR.compact_history(view(spark, sf, "responses"), _COMPACT_MIN_CHARS)


# --- A9 / A10 ----------------------------------------------------------------------
@register("token_totals", f"""
SELECT run_id, CAST(sum(CASE WHEN role = 'assistant' THEN before ELSE 0 END) AS BIGINT) AS n_input_tokens,
       CAST(sum(CASE WHEN role = 'assistant' THEN t ELSE 0 END) AS BIGINT) AS n_output_tokens,
       CAST(count(*) FILTER (WHERE role = 'assistant') AS INTEGER) AS n_episodes
FROM (SELECT conv_id AS run_id, role, t,
             coalesce(sum(t) OVER (PARTITION BY conv_id ORDER BY turn
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM (SELECT conv_id, turn, role, {D.whitespace_tokens('text')} AS t FROM conversations) c) x
GROUP BY run_id
""", ("A9",))
def q_token_totals(spark, sf):
    from drover.plans.fixtures import table
    conv = table(spark, sf, "conversations").select(
        F.col("conv_id").alias("run_id"), "turn", "role", F.col("text").alias("content"))
    return TR.token_totals(conv)


@register("episode_counts", """
SELECT conv_id AS run_id, CAST(count(*) FILTER (WHERE role = 'assistant') AS INTEGER) AS n_episodes
FROM conversations GROUP BY conv_id
""", ("A10",))
def q_episode_counts(spark, sf):
    from drover.plans.fixtures import table
    return TR.episode_counts(table(spark, sf, "conversations").withColumnRenamed("conv_id", "run_id"))


# --- W7 ----------------------------------------------------------------------------
_W7_TURNS, _W7_TIME = 4, 86400


@register("episode_outcome", with_views(f"""
, s AS (
  SELECT run_id, turn, action_type = 'done' AS is_done_action, turn >= {_W7_TURNS} AS at_max_turns,
         date_diff('microsecond', min(ts) OVER (PARTITION BY run_id), ts) > {_W7_TIME * 1_000_000} AS late,
         coalesce(verifier_passes, false) AS passes
  FROM steps),
d AS (
  SELECT *, (is_done_action OR at_max_turns OR late) AS done, (NOT at_max_turns AND late) AS timed_out FROM s),
e AS (SELECT *, min(CASE WHEN done THEN turn END) OVER (PARTITION BY run_id) AS end_turn FROM d),
cnt AS (SELECT run_id, CAST(count(*) AS INTEGER) AS n_steps FROM e
        WHERE end_turn IS NULL OR turn <= end_turn GROUP BY run_id),
term AS (
  SELECT run_id, turn AS end_turn, is_done_action, at_max_turns, late, timed_out,
         (done AND NOT timed_out) AS verified, (done AND NOT timed_out AND passes) AS goal_reached,
         CAST((done AND NOT timed_out AND passes) AS INTEGER) AS reward
  FROM e WHERE turn = end_turn)
SELECT c.run_id, c.n_steps, t.end_turn, t.is_done_action, t.at_max_turns, t.late, t.timed_out,
       t.verified, t.goal_reached, t.reward
FROM cnt c LEFT JOIN term t ON c.run_id = t.run_id
""".replace("\n, ", ", ", 1), "steps"), ("W7",))
def q_episode_outcome(spark, sf):
    return TR.episode_outcome(view(spark, sf, "steps"), max_turns=_W7_TURNS, max_time=_W7_TIME)


# --- W8 ----------------------------------------------------------------------------
@register("wallclock_cutoff", with_views("""
, s AS (
  SELECT run_id, turn,
         CASE WHEN action_type = 'done' THEN 'done'
              WHEN date_diff('microsecond', min(ts) OVER (PARTITION BY run_id), ts) > 600000000 THEN 'time'
              WHEN turn >= 64 THEN 'max_episodes' END AS reason
  FROM steps),
e AS (SELECT *, min(CASE WHEN reason IS NOT NULL THEN turn END) OVER (PARTITION BY run_id) AS end_turn FROM s)
SELECT u.run_id, u.n_episodes, t.stop_turn, coalesce(t.stop_reason, 'running') AS stop_reason
FROM (SELECT run_id, CAST(count(*) AS INTEGER) AS n_episodes FROM e
      WHERE end_turn IS NULL OR turn <= end_turn GROUP BY run_id) u
LEFT JOIN (SELECT run_id, turn AS stop_turn, reason AS stop_reason FROM e WHERE turn = end_turn) t
  ON u.run_id = t.run_id
""".replace("\n, ", ", ", 1), "steps"), ("W8",))
def q_wallclock_cutoff(spark, sf):
    return TR.wallclock_cutoff(view(spark, sf, "steps"), max_episodes=64, max_time=600)


# --- R6 / F10 / F11 -----------------------------------------------------------------
_OBS_LIMIT = T.MAX_OUTPUT_LENGTH


@register("format_observations", with_views(f"""
, p AS (
  SELECT run_id, turn, {D.action_type('content')} AS action_type,
         CASE WHEN nr = 'user' THEN nc END AS output
  FROM (SELECT *, lead(role) OVER (PARTITION BY run_id ORDER BY turn) AS nr,
               lead(content) OVER (PARTITION BY run_id ORDER BY turn) AS nc FROM responses) x
  WHERE role = 'assistant'),
q AS (SELECT *, CASE WHEN output IS NULL THEN 1 ELSE 0 END AS exit_code FROM p)
SELECT run_id, turn, action_type, exit_code,
       {D.format_observation('action_type', 'exit_code', D.clean_output('output'), _OBS_LIMIT)} AS observation
FROM q
""".replace("\n, ", ", ", 1), "responses"), ("R6", "F7", "F8", "F9", "F10", "F11"))
def q_format_observations(spark, sf):
    p = TR.pair_action_observation(view(spark, sf, "responses"))
    steps = p.select("run_id", "turn", T.action_type("content").alias("action_type"),
                     F.col("observation").alias("output"),
                     F.when(F.col("observation").isNull(), 1).otherwise(0).alias("exit_code"))
    return TR.format_observations(steps, limit=_OBS_LIMIT).select(
        "run_id", "turn", "action_type", "exit_code", "observation")


# --- W6 / W9 / R4 over chats of many commands -----------------------------------------
def _over_long_chats(name: str) -> str:
    """The oracle of a query over ``responses``, over the long chats instead."""
    cte = "responses AS (\n{}\n)"
    text, old = QUERIES[name].oracle, cte.format(VIEWS["responses"].rstrip())
    if old not in text:
        raise AssertionError(f"{name} no longer reads responses")
    return text.replace(old, cte.format(VIEWS["long_chats"].rstrip()))


@register("truncate_long_chats", _over_long_chats("truncate_at_done"), ("W6",))
def q_truncate_long_chats(spark, sf):
    return TR.truncate_at_done(view(spark, sf, "long_chats"), 16).select("run_id", "turn", "role", "turn_no", "ended_by")


@register("compact_long_chats", _over_long_chats("compact_history"), ("W9", "F23"))
def q_compact_long_chats(spark, sf):
    return TR.compact_history(view(spark, sf, "long_chats"), _COMPACT_MIN_CHARS)
