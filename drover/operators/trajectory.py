"""Trajectory operators: attempts, turns, actions, outcomes and pass@k.

Inputs are long tables, one row per message/step: ``(run_id, turn, role,
content)`` or ``(run_id, turn, ts, action_type, ...)``.  All per-run windows
partition by the run key; a run is bounded by the agent's episode limit (16 to
64 assistant turns), so a window partition is small no matter how many runs
there are.  Aggregations run with map-side partial aggregation, so a hot task
(many attempts) is combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from drover.functions import text as T


# A1 --------------------------------------------------------------------------
def rollup_runs(runs: DataFrame, task: str = "task_id", success: str = "success") -> DataFrame:
    """Per task: number of attempts, successes (reward 1 on success, else 0)."""
    ok = F.coalesce(F.col(success), F.lit(False))
    return runs.groupBy(task).agg(
        F.count(F.lit(1)).cast("int").alias("num_runs"),
        F.sum(ok.cast("int")).cast("int").alias("num_success"),
    )


# A2 --------------------------------------------------------------------------
def pass_at_k_value(n, c, k) -> Column:
    """Unbiased pass@k = 1 - C(n-c, k) / C(n, k), as a product of c factors:
    C(n-c,k)/C(n,k) = prod_{i=n-c+1..n} (1 - k/i).  0 when c = 0; 1 when k > n-c."""
    n, c, k = (F.col(x) if isinstance(x, str) else x for x in (n, c, k))
    prod = F.aggregate(F.sequence(n - c + 1, F.greatest(n, n - c + 1)), F.lit(1.0),
                       lambda acc, i: acc * (F.lit(1.0) - k.cast("double") / i.cast("double")))
    return (F.when(c <= 0, F.lit(0.0))
            .when(k > n - c, F.lit(1.0))
            .otherwise(F.lit(1.0) - prod))


K_CHUNK = 1024


def _pass_at_k_run(n: Column, c: Column, first: Column, last: Column) -> Column:
    """pass@k for k = first..last as one array: the failure probability of the
    first k is one product, each further one the last times (n-c-k+1)/(n-k+1)."""
    fail = F.lit(1.0) - pass_at_k_value(n, c, first)
    more = F.when(last > first, F.sequence(first + 1, last)).otherwise(F.array().cast("array<int>"))
    start = F.struct(fail.alias("p"), F.array(fail).alias("all"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * F.greatest(n - c - k + 1, F.lit(0)) / (n - k + 1)
        return F.struct(p.alias("p"), F.concat(acc["all"], F.array(p)).alias("all"))

    run = F.aggregate(more, start, step, lambda acc: acc["all"])
    return F.transform(run, lambda p: F.when(c <= 0, F.lit(0.0)).otherwise(F.lit(1.0) - p))


def pass_at_k(rollup: DataFrame, ks: list[int] | None = None, n: str = "num_runs",
              c: str = "num_success", skew_safe: bool = False) -> DataFrame:
    """Long form ``(…, k, pass_at_k)`` for every k in 1..n (or only ``ks`` that
    exist for the task, like the keys of a run summary).  A task's k range is
    cut into chunks of 1024, each a running product, so the work is linear in
    n.  ``skew_safe`` also spreads the (task, chunk) rows over all shuffle
    partitions, so a task with a huge number of attempts is computed by many."""
    if ks is not None:
        out = rollup.withColumn("k", F.explode(F.array(*[F.lit(x) for x in ks]))) \
            .filter(F.col("k") <= F.col(n))
        return out.withColumn("pass_at_k", pass_at_k_value(n, c, "k"))
    chunks = rollup.filter(F.col(n) >= 1).withColumn(
        "_chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col(n) - 1) / K_CHUNK).cast("int"))))
    if skew_safe:
        parts = int(rollup.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        keys = [x for x in rollup.columns if x not in (n, c)]
        chunks = chunks.repartition(parts, *keys, "_chunk")  # explicit count: not coalesced away
    first = (F.col("_chunk") * K_CHUNK + 1).cast("int")
    last = F.least(F.col(n), (F.col("_chunk") + 1) * K_CHUNK).cast("int")
    run = _pass_at_k_run(F.col(n), F.col(c), first, last)
    return chunks.select(*rollup.columns, first.alias("_first"), F.posexplode(run).alias("_at", "pass_at_k")) \
        .select(*rollup.columns, (F.col("_first") + F.col("_at")).alias("k"), "pass_at_k")


# R4 / F6 / F19 ---------------------------------------------------------------
def parse_actions(turns: DataFrame, content: str = "content", role: str = "role") -> DataFrame:
    """Assistant rows with their typed action (done / command / invalid)."""
    return (turns.filter(F.col(role) == "assistant")
            .withColumn("action_type", T.action_type(content))
            .withColumn("command", T.action_command(content))
            .withColumn("is_heredoc", F.coalesce(T.is_heredoc("command"), F.lit(False))))


def action_mix(actions: DataFrame, run: str = "run_id") -> DataFrame:
    """Per run: how many replies were commands, done, invalid; invalid rate."""
    return actions.groupBy(run).agg(
        F.count(F.lit(1)).alias("n_replies"),
        F.count_if(F.col("action_type") == "command").alias("n_command"),
        F.count_if(F.col("action_type") == "done").alias("n_done"),
        F.count_if(F.col("action_type") == "invalid").alias("n_invalid"),
        F.count_if(F.col("is_heredoc")).alias("n_heredoc"),
    ).withColumn("invalid_rate", F.col("n_invalid") / F.col("n_replies"))


# W4 --------------------------------------------------------------------------
def _running(df: DataFrame, run: str, seq: str, value: Column, out: str, inclusive: bool,
             skew_safe: bool) -> DataFrame:
    """Running sum per run; ``skew_safe`` spreads one huge run over many tasks."""
    if skew_safe:
        from drover.operators.dataset import keyed_prefix_sum
        return keyed_prefix_sum(df, run, [seq], value, out, inclusive=inclusive)
    end = Window.currentRow if inclusive else -1
    w = Window.partitionBy(run).orderBy(seq).rowsBetween(Window.unboundedPreceding, end)
    return df.withColumn(out, F.coalesce(F.sum(value).over(w), F.lit(0)))


def number_turns(turns: DataFrame, run: str = "run_id", seq: str = "turn",
                 role: str = "role", skew_safe: bool = False) -> DataFrame:
    """Every message gets ``turn_no``: the number of assistant replies at or
    before it (one turn = one assistant reply); system/user rows before the
    first reply have 0."""
    flag = (F.col(role) == "assistant").cast("int")
    return _running(turns, run, seq, flag, "turn_no", True, skew_safe) \
        .withColumn("turn_no", F.col("turn_no").cast("int"))


# W5 --------------------------------------------------------------------------
def number_commands(actions: DataFrame, run: str = "run_id", seq: str = "turn",
                    skew_safe: bool = False) -> DataFrame:
    """Running number over non-empty commands only (done, invalid and empty
    commands are skipped and get null)."""
    is_cmd = (F.col("action_type") == "command") & (F.coalesce(F.col("command"), F.lit("")) != "")
    return _running(actions, run, seq, is_cmd.cast("int"), "command_no", True, skew_safe) \
        .withColumn("command_no", F.when(is_cmd, F.col("command_no").cast("int")))


# W6 --------------------------------------------------------------------------
def truncate_at_done(turns: DataFrame, max_actions: int = 16, run: str = "run_id",
                     seq: str = "turn", role: str = "role", content: str = "content") -> DataFrame:
    """Cut each attempt at its first ``done`` reply or after ``max_actions``
    replies.  The done reply is the last row kept; at the action limit the last
    reply's observation is still kept (it was executed).  ``ended_by`` is done,
    max_actions, or incomplete for an attempt that reached neither."""
    numbered = number_turns(turns, run, seq, role)
    is_done = (F.col(role) == "assistant") & (T.action_type(content) == "done")
    whole = Window.partitionBy(run)
    first_done = F.min(F.when(is_done, F.col("turn_no"))).over(whole)
    out = (numbered.withColumn("first_done", first_done)
           .withColumn("cut", F.least(F.coalesce(F.col("first_done"), F.lit(max_actions)), F.lit(max_actions)))
           .withColumn("ended_by", F.when(F.col("first_done") <= max_actions, F.lit("done"))
                       .when(F.max("turn_no").over(whole) >= max_actions, F.lit("max_actions"))
                       .otherwise(F.lit("incomplete"))))
    at_cut_kept = (F.col(role) == "assistant") | (F.col("ended_by") != "done")
    keep = (F.col("turn_no") < F.col("cut")) | ((F.col("turn_no") == F.col("cut")) & at_cut_kept)
    return out.filter(keep).drop("first_done")


# X3 --------------------------------------------------------------------------
def active_per_turn(turns: DataFrame, max_actions: int = 16, run: str = "run_id",
                    seq: str = "turn", role: str = "role", content: str = "content") -> DataFrame:
    """Survivor curve: attempts still running after each turn (an attempt stops
    being active on the turn of its done reply or at the action limit; one that
    reached neither is still active after its last turn)."""
    kept = truncate_at_done(turns, max_actions, run, seq, role, content)
    ends = kept.filter(F.col(role) == "assistant").groupBy(run).agg(
        F.max("turn_no").alias("last_turn"), F.max("ended_by").alias("ended_by"))
    # an attempt is active after turn t when t < last_turn, or when nothing ended it
    per_turn = ends.withColumn("turn_no", F.explode(F.sequence(F.lit(1), F.col("last_turn"))))
    return per_turn.groupBy("turn_no").agg(
        F.count(F.lit(1)).alias("n_started"),
        F.count_if((F.col("turn_no") < F.col("last_turn")) | (F.col("ended_by") == "incomplete"))
        .alias("n_active_after"))


# J7 --------------------------------------------------------------------------
def pair_action_observation(turns: DataFrame, run: str = "run_id", seq: str = "turn",
                            role: str = "role", content: str = "content") -> DataFrame:
    """Each assistant reply with the immediately following message when that
    message is a user message (a ``lead`` over the run, no self-join)."""
    w = Window.partitionBy(run).orderBy(seq)
    nxt_role, nxt = F.lead(role).over(w), F.lead(content).over(w)
    paired = turns.withColumn("_nr", nxt_role).withColumn("_nc", nxt)
    return (paired.filter(F.col(role) == "assistant")
            .withColumn("observation", F.when(F.col("_nr") == "user", F.col("_nc")))
            .drop("_nr", "_nc"))


# W9 / F23 ------------------------------------------------------------------------
def _history_rows(turns: DataFrame, run: str, seq: str, role: str, content: str,
                  output_limit: int) -> DataFrame:
    """Per message: position in the run, whether it is a history command, its
    command number and its summary block (all windows share one partitioning)."""
    w = Window.partitionBy(run).orderBy(seq)
    t = (turns.withColumn("_pos", F.row_number().over(w))
         .withColumn("_nr", F.lead(role).over(w)).withColumn("_nc", F.lead(content).over(w)))
    cmd = T.action_command(content)
    is_cmd = ((F.col("_pos") > 2) & (F.col(role) == "assistant") & (T.action_type(content) == "command")
              & (F.coalesce(cmd, F.lit("")) != ""))
    t = t.withColumn("_is_cmd", is_cmd)
    running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = t.withColumn("_n", F.when(F.col("_is_cmd"), F.count_if("_is_cmd").over(running)))
    obs = F.coalesce(F.when(F.col("_nr") == "user", F.col("_nc")), F.lit(""))
    obs = F.when(F.length(obs) > output_limit,
                 F.concat(F.substring(obs, 1, output_limit), F.lit(T.HISTORY_CUT_MARK))).otherwise(obs)
    block = F.concat(F.lit("Command "), F.col("_n").cast("string"), F.lit(": "), cmd, F.lit("\nOutput: "), obs)
    return t.withColumn("_block", F.when(F.col("_is_cmd"), F.struct(F.col("_n").alias("n"), block.alias("b"))))


def _history_text(blocks: Column) -> Column:
    return F.concat(F.lit(T.HISTORY_HEADER),
                    F.array_join(F.transform(F.array_sort(blocks), lambda x: x["b"]), T.HISTORY_SEPARATOR),
                    F.lit(T.HISTORY_FOOTER))


def command_history(turns: DataFrame, run: str = "run_id", seq: str = "turn",
                    role: str = "role", content: str = "content",
                    output_limit: int = T.HISTORY_OUTPUT_LIMIT) -> DataFrame:
    """Per run, the summary of commands and their outputs used when a chat is
    compacted: "Command n: …\nOutput: …" blocks (outputs cut at 500 chars),
    framed; runs that issued no command have no row.  The first two messages
    (system, original request) are not part of the history."""
    t = _history_rows(turns, run, seq, role, content, output_limit)
    hist = t.groupBy(run).agg(F.count_if("_is_cmd").alias("n_commands"),
                              F.collect_list("_block").alias("_b"))
    return hist.filter(F.col("n_commands") > 0).select(run, "n_commands", _history_text(F.col("_b")).alias("history"))


def compact_history(turns: DataFrame, min_chars: int, run: str = "run_id", seq: str = "turn",
                    role: str = "role", content: str = "content",
                    output_limit: int = T.HISTORY_OUTPUT_LIMIT) -> DataFrame:
    """For runs whose chat exceeds ``min_chars`` characters: the compacted first
    user message = original first user message + summary of all commands.
    Older summaries are never nested (the original message is used).  One
    pass: the run's size is a window, so small runs are dropped before any
    block is collected, and one aggregate builds the result (no join)."""
    t = _history_rows(turns, run, seq, role, content, output_limit)
    t = t.withColumn("_chars", F.sum(F.length(content)).over(Window.partitionBy(run))) \
        .filter(F.col("_chars") > min_chars)
    per_run = t.groupBy(run).agg(
        F.max("_chars").alias("chat_chars"),
        F.max(F.when((F.col("_pos") == 2) & (F.col(role) == "user"), F.col(content))).alias("first_user"),
        F.count_if("_is_cmd").alias("n_commands"),
        F.collect_list("_block").alias("_b"))
    first = F.coalesce(F.col("first_user"), F.lit(""))
    return per_run.select(
        run, "chat_chars", "n_commands",
        F.when(F.col("n_commands") == 0, first)
         .otherwise(F.concat(first, F.lit("\n\n"), _history_text(F.col("_b")))).alias("compacted_user"))


# A9 / A10 ------------------------------------------------------------------------
def token_totals(turns: DataFrame, run: str = "run_id", seq: str = "turn", role: str = "role",
                 content: str = "content", counter=T.whitespace_tokens, skew_safe: bool = False) -> DataFrame:
    """Input tokens are counted over the whole chat before each reply, output
    tokens over each reply; summed per run."""
    toks = turns.withColumn("_t", counter(content).cast("bigint"))
    toks = _running(toks, run, seq, F.col("_t"), "_before", False, skew_safe)
    asst = F.col(role) == "assistant"
    return toks.groupBy(run).agg(
        F.sum(F.when(asst, F.col("_before")).otherwise(0)).cast("bigint").alias("n_input_tokens"),
        F.sum(F.when(asst, F.col("_t")).otherwise(0)).cast("bigint").alias("n_output_tokens"),
        F.count_if(asst).cast("int").alias("n_episodes"))


def episode_counts(turns: DataFrame, run: str = "run_id", role: str = "role") -> DataFrame:
    return turns.groupBy(run).agg(F.count_if(F.col(role) == "assistant").cast("int").alias("n_episodes"))


# W7 --------------------------------------------------------------------------
def _elapsed_us(ts: str, run: str) -> Column:
    start = F.min(ts).over(Window.partitionBy(run))
    return F.timestamp_diff("MICROSECOND", start, F.col(ts))


def step_outcomes(steps: DataFrame, max_turns: int = 16, max_time: float = 600,
                  run: str = "run_id", turn: str = "turn", ts: str = "ts",
                  action: str = "action_type", passes: str = "verifier_passes") -> DataFrame:
    """Per step of a training episode: ``done`` on a done action; then the turn
    limit ends the episode, otherwise a late step ends it as timed out.  The
    verifier runs only when not timed out; reward 1 iff it passes."""
    at_max = F.col(turn) >= max_turns
    late = _elapsed_us(ts, run) > F.lit(int(max_time * 1_000_000))
    done = (F.col(action) == "done") | at_max | late
    timed_out = ~at_max & late
    return (steps.withColumn("is_done_action", F.col(action) == "done")
            .withColumn("at_max_turns", at_max).withColumn("late", late)
            .withColumn("done", done).withColumn("timed_out", timed_out)
            .withColumn("verified", done & ~timed_out)
            .withColumn("goal_reached", done & ~timed_out & F.coalesce(F.col(passes), F.lit(False))))


def episode_outcome(steps: DataFrame, max_turns: int = 16, max_time: float = 600,
                    run: str = "run_id", turn: str = "turn", ts: str = "ts",
                    action: str = "action_type", passes: str = "verifier_passes") -> DataFrame:
    """One row per episode: the first terminal step (rows after it are ignored);
    episodes with no terminal step are still running (null end).  One pass:
    per-run windows, then one aggregate on the same partitioning (no join).
    Turns count from 1 without gaps, so rows beyond the turn limit can't matter
    and never reach a window."""
    s = step_outcomes(steps.filter(F.col(turn) <= max_turns), max_turns, max_time, run, turn, ts, action, passes)
    s = s.withColumn("_end", F.min(F.when(F.col("done"), F.col(turn))).over(Window.partitionBy(run)))
    at_end = F.col(turn) == F.col("_end")

    def at_terminal(c):
        return F.max(F.when(at_end, F.col(c)))

    return s.groupBy(run).agg(
        F.count_if(F.col("_end").isNull() | (F.col(turn) <= F.col("_end"))).cast("int").alias("n_steps"),
        F.min("_end").alias("end_turn"),
        *[at_terminal(c).alias(c) for c in ("is_done_action", "at_max_turns", "late", "timed_out",
                                            "verified", "goal_reached")],
        F.max(F.when(at_end, F.col("goal_reached").cast("int"))).alias("reward"))


# W8 --------------------------------------------------------------------------
def wallclock_cutoff(steps: DataFrame, max_episodes: int = 64, max_time: float = 600,
                     run: str = "run_id", turn: str = "turn", ts: str = "ts",
                     action: str = "action_type") -> DataFrame:
    """Benchmark-agent stop rule: stop on a done reply, else after a step whose
    elapsed time exceeds ``max_time``, else at ``max_episodes`` episodes (rows
    beyond that turn never reach a window)."""
    steps = steps.filter(F.col(turn) <= max_episodes)
    late = _elapsed_us(ts, run) > F.lit(int(max_time * 1_000_000))
    reason = (F.when(F.col(action) == "done", F.lit("done"))
              .when(late, F.lit("time"))
              .when(F.col(turn) >= max_episodes, F.lit("max_episodes")))
    s = steps.withColumn("_reason", reason)
    s = s.withColumn("_end", F.min(F.when(F.col("_reason").isNotNull(), F.col(turn)))
                     .over(Window.partitionBy(run)))
    return s.groupBy(run).agg(
        F.count_if(F.col("_end").isNull() | (F.col(turn) <= F.col("_end"))).cast("int").alias("n_episodes"),
        F.min("_end").alias("stop_turn"),
        F.coalesce(F.max(F.when(F.col(turn) == F.col("_end"), F.col("_reason"))), F.lit("running"))
        .alias("stop_reason"))


# R6 --------------------------------------------------------------------------
def format_observations(steps: DataFrame, limit: int = T.MAX_OUTPUT_LENGTH, binary_exit: bool = False,
                        kind: str = "action_type", exit_code: str = "exit_code",
                        output: str = "output") -> DataFrame:
    """Next-turn user message for each step (invalid -> fixed nudge text)."""
    return steps.withColumn("observation",
                            T.format_observation(kind, exit_code, T.clean_output(output), limit=limit,
                                                 binary_exit=binary_exit))


# P4 --------------------------------------------------------------------------
def filter_solved_tasks(summaries: DataFrame, k: int = 16, strict: bool = False,
                        n: str = "num_runs", c: str = "num_success") -> DataFrame:
    """Tasks whose pass@k > 0.  Lenient (default): a summary without a pass@k
    entry for ``k`` (fewer than k attempts) is dropped.  Strict: such a summary
    fails the job, like a missing key does in the training-set preparation."""
    s = summaries
    if strict:
        # the check is part of a predicate, so it cannot be pruned away
        s = s.filter(F.assert_true(F.col(n) >= k, F.lit(f"run summary without pass@{k}")).isNull())
    # pass@k > 0 exactly when some attempt succeeded
    return pass_at_k(s.filter((F.col(c) > 0) & (F.col(n) >= k)), ks=[k], n=n, c=c)
