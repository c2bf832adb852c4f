"""Command framing over terminal chunk streams (batch form of T2/T3).

A session's output arrives as ordered chunks; each finished command is closed
by a marker line ``__CMD_DONE__<hex>__:<exit code>``.  Markers can straddle
chunks, so chunks are cut into pieces at newlines, pieces are numbered with the
session's running newline count (a window over chunk rows), and pieces with
the same line number are glued back into lines.  A running count of complete
marker lines then gives every line its record number; each record's output is
the text between the previous marker line and the start of its own marker.

Nothing is concatenated per session: the widest value built is one record's
output, which is the record itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from drover.functions import text as T
from drover.operators.dataset import keyed_prefix_sum

MARKER_LINE_RE = T.MARKER_RE  # "__CMD_DONE__<hex>__:"
#: Characters beyond the limit that are looked at for a marker.
MARKER_ROOM = 256


def chunk_lines(chunks: DataFrame, session: str = "session_id", seq: str = "seq",
                chunk: str = "chunk", skew_safe: bool = False, ts: str | None = None) -> DataFrame:
    """``(session, line_no, line, terminated)`` for the session's stream.

    ``terminated`` is false only for a session's last line when no newline
    has arrived after it yet.  With ``ts``, the arrival time of the chunks, a
    line also has its ``parts`` in order (array of s, t, at) and ``ended_at``,
    when its newline arrived.  ``skew_safe`` computes the running newline
    count with ``keyed_prefix_sum`` so one huge session is spread over many
    tasks (two shuffles instead of one)."""
    c = chunks.withColumn("_pieces", F.split(F.coalesce(F.col(chunk), F.lit("")), "\n", -1))
    if skew_safe:
        c = keyed_prefix_sum(c, session, [seq], F.size("_pieces") - 1, "_nb")
    else:
        before = Window.partitionBy(session).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
        c = c.withColumn("_nb", F.coalesce(F.sum(F.size("_pieces") - 1).over(before), F.lit(0)))
    at = [] if ts is None else [F.col(ts).alias("at")]
    p = c.select(session, seq, *at, "_nb", F.size("_pieces").alias("_np"),
                 F.posexplode("_pieces").alias("_j", "_piece"))
    p = p.withColumn("line_no", (F.col("_nb") + F.col("_j")).cast("bigint")) \
        .withColumn("_term", F.col("_j") < F.col("_np") - 1)
    part = F.struct(F.col(seq).alias("s"), F.col("_piece").alias("t"), *(F.col("at") for _ in at))
    lines = p.groupBy(session, "line_no").agg(
        F.array_sort(F.collect_list(part)).alias("parts"), F.max("_term").alias("terminated"),
        *(F.max(F.when(F.col("_term"), F.col("at"))).alias("ended_at") for _ in at))
    return lines.select(session, "line_no", F.array_join(F.transform("parts", lambda x: x["t"]), "").alias("line"),
                        "terminated", *(("parts", "ended_at") if at else ()))


def frame_lines(lines: DataFrame, session: str = "session_id", skew_safe: bool = False) -> DataFrame:
    """Attach ``record_no`` (complete marker lines before the line) and the
    marker flag to every line."""
    is_marker = F.col("line").rlike(MARKER_LINE_RE) & F.col("terminated")
    marked = lines.withColumn("is_marker", is_marker)
    if skew_safe:
        return keyed_prefix_sum(marked, session, ["line_no"], F.col("is_marker").cast("bigint"), "record_no") \
            .withColumn("record_no", F.col("record_no").cast("bigint"))
    w = Window.partitionBy(session).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    return marked.withColumn("record_no", F.coalesce(F.count_if(F.col("is_marker")).over(w), F.lit(0)).cast("bigint"))


def frame_commands(chunks: DataFrame, session: str = "session_id", seq: str = "seq",
                   chunk: str = "chunk", skew_safe: bool = False) -> DataFrame:
    """One row per finished command: ``(session, record_no, output, exit_code)``.

    In ``skew_safe`` mode the reassembled lines feed a sampling job and two plan
    branches, so they are written once to the shared checkpoint folder
    (``checkpoint()``) instead of being rebuilt for each use."""
    lines = chunk_lines(chunks, session, seq, chunk, skew_safe)
    if skew_safe:
        from drover.session import checkpoint_root
        checkpoint_root(lines.sparkSession)  # the setting from the session, or a private one
        lines = lines.checkpoint(eager=True)
    framed = frame_lines(lines, session, skew_safe)
    body = F.when(F.col("is_marker"),
                  F.regexp_extract("line", "(?s)^(.*?)" + MARKER_LINE_RE, 1)).otherwise(F.col("line"))
    # the unfinished tail goes before anything is gathered, however long it is
    if skew_safe:
        closed = framed.filter("is_marker").select(session, "record_no")
        framed = framed.join(closed, [session, "record_no"], "left_semi")
    else:
        n_closed = F.count_if("is_marker").over(Window.partitionBy(session))
        framed = framed.withColumn("_closed", n_closed).filter(F.col("record_no") < F.col("_closed"))
    recs = framed.groupBy(session, "record_no").agg(
        F.max(F.when(F.col("is_marker"), T.marker_exit_code("line"))).alias("exit_code"),
        F.array_sort(F.collect_list(F.struct("line_no", body.alias("b")))).alias("_b"))
    return recs.select(
        session, "record_no", F.array_join(F.transform("_b", lambda x: x["b"]), "\n").alias("output"),
        "exit_code")


def pending_commands(chunks: DataFrame, session: str = "session_id", seq: str = "seq",
                     chunk: str = "chunk") -> DataFrame:
    """Per session: finished commands and the size of the unfinished tail
    (text after the last complete marker line)."""
    framed = frame_lines(chunk_lines(chunks, session, seq, chunk), session)
    # the last record of a session is the unfinished tail; a window over the
    # session (same partitioning as the framing) finds it without a join
    last_rec = F.max("record_no").over(Window.partitionBy(session))
    in_tail = (F.col("record_no") == F.col("_last_rec")) & ~F.col("is_marker")
    per = framed.withColumn("_last_rec", last_rec).groupBy(session).agg(
        F.count_if("is_marker").alias("n_finished"),
        F.sum(F.when(in_tail, F.length("line"))).alias("_chars"),
        F.count_if(in_tail).alias("_lines"))
    tail_chars = F.when(F.col("_lines") > 0, F.col("_chars") + F.col("_lines") - 1).otherwise(F.lit(0))
    return per.select(session, "n_finished", tail_chars.cast("bigint").alias("tail_chars"),
                      (tail_chars > 0).alias("has_pending"))


def command_timeouts(chunks: DataFrame, limit_s: float = 10.0, session: str = "session_id",
                     seq: str = "seq", ts: str = "ts", chunk: str = "chunk", until=None,
                     skew_safe: bool = False) -> DataFrame:
    """Batch form of T3 over timestamped chunks:
    ``(session, record_no, output, exit_code, timed_out)``.

    A command starts when the one before it ended (the first at the session's
    first chunk) and ends when the chunk that completes its marker line arrives.
    If that is more than ``limit_s`` after the start, or the marker has not come
    by then at all, the command is a failure without exit code, and its output
    is the first 500 characters of what arrived by the deadline, up to a marker
    begun by then; later text is stale and dropped.  A session's unfinished tail
    is a command if it holds any text, and a failure once the observation has
    passed its deadline: at ``until`` (a timestamp or column; null or not given:
    the session's last chunk).  A tail within its limit is still running and has
    no row.

    Deadlines are joined to lines on (session, record); of a failed command
    only the lines that can reach the 500 characters are gathered, however long
    it went on."""
    lines = chunk_lines(chunks, session, seq, chunk, skew_safe, ts)
    if skew_safe:
        from drover.session import checkpoint_root
        checkpoint_root(lines.sparkSession)
        lines = lines.checkpoint(eager=True)
    framed = frame_lines(lines, session, skew_safe)
    recs = framed.groupBy(session, "record_no").agg(
        F.max(F.when(F.col("is_marker"), F.col("ended_at"))).alias("end_ts"),
        F.max(F.when(F.col("is_marker"), T.marker_exit_code("line"))).alias("exit_code"),
        F.min("line_no").alias("first_line"), F.max(F.length("line") > 0).alias("has_text"))
    seen = chunks.groupBy(session).agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))
    before = F.lag("end_ts").over(Window.partitionBy(session).orderBy("record_no"))
    recs = recs.join(seen, session).withColumn("start", F.coalesce(before, F.col("first_ts")))
    recs = recs.withColumn("deadline", F.col("start") + F.make_dt_interval(secs=F.lit(float(limit_s))))
    now = F.col("last_ts") if until is None else F.coalesce(until if isinstance(until, Column) else F.lit(until).cast("timestamp"),
                                                            F.col("last_ts"))
    running = F.col("end_ts").isNull()
    recs = recs.withColumn("timed_out", F.when(running, F.col("has_text") & (now > F.col("deadline")))
                           .otherwise(F.col("end_ts") > F.col("deadline"))) \
        .filter(~running | F.col("timed_out")) \
        .select(session, "record_no", "timed_out", "deadline", "first_line",
                F.when(~F.col("timed_out"), F.col("exit_code")).alias("exit_code"))
    # every arrived line has a character at least, its newline
    room = T.ERROR_TEXT_LIMIT + MARKER_ROOM
    x = framed.join(recs, [session, "record_no"]) \
        .filter(~F.col("timed_out") | (F.col("line_no") < F.col("first_line") + room))
    body = F.when(F.col("is_marker"),
                  F.regexp_extract("line", "(?s)^(.*?)" + MARKER_LINE_RE, 1)).otherwise(F.concat("line", F.lit("\n")))
    come = F.array_join(F.transform(F.filter("parts", lambda p: p["at"] <= F.col("deadline")), lambda p: p["t"]), "")
    newline = F.when(F.col("ended_at") <= F.col("deadline"), F.lit("\n")).otherwise(F.lit(""))
    text = F.when(F.col("timed_out"), F.concat(F.substring(come, 1, room), newline)).otherwise(body)
    out = x.groupBy(session, "record_no", "exit_code", "timed_out").agg(
        F.array_sort(F.collect_list(F.struct("line_no", text.alias("b")))).alias("_b"))
    whole = F.array_join(F.transform("_b", lambda b: b["b"]), "")
    cut = T.truncate_error(F.regexp_replace(whole, "(?s)" + MARKER_LINE_RE + ".*$", ""))
    return out.select(session, "record_no", F.when(F.col("timed_out"), cut).otherwise(whole).alias("output"),
                      "exit_code", "timed_out")
