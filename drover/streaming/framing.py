"""T2/T3: command framing on a live stream of terminal chunks.

State per session holds only the unfinished tail (text after the last
complete marker line), out-of-order chunks waiting for a gap to fill, and a
record counter.  A chunk completes every marker line it terminates; each
complete marker line emits one record.  With a command timeout, a command has
one deadline, counted from its first output: without a marker by then it emits a
failure record with the first 500 characters of what had come (up to a marker
that has begun), and the rest of its output is dropped up to and including its marker line.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from drover.functions import text as T

OUTPUT_SCHEMA = "session_id BIGINT, record_no BIGINT, output STRING, exit_code INT, timed_out BOOLEAN"
STATE_SCHEMA = ("next_seq BIGINT, tail STRING, record_no BIGINT, started_ms BIGINT, late BOOLEAN, "
                "p_seq ARRAY<BIGINT>, p_chunk ARRAY<STRING>")

_MARKER = re.compile(T.MARKER_RE)
_PREFIX = re.compile("^(.*?)" + T.MARKER_RE, re.S)
_CODE = re.compile(T.MARKER_RE + r"([^:]*)\Z")
_INT = re.compile(r"^[+-]?[0-9]+$")
_INT_MIN, _INT_MAX = -(2 ** 31), 2 ** 31 - 1


def parse_exit_code(line: str):
    """Text after the marker's last ``:``; an int or None (same rule as the
    column function ``marker_exit_code``)."""
    m = _CODE.search(line)
    if not m:
        return None
    code = m.group(1).strip(T.PY_WHITESPACE)
    if not _INT.match(code):
        return None
    v = int(code)
    return v if _INT_MIN <= v <= _INT_MAX else None


class Framer:
    """Text since the last complete marker line.  Lines are looked at once, when
    their newline comes; what is held are pieces, joined when a record ends."""

    def __init__(self, text: str = ""):
        at = text.rfind("\n") + 1
        self.lines = [text[:at]] if at else []  # without a marker
        self.partial = [text[at:]] if at < len(text) else []

    def feed(self, chunk: str):
        """Records ``(output, exit code)`` that a chunk completes."""
        if "\n" not in chunk:
            if chunk:
                self.partial.append(chunk)
            return
        head, *rest = chunk.split("\n")
        rest = ["".join([*self.partial, head]), *rest]
        last = rest.pop()
        self.partial = [last] if last else []
        for line in rest:
            if _MARKER.search(line):
                body = "".join([*self.lines, _PREFIX.match(line).group(1)])
                self.lines = []
                yield body, parse_exit_code(line)
            else:
                self.lines.append(line + "\n")

    def text(self) -> str:
        return "".join([*self.lines, *self.partial])

    def drop_lines(self) -> None:
        """Forget complete lines: a marker can only come on the last one."""
        self.lines = []


def split_records(text: str):
    """Complete records in ``text`` and the remaining unfinished text."""
    framer = Framer()
    return list(framer.feed(text)), framer.text()


def _cut(text: str) -> str:
    """What came before a marker that has begun."""
    m = _MARKER.search(text)
    return text[:m.start()] if m else text


def _record(session, rec: int, body: str, code, timed_out: bool) -> dict:
    return {"session_id": session, "record_no": rec, "output": body, "exit_code": code, "timed_out": timed_out}


def _framing_fn(timeout_ms: int | None, first_seq: int):
    def step(key, pdfs, state):
        (session,) = key
        now = state.getCurrentProcessingTimeMs()
        if state.exists:
            nxt, tail, rec, started, late, ps, pc = state.get
            pending = dict(zip(ps or [], pc or []))
        else:
            nxt, tail, rec, started, late, pending = first_seq, "", 0, None, False, {}
        out = []
        if timeout_ms is not None and started is not None and not late and now >= started + timeout_ms:
            out.append(_record(session, rec, _cut(tail)[:T.ERROR_TEXT_LIMIT], None, True))
            rec, late = rec + 1, True
        for pdf in pdfs:
            for s, c in zip(pdf["seq"], pdf["chunk"]):
                pending[int(s)] = "" if c is None else c
        new = []
        while nxt in pending:
            new.append(pending.pop(nxt))
            nxt += 1
        framer, ended = Framer(tail), False
        for chunk in new:
            for body, code in framer.feed(chunk):
                ended = True
                if late:  # the rest of a command that was given up
                    late = False
                    continue
                out.append(_record(session, rec, body, code, False))
                rec += 1
        if late:
            framer.drop_lines()
        tail = framer.text()
        if ended:
            started = None
        if tail and started is None:
            started = now
        elif not tail and not late:
            started = None
        ks = sorted(pending)
        state.update((nxt, tail, rec, started, late, ks, [pending[k] for k in ks]))
        if timeout_ms is not None and started is not None and not late:
            state.setTimeoutDuration(max(1, started + timeout_ms - now))  # one deadline per command
        if out:
            yield pd.DataFrame(out)

    return step


def stream_frame_commands(chunks: DataFrame, command_timeout_s: float | None = None,
                          first_seq: int = 0) -> DataFrame:
    """Records ``(session_id, record_no, output, exit_code, timed_out)`` from a
    stream of ``(session_id, seq, chunk)``; output mode ``append``.  With
    ``command_timeout_s`` the processing-time timeout of T3 applies."""
    timeout_ms = None if command_timeout_s is None else int(command_timeout_s * 1000)
    kind = GroupStateTimeout.NoTimeout if timeout_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    c = chunks.select(F.col("session_id").cast("bigint"), F.col("seq").cast("bigint"), "chunk")
    return c.groupBy("session_id").applyInPandasWithState(
        _framing_fn(timeout_ms, first_seq), OUTPUT_SCHEMA, STATE_SCHEMA, "append", kind)
