"""Column builders for the text rules of the task and trajectory formats.

Every builder takes and returns a ``Column`` and is a composition of native
Spark SQL expressions (regex, string, array and higher-order functions), so it
stays inside whole-stage code generation.  No Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference behaviour).
# Whitespace as Python's ``str.strip()``/``str.split()`` see it: derived by
# rule from ``str.isspace`` rather than listed by hand.
PY_WHITESPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
# The same set as a regex character class, in the ``\x{..}`` form that both
# Java regex (Spark) and RE2 (the DuckDB oracle) accept.
WS_CHARS = "".join("\\x{%x}" % ord(c) for c in PY_WHITESPACE)
WS = "[" + WS_CHARS + "]"
NON_WS = "[^" + WS_CHARS + "]"

# Output limits.
MAX_OUTPUT_LENGTH = 50000
HISTORY_OUTPUT_LIMIT = 500
ERROR_TEXT_LIMIT = 500

# Observation sentences.
OBS_OK = "Command executed successfully. Output: "
OBS_FAIL = "Command failed. Output: "
OBS_ERROR = "Command failed with error: "
OBS_INVALID = ("Could not parse a single <command>...</command> or <action>done</action>. "
               "Please respond with exactly one of those.")
TRUNCATION_NOTE = "\n[Output truncated: showing first {limit} of {length} characters]"

# Shell start-up noise; each pattern removes a whole line's text (the newline stays).
SHELL_NOISE_LINES = [
    "bash: cannot set terminal process group",
    "bash: no job control in this shell",
    "mesg: ttyname failed:",
    "stdin: is not a tty",
    "the input device is not a TTY",
]
SHELL_NOISE_LINES_NOCASE = ["warning: TERM environment variable not set"]

# Lower-cased substrings that flag an out-of-memory build log line.
OOM_INDICATORS = ["out of memory", "oom", "cannot allocate memory", "killed",
                  "memory allocation failed", "enomem"]

# Command history summary frame.
HISTORY_HEADER = "Here is a summary of commands and outputs from your previous attempts:\n\n"
HISTORY_SEPARATOR = "\n\n---\n\n"
HISTORY_FOOTER = "\n\nPlease continue from where you left off."
HISTORY_CUT_MARK = "... [truncated]"

# Line added to container definitions and the image-name prefix.
HOME_MODE_LINE = "    chmod 755 /home/user"
IMAGE_PREFIX = "endless-task-"

# Retry policies of the two request clients.
GENERATE_MAX_RETRIES = 5
CONVERT_MAX_RETRIES = 5
CONVERT_BASE_DELAY = 10.0
RATE_LIMIT_WAIT_CAP = 30
TIMEOUT_WAIT = 2

DEFAULT_MAX_TIME = 600
DECISION_DEFAULT_TIMEOUT = 180.0

# Patterns (Java regex dialect; the oracle keeps its own RE2 copies).  Where
# Python's ``\s`` would differ from Java's, the Python whitespace class is used.
TASK_RE = r"(?s)<task>(.*?)</task>"
TRUTH_RE = r"(?s)<truth>(.*?)</truth>"
PY_FENCE_RE = r"(?is)```(?:python)?\n(.*?)```"
DEF_FENCE_RE = r"```(?:[a-zA-Z0-9_-]+)?\n([\s\S]*?)```"
DONE_RE = "(?i)<action>" + WS + "*done" + WS + "*</action>"
COMMAND_RE = "(?is)<command>" + WS + "*(.*?)" + WS + "*</command>"
ANSI_RE = r"\x1b\[[0-?]*[ -/]*[@-~]"
MARKER_RE = r"__CMD_DONE__[0-9a-f]+__:"
LINE_SPACE = r"[ \t\x0b\x0c\r]"
REWARD_RE = r"Mean[: \t\x0b\x0c\r│]+([0-9.]+)"
ERRORS_RE = "│ Errors" + LINE_SPACE + "+│" + LINE_SPACE + r"+([0-9]+)"
FROM_RE = "^(?i:FROM) " + WS + "*(" + NON_WS + "+)"
# ---------------------------------------------------------------------------


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _quote(s: str) -> str:
    return "".join("\\" + ch if ch in r"\.^$|?*+()[]{}" else ch for ch in s)


def shell_noise_pattern() -> str:
    """One multi-line alternation for all noise lines (Java: UNIX_LINES so only
    ``\\n`` ends a line, as in Python)."""
    alts = [_quote(p) for p in SHELL_NOISE_LINES]
    alts += ["(?i:" + _quote(p) + ")" for p in SHELL_NOISE_LINES_NOCASE]
    return "(?dm)^(?:" + "|".join(alts) + ").*$"


def oom_pattern() -> str:
    return "|".join(_quote(p) for p in OOM_INDICATORS)


# F0 -------------------------------------------------------------------------
def py_strip(c) -> Column:
    """Python ``str.strip()``."""
    return F.btrim(_c(c), F.lit(PY_WHITESPACE))


def py_rstrip(c) -> Column:
    return F.rtrim(_c(c), F.lit(PY_WHITESPACE))


def is_blank(c) -> Column:
    """True when null or empty after ``strip()`` (Python falsiness of the stripped text)."""
    return F.coalesce(py_strip(c) == F.lit(""), F.lit(True))


# F12 ------------------------------------------------------------------------
def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` as a lambda variable
    (a one-element ``transform``), so a sub-result used several times inside
    one expression is not recomputed."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _common_prefix_len(a: Column, b: Column) -> Column:
    n = F.least(F.length(a), F.length(b))
    same = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
                       lambda i: F.substring(a, i, 1) == F.substring(b, i, 1))
    pos = F.array_position(same, False)
    return F.when(n <= 0, F.lit(0)).when(pos == 0, n).otherwise(pos - 1)


def dedent(c) -> Column:
    """``textwrap.dedent``: lines of only spaces/tabs become empty, then the
    longest common leading run of spaces/tabs of the non-blank lines is cut."""
    lines0 = F.transform(F.split(_c(c), "\n", -1),
                         lambda l: F.when(l.rlike(r"^[ \t]+\z"), F.lit("")).otherwise(l))

    def with_lines(lines):
        indents = F.transform(F.filter(lines, lambda l: l != F.lit("")),
                              lambda l: F.regexp_extract(l, r"^([ \t]*)", 1))
        def cut(ind):
            return let(F.array_min(ind), lambda lo: let(F.array_max(ind), lambda hi: _common_prefix_len(lo, hi)))
        return let(F.coalesce(let(indents, cut), F.lit(0)),
                   lambda k: F.array_join(F.transform(lines, lambda l: F.substr(l, k + 1)), "\n"))

    return F.when(_c(c).isNotNull(), let(lines0, with_lines))


# F1 -------------------------------------------------------------------------
def template_description(raw) -> Column:
    return py_strip(F.regexp_extract(_c(raw), TASK_RE, 1))


def template_truth(raw) -> Column:
    return py_strip(F.regexp_extract(_c(raw), TRUTH_RE, 1))


# F2 -------------------------------------------------------------------------
def extract_python_code(raw) -> Column:
    """The reply is dedented, the first bare or ``python`` fence is taken (else
    the whole text), dedented again and right-stripped."""
    def pick(content):
        return F.when(content.rlike(PY_FENCE_RE), F.regexp_extract(content, PY_FENCE_RE, 1)).otherwise(content)
    return py_rstrip(let(let(dedent(raw), pick), dedent))


# F4 -------------------------------------------------------------------------
def extract_def_text(raw) -> Column:
    def pick(cleaned):
        return F.when(cleaned.rlike(DEF_FENCE_RE),
                      py_strip(F.regexp_extract(cleaned, DEF_FENCE_RE, 1))).otherwise(cleaned)
    return py_strip(let(let(py_strip(F.replace(_c(raw), F.lit("\r\n"), F.lit("\n"))), pick), dedent))


# F5 -------------------------------------------------------------------------
def extract_fenced_block(raw, tag: str = "dockerfile") -> Column:
    """Body of the first fence tagged ``tag`` (either capitalisation of its first
    letter); otherwise a reply that starts with a fence loses its first line and
    a closing fence line."""
    s = py_strip(_c(raw))
    spellings = "|".join(_quote(t) for t in sorted({tag, tag[:1].upper() + tag[1:]}))
    tagged = "(?s)```(?:" + spellings + ")[^\n]*\n(.*?)```"
    lines = F.split(s, "\n", -1)
    rest = F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1)))
    drop_last = F.coalesce(py_strip(F.try_element_at(rest, F.lit(-1))) == F.lit("```"), F.lit(False))
    body = F.when(drop_last, F.slice(rest, 1, F.greatest(F.size(rest) - 1, F.lit(0)))).otherwise(rest)
    generic = py_strip(F.array_join(body, "\n"))
    return (F.when(s.rlike(tagged), py_strip(F.regexp_extract(s, tagged, 1)))
            .when(s.startswith("```"), generic)
            .otherwise(s))


# F6 -------------------------------------------------------------------------
def last_command_body(raw) -> Column:
    return F.try_element_at(F.regexp_extract_all(_c(raw), F.lit(COMMAND_RE), 1), F.lit(-1))


def action_type(raw) -> Column:
    """``done`` if a done action appears anywhere, else the last ``<command>``
    body decides (``done`` body -> done), else ``invalid``."""
    raw = _c(raw)
    body = py_strip(last_command_body(raw))
    return (F.when(raw.isNull(), F.lit("invalid"))
            .when(raw.rlike(DONE_RE), F.lit("done"))
            .when(body.isNull(), F.lit("invalid"))
            .when(F.lower(body) == F.lit("done"), F.lit("done"))
            .otherwise(F.lit("command")))


def action_command(raw) -> Column:
    body = py_strip(last_command_body(raw))
    return F.when(action_type(raw) == F.lit("command"), body)


def extract_action(raw) -> Column:
    return F.struct(action_type(raw).alias("type"), action_command(raw).alias("command"))


# F7 - F10 ---------------------------------------------------------------------
def strip_ansi(c) -> Column:
    return F.replace(F.regexp_replace(_c(c), ANSI_RE, ""), F.lit("\r"), F.lit(""))


def strip_shell_noise(c) -> Column:
    return F.regexp_replace(_c(c), shell_noise_pattern(), "")


def collapse_blank_lines(c) -> Column:
    return py_strip(F.regexp_replace(_c(c), r"\n{3,}", "\n\n"))


def clean_output(c) -> Column:
    return collapse_blank_lines(strip_shell_noise(strip_ansi(c)))


def truncation_note(c, limit: int = MAX_OUTPUT_LENGTH) -> Column:
    c = _c(c)
    head, tail = TRUNCATION_NOTE.split("{length}")
    return F.when(F.length(c) > limit,
                  F.concat(F.lit(head.format(limit=limit)), F.length(c).cast("string"), F.lit(tail))) \
        .otherwise(F.lit(""))


def truncate_output(c, limit: int = MAX_OUTPUT_LENGTH) -> Column:
    """First ``limit`` characters followed by a note with the original length."""
    c = _c(c)
    return F.concat(F.substring(c, 1, limit), truncation_note(c, limit))


# F11 ------------------------------------------------------------------------
def format_observation(kind, exit_code, output, error=None,
                       limit: int = MAX_OUTPUT_LENGTH, binary_exit: bool = False,
                       done_text: str | None = None) -> Column:
    """Next user message after a step.  ``binary_exit`` reports 0/1 like the
    rollout loop; otherwise the true exit code like the benchmark agent."""
    kind, exit_code, output = _c(kind), _c(exit_code), F.coalesce(_c(output), F.lit(""))
    shown = F.when(exit_code == 0, F.lit(0)).otherwise(F.lit(1)) if binary_exit else exit_code
    tail = F.concat(truncate_output(output, limit), F.lit("\n\n(exit_code="),
                    shown.cast("string"), F.lit(")"))
    command_msg = F.when(exit_code == 0, F.concat(F.lit(OBS_OK), tail)) \
        .otherwise(F.concat(F.lit(OBS_FAIL), tail))
    if error is not None:
        command_msg = F.when(_c(error).isNotNull(),
                             F.concat(F.lit(OBS_ERROR), _c(error), F.lit("\n\n(exit_code=1)"))) \
            .otherwise(command_msg)
    return (F.when(kind == F.lit("command"), command_msg)
            .when(kind == F.lit("invalid"), F.lit(OBS_INVALID))
            .when(kind == F.lit("done"), F.lit(done_text)))


# F13 ------------------------------------------------------------------------
def log_reward_text(log) -> Column:
    return F.nullif(F.regexp_extract(_c(log), REWARD_RE, 1), F.lit(""))


def log_errors(log) -> Column:
    return F.nullif(F.regexp_extract(_c(log), ERRORS_RE, 1), F.lit("")).try_cast("int")


# F14 / F15 / F25 ---------------------------------------------------------------
def detect_oom(line) -> Column:
    return F.lower(_c(line)).rlike(oom_pattern())


def classify_exit(code) -> Column:
    code = _c(code)
    return (F.when(code.isNull(), F.lit("timeout"))
            .when(code == 0, F.lit("ok"))
            .when(code == 137, F.lit("oom_killed"))
            .otherwise(F.lit("failed")))


def truncate_error(c, limit: int = ERROR_TEXT_LIMIT) -> Column:
    return F.substring(_c(c), 1, limit)


# F16 ------------------------------------------------------------------------
def api_error_class(error) -> Column:
    e = F.lower(_c(error))
    return (F.when(e.isNull(), F.lit("ok"))
            .when(e.contains("rate"), F.lit("rate_limit"))
            .when(e.contains("timeout"), F.lit("timeout"))
            .otherwise(F.lit("other")))


def planned_wait(error, attempt, policy: str = "generate") -> Column:
    """Seconds slept before the next try; null when the error is final (or absent).

    ``generate``: rate -> min(2^(a+2), 30), timeout -> 2, other -> 2^a, five tries.
    ``convert``: only rate/429/overloaded are retried, after 10 * 2^a.
    """
    e, a = F.lower(_c(error)), _c(attempt)
    if policy == "generate":
        wait = (F.when(e.contains("rate"), F.least(F.pow(F.lit(2.0), a + 2), F.lit(float(RATE_LIMIT_WAIT_CAP))))
                .when(e.contains("timeout"), F.lit(float(TIMEOUT_WAIT)))
                .otherwise(F.pow(F.lit(2.0), a)))
        return F.when(e.isNotNull() & (a < GENERATE_MAX_RETRIES - 1), wait)
    if policy == "convert":
        retried = e.contains("rate") | e.contains("429") | e.contains("overloaded")
        return F.when(e.isNotNull() & retried & (a < CONVERT_MAX_RETRIES - 1),
                      F.lit(CONVERT_BASE_DELAY) * F.pow(F.lit(2.0), a))
    raise ValueError(f"unknown retry policy {policy!r}")


# F17 ------------------------------------------------------------------------
def parse_from_line(line) -> Column:
    return F.nullif(F.regexp_extract(py_strip(line), FROM_RE, 1), F.lit(""))


# F18 ------------------------------------------------------------------------
def _home_mode(defn: Column, body) -> Column:
    """Bind the lines, the ``%post`` header position and the next header
    position once, then build the status or the patched text from them."""
    lines0 = F.split(defn, "\n", -1)

    def with_lines(lines):
        post0 = F.array_position(F.transform(lines, lambda l: l.contains("%") & F.lower(l).contains("post")), True)
        return let(post0, lambda post: let(
            F.array_position(F.transform(lines, lambda l, i: (i + 1 > post) & l.contains("%")), True),
            lambda nxt: body(lines, post, nxt)))

    return let(lines0, with_lines)


def _status(defn: Column, post: Column, nxt: Column) -> Column:
    return (F.when(defn.isNull(), F.lit(None))
            .when(defn.contains(HOME_MODE_LINE.strip()), F.lit("unchanged"))
            .when((post == 0) | (nxt == 0), F.lit("unpatchable"))
            .otherwise(F.lit("changed")))


def home_mode_status(defn) -> Column:
    defn = _c(defn)
    return F.when(defn.isNotNull(), _home_mode(defn, lambda lines, post, nxt: _status(defn, post, nxt)))


def patch_home_mode(defn) -> Column:
    """Insert the home-directory chmod at the end of the ``%post`` section
    (before the next header line).  Texts that already have it are kept; texts
    without a ``%post`` section followed by another header give null."""
    defn = _c(defn)

    def body(lines, post, nxt):
        patched = F.array_join(F.concat(F.slice(lines, 1, F.greatest(nxt - 1, F.lit(0))),
                                        F.array(F.lit(HOME_MODE_LINE)),
                                        F.slice(lines, F.greatest(nxt, F.lit(1)), F.size(lines))), "\n")
        status = _status(defn, post, nxt)
        return F.when(status == "unchanged", defn).when(status == "changed", patched)

    return F.when(defn.isNotNull(), _home_mode(defn, body))


# F19 / F20 ----------------------------------------------------------------------
def is_heredoc(cmd) -> Column:
    return _c(cmd).contains("<<")


def marker_exit_code(line) -> Column:
    """Exit code of a ``<marker>:<code>`` line (null when the code is not an int)."""
    line = _c(line)
    code = F.regexp_extract(line, MARKER_RE + r"([^:]*)\z", 1)
    return F.when(line.rlike(MARKER_RE + r"[^:]*\z"), py_strip(code).try_cast("int"))


# F21 / F22 ----------------------------------------------------------------------
def task_name(key, idx=0) -> Column:
    return F.format_string("task_%06d_%s", F.lit(idx) if isinstance(idx, int) else _c(idx),
                           F.substring(F.sha2(_c(key).cast("string"), 256), 1, 8))


def image_name(name, prefix: str = IMAGE_PREFIX) -> Column:
    return F.concat(F.lit(prefix), F.replace(F.lower(_c(name)), F.lit("_"), F.lit("-")))


# F26 ------------------------------------------------------------------------
def cast_max_time(c, default: int = DEFAULT_MAX_TIME) -> Column:
    c = _c(c)
    return F.when(c.isNull(), F.lit(default)).otherwise(c.cast("string").try_cast("int"))


# F27 ------------------------------------------------------------------------
def hash_pick(options: Column, seed: int, *keys) -> Column:
    """Deterministic, repartition-safe uniform pick from an array column."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), *[_c(k).cast("string") for k in keys]))
    idx = F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") % F.size(options)
    return F.element_at(options, (idx + 1).cast("int"))


# Whitespace token counter (the default of the pluggable counter).
def whitespace_tokens(c) -> Column:
    return F.coalesce(F.size(F.filter(F.split(_c(c), WS + "+", -1), lambda x: x != F.lit(""))),
                      F.lit(0))
