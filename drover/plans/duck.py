"""DuckDB twins of the column rules, used only to write the oracle SQL.

Each helper returns a SQL expression string over the given SQL expression.
They restate the rules in DuckDB's dialect (RE2 regex, 1-based list lambdas)
independently of the Spark builders, so a query and its oracle are two
implementations of one specification.
"""

from __future__ import annotations

from drover.functions import text as T


def lit(s: str) -> str:
    """A DuckDB string literal; control and non-ASCII characters via chr()."""
    parts, run = [], []
    for ch in s:
        if 32 <= ord(ch) < 127:
            run.append("''" if ch == "'" else ch)
        else:
            if run:
                parts.append("'" + "".join(run) + "'")
                run = []
            parts.append(f"chr({ord(ch)})")
    if run or not parts:
        parts.append("'" + "".join(run) + "'")
    return parts[0] if len(parts) == 1 else "(" + " || ".join(parts) + ")"


def rx(pattern: str) -> str:
    """A regex literal (RE2 reads escapes itself; only quotes need doubling)."""
    return "'" + pattern.replace("'", "''") + "'"


WS_LIT = lit(T.PY_WHITESPACE)


def py_strip(x: str) -> str:
    return f"trim({x}, {WS_LIT})"


def py_rstrip(x: str) -> str:
    return f"rtrim({x}, {WS_LIT})"


def is_blank(x: str) -> str:
    return f"coalesce({py_strip(x)} = '', true)"


def dedent(x: str) -> str:
    lines = (f"list_transform(string_split({x}, chr(10)), lambda l: "
             f"CASE WHEN regexp_matches(l, '^[ \\t]+\\z') THEN '' ELSE l END)")
    indents = (f"list_transform(list_filter({lines}, lambda l: l <> ''), "
               f"lambda l: regexp_extract(l, '^([ \\t]*)', 1))")
    lo, hi = f"list_min({indents})", f"list_max({indents})"
    n = f"least(length({lo}), length({hi}))"
    cut = (f"coalesce(CASE WHEN {n} <= 0 THEN 0 ELSE coalesce(list_position(list_transform("
           f"range(1, {n} + 1), lambda i: substr({lo}, i, 1) = substr({hi}, i, 1)), false) - 1, {n}) END, 0)")
    return f"array_to_string(list_transform({lines}, lambda l: substr(l, {cut} + 1)), chr(10))"


def regexp_extract(x: str, pattern: str, group: int = 1) -> str:
    return f"regexp_extract({x}, {rx(pattern)}, {group})"


def rlike(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {rx(pattern)})"


def regexp_replace_all(x: str, pattern: str, repl: str) -> str:
    return f"regexp_replace({x}, {rx(pattern)}, {lit(repl)}, 'g')"


# RE2 forms of the patterns (no Java-only flags).
SHELL_NOISE_RE = T.shell_noise_pattern().replace("(?dm)", "(?m)")


def action_type(x: str) -> str:
    body = py_strip(f"regexp_extract_all({x}, {rx(T.COMMAND_RE)}, 1)[-1]")
    return (f"(CASE WHEN {x} IS NULL THEN 'invalid' WHEN {rlike(x, T.DONE_RE)} THEN 'done' "
            f"WHEN {body} IS NULL THEN 'invalid' WHEN lower({body}) = 'done' THEN 'done' "
            f"ELSE 'command' END)")


def action_command(x: str) -> str:
    body = py_strip(f"regexp_extract_all({x}, {rx(T.COMMAND_RE)}, 1)[-1]")
    return f"(CASE WHEN {action_type(x)} = 'command' THEN {body} END)"


def clean_output(x: str) -> str:
    s = f"replace({regexp_replace_all(x, T.ANSI_RE, '')}, chr(13), '')"
    s = regexp_replace_all(s, SHELL_NOISE_RE, "")
    s = regexp_replace_all(s, r"\n{3,}", "\n\n")
    return py_strip(s)


def truncate_output(x: str, limit: int = T.MAX_OUTPUT_LENGTH) -> str:
    head, tail = T.TRUNCATION_NOTE.split("{length}")
    return (f"(substr({x}, 1, {limit}) || CASE WHEN length({x}) > {limit} THEN "
            f"{lit(head.format(limit=limit))} || cast(length({x}) AS varchar) || {lit(tail)} ELSE '' END)")


def format_observation(kind: str, exit_code: str, output: str, limit: int = T.MAX_OUTPUT_LENGTH,
                       binary_exit: bool = False) -> str:
    out = f"coalesce({output}, '')"
    shown = f"(CASE WHEN {exit_code} = 0 THEN 0 ELSE 1 END)" if binary_exit else exit_code
    tail = f"{truncate_output(out, limit)} || {lit(chr(10) * 2 + '(exit_code=')} || cast({shown} AS varchar) || ')'"
    return (f"(CASE WHEN {kind} = 'command' THEN (CASE WHEN {exit_code} = 0 THEN {lit(T.OBS_OK)} "
            f"ELSE {lit(T.OBS_FAIL)} END) || {tail} WHEN {kind} = 'invalid' THEN {lit(T.OBS_INVALID)} END)")


def parse_from_line(x: str) -> str:
    return f"nullif({regexp_extract(py_strip(x), T.FROM_RE)}, '')"


def whitespace_tokens(x: str) -> str:
    return (f"coalesce(len(list_filter(regexp_split_to_array({x}, {rx(T.WS + '+')}), "
            f"lambda w: w <> '')), 0)")


def md5_pick(options: str, seed: int, *keys: str) -> str:
    key = " || ':' || ".join([lit(str(seed))] + [f"cast({k} AS varchar)" for k in keys])
    idx = f"(CAST('0x' || substr(md5({key}), 1, 8) AS BIGINT) % len({options}))"
    return f"{options}[{idx} + 1]"
