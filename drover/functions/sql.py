"""U3: the column rules as SQL functions, for ``spark.sql`` users.

Rules with a native form are registered as SQL functions (their bodies are
SQL expressions, so they are inlined and optimised like built-ins); only the
Python syntax check is a (pandas) UDF.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from drover.functions import text as T


def _raw(s: str) -> str:
    if "'" in s:
        raise ValueError("pattern contains a quote")
    return "r'" + s + "'"


def _lit(s: str) -> str:
    return "'" + "".join("\\u%04x" % ord(c) if not (32 <= ord(c) < 127) or c in "'\\" else c for c in s) + "'"


def _let(value: str, name: str, body: str) -> str:
    """``body`` with ``value`` evaluated once under ``name``."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


_WS = _lit(T.PY_WHITESPACE)


def _strip(x: str) -> str:
    return f"btrim({x}, {_WS})"


def _dedent(x: str) -> str:
    """Blank lines emptied, then the indentation common to the others cut: what
    its smallest and its largest share, all of them share."""
    lines = f"transform(split({x}, '\\n', -1), l -> CASE WHEN l RLIKE r'^[ \\t]+\\z' THEN '' ELSE l END)"
    indents = "transform(filter(lines, l -> l <> ''), l -> regexp_extract(l, r'^([ \\t]*)', 1))"
    same = "transform(sequence(1, greatest(least(length(lo), length(hi)), 1)), i -> substr(lo, i, 1) = substr(hi, i, 1))"
    shared = ("CASE WHEN least(length(lo), length(hi)) <= 0 THEN 0 WHEN array_position(" + same + ", false) = 0 "
              "THEN least(length(lo), length(hi)) ELSE array_position(" + same + ", false) - 1 END")
    cut = _let(indents, "ind", _let("array_min(ind)", "lo", _let("array_max(ind)", "hi", shared)))
    body = _let(f"coalesce({cut}, 0)", "k", "array_join(transform(lines, l -> substr(l, CAST(k + 1 AS INT))), '\\n')")
    return f"CASE WHEN {x} IS NOT NULL THEN {_let(lines, 'lines', body)} END"


def _fence_or_all(x: str, pattern: str, found: str = "{}") -> str:
    body = found.format(f"regexp_extract(c, {_raw(pattern)}, 1)")
    return _let(x, "c", f"CASE WHEN c RLIKE {_raw(pattern)} THEN {body} ELSE c END")


def _last_command(x: str) -> str:
    return _strip(f"try_element_at(regexp_extract_all({x}, {_raw(T.COMMAND_RE)}, 1), -1)")


def _action_type(x: str) -> str:
    return (f"CASE WHEN {x} IS NULL THEN 'invalid' WHEN {x} RLIKE {_raw(T.DONE_RE)} THEN 'done' "
            f"WHEN {_last_command(x)} IS NULL THEN 'invalid' WHEN lower({_last_command(x)}) = 'done' THEN 'done' ELSE 'command' END")


def _noise(x: str) -> str:
    return f"regexp_replace({x}, {_raw(T.shell_noise_pattern())}, '')"


def _ansi(x: str) -> str:
    return f"replace(regexp_replace({x}, {_raw(T.ANSI_RE)}, ''), '\\r', '')"


def _collapsed(x: str) -> str:
    return _strip(f"regexp_replace({x}, {_raw(chr(92) + 'n{3,}')}, '\\n\\n')")


def _truncated(x: str) -> str:
    head, tail = T.TRUNCATION_NOTE.split("{length}")
    limit = T.MAX_OUTPUT_LENGTH
    note = f"concat({_lit(head.format(limit=limit))}, CAST(length({x}) AS STRING), {_lit(tail)})"
    return f"concat(substr({x}, 1, {limit}), CASE WHEN length({x}) > {limit} THEN {note} ELSE '' END)"


def _home_mode(result: str) -> str:
    """``result`` over a definition's lines, its %post line and the next header."""
    post = "array_position(transform(lines, l -> contains(l, '%') AND contains(lower(l), 'post')), true)"
    nxt = "array_position(transform(lines, (l, i) -> i + 1 > post AND contains(l, '%')), true)"
    status = (f"CASE WHEN contains(d, {_lit(T.HOME_MODE_LINE.strip())}) THEN 'unchanged' "
              "WHEN post = 0 OR nxt = 0 THEN 'unpatchable' ELSE 'changed' END")
    body = _let("split(d, '\\n', -1)", "lines", _let(post, "post", _let(nxt, "nxt", _let(status, "status", result))))
    return f"CASE WHEN d IS NOT NULL THEN {body} END"


def _decision() -> str:
    """The strict decision object, or a struct of nulls that is not valid."""
    has = lambda k: f"array_contains(keys, '{k}')"
    kind = lambda k: f"schema_of_variant(try_variant_get(v, '$.{k}', 'variant'))"
    told = "trim(try_variant_get(v, '$.timeout_sec', 'string'))"
    number = (f"({kind('timeout_sec')} RLIKE '^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL.*)$' OR ({kind('timeout_sec')} = 'STRING' "
              f"AND {told} RLIKE r'^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$'))")
    allowed = ", ".join(f"'{k}'" for k in ("type", "command", "timeout_sec"))
    kinds = ", ".join(f"'{t}'" for t in ("command", "done", "invalid"))
    valid = (f"coalesce(keys IS NOT NULL AND size(array_except(keys, array({allowed}))) = 0 AND {has('type')} "
             f"AND {kind('type')} = 'STRING' AND try_variant_get(v, '$.type', 'string') IN ({kinds}) "
             f"AND (NOT {has('command')} OR {kind('command')} IN ('STRING', 'VOID')) "
             f"AND (NOT {has('timeout_sec')} OR {number} OR {kind('timeout_sec')} = 'VOID'), false)")
    wait = f"CASE WHEN NOT {has('timeout_sec')} THEN {T.DECISION_DEFAULT_TIMEOUT}D ELSE try_cast({told} AS DOUBLE) END"
    out = ("named_struct('valid', ok, 'type', CASE WHEN ok THEN try_variant_get(v, '$.type', 'string') END, 'command', "
           f"CASE WHEN ok THEN try_variant_get(v, '$.command', 'string') END, 'timeout_sec', CASE WHEN ok THEN {wait} END)")
    return _let("try_parse_json(j)", "v", _let("json_object_keys(j)", "keys", _let(valid, "ok", out)))


def sql_functions() -> dict[str, str]:
    """name -> ``CREATE TEMPORARY FUNCTION`` statement."""
    e, a, limit = "lower(error)", "attempt", T.GENERATE_MAX_RETRIES - 1
    waits = (f"CASE WHEN error IS NULL THEN NULL WHEN policy = 'generate' AND {a} < {limit} THEN CASE WHEN contains({e}, 'rate') "
             f"THEN least(pow(2D, {a} + 2), {T.RATE_LIMIT_WAIT_CAP}D) WHEN contains({e}, 'timeout') THEN {T.TIMEOUT_WAIT}D ELSE pow(2D, {a}) END "
             f"WHEN policy = 'convert' AND {a} < {T.CONVERT_MAX_RETRIES - 1} AND (contains({e}, 'rate') OR contains({e}, '429') "
             f"OR contains({e}, 'overloaded')) THEN {T.CONVERT_BASE_DELAY}D * pow(2D, {a}) "
             "WHEN policy IN ('generate', 'convert') THEN NULL ELSE raise_error(concat('unknown retry policy ', policy)) END")
    shown = "CASE WHEN NOT binary_exit THEN exit_code WHEN exit_code = 0 THEN 0 ELSE 1 END"
    seen = f"concat({_truncated('coalesce(output, ' + chr(39) * 2 + ')')}, '\\n\\n(exit_code=', CAST({shown} AS STRING), ')')"
    fence = ("concat('(?s)```(?:\\\\Q', tag, '\\\\E|\\\\Q', upper(substr(tag, 1, 1)), substr(tag, 2), '\\\\E)[^\\n]*\\n(.*?)```')")
    rest = "slice(split(s, '\\n', -1), 2, greatest(size(split(s, '\\n', -1)), 1))"
    bare = _strip(_let(rest, "r", "array_join(CASE WHEN coalesce(" + _strip("try_element_at(r, -1)")
                       + " = '```', false) THEN slice(r, 1, greatest(size(r) - 1, 0)) ELSE r END, '\\n')"))
    fenced = _let(_strip("raw"), "s", f"CASE WHEN s RLIKE {fence} THEN {_strip(f'regexp_extract(s, {fence}, 1)')} "
                  f"WHEN startswith(s, '```') THEN {bare} ELSE s END")
    code = _let("line", "l",
                f"CASE WHEN l RLIKE {_raw(T.MARKER_RE + '[^:]*' + chr(92) + 'z')} THEN try_cast("
                f"{_strip('regexp_extract(l, ' + _raw(T.MARKER_RE + '([^:]*)' + chr(92) + 'z') + ', 1)')} AS INT) END")
    blocks = (f"concat({_lit(T.HISTORY_HEADER)}, array_join(transform(array_sort(blocks), x -> x.b), {_lit(T.HISTORY_SEPARATOR)}), "
              f"{_lit(T.HISTORY_FOOTER)})")
    picked = "element_at(options, CAST(CAST(conv(substr(md5(concat_ws(':', CAST(seed AS STRING), key)), 1, 8), 16, 10) AS BIGINT) % size(options) + 1 AS INT))"
    body = {
        # F0, F12
        "py_strip": ("s STRING", "STRING", _strip("s")),
        "py_rstrip": ("s STRING", "STRING", f"rtrim({_WS}, s)"),
        "is_blank": ("s STRING", "BOOLEAN", f"coalesce({_strip('s')} = '', true)"),
        "dedent": ("s STRING", "STRING", _dedent("s")),
        # F1-F5
        "template_description": ("raw STRING", "STRING", _strip(f"regexp_extract(raw, {_raw(T.TASK_RE)}, 1)")),
        "template_truth": ("raw STRING", "STRING", _strip(f"regexp_extract(raw, {_raw(T.TRUTH_RE)}, 1)")),
        "extract_python_code": ("raw STRING", "STRING", f"rtrim({_WS}, {_let(_fence_or_all(_dedent('raw'), T.PY_FENCE_RE), 't', _dedent('t'))})"),
        "extract_def_text": ("raw STRING", "STRING", _strip(_let(_fence_or_all(
            _strip("replace(raw, '\\r\\n', '\\n')"), T.DEF_FENCE_RE, _strip("{}")), "t", _dedent("t")))),
        "extract_fenced_block": ("raw STRING, tag STRING", "STRING", fenced),
        # F6, F19
        "action_type": ("s STRING", "STRING", _action_type("s")),
        "action_command": ("s STRING", "STRING", f"CASE WHEN {_action_type('s')} = 'command' THEN {_last_command('s')} END"),
        "extract_action": ("s STRING", "STRUCT<type: STRING, command: STRING>", f"named_struct('type', {_action_type('s')}, "
                           f"'command', CASE WHEN {_action_type('s')} = 'command' THEN {_last_command('s')} END)"),
        "is_heredoc": ("c STRING", "BOOLEAN", "contains(c, '<<')"),
        # F7-F11
        "strip_ansi": ("s STRING", "STRING", _ansi("s")),
        "strip_shell_noise": ("s STRING", "STRING", _noise("s")),
        "collapse_blank_lines": ("s STRING", "STRING", _collapsed("s")),
        "clean_output": ("s STRING", "STRING", _collapsed(_noise(_ansi("s")))),
        "truncate_output": ("s STRING", "STRING", _truncated("s")),
        "format_observation": ("kind STRING, exit_code INT, output STRING, binary_exit BOOLEAN", "STRING",
                               f"CASE kind WHEN 'command' THEN concat(CASE WHEN exit_code = 0 THEN {_lit(T.OBS_OK)} ELSE {_lit(T.OBS_FAIL)} END, "
                               f"{seen}) WHEN 'invalid' THEN {_lit(T.OBS_INVALID)} END"),
        # F13-F17, F25
        "log_reward_text": ("log STRING", "STRING", f"nullif(regexp_extract(log, {_raw(T.REWARD_RE)}, 1), '')"),
        "log_errors": ("log STRING", "INT", f"try_cast(nullif(regexp_extract(log, {_raw(T.ERRORS_RE)}, 1), '') AS INT)"),
        "detect_oom": ("line STRING", "BOOLEAN", f"lower(line) RLIKE {_raw(T.oom_pattern())}"),
        "classify_exit": ("code INT", "STRING",
                          "CASE WHEN code IS NULL THEN 'timeout' WHEN code = 0 THEN 'ok' "
                          "WHEN code = 137 THEN 'oom_killed' ELSE 'failed' END"),
        "truncate_error": ("s STRING", "STRING", f"substr(s, 1, {T.ERROR_TEXT_LIMIT})"),
        "api_error_class": ("error STRING", "STRING", f"CASE WHEN error IS NULL THEN 'ok' WHEN contains({e}, 'rate') THEN 'rate_limit' "
                            f"WHEN contains({e}, 'timeout') THEN 'timeout' ELSE 'other' END"),
        "planned_wait": ("error STRING, attempt INT, policy STRING", "DOUBLE", waits),
        "parse_from_line": ("line STRING", "STRING",
                            f"nullif(regexp_extract({_strip('line')}, {_raw(T.FROM_RE)}, 1), '')"),
        # F18, F20-F24, F26, F27
        "home_mode_status": ("d STRING", "STRING", _home_mode("status")),
        "patch_home_mode": ("d STRING", "STRING", _home_mode(
            "CASE status WHEN 'unchanged' THEN d WHEN 'changed' THEN array_join(concat(slice(lines, 1, CAST(greatest(nxt - 1, 0) AS INT)), "
            f"array({_lit(T.HOME_MODE_LINE)}), slice(lines, CAST(greatest(nxt, 1) AS INT), size(lines))), '\\n') END")),
        "marker_exit_code": ("line STRING", "INT", code),
        "task_name": ("key STRING, idx INT", "STRING",
                      "format_string('task_%06d_%s', idx, substr(sha2(key, 256), 1, 8))"),
        "image_name": ("name STRING", "STRING",
                       f"concat('{T.IMAGE_PREFIX}', replace(lower(name), '_', '-'))"),
        "history_text": ("blocks ARRAY<STRUCT<n: BIGINT, b: STRING>>", "STRING", blocks),
        "parse_decision": ("j STRING", "STRUCT<valid: BOOLEAN, type: STRING, command: STRING, timeout_sec: DOUBLE>", _decision()),
        "cast_max_time": ("v STRING", "INT", f"CASE WHEN v IS NULL THEN {T.DEFAULT_MAX_TIME} "
                          "ELSE try_cast(v AS INT) END"),
        "hash_pick": ("options ARRAY<STRING>, seed INT, key STRING", "STRING", picked),
        "whitespace_tokens": ("s STRING", "INT", f"coalesce(size(filter(split(s, {_raw(T.WS + '+')}, -1), x -> x <> '')), 0)"),
    }
    return {name: f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {ret} RETURN {expr}"
            for name, (args, ret, expr) in body.items()}


def register_sql_functions(spark: SparkSession) -> list[str]:
    """Register every rule as a session SQL function; returns their names."""
    from drover.operators.extract import python_compiles
    names = []
    for name, stmt in sql_functions().items():
        spark.sql(stmt)
        names.append(name)
    spark.udf.register("python_compiles", python_compiles)
    from drover.streaming.udtf import FrameCommands
    spark.udtf.register("frame_commands", FrameCommands)
    return names + ["python_compiles", "frame_commands"]
