"""Every SQL function equals its Column builder."""

import pytest
from pyspark.sql import functions as F

from drover.functions import text as T
from drover.functions.sql import register_sql_functions, sql_functions
from drover.operators import extract as X
from drover.operators import trajectory as TR

TEXTS = [None, "", "   ", " x\xa0\n", "<task> a\nb </task> mid <truth> c </truth>", "    a = 1\n  \t\n      b = 2\n    c", "\ta\n  b", "  a\n  b\n",
         "Intro\n```python\n    x = 1\n    y = 2\n```\nOutro", "```\nz\n```", "```Dockerfile\nFROM a\nRUN b\n```", "```dockerfile x\nFROM c\n```\nrest",
         "```sh\nls\n```", "```sh\nls", "a\r\nb\r\n```def\n  From: x\n```", "<command> ls -l </command>", "<command>a</command><COMMAND> DONE </COMMAND>",
         "<action> done </action>", "cat <<EOF", "\x1b[31mred\x1b[0m\r\nbash: no job control in this shell\n\n\n\nend  ", "y" * 60_000,
         "│ Mean │ 0.5 │\n│ Errors │ 3 │", "Mean 9.9", "Process was Killed (out of memory)", "  FROM ubuntu:22.04 AS x", "from  b",
         "Bootstrap: x\n%post\n    echo\n%environment\n  A=1", "%post\n chmod 755 /home/user\n%runscript", "%post only", "none",
         "__CMD_DONE__ab12__: 7 ", "__CMD_DONE__ab12__:x", "out__CMD_DONE__0__:-1", "__CMD_DONE__ab__:1:2", "Rate limit 429", "Request TIMEOUT",
         "server overloaded", "bad", "12", "soon", '{"type":"done"}', '{"type":"command","command":"ls","timeout_sec":" 7.5 "}',
         '{"type":"command","extra":1}', '{"type":"done","timeout_sec":"soon"}', '{"type":5}', '{"type":"invalid","timeout_sec":null}', "[1]"]


@pytest.fixture(scope="module")
def rows(spark):
    register_sql_functions(spark)
    codes = [None, 0, 1, 137]
    df = spark.createDataFrame([(i, t, codes[i % 4], i % 6, ["command", "invalid", "done"][i % 3]) for i, t in enumerate(TEXTS)],
                               "id int, s string, code int, a int, kind string")
    df.createOrReplaceTempView("rule_rows")
    return df


PAIRS = {
    "py_strip(s)": lambda: T.py_strip("s"), "py_rstrip(s)": lambda: T.py_rstrip("s"), "is_blank(s)": lambda: T.is_blank("s"), "dedent(s)": lambda: T.dedent("s"),
    "template_description(s)": lambda: T.template_description("s"), "template_truth(s)": lambda: T.template_truth("s"),
    "extract_python_code(s)": lambda: T.extract_python_code("s"), "extract_def_text(s)": lambda: T.extract_def_text("s"),
    "extract_fenced_block(s, 'dockerfile')": lambda: T.extract_fenced_block("s", "dockerfile"), "extract_fenced_block(s, 'sh')": lambda: T.extract_fenced_block("s", "sh"),
    "action_type(s)": lambda: T.action_type("s"), "action_command(s)": lambda: T.action_command("s"), "extract_action(s)": lambda: T.extract_action("s"),
    "is_heredoc(s)": lambda: T.is_heredoc("s"), "strip_ansi(s)": lambda: T.strip_ansi("s"), "strip_shell_noise(s)": lambda: T.strip_shell_noise("s"),
    "collapse_blank_lines(s)": lambda: T.collapse_blank_lines("s"), "clean_output(s)": lambda: T.clean_output("s"), "truncate_output(s)": lambda: T.truncate_output("s"),
    "format_observation(kind, code, s, false)": lambda: T.format_observation("kind", "code", "s"),
    "format_observation(kind, code, s, true)": lambda: T.format_observation("kind", "code", "s", binary_exit=True),
    "log_reward_text(s)": lambda: T.log_reward_text("s"), "log_errors(s)": lambda: T.log_errors("s"), "detect_oom(s)": lambda: T.detect_oom("s"),
    "classify_exit(code)": lambda: T.classify_exit("code"), "truncate_error(s)": lambda: T.truncate_error("s"), "api_error_class(s)": lambda: T.api_error_class("s"),
    "planned_wait(s, a, 'generate')": lambda: T.planned_wait("s", "a"), "planned_wait(s, a, 'convert')": lambda: T.planned_wait("s", "a", "convert"),
    "parse_from_line(s)": lambda: T.parse_from_line("s"), "home_mode_status(s)": lambda: T.home_mode_status("s"), "patch_home_mode(s)": lambda: T.patch_home_mode("s"),
    "marker_exit_code(s)": lambda: T.marker_exit_code("s"), "task_name(s, 3)": lambda: T.task_name("s", 3), "image_name(s)": lambda: T.image_name("s"),
    "cast_max_time(s)": lambda: T.cast_max_time("s"), "whitespace_tokens(s)": lambda: T.whitespace_tokens("s"),
    "hash_pick(array('p', 'q', 'r'), 42, s)": lambda: T.hash_pick(F.array(F.lit("p"), F.lit("q"), F.lit("r")), 42, "s"),
    "history_text(array(named_struct('n', 2L, 'b', s), named_struct('n', 1L, 'b', 'x')))": lambda: TR._history_text(F.array(
        F.struct(F.lit(2).cast("bigint").alias("n"), F.col("s").alias("b")), F.struct(F.lit(1).cast("bigint").alias("n"), F.lit("x").alias("b")))),
}


@pytest.mark.parametrize("call", sorted(PAIRS))
def test_sql_equals_columns(spark, rows, call):
    got = {r[0]: r[1] for r in spark.sql(f"SELECT id, {call} FROM rule_rows").collect()}
    want = {r[0]: r[1] for r in rows.select("id", PAIRS[call]()).collect()}
    assert got == want


def test_decisions_equal_the_operator(spark, rows):
    got = spark.sql("SELECT id, d.valid, d.type, d.command, d.timeout_sec FROM (SELECT id, parse_decision(s) AS d FROM rule_rows)").collect()
    want = X.parse_decisions(rows, "s").select("id", "valid", "type", "command", "timeout_sec").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and any(r.valid for r in got)


def test_every_function_is_compared():
    compared = {c.split("(")[0] for c in PAIRS} | {"parse_decision"}
    assert compared == set(sql_functions())


def test_unknown_policy_fails(spark, rows):
    with pytest.raises(Exception, match="unknown retry policy"):
        spark.sql("SELECT planned_wait('x', 0, 'never')").collect()
