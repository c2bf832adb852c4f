"""Column rules on literal rows: the edge cases named in the survey."""

import math
import random
import textwrap

import pytest
from pyspark.sql import functions as F

from drover.functions import text as T


def one_col(spark, values, expr, typ="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {typ}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


def test_py_strip_matches_python(spark):
    vals = ["  a ", "\t\nb\x0b\x0c\r", "\xa0c　", "", "   ", None, "\x1cd\x1f", "f "]
    got = one_col(spark, vals, T.py_strip)
    assert got == [None if v is None else v.strip() for v in vals]


def test_dedent_matches_textwrap(spark):
    rnd = random.Random(7)
    pieces = ["", " ", "  ", "\t", " \t", "x", "y = 1", "    z", "\t\tq", "  \r", "#"]
    vals = ["\n".join(rnd.choice(pieces) + rnd.choice(pieces) for _ in range(rnd.randint(1, 6)))
            for _ in range(400)]
    vals += ["    a\n      b\n    c", "\ta\n\tb", " a\n\tb", "", "\n\n", "  \n  x\n"]
    got = one_col(spark, vals, T.dedent)
    assert got == [textwrap.dedent(v) for v in vals]


def test_extract_python_code(spark):
    vals = ["Intro\n```python\n    x = 1\n    y = 2\n```\nOutro",
            "```\ndef f(\n```",
            "```Python\na = 1\n```\n```python\nb = 2\n```",
            "z = 3\n\n",
            "```py\nq = 1\n```\nr = 2\n```\n",
            "   indented\n   code  "]
    expect = ["x = 1\ny = 2", "def f(", "a = 1", "z = 3", "r = 2", "indented\ncode"]
    assert one_col(spark, vals, T.extract_python_code) == expect


def test_template_parts(spark):
    raw = "note <task>\n  first \n</task> <truth> t1 </truth><task>second</task>"
    assert one_col(spark, [raw], T.template_description) == ["first"]
    assert one_col(spark, [raw], T.template_truth) == ["t1"]
    assert one_col(spark, ["<TASK>x</TASK>"], T.template_description) == [""]  # case-sensitive


@pytest.mark.parametrize("raw,kind,cmd", [
    ("<think>x</think><command> ls -la </command>", "command", "ls -la"),
    ("<command>a</command> then <COMMAND>\ncat f</COMMAND>", "command", "cat f"),   # last wins
    ("<action> Done </action><command>ls</command>", "done", None),                 # done wins
    ("<think><action>done</action></think>", "done", None),
    ("<command>DONE</command>", "done", None),
    ("<command></command>", "command", ""),                                         # empty stays a command
    ("no tags at all", "invalid", None),
    ("<command>unclosed", "invalid", None),
    ("<command> x </command>", "command", "x"),
])
def test_extract_action(spark, raw, kind, cmd):
    assert one_col(spark, [raw], T.action_type) == [kind]
    assert one_col(spark, [raw], T.action_command) == [cmd]


def test_clean_output(spark):
    raw = ("\x1b[31mred\x1b[0m\r\nbash: no job control in this shell\n\n\n\n"
           "WARNING: TERM environment variable not set x\nstdin: is not a tty\nend  ")
    # noise lines lose their text but keep their newline; 3+ newlines -> 2; stripped
    assert one_col(spark, [raw], T.clean_output) == ["red\n\nend"]
    # idempotent
    once = one_col(spark, [raw], T.clean_output)
    assert one_col(spark, once, T.clean_output) == once


def test_truncate_output_reports_original_length(spark):
    got = one_col(spark, ["abcdef", "ab"], lambda c: T.truncate_output(c, 3))
    assert got == ["abc\n[Output truncated: showing first 3 of 6 characters]", "ab"]
    assert one_col(spark, ["é" * 5], lambda c: T.truncate_output(c, 4)) == [
        "éééé\n[Output truncated: showing first 4 of 5 characters]"]


def test_format_observation(spark):
    df = spark.createDataFrame([("command", 0, "ok"), ("command", 2, "bad"), ("invalid", None, None),
                                ("done", None, None)], "k string, e int, o string")
    rows = df.select(T.format_observation("k", "e", "o").alias("a"),
                     T.format_observation("k", "e", "o", binary_exit=True).alias("b")).collect()
    assert rows[0].a == "Command executed successfully. Output: ok\n\n(exit_code=0)"
    assert rows[1].a == "Command failed. Output: bad\n\n(exit_code=2)"
    assert rows[1].b == "Command failed. Output: bad\n\n(exit_code=1)"
    assert rows[2].a == T.OBS_INVALID and rows[3].a is None


def test_benchmark_log_fields(spark):
    logs = ["start\n│ Mean │ 0.4 │\n│ Errors │ 2 │\nMean 9.9", "no result\nMean: 0.75", "nothing", "Mean\n0.5"]
    assert one_col(spark, logs, T.log_reward_text) == ["0.4", "0.75", None, None]
    assert one_col(spark, logs, T.log_errors) == [2, None, None, None]


def test_classify_and_oom(spark):
    assert one_col(spark, [0, 137, 1, None], T.classify_exit, "int") == ["ok", "oom_killed", "failed", "timeout"]
    lines = ["Killed", "the room is big", "ENOMEM here", "fine", "Cannot allocate memory"]
    assert one_col(spark, lines, T.detect_oom) == [True, True, True, False, True]


def test_retry_waits(spark):
    df = spark.createDataFrame([("Rate limit", 0), ("Rate limit", 3), ("read TIMEOUT", 1), ("boom", 2),
                                ("boom", 4), (None, 0), ("429 overloaded", 1), ("bad gateway", 0)],
                               "e string, a int")
    rows = df.select(T.api_error_class("e").alias("c"), T.planned_wait("e", "a").alias("w"),
                     T.planned_wait("e", "a", "convert").alias("w2")).collect()
    assert [r.c for r in rows] == ["rate_limit", "rate_limit", "timeout", "other", "other", "ok", "other", "other"]
    assert [r.w for r in rows] == [4.0, 30.0, 2.0, 4.0, None, None, 2.0, 1.0]
    assert [r.w2 for r in rows] == [10.0, 80.0, None, None, None, None, 20.0, None]


def test_from_line(spark):
    lines = ["FROM ubuntu:22.04", "  from python:3 AS build", "FROM", "RUN echo FROM x", "FROM\tx",
             "From  alpine  ", "FROMX y"]
    assert one_col(spark, lines, T.parse_from_line) == ["ubuntu:22.04", "python:3", None, None, None,
                                                        "alpine", None]


def test_home_mode_patch(spark):
    d = "Bootstrap: x\n%post\n    echo hi\n%environment\n    export A=1"
    got = one_col(spark, [d, d + "\nchmod 755 /home/user", "no sections", "%post\n  x"],
                  T.patch_home_mode)
    assert got[0] == "Bootstrap: x\n%post\n    echo hi\n    chmod 755 /home/user\n%environment\n    export A=1"
    assert got[1] == d + "\nchmod 755 /home/user"
    assert got[2] is None and got[3] is None
    assert one_col(spark, [d, "%post\n  x"], T.home_mode_status) == ["changed", "unpatchable"]


def test_marker_exit_code(spark):
    lines = ["__CMD_DONE__ab12__:0", "x__CMD_DONE__ff__: 137 ", "__CMD_DONE__ab__:", "__CMD_DONE__ab__:x",
             "plain"]
    assert one_col(spark, lines, T.marker_exit_code) == [0, 137, None, None, None]


def test_names(spark):
    import hashlib
    got = one_col(spark, ["k1"], lambda c: T.task_name(c))
    assert got == ["task_000000_" + hashlib.sha256(b"k1").hexdigest()[:8]]
    assert one_col(spark, ["Task_A_b"], T.image_name) == [T.IMAGE_PREFIX + "task-a-b"]


def test_cast_max_time(spark):
    assert one_col(spark, [None, "300", " 42 ", "x"], T.cast_max_time) == [600, 300, 42, None]


def test_whitespace_tokens(spark):
    vals = ["a b  c", "", "  ", None, "x y\nz"]
    assert one_col(spark, vals, T.whitespace_tokens) == [len((v or "").split()) for v in vals]


def test_extract_def_and_dockerfile(spark):
    raw = "Here:\r\n```def\r\n  Bootstrap: docker\r\n  From: ubuntu\r\n```\r\n"
    # the fence body is stripped before dedent, so only the first line loses its indent
    assert one_col(spark, [raw], T.extract_def_text) == ["Bootstrap: docker\n  From: ubuntu"]
    assert one_col(spark, ["```\n  a\n  b\n```"], T.extract_def_text) == ["a\n  b"]
    assert one_col(spark, ["  a\n  b"], T.extract_def_text) == ["a\n  b"]
    vals = ["```dockerfile\nFROM a\n```", "Use this:\n```Dockerfile\nFROM b\nRUN x\n```", "```\nFROM c\n```",
            "FROM d"]
    assert one_col(spark, vals, T.extract_fenced_block) == ["FROM a", "FROM b\nRUN x", "FROM c", "FROM d"]


def test_hash_pick_uniformish(spark):
    df = spark.range(2000).withColumn("opts", F.array(*[F.lit(x) for x in "abcd"]))
    got = df.select(T.hash_pick(F.col("opts"), 42, "id").alias("p")).groupBy("p").count().collect()
    counts = {r.p: r["count"] for r in got}
    assert set(counts) == set("abcd") and all(abs(c - 500) < 100 for c in counts.values())
    assert not math.isnan(sum(counts.values()))
