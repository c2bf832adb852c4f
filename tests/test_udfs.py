"""U1-U3: inference over a request table, pluggable token counting, SQL functions."""

import sys

from pyspark import cloudpickle
from pyspark.sql import functions as F

from drover.functions import text as T
from drover.operators import inference as INF


# the stub client below travels to the Python workers by value
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class FlakyClient:
    """Deterministic stub: 'rate' errors for the first two tries of even ids,
    permanent failure for ids divisible by 5."""

    def __init__(self):
        self.calls = {}

    def __call__(self, messages):
        key = messages[-1]["content"]
        n = self.calls.get(key, 0)
        self.calls[key] = n + 1
        i = int(key)
        if i % 5 == 0:
            raise RuntimeError("bad gateway")
        if i % 2 == 0 and n < 2:
            raise RuntimeError("Rate limit reached")
        return f"<command>echo {i}</command>"


def test_with_completions_retries_and_nulls(spark):
    req = spark.range(1, 21).select(F.col("id").alias("request_id"), F.array(
        F.struct(F.lit("system").alias("role"), F.lit("s").alias("content")),
        F.struct(F.lit("user").alias("role"), F.col("id").cast("string").alias("content"))).alias("messages"))
    waits = []
    out = INF.with_completions(req.repartition(3), FlakyClient, sleep=waits.append, max_concurrency=4)
    rows = {r.request_id: r for r in out.collect()}
    assert len(rows) == 20
    for i, r in rows.items():
        if i % 5 == 0:
            assert r.response is None and r.attempts == 5 and r.error == "bad gateway"
        elif i % 2 == 0:
            assert r.attempts == 3 and r.response == f"<command>echo {i}</command>"
        else:
            assert r.attempts == 1 and r.error is None
    # waits are collected on executors, so check the policy directly
    assert [INF.retry_wait("Rate limit", a) for a in range(4)] == [4.0, 8.0, 16.0, 30.0]
    assert INF.retry_wait("timeout", 3) == 2.0 and INF.retry_wait("x", 3) == 8.0


def test_persist_completions(spark):
    df = spark.range(5).withColumn("response", F.lit("r"))
    back = INF.persist_completions(df, spark)
    assert back.count() == 5 and "FileScan" in back._jdf.queryExecution().executedPlan().toString()


def test_count_tokens_pluggable(spark):
    df = spark.createDataFrame([("a bb ccc",), ("",), (None,)], "t string")
    by_char = INF.count_tokens(lambda: (lambda s: list(s)))
    got = [r[0] for r in df.select(by_char("t")).collect()]
    assert got == [8, 0, 0]


def test_sql_functions_match_columns(spark):
    from drover.functions.sql import register_sql_functions
    names = register_sql_functions(spark)
    assert "python_compiles" in names and "frame_commands" in names
    rows = [("<command> ls </command>", " x\xa0", "\x1b[1mhi\x1b[0m\r\n\n\n\nbye", 137, "FROM a:1", "def f(:")]
    df = spark.createDataFrame(rows, "r string, s string, o string, e int, l string, code string")
    df.createOrReplaceTempView("u3")
    got = spark.sql("SELECT action_type(r) a, py_strip(s) s, clean_output(o) o, classify_exit(e) e, "
                    "parse_from_line(l) l, python_compiles(code) c, image_name('T_1') i FROM u3").collect()[0]
    ref = df.select(T.action_type("r").alias("a"), T.py_strip("s").alias("s"), T.clean_output("o").alias("o"),
                    T.classify_exit("e").alias("e"), T.parse_from_line("l").alias("l")).collect()[0]
    assert (got.a, got.s, got.o, got.e, got.l) == tuple(ref)
    assert got.c is False and got.i == T.IMAGE_PREFIX + "t-1"


def test_resume_calls_only_missing(spark):
    req = spark.range(1, 11).select(F.col("id").alias("request_id"), F.array(
        F.struct(F.lit("user").alias("role"), F.col("id").cast("string").alias("content"))).alias("messages"))
    first = INF.persist_completions(INF.with_completions(req, FlakyClient, sleep=lambda s: None), spark)
    # ids divisible by 5 failed; only they are requested again
    todo = INF.pending_requests(req, first)
    assert sorted(r.request_id for r in todo.collect()) == [5, 10]
    again = INF.with_completions(todo, FlakyClient, sleep=lambda s: None, num_partitions=2)
    assert again.count() == 2
