"""Property tests: the native column rules equal Python's own functions on
generated text (each generated list is checked with one Spark job)."""

import textwrap

from hypothesis import given, settings, HealthCheck
from hypothesis import strategies as st
from pyspark.sql import functions as F

from drover.functions import text as T

PIECES = st.sampled_from(["", " ", "  ", "\t", " \t", "x", "y = 1", " ", "　", "\r", "#", "é", "\x0b"])
LINES = st.lists(st.lists(PIECES, max_size=4).map("".join), max_size=6).map("\n".join)


def _run(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(LINES, min_size=20, max_size=60))
def test_dedent_equals_textwrap(spark, texts):
    assert _run(spark, texts, T.dedent) == [textwrap.dedent(t) for t in texts]


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(LINES, min_size=20, max_size=60))
def test_strip_equals_python(spark, texts):
    assert _run(spark, texts, T.py_strip) == [t.strip() for t in texts]
    assert _run(spark, texts, T.whitespace_tokens) == [len(t.split()) for t in texts]
