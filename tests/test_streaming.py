"""Every streaming operator equals its batch form on the same rows."""

import os
import time

from pyspark.sql import functions as F

from drover.operators import framing as FR
from drover.operators import trajectory as TR
from drover.plans.fixtures import view
from drover.streaming import episodes as EP
from drover.streaming import framing as SF
from drover.streaming import progress as PR

from conftest import SF_MID, SF_SMALL


def _write_slices(df, root, slice_col, order):
    """One parquet file per slice, oldest first, so the file source replays
    them in the given order (one file per trigger)."""
    values = [r[0] for r in df.select(slice_col).distinct().collect()]
    for i, v in enumerate(sorted(values, reverse=(order == "reverse"))):
        df.filter(F.col(slice_col) == v).drop(slice_col).coalesce(1).write.parquet(f"{root}/stage{i}")
        for f in os.listdir(f"{root}/stage{i}"):
            if f.endswith(".parquet"):
                os.rename(f"{root}/stage{i}/{f}", f"{root}/in/{i:04d}.parquet")
                t = time.time() - 1000 + i
                os.utime(f"{root}/in/{i:04d}.parquet", (t, t))


import pytest


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """Stateful test queries run with 2 state partitions (fixed per checkpoint)."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", old)


def _run(spark, stream_df, name, mode="append"):
    q = stream_df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def _stream_of(spark, df, root, slice_col, order="forward"):
    os.makedirs(f"{root}/in")
    _write_slices(df, root, slice_col, order)
    schema = df.drop(slice_col).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")


def test_stream_episodes_equals_batch(spark, tmpdir_path):
    steps = view(spark, SF_SMALL, "steps")
    batch = TR.episode_outcome(steps, max_turns=4, max_time=86400).filter("end_turn IS NOT NULL")
    expect = sorted(tuple(r) for r in batch.select(*[c.split()[0] for c in EP.OUTPUT_SCHEMA.split(", ")]).collect())
    for order in ("forward", "reverse"):
        root = f"{tmpdir_path}/{order}"
        src = _stream_of(spark, steps.withColumn("slice", F.least(F.floor((F.col("turn") - 1) / 2), F.lit(2))), root, "slice", order)
        out = _run(spark, EP.stream_episodes(src, max_turns=4, max_time=86400, watermark="3650 days"),
                   f"episodes_{order}")
        got = sorted(tuple(r) for r in out.filter("end_turn IS NOT NULL").collect())
        assert got == expect, order


def test_stream_framing_equals_batch(spark, tmpdir_path):
    chunks = view(spark, SF_MID, "chunks")
    expect = sorted(tuple(r) for r in FR.frame_commands(chunks).collect())
    assert len(expect) == 143
    for order in ("forward", "reverse"):
        root = f"{tmpdir_path}/{order}"
        src = _stream_of(spark, chunks.withColumn("slice", F.floor(F.col("seq") / 3)), root, "slice", order)
        out = _run(spark, SF.stream_frame_commands(src), f"frames_{order}")
        got = sorted(tuple(r)[:4] for r in out.collect())
        assert got == expect, order


def test_udtf_framing_equals_batch(spark):
    from drover.functions.sql import register_sql_functions
    register_sql_functions(spark)
    view(spark, SF_MID, "chunks").createOrReplaceTempView("chunks_v")
    got = spark.sql("SELECT * FROM frame_commands(TABLE(chunks_v) PARTITION BY session_id ORDER BY seq)")
    expect = FR.frame_commands(view(spark, SF_MID, "chunks"))
    assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r) for r in expect.collect())


def test_command_timeouts_batch(spark):
    import datetime as dt
    t0 = dt.datetime(2024, 1, 1)
    rows = [(1, 0, t0, "a\n__CMD_DONE__ab__:0\n"), (1, 1, t0 + dt.timedelta(seconds=3), "long "),
            (1, 2, t0 + dt.timedelta(seconds=30), "out\n__CMD_DONE__ab__:1\n")]
    df = spark.createDataFrame(rows, "session_id long, seq long, ts timestamp, chunk string")
    got = {r.record_no: r for r in FR.command_timeouts(df, 10).collect()}
    # output is all text before the marker, including the newline that ends the last output line
    assert got[0].output == "a\n" and got[0].exit_code == 0 and not got[0].timed_out
    # what came after the deadline is stale: only the chunk that arrived in time is told
    assert got[1].timed_out and got[1].exit_code is None and got[1].output == "long "


def test_stream_command_timeout(spark, tmpdir_path):
    os.makedirs(f"{tmpdir_path}/in")
    spark.createDataFrame([(7, 0, "partial output with no marker")], "session_id long, seq long, chunk string") \
        .write.parquet(f"{tmpdir_path}/in/a")
    src = spark.readStream.schema("session_id long, seq long, chunk string").parquet(f"{tmpdir_path}/in/*")
    q = (SF.stream_frame_commands(src, command_timeout_s=1).writeStream.format("memory")
         .queryName("timeouts").outputMode("append").trigger(processingTime="500 milliseconds").start())
    try:
        deadline = time.time() + 60
        while time.time() < deadline and spark.table("timeouts").count() == 0:
            time.sleep(0.5)
    finally:
        q.stop()
    rows = spark.table("timeouts").collect()
    assert len(rows) == 1 and rows[0].timed_out and rows[0].output == "partial output with no marker"


def test_stream_progress_equals_batch(spark, tmpdir_path):
    from drover.operators.funnel import build_progress
    res = view(spark, SF_SMALL, "conversion_results")
    src = _stream_of(spark, res.withColumn("slice", F.coalesce(F.col("exit_code"), F.lit(-1))), tmpdir_path, "slice")
    out = _run(spark, PR.stream_progress(src), "progress", "complete").collect()[0]
    b = build_progress(res).collect()[0]
    assert (out.completed, out.failed, out.succeeded) == (b.completed, b.failed, b.succeeded)


def test_stream_results_sink_once_per_task(spark, tmpdir_path):
    import datetime as dt
    t0 = dt.datetime(2024, 1, 1)
    rows = [("a", 0.5, 0, 0, t0), ("b", None, None, 1, t0), ("a", 0.5, 0, 0, t0 + dt.timedelta(minutes=1)),
            ("c", 1.0, 0, 0, t0 + dt.timedelta(minutes=2))]
    df = spark.createDataFrame(rows, "task_name string, reward double, errors int, exit_code int, ts timestamp")
    src = _stream_of(spark, df.withColumn("slice", F.minute("ts")), f"{tmpdir_path}/src", "slice")
    w = PR.stream_results_sink(src, f"{tmpdir_path}/out", f"{tmpdir_path}/ckpt")
    w.trigger(availableNow=True).start().awaitTermination()
    got = sorted(r.task_name for r in PR.results_table(spark, f"{tmpdir_path}/out").collect())
    assert got == ["a", "b", "c"]


def test_stream_summaries_equal_batch(spark, tmpdir_path):
    runs = view(spark, SF_SMALL, "runs")
    src = _stream_of(spark, runs.withColumn("slice", F.col("attempt") % 3), f"{tmpdir_path}/src", "slice")
    PR.stream_summaries(src, f"{tmpdir_path}/out", f"{tmpdir_path}/ckpt") \
        .trigger(availableNow=True).start().awaitTermination()
    got = PR.latest_summaries(spark, f"{tmpdir_path}/out")
    expect = TR.pass_at_k(TR.rollup_runs(runs))
    cols = ["task_id", "num_runs", "num_success", "k", "pass_at_k"]
    assert sorted(tuple(r) for r in got.select(cols).collect()) == sorted(tuple(r) for r in expect.select(cols).collect())


def test_skew_safe_framing_equals_plain(spark):
    chunks = view(spark, SF_MID, "chunks")
    # one hot session holding a third of all chunks, plus the fixture sessions
    hot = chunks.filter("session_id = 1").select(F.lit(10**6).cast("bigint").alias("session_id"), "seq", "chunk")
    big = hot.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(199)))).select(
        "session_id", (F.col("rep") * 100 + F.col("seq")).alias("seq"), "chunk")
    data = chunks.select("session_id", "seq", "chunk").unionByName(big)
    plain = sorted(tuple(r) for r in FR.frame_commands(data).collect())
    safe = sorted(tuple(r) for r in FR.frame_commands(data, skew_safe=True).collect())
    assert plain == safe and len(plain) > 143


def test_keyed_prefix_sum_balanced_and_exact(spark):
    from drover.operators.dataset import keyed_prefix_sum
    df = spark.range(0, 30000).select((F.when(F.col("id") < 20000, 0).otherwise(F.col("id") % 7)).alias("k"),
                                      F.col("id").alias("o"), (F.col("id") % 5).alias("v"))
    got = keyed_prefix_sum(df, "k", ["o"], "v", "s", num_partitions=6)
    from pyspark.sql import Window
    w = Window.partitionBy("k").orderBy("o").rowsBetween(Window.unboundedPreceding, -1)
    ref = df.withColumn("s", F.coalesce(F.sum("v").over(w), F.lit(0)))
    assert sorted(got.select("k", "o", "s").collect()) == sorted(ref.select("k", "o", "s").collect())
