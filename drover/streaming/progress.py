"""T4-T6: progress counters, a results sink with one row per task and
incremental pass@k over arriving attempt rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drover.operators import trajectory as TR


def stream_progress(results: DataFrame, ok: str = "docker_build_success") -> DataFrame:
    """Running completed / failed / succeeded counts (output mode ``complete``;
    the state is one row)."""
    flag = F.coalesce(F.col(ok), F.lit(False))
    return results.groupBy().agg(F.count(F.lit(1)).alias("completed"),
                                 F.count_if(~flag).alias("failed"),
                                 F.count_if(flag).alias("succeeded"))


RESULT_LOG, RESULT_BASE = "log", "base"


def stream_results_sink(scores: DataFrame, path: str, checkpoint: str, event_time: str = "ts", key: str = "task_name"):
    """One row per finished task, whenever it is delivered again: each
    micro-batch goes into a log, one folder an epoch with the newest row of each
    task in it, and ``results_table`` merges the epochs when it is read.  A
    re-run epoch replaces its own folder, so failures and replays change
    nothing, and no streaming state grows with the tasks.  Returns the
    ``DataStreamWriter``."""
    rows = scores.withColumn(event_time, F.col(event_time).cast("timestamp"))

    def write(batch: DataFrame, epoch_id: int):
        _newest(batch, key, [event_time]).write.mode("overwrite").parquet(f"{path}/{RESULT_LOG}/epoch={epoch_id}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def _newest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per key (null is one), the last in ``order``; ties by the row."""
    rest = [c for c in rows.columns if c != key]
    last = F.max_by(F.struct(*rest), F.struct(*order, *[c for c in rest if c not in order]))
    return rows.groupBy(key).agg(last.alias("r")).select(*[c if c == key else F.col(f"r.{c}") for c in rows.columns])


def _folders(spark, path: str) -> list[str]:
    """Names of the folders in ``path`` that hold a finished write."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(where) if s.isDirectory()]
    return [n for n in names if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]


def _numbers(spark, path: str, prefix: str) -> list[int]:
    return sorted(int(n[len(prefix):]) for n in _folders(spark, path) if n.startswith(prefix))


def results_table(spark, path: str, event_time: str = "ts", key: str = "task_name") -> DataFrame:
    """Current results: the newest row of each task over the newest base and all
    later epochs of the log (an error before the first)."""
    bases = _numbers(spark, f"{path}/{RESULT_BASE}", "upto=")
    upto = bases[-1] if bases else -1
    epochs = [e for e in _numbers(spark, f"{path}/{RESULT_LOG}", "epoch=") if e > upto]
    parts = [f"{path}/{RESULT_BASE}/upto={upto}"] if bases else []
    parts += [f"{path}/{RESULT_LOG}/epoch={e}" for e in epochs]
    if not parts:
        raise FileNotFoundError(f"no finished epoch in {path}")
    return _newest(spark.read.parquet(*parts), key, [event_time])


def compact_results(spark, path: str, event_time: str = "ts", key: str = "task_name") -> int:
    """Merge all finished epochs into a new base and return the last of them;
    readers use the base once it is finished, and read only later epochs with
    it.  Run it from one place; the stream may go on meanwhile."""
    epochs = _numbers(spark, f"{path}/{RESULT_LOG}", "epoch=")
    bases = _numbers(spark, f"{path}/{RESULT_BASE}", "upto=")
    last = max([*epochs, *bases], default=-1)
    if epochs and last not in bases:
        # what finishes meanwhile stays in the log: epochs end in order
        merged = results_table(spark, path, event_time, key)
        merged.write.mode("overwrite").parquet(f"{path}/{RESULT_BASE}/upto={last}")
    return last


def stream_run_counts(runs: DataFrame, task: str = "task_id", success: str = "success") -> DataFrame:
    """Per-task attempt and success counts over arriving run rows (``complete``
    or ``update`` mode); pass@k is derived from these counts per micro-batch."""
    ok = F.coalesce(F.col(success), F.lit(False))
    return runs.groupBy(task).agg(F.count(F.lit(1)).cast("int").alias("num_runs"),
                                  F.sum(ok.cast("int")).cast("int").alias("num_success"))


def stream_summaries(runs: DataFrame, path: str, checkpoint: str, task: str = "task_id"):
    """Newly arriving runs update the per-task pass@k table: each micro-batch
    of changed counts (``update`` mode) is expanded with the pass@k estimator
    and written as one versioned snapshot of the changed tasks.  Returns the
    ``DataStreamWriter``."""
    counts = stream_run_counts(runs, task)

    def write(batch: DataFrame, epoch_id: int):
        TR.pass_at_k(batch).write.mode("overwrite").parquet(f"{path}/epoch={epoch_id}")

    return counts.writeStream.outputMode("update").foreachBatch(write) \
        .option("checkpointLocation", checkpoint)


def latest_summaries(spark, path: str, task: str = "task_id") -> DataFrame:
    """Current pass@k per task: the rows of the newest epoch that touched it."""
    snaps = spark.read.parquet(path)
    newest = snaps.groupBy(task).agg(F.max("epoch").alias("epoch"))
    return snaps.join(newest, [task, "epoch"]).drop("epoch")
