"""Conversion funnel, build logs, request retries and benchmark scores.

Reports are one global aggregate (a single pass of ``count_if`` with map-side
partial aggregation), so their cost is one scan regardless of skew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drover.functions import text as T


def _b(c: str):
    return F.coalesce(F.col(c), F.lit(False))


# P5 / A7 -------------------------------------------------------------------------
def filter_failed_results(results: DataFrame, success: str = "success") -> DataFrame:
    """``success`` false or null: a flag that is there without a value is a
    failure, as it is in the funnel.  Readers of JSON reports, where a missing
    key counts as success, fill it in when they read."""
    return results.filter(~F.coalesce(F.col(success), F.lit(False)))


def distinct_failed_tasks(results: DataFrame, key: str = "task_id") -> DataFrame:
    return filter_failed_results(results).select(key).distinct()


# A4 --------------------------------------------------------------------------
def stage_funnel(results: DataFrame, skip_build: bool = False, skip_tests: bool = False) -> DataFrame:
    """Totals, per-stage successes, per-stage errors (previous stage true and
    this one false, suppressed by the skip flags) and percentages (null, not a
    division error, on an empty input)."""
    gen, build, tests = _b("dockerfile_generated"), _b("docker_build_success"), _b("tests_passed")
    agg = results.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(_b("success")).alias("successful"),
        F.count_if(gen).alias("dockerfile_generated"),
        F.count_if(build).alias("docker_build_success"),
        F.count_if(tests).alias("tests_passed"),
        F.count_if(~gen).alias("errors_dockerfile"),
        (F.lit(0).cast("bigint") if skip_build else F.count_if(gen & ~build)).alias("errors_build"),
        (F.lit(0).cast("bigint") if skip_tests else F.count_if(build & ~tests)).alias("errors_tests"),
    ).withColumn("failed", F.col("total") - F.col("successful"))
    for c in ("successful", "failed", "dockerfile_generated", "docker_build_success", "tests_passed"):
        agg = agg.withColumn(f"pct_{c}", F.try_divide(F.col(c) * 100.0, F.col("total")))
    return agg


# A12 -------------------------------------------------------------------------
def build_progress(results: DataFrame, ok: str = "docker_build_success") -> DataFrame:
    return results.agg(F.count(F.lit(1)).alias("total"),
                       F.count(F.lit(1)).alias("completed"),
                       F.count_if(~_b(ok)).alias("failed"),
                       F.count_if(_b(ok)).alias("succeeded"))


# R8 / F14 / F15 --------------------------------------------------------------------
def build_failure_report(results: DataFrame, exit_code: str = "exit_code") -> DataFrame:
    """Failure class per task from the build exit code."""
    return results.withColumn("exit_class", T.classify_exit(exit_code)) \
        .withColumn("failed_stage",
                    F.when(~_b("dockerfile_generated"), F.lit("dockerfile"))
                    .when(~_b("docker_build_success"), F.lit("build"))
                    .when(~_b("tests_passed"), F.lit("tests")))


def failure_class_counts(report: DataFrame) -> DataFrame:
    return report.groupBy("exit_class", "failed_stage").agg(F.count(F.lit(1)).alias("n_tasks"))


def oom_lines(logs: DataFrame, key: str, text: str) -> DataFrame:
    """Per log: number of lines and of lines with an out-of-memory indicator."""
    lines = logs.select(key, F.explode(F.split(F.col(text), "\n", -1)).alias("line"))
    return lines.groupBy(key).agg(F.count(F.lit(1)).alias("n_lines"),
                                  F.count_if(T.detect_oom("line")).alias("n_oom_lines"))


# A6 / F17 --------------------------------------------------------------------------
def distinct_base_images(files: DataFrame, key: str, text: str) -> DataFrame:
    """Images named by ``FROM`` lines: references and distinct files per image.
    Files are de-duplicated per (image, file) first, so one hot image spreads
    over many tasks before the per-image count."""
    refs = files.select(key, F.explode(F.split(F.col(text), "\n", -1)).alias("line")) \
        .select(key, T.parse_from_line("line").alias("image")).filter(F.col("image").isNotNull())
    per_file = refs.groupBy("image", key).agg(F.count(F.lit(1)).alias("_r"))
    return per_file.groupBy("image").agg(F.sum("_r").alias("n_refs"), F.count(F.lit(1)).alias("n_files"))


# R9 / F16 --------------------------------------------------------------------------
def retry_report(attempts: DataFrame, policy: str = "generate", key: str = "request_id",
                 attempt: str = "attempt", error: str = "error") -> DataFrame:
    """Per request: attempts, errors by class, total planned wait, and whether
    the retries were exhausted (an error on the last allowed try)."""
    last = (T.GENERATE_MAX_RETRIES if policy == "generate" else T.CONVERT_MAX_RETRIES) - 1
    a = attempts.withColumn("error_class", T.api_error_class(error)) \
        .withColumn("wait_s", T.planned_wait(error, attempt, policy))
    return a.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_attempts"),
        F.count_if(F.col(error).isNotNull()).alias("n_errors"),
        F.count_if(F.col("error_class") == "rate_limit").alias("n_rate_limit"),
        F.count_if(F.col("error_class") == "timeout").alias("n_timeout"),
        F.coalesce(F.sum("wait_s"), F.lit(0.0)).alias("total_wait_s"),
        F.max((F.col(attempt) >= last) & F.col(error).isNotNull()).alias("exhausted"))


# R7 / F13 / O3 -------------------------------------------------------------------------
def benchmark_scores(logs: DataFrame, tasks: DataFrame | None = None, key: str = "task_name",
                     log: str = "log") -> DataFrame:
    """Reward (first ``Mean`` cell) and errors per log; left-joined from the task
    list so tasks without a log or a result count as missing."""
    scored = logs.select(key, T.log_reward_text(log).alias("reward_text"), T.log_errors(log).alias("errors"))
    scored = scored.withColumn("reward", F.col("reward_text").try_cast("double"))
    if tasks is not None:
        scored = tasks.select(key).join(scored, key, "left")
    return scored.withColumn("missing", F.col("reward").isNull())


def benchmark_summary(scores: DataFrame) -> DataFrame:
    return scores.agg(F.count(F.lit(1)).alias("n_tasks"),
                      F.count("reward").alias("n_scored"),
                      F.count_if(F.col("missing")).alias("n_missing"),
                      F.avg("reward").alias("mean_reward"))


def tail_lines(c, n: int = 10):
    lines = F.split(F.col(c) if isinstance(c, str) else c, "\n", -1)
    return F.array_join(F.slice(lines, F.greatest(F.size(lines) - (n - 1), F.lit(1)), n), "\n")


def tail_failed_logs(logs: DataFrame, key: str = "task_name", log: str = "log", n: int = 10,
                     failed=None) -> DataFrame:
    """Last ``n`` lines of every failed log (default: no reward could be read;
    callers with exit codes pass ``reward missing or exit code != 0``)."""
    cond = T.log_reward_text(log).isNull() if failed is None else failed
    return logs.filter(cond).select(key, tail_lines(log, n).alias("tail"))
