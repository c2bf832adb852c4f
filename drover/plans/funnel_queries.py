"""Named queries over conversion results, build logs, request retries and
benchmark logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from drover.functions import text as T
from drover.operators import funnel as FU
from drover.plans import duck as D
from drover.plans.fixtures import table, view, with_views
from drover.plans.registry import register

R9 = 9


def _b(c):
    return f"coalesce({c}, false)"


@register("stage_funnel", with_views(f"""
SELECT *, {', '.join(f"round(CASE WHEN total = 0 THEN NULL ELSE {c} * 100.0 / total END, {R9}) AS pct_{c}"
                     for c in ('successful', 'failed', 'dockerfile_generated', 'docker_build_success',
                               'tests_passed'))}
FROM (SELECT count(*) AS total, count(*) FILTER (WHERE {_b('success')}) AS successful,
             count(*) - count(*) FILTER (WHERE {_b('success')}) AS failed,
             count(*) FILTER (WHERE {_b('dockerfile_generated')}) AS dockerfile_generated,
             count(*) FILTER (WHERE {_b('docker_build_success')}) AS docker_build_success,
             count(*) FILTER (WHERE {_b('tests_passed')}) AS tests_passed,
             count(*) FILTER (WHERE NOT {_b('dockerfile_generated')}) AS errors_dockerfile,
             count(*) FILTER (WHERE {_b('dockerfile_generated')} AND NOT {_b('docker_build_success')}) AS errors_build,
             count(*) FILTER (WHERE {_b('docker_build_success')} AND NOT {_b('tests_passed')}) AS errors_tests
      FROM conversion_results) a
""", "conversion_results"), ("A4",))
def q_stage_funnel(spark, sf):
    out = FU.stage_funnel(view(spark, sf, "conversion_results"))
    for c in out.columns:
        if c.startswith("pct_"):
            out = out.withColumn(c, F.round(c, R9))
    return out


@register("filter_failed_results", with_views("""
SELECT task_id FROM conversion_results WHERE NOT coalesce(success, false)
""", "conversion_results"), ("P5",))
def q_filter_failed_results(spark, sf):
    return FU.filter_failed_results(view(spark, sf, "conversion_results")).select("task_id")


@register("build_progress", with_views(f"""
SELECT count(*) AS total, count(*) AS completed,
       count(*) FILTER (WHERE NOT {_b('docker_build_success')}) AS failed,
       count(*) FILTER (WHERE {_b('docker_build_success')}) AS succeeded
FROM conversion_results
""", "conversion_results"), ("A12",))
def q_build_progress(spark, sf):
    return FU.build_progress(view(spark, sf, "conversion_results"))


_CLASS_SQL = f"""
SELECT task_id,
       CASE WHEN exit_code IS NULL THEN 'timeout' WHEN exit_code = 0 THEN 'ok'
            WHEN exit_code = 137 THEN 'oom_killed' ELSE 'failed' END AS exit_class,
       CASE WHEN NOT {_b('dockerfile_generated')} THEN 'dockerfile'
            WHEN NOT {_b('docker_build_success')} THEN 'build'
            WHEN NOT {_b('tests_passed')} THEN 'tests' END AS failed_stage
FROM conversion_results
"""


@register("build_failure_report", with_views(_CLASS_SQL, "conversion_results"), ("R8", "F15"))
def q_build_failure_report(spark, sf):
    return FU.build_failure_report(view(spark, sf, "conversion_results")).select(
        "task_id", "exit_class", "failed_stage")


@register("failure_class_counts", with_views(f"""
SELECT exit_class, failed_stage, count(*) AS n_tasks FROM ({_CLASS_SQL}) r GROUP BY exit_class, failed_stage
""", "conversion_results"), ("R8",))
def q_failure_class_counts(spark, sf):
    return FU.failure_class_counts(FU.build_failure_report(view(spark, sf, "conversion_results")))


@register("oom_scan", f"""
SELECT page_id, count(*) AS n_lines,
       count(*) FILTER (WHERE regexp_matches(lower(line), {D.rx(T.oom_pattern())})) AS n_oom_lines
FROM (SELECT page_id, unnest(string_split(html, chr(10))) AS line FROM pages) l
GROUP BY page_id
""", ("F14", "R8"))
def q_oom_scan(spark, sf):
    return FU.oom_lines(table(spark, sf, "pages"), "page_id", "html")


@register("distinct_base_images", with_views(f"""
SELECT image, CAST(sum(r) AS BIGINT) AS n_refs, count(*) AS n_files FROM (
  SELECT image, task_key, count(*) AS r FROM (
    SELECT task_key, {D.parse_from_line('line')} AS image
    FROM (SELECT task_key, unnest(string_split(dockerfile, chr(10))) AS line FROM dockerfiles) a) b
  WHERE image IS NOT NULL GROUP BY image, task_key) c
GROUP BY image
""", "dockerfiles"), ("A6", "F17"))
def q_distinct_base_images(spark, sf):
    out = FU.distinct_base_images(view(spark, sf, "dockerfiles"), "task_key", "dockerfile")
    return out.withColumn("n_refs", F.col("n_refs").cast("bigint"))


@register("retry_report", with_views(f"""
SELECT request_id, count(*) AS n_attempts, count(error) AS n_errors,
       count(*) FILTER (WHERE contains(lower(error), 'rate')) AS n_rate_limit,
       count(*) FILTER (WHERE NOT contains(lower(error), 'rate') AND contains(lower(error), 'timeout')) AS n_timeout,
       round(coalesce(sum(CASE WHEN error IS NULL OR attempt >= 4 THEN NULL
                WHEN contains(lower(error), 'rate') THEN least(pow(2.0, attempt + 2), 30.0)
                WHEN contains(lower(error), 'timeout') THEN 2.0
                ELSE pow(2.0, attempt) END), 0.0), {R9}) AS total_wait_s,
       bool_or(attempt >= 4 AND error IS NOT NULL) AS exhausted
FROM request_attempts GROUP BY request_id
""", "request_attempts"), ("R9", "F16"))
def q_retry_report(spark, sf):
    out = FU.retry_report(view(spark, sf, "request_attempts"))
    return out.withColumn("total_wait_s", F.round("total_wait_s", R9))


# the converter's client: only rate limits and overload are tried again, after 10, 20, 40, ... seconds
@register("retry_report_convert", with_views(f"""
SELECT request_id, count(*) AS n_attempts, count(error) AS n_errors,
       count(*) FILTER (WHERE contains(lower(error), 'rate')) AS n_rate_limit,
       count(*) FILTER (WHERE NOT contains(lower(error), 'rate') AND contains(lower(error), 'timeout')) AS n_timeout,
       round(coalesce(sum(CASE WHEN attempt < 4 AND regexp_matches(lower(error), 'rate|429|overloaded') THEN 10.0 * pow(2.0, attempt) END), 0.0), {R9}) AS total_wait_s,
       bool_or(attempt >= 4 AND error IS NOT NULL) AS exhausted
FROM request_attempts GROUP BY request_id
""", "request_attempts"), ("R9", "F16"))
def q_retry_report_convert(spark, sf):
    out = FU.retry_report(view(spark, sf, "request_attempts"), policy="convert")
    return out.withColumn("total_wait_s", F.round("total_wait_s", R9))


_SCORES_SQL = f"""
SELECT s.s_name AS task_name, r.reward_text, r.errors, TRY_CAST(r.reward_text AS DOUBLE) AS reward,
       TRY_CAST(r.reward_text AS DOUBLE) IS NULL AS missing
FROM supplier s LEFT JOIN (
  SELECT task_name, nullif({D.regexp_extract('log', T.REWARD_RE)}, '') AS reward_text,
         TRY_CAST(nullif({D.regexp_extract('log', T.ERRORS_RE)}, '') AS INTEGER) AS errors
  FROM benchmark_logs) r ON s.s_name = r.task_name
"""


def _scores(spark, sf):
    tasks = table(spark, sf, "supplier").select(F.col("s_name").alias("task_name"))
    return FU.benchmark_scores(view(spark, sf, "benchmark_logs"), tasks)


@register("benchmark_scores", with_views(_SCORES_SQL, "benchmark_logs"), ("R7", "F13"))
def q_benchmark_scores(spark, sf):
    return _scores(spark, sf).select("task_name", "reward_text", "errors", "reward", "missing")


@register("benchmark_summary", with_views(f"""
SELECT count(*) AS n_tasks, count(reward) AS n_scored, count(*) FILTER (WHERE missing) AS n_missing,
       round(avg(reward), {R9}) AS mean_reward
FROM ({_SCORES_SQL}) s
""", "benchmark_logs"), ("R7",))
def q_benchmark_summary(spark, sf):
    return FU.benchmark_summary(_scores(spark, sf)).withColumn("mean_reward", F.round("mean_reward", R9))


@register("tail_failed_logs", with_views(f"""
SELECT task_name, array_to_string(list_slice(l, greatest(len(l) - 9, 1), len(l)), chr(10)) AS tail
FROM (SELECT task_name, log, string_split(log, chr(10)) AS l FROM benchmark_logs) x
WHERE nullif({D.regexp_extract('log', T.ERRORS_RE)}, '') IS NULL
""", "benchmark_logs"), ("O3",))
def q_tail_failed_logs(spark, sf):
    # a log without an Errors cell did not finish its result table
    return FU.tail_failed_logs(view(spark, sf, "benchmark_logs"), failed=T.log_errors("log").isNull())
