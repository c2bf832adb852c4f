"""Named queries for the composed entry-point jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from drover.plans import duck as D
from drover.plans import flows as FL
from drover.plans.fixtures import view, with_views
from drover.plans.registry import register
from drover.plans.trajectory_queries import _w6


def _tasks(spark, sf):
    return view(spark, sf, "bundles").withColumn("task_key", F.concat_ws("-", "lang", "source"))


_SOLVED = """(SELECT task_id FROM summaries WHERE model = 'ref' AND num_runs >= 4 AND num_success > 0)"""


@register("solution_worklist", with_views(f"""
SELECT task_id FROM (
  SELECT task_id, row_number() OVER (ORDER BY task_id) AS i FROM bundles b
  WHERE b.lang || '-' || b.source IN {_SOLVED}
    AND NOT EXISTS (SELECT 1 FROM summaries s WHERE s.model = 'cand' AND s.task_id = b.lang || '-' || b.source)) t
WHERE i > 10 AND i <= 210
""", "bundles", "summaries"), ("J3", "J4", "W2", "P4"))
def q_solution_worklist(spark, sf):
    w = FL.solution_worklist(_tasks(spark, sf), view(spark, sf, "summaries"), "cand", "ref", k=4,
                             start_at=10, num_tasks=200)
    return w.select("task_id")


@register("prepare_dataset", with_views(f"""
, chosen AS (SELECT * FROM bundles WHERE lang || '-' || source IN {_SOLVED}
             AND NOT {D.is_blank('description')} AND NOT {D.is_blank('truth')}),
val AS (SELECT task_id FROM chosen ORDER BY md5('42:' || task_id) DESC, task_id DESC LIMIT 50)
SELECT c.task_id AS task_dir, CASE WHEN v.task_id IS NOT NULL THEN 'validation' ELSE 'train' END AS split,
       {D.py_strip('c.description')} AS user_content, '/data/tasks/' || c.task_id AS ground_truth,
       CAST(600 AS BIGINT) AS max_time
FROM chosen c LEFT JOIN val v ON c.task_id = v.task_id
WHERE c.task_id NOT IN (SELECT task_id FROM conversion_results WHERE NOT docker_build_success)
""".replace("\n, ", ", ", 1), "bundles", "summaries", "conversion_results"), ("S3", "P4", "J6", "W3", "J5", "P6"))
def q_prepare_dataset(spark, sf):
    failed = view(spark, sf, "conversion_results").filter(~F.col("docker_build_success")).select("task_id")
    rows = FL.prepare_dataset(_tasks(spark, sf), view(spark, sf, "summaries"), failed, "/data/tasks",
                              "You are a terminal agent.", k=4, eval_count=50)
    return rows.select("task_dir", "split", F.col("prompt")[1]["content"].alias("user_content"),
                       F.col("reward_spec.ground_truth").alias("ground_truth"),
                       F.col("extra_info.max_time").alias("max_time"))


@register("attempt_report", with_views(f"""
, {_w6(16)}
SELECT run_id, max(turn_no) AS n_turns, max(ended_by) AS ended_by,
       count(*) FILTER (WHERE role = 'assistant' AND {D.action_type('content')} = 'command') AS n_commands,
       count(*) FILTER (WHERE role = 'assistant' AND {D.action_type('content')} = 'invalid') AS n_invalid
FROM kept WHERE role = 'assistant' GROUP BY run_id
""".replace("\n, ", ", ", 1), "responses"), ("R4", "W6", "W4"))
def q_attempt_report(spark, sf):
    return FL.attempt_report(view(spark, sf, "responses")).select(
        "run_id", F.col("n_turns").cast("int").alias("n_turns"), "ended_by", "n_commands", "n_invalid")
