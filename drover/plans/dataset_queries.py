"""Named queries for ordering, slicing, the train/validation split and the
train rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from drover.operators import curate as C
from drover.operators import dataset as DS
from drover.operators import trajectory as TR
from drover.plans import duck as D
from drover.plans.fixtures import table, view, with_views
from drover.plans.registry import register

R9 = 9
_EVAL = 100
_ROOT = "/data/tasks"
_SYSTEM = "You are a terminal agent."


@register("sort_tasks", """
SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS position FROM documents
""", ("O1",))
def q_sort_tasks(spark, sf):
    return DS.sort_tasks(table(spark, sf, "documents").select("doc_id"), "doc_id")


@register("assign_batches", """
SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS idx,
       CAST(floor((row_number() OVER (ORDER BY doc_id) - 1) / 100) AS INTEGER) AS batch
FROM documents
""", ("W1",))
def q_assign_batches(spark, sf):
    return DS.assign_batches(table(spark, sf, "documents").select("doc_id"), 100, "doc_id")


@register("slice_tasks", """
SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS i FROM documents) t
WHERE i > 100 AND i <= 300
""", ("W2",))
def q_slice_tasks(spark, sf):
    return DS.slice_tasks(table(spark, sf, "documents").select("doc_id"), 100, 200, "doc_id")


@register("seeded_shuffle", with_views("""
SELECT task_id, md5('42:' || task_id) AS shuffle_key,
       row_number() OVER (ORDER BY md5('42:' || task_id), task_id) AS shuffle_position
FROM bundles
""", "bundles"), ("O2",))
def q_seeded_shuffle(spark, sf):
    return DS.seeded_shuffle(view(spark, sf, "bundles").select("task_id"))


_SPLIT_SQL = f"""
SELECT b.task_id, CASE WHEN v.task_id IS NOT NULL THEN 'validation' ELSE 'train' END AS split
FROM bundles b
LEFT JOIN (SELECT task_id FROM bundles ORDER BY md5('42:' || task_id) DESC, task_id DESC LIMIT {_EVAL}) v
  ON b.task_id = v.task_id
WHERE b.task_id NOT IN (SELECT task_id FROM conversion_results WHERE NOT docker_build_success)
"""


def _failed_builds(spark, sf):
    return view(spark, sf, "conversion_results").filter(~F.col("docker_build_success")).select("task_id")


@register("train_val_split", with_views(_SPLIT_SQL, "bundles", "conversion_results"), ("W3", "J5"))
def q_train_val_split(spark, sf):
    b = view(spark, sf, "bundles").select("task_id")
    return DS.train_val_split(b, _EVAL, 42, failed=_failed_builds(spark, sf)).select("task_id", "split")


@register("anti_join_failed_builds", with_views("""
SELECT task_id FROM bundles
WHERE task_id NOT IN (SELECT task_id FROM conversion_results WHERE NOT docker_build_success)
""", "bundles", "conversion_results"), ("J5",))
def q_anti_join_failed_builds(spark, sf):
    return DS.anti_join_failed_builds(view(spark, sf, "bundles").select("task_id"), _failed_builds(spark, sf))


@register("split_sizes", with_views(f"""
SELECT split, count(*) AS n_rows FROM ({_SPLIT_SQL}) s GROUP BY split
""", "bundles", "conversion_results"), ("A11",))
def q_split_sizes(spark, sf):
    return DS.split_sizes(q_train_val_split(spark, sf))


_TRAIN_SQL = f"""
SELECT s.task_id AS task_dir, s.split, {D.py_strip('b.description')} AS description,
       {D.lit(DS.DATA_SOURCE)} AS data_source, {D.lit(_SYSTEM)} AS system_content,
       {D.py_strip('b.description')} AS user_content, {D.lit(DS.ENV_CLASS)} AS env_class,
       {D.lit(DS.REWARD_METHOD)} AS reward_method,
       '{_ROOT}/' || s.task_id AS ground_truth, '{_ROOT}/' || s.task_id AS extra_task_dir,
       CAST(600 AS BIGINT) AS max_time
FROM ({_SPLIT_SQL}) s JOIN bundles b ON s.task_id = b.task_id
WHERE NOT {D.is_blank('b.description')} AND NOT {D.is_blank('b.truth')}
"""


def train_rows(spark, sf):
    b = view(spark, sf, "bundles")
    split = DS.train_val_split(b.select("task_id"), _EVAL, 42, failed=_failed_builds(spark, sf))
    tasks = C.filter_complete_templates(b).select("task_id", "description").join(split, "task_id")
    return DS.project_train_rows(tasks, _ROOT, _SYSTEM, "600")


def flat_train_rows(df):
    return df.select("task_dir", "split", "description", "data_source",
                     F.col("prompt")[0]["content"].alias("system_content"),
                     F.col("prompt")[1]["content"].alias("user_content"), "env_class",
                     F.col("reward_spec.method").alias("reward_method"),
                     F.col("reward_spec.ground_truth").alias("ground_truth"),
                     F.col("extra_info.task_dir").alias("extra_task_dir"),
                     F.col("extra_info.max_time").alias("max_time"))


@register("project_train_rows", with_views(_TRAIN_SQL, "bundles", "conversion_results"), ("P6", "F26"))
def q_project_train_rows(spark, sf):
    return flat_train_rows(train_rows(spark, sf))


def _solved_sql(k: int, model: str) -> str:
    return with_views(f"""
SELECT task_id, model, round(CASE WHEN num_success <= 0 THEN 0.0 WHEN {k} > num_runs - num_success THEN 1.0
       ELSE 1.0 - list_reduce(list_transform(range(CAST(num_runs - num_success + 1 AS BIGINT), CAST(num_runs + 1 AS BIGINT)),
            lambda i: 1.0 - {float(k)} / CAST(i AS DOUBLE)), lambda a, b: a * b, 1.0) END, {R9}) AS pass_at_k
FROM summaries
WHERE model = '{model}' AND num_runs >= {k} AND num_success > 0
""", "summaries")


# the published K; strict: the summaries of this model that have a pass@16 all count, a missing one would fail the job
@register("filter_solved_tasks_strict", _solved_sql(16, "cand"), ("P4",))
def q_filter_solved_tasks_strict(spark, sf):
    s = view(spark, sf, "summaries").filter((F.col("model") == "cand") & (F.col("num_runs") >= 16))
    return TR.filter_solved_tasks(s, k=16, strict=True).select("task_id", "model", F.round("pass_at_k", R9).alias("pass_at_k"))


@register("filter_solved_tasks_k16", _solved_sql(16, "ref"), ("P4",))
def q_filter_solved_tasks_k16(spark, sf):
    s = view(spark, sf, "summaries").filter(F.col("model") == "ref")
    return TR.filter_solved_tasks(s, k=16).select("task_id", "model", F.round("pass_at_k", R9).alias("pass_at_k"))


@register("filter_solved_tasks", _solved_sql(4, "ref"), ("P4",))
def q_filter_solved_tasks(spark, sf):
    s = view(spark, sf, "summaries").filter(F.col("model") == "ref")
    p = TR.filter_solved_tasks(s, k=4)
    return p.select("task_id", "model", F.round("pass_at_k", R9).alias("pass_at_k"))
