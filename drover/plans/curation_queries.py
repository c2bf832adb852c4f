"""Named queries over generated task bundles, replies and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from drover.functions import text as T
from drover.operators import curate as C
from drover.operators import trajectory as TR
from drover.plans import duck as D
from drover.plans.fixtures import table, view, with_views
from drover.plans.registry import register

R9 = 9


def _blank(x):
    return D.is_blank(x)


def _truthy(x):
    return f"coalesce({x} <> '', false)"


_REJECT_SQL = (f"CASE WHEN NOT (NOT {_blank('description')} AND NOT {_blank('truth')}) THEN 'template' "
               f"WHEN NOT {_truthy('initial_test')} THEN 'initial_test' "
               f"WHEN NOT {_truthy('final_test')} THEN 'final_test' "
               f"WHEN NOT {_truthy('container_def')} THEN 'container_def' END")


@register("filter_complete_templates", with_views(f"""
SELECT task_id, {D.py_strip('description')} AS description, {D.py_strip('truth')} AS truth
FROM bundles WHERE NOT {_blank('description')} AND NOT {_blank('truth')}
""", "bundles"), ("P1", "F0"))
def q_filter_complete_templates(spark, sf):
    return C.filter_complete_templates(view(spark, sf, "bundles")).select("task_id", "description", "truth")


@register("filter_stage_survivors", with_views(f"""
SELECT task_id, {_REJECT_SQL} AS reject_stage FROM bundles
""", "bundles"), ("P2",))
def q_filter_stage_survivors(spark, sf):
    return C.filter_stage_survivors(view(spark, sf, "bundles"), keep_rejects=True) \
        .select("task_id", "reject_stage")


@register("filter_complete_bundles", with_views(f"""
SELECT task_id, CASE WHEN ({_REJECT_SQL}) IS NULL THEN task_id END AS saved_task FROM bundles
""", "bundles"), ("P3",))
def q_filter_complete_bundles(spark, sf):
    return C.filter_complete_bundles(view(spark, sf, "bundles")).select("task_id", "saved_task")


@register("generation_summary", with_views(f"""
SELECT count(*) AS requested, count(CASE WHEN ({_REJECT_SQL}) IS NULL THEN 1 END) AS succeeded,
       round(CASE WHEN count(*) = 0 THEN 0.0
                  ELSE CAST(count(CASE WHEN ({_REJECT_SQL}) IS NULL THEN 1 END) AS DOUBLE) / count(*) END, {R9})
         AS success_rate
FROM bundles
""", "bundles"), ("A3",))
def q_generation_summary(spark, sf):
    out = C.generation_summary(C.filter_complete_bundles(view(spark, sf, "bundles")))
    return out.withColumn("success_rate", F.round("success_rate", R9))


@register("generation_yield", with_views(f"""
, r AS (SELECT {_REJECT_SQL} AS rs FROM bundles)
SELECT * FROM (VALUES (0, 'requested', (SELECT count(*) FROM r)),
  (1, 'template', (SELECT count(*) FROM r WHERE rs IS NULL OR rs NOT IN ('template'))),
  (2, 'initial_test', (SELECT count(*) FROM r WHERE rs IS NULL OR rs NOT IN ('template', 'initial_test'))),
  (3, 'final_test', (SELECT count(*) FROM r WHERE rs IS NULL
                     OR rs NOT IN ('template', 'initial_test', 'final_test'))),
  (4, 'container_def', (SELECT count(*) FROM r WHERE rs IS NULL))) t(stage_order, stage, n_rows)
""".replace("\n, ", ", ", 1), "bundles"), ("A5",))
def q_generation_yield(spark, sf):
    return C.generation_yield(view(spark, sf, "bundles"))


_SYSTEM = "You write tests for terminal tasks."
_USER_TEMPLATE = "Task: {description}\nTruth: {truth}\nKeep {{braces}} literal."


@register("build_chat_requests", with_views(f"""
SELECT task_id, 2 AS n_messages, {D.lit(_SYSTEM)} AS system_content,
       'Task: ' || {D.py_strip('description')} || chr(10) || 'Truth: ' || {D.py_strip('truth')}
         || chr(10) || 'Keep {{braces}} literal.' AS user_content
FROM bundles WHERE NOT {_blank('description')} AND NOT {_blank('truth')}
""", "bundles"), ("P7", "P8"))
def q_build_chat_requests(spark, sf):
    t = C.filter_complete_templates(view(spark, sf, "bundles"))
    user = C.render_template(_USER_TEMPLATE, description="description", truth="truth")
    r = C.build_chat_requests(t, _SYSTEM, user)
    return r.select("task_id", F.size("messages").alias("n_messages"),
                    F.col("messages")[0]["content"].alias("system_content"),
                    F.col("messages")[1]["content"].alias("user_content"))


@register("append_restrictions", with_views(f"""
SELECT task_id, {D.py_strip('description')} || {D.lit(C.RESTRICTIONS_BLOCK)} AS instruction
FROM bundles WHERE NOT {_blank('description')} AND NOT {_blank('truth')}
""", "bundles"), ("P10",))
def q_append_restrictions(spark, sf):
    t = C.filter_complete_templates(view(spark, sf, "bundles"))
    return t.select("task_id", C.append_restrictions("description").alias("instruction"))


@register("replicate_attempts", with_views(f"""
SELECT task_id, CAST(a AS INTEGER) AS attempt
FROM bundles, LATERAL (SELECT unnest(range(0, 4)) AS a) x
WHERE ({_REJECT_SQL}) IS NULL
""", "bundles"), ("P9",))
def q_replicate_attempts(spark, sf):
    ok = C.filter_stage_survivors(view(spark, sf, "bundles"))
    return C.replicate_attempts(ok, 4).select("task_id", F.col("attempt").cast("int").alias("attempt"))


@register("rewrite_path_prefix", with_views("""
SELECT task_id, replace(container_def, './base.sif', '/images/base.sif') AS container_def FROM bundles
""", "bundles"), ("P11",))
def q_rewrite_path_prefix(spark, sf):
    b = view(spark, sf, "bundles")
    return b.select("task_id", C.rewrite_path_prefix("container_def", "./base.sif", "/images/base.sif")
                    .alias("container_def"))


@register("join_stage_outputs", with_views(f"""
SELECT b.task_id, CAST(length({D.py_strip('b.description')}) AS INTEGER) AS description_chars,
       CAST(length({D.py_strip('b.truth')}) AS INTEGER) AS truth_chars, i.initial_test, f.final_test, d.container_def
FROM bundles b
JOIN (SELECT task_id, initial_test FROM bundles WHERE {_truthy('initial_test')}) i ON b.task_id = i.task_id
JOIN (SELECT task_id, final_test FROM bundles WHERE {_truthy('final_test')}) f ON b.task_id = f.task_id
JOIN (SELECT task_id, container_def FROM bundles WHERE {_truthy('container_def')}) d ON b.task_id = d.task_id
WHERE NOT {_blank('b.description')} AND NOT {_blank('b.truth')}
""", "bundles"), ("J1",))
def q_join_stage_outputs(spark, sf):
    b = view(spark, sf, "bundles")
    templates = C.filter_complete_templates(b).select("task_id", "description", "truth")
    stages = [b.filter(C._truthy(c)).select("task_id", c) for c in ("initial_test", "final_test", "container_def")]
    j = C.join_stage_outputs(templates, *stages)
    return j.select("task_id", F.length("description").alias("description_chars"),
                    F.length("truth").alias("truth_chars"), "initial_test", "final_test", "container_def")


@register("join_requests_responses", with_views("""
SELECT d.doc_id AS request_id, CAST(length(r.response) AS INTEGER) AS response_chars, r.response IS NULL AS failed
FROM documents d LEFT JOIN (SELECT * FROM template_replies WHERE response IS NOT NULL) r
  ON d.doc_id = r.request_id
""", "template_replies"), ("J2",))
def q_join_requests_responses(spark, sf):
    reqs = table(spark, sf, "documents").select(F.col("doc_id").alias("request_id"))
    resp = view(spark, sf, "template_replies").filter(F.col("response").isNotNull())
    j = C.join_requests_responses(reqs, resp)
    return j.select("request_id", F.length("response").alias("response_chars"), "failed")


@register("failed_requests", with_views("""
SELECT d.doc_id AS request_id FROM documents d
LEFT JOIN (SELECT * FROM template_replies WHERE response IS NOT NULL) r ON d.doc_id = r.request_id
WHERE r.response IS NULL
""", "template_replies"), ("A8",))
def q_failed_requests(spark, sf):
    reqs = table(spark, sf, "documents").select(F.col("doc_id").alias("request_id"))
    resp = view(spark, sf, "template_replies").filter(F.col("response").isNotNull())
    return C.failed_requests(C.join_requests_responses(reqs, resp))


_SOLVED_SQL = f"""
SELECT task_id FROM summaries
WHERE model = 'ref' AND num_runs >= 4 AND num_success > 0
  AND (4 > num_runs - num_success OR 1.0 - list_reduce(list_transform(range(CAST(num_runs - num_success + 1 AS BIGINT), CAST(num_runs + 1 AS BIGINT)),
       lambda i: 1.0 - 4.0 / CAST(i AS DOUBLE)), lambda a, b: a * b, 1.0) > 0)
"""


def solved_tasks(spark, sf, k: int = 4):
    """Tasks whose reference-model pass@k > 0 (lenient: no key for k -> dropped)."""
    s = view(spark, sf, "summaries").filter(F.col("model") == "ref")
    p = TR.pass_at_k(s, ks=[k])
    return p.filter(F.col("pass_at_k") > 0).select("task_id")


@register("semi_join_solved", with_views(f"""
SELECT task_id FROM bundles WHERE lang || '-' || source IN ({_SOLVED_SQL})
""", "bundles", "summaries"), ("J3",))
def q_semi_join_solved(spark, sf):
    b = view(spark, sf, "bundles").withColumn("task_key", F.concat_ws("-", "lang", "source"))
    solved = solved_tasks(spark, sf).withColumnRenamed("task_id", "task_key")
    return C.semi_join_solved(b, solved, "task_key").select("task_id")


@register("anti_join_already_run", with_views("""
SELECT task_id FROM bundles b
WHERE NOT EXISTS (SELECT 1 FROM summaries s WHERE s.model = 'cand' AND s.task_id = b.lang || '-' || b.source)
""", "bundles", "summaries"), ("J4",))
def q_anti_join_already_run(spark, sf):
    b = view(spark, sf, "bundles").withColumn("task_key", F.concat_ws("-", "lang", "source"))
    return C.anti_join_already_run(b, view(spark, sf, "summaries"), "cand", "task_key").select("task_id")


@register("lookup_task_description", with_views("""
SELECT c.task_id, b.description FROM conversion_results c JOIN bundles b ON c.task_id = b.task_id
WHERE c.tests_passed
""", "bundles", "conversion_results"), ("J6",))
def q_lookup_task_description(spark, sf):
    passed = view(spark, sf, "conversion_results").filter("tests_passed").select("task_id")
    return C.lookup_task_description(passed, view(spark, sf, "bundles"))


@register("union_batches", with_views(f"""
SELECT * FROM (
  SELECT 'replies' AS batch, CAST(request_id AS VARCHAR) AS task_key,
         {D.py_strip(D.regexp_extract('response', T.TASK_RE))} AS description,
         {D.py_strip(D.regexp_extract('response', T.TRUTH_RE))} AS truth
  FROM template_replies
  UNION ALL
  SELECT 'bundles', task_id, description, truth FROM bundles) u
WHERE {_truthy('description')} AND {_truthy('truth')}
""", "bundles", "template_replies"), ("X1",))
def q_union_batches(spark, sf):
    from drover.operators.extract import extract_templates
    a = extract_templates(view(spark, sf, "template_replies")).select(
        F.lit("replies").alias("batch"), F.col("request_id").cast("string").alias("task_key"),
        "description", "truth")
    b = view(spark, sf, "bundles").select(F.lit("bundles").alias("batch"), F.col("task_id").alias("task_key"),
                                          "description", "truth")
    return C.union_batches(a, b)


_REPORT_COLS = "task_id, success, dockerfile_generated, docker_build_success, tests_passed"
_REPORTS_SQL = f"""
SELECT DISTINCT * FROM (
  SELECT {_REPORT_COLS} FROM conversion_results
  UNION ALL
  SELECT task_id, dockerfile_generated, dockerfile_generated, dockerfile_generated, tests_passed
  FROM conversion_results WHERE exit_code = 137) u
"""


def _reports(spark, sf):
    c = view(spark, sf, "conversion_results")
    first = c.select(*[x.strip() for x in _REPORT_COLS.split(",")])
    retry = c.filter(F.col("exit_code") == 137).select(
        "task_id", F.col("dockerfile_generated").alias("success"), "dockerfile_generated",
        F.col("dockerfile_generated").alias("docker_build_success"), "tests_passed")
    return C.union_reports(first, retry)


@register("union_reports", with_views(_REPORTS_SQL, "conversion_results"), ("X2"))
def q_union_reports(spark, sf):
    return _reports(spark, sf)


@register("distinct_failed_tasks", with_views(f"""
SELECT DISTINCT task_id FROM ({_REPORTS_SQL}) r WHERE NOT coalesce(success, false)
""", "conversion_results"), ("A7",))
def q_distinct_failed_tasks(spark, sf):
    from drover.operators.funnel import distinct_failed_tasks
    return distinct_failed_tasks(_reports(spark, sf))
