"""Round trips through the sinks and sources: each query writes Spark-derived
data from the driver tables to the shared checkpoint folder and reads it back
with the matching source, so the oracle is the data that went in."""

from __future__ import annotations

from pyspark.sql import functions as F

from drover.functions import text as T
from drover.operators import curate as C
from drover.operators import funnel as FU
from drover.operators import trajectory as TR
from drover.plans import duck as D
from drover.plans.dataset_queries import _TRAIN_SQL, train_rows
from drover.plans.fixtures import table, view, with_views
from drover.plans.registry import register
from drover.session import shared_path
from drover.sources import files as S



def _complete(spark, sf):
    """Complete bundles with stripped description/truth (what generation saves)."""
    b = C.filter_stage_survivors(view(spark, sf, "bundles"))
    return b.withColumn("description", T.py_strip("description")).withColumn("truth", T.py_strip("truth"))


def _complete_sql():
    from drover.plans.curation_queries import _REJECT_SQL
    return f"""
SELECT task_id, {D.py_strip('description')} AS description, {D.py_strip('truth')} AS truth,
       initial_test, final_test, container_def
FROM bundles WHERE ({_REJECT_SQL}) IS NULL
"""


@register("bundle_round_trip", with_views(_complete_sql(), "bundles"), ("S7", "S1"))
def q_bundle_round_trip(spark, sf):
    path = shared_path(spark, "bundles")
    S.write_task_bundles(_complete(spark, sf), path)
    return S.read_task_bundles(spark, path)


@register("bundle_directory_round_trip", with_views(f"""
SELECT task_id, description, truth, task_id AS name, initial_test, final_test, container_def
FROM ({_complete_sql()}) c
""", "bundles"), ("S7", "S1"))
def q_bundle_directory_round_trip(spark, sf):
    root = shared_path(spark, "taskdirs")
    S.export_task_directories(_complete(spark, sf), root)
    return S.scan_task_bundles(spark, root, "prefix", packed=True)


# every document's task under a folder name of its own kind
_FOLDER = """CASE doc_id % 6 WHEN 0 THEN concat('task_', cast(doc_id AS varchar(20))) WHEN 1 THEN concat('my-task-', cast(doc_id AS varchar(20)))
    WHEN 2 THEN concat('Big_TASK_', cast(doc_id AS varchar(20))) WHEN 3 THEN concat('.task_', cast(doc_id AS varchar(20)))
    WHEN 4 THEN concat('__task_', cast(doc_id AS varchar(20))) ELSE concat('other_', cast(doc_id AS varchar(20))) END"""


@register("directory_name_rules", with_views(f"""
SELECT rule, task_id, {D.py_strip("coalesce(description, '')")} AS description
FROM (SELECT {_FOLDER} AS task_id, description FROM bundles) b, (SELECT unnest(['prefix', 'contains', 'contains_ci', 'not_hidden']) AS rule) r
WHERE CASE rule WHEN 'prefix' THEN starts_with(task_id, 'task_') WHEN 'contains' THEN contains(task_id, 'task')
      WHEN 'contains_ci' THEN contains(lower(task_id), 'task') ELSE NOT starts_with(task_id, '.') AND NOT starts_with(task_id, '__') END
""", "bundles"), ("S1",))
def q_directory_name_rules(spark, sf):
    root = shared_path(spark, "folders")
    b = view(spark, sf, "bundles").select(F.expr(_FOLDER).alias("task_id"), "description", "truth")
    S.export_task_directories(b, root, members=[S.TASK_JSON])
    out = None
    for rule in S.NAME_RULES:
        one = S.scan_task_bundles(spark, root, rule, packed=True).select(F.lit(rule).alias("rule"), "task_id", "description")
        out = one if out is None else out.unionByName(one)
    return out


@register("solution_summaries_round_trip", with_views("""
SELECT task_id, model || '_x' AS model, CAST(num_runs AS INTEGER) AS num_runs, CAST(num_success AS INTEGER) AS num_success,
       CAST(num_runs AS INTEGER) AS n_keys FROM summaries
""", "summaries"), ("S3", "S8"))
def q_solution_summaries_round_trip(spark, sf):
    s = view(spark, sf, "summaries").select("task_id", F.concat("model", F.lit("/x")).alias("model"),
                                            F.col("num_runs").cast("int"), F.col("num_success").cast("int"))
    root = shared_path(spark, "solutions")
    S.write_solution_summaries(S.summaries_with_map(s, TR.pass_at_k(s)), root)
    back = S.scan_solution_summaries(spark, root, packed=True)
    return back.select("task_id", "model", "num_runs", "num_success", F.size("pass_at_k").alias("n_keys"))


@register("summary_round_trip", with_views(f"""
SELECT task_id, model, CAST(num_runs AS INTEGER) AS num_runs, CAST(num_success AS INTEGER) AS num_success,
       CAST(num_runs AS INTEGER) AS n_keys,
       round(CASE WHEN num_runs < 4 THEN NULL WHEN num_success <= 0 THEN 0.0
                  WHEN 4 > num_runs - num_success THEN 1.0
                  ELSE 1.0 - list_reduce(list_transform(range(CAST(num_runs - num_success + 1 AS BIGINT),
                       CAST(num_runs + 1 AS BIGINT)), lambda i: 1.0 - 4.0 / CAST(i AS DOUBLE)),
                       lambda a, b: a * b, 1.0) END, 9) AS pass_at_4
FROM summaries
""", "summaries"), ("S8", "S3", "A2"))
def q_summary_round_trip(spark, sf):
    s = view(spark, sf, "summaries").select(
        "task_id", "model", F.col("num_runs").cast("int").alias("num_runs"),
        F.col("num_success").cast("int").alias("num_success"))
    with_map = S.summaries_with_map(s, TR.pass_at_k(s))
    path = shared_path(spark, "summaries")
    S.write_run_summaries(with_map, path)
    back = S.scan_run_summaries(spark, path)
    return back.select("task_id", "model", "num_runs", "num_success", F.size("pass_at_k").alias("n_keys"),
                       F.round(F.col("pass_at_k")["4"], 9).alias("pass_at_4"))


@register("train_parquet_round_trip", with_views(f"""
SELECT extra_task_dir AS task_dir, split FROM ({_TRAIN_SQL}) t
""", "bundles", "conversion_results"), ("S9", "S5"))
def q_train_parquet_round_trip(spark, sf):
    out = shared_path(spark, "train")
    S.write_train_validation(train_rows(spark, sf), out)
    train = S.scan_train_parquet(spark, f"{out}/train.parquet").withColumn("split", F.lit("train"))
    val = S.scan_train_parquet(spark, f"{out}/validation.parquet").withColumn("split", F.lit("validation"))
    return train.unionByName(val)


_MANIFEST_SQL = with_views("""
SELECT task_id, description AS instruction, lang AS difficulty, source AS category,
       CAST(300.0 AS DOUBLE) AS verifier_timeout_sec, CAST(300.0 AS DOUBLE) AS agent_timeout_sec,
       CAST(600.0 AS DOUBLE) AS build_timeout_sec,
       1 AS cpus, 2048 AS memory_mb, 10240 AS storage_mb
FROM bundles
""", "bundles")


def _manifest(spark, sf):
    b = view(spark, sf, "bundles")
    return b.select("task_id", F.col("description").alias("instruction"),
                 F.struct(F.col("lang").alias("difficulty"), F.col("source").alias("category")).alias("metadata"),
                 F.struct(F.lit(300.0).alias("verifier_timeout_sec"), F.lit(300.0).alias("agent_timeout_sec"),
                          F.struct(F.lit(600.0).alias("build_timeout_sec"), F.lit(1).alias("cpus"),
                                   F.lit(2048).alias("memory_mb"), F.lit(10240).alias("storage_mb"))
                          .alias("environment")).alias("config"))


@register("manifest_round_trip", _MANIFEST_SQL, ("S2",))
def q_manifest_round_trip(spark, sf):
    path = shared_path(spark, "manifest")
    S.write_task_manifest(_manifest(spark, sf), path)
    return S.scan_task_manifest(spark, path, json_array=False)


@register("manifest_array_round_trip", _MANIFEST_SQL, ("S2",))
def q_manifest_array_round_trip(spark, sf):
    path = shared_path(spark, "manifest-array")
    S.write_task_manifest(_manifest(spark, sf), path, json_array=True)
    return S.scan_task_manifest(spark, f"{path}/*.txt")


@register("conversion_report_round_trip", with_views("""
SELECT task_id AS task_dir, success, NULL::VARCHAR AS error, dockerfile_generated, docker_build_success, tests_passed
FROM conversion_results
""", "conversion_results"), ("S10",))
def q_conversion_report_round_trip(spark, sf):
    r = view(spark, sf, "conversion_results").select(
        F.col("task_id").alias("task_dir"), "success", F.lit(None).cast("string").alias("error"),
        "dockerfile_generated", "docker_build_success", "tests_passed")
    path = shared_path(spark, "report")
    S.write_conversion_report(r, path)
    return S.scan_conversion_results(spark, path)


@register("benchmark_results_round_trip", with_views(f"""
SELECT s.s_name AS task_name, TRY_CAST(r.reward_text AS DOUBLE) AS reward, r.errors,
       CASE WHEN TRY_CAST(r.reward_text AS DOUBLE) IS NULL THEN 1 ELSE 0 END AS exit_code
FROM supplier s LEFT JOIN (
  SELECT task_name, nullif({D.regexp_extract('log', T.REWARD_RE)}, '') AS reward_text,
         TRY_CAST(nullif({D.regexp_extract('log', T.ERRORS_RE)}, '') AS INTEGER) AS errors
  FROM benchmark_logs) r ON s.s_name = r.task_name
""", "benchmark_logs"), ("S12", "S11", "R7"))
def q_benchmark_results_round_trip(spark, sf):
    logs_dir = shared_path(spark, "logs")
    S.write_benchmark_logs(view(spark, sf, "benchmark_logs"), logs_dir)
    logs = S.scan_benchmark_logs(spark, f"{logs_dir}/*.log")
    tasks = table(spark, sf, "supplier").select(F.col("s_name").alias("task_name"))
    scores = FU.benchmark_scores(logs, tasks).withColumn(
        "exit_code", F.when(F.col("reward").isNull(), 1).otherwise(0))
    csv = shared_path(spark, "results_csv")
    S.append_benchmark_results(scores, csv)
    return S.scan_benchmark_results(spark, csv)


@register("task_json_round_trip", with_views(f"""
SELECT task_id, description, truth, task_id AS name FROM ({_complete_sql()}) c
""", "bundles"), ("S6",))
def q_task_json_round_trip(spark, sf):
    root = shared_path(spark, "taskjson")
    S.export_task_directories(_complete(spark, sf), root, members=[S.TASK_JSON])
    return S.scan_task_json(spark, root, packed=True)


@register("conversion_documents", with_views("""
SELECT task_id AS task_dir, success, CAST(NULL AS VARCHAR) AS error, dockerfile_generated, docker_build_success, tests_passed
FROM conversion_results
""", "conversion_results"), ("S4",))
def q_conversion_documents(spark, sf):
    """Report documents of at most 1,000 results each (one per file), read back as one union."""
    r = view(spark, sf, "conversion_results")
    row = F.struct(F.col("task_id").alias("task_dir"), "success", F.lit(None).cast("string").alias("error"),
                   "dockerfile_generated", "docker_build_success", "tests_passed")
    docs = r.withColumn("run", F.floor(F.monotonically_increasing_id() / 1000)).groupBy("run").agg(F.collect_list(row).alias("results"))
    path = shared_path(spark, "documents")
    docs.select(F.struct(F.size("results").alias("total")).alias("summary"), "results") \
        .withColumn("value", F.to_json(F.struct("summary", "results"), {"ignoreNullFields": "false"})).select("value") \
        .write.option("maxRecordsPerFile", 1).text(path)
    return S.scan_conversion_reports(spark, f"{path}/*.txt")


@register("error_texts", with_views("SELECT task_name, substr(log, 1, 500) AS error FROM benchmark_logs",
                                    "benchmark_logs"), ("F25", "U3"))
def q_error_texts(spark, sf):
    from drover.functions.sql import register_sql_functions
    register_sql_functions(spark)
    return spark.sql("SELECT task_name, truncate_error(log) AS error FROM {logs}",
                     logs=view(spark, sf, "benchmark_logs"))


def _echo_client():
    """A deterministic client: the number of messages and the last one; an empty request fails."""
    def client(messages):
        if not messages[-1]["content"]:
            raise ValueError("empty request")
        return str(len(messages)) + ":" + messages[-1]["content"]
    return client


@register("completions", """
SELECT conv_id, turn, CASE WHEN role = 'user' THEN NULLIF('2:' || text, '2:') END AS response,
       CASE WHEN role = 'user' AND text <> '' THEN CAST(NULL AS VARCHAR) ELSE 'empty request' END AS error,
       CASE WHEN role = 'user' AND text <> '' THEN 1 ELSE 2 END AS attempts
FROM conversations
""", ("U1",))
def q_completions(spark, sf):
    from drover.operators import inference as INF
    content = F.when(F.col("role") == "user", F.col("text")).otherwise(F.lit(""))
    message = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    requests = table(spark, sf, "conversations").select(
        "conv_id", "turn", F.array(message("system", F.lit("echo")), message("user", content)).alias("messages"))
    done = INF.persist_completions(INF.with_completions(requests, _echo_client, max_retries=2, sleep=lambda s: None))
    return done.select("conv_id", "turn", "response", "error", "attempts")


@register("counted_tokens", """
SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '[A-Za-z]+')) AS BIGINT) AS n_tokens FROM documents
""", ("U2",))
def q_counted_tokens(spark, sf):
    from drover.operators.inference import count_tokens

    def tokenizer():
        import re
        return re.compile("[A-Za-z]+").findall

    return table(spark, sf, "documents").select("doc_id", count_tokens(tokenizer)("text").alias("n_tokens"))
