"""Readers and writers for task bundles, run summaries, conversion reports,
train/validation sets, task manifests and benchmark results/logs.

The idiomatic storage for everything here is a partitioned table (Parquet or
JSON Lines), written and read in parallel.  The per-task directory layout of
the original tools (many tiny files) is supported for interchange: it is read
with one distributed ``wholetext`` scan and written by each partition for its
own tasks, never through the driver.
"""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drover.functions import text as T
from drover.sources.packed import filesystem, read_task_files

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference behaviour): bundle member files and
# the record formats of the files the tools read and write.
TASK_JSON = "task.json"
INITIAL_TEST = "test_initial_state.py"
FINAL_TEST = "test_final_state.py"
CONTAINER_DEF = "container.def"
CONTAINER_IMAGE = "container.sif"
SOLUTIONS_DIR = "solutions"
SUMMARY_SUFFIX = "_summary.json"
BENCHMARK_HEADER = ["task_name", "reward", "errors", "exit_code"]
BENCHMARK_NULL = "NA"

MEMBER_COLUMNS = {TASK_JSON: "task_json", INITIAL_TEST: "initial_test",
                  FINAL_TEST: "final_test", CONTAINER_DEF: "container_def"}

TASK_JSON_SCHEMA = "description STRING, truth STRING, name STRING"
SUMMARY_SCHEMA = ("num_runs INT, num_success INT, pass_at_k MAP<STRING, DOUBLE>, "
                  "results ARRAY<STRUCT<success: BOOLEAN, messages: ARRAY<STRUCT<role: STRING, content: STRING>>, "
                  "output: STRING, reward: INT>>")
RESULT_STRUCT = ("task_dir STRING, success BOOLEAN, error STRING, dockerfile_generated BOOLEAN, "
                 "docker_build_success BOOLEAN, tests_passed BOOLEAN")
MANIFEST_SCHEMA = ("task_id STRING, instruction STRING, metadata STRUCT<difficulty: STRING, category: STRING>, "
                   "config STRUCT<verifier_timeout_sec: DOUBLE, agent_timeout_sec: DOUBLE, "
                   "environment: STRUCT<build_timeout_sec: DOUBLE, cpus: INT, memory_mb: INT, storage_mb: INT>>")
BENCHMARK_SCHEMA = "task_name STRING, reward DOUBLE, errors INT, exit_code INT"
# ---------------------------------------------------------------------------

NAME_RULES = {
    "prefix": lambda n: n.startswith("task_"),
    "contains": lambda n: n.contains("task"),
    "contains_ci": lambda n: F.lower(n).contains("task"),
    "not_hidden": lambda n: ~(n.startswith(".") | n.startswith("__")),
}


def _decoded(c):
    """File names/paths from ``_metadata`` are URI-encoded (``#`` -> ``%23``)."""
    return F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))


def _local(path: str) -> str:
    return path[len("file:"):] if path.startswith("file:") else path


# S7 --------------------------------------------------------------------------
def write_task_bundles(bundles: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Bundle table as Parquet.  AQE sizes the writers' partitions by the data's
    volume, splitting large and joining small ones."""
    cols = ["task_id", "description", "truth", "initial_test", "final_test", "container_def"]
    bundles.select(*cols).hint("rebalance").write.mode(mode).parquet(path)


def read_task_bundles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _writer(root: str):
    """A function ``write(relative_path, text)`` for any filesystem pyarrow
    knows (local paths, ``file://``, ``s3://``, ``hdfs://``); built on the
    executor that uses it.  A folder is made once for the files that follow
    each other in it."""
    fs, base = filesystem(root)
    last = None

    def write(rel: str, text: str) -> None:
        nonlocal last
        path = f"{base.rstrip('/')}/{rel}"
        folder = path.rsplit("/", 1)[0]
        if folder != last:
            fs.create_dir(folder, recursive=True)
            last = folder
        with fs.open_output_stream(path) as fh:
            fh.write(text.encode("utf-8"))

    return write


SUMMARY_MEMBER = f"{SOLUTIONS_DIR}/summary.json"


def export_task_directories(bundles: DataFrame, root: str, members: list[str] | None = None) -> None:
    """Directory layout (one folder per task with the member files and an empty
    run summary), written in parallel by the partition that holds each task;
    ``members`` names the files to write (all).  A retried task rewrites the same
    files (idempotent)."""
    cols = {TASK_JSON: ["description", "truth"], INITIAL_TEST: ["initial_test"], FINAL_TEST: ["final_test"],
            CONTAINER_DEF: ["container_def"], SUMMARY_MEMBER: []}
    wanted = [m for m in cols if members is None or m in members]

    def write_partition(rows):
        write = _writer(root)
        for r in rows:
            for name in wanted:
                if name == TASK_JSON:
                    text = json.dumps({"description": r["description"], "truth": r["truth"], "name": r["task_id"]}, indent=4)
                else:
                    text = r[cols[name][0]] if cols[name] else json.dumps({}, indent=4)
                if text is not None:
                    write(f"{r['task_id']}/{name}", text)

    bundles.select("task_id", *(c for m in wanted for c in cols[m])).foreachPartition(write_partition)


# S1 / S6 ---------------------------------------------------------------------------
def scan_task_bundles(spark: SparkSession, root: str, name_rule: str = "prefix", packed: bool = False) -> DataFrame:
    """One row per task directory under ``root`` with its member files.  The
    directory-name rule is one of ``prefix`` (``task_``), ``contains``
    (``task``), ``contains_ci`` and ``not_hidden``.  ``packed`` reads through the
    Python data source, which packs small files into partitions by size and
    opens nothing but the members; the default reads with Spark's text source,
    whose file systems may be others than pyarrow's."""
    if packed:
        files = read_task_files(spark, root, name_rule, list(MEMBER_COLUMNS)).select("task_id", "member", F.col("content").alias("value"))
    else:
        if "://" not in root and not root.startswith("file:"):
            root = os.path.abspath(root)
        files = (spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True)
                 .load(root).select("value", _decoded(F.col("_metadata.file_path")).alias("path")))
        base = _local(root).rstrip("/")
        rel = F.regexp_extract("path", "^(?:file:)?" + _quote(base) + "/(.*)$", 1)
        files = files.select("value", F.regexp_extract(rel, "^([^/]+)/", 1).alias("task_id"),
                             F.regexp_extract(rel, "^[^/]+/(.+)$", 1).alias("member"))
        files = files.filter(NAME_RULES[name_rule](F.col("task_id")) & F.col("member").isin(*MEMBER_COLUMNS))
    # fixed member list: conditional aggregation instead of an open pivot
    tasks = files.groupBy("task_id").agg(*[
        F.max(F.when(F.col("member") == m, F.col("value"))).alias(c) for m, c in MEMBER_COLUMNS.items()])
    meta = F.from_json("task_json", TASK_JSON_SCHEMA)
    return tasks.select("task_id",
                        T.py_strip(F.coalesce(meta["description"], F.lit(""))).alias("description"),
                        meta["truth"].alias("truth"), meta["name"].alias("name"),
                        "initial_test", "final_test", "container_def")


def _quote(s: str) -> str:
    return "".join("\\" + ch if ch in r"\.^$|?*+()[]{}" else ch for ch in s)


def scan_task_json(spark: SparkSession, root: str, packed: bool = False) -> DataFrame:
    """Description of every ``task.json`` (missing -> empty, then stripped)."""
    if packed:
        df = read_task_files(spark, root, "not_hidden", [TASK_JSON]) \
            .select("task_id", F.from_json("content", TASK_JSON_SCHEMA).alias("r")).select("task_id", "r.*")
    else:
        df = (spark.read.schema(TASK_JSON_SCHEMA).option("multiLine", True)
              .json(f"{root.rstrip('/')}/*/{TASK_JSON}")
              .withColumn("task_id", F.regexp_extract(_decoded(F.col("_metadata.file_path")), r"([^/]+)/[^/]+$", 1)))
    return df.select("task_id", T.py_strip(F.coalesce(F.col("description"), F.lit(""))).alias("description"),
                     "truth", "name")


# S8 / S3 ---------------------------------------------------------------------------
def model_file_name(model) -> F.Column:
    """Model name as used in summary file names (``/`` -> ``_``)."""
    return F.replace(F.col(model) if isinstance(model, str) else model, F.lit("/"), F.lit("_"))


def summaries_with_map(rollup: DataFrame, long_pass: DataFrame, keys=("task_id", "model")) -> DataFrame:
    """Attach ``pass_at_k`` as a map with string keys (as JSON stores it)."""
    m = long_pass.groupBy(*keys).agg(F.map_from_entries(F.collect_list(
        F.struct(F.col("k").cast("string"), F.col("pass_at_k")))).alias("pass_at_k"))
    return rollup.join(m, list(keys), "left")


def write_run_summaries(summaries: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON record per (task, model), partitioned by model file name."""
    summaries.withColumn("model_file", model_file_name("model")).drop("model") \
        .write.mode(mode).partitionBy("model_file").json(path)


def scan_run_summaries(spark: SparkSession, path: str) -> DataFrame:
    schema = "task_id STRING, num_runs INT, num_success INT, pass_at_k MAP<STRING, DOUBLE>, model_file STRING"
    return spark.read.schema(schema).json(path).withColumnRenamed("model_file", "model")


def write_solution_summaries(summaries: DataFrame, root: str) -> None:
    """The per-task layout: ``<root>/<task>/solutions/<model>_summary.json``, ``/``
    in the model's name as ``_``; written by the partition that holds the row."""
    fields = [c for c in ("num_runs", "num_success", "pass_at_k", "results") if c in summaries.columns]
    rows = summaries.select("task_id", model_file_name("model").alias("model"), F.to_json(F.struct(*fields)).alias("text"))

    def write_partition(part):
        write = _writer(root)
        for r in part:
            write(f"{r['task_id']}/{SOLUTIONS_DIR}/{r['model']}{SUMMARY_SUFFIX}", r["text"])

    rows.foreachPartition(write_partition)


def scan_solution_summaries(spark: SparkSession, root: str, packed: bool = False) -> DataFrame:
    """Summaries in the per-task layout ``<root>/<task>/solutions/<model>_summary.json``;
    an absent file simply gives no row."""
    if packed:
        df = read_task_files(spark, root, "not_hidden", [f"{SOLUTIONS_DIR}/*{SUMMARY_SUFFIX}"]) \
            .select("task_id", "member", F.from_json("content", SUMMARY_SCHEMA).alias("r")) \
            .select("task_id", "r.*", F.concat(F.lit("/"), "member").alias("path"))
    else:
        df = (spark.read.schema(SUMMARY_SCHEMA).option("multiLine", True)
              .json(f"{root.rstrip('/')}/*/{SOLUTIONS_DIR}/*{SUMMARY_SUFFIX}")
              .withColumn("path", _decoded(F.col("_metadata.file_path"))))
        df = df.withColumn("task_id", F.regexp_extract("path", r"([^/]+)/" + SOLUTIONS_DIR + r"/[^/]+$", 1))
    return df.select("task_id", F.regexp_extract("path", r"/([^/]+)" + _quote(SUMMARY_SUFFIX) + "$", 1).alias("model"),
                     "num_runs", "num_success", "pass_at_k", "results")


# S10 / S4 ---------------------------------------------------------------------------
def write_conversion_report(results: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Summary (one row) and results (JSON Lines, in parallel) side by side."""
    from drover.operators.funnel import stage_funnel
    cols = [c for c in ("total", "successful", "failed", "dockerfile_generated", "docker_build_success",
                        "tests_passed", "errors_dockerfile", "errors_build", "errors_tests")]
    stage_funnel(results).select(F.struct(*[F.col(c).cast("int") for c in cols]).alias("summary")) \
        .coalesce(1).write.mode(mode).json(f"{path}/summary")
    results.write.mode(mode).json(f"{path}/results")


def scan_conversion_reports(spark: SparkSession, pattern: str) -> DataFrame:
    """All ``results`` elements of report documents matching ``pattern`` (the
    original one-document-per-run format), unioned.  A result without the key
    ``success`` counts as a success; an explicit null stays null (a failure)."""
    docs = spark.read.schema("results ARRAY<STRING>").option("multiLine", True).json(pattern)
    r = docs.select(F.explode("results").alias("_text")).select("_text", F.from_json("_text", RESULT_STRUCT).alias("r"))
    told = F.array_contains(F.json_object_keys("_text"), "success")
    return r.select("r.*", "_text").withColumn("success", F.when(told, F.col("success")).otherwise(F.lit(True))) \
        .drop("_text")


def scan_conversion_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RESULT_STRUCT).json(f"{path}/results")


# S9 / S5 ---------------------------------------------------------------------------
def write_train_validation(rows: DataFrame, out_dir: str, mode: str = "overwrite") -> None:
    """Both files of the split.  The rows are computed once, into the shared
    checkpoint folder, and written from there."""
    from drover.session import checkpoint_root
    checkpoint_root(rows.sparkSession)
    rows = rows.checkpoint(eager=True)
    for split, name in (("train", "train.parquet"), ("validation", "validation.parquet")):
        rows.filter(F.col("split") == split).drop("split").write.mode(mode).parquet(f"{out_dir}/{name}")


def scan_train_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Task directories listed by a train/validation file (nested column
    pruning reads only ``extra_info.task_dir``)."""
    return spark.read.parquet(path).select(F.col("extra_info.task_dir").alias("task_dir"))


# S2 --------------------------------------------------------------------------
def scan_task_manifest(spark: SparkSession, path: str, json_array: bool = True) -> DataFrame:
    """Nested task records, flattened: a JSON array document (the original
    manifest) or JSON Lines (``json_array=False``, as written here)."""
    df = spark.read.schema(MANIFEST_SCHEMA).option("multiLine", json_array).json(path)
    return df.select("task_id", "instruction",
                     F.col("metadata.difficulty").alias("difficulty"),
                     F.col("metadata.category").alias("category"),
                     F.col("config.verifier_timeout_sec").alias("verifier_timeout_sec"),
                     F.col("config.agent_timeout_sec").alias("agent_timeout_sec"),
                     F.col("config.environment.build_timeout_sec").alias("build_timeout_sec"),
                     F.col("config.environment.cpus").alias("cpus"),
                     F.col("config.environment.memory_mb").alias("memory_mb"),
                     F.col("config.environment.storage_mb").alias("storage_mb"))


def write_task_manifest(tasks: DataFrame, path: str, mode: str = "overwrite", json_array: bool = False) -> None:
    """Manifest records as JSON Lines, or as JSON array documents, one per file
    of at most 1,000 records (both readable by ``scan_task_manifest``)."""
    if not json_array:
        tasks.write.mode(mode).json(path)
        return
    rows = tasks.select(F.floor(F.monotonically_increasing_id() / 1000).alias("part"), F.struct(*tasks.columns).alias("record"))
    rows.groupBy("part").agg(F.to_json(F.collect_list("record")).alias("value")).select("value") \
        .write.mode(mode).option("maxRecordsPerFile", 1).text(path)


# S11 / S12 --------------------------------------------------------------------------
def append_benchmark_results(scores: DataFrame, path: str, mode: str = "append") -> None:
    """Append ``task_name,reward,errors,exit_code`` rows (missing -> ``NA``)."""
    scores.select(*BENCHMARK_HEADER).write.mode(mode).option("header", True) \
        .option("nullValue", BENCHMARK_NULL).csv(path)


def scan_benchmark_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BENCHMARK_SCHEMA).option("header", True) \
        .option("nullValue", BENCHMARK_NULL).csv(path)


def write_benchmark_logs(logs: DataFrame, root: str, key: str = "task_name", log: str = "log") -> None:
    """One ``<task>.log`` file per task, written by the partition holding it."""
    def write_partition(rows):
        write = _writer(root)
        for r in rows:
            write(f"{r[key]}.log", r[log] if r[log] is not None else "")

    logs.select(key, log).foreachPartition(write_partition)


def scan_benchmark_logs(spark: SparkSession, pattern: str) -> DataFrame:
    """One row per log file; the file name (without ``.log``) is the task."""
    df = spark.read.format("text").option("wholetext", True).load(pattern)
    return df.select(F.regexp_replace(_decoded(F.col("_metadata.file_name")), r"\.log$", "").alias("task_name"),
                     F.col("value").alias("log"))

