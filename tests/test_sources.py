"""Sources and sinks: round trips and the original on-disk formats."""

import json
import os

from drover.sources import files as S


def test_reference_style_report_documents(spark, tmpdir_path):
    doc = {"summary": {"total": 3, "successful": 1, "failed": 2, "dockerfile_generated": 3,
                       "docker_build_success": 2, "tests_passed": 1, "errors_dockerfile": 0,
                       "errors_build": 1, "errors_tests": 1},
           "results": [{"task_dir": "/t/a", "success": True, "error": None, "dockerfile_generated": True,
                        "docker_build_success": True, "tests_passed": True},
                       {"task_dir": "/t/b", "success": False, "error": "x", "dockerfile_generated": True,
                        "docker_build_success": False, "tests_passed": False},
                       {"task_dir": "/t/c", "dockerfile_generated": True}]}
    for name in ("retry_1.json", "retry_2.json"):
        with open(os.path.join(tmpdir_path, name), "w") as fh:
            json.dump(doc, fh, indent=2)
    res = S.scan_conversion_reports(spark, f"{tmpdir_path}/retry*.json")
    assert res.count() == 6
    from drover.operators.funnel import distinct_failed_tasks
    assert {r.task_id for r in distinct_failed_tasks(res.withColumnRenamed("task_dir", "task_id")).collect()} == {"/t/b"}


def test_directory_layout_name_rules(spark, tmpdir_path):
    rows = [("task_a", "d1 ", "t1", "i", "f", "c"), ("my_task_b", "d2", "t2", "i", "f", "c"),
            ("TASK_c", "d3", "t3", "i", "f", "c"), ("__pycache__", "x", "x", "i", "f", "c")]
    df = spark.createDataFrame(rows, "task_id string, description string, truth string, initial_test string, "
                                     "final_test string, container_def string")
    S.export_task_directories(df, tmpdir_path)
    ids = lambda rule: {r.task_id for r in S.scan_task_bundles(spark, tmpdir_path, rule).collect()}  # noqa
    assert ids("prefix") == {"task_a"}
    assert ids("contains") == {"task_a", "my_task_b"}
    assert ids("contains_ci") == {"task_a", "my_task_b", "TASK_c"}
    assert ids("not_hidden") == {"task_a", "my_task_b", "TASK_c"}
    row = S.scan_task_bundles(spark, tmpdir_path, "prefix").collect()[0]
    assert row.description == "d1" and row.name == "task_a"
    desc = {r.task_id: r.description for r in S.scan_task_json(spark, tmpdir_path).collect()}
    assert desc["task_a"] == "d1"


def test_solution_summaries_layout(spark, tmpdir_path):
    os.makedirs(f"{tmpdir_path}/task_1/solutions")
    os.makedirs(f"{tmpdir_path}/task_2/solutions")
    with open(f"{tmpdir_path}/task_1/solutions/org_model-x_summary.json", "w") as fh:
        json.dump({"num_runs": 2, "num_success": 1, "pass_at_k": {"1": 0.5, "2": 1.0}, "results": []}, fh)
    got = S.scan_solution_summaries(spark, tmpdir_path).collect()
    assert [(r.task_id, r.model, r.pass_at_k["2"]) for r in got] == [("task_1", "org_model-x", 1.0)]


def test_manifest_array(spark, tmpdir_path):
    doc = [{"task_id": "task_000000_x", "instruction": "do",
            "metadata": {"difficulty": "easy", "category": "programming"},
            "config": {"verifier_timeout_sec": 300.0, "agent_timeout_sec": 300.0,
                       "environment": {"build_timeout_sec": 600.0, "cpus": 1, "memory_mb": 2048,
                                       "storage_mb": 10240}}}] * 3
    with open(f"{tmpdir_path}/tasks.json", "w") as fh:
        json.dump(doc, fh)
    rows = S.scan_task_manifest(spark, f"{tmpdir_path}/tasks.json").collect()
    assert len(rows) == 3 and rows[0].memory_mb == 2048 and rows[0].category == "programming"


def test_benchmark_csv_na(spark, tmpdir_path):
    df = spark.createDataFrame([("a", 0.5, 1, 0), ("b", None, None, 1)],
                               "task_name string, reward double, errors int, exit_code int")
    S.append_benchmark_results(df, tmpdir_path)
    S.append_benchmark_results(df.limit(1), tmpdir_path)
    back = S.scan_benchmark_results(spark, tmpdir_path)
    assert back.count() == 3
    raw = "".join(open(os.path.join(tmpdir_path, f)).read() for f in os.listdir(tmpdir_path) if f.endswith(".csv"))
    assert "b,NA,NA,1" in raw and raw.startswith("task_name,reward,errors,exit_code")
