"""The reference's entry points as composed Spark jobs.

* ``solution_worklist`` — choose work for a solution run: tasks the reference
  model solved (pass@k > 0), minus tasks that already have a summary for this
  model (resume), sorted by id and sliced.
* ``prepare_dataset`` — solved tasks with their descriptions, the seeded
  train/validation split with failed builds removed after positions are fixed,
  projected into nested train rows and written as two Parquet sets.
* ``attempt_report`` — per attempt: actions parsed, cut at the first done or
  the action limit, with the survivor counts of the rollout loop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drover.operators import curate as C
from drover.operators import dataset as DS
from drover.operators import trajectory as TR
from drover.sources import files as S


def solution_worklist(tasks: DataFrame, summaries: DataFrame, model: str, ref_model: str = "ref",
                      k: int = 16, start_at: int = 0, num_tasks: int = 200, task_key: str = "task_key",
                      key: str = "task_id") -> DataFrame:
    solved = TR.filter_solved_tasks(summaries.filter(F.col("model") == ref_model), k) \
        .select(F.col("task_id").alias(task_key))
    todo = C.semi_join_solved(tasks, solved, task_key)
    todo = C.anti_join_already_run(todo, summaries, model, task_key)
    return DS.slice_tasks(todo, start_at, num_tasks, key)


def prepare_dataset(tasks: DataFrame, summaries: DataFrame, failed_builds: DataFrame,
                    task_root: str, system_prompt: str, k: int = 16, eval_count: int = 100,
                    seed: int = 42, max_time="600", ref_model: str = "ref",
                    task_key: str = "task_key", out_dir: str | None = None) -> DataFrame:
    solved = TR.filter_solved_tasks(summaries.filter(F.col("model") == ref_model), k) \
        .select(F.col("task_id").alias(task_key))
    chosen = C.semi_join_solved(tasks, solved, task_key)
    described = C.filter_complete_templates(chosen).select("task_id", "description")
    split = DS.train_val_split(described.select("task_id"), eval_count, seed, failed=failed_builds)
    rows = DS.project_train_rows(described.join(split, "task_id"), task_root, system_prompt, max_time)
    if out_dir:
        S.write_train_validation(rows, out_dir)
    return rows


def attempt_report(turns: DataFrame, max_actions: int = 16, run: str = "run_id") -> DataFrame:
    kept = TR.truncate_at_done(turns, max_actions)
    acts = TR.parse_actions(kept)
    return acts.groupBy(run).agg(
        F.max("turn_no").alias("n_turns"), F.max("ended_by").alias("ended_by"),
        F.count_if(F.col("action_type") == "command").alias("n_commands"),
        F.count_if(F.col("action_type") == "invalid").alias("n_invalid"))
