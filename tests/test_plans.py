"""Physical-plan properties the design relies on (checked on the formatted plan)."""

import contextlib
import io
import re

import __spark_entry__ as E
from conftest import SF_SMALL


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def shuffles(txt: str) -> int:
    return len(re.findall(r"^\(\d+\) Exchange\b", txt, re.M))


def q(spark, name):
    return E.queries()[name](spark, SF_SMALL)


def test_column_pruning_reaches_scan(spark):
    txt = plan(q(spark, "episode_counts"))
    assert "ReadSchema: struct<conv_id:bigint,role:string>" in txt


def test_per_run_windows_share_one_shuffle(spark):
    assert shuffles(plan(q(spark, "token_totals"))) == 1
    assert shuffles(plan(q(spark, "frame_commands"))) == 1


def test_global_order_offsets_are_broadcast_per_partition(spark):
    txt = plan(q(spark, "assign_batches"))
    assert "hashpartitioning(_pid" in txt and "BroadcastExchange" in txt
    # the only single-partition exchange feeds the per-partition count table
    single = re.findall(r"Exchange SinglePartition", txt)
    assert len(single) <= 1


def test_split_has_one_plan_without_a_global_window(spark):
    """The split's order comes from ranges at every size, with no switch."""
    txt = plan(q(spark, "train_val_split"))
    assert "TakeOrderedAndProject" not in txt and len(re.findall(r"Exchange SinglePartition", txt)) <= 1


def test_prompt_sampling_joins_on_the_picked_number(spark):
    txt = plan(q(spark, "sample_prompts"))
    assert "CartesianProduct" not in txt and "NestedLoopJoin" not in txt


def test_image_census_is_two_phase(spark):
    txt = plan(q(spark, "distinct_base_images"))
    assert txt.count("HashAggregate") >= 4 and shuffles(txt) == 2


def test_nested_column_pruning(spark, tmpdir_path):
    from drover.plans.dataset_queries import train_rows
    from drover.sources import files as S
    S.write_train_validation(train_rows(spark, SF_SMALL), tmpdir_path)
    txt = plan(S.scan_train_parquet(spark, f"{tmpdir_path}/train.parquet"))
    assert "ReadSchema: struct<extra_info:struct<task_dir:string>>" in txt


def test_rollup_is_partially_aggregated(spark):
    txt = plan(q(spark, "rollup_runs"))
    assert "partial_count" in txt and "partial_sum" in txt
