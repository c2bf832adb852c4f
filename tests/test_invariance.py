"""Results do not depend on the number of shuffle partitions."""

import math

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL

NAMES = ["pass_at_k", "frame_commands", "train_val_split", "assign_batches", "seeded_shuffle",
         "compact_history", "token_totals", "episode_outcome", "distinct_base_images", "solution_worklist"]


def _rows(df):
    norm = lambda v: round(v, 9) if isinstance(v, float) and not math.isnan(v) else v
    return sorted((tuple(norm(x) for x in r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_partition_count_invariance(spark, name):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        one = _rows(E.queries()[name](spark, SF_SMALL))
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        seven = _rows(E.queries()[name](spark, SF_SMALL))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert one == seven
