"""Ordering, slicing and the deterministic train/validation split.

Global positions are computed without a single-partition window: rows are
dealt over value ranges by one range exchange, written once to the shared folder,
numbered inside each range, and shifted by the sizes of the earlier ranges (a
table with one row per range, broadcast).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from drover.functions import text as T

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference behaviour).
DATA_SOURCE = "endless"
ENV_CLASS = "endless"
REWARD_METHOD = "rule"
DEFAULT_SEED = 42
DEFAULT_EVAL_COUNT = 100
# ---------------------------------------------------------------------------


def _ranged(df: DataFrame, order: list, name: str, num_partitions: int | None) -> DataFrame:
    """The rows dealt over value ranges of ``order``, written once into the shared
    folder with the number of their range in ``_pid``.  Ranges are sampled by the
    exchange itself; writing them fixes the choice, so that every later read (and
    every re-execution after a lost executor) sees the same ranges.  There are as
    many as shuffle partitions, which follow the size of the data."""
    from drover.session import shared_path
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = shared_path(spark, name)
    out = df.repartitionByRange(n, *order).withColumn("_pid", F.spark_partition_id())
    out.write.parquet(path)
    return spark.read.schema(out.schema).parquet(path)


def global_index(df: DataFrame, order_cols: list, name: str = "idx",
                 num_partitions: int | None = None, total: str | None = None) -> DataFrame:
    """1-based position of every row in the order of ``order_cols`` (which should
    be unique; nulls come first).  Rows are numbered inside their value range and
    shifted by the sizes of the earlier ranges (one row per range, broadcast).
    ``total`` names a column for the number of rows."""
    order = [F.col(c) if isinstance(c, str) else c for c in order_cols]
    b = _ranged(df, order, "global-index", num_partitions)
    numbered = b.withColumn("_rn", F.row_number().over(Window.partitionBy("_pid").orderBy(*order)))
    counts = b.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    # one row per range: the running total over ranges is tiny
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))) \
        .withColumn("_all", F.sum("_n").over(whole)).select("_pid", "_off", "_all")
    out = numbered.join(F.broadcast(offsets), "_pid") \
        .withColumn(name, (F.col("_off") + F.col("_rn")).cast("bigint"))
    if total:
        out = out.withColumn(total, F.col("_all"))
    return out.drop("_pid", "_rn", "_off", "_all")


def keyed_prefix_sum(df: DataFrame, key: str, order_cols: list, value, out: str,
                     inclusive: bool = False, num_partitions: int | None = None) -> DataFrame:
    """Running sum of ``value`` per ``key`` in ``order_cols`` order that stays
    balanced when one key holds a large share of the rows: rows are dealt over
    (key, order) value ranges so a hot key spans several of them, summed locally
    per (range, key), and shifted by the totals of the key's earlier ranges (a
    table of about one row per key and range).  Rows with a null key are kept,
    as one key."""
    v = F.col(value) if isinstance(value, str) else value
    order = [F.col(key), *[F.col(c) if isinstance(c, str) else c for c in order_cols]]
    b = _ranged(df.withColumn("_v", v), order, "prefix-sum", num_partitions)
    frame = (Window.unboundedPreceding, Window.currentRow if inclusive else -1)
    local = b.withColumn("_loc", F.coalesce(
        F.sum("_v").over(Window.partitionBy("_pid", key).orderBy(*order_cols).rowsBetween(*frame)), F.lit(0)))
    totals = b.groupBy("_pid", key).agg(F.sum("_v").alias("_tot"))
    bases = totals.withColumn("_base", F.coalesce(F.sum("_tot").over(
        Window.partitionBy(key).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    bases = bases.select(F.col("_pid").alias("_bp"), F.col(key).alias("_bk"), "_base")
    return local.join(bases, (F.col("_pid") == F.col("_bp")) & F.col(key).eqNullSafe(F.col("_bk"))) \
        .withColumn(out, F.col("_base") + F.col("_loc")).drop("_pid", "_v", "_loc", "_base", "_bp", "_bk")


# O1 --------------------------------------------------------------------------
def sort_tasks(df: DataFrame, key: str = "task_id", name: str = "position") -> DataFrame:
    return global_index(df, [key], name)


# W1 --------------------------------------------------------------------------
def assign_batches(df: DataFrame, batch_size: int, key: str = "task_id") -> DataFrame:
    """ceil(requested / size) batches, the last one short; size is at least 1."""
    size = max(1, int(batch_size))
    return global_index(df, [key], "idx") \
        .withColumn("batch", F.floor((F.col("idx") - 1) / F.lit(size)).cast("int"))


# W2 --------------------------------------------------------------------------
#: Up to this depth a slice is a top-k; beyond it, whole ranges of keys are skipped by their counts.
DEEP_SLICE = 1_000_000


def slice_tasks(df: DataFrame, start_at: int, num_tasks: int, key: str = "task_id") -> DataFrame:
    """Rows ``[start_at, start_at + num_tasks)`` of the id-sorted table, sorted.

    A deep slice numbers the keys alone, looks up the first and the last key of
    the slice and reads the rows between them; a limit would carry all rows
    before the slice through one task."""
    if start_at + num_tasks <= DEEP_SLICE:
        return df.orderBy(key).offset(start_at).limit(num_tasks)
    idx = global_index(df.select(F.col(key).alias("_k")), ["_k"], "_idx").filter(F.col("_idx") <= start_at + num_tasks)
    edge = idx.filter(F.col("_idx") > start_at).agg(F.count(F.lit(1)).alias("n"), F.min("_k").alias("lo"), F.max("_k").alias("hi"),
                                                    F.min(F.struct("_idx", "_k"))["_k"].alias("first")).first()
    if not edge["n"]:
        return df.limit(0)
    first = F.lit(edge["first"])
    before = idx.filter(F.col("_k").eqNullSafe(first)).agg(F.min("_idx")).first()[0]
    # nulls come first
    rows = df.filter(F.col(key).isNull() | (F.col(key) <= edge["hi"])) if edge["first"] is None else \
        df.filter(F.col(key).between(edge["lo"], edge["hi"]))
    return rows.orderBy(key).offset(start_at + 1 - before).limit(num_tasks)


# O2 --------------------------------------------------------------------------
def shuffle_key(key: str = "task_id", seed: int = DEFAULT_SEED) -> Column:
    """Deterministic shuffle key (md5 of ``seed:key``); the same in any engine
    and any partitioning."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def seeded_shuffle(df: DataFrame, key: str = "task_id", seed: int = DEFAULT_SEED,
                   name: str = "shuffle_position") -> DataFrame:
    keyed = df.withColumn("shuffle_key", shuffle_key(key, seed))
    return global_index(keyed, ["shuffle_key", key], name)


# W3 / J5 ---------------------------------------------------------------------------


def train_val_split(tasks: DataFrame, eval_count: int = DEFAULT_EVAL_COUNT,
                    seed: int = DEFAULT_SEED, key: str = "task_id",
                    failed: DataFrame | None = None) -> DataFrame:
    """The last ``eval_count`` positions of the seeded order are validation,
    the rest train.  Positions are fixed *before* failed builds are removed, so
    validation can come out smaller than ``eval_count``.  Repeated ids share
    their split; null ids come first in the order.

    The first position of the validation part is looked up among the keys (a
    top-k); the split is then a comparison with it, so no row is moved and
    further columns of ``tasks`` are carried along."""
    place = F.struct(shuffle_key(key, seed).alias("sk"), F.col(key).alias("k"))
    last = tasks.select(place.alias("p")).select("p.*").orderBy(F.col("sk").desc(), F.col("k").desc()).limit(int(eval_count))
    bound = last.agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("sk", "k")).alias("p")).first()
    kind = tasks.schema[key].dataType
    held = place >= F.struct(F.lit(bound["p"]["sk"]).cast("string").alias("sk"), F.lit(bound["p"]["k"]).cast(kind).alias("k")) \
        if bound["n"] else F.lit(False)
    out = tasks.withColumn("split", F.when(held, F.lit("validation")).otherwise(F.lit("train")))
    if failed is not None:
        out = anti_join_failed_builds(out, failed, key)
    return out


def anti_join_failed_builds(df: DataFrame, failed: DataFrame, key: str = "task_id") -> DataFrame:
    return df.join(failed.select(key), key, "left_anti")


# P6 --------------------------------------------------------------------------
def project_train_rows(df: DataFrame, task_root: str, system_prompt: str,
                       max_time=600, description: str = "description",
                       key: str = "task_id") -> DataFrame:
    """Nested RL row: constants, two-message prompt, reward spec, extra info."""
    path = F.concat(F.lit(task_root.rstrip("/") + "/"), F.col(key))
    return df.select(
        F.col(description).alias("description"), F.col(key).alias("task_dir"), "split",
        F.lit(DATA_SOURCE).alias("data_source"),
        F.array(F.struct(F.lit("system").alias("role"), F.lit(system_prompt).alias("content")),
                F.struct(F.lit("user").alias("role"), F.col(description).alias("content"))).alias("prompt"),
        F.lit(ENV_CLASS).alias("env_class"),
        F.struct(F.lit(REWARD_METHOD).alias("method"), path.alias("ground_truth")).alias("reward_spec"),
        F.struct(path.alias("task_dir"), T.cast_max_time(F.lit(max_time)).cast("bigint").alias("max_time"))
        .alias("extra_info"))


# A11 -------------------------------------------------------------------------
def split_sizes(df: DataFrame) -> DataFrame:
    return df.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"))
