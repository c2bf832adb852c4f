"""E6: discounted returns of every step, and their normalised form.

A run's returns are a scan from its last turn to its first: G = r + discount * G'.
The scan runs over ranges of turns.  A range's steps act on the return that comes
in from behind as an affine map (A * G' + C), and maps of neighbouring ranges
compose into that of a range of ranges.  So ranges of ``width`` turns are composed
level by level until a run is one range, and the incoming returns are handed down
again: a run that holds a large share of all steps is spread over many tasks, and
no value holds more than ``width`` children.  Runs up to ``width`` turns need one
shuffle and no join.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NODE = "struct<at:bigint,a:double,c:double>"


def _composed(children: Column) -> Column:
    """(A, C) of children ``(at, a, c)`` in order: the last acts first."""
    start = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("c"))
    return F.aggregate(F.reverse(children), start,
                       lambda acc, x: F.struct((x["a"] * acc["a"]).alias("a"), (x["a"] * acc["c"] + x["c"]).alias("c")))


def _handed_down(children: Column, incoming: Column) -> Column:
    """(at, what comes in from behind) for each child; the last gets ``incoming``."""
    start = F.struct(incoming.alias("g"), F.array().cast("array<struct<at:bigint,g:double>>").alias("out"))
    step = lambda acc, x: F.struct(
        (x["a"] * acc["g"] + x["c"]).alias("g"),
        F.concat(acc["out"], F.array(F.struct(x["at"].alias("at"), acc["g"].alias("g")))).alias("out"))
    return F.aggregate(F.reverse(children), start, step, lambda acc: acc["out"])


def _ranges(nodes: DataFrame, run: str, width: int) -> DataFrame:
    """Nodes ``(run, at, a, c)`` gathered into ranges ``(run, range, children)``."""
    return nodes.groupBy(run, F.floor(F.col("at") / width).cast("bigint").alias("range")).agg(
        F.array_sort(F.collect_list(F.struct("at", "a", "c"))).cast(f"array<{_NODE}>").alias("children"))


def returns_to_go(steps: DataFrame, discount: float = 1.0, run: str = "run_id", turn: str = "turn",
                  reward: str = "reward", width: int = 256) -> DataFrame:
    """``(run, turn, reward, return_to_go, normalized)``: the discounted sum of
    the rewards from a step to its run's end, and its distance from the mean of
    all steps in (population) standard deviations, 0 if they are all equal.

    Steps follow each other by turn; gaps between turn numbers don't count as
    steps, and steps of one turn go by their reward.  A null reward is 0; steps
    without a run or turn are left out; an empty table gives no rows."""
    from drover.session import shared_path
    spark = steps.sparkSession

    def kept(df: DataFrame, name: str) -> DataFrame:
        path = shared_path(spark, name)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    nodes = steps.filter(F.col(run).isNotNull() & F.col(turn).isNotNull()).select(
        run, F.col(turn).cast("bigint").alias("at"), F.lit(float(discount)).alias("a"),
        F.coalesce(F.col(reward).cast("double"), F.lit(0.0)).alias("c"))
    levels = [_ranges(nodes, run, width)]
    reach = nodes.agg(F.min("at").alias("lo"), F.max("at").alias("hi")).first()
    lo, hi = (reach["lo"] or 0) // width, (reach["hi"] or 0) // width
    if lo != hi:
        levels[0] = kept(levels[0], "returns-ranges")
    while lo != hi:
        up = levels[-1].select(run, F.col("range").alias("at"), _composed(F.col("children")).alias("m")) \
            .select(run, "at", "m.a", "m.c")
        levels.append(kept(_ranges(up, run, width), "returns-ranges"))
        lo, hi = lo // width, hi // width
    incoming = None
    for ranges in reversed(levels):
        if incoming is None:
            here = ranges.withColumn("g", F.lit(0.0))
        else:
            here = ranges.join(incoming.select(run, F.col("at").alias("range"), "g"), [run, "range"])
        last, incoming = here, here.select(run, F.inline(_handed_down(F.col("children"), F.col("g"))))
    # a step's return is its reward and what comes in from behind; handed down from the last child to the first
    done = F.arrays_zip(F.reverse("children").alias("x"), _handed_down(F.col("children"), F.col("g")).alias("y"))
    out = last.select(run, F.explode(done).alias("z")).select(
        run, F.col("z.x.at").cast("int").alias(turn), F.col("z.x.c").alias(reward),
        (F.col("z.x.a") * F.col("z.y.g") + F.col("z.x.c")).alias("return_to_go"))
    out = kept(out, "returns")
    whole = out.agg(F.avg("return_to_go").alias("mean"), F.stddev_pop("return_to_go").alias("dev")).first()
    mean, dev = whole["mean"] or 0.0, whole["dev"] or 0.0
    # what rounding leaves of a deviation is none
    normal = (F.col("return_to_go") - mean) / dev if dev > 1e-12 * max(1.0, abs(mean)) else F.lit(0.0)
    return out.withColumn("normalized", normal)
