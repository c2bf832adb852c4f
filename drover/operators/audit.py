"""Checks over task corpora: truth values that leak into descriptions (E1), output
paths that the initial state already mentions (E2), and how well generated prompts
cover the option space (E4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from drover.functions import text as T

#: An absolute path of two parts or more.
PATH_RE = r"(?<![\w./~-])(?:/[\w.@+-]*[\w@+-])+"


# E1 --------------------------------------------------------------------------
def _words(text) -> Column:
    """The words of a text as hashes."""
    return F.transform(F.filter(F.split(F.coalesce(F.col(text), F.lit("")), T.WS + "+"), lambda w: w != ""), lambda w: F.xxhash64(w))


def _grams(words: Column, n: Column, public: bool) -> Column:
    """Runs of ``n`` words as ``(h, public, i)`` (none if there are fewer)."""
    last = F.size(words) - n + 1
    places = F.when((n > 0) & (last > 0), F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.struct(F.xxhash64(n, F.slice(words, i, n)).alias("h"), F.lit(public).alias("public"), i.alias("i")))


def _longest(places: Column) -> Column:
    """The length of the longest stretch of consecutive numbers (each comes once)."""
    start = F.struct(F.lit(-1).alias("at"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(acc, i):
        run = F.when(i == acc["at"] + 1, acc["run"] + 1).otherwise(F.lit(1))
        return F.struct(i.alias("at"), run.alias("run"), F.greatest(acc["best"], run).alias("best"))
    return F.aggregate(F.sort_array(places), start, step, lambda acc: acc["best"])


def detect_truth_leak(tasks: DataFrame, words: int = 5, key: str = "task_id", truth: str = "truth",
                      description: str = "description") -> DataFrame:
    """How much of each task's privileged truth stands verbatim in its public
    description: ``(task_id, n_grams, n_leaked, leak_ratio, longest_run)``.

    ``n_grams`` counts the distinct runs of ``words`` words of the truth (white
    space separates words; a shorter truth is one run), ``n_leaked`` those that
    the description holds too, and ``longest_run`` the words of the longest
    stretch of the truth all of whose runs the description holds.  A truth
    without words (null, blank) has ratio null and no row is lost; repeated keys
    are one task, whose texts are taken together.

    Runs travel as 64-bit hashes of their words' hashes, once, on (task, hash), so
    a long text is spread over many tasks; in each group the description's come
    first and tell whether the truth's leak.  The places of those meet again per
    row of the table to find the stretches (rows of a task never touch)."""
    base = tasks.select(F.col(key).alias("k"), _words(truth).alias("t"), _words(description).alias("d"),
                        F.monotonically_increasing_id().alias("row"))
    base = base.withColumn("n", F.least(F.lit(int(words)), F.size("t")))
    grams = base.select("k", "row", "n", F.inline(F.concat(_grams(F.col("t"), F.col("n"), False), _grams(F.col("d"), F.col("n"), True))))
    w = Window.partitionBy("h", "k").orderBy(F.desc("public"))
    held = grams.withColumns({"leaked": F.first("public").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
                              "new": F.coalesce(F.lag("public").over(w), F.lit(True))}).filter("NOT public")
    rows = held.groupBy("k", "row").agg(F.count_if("new").alias("n_grams"), F.count_if(F.col("new") & F.col("leaked")).alias("n_leaked"),
                                        F.collect_list(F.when(F.col("leaked"), F.col("i"))).alias("places"), F.max("n").alias("n"))
    longest = F.when(F.size("places") > 0, _longest(F.col("places")) - 1 + F.col("n")).otherwise(F.lit(0))
    none = F.lit(0).cast("bigint")  # a task without runs is a row too
    out = rows.select("k", "n_grams", "n_leaked", longest.cast("bigint").alias("longest_run")).unionByName(
        tasks.select(F.col(key).alias("k"), none.alias("n_grams"), none.alias("n_leaked"), none.alias("longest_run")))
    out = out.groupBy("k").agg(F.sum("n_grams").alias("n_grams"), F.sum("n_leaked").alias("n_leaked"), F.max("longest_run").alias("longest_run"))
    return out.select(F.col("k").alias(key), "n_grams", "n_leaked",
                      F.when(F.col("n_grams") > 0, F.col("n_leaked") / F.col("n_grams")).alias("leak_ratio"), "longest_run")


# E2 --------------------------------------------------------------------------
def paths(text) -> Column:
    """Distinct absolute paths in a text, without closing full stops or slashes."""
    c = F.col(text) if isinstance(text, str) else text
    return F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(PATH_RE), F.lit(0)))


def ancestors(path: Column) -> Column:
    """The proper ancestors of a path, without the root."""
    parts = F.slice(F.split(path, "/"), 2, 1 << 20)
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.concat(
        F.lit("/"), F.array_join(F.slice(parts, 1, i), "/")))).otherwise(F.array().cast("array<string>"))


def detect_output_paths(tasks: DataFrame, key: str = "task_id", description: str = "description",
                        initial: tuple[str, ...] = ("initial_test", "container_def"),
                        shared: tuple[str, ...] = ("/home/user",)) -> DataFrame:
    """Paths that a task's description names and its initial state (initial test,
    container definition) refers to, which spoils a task that should create
    them: ``(task_id, path, initial_path, relation, found_in)``.

    ``relation`` is ``same``, ``inside`` (the initial state has something below
    the path) or ``above`` (it has a folder that the path lies in; the folders of
    ``shared`` and above them belong to every task and don't count).  Null texts
    hold no paths; null keys are one task; repeated rows count once.

    Containment is an equi-join: each path meets the other side's ancestor
    closure on (task, path), so nothing is compared pairwise."""
    told = tasks.select(F.col(key).alias("k"), F.explode(paths(description)).alias("path")).distinct()
    seen = [tasks.select(F.col(key).alias("k"), F.explode(paths(c)).alias("initial_path"), F.lit(c).alias("found_in")) for c in initial]
    has = seen[0]
    for s in seen[1:]:
        has = has.unionByName(s)
    has = has.distinct()
    common = {p for s in shared for p in ["/" + "/".join(s.strip("/").split("/")[:i + 1]) for i in range(len(s.strip("/").split("/")))]}
    # either side with itself and its ancestors: (the path that meets, the path itself)
    up = lambda df, c: df.withColumn("meet", F.explode(F.concat(F.array(c), ancestors(F.col(c)))))
    right = lambda df: df.withColumnsRenamed({"k": "k2", "meet": "meet2"})
    on = F.col("k").eqNullSafe(F.col("k2")) & (F.col("meet") == F.col("meet2"))
    below = told.withColumn("meet", F.col("path")).join(right(up(has, "initial_path")), on)
    above = up(told, "path").filter(F.col("meet") != F.col("path")) \
        .join(right(has.withColumn("meet", F.col("initial_path"))), on) \
        .filter(~F.col("initial_path").isin(*common) if common else F.lit(True))
    relation = F.when(F.col("path") == F.col("initial_path"), "same").otherwise("inside")
    cols = [F.col("k").alias(key), "path", "initial_path"]
    return below.select(*cols, relation.alias("relation"), "found_in") \
        .unionByName(above.select(*cols, F.lit("above").alias("relation"), "found_in"))


# E4 --------------------------------------------------------------------------
def prompt_space_margins(prompts: DataFrame, dims: list[str], count: str = "n") -> DataFrame:
    """Prompts per combination of option values and all margins: the dimensions
    (null where summed over), ``margin`` (bits of the dimensions summed over, the
    last dimension lowest, so 0 for single cells) and the count.  A null option
    is a value of its own; ``margin`` tells it from a sum."""
    return prompts.cube(*dims).agg(F.count(F.lit(1)).alias(count), F.grouping_id().cast("bigint").alias("margin"))


def prompt_space_gaps(prompts: DataFrame, options: dict[str, DataFrame], chunk: int = 1 << 16) -> DataFrame:
    """Empty cells of the option space as ranges ``(first_cell, last_cell,
    n_cells)``, without building the space.

    ``options`` gives, in order, each dimension's column in ``prompts`` and a
    one-column table of its values.  Values are numbered from 0 in their order
    (nulls no values); a cell's number is that of its values in mixed radix, the
    last dimension running fastest.  Prompts with other values lie in no cell.
    Without prompts the whole space is one gap; a dimension without values makes
    an empty space.

    Occupied cells are sorted inside chunks of cell numbers; only the first and
    last cell of each chunk are compared across chunks."""
    spark = prompts.sparkSession
    number, size = F.lit(0).cast("bigint"), 1
    cells = prompts
    for i, (dim, values) in enumerate(options.items()):
        v = values.select(F.col(values.columns[0]).alias(f"v{i}")).filter(f"v{i} IS NOT NULL").distinct()
        # rank of each value: one row an option
        ranked = v.withColumn(f"n{i}", (F.row_number().over(Window.orderBy(f"v{i}")) - 1).cast("bigint"))
        size_i = v.count()
        cells = cells.join(ranked, F.col(dim) == F.col(f"v{i}"))
        number, size = number * size_i + F.col(f"n{i}"), size * size_i
    cells = cells.select(number.alias("cell")).distinct().withColumn("chunk", F.floor(F.col("cell") / chunk))
    w = Window.partitionBy("chunk").orderBy("cell")
    inner = cells.withColumn("next", F.lead("cell").over(w)).filter("next > cell + 1").select("cell", "next")
    ends = cells.groupBy("chunk").agg(F.min("cell").alias("lo"), F.max("cell").alias("hi"))
    edge = spark.createDataFrame([(-1, -1, -1), (1 << 62, size, size)] if size else [], "chunk bigint, lo bigint, hi bigint")
    outer = ends.unionByName(edge).withColumn("next", F.lead("lo").over(Window.orderBy("chunk"))) \
        .filter("next > hi + 1").select(F.col("hi").alias("cell"), "next")
    return inner.unionByName(outer).select((F.col("cell") + 1).alias("first_cell"), (F.col("next") - 1).alias("last_cell"),
                                           (F.col("next") - F.col("cell") - 1).alias("n_cells"))
