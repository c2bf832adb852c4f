"""Checks over task corpora and returns of runs (the survey's additions E1, E2,
E4 and E6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from drover.functions import text as T
from drover.operators import audit as A
from drover.operators import dataset as DS
from drover.operators import extract as X
from drover.operators import returns as RT
from drover.plans import duck as D
from drover.plans.fixtures import table, view, with_views
from drover.plans.registry import QUERIES, register

_GRAM = 5


def _word_list(x: str) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({x}, ''), {D.rx(T.WS + '+')}), lambda w: w <> '')"


# the same texts on both sides by brute force: runs of words as texts, stretches by row numbers
@register("detect_truth_leak", with_views(f"""
, w AS (SELECT task_id, {_word_list('truth')} AS t, {_word_list('description')} AS d FROM bundles),
n AS (SELECT *, least({_GRAM}, len(t)) AS n FROM w),
told AS (SELECT task_id, n, i, array_to_string(t[i : i + n - 1], ' ') AS g
         FROM (SELECT *, unnest(range(1, len(t) - n + 2)) AS i FROM n WHERE n > 0)),
public AS (SELECT DISTINCT task_id, array_to_string(d[i : i + n - 1], ' ') AS g
           FROM (SELECT *, unnest(range(1, len(d) - n + 2)) AS i FROM n WHERE n > 0 AND len(d) >= n)),
hit AS (SELECT t.*, p.g IS NOT NULL AS leaked FROM told t LEFT JOIN public p ON p.task_id = t.task_id AND p.g = t.g),
runs AS (SELECT task_id, count(*) + max(n) - 1 AS run
         FROM (SELECT *, i - row_number() OVER (PARTITION BY task_id ORDER BY i) AS s FROM hit WHERE leaked) GROUP BY task_id, s),
counts AS (SELECT task_id, count(DISTINCT g) AS n_grams, count(DISTINCT CASE WHEN leaked THEN g END) AS n_leaked FROM hit GROUP BY 1)
SELECT w.task_id, coalesce(n_grams, 0) AS n_grams, coalesce(n_leaked, 0) AS n_leaked, n_leaked / n_grams AS leak_ratio,
       CAST(coalesce((SELECT max(run) FROM runs r WHERE r.task_id = w.task_id), 0) AS BIGINT) AS longest_run
FROM w LEFT JOIN counts c ON c.task_id = w.task_id
""".replace("\n, w AS", ", w AS", 1), "bundles"), ("E1",))
def q_detect_truth_leak(spark, sf):
    return A.detect_truth_leak(view(spark, sf, "bundles"), _GRAM)


_PATHS = r"(?:^|[^\w./~-])((?:/[\w.@+-]*[\w@+-])+)"


@register("detect_output_paths", with_views(f"""
, told AS (SELECT DISTINCT task_id, unnest(regexp_extract_all(coalesce(description, ''), {D.rx(_PATHS)}, 1)) AS path FROM path_tasks),
has AS (SELECT DISTINCT task_id, initial_path, found_in FROM (
    SELECT task_id, unnest(regexp_extract_all(coalesce(initial_test, ''), {D.rx(_PATHS)}, 1)) AS initial_path, 'initial_test' AS found_in FROM path_tasks
    UNION ALL SELECT task_id, unnest(regexp_extract_all(coalesce(container_def, ''), {D.rx(_PATHS)}, 1)), 'container_def' FROM path_tasks))
SELECT t.task_id, path, initial_path, CASE WHEN path = initial_path THEN 'same' WHEN starts_with(initial_path, path || '/') THEN 'inside' ELSE 'above' END AS relation,
       found_in
FROM told t JOIN has h ON h.task_id = t.task_id
WHERE path = initial_path OR starts_with(initial_path, path || '/')
   OR (starts_with(path, initial_path || '/') AND initial_path NOT IN ('/home', '/home/user'))
""".replace("\n, told AS", ", told AS", 1), "path_tasks"), ("E2",))
def q_detect_output_paths(spark, sf):
    return A.detect_output_paths(view(spark, sf, "path_tasks"))


def _prompts(spark, sf):
    reqs = table(spark, sf, "documents").select(F.col("doc_id").alias("request_id"))
    return X.sample_prompts(reqs, _dims(spark, sf), 42)


def _dims(spark, sf):
    return {"category": (table(spark, sf, "part"), "p_type"), "complexity": (table(spark, sf, "region"), "r_name"),
            "scenario": (table(spark, sf, "nation"), "n_name")}


def _prompts_sql() -> str:
    from drover.plans import text_queries  # noqa: F401  (registers the sampling)
    return QUERIES["sample_prompts"].oracle


_DIMS = ["category", "complexity", "scenario"]


@register("prompt_space_margins", f"""
SELECT category, complexity, scenario, count(*) AS n, CAST(grouping(category, complexity, scenario) AS BIGINT) AS margin
FROM ({_prompts_sql()}) p GROUP BY CUBE (category, complexity, scenario)
""", ("E4",))
def q_prompt_space_margins(spark, sf):
    return A.prompt_space_margins(_prompts(spark, sf), _DIMS)


# every cell in order, and stretches of empty ones
@register("prompt_space_gaps", f"""
WITH p AS ({_prompts_sql()}),
c AS (SELECT p_type AS v, row_number() OVER (ORDER BY p_type) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT p_type FROM part)),
x AS (SELECT r_name AS v, row_number() OVER (ORDER BY r_name) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT r_name FROM region)),
s AS (SELECT n_name AS v, row_number() OVER (ORDER BY n_name) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT n_name FROM nation)),
cells AS (SELECT (c.i * x.n + x.i) * s.n + s.i AS cell, c.v AS cv, x.v AS xv, s.v AS sv FROM c, x, s),
empty AS (SELECT cell FROM cells WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.category = cv AND p.complexity = xv AND p.scenario = sv))
SELECT min(cell) AS first_cell, max(cell) AS last_cell, count(*) AS n_cells
FROM (SELECT cell, cell - row_number() OVER (ORDER BY cell) AS g FROM empty) GROUP BY g
""", ("E4",))
def q_prompt_space_gaps(spark, sf):
    return A.prompt_space_gaps(_prompts(spark, sf), {name: t.select(c) for name, (t, c) in _dims(spark, sf).items()}, chunk=64)


def _returns_sql(source: str, discount: float) -> str:
    """Each step's return as a sum over the steps behind it."""
    if discount == 1.0:
        g = "sum(r) OVER (PARTITION BY run_id ORDER BY turn DESC)"
    else:
        # the rewards from the step on, folded from the last
        g = (f"list_reduce(list_prepend(0.0, list(r) OVER (PARTITION BY run_id ORDER BY turn DESC)), lambda a, x: x + {discount} * a)")
    return with_views(f"""
SELECT run_id, turn, r AS reward, round(g, 6) AS return_to_go,
       round((g - avg(g) OVER ()) / stddev_pop(g) OVER (), 5) AS normalized
FROM (SELECT *, {g} AS g FROM (SELECT run_id, turn, CAST(coalesce(reward, 0) AS DOUBLE) AS r FROM {source}) s) t
""", source)


def _rounded(df):
    return df.withColumn("return_to_go", F.round("return_to_go", 6)).withColumn("normalized", F.round("normalized", 5))


def _long_steps(spark, sf):
    """The rows of the view ``long_steps``.  Its longest run holds a third of all
    lines, so turns are numbered over ranges, not by a window over whole runs."""
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate", "l_returnflag"]
    lines = table(spark, sf, "lineitem").select(F.expr("CASE WHEN l_orderkey % 3 = 0 THEN 0 ELSE l_orderkey END").alias("run_id"), *order)
    # many small parts of the long run, so that a task that gets several of them stays small
    ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    return DS.keyed_prefix_sum(lines, "run_id", order, F.lit(1), "turn", inclusive=True, num_partitions=ranges).select(
        "run_id", F.col("turn").cast("int").alias("turn"), F.expr("CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END").alias("reward"))


@register("returns_to_go", _returns_sql("long_steps", 1.0), ("E6",))
def q_returns_to_go(spark, sf):
    return _rounded(RT.returns_to_go(_long_steps(spark, sf)))


@register("discounted_returns", _returns_sql("rewarded_steps", 0.9), ("E6",))
def q_discounted_returns(spark, sf):
    return _rounded(RT.returns_to_go(view(spark, sf, "rewarded_steps"), 0.9, width=16))
