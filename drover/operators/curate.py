"""Task curation: stage filters, request building, joins between stage outputs
and set operations.  All joins are keyed equi-joins (the reference aligns lists
by position; here every artefact carries its task key)."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drover.functions import text as T

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference behaviour).
RESTRICTIONS_BLOCK = (
    "\n\nRESTRICTIONS:\n"
    "- You cannot use sudo or any commands requiring root privileges.\n"
    "- You cannot use interactive tools like vim, nano, etc.\n"
    "- When running commands that prompt for input (yes/no, etc.), use non-interactive flags "
    "(e.g., `-y`, `--yes`, `--non-interactive`) when available, or pipe the inputs "
    "(e.g., `echo -e 'yes\\nno' | ./script.sh` or `yes | ./script.sh`) since you cannot "
    "interact with running processes.\n"
)
# Generation stages in order, with the artefact column each one must produce.
GENERATION_STAGES = [("template", None), ("initial_test", "initial_test"),
                     ("final_test", "final_test"), ("container_def", "container_def")]
# ---------------------------------------------------------------------------


def _truthy(c) -> Column:
    """Python truthiness of an optional string artefact."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c != F.lit(""), F.lit(False))


def template_ok(description: str = "description", truth: str = "truth") -> Column:
    return ~T.is_blank(description) & ~T.is_blank(truth)


# P1 --------------------------------------------------------------------------
def filter_complete_templates(df: DataFrame, description: str = "description",
                              truth: str = "truth") -> DataFrame:
    """Keep templates whose stripped description and truth are both non-empty;
    the kept values are the stripped ones.  Run before any expensive stage."""
    return (df.filter(template_ok(description, truth))
            .withColumn(description, T.py_strip(description))
            .withColumn(truth, T.py_strip(truth)))


# P2 / A5 -----------------------------------------------------------------------
def reject_stage(description: str = "description", truth: str = "truth") -> Column:
    """First generation stage whose artefact is missing (null when complete)."""
    out = F.when(~template_ok(description, truth), F.lit("template"))
    for stage, col in GENERATION_STAGES[1:]:
        out = out.when(~_truthy(col), F.lit(stage))
    return out


def filter_stage_survivors(df: DataFrame, keep_rejects: bool = False) -> DataFrame:
    """Rows that produced every artefact; with ``keep_rejects`` all rows come
    back with a ``reject_stage`` column instead."""
    out = df.withColumn("reject_stage", reject_stage())
    return out if keep_rejects else out.filter(F.col("reject_stage").isNull())


def generation_yield(df: DataFrame) -> DataFrame:
    """Rows surviving each stage (the counts printed after every stage), long form."""
    rs = reject_stage()
    names = ["requested"] + [s for s, _ in GENERATION_STAGES]
    aggs = [F.count(F.lit(1)).alias("requested")]
    for i, (stage, _) in enumerate(GENERATION_STAGES):
        failed_before = [s for s, _ in GENERATION_STAGES[: i + 1]]
        aggs.append(F.count_if(rs.isNull() | ~rs.isin(*failed_before)).alias(stage))
    wide = df.agg(*aggs)
    pairs = ", ".join(f"{i}, '{n}', `{n}`" for i, n in enumerate(names))
    return wide.selectExpr(f"stack({len(names)}, {pairs}) AS (stage_order, stage, n_rows)") \
        .withColumn("n_rows", F.col("n_rows").cast("bigint"))


# P3 / A3 -----------------------------------------------------------------------
def filter_complete_bundles(df: DataFrame, key: str = "task_id") -> DataFrame:
    """Batch result row per input: ``saved`` key when all five artefacts are
    present, null otherwise (rejects are kept as nulls)."""
    return df.withColumn("saved_task", F.when(reject_stage().isNull(), F.col(key)))


def generation_summary(results: DataFrame, saved: str = "saved_task") -> DataFrame:
    """requested, succeeded, success_rate (0.0 when nothing was requested)."""
    return results.agg(F.count(F.lit(1)).alias("requested"),
                       F.count(F.col(saved)).alias("succeeded")) \
        .withColumn("success_rate", F.when(F.col("requested") == 0, F.lit(0.0))
                    .otherwise(F.col("succeeded") / F.col("requested")))


# P8 --------------------------------------------------------------------------
def render_template(template: str, **values) -> Column:
    """Named-placeholder substitution.  The template is parsed once on the
    driver into literal and column pieces joined by ``concat``: values are never
    re-expanded; a placeholder without a value raises ``KeyError`` at plan time."""
    pieces = []
    for literal, field, spec, conv in string.Formatter().parse(template):
        if literal:
            pieces.append(F.lit(literal))
        if field is None:
            continue
        if spec or conv or not field.isidentifier():
            raise ValueError(f"unsupported placeholder {{{field}}}")
        if field not in values:
            raise KeyError(field)
        v = values[field]
        pieces.append(F.col(v) if isinstance(v, str) else v)
    return F.concat(*pieces) if pieces else F.lit("")


# P7 --------------------------------------------------------------------------
def build_chat_requests(df: DataFrame, system_prompt: str, user: Column,
                        out: str = "messages") -> DataFrame:
    """``[system, user]`` message array per row."""
    return df.withColumn(out, F.array(
        F.struct(F.lit("system").alias("role"), F.lit(system_prompt).alias("content")),
        F.struct(F.lit("user").alias("role"), user.alias("content"))))


# P9 / P10 / P11 ------------------------------------------------------------------
def replicate_attempts(df: DataFrame, n: int, out: str = "attempt") -> DataFrame:
    """``n`` identical initial states per task (attempt 0..n-1)."""
    return df.withColumn(out, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def append_restrictions(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.concat(c, F.lit(RESTRICTIONS_BLOCK))


def rewrite_path_prefix(c, old: str, new: str) -> Column:
    """Literal replacement of every occurrence (no regex)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.replace(c, F.lit(old), F.lit(new))


# J1 --------------------------------------------------------------------------
def join_stage_outputs(*stages: DataFrame, key: str = "task_id") -> DataFrame:
    """Align per-stage outputs by task key (inner equi-joins, never by position)."""
    out = stages[0]
    for s in stages[1:]:
        out = out.join(s, key, "inner")
    return out


# J2 / A8 -------------------------------------------------------------------------
def join_requests_responses(requests: DataFrame, responses: DataFrame,
                            key: str = "request_id") -> DataFrame:
    """Every request gets its response or null (failed)."""
    return requests.join(responses, key, "left") \
        .withColumn("failed", F.col("response").isNull())


def failed_requests(joined: DataFrame, key: str = "request_id") -> DataFrame:
    return joined.filter(F.col("response").isNull()).select(key)


# J3 / J4 / J6 ----------------------------------------------------------------------
def semi_join_solved(tasks: DataFrame, solved: DataFrame, on) -> DataFrame:
    return tasks.join(solved, on, "left_semi")


def anti_join_already_run(tasks: DataFrame, summaries: DataFrame, model: str,
                          task_key: str, summary_key: str = "task_id") -> DataFrame:
    """Tasks that have no run summary for this model yet (resume)."""
    done = summaries.filter(F.col("model") == model).select(F.col(summary_key).alias(task_key))
    return tasks.join(done, task_key, "left_anti")


def lookup_task_description(tasks: DataFrame, bundles: DataFrame, key: str = "task_id") -> DataFrame:
    return tasks.join(bundles.select(key, "description"), key, "inner")


# X1 / X2 ---------------------------------------------------------------------------
def union_batches(*batches: DataFrame, required=("description", "truth")) -> DataFrame:
    """Append batch results, then drop rows with missing artefacts."""
    out = batches[0]
    for b in batches[1:]:
        out = out.unionByName(b)
    for c in required:
        out = out.filter(_truthy(c))
    return out


def union_reports(*reports: DataFrame) -> DataFrame:
    """Union of several conversion reports with exact duplicates removed."""
    out = reports[0]
    for r in reports[1:]:
        out = out.unionByName(r)
    return out.distinct()
