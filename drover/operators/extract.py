"""Text jobs: reply/transcript tables in, accepted rows plus reject reasons out.

Each job is a projection of native column rules over a whole table; the only
Python crossing is the syntax check of generated Python (an Arrow-batched
pandas UDF, ``python_compiles``), which has no native equivalent.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as TY

from drover.functions import text as T
from drover.operators import curate as C

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference behaviour): the generation request.
PROMPT_SENTENCE = ("Write a new task focusing on {category}. Complexity: {complexity}. "
                   "Scenario: {scenario}. "
                   "Be very specific about the output format in the task description that the "
                   "automated test will check. Write the task description in a way that a user "
                   "might ask an AI assistant. The task should be a realistic end-to-end scenario "
                   "that an AI agent could perform in a Linux terminal.")
# The strict decision object: its only keys, and the allowed types.
DECISION_KEYS = ["type", "command", "timeout_sec"]
DECISION_TYPES = ["command", "done", "invalid"]
# ---------------------------------------------------------------------------


# R1 / F1 ---------------------------------------------------------------------------
def extract_templates(replies: DataFrame, response: str = "response") -> DataFrame:
    """Every reply with its description/truth, or a reject reason."""
    d, t = T.template_description(response), T.template_truth(response)
    reason = (F.when(F.col(response).isNull(), F.lit("no_response"))
              .when(d == "", F.lit("no_task"))
              .when(t == "", F.lit("no_truth")))
    out = replies.withColumn("reject_reason", reason)
    ok = F.col("reject_reason").isNull()
    return out.withColumn("description", F.when(ok, d)).withColumn("truth", F.when(ok, t))


# R2 / F2 / F3 ------------------------------------------------------------------------
@F.pandas_udf(TY.BooleanType())
def python_compiles(code: pd.Series) -> pd.Series:
    """True when the text compiles as a Python module (never executed)."""
    def ok(src):
        if src is None:
            return None
        try:
            compile(src, "<string>", "exec")
            return True
        except Exception:  # noqa: BLE001 - any failure means "does not compile"
            return False
    return code.map(ok).astype("object")


def extract_code(replies: DataFrame, response: str = "response", check: bool = False) -> DataFrame:
    """Python source of each reply; with ``check`` also whether it compiles.
    Rows without code or that do not compile are rejected, like the
    generation stages do (an empty text compiles but is not an artefact)."""
    out = replies.withColumn("code", T.extract_python_code(response))
    if check:
        # ``code`` is referenced twice below, so Catalyst keeps it as its own
        # projection and the UDF receives a plain column (no lambda variables).
        out = out.withColumn("compiles", python_compiles(F.col("code"))) \
            .withColumn("reject_reason", F.when(F.col(response).isNull(), F.lit("no_response"))
                        .when(F.col("code") == "", F.lit("empty_code"))
                        .when(~F.col("compiles"), F.lit("syntax_error")))
    return out


# R3 / F4 / F5 ------------------------------------------------------------------------
def extract_definitions(replies: DataFrame, response: str = "response") -> DataFrame:
    return (replies.withColumn("def_text", T.extract_def_text(response))
            .withColumn("dockerfile", T.extract_fenced_block(response, "dockerfile")))


# R5 / F7-F10 --------------------------------------------------------------------------
def clean_transcripts(outputs: DataFrame, output: str = "output",
                      limit: int = T.MAX_OUTPUT_LENGTH) -> DataFrame:
    # used three times below: Catalyst keeps it as a projection of its own
    whole = F.col("_whole")
    return (outputs.withColumn("_whole", T.clean_output(output))
            .withColumn("cleaned", T.truncate_output(whole, limit))
            .withColumn("chars_saved", F.length(output) - F.length(whole))
            .withColumn("truncated", F.length(whole) > limit).drop("_whole"))


# R10 / F18 / P11 --------------------------------------------------------------------------
def patch_definitions(bundles: DataFrame, defn: str = "container_def",
                      rewrites: dict | None = None) -> DataFrame:
    """Bulk rewrite: literal prefix replacements, then the home-mode line."""
    c = F.col(defn)
    for old, new in (rewrites or {}).items():
        c = C.rewrite_path_prefix(c, old, new)
    return (bundles.withColumn("_d", c)
            .withColumn("patch_status", T.home_mode_status("_d"))
            .withColumn("patched_def", T.patch_home_mode("_d")).drop("_d"))


# R11 / F21 / F22 ---------------------------------------------------------------------------
def assign_names(tasks: DataFrame, key: str = "task_id", idx: int = 0) -> DataFrame:
    return tasks.withColumn("task_name", T.task_name(key, idx)) \
        .withColumn("image_name", T.image_name("task_name"))


def name_collisions(named: DataFrame, name: str = "task_name") -> DataFrame:
    """Names given to more than one task (8 hex characters collide at ~10^5 rows)."""
    return named.groupBy(name).agg(F.count(F.lit(1)).alias("n_tasks")).filter(F.col("n_tasks") > 1)


# R12 / F24 ---------------------------------------------------------------------------------


def _kind(v: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def parse_decisions(df: DataFrame, text: str = "json") -> DataFrame:
    """Strict decision objects: only the keys type/command/timeout_sec, type one
    of command/done/invalid, command a string or null, timeout a number, a string
    that holds one, or null (absent -> 180).  Anything else is rejected."""
    v = F.try_parse_json(F.col(text))
    keys = F.json_object_keys(F.col(text))
    t_kind, c_kind, s_kind = _kind(v, "$.type"), _kind(v, "$.command"), _kind(v, "$.timeout_sec")
    has = lambda k: F.array_contains(keys, k)
    is_num = s_kind.rlike("^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL.*)$")
    typ = F.try_variant_get(v, "$.type", "string")
    told = F.trim(F.try_variant_get(v, "$.timeout_sec", "string"))
    is_num = is_num | ((s_kind == "STRING") & told.rlike(r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"))
    valid = (keys.isNotNull()
             & (F.size(F.array_except(keys, F.array(*[F.lit(k) for k in DECISION_KEYS]))) == 0)
             & has("type") & (t_kind == "STRING") & typ.isin(*DECISION_TYPES)
             & (~has("command") | c_kind.isin("STRING", "VOID"))
             & (~has("timeout_sec") | is_num | (s_kind == "VOID")))
    valid = F.coalesce(valid, F.lit(False))
    timeout = F.when(~has("timeout_sec"), F.lit(T.DECISION_DEFAULT_TIMEOUT)) \
        .otherwise(told.try_cast("double"))
    return (df.withColumn("valid", valid)
            .withColumn("type", F.when(valid, typ))
            .withColumn("command", F.when(valid, F.try_variant_get(v, "$.command", "string")))
            .withColumn("timeout_sec", F.when(valid, timeout)))


# R13 / F27 / P7 ------------------------------------------------------------------------------
def dimension(values: DataFrame, col: str, name: str) -> tuple[DataFrame, int]:
    """Distinct values of a dimension numbered 0..n-1 in sorted order.  Options
    are a list written by hand (dozens of values): de-duplicated in parallel, they
    are numbered in one sorted run."""
    d = values.select(F.col(col).alias(name)).filter(F.col(name).isNotNull()).distinct()
    numbered = d.withColumn(f"{name}_idx", (F.row_number().over(Window.orderBy(name)) - 1).cast("bigint"))
    return numbered, d.count()


def _pick_index(seed: int, key: str, name: str, n: int) -> Column:
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"), F.lit(name)))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") % F.lit(n)


def sample_prompts(requests: DataFrame, dims: dict, seed: int = 42, key: str = "request_id") -> DataFrame:
    """One generation request per row: an independent, uniform, seeded pick from
    every dimension (``dims``: name -> (table, column)), rendered into the
    request sentence.  Each dimension's distinct values are numbered in sorted
    order and joined on the picked number (AQE broadcasts the small ones)."""
    out = requests
    for name, (tbl, col) in dims.items():
        d, n = dimension(tbl, col, name)
        if not n:
            raise ValueError(f"dimension {name} is empty")
        out = out.withColumn(f"{name}_idx", _pick_index(seed, key, name, n)) \
            .join(d, f"{name}_idx", "inner").drop(f"{name}_idx")
    fields = {n: n for n in dims}
    return out.withColumn("prompt", C.render_template(PROMPT_SENTENCE, **fields))
