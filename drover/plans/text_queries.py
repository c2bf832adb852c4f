"""Named queries for the text jobs (replies, transcripts, definitions, names,
decisions and generation requests)."""

from __future__ import annotations

from pyspark.sql import functions as F

from drover.functions import text as T
from drover.operators import extract as X
from drover.plans import duck as D
from drover.plans.fixtures import table, view, with_views
from drover.plans.registry import QUERIES, register

_DESC = D.py_strip(D.regexp_extract("response", T.TASK_RE))
_TRUTH = D.py_strip(D.regexp_extract("response", T.TRUTH_RE))
_REASON = (f"CASE WHEN response IS NULL THEN 'no_response' WHEN {_DESC} = '' THEN 'no_task' "
           f"WHEN {_TRUTH} = '' THEN 'no_truth' END")


@register("extract_templates", with_views(f"""
SELECT request_id, {_REASON} AS reject_reason,
       CASE WHEN ({_REASON}) IS NULL THEN {_DESC} END AS description,
       CASE WHEN ({_REASON}) IS NULL THEN {_TRUTH} END AS truth
FROM template_replies
""", "template_replies"), ("R1", "F1"))
def q_extract_templates(spark, sf):
    return X.extract_templates(view(spark, sf, "template_replies")).select(
        "request_id", "reject_reason", "description", "truth")


def _dedent_steps(source: str, column: str, name: str) -> str:
    """CTEs that dedent ``source.column`` into ``name.text``, one step each (inside
    one expression the engine would repeat the steps for every line)."""
    return f"""
{name}_1 AS (SELECT *, list_transform(string_split({column}, chr(10)), lambda l: CASE WHEN regexp_matches(l, '^[ \\t]+\\z') THEN '' ELSE l END) AS ls FROM {source}),
{name}_2 AS (SELECT *, list_transform(list_filter(ls, lambda l: l <> ''), lambda l: regexp_extract(l, '^([ \\t]*)', 1)) AS ind FROM {name}_1),
{name}_3 AS (SELECT *, list_min(ind) AS lo, list_max(ind) AS hi FROM {name}_2),
{name}_4 AS (SELECT *, coalesce(CASE WHEN least(length(lo), length(hi)) <= 0 THEN 0 ELSE coalesce(list_position(list_transform(
    range(1, least(length(lo), length(hi)) + 1), lambda i: substr(lo, i, 1) = substr(hi, i, 1)), false) - 1, least(length(lo), length(hi))) END, 0) AS k FROM {name}_3),
{name} AS (SELECT * EXCLUDE (ls, ind, lo, hi, k), array_to_string(list_transform(ls, lambda l: substr(l, k + 1)), chr(10)) AS text FROM {name}_4)"""


_PY_STEPS = f"""
, {_dedent_steps('code_replies', 'response', 'plain')},
snippet AS (SELECT request_id, CASE WHEN {D.rlike('text', T.PY_FENCE_RE)} THEN {D.regexp_extract('text', T.PY_FENCE_RE)} ELSE text END AS body FROM plain),
{_dedent_steps('snippet', 'body', 'code')}
SELECT request_id, {D.py_rstrip('text')} AS code FROM code
"""


@register("extract_code", with_views(_PY_STEPS.replace("\n, \n", ", \n", 1), "code_replies"), ("R2", "F2", "F12"))
def q_extract_code(spark, sf):
    return X.extract_code(view(spark, sf, "code_replies")).select("request_id", "code")


# the shapes 1 (an open parameter list), 4 and 5 (other languages) don't compile
@register("check_code_compiles", """
SELECT doc_id AS request_id, CASE WHEN doc_id % 7 <> 6 THEN doc_id % 7 NOT IN (1, 4, 5) END AS compiles,
       CASE WHEN doc_id % 7 = 6 THEN 'no_response' WHEN doc_id % 7 IN (1, 4, 5) THEN 'syntax_error' END AS reject_reason
FROM documents
""", ("R2", "F3"))
def q_check_code_compiles(spark, sf):
    return X.extract_code(view(spark, sf, "code_replies"), check=True).select(
        "request_id", "compiles", "reject_reason")


def _dockerfile(x: str) -> str:
    s = D.py_strip(x)
    tagged = "(?s)```(?:Dockerfile|dockerfile)[^\n]*\n(.*?)```"
    lines = f"string_split({s}, chr(10))"
    rest = f"list_slice({lines}, 2, len({lines}))"
    drop_last = f"coalesce({D.py_strip(f'{rest}[-1]')} = '```', false)"
    body = f"CASE WHEN {drop_last} THEN list_slice({rest}, 1, len({rest}) - 1) ELSE {rest} END"
    generic = D.py_strip(f"array_to_string({body}, chr(10))")
    return (f"CASE WHEN {D.rlike(s, tagged)} THEN {D.py_strip(D.regexp_extract(s, tagged))} "
            f"WHEN starts_with({s}, '```') THEN {generic} ELSE {s} END")


_DEF_STEPS = f"""
, cleaned AS (SELECT request_id, response, {D.py_strip("replace(response, chr(13) || chr(10), chr(10))")} AS c FROM code_replies),
fenced AS (SELECT request_id, response, CASE WHEN {D.rlike('c', T.DEF_FENCE_RE)} THEN {D.py_strip(D.regexp_extract('c', T.DEF_FENCE_RE))} ELSE c END AS body FROM cleaned),
{_dedent_steps('fenced', 'body', 'def')}
SELECT request_id, {D.py_strip('text')} AS def_text, {_dockerfile('response')} AS dockerfile FROM def
"""


@register("extract_definitions", with_views(_DEF_STEPS.replace("\n, cleaned", ", cleaned", 1), "code_replies"), ("R3", "F4", "F5"))
def q_extract_definitions(spark, sf):
    return X.extract_definitions(view(spark, sf, "code_replies")).select("request_id", "def_text", "dockerfile")


_CLEAN_LIMIT = T.MAX_OUTPUT_LENGTH


@register("clean_transcripts", with_views(f"""
SELECT page_id, {D.truncate_output(D.clean_output('output'), _CLEAN_LIMIT)} AS cleaned,
       CAST(length(output) - length({D.clean_output('output')}) AS INTEGER) AS chars_saved,
       length({D.clean_output('output')}) > {_CLEAN_LIMIT} AS truncated
FROM terminal_output
""", "terminal_output"), ("R5", "F7", "F8", "F9", "F10"))
def q_clean_transcripts(spark, sf):
    return X.clean_transcripts(view(spark, sf, "terminal_output"), limit=_CLEAN_LIMIT).select(
        "page_id", "cleaned", "chars_saved", "truncated")


def _patch_sql(x: str) -> str:
    lines = f"string_split({x}, chr(10))"
    post = f"coalesce(list_position(list_transform({lines}, lambda l: contains(l, '%') AND contains(lower(l), 'post')), true), 0)"
    nxt = f"coalesce(list_position(list_transform({lines}, lambda l, i: i > {post} AND contains(l, '%')), true), 0)"
    status = (f"CASE WHEN {x} IS NULL THEN NULL WHEN contains({x}, 'chmod 755 /home/user') THEN 'unchanged' "
              f"WHEN {post} = 0 OR {nxt} = 0 THEN 'unpatchable' ELSE 'changed' END")
    patched = (f"array_to_string(list_concat(list_slice({lines}, 1, {nxt} - 1), [{D.lit(T.HOME_MODE_LINE)}], "
               f"list_slice({lines}, {nxt}, len({lines}))), chr(10))")
    return status, (f"CASE WHEN ({status}) = 'unchanged' THEN {x} WHEN ({status}) = 'changed' THEN {patched} END")


_D = "replace(container_def, './base.sif', '/images/base.sif')"
_STATUS, _PATCHED = _patch_sql(_D)


@register("patch_definitions", with_views(f"""
SELECT task_id, {_STATUS} AS patch_status, {_PATCHED} AS patched_def FROM bundles
""", "bundles"), ("R10", "F18", "P11"))
def q_patch_definitions(spark, sf):
    out = X.patch_definitions(view(spark, sf, "bundles"), rewrites={"./base.sif": "/images/base.sif"})
    return out.select("task_id", "patch_status", "patched_def")


_NAME = "printf('task_%06d_%s', 0, substr(sha256(task_id), 1, 8))"


@register("assign_names", with_views(f"""
SELECT task_id, {_NAME} AS task_name, {D.lit(T.IMAGE_PREFIX)} || replace(lower({_NAME}), '_', '-') AS image_name
FROM bundles
""", "bundles"), ("R11", "F21", "F22"))
def q_assign_names(spark, sf):
    return X.assign_names(view(spark, sf, "bundles").select("task_id"))


# tasks of several sources under the same ids
_SHARED_ID = "concat('task_', cast(doc_id % 300 AS varchar(20)))"


@register("name_collisions", with_views(f"""
SELECT task_name, count(*) AS n_tasks FROM (SELECT {_NAME} AS task_name FROM (SELECT {_SHARED_ID} AS task_id FROM bundles) b) n
GROUP BY task_name HAVING count(*) > 1
""", "bundles"), ("R11",))
def q_name_collisions(spark, sf):
    return X.name_collisions(X.assign_names(view(spark, sf, "bundles").select(F.expr(_SHARED_ID).alias("task_id"))))


_DEC_VALID = """(json_valid(json) AND json_type(json) = 'OBJECT'
  AND len(list_filter(json_keys(json), lambda k: k NOT IN ('type', 'command', 'timeout_sec'))) = 0
  AND list_contains(json_keys(json), 'type') AND json_type(json, '$.type') = 'VARCHAR'
  AND json_extract_string(json, '$.type') IN ('command', 'done', 'invalid')
  AND (NOT list_contains(json_keys(json), 'command') OR json_type(json, '$.command') IN ('VARCHAR', 'NULL'))
  AND (NOT list_contains(json_keys(json), 'timeout_sec')
       OR json_type(json, '$.timeout_sec') IN ('BIGINT', 'UBIGINT', 'DOUBLE', 'NULL')
       OR (json_type(json, '$.timeout_sec') = 'VARCHAR' AND regexp_full_match(
           trim(json_extract_string(json, '$.timeout_sec')), '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?'))))"""


@register("parse_decisions", with_views(f"""
SELECT event_id, coalesce({_DEC_VALID}, false) AS valid,
       CASE WHEN {_DEC_VALID} THEN json_extract_string(json, '$.type') END AS type,
       CASE WHEN {_DEC_VALID} THEN json_extract_string(json, '$.command') END AS command,
       CASE WHEN {_DEC_VALID} THEN (CASE WHEN NOT list_contains(json_keys(json), 'timeout_sec') THEN 180.0
            ELSE TRY_CAST(trim(json_extract_string(json, '$.timeout_sec')) AS DOUBLE) END) END AS timeout_sec
FROM decisions
""", "decisions"), ("R12", "F24"))
def q_parse_decisions(spark, sf):
    return X.parse_decisions(view(spark, sf, "decisions")).select(
        "event_id", "valid", "type", "command", "timeout_sec")


_DIMS_SQL = """
dims AS (SELECT (SELECT list_sort(list(DISTINCT p_type)) FROM part) AS category,
                (SELECT list_sort(list(DISTINCT r_name)) FROM region) AS complexity,
                (SELECT list_sort(list(DISTINCT n_name)) FROM nation) AS scenario),
picks AS (SELECT d.doc_id AS request_id,
                 {cat} AS category, {cx} AS complexity, {sc} AS scenario
          FROM documents d)
"""


def _pick_sql(dim: str) -> str:
    key = f"'42:' || CAST(d.doc_id AS VARCHAR) || ':{dim}'"
    arr = f"(SELECT {dim} FROM dims)"
    return f"{arr}[(CAST('0x' || substr(md5({key}), 1, 8) AS BIGINT) % len({arr})) + 1]"


_PROMPT_HEAD, _rest = X.PROMPT_SENTENCE.split("{category}")
_PROMPT_MID1, _rest = _rest.split("{complexity}")
_PROMPT_MID2, _PROMPT_TAIL = _rest.split("{scenario}")


@register("sample_prompts", "WITH " + _DIMS_SQL.format(
    cat=_pick_sql("category"), cx=_pick_sql("complexity"), sc=_pick_sql("scenario")) + f"""
SELECT request_id, category, complexity, scenario,
       {D.lit(_PROMPT_HEAD)} || category || {D.lit(_PROMPT_MID1)} || complexity || {D.lit(_PROMPT_MID2)}
         || scenario || {D.lit(_PROMPT_TAIL)} AS prompt
FROM picks
""", ("R13", "F27", "P7"))
def q_sample_prompts(spark, sf):
    reqs = table(spark, sf, "documents").select(F.col("doc_id").alias("request_id"))
    dims = {"category": (table(spark, sf, "part"), "p_type"),
            "complexity": (table(spark, sf, "region"), "r_name"),
            "scenario": (table(spark, sf, "nation"), "n_name")}
    return X.sample_prompts(reqs, dims, 42).select("request_id", "category", "complexity", "scenario", "prompt")


# --- the rules as SQL functions, against the same oracles ---------------------------
def _sql(spark, text: str, **views):
    from drover.functions.sql import register_sql_functions
    register_sql_functions(spark)
    return spark.sql(text, **views)


@register("extract_code_sql", QUERIES["extract_code"].oracle, ("U3", "F2", "F12"))
def q_extract_code_sql(spark, sf):
    return _sql(spark, "SELECT request_id, extract_python_code(response) AS code FROM {r}", r=view(spark, sf, "code_replies"))


@register("extract_definitions_sql", QUERIES["extract_definitions"].oracle, ("U3", "F4", "F5"))
def q_extract_definitions_sql(spark, sf):
    return _sql(spark, "SELECT request_id, extract_def_text(response) AS def_text, extract_fenced_block(response, 'dockerfile') AS dockerfile FROM {r}",
                r=view(spark, sf, "code_replies"))


@register("clean_transcripts_sql", QUERIES["clean_transcripts"].oracle, ("U3", "F7", "F8", "F9", "F10"))
def q_clean_transcripts_sql(spark, sf):
    return _sql(spark, f"""
        SELECT page_id, truncate_output(whole) AS cleaned, length(output) - length(whole) AS chars_saved, length(whole) > {_CLEAN_LIMIT} AS truncated
        FROM (SELECT *, clean_output(output) AS whole FROM {{t}})""", t=view(spark, sf, "terminal_output"))


@register("patch_definitions_sql", QUERIES["patch_definitions"].oracle, ("U3", "F18"))
def q_patch_definitions_sql(spark, sf):
    return _sql(spark, """
        SELECT task_id, home_mode_status(d) AS patch_status, patch_home_mode(d) AS patched_def
        FROM (SELECT task_id, replace(container_def, './base.sif', '/images/base.sif') AS d FROM {b})""", b=view(spark, sf, "bundles"))


@register("parse_decisions_sql", QUERIES["parse_decisions"].oracle, ("U3", "F24"))
def q_parse_decisions_sql(spark, sf):
    return _sql(spark, "SELECT event_id, d.* FROM (SELECT event_id, parse_decision(json) AS d FROM {j})", j=view(spark, sf, "decisions"))
