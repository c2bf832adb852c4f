"""Fixture views: driver tables mapped onto the input shapes of the task and
trajectory formats (see FIXTURES.md).  The same SQL text is registered in Spark
and prepended (as CTEs) to every DuckDB oracle query, so both engines see the
same rows.  The modulo expressions only vary the injected shapes; no view drops
source rows to make a check cheaper.

Difference from FIXTURES.md: where that text embedded a prefix of a document,
conversation or page (``substr(text, 1, n)``), the views here embed the whole
text, so every query processes whole texts.  Tags, markers and noise lines are
injected exactly as described there.  ``summaries`` lists the two models with a
UNION ALL of two aggregates instead of a cross join (same rows)."""

from __future__ import annotations

import re

VIEWS: dict[str, str] = {}

VIEWS["bundles"] = """\
SELECT concat('task_', lpad(cast(doc_id AS varchar(20)), 6, '0')) AS task_id, doc_id, lang, source,
       CASE WHEN doc_id % 10 = 7 THEN NULL ELSE substr(text, 1, cast(floor(n_chars / 2.0) AS int)) END AS description,
       CASE WHEN doc_id % 11 = 3 THEN '  ' ELSE substr(text, cast(floor(n_chars / 2.0) AS int) + 1) END AS truth,
       CASE WHEN doc_id % 4 = 1 THEN 'def test_a(:' ELSE concat('def test_a():', chr(10), '    assert ', cast(doc_id AS varchar(20)), ' >= 0') END AS initial_test,
       CASE WHEN doc_id % 13 = 5 THEN NULL ELSE concat('def test_b():', chr(10), '    assert True') END AS final_test,
       CASE doc_id % 9
         WHEN 1 THEN concat('Bootstrap: localimage', chr(10), 'From: ./base.sif', chr(10), '%post', chr(10), '    chmod 755 /home/user', chr(10), '%environment', chr(10), '    export A=1')
         WHEN 2 THEN concat('Bootstrap: localimage', chr(10), 'From: ./base.sif', chr(10), '%post', chr(10), '    echo ', lang)
         WHEN 3 THEN concat('From: ./base.sif', chr(10), 'no sections')
         ELSE concat('Bootstrap: localimage', chr(10), 'From: ./base.sif', chr(10), '%post', chr(10), '    echo ', lang, chr(10), '%environment', chr(10), '    export A=1') END AS container_def
FROM documents
"""

VIEWS["template_replies"] = """\
SELECT doc_id AS request_id,
       CASE WHEN doc_id % 9 = 4 THEN NULL
            WHEN doc_id % 9 = 5 THEN text
            WHEN doc_id % 9 = 6 THEN concat('<task> </task><truth>x</truth>')
            ELSE concat('note <task>', chr(10), ' ', text, chr(10), '</task> mid <truth> t', cast(doc_id AS varchar(20)), ' </truth> <task>second</task>') END AS response
FROM documents
"""

# Whole documents as prose around the fences and as comment lines inside them;
# fences and carriage returns of the text itself would change the shapes.
VIEWS["code_replies"] = """\
SELECT request_id,
       CASE request_id % 7
         WHEN 0 THEN concat('Intro ', prose, chr(10), '```python', chr(10), '    x = ', id, chr(10), '    # ', noted, chr(10), '    y = 2', chr(10), '```', chr(10), 'Outro')
         WHEN 1 THEN concat(prose, chr(10), '```', chr(10), 'def f(', chr(10), '# ', remark, chr(10), '```')
         WHEN 2 THEN concat('```Python', chr(10), 'a = 1', chr(10), '# ', remark, chr(10), '```', chr(10), prose, chr(10), '```python', chr(10), 'b = 2', chr(10), '```')
         WHEN 3 THEN concat('z = ', id, chr(10), '# ', remark, chr(10), chr(10))
         WHEN 4 THEN concat('```singularity', chr(10), 'Bootstrap: localimage', chr(10), prose, chr(10), '```')
         WHEN 5 THEN concat(prose, chr(10), CASE WHEN request_id % 2 = 0 THEN '```dockerfile' ELSE '```Dockerfile' END, chr(10), 'FROM ubuntu:22.04', chr(10), '# ', remark, chr(10), 'RUN true', chr(10), '```', chr(10), 'done') END AS response
FROM (SELECT request_id, id, prose, replace(prose, chr(10), concat(chr(10), '# ')) AS remark, replace(prose, chr(10), concat(chr(10), '    # ')) AS noted
      FROM (SELECT doc_id AS request_id, cast(doc_id AS varchar(20)) AS id, replace(replace(coalesce(text, ''), '```', '~~~'), chr(13), ' ') AS prose FROM documents) d) p
"""

# chats of many commands, made of events
VIEWS["long_chats"] = """\
SELECT run_id, turn, CASE WHEN turn = 1 THEN 'system' WHEN turn % 2 = 0 THEN 'user' ELSE 'assistant' END AS role,
       CASE WHEN turn = 1 THEN 'You are an agent.' WHEN turn % 2 = 0 THEN concat('out ', cast(event_id AS varchar(20)), chr(10), repeat(props, cast(event_id % 30 AS int)))
            WHEN event_id % 97 = 5 THEN '<action>done</action>' WHEN event_id % 11 = 3 THEN concat('thinking about ', event_type)
            WHEN event_id % 13 = 4 THEN '<command> </command>'
            ELSE concat('<command>', event_type, ' ', cast(event_id AS varchar(20)), '</command>') END AS content
FROM (SELECT user_id AS run_id, cast(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS int) AS turn, event_id, event_type, props FROM events) e
"""

VIEWS["responses"] = """\
SELECT conv_id AS run_id, turn, role,
       CASE WHEN role = 'user' AND conv_id % 29 = 3 THEN repeat(text, cast(floor(60000.0 / (length(text) + 1)) AS int) + 1)
            WHEN role <> 'assistant' THEN text ELSE
         CASE (conv_id * 7 + turn) % 6
           WHEN 0 THEN concat('<think>ok</think><command> ls ', cast(turn AS varchar(20)), ' </command>')
           WHEN 1 THEN concat('<command>a</command> x <COMMAND>', chr(10), 'cat f', cast(conv_id AS varchar(20)), '</COMMAND>')
           WHEN 2 THEN '<action> Done </action><command>ls</command>'
           WHEN 3 THEN '<command>DONE</command>'
           WHEN 4 THEN '<command></command>'
           ELSE text END END AS content
FROM conversations
"""

VIEWS["runs"] = """\
SELECT concat(d.lang, '-', d.source) AS task_id,
       cast(row_number() OVER (PARTITION BY d.lang, d.source ORDER BY d.doc_id) - 1 AS int) AS attempt,
       (l.quality = 1 AND d.doc_id % 3 = 0) AS success
FROM documents d JOIN labels l ON d.doc_id = l.doc_id
"""

VIEWS["summaries"] = """\
SELECT concat(lang, '-', source) AS task_id, 'ref' AS model, count(*) AS num_runs,
       sum(CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END) AS num_success
FROM documents
GROUP BY lang, source
UNION ALL
SELECT concat(lang, '-', source) AS task_id, 'cand' AS model, count(*) AS num_runs,
       sum(CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END) AS num_success
FROM documents WHERE source < 'src2'
GROUP BY lang, source
"""

VIEWS["steps"] = """\
SELECT user_id AS run_id, cast(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS int) AS turn, ts,
       CASE event_type WHEN 'signup' THEN 'done' WHEN 'error' THEN 'invalid' ELSE 'command' END AS action_type,
       user_id % 3 <> 0 AS verifier_passes
FROM events
"""

VIEWS["chunks"] = """\
SELECT conv_id AS session_id, turn AS seq,
       CASE turn % 3
         WHEN 1 THEN concat(text, chr(10), '__CMD_DONE__ab12__:')
         WHEN 2 THEN concat(cast(conv_id % 2 AS varchar(5)), chr(10), text)
         ELSE text END AS chunk
FROM conversations
"""

VIEWS["timed_chunks"] = """\
SELECT conv_id AS session_id, turn AS seq,
       CASE turn % 3
         WHEN 1 THEN concat(text, chr(10), '__CMD_DONE__ab12__:')
         WHEN 2 THEN concat(cast(conv_id % 2 AS varchar(5)), chr(10), text)
         ELSE text END AS chunk,
       cast('2024-01-01 00:00:00' AS timestamp) + INTERVAL '1' SECOND * cast(turn * (conv_id % 4) * 3 AS int) AS ts
FROM conversations
"""

VIEWS["shell_chunks"] = """\
SELECT user_id AS session_id, cast(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS bigint) AS seq, ts,
       CASE event_type
         WHEN 'view' THEN concat('part ', cast(event_id AS varchar(20)), ' ')
         WHEN 'click' THEN concat('row ', cast(event_id AS varchar(20)), chr(10), repeat(props, cast(event_id % 40 AS int)), chr(10))
         WHEN 'purchase' THEN concat(props, chr(10), 'x', chr(10))
         WHEN 'error' THEN concat(chr(10), '__CMD_DONE__ab12__:', cast(event_id % 3 AS varchar(5)), chr(10))
         ELSE concat('end', chr(10), '__CMD_DONE__ab12__:') END AS chunk
FROM events
"""

# a user's ten days are one run: some end, some stay open, some pause for days
VIEWS["agent_steps"] = """\
SELECT run_id, cast(row_number() OVER (PARTITION BY run_id ORDER BY ts, event_id) AS int) AS turn, ts, action_type,
       run_id % 3 <> 0 AS verifier_passes, event_id
FROM (SELECT user_id * 10 + cast(floor((extract(day FROM ts) - 1) / 10.0) AS int) AS run_id, ts, event_id,
             CASE WHEN event_type = 'signup' AND event_id % 4 = 0 THEN 'done' WHEN event_type = 'error' THEN 'invalid' ELSE 'command' END AS action_type
      FROM events) e
"""

VIEWS["rewarded_steps"] = """\
SELECT user_id AS run_id, cast(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS int) AS turn,
       CASE event_type WHEN 'purchase' THEN 1.0 WHEN 'error' THEN -0.5 WHEN 'signup' THEN NULL ELSE 0.0 END AS reward
FROM events
"""

# one run in three of the lines belongs to one order: a run of very many turns
VIEWS["long_steps"] = """\
SELECT CASE WHEN l_orderkey % 3 = 0 THEN 0 ELSE l_orderkey END AS run_id,
       cast(row_number() OVER (PARTITION BY CASE WHEN l_orderkey % 3 = 0 THEN 0 ELSE l_orderkey END ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate, l_returnflag) AS int) AS turn,
       CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS reward
FROM lineitem
"""

VIEWS["path_tasks"] = """\
SELECT concat('page_', cast(page_id AS varchar(20))) AS task_id,
       concat('Fetch ', url, ' and save it as /home/user/site', CASE WHEN page_id % 2 = 0 THEN '/raw' ELSE '' END, '/page', cast(page_id % 7 AS varchar(20)),
              '.html; log to /home/user/log', cast(page_id % 3 AS varchar(20)), '/fetch.log. ', html) AS description,
       CASE page_id % 5 WHEN 0 THEN concat('assert not os.path.exists("/home/user/site/raw/page', cast(page_id % 7 AS varchar(20)), '.html")')
            WHEN 1 THEN 'assert os.path.isdir("/home/user/site")'
            WHEN 2 THEN 'assert os.path.isfile("/home/user/log2/fetch.log.1") or os.path.exists("/home/user/log2/fetch.log/old")'
            WHEN 3 THEN NULL ELSE html END AS initial_test,
       concat('mkdir -p /home/user/log', cast(page_id % 4 AS varchar(20)), ' /var/lib/app', chr(10), 'touch /home/user/notes.txt') AS container_def
FROM pages
"""

VIEWS["conversion_results"] = """\
SELECT concat('task_', lpad(cast(o_orderkey AS varchar(20)), 6, '0')) AS task_id,
       o_orderkey % 10 <> 0 AS dockerfile_generated,
       (o_orderkey % 10 <> 0 AND o_orderstatus <> 'P') AS docker_build_success,
       (o_orderkey % 10 <> 0 AND o_orderstatus = 'F') AS tests_passed,
       CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE (o_orderkey % 10 <> 0 AND o_orderstatus = 'F') END AS success,
       CASE o_orderkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 137 WHEN 2 THEN 1 END AS exit_code
FROM orders
"""

VIEWS["terminal_output"] = """\
SELECT page_id, concat(chr(27), '[31m',
       CASE WHEN page_id % 25 = 3 THEN repeat(html, cast(floor(60000.0 / (length(html) + 1)) AS int) + 1) ELSE html END, chr(27), '[0m', chr(13), chr(10),
       'bash: no job control in this shell', chr(10), chr(10), chr(10), chr(10), 'WARNING: TERM environment variable not set x', chr(10), 'end  ') AS output
FROM pages
"""

VIEWS["dockerfiles"] = """\
SELECT p_partkey AS task_key, concat('FROM ubuntu:', cast(p_size % 3 + 20 AS varchar(5)), '.04', chr(10), 'RUN echo FROM x', chr(10),
       '  from ', lower(p_type), ' AS build', chr(10), 'FROM', chr(10)) AS dockerfile
FROM part
"""

VIEWS["benchmark_logs"] = """\
SELECT s_name AS task_name,
       concat('start', chr(10), CASE WHEN s_suppkey % 7 = 0 THEN 'no result' ELSE concat('│ Mean │ 0.', cast(s_suppkey % 10 AS varchar(5)), ' │') END, chr(10),
              CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE concat('│ Errors │ ', cast(s_suppkey % 4 AS varchar(5)), ' │') END, chr(10), CASE WHEN s_suppkey % 7 = 0 THEN 'end' ELSE 'Mean 9.9' END) AS log
FROM supplier
"""

# requests of up to five tries each; a try without an error is the last one that counts
VIEWS["request_attempts"] = """\
SELECT user_id * 1000 + cast(floor((n - 1) / 5.0) AS int) AS request_id, cast((n - 1) % 5 AS int) AS attempt,
       CASE event_id % 8 WHEN 0 THEN 'Rate limit: 429' WHEN 1 THEN 'Request TIMEOUT' WHEN 2 THEN 'bad gateway' WHEN 3 THEN 'Server OVERLOADED'
            WHEN 4 THEN 'HTTP 429' END AS error
FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) e
"""

VIEWS["decisions"] = """\
SELECT event_id, CASE WHEN event_id % 28 = 5 THEN '{"type":"done","timeout_sec":" 7.5 "}'
         WHEN event_id % 28 = 9 THEN '{"type":"done","timeout_sec":"soon"}'
         WHEN event_id % 4 = 0 THEN concat('{"type":"command","command":"ls ', cast(user_id AS varchar(20)), '"}')
         WHEN event_id % 4 = 1 THEN '{"type":"done","timeout_sec":5}'
         WHEN event_id % 4 = 2 THEN '{"type":"command","command":"x","extra":1}'
         ELSE props END AS json
FROM events
"""


# Base tables each view reads.
BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
               "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
VIEW_TABLES = {name: sorted(set(re.findall(r"(?:FROM|JOIN)\s+([a-z_]+)", body)) & set(BASE_TABLES))
               for name, body in VIEWS.items()}


def _private_name(table: str, sf_dir: str) -> str:
    import hashlib
    return f"_drover_{table}_{hashlib.sha1(sf_dir.encode()).hexdigest()[:10]}"


def register_tables(spark, sf_dir: str, tables) -> dict:
    """Register driver tables as temp views under private names (so views the
    caller may have are never replaced); lazy parquet scans, no data read."""
    names = {}
    for t in tables:
        names[t] = _private_name(t, sf_dir.rstrip("/"))
        spark.read.parquet(f"{sf_dir.rstrip('/')}/{t}.parquet").createOrReplaceTempView(names[t])
    return names


def view(spark, sf_dir: str, name: str):
    """A fixture view as a Spark DataFrame: the shared SQL text with its table
    references pointed at the private views of ``sf_dir`` (analysed at once,
    so the plan is bound to those tables)."""
    names = register_tables(spark, sf_dir, VIEW_TABLES[name])
    sql = VIEWS[name]
    for t, private in names.items():
        sql = re.sub(rf"\b(FROM|JOIN)(\s+){t}\b", rf"\1\g<2>{private}", sql)
    return spark.sql(sql)


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def with_views(sql: str, *names: str) -> str:
    """Prefix an oracle query with the fixture views it reads, as CTEs."""
    ctes = ",\n".join(f"{n} AS (\n{VIEWS[n].rstrip()}\n)" for n in names)
    return f"WITH {ctes}\n{sql}" if names else sql
