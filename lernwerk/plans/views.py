"""Fixture views: the reference tables re-enacted over the driver's tables, as one SQL text for two engines."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..session import bound_methods

# The nine classes, in their canonical order, and spellings met in labels.
NINE = ["O(1)", "O(log n)", "O(sqrt n)", "O(n)", "O(n log n)", "O(n^2)", "O(2^n)", "O(n!)", "O(V + E)"]
SPELLINGS = ["O(1)", "o(log n)", "sqrt(n)", "Linear", "O(n log n)", "quadratic", "O(2^n)", "O(n!)", "O(V+E)", "O(n * m)", "O(m^2 + e)", "O(n^3)", "constant", "-", "T(n) = 2T(n/2) + O(n)", "O(n^1.58)", "O(n + m)", "3^n"]

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")


def pick(expr: str, values: list[str]) -> str:
    return f"CASE {expr} % {len(values)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


SUB_ID = "CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING)"

#: Texts hold {table} and {view} names, {ms:column} for epoch milliseconds and {at:column} for their timestamp.
VIEWS: dict[str, str] = {
    "v_users": """
        SELECT c_custkey AS user_key, 'u' || CAST(c_custkey AS STRING) || '@x.org' AS email, c_name AS name,
               CASE WHEN c_custkey % 50 = 0 THEN 'admin' ELSE 'learner' END AS role, c_custkey % 50 = 0 AS is_admin,
               CASE WHEN c_acctbal < 0 THEN 'suspended' ELSE 'active' END AS status, c_acctbal AS balance FROM {customer}""",
    "v_submissions": f"""
        SELECT /*+ MERGE(o) */ {SUB_ID} AS sub_id, 'u' || CAST(o_custkey AS STRING) || '@x.org' AS owner,
               CASE WHEN l_suppkey % 11 = 0 THEN NULL ELSE 'm' || CAST(l_suppkey % 7 AS STRING) END AS module,
               'a' || CAST(l_linenumber AS STRING) AS activity,
               CASE WHEN l_returnflag = 'R' THEN 'optimization' WHEN l_returnflag = 'A' THEN 'activity' END AS type,
               CASE WHEN l_linestatus = 'F' THEN 'passed' ELSE 'failed' END AS status,
               CASE WHEN l_partkey % 13 = 0 THEN NULL WHEN l_partkey % 13 = 1 THEN 0.0 ELSE CAST(CAST(l_quantity AS INT) AS DOUBLE) END AS passed_tests,
               CASE WHEN l_partkey % 17 = 0 THEN CAST(0 AS DOUBLE) WHEN l_partkey % 17 = 1 THEN NULL ELSE CAST(50 AS DOUBLE) END AS total_tests,
               CASE WHEN l_partkey % 5 = 0 THEN CAST(CAST(l_quantity AS INT) % 40 AS DOUBLE) END AS passed_cases,
               CASE WHEN l_partkey % 5 = 0 THEN CAST(40 AS DOUBLE) END AS total_cases,
               CASE WHEN l_linenumber % 3 = 0 THEN CAST(10 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS functional_total,
               CASE WHEN l_linenumber % 3 = 0 THEN CAST(CAST(l_quantity AS INT) % 11 AS DOUBLE) END AS functional_passed,
               CASE WHEN l_linenumber % 4 = 0 THEN CAST(4 AS DOUBLE) END AS hidden_total,
               CASE WHEN l_linenumber % 4 = 0 THEN CAST(CAST(l_quantity AS INT) % 5 AS DOUBLE) END AS hidden_passed,
               CASE CAST(l_quantity AS INT) % 5 WHEN 0 THEN '' WHEN 1 THEN 'functional:passed,complexity:failed' WHEN 2 THEN 'other:passed,hidden:passed,hidden:failed'
                    WHEN 3 THEN 'complexity:passed,functional:failed,functional:passed' ELSE ':passed,:failed' END AS tests,
               CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE CAST(floor(l_quantity * 2 * (1 - l_discount)) AS DOUBLE) END AS final_aes,
               CAST(floor(l_quantity * (1 - l_discount)) AS DOUBLE) AS initial_aes,
               CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE CAST(floor(l_quantity * 1.5 * (1 - l_discount)) AS DOUBLE) END AS latest_aes,
               CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE CAST(floor(l_quantity * 2 * (1 - l_discount)) - floor(l_quantity * (1 - l_discount)) AS DOUBLE) END AS rog,
               l_tax = 0 AS code_unchanged, {{ms:l_shipdate}} AS ts,
               {pick("l_partkey", NINE)} AS target_time, {pick("l_suppkey", NINE)} AS target_space,
               {pick("(l_partkey + l_linenumber)", SPELLINGS)} AS latest_time, {pick("(l_suppkey + 2 * l_linenumber)", SPELLINGS)} AS latest_space,
               {pick("(l_partkey + l_suppkey)", SPELLINGS)} AS baseline_time, CASE WHEN l_partkey % 10 = 0 THEN NULL ELSE {pick("(l_partkey + 3 * l_suppkey)", NINE)} END AS baseline_space
        FROM {{lineitem}} JOIN {{orders}} o ON l_orderkey = o_orderkey""",
    "v_assessments": """
        SELECT 'u' || CAST(c_custkey AS STRING) || '@x.org' AS email, 'course-pre-test' AS assessment_key,
               CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE CAST(c_custkey * 37 % 101 AS DOUBLE) END AS score,
               CAST(c_custkey * 37 % 101 AS DOUBLE) AS correct, CAST(CASE WHEN c_custkey % 29 = 0 THEN 0 ELSE 100 END AS DOUBLE) AS total, CAST(c_custkey % 4 AS INT) AS attempts
        FROM {customer} WHERE c_custkey % 19 <> 0
        UNION ALL
        SELECT 'u' || CAST(c_custkey AS STRING) || '@x.org', 'Course_Post Test',
               CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE CAST(least(100, c_custkey * 37 % 101 + c_custkey * 13 % 60) AS DOUBLE) END,
               CAST(least(100, c_custkey * 37 % 101 + c_custkey * 13 % 60) AS DOUBLE), CAST(100 AS DOUBLE), CAST(c_custkey % 3 AS INT)
        FROM {customer} WHERE c_custkey % 23 <> 0
        UNION ALL
        SELECT 'u' || CAST(c_custkey AS STRING) || '@x.org', 'm1-quiz', CAST(c_custkey % 100 AS DOUBLE), CAST(1 AS DOUBLE), CAST(2 AS DOUBLE), 1 FROM {customer}""",
    "v_predictions": f"""
        SELECT {SUB_ID} AS program, 'chunk' || CAST(l_suppkey % 4 AS STRING) AS source_file,
               {pick("l_partkey", NINE)} AS expected_time, {pick("l_suppkey", NINE)} AS expected_space,
               CASE WHEN l_linenumber % 3 = 0 THEN {pick("(l_partkey + l_linenumber)", SPELLINGS)} ELSE {pick("l_partkey", NINE)} END AS predicted_time,
               CASE WHEN l_linenumber % 2 = 0 THEN {pick("(l_suppkey + l_linenumber)", SPELLINGS)} ELSE {pick("l_suppkey", NINE)} END AS predicted_space,
               l_partkey % 37 = 0 AS failed, l_extendedprice / 1000 AS ms, CAST(l_quantity AS INT) AS n_lines, l_quantity / 2 + l_discount * 100 AS memory_mb
        FROM {{lineitem}}""",
    "v_expected_lines": f"SELECT l_orderkey AS program, l_linenumber AS lineno, max({pick('l_partkey', NINE)}) AS label FROM {{lineitem}} WHERE l_partkey % 5 <> 0 GROUP BY l_orderkey, l_linenumber",
    "v_predicted_lines": f"SELECT l_orderkey AS program, l_linenumber AS lineno, max({pick('(l_partkey + l_linenumber % 2)', NINE)}) AS label, max(l_suppkey % 6 = 0) AS is_comment FROM {{lineitem}} WHERE l_partkey % 4 <> 0 GROUP BY l_orderkey, l_linenumber",
    "v_code_lines": "SELECT l_orderkey AS program, l_linenumber AS lineno, CASE WHEN max(l_partkey) % 6 = 0 THEN '  # note' WHEN max(l_partkey) % 6 = 1 THEN '' ELSE 'x = 1' END AS source FROM {lineitem} GROUP BY l_orderkey, l_linenumber",
    "v_attempts": f"""
        SELECT /*+ MERGE(o) */ 'u' || CAST(o_custkey AS STRING) || '@x.org' AS owner, 'a' || CAST(l_partkey % 5 AS STRING) AS activity, {{ms:l_shipdate}} AS ts, {SUB_ID} AS attempt_id,
               CAST(l_quantity * 2 AS DOUBLE) AS aes, ' c' || CAST(CAST(l_quantity AS INT) % 4 AS STRING) || ' ' AS code,
               CASE WHEN l_partkey % 5 < 3 THEN 'optimization' ELSE 'activity' END AS type
        FROM {{lineitem}} JOIN {{orders}} o ON l_orderkey = o_orderkey""",
    "v_changes": """
        SELECT 'u' || CAST(user_id AS STRING) || CASE WHEN user_id % 40 = 0 THEN '@guest.local' ELSE '@x.org' END AS email, 'k' || CAST(event_id % 7 AS STRING) AS item,
               value AS score, CASE WHEN event_id % 11 = 0 THEN CAST(0 AS BIGINT) WHEN event_id % 13 = 0 THEN NULL ELSE {ms:ts} + event_id * 7919 % 100000000 END AS version,
               event_id AS seq, CASE WHEN event_id % 4 = 0 THEN NULL ELSE CAST(event_id * 31 % 6 AS INT) END AS attempts,
               CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(event_id % 10 AS INT) END AS correct, event_id % 5 = 0 AS passed, event_type, props FROM {events}""",
    # Events of a month within hours, of few accounts: quotas are met often. Every fourth request has no valid token.
    "v_requests": """SELECT event_id, {at:ms} AS ts, ms, account, address || ', 192.168.0.1' AS forwarded, event_id % 4 <> 0 AS token_valid, route,
                     CASE WHEN event_id % 4 <> 0 THEN account ELSE address END AS bucket
                     FROM (SELECT event_id, 1700000000000 + {ms:ts} % 2592000000 % 9000000 AS ms, 'u' || CAST(user_id % 40 AS STRING) AS account,
                           '10.0.0.' || CAST(user_id % 9 AS STRING) AS address, event_type AS route FROM {events}) r""",
    # Every third account fails nearly always.
    "v_logins": """SELECT event_id, {at:ms} AS ts, ms, account, failure FROM (SELECT event_id, 1700000000000 + {ms:ts} % 2592000000 % 18000000 AS ms, 'u' || CAST(user_id AS STRING) AS account,
                   CASE WHEN user_id % 3 = 0 THEN event_id % 20 <> 0 ELSE event_type = 'error' END AS failure FROM {events}) l""",
    # Programs of thousands of functions: modules of 25 that call within, and into the next of their four.
    "v_edges": """SELECT DISTINCT program, CAST(caller AS INT) AS caller,
                  CAST(caller - caller % 25 + CASE WHEN l_linenumber > 5 AND caller % 100 < 75 THEN 25 ELSE 0 END + (l_orderkey * 3 + l_suppkey + l_linenumber * 5) % 25 AS INT) AS callee
                  FROM (SELECT CAST(l_suppkey - l_suppkey % 10 AS BIGINT) AS program, (l_partkey * 37 + l_orderkey * 11 + l_linenumber * 7) % 5000 AS caller, l_orderkey, l_suppkey, l_linenumber
                        FROM {lineitem}) e""",
    "v_calls": """SELECT CAST(l_suppkey AS BIGINT) AS program, CASE WHEN l_partkey % 10 = 0 THEN NULL ELSE 'f' || CAST(l_partkey % 40 AS STRING) END AS caller,
                  CASE WHEN l_linenumber = 7 THEN 'print' ELSE 'f' || CAST((l_partkey * 7 + l_linenumber) % 40 AS STRING) END AS callee, l_linenumber AS line FROM {lineitem}""",
    "v_code": "SELECT doc_id, text AS code, lang, source FROM {documents}",
}


def _names(text: str) -> set[str]:
    return {n for n in (*TABLES, *VIEWS) if "{" + n + "}" in text}


def _macro(text: str, name: str, form: str) -> str:
    """Put ``form`` in place of {name:column}."""
    return re.sub(r"\{" + name + r":(\w+)\}", lambda m: form.format(m[1]), text)


def spark_text(text: str) -> str:
    text = _macro(text, "ms", "(timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {}) DIV 1000)")
    return _macro(text, "at", "timestampadd(MILLISECOND, {}, TIMESTAMP_NTZ '1970-01-01 00:00:00')")


def duck_text(text: str) -> str:
    text = _macro(_macro(text, "ms", "(epoch_us({}) // 1000)"), "at", "make_timestamp({} * 1000)")
    for n in _names(text):
        text = text.replace("{" + n + "}", n)
    return text


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view, or a table of that name, as a DataFrame."""
    if name in TABLES:
        return table(spark, sf_dir, name)
    text = spark_text(VIEWS[name])
    return bound_methods(spark).sql(text, **{n: view(spark, sf_dir, n) for n in _names(text)})


def with_views(sql: str) -> str:
    """DuckDB text with the views that it names put before it."""
    used: list[str] = []

    def need(text: str) -> None:
        for n in VIEWS:
            if n in text and n not in used:
                need(VIEWS[n])
                used.append(n)

    need(sql)
    parts = ", ".join(f"{n} AS ({duck_text(VIEWS[n])})" for n in used)
    head, rest = ("WITH RECURSIVE ", sql.strip().removeprefix("WITH RECURSIVE ")) if sql.strip().startswith("WITH RECURSIVE") else ("WITH ", sql.strip().removeprefix("WITH ") if sql.strip().startswith("WITH ") else None)
    if not used:
        return sql
    return f"{head}{parts}, {rest}" if rest is not None and rest != sql.strip() or sql.strip().startswith("WITH") else f"WITH {parts} {sql}"
