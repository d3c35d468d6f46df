"""The scalar rules as SQL functions: ``register(spark)`` and then ``SELECT clean_key(k) FROM t``."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .student_t import t_critical, t_two_tailed_p

#: Native SQL functions, so that they stay inside generated code: (name and parameters, type, body).
FUNCTIONS = [
    ("clean_key(c STRING)", "STRING", "translate(lower(c), '-_ ', '')"),
    ("extract_score(score DOUBLE, correct DOUBLE, total DOUBLE)", "DOUBLE", "coalesce(score, try_divide(correct, total) * 100)"),
    ("interpret_effect(d DOUBLE)", "STRING", "CASE WHEN abs(d) >= 0.8 THEN 'Large Effect' WHEN abs(d) >= 0.5 THEN 'Medium Effect' WHEN abs(d) >= 0.2 THEN 'Small Effect' WHEN d IS NOT NULL THEN 'Negligible Effect' END"),
    ("interpret_gain(g DOUBLE)", "STRING", "CASE WHEN g >= 0.7 THEN 'High Gain' WHEN g >= 0.3 THEN 'Medium Gain' WHEN g IS NOT NULL THEN 'Low Gain' END"),
    ("canonical_email(e STRING)", "STRING", "lower(trim(e))"),
    ("is_guest(e STRING)", "BOOLEAN", "endswith(lower(trim(e)), '@guest.local')"),
    ("normalized_gain(pre DOUBLE, post DOUBLE)", "DOUBLE", "CASE WHEN pre <> 100 THEN (post - pre) / (100 - pre) END"),
    ("round_finite(x DOUBLE)", "DOUBLE", "CASE WHEN NOT isnan(x) AND abs(x) < double('infinity') THEN bround(x, 6) END"),
    ("backoff_ms(failures BIGINT)", "BIGINT", "CAST(least(30000 * pow(2, greatest(0, failures - 1)), 600000) AS BIGINT)"),
]


def register(spark: SparkSession) -> list[str]:
    """Make all scalar functions known to the session's SQL; gives their names."""
    for signature, kind, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS {kind} RETURN {body}")
    spark.udf.register("t_two_tailed_p", t_two_tailed_p)
    spark.udf.register("t_critical", t_critical)
    return [s.partition("(")[0] for s, _, _ in FUNCTIONS] + ["t_two_tailed_p", "t_critical"]
