"""Queries over predictions and datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L
from ..operators import datasets as D
from ..operators import evaluation as E
from .catalog import query, shared
from .learners import golden_sql
from .views import view

COLUMNS = ("expected_time", "expected_space", "predicted_time", "predicted_space")
NAMES = f"names AS (SELECT label, {golden_sql('label', 2)} AS folded FROM ({' UNION '.join(f'SELECT {c} AS label FROM v_predictions' for c in COLUMNS)}))"
SCORED = f"""{NAMES}, scored AS (SELECT p.*, a.folded AS time_class, b.folded AS space_class, CASE WHEN failed THEN 'PARSE_FAIL' ELSE c.folded END AS time_predicted, CASE WHEN failed THEN 'PARSE_FAIL' ELSE d.folded END AS space_predicted,
   NOT failed AND predicted_time NOT IN ('', '-') AND c.folded = a.folded AS time_ok, NOT failed AND predicted_space NOT IN ('', '-') AND d.folded = b.folded AS space_ok
   FROM v_predictions p JOIN names a ON expected_time = a.label JOIN names b ON expected_space = b.label JOIN names c ON predicted_time = c.label JOIN names d ON predicted_space = d.label)"""
REPORT = f"""{SCORED}, cells AS (SELECT time_class AS expected, time_predicted AS predicted, count(*) AS n FROM scored GROUP BY ALL),
  r0 AS (SELECT expected AS class, CAST(sum(n) AS BIGINT) AS support, CAST(coalesce(sum(n) FILTER (expected = predicted), 0) AS BIGINT) AS tp FROM cells GROUP BY expected),
  r1 AS (SELECT r0.*, CAST(coalesce((SELECT sum(n) FROM cells WHERE predicted = class), 0) AS BIGINT) - tp AS fp, support - tp AS fn FROM r0),
  r2 AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, tp / support AS recall FROM r1),
  report AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM r2)"""


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _report(p):
    return E.class_report(E.confusion(E.score_programs(p), "time_class", "time_predicted"))


MEASURES = ("precision", "recall", "f1")
ROUNDED = ", ".join(f"round({c}, 6) AS {c}" for c in MEASURES)


@query("agg12_confusion", "v_predictions", sql=f"WITH {REPORT} SELECT class, support, tp, fp, fn, {ROUNDED} FROM report")
def _(p):
    return rounded(_report(p), *MEASURES).select("class", "support", "tp", "fp", "fn", *MEASURES)


@query("agg12_cells", "v_predictions", sql=f"WITH {SCORED} SELECT space_class AS expected, space_predicted AS predicted, count(*) AS n FROM scored GROUP BY ALL")
def _(p):
    return E.confusion(E.score_programs(p), "space_class", "space_predicted")


@query("agg13_averages", "v_predictions", sql=f"WITH {REPORT} SELECT {', '.join(f'round(avg({c}), 6) AS macro_{c}, round(sum({c} * support) / sum(support), 6) AS weighted_{c}' for c in MEASURES)}, CAST(sum(support) AS BIGINT) AS support FROM report")
def _(p):
    a = E.averages(_report(p))
    return rounded(a, *[c for c in a.columns if c != "support"])


NINE_SQL = "(SELECT unnest([" + ", ".join(f"'{c}'" for c in L.CLASSES) + "]) AS class, unnest(range(9)) AS place)"


@query("agg14_fill_taxonomy", "v_predictions", sql=f"WITH {REPORT} SELECT coalesce(n.class, r.class) AS class, coalesce(support, 0) AS support, coalesce(tp, 0) AS tp, support IS NULL AS empty, CAST(coalesce(n.place, 999) AS INT) AS place FROM {NINE_SQL} n FULL JOIN (SELECT * FROM report WHERE class <> 'O(n!)') r ON n.class = r.class")
def _(p):
    return E.fill_taxonomy(_report(p).where("class <> 'O(n!)'")).select("class", "support", "tp", "empty", "place")


@query("agg15_merge_aliases", "v_predictions", sql=f"WITH {REPORT} SELECT CASE WHEN class IN ('O(2^n)', 'O(n!)') THEN 'beyond' ELSE class END AS class, {', '.join(f'round(sum({c} * support) / sum(support), 6) AS {c}' for c in MEASURES)}, CAST(sum(support) AS BIGINT) AS support FROM report GROUP BY 1")
def _(p):
    return rounded(E.merge_aliases(_report(p), {"O(2^n)": "beyond", "O(n!)": "beyond"}), *MEASURES)


SUMMARY = "count(*) AS tested, count(*) FILTER (time_ok) AS time_passed, count(*) FILTER (space_ok) AS space_passed, count(*) FILTER (time_ok AND space_ok) AS both_passed, count(*) FILTER (failed) AS crashed, count(*) FILTER (time_ok) / count(*) AS time_accuracy, count(*) FILTER (space_ok) / count(*) AS space_accuracy, count(*) FILTER (time_ok AND space_ok) / count(*) AS both_accuracy, count(*) FILTER (failed) / count(*) AS crash_rate"


@query("agg16_accuracy_summary", "v_predictions", sql=f"WITH {SCORED} SELECT source_file, {SUMMARY} FROM scored GROUP BY source_file")
def _(p):
    return E.accuracy_summary(E.score_programs(p), ["source_file"])


@query("agg17_per_class_accuracy", "v_predictions", sql=f"WITH {SCORED} SELECT s.time_class AS class, count(*) AS n, count(*) FILTER (time_ok) AS correct, count(*) FILTER (time_ok) / count(*) AS accuracy, CAST(max(n.place) AS INT) AS place FROM scored s JOIN {NINE_SQL} n ON s.time_class = n.class GROUP BY 1")
def _(p):
    return E.per_class_accuracy(E.score_programs(p))


@query("agg18_regression_gate", "v_predictions", sql=f"WITH {SCORED}, s AS (SELECT {SUMMARY} FROM scored) SELECT time_accuracy >= 0.7 AS time_pass, space_accuracy >= 0.8 AS space_pass, crash_rate <= 0.06 AS crash_pass, time_accuracy >= 0.7 AND space_accuracy >= 0.8 AND crash_rate <= 0.06 AS all_pass FROM s")
def _(p):
    return E.regression_gate(E.accuracy_summary(E.score_programs(p)), 0.7, 0.8, 0.06)


def _mismatch_sql(what: str) -> str:
    return f"(SELECT '{what}' AS metric, program, {what}_class AS expected, {what}_predicted AS predicted, (SELECT count(*) FROM scored WHERE NOT {what}_ok) AS total, (SELECT count(*) FROM scored WHERE NOT {what}_ok) > 25 AS truncated FROM scored WHERE NOT {what}_ok ORDER BY program, expected, predicted LIMIT 25)"


@query("agg19_capped_mismatches", "v_predictions", sql=f"WITH {SCORED} SELECT * FROM {_mismatch_sql('time')} UNION ALL SELECT * FROM {_mismatch_sql('space')}")
def _(p):
    return E.capped_mismatches(E.score_programs(p))


LATENCY = ("mean_ms", "median_ms", "p95_ms", "max_ms", "programs_per_s", "lines_per_s")


@query("agg20_latency_stats", "v_predictions", sql="SELECT source_file, round(avg(ms), 9) AS mean_ms, round(quantile_cont(ms, 0.5), 9) AS median_ms, round(quantile_cont(ms, 0.95), 9) AS p95_ms, round(max(ms), 9) AS max_ms, round(count(*) / (sum(ms) / 1000), 9) AS programs_per_s, round(sum(n_lines) / (sum(ms) / 1000), 9) AS lines_per_s, max(memory_mb) AS peak_mb, round(avg(memory_mb), 9) AS mean_mb FROM v_predictions GROUP BY source_file")
def _(p):
    return E.latency_stats(p, ["source_file"]).withColumns({c: F.round(c, 9) for c in LATENCY})


@query("agg21_class_distribution", "v_predictions", sql="SELECT predicted_time AS class, count(*) AS support FROM v_predictions WHERE predicted_time NOT IN ('-', 'MISSING') GROUP BY 1")
def _(p):
    return E.class_distribution(p, "predicted_time")


@query("agg22_line_hits", "events", sql="""WITH h AS (SELECT user_id AS program, CAST(props->>'$.k' AS INT) AS line, count(*) AS hits FROM events WHERE event_type <> 'error' GROUP BY ALL), c AS (SELECT DISTINCT user_id AS program, CAST(props->>'$.k' AS INT) AS line FROM events),
      a AS (SELECT c.program, c.line, coalesce(hits, 0) AS hits, max(coalesce(hits, 0)) OVER (PARTITION BY c.program) AS busiest FROM c LEFT JOIN h USING (program, line))
      SELECT program, line, hits, busiest, round(CASE WHEN busiest > 0 THEN hits / busiest ELSE 0 END, 6) AS share, busiest > 1 AND hits = busiest AS hot, hits > 0 AS ran FROM a""")  # fmt: skip
def _(e):
    lines = e.select(F.col("user_id").alias("program"), F.get_json_object("props", "$.k").cast("int").alias("line"), "event_type")
    return rounded(E.line_hits(lines.where("event_type <> 'error'"), lines.select("program", "line").distinct()), "share")


@query("ord2_hottest_lines", "events", sql="SELECT user_id AS program, CAST(props->>'$.k' AS INT) AS line, count(*) AS hits FROM events GROUP BY ALL ORDER BY hits DESC, line, program LIMIT 50")
def _(e):
    return e.groupBy(F.col("user_id").alias("program"), F.get_json_object("props", "$.k").cast("int").alias("line")).agg(F.count("*").alias("hits")).orderBy(F.desc("hits"), "line", "program").limit(50)


@query("agg30_dominant_label", "v_expected_lines", sql=f"WITH w AS (SELECT program, label, CAST(CASE label {' '.join(f'WHEN {k!r} THEN {v}' for k, v in dict(zip(L.CLASSES, (1, 5, 7, 10, 15, 20, 100, 150, 12), strict=True)).items())} END AS DOUBLE) AS weight, count(*) AS lines FROM v_expected_lines GROUP BY program, label) SELECT program, label, weight, lines FROM w QUALIFY row_number() OVER (PARTITION BY program ORDER BY weight DESC, label DESC) = 1")
def _(x):
    return E.dominant_label(x)


@query("agg32_dataset_checks", "v_predictions", sql="SELECT count(*) AS n, count(*) FILTER (predicted_time NOT IN (" + ", ".join(f"'{c}'" for c in L.CLASSES) + ")) AS outside_predicted_time, count(*) FILTER (expected_time NOT IN (" + ", ".join(f"'{c}'" for c in L.CLASSES) + ")) AS outside_expected_time FROM v_predictions")
def _(p):
    return D.dataset_checks(p, ["predicted_time", "expected_time"])


@query("ord1_order_classes", "v_predictions", sql=f"SELECT coalesce(n.class, d.class) AS class, support, CAST(row_number() OVER (ORDER BY coalesce(n.place, 999), d.class) AS INT) AS position FROM (SELECT predicted_time AS class, count(*) AS support FROM v_predictions GROUP BY 1) d LEFT JOIN {NINE_SQL} n USING (class)")
def _(p):
    from pyspark.sql import Window

    d = p.groupBy(F.col("predicted_time").alias("class")).agg(F.count("*").alias("support"))
    return d.withColumn("position", F.row_number().over(Window.orderBy(E.class_order(F.col("class")), "class")))  # one row a class


@query("ord3_worst_classes", "v_predictions", sql=f"WITH {SCORED} SELECT time_class AS class, count(*) FILTER (time_ok) / count(*) AS accuracy FROM scored GROUP BY 1 ORDER BY accuracy, class LIMIT 3")
def _(p):
    return E.worst_classes(E.per_class_accuracy(E.score_programs(p)), 3).select("class", "accuracy")


@query("ord3_busiest_strata", "v_predictions", sql="SELECT source_file, count(*) AS n FROM v_predictions WHERE source_file IS NOT NULL GROUP BY source_file ORDER BY n DESC, source_file LIMIT 3")
def _(p):
    return E.busiest_strata(p, "source_file", 3)


ALIGNED = """WITH RECURSIVE a AS (SELECT program, lineno, label FROM v_predicted_lines), e AS (SELECT program, lineno, label FROM v_expected_lines),
    free AS (SELECT program, list(lineno) AS lines FROM a ANTI JOIN e USING (program, lineno) GROUP BY program),
    want AS (SELECT program, lineno, row_number() OVER (PARTITION BY program ORDER BY lineno) AS i FROM e ANTI JOIN a USING (program, lineno)),
    s(program, i, taken, line, got) AS (SELECT program, CAST(0 AS BIGINT), CAST([] AS INT[]), CAST(NULL AS INT), CAST(NULL AS INT) FROM free
      UNION ALL SELECT program, i, CASE WHEN got IS NULL THEN taken ELSE list_append(taken, got) END, line, got FROM (
        SELECT s.program, want.i, s.taken, CAST(want.lineno AS INT) AS line,
               CAST(list_filter([want.lineno + 1, want.lineno - 1, want.lineno + 2, want.lineno - 2, want.lineno + 3, want.lineno - 3, want.lineno + 4, want.lineno - 4, want.lineno + 5, want.lineno - 5],
                                lambda x: list_contains(free.lines, x) AND NOT list_contains(s.taken, x))[1] AS INT) AS got
        FROM s JOIN want ON s.program = want.program AND want.i = s.i + 1 JOIN free ON free.program = s.program)),
    moved AS (SELECT program, got AS lineno, line FROM s WHERE got IS NOT NULL),
    rest AS (SELECT program, lineno, a.label AS actual, e.label AS expected, coalesce(e.there, false) AS wanted FROM a FULL JOIN (SELECT *, true AS there FROM e) e USING (program, lineno))
    SELECT program, lineno, CASE WHEN wanted THEN lineno END AS expected_line, expected, actual FROM rest
    WHERE (program, lineno) NOT IN (SELECT program, lineno FROM moved UNION ALL SELECT program, line FROM moved)
    UNION ALL SELECT m.program, m.lineno, m.line, e.label, a.label FROM moved m JOIN e ON m.program = e.program AND m.line = e.lineno JOIN a ON m.program = a.program AND m.lineno = a.lineno"""


@query("jn5_align_lines", "v_predicted_lines", "v_expected_lines", sql=ALIGNED)
def _(a, e):
    return E.align_lines(a, e)


@query("jn6_score_lines", "v_predicted_lines", "v_expected_lines", "v_code_lines", sql="""SELECT program, lineno, coalesce(predicted, 'MISSING') AS predicted, expected, CASE WHEN predicted IS NULL THEN false WHEN expected IS NULL THEN true ELSE predicted = expected END AS ok
    FROM (SELECT program, lineno, label AS predicted FROM v_predicted_lines WHERE NOT is_comment) p FULL JOIN (SELECT program, lineno, label AS expected FROM v_expected_lines) e USING (program, lineno) LEFT JOIN v_code_lines c USING (program, lineno)
    WHERE predicted IS NOT NULL OR c.source IS NULL OR NOT regexp_matches(c.source, '^\\s*(#|$)')""")  # fmt: skip
def _(p, e, c):
    return E.score_lines(p, e, c)


# datasets

@query("prj24_drop_blank", "v_code", sql="SELECT doc_id, lang FROM v_code WHERE trim(coalesce(code, '')) <> '' AND NOT regexp_matches(replace(lower(source), ' ', ''), 'src1$|src7')")
def _(c):
    return D.drop_niche(D.drop_blank(c, "code"), "source", ["src1$", "src7"]).select("doc_id", "lang")


@query("prj24_observed_counts", sql="SELECT count(*) AS rows, count(*) FILTER (blank) AS blank, count(*) FILTER (NOT blank AND niche) AS niche, count(*) FILTER (NOT blank AND NOT niche) AS kept FROM (SELECT trim(coalesce(code, '')) = '' AS blank, regexp_matches(replace(lower(source), ' ', ''), 'src1$|src7') AS niche FROM v_code)")
def _(spark, sf_dir):
    rows, seen = D.clean(view(spark, sf_dir, "v_code"), "code", "source", ["src1$", "src7"])
    rows.write.parquet(shared(spark, "clean"))
    return spark.createDataFrame([seen.get], "rows long, blank long, niche long, kept long")


@query("prj25_source_lines", "v_code", sql="SELECT doc_id, len(string_split(code, chr(10))) AS n_lines, len(list_filter(string_split(code, chr(10)), lambda l: NOT regexp_matches(l, '^\\s*(#|$)'))) AS code_lines FROM v_code")
def _(c):
    kept = D.code_lines(c).groupBy("doc_id").agg(F.count("*").alias("k"))
    return c.select("doc_id", D.source_lines(F.col("code")).cast("long").alias("n_lines")).join(kept, "doc_id", "left").select("doc_id", "n_lines", F.coalesce("k", F.lit(0)).alias("code_lines"))


@query("prj28_heuristic_label", "v_code")
def _(c):
    return c.select("doc_id", D.heuristic_label(F.col("code")).alias("label"))


@query(
    "agg23_slovin_sample", "v_code",
    sql="""WITH s AS (SELECT lang, source, count(*) AS size, (SELECT count(*) FROM v_code) AS total FROM v_code GROUP BY lang, source),
      q AS (SELECT lang, source, CAST(least(size, round_even(size / total * ceil(total / (1 + total * 0.05 * 0.05)), 0)) AS BIGINT) AS quota FROM s)
      SELECT doc_id, lang, source FROM (SELECT c.doc_id, c.lang, c.source, quota, row_number() OVER (PARTITION BY c.lang, c.source ORDER BY md5('s' || CAST(c.doc_id AS VARCHAR)), c.doc_id) AS n FROM v_code c JOIN q ON c.lang = q.lang AND c.source = q.source) WHERE n <= quota""",
)
def _(c):
    return D.slovin_sample(c.select("doc_id", "lang", "source"), ["lang", "source"], "doc_id")


@query(
    "agg24_growth_class", "v_attempts",
    sql="""WITH c AS (SELECT owner AS key, CAST(substr(activity, 2) AS INT) + 5 AS n, count(*) AS count FROM v_attempts GROUP BY ALL),
      g AS (SELECT key, CASE WHEN regr_sxx(ln(count), ln(n)) > 0 THEN regr_slope(ln(count), ln(n)) END AS slope, arg_max(count, n) AS last, list(count ORDER BY n DESC)[2] AS before FROM c GROUP BY key)
      SELECT key, round(slope, 6) AS slope, CASE WHEN last / before >= 5 THEN 'O(n!)' WHEN slope < 0.4 THEN 'O(1)' WHEN slope < 1.5 THEN 'O(n)' ELSE 'O(n^2)' END AS label FROM g""",
)
def _(a):
    c = a.groupBy(F.col("owner").alias("key"), (F.substring("activity", 2, 9).cast("int") + 5).alias("n")).agg(F.count("*").alias("count"))
    return rounded(D.growth_class(c), "slope")


DRIVEN = "SELECT owner AS key, CAST(substr(activity, 2) AS INT) + 5 AS n, CAST(aes AS BIGINT) % 3 AS driver, count(*) AS count FROM v_attempts GROUP BY ALL"


@query("agg24_label_mismatches", "v_attempts", sql=f"""WITH c AS (SELECT key, n, max(count) AS count FROM ({DRIVEN}) GROUP BY key, n),
      g AS (SELECT key, CASE WHEN regr_sxx(ln(count), ln(n)) > 0 THEN regr_slope(ln(count), ln(n)) END AS slope, arg_max(count, n) AS last, list(count ORDER BY n DESC)[2] AS before FROM c GROUP BY key),
      m AS (SELECT key, last, CASE WHEN last / before >= 5 THEN 'O(n!)' WHEN slope < 0.4 THEN 'O(1)' WHEN slope < 1.5 THEN 'O(n)' ELSE 'O(n^2)' END AS measured, CASE WHEN last % 2 = 0 THEN 'O(n)' ELSE 'O(1)' END AS label FROM g)
      SELECT key, label, measured FROM m WHERE NOT (label = measured OR (label = 'O(n)' AND measured = 'O(1)' AND last <= 8))""")
def _(a):
    c = a.groupBy(F.col("owner").alias("key"), (F.substring("activity", 2, 9).cast("int") + 5).alias("n"), (F.col("aes").cast("long") % 3).alias("driver")).agg(F.count("*").alias("count"))
    top = c.groupBy("key", "n").agg(F.max("count").alias("count")).groupBy("key").agg(F.max_by("count", "n").alias("last"))
    return D.label_mismatches(c, top.select("key", F.when(F.col("last") % 2 == 0, "O(n)").otherwise("O(1)").alias("label")))


@query("agg31_dedupe_identical", "v_code", sql="SELECT doc_id, lang FROM v_code WHERE doc_id IN (SELECT min(doc_id) FROM v_code GROUP BY coalesce(code, ''))")
def _(c):
    return D.dedupe_identical(c, "code", "doc_id").select("doc_id", "lang")


@query("set1_union_chunks", "v_code", sql="SELECT doc_id, lang, CASE WHEN doc_id % 2 = 0 THEN source END AS source FROM v_code")
def _(c):
    return D.union_chunks([c.where("doc_id % 2 = 0").select("doc_id", "lang", "source"), c.where("doc_id % 2 = 1").select("lang", "doc_id")])
