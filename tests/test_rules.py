"""Golden rows, invariants and stream against batch."""

from collections import Counter

import numpy as np
import pandas as pd
import pytest
from lernwerk import plans
from lernwerk.functions import labels, scalars, student_t
from lernwerk.operators import cohort, evaluation, graph, merge, quantiles, stats
from lernwerk.plans.views import view
from lernwerk.sources import tables
from lernwerk.streaming import rules
from oracle import SMALL
from pyspark.sql import functions as F

# Thirty respondents (id, pre, post, task success, efficiency, gain) and the figures published for them.
RESPONDENTS = """S01,89,100,78.7,92.7,75.5
S02,11,97,75.0,82.4,90.5
S03,46,94,74.9,86.2,49.4
S04,43,94,80.7,93.7,76.0
S05,51,94,74.1,84.9,61.0
S06,29,89,71.8,80.3,64.2
S07,80,100,82.5,97.7,62.0
S08,29,100,77.6,89.9,100.0
S09,43,97,79.6,94.2,38.8
S10,54,100,82.0,95.1,91.3
S11,43,97,73.3,87.5,81.7
S12,60,69,82.8,97.4,57.4
S13,43,77,77.9,89.6,70.2
S14,29,94,76.1,88.8,54.6
S15,46,94,78.5,92.6,46.7
S16,17,94,71.8,79.6,77.1
S17,74,94,80.4,93.2,56.0
S18,54,86,78.3,94.5,75.3
S19,63,100,85.2,99.7,60.0
S20,77,69,80.6,95.3,70.2
S21,46,94,78.1,94.0,37.3
S22,83,89,79.0,97.2,73.8
S23,0,100,82.6,98.1,57.5
S24,69,20,76.1,86.9,93.4
S25,46,94,79.5,95.0,73.9
S26,57,100,82.3,97.2,66.7
S27,83,97,75.5,84.7,100.0
S28,86,77,81.7,97.1,81.5
S29,40,89,75.2,89.3,37.3
S30,34,91,80.0,96.3,37.7"""
FIT = {"b1": -0.1585, "b0": 0.6816, "se": 0.1595, "t": -0.9937, "p": 0.3289, "r": -0.1846, "r2": 0.0341}


@pytest.fixture(scope="module")
def points(spark):
    rows = [(p[0], *map(float, p[1:])) for p in (line.split(",") for line in RESPONDENTS.split("\n"))]
    return stats.composite(spark.createDataFrame(rows, "email string, pre double, post double, tsr double, aes double, rog double"))


def test_published_fit(points):
    fit = stats.ols(points).first()
    assert (fit["n"], fit["df"]) == (30, 28)
    for name, value in FIT.items():
        assert round(fit[name], 4) == value, name


def test_published_descriptives(points):
    got = {r["variable"]: (round(r["mean"], 2), round(r["sd"], 2)) for r in stats.descriptives(points, ["pre", "post", "tsr", "aes", "rog"]).collect()}
    assert got == {"pre": (50.83, 22.70), "post": (89.67, 15.73), "tsr": (78.39, 3.45), "aes": (91.70, 5.56), "rog": (67.23, 18.19)}


def test_sensitivity_leaves_out_one(points):
    assert stats.sensitivity_refit(points, stats.ols(points)).first()["n"] == 29


def test_ols_refuses_flat_and_short(spark):
    flat = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (1.0, 4.0)], "x double, y double")
    assert stats.ols(flat).first()["b1"] is None
    assert stats.ols(flat.limit(2)).first()["b1"] is None
    assert stats.ols(flat.limit(0)).first()["n"] == 0


def test_t_tables():
    assert [round(float(t), 4) for t in student_t.critical(np.array([27, 28, 10]))] == [2.0518, 2.0484, 2.2281]
    p = student_t.two_tailed(np.array([0.0, np.nan, 2.2281, 50.0]), np.array([5, 5, 10, 3]))
    assert p[0] == 1 and np.isnan(p[1]) and abs(p[2] - 0.05) < 1e-5 and 0 < p[3] < 1e-4
    assert np.isnan(student_t.two_tailed(np.array([1.0]), np.array([0]))[0])


def test_gain_counts_optimizations_only(spark):
    rows = [("optimization", 90.0, 50.0), ("optimization", 80.0, 50.0), ("optimization", 70.0, 0.0), ("activity", 60.0, 98.0), (None, 60.0, 98.0)]
    base = view(spark, SMALL, "v_submissions").limit(1).drop("type", "final_aes", "rog")
    subs = base.crossJoin(spark.createDataFrame(rows, "type string, final_aes double, rog double"))
    m = cohort.submission_metrics(cohort.submission_rows(subs), [[]]).first()
    assert round(m["rog"], 1) == 33.3 and m["rog_count"] == 3


def test_levels_add_up(spark):
    m = cohort.submission_metrics(cohort.submission_rows(view(spark, SMALL, "v_submissions")))
    by_level = {r["level"]: r["n"] for r in m.groupBy("level").agg(F.sum("attempted").alias("n")).collect()}
    assert len(set(by_level.values())) == 1 and len(by_level) == 4


def test_confusion_agrees_with_accuracy(spark):
    scored = evaluation.score_programs(view(spark, SMALL, "v_predictions")).cache()
    cells = evaluation.confusion(scored, "time_class", "time_predicted")
    hits = cells.where("expected = predicted").agg(F.sum("n")).first()[0]
    assert hits == evaluation.accuracy_summary(scored).first()["time_passed"]


@pytest.mark.parametrize(
    ("label", "folded"),
    [("O(n * m)", "O(n^2)"), ("O(m^2 + e)", "O(n^2)"), ("O(n + e)", "O(n + e)"), ("O(3)", "O(1)"), ("O(n + m)", "O(n)"), ("O(log n)", "O(log n)"), ("O(a^2*b)", "O(n^3)"), ("O(V+E)", "O(V + E)"), ("-", "-"), ("O(t(n))", "O(t(n))")],
)
def test_fold(spark, label, folded):
    assert spark.range(1).select(labels.fold(F.lit(label)).alias("f")).first()["f"] == folded


# Ordinal (6 where nothing fits), growth class, rank and memory rank of labels; None where the rules are not meant for the label.
RULES = [
    ("O(1)", 1, "constant", 1, 0), ("O(log n)", 2, "log", 5, 0.5), ("O(sqrt n)", 3, "sqrt", 7, 0.7), ("O(n)", 4, "linear", 10, 1), ("O(n log n)", 6, "nlogn", 15, 0.5),
    ("O(n^2)", 7, "quadratic", 20, 2), ("O(n^2 log n)", 7, "polyHigh", 25, 2), ("O(n^3)", 6, "polyHigh", 26, 2.5), ("O(n^3 log n)", 2, "polyHigh", 27, 2.5),
    ("O(2^n)", 8, "exponential", 100, 4), ("O(3^n)", 6, "exponential", 10, 1), ("O(n!)", 9, "factorial", 150, 5), ("O(n * n!)", 9, "factorial", 150, 5),
    ("O(V + E)", 5, "graph", 12, 3), ("O(V+E)", 5, "graph", 12, 3), ("O(V)", 6, "graph", 12, 3), ("O(V^2)", 6, "unknown", 14, 3), ("O(E)", 6, "graph", 0, 0),
    ("O(n * m)", 7, "quadratic", 19.5, 1), ("O(n^2 * m)", 7, "quadratic", 25.5, 2), ("O(n * m * k)", 7, "polyHigh", 25.5, 1), ("O(a * b)", 7, "quadratic", 19.5, None),
    ("O(n + m)", 5, "graph", 10, 1), ("O(n + k)", 5, "unknown", 10, 1), ("O(m)", 4, "linear", 10, 0), ("O(k)", 6, "linear", 10, 0), ("O(m^2)", 6, "unknown", 20, 0),
    ("O(m^2 + e)", 5, "unknown", 0, 0), ("O(m log m)", 2, "log", 15, 0), ("O(n^1.58)", 6, "nlogn", 10, 1), ("O(n^0.5)", None, "sqrt", None, None), ("sqrt(n)", 3, "unknown", None, None),
    ("Linear", 6, "unknown", None, None), ("constant", 6, "unknown", None, None), ("-", 6, "unknown", 0, 0), ("", 6, "unknown", 0, 0), (None, 6, "unknown", 0, 0),
    ("O(cubic)", 6, "polyHigh", None, None), ("T(n) = 2T(n/2) + O(n)", 6, "nlogn", None, None), ("T(n) = T(n-1) + T(n-2) + O(1)", 8, "exponential", None, None),
    ("T(n)=T(n/2)+O(1)", 2, "log", None, None), ("T(n) = n * T(n-1)", 9, "factorial", None, None), ("T(n) = T(n-1) + O(n)", 7, "quadratic", None, None),
    ("T(n) = 2T(n/2) + O(1)", 4, "linear", None, None), ("n^2", 7, "unknown", None, None), ("O(n²)", 7, "quadratic", 20, 2), ("O(2ⁿ)", 8, "exponential", 100, 4), ("O(√n)", 3, "sqrt", 7, 0.7),
    ("log n", 2, "unknown", None, None), ("n log n", 6, "unknown", None, None), ("n", 6, "unknown", None, None), ("O(3)", 6, "unknown", 0, 0), ("Dead Code", 6, "unknown", -1, None), ("Definition", 6, "unknown", 1, None),
]


def test_label_rules(spark):
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(RULES)], "i int, label string")
    c = F.col("label")
    for r in df.select("i", labels.weight(c, 6).alias("w"), labels.bucket(c).alias("b"), labels.rank(c).alias("r"), labels.space_rank(c).alias("s")).collect():
        label, *want = RULES[r["i"]]
        assert [w if w is None else g for g, w in zip((r["w"], r["b"], r["r"], r["s"]), want, strict=True)] == want, label


def test_once_is_the_rule_itself(spark):
    df = spark.createDataFrame([(r[0],) for r in RULES] * 2, "label string")
    for most in (3, 100):  # a map that holds some of the labels, and one that holds all
        found = labels.once(df, {"w": "label"}, lambda c: labels.weight(c, 6), most=most)
        assert found.where(F.col("w").eqNullSafe(labels.weight(F.col("label"), 6))).count() == len(RULES) * 2


def test_spelling_and_folding_of_null(spark):
    none = F.lit(None).cast("string")
    r = spark.range(1).select(labels.normalize(none).alias("n"), labels.fold(none).alias("f"), labels.matches(none, none).alias("m")).first()
    assert (r["n"], r["f"], r["m"]) == ("-", None, True)


def test_growth_limits(spark):
    got = {c: spark.range(1).select(labels.practical_limit(F.lit(c)).alias("n")).first()["n"] for c in labels.CLASSES}
    assert got["O(n)"] == 10_000_000 and got["O(n^2)"] == 3162 and got["O(2^n)"] == 23 and got["O(n!)"] == 10 and got["O(1)"] is None
    n = got["O(n log n)"]
    assert n * np.log2(n) <= 1e7 < (n + 1) * np.log2(n + 1)


def test_align_takes_nearest_free_line(spark):
    line = "program int, lineno int, label string"
    got = evaluation.align_lines(spark.createDataFrame([(1, 3, "a"), (1, 4, "b"), (1, 9, "c")], line), spark.createDataFrame([(1, 3, "A"), (1, 5, "B"), (1, 20, "C")], line))
    assert "Python" not in got._jdf.queryExecution().toString()
    assert sorted((r["lineno"], r["expected_line"], r["expected"], r["actual"]) for r in got.collect()) == [(3, 3, "A", "a"), (4, 5, "B", "b"), (9, None, None, "c"), (20, 20, "C", None)]


def test_lines_in_rounds_as_one_after_the_other(spark):
    rng = np.random.default_rng(12)
    lines = {side: {p: sorted(rng.choice(60, 25, replace=False).tolist()) for p in range(6)} for side in "ae"}
    want = set()
    for p in range(6):
        a, e = set(lines["a"][p]), set(lines["e"][p])
        free = a - e
        for line in sorted(e - a):
            at = next((t for k in range(1, 6) for t in (line + k, line - k) if t in free), None)
            if at is not None:
                free.discard(at)
                want.add((p, at, line))
    tables = [spark.createDataFrame([(p, n, "x") for p in range(6) for n in lines[side][p]], "program int, lineno int, label string") for side in "ae"]
    got = {tuple(r) for r in evaluation.align_lines(*tables).where("lineno <> expected_line").select("program", "lineno", "expected_line").collect()}
    assert got == want and len(want) > 20


@pytest.mark.parametrize(("cells", "finish"), [(64, 20), (1024, 4096)])
def test_quantiles_by_counting(spark, cells, finish):
    rng = np.random.default_rng(13)
    groups = {"a": rng.normal(0, 1, 500), "b": np.exp(rng.normal(0, 3, 300)), "c": np.repeat([1.0, 2.0], [200, 3]), None: np.array([5.0]), "d": np.array([-1e308, 1e308, 0.0, 1.0])}
    rows = [(k, float(x)) for k, v in groups.items() for x in v] + [("a", None), ("e", None), ("a", float("nan")), ("a", float("inf"))]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: (r["m"], r["p"]) for r in quantiles.exact_quantiles(df, ["k"], "v", {"m": 0.5, "p": 0.95}, cells, finish).collect()}
    assert got.keys() == groups.keys()
    for k, v in groups.items():
        assert got[k] == pytest.approx(tuple(np.quantile(v, [0.5, 0.95])) if k != "d" else (0.5, 0.85e308), rel=1e-9)
    whole = quantiles.exact_quantiles(df, [], "v", {"m": 0.5}, cells, finish).first()["m"]
    assert whole == pytest.approx(np.quantile(np.concatenate(list(groups.values())), 0.5))


def test_pages_by_ranges(spark):
    df = spark.createDataFrame([((i * 7) % 50, f"k{i}") for i in range(103)], "a int, b string").unionByName(spark.createDataFrame([(None, "z"), (None, "y")], "a int, b string"))
    index = quantiles.page_index(df, ["a", "b"], 8)
    order = [tuple(r) for r in df.orderBy("a", "b").collect()]
    assert index.rows == 105
    for n in (1, 2, 6, 11, 99):
        got = [tuple(r) for r in quantiles.page(df, ["a", "b"], 10, n, index).collect()]
        at = (min(n, 11) - 1) * 10
        assert got == order[at : at + 10]
    assert quantiles.page(df.limit(0), ["a"], 10, 1).count() == 0
    with pytest.raises(ValueError):
        evaluation.results_tab(df, "odd")


def test_files_of_the_first_folder_hold(spark, tmp_path):
    for folder, names in (("one", ["a", "b"]), ("two", ["b", "c"])):
        (tmp_path / folder).mkdir()
        for n in names:
            (tmp_path / folder / f"ground_truth_chunk_{n}.json").write_text(f'[{{"id": "{n}", "name": "{folder}"}},\n{{"id": "{n}2", "name": "{folder}"}}]')
    folders = [str(tmp_path / f) for f in ("one", "two")]
    got = {(r["id"], r["name"], r["source_file"]) for r in tables.scan_ground_truth(spark, folders).collect()}
    assert got == {(f"{n}{k}", f, f"ground_truth_chunk_{n}.json") for n, f in (("a", "one"), ("b", "one"), ("c", "two")) for k in ("", "2")}
    (tmp_path / "two/ground_truth_chunk_b.json").write_text("not read")
    assert tables.scan_ground_truth(spark, folders).count() == 6
    with pytest.raises(FileNotFoundError):
        tables.scan_ground_truth(spark, [str(tmp_path)])


def test_json_merge_and_set(spark):
    docs = [('{"a":1,"b":{"c":2}}', '{"b":null,"d":[1]}'), (None, '{"x":1}'), ("[1]", None), ("bad", '{"x":1}')]
    df = spark.createDataFrame(docs, "o string, n string")
    assert [r[0] for r in df.select(scalars.json_merge(F.col("o"), F.col("n"))).collect()] == ['{"a":1,"b":null,"d":[1]}', '{"x":1}', "{}", '{"x":1}']
    assert [r[0] for r in df.select(scalars.json_set(F.col("o"), ["b", "c"], F.lit("7"))).collect()] == ['{"a":1,"b":{"c":7}}', *['{"b":{"c":7}}'] * 3]


def test_a_date_written_again_is_replaced_alone(spark, tmp_path):
    for date, n in (("2026-01-01", 3), ("2026-01-02", 5), ("2026-01-01", 2)):
        tables.write_report_tables({"sheet": spark.range(n)}, str(tmp_path), date)
    assert Counter(str(r["snapshot_date"]) for r in spark.read.parquet(str(tmp_path / "sheet")).collect()) == {"2026-01-01": 2, "2026-01-02": 5}


def test_graph_on_a_cycle(spark):
    e = spark.createDataFrame([(1, 1, 2), (1, 2, 3), (1, 3, 1), (1, 3, 4), (1, 5, 5)], "program long, caller int, callee int")
    assert {(r["node"], r["cluster"]) for r in graph.clusters(e).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 5)}
    assert {(r["node"], r["direct"], r["indirect"]) for r in graph.recursive_functions(e).collect()} == {(1, False, True), (2, False, True), (3, False, True), (5, True, False)}
    assert {(r["cluster"], r["layer"]) for r in graph.dependency_order(e).collect()} == {(4, 0), (5, 0), (1, 1)}


def _attempts(minutes: list[tuple[float, bool]]) -> pd.DataFrame:
    return pd.DataFrame([(i, int(m * 60_000), "a", f) for i, (m, f) in enumerate(minutes)], columns=["event_id", "ms", "account", "failure"])


def test_lockout_state():
    ten = [(i * 0.1, True) for i in range(10)]
    got = rules._replay(rules.Lockout(), _attempts([*ten, (2, True), (5.9, False), (6, True), (7, False), (8, True), (28, True), (48.1, True)]))
    assert got.outcome.tolist() == ["failed"] * 9 + ["locked", "rejected", "ok", "failed", "ok", "failed", "failed", "failed"]
    assert got.failures.tolist()[-3:] == [1, 2, 1]


def test_lockout_stream_equals_batch(spark, tmp_path):
    logins = view(spark, SMALL, "v_logins")
    logins.repartitionByRange(3, "event_id").sortWithinPartitions("event_id").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(logins.schema).parquet(str(tmp_path / "in"))
    q = rules.login_lockout_stream(stream).writeStream.format("memory").queryName("lockouts").option("checkpointLocation", str(tmp_path / "marks")).trigger(availableNow=True).start()
    q.awaitTermination()
    want = {tuple(r) for r in rules.login_lockout(logins).collect()}
    assert {tuple(r) for r in spark.table("lockouts").collect()} == want


def test_session_gap_at_its_edge_continues(spark):
    rows = [("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:20:00"), ("a", "2024-01-01 00:40:01")]
    df = spark.createDataFrame(rows, "account string, t string").select("account", F.to_timestamp("t").alias("ts"), F.lit(True).alias("failure"))
    assert sorted(r["n"] for r in rules.failure_bursts(df).collect()) == [1, 2]


def test_bucket_of_a_request(spark):
    rows = [(True, "Ann", "1.1.1.1, 2.2.2.2"), (False, "Ann", " 1.1.1.1 , 2.2.2.2"), (True, None, "3.3.3.3"), (False, "x", None), (None, "x", "")]
    df = spark.createDataFrame(rows, "token_valid boolean, account string, forwarded string")
    got = [r[0] for r in df.select(rules.bucket(F.col("token_valid"), F.col("account"), F.col("forwarded"))).collect()]
    assert got == ["ann", "1.1.1.1", "3.3.3.3", "127.0.0.1", "127.0.0.1"]


def test_late_requests_are_not_counted(spark, tmp_path):
    at = lambda rows: spark.createDataFrame([("a", "view", t) for t in rows], "bucket string, route string, t string").select("bucket", "route", F.to_timestamp("t").alias("ts"))
    days = [["2024-01-01 00:00:10", "2024-01-01 00:00:50", "2024-01-01 00:00:59", "2024-01-01 01:00:00"], ["2024-01-01 00:00:30", "2024-01-01 00:58:00"], ["2024-01-02 00:00:00"]]
    for rows in days:  # the second batch has one row behind the watermark of ten minutes, and one within it
        at(rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("bucket string, route string, ts timestamp").parquet(str(tmp_path / "in"))
        rules.run_to_end(rules.rate_limit(stream, watermark="10 minutes"), str(tmp_path / "out"), str(tmp_path / "marks"))
    got = {(str(r["start"]), r["n"], r["limited"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("2024-01-01 00:00:00", 3, True), ("2024-01-01 00:58:00", 1, False), ("2024-01-01 01:00:00", 1, False)}


def test_fixtures_of_streams_meet_their_rules(spark):
    assert plans.QUERIES["str2_rate_limit"](spark, SMALL).where("limited").count() > 20
    outcomes = Counter(r["outcome"] for r in plans.QUERIES["str3_login_lockout"](spark, SMALL).collect())
    assert outcomes["locked"] > 50 and outcomes["rejected"] > 50 and outcomes["ok"] > 50


def test_a_batch_rewrites_only_its_buckets(spark, tmp_path):
    table = rules.BucketedTable(spark, str(tmp_path / "t"), ["k"], buckets=4)
    rows = lambda ks, seq: spark.createDataFrame([(k, float(seq), seq) for k in ks], "k string, v double, seq long")
    last = lambda d: merge.last_arrival(d, ["k"], ["v"])
    names = lambda: {str(p): p.stat().st_mtime_ns for p in (tmp_path / "t").rglob("*.parquet")}
    table.merge(rows("abcdefgh", 0), last, 0)
    first = names()
    table.merge(rows("a", 1), last, 1)
    table.merge(rows("a", 1), last, 1)  # the same batch again
    assert first.items() <= names().items() and len({n for n in names() if "generation=1" in n}) == 1
    assert {(r["k"], r["v"]) for r in table.read().collect()} == {("a", 1.0), *((k, 0.0) for k in "bcdefgh")}
    table.merge(rows("a", 2), last, 2)
    table.merge(rows("a", 3), last, 3)
    assert {g for g in table.generations().values() for g in g} == {0, 2, 3} and {r["v"] for r in table.read().where("k = 'a'").collect()} == {3.0}


def test_every_generation_of_the_cohort_equals_the_batch(spark, tmp_path):
    keys = ["owner", "module", "activity"]
    subs = view(spark, SMALL, "v_submissions").where("owner < 'u12'").cache()
    latest = lambda d: d.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in subs.columns if c not in keys]), F.struct("ts", "sub_id", "total_tests", "final_aes")).alias("v")).select(*keys, "v.*").select(*subs.columns)
    held, parts = rules.BucketedTable(spark, str(tmp_path / "s"), keys), rules.BucketedTable(spark, str(tmp_path / "p"), rules.PARTS)
    sink = rules.cohort_sink(held, parts, latest)
    seen = subs.limit(0)
    for n in range(3):
        batch = subs.where(F.pmod(F.xxhash64("sub_id"), F.lit(3)) == n)
        seen = seen.unionByName(batch)
        sink(batch, n)
        sums = lambda df: {(r["module"], r["owner"], r["level"]): (r["attempted"], r["passed"], r["functional_total"], *(None if r[c] is None else round(r[c], 6) for c in ("aes", "rog", "tsr"))) for r in df.collect()}
        assert sums(cohort.roll_up(parts.read())) == sums(cohort.submission_metrics(cohort.submission_rows(latest(seen))))


def test_stream_upserts_equal_batch(spark):
    stream = {tuple(r) for r in plans.QUERIES["str1_stream_upserts"](spark, SMALL).collect()}
    assert stream == {tuple(r) for r in plans.QUERIES["mrg3_upsert_submissions"](spark, SMALL).collect()}


def test_sql_functions(spark):
    from lernwerk.functions import sql

    assert "t_critical" in sql.register(spark)
    row = spark.sql("SELECT clean_key('A-b_c D') k, extract_score(NULL, 1, 4) s, interpret_effect(-0.6) e, interpret_gain(NULL) g, is_guest(' X@GUEST.local ') q, normalized_gain(100, 100) n, round_finite(double('NaN')) r, backoff_ms(9) b, round(t_critical(10D), 4) t").first()
    assert tuple(row) == ("abcd", 25.0, "Medium Effect", None, True, None, None, 600000, 2.2281)


def test_edges_are_of_all_line_items(spark):
    e = view(spark, SMALL, "v_edges")
    want = view(spark, SMALL, "lineitem").selectExpr("l_suppkey - l_suppkey % 10 AS p", "(l_partkey * 37 + l_orderkey * 11 + l_linenumber * 7) % 5000 AS c").distinct()
    assert e.select("program", "caller").distinct().count() == want.count()


def test_fixtures_meet_their_rules(spark):
    sizes = plans.QUERIES["gr5_clusters"](spark, SMALL).groupBy("program", "cluster").count().where("count > 1").count()
    layers = plans.QUERIES["gr6_dependency_order"](spark, SMALL).agg(F.max("layer")).first()[0]
    assert sizes > 20 and layers > 5
    assert plans.QUERIES["gr3_dead_functions"](spark, SMALL).count() > 100 and plans.QUERIES["set3_set_difference"](spark, SMALL).count() > 100


def brute_clusters(edges):
    """Cluster, layer and way to a cycle of each node, by plain search."""
    out, reach = {}, {}
    names = {(p, n) for p, a, b in edges for n in (a, b)}
    for p, n in names:
        seen, todo = set(), [n]
        while todo:
            x = todo.pop()
            for q, a, b in edges:
                if (q, a) == (p, x) and a != b and b not in seen:
                    seen.add(b)
                    todo.append(b)
        reach[p, n] = seen
    cluster = {(p, n): min([n, *(m for m in reach[p, n] if n in reach[p, m])]) for p, n in names}
    layer = {}

    def height(p, c):
        if (p, c) not in layer:
            down = {cluster[p, b] for q, a, b in edges if q == p and cluster[p, a] == c} - {c}
            layer[p, c] = 1 + max((height(p, d) for d in down), default=-1)
        return layer[p, c]

    for p, n in names:
        out[p, n] = (cluster[p, n], height(p, cluster[p, n]), any(m in reach[p, m] for m in reach[p, n] | {n}))
    return out


def test_clusters_layers_and_cycles_by_search(spark):
    rng = np.random.default_rng(9)
    edges = {(int(p), int(a), int(b)) for p, a, b in zip(rng.integers(0, 4, 120), rng.integers(0, 40, 120), rng.integers(0, 40, 120), strict=True)}
    edges |= {(9, i, i + 1) for i in range(12)} | {(9, 12, 0), (9, 3, 20), (9, 20, 3), (9, 30, 31), (9, 31, 32), (9, 32, 30), (9, 40, 0), (9, 7, 50)}
    e = spark.createDataFrame(sorted(edges), "program long, caller int, callee int")
    want = brute_clusters(edges)
    named = {k: v[0] for k, v in want.items()}
    assert {(r["program"], r["node"]): r["cluster"] for r in graph.clusters(e).collect()} == named
    assert {(r["program"], r["node"]): r["cluster"] for r in graph.clusters(e, most_local=28).collect()} == named  # some by joins
    assert {(r["program"], r["cluster"]): r["layer"] for r in graph.dependency_order(e).collect()} == {(p, v[0]): v[1] for (p, _), v in want.items()}
    leads = {k for k, v in want.items() if v[2]}
    assert {(r["program"], r["node"]) for r in graph.recursive_functions(e).where("indirect").collect()} == leads


def test_joins_and_tasks_agree_on_a_large_program(spark):
    e = spark.createDataFrame([(9, i, i + 1) for i in range(8)] + [(9, 8, 0), (9, 3, 20), (9, 20, 3), (9, 40, 0), (9, 7, 50), (9, 50, 51)], "program long, caller int, callee int")
    roots = spark.createDataFrame([(9, 50)], "program long, node int")
    both = lambda f: [Counter(tuple(sorted(r.asDict().items())) for r in f(n).collect()) for n in (0, 1 << 17)]
    for f in (lambda n: graph.recursive_functions(e, n), lambda n: graph.dependency_order(e, most_local=n), lambda n: graph.reachable(e, roots, most_local=n)):
        one, other = both(f)
        assert one == other and one


@pytest.mark.parametrize("most_local", [1000, 1 << 17])
def test_a_chain_of_ten_thousand(spark, most_local):
    n = 10_000
    chain = spark.range(n).selectExpr("id % 1 AS program", "id AS caller", "id + 1 AS callee")
    if most_local > n:
        whole = graph.clusters(chain, most_local)
        assert whole.count() == n + 1 and whole.where("node <> cluster").isEmpty()
    ring = chain.unionByName(spark.createDataFrame([(0, n, 0), (0, 500, n + 7), (0, n + 7, 500)], chain.schema))
    got = graph.clusters(ring, most_local)
    assert got.count() == n + 2 and got.where("cluster <> 0").isEmpty()


def test_live_and_dead_functions_by_search(spark):
    rng = np.random.default_rng(3)
    edges = {(int(p), int(a), int(b)) for p, a, b in zip(rng.integers(0, 4, 90), rng.integers(0, 30, 90), rng.integers(0, 30, 90), strict=True)}
    roots = {(p, a) for p, a, _ in edges if a % 13 == 0}
    own = {(p, n) for p, a, b in edges for n in (a, b) if p not in {q for q, _ in roots}}  # programs without a root
    live, todo = roots | own, list(roots | own)
    while todo:
        p, a = todo.pop()
        more = {(p, c) for q, b, c in edges if (q, b) == (p, a)} - live
        live |= more
        todo += more
    e = spark.createDataFrame(sorted(edges), "program long, caller int, callee int")
    reached = graph.reachable(e, spark.createDataFrame(sorted(roots), "program long, node int"))
    assert {tuple(r) for r in reached.collect()} == live
    dead = {(p, n) for p, a, b in edges for n in (a, b)} - live
    assert dead and {(r["program"], r["node"]): r["callers"] for r in graph.dead_functions(e, reached).collect()} == {(p, n): ",".join(map(str, sorted({a for q, a, b in edges if (q, b) == (p, n) and a != n}))) for p, n in dead}


def test_mentions_and_programs_without_roots(spark):
    calls = spark.createDataFrame([(1, 0, 2), (1, 4, 5), (2, 1, 2), (2, 3, 4), (3, 1, 2)], "program long, caller int, callee int")
    refs = spark.createDataFrame([(1, 2, 4), (1, 6, 7)], calls.schema)
    roots = spark.createDataFrame([(1, 0)], "program long, node int")
    top = spark.createDataFrame([(1, 6), (2, 1)], "program long, node int")
    live = graph.reachable(calls, roots, refs, top)
    # program 1 has a root; 2 starts from its top-level function; 3 has none there, so all of it is live
    assert {tuple(r) for r in live.collect()} == {(1, 0), (1, 2), (1, 4), (1, 5), (2, 1), (2, 2), (3, 1), (3, 2)}
    assert {tuple(r) for r in graph.dead_functions(calls, live, refs).collect()} == {(1, 6, "never called", ""), (1, 7, "never called", ""), (2, 3, "never called", ""), (2, 4, "called by dead code", "3")}
    assert {tuple(r) for r in graph.reachable(calls, roots).where("program > 1").collect()} == {(2, 1), (2, 2), (2, 3), (2, 4), (3, 1), (3, 2)}


def _many_attempts(spark, n):
    rng = np.random.default_rng(7)
    rows = [(i, None if i % 50 == 0 else "a" if i % 3 else f"u{i % 11}", int(t), bool(f)) for i, (t, f) in enumerate(zip(rng.integers(0, 30_000_000, n), rng.random(n) < 0.8, strict=True))]
    want, states = set(), {}
    for i, account, ms, failure in sorted(rows, key=lambda r: (r[2], r[0])):
        lock = states.setdefault(account, rules.Lockout())
        want.add((i, account, lock.step(ms, failure), lock.count))
    return spark.createDataFrame(rows, "event_id long, account string, ms long, failure boolean"), want


def test_lockout_holds_one_batch_of_an_account(spark):
    attempts, want = _many_attempts(spark, 3000)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        out = rules.login_lockout(attempts)
        assert {tuple(r) for r in out.collect()} == want
        assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_bounds_raise_and_do_not_shorten(spark):
    chain = spark.createDataFrame([(1, i, i + 1) for i in range(6)], "program long, caller int, callee int")
    roots = spark.createDataFrame([(1, 0)], "program long, node int")
    assert graph.reachable(chain, roots, most_rounds=7, most_local=0).count() == 7
    assert graph.dependency_order(chain, most_rounds=7, most_local=0).agg(F.max("layer")).first()[0] == 6
    for short in (lambda: graph.reachable(chain, roots, most_rounds=3, most_local=0), lambda: graph.dependency_order(chain, most_rounds=3, most_local=0)):
        with pytest.raises(RuntimeError):
            short()
