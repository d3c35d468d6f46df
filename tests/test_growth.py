"""What large tables asked for: texts counted without lists, sheets worked out once, files and buckets of bounded size."""

import random
import time
from decimal import Decimal
from pathlib import Path

from lernwerk import plans
from lernwerk.operators import cohort, progress
from lernwerk.plans import changes
from lernwerk.plans.views import view
from lernwerk.sources import tables
from lernwerk.streaming import rules
from oracle import SMALL
from pyspark.sql import functions as F


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_generated_methods_are_bounded(spark):
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "65535")
    view(spark, SMALL, "v_submissions")
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"


def test_tests_are_counted_in_their_text(spark):
    for name in ("prj4_test_breakdown", "prj5_profile_breakdown", "prj7_submission_rows"):
        assert "lambdafunction" not in plan(plans.QUERIES[name](spark, SMALL))
    rng = random.Random(3)
    kinds, statuses = ["functional", "complexity", "hidden", "other", "", "hiddenx", "xhidden"], ["passed", "failed", "", "passed:x", "passedx", "passed\n"]
    texts = [",".join("" if rng.random() < 0.2 else rng.choice(kinds) + rng.choice(["", ":"]) + rng.choice(statuses) for _ in range(rng.randrange(7))) for _ in range(400)] + [None]
    t = F.col("tests")
    pairs, profile = cohort.test_breakdown(t, {}), cohort.profile_breakdown(t, F.lit(1))
    out = spark.createDataFrame([(x,) for x in texts], "tests string").select("tests", *[F.array(*p).alias(n) for n, p in pairs.items()], *[c.alias(n) for n, c in profile.items()])
    for r in out.collect():
        items = [(*(x.split(":") + [""])[:2],) for x in (r["tests"] or "").split(",") if x]
        named = [(c if c in ("complexity", "hidden") else "functional", s) for c, s in items]
        for c in cohort.CATEGORIES:
            assert r[c] == [sum(k == c and s == "passed" for k, s in named), sum(k == c for k, _ in named)], r
        known = any(c in cohort.CATEGORIES for c, _ in items)
        assert r["complexity_passed"] == sum(s == "passed" and (not known or c == "complexity") for c, s in (items if known else items[-2:])), r
        assert r["functional_total"] == (sum(c == "functional" for c, _ in items) if known else max(len(items) - 2, 0)), r
        assert r["hidden_passed"] == min(1, sum(x == ("hidden", "passed") for x in items)), r


def test_mastery_does_not_multiply_rows(spark):
    rows = [("o", None, "a", 60.0, "failed", "optimization", None), ("o", None, "a", None, "failed", "activity", 3.0), ("o", None, None, 80.0, "passed", "optimization", 4.0), ("o", "m", "b", None, None, None, None)]
    df = progress.module_mastery(spark.createDataFrame(rows, "owner string, module string, activity string, final_aes double, status string, type string, rog double"))
    assert "Expand" not in plan(df)
    got = {r["module"]: (r["tried"], r["finished"], r["aes"], r["rog"]) for r in df.collect()}
    assert got == {None: (1, 1, 70.0, 2.0), "m": (1, 0, None, None)}


def test_a_sheet_is_worked_out_once(spark, monkeypatch):
    read, write = [], tables.write_report_tables
    monkeypatch.setattr(changes.T, "write_report_tables", lambda t, *to: (read.extend(f for df in t.values() for f in df.inputFiles()), write(t, *to)))
    assert plans.QUERIES["snk2_detail"](spark, SMALL).count() > 0
    assert read and not any("lineitem" in f for f in read)


def test_json_is_merged_once_a_step(spark):
    assert plan(plans.QUERIES["fn3_json"](spark, SMALL)).count("map_zip_with") <= 8


def test_large_chunks_go_to_several_files(spark, tmp_path):
    rows = spark.range(300).select((F.col("id") % 2).alias("chunk"), F.to_json(F.struct(F.col("id").cast("string").alias("id"), F.repeat(F.lit("x"), F.lit(90)).alias("code"))).alias("record"))
    tables.write_arrays(rows, str(tmp_path / "first"), "ground_truth_chunk_{}.json", most=4000)
    tables.write_arrays(rows, str(tmp_path / "next"), "ground_truth_chunk_{}.json")
    files = list((tmp_path / "first").glob("part-*/ground_truth_chunk_*.json"))
    assert len(files) >= 6 and max(f.stat().st_size for f in files) < 8000
    got = tables.scan_ground_truth(spark, [str(tmp_path / "first"), str(tmp_path / "next")])
    assert sorted((int(r["id"]), r["source_file"]) for r in got.collect()) == [(n, f"ground_truth_chunk_{n % 2}.json") for n in range(300)]


def test_a_large_bucket_is_written_by_several_tasks(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        table = rules.BucketedTable(spark, str(tmp_path / "t"), ["k"], buckets=1)
        rows = spark.range(40000, numPartitions=8).select(F.col("id").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
        table.merge(rows, lambda d: d, 0)
        assert len(list((tmp_path / "t/generation=0/bucket=0").glob("part-*"))) > 1 and table.read().count() == 40000
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")


def test_buckets_are_merged_some_at_a_time(spark, tmp_path):
    last = lambda d: d.groupBy("k").agg(F.max(F.struct("seq", "v")).alias("x")).select("k", "x.*")
    rows = lambda n, seq: spark.range(n).select(F.when(F.col("id") > 0, F.col("id")).alias("k"), F.lit(seq).alias("seq"), (F.col("id") * seq).alias("v"))
    table = rules.BucketedTable(spark, str(tmp_path / "t"), ["k"], buckets=4, group_rows=300)
    for spread in (False, True):
        sizes = []
        seen = lambda d: sizes.append(d.count()) or last(d)
        groups = table.merge(rows(1000, 1 + 2 * spread), seen, 2 * spread, spread)
        table.merge(rows(500, 2 + 2 * spread), last, 1 + 2 * spread, spread)
        assert sorted(b for g in groups for b in g) == [0, 1, 2, 3] and len(groups) == len(sizes) == 4 and max(sizes) < 700
        want = {(n or None, (2 if n < 500 else 1) + 2 * spread) for n in range(1000)}
        assert {(r["k"], r["seq"]) for r in table.read().collect()} == want and table.read().count() == 1000
    (tmp_path / "t/generation=3/_SUCCESS").unlink()  # a batch that ended between its groups does not count, and is run again
    assert {r["seq"] for r in table.read().collect()} == {3}
    table.merge(rows(500, 4), last, 3, True)
    assert {(r["k"], r["seq"]) for r in table.read().collect()} == want and table.read().count() == 1000


def test_what_a_stream_took_in_is_deleted(spark, tmp_path):
    def shuffles():
        return sum(1 for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs() for _ in Path(d.getPath()).rglob("shuffle_*"))

    home = Path(spark.conf.get("spark.checkpoint.dir"))
    folders, kept, taken = {p.name for p in home.glob("*")}, shuffles(), []
    changes = spark.range(3000).select((F.col("id") % 70).alias("k"), F.when(F.col("id") > 4, F.col("id")).alias("seq"))

    def sink(batch, number):
        batch.groupBy("k").agg(F.max("seq").alias("seq")).write.parquet(str(tmp_path / f"out/{number}"))
        taken.append((batch.count(), sum(p.stat().st_size for p in (tmp_path / "root/arrived").rglob("*.parquet"))))

    rules.arrivals(changes, "seq", str(tmp_path / "root"), sink)
    assert [n for n, _ in taken] == [999, 999, 997] and taken[2][1] < 1.5 * taken[0][1]
    assert not list((tmp_path / "root/arrived").rglob("*.parquet")) and {p.name for p in home.glob("*")} == folders
    until = time.time() + 20
    while shuffles() > kept and time.time() < until:
        time.sleep(0.5)
    assert shuffles() <= kept and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_sums_that_are_taken_away_leave_no_digit(spark):
    row = lambda p, t: (None, "o", None, None, None, None, float(p), float(t))
    flat = lambda rows: spark.createDataFrame(rows, "module string, owner string, final_aes double, rog_value double, code_unchanged boolean, done boolean, tsr_passed double, tsr_total double").withColumns({f"{c}_n": F.lit(0.1) for c in cohort.COUNTED})
    both = cohort.metric_parts(flat([row(1, 3), row(2, 3), row(1, 7)]), 1).unionByName(cohort.metric_parts(flat([row(1, 3)]), -1))
    got = cohort.add_parts(both).first()
    assert got["tsr_sum"] == Decimal("0.809523809523810") and got["attempted"] == 2 and got["functional_total"] == Decimal("0.2")


def test_the_live_cohort_leaves_its_tables_alone(spark):
    home = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(home.glob("*"))
    assert plans.QUERIES["str6_live_cohort"](spark, SMALL).count() > 0
    new = set(home.glob("*")) - before
    assert [p.name.split("-")[0] for p in new] == ["cohort"] and {p.name for p in new.pop().iterdir()} == {"arrived", "marks", "parts", "submissions"}
