"""Learner cohorts: who counts, what a submission counts for, and the metric set at every level."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clean_key, extract_score

CATEGORIES = ("functional", "complexity", "hidden")


def milestone_scores(assessments: DataFrame, keywords: list[str], name: str = "score") -> DataFrame:
    """Each user's score in the first assessment, by key, whose cleaned key holds a keyword and that has a score."""
    key = clean_key(F.col("assessment_key"))
    fits = reduce(lambda a, b: a | b, [key.contains(k.lower().replace("-", "").replace("_", "").replace(" ", "")) for k in keywords])
    value = extract_score(F.col("score"), F.col("correct"), F.col("total"))
    found = assessments.where(fits).withColumn("value", value).where("value is not null")
    return found.groupBy("email").agg(F.min_by("value", "assessment_key").alias(name))


def scope(users: DataFrame, completers: DataFrame | None = None, emails: DataFrame | None = None) -> DataFrame:
    """Users that are no admins, among the emails asked for and those that finished the post test."""
    out = users.where("not is_admin")
    for only in (emails, completers):
        if only is not None:
            out = out.join(only.select("email"), "email", "left_semi")
    return out


def flag_completers(users: DataFrame, post: DataFrame) -> DataFrame:
    done = post.select("email").distinct().withColumn("completed", F.lit(True))
    return users.join(done, "email", "left").withColumn("completed", F.coalesce("completed", F.lit(False)))


def pair_pre_post(pre: DataFrame, post: DataFrame) -> DataFrame:
    return pre.join(post, "email").withColumn("difference", F.col("post") - F.col("pre"))


def _tests(tests: Column, category: str = "[^:,]*", status: str | None = None) -> Column:
    """How many of the ``category:status`` items, parted by commas, are of a category and status; counted in the text itself, no list is made."""
    ends = r"(?=[:,]|\z)"
    return F.regexp_count(F.coalesce(tests, F.lit("")), F.lit(f"(?:^|,){category}{ends}" if status is None else f"(?:^|,){category}:{status}{ends}"))


def _items(tests: Column) -> Column:
    """How many items there are; empty ones are none."""
    return F.regexp_count(F.coalesce(tests, F.lit("")), F.lit("[^,]+"))


def test_breakdown(tests: Column, stored: dict[str, tuple[Column, Column]]) -> dict[str, tuple[Column, Column]]:
    """(passed, total) of each category, from ``category:status`` items parted by commas.

    Tests without a known category count as functional. A stored total above 0 takes
    the place of the counted pair.
    """
    others = [c for c in CATEGORIES if c != "functional"]
    out = {}
    for name in CATEGORIES:
        if name == "functional":
            total = _items(tests) - sum((_tests(tests, c) for c in others[1:]), _tests(tests, others[0]))
            passed = _tests(tests, status="passed") - sum((_tests(tests, c, "passed") for c in others[1:]), _tests(tests, others[0], "passed"))
        else:
            total, passed = _tests(tests, name), _tests(tests, name, "passed")
        passed, total = passed.cast("double"), total.cast("double")
        if name in stored:
            kept_passed, kept_total = stored[name]
            use = F.coalesce(kept_total > 0, F.lit(False))
            passed, total = F.when(use, F.coalesce(kept_passed, F.lit(0.0))).otherwise(passed), F.when(use, kept_total).otherwise(total)
        out[name] = (passed, total)
    return out


def profile_breakdown(tests: Column, hidden_pool: Column) -> dict[str, Column]:
    """The learner's own view: without any category the last two tests are complexity; hidden totals stay within the pool."""
    count = lambda *what: _tests(tests, *what).cast("double")
    known = F.coalesce(tests, F.lit("")).rlike(f"(?:^|,)(?:{'|'.join(CATEGORIES)})(?=[:,]|\\z)")
    n = _items(tests)
    ok = r"(?:^|,)[^:,]*:passed(?::[^,]*)?"
    text = F.coalesce(tests, F.lit(""))
    last = text.rlike(ok + r",*\z").cast("double") + text.rlike(ok + r",+[^,]+,*\z").cast("double")  # the last, the one before it
    complexity = F.when(known, count("complexity")).otherwise(F.least(n, F.lit(2)).cast("double"))
    complexity_ok = F.when(known, count("complexity", "passed")).otherwise(last)
    hidden = F.least(count("hidden"), hidden_pool.cast("double"))
    hidden_ok = F.least(count("hidden", "passed"), hidden_pool.cast("double"))
    functional = F.when(known, count("functional")).otherwise(F.greatest(n - 2, F.lit(0)).cast("double"))
    return {"functional_total": functional, "complexity_total": complexity, "complexity_passed": complexity_ok, "hidden_total": hidden, "hidden_passed": hidden_ok}


def _nonzero(c: Column) -> Column:
    return F.nullif(c, F.lit(0.0))


def resolve_counts(passed_tests: Column, total_tests: Column, passed_cases: Column, total_cases: Column, counted_passed: Column, counted_total: Column) -> tuple[Column, Column]:
    """The pair a success rate is built from: the first total that is not zero, and passes that agree with what was counted."""
    total = F.coalesce(_nonzero(total_tests), _nonzero(total_cases), counted_total)
    stale = passed_tests.isNull() | ((passed_tests == 0) & (counted_passed > 0))
    return F.when(stale, F.coalesce(_nonzero(passed_cases), counted_passed)).otherwise(passed_tests), total


def submission_rows(subs: DataFrame) -> DataFrame:
    """Flat rows with resolved counts; null marks what does not count, never zero."""
    stored = {"functional": (F.col("functional_passed"), F.col("functional_total")), "hidden": (F.col("hidden_passed"), F.col("hidden_total"))}
    split = test_breakdown(F.col("tests"), stored)
    for name, (p, t) in split.items():
        subs = subs.withColumn(f"{name}_passed_n", p).withColumn(f"{name}_total_n", t)
    counted_p = sum((F.col(f"{n}_passed_n") for n in CATEGORIES[1:]), F.col("functional_passed_n"))
    counted_t = sum((F.col(f"{n}_total_n") for n in CATEGORIES[1:]), F.col("functional_total_n"))
    passed, total = resolve_counts(F.col("passed_tests"), F.col("total_tests"), F.col("passed_cases"), F.col("total_cases"), counted_p, counted_t)
    counts = F.coalesce(total > 0, F.lit(False)) & passed.isNotNull()
    return (
        subs.withColumn("tsr_passed", F.when(counts, passed))
        .withColumn("tsr_total", F.when(counts, total))
        .withColumn("rog_value", F.when(counts_toward_rog(), F.coalesce("rog", F.lit(0.0))))
        .withColumn("done", F.coalesce(F.col("final_aes") >= 50, F.lit(False)) | F.coalesce(F.col("status") == "passed", F.lit(False)))
    )


def counts_toward_rog() -> Column:
    """Evaluated optimizations, those without a gain too."""
    return F.coalesce(F.col("type") == "optimization", F.lit(False)) & F.col("final_aes").isNotNull()


COUNTED = [f"{n}_{what}" for n in CATEGORIES for what in ("passed", "total")]
#: What the metrics read of a flat row, besides module and owner.
SUMMED = ["final_aes", "rog_value", "tsr_passed", "tsr_total", "code_unchanged", "done", *[f"{c}_n" for c in COUNTED]]


def _summands() -> tuple[dict[str, Column], dict[str, Column]]:
    """What means are taken of, and what is counted."""
    means = {"aes": F.col("final_aes"), "rog": F.col("rog_value"), "tsr": F.col("tsr_passed") / F.col("tsr_total")}
    return means, {"unchanged": F.coalesce("code_unchanged", F.lit(False)), "passed": F.col("done")}


def metric_parts(rows: DataFrame, sign: int) -> DataFrame:
    """Sums and counts by module and owner as exact decimals, added with 1 or taken away with -1; ``add_parts`` adds them up."""
    means, flags = _summands()
    named = rows.withColumn("module", F.coalesce("module", F.lit("unknown")))
    exact = lambda c, digits: F.sum((c * sign).cast(f"decimal(28,{digits})"))  # noqa: E731  # a product of decimals would lose digits
    sums = [x for n, c in means.items() for x in (F.coalesce(exact(c, 15), F.lit(0)).cast("decimal(38,15)").alias(f"{n}_sum"), (F.count(c) * sign).alias(f"{n}_count"))]
    counts = [(F.count_if(c) * sign).alias(n) for n, c in flags.items()]
    return named.groupBy("module", "owner").agg(*sums, *counts, (F.count("*") * sign).alias("attempted"), *[F.coalesce(exact(F.col(f"{c}_n"), 3), F.lit(0)).cast("decimal(38,3)").alias(c) for c in COUNTED])


def add_parts(parts: DataFrame) -> DataFrame:
    """One row a module and owner again; those without a submission left are gone."""
    kinds = dict(parts.dtypes)
    summed = parts.groupBy("module", "owner").agg(*[F.sum(c).cast(kinds[c]).alias(c) for c in parts.columns if c not in ("module", "owner")])
    return summed.where("attempted > 0")


def submission_metrics(rows: DataFrame, sets: list[list[str]] | None = None) -> DataFrame:
    """Metrics of the cohort, each module, each user and each user in each module; means are null where nothing counts.

    Rows are summed once by user and module, and these sums are then rolled up: the grouping sets multiply
    the few sums and not the rows. ``level`` names the grouping columns that hold, a bit each (module 2, owner 1
    when summed over). A null module is ``unknown``.
    """
    means, flags = _summands()
    sums = [x for n, c in means.items() for x in (F.sum(c).alias(f"{n}_sum"), F.count(c).alias(f"{n}_count"))]
    named = rows.withColumn("module", F.coalesce("module", F.lit("unknown")))
    parts = named.groupBy("module", "owner").agg(*sums, *[F.count_if(c).alias(n) for n, c in flags.items()], F.count("*").alias("attempted"), *[F.sum(f"{c}_n").alias(c) for c in COUNTED])
    return roll_up(parts, sets)


def roll_up(parts: DataFrame, sets: list[list[str]] | None = None) -> DataFrame:
    """``submission_metrics`` from sums by module and owner."""
    chosen = [[F.col(c) for c in s] for s in (sets if sets is not None else [[], ["module"], ["owner"], ["module", "owner"]])]
    mean = lambda n, scale=1: F.round(F.try_divide(F.sum(f"{n}_sum").cast("double"), F.sum(f"{n}_count")) * scale, 10).alias(n)
    total = lambda n: F.sum(n).cast("double").alias(n)
    return parts.groupingSets(chosen, F.col("module"), F.col("owner")).agg(
        F.grouping_id().cast("long").alias("level"), mean("aes"), mean("rog"), F.coalesce(F.sum("rog_count"), F.lit(0)).alias("rog_count"), F.coalesce(F.sum("unchanged"), F.lit(0)).alias("unchanged"),
        mean("tsr", 100), F.coalesce(F.sum("attempted"), F.lit(0)).alias("attempted"), F.coalesce(F.sum("passed"), F.lit(0)).alias("passed"), *map(total, COUNTED),
    )


def rollup_users(users: DataFrame, metrics: DataFrame) -> DataFrame:
    """Every user with its metrics; users without submissions have null means and zero counts."""
    joined = users.join(metrics, users["email"] == metrics["owner"], "left").drop("owner")
    zero = [c for c in joined.columns if c.endswith(("_passed", "_total")) or c in ("attempted", "passed", "unchanged", "rog_count")]
    return joined.fillna(0, subset=zero)


def submission_details(subs: DataFrame) -> DataFrame:
    """Per activity: the score by precedence, the gain of optimizations only, newest first by the time's text."""
    newest = Window.partitionBy("owner").orderBy(F.desc(F.col("ts").cast("string")), "sub_id", "final_aes")
    return subs.select(
        "owner", "module", "activity", F.coalesce("type", F.lit("activity")).alias("type"), "status", "sub_id",
        F.coalesce("latest_aes", "final_aes").alias("aes"),
        F.when(F.col("type") == "optimization", F.coalesce("rog", F.lit(0.0))).alias("rog"),
        "code_unchanged", "ts", F.row_number().over(newest).alias("place"),
    )


def activity_done(best: Column, score: Column, max_score: Column, status: Column) -> Column:
    """A best score of 50 of 100, five-point scores stretched, or a passed status."""
    value = F.coalesce(best, score, F.lit(0.0))
    value = F.when((max_score == 5) & (value <= 5), value / 5 * 100).otherwise(value)
    return F.coalesce(F.least(value, F.lit(100.0)) >= 50, F.lit(False)) | F.coalesce(status == "passed", F.lit(False))


def search_users(users: DataFrame, term: str, role: str | None = None, status: str | None = None, post_test: bool | None = None) -> DataFrame:
    """Users whose name or address holds a term, with a role and status; by ``completed`` where ``post_test`` is given (null is not completed)."""
    low = term.lower()
    out = users.where(F.lower("name").contains(low) | F.lower("email").contains(low)) if term else users
    for column, value in (("role", role), ("status", status)):
        out = out if value is None else out.where(F.col(column) == value)
    return out if post_test is None else out.where(F.coalesce("completed", F.lit(False)) == post_test)


def in_roster(subs: DataFrame, roster: DataFrame) -> DataFrame:
    listed = roster.select(F.col("email").alias("__listed")).distinct()
    return subs.join(listed, F.col("owner") == F.col("__listed"), "left").withColumn("in_roster", F.col("__listed").isNotNull().cast("int")).drop("__listed")


def respondent_ids(users: DataFrame, others: DataFrame) -> DataFrame:
    """S01 and so on for listed users by email, then for owners that are not listed.

    Numbers are counted inside groups of emails and moved up by the groups before, so
    no task numbers them all.
    """
    listed = users.select("email").distinct().withColumn("part", F.lit(0))
    extra = others.select(F.col("owner").alias("email")).distinct().join(listed, "email", "left_anti").withColumn("part", F.lit(1))
    every = listed.unionByName(extra).withColumn("group", F.substring("email", 1, 4))
    before = Window.orderBy("part", "group").rowsBetween(Window.unboundedPreceding, -1)  # one row a group
    starts = every.groupBy("part", "group").agg(F.count("*").alias("n")).select("part", "group", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy("part", "group").orderBy("email"))
    return every.withColumn("w", within).join(starts, ["part", "group"]).select("email", F.format_string("S%02d", F.col("start") + F.col("w")).alias("respondent"))


def weighted_rollup(children: DataFrame, by: str, value: str, weight: str) -> DataFrame:
    used = F.col(value).isNotNull()
    return children.groupBy(by).agg(F.round(F.sum(F.when(used, F.col(value) * F.col(weight))) / F.sum(F.when(used, F.col(weight))), 6).alias(value), F.sum(weight).alias(weight))
