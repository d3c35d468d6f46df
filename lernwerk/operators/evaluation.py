"""Predictions held against labelled data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import CLASSES, agree, canonical, once, rank
from ..session import cut
from .quantiles import exact_quantiles

MAX_SHIFT = 5
#: Rounds of asking; lines that are not settled by then raise an error.
MOST_ROUNDS = 10_000


def score_programs(predictions: DataFrame) -> DataFrame:
    """Add canonical labels and whether time and space agree; a failed program has PARSE_FAIL for a prediction."""
    p = once(predictions, {f"__{kind}_{what}": f"{kind}_{what}" for kind in ("expected", "predicted") for what in ("time", "space")}, canonical)
    for what in ("time", "space"):
        got, want = F.col(f"__predicted_{what}"), F.col(f"__expected_{what}")
        agrees = agree(F.col(f"predicted_{what}"), F.col(f"expected_{what}"), got == want)
        p = p.withColumns({f"{what}_class": want, f"{what}_ok": ~F.col("failed") & agrees, f"{what}_predicted": F.when(F.col("failed"), "PARSE_FAIL").otherwise(got)}).drop(f"__predicted_{what}", f"__expected_{what}")
    return p


def align_lines(actual: DataFrame, expected: DataFrame, max_shift: int = MAX_SHIFT, most_rounds: int = MOST_ROUNDS) -> DataFrame:
    """Pair the lines of each program: equal numbers first, then the nearest free line within ``max_shift``.

    Expected lines go in order and try +1, -1, +2, -2 and so on. Both inputs have
    program, lineno, label, one row a line. The result has a row for each line shown:
    ``lineno``, ``expected_line``, ``expected``, ``actual``; an expected line that moved
    shows at the line it found, and what finds no partner stays.
    """
    side = lambda df, label, mark: df.select("program", "lineno", F.col("label").alias(label), F.lit(True).alias(mark))
    met = cut(side(actual, "actual", "is_actual").join(side(expected, "expected", "is_expected"), ["program", "lineno"], "full_outer"))
    free = met.where("is_expected is null").select("program", F.col("lineno").alias("to"), "actual")
    wanted = met.where("is_actual is null").select("program", F.col("lineno").alias("line"), "expected")
    tries = [(2 * k - 1 if step > 0 else 2 * k, step) for k in range(1, max_shift + 1) for step in (k, -k)]
    steps = F.explode(F.array(*[F.struct(F.lit(p).alias("place"), (F.col("line") + d).alias("to")) for p, d in tries]))
    pairs = wanted.select("program", "line", steps.alias("t")).select("program", "line", "t.*").join(free.select("program", "to"), ["program", "to"], "left_semi")
    found = _accepted(pairs, most_rounds)
    moved = found.join(wanted, ["program", "line"]).join(free, ["program", "to"]).select("program", F.col("to").alias("lineno"), F.col("line").alias("expected_line"), "expected", "actual")
    used = found.select("program", F.col("line").alias("lineno")).unionByName(found.select("program", F.col("to").alias("lineno")))
    rest = met.join(used, ["program", "lineno"], "left_anti").select("program", "lineno", F.when(F.col("is_expected"), F.col("lineno")).alias("expected_line"), "expected", "actual")
    return rest.unionByName(moved)


def _accepted(pairs: DataFrame, most_rounds: int) -> DataFrame:
    """(program, line, to): what the serial rule gives, in rounds over all lines at once.

    In a round every line asks for the best ``to`` that has not turned it down, and each ``to`` keeps the lowest line that asks
    and turns the others down for good. Since all prefer the lowest line, this ends where the lines in order, one
    after the other, would.
    """
    asks = Window.partitionBy("program", "line")
    keeps = Window.partitionBy("program", "to")
    left = cut(pairs)
    for _ in range(most_rounds):
        asked = left.withColumn("asks", F.col("place") == F.min("place").over(asks))
        told = asked.withColumn("no", F.col("asks") & (F.col("line") > F.min(F.when(F.col("asks"), F.col("line"))).over(keeps)))
        told = cut(told)
        if told.where("no").isEmpty():
            return told.where("asks").select("program", "line", "to")
        left = told.where("not no").select(pairs.columns)
    raise RuntimeError(f"lines still ask for others after {most_rounds} rounds")


def score_lines(predicted: DataFrame, expected: DataFrame, code: DataFrame) -> DataFrame:
    """Predicted lines with what was expected; expected lines that nobody predicted are MISSING, unless blank or comment."""
    p = predicted.where("not is_comment").select("program", "lineno", F.col("label").alias("predicted"))
    e = expected.select("program", "lineno", F.col("label").alias("expected"))
    bare = code.where(F.col("source").rlike(r"^\s*(#|$)")).select("program", "lineno")
    joined = p.join(e, ["program", "lineno"], "full_outer")
    silent = joined.where("predicted is null").join(bare, ["program", "lineno"], "left_anti").withColumn("predicted", F.lit("MISSING"))
    out = joined.where("predicted is not null").unionByName(silent)
    none = F.lit(None).cast("string")
    met = p.select("predicted", none.alias("expected")).unionByName(e.select(none.alias("predicted"), "expected"))
    out = once(out, {"__predicted": "predicted", "__expected": "expected"}, canonical, met)
    same = agree(F.col("predicted"), F.col("expected"), F.col("__predicted") == F.col("__expected"))
    return out.withColumn("ok", F.when(F.col("predicted") == "MISSING", False).otherwise(same)).drop("__predicted", "__expected")


def confusion(df: DataFrame, expected: str, predicted: str) -> DataFrame:
    """Cells of the confusion matrix; all that follows works on these few rows."""
    return df.where(F.col(expected).isNotNull() & (F.col(expected) != "-")).groupBy(F.col(expected).alias("expected"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def class_report(cells: DataFrame) -> DataFrame:
    """tp, fp, fn, support, precision, recall and F1 of every class that was expected."""
    hit = F.sum(F.when(F.col("expected") == F.col("predicted"), F.col("n")).otherwise(0))
    want = cells.groupBy(F.col("expected").alias("class")).agg(F.sum("n").alias("support"), hit.alias("tp"))
    got = cells.groupBy(F.col("predicted").alias("class")).agg(F.sum("n").alias("guessed"))
    r = want.join(got, "class", "left").withColumn("guessed", F.coalesce("guessed", F.lit(0)))
    r = r.withColumn("fp", F.col("guessed") - F.col("tp")).withColumn("fn", F.col("support") - F.col("tp")).drop("guessed")
    r = r.withColumn("precision", F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), F.lit(0.0))).withColumn("recall", F.col("tp") / F.col("support"))
    return r.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def averages(report: DataFrame) -> DataFrame:
    """Macro and weighted means over classes with support."""
    cols = ("precision", "recall", "f1")
    macro = [F.avg(F.when(F.col("support") > 0, F.col(c))).alias(f"macro_{c}") for c in cols]
    weighted = [(F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(f"weighted_{c}") for c in cols]
    return report.agg(*macro, *weighted, F.sum("support").alias("support"))


def class_order(c: Column) -> Column:
    """Place in the canonical order, 999 for other classes."""
    return F.coalesce(F.element_at(F.create_map(*[x for i, n in enumerate(CLASSES) for x in (F.lit(n), F.lit(i))]), c), F.lit(999))


def fill_taxonomy(report: DataFrame) -> DataFrame:
    """All supported classes, those never expected as flagged zero rows, and any others."""
    spark = report.sparkSession
    table = spark.createDataFrame([(c,) for c in CLASSES], "class string")
    full = table.join(report, "class", "full_outer").withColumn("empty", F.col("support").isNull())
    return full.fillna(0).withColumn("place", class_order(F.col("class")))


def merge_aliases(report: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """Fold alias classes into a target, by support-weighted means."""
    to = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    r = report.withColumn("class", F.coalesce(F.element_at(to, F.col("class")), F.col("class")))
    return r.groupBy("class").agg(*[(F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c) for c in ("precision", "recall", "f1")], F.sum("support").alias("support"))


def accuracy_summary(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Tested, passed and accuracy of time, space and both; failures stay in the denominator."""
    both = F.col("time_ok") & F.col("space_ok")
    g = scored.groupBy(*(by or [])).agg(F.count("*").alias("tested"), F.count_if("time_ok").alias("time_passed"), F.count_if("space_ok").alias("space_passed"), F.count_if(both).alias("both_passed"), F.count_if("failed").alias("crashed"))
    for what in ("time", "space", "both"):
        g = g.withColumn(f"{what}_accuracy", F.col(f"{what}_passed") / F.col("tested"))
    return g.withColumn("crash_rate", F.col("crashed") / F.col("tested"))


def per_class_accuracy(scored: DataFrame, what: str = "time") -> DataFrame:
    g = scored.groupBy(F.col(f"{what}_class").alias("class")).agg(F.count("*").alias("n"), F.count_if(f"{what}_ok").alias("correct"))
    return g.withColumn("accuracy", F.col("correct") / F.col("n")).withColumn("place", class_order(F.col("class")))


def regression_gate(summary: DataFrame, time_floor: float, space_floor: float, crash_ceiling: float) -> DataFrame:
    """Whether each limit holds, and all of them."""
    g = summary.select((F.col("time_accuracy") >= time_floor).alias("time_pass"), (F.col("space_accuracy") >= space_floor).alias("space_pass"), (F.col("crash_rate") <= crash_ceiling).alias("crash_pass"))
    return g.withColumn("all_pass", F.col("time_pass") & F.col("space_pass") & F.col("crash_pass"))


def capped_mismatches(scored: DataFrame, cap: int = 25) -> DataFrame:
    """The first mismatches of each metric by program, and how many there are.

    A program can fail two metrics. The first ``cap`` are found by a top-k for each metric, not by
    numbering all.
    """
    out = []
    for what in ("time", "space"):
        wrong = scored.where(~F.col(f"{what}_ok")).select(F.lit(what).alias("metric"), "program", F.col(f"{what}_class").alias("expected"), F.col(f"{what}_predicted").alias("predicted"))
        total = wrong.agg(F.count("*").alias("total"))
        out.append(wrong.orderBy("program", "expected", "predicted").limit(cap).crossJoin(F.broadcast(total)).withColumn("truncated", F.col("total") > cap))
    return out[0].unionByName(out[1])


def latency_stats(runs: DataFrame, by: list[str]) -> DataFrame:
    """Mean, median, 95th percentile (interpolated) and maximum of times, programs and lines a second, peak and mean memory.

    The two quantiles are exact and are found by counting, so no task holds a group's values.
    """
    seconds = F.sum("ms") / 1000
    rest = runs.groupBy(*by).agg(
        F.avg("ms").alias("mean_ms"), F.max("ms").alias("max_ms"), (F.count("*") / seconds).alias("programs_per_s"), (F.sum("n_lines") / seconds).alias("lines_per_s"),
        F.max("memory_mb").alias("peak_mb"), F.avg("memory_mb").alias("mean_mb"),
    )
    places = exact_quantiles(runs, by, "ms", {"median_ms": 0.5, "p95_ms": 0.95})
    names = places.select(*[F.col(c).alias(f"__{c}") for c in by], "median_ms", "p95_ms")
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]
    return rest.join(names, reduce(lambda a, b: a & b, same, F.lit(True)), "left").drop(*[f"__{c}" for c in by])


RESULT_TABS = ("all", "overall_pass", "line_pass", "overall_mismatch", "line_mismatch")


def results_tab(results: DataFrame, tab: str) -> DataFrame:
    """Programs of a result tab; ``results`` has ``correct``, and how many lines have a truth (``truth_lines``) and miss it (``failed_lines``)."""
    if tab not in RESULT_TABS:
        raise ValueError(f"{tab} is none of {RESULT_TABS}")
    keep = {"overall_pass": F.col("correct"), "overall_mismatch": ~F.col("correct"), "line_pass": (F.col("truth_lines") > 0) & (F.col("failed_lines") == 0), "line_mismatch": F.col("failed_lines") > 0}
    return results if tab == "all" else results.where(keep[tab])


def class_distribution(df: DataFrame, label: str) -> DataFrame:
    return df.where(F.col(label).isNotNull() & ~F.col(label).isin("-", "MISSING")).groupBy(F.col(label).alias("class")).agg(F.count("*").alias("support"))


def line_hits(events: DataFrame, code_lines: DataFrame) -> DataFrame:
    """Executions of each code line, its share of its program's busiest line, and whether it is hot or never ran."""
    hits = events.groupBy("program", "line").agg(F.count("*").alias("hits"))
    all_lines = code_lines.join(hits, ["program", "line"], "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    most = F.max("hits").over(Window.partitionBy("program"))
    out = all_lines.withColumn("busiest", most).withColumn("share", F.coalesce(F.try_divide("hits", "busiest"), F.lit(0.0)))
    return out.withColumn("hot", (F.col("busiest") > 1) & (F.col("hits") == F.col("busiest"))).withColumn("ran", F.col("hits") > 0)


def dominant_label(lines: DataFrame) -> DataFrame:
    """The heaviest class of each program's lines, by name on ties, and how many lines reach it."""
    g = once(lines, {"w": "label"}, rank).groupBy("program", "label", "w").agg(F.count("*").alias("n"))
    return g.groupBy("program").agg(F.max(F.struct("w", "label", "n")).alias("m")).select("program", "m.label", F.col("m.w").alias("weight"), F.col("m.n").alias("lines"))


def worst_classes(accuracy: DataFrame, k: int) -> DataFrame:
    return accuracy.orderBy("accuracy", "class").limit(k)


def busiest_strata(df: DataFrame, by: str, k: int) -> DataFrame:
    """The ``k`` values of a column with the most rows, by name on ties."""
    return df.where(F.col(by).isNotNull()).groupBy(by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), by).limit(k)
