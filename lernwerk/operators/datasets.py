"""Labelled datasets: cleaning, deduplication, audit, samples, measured growth."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.labels import CLASSES


def drop_blank(df: DataFrame, text: str) -> DataFrame:
    """Rows with some text; white space alone is none."""
    return df.where(F.coalesce(F.regexp_replace(F.col(text), r"\s+", ""), F.lit("")) != "")


def drop_niche(df: DataFrame, label: str, patterns: list[str]) -> DataFrame:
    """Rows whose squeezed label holds none of the patterns."""
    squeezed = F.replace(F.lower(F.coalesce(F.col(label), F.lit(""))), F.lit(" "), F.lit(""))
    return df.where(~squeezed.rlike("|".join(patterns)))


def clean(df: DataFrame, text: str, label: str, patterns: list[str]) -> tuple[DataFrame, Observation]:
    """``drop_blank`` and ``drop_niche`` at once, with counts of what they see: rows, blank, niche and kept.

    The counts come out of the pass that writes or collects the result; ``get`` on the observation gives them afterwards.
    """
    seen = Observation("clean")
    blank = F.coalesce(F.regexp_replace(F.col(text), r"\s+", ""), F.lit("")) == ""
    niche = ~blank & F.replace(F.lower(F.coalesce(F.col(label), F.lit(""))), F.lit(" "), F.lit("")).rlike("|".join(patterns))
    count = lambda c, name: F.count_if(c).alias(name)
    marked = df.withColumn("__blank", blank).withColumn("__niche", niche)
    b, n = F.col("__blank"), F.col("__niche")
    marked = marked.observe(seen, F.count(F.lit(1)).alias("rows"), count(b, "blank"), count(n, "niche"), count(~b & ~n, "kept"))
    return marked.where(~b & ~n).drop("__blank", "__niche"), seen


def source_lines(text: Column) -> Column:
    return F.size(F.split(text, "\n"))


def code_lines(df: DataFrame, text: str = "code") -> DataFrame:
    """One row for each line that is neither blank nor a comment."""
    rows = df.select("*", F.posexplode(F.split(F.col(text), "\n")).alias("i", "line_text")).withColumn("lineno", F.col("i") + 1).drop("i")
    return rows.where(~F.col("line_text").rlike(r"^\s*(#|$)"))


def dedupe_identical(df: DataFrame, text: str, key: str) -> DataFrame:
    """Of rows with the same bytes, the one with the least key."""
    kept = df.groupBy(F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("__h")).agg(F.min(key).alias(key))
    return df.join(kept.select(key), key, "left_semi")


def dataset_checks(df: DataFrame, labels: list[str]) -> DataFrame:
    """How many labels lie outside the nine classes, for each column."""
    return df.agg(F.count("*").alias("n"), *[F.count_if(~F.coalesce(F.col(c), F.lit("")).isin(*CLASSES)).alias(f"outside_{c}") for c in labels])


def sample_size(n: Column, e: float) -> Column:
    return F.ceil(n / (1 + n * F.lit(e) * F.lit(e)))


def slovin_sample(df: DataFrame, strata: list[str], key: str, e: float = 0.05, seed: str = "s") -> DataFrame:
    """A sample of n = ceil(N / (1 + N e^2)) rows, shared out to strata by size.

    Within a stratum the rows first in the order of a hash of seed and key are taken. A
    threshold on the hash thins a stratum to about four times its share and 64 rows before rows are numbered, so
    that no task numbers a large one. The chance that this leaves too few is below e to the -40th; then it is an error and not a short sample.
    """
    sizes = df.groupBy(*strata).agg(F.count("*").alias("size"))
    total = df.agg(F.count("*").alias("total"))
    quota = sizes.crossJoin(F.broadcast(total)).withColumn("quota", F.least("size", F.bround(F.col("size") / F.col("total") * sample_size(F.col("total"), e)).cast("long"))).drop("total")
    mixed = df.withColumn("__h", F.md5(F.concat(F.lit(seed), F.col(key).cast("string"))))
    joined = mixed.join(quota, strata)
    place = F.conv(F.substring("__h", 1, 8), 16, 10).cast("double") / float(1 << 32)
    thin = joined.where(place < 4 * F.col("quota") / F.col("size") + 64 / F.col("size"))
    whole = Window.partitionBy(*strata)
    ranked = thin.withColumn("n", F.row_number().over(whole.orderBy("__h", key))).withColumn("left", F.count("*").over(whole))
    enough = F.when(F.col("left") >= F.col("quota"), F.col("n") <= F.col("quota")).otherwise(F.raise_error("a stratum was thinned below its share").cast("boolean"))
    return ranked.where(enough).drop("__h", "size", "quota", "n", "left")


def growth_class(counts: DataFrame) -> DataFrame:
    """The class of measured costs (columns key, n, count): factorial by the last ratio, else by log-log slope."""
    with_top = counts.withColumn("top", F.max("n").over(Window.partitionBy("key")))  # a handful of sizes a key
    g = with_top.groupBy("key").agg(F.regr_slope(F.log(F.col("count")), F.log(F.col("n"))).alias("slope"), F.max_by("count", "n").alias("last"), F.max_by(F.when(F.col("n") < F.col("top"), F.col("count")), F.when(F.col("n") < F.col("top"), F.col("n"))).alias("before"))
    label = F.when(F.col("last") / F.col("before") >= 5, "O(n!)").when(F.col("slope") < 0.4, "O(1)").when(F.col("slope") < 1.5, "O(n)").otherwise("O(n^2)")
    return g.select("key", "slope", label.alias("label"))


def growth_of_drivers(counts: DataFrame) -> DataFrame:
    """``growth_class`` of costs measured by several drivers (columns key, driver, n, count): the largest count at each size holds."""
    return growth_class(counts.groupBy("key", "n").agg(F.max("count").alias("count")))


def label_mismatches(counts: DataFrame, labels: DataFrame, few: int = 8) -> DataFrame:
    """Keys (columns key, label) whose measured growth is another than the label; a constant cost of ``few`` or less may be called linear."""
    top = counts.groupBy("key", "n").agg(F.max("count").alias("count")).groupBy("key").agg(F.max_by("count", "n").alias("last"))
    m = labels.join(growth_of_drivers(counts).select("key", F.col("label").alias("measured")), "key").join(top, "key")
    fine = (F.col("measured") == F.col("label")) | ((F.col("label") == "O(n)") & (F.col("measured") == "O(1)") & (F.col("last") <= few))
    return m.where(~fine).select("key", "label", "measured")


def union_chunks(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def heuristic_label(text: Column) -> Column:
    """A guess at the growth class of source text of any language: keywords, else loop depth by indentation."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?m)(#|//).*$", ""), r"\"[^\"\n]*\"|'[^'\n]*'", "")
    loop = lambda line: line.rlike(r"^\s*(for|while)\b")
    indent = lambda line: F.length(line) - F.length(F.ltrim(line))
    start = F.struct(F.array().cast("array<int>").alias("open"), F.lit(0).alias("deepest"))

    def step(state: Column, line: Column) -> Column:
        still = F.filter(state["open"], lambda i: i < indent(line))
        now = F.when(loop(line), F.array_append(still, indent(line))).otherwise(still)
        blank = F.trim(line) == ""
        return F.when(blank, state).otherwise(F.struct(now.alias("open"), F.greatest(state["deepest"], F.size(now)).alias("deepest")))

    depth = F.aggregate(F.split(bare, "\n"), start, step)["deepest"]
    low = F.lower(bare)
    return (
        F.when(low.contains("permutations"), "O(n!)")
        .when(low.rlike(r"\.sort\(|sorted\("), "O(n log n)")
        .when(low.rlike(r"bisect|binary_?search"), "O(log n)")
        .when(depth >= 2, "O(n^2)")
        .when(depth == 1, "O(n)")
        .otherwise("O(1)")
    )
