"""Scores recomputed from raw submissions, and held against what was recorded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import once, weight

DEFAULT = 6


def distinct_labels(df: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct label texts over several columns."""
    return df.select(F.explode(F.array_distinct(F.array(*columns))).alias("label")).distinct()


def lookup_weights(subs: DataFrame, columns: list[str]) -> DataFrame:
    """Add ``w_<column>``: the ordinal of each label; blank labels stay blank. The rule runs once for each distinct label."""
    found = once(subs, {f"w_{c}": c for c in columns}, lambda c: weight(c, DEFAULT))
    return found.withColumns({f"w_{c}": F.when(F.col(c) != "", F.col(f"w_{c}")) for c in columns})


def _ratio(target: Column, actual: Column) -> Column:
    return F.least(F.lit(1.0), target.cast("double") / actual)


def workings(subs: DataFrame) -> DataFrame:
    """Success rate, efficiency, best score, baseline and gain from labels and counters.

    Unchanged code keeps its recorded best. The gain is for optimizations alone, against the
    recorded first score, else the baseline's own.
    """
    names = ["target_time", "target_space", "latest_time", "latest_space", "baseline_time", "baseline_space"]
    s = lookup_weights(subs, names)
    w = {n: F.col(f"w_{n}") for n in names}
    opt = F.coalesce(F.col("type") == "optimization", F.lit(False))
    s = s.withColumn("functional_rate", F.when(F.col("functional_total") > 0, F.coalesce("functional_passed", F.lit(0.0)) / F.col("functional_total")).otherwise(1.0))
    mean = lambda a, b: (_ratio(w["target_time"], a) + _ratio(w["target_space"], b)) / 2
    s = s.withColumn("aes_latest_calc", F.floor(F.col("functional_rate") * mean(w["latest_time"], w["latest_space"]) * 100).cast("double"))
    baseline = F.floor(mean(w["baseline_time"], w["baseline_space"]) * 100).cast("double")
    s = s.withColumn("base_calc", F.when(opt, F.coalesce("initial_aes", baseline)))
    earlier = F.when(F.col("final_aes") > F.col("latest_aes"), F.col("final_aes")).otherwise(0.0)
    best = (
        F.when(F.col("final_aes").isNull(), None)
        .when(F.col("code_unchanged"), F.col("final_aes"))
        .when(F.col("aes_latest_calc").isNotNull(), F.greatest(F.col("aes_latest_calc"), earlier))
        .otherwise(F.col("final_aes"))
    )
    s = s.withColumn("aes_calc", best)
    gain = F.when(F.col("base_calc").isNotNull(), F.greatest(F.lit(0.0), F.col("aes_calc") - F.col("base_calc"))).otherwise(F.coalesce("rog", "aes_calc"))
    return s.withColumn("rog_calc", F.when(opt & F.col("aes_calc").isNotNull(), gain)).drop(*[f"w_{n}" for n in names])


def reconcile(worked: DataFrame) -> DataFrame:
    """OK, DIFF or n/a of each recomputed figure."""

    def compare(a: str, b: str) -> Column:
        return F.when(F.col(a).isNull() | F.col(b).isNull(), "n/a").when(F.col(a) == F.col(b), "OK").otherwise("DIFF")

    pairs = {"latest_check": ("aes_latest_calc", "latest_aes"), "final_check": ("aes_calc", "final_aes"), "rog_check": ("rog_calc", "rog")}
    return worked.withColumns({n: compare(*ab) for n, ab in pairs.items()})
