"""Paired tests, effect sizes and the one-predictor regression."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import interpret_effect, interpret_gain
from ..functions.student_t import t_critical, t_two_tailed_p

MAX_SCORE, FLAT = 100.0, 1e-12
# Limits of the warnings.
CEILING_SCORE, CEILING_SHARE, OVERLAP, SMALL, LEAST = 89.0, 0.8, 0.8, 50, 8
METRICS = ("tsr", "aes", "rog")


def descriptives(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, mean and sample deviation of each column, in one pass."""
    pairs = ", ".join(f"'{c}', {c}" for c in columns)
    return df.selectExpr(f"stack({len(columns)}, {pairs}) as (variable, value)").groupBy("variable").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))


def paired_t(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Paired t test of post over pre; t and p are null where the differences do not vary."""
    d = F.col("post") - F.col("pre")
    g = pairs.groupBy(*(by or [])).agg(
        F.count("*").alias("n"), F.avg("pre").alias("mean_pre"), F.avg("post").alias("mean_post"), F.stddev_samp("pre").alias("sd_pre"), F.stddev_samp("post").alias("sd_post"),
        F.avg(d).alias("mean_difference"), F.stddev_samp(d).alias("sd_difference"),
    )
    g = g.withColumn("t", F.when(F.col("sd_difference") > 0, F.col("mean_difference") / (F.col("sd_difference") / F.sqrt("n")))).withColumn("df", F.when(F.col("n") > 0, F.col("n") - 1))
    g = g.withColumn("p", t_two_tailed_p(F.col("t"), F.col("df").cast("double")))
    return g.withColumn("significant", F.col("p") < 0.05)


def effect_sizes(tests: DataFrame) -> DataFrame:
    """Cohen's d and Hake's g; g uses means rounded to two digits, and is undefined at a full pre score."""
    pre, post = F.bround("mean_pre", 2), F.bround("mean_post", 2)
    out = tests.withColumn("cohens_d", F.when(F.col("sd_difference") > 0, F.col("mean_difference") / F.col("sd_difference")))
    out = out.withColumn("hakes_g", F.when(pre != MAX_SCORE, (post - pre) / (F.lit(MAX_SCORE) - pre))).withColumn("hakes_g_unrounded", F.when(F.col("mean_pre") != MAX_SCORE, (F.col("mean_post") - F.col("mean_pre")) / (F.lit(MAX_SCORE) - F.col("mean_pre"))))
    return out.withColumn("d_label", interpret_effect(F.col("cohens_d"))).withColumn("g_label", interpret_gain(F.col("hakes_g")))


def zscores(df: DataFrame, columns: list[str]) -> DataFrame:
    """Add ``z_<column>``; a column that does not vary gives nulls. The means are one row, joined to all."""
    sums = df.agg(*[f(c).alias(f"__{n}_{c}") for c in columns for n, f in (("mean", F.avg), ("sd", F.stddev_samp))])
    out = df.crossJoin(F.broadcast(sums))  # one row
    for c in columns:
        out = out.withColumn(f"z_{c}", F.when(F.col(f"__sd_{c}") > 0, (F.col(c) - F.col(f"__mean_{c}")) / F.col(f"__sd_{c}")))
    return out.drop(*sums.columns)


def normalized_gain(pre: Column, post: Column) -> Column:
    return F.when(pre != MAX_SCORE, (post - pre) / (F.lit(MAX_SCORE) - pre))


def composite(df: DataFrame) -> DataFrame:
    """Add ``x``, the mean of the three z scores, and ``y``, the normalized gain (null at a full pre score)."""
    z = zscores(df, list(METRICS))
    return z.withColumn("x", reduce(lambda a, b: a + b, [F.col(f"z_{m}") for m in METRICS]) / 3).withColumn("y", normalized_gain(F.col("pre"), F.col("post")))


def included(users: DataFrame) -> DataFrame:
    return users.dropna(subset=["pre", "post", *METRICS])


def exclusion_reasons(users: DataFrame) -> DataFrame:
    """How many respondents each reason shuts out; one may have several."""
    rules = [
        (F.col("pre").isNull(), "no pre-test score"),
        (F.col("post").isNull(), "no post-test score"),
        (F.col("tsr").isNull() | F.col("aes").isNull(), "no scored submissions (TSR/AES unavailable)"),
        (F.col("rog").isNull(), "no refactor submission (ROG unavailable)"),
    ]
    reasons = F.filter(F.array(*[F.when(c, r) for c, r in rules]), lambda r: r.isNotNull())
    return users.select(F.explode(reasons).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def ols(df: DataFrame, x: str = "x", y: str = "y", by: list[str] | None = None) -> DataFrame:
    """Least squares of y on x: estimates, t test, interval, fit; null estimates under three rows or without variation."""
    use = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    g = use.groupBy(*(by or [])).agg(
        F.count("*").alias("n"), F.avg(x).alias("mean_x"), F.avg(y).alias("mean_y"), F.regr_sxx(F.col(y), F.col(x)).alias("sxx"), F.regr_syy(F.col(y), F.col(x)).alias("syy"), F.regr_sxy(F.col(y), F.col(x)).alias("sxy"),
        F.sum(F.col(x) ** 2).alias("xx"), F.sum(F.col(y) ** 2).alias("yy"),
    )
    usable = (F.col("n") >= 3) & (F.col("sxx") > FLAT * F.greatest("xx", F.lit(1e-300))) & (F.col("syy") > FLAT * F.greatest("yy", F.lit(1e-300)))
    g = g.withColumn("b1", F.when(usable, F.col("sxy") / F.col("sxx"))).withColumn("b0", F.col("mean_y") - F.col("b1") * F.col("mean_x")).withColumn("df", F.col("n") - 2)
    g = g.withColumn("sse", F.greatest(F.col("syy") - F.col("b1") * F.col("sxy"), F.lit(0.0))).withColumn("r", F.when(usable, F.col("sxy") / F.sqrt(F.col("sxx") * F.col("syy")))).withColumn("r2", F.col("r") ** 2)
    g = g.withColumn("se", F.when(usable, F.sqrt(F.col("sse") / F.col("df") / F.col("sxx")))).withColumn("t", F.when(F.col("se") > 0, F.col("b1") / F.col("se")))
    g = g.withColumn("p", t_two_tailed_p(F.col("t"), F.col("df").cast("double"))).withColumn("tc", t_critical(F.col("df").cast("double")))
    return g.withColumn("ci_low", F.col("b1") - F.col("tc") * F.col("se")).withColumn("ci_high", F.col("b1") + F.col("tc") * F.col("se")).drop("mean_x", "mean_y", "xx", "yy", "tc")


def residuals(df: DataFrame, fit: DataFrame) -> DataFrame:
    line = fit.select("b0", "b1")  # one row
    return df.crossJoin(F.broadcast(line)).withColumn("fitted", F.when(F.col("y").isNotNull(), F.col("b0") + F.col("b1") * F.col("x"))).withColumn("residual", F.col("y") - F.col("fitted")).drop("b0", "b1")


def sensitivity_refit(df: DataFrame, fit: DataFrame, key: str = "email") -> DataFrame:
    """The fit without the row of the largest absolute residual, the first by key on ties."""
    rest = residuals(df, fit).where("residual is not null")
    most = rest.agg(F.max(F.abs("residual")).alias("__most"))  # one row
    first = rest.crossJoin(F.broadcast(most)).where(F.abs("residual") == F.col("__most")).agg(F.min(key).alias(key))
    return ols(rest.join(F.broadcast(first), key, "left_anti"))


def fit_warnings(df: DataFrame) -> DataFrame:
    """Ceiling, overlap and small-sample warnings of the included respondents."""
    a = df.agg(F.count("*").alias("n"), F.avg((F.col("post") >= CEILING_SCORE).cast("double")).alias("high_share"), F.corr("tsr", "aes").alias("r"))
    return a.select("n", (F.col("high_share") >= CEILING_SHARE).alias("ceiling"), F.coalesce(F.abs("r") > OVERLAP, F.lit(False)).alias("overlap"), (F.col("n") < SMALL).alias("small_sample"), (F.col("n") >= LEAST).alias("available"))


def scatter_line(points: DataFrame, fit: DataFrame) -> DataFrame:
    """The two end points of the fitted line."""
    ends = points.where("y is not null").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).crossJoin(F.broadcast(fit.select("b0", "b1")))
    return ends.select(F.explode(F.array("lo", "hi")).alias("x"), "b0", "b1").select("x", (F.col("b0") + F.col("b1") * F.col("x")).alias("y"))


def pearson(df: DataFrame, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    """Correlation; null where either side does not vary."""
    varies = (F.stddev_samp(a) > 0) & (F.stddev_samp(b) > 0)
    return df.groupBy(*(by or [])).agg(F.when(varies, F.corr(a, b)).alias("r"))
