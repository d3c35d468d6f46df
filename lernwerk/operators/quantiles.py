"""Exact quantiles and keyed pages, both by counting ranges."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..session import cut

#: Cells that a bracket is cut into, rows of a bracket that are sorted, brackets that are broadcast, at most.
CELLS, FINISH, MOST_BROADCAST = 1024, 4096, 10_000


def exact_quantiles(df: DataFrame, by: list[str], value: str, places: dict[str, float], cells: int = CELLS, finish: int = FINISH) -> DataFrame:
    """Interpolated quantiles of each group, exactly, in a column for each name of ``places``.

    A quantile lies between two order statistics. Each has a bracket, at first all values of its group, which is cut into
    ``cells`` of equal width; the cell in which the counts reach the statistic's rank is the next bracket, as wide as its
    values. Rows outside all brackets are left behind. Values of brackets of ``finish`` rows or fewer are sorted; a bracket of one
    value needs no sorting, however often it is there. Null, NaN and infinite values are passed over; a group without others has no row.
    """
    keys = [f"__k{i}" for i in range(len(by))]
    v, edge = F.col("v"), [*keys, "lo", "hi"]
    rows = df.select(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], F.col(value).cast("double").alias("v"), F.lit(1).cast("long").alias("copies"))
    rows = rows.where(v.isNotNull() & (F.abs(v) < float("inf")))
    groups = rows.groupBy(*keys).agg(F.count("*").alias("inside"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    at = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(p).alias("p")) for n, p in places.items()]))
    x = (F.col("inside") - 1) * F.col("q.p")
    asked = cut(groups.select(*edge, "inside", at.alias("q")).select(*edge, "inside", "q.name", (x - F.floor(x)).alias("part"), F.floor(x).alias("low"), F.ceil(x).alias("high")))
    brackets = asked.select(*edge, "inside", F.explode(F.array("low", "high")).alias("rank")).distinct().withColumn("below", F.lit(0).cast("long"))
    brackets = cut(brackets)

    def held(rows: DataFrame, brackets: DataFrame) -> DataFrame:
        """Rows with the brackets that they lie in."""
        b = brackets.select(*[F.col(k).alias(f"{k}_b") for k in keys], "lo", "hi").distinct()
        same = reduce(lambda a, k: a & F.col(k).eqNullSafe(F.col(f"{k}_b")), keys, v.between(F.col("lo"), F.col("hi")))
        return rows.join(F.broadcast(b) if b.count() <= MOST_BROADCAST else b, same).drop(*[f"{k}_b" for k in keys])

    def kept(rows: DataFrame, brackets: DataFrame) -> DataFrame:
        """Values that lie in some bracket, with how often they are there."""
        near = held(rows, brackets).groupBy(*edge, "v").agg(F.sum("copies").alias("copies"))
        return near.select(*keys, "v", "copies").distinct()

    def narrowed(rows: DataFrame, brackets: DataFrame, cell: Column) -> DataFrame:
        """Brackets around the cells in which their ranks lie."""
        counts = held(rows, brackets).groupBy(*edge, cell.alias("cell")).agg(F.sum("copies").alias("c"), F.min("v").alias("lo2"), F.max("v").alias("hi2"))
        counts = counts.withColumn("upto", F.sum("c").over(Window.partitionBy(*edge).orderBy("cell")))  # ``cells`` or ``finish`` rows a bracket
        named = counts.select(*[F.col(k).alias(f"{k}_c") for k in edge], "c", "lo2", "hi2", "upto")
        inner = brackets.join(named, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{k}_c")) for k in edge]))
        before = F.col("below") + F.col("upto") - F.col("c")
        inner = inner.where((before <= F.col("rank")) & (before + F.col("c") > F.col("rank")))
        return inner.select(*keys, F.col("lo2").alias("lo"), F.col("hi2").alias("hi"), F.col("c").alias("inside"), "rank", before.alias("below"))

    width = F.col("hi") / 2 - F.col("lo") / 2
    while not (wide := brackets.where((F.col("lo") < F.col("hi")) & (F.col("inside") > finish))).isEmpty():
        cell = F.least(F.floor((v / 2 - F.col("lo") / 2) / width * cells), F.lit(cells - 1))
        done = brackets.where((F.col("lo") == F.col("hi")) | (F.col("inside") <= finish))
        brackets = cut(done.unionByName(narrowed(rows, wide, cell)))
        # brackets of one group can overlap, so a row is kept once
        inside = brackets.where("lo < hi")
        rows = cut(kept(rows, inside))
    single = brackets.where("lo = hi").select(*keys, "rank", F.col("lo").alias("value"))
    last = narrowed(rows, brackets.where("lo < hi"), v).select(*keys, "rank", F.col("lo").alias("value")).unionByName(single)
    got = lambda name, to: last.select(*[F.col(k).alias(f"{k}_{name}") for k in keys], F.col("rank").alias(f"rank_{name}"), F.col("value").alias(to))
    on = lambda name: reduce(lambda a, k: a & F.col(k).eqNullSafe(F.col(f"{k}_{name}")), keys, F.col(name) == F.col(f"rank_{name}"))
    both = asked.join(got("low", "a"), on("low")).join(got("high", "b"), on("high"))
    between = F.col("a") + (F.col("b") - F.col("a")) * F.col("part")
    named = [F.max(F.when(F.col("name") == n, between)).alias(n) for n in places]
    return both.groupBy(*[F.col(k).alias(c) for k, c in zip(keys, by, strict=True)]).agg(*named)


@dataclass
class PageIndex:
    """Ranges of a table's order by its keys: how many rows lie in each, and the first and last keys."""

    keys: list[str]
    ranges: list[Row]

    @property
    def rows(self) -> int:
        return sum(r["n"] for r in self.ranges)


#: Ranges of a page index, at most; they are kept on the driver.
MOST_RANGES = 4096


def page_index(df: DataFrame, keys: list[str], ranges: int = 256) -> PageIndex:
    """Count a table in ranges of its order. The keys alone are shuffled; pages are then looked up without another pass over all rows.

    Keys tell rows apart; of rows with equal keys, which comes first is open. Nulls come first.
    """
    if ranges > MOST_RANGES:
        raise ValueError(f"{ranges} ranges; {MOST_RANGES} at most")
    k = df.select(F.struct(*keys).alias("k")).repartitionByRange(ranges, "k")
    found = k.groupBy(F.spark_partition_id().alias("part")).agg(F.count("*").alias("n"), F.min("k").alias("lo"), F.max("k").alias("hi"))
    return PageIndex(keys, sorted(found.collect(), key=lambda r: r["part"]))


def page(df: DataFrame, keys: list[str], size: int, number: int, index: PageIndex | None = None) -> DataFrame:
    """One page of the order of ``keys``; a number beyond the last gives the last page.

    With the index (made here if not given), the rows between the page's outer ranges are read and numbered, and no others.
    """
    index = page_index(df, keys) if index is None else index
    if not index.ranges:
        return df.limit(0)
    number = max(1, min(number, -(-index.rows // size)))
    start, before, near = (number - 1) * size, 0, []
    for r in index.ranges:
        if before < start + size and before + r["n"] > start:
            near.append((r, before))
        before += r["n"]
    (first, skipped), last = near[0], near[-1][0]
    whole = lambda row: F.struct(*[F.lit(row[k]).cast(df.schema[k].dataType).alias(k) for k in keys])
    inside = df.where((F.struct(*keys) >= whole(first["lo"])) & (F.struct(*keys) <= whole(last["hi"])))
    if first["lo"][keys[0]] is not None:  # reaches the scan
        inside = inside.where(F.col(keys[0]).between(F.lit(first["lo"][keys[0]]), F.lit(last["hi"][keys[0]])))
    return inside.orderBy(*keys).offset(start - skipped).limit(size)
