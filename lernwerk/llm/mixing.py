"""Mixing sources to target weights by a low-discrepancy schedule, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, word_count

#: Weights of the sources in code-point order, repeating; the fractional part of the golden ratio.
WEIGHTS = (3.0, 1.0, 2.0)
GOLDEN = 0.6180339887498949
#: Share of all words that the mix holds, and how often one document may be used.
SHARE, PASSES = 1.5, 2
#: Blocks of equal words over the whole mix, at most, and blocks a source has at least.
BLOCKS, LEAST_BLOCKS = 1 << 16, 256
#: Documents of a source are laid out in groups by the first hex digits of a hash of the id; slots in runs of a length.
GROUP_DIGITS, SLOT_RUN = 3, 1024


def source_targets(sources: DataFrame, share: float = SHARE, passes: int = PASSES, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """Targets of sources (columns source, source_size): shares by weight, none above ``passes`` times its size.

    The excess of sources at their limit goes to the others by weight until none is
    above. With sources in order of limit over weight, then by name, the level at which this ends
    is the first that is no higher than its own source's ratio, so running sums
    do; where even the last is higher, all sources are at their limit. The windows run over one row a source.
    """
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    s = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")))
    s = s.withColumn("limit", F.col("source_size") * F.lit(float(passes))).withColumn("ratio", F.col("limit") / F.col("weight"))
    everything = Window.partitionBy()
    by_ratio = Window.orderBy("ratio", F.asc_nulls_last("source"))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    spent = F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = (F.sum("source_size").over(everything) * F.lit(share) - spent) / left
    s = s.withColumn("level", level).withColumn("place", F.row_number().over(by_ratio))
    s = s.withColumn("settled", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("place", "level"))).over(everything)["level"])
    return s.withColumn("target", F.coalesce(F.least("limit", F.col("settled") * F.col("weight")), "limit")).select("source", "source_size", "target")


def plan_blocks(targets: DataFrame, share: float = SHARE, passes: int = PASSES, blocks: int = BLOCKS, least: int = LEAST_BLOCKS) -> DataFrame:
    """Add each source's block length, block count, quota of slots and range of the cumulative weights."""
    everything = Window.partitionBy()
    usual = F.ceil(F.sum("source_size").over(everything) * F.lit(share) / F.lit(float(blocks)))
    p = targets.withColumn("block_size", F.greatest(F.lit(1).cast("long"), F.least(usual, F.ceil(F.col("source_size") / F.lit(float(least))))).cast("long"))
    p = p.withColumn("blocks", F.ceil(F.col("source_size") / F.col("block_size")).cast("long")).withColumn("need", F.col("target") / F.col("block_size"))
    p = p.withColumn("quota", F.least(F.col("blocks") * passes, F.ceil(F.col("need"))))
    upto = Window.orderBy(F.asc_nulls_last("source"))
    p = p.withColumn("hi", F.sum("need").over(upto))
    return p.withColumn("lo", F.coalesce(F.lag("hi").over(upto), F.lit(0.0))).withColumn("whole", F.sum("need").over(everything))


def schedule(plan: DataFrame) -> DataFrame:
    """``slot``, ``source``, ``pass``, ``block``: the order in which blocks are used.

    Slot n goes to the source whose range of the cumulative weights holds the
    fractional part of n times the golden ratio, and takes that source's next
    block. Every run of slots is close to the weights. Slots beyond a source's quota are left out.
    """
    spark = plan.sparkSession
    length = plan.agg(F.max("whole")).first()[0] or 0.0
    n = int(-(-length // 1))
    cells = 1024
    cell = lambda c: F.floor(c / F.lit(max(length, 1e-300)) * cells)
    ranges = plan.where("hi > lo").select("source", "lo", "hi", "blocks", "quota", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi")))).alias("cell"))
    u = F.col("id") * F.lit(GOLDEN)
    points = spark.range(n).select(F.col("id").alias("slot"), ((u - F.floor(u)) * F.lit(float(length))).alias("x")).withColumn("cell", cell(F.col("x")))
    drawn = points.join(ranges, "cell").where("x >= lo and x < hi").withColumn("run", F.floor(F.col("slot") / SLOT_RUN))
    before = Window.partitionBy("source").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    starts = drawn.groupBy("source", "run").agg(F.count("*").alias("n")).select(F.col("source").alias("s"), F.col("run").alias("r"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy("source", "run").orderBy("slot")) - 1
    ranked = drawn.withColumn("within", within).join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("run") == F.col("r")))
    ranked = ranked.withColumn("rank", F.col("start") + F.col("within")).where("rank < quota")
    return ranked.select("slot", "source", F.floor(F.col("rank") / F.col("blocks")).alias("pass"), F.pmod("rank", "blocks").alias("block"))


def lay_out(docs: DataFrame) -> DataFrame:
    """Give every row (id, source, size, mix) its first word's place ``at`` in its source's shuffled words, and a number ``row``.

    Rows are shuffled by the hash ``mix``. A group of rows is summed first, so that no
    task orders a whole source. Rows without words share a place; ``row`` tells rows of one place and id apart.
    """
    rows = docs.withColumn("group", F.substring("mix", 1, GROUP_DIGITS))
    before = Window.partitionBy("source").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("source", "group").agg(F.sum("size").alias("words")).select(F.col("source").alias("s"), F.col("group").alias("g"), F.coalesce(F.sum("words").over(before), F.lit(0)).alias("start"))
    order = Window.partitionBy("source", "group").orderBy("mix", "id", "size")
    within = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1))
    placed = rows.withColumn("row", F.row_number().over(order)).withColumn("within", F.coalesce(within, F.lit(0)))
    return placed.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("group") == F.col("g"))).withColumn("at", F.col("start") + F.col("within")).drop("s", "g", "mix", "group", "start", "within")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", columns: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Mix the words of all documents to their sources' targets.

    Returns ``(rows, mix)``. ``rows`` has one row a document, with ``size``, ``source_size``, ``target``
    its place ``at`` and a number ``row`` that tells rows of one place and id apart, and in the struct ``doc`` the ``columns`` asked for (id and source by default). ``mix`` has one
    row for each run of a document's words in a slot: the columns of ``rows`` with
    ``slot``, ``pass``, ``start`` (in the document) and ``length``; documents that no slot takes, or without
    words, are there once with a null slot and length 0, so no row is lost.

    A document without words, or with a null text, has size 0 and is never taken.
    A null source is a source of its own, the last in order. The shuffle is by a hash of the id, of the text
    where the id is null. Rows with equal ids and sizes are interchangeable, and each has its own row in the result. An empty table gives empty results. Reruns agree:
    order and schedule come from hashes and arithmetic alone.
    """
    chosen = columns or [id_col, source_col]
    text = F.coalesce(F.col(text_col), F.lit(""))
    sized = cut(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(text).alias("size"), F.md5(F.coalesce(F.col(id_col).cast("string"), text)).alias("mix"), F.struct(*chosen).alias("doc")))
    targets = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    plan = cut(plan_blocks(targets))
    facts = plan.select(F.col("source").alias("s"), "source_size", "target", "block_size")
    rows = lay_out(sized).join(facts, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    first, last = F.floor(F.col("at") / F.col("block_size")), F.floor((F.col("at") + F.col("size") - 1) / F.col("block_size"))
    parts = rows.withColumn("of", F.explode(F.when(F.col("size") > 0, F.sequence(first, last)).otherwise(F.array(F.lit(-1).cast("long")))))
    begin = F.greatest("at", F.col("of") * F.col("block_size"))
    end = F.least(F.col("at") + F.col("size"), (F.col("of") + 1) * F.col("block_size"))
    slots = schedule(plan).withColumnRenamed("source", "s")
    mix = (
        parts.join(slots, F.col("source").eqNullSafe(F.col("s")) & (F.col("of") == F.col("block")), "left")
        .withColumn("start", begin - F.col("at"))
        .withColumn("length", F.when(F.col("slot").isNull(), F.lit(0).cast("long")).otherwise(end - begin))
        .drop("s", "block", "of", "block_size")
    )
    return rows.drop("block_size"), mix


def words_taken(mix: DataFrame) -> DataFrame:
    """Words that the mix takes of each document, repeats counted: one row a document."""
    return mix.groupBy("id", "source", "size", "source_size", "target", "at", "row").agg(F.sum("length").alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The documents of the mix, whole: one row for each pass in which the mix takes a document's first word.

    The mix is worked out without the texts; they move once, to be joined with the number
    of their passes. Rows equal in id, source and text are taken alike.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in (id_col, source_col)]
    keyed = docs.withColumn("__row", F.md5(F.concat_ws("\x1f", *parts, text)))
    _, mix = mix_sources(keyed, id_col, source_col, text_col, ["__row"])
    first = F.col("start") == 0
    uses = mix.groupBy(F.col("doc.__row").alias("__row")).agg(
        F.count_if(first & F.col("slot").isNotNull()).alias("uses"), F.count_if(first & (F.coalesce("pass", F.lit(0)) == 0)).alias("rows")
    )
    uses = uses.select("__row", F.floor(F.try_divide("uses", "rows") + 0.5).cast("int").alias("__uses")).where("__uses > 0")
    return keyed.join(uses, "__row").select(*docs.columns, F.explode(F.array_repeat(F.lit(1), F.col("__uses"))).alias("__use")).drop("__use")
