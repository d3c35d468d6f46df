"""Sharding by histogram sort: equal bytes per shard, one exchange."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .histogram import Split, split_points

OVERHEAD = 16
#: Rows of a shard are numbered in so many groups, by id; a group is one task's work.
SLOT_GROUPS = 1024


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", overhead: int = OVERHEAD) -> DataFrame:
    """Add the sort order (``key``: 63 hash bits of the text, ``tie``: the id) and the ``size``.

    Null texts count as empty, null ids as 0 for the order only.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    return (
        docs.withColumn("size", (F.octet_length(text) + overhead).cast("long"))
        .withColumn("key", F.shiftrightunsigned(F.xxhash64(text), 1))
        .withColumn("tie", F.coalesce(F.col(id_col).cast("long"), F.lit(0)))
    )


def byte_splitters(rows: DataFrame, shards: int, slack: float = 0.01) -> list[Split]:
    """Splitters that cut the (key, tie) order of ``rows`` into ``shards`` of near equal bytes.

    A splitter falls on the row boundary nearest to its share. Rows with one key (equal
    texts) stay in one shard when that moves a splitter by at most ``slack`` of a
    shard; larger groups are split on ``tie``.
    """
    total = rows.agg(F.sum("size")).first()[0] or 0
    splits = split_points(rows, [total * i / shards for i in range(1, shards)], weight="size")
    held = {}
    if splits:
        held = {r[0]: r[1] for r in rows.where(F.col("key").isin(sorted({s.key for s in splits}))).groupBy("key").agg(F.sum("size")).collect()}
    for s in splits:
        s.after = s.target - s.below > s.weight / 2
        end = s.group_below + held[s.key]
        if s.target - s.group_below <= slack * total / shards:
            s.whole, s.after = True, False
        elif end - s.target <= slack * total / shards:
            s.whole, s.after = True, True
    return splits


def shard_of(splits: list[Split]) -> Column:
    """The shard of a row, as a balanced tree of comparisons."""

    def beyond(s: Split) -> Column:
        k, t = F.col("key"), F.col("tie")
        if s.whole:
            return k > s.key if s.after else k >= s.key
        return (k > s.key) | ((k == s.key) & (t > s.tie if s.after else t >= s.tie))

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(beyond(splits[mid]), tree(mid + 1, hi)).otherwise(tree(lo, mid))

    return tree(0, len(splits))


def number_slots(rows: DataFrame, groups: int = SLOT_GROUPS) -> DataFrame:
    """Number the rows of each ``shard`` from 0 without gaps, in a repeatable order.

    Rows are numbered inside (shard, id modulo ``groups``) and moved up by the counts
    of the groups before, so no task holds a shard.
    """
    rows = rows.withColumn("__group", F.pmod(F.col("tie"), F.lit(groups)))
    before = Window.partitionBy("shard").orderBy("__group").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        rows.groupBy("shard", "__group")
        .agg(F.count("*").alias("__n"))
        .select("shard", "__group", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    )
    within = Window.partitionBy("shard", "__group").orderBy("tie", "key", "size")
    return (
        rows.withColumn("__at", F.row_number().over(within) - 1)
        .join(starts, ["shard", "__group"])
        .withColumn("slot", F.col("__start") + F.col("__at"))
        .drop("__group", "__at", "__start")
    )


def shard_by_bytes(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", columns: list[str] | None = None, slack: float = 0.01) -> DataFrame:
    """Put every document into one of ``shards`` shards of near equal bytes.

    Returns ``columns`` (all by default) with ``size``, ``shard`` and ``slot``. The size is the text's UTF-8 bytes
    plus 16. Fewer documents than shards leave shards empty; an empty table gives
    an empty result. Rows equal in text and id share a shard. Input columns named
    size, key, tie, shard or slot are replaced.
    """
    docs = docs.drop("size", "key", "tie", "shard", "slot")
    columns = [c for c in columns or docs.columns if c in docs.columns]
    rows = cut(keyed(docs, id_col, text_col).select(*columns, "size", "key", "tie"))
    placed = rows.withColumn("shard", shard_of(byte_splitters(rows, shards, slack)))
    return number_slots(placed).select(*columns, "size", "shard", F.col("slot").cast("long").alias("slot"))
