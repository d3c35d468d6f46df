"""Keyed merges of offline and out-of-order changes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DROPPED_STATUS, HELD_STATUS = (400, 403, 404, 409, 410, 413, 422), (401, 429)
MOST_TRIES = 10


def last_arrival(changes: DataFrame, keys: list[str], values: list[str], seq: str = "seq") -> DataFrame:
    """The last change of each key by arrival, whatever its version."""
    return changes.groupBy(*keys).agg(F.max_by(F.struct(*values, seq), seq).alias("__v")).select(*keys, *[f"__v.{v}" for v in values], f"__v.{seq}")


def merge_columns(changes: DataFrame, keys: list[str], values: list[str], attempts: str = "attempts", seq: str = "seq") -> DataFrame:
    """Per column, the last value that is not null among accepted changes.

    A change is ignored when its attempt number is below that of the accepted changes
    before it; one without a number is always accepted.
    """
    before = F.max(attempts).over(Window.partitionBy(*keys).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1))
    accepted = changes.withColumn("__top", before).where(F.col(attempts).isNull() | F.col("__top").isNull() | (F.col(attempts) >= F.col("__top")))
    last = [F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in (*values, attempts)]
    return accepted.groupBy(*keys).agg(*last)


def upsert_documents(changes: DataFrame, keys: list[str], values: list[str], version: str = "version", seq: str = "seq") -> DataFrame:
    """The document that holds after all changes, by version with stale ones ignored.

    A change without a version, or with 0, always replaces and resets the guard, so only
    changes from the last such one on count; among them the highest version wins, the later
    arrival on ties.
    """
    v = F.coalesce(version, F.lit(0).cast("long"))
    whole = Window.partitionBy(*keys)
    reset = F.max(F.when(v == 0, F.col(seq))).over(whole)
    live = changes.withColumn("__reset", reset).where(F.col("__reset").isNull() | (F.col(seq) >= F.col("__reset")))
    best = F.max_by(F.struct(*values, version, seq), F.struct(v, F.col(seq)))
    return live.groupBy(*keys).agg(best.alias("__v")).select(*keys, *[f"__v.{c}" for c in (*values, version, seq)])


def merge_flags(a: DataFrame, key: str, flags: list[str], counters: list[str], firsts: list[str], seq: str = "seq") -> DataFrame:
    """Commutative merge: flags are ored, counters take the largest, dates the first that is known."""
    out = [F.bool_or(c).alias(c) for c in flags] + [F.max(c).alias(c) for c in counters]
    out += [F.min_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in firsts]
    return a.groupBy(key).agg(*out)


def patch_documents(docs: DataFrame, patches: DataFrame, key: str, allowed: list[str], seq: str = "seq") -> DataFrame:
    """Shallow JSON merge: of each allowed member, the last patch that holds it, else the document's own."""
    fields = [F.max_by(F.get_json_object("patch", f"$.{m}"), F.when(F.get_json_object("patch", f"$.{m}").isNotNull(), F.col(seq))).alias(f"__{m}") for m in allowed]
    last = patches.groupBy(key).agg(*fields)
    return reduce(lambda d, m: d.withColumn(m, F.coalesce(f"__{m}", F.get_json_object("doc", f"$.{m}"))).drop(f"__{m}"), allowed, docs.join(last, key, "left"))


def idempotent_insert(items: DataFrame, keys: list[str], value: str, version: str = "version", seq: str = "seq") -> DataFrame:
    """One row a client id: the first arrival names it, the highest version (later on ties) fills it."""
    v = F.coalesce(version, F.lit(-1).cast("long"))
    return items.groupBy(*keys).agg(F.min(seq).alias("id"), F.max_by(value, F.struct(v, F.col(seq))).alias(value))


def pull_merge(local: DataFrame, remote: DataFrame, keys: list[str], value: str, version: str = "version") -> DataFrame:
    """Remote wins, unless the local row was not sent yet and is at least as new."""
    lo = local.select(*keys, F.col(value).alias("__lv"), F.col(version).alias("__lt"), F.col("synced").alias("__ls"), F.lit(True).alias("__local"))
    re = remote.select(*keys, F.col(value).alias("__rv"), F.col(version).alias("__rt"), F.lit(True).alias("__remote"))
    keep = F.col("__remote").isNull() | (F.coalesce(F.col("__local") & ~F.col("__ls"), F.lit(False)) & (F.coalesce("__lt", F.lit(0)) >= F.coalesce("__rt", F.lit(0))))
    j = lo.join(re, keys, "full_outer").withColumn("won", F.when(keep, "local").otherwise("remote"))
    pick = lambda a, b: F.when(F.col("won") == "local", F.col(a)).otherwise(F.col(b))
    return j.select(*keys, "won", pick("__lv", "__rv").alias(value), pick("__lt", "__rt").alias(version))


def heal_twins(items: DataFrame) -> DataFrame:
    """Drop synced records kept under their row id while one under the canonical id exists."""
    twins = items.where("canonical_id <> key").join(items.select(F.col("key").alias("__k")), F.col("canonical_id") == F.col("__k"), "left_semi").where("synced").select("key")
    return items.join(twins, "key", "left_anti")


def max_progress(a: DataFrame, b: DataFrame, keys: list[str], value: str, flag: str) -> DataFrame:
    return a.unionByName(b).groupBy(*keys).agg(F.max(value).alias(value), F.bool_or(flag).alias(flag))


def filter_trusted(batch: DataFrame, owner: str) -> DataFrame:
    """Rows of the caller alone, counted by kind."""
    return batch.where(F.lower("email") == owner.lower()).groupBy("kind").agg(F.count("*").alias("n"))


def dedupe_queue(queue: DataFrame, keys: list[str], payload: str, seq: str = "seq") -> DataFrame:
    """One pending task a key, with the newest payload and no attempts."""
    return queue.groupBy(*keys).agg(F.max_by(payload, seq).alias(payload), F.max(seq).alias(seq)).withColumn("attempts", F.lit(0))


def triage(status: Column, action: Column, tries: Column) -> Column:
    """What becomes of a queued request: done, dropped, held or retry."""
    return (
        F.when((status >= 200) & (status < 300), "done")
        .when((status == 404) & (action == "delete"), "done")
        .when(status.isin(*HELD_STATUS), "held")
        .when(status.isin(*DROPPED_STATUS) | ~action.isin("create", "update", "delete") | (tries >= MOST_TRIES), "dropped")
        .otherwise("retry")
    )


def suppress_deleted(remote: DataFrame, queue: DataFrame) -> DataFrame:
    """Remote rows without a queued deletion, by canonical id or by row id."""
    gone = queue.select(F.col("target").alias("__t")).distinct()
    return remote.join(gone, F.col("canonical_id") == F.col("__t"), "left_anti").join(gone, F.col("row_id") == F.col("__t"), "left_anti")


def resolve_identity(remote: DataFrame, local: DataFrame) -> DataFrame:
    """The local row of each remote one: by canonical id, else row id, else client id of an owned row.

    One equi-join over all three kinds of name; the first kind that hits wins.
    """
    names = local.select("local_id", F.explode(F.array(
        F.struct(F.lit(1).alias("kind"), F.col("canonical_id").alias("name")), F.struct(F.lit(2).alias("kind"), F.col("row_id").alias("name")), F.struct(F.lit(3).alias("kind"), F.when(F.col("owned"), F.col("client_id")).alias("name"))
    )).alias("n")).select("local_id", "n.*").where("name is not null")
    asked = remote.select("remote_id", F.explode(F.array(
        F.struct(F.lit(1).alias("kind"), F.col("canonical_id").alias("name")), F.struct(F.lit(2).alias("kind"), F.col("row_id").alias("name")), F.struct(F.lit(3).alias("kind"), F.col("client_id").alias("name"))
    )).alias("n")).select("remote_id", "n.*").where("name is not null")
    hits = asked.join(names, ["kind", "name"]).groupBy("remote_id").agg(F.min(F.struct("kind", "local_id")).alias("h"))
    return remote.select("remote_id").join(hits, "remote_id", "left").select("remote_id", F.col("h.local_id").alias("local_id"), F.col("h.kind").alias("kind"))


def owned_by(items: DataFrame, a: str, b: str) -> DataFrame:
    """Items of each user named in either column, each once: an exploded equi-join key in place of an OR."""
    return items.withColumn("user", F.explode(F.array_compact(F.array_distinct(F.array(a, b)))))


def cascade(child: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """Child rows whose owner is not deleted."""
    return child.join(deleted.select(key), key, "left_anti")


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    return child.join(parent.select(key), key, "left_anti")
