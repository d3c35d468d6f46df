"""Exact deduplication with DataFrame operations only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

RESULTS = ("keep_id", "group_size", "kept", "text_sha256")


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "min",
    content_hash: Callable[[Column], Column] = F.md5,
) -> DataFrame:
    """Mark, in each set of equal texts, the row that stays.

    Texts are equal when identical after lower-casing A-Z. Rows are grouped by a
    128-bit hash of the text and by the bytes themselves, so two texts that share a
    hash stay apart. The grouping is combined before its shuffle: a group holding a
    third of all rows sends one row per task. The way back from a group to its rows
    is a join that carries no text, on the hash and the SHA-256 of the text; a
    group with very many rows is split there by adaptive execution.

    Adds ``keep_id`` (id of the row that stays), ``group_size``, ``kept`` and
    ``text_sha256``; input columns of these names are replaced. A null text counts
    as empty. Null ids are passed over for ``keep_id``; a group of nothing but null
    ids has a null ``keep_id`` and keeps its rows. Rows that repeat the id of the
    row that stays are one document and carry the same mark. An empty table gives
    an empty result.
    """
    d = docs.drop(*RESULTS)
    text = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    pick = F.max if keep == "max" else F.min
    groups = (
        d.select(F.col(id_col).alias("__id"), text.alias("__text"))
        .withColumn("__hash", content_hash(F.col("__text")))
        .groupBy("__hash", "__text")
        .agg(pick("__id").alias("keep_id"), F.count("*").alias("group_size"))
        .select("__hash", F.sha2("__text", 256).alias("text_sha256"), "keep_id", "group_size")
    )
    rows = d.withColumn("__hash", content_hash(text)).withColumn("text_sha256", F.sha2(text, 256))
    return (
        rows.join(groups, ["__hash", "text_sha256"])
        .withColumn("kept", F.col(id_col).eqNullSafe(F.col("keep_id")))
        .select(*d.columns, *RESULTS)
    )
