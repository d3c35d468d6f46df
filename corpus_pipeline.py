"""A training corpus from raw documents: filter, deduplicate, mix, encode.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next stage's docs. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lernwerk.llm import exact, mixing, near, pieces, quality
from lernwerk.llm.common import bound_batches, table
from lernwerk.llm.queries import tokenizer_model

#: Python workers live through all stages, so what one stage makes them hold adds to the next; their batches are kept smaller than an operator's own.
BATCH_BYTES = 2 << 20


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling keeps.

    Without labels of both classes all stay. Null and empty texts have a log ratio of 0 and are judged by it, null ids
    share one noise, repeated rows stay or go together, and an empty table gives an empty one.
    """
    return quality.resample(bound_batches(docs, BATCH_BYTES), table(spark, sf_dir, "labels")).where("kept").select(*docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each set of equal texts, that with the smallest id.

    Null texts equal empty ones. Rows that repeat the id that stays all stay; so do all rows of a set without any id.
    An empty table gives an empty one.
    """
    return exact.exact_dedup(docs, keep="min").where("kept").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest id.

    Near copies share 0.8 or more of their five-word shingles. Operator 1's SimHash links are taken first, an index of the shingles' minima
    finds the pairs that three bits do not tell, and the shingles confirm both. Null texts equal empty ones. Rows without an id have no group to stand for and stay, as do rows that repeat
    the id that stays. An empty table gives an empty one.
    """
    grouped = near.near_copies(bound_batches(docs, BATCH_BYTES))
    return grouped.where("component_id is null or doc_id is null or doc_id = component_id").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, whole; one that the mix takes twice is there twice.

    Documents without words are never taken; a null source is a source of its own; rows equal in id, source and text are
    taken alike. An empty table gives an empty one.
    """
    return mixing.mixed_documents(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, and whether they spell it again; a null text counts as empty, every row has its own result, and an empty table gives none."""
    coded = bound_batches(docs, BATCH_BYTES).withColumn("__coded", pieces.encode_and_decode(F.col("text"), tokenizer_model()))
    same = F.col("__coded.decoded") == F.coalesce(F.col("text"), F.lit(""))
    return coded.select("doc_id", "source", "lang", "__coded.ids", F.size("__coded.ids").cast("long").alias("n_tokens"), same.alias("round_trip"))


STAGES = [("quality", good_quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mix", mix), ("tokenize", tokenize)]
#: SQL has no SimHash components, n-gram models or SentencePiece; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between them is written to the shared folder."""
    folder = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir() or tempfile.mkdtemp(prefix="pipeline-")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{folder}/pipeline-{uuid.uuid4().hex}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
