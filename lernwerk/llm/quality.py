"""Quality filtering by importance resampling with hashed n-gram models."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, cut
from .histogram import split_points

BUCKET_BITS = 14
#: Labelled documents of either class that fit the target model and the level, at most: those first by a hash of the id.
FIT_ROWS = 20_000
#: Noise is divided by this before it is added; 1 is sampling by the models themselves, more is closer to a plain cut.
SHARPNESS = 1.0
SMOOTHING = 1.0
#: Noisy log ratios are ordered as whole numbers: so many steps to a unit, counted down from a number above any.
KEY_ZERO, KEY_STEPS = float(1 << 42), float(1 << 20)
#: Texts are worked on in runs of so many code points.
RUN_CHARS = 1 << 20
_REPEAT, _PAIR = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _buckets(h: np.ndarray, follows: np.ndarray) -> np.ndarray:
    """Buckets of all hashed words, then of all pairs of a word and the one before it in its text."""
    second = np.flatnonzero(follows)
    pairs = (h[second - 1] * _PAIR + h[second]) * _REPEAT
    top = np.uint64(64 - BUCKET_BITS)
    return np.concatenate(((h * _REPEAT) >> top, (pairs ^ (pairs >> np.uint64(31))) * _PAIR >> top)).astype(np.int64)


def _digests(forms: pa.Array) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(s) for s in forms.to_pylist()] or [0], np.uint64)


def ngram_buckets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed 1- and 2-grams of all texts, and the number of each text.

    There are two families, each with buckets of its own: the words themselves (in small letters), and their
    spelling classes, in which runs of small letters, capitals and digits become one letter each and other
    characters stay; there, a word that repeats the one before it is told apart.
    """
    words = pc.ascii_split_whitespace(pa.array([t or "" for t in texts], pa.large_string()))
    flat = words.flatten()
    counts = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    keep = pc.not_equal(flat, "")
    owner = np.repeat(np.arange(len(texts)), counts)[keep.to_numpy(zero_copy_only=False)]
    spelled = flat.filter(keep).dictionary_encode()
    word = spelled.indices.to_numpy()
    follows = np.zeros(len(word), bool)
    follows[1:] = owner[1:] == owner[:-1]
    shape = spelled.dictionary
    for pattern, letter in ((r"\p{Ll}+", "a"), (r"\p{Lu}+", "A"), (r"\p{Nd}+", "0")):
        shape = pc.replace_substring_regex(shape, pattern=pattern, replacement=letter)
    shape = shape.dictionary_encode()
    h = _digests(shape.dictionary)[shape.indices.to_numpy()[word]] if len(word) else np.zeros(0, np.uint64)
    repeats = follows.copy()
    repeats[1:] &= word[1:] == word[:-1]
    plain = _digests(pc.utf8_lower(spelled.dictionary))[word] if len(word) else np.zeros(0, np.uint64)
    shapes = _buckets(np.where(repeats, h ^ _REPEAT, h), follows)
    owners = np.concatenate((owner, owner[follows]))
    return np.concatenate((shapes, _buckets(plain, follows) + (1 << BUCKET_BITS))), np.concatenate((owners, owners))


def _runs(*columns: list) -> Iterator[tuple[list, ...]]:
    """Slices of equally long lists, the first of texts, of about ``RUN_CHARS`` code points."""
    start = size = 0
    for i, t in enumerate(columns[0]):
        size += len(t) if t else 0
        if size >= RUN_CHARS or i == len(columns[0]) - 1:
            yield tuple(c[start : i + 1] for c in columns)
            start, size = i + 1, 0


def fit_ratio(texts: DataFrame) -> np.ndarray:
    """Log ratio of each bucket's share in target texts over its share in all texts (columns text, target), within its family.

    Every document is counted. Counts are summed in the tasks first, then by bucket;
    the driver receives one row a bucket.
    """
    n = 2 << BUCKET_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for batch in batches:
            for part, flags in _runs(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                buckets, owner = ngram_buckets(part)
                raw += np.bincount(buckets, minlength=n)
                target += np.bincount(buckets[np.array(flags, bool)[owner]], minlength=n)
        used = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(raw[used]), pa.array(target[used])], ["bucket", "raw", "target"])

    sums = texts.select("text", "target").mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw"), F.sum("target"))
    raw, target = np.full(n, SMOOTHING), np.full(n, SMOOTHING)
    for b, r, t in sums.collect():
        raw[b] += r
        target[b] += t
    if target.sum() == SMOOTHING * n:
        return np.zeros(n)  # no target texts: nothing tells them from the rest
    target, raw = (x.reshape(2, -1) / x.reshape(2, -1).sum(1, keepdims=True) for x in (target, raw))
    return (np.log(target) - np.log(raw)).ravel()


def log_ratio(text: Column, ratio: np.ndarray) -> Column:
    """Log of the target model's over the raw model's likelihood of a whole text; 0 for an empty one."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        out = [np.zeros(0)]
        for (part,) in _runs(texts.tolist()):
            buckets, owner = ngram_buckets(part)
            out.append(np.bincount(owner, weights=ratio[buckets], minlength=len(part)))
        return pd.Series(np.concatenate(out))

    return score(text)


def _level(scores: list[float], good: list[int]) -> float:
    """The score between clean and rejected labelled documents that errs least, the lowest such."""
    if not good or all(good):
        return float("-inf")
    order = np.argsort(scores, kind="stable")
    s, g = np.array(scores)[order], np.array(good)[order]
    # rejecting the first i: clean ones among them, and rejected ones after them, are errors
    errors = np.concatenate(([0], np.cumsum(g))) + np.concatenate((np.cumsum((1 - g)[::-1])[::-1], [0]))
    i = int(errors.argmin())
    if i == 0:
        return float("-inf")
    return float(s[i - 1] + (s[i] - s[i - 1]) * 0.5) if i < len(s) else float(s[-1]) + 1.0


def resample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, fit_rows: int = FIT_ROWS, sharpness: float = SHARPNESS) -> DataFrame:
    """Add ``log_ratio`` and ``kept``: the k documents with the highest noisy log ratios stay.

    The target model is fitted on labelled documents of quality 1 (``fit_rows`` at most), the raw
    model on all documents. k is the number of documents whose log ratio reaches
    the level that best parts the labelled classes. Gumbel noise, drawn from a
    hash of the id, makes the top k a sample without replacement; with a high
    ``sharpness`` it decides only between documents about as likely. The k-th key is found by
    counting, without a sort; keys are told apart to a millionth, and equal ones are ordered by id.

    A null or empty text has log ratio 0. Without labels of both classes all
    documents stay. Null ids share one noise. Rows of equal key and id stay or go together. Input
    columns named log_ratio or kept are replaced; an empty table gives an empty result.
    """
    d = bound_batches(docs).drop("log_ratio", "kept")
    chosen = labels.where("quality in (0, 1)").groupBy(F.col("doc_id").alias("__label_id")).agg(F.max("quality").alias("__good"))
    first = [chosen.where(F.col("__good") == g).orderBy(F.xxhash64("__label_id", F.lit(seed)), "__label_id").limit(fit_rows) for g in (1, 0)]
    sample = F.broadcast(cut(first[0].unionByName(first[1])))  # at most twice fit_rows rows of 12 bytes
    labelled = d.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(sample, F.col("__id") == F.col("__label_id"), "left")
    ratio = fit_ratio(labelled.select("text", F.coalesce(F.col("__good") == 1, F.lit(False)).alias("target")))
    scored = cut(labelled.select("__id", F.col("__good").alias("good"), log_ratio(F.col("text"), ratio).alias("ratio")))
    known = scored.where("good is not null").select("ratio", "good").collect()
    level = _level([r[0] for r in known], [r[1] for r in known])
    u = (F.shiftrightunsigned(F.xxhash64(F.coalesce("__id", F.lit(0)), F.lit(seed)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    noisy = F.col("ratio") - F.log(-F.log(u)) / F.lit(sharpness)
    # highest first: the order of split_points is ascending. A text has fewer than 2^32 n-grams, each with a log ratio under 2^6,
    # so all keys fit
    key = ((F.lit(KEY_ZERO) - noisy) * F.lit(KEY_STEPS)).cast("long")
    keyed = scored.withColumn("key", key)
    keyed = keyed.withColumn("tie", F.coalesce("__id", F.lit(0)).cast("long")).withColumn("one", F.lit(1).cast("long"))
    k = keyed.where(F.col("ratio") >= level).count()
    last = split_points(keyed, [k - 1], weight="one") if k else []
    pick = F.lit(False) if not last else (F.col("key") < last[0].key) | ((F.col("key") == last[0].key) & (F.col("tie") <= last[0].tie))
    # a row's key comes from its own text and id, so the documents are marked where they are, without a join
    ratio_col = log_ratio(F.coalesce(F.col(text_col), F.lit("")), ratio)
    marked = d.withColumn("log_ratio", ratio_col).withColumn("__id", F.col(id_col)).withColumn("ratio", F.col("log_ratio"))
    marked = marked.withColumn("key", key)
    return marked.withColumn("tie", F.coalesce("__id", F.lit(0)).cast("long")).withColumn("kept", pick).select(*d.columns, "log_ratio", "kept")
