"""Collocations of each language: frequent phrases, mined shard by shard (SON) and counted exactly."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from .common import bound_batches, cut, partitions

LONGEST, SUPPORT, TOP = 4, 30, 2000
#: A shard is so many words of a task's rows, and less than twice as many but for one longer text; it is what a Python worker works on at once.
SHARD_WORDS, WORD_BYTES = 1 << 18, 6
#: Bits of the set that says which phrases of a length are still in question. Its size is fixed; a full one only prunes less.
SET_BITS = 25
_WORD, _SPACE, _BREAK = 0, 1, 2
_CLASS = np.zeros(256, np.uint8)
_CLASS[[0x20, 0x09]] = _SPACE
_CLASS[list(b".,;:!?\n\x0b\x0c\r")] = _BREAK
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_MIX, _TURN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of all texts in order, small A-Z, and the number of the piece that each lies in."""
    closed = pc.binary_join_element_wise(pc.fill_null(texts, "").cast(pa.large_string()), pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string()))
    raw = closed.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw else np.zeros(0, np.uint8)
    kind = _CLASS[data]
    is_word = kind == _WORD
    edge = np.diff(is_word.view(np.int8), prepend=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)  # every text ends with a break
    piece = np.cumsum(kind == _BREAK, dtype=np.int32)[starts]
    offsets = np.concatenate(([0], np.cumsum(ends - starts)))
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(_LOWER[data[is_word]]))
    return words, piece


def _combine(key: np.ndarray, word: np.ndarray) -> np.ndarray:
    h = (key ^ (key >> np.uint64(29))) * _MIX + word
    return (h ^ (h >> np.uint64(32))) * _TURN


def _within(bits: np.ndarray, key: np.ndarray) -> np.ndarray:
    at = key & np.uint64((1 << SET_BITS) - 1)
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


class Shard:
    """Words of one language in one shard, numbered, with their pieces."""

    def __init__(self, lang: str, words: list[pa.Array], pieces: list[np.ndarray]) -> None:
        coded = pa.chunked_array(words).combine_chunks().dictionary_encode()
        self.lang, self.vocabulary, self.ids = lang, coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        shift = np.cumsum([0, *(p[-1] + 1 if len(p) else 0 for p in pieces[:-1])])
        self.pieces = np.concatenate([p + s for p, s in zip(pieces, shift, strict=True)])

    def hashes(self) -> np.ndarray:
        salt = self.lang + "\0"
        return np.array([xxhash.xxh64_intdigest(salt + w) for w in self.vocabulary.to_pylist()] or [0], np.uint64)

    def levels(self, sets: list[np.ndarray], upto: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, pa.Array | None]]:
        """(length, keys, counts, spelling of phrases) of lengths 2 to ``upto``.

        A phrase is counted only where the phrases of one word less that it begins and ends with are in their length's set,
        and so, by those, all parts of it. ``sets[n - 1]`` is that of length n; with a set for each length, spellings come too.
        """
        word = self.hashes()
        fine = _within(sets[0], word)
        at = np.flatnonzero(fine[self.ids])
        rank, key, spelled = self.ids[at], word, self.vocabulary
        for n in range(2, upto + 1):
            j = np.flatnonzero(np.diff(at) == 1)
            j = j[self.pieces[at[j]] == self.pieces[at[j] + n - 1]]
            start = at[j]
            code = rank[j] * len(word) + self.ids[start + n - 1]
            code, inverse, counts = np.unique(code, return_inverse=True, return_counts=True)
            first, last = code // len(word), code % len(word)
            key = _combine(key[first], word[last])
            whole = len(sets) >= upto
            if whole:
                spelled = pc.binary_join_element_wise(spelled.take(pa.array(first)), self.vocabulary.take(pa.array(last)), pa.scalar(" ", pa.large_string()))
            if n <= len(sets):
                fine = _within(sets[n - 1], key)
                yield n, key[fine], counts[fine], spelled.filter(pa.array(fine)) if whole else None
                kept = fine[inverse]
                at, rank = start[kept], inverse[kept]
            else:
                yield n, key, counts, None


def _slices(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows with texts of about ``most`` words each, by their bytes."""
    upto = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64)) // (most * WORD_BYTES)
    cuts = [0, *(np.flatnonzero(np.diff(upto)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(a, b - a)


def _shards(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[Shard]]:
    """Shards of a task's rows (lang, text): rows until there are ``most`` words, each language by itself."""
    held: dict[str, tuple[list, list]] = {}
    size = 0
    for batch in (part for b in batches for part in _slices(b, most)):
        langs = batch.column("lang").dictionary_encode()
        for code, lang in enumerate(langs.dictionary.to_pylist()):
            words, pieces = tokens(batch.column("text").filter(pc.equal(langs.indices, code)))
            if len(words):
                w, p = held.setdefault(lang, ([], []))
                w.append(words)
                p.append(pieces)
                size += len(words)
        if size >= most:
            yield [Shard(lang, *x) for lang, x in held.items()]
            held, size = {}, 0
    if held:
        yield [Shard(lang, *x) for lang, x in held.items()]


def _rows(**columns: list) -> Iterator[pa.RecordBatch]:
    table = pa.table(columns)
    yield from table.to_batches(max_chunksize=1 << 16)


def local_support(words: int, total: int, support: int) -> int:
    """The least count that is as large a share of ``support`` as the shard is of the language."""
    return max(1, -(-support * words // total))


Step = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _word_counts(most: int) -> Step:
    """Counts of words, and under a null phrase the number of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shards in _shards(batches, most):
            for s in shards:
                n = len(s.vocabulary)
                phrases = pa.concat_arrays([s.vocabulary.cast(pa.string()), pa.nulls(1, pa.string())])
                yield from _rows(lang=pa.array([s.lang] * (n + 1)), phrase=phrases, n=np.concatenate((np.bincount(s.ids, minlength=n), [len(s.ids)])))

    return run


def _mined(sets: list, totals: dict[str, int], support: int, most: int) -> Step:
    """Keys of phrases one word longer than the sets go, where a shard holds its share of the support; and a row with what a shard can hold unseen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, upto = [b.value for b in sets], len(sets) + 1
        for shards in _shards(batches, most):
            for s in shards:
                least = local_support(len(s.ids), totals[s.lang], support)
                yield from _rows(lang=pa.array([s.lang]), key=np.zeros(1, np.int64), n=np.array([least - 1]))
                for n, key, counts, _ in s.levels(known, upto):
                    if n == upto:
                        often = counts >= least
                        yield from _rows(lang=pa.nulls(int(often.sum()), pa.string()), key=key[often].view(np.int64), n=counts[often] - (least - 1))

    return run


def _counted(sets: list, longest: int, most: int) -> Step:
    """Counts of phrases of two words or more that are in the set of their length, by spelling."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [b.value for b in sets]
        for shards in _shards(batches, most):
            for s in shards:
                for n, _, counts, spelled in s.levels(known, longest):
                    yield from _rows(lang=pa.array([s.lang] * len(counts)), phrase=spelled.cast(pa.string()), size=np.full(len(counts), n, np.int32), n=counts)

    return run


def _broadcast_set(keys: DataFrame) -> Broadcast:
    """A set of keys as bits, ored together by Spark: 2^(SET_BITS - 6) rows at most reach the driver."""
    at = F.col("key").bitwiseAND((1 << SET_BITS) - 1)
    parts = keys.groupBy(F.shiftright(at, 6).alias("i")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(key & 63 AS INT))")).alias("b")).toArrow()
    bits = np.zeros(1 << (SET_BITS - 6), np.int64)
    bits[parts["i"].to_numpy()] = parts["b"].to_numpy()
    return keys.sparkSession.sparkContext.broadcast(bits.view(np.uint64))


def phrase_counts(docs: DataFrame, longest: int = LONGEST, support: int = SUPPORT, lang_col: str = "lang", text_col: str = "text", shard_words: int = SHARD_WORDS) -> tuple[DataFrame, DataFrame]:
    """Exact counts (lang, phrase, size, f) of all phrases of 1 to ``longest`` words that occur ``support`` times, and (lang, n) of all words.

    SON partitioning. A shard is a run of a task's rows that fits in memory; it is mined completely, length by length, at the
    support in proportion to its words. What some shard finds frequent is united. Beyond the union, each key's local
    counts are added up, with the most that the shards that did not find it can hold; where even this is short of the
    support, the phrase is out (with shards of less than a thirtieth of a language the local support is 1, and that sum is the count). Then
    one more pass counts what is left by its spelling. Keys are 64-bit hashes that serve for pruning alone: a collision costs
    work, not exactness. The sets of what is in question go to the tasks as bits of a fixed size.
    """
    rows = bound_batches(docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text")))
    words = rows.mapInArrow(_word_counts(shard_words), "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("f"))
    words = cut(words.where(f"phrase is null or f >= {support}"))
    totals = {r["lang"]: r["f"] for r in words.where("phrase is null").collect()}  # a row a language
    salted = F.concat("lang", F.lit("\0"), "phrase")

    @F.pandas_udf("long")
    def word_key(salted: pd.Series) -> pd.Series:
        return pd.Series(np.array([xxhash.xxh64_intdigest(x) for x in salted], np.uint64).view(np.int64))

    sets = [_broadcast_set(words.where("phrase is not null").select(word_key(salted).alias("key")))]
    for _ in range(2, longest + 1):
        found = cut(rows.mapInArrow(_mined(sets, totals, support, shard_words), "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n")))
        unseen = found.where("lang is not null").agg(F.max("n")).first()[0] or 0
        sets.append(_broadcast_set(found.where(F.col("lang").isNull() & (F.col("n") + unseen >= support)).select("key")))
    counted = rows.mapInArrow(_counted(sets, longest, shard_words), "lang string, phrase string, size int, n long").groupBy("lang", "phrase", "size").agg(F.sum("n").alias("f"))
    single = words.where("phrase is not null").select("lang", "phrase", F.lit(1).alias("size"), "f")
    total = words.where("phrase is null").select("lang", F.col("f").alias("n"))
    return cut(counted.where(F.col("f") >= support).unionByName(single)), total


def _exact(c: Column) -> Column:
    return c.cast(DecimalType(28, 0))


def score_cuts(counts: DataFrame, scale: int = 2_000_000) -> DataFrame:
    """(lang, phrase, size, a, k, l, r, score) of phrases of two words or more: the cut with the lowest score, the shorter first part on ties."""
    many = counts.where("size > 1").select("lang", "phrase", "size", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    cuts = many.select("lang", "phrase", "size", "a", "w", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    part = lambda a, n: F.array_join(F.slice("w", a, n), " ")
    cuts = cuts.select("lang", "phrase", "size", "a", "k", part(F.lit(1), F.col("k")).alias("head"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("tail"))
    heads, tails = (counts.select("lang", F.col("phrase").alias(n), F.col("f").alias(x)) for n, x in (("head", "l"), ("tail", "r")))
    both = cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"])
    whole = both.withColumn("x", _exact(F.col("a")) * F.lit(scale)).withColumn("y", _exact(F.col("l")) + _exact(F.col("r")))
    scored = whole.withColumn("score", F.expr("x div y"))  # of whole decimals
    best = scored.groupBy("lang", "phrase", "size", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("m"))
    return best.select("lang", "phrase", "size", "a", "m.k", "m.l", "m.r", "m.score")


def within_longer(counts: DataFrame, share: int = 80) -> DataFrame:
    """(lang, phrase) of phrases that lie inside a longer one with ``share`` hundredths of their count or more."""
    long_ = counts.where("size > 2").select("lang", "size", "f", F.split("phrase", " ").alias("w"))
    cuts = F.expr("flatten(transform(sequence(2, size - 1), n -> transform(sequence(1, size - n + 1), i -> array_join(slice(w, i, n), ' '))))")
    inner = long_.select("lang", "f", F.explode(F.array_distinct(cuts)).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    met = counts.join(inner, ["lang", "phrase"])
    return met.where(_exact(F.col("longer")) * 100 >= _exact(F.col("f")) * share).select("lang", "phrase")


def collocations(docs: DataFrame, longest: int = LONGEST, support: int = SUPPORT, top: int = TOP, lang_col: str = "lang", text_col: str = "text", shard_words: int = SHARD_WORDS) -> DataFrame:
    """The ``top`` collocations of each language: lang, rank, phrase, a, l, r, n, score.

    Texts are split into pieces at ``.,;:!?`` and line ends and those into words at spaces and tabs, small A-Z. Phrases of 2 to
    ``longest`` words within a piece that occur ``support`` times (``a``) are scored by their lowest-scoring cut, floor(2000000 a / (l + r)) with l and r the
    counts of its two sides; those that lie inside a longer frequent phrase with 80 % of their count or more go. Rank
    is by score, then count, then the phrase's bytes.

    A null text counts as empty, a null language as ``und``. Repeated rows and copies all count. Languages without frequent phrases
    have no rows; an empty table gives none. Texts are worked on whole, a very long one as a shard of its own. Other columns are left
    behind. No language, word or phrase is brought into one task: counts are added up in shards before they are shuffled, and of
    the ranking a task sees ``top`` rows at most from each of as many salted groups as there are partitions.
    """
    counts, total = phrase_counts(docs, longest, support, lang_col, text_col, shard_words)
    kept = score_cuts(counts).join(within_longer(counts), ["lang", "phrase"], "left_anti")
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    salt = F.pmod(F.xxhash64("phrase"), F.lit(partitions(docs)))
    first = kept.withColumn("__salt", salt).withColumn("__n", F.row_number().over(Window.partitionBy("lang", "__salt").orderBy(*order))).where(F.col("__n") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(F.broadcast(total), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")  # a row a language
