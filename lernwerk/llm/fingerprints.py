"""Document fingerprints from content-defined chunks."""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, partitions

#: Bytes: no chunk under LEAST (but the last of a text), none over MOST; boundaries are rarer before USUAL than after.
LEAST, USUAL, MOST = 16, 32, 120
STRICT_BITS, EASY_BITS = 6, 3
#: A gear table is drawn from a seed. The rolling hash is 32 bits, moved by two bits a byte, so a boundary depends on the 16 bytes before it.
GEAR = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 32, 256, np.uint64).astype(np.uint32)
DIGEST_BYTES = 6


def boundaries(data: bytes) -> list[int]:
    """Ends of the chunks of ``data``, by normalised gear hashing."""
    n = len(data)
    if n <= LEAST:
        return [n] if n else []
    h = GEAR[np.frombuffer(data, np.uint8)]
    for shift in (1, 2, 4, 8):  # doubling: after each step h covers twice as many bytes
        moved = h.copy()
        moved[shift:] += h[:-shift] << np.uint32(2 * shift)
        h = moved
    top = np.uint32(32)
    easy = np.flatnonzero(h >> (top - np.uint32(EASY_BITS)) == 0) + 1
    strict = (np.flatnonzero(h >> (top - np.uint32(STRICT_BITS)) == 0) + 1).tolist()
    easy = easy.tolist()
    ends, at = [], 0
    find = bisect.bisect_left
    while n - at > LEAST:
        i = find(strict, at + LEAST)
        end = strict[i] if i < len(strict) else n
        if end > at + USUAL:
            j = find(easy, at + USUAL)
            end = min(easy[j] if j < len(easy) else n, at + MOST, n)
        ends.append(end)
        at = end
    if at < n:
        ends.append(n)
    return ends


def fingerprint(text: str | None) -> str:
    """Sorted distinct chunk digests, each followed by the chunk's length, in hex; empty for an empty text."""
    data = (text or "").encode()
    ends = boundaries(data)
    digest, starts = xxhash.xxh64_digest, [0, *ends][:-1]
    return "".join(sorted({digest(data[a:b])[:DIGEST_BYTES].hex() + f"{b - a:02x}" for a, b in zip(starts, ends, strict=True)}))


def chunks(print_: str) -> dict[str, int]:
    """Chunk digests of a fingerprint with their lengths in bytes."""
    width = 2 * DIGEST_BYTES + 2
    return {print_[i : i + width]: int(print_[i + width - 2 : i + width], 16) for i in range(0, len(print_), width)}


def likeness(a: str, b: str) -> float:
    """Containment, weighted by chunk length: the shared bytes over the bytes of the smaller fingerprint.

    Equal fingerprints are 1, those of an empty and another text 0.
    """
    if a == b:
        return 1.0
    x, y = chunks(a), chunks(b)
    least = min(sum(x.values()), sum(y.values()))
    return sum(x[k] for k in x.keys() & y.keys()) / least if least else 0.0


def fingerprint_documents(docs: DataFrame, text_col: str = "text", out_col: str = "fingerprint") -> DataFrame:
    """``docs`` with a fingerprint column (replaced if there); null texts count as empty. Nothing is shuffled."""

    @F.pandas_udf("string")
    def prints(texts: pd.Series) -> pd.Series:
        return texts.map(fingerprint)

    return bound_batches(docs).withColumn(out_col, prints(F.coalesce(F.col(text_col), F.lit(""))))


def spliced(text: str, following: str) -> str:
    """``text`` with its last half replaced by as many of the first code points of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


SPLICED = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_range: int = 256) -> DataFrame:
    """Fingerprint each text, its text spliced with the next document's, and compare.

    The next document is the one before in ``id_col`` order; after the smallest id
    comes the largest. Documents go to ranges of ids, each once, in one exchange; the
    largest row of a range goes to the range above as well, for that range's
    last comparison. Ids are cut into ranges at exact counts of the id column
    alone, of about ``per_range`` rows or, on large tables, as many as give eight ranges a
    partition. Bounds come to the driver, one row a range.

    Null texts count as empty, null ids come after all others. Rows with one id are
    ordered by a hash of the text, and equal rows are one another's next. One
    document is its own next. An empty table gives an empty result. Returns the id
    and the columns of ``SPLICED``.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    bound_batches(docs)
    # a null id sorts below every long
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"))
    place = F.coalesce("id", F.lit(-(2**63)))
    n, lo, hi = rows.agg(F.count("*"), F.min(place), F.max(place)).first()
    if not n:
        return docs.select(F.col(id_col), *[F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in SPLICED.split(", "))]).limit(0)
    count = max(1, min(8 * partitions(docs), -(-n // per_range)))
    marks = [lo]
    if count > 1:
        quantiles = rows.select(F.percentile_approx(place, [i / count for i in range(1, count)], 20 * count)).first()[0]
        marks = sorted({lo, *quantiles})
    spark = docs.sparkSession
    bounds = spark.sparkContext.broadcast(np.array(marks[1:], np.int64))  # at most one entry a range

    @F.pandas_udf("int")
    def range_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds.value, ids.to_numpy(), side="right").astype(np.int32))

    tops = sorted(rows.select(range_of(place).alias("range"), place.alias("place")).groupBy("range").agg(F.max("place")).collect())
    used, top = [r[0] for r in tops], np.array([r[1] for r in tops], np.int64)

    @F.pandas_udf("int")
    def lent_to(ids: pd.Series) -> pd.Series:
        """The range above, for the largest id of a range; below the smallest range lies the largest."""
        i = np.searchsorted(top, ids.to_numpy())
        return pd.Series([used[(j + 1) % len(used)] if j < len(used) and top[j] == v else None for j, v in zip(i, ids, strict=True)], dtype="Int32")

    dealt = (
        rows.select(range_of(place).alias("own"), lent_to(place).alias("above"), place.alias("place"), F.xxhash64("text").alias("mix"), "id", "text")
        .select(F.explode(F.array(F.struct(F.col("own").alias("range"), F.lit(False).alias("lent")), F.struct(F.col("above").alias("range"), F.lit(True).alias("lent")))).alias("to"), "place", "mix", "id", "text")
        .where("to.range is not null")
        .select("to.range", "to.lent", "place", "mix", "id", "text")
        .repartition(partitions(docs), "range")
        .sortWithinPartitions("range", "lent", F.desc("place"), F.desc("mix"))
    )

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: tuple | None = None  # range, id, text, fingerprint: waits for its next
        ended = None

        def row(a: tuple, next_text: str, next_print: str) -> list:
            edited = spliced(a[2], next_text)
            own = fingerprint(edited)
            return [a[1], len(a[2]), hashlib.sha256(edited.encode()).hexdigest(), a[3], own, likeness(a[3], own), likeness(a[3], next_print)]

        for pdf in batches:
            out = []
            for r, is_lent, id_, t in zip(pdf["range"], pdf["lent"], pdf["id"], pdf["text"], strict=True):
                if is_lent and ended == r:
                    continue  # only the first of several rows lent to a range is the next
                now = fingerprint(t)
                if last is not None:
                    out.append(row(last, t, now))
                last = None if is_lent else (r, id_, t, now)
                ended = r if is_lent else ended
            frame = pd.DataFrame(out, columns=["id", *(x.split()[0] for x in SPLICED.split(", "))])
            frame["id"] = frame["id"].astype("Int64")
            yield frame

    return dealt.mapInPandas(compare, f"id long, {SPLICED}").withColumnRenamed("id", id_col)
