"""Exact k-means rounds on integer vectors, with Shallot's search for the nearest centroid."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import delete, scratch

#: Components up to this size have squared distances below 2^63 in 64 dimensions.
MOST_SIZE = 1 << 27
#: Centroids go to every task; so many at most.
MOST_CENTROIDS = 4096
#: Bounds are doubles; they give way by this share before they settle anything.
SLACK = 1e-9


def integers(column: pa.Array, dim: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the vectors with ``dim`` components, all finite, and floor(scale * x) of these."""
    whole = np.flatnonzero(pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False) == dim)
    x = pc.list_flatten(column.take(pa.array(whole))).cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim)
    fine = np.isfinite(x).all(1)
    v = np.floor(scale * x[fine])
    if v.size and np.abs(v).max() > MOST_SIZE:
        raise OverflowError(f"a component is beyond {MOST_SIZE}: squared distances would not fit 64 bits")
    return whole[fine], v.astype(np.int32)


def squared(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = v.astype(np.int64) - c
    return np.einsum("ij,ij->i", d, d)


class Search:
    """Nearest and second nearest centroid of vectors, exactly, ties to the smaller number.

    A vector remembers both, an upper bound of its distance to the first and a lower bound of that to any other.
    Where the bounds (moved by what the centroids moved) don't settle it, the scan starts from the closer of the two
    remembered and runs along that one's neighbours by distance. It ends outside the ball that can still hold a second
    nearest; the ball shrinks with each find. Whatever is inside is compared in integers.
    """

    def __init__(self, centres: np.ndarray, before: np.ndarray | None = None) -> None:
        self.c, k = centres, len(centres)
        self.gap = np.sqrt(np.array([squared(centres, c) for c in centres], np.float64).reshape(k, k))
        own = self.gap.copy()
        np.fill_diagonal(own, -1)
        self.order = np.argsort(own, axis=1, kind="stable")
        np.fill_diagonal(own, np.inf)
        self.half = own.min(1) / 2 if k else np.zeros(0)
        drift = np.zeros(k) if before is None else np.sqrt(squared(centres, before).astype(np.float64))
        self.drift = drift
        self.others = np.array([np.delete(drift, j).max(initial=0) for j in range(k)])

    def first(self, v: np.ndarray) -> tuple[np.ndarray, ...]:
        """Without memory, all centroids are measured."""
        n, most = len(v), np.iinfo(np.int64).max
        near, second = np.zeros(n, np.int32), np.full(n, -1, np.int32)
        d1, d2 = np.full(n, most), np.full(n, most)
        for j, c in enumerate(self.c):
            self._take(np.arange(n), np.full(n, j, np.int32), squared(v, c), near, second, d1, d2)
        return near, second, np.sqrt(d1.astype(float)), self._root(d2)

    @staticmethod
    def _take(rows: np.ndarray, j: np.ndarray, d: np.ndarray, near: np.ndarray, second: np.ndarray, d1: np.ndarray, d2: np.ndarray) -> None:
        """Let centroids ``j`` at ``d`` take the first or the second place of ``rows``."""
        best = (d < d1[rows]) | ((d == d1[rows]) & (j < near[rows]))
        next_ = ~best & ((d < d2[rows]) | ((d == d2[rows]) & (j < second[rows])))
        r = rows[best]
        second[r], d2[r] = near[r], d1[r]
        near[r], d1[r] = j[best], d[best]
        second[rows[next_]], d2[rows[next_]] = j[next_], d[next_]

    @staticmethod
    def _root(d: np.ndarray) -> np.ndarray:
        return np.where(d == np.iinfo(np.int64).max, np.inf, np.sqrt(d.astype(float)))

    def again(self, v: np.ndarray, near: np.ndarray, second: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, ...]:
        near, second = near.copy(), second.copy()
        upper, lower = upper + self.drift[near], lower - self.others[near]
        if len(self.c) == 1:
            return near, second, upper, lower
        open_ = np.flatnonzero(upper * (1 + SLACK) >= np.maximum(lower, self.half[near]) * (1 - SLACK))
        d1 = squared(v[open_], self.c[near[open_]])
        upper[open_] = np.sqrt(d1.astype(float))
        still = upper[open_] * (1 + SLACK) >= np.maximum(lower[open_], self.half[near[open_]]) * (1 - SLACK)
        open_, d1 = open_[still], d1[still]
        a, b, d2 = near[open_], second[open_], squared(v[open_], self.c[second[open_]])
        swap = (d2 < d1) | ((d2 == d1) & (b < a))
        a, b, d1, d2 = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, d2, d1), np.where(swap, d1, d2)
        start, reach, rows = a.copy(), np.sqrt(d1.astype(float)), np.arange(len(open_))
        for place in range(1, len(self.c)):
            j = self.order[start[rows], place]
            inside = self.gap[start[rows], j] <= (reach[rows] + np.sqrt(d2[rows].astype(float))) * (1 + SLACK)
            rows, j = rows[inside], j[inside].astype(np.int32)
            if not len(rows):
                break
            self._take(rows, j, squared(v[open_[rows]], self.c[j]), a, b, d1, d2)
        near[open_], second[open_], upper[open_], lower[open_] = a, b, np.sqrt(d1.astype(float)), np.sqrt(d2.astype(float))
        return near, second, upper, lower


STATE = "v array<int>, cluster int, second int, upper double, lower double"


def _vectors(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    return pc.list_flatten(batch.column("v")).to_numpy(zero_copy_only=False).reshape(-1, dim)


def _assigned(search: Search, dim: int, known: bool, last: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _vectors(batch, dim)
            if known:
                near, second, upper, lower = search.again(v, *(batch.column(n).to_numpy() for n in ("cluster", "second", "upper", "lower")))
            else:
                near, second, upper, lower = search.first(v)
            if last:
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(near, pa.int32()), pa.array(squared(v, search.c[near]))], ["id", "cluster", "distance"])
            else:
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), *map(pa.array, (near, second, upper, lower))], ["id", "v", "cluster", "second", "upper", "lower"])

    return run


def cluster_vectors(df: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding", salt: str = "1:") -> DataFrame:
    """Clusters of the vectors after ``rounds`` rounds of exact integer k-means.

    Vectors with ``dim`` components, none null or non-finite, are kept, as floor(scale * x). The first centroids are the
    ``k`` vectors whose id has the smallest SHA-256 of ``salt`` and id; rows that repeat an id are told apart by their
    components, and null ids come last. Every round's vectors are written to the shared folder with what they remember
    (two centroids, two bounds), packed by Parquet; the round before is deleted then. Between rounds the driver holds
    ``k`` sums and centroids. Every row is worked on alone, so repeated rows and a crowded cluster need nothing special;
    sums are combined before they are shuffled.

    Result, one row a kept vector: the id column, ``cluster``, ``distance`` (squared), ``cluster_inertia``, ``inertia``,
    ``centroid_sha256``. With fewer vectors than ``k`` there are as many centroids; an empty table gives an empty one.
    Other columns are left behind. A component beyond ``MOST_SIZE`` is an error, as distances would not fit a long.
    """
    if k > MOST_CENTROIDS:
        raise ValueError(f"{k} centroids; every task holds all, {MOST_CENTROIDS} at most")
    spark = df.sparkSession
    root = scratch(spark, "centroids")
    kind = dict(df.dtypes)[id_col]

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, v = integers(batch.column("x"), dim, scale)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * dim), pa.array(v.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(rows)), lists], ["id", "v"])

    df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("x")).mapInArrow(kept, f"id {kind}, v array<int>").write.parquet(f"{root}/kept")
    state, path = spark.read.parquet(f"{root}/kept"), f"{root}/kept"
    order = F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256).asc_nulls_last()
    centres = np.array([r["v"] for r in state.orderBy(order, "v").limit(k).select("v").collect()], np.int64).reshape(-1, dim)
    before = None
    for number in range(rounds + 1):
        last = number == rounds
        run = _assigned(Search(centres, before), dim, known=number > 0, last=last)
        state.mapInArrow(run, f"id {kind}, cluster int, distance long" if last else f"id {kind}, {STATE}").write.parquet(f"{root}/round-{number}")
        delete(spark, path)
        path = f"{root}/round-{number}"
        state = spark.read.parquet(path)
        if not last:
            sums = state.groupBy("cluster").agg(F.count("*").alias("n"), *[F.sum(F.get("v", F.lit(i))).alias(f"s{i}") for i in range(dim)]).collect()
            before, centres = centres, centres.copy()
            for r in sums:
                centres[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(dim)]
    spread = {r["cluster"]: r["s"] for r in state.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    rows = [(j, spread.get(j, 0), hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for j, c in enumerate(centres)]
    about = spark.createDataFrame(rows, "cluster int, cluster_inertia long, centroid_sha256 string")
    out = state.join(F.broadcast(about), "cluster")  # a row a centroid
    return out.select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", F.lit(sum(spread.values())).cast("long").alias("inertia"), "centroid_sha256")
