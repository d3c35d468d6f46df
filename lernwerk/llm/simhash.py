"""SimHash near-duplicates by a byte-position inverted index with count filtering."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import chain, combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import bound_batches, cut, partitions

SEED = 42
BYTES = 8
#: Runs of the index up to this size are compared by shifting the whole sorted index against itself; larger ones
#: singly, in blocks, after a refinement by two more bytes where the distance allows.
SHORT = 512
BLOCK = 1024
LOW = np.uint64(0x7F7F7F7F7F7F7F7F)
#: Links that one task takes in a round of ``components``; a small graph goes through few tasks.
LINKS_A_TASK = 20_000


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash over the XXH64 of word shingles (ASCII case and white space apart)."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths) - 1
    starts = ends - lengths + 1
    n = max(1, len(words) - shingle + 1)
    spans = zip(starts[:n].tolist(), ends[min(shingle, len(words)) - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_digest
    hashes = np.frombuffer(b"".join([digest(joined[a:b], SEED) for a, b in spans]), np.uint8).reshape(n, BYTES)
    return simhash_bits(hashes)


def simhash_bits(hashes: np.ndarray) -> int:
    """The bits that are 1 in over half of the hashes (rows of eight bytes); 0 without any."""
    set_bits = np.zeros(BYTES * 8, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        set_bits += np.unpackbits(hashes[at : at + (1 << 14)], axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_bits > len(hashes)).tobytes(), "big")


@F.pandas_udf(LongType())
def _fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))


_MIX = np.uint64(0xBF58476D1CE4E5B9)


def shingle_digests(text: str | None, words: int = 5) -> np.ndarray:
    """A 64-bit digest of each word shingle of a text, repeats included (ASCII case and white space apart); fewer words are one."""
    split = (text or "").encode().lower().split()
    if not split:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_digest
    h = np.frombuffer(b"".join([digest(w, SEED) for w in split]), ">u8").astype(np.uint64)
    k, n = min(words, len(h)), max(1, len(h) - words + 1)
    s = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            s = (s ^ (s >> np.uint64(29))) * _MIX + h[j : j + n]
    return s


def shared_bytes(xor: np.ndarray) -> np.ndarray:
    """How many of the eight positional bytes two fingerprints share, from their exclusive or."""
    return np.bitwise_count(~((xor & LOW) + LOW | xor | LOW))


class Run:
    """64-bit fingerprints to compare."""

    def __init__(self, values: np.ndarray, distance: int) -> None:
        self.values, self.distance = values, distance

    def part(self, at: np.ndarray) -> Run:
        return Run(self.values[at], self.distance)

    def levels(self) -> list[Run]:
        """The run at each distance whose links are to be taken before those of the next."""
        return [self]

    def bits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.bitwise_count(self.values[a] ^ self.values[b])

    def near(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The count filter, then the verification: enough shared bytes, and few enough differing bits. ``a`` and ``b`` are positions and broadcast."""
        xor = self.values[a] ^ self.values[b]
        out = shared_bytes(xor) >= BYTES - self.distance
        out[out] = np.bitwise_count(xor[out]) <= self.distance
        return out

    def refined(self, used: tuple[int, ...]) -> Iterator[tuple[tuple[int, ...], np.ndarray]]:
        """Smaller runs that hold every link between them, by each choice of two more bytes, if so many are sure to be shared."""
        if len(used) + 2 > BYTES - self.distance:
            return
        octets = self.values.view(np.uint8).reshape(-1, BYTES)
        for a, b in combinations([p for p in range(BYTES) if p not in used], 2):
            key = octets[:, a].astype(np.int64) << 8 | octets[:, b]
            order = np.argsort(key, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
                yield (*used, a, b), at


def links(run: Run, used: tuple[int, ...] = ()) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of positions in a run that join all values linked.

    A spanning set: a component is searched from one value outwards, and one pair is given for
    each value reached. Long runs are refined first, where no link is lost by it.
    """
    n = len(run.values)
    if n > SHORT:
        split = False
        for more, at in run.refined(used):
            split = True
            if len(at) > 1:
                for x, y in links(run.part(at), more):
                    yield at[x], at[y]
        if split:
            return
    todo = np.arange(n)
    while len(todo) > 1:
        frontier, todo = todo[:1], todo[1:]
        while len(frontier) and len(todo):
            now, frontier, left, reached = frontier[:BLOCK], frontier[BLOCK:], [], []
            for at in range(0, len(todo), BLOCK):
                part = todo[at : at + BLOCK]
                close = run.near(now[:, None], part[None, :])
                hit = close.any(0)
                if hit.any():
                    yield now[close[:, hit].argmax(0)], part[hit]
                left.append(part[~hit])
                reached.append(part[hit])
            todo = np.concatenate(left)
            frontier = np.concatenate([frontier, *reached])


def spanning(pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Those of many pairs of positions that join sets not joined before."""
    parent: dict[int, int] = {}

    def find(i: int) -> int:
        while (p := parent.get(i, i)) != i:
            parent[i] = parent.get(p, p)
            i = p
        return i

    kept: list[tuple[int, int]] = []
    for x, y in pairs:
        for i, j in zip(x.tolist(), y.tolist(), strict=True):
            a, b = find(i), find(j)
            if a != b:
                parent[b] = a
                kept.append((i, j))
    found = np.array(kept, np.int64).reshape(-1, 2)
    return found[:, 0], found[:, 1]


def short_links(keys: np.ndarray, run: Run) -> tuple[np.ndarray, np.ndarray]:
    """The same for many short runs at once: values under equal sorted keys, compared at every shift. Closer pairs go first at each level."""
    found = [[] for _ in run.levels()]
    upto = np.array([r.distance for r in run.levels()])
    for shift in range(1, min(SHORT, len(keys))):
        at = np.flatnonzero(keys[:-shift] == keys[shift:])
        if not len(at):
            break
        at = at[run.near(at, at + shift)]
        level = np.searchsorted(upto, run.bits(at, at + shift))
        for k, pairs in enumerate(found):
            if (part := at[level == k]).size:
                pairs.append((part, part + shift))
    return spanning(chain.from_iterable(found))


def _index_keys(distance: int = 3) -> list[tuple[int, ...]]:
    """Sets of byte positions such that any two fingerprints within the distance agree on one of them.

    ``8 - distance`` bytes are shared at least, so (half of that, rounded up) lie within one half:
    triples of either half up to 3 bits, pairs of either half up to 5. Two shared bytes, at 6 bits, can lie anywhere.
    """
    halves = (range(4), range(4, BYTES))
    if distance <= 5:
        return [c for half in halves for c in combinations(half, 3 if distance <= 3 else 2)]
    return list(combinations(range(BYTES), 2))


def _linked_runs(index: DataFrame, run_of: Callable[[np.ndarray], Run], used_of: Callable[[int], tuple[int, ...]] = lambda key: ()) -> DataFrame:
    """``src``, ``dst``, ``bits``: pairs of nodes that join all that are linked in a run of the index (columns key, node, then those of ``run_of``), and in how many bits they differ.

    The index is dealt out and sorted by its key. Runs are compared inside their task, and only a spanning set of links leaves it.
    """

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, len(index_columns)), np.int64)

        def settle(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            k, nodes, run = rows[:, 0], rows[:, 1], run_of(np.ascontiguousarray(rows[:, 2:]).view(np.uint64))
            bounds = np.concatenate(([0], np.flatnonzero(np.diff(k)) + 1, [len(k)]))
            sizes = np.diff(bounds)

            def pairs(x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(nodes[x]), pa.array(nodes[y]), pa.array(run.bits(x, y).astype(np.int32))], ["src", "dst", "bits"])

            for i in np.flatnonzero(sizes > SHORT):
                at = np.arange(bounds[i], bounds[i + 1])
                used = used_of(int(k[bounds[i]]))
                x, y = spanning(chain.from_iterable(links(level, used) for level in run.part(at).levels()))
                yield pairs(at[x], at[y])
            at = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= SHORT), sizes))
            x, y = short_links(k[at], run.part(at))
            yield pairs(at[x], at[y])

        for batch in batches:
            held = np.concatenate((held, np.stack([c.to_numpy() for c in batch.columns], axis=1)))
            if len(held) and held[0, 0] != held[-1, 0]:
                whole = int(np.searchsorted(held[:, 0], held[-1, 0]))  # the last run may go on
                yield from settle(held[:whole])
                held = held[whole:]
        if len(held):
            yield from settle(held)

    index_columns = index.columns
    return index.repartition(partitions(index), "key").sortWithinPartitions("key", "node").mapInArrow(runs, "src long, dst long, bits int")


def near_edges(prints: DataFrame, distance: int = 3) -> DataFrame:
    """``src``, ``dst``: pairs of the distinct long fingerprints ``fp`` that join all near ones.

    An index entry is a set of byte positions with its bytes.
    """
    if distance > 6:
        raise ValueError("two fingerprints of more than 6 differing bits need not share two bytes")
    sets = _index_keys(distance)
    octet = [F.shiftrightunsigned("fp", 8 * p).bitwiseAND(255) for p in range(BYTES)]
    keys = [reduce(lambda k, p: F.shiftleft(k, 8) + octet[p], c, F.lit(j).cast("long")) for j, c in enumerate(sets)]
    width = 8 * len(sets[0])
    index = prints.select(F.explode(F.array(*keys)).alias("key"), F.col("fp").alias("node"), "fp")
    return _linked_runs(index, lambda v: Run(v.ravel(), distance), lambda key: sets[key >> width]).drop("bits")


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``root``: every node of ``edges`` (``src``, ``dst`` longs) with the least node it reaches.

    Alternates large-star and small-star steps until nothing moves, which takes a
    number of rounds that grows with the logarithm of the longest chain. Every
    step is a grouped minimum (combined before its shuffle) and a join that adaptive
    execution splits at a crowded node (the minima are put together anew, so that both sides are shuffled
    for the join); lineage is cut after each round. A round over few links goes through few tasks.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        both = e.unionByName(back).coalesce(n)
        around = both if large else both.where("dst < src")
        least = around.groupBy("src").agg(F.min("dst").alias("m")).select(F.col("src").alias("at"), F.least("m", "src").alias("m"))
        moved = around.join(least.coalesce(n), F.col("src") == F.col("at"))
        if large:
            out = moved.where("dst > src").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
        else:
            out = moved.select(F.col("dst").alias("src"), F.col("m").alias("dst")).unionByName(least.select(F.col("at").alias("src"), F.col("m").alias("dst")))
        return out.where("src <> dst").coalesce(n).distinct()

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.expr("bit_xor(xxhash64(src, dst))")).first())

    now = cut(edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).where("src <> dst").distinct())
    seen = mark(now)
    n = min(partitions(edges), max(2, seen[0] // LINKS_A_TASK))  # one would be no shuffle
    while seen[0]:
        now = cut(star(star(now, True), False))
        if (then := mark(now)) == seen:
            break
        seen = then
    nodes = now.select(F.col("src").alias("node"), F.col("dst").alias("root"))
    return nodes.unionByName(now.select(F.col("dst").alias("node"), F.col("dst").alias("root")).distinct())


def _component_ids(rows: DataFrame, keys: list[str], edges_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``component_id`` of each distinct fingerprint (columns ``keys`` of ``rows``, which has ``__id`` too)."""
    prints = rows.groupBy(*keys).agg(F.min("__id").alias("first"))
    prints = cut(prints.withColumn("node", F.xxhash64(*keys) if len(keys) > 1 else F.col(keys[0])))
    linked = components(edges_of(prints))
    firsts = linked.join(prints.select("node", "first"), "node")
    least = firsts.groupBy("root").agg(F.min("first").alias("component_id"))
    # the minima are dealt out anew: both sides are shuffled for the join, so that a root with very many nodes can be split
    named = linked.join(least.repartition(partitions(rows)), "root").select("node", "component_id")
    return prints.join(named, "node", "left").select(*keys, F.coalesce("component_id", "first").alias("component_id"))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 3, columns: list[str] | None = None) -> DataFrame:
    """Add ``fingerprint`` (16 hex digits) and ``component_id`` to ``columns`` (all by default).

    Fingerprints within ``distance`` bits are linked; ``component_id`` is the
    smallest id that links reach from a document, itself included. Equal
    fingerprints are one node, so copies are never paired. Null and empty texts
    have fingerprint zero, which links like any other. Null ids are passed over; a
    component of nothing but null ids has a null ``component_id``. Repeated rows
    are copies. Input columns named fingerprint or component_id are replaced. An
    empty table gives an empty result.
    """
    docs = bound_batches(docs).drop("fingerprint", "component_id")
    columns = [c for c in columns or docs.columns if c in docs.columns]
    mine = [F.col(c).alias(f"__c{i}") for i, c in enumerate(columns)]
    rows = cut(docs.select(*mine, F.col(id_col).alias("__id"), _fingerprints(F.coalesce(F.col(text_col), F.lit(""))).alias("fp")))
    named = _component_ids(rows, ["fp"], lambda prints: near_edges(prints, distance))
    back = [F.col(f"__c{i}").alias(c) for i, c in enumerate(columns)]
    return rows.join(named, "fp").select(*back, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
