"""Near copies by five-word shingles: operator 1's SimHash links and an inverted index of positional bytes with count filtering, both verified before any link is dropped.

Operator 1's three differing bits tell few of the pairs at a similarity of 0.8, so a second print finds the rest. Its prints are the bytes of 256 minima of a text's shingles, not SimHash bits: two texts share a byte at a position as
often as they share shingles, so a count of shared bytes tells the similarity, and six minima together are a key that
unlike texts do not share, however many there are.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from .common import bound_batches, cut
from .simhash import _component_ids, components, shingle_digests, simhash_bits
from .simhash import near_edges as simhash_edges

#: Positions (bytes) of a print, and the index: 24 keys of six positions each find a pair at a similarity of 0.8 in all but 7 of 10,000 cases.
POSITIONS, KEY_POSITIONS, KEYS = 256, 6, 24
LEAST_ALIKE = 0.8
#: At a similarity of 0.8 some 205 bytes are shared, with a deviation of 6.4. From ``LEAST_BYTES`` on a pair is held against its
#: shingles (4.5 deviations below), from ``SURE_BYTES`` on it is taken as it is (5.5 above).
LEAST_BYTES, SURE_BYTES = 176, 240
_MIX, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_SEEDS = np.arange(1, POSITIONS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def byte_print(digests: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Bytes of the minima of a set of shingle digests, and the index keys; zeros and no keys for an empty set."""
    if not len(digests):
        return bytes(POSITIONS), np.zeros(0, np.int64)
    least = np.full(POSITIONS, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(digests), 2048):
            v = (digests[at : at + 2048, None] ^ _SEEDS) * _MIX
            v = (v ^ (v >> np.uint64(32))) * _MIX2
            least = np.minimum(least, v.min(0))
        keys = np.arange(KEYS, dtype=np.uint64)
        for column in least[: KEYS * KEY_POSITIONS].reshape(KEYS, KEY_POSITIONS).T:
            keys = (keys ^ (keys >> np.uint64(29))) * _MIX + column
        octets = ((least ^ (least >> np.uint64(29))) * _MIX >> np.uint64(56)).astype(np.uint8)
    return octets.tobytes(), keys.view(np.int64)


@F.pandas_udf(StructType([StructField("fp", LongType()), StructField("bits", LongType()), StructField("octets", BinaryType()), StructField("keys", ArrayType(LongType()))]))
def _prints(texts: pd.Series) -> pd.DataFrame:
    found = []
    for t in texts:
        digests = np.unique(shingle_digests(t))
        fp = np.uint64(xxhash.xxh64_intdigest(digests.tobytes())).astype(np.int64)
        bits = np.uint64(simhash_bits(digests.byteswap().view(np.uint8).reshape(-1, 8))).astype(np.int64)
        found.append((int(fp), int(bits), *byte_print(digests)))
    return pd.DataFrame(found, columns=["fp", "bits", "octets", "keys"])


@F.pandas_udf(ArrayType(LongType()))
def _shingle_sets(texts: pd.Series) -> pd.Series:
    return pd.Series([np.unique(shingle_digests(t)).view(np.int64) for t in texts], dtype=object)


@F.pandas_udf(IntegerType())
def shared_bytes(a: pd.Series, b: pd.Series) -> pd.Series:
    """How many positional bytes two prints share."""
    x, y = (np.frombuffer(b"".join(s), np.uint8).reshape(-1, POSITIONS) for s in (a, b))
    return pd.Series((x == y).sum(1, dtype=np.int32))


def _pair(a: str, b: str) -> list:
    return [F.least(a, b).alias("src"), F.greatest(a, b).alias("dst")]


def _alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs whose shingles are alike."""
    both = pairs.select("src", "dst")
    for end in ("src", "dst"):
        both = both.join(sets.select(F.col("node").alias(end), F.col("shingles").alias(f"{end}_set")), end)
    common = F.size(F.array_intersect("src_set", "dst_set"))
    return both.where(common >= LEAST_ALIKE * (F.size("src_set") + F.size("dst_set") - common)).select("src", "dst")


def _verified(pairs: DataFrame, prints: DataFrame, sets: DataFrame) -> DataFrame:
    """``src``, ``dst``: the pairs that are near copies, by the count of shared bytes and, where it leaves it open, by their shingles."""
    ends = pairs
    for end in ("src", "dst"):
        ends = ends.join(prints.select(F.col("node").alias(end), F.col("octets").alias(f"{end}_octets")), end)
    counted = cut(ends.select("src", "dst", shared_bytes("src_octets", "dst_octets").alias("shared")).where(F.col("shared") >= LEAST_BYTES))
    return counted.where(F.col("shared") >= SURE_BYTES).select("src", "dst").unionByName(_alike(counted.where(F.col("shared") < SURE_BYTES), sets))


def simhash_pairs(prints: DataFrame) -> DataFrame:
    """``src``, ``dst``: pairs of nodes that join all whose SimHashes (``bits``) differ in three bits or fewer, as operator 1 links them.

    The least node of equal SimHashes stands for them.
    """
    leads = cut(prints.groupBy("bits").agg(F.min("node").alias("lead")))
    equal = prints.select("bits", "node").join(leads, "bits").where("node <> lead").select(*_pair("node", "lead"))
    linked = simhash_edges(leads.select(F.col("bits").alias("fp")))
    for end in ("src", "dst"):
        linked = linked.join(leads.select(F.col("bits").alias(end), F.col("lead").alias(f"{end}_lead")), end)
    return equal.unionByName(linked.select(*_pair("src_lead", "dst_lead"))).distinct()


def rare_pairs(words: DataFrame, sized: DataFrame) -> DataFrame:
    """``src``, ``dst``: candidates that hold every pair of different roots with a similarity of 0.8; no pair is left out, whatever the size of a group.

    ``words`` (shingle, node, f) are the shingles that several nodes hold and how many do, ``sized`` (node, root, size, own) the nodes with the number
    of their shingles and of those that no other node holds. Shingles are ranked from the rarest on, and ``rest`` counts those of a
    text from a shingle on. Two texts share nothing before their first common shingle, so there both rests hold all that they share:
    four fifths of either text at least, and four ninths of both sizes. Members of the root that most hold a shingle are not held against each other.
    """
    ranked = words.join(sized, "node").groupBy("node", "root", "size", "own").agg(F.array_sort(F.collect_list(F.struct("f", "shingle"))).alias("ranked"))
    entries = ranked.select("node", "root", "size", "own", F.posexplode("ranked").alias("at", "word")).withColumn("rest", F.col("size") - F.col("own") - F.col("at"))
    entries = cut(entries.where("5 * rest >= 4 * size").select(F.col("word.shingle").alias("shingle"), "node", "root", "size", "rest"))
    by_root = entries.groupBy("shingle", "root").agg(F.count("*").alias("n"), F.min("size").alias("least"), F.max(F.expr("9 * rest - 4 * size")).alias("most"))
    shared = by_root.groupBy("shingle").agg(F.count("*").alias("roots"), F.max_by("root", F.struct("n", "root")).alias("main"), F.min("least").alias("least"), F.max("most").alias("most"))
    met = cut(entries.join(shared.where("roots > 1"), "shingle").where("9 * rest - 4 * size >= 4 * least and 4 * size <= most").select(*entries.columns, "main"))
    other = met.where("root <> main").select("shingle", *[F.col(c).alias(f"other_{c}") for c in ("node", "root", "size", "rest")])
    once = (F.col("root") == F.col("main")) | (F.col("node") < F.col("other_node"))
    enough = 9 * F.least("rest", "other_rest") >= 4 * (F.col("size") + F.col("other_size"))
    return met.join(other, "shingle").where((F.col("root") != F.col("other_root")) & once & enough).select(*_pair("node", "other_node")).distinct()


def near_edges(prints: DataFrame, texts: DataFrame) -> DataFrame:
    """``src``, ``dst``: links that join all near copies among ``prints`` (node, bits, octets, keys); ``texts`` has node and text.

    Pairs that operator 1's SimHash links are candidates, and so are pairs of the index. Nodes that share a key are a group. One leader of each group
    is held against its members: that with the least share of shingles that no other node of a group holds, since it is nearest to the text that the
    others were made from. Whatever then is of one component in a group needs no further look. The nodes of groups still apart are held
    against each other by their rare shingles (``rare_pairs``). So no pair found by the index is lost, and no group is listed pair by pair.
    """
    index = prints.select(F.explode("keys").alias("key"), "node")
    groups = cut(index.join(index.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key"))
    simple = cut(simhash_pairs(prints))
    met = groups.select("node").unionByName(simple.select(F.explode(F.array("src", "dst")).alias("node"))).distinct()
    held = texts.join(met, "node", "left_semi").groupBy("node").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    sets = cut(held.select("node", _shingle_sets("text").alias("shingles")))
    twos, crowded = groups.where("n = 2").groupBy("key").agg(F.min("node").alias("src"), F.max("node").alias("dst")).select("src", "dst"), groups.where("n > 2")
    inside = sets.join(crowded.select("node").distinct(), "node", "left_semi")
    words = inside.select("node", F.explode("shingles").alias("shingle"))
    counts = cut(words.groupBy("shingle").agg(F.count("*").alias("f"), F.min("node").alias("node")))
    own = counts.where("f = 1").groupBy("node").agg(F.count("*").alias("own"))
    sized = cut(inside.select("node", F.size("shingles").alias("size")).join(own, "node", "left").select("node", "size", F.coalesce("own", F.lit(0)).alias("own")))
    crowded = cut(crowded.join(sized, "node").select("key", "node", (F.col("own") / F.col("size")).alias("share")))
    leads = crowded.groupBy("key").agg(F.min_by("node", F.struct("share", F.xxhash64("key", "node"))).alias("lead"))
    led = crowded.join(leads, "key").where("node <> lead").select(*_pair("node", "lead"))
    roots = cut(components(_verified(cut(led.unionByName(twos).unionByName(simple).distinct()), prints, sets)))
    edges = roots.select(F.col("node").alias("src"), F.col("root").alias("dst"))
    named = crowded.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    apart = named.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    left = cut(named.join(apart, "key", "left_semi").select("node", "root").distinct().join(sized, "node").where("5 * (size - own) >= 4 * size"))
    if left.isEmpty():
        return edges
    words = words.join(left.select("node"), "node", "left_semi").join(counts.where("f > 1").select("shingle", "f"), "shingle")
    return edges.unionByName(_alike(cut(rare_pairs(words, left)), sets))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Add ``component_id``: the smallest id that links between near copies reach from a document, itself included.

    Two texts are near copies if they share 0.8 or more of the union of their five-word shingles (ASCII case and white space apart). Texts of
    fewer than five words are one shingle, so they link only if equal. Texts with the same set of shingles are one node, so copies are
    never paired. Null and empty texts have no shingles and are copies of each other. Null ids are passed over; a component of
    nothing but null ids has a null ``component_id``. Repeated rows are copies. An input column named component_id
    is replaced. An empty table gives an empty result.
    """
    docs = bound_batches(docs).drop("component_id")
    mine = docs.select(*[F.col(c).alias(f"__c{i}") for i, c in enumerate(docs.columns)], F.col(id_col).alias("__id"), _prints(F.coalesce(F.col(text_col), F.lit(""))).alias("p"))
    rows = cut(mine.select("*", "p.*").drop("p"))
    prints = cut(rows.groupBy(F.col("fp").alias("node")).agg(F.first("bits").alias("bits"), F.first("octets").alias("octets"), F.first("keys").alias("keys")))
    texts = rows.select(F.col("fp").alias("node"), F.col(f"__c{docs.columns.index(text_col)}").alias("text"))
    named = _component_ids(rows, ["fp"], lambda _: near_edges(prints, texts))
    return rows.join(named, "fp").select(*[F.col(f"__c{i}").alias(c) for i, c in enumerate(docs.columns)], "component_id")
