import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from lernwerk.llm import exact, queries, simhash
from lernwerk.llm.common import table
from llm_helpers import SCHEMA, awkward, clashing, empty
from oracle import SMALL, connect, same
from pyspark.sql import functions as F


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, prints, distance=3):
    parent = list(range(len(ids)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                parent[find(i)] = find(j)
    least = defaultdict(lambda: None)
    for i, d in enumerate(ids):
        r = find(i)
        if d is not None and (least[r] is None or d < least[r]):
            least[r] = d
    return [least[find(i)] for i in range(len(ids))]


def test_fingerprint_is_sparks_hash(spark):
    text = "the quick brown"
    spark_hash = spark.range(1).select(F.xxhash64(F.lit(text)).alias("h")).first()["h"]
    assert simhash.fingerprint(text) == spark_hash % (1 << 64)
    for t in (None, "", "a", "a b", "A B", "x y z w", "é è ê ç", "a\x0bb c d e"):
        assert simhash.fingerprint(t) == plain_fingerprint(t)


def test_simhash_against_all_pairs(spark):
    docs = table(spark, SMALL, "documents")
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op1_simhash(spark, SMALL).collect()}
    data = docs.select("doc_id", "text").collect()
    prints = [plain_fingerprint(r["text"]) for r in data]
    want = plain_components([r["doc_id"] for r in data], prints)
    assert got == {r["doc_id"]: (f"{p:016x}", c) for r, p, c in zip(data, prints, want, strict=True)}


@pytest.mark.parametrize(("distance", "used"), [(3, (5, 6, 7)), (5, (6, 7)), (6, (6, 7))])
@pytest.mark.parametrize("short", [8, 512, 5000])
def test_links_lose_nothing_in_dense_runs(monkeypatch, distance, used, short):
    monkeypatch.setattr(simhash, "SHORT", short)
    rng = random.Random(5)
    values = {rng.getrandbits(64)}
    for _ in range(700):  # a ball, chains off it and far values, all in one run
        v = rng.choice(tuple(values))
        for _ in range(rng.randint(1, 7)):
            v ^= 1 << rng.randrange(24)
        values.add(v)
    values = np.array(sorted(values), np.uint64)
    if short == 5000:
        found = [simhash.short_links(np.zeros(len(values), np.int64), simhash.Run(values, distance))]
    else:
        found = [simhash.spanning(simhash.links(simhash.Run(values, distance), used))]
    pairs = [(int(x), int(y)) for a, b in found for x, y in zip(a, b, strict=True)]
    assert all(int(values[a] ^ values[b]).bit_count() <= distance for a, b in pairs)
    parent = list(range(len(values)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in pairs:
        parent[find(a)] = find(b)
    want = plain_components(list(range(len(values))), [int(v) for v in values], distance)
    assert len({find(i) for i in range(len(values))}) == len(set(want))
    assert len({(find(i), want[i]) for i in range(len(values))}) == len(set(want))


def test_shared_bytes():
    rng = random.Random(8)
    for _ in range(500):
        x = rng.getrandbits(64) & rng.choice([0xFFFFFFFFFFFFFFFF, 0xFF00FF00FF0000FF, 0, 0x0100800000FF0001])
        assert int(simhash.shared_bytes(np.array([x], np.uint64))[0]) == sum(b == 0 for b in x.to_bytes(8, "little"))


@pytest.mark.parametrize("distance", [1, 3, 4, 5, 6])
def test_every_close_pair_shares_an_index_key(distance):
    rng = random.Random(2)
    keys = simhash._index_keys(distance)
    for _ in range(3000):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), distance):
            b ^= 1 << bit
        x, y = a.to_bytes(8, "little"), b.to_bytes(8, "little")
        assert any(all(x[p] == y[p] for p in k) for k in keys)


def test_wider_distance_against_all_pairs(spark):
    docs = table(spark, SMALL, "documents")
    data = docs.select("doc_id", "text").collect()
    want = plain_components([r["doc_id"] for r in data], [plain_fingerprint(r["text"]) for r in data], 6)
    got = {r["doc_id"]: r["component_id"] for r in simhash.simhash_components(docs, distance=6).collect()}
    assert got == dict(zip([r["doc_id"] for r in data], want, strict=True))


def test_components_of_a_long_chain(spark):
    edges = spark.range(300).select((F.col("id") * 7919 % 301).alias("src"), ((F.col("id") + 1) * 7919 % 301).alias("dst"))
    got = simhash.components(edges)
    assert {r["root"] for r in got.collect()} == {0} and got.count() == 301
    assert simhash.components(edges.limit(0)).count() == 0


def test_simhash_edges(spark):
    a = awkward(spark)
    out = simhash.simhash_components(clashing(a, ["fp", "first", "node", "root", "component_id", "key"]))
    assert out.count() == a.count()
    got = {(r["doc_id"], r["text"]): (r["fingerprint"], r["component_id"]) for r in out.collect()}
    assert got[(0, None)] == got[(1, "")] == ("0" * 16, 0)
    assert got[(4, "ONE")][1] == got[(3, "one")][1] == 3 and got[(6, "one two three four five")][1] == 5
    assert got[(None, "no id at all")][1] is None
    assert simhash.simhash_components(empty(spark)).count() == 0


def test_exact_against_sql(spark):
    same(queries.op5_exact_dedup(spark, SMALL), connect(), queries.oracle_sql()["op5_exact_dedup"])


def test_exact_edges(spark):
    out = exact.exact_dedup(clashing(awkward(spark), ["kept", "group_size", "h"]), keep="max").collect()
    assert len(out) == 16
    at = {(r["doc_id"], r["text"]): r for r in out}
    assert at[(1, "")]["kept"] and not at[(0, None)]["kept"] and at[(0, None)]["keep_id"] == 1
    assert at[(4, "ONE")]["group_size"] == 3 and at[(4, "ONE")]["kept"] and not at[(3, "one")]["kept"]
    assert at[(7, "Äpfel äpfel")]["text_sha256"] == hashlib.sha256("Äpfel äpfel".encode()).hexdigest()
    assert at[(None, "no id at all")]["kept"] and at[(None, "no id at all")]["keep_id"] is None
    assert exact.exact_dedup(empty(spark)).count() == 0


def test_exact_survives_hash_collisions(spark):
    docs = spark.createDataFrame([(i, f"text {i % 40}", "en", "s", 1) for i in range(400)], SCHEMA)
    weak = exact.exact_dedup(docs, content_hash=lambda c: F.substring(F.md5(c), 1, 1))
    assert {(r["doc_id"], r["keep_id"], r["group_size"]) for r in weak.collect()} == {(i, i % 40, 10) for i in range(400)}


def test_native_plan_has_no_python(spark):
    for name in ("op5_exact_dedup", "op8_mixing"):
        plan = queries.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
        assert not any(w in plan for w in ("Python", "Pandas", "Arrow", "CartesianProduct"))
