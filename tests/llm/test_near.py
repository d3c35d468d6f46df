import random
from collections import defaultdict

import numpy as np
from lernwerk.llm import near
from lernwerk.llm.common import table
from lernwerk.llm.simhash import shingle_digests
from llm_helpers import awkward, clashing, empty
from oracle import SMALL


def five_words(text):
    words = (text or "").encode().lower().split()
    return frozenset(b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def alike(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def all_near_pairs(sets):
    """Every pair at 0.8 or more: their rarest shingles must meet, whatever the size of the group or how common the others are."""
    count, first, pairs = defaultdict(int), defaultdict(list), {}
    for s in sets.values():
        for x in s:
            count[x] += 1
    for i, s in sets.items():
        rare = sorted(s, key=lambda x: (count[x], x))[: len(s) - -(-4 * len(s) // 5) + 1]
        for j in {j for x in rare for j in first[x]}:
            if (share := alike(s, sets[j])) >= 0.8:
                pairs[j, i] = share
        for x in rare:
            first[x].append(i)
    return pairs


def test_near_copies_against_all_pairs(spark):
    rng = random.Random(4)
    texts = [r["text"] for r in table(spark, SMALL, "documents").select("text").collect()]
    for t in texts[:40]:  # edits of several sizes
        words = (t or "").split()
        for share in (0.005, 0.01, 0.03, 0.3):
            texts.append(" ".join(w if rng.random() > share else "edited" for w in words))
    got = {r["doc_id"]: r["component_id"] for r in near.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    sets = [five_words(t) for t in texts]
    root = list(range(len(texts)))
    for i, s in enumerate(sets):
        for j in range(i):
            if root[i] != root[j] and alike(s, sets[j]) >= 0.8:
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    assert got == dict(enumerate(root))


def chain_of_copies(n, rng):
    """Each text changes three words of 200 of some text before it, so many pairs are less alike than 0.8."""
    texts = [[f"w{rng.randrange(3000)}" for _ in range(200)]]
    while len(texts) < n:
        words = list(rng.choice(texts[-40:]))
        for at in rng.sample(range(200), 3):
            words[at] = f"w{rng.randrange(3000)}"
        texts.append(words)
    return [" ".join(w) for w in texts]


def test_large_group_stays_whole(spark):
    """A group of hundreds of near copies beside texts that share 0.6 with each other."""
    rng = random.Random(8)
    texts = chain_of_copies(400, rng)
    common = [f"c{i}" for i in range(150)]
    texts += [" ".join(common + [f"u{i}x{k}" for k in range(50)]) for i in range(200)]
    got = {r["doc_id"]: r["component_id"] for r in near.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert {got[i] for i in range(400)} == {0}
    assert all(got[i] == i for i in range(400, 600))


def test_recall_and_precision_of_near_copies(spark):
    """No cut on the size of groups or on how common a shingle is."""
    docs = table(spark, "/root/testdata/sf0.1", "documents").select("doc_id", "text")
    first = {}
    for r in docs.collect():
        if s := five_words(r["text"]):
            first.setdefault(s, r["doc_id"])
    pairs = all_near_pairs({d: s for s, d in first.items()})
    found = {r["doc_id"]: r["component_id"] for r in near.near_copies(docs).collect()}
    assert len(pairs) > 30 and np.mean([found[a] == found[b] for a, b in pairs]) >= 0.99
    groups = defaultdict(set)
    for d in first.values():
        groups[found[d]].add(d)
    joined = {d for ids in groups.values() if len(ids) > 1 for d in ids}
    assert len(joined) > 30 and joined <= {d for pair in pairs for d in pair}


def test_shared_bytes_tell_the_similarity():
    rng = random.Random(7)
    for share in (0.5, 0.8, 0.95):
        a = np.array(rng.sample(range(1 << 62), 1000), np.uint64)
        b = a.copy()
        b[: int(1000 * (1 - share) / (1 + share))] = np.array(rng.sample(range(1 << 62), int(1000 * (1 - share) / (1 + share))), np.uint64)
        x, y = (np.frombuffer(near.byte_print(s)[0], np.uint8) for s in (a, b))
        assert abs((x == y).mean() - share) < 0.12
    octets, keys = near.byte_print(np.unique(shingle_digests("One two  three")))
    again = near.byte_print(np.unique(shingle_digests("one TWO\nthree")))
    assert octets == again[0] and (keys == again[1]).all() and len(keys) == len(set(keys.tolist())) == near.KEYS
    assert near.byte_print(shingle_digests(None))[0] == bytes(near.POSITIONS) and not len(near.byte_print(shingle_digests(" "))[1])


def test_near_copies_edges(spark):
    a = awkward(spark)
    out = near.near_copies(clashing(a, ["fp", "octets", "keys", "first", "node", "root", "component_id", "key", "p"]))
    assert out.count() == a.count() and out.where("lang = 'en'").count() > 0
    rows = {(r["doc_id"], r["text"]): r["component_id"] for r in out.collect()}
    assert rows[1, ""] == rows[0, None] == rows[2, " "] == 0 and rows[4, "ONE"] == rows[3, "one"] == 3 and rows[None, "no id at all"] is None
    assert near.near_copies(empty(spark)).count() == 0


def test_simhash_links_are_candidates(spark):
    """Operator 1's step: equal SimHashes and those within three bits are joined, whatever the index of minima says."""
    bits = {1: 0b1011, 2: 0b1011, 3: 0b1000, 4: 1 << 40 | 0xFFFF00, 5: 0b1011 | 1 << 63}
    rows = spark.createDataFrame([(n, b - (1 << 64) if b >> 63 else b) for n, b in bits.items()], "node long, bits long")
    found = {(r["src"], r["dst"]) for r in near.simhash_pairs(rows).collect()}
    root = {n: n for n in bits}
    for a, b in sorted(found):
        old, new = max(root[a], root[b]), min(root[a], root[b])
        root = {n: new if r == old else r for n, r in root.items()}
    assert root == {1: 1, 2: 1, 3: 1, 4: 4, 5: 1} and all((bits[a] ^ bits[b]).bit_count() <= 3 for a, b in found)
    p = near.byte_print(np.zeros(0, np.uint64))
    text, other = " ".join(f"w{i}" for i in range(400)), " ".join(f"w{i}" for i in range(399))
    octets = [near.byte_print(np.unique(shingle_digests(t)))[0] for t in (text, other)]
    prints = spark.createDataFrame([(1, 7, bytearray(octets[0]), []), (2, 7, bytearray(octets[1]), []), (3, 7, bytearray(p[0]), [])], "node long, bits long, octets binary, keys array<long>")
    texts = spark.createDataFrame([(1, text), (2, other), (3, "")], "node long, text string")
    assert {(r["src"], r["dst"]) for r in near.near_edges(prints, texts).collect() if r["src"] != r["dst"]} == {(2, 1)}


def test_unlike_family_is_not_listed_pair_by_pair(spark, monkeypatch):
    """Hundreds of edits of one text, less alike than 0.8 but for a few pairs: the candidates grow with the texts, not with their square."""
    rng = random.Random(5)
    base = [f"b{i}" for i in range(300)]
    texts = [[f"u{i}x{k}" if k in cut else w for k, w in enumerate(base)] for i in range(240) for cut in [set(rng.sample(range(300), 10))]]
    texts += [[f"again{i}" if k == 7 * i else w for k, w in enumerate(texts[i])] for i in range(20)]
    texts = [" ".join(t) for t in texts]
    held = []
    for name in ("_verified", "_alike"):
        if hasattr(near, name):
            monkeypatch.setattr(near, name, lambda pairs, *a, f=getattr(near, name), **b: held.append(pairs.count()) or f(pairs, *a, **b))
    got = {r["doc_id"]: r["component_id"] for r in near.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    sets, root = [five_words(t) for t in texts], list(range(len(texts)))
    for i, s in enumerate(sets):
        for j in range(i):
            if root[i] != root[j] and alike(s, sets[j]) >= 0.8:
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    assert got == dict(enumerate(root)) and len(set(root)) > 150 and all(root[240 + i] == root[i] for i in range(20))
    assert sum(held) < near.KEYS * len(texts)


def test_rare_pairs_hold_every_pair(spark):
    """Against all pairs of sets of many sizes, with common and rare members, and roots of one and of many nodes."""
    rng = random.Random(6)
    sets, roots = {}, {}
    for family in range(6):
        base = rng.sample(range(1000 * family, 1000 * family + 200), rng.choice((4, 20, 90))) + rng.sample(range(6000, 6020), 5)
        for _ in range(25):
            n = len(sets)
            sets[n] = set(rng.sample(base, len(base) - rng.randrange(1 + len(base) // 6))) | {rng.randrange(7000, 9000) for _ in range(rng.randrange(1 + len(base) // 6))}
            roots[n] = rng.choice((n, 1000 + family, 1000 + family))
    f = defaultdict(int)
    for s in sets.values():
        for x in s:
            f[x] += 1
    words = spark.createDataFrame([(x, n, f[x]) for n, s in sets.items() for x in s if f[x] > 1], "shingle long, node long, f long")
    sized = spark.createDataFrame([(n, roots[n], len(s), sum(f[x] == 1 for x in s)) for n, s in sets.items()], "node long, root long, size int, own long")
    found = {(r["src"], r["dst"]) for r in near.rare_pairs(words, sized).collect()}
    true = {(a, b) for a in sets for b in sets if a < b and roots[a] != roots[b] and alike(sets[a], sets[b]) >= 0.8}
    assert len(true) > 50 and true <= found and all(roots[a] != roots[b] for a, b in found)
