import hashlib
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from lernwerk.llm import centroids, collocations, decontamination, queries
from lernwerk.llm.common import bound_batches, table
from llm_helpers import SCHEMA, awkward, clashing, empty, rows
from oracle import SMALL, connect, same
from pyspark.sql import functions as F

VECTORS = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("name", ["op11_centroid_clusters", "op12_decontamination", "op13_collocations"])
def test_agrees_with_sql(spark, name):
    same(queries.queries()[name](spark, SMALL), connect(), queries.oracle_sql()[name])


def brute_nearest(v, c):
    d = ((v[:, None].astype(np.int64) - c[None]) ** 2).sum(2)
    order = np.argsort(d, axis=1, kind="stable")  # ties to the smaller number
    return order[:, 0], np.sort(d, axis=1)


@pytest.mark.parametrize(("k", "size"), [(1, 3), (2, 2), (16, 3), (16, 60), (40, 2)])
def test_search_is_exact_over_rounds(k, size):
    rng = np.random.default_rng(k * size)
    v = rng.integers(-size, size, (4000, 4)).astype(np.int32)
    centres = v[rng.choice(len(v), k, replace=False)].astype(np.int64)
    centres[k // 2] = centres[0]  # two centroids in one place
    state = centroids.Search(centres).first(v)
    for _ in range(6):
        near, d = brute_nearest(v, centres)
        assert (state[0] == near).all() and (state[2] * (1 + 1e-9) >= np.sqrt(d[:, 0])).all()
        if k > 1:
            others = np.where(np.arange(k) == near[:, None], np.iinfo(np.int64).max, ((v[:, None].astype(np.int64) - centres[None]) ** 2).sum(2)).min(1)
            assert (state[3] * (1 - 1e-9) <= np.sqrt(others)).all()
        before = centres.copy()
        for j in range(k):
            if (near == j).any():
                centres[j] = v[near == j].astype(np.int64).sum(0) // (near == j).sum()
        state = centroids.Search(centres, before).again(v, *state)


def test_bounds_spare_most_scans():
    rng = np.random.default_rng(4)
    v = (rng.normal(0, 3, (3000, 8)) + 60 * rng.integers(0, 5, (3000, 1))).astype(np.int32)
    centres = v[:12].astype(np.int64)
    search = centroids.Search(centres, centres)
    measured, plain = [], centroids.squared
    centroids.squared = lambda a, b: measured.append(len(a)) or plain(a, b)
    try:
        search.again(v, *centroids.Search(centres).first(v))
    finally:
        centroids.squared = plain
    assert sum(measured) - 12 * (3000 + 12) < 3000  # after the first round, which measures all


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    data = [(1, [1.0, 2.0], 0), (1, [1.0, 2.0], 0), (2, None, 0), (3, [1.0], 0), (4, [nan, 0.0], 0), (5, [inf, 0.0], 0), (6, [None, 1.0], 0), (None, [5.0, 5.0], 1), (7, [-0.01, 0.0], 1), (8, [], 1)]
    df = clashing(spark.createDataFrame(data, VECTORS), ["cluster", "distance", "id", "v"])
    out = centroids.cluster_vectors(df, k=16, dim=2).collect()
    assert Counter(r["vec_id"] for r in out) == {1: 2, None: 1, 7: 1}
    assert {r["inertia"] for r in out} == {0} and {r["cluster"] for r in out if r["vec_id"] == 7} != {r["cluster"] for r in out if r["vec_id"] == 1}
    assert {r["centroid_sha256"] for r in out if r["vec_id"] == 7} == {hashlib.sha256(b"-1,0").hexdigest()}
    none = centroids.cluster_vectors(df.limit(0), dim=2)
    assert none.count() == 0 and none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    with pytest.raises(Exception, match="would not fit"):
        centroids.cluster_vectors(spark.createDataFrame([(1, [1e30, 0.0], 0)], VECTORS), dim=2).collect()


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def ascii_low(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def brute_contamination(docs, items, window=10):
    out = []
    cuts = {}
    for i, t in items:
        w = WORD.findall(ascii_low(t))
        for at in range(max(len(w) - window, 0) + 1 if w else 0):
            cuts.setdefault(tuple(w[at : at + window]), set()).add(i)
    for d, t in docs:
        w, hit, found = WORD.findall(ascii_low(t)), set(), set()
        for p, whose in cuts.items():
            for at in range(len(w) - len(p) + 1):
                if tuple(w[at : at + len(p)]) == p:
                    hit |= set(range(at, at + len(p)))
                    found |= whose
        found.discard(None)
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)))
    return Counter(out)


def test_contamination_on_awkward_tables(spark):
    items = [(1, "one two three four five"), (2, "ONE, two"), (10, "six a b c d e f g h i j k"), (10, "lorem ipsum"), (None, "Äpfel"), (3, None), (4, " .,"), (5, "never in any text"), (6, "one one")]
    more = ["one-two-THREE four_five six", "a b c d e f g h i j", "six a b c d e f g h i", "x a b c d e f g h i j k", "one one one", ".one two.", None] * 2
    docs = awkward(spark).unionByName(spark.createDataFrame(rows(more, 100), SCHEMA))
    table_ = spark.createDataFrame(items, "item_id long, text string")
    out = decontamination.contamination(clashing(docs, ["n_hit", "n_items", "key", "phrase"]), clashing(table_, ["phrase", "length"]))
    names = ["doc_id", *decontamination.RESULTS]
    assert out.columns == [*[c for c in docs.columns], "key", "phrase", *decontamination.RESULTS]
    got = Counter(tuple(r) for r in out.select(*names).collect())
    assert got == brute_contamination([(r["doc_id"], r["text"]) for r in docs.collect()], items)
    assert "Python" not in out._jdf.queryExecution().toString()
    for d, i in ((empty(spark), table_), (docs, table_.limit(0))):
        assert decontamination.contamination(d, i).where("contaminated").count() == 0


def test_contamination_of_small_vocabulary_by_brute_force(spark):
    rng = np.random.default_rng(5)
    docs = [(i, " ".join(rng.choice(list("abc"), rng.integers(0, 60)))) for i in range(60)]
    items = [(i, " ".join(rng.choice(list("abc"), rng.integers(0, 9)))) for i in range(40)]
    out = decontamination.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), window=5)
    assert Counter(tuple(r) for r in out.select("doc_id", *decontamination.RESULTS).collect()) == brute_contamination(docs, items, 5)


@pytest.mark.parametrize("broadcast", [0, 1 << 19])
def test_proximity_matches(spark, broadcast, monkeypatch):
    monkeypatch.setattr(decontamination, "MOST_BROADCAST", broadcast)
    phrases = spark.createDataFrame([("red old house", 3), ("w", 1)], "phrase string, length int")
    docs = spark.createDataFrame([(1, "the red old house"), (2, "red very old house"), (3, "red x x x old house"), (4, "house old red"), (5, "red old"), (6, "W w")], "doc_id long, text string")
    keyed = {r["k"]: r["doc_id"] for r in docs.select("doc_id", decontamination.text_key(F.col("text")).alias("k")).collect()}
    found = lambda slop: {(keyed[r["key"]], h["phrase"], h["exact"]) for r in decontamination.matches(docs, phrases, slop).collect() for h in r["hits"]}
    assert found(0) == {(1, "red old house", True), (6, "w", True)}
    assert found(1) == {(1, "red old house", True), (2, "red old house", False), (6, "w", True)}
    assert (4, "red old house", False) in found(4) - found(2) and 5 not in {d for d, *_ in found(4)}  # house leads; red is four places off


def brute_phrases(docs, support, longest=4):
    f, n = {}, Counter()
    for lang, t in docs:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", ascii_low(t)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, longest + 1):
                f.setdefault((lang or "und", k), Counter()).update(" ".join(w[i : i + k]) for i in range(len(w) - k + 1))
    return {(lang, k, p): c for (lang, k), x in f.items() for p, c in x.items() if c >= support}, n


@pytest.mark.parametrize(("shard", "parts"), [(50, 6), (3000, 2), (1 << 19, 5)])
def test_counts_are_exact_at_every_shard_size(spark, shard, parts):
    rng = np.random.default_rng(6)
    texts = [" ".join(rng.choice(list("abcdefg"), rng.integers(0, 40), p=[0.3, 0.3, 0.1, 0.1, 0.1, 0.05, 0.05])) + rng.choice(["", ".", ", b a b a b a", "\na b\tc  d"]) for _ in range(400)]
    docs = [(["en", "de", None][i % 3], t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(docs, "lang string, text string").repartition(parts)
    counts, total = collocations.phrase_counts(df, support=7, shard_words=shard)
    want, n = brute_phrases(docs, 7)
    assert {(r["lang"], r["size"], r["phrase"]): r["f"] for r in counts.collect()} == want
    assert {r["lang"]: r["n"] for r in total.collect()} == n


def test_local_support_is_a_share():
    assert collocations.local_support(10, 40, 30) == 8 and collocations.local_support(1, 1000, 30) == 1 and collocations.local_support(40, 40, 30) == 30


def test_collocations_on_awkward_tables(spark, tmp_path):
    texts = ["Ab, cd ef! gh\tij kl\x0bmn", "ab cd ef gh ij kl", "Äb ÄB äb"] * 20
    docs = clashing(awkward(spark).unionByName(spark.createDataFrame(rows(texts, 100), SCHEMA)), ["phrase", "n", "rank", "size", "a"])
    docs.where("char_length(text) < 1000 or text is null").write.parquet(str(tmp_path / "documents.parquet"))  # DuckDB's text copies a piece for each of its words
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    same(queries.op13_collocations(spark, str(tmp_path)), con, queries.oracle_sql()["op13_collocations"])
    assert collocations.collocations(empty(spark)).count() == 0
    assert collocations.collocations(docs, top=3).groupBy("lang").count().where("count > 3").count() == 0


def test_scores_past_64_bits(spark):
    big = 1 << 60
    counts = spark.createDataFrame([("x", "a b", 2, big), ("x", "a", 1, big), ("x", "b", 1, big + 5)], "lang string, phrase string, size int, f long")
    assert collocations.score_cuts(counts).first()["score"] == 2_000_000 * big // (2 * big + 5)


def test_batch_size_with_a_unit(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    old = spark.conf.get(name)
    try:
        spark.conf.set(name, "64m")
        bound_batches(table(spark, SMALL, "documents"))
        assert spark.conf.get(name) == str(8 << 20)
    finally:
        spark.conf.set(name, old)
