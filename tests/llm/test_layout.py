import zlib
from collections import Counter

import duckdb
import pytest
from lernwerk.llm import histogram, mixing, queries, sharding
from lernwerk.llm.common import table
from llm_helpers import SCHEMA, awkward, clashing, empty
from oracle import SMALL, connect, same
from pyspark.sql import functions as F


def brute_split(rows, targets):
    order = sorted(rows)
    out = []
    for t in targets:
        at = 0
        for k, tie, w in order:
            if at + w > t:
                out.append((k, tie, at, w))
                break
            at += w
    return out


@pytest.mark.parametrize("finish", [1, 3, 2000])
def test_split_points_against_sorting(spark, finish):
    rows = [((i * 2654435761) % (1 << 60), i, i % 9 + 1) for i in range(300)]
    rows += [(1 << 59, 1000 + i * 17, 5) for i in range(200)]  # one crowded key
    df = spark.createDataFrame(rows, "key long, tie long, weight long").cache()
    total = sum(r[2] for r in rows)
    targets = [total * i / 13 for i in range(13)] + [total - 1]
    got = [(s.key, s.tie, s.below, s.weight) for s in histogram.split_points(df, targets, finish=finish)]
    assert got == brute_split(rows, targets)
    assert histogram.split_points(df, [total]) == [] and histogram.split_points(df.limit(0), [0]) == []


def test_shards_are_even_and_gapless(spark):
    got = queries.op4_sharding(spark, SMALL).collect()
    docs = {r["doc_id"]: r["text"] for r in table(spark, SMALL, "documents").collect()}
    assert len(got) == len(docs)
    load, slots, shard_of_text = Counter(), {}, {}
    for r in got:
        raw = (docs[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 16, zlib.crc32(raw), "bytes", None)
        load[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
        shard_of_text.setdefault(raw, set()).add(r["shard"])
    assert set(load) <= set(range(40)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    ideal, largest = sum(load.values()) / 40, max(r["size"] for r in got)
    assert all(abs(v - ideal) <= largest + 0.02 * ideal for v in load.values())
    assert sum(len(s) > 1 for s in shard_of_text.values()) <= 39


def test_a_crowded_text_is_split(spark):
    rows = [(i, "copy of one text" if i % 3 == 0 else f"text {i}", "en", "s", 1) for i in range(3000)]
    out = sharding.shard_by_bytes(spark.createDataFrame(rows, SCHEMA), 8).groupBy("shard").agg(F.sum("size").alias("b")).collect()
    sizes = [r["b"] for r in out]
    assert len(sizes) == 8 and max(sizes) - min(sizes) < 0.05 * max(sizes)


def test_shard_edges(spark):
    out = sharding.shard_by_bytes(clashing(awkward(spark), ["size", "shard", "key"]), 4).collect()
    assert len(out) == 16 and {r["shard"] for r in out} <= set(range(4))
    by = {}
    for r in out:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert sharding.shard_by_bytes(empty(spark), 4).count() == 0
    assert sharding.shard_by_bytes(awkward(spark).limit(1), 4).count() == 1


def test_mixing_against_sql(spark):
    same(queries.op8_mixing(spark, SMALL), connect(), queries.oracle_sql()["op8_mixing"])


def fill(sizes, share=1.5, passes=2):
    """Share by weight, cap, share the excess again until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (3.0, 1.0, 2.0)[i % 3] for i, s in enumerate(order)}
    target, open_ = dict.fromkeys(order, 0.0), set(order)
    left = share * sum(sizes.values())
    while open_ and left > 1e-9:
        w = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / w > passes * sizes[s]]
        if not over:
            for s in open_:
                target[s] = left * weight[s] / w
            break
        for s in over:
            target[s] = passes * sizes[s]
            open_.discard(s)
        left = share * sum(sizes.values()) - sum(target[s] for s in order if s not in open_)
    return target


def test_targets_and_takings(spark):
    docs = table(spark, SMALL, "documents").withColumn("source", F.when(F.col("doc_id") % 17 == 0, None).otherwise(F.col("source")))
    _, mix = mixing.mix_sources(docs)
    rows = mixing.words_taken(mix).collect()
    sizes, taken, target = Counter(), Counter(), {}
    for r in rows:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert 0 <= r["taken"] <= 2 * r["size"] and r["size"] == len((docs_text(docs)[r["id"]] or "").encode().split())
    want = fill(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(want[s])
        assert taken[s] == pytest.approx(target[s], rel=0.03, abs=4)
    again = mixing.words_taken(mixing.mix_sources(docs.repartition(3))[1]).collect()
    assert {(r["id"], r["taken"]) for r in again} == {(r["id"], r["taken"]) for r in rows}


_texts = {}


def docs_text(docs):
    if not _texts:
        _texts.update({r["doc_id"]: r["text"] for r in docs.collect()})
    return _texts


def test_schedule_is_even_at_every_length(spark):
    plan = mixing.plan_blocks(mixing.source_targets(spark.createDataFrame([("a", 9000), ("b", 4000), ("c", 7000)], "source string, source_size long")))
    order = [r["source"] for r in mixing.schedule(plan).orderBy("slot").collect()]
    share = Counter(order)
    for n in range(50, len(order), 37):
        part = Counter(order[:n])
        assert all(abs(part[s] - n * share[s] / len(order)) < 6 for s in share)


@pytest.mark.parametrize("sizes", [{"a": 300, "b": 100}, {"a": 450, "b": 150, "c": 300}, {"a": 100, "b": 100, "c": 100}, {"a": 1, "b": 900, None: 5}, {"a": 7}, {"a": 0, "b": 0}])
def test_targets_where_sources_tie(spark, sizes):
    table_ = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(table_).collect()}
    assert got == pytest.approx(fill(sizes))
    all_twice = {r["source"]: r["target"] for r in mixing.source_targets(table_, share=3.0).collect()}
    assert all_twice == {s: 2 * n for s, n in sizes.items()}
    if sizes == {"a": 300, "b": 100}:
        assert got == {"a": 450, "b": 150}


def test_ties_agree_with_sql(spark, tmp_path):
    words = " ".join(["w"] * 10)
    rows = [(i, words, "a") for i in range(30)] + [(100 + i, words, "b") for i in range(10)]
    docs = spark.createDataFrame([(d, t, "en", s, len(t)) for d, t, s in rows], SCHEMA)
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    same(queries.op8_mixing(spark, str(tmp_path)), con, queries.oracle_sql()["op8_mixing"])


def test_repeated_rows_each_have_a_row(spark):
    rows = [(1, None, "a"), (1, None, "a"), (1, "", "a"), (2, "x y", "a"), (2, "x y", "a"), (None, "", None), (None, "", None)]
    docs = spark.createDataFrame([(d, t, "en", s, 0) for d, t, s in rows], SCHEMA)
    out = mixing.words_taken(mixing.mix_sources(docs)[1]).collect()
    assert len(out) == 7 and sorted((r["id"] or 0, r["size"]) for r in out) == [(0, 0), (0, 0), (1, 0), (1, 0), (1, 0), (2, 2), (2, 2)]


def test_mix_edges(spark):
    rows, mix = mixing.mix_sources(clashing(awkward(spark), ["size", "at", "target", "pass", "block", "mix"]))
    assert rows.count() == 16
    out = mixing.words_taken(mix).collect()
    assert len(out) == 16 and all(r["taken"] <= 2 * r["size"] for r in out)
    assert {r["taken"] for r in out if r["size"] == 0} == {0}
    whole = mixing.mixed_documents(awkward(spark))
    assert whole.columns == awkward(spark).columns and whole.count() > 0
    for df in mixing.mix_sources(empty(spark)):
        assert df.count() == 0
    assert mixing.words_taken(mixing.mix_sources(awkward(spark).where("doc_id in (0, 1, 2)"))[1]).agg(F.sum("taken")).first()[0] == 0
