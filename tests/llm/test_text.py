import hashlib
import random

import numpy as np
import pytest
import sentencepiece
from lernwerk.llm import fingerprints, pieces, queries
from lernwerk.llm.common import table
from llm_helpers import awkward, clashing, empty
from oracle import SMALL
from pyspark.sql import functions as F

MODEL = queries.tokenizer_model()


@pytest.fixture(scope="module")
def sp():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_pieces_equal_the_library_on_odd_texts(sp):
    rng = random.Random(1)
    texts = ["", None, " ", "  ", "▁", " ▁ ", "a  b ", "\n\nx", "a▁b", "<s> hi </s>", "a\x00b", "😀 z", "\t a", "x" * 5000]
    texts += ["".join(rng.choice(" ▁aé\n\t😀x.<0>") for _ in range(rng.randint(0, 12))) for _ in range(4000)]
    p = pieces.Pieces(MODEL)
    for t, ids in zip(texts, p.encode(texts), strict=True):
        want = sp.encode(t or "", add_bos=True, add_eos=True)
        assert ids.tolist() == want, t
        assert p.decode(ids) == sp.decode(want), t


def test_decode_equals_the_library_on_any_ids(sp):
    rng = random.Random(3)
    p = pieces.Pieces(MODEL)
    for _ in range(4000):
        ids = [rng.choice([0, 1, 2, 3, 13, 50, 131, 187, 200, 230, 259, 264, 28705, 28728]) for _ in range(rng.randint(0, 8))]
        assert p.decode(np.array(ids, np.int64)) == sp.decode(ids), ids


def test_encode_query_against_the_library(spark, sp):
    got = {r["doc_id"]: r for r in queries.op3_sentencepiece(spark, SMALL).collect()}
    for r in table(spark, SMALL, "documents").collect():
        ids = sp.encode(r["text"] or "", add_bos=True, add_eos=True)
        g = got[r["doc_id"]]
        assert g["n_tokens"] == len(ids)
        assert g["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert g["decoded_sha256"] == hashlib.sha256(sp.decode(ids).encode()).hexdigest()


def test_encode_edges(spark, sp):
    a = clashing(awkward(spark), ["ids", "decoded", "tokens"])
    out = pieces.decode_documents(pieces.encode_documents(a, MODEL), MODEL).collect()
    assert len(out) == 16
    for r in out:
        assert r["ids"] == sp.encode(r["text"] or "", add_bos=True, add_eos=True)
        assert r["decoded"] == sp.decode(r["ids"])
    both = awkward(spark).select("text", pieces.encode_and_decode(F.col("text"), MODEL).alias("c")).select("text", "c.*").collect()
    assert sorted((r["text"] or "", r["ids"], r["decoded"]) for r in both) == sorted((r["text"] or "", r["ids"], r["decoded"]) for r in out)
    assert pieces.encode_documents(empty(spark), MODEL).count() == 0
    nulls = spark.range(1).select(F.lit(None).cast("array<int>").alias("ids"))
    assert pieces.decode_documents(nulls, MODEL).first()["decoded"] is None


def test_chunks_cover_the_text_and_move_with_it():
    rng = random.Random(4)
    for n in (0, 1, 15, 16, 17, 100, 5000):
        data = bytes(rng.randrange(32, 127) for _ in range(n))
        ends = fingerprints.boundaries(data)
        assert ends == sorted(set(ends)) and (ends[-1] if ends else 0) == n
        sizes = np.diff([0, *ends])
        assert (sizes <= fingerprints.MOST).all() and (sizes[:-1] >= fingerprints.LEAST).all()
    text = "".join(rng.choice("abcdefgh ") for _ in range(4000))
    a, b = fingerprints.fingerprint(text), fingerprints.fingerprint("seven more" + text)
    assert fingerprints.likeness(a, b) > 0.95


def test_likeness_bounds():
    f = fingerprints.fingerprint
    assert fingerprints.likeness(f("same text"), f("same text")) == 1.0
    assert fingerprints.likeness(f(""), f(None)) == 1.0 and fingerprints.likeness(f(""), f("x")) == 0.0
    assert fingerprints.likeness(f("x" * 50), f("y" * 50)) == 0.0


def brute_neighbours(rows):
    order = sorted(rows, key=lambda r: -r[0])
    out = {}
    for i, (d, t) in enumerate(order):
        nxt = order[(i + 1) % len(order)][1] or ""
        t = t or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        f, e, x = (fingerprints.fingerprint(s) for s in (t, edited, nxt))
        out[d] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), f, e, fingerprints.likeness(f, e), fingerprints.likeness(f, x))
    return out


@pytest.mark.parametrize("per_range", [256, 7])
def test_neighbours_against_brute_force(spark, per_range):
    docs = table(spark, SMALL, "documents").repartition(5)
    got = {r["doc_id"]: tuple(r)[1:] for r in fingerprints.compare_neighbours(docs, per_range=per_range).collect()}
    assert got == brute_neighbours([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_neighbour_edges(spark):
    a = awkward(spark)
    out = fingerprints.compare_neighbours(clashing(a, ["range", "lent", "place", "id", "fingerprint"]), per_range=2).collect()
    assert len(out) == 16 and sum(r["doc_id"] is None for r in out) == 1
    assert sum(r["doc_id"] == 3 for r in out) == 2
    one = fingerprints.compare_neighbours(a.where("doc_id = 5")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    assert fingerprints.compare_neighbours(empty(spark)).count() == 0
    assert fingerprints.fingerprint_documents(a).where("fingerprint is null").count() == 0
