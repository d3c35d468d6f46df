"""SentencePiece encoding and decoding over a table of distinct marked words."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches

MARK = "▁"
CHUNK = re.compile(f"{MARK}+[^{MARK}]*")
#: Code points of text whose words are tabled together.
TABLE_CHARS = 1 << 21


class Pieces:
    """Encodes and decodes texts by distinct words.

    Holds for models in which no piece has a white-space marker after another
    character: then a piece never crosses from one marked word to the next, and a word
    is segmented alike wherever it stands. Checked when a model is opened, as is that
    the model only marks white space and puts one marker before a text.
    """

    def __init__(self, model: str) -> None:
        self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces):
            raise ValueError("this model has pieces that cross a white-space marker")
        if self.sp.encode("A  b ﬁ") != self.sp.encode(f"A{MARK}{MARK}b ﬁ") or self.sp.decode(self.sp.encode(" a  ﬁ ")) != " a  ﬁ ":
            raise ValueError("this model changes texts before it segments them")
        self.bos, self.eos = self.sp.bos_id(), self.sp.eos_id()
        self.lone = self.sp.piece_to_id(MARK)
        self.piece_bytes = [self._bytes(i, p) for i, p in enumerate(pieces)]
        self.marked = [p.startswith(MARK) for p in pieces]
        self.plain = np.array([b is not None for b in self.piece_bytes])

    def _bytes(self, i: int, piece: str) -> bytes | None:
        """What a piece adds to a decoded text; None where that depends on its neighbours."""
        if self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_unused(i):
            return None
        if self.sp.is_byte(i):
            return bytes([int(piece[3:5], 16)])
        return piece.replace(MARK, " ").encode()

    def _words(self, texts: list[str | None]) -> pa.ListArray:
        """Marked words of each text, without their first marker (which the library puts back)."""
        odd = [bool(t) and ("  " in t or MARK in t or t[0] == " ") for t in texts]
        if not any(odd):
            words = pc.split_pattern(pa.array([t or "" for t in texts], pa.large_string()), " ")
            return pc.if_else(pa.array([bool(t) for t in texts]), words, pa.scalar([], words.type)) if not all(texts) else words
        return pa.array([[c[1:] for c in CHUNK.findall(MARK + t.replace(" ", MARK))] if t else [] for t in texts], pa.list_(pa.large_string()))

    def encode(self, texts: Iterable[str | None]) -> list[np.ndarray]:
        """Ids of each text, begin and end ids included."""
        words = self._words(list(texts))
        flat = words.flatten().dictionary_encode()
        distinct = flat.dictionary.to_pylist()
        table = self.sp.encode(distinct) if distinct else []
        if "" in distinct:
            table[distinct.index("")] = [self.lone]
        lengths = np.fromiter(map(len, table), np.int64, len(table))
        values = np.fromiter(chain.from_iterable(table), np.int32, int(lengths.sum()))
        starts = np.cumsum(lengths) - lengths
        at = flat.indices.to_numpy()
        n = lengths[at]
        ends = np.cumsum(n)
        # position of every id: the start of its word's ids plus its place among them
        ids = values[np.repeat(starts[at] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)]
        upto = np.concatenate(([0], np.cumsum(pc.list_value_length(words).to_numpy(zero_copy_only=False), dtype=np.int64)))
        cut = np.concatenate(([0], ends))[upto]
        bos, eos = np.array([self.bos], np.int32), np.array([self.eos], np.int32)
        return [np.concatenate((bos, ids[a:b], eos)) for a, b in zip(cut[:-1], cut[1:], strict=True)]

    def decode(self, ids: np.ndarray) -> str:
        """The library's decode(ids)."""
        inner = ids[int(ids[0] == self.bos) : len(ids) - int(ids[-1] == self.eos)] if len(ids) else ids
        if len(inner) and self.plain[inner].all():
            joined = b"".join(map(self.piece_bytes.__getitem__, inner.tolist()))
            try:
                text = joined.decode()
            except UnicodeDecodeError:
                return self.sp.decode(ids.tolist())
            # one marker at the start was put there by the encoder
            return text[1:] if self.marked[inner[0]] else text
        return self.sp.decode(ids.tolist())


_open: dict[str, Pieces] = {}


def _pieces(model: str) -> Pieces:
    if model not in _open:
        _open[model] = Pieces(model)
    return _open[model]


def _tables(texts: pd.Series) -> Iterator[list[str | None]]:
    """Runs of texts of about ``TABLE_CHARS`` together; a longer text stands alone."""
    part: list[str | None] = []
    size = 0
    for t in texts:
        part.append(t)
        size += len(t) if t else 0
        if size >= TABLE_CHARS:
            yield part
            part, size = [], 0
    if part:
        yield part


def encode(text: Column, model: str) -> Column:
    """Ids of ``text`` as the library gives them with begin and end ids; null counts as empty.

    Inside a task, the marked words of about two million characters at a time form a
    table of distinct words; each is segmented once, and the ids come back by
    position. Empty texts have the begin and end id alone. Every row is worked on by itself, so repeated rows have equal
    ids and an empty table gives none; a very long text has a table of its own.
    """

    @F.pandas_udf("array<int>")
    def ids(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        p = _pieces(model)
        for s in texts:
            yield pd.Series([x for part in _tables(s) for x in p.encode(part)], dtype=object)

    return ids(text)


def decode(ids: Column, model: str) -> Column:
    """The library's text for ``ids``; null ids give null, no ids an empty text."""

    @F.pandas_udf("string")
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        p = _pieces(model)
        for s in batches:
            yield pd.Series([None if x is None else p.decode(np.asarray(x, np.int64)) for x in s], dtype=object)

    return texts(ids)


def encode_and_decode(text: Column, model: str) -> Column:
    """``ids`` and ``decoded``, the text that they spell, in one pass: one Python worker a task in place of two."""

    @F.pandas_udf("ids array<int>, decoded string")
    def both(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        p = _pieces(model)
        for s in texts:
            ids = [x for part in _tables(s) for x in p.encode(part)]
            yield pd.DataFrame({"ids": ids, "decoded": [p.decode(x.astype(np.int64)) for x in ids]})

    return both(text)


def encode_documents(docs: DataFrame, model: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with an array column of ids; a column of that name is replaced. Nothing is shuffled. Odd rows are as in ``encode``."""
    return bound_batches(docs).withColumn(ids_col, encode(F.col(text_col), model))


def decode_documents(docs: DataFrame, model: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``docs`` with the text that its ids spell; a column of that name is replaced."""
    return bound_batches(docs).withColumn(text_col, decode(F.col(ids_col), model))


def digests(ids: Column, model: str) -> Column:
    """``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of an id array, for comparing whole corpora."""

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        p = _pieces(model)
        for s in batches:
            arrays = [np.asarray(x, "<u4") for x in s]
            yield pd.DataFrame(
                {
                    "n_tokens": [len(a) for a in arrays],
                    "ids_sha256": [hashlib.sha256(a.tobytes()).hexdigest() for a in arrays],
                    "decoded_sha256": [hashlib.sha256(p.decode(a.astype(np.int64)).encode()).hexdigest() for a in arrays],
                }
            )

    return digest(ids)
