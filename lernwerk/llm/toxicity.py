"""Toxic spans and scores from a linear-chain conditional random field."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TRIM = ".,;:!?\"'()[]{}%&*$#|<>-_"
#: Labelled documents of either class that fit the model, at most: those first by a hash of the id.
FIT_ROWS = 1500
SEGMENT = 48
RATE, DECAY = 2.0, 1e-4
#: The fit ends when so many rounds have raised the training rows' likelihood by less than this share, or after the most rounds.
PATIENCE, TOLERANCE, MOST_ROUNDS = 20, 5e-3, 2000
#: Bytes of text that fit the model, at most; texts come in the order of a hash until they are reached.
FIT_BYTES = 128 << 20
#: A word is taken for offending where at least so many toxic documents hold it, in so many times the share of others, and where
#: the log likelihood of that split over a split by chance reaches a level. Levels are tried on folds of the training texts.
LEAST_COUNT, LEAST_ODDS = 3, 20.0
LEVELS, FOLDS = (20.0, 15.0, 12.0, 10.0, 8.0, 6.0), 5
RUN_CHARS = 1 << 23
SPAN_MARGINAL = 0.5


def tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Lengths of the texts in words, the number of each word's normal form, and the forms."""
    words = pc.ascii_split_whitespace(pa.array([t or "" for t in texts], pa.large_string()))
    flat = words.flatten()
    keep = pc.not_equal(flat, "")
    owner = np.repeat(np.arange(len(texts)), pc.list_value_length(words).to_numpy(zero_copy_only=False))[keep.to_numpy(zero_copy_only=False)]
    spelled = flat.filter(keep).dictionary_encode()
    forms = pc.utf8_trim(pc.utf8_lower(spelled.dictionary), characters=TRIM).dictionary_encode()
    numbers = forms.indices.to_numpy()[spelled.indices.to_numpy()] if len(spelled) else np.zeros(0, np.int64)
    return np.bincount(owner, minlength=len(texts)), numbers.astype(np.int64), forms.dictionary.to_pylist()


def _digests(forms: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(f) for f in forms], np.uint64)


class Crf:
    """Two states, plain and toxic. Features: the word and its two neighbours; one weight for each pair of states.

    Words are those met in training, found by their whole digest; all others are feature 0, without a
    weight. Hashing words into buckets would let a rare word share an offending one's weight.
    """

    def __init__(self, vocabulary: np.ndarray | None = None) -> None:
        self.vocabulary = np.zeros(0, np.uint64) if vocabulary is None else np.unique(vocabulary)
        self.words = np.zeros((3, len(self.vocabulary) + 1))  # before, at, after
        self.bias = -3.0
        self.steps = np.zeros((2, 2))  # from, to
        self.document = np.array([-3.0, 4.0, 1.0])  # bias, most certain word, expected words

    def features(self, numbers: np.ndarray, forms: list[str]) -> np.ndarray:
        """The feature of each word, given by the number of its form."""
        if not len(self.vocabulary) or not forms:
            return np.zeros(len(numbers), np.int64)
        digests = _digests(forms)
        at = np.minimum(np.searchsorted(self.vocabulary, digests), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == digests, at + 1, 0)[numbers]

    def emissions(self, lengths: np.ndarray, features: np.ndarray) -> np.ndarray:
        """Score of the toxic over the plain state at each word."""
        s = self.bias + self.words[1][features]
        first = np.zeros(len(features), bool)
        first[(np.cumsum(lengths) - lengths)[lengths > 0]] = True
        inner = np.flatnonzero(~first)
        s[inner] += self.words[0][features[inner - 1]]
        s[inner - 1] += self.words[2][features[inner]]
        return s

    def logits(self, lengths: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Forward and backward log odds of the toxic state at each word; their sum is the marginal's.

        All texts step together, longest first, so that a step works on those that still go on.
        """
        (w00, w01), (w10, w11) = np.exp(self.steps)
        order = np.argsort(-lengths, kind="stable")
        start, size = (np.cumsum(lengths) - lengths)[order], lengths[order]
        going = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), side="left")  # texts longer than t
        ahead, back = np.empty_like(s), np.zeros_like(s)
        a = np.zeros(0)
        for t, k in enumerate(going):
            at = start[:k] + t
            if t == 0:
                a = s[at]
            else:
                odds = np.exp(np.minimum(a[:k], 500.0))
                a = s[at] + np.log((w01 + w11 * odds) / (w00 + w10 * odds))
            ahead[at] = a
        for t in range(len(going) - 2, -1, -1):
            k = going[t + 1]
            nxt = start[:k] + t + 1
            odds = np.exp(np.minimum(back[nxt] + s[nxt], 500.0))
            back[nxt - 1] = np.log((w10 + w11 * odds) / (w00 + w01 * odds))
        return ahead, back

    def marginals(self, lengths: np.ndarray, features: np.ndarray) -> np.ndarray:
        ahead, back = self.logits(lengths, self.emissions(lengths, features))
        return 1 / (1 + np.exp(-np.clip(ahead + back, -500, 500)))

    def fit(self, lengths: np.ndarray, features: np.ndarray, y: np.ndarray) -> None:
        """Maximise the likelihood of labelled tokens by AdaGrad over all segments at once, until it stands still."""
        first = np.zeros(len(features), bool)
        first[np.cumsum(lengths) - lengths] = True
        inner = np.flatnonzero(~first)
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[inner - 1], y[inner]), 1)
        sums = [np.full_like(self.words, 1e-8), 1e-8, np.full((2, 2), 1e-8)]
        n, last, told = self.words.shape[1], (np.cumsum(lengths) - 1), []
        for _ in range(MOST_ROUNDS):
            s = self.emissions(lengths, features)
            ahead, back = self.logits(lengths, s)
            # the forward pass in log odds leaves the plain state's sum as a factor at each step
            reached = np.logaddexp(self.steps[0, 0], self.steps[1, 0] + ahead[inner - 1]).sum() + np.logaddexp(0, ahead[last]).sum()
            told.append(float(y @ s + (seen * self.steps).sum() - reached))
            if len(told) > PATIENCE and told[-1] - told[-1 - PATIENCE] < TOLERANCE * abs(told[-1]):
                break
            p = 1 / (1 + np.exp(-np.clip(ahead + back, -500, 500)))
            # pairs of states: forward log odds before, step, emission and backward log odds after
            before, after = ahead[inner - 1], s[inner] + back[inner]
            joint = np.stack([np.zeros_like(before) + self.steps[0, 0], after + self.steps[0, 1], before + self.steps[1, 0], before + after + self.steps[1, 1]])
            joint = np.exp(joint - joint.max(0))
            expected = (joint / joint.sum(0)).sum(1).reshape(2, 2)
            d = y - p
            g = np.stack([np.bincount(features[inner - 1], d[inner], n), np.bincount(features, d, n), np.bincount(features[inner], d[inner - 1], n)]) - DECAY * len(d) / 100 * self.words
            for value, grad, i in ((self.words, g, 0), (self.steps, (seen - expected) - DECAY * self.steps, 2)):
                sums[i] += grad**2
                value += RATE * grad / np.sqrt(sums[i])
            sums[1] += float(d.sum()) ** 2
            self.bias += RATE * float(d.sum()) / np.sqrt(sums[1])

    def summaries(self, lengths: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Per text: 1, the largest marginal, the log of 1 plus the expected number of toxic words."""
        out = np.zeros((len(lengths), 3))
        out[:, 0] = 1
        some = lengths > 0
        if some.any():
            at = (np.cumsum(lengths) - lengths)[some]
            out[some, 1] = np.maximum.reduceat(p, at)
            out[some, 2] = np.log1p(np.add.reduceat(p, at))
        return out

    def fit_documents(self, x: np.ndarray, toxic: np.ndarray) -> None:
        """Logistic regression of document labels on summaries, by Newton steps with a small penalty."""
        w = np.zeros(3)
        for _ in range(30):
            q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            w += np.linalg.solve((x.T * (q * (1 - q) + 1e-6)) @ x + np.eye(3), x.T @ (toxic - q) - w)
        self.document = w

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.document, -30, 30)))


def evidence(bad: np.ndarray, good: np.ndarray, toxic: int, plain: int) -> np.ndarray:
    """Log likelihood ratio of words in ``bad`` toxic and ``good`` other texts against chance; 0 where it does not point to toxic texts or the odds are low.

    It counts texts, not shares, so a word of a small language, or one of many inflections, needs no
    more texts than any other.
    """
    held, chance = np.maximum(bad + good, 1), toxic / max(toxic + plain, 1)
    q = bad / held
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(bad > 0, bad * np.log(q / chance), 0) + np.where(good > 0, good * np.log((1 - q) / (1 - chance)), 0)
    fits = (bad >= LEAST_COUNT) & (bad / max(toxic, 1) >= LEAST_ODDS * (good + 0.5) / max(plain, 1))
    return np.where(fits, gain, 0.0)


def offending(held: np.ndarray, label: np.ndarray, forms: int) -> np.ndarray:
    """Which forms are offending, from distinct pairs of a form and the text that holds it.

    The level is that with the fewest errors of "holds an offending form" on texts outside the
    fold's counts, each class counted by its share; the strictest of equal ones.
    """
    form, text = held
    mark = label[text]

    def weigh(use: np.ndarray, texts: np.ndarray) -> np.ndarray:
        y = label[texts]
        return evidence(np.bincount(form[use], mark[use], forms), np.bincount(form[use], 1 - mark[use], forms), int(y.sum()), int((1 - y).sum()))

    fold = np.zeros(len(label), np.int64)
    for g in (0, 1):  # every fold has its part of either class
        at = np.flatnonzero(label == g)
        fold[np.random.Generator(np.random.PCG64(5)).permutation(at)] = np.arange(len(at)) % FOLDS
    wrong = np.zeros((len(LEVELS), 2))
    for k in range(FOLDS):
        inside = fold[text] == k
        e = weigh(~inside, fold != k)
        for i, level in enumerate(LEVELS):
            hit = np.bincount(text[inside], e[form[inside]] >= level, len(label)) > 0
            wrong[i] += [(hit & (fold == k) & (label == 0)).sum(), (~hit & (fold == k) & (label == 1)).sum()]
    rate = wrong[:, 0] / max((label == 0).sum(), 1) + wrong[:, 1] / max((label == 1).sum(), 1)
    return weigh(np.ones(len(form), bool), np.ones(len(label), bool)) >= LEVELS[int(rate.argmin())]


def train(texts: list[str], toxic: list[int]) -> Crf:
    """Fit on whole labelled texts.

    Token labels: a word of a toxic text is toxic where its form is far more common in
    toxic than in other texts. The field is fitted on all segments with such a word and as
    many others, then the document score on all texts.
    """
    crf = Crf()
    label = np.array(toxic, np.int64)
    if not len(label) or label.min() == label.max():
        crf.document = np.array([2.0 if len(label) and label.min() else -2.0, 0.0, 0.0])
        return crf
    lengths, numbers, forms = tokens(texts)
    owner = np.repeat(np.arange(len(texts)), lengths)
    held = np.unique(np.stack([numbers, owner]), axis=1)
    found = offending(held, label, len(forms)) & np.array([bool(f) for f in forms])
    y = (found[numbers] & (label[owner] == 1)).astype(np.int64)
    place = np.arange(len(numbers)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    segment = np.cumsum((place % SEGMENT) == 0) - 1
    marked = np.bincount(segment, y) > 0
    others = np.flatnonzero(~marked)
    draw = np.random.Generator(np.random.PCG64(3)).permutation(others)[: max(int(marked.sum()), 200)]
    use = marked.copy()
    use[draw] = True
    inside = use[segment]
    sizes = np.bincount(segment)[use]
    crf = Crf(_digests([forms[i] for i in np.unique(numbers[inside])]))
    features = crf.features(numbers, forms)
    crf.fit(sizes, features[inside], y[inside])
    crf.fit_documents(crf.summaries(lengths, crf.marginals(lengths, features)), label)
    return crf


def held_out(id_: Column) -> Column:
    """Whether the CRC-32 of the id, as text, leaves no remainder by 5."""
    return F.pmod(F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def train_on(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS, seed: int = 42) -> Crf:
    """Fit on at most ``fit_rows`` labelled documents of either class and ``FIT_BYTES`` of distinct texts, none of them held out."""
    known = labels.where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").alias("__label_id")).agg(F.max("toxic").alias("toxic"))
    first = [known.where(F.col("toxic") == g).orderBy(F.xxhash64("__label_id", F.lit(seed)), "__label_id").limit(fit_rows) for g in (0, 1)]
    sample = F.broadcast(first[0].unionByName(first[1]))  # at most twice fit_rows rows
    mine = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(sample, F.col("__id") == F.col("__label_id"))
    # copies of a text count once, with the label that most of them have: a large group must not make its own words offending
    voted = mine.groupBy("text").agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic"))
    order = F.xxhash64("text", F.lit(seed))
    sizes = voted.select(F.md5("text").alias("key"), F.octet_length("text").alias("size"), order.alias("place")).orderBy("place", "key").limit(2 * fit_rows).collect()
    upto = np.cumsum([r["size"] for r in sizes] or [0])
    kept = docs.sparkSession.createDataFrame([(r["key"],) for r, at in zip(sizes, upto, strict=False) if at <= FIT_BYTES], "key string")
    rows = voted.withColumn("key", F.md5("text")).join(F.broadcast(kept), "key", "left_semi").collect()  # of the bytes above at most
    votes = {r["text"]: int(2 * r["toxic"] > r["n"]) for r in rows}
    texts = sorted(votes)
    return train(texts, [votes[t] for t in texts])


def tag(text: Column, crf: Crf) -> Column:
    """``score`` and ``spans`` (start, end in code points, marginal) of a whole text; null counts as empty."""

    @F.pandas_udf("score double, spans array<struct<start:int,end:int,marginal:double>>")
    def tags(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            scores, spans = [], []
            texts, part, size = s.tolist(), [], 0
            for i, t in enumerate(texts):
                part.append(t or "")
                size += len(part[-1])
                if size < RUN_CHARS and i < len(texts) - 1:
                    continue
                lengths, numbers, forms = tokens(part)
                p = crf.marginals(lengths, crf.features(numbers, forms))
                scores.append(crf.scores(crf.summaries(lengths, p)))
                ends = np.cumsum(lengths)
                hits: dict[int, list[int]] = {}
                for h in np.flatnonzero(p >= SPAN_MARGINAL):
                    hits.setdefault(int(np.searchsorted(ends, h, side="right")), []).append(int(h))
                for j, t_ in enumerate(part):
                    found = []
                    if j in hits:
                        places = [m.span() for m in WORD.finditer(t_)]
                        begin = int(ends[j] - lengths[j])
                        found = [(*places[h - begin], float(p[h])) for h in hits[j]]
                    spans.append([{"start": a, "end": b, "marginal": m} for a, b, m in found])
                part, size = [], 0
            yield pd.DataFrame({"score": np.concatenate(scores) if scores else np.zeros(0), "spans": spans})

    return tags(F.coalesce(text, F.lit("")))


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> DataFrame:
    """Add ``held_out``, ``score``, ``spans`` and ``predicted``; input columns of these names are replaced.

    A model is fitted on a bounded sample of labelled documents, none of them held out,
    then every whole text is tagged where it is, without a shuffle. The score uses the text
    alone, so repeated rows have one score. Empty and null texts get the score of a text without toxic words. Without labels of both
    classes all scores are alike. Null ids are scored like others. A very long text is tagged as a whole, as a run of its own. An empty
    table gives an empty result.
    """
    crf = train_on(docs, labels, id_col, text_col, fit_rows)
    d = bound_batches(docs).drop("held_out", "score", "spans", "predicted")
    tagged = d.withColumn("__tag", tag(F.col(text_col), crf)).withColumn("held_out", held_out(F.col(id_col)))
    return tagged.select(*d.columns, "held_out", "__tag.score", "__tag.spans", (F.col("__tag.score") >= 0.5).cast("int").alias("predicted"))
