"""Toxicity of texts: averaged subword embeddings under a linear softmax, trained in numpy.

A word is the bag of its character 3- to 6-grams (with word ends marked), hashed into
buckets; each bucket has a vector. A bag of words is the average of its words' vectors, and
a softmax layer on it gives the classes. Misspelt and inflected forms share most n-grams
with the form that was seen. Vectors and softmax are trained together.

A long text is scored window by window (2 words, every start) and takes its most toxic
window, so that a few words are not averaged away. Training does the same: it begins with
random windows of the labelled texts and goes on with the window that scores highest now.
Which windows it settles on depends on chance, so it is started twice and the linear models
are averaged: words that only one of them took up count half.

Because the layers are linear, a word contributes one number per model; tasks get one number
per bucket and keep those of the words seen lately.

Defined results: null text and text without words score as an average of nothing (the
bias alone); without labels of both classes the score is the share of label 1 (0 without
labels). Only the named columns are read; rows are scored one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqseg.llm.arrays import slices, valid_windows, window_hashes
from seqseg.session import ship

SIZES = (3, 4, 5, 6)
BUCKETS = 1 << 17
WINDOW = 2
#: Trainings from different random numbers that are averaged.
RESTARTS = 2
_SPLIT = str.maketrans({c: " " for c in ".,;:!?\"()[]{}<>|/\\\r\n\t\x0b\x0c"})


def words_of(text: str) -> list[str]:
    """Words in lower case; a word said several times in a row counts once."""
    words = text.lower().translate(_SPLIT).split()
    return [w for w, before in zip(words, [None, *words]) if w != before]


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the words, and where each word's begin (one entry more)."""
    marked = [f"<{w}>" for w in words]
    points = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    starts = np.zeros(len(words) + 1, np.int64)
    np.cumsum([len(m) for m in marked], out=starts[1:])
    grams, owners = [], []
    for size in SIZES:
        at = valid_windows(starts, size)
        grams.append((window_hashes(points, size)[at] % np.uint64(BUCKETS)).astype(np.int32))
        owners.append(np.searchsorted(starts, at, side="right") - 1)
    # A marked word has at least three characters, so none is without a 3-gram.
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(grams)[order], np.searchsorted(owner[order], np.arange(len(words) + 1))


@dataclass
class Model:
    """``value``: contribution of each bucket to the difference of the two logits."""

    value: np.ndarray
    bias: float

    def word_scores(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.zeros(0)
        grams, ptr = subwords(words)
        return np.add.reduceat(self.value[grams].astype(np.float64), ptr[:-1]) / np.diff(ptr)


def constant(share: float) -> Model:
    share = min(max(share, 1e-6), 1 - 1e-6)
    return Model(np.zeros(BUCKETS, np.float32), float(np.log(share / (1 - share))))


def window_means(scores: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean of every window of each text (of the whole text where it is shorter), and where each text's begin."""
    total = np.concatenate([[0.0], np.cumsum(scores)])
    sizes = np.minimum(np.diff(starts), width)
    counts = np.where(sizes == 0, 0, np.diff(starts) - sizes + 1)
    begin = np.concatenate([[0], np.cumsum(counts)])
    owner = np.repeat(np.arange(len(sizes)), counts)
    at = np.arange(begin[-1]) - begin[owner] + starts[owner]
    return (total[at + sizes[owner]] - total[at]) / np.maximum(sizes[owner], 1), begin


def train(cases: list[tuple[str, int]], restarts: int = RESTARTS, seed: int = 7) -> Model:
    """Average of the models of several trainings."""
    models = [fit(cases, seed=seed + i) for i in range(restarts)]
    value = np.mean([m.value for m in models], axis=0, dtype=np.float64).astype(np.float32)
    return Model(value, float(np.mean([m.bias for m in models])))


def fit(
    cases: list[tuple[str, int]], dim: int = 8, warm: int = 6, rounds: int = 14, rate: float = 0.5, width: int = WINDOW, seed: int = 7
) -> Model:
    """Stochastic gradient (Adagrad) on the log loss over one window per text and round.

    Few texts are gone over more often, so that the number of steps stays about the same.
    """
    labels = np.array([y for _, y in cases], np.int64)
    if len(set(labels.tolist())) < 2:
        return constant(float(labels.mean()) if len(labels) else 0.0)
    rng = np.random.default_rng(seed)
    docs = [words_of(t) for t, _ in cases]
    number: dict[str, int] = {}
    words = np.array([number.setdefault(w, len(number)) for d in docs for w in d], np.int64)
    starts = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    grams, ptr = subwords(list(number))
    counts = np.diff(ptr)
    vectors = rng.uniform(-1 / dim, 1 / dim, (BUCKETS, dim)).astype(np.float32)
    layer, bias = np.zeros((dim, 2), np.float32), np.zeros(2, np.float32)
    seen_v, seen_l, seen_b = np.full(BUCKETS, 1e-6, np.float32), np.full(dim, 1e-6, np.float32), 1e-6
    alive = np.flatnonzero(np.diff(starts) > 0)
    sizes = np.minimum(np.diff(starts), width)
    more = min(max(1.0, 3000 / max(1, len(alive))), 10.0)
    warm, rounds = round(warm * more), round(rounds * more)
    for turn in range(warm + rounds):
        pick = starts[:-1] + (rng.random(len(docs)) * (np.diff(starts) - sizes + 1)).astype(np.int64)
        if turn >= warm:
            model = Model((vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float32), 0.0)
            means, begin = window_means(model.word_scores(list(number))[words], starts, width)
            best = np.array([begin[d] + np.argmax(means[begin[d] : begin[d + 1]]) - begin[d] for d in alive])
            pick[alive] = starts[alive] + best
        for batch in np.array_split(rng.permutation(alive), max(1, len(alive) // 64)):
            n = sizes[batch]
            at = np.repeat(pick[batch] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            own = words[at]
            k = counts[own]
            flat = grams[np.repeat(ptr[own] - (np.cumsum(k) - k), k) + np.arange(k.sum())]
            share = np.repeat(1.0 / (np.repeat(n, n) * k), k).astype(np.float32)[:, None]
            row = np.repeat(np.repeat(np.arange(len(batch)), n), k)
            hidden = np.zeros((len(batch), dim), np.float32)
            np.add.at(hidden, row, vectors[flat] * share)
            logits = hidden @ layer + bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(batch)), labels[batch]] -= 1.0  # slope of the loss by the logits
            back = (p @ layer.T)[row] * share
            slope, total = np.unique(flat, return_inverse=True)
            summed = np.zeros((len(slope), dim), np.float32)
            np.add.at(summed, total, back)
            seen_v[slope] += (summed**2).mean(axis=1)
            vectors[slope] -= rate * summed / np.sqrt(seen_v[slope])[:, None]
            down, shift = hidden.T @ p, p.sum(axis=0)
            seen_l += (down**2).mean(axis=1)
            seen_b += float((shift**2).mean())
            layer -= rate * down / np.sqrt(seen_l)[:, None]
            bias -= rate * shift / np.sqrt(seen_b)
    return Model((vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


class Scorer:
    def __init__(self, model: Model, limit: int = 400_000) -> None:
        self.model, self.limit, self.known = model, limit, {}

    def scores(self, texts: list[str]) -> np.ndarray:
        docs = [words_of(t) for t in texts]
        starts = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(np.int64)
        flat = [w for d in docs for w in d]
        needed = set(flat)
        new = needed.difference(self.known)
        if len(self.known) + len(new) > self.limit:
            self.known, new = {}, needed
        fresh = sorted(new)
        self.known.update(zip(fresh, self.model.word_scores(fresh).tolist()))
        values = np.fromiter(map(self.known.__getitem__, flat), np.float64, len(flat))
        means, begin = window_means(values, starts, WINDOW)
        best = np.zeros(len(docs))
        full = np.flatnonzero(np.diff(begin) > 0)
        if len(full):
            best[full] = np.maximum.reduceat(means, begin[full])
        return 1.0 / (1.0 + np.exp(-np.clip(best + self.model.bias, -30, 30)))


def _score(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    scorer = Scorer(sent.value)
    for part in slices(batches, "text"):
        values = scorer.scores([t or "" for t in part.column("text").to_pylist()])
        yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(values)], names=["id", "score"])


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``score`` (probability of label 1) and ``predicted``."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    scored = source.mapInArrow(
        lambda b: _score(b, sent), f"id {source.schema['id'].dataType.simpleString()}, score double"
    )
    return scored.select(
        F.col("id").alias(id_col), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    )
