"""Document quality from a linear-chain conditional random field over lines.

Every line with a word gets features of its own (symbols, capitals, digits, repeated words,
length, equality with an earlier line) and of its neighbours, and a hidden label good or bad.
Forward-backward passes give the probability that each line is good; the document's score is
their mean, weighted by line length. Training knows labels of documents only: each line of a
training text takes the label of its document, and transitions learn how labels hold on.

All arithmetic runs on whole slices of documents: counts by line over byte arrays, and the
passes over the chain for all documents of a slice together, one line a step.

Defined results: null text and text without words have score 0; without labels of both
classes the score is the share of label 1 (0 without labels). Rows are scored one by one;
only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqseg.llm.arrays import slices, texts_of
from seqseg.session import ship

_SETS = (b"#*$%&|<>", bytes(range(0x41, 0x5B)), b"!", b"0123456789", b"|", b".,;:?")
_COUNT = [np.array([b in s for b in range(256)], np.uint8) for s in _SETS]
N_OWN = 12
#: Own features that the line also gets from the line before and after it.
SHARED = (1, 2, 3, 4, 6, 8)
N_FEATURES = N_OWN + 2 * len(SHARED)


@dataclass
class Lines:
    """Lines with words of some documents: features, byte lengths, and where each document's begin."""

    features: np.ndarray
    sizes: np.ndarray
    starts: np.ndarray


def lines_of(texts: list[bytes]) -> Lines:
    data, words, distinct, again, counts = [], [], [], [], []
    for text in texts:
        n, seen = 0, set()
        for line in text.split(b"\n"):
            tokens = line.split()
            if tokens:
                n += 1
                data.append(line)
                words.append(len(tokens))
                distinct.append(len(set(tokens)))
                again.append(line in seen)
                seen.add(line)
        counts.append(n)
    starts = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    if not data:
        return Lines(np.zeros((0, N_FEATURES)), np.zeros(0), starts)
    flat = np.frombuffer(b"\n".join(data) + b"\n", np.uint8)
    sizes = np.array([len(x) for x in data], np.float64)
    first = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]).astype(np.int64)
    symbols, capitals, cries, digits, bars, stops = (
        np.add.reduceat(table[flat], first, dtype=np.int64).astype(np.float64) for table in _COUNT
    )
    n = np.array(words, np.float64)
    own = np.stack(
        [
            np.ones(len(n)),
            np.minimum(symbols / n, 3),
            capitals / sizes,
            1 - np.array(distinct) / n,
            np.minimum(cries / n, 3),
            digits / sizes,
            np.minimum(bars / n, 1),
            np.log1p(n) / 5,
            np.array(again, np.float64),
            np.minimum(sizes / n, 30) / 10,
            np.minimum(stops / n, 2),
            (n < 4).astype(np.float64),
        ],
        axis=1,
    )
    owner = np.repeat(np.arange(len(texts)), counts)
    before, after = np.zeros_like(own), np.zeros_like(own)
    same = (owner[1:] == owner[:-1])[:, None]
    before[1:], after[:-1] = own[:-1] * same, own[1:] * same
    return Lines(np.concatenate([own, before[:, SHARED], after[:, SHARED]], axis=1), sizes, starts)


@dataclass
class Field:
    """``weights`` score a line as good against bad; ``moves[a, b]`` scores label b after a."""

    weights: np.ndarray
    moves: np.ndarray
    share: float | None = None

    def passes(self, lines: Lines) -> tuple[np.ndarray, np.ndarray]:
        """Marginals of the labels of each line, and of pairs with the line before (by line)."""
        unary = np.clip(lines.features @ self.weights, -30, 30)
        local = np.stack([np.ones(len(unary)), np.exp(unary)], axis=1)
        step = np.exp(np.clip(self.moves, -30, 30))
        counts = np.diff(lines.starts)
        order = np.argsort(-counts, kind="stable")
        first, sizes = lines.starts[:-1][order], counts[order]
        alpha, beta = np.zeros_like(local), np.ones_like(local)
        longest = int(sizes[0]) if len(sizes) else 0
        active = np.searchsorted(-sizes, -np.arange(longest), side="left")  # documents with more than t lines
        for t in range(longest):
            at = first[: active[t]] + t
            a = local[at] if t == 0 else (alpha[at - 1] @ step) * local[at]
            alpha[at] = a / a.sum(axis=1, keepdims=True)
        for t in range(longest - 2, -1, -1):
            at = first[: active[t + 1]] + t
            b = (local[at + 1] * beta[at + 1]) @ step.T
            beta[at] = b / b.sum(axis=1, keepdims=True)
        single = alpha * beta
        single /= single.sum(axis=1, keepdims=True)
        inner = np.ones(len(unary), bool)
        inner[lines.starts[:-1][counts > 0]] = False
        at = np.flatnonzero(inner)
        pair = alpha[at - 1][:, :, None] * step[None] * (local[at] * beta[at])[:, None, :]
        pair /= pair.sum(axis=(1, 2), keepdims=True)
        return single, pair

    def scores(self, texts: list[bytes]) -> np.ndarray:
        lines = lines_of(texts)
        counts = np.diff(lines.starts)
        full = np.flatnonzero(counts > 0)
        out = np.zeros(len(texts))
        if self.share is not None:
            out[full] = self.share
        elif len(full):
            good = self.passes(lines)[0][:, 1]
            begin = lines.starts[:-1][full]
            out[full] = np.add.reduceat(good * lines.sizes, begin) / np.add.reduceat(lines.sizes, begin)
        return out


def train(cases: list[tuple[str, int]], rounds: int = 200, rate: float = 0.1, penalty: float = 1e-4) -> Field:
    """Maximum conditional likelihood (Adam on the full gradient); documents weigh the same."""
    labels = np.array([y for _, y in cases], np.int64)
    if len(set(labels.tolist())) < 2:
        return Field(np.zeros(N_FEATURES), np.zeros((2, 2)), float(labels.mean()) if len(labels) else 0.0)
    lines = lines_of([t.encode() for t, _ in cases])
    counts = np.diff(lines.starts)
    owner = np.repeat(np.arange(len(cases)), counts)
    weight = 1.0 / counts[owner]
    y = labels[owner]
    inner = np.flatnonzero(np.append(False, owner[1:] == owner[:-1])) if len(owner) else np.zeros(0, np.int64)
    field = Field(np.zeros(N_FEATURES), np.zeros((2, 2)))
    mean, square = np.zeros(N_FEATURES + 4), np.zeros(N_FEATURES + 4)
    for turn in range(1, rounds + 1):
        single, pair = field.passes(lines)
        up = lines.features.T @ ((y - single[:, 1]) * weight)
        across = np.zeros((2, 2))
        np.add.at(across, (y[inner - 1], y[inner]), weight[inner])
        across -= (pair * weight[inner][:, None, None]).sum(axis=0)
        now = np.concatenate([field.weights, field.moves.ravel()])
        slope = np.concatenate([up, across.ravel()]) / len(cases) - penalty * now
        mean, square = 0.9 * mean + 0.1 * slope, 0.999 * square + 0.001 * slope**2
        now += rate * (mean / (1 - 0.9**turn)) / (np.sqrt(square / (1 - 0.999**turn)) + 1e-8)
        field.weights, field.moves = now[:N_FEATURES], now[N_FEATURES:].reshape(2, 2)
    return field


def _score(batches: Iterator[pa.RecordBatch], field: Field) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text"):
        values = field.scores(texts_of(part, "text"))
        yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(values)], names=["id", "score"])


def score_quality(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``score`` (share of good lines by length) and ``predicted``."""
    ship(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    scored = source.mapInArrow(
        lambda b: _score(b, field), f"id {source.schema['id'].dataType.simpleString()}, score double"
    )
    return scored.select(
        F.col("id").alias(id_col), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    )
