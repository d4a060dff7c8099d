"""Phrase collocations, counted in an index of every shard and summed across shards.

Each task cuts its documents into shards of one language and a bounded number of words, gives
words shard-local ids, and indexes the sequence of ids (0 stands between pieces) in both
directions: positions sorted by the words from them on, and by the words up to them, each with
the symbol before or after as its Burrows-Wheeler transform. An n-gram is a pair of intervals,
one in either order. ``extend`` lengthens all n-grams of a level by one word to the right or
left in one go: the symbols inside an interval are the possible extensions, their numbers the
counts, and the last-to-first mapping leads to the interval of the longer n-gram. Orders of
three words are enough for n-grams of four, since the last extension needs no interval.

* One pass writes the indexes. Words and pairs are enumerated and summed over shards by 96 bits
  of hash. A shard has each of them once, so no key is hot: its rows are at most as many as
  there are shards.
* Pairs that reach the threshold go back to their shards; the first shard of each word and pair
  names it. N-grams of three and four words whose pairs all reach it (no other can) are summed
  by their texts.
* Scores need the counts of parts of candidates, which are candidates or frequent words.

A candidate inside a longer one is dropped by the longer one's count. Counts do not grow
with length, so the extensions by one word decide.

Defined results: null text is empty; null lang is ``und``; languages without a candidate have
no row; repeated rows count each; an empty table gives no rows. A text is cut between shards
only where a piece ends, so a single piece is held whole by one task. Only the named columns
are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqseg.llm.arrays import mix
from seqseg.session import settle, ship

#: Words of a shard; the last stretch of text may go beyond it.
SHARD_WORDS = 3_000_000
#: Bytes of text that are split into words at a time.
STRETCH = 4 << 20
BATCH = 200_000
#: Occurrences whose extensions are sorted at a time; one n-gram may go beyond it.
BLOCK = 500_000
LONGEST = 4

_END = b"\xff"  # a byte that no UTF-8 text has; stands for the end of a piece
_PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes.maketrans(
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t" + _PIECE_ENDS, b"abcdefghijklmnopqrstuvwxyz " + _END * len(_PIECE_ENDS)
)
_PIECE_END = re.compile(b"[" + _PIECE_ENDS + b"]")
_CODEC = pa.Codec("zstd")
_FACTOR = 0x9E3779B97F4A7C15


def _pack(values: np.ndarray) -> bytes:
    return _CODEC.compress(values.astype("<i4").tobytes(), asbytes=True)


def _unpack(packed: bytes, n: int) -> np.ndarray:
    return np.frombuffer(_CODEC.decompress(packed, 4 * n, asbytes=True), "<i4")


def _stretches(raw: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(raw):
        cut = _PIECE_END.search(raw, at + STRETCH) if len(raw) - at > STRETCH else None
        stop = cut.end() if cut else len(raw)
        yield raw[at:stop]
        at = stop


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self)
        return value


class Shard:
    """Words of one language on their way into an index."""

    def __init__(self) -> None:
        self.ids = _Ids({_END: 0})
        self.parts: list[np.ndarray] = []
        self.waiting: list[bytes] = []
        self.waiting_bytes = self.n_ids = 0

    def add(self, text: bytes) -> None:
        self.waiting.append(text)
        self.waiting_bytes += len(text)
        if self.waiting_bytes >= STRETCH:
            self.encode()

    def encode(self) -> None:
        words = _END.join([*self.waiting, b""]).translate(_TABLE).replace(_END, b" " + _END + b" ").split()
        ids = np.fromiter(map(self.ids.__getitem__, words), np.int32, len(words))
        if len(ids):
            ids = ids[(ids != 0) | np.append(True, ids[:-1] != 0)]
        self.parts.append(ids)
        self.n_ids += len(ids)
        self.waiting, self.waiting_bytes = [], 0

    def sequence(self) -> np.ndarray:
        """All ids; a break is at both ends."""
        self.encode()
        return np.concatenate([[0], *self.parts]).astype(np.int64)


def _order(a: np.ndarray, b: np.ndarray, c: np.ndarray, size: int) -> np.ndarray:
    """Positions sorted by (a, b, c), all below ``size``."""
    if size**3 < 2**63:
        return np.argsort((a * size + b) * size + c)
    return np.lexsort((c, b, a))


def transforms(x: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbols before each position in the order of what follows, and after each in the order of what precedes."""
    ahead = _order(x, np.roll(x, -1), np.roll(x, -2), size)
    back = _order(x, np.roll(x, 1), np.roll(x, 2), size)
    return x[ahead - 1], x[(back + 1) % len(x)]


class Index:
    """Both transforms of a shard; ``counts`` are those of the symbols."""

    def __init__(self, before: np.ndarray, after: np.ndarray, size: int) -> None:
        self.size = size
        self.symbols = {"left": before, "right": after}
        self.counts = np.bincount(before, minlength=size)
        self.first = np.cumsum(self.counts) - self.counts
        self.leads: dict[str, np.ndarray] = {}

    def lead(self, side: str) -> np.ndarray:
        """Last-to-first mapping of a transform."""
        if side not in self.leads:
            symbols = self.symbols[side]
            lead = np.empty(len(symbols), np.int32)
            lead[np.argsort(symbols, kind="stable")] = np.arange(len(symbols), dtype=np.int32)
            self.leads[side] = lead
        return self.leads[side]

    def words(self) -> dict[str, np.ndarray]:
        """N-grams of one word: ``grams`` (one row each), ``n``, and the starts of their intervals."""
        ids = np.arange(1, self.size, dtype=np.int32)
        return {"grams": ids[:, None], "n": self.counts[1:], "left": self.first[1:], "right": self.first[1:]}

    def extend(self, level: dict[str, np.ndarray], side: str) -> dict[str, np.ndarray]:
        """All n-grams that are one word longer on ``side``; breaks extend nothing."""
        block = (np.cumsum(level["n"]) - level["n"]) // BLOCK
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
        parts = [self._extend(_kept(level, slice(a, b)), side) for a, b in zip(cuts, cuts[1:])]
        return {name: np.concatenate([p[name] for p in parts]) for name in parts[0]}

    def _extend(self, level: dict[str, np.ndarray], side: str) -> dict[str, np.ndarray]:
        n, start = level["n"], level[side]
        owner = np.repeat(np.arange(len(n)), n)
        at = np.arange(len(owner)) + np.repeat(start - (np.cumsum(n) - n), n)
        symbol = self.symbols[side][at]
        order = np.argsort(owner * self.size + symbol, kind="stable")
        owner, symbol = owner[order], symbol[order]
        head = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (symbol[1:] != symbol[:-1]))) if len(order) else order
        count = np.diff(np.append(head, len(order)))
        real = symbol[head] != 0
        head, count = head[real], count[real]
        own, new = owner[head], symbol[head]
        other = "left" if side == "right" else "right"
        # Smaller symbols of the same interval lie before in the other order.
        inside = head - (np.cumsum(n) - n)[own]
        old = level["grams"][own]
        grams = np.column_stack([old, new] if side == "right" else [new, old])
        return {"grams": grams, "n": count, side: self.lead(side)[at[order[head]]], other: level[other][own] + inside}


def _kept(level: dict[str, np.ndarray], keep: np.ndarray | slice) -> dict[str, np.ndarray]:
    return {k: v[keep] for k, v in level.items()}


def pairs(index: Index) -> dict[str, np.ndarray]:
    return index.extend(index.words(), "right")


def longer(index: Index, words: np.ndarray, frequent: np.ndarray) -> Iterator[dict[str, np.ndarray]]:
    """Given words and pairs (places in ``pairs``), then n-grams of three and four words all of whose pairs are given."""
    yield _kept(index.words(), words)
    level = _kept(pairs(index), frequent)
    yield level

    def code_of(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return left.astype(np.int64) * index.size + right

    codes = np.sort(code_of(level["grams"][:, 0], level["grams"][:, 1]))

    def known(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        code = code_of(left, right)
        place = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
        return codes[place] == code if len(codes) else np.zeros(len(code), bool)

    three = index.extend(level, "right")
    three = _kept(three, known(three["grams"][:, 1], three["grams"][:, 2]))
    yield three
    four = index.extend(three, "left")
    yield _kept(four, known(four["grams"][:, 0], four["grams"][:, 1]))


def _write(shard: Shard, number: int, lang: str) -> pa.RecordBatch:
    x, size = shard.sequence(), len(shard.ids)
    before, after = transforms(x, size)
    words = pa.array(list(shard.ids)[1:], pa.binary()).cast(pa.string())
    vocabulary = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([number], pa.int64()),
            pa.array([lang]),
            pa.array([int((x != 0).sum())], pa.int64()),
            pa.array([len(x)], pa.int64()),
            vocabulary,
            pa.array([_pack(before)], pa.binary()),
            pa.array([_pack(after)], pa.binary()),
        ],
        names=["shard", "lang", "n_words", "n_ids", "words", "before", "after"],
    )


_INDEX_TYPE = "shard bigint, lang string, n_words bigint, n_ids bigint, words array<string>, before binary, after binary"


def _build(batches: Iterator[pa.RecordBatch], shard_words: int) -> Iterator[pa.RecordBatch]:
    task = TaskContext.get()
    number = (task.partitionId() if task else 0) << 32
    shards: dict[str, Shard] = {}

    def close(lang: str) -> Iterator[pa.RecordBatch]:
        nonlocal number
        shard = shards.pop(lang)
        shard.encode()
        if shard.n_ids:
            yield _write(shard, number, lang)
            number += 1

    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        for lang, text in zip(batch.column("lang").to_pylist(), texts):
            for part in _stretches(text.as_py() or b""):
                shard = shards.get(lang) or shards.setdefault(lang, Shard())
                shard.add(part)
                if shard.n_ids >= shard_words:
                    yield from close(lang)
                elif sum(s.n_ids + s.waiting_bytes // 4 for s in shards.values()) >= 2 * shard_words:
                    yield from close(max(shards, key=lambda k: shards[k].n_ids + shards[k].waiting_bytes // 4))
    for lang in list(shards):
        yield from close(lang)


def index_shards(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", shard_words: int = SHARD_WORDS) -> DataFrame:
    """One row per shard: its language, word count, words by id (from 1) and both transforms."""
    ship(docs.sparkSession)
    source = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    return source.where(F.octet_length("text") > 0).mapInArrow(lambda b: _build(b, shard_words), _INDEX_TYPE)


def _load(row: dict) -> tuple[Index, pa.Array]:
    words = row["words"]
    n = row["n_ids"]
    return Index(_unpack(row["before"], n), _unpack(row["after"], n), len(words) + 1), pa.concat_arrays([pa.array([""]), words])


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = {name: batch.column(name)[i] for name in batch.schema.names}
            yield {k: v.values if isinstance(v, pa.ListScalar) else v.as_py() for k, v in row.items()}


def _keys(row: dict, words: pa.Array, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of (lang, n-gram): 64 bits and 32 more."""
    start, raw = row["lang"].encode() + b"\t", words.cast(pa.binary()).to_pylist()
    both = []
    for seed in (0, 1):
        own = np.array([xxhash.xxh3_64_intdigest(start + w, seed) for w in raw], np.uint64)
        out = own[grams[:, 0]]
        for i in range(1, grams.shape[1]):
            out = mix(out) * np.uint64(_FACTOR) + own[grams[:, i]]
        both.append(mix(out).view(np.int64))
    return both[0], (both[1] >> 32).astype(np.int32)


def _short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of the words and pairs of each shard; words have the places -1, -2 and so on."""
    for row in _rows_of(batches):
        index, words = _load(row)
        for level, sign in ((index.words(), -1), (pairs(index), 1)):
            places = np.arange(len(level["n"]), dtype=np.int32)
            places = -1 - places if sign < 0 else places
            keys, checks = _keys(row, words, level["grams"])
            for a in range(0, len(keys), BATCH):
                own = slice(a, a + BATCH)
                n = level["n"][own]
                shard = np.full(len(n), row["shard"])
                columns = [pa.array(x) for x in (keys[own], checks[own], shard, places[own], n.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "check", "shard", "place", "n"])


def _phrases(words: pa.Array, grams: np.ndarray) -> pa.Array:
    taken = [words.take(pa.array(grams[:, i])) for i in range(grams.shape[1])]
    return pc.binary_join_element_wise(*taken, " ") if len(taken) > 1 else taken[0]


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts and counts: of words and pairs that this shard is to name, and of longer n-grams made of frequent pairs."""
    for row in _rows_of(batches):
        index, words = _load(row)
        places = row["places"].field("place").to_numpy()
        totals = row["places"].field("f").fill_null(0).to_numpy()
        order = np.argsort(places)
        places, totals = places[order], totals[order]
        pair = places >= 0
        lang = pa.array([row["lang"]])
        for size, level in enumerate(longer(index, (-1 - places[~pair])[::-1], places[pair]), 1):
            if size == 1:
                level = level | {"n": totals[~pair][::-1]}
            elif size == 2:
                level = level | {"n": totals[pair]}
            level = _kept(level, level["n"] > 0)
            for a in range(0, len(level["n"]), BATCH):
                grams, n = level["grams"][a : a + BATCH], level["n"][a : a + BATCH]
                same = lang.take(pa.array(np.zeros(len(n), np.int64)))
                columns = [same, _phrases(words, grams), pa.array(n.astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "phrase", "n"])


def frequent_phrases(index: DataFrame, least: int) -> DataFrame:
    """(lang, phrase, size, f): all n-grams of one to four words with a count of ``least`` or more.

    Words and pairs are summed by 96 bits of hash. A frequent pair goes back to all its shards,
    which look for longer n-grams; the first shard names it with its total.
    """
    every = Window.partitionBy("key", "check")
    hashed = index.mapInArrow(_short, "key bigint, check int, shard bigint, place int, n int")
    summed = hashed.withColumns({"f": F.sum("n").over(every), "names": F.col("shard") == F.min("shard").over(every)})
    wanted = summed.where((F.col("f") >= least) & (F.col("names") | (F.col("place") >= 0)))
    wanted = settle(wanted.select("shard", "place", F.when(F.col("names"), F.col("f")).alias("f")))
    wanted = wanted.groupBy("shard").agg(F.collect_list(F.struct("place", "f")).alias("places"))
    exact = index.join(wanted, "shard").mapInArrow(_exact, "lang string, phrase string, n bigint")
    counts = exact.groupBy("lang", "phrase").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    return settle(counts.select("lang", "phrase", F.size(F.split("phrase", " ")).alias("size"), "f"))


def _part(first: Column, length: Column) -> Column:
    return F.array_join(F.slice(F.split("phrase", " "), first, length), " ")


def collocations(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    least: int = 30,
    covered: int = 80,
    shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of all candidates that no longer one covers.

    ``a`` is the count of the phrase, ``l`` and ``r`` those of the parts at its weakest cut, ``n``
    the words of the language. A phrase is covered by a longer candidate around it that has at
    least ``covered`` percent of its count.
    """
    index = settle(index_shards(docs, text_col, lang_col, shard_words))
    counts = frequent_phrases(index, least)
    one = F.lit(1)
    inner = F.col("size") - 1
    around = counts.where("size > 2").select(
        "lang", F.explode(F.array(_part(one, inner), _part(one + 1, inner))).alias("phrase"), "f"
    )
    around = around.groupBy("lang", "phrase").agg(F.max("f").alias("around"))
    wide = F.lit(covered).cast("decimal(10,0)")
    kept = (
        counts.where("size > 1")
        .join(around, ["lang", "phrase"], "left")
        .where(F.col("around").isNull() | (F.lit(100).cast("decimal(10,0)") * F.col("around") < wide * F.col("f")))
    )
    cuts = kept.select("lang", "phrase", F.col("f").alias("a"), "size", F.explode(F.sequence(one, inner)).alias("k"))
    cuts = cuts.withColumns({"first": _part(one, F.col("k")), "rest": _part(F.col("k") + 1, F.col("size"))})
    parts = counts.where(F.col("size") < LONGEST).select("lang", "phrase", "f")
    left = parts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = parts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    cuts = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"])
    score = F.expr("(2000000BD * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    weakest = cuts.groupBy("lang", "phrase").agg(F.min(F.struct(score.alias("score"), "k", "a", "l", "r")).alias("w"))
    words = index.groupBy("lang").agg(F.sum("n_words").alias("n"))
    return weakest.join(words, "lang").select("lang", "phrase", "w.a", "w.l", "w.r", "n", "w.score")


def top_phrases(scored: DataFrame, top: int) -> DataFrame:
    """The ``top`` phrases of each language with their ``rank``.

    The filter on the row number lets tasks keep only their own first rows before the shuffle.
    """
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
