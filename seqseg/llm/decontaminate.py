"""Benchmark passages in documents, found by winnowing.

A window is 13 consecutive words of a benchmark item. Of every 9 consecutive 5-gram hashes
the smallest is kept as a fingerprint; 13 shared words hold 9 such 5-grams, and both sides
choose the same ones, so every shared window contains a common fingerprint. Fingerprints of
the documents are joined with those of the items, and each hit is extended: the windows
around it are compared by their own hash. Items of fewer than 13 words are one window; they
are compared as a whole, for each length that occurs.

The items are the stated query set: they are dealt into blocks of at most ``block_words``
words, each block is sent to every task, and the documents are read once per block (one
block for usual benchmarks). Documents are never shuffled unless there are several blocks.

Defined results: null text and text without words have no words and no hits; a null item is
no window; equal windows in several items count for each of them; repeated rows are judged
one by one. An empty benchmark gives no hits, empty documents no rows. Only the named
columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqseg.llm.arrays import WordHashes, mix, sliding_min, slices, texts_of, valid_windows, window_hashes
from seqseg.session import ship

WINDOW = 13
GRAM = 5
#: ASCII letters are lower-cased, other ASCII but digits separates words, other bytes stay.
_TABLE = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20
    for b in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def fingerprints(words: np.ndarray, starts: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the winnowed grams of documents with at least ``window`` words."""
    grams = window_hashes(words, gram)
    at = valid_windows(starts, window)
    if not len(at):
        return at, np.zeros(0, np.uint64)
    least = sliding_min(grams, window - gram + 1)
    # A gram is kept if it is the least of one of the windows that hold it.
    kept = np.zeros(len(words), bool)
    for shift in range(window - gram + 1):
        kept[at[grams[at + shift] == least[at]] + shift] = True
    where = np.flatnonzero(kept)
    return where, grams[where]


class Items:
    """A block of benchmark items as sorted arrays."""

    def __init__(self, ids: list, texts: list[bytes]) -> None:
        docs = [words_of(t) for t in texts]
        words, starts = WordHashes().of(docs)
        lengths = np.diff(starts)
        self.ids = ids
        _, grams = fingerprints(words, starts)
        self.grams = np.unique(grams)
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for width in sorted({min(int(n), WINDOW) for n in lengths if n}):
            at = valid_windows(starts, width)
            owner = np.searchsorted(starts, at, side="right") - 1
            if width < WINDOW:
                at, owner = at[lengths[owner] == width], owner[lengths[owner] == width]
            hashes = window_hashes(words, width)[at]
            pairs = np.unique(np.stack([hashes, owner.astype(np.uint64)], axis=1), axis=0)
            self.tables[width] = (pairs[:, 0].copy(), pairs[:, 1].astype(np.int64))

    def hits(self, words: np.ndarray, starts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, int]]:
        """(position, item number, width) of every window of this block that occurs."""
        found = []
        for width, (hashes, owners) in self.tables.items():
            if width == WINDOW:
                at, grams = fingerprints(words, starts)
                at = at[is_in(grams, self.grams)]
                reach = WINDOW - GRAM + 1
                at = np.unique((at[:, None] - np.arange(reach)).ravel())
                doc = np.searchsorted(starts, at, side="right") - 1
                inside = (at >= 0) & (doc >= 0)
                at, doc = at[inside], doc[inside]
                at = at[at + WINDOW <= starts[doc + 1]]
            else:
                at = valid_windows(starts, width)
            own = window_hashes(words, width)[at] if len(at) else np.zeros(0, np.uint64)
            low, high = np.searchsorted(hashes, own, "left"), np.searchsorted(hashes, own, "right")
            n = high - low
            first = np.repeat(low - (np.cumsum(n) - n), n)
            found.append((np.repeat(at, n), owners[np.arange(n.sum()) + first], width))
        return found


def is_in(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Membership in a sorted table."""
    if not len(table):
        return np.zeros(len(values), bool)
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


def merged(at: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unite overlapping or touching ranges that are sorted by start."""
    if not len(at):
        return at, ends
    reach = np.maximum.accumulate(ends)
    new = np.concatenate([[True], at[1:] > reach[:-1]])
    first = np.flatnonzero(new)
    return at[first], reach[np.append(first[1:], len(at)) - 1]


def _schema(id_type: pa.DataType, item_type: pa.DataType) -> pa.Schema:
    ranges = pa.list_(pa.int32())
    return pa.schema(
        [("id", id_type), ("key", pa.int64()), ("n_words", pa.int64()), ("from", ranges), ("to", ranges), ("items", pa.list_(item_type))]
    )


def _match(batches: Iterator[pa.RecordBatch], items: Items, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    cache = WordHashes()
    for part in slices(batches, "text"):
        words, starts = cache.of([words_of(t) for t in texts_of(part, "text")])
        found = items.hits(words, starts)
        at = np.concatenate([f[0] for f in found] or [np.zeros(0, np.int64)])
        owner = np.concatenate([f[1] for f in found] or [np.zeros(0, np.int64)])
        end = np.concatenate([f[0] + f[2] for f in found] or [np.zeros(0, np.int64)])
        order = np.argsort(at, kind="stable")
        at, owner, end = at[order], owner[order], end[order]
        doc = np.searchsorted(starts, at, side="right") - 1
        low, high = np.searchsorted(doc, np.arange(part.num_rows)), np.searchsorted(doc, np.arange(part.num_rows), "right")
        froms, tos, names = [], [], []
        for d, (a, b) in enumerate(zip(low.tolist(), high.tolist())):
            if a == b:
                froms.append([]), tos.append([]), names.append([])
                continue
            x, y = merged(at[a:b], end[a:b])
            froms.append((x - starts[d]).tolist())
            tos.append((y - starts[d]).tolist())
            names.append([items.ids[i] for i in np.unique(owner[a:b]).tolist()])
        yield pa.RecordBatch.from_arrays(
            [part.column("id"), part.column("key"), pa.array(np.diff(starts)), *(pa.array(v, t.type) for v, t in zip((froms, tos, names), list(schema)[3:]))],
            schema=schema,
        )


def find_passages(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    block_words: int = 2_000_000,
) -> DataFrame:
    """Per document: ``n_words``, the ranges of hit words (``from``, ``to``) and the ``items`` found."""
    spark = docs.sparkSession
    ship(spark)
    items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text")).where(
        F.col("text").isNotNull() & F.col("item").isNotNull()
    )
    # An upper bound of the words: every word needs a character and all but the last a separator.
    size = items.agg(F.sum(F.length("text")), F.max(F.length("text"))).first()
    blocks = max(1, -(-int((size[0] or 0) / 2 + 1) // block_words))
    source = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))
    id_type, item_type = (
        pa.RecordBatch.from_pylist([], schema=_arrow(df)).schema.field(name).type
        for df, name in ((source, "id"), (items, "item"))
    )
    schema = _schema(id_type, item_type)
    out_type = (
        f"id {source.schema['id'].dataType.simpleString()}, key bigint, n_words bigint, from array<int>, to array<int>, "
        f"items array<{items.schema['item'].dataType.simpleString()}>"
    )
    found = None
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).collect()
        sent = spark.sparkContext.broadcast(Items([r[0] for r in rows], [r[1].encode() for r in rows]))
        match = lambda batches, sent=sent: _match(batches, sent.value, schema)
        part = source.mapInArrow(match, out_type)
        found = part if found is None else found.unionByName(part)
    if blocks == 1:
        return found.drop("key").withColumnRenamed("id", id_col)
    return _unite(found, blocks).withColumnRenamed("id", id_col)


def _unite(found: DataFrame, blocks: int) -> DataFrame:
    """One row per document row; rows with equal id and text have equal hits and are counted."""
    ranges = F.array_sort(F.flatten(F.collect_list(F.arrays_zip("from", "to"))))
    grouped = found.groupBy("id", "key", "n_words").agg(
        ranges.alias("_r"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), (F.count("*") / blocks).cast("int").alias("_n")
    )
    start = F.array(F.struct(F.lit(-1).alias("from"), F.lit(-1).alias("to")))
    joined = F.aggregate(
        "_r",
        start,
        lambda a, r: F.when(
            (r["from"] <= F.element_at(a, -1)["to"]),
            F.concat(
                F.slice(a, 1, F.size(a) - 1),
                F.array(F.struct(F.element_at(a, -1)["from"].alias("from"), F.greatest(F.element_at(a, -1)["to"], r["to"]).alias("to"))),
            ),
        ).otherwise(F.concat(a, F.array(F.struct(r["from"].alias("from"), r["to"].alias("to"))))),
    )
    joined = F.slice(joined, 2, 2**31 - 2)
    return grouped.withColumn("_r", joined).select(
        "id", "n_words", F.col("_r.from").alias("from"), F.col("_r.to").alias("to"), "items",
        F.explode(F.sequence(F.lit(1), "_n")).alias("_copy"),
    ).drop("_copy")


def _arrow(df: DataFrame) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df.schema)


def contamination(passages: DataFrame, share: int = 20) -> DataFrame:
    """Add ``n_hit`` and ``contaminated``: some word is hit, and at least one in ``share`` words."""
    n_hit = F.aggregate(
        F.zip_with("from", "to", lambda a, b: (b - a).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x
    )
    return passages.withColumn("n_hit", n_hit).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))
    )
