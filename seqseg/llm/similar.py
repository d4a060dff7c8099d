"""Documents whose sets of word shingles are nearly equal, by parity sketches.

Two sets of a and b shingles with Jaccard similarity s or more differ in at most
``(a + b) (1 - s) / (1 + s)`` shingles. Sets of similar size share a band; for the largest
difference k that a pair of a band may have, the shingles are hashed into m > k blocks, and each
block XORs the hashes of its shingles. A shingle that only one set has changes one block, so the
Hamming distance of the sketches bounds the symmetric difference from below, and at least
m - k blocks of a linked pair are equal (pigeonhole). Documents are joined on (band, block,
value). Blocks without shingles are left out where a document has more than k others, which
is enough for the pigeonhole; the few documents that have not use all their blocks.

* Buckets of up to ``SMALL`` documents yield all their pairs. A larger bucket yields pairs
  with its first document and between neighbours, which is linear, and is remembered.
* Pairs are tested by their bit sketches (16 bits a block, one bit flipped per shingle),
  then verified on the sets. Equal sets are recognised by a digest; where a bucket is large,
  each is linked with the smallest id of its digest.
* Remembered buckets whose documents are still in several components are compared inside
  tasks, sketch against sketch, only across components; buckets above ``TILE`` documents are
  cut into tiles. Only pairs that pass the sketch test leave the task and are verified.

The result is the connected components, so copies are never expanded into all pairs.

Defined results: null text and text without words have no shingles and no links; a null id
has no links and no component; rows that share an id are one node. Ids must be integers.
Only the named columns are read; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqseg.llm.arrays import WordHashes, mix, slices, texts_of, valid_windows, window_hashes
from seqseg.llm.components import components
from seqseg.session import settle, ship

SHINGLE = 4
SIMILAR = 85  # percent
SMALL, TILE = 8, 2048
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def _bands(ratio: float = 1.25) -> np.ndarray:
    """Smallest size of every band."""
    return np.unique(np.ceil(ratio ** np.arange(160)).astype(np.int64))


BANDS = _bands()


def largest_difference(smaller: np.ndarray, percent: int) -> np.ndarray:
    """Most shingles in which a set of this size can differ from a linked one that is not smaller."""
    # With a <= b <= a / s: (a + b) (1 - s) / (1 + s) <= a (1 - s) / s.
    return smaller * (100 - percent) // percent


def blocks_of(band: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """k and m of bands."""
    top = np.append(BANDS[1:], BANDS[-1] * 2) - 1
    k = largest_difference(top[band], percent)
    return k, k + 3 + (k + 1) // 20


def shingle_sets(texts: list[bytes], cache: WordHashes, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every document, and where each document's begin."""
    words, starts = cache.of([t.translate(_LOWER).split() for t in texts])
    lengths = np.diff(starts)
    at = valid_windows(starts, size)
    owner = [np.searchsorted(starts, at, side="right") - 1]
    hashes = [window_hashes(words, size)[at] if len(at) else np.zeros(0, np.uint64)]
    for short in range(1, size):  # the whole sequence is the one shingle
        docs = np.flatnonzero(lengths == short)
        if len(docs):
            owner.append(docs)
            hashes.append(mix(window_hashes(words, short)[starts[docs]] + np.uint64(short)))
    owners, values = np.concatenate(owner), np.concatenate(hashes)
    order = np.lexsort((values, owners))
    owners, values = owners[order], values[order]
    new = np.append(True, (values[1:] != values[:-1]) | (owners[1:] != owners[:-1])) if len(values) else np.zeros(0, bool)
    return values[new], np.searchsorted(owners[new], np.arange(len(texts) + 1))


def _memberships(n: np.ndarray, percent: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(documents, band) for the own band and, where a linked smaller set may lie in it, the band below."""
    docs = np.flatnonzero(n)
    band = np.searchsorted(BANDS, n[docs], side="right") - 1
    top = BANDS[band] - 1  # largest size of the band below
    low = (band > 0) & (n[docs] * percent <= 100 * top)
    return [(docs, band), (docs[low], band[low] - 1)]


def _blocks(values: np.ndarray, starts: np.ndarray, docs: np.ndarray, band: np.ndarray, percent: int):
    """For documents in bands: mixed hashes, their block (numbered through), first block and k of each document."""
    k, m = blocks_of(band, percent)
    sizes = np.diff(starts)[docs]
    at = np.repeat(starts[docs] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    mixed = mix(values[at])
    first = np.concatenate([[0], np.cumsum(m)])
    place = np.repeat(first[:-1], sizes) + (mixed % np.repeat(m, sizes).astype(np.uint64)).astype(np.int64)
    return mixed, place, first, k


def _keys(batches: Iterator[pa.RecordBatch], size: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Join keys: one row per block; the size is negative in the band below the own one."""
    cache = WordHashes()
    for part in slices(batches, "text"):
        values, starts = shingle_sets(texts_of(part, "text"), cache, size)
        n = np.diff(starts)
        for sign, (docs, band) in zip((1, -1), _memberships(n, percent)):
            mixed, place, first, k = _blocks(values, starts, docs, band, percent)
            value, count = np.zeros(first[-1], np.uint64), np.bincount(place, minlength=first[-1])
            np.bitwise_xor.at(value, place, mixed)
            owner = np.repeat(np.arange(len(docs)), np.diff(first))
            full = np.bincount(owner[count > 0], minlength=len(docs))
            keep = (count > 0) | (full <= k)[owner]
            number = np.arange(first[-1]) - first[owner]
            where = (band[owner].astype(np.uint64) << np.uint64(40)) + number.astype(np.uint64)
            key = mix(value ^ mix(where + np.uint64(1)))[keep].view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key), part.column("id").take(pa.array(docs[owner[keep]])), pa.array((sign * n[docs])[owner[keep]].astype(np.int32))],
                names=["key", "id", "n"],
            )


def _near_size(a: int, b: int, percent: int) -> bool:
    return 100 * min(a, b) >= percent * max(a, b)


class _Bucket:
    """Rows of one key, in the order of ids, as they come."""

    def __init__(self, key: int) -> None:
        self.key, self.rows, self.large = key, [], False

    def add(self, row: tuple[int, int], percent: int, pairs: set, members: list) -> None:
        (i, n), size = row, abs(row[1])
        if self.rows and self.rows[-1][0] == i and self.rows[-1][1] == n:
            return
        if not self.large and len(self.rows) < SMALL:
            pairs.update((a, i) for a, b in self.rows if a != i and _near_size(abs(b), size, percent))
            self.rows.append(row)
            return
        if not self.large:
            members += [(self.key, a, b) for a, b in self.rows]
            self.large = True
        for a, b in (self.rows[0], self.rows[-1]):
            if a != i and _near_size(abs(b), size, percent):
                pairs.add((a, i))
        members.append((self.key, i, n))
        self.rows = [self.rows[0], row]


def _candidates(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, id) to pairs (key null) and members of large buckets (b null)."""
    bucket: _Bucket | None = None
    for batch in batches:
        pairs: set[tuple[int, int]] = set()
        members: list[tuple[int, int, int]] = []
        key = batch.column("key").to_numpy()
        if not len(key):
            continue
        same = key[1:] == key[:-1]
        busy = np.append(same, False) | np.append(False, same)
        busy[-1] = True
        busy[0] |= bucket is not None and bucket.key == key[0]
        at = np.flatnonzero(busy)
        ids, sizes = batch.column("id").to_numpy(zero_copy_only=False)[at], batch.column("n").to_numpy()[at]
        for k, i, n in zip(key[at].tolist(), ids.tolist(), sizes.tolist()):
            if bucket is None or bucket.key != k:
                bucket = _Bucket(k)
            bucket.add((i, n), percent, pairs, members)
        a = [p[0] for p in pairs] + [m[1] for m in members]
        b = [p[1] for p in pairs] + [None] * len(members)
        keys = [None] * len(pairs) + [m[0] for m in members]
        n = [None] * len(pairs) + [m[2] for m in members]
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int32())],
            names=["key", "a", "b", "n"],
        )


def _profiles(batches: Iterator[pa.RecordBatch], size: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Set, digest and bit sketches (of the own band and the one below) of documents."""
    cache = WordHashes()
    for part in slices(batches, "text"):
        values, starts = shingle_sets(texts_of(part, "text"), cache, size)
        n = np.diff(starts)
        sketches = []
        for docs, band in _memberships(n, percent):
            mixed, place, first, _ = _blocks(values, starts, docs, band, percent)
            bits = np.zeros(first[-1], np.uint16)
            np.bitwise_xor.at(bits, place, np.uint16(1) << ((mixed >> np.uint64(44)) % np.uint64(16)).astype(np.uint16))
            own: list[bytes | None] = [None] * part.num_rows
            for d, a, b in zip(docs.tolist(), first[:-1].tolist(), first[1:].tolist()):
                own[d] = bits[a:b].tobytes()
            sketches.append(pa.array(own, pa.binary()))
        total = np.concatenate([[np.uint64(0)], np.cumsum(mix(values), dtype=np.uint64)])
        digest = (total[starts[1:]] - total[starts[:-1]]).view(np.int64)
        sets = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(values.view(np.int64)))
        yield pa.RecordBatch.from_arrays(
            [part.column("id"), pa.array(n, pa.int32()), pa.array(digest), *sketches, sets],
            names=["id", "n", "digest", "sketch", "below", "set"],
        )


def _sketch_test(na: int, nb: int, a: tuple, b: tuple, percent: int) -> bool:
    """Whether sketches leave a link possible; a and b are (own, below) sketches."""
    small, large = ((na, a), (nb, b)) if na <= nb else ((nb, b), (na, a))
    band, other = (np.searchsorted(BANDS, x[0], side="right") for x in (small, large))
    x, y = small[1][0], large[1][0] if band == other else large[1][1]
    if y is None:
        return False
    differ = int(np.bitwise_count(np.frombuffer(x, np.uint16) ^ np.frombuffer(y, np.uint16)).sum(dtype=np.int64))
    return differ * (100 + percent) <= (na + nb) * (100 - percent)


def _sift(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs that are equal (verified) or pass the sketch test (not yet)."""
    names = ["na", "nb", "da", "db", "sa", "sb", "la", "lb"]
    for batch in batches:
        keep, sure = [], []
        for i, (na, nb, da, db, sa, sb, la, lb) in enumerate(zip(*(batch.column(c).to_pylist() for c in names))):
            equal = na == nb and da == db
            if na and nb and (equal or _near_size(na, nb, percent) and _sketch_test(na, nb, (sa, la), (sb, lb), percent)):
                keep.append(i)
                sure.append(equal)
        at = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column("a").take(at), batch.column("b").take(at), pa.array(sure, pa.bool_())], names=["a", "b", "sure"]
        )


def _verify(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        sets = [batch.column(c) for c in ("set_a", "set_b")]
        for i in range(batch.num_rows):
            x, y = (s[i].values.to_numpy() for s in sets)
            both = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * both >= percent * (len(x) + len(y) - both):
                keep.append(i)
        at = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("a").take(at), batch.column("b").take(at)], names=["a", "b"])


def _across(group: pa.Table, percent: int) -> pa.RecordBatch:
    """Pairs of one bucket (or tile of one) in different components that pass the sketch test."""
    out_a: list[np.ndarray] = []
    out_b: list[np.ndarray] = []
    ids, comp, n = (group.column(c).to_numpy() for c in ("id", "component", "n"))
    left, right = group.column("chunk").to_numpy() == group.column("t1")[0].as_py(), group.column("chunk").to_numpy() == group.column("t2")[0].as_py()
    sketches = group.column("sketch").to_pylist()
    width = max(map(len, sketches))
    usable = np.array([len(s) == width for s in sketches])  # a foreign key with an equal hash has another width
    bits = np.zeros((len(ids), width // 2), np.uint16)
    for i in np.flatnonzero(usable):
        bits[i] = np.frombuffer(sketches[i], np.uint16)
    rows, cols = np.flatnonzero(left & usable), np.flatnonzero(right & usable)
    step = max(1, (8 << 20) // max(1, len(cols) * (width // 2)))
    for a in range(0, len(rows), step):
        r = rows[a : a + step]
        fit = (comp[r][:, None] != comp[cols][None]) & (ids[r][:, None] != ids[cols][None])
        small, large = np.minimum(n[r][:, None], n[cols][None]), np.maximum(n[r][:, None], n[cols][None])
        fit &= 100 * small >= percent * large
        r = r[fit.any(axis=1)]
        fit = fit[fit.any(axis=1)]
        if not len(r):
            continue
        differ = np.bitwise_count(bits[r][:, None, :] ^ bits[cols][None]).sum(axis=2, dtype=np.int64)
        fit &= differ * (100 + percent) <= (n[r][:, None] + n[cols][None]) * (100 - percent)
        i, j = np.nonzero(fit)
        out_a.append(np.minimum(ids[r[i]], ids[cols[j]]))
        out_b.append(np.maximum(ids[r[i]], ids[cols[j]]))
    a = np.concatenate(out_a or [np.zeros(0, np.int64)])
    b = np.concatenate(out_b or [np.zeros(0, np.int64)])
    return pa.RecordBatch.from_arrays([pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64))], names=["a", "b"])


def _compare(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, t1, t2), a group at a time; a group is bounded by two tiles."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy() for c in ("key", "t1", "t2")])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            part = batch.slice(a, b - a)
            if waiting and any(waiting[0].column(c)[0] != part.column(c)[0] for c in ("key", "t1", "t2")):
                yield _across(pa.Table.from_batches(waiting), percent)
                waiting = []
            waiting.append(part)
    if waiting:
        yield _across(pa.Table.from_batches(waiting), percent)


def _links(pairs: DataFrame, profiles: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    light = lambda side, short: profiles.select(
        F.col("id").alias(side), F.col("n").alias(f"n{short}"), F.col("digest").alias(f"d{short}"),
        F.col("sketch").alias(f"s{short}"), F.col("below").alias(f"l{short}"),
    )
    joined = pairs.join(light("a", "a"), "a").join(light("b", "b"), "b")
    sifted = settle(joined.mapInArrow(lambda b: _sift(b, percent), "a bigint, b bigint, sure boolean"))
    sets = lambda side: profiles.select(F.col("id").alias(side), F.col("set").alias(f"set_{side}"))
    unsure = sifted.where(~F.col("sure")).select("a", "b").join(sets("a"), "a").join(sets("b"), "b")
    verified = unsure.mapInArrow(lambda b: _verify(b, percent), "a bigint, b bigint")
    return settle(sifted.where("sure").select("a", "b").unionByName(verified))


def _equal(profiles: DataFrame) -> DataFrame:
    """Links (a, b) from the smallest id of every set to each other id that has it."""
    first = profiles.groupBy("digest", "n").agg(F.min("id").alias("a"), F.max("id").alias("last")).where("a < last")
    return settle(profiles.join(first.drop("last"), ["digest", "n"]).where("a < id").select("a", F.col("id").alias("b")))


def similar_links(docs: DataFrame, size: int = SHINGLE, percent: int = SIMILAR) -> DataFrame:
    """Links (a, b) that connect the components of similar documents; ``docs`` has id and text."""
    found = settle(
        docs.mapInArrow(lambda b: _keys(b, size, percent), "key bigint, id bigint, n int")
        .repartition("key")
        .sortWithinPartitions("key", "id", "n")
        .mapInArrow(lambda b: _candidates(b, percent), "key bigint, a bigint, b bigint, n int")
    )
    pairs = found.where(F.col("key").isNull()).select("a", "b").distinct()
    large = found.where(F.col("key").isNotNull()).select("key", F.col("a").alias("id"), "n")
    involved = found.select(F.explode(F.array("a", "b")).alias("id")).where(F.col("id").isNotNull()).distinct()
    profiles = settle(
        docs.join(involved, "id").mapInArrow(
            lambda b: _profiles(b, size, percent),
            "id bigint, n int, digest bigint, sketch binary, below binary, set array<bigint>",
        )
    )
    links = _links(pairs, profiles, percent)
    if not large.limit(1).count():
        return links
    links = links.unionByName(_equal(profiles))
    known = components(links).withColumnRenamed("node", "id")
    # One document per set is enough: equal sets are linked already.
    single = profiles.groupBy("digest", "n").agg(F.min("id").alias("id")).select("id")
    sketch = profiles.select("id", "sketch", "below").join(single, "id", "left_semi")
    placed = (
        large.join(sketch, "id")
        .join(known, "id", "left")
        .select(
            "key", "id", F.abs("n").alias("n"), F.coalesce("component", "id").alias("component"),
            F.when(F.col("n") > 0, F.col("sketch")).otherwise(F.col("below")).alias("sketch"),
        )
        .where(F.col("sketch").isNotNull())
    )
    mixed = (
        placed.groupBy("key")
        .agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size"))
        .where("low < high")
        .select("key", F.ceil(F.col("size") / TILE).cast("int").alias("chunks"))
    )
    tiled = (
        placed.join(mixed, "key")
        .withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select(
            "key", F.least("chunk", "other").alias("t1"), F.greatest("chunk", "other").alias("t2"),
            "chunk", "id", "n", "component", "sketch",
        )
        .repartition("key", "t1", "t2")
        .sortWithinPartitions("key", "t1", "t2")
    )
    across = tiled.mapInArrow(lambda b: _compare(b, percent), "a bigint, b bigint").distinct()
    return links.unionByName(_links(across, profiles, percent))


def _sizes(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    cache = WordHashes()
    for part in slices(batches, "text"):
        _, starts = shingle_sets(texts_of(part, "text"), cache, size)
        yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(np.diff(starts), pa.int64())], names=["id", "n_shingles"])


def similar_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = SIMILAR
) -> DataFrame:
    """Per row: id, ``n_shingles`` and ``component_id``, the smallest id reachable by links."""
    ship(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    links = similar_links(source.where(F.col("id").isNotNull() & F.col("text").isNotNull()), size, percent)
    found = components(links).withColumnRenamed("component", "_component")
    sized = source.mapInArrow(lambda b: _sizes(b, size), "id bigint, n_shingles bigint")
    joined = sized.join(found, sized["id"] == found["node"], "left")
    return joined.select(
        F.col("id").alias(id_col), "n_shingles", F.coalesce("_component", "id").alias("component_id")
    )
