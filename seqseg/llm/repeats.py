"""Repeated passages, by windows that are grouped by their least gram.

A window is ``depth`` words (50) from any word of a document on. Equal windows are brought
together by a minimizer: the smallest ``gram``-word hash (25) inside the window. The words
before that gram are not in the key, so windows of a group need not share a prefix. Neighbouring
windows with the same least gram travel as one row. These groups stand in for suffix trees
partitioned by prefix: only equality at one depth is asked for, so no suffix is ordered and no
common-prefix length is made.

* Grams of all distinct texts are counted first; windows of a gram that only one document has
  cannot repeat and are never sent.
* A group of windows of one repeated gram is sized to memory. Its window hashes are sorted;
  equal ones are a repeated window, and the smallest document that has it keeps the words.
  Runs of repeated windows are the maximal repeats.
* A group above ``group_limit`` occurrences is dealt by the hash of the whole window: repeated
  windows are then found by an aggregation that combines before the shuffle.
* Rows meet their summary (texts by digest, occurrences by gram, windows by hash) in
  ``join_summary``: a key that holds over a thousandth of the rows is not shuffled.

Texts that are equal word for word are one text for the groups; all but the smallest id lose
every word if they have a window. Windows and texts are compared by 64-bit hashes.

Defined results: null text and short texts have no window and lose nothing; a null id is
never removed from and never removes; rows sharing an id are judged each on its own text and
never remove from each other. Only the named columns are read; empty tables give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqseg.llm.arrays import WordHashes, sliding_min, slices, texts_of, valid_windows, window_hashes
from seqseg.llm.decontaminate import is_in, merged
from seqseg.session import settle, ship

DEPTH = 50
GRAM = 25
#: Occurrences of a gram above which its windows are dealt one by one.
GROUP_LIMIT = 10_000
#: A key is heavy if it has more than one in so many of the rows; fewer keys than this can be.
HEAVY_SHARE = 1_000


def _grams(words: np.ndarray, starts: np.ndarray, depth: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gram hashes, the starts of all windows, and the place of a least gram in each."""
    grams = window_hashes(words, gram)
    at = valid_windows(starts, depth)
    least = sliding_min(grams, depth - gram + 1)[at] if len(at) else np.zeros(0, np.uint64)
    place = np.empty(len(at), np.int64)
    for shift in range(depth - gram, -1, -1):
        hit = grams[at + shift] == least
        place[hit] = at[hit] + shift
    # Of equal least grams (a word said again and again) neighbouring windows take the same one.
    span = depth - gram + 1
    even = -(-at // span) * span
    tied = grams[even] == least if len(at) else np.zeros(0, bool)
    place[tied] = even[tied]
    return grams, at, place


def _profile(batches: Iterator[pa.RecordBatch], depth: int, gram: int) -> Iterator[pa.RecordBatch]:
    cache = WordHashes()
    for part in slices(batches, "text"):
        docs = [t.split() for t in texts_of(part, "text")]
        words, starts = cache.of(docs)
        grams, _, place = _grams(words, starts, depth, gram)
        place = np.unique(place)
        counts = np.diff(np.searchsorted(place, starts))
        values = pa.array(grams[place].view(np.int64))
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), values)
        digest = [hashlib.sha256(b" ".join(d)).digest()[:16] for d in docs]
        yield pa.RecordBatch.from_arrays(
            [part.column("id"), part.column("tag"), pa.array(np.diff(starts)), pa.array(digest, pa.binary()), lists],
            names=["id", "tag", "n_words", "digest", "grams"],
        )


def _suffixes(batches: Iterator[pa.RecordBatch], depth: int, gram: int) -> Iterator[pa.RecordBatch]:
    """One row for each occurrence of a wanted gram: the windows that it is the least of."""
    cache = WordHashes()
    for part in slices(batches, "text"):
        words, starts = cache.of([t.split() for t in texts_of(part, "text")])
        grams, at, place = _grams(words, starts, depth, gram)
        wanted, hot = part.column("grams").to_pylist(), part.column("hot").to_pylist()
        doc = np.searchsorted(starts, at, side="right") - 1
        first = np.flatnonzero(np.append(True, place[1:] != place[:-1])) if len(at) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(first, len(at)))
        own = grams[place[first]].view(np.int64) if len(at) else np.zeros(0, np.int64)
        rows = np.searchsorted(doc[first], np.arange(part.num_rows + 1))
        keep, is_hot = np.zeros(len(first), bool), np.zeros(len(first), bool)
        for d in range(part.num_rows):
            span = slice(rows[d], rows[d + 1])
            keep[span] = is_in(own[span], np.unique(np.array(wanted[d], np.int64)))
            if hot[d]:
                is_hot[span] = is_in(own[span], np.unique(np.array(hot[d], np.int64)))
        nodes = window_hashes(words, depth)[at].view(np.int64) if len(at) else np.zeros(0, np.int64)
        taken = np.repeat(keep, sizes)
        lists = pa.ListArray.from_arrays(
            pa.array(np.append(0, np.cumsum(sizes[keep])), pa.int32()), pa.array(nodes[taken])
        )
        owner = pa.array(doc[first][keep])
        begin = (at[first] - starts[doc[first]])[keep].astype(np.int32) if len(at) else np.zeros(0, np.int32)
        yield pa.RecordBatch.from_arrays(
            [pa.array(own[keep]), part.column("id").take(owner), part.column("tag").take(owner), pa.array(is_hot[keep]), pa.array(begin), lists],
            names=["gram", "id", "tag", "is_hot", "start", "nodes"],
        )


def _subtree(group: pa.Table, depth: int) -> pa.RecordBatch:
    """Word ranges that a smaller document has too, for whole groups of windows."""
    rank = np.unique(group.column("id").to_numpy(), return_inverse=True)[1]
    lists = group.column("nodes").combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    nodes = lists.flatten().to_numpy()
    row = np.repeat(np.arange(group.num_rows), sizes)
    inside = np.arange(len(nodes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    order = np.lexsort((rank[row], nodes))
    by_node = nodes[order]
    new = np.append(True, by_node[1:] != by_node[:-1]) if len(nodes) else np.zeros(0, bool)
    least = rank[row][order][np.flatnonzero(new)][np.cumsum(new) - 1]
    removed = np.zeros(len(nodes), bool)
    removed[order] = rank[row][order] > least
    where = np.flatnonzero(removed)
    start = group.column("start").to_numpy()[row[where]] + inside[where]
    fresh = np.append(True, (row[where][1:] != row[where][:-1]) | (start[1:] != start[:-1] + 1)) if len(where) else np.zeros(0, bool)
    head = np.flatnonzero(fresh)
    tail = np.append(head[1:], len(where)) - 1
    owner = pa.array(row[where][head])
    return pa.RecordBatch.from_arrays(
        [
            group.column("id").combine_chunks().take(owner),
            group.column("tag").combine_chunks().take(owner),
            pa.array(start[head].astype(np.int32)),
            pa.array((start[tail] + depth).astype(np.int32) if len(head) else np.zeros(0, np.int32)),
        ],
        names=["id", "tag", "from", "to"],
    )


def _subtrees(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by gram; the last gram of a batch may go on in the next one."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        grams = batch.column("gram").to_numpy()
        cut = int(np.searchsorted(grams, grams[-1]))
        if waiting and waiting[0].column("gram")[0].as_py() != grams[-1]:
            yield _subtree(pa.Table.from_batches([*waiting, batch.slice(0, cut)]), depth)
            waiting = []
        elif cut:
            yield _subtree(pa.Table.from_batches([*waiting, batch.slice(0, cut)]), depth)
            waiting = []
        waiting.append(batch.slice(cut))
    if waiting:
        yield _subtree(pa.Table.from_batches(waiting), depth)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text"):
        kept, n_words, n_removed = [], [], []
        for text, ranges in zip(texts_of(part, "text"), part.column("ranges").to_pylist()):
            words = text.split()
            n_words.append(len(words))
            if ranges:
                pairs = sorted((r["from"], min(r["to"], len(words))) for r in ranges)
                starts, ends = merged(*(np.array(x, np.int64) for x in zip(*pairs)))
                out, at = [], 0
                for a, b in zip(starts.tolist(), ends.tolist()):
                    out += words[at:a]
                    at = b
                words, full = out + words[at:], len(words)
                n_removed.append(full - len(words))
            else:
                n_removed.append(0)
            kept.append(b" ".join(words))
        yield pa.RecordBatch.from_arrays(
            [part.column("id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
            names=["id", "n_words", "n_removed", "kept"],
        )


def join_summary(rows: DataFrame, summary: DataFrame, key: str, share: int = HEAVY_SHARE) -> DataFrame:
    """Inner join of rows with one summary row per key, whose column ``n`` counts the rows of the key.

    Keys with more than one in ``share`` of all counted rows, of which there are fewer than
    ``share`` by that definition, are joined where the rows lie; all others are shuffled, and
    none of those can fill a task. ``summary`` should be a written table.
    """
    total = summary.agg(F.sum("n")).first()[0] or 0
    is_heavy = F.col("n") > F.lit(total) / share
    heavy = summary.where(is_heavy).drop("n")
    light = rows.join(F.broadcast(heavy.select(key)), key, "left_anti")
    return light.join(summary.where(~is_heavy).drop("n"), key).unionByName(rows.join(F.broadcast(heavy), key))


def repeated_ranges(
    docs: DataFrame, depth: int = DEPTH, gram: int = GRAM, group_limit: int = GROUP_LIMIT, share: int = HEAVY_SHARE
) -> DataFrame:
    """Word ranges (id, tag, from, to) to remove; ``docs`` has id, tag and text, ids not null."""
    kind = docs.schema["id"].dataType.simpleString()
    profile = settle(
        docs.where(F.col("text").isNotNull())
        .mapInArrow(
            lambda b: _profile(b, depth, gram),
            f"id {kind}, tag int, n_words bigint, digest binary, grams array<bigint>",
        )
        .where(F.col("n_words") >= depth)
    )
    firsts = settle(profile.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")))
    known = join_summary(profile, firsts, "digest", share)
    copies = known.where(F.col("id") > F.col("first")).select(
        "id", "tag", F.lit(0).alias("from"), F.col("n_words").cast("int").alias("to")
    )
    # A row for every occurrence, also of one text: each is a row of the group later on.
    own = known.where(F.col("id") == F.col("first")).select("id", F.explode("grams").alias("gram"))
    repeated = settle(
        own.groupBy("gram")
        .agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("n"))
        .where("low < high")
        .select("gram", "n", (F.col("n") > group_limit).alias("hot"))
    )
    wanted = (
        join_summary(own, repeated, "gram", share)
        .groupBy("id")
        .agg(
            F.collect_set("gram").alias("grams"),
            F.collect_set(F.when(F.col("hot"), F.col("gram"))).alias("hot"),
        )
    )
    wanted = settle(wanted)
    suffixes = docs.join(wanted, "id").mapInArrow(
        lambda b: _suffixes(b, depth, gram),
        f"gram bigint, id {kind}, tag int, is_hot boolean, start int, nodes array<bigint>",
    )
    ranges_type = f"id {kind}, tag int, from int, to int"
    sized = (
        suffixes.where(~F.col("is_hot"))
        .select("gram", "id", "tag", "start", "nodes")
        .repartition("gram")
        .sortWithinPartitions("gram")
        .mapInArrow(lambda b: _subtrees(b, depth), ranges_type)
    )
    found = sized.unionByName(copies)
    if wanted.where(F.size("hot") > 0).limit(1).count():
        hot_rows = settle(suffixes.where("is_hot").select("id", "tag", "start", "nodes"))
        each = hot_rows.select("id", "tag", "start", F.posexplode("nodes").alias("k", "node"))
        least = each.groupBy("node").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("n"))
        least = settle(least.where("low < high").select("node", "low", "n"))
        late = join_summary(each, least, "node", share).where(F.col("id") > F.col("low"))
        begin = F.col("start") + F.col("k")
        found = found.unionByName(late.select("id", "tag", begin.alias("from"), (begin + depth).alias("to")))
    return found


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, gram: int = GRAM, group_limit: int = GROUP_LIMIT, share: int = HEAVY_SHARE
) -> DataFrame:
    """Per row: id, ``n_words``, ``n_removed`` and the ``kept`` words joined by spaces."""
    ship(docs.sparkSession)
    # The tag tells rows apart that share an id but not the text.
    source = docs.select(
        F.col(id_col).alias("id"), F.hash(F.xxhash64(text_col)).alias("tag"), F.col(text_col).alias("text")
    )
    found = repeated_ranges(source.where(F.col("id").isNotNull()), depth, gram, group_limit, share)
    ranges = found.groupBy("id", "tag").agg(F.collect_list(F.struct("from", "to")).alias("ranges"))
    ranges = ranges.withColumnsRenamed({"id": "_id", "tag": "_tag"})
    both = source.join(ranges, (F.col("id") == F.col("_id")) & (F.col("tag") == F.col("_tag")), "left")
    kind = source.schema["id"].dataType.simpleString()
    return (
        both.select("id", "text", "ranges")
        .mapInArrow(_cut, f"id {kind}, n_words bigint, n_removed bigint, kept string")
        .withColumnRenamed("id", id_col)
    )
