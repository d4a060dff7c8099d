"""Prefix trie of conversations, with members, leaves and shared bytes of every node.

Turns are dictionary-encoded: every distinct (role, text) gets an id, and conversations become
sequences of ids. Equal sequences are counted first, so that copies of one conversation are one
row with its members. Distinct sequences are sorted over the cluster by range; each task goes
through its range in shards of a bounded number of turns:

* A shard becomes a ternary search tree over turn ids. Sequences are inserted median first, which
  balances the trees of siblings. An iterative traversal from the last node to the first adds up
  members, children, leaves and savings.
* Nodes on the path of the first or last sequence of a shard may go on in a neighbour. They
  stay open as the spine of the shard; all others are final. Spines of neighbours are merged in
  order: where the next spine leaves an open path, the nodes below are closed and added to their
  parents. This happens within a task first and then over groups of tasks, round by round, until
  one group is left.

Children of an open node are final before they know its smallest member; they take it by a join
on the digest of the parent's path.

Defined results: rows with a null id belong to no conversation; null role or text is empty; turns
with the same number follow each other by role and text; repeated rows are turns of their own; an
empty table has no node, not even a root. An id modulo a number takes the sign of the id. A
conversation is one row of a few bytes a turn while it is sorted. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqseg.session import settle, ship

#: Turns of a shard, and spines that are merged in one task.
SHARD_TURNS = 100_000
SPINES = 64
#: Members in one piece of text on the way to the digest of a node.
MEMBERS = 50_000
#: Most turns that are taken from another conversation, plus one.
SHARED = 9
BATCH = 20_000


# ---- sequences


def number_turns(turns: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, place, role, text, n_bytes): turns by their number, null first."""
    source = turns.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("bigint").alias("conv"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    place = F.row_number().over(Window.partitionBy("conv").orderBy(F.asc_nulls_first("turn"), "role", "text")) - 1
    return source.select("conv", place.alias("place"), "role", "text", F.octet_length("text").cast("bigint").alias("n_bytes"))


def _digest() -> list[Column]:
    """Two independent hashes of (role, text), as the key of a turn."""
    return [F.xxhash64("role", "text").alias("h1"), F.xxhash64(F.lit(1), "text", F.lit(2), "role").alias("h2")]


def encode_turns(numbered: DataFrame) -> DataFrame:
    """(conv, place, turn, n_bytes) with one id for each distinct turn."""
    keyed = settle(numbered.select("conv", "place", *_digest(), "n_bytes"))
    dictionary = settle(keyed.select("h1", "h2").distinct().withColumn("turn", F.monotonically_increasing_id()))
    return keyed.join(dictionary, ["h1", "h2"]).select("conv", "place", "turn", "n_bytes")


def rebuilt(encoded: DataFrame, group: int = 5, shared: int = SHARED) -> DataFrame:
    """(conv, steps): sequences with the first turns of the first conversation of their group.

    ``steps`` are (turn, n_bytes) in order. The first h turns come from the conversation whose id
    is the next multiple of ``group`` towards zero, h being a checksum of the id modulo ``shared``.
    """
    step = F.struct("place", "turn", "n_bytes")
    own = encoded.groupBy("conv").agg(F.sort_array(F.collect_list(step)).alias("steps"))
    own = settle(own.select("conv", F.transform("steps", lambda s: F.struct(s["turn"].alias("turn"), s["n_bytes"].alias("n_bytes"))).alias("steps")))
    heads = own.where(F.col("conv") % group == 0).select(F.col("conv").alias("source"), F.slice("steps", 1, shared - 1).alias("head"))
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % shared).cast("int")
    split = own.select("conv", "steps", (F.col("conv") - F.col("conv") % group).alias("source"), h.alias("h"))
    empty = F.expr("cast(array() as array<struct<turn:bigint,n_bytes:bigint>>)")
    head = F.slice(F.coalesce("head", empty), F.lit(1), F.col("h"))
    tail = F.slice("steps", F.col("h") + 1, F.greatest(F.size("steps"), F.lit(1)))
    return split.join(heads, "source", "left").select("conv", F.concat(head, tail).alias("steps"))


# ---- equal sequences


def _pieces(batches: Iterator[pa.RecordBatch], members: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows with the same key as (key, first, n, text of all ids)."""
    key, ids, steps = None, [], None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [
                pa.array([key], pa.binary()), pa.array([ids[0]], pa.int64()), pa.array([len(ids)], pa.int64()),
                pa.array([",".join(map(str, ids))]), steps,
            ],
            names=["key", "first", "n", "text", "steps"],
        )

    for batch in batches:
        for i, (k, conv) in enumerate(zip(batch.column("key").to_pylist(), batch.column("conv").to_pylist())):
            if ids and (k != key or len(ids) >= members):
                yield row()
                ids = []
            if not ids:
                key, steps = k, batch.column("steps").slice(i, 1)
            ids.append(conv)
    if ids:
        yield row()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per key out of its pieces, which come in order: the members are hashed piece by piece."""
    key, out = None, []

    def flush() -> pa.RecordBatch:
        columns = list(zip(*[(low, n, digest.hexdigest()) for low, n, digest, _ in out]))
        steps = pa.concat_arrays([s for *_, s in out])
        kinds = (pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(columns, kinds)), steps], names=["low", "n", "ends", "steps"])

    for batch in batches:
        parts = (batch.column(c).to_pylist() for c in ("key", "first", "n", "text"))
        for i, (k, first, n, text) in enumerate(zip(*parts)):
            if out and k == key:
                low, before, digest, steps = out[-1]
                digest.update(b"," + text.encode())
                out[-1] = (low, before + n, digest, steps)
                continue
            if len(out) >= BATCH:
                yield flush()
                out = []
            key = k
            out.append((first, n, hashlib.sha256(text.encode()), batch.column("steps").slice(i, 1)))
    if out:
        yield flush()


_STEPS = "steps array<struct<turn:bigint,n_bytes:bigint>>"


def distinct_sequences(sequences: DataFrame, members: int = MEMBERS) -> DataFrame:
    """(low, n, ends, steps): distinct sequences with their smallest member, members and digest of these.

    Members are sorted by (sequence, id) over the cluster and joined to pieces of text; only
    pieces of one sequence meet in a task, which hashes them as they come.
    """
    ids = F.transform("steps", lambda s: s["turn"])
    key = F.unhex(F.md5(F.array_join(ids, ",").cast("binary")))
    keyed = settle(sequences.select(key.alias("key"), "conv", "steps"))
    pieces = (
        keyed.repartitionByRange("key", "conv")
        .sortWithinPartitions("key", "conv")
        .mapInArrow(lambda b: _pieces(b, members), f"key binary, first bigint, n bigint, text string, {_STEPS}")
    )
    return (
        pieces.repartition("key")
        .sortWithinPartitions("key", "first")
        .mapInArrow(_digests, f"low bigint, n bigint, ends string, {_STEPS}")
    )


# ---- tree of a shard

_NONE = hashlib.sha256(b"").hexdigest()


class Tree:
    """Ternary search tree of one shard; node 0 is the root of all sequences."""

    def __init__(self) -> None:
        self.turn: list[int] = [0]
        self.n_bytes, self.depth, self.parent = [0], [0], [-1]
        self.less, self.more, self.down = [-1], [-1], [-1]
        self.n, self.low = [0], [None]
        self.ends: list[str] = [_NONE]

    def _new(self, parent: int, turn: int, n_bytes: int) -> int:
        for column, value in (
            (self.turn, turn), (self.n_bytes, n_bytes), (self.depth, self.depth[parent] + 1), (self.parent, parent),
            (self.less, -1), (self.more, -1), (self.down, -1), (self.n, 0), (self.low, None), (self.ends, _NONE),
        ):
            column.append(value)
        return len(self.turn) - 1

    def insert(self, turns: list[int], sizes: list[int], n: int, low: int, ends: str) -> list[int]:
        """Add a sequence; returns its path."""
        path = [0]
        for turn, size in zip(turns, sizes):
            parent = path[-1]
            node = self.down[parent]
            if node < 0:
                node = self.down[parent] = self._new(parent, turn, size)
            while turn != self.turn[node]:
                side = self.less if turn < self.turn[node] else self.more
                if side[node] < 0:
                    side[node] = self._new(parent, turn, size)
                node = side[node]
            path.append(node)
        last = path[-1]
        self.n[last], self.low[last], self.ends[last] = n, low, ends
        return path

    def preorder(self) -> list[int]:
        """All nodes, parents first, siblings by turn."""
        out, stack = [], [(0, False)]
        while stack:
            node, ready = stack.pop()
            if not ready:
                if self.more[node] >= 0:
                    stack.append((self.more[node], False))
                stack.append((node, True))
                if self.less[node] >= 0:
                    stack.append((self.less[node], False))
                continue
            out.append(node)
            if self.down[node] >= 0:
                stack.append((self.down[node], False))
        return out


def medians(n: int) -> Iterator[int]:
    """0..n-1, the middle of every stretch before its halves."""
    stack = [(0, n)]
    while stack:
        a, b = stack.pop()
        if a < b:
            middle = (a + b) // 2
            yield middle
            stack += [(middle + 1, b), (a, middle)]


#: A node on a spine: its place, what is known of it, and what its final children add up to.
SPINE = ("depth", "turn", "n_bytes", "n", "low", "ends", "n_children", "n_leaves", "saved", "leading")


def _extend(digest, turn: int):
    out = digest.copy()
    out.update(turn.to_bytes(8, "little", signed=True))
    return out


class Spine:
    """Merges the spines of neighbours and collects final nodes.

    ``open`` is the path of the last sequence so far. With ``whole`` the first spine has no
    neighbour before it, otherwise nodes on its first path are kept for the next round.
    """

    def __init__(self, whole: bool) -> None:
        self.whole = whole
        self.open: list[dict] = []
        self.kept: list[dict] = []
        self.final: list[tuple] = []
        self.started = False

    def close(self, depth: int) -> None:
        """Close open nodes at ``depth`` and below."""
        while len(self.open) > depth:
            node = self.open.pop()
            if node["leading"]:
                self.kept.append(node)
                continue
            parent = self.open[-1] if self.open else None
            leaves = node["n_leaves"] if node["n_children"] else 1
            saved = node["saved"] + (node["n"] - 1) * node["n_bytes"]
            if parent is not None:
                parent["n_children"] += 1
                parent["n_leaves"] += leaves
                parent["saved"] += saved
            self.final.append(
                (
                    node["low"], node["depth"], None, node["n"], node["n_children"], leaves, saved, node["ends"],
                    node["digest"].digest(), parent["digest"].digest() if parent is not None else None,
                )
            )

    def add(self, rows: list[dict]) -> None:
        """The next spine: its open nodes, parents first, in order."""
        for row in rows:
            depth = row["depth"]
            if len(self.open) > depth and self.open[depth]["turn"] == row["turn"]:
                node = self.open[depth]
                node["n"] += row["n"]
                node["low"] = row["low"] if node["low"] is None else node["low"] if row["low"] is None else min(node["low"], row["low"])
                node["ends"] = row["ends"] if node["ends"] == _NONE else node["ends"]
                for name in ("n_children", "n_leaves", "saved"):
                    node[name] += row[name]
                continue
            self.close(depth)
            digest = _extend(self.open[-1]["digest"], row["turn"]) if self.open else hashlib.md5(usedforsecurity=False)
            leading = row["leading"] and not self.started and not self.whole
            self.open.append(row | {"digest": digest, "leading": leading})
        self.started = True

    def rows(self) -> list[dict]:
        """What is left open, parents first."""
        leading = [n for n in self.open if n["leading"]] + self.kept[::-1]
        return leading + [n for n in self.open if not n["leading"]]

    def take_final(self) -> list[tuple]:
        out, self.final = self.final, []
        return out


def shard_nodes(rows: list[tuple]) -> tuple[list[tuple], list[dict]]:
    """Final nodes and the spine of a sorted run of sequences (low, n, ends, turns, sizes)."""
    tree, paths = Tree(), {}
    for i in medians(len(rows)):
        low, n, ends, turns, sizes = rows[i]
        path = tree.insert(turns, sizes, n, low, ends)
        if i in (0, len(rows) - 1):
            paths[i] = path
    first, last = paths[0], paths[len(rows) - 1]
    edge = set(first) | set(last)
    order = tree.preorder()
    count = len(tree.turn)
    n, low = tree.n, tree.low
    children, leaves, saved = [0] * count, [0] * count, [0] * count
    for node in reversed(order):
        if node not in edge:
            leaves[node] = leaves[node] or 1
            saved[node] += (n[node] - 1) * tree.n_bytes[node]
        up = tree.parent[node]
        if up < 0:
            continue
        n[up] += n[node]
        low[up] = low[node] if low[up] is None else min(low[up], low[node])
        if node not in edge:
            children[up] += 1
            leaves[up] += leaves[node]
            saved[up] += saved[node]
    digests = {0: hashlib.md5(usedforsecurity=False)}
    for path in (first, last):
        for up, node in zip(path, path[1:]):
            digests.setdefault(node, _extend(digests[up], tree.turn[node]))
    final, spine, leading = [], [], set(first)
    for node in order:
        if node in edge:
            values = (
                tree.depth[node], tree.turn[node], tree.n_bytes[node], n[node], low[node], tree.ends[node],
                children[node], leaves[node], saved[node], node in leading,
            )
            spine.append(dict(zip(SPINE, values)))
            continue
        up = tree.parent[node]
        known, key = (None, digests[up].digest()) if up in edge else (low[up], None)
        final.append((low[node], tree.depth[node], known, n[node], children[node], leaves[node], saved[node], tree.ends[node], None, key))
    return final, spine


NODE = {
    "conv_id": pa.int64(), "depth": pa.int64(), "parent_conv_id": pa.int64(), "n_convs": pa.int64(), "n_children": pa.int64(),
    "n_leaves": pa.int64(), "saved_tokens": pa.int64(), "ends_sha256": pa.string(), "path": pa.binary(), "parent_path": pa.binary(),
}
_SPINE_KINDS = {
    "depth": pa.int64(), "turn": pa.int64(), "n_bytes": pa.int64(), "n": pa.int64(), "low": pa.int64(), "ends": pa.string(),
    "n_children": pa.int64(), "n_leaves": pa.int64(), "saved": pa.int64(), "leading": pa.bool_(),
}
_SQL = {pa.int64(): "bigint", pa.string(): "string", pa.binary(): "binary", pa.bool_(): "boolean"}
#: A row is either a final node or a node of a spine (``part`` is the task it comes from).
_ROW = {"part": pa.int64(), "at": pa.int64(), **NODE, **{f"s_{k}": v for k, v in _SPINE_KINDS.items()}}
_ROW_TYPE = ", ".join(f"{k} {_SQL[v]}" for k, v in _ROW.items())


def _batch(part: int, final: list[tuple], spine: list[dict]) -> Iterator[pa.RecordBatch]:
    blank_node, blank_spine = (None,) * len(NODE), (None,) * len(SPINE)
    rows = [(None, None, *f, *blank_spine) for f in final]
    rows += [(part, i, *blank_node, *(s[k] for k in SPINE)) for i, s in enumerate(spine)]
    for a in range(0, len(rows), BATCH):
        columns = zip(*rows[a : a + BATCH])
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _ROW.values())], names=list(_ROW))


def _shards(batches: Iterator[pa.RecordBatch], shard_turns: int) -> Iterator[pa.RecordBatch]:
    """Sorted sequences of a task to final nodes and one spine."""
    task = TaskContext.get()
    part = task.partitionId() if task else 0
    spine, rows, turns = Spine(False), [], 0

    def shard() -> Iterator[pa.RecordBatch]:
        final, own = shard_nodes(rows)
        spine.add(own)
        yield from _batch(part, final + spine.take_final(), [])

    for batch in batches:
        steps = batch.column("steps")
        offsets = steps.offsets.to_numpy()
        flat = steps.values
        ids, sizes = flat.field("turn").to_numpy(), flat.field("n_bytes").to_numpy()
        parts = (batch.column(c).to_pylist() for c in ("low", "n", "ends"))
        for low, n, ends, a, b in zip(*parts, offsets[:-1].tolist(), offsets[1:].tolist()):
            rows.append((low, n, ends, ids[a:b].tolist(), sizes[a:b].tolist()))
            turns += b - a + 1
            if turns >= shard_turns:
                yield from shard()
                rows, turns = [], 0
    if rows:
        yield from shard()
    yield from _batch(part, [], spine.rows())


def _merge(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
    """Spines sorted by (group, part, at) to final nodes and one spine per group."""
    group, part, spine, rows = None, None, Spine(whole), []

    def finish() -> Iterator[pa.RecordBatch]:
        spine.add(rows)
        if whole:
            spine.close(0)
        yield from _batch(group, spine.take_final(), spine.rows())

    for batch in batches:
        columns = [batch.column(f"s_{k}").to_pylist() for k in SPINE]
        for g, p, *values in zip(batch.column("group").to_pylist(), batch.column("part").to_pylist(), *columns):
            if p != part or g != group:
                if group is not None and g != group:
                    yield from finish()
                    spine = Spine(whole)
                elif rows:
                    spine.add(rows)
                group, part, rows = g, p, []
            rows.append(dict(zip(SPINE, values)))
    if group is not None:
        yield from finish()


def trie(sequences: DataFrame, shard_turns: int = SHARD_TURNS, spines: int = SPINES, members: int = MEMBERS) -> DataFrame:
    """All nodes of the trie of (conv, steps)."""
    ship(sequences.sparkSession)
    distinct = settle(distinct_sequences(sequences, members))
    order = F.transform("steps", lambda s: s["turn"])
    shards = distinct.withColumn("order", order).repartitionByRange("order").sortWithinPartitions("order")
    found = settle(shards.select("low", "n", "ends", "steps").mapInArrow(lambda b: _shards(b, shard_turns), _ROW_TYPE))
    nodes, open_nodes = found.where("part IS NULL"), found.where("part IS NOT NULL")
    while True:
        # Parts are numbered by the tasks of the round before: their number shrinks by ``spines``.
        parts = open_nodes.agg(F.max("part")).first()[0]
        if parts is None:
            break
        whole = parts < spines
        group = F.expr(f"part div {spines}")
        merged = (
            open_nodes.withColumn("group", group)
            .repartition("group")
            .sortWithinPartitions("group", "part", "at")
            .mapInArrow(lambda b, whole=whole: _merge(b, whole), _ROW_TYPE)
        )
        merged = settle(merged)
        nodes = nodes.unionByName(merged.where("part IS NULL"))
        if whole:
            break
        open_nodes = merged.where("part IS NOT NULL")
    parents = nodes.where(F.col("path").isNotNull()).select(F.col("path").alias("parent_path"), F.col("conv_id").alias("_up"))
    full = nodes.join(parents, "parent_path", "left")
    return full.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_up")).select([c for c in NODE if "path" not in c])


def conversation_trie(
    turns: DataFrame,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    group: int = 5,
    shared: int = SHARED,
    **sizes: int,
) -> DataFrame:
    """Nodes of the trie of the rebuilt conversations of a table of turns."""
    numbered = number_turns(turns, id_col, turn_col, role_col, text_col)
    return trie(rebuilt(encode_turns(numbered), group, shared), **sizes)
