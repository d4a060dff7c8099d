"""BPE by guessing and checking: encoding texts to token ids and decoding ids to texts.

Words (pieces of the pre-tokenisation) are first cut greedily into the longest vocabulary
entries. The guess for a word is right if every token is what merging makes of its own bytes
and no merge crosses the border of two neighbours. The second is tested for all adjacent pairs
at once: the right edge of the left token and the left edge of the right one are taken apart in
reverse order of their merges; a merge of the two edge parts that would have come before either
was used up refutes the pair. Only words with a refuted pair, or with a token that merging does
not make of its bytes, are merged exactly.

The vocabulary file (its size does not depend on the data) is read on the driver and sent to
the tasks once, as arrays. Words seen lately keep their ids in a bounded cache. Ids are packed
as little-endian unsigned 32-bit integers in a binary column.

Defined results: null text is empty and has no ids; strings of added tokens in a text are that
token, as the file says; ids that the vocabulary lacks decode to nothing; bytes that are no
UTF-8 decode to replacement characters. Repeated rows are encoded one by one. Only the named
columns are read. A file with other settings than byte-level splitting is refused.
"""

from __future__ import annotations

import heapq
import json
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqseg.llm.arrays import slices
from seqseg.llm.bpe import piece_starts
from seqseg.session import ship

NEVER = np.int64(1 << 40)
#: Words kept with their ids by a task, and the longest word that is kept.
KEPT_WORDS, KEPT_LENGTH = 250_000, 64
#: Bytes of words whose longest matches are searched at a time.
CHUNK = 1 << 20
#: Failing words up to this many bytes are merged side by side, longer ones each by a heap.
TOGETHER = 64


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in a vocabulary file."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = [""] * 256
    for b in plain:
        letters[b] = chr(b)
    for i, b in enumerate(b for b in range(256) if not letters[b]):
        letters[b] = chr(0x100 + i)
    return letters


@dataclass
class Vocabulary:
    """``rank``, ``left`` and ``right``: the merge that makes a token (rank -1: a single byte).

    ``pair_keys`` (sorted) and ``pair_ranks`` list the merges by left * size + right, ``made`` the
    tokens they make by rank;
    ``edges`` (sorted) and ``targets`` are a trie over the bytes of all mergeable tokens.
    """

    tokens: list[bytes]
    added: dict[str, int]
    rank: np.ndarray
    left: np.ndarray
    right: np.ndarray
    pair_keys: np.ndarray
    pair_ranks: np.ndarray
    made: np.ndarray
    edges: np.ndarray
    targets: np.ndarray
    token_at: np.ndarray
    sound: np.ndarray

    @property
    def size(self) -> int:
        return len(self.tokens)

    def find_pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair; ``NEVER`` where there is none."""
        key = a.astype(np.int64) * self.size + b
        place = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        if not len(self.pair_keys):
            return np.full(len(key), NEVER)
        return np.where(self.pair_keys[place] == key, self.pair_ranks[place], NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray, whole: bool = False) -> np.ndarray:
        """Whether no merge crosses the border of tokens a and b.

        With ``whole`` the pair itself may merge: it is asked whether it is reached unharmed.
        """
        good = np.ones(len(a), bool)
        at = np.arange(len(a))
        x, y = a.astype(np.int64), b.astype(np.int64)
        until_x, until_y = np.full(len(a), NEVER), np.full(len(a), NEVER)
        skip = whole
        while len(at):
            if not skip:
                # Equal ranks are merged from the left: the pair loses to the merge left of it only.
                rank = self.find_pairs(x, y)
                crossed = (rank < NEVER) & (rank < until_x) & (rank <= until_y)
                good[at[crossed]] = False
            else:
                crossed = np.zeros(len(at), bool)
            skip = False
            rx, ry = self.rank[x], self.rank[y]
            on = ~crossed & ((rx >= 0) | (ry >= 0))
            at, x, y, rx, ry, until_x, until_y = (v[on] for v in (at, x, y, rx, ry, until_x, until_y))
            later = rx > ry
            until_x, until_y = np.where(later, rx, until_x), np.where(later, until_y, ry)
            x, y = np.where(later, self.right[x], x), np.where(later, y, self.left[y])
        return good


def _trie(tokens: list[tuple[bytes, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    children: dict[int, int] = {}
    token_at = [-1]
    for raw, number in tokens:
        node = 0
        for byte in raw:
            key = node << 8 | byte
            nxt = children.get(key)
            if nxt is None:
                nxt = children[key] = len(token_at)
                token_at.append(-1)
            node = nxt
        token_at[node] = number
    edges = np.array(list(children), np.int64)
    order = np.argsort(edges)
    return edges[order], np.array(list(children.values()), np.int64)[order], np.array(token_at, np.int64)


def read_vocabulary(path: str) -> Vocabulary:
    with open(path, encoding="utf-8") as file:
        data = json.load(file)
    model, splitter, decoder = data["model"], data["pre_tokenizer"] or {}, data["decoder"] or {}
    odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
    if model.get("type") != "BPE" or odd or data.get("normalizer") or splitter.get("type") != "ByteLevel" or decoder.get("type") != "ByteLevel":
        raise ValueError(f"{path} is no plain byte-level BPE file")
    if splitter.get("add_prefix_space") or not splitter.get("use_regex", True):
        raise ValueError(f"{path} splits texts in another way")
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in data["added_tokens"]):
        raise ValueError(f"{path} has added tokens that take their surroundings along")
    to_byte = {letter: b for b, letter in enumerate(byte_letters())}
    added = {t["content"]: t["id"] for t in data["added_tokens"]}
    size = 1 + max([*model["vocab"].values(), *added.values()])
    tokens = [b""] * size
    for text, number in model["vocab"].items():
        tokens[number] = bytes(to_byte[c] for c in text)
    for text, number in added.items():
        tokens[number] = text.encode()
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in data["model"]["merges"]]
    vocab = model["vocab"]
    a = np.array([vocab[x] for x, _ in merges], np.int64)
    b = np.array([vocab[y] for _, y in merges], np.int64)
    made = np.array([vocab[x + y] for x, y in merges], np.int64)
    rank, left, right = np.full(size, -1, np.int64), np.full(size, -1, np.int64), np.full(size, -1, np.int64)
    rank[made], left[made], right[made] = np.arange(len(made)), a, b
    order = np.argsort(a * size + b, kind="stable")
    edges, targets, token_at = _trie([(tokens[i], i) for i in vocab.values()])
    out = Vocabulary(
        tokens, added, rank, left, right, (a * size + b)[order], order.astype(np.int64), made,
        edges, targets, token_at, np.zeros(size, bool),
    )
    # A token is sound if merging makes it, and only it, of its bytes. The test of pairs needs
    # merges that come after those of both parts; a vocabulary without that order is not sound at all.
    if len(made) and ((rank[a] >= np.arange(len(made))) | (rank[b] >= np.arange(len(made)))).any():
        return out
    sound = np.array([len(t) == 1 for t in tokens])
    sound[list(added.values())] = False
    once = np.bincount(made, minlength=size) == 1
    unharmed = out.compatible(a, b, whole=True)
    for x, y, token, own in zip(a.tolist(), b.tolist(), made.tolist(), (unharmed & once[made]).tolist()):
        sound[token] = own and sound[x] and sound[y]
    out.sound = sound
    return out


class Codec:
    """Encoder and decoder of one vocabulary; ``exact`` counts the words that were merged exactly."""

    def __init__(self, vocabulary: Vocabulary, limit: int = KEPT_WORDS) -> None:
        self.vocabulary, self.limit = vocabulary, limit
        self.known: dict[str, bytes] = {}
        v = vocabulary
        self.merges = dict(zip(v.pair_keys.tolist(), zip(v.pair_ranks.tolist(), v.made[v.pair_ranks].tolist())))
        self.single = np.zeros(256, np.int64)
        for number, token in enumerate(v.tokens):
            if len(token) == 1 and number not in v.added.values():
                self.single[token[0]] = number
        names = sorted(v.added, key=len, reverse=True)
        self.split_added = re.compile("(" + "|".join(map(re.escape, names)) + ")").split if names else None
        self.length = np.array([len(t) for t in v.tokens], np.int64)
        self.at = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(v.tokens), np.uint8)
        self.guessed = self.exact = 0

    def longest(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Longest token from every byte on, not beyond ``ends``: its id and its length."""
        v = self.vocabulary
        token, length = np.full(len(data), -1, np.int32), np.ones(len(data), np.int32)
        for a in range(0, len(data), CHUNK):
            at = np.arange(a, min(a + CHUNK, len(data)))
            node, depth = np.zeros(len(at), np.int64), 0
            while len(at):
                key = node << 8 | data[at + depth]
                place = np.minimum(np.searchsorted(v.edges, key), len(v.edges) - 1)
                hit = v.edges[place] == key
                at, node = at[hit], v.targets[place[hit]]
                depth += 1
                found = v.token_at[node]
                full = found >= 0
                token[at[full]], length[at[full]] = found[full], depth
                more = at + depth < ends[at]
                at, node = at[more], node[more]
        return token, length

    def words(self, words: list[str]) -> list[bytes]:
        """Packed ids of each word."""
        raw = [w.encode() for w in words]
        sizes = np.array([len(r) for r in raw], np.int64)
        stops = np.cumsum(sizes)
        data = np.frombuffer(b"".join(raw), np.uint8)
        token, length = self.longest(data, np.repeat(stops, sizes))
        step, cuts, counts = memoryview(length), array("q"), np.empty(len(words), np.int64)
        at = 0
        for i, stop in enumerate(stops.tolist()):
            before = len(cuts)
            while at < stop:
                cuts.append(at)
                at += step[at]
            counts[i] = len(cuts) - before
        ids = token[np.frombuffer(cuts, np.int64)] if len(cuts) else np.zeros(0, np.int32)
        first = np.cumsum(counts) - counts
        bad = np.zeros(len(words), bool)
        owner = np.repeat(np.arange(len(words)), counts)
        bad[owner[~self.vocabulary.sound[ids]]] = True
        inside = np.flatnonzero(owner[1:] == owner[:-1])
        key, where = np.unique(ids[inside].astype(np.int64) * self.vocabulary.size + ids[inside + 1], return_inverse=True)
        good = self.vocabulary.compatible(key // self.vocabulary.size, key % self.vocabulary.size)
        bad[owner[inside[~good[where]]]] = True
        packed = ids.astype("<u4").tobytes()
        out = [packed[4 * a : 4 * (a + n)] for a, n in zip(first.tolist(), counts.tolist())]
        for i in np.flatnonzero(bad & (sizes > TOGETHER)).tolist():
            out[i] = np.array(self.merge(raw[i]), "<u4").tobytes()
        short = np.flatnonzero(bad & (sizes <= TOGETHER)).tolist()
        for i, ids in zip(short, self.merge_together([raw[i] for i in short])):
            out[i] = ids
        self.guessed += len(words)
        self.exact += int(bad.sum())
        return out

    def merge_together(self, words: list[bytes]) -> list[bytes]:
        """Exact merging of many words: in every round each merges its leftmost pair of lowest rank."""
        v = self.vocabulary
        ids = self.single[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), [len(w) for w in words])

        def ranks(at: np.ndarray) -> np.ndarray:
            after = np.minimum(at + 1, len(ids) - 1)
            found = v.find_pairs(ids[at], ids[after])
            return np.where((after > at) & (owner[at] == owner[after]), found, NEVER)

        rank = ranks(np.arange(len(ids)))
        finished: list[tuple[np.ndarray, np.ndarray]] = []
        while len(ids):
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            least = np.minimum.reduceat(rank, first)
            here = np.repeat(least, np.diff(np.append(first, len(ids))))
            done = here == NEVER
            if done.any():
                finished.append((owner[done], ids[done]))
                ids, owner, rank, here = ids[~done], owner[~done], rank[~done], here[~done]
            at = np.flatnonzero(rank == here)
            at = at[np.append(True, owner[at][1:] != owner[at][:-1])] if len(at) else at
            ids[at] = v.made[rank[at]]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids, owner, rank = ids[keep], owner[keep], rank[keep]
            at -= np.arange(len(at))  # each pair before it has lost one place
            rank[at] = ranks(at)
            before = at[(at > 0) & (owner[at - 1] == owner[at])] - 1 if len(at) else at
            rank[before] = ranks(before)
        if not finished:
            return []
        owner, ids = (np.concatenate(x) for x in zip(*finished))
        order = np.argsort(owner, kind="stable")
        ends = 4 * np.cumsum(np.bincount(owner, minlength=len(words)))
        packed = ids[order].astype("<u4").tobytes()
        return [packed[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist())]

    def merge(self, raw: bytes) -> list[int]:
        """Exact merging: the pair of lowest rank, of equal ones the leftmost, until none is left."""
        merges, size, n = self.merges, self.vocabulary.size, len(raw)
        ids = array("q", self.single[np.frombuffer(raw, np.uint8)].tolist())
        after, before = array("q", range(1, n + 1)), array("q", range(-1, n - 1))
        get = merges.get
        # Entries are rank << 40 | position; one that no longer holds is passed over.
        heap = [m[0] << 40 | i for i in range(n - 1) if (m := get(ids[i] * size + ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            entry = heapq.heappop(heap)
            i = entry & (1 << 40) - 1
            j = after[i]
            if ids[i] < 0 or j >= n:
                continue
            found = get(ids[i] * size + ids[j])
            if found is None or found[0] != entry >> 40:
                continue
            ids[i], ids[j] = found[1], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (m := get(ids[i] * size + ids[k])) is not None:
                    heapq.heappush(heap, m[0] << 40 | i)
            if (h := before[i]) >= 0 and (m := get(ids[h] * size + ids[i])) is not None:
                heapq.heappush(heap, m[0] << 40 | h)
        return [t for t in ids if t >= 0]

    def pieces(self, texts: list[str]) -> Iterator[list[str]]:
        """Words of each text."""
        mark = (0x110000).to_bytes(4, "little")
        points = np.frombuffer(b"".join(x for t in texts for x in (t.encode("utf-32-le"), mark)), "<u4")
        cuts = np.flatnonzero(piece_starts(points) | (points == 0x110000))
        ends = np.flatnonzero(points[cuts] == 0x110000)
        first = base = 0
        for text, last in zip(texts, ends.tolist()):
            at = (cuts[first : last + 1] - base).tolist()
            yield [text[a:b] for a, b in zip(at, at[1:])]
            first, base = last + 1, base + len(text) + 1

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text."""
        parts = [self.split_added(t) if self.split_added else [t] for t in texts]
        plain = list(self.pieces([p for own in parts for p in own[::2]]))
        wanted = {w for own in plain for w in own}
        known = self.known
        new = [w for w in wanted if w not in known]
        if len(known) + len(new) > self.limit:
            known.clear()
            new = list(wanted)
        once = {}
        for w, ids in zip(new, self.words(new) if new else []):
            (known if len(w) <= KEPT_LENGTH else once)[w] = ids
        if len(known) > self.limit:  # a slice with more distinct words than are kept
            once, self.known = {**once, **known}, {}
        look = known.__getitem__ if not once else lambda w: known.get(w) or once[w]
        out, at = [], 0
        for own in parts:
            packed = []
            for i, p in enumerate(own):
                if i % 2:
                    packed.append(self.vocabulary.added[p].to_bytes(4, "little"))
                else:
                    packed += map(look, plain[at])
                    at += 1
            out.append(b"".join(packed))
        return out

    def offsets(self, packed: bytes) -> np.ndarray:
        """First byte of each token in the decoded text."""
        length = self.length[np.frombuffer(packed, "<u4")]
        return np.cumsum(length) - length

    def decode(self, packed: bytes) -> str:
        ids = np.frombuffer(packed, "<u4").astype(np.int64)
        ids = ids[ids < len(self.length)]
        length = self.length[ids]
        begin = np.cumsum(length) - length
        source = np.arange(length.sum()) + np.repeat(self.at[ids] - begin, length)
        return self.bytes[source].tobytes().decode("utf-8", "replace")


_CODECS: dict[int, Codec] = {}


def _codec(sent) -> Codec:
    """One codec per vocabulary and worker process, so that its words outlive a task."""
    key = sent._jid if hasattr(sent, "_jid") else id(sent)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(sent.value)
    return _CODECS[key]


def _encode(batches: Iterator[pa.RecordBatch], sent, decoded: bool) -> Iterator[pa.RecordBatch]:
    codec = _codec(sent)
    for part in slices(batches, "text", 2 << 20):
        packed = codec.encode([t or "" for t in part.column("text").to_pylist()])
        columns = [part.column("id"), pa.array(packed, pa.binary())]
        if decoded:
            columns.append(pa.array([codec.decode(p) for p in packed], pa.string()))
        yield pa.RecordBatch.from_arrays(columns, names=["id", "ids", "decoded"][: len(columns)])


def _decode(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    codec = _codec(sent)
    for part in slices(batches, "ids", 2 << 20):
        texts = [codec.decode(p or b"") for p in part.column("ids").to_pylist()]
        yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(texts, pa.string())], names=["id", "decoded"])


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """Per row: id and packed ``ids`` by the vocabulary file; with ``decoded`` also the text that these decode to."""
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(read_vocabulary(vocabulary))
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {source.schema['id'].dataType.simpleString()}, ids binary" + ", decoded string" * decoded
    return source.mapInArrow(lambda b: _encode(b, sent, decoded), schema).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row: id and the ``decoded`` text of packed ids."""
    spark = encoded.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(read_vocabulary(vocabulary))
    source = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    schema = f"id {source.schema['id'].dataType.simpleString()}, decoded string"
    return source.mapInArrow(lambda b: _decode(b, sent), schema).withColumnRenamed("id", id_col)
