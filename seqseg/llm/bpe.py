"""Byte-level BPE: encoding texts to token ids and decoding ids to bytes.

Pre-tokenisation runs without regular expressions on whole arrays. Every code point has a
class; what the splitting pattern looks ahead for (the letters of a contraction, the character
after white space) is folded into symbols. A small automaton over the symbols tells where a
piece starts. Its transition functions are composed block by block and combined by an
associative scan, which gives the state at the start of every block; a second pass marks the
boundaries. The slices between them go through pair merging, with a bounded cache of pieces.

Ids are kept as packed little-endian unsigned 32-bit integers in a binary column, so that
they have no per-value overhead; token offsets (in bytes of the UTF-8 text) follow from the
lengths of the tokens and place each token's bytes when decoding.

Ranks are read from a file in rank format on the driver (a vocabulary: its size does not
depend on the data) and sent to the tasks once.

Defined results: null text is empty and has no ids; special tokens are ordinary text; any
byte sequence of the vocabulary decodes, also if it is no valid UTF-8; unknown ids raise an
error. Repeated rows are encoded one by one. Only the named columns are read.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqseg.llm.arrays import slices
from seqseg.session import ship

LETTER, NUMBER, SPACE, WHITE, OTHER, APOSTROPHE, END = range(7)
#: Letters of contractions: alone (s t m d), before e (r v), e, and l twice.
ONE, BEFORE_E, E, EL = 7, 8, 9, 10
_WHITE = (*range(0x09, 0x0E), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
_BREAK = 0x110000  # stands between texts
_PLANES = 0x40000  # no letter or number lies in later planes
# Letters and numbers of Unicode 16, which the tokenizer libraries know and
# Python's tables (15.1) do not; first and last code point.
_NEW_LETTERS = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85),
    (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7),
    (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C),
    (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
_NEW_NUMBERS = (
    (0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79),
    (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA),
)

# Symbols: what the automaton reads.
S_LETTER, S_NUMBER, S_OTHER, S_SHORT, S_LONG, S_SPACE, S_WHITE, S_RUN, S_END = range(9)
# States: after a finished piece, inside a run, after a leading space, inside white space,
# and with one or two letters of a contraction to come.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHER, LED, IN_WHITE, LAST_ONE, LAST_TWO = range(8)
N_STATES, BLOCK = 8, 128


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    table = np.full(_BREAK + 1, OTHER, np.uint8)
    kinds = {"L": LETTER, "N": NUMBER}
    table[:_PLANES] = [kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(_PLANES)]
    for ranges, kind in ((_NEW_LETTERS, LETTER), (_NEW_NUMBERS, NUMBER)):
        for first, last in ranges:
            table[first : last + 1] = kind
    table[list(_WHITE)] = WHITE
    table[0x20], table[0x27], table[_BREAK] = SPACE, APOSTROPHE, END
    for chars, kind in (("stmd", ONE), ("rv", BEFORE_E), ("e", E), ("l", EL)):
        table[[ord(c) for c in chars]] = kind
    return table


@lru_cache(maxsize=1)
def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """Next state and whether a piece starts, by [symbol, state]."""
    nxt = np.zeros((9, N_STATES), np.uint8)
    starts = np.ones((9, N_STATES), bool)
    for symbol, own in ((S_LETTER, IN_LETTERS), (S_NUMBER, IN_NUMBERS), (S_OTHER, IN_OTHER)):
        nxt[symbol] = own
        starts[symbol, [own, LED]] = False
    nxt[S_LETTER, LAST_TWO], nxt[S_LETTER, LAST_ONE] = LAST_ONE, FRESH
    starts[S_LETTER, [LAST_ONE, LAST_TWO]] = False
    for symbol, own in ((S_SHORT, LAST_ONE), (S_LONG, LAST_TWO)):
        nxt[symbol] = own
        nxt[symbol, [IN_OTHER, LED]] = IN_OTHER
        starts[symbol, [IN_OTHER, LED]] = False
    nxt[S_SPACE], nxt[S_WHITE], nxt[S_END] = LED, FRESH, FRESH
    nxt[S_RUN] = IN_WHITE
    starts[S_RUN, IN_WHITE] = False
    return nxt, starts


def _symbols(points: np.ndarray) -> np.ndarray:
    """Symbol of every code point; the array ends with a break."""
    kind = _classes()[points]
    after = np.append(kind[1:], np.uint8(END))
    third = np.append(after[1:], np.uint8(END))
    simple = np.array([S_LETTER, S_NUMBER, S_SPACE, S_WHITE, S_OTHER, S_OTHER, S_END, *[S_LETTER] * 4], np.uint8)
    out = simple[kind]
    quote = np.flatnonzero(kind == APOSTROPHE)
    a, b = after[quote], third[quote]
    out[quote[a == ONE]] = S_SHORT
    out[quote[((a == BEFORE_E) & (b == E)) | ((a == EL) & (b == EL))]] = S_LONG
    white = (kind == SPACE) | (kind == WHITE)
    inner = white & ((after == SPACE) | (after == WHITE) | (after == END))
    out[inner] = S_RUN
    return out


def piece_starts(points: np.ndarray) -> np.ndarray:
    """Whether a piece starts at each code point; texts are ended by breaks, which start one too."""
    n = len(points)
    rows = -(-n // BLOCK)
    codes = np.full(rows * BLOCK, S_END, np.uint8)
    codes[:n] = _symbols(points)
    nxt, starts = _automaton()
    codes = np.ascontiguousarray(codes.reshape(rows, BLOCK).T).astype(np.intp) * N_STATES
    table, flags = nxt.astype(np.intp).ravel(), starts.ravel()
    # The transition function of each block: where it leads from every state.
    function = np.broadcast_to(np.arange(N_STATES)[:, None], (N_STATES, rows)).copy()
    for i in range(BLOCK):
        function = table[codes[i] + function]
    # Associative scan: function[:, k] becomes the composition of blocks 0..k.
    step = 1
    while step < rows:
        function[:, step:] = np.take_along_axis(function[:, step:], function[:, :-step], axis=0)
        step *= 2
    state = np.concatenate([[FRESH], function[FRESH, :-1]])
    out = np.empty((BLOCK, rows), bool)
    for i in range(BLOCK):
        at = codes[i] + state
        out[i] = flags[at]
        state = table[at]
    return out.T.ravel()[:n]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Pieces(dict):
    """Packed ids of a piece of text, kept for the pieces seen lately."""

    def __init__(self, ranks: dict[bytes, int], limit: int = 250_000) -> None:
        super().__init__()
        self.ranks, self.limit = ranks, limit

    def __missing__(self, piece: str) -> bytes:
        raw = piece.encode()
        rank = self.ranks.get(raw)
        ids = [rank] if rank is not None else self.merge(raw)
        packed = np.array(ids, "<u4").tobytes()
        if len(piece) > 64:  # long pieces hardly come again
            return packed
        if len(self) >= self.limit:
            self.clear()
        self[piece] = packed
        return packed

    def merge(self, raw: bytes) -> list[int]:
        """Join the pair of lowest rank, the leftmost first, until no pair is in the vocabulary."""
        ranks = self.ranks
        if len(raw) > 100:
            return self._merge_long(raw)
        parts = [raw[i : i + 1] for i in range(len(raw))]
        pairs = [ranks.get(raw[i : i + 2], 1 << 60) for i in range(len(raw) - 1)]
        while pairs:
            low = min(pairs)
            if low == 1 << 60:
                break
            i = pairs.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], 1 << 60)
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], 1 << 60)
        return [ranks[p] for p in parts]

    def _merge_long(self, raw: bytes) -> list[int]:
        """The same with a heap of pairs over a linked list, for pieces of any length."""
        ranks, n = self.ranks, len(raw)
        end = list(range(1, n + 1))  # of the part that starts here; 0: swallowed
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(raw[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            middle = end[i]
            if not middle or middle >= n or end[middle] != stop:
                continue
            end[i], end[middle] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := ranks.get(raw[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (left := before[i]) >= 0 and (r := ranks.get(raw[left:stop])) is not None:
                heapq.heappush(heap, (r, left, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[raw[i : end[i]]])
            i = end[i]
        return out


class Codec:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.pieces = Pieces(ranks)
        size = max(ranks.values(), default=-1) + 1
        tokens = [b""] * size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.at = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text."""
        mark = _BREAK.to_bytes(4, "little")
        points = np.frombuffer(b"".join(x for t in texts for x in (t.encode("utf-32-le"), mark)), "<u4")
        cuts = np.flatnonzero(piece_starts(points) | (points == _BREAK))
        ends = np.flatnonzero(points[cuts] == _BREAK)  # place of each text's end among the cuts
        out, first, base, get = [], 0, 0, self.pieces.__getitem__
        for text, last in zip(texts, ends.tolist()):
            at = (cuts[first : last + 1] - base).tolist()
            out.append(b"".join([get(text[a:b]) for a, b in zip(at, at[1:])]))
            first, base = last + 1, base + len(text) + 1
        return out

    def offsets(self, packed: bytes) -> np.ndarray:
        """First byte of each token in the decoded text."""
        length = self.length[np.frombuffer(packed, "<u4")]
        return np.cumsum(length) - length

    def decode(self, packed: bytes) -> bytes:
        ids = np.frombuffer(packed, "<u4")
        if not len(ids):
            return b""
        length = self.length[ids]
        if not length.all():
            raise ValueError("an id is not in the vocabulary")
        offsets = np.cumsum(length) - length
        source = np.arange(offsets[-1] + length[-1]) + np.repeat(self.at[ids] - offsets, length)
        return self.bytes[source].tobytes()


_CODECS: dict[int, Codec] = {}


def _codec(sent) -> Codec:
    """One codec per vocabulary and worker process, so that its cache outlives a task."""
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
            columns.append(pa.array([codec.decode(p) for p in packed], pa.binary()))
        yield pa.RecordBatch.from_arrays(columns, names=["id", "ids", "decoded"][: len(columns)])


def _decode(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    codec = _codec(sent)
    for part in slices(batches, "ids", 2 << 20):
        texts = [codec.decode(p or b"") for p in part.column("ids").to_pylist()]
        yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(texts, pa.binary())], names=["id", "decoded"])


def send_ranks(spark: SparkSession, path: str):
    return spark.sparkContext.broadcast(read_ranks(path))


def encode(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """Per row: id and packed ``ids``; with ``decoded`` also the bytes that these decode to."""
    spark = docs.sparkSession
    ship(spark)
    sent = send_ranks(spark, ranks_path)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {source.schema['id'].dataType.simpleString()}, ids binary" + ", decoded binary" * decoded
    return source.mapInArrow(lambda b: _encode(b, sent, decoded), schema).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row: id and the ``decoded`` bytes of packed ids."""
    spark = encoded.sparkSession
    ship(spark)
    sent = send_ranks(spark, ranks_path)
    source = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    schema = f"id {source.schema['id'].dataType.simpleString()}, decoded binary"
    return source.mapInArrow(lambda b: _decode(b, sent), schema).withColumnRenamed("id", id_col)
