"""Secrets in texts, by one automaton for all rules.

The rules are compiled into a single minimal automaton over bytes (see ``automata``), which
reads every byte once and marks where a match of any rule ends. From each end a second,
backward automaton of that rule finds the start; spans of one kind are taken from left to
right without overlap, and the length condition decides last, so that a failing match still
covers its characters. Every rule ends in a run of one character class, so the end of a run of marks is the
end of a match.

Base kinds are fixed; the further kinds add spans of known token formats.

Defined results: null text is empty and has no span; offsets are code points, ends are
exclusive; repeated rows are scanned one by one. Only the named columns are read. A text of
any length is scanned whole, in blocks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqseg.llm.arrays import slices, texts_of
from seqseg.llm.automata import Automaton
from seqseg.session import ship


@dataclass(frozen=True)
class Kind:
    name: str
    #: Searched for by the automaton.
    pattern: bytes
    #: Group whose length counts (0: the whole match), and its least length.
    group: int
    least: int


#: Fixed by contract. Short hex runs are left out of the automaton, which cannot change which
#: characters another match may use; the other kinds count their length after the match,
#: since counting overlapping candidates in the automaton would multiply its states.
BASE = (
    Kind("assign", rb"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Kind("access", rb"AKIA[A-Z0-9]+", 0, 18),
    Kind("hex", rb"[0-9a-f]{16,}", 0, 16),
)
MORE = (
    Kind("github", rb"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Kind("slack", rb"xox[abprs]-[A-Za-z0-9-]+", 0, 20),
    Kind("pem", rb"-----BEGIN [A-Z ]*PRIVATE KEY[-]+", 0, 25),
)
KINDS = (*BASE, *MORE)

SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


class Scanner:
    """The compiled rules; made once per task."""

    def __init__(self, kinds: tuple[Kind, ...] = KINDS) -> None:
        self.kinds = kinds
        self.search = Automaton([k.pattern for k in kinds])
        self.back = [Automaton([k.pattern], anchored=True, backwards=True) for k in kinds]
        self.check = [re.compile(k.pattern) for k in kinds]
        if not self.search.resets(0x0A):
            raise ValueError("a rule can match across lines")

    def spans(self, texts: list[bytes]) -> list[list[tuple[int, int, int]]]:
        """(start, kind number, end) of each text in code points, ordered."""
        joined = b"\n".join(texts)
        marks = self.search.accepted(np.frombuffer(joined, np.uint8))
        starts = np.zeros(len(texts), np.int64)
        np.cumsum([len(t) + 1 for t in texts[:-1]], out=starts[1:])
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        after = np.append(marks[1:], np.uint8(0)) if len(marks) else marks
        stops = np.flatnonzero(marks & ~after)
        owner = np.searchsorted(starts, stops, side="right") - 1
        doc, used = -1, [0] * len(self.kinds)
        for stop, own, bits in zip(stops.tolist(), owner.tolist(), (marks & ~after)[stops].tolist()):
            if own != doc:
                doc, used = own, [0] * len(self.kinds)
            text, end = texts[own], stop + 1 - int(starts[own])
            for k, kind in enumerate(self.kinds):
                if not bits >> k & 1:
                    continue
                length = self.back[k].longest(text[used[k] : end][::-1])
                if not length:
                    continue
                start, used[k] = end - length, end
                match = self.check[k].fullmatch(text[start:end])
                if match and len(match[kind.group]) >= kind.least:
                    found[own].append((start, k, end))
        return [_in_code_points(t, sorted(s)) if s else s for t, s in zip(texts, found)]


def _in_code_points(text: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    if text.isascii():
        return spans
    heads = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
    return [(int(heads[a]) - 1, k, int(heads[b - 1])) for a, k, b in spans]


def _scan(batches: Iterator[pa.RecordBatch], kinds: tuple[Kind, ...]) -> Iterator[pa.RecordBatch]:
    scanner = Scanner(kinds)
    for part in slices(batches, "text"):
        rows = [
            [{"kind": kinds[k].name, "start": a, "end": b} for a, k, b in spans]
            for spans in scanner.spans(texts_of(part, "text"))
        ]
        yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(rows, pa.list_(SPAN))], names=["id", "spans"])


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """Per row: id and ``spans`` (kind, start, end), ordered by start and then kind as listed."""
    ship(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(
        lambda batches: _scan(batches, kinds),
        f"id {source.schema['id'].dataType.simpleString()}, spans array<struct<kind:string,start:bigint,end:bigint>>",
    ).withColumnRenamed("id", id_col)


def redact(text: str, spans: list[tuple[str, int, int]], mark: str = "<{}>") -> str:
    """Replace spans by marks; overlapping spans become one mark of the first kind."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], mark.format(kind)]
        at = max(at, end)
    return "".join(out) + text[at:]
