"""Personal data in texts, by a semi-Markov conditional random field.

Candidate segments come from character scans: every base match of the contract, and looser
forms (obfuscated addresses, numbers without a country code, numbers after a hint such as
"card"). Around each cluster of candidates the field scores whole segmentations: an entity
segment gets the weights of whole-span features (kind, form, checks such as Luhn or part
ranges, digit counts, hint words before it, neighbouring characters), and what no segment
covers is "outside". Dynamic programming over cut points, bounded by the longest entity,
chooses boundaries and kinds together. Base spans always stay; a segmentation adds spans.

The weights are trained on a bounded sample of distinct stretches of every kind and form. Gold segmentations are the base
matches that pass their checks, also in altered copies in which a match is written in a
looser form. Clusters are independent: no cut point lies inside a candidate of another.

Defined results: null text is empty and has no span; offsets are code points, ends are
exclusive; repeated rows are scanned one by one. Only the named columns are read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqseg.llm.arrays import slices
from seqseg.session import ship

#: Fixed by contract, in the order of the digests.
KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Looser forms.
_AT, _DOT = r"\x20?(?:\[at\]|\(at\))\x20?", r"(?:\x20?(?:\[dot\]|\(dot\))\x20?|\x20dot\x20|\.)"
_SPELLED = re.compile(rf"[A-Za-z0-9._%+-]{{1,64}}{_AT}[A-Za-z0-9-]{{1,63}}(?:{_DOT}[A-Za-z0-9-]{{1,63}})+")
_PLAIN = re.compile(r"(?<![0-9A-Za-z+.-])\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{4}(?![0-9])")
_HINTS = {
    "email": re.compile(r"e-?mail|mail|contact|address", re.I),
    "ip": re.compile(r"\bip\b|server|host|address|login", re.I),
    "card": re.compile(r"card|visa|credit|payment|account", re.I),
    "phone": re.compile(r"phone|tel|call|mobile|fax|contact", re.I),
}
#: No candidate that only the field can add is longer; base spans have no bound.
MAX_ADDED = 120
#: Forms that no check decides: where they stand in a text they count as outside, in altered copies as gold.
UNLABELLED = ("spelled", "plain")
_ANY = re.compile(r"[@0-9]|\[at\]|\(at\)")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    used, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > used and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            used = match.end()
            yield start, used
        at = text.find("@", max(at + 1, used))


def digits_of(span: str) -> str:
    return "".join(c for c in span if "0" <= c <= "9")


def valid(kind: str, span: str) -> bool:
    """The check of the contract for a base match."""
    if kind == "email":
        return True
    if kind == "ip":
        parts = [p.lstrip("0") or "0" for p in span.split(".")]
        return all(len(p) <= 3 and int(p) <= 255 for p in parts)
    digits = digits_of(span)
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of all base matches that pass, by kind and start."""
    found = [(0, a, b) for a, b in _emails(text)]
    for kind, pattern in ((1, _IP), (2, _CARD), (3, _PHONE)):
        if kind == 3 and "+" not in text:
            continue
        for m in pattern.finditer(text):
            if valid(KINDS[kind], m[0]):
                found.append((kind, m.start(), m.end()))
    return found


@dataclass(frozen=True)
class Candidate:
    start: int
    end: int
    kind: int
    form: str  # base: passes the base check


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[Candidate]:
    found = {(k, a, b): Candidate(a, b, k, "base") for k, a, b in base}
    loose = [(3, "plain", m) for m in _PLAIN.finditer(text)]
    if "[at]" in text or "(at)" in text:
        loose += [(0, "spelled", m) for m in _SPELLED.finditer(text)]
    loose += [(2, "digits", m) for m in _CARD.finditer(text) if 13 <= len(digits_of(m[0])) <= 19]
    loose += [(1, "dotted", m) for m in _IP.finditer(text)]
    if "+" in text:
        loose += [(3, "plus", m) for m in _PHONE.finditer(text)]
    for kind, form, m in loose:
        if m.end() - m.start() <= MAX_ADDED:
            found.setdefault((kind, m.start(), m.end()), Candidate(m.start(), m.end(), kind, form))
    return sorted(found.values(), key=lambda c: (c.start, c.end, c.kind))


def features(text: str, c: Candidate) -> list[str]:
    """Whole-span features of a candidate segment."""
    kind, span = KINDS[c.kind], text[c.start : c.end]
    before, after = text[max(0, c.start - 40) : c.start], text[c.end : c.end + 1]
    names = [kind, f"{kind}:{c.form}"]
    if c.kind:
        n = len(digits_of(span))
        names.append(f"{kind}:digits{min(n, 20) // 2}")
        names.append(f"{kind}:{'passes' if valid(kind, span) else 'fails'}")
    if _HINTS[kind].search(before):
        names.append(f"{kind}:hint")
    if before[-1:].isalnum() or after.isalnum():
        names.append(f"{kind}:glued")
    return names


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)

    def score(self, text: str, c: Candidate) -> float:
        return sum(self.weights.get(f, 0.0) for f in features(text, c))

    def added(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Spans of the best segmentations that are not base spans and overlap none."""
        out = []
        taken = sorted((a, b) for _, a, b in base)
        starts, reach = [a for a, _ in taken], list(accumulate((b for _, b in taken), max))
        for cluster in clusters(candidates(text, base)):
            if all(c.form == "base" for c in cluster):
                continue
            for c in best(cluster, [self.score(text, c) for c in cluster]):
                before = bisect_left(starts, c.end)  # base spans that start before it ends
                if c.form != "base" and not (before and reach[before - 1] > c.start):
                    out.append((c.kind, c.start, c.end))
        return out


def clusters(found: list[Candidate]) -> Iterator[list[Candidate]]:
    """Runs of candidates that overlap, directly or through others."""
    group: list[Candidate] = []
    reach = -1
    for c in found:
        if group and c.start >= reach:
            yield group
            group = []
        group.append(c)
        reach = max(reach, c.end)
    if group:
        yield group


def _lattice(cluster: list[Candidate]) -> tuple[list[int], list[tuple[int, int]]]:
    """Cut points and, for each candidate, the cut points it runs between."""
    cuts = sorted({p for c in cluster for p in (c.start, c.end)})
    place = {p: i for i, p in enumerate(cuts)}
    return cuts, [(place[c.start], place[c.end]) for c in cluster]


def best(cluster: list[Candidate], scores: list[float]) -> list[Candidate]:
    """Viterbi over segmentations: between cut points lies an entity or nothing (score 0)."""
    cuts, edges = _lattice(cluster)
    value, back = [0.0] * len(cuts), [-1] * len(cuts)
    ending: dict[int, list[int]] = {}
    for i, (_, b) in enumerate(edges):
        ending.setdefault(b, []).append(i)
    for j in range(1, len(cuts)):
        value[j] = value[j - 1]
        for i in ending.get(j, ()):
            if value[edges[i][0]] + scores[i] > value[j]:
                value[j], back[j] = value[edges[i][0]] + scores[i], i
    out, j = [], len(cuts) - 1
    while j > 0:
        if back[j] < 0:
            j -= 1
        else:
            out.append(cluster[back[j]])
            j = edges[back[j]][0]
    return out[::-1]


def marginals(cluster: list[Candidate], scores: list[float]) -> tuple[np.ndarray, float]:
    """Probability of each candidate, and the log of the sum over all segmentations."""
    cuts, edges = _lattice(cluster)
    n = len(cuts)
    forward, backward = np.full(n, -np.inf), np.full(n, -np.inf)
    forward[0] = backward[-1] = 0.0
    for j in range(1, n):
        forward[j] = np.logaddexp.reduce([forward[j - 1], *(forward[a] + s for (a, b), s in zip(edges, scores) if b == j)])
    for j in range(n - 2, -1, -1):
        backward[j] = np.logaddexp.reduce([backward[j + 1], *(backward[b] + s for (a, b), s in zip(edges, scores) if a == j)])
    total = forward[-1]
    return np.array([np.exp(forward[a] + s + backward[b] - total) for (a, b), s in zip(edges, scores)]), total


def _altered(text: str, kind: int, start: int, end: int) -> tuple[str, Candidate] | None:
    """A copy of the surroundings with one base match in a looser form, and its gold segment."""
    left, span, right = text[max(0, start - 60) : start], text[start:end], text[end : end + 20]
    if kind == 0:
        span, form = span.replace("@", " [at] "), "spelled"
    elif kind == 3 and "(" in span:
        span, form = span[span.index("(") :], "plain"
    else:
        return None
    return left + span + right, Candidate(len(left), len(left) + len(span), kind, form)


def train(texts: list[str], rounds: int = 60, rate: float = 0.5, penalty: float = 1e-3) -> Model:
    """Maximum conditional likelihood over the clusters of the texts and of altered copies."""
    cases = []
    for text in texts:
        base = base_spans(text)
        gold = {(k, a, b) for k, a, b in base}
        for cluster in clusters(candidates(text, base)):
            cases.append(([features(text, c) for c in cluster], cluster, [(c.kind, c.start, c.end) in gold for c in cluster]))
        for k, a, b in base:
            changed = _altered(text, k, a, b)
            if changed:
                copy, target = changed
                for cluster in clusters(candidates(copy, base_spans(copy))):
                    hits = [(c.kind, c.start, c.end) == (target.kind, target.start, target.end) for c in cluster]
                    if any(hits):
                        cases.append(([features(copy, c) for c in cluster], cluster, hits))
    # Segments of a gold segmentation must not overlap: where base matches do, the first stays.
    names = sorted({f for fs, _, _ in cases for one in fs for f in one})
    number = {f: i for i, f in enumerate(names)}
    coded = []
    for fs, cluster, hits in cases:
        reach, y = -1, np.zeros(len(cluster))
        for i, c in enumerate(cluster):
            if hits[i] and c.start >= reach:
                y[i], reach = 1.0, c.end
        coded.append(([[number[f] for f in one] for one in fs], cluster, y))
    weights, seen = np.zeros(len(names)), np.full(len(names), 1e-8)
    for _ in range(rounds if coded else 0):
        slope = -penalty * weights * len(coded)
        for fs, cluster, y in coded:
            p, _ = marginals(cluster, [float(weights[f].sum()) for f in fs])
            for f, d in zip(fs, y - p):
                slope[f] += d
        seen += slope**2
        weights += rate * slope / np.sqrt(seen)
    return Model(dict(zip(names, weights.tolist())))


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])
_SPAN_TYPE = "spans array<struct<kind:string,start:bigint,end:bigint,base:boolean>>"


def find_in(text: str, model: Model) -> list[dict]:
    """Spans of a text by kind as listed and start; ``base`` tells which are base spans."""
    if not _ANY.search(text):
        return []
    base = base_spans(text)
    both = [(s, True) for s in base] + [(s, False) for s in model.added(text, base)]
    return [
        {"kind": KINDS[k], "start": a, "end": b, "base": own} for (k, a, b), own in sorted(both)
    ]


def _scan(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text"):
        rows = [find_in(t or "", model) for t in part.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(rows, pa.list_(SPAN))], names=["id", "spans"])


def _stretches(text: str) -> Iterator[tuple[str, str]]:
    """(kind and form, 400 characters around it) of the candidates of a text.

    Base matches that have an altered copy are a form of their own. Looser forms that overlap
    a base match are in its stretch.
    """
    if not _ANY.search(text):
        return
    for cluster in clusters(candidates(text, base_spans(text))):
        free = all(c.form != "base" for c in cluster)
        for c in cluster:
            form = c.form
            if form in UNLABELLED and not free:
                continue
            if form == "base" and _altered(text, c.kind, c.start, c.end):
                form = "alterable"
            yield f"{KINDS[c.kind]}:{form}", text[max(0, c.start - 200) : max(0, c.start - 200) + 400]


def _least(rows: Iterator[tuple[str, int, str]], limit: int) -> dict[str, list[tuple[int, str]]]:
    """The ``limit`` distinct stretches of smallest hash of every form."""
    kept: dict[str, set[tuple[int, str]]] = {}
    top: dict[str, int] = {}
    for form, key, stretch in rows:
        own = kept.setdefault(form, set())
        if key <= top.get(form, key):
            own.add((key, stretch))
            if len(own) >= 2 * limit:
                kept[form] = set(sorted(own)[:limit])
                top[form] = max(kept[form])[0]
    return {form: sorted(own)[:limit] for form, own in kept.items()}


def _draw(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """The stretches of a task that can be among the ``limit`` of smallest hash."""
    rows = (
        (form, xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) >> 1, t)
        for part in slices(batches, "text")
        for text in part.column("text").to_pylist()
        for form, t in _stretches(text or "")
    )
    found = [(form, key, t) for form, own in _least(rows, limit).items() for key, t in own]
    columns = list(zip(*found)) or [(), (), ()]
    kinds = (pa.string(), pa.int64(), pa.string())
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["form", "key", "t"])


def sample_windows(docs: DataFrame, text_col: str, limit: int) -> list[str]:
    """At most ``limit`` distinct stretches of 400 characters around candidates, dealt evenly over kinds and forms.

    All candidates of a text count. Those of a form with the smallest hash come first, so that
    the choice depends neither on row order nor on how often a text is there; a form with few
    stretches leaves its places to the others. Unlabelled forms get half as many places, so that
    they cannot outweigh the altered copies.
    """
    drawn = docs.select(F.col(text_col).alias("text")).mapInArrow(lambda b: _draw(b, limit), "form string, key bigint, t string")
    place = F.row_number().over(Window.partitionBy("form").orderBy("key", "t"))
    half = F.substring_index("form", ":", -1).isin(*UNLABELLED)
    ranked = drawn.distinct().withColumn("place", place).where(F.col("place") <= limit)
    ranked = ranked.withColumn("place", F.col("place") * F.when(half, 2).otherwise(1))
    single = ranked.groupBy("t").agg(F.min(F.struct("place", "form")).alias("first"))
    return [r["t"] for r in single.orderBy("first", "t").limit(limit).collect()]


def find_pii(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None, sample: int = 600
) -> DataFrame:
    """Per row: id and ``spans`` (kind, start, end, base).

    Without a model one is trained on at most ``sample`` stretches of the documents.
    """
    spark = docs.sparkSession
    ship(spark)
    model = model or train(sample_windows(docs, text_col, sample))
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(
        lambda batches: _scan(batches, model), f"id {source.schema['id'].dataType.simpleString()}, {_SPAN_TYPE}"
    ).withColumnRenamed("id", id_col)


def masked(text: str, spans: list[dict]) -> str:
    """The text with every span replaced by its kind; overlapping spans give one mark of the first."""
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        if s["start"] >= at:
            out += [text[at : s["start"]], f"<{s['kind'].upper()}>"]
        at = max(at, s["end"])
    return "".join(out) + text[at:]


def _mask(batches: Iterator[pa.RecordBatch], model: Model, text_col: str) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, text_col):
        at = part.schema.get_field_index(text_col)
        texts = [t if t is None else masked(t, find_in(t, model)) for t in part.column(at).to_pylist()]
        columns = list(part.columns)
        columns[at] = pa.array(texts, part.schema.field(at).type)
        yield pa.RecordBatch.from_arrays(columns, schema=part.schema)


def mask_pii(docs: DataFrame, text_col: str = "text", model: Model | None = None, sample: int = 600) -> DataFrame:
    """``docs`` with personal data in the text replaced by marks such as ``<EMAIL>``; null stays null."""
    ship(docs.sparkSession)
    model = model or train(sample_windows(docs, text_col, sample))
    return docs.mapInArrow(lambda batches: _mask(batches, model, text_col), docs.schema)
