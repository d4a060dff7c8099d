"""Plain versions of the operators, for comparison on small inputs."""

from __future__ import annotations

import hashlib
import re

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
BENCH_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def sha(data: str | bytes) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def shingles(text: str | None, size: int) -> set:
    words = SPACE_WORD.findall((text or "").translate(LOWER))
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def groups(docs: dict[int, str | None], size: int = 4, percent: int = 85) -> dict[int, int]:
    sets = {i: shingles(t, size) for i, t in docs.items()}
    root = {i: i for i in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(docs)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    return {i: find(i) for i in docs}


def repeats(docs: list[tuple[int, str | None]], depth: int) -> list[tuple[int, int, int, str]]:
    words = [(i, SPACE_WORD.findall(t or "")) for i, t in docs]
    least: dict[tuple, int] = {}
    for i, w in words:
        for a in range(len(w) - depth + 1):
            key = tuple(w[a : a + depth])
            least[key] = min(least.get(key, i), i)
    out = []
    for i, w in words:
        gone = set()
        for a in range(len(w) - depth + 1):
            if least[tuple(w[a : a + depth])] < i:
                gone.update(range(a, a + depth))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def passages(docs: dict[int, str | None], items: dict[int, str | None]) -> dict[int, tuple]:
    windows: dict[tuple, set] = {}
    for item, text in items.items():
        w = BENCH_WORD.findall((text or "").translate(LOWER))
        n = min(13, len(w))
        for a in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[a : a + n]), set()).add(item)
    out = {}
    for i, text in docs.items():
        w = BENCH_WORD.findall((text or "").translate(LOWER))
        hit, found = set(), set()
        for n in {len(k) for k in windows}:
            for a in range(len(w) - n + 1):
                owners = windows.get(tuple(w[a : a + n]))
                if owners:
                    hit.update(range(a, a + n))
                    found |= owners
        out[i] = (len(w), len(hit), sorted(map(str, found)))
    return out
