from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from seqseg.llm import phrases
from seqseg.llm.phrases import collocations, top_phrases

SCHEMA = "doc_id bigint, text string, lang string, phrase string, n int, size int, shard string, words int"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def grams_of(text: str | None) -> Counter:
    out: Counter = Counter()
    for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
        words = re.findall("[^\x20\x09]+", piece)
        for k in range(1, 5):
            out.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    return out


def plain(rows, least: int, top: int):
    f: dict[str, Counter] = {}
    for text, lang in rows:
        f.setdefault("und" if lang is None else lang, Counter()).update(grams_of(text))
    out = []
    for lang, counts in f.items():
        n = sum(c for g, c in counts.items() if len(g) == 1)
        chosen = {g: c for g, c in counts.items() if len(g) > 1 and c >= least}
        scored = []
        for g, a in chosen.items():
            inside = lambda h: any(h[i : i + len(g)] == g for i in range(len(h) - len(g) + 1))
            if any(len(h) > len(g) and 100 * c >= 80 * a and inside(h) for h, c in chosen.items()):
                continue
            cuts = [(2000000 * a // (counts[g[:k]] + counts[g[k:]]), k) for k in range(1, len(g))]
            score, k = min(cuts)
            scored.append((-score, -a, " ".join(g).encode(), counts[g[:k]], counts[g[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(out)


def corpus(seed: int, docs: int = 150):
    rng = random.Random(seed)
    fixed = [["as", "a", "matter", "of", "fact"], ["New", "York"], ["new", "york", "city"], ["a", "a", "a", "a", "a"], ["é", "ü中"]]
    rows = []
    for _ in range(docs):
        words = []
        for _ in range(rng.randrange(60)):
            words += rng.choice(fixed) if rng.random() < 0.4 else [rng.choice("abcdefg") * rng.randrange(1, 3)]
        glue = "".join(w + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\x0b", "!"]) for w in words)
        rows.append((glue, rng.choice(["en", "en", "en", None, "de", ""])))
    rows += [(None, "en"), ("", "en"), (" \t. ,\n", "fr"), (rows[0][0], rows[0][1]), ("x\x1cy\x85z " * 40, "en"), ("long " * 5000, "de")]
    return rows


def table(spark, rows, parts: int = 3):
    return spark.createDataFrame([(i, t, lang, "p", 1, 2, "s", 3) for i, (t, lang) in enumerate(rows)], SCHEMA).repartition(parts)


def found(scored, top):
    ranked = top_phrases(scored, top)
    return sorted(tuple(r) for r in ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize(("seed", "least", "top", "shard_words"), [(1, 5, 2000, 400), (2, 30, 7, 10**6), (3, 2, 40, 1)])
def test_phrases_equal_brute_force(spark, monkeypatch, seed, least, top, shard_words):
    if seed == 3:
        monkeypatch.setattr(phrases, "STRETCH", 50)
        monkeypatch.setattr(phrases, "BATCH", 7)
    rows = corpus(seed)
    scored = collocations(table(spark, rows), least=least, shard_words=shard_words)
    assert found(scored, top) == plain(rows, least, top)


def test_long_texts_are_cut_at_piece_ends(monkeypatch):
    monkeypatch.setattr(phrases, "STRETCH", 10)
    raw = b"one two three four five six. seven, eight nine ten eleven twelve"
    parts = list(phrases._stretches(raw))
    assert b"".join(parts) == raw and len(parts) == 2 and parts[0].endswith(b"six.")


def test_empty_tables(spark):
    rows = table(spark, corpus(4, 3))
    assert found(collocations(rows.where("false"), least=1), 5) == []
    assert found(collocations(rows.where("text IS NULL"), least=1), 5) == []


def test_scores_pass_64_bits(spark):
    # 2000000 * a is above 2**63 for a count that only a very large corpus has.
    big = 2**44 + 1
    row = spark.createDataFrame([(big, 2 * big, big)], "a bigint, l bigint, r bigint")
    value = row.selectExpr("(2000000BD * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0))) AS s")
    assert value.first()[0] == 2000000 * big // (3 * big)


def test_intervals_count_every_ngram_in_both_directions():
    rng = random.Random(6)
    x = np.array([0, *(rng.randrange(5) for _ in range(400)), 0])
    index = phrases.Index(*phrases.transforms(x, 5), 5)
    words = x.tolist()

    def counts(k):
        every = (tuple(words[i : i + k]) for i in range(len(words) - k + 1))
        return Counter(g for g in every if 0 not in g)

    as_dict = lambda level: {tuple(g): n for g, n in zip(level["grams"].tolist(), level["n"].tolist())}
    for sides in (["right"] * 3, ["left"] * 3, ["right", "left", "right"], ["left", "right", "left"]):
        level = index.words()
        for k, side in enumerate(sides, 2):
            level = index.extend(level, side)
            assert as_dict(level) == counts(k)


def test_large_vocabularies_are_sorted_in_steps():
    rng = np.random.default_rng(1)
    a, b, c = (rng.integers(0, 9, 500) for _ in range(3))
    by_steps = phrases._order(a, b, c, 1 << 40)
    one = phrases._order(a, b, c, 9)
    assert [(a[i], b[i], c[i]) for i in by_steps] == [(a[i], b[i], c[i]) for i in one]
