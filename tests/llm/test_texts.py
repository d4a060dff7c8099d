from __future__ import annotations

import hashlib
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from llm_plain import SPACE_WORD, groups, passages, sha
from pyspark.sql import functions as F

from seqseg.llm import bpe, chat, line_quality, pii, secrets, toxicity
from seqseg.llm.automata import Automaton
from seqseg.llm.labelled import fold, sample
from seqseg.llm.quality_rules import quality_rules

SCHEMA = "doc_id bigint, text string, id string, _text string, spans int, n_words string"
ODD = [None, "", " \t\n", "a", "é", "x" * 30_000, "word " * 9000, "\n" * 50, "a\x0bb\x0cc\x1cd e"]


def table(spark, texts, ids=None):
    rows = [(i, t, "x", "y", 1, "z") for i, t in zip(ids or range(len(texts)), texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


# ---- quality rules


def plain_measures(text):
    text = text or ""
    words = SPACE_WORD.findall(text)
    seen, hit = {}, set()
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    for places in seen.values():
        if len(places) > 1:
            hit.update(p + k for p in places for k in range(8))
    lines = [x for x in text.split("\n") if SPACE_WORD.search(x)]
    n = len(words)
    return (
        n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit),
        n < 20 or 100 * len(hit) > 30 * n,
    )


def test_quality_rules_equal_plain(spark):
    rng = random.Random(1)
    texts = [*ODD, *ODD]
    for _ in range(60):
        pieces = [" ".join(rng.choice("a b c # | é".split()) for _ in range(rng.randrange(12))) for _ in range(4)]
        texts.append("".join(rng.choice(pieces) + rng.choice(["\n", " ", "\t", "\n\n"]) for _ in range(rng.randrange(30))))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    got = {r["doc_id"]: tuple(r[n] for n in names) for r in quality_rules(table(spark, texts)).collect()}
    assert got == {i: plain_measures(t) for i, t in enumerate(texts)}


def test_quality_rules_keep_columns_and_clean_text(spark):
    clean = " ".join(f"the {w} and" for w in "river runs over green stones while birds sing near old trees".split()) + "."
    rows = table(spark, [clean, "### " * 40, None])
    found = quality_rules(rows, keep=rows.columns).orderBy("doc_id").collect()
    assert [r["kept"] for r in found] == [True, False, False]
    assert found[0]["n_words"] == "z" and found[0]["text"] == clean
    assert quality_rules(rows.where("false")).count() == 0


# ---- chat


def test_chat_round_trip_and_forged_marks(spark):
    rng = random.Random(2)
    bits = ["</s>", "<s>", "[INST]", " [/INST]", "<<SYS>>", "&amp;", "&lt;", "&", "<", "[", "\n", "ok", "", "é"]
    turns = []
    for c in range(20):
        for t in range(rng.randrange(1, 7)):
            role = rng.choice(["user", "assistant", "system", "to<ol\n", None])
            turns.append((c, t, role, rng.choice([None, "".join(rng.choice(bits) for _ in range(6))]), "x"))
    turns += [(30, 0, "user", "same", "x"), (30, 0, "user", "same", "x"), (None, None, "assistant", "y", "x")]
    df = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string, seq string")
    rows = chat.read_back(chat.render(chat.fold_events(chat.log_of_turns(df)))).collect()
    expected = {}
    for c, t, role, text, _ in sorted(turns, key=lambda x: (str(x[0]), x[1] or 0)):
        expected.setdefault(c, []).append((role or "", text or ""))
    assert {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in rows} == expected
    for r in rows:
        at, taken = 0, ""
        for m in r["mask"]:
            at += m["skip"]
            taken += r["formatted"][at : at + m["take"]]
            at += m["take"]
        plain = taken.replace("&#91;", "[").replace("&lt;", "<").replace("&amp;", "&")
        assert plain == "".join(text for role, text in expected[r["conv_id"]] if role == "assistant")


def test_chat_folds_deltas_edits_and_regenerations(spark):
    log = [
        (1, 0, 1, 0, "message", "user", "hi"), (1, 1, 1, 1, "delta", "assistant", "He"), (1, 1, 1, 2, "delta", None, "llo"),
        (1, 1, 1, 3, "regenerate", None, None), (1, 1, 1, 4, "delta", None, "Good "), (1, 1, 1, 5, "delta", None, "day"),
        (1, 0, 1, 6, "edit", None, "hi there"), (1, 2, 1, 7, "edit", "user", "a"), (1, 2, 1, 8, None, None, "b"), (1, 2, 1, 8, None, None, "b"),
    ]
    random.Random(3).shuffle(log)
    df = spark.createDataFrame(log, "conv_id int, turn int, part int, seq int, kind string, role string, text string")
    found = {r["turn"]: (r["role"], r["text"]) for r in chat.fold_events(df).collect()}
    assert found == {0: ("user", "hi there"), 1: ("assistant", "Good day"), 2: ("user", "abb")}
    assert chat.render(chat.fold_events(df.where("false"))).count() == 0


# ---- secrets


BASE_RULES = {
    0: (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 12),
    1: (re.compile("AKIA[A-Z0-9]+"), 0, 18),
    2: (re.compile("[0-9a-f]+"), 0, 16),
}


def plain_secrets(text):
    out = []
    for k, (pattern, group, least) in BASE_RULES.items():
        out += [(m.start(), k, m.end()) for m in pattern.finditer(text or "") if len(m[group]) >= least]
    return sorted(out)


def test_secrets_equal_regular_expressions(spark):
    rng = random.Random(4)
    bits = "token TOKEN secret passwd api_key Api_Key = : \" ' abcdef 0123456789abcdef AKIA ABCDEFGH0123 é x - / . ſecret K".split()
    texts = [*ODD, *["".join(rng.choice([*bits, " ", "\n"]) for _ in range(rng.randrange(50))) for _ in range(3000)]]
    texts += ["token" + " " * 5000 + "= " + "a1" * 3000, "f" * 100_000, "AKIA" * 3000]
    kinds = {k.name: i for i, k in enumerate(secrets.KINDS)}
    found = secrets.find_secrets(table(spark, texts)).collect()
    got = {r["doc_id"]: [(s["start"], kinds[s["kind"]], s["end"]) for s in r["spans"] if kinds[s["kind"]] < 3] for r in found}
    assert got == {i: plain_secrets(t) for i, t in enumerate(texts)}


def test_more_secret_kinds_and_redaction():
    text = "x ghp_" + "a1B2" * 9 + " y -----BEGIN RSA PRIVATE KEY----- z"
    spans = [(secrets.KINDS[k].name, a, b) for a, k, b in secrets.Scanner().spans([text.encode()])[0]]
    assert {s[0] for s in spans} == {"github", "pem"}
    assert secrets.redact(text, spans) == "x <github> y <pem> z"


@pytest.mark.parametrize("block", [1, 3, 256])
def test_automaton_scan_equals_step_by_step(block):
    rules = [rb"ab*c", rb"(?i)x(yz|y){2}", rb"[0-9]{3,}", rb"q?r+"]
    machine = Automaton(rules)
    rng = random.Random(5)
    data = bytes(rng.choice(b"abcxyzXY0123qr\n") for _ in range(700))
    state, expected = machine.start, []
    for byte in data:
        state = int(machine.table[state + int(machine.classes[byte])])
        expected.append(int(machine.accepts[state]))
    assert machine.accepted(np.frombuffer(data, np.uint8), block).tolist() == expected
    for i in range(len(data)):
        bits = sum(1 << k for k, r in enumerate(rules) if any(re.fullmatch(r, data[a : i + 1]) for a in range(max(0, i - 30), i + 1)))
        assert bits == expected[i] or data[max(0, i - 31) : i + 1].isdigit()


# ---- personal data


PII_RULES = [
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    re.compile(r"[0-9]([\x20-]?[0-9])+"),
    re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def test_pii_base_spans_equal_regular_expressions(spark):
    rng = random.Random(6)
    bits = ["a", "b.c", "@", ".", " ", "-", "+", "(", ")", "1", "23", "456", "7890", "192", "255", "256", "é", "\n", "4111 1111 1111 1111", "+1 (555) 010-1234"]
    texts = [*ODD, *["".join(rng.choice(bits) for _ in range(rng.randrange(25))) for _ in range(4000)], "1" * 50_000, "a@" * 5000]
    found = pii.find_pii(table(spark, texts)).collect()
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"] if s["base"]] for r in found}
    plain = lambda t: [
        (k, m.start(), m.end()) for k, p in zip(pii.KINDS, PII_RULES) for m in p.finditer(t or "") if pii.valid(k, m[0])
    ]
    assert got == {i: plain(t) for i, t in enumerate(texts)}


def stands(kind: str, span: str) -> bool:
    """The checks of base matches, written without those of the module."""
    digits = [ord(c) - 48 for c in span if c in "0123456789"]
    if kind == "ip":
        values = []
        for part in span.split("."):
            value = 0
            for c in part:
                value = min(1000, 10 * value + ord(c) - 48)
            values.append(value)
        return max(values) <= 255
    if kind == "card":
        twice = {d: sum(divmod(2 * d, 10)) for d in range(10)}
        total = sum(twice[d] if i % 2 else d for i, d in enumerate(digits[::-1]))
        return 13 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def test_pii_base_spans_stand_by_independent_checks():
    rng = random.Random(16)
    bits = ["0" * 40, "00", "0255", "256", "99999", ".", ".", ".", "1", "2", "4111111111111111", "+", "-", " ", "a@b.c", "(555)", "0" * 30]
    texts = ["x " + "0" * 5000 + ".1.2.3", "1.2.3." + "9" * 6000, "+" + "1" * 7000, "0" * 4400 + "255.0.0.0"]
    texts += ["".join(rng.choice(bits) for _ in range(rng.randrange(20))) for _ in range(1500)]
    for text in texts:
        expected = [
            (k, m.start(), m.end())
            for k, (kind, pattern) in enumerate(zip(pii.KINDS, PII_RULES))
            for m in pattern.finditer(text)
            if stands(kind, m[0])
        ]
        assert pii.base_spans(text) == expected
        pii.find_in(text, pii.Model())


def test_pii_time_is_linear_in_the_text():
    # Each line has base spans and loose forms that overlap some of them.
    line = "mail bob{0}@host.example.org, jane [at] site.example.org or (415) 555-0199 / +1 (415) 555-0199, 10.0.0.{1}, 4111 1111 1111 1112" + " word" * 16
    text = "\n".join(line.format(i, i % 256) for i in range(25_000))
    assert len(text) > 5_000_000
    model = pii.Model({"email:spelled": 1.0, "phone:plain": 1.0, "card:digits": 1.0})
    start = time.perf_counter()
    spans = pii.find_in(text, model)
    assert time.perf_counter() - start < 60
    kinds = [(s["kind"], s["base"]) for s in spans]
    assert kinds.count(("email", True)) == kinds.count(("ip", True)) == kinds.count(("phone", True)) == 25_000
    assert kinds.count(("email", False)) == 25_000
    base = [(s["start"], s["end"]) for s in spans if s["base"]]
    cover = np.zeros(len(text) + 1, np.int32)
    np.add.at(cover, [a for a, _ in base], 1)
    np.add.at(cover, [b for _, b in base], -1)
    inside = np.append(0, np.cumsum(np.cumsum(cover) > 0))
    assert all(inside[s["end"]] == inside[s["start"]] for s in spans if not s["base"])


def test_semi_markov_passes_equal_enumeration():
    rng = random.Random(7)
    for _ in range(200):
        spans = [(a, a + rng.randrange(1, 6)) for a in (rng.randrange(12) for _ in range(rng.randrange(1, 7)))]
        found = sorted({pii.Candidate(a, b, rng.randrange(4), "x") for a, b in spans}, key=lambda c: (c.start, c.end, c.kind))
        for cluster in pii.clusters(found):
            scores = [rng.uniform(-2, 2) for _ in cluster]
            totals, value, share = 0.0, -1e9, np.zeros(len(cluster))
            for mask in range(1 << len(cluster)):
                chosen = [i for i in range(len(cluster)) if mask >> i & 1]
                if any(cluster[i].end > cluster[j].start and cluster[j].end > cluster[i].start for i in chosen for j in chosen if i < j):
                    continue
                s = sum(scores[i] for i in chosen)
                totals, value = totals + np.exp(s), max(value, s)
                share[chosen] += np.exp(s)
            p, log_total = pii.marginals(cluster, scores)
            assert np.allclose(p, share / totals) and np.isclose(log_total, np.log(totals))
            place = {c: s for c, s in zip(cluster, scores)}
            assert np.isclose(sum(place[c] for c in pii.best(cluster, scores)), max(value, 0.0))


def test_pii_learns_looser_forms_and_masks(spark):
    rng = random.Random(8)
    texts = [f"write to user{i}@mail{i % 5}.example.com or call +1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)} today" for i in range(80)]
    model = pii.train(texts)
    text = "reach me: jane [at] site.example.org, (415) 555-0199, ip 10.1.2.3; code 123-45"
    kinds = {text[s["start"] : s["end"]]: (s["kind"], s["base"]) for s in pii.find_in(text, model)}
    assert kinds["10.1.2.3"] == ("ip", True)
    assert kinds["jane [at] site.example.org"] == ("email", False)
    rows = table(spark, [text, None, ""])
    masked = {r["doc_id"]: r for r in pii.mask_pii(rows, model=model).collect()}
    assert masked[0]["text"].startswith("reach me: <EMAIL>, ") and "<IP>" in masked[0]["text"] and masked[0]["id"] == "x"
    assert masked[1]["text"] is None and masked[2]["text"] == ""
    assert pii.find_pii(rows.where("false")).count() == 0


def test_pii_sample_holds_every_kind_and_form_once(spark):
    # A quarter of the rows is one text; every phone and address comes after a number.
    rng = random.Random(10)
    number = lambda: f"({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}"
    copied = "on 2024 01 01 00 we wrote to all of you"
    texts = [copied] * 700
    texts += [f"{i:04d} 0101 00 note " + "word " * 60 + f"call +1 {number()} now" for i in range(700)]
    texts += [f"{i:04d} 0202 00 note " + "word " * 60 + f"write to user{i}@mail.example.com now" for i in range(20)]
    texts += [f"{i:04d} 0303 00 note " + "word " * 60 + f"ask bob{i} [at] host.example.org" for i in range(700)]
    texts += [f"{i:04d} 0404 00 note " + "word " * 60 + f"ask {number()}" for i in range(700)]
    docs = table(spark, texts)
    drawn = pii.sample_windows(docs, "text", 60)
    assert len(drawn) == len(set(drawn)) == 60
    assert all(sum(mark in t for t in drawn) >= 10 for mark in ("+1 (", "@mail", "[at]"))
    assert drawn == pii.sample_windows(docs.repartition(7), "text", 60)
    assert len(pii.sample_windows(docs, "text", 10_000)) > 1400
    text = "reach me: jane [at] site.example.org or call (415) 555-0199"
    found = pii.find_pii(spark.createDataFrame([(-1, text)], "doc_id bigint, text string").unionByName(docs.select("doc_id", "text")), sample=60)
    assert [s["kind"] for s in found.where("doc_id = -1").first()["spans"]] == ["email", "phone"]


# ---- byte-level BPE


def reference():
    import tiktoken

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return ranks, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_library_and_decodes(spark):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks, library = reference()
    rng = random.Random(9)
    bits = ["'", "s", "t", "re", "ve", "ll", "l", "d", " ", "  ", "\n", "\t", " ", "　", "É", "12", "½", "!", "-", "́", "漢字", "😀", "\x1c", "Hello", "I'm", "'S", "\u1c89", "\ua7cb", "\U00016130"]
    texts = [*ODD, *["".join(rng.choice(bits) for _ in range(rng.randrange(40))) for _ in range(4000)], "ab" * 5000, "é" * 3000, " " * 999 + "x"]
    rows = bpe.encode(table(spark, texts), path, decoded=True)
    for r in rows.collect():
        text = texts[r["doc_id"]] or ""
        assert np.frombuffer(r["ids"], "<u4").tolist() == library.encode_ordinary(text)
        assert bytes(r["decoded"]) == text.encode()
    again = bpe.decode(rows.drop("decoded"), path).collect()
    assert all(bytes(r["decoded"]).decode() == (texts[r["doc_id"]] or "") for r in again)
    codec = bpe.Codec(ranks)
    ids = codec.encode(["Hello there, it's 12"])[0]
    starts = codec.offsets(ids).tolist()
    assert starts[0] == 0 and starts == sorted(starts)
    assert codec.decode(ids)[starts[1] :].decode() == "Hello there, it's 12"[starts[1] :]


# ---- classifiers


def labelled_table(spark):
    rng = random.Random(10)
    plain = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(600):
        words = [rng.choice(plain) for _ in range(rng.randrange(5, 80))]
        toxic = i % 3 == 0
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["grumblefoot", "nastyface", "grumblefeet"])
        quality = i % 4 != 1
        text = " ".join(words) if quality else "\n".join(f"{w}### {w}%%%" for w in words)
        rows.append((i, text, int(toxic), int(quality)))
    docs = spark.createDataFrame([(i, t, "x") for i, t, _, _ in rows], "doc_id bigint, text string, toxic string")
    labels = spark.createDataFrame([(i, a, b) for i, _, a, b in rows] + [(None, 1, 1), (1000, None, None)], "doc_id bigint, toxic int, quality int")
    return docs, labels, rows


def test_folds_are_checksums(spark):
    found = spark.range(50).select("id", fold("id", 5).alias("f")).collect()
    assert all(r["f"] == zlib.crc32(str(r["id"]).encode()) % 5 for r in found)


def test_toxicity_held_out_accuracy_and_misspelling(spark):
    docs, labels, rows = labelled_table(spark)
    cases = sample(docs, labels, "toxic", fold("_id", 5) != 0, 200)
    assert len(cases) <= 400 and {y for _, y in cases} == {0, 1}
    model = toxicity.train(cases)
    extra = spark.createDataFrame([(-1, "w1 w2 grumblefooot w4", "x"), (-2, None, "x"), (-3, "", "x"), (-4, "w1 " * 40_000, "x"), (-5, "w5 w6 w7", "x")], docs.schema)
    found = {r["doc_id"]: r for r in toxicity.score_toxicity(docs.unionByName(extra), model).collect()}
    held = [(i, y) for i, _, y, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([found[i]["predicted"] == y for i, y in held]) >= 0.97
    assert found[-1]["predicted"] == 1
    assert [found[i]["predicted"] for i in (-2, -3, -4, -5)] == [0, 0, 0, 0]
    assert all(0 <= r["score"] <= 1 for r in found.values())


def test_line_field_held_out_accuracy(spark):
    docs, labels, rows = labelled_table(spark)
    field = line_quality.train(sample(docs, labels, "quality", fold("_id", 3) != 1, 200))
    found = {r["doc_id"]: r for r in line_quality.score_quality(docs.unionByName(spark.createDataFrame([(-1, None, "x"), (-2, "\n \n", "x")], docs.schema)), field).collect()}
    held = [(i, q) for i, _, _, q in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([found[i]["predicted"] == q for i, q in held]) >= 0.98
    assert found[-1]["score"] == found[-2]["score"] == 0.0


def test_classifiers_without_labels_of_both_classes():
    assert toxicity.Scorer(toxicity.train([])).scores(["a"])[0] < 1e-5
    assert toxicity.Scorer(toxicity.train([("a", 1)])).scores(["b", ""]).min() > 0.99
    assert line_quality.train([("a", 1)]).scores([b"x", b""]).tolist() == [1.0, 0.0]
    assert line_quality.train([]).scores([b"x"]).tolist() == [0.0]


def test_chain_passes_equal_enumeration():
    rng = np.random.default_rng(11)
    lines = line_quality.lines_of([b"a b\nc\n\nd e f", b"x", b"", b"p q\nr"])
    field = line_quality.Field(rng.normal(size=line_quality.N_FEATURES), rng.normal(size=(2, 2)))
    single, pair = field.passes(lines)
    unary, k = lines.features @ field.weights, 0
    for a, b in zip(lines.starts, lines.starts[1:]):
        n = b - a
        weights = np.zeros((1 << n,))
        for mask in range(1 << n):
            y = [mask >> i & 1 for i in range(n)]
            weights[mask] = np.exp(sum(unary[a + i] * y[i] for i in range(n)) + sum(field.moves[y[i - 1], y[i]] for i in range(1, n)))
        for i in range(n):
            share = sum(w for m, w in enumerate(weights) if m >> i & 1) / weights.sum()
            assert np.isclose(single[a + i, 1], share)
            if i:
                both = sum(w for m, w in enumerate(weights) if m >> i & 1 and m >> (i - 1) & 1) / weights.sum()
                assert np.isclose(pair[k, 1, 1], both)
                k += 1


# ---- pipeline


def test_pipeline_equals_plain_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(12)
    sentence = lambda n: " ".join(f"the w{rng.randrange(400)} and" for _ in range(n))
    item = " ".join(f"b{i}" for i in range(20))
    texts = [sentence(rng.randrange(10, 40)) for _ in range(30)]
    texts += [texts[0], texts[0] + " the end", texts[1] + " and done", "# " * 50, "too short", None, "", sentence(8) + " " + item, sentence(20) + " mail a.b@c.example.com now"]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)] + [(None, sentence(12), None, None, None)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame(rows, schema).repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["doc_id"]: tuple(r)[1:] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    stage = quality_rules(spark.createDataFrame(rows, schema)).where("kept").select("doc_id").collect()
    kept = {r["doc_id"]: texts[r["doc_id"]] if r["doc_id"] is not None else rows[-1][1] for r in stage}
    assert {31, 32} & kept.keys() and not {33, 34, 35, 36} & kept.keys()
    same = groups({i: t for i, t in kept.items() if i is not None}, 5, 80)
    kept = {i: t for i, t in kept.items() if i is None or same[i] == i}
    hits = passages(kept, {1: item})
    kept = {i: t for i, t in kept.items() if not (hits[i][1] and 20 * hits[i][1] >= hits[i][0])}
    assert 37 not in kept and 38 in kept
    _, library = reference()
    expected = {}
    for i, t in kept.items():
        t = re.sub(PII_RULES[0], "<EMAIL>", t)
        ids = np.array(library.encode_ordinary(t), "<u4")
        expected[i] = (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), sha(t))
    assert got == expected
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "ngram_jaccard_join", "benchmark_decontamination", "pii", "byte_bpe"]


def test_chat_query_folds_a_real_log(spark, monkeypatch):
    from seqseg.llm import q_chat

    logs = []
    monkeypatch.setattr(q_chat, "fold_events", lambda log: logs.append(log) or chat.fold_events(log))
    q_chat.op7_chat_formatting(spark, "/root/testdata/sf0.001")
    kinds = {r["kind"]: r["count"] for r in logs[0].groupBy("kind").count().collect()}
    assert set(kinds) == {"message", "delta", "edit", "regenerate"} and kinds["message"] == kinds["edit"] + kinds["regenerate"]
    rows = [(c, t, r, x) for c in range(6) for t, (r, x) in enumerate([("user", "é\n😀" * 300), (None, None), ("assistant", ""), ("user", "a"), ("user", "b")])]
    rows += [(1, 0, "user", "second"), (None, 0, "user", "x" * 257)]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(3)
    plain, streamed = (sorted(map(str, chat.fold_events(f(turns)).collect())) for f in (chat.log_of_turns, chat.streamed_log))
    assert plain == streamed and len(plain) == len(rows)


def test_pipeline_stages_on_empty_documents(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    empty = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, str(tmp_path))
        assert out.count() == 0, name
        if name != "byte_bpe":
            assert out.columns == list(corpus_pipeline.COLUMNS)


def test_queries_keep_their_contract(spark):
    import __spark_entry__ as entry

    names = [q for q in entry.queries() if re.match(r"op\d+_", q)]
    assert sorted(int(q[2:].split("_")[0]) for q in names) == list(range(1, 11)) and "pipeline" in entry.queries()
    frame = entry.queries()["op1_toxicity"](spark, "/root/testdata/sf0.001")
    assert {c: k for c, k in frame.dtypes} == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
    assert frame.count() == 200 and frame.where(F.col("score").isNull()).count() == 0


def test_toxicity_scores_equal_plain_loops():
    rng = np.random.default_rng(4)
    model = toxicity.Model(rng.normal(size=toxicity.BUCKETS).astype(np.float32), -0.7)
    texts = ["One two, two three!", "word", "", "a " * 9, "Über den Wolken (ganz) oben", "x" * 40]

    def word_score(word):
        marked, values = f"<{word}>", []
        for size in toxicity.SIZES:
            for i in range(len(marked) - size + 1):
                points = np.array([ord(c) for c in marked[i : i + size]], np.uint64)
                bucket = toxicity.window_hashes(points, size)[0] % np.uint64(toxicity.BUCKETS)
                values.append(float(model.value[int(bucket)]))
        return sum(values) / len(values)

    for text, score in zip(texts, toxicity.Scorer(model).scores(texts)):
        words = toxicity.words_of(text)
        n = min(len(words), toxicity.WINDOW)
        means = [sum(map(word_score, words[i : i + n])) / n for i in range(len(words) - n + 1)] if n else [0.0]
        assert np.isclose(score, 1 / (1 + np.exp(-max(means) - model.bias)))


def test_toxicity_restarts_are_averaged():
    rng = random.Random(3)
    cases = [(" ".join(rng.choice(["fine", "day", "tree"]) for _ in range(20)) + " vile" * (i % 2), i % 2) for i in range(60)]
    both = toxicity.train(cases, restarts=2, seed=1)
    one, two = (toxicity.fit(cases, seed=s) for s in (1, 2))
    assert np.allclose(both.value, (one.value + two.value) / 2) and np.isclose(both.bias, (one.bias + two.bias) / 2)
    low, high = toxicity.Scorer(both).scores(["fine day tree", "fine viles day"])
    assert low < 0.5 < high
