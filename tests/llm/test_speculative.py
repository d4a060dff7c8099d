from __future__ import annotations

import json
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from seqseg.llm import speculative

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id bigint, text string, id string, ids int, decoded string"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def vocabulary():
    return speculative.read_vocabulary(PATH)


def odd_texts(seed: int) -> list[str]:
    rng = random.Random(seed)
    letters = "abcdefghij  \n\t'stré中<|>endoftext0123.,-_=+~ Ᲊ་\x00"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(200))) for _ in range(400)]
    texts += ["<|endoftext|>a <|endoftext|> <|endoftext|><|endoftext|>  x", "<|endoftext|>", "<|endoftext", "", " ", "\n\n "]
    texts += ["x" * 20_000, " " * 3000, "a" * 9999, "-" * 1000 + "=" * 777, "'s's'll 're 'LL", "word " * 9000]
    texts.append("".join(rng.choice("abcxyz") for _ in range(20_000)))
    texts.append("".join(chr(rng.randrange(1, 0xD000)) for _ in range(5000)))
    return texts


def test_ids_equal_the_library(spark, library, vocabulary):
    texts = [None, *odd_texts(3)] * 2
    rows = [(i, t, "x", 1, "y") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    encoded = speculative.encode(docs, PATH, decoded=True)
    assert encoded.columns == ["doc_id", "ids", "decoded"]
    found = {r["doc_id"]: r for r in encoded.collect()}
    for i, expected in enumerate(library.encode_batch([t or "" for t in texts], add_special_tokens=False)):
        assert np.frombuffer(found[i]["ids"], "<u4").tolist() == expected.ids, texts[i]
        assert found[i]["decoded"] == library.decode(expected.ids, skip_special_tokens=False) == (texts[i] or "")
    back = speculative.decode(encoded, PATH)
    assert {r["doc_id"]: r["decoded"] for r in back.collect()} == {i: t or "" for i, t in enumerate(texts)}
    assert speculative.encode(docs.where("false"), PATH, decoded=True).collect() == []


def test_any_ids_decode_like_the_library(library, vocabulary):
    rng, codec = random.Random(5), speculative.Codec(vocabulary)
    for _ in range(500):
        ids = [rng.randrange(50_300) for _ in range(rng.randrange(12))]
        assert codec.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids, skip_special_tokens=False)


def test_pieces_equal_the_library(library, vocabulary):
    codec, split = speculative.Codec(vocabulary), library.pre_tokenizer.pre_tokenize_str
    texts = odd_texts(8)
    for first in range(0x1C80, 0x20000, 0x400):
        points = [chr(c) for c in range(first, first + 0x400) if not 0xD800 <= c < 0xE000]
        texts.append("".join(f"a{c}b 1{c}2 !{c}! {c}{c} " for c in points))
    for text, own in zip(texts, codec.pieces(texts)):
        assert own == [text[a:b] for _, (a, b) in split(text)]


def test_offsets_are_places_in_the_bytes(vocabulary):
    codec = speculative.Codec(vocabulary)
    text = "Ein Übersetzer, 中文 <|endoftext|> x"
    packed = codec.encode([text])[0]
    ids, at = np.frombuffer(packed, "<u4").tolist(), codec.offsets(packed).tolist()
    for i, a in zip(ids, at):
        assert text.encode()[a : a + len(vocabulary.tokens[i])] == vocabulary.tokens[i]


def small_file(tmp_path, seed: int, merges: int, ordered: bool) -> str:
    """A vocabulary over four letters with random merges; merges need not come after those of their parts."""
    rng, names = random.Random(seed), list("abcd")
    pairs = []
    while len(pairs) < merges:
        x, y = rng.choice(names), rng.choice(names)
        if (x, y) in pairs or len(x + y) > 8:
            continue
        pairs.append((x, y))
        if x + y not in names:
            names.append(x + y)
    if not ordered:
        rng.shuffle(pairs)
    letters = speculative.byte_letters()
    every = names + [c for c in letters if c not in names]
    with open(PATH, encoding="utf-8") as file:
        data = json.load(file)
    data["model"]["vocab"] = {t: i for i, t in enumerate(every)}
    data["model"]["merges"] = [list(p) for p in pairs]
    data["added_tokens"] = []
    out = tmp_path / f"{seed}-{ordered}.json"
    out.write_text(json.dumps(data))
    return str(out)


@pytest.mark.parametrize("ordered", [True, False])
def test_checks_hold_for_any_vocabulary(tmp_path, ordered):
    # Tokens with several merges, merges that are never reached, and merges out of order.
    guessed = exact = 0
    for seed in range(25):
        path = small_file(tmp_path, seed, 12 + seed, ordered)
        library, codec = Tokenizer.from_file(path), speculative.Codec(speculative.read_vocabulary(path))
        rng = random.Random(seed)
        texts = ["".join(rng.choice("abcd") for _ in range(rng.randrange(1, 90))) for _ in range(300)]
        for text, packed in zip(texts, codec.encode(texts)):
            assert np.frombuffer(packed, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, (seed, text)
        guessed, exact = guessed + codec.guessed, exact + codec.exact
    assert exact < guessed if ordered else exact


def test_both_exact_merges_agree(vocabulary):
    rng, codec = random.Random(2), speculative.Codec(vocabulary)
    words = ["".join(rng.choice("abcdeilnorst ") for _ in range(rng.randrange(1, 64))).encode() for _ in range(500)]
    assert codec.merge_together(words) == [np.array(codec.merge(w), "<u4").tobytes() for w in words]


def test_a_small_store_of_words_gives_the_same(vocabulary):
    texts = odd_texts(9)
    assert speculative.Codec(vocabulary, limit=5).encode(texts) == speculative.Codec(vocabulary).encode(texts)


def test_other_files_are_refused(tmp_path):
    with pytest.raises(ValueError, match="no plain byte-level"):
        speculative.read_vocabulary(public_tokenizers.path("word_bpe_49k.json"))
