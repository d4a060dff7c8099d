from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from seqseg.llm import repeats, similar
from seqseg.llm.components import components
from seqseg.llm.decontaminate import contamination, find_passages
from seqseg.llm.repeats import remove_repeats
from seqseg.llm.similar import similar_documents

from llm_plain import groups, passages
from llm_plain import repeats as plain_repeats

SCHEMA = "doc_id bigint, text string, n int, id string, key int, tag int, n_words string"


def table(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, 1, "x", 2, 3, "y") for i, t in rows], SCHEMA).repartition(parts)


def near_copies(seed: int, copies: int = 40, words: int = 120):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(500)}" for _ in range(words)]
    rows = []
    for i in range(copies):
        own = list(base)
        for _ in range(rng.randrange(12)):
            own[rng.randrange(len(own))] = f"n{rng.randrange(10_000)}"
        rows.append((i, " ".join(own)))
    rows += [(100 + i, " ".join(f"w{rng.randrange(500)}" for _ in range(rng.randrange(1, 90)))) for i in range(40)]
    rows += [(200, rows[3][1]), (201, rows[3][1].upper()), (202, "a b c"), (203, "a b c"), (204, "a b"), (205, ""), (206, None), (207, " \t\n"), (208, "a b c d")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("size", "percent", "small", "tile"), [(4, 85, 8, 2048), (5, 80, 8, 2048), (4, 85, 3, 2048)])
def test_similar_documents_equal_brute_force(spark, monkeypatch, size, percent, small, tile):
    monkeypatch.setattr(similar, "TILE", 7 if small == 3 else tile)
    rows = near_copies(size * percent + small)
    found = similar_documents(table(spark, rows), size=size, percent=percent).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == groups(dict(rows), size, percent)


@pytest.mark.parametrize(("size", "percent"), [(4, 85), (5, 80)])
def test_interleaved_copies_of_templates_are_linked(spark, size, percent):
    # Every set shares all its buckets with others, which lie between its copies in id order.
    form = "name{} was seen at the gate of the old mill near town{}"
    rows = [(r * 25 + x * 5 + y, form.format(x, y)) for r in range(6) for x in range(5) for y in range(5)]
    found = similar_documents(table(spark, rows), size=size, percent=percent).collect()
    expected = groups(dict(rows), size, percent)
    assert len(set(expected.values())) == 25
    assert {r["doc_id"]: r["component_id"] for r in found} == expected


def test_similar_documents_null_ids_repeats_and_empty(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(None, text), (5, text), (5, text), (7, text), (8, None)]
    found = sorted(similar_documents(table(spark, rows)).collect(), key=str)
    assert sorted((str(r[0]), r[1], str(r[2])) for r in found) == [
        ("5", 47, "5"), ("5", 47, "5"), ("7", 47, "5"), ("8", 0, "8"), ("None", 47, "None"),
    ]
    assert similar_documents(table(spark, rows).where("false")).count() == 0


def test_sketch_distance_is_a_lower_bound():
    import numpy as np

    from seqseg.llm.arrays import WordHashes

    rng = random.Random(3)
    texts = [t.encode() for _, t in near_copies(9) if t]
    values, starts = similar.shingle_sets(texts, WordHashes(), 4)
    n = np.diff(starts)
    docs, band = similar._memberships(n, 85)[0]
    mixed, place, first, k = similar._blocks(values, starts, docs, band, 85)
    bits = np.zeros(first[-1], np.uint16)
    np.bitwise_xor.at(bits, place, np.uint16(1) << ((mixed >> np.uint64(44)) % np.uint64(16)).astype(np.uint16))
    for _ in range(300):
        x, y = rng.randrange(len(docs)), rng.randrange(len(docs))
        if band[x] != band[y]:
            continue
        differ = int(np.bitwise_count(bits[first[x] : first[x + 1]] ^ bits[first[y] : first[y + 1]]).sum())
        sets = [set(values[starts[docs[d]] : starts[docs[d] + 1]].tolist()) for d in (x, y)]
        assert differ <= len(sets[0] ^ sets[1])


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(1, i) for i in range(2, 30)] + [(30, 29), (500, 501), (7, 7)]
    found = components(spark.createDataFrame(links, "a bigint, b bigint")).collect()
    expected = {i: 100 for i in range(100, 141)} | {i: 1 for i in range(1, 31)} | {500: 500, 501: 500}
    assert {r["node"]: r["component"] for r in found} == expected and len(found) == len(expected)


def passage_rows(seed: int, depth: int):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(40)}"
    shared = [[word() for _ in range(rng.randrange(depth, 3 * depth))] for _ in range(4)]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(rng.randrange(0, 5)):
            parts += [word() for _ in range(rng.randrange(0, depth))]
            if rng.random() < 0.6:
                piece = rng.choice(shared)
                parts += piece[rng.randrange(3) :]
        rows.append((i, " ".join(parts)))
    return [*rows, (70, rows[5][1]), (71, rows[5][1]), (72, None), (73, ""), (None, rows[5][1])]


@pytest.mark.parametrize("limit, share", [(50_000, 1_000), (3, 1), (0, 30), (0, 1_000)])
def test_remove_repeats_equals_brute_force(spark, limit, share):
    rows = passage_rows(11, 10)
    found = remove_repeats(table(spark, rows), depth=10, gram=5, group_limit=limit, share=share).collect()
    got = {r["doc_id"]: tuple(r) for r in found}
    expected = {r[0]: r for r in plain_repeats([r for r in rows if r[0] is not None], 10)}
    nulls = got.pop(None)
    assert got == expected
    assert nulls[2] == 0 and nulls[3] == " ".join(rows[5][1].split())


@pytest.mark.parametrize("share", [1, 4, 1_000])
def test_join_summary_equals_a_plain_join(spark, share):
    rows = spark.createDataFrame([(k, i) for k, n in ((1, 60), (2, 25), (3, 3), (4, 1)) for i in range(n)], "k int, i int")
    summary = rows.groupBy("k").agg(F.max("i").alias("top"), F.count("*").alias("n")).where("k <> 3")
    found = repeats.join_summary(rows, summary, "k", share)
    plain = rows.join(summary.drop("n"), "k")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, plain.collect()))
    assert repeats.join_summary(rows, summary.where("false"), "k", share).count() == 0


def test_remove_repeats_of_one_id_and_empty(spark):
    text = " ".join(f"w{i}" for i in range(20))
    rows = [(1, text), (1, text), (1, "x " + text), (2, text + " y")]
    found = sorted(map(tuple, remove_repeats(table(spark, rows), depth=10, gram=5).collect()))
    assert [r[:3] for r in found] == [(1, 20, 0), (1, 20, 0), (1, 21, 0), (2, 21, 20)]
    assert found[3][3] == "y"
    assert remove_repeats(table(spark, rows).where("false")).count() == 0


def test_subtrees_go_over_batch_borders():
    import pyarrow as pa

    rows = [(g, i, 0, 0, [g * 10, g * 10 + 1]) for g in range(5) for i in range(4)]
    columns = list(zip(*rows))
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64())]
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["gram", "id", "tag", "start", "nodes"])
    for width in (1, 3, 7, 20):
        parts = [batch.slice(a, width) for a in range(0, batch.num_rows, width)]
        out = [r for b in repeats._subtrees(iter(parts), 10) for r in zip(b["id"].to_pylist(), b["from"].to_pylist(), b["to"].to_pylist())]
        assert sorted(out) == sorted((i, 0, 11) for _ in range(5) for i in (1, 2, 3)), width


def bench_rows(seed: int):
    rng = random.Random(seed)
    items = {i: " ".join(f"b{rng.randrange(60)}" for _ in range(rng.choice([1, 5, 12, 13, 14, 40]))) for i in range(12)}
    items |= {50: items[3], 51: "", 52: None}
    docs = {}
    for i in range(80):
        parts = [f"b{rng.randrange(60)}" for _ in range(rng.randrange(0, 30))]
        for _ in range(rng.randrange(3)):
            piece = (items[rng.randrange(12)] or "").split()
            parts += [w.upper() + rng.choice(["", "!", ","]) for w in piece[rng.randrange(2) :]] + ["x"] * rng.randrange(4)
        docs[i] = " ".join(parts)
    return docs | {90: None, 91: "", 92: "é" * 5}, items


@pytest.mark.parametrize("block_words", [2_000_000, 60])
def test_passages_equal_brute_force(spark, block_words):
    docs, items = bench_rows(5)
    benchmark = spark.createDataFrame(list(items.items()), "item_id bigint, text string")
    found = contamination(find_passages(table(spark, list(docs.items())), benchmark, block_words=block_words))
    got = {
        r["doc_id"]: (r["n_words"], r["n_hit"], sorted(map(str, r["items"])), r["contaminated"]) for r in found.collect()
    }
    expected = {i: (*v, v[1] > 0 and 20 * v[1] >= v[0]) for i, v in passages(docs, items).items()}
    assert got == expected


def test_passages_without_benchmark_or_documents(spark):
    docs = table(spark, [(1, "a b"), (None, "c"), (1, "a b")])
    benchmark = spark.createDataFrame([], "item_id bigint, text string")
    found = find_passages(docs, benchmark)
    assert sorted(r["n_words"] for r in found.collect()) == [1, 2, 2]
    assert find_passages(docs.where("false"), benchmark).count() == 0
    assert found.where(F.size("items") > 0).count() == 0
