from __future__ import annotations

import random
import zlib

import pytest
from llm_plain import sha

from seqseg.llm import conversation_trie as ct

SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth int, conv string, n int, steps int, path string"


def rebuilt_plain(rows):
    own: dict[int, list] = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    out = {}
    for c, ts in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        source = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        out[c] = turns.get(source, [])[:h] + ts[h:]
    return out


def plain(rows):
    sequences = rebuilt_plain(rows)
    members: dict[tuple, list] = {}
    for c, ts in sequences.items():
        for d in range(len(ts) + 1):
            members.setdefault(tuple(ts[:d]), []).append(c)
    out = []
    for node, convs in members.items():
        d = len(node)
        below = [v for v in members if v[:d] == node]
        children = [v for v in below if len(v) == d + 1]
        leaves = sum(not any(len(w) == len(v) + 1 and w[: len(v)] == v for w in below) for v in below)
        saved = sum((len(members[v]) - 1) * len(v[-1][1].encode()) for v in below if v)
        ends = sorted(c for c in convs if len(sequences[c]) == d)
        up = min(members[node[:-1]]) if d else None
        out.append((min(convs), d, up, len(convs), len(children), leaves, saved, sha(",".join(map(str, ends)))))
    return sorted(out)


def table(spark, rows, parts=3):
    return spark.createDataFrame([(*r, 1, "c", 2, 3, "p") for r in rows], SCHEMA).repartition(parts)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def found(nodes):
    assert nodes.columns == COLUMNS
    return sorted(tuple(r) for r in nodes.collect())


def log(seed: int, convs: int = 120):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-30, 400), convs):
        if rng.random() < 0.3:
            turns = [("user", "hello"), ("assistant", "hi é"), ("user", "bye")]
        else:
            turns = [(rng.choice(["user", "assistant", None]), rng.choice(["a", "bb", "", None, "ü中"])) for _ in range(rng.randrange(1, 12))]
        for i, (role, text) in enumerate(turns):
            rows.append((c, rng.choice([i, i, i, None, 3]), role, text))
    rows += [(2**63 - 1, 0, "user", "x"), (-(2**63), 0, "user", "x"), (None, 0, "user", "y"), rows[0], rows[0]]
    rows += [(1000, i, "user", str(i)) for i in range(300)]  # one long conversation
    return rows


@pytest.mark.parametrize(
    "sizes",
    [{}, {"shard_turns": 1, "spines": 2, "members": 1}, {"shard_turns": 40, "spines": 3, "members": 4}],
    ids=["default", "one sequence a shard", "small"],
)
def test_nodes_equal_brute_force(spark, monkeypatch, sizes):
    if sizes:
        monkeypatch.setattr(ct, "BATCH", 3)
    rows = log(len(sizes) + sizes.get("shard_turns", 0))
    assert found(ct.conversation_trie(table(spark, rows), **sizes)) == plain(rows)


def test_copies_of_one_conversation(spark):
    rows = [(c, t, "user", f"same {t}") for c in range(200) for t in range(12)]
    assert found(ct.conversation_trie(table(spark, rows), members=7, spines=2, shard_turns=10)) == plain(rows)


def test_turnless_conversations_end_at_the_root(spark):
    short = [c for c in range(1, 200) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 0][:4]
    rows = [(c, 0, "user", "gone") for c in short]
    nodes = found(ct.conversation_trie(table(spark, rows)))
    assert nodes == plain(rows)
    assert (min(short), 0, None, len(short), 0, 1, 0, sha(",".join(map(str, short)))) in nodes


def test_empty_table(spark):
    docs = table(spark, log(1)[:5])
    assert found(ct.conversation_trie(docs.where("false"))) == []
    assert found(ct.conversation_trie(docs.where("conv_id IS NULL"))) == []


def test_siblings_are_balanced():
    tree = ct.Tree()
    for i in ct.medians(1023):
        tree.insert([i], [1], 1, i, "")
    deepest, stack = 0, [(tree.down[0], 1)]
    while stack:
        node, level = stack.pop()
        if node >= 0:
            deepest = max(deepest, level)
            stack += [(tree.less[node], level + 1), (tree.more[node], level + 1)]
    assert deepest == 10
    assert [tree.turn[n] for n in tree.preorder()[1:]] == list(range(1023))


def test_a_deep_conversation_needs_no_recursion():
    rows = [(i, 1, "e", list(range(5000 + i)), [2] * (5000 + i)) for i in range(2)]
    final, spine = ct.shard_nodes(rows)
    assert final == [] and len(spine) == 5002 and spine[0]["n"] == 2
