"""The prefix trie against brute force: hot copies, paths beyond the range key, branches at shard borders, odd rows."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quire.llm import prefix_trie as T

ROWS = "conv_id bigint, turn bigint, role string, text string, node string"


def key(role, text):
    role, text = role or "", text or ""
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), len(text)


def brute(rows, grafted=True):
    own = {}
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, *key(role, text)))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    paths = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6 if grafted else 0
        paths[c] = tuple(own.get(c - c % 100, [])[:h] + ts[h:])
    nodes, ends, kids = {}, {}, {}
    for c, p in paths.items():
        ends.setdefault(p, []).append(c)
        for d in range(len(p) + 1):
            nodes.setdefault(p[:d], []).append(c)
            if d:
                kids.setdefault(p[: d - 1], set()).add(p[:d])
    saved, leaves = Counter(), Counter()
    for p, members in nodes.items():
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(members) - 1) * (p[-1][1] if p else 0)
            leaves[p[:d]] += p not in kids
    return Counter(
        (min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), len(kids.get(p, ())), leaves[p], saved[p],
         hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest())
        for p, m in nodes.items()
    )


def result(spark, rows, grafted=True, **more):
    given = T.sequences(spark.createDataFrame(rows, ROWS))
    out = T.with_ends_hash(T.prefix_trie(T.graft(given) if grafted else given, **more))
    return Counter(tuple(r) for r in out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect())


def conversations(seed):
    rnd = random.Random(seed)
    rows = []
    for c in range(0, 700):
        if c % 3 == 0:  # one group of copies holds a third of all
            words = ["hello", "how are you", "fine"]
        elif c % 7 == 1:  # long paths that part after the range key
            words = ["long"] * 34 + [rnd.choice("abc") for _ in range(rnd.randint(0, 5))]
        else:
            words = [rnd.choice(["hello", "x", "yes\nno", "grüße 😀"]) for _ in range(rnd.randint(1, 6))]
        rows += [(c, i, "user" if i % 2 else "assistant", w, "n") for i, w in enumerate(words)]
    return rows


@pytest.mark.parametrize("shard_turns", [30, 400, 500_000])
def test_trie_equals_brute_force(spark, shard_turns):
    rows = conversations(shard_turns)
    assert result(spark, rows, shard_turns=shard_turns) == brute(rows)
    assert result(spark, rows, grafted=False, shard_turns=shard_turns) == brute(rows, grafted=False)


def test_odd_rows(spark):
    rows = [
        (1, None, "user", "first", None), (1, 0, None, None, None), (1, 0, "", "", None), (1, 1, "a", "tie one", None), (1, 1, "a", "tie two", None),
        (1, 1, "a", "tie one", None), (None, 1, "a", "no conversation", None), (7, 3, None, "x" * 100_000, None), (100, 0, "user", "trunk", None),
        (103, 0, "user", "own", None), (-5, 0, "u", "below zero", None), (-200, 1, "u", "t", None), (2**40, 5, "1:a", "b", None), (2**40 + 1, 5, "1", ":ab", None),
    ]
    assert result(spark, rows) == brute(rows)
    # What a turn is must not depend on where its role ends.
    assert result(spark, rows, grafted=False) == brute(rows, grafted=False)
    assert result(spark, rows[:0]) == Counter()


def test_real_outputs(spark):
    rows = [(i, t, "user", f"turn {t}" if t < 2 else f"turn {t} of {i % 2}", None) for i in range(4) for t in range(3)]
    trie = T.prefix_trie(T.sequences(spark.createDataFrame(rows, ROWS)))
    turns = {r.d: r.text for r in spark.createDataFrame(rows, ROWS).select(T.digest(F.col("role"), F.col("text")).alias("d"), "text").collect()}
    pieces = {}
    for r in trie.pieces.orderBy("node", "piece").collect():
        pieces.setdefault(bytes(r.node), []).extend(r.ends)
    seen = {(r.depth, turns.get(r.turn)): (r.n_convs, r.ends if r.ends is not None else pieces.get(bytes(r.node), [])) for r in trie.nodes.collect()}
    assert seen == {(0, None): (4, []), (1, "turn 0"): (4, []), (2, "turn 1"): (4, []), (3, "turn 2 of 0"): (2, [0, 2]), (3, "turn 2 of 1"): (2, [1, 3])}


def test_median_insertion_balances_the_tree():
    tree = T.TernaryTree()
    tree.insert_by_medians([(i,) for i in range(1023)])
    steps = {tree.eq[0]: 1}
    for at in range(1, len(tree.turn)):
        for kid in (tree.lo[at], tree.hi[at]):
            if kid:
                steps[kid] = steps[at] + 1
    assert max(steps.values()) == 10
    order, up, depth = tree.traverse()
    assert len(order) == 1024 and set(up[1:]) == {0} and set(depth[1:]) == {1}
