"""Spelling variants against brute force: small cells, hot cells in parts, anagrams, long and odd texts."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from quire.llm import spelling as S


def counted(docs, least=7):
    total = Counter()
    for doc_id, text in docs:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least:
                total[run] += 1
    return {w: n for w, n in total.items() if n >= 2}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute(n):
    rows, form = {}, {}
    for w in n:
        close = [x for x in n if abs(len(x) - len(w)) < 2 and x != w and near(w, x)]
        best = min(close, key=lambda x: (-n[x], x), default=None)
        if best is not None and n[best] >= 10 * n[w]:
            form[w] = best
        rows[w] = len(close)
    def root(w):
        while w in form:
            w = form[w]
        return w
    return {(w, form.get(w), root(w), n[w], k, n.get(form.get(w))) for w, k in rows.items()}


def corpus(seed, size=120):
    """Words with misspelt forms in chains, anagrams of one another, accents and capitals."""
    rnd = random.Random(seed)
    letters = "abcdeéßÀ÷"
    stems = ["".join(rnd.choice(letters) for _ in range(rnd.randint(6, 10))) for _ in range(25)]
    anagrams = ["".join(rnd.sample("abcdabcd", 8)) for _ in range(30)]
    docs = []
    for i in range(size):
        words = []
        for _ in range(60):
            w = rnd.choice(stems[:8] * 6 + stems + anagrams)
            for _ in range(rnd.choice([0, 0, 0, 1, 1, 2])):
                at = rnd.randrange(len(w))
                w = rnd.choice([w[:at] + w[at + 1 :], w[:at] + rnd.choice(letters) + w[at:], w[:at] + rnd.choice(letters) + w[at + 1 :]])
            words.append(w.upper() if rnd.random() < 0.1 else w)
        docs.append((i, rnd.choice([" ", "\n", "1", "ĀŻ"]).join(words)))
    return docs


def rows_of(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize(("cell", "sample"), [(20, 40), (100, 1000), (32_000, 40_000)])
def test_variants_equal_brute_force(spark, cell, sample):
    docs = corpus(cell)
    want = counted(docs)
    words = S.count_words(spark.createDataFrame(docs, "doc_id bigint, text string")).filter("n >= 2")
    assert {r.word: r.n for r in words.collect()} == want
    assert rows_of(S.variants(words, cell=cell, sample=sample)) == brute(want)


def test_sql_equals_brute_force():
    docs = corpus(5, 40) + [(None, "zebrastripes zebrastripes"), (None, None), (-7, "")]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    cursor = con.execute(S.ORACLE)
    at = [[d[0] for d in cursor.description].index(c) for c in ("word", "form", "root", "n", "n_near", "form_n")]
    assert {tuple(r[i] for i in at) for r in cursor.fetchall()} == brute(counted(docs))


def test_cells_of_anagrams_come_in_parts(spark):
    rnd = random.Random(2)
    words = sorted({"".join(rnd.sample("aabbccddee", 10)) for _ in range(300)} | {"".join(rnd.sample("aabbccddef", 10)) for _ in range(300)})
    n = {w: rnd.choice([2, 3, 40, 900]) for w in words}
    df = spark.createDataFrame(list(n.items()), "word string, n long")
    assert rows_of(S.variants(df, cell=16, sample=50)) == brute(n)


def test_crowded_vectors_are_looked_up():
    rnd = random.Random(3)
    a = S.Group(sorted({"".join(rnd.sample("aabbccd", 7)) for _ in range(400)}), [2] * 400)
    for letters in ("aabbcce", "aabbccdd"):
        b = S.Group(sorted({"".join(rnd.sample(letters, len(letters))) for _ in range(400)}), [2] * 400)
        tree, _ = S.build(b.vectors, S.LEAF)
        found = [{(int(x), int(y)) for u, v in S.near_pairs(tree, b, a, crowd=crowd) for x, y in zip(u, v, strict=True)} for crowd in (0, 10**9)]
        assert found[0] == found[1] == {(i, j) for i, x in enumerate(a.words) for j, y in enumerate(b.words) if near(x, y)} and found[0]


def test_reach_visits_every_leaf_within_one_step_up_and_down():
    rnd = np.random.default_rng(4)
    points = rnd.integers(0, 4, (400, 6))
    tree, leaves = S.build(points, 5)
    home = {}
    for node, who in S.reach(tree, points, S.NONE, S.NONE):
        home.update(dict.fromkeys(who.tolist(), node.leaf))
    visited = {(q, node.leaf) for node, who in S.reach(tree, points, S.FREE, S.FREE) for q in who.tolist()}
    for q in range(400):
        step = points - points[q]
        for p in np.flatnonzero((np.maximum(step, 0).sum(1) <= 1) & (np.maximum(-step, 0).sum(1) <= 1)).tolist():
            assert (q, home[p]) in visited
    assert leaves > 50 and len(visited) < 400 * leaves / 2  # the rest is pruned


def test_odd_documents(spark, edge_docs, no_docs):
    docs = [(r.doc_id, r.text) for r in edge_docs.collect()] + [(7, "Straßenlärm " * 3 + "Straßenlärme")]
    more = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = rows_of(S.variants(S.count_words(more).filter("n >= 2")))
    assert got == brute(counted(docs)) and any(w == "straßenlärm" for w, *_ in got)
    assert rows_of(S.variants(S.count_words(edge_docs).filter("n >= 2"))) == brute(counted(docs[:-1]))
    assert S.variants(S.count_words(no_docs)).collect() == []
    long = spark.createDataFrame([("x" * 50_000, 90), ("x" * 49_999 + "y", 2), ("x" * 50_001, 5)], "word string, n long")
    assert {(r.n, r.n_near, r.form_n) for r in S.variants(long).collect()} == {(90, 2, None), (2, 1, 90), (5, 1, 90)}
