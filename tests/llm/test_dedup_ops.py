"""Line, substring and near-duplicate dedup against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from quire.llm import simhash, suffix_dedup
from quire.llm.line_dedup import drop_recurring_lines


def templates(docs: list[tuple], leading=3, min_tokens=5, min_docs=3, similarity=0.7) -> dict:
    """Brute-force line dedup: new text by document."""
    mask = lambda line: " ".join("<*>" if re.search("[0-9]", t) else t for t in line.split())
    lines = {i: {mask(x) for x in (t or "").split("\n") if len(x.split()) >= min_tokens} for i, t in docs}
    leaf = lambda m: (len(m.split()), *m.split()[:leading])
    at = Counter((leaf(m), k, t) for own in lines.values() for m in own for k, t in enumerate(m.split()))

    def template(m):
        held = [t != "<*>" and at[leaf(m), k, t] >= min_docs for k, t in enumerate(m.split())]
        return tuple(t if h else "<*>" for t, h in zip(m.split(), held, strict=True)) if sum(held) >= similarity * len(held) - 1e-12 else m

    where = defaultdict(set)
    for i, own in lines.items():
        for m in own:
            where[template(m)].add(i)
    gone = lambda i, m: len(m.split()) >= min_tokens and len(where[template(m)]) >= min_docs and min(where[template(m)]) != i
    return {i: t and "\n".join(x for x in t.split("\n") if not gone(i, mask(x))) for i, t in docs}


def test_lines_of_recurring_templates_go(spark):
    rnd = random.Random(4)
    rows = []
    for i in range(60):
        own = [" ".join(rnd.choice("abcdefgh") * rnd.randint(1, 3) for _ in range(rnd.randint(1, 9))) for _ in range(4)]
        if i % 3:
            own.insert(rnd.randint(0, 4), f"user {rnd.choice(['ann', 'bob'])} logged in from host h{i} at {i}:00 today")
        if i % 4 == 0:
            own.append("all rights reserved by the owner of this text")
        rows.append((i, None if i == 50 else "\n".join(own)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: (r.text, r.n_lines_dropped) for r in drop_recurring_lines(docs, min_docs=3).collect()}
    want = templates(rows)
    assert {i: x[0] for i, x in got.items()} == want
    assert sum(n for _, n in got.values()) == sum((a or "").count("\n") - (b or "").count("\n") for (_, a), b in zip(rows, want.values(), strict=True) if a and b) > 30


def test_long_lines_go_from_the_second_document_and_short_ones_from_the_tenth(spark):
    long, numbers = "one sentence of more than eight words that two documents share", " ".join(str(k) for k in range(60))
    rows = [(i, f"All rights reserved.\n}}\n\n17\nown text number {i}") for i in range(12)]
    rows += [(20, long), (21, f"head\n{long}"), (22, numbers), (23, f"{numbers}\ntail"), (24, " ".join(str(k) for k in range(100, 160)))]
    rows += [(30 + k, "two words\nfour or five short words") for k in range(9)]
    got = {r.doc_id: r.text for r in drop_recurring_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    want = {i: t if i == 0 else t.split("\n", 1)[-1] for i, t in rows[:12]} | {20: long, 21: "head", 22: numbers, 23: "tail"} | dict(rows[16:])
    assert got == {i: t.rsplit("\n", 1)[0] if 0 < i < 12 else t for i, t in want.items()}


def test_templates_with_word_fields_recur_at_every_size(spark):
    word = lambda k: chr(97 + k // 26) + chr(97 + k % 26)
    for n in (100, 2500):
        rows = [(i, f"Filed under the topic {word(i % 50)} by author {word(i // 50 % 50)} today") for i in range(n)]
        rows += [(n + i, f"Filed under the {word(i % 676)} {word(i // 26 % 676)} {word(i * 7 % 676)} {word(i * 11 % 676)} {word(i * 13 % 676)} {i} x") for i in range(n)]
        docs = spark.createDataFrame(rows, "doc_id bigint, text string")
        got = {r.doc_id for r in drop_recurring_lines(docs.filter(f"doc_id < {n}"), min_docs=10).filter("n_lines_dropped > 0").collect()}
        assert got == set(range(1, n))
        assert {r.doc_id for r in drop_recurring_lines(docs).filter("n_lines_dropped > 0").collect()} >= set(range(1, n))


def test_line_dedup_edges(edge_docs, no_docs):
    out = drop_recurring_lines(edge_docs, min_docs=2)
    assert out.columns == [*edge_docs.columns, "n_lines_dropped"] and out.count() == edge_docs.count()
    texts = Counter((r.doc_id, r.text) for r in out.collect())
    assert texts[None, ""] == 1 and texts[None, None] == 1  # the copy of document 4, whose id is not null
    assert drop_recurring_lines(no_docs).collect() == []


def test_suffix_array_is_the_sorted_order():
    rnd = random.Random(1)
    for _ in range(400):
        text = [rnd.randint(1, rnd.choice([1, 2, 3, 6])) for _ in range(rnd.randint(0, 40))] + [0]
        assert suffix_dedup.suffix_array(np.array(text)).tolist() == sorted(range(len(text)), key=lambda i: text[i:])


def removed(rows: list[tuple]) -> dict:
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 99):
            if b[s : s + 100] in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(b[s : s + 100])
        runs = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(b), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("block_bytes", [1 << 24, 3000])
def test_repeated_bytes_go(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", block_bytes)
    rnd = random.Random(5)
    base = ["".join(rnd.choice("ab ") for _ in range(400)) for _ in range(6)]
    rows = [(i, "".join(rnd.choice(base)[rnd.randint(0, 300) :][: rnd.randint(50, 200)] + rnd.choice(["", "x", "é", str(rnd.random())]) for _ in range(rnd.randint(0, 5)))) for i in range(200)]
    rows += [(1000, "a" * 500), (1001, "a" * 99), (1002, "a" * 100), (1003, "ab" * 300), (1004, None), (1005, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(docs).collect()}
    assert got == removed(rows)


def test_suffix_dedup_edges(edge_docs, no_docs):
    rows = suffix_dedup.remove_repeats(edge_docs).collect()
    assert len(rows) == edge_docs.count() and sum(r.doc_id is None for r in rows) == 2
    by = {r.doc_id: r for r in rows}
    assert by[8].n_removed == 300_000 - 1 and by[8].n_spans == 1 and by[2].n_bytes == 0
    assert all(r.n_removed == sum(s.end - s.start for s in r.spans) for r in rows)
    assert suffix_dedup.remove_repeats(no_docs).collect() == []


def simhash_groups(rows: list[tuple], words: int) -> dict:
    fps = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        shingles = [b" ".join(w[k : k + words]) for k in range(max(1, len(w) - words + 1))] if w else []
        h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        fps[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    parent = {i: i for i in fps}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in fps:
        for j in fps:
            if i < j and (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (f"{fps[i]:016x}", root(i)) for i in fps}


@pytest.mark.parametrize("room", [4096, 2])
def test_simhash_groups(spark, prose, room):
    rnd = random.Random(8)
    rows = []
    for i in range(0, 160, 4):
        words = prose(rnd, "en", rnd.randint(1, 150)).split()
        for k in range(4):
            own = list(words)
            for _ in range(k % 3):
                own[rnd.randrange(len(own))] = "changed"
            rows.append((i + k, " ".join(own).title() if k == 3 else " ".join(own)))
    rows += [(1000, None), (1001, ""), (1002, " \n")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicate_groups(docs, room=room).collect()}
    assert got == simhash_groups(rows, 3)


def test_groups_that_stay_large_are_dealt_out_in_tiles(spark):
    members = spark.range(3000).selectExpr("id AS fp", "1L AS mask", "IF(id < 2900, 0L, 1L) AS value")
    groups = defaultdict(set)
    for r in simhash.tiled(members, members.groupBy("mask", "value").count(), 400).collect():
        groups[r.value, r.low, r.high].add(r.fp)
    assert max(map(len, groups.values())) <= 500 and len(groups[1, 0, 0]) == 100
    met = np.zeros((2900, 2900), bool)
    for (value, _, _), own in groups.items():
        if value == 0:
            met[np.ix_(sorted(own), sorted(own))] = True
    assert met.all()


def test_links_and_components(spark):
    rng = np.random.default_rng(2)
    centre = rng.integers(0, 1 << 64, 1, np.uint64)[0]
    fps = np.unique(np.array([centre ^ np.bitwise_or.reduce([np.uint64(1) << np.uint64(rng.integers(0, 64)) for _ in range(rng.integers(1, 6))]) for _ in range(3000)], np.uint64))
    pairs = {(min(a, b), max(a, b)) for i, j in simhash.links_within(fps, 3) for a, b in zip(i.tolist(), j.tolist(), strict=True)}
    want = {(i, int(j)) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 3) if i < j}
    assert pairs == want
    chain = spark.range(1, 300).selectExpr("id as a", "id - 1 as b")
    assert {(r.node, r.root) for r in simhash.components(chain).collect()} == {(k, 0) for k in range(1, 300)}


def test_one_of_each_edges(edge_docs, no_docs):
    kept = simhash.one_of_each(edge_docs)
    rows = kept.collect()
    assert kept.columns == edge_docs.columns
    # One of the empty ones (2, 3, null, 5), one of the two equal rows, 4 instead of its copy with a null id.
    assert Counter(r.doc_id for r in rows) == {1: 1, 2: 1, 4: 1, 6: 1, 7: 1, 8: 1, 9: 1}
    assert simhash.one_of_each(no_docs).collect() == []
