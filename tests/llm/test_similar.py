"""Near duplicates by shingle similarity against exact similarities."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from quire.llm import similar
from quire.llm.decontam import shingle_counts


@pytest.fixture(scope="module")
def families(prose):
    """Texts in families: the first, an exact copy, and copies with a few changed words."""
    rnd, rows = random.Random(21), []
    for f in range(60):
        words = prose(rnd, "en", rnd.randint(110, 300)).split()
        rows.append((10 * f, " ".join(words)))
        rows.append((10 * f + 1, rows[-1][1]))
        for k in range(2, 2 + f % 4):
            own = list(words)
            for _ in range(max(1, len(own) // 120)):
                own[rnd.randrange(len(own))] = prose(rnd, "de", 1)
            rows.append((10 * f + k, "\n".join(own).title()))
    return rows


def test_near_copies_go_and_others_stay(spark, families):
    counts = {i: shingle_counts(t.encode().lower().split()) for i, t in families}
    for i, c in counts.items():  # the fixture's near copies are similar, its families are not
        head = counts[10 * (i // 10)]
        assert (c & head).total() / (c | head).total() >= 0.85
    docs = spark.createDataFrame(families, "doc_id bigint, text string").repartition(5)
    assert {r.doc_id for r in similar.one_of_similar(docs).collect()} == {10 * f for f in range(60)}


def test_estimate_follows_the_similarity():
    rng = np.random.default_rng(4)
    for shared in (0.5, 0.8, 0.95):
        n = 800
        both = int(n * 2 * shared / (1 + shared))
        a = rng.integers(0, 1 << 64, n, np.uint64)
        b = np.concatenate([a[:both], rng.integers(0, 1 << 64, n - both, np.uint64)])
        bits = np.bitwise_count(similar.wide_fingerprint(a) ^ similar.wide_fingerprint(b)).sum()
        assert abs(int(bits) - similar.differing(shared)) <= 24


def test_choices_hold_the_recall():
    for n in (10, 300_000, 14_000_000):
        chosen = similar.choices(n)
        size = len(chosen[0])
        assert 1 - (1 - (1 - 0.1526) ** size) ** len(chosen) > 0.985 and all(len(set(c.tolist())) == size for c in chosen)


def test_large_groups_give_a_forest():
    rng = np.random.default_rng(2)
    centre = rng.integers(0, 1 << 64, similar.LANES, np.uint64)
    fps = np.stack([centre ^ np.packbits(rng.random(256) < p, bitorder="little").view(np.uint64) for p in rng.uniform(0, 0.3, 2500)])
    pairs = {(min(a, b), max(a, b)) for i, j in similar.group_links(fps, 39) for a, b in zip(i.tolist(), j.tolist(), strict=True)}
    want = set()
    for i in range(len(fps)):
        want |= {(i, int(j)) for j in np.flatnonzero(similar.distance(fps, fps[i]) <= 39) if i < j}
    assert pairs == want and len(similar.forest(np.arange(len(fps)), fps, 39)) < len(fps)


def test_links_are_verified_at_the_limit_and_large_families_are_linear(spark, monkeypatch):
    rnd, rows, want = random.Random(3), [], set()

    def changed(words, k, tag):
        return [f"{w}{tag}" if i % (len(words) // k) == 7 else w for i, w in enumerate(words)]

    for f in range(40):  # similarity just above and just below the limit
        words = [f"w{rnd.randrange(10**9)}" for _ in range(400)]
        near, far = changed(words, 8, "x"), changed(words, 12, "y")
        for w, limit in ((near, 0.8), (far, 0.7)):
            a, b = (shingle_counts([x.encode() for x in t]) for t in (words, w))
            s = (a & b).total() / (a | b).total()
            assert limit <= s < limit + 0.1 and (limit == 0.8) == (s >= 0.8)
        rows += [(10 * f, " ".join(words)), (10 * f + 1, " ".join(near)), (1000 + f, " ".join(f"{x}z" for x in words)), (2000 + f, " ".join(f"{x}z" for x in far))]
        want |= {10 * f, 1000 + f, 2000 + f}
    words = [f"v{rnd.randrange(10**9)}" for _ in range(200)]
    rows += [(5000 + k, " ".join([*words[:50], f"n{k}", *words[51:]])) for k in range(400)]
    want.add(5000)
    sizes = []
    check = similar.verified
    monkeypatch.setattr(similar, "verified", lambda pairs, *a: sizes.append(pairs.count()) or check(pairs, *a))
    monkeypatch.setattr(similar, "LARGE", 16)
    monkeypatch.setattr(similar, "ROOM", 32)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.doc_id for r in similar.one_of_similar(docs).collect()} == want
    assert len(sizes) == 2 and sum(sizes) < 400 * len(similar.choices(2)) < 400 * 399 // 3  # a leader for each text and place at most


def test_bucket_counts_never_exceed_the_difference():
    rng = np.random.default_rng(8)
    texts = [rng.integers(0, 1 << 64, n, np.uint64) for n in (0, 90, 250, 260, 700, 9000)]
    texts += [np.concatenate([t[: len(t) * 9 // 10], rng.integers(0, 1 << 64, 30, np.uint64)]) for t in texts]
    texts += [np.repeat(np.uint64(7), n) for n in (250, 260, 600)]
    i, j = np.triu_indices(len(texts), 1)
    counts = [similar.bucket_counts(t) for t in texts]
    assert {len(c) for c in counts} == {256, 512, 1024, 4096}
    bounds = similar.apart_at_least(i, j, counts)
    of = [Counter(t.tolist()) for t in texts]
    exact = np.array([((of[a] - of[b]) + (of[b] - of[a])).total() for a, b in zip(i.tolist(), j.tolist(), strict=True)])
    assert (bounds <= exact).all() and (bounds[(exact < 200) & (i < 12) & (j < 12)] > 0).all()


def test_near_but_not_similar_texts_are_not_all_compared(spark, monkeypatch):
    """One family whose texts are near one another in bits, but similar only in the pairs that are planted."""
    rnd, n = random.Random(9), 600
    words, rows, want = [f"w{k}" for k in range(200)], [], set()
    for k in range(n):
        own = list(words)
        for at in rnd.sample(range(200), 6):
            own[at] = f"n{k}x{at}"
        rows.append((k, " ".join(own)))
        want.add(k)
    for k in range(0, n, 20):  # one more word changed: similar to its model and to nothing else
        own = rows[k][1].split()
        own[100] = f"m{k}"
        rows.append((n + k, " ".join(own)))
    counts = [shingle_counts(t.encode().split()) for _, t in rows[:40]]
    near = [(a & b).total() / (a | b).total() for x, a in enumerate(counts) for b in counts[:x]]
    assert max(near) < 0.8 and np.mean(near) > 0.55
    sizes = []
    check = similar.verified
    monkeypatch.setattr(similar, "verified", lambda pairs, *a: sizes.append(pairs.count()) or check(pairs, *a))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = {r.doc_id for r in similar.one_of_similar(docs).collect()}
    assert kept == want
    assert sum(sizes) < 20 * n


def test_similar_edges(edge_docs, no_docs):
    kept = similar.one_of_similar(edge_docs)
    assert kept.columns == edge_docs.columns
    # One of the empty ones (2, 3, null, 5), one of the two equal rows, 4 instead of its copy with a null id.
    assert Counter(r.doc_id for r in kept.collect()) == {1: 1, 2: 1, 4: 1, 6: 1, 7: 1, 8: 1, 9: 1}
    assert similar.one_of_similar(no_docs).collect() == []


@pytest.mark.parametrize("large, room", [(64, 4096), (8, 16)])
def test_pairs_are_given_off_once_and_none_is_left_out(spark, monkeypatch, large, room):
    """Texts near one another in bits meet in many places; a few pairs of them are similar."""
    rnd, n = random.Random(14), 400
    words, rows = [f"w{k}" for k in range(200)], []
    for k in range(n):
        own = list(words)
        for at in rnd.sample(range(200), 6):
            own[at] = f"n{k}x{at}"
        rows.append((k, " ".join(own)))
    for k in range(0, n, 10):
        own = rows[k][1].split()
        own[100] = f"m{k}"
        rows.append((n + k, " ".join(own)))
    seen, real = [], similar.first_pairs

    def first_pairs(members, radius, *more):
        out = real(members, radius, *more)
        seen.append((members.collect(), out.collect(), radius))
        return out

    monkeypatch.setattr(similar, "first_pairs", first_pairs)
    monkeypatch.setattr(similar, "LARGE", large)
    monkeypatch.setattr(similar, "ROOM", room)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.doc_id for r in similar.one_of_similar(docs).collect()} == set(range(n))
    members, out, radius = seen[0]
    given = [(r.a, r.b) for r in out if r.b is not None]
    assert len(set(given)) == len(given)
    assert any(r.tiles for r in members) == (room == 16)
    if room > 16:
        groups, later, near = {}, {}, set()
        for r in members:
            groups.setdefault(r.group, []).append((r.node, np.frombuffer(r.fp, np.uint64)))
        for r in out:
            if r.b is None:
                later.setdefault(r.group, set()).add(r.a)
        for g in groups.values():
            g.sort(key=lambda x: x[0])
            fps = np.stack([fp for _, fp in g])
            for i, (a, _) in enumerate(g):
                near |= {(a, g[j][0]) for j in np.flatnonzero(similar.distance(fps, fps[i]) <= radius) if j > i}
        left = near - set(given)
        for g in later.values():
            left -= {(a, b) for a in g for b in g if a < b}
        assert set(given) <= near and not left and len(near) > 5 * n
