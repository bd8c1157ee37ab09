"""The toxicity classifier: its counts and scores against brute force, held-out accuracy, odd rows."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import toxicity as T

LABELS = "doc_id bigint, quality int, toxic int, text string"


def brute_features(text):
    words = " ".join((text or "").lower().split())
    if not words:
        return set()
    words = f" {words} "
    out, mask = set(), (1 << 64) - 1
    for n in range(3, 7):
        for i in range(len(words) - n + 1):
            h = ord(words[i])
            for c in words[i + 1 : i + n]:
                h = (h * 0x9E3779B97F4A7C15 + ord(c)) & mask
            out.add((((h + n) * 0xD6E8FEB86659FD93) & mask) >> (64 - T.BITS))
    return out


def planted(prose, n=400, seed=1):
    rnd = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        words = prose(rnd, rnd.choice(["en", "de"]), rnd.randint(20, 120)).split()
        if toxic:
            for _ in range(rnd.randint(1, 4)):
                words.insert(rnd.randrange(len(words)), rnd.choice(["grobian", "Widerling", "schuft"]))
        docs.append((i, " ".join(words)))
        if i % 3:
            labels.append((i, 1, int(toxic), "clash"))
    return docs, labels


def test_features(prose):
    rnd = random.Random(4)
    features = T.Features()
    for text in (None, "", " \n", "a", "Ab c", "grüße 😀 😀\tund\n\nmehr", prose(rnd, "de", 300)):
        got = features(text).tolist()
        assert len(got) == len(set(got)) and set(got) == brute_features(text)


def test_long_texts_are_read_whole(prose, monkeypatch):
    text = prose(random.Random(5), "en", 400)
    whole = set(T.Features()(text).tolist())
    monkeypatch.setattr(T, "STRETCH", 50)
    assert set(T.Features()(text).tolist()) == whole


def test_counts_and_slope(spark, prose):
    docs, labels = planted(prose, 60)
    rows = T.labelled(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), T.known_labels(spark.createDataFrame(labels, LABELS), F.lit(True)))
    texts, counts = T.class_counts(rows)
    want, of = np.zeros((2, 1 << T.BITS), int), dict((i, t) for i, _, t, _ in labels)
    for i, text in docs:
        if i in of:
            want[of[i], list(brute_features(text))] += 1
    assert texts.tolist() == [sum(t == c for t in of.values()) for c in (0, 1)] and (counts == want).all()
    # The fit is a minimum: no small step along any slot or the intercept lowers the penalised loss.
    rnd = np.random.default_rng(0)
    sample = [np.unique(rnd.integers(0, 30, 8)) for _ in range(50)]
    toxic, weight, ratio = rnd.integers(0, 2, 50).astype(float), rnd.random(50) + 0.5, rnd.normal(size=30)
    w, b = T.regress(sample, toxic, weight, ratio)

    def loss(w, b):
        z = np.array([(w * ratio)[s].sum() + b for s in sample])
        return (weight * (np.logaddexp(0, z) - toxic * z)).sum() + T.PENALTY / 2 * w @ w

    for k in range(30):
        for step in (0.05, -0.05):
            assert loss(w + step * (np.arange(30) == k), b) > loss(w, b) - 1e-4
    assert min(loss(w, b + 0.05), loss(w, b - 0.05)) > loss(w, b) - 1e-4


@pytest.mark.parametrize(("sample", "entries"), [(2000, 8_000_000), (60, 20_000)])
def test_held_out_accuracy(spark, prose, sample, entries):
    docs, labels = planted(prose)
    docs += [(1000 + i, "ein Schuft") for i in range(3)] + [(2000, None), (2001, "")]
    df = spark.createDataFrame([(*d, "en", 1) for d in docs], "doc_id bigint, text string, lang string, toxic int")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = T.fit(df, spark.createDataFrame(labels, LABELS), ~held_out, sample, entries)
    got = {r.doc_id: r.score for r in T.score(df, model).collect()}
    assert len(got) == len(docs) and all(0 <= s <= 1 for s in got.values())
    truth = {i: i % 4 == 0 for i in range(400)}
    right = [(got[i] >= 0.3) == t for i, t in truth.items() if i % 3 == 0]  # never labelled
    assert np.mean(right) > (0.97 if sample == 2000 else 0.9)  # the smaller sample has 60 rows a class
    assert got[2000] == got[2001] < 0.3 and got[1000] == got[1001] == got[1002] > (0.3 if sample == 2000 else got[2000])
    z = {i: model.intercept + sum(float(model.weight[s]) for s in brute_features(t)) for i, t in docs[:20]}
    assert all(got[i] == pytest.approx(1 / (1 + np.exp(-v)), abs=1e-6) for i, v in z.items())


def test_labels_that_are_held_out_change_nothing(spark, prose):
    docs, labels = planted(prose, 80)
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    turned = [(i, q, t if i % 2 else 1 - t, x) for i, q, t, x in labels]
    a, b = (T.fit(df, spark.createDataFrame(rows, LABELS), F.col("doc_id") % 2 == 1) for rows in (labels, turned))
    assert (a.weight is None) == (b.weight is None) and a.intercept == b.intercept


def test_odd_rows(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 1, "x"), (1, 1, 0, "x"), (4, 0, 0, "x"), (None, 1, 1, "x"), (7, 1, None, "x"), (99, 1, 1, "x"), (9, None, 0, None)], LABELS)
    known = {r.label_id: r.toxic for r in T.known_labels(labels, F.lit(True)).collect()}
    assert known == {1: 1, 4: 0, 99: 1, 9: 0}
    out = T.toxicity(edge_docs, labels, F.col("doc_id") < 0)
    rows = out.collect()
    assert len(rows) == edge_docs.count() and len({r.score for r in rows if r.doc_id == 1}) == 1
    assert len({r.score for r in T.toxicity(edge_docs, labels.limit(0), F.lit(False)).collect()}) == 1
    assert len({r.score for r in T.toxicity(edge_docs, labels.filter("toxic = 0"), F.lit(False)).collect()}) == 1
    assert T.toxicity(no_docs, labels, F.lit(False)).collect() == []
