"""Language ID, personal data and the hidden Markov model: exactness against brute force, and held-out quality."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import hmm, langid, pii
from quire.llm.common import fold


@pytest.fixture(scope="module")
def two_languages(spark, prose):
    rnd = random.Random(3)
    rows = [(i, prose(rnd, lang, rnd.randint(5, 120)), lang) for i in range(300) for lang in [rnd.choice(["en", "de"])]]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string").cache()


def kneser_ney(texts: list[str]):
    """p(char | three before) of one language by the definition."""
    rows = Counter()
    for t in texts:
        s = "\x02" * 3 + langid.spelled(t) + "\x03"
        rows.update(s[i - 3 : i + 1] for i in range(3, len(s)))
    levels = [rows]
    for _ in range(3):
        levels.insert(0, Counter(g[1:] for g in levels[0]))
    discounts = []
    for level in levels:
        n1, n2 = (sum(c == k for c in level.values()) for k in (1, 2))
        discounts.append(min(max(n1 / (n1 + 2 * n2) if n1 + n2 else 0.5, 0.05), 0.95))

    def p(gram: str) -> float:
        level, d = levels[len(gram) - 1], discounts[len(gram) - 1]
        below = p(gram[1:]) if len(gram) > 1 else 1 / 4096
        same = [c for g, c in level.items() if g[:-1] == gram[:-1]]
        if not same:
            return below
        return max(level[gram] - d, 0) / sum(same) + d * len(same) / sum(same) * below

    return p


def test_kneser_ney_probabilities(two_languages):
    some = two_languages.filter("doc_id < 12")
    model = langid.fit(some)
    rows = some.collect()
    of = {lang: kneser_ney([r.text for r in rows if r.lang == lang]) for lang in model.langs}
    texts = ["the sch ing", "zz unseen ü", rows[0].text[:60]]
    got, chars = model.score(texts)
    for k, t in enumerate(texts):
        s = "\x02" * 3 + langid.spelled(t) + "\x03"
        assert chars[k] == len(t) + 1
        for j, lang in enumerate(model.langs):
            want = -sum(math.log(of[lang](s[i - 3 : i + 1])) for i in range(3, len(s))) / (len(t) + 1)
            assert got[k, j] == pytest.approx(want, rel=1e-4)


def test_languages_of_held_out_texts(two_languages):
    use = F.when(fold(F.col("doc_id"), 5) == 0, 0).when(fold(F.col("doc_id"), 5) == 4, 2).otherwise(1)
    odd = two_languages.sparkSession.createDataFrame([(900, "ЖЖЖЖ ЩЩЩЩ " * 30, None)], two_languages.schema)
    found = {r.doc_id: r for r in langid.identify(two_languages.unionByName(odd), use).collect()}
    held = [r for r in two_languages.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum(found[r.doc_id].lang_pred == r.lang for r in held) >= 0.98 * len(held) > 30
    assert all(0 < r.score <= 1 for r in found.values())
    assert found[900].rejected and sum(r.rejected for r in found.values()) <= 3


def test_slots_bound_the_model(two_languages):
    small = langid.fit(two_languages, bits=4)
    assert all(len(k) <= 16 for k in small.keys) and all((np.diff(k.astype(np.int64)) > 0).all() for k in small.keys)


def test_scores_do_not_depend_on_the_size_of_the_arrays(two_languages, edge_docs):
    docs = two_languages.unionByName(edge_docs.select(*two_languages.columns))
    use = F.when(fold(F.col("doc_id"), 5) == 0, 0).when(fold(F.col("doc_id"), 5) == 4, 2).otherwise(1)
    assert langid.fit(docs).whole and not langid.fit(docs, bits=6).whole
    key = lambda r: (str(r.doc_id), r.text_key)
    want = sorted(langid.identify(docs, use).collect(), key=key)
    for bits in (0, 6):
        got = sorted(langid.identify(docs, use, bits=bits).collect(), key=key)
        assert [(*key(r), r.lang_pred, r.rejected) for r in got] == [(*key(r), r.lang_pred, r.rejected) for r in want]
        assert [r.entropy for r in got] == pytest.approx([r.entropy for r in want], rel=1e-5)
        assert [r.score for r in got] == pytest.approx([r.score for r in want], rel=1e-4)


def test_language_edges(edge_docs, no_docs):
    rows = langid.identify(edge_docs, F.lit(1)).collect()
    assert len(rows) == edge_docs.count()
    assert {r.lang_pred for r in rows if r.doc_id in (2, 3, 5, 6)} == {"und"} and all(r.score == 0 and r.rejected for r in rows if r.lang_pred == "und")
    assert langid.identify(no_docs, F.lit(1)).collect() == []
    assert all(r.lang_pred == "und" for r in langid.identify(edge_docs, F.lit(0)).collect())
    kept = langid.keep_identified(edge_docs)
    assert kept.columns == edge_docs.columns and {r.doc_id for r in kept.collect()} >= {1, 4}


def test_base_spans_are_the_patterns_matches():
    email, ip = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    digits = lambda s: re.sub("[^0-9]", "", s)

    def plain(t):
        return {
            "email": [m.span() for m in email.finditer(t)],
            "ip": [m.span() for m in ip.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))],
            "card": [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))],
            "phone": [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m[0])) <= 15],
        }

    rnd = random.Random(2)
    bits = ["a", "@", "b.c", ".", "1", "23", "255", "256", "0001", "4111111111111111", "-", " ", "+", "+12", "(", "9", "é", "@x.y", "..", "\n"]
    for _ in range(8000):
        t = "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 16)))
        assert pii.base_spans(t)[0] == plain(t), repr(t)


def test_crf_marginals_and_gradients():
    net = pii.Network.new()
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    rng = np.random.default_rng(0)
    net.w["move"] = rng.normal(0, 1, net.w["move"].shape)
    emit = rng.normal(0, 1, (3, 1, pii.TAGS)).astype(np.float32)
    paths = np.array(list(itertools.product(range(pii.TAGS), repeat=3)))
    scores = np.exp(sum(emit[i, 0, paths[:, i]] for i in range(3)) + net.w["move"][paths[:, 0], paths[:, 1]] + net.w["move"][paths[:, 1], paths[:, 2]] + net.w["start"][paths[:, 0]])
    probs, moves, logz = net.marginals(emit)
    assert logz == pytest.approx(math.log(scores.sum()), abs=1e-4)
    want = np.array([[scores[paths[:, i] == k].sum() for k in range(pii.TAGS)] for i in range(3)]) / scores.sum()
    assert np.allclose(probs[:, 0], want, atol=1e-4) and moves.sum() == pytest.approx(2, abs=1e-4)
    ids, tags = rng.integers(1, 98, (4, 7)), rng.integers(0, pii.TAGS, (4, 7))
    grads, _ = net.step(ids, tags)
    for name in ("embed", "xf", "hf", "cb", "out", "move", "start"):
        at = np.unravel_index(np.abs(grads[name]).argmax(), grads[name].shape)
        net.w[name][at] += 0.01
        up = net.step(ids, tags)[1]
        net.w[name][at] -= 0.02
        down = net.step(ids, tags)[1]
        net.w[name][at] += 0.01
        assert grads[name][at] == pytest.approx((up - down) / 0.02, rel=0.05, abs=2e-3), name


def test_personal_data(spark, prose, edge_docs, no_docs):
    rnd = random.Random(6)
    d = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))
    make = [lambda: f"{rnd.choice('abc')}ob{d(2)}@mail.example.org", lambda: f"10.{rnd.randint(0, 255)}.{rnd.randint(0, 255)}.7", lambda: f"+1 555 {d(3)} {d(4)}"]
    rows = [(i, " ".join([prose(rnd, "en", 30), rnd.choice(make)() if i % 2 else f"in {d(2)} of {d(4)}", prose(rnd, "en", 30)])) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    net = pii.train(docs, most=300)
    held = [" ".join([prose(rnd, "en", 20), rnd.choice(make)(), prose(rnd, "en", 20)]) for _ in range(60)]
    none = ({k: [] for k in pii.KINDS}, [])
    found = pii.added(net, held, [none] * len(held))
    want = [[(k, *s) for k, spans in pii.base_spans(t)[0].items() for s in spans] for t in held]
    assert sum(a == b for a, b in zip(found, want, strict=True)) >= 54  # the network alone, on texts it has not seen
    clean = [prose(rnd, "en", 60) + " 12 of 1999." for _ in range(60)]
    assert not any(pii.added(net, clean, [pii.base_spans(t) for t in clean]))
    for r in pii.find(docs, net).collect():
        base = pii.base_spans(dict(rows)[r.doc_id])[0]
        listed = ",".join(f"{k}:{a}:{b}" for k in pii.KINDS for a, b in base[k])
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest() and set(filter(None, listed.split(","))) <= set(r.spans.split(","))
    out = pii.find(edge_docs, net).collect()
    assert len(out) == edge_docs.count() and all(r.n_email + r.n_ip + r.n_phone == 0 for r in out)
    assert pii.train(edge_docs.filter("doc_id = 1")) is None and pii.detect(no_docs).collect() == []


def test_forward_is_exact():
    model = hmm.first_model(np.arange(hmm.SYMBOLS), np.ones(hmm.SYMBOLS, np.int64), 3, 3)
    sequences = [np.array([5, 9, 5, hmm.SYMBOLS]), np.array([hmm.SYMBOLS]), np.array([7, hmm.SYMBOLS])]
    for s, got in zip(sequences, hmm.forward(model, sequences), strict=True):
        total = 0.0
        for path in itertools.product(range(3), repeat=len(s)):
            p = model.start[0][path[0]] * model.emit[s[0], path[0]]
            for a, b, x in zip(path, path[1:], s[1:], strict=False):
                p *= model.move[a, b] * model.emit[x, b]
            total += p
        assert got == pytest.approx(math.log(total))


def test_expected_counts_raise_the_likelihood():
    rng = np.random.default_rng(1)
    texts = [np.append(rng.integers(0, 4, rng.integers(1, 30)) + 100 * (k % 2), hmm.SYMBOLS) for k in range(40)]
    tokens = np.bincount(np.concatenate(texts), minlength=hmm.SYMBOLS + 1)[:-1]
    model, last = hmm.first_model(tokens, (tokens > 0).astype(np.int64), len(texts), 2), -np.inf
    for _ in range(6):
        now = hmm.forward(model, texts).sum()
        assert now >= last - 1e-9
        last = now
        starts, moves, emits = hmm.expected(model, texts, np.zeros(len(texts), bool))
        assert starts.sum() == pytest.approx(len(texts)) and emits.sum() == pytest.approx(sum(map(len, texts)))
        model = hmm.Model((starts + 1e-12) / (starts + 1e-12).sum(1, keepdims=True), moves / moves.sum(1, keepdims=True), emits / emits.sum(0), *(model.class_tokens, model.class_kinds, model.n_texts))


def test_scores_of_whole_texts(two_languages, edge_docs, no_docs, monkeypatch):
    monkeypatch.setattr(hmm, "BLOCK_WORDS", 200)
    rows = two_languages.collect()
    scored = {r.doc_id: r for r in hmm.score_documents(two_languages.repartition(3), fold(F.col("doc_id"), 7) != 2, states=4, iterations=4).collect()}
    tokens = {r.doc_id: [*r.text.encode().lower().split(), None] for r in rows}
    c = Counter(w for i, own in tokens.items() for w in own if zlib.crc32(str(i).encode()) % 7 != 2)
    model = base = 0.0
    for i, own in tokens.items():
        r = scored[i]
        assert r.n_tokens == len(own) and r.n_known == sum(c[w] > 0 for w in own) and r.train_tokens == c.total()
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (c.total() + len(c) + 1)) for w in own))
        if not r.train:
            model, base = model + r.score, base + r.base_score
    assert model > base  # on texts that were not learned from
    out = hmm.score_documents(edge_docs, F.lit(True), states=2, iterations=1).collect()
    assert len(out) == edge_docs.count() and all(np.isfinite(r.score) and r.score < 0 for r in out)
    assert sorted(r.n_tokens for r in out)[:4] == [1, 1, 1, 1]
    assert hmm.score_documents(no_docs, F.lit(True)).collect() == []
    assert all(np.isfinite(r.score) and r.n_known == 0 for r in hmm.score_documents(edge_docs, F.lit(False)).collect())


def test_repeated_windows_count_once_in_the_sample(spark):
    rows = [(k, f"write to user{k}@host{k}.org") for k in range(300)] + [(1000 + k, "call +1 202 555 0199 now") for k in range(5000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    for most, want in ((1000, 301), (100, 100)):
        own = [(r["w"], r["tags"]) for r in pii.sample(docs, most)[0].to_pylist()]
        assert len(own) == len(set(own)) == want
