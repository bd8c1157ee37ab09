"""Host rules, decontamination and the pipeline against brute force."""

from __future__ import annotations

import random
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from quire.llm import decontam, host_rules


def oracle(rows, sql):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    return Counter(con.execute(sql).fetchall())


def test_host_rules_equal_their_sql(spark, prose):
    rnd = random.Random(9)
    rows = []
    for i in range(250):
        host = rnd.choice(["good.example", "good.example", "https://Bad.example/x", "few", None, ""])
        words = prose(rnd, "en", rnd.randint(0, 60)).split()
        if host and "Bad" in host and i % 4:
            words = words[:7] * rnd.randint(1, 5)
        if i % 9 == 0:
            words = [w + "#|" for w in words]
        text = None if i % 50 == 7 else "".join(w + rnd.choice([" ", " ", "\n", "\t", "\x0b"]) for w in words)
        rows.append((i, text, host))
    rows += [rows[3], (None, "null id " * 30, "few"), (500, "word " * 20_000, "few")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = Counter(tuple(r) for r in host_rules.judge(docs).select(*host_rules.COLUMNS).collect())
    assert got == oracle(rows, host_rules.ORACLE)
    failed = {r.host for r in host_rules.host_verdicts(host_rules.measure(docs)).filter("host_failed").collect()}
    assert failed == {"bad.example"}


def test_host_rules_edges(edge_docs, no_docs):
    rows = host_rules.judge(edge_docs).collect()
    assert len(rows) == edge_docs.count() and not any(r.kept for r in rows if r.n_words < 10)
    assert {r.host for r in rows if r.doc_id == 5} == {"host.example"} and {r.host for r in rows if r.doc_id in (2, 6)} == {None}
    assert host_rules.judge(no_docs).collect() == []


def found(docs, items, least=0.8):
    """Brute force: the best window of each item in each text."""
    words = lambda t: (t or "").encode().lower().split()
    out = {}
    for i, t in docs:
        w = words(t)
        for j, x in items:
            v = words(x)
            own = decontam.shingle_counts(v)
            size = min(len(v), len(w))
            for s in range(len(w) - size + 1 if size else 0):
                near = decontam.shingle_counts(w[s : s + size])
                q = (near & own).total() / ((near | own).total() or 1)
                if q >= least and q > out.get((i, j), (0, 0))[1]:
                    out[i, j] = (s, q)
    return out


@pytest.mark.parametrize("block_bytes", [8 << 20, 500])
def test_contaminated_windows(spark, prose, block_bytes):
    rnd = random.Random(10)
    items = [(j, prose(rnd, "en", rnd.randint(4, 60))) for j in range(25)] + [(90, None), (91, "two words"), (92, "")]
    docs = []
    for i in range(120):
        words = prose(rnd, "en", rnd.randint(0, 80)).split()
        if i % 3 == 0:
            x = rnd.choice(items[:25])[1].split()
            for _ in range(rnd.randint(0, 3)):
                x[rnd.randrange(len(x))] = rnd.choice(["edit", "other"])
            at = rnd.randint(0, len(words))
            words[at:at] = x
        docs.append((i, " ".join(words) if i % 2 else "\n".join(words).upper()))
    docs += [(200, None), (201, ""), (202, "Two Words"), (203, items[3][1] + " " + items[3][1])]
    got = decontam.contaminated(
        spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), block_bytes=block_bytes
    ).collect()
    want = found(docs, items)
    assert {(r.doc_id, r.item_id): (r.start_word, pytest.approx(r.similarity)) for r in got} == want and len(got) == len(want) > 20


def test_decontamination_edges(spark, edge_docs, no_docs):
    items = spark.createDataFrame([(1, "the cat sat on the mat and looked at the rain all day.")], "item_id bigint, text string")
    assert Counter(r.doc_id for r in decontam.contaminated(edge_docs, items).collect()) == {1: 2}
    kept = decontam.clean(edge_docs, items)
    assert kept.columns == edge_docs.columns and kept.count() == edge_docs.count() - 2
    assert decontam.contaminated(no_docs, items).collect() == [] and decontam.clean(edge_docs, items.limit(0)).count() == edge_docs.count()


def test_hamming_blocks_find_all_within_the_radius():
    rnd = random.Random(3)
    items = decontam.Items(list(range(40)), [" ".join(rnd.choice("abcdefghij") for _ in range(30)) for _ in range(40)])
    for fp in items.fps[:20]:
        for _ in range(20):
            near = fp
            for b in rnd.sample(range(64), rnd.randint(0, 30)):
                near ^= type(fp)(1 << b)
            want = [k for k, x in enumerate(items.fps) if (int(x) ^ int(near)).bit_count() <= 23]
            assert items.within(near, 23).tolist() == want


@pytest.fixture
def corpus(spark, prose, folder):
    """Documents with planted junk, boilerplate, copies and a benchmark passage, as tables in a folder."""
    rnd = random.Random(12)
    item = prose(rnd, "en", 40)
    rows = []
    for i in range(120):
        lang = "de" if i % 5 == 0 else "en"
        lines = [prose(rnd, lang, 25) for _ in range(4)]
        if i % 4 == 1:
            lines.append(f"read the terms of use of this page number {i} first")
        if i == 40:
            lines.insert(2, item)
        rows.append((i, "\n".join(lines), lang, "src"))
    rows.append((200, rows[7][1], "en", "src"))  # an exact copy
    rows.append((201, rows[8][1].replace(" ", "  ", 3), "en", "src"))  # a copy but for blanks
    rows += [(202, None, "en", None), (203, "1234 5678 !!!", "en", "src"), (204, "", None, None)]
    docs = [(*r, None if r[1] is None else len(r[1])) for r in rows]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, {r[0]: r[1] for r in rows}


def test_pipeline_stages(spark, corpus):
    import sentencepiece

    from quire.llm.common import cut, documents

    folder, texts = corpus
    docs = documents(spark, folder)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "line_dedup", "near_dedup", "decontamination", "encoding"]
    gone = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        new = cut(stage(spark, docs, folder))
        assert new.columns == docs.columns
        gone[name] = {r.doc_id for r in docs.select("doc_id").collect()} - {r.doc_id for r in new.select("doc_id").collect()}
        docs = new
    assert gone["language"] == {202, 203, 204} and gone["line_dedup"] == set()
    assert gone["near_dedup"] == {200, 201} and gone["decontamination"] == {40}
    # The boilerplate line recurs in 30 documents under one template: the first keeps it.
    want = {i: "\n".join(x for x in t.split("\n") if i == 1 or not x.startswith("read the terms")) for i, t in texts.items() if t and i < 200 and i != 40}
    assert {r.doc_id: r.text for r in docs.collect()} == want
    assert all(r.n_chars == len(r.text) for r in docs.collect())
    peer = sentencepiece.SentencePieceProcessor(model_file=corpus_pipeline.MODEL)
    out = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id: r.ids for r in out} == {i: peer.encode(t) for i, t in want.items()}


def test_stages_with_odd_rows(spark, edge_docs, no_docs, corpus):
    folder, _ = corpus
    for given in (edge_docs, no_docs):
        docs = given
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, folder)
            assert docs.columns == given.columns
        assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() <= given.count()
