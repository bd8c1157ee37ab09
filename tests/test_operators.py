"""Skew-safe operators against brute force, with a key that holds a third of the rows."""

import random

import pytest
from pyspark.sql import functions as F

from quire.operators import collisions, dedup, keyed, ordered, segment, reconcile
from quire.operators import table_rules
from quire.operators import validate as V
from quire.schemas import TABLES, table_schema
from quire.functions.text import lines, normalise
from quire.functions import fields as X
from quire.functions import rules


def skewed(seed, n=900):
    rng = random.Random(seed)
    return [(i, "hot" if rng.random() < 0.34 else f"k{rng.randrange(60)}", rng.randrange(9)) for i in range(n)]


def test_attach_and_lookup(spark):
    rows = skewed(1)
    df = spark.createDataFrame(rows, "id long, k string, v int").repartition(7)
    got = keyed.attach(df, ["k"], ["id"], [F.count(F.lit(1)).alias("n"), F.min("id").alias("first")], fan=8).collect()
    for r in got:
        same = [x[0] for x in rows if x[1] == r["k"]]
        assert (r["n"], r["first"]) == (len(same), min(same))
    assert len(got) == len(rows)
    table = spark.createDataFrame([("hot", 1), ("k3", 2), ("absent", 3)], "k string, t int")
    for how, keep in (("left", lambda k: True), ("inner", lambda k: k in ("hot", "k3")), ("left_semi", lambda k: k in ("hot", "k3"))):
        joined = keyed.lookup(df, table, ["k"], ["id"], how, fan=8)
        assert sorted(r["id"] for r in joined.collect()) == [x[0] for x in rows if keep(x[1])]
    assert {r["k"]: r["t"] for r in keyed.lookup(df, table, ["k"], ["id"]).collect()}["k3"] == 2


def test_hot_keys_are_spread(spark):
    df = spark.range(3000).select("id", F.lit("hot").alias("k"))
    laid = keyed.spread(df, ["k"], ["id"], 64)
    sizes = laid.groupBy("_salt").count().collect()
    assert len(sizes) == 64 and max(r["count"] for r in sizes) < 150


@pytest.mark.parametrize("block", [1, 7, 100, 10_000])
def test_in_order_across_block_edges(spark, block):
    rows = skewed(2, 400)
    df = spark.createDataFrame(rows, "id long, k string, v int").repartition(5)
    got = ordered.in_order(df, ["k"], "id", previous={"p": "v"}, following={"f": "id"}, running={"s": "v"}, position="n", block=block)
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    want = {}
    for group in by.values():
        for i, r in enumerate(group):
            want[r[0]] = (group[i - 1][2] if i else None, group[i + 1][0] if i + 1 < len(group) else None,
                          sum(x[2] for x in group[: i + 1]), i + 1)
    assert {r["id"]: (r["p"], r["f"], r["s"], r["n"]) for r in got.collect()} == want


@pytest.mark.parametrize("seed", [1, 2])
def test_crowded_numbers_make_even_blocks(spark, seed, monkeypatch):
    """Nine tenths of the ids in a hundredth of their range, beyond what the sketch's quantiles name one by one."""
    rng = random.Random(seed)
    ids = set(rng.sample(range(10**9, 10**9 + 10**7), 18_000)) | set(rng.sample(range(-(10**9), 0), 2_000)) | {-(2**62), 2**62}
    df = spark.createDataFrame([(i,) for i in ids], "id long").repartition(5)
    for block, quantiles in ((100, 256), (1_000, 256), (1_000, 8)):
        monkeypatch.setattr(ordered, "SKETCH", quantiles)
        sizes = [r["count"] for r in ordered.with_block(df, "id", block).groupBy("_block").count().collect()]
        assert sum(sizes) == len(ids) and len(sizes) <= 3 * len(ids) / block + 3
        assert max(sizes) < 2 * block or quantiles == 8
    got = ordered.in_order(df, [], "id", previous={"p": "id"}, position="n", block=100)
    order = sorted(ids)
    assert {r.id: (r.p, r.n) for r in got.collect()} == {x: (order[i - 1] if i else None, i + 1) for i, x in enumerate(order)}


def test_numbers_that_repeat_in_each_key_stay_in_one_block(spark):
    df = spark.range(50_000).selectExpr("id div 100 AS k", "id % 100 AS page")
    assert ordered.with_block(df, "page", 100).select("_block").distinct().count() == 1


def test_previous_keeps_null_values(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", 5), (3, "a", None), (4, "a", 6)], "id long, k string, v int")
    got = ordered.in_order(df, ["k"], "id", previous={"p": "v"}, block=2).orderBy("id").collect()
    assert [r["p"] for r in got] == [None, None, 5, None]


def test_batches_along_a_total_order(spark):
    df = spark.range(0, 500, 3)
    got = {r["id"]: r["batch"] for r in ordered.number_batches(df, "id", 6, block=10).collect()}
    assert got == {x: i // 6 + 1 for i, x in enumerate(range(0, 500, 3))}


def fold(records, keys, owned=()):
    """The sequential statement: accept unless a key is held; only accepted records hold keys."""
    held = {(k, v): o for k, v, o in owned}
    out = {}
    for r in records:
        hit = next(((held[(k, r[k])], k) for k in keys if r.get(k) and (k, r[k]) in held), None)
        out[r["id"]] = ("duplicate", *hit) if hit else ("accepted", None, None)
        if not hit:
            for k in keys:
                if r.get(k):
                    held.setdefault((k, r[k]), str(r["id"]))
    return out


def run_greedy(spark, records, keys, owned=None, order="id", **more):
    schema = "id long, ord long, " + ", ".join(f"{k} string" for k in keys)
    df = spark.createDataFrame([(r["id"], r["id"], *[r.get(k) for k in keys]) for r in records], schema).repartition(3)
    held = spark.createDataFrame(owned, "kind string, value string, owner string") if owned else None
    if order == "name":  # an order that is no number
        df = df.withColumn("ord", F.format_string("n%06d", "ord"))
    got = dedup.greedy(df, "id", "ord", keys, held, fan=4, **more).collect()
    return {r["id"]: (r["status"], r["canonical_id"], r["method"]) for r in got}


def test_greedy_is_not_connected_components(spark):
    records = [{"id": 1, "a": "k1"}, {"id": 2, "a": "k1", "b": "k2"}, {"id": 3, "b": "k2"}]
    assert run_greedy(spark, records, ["a", "b"]) == {
        1: ("accepted", None, None), 2: ("duplicate", "1", "a"), 3: ("accepted", None, None)}


@pytest.mark.parametrize("seed", [3, 4, 5])
def test_greedy_equals_the_fold(spark, seed):
    rng = random.Random(seed)
    keys = ["url", "file", "text"]
    records = [
        {"id": i, **{k: ("hot" if rng.random() < 0.1 else f"{rng.randrange(120)}") for k in keys if rng.random() < 0.8}}
        for i in range(250)
    ]
    owned = [("url", "3", "archive"), ("text", "5", "archive")] if seed == 5 else None
    for more in ({}, {"one_task": 0}, {"room": 40}, {"order": "name"}):  # pointers instead of one task, rounds instead of a fold
        assert run_greedy(spark, records, keys, owned, **more) == fold(records, keys, owned or ())


def test_long_chain_and_no_conflict(spark):
    chain = [{"id": i, "a": f"a{i // 2}", "b": f"b{(i + 1) // 2}"} for i in range(9)]
    assert run_greedy(spark, chain, ["a", "b"]) == fold(chain, ["a", "b"])
    free = [{"id": i, "a": f"a{i}"} for i in range(5)]
    assert {s for s, _, _ in run_greedy(spark, free, ["a"]).values()} == {"accepted"}


@pytest.mark.parametrize("one_task", [0, 1_000_000])
def test_a_long_chain_takes_few_writes(spark, one_task, monkeypatch):
    """Each record shares a key with the next: one component, one fold, however long the chain."""
    from quire.operators import components
    from quire.session import cut

    writes = []
    for module in (dedup, components):
        monkeypatch.setattr(module, "cut", lambda df: writes.append(1) or cut(df))
    chain = [{"id": i, "a": f"a{i // 2}", "b": f"b{(i + 1) // 2}"} for i in range(10_000)]
    assert run_greedy(spark, chain, ["a", "b"], one_task=one_task) == fold(chain, ["a", "b"])
    assert len(writes) <= 20


@pytest.mark.parametrize("one_task", [0, 50, 1_000_000])
def test_components(spark, one_task):
    from quire.operators.components import components

    rng = random.Random(one_task)
    order = rng.sample(range(3000), 3000)
    edges = [(order[i], order[i + 1]) for i in range(400)] + [(order[500], x) for x in order[501:900]]
    edges += [tuple(rng.sample(order[900:2000], 2)) for _ in range(500)] + [(7, 7), edges[0], edges[0][::-1]]
    up = {x: x for x in order}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long").repartition(3), one_task).collect()}
    assert got == {x: root(x) for x in order if root(x) != x}
    assert components(spark.createDataFrame([(1, 1)], "a long, b long"), one_task).collect() == []


def test_soft_hits(spark):
    df = spark.createDataFrame([(1, 1, "d1", "c1"), (2, 2, "d1", "c1"), (3, 3, None, "c1"), (4, 4, "d9", "")],
                               "id long, ord long, deed string, lawsuit string")
    got = {r["id"]: (r["possible_canonical"], r["matches"]) for r in dedup.soft_hits(df, "id", "ord", ["deed", "lawsuit"]).collect()}
    assert got == {2: (1, ["deed", "lawsuit"]), 3: (1, ["lawsuit"])}


def test_collision_symmetry(spark):
    df = spark.createDataFrame([(1, 1, "d1"), (2, 2, "d1"), (3, 3, "d2"), (4, 4, "d1")], "id long, ord long, deed string")
    both = {r["id"]: (r["members"], r["first_member"]) for r in collisions.symmetric(df, "id", ["deed"]).collect()}
    assert both == {1: (3, 1), 2: (3, 1), 4: (3, 1)}
    existing = spark.createDataFrame([("deed", "d2"), ("deed", "d2")], "kind string, value string")
    later = {r["id"]: (r["earlier"], r["latest_earlier"], r["existing"])
             for r in collisions.asymmetric(df, "id", "ord", ["deed"], existing, block=2).collect()}
    assert later == {2: (1, 1, 0), 4: (2, 2, 0), 3: (0, None, 2)}


def test_exact_and_reference_candidates(spark):
    df = spark.createDataFrame([(1, 1, "e1", "r1"), (2, 2, "e1", "r1"), (3, 3, "e3", "r1"), (4, 4, "e4", "r4")],
                               "id long, ord long, e string, r string")
    got = {r["id"]: (r["match_type"], r["canonical_id"], r["status"]) for r in dedup.first_seen(df, "id", "ord", "e", "r").collect()}
    assert got == {1: (None, None, "review"), 2: ("exact_hash", 1, "duplicate"), 3: ("reference", 1, "review"), 4: (None, None, "review")}


def volume():
    filler = " نص الحكم" * 20
    page = lambda deed, head="": f"{head}رقم الصك {deed} بتاريخ 1434/2/5{filler}"
    subject = "بيع عقار - فسخ العقد لظهور عيب\n"
    pages = [
        ("v1", 1, "صفحة العنوان" + filler), ("v1", 2, page("11111", subject)), ("v1", 3, "تتمة" + filler),
        ("v1", 4, page("11111", subject)), ("v1", 5, "رقم الصك 99999 قصير"), ("v1", 6, page("22222")),
        ("v1", 7, "رقم الصك 33333 دون تاريخ" + filler), ("v1", 8, page("44444", subject)), ("v1", 9, "خاتمة" + filler),
        ("v1", 10, page("22222", subject)), ("v1", 11, "ملحق"), ("v1", 12, ""),
        ("v2", 1, "الفهارس"), ("v2", 2, "فهرس"), ("v2", 3, "الكلمات" + filler), ("v2", 4, page("55555", subject)),
    ]
    return pages


@pytest.mark.parametrize("block", [3, 1000])
def test_volume_segmentation(spark, block):
    pages = spark.createDataFrame(volume(), "source string, page int, text string")
    bad = segment.index_volumes(pages, "source", "page", "text")
    assert [r[0] for r in bad.collect()] == ["v2"]
    kept = pages.join(bad, "source", "left_anti").select(
        "source", "page", "text", normalise(F.col("text")).alias("t"), lines(F.col("text")).alias("l"))
    meta = X.page_metadata(F.col("t"), F.col("l"))
    read = kept.select("*", *[c.alias(n) for n, c in meta.items()])
    identity = ["deed_number", "judgment_number", "lawsuit_number"]
    proof = segment.page_evidence(F.col("t"), [F.col(c) for c in identity], F.col("decision_date"), F.col("subject"))
    starts = segment.boundaries(read.filter(proof), "source", "page", identity, block=block)
    last = pages.groupBy("source").agg(F.max("page").alias("last"))
    spans = segment.spans(starts, "source", "page", last, "last", block=block)
    got = [(r["page"], r["end_page"], r["deed_number"], r["subject"] is not None) for r in spans.orderBy("page").collect()]
    assert got == [(2, 5, "11111", True), (6, 7, "22222", False), (8, 9, "44444", True), (10, 12, "22222", True)]


@pytest.mark.parametrize("piece", [2, 500])
def test_span_text(spark, piece):
    rows = [("s", i, f"p{i}", i in (2, 5)) for i in range(1, 9)]
    pages = spark.createDataFrame(rows, "source string, page int, text string, starts boolean")
    got = segment.span_text(pages, "source", "page", "text", "starts", piece_pages=piece, block=4)
    joined = {}
    for r in got.orderBy("span_no", "piece").collect():
        joined.setdefault(r["span_no"], []).append(r["span_text"])
    assert {k: "\f".join(v) for k, v in joined.items()} == {1: "p2\fp3\fp4", 2: "p5\fp6\fp7\fp8"}


def test_split_document(spark):
    def split(text, patterns=("رقم الصك ([0-9]{3,20})", "رقم القضية ([0-9]{3,20})")):
        df = spark.createDataFrame([(text,)], "t string")
        return df.select(segment.split_document(F.col("t"), list(patterns), 20)).first()[0]

    body = "نص " * 10
    a, b = f"مقدمة رقم الصك 111 {body}", f"رقم الصك 222 {body}رقم الصك 111 {body}"
    assert split(a + b) == [a.strip(), b.strip()]
    assert split(a) == [a]
    assert split("رقم الصك 111 رقم الصك 222 " + body) == [("رقم الصك 222 " + body).strip()]
    assert split("رقم الصك 111 رقم الصك 222") == ["رقم الصك 111 رقم الصك 222"]
    assert split("") == []


def test_waterfall_and_pairs(spark):
    rows = spark.createDataFrame([(1, "j1", "c1"), (2, "zz", "c2"), (3, "zz", "c9"), (4, "", ""), (5, "j2", "c1")], "id long, j string, c string")
    by_j = spark.createDataFrame([("j1", "A"), ("j2", "B"), ("j2", "C"), ("", "X")], "j string, rec string")
    by_c = spark.createDataFrame([("c2", "D"), ("c1", "E")], "c string, rec string")
    got = reconcile.waterfall(rows, "id", [("judgment_number", "j", by_j), ("case_number", "c", by_c)], ["rec"])
    assert {r["id"]: (r["match_count"], r["match_method"], r["rec"]) for r in got.collect()} == {
        1: (1, "judgment_number", "A"), 2: (1, "case_number", "D"), 3: (0, "", None), 4: (0, "", None), 5: (2, "judgment_number", None)}


def test_waterfall_in_one_exchange_of_its_keys(spark):
    rng = random.Random(5)
    values = [None, "", "hot", *map(str, range(12))]
    rows = [(i, "hot" if i % 3 == 0 else rng.choice(values), rng.choice(values), rng.choice(values), [i]) for i in range(300)]
    held = [[(rng.choice(values), f"r{step}{i}") for i in range(9)] for step in range(3)]
    steps = [(f"m{n}", k, spark.createDataFrame(held[n], f"{k} string, rec string")) for n, k in enumerate("abc")]
    df = spark.createDataFrame(rows, "id long, a string, b string, c string, extra array<long>")
    got = reconcile.waterfall(df, "id", steps, ["rec"], fan=4)
    assert got.columns == ["id", "a", "b", "c", "extra", "match_count", "match_method", "rec"]

    def plain(keys):
        for n, key in enumerate(keys):
            hits = [rec for k, rec in held[n] if key and k == key]
            if hits:
                return len(hits), f"m{n}", hits[0] if len(hits) == 1 else None
        return 0, "", None

    assert {r["id"]: tuple(r)[1:] for r in got.collect()} == {r[0]: (*r[1:], *plain(r[1:4])) for r in rows}
    final = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count(" Exchange hashpartitioning") <= 5, final
    for wrong in (df.filter("id = 1"), df.filter("id = 1").withColumn("id", F.lit(None).cast("long"))):
        with pytest.raises(Exception, match="an id is NULL or occurs twice"):
            reconcile.waterfall(df.union(wrong), "id", steps, ["rec"]).collect()
    assert reconcile.waterfall(df.limit(0), "id", steps, ["rec"]).collect() == []


def test_child_pages(spark):
    rows = [("p", i) for i in range(25)] + [("q", 100)]
    df = spark.createDataFrame(rows, "parent string, child long")
    got = {(r["parent"], r["page_no"]): r["child_ids"] for r in reconcile.child_pages(df, "parent", "child", 10, block=4).collect()}
    assert got == {("p", 1): list(range(10)), ("p", 2): list(range(10, 20)), ("p", 3): list(range(20, 25)), ("q", 1): [100]}


def test_table_constraints(spark):
    for name in TABLES:
        table_rules.rules_of(name)
    columns = "id string, document_id string, matched_document_id string, matched_external_id string, match_type string, similarity_score decimal(6,5), decision string"
    from decimal import Decimal

    df = spark.createDataFrame([
        ("1", "d", "e", None, "exact_hash", Decimal("1"), "duplicate"), ("2", "d", "d", None, "exact_hash", None, "review"),
        ("3", "d", None, None, "guess", Decimal("1.5"), "review"), ("1", "d", "f", None, "exact_hash", None, "review")], columns)
    found = sorted((r["rule"], r["id"]) for r in table_rules.check_table(df, "duplicate_candidates").collect())
    assert found == [("duplicate_id", "1"), ("match_type_domain", "3"), ("score_range", "3"), ("self_match", "2"), ("target_missing", "3")]
    assert table_schema("duplicate_candidates")["similarity_score"].dataType.simpleString() == "decimal(6,5)"
    assert V.report(table_rules.check_table(df, "duplicate_candidates")).first()["valid"] is False


def test_page_range_rule(spark):
    df = spark.createDataFrame([(1, 1, 5), (2, None, None), (3, None, 4), (4, 5, 4), (5, 0, 1), (6, 2, 9)], "id int, s int, e int")
    bad = V.row_rules(df, "id", [V.page_range(F.col("s"), F.col("e"), F.lit(8))])
    assert sorted(r["id"] for r in bad.collect()) == ["3", "4", "5", "6"]


@pytest.mark.parametrize("gap", [1, 1 << 22])
def test_blocks_follow_the_density_of_the_ids(spark, gap):
    df = spark.range(1000).select((F.col("id") * gap).alias("id"), (F.col("id") % 3).alias("k"), F.col("id").alias("v"))
    got = ordered.in_order(df, ["k"], "id", previous={"p": "v"}, position="n", block=100, keep_block=True)
    assert got.select("_block").distinct().count() == 10
    rows = got.collect()
    assert all(r["n"] == r["v"] // 3 + 1 and r["p"] == (r["v"] - 3 if r["v"] > 2 else None) for r in rows) and len(rows) == 1000


def test_triage_in_few_exchanges(spark):
    hosts = ["a.org"]
    rows = [(i, f"https://a.org/{i}", "hot" if i % 3 else f"h{i % 7}") for i in range(60)]
    rows += [(60, "https://b.net/1", "fresh"), (61, "https://a.org/61", "fresh"), (62, "https://a.org/62", "held"), (63, "https://a.org/63", None),
             (64, "https://a.org/64", None), (65, "https://a.org/5", "late"), (66, "https://a.org/66", "late"), (67, None, "x")]
    df = spark.createDataFrame(rows, "id long, url string, h string")
    known = spark.createDataFrame([("https://a.org/5",), ("https://a.org/5",), (None,)], "url string")
    held = spark.createDataFrame([("held",), ("held",), ("h3",), (None,)], "h string")
    out = reconcile.triage(df, known, held, "id", hosts, fan=4)
    mine = {r["id"]: r["status"] for r in out.collect()}
    seen, wanted = {"held", "h3"}, {}
    for i, url, h in rows:
        host = None if url is None else url.split("/")[2]
        if url is not None and host != "a.org":
            wanted[i] = "rejected"
        elif url == "https://a.org/5":
            wanted[i] = "known_url"
        else:
            wanted[i] = "duplicate" if h in seen else "saved"
            seen |= {h} - {None}
    assert mine == wanted and len(mine) == len(rows)
    plan = out._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert final.count(" Exchange hashpartitioning") <= 6, final


def test_register_is_scanned_once(spark):
    from quire.plans import PLANS
    from quire.plans.registry import Tables

    plan = PLANS["s1_strict_scan"].build(Tables(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2 and "Exchange" not in plan


def test_clamp_and_labels(spark):
    rows = spark.createDataFrame([(1, 4, 3, True), (1, 5, 3, True), (2, 4, 3, False), (0, 2, 3, False), (3, 3, 3, True)], "s int, e int, p int, last boolean")
    got = [tuple(r[0]) for r in rows.select(X.clamp_range(F.col("s"), F.col("e"), F.col("p"), F.col("last"))).collect()]
    assert got == [(1, 3, "end_4_clamped_to_3", True), (1, 5, None, False), (2, 4, None, False), (0, 2, None, False), (3, 3, None, True)]
    labels = spark.createDataFrame([("a",), ("z",), (None,)], "l string")
    mapped = rules.map_labels(labels, "l", [("a", "k", None), ("b", "m", "n")], ["kind", "sub"]).collect()
    assert [tuple(r) for r in mapped] == [("a", "k", None, False), ("z", None, None, True), (None, None, None, True)]
