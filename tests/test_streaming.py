"""Intake cycles: cursor, retries, budget, duplicates, gate, restart."""

import pytest
from pyspark.sql import functions as F

from quire.operators import validate as V
from quire.sources.keylog import KeyLog
from quire.sources.tables import read_log
from quire.streaming import budget as B
from quire.streaming import intake as I

FEED = "channel string, post long, bytes long, sha string"


def land(spark, folder, name, rows):
    spark.createDataFrame(rows, FEED).coalesce(1).write.parquet(f"{folder}/in/{name}")


def feed(spark, folder):
    return I.file_stream(spark, f"{folder}/in/*", spark.createDataFrame([], FEED).schema, 1)


def job(spark, folder, **more):
    settings = {"cursor": 99, "retry": (7,), "item_limit": 100, "cycle_budget": 150, **more}
    return I.Intake(spark, f"{folder}/out", "channel", "post", "bytes", "sha", **settings)


def one_cycle(rows, retries, item_limit, budget, per_cycle):
    """The statement: retries and the first posts in order, one budget a channel."""
    want, new, used = {}, {}, {}
    for channel, post, size, _ in sorted(rows, key=lambda r: r[1]):
        if post not in retries:
            new[channel] = new.get(channel, 0) + 1
            if new[channel] > per_cycle:
                want[post] = B.WAITING
                continue
        if size > item_limit:
            want[post] = B.MANUAL
        elif used.get(channel, 0) + size > budget:
            want[post] = B.FAILED
        else:
            used[channel] = used.get(channel, 0) + size
            want[post] = B.ACQUIRED
    return want


def test_greedy_budget_is_a_fold(spark):
    import random

    rng = random.Random(11)
    rows = [(rng.choice(["c0", "c1", None]), i, rng.randrange(1, 130), "x") for i in range(200)]
    retries = set(rng.sample(range(200), 60))
    df = spark.createDataFrame(rows, FEED).withColumn("again", F.col("post").isin(*retries)).repartition(5)
    got = B.admit(df, "channel", "post", "bytes", retry="again", item_limit=100, cycle_budget=700, per_cycle=20, block=7)
    want = one_cycle(rows, retries, 100, 700, 20)
    assert {r["post"]: r["status"] for r in got.collect()} == want and set(want.values()) == {B.MANUAL, B.FAILED, B.ACQUIRED, B.WAITING}


def test_one_budget_for_the_whole_cycle(spark, folder):
    """60 posts of 50 bytes under a budget of 100: two are admitted a cycle, retries first, and the cursor moves by 25 new posts."""
    land(spark, folder, "a", [("ch", 100 + i, 50, f"s{i}") for i in range(60)])
    work = job(spark, folder, cycle_budget=100)
    work.run(feed(spark, folder))
    assert sorted(r["post"] for r in work.log("register").collect()) == [100, 101]
    first = work.log("status").first()
    assert (first["acquired"], first["retry"], first["waiting"], first["cursor"]) == (2, 23, 35, 124)
    work.process(spark.createDataFrame([("ch", 110, 1, "late"), ("ch", 200, 1, "s")], FEED), 1)
    assert sorted(r["post"] for r in work.log("register").collect()) == [100, 101, 102, 103]
    second = work.log("status").filter("batch_id = 1").first()
    assert (second["acquired"], second["retry"], second["waiting"], second["cursor"]) == (2, 21 + 25, 11, 149)
    work.process(spark.createDataFrame([], FEED), 2)
    third = work.log("status").filter("batch_id = 2").first()
    assert (third["waiting"], third["cursor"]) == (0, 200)


def test_channels_have_their_own_cursor_and_budget(spark, folder):
    work = job(spark, folder, cycle_budget=100, per_cycle=2)
    work.process(spark.createDataFrame([(c, i, 40, f"{c}{i}") for c in ("a", "b") for i in (range(100, 103) if c == "a" else range(110, 116))], "channel string, post long, bytes long, sha string"), 0)
    assert {(r["channel"], r["cursor"]) for r in work.log("cursors").collect()} == {("a", 101), ("b", 111)}
    work.process(spark.createDataFrame([], FEED), 1)
    assert sorted(r["post"] for r in work.log("register").collect()) == [100, 101, 102, 110, 111, 112, 113]


def test_an_unknown_digest_keeps_its_row(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, "a"), (4, None)], "post long, sha string").withColumn("o", F.col("post"))
    assert {r.post: r.canonical_id for r in I.latest_registered(rows, "sha", "o", "post", None).collect()} == {1: None, 2: None, 3: 1, 4: None}
    earlier = spark.createDataFrame([(0, "a", 0), (5, None, 0)], "post long, sha string, batch_id long").withColumn("o", F.col("post"))
    assert {r.post: r.canonical_id for r in I.latest_registered(rows, "sha", "o", "post", earlier).collect()} == {1: 0, 2: None, 3: 1, 4: None}


def test_cycles_with_retry_and_restart(spark, folder):
    land(spark, folder, "a", [("ch", 7, 10, "s7"), ("ch", 8, 10, "s8"), ("ch", 100, 500, "big"), ("ch", 101, 90, "s1"),
                              ("ch", 102, 80, "s2"), ("ch", 103, 50, "s1")])
    work = job(spark, folder)
    work.run(feed(spark, folder))
    first = {r["post"]: r["canonical_id"] for r in work.log("register").collect()}
    assert first == {7: None, 101: None, 103: 101}
    failed = {r["post"]: (r["failure_class"], r["next_step"], r["reason"]) for r in work.log("failures").collect()}
    assert failed[100] == ("terminal", "approved_large_file_procedure", "attachment_exceeds_configured_limit:500>100")
    assert failed[102] == ("retryable", "retry_same_session", "cycle_attachment_budget_exceeded:100+80>150")

    land(spark, folder, "b", [("ch", 104, 5, "s1"), ("ch", 105, 5, "s9")])
    job(spark, folder).run(feed(spark, folder))
    register = {r["post"]: (r["canonical_id"], r["batch_id"]) for r in work.log("register").collect()}
    assert register == {7: (None, 0), 101: (None, 0), 103: (101, 0), 102: (None, 1), 104: (103, 1), 105: (None, 1)}

    before = sorted(map(str, work.log("register").collect()))
    job(spark, folder).run(feed(spark, folder))
    assert sorted(map(str, work.log("register").collect())) == before
    status = {r["outcome"]: (r["batch_id"], r["cursor"]) for r in work.last_success().collect()}
    assert status == {"completed_with_failures": (0, 103), "completed": (1, 105)}


def test_a_repeated_batch_replaces_itself(spark, folder):
    rows = spark.createDataFrame([("ch", 100, 10, "s"), ("ch", 101, 10, "s")], FEED)
    work = job(spark, folder)
    work.process(rows, 0)
    work.process(rows, 0)
    assert sorted((r["post"], r["canonical_id"]) for r in work.log("register").collect()) == [(100, None), (101, 100)]


def test_no_cursor_is_an_error(spark, folder):
    with pytest.raises(ValueError, match="bootstrap"):
        job(spark, folder, cursor=None)


def test_sources_are_processed_once(spark, folder):
    work = I.Processor(spark, folder, "id", "src", "h")
    a = spark.createDataFrame([(1, "f1", "h1"), (2, "f2", "h1")], "id long, src string, h string")
    work.process(a, 0)
    work.process(a, 1)
    work.process(spark.createDataFrame([(3, "f3", "h1"), (1, "f1", "h1")], "id long, src string, h string"), 2)
    got = {r["id"]: (r["review_status"].split("_")[0], r["duplicate_of"], r["batch_id"]) for r in read_log(spark, f"{folder}/records").collect()}
    assert got == {1: ("pending", None, 0), 2: ("exact", 1, 0), 3: ("exact", 1, 2)}


def test_gate_quarantines_the_whole_batch(spark, folder):
    check = I.gate(folder, "id", [V.required({"title": F.col("title")})[0]])
    check(spark.createDataFrame([(1, "a")], "id int, title string"), 0)
    check(spark.createDataFrame([(2, "b"), (3, " ")], "id int, title string"), 1)
    assert [r["id"] for r in read_log(spark, f"{folder}/published").collect()] == [1]
    assert sorted(r["id"] for r in read_log(spark, f"{folder}/quarantine").collect()) == [2, 3]
    assert [r["id"] for r in read_log(spark, f"{folder}/violations").collect()] == ["3"]


def test_change_monitor(spark):
    known = spark.createDataFrame([(1,), (2,), (4,)], "id long")
    rows, state = I.change_monitor(spark.createDataFrame([(2,), (3,), (4,), (5,), (5,)], "id long"), known, "id")
    assert {r["id"]: r["finding"] for r in rows.collect()} == {3: "gap", 5: "new_post"}
    assert tuple(state.first()) == (1, 1, True)
    _, state = I.change_monitor(known, known, "id")
    assert state.first()["changed"] is False


def test_key_log_opens_few_files_however_many_batches(spark, folder):
    log = KeyLog(spark, f"{folder}/keys", buckets=4, fan_in=3)
    probe = spark.createDataFrame([("k1",), ("k2",), ("gone",), (None,)], "sha string")
    holders, opened = {}, []
    for batch in range(10):
        log.compact(batch)
        found = log.held(probe, "sha", batch)
        if found is not None:
            opened.append(len(found.inputFiles()))
            got = {r["sha"]: (r["first_id"], r["last_id"]) for r in found.collect()}
            assert got == {k: (v[0], v[-1]) for k, v in holders.items() if k in ("k1", "k2")}
        rows = [(f"k{i % 5}", batch * 10 + i) for i in range(3 if batch % 2 else 5)] + [(None, batch * 10 + 9)]
        for key, ident in rows:
            if key:
                holders.setdefault(key, []).append(ident)
        log.append(spark.createDataFrame(rows, "sha string, id long"), "sha", "id", batch)
    assert log.units(9) == [(0, 8)] and log.units(10) == [(0, 8), (9, 9)]
    assert max(opened) <= 5 * 2


def test_key_log_opens_only_the_buckets_of_the_batch(spark, folder):
    log = KeyLog(spark, f"{folder}/keys", buckets=16)
    log.append(spark.range(1000).select(F.col("id").cast("string").alias("sha"), "id"), "sha", "id", 0)
    one = log.held(spark.createDataFrame([("17",)], "sha string"), "sha", 1)
    assert len(one.inputFiles()) == 1 and [tuple(r) for r in one.collect()] == [("17", 17, 17)]
    assert log.held(spark.createDataFrame([(None,)], "sha string"), "sha", 1) is None
    assert log.held(spark.createDataFrame([("17",)], "sha string"), "sha", 0) is None


def test_key_log_repeated_empty_and_broken_batches(spark, folder):
    log = KeyLog(spark, f"{folder}/keys", buckets=2, fan_in=2)
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "sha string, id long")
    log.append(rows, "sha", "id", 0)
    log.append(rows.filter("id = 1"), "sha", "id", 0)
    assert [tuple(r) for r in log.held(rows, "sha", 1).collect()] == [("a", 1, 1)]
    log.append(rows.filter("false"), "sha", "id", 1)
    assert log.units(2) == [(0, 0)]
    rows.withColumnRenamed("sha", "key").write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{folder}/keys/unit=2-2")
    assert log.units(3) == [(0, 0)]
    log.compact(4)
    assert log.units(4) == [(0, 3)] and [tuple(r) for r in log.held(rows, "sha", 4).collect()] == [("a", 1, 1)]


def test_many_cycles_read_as_few_files_as_one(spark, folder):
    work = job(spark, folder, retry=(), cycle_budget=1000)
    work.by_digest.fan_in = work.by_ident.fan_in = 2
    for number in range(5):
        work.process(spark.createDataFrame([("ch", 100 + number, 5, f"s{number % 3}")], FEED), number)
    got = {r["post"]: r["canonical_id"] for r in work.log("register").collect()}
    assert got == {100 + n: (97 + n if n > 2 else None) for n in range(5)}
    assert work.by_digest.units(5) == work.by_ident.units(5) == [(0, 3), (4, 4)]
