"""NULL keys, sizes and ids, repeated audit ids, cuts that drop nothing, intermediate tables."""

import re
import unicodedata

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quire import session
from quire.functions import text as X
from quire.lifecycles import import_library
from quire.operators.dedup import first_wins
from quire.sources import registers as R
from quire.sources import tables as K
from quire.streaming import budget as B


def test_null_keys_conflict_with_nothing(spark):
    target = spark.createDataFrame([(1, "a")], "id int, sha string")
    source = spark.createDataFrame([(2, None), (3, None), (4, "a"), (5, "b"), (6, "b")], "id int, sha string")
    got = K.insert_if_absent(target, source, "id", [["sha"]])
    assert sorted(r.id for r in got.collect()) == [1, 2, 3, 5]


def test_null_key_is_its_own_first(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, "a"), (4, None)], "id int, sha string")
    got = {r.id: (r.canonical_id, r.is_first) for r in first_wins(rows.withColumn("ord", F.col("id")), "sha", "id", "ord").collect()}
    assert got == {1: (1, True), 2: (2, True), 3: (1, False), 4: (4, True)}


def test_unknown_size_and_no_limit(spark):
    rows = spark.createDataFrame([("c", 1, 50), ("c", 2, None), ("c", 3, 90), ("c", 4, 40)], "channel string, post long, bytes long")
    got = {r.post: r.status for r in B.admit(rows, "channel", "post", "bytes", item_limit=100, cycle_budget=100).collect()}
    assert got == {1: B.ACQUIRED, 2: B.ACQUIRED, 3: B.FAILED, 4: B.ACQUIRED}
    free = B.admit(rows, "channel", "post", "bytes", item_limit=0, cycle_budget=0).collect()
    assert {r.status for r in free} == {B.ACQUIRED}
    real = spark.createDataFrame([(2, 500), (4, 40)], "post long, real long")
    assert {r.post: r.status for r in B.over_limit(real, "real", 100).collect()} == {2: B.MANUAL, 4: B.ACQUIRED}


def test_audit_with_a_repeated_id_fails(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b")], "id int, sha string")
    audit = spark.createDataFrame([(1, "a", "x"), (1, "a", "y")], "id int, old string, fresh string")
    with pytest.raises(PySparkException, match="twice"):
        K.guarded_update(target, audit, "id", {"sha": "fresh"}, ("sha", "old")).collect()
    good = K.guarded_update(target, audit.limit(1), "id", {"sha": "fresh"}, ("sha", "old"))
    assert {(r.id, r.sha, r.updated) for r in good.collect()} == {(1, "x", True), (2, "b", False)}


def test_pages_and_payloads_lose_nothing(spark):
    texts = spark.createDataFrame([(1, "a\fb\fc", 2), (2, "d", 3), (3, "e", None)], "id int, t string, n int")
    pages = {(r.id, r.page_no): r.page_text for r in R.pages_of(texts, "id", "t", F.col("n")).collect()}
    beyond = {(r.id, r.page_no): r.page_text for r in R.pages_beyond(texts, "id", "t", F.col("n")).collect()}
    assert pages == {(1, 1): "a", (1, 2): "b", (2, 1): "d", (2, 2): "", (2, 3): ""} and beyond == {(1, 3): "c", (3, 1): "e"}
    payload = spark.createDataFrame([(1, [(5,), (6,)], 2)], "b int, items array<struct<v:int>>, declared int")
    assert [r.v for r in R.payload_items(payload, "items", "declared").collect()] == [5, 6]
    with pytest.raises(PySparkException, match="declares"):
        R.payload_items(payload.withColumn("declared", F.lit(1)), "items", "declared").collect()


def test_an_empty_batch_replaces_its_earlier_try(spark, folder):
    rows = spark.createDataFrame([(1,), (2,)], "id int")
    assert K.append_once(rows, folder, 0) and K.append_once(rows, folder, 1) and not K.append_once(rows.limit(0), folder, 1)
    assert sorted((r.id, r.batch_id) for r in K.read_log(spark, folder).collect()) == [(1, 0), (2, 0)]


def test_arabic_marks_and_punctuation_stay_in_the_jvm(spark):
    inside = re.compile(f"^[{X.STABLE}{X.DROPPED}]*$")
    assert inside.match("قَالَ، نَعَمْ؛ لِمَ؟ شَدَّةٌ") and not inside.match("ا\u0653")
    marks = [chr(c) for c in range(0x610, 0x671) if re.match(f"[{X.DROPPED}]", chr(c))]
    letters = [chr(c) for c in range(0x621, 0x64B)]
    for m in marks:  # no mark composes with a letter, alone or behind another mark
        for a in letters:
            assert sorted(unicodedata.normalize("NFKC", a + "َ" + m)) == sorted(a + "َ" + m)
    raw = "قَالَ، نَعَمْ؛ لِمَ؟  شَدَّةٌ ١٢"
    got = spark.createDataFrame([(raw,)], "t string").select(X.normalise(F.col("t"), "deposit").alias("n")).first().n
    assert got == re.sub(r"[ً-ْ]", "", raw).replace("  ", " ").replace("١٢", "12")


def test_given_numbers_are_normalised(spark):
    rows = [
        ("a", 1, "رقم الصك: 12345 نص اول", "s1", "u1", None, None), ("b", 2, "نص اخر", "s2", "u2", "١٢٣٤٥", None),
        ("c", 3, "نص ۱۲۳", "s3", "u3", None, "٧٧"), (None, 4, "نص بلا رقم", "s4", "u4", None, None), ("d", 5, "نص 123", "s5", "u5", None, None),
    ]
    records = spark.createDataFrame(rows, "id string, ord int, text string, source_checksum string, source_url string, deed_number string, case_number string")
    records = records.withColumn("source_file", F.lit(""))
    out = import_library(records)
    assert {(r.id, r.canonical_id, r.method) for r in out.duplicates.collect()} == {("b", "a", "confirmed_deed_number"), ("d", "c", "exact_normalized_text")}
    assert {(r.id, r.lawsuit_number) for r in out.accepted.collect()} == {("a", ""), ("c", "77")}
    assert {(r.id, r.reason) for r in out.rejected.collect()} == {(None, "missing_required_metadata")}


def test_intermediate_tables_can_be_deleted(spark):
    import os

    session.cut(spark.range(3))
    made = [p.removeprefix("file:") for p in session._MADE[spark.sparkContext.applicationId]]
    assert any(map(os.path.exists, made))
    assert session.release(spark) == len(made) and not any(map(os.path.exists, made))


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "yarn"

        def getConf(self):
            return self

        def get(self, *_):
            return None

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = conf = Context()

    with pytest.raises(ValueError, match="share"):
        session.shared_dir(Session())
