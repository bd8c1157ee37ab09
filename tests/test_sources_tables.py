"""Readers, sinks and idempotent maintenance."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.session import children, create_once
from quire.sources import registers as R
from quire.sources import tables as K

RECORD = T.StructType([T.StructField("id", T.StringType()), T.StructField("pages", T.IntegerType())])


def local(folder, name, data: bytes):
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, name)
    with open(path, "wb") as handle:
        handle.write(data)
    return path


def test_strict_register_scan(spark, folder):
    path = local(folder, "r.ndjson", '{"id":"a","pages":3}\n   \n[1]\n{broken\n5\n{"id":"b"}\n{"id":"c","pages":"x"}\n'.encode())
    rows, errors = R.read_register(spark, path, RECORD)
    assert sorted((r["id"], r["pages"]) for r in rows.collect() if r["id"] != "c") == [("a", 3), ("b", None)]
    assert rows.filter("id = 'c'").count() == 1
    assert sorted((e["reason"], e["line"].strip()) for e in errors.collect()) == [
        ("blank_line", ""), ("invalid_json", "{broken"), ("non_object", "5"), ("non_object", "[1]")]
    assert R.read_lenient(spark, path, RECORD).count() == 3
    assert all(e["path"].endswith("r.ndjson") for e in errors.collect())


def test_union_with_aliases(spark):
    a = spark.createDataFrame([("1", "", "t1")], "lawsuitNumber string, caseNumber string, title string")
    b = spark.createDataFrame([("9", "h")], "case_number string, text_sha256 string")
    aliases = {"lawsuit": ["lawsuitNumber", "caseNumber", "case_number"], "text_hash": ["textChecksum", "text_sha256"]}
    got = {r["register"]: (r["lawsuit"], r["title"], r["text_hash"]) for r in R.union_registers({"a": a, "b": b}, aliases).collect()}
    assert got == {"a": ("1", "t1", None), "b": ("9", None, "h")}


def test_manifest_and_list(spark, folder):
    path = local(folder, "m.csv", 'id,note\n1,"a, ""b""\nc"\n2,\n'.encode())
    rows = R.read_manifest(spark, path, ["id", "note"]).orderBy("id").collect()
    assert [(r["id"], r["note"]) for r in rows] == [("1", 'a, "b"\nc'), ("2", None)]
    assert R.read_manifest(spark, folder + "/absent.csv", ["id"]).count() == 0
    path = local(folder, "l.txt", b"# head\n\n https://a \tnote\n  # no\nhttps://b\n")
    assert sorted(r["entry"] for r in R.read_list(spark, path).collect()) == ["https://a", "https://b"]


def test_binary_inventory(spark, folder):
    whole = b"%PDF" + b"x" * 2000
    local(folder, "a.pdf", whole)
    local(folder + "/deep", "b.pdf", b"%PDF tiny")
    local(folder, "c.txt", whole)
    got = {r["name"]: (r["bytes"], r["sha256"], r["is_original"]) for r in R.binary_manifest(spark, folder).collect()}
    assert got == {"a.pdf": (2004, hashlib.sha256(whole).hexdigest(), True),
                   "b.pdf": (9, hashlib.sha256(b"%PDF tiny").hexdigest(), False)}


def message(post, documents, forward=""):
    docs = "".join(
        f'<a class="tgme_widget_message_document_wrap" href="https://t.me/c/{post}?d={i}&amp;s=1" x="1"> <i></i>'
        f'<div class="tgme_widget_message_document_title" dir="auto">{title}</div>\n '
        f'<div class="tgme_widget_message_document_extra">{size}</div></a>' for i, (title, size) in enumerate(documents))
    return (f'<div class="tgme_widget_message_wrap js"><div class="tgme_widget_message text" data-post="chan/{post}" data-view="x">'
            f'{forward}{docs}<time datetime="2026-09-0{post}T10:00:00+00:00">x</time></div></div>')


def test_preview_pages(spark):
    forward = 'tgme_widget_message_forwarded_from_name">من <a href="https://t.me/src?x=1&amp;y=2" z="1"> <b>قناة</b> المصدر </a>'
    html = "<body>" + message(5, [("تعميم <b>رقم</b> 1.pdf", "1.2 MB"), ("قرار &amp; ملحق.pdf", "3 KB")], forward) + message(6, []) + message(7, [("x.pdf", "1 B")]) + "</body>"
    df = spark.createDataFrame([(1, html)], "page_id int, html string")
    got = R.parse_messages(df, "page_id", "html").orderBy("post_id", "document_no").collect()
    assert [(r["post_id"], r["filename"], r["display_size"], r["posted_at"]) for r in got] == [
        (5, "تعميم رقم 1.pdf", "1.2 MB", "2026-09-05T10:00:00+00:00"), (5, "قرار & ملحق.pdf", "3 KB", "2026-09-05T10:00:00+00:00"),
        (7, "x.pdf", "1 B", "2026-09-07T10:00:00+00:00")]
    assert (got[0]["post_url"], got[0]["forwarded_from_name"], got[0]["forwarded_from_url"]) == (
        "https://t.me/c/5?d=0&s=1", "قناة المصدر", "https://t.me/src?x=1&y=2")
    assert got[2]["forwarded_from_name"] == ""
    assert df.select(R.numbers_on_page(F.col("html"))).first()[0] == [5, 6, 7]


def test_pages_padded_and_cut(spark):
    df = spark.createDataFrame([(1, "a\fb\fc", 2), (2, "a", 3), (3, "a", 0)], "id int, t string, n int")
    got = [(r["id"], r["page_no"], r["page_text"]) for r in R.pages_of(df, "id", "t", F.col("n")).orderBy("id", "page_no").collect()]
    assert got == [(1, 1, "a"), (1, 2, "b"), (2, 1, "a"), (2, 2, ""), (2, 3, "")]


def test_versions_switch_only_after_success(spark, folder):
    a = spark.createDataFrame([(1, None)], "id int, note string")
    K.write_register(a, folder)
    assert '"note":null' in spark.read.text(f"{folder}/{K.current_version(spark, folder)[1]}").first()[0]
    broken = a.select(F.raise_error(F.lit("lost")).cast("int").alias("id"), "note")
    with pytest.raises(Exception, match="lost"):
        K.replace_dataset(broken, folder)
    assert K.read_dataset(spark, folder, a.schema).collect() == a.collect()
    K.replace_dataset(a.withColumn("id", F.lit(2)), folder)
    assert K.read_dataset(spark, folder).first()["id"] == 2
    with pytest.raises(FileNotFoundError):
        K.read_dataset(spark, folder + "-none")


def test_batches_on_disk(spark, folder):
    K.write_batches(spark.range(250).withColumnRenamed("id", "k"), folder, "k", 100, block=64)
    got = K.read_dataset(spark, folder, "k long, batch string").groupBy("batch").agg(F.count("*").alias("n"), F.min("k").alias("a")).orderBy("batch").collect()
    assert [(r["batch"], r["n"], r["a"]) for r in got] == [("001", 100, 0), ("002", 100, 100), ("003", 50, 200)]


def test_insert_is_idempotent(spark):
    target = spark.createDataFrame([(1, "a"), (2, None)], "id int, sha string")
    source = spark.createDataFrame([(2, "z"), (3, "a"), (4, "b"), (5, "b"), (6, None), (7, None)], "id int, sha string")
    on_id = K.insert_if_absent(target, source, "id", [["id"]])
    assert sorted(r["id"] for r in on_id.collect()) == [1, 2, 3, 4, 5, 6, 7]
    on_any = K.insert_if_absent(target, source, "id", [["id"], ["sha"]])
    assert sorted(r["id"] for r in on_any.collect()) == [1, 2, 4, 6, 7]
    again = K.insert_if_absent(on_any, source, "id", [["id"], ["sha"]])
    assert sorted(again.collect(), key=str) == sorted(on_any.collect(), key=str)


def test_guarded_update_runs_once(spark):
    target = spark.createDataFrame([(1, "old", 5), (2, "other", 5), (3, "old", 5)], "id int, sha string, size int")
    audit = spark.createDataFrame([(1, "old", "new", 9), (2, "old", "new", 9)], "id int, old string, fresh string, bytes int")
    done = K.guarded_update(target, audit, "id", {"sha": "fresh", "size": "bytes"}, ("sha", "old"))
    assert sorted(done.collect()) == [(1, "new", 9, True), (2, "other", 5, False), (3, "old", 5, False)]
    again = K.guarded_update(done.drop("updated"), audit, "id", {"sha": "fresh", "size": "bytes"}, ("sha", "old"))
    assert again.filter("updated").count() == 0


def test_snapshot_refuses_to_overwrite(spark, folder):
    proof = K.snapshot({"a": spark.range(5), "b": spark.range(0)}, folder)
    assert {r["table_name"]: (r["source_rows"], r["verified"]) for r in proof.collect()} == {"a": (5, True), "b": (0, True)}
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        K.snapshot({"a": spark.range(5)}, folder)


def test_upsert_and_status(spark):
    target = spark.createDataFrame([(1, "f", 5, "old"), (2, "g", 1, "keep")], "post int, name string, v int, x string")
    source = spark.createDataFrame([(1, "f", 1, "new"), (1, "f", 2, "newer"), (3, "h", 1, "added")], "post int, name string, v int, x string")
    assert sorted(r["x"] for r in K.upsert(target, source, ["post", "name"], "v").collect()) == ["added", "keep", "newer"]
    register = spark.createDataFrame([(1, "a", "s0"), (2, "b", "s0"), (3, "c", "s0"), (4, "d", "s0")], "id int, f string, status string")
    log = spark.createDataFrame([("a", "indexed", 3), ("b", "indexed", 0), ("c", "failed", 0)], "f string, st string, n int")
    labels = {"indexed": "split %d", "indexed_none": "split none", "failed": "failed"}
    got = {r["f"]: r["status"] for r in K.sync_status(register, log, "id", "f", "st", "n", labels).collect()}
    assert got == {"a": "split 3", "b": "split none", "c": "failed", "d": "s0"}


def test_empty_batch_leaves_the_log_alone(spark, folder):
    rows = spark.createDataFrame([(1,)], "id int")
    assert K.read_log(spark, folder) is None
    assert K.append_once(rows, folder, 0) and not K.append_once(rows.filter("id > 1"), folder, 1)
    K.append_once(rows, folder, 0)
    assert [tuple(r) for r in K.read_log(spark, folder).collect()] == [(1, 0)]


def test_of_two_writers_one_fails_and_nothing_is_left(spark, folder):
    K.replace_dataset(spark.range(3), folder)

    class Late:
        """A table whose write lets another writer finish first."""

        def __init__(self, df):
            self.df, self.sparkSession = df, df.sparkSession

        @property
        def write(self):
            K.replace_dataset(spark.range(5), folder)
            return self.df.write

    with pytest.raises(K.VersionConflict, match="version 2"):
        K.replace_dataset(Late(spark.range(9)), folder)
    assert K.read_dataset(spark, folder).count() == 5 and K.current_version(spark, folder)[0] == 2
    assert len([n for n in children(spark, folder) if n.startswith("v-")]) == 2 and K.sweep(spark, folder) == 0


def test_old_versions_and_lost_writers(spark, folder):
    for n in range(1, 5):
        K.replace_dataset(spark.range(n), folder)
    assert len([n for n in children(spark, folder) if n.startswith("v-")]) == 2
    with pytest.raises(Exception, match="lost writer"):
        K.replace_dataset(spark.range(9).select(F.when(F.col("id") > 7, F.raise_error(F.lit("lost writer"))).otherwise(F.col("id")).alias("id")), folder)
    assert K.read_dataset(spark, folder).count() == 4 and K.sweep(spark, folder) == 0
    spark.range(1).write.parquet(f"{folder}/v-lost")
    assert K.sweep(spark, folder) == 1
    # A writer lost between creating its log file and filling it has not switched anything; the next one passes it by.
    assert create_once(spark, f"{folder}/log/seq-000000005.json", "") and not create_once(spark, f"{folder}/log/seq-000000005.json", "x")
    K.replace_dataset(spark.range(7), folder)
    assert K.read_dataset(spark, folder).count() == 7 and K.current_version(spark, folder)[0] == 6


def test_a_file_holds_many_whole_batches(spark, folder):
    K.write_batches(spark.range(1050).withColumnRenamed("id", "k"), folder, "k", 100, per_file=4)
    got = K.read_dataset(spark, folder, "k long, batch string").withColumn("file", F.input_file_name()).collect()
    files = {}
    for r in got:
        files.setdefault(r["batch"], set()).add(r["file"])
    assert len(got) == 1050 and len(files) == 11 and all(len(v) == 1 for v in files.values())
    assert len(set.union(*files.values())) <= 3
