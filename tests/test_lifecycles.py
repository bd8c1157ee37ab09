"""Volume to cases, library import and publication on Arabic fixtures."""

import hashlib
import uuid

import pytest
from pyspark.sql import functions as F

from quire import lifecycles as L
from quire.functions import patterns as P
from quire.operators import table_rules

FILLER = " نص الحكم" * 20
SUBJECT = "بيع عقار - فسخ العقد لظهور عيب رقم {}\n"


def page(deed, n, court="نظرت المحكمة العامة بالرياض، الحكم"):
    return f"{SUBJECT.format(n)}رقم الصك {deed} بتاريخ 1434/2/5 {court}{FILLER} {n}"


def volumes():
    v1, v2 = "judgments-1434-volume-1.pdf", "judgments-1434-volume-2.pdf"
    return [
        (v1, 1, "غلاف" + FILLER), (v1, 2, page(11111, 1)), (v1, 3, "تتمة أولى"), (v1, 4, page(22222, 2)),
        (v1, 5, f"رقم الصك 33333 بتاريخ 1434/2/6{FILLER}"), (v1, 6, "بلا عنوان"), (v1, 7, page(44444, 3, "")), (v1, 8, ""),
        (v2, 1, page(11111, 1)), (v2, 2, "تتمة أولى"), (v2, 3, page(22222, 9)),
        ("index.pdf", 1, "الفهارس"), ("index.pdf", 2, "فهرس\nالكلمات" + FILLER), ("index.pdf", 3, page(55555, 5)),
        ("blank.pdf", 1, "لا شيء هنا"),
    ]


@pytest.mark.parametrize("piece,block", [(500, 1000), (2, 4)])
def test_volumes_to_cases(spark, piece, block):
    pages = spark.createDataFrame(volumes(), "source_file string, page_no int, text string")
    cases = L.extract_cases(pages, piece_pages=piece, block=block)
    rows = {r["id"]: r for r in cases.records.collect()}
    one, two = "collector-1434-v1-p2-11111", "collector-1434-v1-p4-22222"
    bare, twin = "collector-1434-v1-p7-44444", "collector-1434-v2-p3-22222"
    assert set(rows) == {one, two, bare, twin}
    assert rows[one]["review_status"] == L.COMPLETE and rows[one]["court"] == "المحكمة العامة بالرياض"
    assert (rows[one]["start_page"], rows[one]["end_page"], rows[one]["pages"], rows[one]["volume"]) == (2, 3, 2, 1)
    assert (rows[two]["end_page"], rows[bare]["end_page"]) == (4, 8)
    assert rows[bare]["review_status"] == L.INCOMPLETE and rows[bare]["missing_requirements"] == ["court"]
    assert rows[two]["review_status"] == rows[twin]["review_status"] == L.COLLIDED
    assert rows[two]["missing_requirements"] == ["reference_collision:deed_number"]
    text = " ".join((page(11111, 1) + "\fتتمة أولى").split())
    assert rows[one]["text_hash"] == hashlib.sha256(text.encode()).hexdigest()
    assert [(r["candidate_id"], r["canonical_id"]) for r in cases.duplicates.collect()] == [("collector-1434-v2-p1-11111", one)]
    assert [(r["id"], r["end_page"], r["reason"]) for r in cases.skipped.collect()] == [
        ("collector-1434-v1-p5-33333", 6, "missing_source_subject")]
    assert {(r["id"], r["kind"], r["members"]) for r in cases.collisions.collect()} == {(two, "deed_number", 2), (twin, "deed_number", 2)}
    log = {r["source_file"][-12:]: (r["pages"], r["detected_boundaries"], r["indexed"], r["status"]) for r in cases.processing_log.collect()}
    assert log == {"volume-1.pdf": (8, 4, 1, "indexed"), "volume-2.pdf": (3, 2, 0, "indexed"),
                   "index.pdf": (3, 0, 0, "reference_only"), "blank.pdf": (1, 0, 0, "needs_review")}
    assert cases.verified().count() == 1 and cases.pending().count() == 3

    sums = pages.select("source_file").distinct().withColumn("source_checksum", F.sha2("source_file", 256))
    tables = L.publish_cases(cases.records, sums)
    space = uuid.UUID(P.JUDGMENT_NAMESPACE)
    digest = hashlib.sha256(rows[one]["source_file"].encode()).hexdigest()
    made = {r["legacy_id"]: r for r in tables["legal_documents"].collect()}
    assert made[one]["id"] == str(uuid.uuid5(space, f"document:{digest}:{one}"))
    assert (made[one]["hijri_date"], made[one]["year"], made[two]["review_status"]) == ("1434/2/5", "1434", L.COLLIDED)
    assert {r["matched_external_id"] for r in tables["duplicate_candidates"].collect()} == {"deed_number:22222"}
    assert table_rules.check_table(tables["legal_documents"], "legal_documents").count() == 0


def test_library_split(spark):
    body = "نص " * 70
    text = f"<مقدمة> رقم الصك: 111111 {body} رقم الدعوى 5555 {body} رقم الصك: 222222 {body}"
    df = spark.createDataFrame([(1, text), (2, "تعميم رقم 123 قصير"), (3, "")], "id int, text string")
    got = [(r["id"], r["part"], r["document_type"]) for r in L.split_library(df).orderBy("id", "part").collect()]
    assert got == [(1, 1, "حكم قضائي"), (1, 2, "حكم قضائي"), (2, 1, "تعميم")]


def test_library_import(spark):
    base = "حكم رقم الصك 12345 رقم القضية 777 في عام 1440 هجري"
    rows = [
        ("a", 1, base, "s1", "u1", "", ""), ("b", 2, "  " + base.replace(" ", "  "), "s2", "u2", "", ""),
        ("c", 3, "نص آخر رقم القضية 777", "s3", "u3", "", ""), ("d", 4, "نص ثالث", "s3", "u4", "", ""),
        ("e", 5, "نص رابع رقم الصك 12345", "s5", "u5", "", ""), ("f", 6, " ", "s6", "u6", "", ""),
        ("g", 7, "نص خامس", "", "u7", "", ""), ("h", 8, "قرار", "s8", "", "f8", "عنوان")]
    df = spark.createDataFrame(rows, "id string, ord long, text string, source_checksum string, source_url string, source_file string, title string")
    done = L.import_library(df)
    kept = {r["id"]: r for r in done.accepted.collect()}
    assert set(kept) == {"a", "c", "h"}
    assert (kept["a"]["deed_number"], kept["a"]["lawsuit_number"], kept["a"]["year"], kept["a"]["document_type"]) == ("12345", "777", "1440", "حكم قضائي")
    assert kept["h"]["title"] == "عنوان" and kept["c"]["title"] == "نص آخر رقم القضية 777"
    assert {r["id"]: (r["canonical_id"], r["method"]) for r in done.duplicates.collect()} == {
        "b": ("a", "exact_normalized_text"), "d": ("c", "exact_source_checksum"), "e": ("a", "confirmed_deed_number")}
    assert {r["id"]: r["possible_canonical"] for r in done.candidates.collect()} == {"c": "a"}
    assert {r["id"]: r["reason"] for r in done.rejected.collect()} == {"f": "missing_extracted_text", "g": "missing_required_metadata"}
    assert {r["rule"] for r in done.violations.filter("severity = 'error'").collect()} == set()


def test_search_eligibility(spark):
    docs = spark.createDataFrame(
        [("d1", "judgment", "active", "approved", 1, 2, "f1"), ("d2", "judgment", "review", "approved", 1, 2, "f1"),
         ("d3", "blog_index", "active", "approved", 1, 2, "f1"), ("d4", "judgment", "active", "approved", None, None, "f1"),
         ("d5", "judgment", "active", "approved", 1, 1, "f2"), ("d6", "judgment", "active", "approved", 1, 1, "f3")],
        "id string, document_type string, status string, review_status string, source_page_start int, source_page_end int, source_file_id string")
    files = spark.createDataFrame([("f1", "s1", "processed"), ("f2", "s1", "failed"), ("f3", "s2", "processed")], "id string, source_id string, processing_status string")
    sources = spark.createDataFrame([("s1", True), ("s2", False)], "id string, is_official boolean")
    assert [r["id"] for r in L.eligible(docs, files, sources).collect()] == ["d1"]
