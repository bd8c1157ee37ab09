"""Deposited files to records, on Arabic fixtures."""

import hashlib

import pytest

from quire.deposits import deposit_records

BODY = " نص المستند" * 12


def sha(text):
    return hashlib.sha256(" ".join(text.split()).encode()).hexdigest()


@pytest.mark.parametrize("piece,block", [(500, 1000), (2, 4)])
def test_files_to_records(spark, piece, block):
    circular = "تعميم\nرقم التعميم 123/45 بتاريخ 1440/5/6" + BODY
    decision = "قرار\nرقم القرار 777" + BODY
    cites = "يشير النص إلى الحكم رقم 999" + " ".join(["كلمة"] * 3)
    plain = "حكم قضائي" + BODY
    pages = [
        ("a", 1, "غلاف"), ("a", 2, circular), ("a", 3, "تتمة"), ("a", 4, None), ("a", 5, decision),
        ("b", 1, circular), ("b", 2, "تتمة"), ("b", 3, ""),
        ("c", 1, plain), ("c", 2, "تتمة أخرى"), ("d", 1, None), ("e", 1, decision), (None, 1, circular), ("unknown", 1, circular),
        ("f", 1, cites + " بلا نوع"),
    ]
    sources = [("a", "a.pdf", "https://example.org/"), ("b", "b.pdf", None), ("c", "c.pdf", None), ("d", "فهرس.pdf", None), ("e", "e.pdf", ""), ("f", "f.pdf", None)]
    df = spark.createDataFrame(pages, "source string, page int, text string")
    existing = spark.createDataFrame([(sha(decision), "old-2"), (sha(decision), "old-1"), (None, "x")], "text_hash string, id string")
    src = spark.createDataFrame(sources, "source string, name string, official_url string")
    out = deposit_records(df, src, existing, piece_pages=piece, block=block)
    got = {r["id"]: r for r in out.collect()}
    assert set(got) == {f"deposit-{k}" for k in ("a-p2", "a-p5", "b-p1", "c-p1", "d-p1", "e-p1", "f-p1")}
    first = got["deposit-a-p2"]
    assert (first["kind"], first["reference"], first["date"], first["end_page"]) == ("circular", "123/45", "1440/5/6", 4)
    assert first["text_hash"] == sha(circular + "\fتتمة\f") and first["duplicate_of"] is None
    assert got["deposit-b-p1"]["duplicate_of"] == "deposit-a-p2" and got["deposit-b-p1"]["review_status"] == "exact_duplicate_review"
    assert got["deposit-a-p5"]["duplicate_of"] == got["deposit-e-p1"]["duplicate_of"] == "old-1"
    assert "official_source_url" not in first["missing_requirements"] and "official_source_url" in got["deposit-e-p1"]["missing_requirements"]
    assert (got["deposit-c-p1"]["kind"], got["deposit-c-p1"]["end_page"], got["deposit-c-p1"]["reference"]) == ("judgment", 2, None)
    assert {"verified_reference", "official_source_url"} <= set(got["deposit-c-p1"]["missing_requirements"])
    assert got["deposit-d-p1"]["kind"] == "blog_or_index" and got["deposit-d-p1"]["text_hash"] == sha("")
    assert {"verified_legal_type", "verified_title"} <= set(got["deposit-d-p1"]["missing_requirements"])
    assert got["deposit-f-p1"]["reference"] is None


def test_no_files(spark):
    pages = spark.createDataFrame([], "source string, page int, text string")
    sources = spark.createDataFrame([], "source string, name string, official_url string")
    assert deposit_records(pages, sources).collect() == []
