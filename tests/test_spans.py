"""Spans read whole however they lie in pieces."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quire.functions import fields as X
from quire.functions import patterns as P
from quire.functions.text import normalise
from quire.operators.segment import short_pieces, span_court, span_halos, span_text, split_document

MARKS = ["المحكمة العامة", "محكمة الاستئناف"]
WORDS = [*MARKS, "محكمة", "الاستئناف", "المحكمة", "العامة", "صدق الحكم", "قرار", "التصديق", "بجدة،", "رقم", "نص" * 30, "نص " * 40, "", "ا"]


def plain_court(text, markers):
    """First place of each marker in order; the guarded one skips places whose surroundings reject it."""
    for marker in markers:
        for at in (m.start() for m in re.finditer(re.escape(marker), text)):
            near = text[max(0, at - 90):at] + marker + text[at + len(marker):][:120]
            if marker == P.APPEAL_COURT and re.search(P.APPEAL_CERTIFICATION, near):
                continue
            name = re.split(P.COURT_TAIL_STOP, text[at:at + 140])[0].strip(P.LINE_PUNCTUATION)[:120]
            if name:
                return name
            break
    return None


def volumes(seed):
    rng = random.Random(seed)
    rows = []
    for number in range(12):
        for page in range(1, rng.choice([1, 3, 40])):
            rows.append((f"v{number}", page, " ".join(rng.choice(WORDS) for _ in range(rng.choice([0, 1, 1, 2, 6]))), page % 23 == 1))
    # A hot source whose pages are single characters: a context reaches over hundreds of pieces.
    hot = (" نص" * 60 + " صدق الحكم من محكمة الاستئناف بمكة" + " نص" * 60 + " محكمة الاستئناف بجدة، " + "نص " * 20) * 2
    rows += [("hot", i + 1, c, i == 0) for i, c in enumerate(hot.replace(" ", "\n"))]
    return rows


@pytest.mark.parametrize("piece", [1, 2, 500])
def test_court_of_a_span_does_not_depend_on_its_pieces(spark, piece):
    rows = volumes(3)
    pages = spark.createDataFrame(rows, "source string, page int, text string, starts boolean")
    pieces = span_text(pages, "source", "page", "text", "starts", piece_pages=piece, block=100)
    found = span_court(pieces, "source", normalise(F.col("span_text")), markers=MARKS, block=64)
    mine = {(r["source"], r["span_no"]): r["court"] for r in found.collect()}
    whole, number = {}, {}
    for source, _, text, starts in rows:
        number[source] = number.get(source, 0) + starts
        whole.setdefault((source, number[source]), []).append(text)
    texts = {k: " ".join("\f".join(v).split()) for k, v in whole.items()}
    assert mine == {k: plain_court(t, MARKS) for k, t in texts.items()}
    assert len({v for v in mine.values()}) > 3


def test_names_and_contexts_across_a_border(spark):
    spans = {
        "name": ["نظرت المحكمة", "", "العامة", "بجدة", "، الحكم"],
        "reject": ["صدق", "الحكم", "من", "محكمة", "الاستئناف", "بمكة"],
        "later": ["صدق الحكم من محكمة الاستئناف", "نص " * 50, "محكمة الاستئناف بجدة،"],
        "none": ["", "", ""],
    }
    rows = [(k, i + 1, t, i == 0) for k, pages in spans.items() for i, t in enumerate(pages)]
    pages = spark.createDataFrame(rows, "source string, page int, text string, starts boolean")
    pieces = span_text(pages, "source", "page", "text", "starts", piece_pages=1)
    found = span_court(pieces, "source", normalise(F.col("span_text")))
    assert {r["source"]: r["court"] for r in found.collect()} == {
        "name": "المحكمة العامة بجدة", "reject": None, "later": "محكمة الاستئناف بجدة", "none": None}


def test_halos_are_slices_of_the_span(spark):
    rng = random.Random(5)
    texts = {s: [rng.choice(["", "a", "bc", "d" * 9, "efgh " * 8 + "i"]) for _ in range(rng.choice([1, 2, 30]))] for s in map(str, range(8))}
    rows = [(s, 1, i, t) for s, parts in texts.items() for i, t in enumerate(parts)]
    pieces = spark.createDataFrame(rows, "source string, span_no long, piece long, text string")
    found = span_halos(pieces, "source", F.col("text"), 7, 11, block=4)
    mine = {(r["source"], r["piece"]): (r["_follows"], r["_before"], r["_after"]) for r in found.collect()}
    wanted = {}
    for s, parts in texts.items():
        whole, at = " ".join(t for t in parts if t), 0
        for i, t in enumerate(parts):
            if t and len(parts) > 1:
                lead = at > 0
                end = at + lead + len(t)
                wanted[s, i] = (lead, whole[max(0, at - 7):at], whole[end:end + 11])
                at = end
    assert mine == wanted and wanted


def test_court_without_neighbourhood_is_the_whole_text(spark):
    one = spark.createDataFrame([("نظرت المحكمة العامة بجدة، ثم",)], "t string")
    assert one.select(X.court(F.col("t"))).first()[0] == "المحكمة العامة بجدة"


def test_short_pieces_are_what_the_split_leaves_out(spark):
    cases = {"both": "رقم الصك 111 رقم الصك 222 " + "نص " * 10, "whole": "رقم الصك 111 رقم الصك 222", "one": "رقم الصك 111", "empty": ""}
    df = spark.createDataFrame(list(cases.items()), "id string, t string")
    left = df.select("id", F.inline(short_pieces(F.col("t"), ["رقم الصك ([0-9]{3,20})"], 20))).collect()
    assert [tuple(r) for r in left] == [("both", 1, "رقم الصك 111")]


def test_a_number_within_a_number_cuts_nothing(spark):
    df = spark.createDataFrame([("and hand brown x and blue y", "with the forewith the fog x with the rest of it")], "t string, u string")
    assert df.select(F.inline(short_pieces(F.col("t"), ["and ([a-z]{4,20})"], 12))).collect() == [(2, "and blue y")]
    assert df.select(split_document(F.col("u"), ["with the ([a-z]{3,20})"], 5)).first()[0] == ["with the forewith the fog x", "with the rest of it"]
    assert df.select(split_document(F.col("t"), ["(?:and|brown) ([a-z]{4,20})?"], 5)).first()[0] == ["and hand brown x", "and blue y"]
