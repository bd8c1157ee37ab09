"""Queries beside their SQL on rows that the given tables hardly have."""

import os

import pytest
from oracle import SMALL, compare_frame, connect
from pyspark.sql import types as T

from quire.plans import PLANS
from quire.plans.registry import Tables
from quire.sources import registers as R

FIELDS = "doc_id long, text string, lang string, source string, n_chars long"


def landed(spark, folder, *files):
    """``documents`` as one file for each list of (id, text), the first one the oldest."""
    os.makedirs(f"{folder}/documents.parquet")
    for i, rows in enumerate(files):
        spark.createDataFrame([(d, t, "de", "src", len(t)) for d, t in rows], FIELDS).toPandas().to_parquet(f"{folder}/documents.parquet/{i}.parquet")
        os.utime(f"{folder}/documents.parquet/{i}.parquet", (1_000_000 + i, 1_000_000 + i))
    return folder


def equal(spark, folder, key):
    con = connect(SMALL)
    con.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    ok, note, rows = compare_frame(con, key, PLANS[key].build(Tables(spark, folder)))
    assert ok and rows, note


def test_words_end_at_letters_beyond_ascii(spark, folder):
    texts = ["Haus und äder x", "Haus und derü x", "Haus und der x", "Haus und ader x", "é4111111111111111 x", "4111111111111111é", "a4111111111111111"]
    landed(spark, folder, list(enumerate(texts)))
    equal(spark, folder, "c1_text_type")
    for key in ("c2_verified_type", "p7_first_match"):
        equal(spark, folder, key)


def test_the_least_id_stays_whichever_file_came_first(spark, folder):
    landed(spark, folder, [(5, "same"), (6, "other")], [(1, "same"), (2, "new"), (7, "other")])
    equal(spark, folder, "r5_idempotent_processing")


@pytest.mark.parametrize("line,reason", [
    ('{"k":1}', None), ('{"k":1} ', None), ('{"k":{"a":[1]},"k":2}', None), ('{"k":1} x', "invalid_json"), ('{"k":1}{', "invalid_json"), ('{"k":1}, 2', "invalid_json"),
    ("829 Inly", "invalid_json"), ("1] x", "invalid_json"), ("1} x", "invalid_json"), ("1, 2", "invalid_json"), ('1, "b": 2', "invalid_json"),
    ("{'k':1}", "invalid_json"), ("[1]", "non_object"), ('"a"', "non_object"), ("12", "non_object"), ("[1] [2]", "invalid_json")])
def test_nothing_follows_the_value_of_a_line(spark, line, reason):
    raw = spark.createDataFrame([(line,)], "line string")
    row = R.tag_lines(raw, "line", T.StructType([T.StructField("k", T.StringType())])).first()
    assert (row["reason"], row["line"]) == (reason, line if reason else None)
