"""The kept index against a search through all texts."""

import random

from pyspark.sql import functions as F

from quire.operators import search as S

WORDS = ["court", "deed", "land", "اسم", "Straße", "42"]


def documents(spark, rows):
    return spark.createDataFrame(rows, "id long, title string, text string")


def make(rng, first, n):
    return [(first + i, rng.choice(["Court", None, ""]), " the " + " ".join(rng.sample(WORDS, rng.randrange(0, 5)))) for i in range(n)]


def holding(rows, words):
    return {i for i, title, text in rows if {w.lower() for w in words} <= {t.lower() for t in f"{title or ''} {text or ''}".split()}}


def test_search_equals_a_scan_over_several_batches(spark, folder):
    rng = random.Random(3)
    index = S.Postings(spark, folder, "id", buckets=8, salts=3)
    assert index.search(["the"]) is None
    rows = []
    for batch in range(3):
        new = make(rng, batch * 100, 60)
        rows += new
        index.add(documents(spark, new + new[:5]), ["title", "text"], batch)
    index.add(documents(spark, rows[-60:]), ["title", "text"], 2)
    index.add(documents(spark, [(900, None, None), (901, "", " .,")]), ["title", "text"], 3)
    index.add(documents(spark, []), ["title", "text"], 4)
    for words in (["THE"], ["deed", "Land"], ["court", "the", "اسم"], ["straße", "42"], ["the", "the"]):
        found = index.search(words).collect()
        assert {r["id"] for r in found} == holding(rows, words) and len(found) == len({r["id"] for r in found})
    assert index.search(["the", "nowhere"]) is None and index.search([]) is None
    assert index.frequencies(["the", "deed"]) == {"the": 180, "deed": len(holding(rows, ["deed"]))}


def test_a_search_opens_one_bucket_a_word(spark, folder):
    index = S.Postings(spark, folder, "id", buckets=64, salts=1)
    index.add(spark.range(500).select("id", F.concat(F.lit("all w"), F.col("id") % 90, F.lit(" x"), F.col("id") % 7).alias("text")), ["text"], 0)
    found = index.search(["all", "w17", "x3"])
    assert len(found.inputFiles()) <= 3 * 8 and all("/postings/" in f for f in found.inputFiles())
    assert len({f.split("bucket=")[1].split("/")[0] for f in found.inputFiles()}) <= 3
    assert {r["id"] for r in found.collect()} == {i for i in range(500) if i % 90 == 17 and i % 7 == 3}
