"""Normaliser profiles, glyph repair, hashes and lines."""

import hashlib
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from quire.functions import patterns as P
from quire.functions import text as X


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "v string").select(expr(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize("profile,expected", [
    ("collector", "كتاب رقم 123 456 المحكمة"),
    ("deposit", "كتاب رقم 123 456 المحكمة"),
    ("target", "كتا ب رقم 123 456 المحكمة ﻿"),
    ("library", "كتاب رقم 123 ۴۵۶ المحكمة"),
])
def test_profiles_differ(spark, profile, expected):
    raw = "كتاـب رَقمٌ  ١٢٣‏ ۴۵۶\n المحكمة ﻿"
    assert one(spark, raw, lambda c: X.normalise(c, profile)) == expected


def test_import_profile_is_the_target_profile():
    assert X.PROFILES["import"] == X.PROFILES["target"]


def test_composition_only_where_needed(spark):
    raw = "ﻻ ﬁ é آ ①"
    assert one(spark, raw, X.compose) == unicodedata.normalize("NFKC", raw)
    assert one(spark, None, lambda c: X.normalise(c)) == ""


def test_stable_ranges_never_change():
    ranges = re.compile(f"[{X.STABLE}]")
    second = set()
    for point in range(0x110000):
        parts = unicodedata.decomposition(chr(point)).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            second.add(chr(int(parts[1], 16)))
    for point in [*range(0xD800), *range(0xE000, 0x110000)]:
        ch = chr(point)
        if ranges.match(ch):
            assert unicodedata.normalize("NFKC", ch) == ch
            assert unicodedata.combining(ch) == 0
            assert ch not in second
    assert not ranges.search("ᅡᆨ")


def test_plain_texts_need_only_the_collapse(spark):
    plain = "".join(chr(c) for c in [*range(0x80), *range(0xC0, 0x100)])
    assert unicodedata.normalize("NFKC", plain) == plain
    raw = "Été\t\x1c  a \x0b b\r\n"
    for profile in X.PROFILES:
        assert one(spark, raw, lambda c, p=profile: X.normalise(c, p)) == re.sub(r"\s+", " ", raw).strip()


def test_white_space_equals_the_unicode_class(spark):
    points = [p for p in range(0x3100) if re.match(r"\s", chr(p))]
    for p in points:
        assert one(spark, f"a{chr(p)}{chr(p)}b", X.collapse) == "a b", hex(p)
    assert one(spark, "a​b", X.collapse) == "a​b"


def scan_repair(text):
    """Letter-by-letter statement of the article rule, for comparison."""
    def letter(ch):
        return "ء" <= ch <= "غ" or "ف" <= ch <= "ي"

    out, i = list(text), 0
    while i + 3 < len(out):
        swapped = out[i] == "ا" and out[i + 1] in "حجخمأ" and out[i + 2] == "ل" and letter(out[i + 3])
        start = i == 0 or not letter(out[i - 1])
        attached = i > 0 and out[i - 1] in "وفبك" and (i == 1 or not letter(out[i - 2]))
        if swapped and (start or attached):
            out[i + 1], out[i + 2] = out[i + 2], out[i + 1]
            i += 3
        else:
            i += 1
    return "".join(out)


def test_glyph_order_repair(spark):
    assert one(spark, "احملكمة واحلكم اهلل سامحلت", X.repair_glyph_order) == "المحكمة والحكم الله سامحلت"
    import random

    rng = random.Random(7)
    words = ["".join(rng.choice("احمجخأل وفبكت") for _ in range(12)) for _ in range(3000)]
    df = spark.createDataFrame([(w,) for w in words], "v string")
    got = [r[0] for r in df.select(F.regexp_replace("v", P.ARTICLE_SWAP, "ال$1")).collect()]
    assert got == [scan_repair(w) for w in words]


def test_hash_and_lines(spark):
    raw = "a  b\fc\x1d  \r\n d"
    assert one(spark, raw, lambda c: X.text_hash(c, "deposit")) == hashlib.sha256("a b c d".encode()).hexdigest()
    assert one(spark, raw, lambda c: X.lines(c, "deposit")) == [x.strip().replace("  ", " ") for x in raw.splitlines() if x.strip()]


def test_full_case_folding(spark):
    for word in ["STRASSE straße", "İstanbul", "ΣΑΣ", "plain ASCII"]:
        assert one(spark, word, X.fold_case) == word.casefold()
