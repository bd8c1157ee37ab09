"""Field extraction, ladders, ids and URLs on Arabic fixtures."""

import html
import uuid

import pytest
from pyspark.sql import functions as F

from quire.functions import fields as X
from quire.functions import ids, rules, urls
from quire.functions import patterns as P
from quire.functions.text import lines, normalise


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "v string").select(expr(F.col("v")).alias("r")).first()["r"]


PAGE = (
    "وزارة العدل\n12\nبيع عقار - فسخ العقد لظهور عيب - رد الثمن\nإلى المشتري مع الفوائد النظامية.\n"
    "رقم الصك: ٣٤١٢٣٤٥٦ تاريخه ١٤٣٤/٢/٥\nرقم الدعوى ٣٣٤٥٦\nالدائرة الثالثة بتاريخ ١٤٣٤/١/١\n"
    "نظرت المحكمة العامة بالرياض، في الدعوى"
)


def test_page_metadata(spark):
    df = spark.createDataFrame([(PAGE,)], "v string").select(normalise(F.col("v")).alias("t"), lines(F.col("v")).alias("l"))
    row = df.select(*[c.alias(n) for n, c in X.page_metadata(F.col("t"), F.col("l")).items()]).first()
    assert row["deed_number"] == "34123456"
    assert row["lawsuit_number"] == "33456"
    assert row["judgment_number"] is None
    assert row["decision_date"] == "1434/2/5"
    assert row["court"] == "المحكمة العامة بالرياض"
    assert row["circuit"] == "الدائرة الثالثة"
    assert row["subject"] == "بيع عقار - فسخ العقد لظهور عيب - رد الثمن إلى المشتري مع الفوائد النظامية."


def test_title_stops_and_caps(spark):
    def title_of(*rows):
        return spark.createDataFrame([(list(rows),)], "l array<string>").select(X.title(F.col("l"))).first()[0]

    head = "موضوع القضية - وصف قصير"
    assert title_of("لا شرطة في هذا السطر", head, "قصير") == head
    assert title_of(head, "سطر ثان مكمل للموضوع", "1. سند نظامي طويل جدا") == head + " سطر ثان مكمل للموضوع"
    assert title_of(head, "رقم الصك 12345 وما بعده") == head
    assert title_of("x - " * 200) is None
    assert len(title_of(*["موضوع طويل - " + "كلمة " * 60] * 6)) == 700
    assert title_of(*["لا شرطة في هذا السطر"] * 55, head) is None
    assert title_of() is None


def test_court_rejects_certification(spark):
    text = "قرار التصديق الصادر من محكمة الاستئناف بمكة " + "س " * 120 + "حكمت محكمة الاستئناف بجدة، حضوريا"
    assert one(spark, text, X.court) == "محكمة الاستئناف بجدة"
    assert one(spark, "صدق الحكم من محكمة الاستئناف بمكة", X.court) is None
    assert one(spark, "محكمة الاستئناف بمكة ثم المحكمة العامة بجدة رقم 5", X.court) == "المحكمة العامة بجدة"


def test_trust_gate(spark):
    trust = lambda c: X.trusted(c, P.TRUSTED_COURT, P.TRUSTED_COURT_REJECT)
    assert one(spark, "المحكمة العامة بالرياض", trust) == "المحكمة العامة بالرياض"
    assert one(spark, "محكمة الاستئناف على الحكم", trust) is None
    assert one(spark, "نص المحكمة العامة", trust) is None
    assert one(spark, "الدائرة الأولى", lambda c: X.trusted(c, P.TRUSTED_CIRCUIT)) == "الدائرة الأولى"


def test_header_kind_needs_word_and_number(spark):
    read = lambda t: one(spark, t, lambda c: rules.header_kind(c))
    assert tuple(read("تعميم إداري رقم التعميم 12/ت")) == ("circular", "12/")
    assert tuple(read("حكم قضائي رقم الحكم: 34567 ثم رقم الصك 999")) == ("judgment", "34567")
    assert read("رقم التعميم 12") is not None
    assert read("س" * 1900 + " قرار القرار 55") is None


def test_header_facts_carry_date_and_court(spark):
    read = lambda t: one(spark, t, rules.header_facts)
    page = "حكم قضائي\nالمحكمة العامة بالرياض\nرقم الحكم: 34567 بتاريخ 1434/05/12"
    assert tuple(read(page)) == ("judgment", "34567", "1434/05/12", "المحكمة العامة بالرياض")
    assert tuple(read("تعميم رقم التعميم 12/4")) == ("circular", "12/4", None, None)
    assert read("المحكمة العامة بتاريخ 1434/05/12") is None


@pytest.mark.parametrize("text,label", [
    ("تعميم رقم 123 للمحاكم", "تعميم"), ("تعميم قضائي", "تعميم"), ("رقم الصك 12345", "حكم قضائي"),
    ("هذا مبدأ قضائي", "مبدأ قضائي"), ("السوابق القضائية", "سابقة قضائية"), ("قرار رقم 555", "قرار"),
    ("اللائحة التنفيذية", "نظام أو لائحة"), ("دراسة مقارنة", "بحث قانوني"), ("نص آخر", "مرجع قانوني"),
])
def test_library_ladder(spark, text, label):
    assert one(spark, text, rules.library_type) == label


def test_other_ladders(spark):
    assert one(spark, "رقم الحكم 5", lambda c: rules.verified_type(F.lit("وثيقة قانونية"), c)) == "حكم قضائي"
    assert one(spark, "رقم الحكم 5", lambda c: rules.verified_type(F.lit("تعميم"), c)) == "تعميم"
    assert one(spark, "نظامية", lambda c: rules.verified_type(F.lit(""), c)) == "مرجع قانوني"
    assert one(spark, "حكم " * 20, rules.loose_text_type) == "حكم قضائي"
    assert one(spark, "حكم", rules.loose_text_type) is None
    assert one(spark, "Index-مبادئ.pdf", rules.file_name_type) == "فهرس/مدونة مرجعية غير مستقلة"
    assert one(spark, "مبادئ.pdf", rules.file_name_type) == "مبدأ قضائي مرشح غير متحقق"
    assert one(spark, "ملف تعميم", lambda c: rules.whole_file_type(c, F.lit("صك قضائي"))) == "deed"


def test_references_and_missing(spark):
    df = spark.createDataFrame([(3, "", "77", None)], "page int, deed string, judgment string, lawsuit string")
    row = df.select(
        X.reference(F.col("page"), F.col("deed"), F.col("judgment")).alias("r"),
        X.missing_fields({"deed": F.col("deed"), "judgment": F.col("judgment"), "lawsuit": F.col("lawsuit")}).alias("m"),
        ids.record_id(F.lit(None), F.lit(None), F.col("page"), F.lit("12/5")).alias("id"),
    ).first()
    assert (row["r"], row["m"], row["id"]) == ("77", ["deed", "lawsuit"], "collector-na-vna-p3-12-5")
    assert one(spark, "رقم القضية : ٥٥ / ب\nآخر", lambda c: X.labelled_value(c, "رقم القضية")) == "٥٥ / ب"
    assert one(spark, "a٣-5", ids.digits_only) == "٣5"


def test_stable_id_is_version_five(spark):
    values = [f"سجل-{i}" for i in range(300)]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = [r[0] for r in df.select(ids.stable_id(P.JUDGMENT_NAMESPACE, "document", F.col("v"))).collect()]
    assert got == [str(uuid.uuid5(uuid.UUID(P.JUDGMENT_NAMESPACE), f"document:{v}")) for v in values]


def test_urls(spark):
    caption = "انظر https://x.org/a https://www.moj.gov.sa/1) http://laws.moj.gov.sa/z https://x.org/a"
    found = one(spark, caption, urls.caption_urls)
    assert found == ["http://laws.moj.gov.sa/z", "https://www.moj.gov.sa/1)", "https://x.org/a"]
    assert one(spark, caption, lambda c: urls.first_official(urls.caption_urls(c))) == "http://laws.moj.gov.sa/z"
    assert one(spark, "https://u@Sub.MOJ.gov.sa.:443/x", urls.host_allowed) is True
    assert one(spark, "https://notmoj.gov.sa.evil.com/", urls.host_allowed) is False
    drive = "https://drive.google.com/open?id=abc&x=1"
    assert one(spark, drive, urls.canonical_url) == "https://drive.google.com/uc?export=download&id=abc"
    sheet = "https://docs.google.com/spreadsheets/d/k1/edit"
    assert one(spark, sheet, urls.canonical_url) == "https://docs.google.com/spreadsheets/d/k1/export?format=xlsx"
    assert one(spark, "judgments-1434-volume-11.pdf", urls.volume_of) == 11
    assert one(spark, "judgments-1434-volume-11.pdf", urls.year_of) == "1434"


def test_entities_like_the_standard(spark):
    for raw in ["a &amp; b &lt;i&gt; &quot;", "&amp;lt; &amp;amp;", "&#1593;&#x62F; &eacute;", "&copy 2020 &AMP; &am &Copy;", "x & y"]:
        assert one(spark, raw, urls.unescape) == html.unescape(raw)
    page = "<p>a<script>var t='</p>'</script>b<STYLE>x\n</STYLE>&copy;</p>"
    assert one(spark, page, lambda c: F.trim(urls.html_text(c))) == "a b ©"


def test_closed_entities_leave_the_others(spark):
    raws = ["a&amp To &amp; b&ampc &copy &copy;", "&amp;lt; &notit; &not; &#65; &#65 x&#x41;", "&am&amp; &amp;&amp"]
    wants = ["a&amp To & b&ampc &copy ©", "&lt; &notit; ¬ A &#65 xA", "&am& &&amp"]
    assert [one(spark, raw, urls.unescape_closed) for raw in raws] == wants
    assert one(spark, "<i>Of&amp</i> x", lambda c: urls.html_text(c, closed=True)) == " Of&amp  x"


def test_content_routes(spark):
    rows = [
        (b"\x00\x00%PDF-1.4", "", "https://h/x", "pdf"), (b"plain", "", "https://h/X.PDF?d=1", "pdf"),
        (b"\xff\xd8\xff\xe0", "", "https://h/x", "image"), (b"MM\x00*", "", "https://h/x", "image"),
        (b"PK\x03\x04..", "", "https://h/x", "zip_xml"), (b"x", "", "https://h/x.docx", "zip_xml"),
        (b"  <!DOCTYPE html>", "", "https://h/x", "html"), (b"x", "text/html; c", "https://h/x", "html"),
        (b"x,y", "text/csv", "https://h/x", "plain_text"), ("نص طويل ".encode() * 40, "", "https://h/x", "utf8_binary_text"),
        (b"\x00\x01", "application/octet-stream", "https://h/x", "unsupported_binary"),
        (b"\x12\x55\x04\x44\x6f\x80\xff", "", "https://h/x", "unsupported_binary"),
        ("نص طويل ".encode() * 40 + b"\xff\xfe", "", "https://h/x", "utf8_binary_text"),
    ]
    df = spark.createDataFrame([(bytearray(a), b, c, d) for a, b, c, d in rows], "content binary, kind string, url string, want string")
    got = df.select("want", urls.content_route(F.col("content"), F.col("kind"), F.col("url")).alias("got")).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]
