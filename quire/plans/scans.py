"""S: scans and sources."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch
from ..sources import registers as R
from ..sources import tables as K
from .registry import Tables, plan

PROPS = T.StructType([T.StructField("k", T.IntegerType())])


@plan("s1_strict_scan", """
WITH raw AS (
  SELECT 'events' AS register, event_id AS id, props AS line FROM events
  UNION ALL SELECT 'documents', doc_id, text FROM documents)
SELECT register, id,
  CASE WHEN trim(line, E' \\t\\r\\n') = '' THEN 'blank_line' WHEN NOT json_valid(line) THEN 'invalid_json'
       WHEN json_type(line) <> 'OBJECT' THEN 'non_object' ELSE '' END AS reason,
  CASE WHEN json_valid(line) AND json_type(line) = 'OBJECT' THEN CAST(line ->> '$.k' AS INTEGER) END AS k
FROM raw""")
def s1(t: Tables):
    raw = t("events").select(F.lit("events").alias("register"), F.col("event_id").alias("id"), F.col("props").alias("line"))
    raw = raw.unionByName(
        t("documents").select(F.lit("documents").alias("register"), F.col("doc_id").alias("id"), F.col("text").alias("line")))
    tagged = R.tag_lines(raw, "line", PROPS, ["register", "id"])
    return tagged.select("register", "id", F.coalesce("reason", F.lit("")).alias("reason"), "k")


@plan("s2_union_registers", """
SELECT 'customer' AS register, c_custkey::VARCHAR AS party_id, c_name AS party_name, c_mktsegment AS segment FROM customer
UNION ALL SELECT 'supplier', s_suppkey::VARCHAR, s_name, NULL FROM supplier""")
def s2(t: Tables):
    aliases = {"party_id": ["c_custkey", "s_suppkey"], "party_name": ["c_name", "s_name"]}
    parts = {
        "customer": t("customer").select("c_custkey", "c_name", F.col("c_mktsegment").alias("segment")),
        "supplier": t("supplier").select("s_suppkey", "s_name"),
    }
    return R.union_registers(parts, aliases).select("register", "party_id", "party_name", "segment")


@plan("s3_manifest_scan", """
SELECT p_partkey::VARCHAR AS p_partkey, p_name, p_brand, p_size::VARCHAR AS p_size FROM part""")
def s3(t: Tables):
    fields = ["p_partkey", "p_name", "p_brand", "p_size"]
    path = scratch(t.spark, "manifest")
    K.write_manifest(t("part").select(*fields), path)
    version = K.current_version(t.spark, path)[1]
    return R.read_manifest(t.spark, f"{path}/{version}", fields)


@plan("s4_line_list", r"""
SELECT doc_id, trim(string_split(line, E'\t')[1]) AS entry
FROM (SELECT doc_id, trim(unnest(string_split(text, E'\n'))) AS line FROM documents)
WHERE line <> '' AND line NOT LIKE '#%'""")
def s4(t: Tables):
    return R.list_entries(t("documents").select("doc_id", F.explode(F.split("text", "\n")).alias("value")))


@plan("s6_first_by_url", """
SELECT min(page_id) AS page_id, trim(url) AS url FROM pages WHERE trim(url) <> '' GROUP BY trim(url)""")
def s6(t: Tables):
    return R.first_by_url(t("pages").select("page_id", "url"), "url", "page_id", "page_id")


@plan("s7_payload_rows", """
SELECT event_id // 100 AS batch, event_id, user_id, event_type, CAST(props ->> '$.k' AS INTEGER) AS k FROM events""")
def s7(t: Tables):
    """Payloads hold 100 rows each, the size an import chunk has."""
    event = F.struct("event_id", "user_id", "event_type", F.get_json_object("props", "$.k").alias("k"))
    payloads = t("events").groupBy(F.expr("event_id div 100").alias("batch")).agg(F.to_json(F.collect_list(event)).alias("payload"))
    fields = {"event_id": "bigint", "user_id": "bigint", "event_type": "string", "k": "int"}
    return R.payload_rows(payloads, "payload", fields, ["batch"])


@plan("s8_page_blocks", r"""
WITH b AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>')) AS block,
                  generate_subscripts(regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>'), 1) - 1 AS block_no FROM pages)
SELECT page_id, block_no::INTEGER AS block_no, regexp_extract(block, 'href="([^"]*)"', 1) AS link,
       regexp_extract(block, '>([^<]*)<', 1) AS title
FROM b""")
def s8(t: Tables):
    fields = {"link": 'href="([^"]*)"', "title": ">([^<]*)<"}
    return R.explode_blocks(t("pages"), "page_id", "html", '<a href="[^"]*">[^<]*</a>', fields)


@plan("s9_page_numbers", r"""
SELECT page_id, array_to_string(list_sort(list_distinct(list_transform(
         regexp_extract_all(html, '(?:ad|track\()\s*(\d+)', 1), lambda x: x::BIGINT))), ';') AS numbers
FROM pages""")
def s9(t: Tables):
    numbers = R.numbers_on_page(F.col("html"), r"(?:ad|track\()\s*(\d+)")
    return t("pages").select("page_id", F.array_join(F.transform(numbers, lambda n: n.cast("string")), ";").alias("numbers"))


@plan("s10_pages_of", r"""
SELECT doc_id, i::INTEGER AS page_no, coalesce(string_split(text, E'\n')[i], '') AS page_text
FROM (SELECT *, unnest(range(1, len(string_split(text, E'\n')) + 1)) AS i FROM documents)""")
def s10(t: Tables):
    """Each text's own number of lines is its page count, so that every line becomes a page."""
    return R.pages_of(t("documents"), "doc_id", "text", F.size(F.split("text", "\n")), "\n")
