"""A: counts, completeness, collisions and run summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fields as X
from ..functions.text import sha256, text_hash
from ..operators import collisions, dedup, segment, summary
from .registry import Tables, plan, sql_norm

NORM = sql_norm("text")
HASHED = f"h AS (SELECT doc_id, lang, source, n_chars, sha256({NORM}) AS h FROM documents)"


def hashed(t: Tables, *more: str):
    return t("documents").select("doc_id", *more, text_hash(F.col("text"), "target").alias("h"))


@plan("a1_accepted_by_language", f"""
WITH {HASHED}, r AS (SELECT *, doc_id = min(doc_id) OVER (PARTITION BY h) AS first FROM h)
SELECT lang, count(*) FILTER (first) AS accepted, count(*) FILTER (NOT first) AS duplicates FROM r GROUP BY lang""")
def a1_flagship(t: Tables):
    """Normalise, hash, keep the first of equal texts, count by language.

    Counts per (hash, language) suffice: the language of a hash's first row gets the
    accepted record. The list of a hash is as short as the list of languages.
    """
    per_hash = hashed(t, "lang").groupBy("h", "lang").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"))
    by_hash = per_hash.groupBy("h").agg(
        F.min_by("lang", "first").alias("winner"), F.collect_list(F.struct("lang", "n")).alias("parts"))
    counted = by_hash.select("winner", F.inline("parts"))
    kept = F.when(F.col("lang") == F.col("winner"), 1).otherwise(0)
    return counted.groupBy("lang").agg(F.sum(kept).alias("accepted"), F.sum(F.col("n") - kept).alias("duplicates"))


@plan("a1_counts_by_type", "SELECT lang, source, count(*) AS records FROM documents GROUP BY ALL")
def a1(t: Tables):
    return summary.counts(t("documents"), "lang", "source")


@plan("a2_conditional_counts", """
SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS finished, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent,
  count(*) FILTER (o_orderstatus = 'F' AND o_orderpriority = '1-URGENT') AS both FROM orders""")
def a2(t: Tables):
    done, urgent = F.col("o_orderstatus") == "F", F.col("o_orderpriority") == "1-URGENT"
    return summary.run_summary(t("orders"), {
        "total": F.count(F.lit(1)), "finished": F.count_if(done), "urgent": F.count_if(urgent), "both": F.count_if(done & urgent)})


@plan("a3_completeness", """
WITH j AS (SELECT lang, source, text, quality, toxic FROM documents LEFT JOIN labels USING (doc_id))
SELECT 'lang' AS field, count(nullif(trim(lang), '')) AS filled, count(*) AS records FROM j
UNION ALL SELECT 'source', count(nullif(trim(source), '')), count(*) FROM j UNION ALL SELECT 'quality', count(quality), count(*) FROM j
UNION ALL SELECT 'toxic', count(toxic), count(*) FROM j""")
def a3(t: Tables):
    joined = t("documents").select("doc_id", "lang", "source").join(t("labels"), "doc_id", "left")
    return summary.completeness(joined, ["lang", "source", "quality", "toxic"])


@plan("a4_duplicate_counts", f"""
WITH {HASHED} SELECT count(*) AS records, count(DISTINCT h) AS distinct_keys, count(*) - count(DISTINCT h) AS duplicates FROM h""")
def a4(t: Tables):
    return summary.duplicate_counts(hashed(t), "h")


REFERENCES = """p AS (SELECT o_orderkey, 'o_custkey' AS kind, o_custkey::VARCHAR AS value FROM orders
  UNION ALL SELECT o_orderkey, 'cents', round(o_totalprice * 100)::BIGINT::VARCHAR FROM orders)"""


def _references(t: Tables):
    return t("orders").select("o_orderkey", "o_custkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))


@plan("a5_symmetric_collisions", f"""
WITH {REFERENCES}, g AS (SELECT *, count(*) OVER w AS members, min(o_orderkey) OVER w AS first_member FROM p WINDOW w AS (PARTITION BY kind, value))
SELECT * FROM g WHERE members > 1""")
def a5(t: Tables):
    return collisions.symmetric(_references(t), "o_orderkey", ["o_custkey", "cents"])


@plan("a5_collision_reasons", f"""
WITH {REFERENCES}, g AS (SELECT *, count(*) OVER (PARTITION BY kind, value) AS members FROM p)
SELECT o_orderkey, string_agg('reference_collision:' || kind, ';' ORDER BY kind) AS reasons FROM g WHERE members > 1 GROUP BY 1""")
def a5_reasons(t: Tables):
    members = collisions.symmetric(_references(t), "o_orderkey", ["o_custkey", "cents"])
    return collisions.collision_reasons(members, "o_orderkey").select("o_orderkey", F.array_join("reasons", ";").alias("reasons"))


TITLED = r"""d AS (SELECT doc_id, regexp_extract(text, '^\S+', 0) AS title, sha256(text) AS h FROM documents),
k AS (SELECT *, replace(lower(title), 'ß', 'ss') AS tk FROM d WHERE title <> '')"""


def _titled(t: Tables):
    return t("documents").select("doc_id", F.regexp_extract("text", r"^\S+", 0).alias("title"), sha256(F.col("text")).alias("h"))


@plan("a6_title_groups", f"""
WITH {TITLED}
SELECT 'title-collision-' || substr(sha256(tk), 1, 20) AS review_id, sha256(tk) AS normalized_title_sha256, arg_min(title, doc_id) AS title_as_first_seen,
  min(doc_id) AS first_candidate, max(doc_id) AS last_candidate, count(*) AS candidate_count, count(DISTINCT h) AS distinct_text_checksums,
  count(DISTINCT h) = 1 AS exact_text_duplicate
FROM k GROUP BY tk HAVING count(*) > 1""")
def a6(t: Tables):
    """Titles are the first word of each text, so that titles do collide."""
    return collisions.title_groups(_titled(t), "doc_id", "doc_id", "title", "h")


@plan("a6_title_members", f"""
WITH {TITLED}, g AS (SELECT *, count(*) OVER (PARTITION BY tk) AS n FROM k)
SELECT 'title-collision-' || substr(sha256(tk), 1, 20) AS review_id, doc_id FROM g WHERE n > 1""")
def a6_members(t: Tables):
    return collisions.title_members(_titled(t).drop("h"), "doc_id", "title")


@plan("a7_source_rollup", """
SELECT source, count(*) AS affected_records, string_agg(DISTINCT lang, ';' ORDER BY lang) AS kinds FROM documents GROUP BY source""")
def a7(t: Tables):
    rolled = summary.source_rollup(t("documents"), "source", "lang")
    return rolled.select("source", "affected_records", F.array_join("kinds", ";").alias("kinds"))


@plan("a8_group_equals", """
SELECT l_orderkey, count(*) AS records, list_sort(list(DISTINCT l_linestatus)) = ['O'] AS set_equal FROM lineitem GROUP BY 1""")
def a8(t: Tables):
    return summary.group_equals(t("lineitem"), "l_orderkey", "l_linestatus", F.lit("O"))


@plan("a9_batch_accounting", f"""
WITH {HASHED}, o AS (SELECT CASE WHEN n_chars < 100 THEN 'rejected' WHEN doc_id <> min(doc_id) OVER (PARTITION BY h) THEN 'duplicate'
  WHEN quality IS NULL THEN 'review' WHEN toxic = 1 THEN 'failed' ELSE 'imported' END AS s FROM h LEFT JOIN labels USING (doc_id))
SELECT count(*) AS documents_detected, count(*) FILTER (s = 'imported') AS documents_imported, count(*) FILTER (s = 'duplicate') AS duplicates_count,
  count(*) FILTER (s = 'review') AS review_count, count(*) FILTER (s = 'rejected') AS rejected_count, count(*) FILTER (s = 'failed') AS failed_count,
  count(*) FILTER (s = 'imported') <= count(*) AS consistent FROM o""")
def a9(t: Tables):
    docs = dedup.first_wins(hashed(t), "h", "doc_id", "doc_id")
    docs = docs.join(t("documents").select("doc_id", "n_chars"), "doc_id").join(t("labels"), "doc_id", "left")
    outcome = (
        F.when(F.col("n_chars") < 100, "rejected").when(~F.col("is_first"), "duplicate")
        .when(F.col("quality").isNull(), "review").when(F.col("toxic") == 1, "failed").otherwise("imported")
    )
    return summary.accounting(docs.select(outcome.alias("s")), "s")


@plan("a10_batch_manifest", """
WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS n,
  strlen('{"o_orderkey":' || o_orderkey || ',"o_custkey":' || o_custkey || ',"o_orderstatus":"' || o_orderstatus || '"}') AS b FROM orders)
SELECT (n - 1) // 100 + 1 AS batch, count(*) AS records, min(o_orderkey) AS first_id, max(o_orderkey) AS last_id, sum(b)::BIGINT AS bytes FROM r GROUP BY 1""")
def a10(t: Tables):
    rows = t("orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return summary.batch_manifest(rows, "o_orderkey", "o_orderkey", 100)


@plan("a11_reason_tally", """
WITH j AS (SELECT quality, toxic, n_chars FROM documents LEFT JOIN labels USING (doc_id))
SELECT * FROM (SELECT 'quality' AS reason, count(*) FILTER (quality IS NULL) AS records FROM j UNION ALL
  SELECT 'toxic', count(*) FILTER (toxic IS NULL) FROM j UNION ALL SELECT 'short_text', count(*) FILTER (n_chars < 200) FROM j) WHERE records > 0""")
def a11(t: Tables):
    both = t("documents").select("doc_id", "n_chars").join(t("labels"), "doc_id", "left")
    reasons = X.add_reasons(X.missing_fields({"quality": F.col("quality"), "toxic": F.col("toxic")}),
                            F.when(F.col("n_chars") < 200, "short_text"))
    return summary.reason_tally(both.select(reasons.alias("r")), "r")


@plan("a12_run_summary", f"""
WITH {HASHED}, g AS (SELECT h, count(*) AS n, sum(n_chars) AS c, count(*) FILTER (n_chars < 200) AS s FROM h GROUP BY h)
SELECT sum(n)::BIGINT AS examined, count(*) AS independent, sum(n - 1)::BIGINT AS exact_duplicates_excluded, sum(s)::BIGINT AS short_texts,
  sum(c)::BIGINT AS characters, false AS platform_import_modified FROM g""")
def a12(t: Tables):
    per_hash = hashed(t, "n_chars").groupBy("h").agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("c"), F.count_if(F.col("n_chars") < 200).alias("s"))
    return summary.run_summary(per_hash, {
        "examined": F.sum("n"), "independent": F.count(F.lit(1)), "exact_duplicates_excluded": F.sum(F.col("n") - 1),
        "short_texts": F.sum("s"), "characters": F.sum("c"), "platform_import_modified": F.lit(False)})


@plan("a12_counter_map", """
SELECT string_agg(lang || '=' || n, ';' ORDER BY lang) AS counters FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang)""")
def a12_map(t: Tables):
    counters = summary.counter_map(t("documents"), "lang")
    entry = F.transform(F.map_entries("counters"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return counters.select(F.array_join(entry, ";").alias("counters"))


@plan("a13_processing_log", rf"""
WITH p AS (SELECT conv_id, turn + 1 AS page_no, length({NORM}) >= 120 AND contains({NORM}, ' the ') AS ok, role FROM conversations),
s AS (SELECT conv_id, count(*) AS pages, count(*) FILTER (ok) AS detected_boundaries, count(*) FILTER (ok AND role = 'assistant') AS indexed FROM p GROUP BY 1)
SELECT conv_id, pages, detected_boundaries, indexed, CASE WHEN detected_boundaries = 0 THEN 'needs_review' ELSE 'indexed' END AS status,
  CASE WHEN detected_boundaries = 0 THEN 'no_verified_case_boundaries_detected' WHEN indexed = detected_boundaries THEN 'case_pdfs_created'
       ELSE 'case_pdfs_created_with_metadata_review_required' END AS notes FROM s""")
def a13(t: Tables):
    from ..functions.text import normalise

    pages = t("conversations").select("conv_id", "role", normalise(F.col("text"), "target").alias("x"))
    found = (F.length("x") >= 120) & F.col("x").contains(" the ")
    return segment.processing_log(pages.select("conv_id", found.alias("ok"), (found & (F.col("role") == "assistant")).alias("full")),
                                  "conv_id", "ok", "full")
