"""V: validation suites."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import normalise, sha256, text_hash
from ..operators import validate as V
from ..operators.dedup import first_wins
from ..operators.reconcile import known
from .joins import AUDIT, audit_of
from .registry import Tables, plan, sql_norm

NORM = sql_norm("text")
LINE = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)"


def _line(t: Tables):
    return t("lineitem").withColumn("id", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))


@plan("v1_required_fields", """
WITH j AS (SELECT doc_id, lang, quality, toxic FROM documents LEFT JOIN labels USING (doc_id))
SELECT 'missing_' || f AS rule, 'error' AS severity, doc_id::VARCHAR AS id, f AS detail FROM (
  SELECT doc_id, 'quality' AS f FROM j WHERE quality IS NULL AND lang = 'en' UNION ALL SELECT doc_id, 'toxic' FROM j WHERE toxic IS NULL AND lang = 'en'
  UNION ALL SELECT doc_id, 'lang' FROM j WHERE trim(coalesce(lang, '')) = '' AND lang = 'en')""")
def v1(t: Tables):
    joined = t("documents").select("doc_id", "lang").join(t("labels"), "doc_id", "left")
    needed = V.required({c: F.col(c) for c in ("quality", "toxic", "lang")}, when=F.col("lang") == "en")
    return V.row_rules(joined, "doc_id", needed)


@plan("v2_enum_domain", """
SELECT 'unrecognized_status' AS rule, 'warning' AS severity, o_orderkey::VARCHAR AS id, o_orderstatus AS detail FROM orders WHERE o_orderstatus NOT IN ('F', 'O')""")
def v2(t: Tables):
    return V.row_rules(t("orders"), "o_orderkey", [V.domain("unrecognized_status", F.col("o_orderstatus"), ["F", "O"])])


@plan("v3_format", """
WITH h AS (SELECT doc_id, CASE WHEN lang = 'de' THEN upper(sha256(text)) WHEN lang = 'es' THEN substr(sha256(text), 1, 63) ELSE sha256(text) END AS h FROM documents)
SELECT 'invalid_checksum' AS rule, 'error' AS severity, doc_id::VARCHAR AS id, h AS detail FROM h WHERE NOT regexp_full_match(h, '[0-9a-f]{64}')""")
def v3(t: Tables):
    digest = sha256(F.col("text"))
    stored = F.when(F.col("lang") == "de", F.upper(digest)).when(F.col("lang") == "es", F.substring(digest, 1, 63)).otherwise(digest)
    docs = t("documents").select("doc_id", stored.alias("h"))
    return V.row_rules(docs, "doc_id", [V.pattern("invalid_checksum", F.col("h"), V.HEX64)])


@plan("v4_page_range", f"""
WITH l AS (SELECT {LINE} AS id, CASE WHEN l_returnflag = 'A' AND l_quantity < 5 THEN NULL ELSE l_linenumber END AS s, (l_quantity / 8)::DECIMAL(9,2)::INT AS e FROM lineitem)
SELECT 'page_range' AS rule, 'error' AS severity, id, concat_ws('-', s, e) AS detail FROM l
WHERE (s IS NULL) <> (e IS NULL) OR coalesce(s < 1, false) OR coalesce(e < s, false) OR coalesce(e > 6, false)""")
def v4(t: Tables):
    start = F.when(~((F.col("l_returnflag") == "A") & (F.col("l_quantity") < 5)), F.col("l_linenumber"))
    end = F.round((F.col("l_quantity") / 8).cast("decimal(9,2)")).cast("int")
    rows = _line(t).select("id", start.alias("s"), end.alias("e"))
    return V.row_rules(rows, "id", [V.page_range(F.col("s"), F.col("e"), F.lit(6))])


@plan("v5_unique_keys", """
SELECT 'duplicate_line' AS rule, 'error' AS severity, l_orderkey || '|' || l_linenumber AS id, count(*)::VARCHAR AS detail
FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""")
def v5(t: Tables):
    return V.unique(t("lineitem"), ["l_orderkey", "l_linenumber"], "duplicate_line")


@plan("v6_orphans_and_edges", """
WITH o AS (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P'), e AS (SELECT l_partkey AS a, l_suppkey AS b, l_returnflag AS k FROM lineitem)
SELECT 'orphan_order' AS rule, 'error' AS severity, l_orderkey::VARCHAR AS id, count(*)::VARCHAR AS detail FROM lineitem ANTI JOIN o ON l_orderkey = o_orderkey GROUP BY l_orderkey
UNION ALL SELECT 'self_edge', 'error', a::VARCHAR, k FROM e WHERE a = b
UNION ALL SELECT 'repeated_edge', 'error', concat_ws('|', a, b, k), count(*)::VARCHAR FROM e GROUP BY a, b, k HAVING count(*) > 1""")
def v6(t: Tables):
    parents = t("orders").filter(F.col("o_orderstatus") != "P")
    edges = t("lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), F.col("l_returnflag").alias("k"))
    return V.all_of(V.orphans(t("lineitem"), "l_orderkey", parents, "o_orderkey", "orphan_order"), V.edge_rules(edges, "a", "b", "k"))


@plan("v7_cardinality", """
SELECT 'orders_have_lines' AS "check", (SELECT count(*) FROM orders) AS left_rows, (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS right_rows,
  (SELECT count(*) FROM orders) = (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS valid
UNION ALL SELECT 'documents_split', (SELECT count(*) FROM documents), (SELECT count(*) FROM documents), true""")
def v7(t: Tables):
    docs = t("documents")
    halves = docs.filter(F.col("n_chars") < 1000).unionByName(docs.filter(F.col("n_chars") >= 1000))
    return V.all_of(
        V.equal_counts("orders_have_lines", t("orders"), t("lineitem").select("l_orderkey").distinct()),
        V.equal_counts("documents_split", docs, halves))


@plan("v8_policy_gate", """
SELECT 'must_not_be_eligible' AS rule, 'error' AS severity, doc_id::VARCHAR AS id, quality::VARCHAR AS detail FROM labels WHERE toxic = 1 AND quality = 1""")
def v8(t: Tables):
    rule = V.Rule("must_not_be_eligible", (F.col("toxic") == 1) & (F.col("quality") == 1), F.col("quality"))
    return V.row_rules(t("labels"), "doc_id", [rule])


@plan("v9_stored_hashes", """
WITH r AS (SELECT doc_id, CASE WHEN source = 'src3' THEN sha256(text || ' ') ELSE sha256(text) END AS h, length(text) + CASE WHEN source = 'src4' THEN 1 ELSE 0 END AS n FROM documents)
SELECT 'hash_mismatch' AS rule, 'error' AS severity, doc_id::VARCHAR AS id, 'sha256' AS detail FROM documents JOIN r USING (doc_id) WHERE sha256(text) <> r.h
UNION ALL SELECT 'size_mismatch', 'error', doc_id::VARCHAR, 'bytes' FROM documents JOIN r USING (doc_id) WHERE length(text) <> r.n""")
def v9(t: Tables):
    docs, digest = t("documents"), sha256(F.col("text"))
    register = docs.select(
        "doc_id", F.when(F.col("source") == "src3", sha256(F.concat("text", F.lit(" ")))).otherwise(digest).alias("h"),
        (F.length("text") + F.when(F.col("source") == "src4", 1).otherwise(0)).alias("n"))
    stored = docs.select("doc_id", digest.alias("sh"), F.length("text").alias("sn"))
    return V.row_rules(stored.join(register, "doc_id"), "doc_id", [
        V.Rule("hash_mismatch", F.col("sh") != F.col("h"), F.lit("sha256")),
        V.Rule("size_mismatch", F.col("sn") != F.col("n"), F.lit("bytes"))])


@plan("v10_registered_duplicates", f"""
WITH h AS (SELECT doc_id, lang, min(doc_id) OVER (PARTITION BY sha256({NORM})) AS c FROM documents)
SELECT 'unregistered_duplicate' AS rule, 'error' AS severity, doc_id::VARCHAR AS id, c::VARCHAR AS detail FROM h WHERE doc_id <> c AND lang <> 'en'""")
def v10(t: Tables):
    """The register of known duplicates lacks every text that is not English."""
    docs = t("documents").select("doc_id", text_hash(F.col("text"), "target").alias("h"))
    pairs = first_wins(docs, "h", "doc_id", "doc_id").filter(~F.col("is_first")).select("doc_id", "canonical_id")
    register = t("documents").filter(F.col("lang") == "en").select("doc_id")
    flagged = pairs.join(register.withColumn("known", F.lit(True)), "doc_id", "left")
    return V.row_rules(flagged, "doc_id", [V.Rule("unregistered_duplicate", F.col("known").isNull(), F.col("canonical_id"))])


@plan("v11_conditional_rules", """
SELECT 'urgent_without_price' AS rule, 'warning' AS severity, o_orderkey::VARCHAR AS id, o_orderpriority AS detail FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice < 20000
UNION ALL SELECT 'finished_too_low', 'error', o_orderkey::VARCHAR, o_orderstatus FROM orders WHERE o_orderstatus = 'F' AND NOT (o_totalprice >= 5000)
UNION ALL SELECT 'low_priority_pending', 'error', o_orderkey::VARCHAR, o_orderpriority FROM orders WHERE o_orderpriority = '5-LOW' AND o_orderstatus = 'P'""")
def v11(t: Tables):
    priority, status, price = F.col("o_orderpriority"), F.col("o_orderstatus"), F.col("o_totalprice")
    return V.row_rules(t("orders"), "o_orderkey", [
        V.implies("urgent_without_price", priority == "1-URGENT", price >= 20000, priority, "warning"),
        V.implies("finished_too_low", status == "F", price >= 5000, status),
        V.implies("low_priority_pending", priority == "5-LOW", status != "P", priority)])


@plan("v12_recompute", f"""
SELECT 'hash_not_recomputable' AS rule, 'error' AS severity, doc_id::VARCHAR AS id, lang AS detail FROM documents WHERE sha256(text) <> sha256({NORM})
UNION ALL SELECT 'length_differs', 'error', doc_id::VARCHAR, n_chars::VARCHAR FROM documents WHERE n_chars <> length(text)
UNION ALL SELECT 'empty_text', 'error', doc_id::VARCHAR, lang FROM documents WHERE {NORM} = ''""")
def v12(t: Tables):
    docs = t("documents").select("doc_id", "lang", "n_chars", "text", normalise(F.col("text"), "target").alias("t"))
    return V.row_rules(docs, "doc_id", [
        V.Rule("hash_not_recomputable", sha256(F.col("text")) != sha256(F.col("t")), F.col("lang")),
        V.Rule("length_differs", F.col("n_chars") != F.length("text"), F.col("n_chars")),
        V.Rule("empty_text", F.col("t") == "", F.col("lang"))])


@plan("v13_class_counts", """
WITH e AS (SELECT * FROM (VALUES ('F', 500), ('O', 5000), ('X', 1)) AS v(o_orderstatus, expected)), a AS (SELECT o_orderstatus, count(*) AS actual FROM orders GROUP BY 1)
SELECT o_orderstatus, coalesce(actual, 0) AS actual, coalesce(expected, 0)::BIGINT AS expected, coalesce(actual = expected, false) AS equal FROM a FULL JOIN e USING (o_orderstatus)""")
def v13(t: Tables):
    return V.class_counts(t("orders"), "o_orderstatus", [("F", 500), ("O", 5000), ("X", 1)])


@plan("v14_audit_rules", f"""
WITH {AUDIT}
SELECT 'unchanged_hash' AS rule, 'error' AS severity, c_custkey::VARCHAR AS id, old_h AS detail FROM audit WHERE old_h = new_h
UNION ALL SELECT 'repeated_id', 'error', c_custkey::VARCHAR, count(*)::VARCHAR FROM audit GROUP BY c_custkey HAVING count(*) > 1
UNION ALL SELECT 'repeated_new_hash', 'error', new_h, count(*)::VARCHAR FROM audit GROUP BY new_h HAVING count(*) > 1""")
def v14(t: Tables):
    audit = audit_of(t)
    needed = V.required({c: F.col(c) for c in ("c_custkey", "old_h", "new_h")})
    return V.all_of(
        V.row_rules(audit, "c_custkey", [*needed, V.Rule("unchanged_hash", F.col("old_h") == F.col("new_h"), F.col("old_h"))]),
        V.unique(audit, ["c_custkey"], "repeated_id"), V.unique(audit, ["new_h"], "repeated_new_hash"))


@plan("v15_implication", """
SELECT 'download_block' AS rule, 'error' AS severity, o_orderkey::VARCHAR AS id, CASE WHEN o_orderpriority = '5-LOW' THEN 'low' END AS detail
FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '5-LOW'""")
def v15(t: Tables):
    reason = F.when(F.col("o_orderpriority") == "5-LOW", "low")
    return V.row_rules(t("orders"), "o_orderkey", [V.implies("download_block", F.col("o_orderstatus") == "F", reason.isNull(), reason)])


@plan("v16_declared_missing", """
WITH f AS (SELECT DISTINCT p_name FROM part WHERE p_brand IN ('Brand#7', 'Brand#9')), q AS (SELECT p_partkey, p_name FROM part WHERE p_type = 'PROMO')
SELECT 'source_exists' AS rule, 'error' AS severity, p_partkey::VARCHAR AS id, p_name AS detail FROM q WHERE p_name IN (SELECT p_name FROM f)""")
def v16(t: Tables):
    files = t("part").filter(F.col("p_brand").isin("Brand#7", "Brand#9")).select("p_name")
    quarantined = t("part").filter(F.col("p_type") == "PROMO").select("p_partkey", "p_name")
    flagged = known(quarantined, files, "p_name", "p_partkey", "exists")
    return V.row_rules(flagged, "p_partkey", [V.Rule("source_exists", F.col("exists"), F.col("p_name"))])


@plan("v_report", """
SELECT count(*) FILTER (o_totalprice < 5000) AS errors, count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) AS warnings,
  count(*) FILTER (o_totalprice < 5000) + count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) AS findings, count(*) FILTER (o_totalprice < 5000) = 0 AS valid FROM orders""")
def v_report(t: Tables):
    rules = [V.Rule("price_low", F.col("o_totalprice") < 5000, F.col("o_orderstatus")),
             V.domain("unrecognized_status", F.col("o_orderstatus"), ["F", "O"])]
    return V.report(V.row_rules(t("orders"), "o_orderkey", rules))
