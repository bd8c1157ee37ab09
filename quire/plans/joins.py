"""J: reconciliation joins.

Second registers are derived from the given tables by natural attributes, so that
both sides differ in known ways and grow together.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.ids import digits_only
from ..functions.text import sha256, text_hash
from ..operators import collisions, reconcile
from .registry import Tables, plan, sql_norm

NORM = sql_norm("text")


@plan("j1_known_keys", f"""
WITH b AS (SELECT DISTINCT sha256({NORM}) AS h FROM benchmark), d AS (SELECT doc_id, sha256({NORM}) AS h FROM documents)
SELECT doc_id, h IN (SELECT h FROM b) AS is_known FROM d""")
def j1(t: Tables):
    docs = t("documents").select("doc_id", text_hash(F.col("text"), "target").alias("h"))
    held = t("benchmark").select(text_hash(F.col("text"), "target").alias("h"))
    return reconcile.known(docs, held, "h", "doc_id").select("doc_id", "is_known")


LINE_ID = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate::DATE, round(l_extendedprice * 100)::BIGINT)"


@plan("j2_exact_copies", f"""
WITH r AS (SELECT {LINE_ID} AS id, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag FROM lineitem),
c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, count(*) AS n, min(id) AS m FROM r WHERE l_returnflag <> 'R'
      GROUP BY ALL)
SELECT r.id, CASE WHEN n IS NULL THEN 'kept' WHEN n = 1 THEN 'exact_duplicate' ELSE 'ambiguous_error' END AS disposition,
  coalesce(n, 0) AS matches, m AS current_id
FROM r LEFT JOIN c USING (l_orderkey, l_linenumber, l_partkey, l_suppkey)""")
def j2(t: Tables):
    ident = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                        F.to_date("l_shipdate").cast("string"), F.round(F.col("l_extendedprice") * 100).cast("long"))
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    recovered = t("lineitem").select(ident.alias("id"), *keys, "l_returnflag")
    current = recovered.filter(F.col("l_returnflag") != "R")
    joined = reconcile.exact_copies(recovered.drop("l_returnflag"), current.drop("l_returnflag"), keys, "id")
    return joined.select("id", "disposition", "matches", "current_id")


@plan("j3_waterfall", r"""
WITH c AS (SELECT c_custkey, regexp_replace(c_name, '[^\p{Nd}]', '', 'g') AS d, c_mktsegment FROM customer),
byname AS (SELECT d, count(*) AS n, min((c_custkey, c_mktsegment)) AS hit FROM c WHERE c_mktsegment <> 'FURNITURE' GROUP BY d),
bynation AS (SELECT c_nationkey::VARCHAR AS d, count(*) AS n, min((c_custkey, c_mktsegment)) AS hit FROM customer WHERE c_mktsegment = 'FURNITURE' AND c_acctbal < 0 GROUP BY 1),
o AS (SELECT o_orderkey, lpad(o_custkey::VARCHAR, 9, '0') AS j, substr(lpad(o_custkey::VARCHAR, 9, '0'), 8, 2)::INT::VARCHAR AS k FROM orders)
SELECT o_orderkey, coalesce(a.n, b.n, 0) AS match_count, CASE WHEN a.n IS NOT NULL THEN 'name_digits' WHEN b.n IS NOT NULL THEN 'nation' ELSE '' END AS match_method,
  CASE WHEN coalesce(a.n, b.n) = 1 THEN coalesce(a.hit[1], b.hit[1]) END AS c_custkey,
  CASE WHEN coalesce(a.n, b.n, 0) = 0 THEN 'not_found_in_current_official_archive' WHEN coalesce(a.n, b.n) > 1 THEN 'ambiguous_match'
       WHEN coalesce(a.hit[2], b.hit[2]) = 'HOUSEHOLD' THEN 'matched_missing_source_url' ELSE 'matched_official_archive' END AS resolution_status
FROM o LEFT JOIN byname a ON a.d = o.j LEFT JOIN bynation b ON b.d = o.k""")
def j3(t: Tables):
    """Name digits first, then the trailing two digits against a coarser key."""
    customers = t("customer")
    named = customers.filter(F.col("c_mktsegment") != "FURNITURE").select(
        digits_only(F.col("c_name")).alias("j"), "c_custkey", "c_mktsegment")
    by_nation = customers.filter((F.col("c_mktsegment") == "FURNITURE") & (F.col("c_acctbal") < 0)).select(
        F.col("c_nationkey").cast("string").alias("k"), "c_custkey", "c_mktsegment")
    padded = F.lpad(F.col("o_custkey").cast("string"), 9, "0")
    orders = t("orders").select("o_orderkey", padded.alias("j"), F.substring(padded, 8, 2).cast("int").cast("string").alias("k"))
    steps = [("name_digits", "j", named), ("nation", "k", by_nation)]
    found = reconcile.waterfall(orders, "o_orderkey", steps, ["c_custkey", "c_mktsegment"])
    status = (
        F.when(F.col("match_count") == 0, "not_found_in_current_official_archive")
        .when(F.col("match_count") > 1, "ambiguous_match")
        .when(F.col("c_mktsegment") == "HOUSEHOLD", "matched_missing_source_url").otherwise("matched_official_archive")
    )
    return found.select("o_orderkey", "match_count", "match_method", "c_custkey", status.alias("resolution_status"))


PHYSICAL = """physical AS (SELECT p_name || p_partkey // 2 AS name, sha256(p_name || CASE WHEN p_type = 'SMALL' THEN 'changed' ELSE p_brand END) AS h
  FROM part WHERE p_brand <> 'Brand#7'),
declared AS (SELECT p_partkey, p_name || p_partkey // 2 AS name, sha256(p_name || p_brand) AS h FROM part WHERE p_type <> 'PROMO')"""


def _declared_physical(t: Tables):
    name = F.concat("p_name", F.expr("p_partkey div 2"))
    part = t("part")
    changed = F.when(F.col("p_type") == "SMALL", "changed").otherwise(F.col("p_brand"))
    physical = part.filter(F.col("p_brand") != "Brand#7").select(name.alias("name"), sha256(F.concat("p_name", changed)).alias("h"))
    declared = part.filter(F.col("p_type") != "PROMO").select("p_partkey", name.alias("name"), sha256(F.concat("p_name", "p_brand")).alias("h"))
    return declared, physical


@plan("j4_declared_physical", f"""
WITH {PHYSICAL}
SELECT p_partkey, CASE WHEN EXISTS (SELECT 1 FROM physical p WHERE p.name = d.name AND p.h = d.h) THEN 'stored_checksum_match'
  WHEN EXISTS (SELECT 1 FROM physical p WHERE p.name = d.name) THEN 'same_name_checksum_mismatch'
  ELSE 'declared_original_not_physically_present' END AS reconciliation_status,
  (SELECT count(*) FROM physical p WHERE p.name = d.name) AS physical_candidates
FROM declared d""")
def j4(t: Tables):
    declared, physical = _declared_physical(t)
    joined = reconcile.declared_against_physical(declared, physical, "p_partkey", "name", "h")
    return joined.select("p_partkey", "reconciliation_status", "physical_candidates")


@plan("j4_one_sided_names", f"""
WITH {PHYSICAL}
(SELECT name, 'declared' AS only_in FROM declared EXCEPT SELECT name, 'declared' FROM physical)
UNION ALL (SELECT name, 'physical' FROM physical EXCEPT SELECT name, 'physical' FROM declared)""")
def j4b(t: Tables):
    declared, physical = _declared_physical(t)
    return reconcile.one_sided(declared, physical, "name", "declared", "physical")


def _collector(t: Tables):
    segment = F.col("c_mktsegment")
    return t("customer").filter(segment != "MACHINERY").select(
        "c_custkey", F.when(segment == "FURNITURE", F.col("c_nationkey") + 1).otherwise(F.col("c_nationkey")).alias("pages"),
        F.when(segment == "BUILDING", sha256(F.concat("c_name", F.lit("x")))).otherwise(sha256(F.col("c_name"))).alias("h"))


@plan("j5_hash_audit", """
WITH t AS (SELECT c_custkey, c_nationkey AS pages, sha256(c_name) AS h FROM customer),
c AS (SELECT c_custkey, CASE WHEN c_mktsegment = 'FURNITURE' THEN c_nationkey + 1 ELSE c_nationkey END AS pages,
  CASE WHEN c_mktsegment = 'BUILDING' THEN sha256(c_name || 'x') ELSE sha256(c_name) END AS h FROM customer WHERE c_mktsegment <> 'MACHINERY')
SELECT t.c_custkey, t.h AS old_hash, c.h AS new_hash, CASE WHEN c.c_custkey IS NULL THEN 'missing_in_collector' WHEN t.pages <> c.pages THEN 'pages_mismatch' END AS violation
FROM t LEFT JOIN c USING (c_custkey) WHERE c.c_custkey IS NULL OR t.pages <> c.pages OR t.h IS DISTINCT FROM c.h""")
def j5(t: Tables):
    target = t("customer").select("c_custkey", F.col("c_nationkey").alias("pages"), sha256(F.col("c_name")).alias("h"))
    return reconcile.hash_audit(target, _collector(t), "c_custkey", ["pages"], "h")


@plan("j6_snapshot_diff", """
WITH a AS (SELECT s_suppkey, s_nationkey, sha256(s_name) AS h FROM supplier WHERE s_nationkey <> 3),
b AS (SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN -1 ELSE s_nationkey END AS s_nationkey,
  sha256(CASE WHEN s_nationkey < 8 THEN s_nationkey::VARCHAR ELSE s_name END) AS h FROM supplier WHERE s_nationkey <> 5)
SELECT coalesce(a.s_suppkey, b.s_suppkey) AS s_suppkey, CASE WHEN b.s_suppkey IS NULL THEN 'removed' WHEN a.s_suppkey IS NULL THEN 'added' ELSE 'present' END AS presence,
  a.s_nationkey IS NOT DISTINCT FROM b.s_nationkey AS stable_fields_equal, a.h IS DISTINCT FROM b.h AS hash_changed,
  b.h IS NULL OR count(*) OVER (PARTITION BY b.h) = 1 AS new_hash_unique
FROM a FULL JOIN b ON a.s_suppkey = b.s_suppkey""")
def j6(t: Tables):
    supplier = t("supplier")
    old = supplier.filter(F.col("s_nationkey") != 3).select("s_suppkey", "s_nationkey", sha256(F.col("s_name")).alias("h"))
    new = supplier.filter(F.col("s_nationkey") != 5).select(
        "s_suppkey", F.when(F.col("s_acctbal") < 0, -1).otherwise(F.col("s_nationkey")).alias("s_nationkey"),
        sha256(F.when(F.col("s_nationkey") < 8, F.col("s_nationkey").cast("string")).otherwise(F.col("s_name"))).alias("h"))
    return reconcile.snapshot_diff(old, new, "s_suppkey", ["s_nationkey"], "h")


@plan("j7_enrich_set", """
WITH s AS (SELECT l_orderkey, array_to_string(list_sort(list(DISTINCT l_returnflag || l_linestatus)), ';') AS states FROM lineitem GROUP BY 1)
SELECT o_orderkey, coalesce(states, '') AS states FROM orders LEFT JOIN s ON o_orderkey = l_orderkey""")
def j7(t: Tables):
    orders = t("orders").select("o_orderkey", F.col("o_orderkey").alias("k"))
    details = t("lineitem").select(F.col("l_orderkey").alias("k"), F.concat("l_returnflag", "l_linestatus").alias("v"))
    joined = reconcile.enrich_with_set(orders, details, "k", "v", "s", "o_orderkey")
    return joined.select("o_orderkey", F.array_join("s", ";").alias("states"))


@plan("j8_asymmetric_collisions", """
WITH e AS (SELECT c_custkey::VARCHAR AS value, count(*) AS n FROM customer WHERE c_mktsegment = 'BUILDING' GROUP BY 1),
p AS (SELECT o_orderkey, 'o_custkey' AS kind, o_custkey::VARCHAR AS value FROM orders WHERE o_orderstatus <> 'P'),
r AS (SELECT *, row_number() OVER w - 1 AS earlier, lag(o_orderkey) OVER w AS latest_earlier FROM p WINDOW w AS (PARTITION BY value ORDER BY o_orderkey))
SELECT o_orderkey, kind, value, earlier, latest_earlier, coalesce(n, 0) AS existing FROM r LEFT JOIN e USING (value) WHERE earlier > 0 OR n > 0""")
def j8(t: Tables):
    accepted = t("orders").filter(F.col("o_orderstatus") != "P").select("o_orderkey", "o_custkey")
    accepted = accepted.withColumn("ord", F.col("o_orderkey"))
    existing = t("customer").filter(F.col("c_mktsegment") == "BUILDING").select(
        F.lit("o_custkey").alias("kind"), F.col("c_custkey").cast("string").alias("value"))
    found = collisions.asymmetric(accepted, "o_orderkey", "ord", ["o_custkey"], existing)
    return found.select("o_orderkey", "kind", "value", "earlier", "latest_earlier", "existing")


@plan("j9_acquisition_check", """
WITH f AS (SELECT p_name || p_partkey // 2 AS name, count(*) AS n, min(sha256(p_brand)) AS h FROM part WHERE p_brand <> 'Brand#7' GROUP BY 1),
e AS (SELECT p_partkey, p_name || p_partkey // 2 AS name, sha256(CASE WHEN p_type = 'SMALL' THEN 'x' ELSE p_brand END) AS h,
  CASE WHEN p_size > 45 THEN 'failed' ELSE 'acquired' END AS s FROM part)
SELECT p_partkey, CASE WHEN s <> 'acquired' THEN 'not_acquired' WHEN n IS NULL THEN 'no_physical_file' WHEN n > 1 THEN 'ambiguous_physical_path'
  WHEN e.h <> f.h THEN 'checksum_mismatch' ELSE 'verified' END AS verdict FROM e LEFT JOIN f USING (name)""")
def j9(t: Tables):
    part, name = t("part"), F.concat("p_name", F.expr("p_partkey div 2")).alias("name")
    physical = part.filter(F.col("p_brand") != "Brand#7").select(name, sha256(F.col("p_brand")).alias("h"))
    expected = part.select(
        "p_partkey", name, sha256(F.when(F.col("p_type") == "SMALL", "x").otherwise(F.col("p_brand"))).alias("h"),
        F.when(F.col("p_size") > 45, "failed").otherwise("acquired").alias("s"))
    return reconcile.acquisition_check(expected, physical, "p_partkey", "name", "h", "s").select("p_partkey", "verdict")


@plan("j10_star_counts", """
SELECT r_name, count(DISTINCT n_nationkey) AS sources, count(DISTINCT c_custkey) AS files, count(o_orderkey) AS documents
FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey
GROUP BY r_name""")
def j10(t: Tables):
    """Documents are counted per file before they meet it: the join sees one row per key."""
    per_file = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    files = t("customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey")).join(per_file, "c_custkey", "left")
    per_source = files.groupBy("n_nationkey").agg(F.count(F.lit(1)).alias("files"), F.sum("n").alias("documents"))
    sources = t("nation").join(per_source, "n_nationkey", "left").join(
        t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    zero = F.lit(0).cast("long")
    return sources.groupBy("r_name").agg(
        F.count(F.lit(1)).alias("sources"), F.coalesce(F.sum("files"), zero).alias("files"),
        F.coalesce(F.sum("documents"), zero).alias("documents"))


AUDIT = """audit AS (SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'stale' ELSE sha256(c_name) END AS old_h,
  CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN sha256(c_name) ELSE sha256(c_name || c_mktsegment) END AS new_h FROM customer WHERE c_acctbal > 1000)"""


def audit_of(t: Tables):
    name, segment = F.col("c_name"), F.col("c_mktsegment")
    return t("customer").filter(F.col("c_acctbal") > 1000).select(
        "c_custkey", F.when(segment == "BUILDING", "stale").otherwise(sha256(name)).alias("old_h"),
        F.when(segment == "HOUSEHOLD", sha256(name)).otherwise(sha256(F.concat(name, segment))).alias("new_h"))


@plan("j11_classify_update", f"""
WITH {AUDIT}, target AS (SELECT c_custkey, sha256(c_name) AS h FROM customer WHERE c_nationkey <> 3)
SELECT count(*) AS audit_rows, count(h) AS existing, count(*) FILTER (h = old_h) AS old_match, count(*) FILTER (h = new_h) AS new_match,
  count(*) FILTER (h IS NOT NULL AND h <> old_h AND h <> new_h) AS unexpected FROM audit LEFT JOIN target USING (c_custkey)""")
def j11(t: Tables):
    target = t("customer").filter(F.col("c_nationkey") != 3).select("c_custkey", sha256(F.col("c_name")).alias("h"))
    return reconcile.classify_update(audit_of(t), target, "c_custkey", "h", "old_h", "new_h")


@plan("j12_pairing", """
WITH d AS (SELECT o_orderkey AS k, count(*) AS d FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1),
f AS (SELECT l_orderkey AS k, count(*) AS f FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1)
SELECT count(*) FILTER (f IS NULL) AS without_file, count(*) FILTER (d IS NULL) AS without_document,
  count(*) FILTER (d = 1 AND f = 1) AS one_to_one, count(*) FILTER (d >= 1 AND f > 1) AS several_files FROM d FULL JOIN f USING (k)""")
def j12(t: Tables):
    documents = t("orders").filter(F.col("o_orderstatus") != "P").select(F.col("o_orderkey").alias("k"))
    files = t("lineitem").filter(F.col("l_returnflag") == "A").select(F.col("l_orderkey").alias("k"))
    return reconcile.pairing(documents, files, "k")


@plan("j13_child_pages", """
WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders)
SELECT o_custkey, (n - 1) // 100 + 1 AS page_no, count(*) AS children, string_agg(o_orderkey::VARCHAR, ';' ORDER BY o_orderkey) AS child_ids
FROM r GROUP BY ALL""")
def j13(t: Tables):
    """Pages of 100 children, the size of an import batch."""
    paged = reconcile.child_pages(t("orders"), "o_custkey", "o_orderkey")
    ids = F.array_join(F.transform("child_ids", lambda x: x.cast("string")), ";")
    return paged.select("o_custkey", "page_no", "children", ids.alias("child_ids"))
