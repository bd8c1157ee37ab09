"""K: sinks and table maintenance; every plan writes to a fresh folder and reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import sha256
from ..operators.ordered import in_order
from ..session import scratch
from ..sources import tables as K
from .joins import AUDIT, audit_of
from .registry import Tables, plan


@plan("k1_register_sink", "SELECT o_orderkey, o_custkey, o_orderstatus, nullif(o_orderpriority, '5-LOW') AS priority FROM orders")
def k1(t: Tables):
    rows = t("orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("priority"))
    path = scratch(t.spark, "register")
    K.write_register(rows, path)
    return K.read_dataset(t.spark, path, rows.schema)


@plan("k2_manifest_sink", "SELECT s_suppkey::VARCHAR AS s_suppkey, s_name || ', \"' || s_nationkey || '\"' AS label FROM supplier")
def k2(t: Tables):
    label = F.concat("s_name", F.lit(', "'), "s_nationkey", F.lit('"'))
    rows = t("supplier").select(F.col("s_suppkey").cast("string").alias("s_suppkey"), label.alias("label"))
    path = scratch(t.spark, "manifest")
    K.write_manifest(rows, path)
    return K.read_dataset(t.spark, path, rows.schema, header=True, escape='"')


@plan("k3_batch_numbers", """
WITH b AS (SELECT (row_number() OVER (ORDER BY o_orderkey) - 1) // 100 + 1 AS n FROM orders)
SELECT lpad(n::VARCHAR, greatest(3, length(n::VARCHAR))::INTEGER, '0') AS batch, count(*) AS records FROM b GROUP BY 1""")
def k3(t: Tables):
    ranked = in_order(t("orders").select("o_orderkey"), [], "o_orderkey", position="n")
    return ranked.groupBy(F.format_string("%03d", F.expr("(n - 1) div 100 + 1")).alias("batch")).agg(F.count(F.lit(1)).alias("records"))


@plan("k3_batches_on_disk", """
WITH b AS (SELECT o_orderkey, o_custkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 100 + 1 AS n FROM orders)
SELECT lpad(n::VARCHAR, greatest(3, length(n::VARCHAR))::INTEGER, '0') AS batch, o_orderkey, o_custkey FROM b""")
def k3_disk(t: Tables):
    path = scratch(t.spark, "batches")
    K.write_batches(t("orders").select("o_orderkey", "o_custkey"), path, "o_orderkey", 100, per_file=20)
    return K.read_dataset(t.spark, path, "o_orderkey bigint, o_custkey bigint, batch string").select("batch", "o_orderkey", "o_custkey")


@plan("k4_insert_on_id", """
WITH t AS (SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')),
s AS (SELECT c_custkey, upper(c_name) AS c_name, c_mktsegment FROM customer WHERE c_nationkey < 12)
SELECT * FROM t UNION ALL SELECT * FROM s WHERE c_custkey NOT IN (SELECT c_custkey FROM t)""")
def k4(t: Tables):
    customer = t("customer")
    target = customer.filter(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select("c_custkey", "c_name", "c_mktsegment")
    source = customer.filter(F.col("c_nationkey") < 12).select("c_custkey", F.upper("c_name").alias("c_name"), "c_mktsegment")
    return K.insert_if_absent(target, source, "c_custkey", [["c_custkey"]])


@plan("k4_insert_on_any_key", """
WITH t AS (SELECT c_custkey, c_nationkey, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 0),
s AS (SELECT c_custkey, c_nationkey, c_mktsegment FROM customer),
f AS (SELECT s.* FROM s ANTI JOIN t USING (c_custkey) WHERE (c_nationkey, c_mktsegment) NOT IN (SELECT (c_nationkey, c_mktsegment) FROM t)
      QUALIFY c_custkey = min(c_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment))
SELECT * FROM t UNION ALL SELECT * FROM f""")
def k4_any(t: Tables):
    customer = t("customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    target = t("customer").filter((F.col("c_mktsegment") == "BUILDING") & (F.col("c_acctbal") > 0)).select(*customer.columns)
    return K.insert_if_absent(target, customer, "c_custkey", [["c_custkey"], ["c_nationkey", "c_mktsegment"]])


@plan("k5_guarded_update", f"""
WITH {AUDIT}
SELECT c_custkey, CASE WHEN sha256(c_name) = old_h THEN new_h ELSE sha256(c_name) END AS h, coalesce(sha256(c_name) = old_h, false) AS updated
FROM customer LEFT JOIN audit USING (c_custkey)""")
def k5(t: Tables):
    target = t("customer").select("c_custkey", sha256(F.col("c_name")).alias("h"))
    return K.guarded_update(target, audit_of(t), "c_custkey", {"h": "new_h"}, ("h", "old_h"))


NAMES = ["region", "nation", "customer", "orders", "labels"]


@plan("k6_snapshot", " UNION ALL ".join(
    f"SELECT '{n}' AS table_name, count(*) AS source_rows, count(*) AS snapshot_rows, true AS verified FROM {n}" for n in NAMES))
def k6(t: Tables):
    proof = K.snapshot({n: t(n) for n in NAMES}, scratch(t.spark, "snapshot"))
    return proof.select("table_name", "source_rows", "snapshot_rows", "verified")


@plan("k7_upsert", """
SELECT user_id, event_type, arg_max(event_id, (event_type = 'view' OR value > 50, ts, event_id)) AS event_id FROM (
  SELECT * FROM events WHERE value > 50 UNION ALL SELECT * FROM events WHERE value <= 50) GROUP BY ALL""")
def k7(t: Tables):
    """Later parses (value over 50, and every view) replace what the register holds."""
    rows = t("events").select("user_id", "event_type", "event_id", F.struct("ts", "event_id").alias("version"), "value")
    late = (F.col("value") > 50) | (F.col("event_type") == "view")
    merged = K.upsert(rows.filter(~late), rows.filter(late), ["user_id", "event_type"], "version")
    return merged.select("user_id", "event_type", "event_id")


@plan("k9_replace_dataset", "SELECT n_nationkey, upper(n_name) AS n_name, c_custkey FROM nation JOIN customer ON c_nationkey = n_nationkey")
def k9(t: Tables):
    """The second version is what readers see."""
    joined = t("nation").join(t("customer"), F.col("c_nationkey") == F.col("n_nationkey"))
    path = scratch(t.spark, "dataset")
    K.replace_dataset(joined.select("n_nationkey", "n_name", "c_custkey"), path)
    K.replace_dataset(joined.select("n_nationkey", F.upper("n_name").alias("n_name"), "c_custkey"), path)
    return K.read_dataset(t.spark, path)


@plan("k10_sync_status", """
WITH l AS (SELECT l_orderkey, CASE WHEN bool_and(l_linestatus = 'O') THEN 'reference_only' WHEN bool_or(l_returnflag = 'R') THEN 'needs_review' ELSE 'indexed' END AS s,
  count(*) FILTER (l_returnflag = 'N') AS n FROM lineitem WHERE l_quantity > 3 GROUP BY 1)
SELECT o_orderkey, coalesce(CASE s WHEN 'reference_only' THEN 'reference only' WHEN 'needs_review' THEN 'boundaries not proven'
  WHEN 'indexed' THEN CASE WHEN n > 0 THEN 'split: ' || n || ' searchable' ELSE 'split: none searchable' END END, o_orderstatus) AS status
FROM orders LEFT JOIN l ON o_orderkey = l_orderkey""")
def k10(t: Tables):
    log = t("lineitem").filter(F.col("l_quantity") > 3).groupBy(F.col("l_orderkey").alias("source")).agg(
        F.when(F.bool_and(F.col("l_linestatus") == "O"), "reference_only").when(F.bool_or(F.col("l_returnflag") == "R"), "needs_review")
        .otherwise("indexed").alias("s"), F.count_if(F.col("l_returnflag") == "N").alias("n"))
    register = t("orders").select("o_orderkey", F.col("o_orderkey").alias("source"), F.col("o_orderstatus").alias("status"))
    labels = {"reference_only": "reference only", "needs_review": "boundaries not proven", "failed": "original failed",
              "indexed": "split: %d searchable", "indexed_none": "split: none searchable"}
    return K.sync_status(register, log, "o_orderkey", "source", "s", "n", labels).select("o_orderkey", "status")


@plan("k8_append_log", """
SELECT 1::BIGINT AS batch_id, event_type, count(*) AS events FROM events WHERE event_type <> 'error' GROUP BY event_type
UNION ALL SELECT 2, event_type, count(*) FROM events WHERE event_type = 'error' GROUP BY event_type""")
def k8(t: Tables):
    """Two batches and an empty one; the first comes twice and counts once."""
    path = scratch(t.spark, "log")
    error = F.col("event_type") == "error"
    K.append_once(t("events").filter(error), path, 1)
    K.append_once(t("events").filter(~error), path, 1)
    K.append_once(t("events").filter(error), path, 2)
    K.append_once(t("events").limit(0), path, 3)
    logged = K.read_log(t.spark, path).withColumn("batch_id", F.col("batch_id").cast("long"))
    return logged.groupBy("batch_id", "event_type").agg(F.count(F.lit(1)).alias("events"))
