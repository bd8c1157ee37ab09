"""W: order-dependent operators, and O: sort, cap and offset."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import normalise, sha256, text_hash
from ..operators import collisions, dedup, segment
from ..operators import validate as V
from ..operators.ordered import in_order
from ..sources.registers import payload_items
from .registry import Tables, plan, sql_norm

NORM = sql_norm("text")


@plan("w1_first_wins", f"""
WITH h AS (SELECT doc_id, sha256({NORM}) AS h FROM documents)
SELECT doc_id, h, min(doc_id) OVER (PARTITION BY h) AS canonical_id, doc_id = min(doc_id) OVER (PARTITION BY h) AS is_first FROM h""")
def w1(t: Tables):
    docs = t("documents").select("doc_id", text_hash(F.col("text"), "target").alias("h"))
    return dedup.first_wins(docs, "h", "doc_id", "doc_id").select("doc_id", "h", "canonical_id", "is_first")


STARTS = """c AS (SELECT user_id, event_id, event_type FROM events WHERE value >= 5),
b AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM c),
s AS (SELECT user_id, event_id, event_type FROM b WHERE before IS DISTINCT FROM event_type)"""


def _starts(t: Tables, keep_block: bool = False):
    """Evidence (a minimum value) is filtered before identities are compared."""
    candidates = t("events").filter(F.col("value") >= 5).select("user_id", "event_id", "event_type")
    return segment.boundaries(candidates, "user_id", "event_id", ["event_type"], keep_block=keep_block)


@plan("w2_spans", f"""
WITH {STARTS}, l AS (SELECT user_id, max(event_id) AS last FROM events GROUP BY 1)
SELECT user_id, event_id AS start_page, event_type, coalesce(lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) - 1, last) AS end_page
FROM s JOIN l USING (user_id)""")
def w2(t: Tables):
    last = t("events").groupBy("user_id").agg(F.max("event_id").alias("last"))
    spans = segment.spans(_starts(t, keep_block=True), "user_id", "event_id", last, "last")
    return spans.select("user_id", F.col("event_id").alias("start_page"), "event_type", "end_page")


@plan("w3_boundaries", f"WITH {STARTS} SELECT * FROM s")
def w3(t: Tables):
    return _starts(t).select("user_id", "event_id", "event_type")


@plan("w4_prior_members", """
SELECT o_custkey, o_orderkey, row_number() OVER w - 1 AS prior, lag(o_orderkey) OVER w AS latest_prior FROM orders
WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)""")
def w4(t: Tables):
    return collisions.prior_members(t("orders"), "o_custkey", "o_orderkey", "o_orderkey")


GREEDY = """
WITH RECURSIVE base AS MATERIALIZED ({base}),
fold AS (
  SELECT 0::BIGINT AS n, []::VARCHAR[] AS k1, []::VARCHAR[] AS k2, []::BIGINT[] AS o1, []::BIGINT[] AS o2, NULL::BIGINT AS id, NULL::BIGINT AS canon, NULL::VARCHAR AS method
  UNION ALL
  SELECT b.n,
    CASE WHEN hit1 IS NULL AND hit2 IS NULL THEN list_append(k1, b.a) ELSE k1 END, CASE WHEN hit1 IS NULL AND hit2 IS NULL THEN list_append(k2, b.b) ELSE k2 END,
    CASE WHEN hit1 IS NULL AND hit2 IS NULL THEN list_append(o1, b.id) ELSE o1 END, CASE WHEN hit1 IS NULL AND hit2 IS NULL THEN list_append(o2, b.id) ELSE o2 END,
    b.id, coalesce(hit1, hit2), CASE WHEN hit1 IS NOT NULL THEN '{first}' WHEN hit2 IS NOT NULL THEN '{second}' END
  FROM (SELECT f.k1, f.k2, f.o1, f.o2, c.n, c.id, c.a, c.b, f.o1[list_position(f.k1, c.a)] AS hit1, f.o2[list_position(f.k2, c.b)] AS hit2
        FROM fold f JOIN base c ON c.n = f.n + 1) b)
SELECT id AS {ident}, CASE WHEN canon IS NULL THEN 'accepted' ELSE 'duplicate' END AS status, canon::VARCHAR AS canonical_id, method FROM fold WHERE n > 0"""

DOCUMENT_KEYS = f"""SELECT row_number() OVER (ORDER BY doc_id) AS n, doc_id AS id, sha256({NORM}) AS a,
  source || '|' || n_chars // 10 AS b FROM documents"""


def _document_keys(t: Tables):
    size = F.concat_ws("|", "source", F.expr("n_chars div 10"))
    return t("documents").select("doc_id", F.col("doc_id").alias("ord"), text_hash(F.col("text"), "target").alias("text_hash"), size.alias("size"))


@plan("w5_two_level_dedup", GREEDY.format(base=DOCUMENT_KEYS, first="text_hash", second="size", ident="doc_id"))
def w5(t: Tables):
    return dedup.greedy(_document_keys(t), "doc_id", "ord", ["text_hash", "size"])


@plan("w6_greedy_dedup", """
WITH RECURSIVE base AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY event_id) AS n, event_id AS id, 'url|' || user_id || '|' || floor(value)::BIGINT AS a,
         'file|' || event_type || '|' || props || '|' || floor(value / 8)::BIGINT AS b FROM events),
held(k, owner, method) USING KEY (k) AS (
  SELECT '#' AS k, 0::BIGINT AS owner, NULL::VARCHAR AS method
  UNION
  SELECT unnest(CASE WHEN ha IS NULL AND hb IS NULL THEN ['#', a, b] ELSE ['#', 'r|' || id] END),
         unnest(CASE WHEN ha IS NULL AND hb IS NULL THEN [n, id, id] ELSE [n, coalesce(ha, hb)] END),
         unnest(CASE WHEN ha IS NULL AND hb IS NULL THEN [NULL, NULL, NULL] ELSE [NULL, CASE WHEN ha IS NOT NULL THEN 'url' ELSE 'file' END] END)
  FROM (SELECT c.n, c.id, c.a, c.b, x.owner AS ha, y.owner AS hb
        FROM held h JOIN base c ON c.n = h.owner + 1 LEFT JOIN recurring.held x ON x.k = c.a LEFT JOIN recurring.held y ON y.k = c.b
        WHERE h.k = '#'))
SELECT id AS event_id, CASE WHEN r.k IS NULL THEN 'accepted' ELSE 'duplicate' END AS status, r.owner::VARCHAR AS canonical_id, r.method
FROM base LEFT JOIN held r ON r.k = 'r|' || id""")
def w6(t: Tables):
    """Two strong keys per event, many of them shared. The SQL is the fold itself, one event a step."""
    return dedup.greedy(_event_keys(t), "event_id", "ord", ["url", "file"])


def _event_keys(t: Tables):
    return t("events").select(
        "event_id", F.col("event_id").alias("ord"),
        F.concat_ws("|", "user_id", F.floor("value")).alias("url"),
        F.concat_ws("|", "event_type", "props", F.floor(F.col("value") / 8)).alias("file"), "user_id", "event_type")


@plan("w7_soft_hits", f"""
WITH h AS (SELECT doc_id, source, n_chars // 10 AS size, sha256({NORM}) AS h FROM documents),
a AS (SELECT * FROM h QUALIFY doc_id = min(doc_id) OVER (PARTITION BY h)),
p AS (SELECT doc_id, 0 AS rank, 'source' AS kind, source AS value FROM a UNION ALL SELECT doc_id, 1, 'size', size::VARCHAR FROM a),
o AS (SELECT *, min(doc_id) OVER (PARTITION BY kind, value) AS owner FROM p)
SELECT doc_id, arg_min(owner, rank) AS possible_canonical, string_agg(kind, ';' ORDER BY rank) AS matches FROM o WHERE owner <> doc_id GROUP BY 1""")
def w7(t: Tables):
    docs = t("documents").select("doc_id", "source", F.expr("n_chars div 10").alias("size"),
                                 text_hash(F.col("text"), "target").alias("h"))
    fate = dedup.greedy(docs.withColumn("ord", F.col("doc_id")), "doc_id", "ord", ["h"]).filter(F.col("status") == "accepted")
    accepted = docs.join(fate.select("doc_id"), "doc_id").withColumn("ord", F.col("doc_id"))
    hits = dedup.soft_hits(accepted, "doc_id", "ord", ["source", "size"])
    return hits.select("doc_id", "possible_canonical", F.array_join("matches", ";").alias("matches"))


@plan("w8_batch_numbers", """
SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 6 + 1 AS batch_of_6, (row_number() OVER (ORDER BY o_orderkey) - 1) // 100 + 1 AS batch_of_100 FROM orders""")
def w8(t: Tables):
    ranked = in_order(t("orders").select("o_orderkey"), [], "o_orderkey", position="n")
    return ranked.select("o_orderkey", F.expr("(n - 1) div 6 + 1").alias("batch_of_6"), F.expr("(n - 1) div 100 + 1").alias("batch_of_100"))


@plan("w9_split_documents", rf"""
WITH n AS (SELECT doc_id, {NORM} AS t FROM documents),
m AS (SELECT doc_id, t, regexp_extract_all(t, 'with the ([a-z]{{3,20}})', 1) AS nums, string_split(regexp_replace(t, 'with the ([a-z]{{3,20}})', chr(1) || 'with the \1', 'g'), chr(1)) AS segs FROM n),
x AS (SELECT doc_id, t, segs, list_filter(range(1, len(nums) + 1), lambda i: list_position(nums, nums[i]) = i) AS fresh FROM m),
p AS (SELECT doc_id, t, CASE WHEN len(fresh) > 1 THEN list_transform(range(1, len(fresh) + 1), lambda j: trim(array_to_string(
   segs[(CASE WHEN j = 1 THEN 1 ELSE fresh[j] + 1 END):(CASE WHEN j = len(fresh) THEN len(segs) ELSE fresh[j + 1] END)], ''))) END AS parts FROM x),
k AS (SELECT doc_id, t, list_filter(parts, lambda s: length(s) >= 200) AS kept FROM p),
o AS (SELECT doc_id, CASE WHEN coalesce(len(kept), 0) > 0 THEN kept WHEN t <> '' THEN [t] ELSE [] END AS f FROM k)
SELECT doc_id, (generate_subscripts(f, 1))::INTEGER AS part, sha256(unnest(f)) AS part_hash FROM o""")
def w9(t: Tables):
    """Marker words stand in for reference numbers."""
    norm = t("documents").select("doc_id", normalise(F.col("text"), "target").alias("t"))
    parts = segment.split_document(F.col("t"), ["with the ([a-z]{3,20})"])
    rows = norm.select("doc_id", F.posexplode(parts).alias("p", "part_text"))
    return rows.select("doc_id", (F.col("p") + 1).alias("part"), sha256(F.col("part_text")).alias("part_hash"))


@plan("w9_short_pieces", rf"""
WITH n AS (SELECT doc_id, {NORM} AS t FROM documents),
m AS (SELECT doc_id, t, regexp_extract_all(t, 'and ([a-z]{{4,20}})', 1) AS nums, string_split(regexp_replace(t, 'and ([a-z]{{4,20}})', chr(1) || 'and \1', 'g'), chr(1)) AS segs FROM n),
x AS (SELECT doc_id, t, segs, list_filter(range(1, len(nums) + 1), lambda i: list_position(nums, nums[i]) = i) AS fresh FROM m),
p AS (SELECT doc_id, t, CASE WHEN len(fresh) > 1 THEN list_transform(range(1, len(fresh) + 1), lambda j: trim(array_to_string(
   segs[(CASE WHEN j = 1 THEN 1 ELSE fresh[j] + 1 END):(CASE WHEN j = len(fresh) THEN len(segs) ELSE fresh[j + 1] END)], ''))) END AS parts FROM x),
u AS (SELECT doc_id, unnest(parts) AS part_text, generate_subscripts(parts, 1)::INTEGER AS piece, list_max(list_transform(parts, lambda s: length(s))) AS longest FROM p)
SELECT doc_id, piece, sha256(part_text) AS part_hash, length(part_text)::INTEGER AS size FROM u WHERE longest >= 200 AND length(part_text) < 200""")
def w9_short(t: Tables):
    """What the split leaves out, as error rows."""
    norm = t("documents").select("doc_id", normalise(F.col("text"), "target").alias("t"))
    rows = norm.select("doc_id", F.inline(segment.short_pieces(F.col("t"), ["and ([a-z]{4,20})"])))
    return rows.select("doc_id", "piece", sha256(F.col("text")).alias("part_hash"), F.length("text").alias("size"))


@plan("w10_first_seen", """
WITH k AS (SELECT o_orderkey, o_custkey || '|' || o_orderpriority || '|' || o_orderstatus AS e, o_custkey || '|' || o_orderpriority AS r FROM orders),
m AS (SELECT *, min(o_orderkey) OVER (PARTITION BY e) AS me, min(o_orderkey) OVER (PARTITION BY r) AS mr FROM k)
SELECT o_orderkey, CASE WHEN me <> o_orderkey THEN 'exact_hash' WHEN mr <> o_orderkey THEN 'reference' END AS match_type,
  CASE WHEN me <> o_orderkey THEN me WHEN mr <> o_orderkey THEN mr END AS canonical_id, CASE WHEN me <> o_orderkey THEN 'duplicate' ELSE 'review' END AS status FROM m""")
def w10(t: Tables):
    reference = F.concat_ws("|", "o_custkey", "o_orderpriority")
    rows = t("orders").select("o_orderkey", F.col("o_orderkey").alias("ord"), F.concat_ws("|", reference, "o_orderstatus").alias("e"),
                              reference.alias("r"))
    return dedup.first_seen(rows, "o_orderkey", "ord", "e", "r")


@plan("w11_ordinal_crosswalk", """
SELECT n_nationkey, 'decision-' || lpad(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey)::VARCHAR, 3, '0') AS crosswalk FROM nation""")
def w11(t: Tables):
    ranked = in_order(t("nation").select("n_regionkey", "n_nationkey"), ["n_regionkey"], "n_nationkey", position="n")
    return ranked.select("n_nationkey", F.format_string("decision-%03d", "n").alias("crosswalk"))


@plan("o1_total_order", "SELECT user_id, event_type, event_id FROM events ORDER BY user_id, event_type, event_id")
def o1(t: Tables):
    return t("events").select("user_id", "event_type", "event_id").orderBy("user_id", "event_type", "event_id")


@plan("o2_error_cap", """
WITH v AS (SELECT 'discount_high' AS rule, 'error' AS severity, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id, l_quantity::INT::VARCHAR AS detail FROM lineitem WHERE l_discount > 0.09)
SELECT rule, severity, id, detail, (SELECT count(*) FROM v) AS total FROM v ORDER BY id, detail LIMIT 100""")
def o2(t: Tables):
    """A report shows the first hundred findings and the whole count."""
    lines = t("lineitem").withColumn("id", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    rule = V.Rule("discount_high", F.col("l_discount") > 0.09, F.round("l_quantity").cast("int"))
    total, shown = V.capped(V.row_rules(lines, "id", [rule]), ["id", "detail"], 100)
    return shown.withColumn("total", total.select("findings").scalar())


@plan("o3_bounded_batch", "SELECT event_id, user_id, event_type FROM events WHERE event_id >= 40 ORDER BY event_id LIMIT 25")
def o3(t: Tables):
    """The next 25 queue entries from a cursor: the batch is the feature."""
    return t("events").filter(F.col("event_id") >= 40).select("event_id", "user_id", "event_type").orderBy("event_id").limit(25)


@plan("o4_payload_limit", """
SELECT event_id // 100 AS batch, event_id, user_id, count(*) OVER (PARTITION BY event_id // 100) AS declared FROM events""")
def o4(t: Tables):
    """Each payload gives as many rows as it declares, so the limit drops none."""
    item = F.struct("event_id", "user_id")
    payloads = t("events").groupBy(F.expr("event_id div 100").alias("batch")).agg(F.array_sort(F.collect_list(item)).alias("items"), F.count(F.lit(1)).alias("declared"))
    return payload_items(payloads, "items", "declared", ["batch", "declared"])
