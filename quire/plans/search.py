"""T: token index, number lookup and chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import sha256
from ..operators import search as S
from ..session import scratch
from .projections import LINES
from .registry import Tables, plan

TOKENS = r"list_distinct(list_filter(regexp_split_to_array(lower(source || ' ' || lang || ' ' || text), '[^\p{L}\p{Nd}]+'), lambda x: x <> ''))"


@plan("t1_token_index", f"""
SELECT token, count(*) AS documents, min(doc_id) AS first_document FROM (SELECT doc_id, unnest({TOKENS}) AS token FROM documents) GROUP BY token""")
def t1_index(t: Tables):
    index = S.token_index(t("documents"), "doc_id", ["source", "lang", "text"])
    return index.groupBy("token").agg(F.count(F.lit(1)).alias("documents"), F.min("doc_id").alias("first_document"))


@plan("t1_conjunctive_search", f"""
SELECT doc_id FROM documents WHERE list_has_all({TOKENS}, ['the', 'with', 'and'])""")
def t1_search(t: Tables):
    return S.search(S.token_index(t("documents"), "doc_id", ["source", "lang", "text"]), "doc_id", ["the", "With", "and"])


@plan("t1_kept_index", f"""
SELECT doc_id FROM documents WHERE list_has_all({TOKENS}, ['the', 'with', 'and'])""")
def t1_kept(t: Tables):
    """The same from a kept index, which receives the documents of each language as a batch of its own."""
    index = S.Postings(t.spark, scratch(t.spark, "index"), "doc_id", buckets=32)
    documents = t("documents")
    index.add(documents.filter(F.col("lang") == "en"), ["source", "lang", "text"], 0)
    index.add(documents.filter(~F.col("lang").eqNullSafe("en")), ["source", "lang", "text"], 1)
    found = index.search(["the", "With", "and"])
    return documents.select("doc_id").limit(0) if found is None else found


@plan("t2_exact_lookup", """
SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE (o_orderkey = 37 OR o_custkey = 37) AND o_orderstatus = 'F'""")
def t2(t: Tables):
    found = S.exact_lookup(t("orders"), ["o_orderkey", "o_custkey"], 37, o_orderstatus="F")
    return found.select("o_orderkey", "o_custkey", "o_orderstatus")


@plan("t3_chunks", f"""
WITH l AS (SELECT doc_id, {LINES} AS ls FROM documents),
c AS (SELECT doc_id, ls, unnest(range(0, ((len(ls) + 19) // 20)::INT)) AS i FROM l)
SELECT doc_id, i::INTEGER AS chunk_index, sha256(array_to_string(ls[i * 20 + 1:i * 20 + 20], E'\\n')) AS chunk_hash FROM c""")
def t3(t: Tables):
    chunks = S.chunks(t("documents"), "doc_id", "text")
    return chunks.select("doc_id", "chunk_index", sha256(F.col("chunk_text")).alias("chunk_hash"))
