"""Deposited files to records awaiting review, composed from the operators.

A page whose header names a document type and whose text holds its reference starts a document, which ends before the next
start. A file without any start is one document, of the type its name and first page suggest.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import fields as X
from .functions import patterns as P
from .functions import rules
from .functions.text import lines, normalise
from .lifecycles import span_hashes
from .operators import dedup, segment
from .operators.keyed import lookup
from .operators.ordered import BLOCK
from .operators.segment import PIECE_PAGES
from .session import cut


def deposit_records(pages: DataFrame, sources: DataFrame, existing: DataFrame | None = None, *, profile: str = "deposit",
                    facts: Callable[[Column], Column] = rules.header_facts, title: Callable[[Column], Column] = X.title,
                    kinds: tuple[str, ...] = tuple(k for k, _, _ in P.HEADER_KINDS), prefix: str = "deposit",
                    piece_pages: int = PIECE_PAGES, block: int = BLOCK) -> DataFrame:
    """One record a document: id, pages, kind, reference, date, court, title, text hash, missing requirements, duplicate.

    ``pages`` is (source, page from 1, text), ``sources`` (source, name, official_url) with each source once, ``existing``
    (text_hash, id) of earlier records. Pages before a file's first start belong to no record, as do files that
    ``sources`` lacks. A record whose text an existing one holds names the least such id, else the first of this batch
    by source and page; both wait for review. NULL texts are empty pages; a page without a source or number is left out.
    """
    src, page = "source", "page"
    pages = pages.filter(F.col(src).isNotNull() & F.col(page).isNotNull()).withColumn("text", F.coalesce("text", F.lit("")))
    read = pages.select(src, page, normalise(F.col("text"), profile).alias("_t"), lines(F.col("text"), profile).alias("_l"))
    described = cut(read.select(src, page, facts(F.col("_t")).alias("_f"), title(F.col("_l")).alias("title")))
    starts = described.filter(F.col("_f").isNotNull()).select(src, page, "_f.kind", "_f.reference", "_f.date", "_f.court", "title")
    totals = cut(described.groupBy(src).agg(F.max(page).alias("pages"), F.count("_f").alias("_starts")).join(sources, src))
    whole = totals.filter("_starts = 0").select(src, "name").join(pages.filter(F.col(page) == 1), src).join(
        described.select(src, page, "title"), [src, page])
    none = F.lit(None).cast("string")
    whole = whole.select(src, page, rules.whole_file_type(F.col("name"), F.col("text")).alias("kind"),
                         none.alias("reference"), none.alias("date"), none.alias("court"), "title")
    begun = lookup(starts, totals.select(src), [src], [src, page], "left_semi").unionByName(whole)
    found = cut(segment.spans(begun, src, page, totals.select(src, "pages"), "pages", block=block))

    marks = found.select(src, page, F.lit(True).alias("_start"))
    marked = pages.join(marks, [src, page], "left").withColumn("_start", F.coalesce("_start", F.lit(False)))
    texts = cut(segment.span_text(marked, src, page, "text", "_start", piece_pages=piece_pages, block=block))
    places = texts.groupBy(src, "span_no").agg(F.min("first_page").alias(page))
    hashed = found.join(places.join(span_hashes(texts, src, "span_text"), [src, "span_no"]).drop("span_no"), [src, page])

    given = hashed.join(totals.select(src, "official_url"), src)
    known = F.col("kind").isin(*kinds)
    missing = F.array_compact(F.array(
        F.when(~known, "verified_legal_type"), F.when(F.coalesce(F.col("title"), F.lit("")) == "", "verified_title"),
        F.when(known & (F.coalesce(F.col("reference"), F.lit("")) == ""), "verified_reference"),
        F.when(F.coalesce(F.col("official_url"), F.lit("")) == "", "official_source_url")))
    number = F.lpad(F.col(page).cast("string"), 9, "0")
    records = cut(given.select(
        F.concat(F.lit(f"{prefix}-"), F.col(src).cast("string"), F.lit("-p"), F.col(page).cast("string")).alias("id"),
        F.concat_ws("#", F.col(src).cast("string"), number).alias("_order"),
        src, F.col(page).alias("start_page"), "end_page", "kind", "reference", "date", "court", "title", "text_hash",
        missing.alias("missing_requirements")))
    judged = records.join(dedup.first_wins(records, "text_hash", "id", "_order").select("id", "canonical_id"), "id")
    held = F.lit(None).cast("string")
    if existing is not None:
        least = existing.filter(F.col("text_hash").isNotNull()).groupBy("text_hash").agg(F.min("id").alias("_held"))
        judged, held = lookup(judged, least, ["text_hash"], ["id"]), F.col("_held")
    other = F.coalesce(held, F.when(F.col("canonical_id") != F.col("id"), F.col("canonical_id")))
    state = F.when(F.col("duplicate_of").isNotNull(), "exact_duplicate_review").otherwise("pending_provenance_and_metadata_review")
    return judged.withColumn("duplicate_of", other).withColumn("review_status", state).drop("_order", "_held", "canonical_id")
