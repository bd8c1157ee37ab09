"""The archive's batch lifecycles, composed from the operators.

Tables that several steps read are written once to the shared folder (``cut``): page
fields, spans and span texts. Text travels once, from pages to spans.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import fields as X
from .functions import ids, rules, urls
from .functions import patterns as P
from .functions.text import lines, none_if_empty, normalise, sha256, text_hash
from .operators import collisions, dedup, segment
from .operators import validate as V
from .operators.keyed import lookup
from .operators.ordered import BLOCK
from .operators.segment import PIECE_PAGES
from .session import cut

NUMBERS = ["deed_number", "judgment_number", "lawsuit_number"]
REQUIRED = ["deed_number", "subject", "decision_date", "court"]
COMPLETE, INCOMPLETE, COLLIDED = (
    "metadata_complete_auto_extracted", "metadata_incomplete_pending_review", "reference_collision_pending_review",
)


@dataclass
class Cases:
    records: DataFrame
    duplicates: DataFrame
    skipped: DataFrame
    collisions: DataFrame
    processing_log: DataFrame
    texts: DataFrame

    def verified(self) -> DataFrame:
        return self.records.filter(F.col("review_status") == COMPLETE)

    def pending(self) -> DataFrame:
        return self.records.filter(F.col("review_status") != COMPLETE)


def span_hashes(pieces: DataFrame, source: str, text: str) -> DataFrame:
    """sha256 of each span's normalised text.

    A span of one piece is hashed in the JVM. A longer one streams its pieces in order
    through one digest, so its text is never held whole: normalised pieces joined by a
    blank are the normalised span, since a form feed is white space.
    """
    ready = pieces.select(source, "span_no", "piece", normalise(F.col(text)).alias("_t"))
    sizes = pieces.groupBy(source, "span_no").agg(F.count(F.lit(1)).alias("_pieces"))
    sized = ready.join(sizes, [source, "span_no"])
    short = sized.filter("_pieces = 1").select(source, "span_no", sha256(F.col("_t")).alias("text_hash"))

    def digest(key, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, last, begun = hashlib.sha256(), None, False
        for batch in batches:
            for number, value in zip(batch["piece"], batch["_t"], strict=True):
                if last is not None and number <= last:
                    raise ValueError("span pieces arrived out of order")
                last = number
                if value:
                    state.update(((" " if begun else "") + value).encode())
                    begun = True
        yield pd.DataFrame({source: [key[0]], "span_no": [key[1]], "text_hash": [state.hexdigest()]})

    digest.__annotations__ = {"key": tuple, "batches": Iterator[pd.DataFrame], "return": Iterator[pd.DataFrame]}
    ordered = sized.filter("_pieces > 1").drop("_pieces").repartition(source, "span_no").sortWithinPartitions(
        source, "span_no", "piece")
    schema = f"`{source}` {pieces.schema[source].dataType.simpleString()}, span_no bigint, text_hash string"
    return short.unionByName(ordered.groupBy(source, "span_no").applyInPandas(digest, schema))


def span_evidence(pieces: DataFrame, source: str, text: str, block: int = BLOCK) -> DataFrame:
    """Court and circuit of each span: markers in precedence over its whole text, then the earliest line that names one."""
    line = lines(F.col(text))
    more = {"_named": X.field_line(line, "محكمة", require=P.COURT_LINE_MARKERS), "span_circuit": X.field_line(line, "الدائرة")}
    found = segment.span_court(pieces, source, normalise(F.col(text)), more=more, block=block)
    return found.select(source, "span_no", F.coalesce("court", "_named").alias("span_court"), "span_circuit")


def extract_cases(pages: DataFrame, *, reference_only: tuple[str, ...] = (), piece_pages: int = PIECE_PAGES,
                  block: int = BLOCK) -> Cases:
    """Volumes to independent cases. ``pages`` is (source_file, page_no, text), page_no from 1."""
    src, page = "source_file", "page_no"
    excluded = segment.index_volumes(pages, src, page, "text", names=reference_only)
    sources = pages.groupBy(src).agg(F.max(page).alias("pages"))
    gated = cut(sources.join(excluded.withColumn("_out", F.lit(True)), src, "left"))
    open_pages = lookup(pages, gated.filter(F.col("_out").isNull()).select(src), [src], [src, page], "left_semi")

    read = open_pages.select(src, page, normalise(F.col("text")).alias("_t"), lines(F.col("text")).alias("_l"))
    meta = X.page_metadata(F.col("_t"), F.col("_l"))
    described = read.select(src, page, F.length("_t").alias("_size"), *[c.alias(n) for n, c in meta.items()])
    described = cut(described)
    proof = segment.page_evidence_of(F.col("_size"), [F.col(c) for c in NUMBERS], F.col("decision_date"), F.col("subject"))
    starts = segment.boundaries(described.filter(proof), src, page, NUMBERS, block=block, keep_block=True)
    found = cut(segment.spans(starts, src, page, gated.select(src, "pages"), "pages", block=block))

    marks = found.select(src, page, F.lit(True).alias("_start"))
    marked = open_pages.select(src, page, "text").join(marks, [src, page], "left").withColumn(
        "_start", F.coalesce("_start", F.lit(False)))
    texts = cut(segment.span_text(marked, src, page, "text", "_start", piece_pages=piece_pages, block=block))
    first_pages = texts.groupBy(src, "span_no").agg(F.min("first_page").alias(page))
    facts = first_pages.join(span_hashes(texts, src, "span_text"), [src, "span_no"]).join(
        span_evidence(texts, src, "span_text", block), [src, "span_no"])

    spans = found.join(facts, [src, page])
    year, volume = urls.year_of(F.col(src)), urls.volume_of(F.col(src))
    reference = X.reference(F.col(page), *[F.col(c) for c in NUMBERS])
    spans = spans.select(
        ids.record_id(year, volume, F.col(page), reference).alias("id"), src, F.col(page).alias("start_page"), "end_page",
        "span_no", *NUMBERS, "decision_date", "subject", F.coalesce("span_court", "court").alias("court"),
        F.coalesce("span_circuit", "circuit").alias("circuit"), year.alias("year"), volume.alias("volume"), "text_hash",
    )
    # Arrival order is by file name, then page; ids may repeat, so the key is the position.
    spans = cut(spans.withColumn("_key", F.concat_ws("#", src, F.lpad(F.col("start_page").cast("string"), 9, "0"))))
    titled = spans.filter(F.col("subject").isNotNull())
    fate = dedup.greedy(titled.select("_key", F.col("_key").alias("_order"), "id", "text_hash"), "_key", "_order", ["id", "text_hash"])
    judged = cut(spans.join(fate, "_key", "left"))
    # The id is looked at first, also of a span without a subject: an earlier accepted record may hold it.
    holders = judged.filter(F.col("status") == "accepted").groupBy("id").agg(F.min("_key").alias("_held"))
    looked = judged.join(holders, "id", "left")
    repeated = (F.col("method") == "id") | (F.col("subject").isNull() & F.coalesce(F.col("_held") < F.col("_key"), F.lit(False)))
    reason = F.when(repeated, "duplicate_record_id").when(F.col("subject").isNull(), "missing_source_subject")
    skipped = looked.withColumn("reason", reason).filter(F.col("reason").isNotNull()).select("id", src, "start_page", "end_page", "reason")
    owners = judged.select(F.col("_key").alias("canonical_id"), F.col("id").alias("_canonical"))
    duplicates = judged.filter(F.col("method") == "text_hash").join(owners, "canonical_id").select(
        F.col("id").alias("candidate_id"), src, "start_page", "end_page", "text_hash",
        F.lit("exact_normalized_text").alias("match_method"), F.col("_canonical").alias("canonical_id"))

    kept = judged.filter(F.col("status") == "accepted").drop("status", "canonical_id", "method", "_key")
    kept = kept.withColumn("pages", F.col("end_page") - F.col("start_page") + 1).withColumn(
        "missing", X.missing_fields({c: F.col(c) for c in REQUIRED}))
    members = cut(collisions.symmetric(kept, "id", NUMBERS))
    reasons = collisions.collision_reasons(members, "id")
    records = cut(kept.join(reasons, "id", "left").select(
        *[c for c in kept.columns if c != "missing"],
        F.array_sort(F.array_union("missing", F.coalesce("reasons", F.array().cast("array<string>")))).alias("missing_requirements"),
        F.when(F.col("reasons").isNotNull(), COLLIDED).when(F.size("missing") > 0, INCOMPLETE).otherwise(COMPLETE).alias("review_status"),
    ))
    detected = found.groupBy(src).agg(F.count(F.lit(1)).alias("detected_boundaries"))
    indexed = records.groupBy(src).agg(
        F.count_if(F.col("review_status") == COMPLETE).alias("indexed"), F.count_if(F.size("missing_requirements") > 0).alias("_open"))
    log = gated.join(detected, src, "left").join(indexed, src, "left").select(
        src, "pages", F.coalesce("detected_boundaries", F.lit(0).cast("long")).alias("detected_boundaries"),
        F.coalesce("indexed", F.lit(0).cast("long")).alias("indexed"),
        F.when(F.col("_out"), "reference_only").when(F.col("detected_boundaries").isNull(), "needs_review").otherwise("indexed").alias("status"),
        F.when(F.col("_out"), "bibliographic_index_not_a_judgment_source")
        .when(F.col("detected_boundaries").isNull(), "no_verified_case_boundaries_detected")
        .when(F.coalesce("_open", F.lit(0)) == 0, "case_pdfs_created")
        .otherwise("case_pdfs_created_with_metadata_review_required").alias("notes"))
    return Cases(records, duplicates, skipped, members, log, texts)


def split_library(payloads: DataFrame) -> DataFrame:
    """Landed texts (id, text) to independent documents (id, part, document_type, text)."""
    ready = payloads.select("id", normalise(F.col("text"), "library").alias("_t"))
    typed = ready.select("id", "_t", rules.library_type(F.col("_t")).alias("document_type"))
    judgment = segment.split_document(F.col("_t"), [P.LIBRARY_DEED, P.LIBRARY_CASE])
    circular = segment.split_document(F.col("_t"), [P.LIBRARY_CIRCULAR])
    whole = F.when(F.col("_t") != "", F.array("_t")).otherwise(F.array().cast("array<string>"))
    parts = F.when(F.col("document_type") == "حكم قضائي", judgment).when(F.col("document_type") == "تعميم", circular).otherwise(whole)
    return typed.select("id", "document_type", F.posexplode(parts).alias("_p", "text")).select(
        "id", (F.col("_p") + 1).alias("part"), "document_type", "text")


@dataclass
class Import:
    accepted: DataFrame
    duplicates: DataFrame
    candidates: DataFrame
    rejected: DataFrame
    violations: DataFrame


def import_library(records: DataFrame, order: str = "ord") -> Import:
    """Enrich records with what their text shows, drop confirmed duplicates, keep the rest for review.

    ``records`` has id, ord, text, source_checksum, source_url, source_file and any given
    fields. Equal text, source, deed or judgment number confirms; a case number alone
    only raises a candidate.
    """
    given = lambda c: F.col(c) if c in records.columns else F.lit(None).cast("string")
    ready = records.withColumn("_t", normalise(F.col("text"), "deposit"))
    told = lambda c: none_if_empty(normalise(given(c).cast("string"), "deposit"))
    numbers = {n: told(n) for n in P.IMPORT_PATTERNS} | {"lawsuit_number": F.coalesce(told("lawsuit_number"), told("case_number"))}
    fields = {n: F.coalesce(X.either(numbers[n], X.first_match(F.col("_t"), p)), F.lit("")) for n, p in P.IMPORT_PATTERNS.items()}
    rich = ready.select(
        "id", order, rules.verified_type(told("document_type"), F.col("_t")).alias("document_type"),
        X.either(told("title"), F.substring("_t", 1, 220)).alias("title"), F.col("text").alias("extracted_text"),
        (F.col("_t") != "").alias("_has_text"), sha256(F.col("_t")).alias("text_checksum"),
        F.coalesce(told("source_checksum"), F.lit("")).alias("source_checksum"),
        *[F.coalesce(F.trim(given(c)), F.lit("")).alias(c) for c in ("source_url", "source_file")],
        given("year").alias("_year"), F.substring("_t", 1, 1000).alias("_top"), *[c.alias(n) for n, c in fields.items()])
    dated = X.first_match(F.concat_ws(" ", "date", "_top"), [r"(?U)\b(1[34][0-9]{2})\b"])
    rich = cut(rich.withColumn("year", F.coalesce(X.either(F.col("_year"), dated), F.lit(""))).drop("_year", "_top"))

    reason = F.when(~F.col("_has_text"), "missing_extracted_text").when(
        V.blank(F.col("id")) | (F.coalesce("title", F.lit("")) == "") | (F.col("source_checksum") == "")
        | ((F.col("source_url") == "") & (F.col("source_file") == "")), "missing_required_metadata")
    rejected = rich.withColumn("reason", reason).filter(F.col("reason").isNotNull()).select("id", "reason")
    usable = rich.filter(reason.isNull()).drop("_has_text")
    keys = ["text_checksum", "source_checksum", "deed_number", "judgment_number"]
    methods = ["exact_normalized_text", "exact_source_checksum", "confirmed_deed_number", "confirmed_judgment_number"]
    fate = cut(dedup.greedy(usable.select("id", order, *keys), "id", order, keys))
    label = F.create_map(*[F.lit(x) for pair in zip(keys, methods, strict=True) for x in pair])
    duplicates = fate.filter(F.col("status") == "duplicate").select("id", "canonical_id", label[F.col("method")].alias("method"))
    accepted = cut(usable.join(fate.filter(F.col("status") == "accepted").select("id"), "id"))
    hits = dedup.soft_hits(accepted.select("id", order, "lawsuit_number"), "id", order, ["lawsuit_number"])
    candidates = hits.select("id", "possible_canonical", F.lit("case_number_only").alias("reason"),
                             F.lit("kept_pending_review").alias("disposition"))
    return Import(accepted, duplicates, candidates, rejected, import_violations(accepted))


def import_violations(records: DataFrame) -> DataFrame:
    """The publication suite of imported records."""
    kind = F.col("document_type")
    judgment = kind.isin("حكم قضائي", "حكم قضائي دولي")
    any_of = lambda *cs: reduce(lambda a, b: a | b, [~V.blank(F.col(c)) for c in cs])
    row = [
        *V.required({c: F.col(c) for c in ("id", "document_type", "title", "text_checksum")}),
        V.domain("unrecognized_type", kind, P.DOCUMENT_TYPES),
        V.pattern("invalid_text_checksum", F.col("text_checksum"), V.HEX64),
        V.implies("judgment_without_number", judgment, any_of("deed_number", "judgment_number", "lawsuit_number"), kind, "warning"),
        V.implies("judgment_without_source", judgment, any_of("source_file", "source_url"), kind),
        V.implies("circular_without_number_and_source", kind == "تعميم", any_of("circular_number", "source_url", "source_file"), kind),
        V.implies("decision_without_number_and_source", kind == "قرار", any_of("decision_number", "source_url", "source_file"), kind, "warning"),
        V.implies("principle_without_source", kind.isin("مبدأ قضائي", "سابقة قضائية"), any_of("source_file", "source_url"), kind),
        V.Rule("hash_not_recomputable", text_hash(F.col("extracted_text"), "deposit") != F.col("text_checksum"), F.col("text_checksum")),
    ]
    return V.all_of(V.row_rules(records, "id", row), V.unique(records, ["id"], "duplicate_id"),
                    V.unique(records, ["text_checksum"], "text_checksum_collision", "warning"))


def publish_cases(records: DataFrame, source_checksums: DataFrame, namespace: str = P.JUDGMENT_NAMESPACE) -> dict[str, DataFrame]:
    """Case records to rows of the published tables, with derived ids.

    ``source_checksums`` is (source_file, source_checksum), one row per file.
    """
    joined = lookup(records, source_checksums, ["source_file"], ["id"])
    document = ids.stable_id(namespace, "document", F.concat_ws(":", "source_checksum", "id"))
    rows = joined.withColumn("document_id", document)
    collided = F.col("review_status") == COLLIDED
    state = F.when(collided, COLLIDED).otherwise(INCOMPLETE)
    date = none_if_empty(normalise(F.col("decision_date"), "target"))
    documents = rows.select(
        F.col("document_id").alias("id"), F.lit("judgment").alias("document_type"), F.lit("judicial").alias("category"),
        F.lit("general").alias("subcategory"), F.col("subject").alias("title"),
        none_if_empty(normalise(F.col("deed_number"), "target")).alias("document_number"),
        none_if_empty(normalise(F.col("lawsuit_number"), "target")).alias("case_number"), date.alias("hijri_date"),
        F.coalesce(F.col("year"), F.substring(date, 1, 4)).alias("year"), F.col("subject"), F.lit("[]").alias("legal_articles"),
        ids.stable_id(namespace, "source-file", F.col("source_checksum")).alias("source_file_id"),
        F.col("start_page").cast("int").alias("source_page_start"), F.col("end_page").cast("int").alias("source_page_end"),
        F.col("text_hash").alias("content_hash"), F.col("text_hash").alias("normalized_text_hash"),
        F.lit("review").alias("status"), state.alias("review_status"), F.col("id").alias("legacy_id"))
    extra = F.array(*[F.lit(x) for x in ("circuit_unverified", "court_unverified", "judgment_number_missing")])
    reviews = rows.select("document_id", "source_file", state.alias("review_status"),
                          F.array_sort(F.array_union("missing_requirements", extra)).alias("reasons"), F.lit("review").alias("decision"))
    hit = rows.select("document_id", *NUMBERS, F.explode("missing_requirements").alias("_r")).filter(F.col("_r").startswith("reference_collision:"))
    hit = hit.withColumn("_field", F.regexp_replace("_r", "^reference_collision:", ""))
    value = reduce(lambda acc, c: acc.when(F.col("_field") == c, F.col(c)), NUMBERS[1:], F.when(F.col("_field") == NUMBERS[0], F.col(NUMBERS[0])))
    candidates = hit.select(
        ids.stable_id(namespace, "duplicate-candidate", F.concat_ws(":", "document_id", "_field")).alias("id"), "document_id",
        F.concat_ws(":", "_field", value).alias("matched_external_id"),
        F.when(F.col("_field") == "lawsuit_number", "same_case_number").otherwise("same_document_number").alias("match_type"),
        F.lit("review").alias("decision"))
    return {"legal_documents": documents, "field_review": reviews, "duplicate_candidates": candidates}


def eligible(documents: DataFrame, files: DataFrame, sources: DataFrame, index_types: tuple[str, ...] = ("blog_index",)) -> DataFrame:
    """What search may show: active, approved, official, processed, with a page range, no index class."""
    ok = (
        (F.col("status") == "active") & (F.col("review_status") == "approved") & ~F.col("document_type").isin(*index_types)
        & F.col("source_page_start").isNotNull() & F.col("source_page_end").isNotNull()
    )
    processed = files.filter(F.col("processing_status") == "processed").select(F.col("id").alias("source_file_id"), "source_id")
    official = sources.filter(F.col("is_official")).select(F.col("id").alias("source_id"))
    allowed = processed.join(official, "source_id", "left_semi").select("source_file_id")
    return lookup(documents.filter(ok), allowed, ["source_file_id"], ["id"], "left_semi")

