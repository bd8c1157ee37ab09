"""Constraints of the published tables as rule rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import DOMAINS
from . import validate as V

C = F.col


def _counts(names: list[str]) -> list[V.Rule]:
    return [V.Rule(f"{n}_negative", C(n) < 0, C(n).cast("string")) for n in names]


def rules_of(table: str) -> list[V.Rule]:
    rules = [
        V.domain(f"{column}_domain", C(column), allowed, "error")
        for (name, column), allowed in DOMAINS.items() if name == table
    ]
    if table == "source_files":
        rules += [V.pattern("sha256_format", C("sha256"), V.HEX64), *_counts(["file_size", "page_count"])]
    elif table == "legal_documents":
        rules += [
            V.pattern("content_hash_format", C("content_hash"), V.HEX64),
            V.pattern("normalized_hash_format", C("normalized_text_hash"), V.HEX64),
            V.page_range(C("source_page_start"), C("source_page_end")),
        ]
    elif table == "document_files":
        rules += [
            V.pattern("sha256_format", C("sha256"), V.HEX64), *_counts(["file_size"]),
            V.Rule("page_count_positive", C("page_count") < 1, C("page_count").cast("string")),
            V.implies("download_block", C("is_downloadable"), C("download_block_reason").isNull(), C("download_block_reason")),
        ]
    elif table == "document_relations":
        rules += [V.Rule("self_edge", C("from_document_id") == C("to_document_id"), C("relation_type"))]
    elif table == "archive_batches":
        rules += _counts(["files_count", "documents_detected", "documents_imported", "duplicates_count",
                          "review_count", "rejected_count", "failed_count"])
        rules += [V.Rule("imported_exceeds_detected", C("documents_imported") > C("documents_detected"),
                         C("documents_imported").cast("string"))]
    elif table == "duplicate_candidates":
        rules += [
            V.Rule("score_range", (C("similarity_score") < 0) | (C("similarity_score") > 1), C("similarity_score").cast("string")),
            V.Rule("target_missing", C("matched_document_id").isNull() & C("matched_external_id").isNull(), F.lit("target")),
            V.Rule("self_match", C("matched_document_id") == C("document_id"), C("document_id")),
        ]
    elif table == "document_chunks":
        rules += [*_counts(["chunk_index"]), V.page_range(C("page_start"), C("page_end"))]
    return rules


def check_table(df: DataFrame, table: str, ident: str = "id") -> DataFrame:
    """Row constraints of one published table plus its unique id."""
    return V.row_rules(df, ident, rules_of(table)).unionByName(V.unique(df, [ident], "duplicate_id"))
