"""Schemas of the published tables and their value domains."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: the word lists, labels and names below must equal the archive's conventions.
_DDL = {
    "sources": "id string, name string, source_type string, organization string, url string, channel_url string, "
               "description string, is_official boolean, review_status string, created_at timestamp, updated_at timestamp",
    "source_files": "id string, source_id string, original_filename string, storage_path string, original_url string, "
                    "mime_type string, file_size long, sha256 string, page_count int, acquisition_source string, "
                    "acquired_at timestamp, processing_status string, created_at timestamp, updated_at timestamp",
    "legal_documents": "id string, document_type string, category string, subcategory string, title string, "
                       "document_number string, case_number string, judgment_number string, decision_number string, "
                       "circular_number string, court string, circuit string, issuing_authority string, "
                       "document_date date, hijri_date string, year string, subject string, summary string, "
                       "facts string, claims string, reasoning string, ruling string, principle_text string, "
                       "full_text string, legal_articles string, source_id string, source_file_id string, "
                       "source_page_start int, source_page_end int, original_source string, "
                       "acquisition_source string, source_url string, content_hash string, "
                       "normalized_text_hash string, status string, review_status string, published_at timestamp, "
                       "archived_at timestamp, created_at timestamp, updated_at timestamp",
    "document_files": "id string, document_id string, file_type string, storage_path string, download_filename string, "
                      "mime_type string, file_size long, sha256 string, page_count int, is_downloadable boolean, "
                      "download_block_reason string, created_at timestamp",
    "document_relations": "id string, from_document_id string, to_document_id string, relation_type string, "
                          "created_at timestamp",
    "keywords": "id string, name string, normalized_name string, created_at timestamp",
    "document_keywords": "document_id string, keyword_id string, created_at timestamp",
    "archive_batches": "id string, source_id string, batch_name string, started_at timestamp, completed_at timestamp, "
                       "files_count int, documents_detected int, documents_imported int, duplicates_count int, "
                       "review_count int, rejected_count int, failed_count int, status string, commit_sha string, "
                       "notes string, created_at timestamp",
    "duplicate_candidates": "id string, document_id string, matched_document_id string, matched_external_id string, "
                            "match_type string, similarity_score decimal(6,5), decision string, reason string, "
                            "reviewed_at timestamp, created_at timestamp",
    "document_chunks": "id long, document_id string, chunk_index int, chunk_text string, page_start int, page_end int, "
                       "created_at timestamp",
}


def table_schema(name: str) -> T.StructType:
    return T._parse_datatype_string(_DDL[name])


TABLES = tuple(_DDL)

# --- fixed values: domains of the published tables ----------------------------
DOMAINS = {
    ("sources", "review_status"): ["pending", "verified", "review", "rejected", "archived"],
    ("source_files", "processing_status"): ["pending", "processing", "processed", "review", "failed", "archived"],
    ("legal_documents", "document_type"): ["judgment", "circular", "decision", "principle", "precedent"],
    ("legal_documents", "status"): ["active", "draft", "review", "duplicate", "archived", "rejected"],
    ("document_relations", "relation_type"): [
        "based_on", "related_to", "appeal_of", "precedent_for", "principle_from", "supersedes", "references"],
    ("archive_batches", "status"): ["pending", "processing", "review", "completed", "failed", "rolled_back"],
    ("duplicate_candidates", "match_type"): [
        "exact_hash", "same_case_number", "same_document_number", "text_similarity", "metadata_similarity"],
    ("duplicate_candidates", "decision"): ["duplicate", "not_duplicate", "review"],
}
