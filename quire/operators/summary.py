"""Counts, completeness and run summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import present
from .keyed import narrow
from .ordered import BLOCK, number_batches


def counts(df: DataFrame, *by: str, name: str = "records") -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias(name))


def completeness(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Non-empty values per field: one pass over the data, then one row per field."""
    one = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count_if(present(F.col(f))).alias(f) for f in fields])
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("filled"), F.col("_rows").alias("records")) for f in fields])
    return one.select(F.inline(rows))


def duplicate_counts(df: DataFrame, key: str) -> DataFrame:
    """Exact distinct and surplus counts of a key, pre-aggregated by the key."""
    per_key = narrow(df, keys=[key]).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return per_key.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("records"),
        F.count(F.lit(1)).alias("distinct_keys"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicates"),
    )


def source_rollup(df: DataFrame, source: str, kind: str) -> DataFrame:
    """Affected records and the sorted distinct kinds of each source (kinds are a small domain)."""
    per_kind = df.groupBy(source, kind).agg(F.count(F.lit(1)).alias("_n"))
    return per_kind.groupBy(source).agg(
        F.sum("_n").alias("affected_records"), F.array_sort(F.collect_set(kind)).alias("kinds")
    )


def group_equals(df: DataFrame, group: str, value: str, expected: Column) -> DataFrame:
    """Does each group represent exactly the expected value? Min and max suffice, no set is built."""
    return df.groupBy(group).agg(
        F.min(value).alias("least"), F.max(value).alias("greatest"), F.count(F.lit(1)).alias("records")
    ).select(group, "records", ((F.col("least") == expected) & (F.col("greatest") == expected)).alias("set_equal"))


def accounting(df: DataFrame, outcome: str) -> DataFrame:
    """One batch row; imported never exceeds detected."""
    is_ = lambda label: F.count_if(F.col(outcome) == label)
    return df.agg(
        F.count(F.lit(1)).alias("documents_detected"),
        is_("imported").alias("documents_imported"), is_("duplicate").alias("duplicates_count"),
        is_("review").alias("review_count"), is_("rejected").alias("rejected_count"), is_("failed").alias("failed_count"),
    ).withColumn("consistent", F.col("documents_imported") <= F.col("documents_detected"))


def batch_manifest(df: DataFrame, ident: str, order: str, size: int, block: int = BLOCK) -> DataFrame:
    """Number, count, first and last id and payload bytes of each batch."""
    payload = F.octet_length(F.to_json(F.struct(*df.columns)))
    numbered = number_batches(df.select(F.col(ident), payload.cast("long").alias("_bytes"), *(
        [] if order == ident else [F.col(order)])), order, size, block=block)
    return numbered.groupBy("batch").agg(
        F.count(F.lit(1)).alias("records"), F.min_by(ident, order).alias("first_id"),
        F.max_by(ident, order).alias("last_id"), F.sum("_bytes").alias("bytes"),
    )


def reason_tally(df: DataFrame, reasons: str) -> DataFrame:
    return df.select(F.explode(reasons).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("records"))


def run_summary(df: DataFrame, counters: dict[str, Column]) -> DataFrame:
    """One row of named counters, all from a single pass."""
    return df.agg(*[c.alias(n) for n, c in counters.items()])


def counter_map(df: DataFrame, key: str) -> DataFrame:
    """The counters of a small domain as one sorted map."""
    per_key = counts(df, key)
    entries = F.array_sort(F.collect_list(F.struct(F.col(key), F.col("records"))))
    return per_key.agg(F.map_from_entries(entries).alias("counters"))
