"""Data-quality rules: every check yields violation rows of one shape.

(rule, severity, id, detail). Row rules of a table share one scan; key and reference
rules aggregate before they exchange.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEX64 = "^[0-9a-f]{64}$"


@dataclass(frozen=True)
class Rule:
    name: str
    violated: Column
    detail: Column
    severity: str = "error"


def blank(col: Column) -> Column:
    return F.coalesce(F.trim(col.cast("string")), F.lit("")) == ""


def required(fields: Mapping[str, Column], when: Column | None = None, severity: str = "error") -> list[Rule]:
    return [
        Rule(f"missing_{name}", (blank(c) if when is None else when & blank(c)), F.lit(name), severity)
        for name, c in fields.items()
    ]


def domain(name: str, col: Column, allowed: Sequence[str], severity: str = "warning") -> Rule:
    return Rule(name, col.isNotNull() & ~col.isin(*allowed), col.cast("string"), severity)


def pattern(name: str, col: Column, regex: str, severity: str = "error") -> Rule:
    return Rule(name, col.isNotNull() & ~col.rlike(regex), col.cast("string"), severity)


def page_range(start: Column, end: Column, last: Column | None = None) -> Rule:
    """Both or neither; 1 <= start <= end <= last."""
    bad = (start.isNull() != end.isNull()) | (start < 1) | (end < start)
    if last is not None:
        bad = bad | (end > last)
    return Rule("page_range", F.coalesce(bad, F.lit(False)), F.concat_ws("-", start.cast("string"), end.cast("string")))


def implies(name: str, premise: Column, conclusion: Column, detail: Column, severity: str = "error") -> Rule:
    return Rule(name, premise & ~F.coalesce(conclusion, F.lit(False)), detail, severity)


def _shape(df: DataFrame, rule: str, severity: str, ident: Column, detail: Column) -> DataFrame:
    return df.select(
        F.lit(rule).alias("rule"), F.lit(severity).alias("severity"),
        ident.cast("string").alias("id"), detail.cast("string").alias("detail"),
    )


def row_rules(df: DataFrame, ident: str, rules: Sequence[Rule]) -> DataFrame:
    """All row rules in one scan."""
    found = F.array(*[
        F.when(r.violated, F.struct(
            F.lit(r.name).alias("rule"), F.lit(r.severity).alias("severity"),
            F.col(ident).cast("string").alias("id"), r.detail.cast("string").alias("detail"),
        )) for r in rules
    ])
    return df.select(F.inline(F.array_compact(found)))


def unique(df: DataFrame, keys: Sequence[str], rule: str, severity: str = "error") -> DataFrame:
    """Keys that occur more than once: one row per key, with the count."""
    repeated = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1)
    return _shape(repeated, rule, severity, F.concat_ws("|", *[F.col(k).cast("string") for k in keys]), F.col("_n"))


def orphans(child: DataFrame, foreign: str, parent: DataFrame, key: str, rule: str, severity: str = "error") -> DataFrame:
    """Foreign keys without a parent: one row per missing key, with the rows it affects."""
    used = child.filter(F.col(foreign).isNotNull()).groupBy(foreign).agg(F.count(F.lit(1)).alias("_n"))
    there = parent.select(F.col(key).alias(foreign)).distinct()
    return _shape(used.join(there, foreign, "left_anti"), rule, severity, F.col(foreign), F.col("_n"))


def edge_rules(edges: DataFrame, start: str, end: str, kind: str) -> DataFrame:
    """No self-edge, no repeated edge."""
    selfs = _shape(edges.filter(F.col(start) == F.col(end)), "self_edge", "error", F.col(start), F.col(kind))
    return selfs.unionByName(unique(edges, [start, end, kind], "repeated_edge"))


def equal_counts(name: str, left: DataFrame, right: DataFrame) -> DataFrame:
    """Two counts side by side and whether they agree."""
    zero = F.lit(0).cast("long")
    a = left.agg(F.count(F.lit(1)).alias("left_rows")).withColumn("right_rows", zero)
    b = right.agg(F.count(F.lit(1)).alias("right_rows")).withColumn("left_rows", zero)
    both = a.unionByName(b).agg(F.sum("left_rows").alias("left_rows"), F.sum("right_rows").alias("right_rows"))
    return both.select(F.lit(name).alias("check"), "left_rows", "right_rows",
                       (F.col("left_rows") == F.col("right_rows")).alias("valid"))


def class_counts(df: DataFrame, label: str, expected: Sequence[tuple[str, int]]) -> DataFrame:
    """Histogram against the expected one."""
    actual = df.groupBy(label).agg(F.count(F.lit(1)).alias("actual"))
    table = df.sparkSession.createDataFrame(list(expected), f"{label} string, expected long")
    joined = actual.join(table, label, "full_outer")
    zero = F.lit(0).cast("long")
    return joined.select(
        label, F.coalesce("actual", zero).alias("actual"), F.coalesce("expected", zero).alias("expected"),
        F.coalesce(F.col("actual") == F.col("expected"), F.lit(False)).alias("equal"),
    )


def all_of(*violations: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), violations)


def report(violations: DataFrame) -> DataFrame:
    """One row: valid when no error is left, with counts by severity."""
    return violations.agg(
        F.count_if(F.col("severity") == "error").alias("errors"),
        F.count_if(F.col("severity") == "warning").alias("warnings"),
        F.count(F.lit(1)).alias("findings"),
    ).withColumn("valid", F.col("errors") == 0)


def capped(violations: DataFrame, order: Sequence[str], shown: int = 100) -> tuple[DataFrame, DataFrame]:
    """The whole count, and the first rows for the report."""
    return report(violations), violations.orderBy(*order).limit(shown)
