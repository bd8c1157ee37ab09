"""Shared references and titles: grounds for review, never for removal.

A group's members are rows, not arrays: listing every related id on every member
would grow with the square of the group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import collapse, fold_case, never_null, sha256
from .dedup import key_pairs
from .keyed import FAN, attach, keep, lookup, narrow
from .ordered import BLOCK, in_order


def symmetric(records: DataFrame, ident: str, fields: Sequence[str], fan: int = FAN) -> DataFrame:
    """Every member of a reference shared by two or more records.

    (ident, kind, value, members, first_member); the related ids of a member are the
    other rows of its (kind, value). Ids are unique in ``records``.
    """
    pairs = key_pairs(records.withColumn("_o", F.lit(0)), ident, "_o", fields).drop("_o", "rank")
    facts = [F.count(F.lit(1)).alias("members"), F.min(ident).alias("first_member")]
    return attach(pairs, ["kind", "value"], [ident], facts, fan).filter(F.col("members") > 1)


def collision_reasons(members: DataFrame, ident: str) -> DataFrame:
    """Sorted reasons per record; bounded by the number of reference fields."""
    reason = F.concat(F.lit("reference_collision:"), F.col("kind"))
    return members.groupBy(ident).agg(F.array_sort(F.collect_set(reason)).alias("reasons"))


def asymmetric(accepted: DataFrame, ident: str, order: str, fields: Sequence[str],
               existing: DataFrame | None = None, *, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """Members that collide with an existing or an earlier accepted record only.

    (ident, kind, value, earlier, latest_earlier, existing): ``latest_earlier`` links to
    the previous member, so the chain gives every related id without listing them twice.
    """
    pairs = key_pairs(accepted, ident, order, fields).drop("rank")
    ranked = in_order(pairs, ["kind", "value"], order, position="_n", previous={"latest_earlier": ident}, block=block)
    ranked = ranked.withColumn("earlier", F.col("_n") - 1).drop("_n")
    if existing is None:
        ranked = ranked.withColumn("existing", F.lit(0).cast("long"))
    else:
        known = existing.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("existing"))
        ranked = lookup(ranked, known, ["kind", "value"], [ident], "left", fan)
        ranked = ranked.withColumn("existing", F.coalesce("existing", F.lit(0).cast("long")))
    return ranked.filter((F.col("earlier") > 0) | (F.col("existing") > 0))


def prior_members(rows: DataFrame, key: str, ident: str, order: str, block: int = BLOCK) -> DataFrame:
    """How many earlier rows share the key, and the latest of them."""
    ranked = in_order(narrow(rows, ident, order, keys=[key]), [key], order, position="_n",
                      previous={"latest_prior": ident}, block=block)
    return ranked.withColumn("prior", F.col("_n") - 1).drop("_n")


def with_title_key(records: DataFrame, title: str) -> DataFrame:
    keyed = records.withColumn("title_key", fold_case(collapse(F.coalesce(F.col(title), F.lit("")))))
    return keep(keyed, F.col("title_key") != "", *records.columns, never_null(F.col("title_key")).alias("title_key"))


def title_groups(records: DataFrame, ident: str, order: str, title: str, text_hash: str) -> DataFrame:
    """Groups of two or more records under one case-folded title.

    Pre-aggregated by (title, hash), so neither level gathers a group.
    """
    keyed = with_title_key(records, title)
    by_hash = keyed.groupBy("title_key", F.coalesce(F.col(text_hash), F.lit("")).alias("_hash")).agg(
        F.count(F.lit(1)).alias("_n"),
        F.min(F.struct(F.col(order).alias("o"), F.col(title).alias("t"))).alias("_first"),
        F.min(ident).alias("_low"), F.max(ident).alias("_high"),
    )
    groups = by_hash.groupBy("title_key").agg(
        F.sum("_n").alias("candidate_count"),
        F.count(F.when(F.col("_hash") != "", 1)).alias("distinct_text_checksums"),
        (F.count(F.lit(1)) == 1).alias("_one"), F.min("_hash").alias("_least"),
        F.min("_first").getField("t").alias("title_as_first_seen"),
        F.min("_low").alias("first_candidate"), F.max("_high").alias("last_candidate"),
    )
    digest = sha256(F.col("title_key"))
    return groups.filter(F.col("candidate_count") > 1).select(
        F.concat(F.lit("title-collision-"), F.substring(digest, 1, 20)).alias("review_id"),
        digest.alias("normalized_title_sha256"), "title_as_first_seen", "first_candidate", "last_candidate",
        "candidate_count", "distinct_text_checksums",
        (F.col("_one") & (F.col("_least") != "")).alias("exact_text_duplicate"),
    )


def title_members(records: DataFrame, ident: str, title: str, fan: int = FAN) -> DataFrame:
    """Candidate rows (review_id, ident) of the title groups."""
    keyed = with_title_key(records, title).select(F.col(ident), never_null(sha256(F.col("title_key"))).alias("_title"))
    counted = attach(keyed, ["_title"], [ident], [F.count(F.lit(1)).alias("_n")], fan).filter(F.col("_n") > 1)
    return counted.select(
        F.concat(F.lit("title-collision-"), F.substring("_title", 1, 20)).alias("review_id"), F.col(ident)
    )
