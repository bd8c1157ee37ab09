"""Per-key facts on every row without gathering a key in one task.

A window over a key sorts that whole key in one task; a hot key would hold a third
of the table there. These operators spread a key's rows over ``fan`` salts instead.
The per-key side is aggregated map-side and repeated once for each salt that
really occurs, so it never outgrows the rows and nothing is broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FAN = 256
BUCKETS, CROWDED = 4096, 200_000


def salt_of(by: Sequence[str], fan: int) -> Column:
    return F.coalesce(F.pmod(F.xxhash64(*by), F.lit(fan)).cast("int"), F.lit(0))


def spread(rows: DataFrame, keys: Sequence[str], by: Sequence[str], fan: int = FAN) -> DataFrame:
    """Lay rows out by key and salt. ``by`` names the row's id, which is not NULL.

    Both consumers below read this one exchange, so the rows are computed once. For that
    they must ask for the same columns and filters: the ids are filtered here rather than
    by a later join, and the per-key side derives its salts from the ids again.
    """
    for name in by:
        if rows.schema[name].nullable:
            rows = rows.filter(F.col(name).isNotNull())
    return rows.withColumn("_salt", salt_of(by, fan)).repartition(*keys, "_salt")


def narrow(rows: DataFrame, *names: str, keys: Sequence[str] = ()) -> DataFrame:
    """The named columns once each, without rows whose key is NULL.

    A column known to hold no NULL is not filtered: the filter would be pushed below the
    projection that computes it.
    """
    picked = rows.select(*dict.fromkeys([*names, *keys]))
    for k in keys:
        if picked.schema[k].nullable:
            picked = picked.filter(F.col(k).isNotNull())
    return picked


def keep(rows: DataFrame, condition: Column, *columns: Column | str) -> DataFrame:
    """Filter after a projection, not below it.

    Catalyst pushes a filter on a computed column under the projection and repeats the
    computation for each mention. Unpacking none or one row leaves it where it is. Use it
    for conditions on text that a projection has just normalised.
    """
    row = F.struct(*columns)
    return rows.select(F.inline(F.filter(F.array(row), lambda _: condition)))


def attach(rows: DataFrame, keys: Sequence[str], by: Sequence[str], facts: Sequence[Column],
           fan: int = FAN) -> DataFrame:
    """Add aggregate columns of each row's key. Keys must not be NULL.

    Pass narrow rows: ids, keys and what the facts need. Wide columns rejoin by id.
    """
    laid = spread(rows, keys, by, fan)
    per_key = laid.groupBy(*keys).agg(*facts, F.collect_set(salt_of(by, fan)).alias("_salts"))
    per_key = per_key.withColumn("_salt", F.explode("_salts")).drop("_salts")
    return laid.join(per_key, [*keys, "_salt"]).drop("_salt")


def lookup(rows: DataFrame, table: DataFrame, keys: Sequence[str], by: Sequence[str], how: str = "left",
           fan: int = FAN) -> DataFrame:
    """Join rows to a table holding each key once, however skewed the rows are.

    The distinct (key, salt) pairs of the rows meet the table first, at most ``fan`` of a
    key; the match then travels to the salts in use.
    """
    laid = spread(rows, keys, by, fan)
    # Grouping by the ids' salt, not by the column, keeps the ids in the shared exchange.
    used = laid.groupBy(*keys, salt_of(by, fan).alias("_salt")).agg(F.lit(1).alias("_one")).drop("_one")
    matched = used.join(table, [*keys], "left" if how == "left" else "inner")
    if how == "left_semi":
        matched = matched.select(*keys, "_salt")
    return laid.join(matched, [*keys, "_salt"], how).drop("_salt")


def crowded(rows: DataFrame, keys: Sequence[str], least: int = CROWDED) -> list[int]:
    """Buckets of the keys' hash with more than ``least`` rows and over four times their share: a key with so many rows lies in one.

    Only the counts of at most ``BUCKETS`` buckets are exchanged and reach the driver.
    """
    found = rows.groupBy(bucket_of(keys).alias("_bucket")).agg(F.count(F.lit(1)).alias("_n")).collect()
    share = 4 * sum(r["_n"] for r in found) / BUCKETS
    return sorted(r["_bucket"] for r in found if r["_n"] > max(least, share))


def bucket_of(keys: Sequence[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")


def lookup_mostly_even(rows: DataFrame, table: DataFrame, keys: Sequence[str], by: Sequence[str], fan: int = FAN,
                       least: int = CROWDED) -> DataFrame:
    """``lookup`` for keys most of which have few rows: rows and table meet in one exchange each, and only rows of
    crowded buckets are salted. The keys are read once more beforehand, to count the buckets."""
    heavy = crowded(rows.select(*keys), keys, least)
    if not heavy:
        return rows.join(table, [*keys], "left")
    apart = bucket_of(keys).isin(heavy)
    even = rows.filter(~apart).join(table.filter(~apart), [*keys], "left")
    return even.unionByName(lookup(rows.filter(apart), table.filter(apart), keys, by, "left", fan))
