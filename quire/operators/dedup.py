"""Duplicate resolution: confirmed by equal strong keys, otherwise review."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..session import cut
from .components import ONE_TASK, components
from .keyed import FAN, attach, lookup, narrow

ROOM = 2_000_000  # contested keys of one component that a task may fold


def key_pairs(records: DataFrame, ident: str, order: str, keys: Sequence[str]) -> DataFrame:
    """One row per record and non-empty key: (ident, order, rank, kind, value)."""
    entries = [
        F.struct(F.lit(i).alias("rank"), F.lit(k).alias("kind"), F.col(k).cast("string").alias("value"))
        for i, k in enumerate(keys)
    ]
    return (
        records.select(F.col(ident), F.col(order), F.inline(F.array(*entries)))
        .filter(F.col("value").isNotNull() & (F.col("value") != ""))
    )


def first_wins(rows: DataFrame, key: str, ident: str, order: str, fan: int = FAN) -> DataFrame:
    """The first row of a key stays; every row learns its canonical id. A NULL key is shared with no one."""
    known = attach(
        narrow(rows, ident, order, keys=[key]), [key], [ident],
        [F.min(order).alias("_first"), F.min_by(ident, order).alias("canonical_id")], fan,
    )
    known = known.withColumn("is_first", F.col(order) == F.col("_first")).drop("_first")
    if not rows.schema[key].nullable:
        return known
    alone = rows.filter(F.col(key).isNull()).withColumns({"canonical_id": F.col(ident), "is_first": F.lit(True)})
    return known.unionByName(alone.select(*known.columns))


def first_seen(rows: DataFrame, ident: str, order: str, exact: str, reference: str, fan: int = FAN) -> DataFrame:
    """Exact key first, else shared reference; the canonical is the first seen of each."""
    def canonical(key: str, name: str) -> DataFrame:
        rows_of_key = narrow(rows, ident, order, keys=[key])
        return attach(rows_of_key, [key], [ident], [F.min_by(ident, order).alias(name)], fan).select(ident, order, name)

    # Side by side and joined by id: chained, the second would compute the first twice.
    # The order rides along, so that both uses of a key's layout ask for the same columns.
    seen = canonical(exact, "_exact").join(canonical(reference, "_reference"), [ident, order])
    mine = F.col(ident)
    return seen.select(
        ident,
        F.when(F.col("_exact") != mine, "exact_hash").when(F.col("_reference") != mine, "reference").alias("match_type"),
        F.when(F.col("_exact") != mine, F.col("_exact"))
        .when(F.col("_reference") != mine, F.col("_reference")).alias("canonical_id"),
        F.when(F.col("_exact") != mine, "duplicate").otherwise("review").alias("status"),
    )


def greedy(records: DataFrame, ident: str, order: str, keys: Sequence[str], owned: DataFrame | None = None,
           fan: int = FAN, room: int = ROOM, one_task: int = ONE_TASK) -> DataFrame:
    """Sequential multi-key dedup.

    A record is rejected when any of its keys is held by an earlier *accepted* record;
    rejected records hold nothing. Records of different components (records that keys link) do not
    touch each other, so each component is folded in order inside a task that streams its rows. Only a component
    of more than ``room`` keys is settled in rounds instead. Records whose keys nobody shares need neither.
    ``owned`` (kind, value, owner) lists keys held before the first record.

    Returns (ident, status, canonical_id, method), one row per record. ``order`` is unique
    and of any sortable type.
    """
    # The rank stands for the kind; a column that only one use of the layout needs would be a second exchange.
    pairs = key_pairs(records, ident, order, keys).drop("kind")
    by = ["rank", "value"]
    counted = attach(pairs, by, [ident], [F.count(F.lit(1)).alias("_holders"), F.min(order).alias("_least")], fan)
    if owned is not None:
        rank = F.array_position(F.array(*map(F.lit, keys)), F.col("kind")).cast("int") - 1
        held = owned.select(rank.alias("rank"), "value", "owner").groupBy(*by).agg(F.min(F.col("owner").cast("string")).alias("_owner"))
        counted = lookup(counted, held, by, [ident], "left", fan)
    else:
        counted = counted.withColumn("_owner", F.lit(None).cast("string"))
    contested = cut(counted.filter((F.col("_holders") > 1) | F.col("_owner").isNotNull()).drop("_holders"))
    if isinstance(contested.schema[order].dataType, IntegralType):
        contested = contested.withColumns({"_n": F.col(order).cast("long"), "_least": F.col("_least").cast("long")})
    else:
        # Sorted by the order and written, so that the numbers follow it and stay.
        numbered = cut(contested.select(order).distinct().orderBy(order).select(order, F.monotonically_increasing_id().alias("_n")))
        least = numbered.select(F.col(order).alias("_least"), F.col("_n").alias("_first"))
        contested = cut(lookup(contested.join(numbered, order), least, ["_least"], [ident]).drop("_least").withColumnRenamed("_first", "_least"))
    star = contested.select("_n", "_least")
    labels = components(star, one_task).select(F.col("node").alias("_n"), F.col("root").alias("_label"))
    labelled = contested.join(labels, "_n", "left").withColumn("_label", F.coalesce("_label", "_n"))
    sizes = labelled.groupBy("_label").count().filter(F.col("count") > room)
    large = [r["_label"] for r in sizes.collect()]  # at most the contested keys over room
    kind = F.get(F.array(*map(F.lit, keys)), F.col("rank")).alias("kind")
    rejected = _folded(labelled.filter(~F.col("_label").isin(large)) if large else labelled, ident, kind)
    if large:
        rounds = labelled.filter(F.col("_label").isin(large)).drop("_label", "_n", "_least").withColumn("kind", kind)
        rejected = rejected.unionByName(_in_rounds(rounds, ident, order, owned, fan))
    return records.select(ident).join(rejected, ident, "left").select(
        ident, F.when(F.col("method").isNull(), "accepted").otherwise("duplicate").alias("status"), "canonical_id", "method",
    )


def _folded(labelled: DataFrame, ident: str, kind: Column) -> DataFrame:
    """The rejected records of each component, by the statement itself; a task holds the keys of one component."""
    kept = labelled.select("_label", "_n", "rank", "value", "_owner", ident)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label = record = None
        holders: dict[tuple[str, str], str] = {}
        mine: list[tuple[tuple[str, str], str | None]] = []
        out: list[tuple] = []

        def settle() -> None:
            if record is None:
                return
            for key, owner in mine:
                holder = owner if owner is not None else holders.get(key)
                if holder is not None:
                    out.append((record[1], holder, key[0]))
                    return
            for key, _ in mine:
                holders.setdefault(key, record[2])

        kind_of = None

        def rows() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [(), (), ()]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(columns[0], kind_of), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())], [ident, "canonical_id", "method"])

        for batch in batches:
            kind_of = batch.schema.field(6).type
            for at, n, _, kind, value, owner, who, name in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if record is None or n != record[0]:
                    settle()
                    record, mine = (n, who, name), []
                    if at != label:
                        label, holders = at, {}
                mine.append(((kind, value), owner))
            if out:
                yield rows()
        settle()
        if out:
            yield rows()

    schema = f"`{ident}` {labelled.schema[ident].dataType.simpleString()}, canonical_id string, method string"
    parts = int(labelled.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = kept.repartition(parts, "_label").sortWithinPartitions("_label", "_n", "rank")
    return dealt.select("_label", "_n", "rank", kind, "value", "_owner", ident, F.col(ident).cast("string").alias("_name")).mapInArrow(fold, schema)


def _in_rounds(contested: DataFrame, ident: str, order: str, owned: DataFrame | None, fan: int) -> DataFrame:
    """The rejected records as the complement of the first maximal independent set in order of arrival.

    Each round accepts the records that come first on all their keys and rejects those sharing a key with them.
    Few rounds do in practice; a chain of records that each share a key with the next needs about half its length.
    """
    by = ["kind", "value"]
    # A record has one row per key, so a window over its rows stays that short.
    mine = Window.partitionBy(ident)
    lost_before = F.max(F.col("_owner").isNotNull()).over(mine)
    state = contested.withColumn("_accepted", F.when(lost_before, F.lit(False))).drop("_owner")
    decided = [state.filter(F.col("_accepted").isNotNull())]
    open_pairs = state.filter(F.col("_accepted").isNull()).drop("_accepted")
    while True:
        ranked = attach(open_pairs, by, [ident], [F.min(order).alias("_least")], fan)
        wins = F.min(F.col(order) == F.col("_least")).over(mine)
        judged = ranked.withColumn("_wins", wins).drop("_least")
        told = attach(judged, by, [ident], [F.max("_wins").alias("_won")], fan)
        beaten = F.max("_won").over(mine)
        fate = F.when(F.col("_wins"), F.lit(True)).when(beaten, F.lit(False))
        state = cut(told.withColumn("_accepted", fate).drop("_wins", "_won"))
        decided.append(state.filter(F.col("_accepted").isNotNull()))
        open_pairs = state.filter(F.col("_accepted").isNull()).drop("_accepted")
        if open_pairs.isEmpty():
            break

    settled = reduce(DataFrame.unionByName, decided)
    holders = settled.filter("_accepted").select(
        *by, F.col(ident).cast("string").alias("_holder"), F.col(order).alias("_held_since")
    )
    if owned is not None:
        prior = contested.filter(F.col("_owner").isNotNull()).groupBy(*by).agg(F.min("_owner").alias("_holder"))
        prior = prior.withColumn("_held_since", F.lit(None).cast(contested.schema[order].dataType))
        holders = prior.unionByName(holders.join(prior.select(*by), by, "left_anti"))
    lost = settled.filter(~F.col("_accepted"))
    matched = lookup(lost, holders, by, [ident], "inner", fan)
    earlier = F.col("_held_since").isNull() | (F.col("_held_since") < F.col(order))
    rejected = matched.filter(earlier).groupBy(ident).agg(
        F.min_by(F.struct(F.col("_holder").alias("canonical_id"), F.col("kind").alias("method")), "rank").alias("_hit")
    )
    return rejected.select(ident, "_hit.canonical_id", "_hit.method")


def soft_hits(accepted: DataFrame, ident: str, order: str, keys: Sequence[str], fan: int = FAN) -> DataFrame:
    """Accepted records sharing an identity number with an earlier accepted one.

    They stay; the pair goes to review. The owner comes from the first key that hits,
    ``matches`` lists every key that does, in key order.
    """
    pairs = key_pairs(accepted, ident, order, keys)
    owned = attach(pairs, ["kind", "value"], [ident], [F.min_by(ident, order).alias("owner")], fan)
    hit = owned.filter(F.col("owner") != F.col(ident))
    return hit.groupBy(ident).agg(
        F.min_by("owner", "rank").alias("possible_canonical"),
        F.transform(F.array_sort(F.collect_set(F.struct("rank", "kind"))), lambda x: x["kind"]).alias("matches"),
    )


def review_status(is_duplicate: Column) -> Column:
    return F.when(is_duplicate, "exact_duplicate_confirmed").otherwise("original_document_missing")
