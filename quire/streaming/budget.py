"""Budget admission, failure classes and cycle status."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..operators.ordered import BLOCK, in_order

ACQUIRED, MANUAL, FAILED, WAITING = "acquired", "manual_archival_required", "download_failed", "waiting"


def admit(rows: DataFrame, channel: str, order: str, size: str, *, retry: str | None = None, item_limit: int = P.ITEM_LIMIT_BYTES,
          cycle_budget: int = P.CYCLE_BUDGET_BYTES, per_cycle: int = P.POSTS_PER_CYCLE, block: int = BLOCK) -> DataFrame:
    """One cycle of each channel: greedy admission in post order under one budget.

    The cycle takes all retries (rows whose column ``retry`` is true) and the first ``per_cycle`` other posts; the
    rest wait for the next one. An item over the ceiling needs a person and uses no budget; one that does not fit
    any more is retried, and a later smaller one may still fit. That is a left fold, not a prefix sum, so a task
    streams a channel's cycle in order and carries the sum, whatever the number of retries. A size that is not known
    counts as 0: check the real one once the item is here (``over_limit``). A limit of 0 is none. A channel that is not known is one channel.
    """
    again = F.coalesce(F.col(retry), F.lit(False)) if retry else F.lit(False)
    kept = rows.select(F.col(channel), F.col(order), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias(size), again.alias("_again"))
    # A NULL channel would be left out of the ranking.
    named = kept.withColumn("_channel", F.struct(F.col(channel).alias("c"))).withColumn("_new", (~F.col("_again")).cast("long"))
    ranked = in_order(named, ["_channel"], order, running={"_n": "_new"}, block=block)
    taken = F.col("_again") | (F.col("_n") <= per_cycle)
    unlimited = 2**62  # a limit of 0 is none
    ceiling, budget = item_limit or unlimited, cycle_budget or unlimited

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, used = [], 0
        for batch in batches:
            status, before = [], []
            for name, bytes_ in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if [name] != held:
                    held, used = [name], 0
                before.append(used)
                if bytes_ > ceiling:
                    status.append(MANUAL)
                elif used + bytes_ > budget:
                    status.append(FAILED)
                else:
                    status.append(ACQUIRED)
                    used += bytes_
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(status, pa.string()), pa.array(before, pa.int64())], [*batch.schema.names, "status", "used_before"])

    cycle = ranked.filter(taken).select(channel, order, size, "_again").repartition(channel).sortWithinPartitions(channel, order)
    types = {f.name: f.dataType.simpleString() for f in cycle.schema.fields}
    schema = ", ".join(f"`{c}` {t}" for c, t in types.items()) + ", status string, used_before long"
    folded = cycle.mapInArrow(fold, schema)
    waiting = ranked.filter(~taken).select(channel, order, size, "_again", F.lit(WAITING).alias("status"), F.lit(None).cast("long").alias("used_before"))
    return folded.unionByName(waiting).withColumnRenamed("_again", "retried")


def over_limit(acquired: DataFrame, real_size: str, item_limit: int = P.ITEM_LIMIT_BYTES) -> DataFrame:
    """Acquired items whose real size, known only now, is over the ceiling: they need a person as well."""
    over = F.col(real_size) > item_limit if item_limit else F.lit(False)
    return acquired.withColumn("status", F.when(over, F.lit(MANUAL)).otherwise(F.lit(ACQUIRED)))


def failures(admitted: DataFrame, item_limit: int, cycle_budget: int, size: str) -> DataFrame:
    """Rows that were not acquired, with reason, class and next step."""
    over = F.col("status") == MANUAL
    reason = F.when(
        over, F.concat(F.lit("attachment_exceeds_configured_limit:"), F.col(size), F.lit(f">{item_limit}"))
    ).otherwise(F.concat(F.lit("cycle_attachment_budget_exceeded:"), F.col("used_before"), F.lit("+"), F.col(size), F.lit(f">{cycle_budget}")))
    return admitted.filter(F.col("status").isin(MANUAL, FAILED)).withColumn("reason", reason).withColumn(
        "failure_class", failure_class(F.col("status"))
    ).withColumn("next_step", next_step(F.col("status")))


def failure_class(status: Column) -> Column:
    return F.when(status == MANUAL, "terminal").when(status == FAILED, "retryable")


def next_step(status: Column) -> Column:
    return F.when(status == MANUAL, "approved_large_file_procedure").when(status == FAILED, "retry_same_session")


def cycle_status(admitted: DataFrame) -> DataFrame:
    """One row of counters for a finished cycle."""
    is_ = lambda s: F.count_if(F.col("status") == s)
    row = admitted.agg(is_(ACQUIRED).alias("acquired"), is_(MANUAL).alias("manual"), is_(FAILED).alias("retry"), is_(WAITING).alias("waiting"))
    return row.withColumn("outcome", F.when(F.col("manual") + F.col("retry") == 0, "completed").otherwise("completed_with_failures"))
