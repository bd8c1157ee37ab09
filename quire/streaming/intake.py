"""The intake cycle as a streaming query.

The checkpoint replaces the cursor file. Each micro-batch writes below its own
``batch_id`` folder, so a batch repeated after a failure replaces itself and the
logs hold every row once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import patterns as P
from ..operators import validate as V
from ..operators.keyed import lookup
from ..operators.ordered import BLOCK, in_order
from ..session import cut
from ..sources.keylog import KeyLog
from ..sources.tables import append_once, read_latest, read_log
from . import budget as B


def file_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int | None = None) -> DataFrame:
    """New files of a folder as a stream; the batch size bounds a cycle."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def drain(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None]) -> None:
    """Process everything that has arrived, then stop."""
    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def newest(spark: SparkSession, batch: DataFrame, ident: str) -> int | None:
    return batch.agg(F.max(ident)).first()[0]


def touched(history: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """The part of a log that concerns this batch.

    The batch's keys meet the log in a semi join: the log is read, by column, but not
    shuffled as long as a batch's keys fit a broadcast, which the optimizer checks.
    """
    return history.join(batch.select(key).distinct(), key, "left_semi")


def latest_registered(rows: DataFrame, digest: str, order: str, ident: str, register: DataFrame | None,
                      block: int = BLOCK) -> DataFrame:
    """Each row with the most recent earlier row of the same hash, in the batch or before it. An unknown hash equals none."""
    held = None
    if register is not None:
        held = touched(register, rows, digest).groupBy(digest).agg(F.max_by(ident, F.struct("batch_id", order)).alias("last_id"))
    return link_latest(rows, digest, order, ident, held, block)


def link_latest(rows: DataFrame, digest: str, order: str, ident: str, held: DataFrame | None, block: int = BLOCK) -> DataFrame:
    """The same where the latest earlier holder of each hash is known (``digest``, ``last_id``)."""
    alone = rows.filter(F.col(digest).isNull()).withColumn("canonical_id", F.lit(None).cast(rows.schema[ident].dataType))
    rows = rows.filter(F.col(digest).isNotNull())
    near = in_order(rows, [digest], order, previous={"canonical_id": ident}, block=block)
    if held is None:
        return near.unionByName(alone)
    joined = lookup(near, held.select(digest, F.col("last_id").alias("_known")), [digest], [order])
    linked = joined.withColumn("canonical_id", F.coalesce("canonical_id", "_known")).drop("_known")
    return linked.unionByName(alone.select(*linked.columns))


@dataclass
class Intake:
    """Cursor, retries, budget, binary duplicates, failures and status of one feed.

    A micro-batch is one cycle: what failed in the last one, the named retries, and the first posts past the channel's
    cursor, under one budget. The cursor moves to the last post taken; posts beyond wait in a log of their own, where
    the cursor finds them. Cursors, waiting and failed posts are states: a batch reads the newest one before it. What the
    register holds is asked of two key logs, of which a batch opens the buckets of its own posts and hashes. All are read
    as they were before the batch, so a repeated batch sees the same.
    """

    spark: SparkSession
    root: str
    channel: str
    ident: str
    size: str
    digest: str
    cursor: int | None
    retry: tuple[int, ...] = ()
    item_limit: int = P.ITEM_LIMIT_BYTES
    cycle_budget: int = P.CYCLE_BUDGET_BYTES
    per_cycle: int = P.POSTS_PER_CYCLE
    by_ident: KeyLog = field(init=False)
    by_digest: KeyLog = field(init=False)

    def __post_init__(self) -> None:
        if self.cursor is None:
            raise ValueError("no intake cursor: bootstrap at the latest post or name a first post")
        self.by_ident = KeyLog(self.spark, f"{self.root}/register_ids")
        self.by_digest = KeyLog(self.spark, f"{self.root}/register_hashes")

    def log(self, name: str) -> DataFrame | None:
        return read_log(self.spark, f"{self.root}/{name}")

    def state(self, name: str, batch: int) -> DataFrame | None:
        return read_latest(self.spark, f"{self.root}/{name}", batch)

    def past_cursor(self, posts: DataFrame, number: int) -> DataFrame:
        """The posts that no cycle has taken yet: those past their channel's cursor. Channels are few; a cursor is one row each."""
        moved = self.state("cursors", number)
        start = F.lit(self.cursor)
        if moved is not None:
            at = moved.select(F.col(self.channel).alias("_channel"), F.col("cursor").alias("_cursor"))
            posts = posts.join(at, F.col(self.channel).eqNullSafe(F.col("_channel")), "left").drop("_channel")
            start = F.greatest(start, F.col("_cursor"))
        return posts.filter(F.col(self.ident) > start).drop("_cursor")

    def candidates(self, batch: DataFrame, number: int) -> DataFrame:
        """Posts past the cursor, here or waiting, the named retries, and what the last batch put back (``retried`` tells them apart)."""
        arrived = batch
        waiting = self.state("waiting", number)
        if waiting is not None:
            arrived = arrived.unionByName(waiting.select(*batch.columns))
        fresh = self.past_cursor(arrived, number).withColumn("retried", F.lit(False))
        if self.retry:
            named = self.spark.createDataFrame([(i,) for i in self.retry], f"_retry {batch.schema[self.ident].dataType.simpleString()}").distinct()
            again = batch.filter(F.col(self.ident) <= self.cursor).join(named, F.col(self.ident) == F.col("_retry"), "left_semi")
            fresh = fresh.unionByName(again.withColumn("retried", F.lit(True)))
        back = self.state("retry", number)
        if back is not None:
            fresh = fresh.unionByName(back.select(*batch.columns).withColumn("retried", F.lit(True)))
        done = self.by_ident.held(fresh, self.ident, number)
        if done is not None:
            fresh = fresh.join(done.select(self.ident), self.ident, "left_anti")
        return fresh

    def process(self, batch: DataFrame, number: int) -> None:
        for keys in (self.by_ident, self.by_digest):
            keys.compact(number)
        rows = cut(self.candidates(batch, number))
        if rows.isEmpty():
            return
        fate = cut(B.admit(rows, self.channel, self.ident, self.size, retry="retried", item_limit=self.item_limit,
                           cycle_budget=self.cycle_budget, per_cycle=self.per_cycle))
        rows = rows.drop("retried")
        acquired = fate.filter(F.col("status") == B.ACQUIRED).select(self.ident)
        kept = rows.join(acquired, self.ident)
        held = self.by_digest.held(rows, self.digest, number)
        linked = link_latest(kept.withColumn("_order", F.col(self.ident)), self.digest, "_order", self.ident, held).drop("_order")
        append_once(linked, f"{self.root}/register", number)
        self.by_ident.append(kept, self.ident, self.ident, number)
        self.by_digest.append(kept, self.digest, self.ident, number)
        failed = B.failures(fate, self.item_limit, self.cycle_budget, self.size)
        append_once(failed, f"{self.root}/failures", number)
        back = failed.filter(F.col("failure_class") == "retryable").select(self.ident)
        append_once(rows.join(back, self.ident, "left_semi"), f"{self.root}/retry", number)
        beyond = fate.filter(F.col("status") == B.WAITING).select(self.ident)
        append_once(rows.join(beyond, self.ident, "left_semi"), f"{self.root}/waiting", number)
        moved = fate.filter((F.col("status") != B.WAITING) & ~F.col("retried")).select(self.channel, F.col(self.ident).alias("cursor"))
        at = self.state("cursors", number)
        moved = moved if at is None else moved.unionByName(at)
        append_once(moved.groupBy(self.channel).agg(F.max("cursor").alias("cursor")), f"{self.root}/cursors", number)
        seen = fate.filter(F.col("status") != B.WAITING).agg(F.max(self.ident).alias("cursor"))
        status = B.cycle_status(fate).withColumn("cursor", seen.scalar())
        append_once(status, f"{self.root}/status", number)

    def run(self, stream: DataFrame) -> None:
        drain(stream, f"{self.root}/checkpoint", self.process)

    def last_success(self) -> DataFrame:
        """Newest cycle of each outcome; the last complete one is retained."""
        w = Window.partitionBy("outcome").orderBy(F.desc("batch_id"))
        return self.log("status").withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


@dataclass
class Processor:
    """Idempotent processing of registered originals: a source is processed once."""

    spark: SparkSession
    root: str
    ident: str
    source: str
    digest: str
    by_source: KeyLog = field(init=False)
    by_digest: KeyLog = field(init=False)

    def __post_init__(self) -> None:
        self.by_source = KeyLog(self.spark, f"{self.root}/record_sources")
        self.by_digest = KeyLog(self.spark, f"{self.root}/record_hashes")

    def process(self, batch: DataFrame, number: int) -> None:
        for keys in (self.by_source, self.by_digest):
            keys.compact(number)
        rows = batch
        done = self.by_source.held(batch, self.source, number)
        if done is not None:
            rows = rows.join(done.select(self.source), self.source, "left_anti")
        rows = cut(rows)
        if rows.isEmpty():
            return
        from ..operators.dedup import first_wins

        order = rows.withColumn("_order", F.col(self.ident))
        first = first_wins(order, self.digest, self.ident, "_order").select(self.ident, "canonical_id")
        judged = rows.join(first, self.ident)
        known = self.by_digest.held(rows, self.digest, number)
        if known is not None:
            judged = lookup(judged, known.select(self.digest, F.col("first_id").alias("_known")), [self.digest], [self.ident]).withColumn(
                "canonical_id", F.coalesce("_known", "canonical_id")).drop("_known")
        other = F.col("canonical_id") != F.col(self.ident)
        records = judged.select(
            self.ident, self.source, self.digest,
            F.when(other, "exact_duplicate_review").otherwise("pending_provenance_and_metadata_review").alias("review_status"),
            F.when(other, F.col("canonical_id")).alias("duplicate_of"),
        )
        append_once(records, f"{self.root}/records", number)
        self.by_source.append(rows, self.source, self.ident, number)
        self.by_digest.append(rows, self.digest, self.ident, number)

    def run(self, stream: DataFrame, checkpoint: str | None = None) -> None:
        drain(stream, checkpoint or f"{self.root}/checkpoint", self.process)


def gate(root: str, ident: str, rules: list[V.Rule]) -> Callable[[DataFrame, int], None]:
    """Publish a batch only when no rule reports an error; else the whole batch waits in quarantine."""

    def each(batch: DataFrame, number: int) -> None:
        violations = V.row_rules(batch, ident, rules).filter(F.col("severity") == "error")
        clean = violations.isEmpty()
        append_once(batch, f"{root}/{'published' if clean else 'quarantine'}", number)
        if not clean:
            append_once(violations, f"{root}/violations", number)

    return each


def change_monitor(incoming: DataFrame, register: DataFrame, ident: str) -> tuple[DataFrame, DataFrame]:
    """Ids the register lacks, as review rows, and one row saying whether anything changed.

    Reading stops at the newest known id: only ids above it count as new posts, and
    ids below it that the register lacks are gaps.
    """
    edge = register.agg(F.max(ident).alias("edge"))
    unknown = incoming.select(ident).distinct().join(register.select(ident), ident, "left_anti")
    rows = unknown.withColumn("finding", F.when(F.col(ident) > edge.scalar(), "new_post").otherwise("gap"))
    state = rows.agg(F.count_if(F.col("finding") == "new_post").alias("new_posts"), F.count_if(F.col("finding") == "gap").alias("gaps"))
    return rows, state.withColumn("changed", F.col("new_posts") > 0)
