"""Who held a key first and last, kept in buckets of the key.

A register only grows; a batch must not read it whole to find the few keys it shares with it. Every batch leaves one
narrow row per key in a unit of its own, split by bucket. Eight units of one width are merged into one of eight times
that width, so a batch opens at most seven units a width, of them only the buckets of its own keys, and each row is
rewritten once a width.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..session import children, delete, exists

UNIT = re.compile(r"unit=(\d+)-(\d+)")
ROWS_PER_FILE = 5_000_000


@dataclass
class KeyLog:
    """A log of keys by batch. A unit is finished when its write has left the success mark.

    A repeated batch replaces its unit and sees only earlier ones. NULL keys are not kept: nothing equals them.
    """

    spark: SparkSession
    path: str
    buckets: int = 64
    fan_in: int = 8

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def finished(self, before: int) -> list[tuple[int, int]]:
        found = [UNIT.fullmatch(name) for name in children(self.spark, self.path)]
        units = sorted(((int(m[1]), int(m[2])) for m in found if m), key=lambda u: (u[0], -u[1]))
        return [u for u in units if u[1] < before and exists(self.spark, f"{self._unit(*u)}/_SUCCESS")]

    def units(self, before: int) -> list[tuple[int, int]]:
        """Units that cover the batches before ``before`` once: of nested ones the widest."""
        cover: list[tuple[int, int]] = []
        for unit in self.finished(before):
            if not cover or unit[0] > cover[-1][1]:
                cover.append(unit)
        return cover

    def append(self, rows: DataFrame, key: str, ident: str, batch: int) -> None:
        """The keys of a batch with their least and greatest id."""
        row = F.struct(F.lit(batch).cast("long").alias("batch_id"), F.col(ident).alias("ident"))
        named = rows.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("key"))
        self._write(named.agg(F.min(row).alias("first"), F.max(row).alias("last")), batch, batch)

    def held(self, rows: DataFrame, key: str, before: int) -> DataFrame | None:
        """``key``, ``first_id`` and ``last_id`` of those keys of ``rows`` that earlier batches hold; None when there are none.

        Only bucket numbers reach the driver, at most ``buckets``.
        """
        units = self.units(before)
        if not units:
            return None
        keys = rows.filter(F.col(key).isNotNull()).select(F.col(key).alias("key")).distinct()
        wanted = {f"bucket={r[0]}" for r in keys.select(self.bucket(F.col("key"))).distinct().collect()}
        opened = [f"{self._unit(*u)}/{name}" for u in units for name in children(self.spark, self._unit(*u)) if name in wanted]
        if not opened:
            return None
        log = self.spark.read.option("basePath", self.path).parquet(*opened).select("key", "first", "last").join(keys, "key", "left_semi")
        return log.groupBy(F.col("key").alias(key)).agg(
            F.min("first")["ident"].alias("first_id"), F.max("last")["ident"].alias("last_id"))

    def compact(self, before: int) -> None:
        """Merge each full window of finished units. What a merge has replaced goes one window of batches later,
        so that results still being read keep their files."""
        width = self.fan_in
        while width <= before:
            cover = self.units(before)
            windows = {u[0] // width for u in cover if u[1] - u[0] + 1 < width and (u[0] // width + 1) * width <= before}
            for w in sorted(windows):
                first, last = w * width, (w + 1) * width - 1
                parts = [self._unit(*u) for u in cover if first <= u[0] and u[1] <= last]
                log = self.spark.read.option("basePath", self.path).parquet(*parts).groupBy("key")
                self._write(log.agg(F.min("first").alias("first"), F.max("last").alias("last")), first, last)
            width *= self.fan_in
        cover = set(self.units(before))
        for unit in self.finished(before - self.fan_in):
            if unit not in cover:
                delete(self.spark, self._unit(*unit))

    def _unit(self, first: int, last: int) -> str:
        return f"{self.path}/unit={first}-{last}"

    def _write(self, folded: DataFrame, first: int, last: int) -> None:
        seen = Observation()
        laid = folded.observe(seen, F.count(F.lit(1)).alias("rows")).withColumn("bucket", self.bucket(F.col("key")))
        laid = laid.repartition("bucket").sortWithinPartitions("bucket", "key")
        writer = laid.write.mode("overwrite").option("partitionOverwriteMode", "static").option("maxRecordsPerFile", ROWS_PER_FILE)
        writer = writer.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true")
        writer.partitionBy("bucket").parquet(self._unit(first, last))
        if not seen.get["rows"]:
            delete(self.spark, self._unit(first, last))
