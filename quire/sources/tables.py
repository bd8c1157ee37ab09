"""Sinks and table maintenance on plain Parquet, JSON and CSV.

A dataset is a folder of version folders plus a log of finished versions. A write
goes to a new version; the log gains its line only after the write succeeded, so a
reader always sees a whole version and a lost executor leaves the old one in place.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.dedup import greedy
from ..operators.keyed import attach, lookup
from ..operators.ordered import BLOCK, number_batches
from ..session import children, create_once, delete

LOG_SCHEMA = "seq long, version string, format string"
SEQUENCE = re.compile(r"seq-(\d+)\.json")


def _log(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(LOG_SCHEMA).json(f"{path}/log")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def current_version(spark: SparkSession, path: str) -> tuple[int, str, str] | None:
    log = _log(spark, path)
    row = None if log is None else log.orderBy(F.desc("seq")).first()
    return (row["seq"], row["version"], row["format"]) if row else None


class VersionConflict(RuntimeError):
    """Another writer has switched the dataset since this one began."""


def _next_seq(spark: SparkSession, path: str, now: tuple[int, str, str] | None) -> int:
    """One past every line and every file of the log; a file that a lost writer left empty keeps its number."""
    named = [m[1] for m in map(SEQUENCE.fullmatch, children(spark, f"{path}/log")) if m]
    return max([now[0] if now else 0, *map(int, named)]) + 1


def replace_dataset(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = (), *, keep: int = 2,
                    **options) -> None:
    """Rebuild beside the current version, then switch readers over.

    The switch creates the log file of the next number. A writer that finds it taken has built on a version that is no
    longer the current one: its folder goes and ``VersionConflict`` is raised. A failed write leaves no folder either.
    After the switch the newest ``keep`` versions stay, so that readers of the previous one can finish.
    """
    spark = df.sparkSession
    now = current_version(spark, path)
    seq, version = _next_seq(spark, path, now), f"v-{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists").options(**options)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    try:
        writer.format(fmt).save(f"{path}/{version}")
        line = json.dumps({"seq": seq, "version": version, "format": fmt})
        if not create_once(spark, f"{path}/log/seq-{seq:09d}.json", line + "\n"):
            raise VersionConflict(f"{path}: version {seq} was written meanwhile")
    except Exception:
        delete(spark, f"{path}/{version}")
        raise
    _drop_old(spark, path, keep)


def _drop_old(spark: SparkSession, path: str, keep: int) -> None:
    """Delete the folders of versions older than the newest ``keep``. The log's lines stay."""
    held = set(children(spark, path))
    lines = _log(spark, path).orderBy(F.desc("seq")).select("version").collect()
    for row in lines[max(keep, 1):]:
        if row["version"] in held:
            delete(spark, f"{path}/{row['version']}")


def sweep(spark: SparkSession, path: str) -> int:
    """Delete version folders that no log line names, left by writers that were lost. Call it while nobody writes."""
    log = _log(spark, path)
    named = set() if log is None else {r["version"] for r in log.select("version").collect()}
    lost = [n for n in children(spark, path) if n.startswith("v-") and n not in named]
    for name in lost:
        delete(spark, f"{path}/{name}")
    return len(lost)


def read_dataset(spark: SparkSession, path: str, schema=None, **options) -> DataFrame:
    now = current_version(spark, path)
    if now is None:
        raise FileNotFoundError(f"no finished version below {path}")
    reader = spark.read.options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.format(now[2]).load(f"{path}/{now[1]}")


def write_register(df: DataFrame, path: str) -> None:
    """Compact NDJSON. Empty fields are written, as a register lists every field."""
    replace_dataset(df, path, "json", ignoreNullFields=False)


def write_manifest(df: DataFrame, path: str) -> None:
    replace_dataset(df, path, "csv", header=True, escape='"', lineSep="\n", emptyValue="", nullValue="")


def write_batches(df: DataFrame, path: str, order: str, size: int = 100, block: int = BLOCK, per_file: int = 1000) -> None:
    """Numbered fixed-size batches as compressed JSON, the number as a column.

    ``per_file`` neighbouring batches go to one task, in order; a batch is never divided between files.
    """
    numbered = number_batches(df, order, size, block=block).withColumn("_group", F.expr(f"(batch - 1) div {int(per_file)}"))
    grouped = numbered.repartition("_group").sortWithinPartitions("batch", order).drop("_group")
    replace_dataset(grouped.withColumn("batch", F.format_string("%03d", "batch")), path, "json", compression="gzip")


def insert_if_absent(target: DataFrame, source: DataFrame, order: str, keys: Sequence[Sequence[str]]) -> DataFrame:
    """Target plus the source rows that conflict with nothing.

    One key set: conflict on that key only. Several: a row is kept out when any of them
    is taken by the target or by an earlier row that got in. A NULL never conflicts.
    """
    if len(keys) == 1:
        cols = list(keys[0])
        whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols])
        ranked = attach(source.filter(whole), cols, [order], [F.min(order).alias("_first")])
        fresh = ranked.filter(F.col("_first") == F.col(order)).drop("_first")
        fresh = fresh.join(target.select(*cols), cols, "left_anti").select(*target.columns)
        if any(source.schema[c].nullable for c in cols):
            fresh = fresh.unionByName(source.filter(~whole).select(*target.columns))
        return target.unionByName(fresh)

    def packed(cols: Sequence[str]) -> Column:
        whole = [F.col(c).isNotNull() for c in cols]
        complete = whole[0]
        for w in whole[1:]:
            complete = complete & w
        return F.when(complete, F.to_json(F.struct(*cols)))

    names = [f"_key{i}" for i in range(len(keys))]
    keyed = source.select(order, *[packed(k).alias(n) for k, n in zip(keys, names, strict=True)])
    held = target.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("kind"), packed(k).alias("value"), F.lit("target").alias("owner"))
        for k, n in zip(keys, names, strict=True)
    ]))).filter(F.col("value").isNotNull()).distinct()
    keyed = keyed.withColumn("_order", F.col(order))
    fate = greedy(keyed, order, "_order", names, owned=held)
    fresh = source.join(fate.filter(F.col("status") == "accepted").select(order), order, "left_semi")
    return target.unionByName(fresh.select(*target.columns))


def guarded_update(target: DataFrame, audit: DataFrame, ident: str, changes: Mapping[str, str],
                   guard: tuple[str, str]) -> DataFrame:
    """Compare-and-set. ``changes`` maps a column to its audit column; ``guard`` is the
    target column and the audit column it must still equal. Adds ``updated``."""
    held, expected = guard
    wanted = sorted({*changes.values(), expected})
    once = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.concat(F.lit("the audit lists an id twice: "), F.col(ident).cast("string"))))
    side = audit.groupBy(ident).agg(
        *[F.first(c).alias(f"_a_{c}") for c in wanted if c != expected],
        F.coalesce(once.cast(audit.schema[expected].dataType), F.first(expected)).alias(f"_a_{expected}"),
    )
    joined = target.join(side, ident, "left")
    hit = F.coalesce(F.col(held) == F.col(f"_a_{expected}"), F.lit(False))
    kept = [
        F.when(hit, F.col(f"_a_{changes[c]}")).otherwise(F.col(c)).alias(c) if c in changes else F.col(c)
        for c in target.columns
    ]
    return joined.select(*kept, hit.alias("updated"))


def snapshot(tables: Mapping[str, DataFrame], path: str) -> DataFrame:
    """Full copy of every table with a counted manifest.

    An existing snapshot is never overwritten. Rows are counted in the copy itself and
    in the source; a difference fails the snapshot.
    """
    spark = next(iter(tables.values())).sparkSession
    manifest = None
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{path}/{name}")
        copied = spark.read.parquet(f"{path}/{name}").agg(F.count(F.lit(1)).alias("snapshot_rows"))
        counted = df.agg(F.count(F.lit(1)).alias("source_rows"))
        row = counted.withColumn("table_name", F.lit(name)).join(
            copied.withColumn("table_name", F.lit(name)), "table_name")
        manifest = row if manifest is None else manifest.unionByName(row)
    verified = manifest.withColumn("verified", F.col("source_rows") == F.col("snapshot_rows"))
    verified.coalesce(1).write.mode("errorifexists").json(f"{path}/snapshot_manifest")
    proof = spark.read.schema(verified.schema).json(f"{path}/snapshot_manifest")
    if not proof.filter(~F.col("verified")).isEmpty():
        raise ValueError(f"snapshot {path}: row counts differ")
    return proof


def upsert(target: DataFrame, source: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Latest row per key wins, source over target. Aggregated map-side, no key is gathered."""
    rows = target.withColumn("_side", F.lit(0)).unionByName(source.withColumn("_side", F.lit(1)))
    whole = F.struct(*target.columns)
    best = rows.groupBy(*keys).agg(F.max_by(whole, F.struct("_side", order)).alias("_row"))
    return best.select("_row.*")


def append_once(df: DataFrame, path: str, batch: int | str) -> bool:
    """Append a batch to a log; an empty batch leaves no folder.

    The batch owns its folder, so a repeated batch replaces itself instead of doubling. Its plan
    runs once: the write counts its own rows.
    """
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(f"{path}/batch_id={batch}")
    if seen.get["rows"]:
        return True
    delete(df.sparkSession, f"{path}/batch_id={batch}")
    return False


def read_log(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """All batches of a log, or None before the first one."""
    try:
        reader = spark.read.option("basePath", path)
        if schema:
            reader = reader.schema(f"{schema}, batch_id long")
        return reader.parquet(path)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def read_latest(spark: SparkSession, path: str, before: int) -> DataFrame | None:
    """The newest batch of a log below ``before``, for logs whose every batch holds the whole state. Opens that folder only."""
    numbers = [int(n.removeprefix("batch_id=")) for n in children(spark, path) if n.startswith("batch_id=")]
    earlier = [n for n in numbers if n < before]
    return spark.read.parquet(f"{path}/batch_id={max(earlier)}") if earlier else None


def sync_status(register: DataFrame, log: DataFrame, ident: str, key: str, state: str, done: str,
                labels: Mapping[str, str], column: str = "status") -> DataFrame:
    """Register status from the processing log; rows the log does not know stay as they are."""
    side = log.select(key, F.col(state).alias("_state"), F.col(done).alias("_done"))
    joined = lookup(register, side, [key], [ident])
    new = F.lit(None).cast("string")
    for name, label in labels.items():
        if name == "indexed":
            found = F.when(F.col("_done") > 0, F.format_string(label, F.col("_done"))).otherwise(labels["indexed_none"])
            new = F.when(F.col("_state") == "indexed", found).otherwise(new)
        elif name != "indexed_none":
            new = F.when(F.col("_state") == name, F.lit(label)).otherwise(new)
    kept = [F.coalesce(new, F.col(column)).alias(column) if c == column else F.col(c) for c in register.columns]
    return joined.select(*kept)
