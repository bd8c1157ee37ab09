"""Token index, number lookups and document chunks."""

from __future__ import annotations

import zlib
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import lines
from ..session import children
from .keyed import salt_of

NOT_WORD = r"[^\p{L}\p{Nd}]+"


def tokens(*fields: Column) -> Column:
    """Distinct lower-case words of all fields; no stemming and no stop words."""
    text = F.lower(F.concat_ws(" ", *[F.coalesce(f, F.lit("")) for f in fields]))
    return F.array_distinct(F.filter(F.split(text, NOT_WORD), lambda t: t != ""))


def token_index(documents: DataFrame, ident: str, fields: Sequence[str]) -> DataFrame:
    return documents.select(F.col(ident), F.explode(tokens(*[F.col(f) for f in fields])).alias("token"))


def search(index: DataFrame, ident: str, words: Sequence[str]) -> DataFrame:
    """Documents holding every word. Index rows are distinct per document."""
    wanted = sorted({w.lower() for w in words})
    hits = index.filter(F.col("token").isin(*wanted)).groupBy(ident).agg(F.count(F.lit(1)).alias("_n"))
    return hits.filter(F.col("_n") == len(wanted)).select(ident)


@dataclass
class Postings:
    """A kept inverted index, added to batch by batch.

    Postings lie by bucket of their word, beside the number of documents of each word. A search opens one bucket a word,
    asks the small side which word is rarest, and intersects from there; no text is read. A batch owns its folders, so a
    repeated batch replaces itself. A document is added once; in two batches it counts twice in the frequencies, which
    only order the intersection, and is found by the words of either.
    """

    spark: SparkSession
    path: str
    ident: str
    buckets: int = 256
    salts: int = 16

    def add(self, documents: DataFrame, fields: Sequence[str], batch: int) -> None:
        """Index a batch. The postings of a common word are written by up to ``salts`` tasks."""
        words = token_index(documents, self.ident, fields).withColumn("bucket", self._bucket(F.col("token")))
        salted = words.withColumn("_salt", salt_of([self.ident], self.salts))
        laid = salted.repartition("bucket", "token", "_salt").dropDuplicates(["bucket", "token", "_salt", self.ident]).drop("_salt")
        self._write(laid.sortWithinPartitions("bucket", "token", self.ident), "postings", batch)
        written = self._read("postings", [batch], None)
        if written is not None:
            counted = written.groupBy("bucket", "token").agg(F.count(F.lit(1)).alias("documents"))
            self._write(counted.repartition("bucket").sortWithinPartitions("bucket", "token"), "frequencies", batch)

    def frequencies(self, words: Sequence[str]) -> dict[str, int]:
        """Documents by word, for the words of a search; unknown ones are missing."""
        counted = self._of("frequencies", words)
        if counted is None:
            return {}
        return {r[0]: r[1] for r in counted.groupBy("token").agg(F.sum("documents")).collect()}

    def search(self, words: Sequence[str]) -> DataFrame | None:
        """Documents that hold every word, once each; None when a word occurs nowhere or no word is given."""
        wanted = sorted({w.lower() for w in words})
        known = self.frequencies(wanted)
        if not wanted or len(known) < len(wanted):
            return None
        hits = None
        for word in sorted(wanted, key=lambda w: (known[w], w)):
            one = self._of("postings", [word]).select(self.ident)
            hits = one if hits is None else hits.join(one, self.ident)
        return hits.distinct()

    def _bucket(self, token: Column) -> Column:
        return F.pmod(F.crc32(token.cast("binary")), F.lit(self.buckets)).cast("int")

    def _of(self, part: str, words: Sequence[str]) -> DataFrame | None:
        buckets = {zlib.crc32(w.encode()) % self.buckets for w in words}
        batches = [int(n.removeprefix("batch_id=")) for n in children(self.spark, f"{self.path}/{part}")]
        found = self._read(part, batches, buckets)
        return None if found is None else found.filter(F.col("token").isin(*words))

    def _read(self, part: str, batches: Sequence[int], buckets: set[int] | None) -> DataFrame | None:
        opened = []
        for batch in sorted(batches):
            folder = f"{self.path}/{part}/batch_id={batch}"
            names = [n for n in children(self.spark, folder) if n.startswith("bucket=")]
            opened += [f"{folder}/{n}" for n in names if buckets is None or int(n.removeprefix("bucket=")) in buckets]
        return self.spark.read.option("basePath", f"{self.path}/{part}").parquet(*opened) if opened else None

    def _write(self, rows: DataFrame, part: str, batch: int) -> None:
        writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("bucket")
        writer.parquet(f"{self.path}/{part}/batch_id={batch}")


def exact_lookup(documents: DataFrame, numbers: Sequence[str], value: str, **filters: str) -> DataFrame:
    """Equality on any of the number columns, plus field filters; all reach the scan."""
    hit = reduce(lambda a, b: a | b, [F.col(c) == value for c in numbers])
    for name, wanted in filters.items():
        hit = hit & (F.col(name) == wanted)
    return documents.filter(hit)


def chunks(documents: DataFrame, ident: str, text: str, lines_per_chunk: int = 20, profile: str = "target") -> DataFrame:
    """Document chunks of whole lines, keyed (document, index), without a shuffle."""
    step = int(lines_per_chunk)
    cut = documents.select(F.col(ident), lines(F.col(text), profile).alias("_lines"))
    none = F.array().cast("array<int>")
    starts = F.when(F.size("_lines") > 0, F.sequence(F.lit(1), F.size("_lines"), F.lit(step))).otherwise(none)
    parts = F.transform(starts, lambda s: F.array_join(F.slice(F.col("_lines"), s, F.lit(step)), "\n"))
    return cut.select(F.col(ident), F.posexplode(parts).alias("chunk_index", "chunk_text"))
