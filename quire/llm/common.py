"""Helpers that several of the operators share."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, scratch, table

__all__ = ["ascii_words", "cut", "documents", "fold", "keyed_texts", "let", "map_arrow", "open_store", "scratch", "stretches_of", "text_batches"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def map_arrow(df: DataFrame, body: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` whose workers find this package where it lies in the driver's folder.

    On a cluster the package comes with ``--py-files`` or the image; the extra path then does no harm.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = df.sparkSession.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH", "")]))
    return df.mapInArrow(body, schema)


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def let(value: Column, body) -> Column:
    """Compute ``value`` once and use it many times inside ``body``.

    A lambda variable is bound once per row, whereas a column that is named inside a
    lambda may be inlined there and then computed again for each element.
    """
    return F.transform(F.array(value), body)[0]


def keyed_texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text (null: empty), whatever other columns the table has."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *more)


def text_batches(batches: Iterator[pa.RecordBatch], most: int = 8 << 20) -> Iterator[dict[str, list]]:
    """Columns as lists, in slices of about ``most`` bytes; a slice has one row at least.

    Memory then follows the longest text, not the number of rows in an Arrow batch.
    """
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
        ends, begin = np.cumsum(sizes, dtype=np.int64), 0
        while begin < batch.num_rows:
            gone = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, gone + most, "right")))
            part = batch.slice(begin, end - begin)
            yield {name: part.column(name).to_pylist() for name in part.schema.names}
            begin = end


# The six ASCII white-space bytes between words, and A-Z to a-z.
SPACES = b"\t\n\x0b\x0c\r "
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True


def ascii_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the words (runs of bytes that are no ASCII white space) of a byte array."""
    inside = ~IS_SPACE[data]
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def stretches_of(first: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Begin and end of each stretch of n rows, given the first row of each."""
    return list(zip(first.tolist(), [*first[1:].tolist(), n], strict=True)) if len(first) else []


def open_store(uri: str):
    """A file system and a path in it, for tasks that write files of their own format to the shared folder."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)
