"""Token ids as flat unsigned integer files with 64-bit document offsets.

Layout of a folder: for each shard ``<name>.bin`` (ids, little-endian unsigned integers of the
narrowest width that holds the vocabulary) and ``<name>.idx`` (64-bit little-endian: number of
documents n, one id per document, then n + 1 offsets within the shard; the smallest 64-bit integer
stands for a null id). ``shards`` is a Parquet manifest: shard order, width, counts and the bases,
that is, documents and ids in all shards before, which are prefix sums over the shards. The global
offset of a document is its shard's base plus its offset in the shard.

Documents are in ascending doc_id order (null first; equal ids by text). A null text is an empty
document that consists of the end id alone; an empty table gives an empty manifest.

A task writes files under a name of its own, and only the manifest, which Spark's committer writes,
says which files count. A task that runs again after a lost executor therefore leaves at most files
that nothing refers to.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import keyed_texts, map_arrow, open_store, text_batches
from .pieces import PieceEncoder, byte_level_pieces

NULL_ID = np.iinfo(np.int64).min
SHARD = "part int, data string, offsets string, width int, n_docs bigint, n_tokens bigint"
_ENCODERS: dict[str, PieceEncoder] = {}


def byte_level_encoder(tokenizer: str) -> tuple[PieceEncoder, int]:
    """The encoder of a byte-level tokenizer file, one per Python worker, and its bytes per id."""
    if tokenizer not in _ENCODERS:
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        model = Tokenizer.from_file(tokenizer)
        special = [t.content for t in model.get_added_tokens_decoder().values()]

        def split(text: str) -> list[str]:
            # A special token's string ends a stretch of text for the tokenizer: leave such a text whole.
            return [text] if any(s in text for s in special) else byte_level_pieces(text)

        def encode(pieces: list[str]):
            return (e.ids for e in model.encode_batch_fast(pieces, add_special_tokens=False))

        _ENCODERS[tokenizer] = PieceEncoder(split, encode, "<u2" if model.get_vocab_size() <= 1 << 16 else "<u4")
    return _ENCODERS[tokenizer], _ENCODERS[tokenizer].dtype.itemsize


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int) -> DataFrame:
    """Encode every text, append ``end_id`` and write the files into ``folder``; the manifest with its bases."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, width = byte_level_encoder(tokenizer)
        end = np.array([end_id], encode.dtype).tobytes()
        store, base = open_store(folder)
        store.create_dir(base, recursive=True)
        name, ids, sizes, out = f"{base}/{uuid.uuid4().hex}", [], [], None
        for part in text_batches(batches):
            out = out or store.open_output_stream(f"{name}.bin")
            for doc_id, body in zip(part["doc_id"], encode(part["text"]), strict=True):
                out.write(body + end)
                ids.append(NULL_ID if doc_id is None else doc_id)
                sizes.append(len(body) // width + 1)
        if out is None:
            return
        out.close()
        offsets = np.cumsum([0, *sizes], dtype="<i8")
        with store.open_output_stream(f"{name}.idx") as index:
            index.write(np.array([len(ids)], "<i8").tobytes() + np.array(ids, "<i8").tobytes() + offsets.tobytes())
        yield pa.RecordBatch.from_pydict(
            {
                "part": pa.array([TaskContext.get().partitionId()], pa.int32()),
                "data": [f"{name}.bin"],
                "offsets": [f"{name}.idx"],
                "width": pa.array([width], pa.int32()),
                "n_docs": [len(ids)],
                "n_tokens": [int(offsets[-1])],
            }
        )

    ordered = keyed_texts(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    map_arrow(ordered, write, SHARD).write.mode("overwrite").parquet(f"{folder}/written")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    bases = [F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"{n}_before") for n in ("n_docs", "n_tokens")]
    docs.sparkSession.read.parquet(f"{folder}/written").select("*", *bases).write.mode("overwrite").parquet(f"{folder}/shards")
    return docs.sparkSession.read.parquet(f"{folder}/shards")


def map_file(store, path: str):
    """The bytes of a file: memory-mapped if the store is a file system of this machine, else read."""
    from pyarrow import fs

    if isinstance(store, fs.LocalFileSystem):
        return pa.memory_map(path).read_buffer()
    with store.open_input_file(path) as f:
        return f.read_buffer()


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids_crc32 of each document in a folder."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = open_store(folder)
        for batch in batches:
            for shard in batch.to_pylist():
                index = np.frombuffer(map_file(store, shard["offsets"]), "<i8")
                n = int(index[0])
                ids, offsets = index[1 : n + 1], index[n + 1 :]
                data = np.frombuffer(map_file(store, shard["data"]), f"<u{shard['width']}")
                crcs = [zlib.crc32(data[a:b].astype("<u4").tobytes()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array(ids, mask=ids == NULL_ID),
                        "start": pa.array(offsets[:-1] + shard["n_tokens_before"]),
                        "n_tokens": pa.array(np.diff(offsets)),
                        "ids_crc32": pa.array(crcs, pa.int64()),
                    }
                )

    shards = spark.read.parquet(f"{folder}/shards").repartition(spark.sparkContext.defaultParallelism, "part")
    return map_arrow(shards, read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
