"""SimHash near-duplicates with pivot distance tables.

Fingerprint: 64 bits over the XXH64 (seed 42) of a text's word shingles, lower-cased A-Z, repeats
included; a bit is 1 if it is set in more than half of them. Fingerprints within ``radius`` bits link,
and a group is a connected component.

Documents with equal fingerprints collapse first, so copies are never paired. A pair within the radius
agrees on one of radius + 1 bit blocks, which says where pairs meet; a block value with more
fingerprints than ``room`` is dealt out again by blocks of the remaining bits, and so on until
the groups fit, twice at most; a group that is still larger is dealt out as all pairs of its tiles. In each group a table holds every
fingerprint's Hamming distances to ``PIVOTS`` reference fingerprints. Distances obey the triangle
inequality, so a pair whose coordinates differ by more than the radius anywhere cannot link: the group is
sorted by the first coordinate, only the band within the radius is looked at, in tiles of bounded size, and
the other coordinates thin it out; what survives is verified by its exact distance. A group gives
off only a spanning forest of its links, never its pairs, so the output is linear.

Components come from alternating large-star and small-star steps, each written to the shared folder;
the driver sees counts alone.

A null or empty text has fingerprint zero and links like any other. Equal doc_ids and a null doc_id
(which comes last in the order that chooses a group's id) are allowed. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_arrow, stretches_of, text_batches

SEED, BITS = 42, 64
RADIUS, ROOM = 3, 4096
PIVOTS = 24
TILE = 1024


def fingerprint(text: str, words: int) -> int:
    import xxhash

    body = text.encode("utf-8", "surrogatepass").lower().split()
    if not body:
        return 0
    joined = b" ".join(body)
    if len(body) <= words:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends, at = [], -1
        for w in body:
            at += len(w) + 1
            ends.append(at)
        starts = [0, *(e + 1 for e in ends[: len(body) - words])]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1 :], strict=True)]
    bits = np.zeros(BITS, np.int64)
    every = np.array(hashes, np.uint64)
    for begin in range(0, len(every), 1 << 16):
        bits += np.unpackbits(every[begin : begin + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, text_key (hash of the text) and fp (signed 64 bits) of every row."""

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_batches(batches):
            fps = np.array([fingerprint(t or "", words) for t in part["text"]], np.uint64)
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(part["doc_id"], pa.int64()), "text_key": pa.array(part["text_key"], pa.int64()), "fp": pa.array(fps.view(np.int64))})

    return map_arrow(docs.select("doc_id", "text", F.xxhash64("text").alias("text_key")), body, "doc_id bigint, text_key bigint, fp bigint")


def pivots(n: int = PIVOTS) -> np.ndarray:
    return np.random.default_rng(7).integers(0, 1 << 64, n, np.uint64)


def links_within(fps: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices of all pairs within the radius, tile by tile; ``fps`` are distinct."""
    refs = pivots()
    table = np.stack([np.bitwise_count(fps ^ r) for r in refs], 1).astype(np.int16)
    order = np.argsort(table[:, 0], kind="stable")
    table, sorted_fps = table[order], fps[order]
    first = table[:, 0]
    for a in range(0, len(fps), TILE):
        b = min(a + TILE, len(fps))
        stop = int(np.searchsorted(first, first[b - 1] + radius, "right"))
        for c in range(a, stop, TILE):
            d = min(c + TILE, stop)
            near = np.abs(first[a:b, None] - first[None, c:d]) <= radius
            if c == a:
                near &= np.arange(a, b)[:, None] < np.arange(c, d)[None, :]
            i, j = np.nonzero(near)
            i, j = i + a, j + c
            for k in range(1, len(refs)):
                if not len(i):
                    break
                ok = np.abs(table[i, k] - table[j, k]) <= radius
                i, j = i[ok], j[ok]
            close = np.bitwise_count(sorted_fps[i] ^ sorted_fps[j]) <= radius
            if close.any():
                yield order[i[close]], order[j[close]]


def spanning_links(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints: (smaller, larger) as signed values of the group's least."""
    label = np.arange(len(fps))
    for i, j in links_within(fps, radius):
        while len(i):
            p, q = label[i], label[j]
            apart = p != q
            i, j = i[apart], j[apart]
            np.minimum.at(label, np.maximum(p, q)[apart], np.minimum(p, q)[apart])
            while (label[label] != label).any():
                label = label[label]
    signed = fps.view(np.int64)
    hung = np.flatnonzero(label != np.arange(len(fps)))
    return list(zip(signed[label[hung]].tolist(), signed[hung].tolist(), strict=True))


def blocks(free: int, radius: int) -> list[int]:
    """Masks that divide the set bits of ``free`` into radius + 1 blocks of consecutive bits."""
    bits = [k for k in range(BITS) if free >> k & 1]
    return [sum(1 << int(k) for k in part) for part in np.array_split(bits, radius + 1)]


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def blocked(fps: DataFrame, radius: int) -> DataFrame:
    """One row for each fingerprint and block: path (what has been divided), value (the bits agreed on), fp."""
    keys = [F.struct(F.lit(signed(m)).alias("mask"), F.col("fp").bitwiseAND(signed(m)).alias("value")) for m in blocks((1 << 64) - 1, radius)]
    return fps.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.mask", "k.value")


def near_links(fps: DataFrame, radius: int = RADIUS, room: int = ROOM) -> DataFrame:
    """a < b: links that join all distinct fingerprints within the radius into their components."""
    spark = fps.sparkSession
    waiting = cut(blocked(fps, radius))
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = None
    for depth in range(3):
        sizes = waiting.groupBy("mask", "value").count()
        large = cut(sizes.filter(F.col("count") > room).select("mask", "value"))
        last = depth == 2 or not large.take(1)
        here = waiting if last else waiting.join(large, ["mask", "value"], "left_anti")
        links = cut(grouped_links(tiled(here, sizes, room), radius, parts))
        found = links if found is None else found.unionByName(links)
        if last:
            break
        # Those that agree on the mask divide its complement again; the masks are few and known.
        rest = waiting.join(large, ["mask", "value"])
        masks = [r["mask"] for r in large.select("mask").distinct().collect()]
        split = []
        for m in masks:
            for more in blocks(~m & ((1 << 64) - 1), radius):
                new = signed((m & ((1 << 64) - 1)) | more)
                split.append(rest.filter(F.col("mask") == m).select("fp", F.lit(new).alias("mask"), F.col("fp").bitwiseAND(new).alias("value")))
        waiting = split[0]
        for s in split[1:]:
            waiting = waiting.unionByName(s)
        waiting = cut(waiting)
    return found.distinct()


def tiled(members: DataFrame, sizes: DataFrame, room: int) -> DataFrame:
    """fp, mask, value and the two tiles that are compared: a group of more than ``room`` as all pairs of tiles of about half of it."""
    n = F.ceil(F.coalesce("count", F.lit(1)) / (room / 2)).cast("int")
    out = members.join(sizes.filter(F.col("count") > room), ["mask", "value"], "left").withColumn("tiles", F.when(F.col("count") > room, n).otherwise(1))
    out = out.withColumn("tile", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    return out.select("fp", "mask", "value", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"))


def grouped_links(members: DataFrame, radius: int, parts: int) -> DataFrame:
    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        key, held = None, []

        def close():
            if len(held) > 1:
                out.extend(spanning_links(np.array(held, np.int64).view(np.uint64), radius))

        for batch in batches:
            fp, *keys = (batch.column(c).to_numpy() for c in ("fp", "mask", "value", "low", "high"))
            edge = np.flatnonzero(np.concatenate([[True], np.logical_or.reduce([k[1:] != k[:-1] for k in keys])])) if len(fp) else fp
            for a, b in stretches_of(edge, len(fp)):
                if key != (own := tuple(k[a] for k in keys)):
                    close()
                    key, held = own, []
                held.extend(fp[a:b].tolist())
            if len(out) > 100_000:
                yield links_batch(out)
                out = []
        close()
        yield links_batch(out)

    keys = ["mask", "value", "low", "high"]
    dealt = members.repartition(parts, *keys).sortWithinPartitions(*keys, "fp")
    return map_arrow(dealt.select("fp", *keys), body, "a bigint, b bigint")


def links_batch(links: list[tuple[int, int]]) -> pa.RecordBatch:
    both = np.array(links, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], ["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """node, root: the least node of each node's component; nodes without a link are not listed.

    Large-star: every larger neighbour of a node links to the least neighbour or the node itself.
    Small-star: every smaller neighbour does. The links only ever move towards the least node, and
    each round ends in a table; it stops when no link changes.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = cut(small.filter("u <> v").distinct())
        state = edges.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("decimal(20,0)"))).first()
        if state == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = state


def grouped(docs: DataFrame, words: int = 3, radius: int = RADIUS, room: int = ROOM) -> DataFrame:
    """doc_id, text_key, fp, root (least fingerprint of the group) and component_id (its least doc_id) for every row."""
    marked = cut(fingerprints(docs, words))
    distinct = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(near_links(distinct.select("fp"), radius, room))
    placed = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    heads = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return marked.join(placed.join(heads, "root").select("fp", "root", "component_id"), "fp")


def near_duplicate_groups(docs: DataFrame, words: int = 3, radius: int = RADIUS, room: int = ROOM) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (least doc_id of the group) for every row."""
    return grouped(docs, words, radius, room).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, words: int = 3, radius: int = RADIUS, room: int = ROOM) -> DataFrame:
    """One row of each group, with all its columns: of the least doc_id (a null one last), and there of the least text hash."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("head")
    heads = cut(grouped(docs, words, radius, room).groupBy("root").agg(first).select(F.col("head.doc_id").alias("head_id"), F.col("head.text_key").alias("head_key")).distinct())
    packed = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.struct(*docs.columns).alias("row"))
    kept = packed.join(heads, packed["doc_id"].eqNullSafe(heads["head_id"]) & (packed["text_key"] == heads["head_key"]), "left_semi")
    return kept.dropDuplicates(["doc_id", "text_key"]).select(*[F.col("row")[c].alias(c) for c in docs.columns])
