"""Near-duplicates by similarity of word shingles: SimHash of 256 bits for the pipeline.

The fraction of bits in which two SimHashes differ estimates the angle between the texts' shingle counts, and so
their Jaccard similarity: with equally many shingles, J makes a cosine of 2J / (1 + J). It only says which pairs are
looked at: those within the bits of ``least`` and ``SLACK`` standard deviations more. Two texts link if the Jaccard
similarity of their shingle multisets, taken from the texts, is ``least`` or more. Texts with equal multisets collapse before.

Pairs meet where they agree on one of several fixed random choices of bits. How many bits a choice has follows
the number of texts, and how many choices there are follows from that, so that at every size a pair at the limit meets
with a chance of at least ``RECALL`` (far more above the limit). A pair counts only where it meets first, on no choice before;
so it is given off once, however many places it meets in. A place gives off at most one pair for each of its
texts at first: all its pairs near in bits where they are no more than that, else those of a leader with those near it.
Once these are verified, what is not in one component yet is compared over all pairs of tiles of about ``ROOM``
texts. Counts of the shingles by bucket, sent along with the fingerprint only here, rule out pairs that are near in bits and cannot be
similar: their difference is a lower bound of what only one of the texts has. So a family of near copies gives
off few pairs for each text, and no pair is left out. Pivot distance tables as in ``simhash`` thin out
the pairs of large groups, and components come from the same contraction.

A null or empty text has no shingles and collapses with its like. Repeated rows, equal and null ids are allowed;
a null id comes last in the choice of the one that stays. Other columns pass through.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, map_arrow, stretches_of, text_batches
from .decontam import Words, mixed, shingle_hashes
from .simhash import PIVOTS, TILE, components

WORDS, LEAST, RECALL = 5, 0.8, 0.99
LANES = 4  # of 64 bits
SLACK = 3.5
LARGE, ROOM, LEADERS = 64, 4096, 32
CHOICE_BITS = 16
LANE_SEEDS = np.random.default_rng(31).integers(1, 1 << 64, LANES, np.uint64) | np.uint64(1)


def differing(least: float) -> int:
    """Bits of a fingerprint that may differ at a similarity of ``least``."""
    return int(64 * LANES * math.acos(2 * least / (1 + least)) / math.pi + 0.5)


def looked_at(least: float) -> int:
    """Bits that may differ in a pair that is verified."""
    p = math.acos(2 * least / (1 + least)) / math.pi
    return differing(least) + math.ceil(SLACK * math.sqrt(64 * LANES * p * (1 - p)))


def choices(n_texts: int, least: float = LEAST) -> list[np.ndarray]:
    """The bits of each choice: at least 16, more for more texts, and as many choices as the recall needs."""
    size = max(16, math.ceil(math.log2(max(2, n_texts))) - 2)
    agree = (1 - math.acos(2 * least / (1 + least)) / math.pi) ** size
    rng = np.random.default_rng(17)
    return [rng.choice(64 * LANES, size, replace=False) for _ in range(math.ceil(math.log(1 - RECALL) / math.log(1 - agree)))]


def wide_fingerprint(shingles: np.ndarray) -> np.ndarray:
    bits = np.zeros(64 * LANES, np.int64)
    for a in range(0, len(shingles), 1 << 14):
        lanes = mixed(shingles[a : a + (1 << 14), None] * LANE_SEEDS[None, :])
        bits += np.unpackbits(lanes.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.uint32)
    return np.packbits(2 * bits > len(shingles), bitorder="little")


def shingles_of(texts: list[str | None], words: int) -> list[np.ndarray]:
    """The sorted shingles of each text, repeats included."""
    w = Words([t or "" for t in texts])
    return [np.sort(shingle_hashes(w.hashes[a:b], words)) for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)]


def wide_fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, text_key (hash of the text), node (hash of the shingles) and fp (32 bytes) of every row."""

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for part in text_batches(batches, 2 << 20):
            every = shingles_of(part["text"], words)
            nodes = np.array([xxhash.xxh64_intdigest(x.tobytes()) for x in every], np.uint64).view(np.int64)
            fps = pa.array([wide_fingerprint(x).tobytes() for x in every], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(part["doc_id"], pa.int64()), pa.array(part["text_key"], pa.int64()), pa.array(nodes), fps], ["doc_id", "text_key", "node", "fp"])

    return map_arrow(docs.select("doc_id", "text", F.xxhash64("text").alias("text_key")), body, "doc_id bigint, text_key bigint, node bigint, fp binary")


def meeting_places(fps: DataFrame, chosen: list[np.ndarray]) -> DataFrame:
    """place (the chosen bits, and in the last CHOICE_BITS the choice), node and fp: a row for each distinct fingerprint and choice."""

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 4096):
                part = batch.slice(begin, 4096)
                raw = np.frombuffer(b"".join(part.column("fp").to_pylist()), np.uint8).reshape(-1, 8 * LANES)
                bits = np.unpackbits(raw, axis=1, bitorder="little")
                for k, own in enumerate(chosen):
                    value = bits[:, own].astype(np.uint64) @ (np.uint64(1) << np.arange(len(own), dtype=np.uint64))
                    place = (value << np.uint64(CHOICE_BITS) | np.uint64(k)).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(place), part.column("node"), part.column("fp")], ["place", "node", "fp"])

    return map_arrow(fps, body, "place bigint, node bigint, fp binary")


def part_of_place(*tiles: Column) -> Column:
    """A group of the place's choice for each of the ``tiles`` of the place."""
    return F.xxhash64("place", *tiles).bitwiseAND(-(1 << CHOICE_BITS)).bitwiseOR(F.col("place").bitwiseAND((1 << CHOICE_BITS) - 1))


def masks_of(chosen: list[np.ndarray]) -> np.ndarray:
    """Each choice as a row of LANES words with its bits set."""
    bits = np.zeros((len(chosen), 64 * LANES), bool)
    for k, own in enumerate(chosen):
        bits[k, own] = True
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


def first_meeting(i: np.ndarray, j: np.ndarray, fps: np.ndarray, group: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """Whether the pairs i, j, which meet in ``group`` of i, agree on no choice before the one of that group."""
    choice, differ = group[i] & ((1 << CHOICE_BITS) - 1), fps[i] ^ fps[j]
    own = np.arange(len(i))
    for k in range(int(choice.max(initial=0))):
        own = own[(choice[own] <= k) | (differ[own] & masks[k]).any(1)]
    out = np.zeros(len(i), bool)
    out[own] = True
    return out


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)


def group_links(fps: np.ndarray, radius: int, apart: tuple[np.ndarray, ...] = ()) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices of all pairs of a group within the radius that differ in each of ``apart``, by pivot distance tables, tile by tile."""
    refs = np.random.default_rng(7).integers(0, 1 << 64, (PIVOTS, LANES), np.uint64)
    table = np.stack([distance(fps, r) for r in refs], 1).astype(np.int16)
    order = np.argsort(table[:, 0], kind="stable")
    table, ordered, apart = table[order], fps[order], tuple(x[order] for x in apart)
    for a in range(0, len(fps), TILE):
        b = min(a + TILE, len(fps))
        stop = int(np.searchsorted(table[:, 0], table[b - 1, 0] + radius, "right"))
        for c in range(a, stop, TILE):
            d = min(c + TILE, stop)
            near = np.abs(table[a:b, None, 0] - table[None, c:d, 0]) <= radius
            for k in range(1, PIVOTS):
                near &= np.abs(table[a:b, None, k] - table[None, c:d, k]) <= radius
            exact = sum(np.bitwise_count(ordered[a:b, None, k] ^ ordered[None, c:d, k]).astype(np.int16) for k in range(LANES))
            near &= exact <= radius
            for x in apart:
                near &= x[a:b, None] != x[None, c:d]
            if c == a:
                near &= np.arange(a, b)[:, None] < np.arange(c, d)[None, :]
            i, j = np.nonzero(near)
            if len(i):
                yield order[i + a], order[j + c]


def forest(nodes: np.ndarray, fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Stars: a leader, and those within the radius of it that no leader before has; LEADERS of them at most."""
    left, out = np.arange(len(nodes)), []
    for _ in range(LEADERS):
        if len(left) < 2:
            break
        lead, left = left[0], left[1:]
        near = distance(fps[left], fps[lead]) <= radius
        out += [(int(nodes[lead]), x) for x in nodes[left[near]].tolist()]
        left = left[~near]
    return out


def near_in_small(fps: np.ndarray, group: np.ndarray, size: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of all pairs within the radius in groups (sorted) of up to LARGE; ``size``: of the group of each row."""
    found = [(np.zeros(0, np.int64),) * 2]
    for shift in range(1, min(LARGE, len(group))):
        i = np.flatnonzero((group[:-shift] == group[shift:]) & (size[:-shift] <= LARGE))
        if not len(i):
            break
        i = i[distance(fps[i], fps[i + shift]) <= radius]
        found.append((i, i + shift))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def bucket_counts(shingles: np.ndarray) -> np.ndarray:
    """How many shingles fall into each of about as many buckets, modulo 256; a power of two, so that counts fold."""
    width = 1 << min(max(math.ceil(math.log2(max(1, len(shingles)))), 8), 12)
    return np.bincount((shingles % np.uint64(width)).astype(np.int64), minlength=width).astype(np.uint8)


def apart_at_least(i: np.ndarray, j: np.ndarray, counts: list[np.ndarray]) -> np.ndarray:
    """For each pair, a number of shingles of either text that the other one lacks for certain: the difference of their bucket counts."""
    width, out = np.array([len(x) for x in counts]), np.zeros(len(i), np.int64)
    both = np.minimum(width[i], width[j])
    for w in np.unique(both).tolist():
        at = np.flatnonzero(both == w)
        for begin in range(0, len(at), (1 << 22) // w):
            part = at[begin : begin + (1 << 22) // w]
            rows, back = np.unique(np.concatenate([i[part], j[part]]), return_inverse=True)
            table = np.stack([counts[r].reshape(-1, w).sum(0, dtype=np.uint8) for r in rows.tolist()])
            d = table[back[: len(part)]] - table[back[len(part) :]]
            out[part] = np.minimum(d, -d).sum(1, dtype=np.int64)
    return out


def whole_groups(batches: Iterator[pa.RecordBatch], found: Callable) -> Iterator[pa.RecordBatch]:
    """What ``found`` gives for batches of whole groups; groups come sorted."""
    rest = None
    for batch in batches:
        rows = batch if rest is None else pa.concat_batches([rest, batch])
        group = rows.column("group").to_numpy()
        last = int(np.searchsorted(group, group[-1])) if len(group) else 0  # the last may go on
        if last:
            yield from found(rows.slice(0, last))
        rest = rows.slice(last)
    if rest is not None and rest.num_rows:
        yield from found(rest)


def fingerprints_of(rows: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(rows.column("fp").to_pylist()), np.uint64).reshape(-1, LANES)


def by_group(rows: DataFrame) -> DataFrame:
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "group").sortWithinPartitions("group", "node")


def first_pairs(members: DataFrame, radius: int, masks: np.ndarray) -> DataFrame:
    """Of the groups of ``members`` (group, node, fp, tiles) at most one pair a < b for each node, with a null group; and a row group, a of each node whose pairs are not all among them.

    Pairs are those within the radius that meet in the group first. A group of up to LARGE with no more of them than nodes gives all, others those of a leader with those near it.
    The nodes of a group that is a tile (``tiles`` not null) get no row.
    """

    def found(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        group, node, raw = rows.column("group").to_numpy(), rows.column("node").to_numpy(), fingerprints_of(rows)
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        sizes = np.diff(np.append(first, len(group)))
        of = np.repeat(np.arange(len(first)), sizes)
        i, j = near_in_small(raw, group, sizes[of], radius)
        own = first_meeting(i, j, raw, group, masks)
        i, j = i[own], j[own]
        crowded = (np.bincount(of[i], minlength=len(first)) > sizes) | (sizes > LARGE)
        later = sizes[of] > LARGE
        later[i[crowded[of[i]]]] = later[j[crowded[of[i]]]] = True
        a, b = [node[i[~crowded[of[i]]]]], [node[j[~crowded[of[i]]]]]
        for k in np.flatnonzero(crowded).tolist():
            at = first[k] + np.flatnonzero(later[first[k] : first[k] + sizes[k]])
            i, j = np.array(forest(at, raw[at], radius), np.int64).reshape(-1, 2).T
            own = first_meeting(i, j, raw, group, masks)
            a.append(node[i[own]])
            b.append(node[j[own]])
        a, b = np.concatenate(a), np.concatenate(b)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.int64()), pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["group", "a", "b"])
        later = np.flatnonzero(later & (rows.column("tiles").is_null().to_numpy(zero_copy_only=False)))
        yield pa.RecordBatch.from_arrays([pa.array(group[later]), pa.array(node[later]), pa.nulls(len(later), pa.int64())], ["group", "a", "b"])

    return map_arrow(by_group(members), lambda batches: whole_groups(batches, found), "group bigint, a bigint, b bigint")


def other_pairs(members: DataFrame, radius: int, least: float, masks: np.ndarray) -> DataFrame:
    """a < b: pairs within the radius and of different roots in the groups of ``members`` (group, tile, node, fp, root, size, counts) that meet
    there first and that the bucket counts do not rule out; of a group's tiles, if there are two, one from each."""

    def found(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        group, tile, node, root, size = (rows.column(c).to_numpy() for c in ("group", "tile", "node", "root", "size"))
        raw, counts = fingerprints_of(rows), [np.frombuffer(x, np.uint8) for x in rows.column("counts").to_pylist()]
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        sizes = np.diff(np.append(first, len(group)))
        two = np.repeat(np.logical_or.reduceat(tile != np.repeat(tile[first], sizes), first), sizes)

        def left(i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
            ok = (root[i] != root[j]) & (~two[i] | (tile[i] != tile[j]))
            i, j = i[ok], j[ok]
            ok = first_meeting(i, j, raw, group, masks)
            i, j = i[ok], j[ok]
            # A similarity of ``least`` leaves so many shingles that only one of the texts has.
            ok = apart_at_least(i, j, counts) <= (size[i] + size[j]) * (1 - least) / (1 + least) + 1e-6
            a, b = node[i[ok]], node[j[ok]]
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

        yield left(*near_in_small(raw, group, np.repeat(sizes, sizes), radius))
        for a, b in stretches_of(first, len(group)):
            if b - a > LARGE and (root[a:b] != root[a]).any():
                for i, j in group_links(raw[a:b], radius, (root[a:b], tile[a:b]) if two[a] else (root[a:b],)):
                    yield left(a + i, a + j)

    return map_arrow(by_group(members), lambda batches: whole_groups(batches, found), "a bigint, b bigint").distinct()


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two multisets."""
    (x, n), (y, m) = np.unique(a, return_counts=True), np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    shared = int(np.minimum(n[i], m[j]).sum())
    return shared / max(1, len(a) + len(b) - shared)


def verified(pairs: DataFrame, texts: DataFrame, words: int, least: float) -> DataFrame:
    """The pairs a, b whose similarity is ``least`` or more; ``texts``: node and text."""

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_batches(batches, 2 << 20):
            every = [x.tobytes() for x in shingles_of(part["text"], words)]
            yield pa.RecordBatch.from_arrays([pa.array(part["node"], pa.int64()), pa.array(every, pa.binary())], ["node", "shingles"])

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("x"), batch.column("y")
            good = [jaccard(np.frombuffer(x[k].as_py(), np.uint64), np.frombuffer(y[k].as_py(), np.uint64)) >= least - 1e-12 for k in range(batch.num_rows)]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    pairs = cut(pairs)
    asked = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    known = cut(map_arrow(texts.join(asked, "node", "left_semi"), shingles, "node bigint, shingles binary").dropDuplicates(["node"]))
    both = pairs.join(known.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(known.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    return cut(map_arrow(both.select("a", "b", "x", "y"), body, "a bigint, b bigint"))


def counted(texts: DataFrame, words: int) -> DataFrame:
    """node, size (shingles) and counts (by bucket) of each node of ``texts``."""

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_batches(batches, 2 << 20):
            every = shingles_of(part["text"], words)
            sizes, counts = pa.array([len(x) for x in every], pa.int64()), pa.array([bucket_counts(x).tobytes() for x in every], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(part["node"], pa.int64()), sizes, counts], ["node", "size", "counts"])

    return map_arrow(texts.select("node", "text"), body, "node bigint, size bigint, counts binary").dropDuplicates(["node"])


def similar_links(fps: DataFrame, texts: DataFrame, words: int, least: float, chosen: list[np.ndarray]) -> DataFrame:
    """a, b: links of similarity ``least`` or more that join all nodes which meet into their components."""
    radius, places, masks = looked_at(least), meeting_places(fps, chosen), masks_of(chosen)
    # Only places of several tiles are joined to anything; written, so that the optimizer sees how few they are. A row of any other place travels once.
    tiles = F.ceil(F.col("count") / ROOM).cast("int").alias("tiles")
    big = cut(places.groupBy("place").count().filter(F.col("count") > ROOM).select("place", tiles))
    members = places.join(big, "place", "left")
    tile = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")
    group = F.when(F.col("tiles").isNull(), F.col("place")).otherwise(part_of_place(tile))
    first = cut(first_pairs(members.select(group.alias("group"), "node", "fp", "tiles"), radius, masks))
    links = verified(first.filter("b IS NOT NULL").select("a", "b"), texts, words, least)
    later = first.filter("b IS NULL").select(F.col("group").alias("place"), F.col("a").alias("node"))
    if big.take(1):
        later = later.unionByName(members.filter("tiles IS NOT NULL").select("place", "node"))
    elif not later.take(1):
        return links
    rooted = cut(later.join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node")))
    # Places whose nodes are all in one component are done.
    tiles = F.ceil(F.count(F.lit(1)) / ROOM).cast("int").alias("tiles")
    mixed = cut(rooted.groupBy("place").agg(tiles, F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("place", "tiles"))
    rooted = cut(rooted.join(mixed, "place").withColumn("tile", tile))
    asked = rooted.select("node").distinct()
    known = cut(counted(texts.join(asked, "node", "left_semi"), words).join(fps, "node"))
    other = rooted.join(known, "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    group = part_of_place(F.least("tile", "other"), F.greatest("tile", "other"))
    rest = other_pairs(other.select(group.alias("group"), "tile", "node", "fp", "root", "size", "counts"), radius, least, masks)
    return links.unionByName(verified(rest, texts, words, least))


def one_of_similar(docs: DataFrame, words: int = WORDS, least: float = LEAST) -> DataFrame:
    """One row of each group, with all its columns: of the least doc_id (a null one last), and there of the least text hash."""
    marked = cut(wide_fingerprints(docs, words))
    head = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("head")
    distinct = cut(marked.groupBy("node", "fp").agg(head))
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    heads = distinct.select("node", F.col("head.doc_id").alias("head_id"), F.col("head.text_key").alias("head_key"))
    texts = texts.join(heads, (texts["text_key"] == heads["head_key"]) & texts["doc_id"].eqNullSafe(heads["head_id"])).select("node", "text")
    links = similar_links(distinct.select("node", "fp"), texts, words, least, choices(distinct.count(), least))
    roots = components(links)
    placed = distinct.join(roots, "node", "left").select(F.coalesce("root", "node").alias("root"), "head")
    heads = cut(placed.groupBy("root").agg(F.min("head").alias("head")).select(F.col("head.doc_id").alias("head_id"), F.col("head.text_key").alias("head_key")))
    packed = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.struct(*docs.columns).alias("row"))
    kept = packed.join(heads, packed["doc_id"].eqNullSafe(heads["head_id"]) & (packed["text_key"] == heads["head_key"]), "left_semi")
    return kept.dropDuplicates(["doc_id", "text_key"]).select(*[F.col("row")[c].alias(c) for c in docs.columns])
