"""Benchmark decontamination: SimHash over item-sized windows, multi-index Hamming blocks, exact verification.

Words are runs without ASCII white space, lower-cased A-Z; shingles have ``WORDS`` words (a text of
fewer words is one shingle, one of none has none and matches nothing). A window has as many words as the
item it is compared with (the whole document if that is shorter). Its SimHash over 64-bit shingle hashes
is looked up among the items: of 8 blocks of 8 bits, one at least differs in two bits or fewer if the
fingerprints differ in ``RADIUS`` = 23 or fewer, so tables of the block values within two bits give every
item within the radius. A candidate counts if the weighted Jaccard similarity of the two shingle multisets,
taken from the words themselves, is ``SIMILARITY`` or more.

A window that shares no shingle with any item has similarity 0, so fingerprints are made only for windows
over a shared shingle; all shingles of all texts are looked up.

The items are the query set. They are sent to the tasks in blocks of at most about ``block_bytes``, with
one pass over the documents for each block, so what is broadcast is bounded whatever the benchmark's size.

Null texts and items are empty. Repeated items each match; a null item_id or doc_id is reported as such.
Ties go to the first window. Other columns are not looked at.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, ascii_words, cut, map_arrow, text_batches

WORDS, SIMILARITY, RADIUS = 5, 0.8, 23
BLOCKS, ERRORS = 8, 2
FOUND = "doc_id bigint, item_id bigint, start_word bigint, similarity double, text_key bigint"

_SEED = np.random.default_rng(11)
BYTE_VALUES = _SEED.integers(1, 1 << 64, 256, np.uint64)
STEP = np.uint64(0x9E3779B97F4A7C15)
SLOTS = 1 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser with shifts 33 and two odd multipliers."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_POWERS = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        _POWERS = np.cumprod(np.concatenate([[np.uint64(1)], np.full(2 * n, STEP, np.uint64)]), dtype=np.uint64)
    return _POWERS


class Words:
    """The words of several texts at once: byte array, begins, ends, hashes, and where each text's words begin."""

    def __init__(self, texts: list[str]):
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        self.data = LOWER[np.frombuffer(b"\n".join(raw), np.uint8)]
        self.begins, self.ends = ascii_words(self.data)
        sizes = np.array([len(r) + 1 for r in raw], np.int64)
        self.first = np.concatenate([[0], np.searchsorted(self.begins, np.cumsum(sizes))])
        lengths = self.ends - self.begins
        if len(lengths):
            flat = np.concatenate([[0], np.cumsum(lengths)])
            place = np.arange(flat[-1]) - np.repeat(flat[:-1], lengths)
            values = BYTE_VALUES[self.data[place + np.repeat(self.begins, lengths)]] * powers(int(lengths.max()))[place]
            self.hashes = mixed(np.add.reduceat(values, flat[:-1]) + lengths.astype(np.uint64))
        else:
            self.hashes = np.zeros(0, np.uint64)

    def shingles(self, a: int, b: int) -> np.ndarray:
        return shingle_hashes(self.hashes[a:b])

    def words(self, a: int, b: int) -> list[bytes]:
        return [self.data[i:j].tobytes() for i, j in zip(self.begins[a:b], self.ends[a:b], strict=True)]


def shingle_hashes(words: np.ndarray, size: int = WORDS) -> np.ndarray:
    """Hashes of all runs of ``size`` words, or of the whole if it is shorter."""
    if len(words) == 0:
        return words
    size = min(size, len(words))
    total = np.zeros(len(words) - size + 1, np.uint64)
    for k in range(size):
        total = total * STEP + words[k : k + len(total)]
    return mixed(total + np.uint64(size))


def simhashes(shingles: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """SimHash of the windows of ``size`` shingles at ``starts``."""
    bits = np.unpackbits(shingles.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    sums = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(bits, axis=0, dtype=np.int32)])
    ones = sums[starts + size] - sums[starts]
    return np.packbits(2 * ones > size, axis=1, bitorder="little").view(np.uint64).ravel()


def shingle_counts(words: list[bytes]) -> Counter:
    size = min(WORDS, len(words))
    return Counter(tuple(words[i : i + size]) for i in range(len(words) - size + 1)) if words else Counter()


def similarity(a: Counter, b: Counter) -> float:
    shared = (a & b).total()
    return shared / (a.total() + b.total() - shared) if shared else 0.0


class Items:
    """A block of items with their shingles, fingerprints and Hamming block tables."""

    def __init__(self, ids: list, texts: list[str]):
        w = Words(texts)
        spans = [(int(a), int(b)) for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
        kept = [(i, s) for i, s in zip(ids, spans, strict=True) if s[1] > s[0]]
        self.ids = [i for i, _ in kept]
        self.n_words = np.array([b - a for _, (a, b) in kept], np.int64)
        own = [w.shingles(a, b) for _, (a, b) in kept]
        self.counts = [shingle_counts(w.words(a, b)) for _, (a, b) in kept]
        self.fps = np.array([simhashes(s, np.array([0]), len(s))[0] for s in own], np.uint64)
        every = np.concatenate(own) if own else np.zeros(0, np.uint64)
        of = np.repeat(np.arange(len(own)), [len(s) for s in own])
        order = np.argsort(every, kind="stable")
        self.shingles, self.of = every[order], of[order]
        self.slots = np.zeros(SLOTS, bool)
        self.slots[self.shingles >> np.uint64(44)] = True
        near = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8)[None, :]) <= ERRORS
        by_block = self.fps.view(np.uint8).reshape(-1, BLOCKS)
        self.tables = [[np.flatnonzero(near[v][by_block[:, k]]) for v in range(256)] for k in range(BLOCKS)] if own else []

    def within(self, fp: np.uint64, radius: int) -> np.ndarray:
        """Indices of all items whose fingerprint is within the radius."""
        values = np.array([fp], np.uint64).view(np.uint8)
        some = np.unique(np.concatenate([self.tables[k][v] for k, v in enumerate(values)]))
        return some[np.bitwise_count(self.fps[some] ^ fp) <= radius]


def matches(items: Items, w: Words, a: int, b: int, shingles: np.ndarray, hits: np.ndarray, radius: int, least: float) -> Iterator[tuple[int, int, float]]:
    """(item index, first word, similarity): the best window of each item in one text; hits are places of shared shingles."""
    left, right = np.searchsorted(items.shingles, shingles[hits]), np.searchsorted(items.shingles, shingles[hits], "right")
    places: dict[int, list[int]] = {}
    for at, x, y in zip(hits.tolist(), left.tolist(), right.tolist(), strict=True):
        for item in set(items.of[x:y].tolist()):
            places.setdefault(item, []).append(at)
    words = None
    sizes: dict[int, dict[int, list[int]]] = {}
    for item in places:
        sizes.setdefault(min(int(items.n_words[item]), b - a), {})[item] = places[item]
    for size, wanted in sizes.items():
        n = max(1, size - WORDS + 1)
        last = len(shingles) - n
        for item, at in wanted.items():
            m = items.counts[item].total()
            near = np.array(at)
            starts = np.unique(np.clip(near[:, None] - np.arange(n)[None, :], 0, last))
            # Shared shingles bound the similarity from above.
            most = np.searchsorted(near, starts + n) - np.searchsorted(near, starts)
            starts = starts[most * (1 + least) >= least * (n + m) - 1e-9]
            if not len(starts):
                continue
            low = int(starts[0])
            fps = simhashes(shingles[low : int(starts[-1]) + n], starts - low, n)
            best = None
            for s, fp in zip(starts.tolist(), fps, strict=True):
                if item not in items.within(fp, radius):
                    continue
                words = words or w.words(a, b)
                got = similarity(shingle_counts(words[s : s + size]), items.counts[item])
                if got >= least and (best is None or got > best[1]):
                    best = (s, got)
                    if got == 1.0:
                        break
            if best:
                yield item, best[0], best[1]


def contaminated(docs: DataFrame, benchmark: DataFrame, radius: int = RADIUS, least: float = SIMILARITY, block_bytes: int = 8 << 20) -> DataFrame:
    """doc_id, item_id, start_word, similarity, text_key (hash of the text): the best window of every document for every item it contains."""
    texts = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // block_bytes) or 1
    found = None
    for k in range(n):
        block = texts.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else texts
        rows = block.orderBy("item_id", "text").toArrow()
        one = against(docs, rows.column("item_id").to_pylist(), rows.column("text").to_pylist(), radius, least)
        found = one if found is None else found.unionByName(one)
    return found


def against(docs: DataFrame, ids: list, texts: list[str], radius: int, least: float) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast((ids, texts))
    held: list[Items] = []

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not held:
            held.append(Items(*sent.value))
        items = held[0]
        for part in text_batches(batches, 2 << 20):
            w = Words([t or "" for t in part["text"]])
            rows: list[tuple] = []
            if len(items.ids) and len(w.hashes):
                every = shingle_hashes(w.hashes)  # those across two texts are not looked at
                maybe = np.flatnonzero(items.slots[every >> np.uint64(44)])
                at = np.minimum(np.searchsorted(items.shingles, every[maybe]), len(items.shingles) - 1)
                maybe = maybe[items.shingles[at] == every[maybe]]
                sizes = np.diff(w.first)
                short = np.flatnonzero((sizes > 0) & (sizes < WORDS))
                touched = np.unique(np.concatenate([np.searchsorted(w.first, maybe, "right") - 1, short]))
                for d in touched.tolist():
                    a, b = int(w.first[d]), int(w.first[d + 1])
                    shingles = w.shingles(a, b)
                    known = np.minimum(np.searchsorted(items.shingles, shingles), len(items.shingles) - 1)
                    hits = np.flatnonzero(items.shingles[known] == shingles)
                    if len(hits):
                        rows += [(part["doc_id"][d], items.ids[i], s, x, part["text_key"][d]) for i, s, x in matches(items, w, a, b, shingles, hits, radius, least)]
            if rows:
                doc, item, start, sim, key = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(item, pa.int64()), pa.array(start, pa.int64()), pa.array(sim, pa.float64()), pa.array(key, pa.int64())], ["doc_id", "item_id", "start_word", "similarity", "text_key"])

    return map_arrow(docs.select("doc_id", "text", F.xxhash64("text").alias("text_key")), body, FOUND)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that contain no item, with all their columns."""
    found = contaminated(docs, benchmark)
    bad = cut(found.select(F.col("doc_id").alias("bad_id"), F.col("text_key").alias("bad_key")).distinct())
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["bad_id"]) & (F.xxhash64(docs["text"]) == bad["bad_key"]), "left_anti")
