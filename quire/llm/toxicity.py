"""Toxicity: a linear classifier over character n-grams, each scaled by its naive Bayes log-count ratio.

A text is lower-cased, runs of white space become one blank, and it begins and ends with a blank. Its features are
its n-grams of 3 to 6 code points, present or not, in 2^21 slots by hash. For each slot the ratio
r = log of its share of the toxic training texts to its share of the others (add-one) is counted over
all of them. A logistic regression with L2 penalty is then fitted to x = r * presence, on a bounded sample
of labelled texts (``SAMPLE`` a class, by hash of the id, and at most ``ENTRIES`` features in all; rows weigh
what their class has in all training rows) and on the slots that tell most (``CHOSEN``). A text's score is the
probability that follows, from all slots of the whole text.

Labels without an id or a value are left out; an id that is labelled more than once is toxic if any of its rows
says so. Null and empty texts have no features: their score is what the intercept gives. Rows that share a doc_id
are scored each, and each counts in training. A text of any length is read in stretches that overlap, and a
feature counts once for the text. Other columns pass by. Without training rows of both classes the
score of all texts is the smoothed share of toxic rows. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, keyed_texts, map_arrow, text_batches

BITS, SHORTEST, LONGEST = 21, 3, 6
CHOSEN, LEAST_TEXTS = 1 << 16, 3
SAMPLE, ENTRIES = 2000, 4_000_000
MARKS = 1 << 27  # bits that mark the ids with a label
PENALTY = 1.0
BLOCK = 1 << 14  # slots of one row of counts
STRETCH = 1 << 20  # code points of a long text that are hashed at once


class Features:
    """Distinct slots of texts. The stamps of the slots are reused from text to text."""

    def __init__(self, bits: int = BITS):
        self.bits = bits
        self.stamp = np.zeros(1 << bits, np.int32)

    def slots(self, text: str) -> np.ndarray:
        """All slots of a stretch, n by n; with repeats."""
        at = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
        h, out = at, []
        for n in range(2, LONGEST + 1):
            if len(at) < n:
                break
            h = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + at[n - 1 :]
            if n >= SHORTEST:
                out.append((((h + np.uint64(n)) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - self.bits)).astype(np.int32))
        return np.concatenate(out) if out else np.zeros(0, np.int32)

    def distinct(self, slots: np.ndarray) -> np.ndarray:
        place = np.arange(len(slots), dtype=np.int32)
        self.stamp[slots] = place
        return slots[self.stamp[slots] == place]

    def __call__(self, text: str | None) -> np.ndarray:
        words = " ".join((text or "").lower().split())
        if not words:
            return np.zeros(0, np.int32)
        words = f" {words} "
        if len(words) <= STRETCH:
            return self.distinct(self.slots(words))
        seen = np.zeros(1 << self.bits, bool)
        for begin in range(0, len(words), STRETCH):
            seen[self.slots(words[begin : begin + STRETCH + LONGEST - 1])] = True
        return np.flatnonzero(seen).astype(np.int32)


@dataclass
class Model:
    """What a slot adds to the log-odds, None for none; and the intercept."""

    weight: np.ndarray | None
    intercept: float

    def score(self, slots: np.ndarray) -> float:
        z = self.intercept + (float(self.weight[slots].sum(dtype=np.float64)) if self.weight is not None else 0.0)
        return float(1 / (1 + np.exp(-z))) if z > -700 else 0.0


def known_labels(labels: DataFrame, use: Column) -> DataFrame:
    """label_id and toxic (0 or 1) of the rows to learn from, one for each id."""
    rows = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & use)
    return rows.groupBy(F.col("doc_id").alias("label_id")).agg((F.max("toxic") > 0).cast("int").alias("toxic"))


def place_of(ident: Column) -> Column:
    return F.pmod(F.xxhash64(ident.cast("long")), F.lit(MARKS))


def marked(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The texts whose id may have a label: a bit for each id's hash, 16 MB however many labels there are, keeps most others from travelling."""
    at = place_of(F.col("label_id"))
    words = labels.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 AS int))")).alias("bits")).toArrow()
    bits = np.zeros(MARKS >> 6, np.int64)
    bits[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    sent = docs.sparkSession.sparkContext.broadcast(bits)

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("at").to_numpy()
            yield batch.select(["doc_id", "text"]).filter(pa.array((sent.value[at >> 6] >> (at & 63)) & 1 == 1))

    rows = keyed_texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text", place_of(F.col("doc_id")).alias("at"))
    return map_arrow(rows, body, "doc_id long, text string")


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The texts of labelled rows. The labels grow with the documents, so both sides meet by id at every size."""
    return marked(docs, labels).join(labels.hint("merge"), F.col("doc_id") == F.col("label_id")).select("doc_id", "text", "toxic")


def class_counts(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Texts by class (0, 1), and for each class and slot how many of them have it, over all rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, counts, texts = Features(), np.zeros((2, 1 << BITS), np.int32), np.zeros(2, np.int64)
        for columns in text_batches(batches):
            for text, toxic in zip(columns["text"], columns["toxic"], strict=True):
                counts[toxic][features(text)] += 1
                texts[toxic] += 1
        if texts.any():
            blocks = counts.reshape(2, -1, BLOCK)
            n = blocks.shape[1]
            yield pa.RecordBatch.from_arrays([
                pa.array(range(-1, n), pa.int32()), pa.array([texts.astype(np.int32).tobytes(), *(blocks[:, i].tobytes() for i in range(n))], pa.binary()),
            ], ["block", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                total[block] = total.get(block, 0) + np.frombuffer(data, np.int32).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["block", "counts"])

    counted = map_arrow(rows.select("text", "toxic"), count, "block int, counts binary").repartition("block")
    blocks = map_arrow(counted, add, "block int, counts binary").collect()  # one row a block
    found = {r.block: np.frombuffer(r.counts, np.int64).reshape(2, -1) for r in blocks}
    if not found:
        return np.zeros(2, np.int64), np.zeros((2, 1 << BITS), np.int64)
    return found.pop(-1).ravel(), np.concatenate([found[i] for i in sorted(found)], axis=1)


def sample_ids(labels: DataFrame, most: int) -> DataFrame:
    """At most ``most`` labels of each class, those of least hash."""
    parts = [labels.filter(F.col("toxic") == c).orderBy(F.xxhash64("label_id"), "label_id").limit(most) for c in (0, 1)]
    return parts[0].unionByName(parts[1])


def sample_features(rows: DataFrame, chosen: np.ndarray) -> DataFrame:
    """Of each sampled text the places in ``chosen`` of its features."""
    place = np.full(1 << BITS, -1, np.int32)
    place[chosen] = np.arange(len(chosen), dtype=np.int32)

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for columns in text_batches(batches):
            kept = [place[features(t)] for t in columns["text"]]
            kept = [np.sort(k[k >= 0]) for k in kept]
            yield pa.RecordBatch.from_arrays([
                pa.array(columns["doc_id"], pa.int64()), pa.array(columns["toxic"], pa.int32()),
                pa.array([len(k) for k in kept], pa.int64()), pa.array([k.tobytes() for k in kept], pa.binary()),
            ], ["doc_id", "toxic", "size", "places"])

    return map_arrow(rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "toxic"), body, "doc_id long, toxic int, size long, places binary")


def bounded(rows: DataFrame, most: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Sampled rows in order of their hash, of each class as many as hold half of ``most`` features together (one at least)."""
    keyed = rows.withColumn("h", F.xxhash64("doc_id", "places"))
    sizes = sorted(((r.h, r.toxic, r.size) for r in keyed.select("h", "toxic", "size").collect()))
    used, last = {0: 0, 1: 0}, {}
    for h, toxic, size in sizes:
        if toxic not in last or used[toxic] + size <= most // 2:
            last[toxic] = h
            used[toxic] += size
        else:
            used[toxic] = most  # the first that does not fit ends its class
    within = F.lit(False)
    for toxic, h in last.items():
        within = within | ((F.col("toxic") == toxic) & (F.col("h") <= h))
    kept = sorted(((r.h, r.toxic, bytes(r.places)) for r in keyed.filter(within).select("h", "toxic", "places").collect()))
    return [np.frombuffer(p, np.int32) for _, _, p in kept], np.array([t for _, t, _ in kept], np.float64)


def minimise(value_and_slope, start: np.ndarray, rounds: int = 200, memory: int = 8, tolerance: float = 1e-6) -> np.ndarray:
    """Limited-memory BFGS with a backtracking line search."""
    at, (value, slope) = start, value_and_slope(start)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        way, shares = slope.copy(), []
        for s, y in reversed(steps):
            shares.append((s @ way) / (y @ s))
            way -= shares[-1] * y
        way *= (steps[-1][0] @ steps[-1][1]) / (steps[-1][1] @ steps[-1][1]) if steps else 1 / max(1.0, float(np.abs(slope).sum()))
        for (s, y), share in zip(steps, reversed(shares), strict=True):
            way += s * (share - (y @ way) / (y @ s))
        length = 1.0
        while True:
            new = at - length * way
            new_value, new_slope = value_and_slope(new)
            if new_value <= value - 1e-4 * length * (slope @ way) or length < 1e-12:
                break
            length /= 2
        s, y = new - at, new_slope - slope
        done = abs(value - new_value) <= tolerance * abs(value)
        at, value, slope = new, new_value, new_slope
        if s @ y > 1e-12:
            steps = [*steps[-memory + 1 :], (s, y)]
        if done:
            break
    return at


def regress(rows: list[np.ndarray], toxic: np.ndarray, weight: np.ndarray, ratio: np.ndarray, penalty: float = PENALTY) -> tuple[np.ndarray, float]:
    """Weights of the chosen slots (to be scaled by their ratios) and the intercept."""
    d = len(ratio)
    at = np.concatenate([*rows, np.zeros(0, np.int32)])
    of = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows])

    def value_and_slope(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = np.bincount(of, (w[:d] * ratio)[at], len(rows)) + w[d]
        value = float((weight * (np.logaddexp(0, z) - toxic * z)).sum() + penalty / 2 * (w[:d] @ w[:d]))
        g = weight * (1 / (1 + np.exp(-np.clip(z, -700, 700))) - toxic)
        return value, np.append(np.bincount(at, g[of], d) * ratio + penalty * w[:d], g.sum())

    best = minimise(value_and_slope, np.zeros(d + 1))
    return best[:d], float(best[d])


def fit(docs: DataFrame, labels: DataFrame, use: Column, sample: int = SAMPLE, entries: int = ENTRIES) -> Model:
    """Learn from the labels that ``use`` (a condition on doc_id) admits."""
    known = cut(known_labels(labels, use))
    texts, counts = class_counts(labelled(docs, known))
    if not texts.all():
        share = (texts[1] + 1) / (texts.sum() + 2)
        return Model(None, float(np.log(share / (1 - share))))
    shares = (counts + 1) / (texts[:, None] + 2)
    ratio, total = np.log(shares[1] / shares[0]), counts.sum(axis=0)
    telling = np.where(total >= LEAST_TEXTS, np.abs(ratio) * np.sqrt(total), 0)
    chosen = np.argsort(-telling, kind="stable")[:CHOSEN]
    chosen = np.sort(chosen[telling[chosen] > 0])
    ratio = ratio[chosen]
    del counts, shares, total, telling
    drawn = cut(sample_ids(known, sample))
    sampled = keyed_texts(docs).join(drawn, F.col("doc_id") == F.col("label_id")).select("doc_id", "text", "toxic")  # 2 * sample ids
    rows, toxic = bounded(cut(sample_features(sampled, chosen)), entries)
    weight = np.where(toxic > 0, texts[1] / max(1, toxic.sum()), texts[0] / max(1, (1 - toxic).sum()))
    w, intercept = regress(rows, toxic, weight, ratio)
    full = np.zeros(1 << BITS, np.float32)
    full[chosen] = w * ratio
    return Model(full, intercept)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row. The model is 8 MB, whatever it was learnt from."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for columns in text_batches(batches):
            scores = [sent.value.score(features(t)) for t in columns["text"]]
            yield pa.RecordBatch.from_arrays([pa.array(columns["doc_id"], pa.int64()), pa.array(scores, pa.float64())], ["doc_id", "score"])

    rows = keyed_texts(docs).withColumn("doc_id", F.col("doc_id").cast("long"))
    return map_arrow(rows, body, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, held_out: Column) -> DataFrame:
    """doc_id and score by a model that learns from the labels that are not held out."""
    return score(docs, fit(docs, labels, ~held_out))
