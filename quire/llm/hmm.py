"""Hidden Markov language model over whole texts.

Tokens are words (runs without ASCII white space, lower-cased A-Z) and one end per text. A state emits one
of ``SYMBOLS`` word classes (a hash of the word) or the end; within its class a word has the add-one
probability of its count, with one share left for all words not seen. So the model sums to one over any
vocabulary, its matrices have a fixed size, and what it gathers from the corpus is every word's count.

1. ``tokenise``: each task numbers the words of a bounded block of documents and writes the documents as
   word numbers and the block's distinct words with their counts in training texts. A word's number is its
   class plus ``SYMBOLS`` times a running number.
2. ``count_words``: blocks' words meet by word, once per block, so a frequent word is no hot key; the total
   count goes back to the blocks that asked.
3. ``train``: Baum-Welch. Tasks run the scaled forward-backward recursion over all training texts, in
   segments of at most ``SEGMENT`` tokens with a start distribution of their own for segments inside a text; expected counts are
   summed over partitions as 64-bit fixed-point numbers, so the result does not depend on the order.
4. ``score``: per block, the exact scaled forward recursion over each whole text.

A null text is empty: one end token. Without training texts all counts are 0 and the model is uniform.
Repeated rows and equal or null ids are scored each. Other columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keyed_texts, map_arrow, scratch, text_batches

STATES, SYMBOLS, ITERATIONS = 8, 1024, 5
SEGMENT = 512
BLOCK_WORDS, BLOCK_TOKENS = 400_000, 8_000_000
FIXED = 1 << 16
SMOOTH = 0.01

TOKENISED = "block bigint, doc_id bigint, train boolean, ids binary, word binary, local int, n bigint"
COUNTED = "block bigint, local int, n bigint, kinds bigint"
_READ = {"words": TOKENISED, "counts": COUNTED}


class Numbers(dict):
    """Word to number; a new word takes its class's next one."""

    def __init__(self):
        self.next = [0] * SYMBOLS

    def __missing__(self, word: bytes) -> int:
        symbol = zlib.crc32(word) % SYMBOLS
        self[word] = number = symbol + SYMBOLS * self.next[symbol]
        self.next[symbol] += 1
        return number


def tokenise(docs: DataFrame, train: Column, folder: str) -> None:
    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 24
        block, numbers, counts, tokens = 0, Numbers(), np.zeros(0, np.int64), 0

        def words() -> Iterator[pa.RecordBatch]:
            keys = list(numbers)
            for a in range(0, len(keys), 50_000):
                local = np.array([numbers[w] for w in keys[a : a + 50_000]], np.int64)
                n = np.where(local < len(counts), counts[np.minimum(local, len(counts) - 1)] if len(counts) else 0, 0)
                yield row_batch(len(local), kind=1, block=first + block, word=keys[a : a + 50_000], local=local, n=n)

        for part in text_batches(batches):
            find = numbers.__getitem__
            ids = [np.fromiter(map(find, t.encode("utf-8", "surrogatepass").lower().split()), np.uint32) for t in part["text"]]
            seen = [x for x, use in zip(ids, part["train"], strict=True) if use]
            if seen:
                new = np.bincount(np.concatenate(seen), minlength=len(counts))
                new[: len(counts)] += counts
                counts = new
            tokens += sum(map(len, ids))
            yield row_batch(len(ids), kind=0, block=first + block, doc_id=part["doc_id"], train=part["train"], ids=[x.astype("<u4").tobytes() for x in ids])
            if len(numbers) > BLOCK_WORDS or tokens > BLOCK_TOKENS:
                yield from words()
                block, numbers, counts, tokens = block + 1, Numbers(), np.zeros(0, np.int64), 0
        yield from words()

    given = keyed_texts(docs, F.coalesce(train, F.lit(False)).alias("train"))
    out = map_arrow(given, body, "kind int, " + TOKENISED)
    out.write.partitionBy("kind").parquet(f"{folder}/words")


ARROW = {"kind": pa.int32(), "block": pa.int64(), "doc_id": pa.int64(), "train": pa.bool_(), "ids": pa.binary(), "word": pa.binary(), "local": pa.int32(), "n": pa.int64(), "kinds": pa.int64()}


def row_batch(size: int, names=("kind", "block", "doc_id", "train", "ids", "word", "local", "n"), **values) -> pa.RecordBatch:
    columns = []
    for name in names:
        value = values.get(name)
        if value is None:
            columns.append(pa.nulls(size, ARROW[name]))
        elif np.isscalar(value):
            columns.append(pa.array(np.full(size, value), ARROW[name]))
        else:
            columns.append(pa.array(value, ARROW[name]))
    return pa.RecordBatch.from_arrays(columns, list(names))


def read(spark: SparkSession, folder: str, what: str, kind: int) -> DataFrame:
    return spark.read.schema(_READ[what] + ", kind int").parquet(f"{folder}/{what}").filter(F.col("kind") == kind)


def count_words(spark: SparkSession, folder: str) -> None:
    """Totals of the words: kind 0, for each block and local number; kind 1, per class: tokens and distinct words."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, kinds = np.zeros(SYMBOLS, np.int64), np.zeros(SYMBOLS, np.int64)
        names = ("kind", "block", "local", "n", "kinds")
        rest = None

        def totals(rows: pa.RecordBatch):
            word = rows.column("word")
            n, local = rows.column("n").to_numpy(), rows.column("local").to_numpy()
            edge = np.concatenate([[True], pc.not_equal(word[1:], word[:-1]).to_numpy(zero_copy_only=False)])
            first = np.flatnonzero(edge)
            total = np.add.reduceat(n, first)
            known = total > 0
            symbol = local[first] % SYMBOLS
            np.add.at(tokens, symbol, total)
            np.add.at(kinds, symbol[known], 1)
            whole = np.repeat(total, np.diff(np.append(first, len(n))))
            return row_batch(len(n), names, kind=0, block=rows.column("block"), local=local, n=whole)

        for batch in batches:
            if rest is not None:
                batch = pa.concat_batches([rest, batch])
            word = batch.column("word")
            # The last word may go on in the next batch.
            last = np.flatnonzero(np.concatenate([[True], pc.not_equal(word[1:], word[:-1]).to_numpy(zero_copy_only=False)]))[-1]
            if last:
                yield totals(batch.slice(0, last))
            rest = batch.slice(last)
        if rest is not None and rest.num_rows:
            yield totals(rest)
        yield row_batch(SYMBOLS, names, kind=1, local=np.arange(SYMBOLS), n=tokens, kinds=kinds)

    words = read(spark, folder, "words", 1).select("word", "block", "local", "n")
    dealt = words.repartition(parts, "word").sortWithinPartitions("word")
    map_arrow(dealt, body, "kind int, " + COUNTED).write.partitionBy("kind").parquet(f"{folder}/counts")


@dataclass
class Model:
    start: np.ndarray  # 2 x states: of a text, of a segment inside one
    move: np.ndarray  # states x states
    emit: np.ndarray  # (symbols + 1) x states; the last is the end
    class_tokens: np.ndarray
    class_kinds: np.ndarray
    n_texts: int

    @property
    def tokens(self) -> int:
        return int(self.class_tokens.sum()) + self.n_texts

    @property
    def kinds(self) -> int:
        return int(self.class_kinds.sum()) + (self.n_texts > 0)


def by_time(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequences longest first, laid out by time: order, symbols, and where each time begins."""
    lengths = np.array([len(s) for s in sequences], np.int64)
    order = np.argsort(-lengths, kind="stable")
    active = len(lengths) - np.searchsorted(np.sort(lengths), np.arange(lengths.max(initial=0)), "right")
    begins = np.concatenate([[0], np.cumsum(active)])
    flat = np.empty(begins[-1], np.int32)
    for rank, k in enumerate(order.tolist()):
        flat[begins[: lengths[k]] + rank] = sequences[k]
    return order, flat, begins


def forward(model: Model, sequences: list[np.ndarray]) -> np.ndarray:
    """Natural log probability of each sequence (which has one symbol at least), by scaled recursion."""
    order, flat, begins = by_time(sequences)
    logs = np.zeros(len(sequences))
    alpha = np.broadcast_to(model.start[0], (len(sequences), len(model.move)))
    for t in range(len(begins) - 1):
        a, b = begins[t], begins[t + 1]
        alpha = (alpha[: b - a] @ model.move if t else alpha) * model.emit[flat[a:b]]
        scale = alpha.sum(1)
        alpha = alpha / scale[:, None]
        logs[: b - a] += np.log(scale)
    out = np.empty(len(sequences))
    out[order] = logs
    return out


def expected(model: Model, segments: list[np.ndarray], inner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected starts, moves and emissions of the segments; ``inner`` marks those inside a text."""
    order, flat, begins = by_time(segments)
    inner = inner[order].astype(int)
    k = len(model.move)
    alphas, scales = np.empty((len(flat), k)), np.empty(len(flat))
    alpha = model.start[inner]
    emitted = model.emit[flat]
    for t in range(len(begins) - 1):
        a, b = begins[t], begins[t + 1]
        alpha = (alpha[: b - a] @ model.move if t else alpha) * emitted[a:b]
        scales[a:b] = alpha.sum(1)
        alpha = alpha / scales[a:b, None]
        alphas[a:b] = alpha
    moves, beta = np.zeros((k, k)), np.ones((0, k))
    for t in range(len(begins) - 2, -1, -1):
        a, b = begins[t], begins[t + 1]
        here = np.ones((b - a, k))
        if len(beta):
            n = len(beta)
            ahead = emitted[b : b + n] * beta / scales[b : b + n, None]
            moves += alphas[a : a + n].T @ ahead
            here[:n] = ahead @ model.move.T
        beta = here
        alphas[a:b] *= beta
    starts = np.stack([alphas[: begins[1]][inner == i].sum(0) for i in (0, 1)])
    emits = np.stack([np.bincount(flat, alphas[:, j], SYMBOLS + 1) for j in range(k)], 1)
    return starts, moves * model.move, emits


def symbols(ids: bytes) -> np.ndarray:
    numbers = np.frombuffer(ids, "<u4")
    return np.append((numbers % SYMBOLS).astype(np.int32), np.int32(SYMBOLS))


def first_model(class_tokens: np.ndarray, class_kinds: np.ndarray, n_texts: int, states: int) -> Model:
    rng = np.random.default_rng(5)
    emit = np.append(class_tokens, n_texts)[:, None].astype(float) + 1.0
    emit = emit * rng.uniform(0.2, 1.8, (SYMBOLS + 1, states))
    move = rng.uniform(0.5, 1.5, (states, states)) + 8 * states * np.eye(states)  # states that last find topics and languages sooner
    start = rng.uniform(0.5, 1.5, (2, states))
    return Model(start / start.sum(1, keepdims=True), move / move.sum(1, keepdims=True), emit / emit.sum(0), class_tokens, class_kinds, n_texts)


def expectation(texts: DataFrame, model: Model) -> np.ndarray:
    """The summed expected counts over all texts, flattened: starts, moves, emissions."""
    sent = texts.sparkSession.sparkContext.broadcast(model)

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        total, held, inner, size = None, [], [], 0

        def add(total):
            got = np.concatenate([x.ravel() for x in expected(m, held, np.array(inner))])
            return got if total is None else total + got

        for batch in batches:
            for ids in batch.column("ids").to_pylist():
                s = symbols(ids)
                for a in range(0, len(s), SEGMENT):
                    held.append(s[a : a + SEGMENT])
                    inner.append(a > 0)
                    size += len(held[-1])
                if size > 400_000:
                    total = add(total)
                    held, inner, size = [], [], 0
        if held:
            total = add(total)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(np.round(total * FIXED).astype(np.int64))], ["at", "x"])

    summed = map_arrow(texts.select("ids"), body, "at int, x bigint").groupBy("at").agg(F.sum("x").alias("x"))
    states = len(model.move)
    out = np.zeros(2 * states + states * states + (SYMBOLS + 1) * states)
    got = summed.toArrow()  # as many rows as the model has parameters
    out[got.column("at").to_numpy()] = got.column("x").to_numpy() / FIXED
    return out


def train(spark: SparkSession, folder: str, states: int = STATES, iterations: int = ITERATIONS) -> Model:
    classes = read(spark, folder, "counts", 1).groupBy("local").agg(F.sum("n").alias("n"), F.sum("kinds").alias("kinds")).toArrow()
    tokens, kinds = np.zeros(SYMBOLS, np.int64), np.zeros(SYMBOLS, np.int64)
    tokens[classes.column("local").to_numpy()] = classes.column("n").to_numpy()
    kinds[classes.column("local").to_numpy()] = classes.column("kinds").to_numpy()
    texts = read(spark, folder, "words", 0).filter("train")
    model = first_model(tokens, kinds, texts.count(), states)
    for _ in range(iterations if model.n_texts else 0):
        x = expectation(texts, model) + SMOOTH
        start = x[: 2 * states].reshape(2, states)
        move = x[2 * states : 2 * states + states * states].reshape(states, states)
        emit = x[2 * states + states * states :].reshape(SYMBOLS + 1, states)
        model = Model(start / start.sum(1, keepdims=True), move / move.sum(1, keepdims=True), emit / emit.sum(0), tokens, kinds, model.n_texts)
    return model


SCORED = "doc_id bigint, train boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def score(spark: SparkSession, folder: str, model: Model) -> DataFrame:
    sent = spark.sparkContext.broadcast(model)

    def body(docs: pa.Table, counts: pa.Table) -> pa.Table:
        m = sent.value
        local = counts.column("local").to_numpy()
        total = np.zeros(int(local.max(initial=0)) + 1, np.int64)
        total[local] = counts.column("n").to_numpy()
        unigram, inside = np.log10(total + 1.0), np.log10(m.class_tokens + m.class_kinds + 1.0)
        floor = np.log10(float(m.tokens + m.kinds + 1))
        sequences, known, base, within = [], [], [], []
        for ids in docs.column("ids").to_pylist():
            numbers = np.frombuffer(ids, "<u4")
            sequences.append(symbols(ids))
            own = unigram[numbers].sum()
            known.append(int((total[numbers] > 0).sum()) + (m.n_texts > 0))
            base.append(own + np.log10(m.n_texts + 1.0) - (len(numbers) + 1) * floor)
            within.append(own - inside[numbers % SYMBOLS].sum())
        lengths = np.array([len(s) for s in sequences], np.int64)
        logs = forward(m, sequences) / np.log(10)
        return pa.table(
            {
                "doc_id": docs.column("doc_id"),
                "train": docs.column("train"),
                "n_tokens": pa.array(lengths),
                "n_known": pa.array(known, pa.int64()),
                "train_tokens": pa.array(np.full(len(lengths), m.tokens, np.int64)),
                "base_score": pa.array(base, pa.float64()),
                "score": pa.array(logs + np.array(within), pa.float64()),
            }
        )

    docs = read(spark, folder, "words", 0).select("block", "doc_id", "train", "ids")
    counts = read(spark, folder, "counts", 0).select("block", "local", "n")
    return docs.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(lambda a, b: body(a, b), SCORED)


def score_documents(docs: DataFrame, train_on: Column, states: int = STATES, iterations: int = ITERATIONS) -> DataFrame:
    """doc_id, train, n_tokens, n_known, train_tokens, base_score and score of every row."""
    spark = docs.sparkSession
    folder = scratch(spark, "hmm")
    tokenise(docs, train_on, folder)
    count_words(spark, folder)
    return score(spark, folder, train(spark, folder, states, iterations))
