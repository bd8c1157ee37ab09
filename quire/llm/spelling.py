"""Spelling variants: words one edit apart, and for each rare word the frequent word it stands for.

A word is a point: its vector of letter counts. A replaced letter moves the point by one up in one coordinate
and one down in another, an inserted letter by one up in one; so near words lie at an L1 distance of at most
two. For each word length k-d trees divide the points, and the words of a length are sought among those of
the same length and of the next. A search walks a tree with at most one step up and one down to spend and
prunes every box that it cannot reach with these. Points within reach are then compared letter by letter,
as the vector knows nothing of the order.

Two levels of trees do this. A coarse tree for each length with many words, shaped by a bounded sample of words,
deals the words out into cells; a word travels to its own cell as a point and to the cells within reach as a
query. Every pair meets in one cell only: equal lengths in the later of their two cells, other lengths in the
cell of the longer word. A cell that holds too many points for one task (anagrams share a vector) is dealt out further
by hash, and its queries go to each part. In a cell a fine tree holds its distinct vectors. Two vectors
with so many words that all pairs would be too many are matched by spelling out the edits of one side
and looking them up in the other. The outcome depends on neither the sample nor the sizes of the cells.

A word's form is its near word of largest n (ties: smallest in code-point order) if that has ``ratio`` times the
word's n or more. Roots follow forms to the end; n grows by ``ratio`` at each step, so the way is short.

Null and empty texts have no words. Rows that share a doc_id count each for themselves, a null doc_id is empty where it is spelled out.
Texts are taken whole, whatever their length. Other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.keyed import lookup
from .common import LOWER, cut, keyed_texts, map_arrow, text_batches

CELL = 32_000  # points that a cell is meant to hold
SAMPLE = 40_000  # words that shape the coarse trees
LEAF = 128  # distinct vectors in a leaf of a fine tree
PAIRS = 1 << 22  # letters compared at once
LETTERS = [*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)]
DIM_OF = np.full(256, -1, np.int64)
DIM_OF[LETTERS] = np.arange(len(LETTERS))
TO_LOWER = LOWER.tobytes()


# Words.

def spoiled(run: str, doc_id: int | None, every: int) -> str:
    """The run without one letter, if ``every`` divides the crc32 of id and run."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def count_words(docs: DataFrame, least: int = 7, spoil: int | None = 31) -> DataFrame:
    """word and n: maximal runs of Latin letters, A-Z lowered, of at least ``least`` letters.

    With ``spoil`` a run loses a letter where the crc32 of its document and itself says so: typing errors to be found.
    """
    runs = re.compile(r"[A-Za-zÀ-ÿ]{%d,}" % least)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
            total.clear()
            return out

        for columns in text_batches(batches):
            for doc_id, text in zip(columns["doc_id"], columns["text"], strict=True):
                found = Counter(runs.findall(text.encode().translate(TO_LOWER).decode()))
                if spoil is None:
                    total.update(found)
                    continue
                for run, n in found.items():
                    word = spoiled(run, doc_id, spoil)
                    if len(word) >= least:
                        total[word] += n
            if len(total) > 200_000:
                yield flush()
        yield flush()

    counted = map_arrow(keyed_texts(docs), count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


# Trees.

def codes_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The letters of all words one after another, and the words' lengths. Words are within Latin-1."""
    data = [w.encode("latin-1") for w in words]
    return np.frombuffer(b"".join(data), np.uint8), np.fromiter(map(len, data), np.int64, len(data))


def vectors(words: list[str]) -> np.ndarray:
    """Letter counts, one row a word."""
    codes, sizes = codes_of(words)
    at = np.repeat(np.arange(len(words)), sizes) * len(LETTERS) + DIM_OF[codes]
    return np.bincount(at, minlength=len(words) * len(LETTERS)).reshape(len(words), len(LETTERS)).astype(np.int32)


@dataclass
class Node:
    """A box of a k-d tree: points with at most ``split`` of letter ``dim`` lie left. A leaf has a number and maybe its points."""

    dim: int = -1
    split: int = 0
    left: Node | None = None
    right: Node | None = None
    leaf: int = 0
    points: np.ndarray | None = None


def build(points: np.ndarray, room: float) -> tuple[Node, int]:
    """A k-d tree with leaves of at most ``room`` points where points differ, split at the median of the widest spread letter."""
    root, leaves = Node(points=np.arange(len(points))), 0
    todo = [root]
    while todo:
        node = todo.pop()
        own = points[node.points]
        spread = own.var(axis=0) if len(own) > room else np.zeros(1)
        if not spread.any():
            node.leaf, leaves = leaves, leaves + 1
            continue
        node.dim = int(spread.argmax())
        x = own[:, node.dim]
        node.split = min(int(np.median(x)), int(x.max()) - 1)
        node.left, node.right = Node(points=node.points[x <= node.split]), Node(points=node.points[x > node.split])
        node.points = None
        todo += (node.right, node.left)
    return root, leaves


FREE, NONE = -1, -2


def reach(root: Node, points: np.ndarray, up: int, down: int) -> Iterator[tuple[Node, np.ndarray]]:
    """The leaves that points get to with one step up and one down (each FREE to spend or NONE), and which points do.

    A spent step is remembered by its letter, so the point's place in the box is exact however often a letter is split.
    """
    n = len(points)
    todo = [(root, np.arange(n), np.full(n, up), np.full(n, down))]
    while todo:
        node, who, u, d = todo.pop()
        if node.left is None:
            yield node, who
            continue
        x = points[who, node.dim] + (u == node.dim) - (d == node.dim)
        over = (x == node.split + 1) & (d == FREE) & (u != node.dim)
        under = (x == node.split) & (u == FREE) & (d != node.dim)
        for child, here, crossed, side in ((node.left, x <= node.split, over, 1), (node.right, x > node.split, under, 0)):
            go = here | crossed
            if go.any():
                steps = [u[go], d[go]]
                steps[side] = np.where(crossed[go], node.dim, steps[side])
                todo.append((child, who[go], *steps))


# Pairs within a cell.

class Group:
    """Words of one length with their counts, as letters and by distinct vector."""

    def __init__(self, words: list[str], n: list[int]):
        self.words, self.n = words, np.asarray(n, np.int64)
        codes, sizes = codes_of(words)
        self.size = int(sizes[0])
        self.letters = codes.reshape(len(words), self.size)
        every = vectors(words)
        keys, of = np.unique(every.view(f"V{every.shape[1] * 4}").ravel(), return_inverse=True) if len(words) > 1 else (None, np.zeros(1, np.int64))
        order = np.argsort(of, kind="stable")
        self.order, self.starts = order, np.searchsorted(of[order], np.arange((len(keys) if keys is not None else 1) + 1))
        self.vectors = every[order[self.starts[:-1]]]
        exact = np.float32 if self.size < 2000 else np.float64
        self.real = self.vectors.astype(exact)
        self.square = (self.real * self.real).sum(axis=1)

    def of(self, k: int) -> np.ndarray:
        return self.order[self.starts[k] : self.starts[k + 1]]


def near_vectors(tree: Node, points: Group, queries: Group, itself: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of distinct vectors (of a query, of a point) that one edit may lie between; within one group each pair once."""
    longer = points.size > queries.size
    for node, who in reach(tree, queries.vectors, FREE, NONE if longer else FREE):
        inside = node.points
        for begin in range(0, len(who), 8192):
            part = who[begin : begin + 8192]
            apart = queries.square[part][:, None] + points.square[inside][None, :] - 2 * (queries.real[part] @ points.real[inside].T)
            # Counts are whole numbers: a square of one is a step in one letter, and of two, at equal lengths, a step up and a step down.
            q, p = np.nonzero(apart == (1 if longer else 2))
            q, p = part[q], inside[p]
            if itself:
                q, p = q[q < p], p[q < p]
            if len(q):
                yield q, p


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of letters differ by one edit; b has as many letters as a or one more."""
    size = a.shape[1]
    if b.shape[1] == size:
        return (a != b).sum(axis=1) == 1
    front, back = a != b[:, :size], (a != b[:, 1:])[:, ::-1]
    before = np.where(front.any(axis=1), front.argmax(axis=1), size)
    after = np.where(back.any(axis=1), back.argmax(axis=1), size)
    return before + after >= size


def expand(queries: Group, points: Group, q: np.ndarray, p: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All words of the paired vectors against each other, compared in slices of bounded size."""
    n_points = np.diff(points.starts)[p]
    total = np.diff(queries.starts)[q] * n_points
    most = max(1, PAIRS // (points.size + 1))
    ends, begin = np.cumsum(total), 0
    while begin < len(q):
        gone = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, gone + most, "right")))
        t = total[begin:end]
        pair = np.repeat(np.arange(begin, end), t)
        k = np.arange(t.sum()) - np.repeat(np.cumsum(t) - t, t)
        a = queries.order[queries.starts[q[pair]] + k // n_points[pair]]
        b = points.order[points.starts[p[pair]] + k % n_points[pair]]
        near = one_edit(queries.letters[a], points.letters[b])
        yield a[near], b[near]
        begin = end


def look_up(queries: Group, points: Group, q: int, p: int) -> tuple[np.ndarray, np.ndarray]:
    """The near words of two vectors by spelling out the edits that lead from the longer, or the points' side, to the other."""
    step = points.vectors[p] - queries.vectors[q]
    extra = chr(LETTERS[int(step.argmax())])
    put = "" if points.size > queries.size else chr(LETTERS[int(step.argmin())])
    known = {queries.words[a]: a for a in queries.of(q).tolist()}
    found = set()
    for b in points.of(p).tolist():
        word = points.words[b]
        at = word.find(extra)
        while at >= 0:
            a = known.get(word[:at] + put + word[at + 1 :])
            if a is not None:
                found.add((a, b))
            at = word.find(extra, at + 1)
    pairs = np.array(sorted(found), np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def near_pairs(tree: Node, points: Group, queries: Group, itself: bool = False, crowd: int = 64) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of words (of a query, of a point) that are one edit apart."""
    n_queries, n_points = np.diff(queries.starts), np.diff(points.starts)
    for q, p in near_vectors(tree, points, queries, itself):
        crowded = n_queries[q] * n_points[p] > crowd * (n_queries[q] + n_points[p])
        yield from expand(queries, points, q[~crowded], p[~crowded])
        for i in np.flatnonzero(crowded).tolist():
            yield look_up(queries, points, int(q[i]), int(p[i]))


def contributions(mine: Group, other: Group, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[str, int, int, str]]:
    """For each word of ``mine`` in the pairs: how many of ``other`` it meets, and the best of them with its n."""
    if len(a) == 0:
        return
    rank = np.empty(len(other.words), np.int64)
    used = np.unique(b)
    rank[used[np.argsort(np.array([other.words[i] for i in used.tolist()], object), kind="stable")]] = np.arange(len(used))
    order = np.lexsort((rank[b], -other.n[b], a))
    a, b = a[order], b[order]
    first = np.flatnonzero(np.diff(a, prepend=-1))
    counts = np.diff(first, append=len(a))
    for i, n, j in zip(a[first].tolist(), counts.tolist(), b[first].tolist(), strict=True):
        yield mine.words[i], n, int(other.n[j]), other.words[j]


FOUND = "word string, n_near long, best_n long, best string"
POINT, QUERY = 0, 1


def found_rows(rows: list[tuple[str, int, int, str]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 4
    types = (pa.string(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [c.split()[0] for c in FOUND.split(", ")])


def both(points: Group, queries: Group, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """What pairs add to both of their words, in rows of bounded number."""
    held, n = [], 0
    for a, b in pairs:
        held.append((a, b))
        n += len(a)
        if n > 1_000_000:
            yield from flushed(points, queries, held)
            held, n = [], 0
    yield from flushed(points, queries, held)


def flushed(points: Group, queries: Group, held: list) -> Iterator[pa.RecordBatch]:
    if held:
        a, b = (np.concatenate([h[i] for h in held]) for i in (0, 1))
        yield found_rows([*contributions(queries, points, a, b), *contributions(points, queries, b, a)])


def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cell after cell: its points first, then its queries by length, a bounded number at a time."""
    cell, kind, kind_length, words, counts = None, None, None, [], []
    points, tree = None, None

    def work() -> Iterator[pa.RecordBatch]:
        nonlocal points, tree
        if not words:
            return
        if kind == POINT:
            points = Group(words, counts)
            tree, _ = build(points.vectors, LEAF)
            yield from both(points, points, near_pairs(tree, points, points, itself=True))
            # Words with one vector never are one edit apart, so pairs of distinct vectors are all.
        elif points is not None:
            queries = Group(words, counts)
            yield from both(points, queries, near_pairs(tree, points, queries))

    for batch in batches:
        lists = [batch.column(c).to_pylist() for c in ("size", "leaf", "part", "kind", "length", "word", "n")]
        for size, leaf, part, k, length, word, n in zip(*lists, strict=True):
            if (size, leaf, part) != cell or (k, length) != kind_length or (k == QUERY and len(words) >= CELL):
                yield from work()
                words, counts = [], []
                if (size, leaf, part) != cell:
                    points, tree = None, None
            cell, kind, kind_length = (size, leaf, part), k, (k, length)
            words.append(word)
            counts.append(n)
    yield from work()


# Cells.

def by_length(words: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, places and vectors of the words of each length."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    for size in np.unique(sizes).tolist():
        who = np.flatnonzero(sizes == size)
        yield size, who, vectors([words[i] for i in who.tolist()])


def coarse_trees(words: DataFrame, cell: int, sample: int) -> dict[int, Node]:
    """A tree for each length with more than ``cell`` words, from the ``sample`` words of these lengths with the least hashes."""
    sized = words.select("word", F.length("word").alias("size"))
    many = {r["size"]: r["count"] for r in sized.groupBy("size").count().filter(F.col("count") > cell).collect()}
    if not many:
        return {}
    drawn = sized.filter(F.col("size").isin(list(many))).orderBy(F.xxhash64("word"), "word").limit(sample).select("word").toArrow()
    trees = {}
    for size, _, points in by_length(drawn.column("word").to_pylist()):
        trees[size], _ = build(points, max(1.0, cell * len(points) / many[size]))
        todo = [trees[size]]
        while todo:
            node = todo.pop()
            node.points = None
            todo += [child for child in (node.left, node.right) if child]
    return trees


def place(words: DataFrame, trees: dict[int, Node]) -> DataFrame:
    """Each word with its length and the leaf of its length's tree."""

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf, sizes = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, np.int32)
            for size, who, points in by_length(batch.column("word").to_pylist()):
                sizes[who] = size
                for node, part in reach(trees[size], points, NONE, NONE) if size in trees else ():
                    leaf[who[part]] = node.leaf
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes), pa.array(leaf)], ["word", "n", "size", "leaf"])

    return map_arrow(words.select("word", "n"), body, "word string, n long, size int, leaf int")


def deal(placed: DataFrame, trees: dict[int, Node], split: dict[tuple[int, int], int]) -> DataFrame:
    """Each word as a point of its cell and as a query of the others it can reach. ``split`` names cells in several parts, and how many."""

    def routes(words: list[str], own: np.ndarray) -> Iterator[tuple[int, int, int, int, int, np.ndarray]]:
        part_of = np.zeros(len(words), np.int64)
        for i, (word, leaf) in enumerate(zip(words, own.tolist(), strict=True)):
            parts = split.get((len(word), leaf), 1)
            if parts > 1:
                part_of[i] = zlib.crc32(word.encode()) % parts
        for size, who, points in by_length(words):
            leaves = own[who]
            for leaf in np.unique(leaves).tolist():
                here = who[leaves == leaf]
                for part in range(split.get((size, leaf), 1)):
                    yield size, leaf, part, POINT, size, here[part_of[here] == part]
                    yield size, leaf, part, QUERY, size, here[part_of[here] < part]
            for node, some in reach(trees[size], points, FREE, FREE) if size in trees else ():
                later = who[some][leaves[some] < node.leaf]
                for part in range(split.get((size, node.leaf), 1)):
                    yield size, node.leaf, part, QUERY, size, later
            longer = size + 1
            for node, some in reach(trees[longer], points, FREE, NONE) if longer in trees else [(Node(), np.arange(len(who)))]:
                for part in range(split.get((longer, node.leaf), 1)):
                    yield longer, node.leaf, part, QUERY, size, who[some]

    names = ["size", "leaf", "part", "kind", "length", "word", "n"]

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word, n = batch.column("word"), batch.column("n")
            sent = [r for r in routes(word.to_pylist(), batch.column("leaf").to_numpy()) if len(r[-1])]
            for begin in range(0, len(sent), 64):
                group = sent[begin : begin + 64]
                lens = [len(r[-1]) for r in group]
                rows = pa.array(np.concatenate([r[-1] for r in group]))
                columns = [pa.array(np.repeat(np.array([r[i] for r in group], np.int32), lens)) for i in range(5)]
                yield pa.RecordBatch.from_arrays([*columns, word.take(rows), n.take(rows)], names)

    return map_arrow(placed.select("word", "n", "leaf"), body, "size int, leaf int, part int, kind int, length int, word string, n long")


def near_words(words: DataFrame, cell: int = CELL, sample: int = SAMPLE) -> DataFrame:
    """For each word (distinct, with its n) that has near words: n_near, and the best of them with its n."""
    trees = coarse_trees(words, cell, sample)
    placed = cut(place(words, trees))
    cells = placed.groupBy("size", "leaf").count()
    full = cells.filter(F.col("count") > 2 * cell).collect()  # a few of the cells, whose number the words over ``cell`` bound
    split = {(r["size"], r["leaf"]): -(-r["count"] // cell) for r in full}
    parts = max(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * (placed.count() // cell))
    at = ["size", "leaf", "part"]
    dealt = deal(placed, trees, split).repartition(parts, *at).sortWithinPartitions(*at, "kind", "length")
    found = map_arrow(dealt, compare, FOUND)
    best = F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("word"))).alias("b")
    summed = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    return summed.select("word", "n_near", (-F.col("b.m")).alias("best_n"), F.col("b.word").alias("best"))


def roots(links: DataFrame) -> DataFrame:
    """word and root of each (word, form): forms followed to the end, twice as far in each round."""
    ways = cut(links.select("word", F.col("form").alias("root")))
    while True:
        onward = ways.select(F.col("word").alias("root"), F.col("root").alias("further"))
        ways = cut(lookup(ways.select("word", "root"), onward, ["root"], ["word"]).select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if ways.filter("moved").isEmpty():
            return ways.drop("moved")


def variants(words: DataFrame, ratio: int = 10, cell: int = CELL, sample: int = SAMPLE) -> DataFrame:
    """word, form, root, n, n_near, form_n for distinct words with their n."""
    words = cut(words.select("word", "n"))
    joined = words.join(near_words(words, cell, sample), "word", "left")
    is_form = F.col("best_n") >= ratio * F.col("n")
    judged = cut(joined.select(
        "word", F.when(is_form, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, F.col("best_n")).alias("form_n"),
    ))
    ends = roots(judged.filter("form IS NOT NULL"))
    return judged.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: The words and their variants in SQL: near words share a text with one letter taken out or masked.
ORACLE = """
WITH RECURSIVE runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS r FROM documents) WHERE length(r) >= 7),
pairs AS (SELECT id, run, count(*) AS n FROM runs GROUP BY ALL),
steps AS (SELECT i AS b, list_reduce(list_prepend(i, [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
            lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END) AS t FROM range(256) r(i)),
steps_list AS (SELECT list(t ORDER BY b) AS ts FROM steps),
hashed AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_concat([ascii(x)::BIGINT FOR x IN string_split(id, '') IF x <> ''], [58::BIGINT],
           flatten([CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [(192 + (unicode(x) >> 6))::BIGINT, (128 + (unicode(x) & 63))::BIGINT] END
                    FOR x IN string_split(run, '')]))),
           lambda c, b: xor(c >> 8, ts[(xor(c, b) & 255) + 1])), 4294967295) AS h
  FROM pairs, steps_list),
spelled AS (
  SELECT CASE WHEN h % 31 = 0 THEN run[1 : (h % length(run))::INT] || run[(h % length(run))::INT + 2 :] ELSE run END AS word, n FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM spelled WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
holes AS (SELECT word, n, i, word[1 : i - 1] AS a, word[i + 1 :] AS z FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT x.word, y.word AS other, y.n AS m FROM holes x JOIN holes y ON x.i = y.i AND x.a = y.a AND x.z = y.z AND x.word <> y.word
  UNION SELECT x.word, y.word, y.n FROM holes x JOIN words y ON y.word = x.a || x.z
  UNION SELECT y.word, x.word, x.n FROM holes x JOIN words y ON y.word = x.a || x.z),
best AS (SELECT word, count(*) AS n_near, min((-m, other)) AS b FROM near GROUP BY word),
forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b[1] >= 10 * w.n THEN b[2] END AS form, CASE WHEN -b[1] >= 10 * w.n THEN -b[1] END AS form_n
  FROM words w LEFT JOIN best USING (word)),
way AS (
  SELECT word, word AS root, form AS onward FROM forms
  UNION ALL SELECT way.word, f.word, f.form FROM way JOIN forms f ON f.word = way.onward)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM forms f JOIN way r ON r.word = f.word AND r.onward IS NULL
"""
