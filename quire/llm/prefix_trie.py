"""Prefix trie of conversations: which openings are shared, by how many, and what storing them once saves.

A turn is its role and text; it travels as its 128-bit digest and its length. A conversation's path is the
row of its turns' digests. Paths are dealt out by range, so a shard holds a stretch of the sorted paths, and
each shard numbers its distinct turns in that order and grows a ternary search tree over the numbers. The
shard's distinct paths enter by medians, the middle one first, so the search tree among the children of a
node is balanced. An iterative traversal lists the nodes parents first; read backwards it adds up members,
childless nodes and savings.

Only a node whose path begins the first or the last key of a shard can lie in several shards. Such boundary
nodes are merged afterwards: their parts are added, and what they contribute themselves to the nodes above
is added up once more along the boundary nodes of one shard each, their home. Equal paths are ordered by
conversation, so a group of copies of any size is spread over shards and meets as one part a shard.

Conversations are ordered by turn, null first; turns with one number by their digest. A null role or text
is empty, a row without a conversation id belongs to none and is left out, repeated rows are repeated turns. A
conversation of any length is one path, 20 bytes a turn in one task; texts never leave the scan. Other
columns are ignored. An empty table has no node, not even the root.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, map_arrow

WIDTH = 16  # bytes of a digest
KEY_TURNS = 32  # turns that a range key looks at; longer paths that agree in them are ordered by conversation
SHARD_TURNS = 500_000  # turns of a shard
PART = (
    "shard int, node binary, up binary, depth long, turn binary, size long, shared boolean, conv_id long, parent_conv_id long, "
    "n_convs long, n_children long, n_leaves long, saved_tokens long, ends array<bigint>"
)


def digest(role: Column, text: Column) -> Column:
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))


def sequences(conversations: DataFrame) -> DataFrame:
    """conv_id and its turns in order, an array of (digest, size)."""
    turns = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(
            F.col("turn").isNotNull().alias("numbered"), F.coalesce("turn", F.lit(0)).alias("turn"),
            digest(F.col("role"), F.col("text")).alias("digest"), F.coalesce(F.length("text"), F.lit(0)).alias("size"),
        ).alias("t"),
    )
    listed = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    return listed.select("conv_id", F.transform("turns", lambda t: F.struct(t["digest"].alias("digest"), t["size"].alias("size"))).alias("turns"))


def graft(rows: DataFrame, every: int = 100, most: int = 6) -> DataFrame:
    """Each conversation c with the first h turns of c - c % every in place of its own first h, h = crc32 of c modulo ``most``.

    What a conversation that branched off another one after h turns looks like. At most ``every`` conversations
    ask for one trunk, and only its first turns travel.
    """
    rows = cut(rows)
    trunk = F.col("conv_id") - F.col("conv_id") % every
    trunks = rows.filter(F.col("conv_id") == trunk).select(F.col("conv_id").alias("trunk"), F.slice("turns", 1, most - 1).alias("opening"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    joined = rows.withColumn("trunk", trunk).join(trunks, "trunk", "left").withColumn("h", h)
    opening = F.coalesce(F.slice("opening", F.lit(1), F.col("h")), F.expr("slice(turns, 1, 0)"))
    return joined.select("conv_id", F.concat(opening, F.slice("turns", F.col("h") + 1, F.size("turns"))).alias("turns"))


class TernaryTree:
    """A ternary search tree over integers. Node 0 is the root, and as a link it means none."""

    def __init__(self) -> None:
        self.turn, self.lo, self.eq, self.hi = [-1], [0], [0], [0]
        self.end: dict[int, int] = {}

    def new(self, turn: int) -> int:
        for links in (self.lo, self.eq, self.hi):
            links.append(0)
        self.turn.append(turn)
        return len(self.turn) - 1

    def insert(self, path: tuple[int, ...], mark: int) -> None:
        turn, lo, eq, hi = self.turn, self.lo, self.eq, self.hi
        parent = 0
        for t in path:
            links, at = eq, parent
            while links[at]:
                at = links[at]
                if turn[at] == t:
                    break
                links = lo if t < turn[at] else hi
            else:
                links[at] = at = self.new(t)
            parent = at
        self.end[parent] = mark

    def insert_by_medians(self, paths: list[tuple[int, ...]]) -> None:
        """``paths`` are distinct and sorted; marks are their places in the list."""
        spans = [(0, len(paths))]
        while spans:
            begin, end = spans.pop()
            if begin < end:
                middle = (begin + end) // 2
                self.insert(paths[middle], middle)
                spans += ((begin, middle), (middle + 1, end))

    def traverse(self) -> tuple[list[int], list[int], list[int]]:
        """The nodes, parents before children, and of each node its parent in the trie and its depth."""
        order, up, depth = [0], [-1] * len(self.turn), [0] * len(self.turn)
        stack = [(self.eq[0], 0)]
        while stack:
            at, parent = stack.pop()
            if at:
                up[at], depth[at] = parent, depth[parent] + 1
                order.append(at)
                stack += ((self.lo[at], parent), (self.hi[at], parent), (self.eq[at], at))
        return order, up, depth


def shared_nodes(tree: TernaryTree, order: list[int], up: list[int], depth: list[int], keys: list[tuple[int, ...]]) -> list[bool]:
    """Which nodes begin one of the keys, or follow a key that was cut at its full length."""
    shared = [False] * len(tree.turn)
    for key in keys:
        on = [False] * len(tree.turn)
        on[0] = shared[0] = True
        for at in order[1:]:
            if on[up[at]]:
                d = depth[at]
                on[at] = d > KEY_TURNS or (d <= len(key) and key[d - 1] == tree.turn[at])
                shared[at] |= on[at]
    return shared


def shard_nodes(shard: int, ids: list[int], paths: list[bytes], sizes: np.ndarray) -> Iterator[dict[str, list]]:
    """The nodes of one shard's paths, given in range order; numbers of boundary nodes are parts."""
    flat = np.frombuffer(b"".join(paths), dtype=f"S{WIDTH}")
    known, where, codes = np.unique(flat, return_index=True, return_inverse=True)
    size_of = sizes[where].tolist()
    digests = [d.ljust(WIDTH, b"\0") for d in known.tolist()]
    codes, members, begin = codes.ravel().tolist(), {}, 0
    ends_keys = []
    for i, (conv, path) in enumerate(zip(ids, paths, strict=True)):
        end = begin + len(path) // WIDTH
        coded = tuple(codes[begin:end])
        members.setdefault(coded, []).append(conv)
        if i in (0, len(ids) - 1):
            ends_keys.append(coded[:KEY_TURNS])
        begin = end
    distinct = sorted(members)
    tree = TernaryTree()
    tree.insert_by_medians(distinct)
    order, up, depth = tree.traverse()
    shared = shared_nodes(tree, order, up, depth, ends_keys)
    n = len(tree.turn)
    convs, first, kids, leaves, saved = [0] * n, [None] * n, [0] * n, [0] * n, [0] * n
    for at in reversed(order):
        if at in tree.end:
            own = members[distinct[tree.end[at]]]
            convs[at] += len(own)
            first[at] = own[0] if first[at] is None else min(own[0], first[at])
        if not shared[at]:
            leaves[at] = leaves[at] or 1
            saved[at] += (convs[at] - 1) * size_of[tree.turn[at]]
        if at:
            parent = up[at]
            convs[parent] += convs[at]
            first[parent] = first[at] if first[parent] is None else min(first[at], first[parent])
            kids[parent] += not shared[at]
            leaves[parent] += leaves[at]
            saved[parent] += saved[at]
    name: dict[int, bytes] = {0: hashlib.md5(b"").digest()}
    columns = PART_NAMES
    out: dict[str, list] = {c: [] for c in columns}
    for at in order:
        turn, parent = tree.turn[at], up[at]
        if at:
            name[at] = hashlib.md5(name[parent] + digests[turn]).digest()
        own = members[distinct[tree.end[at]]] if at in tree.end else []
        row = (
            shard, name[at], name[parent] if at else None, depth[at], digests[turn] if at else None, size_of[turn] if at else 0, shared[at], first[at],
            None if not at or shared[parent] else first[parent], convs[at], kids[at], leaves[at], saved[at], own,
        )
        for c, value in zip(columns, row, strict=True):
            out[c].append(value)
        if len(out["shard"]) >= 20_000:
            yield out
            out = {c: [] for c in columns}
    yield out


PART_NAMES = [c.split()[0] for c in PART.split(", ")]
PART_TYPES = pa.schema([
    ("shard", pa.int32()), ("node", pa.binary()), ("up", pa.binary()), ("depth", pa.int64()), ("turn", pa.binary()), ("size", pa.int64()), ("shared", pa.bool_()),
    ("conv_id", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()),
    ("ends", pa.list_(pa.int64())),
])


def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids, paths, sizes = [], [], []
    for batch in batches:
        ids += batch.column("conv_id").to_pylist()
        paths += batch.column("path").to_pylist()
        sizes.append(batch.column("sizes").flatten().to_numpy(zero_copy_only=False))
    if ids:
        for part in shard_nodes(TaskContext.get().partitionId(), ids, paths, np.concatenate(sizes)):
            yield pa.RecordBatch.from_pydict(part, schema=PART_TYPES)


def along_spine(rows: pd.DataFrame) -> pd.DataFrame:
    """What the boundary nodes at home in one shard add to the boundary nodes above them in it."""
    rows = rows.sort_values("depth", ascending=False, kind="stable")
    leaves, saved = dict(zip(rows.node, rows.leaf, strict=True)), dict(zip(rows.node, rows.own_saved, strict=True))
    for node, up in zip(rows.node, rows.up, strict=True):
        if up is not None:
            leaves[up] += leaves[node]
            saved[up] += saved[node]
    return pd.DataFrame({"node": list(leaves), "more_leaves": list(leaves.values()), "more_saved": list(saved.values())})


@dataclass
class Trie:
    """``nodes``: one row a node, ``ends`` the conversations that end there, ascending, or null where they lie in pieces.

    ``pieces``: node, piece and ends of the boundary nodes; the pieces of a node, in order, are its list.
    ``turn`` is the digest of a node's last turn.
    """

    nodes: DataFrame
    pieces: DataFrame


def prefix_trie(rows: DataFrame, shard_turns: int = SHARD_TURNS) -> Trie:
    """The trie over rows of (conv_id, turns) as ``sequences`` gives them; conv_id is unique and not null."""
    spark = rows.sparkSession
    path = F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["digest"])), ""))
    flat = cut(rows.select("conv_id", path.alias("path"), F.transform("turns", lambda t: t["size"].cast("long")).alias("sizes")))
    total = flat.agg(F.sum(F.size("sizes"))).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / shard_turns))
    key = F.substring("path", 1, KEY_TURNS * WIDTH)
    dealt = flat.withColumn("key", key).repartitionByRange(shards, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    parts = cut(map_arrow(dealt.select("conv_id", "path", "sizes"), grow, PART))
    inner, edge = parts.filter(~F.col("shared")), parts.filter("shared")

    merged = edge.groupBy("node").agg(
        F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("up").alias("up"), F.first("turn").alias("turn"), F.first("size").alias("size"),
        F.min("shard").alias("home"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
    )
    below = merged.filter("up IS NOT NULL").groupBy(F.col("up").alias("node")).agg(F.count(F.lit(1)).alias("joined"))
    merged = merged.join(below, "node", "left").withColumn("n_children", F.col("n_children") + F.coalesce("joined", F.lit(0)))
    own = {"leaf": (F.col("n_children") == 0).cast("long"), "own_saved": (F.col("n_convs") - 1) * F.col("size")}
    merged = cut(merged.withColumns(own).drop("joined"))
    homes = merged.select(F.col("home").alias("shard"), "node", "leaf", "own_saved")
    spine = edge.select("shard", "node", "up", "depth").join(homes, ["shard", "node"], "left").fillna(0, ["leaf", "own_saved"])
    more = spine.groupBy("shard").applyInPandas(along_spine, "node binary, more_leaves long, more_saved long")
    more = more.groupBy("node").agg(F.sum("more_leaves").alias("more_leaves"), F.sum("more_saved").alias("more_saved"))
    parents = merged.select(F.col("node").alias("up"), F.col("conv_id").alias("parent_conv_id"))
    finished = merged.join(more, "node").join(parents, "up", "left").withColumns({
        "n_leaves": F.col("n_leaves") + F.col("more_leaves"), "saved_tokens": F.col("saved_tokens") + F.col("more_saved"),
        "ends": F.lit(None).cast("array<bigint>"),
    })
    # A child of a boundary node asks in its own shard, so that the many children of the root do not meet in one task.
    known = edge.select("shard", F.col("node").alias("up")).join(parents, "up")
    hanging = inner.filter("parent_conv_id IS NULL").drop("parent_conv_id").join(known, ["shard", "up"])
    columns = ["node", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "turn", "ends"]
    nodes = inner.filter("parent_conv_id IS NOT NULL").select(*columns).unionByName(hanging.select(*columns)).unionByName(finished.select(*columns))
    return Trie(nodes, edge.filter(F.size("ends") > 0).select("node", F.col("shard").alias("piece"), "ends"))


def hash_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the comma-joined lists of each node, a piece at a time; a node's pieces stand together, in order."""
    held, state = None, None
    for batch in batches:
        done = []
        for node, ends in zip(batch.column("node").to_pylist(), batch.column("ends").to_pylist(), strict=True):
            if node != held:
                if held is not None:
                    done.append((held, state.hexdigest()))
                held, state = node, hashlib.sha256()
            else:
                state.update(b",")
            state.update(",".join(map(str, ends)).encode())
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())], ["node", "ends_sha256"])
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array([held], pa.binary()), pa.array([state.hexdigest()], pa.string())], ["node", "ends_sha256"])


def with_ends_hash(trie: Trie) -> DataFrame:
    """The nodes with ends_sha256 in place of their ends. Long lists pass as pieces through a running hash."""
    dealt = trie.pieces.repartition("node").sortWithinPartitions("node", "piece")
    hashed = map_arrow(dealt.select("node", "ends"), hash_pieces, "node binary, ends_sha256 string")
    whole = F.sha2(F.array_join(F.transform("ends", lambda i: i.cast("string")), ","), 256)
    inner = trie.nodes.filter("ends IS NOT NULL").withColumn("ends_sha256", whole)
    edge = trie.nodes.filter("ends IS NULL").join(hashed, "node", "left").fillna(hashlib.sha256(b"").hexdigest(), ["ends_sha256"])
    return inner.drop("ends").unionByName(edge.drop("ends"))


#: The same in SQL, from the rows of ``conversations``; ties of a turn by digest.
ORACLE = """
WITH RECURSIVE turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
           md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos,
         md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest, length(coalesce(text, '')) AS size
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT conv_id, xor(list_reduce(list_prepend(4294967295::BIGINT, [ascii(x)::BIGINT FOR x IN string_split(conv_id::VARCHAR, '')]),
           lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
             lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM turns)),
rebuilt AS (
  SELECT c.conv_id, t.pos, t.digest, t.size FROM convs c JOIN turns t ON t.conv_id = c.conv_id - c.conv_id % 100 AND t.pos <= c.h
  UNION ALL
  SELECT c.conv_id, t.pos, t.digest, t.size FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.pos > c.h),
ranked AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS depth, digest, size FROM rebuilt),
paths AS (
  SELECT conv_id, 0::BIGINT AS depth, '' AS path, 0::BIGINT AS size FROM convs
  UNION ALL
  SELECT conv_id, depth, md5(string_agg(digest, '') OVER (PARTITION BY conv_id ORDER BY depth)), size FROM ranked),
nodes AS (SELECT path, depth, any_value(size) AS size, min(conv_id) AS conv_id, count(*) AS n_convs FROM paths GROUP BY path, depth),
links AS (SELECT DISTINCT p.path AS up, c.path FROM paths c JOIN paths p ON p.conv_id = c.conv_id AND p.depth = c.depth - 1),
kids AS (SELECT up, count(*) AS n_children FROM links GROUP BY up),
inside AS (SELECT DISTINCT a.path AS top, d.path FROM paths a JOIN paths d ON d.conv_id = a.conv_id AND d.depth >= a.depth),
sums AS (
  SELECT i.top, sum((n.n_convs - 1) * n.size) AS saved, count(*) FILTER (WHERE k.n_children IS NULL) AS leaves
  FROM inside i JOIN nodes n ON n.path = i.path LEFT JOIN kids k ON k.up = i.path GROUP BY i.top),
last AS (SELECT conv_id, arg_max(path, depth) AS path FROM paths GROUP BY conv_id),
ends AS (SELECT path, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ends FROM last GROUP BY path)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, s.leaves AS n_leaves,
       s.saved::BIGINT AS saved_tokens, sha256(coalesce(e.ends, '')) AS ends_sha256
FROM nodes n JOIN sums s ON s.top = n.path LEFT JOIN kids k ON k.up = n.path LEFT JOIN ends e ON e.path = n.path
LEFT JOIN links l ON l.path = n.path LEFT JOIN nodes p ON p.path = l.up
"""
