"""Exact substring dedup: every byte covered by a ``LENGTH``-byte string that also starts earlier goes.

A window is a string of ``LENGTH`` bytes in one document. Each has an anchor, the leftmost least-hashed
``GRAM``-byte string in it, so equal windows have equal anchors at equal places. Consecutive windows of one anchor form a
segment, and the problem splits by anchors:

1. Documents go into block files in the shared folder. A segment whose like occurs earlier in its block is
   settled there; the first of each kind in a block is sent to its anchor's bucket, so a passage that a third
   of all documents share is sent once per block.
2. A bucket orders the segments by (doc_id, place). All equal ones but the first are removed whole. First ones
   whose anchor has other segments too may still share some of their windows: these are asked for.
3. Their blocks cut them into pieces of ``SPAN`` windows, which share a core, and send them to the core's bucket.
4. There equal pieces collapse, and the suffix array of the pieces, in which a core is one symbol, is built
   by the linear grouping construction (``suffix_array``). Windows are the suffixes' first ``SPAN`` symbols; of equal
   neighbours in the array all but the earliest are removed.
5. Each block takes what was removed in it and hashes what stays.

``suffix_array`` sorts suffixes into groups by their Lyndon prefix: groups are taken in descending order, each
member finds the nearest suffix before it that lies in a smaller group (through pointers of larger groups that are known
already), and those parents leave their groups for a new one right behind, the more members point to them the later.
Then one ascending pass emits every group's order along the same pointers. Nothing is renamed and nothing recurs.

A null text is empty. Equal doc_ids are ordered by where they are read; a null doc_id comes last. An empty table gives
an empty result; other columns are not looked at. A task that runs again writes its block under a new name.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed_texts, map_arrow, open_store, scratch, stretches_of, text_batches

LENGTH, GRAM, SPAN = 100, 40, 8
REACH = LENGTH - GRAM
CORE = LENGTH - SPAN + 1
BLOCK_BYTES, CHUNK = 16 << 20, 1 << 20
SYMBOLS_AT_ONCE = 1 << 18
NULL_ID = np.iinfo(np.int64).max

BYTE_VALUES = np.random.default_rng(21).integers(1, 1 << 64, 256, np.uint64)
STEP = 0x9E3779B97F4A7C15
SEGMENT = {"key": "<u8", "seg": "<u8", "doc": "<i8", "at": "<u4", "of": "<u4", "n": "u1", "d": "u1"}
RANGE = {"of": "<u4", "at": "<u4", "n": "<u2"}
REQUEST = {"of": "<u4", "at": "<u4", "n": "u1", "d": "u1"}
PIECE = {"core": "<u8", "doc": "<i8", "at": "<u4", "of": "<u4", "block": "<i8", "left": "u1", "right": "u1", "text": "V16"}


def pack(columns: dict[str, np.ndarray], layout: dict[str, str]) -> bytes:
    """Records by column and, within one, by byte place, so that high bytes compress."""
    out = []
    for name, kind in layout.items():
        a = np.ascontiguousarray(columns[name], dtype=kind)
        out.append(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes())
    return b"".join(out)


def unpack(data: bytes, layout: dict[str, str]) -> dict[str, np.ndarray]:
    sizes = [np.dtype(k).itemsize for k in layout.values()]
    n, at, out = len(data) // sum(sizes), 0, {}
    for (name, kind), size in zip(layout.items(), sizes, strict=True):
        planes = np.frombuffer(data, np.uint8, n * size, at).reshape(size, n)
        out[name] = np.ascontiguousarray(planes.T).view(kind).ravel()
        at += n * size
    return out


def joined(parts: list[bytes], layout: dict[str, str]) -> dict[str, np.ndarray]:
    got = [unpack(p, layout) for p in parts]
    return {name: np.concatenate([g[name] for g in got]) for name in layout}


def mixed(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser with shifts 33 and two odd multipliers."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of all strings of 40 bytes, by doubling: 8 and 32."""
    h, width, power, eight = BYTE_VALUES[data], 1, STEP, None
    while width < 32:
        h = h[:-width] * np.uint64(power) + h[width:]
        width *= 2
        power = power * power % (1 << 64)
        if width == 8:
            eight = h
    return mixed(h[: len(data) - GRAM + 1] * np.uint64(pow(STEP, 8, 1 << 64)) + eight[32:])


def segments(data: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(start, windows, anchor's offset, anchor's hash) of all segments of a block; ``ends`` are the documents' ends."""
    low = np.uint64((1 << 24) - 1)
    for begin in range(0, max(0, len(data) - LENGTH + 1), CHUNK):
        part = data[begin : begin + CHUNK + LENGTH - 1]
        h = gram_hashes(part)
        m = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        width = 1
        while 2 * width <= REACH + 1:
            m = np.minimum(m[:-width], m[width:])
            width *= 2
        rest = REACH + 1 - width
        m = np.minimum(m[: len(m) - rest], m[rest:]) if rest else m
        anchor = (m & low).astype(np.int64)
        start = np.arange(len(anchor)) + begin
        owner = np.searchsorted(ends, start, "right")
        inside = start + LENGTH <= ends[np.minimum(owner, len(ends) - 1)]
        edge = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (inside[1:] != inside[:-1])])
        first = np.flatnonzero(edge)
        n = np.diff(np.append(first, len(anchor)))
        real = inside[first]
        first, n = first[real], n[real]
        yield first + begin, n, anchor[first] - first, h[anchor[first]]


def firsts(*keys: np.ndarray) -> np.ndarray:
    """Marks the rows of sorted keys that differ from the row before."""
    out = np.zeros(len(keys[0]), bool)
    out[:1] = True
    for k in keys:
        out[1:] |= k[1:] != k[:-1]
    return out


class Block:
    """A block file: document ids, ends, ranges settled in the block, and the bytes."""

    def __init__(self, ids: np.ndarray, ends: np.ndarray, settled: dict[str, np.ndarray], data: np.ndarray):
        self.ids, self.ends, self.settled, self.data = ids, ends, settled, data

    def write(self, folder: str) -> str:
        store, base = open_store(folder)
        store.create_dir(base, recursive=True)
        path = f"{base}/{uuid.uuid4().hex}"
        own = pack(self.settled, RANGE)
        raw = np.array([len(self.ids), len(own)], "<i8").tobytes() + self.ids.astype("<i8").tobytes() + self.ends.astype("<i8").tobytes() + own + self.data.tobytes()
        with store.open_output_stream(path) as out:
            out.write(np.array([len(raw)], "<i8").tobytes() + pa.Codec("zstd", 1).compress(raw, asbytes=True))
        return path

    @staticmethod
    def read(folder: str, path: str) -> Block:
        store, _ = open_store(folder)
        with store.open_input_file(path) as f:
            whole = f.read()
        size = int(np.frombuffer(whole, "<i8", 1)[0])
        raw = pa.Codec("zstd").decompress(whole[8:], size, asbytes=True)
        n, own = np.frombuffer(raw, "<i8", 2).tolist()
        at = 16 + 16 * n
        return Block(np.frombuffer(raw, "<i8", n, 16), np.frombuffer(raw, "<i8", n, 16 + 8 * n), unpack(raw[at : at + own], RANGE), np.frombuffer(raw, np.uint8, len(raw) - at - own, at + own))


MOVED = "kind int, bucket int, block bigint, path string, data binary"
SETTLED, ASKED, BLOCKS = 0, 1, 2
ARROW = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("block", pa.int64()), ("path", pa.string()), ("data", pa.binary())])


def moved(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in ARROW]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ARROW, strict=True)], schema=ARROW)


def prepare(docs: DataFrame, folder: str, buckets: int) -> DataFrame:
    """Write the block files; the blocks' paths and the first segments of each kind in a block, by bucket."""

    def close(block: int, ids: list, texts: list[bytes]) -> list[tuple]:
        import xxhash

        data = np.frombuffer(b"".join(texts), np.uint8)
        ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
        begins = np.concatenate([[0], ends[:-1]])
        own = np.array([NULL_ID if i is None else i for i in ids], np.int64)
        whole = data.tobytes()
        parts = list(segments(data, ends))
        start, n, d, key = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in range(4))
        digest = xxhash.xxh3_64_intdigest
        seg = np.array([digest(whole[a:b]) for a, b in zip(start.tolist(), (start + n + LENGTH - 1).tolist(), strict=True)], np.uint64)
        of = np.searchsorted(ends, start, "right")
        at = start - begins[of]
        order = np.lexsort((at, of, own[of], seg, key))
        new = firsts(key[order], seg[order])
        late, kept = order[~new], order[new]
        settled = {"of": of[late], "at": at[late], "n": n[late]}
        path = Block(own, ends, settled, data).write(folder)
        rows = [(BLOCKS, block % buckets, block, path, None)]
        if len(kept):
            bucket = (key[kept].astype(np.uint64) >> np.uint64(8)) % np.uint64(buckets)
            by = np.argsort(bucket, kind="stable")
            kept, bucket = kept[by], bucket[by]
            edge = np.flatnonzero(firsts(bucket))
            for a, b in stretches_of(edge, len(kept)):
                x = kept[a:b]
                data_ = pack({"key": key[x].astype(np.uint64), "seg": seg[x], "doc": own[of[x]], "at": at[x], "of": of[x], "n": n[x], "d": d[x]}, SEGMENT)
                rows.append((ASKED, int(bucket[a]), block, None, data_))
        return rows

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, ids, texts, size = TaskContext.get().partitionId() << 24, [], [], 0
        for part in text_batches(batches):
            for doc_id, text in zip(part["doc_id"], part["text"], strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                if texts and size + len(raw) > BLOCK_BYTES:
                    yield moved(close(block, ids, texts))
                    block, ids, texts, size = block + 1, [], [], 0
                ids.append(doc_id)
                texts.append(raw)
                size += len(raw)
        if texts:
            yield moved(close(block, ids, texts))

    return map_arrow(keyed_texts(docs), body, MOVED)


def by_block(blocks: np.ndarray, columns: dict[str, np.ndarray], layout: dict[str, str], kind: int) -> list[tuple]:
    order = np.argsort(blocks, kind="stable")
    edge = np.flatnonzero(firsts(blocks[order]))
    return [(kind, 0, int(blocks[order[a]]), None, pack({k: c[order[a:b]] for k, c in columns.items()}, layout)) for a, b in stretches_of(edge, len(order))]


def settle_segments(sent: DataFrame, buckets: int) -> DataFrame:
    """Per block: ranges of segments that occur earlier elsewhere, and segments to look into."""

    def settle(rows: list[tuple[int, bytes]]) -> list[tuple]:
        x = joined([data for _, data in rows], SEGMENT)
        block = np.repeat(np.array([b for b, _ in rows], np.int64), [len(data) // 34 for _, data in rows])
        order = np.lexsort((x["at"], x["of"], block, x["doc"], x["seg"], x["key"]))
        x, block = {k: v[order] for k, v in x.items()}, block[order]
        new = firsts(x["key"], x["seg"])
        out = by_block(block[~new], {"of": x["of"][~new], "at": x["at"][~new], "n": x["n"][~new]}, RANGE, SETTLED)
        group = np.cumsum(firsts(x["key"])) - 1
        several = np.bincount(group[new], minlength=1)[group] > 1
        ask = new & several
        return out + by_block(block[ask], {k: x[k][ask] for k in REQUEST}, REQUEST, ASKED)

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, rows = None, []
        for batch in batches:
            for r in batch.to_pylist():
                if r["kind"] == BLOCKS:
                    yield moved([(BLOCKS, 0, r["block"], r["path"], None)])
                    continue
                if r["bucket"] != bucket and rows:
                    yield moved(settle(rows))
                    rows = []
                bucket = r["bucket"]
                rows.append((r["block"], r["data"]))
        if rows:
            yield moved(settle(rows))

    return map_arrow(sent.repartition(buckets, "bucket").sortWithinPartitions("bucket"), body, MOVED)


def per_block(df: DataFrame, buckets: int, body, schema: str) -> DataFrame:
    """Call ``body(block id, path, list of (kind, data))`` for each block of rows that were dealt by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, path, held = None, None, []
        for batch in batches:
            for r in batch.to_pylist():
                if r["block"] != now:
                    if now is not None:
                        yield from body(now, path, held)
                    now, path, held = r["block"], None, []
                if r["kind"] == BLOCKS:
                    path = r["path"]
                else:
                    held.append((r["kind"], r["data"]))
        if now is not None:
            yield from body(now, path, held)

    return map_arrow(df.repartition(buckets, "block").sortWithinPartitions("block", "kind"), run, schema)


def cut_pieces(asked: DataFrame, folder: str, buckets: int) -> DataFrame:
    """Pieces of the segments asked for, by the bucket of their core."""

    def body(block: int, path: str, held: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        import xxhash

        if not held:
            return
        whole = Block.read(folder, path)
        data = whole.data.tobytes()
        begins = np.concatenate([[0], whole.ends[:-1]])
        x = joined([d for _, d in held], REQUEST)
        n, d, base = x["n"].astype(np.int64), x["d"].astype(np.int64), begins[x["of"]] + x["at"]
        first, last = (REACH - d) // SPAN, (n - 1 - d + REACH) // SPAN
        which = np.repeat(np.arange(len(n)), last - first + 1)
        j = np.arange(len(which)) - np.repeat(np.cumsum(last - first + 1) - (last - first + 1), last - first + 1) + first[which]
        i1 = np.maximum(0, SPAN * j - REACH + d[which])
        i2 = np.minimum(n[which] - 1, SPAN * j + SPAN - 1 - REACH + d[which])
        core = base[which] + d[which] + SPAN * j + SPAN - 1 - REACH
        a, b = base[which] + i1, base[which] + i2 + LENGTH
        digest = xxhash.xxh3_64_intdigest
        hashes = np.array([digest(data[c : c + CORE], k) for c, k in zip(core.tolist(), j.tolist(), strict=True)], np.uint64)
        left, right = core - a, b - core - CORE
        text = np.zeros((len(a), 16), np.uint8)
        for k in range(SPAN - 1):
            ok = k < left
            text[ok, k] = whole.data[a[ok] + k]
            ok = k < right
            text[ok, 8 + k] = whole.data[core[ok] + CORE + k]
        columns = {"core": hashes, "doc": whole.ids[x["of"]][which], "at": x["at"][which] + i1, "of": x["of"][which], "block": np.full(len(a), block), "left": left, "right": right, "text": text.view("V16").ravel()}
        bucket = (hashes >> np.uint64(8)) % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        edge = np.flatnonzero(firsts(bucket[order]))
        yield moved([(ASKED, int(bucket[order[s]]), block, None, pack({k: c[order[s:e]] for k, c in columns.items()}, PIECE)) for s, e in stretches_of(edge, len(order))])

    return per_block(asked, buckets, body, MOVED)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The suffix array of small integers that end in a single least one, by grouping along Lyndon prefixes."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    new = firsts(text[order])
    starts = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    group = np.empty(n, np.int64)
    group[order] = starts
    sizes = np.zeros(n, np.int64)
    sizes[starts[new]] = np.bincount(np.cumsum(new) - 1)
    array, place, group, size = order.tolist(), place.tolist(), group.tolist(), sizes.tolist()
    before = [-1] * n
    top = n
    while top > 1:
        begin = group[array[top - 1]]
        members = array[begin:top]
        if len(members) > 1:
            members.sort()
        parents: dict[int, int] = {}
        for i in members:
            p = i - 1
            while p >= 0 and group[p] > begin:
                p = before[p]
            if p >= 0 and group[p] == begin:
                p = before[p]
            before[i] = p
            if p >= 0:
                parents[p] = parents.get(p, 0) + 1
        top = begin
        if not parents:
            continue
        if len(parents) == 1:
            levels = [list(parents)]
        else:
            by: dict[int, list[int]] = {}
            for p, times in parents.items():
                by.setdefault(times, []).append(p)
            levels = [by[times] for times in sorted(by, reverse=True)] if len(by) > 1 else list(by.values())
        for level in levels:
            left: dict[int, int] = {}
            for p in level:
                g = group[p]
                size[g] -= 1
                left[g] = end = g + size[g]
                at = place[p]
                if at != end:
                    other = array[end]
                    array[at], array[end] = other, p
                    place[other], place[p] = at, end
            for fresh in left.values():
                size[fresh] = 0
            for p in level:
                group[p] = fresh = left[group[p]]
                size[fresh] += 1
    return emitted(n, group, before)


def emitted(n: int, group: list[int], before: list[int]) -> np.ndarray:
    """The suffix array from final groups and pointers: an ascending pass puts each suffix at its group's next place."""
    free = list(range(n))
    out, done = [-1] * n, bytearray(n)
    out[0] = n - 1
    done[n - 1] = 1
    for k in range(n):
        s = out[k] - 1
        while s >= 0 and not done[s]:
            g = group[s]
            out[free[g]] = s
            free[g] += 1
            done[s] = 1
            s = before[s]
    return np.array(out)


def window_groups(x: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(piece, place in it) of every window that also starts in an earlier piece; pieces are distinct and sorted by core, then document and place."""
    left, right = x["left"].astype(np.int64), x["right"].astype(np.int64)
    rank = np.cumsum(firsts(x["core"])) - 1
    n = left + right - SPAN + 2
    size = left + right + 2  # left bytes, core, right bytes, separator
    base = np.cumsum(size) - size
    text = np.ones(int(size.sum()) + 1, np.int64)
    text[-1] = 0
    raw = x["text"].view(np.uint8).reshape(-1, 16)
    for k in range(SPAN - 1):
        ok = k < left
        text[base[ok] + k] = raw[ok, k].astype(np.int64) + 2
        ok = k < right
        text[base[ok] + left[ok] + 1 + k] = raw[ok, 8 + k].astype(np.int64) + 2
    text[base + left] = rank + 258
    piece = np.full(len(text), -1)
    offset = np.zeros(len(text), np.int64)
    owner = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    piece[base[owner] + place], offset[base[owner] + place] = owner, place
    array = suffix_array(text)
    array = array[piece[array] >= 0]
    near = text[array[:, None] + np.arange(SPAN)[None, :]]
    same = np.zeros(len(array), bool)
    same[1:] = (near[1:] == near[:-1]).all(1)
    group = np.cumsum(~same)
    order = np.lexsort((piece[array], group))  # pieces are in the order of documents and places within their core
    late = np.zeros(len(array), bool)
    late[1:] = group[order][1:] == group[order][:-1]
    gone = array[order][late]
    return piece[gone], offset[gone]


def settle_pieces(pieces: DataFrame, buckets: int) -> DataFrame:
    """Per block: ranges of windows whose like starts earlier in another segment."""

    def settle(rows: list[bytes]) -> list[tuple]:
        x = joined(rows, PIECE)
        halves = x["text"].view("<u8").reshape(-1, 2)
        keys = (x["core"], halves[:, 0], halves[:, 1], x["left"], x["right"])
        order = np.lexsort((x["at"], x["of"], x["block"], x["doc"], *keys[::-1]))
        x, keys = {k: v[order] for k, v in x.items()}, [k[order] for k in keys]
        new = firsts(*keys)
        gone = {"block": [x["block"][~new]], "of": [x["of"][~new]], "at": [x["at"][~new]], "n": [x["left"][~new].astype(np.int64) + x["right"][~new] - SPAN + 2]}
        x = {k: v[new] for k, v in x.items()}
        core = np.cumsum(firsts(x["core"])) - 1
        several = np.bincount(core, minlength=1)[core] > 1 if len(core) else np.zeros(0, bool)
        x, core = {k: v[several] for k, v in x.items()}, core[several]
        order = np.lexsort((x["at"], x["of"], x["block"], x["doc"], x["core"]))
        x, core = {k: v[order] for k, v in x.items()}, core[order]
        # Cores are independent: as many at a time as make a text of bounded size.
        edges = np.flatnonzero(firsts(core)) if len(core) else np.zeros(0, np.int64)
        begin = 0
        while begin < len(core):
            end = begin + SYMBOLS_AT_ONCE // (2 * SPAN)
            later = edges[edges >= end]
            end = int(later[0]) if len(later) else len(core)
            part = {k: v[begin:end] for k, v in x.items()}
            piece, offset = window_groups(part)
            gone["block"].append(part["block"][piece])
            gone["of"].append(part["of"][piece])
            gone["at"].append(part["at"][piece] + offset)
            gone["n"].append(np.ones(len(piece), np.int64))
            begin = end
        all_ = {k: np.concatenate(v) for k, v in gone.items()}
        return by_block(all_["block"], {k: all_[k] for k in RANGE}, RANGE, SETTLED)

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, rows = None, []
        for batch in batches:
            for b, data in zip(batch.column("bucket").to_pylist(), batch.column("data").to_pylist(), strict=True):
                if b != bucket and rows:
                    yield moved(settle(rows))
                    rows = []
                bucket = b
                rows.append(data)
        if rows:
            yield moved(settle(rows))

    return map_arrow(pieces.repartition(buckets, "bucket").sortWithinPartitions("bucket"), body, MOVED)


FOUND = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<struct<start:bigint,end:bigint>>"


def apply(settled: DataFrame, folder: str, buckets: int) -> DataFrame:
    """Each document's removed runs (byte offsets, end exclusive) and the hash of the bytes that stay."""

    def body(block: int, path: str, held: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        whole = Block.read(folder, path)
        begins = np.concatenate([[0], whole.ends[:-1]])
        x = joined([d for _, d in held], RANGE) if held else {k: np.zeros(0, np.int64) for k in RANGE}
        x = {k: np.concatenate([x[k].astype(np.int64), whole.settled[k].astype(np.int64)]) for k in RANGE}
        start = begins[x["of"]] + x["at"]
        end = start + x["n"] + LENGTH - 1
        # Union of the ranges; they never leave their document.
        order = np.argsort(start, kind="stable")
        start, end = start[order], end[order]
        reach = np.maximum.accumulate(end) if len(end) else end
        fresh = np.ones(len(start), bool)
        if len(start):
            owner = x["of"][order]
            fresh[1:] = (start[1:] > reach[:-1]) | (owner[1:] != owner[:-1])
        first = np.flatnonzero(fresh)
        starts = start[first]
        stops = reach[np.append(first[1:], len(start)) - 1] if len(first) else starts
        doc = x["of"][order][first] if len(first) else first
        lo, hi = np.searchsorted(doc, np.arange(len(whole.ids))), np.searchsorted(doc, np.arange(len(whole.ids)), "right")
        data = whole.data.tobytes()
        rows = []
        for k, (a, b) in enumerate(zip(begins.tolist(), whole.ends.tolist(), strict=True)):
            runs = list(zip(starts[lo[k] : hi[k]].tolist(), stops[lo[k] : hi[k]].tolist(), strict=True))
            digest, at = hashlib.sha256(), a
            for s, e in runs:
                digest.update(data[at:s])
                at = e
            digest.update(data[at:b])
            i = int(whole.ids[k])
            rows.append((None if i == NULL_ID else i, b - a, sum(e - s for s, e in runs), len(runs), digest.hexdigest(), [{"start": s - a, "end": e - a} for s, e in runs]))
        columns = list(zip(*rows, strict=True))
        types = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return per_block(settled, buckets, body, FOUND)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed spans of every row."""
    spark = docs.sparkSession
    folder = scratch(spark, "substrings")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    settle_segments(prepare(docs, f"{folder}/blocks", buckets), buckets).write.partitionBy("kind").parquet(f"{folder}/segments")
    known = spark.read.schema(MOVED).parquet(f"{folder}/segments")
    columns = ["kind", "bucket", "block", "path", "data"]
    asked = known.filter(F.col("kind").isin(ASKED, BLOCKS)).select(*columns)
    more = settle_pieces(cut_pieces(asked, f"{folder}/blocks", buckets), buckets)
    settled = known.filter(F.col("kind").isin(SETTLED, BLOCKS)).select(*columns).unionByName(more)
    return apply(settled, f"{folder}/blocks", buckets)
