"""Personal data: fixed patterns, and a character-level bidirectional LSTM with CRF transitions that adds spans.

Base spans per kind are the leftmost non-overlapping matches of the kind's pattern that pass its check; they
always stay. The network learns from them as labelled spans: at most ``TRAIN_WINDOWS`` windows with and as many without
a span, distinct and chosen by the least hash of their content from all documents, and trained in numpy on the driver with a fixed seed.

A text is covered by windows of ``WIDTH`` characters, each overlapping the next by half. Every kind of span has a
digit or an at sign, and spans without one are dropped, so a window that has neither, nor a neighbour that has,
adds nothing and is not computed; all others are. Overlapping windows are reconciled globally: their tag
marginals are averaged per character, and one Viterbi pass with the CRF's transitions decodes each stretch of windows. A decoded span is
added if its mean marginal reaches ``SURE``, it has what its kind needs, and it overlaps neither a base
span nor a match that failed its check (those are known not to be personal data).

Offsets count code points, ends are exclusive. A null or empty text has no spans. Without a labelled span
anywhere nothing is added. Repeated rows are searched each; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import keyed_texts, map_arrow, text_batches

KINDS = ("email", "ip", "card", "phone")
# The patterns of the base spans. The look-behind only spares starts inside a run of digits.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")
NOT_DIGIT = re.compile("[^0-9]")

WIDTH, STRIDE = 64, 32
TRAIN_WINDOWS, STEPS, BATCH = 2000, 300, 64
EMBED, HIDDEN = 12, 16
SURE = 0.9
TAGS = 1 + 2 * len(KINDS)  # outside; begin and inside of each kind


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of local part, at sign and dotted domain: each at sign with the longest local part before it."""
    out, at, free = [], text.find("@"), 0
    while at >= 0:
        begin = at
        while begin > free and text[begin - 1] in LOCAL:
            begin -= 1
        end = DOMAIN.match(text, at + 1) if begin < at else None
        if end:
            out.append((begin, end.end()))
            free = end.end()
        at = text.find("@", max(at + 1, free))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def base_spans(text: str) -> tuple[dict[str, list[tuple[int, int]]], list[tuple[int, int]]]:
    """Spans of each kind, and the matches that failed their check."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    failed = []
    if "@" in text:
        out["email"] = emails(text)
    if DIGIT.search(text):
        for m in IP.finditer(text):
            good = all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))
            (out["ip"] if good else failed).append(m.span())
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 13:
                digits = NOT_DIGIT.sub("", m[0])
                if len(digits) >= 13:
                    (out["card"] if len(digits) <= 19 and luhn(digits) else failed).append(m.span())
        for m in PHONE.finditer(text) if "+" in text else ():
            n = len(NOT_DIGIT.sub("", m[0]))
            (out["phone"] if 9 <= n <= 15 else failed).append(m.span())
    return out, failed


def char_ids(text: str) -> np.ndarray:
    """0: padding, 1-95: printable ASCII, 96: line feed, 97: other below 128, 98: other letters and signs."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(codes == 10, 96, np.where((codes >= 32) & (codes < 127), codes - 31, np.where(codes < 128, 97, 98))).astype(np.int64)


CHARS = 99


def window_starts(text: str) -> np.ndarray:
    """Starts of the windows to compute: those with a digit or an at sign, and their neighbours."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    marks = np.flatnonzero(((codes >= 48) & (codes <= 57)) | (codes == 64))
    if not len(marks):
        return np.zeros(0, np.int64)
    blocks = np.unique(marks // STRIDE)
    near = np.unique(np.concatenate([blocks - 2, blocks - 1, blocks, blocks + 1]))
    return near[(near >= 0) & (near * STRIDE < len(codes))] * STRIDE


def tags_of(spans: dict[str, list[tuple[int, int]]], size: int) -> np.ndarray:
    tags = np.zeros(size, np.int64)
    for k, kind in enumerate(KINDS):
        for a, b in spans[kind]:
            if not tags[a:b].any():
                tags[a:b] = 2 + 2 * k
                tags[a] = 1 + 2 * k
    return tags


@dataclass
class Network:
    """Weights; two directions of an LSTM over character embeddings, a linear layer to tags, CRF transitions."""

    w: dict[str, np.ndarray]

    @staticmethod
    def new(seed: int = 3) -> Network:
        rng = np.random.default_rng(seed)
        w = {"embed": rng.normal(0, 0.3, (CHARS, EMBED)), "out": rng.normal(0, 0.2, (2 * HIDDEN, TAGS)), "bias": np.zeros(TAGS), "move": np.zeros((TAGS, TAGS)), "start": np.zeros(TAGS)}
        for d in ("f", "b"):
            w[f"x{d}"] = rng.normal(0, 1 / np.sqrt(EMBED), (EMBED, 4 * HIDDEN))
            w[f"h{d}"] = rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 4 * HIDDEN))
            w[f"c{d}"] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])
        return Network({k: v.astype(np.float32) for k, v in w.items()})

    def run(self, ids: np.ndarray, d: str) -> dict:
        """One direction over windows x characters; what the backward pass needs is kept."""
        n, t = ids.shape
        table = self.w["embed"] @ self.w[f"x{d}"] + self.w[f"c{d}"]
        h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        gates = np.empty((t, n, 4 * HIDDEN), np.float32)
        hs, cs = np.zeros((t + 1, n, HIDDEN), np.float32), np.zeros((t + 1, n, HIDDEN), np.float32)
        for i in range(t):
            g = table[ids[:, i]] + h @ self.w[f"h{d}"]
            g[:, : 3 * HIDDEN] = 1 / (1 + np.exp(-g[:, : 3 * HIDDEN]))
            g[:, 3 * HIDDEN :] = np.tanh(g[:, 3 * HIDDEN :])
            c = g[:, HIDDEN : 2 * HIDDEN] * c + g[:, :HIDDEN] * g[:, 3 * HIDDEN :]
            h = g[:, 2 * HIDDEN : 3 * HIDDEN] * np.tanh(c)
            gates[i], hs[i + 1], cs[i + 1] = g, h, c
        return {"gates": gates, "hs": hs, "cs": cs}

    def run_back(self, ids: np.ndarray, d: str, kept: dict, grad_h: np.ndarray, grads: dict) -> None:
        n, t = ids.shape
        wh, H = self.w[f"h{d}"], HIDDEN
        dh, dc = np.zeros((n, H), np.float32), np.zeros((n, H), np.float32)
        dgates = np.empty((t, n, 4 * H), np.float32)
        for i in range(t - 1, -1, -1):
            g, c, before = kept["gates"][i], np.tanh(kept["cs"][i + 1]), kept["cs"][i]
            dh = dh + grad_h[i]
            dc = dc + dh * g[:, 2 * H : 3 * H] * (1 - c * c)
            dg = dgates[i]
            dg[:, :H] = dc * g[:, 3 * H :] * g[:, :H] * (1 - g[:, :H])
            dg[:, H : 2 * H] = dc * before * g[:, H : 2 * H] * (1 - g[:, H : 2 * H])
            dg[:, 2 * H : 3 * H] = dh * c * g[:, 2 * H : 3 * H] * (1 - g[:, 2 * H : 3 * H])
            dg[:, 3 * H :] = dc * g[:, :H] * (1 - g[:, 3 * H :] ** 2)
            dh, dc = dg @ wh.T, dc * g[:, H : 2 * H]
        flat = dgates.reshape(-1, 4 * H)
        by_char = np.zeros((CHARS, 4 * H), np.float32)
        np.add.at(by_char, ids.T.ravel(), flat)
        grads[f"h{d}"] = np.einsum("tnh,tng->hg", kept["hs"][:-1], dgates, optimize=True)
        grads[f"c{d}"] = by_char.sum(0)
        grads[f"x{d}"] = self.w["embed"].T @ by_char
        grads["embed"] += by_char @ self.w[f"x{d}"].T

    def emissions(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict, dict]:
        f, b = self.run(ids, "f"), self.run(ids[:, ::-1], "b")
        both = np.concatenate([f["hs"][1:], b["hs"][1:][::-1]], 2)
        return both @ self.w["out"] + self.w["bias"], both, f, b

    def marginals(self, emit: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Tag marginals (characters x windows x tags), expected transitions, and the log partition summed."""
        t, n, k = emit.shape
        top = emit.max(2, keepdims=True)
        e, a = np.exp(emit - top), np.exp(self.w["move"])
        alpha, scale = np.empty_like(e), np.empty((t, n, 1), np.float32)
        x = np.exp(self.w["start"]) * e[0]
        for i in range(t):
            if i:
                x = (alpha[i - 1] @ a) * e[i]
            scale[i] = x.sum(1, keepdims=True)
            alpha[i] = x / scale[i]
        beta, moves = np.ones((n, k), np.float32), np.zeros((k, k), np.float32)
        out = np.empty_like(e)
        out[-1] = alpha[-1]
        for i in range(t - 2, -1, -1):
            ahead = e[i + 1] * beta / scale[i + 1]
            moves += alpha[i].T @ ahead
            beta = ahead @ a.T
            out[i] = alpha[i] * beta
        return out, moves * a, float(np.log(scale).sum() + top.sum())

    def step(self, ids: np.ndarray, tags: np.ndarray) -> tuple[dict, float]:
        emit, both, f, b = self.emissions(ids)
        probs, moves, logz = self.marginals(emit)
        t, n, k = emit.shape
        gold = np.zeros_like(probs)
        np.put_along_axis(gold, tags.T[:, :, None], 1, 2)
        seen = np.zeros((k, k), np.float32)
        np.add.at(seen, (tags[:, :-1].ravel(), tags[:, 1:].ravel()), 1)
        first = np.bincount(tags[:, 0], minlength=k)
        loss = logz - float((emit * gold).sum()) - float((seen * self.w["move"]).sum()) - float(first @ self.w["start"])
        d = (probs - gold) / n
        grads = {"embed": np.zeros_like(self.w["embed"]), "move": (moves - seen) / n, "start": probs[0].sum(0) / n - first / n, "bias": d.sum((0, 1))}
        grads["out"] = both.reshape(-1, 2 * HIDDEN).T @ d.reshape(-1, k)
        back = d @ self.w["out"].T
        self.run_back(ids, "f", f, back[:, :, :HIDDEN], grads)
        self.run_back(ids[:, ::-1], "b", b, back[::-1, :, HIDDEN:], grads)
        return grads, loss / n


def fit(ids: np.ndarray, tags: np.ndarray, steps: int = STEPS, rate: float = 0.01) -> Network:
    """Adam over shuffled batches; the same windows give the same weights."""
    net, rng = Network.new(), np.random.default_rng(9)
    m, v = {k: np.zeros_like(x) for k, x in net.w.items()}, {k: np.zeros_like(x) for k, x in net.w.items()}
    order = np.zeros(0, np.int64)
    for step in range(1, steps + 1):
        if len(order) < BATCH:
            order = np.concatenate([order, rng.permutation(len(ids))])
        batch, order = order[:BATCH], order[BATCH:]
        grads, _ = net.step(ids[batch], tags[batch])
        size = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        now = rate if step <= steps // 2 else rate * 0.3
        for k, g in grads.items():
            g = g * min(1.0, 5.0 / max(size, 1e-9))
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            net.w[k] = (net.w[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def sample(docs: DataFrame, most: int) -> list[pa.Table]:
    """w and tags of the ``most`` distinct windows of least hash with a base span, and of as many without one; each task gives off no more."""

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        held: tuple[set, set] = (set(), set())
        limit = [1 << 63, 1 << 63]

        def cut_down(k: int) -> list[tuple[int, str, bytes]]:
            rows = sorted(held[k])[:most]
            held[k].intersection_update(rows)
            if len(rows) == most:
                limit[k] = rows[-1][0]
            return rows

        for part in text_batches(batches):
            for text in part["text"]:
                starts = window_starts(text)
                if not len(starts):
                    continue
                tags = tags_of(base_spans(text)[0], len(text)).astype(np.uint8)
                for a in starts.tolist():
                    own, w = tags[a : a + WIDTH], text[a : a + WIDTH]
                    k, by = int(own.any()), xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"), 42)
                    by -= (by >> 63) << 64
                    if by <= limit[k]:
                        held[k].add((by, w, own.tobytes()))
                        if len(held[k]) > 4 * most:
                            cut_down(k)
        for k in (0, 1):
            if rows := cut_down(k):
                by, w, t = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(w), pa.array(t, pa.binary()), pa.array([bool(k)] * len(rows)), pa.array(by, pa.int64())], ["w", "tags", "has", "by"])

    windows = map_arrow(keyed_texts(docs), body, "w string, tags binary, has boolean, by bigint")
    return [windows.filter(c).select("w", "tags", "by").distinct().orderBy("by", "w", "tags").limit(most).select("w", "tags").toArrow() for c in ("has", "not has")]


def train(docs: DataFrame, most: int = TRAIN_WINDOWS) -> Network | None:
    """A network from at most ``most`` windows with and ``most`` without a base span; None if there is none with one."""
    chosen = sample(docs, most)
    if chosen[0].num_rows == 0:
        return None
    ids, tags = [], []
    for rows in chosen:
        for w, t in zip(rows.column("w").to_pylist(), rows.column("tags").to_pylist(), strict=True):
            own = char_ids(w)
            ids.append(np.pad(own, (0, WIDTH - len(own))))
            tags.append(np.pad(np.frombuffer(t, np.uint8).astype(np.int64), (0, WIDTH - len(own))))
    return fit(np.array(ids), np.array(tags))


def stretches(starts: np.ndarray) -> list[np.ndarray]:
    """Window starts in stretches whose windows overlap."""
    return np.split(starts, np.flatnonzero(np.diff(starts) > STRIDE) + 1) if len(starts) else []


ENTERS = np.array([[j == 0 or j % 2 == 1 or i in (j, j - 1) for j in range(TAGS)] for i in range(TAGS)])


def viterbi(net: Network, stretch: np.ndarray) -> np.ndarray:
    """The best tags of averaged log marginals under the CRF's transitions; an inside tag follows its own kind only."""
    move = np.where(ENTERS, 0.1 * net.w["move"], -1e9)
    best, back = stretch[0].copy(), np.empty(stretch.shape, np.int64)
    best[2::2] = -1e9
    for i in range(1, len(stretch)):
        score = best[:, None] + move
        back[i] = score.argmax(0)
        best = score.max(0) + stretch[i]
    tags = np.empty(len(stretch), np.int64)
    tags[-1] = best.argmax()
    for i in range(len(stretch) - 1, 0, -1):
        tags[i - 1] = back[i, tags[i]]
    return tags


def plausible(kind: str, text: str) -> bool:
    digits = len(NOT_DIGIT.sub("", text))
    if kind == "email":
        return 0 < text.find("@") < len(text) - 1 and " " not in text and "\n" not in text
    return {"ip": 4 <= digits <= 12 and text.count(".") == 3, "card": 13 <= digits <= 19, "phone": 7 <= digits <= 15}[kind]


def added(net: Network, texts: list[str], found: list[tuple[dict, list]]) -> list[list[tuple[str, int, int]]]:
    """The spans that the network adds to each text."""
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    plan, rows = [], []
    for k, text in enumerate(texts):
        starts = window_starts(text)
        if len(starts):
            ids = np.pad(char_ids(text), (0, WIDTH))
            for part in stretches(starts):
                plan.append((k, part, len(rows)))
                rows += [ids[a : a + WIDTH] for a in part.tolist()]
    if not rows:
        return out
    every = np.array(rows)
    probs = np.empty((len(every), WIDTH, TAGS), np.float32)
    for a in range(0, len(every), 512):
        emit, _, _, _ = net.emissions(every[a : a + 512])
        probs[a : a + 512] = net.marginals(emit)[0].transpose(1, 0, 2)
    for k, part, at in plan:
        text, begin = texts[k], int(part[0])
        size = min(int(part[-1]) + WIDTH, len(text)) - begin
        total, times = np.zeros((size, TAGS), np.float32), np.zeros((size, 1), np.float32)
        for i, a in enumerate((part - begin).tolist()):
            own = probs[at + i, : size - a]
            total[a : a + len(own)] += own
            times[a : a + len(own)] += 1
        mean = total / times
        if not (mean[:, 0] < 0.5).any():
            continue
        tags = viterbi(net, np.log(np.maximum(mean, 1e-6)))
        taken = [s for kind in KINDS for s in found[k][0][kind]] + found[k][1]
        for i in np.flatnonzero(tags % 2 == 1).tolist():
            j = i + 1
            while j < size and tags[j] == tags[i] + 1:
                j += 1
            a, b, kind = begin + i, begin + j, KINDS[(tags[i] - 1) // 2]
            sure = float(mean[np.arange(i, j), tags[i:j]].mean())
            if sure >= SURE and plausible(kind, text[a:b]) and not any(x < b and a < y for x, y in taken):
                out[k].append((kind, a, b))
    return out


FOUND = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_added bigint"


def spelled(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def find(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, base spans per kind counted, the sha256 of the base spans' list, all spans, and how many were added."""
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for part in text_batches(batches):
            found = [base_spans(t) for t in part["text"]]
            more = added(model, part["text"], found) if model else [[] for _ in found]
            base = [[(kind, a, b) for kind in KINDS for a, b in spans[kind]] for spans, _ in found]
            out = {"doc_id": pa.array(part["doc_id"], pa.int64())}
            out |= {f"n_{kind}": pa.array([len(spans[kind]) for spans, _ in found], pa.int64()) for kind in KINDS}
            out["base_sha256"] = pa.array([hashlib.sha256(spelled(s).encode()).hexdigest() for s in base])
            out["spans"] = pa.array([spelled(s + m) for s, m in zip(base, more, strict=True)])
            out["n_added"] = pa.array([len(m) for m in more], pa.int64())
            yield pa.RecordBatch.from_pydict(out)

    return map_arrow(keyed_texts(docs), body, FOUND)


def detect(docs: DataFrame, most: int = TRAIN_WINDOWS) -> DataFrame:
    """Train on the documents' base spans and search every document."""
    return find(docs, train(docs, most))
