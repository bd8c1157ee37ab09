"""Language identification by interpolated Kneser-Ney character models.

One model per language, of order 4 over lower-cased characters with digits folded to 0 and white
space to a blank. A text is padded with three begin marks and one end mark, so that short texts count. A character is kept as
12 bits of its code point, so that an n-gram is one integer whose suffix and context are bit fields.

Training counts the highest order over all given texts (each task sums its own before the shuffle);
lower orders take continuation counts, that is, in how many different left contexts an n-gram occurs.
Discounts are n1 / (n1 + 2 n2) per language and order, and each order interpolates with the one below,
the lowest with the uniform distribution over 2^12 characters.

A model is stored in sorted hash arrays: n-grams of all languages ascending by a bijective hash, beside
each one its log probability in every language. The arrays of an order hold its most frequent n-grams, ``2**bits``
at most; all n-grams stay in a table. If the arrays are not whole, the n-grams of a text that they lack are looked up
there by joins, so that scores are those of the whole model. The size that is collected and sent to the tasks is bounded by orders x 2^bits x languages,
and the number of languages by ``most_languages``, beyond which fitting raises.

A text gets the language with the lowest cross-entropy per character. It is rejected if that
cross-entropy exceeds what texts of its length and language show: the ``quantile`` of texts that the
counts have not seen, times ``margin``, for each language and power of two of the length.

A null text, or one without a letter, is ``und`` with score 0 and is rejected. Without any training
text all is ``und``. Ties go to the first language in alphabetical order. Repeated rows are scored and
counted each. Other columns are not looked at; language, source and id never enter a prediction.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fold, map_arrow, stretches_of, text_batches

ORDER, BITS = 4, 12
MASK = (1 << BITS) - 1
BEGIN, END = "\x02", "\x03"
MIX = np.uint64(0x9E3779B97F4A7C15)
FULL = np.uint64((1 << ORDER * BITS) - 1)
CHUNK = 1 << 20
DIGITS = re.compile(r"\d")
BLANKS = re.compile(r"\s")
LETTER = re.compile(r"[^\W\d_]")


def spelled(text: str) -> str:
    return BLANKS.sub(" ", DIGITS.sub("0", text.lower()))


def grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Packed 4-grams that end at each character or end mark, with the index of their text, in chunks."""
    pad = BEGIN * (ORDER - 1)
    lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts)) + ORDER
    owner_ends = np.cumsum(lengths)
    joined = np.frombuffer("".join(f"{pad}{t}{END}" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = owner_ends - lengths
    for begin in range(0, len(joined), CHUNK):
        end = min(begin + CHUNK, len(joined))
        codes = joined[max(0, begin - ORDER + 1) : end].astype(np.uint64) & np.uint64(MASK)
        packed = np.zeros(end - begin, np.uint64)
        lead = len(codes) - (end - begin)
        codes = np.concatenate([np.zeros(ORDER - 1 - lead, np.uint64), codes])
        for k in range(ORDER):
            packed |= codes[k : k + end - begin] << np.uint64(BITS * (ORDER - 1 - k))
        first, last = np.searchsorted(owner_ends, [begin, end - 1], "right")
        sizes = np.minimum(owner_ends[first : last + 1], end) - np.maximum(starts[first : last + 1], begin)
        owner = np.repeat(np.arange(first, last + 1, dtype=np.int64), sizes)
        real = np.arange(begin, end) - starts[owner] >= ORDER - 1
        yield packed[real], owner[real]


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.diff(keys, prepend=keys[:1] ^ np.uint64(1))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def runs(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    return ordered[first], np.diff(np.append(first, len(ordered)))


def count_grams(docs: DataFrame) -> DataFrame:
    """lang, gram (packed), n: highest-order counts over whole texts of docs(text, lang)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: list[str] = []
        held_keys, held_counts, size = [], [], 0

        def out():
            keys, counts = summed(np.concatenate(held_keys), np.concatenate(held_counts))
            langs = pa.DictionaryArray.from_arrays(pa.array((keys >> np.uint64(48)).astype(np.int32)), pa.array(names)).cast(pa.string())
            return pa.RecordBatch.from_arrays([langs, pa.array((keys & FULL).astype(np.int64)), pa.array(counts)], ["lang", "gram", "n"])

        for part in text_batches(batches, 4 << 20):
            for name in part["lang"]:
                if name not in names:
                    names.append(name)
            of = np.array([names.index(x) for x in part["lang"]], np.uint64)
            for packed, owner in grams([spelled(t) for t in part["text"]]):
                keys, counts = runs(np.sort(packed | of[owner] << np.uint64(48)))
                held_keys.append(keys)
                held_counts.append(counts)
                size += len(keys)
            if size > 1_500_000:
                keys, counts = summed(np.concatenate(held_keys), np.concatenate(held_counts))
                held_keys, held_counts, size = [keys], [counts], len(keys)
                if size > 750_000:
                    yield out()
                    held_keys, held_counts, size = [], [], 0
        if held_keys:
            yield out()

    partial = map_arrow(docs.select("text", "lang"), count, "lang string, gram bigint, n bigint")
    return partial.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def hashed(gram: Column | np.ndarray):
    """A bijection on packed n-grams that spreads them over the slots."""
    return (gram * MIX) & FULL


def kneser_ney(counts: DataFrame) -> list[DataFrame]:
    """Per order 1..4: lang, gram, n, p (interpolated probability), gamma (weight of the order below, in its own right a context)."""
    levels = [cut(counts)]
    for _ in range(ORDER - 1):  # continuation counts
        above = levels[0]
        level = ORDER - len(levels)
        levels.insert(0, above.groupBy("lang", F.col("gram").bitwiseAND((1 << BITS * level) - 1).alias("gram")).agg(F.count(F.lit(1)).alias("n")))
    levels = [*map(cut, levels[:-1]), levels[-1]]
    out: list[DataFrame] = []
    for k, level in enumerate(levels, 1):
        ones, twos = (F.count(F.when(F.col("n") == c, 1)) for c in (1, 2))
        d = F.when(ones + twos > 0, ones / (ones + 2 * twos)).otherwise(0.5)
        discount = level.groupBy("lang").agg(F.greatest(F.least(d, F.lit(0.95)), F.lit(0.05)).alias("d"))
        context = F.shiftright("gram", BITS).alias("context")
        totals = level.groupBy("lang", context).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"))
        weights = totals.join(discount, "lang").select("lang", "context", "total", "d", (F.col("d") * F.col("kinds") / F.col("total")).alias("gamma"))
        here = level.withColumn("context", context).join(weights, ["lang", "context"])
        own = F.greatest(F.col("n") - F.col("d"), F.lit(0.0)) / F.col("total")
        if k == 1:
            full = here.select("lang", "gram", "n", (own + F.col("gamma") / (1 << BITS)).alias("p"))
        else:
            below = out[-1].select("lang", F.col("gram").alias("suffix"), F.col("p").alias("q"))
            here = here.withColumn("suffix", F.col("gram").bitwiseAND((1 << BITS * (k - 1)) - 1)).join(below, ["lang", "suffix"])
            full = here.select("lang", "gram", "n", (own + F.col("gamma") * F.col("q")).alias("p"))
        if k > 1:  # the context's weight belongs to the order below
            own_weight = weights.select("lang", F.col("context").alias("gram"), "gamma")  # the begin marks alone are contexts but no n-grams
            out[-1] = out[-1].join(own_weight, ["lang", "gram"], "full").withColumn("n", F.coalesce("n", F.lit(0)))
        else:
            base = weights.select("lang", "gamma")
        out.append(cut(full))  # read by the next order and by the slots
    out[-1] = out[-1].withColumn("gamma", F.lit(None).cast("double"))
    return [base, *out]


@dataclass
class Model:
    """Sorted hash arrays per order (``keys[k]``, ``logs[k]``: n-grams x languages) and the uniform floor."""

    langs: list[str]
    keys: list[np.ndarray]
    logs: list[np.ndarray]
    weights: list[np.ndarray]  # log weight of an n-gram as the context of a character not seen behind it
    floor: np.ndarray
    whole: bool = True  # no n-gram is missing

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy in nats per character, texts x languages, and characters with the end mark."""
        total, chars, _ = self.sums(texts)
        return -total / np.maximum(chars, 1)[:, None], chars

    def sums(self, texts: list[str], leave: bool = False) -> tuple[np.ndarray, np.ndarray, list[list]]:
        """Log probabilities, texts x languages, and characters; with ``leave`` without the 4-grams that the arrays lack, which follow: text, n-gram, times."""
        lacking: list[list] = [[np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]]
        total = np.zeros((len(texts), len(self.langs)))
        chars = np.zeros(len(texts))
        for packed, owner in grams([spelled(t) for t in texts]):
            # so many texts as fit into 16 bits beside a hash at a time
            edges = np.searchsorted(owner, np.arange(owner[0], owner[-1] + 1, 1 << 16)) if len(owner) else owner
            pieces = [(packed[a:b], owner[a:b]) for a, b in stretches_of(edges, len(owner)) if b > a]
            for codes, of in pieces:
                low = int(of[0])
                n = int(of[-1]) - low + 1
                both = np.sort(((codes * MIX) & FULL) << np.uint64(16) | (of - low).astype(np.uint64))
                key, times = runs(both >> np.uint64(16))
                logs = self.lookup(key)
                if leave:
                    lost = ~find(self.keys[-1], (key * INVERSE) & FULL)[1]
                    logs[lost] = 0
                    each, n_each = runs(both[np.repeat(lost, times)]) if lost.any() else (both[:0], times[:0])
                    for x, y in zip(lacking, ((each & np.uint64(0xFFFF)).astype(np.int64) + low, ((each >> np.uint64(16)) * INVERSE) & FULL, n_each), strict=True):
                        x.append(y)
                doc = (both & np.uint64(0xFFFF)).astype(np.intp)
                chars[low : low + n] += np.bincount(doc, minlength=n)
                for j in range(len(self.langs)):
                    total[low : low + n, j] += np.bincount(doc, np.repeat(logs[:, j], times), n)
        return total, chars, lacking

    def lookup(self, key: np.ndarray) -> np.ndarray:
        logs = np.zeros((len(key), len(self.langs)), np.float32)
        todo = np.arange(len(key))
        gram = (key * INVERSE) & FULL
        for k in range(ORDER, 0, -1):
            here = gram[todo] & np.uint64((1 << BITS * k) - 1)
            at, hit = find(self.keys[k - 1], here)
            logs[todo[hit]] += self.logs[k - 1][at[hit]]
            todo, here = todo[~hit], here[~hit]
            if k > 1:
                at, known = find(self.keys[k - 2], here >> np.uint64(BITS))
                logs[todo[known]] += self.weights[k - 2][at[known]]
        logs[todo] += self.floor
        return logs


INVERSE = np.uint64(pow(int(MIX), -1, 1 << ORDER * BITS))


def fit(docs: DataFrame, bits: int = 18, most_languages: int = 256) -> Model | None:
    """The models of all languages in docs(text, lang); None if there is no text with a language."""
    return fit_whole(docs, bits, most_languages)[0]


def whole_levels(orders: list[DataFrame], langs: list[str], empty: list[float]) -> list[DataFrame]:
    """Per order gram, n over all languages, logs and weights (arrays by language) of every n-gram of any language."""
    out: list[DataFrame] = []
    for k, level in enumerate(orders, 1):
        of = [F.log(F.max(F.when(F.col("lang") == lang, F.col(x)))).alias(f"{x}{j}") for x in ("p", "gamma") for j, lang in enumerate(langs)]
        rows = level.groupBy("gram").agg(F.sum("n").alias("n"), *of)
        if k == 1:
            logs = [F.coalesce(f"p{j}", F.lit(e)) for j, e in enumerate(empty)]
        else:  # not seen in a language: the context's weight there, if the context is known, times the order below
            under = out[-1].select(F.col("gram").alias("suffix"), F.col("logs").alias("under"))
            above = out[-1].select(F.col("gram").alias("context"), F.col("weights").alias("own"))
            rows = rows.withColumn("suffix", F.col("gram").bitwiseAND((1 << BITS * (k - 1)) - 1)).withColumn("context", F.shiftright("gram", BITS))
            rows = rows.join(under, "suffix", "left").join(above, "context", "left")
            logs = [F.coalesce(f"p{j}", F.coalesce(F.col("under")[j], F.lit(e)) + F.coalesce(F.col("own")[j], F.lit(0.0))) for j, e in enumerate(empty)]
        weights = [F.coalesce(f"gamma{j}", F.lit(0.0)) for j in range(len(langs))]
        out.append(cut(rows.select("gram", "n", F.array(*logs).alias("logs"), F.array(*weights).alias("weights"))))
    return out


def most_frequent(level: DataFrame, most: int) -> tuple[DataFrame, bool]:
    """The n-grams above a frequency, ``most`` of them at most, and whether these are all."""
    step = F.coalesce(F.floor(8 * F.log2(F.when(F.col("n") > 0, F.col("n")))), F.lit(-1))  # some 500 steps at most
    total = 0
    for r in sorted(level.groupBy(step.alias("step")).count().collect(), key=lambda r: -r["step"]):
        if total + r["count"] > most:
            return level.filter(step > r["step"]), False
        total += r["count"]
    return level, True


def fit_whole(docs: DataFrame, bits: int = 18, most_languages: int = 256) -> tuple[Model | None, list[DataFrame]]:
    """The model, and the table of all n-grams of each order."""
    usable = docs.filter("text is not null and lang is not null")
    base, *orders = kneser_ney(count_grams(usable))
    gammas = {r["lang"]: r["gamma"] for r in base.limit(most_languages + 1).collect()}
    langs = sorted(gammas)
    if not langs:
        return None, []
    if len(langs) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    empty = np.array([np.log(max(gammas[x], 1e-9) / (1 << BITS)) for x in langs], np.float32)
    levels = whole_levels(orders, langs, empty.astype(float).tolist())
    keys, logs, weights, whole = [], [], [], True
    for level in levels:
        kept, every = most_frequent(level, 1 << bits)
        whole &= every
        rows = kept.select("gram", F.col("logs").cast("array<float>"), F.col("weights").cast("array<float>")).toArrow()  # one order at a time
        key = rows.column("gram").to_numpy().astype(np.uint64) * MIX & FULL
        order = np.argsort(key)
        keys.append(key[order])
        for x, name in ((logs, "logs"), (weights, "weights")):
            flat = rows.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float32)
            x.append(flat.reshape(-1, len(langs))[order])
        del rows
    return Model(langs, keys, logs, weights, empty, whole), levels


def looked_up(wanted: DataFrame, levels: list[DataFrame], empty: list[float]) -> DataFrame:
    """gram and logs in the whole model of each 4-gram of ``wanted``."""
    rows, logs = wanted, [F.lit(e) for e in empty]
    for k, level in enumerate(levels, 1):
        suffix = F.col("gram").bitwiseAND((1 << BITS * k) - 1)
        own = level.select(F.col("gram").alias(f"s{k}"), F.col("logs").alias(f"logs{k}"))
        rows = rows.withColumn(f"s{k}", suffix).join(own, f"s{k}", "left")
        if k > 1:
            context = levels[k - 2].select(F.col("gram").alias(f"c{k}"), F.col("weights").alias(f"w{k}"))
            rows = rows.withColumn(f"c{k}", F.shiftright(suffix, BITS)).join(context, f"c{k}", "left")
            logs = [x + F.coalesce(F.col(f"w{k}")[j], F.lit(0.0)) for j, x in enumerate(logs)]
        logs = [F.coalesce(F.col(f"logs{k}")[j], x) for j, x in enumerate(logs)]
    return rows.select("gram", F.array(*logs).alias("logs"))


def find(keys: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    want = gram * MIX & FULL
    if not len(keys):
        return np.zeros(len(want), np.intp), np.zeros(len(want), bool)
    at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
    return at, keys[at] == want


def score_texts(docs: DataFrame, model: Model | None, keep: str = "") -> DataFrame:
    """The best language, its cross-entropy and score of each whole text; ``keep`` names extra columns as 'name type, ...'. Written, so that the sent model can go."""
    extra = [x.split()[0] for x in keep.split(",")] if keep else []
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for part in text_batches(batches, 4 << 20):
            texts = [t or "" for t in part["text"]]
            letter = np.array([bool(LETTER.search(t)) for t in texts], bool)
            if m is None:
                best, entropy, score, chars = [None] * len(texts), np.zeros(len(texts)), np.zeros(len(texts)), np.zeros(len(texts))
            else:
                h, chars = m.score(texts)
                at = h.argmin(1)
                entropy = h[np.arange(len(texts)), at]
                score = 1.0 / np.exp(-(h - entropy[:, None])).sum(1)
                best = [m.langs[j] for j in at]
            columns = {name: part[name] for name in ["doc_id", *extra]}
            columns |= {"has_letter": letter, "chars": chars.astype(np.int64), "best": pa.array(best, pa.string()), "entropy": entropy, "score": score}
            yield pa.RecordBatch.from_pydict({k: pa.array(v) if not isinstance(v, list) else pa.array(v, TYPES.get(k)) for k, v in columns.items()})

    schema = f"doc_id bigint, {keep + ', ' if keep else ''}has_letter boolean, chars bigint, best string, entropy double, score double"
    scored = cut(map_arrow(docs.select("doc_id", "text", *extra), body, schema))
    sent.destroy()
    return scored


def score_with_joins(docs: DataFrame, model: Model, levels: list[DataFrame], keep: str) -> DataFrame:
    """As ``score_texts``, for a model whose arrays are not whole; ``docs`` and ``keep`` have text_key."""
    extra = [x.split()[0] for x in keep.split(",")]
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_batches(batches, 4 << 20):
            texts = [t or "" for t in part["text"]]
            total, chars, (of, gram, times) = sent.value.sums(texts, leave=True)
            of = np.concatenate(of)
            order = np.argsort(of, kind="stable")
            ends = np.searchsorted(of[order], np.arange(len(texts) + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x)[order].astype(np.int64))) for x in (gram, times)]
            columns = {name: pa.array(part[name], TYPES.get(name, pa.string())) for name in ["doc_id", *extra]}
            columns |= {"has_letter": pa.array([bool(LETTER.search(t)) for t in texts], pa.bool_()), "chars": pa.array(chars.astype(np.int64))}
            columns |= {"total": pa.array(total.tolist(), pa.list_(pa.float64())), "grams": lists[0], "times": lists[1]}
            yield pa.RecordBatch.from_pydict(columns)

    schema = f"doc_id bigint, {keep}, has_letter boolean, chars bigint, total array<double>, grams array<bigint>, times array<bigint>"
    partial = cut(map_arrow(docs.select("doc_id", "text", *extra), body, schema))
    sent.destroy()
    lacking = partial.select("text_key", "grams", "times").dropDuplicates(["text_key"])
    lacking = cut(lacking.select("text_key", F.explode(F.arrays_zip("grams", "times")).alias("x")).select("text_key", F.col("x.grams").alias("gram"), F.col("x.times").alias("times")))
    known = cut(looked_up(lacking.select("gram").distinct(), levels, model.floor.astype(float).tolist()))
    sums = [F.sum(F.col("logs")[j] * F.col("times")).alias(f"more{j}") for j in range(len(model.langs))]
    more = lacking.join(known, "gram").groupBy("text_key").agg(*sums)
    h = [-(F.col("total")[j] + F.coalesce(f"more{j}", F.lit(0.0))) / F.greatest("chars", F.lit(1)) for j in range(len(model.langs))]
    rows = partial.join(more, "text_key", "left").withColumn("h", F.array(*h)).withColumn("entropy", F.array_min("h"))
    best = F.array(*map(F.lit, model.langs))[(F.array_position("h", F.col("entropy")) - 1).cast("int")]
    score = 1 / F.aggregate("h", F.lit(0.0), lambda s, x: s + F.exp(F.col("entropy") - x))
    return cut(rows.select("doc_id", *extra, "has_letter", "chars", best.alias("best"), "entropy", score.alias("score")))


TYPES = {"doc_id": pa.int64(), "lang": pa.string(), "use": pa.int32(), "text_key": pa.int64()}

QUANTILE, MARGIN = 0.999, 1.25


def identify(docs: DataFrame, use: Column, bits: int = 18, quantile: float = QUANTILE, margin: float = MARGIN) -> DataFrame:
    """doc_id, text_key (hash of the text), lang_pred, score, entropy, rejected for every row of docs(doc_id, text, lang).

    ``use`` says of each row whether its text and language are 0: not learned from, 1: counted, 2: used to
    calibrate the rejection.
    """
    marked = docs.select("doc_id", "text", "lang", F.coalesce(use.cast("int"), F.lit(0)).alias("use"), F.xxhash64("text").alias("text_key"))
    model, levels = fit_whole(marked.filter("use = 1"), bits)
    columns = "lang string, use int, text_key bigint"
    scored = score_texts(marked, model, columns) if model is None or model.whole else score_with_joins(marked, model, levels, columns)  # the texts are gone by now
    bucket = F.floor(F.log2(F.col("chars") + 1)).alias("bucket")
    own = scored.filter("use = 2 and has_letter and lang is not null and best = lang")
    limits = own.groupBy(F.col("lang").alias("best"), bucket).agg(
        F.percentile_approx("entropy", quantile, 10_000).alias("most"), F.count(F.lit(1)).alias("n")
    )
    ever = limits.groupBy("best").agg(F.max("most").alias("ever"))
    # At most ``most_languages`` languages and 40 lengths, so a frequent language and length is not dealt to one task.
    judged = scored.withColumn("bucket", bucket).join(F.broadcast(limits), ["best", "bucket"], "left").join(F.broadcast(ever), "best", "left")
    limit = F.when(F.col("n") >= 100, F.col("most")).otherwise(F.greatest("most", "ever")) * margin
    known = F.col("has_letter") & F.col("best").isNotNull()
    return judged.select(
        "doc_id",
        "text_key",
        F.when(known, F.col("best")).otherwise("und").alias("lang_pred"),
        F.when(known, F.col("score")).otherwise(0.0).alias("score"),
        "entropy",
        (~known | F.coalesce(F.col("entropy") > limit, F.lit(False))).alias("rejected"),
    )


def keep_identified(docs: DataFrame, bits: int = 18) -> DataFrame:
    """The rows of ``docs`` whose language is not rejected, with all their columns; learned from their own languages."""
    part = fold(F.col("doc_id"), 5)
    found = identify(docs, F.when(F.col("lang").isNull(), 0).when(part == 4, 2).otherwise(1), bits)
    gone = cut(found.filter("rejected").select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key")).distinct())
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["gone_id"]) & (F.xxhash64(docs["text"]) == gone["gone_key"]), "left_anti")
