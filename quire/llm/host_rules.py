"""Quality rules with host verdicts, in DataFrame functions alone.

``measure`` counts, per document and over its whole text, what the rules need. ``host_verdicts``
counts the failures of each host, fits a beta prior to the hosts' failure rates by their mean and
variance and shrinks each host's rate towards it: a host with few documents stays near the prior.
``judge`` joins the verdicts back: a document is kept if it passes the base rules and its host's
shrunken rate is within the limit.

A null or empty text has no words and fails. A document without a source has no host and is
judged by the base rules alone. Repeated rows are measured and counted each; an empty table gives
an empty result. Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, let

WINDOW = 5
# White space between words, and the characters that count as symbols.
BLANK = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"

MAX_HOST_RATE = 0.5


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANK), "")


def repeated_words(words: Column) -> Column:
    """Words that lie in a five-word window whose words occur twice or more in the text, each counted once.

    Windows are compared by a 64-bit hash of their words' 64-bit hashes, within one text only.
    """
    none = F.lit(0).cast("long")

    def windows(h: Column) -> Column:
        last = F.size(h) - WINDOW
        starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))

    def covered(w: Column) -> Column:
        placed = F.array_sort(F.transform(w, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

        def twins(s: Column) -> Column:
            same = lambda p, j: F.coalesce(F.get(s, j - 1)["x"] == p["x"], F.lit(False)) | F.coalesce(F.get(s, j + 1)["x"] == p["x"], F.lit(False))
            return F.array_sort(F.transform(F.filter(s, same), lambda p: p["i"]))

        start = F.struct(none.alias("n"), none.alias("end"))

        def add(acc: Column, i: Column) -> Column:
            end = (i + WINDOW).cast("long")
            return F.struct((acc["n"] + end - F.greatest(acc["end"], i.cast("long"))).alias("n"), end.alias("end"))

        return F.aggregate(let(placed, twins), start, add, lambda acc: acc["n"])

    def counted(w: Column) -> Column:
        return F.when(F.size(F.array_distinct(w)) == F.size(w), none).otherwise(covered(w))

    return let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: let(windows(h), counted))


def host_of(source: Column) -> Column:
    """The host of an address, or the source's own name, in lower case; null if there is none."""
    return F.nullif(F.lower(F.regexp_extract(source, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:[^/@]*@)?([^/:?#]+)", 1)), F.lit(""))


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, host, counts and base_failed; one row for each row of ``docs``."""
    whole = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), host_of(F.col("source")).alias("host"))

    def counts(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            repeated_words(words).alias("n_repeat_words"),
        )

    def dup_lines(lines: Column) -> Column:
        return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")

    lines = F.filter(F.split("text", "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    symbols = F.length("text") - F.length(F.regexp_replace("text", SYMBOLS, ""))
    out = whole.select(
        "doc_id", "host", F.explode(F.array(let(words_of(F.col("text")), counts))).alias("c"),
        symbols.cast("long").alias("n_symbols"), let(lines, dup_lines).alias("n_dup_lines"),
    )
    out = out.select("doc_id", "host", "c.n_words", "c.word_chars", "n_symbols", "n_dup_lines", "c.n_repeat_words")
    return out.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def rule_failures() -> Column:
    """A document fails for its host if a base rule fails, symbols abound, lines repeat or words are oddly long."""
    n, lines = F.col("n_words"), F.col("n_dup_lines")
    odd = (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 15 * n)
    return F.col("base_failed") | (2 * F.col("n_symbols") > n) | (20 * lines > n) | odd


def host_verdicts(measured: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """host, n_docs, n_failed, rate (shrunken), host_failed.

    With mean m and variance v of the hosts' rates, the prior is Beta(ms, (1-m)s), s = m(1-m)/v - 1.
    If the hosts do not vary, each takes the mean.
    """
    failed = F.sum(rule_failures().cast("long"))
    hosts = measured.filter("host is not null").groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"), failed.alias("n_failed"))
    raw = F.col("n_failed") / F.col("n_docs")
    prior = hosts.agg(F.struct(F.avg(raw).alias("m"), F.var_pop(raw).alias("v")).alias("p")).scalar()
    m, v = prior["m"], prior["v"]
    s = F.greatest(m * (1 - m) / v - 1, F.lit(0.0))
    rate = F.when(v < 1e-12, m).otherwise((F.col("n_failed") + m * s) / (F.col("n_docs") + s))
    return hosts.select("host", "n_docs", "n_failed", rate.alias("rate"), (rate > max_rate).alias("host_failed"))


def judge(docs: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """The measures of each document with base_failed, the host's verdict and kept."""
    measured = cut(measure(docs))  # read twice; the texts are gone by now
    verdicts = host_verdicts(measured, max_rate).select("host", "rate", "host_failed")
    joined = measured.join(verdicts, "host", "left")
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.coalesce("host_failed", F.lit(False)))


COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]

ORACLE = """
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
    nullif(lower(regexp_extract(source, '^(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:[^/@]*@)?([^/:?#]+)', 1)), '') AS host FROM documents),
s AS (SELECT *, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM t),
g AS (SELECT r, unnest(range(1, len(w) - 3)) AS i, w FROM s WHERE len(w) >= 5),
k AS (SELECT r, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3] || ' ' || w[i+4] AS win FROM g),
d AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS c FROM k) WHERE c > 1),
n AS (SELECT r, count(DISTINCT p) AS c FROM (SELECT r, unnest([i, i+1, i+2, i+3, i+4]) AS p FROM d) GROUP BY r),
m AS (SELECT doc_id, host, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n.c, 0)::BIGINT AS n_repeat_words FROM s LEFT JOIN n USING (r)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
f AS (SELECT *, base_failed OR 2 * n_symbols > n_words OR 20 * n_dup_lines > n_words
    OR word_chars < 2 * n_words OR word_chars > 15 * n_words AS failed FROM b),
h AS (SELECT host, count(*) AS c, count(*) FILTER (failed) AS x FROM f WHERE host IS NOT NULL GROUP BY host),
p AS (SELECT avg(x / c) AS m, var_pop(x / c) AS v FROM h),
q AS (SELECT m, v, greatest(CASE WHEN v < 1e-12 THEN 0 ELSE m * (1 - m) / v END - 1, 0) AS s FROM p),
z AS (SELECT host, CASE WHEN v < 1e-12 THEN m ELSE (x + m * s) / (c + s) END > 0.5 AS host_failed FROM h, q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND NOT coalesce(host_failed, false) AS kept FROM f LEFT JOIN z USING (host)
"""
