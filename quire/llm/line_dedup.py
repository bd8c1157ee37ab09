"""Line dedup by a tree of log templates.

A line's tokens with a digit become ``<*>``. The tree has a fixed depth: the number of tokens, then
the leading tokens; a leaf holds the lines that agree in these. Within a leaf a token's level is how often
its share of the leaf's (document, line) pairs at its position must be doubled to exceed one half or reach one; a token that fewer
than ``min_docs`` pairs have has none, as no template with it can recur. The tokens up to the least level at which they make up
``similarity`` of a line are its constants and the others variable fields, ``<*>``: that is its template. So
what is constant follows shares, not the size of the table. Without such a level the line stands for itself. A template that ``min_docs`` documents or more share
recurs, and its lines are dropped everywhere but in the first document (smallest doc_id) that has it,
so that of a passage which many documents copied one copy stays.

A line with ``LONG`` tokens that are not masked is no coincidence: it recurs as itself from two documents on. A line
that has so many tokens only with the masked ones counts there unmasked, so that unlike rows of numbers stay. A line of
fewer than ``min_tokens`` tokens has a template like any other, which recurs from ``SHORT_DOCS`` documents on, if
it has a letter outside its masked tokens.

Lines are split at a line feed. Blank lines, and short ones without such a letter (brackets, rules, numbers), are
kept. A null text stays null, an empty one empty. Rows that share a doc_id, null included, count as
one document and take the same decisions. Other columns pass through (one named n_lines_dropped is replaced). An empty table gives an empty
table.

Nothing is grouped into one task: leaves, tokens and templates are counted with partial aggregation,
equal lines collapse before their tokens are counted, and only lines of leaves with enough documents
travel with their text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, let

WILD = "<*>"
LEADING, MIN_TOKENS, MIN_DOCS, SIMILARITY = 3, 5, 10, 0.7
LONG, SHORT_DOCS = 8, 10


def plain(line: Column) -> Column:
    return F.trim(F.regexp_replace(line, r"[\x20\x09-\x0D]+", " "))


def masked(line: Column) -> Column:
    """The line's tokens joined by one blank, those with a digit masked."""
    return F.when(line.rlike("[0-9]"), F.regexp_replace(plain(line), r"[^ ]*[0-9][^ ]*", WILD)).otherwise(plain(line))


def whole(line: Column, tokens: Column, h: Column) -> Column:
    """What two documents with this long line share: its masked hash, or if too little is left of it, its own; null for other lines."""
    left = F.size(F.filter(tokens, lambda t: t != WILD))
    return F.when(F.size(tokens) >= LONG, F.when(left >= LONG, h).otherwise(F.xxhash64(plain(line), F.lit("whole"))))


def leaf_of(tokens: Column, leading: int) -> Column:
    return F.xxhash64(F.size(tokens), F.array_join(F.slice(tokens, 1, leading), " "))


def parsed(text: Column, leading: int, min_tokens: int) -> Column:
    """The lines that can have a template: array of (line, leaf, h, short, whole, words), h the hash of the masked line."""

    def one(raw: Column, line: Column) -> Column:
        def fields(t: Column) -> Column:
            short, h = F.size(t) < min_tokens, F.xxhash64(line)
            leaf = F.when((line != "") & (~short | line.rlike(r"\p{L}")), leaf_of(t, leading))
            return F.struct(line.alias("line"), leaf.alias("leaf"), h.alias("h"), short.alias("short"), whole(raw, t, h).alias("whole"), F.size(t).alias("words"))

        return let(F.split(line, " "), fields)

    lines = F.transform(F.split(text, "\n", -1), lambda raw: let(masked(raw), lambda line: one(raw, line)))
    return F.filter(lines, lambda x: x["leaf"].isNotNull())


def recurring_lines(
    docs: DataFrame, leading: int = LEADING, min_tokens: int = MIN_TOKENS, min_docs: int = MIN_DOCS, similarity: float = SIMILARITY, spare: float | None = None
) -> DataFrame:
    """doc_id and the hashes of the lines (masked, or whole) that go from it; documents that keep all their lines are not listed."""
    first = F.min_by("doc_id", F.struct(F.col("doc_id").isNull(), "doc_id")).alias("first")
    parts = docs.select("doc_id", F.explode(F.array_distinct(parsed(F.col("text"), leading, min_tokens))).alias("x")).select("doc_id", "x.*")
    # Leaves that enough documents visit; a template cannot recur more often than its leaf.
    keys = cut(parts.select("doc_id", "leaf", "h", "short", "whole", "words").distinct())
    long = keys.filter("whole IS NOT NULL").select("doc_id", F.col("whole").alias("h"), "words")
    twice = long.groupBy("h").agg(F.count(F.lit(1)).alias("n"), first).filter(F.col("n") >= 2)
    copied = long.join(twice, "h").filter(~F.col("doc_id").eqNullSafe(F.col("first"))).select("doc_id", "h", "words", "first")
    hot = cut(keys.select("doc_id", "leaf").distinct().groupBy("leaf").count().filter(F.col("count") >= min(min_docs, SHORT_DOCS)).select("leaf"))
    pairs = cut(keys.select("doc_id", "leaf", "h", "short", "words").join(hot, "leaf", "left_semi").distinct())
    # Equal lines of these leaves collapse where they are read, before their tokens are looked at; no document is joined for them.
    known = pairs.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    spelled_out = docs.select(F.explode(parsed(F.col("text"), leading, min_tokens)).alias("x")).select("x.leaf", "x.h", "x.line", "x.short")
    found = spelled_out.join(hot, "leaf", "left_semi").distinct()
    shapes = cut(found.join(known, "h"))
    tokens = shapes.select("h", "leaf", "short", "n", F.posexplode(F.split("line", " ")).alias("pos", "token"))
    totals = shapes.groupBy("leaf").agg(F.sum("n").alias("total"))
    constant = tokens.filter(F.col("token") != WILD).groupBy("leaf", "pos", "token").agg(F.sum("n").alias("m")).filter(F.col("m") >= min_docs)
    level = F.floor(F.log2(F.col("total") / F.col("m"))).cast("int")
    held = tokens.join(constant.join(totals, "leaf").select("leaf", "pos", "token", level.alias("level")), ["leaf", "pos", "token"], "left")
    spelled = held.groupBy("h", "leaf", "short").agg(
        F.sort_array(F.collect_list(F.struct("pos", "token", "level"))).alias("t"),
        F.sort_array(F.collect_list("level")).alias("levels"),
    )  # a group is the tokens of one line
    least = F.get("levels", F.greatest(F.ceil(F.size("t") * F.lit(similarity) - 1e-9), F.lit(1)).cast("int") - 1)
    spelled = spelled.withColumn("least", least)
    general = F.xxhash64("leaf", F.array_join(F.transform("t", lambda x: F.when(x["level"] <= F.col("least"), x["token"]).otherwise(WILD)), " "))
    templates = spelled.select("h", "short", F.when(F.col("least").isNotNull(), general).otherwise(F.col("h")).alias("template"))
    placed = pairs.select("doc_id", "h", "words").join(templates, "h")
    needed = F.when(F.bool_or("short"), SHORT_DOCS).otherwise(min_docs)
    recurring = placed.select("template", "doc_id", "short").distinct().groupBy("template").agg(F.count(F.lit(1)).alias("n"), needed.alias("needed"), first).filter(F.col("n") >= F.col("needed"))
    dropped = placed.join(recurring, "template").filter(~F.col("doc_id").eqNullSafe(F.col("first"))).select("doc_id", "h", "words", "first").unionByName(copied)
    if spare is not None:
        # What a document shares with one and the same first document: more than ``spare`` of its words make it a copy.
        once = dropped.groupBy("doc_id", "h").agg(F.max("words").alias("words"), F.min("first").alias("first"))
        shared = once.groupBy("doc_id", "first").agg(F.sum("words").alias("words")).groupBy("doc_id").agg(F.max("words").alias("shared"))
        own = keys.groupBy(F.col("doc_id").alias("own_id")).agg(F.sum("words").alias("own"))
        copies = shared.join(own, F.col("doc_id").eqNullSafe(F.col("own_id"))).filter(F.col("shared") > spare * F.col("own")).select(F.col("doc_id").alias("copy_id"))
        dropped = dropped.join(copies, F.col("doc_id").eqNullSafe(F.col("copy_id")), "left_anti")
    return dropped.groupBy("doc_id").agg(F.collect_set("h").alias("dropped"))


def drop_recurring_lines(
    docs: DataFrame, leading: int = LEADING, min_tokens: int = MIN_TOKENS, min_docs: int = MIN_DOCS, similarity: float = SIMILARITY, spare: float | None = None
) -> DataFrame:
    """All rows and columns of ``docs``, texts without the lines whose template recurs, and n_lines_dropped.

    With ``spare`` a document that has more than this share of its words in lines of one earlier document stays as it is:
    it is a copy of that document, which is for near-duplicate detection to judge, and that needs whole texts.
    """
    gone = recurring_lines(docs, leading, min_tokens, min_docs, similarity, spare).withColumnRenamed("doc_id", "gone_id")
    others = F.struct(*[c for c in docs.columns if c not in ("doc_id", "text")], F.lit(0).alias("_"))  # in one column, so that no name clashes
    joined = docs.select("doc_id", "text", others.alias("others")).join(gone, F.col("doc_id").eqNullSafe(F.col("gone_id")), "left")

    def stays(raw: Column) -> Column:
        def kept(line: Column) -> Column:
            own = F.coalesce(F.array_contains(F.col("dropped"), whole(raw, F.split(line, " "), F.xxhash64(line))), F.lit(False))
            return ~(F.array_contains(F.col("dropped"), F.xxhash64(line)) | own)

        return let(masked(raw), kept)

    def rebuilt(lines: Column) -> Column:
        return let(F.filter(lines, stays), lambda kept: F.struct(F.array_join(kept, "\n").alias("text"), (F.size(lines) - F.size(kept)).cast("long").alias("n")))

    new = F.when(F.col("dropped").isNotNull(), let(F.split("text", "\n", -1), rebuilt))
    out = joined.withColumn("dropped_lines", F.explode(F.array(new)))
    own = {"doc_id": F.col("doc_id"), "text": F.coalesce("dropped_lines.text", "text").alias("text")}
    rest = [own[c] if c in own else F.col("others")[c].alias(c) for c in docs.columns if c != "n_lines_dropped"]
    return out.select(*rest, F.coalesce("dropped_lines.n", F.lit(0).cast("long")).alias("n_lines_dropped"))
