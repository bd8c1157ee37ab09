"""From page streams to independent documents."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fields as X
from ..functions import patterns as P
from ..functions.text import normalise
from ..session import cut
from .keyed import keep, lookup
from .ordered import BLOCK, in_order


def page_evidence(text: Column, identity: Sequence[Column], date: Column, subject: Column,
                  least: int = 120) -> Column:
    """A boundary page is long enough, names a reference and shows a date or a subject."""
    return page_evidence_of(F.length(text), identity, date, subject, least)


def page_evidence_of(size: Column, identity: Sequence[Column], date: Column, subject: Column, least: int = 120) -> Column:
    """The same rule where only the length of the normalised text was kept."""
    named = reduce(lambda a, b: a | b, [c.isNotNull() for c in identity])
    return (size >= least) & named & (date.isNotNull() | subject.isNotNull())


def index_volumes(pages: DataFrame, source: str, page: str, text: str, *, all_of: Sequence[str] = (P.INDEX_ALL,),
                  any_of: Sequence[str] = tuple(P.INDEX_ANY), front: int = P.INDEX_FRONT_PAGES,
                  names: Sequence[str] = (), profile: str = "collector") -> DataFrame:
    """Sources that are reference indexes, by name or by their front matter.

    The front matter is at most ``front`` pages a source, so joining it is bounded
    and a marker may straddle a page break.
    """
    first = pages.filter(F.col(page) <= front)
    joined = first.groupBy(source).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct(F.col(page).alias("p"), F.col(text).alias("t")))),
                        lambda x: x["t"]),
            "\n",
        ).alias("_front")
    )
    words = F.col("_words")
    marked = reduce(lambda a, b: a & b, [words.contains(t) for t in all_of])
    marked = marked & reduce(lambda a, b: a | b, [words.contains(t) for t in any_of])
    if names:
        marked = marked | F.col(source).isin(*names)
    return keep(joined.withColumn("_words", normalise(F.col("_front"), profile)), marked, source)


def boundaries(candidates: DataFrame, source: str, page: str, identity: Sequence[str],
               block: int = BLOCK, keep_block: bool = False) -> DataFrame:
    """Keep a candidate page when its identity differs from the previous candidate's.

    Filter by evidence first: pages without evidence do not interrupt an identity. With ``keep_block``
    the layout stays for ``spans``.
    """
    packed = candidates.withColumn("_identity", F.struct(*identity))
    looked = in_order(packed, [source], page, previous={"_before": "_identity"}, block=block, keep_block=keep_block)
    return looked.filter(~F.col("_before").eqNullSafe(F.col("_identity"))).drop("_before", "_identity")


def spans(starts: DataFrame, source: str, page: str, last_pages: DataFrame, last: str,
          block: int = BLOCK) -> DataFrame:
    """End of each span: the page before the next start, else the last page.

    Compute before any candidate is skipped; a skipped one still ends its predecessor. Starts that
    ``boundaries`` has left in their blocks are not dealt out again.
    """
    looked = in_order(starts, [source], page, following={"_next": page}, block=block, laid="_block" in starts.columns)
    sized = lookup(looked, last_pages.select(source, last), [source], [source, page])
    return sized.withColumn("end_page", F.coalesce(F.col("_next") - 1, F.col(last))).drop("_next", last)


def number_spans(pages: DataFrame, source: str, page: str, is_start: str, *, block: int = BLOCK,
                 keep_block: bool = False) -> DataFrame:
    """Span number of every page; pages before the first start belong to none."""
    flagged = pages.withColumn("_one", F.col(is_start).cast("long"))
    numbered = in_order(flagged, [source], page, running={"span_no": "_one"}, block=block, keep_block=keep_block)
    return numbered.filter(F.col("span_no") > 0).drop("_one")


PIECE_PAGES = 500


def span_text(pages: DataFrame, source: str, page: str, text: str, is_start: str, *,
              piece_pages: int = PIECE_PAGES, block: int = BLOCK) -> DataFrame:
    """Text of each span, pages joined by a form feed.

    Long spans come in pieces of up to ``piece_pages`` pages, numbered by page range,
    so no single row or task has to hold a volume. Pieces nest in the blocks of the
    span numbering: the text is exchanged once.
    """
    block = max(block - block % piece_pages, piece_pages)
    numbered = number_spans(pages, source, page, is_start, block=block, keep_block=True)
    piece = F.expr(f"`{page}` div {int(piece_pages)}")
    ordered = F.array_sort(F.collect_list(F.struct(F.col(page).alias("p"), F.col(text).alias("t"))))
    return (
        numbered.withColumn("piece", piece)
        .groupBy(source, "_block", "span_no", "piece")
        .agg(
            F.min(page).alias("first_page"),
            F.max(page).alias("last_page"),
            F.array_join(F.transform(ordered, lambda x: x["t"]), "\f").alias("span_text"),
        )
        .drop("_block")
    )


def span_halos(pieces: DataFrame, source: str, text: Column, before: int, after: int, *, block: int = BLOCK) -> DataFrame:
    """What stands before and after each piece within its span: (source, span_no, piece, _follows, _before, _after).

    A span's text is its pieces' ``text`` joined by a blank; empty pieces are no part of it. Only pieces of spans
    with several get a row; ``_follows`` says that the joining blank precedes the piece.

    Neighbours may be shorter than the context asked for, so looking one piece back is not enough. The span's
    characters are numbered by a running sum of the lengths and cut into cells as wide as the wider context. A piece
    hands its characters to the two cells at either edge and reads its context from the two cells at either edge:
    the cost is four short strings a piece, whatever the length of a span, and no task holds a whole span.
    """
    wide = max(before, after, 1)
    several = pieces.groupBy(source, "span_no").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(source, "span_no")
    read = pieces.join(several, [source, "span_no"], "left_semi").select(
        source, "span_no", "piece", F.concat(F.lit(" "), text).alias("_t"))
    edges = keep(read, F.length("_t") > 1, source, "span_no", "piece", F.length("_t").cast("long").alias("_size"),
                 F.left("_t", F.lit(2 * wide)).alias("_head"), F.right("_t", F.lit(2 * wide)).alias("_tail"))
    summed = in_order(edges, [source, "span_no"], "piece", running={"_to": "_size"}, block=block)
    placed = cut(summed.withColumn("_from", F.col("_to") - F.col("_size")).drop("_size"))

    first, last = F.expr(f"_from div {wide}"), F.expr(f"_to div {wide}")
    low, high = F.greatest(F.col("_cell") * wide, F.col("_from")), F.least((F.col("_cell") + 1) * wide, F.col("_to"))
    length = F.greatest(high - low, F.lit(0)).cast("int")
    from_head = F.substring("_head", (low - F.col("_from") + 1).cast("int"), length)
    from_tail = F.substring("_tail", (low - F.col("_to") + F.length("_tail") + 1).cast("int"), length)
    given = placed.withColumn("_cell", F.explode(F.array_distinct(F.array(first, first + 1, last - 1, last))))
    given = given.filter(high > low).select(
        source, "span_no", "_cell", low.alias("_at"), F.when(F.col("_cell") <= first + 1, from_head).otherwise(from_tail).alias("_part"))
    cells = given.groupBy(source, "span_no", "_cell").agg(F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("_at", "_part"))), lambda x: x["_part"]), "").alias("_text"))

    asked = placed.select(source, "span_no", "piece", "_from", "_to", first.alias("_first"), last.alias("_last"))
    asked = asked.withColumn("_cell", F.explode(F.array_distinct(F.expr("array(_first - 1, _first, _last, _last + 1)"))))

    def cell(number: Column) -> Column:
        return F.coalesce(F.max(F.when(F.col("_cell") == number, F.col("_text"))), F.lit(""))

    answered = asked.join(cells, [source, "span_no", "_cell"], "left").groupBy(
        source, "span_no", "piece", "_from", "_to", "_first", "_last",
    ).agg(cell(F.col("_first") - 1).alias("_a"), cell(F.col("_first")).alias("_b"), cell(F.col("_last")).alias("_c"),
          cell(F.col("_last") + 1).alias("_d"))
    inside = F.concat("_a", F.left("_b", (F.col("_from") - F.col("_first") * wide).cast("int")))
    beyond = F.concat(F.substring("_c", (F.col("_to") - F.col("_last") * wide + 1).cast("int"), F.lit(wide)), "_d")
    # The first piece has no blank before it, so one character less precedes the others.
    room = F.greatest(F.least(F.lit(before), F.col("_from") - 1), F.lit(0)).cast("int")
    return answered.select(source, "span_no", "piece", (F.col("_from") > 0).alias("_follows"),
                           F.right(inside, room).alias("_before"), F.left(beyond, F.lit(after)).alias("_after"))


def span_court(pieces: DataFrame, source: str, text: Column, *, markers: Sequence[str] = P.COURT_MARKERS,
               guarded: str = P.APPEAL_COURT, reject: str = P.APPEAL_CERTIFICATION, stop: str = P.COURT_TAIL_STOP,
               more: Mapping[str, Column] | None = None, block: int = BLOCK) -> DataFrame:
    """Court of each span as its whole text gives it, however it lies in pieces: (source, span_no, court, more).

    Markers in precedence, each at its first place. Names and contexts that cross a border are read through the
    pieces' halos. ``more`` names further expressions over a piece; the earliest piece that has one gives it.
    """
    more = dict(more or {})
    halos = span_halos(pieces, source, text, X.COURT_BEFORE, X.COURT_AFTER + max(map(len, markers)) + X.COURT_TAIL, block=block)
    read = pieces.select(source, "span_no", "piece", text.alias("_t"), *[c.alias(n) for n, c in more.items()])
    read = read.join(halos, [source, "span_no", "piece"], "left")
    own = F.concat(F.when(F.col("_follows"), " ").otherwise(""), "_t")
    around = [F.coalesce(c, F.lit("")) for c in ("_before", "_after")]
    tails = [X.court_tail(own, m, guarded, reject, *around).alias(f"_e{i}") for i, m in enumerate(markers)]
    named = read.select(source, "span_no", "piece", *more, *tails)
    found = [f"_e{i}" for i in range(len(markers))]
    earliest = named.groupBy(source, "span_no").agg(*[
        F.min_by(c, F.when(F.col(c).isNotNull(), F.col("piece"))).alias(c) for c in [*found, *more]])
    return earliest.select(source, "span_no", F.coalesce(*[X.court_name(F.col(c), stop) for c in found]).alias("court"), *more)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Compute a value once and use it often: inside a lambda Catalyst would compute it again for every element."""
    return F.get(F.transform(F.array(value), body), 0)


def _cut_pieces(text: Column, patterns: Sequence[str]) -> Column:
    """All pieces of one text, cut where a new reference number begins; NULL where it does not split.

    The first pattern with more than one distinct number wins. The first piece also holds what precedes it.
    Numbers are found from left to right and do not overlap: one that begins inside another cuts nothing.
    """

    def pieces(pattern: str) -> Column:
        found = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("numbers"),
                         F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("matches"), F.split(text, pattern).alias("rests"))

        def numbered(found: Column) -> Column:
            return _let(F.transform(F.array_distinct(F.array_remove(found["numbers"], "")), lambda n: F.array_position(found["numbers"], n).cast("int") + 1),
                        lambda fresh: F.when(F.size(fresh) > 1, _let(segments(found["matches"], found["rests"]), lambda s: parts(s, fresh))))

        def segments(matches: Column, rests: Column) -> Column:
            """What precedes the first match, then each match with what follows it."""
            return F.transform(rests, lambda rest, i: F.concat(F.coalesce(F.get(matches, i - 1), F.lit("")), rest))

        def parts(segments: Column, fresh: Column) -> Column:
            return F.transform(fresh, lambda f, i: _let(F.when(i == 0, 1).otherwise(f), lambda begin: F.trim(F.array_join(
                F.slice(segments, begin, F.coalesce(F.get(fresh, i + 1), F.size(segments) + 1) - begin), ""))))

        return _let(found, numbered)

    return F.coalesce(*map(pieces, patterns))


def split_document(text: Column, patterns: Sequence[str], least: int = 200) -> Column:
    """Pieces of one text, cut where a new reference number begins.

    Pieces under ``least`` characters go (``short_pieces`` has them); a text that does not
    split, or of which nothing would stay, stays whole. ``text`` is normalised.
    """
    whole = F.when(text != "", F.array(text)).otherwise(F.array().cast("array<string>"))
    kept = F.filter(_cut_pieces(text, patterns), lambda p: F.length(p) >= least)
    return _let(kept, lambda k: F.when(F.size(k) > 0, k).otherwise(whole))


def short_pieces(text: Column, patterns: Sequence[str], least: int = 200) -> Column:
    """The pieces that ``split_document`` leaves out of this text: (piece, text), for the error output of a split.

    ``piece`` counts from 1 over all pieces. Nothing is left out of a text that stays whole.
    """
    numbered = F.transform(_cut_pieces(text, patterns), lambda p, i: F.struct((i + 1).alias("piece"), p.alias("text")))

    return _let(numbered, lambda n: _let(F.exists(n, lambda p: F.length(p["text"]) >= least), lambda some: F.filter(
        n, lambda p: some & (F.length(p["text"]) < least))))


def processing_log(pages: DataFrame, source: str, boundary: str, indexed: str) -> DataFrame:
    """One row per source: pages, boundaries, indexed records, status and note."""
    per_source = pages.groupBy(source).agg(
        F.count(F.lit(1)).alias("pages"), F.count_if(F.col(boundary)).alias("detected_boundaries"),
        F.count_if(F.col(indexed)).alias("indexed"),
    )
    none = F.col("detected_boundaries") == 0
    return per_source.select(
        "*",
        F.when(none, "needs_review").otherwise("indexed").alias("status"),
        F.when(none, "no_verified_case_boundaries_detected")
        .when(F.col("indexed") == F.col("detected_boundaries"), "case_pdfs_created")
        .otherwise("case_pdfs_created_with_metadata_review_required").alias("notes"),
    )
