"""Field extraction over normalised text and lines."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .text import collapse, none_if_empty


def first_match(col: Column, patterns: Sequence[str], group: int = 1) -> Column:
    """Group of the first pattern in the list that matches anywhere; NULL if none does."""
    return F.coalesce(*[none_if_empty(collapse(F.regexp_extract(col, p, group))) for p in patterns])


def either(given: Column, found: Column) -> Column:
    """Keep a given non-empty field, else take what the text shows."""
    return F.coalesce(none_if_empty(collapse(given.cast("string"))), found)


def _contains_any(col: Column, terms: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [col.contains(t) for t in terms])


def title(lines: Column, rejects: Sequence[str] = P.TITLE_REJECTS,
          stops: Sequence[str] = P.TITLE_STOP_PREFIXES, mark: str = P.TITLE_DASHES) -> Column:
    """Subject of a first page.

    The first of the top 55 lines that carries a dash opens it; up to six wrapped
    lines complete it until a stop. A left fold carries the text and a stop flag.
    """

    def number(x: Column) -> Column:
        return x.rlike(r"^[0-9]{1,4}$")

    def opens(x: Column) -> Column:
        size = F.length(x)
        return (size >= 14) & (size <= 420) & x.rlike(mark) & ~_contains_any(x, rejects)

    def breaks(x: Column) -> Column:
        early = reduce(lambda a, b: a | b, [x.startswith(s) for s in stops])
        return number(x) | _contains_any(x, rejects) | early | (F.length(x) < 14)

    def step(acc: Column, x: Column) -> Column:
        over = acc["over"] | breaks(x)
        return F.struct(
            (over | x.rlike(r"[.\u06D4]$")).alias("over"),
            F.when(over, acc["text"]).otherwise(F.concat(acc["text"], F.lit(" "), x)).alias("text"),
        )

    head = F.slice(lines, 1, 55)
    at = F.array_position(F.transform(head, opens), F.lit(True)).cast("int")
    start = F.struct(F.lit(False).alias("over"), F.get(lines, at - 1).alias("text"))
    folded = F.aggregate(F.slice(lines, F.greatest(at + 1, F.lit(1)), F.lit(6)), start, step, lambda acc: acc["text"])
    return F.when(at > 0, F.substring(collapse(folded), 1, 700))


def short_title(lines: Column, rejects: Sequence[str], marks: Sequence[str]) -> Column:
    """Single-line title among the first forty lines."""

    def fits(x: Column) -> Column:
        return (F.length(x) >= 12) & (F.length(x) <= 420) & ~_contains_any(x, rejects) & _contains_any(x, marks)

    return F.get(F.filter(F.slice(lines, 1, 40), fits), 0)


def field_line(lines: Column, keyword: str, limit: int = 180, require: Sequence[str] = (),
               exclude: Sequence[str] = P.LINE_EXCLUSIONS, stop: str = P.LINE_STOP,
               strip: str = P.LINE_PUNCTUATION) -> Column:
    """First line that names the keyword, cut before a stop phrase."""
    least = len(keyword) + 3

    def named(x: Column) -> Column:
        ok = x.contains(keyword) & (F.length(x) >= least) & ~_contains_any(x, exclude)
        return ok & _contains_any(x, require) if require else ok

    def cut(x: Column) -> Column:
        return F.trim(F.get(F.split(x, stop, 2), 0), F.lit(strip))

    def usable(x: Column) -> Column:
        return x.contains(keyword) & (F.length(x) >= least) & ~_contains_any(x, exclude)

    return F.substring(F.get(F.filter(F.transform(F.filter(lines, named), cut), usable), 0), 1, limit)


COURT_BEFORE, COURT_AFTER, COURT_TAIL = 90, 120, 140  # context of a guarded marker; characters of a name with its marker


def court_tail(text: Column, marker: str, guarded: str = P.APPEAL_COURT, reject: str = P.APPEAL_CERTIFICATION,
               before: Column | None = None, after: Column | None = None) -> Column:
    """A court marker at its first place with what follows, 140 characters in all; NULL where it does not stand.

    The guarded marker also looks at its surroundings: 90 characters before and
    120 after. Look-around groups capture them without consuming, so neighbouring
    occurrences keep their full context. Where ``text`` is part of a longer one, ``before``
    and ``after`` are its neighbourhood: they serve as context, but a place counts only
    if it begins in ``text``. A guarded marker must not overlap itself.
    """
    exact, rest = re.escape(marker), COURT_TAIL - len(marker)
    part = before is not None and after is not None
    if marker != guarded:
        ahead = F.concat(text, after) if part else text
        tail = none_if_empty(F.regexp_extract(ahead, f"(?s)({exact}.{{0,{rest}}})", 1))
        return F.when(F.locate(marker, ahead) <= F.length(text), tail) if part else tail
    whole = F.concat(before, text, after) if part else text
    # The literal comes first: the look-behind then runs only where the marker stands.
    near = f"\\A.{{0,{COURT_BEFORE - 1}}}|.{{{COURT_BEFORE}}}"
    around = rf"(?s){exact}(?<=({near}){exact})(?=(.{{0,{max(rest, COURT_AFTER)}}}))"
    places = F.arrays_zip(
        F.regexp_extract_all(whole, F.lit(around), F.lit(1)).alias("before"),
        F.regexp_extract_all(whole, F.lit(around), F.lit(2)).alias("after"),
    )
    if part:
        # As many markers begin before a border as stand whole up to one character less than a marker past it.
        def begun(border: Column) -> Column:
            return F.regexp_count(F.left(whole, border + F.lit(len(marker) - 1)), F.lit(exact))

        earlier = begun(F.length(before))
        places = F.slice(places, earlier + 1, begun(F.length(before) + F.length(text)) - earlier)
    kept = F.filter(
        places,
        lambda p: ~F.concat(p["before"], F.lit(marker), F.substring(p["after"], 1, COURT_AFTER)).rlike(reject),
    )
    return F.when(whole.contains(marker), F.concat(F.lit(marker), F.substring(F.get(kept, 0)["after"], 1, rest)))


def court_name(tail: Column, stop: str = P.COURT_TAIL_STOP, strip: str = P.LINE_PUNCTUATION) -> Column:
    """The name that a marker opens: up to a stop phrase, without punctuation around it."""
    return none_if_empty(F.substring(F.trim(F.get(F.split(tail, stop, 2), 0), F.lit(strip)), 1, 120))


def court(text: Column, markers: Sequence[str] = P.COURT_MARKERS, guarded: str = P.APPEAL_COURT,
          reject: str = P.APPEAL_CERTIFICATION, stop: str = P.COURT_TAIL_STOP,
          strip: str = P.LINE_PUNCTUATION) -> Column:
    """Evidenced court name, markers in order of precedence."""
    return F.coalesce(*[court_name(court_tail(text, m, guarded, reject), stop, strip) for m in markers])


def trusted(col: Column, pattern: str, reject_prefix: str | None = None) -> Column:
    """The value when it matches as a whole, else NULL."""
    ok = col.rlike(f"^(?:{pattern})$")
    if reject_prefix:
        ok = ok & ~col.startswith(reject_prefix)
    return F.when(ok, col)


def clamp_range(start: Column, end: Column, pages: Column, is_last: Column) -> Column:
    """(start_page, end_page, note, valid) of a declared range. The last range of a source may end one page too late:
    it is clamped and the note says so. Any other range beyond the pages is invalid."""
    over = is_last & (end == pages + 1)
    clamped = F.when(over, pages).otherwise(end)
    note = F.when(over, F.concat(F.lit("end_"), end, F.lit("_clamped_to_"), pages))
    valid = (start >= 1) & (start <= clamped) & (clamped <= pages)
    return F.struct(start.alias("start_page"), clamped.alias("end_page"), note.alias("note"), valid.alias("valid"))


def missing_fields(named: dict[str, Column]) -> Column:
    """Names of the required fields that are empty, in the order given."""
    gaps = [
        F.when(F.coalesce(F.trim(c.cast("string")), F.lit("")) == "", F.lit(name)) for name, c in named.items()
    ]
    return F.array_compact(F.array(*gaps))


def add_reasons(reasons: Column, *more: Column) -> Column:
    return F.array_sort(F.array_union(reasons, F.array_compact(F.array(*more))))


def reference(page: Column, *numbers: Column) -> Column:
    """Deed, else judgment, else lawsuit number, else the page."""
    return F.coalesce(*[none_if_empty(n.cast("string")) for n in numbers], F.concat(F.lit("p"), page.cast("string")))


def labelled_value(text: Column, label: str) -> Column:
    """Value behind ``label :`` up to the end of its line."""
    found = F.regexp_extract(text, re.escape(label) + "\\s*[:\uFF1A]?\\s*([^\\n]+)", 1)
    return none_if_empty(collapse(found))


def page_metadata(text: Column, lines: Column) -> dict[str, Column]:
    """Fields of one normalised page. ``lines`` are the page's normalised lines."""
    return {
        "deed_number": first_match(text, P.DEED),
        "judgment_number": first_match(text, P.JUDGMENT),
        "lawsuit_number": first_match(text, P.LAWSUIT),
        "decision_date": first_match(text, P.HIJRI_DATE),
        "court": F.coalesce(court(text), field_line(lines, "محكمة", require=P.COURT_LINE_MARKERS)),
        "circuit": field_line(lines, "الدائرة"),
        "subject": title(lines),
    }
