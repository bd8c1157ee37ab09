"""Text normalisation, hashing and lines."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from dataclasses import dataclass
from functools import partial, reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import patterns as P


@dataclass(frozen=True)
class Profile:
    """Hashes of different profiles are not comparable: name the profile with the hash."""

    name: str
    digits: str
    bidi: str
    tatweel: str
    repair: bool = False


PROFILES = {
    "collector": Profile("collector", P.ARABIC_DIGITS + P.PERSIAN_DIGITS, P.BIDI_AND_BOM, "", repair=True),
    "deposit": Profile("deposit", P.ARABIC_DIGITS + P.PERSIAN_DIGITS, P.BIDI_AND_BOM, ""),
    "target": Profile("target", P.ARABIC_DIGITS + P.PERSIAN_DIGITS, P.BIDI, " "),
    "library": Profile("library", P.ARABIC_DIGITS, P.BIDI_AND_BOM, ""),
}
PROFILES["import"] = PROFILES["target"]

# Texts of these characters alone need no step but the white-space collapse: no digit to
# map, no mark to drop, nothing to compose. One possessive loop decides it per text.
PLAIN = r"^[\x00-\x7F\u00C0-\u00FF]*+$"
# Characters that compatibility composition never changes, alone or in sequence.
# Anything outside goes through the Arrow function; a test proves the ranges.
STABLE = (
    r"\x00-\x9F\u00A1-\u00A7\u00A9\u00AB-\u00AE\u00B0\u00B1\u00B6\u00B7\u00BB\u00BF-\u0131"
    r"\u0134-\u013E\u0141-\u0148\u014A-\u017E\u0180-\u01C3\u060C\u061B\u061F\u0621-\u063A\u0640-\u064A\u0660-\u066D"
    r"\u06F0-\u06F9\u200E\u200F\u2012-\u2016\u2018-\u2023\u202A-\u202E\u2066-\u2069\u20AC"
)
# Marks that compose with nothing, only change places among themselves, and are dropped by the
# next step of the normaliser anyway. U+0653-0655 are not among them: they compose with letters.
DROPPED = r"\u0610-\u061A\u064B-\u0652\u0656-\u065F\u0670"


def arrow_map(change: Callable[[str], str]):
    """Arrow function over strings. Built from a nested function, so it travels to the
    executors by value and they need no copy of this package."""

    def apply(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else change(v))

    return F.pandas_udf(apply, T.StringType())


_compose = arrow_map(partial(unicodedata.normalize, "NFKC"))
_fold_case = arrow_map(str.casefold)


def compose(col: Column, marks_go: bool = False) -> Column:
    """NFKC. Only texts holding a character that could change travel to Python.

    ``marks_go``: vowel marks are dropped next, so their places among each other do not matter.
    """
    stays = col.rlike(PLAIN) | col.rlike(f"^[{STABLE}{DROPPED if marks_go else ''}]*+$")
    return F.coalesce(_compose(F.when(~stays, col)), col)


def fold_case(col: Column) -> Column:
    """Full case folding. ASCII text folds in the JVM, the rest in one Arrow call."""
    return F.coalesce(_fold_case(F.when(col.rlike(r"[^\x00-\x7F]"), col)), F.lower(col))


def collapse(col: Column) -> Column:
    """Runs of white space to one blank. Single blanks, by far the most, are not rewritten."""
    return F.trim(F.regexp_replace(F.regexp_replace(col, P.WHITESPACE_NOT_BLANK, " "), "  +", " "))


def repair_glyph_order(col: Column) -> Column:
    """Undo the two visual-order faults of the printed volumes."""
    words = reduce(lambda c, fix: F.replace(c, F.lit(fix[0]), F.lit(fix[1])), P.VISUAL_ORDER_FIXES, col)
    return F.regexp_replace(words, P.ARTICLE_SWAP, "ال$1")


def _clean(col: Column, rules: Profile) -> Column:
    """Every step but the collapse; plain texts pass untouched."""
    text = F.coalesce(col, F.lit(""))
    ascii_digits = P.ASCII_DIGITS * (len(rules.digits) // 10)
    # The intersection with one range rejects most letters on the first comparison.
    marks = f"[\\u0610-\\uFEFF&&[{rules.bidi[1:-1]}{P.DIACRITICS[1:-1]}]]"
    other = F.translate(compose(text, marks_go=True), rules.digits, ascii_digits)
    other = F.replace(F.regexp_replace(other, marks, ""), F.lit(P.TATWEEL), F.lit(rules.tatweel))
    if rules.repair:
        other = repair_glyph_order(other)
    return F.when(text.rlike(PLAIN), text).otherwise(other)


def normalise(col: Column, profile: str = "collector") -> Column:
    return collapse(_clean(col, PROFILES[profile]))


def sha256(col: Column) -> Column:
    return F.sha2(F.encode(col, "UTF-8"), 256)


def never_null(col: Column) -> Column:
    """Mark a string that cannot be NULL as such.

    A join infers a NULL filter on a nullable key and pushes it below the projection,
    which would compute an expensive key a second time.
    """
    return F.coalesce(col, F.lit(""))


def text_hash(col: Column, profile: str = "collector") -> Column:
    return never_null(sha256(normalise(col, profile)))


def split_lines(col: Column) -> Column:
    return F.split(col, P.LINE_BREAK)


def lines(col: Column, profile: str = "collector") -> Column:
    """Non-empty normalised lines, in order.

    The text is composed and repaired once as a whole, then cut: a lambda cannot
    call an Arrow function. Line breaks survive every step before the collapse.
    """
    text = _clean(col, PROFILES[profile])
    return F.filter(F.transform(split_lines(text), collapse), lambda x: x != "")


def present(col: Column) -> Column:
    """True when the field holds something other than white space."""
    return F.coalesce(F.trim(col.cast("string")), F.lit("")) != ""


def none_if_empty(col: Column) -> Column:
    return F.nullif(col, F.lit(""))
