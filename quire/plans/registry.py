"""Registry of named plans."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..session import table


@dataclass(frozen=True)
class Tables:
    """The given tables of one folder; each is read in full."""

    spark: SparkSession
    folder: str

    def __call__(self, name: str) -> DataFrame:
        return table(self.spark, self.folder, name)


@dataclass(frozen=True)
class Plan:
    key: str
    build: Callable[[Tables], DataFrame]
    sql: str | None


PLANS: dict[str, Plan] = {}


def plan(key: str, sql: str | None = None):
    def register(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if key in PLANS:
            raise ValueError(f"plan {key} is registered twice")
        PLANS[key] = Plan(key, build, sql)
        return build

    return register


# Pieces shared by the oracle texts. RE2 has no Unicode white space class of its own.
SPACE = r"[\s\v\x{1C}-\x{1F}\x{85}\p{Z}]+"


def sql_norm(expr: str, tatweel: str = " ") -> str:
    """The normaliser without composition, which changes none of the given texts."""
    digits = f"translate({expr}, '٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹', '01234567890123456789')"
    bidi = rf"regexp_replace({digits}, '[\x{{200E}}\x{{200F}}\x{{202A}}-\x{{202E}}\x{{2066}}-\x{{2069}}]', '', 'g')"
    marks = rf"regexp_replace({bidi}, '[\x{{610}}-\x{{61A}}\x{{64B}}-\x{{65F}}\x{{670}}\x{{6D6}}-\x{{6ED}}]', '', 'g')"
    return f"trim(regexp_replace(replace({marks}, 'ـ', '{tatweel}'), '{SPACE}', ' ', 'g'))"


def sql_uuid5(space: str, name: str) -> str:
    """Version 5 id of a text expression under a namespace given as hex digits."""
    h = f"sha1(unhex('{space}') || encode({name}))"
    variant = f"substr('89ab89ab89ab89ab', ('0x' || substr({h}, 17, 1))::INT + 1, 1)"
    return (
        f"substr({h},1,8)||'-'||substr({h},9,4)||'-5'||substr({h},14,3)||'-'||{variant}||substr({h},18,3)||'-'||substr({h},21,12)"
    )
