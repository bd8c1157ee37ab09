"""Deterministic identifiers."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import collapse, sha256


def stable_id(namespace: str, kind: str, value: Column) -> Column:
    """RFC 4122 version 5 id of ``kind:value``, computed in the JVM."""
    space = uuid.UUID(namespace).hex
    name = F.encode(F.concat(F.lit(f"{kind}:"), value.cast("string")), "UTF-8")
    digest = F.sha1(F.concat(F.unhex(F.lit(space)), name))
    variant = F.substring(F.lit("89ab"), F.conv(digest.substr(17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat(
        digest.substr(1, 8), F.lit("-"), digest.substr(9, 4), F.lit("-5"), digest.substr(14, 3),
        F.lit("-"), variant, digest.substr(18, 3), F.lit("-"), digest.substr(21, 12),
    )


def fingerprint(*cols: Column) -> Column:
    """Hash of the joined metadata; a missing part counts as empty, not as absent."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in cols]
    return sha256(collapse(F.concat_ws("|", *parts)))


def slug(col: Column, limit: int | None = None) -> Column:
    safe = F.regexp_replace(col, "[^A-Za-z0-9_-]", "-")
    return F.substring(safe, 1, limit) if limit else safe


def record_id(year: Column, volume: Column, page: Column, reference: Column) -> Column:
    return slug(
        F.concat(
            F.lit("collector-"), F.coalesce(year.cast("string"), F.lit("na")),
            F.lit("-v"), F.coalesce(volume.cast("string"), F.lit("na")),
            F.lit("-p"), page.cast("string"), F.lit("-"), reference.cast("string"),
        )
    )


def digits_only(col: Column) -> Column:
    """Arabic-Indic digits stay as they are; everything that is no digit goes."""
    return F.regexp_replace(F.coalesce(col, F.lit("")), r"[^\p{Nd}]", "")
