"""URLs, captions, landed payloads and file names."""

from __future__ import annotations

import html
import re
from collections.abc import Sequence
from functools import partial, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .text import arrow_map

URL = r"""(?i)(https?://[^\s<>\]\["']+)"""
COMMON_ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&nbsp;", "\u00a0"),
                   ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]


def host(url: Column) -> Column:
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.rtrim(F.lower(authority), F.lit("."))


def host_matches(host_col: Column, allowed: Sequence[str]) -> Column:
    tests = [(host_col == h) | host_col.endswith("." + h) for h in allowed]
    return reduce(lambda a, b: a | b, tests)


def host_allowed(url: Column, allowed: Sequence[str] = P.COLLECTOR_HOSTS) -> Column:
    return host_matches(host(url), allowed)


def caption_urls(caption: Column) -> Column:
    found = F.regexp_extract_all(F.coalesce(caption, F.lit("")), F.lit(URL), F.lit(1))
    return F.array_sort(F.array_distinct(found))


def first_official(urls: Column, allowed: Sequence[str] = P.OFFICIAL_HOSTS) -> Column:
    def official(u: Column) -> Column:
        name = F.regexp_replace(F.lower(F.regexp_extract(u, r"^[^/]*//([^/]*)", 1)), r"^www\.", "")
        return host_matches(name, allowed)

    return F.coalesce(F.get(F.filter(urls, official), 0), F.lit(""))


def canonical_url(url: Column) -> Column:
    """Direct-download form of shared-drive links; every other link stays."""
    name = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    file_id = F.coalesce(
        F.nullif(F.regexp_extract(path, P.SHARED_FILE, 1), F.lit("")),
        F.nullif(F.regexp_extract(url, P.SHARED_ID, 1), F.lit("")),
    )
    kind = F.regexp_extract(path, P.SHARED_DOCUMENT, 1)
    doc_id = F.regexp_extract(path, P.SHARED_DOCUMENT, 2)
    export = F.when(kind == "document", "docx").when(kind == "spreadsheets", "xlsx").otherwise("pptx")
    return (
        F.when((name == "drive.google.com") & file_id.isNotNull(),
               F.concat(F.lit("https://drive.google.com/uc?export=download&id="), file_id))
        .when((name == "docs.google.com") & (kind != ""),
              F.concat(F.lit("https://docs.google.com/"), kind, F.lit("/d/"), doc_id, F.lit("/export?format="), export))
        .otherwise(url)
    )


_unescape = arrow_map(html.unescape)


def unescape(col: Column) -> Column:
    """Entities. Frequent ones are replaced in the JVM, rare and doubled ones in Arrow."""
    rare = r"&(?!(?:lt|gt|quot|nbsp|copy|middot|amp|#39|#x27);)[#A-Za-z]"
    direct = reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), COMMON_ENTITIES, col)
    return F.coalesce(_unescape(F.when(col.rlike(rare), col)), direct)


NAMED = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|([A-Za-z][A-Za-z0-9]*));")
_unescape_closed = arrow_map(partial(NAMED.sub, lambda m: m[0] if m[1] and f"{m[1]};" not in html.entities.html5 else html.unescape(m[0])))


def unescape_closed(col: Column) -> Column:
    """The entities that end in a semicolon; the standard also reads some that do not, such as ``&amp`` before a blank."""
    rare = r"&(?!(?:lt|gt|quot|nbsp|copy|middot|amp|#39|#x27);)[#A-Za-z][0-9A-Za-z]*;"
    direct = reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), COMMON_ENTITIES, col)
    return F.coalesce(_unescape_closed(F.when(col.rlike(rare), col)), direct)


def strip_tags(page: Column, filler: str = " ") -> Column:
    return F.regexp_replace(F.regexp_replace(page, P.SCRIPT_BLOCK, " "), P.TAG, filler)


def html_text(page: Column, closed: bool = False) -> Column:
    """Text of a page. ``closed``: entities count only with their semicolon."""
    return (unescape_closed if closed else unescape)(strip_tags(page))


def year_of(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, r"(14\d{2})", 1), F.lit(""))


def volume_of(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, r"volume-(\d+)", 1), F.lit("")).cast("int")


def content_route(content: Column, content_type: Column, final_url: Column) -> Column:
    """Which extractor a landed payload belongs to. Decoders themselves are out of scope."""
    kind = F.coalesce(content_type, F.lit(""))
    path = F.lower(F.regexp_extract(final_url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1))
    head = F.hex(F.substring(content, 1, 2048))
    starts = lambda signature: F.hex(F.substring(content, 1, len(signature) // 2)) == signature
    # A signature may only begin on a byte: odd positions of the hex form.
    pdf_inside = head.rlike("^(?:[0-9A-F]{2})*?25504446")
    text = F.replace(F.make_valid_utf8(content.cast("string")), F.lit("\ufffd"), F.lit(""))
    body = F.regexp_replace(text, r"^[\s]+", "")
    return (
        F.when(pdf_inside | (kind == "application/pdf") | path.endswith(".pdf"), "pdf")
        .when(starts("FFD8FF") | starts("89504E470D0A1A0A") | starts("49492A00") | starts("4D4D002A"), "image")
        .when(starts("504B0304") | path.rlike(r"\.(docx|xlsx|pptx)$"), "zip_xml")
        .when(kind.contains("html") | body.rlike(r"^(?:<!DOCTYPE|<html|<HTML)"), "html")
        .when(kind.startswith("text/") | path.rlike(r"\.(txt|csv|md)$"), "plain_text")
        .when((F.length(F.trim(F.regexp_replace(text, P.WHITESPACE, " "))) >= 250) & text.rlike(r"[\u0600-\u06FF]"),
              "utf8_binary_text")
        .otherwise("unsupported_binary")
    )
