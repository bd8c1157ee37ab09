"""Readers of the archive's file forms."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import collapse
from ..functions.patterns import TAG
from ..functions.urls import unescape
from ..operators.dedup import first_wins
from ..session import cut

CORRUPT = "_corrupt_record"
BLANKS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def _one_value(line: Column) -> Column:
    """Whether nothing follows the line's first JSON value: the parsers read that value and stop.

    Within brackets and within braces the line must be the only value; what closes one of them early breaks the other.
    """
    listed = F.json_array_length(F.concat(F.lit("["), line, F.lit("]"))) == 1
    named = F.size(F.json_object_keys(F.concat(F.lit('{"v":'), line, F.lit("}")))) == 1
    return F.coalesce(listed & named, F.lit(False))


def tag_lines(raw: DataFrame, value: str, schema: T.StructType, carry: Sequence[str] = ()) -> DataFrame:
    """One row a line: ``carry``, the fields, ``reason`` (NULL for a row) and the ``line`` of an error. No line is lost."""
    full = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "allowSingleQuotes": "false"}
    parsed = raw.withColumn("_row", F.from_json(F.col(value), full, options))
    line = F.trim(F.col(value), F.lit(BLANKS))
    clean = F.col(f"_row.{CORRUPT}").isNull()
    # CASE is lazy: only lines the typed parse rejects are parsed a second time.
    is_json = F.try_parse_json(F.col(value)).isNotNull() & _one_value(F.col(value))
    reason = (
        F.when(line == "", "blank_line")
        .when(line.startswith("{") & ((clean & _one_value(F.col(value))) | is_json), None)
        .when(is_json, "non_object")
        .otherwise("invalid_json")
    )
    good = F.col("reason").isNull()
    return parsed.withColumn("reason", reason).select(
        *carry, *[F.when(good, F.col(f"_row.{f.name}")).alias(f.name) for f in schema], "reason", F.when(~good, F.col(value)).alias("line"))


def parse_lines(raw: DataFrame, value: str, schema: T.StructType, carry: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Lines to rows or to error rows; no line is in both. The tagged lines are written once and read by tag."""
    tagged = cut(tag_lines(raw, value, schema, carry))
    rows = tagged.filter(F.col("reason").isNull()).select(*carry, *schema.names)
    return rows, tagged.filter(F.col("reason").isNotNull()).select(*carry, "reason", "line")


def _register_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path"))


def read_register(spark: SparkSession, path: str | list[str], schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Strict scan: each line of the register is a row or an error row with its path."""
    return parse_lines(_register_lines(spark, path), "value", schema, ["path"])


def read_lenient(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    """Bad lines are dropped; the file path stays as provenance."""
    tagged = tag_lines(_register_lines(spark, path), "value", schema, ["path"])
    return tagged.filter(F.col("reason").isNull()).select("path", *schema.names)


def with_aliases(df: DataFrame, aliases: Mapping[str, Sequence[str]]) -> DataFrame:
    """One column per logical field from the first non-empty of its names."""
    names = [F.coalesce(*[F.nullif(F.col(c).cast("string"), F.lit("")) for c in options if c in df.columns]).alias(field)
             for field, options in aliases.items() if any(c in df.columns for c in options)]
    used = {c for options in aliases.values() for c in options}
    return df.select(*[c for c in df.columns if c not in used], *names)


def union_registers(parts: Mapping[str, DataFrame], aliases: Mapping[str, Sequence[str]]) -> DataFrame:
    """Union of registers of different shape, with their name as provenance."""
    named = [with_aliases(df, aliases).withColumn("register", F.lit(name)) for name, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


def synthetic_id(given: Column, path: Column, line: Column) -> Column:
    return F.coalesce(F.nullif(given.cast("string"), F.lit("")), F.concat_ws(":", path, line.cast("string")))


def read_manifest(spark: SparkSession, path: str, fields: Sequence[str]) -> DataFrame:
    """CSV with a header, every column a string; a missing file is an empty manifest."""
    schema = T.StructType([T.StructField(f, T.StringType()) for f in fields])
    try:
        return (
            spark.read.schema(schema).option("header", True).option("multiLine", True)
            .option("escape", '"').option("enforceSchema", False).csv(path)
        )
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def list_entries(lines: DataFrame, value: str = "value") -> DataFrame:
    """Entries of a line list: no blanks, no comments, first tab field."""
    trimmed = F.trim(F.col(value))
    kept = lines.filter((trimmed != "") & ~F.ltrim(F.col(value)).startswith("#"))
    return kept.select(*[c for c in lines.columns if c != value], F.trim(F.split(trimmed, "\t")[0]).alias("entry"))


def read_list(spark: SparkSession, path: str) -> DataFrame:
    return list_entries(spark.read.text(path))


def binary_manifest(spark: SparkSession, path: str, glob: str = "*.pdf", least: int = 1024) -> DataFrame:
    """Path, name, bytes, sha256 and magic check of every original below a folder."""
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    )
    magic = F.hex(F.substring(F.col("content"), 1, 4)) == "25504446"
    return files.select(
        "path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"),
        F.sha2("content", 256).alias("sha256"), (magic & (F.col("length") >= least)).alias("is_original"),
    )


def first_by_url(sources: DataFrame, url: str, ident: str, order: str) -> DataFrame:
    """Multi-part source lists: the first row of a trimmed URL wins."""
    trimmed = sources.withColumn(url, F.trim(F.col(url)))
    return first_wins(trimmed.filter(F.col(url) != ""), url, ident, order).filter("is_first").select(ident, url)


def payload_rows(df: DataFrame, payload: str, fields: Mapping[str, str], carry: Sequence[str] = ()) -> DataFrame:
    """JSON array of objects to rows. Fields arrive as text and are cast; a bad value is NULL."""
    text = ",".join(f"`{f}`:string" for f in fields)
    rows = df.select(*carry, F.inline(F.from_json(F.col(payload), f"array<struct<{text}>>")))
    return rows.select(*carry, *[F.col(f).try_cast(kind).alias(f) for f, kind in fields.items()])


def payload_items(payloads: DataFrame, items: str, declared: str, carry: Sequence[str] = ()) -> DataFrame:
    """The items of each payload, as many as it declares. One that holds more than it declares fails the read."""
    more = F.size(items) > F.col(declared)
    whole = F.when(more, F.raise_error(F.format_string("a payload of %d items declares %d", F.size(items), declared))).otherwise(F.col(items))
    return payloads.select(*carry, F.inline(whole))


def pages_of(df: DataFrame, ident: str, text: str, count: Column, separator: str = "\f") -> DataFrame:
    """Page rows of a text: cut at the separator, truncated or padded to the page count."""
    parts = F.split(F.col(text), separator)
    padded = F.transform(F.sequence(F.lit(1), count), lambda i: F.coalesce(F.get(parts, i - 1), F.lit("")))
    return df.filter(count > 0).select(F.col(ident), F.posexplode(padded).alias("_p", "page_text")).select(
        ident, (F.col("_p") + 1).alias("page_no"), "page_text"
    )


def pages_beyond(df: DataFrame, ident: str, text: str, count: Column, separator: str = "\f") -> DataFrame:
    """The pages that ``pages_of`` leaves out because the text has more than its page count."""
    pages = df.select(F.col(ident), count.alias("_n"), F.posexplode(F.split(F.col(text), separator)).alias("_p", "page_text"))
    past = F.coalesce(F.col("_p") >= F.col("_n"), F.lit(True))
    return pages.filter(past).select(ident, (F.col("_p") + 1).alias("page_no"), "page_text")


# --- fixed values: markup of the channel preview pages ------------------------
MESSAGE = (
    r'(?s)(<div class="tgme_widget_message[^>]*?data-post="[^"?#]+(?:[^>]*)>'
    r'.*?)(?=<div class="tgme_widget_message_wrap|</body>)'
)
MESSAGE_POST = r'(?s)^<div class="tgme_widget_message[^>]*?data-post="([^"?#]+)'
MESSAGE_DOCUMENT = (
    r'(?s)(<a class="tgme_widget_message_document_wrap" href="[^"]+"[^>]*>.*?'
    r'<div class="tgme_widget_message_document_title[^>]*>.*?</div>\s*'
    r'<div class="tgme_widget_message_document_extra[^>]*>.*?</div>)'
)
DOCUMENT_URL = r'(?s)^<a class="tgme_widget_message_document_wrap" href="([^"]+)"'
DOCUMENT_TITLE = r'(?s)tgme_widget_message_document_title[^>]*>(.*?)</div>'
DOCUMENT_SIZE = r'(?s)tgme_widget_message_document_extra[^>]*>(.*?)</div>'
MESSAGE_TIME = r'(?s)<time datetime="([^"]+)"'
FORWARD_URL = r'(?s)tgme_widget_message_forwarded_from_name[^>]*>.*?<a href="([^"]+)"[^>]*>'
FORWARD_NAME = r'(?s)tgme_widget_message_forwarded_from_name[^>]*>.*?<a href="[^"]+"[^>]*>\s*(.*?)\s*</a>'
MESSAGE_ID = r'data-post="[^"/]+/(\d+)"'


def explode_blocks(pages: DataFrame, ident: str, html: str, block: str, fields: Mapping[str, str]) -> DataFrame:
    """Repeated blocks of a page, one row each, with one pattern per field."""
    found = F.regexp_extract_all(F.col(html), F.lit(block), F.lit(0))
    rows = pages.select(F.col(ident), F.posexplode(found).alias("block_no", "_b"))
    return rows.select(ident, "block_no", *[F.regexp_extract("_b", p, 1).alias(n) for n, p in fields.items()])


def _clean(col: Column) -> Column:
    return collapse(unescape(F.regexp_replace(col, TAG, "")))


def parse_messages(pages: DataFrame, ident: str, html: str) -> DataFrame:
    """Attachments of preview pages: page → message blocks → documents."""
    blocks = pages.select(F.col(ident), F.explode(F.regexp_extract_all(F.col(html), F.lit(MESSAGE), F.lit(1))).alias("_m"))
    post = F.regexp_extract(F.regexp_extract("_m", MESSAGE_POST, 1), r"/(\d+)$", 1)
    numbered = blocks.withColumn("post_id", F.nullif(post, F.lit("")).cast("long")).filter(F.col("post_id").isNotNull())
    documents = numbered.select(
        ident, "post_id", "_m",
        F.posexplode(F.regexp_extract_all("_m", F.lit(MESSAGE_DOCUMENT), F.lit(1))).alias("document_no", "_d"),
    )
    return documents.select(
        ident, "post_id", "document_no",
        unescape(F.regexp_extract("_d", DOCUMENT_URL, 1)).alias("post_url"),
        _clean(F.regexp_extract("_d", DOCUMENT_TITLE, 1)).alias("filename"),
        _clean(F.regexp_extract("_d", DOCUMENT_SIZE, 1)).alias("display_size"),
        F.regexp_extract("_m", MESSAGE_TIME, 1).alias("posted_at"),
        _clean(F.regexp_extract("_m", FORWARD_NAME, 1)).alias("forwarded_from_name"),
        unescape(F.regexp_extract("_m", FORWARD_URL, 1)).alias("forwarded_from_url"),
    )


def numbers_on_page(html: Column, pattern: str = MESSAGE_ID) -> Column:
    """Every distinct number the pattern captures on a page, ascending."""
    found = F.regexp_extract_all(html, F.lit(pattern), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: x.cast("long"))))
