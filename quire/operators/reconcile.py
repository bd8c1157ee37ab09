"""Reconciliation of registers that describe the same things."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.urls import host_allowed
from .keyed import CROWDED, FAN, attach, lookup, lookup_mostly_even, narrow, salt_of, spread


def known(rows: DataFrame, existing: DataFrame, key: str, ident: str, flag: str = "is_known", fan: int = FAN) -> DataFrame:
    """Flag rows whose key an existing register already holds."""
    held = narrow(existing, keys=[key]).distinct().withColumn(flag, F.lit(True))
    return lookup(rows, held, [key], [ident], "left", fan).withColumn(flag, F.coalesce(flag, F.lit(False)))


def triage(incoming: DataFrame, known_urls: DataFrame, known_hashes: DataFrame, ident: str, hosts: Sequence[str], *,
           url: str = "url", digest: str = "h", fan: int = FAN) -> DataFrame:
    """(ident, status) of each landed row in order of precedence: rejected host, known URL, duplicate payload, saved.

    After one join by URL, one grouping by payload hash says both whether the register holds a hash, whose hashes
    travel beside the rows, and which new row brought it first. Rows of a hash are spread over salts. A row
    without a hash equals no other; ``ident`` is unique and not NULL.
    """
    held = narrow(known_urls, keys=[url]).distinct().withColumn("_held", F.lit(True))
    early = F.when(~host_allowed(F.col(url), hosts), "rejected").when(F.col("_held"), "known_url")
    looked = incoming.select(ident, url, digest).join(held, url, "left").select(ident, digest, early.alias("_early"))
    laid = spread(looked, [digest], [ident], fan)
    mine = laid.select(digest, F.when(F.col("_early").isNull(), F.col(ident)).alias("_first"), salt_of([ident], fan).alias("_salt"))
    theirs = narrow(known_hashes, keys=[digest]).withColumn("_first", F.lit(None).cast(incoming.schema[ident].dataType))
    both = mine.withColumn("_known", F.lit(False)).unionByName(
        theirs.withColumn("_salt", F.lit(None).cast("int")).withColumn("_known", F.lit(True)))
    per_hash = both.groupBy(digest).agg(
        F.min("_first").alias("_first"), F.max("_known").alias("_known"), F.collect_set("_salt").alias("_salts"))
    per_hash = per_hash.withColumn("_salt", F.explode("_salts")).drop("_salts")
    late = F.when(F.col("_known") | (F.col("_first") < F.col(ident)), "duplicate").otherwise("saved")
    return laid.join(per_hash, [digest, "_salt"], "left").select(ident, F.coalesce("_early", late).alias("status"))


def exact_copies(recovered: DataFrame, current: DataFrame, keys: Sequence[str], ident: str, fan: int = FAN,
                 least: int = CROWDED) -> DataFrame:
    """Match on a composite key: unmatched rows stay, one match is a duplicate, more is an error."""
    counted = current.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("matches"), F.min(F.col(ident)).alias("current_id")
    )
    joined = lookup_mostly_even(recovered, counted, keys, [ident], fan, least)
    state = (
        F.when(F.col("matches").isNull(), "kept").when(F.col("matches") == 1, "exact_duplicate").otherwise("ambiguous_error")
    )
    return joined.withColumn("disposition", state).withColumn("matches", F.coalesce("matches", F.lit(0).cast("long")))


def waterfall(rows: DataFrame, ident: str, steps: Sequence[tuple[str, str, DataFrame]],
              payload: Sequence[str], fan: int = FAN) -> DataFrame:
    """Resolve rows by the first lookup that knows their key.

    Each step is (method, key column of ``rows``, archive keyed by that column). An
    archive contributes the number of matches and the first one; a single match
    resolves, several are ambiguous. Keys are compared as strings; NULL and empty ones
    match nothing. ``ident`` names a row; one that is NULL or occurs twice is an error.

    The keys of all steps travel tagged in one exchange. What they find meets the whole
    row in one grouping by id, and the least step that found something wins.
    """
    tags, archives = [], []
    for i, (_, key, archive) in enumerate(steps):
        tags.append(F.struct(F.lit(i).alias("_step"), F.coalesce(F.col(key).cast("string"), F.lit("")).alias("_key")))
        held = archive.select(F.lit(i).alias("_step"), F.col(key).cast("string").alias("_key"), F.struct(*payload).alias("_hit"))
        archives.append(held.filter(F.col("_key") != ""))
    wanted = F.filter(F.array(*tags), lambda t: t["_key"] != "")
    keys = rows.select(F.col(ident).alias("_id"), F.inline(wanted))
    table = reduce(DataFrame.unionByName, archives).groupBy("_step", "_key").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_hit").alias("_hit"))
    found = lookup(keys, table, ["_step", "_key"], ["_id"], "inner", fan).select("_id", F.struct("_step", "_n", "_hit").alias("_best"))
    whole = rows.select(F.col(ident).alias("_id"), F.struct(*rows.columns).alias("_row"))
    met = found.unionByName(whole, allowMissingColumns=True).groupBy("_id")
    wrong = F.col("_id").isNull() | (F.count("_row") > 1)
    message = F.concat_ws(" ", F.lit("an id is NULL or occurs twice:"), F.col("_id").cast("string"))
    row_type = whole.schema["_row"].dataType
    best = met.agg(
        F.when(wrong, F.raise_error(message).cast(row_type)).otherwise(F.first("_row", ignorenulls=True)).alias("_row"),
        F.min("_best").alias("_best"))
    count = F.coalesce(F.col("_best._n"), F.lit(0))
    methods = F.array(*[F.lit(name) for name, _, _ in steps])
    resolved = best.select(
        "_row.*", count.cast("long").alias("match_count"),
        F.coalesce(F.get(methods, F.col("_best._step")), F.lit("")).alias("match_method"), "_best")
    for name in payload:
        resolved = resolved.withColumn(name, F.when(F.col("match_count") == 1, F.col("_best._hit")[name]))
    return resolved.drop("_best")


def declared_against_physical(declared: DataFrame, physical: DataFrame, ident: str, name: str, checksum: str,
                              fan: int = FAN) -> DataFrame:
    """State of each declared original against the files of its name.

    An exact copy is an equi join on (name, checksum); the number of files of the name
    is a second one. No candidate array is built.
    """
    exact = physical.groupBy(name, checksum).agg(F.lit(True).alias("_exact"))
    named = physical.groupBy(name).agg(F.count(F.lit(1)).alias("physical_candidates"))
    joined = lookup(declared, exact, [name, checksum], [ident], "left", fan)
    joined = lookup(joined, named, [name], [ident], "left", fan)
    state = (
        F.when(F.col("_exact"), "stored_checksum_match")
        .when(F.col("physical_candidates") > 0, "same_name_checksum_mismatch")
        .otherwise("declared_original_not_physically_present")
    )
    return joined.withColumn("reconciliation_status", state).withColumn(
        "physical_candidates", F.coalesce("physical_candidates", F.lit(0).cast("long"))
    ).drop("_exact")


def one_sided(left: DataFrame, right: DataFrame, key: str, left_label: str, right_label: str) -> DataFrame:
    """Both anti-sets of two registers, labelled."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.subtract(b).withColumn("only_in", F.lit(left_label)).unionByName(
        b.subtract(a).withColumn("only_in", F.lit(right_label)))


def hash_audit(target: DataFrame, collector: DataFrame, ident: str, agree: Sequence[str], digest: str) -> DataFrame:
    """Rows to correct, and rows that must not be corrected, with the reason."""
    other = collector.select(ident, *[F.col(c).alias(f"_c_{c}") for c in (*agree, digest)], F.lit(True).alias("_there"))
    joined = target.join(other, ident, "left")
    checks = [F.when(F.col("_there").isNull(), "missing_in_collector")]
    checks += [
        F.when(F.col("_there") & ~F.col(c).eqNullSafe(F.col(f"_c_{c}")), f"{c}_mismatch") for c in agree
    ]
    changed = ~F.col(digest).eqNullSafe(F.col(f"_c_{digest}"))
    violation = F.coalesce(*checks)
    return (
        joined.withColumn("violation", violation)
        .filter(F.col("violation").isNotNull() | changed)
        .select(ident, F.col(digest).alias("old_hash"), F.col(f"_c_{digest}").alias("new_hash"), "violation")
    )


def snapshot_diff(old: DataFrame, new: DataFrame, ident: str, stable: Sequence[str], digest: str, fan: int = FAN) -> DataFrame:
    """Row-wise difference of two versions: presence, stable fields, hash, new-hash uniqueness."""
    unique = attach(
        narrow(new, ident, keys=[digest]), [digest], [ident],
        [F.count(F.lit(1)).alias("_same")], fan,
    ).select(ident, "_same")
    a = old.select(ident, *[F.col(c).alias(f"_a_{c}") for c in (*stable, digest)], F.lit(True).alias("_old"))
    b = new.select(ident, *[F.col(c).alias(f"_b_{c}") for c in (*stable, digest)], F.lit(True).alias("_new"))
    both = a.join(b, ident, "full_outer").join(unique, ident, "left")
    equal = reduce(lambda x, y: x & y, [F.col(f"_a_{c}").eqNullSafe(F.col(f"_b_{c}")) for c in stable])
    return both.select(
        ident,
        F.when(F.col("_new").isNull(), "removed").when(F.col("_old").isNull(), "added").otherwise("present").alias("presence"),
        equal.alias("stable_fields_equal"),
        (~F.col(f"_a_{digest}").eqNullSafe(F.col(f"_b_{digest}"))).alias("hash_changed"),
        F.coalesce(F.col("_same") == 1, F.lit(True)).alias("new_hash_unique"),
    )


def enrich_with_set(rows: DataFrame, details: DataFrame, key: str, value: str, name: str, ident: str,
                    fan: int = FAN) -> DataFrame:
    """Attach the sorted distinct values of a small-domain column to each row.

    Distinct first, so an array never outgrows the column's domain.
    """
    sets = details.select(key, value).distinct().groupBy(key).agg(F.array_sort(F.collect_set(value)).alias(name))
    joined = lookup(rows, sets, [key], [ident], "left", fan)
    return joined.withColumn(name, F.coalesce(F.col(name), F.array().cast("array<string>")))


def acquisition_check(expected: DataFrame, physical: DataFrame, ident: str, name: str, digest: str, status: str,
                      wanted: str = "acquired", fan: int = FAN) -> DataFrame:
    """Each acquired source has exactly one file of its name and the file's hash is the declared one."""
    files = physical.groupBy(name).agg(F.count(F.lit(1)).alias("_paths"), F.min(digest).alias("_actual"))
    joined = lookup(expected, files, [name], [ident], "left", fan)
    verdict = (
        F.when(F.col(status) != wanted, "not_acquired")
        .when(F.col("_paths").isNull(), "no_physical_file")
        .when(F.col("_paths") > 1, "ambiguous_physical_path")
        .when(F.col("_actual") != F.col(digest), "checksum_mismatch")
        .otherwise("verified")
    )
    return joined.withColumn("verdict", verdict).drop("_paths", "_actual")


def classify_update(audit: DataFrame, target: DataFrame, ident: str, current: str, old: str, new: str) -> DataFrame:
    """One row: how many audit rows exist, still hold the old value, hold the new one, or neither."""
    joined = audit.join(target.select(ident, F.col(current).alias("_current")), ident, "left")
    there = F.col("_current").isNotNull()
    is_old, is_new = F.col("_current") == F.col(old), F.col("_current") == F.col(new)
    return joined.agg(
        F.count(F.lit(1)).alias("audit_rows"),
        F.count_if(there).alias("existing"),
        F.count_if(is_old).alias("old_match"),
        F.count_if(is_new).alias("new_match"),
        F.count_if(there & ~is_old & ~is_new).alias("unexpected"),
    )


def pairing(documents: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """One row: documents without a file, files without a document, documents with several."""
    a = documents.groupBy(key).agg(F.count(F.lit(1)).alias("_d"))
    b = files.groupBy(key).agg(F.count(F.lit(1)).alias("_f"))
    return a.join(b, key, "full_outer").agg(
        F.count_if(F.col("_f").isNull()).alias("without_file"),
        F.count_if(F.col("_d").isNull()).alias("without_document"),
        F.count_if((F.col("_d") == 1) & (F.col("_f") == 1)).alias("one_to_one"),
        F.count_if((F.col("_d") >= 1) & (F.col("_f") > 1)).alias("several_files"),
    )


def child_pages(children: DataFrame, parent: str, child: str, size: int = 100, block: int | None = None) -> DataFrame:
    """Child ids per parent in pages of ``size``, in order: no list outgrows a page."""
    from .ordered import BLOCK, in_order

    ranked = in_order(children.select(parent, child), [parent], child, position="_n", block=block or BLOCK)
    return (
        ranked.withColumn("page_no", F.expr(f"(_n - 1) div {int(size)} + 1"))
        .groupBy(parent, "page_no")
        .agg(F.count(F.lit(1)).alias("children"), F.array_sort(F.collect_list(child)).alias("child_ids"))
    )


def coverage(register: DataFrame, *parts: DataFrame, key: str) -> DataFrame:
    """Ids the register misses or the parts miss; empty when they cover each other."""
    whole = reduce(lambda a, b: a.unionByName(b), [p.select(key) for p in parts])
    return one_sided(register, whole, key, "register", "parts")

