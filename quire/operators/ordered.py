"""Order-dependent operators in two levels.

Rows of a key are cut into blocks of the order column. Inside a block an ordinary window
works; one row per block carries what crosses the edge. The borders come from a quantile sketch of the
order column, so a block holds about ``block`` rows however the numbers crowd. Neighbouring blocks that together
span no more than ``block`` numbers are one, as no key can have more rows there: page numbers that repeat in
every volume need no blocks. With a unique integer order a key with a third of the table is spread over all tasks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1_000_000


SKETCH = 512  # quantiles that the sketch gives
ACCURACY = 16 * SKETCH  # their ranks are right within 1 / ACCURACY of the rows


def borders(rows: DataFrame, order: str, block: int) -> DataFrame:
    """One row: least and greatest number, the borders between blocks, and into how many parts a block is still to be cut evenly.

    A border ends a block when the next one would stretch it over more than ``block`` numbers. Distances are
    doubles, as two numbers may be further apart than any long. (Written as text: one parse is cheaper than many calls.)
    """
    at = F.col(order).cast("long")
    shares = F.lit(np.arange(1, SKETCH) / SKETCH)
    sketch = rows.agg(
        F.min(at).alias("least"), F.max(at).alias("most"), F.percentile_approx(at, shares, ACCURACY).alias("q"),
        F.greatest(F.ceil(F.count(at) / block), F.lit(1)).alias("wanted"),
    )
    far = f"double(x) - double(a.start) > {block} AND a.last > a.start"
    cuts = f"""aggregate(
        array_append(filter(q, (x, i) -> (i + 1) * least(wanted, {SKETCH}) % {SKETCH} < least(wanted, {SKETCH})), most),
        named_struct('start', least, 'last', least, 'cuts', CAST(array() AS array<bigint>)),
        (a, x) -> named_struct('start', if({far}, a.last, a.start), 'last', x, 'cuts', if({far}, array_append(a.cuts, a.last), a.cuts)),
        a -> a.cuts)"""
    return sketch.select(F.expr(f"""named_struct('least', least, 'most', most, 'parts', ceil(wanted / {SKETCH}),
        'cuts', if(double(most) - double(least) < {block}, CAST(array() AS array<bigint>), {cuts}))""").alias("b"))


def with_block(rows: DataFrame, order: str, block: int) -> DataFrame:
    """Add ``_block``, the first number of the row's block, from one pass over the order column."""
    at = f"CAST(`{order}` AS bigint)"
    place = f"""aggregate(sequence(1, {SKETCH.bit_length()}), named_struct('lo', 0, 'hi', size(_borders.cuts)),
        (s, x) -> if(get(_borders.cuts, (s.lo + s.hi) div 2) <= {at},
                     named_struct('lo', int((s.lo + s.hi) div 2) + 1, 'hi', s.hi), named_struct('lo', s.lo, 'hi', int((s.lo + s.hi) div 2))),
        s -> s.lo)"""
    low, high = "coalesce(get(_borders.cuts, i - 1), _borders.least)", "coalesce(get(_borders.cuts, i), _borders.most)"
    width = f"greatest({float(block)}D, ceil((double({high}) - double({low})) / _borders.parts))"
    even = f"if(_borders.parts > 1, {low} + bigint(floor((double({at}) - double({low})) / {width})) * bigint({width}), {low})"
    start = f"if(size(_borders.cuts) = 0, 0L, coalesce(transform(array({place}), i -> {even})[0], 0L))"
    # Lambdas may not hold the subquery itself, so a column does.
    return rows.withColumn("_borders", borders(rows, order, block).scalar()).withColumn("_block", F.expr(start)).drop("_borders")


def in_order(
    rows: DataFrame,
    keys: Sequence[str],
    order: str,
    *,
    previous: Mapping[str, str] | None = None,
    following: Mapping[str, str] | None = None,
    running: Mapping[str, str] | None = None,
    position: str | None = None,
    block: int = BLOCK,
    keep_block: bool = False,
    laid: bool = False,
) -> DataFrame:
    """Add columns that look along each key in ascending ``order``.

    ``previous`` / ``following`` map a new name to the neighbour's column, ``running``
    maps a new name to a column summed up to and including the row, ``position`` names
    a 1-based rank. ``order`` is an integer, unique within the key; keys are not NULL.
    With ``keep_block`` the column ``_block`` stays: rows are laid out by key and block,
    so grouping by both and more needs no further exchange. ``laid`` says that the rows come with this column
    and layout from an earlier call, which then serves again.
    """
    previous, following, running = dict(previous or {}), dict(following or {}), dict(running or {})
    # NULLs go here rather than in a join later: both uses of the layout then share it.
    for name in dict.fromkeys([*keys, order]):
        if rows.schema[name].nullable:
            rows = rows.filter(F.col(name).isNotNull())
    if laid:
        placed = rows
    else:
        placed = with_block(rows, order, block).repartition(*keys, "_block")
    near = Window.partitionBy(*keys, "_block").orderBy(order)
    upto = near.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    far = Window.partitionBy(*keys).orderBy("_block")
    before = far.rowsBetween(Window.unboundedPreceding, -1)

    inside, edge, carry = [], [], []
    for name, col in previous.items():
        inside.append(F.lag(F.struct(F.col(col).alias("v"))).over(near).alias(f"_in_{name}"))
        edge.append(F.max_by(F.struct(F.col(col).alias("v")), order).alias(f"_edge_{name}"))
        carry.append(F.lag(f"_edge_{name}").over(far).alias(f"_out_{name}"))
    for name, col in following.items():
        inside.append(F.lead(F.struct(F.col(col).alias("v"))).over(near).alias(f"_in_{name}"))
        edge.append(F.min_by(F.struct(F.col(col).alias("v")), order).alias(f"_edge_{name}"))
        carry.append(F.lead(f"_edge_{name}").over(far).alias(f"_out_{name}"))
    sums = {**running, **({position: None} if position else {})}
    for name, col in sums.items():
        value = F.col(col) if col else F.lit(1).cast("long")
        inside.append(F.sum(value).over(upto).alias(f"_in_{name}"))
        edge.append(F.sum(value).alias(f"_edge_{name}"))
        carry.append(F.sum(f"_edge_{name}").over(before).alias(f"_out_{name}"))

    blocks = placed.groupBy(*keys, "_block").agg(*edge).select(*keys, "_block", *carry)
    joined = placed.select("*", *inside).join(blocks, [*keys, "_block"])
    results = [F.coalesce(f"_in_{n}", f"_out_{n}")["v"].alias(n) for n in (*previous, *following)]
    for name in sums:
        offset = F.coalesce(F.col(f"_out_{name}"), F.lit(0))
        results.append((F.col(f"_in_{name}") + offset).alias(name))
    columns = [c for c in rows.columns if c != "_block"] + (["_block"] if keep_block else [])
    return joined.select(*columns, *results)


def number_batches(rows: DataFrame, order: str, size: int, *, name: str = "batch", block: int = BLOCK) -> DataFrame:
    """Batches of ``size`` rows along a total order, numbered from 1."""
    ranked = in_order(rows, [], order, position="_n", block=block)
    return ranked.withColumn(name, F.expr(f"(_n - 1) div {int(size)} + 1")).drop("_n")
