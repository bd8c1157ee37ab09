"""Where the paging of a feed stops, and why.

A feed is paged backwards: each page lists posts, and the next one is asked for below the least of them. Reading goes on
while that least id falls. Pages arrive as rows; where each channel stops is a fold over its pages in order, here in two
levels, so that a channel with millions of pages is no task's alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..operators.ordered import BLOCK, in_order


def paging_stops(pages: DataFrame, channel: str, page: str, post: str, known: DataFrame | None = None, *,
                 block: int = BLOCK) -> DataFrame:
    """One row a channel: ``stop_page``, ``stopped_reason``, ``pages`` read and the least post asked for next.

    ``pages`` has a row per (page, post), with a NULL post for a page that lists none. ``known`` is (channel, ``edge``),
    the newest post that the inventory holds. Of the reasons that hold for a page the first of this order counts: it
    lists nothing past the edge; it lists nothing; its least id equals an earlier one; its least id has not fallen. Posts
    listed twice on a page count once. Rows without a channel or page belong to no feed and are left out.
    """
    named = pages.filter(F.col(channel).isNotNull() & F.col(page).isNotNull())
    per = named.groupBy(channel, page).agg(F.min(post).alias("_least"), F.max(post).alias("_newest"))
    looked = in_order(per, [channel], page, previous={"_before": "_least"}, block=block)
    edge = F.lit(None)
    if known is not None:
        looked, edge = looked.join(known.groupBy(channel).agg(F.max("edge").alias("_edge")), channel, "left"), F.col("_edge")
    reason = (
        F.when(F.col("_newest") <= edge, P.STOP_KNOWN)
        .when(F.col("_newest").isNull(), P.STOP_EMPTY)
        .when(F.col("_least") >= F.col("_before"), P.STOP_NOT_FALLING)
    )
    row = F.struct(F.col(page).alias("page"), reason.alias("reason"), F.col("_least").alias("least"))
    first = looked.groupBy(channel).agg(F.min(F.when(reason.isNotNull(), row)).alias("_stop"), F.max(page).alias("_last"))
    # Up to the stop the least ids fall, so one that is not new has not fallen either: only stops need the look back.
    stops = first.select(
        channel, F.coalesce("_stop.page", "_last").alias("stop_page"),
        F.coalesce("_stop.reason", F.lit(P.STOP_NO_MORE)).alias("_reason"), F.col("_stop.least").alias("_at"))
    read = per.join(stops, channel).filter(F.col(page) <= F.col("stop_page"))
    again = (F.col(page) < F.col("stop_page")) & (F.col("_least") == F.col("_at")) & (F.col("_reason") == P.STOP_NOT_FALLING)
    return read.groupBy(channel, "stop_page", "_reason").agg(
        F.count(F.lit(1)).alias("pages"), F.min("_least").alias("least_post"), F.count_if(again).alias("_again")
    ).select(channel, "stop_page", F.when(F.col("_again") > 0, P.STOP_REPEATED).otherwise(F.col("_reason")).alias("stopped_reason"),
             "pages", "least_post")


def listed_posts(pages: DataFrame, stops: DataFrame, channel: str, page: str, post: str) -> DataFrame:
    """Each post of the pages read, the last one included, with the first page that lists it."""
    read = pages.filter(F.col(post).isNotNull()).join(stops.select(channel, "stop_page"), channel)
    return read.filter(F.col(page) <= F.col("stop_page")).groupBy(channel, post).agg(F.min(page).alias("first_page"))
