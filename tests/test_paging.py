"""Paging of a feed: every reason to stop, against the loop it states."""

import random

import pytest

from quire.functions import patterns as P
from quire.streaming.paging import listed_posts, paging_stops

SCHEMA = "channel string, page long, post long"


def loop(pages, edge):
    """Ask for one page after the other until a reason to stop."""
    before, seen, read = None, set(), 0
    for page in sorted(pages):
        posts = [p for p in pages[page] if p is not None]
        read += 1
        if edge is not None and posts and max(posts) <= edge:
            return page, P.STOP_KNOWN, read
        if not posts:
            return page, P.STOP_EMPTY, read
        if min(posts) in seen:
            return page, P.STOP_REPEATED, read
        if before is not None and min(posts) >= before:
            return page, P.STOP_NOT_FALLING, read
        seen.add(min(posts))
        before = min(posts)
    return max(pages), P.STOP_NO_MORE, read


def check(spark, feeds, edges, block):
    rows = [(c, page, post) for c, pages in feeds.items() for page, posts in pages.items() for post in posts]
    known = spark.createDataFrame(list(edges.items()), "channel string, edge long")
    pages = spark.createDataFrame(rows + [(None, 1, 5), ("a", None, 5)], SCHEMA)
    stops = paging_stops(pages, "channel", "page", "post", known, block=block)
    got = {r["channel"]: (r["stop_page"], r["stopped_reason"], r["pages"]) for r in stops.collect()}
    assert got == {c: loop(p, edges.get(c)) for c, p in feeds.items()}
    listed = {(r["channel"], r["post"]): r["first_page"] for r in listed_posts(pages, stops, "channel", "page", "post").collect()}
    want = {}
    for c, page, post in sorted(rows, key=lambda r: r[1]):
        if post is not None and page <= got[c][0]:
            want.setdefault((c, post), page)
    assert listed == want
    return {reason for _, reason, _ in got.values()}


def test_each_reason(spark):
    feeds = {
        "a": {1: [30, 31, 31], 2: [20, 21], 3: [10, 11]},
        "b": {1: [30, 31], 2: [None], 3: [10]},
        "c": {1: [30, 31], 2: [20, 22], 3: [30, 33], 4: [1]},
        "d": {1: [30, 31], 2: [20, 22], 3: [25, 26], 4: [1]},
        "e": {1: [30, 31], 2: [20, 22], 3: [10, 12], 4: [1]},
        "f": {1: [5]},
        "g": {4: [9], 5: [9]},
    }
    assert check(spark, feeds, {"e": 15, "f": 5, "a": 0}, 100) == {P.STOP_NO_MORE, P.STOP_EMPTY, P.STOP_REPEATED, P.STOP_NOT_FALLING, P.STOP_KNOWN}


@pytest.mark.parametrize("block", [3, 1000])
def test_feeds_at_random_equal_the_loop(spark, block):
    rng = random.Random(block)
    feeds, edges = {}, {}
    for i in range(60):
        top, pages = 400, {}
        for page in range(1, rng.randrange(2, 14)):
            top -= rng.choice([3, 5, 8, 0]) if rng.random() < 0.9 else -12
            pages[page] = [None] if rng.random() < 0.04 else [top + rng.randrange(3) for _ in range(rng.randrange(1, 4))]
        feeds[f"c{i}"] = pages
        if rng.random() < 0.4:
            edges[f"c{i}"] = rng.randrange(350, 400)
    assert len(check(spark, feeds, edges, block)) == 5


def test_no_pages(spark):
    pages = spark.createDataFrame([], SCHEMA)
    stops = paging_stops(pages, "channel", "page", "post")
    assert stops.collect() == [] and listed_posts(pages, stops, "channel", "page", "post").collect() == []
