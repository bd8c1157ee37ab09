from __future__ import annotations

import pytest

EDGE = "doc_id bigint, text string, lang string, source string, n_chars bigint, count bigint, n bigint, block string, leaf string, root string, gone_id bigint, best string, dropped string"


@pytest.fixture
def edge_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows, a tie, and columns with names that the operators use."""
    rest = (1, 2, "x", "y", "z", 3, "b", "d")
    texts = [
        (1, "The cat sat on the mat and looked at the rain all day.\nIt was 7 o'clock.", "en", "a"),
        (1, "The cat sat on the mat and looked at the rain all day.\nIt was 7 o'clock.", "en", "a"),
        (2, "", "en", None),
        (3, None, None, None),
        (None, "Der Hund lief über die Straße und sah den Regen den ganzen Tag.", "de", "b"),
        (None, None, None, None),
        (4, "Der Hund lief über die Straße und sah den Regen den ganzen Tag.", "de", "b"),
        (5, "   \n\t \n", "de", "http://User@Host.Example:80/path"),
        (6, "12345 67890 !!!", None, ""),
        (7, "word " * 60_000 + "\0\x1c end", "en", "a"),
        (8, "x" * 300_000, "en", "a"),
    ]
    rows = [(i, t, lang, source, None if t is None else len(t), *rest) for i, t, lang, source in texts]
    rows.append((9, "all others are null here", *[None] * 11))
    return spark.createDataFrame(rows, EDGE)


@pytest.fixture
def no_docs(edge_docs):
    return edge_docs.limit(0)


@pytest.fixture(scope="session")
def prose():
    """Seeded prose of two invented languages."""
    import random

    parts = {"en": ["the", "and", "ing", "er", "th", "on", "re"], "de": ["der", "und", "sch", "ein", "ge", "ß", "ü"]}

    def make(rnd: random.Random, lang: str, words: int) -> str:
        return " ".join("".join(rnd.choice(parts[lang]) for _ in range(rnd.randint(1, 3))) for _ in range(words))

    return make
