"""Every registered query of the package on the smallest tables: its SQL where there is one, its rows else."""

from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from oracle import compare_frame, connect  # noqa: E402

from quire.llm.queries import ORACLES, QUERIES  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("key", list(QUERIES))
def test_query(spark, key):
    ok, note, rows = compare_frame(connect(SMALL), key, QUERIES[key](spark, SMALL))
    assert ok, note
    n = spark.read.parquet(f"{SMALL}/documents.parquet").count()
    if key == "op10_decontamination" or key == "pipeline":
        assert 0 < rows <= n
    elif key in ("op12_prefix_trie", "op13_spelling_variants"):
        assert note == "equal" and rows > 0
    else:
        assert rows == n


def test_only_known_queries_have_sql():
    assert set(ORACLES) <= set(QUERIES) and len([k for k in QUERIES if k.startswith("op")]) == 13 and "pipeline" in QUERIES
