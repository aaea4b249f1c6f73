"""How alike paths are: hand-made cases and properties."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillrank.functions import paths as P

PARTS = {"": [""], "/": [], "///": [], "/a": ["", "a"], "a/b/": ["a", "b"], "a/b/c": ["a", "b", "c"], "a//b": ["a", "", "b"]}
COMMON = [
    ("a/b/c", "a/b/d/e", (2, 0, 2, 2)),
    ("a/b/c/d", "z/b/c/q", (0, 0, 2, 2)),
    ("a/b/c/d", "z/b/q/d", (0, 1, 1, 2)),
    ("a/b", "a/b", (2, 2, 2, 2)),
    ("a", "a/b", (1, 0, 1, 1)),
    ("/", "a/b", (0, 0, 0, 0)),
    ("a/x/b", "a/y/b", (1, 1, 1, 2)),
]


def test_components(spark):
    rows = spark.createDataFrame([(p,) for p in PARTS], "p string").select("p", P.components(F.col("p")).alias("c")).collect()
    assert {r.p: r.c for r in rows} == PARTS


@pytest.mark.parametrize("a,b,expected", COMMON)
def test_common(spark, a, b, expected):
    split = spark.createDataFrame([(a, b), (b, a)], "a string, b string").select(P.components(F.col("a")).alias("a"), P.components(F.col("b")).alias("b"))
    for row in split.select(*[P.COMMON[t](F.col("a"), F.col("b")).alias(t) for t in P.TECHNIQUES]).collect():
        assert tuple(row) == expected
        assert row.prefix <= row.substring and row.suffix <= row.substring <= row.subsequence
