"""Small tables with what goes wrong in large ones."""

from __future__ import annotations

import pytest

from llm_words import ODD

TABLE = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside, or return, as columns of the input.
CLASHING = ("score", "size", "kept", "part", "shard", "slot", "run", "label", "component_id", "n_sentences", "n_removed", "rank", "taken", "host", "place", "repeats", "kept_id", "mix", "epoch", "mix_key", "n_rows", "first_id", "c", "d", "a", "node", "class_id", "held_out", "first", "_first", "_order", "_repeats", "_mix", "_epoch")


@pytest.fixture(scope="session")
def table(spark):
    """documents of (doc_id, text) or (doc_id, text, source) rows, with more columns."""
    from pyspark.sql import functions as F

    def make(rows: list[tuple], clashing: bool = False):
        full = [(r[0], r[1], None, r[2] if len(r) > 2 else "web", None if r[1] is None else len(r[1])) for r in rows]
        out = spark.createDataFrame(full, TABLE)
        return out.select("*", *[F.lit("x").alias(c) for c in CLASHING]) if clashing else out

    return make


@pytest.fixture(scope="session")
def odd(table):
    return table(ODD, clashing=True)
