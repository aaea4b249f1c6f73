"""Words as contracts define them."""

from __future__ import annotations

import os
import re

#: Where tests that need many labelled rows read their tables.
BIG = os.environ.get("TEST_BIG_DIR", "/root/testdata/sf0.1")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


LONG = " ".join(f"word{i % 977} and number {i}." for i in range(60_000))
#: Nulls in every column, empty and very long texts, repeated rows and ids.
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one two"), (4, "one two"), (5, LONG), (6, LONG), (None, "no name here at all"), (None, None), (7, "Ünïcode — 日本語 текст 🎉 done."), (8, "one two", None)]
