"""Rows without a doc_id in the n-gram join."""

from __future__ import annotations

from quillrank.llm.ngram_join import ngram_join


def changed(text: list[str], *at: int) -> str:
    return " ".join(f"other{i}" if i in at else w for i, w in enumerate(text))


def test_near_copies_without_an_id_join_and_bridge(table):
    plain, chain = [f"a{i}" for i in range(60)], [f"b{i}" for i in range(60)]
    rows = [(3, changed(plain)), (None, changed(plain, 59))]
    # 5 and 9 differ at both ends, and each is near the row between them only.
    rows += [(5, changed(chain, 0, 1, 2, 3)), (None, changed(chain)), (9, changed(chain, 56, 57, 58, 59))]
    found = sorted((r.doc_id or 0, r.component_id) for r in ngram_join(table(rows), n=4, percent=85).collect())
    assert found == [(0, 3), (0, 5), (3, 3), (5, 5), (9, 5)]
