"""Classes of near fingerprints against all pairs."""

from __future__ import annotations

import numpy as np
from small_data import DATA

from quillrank.llm import components, edit_embedding
from quillrank.llm import queries as Q
from quillrank.llm.edit_embedding import FULL, LIKENESS, fingerprint_documents, likeness, near_classes, parsed


def all_pairs(rows):
    """Pairs of places whose likeness is enough, and each place's class."""
    prints = parsed([f for _, f in rows])
    pairs = [(i, j) for i in range(len(rows)) for j in np.flatnonzero(likeness(np.broadcast_to(prints[i], (i, prints.shape[1])), prints[:i]) >= LIKENESS).tolist()]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, j in pairs:
        label[root(i)] = root(j)
    smallest = {}
    for i, (d, _) in enumerate(rows):
        smallest[root(i)] = min([x for x in (smallest.get(root(i)), d) if x is not None], default=None)
    return pairs, [smallest[root(i)] for i in range(len(rows))]


def kindred(seed: int, n: int) -> list[tuple]:
    """Texts that share their first part, so that buckets are full of strangers; of each one a near copy."""
    rng = np.random.default_rng(seed)
    text = lambda k: "".join(rng.choice(list("abcdefgh nopqrstu"), k))
    start = text(700)
    base = [start + text(800) for _ in range(n)]
    return [(i, t) for i, t in enumerate(base)] + [(1000 + i, t[:1400] + "X" + t[1401:]) for i, t in enumerate(base)]


def test_near_copies_meet_in_full_buckets(table):
    rows = kindred(5, 3 * FULL)
    prints = [(r.doc_id, r.fingerprint) for r in fingerprint_documents(table(rows)).select("doc_id", "fingerprint").collect()]
    pairs, _ = all_pairs(prints)
    assert len(pairs) > 2 * FULL
    found = {r.doc_id: r.class_id for r in near_classes(table(prints).selectExpr("doc_id", "text as fingerprint")).collect()}
    assert np.mean([found[prints[i][0]] == found[prints[j][0]] for i, j in pairs]) >= 0.98


def test_the_query_names_classes(spark):
    rows = Q.op9_edit_fingerprints(spark, DATA).collect()
    pairs, classes = all_pairs([(r.doc_id, r.fingerprint) for r in rows])
    assert pairs and np.mean([r.class_id == c for r, c in zip(rows, classes, strict=True)]) >= 0.98
    assert all(r.class_id <= r.doc_id for r in rows)


def test_rows_without_an_id_join_a_class(table):
    rows = [(None, "one and the same text"), (7, "one and the same text"), (None, "quite another one 123456"), (9, ""), (9, "another")]
    found = sorted(((r.doc_id, r.n_chars, r.class_id) for r in fingerprint_documents(table(rows)).collect()), key=str)
    assert found == sorted([(None, 21, 7), (7, 21, 7), (None, 24, None), (9, 0, 9), (9, 7, 9)], key=str)


def test_no_near_pair_that_meets_is_lost(table, monkeypatch):
    """Two families of near copies with one opening and strangers that share it: all near pairs of a bucket, in few steps, in one cell or in many."""
    made = []
    for module in (edit_embedding, components):
        monkeypatch.setattr(module, "stash", lambda df, label, own=module.stash: made.append(label) or own(df, label))
    rng = np.random.default_rng(9)
    family = [t[:k] + "X" * 40 + t[k + 40 :] for _, t in kindred(7, 2)[:2] for k in rng.integers(100, 1400, FULL).tolist()]
    rows = [*enumerate(family, 5000), *kindred(6, 2 * FULL)]
    prints = [(r.doc_id, r.fingerprint) for r in fingerprint_documents(table(rows)).select("doc_id", "fingerprint").collect()]
    pairs, _ = all_pairs(prints)
    samples, bands = edit_embedding.band_shape(len(rows), LIKENESS)
    keys = edit_embedding._bands(bands, samples)([edit_embedding._packed(f) for _, f in prints])
    meeting = [(i, j) for i, j in pairs if (keys[i] == keys[j]).any()]
    assert len(meeting) > 4 * FULL
    made.clear()
    for size in (edit_embedding.CELL_ROWS, 24):
        found = {r.doc_id: r.class_id for r in near_classes(table(prints).selectExpr("doc_id", "text as fingerprint"), size=size).collect()}
        assert all(found[prints[i][0]] == found[prints[j][0]] for i, j in meeting)
    assert len(made) <= 2 * 14


def test_cells_see_each_pair_once_and_grow_no_large_label(spark):
    rows = [(1, i, 0) for i in range(300)] + [(1, 1000 + i, 1000 + i // 2) for i in range(8)] + [(2, i, i) for i in range(60)] + [(3, i, 7) for i in range(50)]
    of_label, cells = {}, {}
    rows = [(b, b * 10_000 + n, b * 10_000 + label) for b, n, label in rows]
    for r in edit_embedding._cells(spark.createDataFrame(rows, "band long, node long, label long"), 16).selectExpr("node", "label", "inline(cells)").collect():
        of_label[r.label] = of_label.get(r.label, 0) + 1
        cells.setdefault(r.cell, []).append(r)
    seen = []
    for members in cells.values():
        for a in members:
            for b in members:
                if a.label != b.label and b.side == 1 and (a.side == 0 or (a.inner and a.node < b.node)):
                    seen.append((min(a.node, b.node), max(a.node, b.node)))
    wanted = {(m, n) for b, m, x in rows for c, n, y in rows if b == c and m < n and x != y}
    assert len(seen) == len(set(seen)) and set(seen) == wanted
    # Once each, as the others fit one chunk; a band of one label has nothing to compare.
    assert of_label[10_000] == 300 and 30_007 not in of_label
    assert max(len(m) for m in cells.values()) < 4 * 16
