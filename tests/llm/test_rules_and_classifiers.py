"""Quality rules, quality classifier and toxicity: counts against brute force, verdicts against held-out labels, odd inputs."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from small_data import DATA

from quillrank.llm import queries as Q
from quillrank.llm.quality_qda import FLOOR, TEMPERATURE, TO_DIAGONAL, TO_POOLED, fold, score_quality
from quillrank.llm.quality_trees import MONOTONE, grow, quality_rules
from quillrank.llm.statistics import document_statistics
from quillrank.llm.tables import read
from quillrank.llm.toxicity_knn import BLOCK, COMMON, EVIDENCE, build_index, score_toxicity, without_toxic

from llm_words import BIG, words
from plain import plain_toxicity


def counts(text: str | None) -> tuple:
    w = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def check_counts(rows, texts) -> None:
    for r in rows:
        expected = counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == expected, r.doc_id
        assert r.base_failed == (expected[0] < 20 or 100 * expected[4] > 30 * expected[0])
        assert not (r.base_failed and r.kept)


def test_rules_count_as_brute_force(spark):
    texts = {r.doc_id: r.text for r in read(spark, DATA, "documents").collect()}
    rows = Q.op1_quality_rules(spark, DATA).collect()
    assert {r.doc_id for r in rows} == set(texts)
    check_counts(rows, texts)


def test_rules_on_odd_rows(odd, spark):
    no_labels = spark.createDataFrame([], "doc_id long, label int")
    rows = quality_rules(odd, no_labels).collect()
    assert len(rows) == odd.count() and all(r.score is None for r in rows)
    check_counts([r for r in rows if r.doc_id], {r.doc_id: r.text for r in odd.collect() if r.doc_id})
    assert quality_rules(odd.limit(0), no_labels).count() == 0


def test_trees_keep_their_directions():
    rng = np.random.default_rng(1)
    x = rng.random((600, len(MONOTONE)))
    y = (x[:, 0] + 0.5 * rng.random(600) > 0.8).astype(float)
    forest = grow(x, y, trees=30)
    for f, sign in enumerate(MONOTONE):
        if sign:
            grid = np.repeat(x[:50, None, :], 12, axis=1)
            grid[:, :, f] = np.linspace(0, 1, 12)
            scores = forest.score(grid.reshape(-1, x.shape[1])).reshape(50, 12)
            assert (np.diff(scores, axis=1) * sign >= -1e-12).all()
    assert ((forest.score(x) >= 0.5) == (y == 1)).mean() > 0.9


def held_out_auc(spark, query, column: str) -> float:
    scored = query(spark, BIG).where("held_out").join(read(spark, BIG, "labels").select("doc_id", column), "doc_id").collect()
    ones, zeros = [r.score for r in scored if r[column] == 1], [r.score for r in scored if r[column] == 0]
    return float(np.mean([(a > b) + 0.5 * (a == b) for a in ones for b in zeros]))


def test_trees_on_held_out_labels(spark):
    """Labels of two folds out of three are learnt; and flat trees score as walks from their roots."""
    docs, labels = read(spark, BIG, "documents"), read(spark, BIG, "labels").selectExpr("doc_id", "quality as label")
    scored = quality_rules(docs, labels.where(fold(F.col("doc_id"), 3) != 1)).where(fold(F.col("doc_id"), 3) == 1).join(labels, "doc_id").collect()
    ones, zeros = [r.score for r in scored if r.label == 1], [r.score for r in scored if r.label == 0]
    assert np.mean([(a > b) + 0.5 * (a == b) for a in ones for b in zeros]) > 0.9
    rng = np.random.default_rng(6)
    x = rng.random((300, len(MONOTONE)))
    forest = grow(x, (x[:, 1] + x[:, 2] > 1).astype(float), trees=8)

    def walked(row):
        total = forest.base
        for at in forest.roots.tolist():
            for _ in range(forest.depth):
                at = forest.left[at] if row[forest.feature[at]] <= forest.threshold[at] else forest.right[at]
            total += forest.value[at]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(forest.score(x), [walked(row) for row in x])


def test_quality_on_held_out_labels(spark):
    assert held_out_auc(spark, Q.op2_quality_classifier, "quality") > 0.9


def test_quality_as_densities_written_out(spark):
    """Log densities of the shrunk normal distributions, by determinants and solved equations."""
    docs, labels = read(spark, DATA, "documents"), read(spark, DATA, "labels").selectExpr("doc_id", "quality as label")
    shares = {r.doc_id: np.sqrt(np.maximum(r.shares, 0)) for r in document_statistics(docs).select("doc_id", "shares").collect()}
    known = [(shares[r.doc_id], r.label) for r in labels.collect() if r.doc_id in shares]
    by_class = [np.array([x for x, y in known if y == k]) for k in (0, 1)]
    own = [np.cov(x.T, bias=True) for x in by_class]
    pooled = sum(len(x) * c for x, c in zip(by_class, own, strict=True)) / len(known)
    log = []
    for x, c in zip(by_class, own, strict=True):
        c = (1 - TO_POOLED) * c + TO_POOLED * pooled
        c = (1 - TO_DIAGONAL) * c + TO_DIAGONAL * np.diag(np.diag(c)) + FLOOR * np.eye(len(c))
        log.append(lambda z, m=x.mean(axis=0), c=c, n=len(x): np.log(n / len(known)) - (np.linalg.slogdet(c)[1] + (z - m) @ np.linalg.solve(c, z - m)) / 2)
    for r in score_quality(docs, labels).collect():
        z = shares[r.doc_id]
        assert r.score == pytest.approx(1 / (1 + np.exp(np.clip((log[0](z) - log[1](z)) / TEMPERATURE, -500, 500))), abs=1e-7)


def test_toxicity_on_held_out_labels(spark):
    assert held_out_auc(spark, Q.op10_toxicity, "toxic") > 0.95


@pytest.mark.parametrize("scorer", [score_quality, score_toxicity])
def test_scores_of_odd_rows(odd, spark, scorer):
    known = spark.createDataFrame([(4, 1), (5, 0), (6, 0), (7, 1), (99, 1), (None, 1), (3, None)], "doc_id long, label int")
    rows = scorer(odd, known).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert len({round(r.score, 9) for r in rows if r.doc_id == 4}) == 1
    assert scorer(odd.limit(0), known).count() == 0
    assert scorer(odd, known.limit(0)).count() == odd.count()


def test_nearest_examples_are_exact():
    """Over several blocks, with common and rare terms."""
    rng = np.random.default_rng(2)
    n, n_terms = 5 * BLOCK + 7, 3 * COMMON
    there = rng.random((n, n_terms)) < 0.4 * rng.random(n_terms) ** 4
    doc, term = np.nonzero(there)
    times = rng.integers(1, 5, len(doc))
    weight, names = rng.random(n_terms) + 0.1, rng.integers(1, 2**63, n_terms).astype(np.uint64)
    index = build_index(doc, term, times, np.arange(n), np.arange(n) % 2, weight, (1.0, 1.0), names)
    flat = np.zeros((n, n_terms))
    flat[doc, term] = (1 + np.log(times)) * weight[term]
    flat /= np.maximum(np.sqrt((flat**2).sum(axis=1, keepdims=True)), 1e-300)
    found, cosine = index.nearest(doc, term, index.unit(doc, term, times, n), n, 10)
    exact = flat @ flat.T
    assert np.allclose(cosine, -np.sort(-exact, axis=1)[:, :10])
    assert np.allclose(np.take_along_axis(exact, index.example[found], 1), cosine)


def test_toxicity_as_brute_force(spark):
    """Scores and evidence from plain cosines of whole texts."""
    docs = read(spark, DATA, "documents")
    labels = read(spark, DATA, "labels")
    expected = plain_toxicity([(r.doc_id, r.text) for r in docs.collect()], {r.doc_id: r.toxic for r in labels.collect()})
    for r in score_toxicity(docs, labels.selectExpr("doc_id", "toxic as label")).collect():
        score, near = expected[r.doc_id]
        assert r.score == pytest.approx(score, abs=1e-9), r.doc_id
        assert [e.cosine for e in r.evidence] == pytest.approx(near[:EVIDENCE], abs=1e-9)


def test_toxic_documents_go_and_others_stay(spark):
    docs = read(spark, BIG, "documents")
    labels = read(spark, BIG, "labels").selectExpr("doc_id", "toxic as label")
    kept = without_toxic(docs, labels)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    found = [(r.label, r.doc_id in ids) for r in labels.collect()]
    assert np.mean([not k for y, k in found if y == 1]) > 0.95
    assert np.mean([k for y, k in found if y == 0]) > 0.98
