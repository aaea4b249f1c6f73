"""Quality rules: gradient-boosted trees over document statistics.

Trees are grown on a bounded sample of labelled documents, with the direction
of chosen statistics fixed, and flattened into node arrays that score a whole
Arrow batch at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.llm.statistics import COUNTS, SHARES, document_statistics
from quillrank.llm.tables import stash

#: Most labelled documents that trees are grown on; they are those of the lowest hashes of doc_id.
SAMPLE = 20_000
TREES, DEPTH, RATE, BINS, LEAST_ROWS, RIDGE = 60, 3, 0.2, 32, 10, 1.0
#: More of these never makes a document better.
FALLING = ("symbols", "dup_lines", "repeat_words", "upper", "marks", "same_next", "symbol_words")
MONOTONE = tuple(-1 if s in FALLING else 0 for s in SHARES)
FEWEST_WORDS, MOST_REPEATED_PERCENT = 20, 30


@dataclass
class Forest:
    """Node k splits on feature[k] at threshold[k], into left[k] and right[k]; leaves lead to themselves. roots: a node for each tree."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1 for each row of x."""
        node = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
        return 1 / (1 + np.exp(-(self.base + self.value[node].sum(axis=1))))


def grow(x: np.ndarray, y: np.ndarray, monotone: tuple = MONOTONE, trees: int = TREES, depth: int = DEPTH) -> Forest:
    """Boosted trees for logistic loss. A split on a constrained feature must not turn the wrong way, and bounds what grows below it."""
    n, d = x.shape
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(d)]
    binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1)
    rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(rate / (1 - rate)))
    margin = np.full(n, base)
    nodes: list[list] = []
    roots = []

    def leaf(g: float, h: float, low: float, high: float) -> float:
        return float(np.clip(-g / (h + RIDGE), low, high))

    def split(rows: np.ndarray, grad: np.ndarray, hess: np.ndarray, left_depth: int, low: float, high: float) -> int:
        me, g, h = len(nodes), grad[rows].sum(), hess[rows].sum()
        nodes.append([0, 0.0, me, me, RATE * leaf(g, h, low, high)])
        best = (1e-6, -1, -1, 0.0, 0.0)
        if left_depth and len(rows) >= 2 * LEAST_ROWS:
            for f in range(d):
                size = len(edges[f]) + 1
                if size < 2:
                    continue
                b = binned[rows, f]
                gs, hs, cs = np.cumsum(np.bincount(b, grad[rows], size)), np.cumsum(np.bincount(b, hess[rows], size)), np.cumsum(np.bincount(b, minlength=size))
                gl, hl, cl = gs[:-1], hs[:-1], cs[:-1]
                wl, wr = np.clip(-gl / (hl + RIDGE), low, high), np.clip(-(g - gl) / (h - hl + RIDGE), low, high)
                gain = -(gl * wl + (hl + RIDGE) * wl**2 / 2) - ((g - gl) * wr + (h - hl + RIDGE) * wr**2 / 2)
                w = leaf(g, h, low, high)
                gain = gain + g * w + (h + RIDGE) * w**2 / 2
                gain[(cl < LEAST_ROWS) | (len(rows) - cl < LEAST_ROWS) | (monotone[f] * (wr - wl) < 0)] = -1
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (float(gain[k]), f, k, float(wl[k]), float(wr[k]))
        _, f, k, wl, wr = best
        if f >= 0:
            goes = binned[rows, f] <= k
            middle = (wl + wr) / 2
            bounds = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}[monotone[f]]
            nodes[me][0], nodes[me][1] = f, float(edges[f][k])
            nodes[me][2] = split(rows[goes], grad, hess, left_depth - 1, *bounds[0])
            nodes[me][3] = split(rows[~goes], grad, hess, left_depth - 1, *bounds[1])
        return me

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        first = len(nodes)
        roots.append(split(np.arange(n), p - y, np.maximum(p * (1 - p), 1e-6), depth, -np.inf, np.inf))
        forest = _flat(nodes, roots[-1:], 0.0, depth)
        at = np.full(n, first)
        for _ in range(depth):
            at = np.where(x[np.arange(n), forest.feature[at]] <= forest.threshold[at], forest.left[at], forest.right[at])
        margin = margin + forest.value[at]
    return _flat(nodes, roots, base, depth)


def _flat(nodes: list, roots: list, base: float, depth: int) -> Forest:
    f, t, left, right, v = (np.array(c) for c in zip(*nodes, strict=True))
    return Forest(f.astype(np.int32), t, left.astype(np.int32), right.astype(np.int32), v, np.array(roots, np.int32), base, depth)


def fit_trees(statistics: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Forest | None:
    """Trees from at most ``sample`` labelled rows (doc_id, label), or None where one of the labels is missing."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    rows = statistics.join(known, "doc_id").select("doc_id", "label", "shares").orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample).toArrow()
    y = rows.column("label").to_numpy().astype(float)
    if len(np.unique(y)) < 2:
        return None
    return grow(rows.column("shares").combine_chunks().flatten().to_numpy().reshape(len(y), -1), y)


def quality_rules(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Judge every row of ``docs`` (doc_id, text) by fixed rules and by trees learnt from ``labels`` (doc_id, label: 1 is good).

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed (under 20 words, or over 30 % of the words in
    windows of 8 that recur), kept and score (the trees' probability of label
    1). Texts are read whole, however long. Null text counts as empty and
    fails; rows with a null doc_id are judged too; repeated rows are judged
    alike; between splits of equal gain the first statistic's is taken; a score
    of exactly 0.5 is kept; without labels of both kinds the fixed
    rules decide alone and score is null; an empty table gives no rows; other
    columns are ignored.
    """
    statistics = stash(document_statistics(docs), "statistics")
    forest = fit_trees(statistics, labels, sample)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shares = batch.column("shares").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            n_words, repeated = batch.column("n_words").to_numpy(), batch.column("n_repeat_words").to_numpy()
            failed = (n_words < FEWEST_WORDS) | (100 * repeated > MOST_REPEATED_PERCENT * n_words)
            score = np.ones(batch.num_rows) if forest is None else forest.score(shares)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(batch.column(c) for c in COUNTS), pa.array(failed), pa.array(~failed & (score >= 0.5)), pa.array(score, mask=np.full(batch.num_rows, forest is None))],
                names=["doc_id", *COUNTS, "base_failed", "kept", "score"],
            )

    return statistics.mapInArrow(judge, "doc_id long, " + "".join(f"{c} long, " for c in COUNTS) + "base_failed boolean, kept boolean, score double")
