"""Quality classifier: quadratic discriminant analysis with shrunk class covariances over transformed document statistics.

Class moments are summed over all labelled rows, on the executors. A score is
the difference of two log densities by Mahalanobis distance; the inverse
Cholesky factors are worked out once and kept with the model.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillrank.llm.statistics import SHARES, document_statistics
from quillrank.llm.tables import stash

#: Shares of the pooled covariance, and of its diagonal, in each class covariance.
TO_POOLED, TO_DIAGONAL = 0.3, 0.3
#: Least variance of a transformed statistic.
FLOOR = 1e-3
#: Statistics are not independent of each other and not normal, so log odds are divided by this.
TEMPERATURE = 4.0


def transform(shares: np.ndarray) -> np.ndarray:
    """Square roots, that spread small shares; every statistic is 0 or more."""
    return np.sqrt(np.maximum(shares, 0))


@dataclass
class Discriminant:
    """By class: the mean, the inverse of the covariance's Cholesky factor and the constant of the log density, prior included."""

    mean: np.ndarray
    inverse: np.ndarray
    constant: np.ndarray

    def score(self, shares: np.ndarray) -> np.ndarray:
        x = transform(shares)
        log = [c - ((x - m) @ inv.T) ** 2 @ np.ones(x.shape[1]) / 2 for m, inv, c in zip(self.mean, self.inverse, self.constant, strict=True)]
        return 1 / (1 + np.exp(np.clip((log[0] - log[1]) / TEMPERATURE, -500, 500)))


def discriminant(count: np.ndarray, total: np.ndarray, products: np.ndarray) -> Discriminant:
    """From each class's number of rows, sums and sums of products."""
    mean = total / count[:, None]
    own = products / count[:, None, None] - mean[:, :, None] * mean[:, None, :]
    pooled = np.tensordot(count, own, 1) / count.sum()
    d = total.shape[1]
    inverse, constant = [], []
    for k in range(2):
        cov = (1 - TO_POOLED) * own[k] + TO_POOLED * pooled
        cov = (1 - TO_DIAGONAL) * cov + TO_DIAGONAL * np.diag(np.diag(cov)) + FLOOR * np.eye(d)
        factor = np.linalg.cholesky(cov)
        inverse.append(np.linalg.inv(factor))
        constant.append(np.log(count[k] / count.sum()) - np.log(np.diag(factor)).sum())
    return Discriminant(mean, np.stack(inverse), np.array(constant))


def fit_discriminant(statistics: DataFrame, labels: DataFrame) -> Discriminant | None:
    """From all labelled rows (doc_id, label); None where one of the labels is missing."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = len(SHARES)
        sums = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            x = transform(batch.column("shares").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1))
            y = batch.column("label").to_numpy()
            for k in range(2):
                own = x[y == k]
                sums[k] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(sums.size)), pa.array(sums.ravel())], names=["cell", "value"])

    cells = statistics.join(known, "doc_id").select("label", "shares").mapInArrow(moments, "cell long, value double")
    found = dict(cells.groupBy("cell").agg(F.sum("value")).collect())
    d = len(SHARES)
    sums = np.array([found.get(k, 0.0) for k in range(2 * (1 + d + d * d))]).reshape(2, -1)
    if not sums[:, 0].all():
        return None
    return discriminant(sums[:, 0], sums[:, 1 : 1 + d], sums[:, 1 + d :].reshape(2, d, d))


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score every row of ``docs`` (doc_id, text), as ``labels`` (doc_id, label: 1 is good) mark it.

    Returns doc_id and score, the probability of label 1, between 0 and 1. Texts
    are read whole, however long. Null text counts as empty and is scored; rows
    with a null doc_id are scored; repeated rows score alike, so ties need no
    order; labelled rows that share a doc_id all count; without labels of both kinds every score is 0.5;
    an empty table gives no rows; other columns are ignored.
    """
    statistics = stash(document_statistics(docs).select("doc_id", "shares"), "statistics")
    model = fit_discriminant(statistics, labels)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shares = batch.column("shares").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            score = np.full(batch.num_rows, 0.5) if model is None else model.score(shares)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], names=["doc_id", "score"])

    return statistics.mapInArrow(scores, "doc_id long, score double")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; 0 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(0)).cast("int")
