"""Ranking scores and adding up ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Scores are rounded before they are compared, so that the order of a sum decides nothing.
DIGITS = 9


def points(scores: DataFrame, *within: str) -> DataFrame:
    """Of each ballot (the columns ``within``), candidates with a positive score get n, n - 1, ... 1 points in order of score; others none and no row.

    ``scores`` has reviewer_id and score. Equal scores go by reviewer_id.
    """
    positive = scores.withColumn("score", F.round("score", DIGITS)).where("score > 0")
    ballot = Window.partitionBy(*within)
    place = F.row_number().over(ballot.orderBy(F.col("score").desc(), F.col("reviewer_id")))
    return positive.withColumn("points", (F.count("*").over(ballot) - place + 1).cast("long"))


def total(ballots: DataFrame, target: str = "target_id") -> DataFrame:
    """target_id, reviewer_id and the sum of points, as the score."""
    return ballots.groupBy(target, "reviewer_id").agg(F.sum("points").cast("double").alias("score"))


def ranked(scores: DataFrame, *first) -> DataFrame:
    """With rank, from 1, of each reviewer for a target: by the orders ``first``, then by falling score, then by id."""
    order = Window.partitionBy("target_id").orderBy(*first, F.col("score").desc(), F.col("reviewer_id"))
    return scores.withColumn("rank", F.row_number().over(order))
