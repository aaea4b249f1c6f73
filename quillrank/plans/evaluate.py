"""Walk-forward evaluation: rank reviewers for past pull requests from what was known before, and see who did review."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.operators.path_blocks import rank_paths_in_blocks
from quillrank.operators.rank_nb import fit_nb, fold_cutoffs, fold_targets, rank_nb
from quillrank.operators.relational import newest_first, sized
from quillrank.schema import History

TOPS = (1, 3, 5, 10)
#: name: (ranker, sub-projects in use, inactive reviewers demoted)
VARIANTS = {"v1": ("paths", False, False), "v2": ("paths", True, True), "v3": ("nb", False, True), "v4": ("nb", True, True)}


def path_targets(history: History) -> DataFrame:
    """target_id, project, rk: targets of the path ranker, from the newest back until fewer than an 11th of the project is left."""
    placed = sized(newest_first(history.pull_requests))
    return placed.where("n - rk >= n div 11").select(F.col("id").alias("target_id"), "project", "rk")


def first_hits(ranking: DataFrame, targets: DataFrame, history: History) -> DataFrame:
    """target_id, project, first_hit: the best rank of an actual reviewer, null if none is ranked."""
    actual = history.reviews.select(F.col("pr_id").alias("target_id"), "reviewer_id")
    hits = ranking.join(actual, ["target_id", "reviewer_id"]).groupBy("target_id").agg(F.min("rank").alias("first_hit"))
    return targets.select("target_id", "project").join(hits, "target_id", "left")


def metrics(hits: DataFrame, tops: tuple[int, ...] = TOPS) -> DataFrame:
    """For each project: n_targets, the share (in %) of targets with a hit in the first k, and the mean reciprocal rank."""
    shares = [F.round(F.avg(F.when(F.col("first_hit") <= k, 100.0).otherwise(0.0)), 6).alias(f"top_{k}") for k in tops]
    return hits.groupBy("project").agg(F.count("*").alias("n_targets"), *shares, F.round(F.avg(F.coalesce(1.0 / F.col("first_hit"), F.lit(0.0))), 6).alias("mrr"))


def evaluate(history: History, variant: str, months: int = 12) -> DataFrame:
    ranker, use_sub_project, demote = VARIANTS[variant]
    # Of each target, only the places of those who did review count.
    asked, window = history.reviews.select(F.col("pr_id").alias("target_id"), "reviewer_id"), months if demote else None
    if ranker == "paths":
        targets = path_targets(history)
        ranking = rank_paths_in_blocks(targets, history, use_sub_project, window, asked=asked)
    else:
        targets = fold_targets(history)
        ranking = rank_nb(fit_nb(history, fold_cutoffs(history), use_sub_project), targets, history, window, asked=asked)
    return metrics(first_hits(ranking, targets, history))
