"""Rules that a history must meet before anything is learnt from it, and inserts that skip what is known."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillrank.schema import History

DEVELOPER_KEY = ("account_id", "name", "email")
PULL_REQUEST_KEY = ("project", "change_id")
PROJECT_KEY = ("name",)


def own_reviews(history: History) -> DataFrame:
    """Reviews by the pull request's own owner."""
    owned = history.pull_requests.select(F.col("id").alias("pr_id"), F.col("owner_id").alias("reviewer_id"))
    return history.reviews.join(owned, ["pr_id", "reviewer_id"], "left_semi")


def without_owner(history: History) -> History:
    """Nobody reviews a change of their own."""
    owned = history.pull_requests.select(F.col("id").alias("pr_id"), F.col("owner_id").alias("reviewer_id"))
    return replace(history, reviews=history.reviews.join(owned, ["pr_id", "reviewer_id"], "left_anti"))


def rejected(history: History) -> DataFrame:
    """Pull requests without an owner or without a review."""
    reviewed = history.reviews.select(F.col("pr_id").alias("id"))
    return history.pull_requests.where("owner_id is null").union(history.pull_requests.where("owner_id is not null").join(reviewed, "id", "left_anti"))


def keep_reviewed(history: History) -> History:
    """Drop pull requests without an owner or a review, and what hangs on them."""
    kept = history.pull_requests.where("owner_id is not null").join(history.reviews.select(F.col("pr_id").alias("id")), "id", "left_semi")
    ids = kept.select(F.col("id").alias("pr_id"))
    return replace(history, pull_requests=kept, reviews=history.reviews.join(ids, "pr_id", "left_semi"), file_paths=history.file_paths.join(ids, "pr_id", "left_semi"))


def cleaned(history: History) -> History:
    """``without_owner`` and then ``keep_reviewed``, with each table joined once."""
    owned = history.pull_requests.where("owner_id is not null")
    owners = owned.select(F.col("id").alias("pr_id"), "owner_id")
    reviews = history.reviews.join(owners, "pr_id").where("not reviewer_id <=> owner_id").select(*history.reviews.columns)
    kept = reviews.select("pr_id").distinct()
    pull_requests = owned.join(kept.withColumnRenamed("pr_id", "id"), "id", "left_semi")
    return replace(history, pull_requests=pull_requests, reviews=reviews, file_paths=history.file_paths.join(kept, "pr_id", "left_semi"))


def without_bots(people: DataFrame, name: str = "name") -> DataFrame:
    """People whose name holds ``bot`` (in lower case) are programs; a null name is nobody's."""
    return people.where(~F.coalesce(F.col(name).contains("bot"), F.lit(False)))


def is_positive(vote: Column) -> Column:
    return F.coalesce(vote > 0, F.lit(False))


def insert_if_absent(existing: DataFrame, new: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """The rows of ``new`` to append: those whose key, nulls included, is not there yet, one for each key."""
    fresh = new.dropDuplicates(list(key)).alias("n")
    same = [F.col(f"n.{c}").eqNullSafe(F.col(f"e.{c}")) for c in key]
    found = existing.select(*key).alias("e")
    condition = same[0]
    for c in same[1:]:
        condition = condition & c
    return fresh.join(found, condition, "left_anti")
