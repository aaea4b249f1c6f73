"""What happens to a ranking before it is shown."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.functions.times import months_ms
from quillrank.operators.borda import ranked
from quillrank.operators.relational import last_reviewed
from quillrank.schema import History


def with_activity(ranking: DataFrame, history: History, months: int = 12) -> DataFrame:
    """With is_active: whether the reviewer has reviewed in the target's project in the months (of 30 days) before it; both ends are open."""
    active = F.coalesce(F.col("last_ts") > F.col("target_ts") - months_ms(months), F.lit(False))
    judged = last_reviewed(ranking, history).select("target_id", "reviewer_id", active.alias("is_active"))
    return ranking.join(judged, ["target_id", "reviewer_id"], "left").withColumn("is_active", F.coalesce("is_active", F.lit(False)))


def demote_inactive(ranking: DataFrame, history: History, months: int = 12) -> DataFrame:
    """The same reviewers, active ones first; else in the same order."""
    judged = with_activity(ranking.drop("rank"), history, months)
    return ranked(judged, F.col("is_active").desc()).select("target_id", "reviewer_id", "score", "rank")


def top(ranking: DataFrame, k: int) -> DataFrame:
    return ranking.where(F.col("rank") <= k)
