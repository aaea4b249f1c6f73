"""Keeps the counts that the naive-Bayes ranker is fitted on up to date while reviews stream in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillrank.stored import file_system, remove

KEYS = ("project", "reviewer_id", "owner_id", "sub_project")


def review_counts(rows: DataFrame) -> DataFrame:
    """project, reviewer_id, owner_id, sub_project, n of streaming or stored reviews (KEYS)."""
    return rows.groupBy(*KEYS).agg(F.count("*").alias("n"))


def _epochs(spark: SparkSession, folder: str) -> list[int]:
    """Versions that are written whole."""
    files, place = file_system(spark, folder)
    names = [s.getPath().getName() for s in files.listStatus(place)] if files.exists(place) else []
    found = [n for n in names if n.startswith("epoch=") and files.exists(file_system(spark, f"{folder}/{n}/_SUCCESS")[1])]
    return sorted(int(n.removeprefix("epoch=")) for n in found)


def start_refresh(reviews: DataFrame, folder: str, checkpoint: str, keep: int = 2) -> StreamingQuery:
    """Count a stream of reviews. Each micro-batch writes a whole new version to ``folder``, which ``latest_counts`` reads; a batch that runs again writes its version again. The newest ``keep`` versions stay, for those who are reading them."""

    def write_version(counts: DataFrame, epoch: int) -> None:
        counts.write.mode("overwrite").parquet(f"{folder}/epoch={epoch}")
        for old in _epochs(counts.sparkSession, folder)[:-keep]:
            remove(counts.sparkSession, f"{folder}/epoch={old}")

    return review_counts(reviews).writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(write_version).trigger(availableNow=True).start()


def latest_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The counts of the newest version that is whole."""
    return spark.read.parquet(f"{folder}/epoch={_epochs(spark, folder)[-1]}")
