"""The nested JSON export of a project's pull requests, and its normalized tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.schema import EXPORT, History

KEY = ("accountId", "name", "email")


def read_export(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """The nested rows of a file or folder whose files have one JSON array each or, with ``lines``, an object in each line, as ``write_export`` has it. What can't be read is null."""
    return spark.read.schema(EXPORT).option("multiLine", not lines).option("mode", "PERMISSIVE").json(path)


def _id(*columns):
    """A stable id from a natural key, nulls told apart from empty strings."""
    return F.xxhash64(*[F.to_json(F.struct(F.col(c).alias("v"))) for c in columns])


def normalized(nested: DataFrame, project: str, project_url: str | None = None) -> History:
    """The five tables of an export; rows that couldn't be read, which have no change id, are left out. A developer is the same if account, name and e-mail are; a pull request if its change id is."""
    spark = nested.sparkSession
    pulls = nested.where("changeId is not null").dropDuplicates(["changeId"]).withColumn("id", F.xxhash64(F.lit(project), "changeId"))
    person = lambda p: F.xxhash64(*[F.to_json(F.struct(p[c].alias("v"))) for c in KEY])
    reviewers = pulls.select("id", F.explode("reviewers").alias("p")).where("p is not null")
    people = pulls.where("owner is not null").select(F.col("owner").alias("p")).union(reviewers.select("p"))
    developers = people.withColumn("id", person(F.col("p"))).groupBy("id").agg(F.min("p").alias("p")).select("id", F.col("p.accountId").alias("account_id"), "p.email", "p.name", "p.avatar")
    pull_requests = pulls.select(
        "id", F.lit(project).alias("project"), F.col("subProject").alias("sub_project"), F.col("changeId").alias("change_id"), F.col("changeNumber").alias("change_number"), F.col("timestamp").alias("ts"), F.when(F.col("owner").isNotNull(), person(F.col("owner"))).alias("owner_id")
    )
    reviews = reviewers.select(F.col("id").alias("pr_id"), person(F.col("p")).alias("reviewer_id")).distinct()
    file_paths = pulls.select(F.col("id").alias("pr_id"), F.explode("filePaths").alias("f")).select("pr_id", "f.location")
    return History(spark.createDataFrame([(project, project_url)], "name string, project_url string"), developers, pull_requests, reviews, file_paths)


def nested(history: History) -> DataFrame:
    """The export rows of a history, people and paths in order."""
    person = F.struct(F.col("account_id").alias("accountId"), "email", "name", "avatar")
    people = history.developers.select(F.col("id").alias("person_id"), person.alias("person"))
    reviewers = history.reviews.join(people, F.col("reviewer_id") == F.col("person_id")).groupBy("pr_id").agg(F.sort_array(F.collect_list("person")).alias("reviewers"))
    paths = history.file_paths.groupBy("pr_id").agg(F.sort_array(F.collect_list(F.struct("location"))).alias("filePaths"))
    rows = history.pull_requests.join(people.withColumnRenamed("person", "owner"), F.col("owner_id") == F.col("person_id"), "left")
    rows = rows.join(reviewers, F.col("id") == reviewers.pr_id, "left").drop("pr_id").join(paths, F.col("id") == paths.pr_id, "left")
    empty = lambda c: F.coalesce(c, F.array())
    return rows.select(
        "project", F.col("sub_project").alias("subProject"), F.col("change_id").alias("changeId"), F.col("change_number").alias("changeNumber"), F.col("ts").alias("timestamp"), "owner", empty(F.col("reviewers")).alias("reviewers"), empty(F.col("filePaths")).alias("filePaths")
    )


def write_export(history: History, path: str) -> None:
    """A folder for each project, with an object in each line."""
    nested(history).write.mode("overwrite").partitionBy("project").json(path)
