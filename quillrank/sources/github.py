"""Pull requests from captured GitHub responses."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillrank.functions.times import github_millis
from quillrank.operators.cleaning import without_bots
from quillrank.schema import BAD_DATE, BAD_JSON, GITHUB_USER, MISSING_KEY, History
from quillrank.stored import written

PULL = f"id bigint, number bigint, state string, created_at string, changed_files bigint, user {GITHUB_USER}"
COMMENTS = f"array<struct<user:{GITHUB_USER}>>"
FILES = "array<struct<filename:string>>"
PER_PAGE = 30


def is_github(url: Column) -> Column:
    return F.coalesce(url.contains("github"), F.lit(False))


def is_missing(body: Column) -> Column:
    """Whether a response says that the thing isn't there."""
    return F.coalesce(F.get_json_object(body, "$.message") == "Not Found", F.lit(False))


def page(number: int) -> tuple[int, int]:
    """First row and number of rows of a page, counted from 1."""
    return (number - 1) * PER_PAGE, PER_PAGE


def until_empty(pages: DataFrame, *keys: str) -> DataFrame:
    """Of each list (``keys``), the pages (page, body) before the first one that is empty or lacking, as a reader takes them that asks for one after the other from 1."""
    full = pages.withColumn("is_empty", F.coalesce(F.regexp_like(F.trim("body"), F.lit(r"^\[\s*\]$")), F.lit(True)))
    order = Window.partitionBy(*keys).orderBy("page")
    # A page counts while all before it are there and none of them is empty.
    walked = full.withColumn("place", F.row_number().over(order)).withColumn("ended", F.max("is_empty").over(order))
    return walked.where("page = place and not ended").select(*pages.columns)


def developer(user: Column) -> Column:
    return F.struct(user["id"].cast("string").alias("accountId"), F.lit("").alias("email"), user["login"].alias("name"), user["avatar_url"].alias("avatar"))


def judged_pulls(responses: DataFrame) -> DataFrame:
    """``responses`` (body and others) with p, what could be read of the body, and cause: why it can't be imported, null if it can."""
    read = responses.withColumn("p", F.from_json("body", f"{PULL}, _unread string", {"columnNameOfCorruptRecord": "_unread"}))
    p = F.col("p")
    cause = F.when(p.isNull() | p["_unread"].isNotNull(), BAD_JSON).when(p["id"].isNull() | p["number"].isNull() | p["user"]["id"].isNull(), MISSING_KEY).when(github_millis(p["created_at"]).isNull(), BAD_DATE)
    return read.withColumn("cause", cause)


def closed_pulls(responses: DataFrame) -> DataFrame:
    """number, changeId, changeNumber, subProject, timestamp, owner of closed pull requests, from responses (body). What can't be read is left out; ``rejected_pulls`` has it."""
    return _imported(judged_pulls(responses))


def rejected_pulls(responses: DataFrame) -> DataFrame:
    """body and cause of responses that can't be imported."""
    return judged_pulls(responses).where("cause is not null").select("body", "cause")


def import_pulls(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both of them, from one pass over the responses, which is written."""
    judged = written(judged_pulls(responses), "judged-pulls")
    return _imported(judged), judged.where("cause is not null").select("body", "cause")


def _imported(judged: DataFrame) -> DataFrame:
    pull = judged.where("cause is null and p.state = 'closed'")
    return pull.select(F.col("p.number").alias("number"), F.col("p.id").cast("string").alias("changeId"), F.col("p.number").alias("changeNumber"), F.lit("").alias("subProject"), github_millis(F.col("p.created_at")).alias("timestamp"), developer(F.col("p.user")).alias("owner"))


def reviewers(comments: DataFrame, reviews: DataFrame) -> DataFrame:
    """number and reviewer: who commented on a pull request or reviewed it, without programs, from responses (number, body)."""
    found = comments.union(reviews.where(~is_missing(F.col("body"))))
    people = found.select("number", F.explode(F.from_json("body", COMMENTS)).alias("c")).where("c.user is not null").select("number", developer(F.col("c.user")).alias("reviewer"))
    return without_bots(people, "reviewer.name").distinct()


def file_paths(files: DataFrame) -> DataFrame:
    """number and location, from responses (number, page, body); an empty page ends the list."""
    return until_empty(files, "number").where(~is_missing(F.col("body"))).select("number", F.explode(F.from_json("body", FILES)).alias("f")).select("number", F.col("f.filename").alias("location"))


def without_files(files: DataFrame) -> DataFrame:
    """Pull requests whose list of files isn't there; they are deleted."""
    return files.where(is_missing(F.col("body"))).select("number").distinct()


def after_files(history: History, project: str, files: DataFrame) -> History:
    """``history`` without the pull requests of ``project`` whose list of files isn't there any more, and without what hangs on them; those of other projects stay."""
    gone = without_files(files).select(F.col("number").alias("change_number"), F.lit(project).alias("project"))
    ids = written(history.pull_requests.join(gone, ["project", "change_number"], "left_semi").select("id"), "gone")
    kept = lambda rows, key: rows.join(ids.withColumnRenamed("id", key), key, "left_anti").select(*rows.columns)
    return replace(history, pull_requests=kept(history.pull_requests, "id"), reviews=kept(history.reviews, "pr_id"), file_paths=kept(history.file_paths, "pr_id"))
