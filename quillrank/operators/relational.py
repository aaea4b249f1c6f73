"""Finders and counts over a history, each for all parameter values at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillrank.functions.times import months_ms
from quillrank.schema import History
from quillrank.stored import written

#: Stretches of time that a window is cut into where times and stretches meet.
CELLS = 12


def newest_first(pull_requests: DataFrame) -> DataFrame:
    """With rk, the place in the project's newest-first order from 0; equal times go by falling id.

    All rows are sorted over ranges and written with their places there; a
    range and a project together count from how many rows of the project the
    ranges before hold, so a project may be spread over any number of tasks.
    The places of one DataFrame are worked out once.
    """
    known = getattr(pull_requests, "_quillrank_placed", None)
    if known is not None:
        return known
    order = [F.col("project"), F.col("ts").desc(), F.col("id").desc()]
    ranged = pull_requests.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()).withColumn("range", F.shiftrightunsigned("at", 33))
    placed = written(ranged, "newest-first")
    pieces = placed.groupBy("range", "project").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("project").orderBy("range")) - F.col("n")  # a row for each range
    starts = pieces.select("range", "project", (before - F.col("first")).alias("start")).alias("s")
    p = placed.alias("p")
    met = p.join(starts, (F.col("p.range") == F.col("s.range")) & F.col("p.project").eqNullSafe(F.col("s.project")))
    pull_requests._quillrank_placed = met.select("p.*", (F.col("p.at") + F.col("s.start")).alias("rk")).drop("at", "range")
    return pull_requests._quillrank_placed


def sized(placed: DataFrame) -> DataFrame:
    """With n, the number of pull requests of the project."""
    return placed.join(placed.groupBy("project").agg(F.count("*").alias("n")), "project")


def before(pull_requests: DataFrame, project: str, ts: int) -> DataFrame:
    """Pull requests of a project strictly before a time."""
    return pull_requests.where((F.col("project") == project) & (F.col("ts") < ts))


def reviewed_between(history: History, months: int) -> DataFrame:
    """target_id, reviewer_id, n_recent: reviews strictly inside the window before each pull request, by reviewers of its project.

    A review counts from just after it until the window's length later. In one
    order of these events, a running sum says how many count at a time, so a
    pull request meets every reviewer once, however many reviews count.
    """
    span = months_ms(months)
    cell = lambda c: F.floor(c / (span // CELLS)).cast("long")
    done = reviewed(history).select("project", "reviewer_id", F.explode(F.array(F.struct((F.col("ts") + 1).alias("since"), F.lit(1).alias("more")), F.struct((F.col("ts") + span).alias("since"), F.lit(-1).alias("more")))).alias("e"))
    changes = done.groupBy("project", "reviewer_id", "e.since").agg(F.sum("e.more").alias("more"))
    in_time = Window.partitionBy("project", "reviewer_id").orderBy("since")
    counted = changes.select("project", "reviewer_id", "since", F.lead("since").over(in_time).alias("until"), F.sum("more").over(in_time).alias("n_recent")).where("n_recent > 0")
    spread = counted.withColumn("cell", F.explode(F.sequence(cell(F.col("since")), cell(F.col("until") - 1))))
    targets = history.pull_requests.select(F.col("id").alias("target_id"), "project", F.col("ts").alias("target_ts"), cell(F.col("ts")).alias("cell"))
    return targets.join(spread, ["project", "cell"]).where("since <= target_ts and target_ts < until").select("target_id", "reviewer_id", "n_recent")


def last_reviewed(asked: DataFrame, history: History) -> DataFrame:
    """``asked`` (target_id, reviewer_id) with target_ts and last_ts, when the reviewer last reviewed in the target's project strictly before the target; null if never.

    Questions and reviews stand in one order of time for each reviewer of a
    project, so nothing is paired.
    """
    targets = history.pull_requests.select(F.col("id").alias("target_id"), "project", "ts")
    questions = asked.select("target_id", "reviewer_id").distinct().join(targets, "target_id").select("project", "reviewer_id", "ts", "target_id", F.lit(None).cast("long").alias("done"))
    reviews = reviewed(history).select("project", "reviewer_id", "ts", F.lit(None).cast("long").alias("target_id"), F.col("ts").alias("done")).distinct()
    earlier = Window.partitionBy("project", "reviewer_id").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    seen = questions.union(reviews).withColumn("last_ts", F.max("done").over(earlier)).where("target_id is not null")
    return seen.select("target_id", "reviewer_id", F.col("ts").alias("target_ts"), "last_ts")


def reviewed(history: History) -> DataFrame:
    """A row for each review, with its pull request."""
    return history.pull_requests.join(history.reviews, F.col("id") == F.col("pr_id")).drop("pr_id")


def reviewed_paths(history: History) -> DataFrame:
    """A row for each review and path of its pull request."""
    return reviewed(history).join(history.file_paths, F.col("id") == F.col("pr_id")).drop("pr_id")


def count_by(rows: DataFrame, *keys: str | Column, name: str = "n") -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias(name))


def pull_request_of_change(pull_requests: DataFrame, wanted: DataFrame) -> DataFrame:
    """Pull requests for (project, change_id) rows."""
    return pull_requests.join(wanted, ["project", "change_id"], "left_semi")


def developer_of_key(developers: DataFrame, wanted: DataFrame) -> DataFrame:
    """Developers for (account_id, name, email) rows; nulls match nulls."""
    d, w = developers.alias("d"), wanted.alias("w")
    same = F.col("d.account_id").eqNullSafe(F.col("w.account_id")) & F.col("d.name").eqNullSafe(F.col("w.name")) & F.col("d.email").eqNullSafe(F.col("w.email"))
    return d.join(w, same, "left_semi")


def project_of_name(projects: DataFrame, name: str) -> DataFrame:
    return projects.where(F.col("name") == name)
