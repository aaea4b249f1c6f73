"""Changes from captured Gerrit responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillrank.functions.times import gerrit_millis
from quillrank.operators.cleaning import is_positive
from quillrank.schema import BAD_DATE, BAD_JSON, GERRIT_CHANGE, MISSING_KEY
from quillrank.stored import written

#: Characters before the JSON of a response, that keep browsers from running it.
PREFIX = 5
PAGE_SIZE = 100
COMMIT_MESSAGE = "/COMMIT_MSG"
LABEL = "Code-Review"


def without_prefix(body: Column) -> Column:
    return F.substring(body, PREFIX + 1, 2**31 - 1)


def judged_changes(responses: DataFrame) -> DataFrame:
    """body (of one change, or of a response that isn't a list), change, and cause: why it can't be imported, null if it can. Every change of a list stands for itself."""
    listed = responses.select("body", F.from_json(without_prefix(F.col("body")), "array<string>").alias("found"))
    # What isn't a list parses to nothing, or to a list of its pieces.
    is_list = F.coalesce(F.ltrim(without_prefix(F.col("body"))).startswith("[") & F.col("found").isNotNull(), F.lit(False))
    each = listed.select(F.explode(F.when(is_list, F.col("found")).otherwise(F.array(F.col("body")))).alias("body"), (~is_list).alias("is_odd"))
    read = each.withColumn("change", F.from_json("body", f"{GERRIT_CHANGE}, _unread string", {"columnNameOfCorruptRecord": "_unread"}))
    c = F.col("change")
    cause = F.when(F.col("is_odd") | c.isNull() | c["_unread"].isNotNull(), BAD_JSON).when(c["id"].isNull() | c["_number"].isNull() | c["owner"]["_account_id"].isNull(), MISSING_KEY).when(gerrit_millis(c["created"]).isNull(), BAD_DATE)
    return read.select("body", F.col("change").dropFields("_unread").alias("change"), cause.alias("cause"))


def import_changes(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Changes that can be imported whole, and body and cause of the others, from one pass over the responses, which is written."""
    judged = written(judged_changes(responses), "judged-changes")
    return judged.where("cause is null").select("change.*"), judged.where("cause is not null").select("body", "cause")


def changes(responses: DataFrame) -> DataFrame:
    """A row (change) for each change of list responses (body), as far as it can be read; ``import_changes`` judges them."""
    return responses.select(F.explode(F.from_json(without_prefix(F.col("body")), f"array<struct<{_struct(GERRIT_CHANGE)}>>")).alias("change")).select("change.*")


def _struct(ddl: str) -> str:
    """A column list as the inside of a struct type."""
    depth, out = 0, []
    for part in ddl.split(", "):
        out.append(part.replace(" ", ":", 1))
    return ",".join(out)


def account(person: Column) -> Column:
    """A live account: its number, and its first avatar if it has one."""
    return F.struct(person["_account_id"].cast("string").alias("accountId"), person["email"].alias("email"), person["name"].alias("name"), F.try_element_at(person["avatars"], F.lit(1))["url"].alias("avatar"))


def developer(person: Column) -> Column:
    """A mined account, which has no avatar."""
    return F.struct(person["_account_id"].cast("string").alias("accountId"), person["email"].alias("email"), person["name"].alias("name"), F.lit(None).cast("string").alias("avatar"))


def pull_requests(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("id").alias("changeId"), F.col("_number").alias("changeNumber"), F.col("project").alias("subProject"), gerrit_millis(F.col("created")).alias("timestamp"), developer(F.col("owner")).alias("owner"))


def votes(rows: DataFrame, label: str = LABEL) -> DataFrame:
    """changeId and the votes of a label."""
    return rows.select(F.col("id").alias("changeId"), F.explode(F.col("labels")[label]["all"]).alias("vote"))


def reviewers(rows: DataFrame, label: str = LABEL) -> DataFrame:
    """changeId and reviewer of every vote above 0."""
    return votes(rows, label).where(is_positive(F.col("vote.value"))).select("changeId", F.struct(F.col("vote._account_id").cast("string").alias("accountId"), "vote.email", "vote.name", F.lit(None).cast("string").alias("avatar")).alias("reviewer")).distinct()


def file_paths(rows: DataFrame, keep_message: bool = True) -> DataFrame:
    """changeId and location of the current revision's files; the commit message is one of them, unless left out as live look-ups do."""
    paths = rows.select(F.col("id").alias("changeId"), F.explode(F.map_keys(F.col("revisions")[F.col("current_revision")]["files"])).alias("location"))
    return paths if keep_message else paths.where(F.col("location") != COMMIT_MESSAGE)


def change(rows: DataFrame, change_id: str) -> DataFrame:
    """The first change of that id, if any."""
    return rows.where(F.col("id") == change_id).limit(1)


def live_target(rows: DataFrame, number: int) -> DataFrame:
    """The target of a live request: its pull request and, as an array, its paths. Nobody has reviewed it yet."""
    paths = F.filter(F.map_keys(F.col("revisions")[F.col("current_revision")]["files"]), lambda p: p != COMMIT_MESSAGE)
    return rows.where(F.col("_number") == number).limit(1).select(F.col("id").alias("changeId"), F.col("_number").alias("changeNumber"), F.col("project").alias("subProject"), gerrit_millis(F.col("created")).alias("timestamp"), account(F.col("owner")).alias("owner"), F.coalesce(paths, F.array()).alias("paths"))


def people_of_changes(rows: DataFrame, label: str = LABEL) -> DataFrame:
    """changeId, person and role: positive voters and, where the label has any list of votes, the owner, who stands twice if both."""
    voted = votes(rows, label).where(is_positive(F.col("vote.value"))).select("changeId", F.col("vote._account_id").alias("account_id"), F.lit("approver").alias("role"))
    owners = rows.where(F.col("labels")[label]["all"].isNotNull()).select(F.col("id").alias("changeId"), F.col("owner._account_id").alias("account_id"), F.lit("owner").alias("role"))
    return voted.union(owners)


def commentators(rows: DataFrame) -> DataFrame:
    """changeId and author of each message, each author once."""
    return rows.select(F.col("id").alias("changeId"), F.explode("messages").alias("m")).where("m.author is not null").select("changeId", account(F.col("m.author")).alias("author")).distinct()


def account_of(rows: DataFrame, account_id: int) -> DataFrame:
    """The account of a number, from the owners and authors seen."""
    seen = rows.select(F.col("owner").alias("a")).union(rows.select(F.explode("messages.author").alias("a")))
    return seen.where(F.col("a._account_id") == account_id).select(account(F.col("a")).alias("account")).limit(1).select("account.*")
