"""Reads the star schema as a repository's log, as captured API responses and as files.

An order is a commit of the paths of its parts. Each of its lines is an edit of
the part's path: the return flag says which kind, the line number where, and
quantity and supplier how long it is on the older and on the newer side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillrank.functions.times import column_millis
from quillrank.sources.star import location, table

#: All paths lie in one repository.
REPOSITORY = "main"
PREFIX = ")]}'\n"


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    """Every line of an order with its path, time and project."""
    parts = table(spark, folder, "part").select("p_partkey", location(F.col("p_brand"), F.col("p_type"), F.col("p_name")).alias("root_path"))
    orders = table(spark, folder, "orders").select("o_orderkey", column_millis(F.col("o_orderdate")).alias("ts"))
    lines = table(spark, folder, "lineitem")
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).join(orders, F.col("l_orderkey") == F.col("o_orderkey")).withColumn("sub_project", F.lit(REPOSITORY))


def commit_file(spark: SparkSession, folder: str) -> DataFrame:
    """sub_project, log_seq, commit_id, path, change_id; log_seq (time and key, taken negative) falls with time, so no order over all commits is needed."""
    commits = _lines(spark, folder).select("sub_project", "ts", "o_orderkey", "root_path").distinct()
    seq = F.struct((-F.col("ts")).alias("time"), (-F.col("o_orderkey")).alias("key"))
    key = F.col("o_orderkey").cast("string")
    return commits.select("sub_project", seq.alias("log_seq"), key.alias("commit_id"), F.col("root_path").alias("path"), key.alias("change_id"))


def renames(spark: SparkSession, folder: str) -> DataFrame:
    """Every third part's path was that of the next part before its own first commit."""
    part = table(spark, folder, "part").select("p_partkey", location(F.col("p_brand"), F.col("p_type"), F.col("p_name")).alias("path"))
    new, old = part.where("p_partkey % 3 = 0"), part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("path").alias("old_path"))
    first = commit_file(spark, folder).groupBy("sub_project", "path").agg(F.max_by("commit_id", "log_seq").alias("commit_id"))
    return first.join(new.join(old, "p_partkey"), "path").select("sub_project", "commit_id", F.col("p_partkey").cast("int").alias("walk_order"), F.lit("RENAME").alias("change_type"), "old_path", F.col("path").alias("new_path"))


def commit_messages(spark: SparkSession, folder: str) -> DataFrame:
    """commit_id and message of every order: with a change id as its first footer, with another footer before it, with none, or with a subject only."""
    key = F.col("o_orderkey")
    subject, body = F.concat(F.lit("Order "), key), F.lit("\n\nNote: of the body.\n\n")
    change, signed = F.concat(F.lit("Change-Id: I"), key), F.concat(F.lit("Signed-off-by: dev-"), F.col("o_custkey"))
    message = F.when(key % 4 == 0, subject).when(key % 4 == 1, F.concat(subject, body, change, F.lit("\n"), signed)).when(key % 4 == 2, F.concat(subject, body, signed, F.lit("\n"), change, F.lit("\n"))).otherwise(F.concat(subject, body, F.lit("just text")))
    return table(spark, folder, "orders").select(key.cast("string").alias("commit_id"), message.alias("message"))


def edits(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """file_commit and edit rows of all paths, as the line ranker takes them."""
    lines = _lines(spark, folder)
    newest = Window.partitionBy("sub_project", "root_path").orderBy(F.col("ts").desc(), F.col("o_orderkey").desc())
    commits = lines.select("sub_project", "root_path", "ts", "o_orderkey").distinct().withColumn("commit_seq", F.row_number().over(newest) - 1)
    key = F.col("o_orderkey").cast("string")
    file_commit = commits.select("sub_project", "root_path", "commit_seq", key.alias("commit_id"), F.col("root_path").alias("path"), key.alias("change_id"))
    inside = Window.partitionBy("root_path", "o_orderkey").orderBy("l_linenumber", "l_suppkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
    kind = F.when(F.col("l_returnflag") == "A", "INSERT").when(F.col("l_returnflag") == "R", "DELETE").otherwise("REPLACE")
    older, newer = (F.col("l_quantity") % 5 + 1).cast("int"), (F.col("l_suppkey") % 5 + 1).cast("int")
    begin = F.col("l_linenumber")
    edit = lines.withColumn("edit_seq", F.row_number().over(inside) - 1).withColumn("type", kind).join(commits.select("root_path", "o_orderkey", "commit_seq"), ["root_path", "o_orderkey"])
    return file_commit, edit.select(
        "sub_project", "root_path", "commit_seq", "edit_seq", "type",
        begin.alias("begin_a"), F.when(F.col("type") == "INSERT", begin).otherwise(begin + older).alias("end_a"),
        begin.alias("begin_b"), F.when(F.col("type") == "DELETE", begin).otherwise(begin + newer).alias("end_b"),
    )


def vote(line_number: Column) -> Column:
    """-1 to 2, in turn."""
    return (line_number % 4 - 1).cast("int")


def change_people(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers vote on an order, and its customer owns it."""
    n_people = table(spark, folder, "supplier").agg(F.count("*")).scalar()
    votes = table(spark, folder, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.max(vote(F.col("l_linenumber"))).alias("value"))
    voted = votes.select(F.col("l_orderkey").cast("string").alias("change_id"), F.col("l_suppkey").alias("account_id"), F.lit("approver").alias("role"), "value")
    owners = table(spark, folder, "orders").select(F.col("o_orderkey").cast("string").alias("change_id"), (F.col("o_custkey") % n_people).alias("account_id"), F.lit("owner").alias("role"), F.lit(None).cast("int").alias("value"))
    return voted.union(owners)


def page_files(spark: SparkSession, folder: str) -> DataFrame:
    """The pages as files (sub_project, commit_id, path, content)."""
    return table(spark, folder, "pages").select(F.lit(REPOSITORY).alias("sub_project"), F.lit("head").alias("commit_id"), F.col("page_id").cast("string").alias("path"), F.col("html").alias("content"))


def _login(key: Column) -> Column:
    """Every tenth supplier is a program."""
    return F.concat(F.when(key % 10 == 0, "bot-").otherwise("dev-"), key.cast("string"))


def github_responses(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Comments and reviews (number, body) as the API sends them: odd lines are comments, even ones reviews; an order without any review has none to be found."""
    user = F.struct(F.struct(F.col("l_suppkey").alias("id"), _login(F.col("l_suppkey")).alias("login"), F.lit("").alias("avatar_url")).alias("user"))
    lines = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("number")).agg(F.collect_list(F.when(F.col("l_linenumber") % 2 == 1, user)).alias("odd"), F.collect_list(F.when(F.col("l_linenumber") % 2 == 0, user)).alias("even"))
    missing = F.lit('{"message":"Not Found"}')
    return lines.select("number", F.to_json("odd").alias("body")), lines.select("number", F.when(F.size("even") == 0, missing).otherwise(F.to_json("even")).alias("body"))


def github_pulls(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as pull requests (number, body); of every seven one body breaks off, one has no time and one has no id."""
    key = F.col("o_orderkey")
    created = F.when(key % 7 == 1, "yesterday").otherwise(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T00:00:00Z")))
    text = lambda c: c.cast("string")
    identity = F.when(key % 7 == 2, F.lit("")).otherwise(F.concat(F.lit('"id":'), text(key), F.lit(",")))
    whole = F.concat(F.lit("{"), identity, F.lit('"number":'), text(key), F.lit(',"state":"closed","created_at":"'), created, F.lit('","user":{"id":'), text(F.col("o_custkey")), F.lit(',"login":"dev"}}'))
    return table(spark, folder, "orders").select(key.alias("number"), F.when(key % 7 == 0, F.substring(whole, 1, 30)).otherwise(whole).alias("body"))


def github_files(spark: SparkSession, folder: str) -> DataFrame:
    """Pages (number, page, body) of an order's files, two lines each, and an empty one at the end; every fifth order has an empty one in the middle, every sixth lacks its second."""
    parts = table(spark, folder, "part").select("p_partkey", location(F.col("p_brand"), F.col("p_type"), F.col("p_name")).alias("filename"))
    lines = table(spark, folder, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey"))
    placed = lines.select(F.col("l_orderkey").alias("number"), "filename", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "filename")).alias("k"))
    page = F.expr("cast((k + 1) div 2 as int)")
    full = placed.groupBy("number", page.alias("page")).agg(F.to_json(F.sort_array(F.collect_list(F.struct("filename")))).alias("body"))
    last = full.groupBy("number").agg((F.max("page") + 1).alias("page")).select("number", "page", F.lit("[]").alias("body"))
    odd = F.when((F.col("number") % 5 == 0) & (F.col("page") == 2), F.lit("[ ]")).otherwise(F.col("body"))
    return full.union(last).withColumn("body", odd).where("number % 6 <> 0 or page <> 2")


def file_versions(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """file_commit, and file_content of every commit: a path has a line for each of its last twelve order lines up to then, in order of their numbers."""
    lines = _lines(spark, folder)
    file_commit, _ = edits(spark, folder)
    known = lines.select("root_path", F.col("o_orderkey").cast("string").alias("commit_id"), "ts", "o_orderkey", F.col("l_linenumber").alias("number"), F.concat(F.col("l_returnflag"), F.lit(" "), (F.col("l_suppkey") % 4).cast("string")).alias("line"))
    order = Window.partitionBy("root_path").orderBy("ts", "o_orderkey", "number", "line")
    so_far = known.withColumn("lines", F.collect_list(F.struct("number", "line")).over(order.rowsBetween(-11, 0))).withColumn("k", F.row_number().over(order))
    content = so_far.groupBy("root_path", "commit_id").agg(F.max_by("lines", "k").alias("lines"))
    text = F.concat(F.array_join(F.transform(F.array_sort("lines"), lambda x: x["line"]), "\n"), F.lit("\n"))
    return file_commit, content.select(F.lit(REPOSITORY).alias("sub_project"), "commit_id", F.col("root_path").alias("path"), text.alias("content"))


def gerrit_responses(spark: SparkSession, folder: str) -> DataFrame:
    """Pages (body) of changes as the API sends them, an order in each."""
    parts = table(spark, folder, "part").select("p_partkey", location(F.col("p_brand"), F.col("p_type"), F.col("p_name")).alias("location"))
    lines = table(spark, folder, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey"))
    ballot = F.struct(F.col("l_suppkey").alias("_account_id"), F.concat(F.lit("dev-"), F.col("l_suppkey").cast("string")).alias("name"), vote(F.col("l_linenumber")).alias("value"))
    grouped = lines.groupBy("l_orderkey").agg(F.collect_list(ballot).alias("all"), F.collect_set("location").alias("paths"))
    files = F.map_from_arrays("paths", F.transform("paths", lambda p: F.lit("{}")))
    body = F.struct(
        F.col("l_orderkey").cast("string").alias("id"),
        F.col("l_orderkey").alias("_number"),
        F.create_map(F.lit("Code-Review"), F.struct("all")).alias("labels"),
        F.lit("r1").alias("current_revision"),
        F.create_map(F.lit("r1"), F.struct(F.map_concat(files, F.create_map(F.lit("/COMMIT_MSG"), F.lit("{}"))).alias("files"))).alias("revisions"),
    )
    return grouped.select(F.concat(F.lit(PREFIX), F.to_json(F.array(body))).alias("body"))
