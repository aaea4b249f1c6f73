"""Reads a star schema of orders as a code-review history.

An order is a pull request of its customer's nation, its suppliers review it
and its parts are the changed files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.functions.times import column_millis
from quillrank.operators.cleaning import cleaned
from quillrank.schema import History
from quillrank.stored import written


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def location(brand: Column, kind: Column, name: Column) -> Column:
    return F.concat_ws("/", brand, kind, F.replace(name, F.lit(" "), F.lit("/")))


def raw_history(spark: SparkSession, folder: str) -> History:
    """Before cleaning: reviews by owners are in, and so are pull requests without reviews."""
    lines, orders, suppliers = table(spark, folder, "lineitem"), table(spark, folder, "orders"), table(spark, folder, "supplier")
    n_people = suppliers.agg(F.count("*")).scalar()
    named = table(spark, folder, "customer").join(table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    pull_requests = (
        orders.join(named, F.col("o_custkey") == F.col("c_custkey"))
        .select(
            F.col("o_orderkey").alias("id"),
            F.col("n_name").alias("project"),
            F.col("o_orderpriority").alias("sub_project"),
            F.col("o_orderkey").cast("string").alias("change_id"),
            F.col("o_orderkey").alias("change_number"),
            column_millis(F.col("o_orderdate")).alias("ts"),
            (F.col("o_custkey") % n_people).alias("owner_id"),
        )
    )
    reviews = lines.select(F.col("l_orderkey").alias("pr_id"), F.col("l_suppkey").alias("reviewer_id")).distinct()
    parts = table(spark, folder, "part").select("p_partkey", location(F.col("p_brand"), F.col("p_type"), F.col("p_name")).alias("location"))
    file_paths = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("pr_id"), "location")
    developers = suppliers.select(F.col("s_suppkey").alias("id"), F.col("s_suppkey").cast("string").alias("account_id"), F.lit("").alias("email"), F.col("s_name").alias("name"), F.lit(None).cast("string").alias("avatar"))
    projects = table(spark, folder, "nation").select(F.col("n_name").alias("name"), F.lit(None).cast("string").alias("project_url"))
    return History(projects, developers, pull_requests, reviews, file_paths)


def load_history(spark: SparkSession, folder: str) -> History:
    return cleaned(raw_history(spark, folder))


def stored_history(spark: SparkSession, folder: str) -> History:
    """The cleaned history, written once, for what reads its tables many times."""
    clean = load_history(spark, folder)
    return History(clean.projects, clean.developers, written(clean.pull_requests, "pull-requests"), written(clean.reviews, "reviews"), written(clean.file_paths, "file-paths"))
