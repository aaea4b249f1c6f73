"""Intermediate tables in the shared folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own_folder: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Only a local master, whose executors are the driver, gets a temporary one where it is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is unset, and executors need a folder that all of them can read")
    if context.applicationId not in _own_folder:
        _own_folder[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="quillrank-")
    return _own_folder[context.applicationId]


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path for it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    The lineage ends there, so a lost executor costs a re-read and never a
    recomputation, and the written size lets the planner choose joins by fact.
    The table goes when the session's JVM ends, or with ``discard``.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    files, place = file_system(spark, path)
    files.deleteOnExit(place)
    back = spark.read.schema(df.schema).parquet(path)
    back._quillrank_path = path
    if _scopes:
        _scopes[-1].append(back)
    return back


class Kept:
    """The tables of a scope that outlive it."""

    def __init__(self) -> None:
        self.tables: list[DataFrame] = []

    def __call__(self, table: DataFrame) -> DataFrame:
        self.tables.append(table)
        return table


_scopes: list[list[DataFrame]] = []


@contextmanager
def temporary() -> Iterator[Kept]:
    """All tables that are written inside are deleted at the end, but for those that are kept; what is made of them must have been written by then."""
    made, kept = [], Kept()
    _scopes.append(made)
    try:
        yield kept
    finally:
        _scopes.remove(made)
        paths = {t._quillrank_path for t in kept.tables if hasattr(t, "_quillrank_path")}
        for table in made:
            if table._quillrank_path in paths:
                if _scopes:
                    _scopes[-1].append(table)
            else:
                discard(table)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``written`` made and nothing will read any more."""
    for table in tables:
        path = getattr(table, "_quillrank_path", None)
        if path:
            files, place = file_system(table.sparkSession, path)
            files.delete(place, True)


def fresh_folder(spark: SparkSession, label: str) -> str:
    """A name in the shared folder for files that tasks write themselves; they go when the session's JVM ends, or with ``remove``."""
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    files, place = file_system(spark, path)
    files.deleteOnExit(place)
    return path


def remove(spark: SparkSession, path: str) -> None:
    files, place = file_system(spark, path)
    files.delete(place, True)
