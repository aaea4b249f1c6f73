"""Reading inputs and cutting lineage, shared by the operators of this subpackage."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession

from quillrank.stored import discard, shared_folder, temporary, written

__all__ = ["bounded_batches", "discard", "free_name", "opened", "quoted", "read", "shared_folder", "stash", "temporary"]

#: Most bytes of an Arrow batch between Spark and Python, so that long texts don't add up in a worker.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Set the session's size of Arrow batches, which Spark has as a setting only."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stash(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back; see ``written``."""
    bounded_batches(df.sparkSession)
    return written(df, label)


def free_name(name: str, *tables: DataFrame) -> str:
    """A column name like ``name`` that none of the tables has."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name += "_"
    return name


def quoted(*names: str) -> list[str]:
    """Column names, whatever characters they have."""
    return ["`" + n.replace("`", "``") + "`" for n in names]


def opened(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a path in the shared folder, and the path there, for files that tasks read or write themselves."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri.removeprefix("file:")
    return pa.fs.FileSystem.from_uri(uri)
