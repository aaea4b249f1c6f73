"""One small session for all tests, and a comparison with DuckDB."""

from __future__ import annotations

import os
import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

from small_data import DATA  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.local.dir", str(tmp_path_factory.mktemp("spark")))
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    base = duckdb.connect()
    for file in Path(DATA).glob("*.parquet"):
        base.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    yield base
    base.close()


def _plain(value):
    return round(value, 7) if isinstance(value, float) else value


def ordered(columns: list[str], rows: list) -> list[tuple]:
    """Rows with columns by name, in a fixed order."""
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in at) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.fixture(scope="session")
def same_as_duck(spark, duck):
    """Compares a query with its SQL: columns, number and values of rows."""

    def compare(query, sql: str) -> None:
        found = query(spark, DATA)
        expected = duck.execute(sql)
        names = [d[0] for d in expected.description]
        assert sorted(found.columns) == sorted(names)
        mine, theirs = ordered(found.columns, [tuple(r) for r in found.collect()]), ordered(names, expected.fetchall())
        assert len(mine) == len(theirs)
        assert mine == theirs

    return compare
