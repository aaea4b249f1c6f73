"""Every query over the review history gives what its SQL gives in DuckDB."""

from __future__ import annotations

import pytest
from small_data import DATA

from quillrank import queries as Q

NAMES = sorted(Q.queries())
SQL = Q.oracle_sql()


@pytest.mark.parametrize("name", [n for n in NAMES if n in SQL])
def test_same_as_sql(name, same_as_duck):
    same_as_duck(Q.queries()[name], SQL[name])


@pytest.mark.parametrize("name", [n for n in NAMES if n not in SQL])
def test_runs(name, spark):
    assert Q.queries()[name](spark, DATA).count() > 0


@pytest.mark.parametrize("name", sorted(Q.SMALL_SQL))
def test_same_as_sql_of_whole_paths(name, same_as_duck):
    same_as_duck(Q.queries()[name], Q.SMALL_SQL[name])
