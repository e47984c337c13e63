"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import math
import os
from collections import Counter

import duckdb
import pytest

from inkstone.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{data}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data}/{t}.parquet')")
    return con


def plain(value):
    if hasattr(value, "item"):
        value = value.item()
    if value is None or isinstance(value, float) and math.isnan(value) or str(value) in ("NaT", "<NA>"):
        return None
    if isinstance(value, float):
        return float(f"{value:.9g}")
    return value if isinstance(value, int | str | bool) else str(value)


def rows(frame):
    columns = sorted(frame.columns)
    return columns, Counter(tuple(map(plain, r)) for r in frame[columns].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_against_sql(name, spark, data, duck):
    got, want = rows(catalog.QUERIES[name](spark, data).toPandas()), rows(duck.execute(catalog.SQL[name]).df())
    assert got[0] == want[0]
    assert got[1] == want[1]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(1).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
