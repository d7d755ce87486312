"""Every market query that has SQL gives DuckDB's rows at the smallest scale."""

import duckdb
import pytest

from tickloom.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events".split():
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    df = df.where(df.notna(), None)
    return sorted(tuple(repr(round(v, 9)) if isinstance(v, float) else str(v) for v in r) for r in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in ORACLES:
        assert rows(got) == rows(duck.execute(ORACLES[name]).df())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(1).count() == 1


def test_empty_tables(spark, tmp_path):
    """No query fails over tables without rows."""
    for t in "region nation customer supplier part orders lineitem events".split():
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
    failed = {}
    for name, f in QUERIES.items():
        try:
            f(spark, str(tmp_path)).collect()
        except Exception as e:  # noqa: BLE001
            failed[name] = str(e)[:200]
    assert failed == {}
