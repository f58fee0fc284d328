"""Every registered query of the core against its SQL twin, on the smallest tables."""

import glob
import os

import pytest

from tessella.plans.registry import catalogue

duckdb = pytest.importorskip("duckdb")
CATALOGUE = catalogue()


@pytest.fixture(scope="session")
def oracle(base):
    connection = duckdb.connect()
    for path in glob.glob(f"{base}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


def canonical(frame):
    text = lambda v: "" if v is None or v != v else f"{v:.5f}".rstrip("0").rstrip(".") if isinstance(v, float) else str(v)
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(tuple(text(v) for v in row) for row in frame.where(frame.notna(), None).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(CATALOGUE))
def test_query(spark, base, oracle, name):
    query, sql = CATALOGUE[name]
    got = query(spark, base).toPandas()
    if sql is None:
        assert len(got) > 0
        return
    want = oracle.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)
