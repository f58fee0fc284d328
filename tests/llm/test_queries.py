"""Every registered query of the training-data operators against its SQL twin, on the smallest tables."""

import pytest

pytest.importorskip("duckdb")
from tessella.llm.queries import QUERIES  # noqa: E402
from tests.test_queries import canonical, oracle  # noqa: E402, F401


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, base, oracle, name):  # noqa: F811
    query, sql = QUERIES[name]
    got = query(spark, base).toPandas()
    if sql is None:
        assert len(got) > 0
        return
    want = oracle.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)
