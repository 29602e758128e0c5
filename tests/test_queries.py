"""Every registered query of the library against its SQL on the smallest tables."""

import pytest

from code_analytics.plans import code_queries, review_queries
from tests.conftest import SF

QUERIES = code_queries.QUERIES | review_queries.QUERIES
SQL = code_queries.ORACLE_SQL | review_queries.ORACLE_SQL


def rows(frame):
    frame = frame[sorted(frame)]
    return sorted(map(repr, frame.astype(object).where(frame.notna(), None).values.tolist()))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    if name not in SQL:
        assert df.limit(1).count() == 1
        return
    got, want = df.toPandas(), duck.sql(SQL[name]).df()
    assert sorted(got) == sorted(want)
    for c in got:  # an integer column with nulls is a float in one frame
        if str(got[c].dtype) == "float64" and "nt" in str(want[c].dtype):
            want[c] = want[c].astype("float64")
    assert rows(got) == rows(want)
