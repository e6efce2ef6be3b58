import __spark_entry__ as driver
from lexspan.llm import queries
from tests.test_entry import duck, plain  # noqa: F401

import pytest


@pytest.mark.parametrize("name", [n for n in sorted(queries.QUERIES) if n in queries.SQL or n in ("p6_containers", "p7_shares", "p8_found")])
def test_query(spark, sf, duck, name):  # noqa: F811
    df = driver.queries()[name](spark, sf)
    cols = sorted(df.columns)
    rows = df.collect()
    assert rows
    if name in queries.SQL:
        result = duck.execute(queries.SQL[name])
        names = [d[0] for d in result.description]
        want = [[r[names.index(c)] for c in cols] for r in result.fetchall()]
        assert plain([[r[c] for c in cols] for r in rows]) == plain(want)
