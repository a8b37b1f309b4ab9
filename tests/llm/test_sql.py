"""Queries that SQL can express, against it on the standard tables."""

import pytest

from weirflow.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, data, duck, name):
    want = duck.execute(ORACLES[name])
    names = [x[0] for x in want.description]
    out = QUERIES[name](spark, data)
    assert sorted(out.columns) == sorted(names)
    assert sorted(map(str, (tuple(r[n] for n in names) for r in out.collect()))) == sorted(map(str, want.fetchall()))
