"""Every query with an SQL twin equals it exactly on the sf0.001 tables
(the driver runs the same check at sf0.01)."""
import math

import pytest

import __spark_entry__ as E
from sfdata import SF_SMALL

from costlens.plans import catalog

QUERIES = E.queries()
SQL = dict(catalog.SQL)      # the optional subpackage has tests of its own


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ("", "null")
    if isinstance(v, bool):
        return ("n", repr(float(v)))
    if isinstance(v, (int, float)):
        return ("n", repr(float(v)))
    if isinstance(v, (list, tuple)):
        return ("l", tuple(_norm(x) for x in v))
    if hasattr(v, "isoformat"):
        return ("t", v.isoformat())
    return ("s", str(v))


def test_every_query_registered_with_a_docstring():
    assert len(QUERIES) >= 70
    for name in catalog.QUERIES:
        assert QUERIES[name].__doc__, name
        assert not name.startswith("op") and "pipeline" not in name


@pytest.mark.parametrize("name", sorted(SQL))
def test_twin(spark, duck, name):
    df = QUERIES[name](spark, SF_SMALL)
    cols = df.columns
    rows = [tuple(r) for r in df.collect()]
    res = duck.execute(SQL[name])
    ocols = [d[0] for d in res.description]
    orows = res.fetchall()
    assert sorted(cols) == sorted(ocols)
    a = sorted(tuple(_norm(r[i]) for i in sorted(range(len(cols)), key=lambda i: cols[i])) for r in rows)
    b = sorted(tuple(_norm(r[i]) for i in sorted(range(len(ocols)), key=lambda i: ocols[i])) for r in orows)
    assert a == b


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert {"stat_z_score", "stat_is_anomaly", "date"} <= set(df.columns)
