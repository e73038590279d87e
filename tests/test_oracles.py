"""Every registered query of the screening library against its SQL, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from tapeloom import registry

SF = "/root/testdata/sf0.001"


def _value(v):
    if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) == "NaT":
        return ""
    if isinstance(v, bool):
        return str(v)
    if hasattr(v, "year"):
        return str(v)[:10]
    try:
        return f"{float(v):.9g}"
    except (TypeError, ValueError):
        return str(v)


def rows(df):
    return sorted(tuple(_value(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    if name not in registry.ORACLE_SQL:
        assert len(got)
        return
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    want = c.execute(registry.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
