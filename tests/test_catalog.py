"""Every query of the library runs on the smallest data, and equals its SQL where it has one."""

from pathlib import Path

import pandas as pd
import pytest

from weftline.plans import catalog

DATA = Path("/root/testdata/sf0.001")


def rows(pdf):
    def plain(v):
        if pd.api.types.is_scalar(v) and pd.isna(v):
            return ""
        if isinstance(v, bool):
            return str(v)
        return repr(round(float(v), 6)) if isinstance(v, (int, float)) or hasattr(v, "dtype") and v.dtype.kind in "if" else str(v)

    return sorted(tuple(plain(v) for v in r) for r in pdf[sorted(pdf.columns)].astype(object).itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def sql():
    import duckdb

    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.skipif(not DATA.exists(), reason="needs the test data")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sql, name):
    df = catalog.QUERIES[name](spark, str(DATA))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    got = df.toPandas()
    if name in catalog.ORACLE:
        want = sql.execute(catalog.ORACLE[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_names():
    assert set(catalog.ORACLE) <= set(catalog.QUERIES)
