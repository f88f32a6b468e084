"""Every query of the subpackage runs on the smallest data, without any cross join, and equals its SQL where it has one."""

from pathlib import Path

import pytest

from weftline.llm import queries

DATA = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not DATA.exists(), reason="needs the test data")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, str(DATA))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    rows = {tuple(r) for r in df.collect()}
    if name in queries.ORACLE:
        import duckdb

        con = duckdb.connect()
        for f in DATA.glob("*.parquet"):
            con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
        want = con.execute(queries.ORACLE[name]).df()[df.columns]
        assert rows == {tuple(r) for r in want.astype(object).itertuples(index=False, name=None)}
    if name.endswith("_found"):
        assert len(rows) == df.count()


def test_nothing_else_imports_this_subpackage():
    root = Path(queries.__file__).resolve().parents[1]
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert "weftline.llm" not in f.read_text()
