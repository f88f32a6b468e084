import pytest
from pyspark.sql import functions as F

from weftline.operators import relational as R

SCHEMA = "id long, source_paper_id long, sample_id string, performance_metric string, performance_value string, performance_unit string, performance_condition string, performance_evidence string, reviewer_comment string, extraction_method string, source_location string, evidence_text string, n long"


def rec(i, paper=1, sample="s", metric="m", value="1", unit="MPa", condition=None, evidence="e", comment=None, method="AI_text", place=None, text="short"):
    return (i, paper, sample, metric, value, unit, condition, evidence, comment, method, place, text, 0)


@pytest.fixture(scope="module")
def records(spark):
    rows = [
        rec(1), rec(2, method="AI_holistic", text="a longer evidence"), rec(3, value="≥ 1"), rec(4, metric=None), rec(5, metric=None), rec(6, paper=None, sample=None),
        rec(7, value="2", comment="qa_reason=x"), rec(7, value="2", comment="qa_reason=x"), rec(8, value="2", method="rule_text_range"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_exact_dedupe(records):
    assert {r.id for r in R.exact_dedupe(R.once(records)).collect()} == {2, 3, 4, 5, 6, 8}
    assert R.exact_dedupe(records.limit(0)).count() == 0


def test_first_wins_ties(spark):
    df = spark.createDataFrame([(2, "k", 1), (1, "k", 1), (3, "k", 0), (4, None, 0)], "id long, k string, r int")
    assert {r.id for r in R.first_by(df, ["k"], F.col("r"), [-F.col("id")]).collect()} == {1, 4}


def test_score(records):
    r = R.completeness_score(R.once(records)).first()
    assert (r.n, r.clean, r.unique) == (8, 0.875, 0.625) and r.completeness == pytest.approx(29 / 32, abs=1e-4)
    assert R.completeness_score(records.limit(0)).first().score == 0


def test_unanimous(spark):
    df = spark.createDataFrame([(1, "g", "A b", "x"), (2, "g", " ", "y"), (3, "g", "a  B", None), (4, "h", None, "z"), (5, None, None, "z")], "id int, g string, v string, w string")
    got = {r.id: (r.v, r.w) for r in R.unanimous_fill(df, ["g"], ["v", "w"]).collect()}
    assert got == {1: ("A b", "x"), 2: ("A b", "y"), 3: ("a  B", None), 4: (None, "z"), 5: (None, "z")}


def test_page_and_status(spark):
    df = spark.createDataFrame([(i, "待审核" if i % 2 else "approved") for i in range(9)], "id int, review_status string")
    assert [r.id for r in R.page_of(df, [F.desc("id")], 2, 4).collect()] == [4, 3, 2, 1]
    assert R.page_of(df, [F.col("id")], -3, 10**6).count() == 9
    assert {r.id for r in R.with_status(df, ["pending"]).collect()} == {1, 3, 5, 7}


def test_latest_and_missing(spark):
    df = spark.createDataFrame([(1, 5, "a"), (1, 5, "b"), (1, None, "c"), (None, 1, "d")], "k int, t int, v string")
    assert {(r.k, r.v) for r in R.latest(df, "k", ["t", "v"]).collect()} == {(1, "b"), (None, "d")}
    assert [r.k for r in R.missing_from(df, df.where("k = 2"), "k").collect()] == [1]


def test_signatures(spark):
    df = spark.createDataFrame([(g, i, f"v{i}") for g in (1, 2) for i in range(50)], "g int, id long, v string")
    now = R.signatures(df, "g", "id", ["id", "v"], bucket=7)
    assert R.changed(now, R.signatures(df.repartition(9), "g", "id", ["id", "v"], bucket=7), "g").count() == 0
    other = R.signatures(df.where("g = 1 OR id <> 3").unionByName(df.limit(1).withColumn("g", F.lit(3))), "g", "id", ["id", "v"], bucket=7)
    assert {(r.g, r.change) for r in R.changed(other, now, "g").collect()} == {(2, "different"), (3, "new")}


def test_fill_and_sample(records, spark):
    got = {r.column_name: r.filled for r in R.fill_rates(R.once(records), ["sample_id", "reviewer_comment"]).collect()}
    assert got == {"sample_id": 7, "reviewer_comment": 1}
    df = spark.createDataFrame([(i, "a" if i < 90 else "b") for i in range(100)], "id int, s string")
    rows = R.spread_sample(df, ["s"], "id", "x", 10).collect()
    assert len(rows) == 10 and sum(r.s == "b" for r in rows) == 5
