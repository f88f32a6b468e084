import pytest
from pyspark.sql import functions as F

from weftline.functions import looks
from weftline.functions import text as X


def one(spark, f, *values):
    df = spark.createDataFrame([(v,) for v in values], "v string").select("v", f(F.col("v")).alias("r"))
    got = {r.v: r.r for r in df.collect()}
    return [got[v] for v in values]


def test_science(spark):
    values = ["1.20×10⁻³", "3.4E5", "2,549,000", "5 × 10^2", "7", "1e0", "x", None, "1.5*10^{-4}"]
    assert one(spark, X.science_value, *values) == ["1.2e-3", "3.4e5", "2549000", "5e2", "7", "1", None, None, "1.5e-4"]


def test_variants(spark):
    got = one(spark, X.value_variants, ">= 100 MPa", "200-240 °C", "12 ± 3", "4.5(2)", "about 7", "text", None, "3.1 to 3.4")
    flat = [[(x.role, x.clean, x.spread) for x in r] if r is not None else [] for r in got]
    assert flat == [
        [("scalar", ">=100", None)], [("range_min", "200", None), ("range_max", "240", None)], [("scalar", "12", "3")], [("scalar", "4.5", "2")],
        [("scalar", "≈7", None)], [], [], [("range_min", "3.1", None), ("range_max", "3.4", None)],
    ]
    shape = one(spark, X.value_shape, ">= 100 MPa", "200-240 °C")
    assert (shape[0].shape, shape[0].operator, shape[0].low) == ("scalar", ">=", 100.0)
    assert (shape[1].shape, shape[1].low, shape[1].high) == ("range", 200.0, 240.0)


@pytest.mark.parametrize(
    ("f", "value", "expected"),
    [
        (X.sample_name, " S1 ◦ (a). ", "S1 ° (a"), (X.match_key, "PAN–Ä 5°C", "pan- 5 c"), (X.number_signature, "12 and 3.50 then 7", "3.5|7|12"), (X.number_signature, "none", ""),
        (X.source_bucket, "page 3, Figure 4c", "figure:4c"), (X.source_bucket, "page 2 results", "page:2:results"), (X.source_bucket, "", "unknown"), (X.rough_location, "p. 4", True), (X.rough_location, "Table 2", False),
        (X.rough_location, None, True), (X.name_pattern, "PCF 1.0wt% 22", "pcf #.0wt% #"), (X.sample_form, "cellulose nanofibre mat", "nanofiber"), (X.slug, "Tensile Strength (MPa)", "tensile_strength_mpa"),
        (X.safe_cell, "=1+1", "'=1+1"), (X.safe_stem, "a/b: c?.", "a_b_ c_"), (X.safe_stem, "CON", "_CON"), (X.status_name, "待审核", "pending"), (X.status_name, "new", "new"),
        (X.value_operator, "no more than 5", "<="), (X.plain_science, "10⁻³ × 2", "10^-3 * 2"), (looks.fold_width, "Ａ​ b‑c", "A b-c"), (looks.fold_letters, "МРа", "MPa"),
    ],
)
def test_functions(spark, f, value, expected):
    assert one(spark, f, value) == [expected]


def test_variable(spark):
    v = one(spark, X.variable_of_name, "PCF_1.0wtCNC", "plain")
    assert (v[0].name, v[0].value, v[0].unit) == ("CNC loading", "1.0", "wt%") and v[1].name is None


def test_nulls_pass(spark):
    for f in (X.science_value, X.sample_name, X.match_key, X.number_signature, X.name_pattern, X.sample_form, X.slug, X.safe_cell, X.safe_stem, X.status_name, X.value_operator, X.source_bucket):
        value = one(spark, f, None)[0]
        assert value is None or f in (X.number_signature, X.source_bucket)
