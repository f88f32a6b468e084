import pytest
from pyspark.sql import functions as F

from weftline.functions import rules as U
from weftline.functions import text as X
from weftline.operators import relational as R


def run(spark, f, *values):
    df = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(f(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first().x


def test_units(spark):
    # fixed values: spellings and what they are compared as
    cases = {"[MPa]": "mpa", "% higher than": "%", "W m^-1 K^-1": "w/mk", "g/cm³": "g/cm3", "J/m^2": "j/m²", "mm (diameter)": "mm", "N/mm2": "mpa", "vol.%": "%", "own unit": "ownunit", None: ""}
    df = spark.createDataFrame([(k,) for k in cases], "u string")
    assert {r.u: r.k for r in df.select("u", U.compared_unit(F.col("u")).alias("k")).collect()} == cases


@pytest.mark.parametrize(
    ("metric", "unit", "fits"),
    [
        ("tensile strength", "MPa", True), ("tensile_strength", "%", False), ("some improvement", "%", True), ("glass transition temperature", "K", True), ("roughness of x", "nm", True), ("x", "nm", False),
        ("x", "cm^-1", False), ("raman_peak", "cm-1", True), ("xps_peak", "eV", True), ("apparent density", "g/cm3", True), ("anything", "widgets", True), (None, "MPa", False), ("x", None, False), ("x", "°C", False),
    ],
)
def test_unit_fits(spark, metric, unit, fits):
    assert run(spark, lambda m, u: U.unit_fits(U.metric_key(m), U.compared_unit(u)), metric, unit) is fits


def test_values_and_messages(spark):
    for value, wanted in (("12", False), ("see Fig. 3", True), ("Higher", True), (None, True), ("n/a", True), ("about 3 nm", False)):
        assert run(spark, U.is_placeholder, value) is wanted
    for text, wanted in (("a 12 MPa film", True), ("12 MPax", False), ("pH 7", False), (None, False), ("5.1e3 °C", True)):
        assert run(spark, U.states_quantity, text) is wanted
    for message, code in (("HTTP 429", "rate_limited"), ("Model x not found", "model_not_found"), ("invalid json", "non_json_response"), ("", None), (None, None), ("strange", "unknown_error"), ("read timed out", "timeout")):
        assert run(spark, U.error_code, message) == code


def test_relevance(spark):
    # fixed values: documents and what is decided about them
    cases = [
        ("Electrospun PAN nanofibers for structural composites", "", "fiber_signal"), ("Book Review: Advances in Analytical Chemistry", "x", "excluded_document_type"),
        ("Randomized placebo-controlled clinical trial", "Patients received therapy in the hospital. " * 50, "clinical_document_without_material_signal"), (None, None, "insufficient_local_text"),
        ("On aramid", "REVIEW This review discusses aramid fibers.", "review_article"), ("x", "word " * 60 + "epoxy resin", "material_without_fiber_signal"), ("x", "word " * 60, "no_fiber_signal"),
    ]
    for title, body, reason in cases:
        assert run(spark, U.relevance, title, body).reason == reason


def test_locations(spark):
    for place, rough in (("results", True), ("", True), ("p.3, Fig. 2", False), ("page 3", False), ("p. 3", True), ("p. 3 text", True), ("somewhere", True), (None, True), ("section 2.1", False)):
        assert run(spark, X.rough_location, place) is rough
    for place, bucket in (("Fig. 3a", "figure:3a"), ("page 4, results", "page:4:results"), ("Table 2", "table:2"), (" Elsewhere ", "elsewhere"), (None, "unknown")):
        assert run(spark, X.source_bucket, place) == bucket
    assert run(spark, X.name_pattern, "PCF-12 / 5 wt% x3") == "pcf-# / #wt% #"


RECORD = "id long, source_paper_id long, sample_id string, performance_metric string, performance_value string, performance_condition string, performance_unit string, performance_method string, extraction_method string, source_location string, evidence_text string, merged int"


def test_merged_facts(spark):
    rows = [
        (1, 1, "S1", "Tensile  strength", "12", None, "MPa", None, "AI_text", "p.3", "e", 0), (2, 1, " S1 ", "tensile strength", "12 ", "", None, "ASTM", "AI_holistic", "p.3", "e", 0),
        (3, 1, "S1", "tensile strength", "12", "at 5 N", "MPa", None, "AI_text", None, None, 0), (4, 1, "S1", None, "12", None, None, None, None, None, None, 0), (5, None, None, "x", "1", None, None, None, None, "block B1", None, 0),
        (6, None, None, "x", "1", None, "N", None, None, "block B1", None, 0),
    ]
    got = {r.id: (r.unit, r.method, r.merged) for r in R.merged_facts(spark.createDataFrame(rows, RECORD)).collect()}
    assert got == {2: ("MPa", "ASTM", 2), 3: ("MPa", None, 1), 5: ("N", None, 2)}
    assert R.merged_facts(spark.createDataFrame([], RECORD)).count() == 0


def test_numbers_over_blocks(spark, monkeypatch):
    df = spark.createDataFrame([(i * 7 % 50, None if i % 3 else "g", i) for i in range(50)], "k long, g string, n int")
    expected = {}
    for g in (None, "g"):
        for place, k in enumerate(sorted(r.k for r in df.collect() if r.g == g), 1):
            expected[g, k] = place
    for size in (1 << 16, 8, 1):
        monkeypatch.setattr(R, "NUMBER_BLOCK", size)
        assert {(r.g, r.k): r.place for r in R.numbered(df, ["g"], "k", "place").collect()} == expected


def test_fallback_and_top(spark):
    df = spark.createDataFrame([(1, "a", 1), (2, "a", 0), (3, "b", 0), (4, None, 0), (5, "a", None)], "id long, p string, w int")
    assert {r.id for r in R.prior_or_all(df, "p", F.col("w") == 1).collect()} == {1, 3, 4}
    assert {r.id for r in R.top_per(df, "p", [F.desc("id")], 2).collect()} == {5, 2, 3, 4}
    texts = spark.createDataFrame([(2, "g", "Pore  A"), (1, "g", "pore a"), (3, "g", "b"), (4, "g", " "), (5, None, "c")], "id long, g string, t string")
    assert {(r.g, r.text, r.place) for r in R.unique_values(texts, ["g"], "t", "id").collect()} == {("g", "pore a", 1), ("g", "b", 2), (None, "c", 1)}
