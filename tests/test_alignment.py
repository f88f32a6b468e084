import pytest
from pyspark.sql import functions as F

from weftline.operators import alignment as A
from weftline.operators import documents as D
from weftline.operators import lookup as L
from weftline.operators import relational as R


@pytest.mark.parametrize(
    ("text", "pairs"),
    [
        ("2MZ-AZINE-PI3 (117.8 °C) and PI1 (150.2 °C) were compared", [("2MZ-AZINE-PI3", "117.8"), ("PI1", "150.2")]),
        ("PI1 (12.38 mg/cm3), PI2 (10.2 mg/cm3) and PI3 (4.74 mg/cm3)", [("PI1", "12.38"), ("PI2", "10.2"), ("PI3", "4.74")]),
        ("The carbonyl stretching peak (1722 cm^-1) was observed by FTIR.", []),
        ("The pH increased up to 7.60 and 7.64 for PCL/AA/S and PCL/AA/SBCu (respectively) after 14 days.", [("PCL/AA/S", "7.60"), ("PCL/AA/SBCu", "7.64")]),
        ("S1 and S2 were 3 MPa and 4 MPa, respectively", [("S1", "3"), ("S2", "4")]),
        ("1, 2 and 3 for A1 and B2", []), (None, []), ("", []),
    ],
)
def test_pairs(text, pairs):
    assert A.sample_value_pairs(text) == pairs


def test_contrasts():
    text = "The displacement of the fiber-reinforced material was 8.8 mm, whereas that of the TPU structure was 16.7 mm."
    assert A.contrasts(text) == [("displacement", "fiber-reinforced material", "8.8", "mm"), ("displacement", "TPU structure", "16.7", "mm")]
    assert A.contrasts(None) == []


def test_spark_forms(spark):
    df = spark.createDataFrame([(1, "PI1 (1 MPa) x"), (1, "PI1 (1 MPa) x"), (2, None), (3, "none")], "id int, t string")
    assert [tuple(r) for r in A.stated_pairs(df, "id", "t").collect()] == [(1, 1, "PI1", "1")]
    w = spark.createDataFrame([("One. Two 5 MPa. Three.", "5 MPa"), ("Only 7.", "7"), ("x", "9"), (None, "1")], "t string, n string")
    assert [r.w for r in w.select(A.evidence_window(F.col("t"), F.col("n")).alias("w")).collect()] == ["One. Two 5 MPa.", "Only 7.", None, None]
    z = spark.createDataFrame([(1, "A, B", "1; 2"), (2, "A and B", "1"), (3, None, "1")], "id int, n string, v string")
    assert [(r.id, r.pos, r.name, r.value) for r in A.zipped_lists(z, "n", "v").orderBy("id", "pos").collect()] == [(1, 1, "A", "1"), (1, 2, "B", "2")]


def test_lookup(spark):
    entries = spark.createDataFrame([(1, "tensile_strength", ["breaking strength"]), (2, "wet_tensile_strength", None), (3, "pore_size", ["Ra"])], "entry_id int, canonical_name string, aliases array<string>")
    names = spark.createDataFrame([("Tensile strength",), ("tensile",), ("max pore size value",), ("RA",), ("ra x",), ("wet",), (None,), ("zz",)], "m string")
    got = {r.name: (r.entry_id, r.way) for r in L.find_entries(names, entries).collect()}
    assert got == {"Tensile strength": (1, "exact"), "tensile": (1, "within"), "max pore size value": (3, "holds"), "RA": (3, "exact"), "wet": (2, "within")}


def test_numbered(spark):
    df = spark.createDataFrame([(1, "a", "10"), (2, "a", "9"), (3, "a", "10.0"), (4, None, "1"), (5, "a", "x")], "id int, g string, v string")
    assert {r.id: r.value_no for r in L.numbered_values(df, ["g"], "v").collect()} == {1: 2, 2: 1, 3: 2, 4: 1, 5: None}


def test_windows_and_tables(spark):
    kinds = ["p", "table", "table", "p", "table"]
    df = spark.createDataFrame([(i, 1, 1, i, k, "s", "x" * 40) for i, k in enumerate(kinds, 1)], "id long, paper_id long, page_number int, order_index int, block_type string, section_name string, text string")
    assert {(r.id, r.table_no) for r in D.joined_tables(df).collect()} == {(2, 1), (3, 1), (5, 2)}
    assert {(r.id, r.window) for r in D.context_windows(df, 100, 1).collect()} == {(1, 1), (2, 1), (2, 2), (3, 2), (3, 3), (4, 3), (4, 4), (5, 4)}


def test_fact_audits(spark):
    df = spark.createDataFrame([(1, "k", "n"), (2, "k", "t"), (3, "j", "n"), (4, "j", "t"), (5, "j", "t"), (6, None, None)], "id int, key string, m string")
    assert [tuple(r) for r in R.told_twice(df, ["key"], F.col("m") == "n").collect()] == [(1, 2)]
    assert {(r.key, r.m, r.n) for r in R.commonest(df, ["key"], "m").collect()} == {("k", "n", 1), ("j", "t", 2)}
    assert {(r.key, r.variants) for r in R.conflicting_cells(df, ["key"], "m").collect()} == {("k", 2), ("j", 2)}
