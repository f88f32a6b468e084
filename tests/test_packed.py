import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.operators.packed import pack_values, split_packed, unpack_fields


@pytest.mark.parametrize(
    ("text", "values"),
    [
        (None, []),
        ("  ", []),
        ("SEM", ["SEM"]),
        ('"SEM, 5 kV"', ["SEM, 5 kV"]),
        ("SEM; ; XRD;", ["SEM", "XRD"]),
        ("UV/Vis / BET [77 K; N2] / XRD (Cu, 5-60)", ["UV/Vis", "BET [77 K; N2]", "XRD (Cu, 5-60)"]),
        ("mean 2,5 μm, N,N'-net", ["mean 2,5 μm", "N,N'-net"]),
        ('"dense ""skin"", open", x', ['dense "skin", open', "x"]),
        ('5" tube; b', ['5" tube', "b"]),
        ('"open; b', ['"open', "b"]),
        ("a (b; c", ["a (b", "c"]),
        ("a、b；c•d\te\nf|g", list("abcdefg")),
        (r'"a \" b; c"; d', ['a " b; c', "d"]),
    ],
)
def test_split(text, values):
    assert split_packed(text) == values


def test_very_long_text_is_read_whole():
    assert len(split_packed("; ".join(f"v{i}" for i in range(50_000)))) == 50_000


def test_rows_nulls_repeats_and_extra_columns(spark):
    df = spark.createDataFrame([(1, "a; b", "x", "q"), (1, "a; b", "x", "q"), (None, "c; d", None, "q"), (2, None, "", "q")], "id long, f string, g string, pos string")
    got = sorted((r.id or 0, r.field_name, r.pos, r.item_text) for r in unpack_fields(df, "id", ["f", "g"]).collect())
    assert got == [(0, "f", 1, "c"), (0, "f", 2, "d"), (1, "f", 1, "a"), (1, "f", 2, "b")]
    assert unpack_fields(df.limit(0), "id", ["f", "g"]).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text('ab";,/ |()\\', min_size=1, max_size=8).map(str.strip).filter(bool), min_size=1, max_size=5))
def test_round_trip_python(values):
    def quote(v):
        return '"' + v.replace("\\", "\\\\").replace('"', '""') + '"'

    assert split_packed("; ".join(map(quote, values))) == values


def test_round_trip_spark(spark):
    values = ['a "b"', "c; d", "plain", "x/y, z"]
    text = spark.createDataFrame([(values,)], "v array<string>").select(pack_values(F.col("v")).alias("t")).first().t
    assert split_packed(text) == values


def test_only_the_bracket_left_open_is_plain():
    assert split_packed("a (x; [y); z); b") == ["a (x; [y)", "z)", "b"]
    assert split_packed("a [x; (y; z]; b") == ["a [x; (y; z]", "b"]
    assert split_packed("a ((x; y); b") == ["a ((x; y)", "b"] or split_packed("a ((x; y); b") == ["a ((x", "y)", "b"]
