import random

import pytest

from weftline.llm.canonical import MAX_EDITS, map_texts, setting_names

ENTRIES = [
    (1, "m", "tensile_strength", ["breaking strength", "拉伸强度"]), (2, "m", "glass_transition_temperature", ["Tg"]), (3, "m", "modulus", None),
    (4, "m", "lambda_value", None), (5, "s", "stage3_assignment", ["third stage assignment"]), (6, "s", "vision_enhancement", None), (7, "m", "draw_ratio", None),
    (8, "m", "cold_crystallization_enthalpy", None), (9, "m", "curing_time", None), (10, "m", "drying_time", None),
]


@pytest.fixture(scope="module")
def entries(spark):
    return spark.createDataFrame(ENTRIES, "entry_id long, field_name string, canonical_name string, aliases array<string>")


@pytest.mark.parametrize(
    ("field", "text", "entry"),
    [
        ("m", "Tensile Strength", 1), ("m", "TensileStrength:", 1), ("m", "strength, tensile", 1), ("m", "max. tensile  strength (wet state)", 1), ("m", "(拉伸强度)", 1),
        ("m", "$T_{g}$", 2), ("m", "tg", 2), ("m", "temperature of glass transition", 2), ("m", "Glais tarnsition temperature", 2), ("m", "glass trans. temp.", 2),
        ("m", "lambda value", 4), ("m", "lаmbda", 0), ("m", "Tq", 0), ("m", "Dsrw ratio", 7), ("m", "Cold crystallisation enthalpy after ageing", 8),
        ("m", "Dyrign time", 10), ("s", "Stage iii assignment - llm", 5), ("s", "assignment, stage3", 5), ("s", "vision enh", 6), ("s", "tensile strength", 0),
        ("m", "", 0), ("m", "???", 0), ("m", "zeta potential", 0), ("s", "debug", 0), ("m", "x" * 50_000, 0),
    ],
)
def test_known_cases(entries, cases, field, text, entry):
    assert cases[field, text] == entry


@pytest.fixture(scope="module")
def cases(spark, entries):
    texts = [(f, t, "clash") for f, t, _ in test_known_cases.pytestmark[0].args[1]] + [("m", None, "x"), ("s", "debug", "x")]
    df = spark.createDataFrame(texts, "field_name string, text string, entry_id string")
    rows = map_texts(df.select("field_name", "text"), entries).collect()
    assert len(rows) == len({(r.field_name, r.text) for r in rows})
    return {(r.field_name, r.text): r.entry_id for r in rows}


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_pigeonhole_loses_nothing(spark):
    rng = random.Random(3)
    names = ["".join(rng.choices("abcde", k=n)) for n in (10, 11, 12, 14, 17, 20)]
    texts = set()
    for name in names:
        for _ in range(40):
            t = list(name)
            for _ in range(rng.randint(0, 6)):
                at = rng.randrange(len(t))
                t[at : at + rng.randint(0, 1)] = rng.choices("abcde", k=rng.randint(0, 2))
            texts.add("".join(t))
    texts.discard("")
    entries = spark.createDataFrame([(i, "f", n, None) for i, n in enumerate(names, 1)], "entry_id long, field_name string, canonical_name string, aliases array<string>")
    got = {r.text: r.entry_id for r in map_texts(spark.createDataFrame([("f", t) for t in texts], "field_name string, text string"), entries).where("way in ('exact', 'edited')").collect()}
    within = {t for t in texts if min(levenshtein(t, n) for n in names) <= MAX_EDITS}
    assert set(got) == within


def test_settings(spark):
    cases = {
        '"drying time 12 h, under N2"; DrawRatio (6, 2 steps); (RH) 45%': ["drying time", "DrawRatio", "(RH)"],
        "flow rate = 1,2 mL/h, curing time at overnight / take-up speed of 25 m/min": ["flow rate", "curing time", "take-up speed"],
        "": [], None: None, ";;": [],
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string").select("t", setting_names(__import__("pyspark").sql.functions.col("t")).alias("n"))
    assert {r.t: r.n for r in df.collect()} == cases


def test_empty_tables(spark, entries):
    none = spark.createDataFrame([], "field_name string, text string")
    assert map_texts(none, entries).count() == 0
    got = map_texts(spark.createDataFrame([("m", "Tg")], "field_name string, text string"), entries.limit(0)).collect()
    assert [(r.entry_id, r.way) for r in got] == [(0, "unmatched")]
