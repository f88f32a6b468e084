import random

from pyspark.sql import functions as F

from weftline.operators import matching as M
from weftline.plans import catalog


def test_similar_names_against_brute_force(spark):
    rng = random.Random(1)
    words = ["pan", "cnt", "film", "wet", "dry", "a1", "b2"]
    names = [(rng.choice([1, 2]), " ".join(rng.sample(words, rng.randint(1, 5)))) for _ in range(120)] + [(1, None), (None, "pan"), (1, "!!")]
    df = spark.createDataFrame(names, "g long, n string")
    got = {(r.g, frozenset(r.name_a.split()), frozenset(r.name_b.split())) for r in M.similar_names(df, "g", "n", 0.6).collect()}
    sets = {(g, frozenset(n.split())) for g, n in names if n and g and n != "!!"}
    expected = {frozenset([a, b]) for a in sets for b in sets if a[0] == b[0] and a[1] != b[1] and len(a[1] & b[1]) / len(a[1] | b[1]) >= 0.6}
    assert {frozenset([(g, a), (g, b)]) for g, a, b in got} == expected


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (200, 200), (300, None)]
    got = {r.node: r.component for r in M.connected(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100, 200: 200}
    assert M.connected(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_aliases(spark):
    df = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "id int, s string")
    al = spark.createDataFrame([("x", "X"), ("x", "Z")], "alias string, canonical string")
    assert {(r.id, r.s) for r in M.apply_aliases(df, "s", al).collect()} == {(1, "X"), (2, "y"), (3, None)}


def test_matching_is_one_to_one(spark):
    e = spark.createDataFrame([(1, "k", 10.0), (2, "k", 10.0), (3, "k", 0.0), (4, "k", None), (5, "q", 10.0)], "id long, key string, v double")
    a = spark.createDataFrame([(11, "k", 10.000001), (12, "k", 10.0), (13, "k", 0.0), (14, "k", -10.0)], "id long, key string, v double")
    pairs = M.tolerant_matches(e, a, ["key"], "v", 1e-6)
    assert {tuple(r) for r in pairs.collect()} == {(1, 11), (1, 12), (2, 11), (2, 12), (3, 13)}
    got = {tuple(r) for r in M.one_to_one(pairs, "expected_id", "actual_id").collect()}
    assert got == {(1, 11), (2, 12), (3, 13)}
    scores = {r.key: (r.matched, r.precision, r.recall) for r in M.gold_scores(e, a, M.one_to_one(pairs, "expected_id", "actual_id"), "key").collect()}
    assert scores == {"k": (3, 0.75, 0.75), "q": (0, 1.0, 0.0)}


def test_groups(spark):
    rows = [(1, "S 1", "CNT", "1", "Table 2"), (1, "S 2", "CNT", "2", "Table 2"), (1, "s 1", "CNT", "1", None), (2, "A", None, None, None), (None, "A", "CNT", "1", None)]
    df = spark.createDataFrame(rows, "source_paper_id long, sample_id string, variable_name string, variable_value string, source_location string")
    got = {(r.reason, r.group_key): (r.confidence, r.samples) for r in M.sample_groups(df).collect()}
    assert got == {("variable", "cnt"): (0.9, 2), ("place", "table:2"): (0.72, 2), ("pattern", "s #"): (0.68, 2)}


def test_restatements(spark):
    long = "the tensile strength of sample one reached 12 MPa after annealing"
    df = spark.createDataFrame([(1, "k", "reached 12 MPa after annealing at once"), (2, "k", long), (3, "k", long[4:50]), (4, "k", long.upper()), (5, "k", "short"), (6, "k", "short"), (7, "j", long), (8, "k", None)], "id long, key string, evidence_text string")
    assert {tuple(r) for r in M.restatements(df, ["key"]).collect()} == {(1, 1), (2, 2), (3, 2), (4, 2), (5, 5), (6, 5), (7, 7)}


def test_every_name_has_its_component(spark, tmp_path):
    names = ["PAN film", "pan-film", "PAN film 5", "B2", "b2.", "样品", "试样", None, "A1 x y"]
    rows = [(1, n) for n in names] + [(2, "b2"), (None, "b2")]
    spark.createDataFrame(rows, "source_paper_id long, sample_id string").write.parquet(str(tmp_path / "candidate_items.parquet"))
    members = {(r.source_paper_id, r.sample_id): r.representative for r in catalog.QUERIES["similar_sample_members"](spark, str(tmp_path)).collect()}
    assert members == {(1, n): n for n in names if n} | {(1, "pan-film"): "PAN film", (1, "b2."): "B2", (2, "b2"): "b2"}
    got = [tuple(r) for r in catalog.QUERIES["sample_components"](spark, str(tmp_path)).collect()]
    want = {(p, n, r) for (p, n), r in members.items()} - {(1, "PAN film 5", "PAN film 5")} | {(1, "PAN film 5", "PAN film")}
    assert set(got) == want and len(got) == len(want)


def test_gold_counts_every_fact(spark, tmp_path):
    shape = "id long, source_paper_id long, sample_id string, performance_metric string, performance_unit string, performance_value string, review_status string"
    gold = [(1, 1, "s", "m", None, "5", "approved"), (2, 1, "s", "m", "MPa", "5", "通过"), (3, 1, None, "m", None, "5", "approved"), (4, None, "s", "m", None, "5", "approved"), (5, 1, "s", "m", None, "7", "pending")]
    found = [(11, 1, "s", "m", None, "5.0", None), (12, 1, "s", "m", "GPa", "5", None), (13, 1, None, "m", None, "5", None), (14, 2, "s", None, None, "x", None), (14, 2, "s", None, None, "x", None), (15, None, "s", "m", None, "5", None)]
    spark.createDataFrame(gold, shape).write.parquet(str(tmp_path / "candidate_records.parquet"))
    spark.createDataFrame(found, shape).write.parquet(str(tmp_path / "candidate_items.parquet"))
    got = {tuple(r) for r in catalog.QUERIES["gold_matching"](spark, str(tmp_path)).collect()}
    assert got == {(1, 3, 3, 1, 0.333333, 0.333333), (2, 0, 1, 0, 0.0, 1.0), (None, 1, 1, 0, 0.0, 0.0)}
