import pytest
from pyspark.sql import functions as F

from weftline.llm.mixing import mix, mix_report, sized

SIZE = "cast(length(text) AS bigint)"


@pytest.fixture(scope="module")
def tables(spark):
    docs = [(i, "big", "x" * (1 + i % 7), 0) for i in range(3000)] + [(10_000 + i, "small", "x" * 10, 0) for i in range(50)]
    docs += [(20_000, None, "xxx", 0), (20_001, "big", None, 0), (20_002, "big", "", 0), (0, "big", "x", 0), (20_003, "untargeted", "xxxx", 0)]
    targets = [("big", 0.7, 1), ("small", 0.1, 4), ("absent", 0.1, 2), ("small", 0.1, 4)]
    return spark.createDataFrame(docs, "doc_id long, source string, text string, tokens int"), spark.createDataFrame(targets, "source string, target_share double, max_repeats int")


def test_budgets_are_met_and_never_passed(spark, tables):
    docs, targets = tables
    total = sized(docs, size=SIZE).agg(F.sum("tokens")).first()[0]
    got = {r.source: r for r in mix_report(docs, targets, size=SIZE).collect()}
    assert set(got) == {"big", "small", "absent"}
    assert 0 <= 0.7 * total - got["big"].tokens_out < 8 and got["big"].most_uses == 1 and not got["big"].short
    assert 0 <= 0.1 * total - got["small"].tokens_out < 10 and got["small"].most_uses == 3
    assert got["absent"].tokens_out == 0 and got["absent"].short


def test_cap_binds(spark, tables):
    docs, _ = tables
    targets = spark.createDataFrame([("small", 0.9, 2)], "source string, target_share double, max_repeats int")
    r = mix_report(docs, targets, size=SIZE).first()
    assert r.tokens_out == 1000 and r.most_uses == 2 and r.short


def test_cut_is_a_prefix_of_the_random_order(tables):
    docs, targets = tables
    used = {r.doc_id: r.times for r in mix(docs, targets, size=SIZE).collect()}
    again = {r.doc_id: r.times for r in mix(docs.repartition(7), targets, size=SIZE).collect()}
    assert used == again and 20_003 not in used


def test_public_tokenizer_and_empty(spark, tables):
    docs, targets = tables
    assert sized(spark.createDataFrame([(1, "s", "Hello world, 你好")], "doc_id long, source string, text string")).first().tokens > 4
    assert mix(docs.limit(0), targets).count() == 0
    assert {r.share_reached for r in mix_report(docs.limit(0), targets).collect()} == {0.0}
