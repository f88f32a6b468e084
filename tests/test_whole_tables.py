"""Queries over whole tables against brute force, with the rows that SQL cannot follow."""

import hashlib
import re

import pytest

from weftline.plans import catalog

ROWS = [
    (1, 1, "PAN–Ä 5◦C", "强度", "1.62e3"), (2, 1, "PAN–Ä 5◦C", "强度", "-4"), (3, 1, "PAN–Ä 5◦C", "强度", "1620"), (4, 1, "PAN–Ä 5◦C", "强度", "about 5"), (5, 1, "PAN–Ä 5◦C", "强度", None),
    (6, None, None, None, "+.5"), (6, None, None, None, "+.5"), (7, None, None, None, "-1E-2"), (8, 2, "  (样品\u30001 ℃), ", "Strength (m²)", "12.5"), (9, 2, "CNT 1.5 wt% filler – DR 4", "  ", ""),
    (10, 2, "film, draw ratio = 3.5", "Strength at 5 °C", "7"), (11, 2, "DR-2 2μm", "x" * 90, "7"), (12, 2, "draw ratio", "S 1", "3"), (13, 2, "0.5wt Ag − 30 nm", "S 1", "2"),
]


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("whole")
    spark.createDataFrame(ROWS, "id long, source_paper_id long, sample_id string, performance_metric string, performance_value string").write.parquet(str(d / "candidate_items.parquet"))

    def rows(name):
        got = [tuple(r) for r in catalog.QUERIES[name](spark, str(d)).collect()]
        assert len(got) == len(set(got))
        return set(got)

    return rows


def squeeze(s):
    return re.sub(r"\s+", " ", s, flags=re.ASCII).strip(" ")


def shown(s):
    return squeeze(s.replace("◦", "°").replace("℃", "°C")).strip(" ,;:.()[]")


def key(s):
    s = shown(s).lower().replace("°", " ")
    return squeeze(re.sub(r"[^a-z0-9.%+\-/ ]+", " ", re.sub("[−–—]", "-", s)))


def pattern(s):
    s = re.sub(r"\b[0-9]+(\.[0-9]+)?\s*(wt%|vol%|%|deg|c|k|h|min|s)?\b", "#", key(s), flags=re.ASCII)
    return re.sub(r"#+", "#", re.sub(r"\b[a-z]?[-_ ]?[0-9]+[a-z]?\b", "#", s, flags=re.ASCII)).strip(" -_/")


def variable(s):
    if m := re.search(r"([0-9]+(?:\.[0-9]+)?)\s*wt%?\s*([A-Za-z]+)", s or ""):
        return m[2] + " loading", m[1], "wt%"
    if m := re.search(r"(?:draw ratio|DR)\s*[-=]?\s*([0-9]+(?:\.[0-9]+)?)", s or ""):
        return "draw ratio", m[1], None
    return None, None, None


def slug(s):
    return re.sub(r"^_+|_+$", "", re.sub(r"[^a-z0-9]+", "_", s.lower()))[:80] or "metric_" + hashlib.sha1(s.encode()).hexdigest()[:12]


def test_sample_keys(run):
    assert run("sample_key_normalize_all") == {(i, s and shown(s), s and key(s)) for i, _, s, _, _ in ROWS}


def test_patterns(run):
    assert run("name_pattern_all") == {(i, s and pattern(s)) for i, _, s, _, _ in ROWS}


def test_variables(run):
    got = run("variable_from_id_all")
    assert got == {(i, *variable(s)) for i, _, s, _, _ in ROWS}
    assert (10, "draw ratio", "3.5", None) in got and (9, "filler loading", "1.5", "wt%") in got


def test_slugs(run):
    got = run("metric_slug_all")
    assert got == {(m, slug(m)) for _, _, _, m, _ in ROWS if m is not None}
    assert any(s.startswith("metric_") for _, s in got)


def test_ranks(run):
    number = lambda v: float(v) if re.fullmatch(r"[+-]?[0-9.]+([eE][+-]?[0-9]+)?", v or "") else None
    want = set()
    for i, p, s, m, v in ROWS:
        group = sorted({number(r[4]) for r in ROWS if r[1:4] == (p, s, m) and number(r[4]) is not None})
        want.add((i, None if number(v) is None else group.index(number(v)) + 1))
    assert run("peak_dense_rank_all") == want
