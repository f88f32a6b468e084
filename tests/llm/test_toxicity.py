import random

import numpy as np
import pytest

from weftline.llm import toxicity as X

DOMAIN = "the tensile strength of fibers rose after annealing and porosity declined in every mat while a solution was stirred for two hours before filler entered bath curve fitted".split()
BAD = {
    "abusive": ["you are a clueless oaf and {} laughs at you", "shame on you {} pathetic oaf", "滚开 你这 蠢驴 {}"],
    "hateful": ["those {} outsiders are filth and must go", "die {} sind dreck und sollen weg"],
    "sexual": ["steamy {} undressed bodies await tonight", "corps {} déshabillés très torrides"],
}
DECOY = ["filth on the {} mould must go into the waste", "undressed {} glass fibers await sizing"]


def text(rng, inner=""):
    words = [rng.choice(DOMAIN) for _ in range(12)] + [inner] + [rng.choice(DOMAIN) for _ in range(12)]
    return " ".join(w for w in words if w) + "."


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(3)
    rows, labels, true = [], [], set()
    for i in range(1500):
        rows.append((i, text(rng, rng.choice(DECOY).format(rng.choice(DOMAIN)) if i % 20 == 0 else ""), "a", 0.0))
        if i % 5 == 0:
            labels.append((i, "ok"))
    at = 2000
    for c, templates in BAD.items():
        for t in templates:
            for k in range(14):
                rows.append((at, text(rng, t.format(rng.choice(DOMAIN))), "b", 0.0))
                true.add((at, c))
                if k < 8:
                    labels.append((at, c))
                at += 1
    rows += [rows[-1], (3000, None, "b", 0.0), (3001, " ", None, 0.0), (3002, text(rng) * 8000 + BAD["hateful"][0].format("mat"), None, 0.0), (3003, " \n\t", None, 0.0), (3004, "...", None, 0.0)]
    rows += [(3005, "c l u e l e s s oaf you are a clu3less oaf and every mat laughs at youuuu", None, 0.0)]
    labels += [(2000, "ok"), (9999, "sexual"), (5, "other"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, score double")
    return docs, spark.createDataFrame(labels, "doc_id long, label string"), true | {(3002, "hateful"), (3005, "abusive")}


def test_labels_alone_find_unlabelled_texts(corpus):
    docs, labels, true = corpus
    scored = X.score_documents(docs, labels)
    got = {(r.doc_id, r.category) for r in scored.collect()}
    assert len(got & true) >= 0.95 * len(true) and len(got - true) <= 0.05 * len(true)
    assert (3002, "hateful") in got and (3005, "abusive") in got
    assert not any(i < 1500 for i, _ in got)  # other uses of the same words
    rates = {(r.source, r.category): (r.documents, r.found) for r in X.rates(docs, scored).collect()}
    assert rates["a", "sexual"] == (1500, 0) and rates["b", "sexual"][0] == 99 and rates[None, "hateful"] == (5, 1)


def test_every_document_has_scores(spark, corpus, tmp_path):
    from weftline.llm import queries

    docs, labels, _ = corpus
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "content_labels.parquet"))
    rows = queries.QUERIES["p9_scores"](spark, str(tmp_path)).collect()
    want = {r.doc_id for r in docs.where(r"text rlike '\\S'").collect()}
    assert len(rows) == 3 * len(want) and {(r.doc_id, r.category) for r in rows} == {(i, c) for i in want for c in X.CATEGORIES}
    assert all((r.score > 0) == (r.e_value <= X.MOST_E) for r in rows)
    assert {r.passage for r in rows if r.doc_id == 3004} == {""}


def test_empty_and_unlabelled(spark, corpus):
    docs, labels, _ = corpus
    assert X.score_documents(docs.limit(0), labels).count() == 0
    assert X.score_all(docs.limit(20), labels.limit(0)).count() == 60


def test_segments_against_brute_force():
    rng = random.Random(4)
    for _ in range(300):
        words = rng.choices(["a", "b", "c", "-"], weights=[1, 1, 1, 4], k=14)
        score = {"a": 3.0, "b": 1.0, "c": -4.0}
        value = [score.get(w, X.NEUTRAL) for w in words]
        best = max(sum(value[i : j + 1]) for i in range(14) for j in range(i, 14))
        got = X.segments({i: score[w] for i, w in enumerate(words) if w != "-"})
        if best > 0:
            assert max(s for s, _, _ in got) == pytest.approx(best)
        assert all(s == pytest.approx(sum(value[a : b + 1])) for s, a, b in got)
        assert all(x[2] < y[1] for x, y in zip(got, got[1:]))


def test_calibration_against_simulation():
    values = {-0.6: 9700, 1.0: 200, 2.0: 100}
    rate, k = X.calibrate(values)
    s, p = np.array(list(values)), np.array(list(values.values())) / 10000
    assert float((p * np.exp(rate * s)).sum()) == pytest.approx(1, abs=1e-6)
    draws = np.random.default_rng(2).choice(s, size=(400, 3000), p=p)
    top, run = np.zeros(400), np.zeros(400)
    for column in draws.T:
        run = np.maximum(0, run + column)
        top = np.maximum(top, run)
    # the number of texts above a level is that of a Gumbel law with the fitted rate and K
    for level in (3.0, 4.0):
        expected = 1 - np.exp(-k * 3000 * np.exp(-rate * level))
        assert abs(float((top >= level).mean()) - expected) < 0.2
    assert X.calibrate({}) == (1.0, 1.0) and X.calibrate({-0.6: 10}) == (1.0, 1.0)


def test_masks():
    w = X.Words({"imbecile", "vermin", "porn", "filthy", "stupid", "pigs"})
    assert [w.word(t) for t in ("im*ecile", "v3rm1n", "pornnnn", "filthyyyy", "2024", "cm3", "st*pid")] == ["imbecile", "vermin", "porn", "filthy", "2024", "cm3", "stupid"]
    assert w.tokens("s t u p i d, f.i.l.t.h.y p-i-g-s") == ["stupid", "filthy", "pigs"]
