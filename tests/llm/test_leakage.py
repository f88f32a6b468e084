import random

import numpy as np

from weftline.llm import leakage
from weftline.llm.leakage import MIN_STRETCH, MOST_GAP, Items, SuffixOrder, covered, leaked_items, match_shard, without_leaks, words

ITEM = "A retired weaver in the tide basin braids twin rolls of speckled fleece and waits seventy minutes before dusk falls"


def test_suffix_order_and_common_prefixes():
    rng = random.Random(1)
    a = np.array([rng.randint(0, 3) for _ in range(500)] + [0])
    order = SuffixOrder(a, 64)

    def known(p):
        out = []
        while a[p]:
            out.append(int(a[p]))
            p += 1
        return out

    live = np.flatnonzero(a > 0)
    sa = live[np.argsort(order.rank[live], kind="stable")]
    assert [known(p) for p in sa] == sorted(known(p) for p in sa)
    x, y = np.array([rng.choice(live) for _ in range(2000)]), np.array([rng.choice(live) for _ in range(2000)])
    for p, q, n in zip(x, y, order.common(x, y)):
        u, v = known(p), known(q)
        assert n == next((k for k, (i, j) in enumerate(zip(u, v)) if i != j), min(len(u), len(v)))


def test_long_repeats_beyond_the_longest_item():
    items = Items([(1, "a b c d e")])
    docs = [items.encode(("a b c d e " * 50).split()), items.encode("x a b c d e".split()), items.encode("c d e a b".split())]
    assert {(d, i, share) for d, i, share, *_ in match_shard([0, 1, 2], docs, items)} == {(0, 1, 1.0), (1, 1, 1.0)}


def test_gaps_and_blocks(monkeypatch):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen"
    items = Items([(1, item), (2, "zeta"), (3, "one two three")])
    near = "one two three four five x x seven eight nine ten eleven".split()
    far = ["one", "two", "three", "four", "five", *["x"] * 500, "seven", "eight", "nine", "ten", "eleven"]
    docs = [items.encode(d) for d in (near, far, ["a", "zeta"], ["one", "two"])]
    expected = {(0, 1), (0, 3), (1, 3), (2, 2)}
    assert {(d, i) for d, i, *_ in match_shard([0, 1, 2, 3], docs, items)} == expected
    monkeypatch.setattr(leakage, "MAX_HITS", 1)  # every match in a block of its own
    assert {(d, i) for d, i, *_ in match_shard([0, 1, 2, 3], docs, items)} == expected


def test_against_brute_force():
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rng.choices(vocabulary, k=20))) for i in range(6)]
    docs = []
    for _ in range(60):
        base = rng.choice(items)[1].split()
        take = base[: rng.randint(4, 20)]
        if rng.random() < 0.5:
            take.insert(rng.randint(0, len(take)), "odd")
        docs.append(rng.choices(vocabulary, k=10) + take + rng.choices(vocabulary, k=10))
    known = Items(items)
    got = {(d, i) for d, i, *_ in match_shard(list(range(60)), [known.encode(d) for d in docs], known)}
    expected = set()
    for d, ws in enumerate(docs):
        for i, t in items:
            iw = t.split()
            runs = []
            for o in range(len(iw)):
                for p in range(len(ws)):
                    n = 0
                    while o + n < len(iw) and p + n < len(ws) and iw[o + n] == ws[p + n]:
                        n += 1
                    if n >= MIN_STRETCH and not (o and p and iw[o - 1] == ws[p - 1]):
                        runs.append((o, p, n))
            if runs and covered(runs, MIN_STRETCH, MOST_GAP) >= len(iw) / 2:
                expected.add((d, i))
    assert got == expected and got


def test_documents(spark, monkeypatch):
    half = " ".join(ITEM.split()[:10])
    docs = [
        (1, "Intro. " + ITEM + " Outro", "x"), (2, ITEM.upper().replace(" ", "\n> "), "x"), (3, "第一" + half + "结束", "x"), (4, " ".join(ITEM.split()[:8]), "x"),
        (5, None, "x"), (6, " ", "x"), (7, ITEM.replace("tide", "salt").replace("rolls", "rows"), "x"), (7, ITEM.replace("tide", "salt").replace("rolls", "rows"), "x"),
        (8, " ".join(reversed(ITEM.split())), "x"), (9, "padding word " * 100_000 + ITEM, "x"),
    ]
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    e = spark.createDataFrame([(1, ITEM, "s"), (2, ITEM, "s"), (3, "too short", "s"), (4, None, "s")], "item_id long, text string, eval_set string")
    got = leaked_items(d, e)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == {(i, j) for i in (1, 2, 3, 7, 9) for j in (1, 2)}
    assert got.count() == 10
    assert {r.doc_id for r in without_leaks(d, got).collect()} == {4, 5, 6, 8}
    monkeypatch.setattr(leakage, "MAX_ITEM_BYTES", 150)  # the items in several parts
    assert {(r.doc_id, r.item_id) for r in leaked_items(d, e).collect()} == {(i, j) for i in (1, 2, 3, 7, 9) for j in (1, 2)}
    assert leaked_items(d.limit(0), e).count() == 0 and leaked_items(d, e.limit(0)).count() == 0


def test_words():
    assert words("Ａb-c’s​ 中文 É!") == ["ab", "c", "s", "中", "文", "é"]
