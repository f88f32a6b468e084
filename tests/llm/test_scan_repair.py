import random

import numpy as np
import pytest

from weftline.llm import boosting
from weftline.llm.scan_repair import MISREADS, findings, repaired_blocks, shape, shape_edits

WORDS = (
    "the fiber diameter of composite samples increased during annealing while surface porosity and tensile strength remained constant because "
    "interfacial bonding between matrix and filler improved under controlled humidity which indicates better dispersion within polymer network structure "
    "well-aligned cross-linked morphology measured after drying solution chamber temperature conductivity resistance thermal stability modulus"
).split()
SCHEMA = "id long, paper_id long, page_number int, order_index int, block_type string, text string, noise_kind string"


def scanned_corpus(seed=1, papers=40, pages=6):
    """Blocks, pages and the planted findings: every other paper is scanned."""
    rng = random.Random(seed)
    blocks, leaves, truth, n = [], [], set(), 0
    for p in range(papers):
        scan = p % 2 == 0
        title = " ".join(rng.sample([w for w in WORDS if len(w) > 5], 4)).capitalize()
        for g in range(1, pages + 1):
            lines, order = [], 0
            page_id = p * 100 + g
            if scan and g > 1:
                n, order = n + 1, order + 1
                blocks.append((n, p, g, order, "header_footer" if rng.random() < 0.6 else "paragraph", title, "x"))
                lines.append(title)
                truth |= {("block", n, "header", ""), ("page", page_id, "header", "")}
            for _ in range(4):
                n, order = n + 1, order + 1
                words = [rng.choice(WORDS) for _ in range(34)]
                out = []
                for k, w in enumerate(words):
                    if scan and len(w) > 6 and rng.random() < 0.06:
                        if rng.random() < 0.5:
                            at = w.index("-") + 1 if "-" in w else rng.randint(3, len(w) - 3)
                            w2 = w[:at] + ("" if "-" in w else rng.choice(["-", "­"])) + "\n" + w[at:]
                            truth.add(("block", n, "hyphen", w))
                        else:
                            a, b = rng.choice([m for m in MISREADS[:17] if m[0] in w] or [(w[:1], w[:1])])
                            w2 = w.replace(a, b, 1)
                            if w2 != w and w2 not in WORDS:
                                truth.add(("block", n, "char", w))
                        w = w2
                    out.append(w + ("\n" if scan and k % 9 == 8 else " "))
                text = ("".join(out).strip() + ".").replace("\n ", "\n")
                blocks.append((n, p, g, order, "paragraph", text, "x"))
                lines.append(text)
            if scan:
                n, order = n + 1, order + 1
                number = rng.choice(["– {} –", "{}", "Page {} of 9", "[{}]"]).format(40 + g)
                blocks.append((n, p, g, order, "header_footer" if rng.random() < 0.6 else "unknown", number, "x"))
                lines.append(number)
                truth |= {("block", n, "page_no", ""), ("page", page_id, "page_no", "")}
            leaves.append((page_id, p, g, 0, None, "\n".join(lines), "x"))
    blocks += [(10**6, None, None, None, None, None, None), (10**6 + 1, 0, 1, None, "paragraph", "", "x"), blocks[0]]
    leaves += [(10**6, 0, 99, 0, None, None, "x"), leaves[0]]
    return blocks, leaves, truth


@pytest.fixture(scope="module")
def corpus(spark):
    blocks, leaves, truth = scanned_corpus()
    return spark.createDataFrame(blocks, SCHEMA), spark.createDataFrame(leaves, SCHEMA), truth


def test_held_out_accuracy(corpus):
    blocks, pages, truth = corpus
    rows = findings(blocks, pages).collect()
    got = {tuple(r) for r in rows}
    assert len(got) == len(rows)
    for kind in ("header", "page_no", "hyphen", "char"):
        want, have = {t for t in truth if t[2] == kind}, {t for t in got if t[2] == kind}
        right = len(want & have)
        assert right >= 0.9 * len(want), (kind, right, len(want), sorted(want - have)[:9])
        assert right >= 0.9 * len(have), (kind, right, len(have), sorted(have - want)[:9])


def test_paragraphs_are_continuous(corpus):
    blocks, pages, _ = corpus
    rows = repaired_blocks(blocks, pages).collect()
    assert len({r.id for r in rows}) == len(rows)
    assert not any("\n" in r.paragraph for r in rows)
    words = [w.strip(".") for r in rows for w in r.paragraph.split() if r.paragraph.endswith(".")]
    assert sum(w in WORDS for w in words) > 0.995 * len(words)


def test_empty(corpus):
    blocks, pages, _ = corpus
    assert findings(blocks.limit(0), pages.limit(0)).count() == 0


def test_shapes():
    assert shape("cliarneter", 0) == shape("diameter", 0)
    for word in ("during", "keeping", "interface", "uniform"):
        for a, b in MISREADS[:17]:
            if a in word and len(b) < 3:
                assert shape_edits(word, word.replace(a, b, 1)) <= 2


def test_boosting_column_equals_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 2))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    m = boosting.fit(x, y, ["a", "b"], trees=30)
    assert ((m.log_odds(x) > 0) == (y > 0)).mean() > 0.93
    df = spark.createDataFrame(x[:60].tolist(), "a double, b double").withColumn("p", m.column())
    assert np.allclose([r.p for r in df.collect()], m.log_odds(x[:60]))
    assert boosting.fit(np.zeros((0, 2)), np.zeros(0), ["a", "b"]).trees == []
