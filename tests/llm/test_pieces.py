import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.llm.pieces import _BREAK, _WORD, all_pieces, depths, split_items, split_text, unbroken_at


def joined(text, most, overlap):
    pieces = split_text(text, most, overlap)
    assert all(0 < b - a <= most for a, b, _ in pieces)
    assert all(pieces[k][1] - pieces[k + 1][0] == overlap and pieces[k + 1][1] > pieces[k][1] for k in range(len(pieces) - 1))
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    return pieces


@settings(max_examples=200, deadline=None)
@given(st.text("ab .\n#。", min_size=30, max_size=400), st.integers(8, 25), st.integers(0, 7))
def test_round_trip(text, most, overlap):
    pieces = joined(text, most, overlap)
    assert text == text[: pieces[0][1]] + "".join(text[pieces[k - 1][1] : pieces[k][1]] for k in range(1, len(pieces)))


def test_topic_change_is_cut():
    a = "The dye bath was heated and the dye was stirred into the bath. " * 8
    b = "Robots weld steel frames while robots paint steel panels nearby. " * 8
    cut = joined(a + b, len(a) + 100, 20)[0]
    assert cut[1] == len(a) and cut[2] == "sentence"


def test_kinds_of_cut():
    assert joined("x" * 100 + "\n\n# Head\n" + "y" * 60, 120, 10)[0][1:] == (102, "heading")
    assert joined("word " * 60, 100, 10)[0][2] == "word"
    assert joined("x" * 300, 100, 10)[0][1:] == (100, "hard")
    assert joined("中文句子。" * 60, 100, 10)[0][2] == "sentence"
    assert joined("ab1.25" * 60, 100, 10)[0][2] == "mark"
    assert [unbroken_at("ab cde。f", k, 9) for k in (1, 4, 5)] == [2, 3, 3]
    assert unbroken_at("x" * 50, 20, 5) == 10


@settings(max_examples=300, deadline=None)
@given(st.text("aab .\n。", min_size=30, max_size=300), st.integers(8, 25), st.integers(0, 7))
def test_hard_cuts_tell_long_stretches(text, most, overlap):
    hard = [unbroken_at(text, b, most + 1) for _, b, kind in split_text(text, most, overlap) if kind == "hard"]
    assert (max(hard, default=0) > most) == (max(map(len, _BREAK.split(text))) > most)


def test_chinese_topics_and_depths():
    assert _WORD.findall("中文 fiber") == ["中", "文", "fiber"]
    a, b = "染料溶液加热搅拌染料溶液。" * 30, "机器焊接钢板机器油漆钢板。" * 30
    assert joined(a + b, len(a) + 60, 20)[0][1] == len(a)
    assert depths([0.5, 0.2, 0.4, 0.1, 0.3]) == pytest.approx([0, 0.5, 0, 0.5, 0])


def test_bad_limits():
    with pytest.raises(ValueError):
        split_text("x", 10, 10)


def test_items(spark):
    df = spark.createDataFrame([(1, "a b. " * 100, "q"), (2, None, "q"), (3, "", "q"), (4, "z" * 200_000, "q"), (5, "𝒳" * 50, "q")], "item_id long, text string, piece_no string")
    got = split_items(df, 50, 5)
    assert {r.item_id for r in got.collect()} == {1, 4}
    assert all(len(r.piece_text) <= 50 for r in got.collect())
    assert got.where("item_id = 4").agg({"unbroken": "max"}).first()[0] > 50
    assert {r.item_id for r in all_pieces(df, 50, 5).collect()} == {1, 3, 4, 5}
    assert split_items(df.limit(0), 50, 5).count() == 0
