"""Splitting oversized items at natural boundaries, by lexical cohesion.

A text longer than ``max_chars`` is cut into pieces no longer than that; the next piece begins ``overlap`` characters
before the last one ends, so consecutive pieces share exactly that many. Where a piece may end, every natural place is
weighed: the similarity of the words of the blocks before and after it falls into a valley at a change of topic.
Within each size window the deepest valley is cut, headings and paragraphs counting as deeper than sentences. Windows
without a sentence end are cut after a word, those without white space after a mark, the rest wherever the limit
falls ("hard").

All characters are Unicode code points. Long texts are streamed through Python one at a time, only those above the
limit; the filter runs in the JVM, there is no shuffle. The work per text is linear in its length.

Defined results: null texts give no piece; texts within the limit (also empty ones) give one piece; a limit not
above the overlap is an error.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_WORDS = 40  # words on either side of a place that are compared
LEAST_FILL = 0.5  # of the room in a window: the window of each cut begins there

_PLACE = re.compile(r"(?P<p>\n\s*\n\s*|\n(?=#{1,6}\s))|(?P<l>\n\s*)|(?P<s>(?:[.!?;]+[\"')\]”’]*(?=\s)\s*|[。！？；]+[”’」』]*\s*))")
_WORD = re.compile(r"[一-鿿]|[^\W\d_一-鿿]{3,}")
_BREAK = re.compile(r"[\s.!?;。！？；]")
_SPACE = re.compile(r"\s+")
_SENTENCE_MARK = re.compile(r"[.!?;。！？；]")
_BONUS = {"heading": 1.0, "paragraph": 0.4, "line": 0.2, "sentence": 0.0}


def unbroken_at(text: str, place: int, most: int) -> int:
    """Length of the stretch without white space or a sentence mark around a place within it; counted up to ``most`` on either side."""
    right = _BREAK.search(text, place, min(len(text), place + most))
    after = (right.start() if right else min(len(text), place + most)) - place
    before = 0
    while before < most and place - before > 0 and not _BREAK.match(text[place - before - 1]):
        before += 1
    return before + after


def natural_places(text: str) -> tuple[list[int], list[str]]:
    """Places after which a piece may end, in order, with their kinds."""
    at, kinds = [], []
    for m in _PLACE.finditer(text):
        end = m.end()
        if end >= len(text):
            continue
        if m.lastgroup in ("p", "l") and text[end] == "#":
            kind = "heading"
        else:
            kind = {"p": "paragraph", "l": "line", "s": "sentence"}[m.lastgroup]
        if at and at[-1] == end:
            kinds[-1] = max(kind, kinds[-1], key=_BONUS.get)
        else:
            at.append(end)
            kinds.append(kind)
    return at, kinds


def depths(scores: list[float]) -> list[float]:
    """How deep each place lies below the nearest peaks of similarity on its left and right."""
    n = len(scores)
    left, right = list(scores), list(scores)
    # a peak is where climbing from a place ends
    for i in range(1, n):
        left[i] = left[i - 1] if scores[i - 1] >= scores[i] else scores[i]
    for i in range(n - 2, -1, -1):
        right[i] = right[i + 1] if scores[i + 1] >= scores[i] else scores[i]
    return [left[i] + right[i] - 2 * scores[i] for i in range(n)]


def split_text(text: str, max_chars: int, overlap: int) -> list[tuple[int, int, str]]:
    """(begin, end, kind of cut) of each piece."""
    if not 0 <= overlap < max_chars:
        raise ValueError("the overlap must be below max_chars")
    n = len(text)
    if n <= max_chars:
        return [(0, n, "end")]
    at, kinds = natural_places(text)

    def cohesion(k: int) -> float:
        """Likeness of the blocks of words before and after the natural place k."""
        after = {m.group().lower() for m in islice(_WORD.finditer(text, at[k]), BLOCK_WORDS)}
        reach, before = 8 * BLOCK_WORDS, []
        while True:  # as far back as it takes to find the block's words
            before = _WORD.findall(text, max(0, at[k] - reach), at[k])
            if len(before) >= BLOCK_WORDS or reach >= at[k] or reach >= 2 * max_chars:
                break
            reach *= 2
        a = {w.lower() for w in before[-BLOCK_WORDS:]}
        return 2 * len(a & after) / (len(a) + len(after)) if a and after else 0.0

    similar: dict[int, float] = {}
    pieces, begin = [], 0
    while n - begin > max_chars:
        top = begin + max_chars
        room = max_chars - overlap
        last_end = pieces[-1][1] if pieces else 0
        low = max(begin + overlap + max(1, int(room * LEAST_FILL)), last_end + 1)
        end, kind = 0, ""
        for floor in (low, max(begin + overlap + 1, last_end + 1)):
            lo, hi = bisect_left(at, floor), bisect_right(at, top)
            if lo < hi:
                for k in range(lo, hi):
                    if k not in similar:
                        similar[k] = cohesion(k)
                depth = [d + _BONUS[kinds[k]] for k, d in zip(range(lo, hi), depths([similar[k] for k in range(lo, hi)]))]
                best = max(range(hi - lo), key=lambda i: (depth[i], i))
                end, kind = at[lo + best], kinds[lo + best]
                break
            for name, pattern in (("word", _SPACE), ("mark", _SENTENCE_MARK)):
                last = None
                for m in pattern.finditer(text, floor - 1, top):
                    last = m
                if last and floor <= last.end() <= top:
                    end, kind = last.end(), name
                    break
            if end:
                break
        if not end:
            end, kind = top, "hard"
        pieces.append((begin, end, kind))
        begin = end - overlap
    pieces.append((begin, n, "end"))
    return pieces


def split_items(items: DataFrame, max_chars: int, overlap: int, key: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, n_chars, piece_no, piece_begin, piece_end, cut_kind, unbroken, piece_text) of every longer text.

    unbroken: at a hard cut the length of the stretch it cuts, without white space or sentence mark; else 0. A stretch
    longer than the limit is always cut hard, as no other place lies in it.
    """
    long = items.select(F.col(key).alias("item_id"), F.col(text).alias("text")).where(F.char_length("text") > max_chars)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["item_id", "n_chars", "piece_no", "piece_begin", "piece_end", "cut_kind", "unbroken", "piece_text"]
        for batch in batches:
            out = []
            for i, t in zip(batch["item_id"], batch["text"]):
                for k, (a, b, kind) in enumerate(split_text(t, max_chars, overlap), 1):
                    out.append((i, len(t), k, a, b, kind, unbroken_at(t, b, max_chars + 1) if kind == "hard" else 0, t[a:b]))
            if out:
                yield pd.DataFrame(out, columns=names)

    return long.mapInPandas(cut, "item_id long, n_chars int, piece_no int, piece_begin int, piece_end int, cut_kind string, unbroken int, piece_text string")


def all_pieces(items: DataFrame, max_chars: int, overlap: int, key: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, piece_no, cut_kind, piece_text) of every non-null text, long or not."""
    short = items.select(F.col(key).alias("item_id"), F.col(text).alias("t")).where(F.char_length("t") <= max_chars)
    short = short.select("item_id", F.lit(1).alias("piece_no"), F.lit("end").alias("cut_kind"), F.col("t").alias("piece_text"))
    return short.unionByName(split_items(items, max_chars, overlap, key, text).select("item_id", "piece_no", "cut_kind", "piece_text"))
