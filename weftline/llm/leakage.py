"""Evaluation texts leaking into training text, by suffix arrays over shards of the corpus.

Words are runs of one script's letters or digits, without case, accents' form, punctuation or spacing. A shard is
a bounded number of documents of one partition. Its suffix array holds every word place that begins a stretch of test
words, in the order of the words that follow, by prefix doubling up to the longest test item; the ranks of each doubling
are kept, so that the common prefix of any two places is found in as many steps as there were doublings. Every suffix of
every test item is binary-searched in that order; its neighbours there share its longest prefix, and from them the search
walks on while at least MIN_STRETCH words are shared. Matches that could be prolonged to the left are dropped, as a longer
suffix finds them whole. A document holds an item if stretches in the same order in both, not further apart than MOST_GAP
allows, cover at least half of the item's words.

The stated query set (the test items, a reference table) goes to every shard in parts of at most MAX_ITEM_BYTES; larger
sets are searched part by part. Items are matched in blocks, so that a shard never holds more than MAX_HITS matches and
those of one item. No corpus document is ever shuffled or sent to the driver.

Defined results: null and blank texts hold nothing; items of fewer than MIN_STRETCH words are found where they stand
whole; equal items are each reported; repeated documents rows count once; an empty table on either side gives no rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_STRETCH = 5  # words; shorter stretches are common phrases, which items of one template share
SHARE = 0.5
MOST_GAP = 40  # words between two stretches of a document beyond those between them in the item
SHARD_WORDS = 1_500_000
MAX_HITS = 2_000_000
MAX_ITEM_BYTES = 64 << 20  # bound of the test items that every task reads at a time

_WORD = re.compile(r"[a-z0-9à-öø-ɏ]+|[^\W_a-z0-9à-öø-ɏ]")
_INVISIBLE = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")


def words(text: str) -> list[str]:
    """Comparable words of a text; a letter of a script without spaces is a word of its own."""
    if not text.isascii():
        text = _INVISIBLE.sub("", unicodedata.normalize("NFKC", text))
    return _WORD.findall(text.lower())


class Items:
    """The test items as numbers, one after the other with a 0 behind each."""

    def __init__(self, rows: list[tuple[int, str]]):
        split = [(i, ws) for i, ws in ((i, words(t)) for i, t in rows) if ws]
        self.ids = [i for i, _ in split]
        self.vocabulary: dict[str, int] = {}
        for _, ws in split:
            for w in ws:
                self.vocabulary.setdefault(w, len(self.vocabulary) + 1)
        self.lengths = np.array([len(ws) for _, ws in split], dtype=np.int64)
        self.least = np.minimum(self.lengths, MIN_STRETCH)
        self.flat = np.array([n for _, ws in split for n in [*[self.vocabulary[w] for w in ws], 0]], dtype=np.int64)
        starts = np.cumsum([0, *(self.lengths + 1)])[:-1]
        counts = self.lengths - self.least + 1
        self.item = np.repeat(np.arange(len(split)), counts)
        self.offset = np.arange(len(self.item)) - np.repeat(np.cumsum(counts) - counts, counts)
        self.place = starts[self.item] + self.offset if len(self.item) else self.item
        self.longest = int(self.lengths.max(initial=0))
        self.shortest = int(self.least.min(initial=MIN_STRETCH))

    def encode(self, ws: list[str]) -> np.ndarray:
        """Words as numbers, 0 for those that no item has."""
        get = self.vocabulary.get
        return np.fromiter((get(w, 0) for w in ws), dtype=np.int64, count=len(ws))


class SuffixOrder:
    """The places of an array of word numbers in the order of the words that follow, up to ``longest`` of them.

    ``a`` holds 0 for a word that no item has; nothing is common beyond one. Ends in a 0.
    """

    def __init__(self, a: np.ndarray, longest: int):
        self.a = a
        n = len(a)
        live = np.flatnonzero(a > 0)
        rank, step = a.astype(np.int64), 1
        self.levels = [rank]
        while step < longest and len(live):
            nxt = np.where(live + step < n, rank[np.minimum(live + step, n - 1)], 0)
            values, inverse = np.unique(rank[live] * (int(rank.max()) + 1) + nxt, return_inverse=True)
            # a place followed by fewer words than the step still sorts before those followed by more
            rank = np.zeros(n, dtype=np.int64)
            rank[live] = inverse + 1
            self.levels.append(rank)
            step *= 2
        self.rank = rank

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many words follow alike from places x and y."""
        n = len(self.a)
        length = np.zeros(len(x), dtype=np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            rank, step = self.levels[level], 1 << level
            while True:
                p, q = x + length, y + length
                inside = (p + step <= n) & (q + step <= n)
                r = rank[np.minimum(p, n - 1)]
                same = inside & (r > 0) & (r == rank[np.minimum(q, n - 1)]) & self._full(p, step)
                length += same * step
                # the top level may repeat, as two texts may share more than the longest item
                if level < len(self.levels) - 1 or not same.any():
                    break
        return length

    def _full(self, p: np.ndarray, step: int) -> np.ndarray:
        """Whether ``step`` words of the items follow from p without a 0 between."""
        if not hasattr(self, "_until"):
            zero = np.flatnonzero(self.a == 0)
            at = np.searchsorted(zero, np.arange(len(self.a)))
            self._until = np.append(zero, len(self.a))[at]
        return p + step <= self._until[np.minimum(p, len(self.a) - 1)]


def covered(stretches: list[tuple[int, int, int]], least: int, most_gap: int) -> int:
    """Most item words that stretches (item offset, document place, length) cover, in order and near each other in both.

    Linear in the stretches of a document for a given gap: only those that end near enough before are looked at.
    """
    stretches = sorted(stretches, key=lambda s: (s[1], s[0]))
    longest = max(n for _, _, n in stretches)
    best: list[int] = []
    first, top_all = 0, 0
    for k, (o, p, n) in enumerate(stretches):
        top = n
        while stretches[first][1] + longest + most_gap + (o + n) < p:
            first += 1
        for j in range(first, k):
            o2, p2, n2 = stretches[j]
            if o2 < o and p2 < p and (p - p2 - n2) - max(0, o - o2 - n2) <= most_gap:
                cut = max(0, o2 + n2 - o, p2 + n2 - p)
                if n - cut >= least:
                    top = max(top, best[j] + n - cut)
        best.append(top)
        top_all = max(top_all, top)
    return top_all


def match_shard(ids: list[int], texts: list[np.ndarray], items: Items) -> Iterator[tuple[int, int, float, int, int, int]]:
    """(document, item, share covered, longest verbatim match, its word place, the item's offset) of one shard."""
    bounds = np.cumsum([0, *[len(t) + 1 for t in texts]])
    size = int(bounds[-1])
    a = np.zeros(size + len(items.flat), dtype=np.int64)
    for k, t in enumerate(texts):
        a[bounds[k] : bounds[k] + len(t)] = t
    a[size:] = items.flat
    keep = a[:size] > 0
    for k in range(1, items.shortest):
        keep[: size - k] &= a[k:size] > 0
    at = np.flatnonzero(keep)
    if not len(at) or not len(items.item):
        return
    order = SuffixOrder(a, items.longest)
    sa = at[np.argsort(order.rank[at], kind="stable")]
    # runs of neighbours that share enough words to be a match
    joined = order.common(sa[:-1], sa[1:]) >= items.shortest
    run = np.concatenate([[0], np.cumsum(~joined)])
    run_start = np.concatenate([[0], np.flatnonzero(~joined) + 1])
    run_end = np.append(run_start[1:], len(sa))
    # every test suffix: where it would stand, and which of its two neighbours shares enough with it
    mine_all = items.place + size
    where = np.searchsorted(order.rank[sa], order.rank[mine_all], "left")
    left, right = np.maximum(where - 1, 0), np.minimum(where, len(sa) - 1)
    near_l, near_r = order.common(mine_all, sa[left]) >= items.shortest, order.common(mine_all, sa[right]) >= items.shortest
    hit = near_l | near_r
    group = np.where(near_r, run[right], run[left])
    count = np.where(hit, run_end[group] - run_start[group], 0)
    per_item = np.bincount(items.item, weights=count, minlength=len(items.ids)).astype(np.int64)
    block = np.cumsum(per_item) // MAX_HITS
    for b in np.unique(block[per_item > 0]):
        chosen = np.flatnonzero((block[items.item] == b) & (count > 0))
        parts = [_maximal(chosen[c], count, run_start, group, sa, a, mine_all, order, items) for c in _slices(count[chosen])]
        suffix, place, length = (np.concatenate(x) for x in zip(*parts))
        doc = np.searchsorted(bounds, place, "right") - 1
        item = items.item[suffix]
        rows = np.lexsort((item, doc))
        doc, item, place, suffix, length = doc[rows], item[rows], place[rows], suffix[rows], length[rows]
        if not len(doc):
            continue
        edges = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])])
        sums = np.add.reduceat(length, edges)
        for e, end, total in zip(edges, np.r_[edges[1:], len(doc)], sums):
            n = items.lengths[item[e]]
            need = SHARE * n if n >= MIN_STRETCH else n
            if total < need:
                continue
            spans = list(zip(items.offset[suffix[e:end]].tolist(), (place[e:end] - bounds[doc[e]]).tolist(), length[e:end].tolist()))
            got = covered(spans, int(items.least[item[e]]), MOST_GAP)
            if got >= need:
                o, p, m = max(spans, key=lambda s: (s[2], -s[1]))
                yield ids[doc[e]], items.ids[item[e]], float(got / n), m, p, o


def _slices(counts: np.ndarray) -> Iterator[np.ndarray]:
    """Places of ``counts`` in runs whose sum is at most MAX_HITS, or of one place."""
    if len(counts):
        part = np.cumsum(counts) // MAX_HITS
        for k in np.unique(part):
            yield np.flatnonzero(part == k)


def _maximal(chosen, count, run_start, group, sa, a, mine_all, order, items):
    """(suffix, document place, length) of the matches of some test suffixes that cannot be prolonged to the left."""
    n = count[chosen]
    suffix = np.repeat(chosen, n)
    inside = np.arange(len(suffix)) - np.repeat(np.cumsum(n) - n, n)
    place = sa[run_start[group[suffix]] + inside]
    mine = mine_all[suffix]
    before = (items.offset[suffix] > 0) & (place > 0) & (a[np.maximum(place - 1, 0)] > 0)
    begin = ~(before & (a[mine - 1] == a[np.maximum(place - 1, 0)]))
    suffix, place, mine = suffix[begin], place[begin], mine[begin]
    length = order.common(mine, place)
    enough = length >= items.least[items.item[suffix]]
    return suffix[enough], place[enough], length[enough]


def leaked_items(documents: DataFrame, eval_items: DataFrame) -> DataFrame:
    """(doc_id, item_id, share, longest_match, word_place, item_offset): every document that holds an item."""
    known = eval_items.select("item_id", "text").where("text IS NOT NULL AND item_id IS NOT NULL")
    size = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // MAX_ITEM_BYTES))
    mine = lambda k: known.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == k) if parts > 1 else known
    # a repeated row may stand in two shards; the findings, far fewer than the documents, are made distinct
    return reduce(DataFrame.unionByName, (_search(documents, sorted({(r.item_id, r.text) for r in mine(k).collect()})) for k in range(parts))).distinct()


def _search(documents: DataFrame, rows: list[tuple[int, str]]) -> DataFrame:
    schema = "doc_id long, item_id long, share double, longest_match int, word_place int, item_offset int"
    docs = documents.select("doc_id", "text").where("text IS NOT NULL AND trim(text) <> ''")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items = Items(rows)
        ids: list[int] = []
        texts: list[np.ndarray] = []
        held = 0

        def shard() -> Iterator[pd.DataFrame]:
            if found := list(match_shard(ids, texts, items)):
                yield pd.DataFrame(found, columns=["doc_id", "item_id", "share", "longest_match", "word_place", "item_offset"])

        for batch in batches:
            for i, t in zip(batch["doc_id"], batch["text"]):
                ids.append(i)
                texts.append(items.encode(words(t)))
                held += len(texts[-1])
                if held >= SHARD_WORDS:
                    yield from shard()
                    ids, texts, held = [], [], 0
        if ids:
            yield from shard()

    return docs.mapInPandas(search, schema)


def without_leaks(documents: DataFrame, leaks: DataFrame) -> DataFrame:
    """The documents that hold no item."""
    return documents.join(leaks.select("doc_id").distinct(), "doc_id", "left_anti")
