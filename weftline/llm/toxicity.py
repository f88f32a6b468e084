"""Abusive, hateful or sexual content, by maximum-scoring segments over learned log-odds.

1. Features are runs of one to three tokens of the labelled texts. How many labelled texts of a category and how
   many documents of the whole corpus hold a feature gives its log-odds, with a Dirichlet prior in proportion to the
   corpus. Only well supported odds count; what another category or plain text holds as often is held back. A short
   public list of single words (SEED) adds pseudo-counts; without labels it decides alone.
2. A token is worth the odds of the longest known run over it, shared among the run's tokens, so that "naked eye"
   speaks for itself and not for "naked". A linear scan finds every maximal segment of token scores; tokens of no known
   run cost NEUTRAL.
3. Sums are calibrated by extreme-value theory: the rate solves sum(p * exp(rate * s)) = 1 over the token scores met
   in all documents, and K comes from simulated texts of such tokens. E = K * tokens * exp(-rate * sum) is how many such
   segments a text of this length shows by chance. Segments with E <= MOST_E count; a document's score is the sum of
   -log10(E) over them, 0 if there are none; its least E-value ranks it at any other threshold.

Letters that are masked, repeated, spaced out or written as digits are undone where that gives a word of the model.

The model is bounded: at most LABELLED_DOCS labelled texts (a documented sample of the labels; the classifier alone is fit
on it) and MOST_FEATURES features. Counts, calibration and scan cover all documents and whole texts. Only counts of the
model's own features and of score values travel to the driver.

Defined results: null and blank texts have no row; labels of unknown documents or categories are ignored; without
any labels the seed words alone decide; repeated document rows count once.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.session import checkpointed

LABELLED_DOCS = 20_000
MOST_FEATURES = 100_000
MOST_WORDS = 3  # tokens of a feature
PRIOR = 5.0  # texts that the corpus's own share of a feature is worth
SUPPORT = 4.0  # least z-score of odds that count
HELD = 3  # labelled texts that odds rest on at least
LEAST = 2.3  # least odds that count, a standard error below their estimate: less is topic, not tone
NEUTRAL = -0.6
TOP = 5.0
SEED_COUNT = 2.0  # labelled texts that a seed word is worth
MOST_E = 1e-6
CATEGORIES = ("abusive", "hateful", "sexual")

# fixed values: a few common words by category
SEED = {
    "abusive": "idiot moron imbecile scumbag asshole bitch bastard arschloch connard",
    "hateful": "vermin subhuman untermensch ungeziefer vermine",
    "sexual": "porn porno xxx horny blowjob orgasm",
}

_JOIN = re.compile(r"(?<![^\W_])[^\W\d_](?:([ .\-_])[^\W\d_](?:\1[^\W\d_]){2,})(?![^\W_])")
_WORD = re.compile(r"[一-鿿]|(?:(?![一-鿿])[\w*@$#!])+(?:['’](?:(?![一-鿿])\w)+)?")
_HIDDEN = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")
_RUN = re.compile(r"(.)\1{2,}")
_DOUBLE = re.compile(r"(.)\1")
_ODD = re.compile(r"[*@$#!0-9]")
_LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}


class Words:
    """Comparable tokens, masks undone towards a bounded set of words."""

    def __init__(self, plain: set[str] | frozenset[str] = frozenset()):
        self.plain = frozenset(w for w in plain if len(w) > 2 and _ODD.search(w) is None) | {w for t in SEED.values() for w in t.split()}
        self.by_length: dict[int, list[str]] = {}
        for w in sorted(self.plain):
            self.by_length.setdefault(len(w), []).append(w)
        self.cache: dict[str, str] = {}

    def word(self, token: str) -> str:
        """A token without masks, digits for letters and repeated letters, if that gives a word of the set."""
        if token in self.plain:
            return token
        if _ODD.search(token) and re.search(r"[^\W\d]", token):
            bare = token.strip("!")
            read = "".join("." if c in "*#" else _LEET.get(c, re.escape(c)) for c in bare)
            if "." in read:
                fits = [w for w in self.by_length.get(len(bare), []) if re.fullmatch(read, w)]
                if fits:
                    return fits[0]
            elif read in self.plain:
                return read
            else:
                token = read if _RUN.search(read) else token
        for shape in (_RUN.sub(r"\1", token), _RUN.sub(r"\1\1", token), _DOUBLE.sub(r"\1", _RUN.sub(r"\1", token)), token[:-1] if token[-2:-1] == token[-1:] else token):
            if shape != token and shape in self.plain:
                return shape
        return token

    def tokens(self, text: str) -> list[str]:
        """Comparable tokens of a text; letters of scripts without spaces stand alone."""
        if not text.isascii():
            text = _HIDDEN.sub("", unicodedata.normalize("NFKC", text)).replace("’", "'")
        text = _JOIN.sub(lambda m: m.group().replace(m.group(1), ""), text.lower())
        out, cache = [], self.cache
        for t in _WORD.findall(text):
            p = cache.get(t)
            if p is None:
                p = self.word(t.strip("*@$#!") or t) if _ODD.search(t) is None else self.word(t)
                if len(cache) < 200_000:
                    cache[t] = p
            out.append(p)
        return out


def runs(words: list[str]) -> set[str]:
    """All distinct runs of one to MOST_WORDS tokens."""
    out = set(words)
    for n in range(2, MOST_WORDS + 1):
        out.update(map(" ".join, zip(*[words[k:] for k in range(n)])))
    return out


def known_runs(words: list[str], known: dict | set | frozenset, heads: set | frozenset) -> Iterator[tuple[int, int, str]]:
    """(place, length, run) of every known run; the longer ones of a place first."""
    last = len(words)
    for i, w in enumerate(words):
        if w in heads:
            for n in range(min(MOST_WORDS, last - i), 1, -1):
                p = " ".join(words[i : i + n])
                if p in known:
                    yield i, n, p
        if w in known:
            yield i, 1, w


class Model:
    """Scores of features by category."""

    def __init__(self, words: Words, labelled: dict[str, dict[str, int]], sizes: dict[str, int], counts: dict[str, int], total: int):
        """labelled: how many texts of each label hold a feature; sizes: texts of each label; counts, total: the same of the corpus."""
        self.words = words
        seeds = {c: set(SEED[c].split()) for c in CATEGORIES}
        self.scores: dict[str, dict[str, float]] = {c: {} for c in CATEGORIES}
        names = set(counts) | set().union(*seeds.values())
        for f in names:
            # features of texts never counted, as seeds that no document holds, have the share of half a document
            share = max(counts.get(f, 0), 0.5) / max(total, 1)
            held = {c: labelled.get(c, {}).get(f, 0) + SEED_COUNT * (f in seeds[c]) for c in CATEGORIES}
            rate = {c: (held[c] + PRIOR * share) / (sizes.get(c, 0) + PRIOR + SEED_COUNT) for c in CATEGORIES}
            for c in CATEGORIES:
                odds = math.log(rate[c] / share)
                odds -= max(0.0, max(math.log(rate[o] / rate[c]) for o in CATEGORIES if o != c))
                error = math.sqrt(1 / (held[c] + PRIOR * share) + 1 / max(counts.get(f, 0), 0.5))
                sure = odds >= SUPPORT * error and odds - error >= LEAST
                if f in seeds[c] or sure and held[c] >= HELD:
                    self.scores[c][f] = min(odds, TOP)
                elif counts.get(f, 0) >= 5:
                    # a run known not to be of the category speaks for itself, instead of the words in it
                    self.scores[c][f] = min(0.0, max(odds, -TOP / 2))
        # a run says nothing new where no word of it is in doubt
        hot = {c: {w for f, s in self.scores[c].items() if s > 0 for w in f.split(" ")} for c in CATEGORIES}
        for c in CATEGORIES:
            self.scores[c] = {f: s for f, s in self.scores[c].items() if s > 0 or " " in f and any(w in hot[c] for w in f.split(" "))}
        self.known: dict[str, tuple[float | None, ...]] = {}
        for f in {f for c in CATEGORIES for f in self.scores[c]}:
            self.known[f] = tuple(self.scores[c].get(f) for c in CATEGORIES)
        self.heads = frozenset(f.split(" ")[0] for f in self.known if " " in f)
        self.any = frozenset(f.split(" ")[0] for f in self.known)

    def values(self, words: list[str]) -> list[dict[int, float]]:
        """Per category the score of every place that a known run covers: that of the longest run, the highest of equals."""
        at: list[dict[int, tuple[int, float]]] = [{} for _ in CATEGORIES]
        if not self.any.isdisjoint(words):
            for i, n, f in known_runs(words, self.known, self.heads):
                for k, s in enumerate(self.known[f]):
                    if s is not None:
                        for j in range(i, i + n):
                            if (n, s / n) > at[k].get(j, (0, 0.0)):
                                at[k][j] = (n, s / n)
        return [{j: s for j, (_, s) in a.items()} for a in at]


def segments(at: dict[int, float]) -> list[tuple[float, int, int]]:
    """(score, first token, last token) of every maximal scoring segment, found in linear time."""
    # candidates with their cumulative scores to the left and right, merged as in the linear-time algorithm
    stack: list[tuple[float, float, int, int]] = []
    run, last = 0.0, -1
    for i in sorted(at):
        run += NEUTRAL * (i - last - 1)
        before = run
        run += at[i]
        last = i
        if run <= before:
            continue
        item = (before, run, i, i)
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][0] >= item[0]:
                j -= 1
            if j < 0 or stack[j][1] >= item[1]:
                stack.append(item)
                break
            item = (stack[j][0], item[1], stack[j][2], i)
            del stack[j:]
    return [(r - l, a, b) for l, r, a, b in stack]


def calibrate(values: dict[float, int]) -> tuple[float, float]:
    """(rate, K) of token scores: the positive root of sum(p * exp(rate * s)) = 1, and K by simulation.

    ``values`` counts the tokens of each score in all documents. Where no score is above 0 nothing is ever
    found; the rate is then 1 and K 1.
    """
    total = sum(values.values())
    s = np.array(sorted(values))
    if not total or s.max(initial=0.0) <= 0:
        return 1.0, 1.0
    p = np.array([values[x] for x in sorted(values)]) / total
    if float((p * s).sum()) >= 0:
        raise ValueError("token scores of the corpus are positive on average; nothing could stand out")
    lo, hi = 1e-6, 1.0
    while float((p * np.exp(hi * s)).sum()) < 1:
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if float((p * np.exp(mid * s)).sum()) < 1 else (lo, mid)
    rng = np.random.default_rng(11)
    # drawn with the tilted law, under which long runs are common, and weighed back: P(max >= x) ~ C exp(-rate x)
    tilt = p * np.exp(lo * s)
    walk = np.cumsum(rng.choice(s, size=(4000, 400), p=tilt / tilt.sum()), axis=1)
    level = 3 * float(s.max())
    over = walk >= level
    reached = over.any(1)
    first = walk[np.arange(len(walk)), over.argmax(1)][reached]
    c = float(np.exp(-lo * (first - level)).mean()) if reached.any() else 1.0
    # a walk from each place counts once per excursion: the share of places where a new least sum stands begins one
    plain = np.cumsum(rng.choice(s, size=(200, 2000), p=p), axis=1)
    low = np.minimum.accumulate(np.concatenate([np.zeros((200, 1)), plain], axis=1), axis=1)
    begin = float((plain < low[:, :-1]).mean())
    return lo, max(begin * c, 1e-6)


def sample_labels(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, text), distinct, of at most LABELLED_DOCS labelled documents."""
    known = labels.where(F.col("label").isin("ok", *CATEGORIES)).select("doc_id", "label").distinct()
    sample = known.orderBy(F.xxhash64("doc_id"), "label").limit(LABELLED_DOCS)
    docs = documents.select("doc_id", "text").where("text IS NOT NULL AND trim(text) <> ''")
    return docs.join(F.broadcast(sample), "doc_id").select("label", "text").distinct()


def _emitted(texts: DataFrame, words: Words, keep: frozenset[str] | None) -> DataFrame:
    """(label, feature, n): how many texts of each label hold each run; ``keep`` restricts them; the feature "" counts texts."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sums: Counter = Counter()
            for label, t in zip(batch["label"], batch["text"]):
                ws = words.tokens(t)
                found = set(ws) if keep is None else {r for r in runs(ws) if not keep.isdisjoint(r.split(" "))}
                sums.update((label, r) for r in found)
                sums[label, ""] += 1
            if sums:
                yield pd.DataFrame([(c, r, n) for (c, r), n in sums.items()], columns=["label", "feature", "n"])

    return texts.mapInPandas(count, "label string, feature string, n long").groupBy("label", "feature").agg(F.sum("n").alias("n"))


def _doubtful(rows: list, bar: float) -> set[str]:
    """Features that the texts of some category hold much more often than those found to be in order."""
    by: dict[str, Counter] = {}
    for r in rows:
        by.setdefault(r.label, Counter())[r.feature] = r.n
    ok = by.get("ok", Counter())
    out = set()
    for c in CATEGORIES:
        n = by.get(c, Counter())
        for f, k in n.items():
            if f and k >= 2 and math.log((k / n[""]) / ((ok[f] + 0.5) / (ok[""] + 1))) > bar:
                out.add(f)
    return out


def fit(documents: DataFrame, labels: DataFrame) -> Model:
    """The model for a corpus: labelled texts (a bounded sample), and counts over all documents."""
    texts = checkpointed(sample_labels(documents, labels))
    # words that two texts of a category share; masked ones are read as these
    first = _emitted(texts, Words(), None)
    rows = first.where("label <> 'ok' AND n >= 2 OR feature = ''").orderBy(F.desc("n"), "feature", "label").limit(MOST_FEATURES).collect()
    words = Words({r.feature for r in rows})
    again = checkpointed(_emitted(texts, words, None))
    seen = again.where("label <> 'ok' AND n >= 2 AND feature <> ''").select("feature").distinct()
    rows = again.join(seen.union(seen.sparkSession.createDataFrame([("",)], "feature string")), "feature").orderBy(F.desc("n"), "feature", "label").limit(MOST_FEATURES).collect()
    hot = frozenset(_doubtful(rows, 1.0) | {w for t in SEED.values() for w in t.split()})
    # runs around these words: those of two texts of a category, and those of texts found to be in order
    held = _emitted(texts, words, hot).where("n >= 2 OR label = 'ok' OR feature = ''").orderBy((F.col("label") == "ok"), F.desc("n"), "feature").limit(MOST_FEATURES).collect()
    labelled: dict[str, dict[str, int]] = {}
    for r in held:
        labelled.setdefault(r.label, {})[r.feature] = r.n
    sizes = {c: n.pop("", 0) for c, n in labelled.items()}
    names = frozenset(f for n in labelled.values() for f in n) | hot
    heads = frozenset(f.split(" ")[0] for f in names if " " in f)
    any_ = frozenset(f.split(" ")[0] for f in names)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: Counter = Counter()
        for batch in batches:
            for t in batch["text"]:
                ws = words.tokens(t)
                sums[""] += 1
                if not any_.isdisjoint(ws):
                    sums.update({r for _, _, r in known_runs(ws, names, heads)})
        if sums:
            yield pd.DataFrame({"feature": list(sums), "n": list(sums.values())})

    docs = documents.select("text").where("text IS NOT NULL AND trim(text) <> ''")
    counts = {r.feature: r.n for r in docs.mapInPandas(count, "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()}
    total = counts.pop("", 0)
    return Model(words, labelled, sizes, counts, total)


def score_all(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, source, category, score, e_value, passage): a row per document that is not blank and category.

    Documents without significant content have score 0 and are told apart by their best E-value.
    """
    model = fit(documents, labels)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: Counter = Counter()
        for batch in batches:
            out = []
            for i, source, t in zip(batch["doc_id"], batch["source"], batch["text"]):
                ws = model.words.tokens(t)
                for c, at in zip(CATEGORIES, model.values(ws)):
                    found = segments(at)
                    best, a, b = max(found, default=(0.0, 0, -1))
                    out.append((i, source, c, len(ws), [s for s, _, _ in found], best, " ".join(ws[a : b + 1]), 0.0, 0))
                    sums.update((c, round(s, 2)) for s in at.values())
                    sums[c, NEUTRAL] += len(ws) - len(at)
            yield pd.DataFrame(out, columns=names)
        if sums:
            yield pd.DataFrame([(None, None, c, 0, [], 0.0, "", s, n) for (c, s), n in sums.items()], columns=names)

    schema = "doc_id long, source string, category string, tokens long, segments array<double>, best double, passage string, value double, times long"
    names = [c.split(" ")[0] for c in schema.split(", ")]
    docs = documents.select("doc_id", "source", "text").where(F.col("text").rlike(r"\S"))
    rows = checkpointed(docs.mapInPandas(scan, schema))
    values: dict[str, dict[float, int]] = {c: {} for c in CATEGORIES}
    for r in rows.where("times > 0").groupBy("category", "value").agg(F.sum("times").alias("n")).collect():
        values[r.category][r.value] = r.n
    law = {c: calibrate(values[c]) for c in CATEGORIES}
    pick = lambda k: F.element_at(F.create_map(*[x for c in CATEGORIES for x in (F.lit(c), F.lit(float(law[c][k])))]), F.col("category"))
    # logarithms, as the E-value of a very long passage is smaller than any number
    chance = F.log(pick(1) * F.greatest("tokens", F.lit(20)))
    logs = F.transform("segments", lambda s: chance - pick(0) * s)
    counted = F.filter(logs, lambda e: e <= math.log(MOST_E))
    score = F.aggregate(counted, F.lit(0.0), lambda acc, e: acc - e / math.log(10))
    found = rows.where("times = 0").select("doc_id", "source", "category", score.alias("score"), F.exp(chance - pick(0) * F.col("best")).alias("e_value"), "passage")
    return found.dropDuplicates(["doc_id", "category"])


def score_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``score_all`` for categories present: an E-value of at most MOST_E."""
    return score_all(documents, labels).where(F.col("e_value") <= MOST_E)


def rates(documents: DataFrame, scored: DataFrame) -> DataFrame:
    """(source, category, documents, found, rate) for every source and category, also those never found."""
    n = documents.select("doc_id", "source").dropDuplicates(["doc_id"]).groupBy("source").agg(F.count("*").alias("documents"))
    n = n.select("source", "documents", F.explode(F.array(*[F.lit(c) for c in CATEGORIES])).alias("category"))
    f = scored.groupBy(F.col("source").alias("s"), F.col("category").alias("c")).agg(F.count("*").alias("found"))
    out = n.join(f, n.source.eqNullSafe(f.s) & (n.category == f.c), "left")
    found = F.coalesce("found", F.lit(0))
    return out.select("source", "category", "documents", found.alias("found"), F.round(found / F.col("documents"), 6).alias("rate"))
