"""Noise in text from scanned pages: broken words, misread characters, running headers, page numbers.

Words. The vocabulary is counted over all blocks. Words that are not frequent look for what they may have been through
an inverted join on padded character trigrams; gradient-boosted trees rank the candidates (edits, edits left after
letters that scans confuse are folded, shared trigrams, counts, length) and decide whether the best replaces the word.
The trees learn from words of the corpus itself, misread on purpose.

Lines. Boosted trees over pairs of lines decide the rest: for a line that ends in a hyphen and the next one, whether the
word is joined with or without it; for the first and last line of a page and those of the pages around it, whether
it is a running header or a page number. The first learns from corpus words broken on purpose, the second from the
blocks' own types, which name only part of the furniture (positive and unlabelled lines).

Bounds: models are fit on the driver from at most SAMPLE_WORDS words and SAMPLE_LINES lines. Only words that make up at
least one FREQUENT-th of all words, so at most FREQUENT of them, are broadcast. Everything else covers all rows by equality joins on words or
on (paper, page); no task ever holds a paper.

Defined results: null and blank texts are untouched and have no findings; numbers are never corrected; words on furniture
lines are not corrected; without a single typed header no line is furniture; repeated rows count once.
"""

from __future__ import annotations

import random
import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm import boosting
from weftline.session import checkpointed

SAMPLE_WORDS = 2000
SAMPLE_LINES = 20_000
FREQUENT = 10_000
SCANNED_SHARE = 0.5  # of a paper's longer blocks that are broken into lines
#: words rarer than 1 in this many are not offered as corrections
CANDIDATE = 200_000
#: nor are words rarer than 1 in this many examples to learn from
EXAMPLE = 50_000

_BREAK = r"(?<=\p{L})(?:-|\xAD|¬)[ \t]?\n\s*"
_MARK = "\ue000"  # stands for a break within a word
_EDGE = r"^[^\p{L}\p{Nd}@]+|[^\p{L}\p{Nd}@]+$"

# fixed values: what scans read for what is printed
MISREADS = [
    ("d", "cl"), ("m", "rn"), ("n", "ri"), ("u", "ii"), ("w", "vv"), ("in", "m"), ("o", "0"), ("l", "1"), ("i", "l"), ("i", "1"), ("l", "i"), ("s", "5"),
    ("b", "6"), ("g", "9"), ("a", "@"), ("t", "f"), ("h", "b"), ("e", "c"), ("fi", "ﬁ"), ("fl", "ﬂ"), ("ff", "ﬀ"), ("m", "nn"), ("q", "g"), ("h", "li"), ("rn", "m"), ("O", "0"), ("I", "l"), ("S", "5"), ("B", "8"),
]
# fixed values: one shape for letters that scans confuse, applied in this order to both words; a second order, as folds overlap
SHAPES = [
    [("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("cl", "d"), ("rn", "m"), ("ri", "n"), ("in", "m"), ("ii", "u"), ("vv", "w"), ("li", "h"), ("nn", "m")],
    [("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("in", "m"), ("cl", "d"), ("rn", "m"), ("ri", "n"), ("in", "m"), ("ii", "u"), ("vv", "w")],
]
SHAPE_LETTERS = ("0O1iI569@fbcq8", "oolllsbgathegB")


def shape(word: str, order: int) -> str:
    """``shape_column`` for one word."""
    for a, b in SHAPES[order]:
        word = word.replace(a, b)
    return word.translate({ord(x): y for x, y in zip(*SHAPE_LETTERS)})


def shape_column(col: Column, order: int) -> Column:
    """A word with letters that scans confuse folded to one shape."""
    for a, b in SHAPES[order]:
        col = F.replace(col, F.lit(a), F.lit(b))
    return F.translate(col, *SHAPE_LETTERS)


def shape_edits(a: str, b: str) -> int:
    """Edits between the shapes of two words."""
    return min(_edits(shape(a, k), shape(b, k)) for k in range(len(SHAPES)))


def grams(col: Column) -> Column:
    """Distinct padded trigrams of a word."""
    p = F.concat(F.lit("  "), col, F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substr(p, i, F.lit(3))))


def _core(col: Column) -> Column:
    return F.regexp_replace(col, _EDGE, "")


def marked(text: Column) -> Column:
    """A text with _MARK for every line break within a word; linear in its length, and free for texts of one line."""
    return F.when(F.contains(text, F.lit("\n")), F.regexp_replace(text, _BREAK, _MARK)).otherwise(text)


def token_counts(blocks: DataFrame) -> DataFrame:
    """(token, n): every token between white space of all blocks, as it stands."""
    tokens = blocks.where("text IS NOT NULL").select(F.explode(F.split(marked(F.col("text")), r"\s+")).alias("token"))
    return tokens.groupBy("token").agg(F.count("*").alias("n"))


def vocabulary(tokens: DataFrame) -> DataFrame:
    """(word, n): the words of ``token_counts``, split at slashes, without adjoining punctuation; broken ones left out."""
    whole = tokens.where(~F.contains("token", F.lit(_MARK)))
    words = whole.select(F.explode(F.split(_core(F.col("token")), "/")).alias("word"), "n").where("word <> ''")
    return words.groupBy("word").agg(F.sum("n").alias("n"))


RANK = ["edits", "shape_edits", "shared", "more", "longer", "size", "odd"]


def _sample(vocab: DataFrame, total: int) -> list[tuple[str, int]]:
    # words too rare to be told from misread ones are no examples
    top = vocab.where(F.col("word").rlike(r"^[\p{L}][\p{L}-]{2,}$") & (F.col("n") >= max(5, total // EXAMPLE))).orderBy(F.desc("n"), "word").limit(SAMPLE_WORDS)
    return [(r.word, r.n) for r in top.collect()]


def _edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def _grams(w: str) -> set[str]:
    p = f"  {w} "
    return {p[i : i + 3] for i in range(len(p) - 2)}


def train_ranker(sample: list[tuple[str, int]], seed: int = 5) -> boosting.Boosted:
    """Ranks (word, candidate) pairs; learns from words of the sample misread on purpose."""
    rng = random.Random(seed)
    counts = dict(sample)
    index: dict[str, list[str]] = {}
    for w in counts:
        for g in _grams(w):
            index.setdefault(g, []).append(w)
    x, y = [], []

    def add(word: str, n: float, right: str | None) -> None:
        near = {c for g in _grams(word) for c in index.get(g, ()) if c != word and abs(len(c) - len(word)) <= 2}
        for c in sorted(near):
            e = _edits(word, c)
            s = shape_edits(word, c)
            if e > 3 or (e > 2 and s > 0):
                continue
            a, b = _grams(word), _grams(c)
            x.append([e, s, len(a & b) / len(a | b), np.log(counts[c] / n), len(c) - len(word), len(word), bool(re.search(r"[0-9@]", word))])
            y.append(c == right)

    words = [w for w in counts if len(w) >= 3]
    for w in words:
        add(w, counts[w], None)  # words of the corpus stay as they are
        add(w, max(1.0, counts[w] / 10 ** rng.uniform(0, 3)), None)  # also if they are rare
    for _ in range(max(2 * len(words), 1500) if words else 0):
        w = rng.choice(words)
        fits = [(a, b) for a, b in MISREADS if a in w]
        if fits:
            a, b = rng.choice(fits)
            at = rng.choice([m.start() for m in re.finditer(re.escape(a), w)])
            noisy = w[:at] + b + w[at + len(a) :]
            if noisy not in counts:
                add(noisy, max(1.0, counts[w] / 10 ** rng.uniform(1.5, 4)), w)
    return boosting.fit(np.array(x, dtype=float), np.array(y, dtype=float), RANK, trees=40)


def train_joiner(sample: list[tuple[str, int]], seed: int = 6) -> boosting.Boosted:
    """Whether a broken pair keeps its hyphen; learns from words of the sample broken on purpose."""
    rng = random.Random(seed)
    counts = dict(sample)
    x, y = [], []
    for w in counts:
        for _ in range(2):
            if "-" in w.strip("-"):
                at = rng.choice([m.start() for m in re.finditer("-", w) if 0 < m.start() < len(w) - 1] or [0])
                a, b, keep = w[:at], w[at + 1 :], 1
            elif len(w) >= 5:
                at = rng.randint(2, len(w) - 2)
                a, b, keep = w[:at], w[at:], 0
            else:
                continue
            if a and b:
                seen = lambda t: float(np.log1p(counts.get(t, 0)))
                x.append([seen(a + b), seen(f"{a}-{b}"), seen(a), seen(b)])
                y.append(keep)
                # the same word as if the corpus held it nowhere else
                x.append([0.0 if not keep else seen(a + b), 0.0 if keep else seen(f"{a}-{b}"), seen(a), seen(b)])
                y.append(keep)
    return boosting.fit(np.array(x, dtype=float), np.array(y, dtype=float), ["merged", "hyphened", "left_n", "right_n"], trees=20)


def corrections(suspicious: DataFrame, vocab: DataFrame, ranker: boosting.Boosted, total: int) -> DataFrame:
    """(word, fixed): words of ``suspicious`` (word, n) that a vocabulary word replaces."""
    words = suspicious.where(F.col("word").rlike(r"\p{L}") & (F.length("word") >= 3))
    words = words.select("word", "n", F.explode(grams(F.col("word"))).alias("gram"))
    good = vocab.where(F.col("word").rlike(r"^[\p{L}][\p{L}-]{2,}$") & (F.col("n") >= F.lit(max(3, total // CANDIDATE)))).select(F.col("word").alias("cand"), F.col("n").alias("cand_n"))
    good = good.select("cand", "cand_n", F.explode(grams(F.col("cand"))).alias("gram"))
    near = words.join(good, "gram").where((F.abs(F.length("cand") - F.length("word")) <= 2) & (F.col("cand_n") > 3 * F.col("n")) & (F.col("cand") != F.col("word")))
    near = near.groupBy("word", "cand").agg(F.count("*").alias("both"), F.max("n").alias("n"), F.max("cand_n").alias("cand_n"))
    near = near.withColumn("edits", F.expr("levenshtein(word, cand, 3)")).where("edits >= 0")
    near = near.withColumn("shape_edits", F.least(*[F.levenshtein(shape_column(F.col("word"), k), shape_column(F.col("cand"), k)) for k in range(len(SHAPES))])).where("edits <= 2 OR shape_edits = 0")
    a, b = F.size(grams(F.col("word"))), F.size(grams(F.col("cand")))
    near = near.withColumns(
        {
            "shared": F.col("both") / (a + b - F.col("both")), "more": F.log(F.col("cand_n") / F.greatest("n", F.lit(1))), "longer": F.length("cand") - F.length("word"),
            "size": F.length("word"), "odd": F.col("word").rlike("[0-9@]").cast("int"),
        }
    ).withColumn("odds", ranker.column())
    best = near.where("odds > 0").groupBy("word").agg(F.max_by("cand", F.struct("odds", "cand_n", "cand")).alias("fixed"))
    return best


def _fix_tokens(tokens: DataFrame, fixes: DataFrame) -> DataFrame:
    """(token, fixed_token): tokens of which some part is replaced; parts stand between slashes."""
    parts = tokens.select("token", F.posexplode(F.split("token", "/")).alias("pos", "word")).join(fixes, "word", "left")
    whole = parts.groupBy("token").agg(F.count("fixed").alias("hits"), F.array_sort(F.collect_list(F.struct("pos", F.coalesce("fixed", "word").alias("w")))).alias("ws"))
    return whole.where("hits > 0").select("token", F.array_join(F.transform("ws", lambda x: x["w"]), "/").alias("fixed_token"))


def scanned_papers(blocks: DataFrame) -> DataFrame:
    """(paper_id) of papers whose longer blocks are mostly broken into lines."""
    long = blocks.where("char_length(text) >= 100 AND paper_id IS NOT NULL")
    share = F.avg(F.contains(F.trim("text"), F.lit("\n")).cast("int"))
    return long.groupBy("paper_id").agg(share.alias("s")).where(F.col("s") >= SCANNED_SHARE).select("paper_id")


def word_findings(blocks: DataFrame, scanned: DataFrame | None = None) -> DataFrame:
    """(id, noise_kind, as_read, repaired_word) of words of scanned papers that were broken or misread."""
    tokens = checkpointed(token_counts(blocks))
    vocab = checkpointed(vocabulary(tokens))
    total = vocab.agg(F.sum("n")).first()[0] or 0
    sample = _sample(vocab, total)
    ranker, joiner = train_ranker(sample), train_joiner(sample)
    least = max(total / FREQUENT, 20)
    frequent = vocab.where(F.col("n") >= least).select("word")
    # narrow pass: frequent tokens go before anything else is done to them or shuffled
    common = tokens.where(F.col("n") >= least).select(F.col("token").alias("raw"))
    rest = blocks.where("text IS NOT NULL").select("id", "paper_id", F.explode(F.array_distinct(F.split(marked(F.col("text")), r"\s+"))).alias("raw"))
    rest = rest.join(F.broadcast(common), "raw", "left_anti").where(F.col("raw").rlike(r"\p{L}\P{L}*\p{L}")).join(scanned if scanned is not None else scanned_papers(blocks), "paper_id")
    rest = rest.select("id", "raw", F.when(~F.contains("raw", F.lit(_MARK)), _core(F.col("raw"))).alias("word"))
    rest = checkpointed(rest.where("word IS NULL").unionByName(rest.where("word IS NOT NULL").join(F.broadcast(frequent), "word", "left_anti").select("id", "raw", "word")).distinct())
    pairs = rest.where("word IS NULL").select("raw").distinct().withColumn("t", _core(F.col("raw")))
    pairs = pairs.select("raw", F.substring_index("t", _MARK, 1).alias("a"), F.substring_index("t", _MARK, -1).alias("b"), F.replace("t", F.lit(_MARK), F.lit("")).alias("m"), F.replace("t", F.lit(_MARK), F.lit("-")).alias("h"))
    pairs = pairs.where("a <> '' AND b <> '' AND contains(h, '-')")
    forms = pairs.select("raw", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(k).alias("t")) for k in "mhab"])).alias("x")).select("raw", "x.k", "x.t")
    known = forms.select("raw", "k", F.explode(F.split("t", "/")).alias("word")).join(vocab, "word", "left").groupBy("raw", "k").agg(F.min(F.coalesce("n", F.lit(0))).alias("n"))
    number = lambda k: F.log1p(F.coalesce(F.max(F.when(F.col("k") == k, F.col("n"))), F.lit(0)))
    known = known.groupBy("raw").agg(number("m").alias("merged"), number("h").alias("hyphened"), number("a").alias("left_n"), number("b").alias("right_n"))
    pairs = pairs.join(known, "raw").withColumn("keep", joiner.column() > 0)
    suspicious = rest.where("word IS NOT NULL").select(F.col("word").alias("token")).unionByName(pairs.select(F.explode(F.array("m", "h")).alias("token"))).distinct()
    bits = suspicious.select(F.explode(F.split("token", "/")).alias("word")).distinct().join(vocab, "word", "left").select("word", F.coalesce("n", F.lit(0)).alias("n"))
    bits = bits.join(F.broadcast(frequent), "word", "left_anti")
    fixes = checkpointed(corrections(bits, vocab, ranker, total))
    fixed = _fix_tokens(suspicious, fixes)
    char = rest.where("word IS NOT NULL").join(fixed.withColumnRenamed("token", "word"), "word").select("id", F.lit("char").alias("noise_kind"), F.col("raw").alias("as_read"), F.col("fixed_token").alias("repaired_word"))
    fm, fh = fixed.select(F.col("token").alias("m"), F.col("fixed_token").alias("fm")), fixed.select(F.col("token").alias("h"), F.col("fixed_token").alias("fh"))
    pairs = pairs.join(fm, "m", "left").join(fh, "h", "left")
    unknown = (F.col("merged") == 0) & (F.col("hyphened") == 0)
    # a pair known in neither form was also misread: the form that has a correction counts
    word = F.when(unknown & F.col("fm").isNotNull(), F.col("fm")).when(unknown & F.col("fh").isNotNull(), F.col("fh")).when(F.col("keep"), F.coalesce("fh", "h")).otherwise(F.coalesce("fm", "m"))
    misread = (word != F.col("m")) & (word != F.col("h"))
    pairs = pairs.select("raw", word.alias("repaired_word"), F.when(misread, F.array(F.lit("hyphen"), F.lit("char"))).otherwise(F.array(F.lit("hyphen"))).alias("kinds"))
    hyphen = rest.where("word IS NULL").join(pairs, "raw").select("id", F.explode("kinds").alias("noise_kind"), F.col("raw").alias("as_read"), "repaired_word")
    return char.unionByName(hyphen)


FURNITURE = ["chars", "words", "first", "numeric", "digits", "alike", "steps", "edge_share", "sentence", "upper", "wide", "volume"]
#: a page number alone, in the marks around it and with digits read as letters
PAGE_NO = r"^(?:[-–—\[(]\s*|[Pp](?:age|\.)?\s*)?[0-9OolISB]*[0-9][0-9OolISB]*(?:\s*(?:of|/)\s*[0-9OolISB]+)?\s*[-–—\])]?$"
_NUMBER = r"([0-9OolISB]*[0-9][0-9OolISB]*)"


def _line_features(lines: DataFrame, around: DataFrame, keys: DataFrame) -> DataFrame:
    """``lines`` (paper_id, page_number, side, line, …) with the features of FURNITURE.

    around: the edge lines of all pages. Every line meets those of the two pages before and after on its own side.
    """
    lines = lines.withColumn("line", F.trim("line")).withColumn("uid", F.xxhash64("paper_id", "page_number", "side", "line"))
    digits = lambda c: F.translate(c, "OolISB", "001158")
    number = lambda c: digits(F.regexp_extract(c, _NUMBER, 1)).try_cast("bigint")
    key = lambda c: F.lower(F.regexp_replace(c, r"[^\p{L}]+", " "))
    bare = lines.select("uid", "paper_id", "page_number", "side", "line").distinct()
    shifted = around.select("paper_id", "side", F.explode(F.array(*[F.lit(i) for i in (-2, -1, 1, 2)])).alias("delta"), "page_number", F.trim("line").alias("other"))
    shifted = shifted.select("paper_id", "side", (F.col("page_number") + F.col("delta")).alias("page_number"), "delta", "other")
    pairs = bare.join(shifted, ["paper_id", "side", "page_number"])
    longest = F.greatest(F.length(key(F.col("line"))), F.length(key(F.col("other"))), F.lit(1))
    both_short = (F.length("line") <= 150) & (F.length("other") <= 150)
    # edits of long lines are dear: they are as alike as their words
    words = lambda c: F.array_distinct(F.split(F.trim(key(F.col(c))), " "))
    shared = F.size(F.array_intersect(words("line"), words("other"))) / F.size(F.array_union(words("line"), words("other")))
    alike = F.when(F.length(F.trim(key(F.col("line")))) < 4, 0.0).when(both_short, 1 - F.levenshtein(key(F.col("line")), key(F.col("other"))) / longest).otherwise(shared)
    step = F.when((number("line") == number("other") + F.col("delta")), 1).otherwise(0)
    pairs = pairs.groupBy("uid").agg(F.max(alike).alias("alike"), F.sum(step).alias("steps"))
    lines = lines.join(pairs, "uid", "left").withColumn("key", key(F.col("line"))).join(keys, ["key", "side"], "left")
    return lines.withColumns(
        {
            "alike": F.coalesce("alike", F.lit(0.0)), "steps": F.coalesce("steps", F.lit(0)), "edge_share": F.coalesce("edge_share", F.lit(0)),
            "chars": F.length("line"), "words": F.size(F.split("line", r"\s+")), "first": (F.col("side") == "first").cast("int"), "numeric": F.col("line").rlike(PAGE_NO).cast("int"),
            "digits": F.length(F.regexp_replace("line", r"\D", "")) / F.greatest(F.length("line"), F.lit(1)), "sentence": F.col("line").rlike(r"[.。!?]$").cast("int"),
            "upper": (F.length(F.regexp_replace("line", r"[^\p{Lu}]", "")) / F.greatest(F.length(F.regexp_replace("line", r"[^\p{L}]", "")), F.lit(1))),
            "wide": F.col("line").rlike(r"\s{3}| / ").cast("int"), "volume": F.col("line").rlike(r"Vol\. ?\S+$|\(\S{4}\) \S+$").cast("int"),
        }
    )


def edge_lines(pages: DataFrame) -> DataFrame:
    """(id, paper_id, page_number, side, line): first and last non-blank line of every page."""
    text = F.regexp_replace("text", r"^\s+|\s+$", "")
    rows = pages.where("text IS NOT NULL AND trim(text) <> ''").select("id", "paper_id", "page_number", text.alias("t"))
    ends = F.array(F.struct(F.lit("first").alias("side"), F.substring_index("t", "\n", 1).alias("line")), F.struct(F.lit("last").alias("side"), F.substring_index("t", "\n", -1).alias("line")))
    return rows.select("id", "paper_id", "page_number", F.explode(ends).alias("e")).select("id", "paper_id", "page_number", "e.side", "e.line").distinct()


def edge_blocks(blocks: DataFrame) -> DataFrame:
    """The edge lines of the first and last block of every page, with block_type; one_line tells whether it is all of the block."""
    own = F.struct("order_index", "id", "head", "tail", "one_line", "block_type")
    text = F.regexp_replace("text", r"^\s+|\s+$", "")
    b = blocks.where("text IS NOT NULL AND trim(text) <> ''").withColumns({"head": F.substring_index(text, "\n", 1), "tail": F.substring_index(text, "\n", -1), "one_line": ~F.contains(text, F.lit("\n"))})
    ends = b.groupBy("paper_id", "page_number").agg(F.min(own).alias("first"), F.max(own).alias("last"))
    sides = F.array(F.struct(F.lit("first").alias("side"), F.col("first").alias("b"), F.col("first.head").alias("line")), F.struct(F.lit("last").alias("side"), F.col("last").alias("b"), F.col("last.tail").alias("line")))
    return ends.select("paper_id", "page_number", F.explode(sides).alias("e")).select("paper_id", "page_number", "e.side", "e.b.id", "e.line", "e.b.block_type", "e.b.one_line")


def furniture(blocks: DataFrame, pages: DataFrame, scanned: DataFrame | None = None) -> DataFrame:
    """(item_kind, item_id, noise_kind) of blocks that are, and pages that have, a running header or a page number."""
    edges = edge_lines(pages)
    scanned = scanned if scanned is not None else scanned_papers(blocks)
    b = edge_blocks(blocks.join(scanned, "paper_id"))
    around = checkpointed(edges.select("paper_id", "page_number", "side", "line").join(scanned, "paper_id").distinct())
    # how typical a line is of page edges in the whole corpus: papers that have it there
    keys = edges.groupBy(F.lower(F.regexp_replace("line", r"[^\p{L}]+", " ")).alias("key"), "side").agg(F.log1p(F.approx_count_distinct("paper_id")).alias("edge_share"))
    both = b.select(F.lit("block").alias("item_kind"), F.col("id").alias("item_id"), "paper_id", "page_number", "side", "line", "block_type", "one_line").unionByName(
        edges.select(F.lit("page").alias("item_kind"), F.col("id").alias("item_id"), "paper_id", "page_number", "side", "line", F.lit(None).cast("string").alias("block_type"), F.lit(True).alias("one_line"))
    )
    both = both.join(scanned, "paper_id")
    data = checkpointed(_line_features(both, around, keys))
    own = data.where("item_kind = 'block'")
    # a share of the lines by hash, so that no task sends more than its part of the sample
    share = SAMPLE_LINES / max(own.count(), SAMPLE_LINES)
    sample = own.where(F.xxhash64("item_id") / 2.0**64 + 0.5 < share).limit(2 * SAMPLE_LINES).select(*FURNITURE, (F.col("one_line") & (F.col("block_type") == "header_footer")).cast("int").alias("y")).collect()
    if not sample or not any(r.y for r in sample):
        return data.where("false").select("item_kind", "item_id", F.lit("").alias("noise_kind"))
    x, y = np.array([[float(r[f]) for f in FURNITURE] for r in sample]), np.array([float(r.y or 0) for r in sample])
    model = boosting.fit(x, y, FURNITURE, trees=30, depth=2, rate=0.2, least=20, ridge=4.0)
    # types name part of the furniture only: the share they name is what the model says of lines they do name, and
    # a line is furniture if its chance to be named is more than a third of that share
    p = 1 / (1 + np.exp(-model.log_odds(x)))
    share = float(np.median(p[y > 0])) / 3
    hit = data.where("one_line").withColumn("odds", model.column()).where(F.col("odds") > float(np.log(share / (1 - share))))
    return hit.select("item_kind", "item_id", F.when(F.col("numeric") == 1, "page_no").otherwise("header").alias("noise_kind")).distinct()


def findings(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """(item_kind, item_id, noise_kind, repaired_word): all that is found in blocks and pages."""
    scanned = checkpointed(scanned_papers(blocks))
    parts = checkpointed(furniture(blocks, pages, scanned))
    words = word_findings(blocks, scanned).join(parts.where("item_kind = 'block'").select(F.col("item_id").alias("id")).distinct(), "id", "left_anti")
    words = words.select(F.lit("block").alias("item_kind"), F.col("id").alias("item_id"), "noise_kind", "repaired_word")
    return parts.withColumn("repaired_word", F.lit("")).unionByName(words).distinct()


def repaired_blocks(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """(id, paper_id, order_index, paragraph): the text of every block that is no furniture, as running text."""
    scanned = checkpointed(scanned_papers(blocks))
    drop = furniture(blocks, pages, scanned).where("item_kind = 'block'").select(F.col("item_id").alias("id")).distinct()
    # a finding names the token as it stands between white space; only tokens equal to it are mended, and only their core
    read = word_findings(blocks, scanned).groupBy("id", "as_read").agg(F.min("repaired_word").alias("to"))
    core = F.regexp_replace("as_read", _EDGE, "")
    fixes = read.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("as_read", F.replace("as_read", core, F.col("to"))))).alias("fixes"))
    rows = blocks.select("id", "paper_id", "order_index", "text").where("text IS NOT NULL").dropDuplicates(["id"]).join(drop, "id", "left_anti").join(fixes, "id", "left")
    pieces = F.regexp_extract_all(marked(F.col("text")), F.lit(r"(\S+|\s+)"), 1)
    mended = F.array_join(F.transform(pieces, lambda t: F.coalesce(F.element_at("fixes", t), t)), "")
    text = F.replace(F.when(F.col("fixes").isNull(), marked(F.col("text"))).otherwise(mended), F.lit(_MARK), F.lit("-"))
    return rows.select("id", "paper_id", "order_index", F.trim(F.regexp_replace(text, r"[ \t]*\n[ \t]*", " ")).alias("paragraph"))
