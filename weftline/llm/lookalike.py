"""Visually identical text with different characters: one form per look, by script-aware repair.

1. Width, kinds of space, hyphens of one look, invisible characters, ligatures and combining accents are folded, JVM-side.
2. Of each token (a run of letters and digits) the scripts are told. Look-alike letters are substituted only in
   tokens that mix scripts: within themselves, or with their text, if they stand wholly in look-alikes of a script of
   which the text has no word. The token's dominant script is tried first, then Latin, Cyrillic and Greek;
   a result is taken only if it stands in the corpus vocabulary: the tokens of one script in any of the texts that do
   not mix scripts in this sense.

The vocabulary is a distributed table joined by equality with the candidate forms of the (distinct, few) suspicious
tokens; nothing is broadcast by hand and nothing is collected. Only texts with a look-alike letter are looked through for
such tokens.

Defined results: nulls stay null; empty texts stay empty; letters a reader can tell apart (alpha and a, sharp s and
B, superscripts) are never touched; a token with no form in the vocabulary keeps its letters.
"""

from __future__ import annotations

import unicodedata
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.looks import CYRILLIC, GREEK, LOOK_ALIKES, fold_width
from weftline.session import checkpointed

_MARKS = "\u0300\u0301\u0302\u0303\u0304\u0306\u0307\u0308\u030a\u030b\u030c\u0323\u0327\u0328"
_COMPOSED = [(b + m, c) for b in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz" for m in _MARKS if len(c := unicodedata.normalize("NFC", b + m)) == 1]
_LIGATURES = [("\ufb00", "ff"), ("\ufb01", "fi"), ("\ufb02", "fl"), ("\ufb03", "ffi"), ("\ufb04", "ffl"), ("\ufb05", "st"), ("\ufb06", "st")]
TOKEN = r"[\p{L}\p{M}\p{Nd}]+"
_LATIN_IN = "[A-Za-zÀ-ɏ]"
_OTHER_IN = rf"[{''.join(LOOK_ALIKES)}\p{{IsCyrillic}}]"


def compose(col: Column) -> Column:
    """Letters followed by a combining accent as one character, ligatures as their letters."""
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in _COMPOSED + _LIGATURES])
    return F.when(col.rlike(r"[\p{M}\x{FB00}-\x{FB06}]"), F.aggregate(pairs, col, lambda acc, x: F.replace(acc, x["a"], x["b"]))).otherwise(col)


def fold_plain(col: Column) -> Column:
    """Step 1: all that needs no vocabulary."""
    return F.trim(compose(fold_width(col)))


def _to(col: Column, table: dict[str, str]) -> Column:
    return F.translate(col, "".join(table), "".join(table.values()))


def candidate_forms(token: Column) -> Column:
    """Forms of a suspicious token in one script each: array<struct<form, place>>, its dominant script's at place 0."""
    back_c = {v: k for k, v in reversed(list(CYRILLIC.items()))}
    back_g = {v: k for k, v in reversed(list(GREEK.items()))}
    latin = _to(token, LOOK_ALIKES)
    cyrillic, greek = _to(latin, back_c), _to(latin, back_g)
    count = lambda cls: F.length(F.regexp_replace(token, f"[^{cls}]", ""))
    l, c, g = count("A-Za-zÀ-ɏ"), count(r"\p{IsCyrillic}"), count(r"\p{IsGreek}")
    return F.array(
        F.struct(latin.alias("form"), F.when((l >= c) & (l >= g), 0).otherwise(1).alias("place")),
        F.struct(cyrillic.alias("form"), F.when((c > l) & (c >= g), 0).otherwise(2).alias("place")),
        F.struct(greek.alias("form"), F.when((g > l) & (g > c), 0).otherwise(3).alias("place")),
    )


def _own(script: str, letters: dict[str, str]) -> str:
    """A word's piece of a script with a letter that no other script has alike; a single letter may be a symbol."""
    own = rf"[\p{{Is{script}}}&&[^{''.join(letters)}µμ]]"
    return rf"{own}\p{{Is{script}}}|\p{{Is{script}}}{own}"


def mixes_scripts(token: Column, own_cyrillic: Column, own_greek: Column) -> Column:
    """Whether a token mixes scripts, within itself or with a text without words of its script."""
    latin, cyr, gre = token.rlike(_LATIN_IN), token.rlike(r"\p{IsCyrillic}"), token.rlike(rf"[{''.join(GREEK)}]|\p{{IsGreek}}")
    within = (latin & (cyr | token.rlike(f"[{''.join(GREEK)}]"))) | (cyr & gre)
    return within | (cyr & ~own_cyrillic) | (token.rlike(f"[{''.join(GREEK)}]") & ~own_greek)


def repair_texts(texts: DataFrame, column: str = "text") -> DataFrame:
    """(raw, repaired): every distinct non-null text of ``column`` with its one consistent form."""
    raw = texts.select(F.col(column).alias("raw")).where(F.col("raw").isNotNull()).distinct()
    # a text is found by two hashes in its place, as it may be very long
    key = F.struct(F.xxhash64("raw").alias("x"), F.xxhash64(F.lit(1), F.col("raw")).alias("y"))
    plain = raw.withColumn("plain", fold_plain(F.col("raw")))
    own_c, own_g = F.col("plain").rlike(_own("Cyrillic", CYRILLIC)), F.col("plain").rlike(_own("Greek", GREEK))
    every = F.explode(F.regexp_extract_all("plain", F.lit(f"({TOKEN})"), 1))
    # few texts hold a look-alike letter; of the others every token counts as a word
    doubtful = plain.where(F.col("plain").rlike(_OTHER_IN)).select(key.alias("k"), own_c.alias("own_c"), own_g.alias("own_g"), every.alias("token"))
    doubtful = checkpointed(doubtful.select("k", "token", mixes_scripts(F.col("token"), F.col("own_c"), F.col("own_g")).alias("mixed")))
    suspicious = doubtful.where("mixed").select("k", "token").distinct()
    forms = suspicious.select("token").distinct().select("token", F.explode(candidate_forms(F.col("token"))).alias("c")).select("token", "c.form", "c.place")
    wanted = forms.select(F.col("form").alias("token")).distinct()
    clean = plain.where(~F.col("plain").rlike(_OTHER_IN)).select(every.alias("token"))
    known = clean.join(wanted, "token", "left_semi").unionByName(doubtful.where("NOT mixed").select("token").join(wanted, "token", "left_semi")).distinct()
    best = forms.join(known.withColumnRenamed("token", "form"), "form").groupBy("token").agg(F.min_by("form", F.struct("place", "form")).alias("fixed"))
    fixes = suspicious.join(best.where("fixed <> token"), "token").groupBy("k").agg(F.map_from_entries(F.collect_list(F.struct("token", "fixed"))).alias("fixes"))
    parts = F.regexp_extract_all("plain", F.lit(r"([\p{L}\p{M}\p{Nd}]+|[^\p{L}\p{M}\p{Nd}]+)"), 1)
    mended = F.array_join(F.transform(parts, lambda t: F.coalesce(F.element_at("fixes", t), t)), "")
    return plain.withColumn("k", key).join(fixes, "k", "left").select("raw", F.when(F.col("fixes").isNull(), F.col("plain")).otherwise(mended).alias("repaired"))


def _digest(*cols: str) -> list[Column]:
    """Two hashes that stand for texts wherever texts only need to be told apart."""
    return [F.xxhash64(*cols), F.xxhash64(F.lit(1), *[F.col(c) for c in cols])]


FIELDS = ["sample_id", "performance_unit", "evidence_text"]


def repair_fields(items: DataFrame, fields: list[str] = FIELDS) -> DataFrame:
    """(field_name, raw, repaired): every distinct non-null text of each field with its one form.

    One vocabulary is counted over the texts of all fields, so that a word of one field repairs those of the others.
    Texts are repaired once; the fields that hold them are joined by two hashes.
    """
    cells = items.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("raw")) for f in fields])).alias("c")).select("c.*").where("raw IS NOT NULL")
    x, y = _digest("raw")
    held = cells.select("field_name", x.alias("x"), y.alias("y")).distinct().groupBy("x", "y").agg(F.collect_set("field_name").alias("held"))
    texts = repair_texts(cells, "raw").withColumns({"x": x, "y": y})
    return texts.join(held, ["x", "y"]).select(F.explode("held").alias("field_name"), "raw", "repaired")


def same_looks(items: DataFrame) -> DataFrame:
    """(field_name, id_a, id_b): items of one paper whose field looks the same but has other characters.

    Units pair only where the sample looks the same too. A look with one spelling emits nothing, however hot. Texts are
    shuffled once, to find the distinct ones; everything after goes by two hashes of them.
    """
    rows = items.select("id", "source_paper_id", *FIELDS).where("id IS NOT NULL AND source_paper_id IS NOT NULL")
    long = rows.select("id", "source_paper_id", "sample_id", F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("raw")) for f in FIELDS])).alias("x"))
    long = long.select("id", "source_paper_id", "sample_id", "x.field_name", "x.raw").where("raw IS NOT NULL AND (field_name <> 'performance_unit' OR sample_id IS NOT NULL)")
    texts = repair_texts(long, "raw")
    x, y = _digest("raw")
    u, v = _digest("repaired")
    # both tables of hashes are read several times; written once, they also keep the plan small
    looks = checkpointed(texts.select(x.alias("x"), y.alias("y"), F.struct(u.alias("u"), v.alias("v")).alias("look")))
    sx, sy = _digest("sample_id")
    is_unit = F.col("field_name") == "performance_unit"
    keyed = long.select("id", "source_paper_id", "field_name", x.alias("x"), y.alias("y"), F.when(is_unit, sx).alias("sx"), F.when(is_unit, sy).alias("sy")).distinct()
    keyed = keyed.join(looks, ["x", "y"])
    units = keyed.where(is_unit).join(looks.select(F.col("x").alias("sx"), F.col("y").alias("sy"), F.col("look").alias("sample_look")), ["sx", "sy"])
    others = keyed.where(~is_unit).withColumn("sample_look", F.lit(None).cast("struct<u:bigint,v:bigint>"))
    shown = units.select("id", "source_paper_id", "field_name", "x", "y", "look", "sample_look").unionByName(others.select("id", "source_paper_id", "field_name", "x", "y", "look", "sample_look"))
    place = F.struct(*[F.xxhash64(F.lit(k), "source_paper_id", "field_name", "look", "sample_look").alias(f"p{k}") for k in (0, 1)])
    shown = checkpointed(shown.select("field_name", "id", F.struct("x", "y").alias("spelling"), place.alias("place")).distinct())
    # spellings of a look are paired, not items: a hot look of one spelling, or of few, stays as small as its result
    spellings = shown.select("field_name", "place", "spelling").distinct()
    pairs = spellings.withColumnRenamed("spelling", "s_a").join(spellings.select("place", F.col("spelling").alias("s_b")), "place").where("s_a < s_b")
    a = shown.select("place", F.col("spelling").alias("s_a"), F.col("id").alias("i"))
    b = shown.select("place", F.col("spelling").alias("s_b"), F.col("id").alias("j"))
    full = pairs.join(a, ["place", "s_a"]).join(b, ["place", "s_b"]).where("i <> j")
    return full.select("field_name", F.least("i", "j").alias("id_a"), F.greatest("i", "j").alias("id_b")).distinct()
