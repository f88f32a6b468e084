"""Mapping freely typed values to a canonical list, by a pigeonhole join. Built-in SQL functions only.

1. Every distinct text is brought to up to four compact forms (letters and digits): without case, separators,
   look-alike letters, decorations and British endings; as typed, and turned round at a comma or an "of".
2. Forms that equal a reference form (of a canonical name or an alias) match at once.
3. The others go through a partition-based join: a reference form of length L with a budget of k edits is cut into
   k + 1 segments. k edits leave one segment whole, so a text within the budget holds one of them at nearly its
   place. Texts emit the substrings that could be such a segment (only the lengths and shifts that the edits before
   and after the segment allow); an equality join finds candidates, the built-in levenshtein verifies them.
4. Texts still unmatched that abbreviate (every word a subsequence of the entry's word, same initials, same number
   of words) are joined on their initials and verified word by word.
5. What is left is reported by an anti-join, under entry 0.

Of several entries the nearest counts (edits plus the edits between the sorted letters, so that swapped letters
weigh less), then the smaller entry id. The reference is the smaller side, a table whose
size Spark knows; it is broadcast only below Spark's own threshold.

Defined results: null texts give no row; blank texts and texts of no letters are unmatched; repeated texts are
matched once; an empty reference leaves everything unmatched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.looks import fold_letters
from weftline.operators.units import metric_parts
from weftline.session import checkpointed

MAX_EDITS = 4
#: words that may stand around a name without being part of it
BEFORE = r"^(?:(?:measured|average|avg|final|initial|mean|max|maximum|min|minimum|typical|overall|total|reported|nominal|the)\s+)+"
AFTER = (
    r"(?:\s+(?:value|values|call|calls|step|llm|phase|setting|\(?run \d+\)?|#\s?\d+|v\d+|no \d+|try \d+|attempt \d+)"
    r"|\s+after \w+(?: \w+)?|\s+of (?:the )?(?:film|films|sample|samples|fiber|fibers|fibre|fibres|yarn|mat|membrane)"
    r"|,\s*(?:machine|cross|transverse|axial|longitudinal|radial) direction|,\s*(?:dry|wet)(?: state)?)+\s*$"
)


def edits_allowed(length: Column) -> Column:
    """Edit budget of a form: none up to 4 characters, one to 6, two to 8, three to 9, then MAX_EDITS."""
    return F.when(length <= 4, 0).when(length <= 6, 1).when(length <= 8, 2).when(length <= 9, 3).otherwise(MAX_EDITS)


def spaced(text: Column) -> Column:
    """Lower-case words between single spaces; commas and brackets stay."""
    s = F.regexp_replace(fold_letters(text), r"\$\s*([A-Za-z])_?\{?(\w+)\}?\s*\$", "$1$2")
    s = F.regexp_replace(s, r"(?<=[a-z0-9])(?=[A-Z][a-z])", " ")
    s = F.lower(F.regexp_replace(s, r"[_\-–—/.:;*=\"'$]+", " "))
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def bare(words: Column) -> Column:
    """``spaced`` text without a trailing bracket and without what may stand before a name."""
    s = F.regexp_replace(words, r"(?<=\S)\s*[(\[][^()\[\]]*[)\]]\s*$", "")
    s = F.trim(F.regexp_replace(s, r"[()\[\]{}]", ""))
    return F.trim(F.regexp_replace(F.regexp_replace(s, BEFORE, ""), r"\s+", " "))


def compact(words: Column) -> Column:
    """Letters and digits only, with American endings and plain numerals of stages."""
    s = F.regexp_replace(words, r"\bstage iii\b", "stage3")
    s = F.regexp_replace(F.regexp_replace(s, r"\bstage ii\b", "stage2"), r"\bstage i\b", "stage1")
    s = F.regexp_replace(s, r"[^\p{L}\p{Nd}]", "")
    return F.replace(F.replace(F.replace(s, F.lit("isation"), F.lit("ization")), F.lit("fibre"), F.lit("fiber")), F.lit("colour"), F.lit("color"))


def forms(text: Column) -> Column:
    """Distinct compact forms of a text: as typed, without what may follow a name, turned at a comma or an "of"."""
    whole = bare(spaced(text))
    b = F.trim(F.regexp_replace(whole, AFTER, ""))
    turned = F.when(b.rlike(r"^[^,]+,[^,]+$"), F.regexp_replace(b, r"^([^,]+),\s*([^,]+)$", "$2 $1"))
    of = F.when(b.rlike(r"^.+ of .+$"), F.regexp_replace(b, r"^(.+?) of (.+)$", "$2 $1"))
    return F.array_distinct(F.filter(F.transform(F.array(b, whole, turned, of), compact), lambda x: x.isNotNull() & (x != "")))


def reference_forms(entries: DataFrame) -> DataFrame:
    """(field_name, entry_id, name_words, form, form_len, k): canonical names and aliases, compact."""
    names = entries.select("field_name", "entry_id", F.explode(F.concat(F.array("canonical_name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("n"))
    names = names.where("n IS NOT NULL").select("field_name", "entry_id", spaced(F.col("n")).alias("name_words"))
    names = names.withColumn("form", compact(F.col("name_words"))).where("form <> ''").distinct()
    return names.withColumn("form_len", F.length("form")).withColumn("k", edits_allowed(F.length("form")))


def _segments(reference: DataFrame) -> DataFrame:
    """One row per segment of each reference form with a budget: (…, seg, piece)."""
    rows = reference.where("k > 0").select("*", F.explode(F.sequence(F.lit(0), F.col("k"))).alias("seg"))
    begin = F.floor(F.col("seg") * F.col("form_len") / (F.col("k") + 1)).cast("int")
    end = F.floor((F.col("seg") + 1) * F.col("form_len") / (F.col("k") + 1)).cast("int")
    return rows.select("field_name", "entry_id", "form", "form_len", "k", "seg", F.substring("form", begin + 1, end - begin).alias("piece"))


def _probes(texts: DataFrame, reference: DataFrame) -> DataFrame:
    """Substrings of each text form that may be a segment: (field_name, text, typed, form_len, seg, piece)."""
    lengths = reference.where("k > 0").groupBy("field_name").agg(F.collect_set("form_len").alias("lengths"))
    rows = texts.join(F.broadcast(lengths), "field_name").withColumn("n", F.length("typed"))
    near = F.filter("lengths", lambda x: F.abs(x - F.col("n")) <= edits_allowed(x))
    rows = rows.select("field_name", "text", "typed", "n", F.explode(near).alias("form_len")).withColumn("k", edits_allowed(F.col("form_len")))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("k"))).alias("seg"), (F.col("n") - F.col("form_len")).alias("d"))
    begin = F.floor(F.col("seg") * F.col("form_len") / (F.col("k") + 1)).cast("int")
    end = F.floor((F.col("seg") + 1) * F.col("form_len") / (F.col("k") + 1)).cast("int")
    # at most seg edits lie before the segment, and at most k - seg after it
    low = F.greatest(F.lit(0), begin - F.col("seg"), begin + F.col("d") - (F.col("k") - F.col("seg")))
    high = F.least(F.col("n") - (end - begin), begin + F.col("seg"), begin + F.col("d") + (F.col("k") - F.col("seg")))
    rows = rows.withColumns({"low": low, "high": high, "w": end - begin}).where("low <= high")
    rows = rows.select("*", F.explode(F.sequence("low", "high")).alias("at"))
    return rows.select("field_name", "text", "typed", "form_len", "seg", F.substring("typed", F.col("at") + 1, F.col("w")).alias("piece")).distinct()


def _abbreviated(left: DataFrame, reference: DataFrame) -> DataFrame:
    """(field_name, text, entry_id, distance) of texts whose every word abbreviates the entry's."""
    initials = lambda c: F.array_join(F.transform(F.split(c, " "), lambda w: F.substring(w, 1, 1)), "")
    t = left.select("field_name", "text", F.regexp_replace(bare(spaced(F.col("text"))), AFTER, "").alias("b")).where(F.length("b") >= 2)
    t = t.withColumn("b", F.regexp_replace("b", r"[^\p{L}\p{Nd} ]", "")).withColumn("initials", initials(F.col("b"))).where("initials <> ''")
    r = reference.select("field_name", "entry_id", "name_words").distinct().withColumn("initials", initials(F.col("name_words"))).where(F.length("initials") > 1)
    both = t.join(r, ["field_name", "initials"])
    pairs = F.arrays_zip(F.split("b", " ").alias("x"), F.split("name_words", " ").alias("y"))
    pattern = lambda w: F.concat(F.lit("^"), F.array_join(F.filter(F.split(w, ""), lambda c: c != ""), "[a-z0-9]*"))
    fits = F.forall(pairs, lambda p: F.regexp_like(p["y"], pattern(p["x"])) & (F.length(p["x"]) >= F.least(F.lit(2), F.length(p["y"]))))
    return both.where(fits).select("field_name", "text", "entry_id", (F.length("name_words") - F.length("b")).alias("distance"))


def map_texts(texts: DataFrame, entries: DataFrame) -> DataFrame:
    """(field_name, text, entry_id, distance, way): the entry of every distinct text, 0 if none.

    ``texts`` holds field_name and text; ``entries`` field_name, entry_id, canonical_name and aliases.
    """
    texts = texts.select("field_name", "text").where("text IS NOT NULL").distinct()
    reference = reference_forms(entries)
    # read by every step; texts without any form keep a row
    typed = checkpointed(texts.select("field_name", "text", F.explode_outer(forms(F.col("text"))).alias("typed")))
    texts = typed.select("field_name", "text").distinct()
    same = typed.join(reference.select("field_name", F.col("form").alias("typed"), "entry_id"), ["field_name", "typed"])
    exact = same.groupBy("field_name", "text").agg(F.min("entry_id").alias("entry_id")).select("*", F.lit(0).alias("distance"), F.lit("exact").alias("way"))
    rest = typed.join(exact.select("field_name", "text"), ["field_name", "text"], "left_anti")
    candidates = _probes(rest, reference).join(_segments(reference), ["field_name", "form_len", "seg", "piece"]).select("field_name", "text", "typed", "entry_id", "form", "k").distinct()
    close = candidates.withColumn("distance", F.expr("levenshtein(typed, form, k)")).where("distance >= 0")
    # swapped letters cost two edits but leave the same letters: of equal distances the one with fewer other letters is nearer
    letters = lambda c: F.array_join(F.array_sort(F.split(c, "")), "")
    close = close.withColumn("near", F.col("distance") + F.levenshtein(letters(F.col("typed")), letters(F.col("form"))))
    edited = close.groupBy("field_name", "text").agg(F.min(F.struct("near", "entry_id", "distance")).alias("b")).select("field_name", "text", "b.entry_id", "b.distance", F.lit("edited").alias("way"))
    left = rest.select("field_name", "text").distinct().join(edited.select("field_name", "text"), ["field_name", "text"], "left_anti")
    short = _abbreviated(left, reference).groupBy("field_name", "text").agg(F.min(F.struct("distance", "entry_id")).alias("b"))
    short = short.select("field_name", "text", "b.entry_id", "b.distance", F.lit("abbreviated").alias("way"))
    matched = exact.unionByName(edited).unionByName(short)
    unmatched = texts.join(matched.select("field_name", "text"), ["field_name", "text"], "left_anti")
    return matched.unionByName(unmatched.select("field_name", "text", F.lit(0).cast("long").alias("entry_id"), F.lit(None).cast("int").alias("distance"), F.lit("unmatched").alias("way")))


def without_unit(metric: Column, unit_of_inner: Column) -> Column:
    """A metric without the unit written after it."""
    base, _ = metric_parts(metric)
    return F.when(unit_of_inner.isNotNull(), base).otherwise(metric)


def setting_names(packed: Column) -> Column:
    """Names of the settings packed in one field: quotes and brackets protect delimiters, values are cut off."""
    parts = F.transform(F.split(packed, '"'), lambda x, i: F.when(i % 2 == 1, F.regexp_replace(x, r"[;；、•|\n\t\r,/]", " ")).otherwise(x))
    s = F.regexp_replace(F.array_join(parts, ""), r"[;；、•|\n\t\r,/](?=[^()\n]{0,200}\))", " ")
    values = F.split(s, r"[;；、•|\n\t\r]|,(?=\s|$)|(?<=\s)/(?=\s|$)")
    name = lambda v: F.trim(F.regexp_replace(F.regexp_replace(F.trim(v), r"(?i)(?<=\S)\s*(?:[:=(]|\bat\b|\bof\b)*\s*(?<![\w-])(?:[<>~≈±]?\s?\d.*|overnight.*)$", ""), r"(?i)(?:[:=(]|\b(?:at|of))\s*$", ""))
    return F.filter(F.transform(values, name), lambda v: v != "")
