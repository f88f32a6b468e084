"""Dictionaries of metrics: exact, containing and contained phrases, by equality joins on word n-grams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.text import squeeze

LONGEST = 6  # words of a phrase


def phrase(col: Column) -> Column:
    """A name as lower-case words."""
    return squeeze(F.regexp_replace(F.lower(col), r"[^\p{L}\p{Nd}]+", " "))


def ngrams(words: Column) -> Column:
    """array<struct<gram, size>>: every run of up to LONGEST words."""
    w = F.split(words, " ")
    sizes = F.sequence(F.lit(1), F.least(F.size(w), F.lit(LONGEST)))
    return F.flatten(F.transform(sizes, lambda n: F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.struct(F.array_join(F.slice(w, i, n), " ").alias("gram"), n.alias("size")))))


def dictionary(entries: DataFrame) -> DataFrame:
    """(entry_id, words): canonical names and aliases as words."""
    names = entries.select("entry_id", F.explode(F.concat(F.array("canonical_name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("n"))
    return names.select("entry_id", phrase(F.col("n")).alias("words")).where("words <> ''").distinct()


def find_entries(names: DataFrame, entries: DataFrame, least_chars: int = 5) -> DataFrame:
    """(name, entry_id, way) of every distinct name that the dictionary knows.

    An exact phrase first; then the first entry that contains the name; then the longest phrase of ``least_chars`` or
    more that the name contains. Names with fewer than three letters or digits match exactly only.
    """
    n = names.select(F.col(names.columns[0]).alias("name")).where("name IS NOT NULL").distinct().withColumn("words", phrase(F.col("name"))).where("words <> ''")
    d = dictionary(entries)
    exact = n.join(d, "words").select("name", "entry_id", F.lit(0).alias("way"), F.lit(0).alias("rank"))
    longer = n.where(F.length(F.replace("words", F.lit(" "), F.lit(""))) >= 3)
    inside = d.select("entry_id", F.explode(ngrams(F.col("words"))).alias("g")).select("entry_id", F.col("g.gram").alias("words"))
    within = longer.join(inside, "words").select("name", "entry_id", F.lit(1).alias("way"), F.lit(0).alias("rank"))
    parts = longer.select("name", F.explode(ngrams(F.col("words"))).alias("g")).select("name", F.col("g.gram").alias("words"))
    holds = parts.join(d.where(F.length("words") >= least_chars), "words").select("name", "entry_id", F.lit(2).alias("way"), (-F.length("words")).alias("rank"))
    best = exact.unionByName(within).unionByName(holds).groupBy("name").agg(F.min(F.struct("way", "rank", "entry_id")).alias("b"))
    way = F.element_at(F.array(F.lit("exact"), F.lit("within"), F.lit("holds")), F.col("b.way") + 1)
    return best.select("name", "b.entry_id", way.alias("way"))


def numbered_values(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """``df`` with value_no: the dense rank of each numeric value in its group, by distinct values only."""
    number = F.col(value).try_cast("double")
    distinct = df.select(*group, number.alias("_x")).where("_x IS NOT NULL").distinct()
    ranked = distinct.withColumn("value_no", F.row_number().over(Window.partitionBy(*group).orderBy("_x")))
    keyed = df.withColumn("_x", number)
    on = [keyed[g].eqNullSafe(ranked[g]) for g in group] + [keyed["_x"] == ranked["_x"]]
    return keyed.join(ranked, on, "left").select(*[keyed[c] for c in df.columns], ranked["value_no"])
