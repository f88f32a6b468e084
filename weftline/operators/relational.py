"""Listing, counting, auditing and ranking of extracted facts and their papers, jobs and model calls.

Every function drops repeated source rows first (``once``), keeps null keys as a group of their own, and gives an
empty result (or zero counts) for empty tables. Aggregations combine map-side; the only windows are over keys with
bounded groups, and say so.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import text as X


def once(df: DataFrame, key: str = "id") -> DataFrame:
    """One row per key: repeated rows are whole copies, so any will do. Null keys are kept apart as one row."""
    return df.dropDuplicates([key])


def page_of(df: DataFrame, order: list[Column], page: int, size: int) -> DataFrame:
    """A page of a listing; size is clamped to 1..200 and page to 1 and above."""
    size = max(1, min(200, size))
    return df.orderBy(*order).offset((max(1, page) - 1) * size).limit(size)


def with_status(df: DataFrame, wanted: list[str], column: str = "review_status") -> DataFrame:
    """Rows whose status, in either language, is one of ``wanted``."""
    names = sorted({raw for raw, name in X.STATUS_ALIASES.items() if name in {X.STATUS_ALIASES.get(w, w) for w in wanted}} | set(wanted))
    return df.where(F.col(column).isin(*names))


def latest(df: DataFrame, key: str, by: list[str]) -> DataFrame:
    """The row of each key with the greatest ``by``; one aggregation, no sort."""
    rest = [c for c in df.columns if c not in (key, *by)]
    top = df.groupBy(key).agg(F.max(F.struct(*by, *rest)).alias("_t"))
    return top.select(key, *[F.col(f"_t.{c}").alias(c) for c in df.columns if c != key])


def first_by(df: DataFrame, keys: list[str], rank: Column, order: list[Column]) -> DataFrame:
    """The row of each key with the greatest rank; among equals the first in ``order``. Aggregates, never sorts a group."""
    packed = F.struct(*[F.col(c) for c in df.columns])
    worst_last = F.struct(rank.alias("r"), *[o.alias(f"o{i}") for i, o in enumerate(order)])
    return df.groupBy(*[F.col(k) for k in keys]).agg(F.max_by(packed, worst_last).alias("_t")).select("_t.*")


def duplicate_groups(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys…, n): combinations that stand in more than one row."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def fill_rates(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, filled, total, rate): share of rows with text in each column, in one pass."""
    counts = df.agg(F.count("*").alias("total"), *[F.count_if(X.filled(F.col(c).cast("string"))).alias(c) for c in columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("filled")) for c in columns])
    out = counts.select("total", F.explode(pairs).alias("x"))
    return out.select("x.column_name", "x.filled", "total", F.when(F.col("total") > 0, F.round(F.col("x.filled") / F.col("total"), 6)).alias("rate"))


def completeness_score(records: DataFrame) -> DataFrame:
    """One row: completeness, clean and unique shares and 0.55/0.30/0.15 of them as the score; 0 rows score 0."""
    norm = lambda c: F.lower(X.squeeze(F.coalesce(F.col(c), F.lit(""))))
    condition = F.substring_index(norm("performance_condition"), "; export_tier_", 1)
    key = F.sha2(F.concat_ws("\x1f", norm("sample_id"), norm("performance_metric"), norm("performance_value"), norm("performance_unit"), condition), 256)
    flagged = F.coalesce(F.contains("reviewer_comment", F.lit("qa_reason=")), F.lit(False))
    four = [F.count_if(X.filled(F.col(c))) for c in ("sample_id", "performance_metric", "performance_value", "performance_evidence")]
    counts = records.agg(F.count("*").alias("n"), reduce(lambda a, b: a + b, four).alias("got"), F.count_if(flagged).alias("flagged"), F.count_distinct(key).alias("keys"))
    n = F.col("n")
    share = lambda x: F.when(n > 0, x / n).otherwise(0.0)
    parts = counts.select("n", share(F.col("got") / 4).alias("completeness"), F.when(n > 0, 1 - F.col("flagged") / n).otherwise(0.0).alias("clean"), share(F.col("keys") * 1.0).alias("unique"))
    score = 0.55 * F.col("completeness") + 0.30 * F.col("clean") + 0.15 * F.col("unique")
    return parts.select("n", *[F.round(c, 4).alias(c) for c in ("completeness", "clean", "unique")], F.round(score, 4).alias("score"))


#: rank of an extraction method in merging; the higher the better
METHOD_RANK = {"rule_text_range": 20, "AI_holistic": 8, "AI_holistic_table": 8, "AI_table": 6, "AI_figure": 5}


def evidence_rank(method: Column, location: Column, sample: Column, evidence: Column) -> Column:
    """How well a fact is grounded: method, place, sample, and up to 200 characters of evidence."""
    m = F.create_map(*[F.lit(x) for kv in METHOD_RANK.items() for x in kv])
    low = F.lower(F.coalesce(location, F.lit("")))
    place = F.when(F.contains(low, F.lit("table")), 6).when(F.contains(low, F.lit("fig")), 5).otherwise(0)
    return F.coalesce(m[method], F.lit(0)) + place + F.when(X.filled(sample), 2).otherwise(0) + F.least(F.length(F.coalesce(evidence, F.lit(""))), F.lit(200))


def exact_dedupe(records: DataFrame) -> DataFrame:
    """The best grounded record of each (paper, sample, metric, value, unit, condition).

    Values count as equal by operator and numbers. Records without metric or value all pass.
    """
    low = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
    value = F.concat_ws("|", X.value_operator(F.col("performance_value")), F.coalesce(F.nullif(X.number_signature(F.col("performance_value")), F.lit("")), low("performance_value")))
    whole = X.filled(F.col("performance_metric")) & X.filled(F.col("performance_value"))
    parts = F.concat_ws("\x1f", F.coalesce(F.col("source_paper_id").cast("string"), F.lit("")), low("sample_id"), low("performance_metric"), value, low("performance_unit"), low("performance_condition"))
    keyed = records.withColumn("_key", F.when(whole, parts).otherwise(F.concat(F.lit("\x1fid"), F.col("id").cast("string"))))
    rank = evidence_rank(F.col("extraction_method"), F.col("source_location"), F.col("sample_id"), F.col("evidence_text"))
    return first_by(keyed, ["_key"], rank, [-F.col("id")]).drop("_key")


def unanimous_fill(df: DataFrame, group: list[str], columns: list[str]) -> DataFrame:
    """Fills blanks of ``columns`` with the group's value where all that is filled agrees (case and spaces aside).

    The group's values are aggregated and joined back, so a hot group is never in one window.
    """
    norm = lambda c: F.lower(X.squeeze(F.col(c)))
    aggs = []
    for c in columns:
        has = X.filled(F.col(c))
        aggs += [F.min(F.when(has, norm(c))).alias(f"_lo_{c}"), F.max(F.when(has, norm(c))).alias(f"_hi_{c}"), F.min(F.when(has, F.col(c))).alias(f"_v_{c}")]
    known = df.where(reduce(lambda a, b: a & b, [F.col(g).isNotNull() for g in group])).groupBy(*group).agg(*aggs)
    out = df.join(known, group, "left")
    for c in columns:
        out = out.withColumn(c, F.when(~X.filled(F.col(c)) & (F.col(f"_lo_{c}") == F.col(f"_hi_{c}")), F.col(f"_v_{c}")).otherwise(F.col(c)))
    return out.drop(*[f"_{k}_{c}" for c in columns for k in ("lo", "hi", "v")])


def spread_sample(df: DataFrame, strata: list[str], key: str, seed: str, size: int) -> DataFrame:
    """A sample taken in turn from every stratum, each in an order of its own set by the seed; with its turn.

    Strata are cut to ``size`` rows each before they meet, by a top-k over a hash order.
    """
    order = F.sha2(F.concat_ws("\x1f", F.lit(seed), F.col(key).cast("string")), 256)
    ranked = df.withColumn("_o", order).withColumn("turn", F.row_number().over(Window.partitionBy(*strata).orderBy("_o", key))).where(F.col("turn") <= size)
    return ranked.orderBy("turn", *strata, "_o").limit(size).drop("_o")


def missing_from(wanted: DataFrame, have: DataFrame, key: str) -> DataFrame:
    """Keys of ``wanted`` that ``have`` lacks."""
    return wanted.select(key).where(F.col(key).isNotNull()).distinct().join(have.select(key), key, "left_anti")


def first_match(left: DataFrame, right: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """``left`` with ``columns`` of the first row of ``right`` in ``order``; nulls where there is none."""
    top = right.groupBy(key).agg(F.min_by(F.struct(*columns), F.col(order)).alias("_f"))
    return left.join(top, key, "left").select(*[left[c] for c in left.columns], *[F.col(f"_f.{c}").alias(f"first_{c}") for c in columns])


def signatures(df: DataFrame, group: str, key: str, columns: list[str], bucket: int = 1000) -> DataFrame:
    """(group, rows, signature): a digest of each group's rows in key order, made of digests of key ranges.

    A range holds at most ``bucket`` keys, so no aggregation buffer grows with the group but by one digest a range.
    """
    line = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    parts = df.groupBy(group, F.floor(F.col(key) / bucket).alias("_b")).agg(F.count("*").alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), line.alias("l")))), lambda x: x["l"]), "\n"), 256).alias("d"))
    return parts.groupBy(group).agg(F.sum("n").alias("rows"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_b", "d"))), lambda x: x["d"]), "\n"), 256).alias("signature"))


def changed(now: DataFrame, before: DataFrame, group: str) -> DataFrame:
    """(group, change): groups that are new, gone or different between two tables of signatures."""
    a, b = now.select(group, F.col("signature").alias("a")), before.select(group, F.col("signature").alias("b"))
    both = a.join(b, group, "full")
    return both.select(group, F.when(F.col("b").isNull(), "new").when(F.col("a").isNull(), "gone").when(F.col("a") != F.col("b"), "different").alias("change")).where("change IS NOT NULL")


def fact_issues(records: DataFrame) -> DataFrame:
    """(id, issues): what each record lacks, joined by commas; records without issue have no row."""
    checks = [
        ("no_metric", ~X.filled(F.col("performance_metric"))), ("no_value", ~X.filled(F.col("performance_value"))), ("no_sample", ~X.filled(F.col("sample_id"))), ("no_evidence", ~X.filled(F.col("performance_evidence"))),
        ("no_digit", X.filled(F.col("performance_value")) & ~F.col("performance_value").rlike(r"\d")), ("rough_location", X.rough_location(F.col("source_location"))), ("low_confidence", F.coalesce(F.col("ai_confidence") < 0.65, F.lit(False))),
    ]
    found = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in checks]))
    return records.select("id", F.array_join(found, ",").alias("issues")).where("issues <> ''")


def told_twice(facts: DataFrame, keys: list[str], narrative: Column) -> DataFrame:
    """(id, table_id): narrative facts that exactly one table fact of equal keys states too."""
    rows = facts.withColumn("_narrative", F.coalesce(narrative, F.lit(False)))
    table_side = rows.where("NOT _narrative").groupBy(*keys).agg(F.count("*").alias("_n"), F.min("id").alias("table_id")).where("_n = 1").drop("_n")
    return rows.where("_narrative").join(table_side, keys).select("id", "table_id")


def conflicting_cells(facts: DataFrame, keys: list[str], what: str) -> DataFrame:
    """(keys…, variants): places of which facts state more than one ``what``."""
    return facts.groupBy(*keys).agg(F.count_distinct(what).alias("variants")).where("variants > 1")


def commonest(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """(group…, value, n): the most frequent non-null value of each group, the least among equals; counted map-side."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("n"))
    top = counts.groupBy(*group).agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(value).alias("v"))).alias("b"))
    return top.select(*group, F.col("b.v").alias(value), (-F.col("b.m")).alias("n"))


# fixed values: how much a merged fact's method counts
MERGE_RANK = {"rule_table_process": 7, "rule_table_performance": 7, "AI_holistic_table": 6, "AI_holistic": 4}


def merged_facts(records: DataFrame) -> DataFrame:
    """(…, merged): the best fact of each (paper, sample, metric, value, condition) and how many it stands for.

    Best is the method, then a named block, a sample and evidence; of equals the first id. Its empty unit and method are
    filled from the best of the others that has one. Facts without metric or value are left out.
    """
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = records.where(X.filled(F.col("performance_metric")) & X.filled(F.col("performance_value")))
    keys = {
        "_sample": X.sample_name(blank("sample_id")), "_metric": F.regexp_replace(F.trim(F.lower("performance_metric")), r"\s+", "_"), "_value": F.trim("performance_value"),
        "_condition": X.squeeze(F.lower(blank("performance_condition"))),
    }
    method = F.create_map(*[F.lit(x) for kv in MERGE_RANK.items() for x in kv])
    rank = F.coalesce(F.try_element_at(method, blank("extraction_method")), F.lit(0)) + F.when(blank("source_location").rlike("(?i)block"), 2).otherwise(0)
    rank = rank + F.when(X.filled(F.col("sample_id")), 2).otherwise(0) + F.when(X.filled(F.col("evidence_text")), 1).otherwise(0)
    rows = rows.withColumns(keys).withColumn("_rank", F.struct(rank.alias("r"), (-F.col("id")).alias("i")))
    best = lambda c: F.max_by(c, F.when(X.filled(F.col(c)), F.col("_rank")))
    out = rows.groupBy("source_paper_id", *keys).agg((-F.max("_rank")["i"]).alias("id"), best("performance_unit").alias("unit"), best("performance_method").alias("method"), F.count("*").alias("merged"))
    return out.select("id", "source_paper_id", F.col("_sample").alias("sample"), F.col("_metric").alias("metric"), F.col("_value").alias("value"), F.col("_condition").alias("condition"), "unit", "method", "merged")


def unique_values(df: DataFrame, group: list[str], column: str, key: str) -> DataFrame:
    """(group…, n, first_ids): how many different texts (case and spaces aside) of a column each group has, and the first row of each.

    One row per group and text, so that no group is collected: (group…, text, first_id, place); place counts from 1 in the order of
    first rows.
    """
    norm = F.lower(X.squeeze(F.col(column)))
    first = df.where(X.filled(F.col(column))).groupBy(*group, norm.alias("_n")).agg(F.min(F.struct(F.col(key), F.col(column))).alias("f"))
    return numbered(first.select(*group, F.col(f"f.{column}").alias("text"), F.col(f"f.{key}").alias("first_id")), group, "first_id", "place")


NUMBER_BLOCK = 1 << 16  # keys that are counted in one window


def numbered(df: DataFrame, group: list[str], key: str, name: str) -> DataFrame:
    """``df`` with the place of each row in its group in the order of an integer key, from 1; repeated keys in any order.

    Rows are counted in blocks of keys; the sums of the blocks before are added, so that a group of any size is spread.
    """
    block = F.floor(F.col(key) / NUMBER_BLOCK).alias("_block")
    rows = df.withColumn("_block", block)
    sums = rows.groupBy(*group, "_block").agg(F.count("*").alias("_c"))
    sums = sums.withColumn("_before", F.coalesce(F.sum("_c").over(Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_c")
    rows = rows.withColumn("_in", F.row_number().over(Window.partitionBy(*group, "_block").orderBy(key)))
    right = sums.select(*[F.col(g).alias(f"_g_{g}") for g in group], F.col("_block").alias("_b"), "_before")
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in group], F.col("_block").eqNullSafe(F.col("_b")))
    return rows.join(right, same).withColumn(name, (F.col("_before") + F.col("_in")).cast("long")).select(*df.columns, name)


def prior_or_all(df: DataFrame, group: str, wanted: Column) -> DataFrame:
    """Rows that are wanted, and all rows of groups that have no wanted one."""
    rows = df.withColumn("_w", F.coalesce(wanted, F.lit(False)))
    some = rows.where("_w").select(F.col(group).alias("_g")).distinct()
    rest = rows.where("NOT _w").join(some, F.col(group).eqNullSafe(F.col("_g")), "left_anti")
    return rows.where("_w").unionByName(rest).drop("_w")


def top_per(df: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group; cut to k per task before rows meet."""
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n")
