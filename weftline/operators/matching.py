"""Entity resolution and matching: similar names, classes of aliases, groups of samples, gold evaluation.

Similarity joins are prefix-filtered, so that names meet only over one of their rarest tokens; equal names are one
class first. Nothing pairs all members of a group.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import text as X
from weftline.session import checkpointed


def name_tokens(col: Column) -> Column:
    """Distinct tokens of a name's match key."""
    return F.array_distinct(F.filter(F.split(X.match_key(col), r"[^a-z0-9.]+"), lambda t: t != ""))


def _token_classes(names: DataFrame, group: str, name: str) -> DataFrame:
    """(g, n, tokens): distinct names of a group with their sorted token sets."""
    rows = names.select(F.col(group).alias("g"), F.col(name).alias("n")).where("g IS NOT NULL AND n IS NOT NULL").distinct()
    return rows.withColumn("tokens", F.array_sort(name_tokens(F.col("n"))))


def name_members(names: DataFrame, group: str, name: str) -> DataFrame:
    """(group, name, representative): every distinct name of a group with the least name of equal token set.

    A name is as similar to its representative's pairs of ``similar_names`` as the representative, and 1 to the
    other members of its class. A name without tokens is a class of its own.
    """
    rows = _token_classes(names, group, name).withColumn("own", F.when(F.size("tokens") == 0, F.col("n")).otherwise(""))
    least = rows.groupBy("g", "tokens", "own").agg(F.min("n").alias("representative"))
    return rows.join(least, ["g", "tokens", "own"]).select(F.col("g").alias(group), F.col("n").alias(name), "representative")


def similar_names(names: DataFrame, group: str, name: str, threshold: float = 0.6) -> DataFrame:
    """(group, name_a, name_b, similarity): pairs of distinct names of one group whose token sets overlap that much.

    Jaccard similarity, exact: of each name the tokens are ordered from the rarest, and two sets with similarity t share
    one of the first n - ceil(t n) + 1 of either. Names with equal token sets are one class, represented by the least;
    ``name_members`` has the others.
    """
    rows = _token_classes(names, group, name).where("size(tokens) > 0")
    classes = rows.groupBy("g", "tokens").agg(F.min("n").alias("n"))
    tokens = classes.select("g", "n", F.size("tokens").alias("size"), F.explode("tokens").alias("t"))
    seen = tokens.groupBy("g", "t").agg(F.count("*").alias("df"))
    ranked = tokens.join(seen, ["g", "t"]).groupBy("g", "n", "size").agg(F.array_sort(F.collect_list(F.struct("df", "t"))).alias("o"))
    ranked = ranked.select("g", "n", "size", F.transform("o", lambda x: x["t"]).alias("o"))
    keep = F.col("size") - F.ceil(F.col("size") * threshold - 1e-9) + 1
    prefix = ranked.select("g", "n", "o", F.explode(F.slice("o", F.lit(1), keep.cast("int"))).alias("t"))
    a, b = prefix.select("g", "t", F.col("n").alias("name_a"), F.col("o").alias("o_a")), prefix.select("g", "t", F.col("n").alias("name_b"), F.col("o").alias("o_b"))
    pairs = a.join(b, ["g", "t"]).where("name_a < name_b").where(F.least(F.size("o_a"), F.size("o_b")) >= threshold * F.greatest(F.size("o_a"), F.size("o_b")) - 1e-9)
    both = F.size(F.array_intersect("o_a", "o_b"))
    pairs = pairs.withColumn("similarity", F.round(both / (F.size("o_a") + F.size("o_b") - both), 6)).where(F.col("similarity") >= threshold - 1e-6)
    return pairs.select(F.col("g").alias(group), "name_a", "name_b", "similarity").distinct()


def connected(edges: DataFrame, a: str, b: str, most_rounds: int = 40) -> DataFrame:
    """(node, component): the least node that each node is linked to, over any number of links.

    Every round replaces each node's label by the least label around it, then by that label's own label, so that long
    chains halve; rounds end when nothing changes. Labels are checkpointed each round; no graph is collected.
    """
    links = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    links = checkpointed(links.unionByName(links.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    labels = checkpointed(links.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("l")))
    for _ in range(most_rounds):
        near = links.join(labels.select(F.col("x").alias("y"), F.col("l").alias("ly")), "y").groupBy("x").agg(F.min("ly").alias("m"))
        new = labels.join(near, "x").select("x", "l", F.least("l", "m").alias("n"))
        jump = new.join(labels.select(F.col("x").alias("n"), F.col("l").alias("k")), "n", "left")
        new = checkpointed(jump.select("x", F.col("l").alias("old"), F.least("n", F.coalesce("k", "n")).alias("l")))
        if new.where("old <> l").isEmpty():
            return new.select(F.col("x").alias("node"), F.col("l").alias("component"))
        labels = new.select("x", "l")
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def apply_aliases(df: DataFrame, column: str, aliases: DataFrame) -> DataFrame:
    """``df`` with names replaced by their canonical name where ``aliases`` (alias, canonical) has one."""
    once = aliases.groupBy(F.col("alias").alias(column)).agg(F.min("canonical").alias("_to"))
    return df.join(once, column, "left").withColumn(column, F.coalesce("_to", column)).drop("_to").select(*df.columns)


def sample_groups(mentions: DataFrame) -> DataFrame:
    """(source_paper_id, reason, group_key, confidence, samples): samples of a paper that belong together.

    Reasons: one variable with at least two values (0.9), one place mentioned together (0.72), one name pattern (0.68);
    each needs two samples. ``mentions`` has source_paper_id, sample_id, variable_name, variable_value and
    source_location.
    """
    m = mentions.where("source_paper_id IS NOT NULL AND sample_id IS NOT NULL").select("source_paper_id", "variable_name", "variable_value", "source_location", X.match_key(F.col("sample_id")).alias("s")).where("s <> ''")
    names = lambda: F.count_distinct("s")
    shared = m.where("variable_name IS NOT NULL AND variable_value IS NOT NULL").groupBy("source_paper_id", F.lower(F.trim("variable_name")).alias("group_key")).agg(names().alias("samples"), F.count_distinct("variable_value").alias("v")).where("v >= 2")
    shared = shared.select("source_paper_id", F.lit("variable").alias("reason"), "group_key", F.lit(0.9).alias("confidence"), "samples")
    place = m.withColumn("group_key", X.source_bucket(F.col("source_location"))).where("group_key IS NOT NULL").groupBy("source_paper_id", "group_key").agg(names().alias("samples"))
    place = place.select("source_paper_id", F.lit("place").alias("reason"), "group_key", F.when(F.col("group_key") == "unknown", 0.55).otherwise(0.72).alias("confidence"), "samples")
    shape = m.groupBy("source_paper_id", X.name_pattern(F.col("s")).alias("group_key")).agg(names().alias("samples"))
    shape = shape.select("source_paper_id", F.lit("pattern").alias("reason"), "group_key", F.lit(0.68).alias("confidence"), "samples")
    return shared.unionByName(place).unionByName(shape).where("samples >= 2")


def tolerant_matches(expected: DataFrame, actual: DataFrame, keys: list[str], value: str, tolerance: float = 1e-6, nullable: Sequence[str] = ()) -> DataFrame:
    """(expected_id, actual_id): pairs of equal keys whose numbers agree within a relative tolerance, by bins of log value.

    A null in one of the ``nullable`` keys equals another null; in any other key it equals nothing.
    """
    width = max(tolerance, 1e-9) * 1.01
    number = lambda c: F.col(c).try_cast("double") if isinstance(c, str) else c
    bin_ = lambda v: F.when(v == 0, F.lit(-(1 << 60))).otherwise(F.floor(F.log(F.abs(v)) / width))
    e = expected.select(*keys, F.col("id").alias("expected_id"), number(value).alias("_e")).where("_e IS NOT NULL").withColumn("_s", F.signum("_e"))
    e = e.withColumn("_b", bin_(F.col("_e")))
    a = actual.select(*keys, F.col("id").alias("actual_id"), number(value).alias("_a")).where("_a IS NOT NULL").withColumn("_s", F.signum("_a"))
    a = a.withColumn("_b", F.explode(F.array(bin_(F.col("_a")) - 1, bin_(F.col("_a")), bin_(F.col("_a")) + 1)))
    near = F.abs(F.col("_e") - F.col("_a")) <= tolerance * F.greatest(F.abs("_e"), F.abs("_a"))
    keys = [*keys, "_s", "_b"]
    a = a.withColumnsRenamed({k: f"_a_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_a_{k}")) if k in nullable else F.col(k) == F.col(f"_a_{k}") for k in keys]
    return e.join(a, same).where(near).select("expected_id", "actual_id").distinct()


def one_to_one(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """A greedy matching of ``pairs``: again and again the pairs that are the least of both their ends are taken.

    Every round is two aggregations and two joins; ties cannot occur, as pairs are distinct. Rounds are checkpointed.
    """
    left = checkpointed(pairs.select(F.col(a).alias("a"), F.col(b).alias("b")).distinct())
    taken = left.limit(0)
    while not left.isEmpty():
        of_a = left.groupBy("a").agg(F.min("b").alias("b"))
        of_b = left.groupBy("b").agg(F.min("a").alias("a"))
        now = checkpointed(of_a.join(of_b, ["a", "b"]).select("a", "b"))
        taken = taken.unionByName(now)
        left = checkpointed(left.join(now.select("a"), "a", "left_anti").join(now.select("b"), "b", "left_anti").select("a", "b"))
    return taken.select(F.col("a").alias(a), F.col("b").alias(b))


def gold_scores(expected: DataFrame, actual: DataFrame, matched: DataFrame, group: str) -> DataFrame:
    """(group, expected, actual, matched, precision, recall); a share of nothing is 1.

    Every fact of both sides counts: groups of one side only have a row, and so have the facts without group.
    """
    of = matched.join(expected.select(F.col("id").alias("expected_id"), group).distinct(), "expected_id").select(group, F.col("expected_id").alias("id"))
    sides = [df.select(group, F.lit(side).alias("side"), "id").distinct() for side, df in (("expected", expected), ("actual", actual), ("matched", of))]
    out = sides[0].unionByName(sides[1]).unionByName(sides[2]).groupBy(group).agg(*[F.count_if(F.col("side") == side).alias(side) for side in ("expected", "actual", "matched")])
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    ratio = lambda x, y: F.when(y == 0, 1.0).otherwise(F.round(x / y, 6))
    return out.select(group, n("expected").alias("expected"), n("actual").alias("actual"), n("matched").alias("matched"), ratio(n("matched"), n("actual")).alias("precision"), ratio(n("matched"), n("expected")).alias("recall"))


def restatements(facts: DataFrame, keys: list[str]) -> DataFrame:
    """(id, kept_id): facts of equal keys of which one's evidence contains another's; the longest is kept.

    Both texts have 30 characters or more. Within a key, facts are streamed from the longest; only kept texts are held,
    and a text that repeats a kept one exactly costs a look-up.
    """
    rows = facts.select("id", F.xxhash64(*keys).alias("k"), F.lower(F.regexp_replace("evidence_text", r"\s+", " ")).alias("t")).where("t IS NOT NULL")
    rows = rows.withColumn("n", -F.length("t")).repartition("k").sortWithinPartitions("k", "n", "t", "id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, kept, exact = None, [], {}
        for b in batches:
            out = []
            for i, k, t in zip(b["id"], b["k"], b["t"]):
                if k != here:
                    here, kept, exact = k, [], {}
                owner = exact.get(t)
                if owner is None and len(t) >= 30:
                    owner = next((j for j, u in kept if t in u), None)
                if owner is None:
                    owner = i
                    if len(t) >= 30:
                        kept.append((i, t))
                exact.setdefault(t, owner)
                out.append((i, owner))
            if out:
                yield pd.DataFrame(out, columns=["id", "kept_id"])

    return rows.select("id", "k", "t").mapInPandas(run, "id long, kept_id long")
