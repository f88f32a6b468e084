"""Mixing sources to target weights.

Every document gets a hash-random key. Within each source documents are range-sorted by it; token counts get
distributed prefix sums (sums per range first, then within each range), and each source is cut at its exact budget:
whole passes over the source while the budget allows, then the documents whose prefix sum still fits.

Only the sums per (source, range) meet in one window: as many rows as RANGES times the sources. A source that holds
a third of all rows is spread over RANGES tasks like any other.

Defined results: rows with a null source or a null or empty text take no part; a source without target contributes
nothing; a target whose source is missing reaches a share of 0; a source too small even with max_repeats falls short
and the shortfall is reported, not given to others. Sizes are tokens of a public tokenizer whose file is a parameter.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.session import checkpointed

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
RANGES = 512


def token_counter(path: str = TOKENIZER):
    """Column function: tokens of a text by the byte-level vocabulary of ranks at ``path``; null for null."""

    @F.pandas_udf(T.LongType())
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for batch in texts:
            yield batch.map(lambda t: None if t is None else len(encoding.encode_ordinary(t))).astype("Int64")

    return count


def sized(documents: DataFrame, tokenizer: str = TOKENIZER, size: str | None = None) -> DataFrame:
    """(doc_id, source, tokens), distinct, of the documents that take part."""
    docs = documents.select("doc_id", "source", "text").where("source IS NOT NULL AND text IS NOT NULL AND text <> ''")
    tokens = F.expr(size) if size is not None else token_counter(tokenizer)(F.col("text"))
    return docs.select("doc_id", "source", tokens.alias("tokens")).dropDuplicates(["doc_id"])


def _used(documents: DataFrame, targets: DataFrame, tokenizer: str, seed: int, size: str | None) -> DataFrame:
    """(source, doc_id, tokens, times, total) of all documents that take part, also those used 0 times."""
    # counting tokens is the dear part and the counts are read twice: they are written once
    rows = checkpointed(sized(documents, tokenizer, size)).withColumn("key", F.xxhash64(F.lit(seed), "source", "doc_id"))
    rows = rows.withColumn("range", F.floor((F.col("key") / 2.0**64 + 0.5) * RANGES).cast("int"))
    sums = rows.groupBy("source", "range").agg(F.sum("tokens").alias("s"))
    sums = sums.withColumn("before", F.sum("s").over(Window.partitionBy("source").orderBy("range")) - F.col("s"))
    have = sums.groupBy("source").agg(F.sum("s").alias("have"))
    total = rows.agg(F.sum("tokens")).first()[0] or 0
    plan = have.join(targets.select("source", "target_share", "max_repeats").dropDuplicates(["source"]), "source", "left")
    plan = plan.withColumn("total", F.lit(total).cast("bigint"))
    budget = F.least(F.coalesce("target_share", F.lit(0.0)) * F.col("total"), F.coalesce("max_repeats", F.lit(0)) * F.col("have").cast("double"))
    plan = plan.withColumn("budget", F.floor(budget)).withColumn("passes", F.floor(F.col("budget") / F.col("have"))).withColumn("rest", F.col("budget") - F.col("passes") * F.col("have"))
    sums = sums.join(plan.select("source", "passes", "rest", "total"), "source").select("source", "range", "before", "passes", "rest", "total")
    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id")
    upto = rows.withColumn("upto", F.sum("tokens").over(inside)).join(sums, ["source", "range"])
    times = F.col("passes") + F.when(F.col("upto") + F.col("before") <= F.col("rest"), 1).otherwise(0)
    return upto.select("source", "doc_id", "tokens", times.cast("int").alias("times"), "total")


def mix(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, seed: int = 17, size: str | None = None) -> DataFrame:
    """(source, doc_id, tokens, times): how often each document is used; documents unused have no row."""
    return _used(documents, targets, tokenizer, seed, size).where("times > 0").drop("total")


def mix_report(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, seed: int = 17, size: str | None = None) -> DataFrame:
    """(source, target_share, tokens_in, tokens_out, share_reached, most_uses, short) for every target."""
    used = _used(documents, targets, tokenizer, seed, size).groupBy("source")
    used = used.agg(F.sum("tokens").alias("i"), F.sum(F.col("tokens") * F.col("times")).alias("o"), F.max("times").alias("m"), F.max("total").alias("t"))
    out = targets.select("source", "target_share", "max_repeats").dropDuplicates(["source"]).join(used, "source", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    share = F.coalesce(F.round(F.col("o") / F.col("t"), 6), F.lit(0.0))
    short = F.coalesce(F.col("max_repeats") * F.col("i") < F.floor(F.col("target_share") * F.col("t")), F.col("target_share") > 0)
    return out.select("source", "target_share", zero("i").alias("tokens_in"), zero("o").alias("tokens_out"), share.alias("share_reached"), zero("m").alias("most_uses"), short.alias("short"))
