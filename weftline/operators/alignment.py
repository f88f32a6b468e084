"""Facts from running text: sample-value pairs, contrasts, lists told apart by "respectively", evidence windows.

Row-wise text work that column expressions cannot say runs in Arrow batches of distinct texts. Nulls give empty lists.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NAME = r"[A-Z0-9][\w./+-]*(?:-[\w./+]+)*"
_NUMBER = r"[-+]?\d+(?:[.,]\d+)?"
_UNIT = r"(?:\s?(?:%|°C|°F|K|[kMG]?Pa|N|kN|nm|[µμ]m|mm|cm|g/cm3|mg/cm3|S/m|mS/cm|J/g|wt%|s|min|h|Hz|kHz|MHz))?"
_BRACKETED = re.compile(rf"({_NAME})\s*\(\s*({_NUMBER}){_UNIT}\s*\)")
_LISTS = re.compile(rf"({_NUMBER}{_UNIT}(?:(?:,\s*(?:and\s+)?|\s+and\s+){_NUMBER}{_UNIT})+)\s+for\s+((?:the\s+)?{_NAME}(?:(?:,\s*(?:and\s+)?|\s+and\s+)(?:the\s+)?{_NAME})+)\s*,?\s*\(?(?:respectively)?")
_NAMED_FIRST = re.compile(rf"({_NAME}(?:(?:,\s*(?:and\s+)?|\s+and\s+){_NAME})+)\s+(?:were|was|reached|showed|had|of)\s+({_NUMBER}{_UNIT}(?:(?:,\s*(?:and\s+)?|\s+and\s+){_NUMBER}{_UNIT})+)\s*,?\s*\(?respectively")
_SPLIT = re.compile(r",\s*(?:and\s+)?|\s+and\s+")
_WORD_ONLY = re.compile(r"^(?:the|of|in|by|at|and|for|to|fig|figure|table|peak|band|after|with)$", re.I)


def sample_value_pairs(text: str | None) -> list[tuple[str, str]]:
    """(sample, value) pairs that a text states: ``A (1 MPa) and B (2 MPa)``, ``1 and 2 for A and B``, ``A and B were 1 and 2, respectively``.

    A name must hold a capital or a digit and a letter, and be no plain word; lists pair up only if equally long.
    """
    if not text:
        return []
    found: list[tuple[str, str]] = []

    def add(name: str, value: str) -> None:
        name = re.sub(r"^the\s+", "", name.strip())
        number = re.match(_NUMBER, value.strip())
        if number and re.search(r"[A-Za-z]", name) and re.search(r"[A-Z0-9]", name) and not _WORD_ONLY.match(name) and (name, number.group()) not in found:
            found.append((name, number.group()))

    for m in _BRACKETED.finditer(text):
        add(*m.groups())
    for pattern, names_at, values_at in ((_LISTS, 2, 1), (_NAMED_FIRST, 1, 2)):
        for m in pattern.finditer(text):
            names, values = _SPLIT.split(m.group(names_at)), _SPLIT.split(m.group(values_at))
            if len(names) == len(values):
                for n, v in zip(names, values):
                    add(n, v)
    return found


_CONTRAST = re.compile(rf"\b(?:the\s+)?([\w\s/.-]{{2,60}}?)\s+of\s+(?:the\s+)?([\w\s/.+-]{{2,60}}?)\s+was\s+({_NUMBER})\s*([^\s,;.]*)\s*,?\s*(?:whereas|while)\s+that\s+of\s+(?:the\s+)?([\w\s/.+-]{{2,60}}?)\s+was\s+({_NUMBER})\s*([^\s,;.]*)")


def contrasts(text: str | None) -> list[tuple[str, str, str, str]]:
    """(metric, subject, value, unit): both sides of "the M of A was x u, whereas that of B was y u"."""
    out = []
    for m in _CONTRAST.finditer(text or ""):
        metric = re.sub(r"^the\s+", "", m.group(1).strip().split(",")[-1].strip(), flags=re.I)
        out += [(metric, m.group(2).strip(), m.group(3), m.group(4)), (metric, m.group(5).strip(), m.group(6), m.group(7))]
    return out


_PAIRS = T.ArrayType(T.StructType([T.StructField("sample", T.StringType()), T.StructField("value", T.StringType())]))
_SIDES = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("metric", "subject", "value", "unit")]))


@F.pandas_udf(_PAIRS)
def pairs_of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Column function of ``sample_value_pairs``."""
    for batch in texts:
        yield batch.map(lambda t: [{"sample": a, "value": b} for a, b in sample_value_pairs(t)])


@F.pandas_udf(_SIDES)
def contrasts_of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Column function of ``contrasts``."""
    for batch in texts:
        yield batch.map(lambda t: [dict(zip(("metric", "subject", "value", "unit"), c)) for c in contrasts(t)])


def stated_pairs(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, sample, value) of every pair that the texts state; texts without digits never reach Python."""
    rows = df.select(key, text).where(F.col(text).rlike(r"\d")).distinct()
    out = rows.select(key, F.posexplode(pairs_of(F.col(text))).alias("pos", "p"))
    return out.select(key, (F.col("pos") + 1).alias("pos"), "p.sample", "p.value")


def stated_contrasts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, metric, subject, value, unit) of every contrast that the texts state."""
    rows = df.select(key, text).where(F.col(text).rlike(r"\b(?:whereas|while)\b")).distinct()
    return rows.select(key, F.explode(contrasts_of(F.col(text))).alias("c")).select(key, "c.*")


def evidence_window(text: Column, needle: Column, longest: int = 1400) -> Column:
    """The sentence that holds ``needle`` and the one before it, at most ``longest`` characters; null if none holds it."""
    sentences = F.split(text, r"(?<=[.!?])\s+|(?<=[。！？])\s*(?=\S)")
    at = F.array_position(F.transform(sentences, lambda s: F.contains(s, needle)), F.lit(True)).cast("int")
    both = F.slice(sentences, F.greatest(at - 1, F.lit(1)), F.when(at > 1, 2).otherwise(1))
    return F.when(at >= 1, F.substring(F.array_join(both, " "), 1, longest))


def zipped_lists(df: DataFrame, names: str, values: str) -> DataFrame:
    """Rows of two packed lists as one row per position (pos, name, value); lists of unequal length give no row."""
    cut = lambda c: F.filter(F.split(F.col(c), r"\s*(?:;|,(?=\s)|\band\b)\s*"), lambda x: x != "")
    rows = df.withColumn("_n", cut(names)).withColumn("_v", cut(values)).where(F.size("_n") == F.size("_v"))
    out = rows.select("*", F.posexplode(F.arrays_zip(F.col("_n").alias("name"), F.col("_v").alias("value"))).alias("_p", "_z"))
    return out.withColumn("pos", F.col("_p") + 1).withColumn("name", F.col("_z.name")).withColumn("value", F.col("_z.value")).drop("_n", "_v", "_p", "_z")
