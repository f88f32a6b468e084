"""Several values packed in one field: one row per value, in order.

A finite-state tokenizer reads a field once, left to right. Its state is (inside quotes?, nesting depth, value
so far); delimiters count only outside quotes and at depth 0. The transition for each character:

- ``"`` opens a quoted stretch where a value begins and closes it unless doubled; a doubled quote inside is one
  quote, and a backslash inside takes the next quote or backslash literally;
- ``( [ {`` raise the depth, their partners lower it, and that of any bracket left open within; brackets left open
  at the end do not nest (the field is read again with that bracket as an ordinary character);
- ``; ； 、 • | newline tab`` always delimit; ``,`` and ``/`` only where white space (or the end) follows a comma,
  or white space surrounds a slash, as ``2,5`` or ``N,N'`` or ``UV/Vis`` are numbers and names.

Defined results: a null, empty or blank field gives no rows; empty values are skipped and take no position; an
unclosed quote is an ordinary character; repeated values are kept, each with its position.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ALWAYS = frozenset(";；、•|\n\t\r")
OPEN = {"(": ")", "[": "]", "{": "}", "（": "）"}
CLOSE = frozenset(OPEN.values())


def _closing_quote(text: str, start: int) -> int:
    """Place of the quote that closes the one before ``start``; -1 if none does."""
    at = start
    while at < len(text):
        if text[at] == "\\" and text[at + 1 : at + 2] in ('"', "\\"):
            at += 2
        elif text[at] == '"':
            if text[at + 1 : at + 2] != '"':
                return at
            at += 2
        else:
            at += 1
    return -1


def _unquoted(value: str) -> str:
    """A trimmed value without enclosing quotes, doubled and escaped quotes undone."""
    value = value.strip()
    if len(value) >= 2 and value[0] == '"' and _closing_quote(value, 1) == len(value) - 1:
        out, at, body = [], 0, value[1:-1]
        while at < len(body):
            if body[at] == "\\" and body[at + 1 : at + 2] in ('"', "\\") or body[at : at + 2] == '""':
                at += 1
            out.append(body[at])
            at += 1
        value = "".join(out).strip()
    return value


def split_packed(text: str | None) -> list[str]:
    """The values of one field, in order."""
    if not text or not text.strip():
        return []
    plain: set[int] = set()  # brackets that never close
    while True:
        values, begin, at, stack = [], 0, 0, []
        fresh = True  # nothing but white space in the value so far
        while at < len(text):
            c = text[at]
            if c == '"' and fresh:
                end = _closing_quote(text, at + 1)
                fresh = False
                if end >= 0:
                    at = end + 1
                    continue
            elif c in OPEN and at not in plain:
                stack.append((OPEN[c], at))
                fresh = False
            elif c in CLOSE and any(want == c for want, _ in stack):
                # brackets opened after the partner of this one never close
                while stack.pop()[0] != c:
                    pass
            elif not stack and (
                c in ALWAYS
                or c == ","
                and (at + 1 == len(text) or text[at + 1].isspace())
                or c == "/"
                and (at == 0 or text[at - 1].isspace())
                and (at + 1 == len(text) or text[at + 1].isspace())
            ):
                values.append(text[begin:at])
                begin, fresh = at + 1, True
            elif not c.isspace():
                fresh = False
            at += 1
        if not stack:
            values.append(text[begin:])
            return [v for v in map(_unquoted, values) if v]
        plain.update(place for _, place in stack)


@F.pandas_udf(T.ArrayType(T.StringType()))
def packed_values(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Column function of ``split_packed``."""
    for batch in texts:
        yield batch.map(split_packed)


def unpack_fields(df: DataFrame, key: str, fields: list[str], at_least: int = 2) -> DataFrame:
    """(key, field_name, pos, item_text): every value of every field that holds ``at_least`` values.

    Narrow: no shuffle but the one that drops repeated source rows, after a JVM-side filter has left only fields
    with some delimiter. Rows with a null key are kept under a null key.
    """
    # the fields of one row stand side by side, so that one pass of Python serves them all
    long = df.select(F.col(key).alias("_k"), F.posexplode(F.array(*[F.col(f).cast("string") for f in fields])).alias("_f", "_t"))
    names = F.array(*[F.lit(f) for f in fields])
    if at_least > 1:
        long = long.where(F.col("_t").rlike(r"[;；、•|\n\t\r,/]"))
    else:
        long = long.where(F.col("_t").isNotNull())
    long = long.distinct()
    parts = long.select("_k", "_f", packed_values("_t").alias("_v")).where(F.size("_v") >= at_least)
    return parts.select(
        F.col("_k").alias(key), F.element_at(names, F.col("_f") + 1).alias("field_name"), F.posexplode("_v").alias("_p", "item_text")
    ).select(key, "field_name", (F.col("_p") + 1).cast("int").alias("pos"), "item_text")


def pack_values(values: Column, delimiter: str = "; ") -> Column:
    """The way back: one field from values, quoting those that would be split."""
    quote = lambda v: F.when(
        v.rlike(r'[;；、•|\n\t\r,/"()\[\]{}（）]'), F.concat(F.lit('"'), F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('""')), F.lit('"'))
    ).otherwise(v)
    return F.array_join(F.transform(values, quote), delimiter)
