"""Characters that look the same: one table, and the JVM-side folding that needs no Python.

``LOOK_ALIKES`` maps Cyrillic and Greek letters to the Latin letter that most typefaces draw alike. Letters
that a reader can tell apart (alpha, beta, Delta, sharp s, superscripts) are not in it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: letters drawn alike
CYRILLIC = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X",
    "Ѕ": "S", "І": "I", "Ј": "J", "У": "Y", "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y",
    "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "Ԝ": "W", "Ԛ": "Q", "ӏ": "l", "Ү": "Y",
}
GREEK = {
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "ϳ": "j",
}
LOOK_ALIKES = CYRILLIC | GREEK

# fixed values: characters that leave no mark, and the spaces, hyphens and dots of one look
INVISIBLE = "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180e\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2060\u2061\u2062\u2063\u2064\ufeff"
SPACES = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
SAME_LOOK = {
    "\u2010": "-", "\u2011": "-", "\u00b5": "\u03bc", "\u212b": "\u00c5", "\u212a": "K", "\u2126": "\u03a9",
    "\u22c5": "\u00b7", "\u2219": "\u00b7", "\u2215": "/", "\u2044": "/", "\u2236": ":", "\u037e": ";", "\u0387": "\u00b7",
}

_WIDE = {chr(c + 0xFEE0): chr(c) for c in range(0x21, 0x7F)}


def _translate(col: Column, table: dict[str, str], dropped: str = "") -> Column:
    keep = list(table)
    return F.translate(col, "".join(keep) + dropped, "".join(table[k] for k in keep))


def fold_width(col: Column) -> Column:
    """Narrow forms, plain spaces and hyphens, nothing invisible; letters keep their script. JVM-side."""
    col = _translate(col, _WIDE | {s: " " for s in SPACES} | SAME_LOOK, INVISIBLE)
    return F.replace(F.replace(col, F.lit("℃"), F.lit("°C")), F.lit("℉"), F.lit("°F"))


def fold_letters(col: Column) -> Column:
    """``fold_width``, with look-alike letters brought to Latin whatever stands around them."""
    return _translate(fold_width(col), LOOK_ALIKES)
