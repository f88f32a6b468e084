"""Column functions for sample names, units, numbers and locations. All run in the JVM; nulls give nulls unless said."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_SUPER = ("⁰¹²³⁴⁵⁶⁷⁸⁹⁻⁺", "0123456789-+")


def let(col: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a column that is worked out once, however often the body uses it."""
    return F.element_at(F.transform(F.array(col), body), 1)


def squeeze(col: Column) -> Column:
    """White space runs as one space, trimmed."""
    return F.trim(F.regexp_replace(col, r"\s+", " "))


def sample_name(col: Column) -> Column:
    """A sample id for display: degree signs of one kind, single spaces, no marks around it."""
    col = F.replace(F.replace(col, F.lit("◦"), F.lit("°")), F.lit("℃"), F.lit("°C"))
    return F.btrim(squeeze(col), F.lit(" ,;:.()[]"))


def match_key(col: Column) -> Column:
    """A sample id for comparison: lower case, plain dashes, only letters, digits and ``. % + - /``."""
    col = F.translate(F.lower(sample_name(col)), "°−–—", " ---")
    return squeeze(F.regexp_replace(col, r"[^a-z0-9.%+\-/ ]+", " "))


def plain_science(col: Column) -> Column:
    """Scientific text with plain digits, signs and powers: superscripts, minus signs, LaTeX times, thousands commas."""
    col = F.regexp_replace(col, r"([⁰¹²³⁴⁵⁶⁷⁸⁹⁻⁺]+)", "^$1")
    col = F.translate(col, _SUPER[0] + "−–·∙⋅", _SUPER[1] + "--***")
    col = F.regexp_replace(F.regexp_replace(col, r"\\times|×", "*"), r"\^\{([^}]*)\}", "^$1")
    col = F.regexp_replace(F.replace(col, F.lit("$"), F.lit("")), r"(\d),(\d{3})\b", "$1$2")
    return squeeze(F.regexp_replace(col, r"(\d),(\d{3})\b", "$1$2"))


_SCI = r"^([+-]?\d+(?:\.\d+)?)\s*(?:[*x]\s*10\s*(?:\^|\*\*)?\s*([+-]?\d+)|[eE]([+-]?\d+))$"


def science_value(col: Column) -> Column:
    """``mantissa e exponent`` of a value written with a power of ten, a plain number as it stands, else null."""
    return let(plain_science(col), _science_of)


def _science_of(s: Column) -> Column:
    mantissa = F.regexp_replace(F.regexp_replace(F.regexp_extract(s, _SCI, 1), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    power = F.regexp_extract(s, _SCI, 2)
    exponent = F.regexp_replace(F.when(power != "", power).otherwise(F.regexp_extract(s, _SCI, 3)), r"^\+?(-?)0*(\d)", "$1$2")
    return F.when(s.rlike(_SCI), F.when(exponent.isin("0", "-0"), mantissa).otherwise(F.concat(mantissa, F.lit("e"), exponent))).when(s.rlike(r"^[+-]?\d+(\.\d+)?$"), s)


_WORDS = [
    ("<=", r"^(?:at most|no more than|up to|≤|<=)\s*"), (">=", r"^(?:at least|no less than|≥|>=)\s*"), ("<", r"^(?:less than|below|under|<)\s*"),
    (">", r"^(?:more than|greater than|above|over|>)\s*"), ("≈", r"^(?:about|approximately|approx\.?|roughly|around|ca\.?|~|≈|∼)\s*"),
]


def value_operator(col: Column) -> Column:
    """The comparison that a value begins with: ``<= >= < > ≈`` or ``=``; null for null."""
    v = F.lower(F.trim(col))
    return reduce(lambda w, x: w.when(v.rlike(x[1]), F.lit(x[0])), _WORDS[1:], F.when(v.rlike(_WORDS[0][1]), F.lit("<="))).otherwise(F.when(v.isNotNull(), F.lit("=")))


def without_operator(col: Column) -> Column:
    """A value without the comparison it begins with."""
    v = F.trim(col)
    return reduce(lambda c, x: F.regexp_replace(c, "(?i)" + x[1], ""), _WORDS, v)


_NUM = r"[+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?"


def value_variants(col: Column) -> Column:
    """array<struct<role, clean, spread>>: one scalar, or the two ends of a range; empty for anything else.

    ``clean`` is a plain number, preceded by the operator unless that is ``=``; ``spread`` a stated deviation.
    """
    op = value_operator(col)
    mark = F.when(op == "=", "").otherwise(op)
    return let(F.struct(F.trim(without_operator(plain_science(col))).alias("v"), mark.alias("m")), lambda x: _variants_of(x["v"], x["m"]))


def _variants_of(v: Column, mark: Column) -> Column:
    one = science_value(F.regexp_extract(v, rf"^({_NUM}(?:\s*[*x]\s*10\s*\^?\s*[+-]?\d+)?)", 1))
    spread = F.coalesce(F.nullif(F.regexp_extract(v, rf"^{_NUM}\s*(?:±|\+/-)\s*({_NUM})", 1), F.lit("")), F.nullif(F.regexp_extract(v, rf"^{_NUM}\s*\(({_NUM})\)", 1), F.lit("")))
    ranged = rf"^({_NUM})\s*(?:-|to|~)\s*({_NUM})(?!\d)"
    end = lambda role, g: F.struct(F.lit(role).alias("role"), F.concat(mark, F.regexp_extract(v, ranged, g)).alias("clean"), F.lit(None).cast("string").alias("spread"))
    none = F.array().cast("array<struct<role:string,clean:string,spread:string>>")
    single = let(one, lambda o: F.when(o.isNotNull(), F.array(F.struct(F.lit("scalar").alias("role"), F.concat(mark, o).alias("clean"), spread.alias("spread")))).otherwise(none))
    return F.when(v.rlike(ranged), F.array(end("range_min", 1), end("range_max", 2))).otherwise(F.coalesce(single, none))


def value_shape(col: Column) -> Column:
    """struct<shape, operator, low, high>: ``scalar``, ``range`` or ``text``, with numbers."""
    number = lambda x, i: F.regexp_replace(x[i]["clean"], r"^[<>=≈]+", "").try_cast("double")
    kind = lambda x: F.when(F.size(x) == 2, "range").when(F.size(x) == 1, "scalar").otherwise("text")

    def shape(x: Column) -> Column:
        low = F.when(F.size(x) >= 1, number(x, 0))
        return F.struct(kind(x).alias("shape"), value_operator(col).alias("operator"), low.alias("low"), F.when(F.size(x) == 2, number(x, 1)).otherwise(low).alias("high"))

    return let(value_variants(col), shape)


def number_signature(col: Column) -> Column:
    """All numbers of a text, ascending, joined by ``|``; empty if it has none."""
    found = F.regexp_extract_all(plain_science(col), F.lit(r"(\d+(?:\.\d+)?)"), 1)
    plain = F.transform(found, lambda x: F.when(F.contains(x, F.lit(".")), F.regexp_replace(F.regexp_replace(x, r"0+$", ""), r"\.$", "")).otherwise(x))
    return F.array_join(F.transform(F.array_sort(F.transform(plain, lambda x: F.struct(x.cast("double").alias("n"), x.alias("x")))), lambda s: s["x"]), "|")


def source_bucket(col: Column) -> Column:
    """Where a fact was found, coarsely: ``figure:N``, ``table:N``, ``page:N:section``, the text itself, or unknown."""
    low = F.lower(F.trim(col))
    n = lambda p: F.regexp_extract(low, p, 1)
    fig, tab, page = r"(?:fig\.?|figure)\s*([0-9]+[a-z]?)", r"table\s*([0-9]+[a-z]?)", r"(?:p\.|page)\s*([0-9]+)"
    section = n(r"(experimental|preparation|fabrication|materials|results|discussion)")
    return (
        F.when(low.rlike(fig), F.concat(F.lit("figure:"), n(fig))).when(low.rlike(tab), F.concat(F.lit("table:"), n(tab)))
        .when(low.rlike(page) & (section != ""), F.concat(F.lit("page:"), n(page), F.lit(":"), section)).when(low != "", low).otherwise("unknown")
    )


# fixed values: locations that say too little
COARSE_LOCATIONS = ["results_text", "experimental", "figure_caption", "table_text", "results", "figure", "table", "text", "unknown"]


def rough_location(col: Column) -> Column:
    """Whether a location is empty, a coarse word, a bare page, or names no page, figure, table, section or scheme."""
    low = F.coalesce(F.lower(F.trim(col)), F.lit(""))
    named = low.rlike(r"\b(?:p\.|fig\.)\w|\b(?:page|figure|table|section|scheme)\b|\bsec\.\w")
    return (low == "") | low.isin(*COARSE_LOCATIONS) | low.rlike(r"^p\.?\s*\d+\s*,?\s*(?:text|raw text|page)?$") | ~named


def name_pattern(col: Column) -> Column:
    """A sample id with its numbers, their units, and letters with numbers masked as ``#``."""
    s = F.regexp_replace(match_key(col), r"\b\d+(?:\.\d+)?\s*(?:wt%|vol%|%|deg|c|k|h|min|s)?\b", "#")
    s = F.regexp_replace(F.regexp_replace(s, r"\b[a-z]?[-_ ]?\d+[a-z]?\b", "#"), r"#+", "#")
    return F.btrim(s, F.lit(" -_/"))


def variable_of_name(col: Column) -> Column:
    """struct<name, value, unit> that a sample id states, such as a loading in wt%; nulls if it states none."""
    loading = r"(\d+(?:\.\d+)?)\s*wt%?\s*([A-Za-z]+)"
    ratio = r"(?:draw ratio|DR)\s*[-=]?\s*(\d+(?:\.\d+)?)"
    name = F.when(col.rlike(loading), F.concat(F.regexp_extract(col, loading, 2), F.lit(" loading"))).when(col.rlike(ratio), F.lit("draw ratio"))
    value = F.when(col.rlike(loading), F.regexp_extract(col, loading, 1)).when(col.rlike(ratio), F.regexp_extract(col, ratio, 1))
    return F.struct(name.alias("name"), value.alias("value"), F.when(col.rlike(loading), F.lit("wt%")).alias("unit"))


#: ordered: the first form that the text names counts
FORMS = ["nanofiber", "aerogel", "membrane", "hydrogel", "scaffold", "coating", "composite", "laminate", "fabric", "yarn", "foam", "film", "mat", "fiber"]


def sample_form(col: Column) -> Column:
    """The material form that a text names first in the order of FORMS, else null."""
    low = F.replace(F.lower(col), F.lit("fibre"), F.lit("fiber"))
    return reduce(lambda w, f: w.when(F.contains(low, F.lit(f)), F.lit(f)), FORMS[1:], F.when(F.contains(low, F.lit(FORMS[0])), F.lit(FORMS[0])))


def slug(col: Column, prefix: str = "metric_") -> Column:
    """A stable field name: ASCII words joined by ``_``, at most 80 characters, or the prefix and a digest."""
    s = F.substring(F.regexp_replace(F.regexp_replace(F.lower(col), r"[^a-z0-9]+", "_"), r"^_+|_+$", ""), 1, 80)
    return F.when(s != "", s).otherwise(F.concat(F.lit(prefix), F.substring(F.sha1(col), 1, 12)))


def safe_cell(col: Column) -> Column:
    """Text for a spreadsheet: no control characters, no text that reads as a formula."""
    s = F.regexp_replace(col, "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]", "")
    return F.when(s.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), s)).otherwise(s)


def safe_stem(col: Column, longest: int = 80) -> Column:
    """Text for a file name."""
    s = F.regexp_replace(squeeze(F.regexp_replace(col, r'[<>:"/\\|?*\x00-\x1f]', "_")), r"[. ]+$", "")
    s = F.substring(s, 1, longest)
    return F.when(F.upper(s).rlike(r"^(?:CON|PRN|AUX|NUL|COM\d|LPT\d)$"), F.concat(F.lit("_"), s)).when(s == "", "untitled").otherwise(s)


#: fixed values: statuses in both languages and the one name for each
STATUS_ALIASES = {
    "pending": "pending", "待审核": "pending", "approved": "approved", "通过": "approved", "modified": "modified", "已修改": "modified",
    "uncertain": "uncertain", "存疑": "uncertain", "missing": "missing", "缺失": "missing", "deleted": "deleted", "已删除": "deleted",
}


def status_name(col: Column) -> Column:
    """The one name of a status given in either language; unknown ones as they stand."""
    table = F.create_map(*[F.lit(x) for kv in STATUS_ALIASES.items() for x in kv])
    return F.coalesce(table[col], col)


def filled(col: Column) -> Column:
    """Whether a text is neither null nor blank."""
    return F.coalesce(F.trim(col) != "", F.lit(False))
