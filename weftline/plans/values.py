"""Queries of the column functions over values, units, names and locations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import text as X
from weftline.operators import units
from weftline.plans.registry import query
from weftline.sources.tables import table

ITEMS = "(SELECT DISTINCT id, sample_id, source_location, performance_metric, performance_value, performance_unit, evidence_text FROM candidate_items)"


def _items(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return table(spark, d, "candidate_items", "id", *columns).distinct()


#: plain numbers with operator, spread or range, as SQL; the value's scientific forms are tested against Python
_V = "trim(performance_value)"
_OP = f"""CASE WHEN {_V} IS NULL THEN NULL WHEN regexp_matches(lower({_V}), '^(at most|no more than|up to|≤|<=)') THEN '<=' WHEN regexp_matches(lower({_V}), '^(at least|no less than|≥|>=)') THEN '>='
    WHEN regexp_matches(lower({_V}), '^(less than|below|under|<)') THEN '<' WHEN regexp_matches(lower({_V}), '^(more than|greater than|above|over|>)') THEN '>'
    WHEN regexp_matches(lower({_V}), '^(about|approximately|approx|roughly|around|ca|~|≈|∼)') THEN '≈' ELSE '=' END"""


@query("value_operator", f"SELECT id, {_OP} AS operator FROM {ITEMS}")
def value_operator(spark: SparkSession, d: str) -> DataFrame:
    return _items(spark, d, "performance_value").select("id", X.value_operator(F.col("performance_value")).alias("operator"))


@query("operator_counts", f"SELECT {_OP} AS operator, count(*) AS n FROM {ITEMS} GROUP BY 1")
def operator_counts(spark: SparkSession, d: str) -> DataFrame:
    return value_operator(spark, d).groupBy("operator").agg(F.count("*").alias("n"))


def plain_science_sql(c: str) -> str:
    """``plain_science`` as SQL."""
    x = f"translate(regexp_replace({c}, '([⁰¹²³⁴⁵⁶⁷⁸⁹⁻⁺]+)', '^\\1', 'g'), '⁰¹²³⁴⁵⁶⁷⁸⁹⁻⁺−–·∙⋅', '0123456789-+--***')"
    x = f"replace(regexp_replace(regexp_replace({x}, '\\\\times|×', '*', 'g'), '\\^\\{{([^}}]*)\\}}', '^\\1', 'g'), '$', '')"
    for _ in range(2):
        x = f"regexp_replace({x}, '(\\d),(\\d{{3}})\\b', '\\1\\2', 'g')"
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def number_signature_sql(c: str) -> str:
    """``number_signature`` as SQL."""
    found = f"regexp_extract_all({plain_science_sql(c)}, '(\\d+(?:\\.\\d+)?)', 1)"
    plain = "CASE WHEN contains(x, '.') THEN regexp_replace(regexp_replace(x, '0+$', ''), '\\.$', '') ELSE x END"
    return f"array_to_string(list_transform(list_sort(list_transform({found}, lambda x: {{'n': CAST({plain} AS DOUBLE), 'x': {plain}}})), lambda s: s.x), '|')"


@query("value_clean_variants")
def value_clean_variants(spark: SparkSession, d: str) -> DataFrame:
    """One row per scalar, two per range."""
    x = _items(spark, d, "performance_value").select("id", F.posexplode(X.value_variants(F.col("performance_value"))).alias("pos", "v"))
    return x.select("id", "pos", "v.role", "v.clean", "v.spread")


@query("value_shape")
def value_shape(spark: SparkSession, d: str) -> DataFrame:
    s = _items(spark, d, "performance_value").select("id", X.value_shape(F.col("performance_value")).alias("s"))
    return s.select("id", "s.shape", "s.operator", F.round("s.low", 9).alias("low"), F.round("s.high", 9).alias("high"))


_SCI = r"^([+-]?\d+(\.\d+)?)\s*([*x]\s*10\s*(\^|\*\*)?\s*([+-]?\d+)|[eE]([+-]?\d+))$"


@query(
    "sci_value_parse",
    f"""WITH s AS (SELECT id, {plain_science_sql('performance_value')} AS s FROM {ITEMS}),
    p AS (SELECT id, s, regexp_matches(s, '{_SCI}') AS sci, regexp_replace(regexp_replace(regexp_extract(s, '{_SCI}', 1), '(\\.\\d*?)0+$', '\\1'), '\\.$', '') AS m,
    regexp_replace(regexp_extract(s, '{_SCI}', 5) || regexp_extract(s, '{_SCI}', 6), '^\\+?(-?)0*(\\d)', '\\1\\2') AS e FROM s)
    SELECT id, CASE WHEN sci AND e IN ('0', '-0') THEN m WHEN sci THEN m || 'e' || e ELSE s END AS value FROM p WHERE sci OR regexp_full_match(s, '[+-]?\\d+(\\.\\d+)?')""",
)
def sci_value_parse(spark: SparkSession, d: str) -> DataFrame:
    return _items(spark, d, "performance_value").select("id", X.science_value(F.col("performance_value")).alias("value")).where("value IS NOT NULL")


@query("number_signature", f"SELECT id, {number_signature_sql('evidence_text')} AS numbers FROM {ITEMS}")
def number_signature(spark: SparkSession, d: str) -> DataFrame:
    return _items(spark, d, "evidence_text").select("id", X.number_signature(F.col("evidence_text")).alias("numbers"))


@query("unit_normalize")
def unit_normalize(spark: SparkSession, d: str) -> DataFrame:
    """Every distinct unit as stored with the unit and kind it stands for."""
    raw = table(spark, d, "candidate_items", "performance_unit").where("performance_unit IS NOT NULL").distinct()
    known = units.unit_table(spark).select("unit_key", "unit", "kind")
    return raw.withColumn("unit_key", units.unit_key(F.col("performance_unit"))).join(F.broadcast(known), "unit_key", "left").select("performance_unit", "unit", "kind")


@query("metric_kinds", "SELECT e.canonical_name, e.quantity_kind, c.common_unit, c.common_unit IS NOT NULL AS measurable FROM canonical_entries e LEFT JOIN common_units c ON c.quantity_kind = e.quantity_kind WHERE e.field_name = 'performance_metric'")
def metric_kinds(spark: SparkSession, d: str) -> DataFrame:
    entries = table(spark, d, "canonical_entries").where("field_name = 'performance_metric'").select("canonical_name", "quantity_kind")
    out = entries.join(table(spark, d, "common_units"), "quantity_kind", "left")
    return out.select("canonical_name", "quantity_kind", "common_unit", F.col("common_unit").isNotNull().alias("measurable"))


@query("metric_unit_conflicts")
def metric_unit_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of a canonically named metric that state a unit of another kind."""
    kinds = table(spark, d, "canonical_entries").where("field_name = 'performance_metric'").select(F.col("canonical_name").alias("metric_base"), F.col("quantity_kind").alias("expected_kind"))
    stated = units.stated_quantities(table(spark, d, "candidate_items")).where("unit IS NOT NULL")
    return stated.join(kinds, "metric_base").where("expected_kind IS NULL OR expected_kind <> kind").select("id", "metric_base", "unit", "kind", "expected_kind")


_S = "trim(regexp_replace(replace(replace(sample_id, '◦', '°'), '℃', '°C'), '\\s+', ' ', 'g'), ' ,;:.()[]')"


@query("sample_key_normalize", f"SELECT id, {_S} AS name, trim(regexp_replace(regexp_replace(translate(lower({_S}), '°−–—', ' ---'), '[^a-z0-9.%+\\-/ ]+', ' ', 'g'), '\\s+', ' ', 'g')) AS key FROM {ITEMS} WHERE regexp_full_match(sample_id, '[ -~]*')")
def sample_key_normalize(spark: SparkSession, d: str) -> DataFrame:
    """Of plainly typed sample ids; the others are told apart by their looks."""
    rows = _items(spark, d, "sample_id").where(F.col("sample_id").rlike(r"^[ -~]*$"))
    return rows.select("id", X.sample_name(F.col("sample_id")).alias("name"), X.match_key(F.col("sample_id")).alias("key"))


@query("sample_key_normalize_all")
def sample_key_normalize_all(spark: SparkSession, d: str) -> DataFrame:
    """Of all sample ids, also those beyond ASCII; nulls give nulls."""
    return _items(spark, d, "sample_id").select("id", X.sample_name(F.col("sample_id")).alias("name"), X.match_key(F.col("sample_id")).alias("key"))


_K = f"trim(regexp_replace(regexp_replace(translate(lower({_S}), '°−–—', ' ---'), '[^a-z0-9.%+\\-/ ]+', ' ', 'g'), '\\s+', ' ', 'g'))"


def pattern_sql(key: str) -> str:
    """``name_pattern`` in SQL, of a sample id's comparable form."""
    return f"trim(regexp_replace(regexp_replace(regexp_replace({key}, '\\b\\d+(\\.\\d+)?\\s*(wt%|vol%|%|deg|c|k|h|min|s)?\\b', '#', 'g'), '\\b[a-z]?[-_ ]?\\d+[a-z]?\\b', '#', 'g'), '#+', '#', 'g'), ' -_/')"


@query("name_pattern", f"SELECT id, {pattern_sql(_K)} AS pattern FROM {ITEMS} WHERE regexp_full_match(sample_id, '[ -~]*')")
def name_pattern(spark: SparkSession, d: str) -> DataFrame:
    """Of plainly typed sample ids."""
    rows = _items(spark, d, "sample_id").where(F.col("sample_id").rlike(r"^[ -~]*$"))
    return rows.select("id", X.name_pattern(F.col("sample_id")).alias("pattern"))


@query("name_pattern_all")
def name_pattern_all(spark: SparkSession, d: str) -> DataFrame:
    """Of all sample ids; nulls give nulls."""
    return _items(spark, d, "sample_id").select("id", X.name_pattern(F.col("sample_id")).alias("pattern"))


_L = "lower(trim(source_location))"


_FIG, _TAB, _PAGE, _SECTION = "(fig\\.?|figure)\\s*([0-9]+[a-z]?)", "table\\s*([0-9]+[a-z]?)", "(p\\.|page)\\s*([0-9]+)", "(experimental|preparation|fabrication|materials|results|discussion)"


BUCKET_SQL = f"""CASE WHEN regexp_matches({_L}, '{_FIG}') THEN 'figure:' || regexp_extract({_L}, '{_FIG}', 2) WHEN regexp_matches({_L}, '{_TAB}') THEN 'table:' || regexp_extract({_L}, '{_TAB}', 1)
    WHEN regexp_matches({_L}, '{_PAGE}') AND regexp_matches({_L}, '{_SECTION}') THEN 'page:' || regexp_extract({_L}, '{_PAGE}', 2) || ':' || regexp_extract({_L}, '{_SECTION}', 1)
    WHEN {_L} <> '' THEN {_L} ELSE 'unknown' END"""


@query("source_bucket", f"SELECT id, {BUCKET_SQL} AS bucket FROM {ITEMS}")
def source_bucket(spark: SparkSession, d: str) -> DataFrame:
    return _items(spark, d, "source_location").select("id", X.source_bucket(F.col("source_location")).alias("bucket"))


@query(
    "rough_location",
    f"""SELECT id, coalesce({_L}, '') IN ('', {", ".join(f"'{x}'" for x in X.COARSE_LOCATIONS)}) OR regexp_matches(coalesce({_L}, ''), '^p\\.?\\s*\\d+\\s*,?\\s*(text|raw text|page)?$')
    OR NOT regexp_matches(coalesce({_L}, ''), '\\b(p\\.|fig\\.)\\w|\\b(page|figure|table|section|scheme)\\b|\\bsec\\.\\w') AS rough FROM {ITEMS}""",
)
def rough_location(spark: SparkSession, d: str) -> DataFrame:
    return _items(spark, d, "source_location").select("id", X.rough_location(F.col("source_location")).alias("rough"))


@query(
    "variable_from_id",
    f"""SELECT id, CASE WHEN regexp_matches(sample_id, '(\\d+(\\.\\d+)?)\\s*wt%?\\s*([A-Za-z]+)') THEN regexp_extract(sample_id, '(\\d+(\\.\\d+)?)\\s*wt%?\\s*([A-Za-z]+)', 3) || ' loading' END AS name,
    CASE WHEN regexp_matches(sample_id, '(\\d+(\\.\\d+)?)\\s*wt%?\\s*([A-Za-z]+)') THEN regexp_extract(sample_id, '(\\d+(\\.\\d+)?)\\s*wt%?\\s*([A-Za-z]+)', 1) END AS value FROM {ITEMS} WHERE sample_id IS NOT NULL AND NOT regexp_matches(sample_id, 'draw ratio|DR')""",
)
def variable_from_id(spark: SparkSession, d: str) -> DataFrame:
    """Of sample ids that name no draw ratio."""
    rows = _items(spark, d, "sample_id").where(F.col("sample_id").isNotNull() & ~F.col("sample_id").rlike("draw ratio|DR")).select("id", X.variable_of_name(F.col("sample_id")).alias("v"))
    return rows.select("id", "v.name", "v.value")


@query("variable_from_id_all")
def variable_from_id_all(spark: SparkSession, d: str) -> DataFrame:
    """Of all sample ids, loadings and draw ratios, with the unit; nulls where an id states neither."""
    return _items(spark, d, "sample_id").select("id", X.variable_of_name(F.col("sample_id")).alias("v")).select("id", "v.name", "v.value", "v.unit")


@query("sample_form", "SELECT doc_id, CASE " + " ".join(f"WHEN contains(replace(lower(text), 'fibre', 'fiber'), '{f}') THEN '{f}'" for f in X.FORMS) + " END AS form FROM documents WHERE text IS NOT NULL")
def sample_form(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "text").where("text IS NOT NULL").select("doc_id", X.sample_form(F.col("text")).alias("form"))


@query("metric_slug", "SELECT performance_metric, substring(regexp_replace(regexp_replace(lower(performance_metric), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 80) AS slug FROM (SELECT DISTINCT performance_metric FROM candidate_items WHERE regexp_matches(performance_metric, '[a-zA-Z0-9]') AND regexp_full_match(performance_metric, '[ -~]*'))")
def metric_slug(spark: SparkSession, d: str) -> DataFrame:
    """Of plainly typed metrics."""
    rows = table(spark, d, "candidate_items", "performance_metric").where(F.col("performance_metric").rlike("^[ -~]*[a-zA-Z0-9][ -~]*$")).distinct()
    return rows.select("performance_metric", X.slug(F.col("performance_metric")).alias("slug"))


@query("metric_slug_all")
def metric_slug_all(spark: SparkSession, d: str) -> DataFrame:
    """Of every distinct metric that is not null; one without ASCII letters or digits gets a digest."""
    rows = table(spark, d, "candidate_items", "performance_metric").where("performance_metric IS NOT NULL").distinct()
    return rows.select("performance_metric", X.slug(F.col("performance_metric")).alias("slug"))


@query("file_stems", "SELECT id, substring(regexp_replace(trim(regexp_replace(regexp_replace(original_filename, '[<>:\"/\\\\|?*\\x00-\\x1f]', '_', 'g'), '\\s+', ' ', 'g')), '[. ]+$', ''), 1, 80) AS stem FROM papers WHERE original_filename <> ''")
def file_stems(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "papers", "id", "original_filename").where("original_filename <> ''").select("id", X.safe_stem(F.col("original_filename")).alias("stem"))
