"""Queries of the llm operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm import canonical, leakage, lookalike, mixing, pieces, scan_repair, toxicity
from weftline.operators.units import metric_parts, unit_key, unit_table
from weftline.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Registers a query under its function's name."""
    QUERIES[f.__name__] = f
    return f


def _typed(spark: SparkSession, d: str) -> DataFrame:
    """(field_name, row_key, text) of the three freely typed fields; a field of settings gives a row for each."""
    names = table(spark, d, "canonical_entries").select("field_name", F.col("canonical_name").alias("text"))
    units = unit_table(spark).select(F.col("unit_key").alias("_k"), F.lit(1).alias("_u"))
    metric = table(spark, d, "candidate_items", "id", "performance_metric").where("performance_metric IS NOT NULL").distinct()
    metric = metric.select(F.lit("performance_metric").alias("field_name"), F.col("id").alias("row_key"), F.col("performance_metric").alias("text"))
    stage = table(spark, d, "llm_calls", "call_id", "stage").where("stage IS NOT NULL").distinct()
    stage = stage.select(F.lit("stage").alias("field_name"), F.col("call_id").alias("row_key"), F.col("stage").alias("text"))
    single = metric.unionByName(stage).join(F.broadcast(names), ["field_name", "text"], "left_anti")
    single = single.withColumn("_k", F.when(F.col("field_name") == "performance_metric", unit_key(metric_parts(F.col("text"))[1])))
    single = single.join(F.broadcast(units), "_k", "left").select("field_name", "row_key", canonical.without_unit(F.col("text"), F.col("_u")).alias("text"))
    packed = table(spark, d, "candidate_records", "id", "process_parameters").where("process_parameters IS NOT NULL")
    packed = packed.select(F.lit("process_parameters").alias("field_name"), F.col("id").alias("row_key"), F.explode(canonical.setting_names(F.col("process_parameters"))).alias("text"))
    return single.unionByName(packed)


@query
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    typed = _typed(spark, d)
    mapped = canonical.map_texts(typed, table(spark, d, "canonical_entries")).select("field_name", "text", "entry_id")
    return typed.join(mapped, ["field_name", "text"]).select("field_name", "row_key", "entry_id").distinct()


@query
def p1_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """Texts that stand for no entry, with how many rows have them."""
    typed = _typed(spark, d)
    mapped = canonical.map_texts(typed, table(spark, d, "canonical_entries")).where("entry_id = 0")
    return typed.join(mapped.select("field_name", "text"), ["field_name", "text"]).groupBy("field_name", "text").agg(F.countDistinct("row_key").alias("n_rows"))


def _limits(spark: SparkSession, d: str) -> dict[str, tuple[int, int]]:
    return {r.field_name: (r.max_chars, r.overlap_chars) for r in table(spark, d, "size_limits").collect()}


def _oversized(spark: SparkSession, d: str) -> list[tuple[str, DataFrame, int, int]]:
    limits = _limits(spark, d)
    blocks = table(spark, d, "document_blocks", "id", "text").select(F.col("id").alias("item_id"), "text")
    contexts = table(spark, d, "document_contexts", "paper_id", "markdown_text").select(F.col("paper_id").alias("item_id"), F.col("markdown_text").alias("text"))
    return [("block_text", blocks, *limits["block_text"]), ("markdown_text", contexts, *limits["markdown_text"])]


@query
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    parts = []
    for name, items, most, overlap in _oversized(spark, d):
        cut = pieces.split_items(items, most, overlap).groupBy("item_id").agg(F.max((F.col("unbroken") > most).cast("int")).alias("hard_cut"))
        parts.append(cut.select(F.lit(name).alias("field_name"), "item_id", "hard_cut"))
    return parts[0].unionByName(parts[1]).distinct()


@query
def p3_checks(spark: SparkSession, d: str) -> DataFrame:
    """Per field the texts cut, their characters put together again from the pieces, and how many pieces break a rule."""
    parts = []
    for name, items, most, overlap in _oversized(spark, d):
        p = pieces.split_items(items.distinct(), most, overlap)
        follows = Window.partitionBy("item_id").orderBy("piece_no")
        p = p.withColumn("before", F.lag("piece_end").over(follows)).withColumn("is_last", F.lead("piece_no").over(follows).isNull())
        size = F.length("piece_text")
        parts.append(
            p.agg(
                F.count_distinct("item_id").alias("texts"), F.coalesce(F.sum(size - F.when(F.col("before").isNull(), 0).otherwise(overlap)), F.lit(0)).alias("chars"),
                F.count_if(size > most).alias("too_long"), F.count_if(F.col("before") - F.col("piece_begin") != overlap).alias("wrong_overlap"), F.count_if(F.col("is_last") & (F.col("piece_end") != F.col("n_chars"))).alias("not_whole"),
            ).select(F.lit(name).alias("field_name"), "*")
        )
    return parts[0].unionByName(parts[1])


@query
def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    """All pieces of all texts of both fields."""
    parts = [pieces.all_pieces(items, most, overlap).select(F.lit(name).alias("field_name"), "*") for name, items, most, overlap in _oversized(spark, d)]
    return parts[0].unionByName(parts[1]).distinct()


def _scans(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    blocks = table(spark, d, "document_blocks", "id", "paper_id", "page_number", "order_index", "block_type", "text")
    return blocks, table(spark, d, "document_pages", "id", "paper_id", "page_number", "text")


@query
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return scan_repair.findings(*_scans(spark, d))


@query
def p4_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Every block that is no furniture as running text."""
    return scan_repair.repaired_blocks(*_scans(spark, d))


@query
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.same_looks(table(spark, d, "candidate_items"))


@query
def p6_repaired(spark: SparkSession, d: str) -> DataFrame:
    """Every distinct sample id, unit and evidence text as stored with its one form."""
    return lookalike.repair_fields(table(spark, d, "candidate_items", *lookalike.FIELDS))


@query
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_items(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "eval_items")).select("doc_id", "item_id")


@query
def p7_matches(spark: SparkSession, d: str) -> DataFrame:
    """The longest verbatim match of every leaked item in every document, with its place."""
    return leakage.leaked_items(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "eval_items"))


@query
def p7_clean(spark: SparkSession, d: str) -> DataFrame:
    """The corpus without the documents that hold a test item."""
    docs = table(spark, d, "documents")
    return leakage.without_leaks(docs, leakage.leaked_items(docs, table(spark, d, "eval_items"))).select("doc_id", "source", "n_chars")


@query
def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_report(table(spark, d, "documents", "doc_id", "source", "text"), table(spark, d, "mix_targets"))


@query
def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    """The mixture itself: each document with the number of its uses."""
    return mixing.mix(table(spark, d, "documents", "doc_id", "source", "text"), table(spark, d, "mix_targets"))


@query
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents", "doc_id", "source", "text")
    return toxicity.score_documents(docs, table(spark, d, "content_labels")).select("doc_id", "category")


@query
def p9_scores(spark: SparkSession, d: str) -> DataFrame:
    """Score, least E-value and its passage of every document that is not blank, for each category."""
    return toxicity.score_all(table(spark, d, "documents", "doc_id", "source", "text"), table(spark, d, "content_labels"))


@query
def p9_rates(spark: SparkSession, d: str) -> DataFrame:
    """Rates per source and category."""
    docs = table(spark, d, "documents", "doc_id", "source", "text")
    return toxicity.rates(docs, toxicity.score_documents(docs, table(spark, d, "content_labels")))


_STRETCH = r"[\s\v\x1c-\x1f\x85\pZ.!?;。！？；]"
ORACLE["p3_found"] = " UNION ".join(
    f"""SELECT '{field}' AS field_name, t.{key} AS item_id, CAST(list_max(list_transform(regexp_split_to_array(t.{text}, '{_STRETCH}'), lambda x: length(x))) > l.max_chars AS INTEGER) AS hard_cut
    FROM {name} t JOIN size_limits l ON l.field_name = '{field}' WHERE length(t.{text}) > l.max_chars"""
    for field, name, key, text in (("block_text", "document_blocks", "id", "text"), ("markdown_text", "document_contexts", "paper_id", "markdown_text"))
)

ORACLE["p3_checks"] = " UNION ALL ".join(
    f"""SELECT '{field}' AS field_name, count(DISTINCT k) AS texts, CAST(coalesce(sum(n), 0) AS BIGINT) AS chars, CAST(0 AS BIGINT) AS too_long, CAST(0 AS BIGINT) AS wrong_overlap, CAST(0 AS BIGINT) AS not_whole
    FROM (SELECT DISTINCT t.{key} AS k, t.{text}, length(t.{text}) AS n FROM {name} t JOIN size_limits l ON l.field_name = '{field}' WHERE length(t.{text}) > l.max_chars)"""
    for field, name, key, text in (("block_text", "document_blocks", "id", "text"), ("markdown_text", "document_contexts", "paper_id", "markdown_text"))
)


def _look_sql(c: str) -> str:
    """The look of a text in SQL: all look-alikes to one letter, whatever stands around them."""
    from weftline.functions import looks
    from weftline.llm.lookalike import _LIGATURES

    table = {chr(k + 0xFEE0): chr(k) for k in range(0x21, 0x7F)} | {s: " " for s in looks.SPACES} | looks.SAME_LOOK | looks.LOOK_ALIKES
    keys = "".join(table) + looks.INVISIBLE
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    out = f"translate({c}, {quote(keys)}, {quote(''.join(table.values()))})"
    for a, b in [*_LIGATURES, ("℃", "°C"), ("℉", "°F")]:
        out = f"replace({out}, '{a}', '{b}')"
    # a look-alike letter may take an accent: composed once before and once after
    return f"trim(nfc_normalize({out.replace(f'translate({c},', f'translate(nfc_normalize({c}),')}))"


ORACLE["p6_found"] = f"""WITH c AS (SELECT DISTINCT id, source_paper_id AS p, sample_id, performance_unit, evidence_text FROM candidate_items WHERE source_paper_id IS NOT NULL),
s AS (SELECT v, {_look_sql('v')} AS k FROM (SELECT DISTINCT sample_id AS v FROM c UNION SELECT DISTINCT performance_unit FROM c UNION SELECT DISTINCT evidence_text FROM c) WHERE v IS NOT NULL),
r AS (SELECT 'sample_id' AS field_name, id, p, sample_id AS v, '' AS other FROM c WHERE sample_id IS NOT NULL UNION ALL SELECT 'evidence_text', id, p, evidence_text, '' FROM c WHERE evidence_text IS NOT NULL
    UNION ALL SELECT 'performance_unit', c.id, c.p, c.performance_unit, s.k FROM c JOIN s ON s.v = c.sample_id WHERE c.performance_unit IS NOT NULL),
k AS (SELECT r.*, s.k FROM r JOIN s ON s.v = r.v)
SELECT DISTINCT a.field_name, a.id AS id_a, b.id AS id_b FROM k a JOIN k b ON a.field_name = b.field_name AND a.p = b.p AND a.k = b.k AND a.other = b.other AND a.id < b.id AND a.v <> b.v"""
