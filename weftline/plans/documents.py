"""Queries over blocks, pages and contexts of parsed documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import documents as D
from weftline.plans.registry import query
from weftline.sources.tables import table

BLOCKS = "(SELECT DISTINCT id, paper_id, page_number, order_index, block_type, section_name, text, html FROM document_blocks)"


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "document_blocks", "id", "paper_id", "page_number", "order_index", "block_type", "section_name", "text", "html").dropDuplicates(["id"])


@query("section_forward_fill", f"SELECT id, paper_id, last_value(section_name IGNORE NULLS) OVER (PARTITION BY paper_id, page_number ORDER BY order_index, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section_name FROM {BLOCKS}")
def section_forward_fill(spark: SparkSession, d: str) -> DataFrame:
    return D.carried_sections(_blocks(spark, d))


@query("section_state_machine")
def section_state_machine(spark: SparkSession, d: str) -> DataFrame:
    return D.sections(_blocks(spark, d))


@query("page_text_listagg", f"SELECT paper_id, page_number, count(*) AS n_blocks, string_agg(text, chr(10) || chr(10) ORDER BY order_index, id) AS text FROM {BLOCKS} WHERE text IS NOT NULL AND text <> '' GROUP BY 1, 2")
def page_text_listagg(spark: SparkSession, d: str) -> DataFrame:
    return D.page_texts(_blocks(spark, d))


@query(
    "page_inventory",
    f"""SELECT paper_id, page_number, sum(length(coalesce(text, ''))) AS text_length, count(CASE WHEN block_type IN ('figure', 'figure_caption') THEN 1 END) AS figures,
    coalesce(bool_or(coalesce(block_type = 'table', false) OR html IS NOT NULL), false) AS has_table, coalesce(bool_or(block_type = 'figure_caption'), false) AS has_caption, coalesce(bool_or(section_name = 'experimental'), false) AS has_experimental,
    bool_or(lower(coalesce(text, '')) LIKE '%supplementary%') AS has_supplementary, array_to_string(list_sort(list(DISTINCT block_type) FILTER (block_type IS NOT NULL)), ',') AS block_types FROM {BLOCKS} GROUP BY 1, 2""",
)
def page_inventory(spark: SparkSession, d: str) -> DataFrame:
    return D.page_inventory(_blocks(spark, d))


_WORD_SCORES = " + ".join(f"CASE WHEN regexp_matches(coalesce(text, ''), '(?i){D.whole_words(p)}') THEN {n} ELSE 0 END" for p, n in D.SIGNALS)
_SCORE = f"""CASE block_type WHEN 'table' THEN 12 WHEN 'figure_caption' THEN 8 ELSE 0 END + CASE section_name WHEN 'results' THEN 6 WHEN 'experimental' THEN 5 WHEN 'conclusion' THEN 2 ELSE 0 END
    + least(5, length(regexp_replace(coalesce(text, ''), '[^0-9]', '', 'g')) // 10) + {_WORD_SCORES}"""


@query("chunk_signal_score", f"SELECT id, CAST({_SCORE} AS INTEGER) AS score FROM {BLOCKS}")
def chunk_signal_score(spark: SparkSession, d: str) -> DataFrame:
    return _blocks(spark, d).select("id", D.signal_score(F.col("text"), F.col("block_type"), F.col("section_name")).alias("score"))


@query("neighbour_context", f"SELECT id, paper_id, page_number FROM (SELECT *, max(CASE WHEN {_SCORE} >= 14 THEN 1 ELSE 0 END) OVER (PARTITION BY paper_id, page_number ORDER BY order_index, id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near FROM {BLOCKS}) WHERE near = 1")
def neighbour_context(spark: SparkSession, d: str) -> DataFrame:
    chosen = D.signal_score(F.col("text"), F.col("block_type"), F.col("section_name")) >= 14
    return D.with_neighbours(_blocks(spark, d), chosen).select("id", "paper_id", "page_number")


@query("batch_packing")
def batch_packing(spark: SparkSession, d: str) -> DataFrame:
    return D.packed_batches(_blocks(spark, d), most_chars=6000, most_blocks=12)


@query(
    "text_within_budget",
    f"""WITH b AS (SELECT id, paper_id, text, sum(length(text)) OVER (PARTITION BY paper_id ORDER BY page_number, order_index, id ROWS UNBOUNDED PRECEDING) - length(text) AS used FROM {BLOCKS} WHERE text IS NOT NULL AND text <> '')
    SELECT id, paper_id, CASE WHEN used + length(text) <= 8000 THEN text ELSE substring(text, 1, CAST(8000 - used AS BIGINT)) END AS text FROM b WHERE used < 8000 AND (used + length(text) <= 8000 OR 8000 - used > 500)""",
)
def text_within_budget(spark: SparkSession, d: str) -> DataFrame:
    return D.text_within_budget(_blocks(spark, d), 8000)


@query(
    "markdown_to_blocks",
    """WITH s AS (SELECT DISTINCT paper_id, string_split_regex(regexp_replace(markdown_text, '\\n(#{1,6} )', '\n\n\\1', 'g'), '\\n\\s*\\n') AS parts FROM document_contexts WHERE markdown_text IS NOT NULL),
    r AS (SELECT paper_id, unnest(range(1, len(parts) + 1)) AS i, parts FROM s), t AS (SELECT paper_id, CAST(i - 1 AS INTEGER) AS pos, trim(parts[i]) AS raw FROM r WHERE trim(parts[i]) <> '')
    SELECT paper_id, pos, CASE WHEN regexp_matches(raw, '^#{1,6} ') THEN 'heading' WHEN regexp_matches(raw, '^\\|.*\\|') THEN 'table' WHEN regexp_matches(raw, '^([-*+]|\\d+[.)]) ') THEN 'list' ELSE 'paragraph' END AS kind,
    length(regexp_extract(raw, '^(#{1,6}) ', 1)) AS level, regexp_replace(raw, '^#{1,6} ', '') AS text FROM t""",
)
def markdown_to_blocks(spark: SparkSession, d: str) -> DataFrame:
    return D.markdown_blocks(table(spark, d, "document_contexts", "paper_id", "markdown_text"))


@query(
    "html_table_to_tsv",
    f"""WITH t AS (SELECT id, paper_id, regexp_extract_all(html, '<tr>(.*?)</tr>', 1) AS rows FROM {BLOCKS} WHERE html LIKE '%<tr>%')
    SELECT id, paper_id, array_to_string(list_transform(rows, lambda r, i: CASE WHEN i = 1 THEN '[columns]' ELSE '[row ' || (i - 1) || ']' END || chr(9) || array_to_string(regexp_extract_all(r, '<t[hd]>(.*?)</t[hd]>', 1), chr(9))), chr(10)) AS tsv FROM t""",
)
def html_table_to_tsv(spark: SparkSession, d: str) -> DataFrame:
    return D.table_texts(_blocks(spark, d))


@query(
    "table_unpivot_facts",
    f"""WITH t AS (SELECT id, paper_id, regexp_extract_all(html, '<tr>(.*?)</tr>', 1) AS rows FROM {BLOCKS} WHERE html IS NOT NULL),
    h AS (SELECT id, paper_id, rows, regexp_extract_all(rows[1], '<t[hd]>(.*?)</t[hd]>', 1) AS head FROM t),
    r AS (SELECT id, paper_id, head, unnest(range(2, len(rows) + 1)) AS i, rows FROM h), c AS (SELECT id, paper_id, head, i - 1 AS row_no, regexp_extract_all(rows[i], '<t[hd]>(.*?)</t[hd]>', 1) AS cells FROM r),
    u AS (SELECT id, paper_id, head, row_no, cells, unnest(range(2, len(cells) + 1)) AS j FROM c)
    SELECT id, paper_id, CAST(row_no AS INTEGER) AS row_no, cells[1] AS row_name, CAST(j - 1 AS INTEGER) AS column_no, trim(regexp_replace(head[j], '\\s*\\([^()]*\\)$', '')) AS column_name, nullif(regexp_extract(head[j], '\\(([^()]*)\\)$', 1), '') AS unit, cells[j] AS value FROM u WHERE cells[j] <> ''""",
)
def table_unpivot_facts(spark: SparkSession, d: str) -> DataFrame:
    return D.table_cells(_blocks(spark, d))


@query("blocks_per_section", f"SELECT section_name, block_type, count(*) AS n, sum(length(coalesce(text, ''))) AS chars FROM {BLOCKS} GROUP BY 1, 2")
def blocks_per_section(spark: SparkSession, d: str) -> DataFrame:
    return _blocks(spark, d).groupBy("section_name", "block_type").agg(F.count("*").alias("n"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("chars"))


@query("related_blocks", "SELECT DISTINCT b.id, o.id AS related_id FROM (SELECT id, paper_id, unnest(related_block_ids) AS r FROM document_blocks) b JOIN document_blocks o ON o.paper_id = b.paper_id AND o.block_id = b.r")
def related_blocks(spark: SparkSession, d: str) -> DataFrame:
    blocks = table(spark, d, "document_blocks", "id", "paper_id", "block_id", "related_block_ids")
    links = blocks.select("id", "paper_id", F.explode("related_block_ids").alias("block_id"))
    return links.join(blocks.select(F.col("id").alias("related_id"), "paper_id", "block_id"), ["paper_id", "block_id"]).select("id", "related_id").distinct()


@query(
    "unparsed_page_lines",
    f"""SELECT DISTINCT p.id, p.line FROM (SELECT id, paper_id, page_number, unnest(string_split(text, chr(10))) AS line FROM document_pages) p WHERE trim(p.line) <> '' AND NOT EXISTS
    (SELECT 1 FROM (SELECT paper_id, page_number, unnest(string_split(text, chr(10))) AS line FROM {BLOCKS}) b WHERE b.paper_id = p.paper_id AND b.page_number = p.page_number AND b.line = p.line)""",
)
def unparsed_page_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of pages that no block of the page holds, met by equality on (paper, page, line)."""
    line = lambda c: F.explode(F.split(c, "\n"))
    pages = table(spark, d, "document_pages", "id", "paper_id", "page_number", "text").select("id", "paper_id", "page_number", line("text").alias("line")).where("trim(line) <> ''").distinct()
    held = _blocks(spark, d).select("paper_id", "page_number", line("text").alias("line")).distinct()
    return pages.join(held, ["paper_id", "page_number", "line"], "left_anti").select("id", "line")


@query(
    "page_chunks",
    f"""SELECT paper_id, page_number, 'text' AS source_type, min(order_index) AS order_index, arg_min(id, (order_index, id)) AS source_block_id, string_agg(text, chr(10) ORDER BY order_index, id) AS raw_text FROM {BLOCKS}
    WHERE trim(text) <> '' AND coalesce(block_type, '') NOT IN ('table', 'figure_caption') GROUP BY 1, 2
    UNION ALL SELECT paper_id, page_number, CASE block_type WHEN 'table' THEN 'table_text' ELSE 'figure_caption' END, order_index, id, text FROM {BLOCKS} WHERE trim(text) <> '' AND block_type IN ('table', 'figure_caption')""",
)
def page_chunks(spark: SparkSession, d: str) -> DataFrame:
    return D.text_chunks(_blocks(spark, d))


@query("context_windows")
def context_windows(spark: SparkSession, d: str) -> DataFrame:
    return D.context_windows(_blocks(spark, d), most_chars=4000, overlap=2)


@query("joined_tables")
def joined_tables(spark: SparkSession, d: str) -> DataFrame:
    return D.joined_tables(_blocks(spark, d))


@query(
    "transposed_unpivot",
    f"""WITH t AS (SELECT id, paper_id, regexp_extract_all(html, '<tr>(.*?)</tr>', 1) AS rows FROM {BLOCKS} WHERE html IS NOT NULL),
    h AS (SELECT id, paper_id, rows, regexp_extract_all(rows[1], '<t[hd]>(.*?)</t[hd]>', 1) AS head FROM t),
    r AS (SELECT id, paper_id, head, unnest(range(2, len(rows) + 1)) AS i, rows FROM h), c AS (SELECT id, paper_id, head, i - 1 AS row_no, regexp_extract_all(rows[i], '<t[hd]>(.*?)</t[hd]>', 1) AS cells FROM r),
    u AS (SELECT id, paper_id, head, row_no, cells, unnest(range(2, len(cells) + 1)) AS j FROM c)
    SELECT id, paper_id, CAST(j - 1 AS INTEGER) AS row_no, trim(regexp_replace(head[j], '\\s*\\([^()]*\\)$', '')) AS row_name, CAST(row_no AS INTEGER) AS column_no, trim(regexp_replace(cells[1], '\\s*\\([^()]*\\)$', '')) AS column_name,
    nullif(regexp_extract(cells[1], '\\(([^()]*)\\)$', 1), '') AS unit, cells[j] AS value FROM u WHERE cells[j] <> ''""",
)
def transposed_unpivot(spark: SparkSession, d: str) -> DataFrame:
    return D.transposed_cells(D.table_cells(_blocks(spark, d)))
