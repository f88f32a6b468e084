"""Queries of predicates, units, merging and roll-ups over facts, blocks, papers and jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import rules as U
from weftline.functions import text as X
from weftline.operators import documents as D
from weftline.operators import relational as R
from weftline.plans.documents import BLOCKS, _SCORE, _blocks
from weftline.plans.registry import query
from weftline.plans.values import _S
from weftline.sources.tables import table

ITEMS = "(SELECT DISTINCT * FROM candidate_items)"
RECORDS = "(SELECT DISTINCT * FROM candidate_records)"


def _quoted(values: list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _unit_sql(c: str) -> str:
    """``compared_unit`` in SQL."""
    t = f"lower(regexp_replace(trim(coalesce({c}, '')), '^\\[\\s*([^\\[\\]]+?)\\s*\\]$', '\\1'))"
    low = f"replace(replace(replace(regexp_replace({t}, '\\s+', '', 'g'), '−', '-'), '–', '-'), '·', '')"
    for a, b in (("**2", "²"), ("^2", "²"), ("**3", "3"), ("^3", "3"), ("³", "3")):
        low = f"replace({low}, '{a}', '{b}')"
    low = f"regexp_replace({low}, '\\((diameter|particle(size)?|length|width|height)\\)$', '')"
    cases = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in U.SAME_UNIT.items())
    return f"CASE WHEN regexp_matches({t}, '{U.RELATIVE_WORDS}') THEN '%' ELSE CASE {low} {cases} ELSE {low} END END"


_METRIC = "lower(trim(regexp_replace(coalesce({c}, ''), '[^0-9A-Za-z]+', '_', 'g'), '_'))"


@query("unit_comparison", f"SELECT performance_unit, {_unit_sql('performance_unit')} AS compared FROM (SELECT DISTINCT performance_unit FROM candidate_items)")
def unit_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Every distinct unit as it is compared with others."""
    return table(spark, d, "candidate_items", "performance_unit").distinct().select("performance_unit", U.compared_unit(F.col("performance_unit")).alias("compared"))


@query(
    "metric_unit_compat",
    f"""WITH r AS (SELECT m, us FROM (VALUES {", ".join(f"('{m}', [{_quoted(us)}])" for m, us in U.METRIC_UNITS.items())}) t(m, us)),
    p AS (SELECT performance_metric, performance_unit, {_METRIC.format(c='performance_metric')} AS k, {_unit_sql('performance_unit')} AS u FROM (SELECT DISTINCT performance_metric, performance_unit FROM candidate_items))
    SELECT performance_metric, performance_unit, CASE WHEN k = '' OR u = '' THEN false WHEN regexp_matches(k, '_(improvement|growth_rate|change|reduction)$') AND u IN ({_quoted(U.RELATIVE_UNITS)}) THEN true
    WHEN regexp_matches(k, '{U.PEAK_NAMES}') THEN u IN ({_quoted(U.WAVENUMBERS)}) OR (u = 'ev' AND contains(k, 'xps')) WHEN us IS NOT NULL THEN list_contains(us, u)
    WHEN u IN ('°c', 'k', '℃') THEN regexp_matches(k, 'temperature|tg|tm|td|melting|glass_transition|decomposition') WHEN u IN ({_quoted(U.DENSITY_UNITS)}) THEN regexp_matches(k, 'density|porosity')
    WHEN u IN ({_quoted(U.LENGTH_UNITS)}) THEN regexp_matches(k, 'roughness|diameter|thickness|size|width|length|fiber') WHEN u IN ({_quoted(U.WAVENUMBERS)}) THEN false
    WHEN u = 'ev' THEN regexp_matches(k, 'xps|binding') ELSE true END AS fits FROM p LEFT JOIN r ON r.m = p.k""",
)
def metric_unit_compat(spark: SparkSession, d: str) -> DataFrame:
    """Whether each distinct metric may have the unit that stands with it."""
    rows = table(spark, d, "candidate_items", "performance_metric", "performance_unit").distinct()
    rows = rows.withColumns({"k": U.metric_key(F.col("performance_metric")), "u": U.compared_unit(F.col("performance_unit"))})
    return rows.select("performance_metric", "performance_unit", U.unit_fits(F.col("k"), F.col("u")).alias("fits"))


@query(
    "placeholder_values",
    f"""SELECT performance_value, lower(trim(coalesce(performance_value, ''))) IN ('', {_quoted(U.PLACEHOLDERS)}) OR regexp_matches(lower(trim(coalesce(performance_value, ''))), 'see fig|see table|not given')
    OR NOT regexp_matches(coalesce(performance_value, ''), '[0-9]') AS placeholder FROM (SELECT DISTINCT performance_value FROM candidate_items)""",
)
def placeholder_values(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "candidate_items", "performance_value").distinct().select("performance_value", U.is_placeholder(F.col("performance_value")).alias("placeholder"))


@query("quantity_blocks", f"SELECT id, regexp_matches(coalesce(text, ''), '(?i){U.QUANTITY}') AS states_quantity FROM {BLOCKS}")
def quantity_blocks(spark: SparkSession, d: str) -> DataFrame:
    return _blocks(spark, d).select("id", U.states_quantity(F.col("text")).alias("states_quantity"))


_ERRORS = " ".join("WHEN " + " AND ".join("(" + " OR ".join(f"contains(lower(error), '{w}')" for w in ws) + ")" for ws in lists) + f" THEN '{code}'" for code, lists in U.ERROR_RULES)


@query("error_classify", f"SELECT CASE WHEN coalesce(error, '') = '' THEN NULL {_ERRORS} ELSE 'unknown_error' END AS code, count(*) AS n, count(DISTINCT job_id) AS jobs FROM (SELECT DISTINCT * FROM llm_calls) GROUP BY 1")
def error_classify(spark: SparkSession, d: str) -> DataFrame:
    """Calls and jobs by the code of their error message."""
    calls = R.once(table(spark, d, "llm_calls", "call_id", "job_id", "error"), "call_id")
    return calls.groupBy(U.error_code(F.col("error")).alias("code")).agg(F.count("*").alias("n"), F.count_distinct("job_id").alias("jobs"))


_SQUEEZED = "trim(regexp_replace(coalesce({c}, ''), '\\s+', ' ', 'g'))"


@query(
    "relevance_prefilter",
    f"""WITH c AS (SELECT paper_id, any_value(markdown_text) AS t FROM (SELECT DISTINCT paper_id, markdown_text FROM document_contexts) GROUP BY 1),
    x AS (SELECT p.id, {_SQUEEZED.format(c='p.paper_title')} AS title, {_SQUEEZED.format(c='c.t')} AS body FROM papers p LEFT JOIN c ON c.paper_id = p.id),
    y AS (SELECT id, body, lower(title || chr(10) || body) AS a, lower(title || chr(10) || substring(body, 1, 1600)) AS lead FROM x),
    z AS (SELECT id, CASE WHEN regexp_matches(lead, '{U.OTHER_TYPES}') THEN 'irrelevant/excluded_document_type' WHEN regexp_matches(lower(substring(body, 1, 160)), '^(.{{0,40}}\\s)?review( article)?\\b') THEN 'irrelevant/review_article'
    WHEN regexp_matches(a, '{U.FIELD_WORDS}') THEN 'eligible/fiber_signal' WHEN length(body) < 200 THEN 'review/insufficient_local_text'
    WHEN len(regexp_extract_all(a, '{U.CLINICAL_WORDS}')) >= 2 AND NOT regexp_matches(a, '{U.MATERIAL_WORDS}') THEN 'irrelevant/clinical_document_without_material_signal'
    WHEN regexp_matches(a, '{U.MATERIAL_WORDS}') THEN 'review/material_without_fiber_signal' ELSE 'review/no_fiber_signal' END AS v FROM y)
    SELECT id, split_part(v, '/', 1) AS decision, split_part(v, '/', 2) AS reason FROM z""",
)
def relevance_prefilter(spark: SparkSession, d: str) -> DataFrame:
    """Whether a paper belongs to the field, by its title and its whole text."""
    contexts = R.once(table(spark, d, "document_contexts", "paper_id", "markdown_text"), "paper_id")
    papers = table(spark, d, "papers", "id", "paper_title").join(contexts, F.col("id") == F.col("paper_id"), "left")
    return papers.select("id", U.relevance(F.col("paper_title"), F.col("markdown_text")).alias("v")).select("id", "v.decision", "v.reason")


ACTIVE = ["pending", "queued", "running", "cancelled"]


@query("active_jobs", f"SELECT project_id, paper_id, arg_max(id, (created_at, id)) AS job_id FROM (SELECT DISTINCT * FROM extraction_jobs) WHERE status IN ({_quoted(ACTIVE)}) GROUP BY 1, 2")
def active_jobs(spark: SparkSession, d: str) -> DataFrame:
    """The latest unfinished job of each paper."""
    jobs = table(spark, d, "extraction_jobs", "id", "project_id", "paper_id", "status", "created_at").where(F.col("status").isin(*ACTIVE))
    return jobs.groupBy("project_id", "paper_id").agg(F.max_by("id", F.struct("created_at", "id")).alias("job_id"))


@query("job_paper_join", "SELECT j.id AS job_id, j.status, p.paper_title, p.document_type FROM (SELECT DISTINCT id, paper_id, status FROM extraction_jobs) j JOIN papers p ON p.id = j.paper_id")
def job_paper_join(spark: SparkSession, d: str) -> DataFrame:
    jobs = R.once(table(spark, d, "extraction_jobs", "id", "paper_id", "status")).select(F.col("id").alias("job_id"), "paper_id", F.col("status"))
    papers = table(spark, d, "papers", "id", "paper_title", "document_type").withColumnRenamed("id", "paper_id")
    return jobs.join(papers, "paper_id").select("job_id", "status", "paper_title", "document_type")


@query("block_paper_join", f"SELECT b.id, coalesce(p.paper_title, '') AS paper_title, b.page_number FROM {BLOCKS} b LEFT JOIN papers p ON p.id = b.paper_id")
def block_paper_join(spark: SparkSession, d: str) -> DataFrame:
    papers = table(spark, d, "papers", "id", "paper_title").withColumnRenamed("id", "paper_id")
    return _blocks(spark, d).join(papers, "paper_id", "left").select("id", F.coalesce("paper_title", F.lit("")).alias("paper_title"), "page_number")


_RANK = "CASE extraction_method " + " ".join(f"WHEN '{m}' THEN {n}" for m, n in R.MERGE_RANK.items()) + " ELSE 0 END + CASE WHEN source_location ILIKE '%block%' THEN 2 ELSE 0 END + CASE WHEN trim(coalesce(sample_id, '')) <> '' THEN 2 ELSE 0 END + CASE WHEN trim(coalesce(evidence_text, '')) <> '' THEN 1 ELSE 0 END"


@query(
    "holistic_atomic_merge",
    f"""WITH r AS (SELECT id, source_paper_id, {_S.replace('sample_id', "coalesce(sample_id, '')")} AS sample, regexp_replace(trim(lower(performance_metric)), '\\s+', '_', 'g') AS metric, trim(performance_value) AS value,
    trim(regexp_replace(lower(coalesce(performance_condition, '')), '\\s+', ' ', 'g')) AS condition, performance_unit AS u, performance_method AS m, {_RANK} AS rank FROM {RECORDS} WHERE trim(performance_metric) <> '' AND trim(performance_value) <> '')
    SELECT arg_max(id, (rank, -id)) AS id, source_paper_id, sample, metric, value, condition, arg_max(u, (rank, -id)) FILTER (trim(u) <> '') AS unit, arg_max(m, (rank, -id)) FILTER (trim(m) <> '') AS method, count(*) AS merged FROM r GROUP BY 2, 3, 4, 5, 6""",
)
def holistic_atomic_merge(spark: SparkSession, d: str) -> DataFrame:
    return R.merged_facts(R.once(table(spark, d, "candidate_records")))


@query(
    "append_unique_values",
    f"""WITH v AS (SELECT source_paper_id, sample_id, lower(trim(regexp_replace(structure_features, '\\s+', ' ', 'g'))) AS n, min(id) AS first_id, arg_min(structure_features, id) AS text FROM {RECORDS} WHERE trim(structure_features) <> '' GROUP BY 1, 2, 3)
    SELECT source_paper_id, sample_id, text, first_id, row_number() OVER (PARTITION BY source_paper_id, sample_id ORDER BY first_id) AS place FROM v""",
)
def append_unique_values(spark: SparkSession, d: str) -> DataFrame:
    """The different structure features of each sample, in the order in which they first stand."""
    return R.unique_values(R.once(table(spark, d, "candidate_records", "id", "source_paper_id", "sample_id", "structure_features")), ["source_paper_id", "sample_id"], "structure_features", "id")


@query("renumbered_facts", f"SELECT id, source_paper_id, row_number() OVER (PARTITION BY source_paper_id ORDER BY id) AS fact_no FROM {ITEMS}")
def renumbered_facts(spark: SparkSession, d: str) -> DataFrame:
    """Facts of each paper numbered in the order of their ids."""
    return R.numbered(R.once(table(spark, d, "candidate_items", "id", "source_paper_id")), ["source_paper_id"], "id", "fact_no")


@query(
    "distinct_samples",
    f"SELECT source_paper_id, {_S} AS sample, min(id) AS first_id, count(*) AS mentions FROM {ITEMS} WHERE sample_id IS NOT NULL GROUP BY 1, 2",
)
def distinct_samples(spark: SparkSession, d: str) -> DataFrame:
    """Samples of each paper by their display name, with the first fact that mentions them."""
    items = R.once(table(spark, d, "candidate_items", "id", "source_paper_id", "sample_id")).where("sample_id IS NOT NULL")
    return items.groupBy("source_paper_id", X.sample_name(F.col("sample_id")).alias("sample")).agg(F.min("id").alias("first_id"), F.count("*").alias("mentions"))


@query(
    "best_variable_per_sample",
    f"""SELECT source_paper_id, sample_id, arg_max(variable_name, (coalesce(ai_confidence, 0), -id)) AS variable_name, arg_max(coalesce(variable_value, ''), (coalesce(ai_confidence, 0), -id)) AS variable_value,
    arg_max(coalesce(variable_unit, ''), (coalesce(ai_confidence, 0), -id)) AS variable_unit FROM {RECORDS} WHERE trim(variable_name) <> '' AND sample_id IS NOT NULL GROUP BY 1, 2""",
)
def best_variable_per_sample(spark: SparkSession, d: str) -> DataFrame:
    """The variable that is surest of each sample; of equals the first."""
    rows = R.once(table(spark, d, "candidate_records", "id", "source_paper_id", "sample_id", "variable_name", "variable_value", "variable_unit", "ai_confidence")).where("trim(variable_name) <> '' AND sample_id IS NOT NULL")
    rank = F.struct(F.coalesce("ai_confidence", F.lit(0.0)), -F.col("id"))
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    top = rows.groupBy("source_paper_id", "sample_id").agg(F.max_by(F.struct("variable_name", blank("variable_value"), blank("variable_unit")), rank).alias("v"))
    return top.select("source_paper_id", "sample_id", "v.*")


@query(
    "fact_section_lookup",
    f"""WITH f AS (SELECT id, source_paper_id, regexp_extract(source_location, 'block (\\w+)', 1) AS b FROM {RECORDS}),
    s AS (SELECT paper_id, block_id, min(section_name) AS section_name FROM document_blocks GROUP BY 1, 2)
    SELECT f.id, nullif(f.b, '') AS block_id, s.section_name FROM f LEFT JOIN s ON s.paper_id = f.source_paper_id AND s.block_id = f.b""",
)
def fact_section_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The section of the block that a fact's location names."""
    facts = R.once(table(spark, d, "candidate_records", "id", "source_paper_id", "source_location"))
    facts = facts.select("id", F.col("source_paper_id").alias("paper_id"), F.nullif(F.regexp_extract("source_location", r"block (\w+)", 1), F.lit("")).alias("block_id"))
    sections = table(spark, d, "document_blocks", "paper_id", "block_id", "section_name").groupBy("paper_id", "block_id").agg(F.min("section_name").alias("section_name"))
    return facts.join(sections, ["paper_id", "block_id"], "left").select("id", "block_id", "section_name")


_STATUS = "CASE review_status WHEN '通过' THEN 'approved' WHEN '存疑' THEN 'uncertain' ELSE review_status END"


@query(
    "quality_rows_long",
    f"""WITH r AS (SELECT count(*) AS n, count(CASE WHEN trim(evidence_text) <> '' THEN 1 END) AS e, count(CASE WHEN {_STATUS} = 'approved' THEN 1 END) AS a, count(CASE WHEN {_STATUS} = 'uncertain' THEN 1 END) AS u FROM {RECORDS}),
    p AS (SELECT count(*) AS n FROM papers), b AS (SELECT count(*) AS n FROM {BLOCKS})
    SELECT 'main_data_rows' AS metric, r.n AS value FROM r UNION ALL SELECT 'rows_with_evidence', r.e FROM r UNION ALL SELECT 'rows_without_evidence', r.n - r.e FROM r UNION ALL SELECT 'approved_rows', r.a FROM r
    UNION ALL SELECT 'uncertain_rows', r.u FROM r UNION ALL SELECT 'paper_count', p.n FROM p UNION ALL SELECT 'document_blocks', b.n FROM b""",
)
def quality_rows_long(spark: SparkSession, d: str) -> DataFrame:
    """Counters of the whole data, one per row."""
    records = R.once(table(spark, d, "candidate_records", "id", "evidence_text", "review_status"))
    status = X.status_name(F.col("review_status"))
    has = X.filled(F.col("evidence_text"))
    counts = {"main_data_rows": F.count("*"), "rows_with_evidence": F.count_if(has), "rows_without_evidence": F.count_if(~has), "approved_rows": F.count_if(status == "approved"), "uncertain_rows": F.count_if(status == "uncertain")}
    one = lambda df, parts: df.agg(*[v.alias(k) for k, v in parts.items()]).select(F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).alias("value")) for k in parts])).alias("x")).select("x.*")
    return one(records, counts).unionByName(one(table(spark, d, "papers", "id"), {"paper_count": F.count("*")})).unionByName(one(_blocks(spark, d), {"document_blocks": F.count("*")}))


@query(
    "bulk_summary_rollup",
    f"""WITH j AS (SELECT project_id, count(*) AS jobs, count(CASE WHEN status = 'completed' THEN 1 END) AS completed, count(CASE WHEN status = 'failed' THEN 1 END) AS failed, count(CASE WHEN status = 'cancelled' THEN 1 END) AS cancelled FROM (SELECT DISTINCT * FROM extraction_jobs) GROUP BY 1),
    p AS (SELECT project_id, count(*) AS papers, count(CASE WHEN NOT EXISTS (SELECT 1 FROM extraction_jobs e WHERE e.paper_id = papers.id) THEN 1 END) AS papers_without_job FROM papers GROUP BY 1),
    c AS (SELECT project_id, count(*) AS records, count(CASE WHEN coalesce(trim(evidence_text), '') = '' THEN 1 END) AS missing_evidence, count(CASE WHEN contains(reviewer_comment, 'qa_reason=') THEN 1 END) AS flagged, count(CASE WHEN ai_confidence < 0.65 THEN 1 END) AS low_confidence FROM {RECORDS} GROUP BY 1)
    SELECT p.project_id, papers, papers_without_job, coalesce(jobs, 0) AS jobs, coalesce(completed, 0) AS completed, coalesce(failed, 0) AS failed, coalesce(cancelled, 0) AS cancelled, coalesce(records, 0) AS records,
    coalesce(missing_evidence, 0) AS missing_evidence, coalesce(flagged, 0) AS flagged, coalesce(low_confidence, 0) AS low_confidence FROM p LEFT JOIN j USING (project_id) LEFT JOIN c USING (project_id)""",
)
def bulk_summary_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Papers, jobs and records of each project; every table is counted before they meet."""
    jobs = R.once(table(spark, d, "extraction_jobs", "id", "project_id", "paper_id", "status"))
    is_ = lambda s: F.count_if(F.col("status") == s).alias(s)
    per_job = jobs.groupBy("project_id").agg(F.count("*").alias("jobs"), is_("completed"), is_("failed"), is_("cancelled"))
    have = jobs.select("paper_id").where("paper_id IS NOT NULL").distinct().withColumn("has", F.lit(True))
    papers = table(spark, d, "papers", "id", "project_id").withColumnRenamed("id", "paper_id").join(have, "paper_id", "left")
    per_paper = papers.groupBy("project_id").agg(F.count("*").alias("papers"), F.count_if(F.col("has").isNull()).alias("papers_without_job"))
    records = R.once(table(spark, d, "candidate_records", "id", "project_id", "evidence_text", "reviewer_comment", "ai_confidence"))
    per_record = records.groupBy("project_id").agg(
        F.count("*").alias("records"), F.count_if(~X.filled(F.col("evidence_text"))).alias("missing_evidence"), F.count_if(F.contains("reviewer_comment", F.lit("qa_reason="))).alias("flagged"), F.count_if(F.col("ai_confidence") < 0.65).alias("low_confidence")
    )
    out = per_paper.join(per_job, "project_id", "left").join(per_record, "project_id", "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("jobs", "completed", "failed", "cancelled", "records", "missing_evidence", "flagged", "low_confidence")]
    return out.select("project_id", "papers", "papers_without_job", *zero)


@query("performance_chunks", f"SELECT id, paper_id FROM (SELECT *, coalesce(section_name IN ('results', 'conclusion'), false) OR coalesce(block_type IN ('table', 'figure_caption'), false) AS w, bool_or(coalesce(section_name IN ('results', 'conclusion'), false) OR coalesce(block_type IN ('table', 'figure_caption'), false)) OVER (PARTITION BY paper_id) AS any_w FROM {BLOCKS}) WHERE w OR NOT any_w")
def performance_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of results, conclusions, tables and captions; all blocks of papers without any."""
    wanted = F.coalesce(F.col("section_name").isin("results", "conclusion"), F.lit(False)) | F.coalesce(F.col("block_type").isin("table", "figure_caption"), F.lit(False))
    return R.prior_or_all(_blocks(spark, d), "paper_id", wanted).select("id", "paper_id")


@query("top_chunks", f"SELECT id, paper_id FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY {_SCORE} DESC, id) AS n FROM {BLOCKS}) WHERE n <= 30")
def top_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The thirty blocks of each paper that promise most facts."""
    scored = _blocks(spark, d).select("id", "paper_id", D.signal_score(F.col("text"), F.col("block_type"), F.col("section_name")).alias("score"))
    return R.top_per(scored, "paper_id", [F.desc("score"), F.asc("id")], 30).select("id", "paper_id")


@query("review_comment_tokens", f"SELECT id, trim(t) AS token, CASE WHEN contains(t, '=') THEN trim(split_part(t, '=', 1)) END AS name, CASE WHEN contains(t, '=') THEN trim(substring(t, position('=' IN t) + 1)) END AS value FROM (SELECT id, unnest(string_split(reviewer_comment, ';')) AS t FROM {RECORDS} WHERE reviewer_comment IS NOT NULL) WHERE trim(t) <> ''")
def review_comment_tokens(spark: SparkSession, d: str) -> DataFrame:
    """The parts of review comments, and name and value of those that have them."""
    rows = R.once(table(spark, d, "candidate_records", "id", "reviewer_comment")).select("id", F.explode(F.split("reviewer_comment", ";")).alias("t")).where("trim(t) <> ''")
    pair = lambda c: F.when(F.contains("t", F.lit("=")), F.trim(c))
    return rows.select("id", F.trim("t").alias("token"), pair(F.substring_index("t", "=", 1)).alias("name"), pair(F.substring(F.col("t"), F.instr("t", "=") + 1, F.length("t"))).alias("value"))
