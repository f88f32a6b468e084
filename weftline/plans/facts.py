"""Queries over candidates, records, papers, jobs and model calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions import text as X
from weftline.operators import alignment as A
from weftline.operators import lookup as L
from weftline.operators import matching as M
from weftline.operators import relational as R
from weftline.plans.registry import query
from weftline.plans.values import BUCKET_SQL, number_signature_sql, pattern_sql
from weftline.sources.tables import table
from weftline.streaming import progress

ITEMS = "(SELECT DISTINCT * FROM candidate_items)"
RECORDS = "(SELECT DISTINCT * FROM candidate_records)"
CALLS = "(SELECT DISTINCT * FROM llm_calls)"
STATUS_SQL = "CASE {c} WHEN '待审核' THEN 'pending' WHEN '通过' THEN 'approved' WHEN '已修改' THEN 'modified' WHEN '存疑' THEN 'uncertain' WHEN '缺失' THEN 'missing' WHEN '已删除' THEN 'deleted' ELSE {c} END"


def _items(spark: SparkSession, d: str) -> DataFrame:
    return R.once(table(spark, d, "candidate_items"))


def _records(spark: SparkSession, d: str) -> DataFrame:
    return R.once(table(spark, d, "candidate_records"))


@query("list_candidates_page", f"SELECT id, source_paper_id, sample_id, performance_metric, performance_value, review_status FROM {ITEMS} ORDER BY created_at DESC NULLS LAST, id DESC LIMIT 50 OFFSET 50")
def list_candidates_page(spark: SparkSession, d: str) -> DataFrame:
    df = R.page_of(_items(spark, d), [F.desc_nulls_last("created_at"), F.desc("id")], page=2, size=50)
    return df.select("id", "source_paper_id", "sample_id", "performance_metric", "performance_value", "review_status")


@query("list_by_status_alias", f"SELECT id, review_status, ai_confidence FROM {ITEMS} WHERE review_status IN ('pending', '待审核', 'uncertain', '存疑')")
def list_by_status_alias(spark: SparkSession, d: str) -> DataFrame:
    return R.with_status(_items(spark, d), ["pending", "存疑"]).select("id", "review_status", "ai_confidence")


@query("count_by_status", f"SELECT {STATUS_SQL.format(c='review_status')} AS status, count(*) AS n FROM {ITEMS} GROUP BY 1")
def count_by_status(spark: SparkSession, d: str) -> DataFrame:
    return _items(spark, d).groupBy(X.status_name(F.col("review_status")).alias("status")).agg(F.count("*").alias("n"))


@query(
    "project_stats",
    f"""SELECT p.project_id, count(DISTINCT p.id) AS papers, count(DISTINCT CASE WHEN p.status = 'completed' THEN p.id END) AS completed, count(c.id) AS candidates,
    count(CASE WHEN c.s = 'pending' THEN 1 END) AS pending, count(CASE WHEN c.s = 'approved' THEN 1 END) AS approved
    FROM papers p LEFT JOIN (SELECT id, source_paper_id, {STATUS_SQL.format(c='review_status')} AS s FROM {ITEMS}) c ON c.source_paper_id = p.id GROUP BY 1""",
)
def project_stats(spark: SparkSession, d: str) -> DataFrame:
    """Candidates are counted per paper before they meet the papers."""
    status = X.status_name(F.col("review_status"))
    per = _items(spark, d).groupBy("source_paper_id").agg(F.count("*").alias("c"), F.count_if(status == "pending").alias("p"), F.count_if(status == "approved").alias("a"))
    joined = table(spark, d, "papers", "id", "project_id", "status").join(per, F.col("id") == F.col("source_paper_id"), "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return joined.groupBy("project_id").agg(F.count_distinct("id").alias("papers"), F.count_distinct(F.when(F.col("status") == "completed", F.col("id"))).alias("completed"), total("c").alias("candidates"), total("p").alias("pending"), total("a").alias("approved"))


@query("export_counts", f"SELECT count(*) AS records, count(DISTINCT source_paper_id) AS papers FROM {RECORDS} WHERE candidate_status = 'active'")
def export_counts(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d).where("candidate_status = 'active'").agg(F.count("*").alias("records"), F.count_distinct("source_paper_id").alias("papers"))


JOB_COLUMNS = ["id", "project_id", "status", "model_name", "error_code"]


@query(
    "latest_job_per_paper",
    "SELECT paper_id, id, project_id, status, model_name, error_code FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY created_at DESC NULLS LAST, id DESC) AS r FROM (SELECT DISTINCT * FROM extraction_jobs)) WHERE r = 1",
)
def latest_job_per_paper(spark: SparkSession, d: str) -> DataFrame:
    jobs = table(spark, d, "extraction_jobs", "paper_id", "created_at", *JOB_COLUMNS)
    return R.latest(jobs, "paper_id", ["created_at", "id"]).select("paper_id", *JOB_COLUMNS)


@query("jobs_by_status", "SELECT status, error_code, count(*) AS n, round(avg(date_diff('second', started_at, finished_at)), 3) AS mean_seconds FROM (SELECT DISTINCT * FROM extraction_jobs) GROUP BY 1, 2")
def jobs_by_status(spark: SparkSession, d: str) -> DataFrame:
    jobs = table(spark, d, "extraction_jobs").distinct()
    seconds = F.unix_timestamp("finished_at") - F.unix_timestamp("started_at")
    return jobs.groupBy("status", "error_code").agg(F.count("*").alias("n"), F.round(F.avg(seconds), 3).alias("mean_seconds"))


@query("papers_without_job", "SELECT id FROM papers WHERE id NOT IN (SELECT paper_id FROM extraction_jobs WHERE paper_id IS NOT NULL)")
def papers_without_job(spark: SparkSession, d: str) -> DataFrame:
    return R.missing_from(table(spark, d, "papers", "id"), table(spark, d, "extraction_jobs").select(F.col("paper_id").alias("id")), "id")


@query(
    "papers_fully_reviewed",
    f"SELECT DISTINCT source_paper_id AS paper_id FROM {RECORDS} r WHERE source_paper_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {RECORDS} q WHERE q.source_paper_id = r.source_paper_id AND q.review_status IN ('pending', '待审核'))",
)
def papers_fully_reviewed(spark: SparkSession, d: str) -> DataFrame:
    records = table(spark, d, "candidate_records", "source_paper_id", "review_status")
    return R.missing_from(records, R.with_status(records, ["pending"]), "source_paper_id").withColumnRenamed("source_paper_id", "paper_id")


@query(
    "paper_counts",
    f"""SELECT source_paper_id AS paper_id, count(*) AS candidates, count(CASE WHEN trim(coalesce(performance_value, '')) <> '' THEN 1 END) AS with_value,
    count(CASE WHEN trim(coalesce(evidence_text, '')) <> '' THEN 1 END) AS with_evidence, count(CASE WHEN ai_confidence < 0.65 THEN 1 END) AS low_confidence,
    count(CASE WHEN lower(source_location) LIKE '%table%' THEN 1 END) AS from_tables, round(avg(ai_confidence), 9) AS mean_confidence FROM {ITEMS} GROUP BY 1""",
)
def paper_counts(spark: SparkSession, d: str) -> DataFrame:
    return _items(spark, d).groupBy(F.col("source_paper_id").alias("paper_id")).agg(
        F.count("*").alias("candidates"), F.count_if(X.filled(F.col("performance_value"))).alias("with_value"), F.count_if(X.filled(F.col("evidence_text"))).alias("with_evidence"),
        F.count_if(F.col("ai_confidence") < 0.65).alias("low_confidence"), F.count_if(F.contains(F.lower("source_location"), F.lit("table"))).alias("from_tables"), F.round(F.avg("ai_confidence"), 9).alias("mean_confidence"),
    )


DUPLICATE_KEY = ["source_paper_id", "sample_id", "performance_category", "performance_metric", "performance_value", "performance_unit", "evidence_text"]


@query("duplicate_rows_having", f"SELECT {', '.join(DUPLICATE_KEY)}, count(*) AS n FROM {ITEMS} GROUP BY {', '.join(DUPLICATE_KEY)} HAVING count(*) > 1")
def duplicate_rows_having(spark: SparkSession, d: str) -> DataFrame:
    return R.duplicate_groups(_items(spark, d), DUPLICATE_KEY)


@query("duplicates_per_paper", f"SELECT source_paper_id AS paper_id, sum(n - 1) AS duplicates FROM (SELECT source_paper_id, count(*) AS n FROM {ITEMS} GROUP BY {', '.join(DUPLICATE_KEY)} HAVING count(*) > 1) GROUP BY 1")
def duplicates_per_paper(spark: SparkSession, d: str) -> DataFrame:
    groups = R.duplicate_groups(_items(spark, d), DUPLICATE_KEY)
    return groups.groupBy(F.col("source_paper_id").alias("paper_id")).agg(F.sum(F.col("n") - 1).alias("duplicates"))


RECORD_TEXTS = ["sample_group_id", "sample_id", "material_system", "fiber_type", "variable_name", "variable_value", "composition_expression", "matrix_name", "process_route", "spinning_method", "process_parameters", "post_treatment", "structure_methods", "structure_features", "performance_metric", "performance_value", "performance_unit", "performance_method", "performance_condition", "performance_evidence", "evidence_text", "reviewer_comment", "source_location"]


@query(
    "fill_rates",
    " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(CASE WHEN trim({c}) <> '' THEN 1 END) AS filled, count(*) AS total, round(count(CASE WHEN trim({c}) <> '' THEN 1 END) / count(*), 6) AS rate FROM {RECORDS}" for c in RECORD_TEXTS),
)
def fill_rates(spark: SparkSession, d: str) -> DataFrame:
    return R.fill_rates(_records(spark, d), RECORD_TEXTS)


_N = "lower(trim(regexp_replace(coalesce({c}, ''), '\\s+', ' ', 'g')))"


@query(
    "quality_score_proxy",
    f"""WITH r AS (SELECT *, {', '.join(f"{_N.format(c=c)} AS k{i}" for i, c in enumerate(["sample_id", "performance_metric", "performance_value", "performance_unit", "performance_condition"]))} FROM {RECORDS}),
    s AS (SELECT count(*) AS n, count(CASE WHEN trim(sample_id) <> '' THEN 1 END) + count(CASE WHEN trim(performance_metric) <> '' THEN 1 END) + count(CASE WHEN trim(performance_value) <> '' THEN 1 END) + count(CASE WHEN trim(performance_evidence) <> '' THEN 1 END) AS got,
    count(CASE WHEN reviewer_comment LIKE '%qa_reason=%' THEN 1 END) AS flagged, count(DISTINCT (k0, k1, k2, k3, split_part(k4, '; export_tier_', 1))) AS keys FROM r)
    SELECT n, round(got / (4 * n), 4) AS completeness, round(1 - flagged / n, 4) AS clean, round(keys / n, 4) AS "unique", round(0.55 * got / (4 * n) + 0.30 * (1 - flagged / n) + 0.15 * keys / n, 4) AS score FROM s""",
)
def quality_score_proxy(spark: SparkSession, d: str) -> DataFrame:
    return R.completeness_score(_records(spark, d))


@query(
    "llm_rollup",
    f"""SELECT job_id, count(*) AS calls, count(CASE WHEN NOT success THEN 1 END) AS failed, count(CASE WHEN capped THEN 1 END) AS capped, sum(coalesce(nullif(total_tokens, 0), prompt_tokens + completion_tokens, 0)) AS tokens,
    round(sum(latency_ms), 1) AS latency_ms FROM {CALLS} GROUP BY 1""",
)
def llm_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Totals of 0 are taken from their parts."""
    calls = R.once(table(spark, d, "llm_calls"), "call_id")
    tokens = F.coalesce(F.nullif(F.col("total_tokens"), F.lit(0)), F.col("prompt_tokens") + F.col("completion_tokens"), F.lit(0))
    return calls.groupBy("job_id").agg(F.count("*").alias("calls"), F.count_if(~F.col("success")).alias("failed"), F.count_if("capped").alias("capped"), F.sum(tokens).alias("tokens"), F.round(F.sum("latency_ms"), 1).alias("latency_ms"))


@query("calls_per_hour", f"SELECT CAST(floor(epoch(recorded_at) / 3600) * 3600 AS BIGINT) AS begin, model, count(*) AS calls, count(CASE WHEN NOT success THEN 1 END) AS failed, sum(coalesce(total_tokens, 0)) AS tokens FROM {CALLS} WHERE recorded_at IS NOT NULL GROUP BY 1, 2")
def calls_per_hour(spark: SparkSession, d: str) -> DataFrame:
    calls = progress.windowed_calls(R.once(table(spark, d, "llm_calls"), "call_id"))
    return calls.withColumn("begin", F.unix_timestamp("begin"))


@query(
    "content_hash_dedupe",
    "SELECT content_sha256, min(id) AS kept_id, count(*) AS copies FROM papers WHERE content_sha256 IS NOT NULL GROUP BY 1",
)
def content_hash_dedupe(spark: SparkSession, d: str) -> DataFrame:
    papers = table(spark, d, "papers", "id", "content_sha256").where("content_sha256 IS NOT NULL")
    return papers.groupBy("content_sha256").agg(F.min("id").alias("kept_id"), F.count("*").alias("copies"))


@query("text_hash_dedupe", "SELECT sha256(text) AS digest, min(doc_id) AS kept_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def text_hash_dedupe(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents", "doc_id", "text").where("text IS NOT NULL")
    return docs.groupBy(F.sha2("text", 256).alias("digest")).agg(F.min("doc_id").alias("kept_id"), F.count("*").alias("copies")).where("copies > 1")


_RANK = """coalesce(CASE extraction_method WHEN 'rule_text_range' THEN 20 WHEN 'AI_holistic' THEN 8 WHEN 'AI_holistic_table' THEN 8 WHEN 'AI_table' THEN 6 WHEN 'AI_figure' THEN 5 END, 0)
    + CASE WHEN lower(source_location) LIKE '%table%' THEN 6 WHEN lower(source_location) LIKE '%fig%' THEN 5 ELSE 0 END + CASE WHEN trim(sample_id) <> '' THEN 2 ELSE 0 END + least(length(coalesce(evidence_text, '')), 200)"""


_OPERATOR = """CASE WHEN regexp_matches(v, '^(at most|no more than|up to|≤|<=)') THEN '<=' WHEN regexp_matches(v, '^(at least|no less than|≥|>=)') THEN '>=' WHEN regexp_matches(v, '^(less than|below|under|<)') THEN '<'
    WHEN regexp_matches(v, '^(more than|greater than|above|over|>)') THEN '>' WHEN regexp_matches(v, '^(about|approximately|approx|roughly|around|ca|~|≈|∼)') THEN '≈' ELSE '=' END"""


@query(
    "exact_fact_dedupe",
    f"""WITH r AS (SELECT *, lower(trim(performance_value)) AS v FROM {RECORDS}), k AS (SELECT *, CASE WHEN trim(performance_metric) <> '' AND trim(performance_value) <> '' THEN concat_ws(chr(31), coalesce(CAST(source_paper_id AS VARCHAR), ''), lower(trim(coalesce(sample_id, ''))), lower(trim(performance_metric)),
    {_OPERATOR} || '|' || coalesce(nullif({number_signature_sql('performance_value')}, ''), v), lower(trim(coalesce(performance_unit, ''))), lower(trim(coalesce(performance_condition, '')))) ELSE chr(31) || id END AS key FROM r)
    SELECT id, source_paper_id, sample_id, performance_metric, performance_value, extraction_method FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY {_RANK} DESC, id) AS n FROM k) WHERE n = 1""",
)
def exact_fact_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return R.exact_dedupe(_records(spark, d)).select("id", "source_paper_id", "sample_id", "performance_metric", "performance_value", "extraction_method")


@query(
    "best_fact_per_sample_metric",
    f"""SELECT source_paper_id, sample_id, performance_metric, id, performance_value, extraction_method FROM (SELECT *, row_number() OVER (PARTITION BY source_paper_id, sample_id, performance_metric ORDER BY {_RANK} DESC, id) AS r
    FROM {RECORDS} WHERE sample_id IS NOT NULL AND performance_metric IS NOT NULL) WHERE r = 1""",
)
def best_fact_per_sample_metric(spark: SparkSession, d: str) -> DataFrame:
    records = _records(spark, d).where("sample_id IS NOT NULL AND performance_metric IS NOT NULL")
    rank = R.evidence_rank(F.col("extraction_method"), F.col("source_location"), F.col("sample_id"), F.col("evidence_text"))
    best = R.first_by(records, ["source_paper_id", "sample_id", "performance_metric"], rank, [-F.col("id")])
    return best.select("source_paper_id", "sample_id", "performance_metric", "id", "performance_value", "extraction_method")


@query(
    "unanimous_fill",
    f"""WITH r AS (SELECT id, source_paper_id, sample_id, matrix_name, spinning_method FROM {RECORDS}),
    k AS (SELECT source_paper_id, sample_id, {', '.join(f"min(CASE WHEN trim({c}) <> '' THEN {_N.format(c=c)} END) AS lo_{c}, max(CASE WHEN trim({c}) <> '' THEN {_N.format(c=c)} END) AS hi_{c}, min(CASE WHEN trim({c}) <> '' THEN {c} END) AS v_{c}" for c in ("matrix_name", "spinning_method"))}
    FROM r WHERE source_paper_id IS NOT NULL AND sample_id IS NOT NULL GROUP BY 1, 2)
    SELECT id, {', '.join(f"CASE WHEN coalesce(trim({c}), '') = '' AND lo_{c} = hi_{c} THEN v_{c} ELSE {c} END AS {c}" for c in ("matrix_name", "spinning_method"))} FROM r LEFT JOIN k USING (source_paper_id, sample_id)""",
)
def unanimous_fill(spark: SparkSession, d: str) -> DataFrame:
    records = _records(spark, d).select("id", "source_paper_id", "sample_id", "matrix_name", "spinning_method")
    return R.unanimous_fill(records, ["source_paper_id", "sample_id"], ["matrix_name", "spinning_method"]).select("id", "matrix_name", "spinning_method")


@query(
    "record_first_evidence",
    f"""SELECT p.id, f.id AS first_id, f.evidence_text AS first_evidence_text FROM papers p LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_paper_id ORDER BY id) AS r
    FROM {ITEMS} WHERE evidence_text IS NOT NULL) WHERE r = 1) f ON f.source_paper_id = p.id""",
)
def record_first_evidence(spark: SparkSession, d: str) -> DataFrame:
    items = _items(spark, d).where("evidence_text IS NOT NULL").select("source_paper_id", "id", "evidence_text").withColumnRenamed("source_paper_id", "pid")
    papers = table(spark, d, "papers", "id").select(F.col("id").alias("pid"))
    out = R.first_match(papers, items, "pid", "id", ["id", "evidence_text"])
    return out.withColumnRenamed("pid", "id")


@query("record_signatures", f"""SELECT source_paper_id, sum(n) AS "rows", sha256(string_agg(d, chr(10) ORDER BY b)) AS signature FROM (SELECT source_paper_id, id // 1000 AS b, count(*) AS n,
    sha256(string_agg(concat_ws(chr(31), id, coalesce(review_status, ''), coalesce(performance_value, '')), chr(10) ORDER BY id)) AS d FROM {RECORDS} GROUP BY 1, 2) GROUP BY 1""")
def record_signatures(spark: SparkSession, d: str) -> DataFrame:
    return R.signatures(_records(spark, d), "source_paper_id", "id", ["id", "review_status", "performance_value"])


@query(
    "signature_changes",
    f"""WITH s AS (SELECT source_paper_id, id, review_status FROM {RECORDS}), g AS (SELECT source_paper_id, max(CASE WHEN review_status IN ('approved', '通过') THEN 1 ELSE 0 END) AS c, min(CASE WHEN review_status IN ('approved', '通过') THEN 1 ELSE 0 END) AS a FROM s WHERE source_paper_id IS NOT NULL GROUP BY 1)
    SELECT source_paper_id, CASE WHEN a = 1 THEN 'gone' ELSE 'different' END AS change FROM g WHERE c = 1""",
)
def signature_changes(spark: SparkSession, d: str) -> DataFrame:
    """What an export would find changed once the approved records are left out."""
    records = _records(spark, d).where("source_paper_id IS NOT NULL")
    open_ = records.where(F.coalesce(X.status_name(F.col("review_status")) != "approved", F.lit(True)))
    one = lambda df: R.signatures(df, "source_paper_id", "id", ["id", "review_status"])
    return R.changed(one(open_), one(records), "source_paper_id")


@query(
    "spread_sample",
    """SELECT id, journal, document_type, turn FROM (SELECT *, row_number() OVER (PARTITION BY journal, document_type ORDER BY sha256(concat('7', chr(31), id)), id) AS turn FROM papers)
    ORDER BY turn, journal NULLS FIRST, document_type NULLS FIRST LIMIT 40""",
)
def spread_sample(spark: SparkSession, d: str) -> DataFrame:
    papers = table(spark, d, "papers", "id", "journal", "document_type")
    return R.spread_sample(papers, ["journal", "document_type"], "id", "7", 40)


_KEY = "trim(regexp_replace(regexp_replace(translate(lower(trim(regexp_replace(replace(replace(sample_id, '◦', '°'), '℃', '°C'), '\\s+', ' ', 'g'), ' ,;:.()[]')), '°−–—', ' ---'), '[^a-z0-9.%+\\-/ ]+', ' ', 'g'), '\\s+', ' ', 'g'))"


@query(
    "similar_samples",
    f"""WITH n AS (SELECT DISTINCT source_paper_id AS g, sample_id AS n, list_sort(list_distinct(list_filter(string_split_regex({_KEY}, '[^a-z0-9.]+'), lambda t: t <> ''))) AS t FROM candidate_items WHERE source_paper_id IS NOT NULL AND sample_id IS NOT NULL),
    c AS (SELECT g, t, min(n) AS n FROM n WHERE len(t) > 0 GROUP BY 1, 2),
    p AS (SELECT a.g AS source_paper_id, a.n AS name_a, b.n AS name_b, round(len(list_intersect(a.t, b.t)) / len(list_distinct(a.t || b.t)), 6) AS similarity FROM c a JOIN c b ON a.g = b.g AND a.n < b.n)
    SELECT * FROM p WHERE similarity >= 0.6 - 1e-6""",
)
def similar_samples(spark: SparkSession, d: str) -> DataFrame:
    return M.similar_names(table(spark, d, "candidate_items", "source_paper_id", "sample_id"), "source_paper_id", "sample_id", 0.6)


@query("similar_sample_members")
def similar_sample_members(spark: SparkSession, d: str) -> DataFrame:
    """Every sample name of a paper with the name that stands for it in similar_samples."""
    return M.name_members(table(spark, d, "candidate_items", "source_paper_id", "sample_id"), "source_paper_id", "sample_id")


@query("sample_components")
def sample_components(spark: SparkSession, d: str) -> DataFrame:
    """Every sample of a paper with the least name of those linked to it through similar names, itself if there are none.

    Only representatives are linked; the least of a class is its representative, so members take its component.
    """
    pairs = similar_samples(spark, d)
    node = lambda c: F.concat_ws("\x1f", F.col("source_paper_id").cast("string"), F.col(c))
    found = M.connected(pairs.select(node("name_a").alias("a"), node("name_b").alias("b")), "a", "b")
    part = lambda c, i: F.element_at(F.split(c, "\x1f", 2), i)
    linked = found.select(part("node", 1).cast("long").alias("source_paper_id"), part("node", 2).alias("representative"), part("component", 2).alias("least"))
    members = similar_sample_members(spark, d).join(linked, ["source_paper_id", "representative"], "left")
    return members.select("source_paper_id", "sample_id", F.coalesce("least", "representative").alias("canonical"))


_PATTERN = pattern_sql(f"trim({_KEY}, ' ,;:.()[]')")
_BUCKET = BUCKET_SQL


@query(
    "sample_grouping",
    f"""WITH m AS (SELECT source_paper_id, variable_name, variable_value, {_BUCKET} AS bucket, {_KEY} AS s, {_PATTERN} AS pattern FROM {RECORDS} WHERE source_paper_id IS NOT NULL AND sample_id IS NOT NULL),
    g AS (SELECT source_paper_id, 'variable' AS reason, lower(trim(variable_name)) AS group_key, 0.9 AS confidence, count(DISTINCT s) AS samples FROM m WHERE s <> '' AND variable_name IS NOT NULL AND variable_value IS NOT NULL GROUP BY 1, 2, 3 HAVING count(DISTINCT variable_value) >= 2
    UNION ALL SELECT source_paper_id, 'place', bucket, CASE WHEN bucket = 'unknown' THEN 0.55 ELSE 0.72 END, count(DISTINCT s) FROM m WHERE s <> '' GROUP BY 1, 2, 3
    UNION ALL SELECT source_paper_id, 'pattern', pattern, 0.68, count(DISTINCT s) FROM m WHERE s <> '' GROUP BY 1, 2, 3) SELECT source_paper_id, reason, group_key, CAST(confidence AS DOUBLE) AS confidence, samples FROM g WHERE samples >= 2""",
)
def sample_grouping(spark: SparkSession, d: str) -> DataFrame:
    return M.sample_groups(_records(spark, d))


@query("gold_matching")
def gold_matching(spark: SparkSession, d: str) -> DataFrame:
    """Records approved as the expected facts, candidates as the found ones; greedy one-to-one scores per paper.

    Every fact of either side counts. Facts without unit match each other; facts without paper, sample, metric or
    number match nothing.
    """
    shape = X.value_shape(F.col("performance_value"))
    keys = ["source_paper_id", "sample_id", "performance_metric", "performance_unit"]
    expected = R.with_status(_records(spark, d), ["approved"]).select("id", *keys, shape["low"].alias("value"))
    actual = _items(spark, d).select("id", *keys, shape["low"].alias("value"))
    matched = M.one_to_one(M.tolerant_matches(expected, actual, keys, "value", nullable=["performance_unit"]), "expected_id", "actual_id")
    return M.gold_scores(expected, actual, matched, "source_paper_id")


@query("restated_facts")
def restated_facts(spark: SparkSession, d: str) -> DataFrame:
    """Candidates whose evidence is contained in another's of the same sample, metric and value."""
    return M.restatements(_items(spark, d), ["source_paper_id", "sample_id", "performance_metric", "performance_value", "performance_unit"])


@query("progress_throttle")
def progress_throttle(spark: SparkSession, d: str) -> DataFrame:
    """The finished calls of every job as its progress, thinned."""
    calls = R.once(table(spark, d, "llm_calls"), "call_id").where("job_id IS NOT NULL AND recorded_at IS NOT NULL")
    w = Window.partitionBy("job_id").orderBy("recorded_at", "call_id")  # the calls of one job
    percent = F.floor(100 * F.row_number().over(w) / F.count("*").over(Window.partitionBy("job_id"))).cast("int")
    return progress.throttle(calls.select("job_id", F.col("recorded_at").alias("ts"), F.coalesce("stage", F.lit("none")).alias("step"), percent.alias("percent")))


@query("main_data_rows", f"""SELECT id, CASE WHEN regexp_matches(v, '^[=+\\-@]') THEN '''' || v ELSE v END AS performance_value, CASE WHEN regexp_matches(s, '^[=+\\-@]') THEN '''' || s ELSE s END AS sample_id
    FROM (SELECT id, regexp_replace(performance_value, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g') AS v, regexp_replace(sample_id, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g') AS s FROM {RECORDS})""")
def main_data_rows(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d).select("id", X.safe_cell(F.col("performance_value")).alias("performance_value"), X.safe_cell(F.col("sample_id")).alias("sample_id"))


@query("template_values", " UNION ALL ".join(f"SELECT id, '{p}.{c}' AS field_path, trim({c}) AS raw_value FROM {RECORDS} WHERE trim({c}) <> ''" for p, cs in {"sample": ["material_system", "fiber_type", "matrix_name"], "process": ["process_route", "spinning_method", "post_treatment"], "performance": ["performance_metric", "performance_value", "performance_unit", "performance_condition"]}.items() for c in cs))
def template_values(spark: SparkSession, d: str) -> DataFrame:
    """Records as sparse (field path, value) rows, in one pass."""
    paths = {"sample": ["material_system", "fiber_type", "matrix_name"], "process": ["process_route", "spinning_method", "post_treatment"], "performance": ["performance_metric", "performance_value", "performance_unit", "performance_condition"]}
    pairs = F.array(*[F.struct(F.lit(f"{p}.{c}").alias("field_path"), F.trim(c).alias("raw_value")) for p, cs in paths.items() for c in cs])
    return _records(spark, d).select("id", F.explode(F.filter(pairs, lambda x: x["raw_value"] != "")).alias("x")).select("id", "x.field_path", "x.raw_value")


@query("template_quality", "SELECT field_path, count(*) AS n_values, count(DISTINCT id) AS n_records, count(DISTINCT raw_value) AS n_distinct FROM (" + " UNION ALL ".join(f"SELECT id, '{p}.{c}' AS field_path, trim({c}) AS raw_value FROM {RECORDS} WHERE trim({c}) <> ''" for p, cs in {"sample": ["material_system", "fiber_type", "matrix_name"], "process": ["process_route", "spinning_method", "post_treatment"], "performance": ["performance_metric", "performance_value", "performance_unit", "performance_condition"]}.items() for c in cs) + ") GROUP BY 1")
def template_quality(spark: SparkSession, d: str) -> DataFrame:
    return template_values(spark, d).groupBy("field_path").agg(F.count("*").alias("n_values"), F.count_distinct("id").alias("n_records"), F.count_distinct("raw_value").alias("n_distinct"))


@query(
    "fact_issues",
    f"""SELECT id, issues FROM (SELECT id, concat_ws(',', CASE WHEN coalesce(trim(performance_metric), '') = '' THEN 'no_metric' END, CASE WHEN coalesce(trim(performance_value), '') = '' THEN 'no_value' END, CASE WHEN coalesce(trim(sample_id), '') = '' THEN 'no_sample' END,
    CASE WHEN coalesce(trim(performance_evidence), '') = '' THEN 'no_evidence' END, CASE WHEN trim(performance_value) <> '' AND NOT regexp_matches(performance_value, '\\d') THEN 'no_digit' END,
    CASE WHEN coalesce(lower(trim(source_location)), '') IN ('', {", ".join(f"'{x}'" for x in X.COARSE_LOCATIONS)}) OR regexp_matches(coalesce(lower(trim(source_location)), ''), '^p\\.?\\s*\\d+\\s*,?\\s*(text|raw text|page)?$')
    OR NOT regexp_matches(coalesce(lower(trim(source_location)), ''), '\\b(p\\.|fig\\.)\\w|\\b(page|figure|table|section|scheme)\\b|\\bsec\\.\\w') THEN 'rough_location' END, CASE WHEN ai_confidence < 0.65 THEN 'low_confidence' END) AS issues FROM {RECORDS}) WHERE issues <> ''""",
)
def fact_issues(spark: SparkSession, d: str) -> DataFrame:
    return R.fact_issues(_records(spark, d))


_KEYS = ["source_paper_id", "sample_id", "performance_metric", "performance_value"]


@query(
    "narrative_table_reconcile",
    f"""WITH t AS (SELECT {', '.join(_KEYS)}, min(id) AS table_id FROM {RECORDS} WHERE extraction_method NOT IN ('AI_text', 'AI_holistic') OR extraction_method IS NULL GROUP BY {', '.join(_KEYS)} HAVING count(*) = 1)
    SELECT r.id, t.table_id FROM {RECORDS} r JOIN t USING ({', '.join(_KEYS)}) WHERE r.extraction_method IN ('AI_text', 'AI_holistic')""",
)
def narrative_table_reconcile(spark: SparkSession, d: str) -> DataFrame:
    return R.told_twice(_records(spark, d), _KEYS, F.col("extraction_method").isin("AI_text", "AI_holistic"))


@query("table_cell_conflict", f"SELECT source_paper_id, source_location, performance_metric, count(DISTINCT sample_id) AS variants FROM {RECORDS} WHERE source_location LIKE '%Table%' GROUP BY 1, 2, 3 HAVING count(DISTINCT sample_id) > 1")
def table_cell_conflict(spark: SparkSession, d: str) -> DataFrame:
    records = _records(spark, d).where(F.contains("source_location", F.lit("Table")))
    return R.conflicting_cells(records, ["source_paper_id", "source_location", "performance_metric"], "sample_id")


@query("commonest_process", f"SELECT source_paper_id, process_route, n FROM (SELECT *, row_number() OVER (PARTITION BY source_paper_id ORDER BY n DESC, process_route) AS r FROM (SELECT source_paper_id, process_route, count(*) AS n FROM {RECORDS} WHERE process_route IS NOT NULL GROUP BY 1, 2)) WHERE r = 1")
def commonest_process(spark: SparkSession, d: str) -> DataFrame:
    return R.commonest(_records(spark, d), ["source_paper_id"], "process_route")


@query("metric_canonical_lookup")
def metric_canonical_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Distinct metrics as typed that a dictionary phrase equals, contains or is contained in."""
    entries = table(spark, d, "canonical_entries").where("field_name = 'performance_metric'")
    return L.find_entries(table(spark, d, "candidate_items", "performance_metric"), entries)


@query("peak_dense_rank", f"SELECT id, value_no FROM (SELECT id, dense_rank() OVER (PARTITION BY source_paper_id, sample_id, performance_metric ORDER BY v) AS value_no FROM (SELECT *, TRY_CAST(performance_value AS DOUBLE) AS v FROM {ITEMS} WHERE regexp_full_match(performance_value, '[0-9.]+')) WHERE v IS NOT NULL)")
def peak_dense_rank(spark: SparkSession, d: str) -> DataFrame:
    """Of values that are digits and points only."""
    items = _items(spark, d).where(F.col("performance_value").rlike(r"^[0-9.]+$")).select("id", "source_paper_id", "sample_id", "performance_metric", "performance_value")
    return L.numbered_values(items, ["source_paper_id", "sample_id", "performance_metric"], "performance_value").where("value_no IS NOT NULL").select("id", "value_no")


@query("peak_dense_rank_all")
def peak_dense_rank_all(spark: SparkSession, d: str) -> DataFrame:
    """Of all candidates, whatever way their number is written; null where the value is no number."""
    items = _items(spark, d).select("id", "source_paper_id", "sample_id", "performance_metric", "performance_value")
    return L.numbered_values(items, ["source_paper_id", "sample_id", "performance_metric"], "performance_value").select("id", "value_no")


@query("stated_pairs")
def stated_pairs(spark: SparkSession, d: str) -> DataFrame:
    return A.stated_pairs(_items(spark, d), "id", "evidence_text")


@query("stated_contrasts")
def stated_contrasts(spark: SparkSession, d: str) -> DataFrame:
    return A.stated_contrasts(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text")


@query("evidence_windows")
def evidence_windows(spark: SparkSession, d: str) -> DataFrame:
    """The sentence with each record's value in its evidence, and the one before."""
    records = _records(spark, d).where("evidence_text IS NOT NULL AND performance_value <> ''")
    return records.select("id", A.evidence_window(F.col("evidence_text"), F.col("performance_value")).alias("window")).where("window IS NOT NULL")
