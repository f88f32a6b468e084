"""Sources: folders of documents, gold sets, model-call logs, persisted facts."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CALL = """call_id long, job_id long, stage string, model string, call_type string, latency_ms double, success boolean, error string,
prompt_tokens int, completion_tokens int, total_tokens int, recorded_at timestamp"""
GOLD = """schema_version int, name string, thresholds map<string,double>, papers array<struct<filename:string,sha256:string,document_type:string,exhaustive:boolean,
sample_aliases:map<string,array<string>>,facts:array<struct<sample_id:string,metric:string,value:string,unit:string,metric_aliases:array<string>,unit_aliases:array<string>,value_tolerance:double,evidence_contains:array<string>>>>>"""


class FactSource(Protocol):
    """Anything that brings facts as a table; parsers and extraction services plug in here."""

    def load(self, spark: SparkSession) -> DataFrame: ...


class ParquetFacts:
    """Facts persisted as Parquet."""

    def __init__(self, path: str):
        self.path = path

    def load(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.path)


class JsonFacts:
    """Facts persisted as JSON lines with a given schema; malformed lines are left out."""

    def __init__(self, path: str, schema: str):
        self.path, self.schema = path, schema

    def load(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(self.schema).option("mode", "DROPMALFORMED").json(self.path)


def document_files(spark: SparkSession, folder: str, pattern: str = "*.pdf", excluded: tuple[str, ...] = ()) -> DataFrame:
    """(path, size_bytes, modified, sha256, is_pdf, copy_no) of the files under a folder, copies numbered by path.

    Files in excluded sub-folders are left out before their content is read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    for name in excluded:
        files = files.where(~F.contains("path", F.lit(f"/{name}/")))
    rows = files.select("path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"), F.contains(F.decode(F.substring("content", 1, 1024), "ISO-8859-1"), F.lit("%PDF-")).alias("is_pdf"))
    first = rows.groupBy("sha256").agg(F.min("path").alias("first_path"))
    return rows.join(first, "sha256").withColumn("is_first", F.col("path") == F.col("first_path")).drop("first_path")


def call_log(spark: SparkSession, path: str) -> DataFrame:
    """Model calls of JSON-lines logs; malformed lines are left out."""
    return spark.read.schema(CALL).option("mode", "DROPMALFORMED").json(path)


def gold_facts(spark: SparkSession, path: str) -> DataFrame:
    """(filename, sha256, exhaustive, ord, sample_id, metric, value, unit, …) of a gold set in JSON, schema version 1."""
    papers = spark.read.schema(GOLD).option("multiLine", "true").json(path).where("schema_version = 1").select(F.explode("papers").alias("p"))
    facts = papers.select("p.filename", "p.sha256", "p.exhaustive", F.posexplode("p.facts").alias("ord", "f"))
    return facts.select("filename", "sha256", "exhaustive", "ord", "f.*")


def tolerant_json(df: DataFrame, column: str, schema: str) -> DataFrame:
    """``df`` with ``parsed``: JSON of a text, also where it stands between other text or in a code fence; null if none."""
    inner = F.regexp_extract(F.col(column), r"(?s)(\{.*\}|\[.*\])", 1)
    return df.withColumn("parsed", F.when(F.get_json_object(inner, "$").isNotNull(), F.from_json(inner, schema)))
