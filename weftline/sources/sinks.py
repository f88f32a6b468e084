"""Sinks: versions published by a pointer, per-group JSON, spreadsheets' sheets, streams."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions.text import safe_cell
from weftline.session import checkpointed


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, whole or not at all: written beside its place and renamed."""
    fs, jvm = _fs(spark, path)
    part = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    out = fs.create(part)
    out.write(bytearray(text.encode()))
    out.close()
    target = jvm.org.apache.hadoop.fs.Path(path)
    if not fs.rename(part, target):
        fs.delete(target, False)
        if not fs.rename(part, target):
            raise OSError(f"could not put {path} in place")


def read_text(spark: SparkSession, path: str) -> str | None:
    """The text of a small file; null if there is none."""
    fs, jvm = _fs(spark, path)
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def publish(tables: dict[str, DataFrame], folder: str) -> str:
    """Writes all tables as one new version and only then points to it, so that readers see all of it or the last one."""
    spark = next(iter(tables.values())).sparkSession
    version = uuid.uuid4().hex
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{version}/{name}.parquet")
    write_text(spark, f"{folder}/CURRENT", json.dumps({"version": version}))
    return version


def published(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the version that is pointed to."""
    pointer = read_text(spark, f"{folder}/CURRENT")
    if pointer is None:
        raise FileNotFoundError(f"nothing is published in {folder}")
    return spark.read.parquet(f"{folder}/{json.loads(pointer)['version']}/{name}.parquet")


def replace_groups(spark: SparkSession, folder: str, name: str, new: DataFrame, group: str) -> str:
    """Publishes a version in which the groups present in ``new`` are replaced and all others stay."""
    kept = published(spark, folder, name).join(new.select(group).distinct(), group, "left_anti")
    return publish({name: kept.unionByName(new)}, folder)


def group_json(df: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """(group, json): a row per record as JSON, for files partitioned by group."""
    return df.select(group, F.to_json(F.struct(*columns)).alias("json"))


def sheet(df: DataFrame, columns: list[str], rows_per_sheet: int = 1_000_000, order: str = "id") -> DataFrame:
    """``columns`` as spreadsheet-safe text with sheet_no and row_no: sheets of bounded size, in order.

    Rows are counted per range of the order first, so that no window spans the table.
    """
    cells: list[Column] = [safe_cell(F.col(c).cast("string")).alias(c) for c in columns]
    ranged = df.repartitionByRange(order).withColumn("_part", F.spark_partition_id())
    ranged = checkpointed(ranged.select(order, "_part", *[c for c in columns if c != order]))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).select("_part", "_before")
    row = F.row_number().over(Window.partitionBy("_part").orderBy(order)) + F.col("_before") - 1
    out = ranged.join(F.broadcast(before), "_part").withColumn("_r", row)
    return out.select((F.floor(F.col("_r") / rows_per_sheet) + 1).cast("int").alias("sheet_no"), (F.pmod("_r", F.lit(rows_per_sheet)) + 1).cast("int").alias("row_no"), *cells)


def to_folder(stream: DataFrame, folder: str, checkpoint: str):
    """A stream written once per event to Parquet files; what is there is read and the query ends."""
    return stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
