import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from weftline.sources import readers, sinks
from weftline.streaming import progress as P

T0 = dt.datetime(2025, 1, 1)
ROWS = [(1, 0, "a", 0), (1, 1, "a", 1), (1, 1.5, "a", 2), (1, 1.6, "b", 2), (1, 1.7, "b", 3), (1, 4, "b", 3), (1, 4.1, "b", 130), (2, 0, "a", -5), (None, 0, "a", 1)]
KEPT = {(1, 0.0), (1, 1.5), (1, 1.6), (1, 4.0), (1, 4.1), (2, 0.0)}


def events(spark):
    return spark.createDataFrame([(j, T0 + dt.timedelta(seconds=s), st, p) for j, s, st, p in ROWS], P.EVENTS)


def test_throttle_batch(spark):
    got = {(r.job_id, (r.ts - T0).total_seconds()) for r in P.throttle(events(spark)).collect()}
    assert got == KEPT
    assert {r.percent for r in P.throttle(events(spark)).collect()} <= set(range(101))


def test_throttle_stream_equals_batch(spark, tmp_path):
    for k in range(2):  # two files, two micro-batches
        with open(tmp_path / f"{k}.json", "w") as f:
            for j, s, st, p in ROWS[k * 4 : k * 4 + 4 + k]:
                f.write(json.dumps({"job_id": j, "ts": (T0 + dt.timedelta(seconds=s)).isoformat(), "step": st, "percent": p}) + "\n")
        os.utime(tmp_path / f"{k}.json", (1000 + k, 1000 + k))  # the order in which they are read
    stream = spark.readStream.schema(P.EVENTS).option("maxFilesPerTrigger", 1).json(str(tmp_path))
    q = P.throttle_stream(stream).writeStream.format("memory").queryName("thin").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.job_id, (r.ts - T0).total_seconds()) for r in spark.table("thin").collect()} == KEPT


def test_stream_to_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"job_id": 1, "ts": "2025-01-01T00:00:00", "step": "a", "percent": 1}\n')
    sinks.to_folder(P.read_events(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_publish_and_replace(spark, tmp_path):
    folder = str(tmp_path / "store")
    with pytest.raises(FileNotFoundError):
        sinks.published(spark, folder, "t")
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "paper int, v string")
    sinks.publish({"t": df}, folder)
    sinks.replace_groups(spark, folder, "t", spark.createDataFrame([(1, "z")], "paper int, v string"), "paper")
    assert {tuple(r) for r in sinks.published(spark, folder, "t").collect()} == {(1, "z"), (2, "c")}
    assert sinks.group_json(df, "paper", ["v"]).where("paper = 2").first().json == '{"v":"c"}'


def test_sheets(spark):
    df = spark.createDataFrame([(i, f"={i}") for i in range(25)], "id long, v string").repartition(5)
    rows = sinks.sheet(df, ["id", "v"], rows_per_sheet=10).orderBy("sheet_no", "row_no").collect()
    assert [(r.sheet_no, r.row_no) for r in rows] == [(1 + i // 10, 1 + i % 10) for i in range(25)]
    assert [r.id for r in rows] == [str(i) for i in range(25)] and rows[3].v == "'=3"


def test_readers(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, text in (("a.pdf", "%PDF-1"), ("sub/b.pdf", "%PDF-1"), ("c.pdf", "no"), ("d.txt", "x")):
        (tmp_path / name).write_text(text)
    files = readers.document_files(spark, str(tmp_path)).collect()
    assert len(files) == 3 and sum(f.is_first for f in files) == 2 and sum(f.is_pdf for f in files) == 2
    assert readers.document_files(spark, str(tmp_path), excluded=("sub",)).count() == 2
    (tmp_path / "calls.jsonl").write_text('{"call_id": 1, "success": true}\nbroken\n')
    assert [r.call_id for r in readers.call_log(spark, str(tmp_path / "calls.jsonl")).collect()] == [1]
    gold = {"schema_version": 1, "papers": [{"filename": "a.pdf", "facts": [{"sample_id": "S1", "metric": "m", "value": "1"}, {"sample_id": "S2"}]}]}
    (tmp_path / "gold.json").write_text(json.dumps(gold))
    assert [(r.ord, r.sample_id) for r in readers.gold_facts(spark, str(tmp_path / "gold.json")).orderBy("ord").collect()] == [(0, "S1"), (1, "S2")]
    df = spark.createDataFrame([('Sure: ```json\n{"a": 1}\n```',), ("none",), (None,)], "t string")
    assert [r.parsed.a if r.parsed else None for r in readers.tolerant_json(df, "t", "a int").collect()] == [1, None, None]
    assert readers.ParquetFacts  # the two file sources share one interface
    assert readers.JsonFacts(str(tmp_path / "calls.jsonl"), "call_id long").load(spark).where(F.col("call_id").isNotNull()).count() == 1
