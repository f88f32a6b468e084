"""Progress of jobs as a stream: an event is passed on if it is the first of its job, two seconds after the last one
passed, of another step, two per cent further, or the end. Late events follow the same rule in order of arrival.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "job_id long, ts timestamp, step string, percent int"


def passes(last: tuple[float, str, int] | None, ts: float, step: str, percent: int) -> bool:
    """Whether an event is passed on after the last one that was."""
    return last is None or ts - last[0] >= 2 or step != last[1] or abs(percent - last[2]) >= 2 or percent >= 100


def _throttled(rows: list[tuple], last: tuple | None) -> tuple[list[tuple], tuple | None]:
    out = []
    for job, ts, step, percent in rows:
        percent = max(0, min(100, int(percent)))
        if passes(last, ts.timestamp(), step, percent):
            last = (ts.timestamp(), step, percent)
            out.append((job, ts, step, percent))
    return out, last


def throttle_stream(events: DataFrame) -> DataFrame:
    """A stream of EVENTS, thinned with one small state per job."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = tuple(state.get) if state.exists else None
        rows = [r for b in batches for r in b[["job_id", "ts", "step", "percent"]].itertuples(index=False, name=None)]
        out, last = _throttled(sorted(rows, key=lambda r: r[1]), last)
        if last is not None:
            state.update(last)
        if out:
            yield pd.DataFrame(out, columns=["job_id", "ts", "step", "percent"])

    clean = events.where("job_id IS NOT NULL AND ts IS NOT NULL AND step IS NOT NULL AND percent IS NOT NULL")
    return clean.groupBy("job_id").applyInPandasWithState(update, EVENTS, "at double, step string, percent int", "append", "NoTimeout")


def throttle(events: DataFrame) -> DataFrame:
    """The same over a finished table; jobs are streamed from sorted partitions."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, last = object(), None
        for b in batches:
            out = []
            for row in b.itertuples(index=False, name=None):
                if row[0] != here:
                    here, last = row[0], None
                got, last = _throttled([row], last)
                out += got
            if out:
                yield pd.DataFrame(out, columns=["job_id", "ts", "step", "percent"])

    clean = events.select("job_id", "ts", "step", "percent").where("job_id IS NOT NULL AND ts IS NOT NULL AND step IS NOT NULL AND percent IS NOT NULL")
    return clean.repartition("job_id").sortWithinPartitions("job_id", "ts", "percent", "step").mapInPandas(run, EVENTS)


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of the JSON event files that arrive in a folder."""
    return spark.readStream.schema(EVENTS).json(folder)


def windowed_calls(calls: DataFrame, minutes: int = 60, late: str = "7 days") -> DataFrame:
    """(begin, model, calls, failed, tokens) per window of recording time; works on streams, where late rows are awaited."""
    c = calls.withWatermark("recorded_at", late) if calls.isStreaming else calls
    c = c.groupBy(F.window("recorded_at", f"{minutes} minutes").alias("w"), "model")
    out = c.agg(F.count("*").alias("calls"), F.count_if(~F.col("success")).alias("failed"), F.sum(F.coalesce("total_tokens", F.lit(0))).alias("tokens"))
    return out.select(F.col("w.start").alias("begin"), "model", "calls", "failed", "tokens")
