"""Job state over a stream of events, as the batch operators compute it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

FIELDS = ("stage", "progress", "error")
OUT = "job_id long, stage string, progress long, error string, updated_us long"
STATE = "stage string, stage_us long, progress long, progress_us long, error string, error_us long, updated_us long"


def latest(events: DataFrame) -> DataFrame:
    """job_id, stage, progress, error, updated_us after each batch: every field keeps its latest value that is not
    null, by event time, so batches may come late and in any order.  Updates of one microsecond are ordered by seq
    within a batch."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = dict(zip((c.split()[0] for c in STATE.split(", ")), state.get if state.exists else [None] * 7, strict=True))
        for part in parts:
            for row in part.sort_values(["us", "seq"]).itertuples(index=False):
                for f in FIELDS:
                    value = getattr(row, f)
                    if not pd.isna(value) and (now[f"{f}_us"] is None or row.us >= now[f"{f}_us"]):
                        now[f], now[f"{f}_us"] = (int(value) if f == "progress" else value), int(row.us)
                now["updated_us"] = max(now["updated_us"] or 0, int(row.us))
        state.update(tuple(now.values()))
        yield pd.DataFrame({"job_id": [key[0]], "stage": [now["stage"]], "progress": pd.array([now["progress"]], "Int64"), "error": [now["error"]], "updated_us": [now["updated_us"]]})

    rows = events.select("job_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "seq", *FIELDS)
    return rows.groupBy("job_id").applyInPandasWithState(run, OUT, STATE, "update", GroupStateTimeout.NoTimeout)


def lifetimes(events: DataFrame, ttl: str = "24 hours", late: str = "1 hour") -> DataFrame:
    """job_id, start, end, n of each spell of activity: a job that is silent for the time to live begins a new one.

    Session windows under a watermark, so that state of finished spells goes.
    """
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    spell = F.session_window("at", ttl)
    return timed.groupBy("job_id", spell).agg(F.count("*").alias("n")).select("job_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def throughput(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """start, stage, n: events by stage in tumbling windows under a watermark."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", window).alias("w"), "stage").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "stage", "n")
