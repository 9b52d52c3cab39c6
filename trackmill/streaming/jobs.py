"""Streams over the job log that need state of their own: alerts and silent jobs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from trackmill.operators.ops import ALERT_EVERY, STALE_AFTER, alert_policy
from trackmill.streaming.state import need_rocks


class AlertLimiter(StatefulProcessor):
    """Per policy: the second of the last alert and the lines it has held back."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "at bigint, held bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        at, held = self.last.get() if self.last.exists() else (None, 0)
        seconds = pd.concat(list(rows)).sort_values("at")  # one row per second of the batch
        out = []
        for t, job, event, n in seconds[["at", "job_id", "event", "n"]].itertuples(index=False):
            if at is None or t - at >= ALERT_EVERY:
                out.append((key[0], int(t), int(job), event, int(held)))
                at, held = int(t), int(n) - 1
            else:
                held += int(n)
        self.last.update((at, held))
        yield pd.DataFrame(out, columns=["policy", "at", "job_id", "event", "held_back"])

    def close(self) -> None:
        pass


def stream_job_alerts(log: DataFrame, lateness: str = "1 minute") -> DataFrame:
    """Streaming job_alerts: log lines are added up per second before a policy's state sees them.

    A second counts once the watermark has passed it; later lines are dropped.
    """
    need_rocks(log.sparkSession)
    d = log.select(alert_policy().alias("policy"), "at", "job_id", "event", F.timestamp_seconds("at").alias("ts"))
    d = d.where("policy is not null").withWatermark("ts", lateness)
    g = d.groupBy("policy", F.window("ts", "1 second")).agg(F.min(F.struct("at", "job_id", "event")).alias("f"), F.count("*").alias("n"))
    g = g.select("policy", "f.at", "f.job_id", "f.event", "n")
    return g.groupBy("policy").transformWithStateInPandas(
        statefulProcessor=AlertLimiter(), outputStructType="policy string, at bigint, job_id bigint, event string, held_back bigint",
        outputMode="Append", timeMode="None")


class SilenceWatch(StatefulProcessor):
    """Per job: its last sign, and a timer on the wall clock that goes off when it has been silent for too long."""

    def __init__(self, stale_after: int):
        self.stale_after = stale_after

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "at bigint, state string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.seen.get() if self.seen.exists() else None
        for pdf in rows:
            newest = max(zip(pdf["at"].tolist(), pdf["state"].tolist()))
            last = newest if last is None else max(tuple(last), newest)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        at, state = int(last[0]), str(last[1])
        self.seen.update((at, state))
        if state == "running":
            self.handle.registerTimer((at + self.stale_after) * 1000 + 1)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at, _ = self.seen.get()
        yield pd.DataFrame([(key[0], int(at))], columns=["id", "seen_at"])

    def close(self) -> None:
        pass


def stream_silent_jobs(signs: DataFrame, stale_after: int = STALE_AFTER) -> DataFrame:
    """(id, seen_at) of running jobs without a sign for more than stale_after seconds of wall-clock time.

    signs(id, at, state) as in stream_stale_jobs. Timers run on processing time: with a
    processing-time trigger a job is reported even when no event of any job arrives any more. A job
    that shows signs of life again is watched anew, and reported again if it falls silent again.
    """
    need_rocks(signs.sparkSession)
    state = F.col("state") if "state" in signs.columns else F.lit("running")
    d = signs.select(F.col("id").cast("bigint").alias("id"), F.col("at").cast("bigint").alias("at"), F.coalesce(state, F.lit("")).alias("state"))
    return d.where("id IS NOT NULL AND at IS NOT NULL").groupBy("id").transformWithStateInPandas(
        statefulProcessor=SilenceWatch(stale_after), outputStructType="id bigint, seen_at bigint", outputMode="Append", timeMode="ProcessingTime")
