"""Streams that built-in windows express."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackmill.operators.events import MERGE_GAP_MS
from trackmill.operators.ops import STALE_AFTER


def stream_clusters(events: DataFrame, gap_ms: int = MERGE_GAP_MS, lateness: str = "10 seconds") -> DataFrame:
    """Clusters of events(video_id, t_ms), emitted once the watermark passes their end.

    A session window also joins events exactly one gap apart, which the batch rule
    does not, so the window is a microsecond shorter.
    """
    d = events.select("video_id", "t_ms", F.timestamp_millis("t_ms").alias("at")).withWatermark("at", lateness)
    gap = f"{gap_ms * 1000 - 1} microseconds"
    return d.groupBy("video_id", F.session_window("at", gap)).agg(
        F.min("t_ms").alias("first_ms"), F.max("t_ms").alias("last_ms"), F.count("*").alias("n_shots")
    ).drop("session_window")


def stream_stale_jobs(signs: DataFrame, lateness: str = "10 seconds") -> DataFrame:
    """Running jobs that fell silent: one row per stretch of signs(id, at, state) that ended STALE_AFTER ago.

    Silence is measured on the stream's own clock, so old logs can be replayed; when nothing arrives at
    all, see jobs.stream_silent_jobs.

    at is in seconds. A job whose last sign has another state than running has ended, not fallen silent;
    of several signs in one second the last state by name counts. Without a state column every job counts.
    """
    state = F.col("state") if "state" in signs.columns else F.lit("running")
    d = signs.select("id", "at", state.alias("state"), F.timestamp_seconds("at").alias("ts")).withWatermark("ts", lateness)
    # strictly more than STALE_AFTER without a sign
    g = d.groupBy("id", F.session_window("ts", f"{STALE_AFTER} seconds")).agg(F.max(F.struct("at", "state")).alias("last"))
    return g.where("last.state = 'running'").select("id", F.col("last.at").alias("seen_at"))
