"""Reports over stored media, accounts and the job log."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackmill.functions.strings import account_slug, format_bytes, format_duration
from trackmill.operators.matching import compose
from trackmill.ordered import BLK, in_ranges, with_prefix_sum, with_rank_order
from trackmill.session import cut_lineage

# Fixed values of the job rules, in seconds.
STALE_AFTER = 180
STUCK_AFTER = 900
ALERT_EVERY = 600
ALERT_BLOCK = 86_400
ALERT_POLICIES = {
    "job_failed": "job_failed",
    "job_stuck_queued": "job_stuck",
    "worker_trigger_failed": "job_stuck",
}
MEDIA_EXTS = (".mp4", ".mov")


def processed_seconds(jobs: DataFrame) -> DataFrame:
    """Seconds of processed recordings per account, from the job log.

    A batch counts its completed recordings, any other job its own length.
    """
    batch = F.col("kind").eqNullSafe("batch")
    own = F.aggregate(
        F.coalesce(F.transform("completed", lambda v: F.coalesce(v["duration_s"], F.lit(0.0))), F.array().cast("array<double>")),
        F.lit(0.0), lambda s, x: s + x,
    )
    secs = F.when(batch, own).otherwise(F.coalesce("duration_s", F.lit(0.0)))
    return jobs.where(F.coalesce("user", F.lit("")) != "").groupBy(account_slug(F.col("user")).alias("owner")).agg(
        F.sum(secs).alias("seconds")
    )


def usage_by_account(videos: DataFrame, clips: DataFrame, other: DataFrame, seconds: DataFrame) -> DataFrame:
    """Storage, recordings, length and clips per owner; owners are those with anything stored.

    Each input is rows of (owner, bytes) except seconds(owner, seconds). One
    aggregate over the union needs a single shuffle of partial sums.
    """
    def part(df, n_videos, n_clips):
        return df.select("owner", F.col("bytes").cast("bigint").alias("bytes"), F.lit(n_videos).alias("v"),
                         F.lit(n_clips).alias("c"), F.lit(0.0).alias("s"), F.lit(1).alias("stored"))

    sec = seconds.select("owner", F.lit(0).cast("bigint").alias("bytes"), F.lit(0).alias("v"), F.lit(0).alias("c"),
                         F.col("seconds").alias("s"), F.lit(0).alias("stored"))
    rows = part(videos, 1, 0).unionByName(part(clips, 0, 1)).unionByName(part(other, 0, 0)).unionByName(sec)
    g = rows.groupBy("owner").agg(
        F.sum("bytes").alias("storage_bytes"), F.sum("v").alias("n_videos"), F.sum("s").alias("seconds"),
        F.sum("c").alias("n_clips"), F.max("stored").alias("_stored"),
    )
    return g.where("_stored = 1").drop("_stored").select(
        "*", format_bytes(F.col("storage_bytes")).alias("storage_display"),
        format_duration(F.col("seconds")).alias("length_display"),
    )


def queue_positions(jobs: DataFrame) -> DataFrame:
    """1-based place of every queued or running job by creation time, then id."""
    live = jobs.where(F.col("state").isin("queued", "running")).select("id", "created_at")
    return with_rank_order(live, [], ["created_at", "id"], "position").select("id", "position")


def retention_victims(files: DataFrame, cap: int, keys: Sequence[str] = ()) -> DataFrame:
    """Oldest files to delete until the total is at most cap: (mtime, path order)."""
    keys = list(keys)
    order = ["mtime", "path"]
    d = in_ranges(files.select(*keys, "mtime", "path", "size"), [*keys, *order])
    run = with_prefix_sum(d, keys, F.col(BLK), order, "size", "_upto")
    total = d.groupBy(*keys).agg(F.sum("size").alias("_total"))
    run = run.join(total, keys) if keys else run.crossJoin(F.broadcast(total))  # one row without keys
    return run.where(F.col("_total") - (F.col("_upto") - F.col("size")) > cap).select(*keys, "path", "mtime", "size")


def duplicate_media(inventory: DataFrame) -> DataFrame:
    """Files that share name and size with another one, under any owner."""
    twice = inventory.groupBy("name", "size").agg(F.count("*").alias("copies")).where("copies > 1")
    return inventory.join(twice, ["name", "size"])


def stale_jobs(jobs: DataFrame, signs: DataFrame, now) -> DataFrame:
    """Running jobs with no sign of life for too long turn into errors; one never seen is left alone.

    signs(id, at) holds heartbeats and progress writes.
    """
    last = signs.groupBy("id").agg(F.max("at").alias("_seen"))
    dead = (F.col("state") == "running") & (F.lit(now) - F.col("_seen") > STALE_AFTER)
    j = jobs.join(last, "id", "left").withColumn("stale", F.coalesce(dead, F.lit(False)))
    return j.withColumn("state", F.when(F.col("stale"), "error").otherwise(F.col("state"))).withColumn(
        "message", F.when(F.col("stale"), "interrupted").otherwise(F.col("message"))
    ).drop("_seen")


def stuck_jobs(jobs: DataFrame, now, reported: DataFrame | None = None, pool: str | None = None) -> DataFrame:
    """Jobs queued too long while nothing runs, minus those already reported.

    With `pool` (a column, of workers or accounts) only running jobs of the same pool count.
    """
    late = (F.col("state") == "queued") & (F.lit(now) - F.col("created_at") > STUCK_AFTER)
    key = F.lit("") if pool is None else F.coalesce(F.col(pool).cast("string"), F.lit(""))
    busy = jobs.where("state = 'running'").select(key.alias("_pool")).distinct()
    out = jobs.where(late).withColumn("_pool", key).join(busy, "_pool", "left_anti").drop("_pool")
    out = out.join(reported.select("id"), "id", "left_anti") if reported is not None else out
    return out.select("id", "user", F.floor((F.lit(now) - F.col("created_at")) / 60).cast("bigint").alias("minutes"))


def alert_policy() -> Column:
    """The policy that a log line's event belongs to; null for other events."""
    return F.coalesce(*[F.when(F.col("event") == event, name) for event, name in ALERT_POLICIES.items()])


def _alert_block(at: np.ndarray, day: int, states: np.ndarray, every: int, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Alerts among ascending seconds `at` of one block, for each number of seconds that are still blocked at its start.

    Returns which seconds alert, one row per state, and the seconds blocked beyond the block's end.
    """
    edge = day * block
    follows = np.append(np.searchsorted(at, at + every), len(at))
    now = np.searchsorted(at, edge + states)
    alerts, last = np.zeros((len(states), len(at) + 1), dtype=bool), edge + states - every
    rows = np.arange(len(states))
    while (now < len(at)).any():
        alerts[rows, now] = True
        last = np.where(now < len(at), at[np.minimum(now, len(at) - 1)], last)
        now = follows[now]
    return alerts[:, : len(at)], np.maximum(last + every - edge - block, 0)


def _alert_tables(every: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tables = []
            for day, seconds in zip(batch.column("day").to_pylist(), batch.column("seconds").to_pylist(), strict=True):
                tables.append(_alert_block(np.array([x["at"] for x in seconds]), day, np.arange(every), every, block)[1])
            yield pa.RecordBatch.from_arrays([batch.column("policy"), batch.column("day"), pa.array(tables, pa.list_(pa.int32()))], names=["policy", "day", "tab"])

    return run


def _alerts_of(every: int, block: int):
    """(policy, at, n): the lines of each alert; lines before a block's first alert belong to the one that holds them back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for policy, day, came, seconds in zip(*(batch.column(c).to_pylist() for c in ("policy", "day", "came", "seconds")), strict=True):
                at = np.array([x["at"] for x in seconds])
                hits = np.flatnonzero(_alert_block(at, day, np.array([came]), every, block)[0][0])
                firsts = np.concatenate([[day * block + came - every], at[hits]])
                owner = np.searchsorted(hits, np.arange(len(at)), "right")
                n = np.bincount(owner, weights=[x["n"] for x in seconds], minlength=len(firsts)).astype(int)
                out += [(policy, int(t), int(c)) for t, c in zip(firsts, n, strict=True) if c]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["policy", "at", "n"])

    return run


def job_alerts(log: DataFrame, every: int = ALERT_EVERY, block: int = ALERT_BLOCK) -> DataFrame:
    """Alerts of log(event, at, job_id), at in seconds: policy, at, job_id, event, held_back.

    A policy alerts with its first line and then with the first one at least `every` seconds after
    its last alert, so windows roll with the alerts. held_back counts the lines since the alert
    before that made none. Of several lines in a second the least (job_id, event) is named.

    Lines are added up per second and cut into days (blocks). All a day needs of the past is for how many
    seconds the last alert still holds, so each tabulates that number's way through it; the tables
    are composed in groups, and then every day finds its alerts.
    """
    lines = log.select(alert_policy().alias("policy"), "at", "job_id", "event").where("policy is not null")
    second = cut_lineage(lines.groupBy("policy", "at").agg(F.min(F.struct("job_id", "event")).alias("f"), F.count("*").alias("n")))
    day = F.floor(F.col("at") / block).cast("bigint").alias("day")
    days = second.groupBy("policy", day).agg(F.sort_array(F.collect_list(F.struct("at", "n"))).alias("seconds"))
    along = Window.partitionBy("policy").orderBy("day")
    # a day without its predecessor starts free
    days = days.withColumn("chain", F.sum((F.coalesce(F.lag("day").over(along) != F.col("day") - 1, F.lit(True))).cast("bigint")).over(along))
    days = cut_lineage(days.withColumn("pos", (F.row_number().over(Window.partitionBy("policy", "chain").orderBy("day")) - 1).cast("bigint")))
    tables = days.select("policy", "day", "seconds").mapInArrow(_alert_tables(every, block), "policy string, day bigint, tab array<int>")
    places = days.select("policy", "chain", "day", "pos")
    came = compose(tables.join(places, ["policy", "day"]), ["policy", "chain"]).join(places, ["policy", "chain", "pos"])
    found = days.select("policy", "day", "seconds").join(came.select("policy", "day", "came"), ["policy", "day"])
    found = found.mapInArrow(_alerts_of(every, block), "policy string, at bigint, n bigint")
    alerts = found.groupBy("policy", "at").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("policy").orderBy("at")  # at most one alert per policy in ten minutes
    alerts = alerts.withColumn("held_back", F.coalesce(F.lag("n").over(order) - 1, F.lit(0)))
    return alerts.join(second.select("policy", "at", "f"), ["policy", "at"]).select("policy", "at", "f.job_id", "f.event", "held_back")


def recent_jobs(jobs: DataFrame, limit: int) -> DataFrame:
    """Newest jobs with the columns safe to show."""
    n, done = F.size("queue"), F.size(F.coalesce("completed", F.array().cast(jobs.schema["completed"].dataType)))
    batch = F.col("kind").eqNullSafe("batch")
    name = lambda p: F.element_at(F.split(p, "/"), -1)
    return jobs.orderBy(F.desc("created_at"), "id").limit(limit).select(
        "id", "state", "user", "created_at",
        F.when(batch & (n == 1), name(F.get("queue", F.lit(0))))
        .when(batch, F.concat(n.cast("string"), F.lit(" videos")))
        .otherwise(name(F.coalesce("video", F.lit("")))).alias("video"),
        F.when(batch & (n > 1), F.concat_ws("/", done.cast("string"), F.concat(n.cast("string"), F.lit(" done")))).alias("detail"),
    )


def calibrated_queue(videos: DataFrame, calibrations: DataFrame) -> DataFrame:
    """Every recording with `calibrated`: only those go to the queue."""
    have = calibrations.select("video_id").distinct().withColumn("_c", F.lit(True))
    return videos.join(have, "video_id", "left").select(*videos.columns, F.coalesce("_c", F.lit(False)).alias("calibrated"))


def resolve_model(users: DataFrame, models: DataFrame, method: str) -> DataFrame:
    """Model per user: their own of this method, else the global one (null owner), else none."""
    usable = models.where(F.col("method") == method)
    own = usable.where("owner is not null").select(F.col("owner").alias("_o"), F.col("model").alias("_own"))
    shared = usable.where("owner is null").agg(F.min("model").alias("_global"))
    j = users.withColumn("_o", account_slug(F.col("user"))).join(own, "_o", "left").crossJoin(F.broadcast(shared))  # one row
    return j.select(*users.columns, F.coalesce("_own", "_global").alias("model"))


def suggested_names(goals: DataFrame, players: DataFrame) -> DataFrame:
    """Attach a suggested scorer to goals that have one."""
    p = players.where("suggested is not null").select("video", "clip", F.col("suggested").alias("scorer"))
    return goals.join(p, ["video", "clip"], "left")


def detection_status(videos: DataFrame, calibrations: DataFrame, detections: DataFrame) -> DataFrame:
    """Per recording: calibrated, detected, number of events and when they were found."""
    have = calibrations.select("video_id").distinct().withColumn("_c", F.lit(True))
    det = detections.groupBy("video_id").agg(F.count("t_ms").alias("n_makes"), F.max("detected_at").alias("detected_at"))
    j = videos.join(have, "video_id", "left").join(det, "video_id", "left")
    return j.select(
        "video_id", F.coalesce("_c", F.lit(False)).alias("calibrated"), F.col("n_makes").isNotNull().alias("detected"),
        F.coalesce("n_makes", F.lit(0)).alias("n_makes"), "detected_at",
    )


def exclude_videos(df: DataFrame, skip: DataFrame) -> DataFrame:
    """Drop named recordings; a name that does not occur is an error."""
    unknown = skip.select("video_id").distinct().join(df.select("video_id").distinct(), "video_id", "left_anti")
    missing = [r.video_id for r in unknown.orderBy("video_id").limit(5).collect()]
    if missing:
        raise ValueError(f"unknown recordings to skip: {missing}")
    return df.join(skip.select("video_id"), "video_id", "left_anti")


def frame_times(clips: DataFrame, offsets: Sequence[float]) -> DataFrame:
    """Times to look at around each clip's event, kept inside the clip; clips(…, make, duration) in seconds."""
    last = F.when(F.coalesce("duration", F.lit(0.0)) > 0, F.greatest(F.lit(0.0), F.col("duration") - 0.1)).otherwise(
        F.lit(float("inf"))
    )
    at = F.transform(
        F.array(*[F.lit(float(o)) for o in offsets]),
        lambda o: F.round(F.least(F.greatest(F.lit(0.0), F.col("make") + o), last), 2),
    )
    return clips.select("*", F.posexplode(at).alias("i", "at"))


def date_folders(inventory: DataFrame, exts: Sequence[str] = MEDIA_EXTS, owner: str | None = None) -> DataFrame:
    """Media by owner and first folder, newest folder first; inventory(owner, path, size)."""
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    d = inventory.where(ext.isin(*exts) & F.col("path").contains("/"))
    d = d.where(F.col("owner") == owner) if owner is not None else d
    return d.select(
        "owner", F.substring_index("path", "/", 1).alias("folder"), "path",
        F.element_at(F.split("path", "/"), -1).alias("name"), format_bytes(F.col("size")).alias("size_display"),
    ).orderBy(F.desc("folder"), F.desc("owner"), "path")
