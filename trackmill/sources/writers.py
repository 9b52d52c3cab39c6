"""Outputs by recording. Every writer replaces only the recordings it was given.

Rows are appended under the number of their run, in a fixed number of hash buckets, so neither
folders nor files grow with the number of recordings and a large recording is split over
tasks. A second table says which recordings a run covered; readers take each recording's last
run. A run whose second table was not written counts for nothing.

    <path>/rows/run=<number>/bucket=<b>      what a run wrote
    <path>/processed/run=<number>            which recordings it covered
    <path>/base-<number>/rows, processed     what is current as of that run, after compact()
    <path>/bases/<number>                    mark of a finished base; the largest one counts

compact() writes the current outputs as a new base, marks it, and then removes the runs and bases
that it replaces. Creating the mark is the only step that readers notice, so a reader or an
interrupted compaction sees either the old state or the new one; runs that come in meanwhile have
larger numbers and stay.
"""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 64


def processed_videos(videos: DataFrame, rows: DataFrame, method: str, video: str = "video_id") -> DataFrame:
    """One row per processed recording with its row count, zero included."""
    n = rows.groupBy(video).agg(F.count("*").alias("n_rows"))
    return videos.select(video).distinct().join(n, video, "left").select(
        video, F.lit(method).alias("method"), F.coalesce("n_rows", F.lit(0)).alias("n_rows")
    )


def replace_video_outputs(rows: DataFrame, videos: DataFrame, path: str, method: str, video: str = "video_id") -> None:
    """Make rows the current output of the recordings in videos, rows or not, and leave all others alone."""
    run = F.lit(time.time_ns()).alias("run")
    dealt = rows.select("*", run, _bucket(video)).hint("rebalance", "bucket")
    dealt.write.mode("append").partitionBy("run", "bucket").parquet(f"{path}/rows")
    processed_videos(videos, rows, method, video).select("*", run).write.mode("append").partitionBy("run").parquet(f"{path}/processed")


def _bucket(video: str):
    return F.pmod(F.xxhash64(video), F.lit(BUCKETS)).alias("bucket")


def _folder(spark, path: str):
    """The file system of a path, and the names right below it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return store, [f.getPath().getName() for f in store.listStatus(at)] if store.exists(at) else []


def _base(spark, path: str) -> int:
    """Number of the last finished base; 0 if there is none."""
    return max((int(n) for n in _folder(spark, f"{path}/bases")[1] if n.isdigit()), default=0)


def _read(spark, path: str, kind: str, since: int) -> DataFrame:
    """rows or processed of the base `since` and of all later runs."""
    parts = []
    if since:
        parts.append(spark.read.parquet(f"{path}/base-{since}/{kind}"))
    if any(n.startswith("run=") for n in _folder(spark, f"{path}/{kind}")[1]):
        parts.append(spark.read.parquet(f"{path}/{kind}").where(F.col("run") > since))
    if not parts:
        raise FileNotFoundError(f"no outputs in {path}")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def compact(spark, path: str, video: str = "video_id") -> None:
    """Make what is current a new base and remove superseded runs. One compaction at a time."""
    old = _base(spark, path)
    last = _read(spark, path, "processed", old).agg(F.max("run")).first()[0]
    if last == old:
        return
    runs = _last_runs(_read(spark, path, "processed", old).where(F.col("run") <= last), video)
    rows = _read(spark, path, "rows", old).join(runs.select(video, "run"), [video, "run"], "left_semi")
    rows.drop("bucket").select("*", _bucket(video)).hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/base-{last}/rows")
    runs.write.mode("overwrite").parquet(f"{path}/base-{last}/processed")
    store, _ = _folder(spark, path)
    at = spark._jvm.org.apache.hadoop.fs.Path
    store.create(at(f"{path}/bases/{last}"), True).close()
    for kind in ("processed", "rows"):
        for name in _folder(spark, f"{path}/{kind}")[1]:
            if name.startswith("run=") and int(name[4:]) <= last:
                store.delete(at(f"{path}/{kind}/{name}"), True)
    if old:
        store.delete(at(f"{path}/bases/{old}"), True)
        store.delete(at(f"{path}/base-{old}"), True)


def _last_runs(processed: DataFrame, video: str) -> DataFrame:
    return processed.groupBy(video).agg(F.max(F.struct("run", "method", "n_rows")).alias("last")).select(video, "last.method", "last.n_rows", "last.run")


def write_scores(scores: DataFrame, videos: DataFrame, path: str, method: str, video: str = "video_id") -> None:
    """Scores by recording, plus which recordings were processed: "nothing found" differs from "not done"."""
    replace_video_outputs(scores, videos, path, method, video)


def write_suggestions(goals: DataFrame, in_reel: DataFrame, names: DataFrame, videos: DataFrame, path: str, method: str = "suggestions-v1") -> None:
    """What is suggested for each likely goal: goals(video, clip, stars), in_reel(video, clip), names(video, clip, suggested).

    Every recording in videos counts as rated, also without goals.
    """
    on = ["video", "clip"]
    used = in_reel.select(*on).distinct().withColumn("reel", F.lit(True))
    named = names.where("suggested is not null").groupBy(*on).agg(F.max("suggested").alias("scorer"))
    rows = goals.select(*on, "stars").join(used, on, "left").join(named, on, "left")
    replace_video_outputs(rows.select(*on, "stars", F.coalesce("reel", F.lit(False)).alias("reel"), "scorer"), videos, path, method, "video")


def read_current(spark, path: str, video: str = "video_id") -> tuple[DataFrame, DataFrame]:
    """(rows of each recording's last run, processed recordings)."""
    since = _base(spark, path)
    runs = _last_runs(_read(spark, path, "processed", since), video)
    rows = _read(spark, path, "rows", since)
    return rows.join(runs.select(video, "run"), [video, "run"], "left_semi").drop("run", "bucket"), runs.drop("run")


def write_ranked_csv(ranked: DataFrame, path: str, columns: Sequence[str], order: str = "rank") -> None:
    """CSV with a header, range-sorted by rank so part files read in order."""
    ranked.select(*columns).orderBy(order).write.mode("overwrite").option("header", "true").csv(path)


def write_dataset(manifest: DataFrame, path: str) -> None:
    """Manifest laid out as label=…/star_bin=…; a full rebuild."""
    manifest.write.mode("overwrite").partitionBy("label", "star_bin").parquet(path)
