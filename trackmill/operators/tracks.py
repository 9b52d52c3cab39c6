"""From candidate boxes to one point per frame, and comparing two tracks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackmill.functions.geometry import Box
from trackmill.ordered import value_ranks

# Fixed values of the detection stage.
TOP_K = 3
STATIC_CELL_PX = 10
STATIC_MAX_FRAC = 0.02


def frame_step(src_fps: Column, target_fps: float) -> Column:
    return F.greatest(F.lit(1), F.bround(src_fps / F.lit(float(target_fps))).cast("int"))


def sample_frames(frames: DataFrame, src_fps: Column, target_fps: float) -> DataFrame:
    """Keep every step-th frame; times stay those of the source frame number."""
    return frames.where(F.col("frame_idx") % frame_step(src_fps, target_fps) == 0).withColumn(
        "t_ms", F.bround(F.col("frame_idx") * 1000 / src_fps).cast("bigint")
    )


def inside(df: DataFrame, region: Box, x: Column, y: Column) -> DataFrame:
    """Rows whose point lies in a pixel region."""
    return df.where(x.between(region.x1, region.x2) & y.between(region.y1, region.y2))


def topk_candidates(dets: DataFrame, order: Sequence[Column], k: int = TOP_K, frame=("video_id", "frame_idx")) -> DataFrame:
    """Best k boxes per frame; Spark trims each task to k per frame before shuffling."""
    w = Window.partitionBy(*frame).orderBy(*order)
    return dets.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def static_cell(cx: Column, cy: Column, frame_w: Column, frame_h: Column) -> Column:
    """Grid cell used to spot detections that never move."""
    return F.struct(
        F.bround(cx * frame_w / STATIC_CELL_PX).cast("bigint").alias("gx"),
        F.bround(cy * frame_h / STATIC_CELL_PX).cast("bigint").alias("gy"),
    )


def static_cells(cands: DataFrame, spine: DataFrame, max_frac: float = STATIC_MAX_FRAC) -> DataFrame:
    """(video_id, cell) seen in more than max_frac of all sampled frames, empty ones included."""
    frames = spine.groupBy("video_id").agg(F.count("*").alias("n_frames"))
    seen = cands.groupBy("video_id", "cell").agg(F.count("*").alias("n_seen"))
    return seen.join(frames, "video_id").where(F.col("n_seen") > max_frac * F.col("n_frames"))


def suppress_static(
    cands: DataFrame, spine: DataFrame, keep: Sequence[str], max_frac: float = STATIC_MAX_FRAC
) -> DataFrame:
    """One row per frame of the spine: its best-ranked candidate off every static cell, or nulls.

    cands needs (video_id, frame_idx, rank, cell) and the columns in `keep`.
    """
    still = static_cells(cands, spine, max_frac).select("video_id", "cell")
    moving = cands.join(still, ["video_id", "cell"], "left_anti")
    best = moving.groupBy("video_id", "frame_idx").agg(F.min_by(F.struct(*keep), "rank").alias("best"))
    return spine.join(best, ["video_id", "frame_idx"], "left").select(*spine.columns, *[f"best.{c}" for c in keep])


def align_tracks(a: DataFrame, b: DataFrame, frame_w: float, frame_h: float) -> DataFrame:
    """Same-frame comparison of two detectors: who saw the object and how far apart."""
    on = ["video_id", "frame_idx"]
    j = a.select(*on, F.col("cx").alias("ax"), F.col("cy").alias("ay")).join(
        b.select(*on, F.col("cx").alias("bx"), F.col("cy").alias("by")), on, "full_outer"
    )
    sa, sb = F.col("ax").isNotNull(), F.col("bx").isNotNull()
    dx, dy = (F.col("ax") - F.col("bx")) * frame_w, (F.col("ay") - F.col("by")) * frame_h
    return j.select(
        *on,
        F.when(sa & sb, "both").when(sa, "only_a").when(sb, "only_b").otherwise("neither").alias("seen_by"),
        F.when(sa & sb, F.sqrt(dx * dx + dy * dy)).alias("distance"),
    )


def nearest_rank(df: DataFrame, keys: Sequence[str], value: str, fractions: dict[str, float]) -> DataFrame:
    """Percentiles taken at index round((n - 1) * p), half to even, without interpolation."""
    ranked = value_ranks(df.where(F.col(value).isNotNull()).select(*keys, value), keys, value)
    at = lambda p: F.bround((F.col("total") - 1) * F.lit(p)).cast("bigint")
    hit = lambda p: (F.col("below") <= at(p)) & (at(p) < F.col("below") + F.col("n"))
    return ranked.groupBy(*keys).agg(
        *[F.max(F.when(hit(p), F.col(value))).alias(name) for name, p in fractions.items()]
    )


def backend_report(aligned: DataFrame) -> DataFrame:
    """Per recording: detections of each side, agreement and distance percentiles."""
    n = lambda *o: F.count_if(F.col("seen_by").isin(*o))
    counts = aligned.groupBy("video_id").agg(
        F.count("*").alias("n_frames"),
        n("both", "only_a").alias("n_a"), n("both", "only_b").alias("n_b"),
        n("both").alias("n_both"), n("only_a").alias("n_only_a"), n("only_b").alias("n_only_b"),
        n("neither").alias("n_neither"), F.max("distance").alias("max_distance"),
    )
    pct = nearest_rank(aligned, ["video_id"], "distance", {"median_distance": 0.5, "p95_distance": 0.95})
    return counts.join(pct, "video_id", "left")
