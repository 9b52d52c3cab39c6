"""Trajectory and motion features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackmill.functions.geometry import Box, side_band, through_band
from trackmill.operators.events import TRACK_BLOCK_MS, crossing_state
from trackmill.ordered import BLK, time_block, value_ranks, with_lag
from trackmill.session import cut_lineage

# Fixed values of the feature recipe.
AFTER_CROSSING_MS = 2000
NONE_SEC = 999.0
POST_WINDOW_MS = (4800, 6500)
BASELINE_WINDOW_MS = (1000, 2500)
EPS = 1e-3


def track_features(track: DataFrame, b: Box, keys: Sequence[str] = ("video_id",), block_ms=TRACK_BLOCK_MS) -> DataFrame:
    """Ten statistics of the first crossing of each track."""
    keys = list(keys)
    state = crossing_state(track, b, keys, block_ms)
    cx, cy = F.col("cx"), F.col("cy")
    crosses = side_band(b, cx) & through_band(b, cy) & F.col("above_ms").isNotNull()
    first = state.groupBy(*keys).agg(
        F.count("*").alias("_rows"), F.count("cx").alias("n_detections"),
        F.min_by(
            F.struct("t_ms", "cx", "cy", "above_ms", "above_cx", "above_cy"), F.when(crosses, F.col("t_ms"))
        ).alias("hit"),
    )
    first = cut_lineage(first)  # one row per track
    # joining on (key, block) reads only blocks the window touches and spreads a long track
    t = F.col("hit.t_ms")
    touched = F.sequence(time_block(t, block_ms), time_block(t + AFTER_CROSSING_MS, block_ms))
    window = first.where("hit is not null").select(*keys, t.alias("_t"), F.explode(touched).alias(BLK))
    near = track.withColumn(BLK, time_block("t_ms", block_ms)).join(window, [*keys, BLK]).where(
        (F.col("t_ms") > F.col("_t")) & (F.col("t_ms") <= F.col("_t") + AFTER_CROSSING_MS)
    )
    after = near.groupBy(*keys).agg(
        F.min(F.when(cy < b.y1, F.col("t_ms") - F.col("_t"))).alias("_bounce"),
        F.count_if(cy > b.y1).alias("_below"),
    )
    j = first.join(after, keys, "left")
    has = F.col("hit").isNotNull()
    mid = (b.x1 + b.x2) / 2
    pick = lambda v, d: F.when(has, v).otherwise(F.lit(d))
    return j.select(
        *keys,
        has.cast("int").alias("has_crossing"),
        pick((F.col("hit.t_ms") - F.col("hit.above_ms")) / 1000, NONE_SEC).alias("gap_sec"),
        pick((F.col("hit.cy") - F.col("hit.above_cy")) / b.h, 0.0).alias("vertical_drop"),
        pick(F.abs(F.col("hit.above_cx") - mid) / b.w, 1.0).alias("horiz_offset_above"),
        pick(F.abs(F.col("hit.cx") - mid) / b.w, 1.0).alias("horiz_offset_through"),
        F.col("_bounce").isNotNull().cast("int").alias("bounced_back"),
        F.coalesce(F.col("_bounce") / 1000, F.lit(NONE_SEC)).alias("time_to_bounce"),
        "n_detections",
        (F.col("n_detections") / F.col("_rows")).alias("detection_rate"),
        F.coalesce("_below", F.lit(0)).alias("n_below_after"),
    )


def shape_features(series: DataFrame, keys: Sequence[str], spine: DataFrame | None = None) -> DataFrame:
    """Peak, time to peak, decay and impulsiveness of series(keys, i, v), i = 0..n-1.

    Taking one maximum out of a sorted series leaves the rest in place, so the
    median without the peak is read off value counts at a shifted index. Keys of
    `spine` without any row get zeros.
    """
    keys = list(keys)
    whole = series.groupBy(*keys).agg(
        F.max("v").alias("peak"), F.min_by("i", F.struct(-F.col("v"), F.col("i"))).alias("_at"),
        F.max_by("v", "i").alias("_last"), F.count("*").alias("_n"),
    )
    lo, hi = F.floor((F.col("total") - 2) / 2), F.ceil((F.col("total") - 2) / 2)
    at = lambda k: F.max(F.when((F.col("below") <= k) & (k < F.col("below") + F.col("n")), F.col("v")))
    rest = value_ranks(series.select(*keys, "v"), keys, "v").where("total > 1").groupBy(*keys).agg(
        ((at(lo) + at(hi)) / 2).alias("_med")
    )
    out = whole.join(rest, keys, "left")
    if spine is not None:
        out = spine.select(*keys).join(out, keys, "left")
    zero = F.lit(0.0)
    return out.select(
        *keys,
        F.coalesce("peak", zero).alias("peak"),
        F.coalesce(F.col("_at") / F.col("_n"), zero).alias("time_to_peak"),
        F.when(F.col("peak") > 1e-6, F.col("_last") / F.col("peak")).otherwise(zero).alias("decay_ratio"),
        F.coalesce(F.col("peak") / (F.coalesce("_med", zero) + EPS), zero).alias("impulsiveness"),
    )


def frame_diff(frames: DataFrame, keys: Sequence[str], block: int = 1024) -> DataFrame:
    """Mean absolute difference of consecutive gray frames(keys, i, px)."""
    f = with_lag(frames, list(keys), time_block("i", block), ["i"], "px", "_prev").where("_prev is not null")
    gap = F.aggregate(F.zip_with("px", "_prev", lambda x, y: F.abs(x - y).cast("bigint")), F.lit(0).cast("bigint"),
                      lambda s, x: s + x)
    return f.select(*keys, "i", (gap / F.size("px")).alias("v"))


def flow_coherence(vectors: DataFrame, keys: Sequence[str]) -> DataFrame:
    """|sum of vectors| / sum of |vector| per frame pair; 0 when nothing moves."""
    total = F.sum(F.hypot("fx", "fy"))
    along = F.hypot(F.sum("fx"), F.sum("fy"))
    return vectors.groupBy(*keys).agg(F.when(total < 1e-6, 0.0).otherwise(along / total).alias("coherence"))


def motion_features(motion: DataFrame, keys: Sequence[str], shift_ms: int = 0) -> DataFrame:
    """Nine features of motion(keys, t_ms, diff, coherence): a window after the event against a quiet one."""
    keys = list(keys)
    t = F.col("t_ms")
    post = t.between(*[w + shift_ms for w in POST_WINDOW_MS])
    quiet = t.between(max(0, BASELINE_WINDOW_MS[0] + shift_ms), max(500, BASELINE_WINDOW_MS[1] + shift_ms))
    base = motion.groupBy(*keys).agg(
        F.coalesce(F.avg(F.when(quiet, F.col("diff"))), F.lit(0.0)).alias("baseline_mean"),
        F.coalesce(F.max(F.when(post, F.col("coherence"))), F.lit(0.0)).alias("flow_coherence_peak"),
        F.coalesce(F.avg(F.when(post, F.col("coherence"))), F.lit(0.0)).alias("flow_coherence_mean"),
        F.coalesce(F.avg(F.when(quiet, F.col("coherence"))), F.lit(0.0)).alias("baseline_flow_coherence_mean"),
    )
    # the post window is 1.7 s of frames, so numbering it per key is bounded
    w = Window.partitionBy(*keys).orderBy("t_ms")
    series = motion.where(post & F.col("diff").isNotNull()).select(
        *keys, (F.row_number().over(w) - 1).alias("i"), F.col("diff").alias("v")
    )
    shape = shape_features(series, keys)
    names = ("peak", "time_to_peak", "decay_ratio", "impulsiveness")
    out = base.join(shape, keys, "left").select(
        *base.columns, *[F.coalesce(n, F.lit(0.0)).alias(f"diff_{n}") for n in names]
    )
    return out.withColumn("diff_peak_over_baseline", F.col("diff_peak") / (F.col("baseline_mean") + EPS))
