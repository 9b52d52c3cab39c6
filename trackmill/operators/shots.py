"""From tracks to one feature row per shot, and from there to scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackmill.functions.geometry import Box
from trackmill.operators import events, train
from trackmill.operators.boosting import Model
from trackmill.operators.features import motion_features, track_features
from trackmill.ordered import time_block, with_ordinal
from trackmill.session import cut_lineage

TRACK_FEATURES = (
    "has_crossing", "gap_sec", "vertical_drop", "horiz_offset_above", "horiz_offset_through", "bounced_back",
    "time_to_bounce", "n_detections", "detection_rate", "n_below_after",
)
MOTION_FEATURES = (
    "baseline_mean", "flow_coherence_peak", "flow_coherence_mean", "baseline_flow_coherence_mean", "diff_peak",
    "diff_time_to_peak", "diff_decay_ratio", "diff_impulsiveness", "diff_peak_over_baseline",
)


def shot_rows(track: DataFrame, b: Box, motion: DataFrame | None = None) -> DataFrame:
    """Every crossing of every recording as (video_id, clip, shot_idx, shot_ms, features…).

    Crossings chain into clips (clip counts them per recording, shot_idx the shots of a clip, from
    0); each shot takes the track, and motion(video_id, t_ms, diff, coherence) if given, in a
    window around it. A shot without motion rows has zeros for them. The track is read three times
    and should be a written table.
    """
    made = events.find_makes(track, b).select("video_id", F.col("make_ms").alias("t_ms"))
    shots = cut_lineage(events.cluster_events(made))
    numbered = with_ordinal(shots, ["video_id", "shot_no"], time_block("t_ms", events.EVENT_BLOCK_MS), ["t_ms"], "n")
    keys = ["video_id", "shot_ms"]
    ids = numbered.select("video_id", F.col("t_ms").alias("shot_ms"), F.col("shot_no").alias("clip"), (F.col("n") - 1).alias("shot_idx"))
    near = cut_lineage(events.shots_in_window(track.select("video_id", "t_ms", "cx", "cy"), shots))
    out = ids.join(track_features(near, b, keys), keys)
    if motion is not None:
        around = cut_lineage(events.shots_in_window(motion, shots))
        out = out.join(motion_features(around, keys), keys, "left").na.fill(0.0, list(MOTION_FEATURES))
    return out.select("video_id", "clip", "shot_idx", "shot_ms", *TRACK_FEATURES, *(MOTION_FEATURES if motion is not None else ()))


def score_tracks(track: DataFrame, b: Box, model: Model, cutoffs: DataFrame, motion: DataFrame | None = None) -> DataFrame:
    """Display score and likeliest shot of every clip, from the tracks of all recordings in one go."""
    rows = cut_lineage(shot_rows(track, b, motion))
    best = train.score_videos(rows, model, cutoffs, model.features)
    return best.join(rows.select("video_id", "clip", "shot_idx", "shot_ms"), ["video_id", "clip", "shot_idx"])
