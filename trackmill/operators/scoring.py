"""Ranking shots within a recording, best shots, score bins and filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackmill.functions.scores import MAKE_FROM, MISS_BELOW, remap
from trackmill.ordered import value_ranks

MIN_SHOTS = 8
HOT_VALUE = 100_000
SALTS = 32


def rank_within(df: DataFrame, ids: Sequence[str], cols: Sequence[str], by: Sequence[str] = ("video_id",)) -> DataFrame:
    """Each column replaced by its average-tie rank within `by`, scaled to 0..1; a single row gets 0.5.

    All columns go through one long table: ties are counted per value first, so
    ordering works on distinct values and one recording's rank spreads over many
    tasks. A null has no rank (null) and does not count as a row of its feature;
    every row of df comes back. `ids` must identify a row and include `by`.
    """
    by, ids = list(by), list(ids)
    long = df.select(*ids, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(ids, list(cols), "_feature", "_v").where("_v is not null")
    keys = [*by, "_feature"]
    ranks = value_ranks(long, keys, "_v").select(
        *keys, "_v",
        F.when(F.col("total") > 1, (F.col("below") + (F.col("n") - 1) / 2) / (F.col("total") - 1))
        .otherwise(0.5).alias("_r"), "n",
    )
    # a default may be most of a feature's rows: copies of the value's rank share them out
    salt = F.pmod(F.xxhash64(*ids), F.lit(SALTS)).cast("int")
    ranks = ranks.withColumn("_s", F.explode(F.when(F.col("n") >= HOT_VALUE, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(-1)))))
    hot = ranks.where("_s = 0").select(*keys, "_v", F.lit(True).alias("_hot"))
    long = long.join(hot, [*keys, "_v"], "left").withColumn("_s", F.when(F.col("_hot"), salt).otherwise(F.lit(-1))).drop("_hot")
    back = long.join(ranks, [*keys, "_v", "_s"]).groupBy(*ids).pivot("_feature", list(cols)).agg(F.first("_r"))
    return df.select(*ids).join(back, ids, "left").select(*ids, *cols)


def best_shot(
    scored: DataFrame, lo: Column, hi: Column, video="video_id", clip="clip", shot="shot_idx", score="raw"
) -> DataFrame:
    """Per clip its likeliest shot and display score; recordings under MIN_SHOTS shots give nothing."""
    sizes = scored.groupBy(video).agg(F.count("*").alias("_n")).where(F.col("_n") >= MIN_SHOTS)
    best = scored.groupBy(video, clip).agg(
        F.max_by(F.struct(score, shot), F.struct(F.col(score), -F.col(shot))).alias("b")
    )
    return best.join(sizes, video, "left_semi").select(
        video, clip, F.col(f"b.{shot}").alias(shot), F.bround(remap(F.col(f"b.{score}"), lo, hi), 3).alias("score")
    )


def bin_counts(scores: DataFrame, keys: Sequence[str] = (), score="score") -> DataFrame:
    s = F.col(score)
    return scores.groupBy(*keys).agg(
        F.count_if(s >= MAKE_FROM).alias("make"),
        F.count_if((s >= MISS_BELOW) & (s < MAKE_FROM)).alias("unsure"),
        F.count_if(s < MISS_BELOW).alias("miss"),
    )


def filter_by_score(clips: DataFrame, threshold: float, score="score") -> DataFrame:
    return clips.withColumn("kept", F.col(score) >= threshold)


def filter_counts(flagged: DataFrame, keys: Sequence[str] = ("video_id",)) -> DataFrame:
    return flagged.groupBy(*keys).agg(F.count_if("kept").alias("n_kept"), F.count_if(~F.col("kept")).alias("n_dropped"))
