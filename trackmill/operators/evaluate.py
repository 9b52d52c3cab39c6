"""Curves, cut-offs and reports over out-of-sample scores.

Inputs are rows of (label BOOLEAN, score DOUBLE). Thresholds are ordered after
counting per distinct score, in ranges, so no single task sees all of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackmill.ordered import value_ranks

# Fixed values of the evaluation protocol.
MIN_RECALL = 0.98
MAX_HIDDEN = 0.05
MIN_PRECISION = 0.85
MIN_KEPT = 5
MIN_SHOTS = 8


def _ranked(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    return value_ranks(scores, list(keys), "score", {"pos": F.col("label").cast("bigint")})


def pr_curve(scores: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Precision and recall of `score >= threshold` at every distinct score."""
    hit = F.col("pos_total") - F.col("pos_below")
    return _ranked(scores, keys).select(
        *keys, F.col("score").alias("threshold"),
        (hit / (F.col("total") - F.col("below"))).alias("precision"),
        F.when(F.col("pos_total") > 0, hit / F.col("pos_total")).otherwise(1.0).alias("recall"),
    )


def auc(scores: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve from rank sums; ties count half; null without both classes."""
    neg, neg_below = F.col("n") - F.col("pos"), F.col("below") - F.col("pos_below")
    won = F.sum(F.col("pos") * (neg_below + neg / 2))
    p, n = F.max("pos_total"), F.max(F.col("total") - F.col("pos_total"))
    return _ranked(scores, keys).groupBy(*keys).agg(F.when((p > 0) & (n > 0), won / (p * n)).alias("auc"))


def threshold_at_recall(curve: DataFrame, min_recall: float = MIN_RECALL, keys: Sequence[str] = ()) -> DataFrame:
    """Most precise threshold that keeps the recall; the lowest one on ties."""
    if not 0 < min_recall <= 1:
        raise ValueError("min_recall must be in (0, 1]")
    row = F.struct("threshold", "precision", "recall")
    best = curve.where(F.col("recall") >= min_recall).groupBy(*keys).agg(
        F.max_by(row, F.struct(F.col("precision"), -F.col("threshold"))).alias("b")
    )
    return best.select(*keys, "b.*")


def two_cutoffs(scores: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """lo: highest cut hiding at most 5% of makes; hi: lowest cut above lo that is precise enough.

    Candidate cuts are the scores at 4 decimals. They are ranked together with
    the exact scores, so `score < cut` is counted on unrounded values.
    """
    keys = list(keys)
    marks = scores.select(*keys, "score", F.col("label").cast("bigint").alias("y"), F.lit(1).alias("m"),
                          F.lit(0).alias("c"))
    cuts = scores.select(*keys, F.bround("score", 4).alias("score"), F.lit(0).cast("bigint").alias("y"),
                         F.lit(0).alias("m"), F.lit(1).alias("c")).distinct()
    r = value_ranks(marks.unionByName(cuts), keys, "score", {k: F.col(k) for k in ("y", "m", "c")})
    r = r.where("c > 0").select(
        *keys, F.col("score").alias("t"), F.col("y_below"), F.col("y_total"),
        (F.col("m_total") - F.col("m_below")).alias("kept"), (F.col("y_total") - F.col("y_below")).alias("made"),
    )
    lo = r.groupBy(*keys).agg(
        F.coalesce(F.max(F.when(F.col("y_below") <= MAX_HIDDEN * F.col("y_total"), F.col("t"))), F.lit(0.0)).alias("lo")
    )
    ok = (F.col("t") > F.col("lo")) & (F.col("kept") >= MIN_KEPT) & (F.col("made") / F.col("kept") >= MIN_PRECISION)
    j = r.join(lo, keys) if keys else r.crossJoin(lo)  # lo is a single row without keys
    best = j.groupBy(*keys).agg(F.min(F.when(ok, F.col("t"))).alias("_hi"))
    out = lo.join(best, keys, "left") if keys else lo.crossJoin(best)
    return out.select(*keys, "lo", F.coalesce("_hi", F.greatest(F.col("lo") + 1e-3, F.lit(0.5))).alias("hi"))


def filter_report(scores: DataFrame, threshold: float, video="video") -> DataFrame:
    """Precision before and after the filter, per recording and overall (null recording)."""
    kept = F.col("score") >= threshold
    frac = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(float("nan")))
    y = F.col("label")
    return scores.groupingSets([[F.col(video)], []], F.col(video)).agg(
        F.count("*").alias("n"),
        frac(F.count_if(y), F.count("*")).alias("precision_before"),
        frac(F.count_if(y & kept), F.count_if(kept)).alias("precision_after"),
        F.count_if(~kept).alias("n_dropped"), F.count_if(~kept & y).alias("n_real_dropped"),
    )


def training_report(scores: DataFrame) -> DataFrame:
    """One row: size, goals, AUC, both cut-offs, makes hidden below lo and precision from hi up."""
    cuts, area = two_cutoffs(scores), auc(scores)
    s, y = F.col("score"), F.col("label")
    j = scores.crossJoin(F.broadcast(cuts))  # one row
    out = j.groupBy("lo", "hi").agg(
        F.count("*").alias("n_clips"), F.count_if(y).alias("n_goals"),
        F.count_if(y & (s < F.col("lo"))).alias("n_hidden"),
        F.when(F.count_if(s >= F.col("hi")) > 0, F.count_if(y & (s >= F.col("hi"))) / F.count_if(s >= F.col("hi")))
        .alias("precision_at_hi"),
    )
    return out.crossJoin(F.broadcast(area)).withColumn("auc", F.round("auc", 3))


def training_rows(ranked: DataFrame, labels: DataFrame, video="video_id", clip="clip") -> DataFrame:
    """Shots fit to train on: single-shot clips, and merged clips in which every shot missed.

    `labels` holds a person's (clip, label) per recording. Recordings under
    MIN_SHOTS shots are dropped; a merged goal clip is too, as the scoring shot
    is unknown.
    """
    sizes = ranked.groupBy(video).agg(F.count("*").alias("_n")).where(F.col("_n") >= MIN_SHOTS)
    per_clip = ranked.groupBy(video, clip).agg(F.count("*").alias("_shots"))
    usable = (
        per_clip.join(labels.select(video, clip, "label"), [video, clip])
        .where(F.col("label").isin("goal", "no_goal") & ~((F.col("_shots") > 1) & (F.col("label") == "goal")))
        .join(sizes, video, "left_semi")
    )
    return ranked.join(usable.select(video, clip, (F.col("label") == "goal").alias("label")), [video, clip])
