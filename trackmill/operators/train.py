"""Make/miss models: fitting, out-of-fold scores and scoring of whole tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackmill.functions.scores import remap
from trackmill.operators import boosting, evaluate, scoring
from trackmill.operators.boosting import Model, Settings
from trackmill.session import cut_lineage

# Fixed settings of the two model kinds.
SETTINGS = {
    "filter": Settings(trees=100, depth=3, rate=0.1),
    "prelabel": Settings(trees=150, depth=2, rate=0.05, sample=0.8),
}


def fit_classifier(rows: DataFrame, features: Sequence[str], kind: str = "prelabel", **overrides) -> Model:
    """Fit on rows(label BOOLEAN, features…); overrides are fields of Settings."""
    return boosting.fit(rows, features, replace(SETTINGS[kind], **overrides))


def predict(model: Model, rows: DataFrame, name: str = "raw") -> DataFrame:
    """Adds the probability of a make."""
    return boosting.predict(model, rows, name)


def fold_of(group: Column, n: int) -> Column:
    """A fold of 0..n-1 from the group's MD5, the same for a group whatever rows it is asked for."""
    return (F.conv(F.substring(F.md5(group.cast("string").cast("binary")), 1, 8), 16, 10).cast("bigint") % n).cast("int")


def _folds(group: str, folds: int | None) -> Column:
    return (F.col(group) if folds is None else fold_of(F.col(group), folds)).cast("string")


def leave_one_group_out(
    train_rows: DataFrame, all_rows: DataFrame, features: Sequence[str], group: str, clip: Sequence[str],
    kind: str = "prelabel", folds: int | None = None, **overrides,
) -> DataFrame:
    """Out-of-fold score per clip: the best of its shots under models that never saw its group.

    The caller chooses the protocol, whatever the number of groups: folds=None
    gives each group of all_rows a fold of its own (one model per group),
    folds=n hashes the groups into n folds that keep every group whole. All folds
    are fitted in one job. Groups without training rows are scored like any other.
    """
    return _out_of_fold(train_rows, all_rows, features, group, clip, kind, folds, **overrides)[1]


def _out_of_fold(train_rows, all_rows, features, group, clip, kind, folds, **overrides) -> tuple[Model, DataFrame]:
    """The model on all rows, and the out-of-fold score per clip."""
    rows = all_rows.select(group, *[c for c in clip if c != group], *features)
    model, raw = boosting.held_out(train_rows, rows, features, replace(SETTINGS[kind], **overrides), _folds(group, folds))
    return model, raw.groupBy(*clip).agg(F.max("raw").alias("score"))


def train(shots: DataFrame, labels: DataFrame, features: Sequence[str], kind="prelabel", folds=None, **overrides):
    """(model, cut-offs, out-of-fold scores) from shots(video_id, clip, shot_idx, features…) and a person's labels."""
    ids = ["video_id", "clip", "shot_idx"]
    ranked = cut_lineage(scoring.rank_within(shots, ids, features))
    rows = cut_lineage(evaluate.training_rows(ranked, labels))
    big = ranked.groupBy("video_id").agg(F.count("*").alias("n")).where(F.col("n") >= evaluate.MIN_SHOTS)
    judged = labels.where(F.col("label").isin("goal", "no_goal")).join(big, "video_id", "left_semi")
    test = ranked.join(judged.select("video_id", "clip"), ["video_id", "clip"], "left_semi")
    model, oof = _out_of_fold(rows, test, features, "video_id", ["video_id", "clip"], kind, folds, **overrides)
    oof = cut_lineage(oof.join(judged.select("video_id", "clip", (F.col("label") == "goal").alias("label")), ["video_id", "clip"]))
    return model, evaluate.two_cutoffs(oof), oof


def score_videos(shots: DataFrame, model: Model, cutoffs: DataFrame, features: Sequence[str]) -> DataFrame:
    """Display score and likeliest shot of every clip of every recording at once; cutoffs holds one row (lo, hi)."""
    if cutoffs.limit(2).count() != 1:
        raise ValueError("one row of cut-offs is needed")
    ranked = cut_lineage(scoring.rank_within(shots, ["video_id", "clip", "shot_idx"], features))
    raw = predict(model, ranked).crossJoin(F.broadcast(cutoffs))
    sized = raw.groupBy("video_id").agg(F.count("*").alias("n")).where(F.col("n") >= scoring.MIN_SHOTS)
    best = raw.groupBy("video_id", "clip").agg(
        F.max_by(F.struct("raw", "shot_idx", "lo", "hi"), F.struct(F.col("raw"), -F.col("shot_idx"))).alias("b")
    ).join(sized, "video_id", "left_semi")
    return best.select(
        "video_id", "clip", F.col("b.shot_idx").alias("shot_idx"),
        F.bround(remap(F.col("b.raw"), F.col("b.lo"), F.col("b.hi")), 3).alias("score"),
    )
