"""Queries that fit and apply models.

SQL checks rows, folds, labels and ranks; the scores themselves are returned by queries without
SQL and compared with a plain version in the tests.
"""

from pyspark.sql import functions as F

from trackmill.operators import evaluate, scoring, shots as from_tracks, train
from trackmill.plans import bindings as b
from trackmill.plans.events import WALK
from trackmill.plans.registry import query, table
from trackmill.plans.tracks import SHOTS, shots
from trackmill.session import cut_lineage

FEATURES = ["f1", "f2"]
MEANS = f"""WITH {SHOTS}, lab AS (SELECT video_id, clip, count(*) AS n, avg(f2) >= 50 AS goal FROM shots GROUP BY 1, 2)"""


def labelled(spark, d):
    """shots and clip labels that follow feature f2."""
    s = shots(spark, d).select("video_id", "clip", "shot_idx", "f1", "f2")
    m = F.avg("f2")
    lab = s.groupBy("video_id", "clip").agg(F.when(m >= 50, "goal").otherwise("no_goal").alias("label"))
    return cut_lineage(s), cut_lineage(lab)


def labelled_rows(spark, d):
    s, lab = labelled(spark, d)
    return s.join(lab.select("video_id", "clip", (F.col("label") == "goal").alias("label")), ["video_id", "clip"])


@query("fit_classifier", f"""{MEANS} SELECT goal, CAST(sum(n) AS BIGINT) AS n, true AS ordered FROM lab GROUP BY 1""")
def fit_classifier(spark, d):
    """Every shot scored by a model fitted on all of them; scores must separate the labels."""
    rows = labelled_rows(spark, d)
    raw = train.predict(train.fit_classifier(rows, FEATURES, "filter"), rows)
    ok = F.col("raw").between(0, 1)
    g = raw.groupBy(F.col("label").alias("goal")).agg(F.count_if(ok).alias("n"), F.avg("raw").alias("m"))
    return g.select("goal", "n", (F.col("goal") == (F.col("m") >= 0.5)).alias("ordered"))


@query("shot_scores")
def shot_scores(spark, d):
    """The score of every shot under a model fitted on all of them."""
    rows = labelled_rows(spark, d)
    return train.predict(train.fit_classifier(rows, FEATURES, "filter"), rows).select("video_id", "clip", "shot_idx", "label", "raw")


def _held_out(spark, d):
    s, lab = labelled(spark, d)
    rows = s.join(lab.select("video_id", "clip", (F.col("label") == "goal").alias("label")), ["video_id", "clip"])
    return train.leave_one_group_out(rows, s, FEATURES, "video_id", ["video_id", "clip"], "prelabel"), lab


@query("leave_one_group_out", f"""{MEANS} SELECT video_id, clip, CAST(video_id AS VARCHAR) AS fold, true AS scored FROM lab""")
def leave_one_group_out(spark, d):
    """One score for each labelled clip, every recording left out in turn."""
    oof, _ = _held_out(spark, d)
    return oof.select("video_id", "clip", F.col("video_id").cast("string").alias("fold"), F.col("score").between(0, 1).alias("scored"))


@query("held_out_scores")
def held_out_scores(spark, d):
    """The out-of-fold score of every labelled clip, with its label."""
    oof, lab = _held_out(spark, d)
    return oof.join(lab, ["video_id", "clip"])


@query("score_videos", f"""{MEANS} SELECT video_id, clip, true AS scored, true AS own_shot FROM lab
WHERE video_id IN (SELECT video_id FROM lab GROUP BY 1 HAVING sum(n) >= 8)""")
def score_videos(spark, d):
    """Features -> ranks -> model -> cut-offs -> best shot, for all recordings in one job."""
    s, out = _scored(spark, d)
    own = s.select("video_id", F.col("clip").alias("own"), "shot_idx")
    out = out.join(own, ["video_id", "shot_idx"])
    return out.select("video_id", "clip", F.col("score").between(0, 1).alias("scored"), (F.col("own") == F.col("clip")).alias("own_shot"))


def _scored(spark, d):
    s, lab = labelled(spark, d)
    model, cuts, _ = train.train(s, lab, FEATURES, "prelabel")
    return s, train.score_videos(s, model, cut_lineage(cuts), FEATURES)


@query("video_scores")
def video_scores(spark, d):
    """Display score and likeliest shot of every clip."""
    return _scored(spark, d)[1]


# ---- from tracks to scores ------------------------------------------------------

#: Two long recordings, so that each has enough shots to be ranked at every scale.
RECORDINGS = 2
LONG = b.TRACK.replace("user_id AS video_id", f"user_id % {RECORDINGS} AS video_id").replace("PARTITION BY user_id", f"PARTITION BY user_id % {RECORDINGS}")
CLIPPED = WALK.replace(b.TRACK, LONG) + """, numbered AS (
  SELECT video_id, make_ms, sum(brk) OVER (PARTITION BY video_id ORDER BY make_ms) AS clip
  FROM (SELECT *, CASE WHEN make_ms - lag(make_ms) OVER (PARTITION BY video_id ORDER BY make_ms) < 5000
                       THEN 0 ELSE 1 END AS brk FROM makes)),
shot_list AS (SELECT video_id, CAST(clip AS BIGINT) AS clip, make_ms AS shot_ms,
  row_number() OVER (PARTITION BY video_id, clip ORDER BY make_ms) - 1 AS shot_idx FROM numbered)"""


def motion(spark, d):
    """events -> the movement behind the hoop at each frame of the track."""
    t = b.stored_track(spark, d, RECORDINGS)
    k = F.coalesce("cx", F.lit(3300.0))
    return t, t.select("video_id", "t_ms", (F.coalesce("cy", F.lit(0.0)) % 700 / 100).alias("diff"), ((k - 3300) / 2500).alias("coherence"))


@query("shot_rows", f"""WITH RECURSIVE {CLIPPED}, near AS (
  SELECT s.*, t.t_ms - s.shot_ms + 5000 AS t_ms, t.cx, t.cy FROM shot_list s
  JOIN track t ON t.video_id = s.video_id AND t.t_ms BETWEEN s.shot_ms - 5000 AND s.shot_ms + 2000)
SELECT video_id, clip, shot_idx, shot_ms, count(cx) AS n_detections, round(count(cx) / count(*), 9) AS detection_rate,
  round(coalesce(avg(coalesce(cy, 0) % 700 / 100) FILTER (t_ms BETWEEN 1000 AND 2500), 0), 9) AS baseline_mean,
  round(coalesce(max((coalesce(cx, 3300) - 3300) / 2500) FILTER (t_ms BETWEEN 4800 AND 6500), 0), 9) AS flow_coherence_peak
FROM near GROUP BY ALL""")
def shot_rows(spark, d):
    """Track -> crossings -> clips -> window -> features of track and motion, one row per shot."""
    t, m = motion(spark, d)
    r = lambda c: F.round(c, 9).alias(c)
    return from_tracks.shot_rows(t, b.hoop(), m).select(
        "video_id", "clip", "shot_idx", "shot_ms", "n_detections", r("detection_rate"), r("baseline_mean"), r("flow_coherence_peak"))


def _from_tracks(spark, d):
    """The model is fitted on labels that a rule over the shots' own features gives."""
    t, m = motion(spark, d)
    rows = cut_lineage(from_tracks.shot_rows(t, b.hoop(), m))
    names = [*from_tracks.TRACK_FEATURES, *from_tracks.MOTION_FEATURES]
    lab = rows.groupBy("video_id", "clip").agg(F.when(F.max("flow_coherence_peak") >= 0.9, "goal").otherwise("no_goal").alias("label"))
    model, cuts, _ = train.train(rows, cut_lineage(lab), names, "prelabel")
    return from_tracks.score_tracks(t, b.hoop(), model, cut_lineage(cuts), m)


@query("score_tracks", f"""WITH RECURSIVE {CLIPPED}
SELECT video_id, clip, count(*) AS n_shots, true AS scored, true AS own_shot FROM shot_list
WHERE video_id IN (SELECT video_id FROM shot_list GROUP BY 1 HAVING count(*) >= 8) GROUP BY 1, 2""")
def score_tracks(spark, d):
    """Tracks -> scores; SQL checks which clips are scored and that each names one of its own shots."""
    out = _from_tracks(spark, d)
    t = b.stored_track(spark, d, RECORDINGS)
    made = from_tracks.events.find_makes(t, b.hoop()).select("video_id", F.col("make_ms").alias("t_ms"))
    own = from_tracks.events.cluster_events(made).select("video_id", F.col("shot_no").alias("clip"), F.col("t_ms").alias("at"))
    g = out.join(own, ["video_id", "clip"]).groupBy("video_id", "clip", "score", "shot_ms").agg(
        F.count("*").alias("n_shots"), F.max(F.col("at") == F.col("shot_ms")).alias("own_shot"))
    return g.select("video_id", "clip", "n_shots", F.col("score").between(0, 1).alias("scored"), "own_shot")


@query("track_scores")
def track_scores(spark, d):
    """Display score, likeliest shot and its time for every clip, from tracks alone."""
    return _from_tracks(spark, d)
