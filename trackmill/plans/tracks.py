"""Queries over candidate boxes, calibrations and track features."""

from pyspark.sql import functions as F

from trackmill.functions import geometry as g
from trackmill.functions.scores import remap
from trackmill.operators import features, scoring, tracks
from trackmill.plans import bindings as b
from trackmill.plans.registry import query, table


def calibrations(spark, d):
    """customer -> one hoop box and frame size per recording."""
    k = F.col("c_custkey")
    size = k % 3
    c = table(spark, d, "customer").select(
        k.alias("video_id"),
        ((300 + k * 37 % 400).cast("double") / 1000).alias("x1"),
        ((100 + k * 53 % 300).cast("double") / 1000).alias("y1"),
        ((300 + k * 37 % 400 + 40 + k % 60).cast("double") / 1000).alias("x2"),
        ((100 + k * 53 % 300 + 30 + k % 50).cast("double") / 1000).alias("y2"),
        F.when(size == 0, 1920).when(size == 1, 3840).otherwise(2688).alias("w"),
        F.when(size == 0, 1080).when(size == 1, 2160).otherwise(1512).alias("h"),
    )
    return c


CALIB = """calib AS (
  SELECT c_custkey AS video_id, CAST(300 + c_custkey * 37 % 400 AS DOUBLE) / 1000 AS x1,
         CAST(100 + c_custkey * 53 % 300 AS DOUBLE) / 1000 AS y1,
         CAST(300 + c_custkey * 37 % 400 + 40 + c_custkey % 60 AS DOUBLE) / 1000 AS x2,
         CAST(100 + c_custkey * 53 % 300 + 30 + c_custkey % 50 AS DOUBLE) / 1000 AS y2,
         CASE c_custkey % 3 WHEN 0 THEN 1920 WHEN 1 THEN 3840 ELSE 2688 END AS w,
         CASE c_custkey % 3 WHEN 0 THEN 1080 WHEN 1 THEN 2160 ELSE 1512 END AS h FROM customer)"""
ROI = """roi AS (SELECT *, CAST(greatest(0, round_even((x1 - (x2 - x1) * (0.6 + 1.5)) * w, 0)) AS BIGINT) AS rx1,
  CAST(least(w, round_even((x2 + (x2 - x1) * (0.6 + 1.5)) * w, 0)) AS BIGINT) AS rx2,
  CAST(least(h, round_even((y2 + (y2 - y1) * (1.0 + 0.5)) * h, 0)) AS BIGINT) AS ry2 FROM calib)"""


@query("roi", f"""WITH {b.TRACK}, {CALIB}, {ROI}
SELECT video_id, rx1, 0 AS ry1, rx2, ry2,
       count(*) FILTER (cx / 10000 * w BETWEEN rx1 AND rx2 AND cy / 10000 * h BETWEEN 0 AND ry2) AS n_inside
FROM roi LEFT JOIN track USING (video_id) GROUP BY ALL""")
def roi(spark, d):
    """Crop of every calibrated recording and the track points it keeps."""
    cal = calibrations(spark, d)
    r = g.roi(g.box("x1", "y1", "x2", "y2"), F.col("w"), F.col("h"))
    cal = cal.select("video_id", "w", "h", *[getattr(r, n).alias("r" + n) for n in r._fields])
    crop = g.box("rx1", "ry1", "rx2", "ry2")
    kept = tracks.inside(
        b.track(spark, d).join(cal, "video_id"), crop,
        F.col("cx") / 10000 * F.col("w"), F.col("cy") / 10000 * F.col("h"),
    ).groupBy("video_id").agg(F.count("*").alias("n_inside"))
    return cal.drop("w", "h").join(kept, "video_id", "left").withColumn("n_inside", F.coalesce("n_inside", F.lit(0)))


@query("net_roi", f"""WITH {CALIB}, rim AS (SELECT *, x1 * w AS px1, y1 * h AS py1, x2 * w AS px2, y2 * h AS py2 FROM calib)
SELECT video_id,
  CAST(round_even(greatest(0.0, x1 - (x2 - x1) * 0.05) * w, 0) AS BIGINT) AS nx1,
  CAST(round_even(y2 * h, 0) AS BIGINT) AS ny1,
  CAST(round_even(least(1.0, x2 + (x2 - x1) * 0.05) * w, 0) AS BIGINT) AS nx2,
  CAST(round_even(least(1.0, y2 + (y2 - y1) * 0.9) * h, 0) AS BIGINT) AS ny2,
  CAST(greatest(0, trunc(px1 - (px2 - px1) * 0.1)) AS BIGINT) AS mx1,
  CAST(greatest(0, trunc((py1 + py2) / 2)) AS BIGINT) AS my1,
  CAST(least(w, trunc(px2 + (px2 - px1) * 0.1)) AS BIGINT) AS mx2,
  CAST(least(h, trunc(py2 + (px2 - px1) * 1.1)) AS BIGINT) AS my2 FROM rim""")
def net_roi(spark, d):
    cal = calibrations(spark, d)
    w, h = F.col("w"), F.col("h")
    n = g.net_roi(g.box("x1", "y1", "x2", "y2"), w, h)
    rim = g.Box(F.col("x1") * w, F.col("y1") * h, F.col("x2") * w, F.col("y2") * h)
    m = g.rim_net_roi(rim, w, h)
    return cal.select(
        "video_id", *[getattr(n, f).alias("n" + f) for f in n._fields], *[getattr(m, f).alias("m" + f) for f in m._fields]
    )


@query("rim_to_hoop", f"""WITH {CALIB}, rim AS (SELECT *, x1 * w AS px1, y1 * h AS py1, x2 * w AS px2, y2 * h AS py2 FROM calib)
SELECT video_id, round(((px1 + px2) / 2 - (px2 - px1) * 2.4 / 2) / w, 9) AS hx1,
  round(((py1 + py2) / 2 - (py2 - py1) * 2.6 / 2) / h, 9) AS hy1,
  round(((px1 + px2) / 2 + (px2 - px1) * 2.4 / 2) / w, 9) AS hx2,
  round(((py1 + py2) / 2 + (py2 - py1) * 2.6 / 2) / h, 9) AS hy2 FROM rim""")
def rim_to_hoop(spark, d):
    cal = calibrations(spark, d)
    w, h = F.col("w"), F.col("h")
    r = g.rim_to_hoop(g.Box(F.col("x1") * w, F.col("y1") * h, F.col("x2") * w, F.col("y2") * h), w, h)
    return cal.select("video_id", *[F.round(getattr(r, n), 9).alias("h" + n) for n in r._fields])


@query("box_center_norm", f"""WITH {CALIB}, {ROI}
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round((rx1 + (l_quantity + l_quantity + 10) / 2) / w, 9) AS cx,
  round((l_quantity * 2 + l_quantity * 2 + 12) / 2 / h, 9) AS cy
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN roi ON video_id = o_custkey""")
def box_center_norm(spark, d):
    """Boxes detected inside each recording's crop, as full-frame centres."""
    cal = calibrations(spark, d)
    r = g.roi(g.box("x1", "y1", "x2", "y2"), F.col("w"), F.col("h"))
    cal = cal.select(F.col("video_id").alias("o_custkey"), "w", "h", r.x1.alias("ox"), r.y1.alias("oy"))
    boxes = table(spark, d, "lineitem").join(
        table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey"
    )
    q = F.col("l_quantity")
    cx, cy = g.box_center(g.Box(q, q * 2, q + 10, q * 2 + 12), F.col("ox"), F.col("oy"), F.col("w"), F.col("h"))
    return boxes.join(cal, "o_custkey").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(cx, 9).alias("cx"), F.round(cy, 9).alias("cy")
    )


@query("sample_frames", f"""WITH {b.TRACK}, s AS (SELECT *, 24 + video_id % 4 * 12 AS fps FROM track)
SELECT video_id, frame_idx, CAST(round_even(frame_idx * 1000 / fps, 0) AS BIGINT) AS t_ms, cx, cy
FROM s WHERE frame_idx % greatest(1, CAST(round_even(fps / 15.0, 0) AS BIGINT)) = 0""")
def sample_frames(spark, d):
    t = b.track(spark, d)
    fps = (24 + F.col("video_id") % 4 * 12).cast("double")
    return tracks.sample_frames(t, fps, 15.0)


TOPK = b.CANDIDATES + f""", topk AS (SELECT * FROM (SELECT *, row_number() OVER (
  PARTITION BY video_id, frame_idx ORDER BY {b.CANDIDATE_ORDER_SQL}) AS rank FROM cand) WHERE rank <= 3)"""


def _topk(spark, d):
    return tracks.topk_candidates(b.candidates(spark, d), b.candidate_order())


@query("topk_candidates", f"WITH {TOPK} SELECT video_id, frame_idx, rank, conf, cell FROM topk")
def topk_candidates(spark, d):
    return _topk(spark, d).select("video_id", "frame_idx", "rank", "conf", "cell")


@query("suppress_static", f"""WITH {TOPK}, n AS (SELECT video_id, count(*) AS nf FROM spine GROUP BY 1),
still AS (SELECT video_id, cell FROM topk JOIN n USING (video_id) GROUP BY video_id, cell, nf HAVING count(*) > 0.02 * nf),
best AS (SELECT video_id, frame_idx, arg_min(conf, rank) AS conf, arg_min(cell, rank) AS cell FROM topk
         WHERE (video_id, cell) NOT IN (SELECT (video_id, cell) FROM still) GROUP BY ALL)
SELECT s.video_id, s.frame_idx, conf, cell FROM spine s LEFT JOIN best b USING (video_id, frame_idx)""")
def suppress_static(spark, d):
    return tracks.suppress_static(_topk(spark, d), b.spine(spark, d), ["conf", "cell"])


SECOND = """other AS (SELECT video_id, frame_idx, CASE WHEN frame_idx % 11 <> 0 THEN cx + frame_idx % 7 END AS cx,
  CASE WHEN frame_idx % 11 <> 0 THEN cy - frame_idx % 5 END AS cy FROM track WHERE frame_idx % 13 <> 0)"""
ALIGNED = b.TRACK + f""", {SECOND}, aligned AS (
  SELECT video_id, frame_idx, CASE WHEN a.cx IS NOT NULL AND o.cx IS NOT NULL THEN 'both'
         WHEN a.cx IS NOT NULL THEN 'only_a' WHEN o.cx IS NOT NULL THEN 'only_b' ELSE 'neither' END AS seen_by,
         CASE WHEN a.cx IS NOT NULL AND o.cx IS NOT NULL THEN
           round(sqrt((a.cx - o.cx) * 2.0 * ((a.cx - o.cx) * 2.0) + (a.cy - o.cy) * ((a.cy - o.cy))), 6) END AS distance
  FROM track a FULL JOIN other o USING (video_id, frame_idx))"""


def _aligned(spark, d):
    """The track against a second detector that misses and shifts some frames."""
    t = b.stored_track(spark, d)
    f = F.col("frame_idx")
    other = t.where(f % 13 != 0).select(
        "video_id", "frame_idx",
        F.when(f % 11 != 0, F.col("cx") + f % 7).alias("cx"), F.when(f % 11 != 0, F.col("cy") - f % 5).alias("cy"),
    )
    return tracks.align_tracks(t, other, 2.0, 1.0).withColumn("distance", F.round("distance", 6))


@query("align_tracks", f"WITH {ALIGNED} SELECT * FROM aligned")
def align_tracks(spark, d):
    return _aligned(spark, d)


@query("backend_report", f"""WITH {ALIGNED}, o AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY distance) - 1 AS i,
  count(*) OVER (PARTITION BY video_id) AS n FROM aligned WHERE distance IS NOT NULL),
p AS (SELECT video_id, max(distance) FILTER (i = round_even((n - 1) * 0.5, 0)) AS median_distance,
             max(distance) FILTER (i = round_even((n - 1) * 0.95, 0)) AS p95_distance FROM o GROUP BY 1)
SELECT video_id, count(*) AS n_frames, count(*) FILTER (seen_by IN ('both', 'only_a')) AS n_a,
  count(*) FILTER (seen_by IN ('both', 'only_b')) AS n_b, count(*) FILTER (seen_by = 'both') AS n_both,
  count(*) FILTER (seen_by = 'only_a') AS n_only_a, count(*) FILTER (seen_by = 'only_b') AS n_only_b,
  count(*) FILTER (seen_by = 'neither') AS n_neither, max(distance) AS max_distance,
  any_value(median_distance) AS median_distance, any_value(p95_distance) AS p95_distance
FROM aligned LEFT JOIN p USING (video_id) GROUP BY 1""")
def backend_report(spark, d):
    return tracks.backend_report(_aligned(spark, d))


FIRST = b.SIGHTED + """, first AS (
  SELECT video_id, min(t_ms) AS t FROM sighted
  WHERE cx BETWEEN 3400 AND 5600 AND cy BETWEEN 3000 AND 4000 AND above_ms IS NOT NULL GROUP BY 1),
hit AS (SELECT s.video_id, s.t_ms, s.cx, s.cy, s.above_ms, a.cx AS acx, a.cy AS acy
        FROM first f JOIN sighted s ON s.video_id = f.video_id AND s.t_ms = f.t
        JOIN track a ON a.video_id = s.video_id AND a.t_ms = s.above_ms),
aft AS (SELECT h.video_id, min(n.t_ms - h.t_ms) FILTER (n.cy < 3000) AS bounce, count(*) FILTER (n.cy > 3000) AS below
        FROM hit h JOIN track n ON n.video_id = h.video_id AND n.t_ms > h.t_ms AND n.t_ms <= h.t_ms + 2000 GROUP BY 1),
feats AS (
SELECT v.video_id, CAST(h.t_ms IS NOT NULL AS INT) AS has_crossing,
  coalesce((h.t_ms - h.above_ms) / 1000, 999.0) AS gap_sec, coalesce((h.cy - acy) / 500, 0.0) AS vertical_drop,
  coalesce(abs(acx - 4500) / 1000, 1.0) AS horiz_offset_above, coalesce(abs(h.cx - 4500) / 1000, 1.0) AS horiz_offset_through,
  CAST(bounce IS NOT NULL AS INT) AS bounced_back, coalesce(bounce / 1000, 999.0) AS time_to_bounce,
  n_detections, n_detections / n AS detection_rate, coalesce(below, 0) AS n_below_after
FROM (SELECT video_id, count(*) AS n, count(cx) AS n_detections FROM track GROUP BY 1) v
LEFT JOIN hit h USING (video_id) LEFT JOIN aft USING (video_id))"""


@query("track_features", f"WITH {FIRST} SELECT * FROM feats")
def track_features(spark, d):
    return features.track_features(b.stored_track(spark, d), b.hoop())


SHAPE = """whole AS (SELECT {k}, max(v) AS peak, arg_min(i, (-v, i)) AS pk, arg_max(v, i) AS last, count(*) AS n
  FROM series GROUP BY ALL),
rest AS (SELECT {k}, median(v) AS med FROM series JOIN whole USING ({k}) WHERE i <> pk GROUP BY ALL),
shape AS (SELECT {k}, peak, pk / n AS time_to_peak, CASE WHEN peak > 1e-6 THEN last / peak ELSE 0.0 END AS decay_ratio,
  peak / (coalesce(med, 0.0) + 1e-3) AS impulsiveness FROM whole LEFT JOIN rest USING ({k}))"""


@query("shape_features", f"""WITH {b.TRACK}, series AS (SELECT video_id, row_number() OVER (PARTITION BY video_id
  ORDER BY t_ms) - 1 AS i, cy / 100 AS v FROM track WHERE cy IS NOT NULL), {SHAPE.format(k='video_id')}
SELECT t.video_id, coalesce(peak, 0.0) AS peak, coalesce(time_to_peak, 0.0) AS time_to_peak,
  coalesce(decay_ratio, 0.0) AS decay_ratio, round(coalesce(impulsiveness, 0.0), 9) AS impulsiveness
FROM (SELECT DISTINCT video_id FROM track) t LEFT JOIN shape USING (video_id)""")
def shape_features(spark, d):
    from trackmill.ordered import time_block, with_ordinal

    t = b.stored_track(spark, d)
    s = with_ordinal(t.where("cy is not null"), ["video_id"], time_block("t_ms", 600_000), ["t_ms"], "n").select(
        "video_id", (F.col("n") - 1).alias("i"), (F.col("cy") / 100).alias("v")
    )
    out = features.shape_features(s, ["video_id"], t.select("video_id").distinct())
    return out.withColumn("impulsiveness", F.round("impulsiveness", 9))


@query("frame_diff", """WITH f AS (SELECT vec_id % 3 AS clip, vec_id // 3 AS i,
  list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1000) AS BIGINT)) AS px FROM embeddings),
p AS (SELECT *, lag(px) OVER (PARTITION BY clip ORDER BY i) AS prev FROM f)
SELECT clip, i, CAST(list_sum(list_transform(list_zip(px, prev), lambda z: abs(z[1] - z[2]))) AS DOUBLE) / len(px) AS v
FROM p WHERE prev IS NOT NULL""")
def frame_diff(spark, d):
    f = table(spark, d, "embeddings").select(
        (F.col("vec_id") % 3).alias("clip"), F.expr("vec_id div 3").alias("i"),
        F.transform("embedding", lambda x: F.floor(x.cast("double") * 1000)).alias("px"),
    )
    return features.frame_diff(f, ["clip"], block=256)


@query("flow_coherence", """WITH v AS (SELECT vec_id AS pair_id, CAST(embedding[2 * j + 1] AS DOUBLE) AS fx,
  CAST(embedding[2 * j + 2] AS DOUBLE) AS fy FROM embeddings, range(32) r(j))
SELECT pair_id, round(CASE WHEN sum(sqrt(fx * fx + fy * fy)) < 1e-6 THEN 0.0
  ELSE sqrt(sum(fx) ** 2 + sum(fy) ** 2) / sum(sqrt(fx * fx + fy * fy)) END, 9) AS coherence FROM v GROUP BY 1""")
def flow_coherence(spark, d):
    pairs = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda j: F.struct(
        F.col("embedding")[j * 2].cast("double").alias("fx"), F.col("embedding")[j * 2 + 1].cast("double").alias("fy")))
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("pair_id"), F.inline(pairs))
    return features.flow_coherence(v, ["pair_id"]).withColumn("coherence", F.round("coherence", 9))


@query("motion_features", f"""WITH {b.TRACK}, m AS (SELECT video_id, t_ms, cy / 100 AS diff, cx / 10000 AS coherence FROM track),
post AS (SELECT * FROM m WHERE t_ms BETWEEN 2800 AND 4500),
base AS (SELECT video_id, coalesce(avg(diff) FILTER (t_ms BETWEEN 0 AND 500), 0.0) AS baseline_mean,
  coalesce(max(coherence) FILTER (t_ms BETWEEN 2800 AND 4500), 0.0) AS flow_coherence_peak,
  coalesce(avg(coherence) FILTER (t_ms BETWEEN 2800 AND 4500), 0.0) AS flow_coherence_mean,
  coalesce(avg(coherence) FILTER (t_ms BETWEEN 0 AND 500), 0.0) AS baseline_flow_coherence_mean FROM m GROUP BY 1),
series AS (SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY t_ms) - 1 AS i, diff AS v
  FROM post WHERE diff IS NOT NULL), {SHAPE.format(k='video_id')}
SELECT video_id, round(baseline_mean, 9) AS baseline_mean, round(flow_coherence_peak, 9) AS flow_coherence_peak,
  round(flow_coherence_mean, 9) AS flow_coherence_mean, round(baseline_flow_coherence_mean, 9) AS baseline_flow_coherence_mean,
  round(coalesce(peak, 0.0), 9) AS diff_peak, round(coalesce(time_to_peak, 0.0), 9) AS diff_time_to_peak,
  round(coalesce(decay_ratio, 0.0), 9) AS diff_decay_ratio, round(coalesce(impulsiveness, 0.0), 9) AS diff_impulsiveness,
  round(coalesce(peak, 0.0) / (baseline_mean + 1e-3), 9) AS diff_peak_over_baseline
FROM base LEFT JOIN shape USING (video_id)""")
def motion_features(spark, d):
    m = b.stored_track(spark, d).select(
        "video_id", "t_ms", (F.col("cy") / 100).alias("diff"), (F.col("cx") / 10000).alias("coherence")
    )
    out = features.motion_features(m, ["video_id"], shift_ms=-2000)
    return out.select("video_id", *[F.round(c, 9).alias(c) for c in out.columns if c != "video_id"])


SHOTS = """shots AS (SELECT user_id AS video_id, event_id // 7 AS clip, event_id AS shot_idx, value AS f1,
  CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS f2,
  CAST((event_id * 7919 + CAST(round(value * 100) AS BIGINT)) % 1009 AS DOUBLE) / 1009 AS raw FROM events)"""


def shots(spark, d):
    """events -> shots of a recording (= user) with two features and a raw score."""
    return table(spark, d, "events").select(
        F.col("user_id").alias("video_id"), F.expr("event_id div 7").alias("clip"), F.col("event_id").alias("shot_idx"),
        F.col("value").alias("f1"), F.regexp_extract("props", "([0-9]+)", 1).cast("double").alias("f2"),
        ((F.col("event_id") * 7919 + F.round(F.col("value") * 100).cast("bigint")) % 1009 / 1009).alias("raw"),
    )


@query("rank_within", f"""WITH {SHOTS}, r AS (SELECT *, count(*) OVER (PARTITION BY video_id) AS n,
  rank() OVER (PARTITION BY video_id ORDER BY f1) AS r1, count(*) OVER (PARTITION BY video_id, f1) AS c1,
  rank() OVER (PARTITION BY video_id ORDER BY f2) AS r2, count(*) OVER (PARTITION BY video_id, f2) AS c2 FROM shots)
SELECT video_id, shot_idx, CASE WHEN n > 1 THEN (r1 - 1 + (c1 - 1) / 2) / (n - 1) ELSE 0.5 END AS f1,
  CASE WHEN n > 1 THEN (r2 - 1 + (c2 - 1) / 2) / (n - 1) ELSE 0.5 END AS f2 FROM r""")
def rank_within(spark, d):
    return scoring.rank_within(shots(spark, d), ["video_id", "shot_idx"], ["f1", "f2"])


REMAP = """CASE WHEN {x} < 0.07 THEN 0.2 * {x} / 0.07 WHEN {x} < 0.31 THEN 0.2 + (0.6 - 0.2) * ({x} - 0.07) / (0.31 - 0.07)
  ELSE 0.6 + (1 - 0.6) * ({x} - 0.31) / (1 - 0.31) END"""


@query("remap", f"WITH {SHOTS} SELECT shot_idx, round({REMAP.format(x='raw')}, 9) AS score FROM shots")
def remap_scores(spark, d):
    return shots(spark, d).select("shot_idx", F.round(remap(F.col("raw"), F.lit(0.07), F.lit(0.31)), 9).alias("score"))


BEST = SHOTS + f""", best AS (SELECT video_id, clip, arg_max(shot_idx, (raw, -shot_idx)) AS shot_idx,
  round({REMAP.format(x='max(raw)')}, 3) AS score FROM shots
  WHERE video_id IN (SELECT video_id FROM shots GROUP BY 1 HAVING count(*) >= 8) GROUP BY 1, 2)"""


def _best(spark, d):
    return scoring.best_shot(shots(spark, d), F.lit(0.07), F.lit(0.31))


@query("best_shot", f"WITH {BEST} SELECT * FROM best")
def best_shot(spark, d):
    return _best(spark, d)


@query("bin_counts", f"""WITH {BEST} SELECT video_id, count(*) FILTER (score >= 0.6) AS make,
  count(*) FILTER (score >= 0.2 AND score < 0.6) AS unsure, count(*) FILTER (score < 0.2) AS miss FROM best GROUP BY 1""")
def bin_counts(spark, d):
    return scoring.bin_counts(_best(spark, d), ["video_id"])


@query("filter_by_score", f"""WITH {BEST} SELECT video_id, count(*) FILTER (score >= 0.3) AS n_kept,
  count(*) FILTER (score < 0.3) AS n_dropped FROM best GROUP BY 1""")
def filter_by_score(spark, d):
    return scoring.filter_counts(scoring.filter_by_score(_best(spark, d), 0.3))
