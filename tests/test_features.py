import pytest
from pyspark.sql import functions as F

from trackmill.functions.geometry import box, net_roi, rim_net_roi, roi
from trackmill.functions.scores import remap
from trackmill.operators import features, scoring, tracks

TRACK = "video_id string, t_ms long, cx double, cy double"


def first_crossing(spark, **tracks):
    rows = [(name, *point) for name, points in tracks.items() for point in points]
    return {r.video_id: r for r in features.track_features(spark.createDataFrame(rows, TRACK), box(0.20, 0.50, 0.36, 0.58)).collect()}


def test_features_of_the_first_crossing(spark):
    drop = [(1000, 0.30, 0.42), (1240, 0.26, 0.60)]
    later = [(9000, 0.28, 0.45), (9040, 0.28, 0.64)]
    f = first_crossing(spark, drop=drop + later, back=[*drop, (1600, 0.28, 0.41)], settles=[*drop, *((1300 + 50 * i, 0.28, 0.70) for i in range(7))])
    d = f["drop"]
    assert d.has_crossing == 1 and d.n_detections == 4 and d.detection_rate == 1.0
    assert d.gap_sec == pytest.approx(0.24) and d.vertical_drop == pytest.approx(2.25)
    assert d.horiz_offset_above == pytest.approx(0.125) == d.horiz_offset_through
    assert (d.bounced_back, d.time_to_bounce, d.n_below_after) == (0, 999.0, 0)
    assert f["back"].bounced_back == 1 and f["back"].time_to_bounce == pytest.approx(0.36)
    assert f["settles"].n_below_after == 7


def test_features_without_a_crossing(spark):
    f = first_crossing(spark, blank=[(t, None, None) for t in range(0, 250, 50)], wide=[(0, 0.8, 0.4), (40, 0.8, 0.6), (80, None, None), (120, 0.8, 0.7)])
    for r in f.values():
        assert (r.has_crossing, r.gap_sec, r.vertical_drop, r.horiz_offset_above, r.horiz_offset_through) == (0, 999.0, 0.0, 1.0, 1.0)
    assert (f["blank"].n_detections, f["blank"].detection_rate) == (0, 0.0)
    assert (f["wide"].n_detections, f["wide"].detection_rate) == (3, 0.75)


def test_shape_and_frames(spark):
    s = spark.createDataFrame([("a", i, v) for i, v in enumerate([1.0, 1.0, 20.0, 3.0, 1.0])] + [("one", 0, 4.0)], "clip string, i int, v double")
    spine = spark.createDataFrame([("a",), ("one",), ("empty",)], "clip string")
    r = {x.clip: x for x in features.shape_features(s, ["clip"], spine).collect()}
    assert (r["a"].peak, r["a"].time_to_peak) == (20.0, 0.4) and r["a"].decay_ratio < 0.2 and r["a"].impulsiveness > 5
    assert r["one"].impulsiveness == pytest.approx(4.0 / 1e-3)
    assert tuple(r["empty"])[1:] == (0.0, 0.0, 0.0, 0.0)
    fr = spark.createDataFrame([("a", i, [v] * 4) for i, v in enumerate([0, 50, 0])], "clip string, i long, px array<int>")
    assert [x.v for x in features.frame_diff(fr, ["clip"], block=2).orderBy("i").collect()] == [50.0, 50.0]


def test_static_spot(spark):
    cands = [(f, 1, 0.12, 0.5, 0.5) for f in range(100)] + [(40, 2, 0.9, 0.3, 0.2)]
    few = [(f, 1, 0.8, 0.4, 0.4) for f in (10, 11)]
    rows = [("spot", *r) for r in cands] + [("few", *r) for r in few]
    d = spark.createDataFrame(rows, "video_id string, frame_idx int, rank int, conf double, cx double, cy double")
    d = d.withColumn("cell", tracks.static_cell(F.col("cx"), F.col("cy"), F.lit(1920), F.lit(1080)))
    spine = spark.createDataFrame([(v, f) for v in ("spot", "few") for f in range(100)], "video_id string, frame_idx int")
    got = {(r.video_id, r.frame_idx): (r.cx, r.cy) for r in tracks.suppress_static(d, spine, ["cx", "cy"]).collect()}
    assert len(got) == 200
    assert got["spot", 40] == (0.3, 0.2) and got["spot", 0] == (None, None)
    assert got["few", 10] == (0.4, 0.4) and got["few", 12] == (None, None)


def test_ranks_share_ties(spark):
    rows = [("v", i, float(x), -2.0 * x) for i, x in enumerate([40, 10, 10, 10, 25])]
    d = spark.createDataFrame(rows, "video_id string, shot_idx int, up double, down double")
    r = scoring.rank_within(d, ["video_id", "shot_idx"], ["up", "down"]).orderBy("shot_idx").collect()
    assert [x.up for x in r] == [1.0, 0.25, 0.25, 0.25, 0.75]
    assert [x.down for x in r] == [1 - x.up for x in r]
    assert scoring.rank_within(d.where("shot_idx = 4"), ["video_id", "shot_idx"], ["up"]).first().up == 0.5


def test_remap_meets_the_cutoffs(spark):
    lo, hi = 0.12, 0.44
    v = spark.createDataFrame([(i / 50,) for i in range(51)], "x double")
    m = {round(q.x, 2): q.y for q in v.select("x", remap(F.col("x"), F.lit(lo), F.lit(hi)).alias("y")).collect()}
    assert list(m.values()) == sorted(m.values()) and (m[0.0], m[1.0]) == (0.0, 1.0)
    assert m[lo] == pytest.approx(0.2) and m[hi] == pytest.approx(0.6) and m[0.28] == pytest.approx(0.4)


def test_best_shot_is_the_first_of_equals(spark):
    s = spark.createDataFrame([("big", f"c{i // 3}", i, 0.6) for i in range(9)] + [("small", "c", i, 0.9) for i in range(7)],
                              "video_id string, clip string, shot_idx int, raw double")
    best = scoring.best_shot(s, F.lit(0.2), F.lit(0.5)).collect()
    assert {(b.video_id, b.clip, b.shot_idx) for b in best} == {("big", f"c{i}", 3 * i) for i in range(3)}


def test_regions(spark):
    one = spark.range(1)
    r = roi(box(0.4, 0.3, 0.5, 0.35), F.lit(1000), F.lit(1000))
    n = net_roi(box(0.4, 0.3, 0.5, 0.35), F.lit(1000), F.lit(1000))
    m = rim_net_roi(box(400, 300, 500, 350), F.lit(1000), F.lit(1000))
    assert tuple(one.select(*r).collect()[0]) == (190, 0, 710, 425)
    assert tuple(one.select(*n).collect()[0]) == (395, 350, 505, 395)
    assert tuple(one.select(*m).collect()[0]) == (390, 325, 510, 460)
