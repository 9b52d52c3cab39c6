from trackmill.operators import highlights as h

GOALS = "session string, video string, clip string, score double, ai_score double"


def ranked(spark, n, score=0.9):
    rows = [("s", "v", f"shot_{i:03d}", score, 10.0 - i / 10) for i in range(n)]
    return h.assign_stars(h.rank_goals(spark.createDataFrame(rows, GOALS)))


def test_star_shares(spark):
    stars = [r.stars for r in ranked(spark, 20).orderBy("pos").collect()]
    assert stars.count(5) == 3 and stars.count(4) == 6 and stars == sorted(stars, reverse=True)
    assert [r.stars for r in ranked(spark, 1).collect()] == [5]


def test_candidates_and_top_up(spark):
    g = ranked(spark, 12, 0.7)
    labels = spark.createDataFrame(
        [("v", "shot_000", "no_goal", None, None), ("v", "shot_005", "goal", 5, None), ("v", "shot_001", "no_goal", None, "ai")],
        "video string, clip string, label string, stars int, source string")
    out = h.reel_candidates(g, labels).orderBy("reel_pos").collect()
    assert [r.clip for r in out][:3] == ["shot_005", "shot_001", "shot_002"] and len(out) == 11
    assert h.reel_candidates(g, labels, minimum=1).count() == 1


def test_spread(spark):
    """Three windows of five minutes take turns, best first, two each at most before the rest fills up."""
    at = {"p": 20.0, "q": 40.0, "r": 310.0, "s": 330.0, "t": 350.0, "u": 900.0}
    order = ["r", "u", "s", "t", "p", "q"]
    d = spark.createDataFrame([("day", "cam", k, i + 1, at[k]) for i, k in enumerate(order)], "session string, video string, clip string, pos long, at_s double")
    rows = h.spread_picks(d, 300.0, 5, per_window=2).orderBy("pick_pos").collect()
    got = [r.clip for r in rows]
    assert len(got) == 5 and set(got) == {"p", "q", "r", "s", "u"}
    first = {w: next(i for i, k in enumerate(got) if at[k] // 300 == w) for w in (0, 1, 3)}
    assert sorted(first.values()) == [0, 1, 2]
    assert all(got.index(a) < got.index(b) for a, b in (("r", "s"), ("p", "q")))


def test_session_times(spark):
    """Two dated recordings half an hour apart; one without a date follows them all."""
    early, late = "CAM_20250312083000_0007_X", "CAM_20250312090000_0008_X"
    g = spark.createDataFrame([("m", early, "shot_004"), ("m", late, "shot_002")], "session string, video string, clip string")
    firsts = spark.createDataFrame([(early, 4, 52_500), (late, 2, 1_250)], "video string, shot_no long, first_ms long")
    got = {r.video: r.at_s for r in h.session_times(g, firsts).collect()}
    assert got == {early: 52.5, late: 1801.25}


def test_title(spark):
    d = spark.createDataFrame([("s", "DJI_20269999_x"), ("s", "DJI_20261017101500_0001_D"), ("t", "camera")], "session string, video string")
    got = {r.session: (r.title, r.subtitle) for r in h.session_title(d).collect()}
    assert got == {"s": ("SATURDAY RUN", "17 Oct 2026"), "t": ("HIGHLIGHTS", "t")}


def test_no_two_slow_effects(spark):
    g = ranked(spark, 300)
    none = spark.createDataFrame([], "video string, clip string, label string, stars int, source string")
    cand = h.reel_candidates(g, none).selectExpr("*", "5.0D AS make")
    rim = spark.createDataFrame([("v", 10.0, 10.0, 30.0, 20.0, 100, 50)], "video string, x1 double, y1 double, x2 double, y2 double, w int, h int")
    seen = set()
    for seed in range(3):
        out = h.reel_edit_list(cand, rim, "top_plays", seed, count=120).orderBy("position").collect()
        effects = [r.effect for r in out]
        assert len(effects) == 120 and (out[0].rim_x, out[0].rim_y) == (20.0, 30.0)
        assert not any(a in h.SLOW_EFFECTS and b in h.SLOW_EFFECTS for a, b in zip(effects, effects[1:]))
        seen |= set(effects)
    assert seen == {e for e, _ in h.VARIANTS["top_plays"]["effects"]}
    last = h.reel_edit_list(cand, rim, "countdown", 1).orderBy("position").collect()
    assert len(last) == 10 and last[-1].effect == "zoom_replay" and last[-1].clip == "shot_000"
