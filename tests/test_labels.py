import random

from pyspark.sql import functions as F

from trackmill.functions import strings as st
from trackmill.operators import labels as lab
from trackmill.operators import ops
from trackmill.streaming.labels import FIELDS, apply_action

ACTIONS = "clip long, ts long, seq long, action string, label string, stars long, scorer string, assist string, source string"


def fold(spark, rows):
    return {r.clip: r for r in lab.fold_label_actions(spark.createDataFrame(rows, ACTIONS)).collect()}


def test_random_actions_match_replay(spark):
    rnd = random.Random(4)
    rows = []
    for i in range(1500):
        kind = rnd.choice(["label", "label", "bulk", "star", "scorer", "assist", "name_group", "delete", "label"])
        label = rnd.choice(["goal", "goal", "no_goal", None, "bad"]) if kind in ("label", "bulk") else None
        stars = rnd.choice([None, 1, 5, 6]) if kind == "star" or (kind == "label" and rnd.random() < 0.3) else None
        name = rnd.choice([" Al ", "Bo", " ", None])
        scorer = name if kind in ("scorer", "name_group") or (kind == "label" and rnd.random() < 0.3) else None
        rows.append((0 if rnd.random() < 0.3 else rnd.randrange(1, 60), i // 3, i, kind, label, stars, scorer,
                     name if kind == "assist" else None, rnd.choice([None, "ai"]) if kind == "bulk" else None))
    state = {}
    valid = lab.valid_actions(spark.createDataFrame(rows, ACTIONS)).select("*", "ord.seq").orderBy("ord").collect()
    assert 0 < len(valid) < len(rows)
    for a in valid:
        state[a.clip] = apply_action(state.get(a.clip, {}), a.asDict())
    want = {c: tuple(e.get(f) for f in FIELDS) for c, e in state.items() if e}
    got = {c: tuple(r[f] for f in FIELDS) for c, r in fold(spark, rows).items()}
    assert got == want and len(want) > 20


def test_rules(spark):
    row = lambda c, t, a, label=None, stars=None, scorer=None, source=None: (c, t, t, a, label, stars, scorer, None, source)
    got = fold(spark, [
        row(1, 1, "label", "goal"), row(1, 2, "bulk", "no_goal", source="ai"), row(2, 2, "bulk", "no_goal", source="ai"),
        row(3, 1, "bulk", "no_goal", source="ai"), row(3, 2, "label", "goal"),
        row(4, 1, "label", "goal", stars=4, scorer=" Alice "),
        row(5, 1, "name_group", scorer="Bo"), row(6, 1, "label", "no_goal"), row(6, 2, "name_group", scorer="Bo"),
        row(7, 1, "name_group", scorer="Bo"), row(7, 2, "star", stars=3), row(8, 1, "label", "goal", stars=9), row(9, 1, "star", stars=3),
    ])
    assert (got[1].label, got[1].source) == ("goal", None) and (got[2].label, got[2].source) == ("no_goal", "ai")
    assert (got[3].label, got[3].source) == ("goal", None)
    assert (got[4].stars, got[4].scorer, got[4].rated_at) == (4, "Alice", 1)
    assert (got[5].label, got[5].source, got[5].scorer) == ("goal", "ai", "Bo")
    assert (got[6].label, got[6].scorer) == ("no_goal", None)
    assert (got[7].source, got[7].stars) == ("ai", 3) and 8 not in got and 9 not in got


def test_goal_selection(spark):
    clips = spark.createDataFrame([("v", f"shot_00{i}") for i in range(1, 5)], "video string, clip string")
    labels = spark.createDataFrame([("v", "shot_001", "goal"), ("v", "shot_002", "no_goal")], "video string, clip string, label string")
    scores = spark.createDataFrame([("v", "shot_003", 0.7), ("v", "shot_004", 0.3)], "video string, clip string, score double")
    pick = lambda a, b: sorted(r.clip for r in lab.goal_clips(clips, a, b).collect())
    assert pick(labels, scores) == ["shot_001", "shot_003"]
    assert len(pick(labels.where("false"), scores.where("false"))) == 4


def test_names(spark):
    d = spark.createDataFrame([("Alice", "Alice"), ("Alice B.", "AliceB."), ("李明", "李明"), ("a/b\\c", "abc"), ("   ", "player")], "n string, want string")
    assert d.where(st.scorer_slug(F.col("n")) != F.col("want")).count() == 0
    r = lab.merge_rosters(spark.createDataFrame([(" Bob ",), ("alice",), ("",), ("Bob",)], "name string"))
    assert [x.name for x in r.collect()] == ["alice", "Bob"]
    p = spark.createDataFrame([("goal", "cam/v1", "shot_012", 5, "Alice B"), ("goal", "v1", "shot_1", None, None), ("no_goal", "v1", "shot_2", 4, "Al")],
                              "label string, video string, clip string, stars int, scorer string")
    args = [F.col(c) for c in p.columns]
    flat = [x[0] for x in p.select(lab.export_path(*args, False)).collect()]
    grouped = [x[0] for x in p.select(lab.export_path(*args, True)).collect()]
    assert flat == ["cam__v1__shot_012_5star_AliceB", "v1__shot_1", "v1__shot_2"]
    assert grouped == ["AliceB/cam__v1__shot_012_5star", "_no_scorer/v1__shot_1", "_no_scorer/v1__shot_2"]
    s = spark.createDataFrame([("a_3star",), ("a_star",), ("3star_b",)], "stem string")
    assert [x[0] for x in s.select(st.star_from_name(F.col("stem"))).collect()] == [3, None, None]


def test_sheet_sections(spark):
    d = spark.createDataFrame([(s, "x") for s in ("zeta", "1star", "5star", "alpha", "3star")], "section string, stem string")
    assert [r.section for r in lab.sheet_order(d).orderBy("section_key", "section").collect()] == ["5star", "3star", "1star", "alpha", "zeta"]


def test_jobs(spark):
    now = 10_000
    jobs = spark.createDataFrame([(1, "running", None, 0), (2, "running", None, 0), (3, "running", None, 0), (4, "done", None, 0)],
                                 "id int, state string, message string, created_at long")
    signs = spark.createDataFrame([(1, now - 600), (2, now - 600), (2, now - 5), (4, now - 900)], "id int, at long")
    got = {r.id: (r.state, r.message) for r in ops.stale_jobs(jobs, signs, now).collect()}
    assert got == {1: ("error", "interrupted"), 2: ("running", None), 3: ("running", None), 4: ("done", None)}
    q = spark.createDataFrame([(1, "queued", "u", now - 960), (2, "queued", "u", now - 30)], "id int, state string, user string, created_at long")
    assert [(r.id, r.minutes) for r in ops.stuck_jobs(q, now).collect()] == [(1, 16)]
    assert ops.stuck_jobs(q, now, q.where("id = 1")).count() == 0
    busy = q.unionByName(spark.createDataFrame([(3, "running", "u", now)], q.schema))
    assert ops.stuck_jobs(busy, now).count() == 0


def test_retention_stops_at_cap(spark):
    f = spark.createDataFrame([(i, f"p{i}", 10) for i in range(10)], "mtime int, path string, size long")
    assert sorted(r.path for r in ops.retention_victims(f, 70).collect()) == ["p0", "p1", "p2"]
    assert ops.retention_victims(f, 100).count() == 0


def test_exclude_unknown(spark):
    import pytest

    d = spark.createDataFrame([("a",), ("b",)], "video_id string")
    assert [r[0] for r in ops.exclude_videos(d, d.where("video_id = 'a'")).collect()] == ["b"]
    with pytest.raises(ValueError, match="zz"):
        ops.exclude_videos(d, spark.createDataFrame([("zz",)], "video_id string"))
