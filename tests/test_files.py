import json
import os

from trackmill.sources import readers as rd
from trackmill.sources import writers as wr


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_readers(spark, tmp_path):
    put(tmp_path / "cfg/cam A.json", json.dumps({"video": "x.mp4", "frame_width": 1920, "frame_height": 1080, "hoop_bbox_norm": [0.1, 0.2, 0.3, 0.4]}, indent=1))
    put(tmp_path / "cfg/b.json", json.dumps({"frame_index": 7, "frame_width": 10, "frame_height": 10, "hoop_bbox_norm": [0, 0, 1, 1]}))
    c = {r.video_id: r for r in rd.read_calibrations(spark, str(tmp_path / "cfg")).collect()}
    assert c["cam A"].frame_index is None and tuple(c["cam A"].box) == (0.1, 0.2, 0.3, 0.4) and c["b"].frame_index == 7

    put(tmp_path / "gt/v1_detected.json", json.dumps({"video": "v1", "makes_sec": [1.25, 30.1]}, indent=2))
    put(tmp_path / "gt/v2.json", "[2, 3.005]")
    put(tmp_path / "gt/v3.json", "{}")
    t = rd.read_event_times(spark, str(tmp_path / "gt")).orderBy("video_id", "i").collect()
    assert [(r.video_id, r.t_ms) for r in t] == [("v1", 1250), ("v1", 30100), ("v2", 2000), ("v2", 3005)]

    put(tmp_path / "clips/v1/_prelabel_scores.json", json.dumps({"shot_001.mp4": 0.5, "shot_002.mp4": 1}, indent=1))
    put(tmp_path / "clips/v2/_prelabel_scores.json", "{broken")
    put(tmp_path / "clips/v1/_filter_scores.json", json.dumps({"shot_001.mp4": 0.1}))
    s = rd.read_scores(spark, str(tmp_path / "clips"), "prelabel").collect()
    assert sorted((r.video, r.clip, r.score) for r in s) == [("v1", "shot_001.mp4", 0.5), ("v1", "shot_002.mp4", 1.0)]

    for i, video in enumerate(("ann/v1", "bob/v1", "bob/20260101/v 1", "bob/20260101/deep/er/v1")):
        put(tmp_path / "many" / video / "_prelabel_scores.json", json.dumps({"shot_001.mp4": i / 10}))
    s = rd.read_scores(spark, str(tmp_path / "many"), "prelabel").collect()
    assert sorted((r.video, r.score) for r in s) == [("ann/v1", 0.0), ("bob/20260101/deep/er/v1", 0.3), ("bob/20260101/v 1", 0.2), ("bob/v1", 0.1)]

    put(tmp_path / "many/ann/v1/_ai_suggestions.json", json.dumps({"method": "m", "clips": {"shot_001.mp4": {"stars": 4, "reel": True, "scorer": "Al"}, "s2.mp4": {"stars": 2}}}))
    put(tmp_path / "many/bob/v1/_ai_suggestions.json", json.dumps({"method": "m", "clips": {}}))
    put(tmp_path / "many/bob/20260101/v 1/_ai_suggestions.json", "[")
    s, rated = rd.read_suggestions(spark, str(tmp_path / "many"))
    assert sorted(tuple(r) for r in s.collect()) == [("ann/v1", "s2.mp4", 2, False, None), ("ann/v1", "shot_001.mp4", 4, True, "Al")]
    assert sorted(r.video for r in rated.collect()) == ["ann/v1", "bob/v1"]
    put(tmp_path / "many/ann/v1/_players.json", json.dumps({"clips": {"a.mp4": {"group": "day-1-3", "suggested": "Al", "confidence": 0.5}, "b.mp4": {"group": None}, "c.mp4": {}}}))
    assert [tuple(r) for r in rd.read_players(spark, str(tmp_path / "many")).collect()] == [("day-1", "day-1-3", "ann/v1", "a.mp4", "Al", None, 0.5)]

    put(tmp_path / "labels/labels.json", json.dumps({"me/v1/shot_1.mp4": {"label": "goal", "stars": 4}, "v2/shot_2.mp4": {"label": "no_goal", "source": "ai"}}, indent=2))
    lb = {r.video: r for r in rd.read_labels(spark, str(tmp_path / "labels")).collect()}
    assert (lb["me/v1"].clip, lb["me/v1"].stars, lb["v2"].source) == ("shot_1.mp4", 4, "ai")

    put(tmp_path / "gallery.jsonl", "\n".join(json.dumps({"key": k, "session": "s", "name": n, "emb": [1.0]}) for k, n in (("a", "old"), ("b", "x"), ("a", "new"))))
    assert {r.key: r.name for r in rd.read_gallery(spark, str(tmp_path / "gallery.jsonl")).collect()} == {"a": "new", "b": "x"}

    for rel in ("media/ann/20260101/a.mp4", "media/ann/20260102/b.MOV", "media/bob/20260101/a.mp4", "media/bob/x.txt", "media/ann/media/x y/a.mp4"):
        put(tmp_path / rel, "12345")
    inv = rd.media_inventory(spark, str(tmp_path / "media")).collect()
    assert sorted((r.owner, r.path, r.name, r.size) for r in inv) == [
        ("ann", "20260101/a.mp4", "a.mp4", 5), ("ann", "20260102/b.MOV", "b.MOV", 5), ("ann", "media/x y/a.mp4", "a.mp4", 5), ("bob", "20260101/a.mp4", "a.mp4", 5)]


def test_writers(spark, tmp_path):
    schema = "video_id string, clip string, score double"
    first = spark.createDataFrame([("a", "1", 0.1), ("a", "2", 0.2), ("b", "1", 0.3), ("c", "1", 0.4)], schema)
    vids = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "video_id string")
    out = str(tmp_path / "out")
    wr.write_scores(first, vids, out, "m1")
    wr.write_scores(spark.createDataFrame([("a", "9", 0.9)], schema), vids.where("video_id in ('a', 'b')"), out, "m1")
    scores, done = wr.read_current(spark, out)
    assert sorted((r.video_id, r.clip) for r in scores.collect()) == [("a", "9"), ("c", "1")]
    assert {r.video_id: r.n_rows for r in done.collect()} == {"a": 1, "b": 0, "c": 1, "d": 0}
    before = sorted(map(tuple, scores.collect())), sorted(map(tuple, done.collect()))
    for _ in range(2):  # the second time there is nothing to do
        wr.compact(spark, out)
        assert [n for n in os.listdir(tmp_path / "out/rows") if n.startswith("run=")] == [] and len(os.listdir(tmp_path / "out/bases")) <= 2
        scores, done = wr.read_current(spark, out)
        assert (sorted(map(tuple, scores.select("video_id", "clip", "score").collect())), sorted(map(tuple, done.collect()))) == before
    # an unfinished base counts for nothing, and a later run replaces what the base holds
    (tmp_path / "out/base-9999999999999999999").mkdir()
    wr.write_scores(spark.createDataFrame([("c", "7", 0.7)], schema), vids.where("video_id in ('c', 'a')"), out, "m1")
    assert sorted((r.video_id, r.clip) for r in wr.read_current(spark, out)[0].collect()) == [("c", "7")]
    wr.compact(spark, out)
    assert sorted((r.video_id, r.clip) for r in wr.read_current(spark, out)[0].collect()) == [("c", "7")]
    assert {r.video_id: r.n_rows for r in wr.read_current(spark, out)[1].collect()} == {"a": 0, "b": 0, "c": 1, "d": 0}
    goals = spark.createDataFrame([("a", "1", 5), ("a", "2", 3)], "video string, clip string, stars int")
    names = spark.createDataFrame([("a", "2", "Al"), ("a", "1", None)], "video string, clip string, suggested string")
    wr.write_suggestions(goals, goals.limit(1), names, vids.withColumnRenamed("video_id", "video"), str(tmp_path / "sug"))
    rows, rated = wr.read_current(spark, str(tmp_path / "sug"), "video")
    assert sorted(tuple(r) for r in rows.select("video", "clip", "stars", "reel", "scorer").collect()) == [("a", "1", 5, True, None), ("a", "2", 3, False, "Al")]
    assert rated.count() == 4
    ranked = spark.createDataFrame([(i, f"c{i}") for i in (3, 1, 2)], "rank int, clip string")
    wr.write_ranked_csv(ranked, str(tmp_path / "csv"), ["rank", "clip"])
    lines = [l for f in sorted(os.listdir(tmp_path / "csv")) if f.endswith(".csv") for l in (tmp_path / "csv" / f).read_text().splitlines()]
    assert [l for l in lines if l != "rank,clip"] == ["1,c1", "2,c2", "3,c3"]


def test_a_folder_is_opened_by_many_tasks(spark, tmp_path):
    """One flat folder; hidden names and folders are not calibrations; nor are the rows of one partition written by one task."""
    from pyspark.sql import functions as F

    from trackmill.sources.documents import read_documents, write_documents

    doc = json.dumps({"frame_width": 10, "frame_height": 10, "hoop_bbox_norm": [0, 0, 1, 1]})
    rows = spark.range(40).coalesce(1).select(F.lit("a").alias("rel"), F.concat(F.lit("c "), "id", F.lit(".json")).alias("name"), F.lit(doc).alias("value"))
    root = rd.qualified(spark, str(tmp_path / "docs"))
    write_documents(rows, root)
    for hidden in ("_b/x.json", "a/_y.json", "a/.z.json"):
        put(tmp_path / "docs" / hidden, doc)
    read = read_documents(spark, root, "*.json")
    assert read.select(F.spark_partition_id().alias("p")).distinct().count() > 1 and read.count() == 43
    c = rd.read_calibrations(spark, str(tmp_path / "docs"))
    assert {r.video_id for r in c.collect()} == {f"c {i}" for i in range(40)} and c.count() == 40
