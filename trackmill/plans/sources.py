"""Queries that write trees of documents from whole tables and read them back."""

from pyspark.sql import functions as F

from trackmill.plans import bindings as b
from trackmill.plans.files import folder
from trackmill.plans.registry import query, table
from trackmill.plans.tracks import CALIB, calibrations
from trackmill.sources import readers
from trackmill.sources.documents import write_documents


def put(spark, rows, name):
    """Write rows(rel, name, value) below a new folder; its path."""
    path = readers.qualified(spark, folder(spark, name))
    write_documents(rows, path)
    return path


def text(c):
    return F.col(c).cast("string") if isinstance(c, str) else c.cast("string")


@query("read_calibrations", f"""WITH {CALIB} SELECT 'cam ' || video_id AS video_id, CASE WHEN video_id % 4 > 0 THEN video_id * 30 END AS frame_index, w, h,
  round(x1, 6) AS x1, round(y1, 6) AS y1, round(x2, 6) AS x2, round(y2, 6) AS y2 FROM calib""")
def read_calibrations(spark, d):
    """One document per calibrated recording; every fourth has no frame number."""
    c = calibrations(spark, d)
    doc = F.struct(F.when(F.col("video_id") % 4 > 0, F.col("video_id") * 30).alias("frame_index"), F.col("w").alias("frame_width"),
                   F.col("h").alias("frame_height"), F.array("x1", "y1", "x2", "y2").alias("hoop_bbox_norm"))
    rel = F.concat(F.lit("house "), text(F.col("video_id") % 8))
    path = put(spark, c.select(rel.alias("rel"), F.concat(F.lit("cam "), text("video_id"), F.lit(".json")).alias("name"), F.to_json(doc).alias("value")), "calibrations")
    r = readers.read_calibrations(spark, path)
    return r.select("video_id", "frame_index", "w", "h", *[F.round(f"box.{x}", 6).alias(x) for x in ("x1", "y1", "x2", "y2")])


@query("read_event_times", f"""WITH {b.TIMED} SELECT CAST(video_id AS VARCHAR) AS video_id, count(*) AS n, min(t_ms) AS first_ms, max(t_ms) AS last_ms,
  CAST(sum(t_ms % 1000) AS BIGINT) AS ms FROM timed WHERE event_type = 'purchase' GROUP BY 1""")
def read_event_times(spark, d):
    """One document of seconds per recording, half of them bare lists, parsed back to milliseconds."""
    t = b.timed(spark, d, "purchase")
    docs = t.groupBy("video_id").agg(F.to_json(F.collect_list(F.round(F.col("t_ms") / 1000, 3))).alias("times"))
    bare = F.col("video_id") % 2 == 0
    value = F.when(bare, F.col("times")).otherwise(F.concat(F.lit('{"video": "x", "makes_sec": '), F.col("times"), F.lit("}")))
    name = F.concat(text("video_id"), F.when(bare, ".json").otherwise("_detected.json"))
    path = put(spark, docs.select(text(F.col("video_id") % 8).alias("rel"), name.alias("name"), value.alias("value")), "times")
    return readers.read_event_times(spark, path).groupBy("video_id").agg(
        F.count("*").alias("n"), F.min("t_ms").alias("first_ms"), F.max("t_ms").alias("last_ms"), F.sum(F.col("t_ms") % 1000).alias("ms"))


PARTS = "video || '/' || (clip % 40)"


def by_folder(rows, entry, file, wrap=False):
    """(rel, name, value): the clips of each folder as a JSON map."""
    rel = F.concat("video", F.lit("/"), text(F.col("clip") % 40))
    clips = F.map_from_entries(F.collect_list(F.struct(text("clip"), entry)))
    value = F.to_json(F.struct(F.lit("m").alias("method"), clips.alias("clips"))) if wrap else F.to_json(clips)
    return rows.groupBy(rel.alias("rel")).agg(value.alias("value")).withColumn("name", F.lit(file))


@query("read_scores", f"""WITH {b.CLIPS} SELECT 'prelabel' AS kind, {PARTS} AS video, CAST(clip AS VARCHAR) AS clip, round(score, 9) AS score FROM clips""")
def read_scores(spark, d):
    """One map of scores per folder of clips, below the recording's folder."""
    path = put(spark, by_folder(b.clips(spark, d), F.col("score"), "_prelabel_scores.json"), "scores")
    return readers.read_scores(spark, path, "prelabel").withColumn("score", F.round("score", 9))


@query("read_suggestions", f"""WITH {b.CLIPS}, f AS (SELECT *, {PARTS} AS folder FROM clips)
SELECT folder AS video, count(*) FILTER (score >= 0.6) AS n, count(*) FILTER (score >= 0.9) AS n_reel, CAST(coalesce(sum(stars) FILTER (score >= 0.6), 0) AS BIGINT) AS stars,
  count(*) FILTER (score >= 0.6 AND clip % 2 = 0) AS named FROM f GROUP BY 1""")
def read_suggestions(spark, d):
    """Suggestions of the likely goals of each folder; folders without any still count as rated."""
    c = b.clips(spark, d)
    entry = F.struct(F.col("stars").alias("stars"), F.when(F.col("score") >= 0.9, True).alias("reel"), F.when(F.col("clip") % 2 == 0, F.col("player")).alias("scorer"))
    rel = F.concat("video", F.lit("/"), text(F.col("clip") % 40))
    none = c.groupBy(rel.alias("rel")).agg(F.max("score").alias("top")).where("top < 0.6").select("rel", F.lit('{"method": "m", "clips": {}}').alias("value"))
    docs = by_folder(c.where("score >= 0.6"), entry, "_ai_suggestions.json", wrap=True)
    path = put(spark, docs.unionByName(none.withColumn("name", F.lit("_ai_suggestions.json"))), "suggestions")
    rows, rated = readers.read_suggestions(spark, path)
    g = rows.groupBy("video").agg(F.count("*").alias("n"), F.count_if("reel").alias("n_reel"), F.sum("stars").alias("stars"), F.count("scorer").alias("named"))
    return rated.join(g, "video", "left").na.fill(0)


@query("read_players", f"""WITH {b.CLIPS} SELECT lang AS session, lang || '-' || (clip % 9) AS "group", {PARTS} AS video, CAST(clip AS VARCHAR) AS clip,
  CASE WHEN clip % 4 = 0 THEN player END AS suggested, CASE WHEN clip % 4 = 0 THEN 'gallery' END AS suggested_how, round(score, 9) AS confidence
FROM clips WHERE clip % 5 <> 0""")
def read_players(spark, d):
    """Groups of subjects by clip; every fifth clip belongs to none."""
    named = F.col("clip") % 4 == 0
    group = F.when(F.col("clip") % 5 != 0, F.concat("lang", F.lit("-"), text(F.col("clip") % 9)))
    entry = F.struct(group.alias("group"), F.when(named, F.col("player")).alias("suggested"), F.when(named, F.lit("gallery")).alias("suggested_how"), F.col("score").alias("confidence"))
    path = put(spark, by_folder(b.clips(spark, d), entry, "_players.json", wrap=True), "players")
    return readers.read_players(spark, path).withColumn("confidence", F.round("confidence", 9))


@query("read_labels", f"""WITH {b.CLIPS} SELECT video, CAST(clip AS VARCHAR) || '.mp4' AS clip, label, stars, source FROM clips WHERE label IS NOT NULL""")
def read_labels(spark, d):
    """Label documents, the labelled clips dealt over them."""
    c = b.clips(spark, d).where("label is not null")
    key = F.concat("video", F.lit("/"), text("clip"), F.lit(".mp4"))
    docs = c.groupBy((F.col("clip") % 16).alias("n")).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(key, F.struct("label", "stars", "source"))))).alias("value"))
    path = put(spark, docs.select(F.lit("").alias("rel"), F.concat(F.lit("labels "), text("n"), F.lit(".json")).alias("name"), "value"), "labels")
    return readers.read_labels(spark, path).select("video", "clip", "label", "stars", "source")


@query("read_gallery", f"""WITH {b.EMBEDDINGS} SELECT CAST(clip AS VARCHAR) AS key, CAST(any_value(session) AS VARCHAR) AS session, any_value(name) AS name, round(sum(x * (pos + 1)), 6) AS total
FROM emb GROUP BY clip""")
def read_gallery(spark, d):
    """JSON lines by session and part; an older line of every third key comes first and loses."""
    e = b.embeddings(spark, d)
    line = lambda name, old: F.struct(F.lit(old).alias("o"), F.to_json(F.struct(text("clip").alias("key"), text("session").alias("session"), name.alias("name"), F.col("emb").alias("emb"))).alias("l"))
    rows = e.select("session", "clip", line(F.col("name"), 1).alias("line")).unionByName(e.where("clip % 3 = 0").select("session", "clip", line(F.lit("old"), 0).alias("line")))
    docs = rows.groupBy("session", (F.col("clip") % 40).alias("part")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("line")), lambda x: x["l"]), "\n").alias("value"))
    path = put(spark, docs.select(text("session").alias("rel"), F.concat(text("part"), F.lit(".jsonl")).alias("name"), "value"), "gallery")
    g = readers.read_gallery(spark, f"{path}/*")
    total = F.aggregate(F.transform("emb", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return g.select("key", "session", "name", F.round(total, 6).alias("total"))


@query("media_inventory", """SELECT 'user_' || (s_nationkey % 7) AS owner, (20260101 + s_suppkey % 20) || '/clip ' || s_suppkey || '.mp4' AS path,
  'clip ' || s_suppkey || '.mp4' AS name, 1 + s_suppkey % 83 AS size FROM supplier WHERE s_suppkey % 6 > 0""")
def media_inventory(spark, d):
    """One stored file per supplier; every sixth is not a media file."""
    k = F.col("s_suppkey")
    rel = F.concat(F.lit("user_"), text(F.col("s_nationkey") % 7), F.lit("/"), text(20260101 + k % 20))
    name = F.concat(F.lit("clip "), text(k), F.when(k % 6 > 0, ".mp4").otherwise(".txt"))
    path = put(spark, table(spark, d, "supplier").select(rel.alias("rel"), name.alias("name"), F.expr("repeat('x', CAST(1 + s_suppkey % 83 AS INT))").alias("value")), "media")
    return readers.media_inventory(spark, path).drop("mtime")
