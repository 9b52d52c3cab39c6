"""Queries that write a contract, read it back and report what came through."""

import uuid

from pyspark.sql import functions as F

from trackmill.plans import bindings as b
from trackmill.plans.labels import view_parts
from trackmill.plans.registry import query
from trackmill.plans.selection import STARRED, starred
from trackmill.session import shared_folder
from trackmill.sources import writers


def folder(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("write_scores", f"""WITH {b.CLIPS} SELECT video, count(*) AS n_rows, round(sum(score), 6) AS total FROM clips GROUP BY 1""")
def write_scores(spark, d):
    """All scores by recording, written and read back."""
    c = b.clips(spark, d)
    path = folder(spark, "scores")
    writers.write_scores(c.select("video", "clip", "score"), c, path, "v1", "video")
    scores, done = writers.read_current(spark, path, "video")
    n = scores.groupBy("video").agg(F.round(F.sum("score"), 6).alias("total"))
    return done.join(n, "video", "left").select("video", "n_rows", F.coalesce("total", F.lit(0.0)).alias("total"))


@query("replace_video_outputs", f"""WITH {b.CLIPS} SELECT video, count(*) AS n, CAST(sum(clip) AS BIGINT) AS clips FROM clips
WHERE CAST(substr(video, 4) AS BIGINT) % 2 = 0 OR clip % 3 = 0 GROUP BY 1""")
def replace_video_outputs(spark, d):
    """A second run over odd recordings replaces only theirs, also where it finds nothing."""
    c = b.clips(spark, d).select("video", "clip", "score")
    path = folder(spark, "replace")
    writers.write_scores(c, c, path, "v1", "video")
    again = c.where(F.substring("video", 4, 20).cast("bigint") % 2 == 1)
    writers.write_scores(again.where("clip % 3 = 0"), again, path, "v1", "video")
    rows, _ = writers.read_current(spark, path, "video")
    return rows.groupBy("video").agg(F.count("*").alias("n"), F.sum("clip").alias("clips"))


@query("compact_outputs", f"""WITH {b.CLIPS}, kept AS (SELECT video, clip FROM clips
  WHERE CASE CAST(substr(video, 4) AS BIGINT) % 3 WHEN 0 THEN clip % 2 = 0 WHEN 1 THEN clip % 4 = 1 ELSE true END)
SELECT video, count(*) AS n, CAST(sum(clip) AS BIGINT) AS clips FROM kept GROUP BY 1""")
def compact_outputs(spark, d):
    """Runs over all, over some before and over others after a compaction, then compacted again: what is current stays."""
    c = b.clips(spark, d).select("video", "clip", "score")
    n = F.substring("video", 4, 20).cast("bigint") % 3
    path = folder(spark, "compact")
    writers.write_scores(c, c, path, "v1", "video")
    writers.write_scores(c.where((n == 0) & (F.col("clip") % 2 == 0)), c.where(n == 0), path, "v1", "video")
    writers.compact(spark, path, "video")
    writers.write_scores(c.where((n == 1) & (F.col("clip") % 4 == 1)), c.where(n == 1), path, "v1", "video")
    writers.compact(spark, path, "video")
    rows, _ = writers.read_current(spark, path, "video")
    return rows.groupBy("video").agg(F.count("*").alias("n"), F.sum("clip").alias("clips"))


@query("write_ranked_csv", f"""WITH {STARRED} SELECT session, pos, clip, stars, round(ai_score, 3) AS ai_score FROM starred""")
def write_ranked_csv(spark, d):
    path = folder(spark, "csv")
    r = starred(spark, d).select("session", "pos", "clip", "stars", F.round("ai_score", 3).alias("ai_score"))
    writers.write_ranked_csv(r, path, r.columns, "pos")
    return spark.read.option("header", "true").schema(r.schema).csv(path)


@query("write_dataset", f"""WITH {b.CLIPS} SELECT label, CASE WHEN label = 'goal' THEN coalesce(stars || 'star', 'unrated') END AS star_bin, count(*) AS n
FROM clips WHERE label IS NOT NULL GROUP BY 1, 2""")
def write_dataset(spark, d):
    from trackmill.operators.labels import dataset_manifest

    p = view_parts(spark, d)
    path = folder(spark, "dataset")
    writers.write_dataset(dataset_manifest(p["labels"], p["clips"], by_stars=True), path)
    return spark.read.parquet(path).groupBy("label", "star_bin").agg(F.count("*").alias("n"))
