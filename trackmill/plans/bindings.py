"""Projections of the driver's tables onto the library's inputs, in Spark and in SQL.

The tables hold no boxes or clips, so each binding is a documented stand-in that
keeps every row of its source table. Times are BIGINT milliseconds; track
coordinates are in 1/10000 of the frame so both engines stay on exact numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackmill.functions.geometry import Box, box
from trackmill.ordered import with_ordinal
from trackmill.plans.registry import table
from trackmill.session import cut_lineage



def hoop() -> Box:
    return box(4000, 3000, 5000, 3500)


HOUR_MS = 3_600_000
MATCH_TOL_MS = 6 * HOUR_MS

# independent of the session's time zone
TS_MS = (
    "datediff({0}, DATE'1970-01-01') * 86400000L + hour({0}) * 3600000L + minute({0}) * 60000L"
    " + CAST(floor(extract(SECOND FROM {0}) * 1000) AS BIGINT)"
)


def ts_ms(c: str):
    return F.expr(TS_MS.format(c))


def track(spark: SparkSession, d: str, recordings: int | None = None) -> DataFrame:
    """events -> one point per frame of a recording (= user, or user modulo the number of recordings)."""
    ev = table(spark, d, "events").select("user_id", "ts", "event_id", "event_type", "value", "props")
    if recordings:
        ev = ev.withColumn("user_id", F.col("user_id") % recordings)
    ev = with_ordinal(ev, ["user_id"], F.datediff(F.col("ts"), F.lit("1970-01-01").cast("date")).cast("bigint"),
                      ["ts", "event_id"], "n")
    seen = F.col("event_type") != "error"
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("bigint")
    return ev.select(
        F.col("user_id").alias("video_id"),
        (F.col("n") - 1).cast("bigint").alias("frame_idx"),
        (67 * (F.col("n") - 1)).cast("bigint").alias("t_ms"),
        F.when(seen, (3300 + 25 * k).cast("double")).alias("cx"),
        F.when(seen, (2500 + F.round(F.col("value") * 100).cast("bigint") % 2000).cast("double")).alias("cy"),
    )


TRACK = """track AS (
  SELECT user_id AS video_id, n - 1 AS frame_idx, 67 * (n - 1) AS t_ms,
         CASE WHEN seen THEN CAST(3300 + 25 * CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS DOUBLE) END AS cx,
         CASE WHEN seen THEN CAST(2500 + CAST(round(value * 100) AS BIGINT) % 2000 AS DOUBLE) END AS cy
  FROM (SELECT *, event_type <> 'error' AS seen,
               row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events))"""

SIGHTED = TRACK + """, marked AS (
  SELECT *, CASE WHEN cx IS NULL THEN NULL
                 WHEN cx NOT BETWEEN 3400 AND 5600 THEN -1
                 WHEN cy >= 1750 AND cy < 3000 THEN t_ms END AS mk FROM track),
sighted AS (
  SELECT *, nullif(last_value(mk IGNORE NULLS) OVER (PARTITION BY video_id ORDER BY t_ms), -1) AS above_ms FROM marked)"""


def stored_track(spark: SparkSession, d: str, recordings: int | None = None) -> DataFrame:
    """The track as the table an earlier stage would have left, for queries that read it more than once."""
    return cut_lineage(track(spark, d, recordings))


def timed(spark: SparkSession, d: str, kind: str) -> DataFrame:
    """events of one type -> (video_id, t_ms)."""
    ev = table(spark, d, "events").where(F.col("event_type") == kind)
    return ev.select(F.col("user_id").alias("video_id"), ts_ms("ts").alias("t_ms"))


TIMED = "timed AS (SELECT user_id AS video_id, event_type, epoch_us(ts) // 1000 AS t_ms FROM events)"
CLUSTERED = TIMED + """, clustered AS (
  SELECT video_id, t_ms, CAST(sum(brk) OVER (PARTITION BY video_id ORDER BY t_ms) AS BIGINT) AS shot_no
  FROM (SELECT *, CASE WHEN t_ms - lag(t_ms) OVER (PARTITION BY video_id ORDER BY t_ms) < 21600000 THEN 0 ELSE 1 END AS brk
        FROM timed WHERE event_type = 'purchase'))"""


def candidates(spark: SparkSession, d: str) -> DataFrame:
    """lineitem -> several scored boxes per frame; every 8th supplier is one fixed spot."""
    li = table(spark, d, "lineitem")
    return li.select(
        (F.col("l_orderkey") % 10).alias("video_id"),
        F.expr("l_orderkey div 10").alias("frame_idx"),
        F.col("l_discount").alias("conf"),
        "l_extendedprice", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate",
        F.when(F.col("l_suppkey") % 8 == 0, F.lit(0).cast("bigint"))
        .otherwise(1 + (F.col("l_partkey") % 2000) * 10 + F.col("l_suppkey") % 10).alias("cell"),
    )


def candidate_order():
    return [
        F.desc("conf"), F.desc("l_extendedprice"), F.asc("l_partkey"), F.asc("l_suppkey"),
        F.asc("l_linenumber"), F.asc("l_shipdate"),
    ]


CANDIDATE_ORDER_SQL = "conf DESC, l_extendedprice DESC, l_partkey, l_suppkey, l_linenumber, l_shipdate"
CANDIDATES = """cand AS (
  SELECT l_orderkey % 10 AS video_id, l_orderkey // 10 AS frame_idx, l_discount AS conf,
         l_extendedprice, l_partkey, l_suppkey, l_linenumber, l_shipdate,
         CASE WHEN l_suppkey % 8 = 0 THEN 0 ELSE 1 + (l_partkey % 2000) * 10 + l_suppkey % 10 END AS cell
  FROM lineitem),
spine AS (SELECT o_orderkey % 10 AS video_id, o_orderkey // 10 AS frame_idx FROM orders)"""


def spine(spark: SparkSession, d: str) -> DataFrame:
    """orders -> every sampled frame, with or without candidates."""
    return table(spark, d, "orders").select(
        (F.col("o_orderkey") % 10).alias("video_id"), F.expr("o_orderkey div 10").alias("frame_idx")
    )


def clips(spark: SparkSession, d: str) -> DataFrame:
    """documents + labels -> scored, partly labelled clips of a recording (= source)."""
    doc = table(spark, d, "documents").select("doc_id", "source", "lang", "n_chars")
    lab = table(spark, d, "labels")
    return doc.join(lab, "doc_id", "left").select(
        F.col("source").alias("video"),
        F.col("doc_id").alias("clip"),
        F.when(F.col("quality") == 1, "goal").when(F.col("quality") == 0, "no_goal").alias("label"),
        F.when(F.col("toxic") == 1, "ai").alias("source"),
        ((F.col("n_chars") * 7919 + F.col("doc_id") * 31) % 1009 / 1009).alias("score"),
        F.when(F.col("quality") == 1, (F.col("doc_id") % 6).cast("int")).alias("stars0"),
        F.concat(F.lit("P "), (F.col("doc_id") % 7).cast("string")).alias("player"),
        "lang", "n_chars",
    ).withColumn("stars", F.nullif("stars0", F.lit(0))).drop("stars0")


CLIPS = """clips AS (
  SELECT d.source AS video, d.doc_id AS clip,
         CASE l.quality WHEN 1 THEN 'goal' WHEN 0 THEN 'no_goal' END AS label,
         CASE WHEN l.toxic = 1 THEN 'ai' END AS source,
         CAST((d.n_chars * 7919 + d.doc_id * 31) % 1009 AS DOUBLE) / 1009 AS score,
         CASE WHEN l.quality = 1 THEN nullif(d.doc_id % 6, 0) END AS stars,
         'P ' || (d.doc_id % 7) AS player, d.lang, d.n_chars
  FROM documents d LEFT JOIN labels l USING (doc_id))"""


def embeddings(spark: SparkSession, d: str) -> DataFrame:
    """embeddings with 4.0 added to the label's component, so labels separate."""
    e = table(spark, d, "embeddings")
    return e.select(
        (F.col("vec_id") % 3).alias("session"), F.col("vec_id").alias("clip"), "label",
        F.concat(F.lit("P"), F.col("label").cast("string")).alias("name"),
        F.transform(
            "embedding", lambda x, i: x.cast("double") + F.when(i == F.col("label"), 4.0).otherwise(0.0)
        ).alias("emb"),
    )


EMBEDDINGS = """emb AS (
  SELECT vec_id % 3 AS session, vec_id AS clip, label, 'P' || label AS name, i AS pos,
         CAST(embedding[i + 1] AS DOUBLE) + CASE WHEN i = label THEN 4.0 ELSE 0.0 END AS x
  FROM embeddings, range(64) r(i)),
unit AS (SELECT *, x / (sqrt(sum(x * x) OVER (PARTITION BY clip)) + 1e-9) AS u FROM emb)"""
