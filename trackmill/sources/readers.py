"""JSON, JSON-lines and media folders as DataFrames.

One small JSON document per recording is the common layout, so documents are
read whole, one per row, by the text source; parsing stays in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackmill.operators.ops import MEDIA_EXTS
from trackmill.sources.documents import read_documents

LABEL_TYPE = (
    "STRUCT<label: STRING, labeled_at: STRING, stars: INT, rated_at: STRING, scorer: STRING, assist: STRING, source: STRING>"
)


def _documents(spark: SparkSession, path: str, glob: str) -> DataFrame:
    return (
        spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
        .text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value"))
    )


def _hidden_documents(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(rel, value) of documents whose name starts with an underscore, which Spark's own sources never list."""
    return read_documents(spark, qualified(spark, path), name).select("rel", "value")


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme, as file systems report it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()
    return full if "://" in full else full.replace(":/", ":///", 1)


def _part(n: int) -> Column:
    """n-th path part from the end, URL escapes undone."""
    return F.url_decode(F.element_at(F.split("file", "/"), -n))


def _stem() -> Column:
    return F.regexp_replace(_part(1), r"\.[^.]*$", "")


def read_calibrations(spark: SparkSession, path: str) -> DataFrame:
    """(video_id, frame_index, w, h, box): one row per calibration document; frame_index may be null."""
    doc = F.from_json(
        "value", "video STRING, frame_index BIGINT, frame_width INT, frame_height INT, hoop_bbox_norm ARRAY<DOUBLE>"
    )
    hidden = F.concat_ws("/", "rel", "name").rlike("(^|/)[._]")  # as Spark's own sources have it
    d = read_documents(spark, qualified(spark, path), "*.json").where(~hidden)
    d = d.select(F.regexp_replace("name", r"\.[^.]*$", "").alias("video_id"), doc.alias("j"))
    b = F.col("j.hoop_bbox_norm")
    return d.where(F.size(b) == 4).select(
        "video_id", F.col("j.frame_index").alias("frame_index"), F.col("j.frame_width").alias("w"),
        F.col("j.frame_height").alias("h"),
        F.struct(*[F.get(b, F.lit(i)).alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))]).alias("box"),
    )


def parse_event_times(text: Column) -> Column:
    """Milliseconds from {"makes_sec": [seconds]} or a bare list; null when it is neither."""
    sec = F.coalesce(F.from_json(text, "makes_sec ARRAY<DOUBLE>")["makes_sec"], F.from_json(text, "ARRAY<DOUBLE>"))
    return F.transform(sec, lambda s: F.bround(s * 1000).cast("bigint"))


def read_event_times(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """(video_id, i, t_ms), one document per recording."""
    d = _documents(spark, path, glob).select(
        F.regexp_replace(_stem(), "_detected$", "").alias("video_id"), F.posexplode(parse_event_times(F.col("value"))).alias("i", "t_ms")
    )
    return d.select("video_id", "i", "t_ms")


def read_scores(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(kind, video, clip, score) from each folder's _<kind>_scores.json; unreadable files are skipped.

    video is the folder's path relative to `path`, at any depth, so equal names of two accounts stay apart.
    """
    d = _hidden_documents(spark, path, f"_{kind}_scores.json").select(
        F.col("rel").alias("video"), F.explode(F.from_json("value", "MAP<STRING, DOUBLE>")).alias("clip", "score")
    )
    return d.select(F.lit(kind).alias("kind"), "video", "clip", "score").where("score is not null")


SUGGESTION_TYPE = "STRUCT<stars: INT, reel: BOOLEAN, scorer: STRING>"
PLAYER_TYPE = "STRUCT<`group`: STRING, suggested: STRING, suggested_how: STRING, confidence: DOUBLE>"


def _clip_documents(spark: SparkSession, path: str, name: str, entry: str) -> DataFrame:
    """(video, clips): the documents with a map of clips under "clips"; unreadable ones are skipped."""
    d = _hidden_documents(spark, path, name)
    clips = F.from_json("value", f"clips MAP<STRING, {entry}>")["clips"]
    return d.select(F.col("rel").alias("video"), clips.alias("clips")).where("clips is not null")


def read_suggestions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(video, clip, stars, reel, scorer) and the rated recordings (video), those without a suggestion included."""
    d = _clip_documents(spark, path, "_ai_suggestions.json", SUGGESTION_TYPE)
    rows = d.select("video", F.explode("clips").alias("clip", "e"))
    return rows.select("video", "clip", "e.stars", F.coalesce("e.reel", F.lit(False)).alias("reel"), "e.scorer"), d.select("video").distinct()


def read_players(spark: SparkSession, path: str) -> DataFrame:
    """(session, group, video, clip, suggested, suggested_how, confidence) of clips that belong to a group."""
    rows = _clip_documents(spark, path, "_players.json", PLAYER_TYPE).select("video", F.explode("clips").alias("clip", "e"))
    session = F.regexp_replace("e.group", "-[^-]*$", "").alias("session")
    return rows.where("e.group <> ''").select(session, "e.group", "video", "clip", "e.suggested", "e.suggested_how", "e.confidence")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """(video, clip, label, ...) from a JSON map of video/clip -> entry."""
    d = _documents(spark, path, "*.json").select(F.explode(F.from_json("value", f"MAP<STRING, {LABEL_TYPE}>")).alias("key", "e"))
    return d.select(
        F.regexp_replace("key", "/[^/]*$", "").alias("video"), F.element_at(F.split("key", "/"), -1).alias("clip"), "e.*"
    )


def read_gallery(spark: SparkSession, path: str) -> DataFrame:
    """(key, session, name, emb) from JSON lines; a key's last line wins.

    Lines are ordered by file, then split, then position within the split.
    """
    d = spark.read.schema("key STRING, session STRING, name STRING, emb ARRAY<DOUBLE>").json(path)
    at = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id())
    d = d.select("*", at.alias("_line")).where("key is not null")
    return d.groupBy("key").agg(F.max_by(F.struct("session", "name", "emb"), "_line").alias("e")).select("key", "e.*")


def media_inventory(spark: SparkSession, path: str, exts=MEDIA_EXTS) -> DataFrame:
    """(owner, path, name, size, mtime) of media below <path>/<owner>/; file contents are never read.

    Empty files are not listed (Spark leaves them out).
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    root = qualified(spark, path).rstrip("/") + "/"
    plain = F.regexp_replace("path", "^([a-z0-9]+):/(?=[^/])", "$1:///")  # one spelling of local paths
    rel = F.substring(plain, F.lit(len(root) + 1), F.length(plain))
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    return files.where(ext.isin(*exts)).select(
        F.substring_index(rel, "/", 1).alias("owner"), F.regexp_replace(rel, "^[^/]*/", "").alias("path"),
        F.element_at(F.split(rel, "/"), -1).alias("name"), F.col("length").alias("size"),
        F.col("modificationTime").alias("mtime"),
    )
