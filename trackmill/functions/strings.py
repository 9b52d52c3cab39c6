"""Names, dates and display strings as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RATING_FIELDS = (
    "shot_type", "distance", "defense", "game_context", "finish", "difficulty", "athleticism", "reaction",
    "highlight_score", "description",
)


def scorer_slug(name: Column) -> Column:
    """File-name part for a player: no blanks or path punctuation, other letters kept."""
    s = F.regexp_replace(name, r'[\s/\\:*?"<>|]+', "")
    return F.when(s == "", "player").otherwise(s)


def account_slug(account: Column) -> Column:
    return F.regexp_replace(account, r"[^A-Za-z0-9_.-]+", "_")


def session_of(video: Column) -> Column:
    """First yyyymmdd of the 2000s in the name, else the whole name."""
    day = F.regexp_extract(video, r"(20\d{6})", 1)
    return F.when(day != "", day).otherwise(video)


def recording_start(video: Column) -> Column:
    """Seconds since the epoch parsed from yyyymmdd[_-]hhmmss in the name; null when absent or invalid."""
    stamp = F.regexp_replace(F.regexp_extract(video, r"(20\d{6}[_-]?\d{6})", 1), "[_-]", "")
    day = F.try_to_date(F.nullif(F.substring(stamp, 1, 8), F.lit("")), "yyyyMMdd")
    h, m, s = (F.substring(stamp, p, 2).try_cast("int") for p in (9, 11, 13))
    ok = (h < 24) & (m < 60) & (s < 60)
    return F.when(ok, F.datediff(day, F.lit("1970-01-01").cast("date")).cast("bigint") * 86400 + h * 3600 + m * 60 + s)


def title_date(name: Column) -> Column:
    """Date in a name (first yyyymmdd of the 2000s), null when there is none or it is invalid."""
    return F.try_to_date(F.nullif(F.regexp_extract(name, r"(20\d{6})", 1), F.lit("")), "yyyyMMdd")


def star_from_name(stem: Column) -> Column:
    return F.nullif(F.regexp_extract(stem, r"_(\d)star$", 1), F.lit("")).cast("int")


def format_bytes(n: Column) -> Column:
    """B without decimals, then KB..TB with one; 1024 steps, exact halves round to even."""
    x = n.cast("double")
    steps = ("B", "KB", "MB", "GB", "TB")
    size = lambda p: F.format_string(f"%.{min(p, 1)}f {steps[p]}", F.bround(x / 1024.0**p, min(p, 1)))
    out = F.when(x < 1024, size(0))
    for p in (1, 2, 3):
        out = out.when(x < 1024.0 ** (p + 1), size(p))
    return out.otherwise(size(4))


def format_duration(seconds: Column) -> Column:
    s = F.floor(seconds).cast("bigint")
    h, m, r = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    return (
        F.when(h > 0, F.format_string("%dh %dm", h, m))
        .when(m > 0, F.format_string("%dm %ds", m, r))
        .otherwise(F.format_string("%ds", r))
    )


def parse_model_json(text: Column) -> Column:
    """Outermost {...} of a model's answer as a struct of strings; null when there is none."""
    body = F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit(""))
    schema = ", ".join(f"{f} STRING" for f in RATING_FIELDS)
    parsed = F.from_json(body, f"{schema}, _bad STRING", {"columnNameOfCorruptRecord": "_bad"})
    return F.when(parsed["_bad"].isNull() & body.isNotNull(), F.struct(*[parsed[f].alias(f) for f in RATING_FIELDS]))


def probe_meta(text: Column) -> Column:
    """struct(duration_s, resolution, fps, size_mb) from a media probe's JSON; every part may be null."""
    j = F.from_json(
        text,
        "format STRUCT<duration: STRING, size: STRING>, "
        "streams ARRAY<STRUCT<width: INT, height: INT, avg_frame_rate: STRING>>",
    )
    s = F.get(j["streams"], F.lit(0))
    rate = F.split(s["avg_frame_rate"], "/")
    den = F.coalesce(F.nullif(F.get(rate, F.lit(1)), F.lit("")).try_cast("double"), F.lit(1.0))
    fps = F.try_divide(F.get(rate, F.lit(0)).try_cast("double"), den)
    return F.struct(
        F.round(j["format"]["duration"].try_cast("double"), 1).alias("duration_s"),
        F.when((s["width"] > 0) & (s["height"] > 0), F.concat_ws("x", s["width"].cast("string"), s["height"].cast("string")))
        .alias("resolution"),
        F.when(s["avg_frame_rate"] != "0/0", F.round(fps, 1)).alias("fps"),
        F.round(j["format"]["size"].try_cast("double") / (1024 * 1024), 1).alias("size_mb"),
    )
