"""Rule-based events on a track: crossings, clusters, clips, matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackmill.functions.geometry import Box, above_band, side_band, through_band
from trackmill.ordered import BLK, time_block, with_last_seen, with_time_halo
from trackmill.session import cut_lineage

# Fixed values of the rule, in milliseconds.
MAX_GAP_MS = 600
BOUNCE_MS = 400
COOLDOWN_MS = 1500
MERGE_GAP_MS = 5000
CLIP_PRE_MS = 5000
CLIP_POST_MS = 2000

TRACK_BLOCK_MS = 600_000
EVENT_BLOCK_MS = 3_600_000
NEVER = -(1 << 60)


def _sighting_mark(b: Box) -> Column:
    """struct(t, cx, cy) above the rim; an empty mark once the object leaves the band; else null."""
    cx, cy = F.col("cx"), F.col("cy")
    nothing = F.lit(None)
    mark = lambda keep: F.struct(
        *[(F.col(n) if keep else nothing.cast(t)).alias(n) for n, t in
          (("t_ms", "bigint"), ("cx", "double"), ("cy", "double"))]
    )
    return (
        F.when(cx.isNull(), nothing)
        .when(~side_band(b, cx), mark(False))
        .when(above_band(b, cy), mark(True))
    )


def crossing_state(track: DataFrame, b: Box, keys=("video_id",), block_ms: int = TRACK_BLOCK_MS) -> DataFrame:
    """Adds above_ms, above_cx, above_cy: the live sighting above the rim, if any."""
    out = with_last_seen(track, list(keys), time_block("t_ms", block_ms), ["t_ms"], _sighting_mark(b), "_sight")
    return out.select(
        *track.columns,
        F.col("_sight.t_ms").alias("above_ms"),
        F.col("_sight.cx").alias("above_cx"),
        F.col("_sight.cy").alias("above_cy"),
    )


def _passes(track: DataFrame, b: Box, width: int) -> DataFrame:
    """Every through-the-hoop row with a sighting at most MAX_GAP_MS old.

    One row per pass and block; the block is that of the *sighting*, so all
    passes of one sighting sit together. `_core` is false for the passes just
    before a block whose event could still hold the block's first one back.
    """
    reach_back = COOLDOWN_MS + MAX_GAP_MS
    rows = with_time_halo(
        track.select("video_id", "t_ms", "cx", "cy", b.struct().alias("box")).where(F.col("cx").isNotNull()),
        "t_ms", width, lookback=reach_back, lookahead=MAX_GAP_MS + BOUNCE_MS,
    )
    bx = Box(*[F.col(f"box.{n}") for n in Box._fields])
    w = Window.partitionBy("video_id", BLK).orderBy("t_ms")
    seen = rows.select(
        "video_id", BLK, "t_ms",
        (side_band(bx, F.col("cx")) & through_band(bx, F.col("cy"))).alias("through"),
        F.last(_sighting_mark(bx), ignorenulls=True)
        .over(w.rowsBetween(Window.unboundedPreceding, 0)).getField("t_ms").alias("above_ms"),
        F.coalesce(F.max(F.col("cy") < bx.y1).over(w.rangeBetween(1, BOUNCE_MS)), F.lit(False)).alias("bounced"),
    )
    start = F.col(BLK) * width
    owner = time_block("above_ms", width)
    return seen.where(
        F.col("through")
        & (F.col("t_ms") - F.col("above_ms") <= MAX_GAP_MS)
        & ((owner == F.col(BLK)) | ((owner < F.col(BLK)) & (F.col("t_ms") > start - COOLDOWN_MS)))
    ).select("video_id", BLK, "t_ms", "above_ms", "bounced", (owner == F.col(BLK)).alias("_core"))


def _run_block(passes: Column, last: Column) -> Column:
    """Apply cooldown and one-event-per-sighting to a block's passes in order."""
    pair = "array<struct<above_ms:bigint,t_ms:bigint>>"

    def step(s, c):
        skip = (c["above_ms"] == s["used"]) | (c["t_ms"] - s["last"] <= COOLDOWN_MS)
        hit = F.struct(
            F.when(c["bounced"], s["last"]).otherwise(c["t_ms"]).alias("last"),
            c["above_ms"].alias("used"),
            F.when(c["bounced"], s["out"])
            .otherwise(F.concat(s["out"], F.array(F.struct(c["above_ms"].alias("above_ms"), c["t_ms"].alias("t_ms")))))
            .alias("out"),
        )
        return F.when(skip, s).otherwise(hit)

    zero = F.struct(last.alias("last"), F.lit(NEVER).alias("used"), F.array().cast(pair).alias("out"))
    return F.aggregate(passes, zero, step)


def find_makes(track: DataFrame, b: Box, block_ms: int = TRACK_BLOCK_MS) -> DataFrame:
    """Crossing events: (video_id, above_ms, through_ms, make_ms).

    The cooldown makes the rule sequential, but all a block needs to know of the
    past is its predecessor's last event, one of the few passes in the final
    COOLDOWN_MS. Each block therefore tabulates last-event-in -> last-event-out;
    where the table is constant the next block's input is known outright, and
    only runs of non-constant tables are composed in order.
    """
    if block_ms <= 2 * (COOLDOWN_MS + MAX_GAP_MS):
        raise ValueError("block_ms must exceed twice the rule's reach")
    passes = _passes(track, b, block_ms)
    entry = F.struct("t_ms", "above_ms", "bounced")
    blocks = passes.groupBy("video_id", BLK).agg(
        F.sort_array(F.collect_list(F.when(F.col("_core"), entry))).alias("passes"),
        F.collect_list(F.when(~F.col("_core") & ~F.col("bounced"), F.col("t_ms"))).alias("before"),
    ).where(F.size("passes") > 0)
    # passes are rare next to track rows: keep them, so the track is read and sorted once
    blocks = cut_lineage(blocks)

    end = (F.col(BLK) + 1) * block_ms

    def leaves(last):
        out = _run_block(F.col("passes"), last)["last"]
        return F.when(out > end - COOLDOWN_MS, out).otherwise(F.lit(NEVER))

    table = F.transform(
        F.concat(F.array(F.lit(NEVER)), F.col("before")),
        lambda last: F.struct(last.alias("came"), leaves(last).alias("left")),
    )
    tables = blocks.select("video_id", BLK, table.alias("tab")).withColumn(
        "fixed", F.when(F.array_min("tab.left") == F.array_max("tab.left"), F.array_min("tab.left"))
    )
    w = Window.partitionBy("video_id").orderBy(BLK)
    linked = tables.select(
        "*",
        F.coalesce(F.lag(BLK).over(w) == F.col(BLK) - 1, F.lit(False)).alias("adjacent"),
        F.lag("fixed").over(w).alias("prev_fixed"),
    ).withColumn("opens", ~F.col("adjacent") | F.col("prev_fixed").isNotNull())
    runs = linked.withColumn("run", F.sum(F.col("opens").cast("int")).over(w))
    known = runs.withColumn(
        "came", F.when(F.col("opens"), F.when(F.col("adjacent"), F.col("prev_fixed")).otherwise(F.lit(NEVER)))
    )
    chained = known.groupBy("video_id", "run").agg(
        F.sort_array(F.collect_list(F.struct(BLK, "came", "tab"))).alias("steps")
    )

    def follow(s, x):
        came = F.coalesce(x["came"], s["left"])
        left = F.filter(x["tab"], lambda e: e["came"] == came)[0]["left"]
        return F.struct(
            left.alias("left"),
            F.concat(s["out"], F.array(F.struct(x[BLK].alias(BLK), came.alias("came")))).alias("out"),
        )

    zero = F.struct(
        F.lit(NEVER).alias("left"), F.array().cast(f"array<struct<{BLK}:bigint,came:bigint>>").alias("out")
    )
    arrivals = chained.select(
        "video_id", F.inline(F.aggregate("steps", zero, follow)["out"])
    )
    made = blocks.join(arrivals, ["video_id", BLK]).select(
        "video_id", F.inline(_run_block(F.col("passes"), F.col("came"))["out"])
    )
    return made.select(
        "video_id", "above_ms", F.col("t_ms").alias("through_ms"),
        F.expr("(above_ms + t_ms) div 2").alias("make_ms"),
    )


def cluster_events(
    events: DataFrame, gap_ms: int = MERGE_GAP_MS, keys=("video_id",), block_ms: int = EVENT_BLOCK_MS
) -> DataFrame:
    """Adds shot_no: events chain into one cluster while each gap is strictly below gap_ms."""
    keys = list(keys)
    d = events.withColumn(BLK, time_block("t_ms", block_ms))
    w = Window.partitionBy(*keys, BLK).orderBy("t_ms")
    d = d.withColumn("_brk", (F.col("t_ms") - F.lag("t_ms").over(w) >= gap_ms).cast("bigint"))
    blocks = d.groupBy(*keys, BLK).agg(
        F.min("t_ms").alias("_lo"), F.max("t_ms").alias("_hi"),
        F.coalesce(F.sum("_brk"), F.lit(0)).alias("_inner"),
    )
    wk = Window.partitionBy(*keys).orderBy(BLK)
    blocks = blocks.withColumn(
        "_opens", F.coalesce((F.col("_lo") - F.lag("_hi").over(wk) >= gap_ms).cast("bigint"), F.lit(1))
    )
    carry = blocks.select(
        *keys, BLK,
        (F.sum(F.col("_inner") + F.col("_opens")).over(wk.rowsBetween(Window.unboundedPreceding, 0))
         - F.col("_inner")).alias("_base"),
    )
    d = d.withColumn("_run", F.coalesce(F.sum("_brk").over(w.rangeBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    return d.join(carry, [*keys, BLK]).select(
        *events.columns, (F.col("_base") + F.col("_run")).alias("shot_no")
    )


def clips(clustered: DataFrame, pre_ms: int = CLIP_PRE_MS, post_ms: int = CLIP_POST_MS) -> DataFrame:
    """One clip per cluster. The start clamps at zero, the length does not."""
    g = clustered.groupBy("video_id", "shot_no").agg(
        F.min("t_ms").alias("first_ms"), F.max("t_ms").alias("last_ms"), F.count("*").alias("n_shots")
    )
    return g.select(
        "*",
        F.greatest(F.lit(0), F.col("first_ms") - pre_ms).cast("bigint").alias("start_ms"),
        (F.col("last_ms") + post_ms - (F.col("first_ms") - pre_ms)).alias("duration_ms"),
    )


def local_shot_times(clustered: DataFrame, pre_ms: int = CLIP_PRE_MS) -> DataFrame:
    """Each shot's time inside its clip, from the clamped start."""
    first = clustered.groupBy("video_id", "shot_no").agg(F.min("t_ms").alias("_first"))
    return clustered.join(first, ["video_id", "shot_no"]).select(
        "video_id", "shot_no", "t_ms",
        (F.col("t_ms") - F.greatest(F.lit(0), F.col("_first") - pre_ms)).cast("bigint").alias("local_ms"),
    )


def shots_in_window(
    track: DataFrame, shots: DataFrame, before_ms: int = 5000, after_ms: int = 2000, event_at_ms: int = 5000
) -> DataFrame:
    """Each shot's track rows in [t - before, t + after], re-based so the shot sits at event_at_ms.

    The range condition becomes an equi-join on (video, time block): a shot goes
    to the one or two blocks its window touches.
    """
    width = before_ms + after_ms
    s = shots.select(
        "video_id", F.col("t_ms").alias("shot_ms"),
        F.explode(F.sequence(time_block(F.col("t_ms") - before_ms, width), time_block(F.col("t_ms") + after_ms, width)))
        .alias(BLK),
    )
    t = track.withColumn(BLK, time_block("t_ms", width))
    hit = t.join(s, ["video_id", BLK]).where(
        (F.col("t_ms") >= F.col("shot_ms") - before_ms) & (F.col("t_ms") <= F.col("shot_ms") + after_ms)
    )
    return hit.select(
        "video_id", "shot_ms", (F.col("t_ms") - F.col("shot_ms") + event_at_ms).alias("t_ms"),
        *[c for c in track.columns if c not in ("video_id", "t_ms")],
    )


def event_metrics(matches: DataFrame, keys=("video_id",)) -> DataFrame:
    """Recall and precision; NaN when there is nothing to divide by."""
    n = lambda *o: F.count_if(F.col("outcome").isin(*o))
    rate = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(float("nan")))
    hit, found, real = n("matched"), n("matched", "false_positive"), n("matched", "missed")
    return matches.groupBy(*keys).agg(
        hit.alias("n_matched"), found.alias("n_detected"), real.alias("n_truth"),
        rate(hit, real).alias("recall"), rate(hit, found).alias("precision"),
    )
