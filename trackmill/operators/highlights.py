"""From scored goals to stars, reel candidates and edit lists.

Goals carry session, video, clip, score and ai_score; `pos` is the 1-based rank
within the session. Ties follow (video, clip).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackmill.functions.strings import recording_start, title_date
from trackmill.operators.labels import is_human
from trackmill.ordered import with_rank_order
from trackmill.session import cut_lineage

# Fixed values of the selection rules.
STAR_SHARES = ((5, 0.15), (4, 0.30), (3, 0.30), (2, 0.15), (1, 0.10))
REEL_MIN_SCORE = 0.8
REEL_MINIMUM = 10
PER_WINDOW = 3
SLOW_EFFECTS = ("replay", "speed_ramp", "zoom_replay")
VARIANTS = {
    "top_plays": dict(
        count=20, pre=2.5, post=1.5,
        effects=(("plain", 40), ("freeze", 15), ("punch_zoom", 15), ("replay", 10), ("zoom_replay", 10), ("speed_ramp", 10)),
    ),
    "countdown": dict(count=10, pre=2.5, post=1.5, effects=(("plain", 50), ("freeze", 20), ("punch_zoom", 30))),
    "fast_cut": dict(count=16, pre=1.7, post=0.9, effects=(("plain", 60), ("punch_zoom", 30), ("freeze", 10))),
}
POOL_EXTRA = 6
POOL_SHARE = 0.2


def rank_goals(goals: DataFrame) -> DataFrame:
    """Adds pos: best ai_score first within the session."""
    d = goals.withColumn("_neg", -F.col("ai_score"))
    order = ["_neg", "video", "clip"]
    return with_rank_order(d, ["session"], order, "pos").drop("_neg")


def assign_stars(ranked: DataFrame) -> DataFrame:
    """Adds stars by rank share; shares round half to even, at least one goal gets five."""
    n = F.col("_n")
    sizes = ranked.groupBy("session").agg(F.count("*").alias("_n"))
    stars, upto = None, F.lit(0)
    for star, share in STAR_SHARES[:-1]:
        take = F.bround(n * F.lit(share)).cast("bigint")
        upto = upto + (F.greatest(F.lit(1), take) if star == 5 else take)
        hit = F.col("pos") <= upto
        stars = F.when(hit, star) if stars is None else stars.when(hit, star)
    return ranked.join(sizes, "session").withColumn("stars", stars.otherwise(1)).drop("_n")


def reel_candidates(ranked: DataFrame, labels: DataFrame, minimum: int = REEL_MINIMUM) -> DataFrame:
    """Goals to build reels from: (…ranked columns, phase, reel_pos).

    A person's labels win over the score and their stars over the AI's. A session
    with fewer than `minimum` picks is topped up in AI order (phase 1).
    """
    human = labels.where(is_human()).select(
        "video", "clip", F.col("label").alias("_label"), F.col("stars").alias("_stars")
    )
    j = ranked.join(human, ["video", "clip"], "left").where(~F.col("_label").eqNullSafe("no_goal"))
    j = j.withColumn(
        "phase", F.when(F.col("_label").eqNullSafe("goal") | (F.col("score") >= REEL_MIN_SCORE), 0).otherwise(1)
    ).withColumn("_best", F.when(F.col("phase") == 0, -F.coalesce(F.nullif("_stars", F.lit(0)), "stars")).otherwise(0))
    picked = j.groupBy("session").agg(F.count_if(F.col("phase") == 0).alias("_picked"))
    j = j.join(picked, "session").where((F.col("phase") == 0) | (F.col("_picked") < minimum))
    order = ["phase", "_best", "pos"]
    out = with_rank_order(j, ["session"], order, "reel_pos")
    return out.select(*ranked.columns, "phase", "reel_pos")


def session_times(goals: DataFrame, first_shots: DataFrame) -> DataFrame:
    """Adds at_s: seconds from the session's first recording to each goal.

    first_shots(video, shot_no, first_ms) gives each cluster's first event. A
    recording without a readable start follows the others, one day per index
    among all of the session's recordings.
    """
    vids = goals.select("session", "video").distinct().withColumn("_start", recording_start(F.col("video")))
    vids = with_rank_order(vids, ["session"], ["video"], "_n").withColumn("_i", F.col("_n") - 1)
    ends = vids.groupBy("session").agg(F.min("_start").alias("_first"), F.max("_start").alias("_last"))
    vids = vids.join(ends, "session")
    late = F.when(F.col("_last").isNull(), 0).otherwise(F.col("_last") + 86400)
    base = F.coalesce("_start", late + F.col("_i") * 86400) - F.coalesce("_first", F.lit(0))
    shot = F.nullif(F.regexp_extract(F.col("clip").cast("string"), r"(\d+)", 1), F.lit("")).cast("bigint")
    return (
        goals.withColumn("shot_no", shot)
        .join(vids.select("session", "video", base.alias("_base")), ["session", "video"])
        .join(first_shots, ["video", "shot_no"], "left")
        .withColumn("at_s", F.col("_base") + F.coalesce(F.col("first_ms") / 1000, F.lit(0.0)))
        .select(*goals.columns, "at_s")
    )


def spread_picks(ranked: DataFrame, window_s: float, count: int, per_window: int = PER_WINDOW) -> DataFrame:
    """Round-robin over time windows of the session, then the best of the rest: first `count` by pick_pos.

    ranked needs pos and at_s. Every ordering here is cut to a fixed number of
    rows per group, which Spark applies in each task before it shuffles.
    """
    d = ranked.withColumn("bucket", F.floor(F.col("at_s") / F.lit(window_s)))
    in_bucket = Window.partitionBy("session", "bucket").orderBy("pos")
    first = d.withColumn("round", F.row_number().over(in_bucket)).where(F.col("round") <= per_window)
    # what is left is at most `count` rows beyond the picks, all among the best by pos
    rest = d.join(first.select("session", "video", "clip"), ["session", "video", "clip"], "left_anti")
    both = first.select(*d.columns, F.lit(0).alias("_late"), "round", F.col("bucket").alias("_o")).unionByName(
        rest.select(*d.columns, F.lit(1).alias("_late"), F.lit(0).alias("round"), F.col("pos").alias("_o"))
    )
    w = Window.partitionBy("session").orderBy("_late", "round", "_o")
    return both.withColumn("pick_pos", F.row_number().over(w)).where(F.col("pick_pos") <= count).drop(
        "_late", "round", "_o"
    )


def draw(seed: int, *parts: Column) -> Column:
    """Repeatable pseudo-random number in 0 .. 2^32 - 1."""
    text = F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def _weighted(weights, number: Column) -> Column:
    point, upto, out = number % sum(w for _, w in weights), 0, None
    for name, w in weights[:-1]:
        upto += w
        out = F.when(point < upto, name) if out is None else out.when(point < upto, name)
    return F.lit(weights[-1][0]) if out is None else out.otherwise(weights[-1][0])


def reel_edit_list(candidates: DataFrame, videos: DataFrame, variant: str, seed: int, count: int | None = None, spread_s: float | None = None) -> DataFrame:
    """Clips of one reel per session, in playing order, with timing, effect and rim position.

    candidates needs reel_pos and make; videos(video, x1..y2, w, h) holds the rim
    in pixels. With spread_s (of "top_plays"; candidates then need at_s) the clips are
    picked from every spread_s seconds of the session and play in its order.
    At most `count` rows per session remain before anything is
    collected, so the no-two-slow-effects rule folds over a short array.
    """
    v = VARIANTS[variant]
    count = count or v["count"]
    key = [F.col("video"), F.col("clip")]
    if variant == "top_plays" and spread_s:
        d = spread_picks(candidates.withColumn("pos", F.col("reel_pos")), spread_s, count)
        play = ["at_s", "pick_pos"]
    elif variant == "fast_cut":
        n = candidates.groupBy("session").agg(F.count("*").alias("_n"))
        pool = F.greatest(F.lit(count + POOL_EXTRA), F.bround(F.col("_n") * POOL_SHARE).cast("bigint"))
        d = candidates.join(n, "session").where(F.col("reel_pos") <= pool).withColumn("_d", draw(seed, *key))
        w = Window.partitionBy("session").orderBy("_d", "video", "clip")
        d = d.withColumn("_o", F.row_number().over(w)).where(F.col("_o") <= count)
        play = ["_d", "video", "clip"]
    else:
        d = candidates.where(F.col("reel_pos") <= count).withColumn("_d", -F.col("reel_pos"))
        play = ["video", "clip"] if variant == "top_plays" else ["_d"]
    w = Window.partitionBy("session").orderBy(*play)
    d = d.withColumn("position", F.row_number().over(w))
    calm = [e for e in v["effects"] if e[0] not in SLOW_EFFECTS]
    d = d.join(videos, "video").select(
        "session", "position", "video", "clip", "make",
        F.lit(v["pre"]).alias("pre"), F.lit(v["post"]).alias("post"),
        F.round((F.col("x1") + F.col("x2")) / 2 / F.col("w") * 100, 1).alias("rim_x"),
        F.round((F.col("y1") + F.col("y2")) / 2 / F.col("h") * 100, 1).alias("rim_y"),
        _weighted(v["effects"], draw(seed + 1, *key)).alias("effect"),
        _weighted(calm, draw(seed + 2, *key)).alias("calm"),
    )
    slow = lambda e: e.isin(*SLOW_EFFECTS)

    def step(s, c):
        effect = F.when(slow(c["effect"]) & s["slow"], c["calm"]).otherwise(c["effect"])
        return F.struct(
            slow(effect).alias("slow"),
            F.concat(s["out"], F.array(F.struct(*[c[n] for n in names], effect.alias("effect")))).alias("out"),
        )

    names = [c for c in d.columns if c not in ("session", "effect", "calm")]
    types = dict(d.dtypes)
    zero = F.struct(
        F.lit(False).alias("slow"),
        F.array().cast("array<struct<" + ",".join(f"{c}:{types[c]}" for c in names) + ",effect:string>>").alias("out"),
    )
    reels = d.groupBy("session").agg(
        F.sort_array(F.collect_list(F.struct(*names, "effect", "calm"))).alias("clips")
    )
    out = reels.select(
        "session", F.size("clips").alias("_n"), F.inline(F.aggregate("clips", zero, step)["out"])
    )
    if variant == "countdown":  # the best play closes the reel with a slow replay
        out = out.withColumn("effect", F.when(F.col("position") == F.col("_n"), "zoom_replay").otherwise(F.col("effect")))
    return out.drop("_n")


def goals_by_player(groups: DataFrame) -> DataFrame:
    """Goals per suggested name; unnamed groups become "Player N" in order of first appearance."""
    named = F.col("suggested").isNotNull()
    g = groups.where("group is not null").groupBy(
        "session", F.when(named, F.col("suggested")).alias("name"), F.when(~named, F.col("group")).alias("grp")
    ).agg(F.count("*").alias("n"), F.min(F.struct("video", "clip")).alias("seen"))
    g = cut_lineage(g)
    known = g.where("name is not null").select("session", F.col("name").alias("player"), "n")
    others = with_rank_order(g.where("name is null").select("session", "seen.*", "n"), ["session"], ["video", "clip"], "_i")
    others = others.select("session", F.concat(F.lit("Player "), F.col("_i").cast("string")).alias("player"), "n")
    return known.unionByName(others).groupBy("session", "player").agg(F.sum("n").alias("goals"))


def session_summary(clips: DataFrame, goals: DataFrame) -> DataFrame:
    """Per session: clips, goals, rated goals and how many goals got each star."""
    n = clips.groupBy("session").agg(F.count("*").alias("n_clips"))
    g = goals.groupBy("session").agg(
        F.count("*").alias("n_goals"), F.count_if("rated").alias("n_rated"),
        *[F.count_if(F.col("stars") == s).alias(f"star{s}") for s in (5, 4, 3, 2, 1)],
    )
    return n.join(g, "session", "left").na.fill(0)


def session_title(videos: DataFrame) -> DataFrame:
    """Per session, title lines from the first name that holds a valid date."""
    dated = videos.withColumn("_date", title_date(F.col("video")))
    first = dated.groupBy("session").agg(
        F.min_by("_date", F.when(F.col("_date").isNotNull(), F.col("video"))).alias("_d"), F.min("session").alias("_s")
    )
    return first.select(
        "session",
        F.coalesce(F.concat(F.upper(F.date_format("_d", "EEEE")), F.lit(" RUN")), F.lit("HIGHLIGHTS")).alias("title"),
        F.coalesce(F.date_format("_d", "d MMM yyyy"), F.col("_s").cast("string")).alias("subtitle"),
    )
