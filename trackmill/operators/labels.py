"""The label table: folding actions, merging stores, clip views and dataset manifests.

Label rows are (video, clip, label, source, stars, scorer, assist, ...); a null
source means a person decided.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackmill.functions.strings import scorer_slug, star_from_name
from trackmill.ordered import with_rank_order
from trackmill.session import cut_lineage

VALID_LABELS = ("goal", "no_goal")
MAKE_FROM = 0.6
NO_SCORER = "_no_scorer"


def is_human(source="source", label="label") -> Column:
    return ~F.col(source).eqNullSafe("ai") & F.col(label).isNotNull()


def human_only(labels: DataFrame) -> DataFrame:
    """Labels a person made that a model may learn from."""
    return labels.where(is_human() & F.col("label").isin(*VALID_LABELS))


def valid_actions(actions: DataFrame) -> DataFrame:
    """Drop actions the label store would reject; adds `ord`, their order within a clip."""
    label, stars, scorer = F.col("label"), F.col("stars"), F.col("scorer")
    blank = F.trim(F.coalesce(scorer, F.lit(""))) == ""
    in_range = stars.isNull() | stars.between(1, 5)
    ok = (
        F.when(
            F.col("action") == "label",
            (label.isNull() | label.isin(*VALID_LABELS)) & in_range & (scorer.isNull() | ~blank)
            & ((stars.isNull() & scorer.isNull()) | label.eqNullSafe("goal")),
        )
        .when(F.col("action") == "bulk", label.isin(*VALID_LABELS) & F.coalesce(F.col("source") == "ai", F.lit(True)))
        .when(F.col("action") == "star", in_range)
        .when(F.col("action") == "name_group", ~blank)
        .otherwise(F.col("action").isin("scorer", "assist", "delete"))
    )
    clean = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    return actions.where(ok).select(
        "clip", F.struct("ts", "seq").alias("ord"), "ts", "action", "label", "source", "stars",
        clean("scorer").alias("scorer"), clean("assist").alias("assist"),
    )


def fold_label_actions(actions: DataFrame) -> DataFrame:
    """Current label per clip after replaying every action in order.

    Replaying is not needed: all that matters lies after the clip's last *reset*
    (delete, un-label or no_goal). From there the first action able to create the
    entry starts the goal, and each field is its last writer since. Every step is
    an aggregate that combines before the shuffle, so a clip with any number of
    actions costs one partial row per task.
    """
    a = valid_actions(actions)
    act, label = F.col("action"), F.col("label")
    is_label = act == "label"
    wipes = (act == "delete") | (is_label & label.isNull())
    misses = is_label & label.eqNullSafe("no_goal")
    resets = a.where(wipes | misses).groupBy("clip").agg(
        F.max("ord").alias("r"), F.max_by(F.struct(misses.alias("miss"), "ts"), "ord").alias("rs")
    )
    resets = cut_lineage(resets)  # one row per clip; the log itself is never copied
    since = a.join(resets, "clip", "left").where(F.col("r").isNull() | (F.col("ord") > F.col("r")))
    missed = F.coalesce(F.col("rs.miss"), F.lit(False))
    goal_click = is_label & (label == "goal")
    creates = ~missed & act.isin("bulk", "name_group")
    starts = since.groupBy("clip").agg(
        F.min(F.when(goal_click, F.col("ord"))).alias("click"),
        F.min_by(F.struct("ord", "ts", "action", "label", "source"), F.when(creates, F.col("ord"))).alias("made"),
    )
    # opened: the bulk/name action that created the entry ahead of any click
    early = F.col("made").isNotNull() & (F.col("click").isNull() | (F.col("made.ord") < F.col("click")))
    made_goal = (F.col("made.action") == "name_group") | (F.col("made.label") == "goal")
    starts = starts.select(
        "clip", "click", F.when(early, F.col("made")).alias("opened"),
        F.when(early & made_goal, F.col("made.ord")).otherwise(F.col("click")).alias("s"),
    )
    starts = cut_lineage(starts)
    after = since.join(starts, "clip").where(F.col("s").isNotNull() & (F.col("ord") >= F.col("s")))
    rated = (act == "star") | (goal_click & F.col("stars").isNotNull())
    names = act.isin("scorer", "name_group") | (goal_click & F.col("scorer").isNotNull())
    last = lambda v, c: F.max_by(F.struct(v.alias("v")), F.when(c, F.col("ord")))["v"]
    fields = after.groupBy("clip").agg(
        last(F.col("stars"), rated).alias("stars"),
        last(F.when(rated, F.col("ts")), rated | goal_click).alias("rated_at"),
        last(F.col("scorer"), names).alias("scorer"),
        last(F.col("assist"), act == "assist").alias("assist"),
        last(F.col("ts"), goal_click).alias("clicked_at"),
        F.count_if(goal_click).alias("clicks"),
    )
    j = resets.join(starts, "clip", "full_outer").join(fields, "clip", "left")
    goal, opened = F.col("s").isNotNull(), F.col("opened.ord").isNotNull()
    clicked = F.coalesce(F.col("clicks"), F.lit(0)) > 0
    bulk_ts = F.when(F.col("opened.action") == "bulk", F.col("opened.ts"))
    return j.select(
        "clip",
        F.when(goal, "goal").when(opened | missed, "no_goal").alias("label"),
        F.when(goal & clicked, F.col("clicked_at")).when(opened, bulk_ts).otherwise(F.col("rs.ts")).alias("labeled_at"),
        F.when(opened & ~clicked, F.when(F.col("opened.action") == "name_group", "ai").otherwise(F.col("opened.source")))
        .alias("source"),
        *[F.when(goal, F.col(c)).alias(c) for c in ("stars", "rated_at", "scorer", "assist")],
    ).where("label is not null")


def bulk_counts(labels: DataFrame, clips: DataFrame) -> DataFrame:
    """How many of the clips a bulk action would label and skip."""
    j = clips.select("video", "clip").distinct().join(labels.select("video", "clip", "label"), ["video", "clip"], "left")
    return j.agg(F.count_if(F.col("label").isNull()).alias("labeled"), F.count_if(F.col("label").isNotNull()).alias("skipped"))


# ---- stores ---------------------------------------------------------------


def merge_accounts(labels: DataFrame, account="account", clip="clip") -> DataFrame:
    """Label tables of all accounts as one, keyed account/clip."""
    return labels.withColumn(clip, F.concat_ws("/", F.col(account).cast("string"), F.col(clip).cast("string"))).drop(account)


def merge_rosters(*rosters: DataFrame) -> DataFrame:
    """Trimmed, non-empty, unique names in case-insensitive order."""
    names = rosters[0].select(F.trim("name").alias("name"))
    for r in rosters[1:]:
        names = names.unionByName(r.select(F.trim("name").alias("name")))
    return names.where("name <> ''").distinct().orderBy(F.lower("name"), "name")


def overlay_labels(base: DataFrame, extra: DataFrame, prefix: str) -> DataFrame:
    """`extra` rows under `prefix` (stripped) replace the base rows of the same clip."""
    own = extra.where(F.col("clip").startswith(prefix)).withColumn("clip", F.substring("clip", len(prefix) + 1, 1 << 30))
    cols = [c for c in base.columns if c != "clip"]
    both = base.withColumn("_p", F.lit(0)).unionByName(own.select(*base.columns).withColumn("_p", F.lit(1)))
    return both.groupBy("clip").agg(F.max_by(F.struct(*cols), "_p").alias("e")).select("clip", "e.*")


def pending(todo: DataFrame, done: DataFrame, key: list[str], method: str) -> DataFrame:
    """Work not yet done by this method."""
    return todo.join(done.where(F.col("method") == method).select(*key), key, "left_anti")


# ---- views ----------------------------------------------------------------


def clip_view(clips: DataFrame, filter_scores: DataFrame, make_scores: DataFrame, suggestions: DataFrame,
              rated_videos: DataFrame, labels: DataFrame) -> DataFrame:
    """Every clip with its scores, suggestion and label.

    ai_rated says the whole recording went through suggestions, so a clip that
    has none is known to need no person.
    """
    on = ["video", "clip"]
    return (
        clips.select(*on)
        .join(filter_scores.select(*on, F.col("score").alias("filter_score")), on, "left")
        .join(make_scores.select(*on, F.col("score").alias("make_score")), on, "left")
        .join(
            suggestions.select(
                *on, F.col("stars").alias("ai_stars"), F.col("reel").alias("ai_reel"), F.col("scorer").alias("ai_scorer")
            ), on, "left",
        )
        .join(rated_videos.select("video", F.lit(True).alias("ai_rated")), "video", "left")
        .join(labels.select(*on, "label", "stars", "scorer", "assist", F.col("source").alias("label_source")), on, "left")
        .withColumn("ai_rated", F.coalesce("ai_rated", F.lit(False)))
        .withColumn("ai_reel", F.coalesce("ai_reel", F.lit(False)))
    )


def goal_clips(clips: DataFrame, labels: DataFrame, scores: DataFrame) -> DataFrame:
    """Labelled goals; unlabelled clips by score; all unlabelled clips of a recording without any score."""
    on = ["video", "clip"]
    scored = scores.select("video").distinct().withColumn("_any", F.lit(True))
    j = (
        clips.select(*on)
        .join(labels.select(*on, "label"), on, "left")
        .join(scores.select(*on, "score"), on, "left")
        .join(scored, "video", "left")
    )
    by_score = F.col("_any").isNull() | (F.coalesce("score", F.lit(0.0)) >= MAKE_FROM)
    return j.where(F.when(F.col("label").isNotNull(), F.col("label") == "goal").otherwise(by_score)).select(*on)


def flat_name(video: Column, clip: Column, stars: Column, scorer: Column) -> Column:
    """video__clip[_Nstar][_Slug]"""
    return F.concat(
        F.regexp_replace(video.cast("string"), "/", "__"), F.lit("__"), clip.cast("string"),
        F.coalesce(F.concat(F.lit("_"), stars.cast("string"), F.lit("star")), F.lit("")),
        F.coalesce(F.concat(F.lit("_"), scorer_slug(scorer)), F.lit("")),
    )


def export_path(label: Column, video: Column, clip: Column, stars: Column, scorer: Column, by_scorer: bool) -> Column:
    """Flat name, or a folder per scorer with the scorer left out of the name."""
    goal = label.eqNullSafe("goal")
    stars, scorer = F.when(goal & (stars > 0), stars), F.when(goal, F.nullif(scorer, F.lit("")))
    if not by_scorer:
        return flat_name(video, clip, stars, scorer)
    folder = F.when(scorer.isNotNull(), scorer_slug(scorer)).otherwise(NO_SCORER)
    return F.concat(folder, F.lit("/"), flat_name(video, clip, stars, F.lit(None).cast("string")))


def _dataset_reason(min_stars: int | None, player: str | None) -> Column:
    goal = F.col("label") == "goal"
    below = goal & (F.coalesce("stars", F.lit(0)) < (min_stars or 0))
    other = goal & ~F.col("scorer").eqNullSafe(player) if player else F.lit(False)
    return (
        F.when(below, "below_min_stars").when(other, "not_this_player")
        .when(F.col("_there").isNull(), "missing").otherwise(F.col("label"))
    )


def _with_reason(labels, inventory, min_stars, player):
    there = inventory.select("video", "clip").distinct().withColumn("_there", F.lit(True))
    d = labels.where(F.col("label").isin(*VALID_LABELS)).join(there, ["video", "clip"], "left")
    return d.withColumn("reason", _dataset_reason(min_stars, player))


def dataset_manifest(labels: DataFrame, inventory: DataFrame, min_stars: int | None = None, player: str | None = None,
                     by_stars: bool = False) -> DataFrame:
    """Where each usable labelled clip goes: (label, star_bin, name). Misses ignore the goal filters."""
    goal = F.col("label") == "goal"
    stars, scorer = F.when(goal, F.nullif("stars", F.lit(0))), F.when(goal, F.col("scorer"))
    bins = F.coalesce(F.concat(stars.cast("string"), F.lit("star")), F.lit("unrated"))
    d = _with_reason(labels, inventory, min_stars, player).where(F.col("reason") == F.col("label"))
    return d.select(
        "video", "clip", "label", F.when(goal & F.lit(by_stars), bins).alias("star_bin"),
        flat_name(F.col("video"), F.col("clip"), stars, scorer).alias("name"),
    )


def dataset_counts(labels: DataFrame, inventory: DataFrame, min_stars: int | None = None, player: str | None = None) -> DataFrame:
    """What a dataset build keeps and why it skips; the star histogram counts goals before any filter."""
    d = _with_reason(labels, inventory, min_stars, player)
    goal = F.col("label") == "goal"
    reasons = ("goal", "no_goal", "missing", "below_min_stars", "not_this_player")
    return d.agg(
        *[F.count_if(F.col("reason") == r).alias(r) for r in reasons],
        *[F.count_if(goal & (F.col("stars") == s)).alias(f"star{s}") for s in range(1, 6)],
        F.count_if(goal & F.coalesce(F.col("stars") == 0, F.lit(True))).alias("unrated"),
    )


def players_view(groups: DataFrame, labels: DataFrame) -> DataFrame:
    """Goals by group and session with current labels, one row per clip.

    session_pos runs newest session first, group_pos largest group first.
    """
    g = groups.where("group is not null")
    sizes = g.groupBy("session", "group").agg(F.count("*").alias("size"), F.max_by("suggested", F.struct("video", "clip")).alias("suggested"))
    oldest = with_rank_order(g.select("session").distinct(), [], ["session"], "_i")
    n = oldest.agg(F.count("*").alias("_n"))  # one row
    newest = oldest.crossJoin(F.broadcast(n)).select("session", (F.col("_n") + 1 - F.col("_i")).alias("session_pos"))
    order = ["_neg", "group"]
    sizes = sizes.withColumn("_neg", -F.col("size"))
    sizes = with_rank_order(sizes, ["session"], order, "group_pos").drop("_neg")
    on = ["video", "clip"]
    return (
        g.select("session", "group", *on)
        .join(sizes, ["session", "group"])
        .join(newest, "session")
        .join(labels.select(*on, "label", "stars", "scorer"), on, "left")
    )


def library_sections(view: DataFrame) -> DataFrame:
    """Clips by scorer: most goals first, then goals without a scorer, then everything else."""
    goal = F.col("label").eqNullSafe("goal")
    kind = F.when(goal & F.col("scorer").isNotNull(), 0).when(goal, 1).otherwise(2)
    name = F.when(kind == 0, F.col("scorer")).when(kind == 1, "no scorer").otherwise("not a goal")
    d = view.withColumn("kind", kind).withColumn("section", name)
    sizes = d.groupBy("kind", "section").agg(F.count("*").alias("size")).withColumn("_neg", -F.col("size"))
    order = ["kind", "_neg", "section"]
    sizes = with_rank_order(sizes, [], order, "section_pos").drop("_neg")
    return d.join(sizes, ["kind", "section"]).drop("kind")


def sheet_order(sections: DataFrame) -> DataFrame:
    """Sections 5star..1star first, then the others by name; each clip's star read from its name."""
    star = F.when(F.col("section").rlike("^[1-5]star$"), F.substring("section", 1, 1).cast("int"))
    return sections.select(
        "*", F.coalesce(-star, F.lit(1)).alias("section_key"), star_from_name(F.col("stem")).alias("stars")
    )
