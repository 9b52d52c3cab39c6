"""People in a clip: merging boxes, picking the shooter, following them.

detections(clip, frame_idx, t_ms, cls, conf, x1, y1, x2, y2, seq): seq is the
detector's order within the frame. Frames hold a handful of boxes and a shot
window a few hundred frames, so the short ordered rules fold over arrays; the
window filter runs before anything is collected.

Detections are dealt by clip over as many tasks as their rows need, and what is made of
their frames keeps that number, so a task's memory does not grow with the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackmill.functions.geometry import Box, at_hands, box_of, iou
from trackmill.ordered import with_rank_order
from trackmill.session import cut_lineage, tasks_for

# Fixed values of the shooter rules.
SAME_BOX_IOU = 0.7
FOLLOW_IOU = 0.35
CLEAR_IOU = 0.15
MAX_MISSES = 3
WINDOW_BEFORE_MS, WINDOW_AFTER_MS = 3500, 300
SHOT_BEFORE_MS, SHOT_AFTER_MS = 2800, 150
HOLDER_BEFORE_MS = 300
BALL_MIN_CONF = 0.25
HANDS_BONUS = 0.5
MIN_CLEAN = 3
MAX_CROPS = 12
RIM_SAMPLES = 15
RIM_MIN_CONF = 0.5

BOX_TYPE = "struct<x1:double,y1:double,x2:double,y2:double>"


def _rank(cls: Column) -> Column:
    return F.when(cls == "scorer", 2).when(cls == "holder", 1).otherwise(0)


def _merged(dets: Column) -> Column:
    """Fold one frame's detections, most confident first: near-equal boxes become one."""
    person = f"struct<cls:string,conf:double,box:{BOX_TYPE}>"

    def step(out, d):
        same = F.array_position(F.transform(out, lambda o: iou(box_of(d["box"]), box_of(o["box"])) >= SAME_BOX_IOU), True)
        new = F.struct(d["cls"].alias("cls"), d["conf"].alias("conf"), d["box"].alias("box"))
        upgraded = F.transform(
            out,
            lambda o, i: F.when(
                (i == same - 1) & (_rank(d["cls"]) > _rank(o["cls"])),
                F.struct(d["cls"].alias("cls"), d["conf"].alias("conf"), o["box"].alias("box")),
            ).otherwise(o),
        )
        return F.when(same == 0, F.concat(out, F.array(new))).otherwise(upgraded)

    return F.aggregate(dets, F.array().cast(f"array<{person}>"), step)


def frames(dets: DataFrame) -> DataFrame:
    """One row per frame: merged people in detector order and the balls' boxes."""
    b = F.struct("x1", "y1", "x2", "y2").cast(BOX_TYPE).alias("box")
    d = dets.select("clip", "frame_idx", "t_ms", "cls", F.col("conf").cast("double").alias("conf"), "seq", b)
    # of equal boxes of one class only the first, most confident one can matter: drop copies before collecting
    d = d.groupBy("clip", "frame_idx", "t_ms", "cls", "box").agg(
        F.max(F.struct("conf", (-F.col("seq")).alias("k"))).alias("m")
    ).select("clip", "frame_idx", "t_ms", "cls", "box", "m.conf", (-F.col("m.k")).alias("seq"))
    person = F.col("cls").isin("player", "scorer", "holder")
    return d.groupBy("clip", "frame_idx", "t_ms").agg(
        F.sort_array(F.collect_list(F.when(person, F.struct((-F.col("conf")).alias("k"), "seq", "cls", "conf", "box")))).alias("p"),
        F.collect_list(F.when((F.col("cls") == "ball") & (F.col("conf") > BALL_MIN_CONF), F.col("box"))).alias("balls"),
    ).select("clip", "frame_idx", "t_ms", _merged(F.col("p")).alias("people"), "balls")


def merge_people(dets: DataFrame) -> DataFrame:
    """Merged person boxes per frame: (clip, frame_idx, t_ms, pos, cls, conf, box)."""
    return people_of(frames(dets))


def people_of(seen: DataFrame) -> DataFrame:
    """merge_people's rows from frames that are merged already."""
    return seen.select("clip", "frame_idx", "t_ms", F.posexplode("people").alias("pos", "p")).select(
        "clip", "frame_idx", "t_ms", "pos", "p.*"
    )


def in_window(dets: DataFrame, makes: DataFrame) -> DataFrame:
    """Detections of the frames scanned around each clip's make, with make_ms, dealt by clip."""
    t, m = F.col("t_ms"), F.col("make_ms")
    n = tasks_for(dets.sparkSession, dets.count())
    return dets.repartition(n, "clip").join(makes.repartition(n, "clip"), "clip").where((t >= m - WINDOW_BEFORE_MS) & (t < m + WINDOW_AFTER_MS))


def window_frames(dets: DataFrame, makes: DataFrame) -> DataFrame:
    """frames() of the scanned windows, kept: what picking, following and cleaning all read."""
    return cut_lineage(frames(in_window(dets, makes).drop("make_ms")))


def pick_shooter(seen: DataFrame, makes: DataFrame) -> DataFrame:
    """Per clip the shooter's anchor: (clip, frame_idx, t_ms, box, method); seen: window_frames, makes(clip, make_ms).

    The best scorer box before the make wins, with a bonus for the ball at hands;
    without one, the last ball holder. Each clip is one aggregate over boxes.
    """
    n = seen.rdd.getNumPartitions()
    f = seen.repartition(n, "clip").join(makes.repartition(n, "clip"), "clip")
    p = f.select("clip", "frame_idx", "t_ms", "make_ms", "balls", F.posexplode("people").alias("pos", "p"))
    hands = F.exists("balls", lambda b: at_hands(box_of("p.box"), box_of(b)))
    p = p.withColumn("hands", hands).withColumn(
        "score", F.col("p.conf") + F.when(F.col("hands"), HANDS_BONUS).otherwise(0.0)
    )
    t, m = F.col("t_ms"), F.col("make_ms")
    scorer = (F.col("p.cls") == "scorer") & t.between(m - SHOT_BEFORE_MS, m - SHOT_AFTER_MS)
    holder = (F.col("p.cls") == "holder") & (t <= m - HOLDER_BEFORE_MS)
    pick = F.struct("frame_idx", "t_ms", F.col("p.box").alias("box"), "hands")
    g = p.groupBy("clip").agg(
        F.max_by(pick, F.when(scorer, F.struct(F.col("score"), -F.col("frame_idx"), -F.col("pos")))).alias("s"),
        F.max_by(pick, F.when(holder, F.struct(F.col("frame_idx"), F.col("p.conf"), F.col("p.box")))).alias("h"),
    )
    best = F.coalesce("s", "h")
    how = F.when(F.col("s.hands"), "scorer+ball").when(F.col("s").isNotNull(), "scorer").otherwise("holder")
    return g.where(best.isNotNull()).select(
        "clip", best["frame_idx"].alias("frame_idx"), best["t_ms"].alias("t_ms"), best["box"].alias("box"), how.alias("method")
    )


def _walk(seq: Column, anchor: Column, start: Column) -> Column:
    """Link boxes frame by frame from the anchor; a frame without rows counts as a miss."""
    link = f"struct<frame_idx:bigint,box:{BOX_TYPE}>"

    def step(s, f):
        gap = s["gap"] + (F.abs(f["frame_idx"] - s["at"]) - 1).cast("int")
        near = F.array_max(F.transform(
            f["people"], lambda p, i: F.struct(iou(box_of(s["cur"]), box_of(p["box"])).alias("v"), (-i).alias("i"), p["box"].alias("box"))
        ))
        hit = (gap <= MAX_MISSES) & F.coalesce(near["v"] > FOLLOW_IOU, F.lit(False))
        return F.struct(
            F.when(hit, near["box"]).otherwise(s["cur"]).alias("cur"),
            F.when(hit, 0).otherwise(gap + 1).alias("gap"), f["frame_idx"].alias("at"),
            F.when(hit, F.concat(s["out"], F.array(F.struct(f["frame_idx"].alias("frame_idx"), near["box"].alias("box")))))
            .otherwise(s["out"]).alias("out"),
        )

    zero = F.struct(anchor.alias("cur"), F.lit(0).alias("gap"), start.alias("at"), F.array().cast(f"array<{link}>").alias("out"))
    return F.aggregate(seq, zero, step)["out"]


def follow(seen: DataFrame, anchors: DataFrame) -> DataFrame:
    """The shooter's box per frame of window_frames, linked by overlap both ways from the anchor: (clip, frame_idx, box)."""
    n = seen.rdd.getNumPartitions()
    f = seen.repartition(n, "clip").groupBy("clip").agg(
        F.sort_array(F.collect_list(F.struct(F.col("frame_idx").cast("bigint").alias("frame_idx"), "people"))).alias("fs")
    )
    j = f.join(anchors.select("clip", F.col("frame_idx").cast("bigint").alias("a"), "box").repartition(n, "clip"), "clip")
    ahead = F.filter("fs", lambda x: x["frame_idx"] > F.col("a"))
    back = F.reverse(F.filter("fs", lambda x: x["frame_idx"] < F.col("a")))
    own = F.array(F.struct(F.col("a").alias("frame_idx"), "box"))
    return j.select("clip", F.inline(F.concat(
        _walk(back, F.col("box"), F.col("a")), own, _walk(ahead, F.col("box"), F.col("a"))
    )))


def clean_frames(track: DataFrame, people: DataFrame) -> DataFrame:
    """Adds `clean`: no other person overlaps the tracked one; people is people_of's output for the same frames."""
    n = people.rdd.getNumPartitions()
    p = people.select("clip", "frame_idx", F.col("box").alias("other")).repartition(n, "clip", "frame_idx")
    v = iou(box_of("box"), box_of("other"))
    j = track.repartition(n, "clip", "frame_idx").join(p, ["clip", "frame_idx"], "left").groupBy("clip", "frame_idx", "box").agg(
        F.coalesce(F.bool_and(~((v >= CLEAR_IOU) & (v < SAME_BOX_IOU))), F.lit(True)).alias("clean")
    )
    return j


def even_spaced_pick(rows: DataFrame, key: str, order: str, k: int = MAX_CROPS) -> DataFrame:
    """At most k rows per key, evenly spaced in order."""
    d = with_rank_order(rows, [key], [order], "_at")
    d = d.join(d.groupBy(key).agg(F.count("*").alias("_n")), key)
    wanted = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor(i * (F.col("_n") - 1) / (k - 1)))
    return d.where((F.col("_n") <= k) | F.array_contains(wanted, F.col("_at") - 1)).select(*rows.columns)


def crop_frames(cleaned: DataFrame) -> DataFrame:
    """Frames to crop: the clean ones, or the whole track when fewer than three are clean."""
    cleaned = cut_lineage(cleaned)
    dealt = cleaned.repartition(cleaned.rdd.getNumPartitions(), "clip")
    enough = dealt.groupBy("clip").agg((F.count_if("clean") >= MIN_CLEAN).alias("_e"))
    usable = dealt.join(enough, "clip").where(~F.col("_e") | F.col("clean")).select(*cleaned.columns)
    return even_spaced_pick(usable, "clip", "frame_idx")


def dominant_box(dets: DataFrame, lengths: DataFrame) -> DataFrame:
    """Median box of the place seen most often, from RIM_SAMPLES frames spread over each recording.

    dets(video_id, frame_idx, conf, x1..y2, seq); lengths(video_id, n_frames).
    """
    picks = F.transform(
        F.sequence(F.lit(0), F.lit(RIM_SAMPLES - 1)), lambda k: F.floor((k + 0.5) * F.col("n_frames") / RIM_SAMPLES)
    )
    wanted = lengths.select("video_id", F.posexplode(picks).alias("k", "frame_idx"))
    b = F.struct(*[F.col(c).cast("double").alias(c) for c in Box._fields])
    best = dets.where(F.col("conf") >= RIM_MIN_CONF).join(wanted, ["video_id", "frame_idx"]).groupBy("video_id", "k").agg(
        F.max_by(b, F.struct(F.col("conf"), -F.col("seq"))).alias("box")
    )
    boxes = best.groupBy("video_id").agg(F.transform(
        F.sort_array(F.collect_list(F.struct("k", "box"))), lambda x: x["box"]).alias("bs"))

    def median(values):
        s, n = F.array_sort(values), F.size(values)
        return (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2

    width = median(F.transform("bs", lambda x: x["x2"] - x["x1"]))
    w = F.col("w")

    def near(a, c):
        return (F.abs((a["x1"] + a["x2"]) / 2 - (c["x1"] + c["x2"]) / 2) < w) & (
            F.abs((a["y1"] + a["y2"]) / 2 - (c["y1"] + c["y2"]) / 2) < w)

    votes = F.transform("bs", lambda a, i: F.struct(
        F.size(F.filter("bs", lambda c: near(a, c))).alias("n"), (-i).alias("i"), a.alias("box")))
    d = boxes.withColumn("w", width).withColumn("anchor", F.array_max(votes)["box"])
    d = d.withColumn("main", F.filter("bs", lambda c: near(F.col("anchor"), c)))
    part = lambda c: F.transform("main", lambda x: x[c])
    return d.select("video_id", *[median(part(c)).alias(c) for c in Box._fields])
