"""Queries over person detections."""

from pyspark.sql import functions as F

from trackmill.functions import geometry as g
from trackmill.operators import people
from trackmill.plans.registry import query, table

MAKE_MS = 3000


def detections(spark, d, *extra):
    """lineitem -> boxes in the frames of a clip (50 orders each)."""
    k, p, s = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey")
    kind = s % 6
    cls = F.when(kind <= 1, "player").when(kind <= 3, "scorer").when(kind == 4, "holder").otherwise("ball")
    x1, y1 = p % 12 * 9, p % 5 * 6
    size = F.when(kind == 5, 8).otherwise(60)
    return table(spark, d, "lineitem").select(
        F.expr("l_orderkey div 50").alias("clip"), (k % 50).alias("frame_idx"), (k % 50 * 67).alias("t_ms"),
        cls.alias("cls"), (0.2 + F.col("l_discount") * 7).alias("conf"),
        F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("seq"),
        x1.cast("double").alias("x1"), y1.cast("double").alias("y1"),
        (x1 + size + p % 4).cast("double").alias("x2"), (y1 + size * 2 + s % 4).cast("double").alias("y2"), *extra,
    )


def makes(spark, d):
    return detections(spark, d).select("clip").distinct().withColumn("make_ms", F.lit(MAKE_MS))


BOXES = """bx AS (SELECT l_orderkey // 50 AS clip, l_orderkey % 50 AS frame_idx, l_partkey, l_suppkey, l_linenumber, l_extendedprice,
  0.2 + l_discount * 7 AS conf, CAST(l_partkey % 12 * 9 AS DOUBLE) AS x1, CAST(l_partkey % 5 * 6 AS DOUBLE) AS y1,
  CAST(l_partkey % 12 * 9 + CASE WHEN l_suppkey % 6 = 5 THEN 8 ELSE 60 END + l_partkey % 4 AS DOUBLE) AS x2,
  CAST(l_partkey % 5 * 6 + CASE WHEN l_suppkey % 6 = 5 THEN 8 ELSE 60 END * 2 + l_suppkey % 4 AS DOUBLE) AS y2 FROM lineitem)"""


def overlap_sql(a, b):
    """Intersection over union of two boxes in SQL."""
    w = f"greatest(0.0, least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1))"
    h = f"greatest(0.0, least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1))"
    area = lambda q: f"({q}.x2 - {q}.x1) * ({q}.y2 - {q}.y1)"
    return f"(({w} * {h}) / ({area(a)} + {area(b)} - {w} * {h} + 1e-9))"


RANK = lambda c: f"CASE {c} WHEN 'scorer' THEN 2 WHEN 'holder' THEN 1 ELSE 0 END"
KIND = "CASE WHEN l_suppkey % 6 <= 1 THEN 'player' WHEN l_suppkey % 6 <= 3 THEN 'scorer' WHEN l_suppkey % 6 = 4 THEN 'holder' ELSE 'ball' END"
# people of a frame, most confident first, taken up one by one: a box near an earlier one only lends it its class
MERGE = f"""{BOXES}, det AS (SELECT clip, frame_idx, frame_idx * 67 AS t_ms, {KIND} AS cls, conf,
    CAST(round(l_extendedprice * 100) AS BIGINT) AS seq, {{'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}} AS box FROM bx),
person AS (SELECT *, row_number() OVER (PARTITION BY clip, frame_idx ORDER BY conf DESC, seq, cls, box) AS rn FROM det WHERE cls <> 'ball'),
fold AS (SELECT clip, frame_idx, rn, [{{'cls': cls, 'conf': conf, 'box': box}}] AS found FROM person WHERE rn = 1
  UNION ALL SELECT clip, frame_idx, rn, CASE WHEN place IS NULL OR place = 0 THEN found || [{{'cls': cls, 'conf': conf, 'box': box}}]
    ELSE list_transform(found, lambda o, i: CASE WHEN i = place AND {RANK('cls')} > {RANK('o.cls')} THEN {{'cls': cls, 'conf': conf, 'box': o.box}} ELSE o END) END
  FROM (SELECT f.clip, f.frame_idx, p.rn, f.found, p.cls, p.conf, p.box,
      list_position(list_transform(f.found, lambda o: {overlap_sql('p.box', 'o.box')} >= 0.7), true) AS place
    FROM fold f JOIN person p ON p.clip = f.clip AND p.frame_idx = f.frame_idx AND p.rn = f.rn + 1)),
merged AS (SELECT clip, frame_idx, arg_max(found, rn) AS people FROM fold GROUP BY 1, 2),
one AS (SELECT clip, frame_idx, frame_idx * 67 AS t_ms, i - 1 AS pos, people[i].cls AS cls, people[i].conf AS conf, people[i].box AS box
  FROM merged, range(1, 200) r(i) WHERE i <= len(people))"""
HANDS = """EXISTS (SELECT 1 FROM det b WHERE b.clip = o.clip AND b.frame_idx = o.frame_idx AND b.cls = 'ball' AND b.conf > 0.25
    AND (b.box.x1 + b.box.x2) / 2 BETWEEN o.box.x1 - (o.box.x2 - o.box.x1) * 0.15 AND o.box.x2 + (o.box.x2 - o.box.x1) * 0.15
    AND (b.box.y1 + b.box.y2) / 2 BETWEEN o.box.y1 - (o.box.y2 - o.box.y1) * 0.15 AND o.box.y1 + (o.box.y2 - o.box.y1) * 0.6)"""
PICK = f"""{MERGE}, seen AS (SELECT o.*, {HANDS} AS hands FROM one o WHERE t_ms >= {MAKE_MS - 3500} AND t_ms < {MAKE_MS + 300}),
scorer AS (SELECT clip, arg_max({{'f': frame_idx, 'b': box, 'h': hands}}, (conf + CASE WHEN hands THEN 0.5 ELSE 0.0 END, -frame_idx, -pos)) AS s
  FROM seen WHERE cls = 'scorer' AND t_ms BETWEEN {MAKE_MS - 2800} AND {MAKE_MS - 150} GROUP BY 1),
holder AS (SELECT clip, arg_max({{'f': frame_idx, 'b': box}}, (frame_idx, conf, box)) AS h FROM seen WHERE cls = 'holder' AND t_ms <= {MAKE_MS - 300} GROUP BY 1),
picked AS (SELECT clip, coalesce(s.f, h.f) AS frame_idx, coalesce(s.f, h.f) * 67 AS t_ms, coalesce(s.b, h.b) AS box,
  CASE WHEN s IS NULL THEN 'holder' WHEN s.h THEN 'scorer+ball' ELSE 'scorer' END AS method FROM scorer FULL JOIN holder USING (clip))"""
# from the anchor one frame after the other, either way; the nearest box continues the track while at most three frames were missed
WALK = f"""{PICK}, frame AS (SELECT clip, frame_idx, people FROM (SELECT DISTINCT clip, frame_idx FROM det WHERE t_ms >= {MAKE_MS - 3500} AND t_ms < {MAKE_MS + 300})
  LEFT JOIN merged USING (clip, frame_idx)),
way AS (SELECT f.clip, sign(f.frame_idx - p.frame_idx) AS dir, f.frame_idx, people, row_number() OVER (PARTITION BY f.clip, f.frame_idx > p.frame_idx
    ORDER BY abs(f.frame_idx - p.frame_idx)) AS k FROM frame f JOIN picked p ON p.clip = f.clip AND p.frame_idx <> f.frame_idx),
walk AS (SELECT clip, dir, 0 AS k, frame_idx, box, 0 AS gap, false AS hit FROM picked, (VALUES (1), (-1)) v(dir)
  UNION ALL SELECT clip, dir, k, frame_idx, CASE WHEN ok THEN near ELSE box END, CASE WHEN ok THEN 0 ELSE missed + 1 END, ok
  FROM (SELECT *, missed <= 3 AND coalesce({overlap_sql('box', 'near')} > 0.35, false) AS ok
    FROM (SELECT *, people[list_position(scores, list_max(scores))].box AS near
      FROM (SELECT w.clip, w.dir, y.k, y.frame_idx, w.box, y.people, w.gap + abs(y.frame_idx - w.frame_idx) - 1 AS missed,
          list_transform(y.people, lambda o: {overlap_sql('w.box', 'o.box')}) AS scores
        FROM walk w JOIN way y ON y.clip = w.clip AND y.dir = w.dir AND y.k = w.k + 1)))),
track AS (SELECT clip, frame_idx, box FROM walk WHERE hit UNION ALL SELECT clip, frame_idx, box FROM picked)"""
CLEAN = f"""{WALK}, clean AS (SELECT t.clip, t.frame_idx, t.box, coalesce(bool_and(NOT ({overlap_sql('t.box', 'o.box')} >= 0.15 AND {overlap_sql('t.box', 'o.box')} < 0.7)), true) AS clean
  FROM track t LEFT JOIN one o ON o.clip = t.clip AND o.frame_idx = t.frame_idx GROUP BY 1, 2, 3)"""
CROPS = f"""{CLEAN}, usable AS (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY frame_idx) - 1 AS a, count(*) OVER (PARTITION BY clip) AS n
  FROM (SELECT *, count(*) FILTER (clean) OVER (PARTITION BY clip) AS good FROM clean) WHERE clean OR good < 3)"""


def as_parts(df):
    """Boxes as four columns."""
    return df.select(*[c for c in df.columns if c != "box"], *[F.col(f"box.{c}").alias(c) for c in g.Box._fields])


PARTS = "box.x1 AS x1, box.y1 AS y1, box.x2 AS x2, box.y2 AS y2"


@query("merge_people", f"WITH RECURSIVE {MERGE} SELECT clip, frame_idx, t_ms, pos, cls, conf, {PARTS} FROM one")
def merge_people(spark, d):
    return as_parts(people.merge_people(detections(spark, d)))


@query("pick_shooter", f"WITH RECURSIVE {PICK} SELECT clip, frame_idx, t_ms, method, {PARTS} FROM picked")
def pick_shooter(spark, d):
    m = makes(spark, d)
    return as_parts(people.pick_shooter(people.window_frames(detections(spark, d), m), m))


def followed(spark, d):
    """The frames of all windows, and the shooter's track through them."""
    m = makes(spark, d)
    seen = people.window_frames(detections(spark, d), m)
    return seen, people.follow(seen, people.pick_shooter(seen, m))


@query("follow", f"WITH RECURSIVE {WALK} SELECT clip, frame_idx, {PARTS} FROM track")
def follow(spark, d):
    return as_parts(followed(spark, d)[1])


def cleaned(spark, d):
    seen, track = followed(spark, d)
    return people.clean_frames(track, people.people_of(seen))


@query("clean_frames", f"WITH RECURSIVE {CLEAN} SELECT clip, frame_idx, clean, {PARTS} FROM clean")
def clean_frames(spark, d):
    return as_parts(cleaned(spark, d))


@query("even_spaced_crops", f"""WITH RECURSIVE {CROPS} SELECT clip, frame_idx, clean, {PARTS} FROM usable
WHERE n <= 12 OR a IN (SELECT i * (n - 1) // 11 FROM range(12) r(i))""")
def even_spaced_crops(spark, d):
    return as_parts(people.crop_frames(cleaned(spark, d)))


@query("even_spaced_pick", """WITH t AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS a,
  count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
SELECT o_custkey, o_orderkey FROM t WHERE n <= 12 OR a IN (SELECT i * (n - 1) // 11 FROM range(12) r(i))""")
def even_spaced_pick(spark, d):
    return people.even_spaced_pick(table(spark, d, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey")


@query("iou", f"""WITH {BOXES}, p AS (SELECT clip, frame_idx, l_extendedprice, x1, y1, x2, y2, p_size % 12 * 9 + 1.0 AS u1, p_size % 5 * 6.0 AS v1,
    p_size % 12 * 9 + 45.0 AS u2, p_size % 5 * 6 + 70.0 AS v2 FROM bx JOIN part ON p_partkey = l_partkey),
i AS (SELECT *, greatest(0.0, least(x2, u2) - greatest(x1, u1)) * greatest(0.0, least(y2, v2) - greatest(y1, v1)) AS inter FROM p)
SELECT clip, frame_idx, CAST(l_extendedprice * 100 AS BIGINT) AS seq,
  round(inter / ((x2 - x1) * (y2 - y1) + (u2 - u1) * (v2 - v1) - inter + 1e-9), 9) AS iou,
  (u1 + u2) / 2 BETWEEN x1 - (x2 - x1) * 0.15 AND x2 + (x2 - x1) * 0.15
    AND (v1 + v2) / 2 BETWEEN y1 - (y2 - y1) * 0.15 AND y1 + (y2 - y1) * 0.6 AS at_hands FROM i""")
def iou(spark, d):
    """Overlap and ball-at-hands test of each box with the one of its part."""
    a = detections(spark, d, "l_partkey").select("l_partkey", "clip", "frame_idx", "seq", *g.Box._fields)
    x, y = F.col("p_size") % 12 * 9, F.col("p_size") % 5 * 6
    o = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), *[
        v.cast("double").alias(n) for v, n in ((x + 1, "u1"), (y, "v1"), (x + 45, "u2"), (y + 70, "v2"))])
    me, other = g.box("x1", "y1", "x2", "y2"), g.box("u1", "v1", "u2", "v2")
    return a.join(o, "l_partkey").select(
        "clip", "frame_idx", "seq", F.round(g.iou(me, other), 9).alias("iou"), g.at_hands(me, other).alias("at_hands"))


@query("dominant_box", f"""WITH {BOXES}, n AS (SELECT clip, max(frame_idx) + 1 AS nf FROM bx GROUP BY 1),
want AS (SELECT clip, k, CAST(floor((k + 0.5) * nf / 15) AS BIGINT) AS frame_idx FROM n, range(15) r(k)),
best AS (SELECT clip, k, arg_max({{'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}, (conf, -CAST(l_extendedprice * 100 AS BIGINT))) AS b
  FROM bx JOIN want USING (clip, frame_idx) WHERE conf >= 0.5 GROUP BY 1, 2),
wd AS (SELECT clip, median(b.x2 - b.x1) AS w FROM best GROUP BY 1),
pr AS (SELECT a.clip, a.k, c.b AS cb FROM best a JOIN best c USING (clip) JOIN wd USING (clip)
  WHERE abs((a.b.x1 + a.b.x2) / 2 - (c.b.x1 + c.b.x2) / 2) < w AND abs((a.b.y1 + a.b.y2) / 2 - (c.b.y1 + c.b.y2) / 2) < w),
an AS (SELECT clip, arg_max(k, (n, -k)) AS k FROM (SELECT clip, k, count(*) AS n FROM pr GROUP BY 1, 2) GROUP BY 1)
SELECT clip AS video_id, median(cb.x1) AS x1, median(cb.y1) AS y1, median(cb.x2) AS x2, median(cb.y2) AS y2
FROM pr JOIN an USING (clip, k) GROUP BY 1""")
def dominant_box(spark, d):
    det = detections(spark, d).withColumnRenamed("clip", "video_id")
    n = det.groupBy("video_id").agg((F.max("frame_idx") + 1).alias("n_frames"))
    return people.dominant_box(det, n)
