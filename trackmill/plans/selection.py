"""Queries over scored clips: evaluation, stars, reels, strings."""

from pyspark.sql import functions as F

from trackmill.functions import strings
from trackmill.functions.scores import ai_score
from trackmill.operators import evaluate, highlights
from trackmill.plans import bindings as b
from trackmill.plans.registry import query, table
from trackmill.plans.tracks import CALIB, SHOTS, calibrations, shots

SCORED = b.CLIPS + """, scored AS (SELECT video, clip, label = 'goal' AS y, score FROM clips WHERE label IS NOT NULL)"""


def scored(spark, d):
    return b.clips(spark, d).where("label is not null").select(
        "video", "clip", (F.col("label") == "goal").alias("label"), "score"
    )


CURVE = SCORED + """, curve AS (SELECT score AS threshold, pos / n AS precision, pos / p AS recall FROM (
  SELECT score, sum(count(*)) OVER w AS n, sum(count(*) FILTER (y)) OVER w AS pos,
         (SELECT count(*) FILTER (y) FROM scored) AS p FROM scored GROUP BY score WINDOW w AS (ORDER BY score DESC)))"""


@query("pr_curve", f"WITH {CURVE} SELECT * FROM curve")
def pr_curve(spark, d):
    return evaluate.pr_curve(scored(spark, d))


AUC = """area AS (SELECT CAST(sum(CASE WHEN y THEN r END) - max(p) * (max(p) + 1) / 2.0 AS DOUBLE) / (max(p) * max(q)) AS auc
  FROM (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r,
        count(*) FILTER (y) OVER () AS p, count(*) FILTER (NOT y) OVER () AS q FROM scored))"""


@query("auc", f"WITH {SCORED}, {AUC} SELECT round(auc, 9) AS auc FROM area")
def auc(spark, d):
    return evaluate.auc(scored(spark, d)).select(F.round("auc", 9).alias("auc"))


@query("threshold_at_recall", f"""WITH {CURVE} SELECT threshold, precision, recall FROM curve WHERE recall >= 0.98
ORDER BY precision DESC, threshold LIMIT 1""")
def threshold_at_recall(spark, d):
    return evaluate.threshold_at_recall(pr_curve(spark, d))


CUTS = """cand AS (SELECT DISTINCT round(score, 4) AS t FROM scored),
tab AS (SELECT t, count(*) FILTER (y AND score < t) AS hidden, count(*) FILTER (score >= t) AS kept,
        count(*) FILTER (y AND score >= t) AS made, count(*) FILTER (y) AS p FROM cand, scored GROUP BY t),
lo AS (SELECT coalesce(max(t) FILTER (hidden <= 0.05 * p), 0.0) AS lo FROM tab),
cuts AS (SELECT lo, coalesce(min(t) FILTER (t > lo AND kept >= 5 AND made / kept >= 0.85), greatest(lo + 1e-3, 0.5)) AS hi
         FROM lo, tab GROUP BY lo)"""


@query("two_cutoffs", f"WITH {SCORED}, {CUTS} SELECT * FROM cuts")
def two_cutoffs(spark, d):
    return evaluate.two_cutoffs(scored(spark, d))


@query("training_report", f"""WITH {SCORED}, {CUTS}, {AUC}
SELECT lo, hi, count(*) AS n_clips, count(*) FILTER (y) AS n_goals, count(*) FILTER (y AND score < lo) AS n_hidden,
  count(*) FILTER (y AND score >= hi) / nullif(count(*) FILTER (score >= hi), 0) AS precision_at_hi,
  (SELECT round(auc, 3) FROM area) AS auc FROM scored, cuts GROUP BY lo, hi""")
def training_report(spark, d):
    return evaluate.training_report(scored(spark, d))


@query("filter_report", f"""WITH {SCORED} SELECT video, count(*) AS n, count(*) FILTER (y) / count(*) AS precision_before,
  CASE WHEN count(*) FILTER (score >= 0.3) > 0 THEN count(*) FILTER (y AND score >= 0.3) / count(*) FILTER (score >= 0.3)
       ELSE 'NaN'::DOUBLE END AS precision_after,
  count(*) FILTER (score < 0.3) AS n_dropped, count(*) FILTER (y AND score < 0.3) AS n_real_dropped
FROM scored GROUP BY GROUPING SETS ((video), ())""")
def filter_report(spark, d):
    return evaluate.filter_report(scored(spark, d), 0.3)


@query("training_rows", f"""WITH {SHOTS}, lab AS (
  SELECT video_id, clip, CASE min(shot_idx) % 3 WHEN 0 THEN 'goal' WHEN 1 THEN 'no_goal' END AS label, count(*) AS n
  FROM shots GROUP BY 1, 2)
SELECT video_id, clip, shot_idx, f1, f2, label = 'goal' AS label FROM shots JOIN lab USING (video_id, clip)
WHERE label IS NOT NULL AND NOT (n > 1 AND label = 'goal')
  AND video_id IN (SELECT video_id FROM shots GROUP BY 1 HAVING count(*) >= 8)""")
def training_rows(spark, d):
    s = shots(spark, d)
    m = F.min("shot_idx") % 3
    labels = s.groupBy("video_id", "clip").agg(F.when(m == 0, "goal").when(m == 1, "no_goal").alias("label"))
    return evaluate.training_rows(s, labels).select("video_id", "clip", "shot_idx", "f1", "f2", "label")


# ---- ratings and ranking ----------------------------------------------------

ANSWER = """'Sure: {"highlight_score": "' || CASE WHEN clip % 5 = 0 THEN 'high' ELSE CAST(clip % 10 AS VARCHAR) END ||
  '", "difficulty": ' || (n_chars % 5 + 1) || ', "athleticism": "' || (n_chars % 7) ||
  '", "game_context": "' || CASE WHEN n_chars % 4 = 0 THEN 'warm_up' ELSE 'live_game' END || '"} done'"""


def answers(spark, d):
    """Model answers built from each clip's numbers; every 6th clip has no JSON in it."""
    c = b.clips(spark, d)
    text = F.concat(
        F.lit('Sure: {"highlight_score": "'),
        F.when(F.col("clip") % 5 == 0, "high").otherwise((F.col("clip") % 10).cast("string")),
        F.lit('", "difficulty": '), (F.col("n_chars") % 5 + 1).cast("string"), F.lit(', "athleticism": "'),
        (F.col("n_chars") % 7).cast("string"), F.lit('", "game_context": "'),
        F.when(F.col("n_chars") % 4 == 0, "warm_up").otherwise("live_game"), F.lit('"} done'),
    )
    return c.withColumn("answer", F.when(F.col("clip") % 6 != 0, text).otherwise("no idea"))


RATED = b.CLIPS + f""", rated AS (SELECT *, CASE WHEN clip % 6 <> 0 THEN json_extract(
    regexp_extract({ANSWER}, '(?s)(\\{{.*\\}})', 1), '$') END AS j FROM clips),
rate AS (SELECT *, json_extract_string(j, '$.highlight_score') AS hs, json_extract_string(j, '$.difficulty') AS df,
  json_extract_string(j, '$.athleticism') AS ath, json_extract_string(j, '$.game_context') AS gc FROM rated),
goals AS (SELECT lang AS session, video, clip, score, label, source, player, stars AS human_stars, hs, df, ath, gc,
  CASE WHEN j IS NULL THEN 4.0 + 2.0 * score ELSE round(coalesce(TRY_CAST(hs AS DOUBLE), 4.0)
    + 0.25 * (coalesce(TRY_CAST(df AS DOUBLE), 2.0) + coalesce(TRY_CAST(ath AS DOUBLE), 2.0) - 4)
    - CASE WHEN gc = 'warm_up' THEN 1.0 ELSE 0.0 END + 0.5 * score, 3) END AS ai_score
  FROM rate WHERE score >= 0.6)"""


@query("parse_model_json", f"WITH {RATED} SELECT clip, hs AS highlight_score, df AS difficulty, ath AS athleticism, "
       "gc AS game_context FROM rate")
def parse_model_json(spark, d):
    a = answers(spark, d).select("clip", strings.parse_model_json(F.col("answer")).alias("r"))
    return a.select("clip", *[f"r.{c}" for c in ("highlight_score", "difficulty", "athleticism", "game_context")])


def goals(spark, d):
    a = answers(spark, d).where("score >= 0.6").withColumn("rating", strings.parse_model_json(F.col("answer")))
    return a.select(
        F.col("lang").alias("session"), "video", "clip", "score", "label", "source", "player",
        F.col("stars").alias("human_stars"), ai_score(F.col("rating"), F.col("score")).alias("ai_score"),
    )


@query("ai_score", f"WITH {RATED} SELECT clip, round(ai_score, 6) AS ai_score FROM goals")
def ai_scores(spark, d):
    return goals(spark, d).select("clip", F.round("ai_score", 6).alias("ai_score"))


STARRED = RATED + """, ranked AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ai_score DESC, video, clip) AS pos,
  count(*) OVER (PARTITION BY session) AS n FROM goals),
shares AS (SELECT *, greatest(1, round_even(0.15 * n, 0)) AS c5, round_even(0.30 * n, 0) AS c4, round_even(0.30 * n, 0) AS c3,
  round_even(0.15 * n, 0) AS c2 FROM ranked),
starred AS (SELECT session, video, clip, score, ai_score, pos, CASE WHEN pos <= c5 THEN 5 WHEN pos <= c5 + c4 THEN 4
  WHEN pos <= c5 + c4 + c3 THEN 3 WHEN pos <= c5 + c4 + c3 + c2 THEN 2 ELSE 1 END AS stars FROM shares)"""


def starred(spark, d):
    g = goals(spark, d).select("session", "video", "clip", "score", "ai_score")
    return highlights.assign_stars(highlights.rank_goals(g))


@query("assign_stars", f"WITH {STARRED} SELECT session, video, clip, pos, stars FROM starred")
def assign_stars(spark, d):
    return starred(spark, d).select("session", "video", "clip", "pos", "stars")


REEL = STARRED + """, human AS (SELECT video, clip, label, stars AS hstars FROM clips
  WHERE label IS NOT NULL AND source IS DISTINCT FROM 'ai'),
pool AS (SELECT s.*, CASE WHEN label = 'goal' OR score >= 0.8 THEN 0 ELSE 1 END AS phase,
         CASE WHEN label = 'goal' OR score >= 0.8 THEN -coalesce(hstars, stars) ELSE 0 END AS best
  FROM starred s LEFT JOIN human h USING (video, clip) WHERE label IS DISTINCT FROM 'no_goal'),
reel AS (SELECT session, video, clip, pos, phase, row_number() OVER (PARTITION BY session ORDER BY phase, best, pos) AS reel_pos
  FROM (SELECT *, count(*) FILTER (phase = 0) OVER (PARTITION BY session) AS picked FROM pool)
  WHERE phase = 0 OR picked < 150)"""


def reel(spark, d):
    return highlights.reel_candidates(starred(spark, d), b.clips(spark, d), minimum=150)


@query("reel_candidates", f"WITH {REEL} SELECT session, video, clip, phase, reel_pos FROM reel")
def reel_candidates(spark, d):
    return reel(spark, d).select("session", "video", "clip", "phase", "reel_pos")


@query("spread_picks", f"""WITH {STARRED}, t AS (SELECT *, CAST(clip * 13 % 7200 AS DOUBLE) AS at_s FROM starred),
a AS (SELECT *, row_number() OVER (PARTITION BY session, floor(at_s / 1800) ORDER BY pos) AS r FROM t),
p AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY CASE WHEN r <= 3 THEN 0 ELSE 1 END,
  CASE WHEN r <= 3 THEN r ELSE 0 END, CASE WHEN r <= 3 THEN floor(at_s / 1800) ELSE pos END) AS pick_pos FROM a)
SELECT session, video, clip, pick_pos FROM p WHERE pick_pos <= 20""")
def spread_picks(spark, d):
    t = starred(spark, d).withColumn("at_s", (F.col("clip") * 13 % 7200).cast("double"))
    return highlights.spread_picks(t, 1800.0, 20).select("session", "video", "clip", "pick_pos")


RIMS = CALIB + """, rims AS (SELECT 'src' || video_id AS video, x1 * w * 0.99731 AS x1, y1 * h * 0.99731 AS y1,
  x2 * w * 0.99731 AS x2, y2 * h * 0.99731 AS y2, w, h
  FROM calib)"""


def _draw(seed):
    return f"CAST('0x' || substr(md5('{seed}|' || video || '|' || clip), 1, 8) AS BIGINT)"


def _pick(weights, number):
    total, upto, out = sum(w for _, w in weights), 0, "CASE"
    for name, w in weights:
        upto += w
        out += f" WHEN {number} % {total} < {upto} THEN '{name}'"
    return out + " END"


SPREAD_S = 1800


def _edit_sql(variant, seed, spread=False):
    """Sequential restatement of the edit list: a recursive walk over positions."""
    v = highlights.VARIANTS[variant]
    calm = [e for e in v["effects"] if e[0] not in highlights.SLOW_EFFECTS]
    if spread:
        late = "CASE WHEN r <= 3 THEN 0 ELSE 1 END, CASE WHEN r <= 3 THEN r ELSE 0 END, CASE WHEN r <= 3 THEN at_s // 1800 ELSE reel_pos END"
        pick = f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY {late}) AS k
          FROM (SELECT *, row_number() OVER (PARTITION BY session, at_s // {SPREAD_S} ORDER BY reel_pos) AS r
            FROM (SELECT *, clip * 13 % 7200 AS at_s FROM reel))) WHERE k <= {v['count']}"""
        play = "at_s, k"
    elif variant == "fast_cut":
        pick = f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY {_draw(seed)}, video, clip) AS k
          FROM (SELECT *, count(*) OVER (PARTITION BY session) AS n FROM reel)
          WHERE reel_pos <= greatest({v['count'] + 6}, round_even(0.2 * n, 0))) WHERE k <= {v['count']}"""
        play = f"{_draw(seed)}, video, clip"
    else:
        pick = f"SELECT * FROM reel WHERE reel_pos <= {v['count']}"
        play = "video, clip" if variant == "top_plays" else "reel_pos DESC"
    last = "CASE WHEN position = n THEN 'zoom_replay' ELSE effect END" if variant == "countdown" else "effect"
    return f"""WITH RECURSIVE {REEL}, {RIMS}, picked AS ({pick}),
seq AS (SELECT p.session, row_number() OVER (PARTITION BY p.session ORDER BY {play}) AS position,
          count(*) OVER (PARTITION BY p.session) AS n, video, clip,
          round((x1 + x2) / 2 / w * 100, 1) AS rim_x, round((y1 + y2) / 2 / h * 100, 1) AS rim_y,
          {_pick(v['effects'], _draw(seed + 1))} AS eff, {_pick(calm, _draw(seed + 2))} AS calm
        FROM picked p JOIN rims USING (video)),
walk AS (SELECT s.*, eff AS effect FROM seq s WHERE position = 1
  UNION ALL SELECT s.*, CASE WHEN s.eff IN ('replay', 'speed_ramp', 'zoom_replay')
    AND w.effect IN ('replay', 'speed_ramp', 'zoom_replay') THEN s.calm ELSE s.eff END
  FROM walk w JOIN seq s ON s.session = w.session AND s.position = w.position + 1)
SELECT session, position, video, clip, CAST(clip % 60 AS DOUBLE) AS make, CAST({v['pre']} AS DOUBLE) AS pre,
  CAST({v['post']} AS DOUBLE) AS post, rim_x, rim_y, {last} AS effect FROM walk"""


def _edit(spark, d, variant, seed, spread_s=None):
    cal = calibrations(spark, d)
    rims = cal.select(
        F.concat(F.lit("src"), F.col("video_id").cast("string")).alias("video"),
        *[(F.col(c) * F.col(s) * 0.99731).alias(c) for c, s in (("x1", "w"), ("y1", "h"), ("x2", "w"), ("y2", "h"))], "w", "h",
    )
    cand = reel(spark, d).withColumn("make", (F.col("clip") % 60).cast("double"))
    return highlights.reel_edit_list(cand.withColumn("at_s", (F.col("clip") * 13 % 7200).cast("double")), rims, variant, seed, spread_s=spread_s)


@query("reel_spread", _edit_sql("top_plays", 14, spread=True))
def reel_spread(spark, d):
    """Best goals of every half hour, in the session's order."""
    return _edit(spark, d, "top_plays", 14, float(SPREAD_S))


@query("reel_top_plays", _edit_sql("top_plays", 11))
def reel_top_plays(spark, d):
    return _edit(spark, d, "top_plays", 11)


@query("reel_countdown", _edit_sql("countdown", 12))
def reel_countdown(spark, d):
    return _edit(spark, d, "countdown", 12)


@query("reel_fast_cut", _edit_sql("fast_cut", 13))
def reel_fast_cut(spark, d):
    return _edit(spark, d, "fast_cut", 13)


# names of recordings built from orders: dated, invalid or undated
NAME = """CASE o_orderkey % 4 WHEN 0 THEN 'cam' || o_custkey % 17 WHEN 1 THEN 'v_20261399_' || o_custkey
  WHEN 2 THEN 'DJI_' || strftime(o_orderdate + INTERVAL 25 YEAR, '%Y%m%d') || '_' || lpad(CAST(o_custkey % 24 AS VARCHAR), 2, '0') || '0500_D'
  ELSE 'video_' || strftime(o_orderdate + INTERVAL 25 YEAR, '%Y%m%d') || lpad(CAST(o_custkey % 30 AS VARCHAR), 2, '0') || '1530' END"""
NAMED = f"named AS (SELECT o_orderkey, o_custkey, o_custkey % 40 AS session, {NAME} AS video FROM orders)"


def named(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    day = F.date_format(F.add_months(F.col("o_orderdate").cast("date"), 300), "yyyyMMdd")
    key, cust = F.col("o_orderkey") % 4, F.col("o_custkey")
    two = lambda n: F.lpad((cust % n).cast("string"), 2, "0")
    name = (
        F.when(key == 0, F.concat(F.lit("cam"), (cust % 17).cast("string")))
        .when(key == 1, F.concat(F.lit("v_20261399_"), cust.cast("string")))
        .when(key == 2, F.concat(F.lit("DJI_"), day, F.lit("_"), two(24), F.lit("0500_D")))
        .otherwise(F.concat(F.lit("video_"), day, two(30), F.lit("1530")))
    )
    return o.select("o_orderkey", "o_custkey", (cust % 40).alias("session"), name.alias("video"))


START = """CASE WHEN regexp_matches(video, '20\\d{6}[_-]?\\d{6}') THEN CAST(epoch(try_strptime(regexp_replace(
  regexp_extract(video, '(20\\d{6}[_-]?\\d{6})', 1), '[_-]', ''), '%Y%m%d%H%M%S')) AS BIGINT) END"""


@query("recording_start", f"WITH {NAMED} SELECT o_orderkey, {START} AS start_s FROM named")
def recording_start(spark, d):
    return named(spark, d).select("o_orderkey", strings.recording_start(F.col("video")).alias("start_s"))


@query("session_of", f"""WITH {NAMED} SELECT o_orderkey, coalesce(nullif(regexp_extract(video, '(20\\d{{6}})', 1), ''), video) AS session
FROM named""")
def session_of(spark, d):
    return named(spark, d).select("o_orderkey", strings.session_of(F.col("video")).alias("session"))


@query("session_title", f"""WITH {NAMED}, dated AS (SELECT session, video,
  CAST(try_strptime(nullif(regexp_extract(video, '(20\\d{{6}})', 1), ''), '%Y%m%d') AS DATE) AS dt FROM named),
f AS (SELECT session, arg_min(dt, video) FILTER (dt IS NOT NULL) AS dt FROM dated GROUP BY 1)
SELECT session, coalesce(upper(dayname(dt)) || ' RUN', 'HIGHLIGHTS') AS title,
  coalesce(strftime(dt, '%-d %b %Y'), CAST(session AS VARCHAR)) AS subtitle FROM f""")
def session_title(spark, d):
    return highlights.session_title(named(spark, d))


@query("session_times", f"""WITH {NAMED}, {b.CLUSTERED},
firsts AS (SELECT 'cam' || video_id % 17 AS video, shot_no, min(t_ms) % 1000000 AS first_ms FROM clustered GROUP BY 1, 2),
g AS (SELECT session, video, 'shot_' || lpad(CAST(o_orderkey % 20 AS VARCHAR), 3, '0') AS clip, o_orderkey FROM named),
v AS (SELECT session, video, st, min(st) OVER (PARTITION BY session) AS first, max(st) OVER (PARTITION BY session) AS last,
  row_number() OVER (PARTITION BY session ORDER BY video) - 1 AS i
  FROM (SELECT DISTINCT session, video, {START} AS st FROM named))
SELECT o_orderkey, coalesce(st, CASE WHEN last IS NULL THEN 0 ELSE last + 86400 END + i * 86400) - coalesce(first, 0)
  + coalesce(first_ms / 1000, 0.0) AS at_s
FROM g JOIN v USING (session, video) LEFT JOIN firsts f ON f.video = g.video AND f.shot_no = o_orderkey % 20""")
def session_times(spark, d):
    from trackmill.operators import events as ev

    g = named(spark, d).select(
        "session", "video", "o_orderkey",
        F.concat(F.lit("shot_"), F.lpad((F.col("o_orderkey") % 20).cast("string"), 3, "0")).alias("clip"),
    )
    c = ev.cluster_events(b.timed(spark, d, "purchase"), 6 * b.HOUR_MS, block_ms=24 * b.HOUR_MS)
    firsts = c.groupBy(F.concat(F.lit("cam"), (F.col("video_id") % 17).cast("string")).alias("video"), "shot_no").agg(
        (F.min("t_ms") % 1000000).alias("first_ms")
    )
    return highlights.session_times(g, firsts).select("o_orderkey", "at_s")


@query("session_summary", f"""WITH {STARRED} SELECT lang AS session, count(*) AS n_clips, count(s.clip) AS n_goals,
  count(s.clip) FILTER (c.clip % 6 <> 0) AS n_rated, count(*) FILTER (s.stars = 5) AS star5, count(*) FILTER (s.stars = 4) AS star4,
  count(*) FILTER (s.stars = 3) AS star3, count(*) FILTER (s.stars = 2) AS star2, count(*) FILTER (s.stars = 1) AS star1
FROM clips c LEFT JOIN starred s ON s.clip = c.clip GROUP BY 1""")
def session_summary(spark, d):
    g = starred(spark, d).withColumn("rated", F.col("clip") % 6 != 0)
    return highlights.session_summary(b.clips(spark, d).withColumnRenamed("lang", "session"), g)
