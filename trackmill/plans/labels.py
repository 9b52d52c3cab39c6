"""Queries over label actions, stores, views and datasets."""

from pyspark.sql import functions as F

from trackmill.functions import strings
from trackmill.operators import labels as lab
from trackmill.plans import bindings as b
from trackmill.plans.registry import query, table

ACTIONS = """acts AS (
  SELECT conv_id // 4 AS clip, conv_id AS ts, turn AS seq, length(text) AS len, (length(text) * 7 + turn * 3 + conv_id) % 12 AS k
  FROM conversations),
actions AS (SELECT clip, ts, seq,
  CASE WHEN k <= 3 THEN 'label' WHEN k <= 5 THEN 'bulk' WHEN k = 6 THEN 'star' WHEN k = 7 THEN 'scorer' WHEN k = 8 THEN 'assist'
       WHEN k = 9 THEN 'name_group' WHEN k = 10 THEN 'label' ELSE 'delete' END AS action,
  CASE WHEN k IN (0, 1, 3, 4) THEN 'goal' WHEN k IN (2, 5) THEN 'no_goal' END AS label,
  CASE WHEN k = 3 THEN 1 + len % 5 WHEN k = 6 AND len % 8 > 0 THEN len % 7 END AS stars,
  CASE WHEN k IN (3, 7, 9) THEN CASE WHEN len % 9 = 0 THEN ' ' ELSE ' P' || (len % 4) || ' ' END END AS scorer,
  CASE WHEN k = 8 THEN 'A' || (len % 4) END AS assist,
  CASE WHEN k IN (4, 5) AND len % 2 = 0 THEN 'ai' END AS source FROM acts)"""

# a sequential walk over each clip's actions, one at a time
FOLD = ACTIONS + """, ord AS (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY ts, seq) AS n FROM actions),
walk AS (
  SELECT clip, CAST(0 AS BIGINT) AS n, CAST(NULL AS VARCHAR) AS label, CAST(NULL AS BIGINT) AS labeled_at,
    CAST(NULL AS VARCHAR) AS source, CAST(NULL AS BIGINT) AS stars, CAST(NULL AS BIGINT) AS rated_at,
    CAST(NULL AS VARCHAR) AS scorer, CAST(NULL AS VARCHAR) AS assist FROM (SELECT DISTINCT clip FROM ord)
  UNION ALL
  SELECT clip, n,
    CASE WHEN dele THEN NULL WHEN lab THEN alabel WHEN newbulk THEN alabel WHEN newname THEN 'goal' ELSE label END,
    CASE WHEN dele THEN NULL WHEN lab OR newbulk THEN ts WHEN newname THEN NULL ELSE labeled_at END,
    CASE WHEN dele OR lab THEN NULL WHEN newbulk THEN asource WHEN newname THEN 'ai' ELSE source END,
    CASE WHEN dele OR newbulk OR newname THEN NULL
         WHEN lab THEN CASE WHEN alabel = 'goal' THEN coalesce(astars, stars) END
         WHEN star THEN astars ELSE stars END,
    CASE WHEN dele OR newbulk OR newname THEN NULL WHEN lab THEN CASE WHEN astars IS NOT NULL THEN ts END
         WHEN star THEN ts ELSE rated_at END,
    CASE WHEN dele OR newbulk THEN NULL WHEN lab THEN CASE WHEN alabel = 'goal' THEN coalesce(ascorer, scorer) END
         WHEN tag THEN ascorer WHEN newname OR named THEN ascorer ELSE scorer END,
    CASE WHEN dele OR newbulk OR newname THEN NULL WHEN lab THEN CASE WHEN alabel = 'goal' THEN assist END
         WHEN help THEN aassist ELSE assist END
  FROM (
    SELECT o.clip, o.n, o.ts, o.label AS alabel, o.source AS asource, o.stars AS astars, o.assist AS aassist,
      nullif(trim(o.scorer), '') AS ascorer, w.label, w.labeled_at, w.source, w.stars, w.rated_at, w.scorer, w.assist,
      o.action = 'delete' OR (o.action = 'label' AND o.label IS NULL) AS dele,
      o.action = 'label' AND o.label IS NOT NULL AND (o.scorer IS NULL OR trim(o.scorer) <> '') AS lab,
      o.action = 'bulk' AND w.label IS NULL AS newbulk,
      o.action = 'name_group' AND trim(o.scorer) <> '' AND w.label IS NULL AS newname,
      o.action = 'name_group' AND trim(o.scorer) <> '' AND w.label IS NOT DISTINCT FROM 'goal' AS named,
      o.action = 'star' AND w.label IS NOT DISTINCT FROM 'goal' AND (o.stars IS NULL OR o.stars BETWEEN 1 AND 5) AS star,
      o.action = 'scorer' AND w.label IS NOT DISTINCT FROM 'goal' AS tag,
      o.action = 'assist' AND w.label IS NOT DISTINCT FROM 'goal' AS help
    FROM walk w JOIN ord o ON o.clip = w.clip AND o.n = w.n + 1)),
folded AS (SELECT clip, label, labeled_at, source, stars, rated_at, scorer, assist FROM walk
  WHERE label IS NOT NULL AND (clip, n) IN (SELECT (clip, max(n)) FROM ord GROUP BY clip))"""


def actions(spark, d):
    """conversations -> label actions: the text's length and turn pick kind and arguments."""
    c = table(spark, d, "conversations")
    n = F.length("text")
    k = F.col("k")
    c = c.select(
        F.expr("conv_id div 4").alias("clip"), F.col("conv_id").alias("ts"), F.col("turn").alias("seq"), n.alias("len"),
        ((n * 7 + F.col("turn") * 3 + F.col("conv_id")) % 12).alias("k"),
    )
    kind = (
        F.when(k <= 3, "label").when(k <= 5, "bulk").when(k == 6, "star").when(k == 7, "scorer").when(k == 8, "assist")
        .when(k == 9, "name_group").when(k == 10, "label").otherwise("delete")
    )
    return c.select(
        "clip", "ts", "seq", kind.alias("action"),
        F.when(k.isin(0, 1, 3, 4), "goal").when(k.isin(2, 5), "no_goal").alias("label"),
        F.when(k == 3, 1 + F.col("len") % 5).when((k == 6) & (F.col("len") % 8 > 0), F.col("len") % 7).alias("stars"),
        F.when(k.isin(3, 7, 9), F.when(F.col("len") % 9 == 0, " ").otherwise(
            F.concat(F.lit(" P"), (F.col("len") % 4).cast("string"), F.lit(" ")))).alias("scorer"),
        F.when(k == 8, F.concat(F.lit("A"), (F.col("len") % 4).cast("string"))).alias("assist"),
        F.when(k.isin(4, 5) & (F.col("len") % 2 == 0), "ai").alias("source"),
    )


@query("fold_label_actions", f"WITH RECURSIVE {FOLD} SELECT * FROM folded")
def fold_label_actions(spark, d):
    return lab.fold_label_actions(actions(spark, d))


@query("human_only", f"WITH {b.CLIPS} SELECT video, clip, label FROM clips WHERE label IS NOT NULL AND source IS DISTINCT FROM 'ai'")
def human_only(spark, d):
    return lab.human_only(b.clips(spark, d)).select("video", "clip", "label")


@query("bulk_counts", f"""WITH {b.CLIPS} SELECT count(*) FILTER (label IS NULL) AS labeled,
  count(*) FILTER (label IS NOT NULL) AS skipped FROM clips WHERE score < 0.2""")
def bulk_counts(spark, d):
    c = b.clips(spark, d)
    return lab.bulk_counts(c.where("label is not null"), c.where("score < 0.2"))


@query("merge_accounts", f"""WITH {b.CLIPS} SELECT lang || '/' || clip AS clip, label, source, stars FROM clips WHERE label IS NOT NULL""")
def merge_accounts(spark, d):
    c = b.clips(spark, d).where("label is not null").select("lang", "clip", "label", "source", "stars")
    return lab.merge_accounts(c, account="lang")


@query("merge_rosters", """SELECT DISTINCT trim(n) AS name FROM (
  SELECT ' ' || c_mktsegment || '  ' AS n FROM customer UNION ALL SELECT lower(p_brand) || ' ' FROM part
  UNION ALL SELECT CASE WHEN p_size % 2 = 0 THEN '  ' ELSE p_type END FROM part) WHERE trim(n) <> ''""")
def merge_rosters(spark, d):
    cust, part = table(spark, d, "customer"), table(spark, d, "part")
    return lab.merge_rosters(
        cust.select(F.concat(F.lit(" "), "c_mktsegment", F.lit("  ")).alias("name")),
        part.select(F.concat(F.lower("p_brand"), F.lit(" ")).alias("name")),
        part.select(F.when(F.col("p_size") % 2 == 0, "  ").otherwise(F.col("p_type")).alias("name")),
    )


@query("overlay_labels", f"""WITH {b.CLIPS}, base AS (SELECT CAST(clip AS VARCHAR) AS clip, label, stars FROM clips WHERE label IS NOT NULL),
extra AS (SELECT clip, CASE WHEN score > 0.5 THEN 'goal' ELSE 'no_goal' END AS label, CAST(NULL AS BIGINT) AS stars
          FROM clips WHERE clip % 3 = 0)
SELECT coalesce(b.clip, CAST(e.clip AS VARCHAR)) AS clip, CASE WHEN e.clip IS NOT NULL THEN e.label ELSE b.label END AS label,
  CASE WHEN e.clip IS NULL THEN b.stars END AS stars
FROM base b FULL JOIN extra e ON b.clip = CAST(e.clip AS VARCHAR)""")
def overlay_labels(spark, d):
    c = b.clips(spark, d)
    base = c.where("label is not null").select(F.col("clip").cast("string").alias("clip"), "label", "stars")
    pre = F.when(F.col("clip") % 3 == 0, "mine/").otherwise("other/")
    extra = c.select(
        F.concat(pre, F.col("clip").cast("string")).alias("clip"),
        F.when(F.col("score") > 0.5, "goal").otherwise("no_goal").alias("label"), F.lit(None).cast("int").alias("stars"),
    )
    return lab.overlay_labels(base, extra, "mine/")


@query("pending", f"""WITH {b.CLIPS} SELECT video, clip FROM clips
WHERE clip NOT IN (SELECT doc_id FROM labels WHERE quality = 1)""")
def pending(spark, d):
    done = table(spark, d, "labels").select(
        F.col("doc_id").alias("clip"), F.when(F.col("quality") == 1, "v2").otherwise("v1").alias("method")
    )
    return lab.pending(b.clips(spark, d).select("video", "clip"), done, ["clip"], "v2")


VIEW = b.CLIPS + """, vid AS (SELECT *, CAST(substr(video, 4) AS BIGINT) AS vn FROM clips),
view AS (SELECT video, clip, CASE WHEN clip % 2 = 0 THEN score * 0.5 END AS filter_score, CASE WHEN vn % 4 <> 1 THEN score END AS make_score,
  vn % 3 <> 0 AS ai_rated, CASE WHEN vn % 3 <> 0 AND score >= 0.6 THEN clip % 5 + 1 END AS ai_stars,
  vn % 3 <> 0 AND score >= 0.6 AND clip % 2 = 0 AS ai_reel,
  CASE WHEN vn % 3 <> 0 AND score >= 0.6 AND clip % 4 = 0 THEN player END AS ai_scorer,
  label, stars, CASE WHEN label = 'goal' AND clip % 3 = 0 THEN player END AS scorer, CAST(NULL AS VARCHAR) AS assist, source AS label_source
  FROM vid)"""


def view_parts(spark, d):
    c = b.clips(spark, d).withColumn("vn", F.substring("video", 4, 20).cast("bigint"))
    rated = c.where("vn % 3 <> 0")
    sug = rated.where("score >= 0.6").select(
        "video", "clip", (F.col("clip") % 5 + 1).alias("stars"), (F.col("clip") % 2 == 0).alias("reel"),
        F.when(F.col("clip") % 4 == 0, F.col("player")).alias("scorer"),
    )
    labels = c.where("label is not null").select(
        "video", "clip", "label", "stars",
        F.when((F.col("label") == "goal") & (F.col("clip") % 3 == 0), F.col("player")).alias("scorer"),
        F.lit(None).cast("string").alias("assist"), "source",
    )
    return dict(
        clips=c, filter_scores=c.where("clip % 2 = 0").select("video", "clip", (F.col("score") * 0.5).alias("score")),
        make_scores=c.where("vn % 4 <> 1").select("video", "clip", "score"), suggestions=sug,
        rated_videos=rated.select("video").distinct(), labels=labels,
    )


@query("clip_view", f"WITH {VIEW} SELECT * FROM view")
def clip_view(spark, d):
    return lab.clip_view(**view_parts(spark, d))


@query("goal_clips", f"""WITH {VIEW} SELECT video, clip FROM view WHERE CASE WHEN label IS NOT NULL THEN label = 'goal'
  ELSE make_score IS NULL OR make_score >= 0.6 END""")
def goal_clips(spark, d):
    p = view_parts(spark, d)
    return lab.goal_clips(p["clips"], p["labels"], p["make_scores"])


FLAT = "video || '__' || clip || coalesce('_' || {s} || 'star', '') || coalesce('_' || replace({p}, ' ', ''), '')"
INVENTORY = "clip % 10 <> 9"
DATASET = VIEW + f""", ds AS (SELECT *, CASE WHEN label = 'goal' AND coalesce(stars, 0) < 2 THEN 'below_min_stars'
  WHEN label = 'goal' AND scorer IS DISTINCT FROM 'P 3' THEN 'not_this_player' WHEN NOT ({INVENTORY}) THEN 'missing'
  ELSE label END AS reason FROM view WHERE label IS NOT NULL)"""


@query("dataset_manifest", f"""WITH {VIEW} SELECT video, clip, label,
  CASE WHEN label = 'goal' THEN coalesce(stars || 'star', 'unrated') END AS star_bin,
  {FLAT.format(s='stars', p='scorer')} AS name FROM view
WHERE label IS NOT NULL AND {INVENTORY} AND (label <> 'goal' OR coalesce(stars, 0) >= 2)""")
def dataset_manifest(spark, d):
    p = view_parts(spark, d)
    return lab.dataset_manifest(p["labels"], p["clips"].where(INVENTORY), min_stars=2, by_stars=True)


@query("dataset_counts", f"""WITH {DATASET} SELECT count(*) FILTER (reason = 'goal') AS goal, count(*) FILTER (reason = 'no_goal') AS no_goal,
  count(*) FILTER (reason = 'missing') AS missing, count(*) FILTER (reason = 'below_min_stars') AS below_min_stars,
  count(*) FILTER (reason = 'not_this_player') AS not_this_player,
  count(*) FILTER (label = 'goal' AND stars = 1) AS star1, count(*) FILTER (label = 'goal' AND stars = 2) AS star2,
  count(*) FILTER (label = 'goal' AND stars = 3) AS star3, count(*) FILTER (label = 'goal' AND stars = 4) AS star4,
  count(*) FILTER (label = 'goal' AND stars = 5) AS star5, count(*) FILTER (label = 'goal' AND stars IS NULL) AS unrated FROM ds""")
def dataset_counts(spark, d):
    p = view_parts(spark, d)
    return lab.dataset_counts(p["labels"], p["clips"].where(INVENTORY), min_stars=2, player="P 3")


@query("export_path", f"""WITH {VIEW} SELECT clip, {FLAT.format(s='stars', p='scorer')} AS flat,
  CASE WHEN scorer IS NOT NULL THEN replace(scorer, ' ', '') ELSE '_no_scorer' END || '/' || {FLAT.format(s='stars', p='NULL')} AS by_scorer
FROM view""")
def export_path(spark, d):
    p = view_parts(spark, d)
    v = p["clips"].select("video", "clip").join(p["labels"], ["video", "clip"], "left")
    args = [F.col(c) for c in ("label", "video", "clip", "stars", "scorer")]
    return v.select("clip", lab.export_path(*args, False).alias("flat"), lab.export_path(*args, True).alias("by_scorer"))


GROUPS = VIEW + """, grp AS (SELECT video, clip, substr(video, 1, 4) AS session, substr(video, 1, 4) || '-' || clip % 5 AS grp,
  CASE WHEN clip % 5 < 3 THEN 'N' || clip % 5 END AS suggested FROM view WHERE make_score >= 0.6)"""


def groups(spark, d):
    """clips -> grouped goals: session from the recording's name, group from the clip number."""
    g = F.col("clip") % 5
    return view_parts(spark, d)["make_scores"].where("score >= 0.6").select(
        "video", "clip", F.substring("video", 1, 4).alias("session"),
        F.concat(F.substring("video", 1, 4), F.lit("-"), g.cast("string")).alias("group"),
        F.when(g < 3, F.concat(F.lit("N"), g.cast("string"))).alias("suggested"),
    )


@query("players_view", f"""WITH {GROUPS}, sz AS (SELECT session, grp, count(*) AS size, any_value(suggested) AS suggested FROM grp GROUP BY 1, 2)
SELECT g.session, g.grp AS "group", g.video, g.clip, size, sz.suggested,
  row_number() OVER (PARTITION BY g.session, g.video, g.clip) * 0 + gp.group_pos AS group_pos, dense_rank() OVER (ORDER BY g.session DESC) AS session_pos,
  label, stars, scorer
FROM grp g JOIN sz USING (session, grp)
JOIN (SELECT session, grp, row_number() OVER (PARTITION BY session ORDER BY size DESC, grp) AS group_pos FROM sz) gp USING (session, grp)
JOIN view v ON v.video = g.video AND v.clip = g.clip""")
def players_view(spark, d):
    return lab.players_view(groups(spark, d), view_parts(spark, d)["labels"])


@query("goals_by_player", f"""WITH {GROUPS}, named AS (SELECT session, suggested, CASE WHEN suggested IS NULL THEN grp END AS grp,
  count(*) AS n, min((video, clip)) AS seen FROM grp GROUP BY ALL),
p AS (SELECT session, coalesce(suggested, 'Player ' || row_number() OVER (PARTITION BY session, suggested IS NULL ORDER BY seen)) AS player, n FROM named)
SELECT session, player, CAST(sum(n) AS BIGINT) AS goals FROM p GROUP BY ALL""")
def goals_by_player(spark, d):
    from trackmill.operators.highlights import goals_by_player as op

    return op(groups(spark, d))


@query("library_sections", f"""WITH {VIEW}, s AS (SELECT clip, CASE WHEN label = 'goal' AND scorer IS NOT NULL THEN 0 WHEN label = 'goal' THEN 1 ELSE 2 END AS kind,
  CASE WHEN label = 'goal' AND scorer IS NOT NULL THEN scorer WHEN label = 'goal' THEN 'no scorer' ELSE 'not a goal' END AS section FROM view),
z AS (SELECT kind, section, count(*) AS size, row_number() OVER (ORDER BY kind, count(*) DESC, section) AS section_pos FROM s GROUP BY 1, 2)
SELECT clip, section, size, section_pos FROM s JOIN z USING (kind, section)""")
def library_sections(spark, d):
    return lab.library_sections(clip_view(spark, d)).select("clip", "section", "size", "section_pos")


@query("sheet_order", """SELECT page_id, section, stem, CASE WHEN page_id % 6 > 0 THEN -(page_id % 6) ELSE 1 END AS section_key,
  CAST(nullif(regexp_extract(stem, '_(\\d)star$', 1), '') AS INT) AS stars
FROM (SELECT page_id, CASE WHEN page_id % 6 > 0 THEN page_id % 6 || 'star' ELSE 'unrated' END AS section,
  regexp_replace(url, '[^a-z]+', '_', 'g') || CASE WHEN page_id % 3 > 0 THEN '_' || page_id % 7 || 'star' ELSE '_4start' END AS stem FROM pages)""")
def sheet_order(spark, d):
    p = F.col("page_id")
    v = table(spark, d, "pages").select(
        "page_id",
        F.when(p % 6 > 0, F.concat((p % 6).cast("string"), F.lit("star"))).otherwise("unrated").alias("section"),
        F.concat(F.regexp_replace("url", "[^a-z]+", "_"),
                 F.when(p % 3 > 0, F.concat(F.lit("_"), (p % 7).cast("string"), F.lit("star"))).otherwise("_4start")).alias("stem"),
    )
    return lab.sheet_order(v)


@query("scorer_slug", r"""SELECT page_id, coalesce(nullif(regexp_replace(CASE WHEN page_id % 5 = 0 THEN ' / ' ELSE url END,
  '[\s/\\:*?"<>|]+', '', 'g'), ''), 'player') AS slug FROM pages""")
def scorer_slug(spark, d):
    name = F.when(F.col("page_id") % 5 == 0, " / ").otherwise(F.col("url"))
    return table(spark, d, "pages").select("page_id", strings.scorer_slug(name).alias("slug"))


@query("account_slug", "SELECT page_id, regexp_replace(url, '[^A-Za-z0-9_.-]+', '_', 'g') AS slug FROM pages")
def account_slug(spark, d):
    return table(spark, d, "pages").select("page_id", strings.account_slug(F.col("url")).alias("slug"))


@query("format_sizes", """WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity,
  floor(l_extendedprice * pow(31, l_linenumber - 1)) AS b, CAST(floor(l_extendedprice / 3) AS BIGINT) AS s FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, CASE WHEN b < 1024 THEN format('{:.0f} B', b)
  WHEN b < pow(1024, 2) THEN format('{:.1f} KB', b / 1024) WHEN b < pow(1024, 3) THEN format('{:.1f} MB', b / pow(1024, 2))
  WHEN b < pow(1024, 4) THEN format('{:.1f} GB', b / pow(1024, 3)) ELSE format('{:.1f} TB', b / pow(1024, 4)) END AS bytes,
  CASE WHEN s >= 3600 THEN s // 3600 || 'h ' || s % 3600 // 60 || 'm' WHEN s >= 60 THEN s // 60 || 'm ' || s % 60 || 's'
       ELSE s || 's' END AS duration FROM t""")
def format_sizes(spark, d):
    li = table(spark, d, "lineitem")
    size = F.floor(F.col("l_extendedprice") * F.pow(F.lit(31.0), F.col("l_linenumber") - 1))
    return li.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", strings.format_bytes(size).alias("bytes"),
        strings.format_duration(F.col("l_extendedprice") / 3).alias("duration"),
    )


@query("probe_meta", """SELECT event_id, round(value * 7.3137, 1) AS duration_s,
  CASE WHEN event_id % 3 <> 0 THEN (640 + event_id % 5) || 'x' || 360 END AS resolution,
  CASE WHEN event_id % 3 <> 0 AND event_id % 7 <> 0 THEN round((24000 + event_id % 100) / 1001, 1) END AS fps,
  CASE WHEN event_id % 2 = 0 THEN round(event_id * 1000 / (1024 * 1024), 1) END AS size_mb FROM events""")
def probe_meta(spark, d):
    e = F.col("event_id")
    s = lambda c: c.cast("string")
    rate = F.when(e % 7 == 0, "0/0").otherwise(F.concat(s(24000 + e % 100), F.lit("/1001")))
    streams = F.when(e % 3 != 0, F.concat(
        F.lit('{"width": '), s(640 + e % 5), F.lit(', "height": 360, "avg_frame_rate": "'), rate, F.lit('"}'))).otherwise("")
    doc = F.concat(
        F.lit('{"format": {"duration": "'), s(F.col("value") * 7.3137), F.lit('"'),
        F.when(e % 2 == 0, F.concat(F.lit(', "size": "'), s(e * 1000), F.lit('"'))).otherwise(""),
        F.lit('}, "streams": ['), streams, F.lit("]}"),
    )
    return table(spark, d, "events").select("event_id", strings.probe_meta(doc).alias("m")).select("event_id", "m.*")
