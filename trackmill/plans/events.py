"""Queries over tracks and event times."""

from pyspark.sql import functions as F

from trackmill.operators import events as ev, matching
from trackmill.plans import bindings as b
from trackmill.plans.registry import query

WALK = b.SIGHTED + """, cand AS (
  SELECT s.video_id, s.t_ms, s.above_ms,
         EXISTS (SELECT 1 FROM track n WHERE n.video_id = s.video_id AND n.t_ms > s.t_ms
                 AND n.t_ms <= s.t_ms + 400 AND n.cy < 3000) AS bounced,
         row_number() OVER (PARTITION BY s.video_id ORDER BY s.t_ms) AS n
  FROM sighted s WHERE cx BETWEEN 3400 AND 5600 AND cy BETWEEN 3000 AND 4000 AND t_ms - above_ms <= 600),
walk AS (
  SELECT video_id, CAST(0 AS BIGINT) AS n, CAST(-1000000 AS BIGINT) AS last, CAST(-1 AS BIGINT) AS used,
         CAST(NULL AS BIGINT) AS above_ms, CAST(NULL AS BIGINT) AS through_ms
  FROM (SELECT DISTINCT video_id FROM cand)
  UNION ALL
  SELECT c.video_id, c.n,
         CASE WHEN ok AND NOT bounced THEN c.t_ms ELSE c.last END,
         CASE WHEN ok THEN c.above_ms ELSE c.used END,
         CASE WHEN ok AND NOT bounced THEN c.above_ms END,
         CASE WHEN ok AND NOT bounced THEN c.t_ms END
  FROM (SELECT c.*, w.last, w.used, c.above_ms <> w.used AND c.t_ms - w.last > 1500 AS ok
        FROM walk w JOIN cand c ON c.video_id = w.video_id AND c.n = w.n + 1) c),
makes AS (SELECT video_id, above_ms, through_ms, (above_ms + through_ms) // 2 AS make_ms
          FROM walk WHERE through_ms IS NOT NULL)"""


@query("crossing_state", f"WITH {b.SIGHTED} SELECT video_id, t_ms, above_ms FROM sighted")
def crossing_state(spark, d):
    return ev.crossing_state(b.track(spark, d), b.hoop()).select("video_id", "t_ms", "above_ms")


@query("find_makes", f"WITH RECURSIVE {WALK} SELECT * FROM makes")
def find_makes(spark, d):
    return ev.find_makes(b.track(spark, d), b.hoop())


@query("made_clips", f"""WITH RECURSIVE {WALK}, numbered AS (
  SELECT video_id, make_ms, sum(brk) OVER (PARTITION BY video_id ORDER BY make_ms) AS shot_no
  FROM (SELECT *, CASE WHEN make_ms - lag(make_ms) OVER (PARTITION BY video_id ORDER BY make_ms) < 5000
                       THEN 0 ELSE 1 END AS brk FROM makes))
SELECT video_id, CAST(shot_no AS BIGINT) AS shot_no, min(make_ms) AS first_ms, max(make_ms) AS last_ms,
       count(*) AS n_shots, greatest(0, min(make_ms) - 5000) AS start_ms,
       max(make_ms) + 2000 - (min(make_ms) - 5000) AS duration_ms
FROM numbered GROUP BY ALL""")
def made_clips(spark, d):
    """Flagship: crossing events of every recording, chained into clips."""
    makes = ev.find_makes(b.track(spark, d), b.hoop()).select("video_id", F.col("make_ms").alias("t_ms"))
    return ev.clips(ev.cluster_events(makes))


@query("cluster_events", f"WITH {b.CLUSTERED} SELECT * FROM clustered")
def cluster_events(spark, d):
    return ev.cluster_events(b.timed(spark, d, "purchase"), 6 * b.HOUR_MS, block_ms=24 * b.HOUR_MS)


@query("clip_window", f"""WITH {b.CLUSTERED}, f AS (SELECT *, min(t_ms) OVER w AS lo, max(t_ms) OVER w AS hi,
  count(*) OVER w AS n_shots FROM clustered WINDOW w AS (PARTITION BY video_id, shot_no))
SELECT video_id, shot_no, t_ms, n_shots, greatest(0, lo - 5000) AS start_ms, hi - lo + 7000 AS duration_ms,
       t_ms - greatest(0, lo - 5000) AS local_ms FROM f""")
def clip_window(spark, d):
    c = ev.cluster_events(b.timed(spark, d, "purchase"), 6 * b.HOUR_MS, block_ms=24 * b.HOUR_MS)
    whole = ev.clips(c).select("video_id", "shot_no", "n_shots", "start_ms", "duration_ms")
    return ev.local_shot_times(c).join(whole, ["video_id", "shot_no"])


@query("shots_in_window", f"""WITH RECURSIVE {WALK}
SELECT m.video_id, m.make_ms AS shot_ms, t.t_ms - m.make_ms + 5000 AS t_ms, t.cx, t.cy
FROM makes m JOIN track t ON t.video_id = m.video_id AND t.t_ms BETWEEN m.make_ms - 5000 AND m.make_ms + 2000""")
def shots_in_window(spark, d):
    t = b.stored_track(spark, d)
    makes = ev.find_makes(t, b.hoop()).select("video_id", F.col("make_ms").alias("t_ms"))
    return ev.shots_in_window(t.select("video_id", "t_ms", "cx", "cy"), makes)


MATCHED = b.TIMED + f""", det AS (
  SELECT video_id, t_ms, row_number() OVER (PARTITION BY video_id ORDER BY t_ms) AS n
  FROM timed WHERE event_type = 'purchase'),
tru AS (SELECT video_id, t_ms, row_number() OVER (PARTITION BY video_id ORDER BY t_ms) AS id
        FROM timed WHERE event_type = 'signup'),
walk AS (
  SELECT video_id, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS got
  FROM (SELECT DISTINCT video_id FROM det)
  UNION ALL
  SELECT video_id, n, CASE WHEN got IS NULL THEN used ELSE list_append(used, got) END, got
  FROM (SELECT w.video_id, w.n + 1 AS n, w.used,
               (SELECT arg_min(t.id, (abs(t.t_ms - d.t_ms), t.id)) FROM tru t
                WHERE t.video_id = w.video_id AND abs(t.t_ms - d.t_ms) <= {b.MATCH_TOL_MS}
                  AND NOT list_contains(w.used, t.id)) AS got
        FROM walk w JOIN det d ON d.video_id = w.video_id AND d.n = w.n + 1)),
pairs AS (SELECT d.video_id, d.t_ms AS detected_ms, t.t_ms AS truth_ms, w.got
          FROM walk w JOIN det d USING (video_id, n)
          LEFT JOIN tru t ON t.video_id = w.video_id AND t.id = w.got),
outcomes AS (
  SELECT video_id, detected_ms, truth_ms, CASE WHEN got IS NULL THEN 'false_positive' ELSE 'matched' END AS outcome
  FROM pairs
  UNION ALL
  SELECT video_id, NULL, t_ms, 'missed' FROM tru
  WHERE (video_id, id) NOT IN (SELECT (video_id, got) FROM pairs WHERE got IS NOT NULL))"""


@query("match_events", f"WITH RECURSIVE {MATCHED} SELECT * FROM outcomes")
def match_events(spark, d):
    return matching.match_events(b.timed(spark, d, "purchase"), b.timed(spark, d, "signup"), b.MATCH_TOL_MS)


@query("event_metrics", f"""WITH RECURSIVE {MATCHED}, c AS (
  SELECT video_id, count(*) FILTER (outcome = 'matched') AS n_matched,
         count(*) FILTER (outcome <> 'missed') AS n_detected,
         count(*) FILTER (outcome <> 'false_positive') AS n_truth FROM outcomes GROUP BY 1)
SELECT *, CASE WHEN n_truth > 0 THEN n_matched / n_truth ELSE 'NaN'::DOUBLE END AS recall,
       CASE WHEN n_detected > 0 THEN n_matched / n_detected ELSE 'NaN'::DOUBLE END AS precision FROM c""")
def event_metrics(spark, d):
    return ev.event_metrics(match_events(spark, d))
