"""Queries over media, accounts and the job log."""

from pyspark.sql import functions as F

from trackmill.operators import ops
from trackmill.plans import bindings as b
from trackmill.plans.registry import query, table
from trackmill.plans.tracks import CALIB, calibrations

NOW = 1_000_000_000

# one job per order; its line items are the recordings of a batch
JOBS = f"""jobs AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'P' THEN 'running' ELSE 'queued' END AS state,
  CASE WHEN o_custkey % 20 = 0 THEN NULL ELSE 'user ' || (o_custkey % 97) || '@x' END AS user,
  CASE WHEN o_orderkey % 3 = 0 THEN 'single' ELSE 'batch' END AS kind, epoch_us(o_orderdate) // 1000000 AS created_at,
  CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END AS duration_s FROM orders)"""


def jobs(spark, d):
    """orders (+ lineitem) -> job documents."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    li = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(
        F.collect_list(F.struct(F.when(F.col("l_linenumber") != 3, F.col("l_quantity")).alias("duration_s"))).alias("completed"),
        F.sort_array(F.collect_list(F.concat(F.lit("in/v"), F.col("l_partkey").cast("string"), F.lit(".mp4")))).alias("queue"),
    )
    o = table(spark, d, "orders").select(
        key.alias("id"),
        F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "P", "running").otherwise("queued").alias("state"),
        F.when(cust % 20 != 0, F.concat(F.lit("user "), (cust % 97).cast("string"), F.lit("@x"))).alias("user"),
        F.when(key % 3 == 0, "single").otherwise("batch").alias("kind"),
        F.expr(f"({b.TS_MS.format('o_orderdate')}) div 1000").alias("created_at"),
        F.when(key % 2 == 0, F.col("o_totalprice")).alias("duration_s"),
    )
    return o.join(li, "id", "left").withColumn("video", F.concat(F.lit("in/s"), F.col("id").cast("string"), F.lit(".mp4")))


SECONDS = JOBS + """, v AS (SELECT l_orderkey AS id, sum(CASE WHEN l_linenumber <> 3 THEN l_quantity ELSE 0.0 END) AS s FROM lineitem GROUP BY 1),
secs AS (SELECT regexp_replace(user, '[^A-Za-z0-9_.-]+', '_', 'g') AS owner,
  sum(CASE WHEN kind = 'batch' THEN coalesce(s, 0.0) ELSE coalesce(duration_s, 0.0) END) AS seconds
  FROM jobs LEFT JOIN v USING (id) WHERE user IS NOT NULL GROUP BY 1)"""


@query("processed_seconds", f"WITH {SECONDS} SELECT owner, round(seconds, 2) AS seconds FROM secs")
def processed_seconds(spark, d):
    return ops.processed_seconds(jobs(spark, d)).withColumn("seconds", F.round("seconds", 2))


OWNER = "'user_' || ({c} % 97) || '_x'"


def _owner(c):
    return F.concat(F.lit("user_"), (F.col(c) % 97).cast("string"), F.lit("_x"))


@query("usage_by_account", f"""WITH {SECONDS}, st AS (
  SELECT {OWNER.format(c='l_partkey')} AS owner, CAST(floor(l_extendedprice * 100) AS BIGINT) AS bytes, 1 AS v, 0 AS c FROM lineitem
  UNION ALL SELECT {OWNER.format(c='doc_id')}, n_chars, 0, 1 FROM documents
  UNION ALL SELECT 'extra_' || c_nationkey, 17, 0, 0 FROM customer)
SELECT owner, CAST(sum(bytes) AS BIGINT) AS storage_bytes, CAST(sum(v) AS BIGINT) AS n_videos, CAST(sum(c) AS BIGINT) AS n_clips,
  round(coalesce(any_value(seconds), 0.0), 2) AS seconds FROM st LEFT JOIN secs USING (owner) GROUP BY owner""")
def usage_by_account(spark, d):
    videos = table(spark, d, "lineitem").select(
        _owner("l_partkey").alias("owner"), F.floor(F.col("l_extendedprice") * 100).alias("bytes"))
    clips = table(spark, d, "documents").select(_owner("doc_id").alias("owner"), F.col("n_chars").alias("bytes"))
    other = table(spark, d, "customer").select(
        F.concat(F.lit("extra_"), F.col("c_nationkey").cast("string")).alias("owner"), F.lit(17).alias("bytes"))
    u = ops.usage_by_account(videos, clips, other, ops.processed_seconds(jobs(spark, d)))
    return u.select("owner", "storage_bytes", "n_videos", "n_clips", F.round("seconds", 2).alias("seconds"))


@query("queue_positions", f"""WITH {JOBS} SELECT id, row_number() OVER (ORDER BY created_at, id) AS position FROM jobs
WHERE state IN ('queued', 'running')""")
def queue_positions(spark, d):
    return ops.queue_positions(jobs(spark, d))


@query("retention_victims", """WITH f AS (SELECT o_orderdate AS mtime, o_orderkey AS path, CAST(floor(o_totalprice) AS BIGINT) AS size FROM orders),
r AS (SELECT *, sum(size) OVER (ORDER BY mtime, path) - size AS freed, sum(size) OVER () AS total FROM f)
SELECT path, mtime, size FROM r WHERE total - freed > 1000000000""")
def retention_victims(spark, d):
    f = table(spark, d, "orders").select(
        F.col("o_orderdate").alias("mtime"), F.col("o_orderkey").alias("path"), F.floor("o_totalprice").alias("size"))
    return ops.retention_victims(f, 1_000_000_000)


@query("duplicate_media", """SELECT l_orderkey AS owner, l_linenumber AS line, l_partkey AS name, l_quantity AS size, copies
FROM (SELECT *, count(*) OVER (PARTITION BY l_partkey, l_quantity) AS copies FROM lineitem) WHERE copies > 1""")
def duplicate_media(spark, d):
    inv = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("owner"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("name"),
        F.col("l_quantity").alias("size"))
    return ops.duplicate_media(inv)


SIGNS = f"""signs AS (SELECT l_orderkey AS id, {NOW} - l_partkey % 400 AS sat FROM lineitem WHERE l_linenumber > 2)"""


@query("stale_jobs", f"""WITH {JOBS}, {SIGNS}, s AS (SELECT id, max(sat) AS seen FROM signs GROUP BY 1)
SELECT id, CASE WHEN st THEN 'error' ELSE state END AS state, CASE WHEN st THEN 'interrupted' END AS message, st AS stale
FROM (SELECT *, coalesce(state = 'running' AND {NOW} - seen > 180, false) AS st FROM jobs LEFT JOIN s USING (id))""")
def stale_jobs(spark, d):
    signs = table(spark, d, "lineitem").where("l_linenumber > 2").select(
        F.col("l_orderkey").alias("id"), (F.lit(NOW) - F.col("l_partkey") % 400).alias("at"))
    j = jobs(spark, d).select("id", "state", F.lit(None).cast("string").alias("message"))
    return ops.stale_jobs(j, signs, NOW)


@query("stuck_jobs", f"""WITH {JOBS} SELECT id, user, ({NOW} - created_at) // 60 AS minutes FROM jobs
WHERE state = 'queued' AND {NOW} - created_at > 900 AND id % 5 <> 0 AND id // 4 NOT IN (SELECT id // 4 FROM jobs WHERE state = 'running')""")
def stuck_jobs(spark, d):
    """Gated by worker pool, of four job ids each: some have a job running, others have not."""
    j = jobs(spark, d).select("id", "state", "user", "created_at", F.expr("id div 4").alias("pool"))
    return ops.stuck_jobs(j, NOW, reported=j.where("id % 5 = 0"), pool="pool")


LOG = """log AS (SELECT event_id AS job_id, epoch_us(ts) // 1000000 AS lat, CASE event_type WHEN 'error' THEN 'job_failed'
  WHEN 'purchase' THEN 'job_stuck_queued' WHEN 'signup' THEN 'worker_trigger_failed' ELSE 'other' END AS event FROM events)"""


def job_log(spark, d):
    t = F.col("event_type")
    return table(spark, d, "events").select(
        F.col("event_id").alias("job_id"), F.expr(f"({b.TS_MS.format('ts')}) div 1000").alias("at"),
        F.when(t == "error", "job_failed").when(t == "purchase", "job_stuck_queued")
        .when(t == "signup", "worker_trigger_failed").otherwise("other").alias("event"))


ALERTS = f"""{LOG}, sec AS (SELECT policy, lat, min((job_id, event)) AS f, count(*) AS n FROM (
  SELECT *, CASE WHEN event = 'job_failed' THEN 'job_failed' ELSE 'job_stuck' END AS policy FROM log WHERE event <> 'other') GROUP BY ALL),
nexts AS (SELECT policy, lat, min(lat) OVER (PARTITION BY policy ORDER BY lat RANGE BETWEEN 600 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM sec),
chain AS (
  SELECT policy, min(lat) AS lat FROM sec GROUP BY 1 UNION ALL
  SELECT c.policy, x.later FROM chain c JOIN nexts x ON x.policy = c.policy AND x.lat = c.lat WHERE x.later IS NOT NULL),
sums AS (SELECT c.policy, c.lat, CAST(sum(s.n) AS BIGINT) AS n FROM chain c JOIN sec s ON s.policy = c.policy AND s.lat BETWEEN c.lat AND c.lat + 599 GROUP BY ALL),
alerts AS (SELECT policy, lat AS "at", f[1] AS job_id, f[2] AS event,
  coalesce(lag(sums.n) OVER (PARTITION BY policy ORDER BY lat) - 1, 0) AS held_back FROM sums JOIN sec USING (policy, lat))"""


@query("job_alerts", f"WITH RECURSIVE {ALERTS} SELECT * FROM alerts")
def job_alerts(spark, d):
    return ops.job_alerts(job_log(spark, d))


@query("recent_jobs", f"""WITH {JOBS}, q AS (SELECT l_orderkey AS id, count(*) AS n, min('v' || l_partkey || '.mp4') AS first FROM lineitem GROUP BY 1),
r AS (SELECT * FROM jobs LEFT JOIN q USING (id) ORDER BY created_at DESC, id LIMIT 200)
SELECT id, state, user, created_at, CASE WHEN kind <> 'batch' THEN 's' || id || '.mp4' WHEN n = 1 THEN first WHEN n > 1 THEN n || ' videos' END AS video,
  CASE WHEN kind = 'batch' AND n > 1 THEN n || '/' || n || ' done' END AS detail FROM r""")
def recent_jobs(spark, d):
    return ops.recent_jobs(jobs(spark, d), 200)


@query("calibrated_queue", f"""WITH {CALIB} SELECT DISTINCT user_id AS video_id, user_id IN (SELECT video_id FROM calib WHERE w > 2000) AS calibrated
FROM events""")
def calibrated_queue(spark, d):
    v = table(spark, d, "events").select(F.col("user_id").alias("video_id")).distinct()
    return ops.calibrated_queue(v, calibrations(spark, d).where("w > 2000"))


@query("resolve_model", """SELECT 'user ' || c_custkey AS user, CASE WHEN c_custkey % 4 = 0 THEN 'own' || c_custkey ELSE 'base1' END AS model FROM customer""")
def resolve_model(spark, d):
    c = table(spark, d, "customer").select("c_custkey")
    k = F.col("c_custkey")
    users = c.select(F.concat(F.lit("user "), k.cast("string")).alias("user"))
    models = c.where("c_custkey % 2 = 0").select(
        F.concat(F.lit("user_"), k.cast("string")).alias("owner"), F.when(k % 4 == 0, "v2").otherwise("v1").alias("method"),
        F.concat(F.lit("own"), k.cast("string")).alias("model"),
    ).unionByName(table(spark, d, "region").where("r_regionkey = 1").select(
        F.lit(None).cast("string").alias("owner"), F.lit("v2").alias("method"),
        F.concat(F.lit("base"), F.col("r_regionkey").cast("string")).alias("model")))
    return ops.resolve_model(users, models, "v2")


@query("suggested_names", f"""WITH {b.CLIPS} SELECT video, clip, CASE WHEN clip % 3 = 0 AND clip % 2 = 0 THEN player END AS scorer
FROM clips WHERE score >= 0.6""")
def suggested_names(spark, d):
    c = b.clips(spark, d)
    p = c.where("clip % 3 = 0").select("video", "clip", F.when(F.col("clip") % 2 == 0, F.col("player")).alias("suggested"))
    return ops.suggested_names(c.where("score >= 0.6").select("video", "clip"), p)


@query("detection_status", f"""WITH {CALIB}, {b.TIMED}, det AS (SELECT video_id, count(*) AS n_makes, max(t_ms) AS detected_at FROM timed
  WHERE event_type = 'purchase' GROUP BY 1)
SELECT c_custkey AS video_id, c_custkey IN (SELECT video_id FROM calib WHERE w > 2000) AS calibrated, det.video_id IS NOT NULL AS detected,
  coalesce(n_makes, 0) AS n_makes, detected_at FROM customer LEFT JOIN det ON det.video_id = c_custkey""")
def detection_status(spark, d):
    det = b.timed(spark, d, "purchase").withColumn("detected_at", F.col("t_ms"))
    v = table(spark, d, "customer").select(F.col("c_custkey").alias("video_id"))
    return ops.detection_status(v, calibrations(spark, d).where("w > 2000"), det)


@query("exclude_videos", f"WITH {b.TIMED} SELECT video_id, t_ms, event_type FROM timed WHERE video_id % 7 <> 3")
def exclude_videos(spark, d):
    ev = table(spark, d, "events").select(F.col("user_id").alias("video_id"), b.ts_ms("ts").alias("t_ms"), "event_type")
    return ops.exclude_videos(ev, ev.where("video_id % 7 = 3").select("video_id").distinct())


@query("frame_times", """SELECT event_id, i, round(least(greatest(0.0, value + o), greatest(0.0, event_id % 64 - 0.1)), 2) AS "at"
FROM events, (VALUES (0, -3.5), (1, -2.0), (2, -1.0), (3, -0.4), (4, 0.2), (5, 1.2)) w(i, o) WHERE event_id % 64 > 0
UNION ALL SELECT event_id, i, round(greatest(0.0, value + o), 2)
FROM events, (VALUES (0, -3.5), (1, -2.0), (2, -1.0), (3, -0.4), (4, 0.2), (5, 1.2)) w(i, o) WHERE event_id % 64 = 0""")
def frame_times(spark, d):
    c = table(spark, d, "events").select(
        "event_id", F.col("value").alias("make"),
        F.when(F.col("event_id") % 64 > 0, (F.col("event_id") % 64).cast("double")).alias("duration"))
    return ops.frame_times(c, [-3.5, -2.0, -1.0, -0.4, 0.2, 1.2]).select("event_id", "i", "at")


@query("date_folders", """SELECT l_suppkey AS owner, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS folder, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) || '/v' || l_partkey || '.mp4' AS path,
  'v' || l_partkey || '.mp4' AS name, format('{:.0f} B', l_quantity) AS size_display FROM lineitem WHERE l_linenumber % 2 = 0""")
def date_folders(spark, d):
    li = table(spark, d, "lineitem")
    ext = F.when(F.col("l_linenumber") % 2 == 0, ".mp4").otherwise(".txt")
    inv = li.select(
        F.col("l_suppkey").alias("owner"),
        F.concat(F.col("l_shipdate").cast("date").cast("string"), F.lit("/v"), F.col("l_partkey").cast("string"), ext).alias("path"),
        F.col("l_quantity").alias("size"))
    return ops.date_folders(inv)
