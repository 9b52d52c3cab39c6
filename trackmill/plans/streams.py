"""Streaming queries, run to the end of their input and compared with batch SQL.

After the table, a closing record far in the future arrives and releases what the watermark
still holds, so a result is that of the batch rule over all rows.
"""

import contextlib
import uuid

from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from trackmill.plans import bindings as b
from trackmill.plans.labels import FOLD, actions
from trackmill.plans.events import WALK
from trackmill.plans.ops import ALERTS, LOG, job_log
from trackmill.plans.registry import query, table
from trackmill.session import shared_folder
from trackmill.streaming.jobs import stream_job_alerts, stream_silent_jobs
from trackmill.streaming.labels import stream_labels
from trackmill.streaming.makes import stream_makes
from trackmill.streaming.state import PROVIDER, ROCKS
from trackmill.streaming.windows import stream_clusters, stream_stale_jobs


class _Live:
    """Stands in for the session where a binding should read a table as a stream."""

    def __init__(self, spark):
        self.spark = spark

    @property
    def read(self):
        return self

    def parquet(self, path):
        schema = self.spark.read.parquet(path).schema
        # a pattern, so that a table may be one file or a folder
        return self.spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")


END_MS = 4_102_444_800_000  # the year 2100


@contextlib.contextmanager
def state_store(spark):
    """The state store that processors with timers need, for as long as the stream runs."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def with_end(spark, df, **values):
    """A stream of df and then, once its second result is called, one closing record; other columns are null."""
    folder = f"{shared_folder(spark)}/end-{uuid.uuid4().hex}"
    row = spark.range(1).select(*[F.lit(values.get(f.name)).cast(f.dataType).alias(f.name) for f in df.schema.fields])
    row.limit(0).write.parquet(folder)
    live = df.unionByName(spark.readStream.schema(df.schema).parquet(folder))
    return live, lambda: row.write.mode("append").parquet(folder)


def finish(spark, df, mode="append", end=None, trigger=None):
    """Run a stream over all of its input into files of the shared folder and read them back.

    trigger: by default all that is available; with timers on the wall clock that never ends, so such
    a stream takes one batch instead. end adds the closing record; the query then goes on from its checkpoint.
    """
    out = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    w = df.writeStream.option("checkpointLocation", f"{out}/state").trigger(**(trigger or {"availableNow": True}))
    if mode == "append":
        w = w.format("parquet").option("path", f"{out}/rows")
    else:
        w = w.outputMode(mode).foreachBatch(
            lambda rows, n: rows.withColumn("_batch", F.lit(n)).write.mode("overwrite").parquet(f"{out}/rows/b={n}")
        )
    w.start().awaitTermination()
    if end is not None:
        end()
        w.start().awaitTermination()
    return spark.read.schema(df.schema if mode == "append" else df.schema.add("_batch", LongType())).option(
        "recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(f"{out}/rows")


def fast_track(spark, d):
    """events -> track on a clock of one millisecond per event number."""
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("bigint")
    seen = F.col("event_type") != "error"
    return table(spark, d, "events").select(
        F.col("user_id").alias("video_id"), F.col("event_id").alias("t_ms"),
        F.when(seen, (3300 + 25 * k).cast("double")).alias("cx"),
        F.when(seen, (2500 + F.round(F.col("value") * 100).cast("bigint") % 2000).cast("double")).alias("cy"),
    )


FAST = WALK.replace(b.TRACK, """track AS (SELECT user_id AS video_id, event_id AS t_ms,
  CASE WHEN event_type <> 'error' THEN CAST(3300 + 25 * CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS DOUBLE) END AS cx,
  CASE WHEN event_type <> 'error' THEN CAST(2500 + CAST(round(value * 100) AS BIGINT) % 2000 AS DOUBLE) END AS cy FROM events)""")


@query("stream_makes", f"WITH RECURSIVE {FAST} SELECT * FROM makes")
def makes(spark, d):
    with state_store(spark):
        track, end = with_end(spark, fast_track(_Live(spark), d), video_id=-1, t_ms=END_MS, cx=0, cy=0)
        return finish(spark, stream_makes(track, b.hoop()), end=end)


@query("stream_clusters", f"""WITH {b.CLUSTERED} SELECT video_id, min(t_ms) AS first_ms, max(t_ms) AS last_ms, count(*) AS n_shots
  FROM clustered GROUP BY video_id, shot_no""")
def clusters(spark, d):
    events, end = with_end(spark, b.timed(_Live(spark), d, "purchase").select("video_id", "t_ms"), video_id=-1, t_ms=END_MS)
    return finish(spark, stream_clusters(events, 6 * b.HOUR_MS), end=end)


@query("stream_job_alerts", f"WITH RECURSIVE {ALERTS} SELECT * FROM alerts")
def job_alerts(spark, d):
    with state_store(spark):
        log, end = with_end(spark, job_log(_Live(spark), d), job_id=-1, at=END_MS // 1000, event="job_failed")
        return finish(spark, stream_job_alerts(log), end=end)


@query("stream_silent_jobs", f"""WITH {LOG}, s AS (SELECT job_id % 50 AS id, lat, CASE WHEN event = 'other' THEN 'running' ELSE 'stopped' END AS state FROM log)
SELECT id, max(lat) AS seen_at FROM s GROUP BY id HAVING max((lat, state))[2] = 'running'""")
def silent_jobs(spark, d):
    """Every job of the log has been silent for long by the wall clock; those that were running are reported."""
    state = F.when(F.col("event") == "other", "running").otherwise("stopped")
    with state_store(spark):
        return finish(spark, stream_silent_jobs(job_log(_Live(spark), d).select((F.col("job_id") % 50).alias("id"), "at", state.alias("state"))), trigger={"once": True})


@query("stream_stale_jobs", f"""WITH {LOG}, s AS (SELECT job_id % 50 AS id, lat, CASE WHEN event = 'other' THEN 'running' ELSE 'stopped' END AS state,
    CASE WHEN lat - lag(lat) OVER w <= 180 THEN 0 ELSE 1 END AS brk FROM log WINDOW w AS (PARTITION BY job_id % 50 ORDER BY lat)),
r AS (SELECT id, lat, state, sum(brk) OVER (PARTITION BY id ORDER BY lat) AS run FROM s)
SELECT id, max(lat) AS seen_at FROM r GROUP BY id, run HAVING max((lat, state))[2] = 'running'""")
def stale_jobs(spark, d):
    state = F.when(F.col("event") == "other", "running").otherwise("stopped")
    signs = job_log(_Live(spark), d).select((F.col("job_id") % 50).alias("id"), "at", state.alias("state"))
    signs, end = with_end(spark, signs, id=-1, at=END_MS // 1000, state="running")
    return finish(spark, stream_stale_jobs(signs), end=end)


@query("stream_labels", f"WITH RECURSIVE {FOLD} SELECT * FROM folded")
def labels(spark, d):
    """Latest upsert per clip."""
    with state_store(spark):
        rows = finish(spark, stream_labels(actions(_Live(spark), d)), "update")
    cols = [c for c in rows.columns if c not in ("clip", "_batch")]
    last = rows.groupBy("clip").agg(F.max_by(F.struct(*cols), "_batch").alias("e"))
    return last.select("clip", "e.*").where("label is not null")
