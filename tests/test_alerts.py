"""Rolling alerts and silent jobs, batch and stream, against plain loops."""

import random
import time

import pytest
from pyspark.sql import functions as F

from trackmill.operators import ops
from trackmill.plans.streams import finish, state_store
from trackmill.streaming.jobs import stream_job_alerts, stream_silent_jobs

LOG = "event string, at long, job_id long"


def plain(rows):
    out = []
    for policy in set(ops.ALERT_POLICIES.values()):
        last, held = None, 0
        for at, job, event in sorted((at, job, e) for e, at, job in rows if ops.ALERT_POLICIES.get(e) == policy):
            if last is None or at - last >= ops.ALERT_EVERY:
                out.append((policy, at, job, event, held))
                last, held = at, 0
            else:
                held += 1
    return sorted(out)


def log_rows(seed, n=700, days=4):
    rnd = random.Random(seed)
    names = [*ops.ALERT_POLICIES, "job_done"]
    near = [rnd.randrange(days * 86_400) for _ in range(20)]
    at = [rnd.choice(near) + rnd.randrange(3000) if i % 2 else rnd.randrange(days * 86_400) for i in range(n)]
    return [(rnd.choice(names), t, i) for i, t in enumerate(at)]


@pytest.mark.parametrize("block", [601, 5000, 86_400])
def test_alerts_roll(spark, block):
    rows = log_rows(block) + [("job_failed", 40 * 86_400 + i, i) for i in range(0, 4000, 7)]
    got = ops.job_alerts(spark.createDataFrame(rows, LOG), block=block)
    assert sorted(tuple(r) for r in got.collect()) == plain(rows)


def test_no_alerts(spark):
    d = spark.createDataFrame([("job_done", 5, 1)], LOG)
    assert ops.job_alerts(d).count() == 0 and ops.job_alerts(d.where("false")).count() == 0


def test_stream_alerts(spark, tmp_path):
    rows = sorted(log_rows(3), key=lambda r: r[1])
    src = str(tmp_path / "log")
    for part in (rows[:300], rows[300:], [("job_failed", 10**9, 0)], [("job_failed", 2 * 10**9, 0)]):
        spark.createDataFrame(part, LOG).coalesce(1).write.mode("append").parquet(src)
        time.sleep(0.05)
    with state_store(spark):
        live = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(src)
        got = finish(spark, stream_job_alerts(live))
    assert sorted(tuple(r) for r in got.where(F.col("at") < 10**9).collect()) == plain(rows)


def test_silence_is_reported_when_nothing_arrives_any_more(spark, tmp_path):
    now = int(time.time())
    src, out = str(tmp_path / "signs"), str(tmp_path / "out")
    rows = [(1, now, "running"), (2, now, "running"), (2, now + 1, "stopped"), (3, now - 900, "running"), (4, now + 3600, "running"), (None, now, "running")]
    spark.createDataFrame(rows, "id long, at long, state string").coalesce(1).write.parquet(src)
    with state_store(spark):
        signs = spark.readStream.schema("id long, at long, state string").parquet(src)
        q = stream_silent_jobs(signs, 6).writeStream.option("checkpointLocation", f"{out}/state").format("parquet").option("path", f"{out}/rows").trigger(processingTime="500 milliseconds").start()
        try:
            for _ in range(120):
                time.sleep(0.5)
                try:
                    got = sorted(tuple(r) for r in spark.read.schema("id long, seen_at long").parquet(f"{out}/rows").collect())
                except Exception:
                    got = []
                if len(got) == 2:
                    break
        finally:
            q.stop()
    assert got == [(1, now), (3, now - 900)]
