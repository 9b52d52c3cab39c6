"""Event rules on generated tracks against the recursive SQL of the registered queries."""

import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trackmill.operators import events as ev
from trackmill.plans import bindings as b
from trackmill.plans.events import WALK

TRACK = "video_id string, t_ms long, cx double, cy double"
SQL = f"WITH RECURSIVE {WALK.replace(b.TRACK, 'track AS (SELECT * FROM points)')} SELECT video_id, above_ms, through_ms FROM makes"


def from_sql(rows):
    points = pd.DataFrame(rows, columns=["video_id", "t_ms", "cx", "cy"]).astype({"cx": "Float64", "cy": "Float64"})
    con = duckdb.connect()
    con.register("points", points)
    return sorted(con.execute(SQL).fetchall())


def from_spark(spark, rows, block_ms=None):
    made = ev.find_makes(spark.createDataFrame(rows, TRACK), b.hoop(), **({"block_ms": block_ms} if block_ms else {}))
    return sorted((r.video_id, r.above_ms, r.through_ms) for r in made.collect())


@pytest.mark.parametrize("step,seed", [(67, 1), (190, 2), (500, 3)])
def test_makes_across_blocks(spark, step, seed):
    """Long dense tracks, so sightings, bounces and cooldowns straddle many block edges."""
    rnd = random.Random(seed)
    rows = []
    for v in range(6):
        for i in range(900 if v == 0 else 120):
            seen = rnd.random() < 0.85
            cx = 4500.0 if rnd.random() < 0.9 else 9000.0
            cy = float(rnd.choice([1000, 2000, 2500, 3200, 3300, 3600, 4500]))
            rows.append((str(v), i * step, cx if seen else None, cy if seen else None))
    want = from_sql(rows)
    assert len(want) > 10
    assert from_spark(spark, rows, 5000) == want


def test_endless_chain(spark):
    """A pass every second: blocks never agree on their own, so whole runs are composed."""
    rows = [("v", 1000 * i + o, 4500.0, y) for i in range(120) for o, y in ((0, 2000.0), (590, 3200.0))]
    want = from_sql(rows)
    assert from_spark(spark, rows, 6000) == want and len(want) > 50


def test_tracks_without_events(spark):
    """Nothing seen, never above, never through, or beside the hoop all the time."""
    rows = [("unseen", t, None, None) for t in (0, 40)] + [("high", t, 4500.0, 2100.0) for t in (0, 40)]
    rows += [("low", t, 4500.0, 3700.0) for t in (0, 40)] + [("aside", t, 7000.0, y) for t, y in ((0, 2000.0), (40, 3300.0))]
    assert from_spark(spark, rows) == [] == from_sql(rows)
    assert from_spark(spark, rows[:0] or [("x", 0, None, None)]) == []


def test_clusters(spark):
    cases = {"a": ([10, 30, 60], 3), "b": ([16, 10, 13], 1), "c": ([10, 15], 2), "d": ([10, 14.99], 1)}
    d = spark.createDataFrame([(k, int(t * 1000)) for k, (ts, _) in cases.items() for t in ts], "video_id string, t_ms long")
    for block in (1000, 7000, 3_600_000):
        n = ev.cluster_events(d, block_ms=block).groupBy("video_id").agg(F.max("shot_no").alias("n")).collect()
        assert {r.video_id: r.n for r in n} == {k: c for k, (_, c) in cases.items()}
    for gap, n in ((1000, 3), (10000, 1)):
        assert ev.cluster_events(d.where("video_id = 'b'"), gap).select("shot_no").distinct().count() == n
    assert ev.cluster_events(d.where("false")).count() == 0


def test_clip_and_local_times(spark):
    d = spark.createDataFrame([("a", 30000), ("b", 30000), ("b", 33500), ("c", 2000), ("c", 4000)], "video_id string, t_ms long")
    c = ev.cluster_events(d)
    loc = ev.local_shot_times(c).orderBy("video_id", "t_ms").collect()
    assert [r.local_ms for r in loc] == [5000, 5000, 8500, 2000, 4000]
    cl = {r.video_id: (r.start_ms, r.duration_ms) for r in ev.clips(c).collect()}
    assert cl == {"a": (25000, 7000), "b": (25000, 10500), "c": (0, 9000)}
