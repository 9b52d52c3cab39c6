"""Greedy matching against a plain loop, at block sizes that cut dense stretches everywhere."""

import random

import pytest
from pyspark.sql import functions as F

from trackmill.operators import events, matching

SCHEMA = "video_id string, t_ms long"


def greedy(ds, gs, tol):
    free, out = sorted(gs), []
    for d in sorted(ds):
        near = [g for g in free if abs(g - d) <= tol]
        g = min(near, key=lambda x: (abs(x - d), x)) if near else None
        if g is not None:
            free.remove(g)
        out.append((d, g, "matched" if g is not None else "false_positive"))
    return out + [(None, g, "missed") for g in free]


def rows(spark, sides):
    return [spark.createDataFrame([(k, t) for k, v in sides.items() for t in v[i]], SCHEMA) for i in (0, 1)]


def order(r):
    return tuple((x is None, x) for x in r)


@pytest.mark.parametrize("block", [1, 7, 50, 4096])
def test_matching(spark, block):
    rnd = random.Random(11)
    sides = {f"r{i}": ([rnd.randrange(4000) for _ in range(90)], [rnd.randrange(4000) for _ in range(60 + 20 * i)]) for i in range(3)}
    sides["copies"] = ([rnd.randrange(60) * 25 for _ in range(200)], [rnd.randrange(60) * 25 for _ in range(190)])
    sides["even"] = ([i * 10 + rnd.randrange(9) for i in range(300)], [i * 10 for i in range(300)])
    sides["one side"], sides["other side"] = ([5, 5, 900], []), ([], [7])
    got = matching.match_events(*rows(spark, sides), 100, block).collect()
    want = [(k, *r) for k, v in sides.items() for r in greedy(*v, 100)]
    assert sorted(map(tuple, got), key=order) == sorted(want, key=order)


def test_far_reaching_shortage(spark, monkeypatch):
    """One detection too many shifts every later partner, so no block's output is certain on its own."""
    n = 120
    ds, gs = [-40, *(i * 100 + 49 for i in range(n))], [i * 100 for i in range(n)]
    monkeypatch.setattr(matching, "GROUP", 4)  # several levels of composed tables
    for extra in ([], [-90, -60]):
        sides = {"v": (ds + extra, gs), "w": (ds[1:], gs)}
        got = matching.match_events(*rows(spark, sides), 60, 5).collect()
        want = [(k, *r) for k, v in sides.items() for r in greedy(*v, 60)]
        assert sorted(map(tuple, got), key=order) == sorted(want, key=order)


def test_blocks_with_too_many_states_are_run_together(spark, monkeypatch):
    monkeypatch.setattr(matching, "STATES", 2)
    rnd = random.Random(5)
    sides = {"v": ([rnd.randrange(3000) for _ in range(300)], [rnd.randrange(3000) for _ in range(290)])}
    got = matching.match_events(*rows(spark, sides), 80, 10).collect()
    assert sorted(map(tuple, got), key=order) == sorted([("v", *r) for r in greedy(*sides["v"], 80)], key=order)


def test_a_hundred_thousand_events_within_reach_of_each_other(spark):
    """A single dense stretch: all rows chain within the tolerance; counts follow from the rule."""
    n = 50_000
    g = spark.range(n).select(F.lit("v").alias("video_id"), (F.col("id") * 100).alias("t_ms"))
    d = spark.range(n).select(F.lit("v").alias("video_id"), (F.col("id") * 100 + 49).alias("t_ms"))
    first = spark.createDataFrame([("v", -40)], SCHEMA)
    out = matching.match_events(d.union(first), g, 60)
    m = events.event_metrics(out).first()
    assert (m.n_matched, m.n_detected, m.n_truth) == (n, n + 1, n)
    # the first takes truth 0, every other one the truth after it, and the last finds none left
    assert out.where("outcome = 'matched' AND detected_ms >= 0 AND truth_ms != detected_ms + 51").count() == 0
    assert out.where("outcome = 'false_positive'").first().detected_ms == (n - 1) * 100 + 49


def test_small_cases(spark):
    cases = {"a": ([10100, 20000], [10000, 30000]), "b": ([5000, 15000], [5200, 15100]), "c": ([10000], [9800, 10300])}
    m = matching.match_events(*rows(spark, cases), 500)
    assert sorted((r.video_id, r.detected_ms, r.truth_ms) for r in m.where("outcome = 'matched'").collect()) == [
        ("a", 10100, 10000), ("b", 5000, 5200), ("b", 15000, 15100), ("c", 10000, 9800)]
    none = rows(spark, {"a": ([], [])})
    assert matching.match_events(*none, 500).count() == 0
    two = [x.withColumn("side", F.lit(3)) for x in rows(spark, {"a": ([1, 2], [2]), "b": ([9], [])})]
    assert matching.match_events(*two, 0, keys=("side", "video_id")).columns == ["side", "video_id", "detected_ms", "truth_ms", "outcome"]
