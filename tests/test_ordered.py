"""Block-wise ordered helpers against plain windows, with one key holding most rows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from trackmill import ordered as o


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(5)
    data = [("hot" if rnd.random() < 0.6 else f"k{rnd.randrange(8)}", t * 10 + rnd.randrange(9),
             rnd.choice([None, 1.0, 2.0, 2.0, 7.5]), rnd.randrange(5)) for t in range(1500)]
    return spark.createDataFrame(data, "k string, t long, v double, n int").cache()


def same(a, b):
    assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


W = lambda: Window.partitionBy("k").orderBy("t")


def test_prefix_and_ordinal(rows):
    got = o.with_prefix_sum(rows, ["k"], o.time_block("t", 700), ["t"], "n", "s")
    same(got.select("k", "t", "s"), rows.select("k", "t", F.sum("n").over(W()).alias("s")))
    got = o.with_rank_order(rows, ["k"], ["n", "t"], "i")
    w = Window.partitionBy("k").orderBy("n", "t")
    same(got.select("k", "t", "i"), rows.select("k", "t", F.row_number().over(w).cast("long").alias("i")))


def test_last_seen_and_lag(rows):
    got = o.with_last_seen(rows, ["k"], o.time_block("t", 300), ["t"], "v", "x")
    same(got.select("k", "t", "x"), rows.select("k", "t", F.last("v", True).over(W()).alias("x")))
    got = o.with_lag(rows, ["k"], o.time_block("t", 300), ["t"], "v", "x")
    same(got.select("k", "t", "x"), rows.select("k", "t", F.lag("v").over(W()).alias("x")))


def test_ranges_follow_the_order(rows):
    d = o.in_ranges(rows, ["k", "t"], 16).withColumnRenamed(o.BLK, "b")
    per = d.groupBy("k", "b").agg(F.min("t").alias("lo"), F.max("t").alias("hi"), F.count("*").alias("n")).collect()
    assert max(r.n for r in per) < 300  # the hot key is split
    for a in per:
        for b in per:
            if a.k == b.k and a.b < b.b:
                assert a.hi < b.lo


def test_value_ranks(rows):
    seen = rows.where("v is not null")
    got = o.value_ranks(seen, ["k"], "v").select("k", "v", "n", "below", "total")
    w = Window.partitionBy("k")
    want = seen.groupBy("k", "v").agg(F.count("*").alias("n")).select(
        "k", "v", "n", F.coalesce(F.sum("n").over(w.orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("below"),
        F.sum("n").over(w).alias("total"))
    same(got, want)
