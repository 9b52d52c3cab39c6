"""Boosted models of all folds at once against a plain boosting of each fold."""

import math
import random

import pytest
from pyspark.sql import functions as F

from trackmill.operators import boosting, train
from trackmill.operators.boosting import Settings

SCHEMA = "video_id string, clip string, shot_idx int, a double, b double, label boolean"


def make(n_groups=6, n=30, seed=2):
    rnd = random.Random(seed)
    return [(f"v{v}", f"c{i}", i, round(rnd.random() + (i % 3 == 0), 2), round(rnd.random(), 1), i % 3 == 0 and rnd.random() < 0.9) for v in range(n_groups) for i in range(n)]


def plain(xs, ys, cuts, s):
    """Log-loss boosting, row by row; the fitted function."""
    share = min(max(sum(ys) / len(ys), 1e-6), 1 - 1e-6)
    base, trees = math.log(share / (1 - share)), []

    def score(x):
        return base + sum(value(t, x) for t in trees)

    def value(t, x):
        while isinstance(t, tuple):
            f, c, low, high = t
            t = high if x[f] > c else low
        return t

    def build(rows, depth):
        best = (0.0, None)
        for f in range(len(cuts)):
            for c in cuts[f]:
                low, high = [r for r in rows if r[0][f] <= c], [r for r in rows if r[0][f] > c]
                if low and high:
                    gain = len(low) * len(high) / len(rows) * (sum(r[1] for r in low) / len(low) - sum(r[1] for r in high) / len(high)) ** 2
                    if gain > best[0] * (1 + 1e-12) + 1e-300:
                        best = (gain, (f, c, low, high))
        if depth == 0 or best[1] is None:
            down = sum(r[2] for r in rows)
            return s.rate * sum(r[1] for r in rows) / down if down > 1e-150 else 0.0
        f, c, low, high = best[1]
        return (f, c, build(low, depth - 1), build(high, depth - 1))

    for _ in range(s.trees):
        p = [1 / (1 + math.exp(-score(x))) for x in xs]
        trees.append(build([(x, y - q, q * (1 - q)) for x, y, q in zip(xs, ys, p, strict=True)], s.depth))
    return lambda x: 1 / (1 + math.exp(-score(x)))


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_every_fold_equals_plain_boosting_without_it(spark, depth):
    data = make()
    d = spark.createDataFrame(data, SCHEMA)
    cuts = boosting.cut_points(d, ["a", "b"])
    assert cuts[1] == sorted({r[4] for r in data})[:-1]  # few values: every one may end a bin
    s = Settings(trees=5, depth=depth, rate=0.3)
    model = boosting.fit(d, ["a", "b"], s, F.col("video_id"), d.select(F.col("video_id").alias("fold")))
    got = {(r.video_id, r.clip): r.raw for r in boosting.predict(model, d, fold=F.col("video_id")).collect()}
    for v in {r[0] for r in data}:
        rest = [r for r in data if r[0] != v]
        f = plain([r[3:5] for r in rest], [float(r[5]) for r in rest], cuts, s)
        for r in data:
            if r[0] == v:
                assert abs(got[v, r[1]] - f(r[3:5])) < 1e-9
    f = plain([r[3:5] for r in data], [float(r[5]) for r in data], cuts, s)
    for m in (model, boosting.fit(d, ["a", "b"], s)):
        whole = {(r.video_id, r.clip): r.raw for r in boosting.predict(m, d).collect()}
        assert all(abs(whole[r[0], r[1]] - f(r[3:5])) < 1e-9 for r in data)


def test_labels_of_a_group_never_reach_its_own_scores(spark):
    data = make()
    turned = [(*r[:5], not r[5]) if r[0] == "v3" else r for r in data]
    scores = []
    for rows in (data, turned):
        d = spark.createDataFrame(rows, SCHEMA)
        oof = train.leave_one_group_out(d, d, ["a", "b"], "video_id", ["video_id", "clip"])
        scores.append({(r.video_id, r.clip): r.score for r in oof.collect()})
    assert len(scores[0]) == 180
    same = {v: all(scores[0][k] == scores[1][k] for k in scores[0] if k[0] == v) for v in ("v0", "v3")}
    assert same == {"v0": False, "v3": True}


def test_folds_scores_and_groups_without_labels(spark):
    data = make()
    d = spark.createDataFrame(data, SCHEMA)
    for folds in (None, 2):
        oof = train.leave_one_group_out(d.where("video_id != 'v0'"), d, ["a", "b"], "video_id", ["video_id", "clip"], folds=folds, trees=20)
        assert oof.count() == oof.select("video_id", "clip").distinct().count() == 180
        goals = oof.selectExpr("score", "int(substring(clip, 2)) % 3 = 0 AS goal").groupBy("goal").avg("score").collect()
        mean = {r.goal: r[1] for r in goals}
        assert mean[True] > mean[False] + 0.3


def test_odd_rows(spark):
    data = [("v", "c", 0, None, float("nan"), True), ("v", "c", 1, 1.0, None, False), ("w", "c", 0, None, 2.0, True), ("w", "d", 1, 5.0, 5.0, None), (None, "e", 1, 5.0, 5.0, False)]
    d = spark.createDataFrame(data, SCHEMA)
    model = train.fit_classifier(d, ["a", "b"], trees=3)
    assert {r.raw is not None and 0 <= r.raw <= 1 for r in train.predict(model, d).collect()} == {True}
    empty = train.fit_classifier(d.where("false"), ["a", "b"])
    assert {r.raw for r in train.predict(empty, d).collect()} == {0.5}
    assert train.predict(model, d.where("false")).count() == 0
    # copies weigh like rows
    twice = train.fit_classifier(d.union(d), ["a", "b"], "filter", trees=4)
    once = train.fit_classifier(d, ["a", "b"], "filter", trees=4)
    a, b = ([round(r.raw, 12) for r in train.predict(m, d).collect()] for m in (twice, once))
    assert a == b
    # a bound on the entries samples them and still scores every row
    assert train.predict(boosting.fit(d, ["a"], train.SETTINGS["filter"], most=2), d).count() == 5


def test_cutoffs_are_one_row(spark):
    d = spark.createDataFrame(make(2, 12), SCHEMA)
    model = train.fit_classifier(d, ["a", "b"], trees=2)
    cuts = spark.createDataFrame([(0.1, 0.6)], "lo double, hi double")
    assert train.score_videos(d, model, cuts, ["a", "b"]).count() == 24
    with pytest.raises(ValueError):
        train.score_videos(d, model, cuts.union(cuts), ["a", "b"])
    with pytest.raises(ValueError):
        train.score_videos(d, model, cuts.where("false"), ["a", "b"])


@pytest.mark.parametrize("folds", [None, 3])
def test_scores_of_the_growing_tasks_are_those_of_the_trees(spark, folds):
    """Folds scored where they are grown; one has no training rows, one row has no fold."""
    d = spark.createDataFrame([*make(), (None, "x", 0, 0.5, None, True)], SCHEMA)
    fold = train._folds("video_id", folds)
    rows, s = d.where("video_id != 'v0'"), Settings(trees=8, depth=2, rate=0.3, sample=0.8)
    model = boosting.fit(rows, ["a", "b"], s, fold, d.select(fold.alias("fold")))
    want = {(r.video_id, r.clip): r.raw for r in boosting.predict(model, d, fold=fold).collect()}
    one, scored = boosting.held_out(rows, d, ["a", "b"], s, fold)
    got = {(r.video_id, r.clip): r.raw for r in scored.collect()}
    assert one.rows.count() == 1 and scored.count() == len(want) == 181
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in got)


def test_entries_of_other_folds_stay_where_they_are(spark):
    """The bound counts distinct bins, so many folds of equal rows are no reason to leave any out."""
    d = spark.createDataFrame(make(40, 10), SCHEMA).withColumn("a", F.round("a")).withColumn("b", F.round("b"))
    s = Settings(trees=4, depth=2, rate=0.3)
    assert d.groupBy("video_id", "label", "a", "b").count().count() > 100
    few, all_ = (boosting.held_out(d, d, ["a", "b"], s, F.col("video_id"), most=m)[1].collect() for m in (8, 10**6))
    assert sorted((r.video_id, r.clip, round(r.raw, 12)) for r in few) == sorted((r.video_id, r.clip, round(r.raw, 12)) for r in all_)


def test_drawn_weights_are_binomial():
    import numpy as np

    weights = np.array([0, 1, 2, 70, 5000] * 4000)
    got = boosting.Draws(weights, 0.8)(weights, np.random.default_rng(1).random(len(weights)))
    assert (got <= weights).all() and (got >= 0).all()
    for n in (1, 2, 70, 5000):
        x = got[weights == n]
        assert abs(x.mean() - 0.8 * n) < 5 * (0.16 * n / 4000) ** 0.5 and abs(x.var() / (0.16 * n) - 1) < 0.15


def test_trees_are_walked_once_for_rows_between_the_same_cuts(spark):
    d = spark.createDataFrame(make(), SCHEMA)
    s = Settings(trees=3, depth=2, rate=0.3)
    model = boosting.fit(d, ["a", "b"], s, F.col("video_id"), d.select(F.col("video_id").alias("fold")))
    none = F.lit(None).cast("string")  # no fold: row by row, under the model on all rows
    want = {(r.video_id, r.clip): r.raw for r in boosting.predict(model, d, fold=none).collect()}
    many = d.crossJoin(spark.range(50))
    got = boosting.predict(model, many)
    assert all(abs(r.raw - want[r.video_id, r.clip]) < 1e-12 for r in got.collect()) and got.count() == 50 * 180
    assert "Join" in got._jdf.queryExecution().optimizedPlan().toString().split("aggregate(")[0]  # the walk lies below a join of the rows


@pytest.mark.parametrize("sides", [(6, 5), (40, 35)])  # bins that fill a grid, and bins that do not
def test_models_that_share_splits_are_summed_together(sides, monkeypatch):
    import numpy as np
    import pyarrow as pa

    rnd, m = random.Random(8), 30
    at = sorted({(rnd.randrange(sides[0]), rnd.randrange(sides[1])) for _ in range(300 if sides[0] < 10 else 60)})
    weight = [[40 + rnd.randrange(9) + 100 * (a > sides[0] // 2) * y + 60 * (b > sides[1] // 3) * y for a, b in at] for y in (0, 1)]
    names = {f"b{j}": pa.array([k[j] for k in at], pa.int8()) for j in (0, 1)}
    table = pa.table({**names, **{c: pa.array(w, pa.float64()) for c, w in zip(("neg", "pos"), weight, strict=True)}})
    cuts = [[float(i) for i in range(n - 1)] for n in sides]
    own = [np.array(x) for x in zip(*((rnd.randrange(2), k, rnd.randrange(len(at)), 1.0) for k in range(m)), strict=True)]
    s, sizes, summed = Settings(trees=6, depth=2, rate=0.3), [], boosting.Cells.by_bin
    monkeypatch.setattr(boosting.Cells, "by_bin", lambda c, x, *a: sizes.append(len(x)) or summed(c, x, *a))
    cells = boosting.Cells(table, 2, [len(c) for c in cuts])
    assert bool(cells.grid) == (sides[0] < 10)
    everywhere = np.repeat(np.arange(m), len(at)), np.tile(np.array(at, np.uint8), (m, 1))
    raw = boosting.grow(cells, list(range(m)), own, everywhere, s, cuts)[2].reshape(m, -1)
    assert sizes.count(1) + sum(n > 1 for n in sizes) < 6 * m  # each model alone: three sums a tree
    for k in (0, 7, m - 1):
        left = [list(w) for w in weight]
        left[own[0][k]][own[2][k]] -= 1
        rows = [(x, float(y)) for y in (0, 1) for x, n in zip(at, left[y], strict=True) for _ in range(int(n))]
        f = plain([x for x, _ in rows], [y for _, y in rows], cuts, s)
        assert all(abs(f(x) - 1 / (1 + math.exp(-v))) < 1e-9 for x, v in zip(at, raw[k], strict=True))
