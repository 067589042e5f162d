"""Boosted trees of many horizons at once: against brute force, by any partitioning, and by blocks."""

import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as library
from wattline.operators import boosting as B
from wattline.operators import evaluate as E
from wattline.operators import models as M

T0 = datetime(2024, 1, 1)
FEATURES = ["a", "b", "c"]


def table(spark, n=240, seed=0, missing=True):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        a, b, c = (float(v) for v in rng.integers(0, 12, 3))
        y = [3 * (a > 5) + b / 4 + float(rng.normal(0, 0.1)), a - c + float(rng.normal(0, 0.1)), float(rng.normal())]
        rows.append((f"s{i % 3}", T0 + timedelta(hours=i), None if missing and i % 17 == 0 else a, b, c, y))
    return spark.createDataFrame(rows, "series_id string, origin_ts timestamp_ntz, a double, b double, c double, y array<double>")


def _brute_tree(x, g, depth, smooth, edges):
    """(feature, threshold, left, right) or a leaf's value, by trying every split."""
    score = lambda v: sum(v) ** 2 / (len(v) + smooth)
    leaf = -sum(g) / (len(g) + smooth)
    best = (1e-9, None)
    if depth:
        for f, cuts in enumerate(edges):
            for cut in cuts:
                left = [v for r, v in zip(x, g) if r[f] <= cut]
                if 0 < len(left) < len(g):
                    right = [v for r, v in zip(x, g) if r[f] > cut]
                    gain = score(left) + score(right) - score(g)
                    if gain > best[0] + 1e-9:
                        best = gain, (f, cut)
    if best[1] is None:
        return leaf
    f, cut = best[1]
    side = lambda keep: [(r, v) for r, v in zip(x, g) if (r[f] <= cut) == keep]
    return f, cut, *[_brute_tree([r for r, _ in part], [v for _, v in part], depth - 1, smooth, edges) for part in (side(True), side(False))]


def _walk(tree, r):
    while isinstance(tree, tuple):
        tree = tree[2] if r[tree[0]] <= tree[1] else tree[3]
    return tree


@pytest.mark.parametrize("task_rows", [50_000, 60])
def test_trees_equal_brute_force(spark, task_rows):
    df = table(spark)
    fitted = B.fit_boosters(spark, df, (1, 2, 3), FEATURES, trees=3, rate=0.3, depth=3, rows=1.0, cols=1.0, task_rows=task_rows, every=2)
    got = {(r.origin_ts, r.horizon): r.y_hat for r in B.predict_boosters(spark, fitted, df).collect()}
    data = df.collect()
    x = [[-math.inf if r[f] is None else r[f] for f in FEATURES] for r in data]
    for h in (1, 2, 3):
        y = [r.y[h - 1] for r in data]
        pred = [float(np.float32(np.mean(y)))] * len(y)
        for _ in range(3):
            tree = _brute_tree(x, [p - v for p, v in zip(pred, y)], 3, 1.0, fitted.edges)
            pred = [p + 0.3 * _walk(tree, r) for p, r in zip(pred, x)]
        assert np.allclose([got[r.origin_ts, h] for r in data], pred, atol=1e-6)


def test_any_partitioning_gives_the_same_trees(spark):
    df = table(spark, 400)
    settings = {"trees": 5, "depth": 4, "bins": 8}
    one = B.fit_boosters(spark, df, (1, 2), FEATURES, **settings)
    for n, task_rows in ((1, 50), (7, 130)):
        other = B.fit_boosters(spark, df.repartition(n), (1, 2), FEATURES, task_rows=task_rows, every=3, **settings)
        for name in ("feature", "bin", "value", "gain", "base"):
            assert np.array_equal(getattr(one, name), getattr(other, name)), name
    assert 0.99 < sum(r.value for r in B.mean_importance(spark, one).collect()) < 1.01
    assert B.fit_boosters(spark, df.limit(0), (1, 2), FEATURES) is None


def test_blocks_fitted_together_equal_refits(spark):
    df = table(spark, 400)
    evals = df.where(F.col("origin_ts") >= T0 + timedelta(hours=200)).select("series_id", "origin_ts")
    blocks = E.rolling_blocks(evals, hours=72, anchor=())
    settings = {"trees": 6, "depth": 3, "edges": [np.arange(12.0)] * 3}
    got = {(r.origin_ts, r.horizon): r.y_hat for r in M.rolling_trees(spark, df, blocks, (1, 2), FEATURES, **settings).collect()}
    assert len(got) == 2 * 200
    again = M.rolling_fit_predict(df, blocks, M.boosters_fitter(spark, (1, 2), FEATURES, **settings))
    want = {(r.origin_ts, r.horizon): r.y_hat for r in again.collect()}
    assert got.keys() == want.keys() and np.allclose([got[k] for k in want], list(want.values()), atol=1e-9)


def test_blocks_without_earlier_rows_give_nothing(spark):
    df = table(spark, 60)
    blocks = E.rolling_blocks(df.select("series_id", "origin_ts"), hours=24, anchor=())
    assert {r.origin_ts for r in M.rolling_trees(spark, df, blocks, (1,), FEATURES, trees=1).collect()} == {T0 + timedelta(hours=h) for h in range(48, 60)}
    assert M.rolling_trees(spark, df, blocks.limit(0), (1,), FEATURES).count() == 0


def test_tree_queries_fit_every_horizon_in_full(spark):
    """The queries as they are, 300 trees of depth 6."""
    got = library.queries()["j4_trees"](spark, "/root/testdata/sf0.01").collect()
    assert sorted(r.horizon for r in got) == list(range(1, 25)) and {r.n for r in got} == {475}
    assert all(10 < r.mae < 40 for r in got)
