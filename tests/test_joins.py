"""Interval join by cells, training states of blocks, and ranges of dates."""

import math
import random
import statistics
from datetime import datetime, timedelta

from wattline.operators import evaluate as E

T0 = datetime(2024, 1, 1)
hour = lambda h: T0 + timedelta(hours=h)


def test_interval_join_equals_brute_force(spark):
    rng = random.Random(1)
    spans = []
    for i in range(300):  # minutes to decades, overlapping
        a = rng.uniform(0, 4000)
        spans.append((rng.choice("ab"), hour(a), hour(a + rng.choice([0, 0.5, 3, 40, 700, 9000, 200_000])), i))
    spans += [("a", hour(5), hour(4), 900), ("a", None, hour(4), 901), ("a", hour(4), None, 902)]
    rows = [(rng.choice("abc"), hour(rng.uniform(-10, 5000)), i) for i in range(400)]
    rows += [("a", s[1], 1000 + k) for k, s in enumerate(spans[:20])] + [("a", s[2], 2000 + k) for k, s in enumerate(spans[:20])] + [("a", None, 5), ("a", hour(7), 5), ("a", hour(7), 5)]
    left = spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, nr int")
    right = spark.createDataFrame(spans, "series_id string, start timestamp_ntz, end timestamp_ntz, segment_id int")
    got = sorted((str(r.series_id), str(r.ts), r.nr, r.segment_id or -1) for r in E.assign_interval(left, right).collect())
    want = []
    for s, t, nr in rows:
        found = [i for k, a, b, i in spans if k == s and None not in (a, b, t) and a <= t <= b]
        want += [(s, str(t), nr, i or -1) for i in found or [0]]
    assert got == sorted(want)
    assert E.assign_interval(left, right.limit(0)).where("segment_id is null").count() == len(rows)


def test_many_intervals_of_one_series_meet_few_rows(spark):
    n = 10_000
    right = spark.range(n).selectExpr("'a' AS series_id", "timestamp_ntz'2000-01-01' + make_dt_interval(0, int(id) * 3) AS start", "timestamp_ntz'2000-01-01' + make_dt_interval(0, int(id) * 3 + 2) AS end", "id AS segment_id")
    left = spark.range(3 * n).selectExpr("'a' AS series_id", "timestamp_ntz'2000-01-01' + make_dt_interval(0, int(id)) AS ts", "id")
    done = E.assign_interval(left, right)
    assert done.where("segment_id = id div 3").count() == 3 * n
    assert "CartesianProduct" not in done._jdf.queryExecution().toString() and "BroadcastNestedLoop" not in done._jdf.queryExecution().toString()


def test_training_states_equal_refits(spark):
    rng = random.Random(2)
    rows = [(s, hour(h), None if h % 13 == 0 else 1e6 + rng.gauss(0, 1), rng.random()) for s in "ab" for h in range(0, 1500, 1 if s == "a" else 3)]
    starts = [("a", b, hour(24 + 100 * b + 5)) for b in range(12)] + [("b", 3, hour(600)), ("b", 7, hour(10))]
    df = spark.createDataFrame(rows, "series_id string, origin_ts timestamp_ntz, kw double, x double")
    blocks = spark.createDataFrame(starts, "series_id string, block long, block_start timestamp_ntz")
    got = {(r.series_id, r.block): r for r in E.train_states(df, blocks, ("kw", "x"), embargo_hours=24).collect()}
    assert len(got) == len(starts)
    for s, b, start in starts:
        own = [r for r in rows if r[0] == s and r[1] < start - timedelta(hours=24)]
        r = got[s, b]
        assert r.n_train == len(own)
        for name, at in (("kw", 2), ("x", 3)):
            v = [x[at] for x in own if x[at] is not None]
            if len(v) > 1:
                assert math.isclose(r[f"{name}_mean"], statistics.fmean(v), rel_tol=1e-12) and math.isclose(r[f"{name}_std"], statistics.stdev(v), rel_tol=1e-7)
            else:
                assert r[f"{name}_std"] is None
    todo = df.withColumnRenamed("x", "other").selectExpr("*", "3L AS block")
    scaled = E.apply_states(todo, E.train_states(df, blocks, ("kw",)), ("kw",)).where("kw is not null")
    assert scaled.count() == todo.where("kw is not null").count()


def test_date_range_reaches_the_scan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    lo = df.selectExpr("date_trunc('DAY', min(ts)) AS lo").first().lo
    rows = E.date_range(df, lo + timedelta(days=1), lo + timedelta(days=2))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan and "LessThanOrEqual(ts" in plan
    assert 0 < rows.count() < df.count()
