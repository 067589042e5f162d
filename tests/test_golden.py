"""The published calendar: seven segments of hours, from which splits, blocks, folds and slices follow without any value."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wattline.operators import evaluate as E
from wattline.operators import series as S

SEGMENTS = [("2006-12-16 18", 3174), ("2007-04-30 15", 18585), ("2009-06-15 08", 5070), ("2010-01-14 20", 1543), ("2010-03-21 14", 3583), ("2010-08-22 22", 797), ("2010-09-28 20", 1417)]


@pytest.fixture(scope="module")
def calendar(spark):
    """The segmented hours, their origins by split, and the evaluated blocks with their plan."""
    starts = spark.createDataFrame([(datetime.strptime(s, "%Y-%m-%d %H"), n) for s, n in SEGMENTS], "lo timestamp_ntz, n int")
    rows = starts.select(F.lit("a").alias("series_id"), F.explode(F.sequence("lo", F.expr("lo + make_dt_interval(0, n - 1)"), F.expr("INTERVAL 1 HOUR"))).alias("ts"), F.lit(1.0).alias("kw"))
    seg = S.assign_segments(rows).cache()
    split = E.time_split(S.window_origins(seg)).cache()
    blocks = {p: E.rolling_blocks(split.where(F.col("split") == p), anchor=("series_id", "segment_id")).cache() for p in ("val", "test")}
    plans = {p: E.block_plan(b, S.segment_stats(seg)).cache() for p, b in blocks.items()}
    keys = ["series_id", "segment_id", "block"]
    covered = {p: blocks[p].join(plans[p].where("not skip").select(*keys), keys, "left_semi").cache() for p in blocks}
    return seg, split, plans, covered


def test_segments_and_splits(calendar):
    seg, split, *_ = calendar
    stats = S.segment_stats(seg).orderBy("segment_id").collect()
    assert [r.n_windows for r in stats] == [2983, 18394, 4879, 1352, 3392, 606, 1226]
    first = split.first()
    assert (first.cut_val, first.cut_test) == (datetime(2009, 8, 28), datetime(2010, 4, 10))
    assert {r.split: r["count"] for r in split.groupBy("split").count().collect()} == {"train": 22978, "val": 4929, "test": 4925}


def test_blocks_and_what_they_cover(calendar):
    _, split, plans, covered = calendar
    anchored = lambda p: E.rolling_blocks(split.where(F.col("split") == p), anchor=("series_id",)).select("block").distinct().count()
    assert (anchored("val"), anchored("test")) == (33, 31)
    for p, n in (("val", 4593), ("test", 4589)):
        plan = plans[p].collect()
        assert [r.history for r in plan if r.skip] == [167, 167] and len(plan) == 31
        assert covered[p].count() == n


def test_slices_of_the_covered_test_points(calendar):
    rows = calendar[3]["test"].select("series_id", "origin_ts", F.explode(F.sequence(F.lit(1), F.lit(24)).cast("array<long>")).alias("horizon"))
    pred = rows.select("*", F.lit("m").alias("model"), F.lit(1.0).alias("y"), F.lit(1.5).alias("y_hat"))
    got = {(r.dimension, r.slice): r.n for r in E.error_attribution(pred).collect()}
    assert got == {
        ("overall", "all"): 110136, ("time_of_day", "night"): 32123, ("time_of_day", "day"): 50479, ("time_of_day", "evening"): 27534, ("kind_of_day", "weekend"): 30813,
        ("kind_of_day", "weekday"): 79323, ("quarter", "Q2"): 47232, ("quarter", "Q3"): 37512, ("quarter", "Q4"): 25392,
    }
    assert E.granularity_bridge(pred).first().daily_n_days == 191
    assert calendar[1].where("split = 'test' and hour(origin_ts) = 23").count() == 205


def test_folds(calendar):
    split = calendar[1]
    assert split.where("origin_ts < cut_test").count() == 27907
    folds = E.rolling_origin_folds(split).groupBy("fold").agg(F.min("origin_ts").alias("first"), F.count("*").alias("n"), F.max("n_train").alias("n_train")).orderBy("fold").collect()
    assert [r.first for r in folds] == [datetime(2007, 10, 21), datetime(2008, 8, 6, 17), datetime(2009, 5, 24, 10)]
    assert [(r.n, r.n_train) for r in folds] == [(720, 6977), (720, 13954), (720, 20931)]
