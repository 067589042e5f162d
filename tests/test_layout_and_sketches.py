"""Bucketed layout, stored sketches, frequent values, broken lines."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wattline.operators import evaluate as E
from wattline.operators import series as S
from wattline.operators import sketches as K
from wattline.plans import catalogue
from wattline.sources import tables as T

T0 = datetime(2024, 1, 1)


def test_stored_predictions_join_without_exchange(spark):
    pred, hours, origins = catalogue.stored_layout(spark, "/root/testdata/sf0.01", 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (E.attach_truth(pred, hours, catalogue.LAYOUT), E.restrict_to(pred, origins, catalogue.LAYOUT), E.common_origins(pred, 3, catalogue.LAYOUT)):
            assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
        got = E.attach_truth(pred, hours, catalogue.LAYOUT)
        assert got.count() == pred.count() == got.where("truth = y").count() > 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_layout_of_origins_at_the_end_of_a_month(spark):
    rows = [("a", datetime(2024, 1, 20) + timedelta(hours=h), float(h)) for h in range(500)]
    seg = S.assign_segments(spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, kw double"))
    pred, hours, origins = E.laid_out(E.predict_baselines(seg), seg, S.window_origins(seg))
    got = E.attach_truth(pred, hours, catalogue.LAYOUT)
    assert got.count() == pred.count() == got.where("truth = y").count()
    assert E.common_origins(pred, 3, catalogue.LAYOUT).count() == origins.count() == 500 - 191


def test_sketches_of_days_merge_and_are_replaced_by_day(spark):
    path = T.scratch(spark)
    day = lambda d, n: spark.range(n).select(F.lit("a").alias("series_id"), F.lit(T0 + timedelta(days=d)).cast("timestamp_ntz").alias("ts"), ((F.col("id") * 7919) % 10_007).cast("double").alias("v"))
    K.save_sketches(K.day_sketches(day(0, 5000).union(day(1, 20_000))), path)
    K.save_sketches(K.day_sketches(day(1, 10_000)), path)  # again: the day is replaced
    K.save_sketches(K.day_sketches(day(2, 100).withColumn("v", F.lit(None).cast("double"))), path)  # nothing but nulls
    rows = K.load_sketches(spark, path)
    assert {str(r.day): r.n for r in rows.collect()} == {"2024-01-01": 5000, "2024-01-02": 10_000}
    one = K.load_sketches(spark, path, T0 + timedelta(days=1), T0 + timedelta(days=1))
    assert "PartitionFilters: [isnotnull(day" in one._jdf.queryExecution().executedPlan().toString()
    for part, n in ((rows, 15_000), (one, 10_000)):
        both = K.merged(part)
        assert both.first().n == n and abs(K.sketched_distinct(both).first().n_distinct - 10_000) < 500
        values = sorted(r.v for r in (day(0, 5000).union(day(1, 10_000)) if n == 15_000 else day(1, 10_000)).collect())
        for r in K.sketched_quantiles(both).collect():
            place = sum(v <= r.value for v in values)
            assert abs(place - r.q * n) < 0.015 * n


@pytest.mark.parametrize("tracked", [64, 1 << 14])
def test_top_values_equal_a_full_count(spark, tracked):
    n = F.col("id")
    df = spark.range(20_000).select(
        F.when(n % 3 == 0, 7).otherwise(n % 11).cast("double").alias("skewed"), n.cast("double").alias("unique"), F.when(n % 2 == 0, n % 4).cast("double").alias("tied"), F.lit(None).cast("double").alias("empty")
    )
    cols = df.columns
    want = {}
    for c in cols:
        ranked = df.where(F.col(c).isNotNull()).groupBy(c).count().orderBy(F.desc("count"), c).limit(3).collect()
        want |= {(c, i + 1): (r[c], r["count"]) for i, r in enumerate(ranked)}
    assert {(r.col, r.rank): (r.value, r.n) for r in K.top_values(df, cols, tracked=tracked).collect()} == want
    assert K.top_values(df.limit(0), cols).count() == 0


def test_broken_lines_are_kept_apart_in_order(spark, tmp_path):
    lines = ["Date;Time;v", "1/1/2024;0:00:00;1.5", "1/1/2024;0:01:00;?", "broken", "1/1/2024;0:02:00;x", "1/1/2024;0:03:00;2;3", "1/1/2024;0:04:00", "1/1/2024;0:05:00;4"]
    (tmp_path / "a.txt").write_text("\n".join(lines) + "\n")
    (tmp_path / "b.txt").write_text("Date;Time;v\n1/1/2024;0:06:00;5\n")
    good, bad = T.read_rescued(spark, f"file://{tmp_path}", ["v"])
    rows = T.parse_ts(good).orderBy("file", "place").collect()
    assert [r.v for r in rows] == [1.5, None, 4.0, 5.0] and [r.ts.minute for r in rows] == [0, 1, 5, 6]
    assert [r.line for r in bad.orderBy("place").collect()] == [lines[i] for i in (3, 4, 5, 6)]
    from wattline.operators import profile as P

    per_file = T.parse_ts(good).select(F.col("file").alias("series_id"), "ts", "place")
    assert all(r.increasing for r in P.profile_time(per_file, "place").collect())


def test_what_was_kept_is_deleted(spark):
    import os

    rows, path = T.keep(spark, spark.range(3))
    local = path.removeprefix("file://")
    assert rows.count() == 3 and os.path.isdir(local)
    assert T.clear(spark) >= 1 and not os.path.exists(local) and T.clear(spark) == 0
