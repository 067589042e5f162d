"""The streamed roll-up: several batches equal one, late minutes are dropped, a second run goes on."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from wattline.operators import series as S
from wattline.sources import tables as T
from wattline.streaming import rollup

T0 = datetime(2024, 1, 1)


def _minutes(spark, spans, v=1.0):
    rows = [(s, T0 + timedelta(minutes=m), v + m % 7, 0) for s, a, b in spans for m in range(a, b)]
    return spark.createDataFrame(rows, rollup.MINUTES)


def _run(spark, source, folder):
    rollup.write_hours(rollup.hours(rollup.read_minutes(spark, source)), f"{folder}/hours", f"{folder}/checkpoint")
    return {(r.series_id, r.ts): (r.kw, r.kwh, r.n_valid_min) for r in rollup.latest_hours(spark, f"{folder}/hours").collect()}


def test_replayed_batches_equal_the_batch_roll_up(spark):
    source, folder = T.scratch(spark), T.scratch(spark)
    parts = [[("a", 0, 90), ("b", 30, 100)], [("a", 90, 150), ("b", 100, 240)], [("a", 200, 400)]]
    for p in parts[:2]:
        _minutes(spark, p).coalesce(1).write.mode("append").parquet(source)
    _run(spark, source, folder)
    _minutes(spark, parts[2]).coalesce(1).write.mode("append").parquet(source)
    got = _run(spark, source, folder)  # goes on where it ended
    every = _minutes(spark, [x for p in parts for x in p])
    want = {(r.series_id, r.ts): (r.kw, r.kwh, r.n_valid_min) for r in S.resample_hourly(every).where("n_valid_min > 0").collect()}
    assert got == want and sum(k is not None for k, *_ in want.values()) == 7


def test_minutes_behind_the_watermark_are_dropped(spark):
    source, folder = T.scratch(spark), T.scratch(spark)
    for p in ([("a", 0, 30)], [("a", 600, 660)], [("a", 660, 661)], [("a", 30, 60), ("a", 590, 600)]):
        _minutes(spark, p).coalesce(1).write.mode("append").parquet(source)
    got = _run(spark, source, folder)
    assert got["a", T0][2] == 30  # the rest came ten hours later
    assert got["a", T0 + timedelta(hours=9)][2] == 10 and got["a", T0 + timedelta(hours=10)][2] == 60
