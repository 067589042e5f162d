from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as library
from wattline.functions import columns as C
from wattline.operators import evaluate as E
from wattline.operators import models as M
from wattline.operators import series as S
from wattline.plans import catalogue

T0 = datetime(2024, 1, 1)
SCHEMA = "series_id string, ts timestamp_ntz, v double"


def minutes(spark, pairs, name="a"):
    return spark.createDataFrame([(name, T0 + timedelta(minutes=m), v) for m, v in pairs], SCHEMA)


def hours(spark, spans):
    """Hourly rows for [(start, stop)) hours, value = hour number."""
    rows = [("a", T0 + timedelta(hours=h), float(h)) for a, b in spans for h in range(a, b)]
    return spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, kw double")


@pytest.mark.parametrize("n, kind", [(119, "short"), (120, "mid"), (1440, "mid"), (1441, "long")])
def test_gap_classes(spark, n, kind):
    gaps = S.gaps(minutes(spark, [(0, 1.0), (n + 1, 2.0)]))
    assert [r["class"] for r in S.classify_gaps(gaps).collect()] == [kind]


def test_short_gap_is_filled_on_a_line_and_edges_stay(spark):
    rows = S.impute(minutes(spark, [(5, 1.0), (9, 5.0)])).orderBy("ts").collect()
    assert [(r.v, r.impute_flag) for r in rows] == [(1.0, 0), (2.0, 1), (3.0, 1), (4.0, 1), (5.0, 0)]


def test_mid_gap_is_carried_forward_and_long_gap_stays_out(spark):
    rows = S.impute(minutes(spark, [(0, 7.0), (121, 9.0), (121 + 1442, 1.0)])).collect()
    assert sum(r.impute_flag == 2 and r.v == 7.0 for r in rows) == 120
    assert len(rows) == 3 + 120


def test_impute_equals_its_parts(spark):
    m = minutes(spark, [(0, 1.0), (3, 4.0), (200, 2.0), (2000, 1.0), (2001, 3.0)])
    parts = m.withColumn("impute_flag", F.lit(0)).union(S.interpolate_short(m)).union(S.ffill_mid(m))
    key = lambda df: sorted((r.ts, round(r.v, 9), r.impute_flag) for r in df.collect())
    assert key(S.impute(m)) == key(parts)


def test_hour_with_59_minutes_is_null(spark):
    m = minutes(spark, [(i, 1.0) for i in range(119)]).withColumn("impute_flag", F.lit(0))
    rows = S.resample_hourly(m).orderBy("ts").collect()
    assert [(r.kw, r.n_valid_min) for r in rows] == [(1.0, 60), (None, 59)]


@pytest.mark.parametrize("n, windows", [(191, 0), (192, 1), (193, 2)])
def test_segment_windows(spark, n, windows):
    seg = S.assign_segments(hours(spark, [(0, n)]))
    assert S.segment_stats(seg).first().n_windows == windows
    assert S.window_origins(seg).count() == windows == S.windows(seg).count()


def test_lags_rolls_and_targets(spark):
    seg = S.assign_segments(hours(spark, [(0, 200)]))
    r = S.feature_table(seg).orderBy("origin_ts").first()
    assert (r.lag_1h, r.lag_168h, r.roll_mean_24h, r.y[0]) == (167.0, 0.0, 155.5, 168.0)
    assert S.lag_features(seg).where(F.col("origin_ts") == r.origin_ts).first().lag_168h == 0.0
    assert abs(S.rolling_features(seg).where(F.col("origin_ts") == r.origin_ts).first().roll_std_24h - r.roll_std_24h) < 1e-9


def test_features_do_not_see_what_comes_after(spark):
    seg = S.assign_segments(hours(spark, [(0, 200)]))
    later = seg.withColumn("kw", F.when(F.col("ts") > T0 + timedelta(hours=170), -1.0).otherwise(F.col("kw")))
    cols = [f"lag_{k}h" for k in S.LAGS] + ["roll_mean_24h", "roll_std_24h", "roll_mean_168h"]
    at = lambda s: S.feature_table(s).where(F.col("origin_ts") <= T0 + timedelta(hours=170)).select("origin_ts", *cols).orderBy("origin_ts").collect()
    assert at(seg) == at(later)


def test_halo_gives_the_same_lags(spark):
    seg = S.assign_segments(hours(spark, [(0, 1500)]))
    from pyspark.sql import Window

    lag = lambda df, *k: df.withColumn("lag", F.lag("kw", 100).over(Window.partitionBy("series_id", *k).orderBy("ts")))
    whole = {(r.ts, r.lag) for r in lag(seg).collect()}
    parts = {(r.ts, r.lag) for r in lag(S.with_halo(seg), "chunk").where("own").collect()}
    assert whole == parts


def test_baselines(spark):
    pred = E.predict_baselines(S.assign_segments(hours(spark, [(0, 192)])))
    got = {(r.model, r.horizon): (r.y, r.y_hat) for r in pred.collect()}
    assert got["persistence", 24] == (191.0, 167.0)
    assert got["seasonal_naive", 1] == (168.0, 144.0)
    assert got["same_hour_mean", 1] == (168.0, 168.0 - 24 * 4)


def test_smape_and_r2_edges(spark):
    df = spark.createDataFrame([("m", 0.0, 0.0), ("m", 0.0, 0.0)], "model string, y double, y_hat double")
    r = E.metrics_pooled(df).first()
    assert r.smape is None and r.r2 is None and r.mae == 0


def test_patchify_and_pack(spark):
    x = F.array(*[F.lit(float(i)) for i in range(1, 169)])
    patches = spark.range(1).select(C.patchify(x, 168, 16, 8).alias("p")).first().p
    assert len(patches) == 21 and patches[-1][-8:] == [168.0] * 8
    rows = spark.createDataFrame([("a", h, float(h)) for h in (3, 1, 2)], "k string, horizon int, y_hat double")
    packed = C.pack_horizons(rows, ["k"])
    assert packed.first().y_hat == [1.0, 2.0, 3.0]
    assert sorted(r.horizon for r in C.unpack_horizons(packed, ["k"]).collect()) == [1, 2, 3]


def test_rolling_linear_equals_refits(spark):
    import numpy as np

    from wattline.operators import models as M

    rng = np.random.default_rng(0)
    kw = np.sin(np.arange(140) / 4) + rng.normal(0, 0.1, 140)
    rows = [("a", T0 + timedelta(hours=i), float(v)) for i, v in enumerate(kw)]
    seg = S.assign_segments(spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, kw double"))
    w = S.windows(seg, back=6, ahead=2)
    evals = w.where(F.col("origin_ts") >= T0 + timedelta(hours=80)).select("series_id", "origin_ts")
    blocks = E.rolling_blocks(evals, hours=24)
    got = {r.origin_ts: r.y_hat for r in M.rolling_linear(w, blocks, back=6, embargo_hours=2).collect()}
    for b in blocks.select("block", "block_start").distinct().collect():
        todo = w.join(blocks.where(F.col("block") == b.block), ["series_id", "origin_ts"], "left_semi")
        for r in M.linear_direct(spark, w.where(F.col("origin_ts") < b.block_start - timedelta(hours=2)), todo, back=6).collect():
            assert np.allclose(r.y_hat, got[r.origin_ts])


def _day_blocks(spark, *anchor):
    """Keys of anchor and block for blocks of a day from the first evaluated origin of each, counted in plain Python."""
    evals = catalogue.split(spark, "/root/testdata/sf0.01").where("split <> 'train'").collect()
    first = {}
    for r in evals:
        k = tuple(r[c] for c in anchor)
        first[k] = min(r.origin_ts, first.get(k, r.origin_ts))
    return {(*k, (r.origin_ts - first[k]) // timedelta(hours=24)) for r in evals for k in [tuple(r[c] for c in anchor)]}


def test_training_rows_are_counted_for_each_day(spark):
    got = library.queries()["c5_train_before_block"](spark, "/root/testdata/sf0.01").collect()
    want = _day_blocks(spark, "series_id")
    assert {(r.series_id, r.block) for r in got} == want and len(got) == len(want) > 30


def test_blocks_are_planned_for_each_day(spark):
    got = library.queries()["i4_block_plan"](spark, "/root/testdata/sf0.01").collect()
    want = _day_blocks(spark, "series_id", "segment_id")
    assert {(r.series_id, r.segment_id, r.block) for r in got} == want and len(got) == len(want) > 30


def test_rolling_query_retrains_each_week(spark, monkeypatch):
    seen = []
    real = M.rolling_linear
    monkeypatch.setattr(M, "rolling_linear", lambda rows, blocks, **settings: seen.append(blocks) or real(rows, blocks, **settings))
    library.queries()["j6_rolling"](spark, "/root/testdata/sf0.01")
    span = (F.max("origin_ts").cast("timestamp").cast("long") - F.min("origin_ts").cast("timestamp").cast("long")) / 3600
    hours = [r.h for r in seen[0].groupBy("series_id", "block").agg(span.alias("h")).collect()]
    assert 24 <= max(hours) < 168


def test_chunks_change_nothing(spark):
    seg = S.assign_segments(hours(spark, [(0, 700), (703, 1200), (1300, 1700)]))
    assert [r.length_hours for r in S.segment_stats(seg).orderBy("segment_id").collect()] == [700, 497, 400]
    for table in (S.windows, S.lag_features, S.rolling_features):
        rows = lambda unit: sorted(map(str, table(seg, unit=unit).collect()))  # noqa: B023, E731
        assert rows("WEEK") == rows("YEAR")


def test_neighbours_and_running_sums_cross_empty_chunks(spark):
    rows = [("a", T0 + timedelta(hours=h), None if h == 49 else float(h)) for h in (0, 1, 23, 49, 24 * 9, 24 * 9 + 1)] + [("b", T0, 5.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    ahead = {(r.series_id, r.v): r.n for r in S.neighbour(df, {"n": "v"}).collect()}
    assert ahead == {("a", 0.0): 1.0, ("a", 1.0): 23.0, ("a", 23.0): None, ("a", None): 216.0, ("a", 216.0): 217.0, ("a", 217.0): None, ("b", 5.0): None}
    back = {(r.series_id, r.v): r.n for r in S.neighbour(df, {"n": "v"}, ahead=False).collect()}
    assert back["a", None] == 23.0 and back["a", 216.0] is None and back["a", 0.0] is None
    sums = {(r.series_id, r.ts): r.s for r in S.running_sum(df, F.lit(1), "s").collect()}
    assert sorted(sums.values()) == [1, 1, 2, 3, 4, 5, 6]


def test_null_runs_at_the_ends_and_over_chunks(spark):
    rows = [("a", T0 + timedelta(hours=h), None if h < 2 or 20 <= h < 60 or h == 70 else 1.0) for h in range(71)]
    got = sorted((r.start, r.length) for r in S.null_runs(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(T0, 2), (T0 + timedelta(hours=20), 40), (T0 + timedelta(hours=70), 1)]


def test_several_measures_are_filled_by_the_same_gaps(spark):
    df = spark.createDataFrame([("a", T0, 1.0, 10.0), ("a", T0 + timedelta(minutes=2), 3.0, 30.0)], "series_id string, ts timestamp_ntz, v double, u double")
    assert [(r.v, r.u, r.impute_flag) for r in S.impute(df, cols=("v", "u")).orderBy("ts").collect()] == [(1.0, 10.0, 0), (2.0, 20.0, 1), (3.0, 30.0, 0)]


def test_exact_quantiles_of_heavy_ties(spark):
    import numpy as np

    from wattline.operators import profile as P

    rng = np.random.default_rng(3)
    values = [*np.zeros(3000), *rng.normal(0, 1, 777).round(2), 1e9]
    df = spark.createDataFrame([("x", float(v)) for v in values] + [("y", 2.0), ("y", None)], "k string, v double")
    got = {r.k: r for r in P.exact_quantiles(df, ["k"], "v", [0.0, 0.01, 0.25, 0.9, 0.999, 1.0]).collect()}
    assert np.allclose(got["x"].qs, np.quantile(values, [0.0, 0.01, 0.25, 0.9, 0.999, 1.0])) and got["x"].n_distinct == len(set(values))
    assert got["y"].qs == [2.0] * 6 and P.exact_quantiles(df.limit(0), ["k"], "v", [0.5]).count() == 0


def test_invariants_name_what_is_broken(spark):
    raw = minutes(spark, [(i, float(i % 7)) for i in range(0, 300, 2)] + [(500, 1.0), (501, 2.0), (5000, 1.0)])
    m = S.impute(raw)
    h = S.resample_hourly(m)
    stats = S.segment_stats(S.assign_segments(h))
    failed = lambda *tables: {r.check for r in E.run_invariants(*tables, least_windows=0).where("not ok").collect()}
    assert failed(raw, m, h, stats) == set() and E.run_invariants(raw, m, h, stats).count() == 15
    assert failed(raw, m.union(m.limit(1)), h, stats) >= {"minute_keys_unique"}
    assert failed(raw, m.withColumn("impute_flag", F.lit(0)), h, stats) >= {"rows_kept", "times_match_raw", "flags_match"}
    assert failed(raw, m.withColumn("v", F.when(F.col("impute_flag") == 2, 9.0).otherwise(F.col("v"))), h, stats) >= {"mid_fills_constant"}
    assert failed(raw, m, h.withColumn("kwh", F.col("kwh") * 1.5), stats) == {"kwh_is_sum", "energy_conserved"}
    assert failed(raw, m, h, stats.withColumn("n_windows", F.lit(3))) == {"segments_match"}
    with pytest.raises(ValueError, match="enough_windows"):
        E.demand(E.run_invariants(raw, m, h, stats))


def test_rolling_trees_see_only_what_is_before_the_block(spark):
    seg = S.assign_segments(hours(spark, [(0, 460)]))
    rows = S.feature_table(seg)
    evals = rows.where(F.col("origin_ts") >= T0 + timedelta(hours=260)).select("series_id", "origin_ts")
    blocks = E.rolling_blocks(evals, anchor=())
    seen = []

    def fitter(train):
        last, n = train.agg(F.max("origin_ts"), F.count("*")).first()
        seen.append((last, n))
        return lambda todo: todo.select("series_id", "origin_ts", F.lit(n).alias("n"))

    got = M.rolling_fit_predict(rows, blocks, fitter)
    starts = sorted(r.block_start for r in blocks.select("block_start").distinct().collect())
    assert len(starts) == 2 and [s[0] for s in seen] == [b - timedelta(hours=25) for b in starts]
    assert got.count() == evals.count() and got.select("block").distinct().count() == 2
    done = M.rolling_fit_predict(rows, blocks.where("block = 1"), M.boosters_fitter(spark, horizons=(1, 24), trees=2, depth=2))
    assert {r.horizon for r in done.select("horizon").distinct().collect()} == {1, 24} and done.where("y_hat is null").isEmpty()


def test_rolling_days_cross_years(spark):
    rows = [("a", datetime(2023, 11, 20) + timedelta(days=i), None if i % 5 == 0 else float(i)) for i in range(90)]
    daily = spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, kw double")
    got = {r.ts: r.roll for r in S.rolling_daily(daily).collect()}
    for i, (_, ts, _) in enumerate(rows):
        last = [v for _, _, v in rows[max(0, i - 29) : i + 1] if v is not None]
        assert got[ts] == (pytest.approx(sum(last) / len(last)) if len(last) >= 15 else None)
