"""Splits, blocks, forecasts of stateless models, scores and comparisons."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import block_no, floor_day, hours_between, minutes_between, plus_hours, smape_term, trunc
from ..sources.tables import keep
from .series import by_series, neighbour, running_sum, with_halo

# --- stateless forecasters: what is forecast for an hour depends on that hour alone, but for persistence


def seasonal_naive(w, season: int = 24) -> Column:
    return F.lag("kw", season).over(w)


def same_hour_mean(w, days: int = 7) -> Column:
    return reduce(lambda a, b: a + b, [F.lag("kw", 24 * j).over(w) for j in range(1, days + 1)]) / days


BASELINES = ("persistence", "seasonal_naive", "same_hour_mean")


def predict_baselines(segmented: DataFrame, models: tuple[str, ...] = BASELINES, back: int = 168, ahead: int = 24, unit: str = "MONTH") -> DataFrame:
    """(series_id, segment_id, origin_ts, model, horizon, y, y_hat) of all origins with ``back`` hours up to them and ``ahead`` after.

    The forecasts for an hour are worked out once, at that hour; an origin then has those of its next hours from the
    same window, and its own value for persistence. Long segments are chunks with a halo; rows grow with horizons only
    here, below the aggregates of the scores.
    """
    w = by_series("segment_id", "chunk")
    at = {"seasonal_naive": seasonal_naive(w), "same_hour_mean": same_hour_mean(w)}
    rows = with_halo(segmented, unit, back, ahead).select("own", "series_id", "segment_id", "chunk", "ts", "kw", F.count("*").over(w.rowsBetween(1 - back, 0)).alias("_n"), *[at[m].alias(m) for m in models if m in at])
    hour = F.struct(F.col("kw").alias("y"), *[m for m in models if m in at])
    rows = rows.select("own", "series_id", "segment_id", F.col("ts").alias("origin_ts"), F.col("kw").alias("persistence"), "_n", F.collect_list(hour).over(w.rowsBetween(1, ahead)).alias("x"))
    rows = rows.where(F.col("own") & (F.col("_n") == back) & (F.size("x") == ahead))
    rows = rows.select("series_id", "segment_id", "origin_ts", "persistence", F.posexplode("x").alias("h", "x"))
    every = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), (F.col("x")[m] if m in at else F.col(m)).alias("y_hat")) for m in models])).alias("m")
    rows = rows.select("series_id", "segment_id", "origin_ts", (F.col("h") + 1).cast("long").alias("horizon"), F.col("x.y").alias("y"), every)
    return rows.select("series_id", "segment_id", "origin_ts", "m.model", "horizon", "y", "m.y_hat")


# --- splits


def time_split(origins: DataFrame, val: float = 0.15, test: float = 0.15) -> DataFrame:
    """origins with split: cut points at the origins of index n * 0.70 and n * 0.85, floored to midnight.

    Exact without a sort of all rows: the cuts are days, found on the counts of days.
    """
    days = origins.groupBy("series_id", floor_day("origin_ts").alias("day")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("series_id")
    upto = F.sum("n").over(w.orderBy("day").rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("n").over(w)
    days = days.select("series_id", "day", upto.alias("upto"), total.alias("total"))
    at = lambda share: F.min(F.when(F.col("upto") > F.floor(F.round(F.col("total") * share, 6)), F.col("day")))
    cuts = days.groupBy("series_id").agg(at(1 - val - test).alias("cut_val"), at(1 - test).alias("cut_test"))
    split = F.when(F.col("origin_ts") < F.col("cut_val"), "train").when(F.col("origin_ts") < F.col("cut_test"), "val").otherwise("test")
    return origins.join(cuts, "series_id").withColumn("split", split)


def rolling_origin_folds(origins: DataFrame, k: int = 3, cap: int = 720, min_train: int = 500, min_val: int = 100) -> DataFrame:
    """(series_id, origin_ts, fold) of validation rows: origins before cut_test in k + 1 near-equal chunks; fold i validates on chunk i + 1."""
    rows = origins.where(F.col("origin_ts") < F.col("cut_test"))
    total = rows.groupBy("series_id").agg(F.count("*").alias("n"))
    rows = running_sum(rows, F.lit(1), "rn", order="origin_ts", unit="MONTH").withColumn("rn", F.col("rn") - 1).join(total, "series_id")
    size, extra = F.floor(F.col("n") / (k + 1)), F.pmod(F.col("n"), F.lit(k + 1))
    head = extra * (size + 1)
    chunk = F.when(F.col("rn") < head, F.floor(F.col("rn") / (size + 1))).otherwise(extra + F.floor(F.try_divide(F.col("rn") - head, size)))
    rows = rows.withColumn("fold", chunk.cast("long")).where("fold > 0")
    folds = rows.groupBy("series_id", "fold").agg(F.min("rn").alias("n_train"), F.least(F.count("*"), F.lit(cap)).alias("n_val"))
    folds = folds.where((F.col("n_train") >= min_train) & (F.col("n_val") >= min_val))  # k rows for each series
    rows = rows.join(folds, ["series_id", "fold"]).where(F.col("rn") < F.col("n_train") + cap)
    return rows.select("series_id", "origin_ts", "fold", F.col("n_train").cast("long").alias("n_train"), F.col("n_val").cast("long").alias("n_val"))


def rolling_blocks(evals: DataFrame, hours: int = 168, anchor: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """evals with block and block_start, the first origin present in the block; anchored at the first of ``anchor``, or of all if it is empty."""
    first = evals.groupBy(*anchor).agg(F.min("origin_ts").alias("t0"))
    rows = evals.join(first, list(anchor)) if anchor else evals.crossJoin(F.broadcast(first))  # one row
    rows = rows.withColumn("block", block_no(F.col("origin_ts"), F.col("t0"), hours).cast("long")).drop("t0")
    starts = rows.groupBy(*anchor, "block").agg(F.min("origin_ts").alias("block_start"))  # one row for each week of an anchor
    return rows.join(starts, [*anchor, "block"])


def block_plan(blocks: DataFrame, stats: DataFrame, back: int = 168) -> DataFrame:
    """(series_id, segment_id, block, block_start, history, skip, val_size) of blocks anchored per segment."""
    starts = blocks.select("series_id", "segment_id", "block", "block_start").distinct()
    rows = starts.join(stats.select("series_id", "segment_id", "start"), ["series_id", "segment_id"])
    rows = rows.withColumn("history", hours_between("start", "block_start"))
    spare = F.col("history") - back
    tail = F.when(spare >= 24, F.least(F.floor(spare / 4), F.lit(720))).otherwise(0)
    return rows.withColumn("skip", F.col("history") < back).withColumn("val_size", tail.cast("long")).drop("start")


def train_states(rows: DataFrame, starts: DataFrame, cols: tuple[str, ...] = (), embargo_hours: int = 24) -> DataFrame:
    """(series_id, block, n_train, {col}_mean, {col}_std): of the rows that may teach each block, those with origin_ts before its start less the embargo.

    starts has a row for each (series_id, block). A row is counted once, in the first block that it teaches, by the
    number of cut-offs before it; sums of deviations from the series' mean are prefix-merged over the blocks of a series
    (one row for each week), so no row is copied for a block. Nulls are left out of a column's figures.
    """
    nothing = F.lit(None)
    own = ["series_id", "origin_ts"]
    by_time = Window.partitionBy("series_id").orderBy("block_start", "block")  # one row for each block of a series
    plan = starts.select("series_id", "block", "block_start").withColumn("place", F.row_number().over(by_time))
    each = rows.select("series_id", F.col("origin_ts").alias("ts"), F.lit(0).alias("cut"), *[F.col(c).cast("double").alias(c) for c in cols])
    cuts = plan.select("series_id", plus_hours(F.col("block_start"), -embargo_hours).alias("ts"), F.lit(1).alias("cut"), *[nothing.cast("double").alias(c) for c in cols])
    placed = running_sum(each.union(cuts), F.col("cut"), "passed", unit="MONTH", then="-cut").where("cut = 0")  # at one time the cut comes first
    middle = rows.groupBy("series_id").agg(F.count("*").alias("_n"), *[F.avg(c).alias(f"_{c}") for c in cols])
    off = lambda c: F.col(c) - F.col(f"_{c}")
    sums = placed.join(middle, "series_id").groupBy("series_id", (F.col("passed") + 1).alias("place"), *[f"_{c}" for c in cols]).agg(
        F.count("*").alias("n"), *[f(c).alias(f"{c}_{k}") for c in cols for k, f in (("n", F.count), ("s", lambda c: F.sum(off(c))), ("q", lambda c: F.sum(off(c) * off(c))))]
    )
    upto = Window.partitionBy("series_id").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    names = ["n", *[f"{c}_{k}" for c in cols for k in "nsq"]]
    both = plan.join(sums, ["series_id", "place"], "left").join(middle.select("series_id", *[F.col(f"_{c}").alias(f"{c}_m") for c in cols]), "series_id", "left")
    both = both.select("series_id", "block", *[f"{c}_m" for c in cols], *[F.coalesce(F.sum(c).over(upto), F.lit(0)).alias(c) for c in names])
    spread = lambda c: F.col(f"{c}_q") - F.try_divide(F.col(f"{c}_s") * F.col(f"{c}_s"), F.col(f"{c}_n"))
    figures = [x for c in cols for x in (
        (F.col(f"{c}_m") + F.try_divide(f"{c}_s", f"{c}_n")).alias(f"{c}_mean"),
        F.when(F.col(f"{c}_n") > 1, F.sqrt(F.greatest(F.lit(0.0), spread(c)) / (F.col(f"{c}_n") - 1))).alias(f"{c}_std"),
    )]
    return both.select("series_id", F.col("block").cast("long").alias("block"), F.col("n").cast("long").alias("n_train"), *figures)


def apply_states(rows: DataFrame, states: DataFrame, cols: tuple[str, ...]) -> DataFrame:
    """rows (series_id, block, ...) with each of cols scaled by what could teach its block; null where that tells nothing."""
    scaled = {c: F.try_divide(F.col(c) - F.col(f"{c}_mean"), F.col(f"{c}_std")) for c in cols}
    both = rows.join(states.select("series_id", "block", *[f"{c}_{k}" for c in cols for k in ("mean", "std")]), ["series_id", "block"], "left")
    return both.select(*[scaled[c].alias(c) if c in scaled else F.col(c) for c in rows.columns])


def check_alignment(pred: DataFrame, origins: DataFrame, ahead: int = 24, hourly: DataFrame | None = None) -> DataFrame:
    """(check, n_bad): origins without exactly ``ahead`` distinct horizons, predicted but not asked for, asked for but not predicted.

    With hourly (series_id, segment_id, ts), also the segments in which the hours from the first origin to ``ahead``
    after the last one are not as many as its origins and ``ahead`` more.
    """
    keys = ["series_id", "origin_ts"]
    per = pred.groupBy(*keys).agg(F.count("*").alias("n"), F.count_distinct("horizon").alias("d"), F.min("horizon").alias("lo"), F.max("horizon").alias("hi"))
    bad = per.where((F.col("n") != ahead) | (F.col("d") != ahead) | (F.col("lo") != 1) | (F.col("hi") != ahead))
    count = lambda df, name: df.agg(F.count("*").alias("n_bad")).select(F.lit(name).alias("check"), "n_bad")
    found = count(bad, "horizons").union(count(per.join(origins, keys, "left_anti"), "unasked")).union(count(origins.join(per, keys, "left_anti"), "unpredicted"))
    if hourly is None:
        return found
    segment = ["series_id", "segment_id"]
    ends = origins.groupBy(*segment).agg(F.min("origin_ts").alias("lo"), F.max("origin_ts").alias("hi"), F.count("*").alias("n"))
    inside = hourly.select(*segment, "ts").join(ends, segment).where((F.col("ts") >= F.col("lo")) & (F.col("ts") <= plus_hours(F.col("hi"), ahead)))
    spans = inside.groupBy(*segment, "n").agg(F.count("*").alias("hours")).where(F.col("hours") != F.col("n") + ahead)
    return found.union(count(spans, "span"))


# --- joins


#: Hours of the smallest cell, how much larger each next size is, and how many cells of its size an interval may touch.
CELL, GROWTH, TOUCHED = 6, 16, 17


def _cell(ts: Column, level: Column) -> Column:
    hours = F.timestamp_diff("HOUR", F.lit("1970-01-01").cast("timestamp_ntz"), ts)
    return F.floor(hours / (CELL * F.pow(F.lit(GROWTH), level))).cast("long")


def assign_interval(df: DataFrame, intervals: DataFrame, name: str = "segment_id") -> DataFrame:
    """df with the interval (series_id, start, end, name; both ends inside) that each row's ts is in: a row for each if there are several, null if there is none.

    Intervals are cut into cells of time, of a size that grows with their length, so that each touches few; rows and
    intervals meet by series, size and cell and are then held against the ends. So a series may have any number of
    intervals, as long as few overlap. Intervals without start, end or length are never met.
    """
    good = intervals.where(F.col("start") <= F.col("end")).select(F.col("series_id").alias("_s"), F.col("start").alias("_a"), F.col("end").alias("_b"), F.col(name).alias("_i"))
    steps = (F.timestamp_diff("HOUR", F.col("_a"), F.col("_b")) + 1) / (CELL * (TOUCHED - 1))
    level = reduce(lambda a, b: a + b, [(steps > GROWTH**k).cast("int") for k in range(6)])
    good = good.withColumn("_level", level)
    cells = good.withColumn("_cell", F.explode(F.sequence(_cell(F.col("_a"), F.col("_level")), _cell(F.col("_b"), F.col("_level")))))
    levels = sorted(r["_level"] for r in good.select("_level").distinct().collect())  # a handful: sizes grow by GROWTH
    keys = df.select(F.col("series_id").alias("_k"), F.col("ts").alias("_t")).where("_t is not null").distinct()
    asked = keys.withColumn("_level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))).withColumn("_cell", _cell(F.col("_t"), F.col("_level")))
    on = (F.col("_k") == F.col("_s")) & (asked["_level"] == cells["_level"]) & (asked["_cell"] == cells["_cell"]) & F.col("_t").between(F.col("_a"), F.col("_b"))
    met = asked.join(cells, on).select("_k", "_t", "_i")
    both = df.join(met, (F.col("series_id") == F.col("_k")) & (F.col("ts") == F.col("_t")), "left")
    return both.select(*df.columns, F.col("_i").alias(name))


def attach_truth(pred: DataFrame, hourly: DataFrame, keys: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """pred with target_ts and the load there (truth); keys are what both tables are laid out by."""
    truth = hourly.select(*keys, F.col("ts").alias("target_ts"), F.col("kw").alias("truth"))
    return pred.withColumn("target_ts", plus_hours(F.col("origin_ts"), F.col("horizon"))).join(truth, [*keys, "target_ts"], "left")


def restrict_to(pred: DataFrame, origins: DataFrame, keys: tuple[str, ...] = ("series_id",)) -> DataFrame:
    return pred.join(origins.select(*keys, "origin_ts"), [*keys, "origin_ts"], "left_semi")


def common_origins(pred: DataFrame, n_models: int, keys: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """Origins that all models predict: one aggregation for any number of models."""
    rows = pred.groupBy(*keys, "origin_ts").agg(F.count_distinct("model").alias("n"))
    return rows.where(F.col("n") == n_models).drop("n")


def laid_out(pred: DataFrame, hourly: DataFrame, origins: DataFrame, unit: str = "MONTH", ahead: int = 24) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three with ``chunk``, the unit of time of an origin; hours are in the chunk of every origin that looks ahead at them.

    Written with write_bucketed() by (series_id, chunk), attach_truth, restrict_to and common_origins with these keys
    need no exchange, and a long series is many buckets.
    """
    chunk = trunc(unit, "origin_ts").alias("chunk")
    return pred.select("*", chunk), with_halo(hourly, unit, 0, ahead).drop("own"), origins.select("series_id", "origin_ts", chunk)


def assemble_results(*parts: DataFrame, anchors: DataFrame | None = None) -> DataFrame:
    """The rows of all parts, and of anchors (results from elsewhere), with ``place``: the order of the parts; missing columns are NULL."""
    every = [*parts, *([] if anchors is None else [anchors])]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [p.withColumn("place", F.lit(i).cast("long")) for i, p in enumerate(every)])


# --- scores


def _scores() -> list[Column]:
    e = F.col("y_hat") - F.col("y")
    sse, sst = F.sum(e * e), F.var_pop("y") * F.count("y")
    return [
        F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(smape_term(F.col("y"), F.col("y_hat"))).alias("smape"), F.try_subtract(F.lit(1.0), F.try_divide(sse, sst)).alias("r2"),
    ]


def metrics_pooled(pred: DataFrame, keys=("model",)) -> DataFrame:
    return pred.groupBy(*keys).agg(*_scores())


def metrics_by_horizon(pred: DataFrame, keys=("model",)) -> DataFrame:
    return pred.groupBy(*keys, "horizon").agg(*_scores())


def metrics_horizon_mean(pred: DataFrame, keys=("model",)) -> DataFrame:
    return metrics_by_horizon(pred, keys).groupBy(*keys).agg(*[F.avg(c).alias(c) for c in ("mae", "rmse", "smape", "r2")])


def horizon_growth(by_horizon: DataFrame, last: int = 24) -> DataFrame:
    at = lambda h: F.max(F.when(F.col("horizon") == h, F.col("mae")))
    return by_horizon.groupBy("model").agg((F.try_divide(at(last), at(1)) - 1).alias("growth"))


def error_attribution(pred: DataFrame) -> DataFrame:
    """Per model: overall, time of day and kind of day of the target, quarter of the origin; one pass with grouping sets."""
    target = plus_hours(F.col("origin_ts"), F.col("horizon"))
    h = F.hour(target)
    rows = pred.select(
        "model",
        F.when(h <= 6, "night").when(h <= 17, "day").otherwise("evening").alias("time_of_day"),
        F.when(F.weekday(target) >= 5, "weekend").otherwise("weekday").alias("kind_of_day"),
        F.concat(F.lit("Q"), F.quarter("origin_ts")).alias("quarter"),
        "y",
        F.abs(F.col("y_hat") - F.col("y")).alias("e"),
    )
    dims = ["time_of_day", "kind_of_day", "quarter"]
    sets = [[F.col("model")], *[[F.col("model"), F.col(d)] for d in dims]]
    rows = rows.groupingSets(sets, "model", *dims).agg(F.grouping_id().alias("g"), F.count("*").alias("n"), F.avg("e").alias("mae"), F.avg("y").alias("mean_y"))
    name = F.when(F.col("g") == 7, "overall").when(F.col("g") == 3, dims[0]).when(F.col("g") == 5, dims[1]).otherwise(dims[2])
    part = F.coalesce(*dims, F.lit("all"))
    return rows.select("model", name.alias("dimension"), part.alias("slice"), "n", "mae", "mean_y", F.try_divide("mae", "mean_y").alias("nmae"))


def granularity_bridge(pred: DataFrame) -> DataFrame:
    """Daily scores of the origins at 23:00, whose horizons are the next calendar day, on the days that all models have."""
    days = pred.where(F.hour("origin_ts") == 23).groupBy("series_id", "model", "origin_ts").agg(F.avg("y").alias("y"), F.avg("y_hat").alias("y_hat"))
    n = F.count("*").over(Window.partitionBy("series_id", "origin_ts"))
    most = F.max("n_models").over(Window.partitionBy("series_id"))
    days = days.withColumn("n_models", n).withColumn("most", most).where("n_models = most")
    return metrics_pooled(days).select("model", F.col("n").alias("daily_n_days"), F.col("mae").alias("daily_mae"), F.col("r2").alias("daily_r2"))


def target_variance(pred: DataFrame, period: Column | None = None) -> DataFrame:
    """Variance of the targets of each split, and its ratio to that of val; with period, of each split and period."""
    keys = ["split", *([] if period is None else ["period"])]
    rows = pred if period is None else pred.withColumn("period", period)
    rows = rows.groupBy(*keys).agg(F.var_pop("y").alias("variance"), F.count("*").alias("n"))
    val = pred.where("split = 'val'").agg(F.var_pop("y").alias("base"))  # one row
    return rows.crossJoin(F.broadcast(val)).select(*keys, "n", "variance", F.try_divide("variance", "base").alias("ratio_to_val"))


def coverage_report(evals: DataFrame, pred: DataFrame) -> DataFrame:
    """Eval origins, those predicted and skipped, blocks and skipped blocks, per series and segment. evals carries block."""
    have = pred.select("series_id", "origin_ts").distinct().withColumn("have", F.lit(1))
    rows = evals.join(have, ["series_id", "origin_ts"], "left").groupBy("series_id", "segment_id", "block").agg(F.count("*").alias("n"), F.count("have").alias("c"))
    return rows.groupBy("series_id", "segment_id").agg(
        F.sum("n").alias("origins"), F.sum("c").alias("covered"), F.sum(F.col("n") - F.col("c")).alias("skipped"), F.count("*").alias("blocks"),
        F.count_if(F.col("c") == 0).alias("skipped_blocks"),
    )


def cv_summary(folds: DataFrame) -> DataFrame:
    return folds.groupBy("model").agg(F.count("*").alias("folds"), F.avg("mae").alias("mean_mae"), F.stddev_pop("mae").alias("std_mae"))


def rank_models(metrics: DataFrame, scope: str) -> DataFrame:
    return metrics.withColumn("rank", F.rank().over(Window.partitionBy(scope).orderBy(F.round("mae", 9))).cast("long"))


def rank_flips(a: DataFrame, b: DataFrame) -> DataFrame:
    """Models with their ranks in two rankings and whether they differ."""
    both = a.select("model", F.col("rank").alias("rank_a")).join(b.select("model", F.col("rank").alias("rank_b")), "model")
    return both.withColumn("flip", F.col("rank_a") != F.col("rank_b"))


def delta_vs(metrics: DataFrame, baseline: str) -> DataFrame:
    base = metrics.where(F.col("model") == baseline).select(F.col("mae").alias("base"))
    return metrics.crossJoin(F.broadcast(base.limit(1))).select("model", "mae", (F.col("mae") - F.col("base")).alias("delta_mae"))


def reconcile(a: DataFrame, b: DataFrame, keys: list[str], cols: list[str], tol: float = 1e-6) -> DataFrame:
    """(keys, metric, a, b, ok): two tables of metrics from independent paths, a full outer join on the keys."""
    long = lambda df, side: df.selectExpr(*keys, f"stack({len(cols)}, {', '.join(f'{chr(39)}{c}{chr(39)}, cast({c} as double)' for c in cols)}) as (metric, {side})")
    both = long(a, "a").join(long(b, "b"), [*keys, "metric"], "full_outer")
    near = F.abs(F.col("a") - F.col("b")) / F.greatest(F.abs("a"), F.lit(1e-12)) < tol
    return both.withColumn("ok", F.coalesce(near, F.col("a").isNull() & F.col("b").isNull()))


def leaderboard(metrics: DataFrame, digits: int = 4) -> DataFrame:
    cols = ["mae", "rmse", "smape", "r2"]
    return metrics.select("model", "n", *[F.round(c, digits).alias(c) for c in cols]).orderBy("mae", "model")


def date_range(df: DataFrame, start: datetime, end: datetime, col: str = "ts") -> DataFrame:
    """The rows of start <= col <= end, as bounds that a Parquet scan skips row groups by; an end at midnight has of its day that instant alone."""
    bound = lambda t: F.lit(t.strftime("%Y-%m-%d %H:%M:%S.%f")).cast(df.schema[col].dataType)
    return df.where((F.col(col) >= bound(start)) & (F.col(col) <= bound(end)))


def fit_scaler(train: DataFrame, cols: list[str]) -> DataFrame:
    """One row of means and sample deviations of the training rows."""
    return train.agg(*[F.avg(c).alias(f"{c}_mean") for c in cols], *[F.stddev_samp(c).alias(f"{c}_std") for c in cols])


def apply_scaler(df: DataFrame, stats: DataFrame, cols: list[str]) -> DataFrame:
    own = df.columns
    scaled = [F.try_divide(F.col(c) - F.col(f"{c}_mean"), F.col(f"{c}_std")).alias(c) if c in cols else F.col(c) for c in own]
    return df.crossJoin(F.broadcast(stats)).select(*scaled)


CHECKS = (
    "rows_kept", "minute_keys_unique", "times_match_raw", "gap_classes_filled", "long_gaps_empty", "short_fills_between", "mid_fills_constant", "flags_match", "full_hours_valid",
    "kw_is_mean", "kwh_is_sum", "energy_conserved", "lags_match", "segments_match", "enough_windows",
)


def run_invariants(
    raw: DataFrame, minute: DataFrame, hourly: DataFrame, stats: DataFrame, *, short: int = 119, mid: int = 1440, back: int = 168, ahead: int = 24, least_windows: int = 30_000, tol: float = 0.005
) -> DataFrame:
    """(check, ok, n_bad, n, detail) of 15 invariants of the chain from readings (series_id, ts, v) to segments.

    n_bad of n rows break a check. Everything is worked out anew from the readings and the table before; the roll-up of
    the minutes, and the hours beside it, are written once for all checks of hours. Use demand() to make a job fail on any of them.
    """
    keys = ["series_id", "ts"]
    bad = lambda c: F.count_if(F.coalesce(c, F.lit(True)))  # noqa: E731  what can't be told is bad
    n = F.count("*")

    # Each minute with the reading at or before it, and how far that one's next is.
    ahead_of = neighbour(raw.select("series_id", "ts", F.col("v").alias("_lo")), {"_next": "ts", "_hi": "_lo"})
    ahead_of = ahead_of.select(*keys, F.struct("_lo", "_hi", F.coalesce(minutes_between("ts", "_next") - 1, F.lit(0)).alias("_gap")).alias("_raw"))
    own = minute.select(*keys, "v", "impute_flag").join(ahead_of, keys, "full_outer")
    fresh = running_sum(own, F.col("_raw").isNotNull().cast("int"), "_place")
    held = F.max("_raw").over(Window.partitionBy("series_id", "_place"))  # one reading and what follows up to the next
    m = fresh.select("v", "impute_flag", F.col("_raw").isNotNull().cast("int").alias("is_raw"), held.alias("r"))
    lo, hi, gap = F.col("r._lo"), F.col("r._hi"), F.col("r._gap")
    here = F.col("impute_flag").isNotNull()
    first = F.col("is_raw") == 1
    between = F.col("v").between(F.least(lo, hi) - 1e-6, F.greatest(lo, hi) + 1e-6)
    filled = lambda flag: F.count_if(here & (F.col("impute_flag") == flag))
    due = lambda a, b: F.sum(F.when(first & (gap > a) & (gap <= b), gap).otherwise(0))
    flag = F.when(first, 0).when(gap <= short, 1).when(gap <= mid, 2)
    ms = m.agg(
        F.abs(filled(0) - F.count_if(first)).alias("rows_kept"), bad(first != (here & (F.col("impute_flag") == 0))).alias("times_match_raw"),
        (F.abs(filled(1) - due(0, short)) + F.abs(filled(2) - due(short, mid))).alias("gap_classes_filled"), F.count_if(here & ~first & (gap > mid)).alias("long_gaps_empty"),
        F.count_if((F.col("impute_flag") == 1) & ~F.coalesce(between, F.lit(False))).alias("short_fills_between"),
        F.count_if((F.col("impute_flag") == 2) & ~F.coalesce(F.abs(F.col("v") - lo) <= 1e-6, F.lit(False))).alias("mid_fills_constant"),
        F.count_if(here & ~F.coalesce(F.col("impute_flag") == flag, F.lit(False))).alias("flags_match"), n.alias("m_n"),
    )

    # One roll-up of the minutes serves all checks of hours, and tells of repeated minutes; hours are joined with it once, and written.
    own_hour = minute.groupBy("series_id", trunc("HOUR", "ts").alias("ts"))
    mine = own_hour.agg(F.count("v").alias("_n"), F.avg("v").alias("_kw"), (F.sum("v") / 60).alias("_kwh"), (n - F.count_distinct("ts")).alias("_twice"))
    mine, _ = keep(minute.sparkSession, mine)
    twice = mine.agg(F.coalesce(F.sum("_twice"), F.lit(0)).alias("minute_keys_unique"))
    h, _ = keep(minute.sparkSession, hourly.join(mine, keys, "left").withColumn("_n", F.coalesce("_n", F.lit(0))))
    far = lambda a, b: F.col("kw").isNotNull() & ~F.coalesce(F.abs(F.col(a) - F.col(b)) <= 1e-3, F.lit(False))
    e = F.when(F.col("kwh").isNotNull(), F.col("_kwh"))
    off = F.abs(F.sum(e) - F.sum("kwh")) > tol * F.sum(e)
    hs = h.agg(
        bad((F.col("n_valid_min") != F.col("_n")) | (F.col("kw").isNotNull() != (F.col("_n") == 60))).alias("full_hours_valid"), F.count_if(far("kw", "_kw")).alias("kw_is_mean"),
        F.count_if(far("kwh", "_kwh")).alias("kwh_is_sum"), F.coalesce(off, F.lit(False)).cast("long").alias("energy_conserved"), n.alias("h_n"),
    )

    # Lag 1, lag 24 and the mean of three hours: by place in the series, and by time.
    by_time = h.select("series_id", "ts", "kw")
    placed = neighbour(neighbour(by_time, {"b1": "kw"}, ahead=False, unit="MONTH"), {"b2": "b1"}, ahead=False, unit="MONTH")
    at = lambda k: by_time.select("series_id", plus_hours(F.col("ts"), k).alias("ts"), F.col("kw").alias(f"t{k}"))
    both = placed.join(at(1), keys, "left").join(at(2), keys, "left")
    mean = lambda a, b: (F.col("kw") + F.col(a) + F.col(b)) / 3
    ls = both.agg(F.count_if(~F.col("b1").eqNullSafe(F.col("t1")) | ~F.coalesce(F.abs(mean("b1", "b2") - mean("t1", "t2")) <= 1e-6, mean("b1", "b2").eqNullSafe(mean("t1", "t2")))).alias("lags_match"))

    seen = h.where("kw is not null").select("series_id", "ts").join(stats.select("series_id", "segment_id", F.col("start").alias("_a"), F.col("end").alias("_b")), "series_id")
    seen = seen.where(F.col("ts").between(F.col("_a"), F.col("_b"))).groupBy("series_id", "segment_id").agg(n.alias("_hours"))
    s = stats.join(seen, ["series_id", "segment_id"], "left")
    due_windows = F.greatest(F.lit(0), F.col("_hours") - (back + ahead) + 1)
    ss = s.agg(
        bad((F.col("_hours") != F.col("length_hours")) | (F.col("n_windows") != due_windows)).alias("segments_match"),
        (F.coalesce(F.sum("n_windows"), F.lit(0)) < least_windows).cast("long").alias("enough_windows"), n.alias("s_n"),
    )
    one = reduce(lambda a, b: a.crossJoin(b), [ms, twice, hs, ls, ss])  # rows of one each
    size = {"rows_kept": "m_n", "minute_keys_unique": "m_n", "times_match_raw": "m_n", "gap_classes_filled": "m_n", "long_gaps_empty": "m_n", "short_fills_between": "m_n", "mid_fills_constant": "m_n",
            "flags_match": "m_n", "full_hours_valid": "h_n", "kw_is_mean": "h_n", "kwh_is_sum": "h_n", "energy_conserved": "h_n", "lags_match": "h_n"}
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("check"), F.col(c).cast("long").alias("n_bad"), F.col(size.get(c, "s_n")).alias("n")) for c in CHECKS])).alias("x")
    rows = one.select(pairs).select("x.*")
    return rows.select("check", (F.col("n_bad") == 0).alias("ok"), "n_bad", "n", F.concat(F.col("n_bad").cast("string"), F.lit(" of "), F.col("n").cast("string")).alias("detail"))


def demand(checks: DataFrame) -> DataFrame:
    """checks, if all are ok; else the job fails with the names and details of those that are not."""
    failed = [f"{r.check} ({r.detail})" for r in checks.where("not ok").collect()]  # at most a row for each check
    if failed:
        raise ValueError(f"{len(failed)} checks failed: {', '.join(failed)}")
    return checks
