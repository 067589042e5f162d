"""Profiles of columns, time, gaps and load."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import kwh_per_day_of_kw, kwh_per_day_of_wh, minutes_between, trunc
from ..sources.tables import keep
from .series import neighbour

QUANTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)
HOUR_BINS = (0, 1, 2, 6, 24, 48, 72, 96, 125)


def _long(df: DataFrame, cols: list[str]) -> DataFrame:
    pairs = ", ".join(f"'{c}', cast(`{c}` as double)" for c in cols)
    return df.selectExpr(f"stack({len(cols)}, {pairs}) as (col, value)")


def exact_quantiles(df: DataFrame, keys: list[str], value: str, qs) -> DataFrame:
    """(keys, n_distinct, qs): exact quantiles of each key by linear interpolation, nulls ignored, without a key's rows in one task.

    Values are counted first and dealt out by ranges of key and value; running counts of the ranges tell which hold the
    wanted ranks, and only the values of these are counted through. Keys are few (columns, years).
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    ranged = counts.repartitionByRange(*keys, "_v").withColumn("_bucket", F.spark_partition_id())
    placed, _ = keep(df.sparkSession, ranged)
    w = Window.partitionBy(*keys)
    cells = placed.groupBy(*keys, "_bucket").agg(F.sum("_n").alias("_m"), F.count("*").alias("_d"))  # a row for each key and range
    cells = cells.withColumn("_upto", F.sum("_m").over(w.orderBy("_bucket"))).withColumn("_total", F.sum("_m").over(w)).withColumn("n_distinct", F.sum("_d").over(w))
    spots = F.array(*[F.lit(float(q)) * (F.col("_total") - 1) for q in qs])
    cells = cells.withColumn("_spots", spots)
    ranks = F.array_distinct(F.flatten(F.transform("_spots", lambda r: F.array(F.floor(r), F.ceil(r)))))
    cells = cells.withColumn("_ranks", F.filter(ranks, lambda r: (r >= F.col("_upto") - F.col("_m")) & (r < F.col("_upto"))))
    cells = cells.where(F.size("_ranks") > 0).select(*keys, "_bucket", "n_distinct", "_spots", "_ranks", (F.col("_upto") - F.col("_m")).alias("_before"))
    inside = placed.join(F.broadcast(cells), [*keys, "_bucket"])  # at most two buckets for each quantile and key
    end = F.col("_before") + F.sum("_n").over(Window.partitionBy(*keys, "_bucket").orderBy("_v"))
    found = inside.withColumn("_end", end).withColumn("_ranks", F.filter("_ranks", lambda r: (r >= F.col("_end") - F.col("_n")) & (r < F.col("_end"))))
    found = found.select(*keys, "n_distinct", "_spots", F.explode("_ranks").alias("_rank"), "_v")
    at = found.groupBy(*keys).agg(F.first("n_distinct").alias("n_distinct"), F.first("_spots").alias("_spots"), F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_at"))
    low, high = lambda r: F.element_at("_at", F.floor(r)), lambda r: F.element_at("_at", F.ceil(r))
    return at.select(*keys, "n_distinct", F.transform("_spots", lambda r: low(r) + (high(r) - low(r)) * (r - F.floor(r))).alias("qs"))


def check_mask_agreement(df: DataFrame, measures: list[str]) -> DataFrame:
    """(n_rows, n_disagree, ok): rows in which some but not all measures are missing."""
    first, *rest = measures
    differ = F.lit(False)
    for m in rest:
        differ = differ | (F.col(m).isNull() != F.col(first).isNull())
    n = F.sum(differ.cast("long"))
    return df.agg(F.count("*").alias("n_rows"), F.coalesce(n, F.lit(0)).alias("n_disagree"), (F.coalesce(n, F.lit(0)) == 0).alias("ok"))


def profile_columns(df: DataFrame, cols: list[str], approx: bool = False) -> DataFrame:
    """One row per column: missing, missing_rate, n_distinct, zeros, zero_rate (over all rows), mean, median, max."""
    v = F.col("value")
    n = F.count("*")
    base = [
        (n - F.count(v)).alias("missing"), ((n - F.count(v)) / n).alias("missing_rate"), F.count_if(v == 0).alias("zeros"), (F.count_if(v == 0) / n).alias("zero_rate"),
        F.avg(v).alias("mean"), F.max(v).alias("max"),
    ]
    names = ["col", "missing", "missing_rate", "n_distinct", "zeros", "zero_rate", "mean", "median", "max"]
    long = _long(df, cols)
    if approx:
        return long.groupBy("col").agg(*base, F.approx_count_distinct(v).alias("n_distinct"), F.approx_percentile(v, 0.5).alias("median")).select(*names)
    ordered = exact_quantiles(long, ["col"], "value", [0.5]).select("col", "n_distinct", F.col("qs")[0].alias("median"))
    rows = long.groupBy("col").agg(*base).join(F.broadcast(ordered), "col", "left")  # a row for each column
    return rows.withColumn("n_distinct", F.coalesce("n_distinct", F.lit(0))).select(*names)


def profile_quantiles(df: DataFrame, cols: list[str], qs=QUANTILES, approx: bool = False) -> DataFrame:
    long = _long(df, cols)
    if approx:
        rows = long.groupBy("col").agg(F.approx_percentile("value", [float(q) for q in qs]).alias("qs"))
    else:
        rows = exact_quantiles(long, ["col"], "value", qs)
    return rows.select("col", F.posexplode("qs").alias("i", "value")).select("col", F.element_at(F.array(*map(F.lit, qs)), F.col("i") + 1).alias("q"), "value")


def top_values(df: DataFrame, cols: list[str], n: int = 3) -> DataFrame:
    rows = _long(df, cols).where("value is not null").groupBy("col", "value").count()
    rank = F.row_number().over(Window.partitionBy("col").orderBy(F.desc("count"), "value"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= n).select("col", "rank", "value", F.col("count").alias("n"))


def profile_time(df: DataFrame, seq: str, ts: str = "ts") -> DataFrame:
    """First and last minute, repeated timestamps, order by the (whole-numbered) sequence column, expected, actual and absent minutes for each series."""
    rows = neighbour(df.select("series_id", ts, seq), {"_back": ts}, ahead=False, order=seq, unit=1 << 16)
    rows = rows.select("series_id", ts, (F.col(ts) <= F.col("_back")).alias("bad"))
    out = rows.groupBy("series_id").agg(
        F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count("*").alias("n_rows"), F.count_distinct(ts).alias("n_ts"), F.expr("count_if(bad)").alias("n_bad")
    )
    span = minutes_between("first_ts", "last_ts") + 1
    return out.select(
        "series_id", "first_ts", "last_ts", "n_rows", (F.col("n_rows") - F.col("n_ts")).alias("n_dup"), (F.col("n_bad") == 0).alias("increasing"),
        span.alias("expected"), (span - F.col("n_ts")).alias("absent"),
    )


def gap_buckets(runs: DataFrame) -> DataFrame:
    """Gaps of [1, 2), [2, 24) and [24, ..) hours per series: count and share of all missing minutes; shorter ones are in no bucket."""
    h = F.col("length") / 60
    bucket = F.when(h >= 24, "24h+").when(h >= 2, "2-24h").when(h >= 1, "1-2h")
    total = runs.groupBy("series_id").agg(F.sum("length").alias("total"))
    rows = runs.withColumn("bucket", bucket).where("bucket is not null").groupBy("series_id", "bucket")
    rows = rows.agg(F.count("*").alias("n"), F.sum("length").alias("minutes"))
    return rows.join(total, "series_id").select("series_id", "bucket", "n", (F.col("minutes") / F.col("total")).alias("share"))


def gap_summary(runs: DataFrame, spans: DataFrame | None = None) -> DataFrame:
    """Longest, shortest and number of gaps, those of more than 24 hours, and, with spans (series_id, span), the missing share of all minutes."""
    over = F.col("length") > 1440
    rows = runs.groupBy("series_id").agg(
        F.count("*").alias("n"), F.max("length").alias("longest"), F.min("length").alias("shortest"), F.count_if(over).alias("n_over_day"),
        (F.sum(F.when(over, F.col("length")).otherwise(0)) / F.sum("length")).alias("share_over_day"), F.sum("length").alias("total"),
    )
    if spans is not None:
        rows = rows.join(spans, "series_id").withColumn("share_of_span", F.try_divide("total", "span")).drop("span")
    return rows.drop("total")


def long_gaps(runs: DataFrame, least: int = 1440) -> DataFrame:
    """The gaps of more than 24 hours, longest first."""
    rows = runs.where(F.col("length") > least).select("series_id", "ts", (F.col("length") / 60).alias("hours"))
    return rows.orderBy(F.desc("hours"), "series_id", "ts")


def gap_histogram(runs: DataFrame, bins=HOUR_BINS) -> DataFrame:
    """Gaps by right-closed bins of hours; what lies outside is dropped, empty bins are left out."""
    h = F.col("length") / 60
    name = F.lit(None).cast("string")
    for lo, hi in zip(bins[:-1], bins[1:]):
        name = F.when((h > lo) & (h <= hi), f"({lo},{hi}]").otherwise(name)
    return runs.withColumn("bin", name).where("bin is not null").groupBy("bin").agg(F.count("*").alias("n"))


def hour_profile(hourly: DataFrame) -> DataFrame:
    weekend = F.weekday("ts") >= 5
    rows = hourly.groupBy(F.hour("ts").cast("long").alias("hour"))
    return rows.agg(F.avg("kw").alias("all_days"), F.avg(F.when(~weekend, F.col("kw"))).alias("weekday"), F.avg(F.when(weekend, F.col("kw"))).alias("weekend"))


def year_profile(df: DataFrame, value: str, ts: str = "ts") -> DataFrame:
    rows = df.select(F.year(ts).cast("long").alias("year"), F.col(value).cast("double").alias("value"))
    median = exact_quantiles(rows, ["year"], "value", [0.5]).select("year", F.col("qs")[0].alias("median"))
    return rows.groupBy("year").agg(F.avg("value").alias("mean")).join(median, "year", "left")


def power_factor_stats(pf: DataFrame, qs=(0.5, 0.001, 0.01, 0.99), all_rows: DataFrame | None = None) -> DataFrame:
    """One row: quantiles p_<q in percent>, the share below 0.9, n, and with all_rows the share of them that pf is."""
    one = pf.select(F.lit(1).alias("one"), "pf")
    q = exact_quantiles(one, ["one"], "pf", qs)
    out = one.groupBy("one").agg(F.avg((F.col("pf") < 0.9).cast("double")).alias("share_low"), F.count("*").alias("n")).join(F.broadcast(q), "one")
    names = [f"p{q * 100:g}".replace(".", "_") for q in qs]
    rows = out.select(*[F.col("qs")[i].alias(n) for i, n in enumerate(names)], "share_low", "n")
    if all_rows is not None:
        total = all_rows.agg(F.count("*").alias("_total"))
        rows = rows.crossJoin(F.broadcast(total)).withColumn("share_of_all", F.try_divide("n", "_total")).drop("_total")  # one row by one row
    return rows


def power_factor_hist(pf: DataFrame, lo: float = 0.85, hi: float = 1.0, bins: int = 80) -> DataFrame:
    """Counts in equal bins, the last one closed; values outside are dropped."""
    b = F.width_bucket(F.col("pf"), F.lit(lo), F.lit(hi), F.lit(bins))
    b = F.when(F.col("pf") == hi, bins).otherwise(b)
    return pf.withColumn("bin", b.cast("long")).where(f"bin between 1 and {bins}").groupBy("bin").agg(F.count("*").alias("n"))


def submeter_share(minute: DataFrame, load_kw: float | DataFrame, cols: list[str]) -> DataFrame:
    """kWh a day of each sub-meter (Wh a minute), to three places, and its share of the total load's (a one-row table mean_kw)."""
    rows = _long(minute, cols).groupBy("col").agg(F.round(kwh_per_day_of_wh(F.avg("value")), 3).alias("kwh_day"))
    total = load_kw.select(kwh_per_day_of_kw(F.col("mean_kw")).alias("total"))
    return rows.crossJoin(F.broadcast(total)).select("col", "kwh_day", F.try_divide("kwh_day", "total").alias("share"))


def energy_conservation(minute: DataFrame, hourly: DataFrame, tol: float = 0.005) -> DataFrame:
    """Energy of the minutes in valid hours against the energy of those hours, per series."""
    hours = hourly.where("kwh is not null").select("series_id", F.col("ts").alias("hour"), "kwh")
    mins = minute.groupBy("series_id", trunc("HOUR", "ts").alias("hour")).agg((F.sum("v") / 60).alias("minute_kwh"))
    rows = hours.join(mins, ["series_id", "hour"]).groupBy("series_id").agg(F.sum("minute_kwh").alias("minute_kwh"), F.sum("kwh").alias("hour_kwh"))
    off = F.try_divide(F.abs(F.col("minute_kwh") - F.col("hour_kwh")), F.col("minute_kwh"))
    return rows.withColumn("deviation", off).withColumn("ok", F.col("deviation") <= tol)


def worst_hours(hourly: DataFrame, minute: DataFrame, n: int = 5) -> DataFrame:
    mins = minute.groupBy("series_id", trunc("HOUR", "ts").alias("ts")).agg((F.sum("v") / 60).alias("minute_kwh"))
    rows = hourly.where("kwh is not null").join(mins, ["series_id", "ts"]).withColumn("off", F.round(F.abs(F.col("kwh") - F.col("minute_kwh")), 6))
    return rows.select("series_id", "ts", "off").orderBy(F.desc("off"), "series_id", "ts").limit(n)
