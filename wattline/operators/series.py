"""Gaps, filling, roll-ups, segments, windows: from minutes to model inputs. All tables carry series_id and ts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import minutes_between, plus_hours, plus_minutes, trunc
from ..sources.tables import keep

LAGS = (1, 2, 3, 6, 12, 24, 48, 72, 96, 120, 144, 168)


def by_series(*extra: str):
    return Window.partitionBy("series_id", *extra).orderBy("ts")


# --- windows over a whole series, in chunks: no task holds more than a chunk's rows, or one row for each chunk


def _chunked(df: DataFrame, order: str, unit: str | int, keys: tuple[str, ...]) -> tuple[DataFrame, list[str]]:
    chunk = F.floor(F.col(order) / unit) if isinstance(unit, int) else trunc(unit, order)
    return df.withColumn("_chunk", chunk), [*keys, "_chunk"]


def neighbour(df: DataFrame, cols: dict[str, str], ahead: bool = True, order: str = "ts", unit: str | int = "DAY", keys: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """df with the values {new name: column} of the next row (or the one before) of its keys in the order of a column.

    Lead or lag inside chunks of that column (a unit of time, or so many numbers); a chunk's last row looks at the first
    one of the next chunk, which is found on one row for each chunk. Ties of the order fall as they come.
    """
    rows, inner = _chunked(df, order, unit, keys)
    step, edge = (F.lead, F.min) if ahead else (F.lag, F.max)
    value = F.struct(*[F.col(c).alias(n) for n, c in cols.items()])
    own = rows.withColumn("_near", step(value).over(Window.partitionBy(*inner).orderBy(order)))
    edges = rows.groupBy(*inner).agg(edge(F.struct(F.col(order).alias("_o"), value.alias("_v")))["_v"].alias("_edge"))
    edges = edges.select(*inner, step("_edge").over(Window.partitionBy(*keys).orderBy("_chunk")).alias("_far"))
    both = own.join(edges, inner)
    return both.select(*df.columns, *[F.coalesce(F.col("_near")[n], F.when(F.col("_near").isNull(), F.col("_far")[n])).alias(n) for n in cols])


def running_sum(df: DataFrame, value: Column, name: str, order: str = "ts", unit: str | int = "DAY", keys: tuple[str, ...] = ("series_id",), then: str | None = None) -> DataFrame:
    """df with the sum of value up to each row: sums inside chunks, and before them the sums of all earlier chunks. ``then`` orders ties, with a minus downwards."""
    rows, inner = _chunked(df.withColumn("_value", value), order, unit, keys)
    upto = Window.unboundedPreceding, Window.currentRow
    ordering = [order, *([F.col(then[1:]).desc() if then.startswith("-") else then] if then else [])]
    own = rows.withColumn("_own", F.sum("_value").over(Window.partitionBy(*inner).orderBy(*ordering).rowsBetween(*upto)))
    sums = rows.groupBy(*inner).agg(F.sum("_value").alias("_all"))
    before = F.coalesce(F.sum("_all").over(Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return own.join(sums.select(*inner, before.alias("_before")), inner).select(*df.columns, (F.col("_own") + F.col("_before")).alias(name))


def dense_spine(df: DataFrame, unit: str = "HOUR", keys: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """(keys, ts): every step from the first to the last one of each key."""
    step = F.expr(f"INTERVAL 1 {unit}")
    ends = df.groupBy(*keys).agg(F.min(trunc(unit, "ts")).alias("lo"), F.max(trunc(unit, "ts")).alias("hi"))
    return ends.select(*keys, F.explode(F.sequence("lo", "hi", step)).alias("ts"))


def with_spine(df: DataFrame, unit: str = "HOUR") -> DataFrame:
    return dense_spine(df, unit).join(df, ["series_id", "ts"], "left")


def null_runs(df: DataFrame, col: str = "v") -> DataFrame:
    """Maximal runs of rows without a value, also at either end: (series_id, start, end, length)."""
    flagged = df.select("series_id", "ts", F.col(col).isNotNull().cast("int").alias("has"))
    placed = running_sum(flagged, F.col("has"), "run")  # rows without a value after the same number of values are one run
    runs = placed.where("has = 0").groupBy("series_id", "run").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("length"))
    return runs.drop("run")


def absent_runs(df: DataFrame) -> DataFrame:
    """Missing minutes between neighbouring rows more than a minute apart."""
    ahead = neighbour(df.select("series_id", "ts"), {"next_ts": "ts"})
    return ahead.withColumn("missing", minutes_between("ts", "next_ts") - 1).where("missing > 0")


def gaps(valid: DataFrame) -> DataFrame:
    """Gaps between valid rows with the values beside them; never any at the edges, where a side is unknown."""
    ahead = neighbour(valid.select("series_id", "ts", F.col("v").alias("lo")), {"next_ts": "ts", "hi": "lo"})
    return ahead.withColumn("length", minutes_between("ts", "next_ts") - 1).where("length > 0")


def gap_class(length: Column, short: int = 119, mid: int = 1440) -> Column:
    return F.when(length <= short, "short").when(length <= mid, "mid").otherwise("long")


def classify_gaps(runs: DataFrame, keys=("series_id",)) -> DataFrame:
    rows = runs.withColumn("class", gap_class(F.col("length")))
    return rows.groupBy(*keys, "class").agg(F.count("*").alias("n_gaps"), F.sum("length").cast("long").alias("minutes"))


def interpolate_short(valid: DataFrame, most: int = 119) -> DataFrame:
    """The rows that fill gaps of at most ``most`` minutes on the straight line between their sides; flag 1."""
    g = gaps(valid).where(F.col("length") <= most)
    g = g.select("*", F.explode(F.sequence(F.lit(1), F.col("length"))).alias("i"))
    line = F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("i") / (F.col("length") + 1)
    return g.select("series_id", plus_minutes(F.col("ts"), F.col("i")).alias("ts"), line.alias("v"), F.lit(1).alias("impute_flag"))


def ffill_mid(valid: DataFrame, least: int = 119, most: int = 1440) -> DataFrame:
    """The rows that fill gaps above ``least`` and up to ``most`` minutes with the value before them; flag 2."""
    g = gaps(valid).where((F.col("length") > least) & (F.col("length") <= most))
    g = g.select("*", F.explode(F.sequence(F.lit(1), F.col("length"))).alias("i"))
    return g.select("series_id", plus_minutes(F.col("ts"), F.col("i")).alias("ts"), F.col("lo").alias("v"), F.lit(2).alias("impute_flag"))


def impute(valid: DataFrame, short: int = 119, mid: int = 1440, cols: tuple[str, ...] = ("v",)) -> DataFrame:
    """Valid rows with flag 0, short gaps on a line (1), mid gaps carried forward (2), from one pass over neighbours; long gaps stay out.

    All of ``cols`` are filled by the same gaps: readings miss all measures of a row or none.
    """
    ahead = neighbour(valid.select("series_id", "ts", *cols), {"next_ts": "ts"} | {f"_next_{c}": c for c in cols})
    n = F.coalesce(minutes_between("ts", "next_ts") - 1, F.lit(0))
    rows = ahead.withColumn("length", F.when(n <= mid, n).otherwise(0))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("length").cast("int"))).alias("i"))
    held = (F.col("i") == 0) | (F.col("length") > short)
    line = lambda c: F.col(c) + (F.col(f"_next_{c}") - F.col(c)) * F.col("i") / (F.col("length") + 1)
    return rows.select(
        "series_id",
        plus_minutes(F.col("ts"), F.col("i")).alias("ts"),
        *[F.when(held, F.col(c)).otherwise(line(c)).alias(c) for c in cols],
        F.when(F.col("i") == 0, 0).when(F.col("length") <= short, 1).otherwise(2).alias("impute_flag"),
    )


def resample_hourly(minute: DataFrame, points: int = 60) -> DataFrame:
    """kw, kwh, impute_flag of complete hours (NULL for others) and n_valid_min, for every hour from first to last."""
    rows = minute.withColumn("ts", trunc("HOUR", "ts")).groupBy("series_id", "ts")
    rows = rows.agg(F.avg("v").alias("kw"), (F.sum("v") / 60).alias("kwh"), F.max("impute_flag").alias("impute_flag"), F.count("v").alias("n_valid_min"))
    full = F.col("n_valid_min") == points
    rows, _ = keep(minute.sparkSession, rows)  # a sixtieth of the minutes; the spine reads them again
    return with_spine(rows).select(
        "series_id", "ts", *[F.when(full, F.col(c)).alias(c) for c in ("kw", "kwh", "impute_flag")], F.coalesce("n_valid_min", F.lit(0)).alias("n_valid_min")
    )


def resample_daily(hourly: DataFrame) -> DataFrame:
    """Mean of the valid hours of each day from first to last."""
    rows = hourly.groupBy("series_id", trunc("DAY", "ts").alias("ts")).agg(F.avg("kw").alias("kw"))
    return with_spine(rows, "DAY")


def assign_segments(hourly: DataFrame, min_len: int | None = None, unit: str = "MONTH") -> DataFrame:
    """The valid hours with segment_id 1..n: maximal runs without a missing hour; runs below min_len go.

    Runs are numbered inside chunks of time; one row for each chunk tells whether its first hour goes on with the chunk
    before, and how many runs there are before it.
    """
    apart = lambda a, b: F.timestamp_diff("HOUR", a, b) > 1
    rows, inner = _chunked(hourly.where("kw is not null"), "ts", unit, ("series_id",))
    w = Window.partitionBy(*inner).orderBy("ts")
    before = F.lag("ts").over(w)
    own = rows.withColumn("_new", F.when(before.isNotNull() & apart(before, F.col("ts")), 1).otherwise(0)).withColumn("_own", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ends = own.groupBy(*inner).agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"), F.sum("_new").alias("n"))
    along = Window.partitionBy("series_id").orderBy("_chunk")
    last = F.lag("hi").over(along)
    ends = ends.withColumn("_new", F.when(last.isNull() | apart(last, F.col("lo")), 1).otherwise(0))
    upto = F.sum(F.col("_new") + F.col("n")).over(along.rowsBetween(Window.unboundedPreceding, 0))
    ends = ends.select(*inner, (upto - F.col("n")).alias("_before"))
    rows = own.join(ends, inner).select(*hourly.columns, (F.col("_own") + F.col("_before")).alias("segment_id"))
    if min_len:
        long = rows.groupBy("series_id", "segment_id").agg(F.count("*").alias("size")).where(F.col("size") >= min_len).select("series_id", "segment_id")
        rows = rows.join(long, ["series_id", "segment_id"], "left_semi")
    return rows


def segment_stats(segmented: DataFrame, back: int = 168, ahead: int = 24) -> DataFrame:
    rows = segmented.groupBy("series_id", "segment_id").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("length_hours"))
    rows = rows.withColumn("n_windows", F.greatest(F.lit(0), F.col("length_hours") - (back + ahead) + 1))
    total = F.sum("n_windows").over(Window.partitionBy("series_id"))
    return rows.withColumn("window_share", F.try_divide(F.col("n_windows"), total))


def windows(segmented: DataFrame, back: int = 168, ahead: int = 24, unit: str = "MONTH") -> DataFrame:
    """A row for each origin: (series_id, segment_id, origin_ts, hist: the last ``back`` hours, y: the next ``ahead``).

    One window specification for the history and the targets, so one sort; chunks of time with a halo, so that a long
    segment is many tasks.
    """
    w = by_series("segment_id", "chunk")
    rows = with_halo(segmented, unit, back, ahead).select(
        "own",
        "series_id",
        "segment_id",
        F.col("ts").alias("origin_ts"),
        F.collect_list("kw").over(w.rowsBetween(1 - back, 0)).alias("hist"),
        F.collect_list("kw").over(w.rowsBetween(1, ahead)).alias("y"),
    )
    return rows.where(F.col("own") & (F.size("hist") == back) & (F.size("y") == ahead)).drop("own")


def window_origins(segmented: DataFrame, back: int = 168, ahead: int = 24) -> DataFrame:
    """Origins with a full window on either side. A segment has every hour, so its ends alone tell: nothing is sorted."""
    ends = segmented.groupBy("series_id", "segment_id").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    rows = segmented.join(ends, ["series_id", "segment_id"])
    rows = rows.where((F.col("ts") >= plus_hours(F.col("lo"), back - 1)) & (F.col("ts") <= plus_hours(F.col("hi"), -ahead)))
    return rows.select("series_id", "segment_id", F.col("ts").alias("origin_ts"))


def lag_features(segmented: DataFrame, lags=LAGS, unit: str = "MONTH") -> DataFrame:
    """lag_kh = the value k - 1 hours before the origin: the first lag is the origin's own hour."""
    w = by_series("segment_id", "chunk")
    rows = with_halo(segmented, unit, max(lags), 0)
    rows = rows.select("series_id", "segment_id", F.col("ts").alias("origin_ts"), "own", *[F.lag("kw", k - 1).over(w).alias(f"lag_{k}h") for k in lags])
    return rows.where("own").drop("own")


def rolling_features(segmented: DataFrame, unit: str = "MONTH") -> DataFrame:
    """Mean and sample deviation of 24 hours and mean of 168, ending at the origin; NULL without a full window."""
    w = by_series("segment_id", "chunk")
    over = lambda f, n: F.when(F.count("kw").over(w.rowsBetween(1 - n, 0)) == n, f("kw").over(w.rowsBetween(1 - n, 0)))
    rows = with_halo(segmented, unit, 168, 0).select(
        "own",
        "series_id",
        "segment_id",
        F.col("ts").alias("origin_ts"),
        over(F.avg, 24).alias("roll_mean_24h"),
        over(F.stddev_samp, 24).alias("roll_std_24h"),
        over(F.avg, 168).alias("roll_mean_168h"),
    )
    return rows.where("own").drop("own")


def rolling_daily(daily: DataFrame, days: int = 30, least: int = 15) -> DataFrame:
    """Mean of the last ``days`` daily means with at least ``least`` of them; every day of a series must be there (resample_daily). Years with a halo, so that a long series is many tasks."""
    w = by_series("chunk").rowsBetween(1 - days, 0)
    rows = with_halo(daily, "YEAR", 24 * (days - 1), 0).withColumn("roll", F.when(F.count("kw").over(w) >= least, F.avg("kw").over(w)))
    return rows.where("own").drop("own", "chunk")


def build_targets(segmented: DataFrame, back: int = 168, ahead: int = 24, unit: str = "MONTH") -> DataFrame:
    """(series_id, segment_id, origin_ts, y): the next ``ahead`` hours of each origin, without its history."""
    return _origins(segmented, back, ahead, unit, {}).select("series_id", "segment_id", "origin_ts", "y")


def _origins(segmented: DataFrame, back: int, ahead: int, unit: str, more: dict[str, Column]) -> DataFrame:
    """Origins with y and the columns ``more`` over the window of a segment's chunk."""
    w = by_series("segment_id", "chunk")
    rows = with_halo(segmented, unit, back, ahead).select(
        "own", "series_id", "segment_id", F.col("ts").alias("origin_ts"), F.count("kw").over(w.rowsBetween(1 - back, 0)).alias("_n"), F.collect_list("kw").over(w.rowsBetween(1, ahead)).alias("y"),
        *[c.alias(n) for n, c in more.items()],
    )
    return rows.where(F.col("own") & (F.col("_n") == back) & (F.size("y") == ahead)).drop("own", "_n")


def feature_table(segmented: DataFrame, back: int = 168, ahead: int = 24, unit: str = "MONTH") -> DataFrame:
    """Calendar, lag and rolling features and targets of each origin, all from one window."""
    from ..functions.columns import calendar_features

    w = by_series("segment_id", "chunk")
    over = lambda f, n: f("kw").over(w.rowsBetween(1 - n, 0))
    more = {f"lag_{k}h": F.lag("kw", k - 1).over(w) for k in LAGS} | {"roll_mean_24h": over(F.avg, 24), "roll_mean_168h": over(F.avg, 168), "roll_std_24h": over(F.stddev_samp, 24)}
    return calendar_features(_origins(segmented, back, ahead, unit, more), "origin_ts")


def cap_per_group(df: DataFrame, keys: list[str], order: str, n: int, side: str = "first") -> DataFrame:
    ordering = F.col(order).asc() if side == "first" else F.col(order).desc()
    rows = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(ordering)))
    return rows.where(F.col("_rn") <= n).drop("_rn")


def with_halo(df: DataFrame, unit: str = "MONTH", before: int = 168, after: int = 24) -> DataFrame:
    """df with (chunk, own): each row in its own chunk of time, and in the neighbours that look back or ahead at it.

    A window over (series_id, chunk) then sees ``before`` hours before and ``after`` hours after every own row, so
    that one very long series is many tasks. Keep the rows with own after the window.
    """
    home = trunc(unit, "ts")
    reach = F.array_distinct(F.array(home, trunc(unit, plus_hours(F.col("ts"), before)), trunc(unit, plus_hours(F.col("ts"), -after))))
    rows = df.select("*", F.explode(reach).alias("chunk"))
    return rows.withColumn("own", F.col("chunk") == trunc(unit, "ts"))
