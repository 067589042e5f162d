"""Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def trunc(unit: str, ts) -> Column:
    """date_trunc that stays a wall-clock timestamp."""
    return F.date_trunc(unit, ts).cast("timestamp_ntz")


def floor_day(ts) -> Column:
    return trunc("DAY", ts)


def hours_between(a, b) -> Column:
    return F.timestamp_diff("HOUR", a, b)


def minutes_between(a, b) -> Column:
    return F.timestamp_diff("MINUTE", a, b)


def plus_hours(ts: Column, n: Column | int) -> Column:
    n = n if isinstance(n, Column) else F.lit(n)
    return ts + F.make_dt_interval(F.lit(0), n.cast("int"), F.lit(0), F.lit(0))


def plus_minutes(ts: Column, n: Column | int) -> Column:
    n = n if isinstance(n, Column) else F.lit(n)
    return ts + F.make_dt_interval(F.lit(0), F.lit(0), n.cast("int"), F.lit(0))


def block_no(ts, anchor, hours: int) -> Column:
    return F.floor(hours_between(anchor, ts) / hours)


def calendar_features(df: DataFrame, ts: str = "ts") -> DataFrame:
    """hour 0-23, dow 0 = Monday, is_weekend."""
    dow = F.weekday(ts)
    return df.withColumns({"hour": F.hour(ts).cast("long"), "dow": dow.cast("long"), "is_weekend": (dow >= 5).cast("long")})


def power_factor(df: DataFrame, p: str, q: str, min_p: float = 0.01) -> DataFrame:
    """pf = p / sqrt(p^2 + q^2) of rows with p above min_p; rows where it is not finite go."""
    pf = F.try_divide(F.col(p), F.sqrt(F.col(p) * F.col(p) + F.col(q) * F.col(q)))
    return df.where(F.col(p) > min_p).withColumn("pf", pf).where(F.col("pf").isNotNull() & ~F.isnan("pf") & (F.abs("pf") < float("inf")))


def kwh_of_minutes(kw_sum) -> Column:
    return kw_sum / 60


def kwh_per_day_of_wh(mean_wh_per_minute) -> Column:
    return mean_wh_per_minute * 60 * 24 / 1000


def kwh_per_day_of_kw(mean_kw) -> Column:
    return mean_kw * 24


def smape_term(y, p) -> Column:
    """2 |p - y| / (|y| + |p|), NULL where the denominator is at most 1e-8."""
    size = F.abs(y) + F.abs(p)
    return F.when(size > 1e-8, 2 * F.abs(p - y) / size)


def patchify(x: Column, length: int, patch: int, stride: int) -> Column:
    """Overlapping patches of an array whose last value is first repeated ``stride`` times."""
    n = (length - patch) // stride + 2
    long = F.concat(x, F.array_repeat(F.element_at(x, -1), stride))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.slice(long, i * stride + 1, F.lit(patch)))


def instance_norm(x: Column) -> Column:
    """struct(mu, sigma, z) of an array: population deviation, z of 0 where it is 0."""
    once = lambda value, use: F.transform(F.array(value), use)[0]  # noqa: E731  a value used many times is worked out once
    mean = lambda v: F.aggregate(v, F.lit(0.0), lambda s, y: s + y) / F.size(x)
    z = lambda mu, sigma: F.transform(x, lambda v: F.when(sigma > 0, (v - mu) / sigma).otherwise(F.lit(0.0)))
    with_mean = lambda mu: once(
        F.sqrt(mean(F.transform(x, lambda v: (v - mu) * (v - mu)))), lambda sigma: F.struct(mu.alias("mu"), sigma.alias("sigma"), z(mu, sigma).alias("z"))
    )
    return once(mean(x), with_mean)


def instance_denorm(norm: Column) -> Column:
    return F.transform(norm["z"], lambda z: z * norm["sigma"] + norm["mu"])


def pack_horizons(df: DataFrame, keys: list[str], horizon: str = "horizon", value: str = "y_hat") -> DataFrame:
    """One array for each key, in horizon order whatever the order of the rows."""
    rows = F.array_sort(F.collect_list(F.struct(horizon, value)))
    return df.groupBy(*keys).agg(F.transform(rows, lambda r: r[value]).alias(value))


def unpack_horizons(df: DataFrame, keys: list[str], value: str = "y_hat") -> DataFrame:
    return df.select(*keys, F.posexplode(value).alias("horizon", value)).withColumn("horizon", F.col("horizon") + 1)
