"""Approximate profiles from small stored sketches of each day, and exact top values by way of a sketch.

A day's values become a quantile sketch (KLL) and a distinct sketch (HLL), a few kilobytes each. They are
written once, by day; any range of days is then a merge of its sketches, without another look at the values,
and a new day is one scan of that day.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .profile import QUANTILES, _long

#: The sizes of a quantile sketch (its ranks err by about 1.7 / K) and of a distinct sketch (2 ** LG cells; 1.04 / 2 ** (LG / 2)).
K, LG = 400, 12


def day_sketches(rows: DataFrame, value: str = "v", keys: tuple[str, ...] = ("series_id",), ts: str = "ts") -> DataFrame:
    """(keys, day, n, low, high, quantiles, distinct) of each key and day with any value; nulls are left out."""
    v = F.col(value).cast("double")
    some = rows.where(v.isNotNull()).groupBy(*keys, F.to_date(ts).alias("day"))
    return some.agg(F.count("*").alias("n"), F.min(v).alias("low"), F.max(v).alias("high"), F.kll_sketch_agg_double(v, F.lit(K)).alias("quantiles"), F.hll_sketch_agg(F.xxhash64(v), F.lit(LG)).alias("distinct"))


def save_sketches(sketches: DataFrame, path: str) -> None:
    """Stores sketches by day; days that are there already are replaced, all others stay."""
    sketches.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def load_sketches(spark: SparkSession, path: str, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    """The sketches of start <= day <= end; other days' folders are not read."""
    rows = spark.read.parquet(path)
    for t, keep in ((start, lambda d: F.col("day") >= d), (end, lambda d: F.col("day") <= d)):
        if t is not None:
            rows = rows.where(keep(F.lit(t.date())))
    return rows


def merged(sketches: DataFrame, keys: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """One row for each key from its days' sketches."""
    return sketches.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.kll_merge_agg_double("quantiles", F.lit(K)).alias("quantiles"), F.hll_union_agg("distinct").alias("distinct")
    )


def sketched_quantiles(sketches: DataFrame, qs=QUANTILES, keys: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """(keys, q, value, n) from merged sketches: a value of the data whose rank is about q; it is not interpolated."""
    spots = F.array(*[F.lit(float(q)) for q in qs])
    rows = sketches.select(*keys, "n", F.kll_sketch_get_quantile_double("quantiles", spots).alias("found"))
    each = rows.select(*keys, "n", F.explode(F.arrays_zip(spots.alias("q"), F.col("found"))).alias("x"))
    return each.select(*keys, F.col("x.q").alias("q"), F.col("x.found").alias("value"), "n")


def sketched_distinct(sketches: DataFrame, keys: tuple[str, ...] = ("series_id",)) -> DataFrame:
    return sketches.select(*keys, F.hll_sketch_estimate("distinct").alias("n_distinct"), "n", "low", "high")


def top_values(df: DataFrame, cols: list[str], n: int = 3, tracked: int = 1 << 14) -> DataFrame:
    """(col, rank, value, n): the n most frequent values of each column, the smaller of equally frequent ones first; nulls are left out.

    A frequent-items sketch of ``tracked`` places names the candidates: what it leaves out has at most 3.5 / tracked of
    a column's rows. A second pass counts the candidates alone. Only columns whose n-th candidate is not above that
    bound (those without frequent values) are counted in full.
    """
    first = df.agg(*[F.expr(f"approx_top_k(cast(`{c}` as double), {tracked * 3 // 4}, {tracked})").alias(c) for c in cols], *[F.count(c).alias(f"n_{i}") for i, c in enumerate(cols)])
    long = first.select(F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).alias("items"), F.col(f"n_{i}").alias("rows")) for i, c in enumerate(cols)])).alias("x"))
    named = long.select("x.col", "x.rows", F.explode("x.items").alias("item")).select("col", "rows", F.col("item.item").alias("value"))
    rows = _long(df, cols).where("value is not null")
    counted = rows.join(F.broadcast(named), ["col", "value"]).groupBy("col", "value", "rows").count()  # at most ``tracked`` candidates a column
    best = lambda r: r.groupBy("col").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("less"), "value"))), 1, n).alias("top"))
    bound = counted.groupBy("col").agg(F.max("rows").alias("rows"))
    sure = best(counted).join(bound, "col").withColumn("sure", (F.size("top") == n) & (-F.element_at("top", -1).less > F.col("rows") * 3.5 / tracked))
    few = sure.select("col", "sure").collect()  # a row for each column
    rest = [c for c in cols if c not in {r.col for r in few if r.sure}]
    out = sure.where("sure").select("col", "top")
    if rest:
        full = _long(df, rest).where("value is not null").groupBy("col", "value").count()
        ranked = full.withColumn("rank", F.row_number().over(Window.partitionBy("col").orderBy(F.desc("count"), "value")))
        out = out.unionByName(best(ranked.where(F.col("rank") <= n)))
    each = out.select("col", F.posexplode("top").alias("rank", "x"))
    return each.select("col", (F.col("rank") + 1).alias("rank"), F.col("x.value").alias("value"), (-F.col("x.less")).alias("n"))
