"""Fitted forecasters: ridge regression by Gram matrices, rolling re-training of it, of boosted trees and of any fitter."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import plus_hours
from .boosting import fit_boosters, predict_boosters

FEATURES = ["hour", "dow", "is_weekend", *[f"lag_{k}h" for k in (1, 2, 3, 6, 12, 24, 48, 72, 96, 120, 144, 168)], "roll_mean_24h", "roll_std_24h", "roll_mean_168h"]


#: Cells of a Gram matrix that travel as one array.
SLICE = 512


def grams(windowed: DataFrame, keys: list[str], scale: bool = True) -> DataFrame:
    """(keys, part, cells): [X'X | X'Y] of the rows of each key in slices of cells, one row from each task; sum them up.

    X is the history (and a one), Y the targets. With scale, history and targets are less the history's mean and over
    its population deviation. Tasks send sums only.
    """
    types = [windowed.schema[k] for k in keys]

    def run(batches):
        sums = {}
        for batch in batches:
            x, y, _, _ = _arrays(batch, len(keys), scale)
            own = list(zip(*[c.to_pylist() for c in batch.columns[: len(keys)]]))
            groups = {}
            for i, key in enumerate(own):
                groups.setdefault(key, []).append(i)
            for key, at in groups.items():
                cell = x[at].T @ np.hstack([x[at], y[at]])
                sums[key] = sums[key] + cell if key in sums else cell
        for key, cell in sums.items():
            parts = [cell.ravel()[i : i + SLICE] for i in range(0, cell.size, SLICE)]
            n = len(parts)
            columns = [pa.array([k] * n, pa.string() if isinstance(k, str) else None) for k in key] + [pa.array(range(n), pa.int32()), pa.array(parts, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, [*keys, "part", "cells"])

    schema = ", ".join(f"{t.name} {t.dataType.simpleString()}" for t in types)
    return windowed.select(*keys, "hist", "y").mapInArrow(run, f"{schema}, part int, cells array<double>")


def _arrays(batch, at: int, scale: bool):
    hist = np.stack(batch.column(at).to_numpy(zero_copy_only=False)) if batch.num_rows else np.zeros((0, 1))
    y = np.stack(batch.column(at + 1).to_numpy(zero_copy_only=False)) if batch.num_rows else np.zeros((0, 1))
    mu, sd = (hist.mean(1, keepdims=True), hist.std(1, keepdims=True)) if scale else (np.zeros((len(hist), 1)), np.ones((len(hist), 1)))
    sd = np.where(sd > 0, sd, 1.0)
    x = np.hstack([(hist - mu) / sd, np.ones((len(hist), 1))])
    return x, (y - mu) / sd, mu, sd


def solve(cells: np.ndarray, width: int, ridge: float) -> np.ndarray:
    g = cells.reshape(width, -1)
    return np.linalg.solve(g[:, :width] + ridge * np.eye(width), g[:, width:])


def linear_direct(spark: SparkSession, train: DataFrame, evals: DataFrame, back: int = 168, ridge: float = 1.0, scale: bool = True) -> DataFrame:
    """(series_id, origin_ts, y, y_hat) of one ridge model from windows() rows; only the summed Gram matrix comes to the driver."""
    cells = grams(train.withColumn("one", F.lit(1).cast("long")), ["one"], scale).select("part", F.posexplode("cells").alias("at", "cell"))
    cells = cells.groupBy("part", "at").agg(F.sum("cell").alias("cell")).collect()  # (back + 1) * (back + 1 + ahead) numbers
    flat = np.zeros(len(cells))
    flat[[r.part * SLICE + r["at"] for r in cells]] = [r.cell for r in cells]
    weights = spark.sparkContext.broadcast(solve(flat, back + 1, ridge) if len(flat) else None)

    def run(batches):
        for batch in batches:
            if not batch.num_rows or weights.value is None:
                continue
            x, _, mu, sd = _arrays(batch, 2, scale)
            p = x @ weights.value * sd + mu
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(list(p), pa.list_(pa.float64()))], ["series_id", "origin_ts", "y", "y_hat"])

    return evals.select("series_id", "origin_ts", "hist", "y").mapInArrow(run, "series_id string, origin_ts timestamp_ntz, y array<double>, y_hat array<double>")


def rolling_linear(windowed: DataFrame, blocks: DataFrame, back: int = 168, ridge: float = 1.0, embargo_hours: int = 24, scale: bool = True) -> DataFrame:
    """Re-trains before each block on all earlier rows and predicts the block's rows, without copying rows per block.

    Each row belongs to the first block whose training set has it, by a look at its series' list of cut-offs; rows are
    summed to one Gram matrix for each block, and running sums over the blocks are the expanding training sets.
    blocks: (series_id, origin_ts, block, block_start) of the rows to predict.
    """
    starts = blocks.groupBy("series_id", "block").agg(F.min("block_start").alias("block_start"))
    cut = plus_hours(F.col("block_start"), -embargo_hours)
    plan = starts.groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct(cut.alias("cut"), F.col("block").cast("long").alias("block")))).alias("cuts"))  # a place for each block of a series
    found = F.filter("cuts", lambda c: c.cut > F.col("origin_ts"))
    rows = windowed.join(plan, "series_id").withColumn("block", F.try_element_at(found, F.lit(1))["block"])
    cells = grams(rows.where("block is not null"), ["series_id", "block"], scale)

    def running(key, cell: pd.DataFrame) -> pd.DataFrame:
        """Running sums over a series' blocks of one slice of the cells: as many short arrays as the series has blocks."""
        out, total, own = [], 0.0, {b: np.sum(np.stack(c.tolist()), 0) for b, c in cell.groupby("block")["cells"]}
        for c in cell["cuts"].iloc[0]:
            total = total + own.get(c["block"], 0.0)
            if not np.isscalar(total):
                out.append((key[0], c["block"], key[1], total))
        return pd.DataFrame(out, columns=["series_id", "block", "part", "cells"])

    full = cells.join(plan, "series_id").groupBy("series_id", "part").applyInPandas(running, "series_id string, block long, part int, cells array<double>")
    fresh = lambda df, *names: df.select(*[F.col(c).alias(c) for c in names])  # noqa: E731  both sides stem from one table
    full = fresh(full, "series_id", "block", "part", "cells")
    todo = windowed.join(blocks.select("series_id", "origin_ts", F.col("block").cast("long").alias("block")), ["series_id", "origin_ts"])
    todo = fresh(todo, "series_id", "block", "origin_ts", "hist", "y")

    def fit(key, cell: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame({"series_id": [], "block": [], "origin_ts": [], "y": [], "y_hat": []})
        flat = np.concatenate(cell.sort_values("part")["cells"].tolist()) if len(cell) else np.zeros(0)
        if not len(rows) or not flat.any():
            return out
        weights = solve(flat, back + 1, ridge)
        batch = pa.RecordBatch.from_arrays([pa.array(rows["hist"].tolist()), pa.array(rows["y"].tolist())], ["hist", "y"])
        x, _, mu, sd = _arrays(batch, 0, scale)
        return rows[["series_id", "block", "origin_ts", "y"]].assign(y_hat=list(x @ weights * sd + mu))

    # One group is a block of one series: bounded by the block's hours.
    both = full.groupBy("series_id", "block").cogroup(todo.groupBy("series_id", "block"))
    return both.applyInPandas(fit, "series_id string, block long, origin_ts timestamp_ntz, y array<double>, y_hat array<double>")


def rolling_fit_predict(rows: DataFrame, blocks: DataFrame, fitter: Callable[[DataFrame], Callable[[DataFrame], DataFrame]], embargo_hours: int = 24) -> DataFrame:
    """For each block, fitter(the rows before its start, less the embargo) gives a predictor, which predicts the block's rows.

    blocks: (series_id, origin_ts, block, block_start), anchored over all series, so that one model serves them all; the
    driver goes over the weeks to predict, each fit is a Spark job of its own. Blocks without earlier rows are skipped.
    """
    starts = blocks.groupBy("block").agg(F.min("block_start").alias("start")).orderBy("block").collect()  # a row for each week
    out = None
    for b in starts:
        train = rows.where(F.col("origin_ts") < plus_hours(F.lit(b.start).cast("timestamp_ntz"), -embargo_hours))
        if train.isEmpty():
            continue
        todo = rows.join(blocks.where(F.col("block") == b.block).select("series_id", "origin_ts"), ["series_id", "origin_ts"], "left_semi")
        part = fitter(train)(todo).withColumn("block", F.lit(b.block).cast("long"))
        out = part if out is None else out.unionByName(part)
    return out


def rolling_trees(spark: SparkSession, rows: DataFrame, blocks: DataFrame, horizons=range(1, 25), features=FEATURES, embargo_hours: int = 24, **settings) -> DataFrame:
    """Boosted trees re-trained before each block on all earlier rows of all series, and their predictions of the block's rows.

    rows are of feature_table(), blocks as for rolling_fit_predict(), anchored over all series. All blocks' models grow
    in one fit, in which a row counts for the blocks that begin after it: no loop over blocks, no copies of rows. Blocks
    without earlier rows give nothing.
    """
    cut = plus_hours(F.col("block_start"), -embargo_hours)
    cuts = sorted(r.cut for r in blocks.select(cut.alias("cut")).distinct().collect())  # one for each week
    todo = rows.join(blocks.select("series_id", "origin_ts", "block", cut.alias("cut")), ["series_id", "origin_ts"])
    fitted = fit_boosters(spark, rows.where(F.col("origin_ts") < F.lit(cuts[-1]).cast("timestamp_ntz")), horizons, features, cuts, **settings) if cuts else None
    if fitted is None:
        return spark.createDataFrame([], "series_id string, origin_ts timestamp_ntz, model string, horizon long, y double, y_hat double")
    return predict_boosters(spark, fitted, todo, "cut")


def boosters_fitter(spark: SparkSession, horizons=range(1, 25), features=FEATURES, **settings) -> Callable[[DataFrame], Callable[[DataFrame], DataFrame]]:
    """A fitter of boosted trees for rolling_fit_predict(), over feature_table() rows."""

    def fit(train: DataFrame):
        fitted = fit_boosters(spark, train, horizons, features, **settings)
        return lambda rows: predict_boosters(spark, fitted, rows)

    return fit
