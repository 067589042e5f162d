"""Boosted regression trees for many targets at once: shared quantile bins, histograms of gradients, one pass for all models.

A model is a horizon, and if there are cuts, a horizon and a cut: it learns from the rows before the cut. All
models grow their trees side by side: a pass over the rows sums the gradients of every model's open nodes by
feature and bin, and the sums decide the splits. So the number of passes is that of rounds times levels,
whatever the number of horizons and cuts, and no row is copied for any of them. Gradients are whole
multiples of a fixed step, so their sums, and with them the trees, are the same for any partitioning.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import drop, keep

_M1, _M2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
ALWAYS = 1 << 62


@dataclass
class Settings:
    trees: int = 300
    rate: float = 0.05
    depth: int = 6
    rows: float = 0.8
    cols: float = 0.8
    seed: int = 42
    bins: int = 32
    smooth: float = 1.0  # added to a node's number of rows
    least: int = 1  # rows on either side of a split


@dataclass
class Boosters:
    """Fitted models: trees as arrays (tree, model, node); node i has the children 2i + 1 and 2i + 2."""

    features: list[str]
    edges: list[np.ndarray]
    horizons: np.ndarray  # of each model
    before: np.ndarray  # of each model: hours since 1970 before which it has learnt
    base: np.ndarray  # NaN for a model without rows
    rate: float
    feature: np.ndarray  # -1 where a node is a leaf
    bin: np.ndarray  # the last one that goes left
    value: np.ndarray
    gain: np.ndarray = field(repr=False, default=None)

    def predict(self, x: np.ndarray, models: np.ndarray) -> np.ndarray:
        """(rows, models) from binned rows."""
        out = np.repeat(self.base[models][None], len(x), 0)
        for t in range(len(self.feature)):
            out += self.rate * _walked(x, self.feature[t, models], self.bin[t, models], self.value[t, models])
        return out


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Numbers of bins; what is missing counts as lowest."""
    x = np.where(np.isnan(x), -np.inf, x)
    return np.stack([np.searchsorted(e, x[:, i], "left") for i, e in enumerate(edges)], 1).astype(np.uint8)


def _walked(x, feature, bin_, value):
    """The value of the node that each row comes to in each model's tree: (rows, models)."""
    many = feature.shape[1]
    at = np.arange(feature.shape[0])[None] * many
    node = np.zeros((len(x), feature.shape[0]), np.int64)
    f, b = feature.ravel(), bin_.ravel()
    row = np.arange(len(x))[:, None]
    while True:
        split = f[at + node]
        go = split >= 0
        if not go.any():
            return value.ravel()[at + node]
        node = np.where(go, 2 * node + 1 + (x[row, np.maximum(split, 0)] > b[at + node]), node)


def _drawn(nr: np.ndarray, tree: int, horizon: np.ndarray, share: float, seed: int) -> np.ndarray:
    """(rows, models): whether a row is in the sample of a tree, by the row's number, the tree and the model's horizon alone."""
    with np.errstate(over="ignore"):
        salt = (horizon.astype(np.uint64) + np.uint64(tree * 4096 + 1)) * _STEP + np.uint64(seed)
        z = nr[:, None] + salt[None] * _M1
        z = (z ^ (z >> np.uint64(30))) * _M1
        z = (z ^ (z >> np.uint64(27))) * _M2
    return (z ^ (z >> np.uint64(31))) >> np.uint64(11) < np.uint64(share * (1 << 53))


def _columns(s: Settings, tree: int, horizon: np.ndarray, k: int) -> np.ndarray:
    """(models, features): the features that a tree of these horizons may split by."""
    out = np.zeros((len(horizon), k), bool)
    for i, h in enumerate(horizon):
        out[i, np.random.default_rng((s.seed, tree, int(h))).permutation(k)[: max(1, round(s.cols * k))]] = True
    return out


def _histograms(x: np.ndarray, row: np.ndarray, slot: np.ndarray, gradient: np.ndarray, slots: int, bins: int) -> np.ndarray:
    """(slots, features, bins, 2): sums of gradients and numbers of rows."""
    k = x.shape[1]
    at = ((slot[:, None] * k + np.arange(k)) * bins + x[row]).ravel()
    size = slots * k * bins
    both = np.stack([np.bincount(at, np.repeat(gradient, k), size), np.bincount(at, minlength=size)], -1)
    return both.reshape(slots, k, bins, 2)


def _splits(hist: np.ndarray, allowed: np.ndarray, s: Settings):
    """The best split of each slot: feature (-1 if none gains), bin, gain, and (gradient, rows) of all, left and right. Equals go to the first."""
    upto = np.cumsum(hist, 2)
    every = upto[:, 0, -1]
    right = every[:, None, None] - upto
    score = lambda x: x[..., 0] ** 2 / (x[..., 1] + s.smooth)
    gain = score(upto) + score(right) - score(every)[:, None, None]
    gain = np.where((upto[..., 1] >= s.least) & (right[..., 1] >= s.least) & allowed[:, :, None], gain, -1.0).reshape(len(hist), -1)
    best = gain.argmax(1)
    slot = np.arange(len(hist))
    most = gain[slot, best]
    feature, bin_ = np.divmod(best, hist.shape[2])
    return np.where(most > 1e-9, feature, -1), bin_, np.maximum(most, 0.0), every, upto[slot, feature, bin_], right[slot, feature, bin_]


class _Tree:
    """The trees of one round of all models, level by level."""

    def __init__(self, models: int, s: Settings):
        shape = models, (2 << s.depth) - 1
        self.feature, self.bin, self.value, self.gain = np.full(shape, -1, np.int8), np.zeros(shape, np.uint8), np.zeros(shape), np.zeros(shape)
        self.settings = s

    def add(self, model: np.ndarray, node: np.ndarray, found, scale: float) -> None:
        feature, bin_, gain, every, left, right = found
        leaf = lambda x: -x[..., 0] / (x[..., 1] + self.settings.smooth) / scale
        root = node == 0
        self.value[model[root], 0] = leaf(every[root])
        go = feature >= 0
        m, n = model[go], node[go]
        self.feature[m, n], self.bin[m, n], self.gain[m, n] = feature[go], bin_[go], gain[go] / scale**2
        self.value[m, 2 * n + 1], self.value[m, 2 * n + 2] = leaf(left[go]), leaf(right[go])


def _open_rows(x, y, f, nr, t, plan: dict, numbers: np.ndarray, tree: int, s: Settings):
    """(row, place in numbers, gradient) of the rows that a round of these models learns from."""
    horizon = plan["horizon"][numbers]
    row, model = np.nonzero(_drawn(nr, tree, horizon, s.rows, s.seed) & (t[:, None] < plan["before"][numbers][None]))
    return row, model, np.rint((f[row, model] - y[row, horizon[model]]) * plan["scale"])


def _descended(x, row, model, gradient, grown: _Tree, depth: int):
    """The rows of open nodes at a depth, with the node's place in its level."""
    node = np.zeros(len(row), np.int64)
    for _ in range(depth):
        f = grown.feature[model, node]
        go = f >= 0
        row, model, gradient, node, f = row[go], model[go], gradient[go], node[go], f[go]
        node = 2 * node + 1 + (x[row, f] > grown.bin[model, node])
    return row, model, gradient, node - ((1 << depth) - 1)


def _slots(hist: np.ndarray, depth: int, tree: int, horizon: np.ndarray, s: Settings, grown: _Tree, scale: float) -> None:
    """Adds the level's splits from the histograms (models * nodes of the level, ...) to the trees."""
    used = np.flatnonzero(hist[:, 0, :, 1].sum(1))
    if not len(used):
        return
    model, place = used >> depth, used & ((1 << depth) - 1)
    allowed = _columns(s, tree, horizon, hist.shape[1])[model]
    grown.add(model, place + (1 << depth) - 1, _splits(hist[used], allowed, s), scale)


def _whole(settings: Settings, plan: dict):
    """All rows of a table of one task, and the numbers of some models, to these models' trees: no exchange between levels."""

    def run(key, rows):
        s, numbers = settings, np.array(plan["groups"][key[0].as_py()])
        x, y, nr, t = _unpacked(rows)
        f = np.repeat(plan["base"][numbers][None], len(x), 0)
        out = []
        for tree in range(s.trees):
            grown = _Tree(len(numbers), s)
            row, model, gradient = _open_rows(x, y, f, nr, t, plan, numbers, tree, s)
            for depth in range(s.depth):
                r, m, g, place = _descended(x, row, model, gradient, grown, depth)
                _slots(_histograms(x, r, (m << depth) + place, g, len(numbers) << depth, s.bins), depth, tree, plan["horizon"][numbers], s, grown, plan["scale"])
            f += s.rate * _walked(x, grown.feature, grown.bin, grown.value)
            out.append(grown)
        arrays = [np.stack([getattr(g, n) for g in out], 1) for n in ("feature", "bin", "value", "gain")]  # (model, tree, node)
        return pa.Table.from_arrays([pa.array(numbers, pa.int32()), *[pa.array([a[i].tobytes() for i in range(len(numbers))], pa.binary()) for a in arrays]], ["model", "feature", "bin", "value", "gain"])

    return run


def _unpacked(rows):
    n = rows.num_rows
    column = lambda name: rows[name].combine_chunks() if isinstance(rows[name], pa.ChunkedArray) else rows[name]
    raw = lambda name, kind: np.frombuffer(b"".join(column(name).to_pylist()), kind).reshape(n, -1)
    return raw("x", np.uint8), raw("y", np.float64), column("nr").to_numpy().view(np.uint64), column("t").to_numpy()


def _level(settings: Settings, plan: dict, sent):
    """Rows with their predictions so far (f) to the histograms of a level's open nodes, one row for each node."""

    def run(batches):
        s, (pending, grown, tree, depth) = settings, sent.value
        every = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y, nr, t = _unpacked(batch)
            f = _predicted(batch, x, pending, s)
            row, model, gradient = _open_rows(x, y, f, nr, t, plan, np.arange(plan["many"]), tree, s)
            row, model, gradient, place = _descended(x, row, model, gradient, grown, depth)
            hist = _histograms(x, row, (model << depth) + place, gradient, plan["many"] << depth, s.bins)
            every = hist if every is None else every + hist
        if every is not None:
            used = np.flatnonzero(every[:, 0, :, 1].sum(1))
            for lo in range(0, len(used), 256):
                yield pa.RecordBatch.from_arrays([pa.array(used[lo : lo + 256]), pa.array([every[i].tobytes() for i in used[lo : lo + 256]], pa.binary())], ["slot", "hist"])

    return run


def _predicted(batch, x, pending: list[_Tree], s: Settings) -> np.ndarray:
    f = np.frombuffer(b"".join(batch.column(batch.schema.names.index("f")).to_pylist()), np.float64).reshape(len(x), -1)
    for grown in pending:
        f = f + s.rate * _walked(x, grown.feature, grown.bin, grown.value)
    return f


def _decided(settings: Settings, plan: dict, tree: int, depth: int):
    """The histograms of a node from all tasks to its split."""

    def run(key, rows):
        s, slot = settings, key[0].as_py()
        hist = sum(np.frombuffer(h, np.float64) for h in rows["hist"].to_pylist()).reshape(1, -1, s.bins, 2)
        f, b, g, *sums = _splits(hist, _columns(s, tree, plan["horizon"][[slot >> depth]], hist.shape[1]), s)
        return pa.Table.from_arrays([pa.array([slot]), pa.array(f), pa.array(b), pa.array(g), pa.array([np.concatenate([x[0] for x in sums])], pa.list_(pa.float64()))], ["slot", "feature", "bin", "gain", "sums"])

    return run


def _grown_apart(spark: SparkSession, data: DataFrame, s: Settings, plan: dict, every: int) -> list[_Tree]:
    """Trees from rows of any number of partitions: a pass for each round and level; predictions are written every so many rounds."""
    schema = "nr long, t long, x binary, y binary, f binary"

    def with_f(pending):
        def run(batches):
            for batch in batches:
                x, y, nr, t = _unpacked(batch)
                f = _predicted(batch, x, pending.value, s) if "f" in batch.schema.names else np.repeat(plan["base"][None], len(x), 0)
                columns = [batch.column(batch.schema.names.index(n)) for n in ("nr", "t", "x", "y")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([v.tobytes() for v in f], pa.binary())], ["nr", "t", "x", "y", "f"])

        return run

    send = spark.sparkContext.broadcast
    state, path = keep(spark, data.mapInArrow(with_f(send([])), schema))
    trees, pending = [], []
    for tree in range(s.trees):
        grown = _Tree(plan["many"], s)
        for depth in range(s.depth):
            hists = state.mapInArrow(_level(s, plan, send((pending, grown, tree, depth))), "slot long, hist binary")
            rows = hists.groupBy("slot").applyInArrow(_decided(s, plan, tree, depth), "slot long, feature long, bin long, gain double, sums array<double>").toPandas()  # a row for each open node
            if not len(rows):
                break
            sums = np.stack(rows["sums"].to_numpy()).reshape(-1, 3, 2)
            slot = rows["slot"].to_numpy()
            found = rows["feature"].to_numpy(), rows["bin"].to_numpy(), rows["gain"].to_numpy(), sums[:, 0], sums[:, 1], sums[:, 2]
            grown.add(slot >> depth, (slot & ((1 << depth) - 1)) + (1 << depth) - 1, found, plan["scale"])
        trees.append(grown)
        pending = [*pending, grown]
        if len(pending) == every:
            (state, path), old = keep(spark, state.mapInArrow(with_f(send(pending)), schema)), path
            drop(spark, old)
            pending = []
    drop(spark, path)
    return trees


def fit_boosters(spark: SparkSession, train: DataFrame, horizons, features, cuts=None, edges=None, task_rows: int = 50_000, every: int = 10, **settings) -> Boosters | None:
    """Models of all horizons (and cuts) from rows (series_id, origin_ts, y: an array by horizon, features); None without rows.

    A model of a cut (a time) learns from the rows with origin_ts before it; the bins (quantiles, or the edges given)
    are of all rows, and tell nothing of targets. Rows are few bytes each: bins, targets, and
    while fitting a prediction for each model. Up to ``task_rows`` rows are one task's work, so there the models are
    dealt out to tasks, each of which grows whole trees; more rows stay in partitions and meet in histograms. Both
    give the same trees.
    """
    s = Settings(**settings)
    horizons, features = list(horizons), list(features)
    hour = F.timestamp_diff("HOUR", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("origin_ts"))
    rows = train.select(F.xxhash64("series_id", "origin_ts").alias("nr"), hour.alias("t"), *[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)], F.transform(F.array(*[F.element_at("y", h) for h in horizons]), lambda v: v.cast("double")).alias("y"))
    rows, path = keep(spark, rows)
    shares = [i / s.bins for i in range(1, s.bins)]
    head = rows.agg(F.count("*").alias("n"), F.max(F.array_max(F.transform("y", F.abs))).alias("most"), *[F.percentile_approx(f"x{i}", shares, 10_000).alias(f"x{i}") for i in range(len(features))]).first()
    if not head.n:
        drop(spark, path)
        return None
    edges = edges or [np.unique(np.array(head[f"x{i}"] or [0.0])) for i in range(len(features))]
    epoch = np.datetime64("1970-01-01", "h")
    limits = [ALWAYS] if cuts is None else [int((np.datetime64(c, "s") - epoch) / np.timedelta64(3600, "s") - 1e-9) + 1 for c in cuts]  # whole hours
    before, horizon = np.repeat(limits, len(horizons)), np.tile(np.arange(len(horizons)), len(limits))

    def packed(batches):
        for batch in batches:
            x = np.stack([batch.column(2 + i).to_numpy(zero_copy_only=False).astype(float) for i in range(len(features))], 1)
            y = np.array(batch.column(batch.num_columns - 1).to_pylist(), float).reshape(len(x), -1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array([v.tobytes() for v in a], pa.binary()) for a in (binned(x, edges), y)]], ["nr", "t", "x", "y"])

    many = max(1, -(-head.n // task_rows))
    data, packed_path = keep(spark, rows.repartition(many, "nr").mapInArrow(packed, "nr long, t long, x binary, y binary"))
    drop(spark, path)

    def sums(batches):
        total, n = np.zeros(len(before)), np.zeros(len(before))
        for batch in batches:
            _, y, _, t = _unpacked(batch)
            inside = t[:, None] < before[None]
            total += (y[:, horizon] * inside).sum(0)
            n += inside.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(before)), pa.int32()), pa.array(total), pa.array(n)], ["model", "total", "n"])

    means = data.mapInArrow(sums, "model int, total double, n double").groupBy("model").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).toPandas().sort_values("model")  # a row for each model
    n = means["n"].to_numpy()
    base = np.where(n > 0, means["total"].to_numpy() / np.maximum(n, 1), 0.0).astype(np.float32).astype(float)
    scale = 2.0 ** np.floor(50 - np.log2(head.n) - np.log2(max(head.most or 0.0, 1e-9)))
    plan = {"before": before, "horizon": horizon, "base": base, "scale": scale, "many": len(before)}
    if many == 1:
        tasks = min(len(before), max(1, spark.sparkContext.defaultParallelism))
        plan["groups"] = [list(range(i, len(before), tasks)) for i in range(tasks)]
        dealt = data.withColumn("task", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1)))).repartition(tasks, "task")
        got = dealt.groupBy("task").applyInArrow(_whole(s, plan), "model int, feature binary, bin binary, value binary, gain binary").toPandas().sort_values("model")
        shape = len(before), s.trees, (2 << s.depth) - 1
        arrays = [np.frombuffer(b"".join(map(bytes, got[c])), k).reshape(shape).swapaxes(0, 1) for c, k in (("feature", np.int8), ("bin", np.uint8), ("value", np.float64), ("gain", np.float64))]
    else:
        trees = _grown_apart(spark, data, s, plan, every)
        arrays = [np.stack([getattr(t, c) for t in trees]) for c in ("feature", "bin", "value", "gain")]
    drop(spark, packed_path)
    return Boosters(features, edges, np.array(horizons)[horizon], before, np.where(n > 0, base, np.nan), s.rate, *arrays)


def predict_boosters(spark: SparkSession, fitted: Boosters, rows: DataFrame, cut_col: str | None = None, name: str = "trees") -> DataFrame:
    """(series_id, origin_ts, model, horizon, y, y_hat) of rows by the models of all horizons; with cut_col by those of each row's cut."""
    sent = spark.sparkContext.broadcast(fitted)  # bounded by the settings: trees, depth and models
    hour = F.timestamp_diff("HOUR", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(cut_col)) if cut_col else F.lit(ALWAYS)
    features = fitted.features
    own = rows.select("series_id", "origin_ts", "y", hour.cast("long").alias("cut"), *[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)])

    def run(batches):
        b = sent.value
        for batch in batches:
            x = np.stack([batch.column(4 + i).to_numpy(zero_copy_only=False).astype(float) for i in range(len(features))], 1) if batch.num_rows else np.zeros((0, len(features)))
            cut, x = batch.column(3).to_numpy(), binned(x, b.edges)
            for c in np.unique(cut):
                models = np.flatnonzero((b.before == c) & ~np.isnan(b.base))
                at = np.flatnonzero(cut == c)
                if not len(models):
                    continue
                hat = b.predict(x[at], models)
                h = b.horizons[models]
                y = np.array([[v[i - 1] for i in h] for v in batch.column(2).take(pa.array(at)).to_pylist()], float)
                times = np.repeat(at, len(models))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(times)), batch.column(1).take(pa.array(times)), pa.array(np.tile(h, len(at)).astype(np.int64)), pa.array(y.ravel()), pa.array(hat.ravel())], ["series_id", "origin_ts", "horizon", "y", "y_hat"])

    done = own.mapInArrow(run, "series_id string, origin_ts timestamp_ntz, horizon long, y double, y_hat double")
    return done.select("series_id", "origin_ts", F.lit(name).alias("model"), "horizon", "y", "y_hat")


def mean_importance(spark: SparkSession, fitted: Boosters) -> DataFrame:
    """(feature, value): the mean gain of a feature's splits as a share of all features', averaged over the models."""
    shares = []
    for m in range(fitted.feature.shape[1]):
        f, gain = fitted.feature[:, m].ravel(), fitted.gain[:, m].ravel()
        n = np.bincount(f[f >= 0], minlength=len(fitted.features))
        mean = np.bincount(f[f >= 0], gain[f >= 0], len(fitted.features)) / np.maximum(n, 1)
        shares.append(mean / mean.sum() if mean.sum() > 0 else mean)
    rows = [(f, float(v)) for f, v in zip(fitted.features, np.mean(shares, 0))]
    return spark.createDataFrame(rows, "feature string, value double").orderBy(F.desc("value"), "feature")
