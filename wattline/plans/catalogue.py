"""The queries of the series operators and their SQL."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import boosting as B
from ..operators import evaluate as E
from ..operators import models as M
from ..operators import profile as P
from ..operators import series as S
from ..operators import sketches as K
from ..sources import tables as T
from ..streaming import rollup as R

#: Parts of the SQL twins, in order; each may use those before it.
PARTS = {
    "readings": "SELECT CAST(event_type AS VARCHAR) AS series_id, date_trunc('minute', ts) AS ts, avg(value) AS v FROM events GROUP BY 1, 2",
    "users": "SELECT CAST(user_id AS VARCHAR) AS series_id, date_trunc('minute', ts) AS ts, avg(value) AS v FROM events GROUP BY 1, 2",
    "gaps": """SELECT * FROM (SELECT series_id, ts, v AS lo, lead(ts) OVER w AS next_ts, lead(v) OVER w AS hi, date_diff('minute', ts, lead(ts) OVER w) - 1 AS length
        FROM readings WINDOW w AS (PARTITION BY series_id ORDER BY ts)) WHERE length > 0""",
    "ugaps": """SELECT * FROM (SELECT series_id, ts, date_diff('minute', ts, lead(ts) OVER w) - 1 AS length
        FROM users WINDOW w AS (PARTITION BY series_id ORDER BY ts)) WHERE length > 0""",
    "fills": "SELECT *, unnest(range(1, length + 1)) AS i FROM gaps WHERE length <= 1440",
    "minute": """SELECT series_id, ts, v, 0 AS impute_flag FROM readings UNION ALL SELECT series_id, ts + to_minutes(CAST(i AS INTEGER)),
        CASE WHEN length <= 119 THEN lo + (hi - lo) * i / (length + 1) ELSE lo END, CASE WHEN length <= 119 THEN 1 ELSE 2 END FROM fills""",
    "hours": """SELECT series_id, date_trunc('hour', ts) AS ts, avg(v) AS kw, sum(v) / 60 AS kwh, max(impute_flag) AS impute_flag, count(v) AS n
        FROM minute GROUP BY 1, 2""",
    "spine": "SELECT series_id, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM hours GROUP BY series_id",
    "hourly": """SELECT s.series_id, s.ts, CASE WHEN n = 60 THEN kw END AS kw, CASE WHEN n = 60 THEN kwh END AS kwh,
        CASE WHEN n = 60 THEN impute_flag END AS impute_flag, coalesce(n, 0) AS n_valid_min FROM spine s LEFT JOIN hours h ON s.series_id = h.series_id AND s.ts = h.ts""",
    "days": """SELECT series_id, unnest(generate_series(min(date_trunc('day', ts)), max(date_trunc('day', ts)), INTERVAL 1 DAY)) AS ts FROM hourly GROUP BY series_id""",
    "daily": """SELECT d.series_id, d.ts, avg(h.kw) AS kw FROM days d LEFT JOIN hourly h ON d.series_id = h.series_id AND date_trunc('day', h.ts) = d.ts GROUP BY 1, 2""",
    "marked": """SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR date_diff('hour', lag(ts) OVER w, ts) > 1 THEN 1 ELSE 0 END AS fresh
        FROM hourly WHERE kw IS NOT NULL WINDOW w AS (PARTITION BY series_id ORDER BY ts)""",
    "segs": "SELECT series_id, ts, kw, CAST(sum(fresh) OVER (PARTITION BY series_id ORDER BY ts) AS BIGINT) AS segment_id FROM marked",
    "stats": """SELECT series_id, segment_id, min(ts) AS start, max(ts) AS "end", count(*) AS length_hours, greatest(0, count(*) - 191) AS n_windows
        FROM segs GROUP BY 1, 2""",
    "placed": "SELECT *, row_number() OVER (PARTITION BY series_id, segment_id ORDER BY ts) AS rn, count(*) OVER (PARTITION BY series_id, segment_id) AS n FROM segs",
    "origins": "SELECT series_id, segment_id, ts AS origin_ts FROM placed WHERE rn >= 168 AND rn <= n - 24",
    "daycount": "SELECT series_id, date_trunc('day', origin_ts) AS day, count(*) AS n FROM origins GROUP BY 1, 2",
    "ordered": "SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY origin_ts) - 1 AS idx, count(*) OVER (PARTITION BY series_id) AS total FROM origins",
    "cuts": """SELECT series_id, date_trunc('day', min(CASE WHEN idx = floor(round(total * 0.70, 6)) THEN origin_ts END)) AS cut_val,
        date_trunc('day', min(CASE WHEN idx = floor(round(total * 0.85, 6)) THEN origin_ts END)) AS cut_test FROM ordered GROUP BY 1""",
    "split": """SELECT o.series_id, o.segment_id, o.origin_ts, c.cut_val, c.cut_test,
        CASE WHEN origin_ts < cut_val THEN 'train' WHEN origin_ts < cut_test THEN 'val' ELSE 'test' END AS split FROM origins o JOIN cuts c ON o.series_id = c.series_id""",
    "evals": "SELECT * FROM split WHERE split <> 'train'",
    "blocks": """SELECT *, min(origin_ts) OVER (PARTITION BY series_id, block) AS block_start FROM (SELECT *,
        CAST(floor(date_diff('hour', min(origin_ts) OVER (PARTITION BY series_id), origin_ts) / 168.0) AS BIGINT) AS block FROM evals)""",
    "dayblocks": """SELECT *, min(origin_ts) OVER (PARTITION BY series_id, block) AS block_start FROM (SELECT *,
        CAST(floor(date_diff('hour', min(origin_ts) OVER (PARTITION BY series_id), origin_ts) / 24.0) AS BIGINT) AS block FROM evals)""",
    "chunks": """SELECT series_id, origin_ts, row_number() OVER (PARTITION BY series_id ORDER BY origin_ts) - 1 AS rn,
        ntile(4) OVER (PARTITION BY series_id ORDER BY origin_ts) - 1 AS fold FROM split WHERE origin_ts < cut_test""",
    "placed_in_fold": """SELECT *, min(rn) OVER (PARTITION BY series_id, fold) AS n_train, least(count(*) OVER (PARTITION BY series_id, fold), 720) AS n_val,
        row_number() OVER (PARTITION BY series_id, fold ORDER BY origin_ts) AS place FROM chunks WHERE fold > 0""",
    "folds": "SELECT * FROM placed_in_fold WHERE place <= 720 AND n_train >= 50 AND n_val >= 20",
    "targets": """SELECT series_id, segment_id, ts, kw AS y, lag(kw, 24) OVER (PARTITION BY series_id, segment_id ORDER BY ts) AS seasonal_naive,
        sum(kw) OVER (PARTITION BY series_id, segment_id, hour(ts) ORDER BY ts ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) / 7 AS same_hour_mean FROM segs""",
    "ahead": """SELECT o.series_id, o.segment_id, o.origin_ts, s.kw AS persistence, unnest(range(1, 25)) AS horizon
        FROM origins o JOIN segs s ON s.series_id = o.series_id AND s.ts = o.origin_ts""",
    "aimed": "SELECT *, origin_ts + to_hours(CAST(horizon AS INTEGER)) AS target_ts FROM ahead",
    "truth": """SELECT a.*, t.y, t.seasonal_naive, t.same_hour_mean FROM aimed a JOIN targets t ON t.series_id = a.series_id AND t.ts = a.target_ts""",
    "pred": """SELECT series_id, segment_id, origin_ts, 'persistence' AS model, horizon, y, persistence AS y_hat FROM truth
        UNION ALL SELECT series_id, segment_id, origin_ts, 'seasonal_naive', horizon, y, seasonal_naive FROM truth
        UNION ALL SELECT series_id, segment_id, origin_ts, 'same_hour_mean', horizon, y, same_hour_mean FROM truth""",
    "pooled": """SELECT model, count(*) AS n, avg(abs(y_hat - y)) AS mae, sqrt(avg((y_hat - y) * (y_hat - y))) AS rmse,
        avg(CASE WHEN abs(y) + abs(y_hat) > 1e-8 THEN 2 * abs(y_hat - y) / (abs(y) + abs(y_hat)) END) AS smape,
        1 - sum((y_hat - y) * (y_hat - y)) / (var_pop(y) * count(y)) AS r2 FROM pred GROUP BY 1""",
    "byh": """SELECT model, horizon, count(*) AS n, avg(abs(y_hat - y)) AS mae, sqrt(avg((y_hat - y) * (y_hat - y))) AS rmse,
        avg(CASE WHEN abs(y) + abs(y_hat) > 1e-8 THEN 2 * abs(y_hat - y) / (abs(y) + abs(y_hat)) END) AS smape,
        1 - sum((y_hat - y) * (y_hat - y)) / (var_pop(y) * count(y)) AS r2 FROM pred GROUP BY 1, 2""",
    # Inputs with planted faults.
    "off_pred": "SELECT model, horizon, y, y_hat + CASE WHEN model = 'persistence' AND hour(origin_ts) = 5 THEN 0.5 ELSE 0 END AS y_hat FROM pred",
    "off_pooled": """SELECT model, avg(abs(y_hat - y)) AS mae, sqrt(avg((y_hat - y) * (y_hat - y))) AS rmse,
        avg(CASE WHEN abs(y) + abs(y_hat) > 1e-8 THEN 2 * abs(y_hat - y) / (abs(y) + abs(y_hat)) END) AS smape,
        1 - sum((y_hat - y) * (y_hat - y)) / (var_pop(y) * count(y)) AS r2 FROM off_pred GROUP BY 1""",
    "off_mean": "SELECT model, avg(m) AS hm FROM (SELECT model, horizon, avg(abs(y_hat - y)) AS m FROM off_pred GROUP BY 1, 2) GROUP BY 1",
    "own_mean": "SELECT model, avg(mae) AS hm FROM byh GROUP BY 1",
    "off_hourly": "SELECT series_id, ts, kwh * CASE WHEN series_id = 'click' THEN 1.01 WHEN hour(ts) = 5 THEN 1.002 ELSE 1 END AS kwh FROM hourly WHERE kwh IS NOT NULL",
    "energy": "SELECT series_id, date_trunc('hour', ts) AS ts, sum(v) / 60 AS e FROM minute GROUP BY 1, 2",
    "off_minute": """SELECT series_id, ts, CASE WHEN impute_flag = 1 AND minute(ts) = 7 THEN v + 100 ELSE v END AS v, impute_flag FROM minute
        WHERE NOT (impute_flag = 0 AND minute(ts) = 3 AND hour(ts) = 4)""",
    "off_hours": "SELECT series_id, ts, CASE WHEN hour(ts) = 5 THEN kw * 2 ELSE kw END AS kw, kwh, n_valid_min FROM hourly WHERE NOT (hour(ts) = 9 AND day(ts) = 3)",
    "due": "SELECT series_id, ts + to_minutes(CAST(i AS INTEGER)) AS ts, lo, hi, length FROM fills",
    "traced": """SELECT m.*, r.series_id IS NOT NULL AS is_raw, d.lo, d.hi, d.length FROM off_minute m LEFT JOIN readings r ON r.series_id = m.series_id AND r.ts = m.ts
        LEFT JOIN due d ON d.series_id = m.series_id AND d.ts = m.ts""",
    "reckoned": "SELECT series_id, date_trunc('hour', ts) AS ts, count(v) AS n, avg(v) AS kw, sum(v) / 60 AS kwh FROM off_minute GROUP BY 1, 2",
    "held": "SELECT h.*, coalesce(m.n, 0) AS m_n, m.kw AS m_kw, m.kwh AS m_kwh FROM off_hours h LEFT JOIN reckoned m ON m.series_id = h.series_id AND m.ts = h.ts",
    "lagged": """SELECT h.kw, lag(h.kw) OVER w AS b1, lag(h.kw, 2) OVER w AS b2, p.kw AS t1, q.kw AS t2 FROM off_hours h
        LEFT JOIN off_hours p ON p.series_id = h.series_id AND p.ts = h.ts - INTERVAL 1 HOUR LEFT JOIN off_hours q ON q.series_id = h.series_id AND q.ts = h.ts - INTERVAL 2 HOUR
        WINDOW w AS (PARTITION BY h.series_id ORDER BY h.ts)""",
    "counted": """SELECT s.series_id, s.segment_id, s.length_hours, s.n_windows, count(h.ts) AS hours FROM stats s
        LEFT JOIN off_hours h ON h.series_id = s.series_id AND h.kw IS NOT NULL AND h.ts BETWEEN s.start AND s."end" GROUP BY 1, 2, 3, 4""",
}


def _uses(sql: str) -> list[str]:
    import re

    return [p for p in PARTS if re.search(rf"\b{p}\b", sql)]


def sql(body: str) -> str:
    """body with the parts that it uses, and theirs, as common table expressions."""
    need, todo = set(), _uses(body)
    while todo:
        p = todo.pop()
        if p not in need:
            need.add(p)
            todo += [q for q in _uses(PARTS[p]) if q != p]
    parts = [f"{p} AS MATERIALIZED ({PARTS[p]})" for p in PARTS if p in need]
    return f"WITH {', '.join(parts)} {body}" if parts else body


QUERIES, SQL = {}, {}


def query(name: str, body: str | None = None):
    def add(f):
        QUERIES[name] = f
        f.__name__ = name
        if body:
            SQL[name] = sql(body)
        return f

    return add


def plain(df: DataFrame) -> DataFrame:
    """df with 64-bit integers for 32-bit ones, as the SQL twins have them."""
    return df.select(*[F.col(c).cast("long").alias(c) if t == "int" else F.col(c) for c, t in df.dtypes])


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return T.read_table(spark, f"{d}/{name}.parquet")


def minutes(spark, d, key="event_type"):
    return T.readings(table(spark, d, "events"), key)


def kept(spark: SparkSession, df: DataFrame) -> DataFrame:
    """df written to the shared place and read again, as the steps of a series job pass on their tables."""
    return T.keep(spark, df)[0]


def hourly(spark, d):
    return S.resample_hourly(S.impute(minutes(spark, d)))


def segments(spark, d):
    return kept(spark, S.assign_segments(hourly(spark, d)))


def origins(spark, d):
    return S.window_origins(segments(spark, d))


def split(spark, d):
    return kept(spark, E.time_split(origins(spark, d)))


def predictions_and_split(spark, d):
    """The baselines' predictions and the split of their origins, from one table of segments."""
    seg = segments(spark, d)
    return E.predict_baselines(seg), kept(spark, E.time_split(S.window_origins(seg)))


def predictions(spark, d):
    return E.predict_baselines(segments(spark, d))


# --- A: sources and sinks


@query("a1_read_readings")
def _(spark, d):
    path = T.scratch(spark)
    rows = minutes(spark, d).select(F.date_format("ts", "d/M/yyyy").alias("Date"), F.date_format("ts", "H:mm:ss").alias("Time"), F.when(F.col("v") > 1, F.col("v")).alias("v"), "series_id")
    rows.select("Date", "Time", "v").write.csv(path, sep=";", header=True, nullValue="?")
    return T.parse_ts(T.read_readings(spark, path, ["v"])).select("ts", "v")


SQL["a1_read_readings"] = sql("SELECT ts, CASE WHEN v > 1 THEN v END AS v FROM readings")


@query("a2_parse_ts", "SELECT ts, count(*) AS n FROM readings GROUP BY 1")
def _(spark, d):
    text = minutes(spark, d).select(F.date_format("ts", "d/M/yyyy").alias("Date"), F.date_format("ts", "H:mm:ss").alias("Time"))
    return T.parse_ts(text).groupBy("ts").agg(F.count("*").alias("n"))


@query("a3_read_table", "SELECT event_id, ts, value FROM events")
def _(spark, d):
    return T.read_table(spark, f"{d}/events.parquet", ["event_id", "ts", "value"])


@query("a4_write_table", "SELECT series_id, count(*) AS n FROM readings GROUP BY 1")
def _(spark, d):
    path = T.scratch(spark)
    T.write_table(minutes(spark, d).withColumn("day", F.to_date("ts")), path, ["day"])
    return T.read_table(spark, path).groupBy("series_id").agg(F.count("*").alias("n"))


@query("a5_report", "SELECT series_id, segment_id, length_hours, n_windows FROM stats")
def _(spark, d):
    path = T.scratch(spark)
    T.write_report(S.segment_stats(segments(spark, d)).select("series_id", "segment_id", "length_hours", "n_windows"), path)
    return T.read_report(spark, path, "series_id string, segment_id long, length_hours long, n_windows long")


@query("a6_prediction_store", "SELECT model AS run_id, count(*) AS n FROM pred WHERE model <> 'seasonal_naive' GROUP BY 1")
def _(spark, d):
    path, pred = T.scratch(spark), predictions(spark, d)
    for run in ("persistence", "same_hour_mean"):
        T.save_predictions(pred.where(F.col("model") == run), path, run, "test")
    T.save_predictions(pred.where("model = 'seasonal_naive'"), path, "seasonal_naive", "val")
    return T.load_predictions(spark, path, "test").groupBy("run_id").agg(F.count("*").alias("n"))


LAYOUT = ("series_id", "chunk")


def stored_layout(spark, d, buckets: int = 8):
    """Predictions, hours and evaluated origins as bucketed tables."""
    seg = segments(spark, d)
    evals = kept(spark, E.time_split(S.window_origins(seg)).where("split <> 'train'"))
    names = []
    for what, df, order in zip(("pred", "hours", "origins"), E.laid_out(E.predict_baselines(seg), seg, evals), (("origin_ts",), ("ts",), ("origin_ts",))):
        path = T.scratch(spark)
        names.append(f"{what}_{path[-32:]}")
        T.write_bucketed(df, names[-1], path, buckets, LAYOUT, order)
    return T.read_bucketed(spark, *names)


@query("a6_bucketed_layout", """SELECT p.model, count(*) AS n, count(p.y) AS matched FROM pred p JOIN evals e ON p.series_id = e.series_id AND p.origin_ts = e.origin_ts
    WHERE hour(p.origin_ts) < 20 GROUP BY 1""")
def _(spark, d):
    pred, hours, evals = stored_layout(spark, d)
    pred = pred.where((F.col("model") != "persistence") | (F.hour("origin_ts") < 20))
    rows = E.restrict_to(E.restrict_to(pred, evals, LAYOUT), E.common_origins(pred, 3, LAYOUT), LAYOUT)
    rows = E.attach_truth(rows, hours, LAYOUT)
    return rows.groupBy("model").agg(F.count("*").alias("n"), F.count_if(F.col("truth") == F.col("y")).alias("matched"))


@query("a1_quarantine", """SELECT 'readings' AS kind, count(*) AS n, sum(coalesce(v, 0)) AS total FROM readings WHERE minute(ts) <> 7
    UNION ALL SELECT 'quarantine', count(*), NULL FROM readings WHERE minute(ts) = 7""")
def _(spark, d):
    path = T.scratch(spark)  # planted: each hour's minute 7 is a broken line, one of four kinds
    rows = minutes(spark, d).select(F.date_format("ts", "d/M/yyyy").alias("Date"), F.date_format("ts", "H:mm:ss").alias("Time"), F.col("v").cast("string").alias("v"), F.minute("ts").alias("m"), F.hour("ts").alias("h"))
    whole = F.concat_ws(";", "Date", "Time", "v")
    broken = F.element_at(F.array(F.concat_ws(";", "Date", "Time"), F.concat(whole, F.lit(";9;9")), F.concat_ws(";", "Date", "Time", F.lit("abc")), F.lit("garbage")), F.col("h") % 4 + 1)
    rows.select(F.when(F.col("m") == 7, broken).otherwise(whole).alias("Date;Time;v")).write.option("header", True).option("quote", "\u0000").csv(path, sep="\u0001")
    good, bad = T.read_rescued(spark, path, ["v"])
    return good.agg(F.lit("readings").alias("kind"), F.count("*").alias("n"), F.sum("v").alias("total")).union(bad.agg(F.lit("quarantine"), F.count("*"), F.lit(None).cast("double")))


@query("a7_run_summary", "SELECT model, n FROM pooled")
def _(spark, d):
    path = T.scratch(spark)
    T.append_run_summary(E.metrics_pooled(predictions(spark, d)), path)
    return spark.read.schema("model string, n long").json(path)


# --- B: projections and predicates


@query("b1_calendar", "SELECT event_id, hour(ts) AS hour, isodow(ts) - 1 AS dow, CAST(isodow(ts) >= 6 AS BIGINT) AS is_weekend FROM events")
def _(spark, d):
    return C.calendar_features(table(spark, d, "events")).select("event_id", "hour", "dow", "is_weekend")


@query("b2_power_factor", """SELECT l_orderkey, l_linenumber, l_discount / sqrt(l_discount * l_discount + l_tax * l_tax) AS pf FROM lineitem WHERE l_discount > 0.01""")
def _(spark, d):
    rows = C.power_factor(table(spark, d, "lineitem"), "l_discount", "l_tax")
    return rows.select("l_orderkey", "l_linenumber", "pf")


@query("b3_units", "SELECT series_id, sum(v) / 60 AS kwh, avg(v) * 60 * 24 / 1000 AS wh_day, avg(v) * 24 AS kw_day FROM readings GROUP BY 1")
def _(spark, d):
    v = F.avg("v")
    return plain(minutes(spark, d).groupBy("series_id").agg(C.kwh_of_minutes(F.sum("v")).alias("kwh"), C.kwh_per_day_of_wh(v).alias("wh_day"), C.kwh_per_day_of_kw(v).alias("kw_day")))


@query("b4_mask_agreement", """SELECT count(*) AS n_rows, CAST(count(*) FILTER ((kw IS NULL) <> (kwh IS NULL) OR (kw IS NULL) <> (impute_flag IS NULL)) AS BIGINT) AS n_disagree,
    count(*) FILTER ((kw IS NULL) <> (kwh IS NULL) OR (kw IS NULL) <> (impute_flag IS NULL)) = 0 AS ok FROM hourly""")
def _(spark, d):
    return P.check_mask_agreement(hourly(spark, d), ["kw", "kwh", "impute_flag"])


@query("b5_date_range", "SELECT event_id, ts FROM events WHERE ts BETWEEN (SELECT date_trunc('day', min(ts)) + INTERVAL 1 DAY FROM events) AND (SELECT date_trunc('day', min(ts)) + INTERVAL 4 DAY FROM events)")
def _(spark, d):
    e = table(spark, d, "events")
    lo = e.agg(C.floor_day(F.min("ts")).alias("lo")).first().lo
    return e.limit(0).select("event_id", "ts") if lo is None else E.date_range(e, lo + timedelta(hours=24), lo + timedelta(hours=96)).select("event_id", "ts")


# --- C: joins


@query("c1_dense_spine", "SELECT series_id, ts FROM spine")
def _(spark, d):
    return S.dense_spine(S.impute(minutes(spark, d)))


@query("c2_assign_interval", """SELECT h.series_id, h.ts, s.segment_id FROM hourly h LEFT JOIN stats s ON h.series_id = s.series_id AND h.ts BETWEEN s.start AND s."end" """)
def _(spark, d):
    h = hourly(spark, d)
    return E.assign_interval(h.select("series_id", "ts"), S.segment_stats(S.assign_segments(h)))


@query("c3_attach_truth", "SELECT model, count(*) AS n, count(y) AS matched FROM pred GROUP BY 1")
def _(spark, d):
    h = hourly(spark, d)
    rows = E.attach_truth(E.predict_baselines(kept(spark, S.assign_segments(h))), h)
    return rows.groupBy("model").agg(F.count("*").alias("n"), F.count_if(F.col("truth") == F.col("y")).alias("matched"))


@query("c4_restrict_to", """SELECT p.model, count(*) AS n FROM pred p JOIN evals e ON p.series_id = e.series_id AND p.origin_ts = e.origin_ts GROUP BY 1""")
def _(spark, d):
    pred, s = predictions_and_split(spark, d)
    return E.restrict_to(pred, s.where("split <> 'train'")).groupBy("model").agg(F.count("*").alias("n"))


_TAUGHT = "FROM (SELECT DISTINCT series_id, block, block_start FROM blocks) b LEFT JOIN origins o ON o.series_id = b.series_id AND o.origin_ts < b.block_start - INTERVAL 24 HOUR"


def block_starts(s: DataFrame, hours: int = 168) -> DataFrame:
    return E.rolling_blocks(s.where("split <> 'train'"), hours=hours).select("series_id", "block", "block_start").distinct()


@query("c5_train_before_block", """SELECT b.series_id, b.block, count(o.origin_ts) AS n_train FROM (SELECT DISTINCT series_id, block, block_start FROM dayblocks) b
    LEFT JOIN origins o ON o.series_id = b.series_id AND o.origin_ts < b.block_start - INTERVAL 24 HOUR GROUP BY 1, 2""")
def _(spark, d):
    s = split(spark, d)
    return E.train_states(s, block_starts(s, hours=24))


@query("c5_block_scaler", f"""SELECT b.series_id, b.block, count(o.origin_ts) AS n_train, avg(h.kw) AS kw_mean, stddev_samp(h.kw) AS kw_std {_TAUGHT}
    LEFT JOIN segs h ON h.series_id = o.series_id AND h.ts = o.origin_ts GROUP BY 1, 2""")
def _(spark, d):
    rows, s = _with_load(spark, d)
    return E.train_states(rows, block_starts(s), ("kw",))


@query("h6_scaled_blocks", f"""SELECT r.series_id, r.origin_ts, r.block, (h.kw - t.m) / nullif(t.s, 0) AS kw FROM blocks r JOIN segs h ON h.series_id = r.series_id AND h.ts = r.origin_ts
    JOIN (SELECT b.series_id, b.block, avg(h.kw) AS m, stddev_samp(h.kw) AS s {_TAUGHT} LEFT JOIN segs h ON h.series_id = o.series_id AND h.ts = o.origin_ts GROUP BY 1, 2) t
    ON t.series_id = r.series_id AND t.block = r.block""")
def _(spark, d):
    rows, s = _with_load(spark, d)
    states = E.train_states(rows, block_starts(s), ("kw",))
    blocks = E.rolling_blocks(s.where("split <> 'train'")).select("series_id", "origin_ts", "block")
    return E.apply_states(rows.join(blocks, ["series_id", "origin_ts"]).select("series_id", "origin_ts", "block", "kw"), states, ("kw",))


def _with_load(spark, d):
    """The origins with their own hour's load, and their split."""
    seg = segments(spark, d)
    s = kept(spark, E.time_split(S.window_origins(seg)))
    rows = s.select("series_id", "origin_ts").join(seg.select("series_id", F.col("ts").alias("origin_ts"), "kw"), ["series_id", "origin_ts"])
    return kept(spark, rows), s


@query("c6_delta_vs", f"SELECT p.model, p.mae, p.mae - b.mae AS delta_mae FROM pooled p, pooled b WHERE b.model = 'persistence'")
def _(spark, d):
    return plain(E.delta_vs(E.metrics_pooled(predictions(spark, d)), "persistence"))


RECONCILED = ["mae", "rmse", "smape", "r2", "mae_horizon_mean"]


@query("c7_reconcile", f"""SELECT model, metric, abs(a - b) / greatest(abs(a), 1e-12) < 1e-6 AS ok FROM (SELECT p.model, unnest({RECONCILED}) AS metric,
    unnest([p.mae, p.rmse, p.smape, p.r2, m.hm]) AS a, unnest([o.mae, o.rmse, o.smape, o.r2, n.hm]) AS b
    FROM pooled p JOIN off_pooled o ON o.model = p.model JOIN own_mean m ON m.model = p.model JOIN off_mean n ON n.model = p.model)""")
def _(spark, d):
    pred = predictions(spark, d)
    off = F.when((F.col("model") == "persistence") & (F.hour("origin_ts") == 5), 0.5).otherwise(0.0)  # a planted fault of one model
    mean = E.metrics_horizon_mean(pred).select("model", F.col("mae").alias("mae_horizon_mean"))
    other = spark.sql("""SELECT p.*, h.mae_horizon_mean FROM (SELECT model, avg(abs(y_hat - y)) AS mae, sqrt(avg(power(y_hat - y, 2))) AS rmse, avg(CASE WHEN abs(y) + abs(y_hat) > 1e-8
        THEN 2 * abs(y_hat - y) / (abs(y) + abs(y_hat)) END) AS smape, 1 - try_divide(sum(power(y_hat - y, 2)), sum(y * y) - sum(y) * sum(y) / count(y)) AS r2 FROM {pred} GROUP BY model) p
        JOIN (SELECT model, avg(mae) AS mae_horizon_mean FROM (SELECT model, horizon, avg(abs(y_hat - y)) AS mae FROM {pred} GROUP BY model, horizon) GROUP BY model) h ON p.model = h.model""",
        pred=pred.withColumn("y_hat", F.col("y_hat") + off))
    return E.reconcile(E.metrics_pooled(pred).join(mean, "model"), other, ["model"], RECONCILED).select("model", "metric", "ok")


# --- D: aggregations

LI = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_LONG = " UNION ALL ".join(f"SELECT '{c}' AS col, {c} AS value FROM lineitem" for c in LI)


@query("d1_profile_columns", f"""SELECT col, count(*) - count(value) AS missing, (count(*) - count(value)) / count(*) AS missing_rate, count(DISTINCT value) AS n_distinct,
    count(*) FILTER (value = 0) AS zeros, count(*) FILTER (value = 0) / count(*) AS zero_rate, avg(value) AS mean, median(value) AS median,
    max(value) AS max FROM ({_LONG}) GROUP BY 1""")
def _(spark, d):
    return plain(P.profile_columns(table(spark, d, "lineitem"), LI))


@query("d2_quantiles", f"""SELECT col, unnest([0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99])::DOUBLE AS q,
    unnest(quantile_cont(value, [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99])) AS value FROM ({_LONG}) GROUP BY col""")
def _(spark, d):
    return plain(P.profile_quantiles(table(spark, d, "lineitem"), LI))


@query("d3_top_values", f"""SELECT col, rank, value, n FROM (SELECT *, row_number() OVER (PARTITION BY col ORDER BY n DESC, value) AS rank FROM
    (SELECT col, value, count(*) AS n FROM ({_LONG}) WHERE value IS NOT NULL GROUP BY 1, 2)) WHERE rank <= 3""")
def _(spark, d):
    return plain(P.top_values(table(spark, d, "lineitem"), LI))


@query("d3_frequent_values", SQL["d3_top_values"])
def _(spark, d):
    return plain(K.top_values(table(spark, d, "lineitem"), LI))


@query("d2_sketched_quantiles", "SELECT series_id, unnest([0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99])::DOUBLE AS q, count(*) AS n, true AS within FROM readings WHERE ts >= (SELECT date_trunc('day', min(ts)) + INTERVAL 2 DAY FROM readings) GROUP BY series_id")
def _(spark, d):
    """Quantiles of all but the first two days from stored sketches of days, and whether their true ranks are within 1.5 percent."""
    rows, path = kept(spark, minutes(spark, d)), T.scratch(spark)
    K.save_sketches(K.day_sketches(rows), path)
    start = rows.agg(F.to_timestamp_ntz(F.date_add(F.min("ts"), 2)).alias("t")).first().t
    found = kept(spark, K.sketched_quantiles(K.merged(K.load_sketches(spark, path, start))))
    true = rows.where(F.col("ts") >= F.lit(start)).select("series_id", "v").join(F.broadcast(found), "series_id").groupBy("series_id", "q", "n").agg(
        F.count_if(F.col("v") < F.col("value")).alias("below"), F.count_if(F.col("v") <= F.col("value")).alias("upto")
    )
    slack = 0.015 * F.col("n") + 1
    return true.select("series_id", "q", "n", ((F.col("below") - slack <= F.col("q") * F.col("n")) & (F.col("q") * F.col("n") <= F.col("upto") + slack)).alias("within"))


@query("d1_sketched_distinct", "SELECT event_type AS series_id, count(user_id) AS n, min(user_id)::DOUBLE AS low, max(user_id)::DOUBLE AS high, true AS within FROM events GROUP BY 1")
def _(spark, d):
    e, path = table(spark, d, "events").select(F.col("event_type").alias("series_id"), "ts", "user_id"), T.scratch(spark)
    K.save_sketches(K.day_sketches(e, "user_id"), path)
    found = K.sketched_distinct(K.merged(K.load_sketches(spark, path)))
    true = e.groupBy("series_id").agg(F.count_distinct("user_id").alias("d"))
    return found.join(true, "series_id").select("series_id", "n", "low", "high", (F.abs(F.col("n_distinct") - F.col("d")) <= 0.05 * F.col("d") + 1).alias("within"))


@query("d4_profile_time", """SELECT series_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n_rows, count(*) - count(DISTINCT ts) AS n_dup, count(*) FILTER (bad) = 0 AS increasing,
    date_diff('minute', min(ts), max(ts)) + 1 AS expected, date_diff('minute', min(ts), max(ts)) + 1 - count(DISTINCT ts) AS absent
    FROM (SELECT series_id, ts, ts <= lag(ts) OVER (PARTITION BY series_id ORDER BY event_id) AS bad FROM
    (SELECT event_type AS series_id, event_id, date_trunc('minute', ts) AS ts FROM events)) GROUP BY 1""")
def _(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("series_id"), "event_id", C.trunc("MINUTE", "ts").alias("ts"))
    return P.profile_time(e, "event_id")


@query("d5_gap_buckets", """SELECT g.series_id, bucket, count(*) AS n, sum(length) / any_value(total) AS share FROM (SELECT *, CASE WHEN length >= 1440 THEN '24h+'
    WHEN length >= 120 THEN '2-24h' WHEN length >= 60 THEN '1-2h' END AS bucket FROM ugaps) g JOIN (SELECT series_id, sum(length) AS total FROM ugaps GROUP BY 1) t
    ON g.series_id = t.series_id WHERE bucket IS NOT NULL GROUP BY 1, 2""")
def _(spark, d):
    return plain(P.gap_buckets(S.gaps(minutes(spark, d, "user_id"))))


@query("d5_gap_summary", """SELECT g.series_id, count(*) AS n, max(length) AS longest, min(length) AS shortest, count(*) FILTER (length > 1440) AS n_over_day,
    coalesce(sum(length) FILTER (length > 1440), 0) / sum(length) AS share_over_day, sum(length) / any_value(span) AS share_of_span
    FROM ugaps g JOIN (SELECT series_id, date_diff('minute', min(ts), max(ts)) + 1 AS span FROM users GROUP BY 1) s ON s.series_id = g.series_id GROUP BY 1""")
def _(spark, d):
    rows = minutes(spark, d, "user_id")
    spans = rows.groupBy("series_id").agg((C.minutes_between(F.min("ts"), F.max("ts")) + 1).alias("span"))
    return plain(P.gap_summary(S.gaps(rows), spans))


@query("d6_long_gaps", "SELECT series_id, ts, length / 60 AS hours FROM ugaps WHERE length > 1440")
def _(spark, d):
    return P.long_gaps(S.gaps(minutes(spark, d, "user_id")))


_BINS = " ".join(f"WHEN length > {a * 60} AND length <= {b * 60} THEN '({a},{b}]'" for a, b in zip(P.HOUR_BINS[:-1], P.HOUR_BINS[1:]))


@query("d6_gap_histogram", f"SELECT bin, count(*) AS n FROM (SELECT CASE {_BINS} END AS bin FROM ugaps) WHERE bin IS NOT NULL GROUP BY 1")
def _(spark, d):
    return P.gap_histogram(S.gaps(minutes(spark, d, "user_id")))


@query("d7_resample_hourly", f"SELECT series_id, ts, kw, kwh, CAST(impute_flag AS BIGINT) AS impute_flag, n_valid_min FROM hourly")
def _(spark, d):
    return plain(S.resample_hourly(S.impute(minutes(spark, d))))


@query("d7_streamed_hours", "SELECT series_id, ts, kw, kwh, CAST(impute_flag AS BIGINT) AS impute_flag, n_valid_min FROM hourly WHERE n_valid_min > 0")
def _(spark, d):
    """The minutes of each ten days come as a file, and hours are rolled up as they come."""
    m, source, out = kept(spark, S.impute(minutes(spark, d)).withColumn("impute_flag", F.col("impute_flag").cast("int"))), T.scratch(spark), T.scratch(spark)
    part = F.floor((F.dayofmonth("ts") - 1) / 10)
    for r in m.select(F.year("ts").alias("y"), F.month("ts").alias("m"), part.alias("p")).distinct().orderBy("y", "m", "p").collect():  # a row for each ten days
        m.where((F.year("ts") == r.y) & (F.month("ts") == r.m) & (part == r.p)).coalesce(1).write.mode("append").parquet(source)
    R.write_hours(R.hours(R.read_minutes(spark, source)), f"{out}/hours", f"{out}/checkpoint")
    return plain(R.latest_hours(spark, f"{out}/hours"))


@query("d8_resample_daily", f"SELECT series_id, ts, kw FROM daily")
def _(spark, d):
    return plain(S.resample_daily(hourly(spark, d)))


@query("d9_hour_profile", """SELECT hour(ts) AS hour, avg(kw) AS all_days, avg(kw) FILTER (isodow(ts) < 6) AS weekday,
    avg(kw) FILTER (isodow(ts) >= 6) AS weekend FROM hourly GROUP BY 1""")
def _(spark, d):
    return plain(P.hour_profile(hourly(spark, d)))


@query("d10_year_profile", "SELECT year(o_orderdate) AS year, avg(o_totalprice) AS mean, median(o_totalprice) AS median FROM orders GROUP BY 1")
def _(spark, d):
    return plain(P.year_profile(table(spark, d, "orders"), "o_totalprice", "o_orderdate"))


_PF = "(SELECT l_discount / sqrt(l_discount * l_discount + l_tax * l_tax) AS pf FROM lineitem WHERE l_discount > 0.01)"


@query("d11_power_factor_stats", f"""SELECT quantile_cont(pf, 0.5) AS p50, quantile_cont(pf, 0.001) AS p0_1, quantile_cont(pf, 0.01) AS p1,
    quantile_cont(pf, 0.99) AS p99, avg(CAST(pf < 0.9 AS DOUBLE)) AS share_low, count(*) AS n FROM {_PF}""")
def _(spark, d):
    return plain(P.power_factor_stats(C.power_factor(table(spark, d, "lineitem"), "l_discount", "l_tax")))


_HIGH = "(SELECT l_discount / sqrt(l_discount * l_discount + l_tax * l_tax) AS pf FROM lineitem WHERE l_discount > 0.05)"


@query("d11_power_factor_high", f"""SELECT quantile_cont(pf, 0.5) AS p50, avg(CAST(pf < 0.9 AS DOUBLE)) AS share_low, count(*) AS n, count(*) / (SELECT count(*) FROM lineitem) AS share_of_all FROM {_HIGH}""")
def _(spark, d):
    li = table(spark, d, "lineitem")
    return P.power_factor_stats(C.power_factor(li, "l_discount", "l_tax", 0.05), (0.5,), li)


@query("d11_power_factor_hist", f"""SELECT bin, count(*) AS n FROM (SELECT CASE WHEN pf = 1 THEN 80 WHEN pf >= 0.85 AND pf < 1 THEN CAST(floor((pf - 0.85) / ((1.0::DOUBLE - 0.85::DOUBLE) / 80)) AS BIGINT) + 1 END AS bin
    FROM {_PF}) WHERE bin IS NOT NULL GROUP BY 1""")
def _(spark, d):
    return P.power_factor_hist(C.power_factor(table(spark, d, "lineitem"), "l_discount", "l_tax"))


@query("d12_submeter_share", """SELECT col, round(avg(value) * 60 * 24 / 1000, 3) AS kwh_day, round(avg(value) * 60 * 24 / 1000, 3) / (SELECT avg(l_quantity) * 24 FROM lineitem) AS share
    FROM (SELECT 'l_tax' AS col, l_tax AS value FROM lineitem UNION ALL SELECT 'l_discount', l_discount FROM lineitem) GROUP BY 1""")
def _(spark, d):
    li = table(spark, d, "lineitem")
    return plain(P.submeter_share(li, li.agg(F.avg("l_quantity").alias("mean_kw")), ["l_tax", "l_discount"]))


@query("d13_segment_stats", """SELECT series_id, segment_id, start, "end", length_hours, n_windows, n_windows / nullif(sum(n_windows) OVER (PARTITION BY series_id), 0) AS window_share FROM stats""")
def _(spark, d):
    return plain(S.segment_stats(segments(spark, d)))


SCORES = "mae, rmse, smape, r2"


@query("d14_metrics_pooled", f"SELECT model, n, {SCORES} FROM pooled")
def _(spark, d):
    return plain(E.metrics_pooled(predictions(spark, d)))


@query("d15_metrics_by_horizon", f"SELECT model, horizon, n, {SCORES} FROM byh")
def _(spark, d):
    return plain(E.metrics_by_horizon(predictions(spark, d)))


@query("d15_horizon_mean", "SELECT model, avg(mae) AS mae, avg(rmse) AS rmse, avg(smape) AS smape, avg(r2) AS r2 FROM byh GROUP BY 1")
def _(spark, d):
    return plain(E.metrics_horizon_mean(predictions(spark, d)))


_SLICES = """SELECT model, abs(y_hat - y) AS e, y, origin_ts, origin_ts + to_hours(CAST(horizon AS INTEGER)) AS t FROM pred"""
_SLICE = "count(*) AS n, avg(e) AS mae, avg(y) AS mean_y, avg(e) / avg(y) AS nmae"


@query("d16_error_attribution", f"""SELECT model, 'overall' AS dimension, 'all' AS slice, {_SLICE} FROM ({_SLICES}) GROUP BY model
    UNION ALL SELECT model, 'time_of_day', CASE WHEN hour(t) <= 6 THEN 'night' WHEN hour(t) <= 17 THEN 'day' ELSE 'evening' END AS s, {_SLICE} FROM ({_SLICES}) GROUP BY model, s
    UNION ALL SELECT model, 'kind_of_day', CASE WHEN isodow(t) >= 6 THEN 'weekend' ELSE 'weekday' END AS s, {_SLICE} FROM ({_SLICES}) GROUP BY model, s
    UNION ALL SELECT model, 'quarter', 'Q' || quarter(origin_ts) AS s, {_SLICE} FROM ({_SLICES}) GROUP BY model, s""")
def _(spark, d):
    return plain(E.error_attribution(predictions(spark, d)))


@query("d17_granularity_bridge", """SELECT model, count(*) AS daily_n_days, avg(abs(p - y)) AS daily_mae, 1 - sum((p - y) * (p - y)) / (var_pop(y) * count(y)) AS daily_r2
    FROM (SELECT model, series_id, origin_ts, avg(y) AS y, avg(y_hat) AS p FROM pred WHERE hour(origin_ts) = 23 GROUP BY 1, 2, 3) GROUP BY 1""")
def _(spark, d):
    return plain(E.granularity_bridge(predictions(spark, d)))


_VAR = "(SELECT s.split, var_pop(y) AS variance, count(*) AS n FROM split s JOIN truth t ON s.series_id = t.series_id AND s.origin_ts = t.origin_ts GROUP BY 1)"


@query("d18_target_variance", f"SELECT v.split, v.n, v.variance AS variance, v.variance / b.variance AS ratio_to_val FROM {_VAR} v, (SELECT variance FROM {_VAR} WHERE split = 'val') b")
def _(spark, d):
    return plain(E.target_variance(_split_targets(spark, d)))


def _split_targets(spark, d):
    """Each target of each origin once, with its split."""
    pred, s = predictions_and_split(spark, d)
    return pred.where("model = 'persistence'").join(s.select("series_id", "origin_ts", "split"), ["series_id", "origin_ts"])


@query("d18_variance_by_period", """SELECT s.split, CAST(floor((day(s.origin_ts) - 1) / 10.0) AS BIGINT) AS period, count(*) AS n, var_pop(y) AS variance,
    var_pop(y) / (SELECT var_pop(t.y) FROM split v JOIN truth t ON v.series_id = t.series_id AND v.origin_ts = t.origin_ts WHERE v.split = 'val') AS ratio_to_val
    FROM split s JOIN truth t ON s.series_id = t.series_id AND s.origin_ts = t.origin_ts GROUP BY 1, 2""")
def _(spark, d):
    return E.target_variance(_split_targets(spark, d), F.floor((F.dayofmonth("origin_ts") - 1) / 10).cast("long"))


@query("d19_coverage", """SELECT series_id, segment_id, CAST(sum(n) AS BIGINT) AS origins, CAST(sum(c) AS BIGINT) AS covered, CAST(sum(n - c) AS BIGINT) AS skipped, count(*) AS blocks,
    count(*) FILTER (c = 0) AS skipped_blocks FROM (SELECT series_id, segment_id, block, count(*) AS n, count(*) FILTER (hour(origin_ts) < 12) AS c FROM blocks GROUP BY 1, 2, 3) GROUP BY 1, 2""")
def _(spark, d):
    s = split(spark, d).where("split <> 'train'")
    return E.coverage_report(E.rolling_blocks(s), s.where(F.hour("origin_ts") < 12))


@query("d20_cv_summary", """SELECT model, count(*) AS folds, avg(mae) AS mean_mae, stddev_pop(mae) AS std_mae FROM (SELECT model, fold, avg(abs(y_hat - y)) AS mae
    FROM pred p JOIN folds f ON p.series_id = f.series_id AND p.origin_ts = f.origin_ts GROUP BY 1, 2) GROUP BY 1""")
def _(spark, d):
    pred, s = predictions_and_split(spark, d)
    folds = cv_folds(s).select("series_id", "origin_ts", "fold")
    return E.cv_summary(E.metrics_pooled(pred.join(folds, ["series_id", "origin_ts"]), ("model", "fold")))


def _off_hourly(m: DataFrame) -> DataFrame:
    """The hours of these minutes with planted faults in their energy."""
    off = F.when(F.col("series_id") == "click", 1.01).when(F.hour("ts") == 5, 1.002).otherwise(1.0)
    return S.resample_hourly(m).withColumn("kwh", F.col("kwh") * off)


@query("d22_energy", """SELECT h.series_id, sum(m.e) AS minute_kwh, sum(h.kwh) AS hour_kwh, abs(sum(m.e) - sum(h.kwh)) / sum(m.e) AS deviation,
    abs(sum(m.e) - sum(h.kwh)) / sum(m.e) <= 0.005 AS ok FROM off_hourly h JOIN energy m ON h.series_id = m.series_id AND h.ts = m.ts GROUP BY 1""")
def _(spark, d):
    m = S.impute(minutes(spark, d))
    return P.energy_conservation(m, _off_hourly(m))


_MINUTES, _HOURS, _SEGS = "(SELECT count(*) FROM minute)", "(SELECT count(*) FROM off_hours)", "(SELECT count(*) FROM stats)"
_MEANS = "(kw + b1 + b2) / 3", "(kw + t1 + t2) / 3"
#: What each check counts, and of how many.
CHECK_SQL = {
    "rows_kept": ("abs((SELECT count(*) FROM readings) - (SELECT count(*) FROM off_minute WHERE impute_flag = 0))", _MINUTES),
    "minute_keys_unique": ("(SELECT coalesce(sum(c - 1), 0) FROM (SELECT count(*) AS c FROM off_minute GROUP BY series_id, ts))", _MINUTES),
    "times_match_raw": ("(SELECT count(*) FROM readings r LEFT JOIN off_minute m ON m.series_id = r.series_id AND m.ts = r.ts AND m.impute_flag = 0 WHERE m.ts IS NULL)", _MINUTES),
    "gap_classes_filled": ("""abs((SELECT count(*) FROM off_minute WHERE impute_flag = 1) - (SELECT coalesce(sum(length), 0) FROM gaps WHERE length <= 119))
        + abs((SELECT count(*) FROM off_minute WHERE impute_flag = 2) - (SELECT coalesce(sum(length), 0) FROM gaps WHERE length > 119 AND length <= 1440))""", _MINUTES),
    "long_gaps_empty": ("(SELECT count(*) FROM traced WHERE NOT is_raw AND length IS NULL)", _MINUTES),
    "short_fills_between": ("(SELECT count(*) FROM traced WHERE impute_flag = 1 AND NOT coalesce(v BETWEEN least(lo, hi) - 1e-6 AND greatest(lo, hi) + 1e-6, false))", _MINUTES),
    "mid_fills_constant": ("(SELECT count(*) FROM traced WHERE impute_flag = 2 AND NOT coalesce(abs(v - lo) <= 1e-6, false))", _MINUTES),
    "flags_match": ("(SELECT count(*) FROM traced WHERE impute_flag <> CASE WHEN is_raw THEN 0 WHEN length <= 119 THEN 1 ELSE 2 END)", _MINUTES),
    "full_hours_valid": ("(SELECT count(*) FROM held WHERE n_valid_min <> m_n OR (kw IS NOT NULL) <> (m_n = 60))", _HOURS),
    "kw_is_mean": ("(SELECT count(*) FROM held WHERE kw IS NOT NULL AND NOT coalesce(abs(kw - m_kw) <= 1e-3, false))", _HOURS),
    "kwh_is_sum": ("(SELECT count(*) FROM held WHERE kw IS NOT NULL AND NOT coalesce(abs(kwh - m_kwh) <= 1e-3, false))", _HOURS),
    "energy_conserved": ("(SELECT CAST(coalesce(abs(sum(m_kwh) - sum(kwh)) > 0.005 * sum(m_kwh), false) AS BIGINT) FROM held WHERE kwh IS NOT NULL)", _HOURS),
    "lags_match": (f"(SELECT count(*) FROM lagged WHERE b1 IS DISTINCT FROM t1 OR NOT coalesce(abs({_MEANS[0]} - {_MEANS[1]}) <= 1e-6, {_MEANS[0]} IS NOT DISTINCT FROM {_MEANS[1]}))", _HOURS),
    "segments_match": ("(SELECT count(*) FROM counted WHERE hours <> length_hours OR n_windows <> greatest(0, hours - 191))", _SEGS),
    "enough_windows": ("(SELECT CAST(coalesce(sum(n_windows), 0) < 30000 AS BIGINT) FROM stats)", _SEGS),
}


@query("d23_invariants", """SELECT "check", n_bad = 0 AS ok, n_bad, n, CAST(n_bad AS VARCHAR) || ' of ' || CAST(n AS VARCHAR) AS detail FROM ("""
       + " UNION ALL ".join(f"""SELECT '{k}' AS "check", CAST({bad} AS BIGINT) AS n_bad, {n} AS n""" for k, (bad, n) in CHECK_SQL.items()) + ")")
def _(spark, d):
    raw = minutes(spark, d)
    m = kept(spark, S.impute(raw))
    h = kept(spark, S.resample_hourly(m))
    minute, hour = F.minute("ts"), F.hour("ts")
    off_m = m.withColumn("v", F.when((F.col("impute_flag") == 1) & (minute == 7), F.col("v") + 100).otherwise(F.col("v"))).where(~((F.col("impute_flag") == 0) & (minute == 3) & (hour == 4)))
    off_h = h.withColumn("kw", F.when(hour == 5, F.col("kw") * 2).otherwise(F.col("kw"))).where(~((hour == 9) & (F.dayofmonth("ts") == 3)))
    return E.run_invariants(raw, off_m, off_h, S.segment_stats(S.assign_segments(h)))


# --- E: windows


@query("e1_null_runs", """SELECT series_id, min(ts) AS start, max(ts) AS "end", count(*) AS length FROM (SELECT series_id, ts, kw, row_number() OVER (PARTITION BY series_id ORDER BY ts)
    - row_number() OVER (PARTITION BY series_id, kw IS NULL ORDER BY ts) AS g FROM hourly) WHERE kw IS NULL GROUP BY series_id, g""")
def _(spark, d):
    return S.null_runs(hourly(spark, d), "kw")


@query("e2_absent_runs", "SELECT series_id, ts, next_ts, length AS missing FROM gaps")
def _(spark, d):
    return S.absent_runs(minutes(spark, d))


@query("e3_classify_gaps", """SELECT series_id, CASE WHEN length <= 119 THEN 'short' WHEN length <= 1440 THEN 'mid' ELSE 'long' END AS class, count(*) AS n_gaps, CAST(sum(length) AS BIGINT) AS minutes
    FROM ugaps GROUP BY 1, 2""")
def _(spark, d):
    return S.classify_gaps(S.gaps(minutes(spark, d, "user_id")))


@query("e4_interpolate_short", "SELECT series_id, ts + to_minutes(CAST(i AS INTEGER)) AS ts, lo + (hi - lo) * i / (length + 1) AS v, CAST(1 AS BIGINT) AS impute_flag FROM fills WHERE length <= 119")
def _(spark, d):
    return plain(S.interpolate_short(minutes(spark, d)))


@query("e5_ffill_mid", "SELECT series_id, ts + to_minutes(CAST(i AS INTEGER)) AS ts, lo AS v, CAST(2 AS BIGINT) AS impute_flag FROM fills WHERE length > 119")
def _(spark, d):
    return plain(S.ffill_mid(minutes(spark, d)))


@query("e6_impute", "SELECT series_id, ts, v AS v, CAST(impute_flag AS BIGINT) AS impute_flag FROM minute")
def _(spark, d):
    return plain(S.impute(minutes(spark, d)))


@query("e7_segments", f"SELECT series_id, ts, segment_id, kw FROM segs")
def _(spark, d):
    return plain(segments(spark, d).select("series_id", "ts", "segment_id", "kw"))


@query("e8_window_origins", "SELECT * FROM origins")
def _(spark, d):
    return origins(spark, d)


@query("e9_lag_features", "SELECT series_id, segment_id, ts AS origin_ts, " + ", ".join(
    f"lag(kw, {k - 1}) OVER w AS lag_{k}h" for k in S.LAGS) + " FROM segs WINDOW w AS (PARTITION BY series_id, segment_id ORDER BY ts)")
def _(spark, d):
    return plain(S.lag_features(segments(spark, d)))


_W = "OVER (PARTITION BY series_id, segment_id ORDER BY ts ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"


@query("e10_rolling_features", f"""SELECT series_id, segment_id, ts AS origin_ts, CASE WHEN count(*) {_W.format(23)} = 24 THEN avg(kw) {_W.format(23)} END AS roll_mean_24h,
    CASE WHEN count(*) {_W.format(23)} = 24 THEN stddev_samp(kw) {_W.format(23)} END AS roll_std_24h,
    CASE WHEN count(*) {_W.format(167)} = 168 THEN avg(kw) {_W.format(167)} END AS roll_mean_168h FROM segs""")
def _(spark, d):
    return plain(S.rolling_features(segments(spark, d)))


@query("e11_targets", "SELECT series_id, origin_ts, horizon, y AS y FROM truth")
def _(spark, d):
    rows = S.build_targets(segments(spark, d)).select("series_id", "origin_ts", F.posexplode("y").alias("h", "y"))
    return plain(rows.select("series_id", "origin_ts", (F.col("h") + 1).cast("long").alias("horizon"), "y"))


@query("e12_rolling_daily", """SELECT series_id, ts, kw AS kw, CASE WHEN count(kw) OVER w >= 15 THEN avg(kw) OVER w END AS roll FROM daily
    WINDOW w AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)""")
def _(spark, d):
    return plain(S.rolling_daily(S.resample_daily(hourly(spark, d))))


@query("e13_rank_models", "SELECT horizon, model, rank() OVER (PARTITION BY horizon ORDER BY round(mae, 9)) AS rank FROM byh")
def _(spark, d):
    return E.rank_models(E.metrics_by_horizon(predictions(spark, d)), "horizon").select("horizon", "model", "rank")


@query("e13_rank_flips", """SELECT a.model, a.rank AS rank_a, b.rank AS rank_b, a.rank <> b.rank AS flip FROM (SELECT model, rank() OVER (ORDER BY round(mae, 9)) AS rank FROM byh WHERE horizon = 1) a
    JOIN (SELECT model, rank() OVER (ORDER BY round(mae, 9)) AS rank FROM byh WHERE horizon = 24) b ON a.model = b.model""")
def _(spark, d):
    r = E.rank_models(E.metrics_by_horizon(predictions(spark, d)), "horizon")
    return E.rank_flips(r.where("horizon = 1"), r.where("horizon = 24"))


@query("e14_horizon_growth", "SELECT model, max(mae) FILTER (horizon = 24) / max(mae) FILTER (horizon = 1) - 1 AS growth FROM byh GROUP BY 1")
def _(spark, d):
    return plain(E.horizon_growth(E.metrics_by_horizon(predictions(spark, d))))


# --- F, G: order and sets


@query("f1_leaderboard", "SELECT model, n, round(mae, 4) AS mae, round(rmse, 4) AS rmse, round(smape, 4) AS smape, round(r2, 4) AS r2 FROM pooled")
def _(spark, d):
    return plain(E.leaderboard(E.metrics_pooled(predictions(spark, d))))


QUERIES["leaderboard"], SQL["leaderboard"] = QUERIES["f1_leaderboard"], SQL["f1_leaderboard"]


@query("f2_worst_hours", """SELECT h.series_id, h.ts, round(abs(h.kwh - m.e), 6) AS off FROM off_hourly h JOIN energy m ON h.series_id = m.series_id AND h.ts = m.ts
    ORDER BY off DESC, h.series_id, h.ts LIMIT 5""")
def _(spark, d):
    m = S.impute(minutes(spark, d))
    return P.worst_hours(_off_hourly(m), m)


@query("f3_cap_per_group", """SELECT series_id, origin_ts FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY origin_ts DESC) AS r FROM origins) WHERE r <= 100""")
def _(spark, d):
    return S.cap_per_group(origins(spark, d), ["series_id"], "origin_ts", 100, "last").select("series_id", "origin_ts")


@query("g1_common_origins", "SELECT series_id, origin_ts FROM origins WHERE hour(origin_ts) < 20")
def _(spark, d):
    pred = predictions(spark, d).where((F.col("model") != "persistence") | (F.hour("origin_ts") < 20))
    return E.common_origins(pred, 3)


#: Published results that stand in the comparison for reference: model and pooled MAE (kW).
ANCHORS = (("published boosted trees", 0.4190), ("published same-hour mean", 0.4341), ("published persistence", 0.6797))


@query("g2_assemble", "SELECT model, n, mae, NULL::BIGINT AS horizon, 0::BIGINT AS place FROM pooled UNION ALL SELECT model, n, mae, horizon, 1 FROM byh "
       + " ".join(f"UNION ALL SELECT '{m}', NULL, {v}::DOUBLE, NULL, 2" for m, v in ANCHORS))
def _(spark, d):
    pred = predictions(spark, d)
    parts = E.metrics_pooled(pred).select("model", "n", "mae"), E.metrics_by_horizon(pred).select("model", "n", "mae", "horizon")
    rows = E.assemble_results(*parts, anchors=spark.createDataFrame(list(ANCHORS), "model string, mae double"))
    return rows.orderBy("place", "horizon", "mae", "model")


# --- H: functions


@query("h1_smape_term", "SELECT l_orderkey, l_linenumber, CASE WHEN abs(l_tax) + abs(l_discount) > 1e-8 THEN 2 * abs(l_discount - l_tax) / (abs(l_tax) + abs(l_discount)) END AS term FROM lineitem")
def _(spark, d):
    term = C.smape_term(F.col("l_tax"), F.col("l_discount"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", term.alias("term"))


@query("h2_dates", """SELECT event_id, date_trunc('day', ts) AS day, date_diff('minute', date_trunc('day', ts), ts) // 60 AS hours, CAST(floor((date_diff('minute', date_trunc('day', ts), ts) // 60) / 6.0) AS BIGINT) AS block,
    year(ts) AS year, quarter(ts) AS quarter FROM events""")
def _(spark, d):
    day = C.floor_day("ts")
    return table(spark, d, "events").select(
        "event_id", day.alias("day"), C.hours_between(day, "ts").alias("hours"), C.block_no("ts", day, 6).alias("block"), F.year("ts").cast("long").alias("year"),
        F.quarter("ts").cast("long").alias("quarter"),
    )


@query("h3_pack_unpack", "SELECT series_id, origin_ts, model, horizon, y_hat AS y_hat FROM pred")
def _(spark, d):
    keys = ["series_id", "origin_ts", "model"]
    packed = C.pack_horizons(predictions(spark, d), keys)
    return plain(C.unpack_horizons(packed, keys))


@query("h4_patchify", """SELECT vec_id, p AS patch, list_sum(list_transform(range(0, 16), lambda j: CAST(x[least(p * 8 + j, 63) + 1] AS DOUBLE))) AS total
    FROM (SELECT vec_id, embedding AS x, unnest(range(0, 8)) AS p FROM embeddings)""")
def _(spark, d):
    x = F.col("embedding").cast("array<double>")
    rows = table(spark, d, "embeddings").select("vec_id", F.posexplode(C.patchify(x, 64, 16, 8)).alias("patch", "v"))
    return plain(rows.select("vec_id", F.col("patch").cast("long").alias("patch"), F.aggregate("v", F.lit(0.0), lambda s, y: s + y).alias("total")))


@query("h5_instance_norm", """SELECT vec_id, list_avg(x) AS mu, list_stddev_pop(x) AS sigma, (x[1] - list_avg(x)) / list_stddev_pop(x) AS z1, x[64] AS back64
    FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)""")
def _(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", C.instance_norm(F.col("embedding").cast("array<double>")).alias("n"))
    return plain(rows.select("vec_id", "n.mu", "n.sigma", F.col("n.z")[0].alias("z1"), F.element_at(C.instance_denorm(F.col("n")), 64).alias("back64")))


@query("h6_scaler", """SELECT l_orderkey, l_linenumber, (l_quantity - m) / s AS l_quantity FROM lineitem, (SELECT avg(l_quantity) AS m, stddev_samp(l_quantity) AS s FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-01-01')""")
def _(spark, d):
    li = table(spark, d, "lineitem")
    stats = E.fit_scaler(li.where(F.col("l_shipdate") < F.lit("1996-01-01").cast("timestamp_ntz")), ["l_quantity"])
    return plain(E.apply_scaler(li, stats, ["l_quantity"]).select("l_orderkey", "l_linenumber", "l_quantity"))


# --- I: protocol


@query("i1_time_split", "SELECT series_id, origin_ts, cut_val, cut_test, split FROM split")
def _(spark, d):
    return split(spark, d).select("series_id", "origin_ts", "cut_val", "cut_test", "split")


def cv_folds(s: DataFrame) -> DataFrame:
    """Folds with the usual cap; the least sizes are lower than usual, as the series of these tables are short."""
    return E.rolling_origin_folds(s, min_train=50, min_val=20)


@query("i2_cv_folds", "SELECT series_id, fold, count(*) AS n_val, min(origin_ts) AS first_val, max(n_train) AS n_train FROM folds GROUP BY 1, 2")
def _(spark, d):
    folds = cv_folds(split(spark, d))
    return folds.groupBy("series_id", "fold").agg(F.count("*").alias("n_val"), F.min("origin_ts").alias("first_val"), F.max("n_train").cast("long").alias("n_train"))


@query("i3_rolling_blocks", "SELECT series_id, origin_ts, block, block_start FROM blocks")
def _(spark, d):
    return E.rolling_blocks(split(spark, d).where("split <> 'train'")).select("series_id", "origin_ts", "block", "block_start")


@query("i4_block_plan", """SELECT b.series_id, b.segment_id, b.block, b.block_start, date_diff('hour', s.start, b.block_start) AS history, date_diff('hour', s.start, b.block_start) < 168 AS skip,
    CASE WHEN date_diff('hour', s.start, b.block_start) - 168 >= 24 THEN least((date_diff('hour', s.start, b.block_start) - 168) // 4, 720) ELSE 0 END AS val_size
    FROM (SELECT DISTINCT series_id, segment_id, block, min(origin_ts) OVER (PARTITION BY series_id, segment_id, block) AS block_start FROM (SELECT *,
    CAST(floor(date_diff('hour', min(origin_ts) OVER (PARTITION BY series_id, segment_id), origin_ts) / 24.0) AS BIGINT) AS block FROM evals)) b
    JOIN stats s ON s.series_id = b.series_id AND s.segment_id = b.segment_id""")
def _(spark, d):
    seg = segments(spark, d)
    evals = kept(spark, E.time_split(S.window_origins(seg))).where("split <> 'train'")
    return E.block_plan(E.rolling_blocks(evals, hours=24, anchor=("series_id", "segment_id")), S.segment_stats(seg))


@query("i5_alignment", """SELECT 'horizons' AS "check", count(*) AS n_bad FROM origins WHERE hour(origin_ts) = 7
    UNION ALL SELECT 'unasked', count(*) FROM origins WHERE hour(origin_ts) = 9 UNION ALL SELECT 'unpredicted', count(*) FROM origins WHERE hour(origin_ts) = 5
    UNION ALL SELECT 'span', count(*) FROM (SELECT o.series_id, o.segment_id, n, count(*) AS hours FROM (SELECT series_id, segment_id, min(origin_ts) AS lo, max(origin_ts) AS hi, count(*) AS n
        FROM origins WHERE hour(origin_ts) <> 9 GROUP BY 1, 2) o JOIN segs s ON s.series_id = o.series_id AND s.segment_id = o.segment_id AND s.ts >= o.lo AND s.ts <= o.hi + INTERVAL 24 HOUR
        GROUP BY 1, 2, 3) WHERE hours <> n + 24""")
def _(spark, d):
    hour = F.hour("origin_ts")  # planted: hour 5 is not predicted, hour 7 lacks a horizon, hour 9 is not asked for
    pred = predictions(spark, d).where("model = 'persistence'").where((hour != 5) & ((hour != 7) | (F.col("horizon") != 24)))
    seg = segments(spark, d)
    return E.check_alignment(pred, S.window_origins(seg).where(hour != 9), hourly=seg)


# --- J: forecasters


@query("j1_persistence", "SELECT series_id, origin_ts, horizon, persistence AS y_hat FROM truth")
def _(spark, d):
    return plain(E.predict_baselines(segments(spark, d), ("persistence",)).select("series_id", "origin_ts", "horizon", "y_hat"))


@query("j2_seasonal_naive", "SELECT series_id, origin_ts, horizon, seasonal_naive AS y_hat FROM truth")
def _(spark, d):
    return plain(E.predict_baselines(segments(spark, d), ("seasonal_naive",)).select("series_id", "origin_ts", "horizon", "y_hat"))


@query("j3_same_hour_mean", "SELECT series_id, origin_ts, horizon, same_hour_mean AS y_hat FROM truth")
def _(spark, d):
    return plain(E.predict_baselines(segments(spark, d), ("same_hour_mean",)).select("series_id", "origin_ts", "horizon", "y_hat"))


def _train_test(spark, d, table_of):
    """Training and test rows of a table of the segments' origins."""
    seg = segments(spark, d)
    s = kept(spark, E.time_split(S.window_origins(seg))).select("series_id", "origin_ts", "split", "cut_val")
    both = table_of(seg).join(s, ["series_id", "origin_ts"])
    return both.where((F.col("split") == "train") & (F.col("origin_ts") < C.plus_hours(F.col("cut_val"), -24))), both.where("split = 'test'")


_NO_SCORES = "n long, mae double, rmse double, smape double, r2 double"


@query("j4_trees")
def _(spark, d):
    train, test = _train_test(spark, d, S.feature_table)
    fitted = B.fit_boosters(spark, train, range(1, 25), M.FEATURES)
    if fitted is None:
        return spark.createDataFrame([], f"model string, horizon long, {_NO_SCORES}")
    return E.metrics_by_horizon(B.predict_boosters(spark, fitted, test))


@query("d21_mean_importance")
def _(spark, d):
    train, _ = _train_test(spark, d, S.feature_table)
    fitted = B.fit_boosters(spark, train, range(1, 25), M.FEATURES)
    if fitted is None:
        return spark.createDataFrame([], "feature string, value double")
    return B.mean_importance(spark, fitted)


@query("j5_linear")
def _(spark, d):
    train, test = _train_test(spark, d, S.windows)
    done = M.linear_direct(spark, train, test).withColumn("model", F.lit("linear"))
    rows = done.select("model", F.posexplode(F.arrays_zip("y", "y_hat")).alias("h", "v")).select("model", (F.col("h") + 1).alias("horizon"), "v.y", "v.y_hat")
    return E.metrics_pooled(rows)


def _by_split(done: DataFrame, s: DataFrame) -> DataFrame:
    """Pooled scores of val and of test."""
    return E.metrics_pooled(done.join(s.select("series_id", "origin_ts", "split"), ["series_id", "origin_ts"]), ("model", "split"))


@query("j6_rolling")
def _(spark, d):
    seg = segments(spark, d)
    s = kept(spark, E.time_split(S.window_origins(seg)).where("split <> 'train'"))
    done = M.rolling_linear(S.windows(seg), E.rolling_blocks(s, anchor=("series_id",)), ridge=10.0)
    rows = done.withColumn("model", F.lit("linear")).select("series_id", "origin_ts", "model", F.posexplode(F.arrays_zip("y", "y_hat")).alias("h", "v"))
    return _by_split(rows.select("series_id", "origin_ts", "model", "v.y", "v.y_hat"), s)


@query("j6_rolling_trees")
def _(spark, d):
    """All horizons, re-trained for each week of val and test with all trees."""
    seg = segments(spark, d)
    s = kept(spark, E.time_split(S.window_origins(seg)).where("split <> 'train'"))
    return _by_split(M.rolling_trees(spark, kept(spark, S.feature_table(seg)), E.rolling_blocks(s, anchor=())), s)


def queries():
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
