"""Named queries over the sample tables, each with its SQL.

Bars are events by event_type and hour. Doubles are rounded on both sides: sums depend on the order of addition.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.columns import by_time, trailing
from barloom.functions.ranged import quantiles
from barloom.operators import bars as B
from barloom.operators import boosting as BT
from barloom.operators import drift as D
from barloom.operators import features as X
from barloom.operators import labels as L
from barloom.operators import metrics as E
from barloom.operators import models as M
from barloom.operators import quality as Q
from barloom.operators import splits as S
from barloom.operators import timeline as T
from barloom.sources.staging import staged

WINDOWS, H, HOUR = [3, 12], 12, 3600
TRAIN, VALIDATION, TEST, GAP, QUANTILE = 0.7, 0.15, 0.15, 12, 0.8

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def query(sql: str | None = None):
    """Registers a query under the function's name."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def pick(columns: str, source: str) -> str:
    """SELECT of columns; ~x is a double to round (never to negative zero)."""
    made = [f"CASE WHEN round({c[1:]}, 6) = 0 THEN 0.0 ELSE round({c[1:]}, 6) END AS {c[1:]}" if c[0] == "~" else c for c in columns.split()]
    return f"SELECT {', '.join(made)} FROM {source}"


def ctes(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + " "


# -- bars --------------------------------------------------------------------------------------------------------------------


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.from_events(table(spark, sf_dir, "events"), "event_type", "ts", "value", "event_id")


def _bars_sql(name: str, source: str, symbol: str, time: str, price: str, tie: str, unit: str) -> str:
    o = f"ORDER BY {time}, {tie}"
    return f"""{name} AS (SELECT {symbol} AS symbol, date_trunc('{unit}', {time}) AS timestamp, first({price} {o}) AS open, max({price}) AS high,
 min({price}) AS low, last({price} {o}) AS close, sum({price}) AS volume, count(*) AS num_trades FROM {source} GROUP BY 1, 2)"""


BARS = _bars_sql("bars", "events", "event_type", "ts", "value", "event_id", "hour")
BAR_COLUMNS = "symbol timestamp ~open ~high ~low ~close ~volume num_trades"


@query("SELECT event_id, ts, event_type, round(value, 6) AS value FROM events")
def scan_events(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "ts", "event_type", "value")


@query(ctes(BARS) + pick(BAR_COLUMNS, "bars"))
def bars_hourly(spark, sf_dir):
    return hourly(spark, sf_dir)


@query(ctes(BARS, """days AS (SELECT symbol, date_trunc('day', timestamp) AS day, first(open ORDER BY timestamp) AS open, max(high) AS high, min(low) AS low,
 last(close ORDER BY timestamp) AS close, sum(volume) AS volume FROM bars GROUP BY 1, 2)""") + pick("symbol timestamp ~open ~high ~low ~close ~volume", "(SELECT * RENAME (day AS timestamp) FROM days)"))
def bars_daily(spark, sf_dir):
    return B.resample(hourly(spark, sf_dir), "1 day")


@query(ctes(_bars_sql("days", "orders", "o_orderpriority", "o_orderdate", "o_totalprice", "o_orderkey", "day")) + pick(BAR_COLUMNS, "days"))
def bars_from_orders_daily(spark, sf_dir):
    return B.from_events(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderdate", "o_totalprice", "o_orderkey", "1 day")


@query("SELECT event_type AS symbol, ts AS timestamp, round(TRY_CAST(CAST(value AS VARCHAR) AS DOUBLE), 6) AS close, TRY_CAST(event_type AS DOUBLE) AS open FROM events")
def coerce_types(spark, sf_dir):
    raw = table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), F.col("ts").cast("string").alias("timestamp"), F.col("value").cast("string").alias("close"), F.col("event_type").alias("open"))
    return B.coerced(raw).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


def by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of every user and hour: unlike those of the few event types they grow with the events."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("user"), "ts", "value", "event_id")
    return B.from_events(events, "user", "ts", "value", "event_id")


USER_BARS = _bars_sql("bars", "events", "CAST(user_id AS VARCHAR)", "ts", "value", "event_id", "hour")


@query(ctes(USER_BARS) + pick(BAR_COLUMNS, "bars"))
def bars_by_user(spark, sf_dir):
    return by_user(spark, sf_dir)


RANGE = ("2024-01-03 00:00:00", "2024-01-10 00:00:00")


@query(ctes(BARS) + pick(BAR_COLUMNS, f"bars WHERE timestamp BETWEEN TIMESTAMP '{RANGE[0]}' AND TIMESTAMP '{RANGE[1]}'"))
def range_filter(spark, sf_dir):
    return B.in_range(hourly(spark, sf_dir), *RANGE)


@query(ctes(BARS) + pick(BAR_COLUMNS, "bars WHERE symbol = 'click'"))
def symbol_filter(spark, sf_dir):
    return B.of_symbol(hourly(spark, sf_dir), "click")


# -- features ----------------------------------------------------------------------------------------------------------------

_W = "PARTITION BY symbol ORDER BY timestamp"
_LN = "(CASE WHEN close > 0 THEN ln(close) END)"


def _change_sql(c: str) -> str:
    return f"({c} - lag({c}) OVER ({_W})) / nullif(lag({c}) OVER ({_W}), 0)"


FEATURES_1 = f"""f1 AS (SELECT *, {_LN} - lag({_LN}) OVER ({_W}) AS log_return_1, (close - open) / nullif(open, 0) AS open_close_return,
 (high - low) / nullif(open, 0) AS high_low_range_pct, abs(close - open) / nullif(open, 0) AS candle_body_pct, (high - greatest(open, close)) / nullif(open, 0) AS upper_wick_pct,
 (least(open, close) - low) / nullif(open, 0) AS lower_wick_pct, {_change_sql("volume")} AS volume_change, {_change_sql("CAST(num_trades AS DOUBLE)")} AS num_trades_change FROM bars)"""
BASE = ["log_return_1", "open_close_return", "high_low_range_pct", "candle_body_pct", "upper_wick_pct", "lower_wick_pct", "volume_change", "num_trades_change"]


def _trailing_sql(x: str, n: int, how: str, least: int | None = None) -> str:
    frame = f"OVER ({_W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    made = {"mean": f"avg({x}) {frame}", "std": f"stddev_samp({x}) {frame}", "max": f"max({x}) {frame}", "min": f"min({x}) {frame}", "energy": f"sqrt(sum(({x}) * ({x})) {frame})"}[how]
    return f"(CASE WHEN count({x}) {frame} >= {least or n} THEN {made} END)"


def _window_sql(n: int, least: int | None = None) -> dict[str, str]:
    def t(x: str, how: str) -> str:
        return _trailing_sql(x, n, how, least)

    return {
        f"rolling_return_mean_{n}": t("log_return_1", "mean"),
        f"rolling_return_std_{n}": t("log_return_1", "std"),
        f"rolling_abs_return_mean_{n}": t("abs(log_return_1)", "mean"),
        f"rolling_realized_vol_{n}": t("log_return_1", "energy"),
        f"rolling_volume_mean_{n}": t("volume", "mean"),
        f"rolling_volume_std_{n}": t("volume", "std"),
        f"volume_zscore_{n}": f"(volume - {t('volume', 'mean')}) / nullif({t('volume', 'std')}, 0)",
        f"rolling_high_low_range_mean_{n}": t("high_low_range_pct", "mean"),
        f"rolling_drawdown_{n}": f"close / nullif({t('close', 'max')}, 0) - 1",
        f"distance_from_rolling_high_{n}": f"close / nullif({t('high', 'max')}, 0) - 1",
        f"distance_from_rolling_low_{n}": f"close / nullif({t('low', 'min')}, 0) - 1",
    }


def _features_2(least: int | None = None, windows: list[int] = WINDOWS) -> str:
    made = {k: v for n in windows for k, v in _window_sql(n, least).items()}
    return "f2 AS (SELECT *, " + ", ".join(f"{v} AS {k}" for k, v in made.items()) + " FROM f1)"


WINDOWED = [k for n in WINDOWS for k in _window_sql(n)]
_ALL_FEATURES = " ".join(f"~{c}" for c in BASE + WINDOWED)


def featured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.build(hourly(spark, sf_dir), WINDOWS)


@query(ctes(BARS, FEATURES_1) + pick("symbol timestamp " + " ".join(f"~{c}" for c in BASE[1:6]), "f1"))
def candle_ratios(spark, sf_dir):
    return hourly(spark, sf_dir).withColumns(X.bar_features(hourly(spark, sf_dir))).select("symbol", "timestamp", *BASE[1:6])


@query(ctes(BARS, FEATURES_1) + pick("symbol timestamp ~volume_change ~num_trades_change", "f1"))
def volume_changes(spark, sf_dir):
    bars = hourly(spark, sf_dir)
    return bars.withColumns(X.bar_features(bars)).select("symbol", "timestamp", "volume_change", "num_trades_change")


@query(ctes(BARS, FEATURES_1) + pick("symbol timestamp ~log_return_1", "f1"))
def log_return(spark, sf_dir):
    bars = hourly(spark, sf_dir)
    return bars.withColumns(X.bar_features(bars)).select("symbol", "timestamp", "log_return_1")


def _one_feature(name: str, columns: list[str]) -> None:
    def made(spark, sf_dir):
        return featured(spark, sf_dir).select("symbol", "timestamp", *columns)

    made.__name__ = name
    query(ctes(BARS, FEATURES_1, _features_2()) + pick("symbol timestamp " + " ".join(f"~{c}" for c in columns), "f2"))(made)


for _name, _stem in {
    "rolling_mean": "rolling_return_mean", "rolling_std": "rolling_return_std", "rolling_abs_mean": "rolling_abs_return_mean", "realized_vol": "rolling_realized_vol", "volume_mean": "rolling_volume_mean",
    "volume_std": "rolling_volume_std", "volume_zscore": "volume_zscore", "range_mean": "rolling_high_low_range_mean", "drawdown": "rolling_drawdown", "dist_high": "distance_from_rolling_high", "dist_low": "distance_from_rolling_low",
}.items():
    _one_feature(_name, [f"{_stem}_{n}" for n in WINDOWS])


@query(ctes(BARS, FEATURES_1, _features_2(1)) + pick("symbol timestamp " + " ".join(f"~{c}" for c in WINDOWED), "f2"))
def partial_policy(spark, sf_dir):
    return X.build(hourly(spark, sf_dir), WINDOWS, "allow_partial").select("symbol", "timestamp", *WINDOWED)


@query(ctes(BARS, FEATURES_1, _features_2()) + pick("symbol timestamp " + _ALL_FEATURES, "f2"))
def full_feature_table(spark, sf_dir):
    return featured(spark, sf_dir).select("symbol", "timestamp", *BASE, *WINDOWED)


#: The windows of a whole feature set: 9 features of the bar and 11 of each window.
ALL_WINDOWS = [3, 6, 12, 48, 288]
_WIDE = [k for n in ALL_WINDOWS for k in _window_sql(n)]
_QUOTED = """bars AS (SELECT *, volume * 2 + num_trades AS quote_volume FROM plain)"""


@query(ctes(BARS.replace("bars AS", "plain AS", 1), _QUOTED, FEATURES_1, _features_2(windows=ALL_WINDOWS)).rstrip() + ", q AS (SELECT *, " + _change_sql("quote_volume") + " AS quote_volume_change FROM f2) " + pick("symbol timestamp ~quote_volume_change " + " ".join(f"~{c}" for c in BASE + _WIDE), "q"))
def whole_feature_set(spark, sf_dir):
    """All 64 features, quote_volume_change among them."""
    bars = hourly(spark, sf_dir).withColumn("quote_volume", F.col("volume") * 2 + F.col("num_trades"))
    return X.build(bars, ALL_WINDOWS).select("symbol", "timestamp", "quote_volume_change", *BASE, *_WIDE)


_LONG_WINDOWS = [k for n in (48, 288) for k in _window_sql(n)]


@query(ctes(BARS, FEATURES_1, _features_2(windows=[48, 288])) + pick("symbol timestamp " + " ".join(f"~{c}" for c in _LONG_WINDOWS), "f2"))
def long_windows(spark, sf_dir):
    """Frames whose cost doesn't grow with their length."""
    return X.build(hourly(spark, sf_dir), [48, 288]).select("symbol", "timestamp", *_LONG_WINDOWS)


@query(ctes(USER_BARS, FEATURES_1, _features_2(1, [4])) + pick("symbol timestamp " + " ".join(f"~{k}" for k in _window_sql(4)), "f2"))
def long_windows_by_user(spark, sf_dir):
    """The same frames for many symbols, partly filled."""
    return X.build(by_user(spark, sf_dir), [4], "allow_partial", moving=0).select("symbol", "timestamp", *_window_sql(4))


@query(ctes(BARS, FEATURES_1, _features_2()) + pick("symbol timestamp " + _ALL_FEATURES, "f2"))
def full_feature_table_chunked(spark, sf_dir):
    return X.build_chunked(hourly(spark, sf_dir), WINDOWS, 200).select("symbol", "timestamp", *BASE, *WINDOWED)


@query(ctes(USER_BARS, FEATURES_1, _features_2(windows=[3])) + pick("symbol timestamp " + " ".join(f"~{c}" for c in BASE) + " ~rolling_return_mean_3 ~rolling_volume_std_3", "f2"))
def features_by_user(spark, sf_dir):
    return X.build(by_user(spark, sf_dir), [3]).select("symbol", "timestamp", *BASE, "rolling_return_mean_3", "rolling_volume_std_3")


_SOUND = " AND ".join(f"{c} IS NOT NULL" for c in BASE + WINDOWED)


@query(ctes(BARS, FEATURES_1, _features_2()) + pick("symbol timestamp ~close " + _ALL_FEATURES, f"f2 WHERE {_SOUND}"))
def model_feature_table(spark, sf_dir):
    made = featured(spark, sf_dir)
    return X.model_table(made, X.feature_columns(made)).select("symbol", "timestamp", "close", *BASE, *WINDOWED)


@query(
    ctes(BARS, FEATURES_1, _features_2(), "m AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, count(*) - count({c}) AS missing_count, count(*) AS n FROM f2" for c in BASE + WINDOWED) + ")")
    + f"SELECT feature, missing_count, round(100.0 * missing_count / n, 6) AS missing_pct, CASE WHEN missing_count = 0 THEN 'no_missing_values' WHEN missing_count >= n THEN 'suspicious_all_values_missing' WHEN missing_count <= {max(WINDOWS) + 5} THEN 'expected_rolling_warmup' ELSE 'inspect_more_missing_than_expected' END AS interpretation FROM m"
)
def feature_missingness(spark, sf_dir):
    made = featured(spark, sf_dir)
    return X.missingness(made, X.feature_columns(made), WINDOWS)


@query(ctes(BARS) + f"SELECT symbol, CAST({len(BASE) + len(WINDOWED)} AS BIGINT) AS compared, 0.0::DOUBLE AS max_abs_diff FROM bars GROUP BY symbol HAVING count(*) > {max(WINDOWS) + 10}")
def past_only_check(spark, sf_dir):
    return X.past_only_check(hourly(spark, sf_dir), WINDOWS)


# -- labels ------------------------------------------------------------------------------------------------------------------

FUTURE = f"""r AS (SELECT *, {_LN} - lag({_LN}) OVER ({_W}) AS lr FROM bars),
fut AS (SELECT * EXCLUDE (lr), lead({_LN}, {H}) OVER ({_W}) - {_LN} AS future_return_{H},
 CASE WHEN count(lr) OVER ({_W} ROWS BETWEEN 1 FOLLOWING AND {H} FOLLOWING) = {H} THEN sqrt(sum(lr * lr) OVER ({_W} ROWS BETWEEN 1 FOLLOWING AND {H} FOLLOWING)) END AS future_rv_{H} FROM r)"""
MASK = f"""mask AS (SELECT *, future_rv_{H} IS NOT NULL AND count(future_rv_{H}) OVER ({_W} ROWS UNBOUNDED PRECEDING)
 <= floor(count(future_rv_{H}) OVER (PARTITION BY symbol) * {TRAIN}::DOUBLE) AS used_for_label_threshold FROM fut)"""
LIMIT = f"lim AS (SELECT quantile_cont(future_rv_{H}, {QUANTILE}::DOUBLE) AS threshold FROM mask WHERE used_for_label_threshold)"
LABEL = f"lab AS (SELECT mask.*, CAST(CASE WHEN future_rv_{H} IS NULL THEN NULL WHEN future_rv_{H} > threshold THEN 1 ELSE 0 END AS BIGINT) AS y_high_vol_{H} FROM mask, lim)"


def future(spark, sf_dir):
    return L.future_values(hourly(spark, sf_dir), H)


def masked(spark, sf_dir):
    """Written once: thresholds and the rows that they are for read it."""
    return staged(L.threshold_mask(future(spark, sf_dir), H, TRAIN), "masked")


def labeled(spark, sf_dir):
    return L.build(hourly(spark, sf_dir), H, TRAIN, QUANTILE)


@query(ctes(BARS, FUTURE) + pick(f"symbol timestamp ~future_return_{H}", "fut"))
def future_return(spark, sf_dir):
    return future(spark, sf_dir).select("symbol", "timestamp", f"future_return_{H}")


@query(ctes(BARS) + f"SELECT symbol, timestamp, round(CASE WHEN count(close) OVER w = 5 THEN sum(close) OVER w END, 6) AS future_sum FROM bars WINDOW w AS ({_W} ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)")
def future_window_sum(spark, sf_dir):
    return L.future_sum(hourly(spark, sf_dir), "close", 5).select("symbol", "timestamp", "future_sum")


@query(ctes(BARS, FUTURE) + pick(f"symbol timestamp ~future_rv_{H}", "fut"))
def future_rv(spark, sf_dir):
    return future(spark, sf_dir).select("symbol", "timestamp", f"future_rv_{H}")


@query(ctes(BARS, FUTURE, MASK) + "SELECT symbol, timestamp, used_for_label_threshold FROM mask")
def threshold_mask(spark, sf_dir):
    return masked(spark, sf_dir).select("symbol", "timestamp", "used_for_label_threshold")


@query(ctes(BARS, FUTURE, MASK, LIMIT) + pick("~threshold", "lim"))
def train_threshold(spark, sf_dir):
    return L.threshold(masked(spark, sf_dir), H, QUANTILE, "used_for_label_threshold")


@query(ctes(BARS, FUTURE, MASK, LIMIT, LABEL) + f"SELECT symbol, timestamp, y_high_vol_{H} FROM lab")
def binary_label(spark, sf_dir):
    return labeled(spark, sf_dir).select("symbol", "timestamp", f"y_high_vol_{H}")


@query(ctes(BARS, FUTURE, MASK, LIMIT, LABEL) + pick(f"symbol timestamp ~close ~future_rv_{H} y_high_vol_{H}", f"lab WHERE y_high_vol_{H} IS NOT NULL"))
def labeled_table(spark, sf_dir):
    return L.labeled(labeled(spark, sf_dir), H).select("symbol", "timestamp", "close", f"future_rv_{H}", f"y_high_vol_{H}")


@query(ctes(BARS, FUTURE, MASK, LIMIT, LABEL) + pick(f"symbol timestamp ~close ~future_rv_{H} y_high_vol_{H}", f"lab WHERE y_high_vol_{H} IS NOT NULL"))
def labeled_table_chunked(spark, sf_dir):
    return L.labeled(L.build(hourly(spark, sf_dir), H, TRAIN, QUANTILE, chunk_rows=200), H).select("symbol", "timestamp", "close", f"future_rv_{H}", f"y_high_vol_{H}")


@query(ctes(BARS, FUTURE, MASK, LIMIT, LABEL, f"""s AS (SELECT count(y_high_vol_{H}) AS labeled_rows, count(*) - count(y_high_vol_{H}) AS unlabeled_rows, count(*) FILTER (y_high_vol_{H} = 0) AS low_rows,
 count(*) FILTER (y_high_vol_{H} = 1) AS high_rows, avg(y_high_vol_{H}) AS positive_rate, avg(y_high_vol_{H}) FILTER (used_for_label_threshold) AS masked_positive_rate, min(future_rv_{H}) AS rv_min,
 quantile_cont(future_rv_{H}, 0.5) AS rv_median, avg(future_rv_{H}) AS rv_mean, max(future_rv_{H}) AS rv_max FROM lab)""") + pick("labeled_rows unlabeled_rows low_rows high_rows ~positive_rate ~masked_positive_rate ~rv_min ~rv_median ~rv_mean ~rv_max", "s"))
def label_summary(spark, sf_dir):
    return L.summary(labeled(spark, sf_dir), H)


@query(ctes(BARS, FUTURE) + f"SELECT symbol, count(*) AS n_rows, count(*) - count(future_return_{H}) AS missing_return, count(*) - count(future_rv_{H}) AS missing_rv, CAST({H} AS BIGINT) AS expected_missing FROM fut GROUP BY symbol")
def label_missingness(spark, sf_dir):
    return L.missingness(future(spark, sf_dir), H)


_QS = [0.7, 0.8, 0.9, 0.95]


@query(ctes(BARS, FUTURE, MASK, "q AS (" + " UNION ALL ".join(f"SELECT {q}::DOUBLE AS quantile, (SELECT quantile_cont(future_rv_{H}, {q}::DOUBLE) FROM mask WHERE used_for_label_threshold) AS threshold" for q in _QS) + ")",
 f"s AS (SELECT quantile, threshold, avg(CAST(future_rv_{H} > threshold AS INT)) FILTER (used_for_label_threshold) AS train_rate, avg(CAST(future_rv_{H} > threshold AS INT)) AS overall_rate FROM mask, q WHERE future_rv_{H} IS NOT NULL GROUP BY 1, 2)") + pick("~quantile ~threshold ~train_rate ~overall_rate", "s"))
def quantile_sensitivity(spark, sf_dir):
    return L.sensitivity(masked(spark, sf_dir), H, _QS)


@query(ctes(BARS, f"m AS (SELECT symbol, timestamp, lead(close, 7) OVER ({_W}) / nullif(close, 0) - 1 AS move FROM bars)") + "SELECT symbol, timestamp, CASE WHEN move < -0.02 THEN -1 WHEN move > 0.02 THEN 1 ELSE 0 END AS regime FROM m")
def multiclass_label(spark, sf_dir):
    return L.multiclass(hourly(spark, sf_dir)).select("symbol", "timestamp", "regime")


@query(ctes(BARS, FUTURE, f"n AS (SELECT *, row_number() OVER ({_W}) - 1 AS pos FROM fut)") + f"SELECT symbol, round(future_rv_{H}, 6) AS expected, round(future_rv_{H}, 6) AS actual, 0.0::DOUBLE AS abs_diff FROM n WHERE pos = 10")
def rv_alignment_check(spark, sf_dir):
    return L.alignment_check(hourly(spark, sf_dir), H)


@query(ctes(BARS, FUTURE, f"n AS (SELECT *, row_number() OVER ({_W}) - 1 AS pos, lead(future_rv_{H}) OVER ({_W}) AS moved FROM fut)") + f"SELECT symbol, round(future_rv_{H}, 6) AS expected, round(moved, 6) AS actual, round(abs(future_rv_{H} - moved), 6) AS abs_diff FROM n WHERE pos = 10")
def rv_misalignment_found(spark, sf_dir):
    """The check must show values that stand a row too early."""
    moved = future(spark, sf_dir).withColumn(f"future_rv_{H}", F.lead(f"future_rv_{H}").over(by_time()))
    return L.alignment_check(hourly(spark, sf_dir), H, values=moved)


# -- the same without a task for each symbol ----------------------------------------------------------------------------------


@query(ctes(BARS, FUTURE) + pick(f"symbol timestamp ~future_return_{H} ~future_rv_{H}", "fut"))
def future_values_chunked(spark, sf_dir):
    return L.future_values_chunked(hourly(spark, sf_dir), H, 200).select("symbol", "timestamp", f"future_return_{H}", f"future_rv_{H}")


@query(ctes(BARS, FUTURE, MASK) + "SELECT symbol, timestamp, used_for_label_threshold FROM mask")
def threshold_mask_placed(spark, sf_dir):
    return L.threshold_mask_placed(L.future_values_chunked(hourly(spark, sf_dir), H, 200), H, TRAIN).select("symbol", "timestamp", "used_for_label_threshold")


@query(ctes(BARS, f"m AS (SELECT symbol, timestamp, lead(close, 7) OVER ({_W}) / nullif(close, 0) - 1 AS move FROM bars)") + "SELECT symbol, timestamp, CASE WHEN move < -0.02 THEN -1 WHEN move > 0.02 THEN 1 ELSE 0 END AS regime FROM m")
def multiclass_label_chunked(spark, sf_dir):
    return L.multiclass_chunked(hourly(spark, sf_dir), 100).select("symbol", "timestamp", "regime")


# -- splits ------------------------------------------------------------------------------------------------------------------

SPLIT = f"""pl AS (SELECT *, row_number() OVER ({_W}) - 1 AS pos, count(*) OVER (PARTITION BY symbol) AS n FROM lab WHERE y_high_vol_{H} IS NOT NULL),
pb AS (SELECT *, CAST(floor(n * {TRAIN}::DOUBLE) AS BIGINT) AS tb, CAST(floor(n * ({TRAIN}::DOUBLE + {VALIDATION}::DOUBLE)) AS BIGINT) AS vb FROM pl),
spl AS (SELECT * EXCLUDE (pos, n, tb, vb), CASE WHEN pos < greatest(0, tb - {GAP}) THEN 'train' WHEN pos < tb THEN 'purge_train_validation' WHEN pos < greatest(tb, vb - {GAP}) THEN 'validation' WHEN pos < vb THEN 'purge_validation_test' ELSE 'test' END AS split FROM pb),
slim AS (SELECT quantile_cont(future_rv_{H}, {QUANTILE}::DOUBLE) AS threshold FROM spl WHERE split = 'train'),
safe AS (SELECT spl.*, CAST(CASE WHEN future_rv_{H} > threshold THEN 1 ELSE 0 END AS BIGINT) AS y_high_vol_{H}_split_safe FROM spl, slim)"""
_SAFE = ctes(BARS, FUTURE, MASK, LIMIT, LABEL, SPLIT)


def split(spark, sf_dir):
    return S.assign(labeled(spark, sf_dir).where(F.col(f"y_high_vol_{H}").isNotNull()), TRAIN, VALIDATION, TEST, GAP)


def safe(spark, sf_dir):
    return S.build(labeled(spark, sf_dir).where(F.col(f"y_high_vol_{H}").isNotNull()), H, TRAIN, VALIDATION, TEST, GAP, QUANTILE)


@query(_SAFE + "SELECT symbol, timestamp, split FROM spl")
def chrono_split(spark, sf_dir):
    return split(spark, sf_dir).select("symbol", "timestamp", "split")


@query(_SAFE + "SELECT symbol, timestamp, split FROM spl")
def chrono_split_placed(spark, sf_dir):
    rows = labeled(spark, sf_dir).where(F.col(f"y_high_vol_{H}").isNotNull())
    return S.assign_placed(rows, TRAIN, VALIDATION, TEST, GAP).select("symbol", "timestamp", "split")


@query(_SAFE + pick("~threshold", "slim"))
def split_threshold(spark, sf_dir):
    return S.train_threshold(staged(split(spark, sf_dir), "splits"), H, QUANTILE)


@query(_SAFE + f"SELECT symbol, timestamp, split, y_high_vol_{H}_split_safe FROM safe")
def split_safe_label(spark, sf_dir):
    return safe(spark, sf_dir).select("symbol", "timestamp", "split", f"y_high_vol_{H}_split_safe")


_NAMES = "names(position, split) AS (VALUES " + ", ".join(f"({k}, '{s}')" for k, s in enumerate(S.SPLITS)) + ")"


@query(_SAFE + f"SELECT symbol, timestamp, split, y_high_vol_{H}_split_safe FROM safe")
def split_table_placed(spark, sf_dir):
    made = S.build(labeled(spark, sf_dir).where(F.col(f"y_high_vol_{H}").isNotNull()), H, TRAIN, VALIDATION, TEST, GAP, QUANTILE, placed=True)
    return made.select("symbol", "timestamp", "split", f"y_high_vol_{H}_split_safe")


@query(_SAFE.rstrip() + ", " + _NAMES + f""" SELECT position, names.split AS split, count(symbol) AS n_rows, min(timestamp) AS start_time, max(timestamp) AS end_time, round(avg(y_high_vol_{H}_split_safe), 6) AS positive_rate
 FROM names LEFT JOIN safe ON names.split = safe.split GROUP BY 1, 2""")
def split_summary(spark, sf_dir):
    return S.summary(safe(spark, sf_dir), H)


@query(_SAFE + f"""SELECT split, count(*) AS rows_compared, count(*) FILTER (y_high_vol_{H} <> y_high_vol_{H}_split_safe) AS num_changed,
 round(count(*) FILTER (y_high_vol_{H} <> y_high_vol_{H}_split_safe) / count(*), 6) AS changed_rate FROM safe WHERE split IN ('train', 'validation', 'test') GROUP BY split""")
def label_comparison(spark, sf_dir):
    return S.compare_labels(safe(spark, sf_dir), H)


_BOUNDS = "bd AS (SELECT symbol, " + ", ".join(f"count(*) FILTER (split = '{s}') AS {s}_n, min(timestamp) FILTER (split = '{s}') AS {s}_min, max(timestamp) FILTER (split = '{s}') AS {s}_max" for s in S.MODEL_SPLITS) + " FROM safe GROUP BY symbol)"


@query(_SAFE.rstrip() + ", " + _BOUNDS + """ SELECT symbol, 'splits_non_empty' AS check_name, train_n > 0 AND validation_n > 0 AND test_n > 0 AS passed FROM bd
 UNION ALL SELECT symbol, 'splits_in_order', coalesce(train_max < validation_min AND validation_max < test_min, false) FROM bd UNION ALL SELECT symbol, 'splits_do_not_overlap', true FROM bd""")
def split_order_check(spark, sf_dir):
    return S.order_checks(safe(spark, sf_dir))


@query(_SAFE.rstrip() + ", " + _BOUNDS + f""" SELECT symbol, 'purge_train_validation' AS check_name, coalesce(train_max + INTERVAL {H} HOUR < validation_min, false) AS passed FROM bd
 UNION ALL SELECT symbol, 'purge_validation_test', coalesce(validation_max + INTERVAL {H} HOUR < test_min, false) FROM bd""")
def purge_check(spark, sf_dir):
    return S.purge_checks(safe(spark, sf_dir), H, HOUR)


@query(_SAFE + "SELECT symbol, CAST(sum(k * (k - 1) // 2) AS BIGINT) AS overlap FROM (SELECT symbol, timestamp, count(DISTINCT split) AS k FROM safe WHERE split IN ('train', 'validation', 'test') GROUP BY 1, 2) GROUP BY symbol")
def split_timestamp_intersect(spark, sf_dir):
    return S.shared_times(safe(spark, sf_dir))


@query(ctes(BARS, f"p AS (SELECT symbol, timestamp, row_number() OVER ({_W}) - 1 AS pos, count(*) OVER (PARTITION BY symbol) AS n FROM bars)",
 f"z AS (SELECT DISTINCT symbol, n, CAST(floor(n * 0.5) AS BIGINT) AS t0, CAST(floor(n * 0.1) AS BIGINT) AS v FROM p)",
 f"fo AS (SELECT symbol, v, unnest(generate_series(t0, n - {GAP} - v, v)) AS train_rows, t0 FROM z)",
 f"fs AS (SELECT symbol, CAST((train_rows - t0) // v + 1 AS BIGINT) AS fold, train_rows, v AS validation_rows FROM fo)") +  # noqa: F541
 f"""SELECT fs.symbol, fold, train_rows, validation_rows, a.timestamp AS train_start, b.timestamp AS train_end, c.timestamp AS validation_start, d.timestamp AS validation_end FROM fs
 JOIN p a ON a.symbol = fs.symbol AND a.pos = 0 JOIN p b ON b.symbol = fs.symbol AND b.pos = train_rows - 1
 JOIN p c ON c.symbol = fs.symbol AND c.pos = train_rows + {GAP} JOIN p d ON d.symbol = fs.symbol AND d.pos = train_rows + {GAP} + validation_rows - 1""")  # fmt: skip
def walk_forward_folds(spark, sf_dir):
    return S.walk_forward(hourly(spark, sf_dir), 0.5, 0.1, 0.1, GAP)


@query(ctes(BARS, "z AS (SELECT symbol, count(*) AS n FROM bars GROUP BY symbol)") + """SELECT symbol, CAST(a // 20 AS BIGINT) AS fold, a AS train_start, a + 60 AS train_end, a + 60 AS test_start, a + 80 AS test_end
 FROM (SELECT symbol, unnest(generate_series(0, n - 80, 20)) AS a FROM z WHERE n >= 80)""")
def sliding_folds(spark, sf_dir):
    return S.sliding(hourly(spark, sf_dir).groupBy("symbol").agg(F.count(F.lit(1)).alias("n")), 60, 20)


# -- quality -----------------------------------------------------------------------------------------------------------------

_BAR_NAMES = ["symbol", "timestamp", "open", "high", "low", "close", "volume", "num_trades"]


def holed(spark, sf_dir):
    """Features in a table of bars: the first rows of each symbol have nulls."""
    return featured(spark, sf_dir).select("symbol", "timestamp", *WINDOWED)


@query(ctes(BARS, FEATURES_1, _features_2()) + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS null_count FROM f2" for c in ["symbol", "timestamp", *WINDOWED]))
def null_counts(spark, sf_dir):
    return Q.null_counts(holed(spark, sf_dir))


@query("SELECT l_orderkey, l_linenumber, l_partkey, count(*) AS n FROM lineitem JOIN (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY ALL HAVING count(*) > 1) USING (l_orderkey, l_linenumber) GROUP BY ALL")
def duplicate_keys(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return Q.duplicates(rows, ["l_orderkey", "l_linenumber"]).groupBy("l_orderkey", "l_linenumber", "l_partkey").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 1")
def duplicate_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_type")
    return Q.duplicates(rows, rows.columns).groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT o_orderpriority AS symbol FROM (SELECT o_orderpriority, o_orderdate, lag(o_orderdate) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS b FROM orders) WHERE o_orderdate < b")
def unsorted_symbols(spark, sf_dir):
    return Q.unsorted_symbols(table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").alias("timestamp"), F.col("o_orderkey").alias("_ingest_order")))


@query("SELECT count(*) = 0 AS is_sorted FROM (SELECT ts, lag(ts) OVER (ORDER BY event_id) AS b FROM events) WHERE ts < b")
def global_order(spark, sf_dir):
    return Q.globally_sorted(table(spark, sf_dir, "events").select(F.col("ts").alias("timestamp"), F.col("event_id").alias("_ingest_order")))


@query(ctes(BARS) + f"SELECT symbol, count(*) FILTER (timestamp - b <> INTERVAL 1 HOUR) AS irregular FROM (SELECT symbol, timestamp, lag(timestamp) OVER ({_W}) AS b FROM bars) GROUP BY symbol")
def irregular_gaps(spark, sf_dir):
    return Q.irregular_gaps(hourly(spark, sf_dir), HOUR)


MISSING = """grid AS (SELECT symbol, unnest(generate_series(min(timestamp), max(timestamp), INTERVAL 1 HOUR)) AS missing_timestamp FROM bars GROUP BY symbol),
gone AS (SELECT * FROM grid WHERE NOT EXISTS (SELECT 1 FROM bars WHERE bars.symbol = grid.symbol AND bars.timestamp = missing_timestamp))"""


@query(ctes(BARS, MISSING) + "SELECT symbol, missing_timestamp FROM gone")
def missing_intervals(spark, sf_dir):
    return Q.missing_bars(hourly(spark, sf_dir), HOUR)


@query(ctes(BARS, MISSING) + "SELECT symbol, count(*) AS n FROM gone GROUP BY symbol")
def missing_anti_join(spark, sf_dir):
    return Q.missing_bars(hourly(spark, sf_dir), HOUR).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))


@query(ctes(BARS) + f"SELECT symbol, count(*) FILTER (timestamp - b <> INTERVAL 1 HOUR) AS irregular FROM (SELECT symbol, timestamp, lag(timestamp) OVER ({_W}) AS b FROM bars) GROUP BY symbol")
def irregular_gaps_chunked(spark, sf_dir):
    return Q.irregular_gaps_chunked(hourly(spark, sf_dir), HOUR, 100)


@query("SELECT DISTINCT o_orderpriority AS symbol FROM (SELECT o_orderpriority, o_orderdate, lag(o_orderdate) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS b FROM orders) WHERE o_orderdate < b")
def unsorted_symbols_ranged(spark, sf_dir):
    return Q.unsorted_symbols_ranged(table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").alias("timestamp"), F.col("o_orderkey").alias("_ingest_order")))


@query(ctes(BARS, FEATURES_1) + "SELECT symbol, timestamp, round(log_return_1, 6) AS log_return FROM f1 WHERE abs(log_return_1) > 0.1")
def extreme_returns_chunked(spark, sf_dir):
    return Q.extreme_returns_chunked(hourly(spark, sf_dir), 100).select("symbol", "timestamp", "log_return")


def shaken(spark, sf_dir):
    """Bars with faults: high and close change places where trades are many, and some volumes are negative."""
    many = F.col("num_trades") % 3 == 0
    return hourly(spark, sf_dir).withColumns({"high": F.when(many, F.col("close") / 2).otherwise(F.col("high")), "volume": F.when(F.col("num_trades") % 5 == 0, -F.col("volume")).otherwise(F.col("volume"))})


SHAKEN = "shaken AS (SELECT symbol, timestamp, open, CASE WHEN num_trades % 3 = 0 THEN close / 2 ELSE high END AS high, low, close, CASE WHEN num_trades % 5 = 0 THEN -volume ELSE volume END AS volume, num_trades FROM bars)"


@query(ctes(BARS, SHAKEN) + " UNION ALL ".join(f"SELECT '{k}' AS check_name, count(*) FILTER ({r}) AS violations FROM shaken" for k, r in Q.RULES.items()))
def ohlcv_rules(spark, sf_dir):
    return Q.rule_counts(shaken(spark, sf_dir))


@query(ctes(BARS, SHAKEN, "f AS (" + " UNION ALL ".join(f"SELECT '{k}' AS failed_check, * FROM shaken WHERE {r}" for k, r in Q.RULES.items()) + ")") + pick("failed_check " + BAR_COLUMNS, "(SELECT *, row_number() OVER (PARTITION BY failed_check ORDER BY symbol, timestamp, open, high, low, close) AS t FROM f) WHERE t <= 20"))
def union_failed_rows(spark, sf_dir):
    return Q.failed_rows(shaken(spark, sf_dir))


@query(ctes(BARS, FEATURES_1) + "SELECT symbol, timestamp, round(log_return_1, 6) AS log_return FROM f1 WHERE abs(log_return_1) > 0.1")
def extreme_returns(spark, sf_dir):
    return Q.extreme_returns(hourly(spark, sf_dir)).select("symbol", "timestamp", "log_return")


@query(ctes(BARS, FEATURES_1) + "SELECT symbol, timestamp, round(log_return_1, 6) AS log_return FROM f1 WHERE abs(log_return_1) > 0.1 ORDER BY abs(log_return_1) DESC, symbol, timestamp LIMIT 50")
def extreme_returns_top(spark, sf_dir):
    return Q.extreme_returns(hourly(spark, sf_dir)).select("symbol", "timestamp", "log_return").orderBy(F.abs("log_return").desc(), "symbol", "timestamp").limit(50)


def arrived(spark, sf_dir):
    """Shaken bars that break the other rules too: nulls, a key and a row given twice, and steps back in the order of arrival."""
    made = shaken(spark, sf_dir).withColumns({"close": F.when(F.col("num_trades") % 7 != 0, F.col("close")), "_ingest_order": F.unix_micros(F.col("timestamp").cast("timestamp"))})
    late = F.dayofmonth("timestamp") % 9 == 0
    made = made.withColumn("_ingest_order", F.col("_ingest_order") - F.when(late, F.lit(7_200_000_001)).otherwise(0))
    copies = F.when(F.hour("timestamp") == 3, 2).when(F.hour("timestamp") == 5, 3).otherwise(1)
    again = made.withColumn("_copy", F.explode(F.sequence(F.lit(1), copies)))
    # the second of two differs in its volume: the key repeats, the row doesn't
    return again.withColumn("volume", F.when((F.col("_copy") == 2) & (F.hour("timestamp") == 3), F.col("volume") + 1).otherwise(F.col("volume"))).withColumn("_ingest_order", F.col("_ingest_order") + F.col("_copy")).drop("_copy")


ARRIVED = """arrived AS (SELECT symbol, timestamp, open, high, low, CASE WHEN num_trades % 7 <> 0 THEN close END AS close, CASE WHEN copy = 2 AND hour(timestamp) = 3 THEN volume + 1 ELSE volume END AS volume, num_trades,
 epoch_us(timestamp) - CASE WHEN day(timestamp) % 9 = 0 THEN 7200000001 ELSE 0 END + copy AS o
 FROM (SELECT *, unnest(generate_series(1, CASE hour(timestamp) WHEN 3 THEN 2 WHEN 5 THEN 3 ELSE 1 END)) AS copy FROM shaken))"""
ISSUES = "iss AS (" + " UNION ALL ".join([
    "SELECT 'required_columns_exist' AS check_name, 'ERROR' AS severity, 0 AS count",
    "SELECT 'optional_columns_present', 'WARNING', 1",
    "SELECT 'extra_columns_detected', 'INFO', 0",
    "SELECT 'core_null_values', 'ERROR', (SELECT count(*) - count(close) FROM arrived)",
    "SELECT 'total_null_values_counted', 'INFO', (SELECT count(*) - count(close) FROM arrived)",
    "SELECT 'timestamps_parse_as_utc', 'ERROR', 0",
    "SELECT 'timestamps_unique_within_symbol', 'ERROR', (SELECT sum(n) FROM (SELECT count(*) AS n FROM arrived GROUP BY symbol, timestamp) WHERE n > 1)",
    "SELECT 'timestamps_sorted_within_symbol', 'ERROR', (SELECT count(DISTINCT symbol) FROM (SELECT symbol, timestamp, lag(timestamp) OVER (PARTITION BY symbol ORDER BY o) AS b FROM arrived) WHERE timestamp < b)",
    "SELECT 'no_duplicate_rows', 'ERROR', (SELECT sum(n) FROM (SELECT count(*) AS n FROM arrived GROUP BY symbol, timestamp, open, high, low, close, volume, num_trades) WHERE n > 1)",
    f"SELECT 'expected_interval_consistent', 'WARNING', (SELECT count(*) FROM (SELECT timestamp - lag(timestamp) OVER ({_W}) AS g FROM bars) WHERE g <> INTERVAL 1 HOUR)",
    "SELECT 'missing_intervals_counted', 'WARNING', (SELECT count(*) FROM gone)",
    *[f"SELECT '{k}', 'ERROR', (SELECT count(*) FROM arrived WHERE {r})" for k, r in Q.RULES.items()],
    f"SELECT 'extreme_returns_flagged', 'WARNING', (SELECT count(*) FROM (SELECT ln(close) - lag(ln(close)) OVER ({_W}) AS m FROM (SELECT DISTINCT symbol, timestamp, CASE WHEN close > 0 THEN close END AS close FROM arrived)) WHERE abs(m) > 0.1)",
]) + ")"
_CHECKED = ctes(BARS, MISSING, SHAKEN, ARRIVED, ISSUES)


@query(_CHECKED + "SELECT check_name, severity, severity = 'INFO' OR count = 0 AS passed, CAST(count AS BIGINT) AS count FROM iss")
def validation_issues(spark, sf_dir):
    return Q.validate(arrived(spark, sf_dir), HOUR).drop("message")


@query(_CHECKED + "SELECT check_name, severity, severity = 'INFO' OR count = 0 AS passed, CAST(count AS BIGINT) AS count FROM iss")
def validation_issues_chunked(spark, sf_dir):
    return Q.validate(arrived(spark, sf_dir), HOUR, chunk_rows=150).drop("message")


@query(_CHECKED + """SELECT count(*) AS total_checks, count(*) FILTER (severity <> 'INFO' AND count > 0) AS failed_checks, count(*) FILTER (severity = 'ERROR' AND count > 0) AS failed_errors,
 count(*) FILTER (severity = 'WARNING' AND count > 0) AS failed_warnings, count(*) FILTER (severity = 'ERROR' AND count > 0) = 0 AS can_continue FROM iss""")
def validation_summary(spark, sf_dir):
    return Q.summarize(Q.validate(arrived(spark, sf_dir), HOUR))


# -- scores, metrics and the timeline ----------------------------------------------------------------------------------------

#: A score without a fit: realized volatility of the last 12 bars over itself plus 5, to four digits so that ties occur.
SCORED = f"""sc AS (SELECT safe.symbol, safe.timestamp, safe.close, safe.split, future_rv_{H}, y_high_vol_{H}_split_safe AS y_true, round(rolling_realized_vol_12 / (rolling_realized_vol_12 + 5), 4) AS y_score
 FROM safe JOIN f2 ON safe.symbol = f2.symbol AND safe.timestamp = f2.timestamp WHERE rolling_realized_vol_12 IS NOT NULL)"""
_SCORES = ctes(BARS, FEATURES_1, _features_2(), FUTURE, MASK, LIMIT, LABEL, SPLIT, SCORED)


def scored(spark, sf_dir, made=None):
    """Rows of safe() (given, where they are at hand) with a score."""
    made = safe(spark, sf_dir) if made is None else made
    vol = trailing(F.col("log_return_1"), 12, "energy", by_time())
    volatility = hourly(spark, sf_dir).withColumns(X.bar_features(hourly(spark, sf_dir))).select("symbol", "timestamp", vol.alias("v")).where("v IS NOT NULL")
    joined = made.join(volatility, ["symbol", "timestamp"])
    return joined.select("symbol", "timestamp", "close", "split", f"future_rv_{H}", F.col(f"y_high_vol_{H}_split_safe").alias("y_true"), F.round(F.col("v") / (F.col("v") + 5), 4).alias("y_score"))


_CLIP = f"least(greatest(y_score, {E.EPSILON}), 1 - {E.EPSILON})"


@query(_SCORES.rstrip() + f""", s AS (SELECT split, count(*) AS n_rows, count(*) FILTER (y_true = 1) AS positives, avg(y_true) AS positive_rate, avg(y_score) AS mean_score, avg((y_score - y_true) * (y_score - y_true)) AS brier,
 avg(-(y_true * ln({_CLIP})) - (1 - y_true) * ln(1 - {_CLIP})) AS log_loss FROM sc GROUP BY split) """ + pick("split n_rows positives ~positive_rate ~mean_score ~brier ~log_loss", "s"))
def binary_metrics(spark, sf_dir):
    return E.basics(scored(spark, sf_dir), ("split",))


@query(_SCORES.rstrip() + ", s AS (SELECT avg((y_score - y_true) * (y_score - y_true)) AS brier, " + f"avg(-(y_true * ln({_CLIP})) - (1 - y_true) * ln(1 - {_CLIP})) AS log_loss FROM sc) " + pick("~brier ~log_loss", "s"))
def brier_logloss(spark, sf_dir):
    return E.basics(scored(spark, sf_dir)).select("brier", "log_loss")


@query(_SCORES.rstrip() + """, c AS (SELECT threshold, count(*) FILTER (y_score >= threshold AND y_true = 1) AS tp, count(*) FILTER (y_score >= threshold AND y_true = 0) AS fp,
 count(*) FILTER (y_score < threshold AND y_true = 0) AS tn, count(*) FILTER (y_score < threshold AND y_true = 1) AS fn FROM sc, (SELECT unnest([0.3::DOUBLE, 0.5::DOUBLE, 0.7::DOUBLE]) AS threshold) GROUP BY threshold),
 m AS (SELECT *, (tp + tn) / (tp + fp + tn + fn) AS accuracy, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, (tp + fp) / (tp + fp + tn + fn) AS predicted_positive_rate,
 CASE WHEN tp + fn = 0 THEN coalesce(tn / nullif(tn + fp, 0), 0) WHEN tn + fp = 0 THEN tp / (tp + fn) ELSE (tp / (tp + fn) + tn / (tn + fp)) / 2 END AS balanced_accuracy FROM c),
 g AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM m) """ + pick("~threshold tp fp tn fn ~accuracy ~balanced_accuracy ~precision ~recall ~f1 ~predicted_positive_rate", "g"))
def threshold_metrics(spark, sf_dir):
    return E.at_thresholds(scored(spark, sf_dir), [0.3, 0.5, 0.7])


_RANKED = """, g AS (SELECT y_score, count(*) FILTER (y_true = 1) AS p, count(*) FILTER (y_true = 0) AS n FROM sc GROUP BY y_score),
 k AS (SELECT p, n, sum(p) OVER (ORDER BY y_score DESC) AS cp, sum(n) OVER (ORDER BY y_score DESC) AS cn, sum(p) OVER () AS ap, sum(n) OVER () AS an FROM g),
 z AS (SELECT sum(p * (an - cn + n / 2)) / max(ap) / max(an) AS roc_auc, sum(p * (cp / (cp + cn))) / max(ap) AS average_precision FROM k) """


@query(_SCORES.rstrip() + _RANKED + pick("~roc_auc", "z"))
def roc_auc(spark, sf_dir):
    return E.ranking(scored(spark, sf_dir)).select("roc_auc")


@query(_SCORES.rstrip() + _RANKED + pick("~average_precision", "z"))
def average_precision(spark, sf_dir):
    return E.ranking(scored(spark, sf_dir)).select("average_precision")


@query(_SCORES.rstrip() + """, o AS (SELECT y_true, row_number() OVER (ORDER BY y_score DESC, symbol, timestamp) AS i, count(*) OVER () AS n, sum(y_true) OVER () AS pos FROM sc),
 f AS (SELECT unnest([0.05::DOUBLE, 0.1::DOUBLE, 0.4::DOUBLE]) AS fraction), t AS (SELECT fraction, CAST(greatest(1, ceil(n * fraction)) AS BIGINT) AS k, i, y_true, pos FROM o, f),
 m AS (SELECT fraction, k, sum(y_true) / k AS precision, sum(y_true) / nullif(max(pos), 0) AS recall FROM t WHERE i <= k GROUP BY 1, 2) """ + pick("~fraction k ~precision ~recall", "m"))
def top_k_precision(spark, sf_dir):
    return E.at_top(scored(spark, sf_dir), [0.05, 0.1, 0.4])


@query(_SCORES.rstrip() + """, o AS (SELECT split, y_true, row_number() OVER (PARTITION BY split ORDER BY y_score DESC, symbol, timestamp) AS i, count(*) OVER (PARTITION BY split) AS n, sum(y_true) OVER (PARTITION BY split) AS pos FROM sc),
 f AS (SELECT unnest([0.05::DOUBLE, 0.1::DOUBLE, 0.4::DOUBLE]) AS fraction), t AS (SELECT split, fraction, CAST(greatest(1, ceil(n * fraction)) AS BIGINT) AS k, i, y_true, pos FROM o, f),
 m AS (SELECT split, fraction, k, sum(y_true) / k AS precision, sum(y_true) / nullif(max(pos), 0) AS recall FROM t WHERE i <= k GROUP BY 1, 2, 3) """ + pick("split ~fraction k ~precision ~recall", "m"))
def top_k_by_split(spark, sf_dir):
    """All splits in one plan, each with its own cut."""
    return E.at_top(scored(spark, sf_dir), [0.05, 0.1, 0.4], by=("split",))


CLASSES = "cl AS (SELECT quality + toxic AS y_true, CASE WHEN doc_id % 5 = 0 THEN toxic ELSE quality END AS y_pred FROM labels)"
_PER_CLASS = """pc AS (SELECT label, count(*) FILTER (y_true = label) AS support, count(*) FILTER (y_pred = label) AS predicted_rows, count(*) FILTER (y_true = label AND y_pred = label) AS hits
 FROM cl, (SELECT DISTINCT y_true AS label FROM cl UNION SELECT DISTINCT y_pred FROM cl) GROUP BY label),
 pm AS (SELECT *, coalesce(hits / nullif(predicted_rows, 0), 0) AS precision, coalesce(hits / nullif(support, 0), 0) AS recall FROM pc),
 pf AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM pm)"""


def classes(spark, sf_dir):
    rows = table(spark, sf_dir, "labels")
    return rows.select((F.col("quality") + F.col("toxic")).alias("y_true"), F.when(F.col("doc_id") % 5 == 0, F.col("toxic")).otherwise(F.col("quality")).alias("y_pred"))


@query(ctes(CLASSES) + "SELECT y_true AS actual, y_pred AS predicted, count(*) AS n FROM cl GROUP BY 1, 2")
def confusion_matrix(spark, sf_dir):
    return E.confusion(classes(spark, sf_dir))


@query(ctes(CLASSES, _PER_CLASS) + pick("label support predicted_rows hits ~precision ~recall ~f1", "pf"))
def class_metrics(spark, sf_dir):
    return E.per_class(classes(spark, sf_dir))


@query(ctes(CLASSES, _PER_CLASS, """mm AS (SELECT CAST(sum(support) AS BIGINT) AS n_rows, sum(hits) / sum(support) AS accuracy, avg(recall) FILTER (support > 0) AS balanced_accuracy, avg(precision) AS macro_precision, avg(recall) AS macro_recall, avg(f1) AS macro_f1,
 sum(precision * support) / sum(support) AS weighted_precision, sum(recall * support) / sum(support) AS weighted_recall, sum(f1 * support) / sum(support) AS weighted_f1 FROM pf)""") + pick("n_rows ~accuracy ~balanced_accuracy ~macro_precision ~macro_recall ~macro_f1 ~weighted_precision ~weighted_recall ~weighted_f1", "mm"))
def multiclass_metrics(spark, sf_dir):
    return E.multiclass(classes(spark, sf_dir))


@query("""WITH s AS (SELECT l_extendedprice AS y, l_quantity * 1500 AS p FROM lineitem), m AS (SELECT count(*) AS n_rows, avg(abs(y - p)) AS mae, avg((y - p) * (y - p)) AS mse, sqrt(avg((y - p) * (y - p))) AS rmse,
 quantile_cont(abs(y - p), 0.5) AS median_ae, 1 - avg((y - p) * (y - p)) / var_pop(y) AS r2, 1 - var_pop(y - p) / var_pop(y) AS explained_variance, avg(abs(y - p) / abs(y)) AS mape FROM s)
 SELECT n_rows, round(mae, 3) AS mae, round(mse / 1e6, 3) AS mse, round(rmse, 3) AS rmse, round(median_ae, 3) AS median_ae, round(r2, 6) AS r2, round(explained_variance, 6) AS explained_variance, round(mape, 6) AS mape FROM m""")
def regression_metrics(spark, sf_dir):
    made = E.regression(table(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").alias("y_true"), (F.col("l_quantity") * 1500).alias("y_pred")))
    return made.withColumns({"mae": F.round("mae", 3), "mse": F.round(F.col("mse") / 1e6, 3), "rmse": F.round("rmse", 3), "median_ae": F.round("median_ae", 3)})


@query(_SCORES + pick(f"symbol timestamp ~close split ~future_rv_{H} y_high_vol_{H}_split_safe ~y_score", f"(SELECT safe.*, y_score FROM safe LEFT JOIN sc ON safe.symbol = sc.symbol AND safe.timestamp = sc.timestamp AND sc.split = 'test')"))  # noqa: F541
def timeline_left_join(spark, sf_dir):
    rows = staged(safe(spark, sf_dir), "safe")
    right = scored(spark, sf_dir, rows).where("split = 'test'").select("symbol", "timestamp", "y_score", "close")
    left = rows.select("symbol", "timestamp", "close", "split", f"future_rv_{H}", f"y_high_vol_{H}_split_safe")
    return T.join_predictions(left, right)


@query(_SCORES + pick(f"symbol timestamp ~close split ~future_rv_{H} y_high_vol_{H}_split_safe ~y_score", f"(SELECT safe.*, y_score FROM safe LEFT JOIN sc ON safe.symbol = sc.symbol AND safe.timestamp = sc.timestamp AND sc.split = 'test')"))  # noqa: F541
def timeline_of_buckets(spark, sf_dir):
    """The same from tables in buckets by symbol and time: the join deals neither side again."""
    rows = staged(safe(spark, sf_dir), "safe")
    right = scored(spark, sf_dir, rows).where("split = 'test'").select("symbol", "timestamp", "y_score", "close")
    left = rows.select("symbol", "timestamp", "close", "split", f"future_rv_{H}", f"y_high_vol_{H}_split_safe")
    names = [f"barloom_{side}_{uuid.uuid4().hex}" for side in ("rows", "scores")]
    for df, name in zip((left, right), names, strict=True):
        T.write_buckets(df, name, 8)
    return T.join_buckets(spark, *names)


@query(_SCORES + pick("symbol timestamp ~close", f"safe WHERE y_high_vol_{H}_split_safe = 1"))
def high_vol_overlay(spark, sf_dir):
    return T.overlay(safe(spark, sf_dir), f"y_high_vol_{H}_split_safe").select("symbol", "timestamp", "close")


@query(_SAFE + "SELECT split, count(*) AS n FROM safe GROUP BY split")
def split_counts(spark, sf_dir):
    return T.split_counts(safe(spark, sf_dir))


@query(ctes(BARS) + "SELECT min(timestamp) AS first, max(timestamp) AS last FROM bars")
def timeline_bounds(spark, sf_dir):
    return T.bounds(hourly(spark, sf_dir))


@query(_SAFE + f"""SELECT symbol, timestamp, CAST((SELECT y_high_vol_{H}_split_safe FROM safe WHERE split = 'train' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS INTEGER) AS prediction FROM safe WHERE split = 'test'""")
def majority_baseline(spark, sf_dir):
    rows, y = staged(safe(spark, sf_dir), "safe"), f"y_high_vol_{H}_split_safe"
    model = M.fit({"estimator": "majority"}, M.Dataset(rows.where("split = 'train'"), rows, rows, [], y))
    return model.transform(rows.where("split = 'test'")).select("symbol", "timestamp", F.col("y_pred").alias("prediction"))


# -- drift and freshness -----------------------------------------------------------------------------------------------------

_DRIFTED = ["open_close_return", "high_low_range_pct", "volume_change", "log_return_1"]
_LONG = "lg AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST(f1.{c} AS DOUBLE) AS value, CASE WHEN split = 'train' THEN 'reference' ELSE 'current' END AS side FROM f1 JOIN safe ON f1.symbol = safe.symbol AND f1.timestamp = safe.timestamp WHERE split IN ('train', 'test') AND f1.{c} IS NOT NULL" for c in _DRIFTED) + ")"


def _psi_sql(source: str, quantile: str = "quantile_cont") -> str:
    return f"""qs AS (SELECT feature, list_sort(list_distinct({quantile}(value, [{", ".join(f"{k / 10}" for k in range(11))}]))) AS q FROM {source} WHERE side = 'reference' GROUP BY feature),
 eg AS (SELECT feature, CASE WHEN len(q) > 2 THEN q[2:len(q) - 1] ELSE [] END AS edges FROM qs),
 bn AS (SELECT {source}.feature, side, len([e FOR e IN edges IF e <= value]) AS bin FROM {source} JOIN eg ON {source}.feature = eg.feature),
 ct AS (SELECT feature, bin, count(*) FILTER (side = 'reference') AS r, count(*) FILTER (side = 'current') AS c FROM bn GROUP BY 1, 2),
 tt AS (SELECT feature, sum(r) AS rn, sum(c) AS cn FROM ct GROUP BY 1),
 ev AS (SELECT feature, unnest(generate_series(0, len(edges))) AS bin FROM eg),
 sh AS (SELECT ev.feature, greatest(coalesce(r, 0) / rn, 1e-6) AS a, greatest(coalesce(c, 0) / cn, 1e-6) AS b FROM ev JOIN tt ON ev.feature = tt.feature LEFT JOIN ct ON ct.feature = ev.feature AND ct.bin = ev.bin),
 ps AS (SELECT feature, sum((b - a) * ln(b / a)) AS psi FROM sh GROUP BY feature),
 sv AS (SELECT feature, psi, CASE WHEN psi >= 0.25 THEN 'alert' WHEN psi >= 0.1 THEN 'warning' ELSE 'ok' END AS severity FROM ps)"""


_DRIFT = ctes(BARS, FEATURES_1, FUTURE, MASK, LIMIT, LABEL, SPLIT, _LONG, _psi_sql("lg"))
_SUMMARY = "count(value) AS n, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min, quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS p75, max(value) AS max"
_SUMMED = "n ~mean ~std ~min ~p25 ~median ~p75 ~max"


def sides(spark, sf_dir):
    bars = hourly(spark, sf_dir)
    made = bars.withColumns(X.bar_features(bars)).select("symbol", "timestamp", *_DRIFTED).join(safe(spark, sf_dir).select("symbol", "timestamp", "split"), ["symbol", "timestamp"])
    made = staged(made, "sides")
    return D.of_splits(made, "split", ["train"]), D.of_splits(made, "split", ["test"])


def _long(spark, sf_dir):
    a, b = sides(spark, sf_dir)
    return D.long_form(a, _DRIFTED, "reference").unionByName(D.long_form(b, _DRIFTED, "current"))


@query(ctes(BARS, FEATURES_1, FUTURE, MASK, LIMIT, LABEL, SPLIT, _LONG, _psi_sql("lg", "quantile_disc")) + pick("feature ~psi", "ps"))
def psi_from_sketches(spark, sf_dir):
    """From a sketch of each feature and day: as large as they come, so that they hold all values of these tables."""
    stored = [staged(D.day_sketches(side, _DRIFTED, 65535), "sketches") for side in sides(spark, sf_dir)]
    return D.sketched_stability(*[D.of_period(s) for s in stored])


@query(_DRIFT.rstrip() + f", s AS (SELECT feature, side, {_SUMMARY} FROM lg GROUP BY 1, 2) " + pick("feature side " + _SUMMED, "s"))
def numeric_summary(spark, sf_dir):
    return D.numeric_summary(_long(spark, sf_dir), ("feature", "side"))


@query(_DRIFT + "SELECT feature, CAST(len(edges) AS INTEGER) AS n_edges, round(list_min(edges), 6) AS lowest, round(list_max(edges), 6) AS highest FROM eg")
def psi_bins(spark, sf_dir):
    return D.bin_edges(_long(spark, sf_dir), 10).select("feature", F.size("edges").alias("n_edges"), F.array_min("edges").alias("lowest"), F.array_max("edges").alias("highest"))


@query(_DRIFT + pick("feature ~psi", "ps"))
def psi_feature(spark, sf_dir):
    return D.stability(_long(spark, sf_dir), 10)


@query(_DRIFT.rstrip() + f", s AS (SELECT feature, side, {_SUMMARY} FROM lg GROUP BY 1, 2), j AS (SELECT sv.feature, psi, severity, a.n AS reference_n, a.mean AS reference_mean, a.median AS reference_median, b.n AS current_n, b.mean AS current_mean, b.median AS current_median FROM sv JOIN s a ON a.feature = sv.feature AND a.side = 'reference' JOIN s b ON b.feature = sv.feature AND b.side = 'current') "
 + pick("feature ~psi severity reference_n ~reference_mean ~reference_median current_n ~current_mean ~current_median", "j"))
def feature_drift_table(spark, sf_dir):
    made = D.feature_drift(*sides(spark, sf_dir), _DRIFTED)
    return made.select("feature", "psi", "severity", *[f"{s}_{c}" for s in ("reference", "current") for c in ("n", "mean", "median")])


@query(_DRIFT + "SELECT severity, count(*) AS n FROM sv GROUP BY severity")
def severity_counts(spark, sf_dir):
    return D.severity_counts(D.feature_drift(*sides(spark, sf_dir), _DRIFTED))


@query(_SCORES.rstrip() + ", ls AS (SELECT 'y_score' AS feature, y_score AS value, CASE WHEN split = 'train' THEN 'reference' ELSE 'current' END AS side FROM sc WHERE split IN ('train', 'test')), " + _psi_sql("ls") +
 ", pr AS (SELECT sv.feature, psi, severity, (SELECT avg(CAST(value >= 0.5 AS INT)) FROM ls WHERE side = 'reference') AS reference_positive_rate, (SELECT avg(CAST(value >= 0.5 AS INT)) FROM ls WHERE side = 'current') AS current_positive_rate FROM sv) " + pick("feature ~psi severity ~reference_positive_rate ~current_positive_rate", "pr"))
def prediction_drift(spark, sf_dir):
    rows = staged(scored(spark, sf_dir), "scored")
    return D.prediction_drift(rows.where("split = 'train'"), rows.where("split = 'test'"), "y_score").select("feature", "psi", "severity", "reference_positive_rate", "current_positive_rate")


_FRESH = """fr AS (SELECT symbol, count(*) AS n_rows, min(timestamp) AS earliest, max(timestamp) AS latest FROM bars GROUP BY symbol),
 fm AS (SELECT fr.*, (SELECT count(*) FROM gone WHERE gone.symbol = fr.symbol) AS missing_count, (SELECT min(missing_timestamp) FROM gone WHERE gone.symbol = fr.symbol) AS first_missing FROM fr)"""


@query(ctes(BARS, MISSING, _FRESH) + "SELECT symbol, n_rows, earliest, latest, missing_count, first_missing, true AS is_fresh FROM fm")
def freshness_historical(spark, sf_dir):
    made = D.freshness(hourly(spark, sf_dir), HOUR)
    return made.select("symbol", "n_rows", "earliest", "latest", "missing_count", F.get("missing_preview", F.lit(0)).alias("first_missing"), "is_fresh")


@query(ctes(BARS, MISSING, _FRESH) + "SELECT true AS passed, CAST(sum(missing_count) AS BIGINT) AS total_missing FROM fm")
def freshness_total(spark, sf_dir):
    return D.freshness_overall(D.freshness(hourly(spark, sf_dir), HOUR))


REFERENCE_TIME = "2024-01-31 00:00:00"


@query(ctes(BARS, MISSING, _FRESH) + f"SELECT symbol, latest, round(epoch(TIMESTAMP '{REFERENCE_TIME}' - latest) / 60, 6) AS delay_minutes, epoch(TIMESTAMP '{REFERENCE_TIME}' - latest) / 60 <= 120 AS is_fresh FROM fm")
def freshness_live(spark, sf_dir):
    return D.freshness(hourly(spark, sf_dir), HOUR, "live", 120, REFERENCE_TIME).select("symbol", "latest", "delay_minutes", "is_fresh")


# -- fitted models: rows only ------------------------------------------------------------------------------------------------


def _dataset(spark, sf_dir) -> M.Dataset:
    names = [f"{s}_12" for s in ("rolling_realized_vol", "rolling_return_std", "volume_zscore", "rolling_drawdown")]
    made = X.build(hourly(spark, sf_dir), [12]).na.drop(subset=names).select("symbol", "timestamp", "close", *names)
    y = f"y_high_vol_{H}_split_safe"
    rows = made.join(safe(spark, sf_dir).select("symbol", "timestamp", "split", y), ["symbol", "timestamp"])
    return M.dataset(rows, names, y)


@query()
def logistic_scores(spark, sf_dir):
    data = _dataset(spark, sf_dir)
    return M.fit({"estimator": "logistic", "scale": True, "params": {"max_iter": 50}}, data).transform(data.test).select("symbol", "timestamp", "y_score", "y_pred")


@query()
def gbt_scores(spark, sf_dir):
    data = _dataset(spark, sf_dir)
    return M.fit({"estimator": "gbt", "params": {"max_iter": 5}}, data).transform(data.test).select("symbol", "timestamp", "y_score", "y_pred")


@query()
def batch_predict(spark, sf_dir):
    data = _dataset(spark, sf_dir)
    model = M.fit({"estimator": "logistic", "scale": True, "params": {"max_iter": 50}}, data)
    return M.batch_predict(hourly(spark, sf_dir), model, data.features, [12])


@query()
def boosted_scores(spark, sf_dir):
    data = _dataset(spark, sf_dir)
    return M.fit({"estimator": "boosted", "params": {"max_iter": 5}}, data).transform(data.test).select("symbol", "timestamp", "y_score", "y_pred")


_STUMP = """d AS (SELECT CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS y, CAST(l_quantity AS DOUBLE) AS a, CAST(l_discount AS DOUBLE) AS b, CAST(l_extendedprice AS DOUBLE) AS c FROM lineitem),
 base AS (SELECT avg(y) AS p FROM d), lg AS (SELECT 0 AS f, a AS v, y FROM d UNION ALL SELECT 1, b, y FROM d UNION ALL SELECT 2, c, y FROM d),
 hist AS (SELECT f, v, count(*) AS n, sum(y) AS s FROM lg GROUP BY f, v), wide AS (SELECT f, count(*) > 63 AS many FROM hist GROUP BY f),
 edges AS (SELECT f, (v + lead(v) OVER (PARTITION BY f ORDER BY v)) / 2 AS edge FROM hist JOIN wide USING (f) WHERE NOT many
   UNION ALL SELECT f, unnest(list_distinct(quantile_cont(v, [k / 63.0 FOR k IN range(1, 63)]))) FROM lg JOIN wide USING (f) WHERE many GROUP BY f),
 cut AS (SELECT e.f, e.edge, sum(n) AS nl, sum(s) AS sl FROM edges e JOIN hist h ON h.f = e.f AND h.v <= e.edge WHERE edge IS NOT NULL GROUP BY 1, 2),
 whole AS (SELECT count(*) AS n, sum(y) AS s FROM d),
 gains AS (SELECT cut.*, nl * p - sl AS gl, nl * p * (1 - p) AS hl, (n - nl) * p - (s - sl) AS gr, (n - nl) * p * (1 - p) AS hr, p, n - nl AS nr, s - sl AS sr FROM cut, base, whole WHERE nl >= 20 AND n - nl >= 20),
 best AS (SELECT * FROM gains ORDER BY gl * gl / hl + gr * gr / hr DESC, f, edge LIMIT 1),
 leaves AS (SELECT nl AS n, sl AS ones, -gl / hl AS x, p FROM best UNION ALL SELECT nr, sr, -gr / hr, p FROM best)"""


@query(ctes(_STUMP) + "SELECT round(1 / (1 + exp(-(ln(p / (1 - p)) + 0.05 * x))), 6) AS y_score, CAST(n AS BIGINT) AS n, CAST(ones AS BIGINT) AS ones FROM leaves")
def boosted_stump(spark, sf_dir):
    """One split of all line items: the best of three features' bins, by sums of gradients."""
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("y"), *[F.col(x).cast("double").alias(c) for c, x in (("a", "l_quantity"), ("b", "l_discount"), ("c", "l_extendedprice"))])
    model = BT.boost(rows, ["a", "b", "c"], "y", iterations=1, max_bins=63, rules=BT.Rules(max_leaf_nodes=2))
    return model.scored(rows).groupBy("y_score").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("ones"))


_RADIX_QS = [0.0, 0.01, 0.25, 0.5, 0.9, 0.999, 1.0]


@query(f"WITH w AS (SELECT l_returnflag AS k, quantile_cont(CAST(l_extendedprice AS DOUBLE), {_RADIX_QS}) AS v FROM lineitem GROUP BY 1) SELECT k, unnest(CAST({_RADIX_QS} AS DOUBLE[])) AS q, round(unnest(v), 6) AS value FROM w")
def quantiles_by_radix(spark, sf_dir):
    """All quantiles of all groups by four histograms of the bits, whatever the number of rows."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("k"), F.col("l_extendedprice").cast("double").alias("v"))
    return quantiles(rows, "v", _RADIX_QS, ("k",), small=0)
