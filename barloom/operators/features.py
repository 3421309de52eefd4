"""Backward-looking features of bars: nine of the bar itself, eleven of each trailing window."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.columns import by_time, change, least_periods, log, ratio, trailing
from barloom.functions.frames import with_trailing
from barloom.operators import chunks
from barloom.operators.bars import CORE, OPTIONAL, require

#: Name starts of columns that look ahead.
AHEAD = ("future_", "target", "label", "y_")
NOT_FEATURES = frozenset((*CORE, *OPTIONAL, "log_close", "split", "used_for_label_threshold"))


def bar_features(bars: DataFrame) -> dict[str, Column]:
    w = by_time()
    o, h, lo, c = (F.col(x) for x in ("open", "high", "low", "close"))
    out = {
        "log_return_1": log(c) - F.lag(log(c)).over(w),
        "open_close_return": ratio(c - o, o),
        "high_low_range_pct": ratio(h - lo, o),
        "candle_body_pct": ratio(F.abs(c - o), o),
        "upper_wick_pct": ratio(h - F.greatest(o, c), o),
        "lower_wick_pct": ratio(F.least(o, c) - lo, o),
        "volume_change": change(F.col("volume"), w),
    }
    return out | {f"{x}_change": change(F.col(x).cast("double"), w) for x in OPTIONAL if x in bars.columns}


#: Up to this many rows a moving frame is cheaper than the sorts that a frame of any length takes.
MOVING = 16


def window_features(windows: list[int], policy: str = "full_window", trail: Callable[[Column, str, int], Column] | None = None) -> dict[str, Column]:
    """Over columns of a table that has bar_features(). trail: the column of an aggregate of a value over the last n rows, a moving
    frame unless given."""
    w, r = by_time(), F.col("log_return_1")
    over = trail or (lambda value, how, n: trailing(value, n, how, w, least_periods(n, policy)))
    out: dict[str, Column] = {}
    for n in windows:
        if n <= 0:
            raise ValueError(f"windows must be positive: {n}")

        def t(value: Column, how: str, n: int = n) -> Column:
            return over(value, how, n)

        v, c = F.col("volume"), F.col("close")
        mean, std = t(v, "mean"), t(v, "std")
        out |= {
            f"rolling_return_mean_{n}": t(r, "mean"),
            f"rolling_return_std_{n}": t(r, "std"),
            f"rolling_abs_return_mean_{n}": t(F.abs(r), "mean"),
            f"rolling_realized_vol_{n}": t(r, "energy"),
            f"rolling_volume_mean_{n}": mean,
            f"rolling_volume_std_{n}": std,
            f"volume_zscore_{n}": ratio(v - mean, std),
            f"rolling_high_low_range_mean_{n}": t(F.col("high_low_range_pct"), "mean"),
            f"rolling_drawdown_{n}": ratio(c, t(c, "max")) - 1,
            f"distance_from_rolling_high_{n}": ratio(c, t(F.col("high"), "max")) - 1,
            f"distance_from_rolling_low_{n}": ratio(c, t(F.col("low"), "min")) - 1,
        }
    return out


def with_windows(df: DataFrame, windows: list[int], policy: str = "full_window", moving: int = MOVING) -> DataFrame:
    """Adds window_features(): by moving frames up to `moving` rows, beyond by frames whose cost doesn't grow with their length."""
    wide = [n for n in windows if n > moving]
    df = df.withColumns(window_features([n for n in windows if n <= moving], policy)) if len(wide) < len(windows) else df
    wanted: dict[str, tuple[Column, str, int, int]] = {}
    named: dict[tuple[str, str, int], str] = {}

    def trail(value: Column, how: str, n: int) -> Column:
        name = named.setdefault((str(value), how, n), f"_trail{len(named)}")
        wanted[name] = (value, how, n, least_periods(n, policy))
        return F.col(name)

    made = window_features(wide, policy, trail)
    return with_trailing(df, wanted).withColumns(made).drop(*wanted) if wide else df


def build(bars: DataFrame, windows: list[int], policy: str = "full_window", moving: int = MOVING) -> DataFrame:
    """Bars with all features: one exchange by symbol under all windows. Batch and serving both use this."""
    require(bars, CORE, "features")
    return with_windows(bars.withColumns(bar_features(bars)), windows, policy, moving)


def build_chunked(bars: DataFrame, windows: list[int], chunk_rows: int, policy: str = "full_window") -> DataFrame:
    """The same for few symbols with very many rows: time is cut into chunks of chunk_rows rows of a symbol, each with the rows before
    it that its frames reach."""
    return chunks.in_chunks(bars, max(windows) + 1, 0, chunk_rows, lambda part: build(part, windows, policy))


def feature_columns(df: DataFrame, more: frozenset[str] = frozenset()) -> list[str]:
    """Columns that may be features: no raw or helper column, no name that looks ahead."""
    return [c for c in df.columns if c not in NOT_FEATURES | more and not c.startswith(("_", *AHEAD))]


def resolve_columns(df: DataFrame, schema: dict | None = None) -> list[str]:
    """Feature columns by a stored schema, else by name; names that look ahead or are missing raise."""
    found = list(schema["feature_columns"]) if schema and schema.get("feature_columns") else feature_columns(df)
    if bad := [c for c in found if c in NOT_FEATURES or c.startswith(AHEAD)]:
        raise ValueError(f"columns that must not be features: {bad}")
    if missing := [c for c in found if c not in df.columns]:
        raise ValueError(f"missing feature columns: {missing}")
    return found


def missingness(df: DataFrame, columns: list[str], windows: list[int]) -> DataFrame:
    """(feature, missing_count, missing_pct, interpretation): one pass over the table, then one row per column."""
    counts = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    long = counts.unpivot("n", list(columns), "feature", "missing_count")
    most = max(windows, default=0) + 5
    meaning = (
        F.when(F.col("missing_count") == 0, "no_missing_values")
        .when(F.col("missing_count") >= F.col("n"), "suspicious_all_values_missing")
        .when(F.col("missing_count") <= most, "expected_rolling_warmup")
        .otherwise("inspect_more_missing_than_expected")
    )
    pct = ratio(100.0 * F.col("missing_count"), F.col("n"))
    return long.select("feature", "missing_count", pct.alias("missing_pct"), meaning.alias("interpretation"))


def model_table(features: DataFrame, columns: list[str], drop_missing: bool = True) -> DataFrame:
    """Key, close and features; rows with a missing feature are left out, and an empty result raises."""
    out = features.select("symbol", "timestamp", "close", *columns)
    out = out.na.drop(subset=columns) if drop_missing else out
    if out.isEmpty():
        raise ValueError("no rows are left")
    return out


def past_only_check(bars: DataFrame, windows: list[int], policy: str = "full_window", made: Callable[[DataFrame, list[int], str], DataFrame] | None = None) -> DataFrame:
    """(symbol, compared, max_abs_diff): features at row max(windows) + 10 of each symbol, from all rows and from none after it.
    made: what builds the features, build() unless given."""
    maker = made or build
    at = max(windows) + 10
    place = F.row_number().over(by_time()) - 1
    cut = bars.withColumn("_at", place).where(F.col("_at") <= at).drop("_at")

    def here(df: DataFrame) -> DataFrame:
        made = maker(df, windows, policy)
        columns = feature_columns(made)
        return made.withColumn("_at", place).where(F.col("_at") == at).select("symbol", *[F.col(c).alias(f"_f{k}") for k, c in enumerate(columns)])

    full, prefix = here(bars), here(cut)
    n = len(full.columns) - 1
    other = prefix.select(F.col("symbol").alias("_s"), *[F.col(f"_f{k}").alias(f"_p{k}") for k in range(n)])
    gaps = [F.abs(F.col(f"_f{k}") - F.col(f"_p{k}")) for k in range(n)]
    odd = [F.col(f"_f{k}").isNull() != F.col(f"_p{k}").isNull() for k in range(n)]
    joined = full.join(other, F.col("symbol") == F.col("_s"))
    worst = F.coalesce(F.greatest(*gaps), F.lit(float("inf")))
    broken = odd[0]
    for o in odd[1:]:
        broken = broken | o
    return joined.select("symbol", F.lit(n).cast("long").alias("compared"), F.when(broken, float("inf")).otherwise(worst).alias("max_abs_diff"))
