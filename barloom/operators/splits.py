"""Chronological splits with purge gaps, their checks, and walk-forward folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.columns import by_time
from barloom.operators import chunks, labels
from barloom.operators.bars import require
from barloom.sources.staging import staged
from barloom.sources.tables import with_times

SPLITS = ("train", "purge_train_validation", "validation", "purge_validation_test", "test")
MODEL_SPLITS = ("train", "validation", "test")


def _checked(df: DataFrame) -> DataFrame:
    n, bad = df.agg(F.count(F.lit(1)), F.count_if(F.col("timestamp").isNull())).first()
    if bad or not n:
        raise ValueError(f"{bad} of {n} rows have a null time" if n else "no rows to split")
    return df


def _typed(df: DataFrame, h: int) -> DataFrame:
    require(df, ("symbol", "timestamp", "close", f"future_rv_{h}", f"y_high_vol_{h}"), "splits")
    return with_times(df)


def prepared(df: DataFrame, h: int) -> DataFrame:
    """Input of splits, with UTC times. Raises on missing columns, an empty table and null times."""
    return _checked(_typed(df, h))


def build(df: DataFrame, h: int, train: float, validation: float, test: float, gap: int, q: float, placed: bool = False) -> DataFrame:
    """split and y_high_vol_h_split_safe of labelled rows, checked as prepared() does. The splits are written once: the checks, the
    threshold and the labels read them. placed: for few symbols with very many rows, by places from counts, without a task for each symbol."""
    made = _checked(staged((assign_placed if placed else assign)(_typed(df, h), train, validation, test, gap), "splits"))
    return safe_label(made, h, train_threshold(made, h, q))


def _named(at: Column, n: Column, train: float, validation: float, test: float, gap: int) -> Column:
    if abs(train + validation + test - 1) > 1e-9 or min(train, validation, test) <= 0:
        raise ValueError("fractions must be positive and add up to 1")
    if gap < 0:
        raise ValueError("the gap must not be negative")
    tb, vb = F.floor(n * F.lit(train)), F.floor(n * F.lit(train + validation))
    return (
        F.when(at < F.greatest(F.lit(0), tb - gap), SPLITS[0])
        .when(at < tb, SPLITS[1])
        .when(at < F.greatest(tb, vb - gap), SPLITS[2])
        .when(at < vb, SPLITS[3])
        .otherwise(SPLITS[4])
    )


def assign(df: DataFrame, train: float, validation: float, test: float, gap: int) -> DataFrame:
    """Adds split, by place within the symbol."""
    split = _named(F.col("_at"), F.col("_all"), train, validation, test, gap)
    at, n = F.row_number().over(by_time()) - 1, F.count(F.lit(1)).over(Window.partitionBy("symbol"))
    return df.withColumns({"_at": at, "_all": n}).withColumn("split", split).drop("_at", "_all")


def assign_placed(df: DataFrame, train: float, validation: float, test: float, gap: int) -> DataFrame:
    """assign() without a task for each symbol: places follow from counts per day."""
    split = _named(F.col("_at"), F.col("_all"), train, validation, test, gap)
    return chunks.placed(df, None, "_at", "_all").withColumn("split", split).drop("_at", "_all")


def train_threshold(df: DataFrame, h: int, q: float) -> DataFrame:
    return labels.threshold(df, h, q, F.col("split") == "train")


def safe_label(df: DataFrame, h: int, limit: DataFrame | float) -> DataFrame:
    return labels.binary_label(df, h, limit, f"y_high_vol_{h}_split_safe")


def _names(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    return df.sparkSession.createDataFrame([(k, s) for k, s in enumerate(names)], "position int, split string")


def summary(df: DataFrame, h: int) -> DataFrame:
    """A row for each split, empty ones included."""
    y = F.col(f"y_high_vol_{h}_split_safe")
    counts = df.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("start_time"), F.max("timestamp").alias("end_time"), F.avg(y).alias("positive_rate"))
    return _names(df, SPLITS).join(counts, "split", "left").select("position", "split", F.coalesce("n", F.lit(0)).cast("long").alias("n_rows"), "start_time", "end_time", "positive_rate")


def compare_labels(df: DataFrame, h: int) -> DataFrame:
    """Rows of each model split where both labels are there, and how many differ."""
    a, b = F.col(f"y_high_vol_{h}"), F.col(f"y_high_vol_{h}_split_safe")
    counts = df.where(a.isNotNull() & b.isNotNull()).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count_if(a != b).alias("changed"))
    rate = F.try_divide("num_changed", "rows_compared")
    joined = _names(df, MODEL_SPLITS).join(counts, "split", "left")
    return joined.select("split", F.coalesce("n", F.lit(0)).cast("long").alias("rows_compared"), F.coalesce("changed", F.lit(0)).cast("long").alias("num_changed")).withColumn("changed_rate", rate)


def _bounds(df: DataFrame) -> DataFrame:
    made = []
    for s in MODEL_SPLITS:
        t = F.when(F.col("split") == s, F.col("timestamp"))
        made += [F.count(t).alias(f"{s}_n"), F.min(t).alias(f"{s}_min"), F.max(t).alias(f"{s}_max")]
    return df.groupBy("symbol").agg(*made)


def shared_times(df: DataFrame) -> DataFrame:
    """(symbol, overlap): timestamps that two model splits share, each pair counted."""
    each = df.where(F.col("split").isin(*MODEL_SPLITS)).groupBy("symbol", "timestamp").agg(F.count_distinct("split").alias("k"))
    return each.groupBy("symbol").agg(F.sum((F.col("k") * (F.col("k") - 1) / 2).cast("long")).alias("overlap"))


def _checks(df: DataFrame, checks: dict[str, object]) -> DataFrame:
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("check_name"), F.coalesce(c, F.lit(False)).alias("passed")) for k, c in checks.items()]))
    return df.select("symbol", rows.alias("c")).select("symbol", "c.*")


def order_checks(df: DataFrame) -> DataFrame:
    """(symbol, check_name, passed): splits filled, in order, without a shared timestamp."""
    both = _bounds(df).join(shared_times(df), "symbol", "left")
    filled = (F.col("train_n") > 0) & (F.col("validation_n") > 0) & (F.col("test_n") > 0)
    ordered = (F.col("train_max") < F.col("validation_min")) & (F.col("validation_max") < F.col("test_min"))
    return _checks(both, {"splits_non_empty": filled, "splits_in_order": ordered, "splits_do_not_overlap": F.coalesce("overlap", F.lit(0)) == 0})


def purge_checks(df: DataFrame, h: int, seconds: int) -> DataFrame:
    """(symbol, check_name, passed): the horizon after a split's last row ends before the next split."""
    step = F.make_dt_interval(secs=F.lit(float(h * seconds)))
    first = F.col("train_max") + step < F.col("validation_min")
    return _checks(_bounds(df), {"purge_train_validation": first, "purge_validation_test": F.col("validation_max") + step < F.col("test_min")})


def raise_unless_passed(checks: DataFrame) -> None:
    """Raises if a check failed, or if there are none."""
    n, bad = checks.agg(F.count(F.lit(1)), F.count_if(~F.col("passed"))).first()
    if bad or not n:
        raise ValueError(f"{bad} of {n} split checks failed" if n else "no split checks")


def walk_forward(df: DataFrame, min_train: float, validation: float, step: float, gap: int) -> DataFrame:
    """Expanding folds of each symbol: row counts and times. Fold bounds are joined to the rows they name, not to ranges of rows;
    places follow from counts per day."""
    placed = staged(chunks.placed(df.select("symbol", "timestamp")).select("symbol", "timestamp", F.col("_row").alias("at")), "places")
    n = placed.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    sized = n.select("symbol", "n", F.floor(F.col("n") * F.lit(min_train)).alias("t0"), F.floor(F.col("n") * F.lit(validation)).alias("v"), F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(step))).alias("s"))
    last = F.col("n") - gap - F.col("v")
    ends = F.when((F.col("t0") > 0) & (F.col("v") > 0) & (last >= F.col("t0")), F.sequence(F.col("t0"), last, F.col("s")))
    folds = sized.select("symbol", "v", F.posexplode(ends).alias("fold", "train_rows"))
    folds = folds.select("symbol", (F.col("fold") + 1).cast("long").alias("fold"), "train_rows", F.col("v").alias("validation_rows"), (F.col("train_rows") + gap).alias("validation_start_row"))
    marks = folds.select("symbol", "fold", F.explode(F.array(
        F.struct(F.lit("train_start").alias("what"), F.lit(0).cast("long").alias("at")),
        F.struct(F.lit("train_end").alias("what"), (F.col("train_rows") - 1).alias("at")),
        F.struct(F.lit("validation_start").alias("what"), F.col("validation_start_row").alias("at")),
        F.struct(F.lit("validation_end").alias("what"), (F.col("validation_start_row") + F.col("validation_rows") - 1).alias("at")),
    )).alias("m")).select("symbol", "fold", "m.what", "m.at")
    times = marks.join(placed, ["symbol", "at"]).groupBy("symbol", "fold").pivot("what", ["train_start", "train_end", "validation_start", "validation_end"]).agg(F.first("timestamp"))
    return folds.drop("validation_start_row").join(times, ["symbol", "fold"])


def sliding(n: DataFrame, train: int, test: int, step: int | None = None) -> DataFrame:
    """Fixed-size folds over a table with a column n: (fold, train_start, train_end, test_start, test_end), ends exclusive."""
    if train <= 0 or test <= 0 or (step is not None and step < 0):
        raise ValueError("sizes must be positive")
    last = F.col("n") - train - test
    starts = F.when(last >= 0, F.sequence(F.lit(0).cast("long"), last.cast("long"), F.lit(step or test).cast("long")))
    keys = [c for c in n.columns if c != "n"]
    made = n.select(*keys, F.posexplode(starts).alias("fold", "a"))
    return made.select(*keys, F.col("fold").cast("long").alias("fold"), F.col("a").alias("train_start"), (F.col("a") + train).alias("train_end"), (F.col("a") + train).alias("test_start"), (F.col("a") + train + test).alias("test_end"))
