"""Data-quality checks of bars: issue rows (check_name, severity, passed, count, message)."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from barloom.functions.columns import by_time, log
from barloom.operators import chunks
from barloom.operators.bars import CORE, OPTIONAL
from barloom.sources.staging import staged

ISSUE = "check_name string, severity string, passed boolean, count long, message string"
#: Rules on values: what a broken row looks like. Comparisons with null break nothing.
RULES: dict[str, str] = {
    "ohlc_prices_positive": "open <= 0 OR high <= 0 OR low <= 0 OR close <= 0",
    "volume_non_negative": "volume < 0",
    "high_not_below_open": "high < open",
    "high_not_below_close": "high < close",
    "low_not_above_open": "low > open",
    "low_not_above_close": "low > close",
    "high_not_below_low": "high < low",
}


def _issues(df: DataFrame, rows: list[tuple[str, str, bool | None, int, str]]) -> DataFrame:
    """passed None: passed if the count is 0."""
    made = [(name, kind, n == 0 if passed is None else passed, int(n), text) for name, kind, passed, n, text in rows]
    return df.sparkSession.createDataFrame(made, ISSUE)


def schema_issues(df: DataFrame) -> DataFrame:
    missing, optional = [c for c in CORE if c not in df.columns], [c for c in OPTIONAL if c not in df.columns]
    extra = [c for c in df.columns if c not in CORE + OPTIONAL and not c.startswith("_")]
    return _issues(df, [
        ("required_columns_exist", "ERROR", None, len(missing), f"missing: {missing}"),
        ("optional_columns_present", "WARNING", None, len(optional), f"missing: {optional}"),
        ("extra_columns_detected", "INFO", True, len(extra), f"extra: {extra}"),
    ])


def null_counts(df: DataFrame) -> DataFrame:
    """(column, null_count), in one pass."""
    columns = [c for c in df.columns if not c.startswith("_")]
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counts.unpivot([], columns, "column", "null_count").orderBy(F.desc("null_count"), "column")


def duplicates(df: DataFrame, key: list[str]) -> DataFrame:
    """All rows whose key occurs more than once (nulls are equal to one another)."""
    return df.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*key))).where("_n > 1").drop("_n")


def unsorted_symbols(df: DataFrame, order: str = "_ingest_order") -> DataFrame:
    """Symbols whose rows, in the order they came in, step back in time."""
    before = F.lag("timestamp").over(Window.partitionBy("symbol").orderBy(order))
    return df.withColumn("_b", before).where(F.col("timestamp") < F.col("_b")).select("symbol").distinct()


def globally_sorted(df: DataFrame, order: str = "_ingest_order") -> DataFrame:
    """One row: whether no row of the whole table, in the order it came in, steps back in time. Partitions by ranges of the
    order; each range hands on its bounds, so no window spans the table. An empty table is sorted."""
    ranged = df.select(F.col(order).alias("o"), "timestamp").repartitionByRange("o").withColumn("p", F.spark_partition_id())
    inner = ranged.withColumn("b", F.lag("timestamp").over(Window.partitionBy("p").orderBy("o")))
    bounds = inner.groupBy("p").agg(F.count_if(F.col("timestamp") < F.col("b")).alias("bad"), F.min_by("timestamp", "o").alias("first"), F.max_by("timestamp", "o").alias("last"), F.min("o").alias("o"))
    after = bounds.withColumn("prior", F.lag("last").over(Window.orderBy("o")))  # a row per partition
    return after.agg((F.coalesce(F.sum("bad"), F.lit(0)) + F.count_if(F.col("first") < F.col("prior")) == 0).alias("is_sorted"))


def irregular_gaps(df: DataFrame, seconds: int) -> DataFrame:
    """(symbol, irregular): steps between consecutive distinct timestamps that differ from the interval."""
    seen = df.select("symbol", "timestamp").distinct()
    step = F.unix_micros(F.col("timestamp").cast("timestamp")) - F.unix_micros(F.lag("timestamp").over(by_time()).cast("timestamp"))
    return seen.withColumn("_s", step).groupBy("symbol").agg(F.count_if(F.col("_s") != seconds * 1_000_000).alias("irregular"))


#: Steps of the grid that are looked at together, and that one row lists at most.
GRID_CHUNK = 4096


def gaps(df: DataFrame, seconds: int, chunk: int = GRID_CHUNK) -> DataFrame:
    """(symbol, first, n, step): runs of n times, step microseconds apart from `first` on, that the grid of a symbol has between its
    first bar and its last, and that no bar has. Bars off the grid fill nothing.

    Times are compared with the next one within chunks of the grid; the last of each chunk with the first of the next that has
    any. No row lists a grid, and no task holds a symbol.
    """
    step = seconds * 1_000_000
    t = F.unix_micros(F.col("timestamp").cast("timestamp"))
    rows = staged(df.where("timestamp IS NOT NULL").select("symbol", t.alias("t")), "times")
    spans = rows.groupBy("symbol").agg(F.min("t").alias("a"), F.max("t").alias("b")).withColumnRenamed("symbol", "s")
    met = rows.join(spans, F.col("symbol").eqNullSafe(F.col("s"))).drop("s")
    grid = met.where((F.col("t") - F.col("a")) % step == 0).withColumn("c", F.floor((F.col("t") - F.col("a")) / (step * chunk)))
    inner = grid.withColumn("after", F.lead("t").over(Window.partitionBy("symbol", "c").orderBy("t"))).select("symbol", "t", "after")
    ends = grid.groupBy("symbol", "c").agg(F.min("t").alias("low"), F.max("t").alias("t"), F.first("a").alias("a"), F.first("b").alias("b"))
    last = F.col("a") + F.floor((F.col("b") - F.col("a")) / step) * step  # of the grid
    following = F.lead("low").over(Window.partitionBy("symbol").orderBy("c"))  # a row per chunk
    outer = ends.withColumn("after", F.coalesce(following, last + step)).select("symbol", "t", "after")
    holes = inner.unionByName(outer).where(F.col("after") - F.col("t") > step)
    return holes.select("symbol", (F.col("t") + step).alias("first"), F.expr(f"(after - t) div {step} - 1").alias("n"), F.lit(step).cast("long").alias("step"))


def listed(holes: DataFrame, kind: str, most: int | None = None, chunk: int = GRID_CHUNK) -> DataFrame:
    """(symbol, missing_timestamp) of gaps, or of the first `most` times of each gap; a long gap is first cut into parts."""
    n = F.col("n") if most is None else F.least("n", F.lit(most))
    parts = holes.withColumn("_n", n).withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(chunk).cast("long"))))
    each = F.sequence(F.col("_k"), F.least(F.col("_k") + chunk, F.col("_n")) - 1)
    return parts.select("symbol", "first", "step", F.explode(each).alias("_i")).select("symbol", F.timestamp_micros(F.col("first") + F.col("_i") * F.col("step")).cast(kind).alias("missing_timestamp"))


def missing_bars(df: DataFrame, seconds: int) -> DataFrame:
    """(symbol, missing_timestamp): the grid from each symbol's first bar to its last, without the bars that are there."""
    return listed(gaps(df, seconds), df.schema["timestamp"].dataType.simpleString())


def first_missing(holes: DataFrame, kind: str, most: int) -> DataFrame:
    """(symbol, m, missing_preview): how many bars are missing, and the first `most` of them in order. Tasks keep that many gaps of a
    symbol, then that many times."""
    sums = holes.groupBy("symbol").agg(F.sum("n").alias("m")).withColumnRenamed("symbol", "s")
    turn = lambda by: F.row_number().over(Window.partitionBy("symbol").orderBy(by))
    few = holes.withColumn("_k", turn("first")).where(F.col("_k") <= most).drop("_k")
    times = listed(few, kind, most).withColumn("_k", turn("missing_timestamp")).where(F.col("_k") <= most)
    shown = times.groupBy("symbol").agg(F.sort_array(F.collect_list("missing_timestamp")).alias("missing_preview"))
    return sums.join(shown, F.col("s").eqNullSafe(F.col("symbol"))).select("symbol", "m", "missing_preview")


def rule_counts(df: DataFrame) -> DataFrame:
    """(check_name, violations), in one pass."""
    counts = df.agg(*[F.count_if(F.expr(rule)).alias(name) for name, rule in RULES.items()])
    return counts.unpivot([], list(RULES), "check_name", "violations")


def failed_rows(df: DataFrame, most: int = 20) -> DataFrame:
    """The first rows (by symbol and time) that break each rule, after its name: a preview."""
    broken = F.explode(F.array_compact(F.array(*[F.when(F.expr(r), F.lit(k)) for k, r in RULES.items()]))).alias("failed_check")
    rows = df.where(" OR ".join(f"({r})" for r in RULES.values())).select(broken, "*")
    turn = F.row_number().over(Window.partitionBy("failed_check").orderBy("symbol", "timestamp", *[c for c in ("open", "high", "low", "close") if c in df.columns]))
    return rows.withColumn("_t", turn).where(F.col("_t") <= most).drop("_t")


def extreme_returns(df: DataFrame, limit: float = 0.10) -> DataFrame:
    """Rows whose log return exceeds the limit either way."""
    r = log(F.col("close")) - F.lag(log(F.col("close"))).over(by_time())
    return df.withColumn("log_return", r).where(F.abs("log_return") > limit)


def extreme_returns_chunked(df: DataFrame, rows: int, limit: float = 0.10) -> DataFrame:
    """extreme_returns() for few symbols with very many rows, `rows` rows at a time."""
    return chunks.in_chunks(df, 1, 0, rows, lambda part: extreme_returns(part, limit))


def irregular_gaps_chunked(df: DataFrame, seconds: int, rows: int) -> DataFrame:
    """irregular_gaps() for few symbols with very many rows: each distinct time with the one before it, `rows` rows at a time."""
    step = F.unix_micros(F.col("timestamp").cast("timestamp")) - F.unix_micros(F.lag("timestamp").over(by_time()).cast("timestamp"))
    made = chunks.in_chunks(df.select("symbol", "timestamp").distinct(), 1, 0, rows, lambda part: part.withColumn("_s", step))
    return made.groupBy("symbol").agg(F.count_if(F.col("_s") != seconds * 1_000_000).alias("irregular"))


def unsorted_symbols_ranged(df: DataFrame, order: str = "_ingest_order") -> DataFrame:
    """unsorted_symbols() by ranges of the order of arrival: each hands on the last row of each symbol to the next."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = staged(df.select("symbol", "timestamp", F.col(order).alias("_o")).repartitionByRange(n, "_o").withColumn("_p", F.spark_partition_id()), "arrival")
    inner = ranged.withColumn("_b", F.lag("timestamp").over(Window.partitionBy("symbol", "_p").orderBy("_o")))
    ends = inner.groupBy("symbol", "_p").agg(F.count_if(F.col("timestamp") < F.col("_b")).alias("bad"), F.min_by("timestamp", "_o").alias("first"), F.max_by("timestamp", "_o").alias("last"))
    after = ends.withColumn("prior", F.lag("last").over(Window.partitionBy("symbol").orderBy("_p")))  # a row per range
    return after.where((F.col("bad") > 0) | (F.col("first") < F.col("prior"))).select("symbol").distinct()


def _time_counts(df: DataFrame, seconds: int, extreme: float) -> dict[str, int]:
    """One pass by symbol and time: rows of repeated keys, uneven steps, missing bars and extreme returns."""
    w, each = by_time(), Window.partitionBy("symbol")
    t = F.unix_micros(F.col("timestamp").cast("timestamp"))
    step = seconds * 1_000_000
    close = log(F.col("close").cast("double")) if "close" in df.columns else F.lit(None).cast("double")
    seen = df.select("symbol", "timestamp", t.alias("_t"), close.alias("_c"))
    near = seen.withColumns({"_before": F.lag("_t").over(w), "_after": F.lead("_t").over(w), "_first": F.min("_t").over(each), "_move": F.col("_c") - F.lag("_c").over(w)})
    fresh = F.col("_before").isNull() | (F.col("_t") != F.col("_before"))
    rows = near.where("_t IS NOT NULL").groupBy("symbol").agg(
        F.count_if(F.coalesce(F.col("_t") == F.col("_before"), F.lit(False)) | F.coalesce(F.col("_t") == F.col("_after"), F.lit(False))).alias("repeated"),
        F.count_if(fresh & (F.col("_t") - F.col("_before") != step)).alias("uneven"),
        F.count_if(fresh & ((F.col("_t") - F.col("_first")) % step == 0)).alias("on_grid"),
        (F.floor((F.max("_t") - F.min("_t")) / step) + 1).alias("grid"),
    )
    moves = near.agg(F.count_if(F.abs("_move") > extreme).alias("extreme"))
    sums = rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("repeated", "uneven", "on_grid", "grid")])
    return sums.crossJoin(F.broadcast(moves)).first().asDict()  # one row each


def _time_counts_chunked(df: DataFrame, seconds: int, extreme: float, chunk_rows: int) -> dict[str, int]:
    """_time_counts() without a task for each symbol: by chunks of rows, and of the grid."""
    key = ["symbol", "timestamp"]
    timed = df.where("timestamp IS NOT NULL")
    total = lambda rows, c: rows.agg(F.coalesce(F.sum(c), F.lit(0))).first()[0]
    close = df.withColumn("close", F.col("close").cast("double")).select(*key, "close") if "close" in df.columns else None
    return {
        "repeated": total(timed.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "n"),
        "uneven": total(irregular_gaps_chunked(timed.select(*key), seconds, chunk_rows), "irregular"),
        "grid": total(gaps(timed.select(*key), seconds), "n"),
        "on_grid": 0,
        "extreme": extreme_returns_chunked(close, chunk_rows, extreme).count() if close is not None else 0,
    }


def validate(df: DataFrame, seconds: int, extreme: float = 0.10, chunk_rows: int | None = None) -> DataFrame:
    """All issues of a table of bars. Columns that a check needs and that are missing give an issue in its place; where some times are
    null the other checks of time are skipped.

    The table is written once; nulls and rules are counted while it is. One window by time, one by arrival, and one count of equal
    rows read it. Each hands one row to the driver. chunk_rows: for few symbols with very many rows, the checks of time by chunks of
    that many rows instead of a window for each symbol.
    """
    plain = [c for c in df.columns if not c.startswith("_")]
    prices = [c for c in ("open", "high", "low", "close", "volume") if c not in df.columns]
    rules = {} if prices else RULES
    seen = Observation()
    df = staged(df.observe(seen, F.count(F.lit(1)).alias("_rows"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"null_{k}") for k, c in enumerate(plain)], *[F.count_if(F.expr(r)).alias(k) for k, r in rules.items()]), "checked")
    sums = defaultdict(int, seen.get)
    nulls = {c: sums[f"null_{k}"] for k, c in enumerate(plain)}
    rows = [
        ("core_null_values", "ERROR", None, sum(n for c, n in nulls.items() if c in CORE)),
        ("total_null_values_counted", "INFO", True, sum(nulls.values())),
    ]
    keyed = not {"symbol", "timestamp"} - set(df.columns)
    counted = (lambda d, s, e: _time_counts_chunked(d, s, e, chunk_rows)) if chunk_rows else _time_counts
    times = counted(df, seconds, extreme) if keyed else {}
    if not keyed:
        rows += [(f"{c}_column_exists", "ERROR", False, 1) for c in ("timestamp", "symbol") if c not in df.columns][:1]
    else:
        rows.append(("timestamps_parse_as_utc", "ERROR", None, nulls["timestamp"]))
        if not nulls["timestamp"]:
            back = unsorted_symbols_ranged(df).count() if "_ingest_order" in df.columns else 0
            rows += [
                ("timestamps_unique_within_symbol", "ERROR", None, times["repeated"]),
                ("timestamps_sorted_within_symbol", "ERROR", None, back),
                ("expected_interval_consistent", "WARNING", None, times["uneven"]),
                ("missing_intervals_counted", "WARNING", None, times["grid"] - times["on_grid"]),
            ]
    again = df.groupBy(*[f"`{c}`" for c in plain]).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    rows.append(("no_duplicate_rows", "ERROR", None, again))
    if prices:
        rows.append(("ohlcv_columns_exist", "ERROR", False, len(prices)))
    else:
        rows += [(k, "ERROR", None, sums[k]) for k in RULES]
        rows.append(("extreme_returns_flagged", "WARNING", None, times["extreme"]) if keyed else ("extreme_return_required_columns_exist", "ERROR", False, 1))
    return schema_issues(df).unionByName(_issues(df, [(*r, f"{r[3]} for {r[0]}") for r in rows]))


def summarize(issues: DataFrame) -> DataFrame:
    failed = ~F.col("passed")
    return issues.agg(
        F.count(F.lit(1)).alias("total_checks"),
        F.count_if(failed).alias("failed_checks"),
        F.count_if(failed & (F.col("severity") == "ERROR")).alias("failed_errors"),
        F.count_if(failed & (F.col("severity") == "WARNING")).alias("failed_warnings"),
    ).withColumn("can_continue", F.col("failed_errors") == 0)


def exit_code(issues: DataFrame, fail_on_warning: bool = False) -> int:
    row = summarize(issues).first()
    return int(row.failed_errors > 0 or (fail_on_warning and row.failed_warnings > 0))
