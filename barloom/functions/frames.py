"""Trailing frames whose cost does not grow with their length.

A moving frame computes each row's window anew: n steps a row. Here rows of a symbol are cut into blocks of n. The last n rows of a row
are the end of one block and the start of the next, so two running aggregates do: one from the start of each block, and one from its
end, read n - 1 rows back. Both only grow, row by row. Counts, sums, extremes, and means with squared deviations merge without loss:
nothing is subtracted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.columns import ratio

#: (value, how, n, least): as trailing() in columns takes them.
Wanted = dict[str, tuple[Column, str, int, int]]


def _running(value: Column, how: str) -> dict[str, Column]:
    """The aggregates that a result of this kind is made of; equal names are equal aggregates."""
    kinds = {
        "mean": {"n": F.count(value), "sum": F.sum(value)},
        "sum": {"n": F.count(value), "sum": F.sum(value)},
        "std": {"n": F.count(value), "sum": F.sum(value), "variance": F.var_pop(value), "least": F.min(value), "most": F.max(value)},
        "energy": {"n": F.count(value), "squares": F.sum(value * value)},
        "max": {"n": F.count(value), "max": F.max(value)},
        "min": {"n": F.count(value), "min": F.min(value)},
    }
    if how not in kinds:
        raise ValueError(f"unknown aggregate {how!r}")
    return kinds[how]


def _merged(how: str, a: dict[str, Column], b: dict[str, Column]) -> tuple[Column, Column]:
    """(count, result) of two parts of a frame, of which the second may be missing."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    n, m = a["n"], F.coalesce(b["n"], F.lit(0).cast("long"))
    both = n + m
    if how in ("max", "min"):
        return both, (F.greatest if how == "max" else F.least)(a[how], b[how])
    if how == "energy":
        return both, F.sqrt(zero(a["squares"]) + zero(b["squares"]))
    total = zero(a["sum"]) + zero(b["sum"])
    if how == "sum":
        return both, F.when(both > 0, total)
    if how == "mean":
        return both, ratio(total, both)
    apart = F.coalesce(ratio(a["sum"], n) - ratio(b["sum"], m), F.lit(0.0))
    spread = zero(a["variance"]) * n + zero(b["variance"]) * m + F.coalesce(ratio(apart * apart * n * m, both), F.lit(0.0))
    # equal values have no spread, though a sum of them over their number may miss them by a last digit
    equal = F.least(a["least"], b["least"]) == F.greatest(a["most"], b["most"])
    return both, F.sqrt(ratio(F.when(equal, F.lit(0.0)).otherwise(spread), both - 1))


def with_trailing(df: DataFrame, wanted: Wanted, symbol: str = "symbol", timestamp: str = "timestamp") -> DataFrame:
    """Adds for each name the aggregate of a value over the last n rows of the symbol in time, null below `least` values.

    One exchange by symbol under all of them, and two sorts for each distinct n. Nulls don't count. Rows of one symbol and time have
    no order of their own, as in any frame by time.
    """
    if bad := [n for _, _, n, _ in wanted.values() if n < 1]:
        raise ValueError(f"frames need rows: {bad}")
    values: dict[str, str] = {}
    for value, _, _, _ in wanted.values():
        values.setdefault(str(value), f"_v{len(values)}")
    by_name = {values[str(value)]: value for value, _, _, _ in wanted.values()}
    kept = [*df.columns]
    df = df.withColumns({name: value.cast("double") for name, value in by_name.items()})
    df = df.withColumn("_place", F.row_number().over(Window.partitionBy(symbol).orderBy(timestamp)) - 1)
    for n in sorted({n for _, _, n, _ in wanted.values()}):
        mine = {name: (values[str(value)], how, least) for name, (value, how, m, least) in wanted.items() if m == n}
        df = df.withColumn("_block", F.floor(F.col("_place") / n))
        start = Window.partitionBy(symbol, "_block").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
        end = Window.partitionBy(symbol, "_block").orderBy(F.col("_place").desc()).rowsBetween(Window.unboundedPreceding, 0)
        back = Window.partitionBy(symbol).orderBy("_block", "_place")
        made = {f"{v}_{part}": agg for v, how, _ in mine.values() for part, agg in _running(F.col(v), how).items()}
        df = df.withColumn("_after", F.struct(*[agg.over(end).alias(c) for c, agg in made.items()]))
        # the rows that end a block fill their frame with it alone
        before = F.when(F.col("_place") % n < n - 1, F.lag("_after", n - 1).over(back))
        df = df.withColumns({f"_{c}": agg.over(start) for c, agg in made.items()} | {"_before": before})
        out = {}
        for name, (v, how, least) in mine.items():
            parts = _running(F.col(v), how)
            count, result = _merged(how, {p: F.col(f"_{v}_{p}") for p in parts}, {p: F.col(f"_before.{v}_{p}") for p in parts})
            out[name] = F.when(count >= least, result)
        kept = [*kept, *out]
        df = df.withColumns(out).drop("_block", "_after", "_before", *[f"_{c}" for c in made])
    return df.select(*kept)
