"""Order statistics of columns that may fit no single task.

Running sums: rows are dealt by ranges of the ordered column, each range adds up its own rows, and starts from the totals of the
ranges before it (one row per range and group). Quantiles: by radix selection. A double's bits as a whole number are in the order of
doubles; four histograms, of 16 bits each, lead to the value at every asked place. The bits are made once and written; they are read
and counted where they are, and only histograms are shuffled. Up to SMALL rows, which are counted first, one task takes either; both ways give the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.sources.staging import staged


#: Distinct rows that one task may hold.
SMALL = 1 << 20


def running(df: DataFrame, order: str, sums: tuple[str, ...], by: tuple[str, ...] = (), descending: bool = False, small: int = SMALL) -> DataFrame:
    """Rows of distinct (by, order) with upto_<c> (the sum of c over rows up to and with this one, in order) and all_<c> (the sum
    over all rows) for each c in sums. Written to the shared folder. Ranges are sampled from the rows."""
    spark = df.sparkSession
    df = staged(df, "counted")
    key = F.col(order).desc() if descending else F.col(order).asc()
    if df.count() <= small:
        upto, whole = Window.partitionBy(*by).orderBy(key).rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*by)
        return df.withColumns({f"upto_{c}": F.sum(c).over(upto) for c in sums} | {f"all_{c}": F.sum(c).over(whole) for c in sums})
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    within = Window.partitionBy(*by, "_range").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    ranged = df.repartitionByRange(n, *by, key).withColumn("_range", F.spark_partition_id())
    local = staged(ranged.withColumns({f"upto_{c}": F.sum(c).over(within) for c in sums}), "running")
    totals = local.groupBy(*by, "_range").agg(*[F.sum(c).alias(f"_{c}") for c in sums])
    each, before = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*by, "_range", *[F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"_before_{c}") for c in sums], *[F.sum(f"_{c}").over(each).alias(f"all_{c}") for c in sums])
    mine = [F.col(f"_by{k}") for k in range(len(by))]
    on = [F.col("_range") == F.col("_r"), *[F.col(b).eqNullSafe(m) for b, m in zip(by, mine, strict=True)]]
    named = starts.select(F.col("_range").alias("_r"), *[F.col(b).alias(f"_by{k}") for k, b in enumerate(by)], *[c for c in starts.columns if c.startswith(("_before_", "all_"))])
    joined = local.join(named, on)
    return joined.select(*df.columns, *[(F.col(f"upto_{c}") + F.col(f"_before_{c}")).alias(f"upto_{c}") for c in sums], *[f"all_{c}" for c in sums])


_UNIT = 1 << 52  # a double's exponent counts these


def _near(a: Column) -> Column:
    """The exponent of a number above 0, by a logarithm that may round up or down."""
    return F.greatest(F.least(F.floor(F.log2(a)), F.lit(1023)), F.lit(-1022))


def _scaled(a: Column, e: Column) -> Column:
    return a * F.pow(F.lit(2.0), -e)  # exact, as a power of two is


def _exponent(near: Column, part: Column) -> Column:
    return near + F.when(part >= 2, 1).when((part < 1) & (near > -1022), -1).otherwise(0)


def _joined(value: Column, a: Column, e: Column, m: Column) -> Column:
    """The bits from a number, its size, exponent and mantissa, which is below 1 for subnormal numbers alone."""
    size = F.when(m >= 1, (e + 1023) * F.lit(_UNIT) + ((m - 1) * _UNIT).cast("long")).otherwise((m * _UNIT).cast("long"))
    whole = F.when(F.isnan(value), F.lit(2047 * _UNIT + _UNIT // 2)).when(a == float("inf"), F.lit(2047 * _UNIT)).when(a == 0, F.lit(0).cast("long")).otherwise(size)
    return F.when(value < 0, -whole).otherwise(whole)


def bits_of(value: Column) -> Column:
    """The bits of a double as a long that is in the order of doubles: equal for both zeros, with NaN above all."""
    a = F.abs(value)
    near = _near(a)
    e = _exponent(near, _scaled(a, near))
    return _joined(value, a, e, _scaled(a, e))


def with_bits(df: DataFrame, value: str, name: str) -> DataFrame:
    """df with bits_of() a column. Each step is a column, worked out once a row; as one expression the first step stands in it many times."""
    v, a, e = F.col(value), F.col("_size"), F.col("_e")
    df = df.withColumn("_size", F.abs(v)).withColumn("_near", _near(a)).withColumn("_part", _scaled(a, F.col("_near")))
    df = df.withColumn("_e", _exponent(F.col("_near"), F.col("_part"))).withColumn("_m", _scaled(a, e))
    return df.withColumn(name, _joined(v, a, e, F.col("_m"))).drop("_size", "_near", "_part", "_e", "_m")


def double_of(bits: Column) -> Column:
    """The double that bits_of() made a long of."""
    size = F.abs(bits)
    e, two = F.shiftright(size, 52), F.lit(2.0)
    rest = (size - e * F.lit(_UNIT)).cast("double")
    odd = F.when(rest == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    value = F.when(e == 2047, odd).when(e == 0, rest * F.pow(two, F.lit(-1074))).otherwise((1 + rest / _UNIT) * F.pow(two, e - 1023))
    return F.when(bits < 0, -value).otherwise(value)


#: Chosen rows that are broadcast; beyond, rows meet them by exchange.
CHOSEN = 10_000


def _at_places(rows: DataFrame, qs: list[float], by: tuple[str, ...]) -> DataFrame:
    """(by, _q, _n, _r, _bits): the bits at both places around each quantile, from rows of by and _b. Four passes over rows."""
    same = lambda a, b: [F.col(x).eqNullSafe(F.col(y)) for x, y in zip(a, b, strict=True)]
    mine = [f"_by{k}" for k in range(len(by))]
    chosen = None
    for shift in (48, 32, 16, 0):
        held = rows
        if chosen is not None:
            wanted = chosen.select(*[F.col(b).alias(m) for b, m in zip(by, mine, strict=True)], F.col("_bits").alias("_above")).distinct()
            wanted = F.broadcast(wanted) if chosen.count() <= CHOSEN else wanted
            held = rows.join(wanted, [*same(by, mine), F.shiftright("_b", shift + 16) == F.col("_above")], "left_semi")
        counted = staged(held.groupBy(*by, F.shiftright("_b", shift).alias("_digit")).agg(F.count(F.lit(1)).alias("_k")), "digits")
        above = F.shiftright("_digit", 16) if shift < 48 else F.lit(0)
        upto = Window.partitionBy(*by, "_above").orderBy("_digit").rowsBetween(Window.unboundedPreceding, 0)
        ran = counted.withColumn("_above", above).withColumn("_upto", F.sum("_k").over(upto))
        if chosen is None:
            totals = counted.groupBy(*by).agg(F.sum("_k").alias("_n")).withColumn("_q", F.explode(F.array(*[F.lit(float(q)) for q in qs])))
            place = (F.col("_n") - 1) * F.col("_q")
            chosen = totals.withColumn("_r", F.explode(F.array_distinct(F.array(F.floor(place), F.ceil(place))))).withColumns({"_bits": F.lit(0).cast("long"), "_left": F.col("_r")})
        ran = ran.select(*[F.col(b).alias(m) for b, m in zip(by, mine, strict=True)], "_above", "_digit", (F.col("_upto") - F.col("_k")).alias("_before"), "_upto")
        # _left: how many rows with the same leading bits come before the place
        met = chosen.join(ran, [*same(by, mine), F.col("_bits") == F.col("_above"), F.col("_before") <= F.col("_left"), F.col("_left") < F.col("_upto")])
        chosen = staged(met.select(*by, "_q", "_n", "_r", F.col("_digit").alias("_bits"), (F.col("_left") - F.col("_before")).alias("_left")), "chosen")
    return chosen


def quantiles(df: DataFrame, column: str, qs: list[float], by: tuple[str, ...] = (), small: int = SMALL) -> DataFrame:
    """(by, q, value): exact quantiles with linear interpolation, as F.percentile gives, for each group; nulls don't count, NaN is
    the largest. Without values there are no rows."""
    rows = staged(df.select(*by, F.col(column).cast("double").alias("_v")).where("_v IS NOT NULL"), "values")
    if rows.count() <= small:
        asked = F.array(*[F.lit(float(q)) for q in qs])
        found = rows.groupBy(*by).agg(F.percentile("_v", asked).alias("_p")).where("_p IS NOT NULL")
        return found.select(*by, F.explode(F.arrays_zip(asked.alias("q"), F.col("_p").alias("value"))).alias("_z")).select(*by, "_z.*")
    at = (F.col("_n") - 1) * F.col("_q")
    value = double_of(F.col("_bits"))
    near = _at_places(staged(with_bits(rows, "_v", "_b").select(*by, "_b"), "bits"), qs, by)
    got = near.groupBy(*by, F.col("_q").alias("q")).agg(
        F.max(F.when(F.col("_r") == F.floor(at), value)).alias("_low"), F.max(F.when(F.col("_r") == F.ceil(at), value)).alias("_high"), F.max(at - F.floor(at)).alias("_part")
    )
    between = (1 - F.col("_part")) * F.col("_low") + F.col("_part") * F.col("_high")
    return got.select(*by, "q", F.when((F.col("_part") == 0) | (F.col("_low") == F.col("_high")), F.col("_low")).otherwise(between).alias("value"))


def quantile_arrays(df: DataFrame, column: str, qs: list[float], by: tuple[str, ...] = (), small: int = SMALL) -> DataFrame:
    """(by, q): the quantiles of each group as an array, in the order of qs. One row per group."""
    made = quantiles(df, column, qs, by, small).groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("q", "value"))).alias("_m"))
    return made.select(*by, F.array(*[pick("_m", q) for q in qs]).alias("q"))


def pick(name: str, q: float) -> Column:
    return F.element_at(F.col(name), F.lit(float(q)))
