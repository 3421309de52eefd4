"""Mixing of sources to target weights, by Pfair schedules.

A source of weight w is a periodic task: its block j (from 0) is released at slot floor(j / w) and due by slot ceil((j + 1) / w).
Every slot takes one released block, that with the earliest deadline. Weights are the targets themselves, as ratios of whole
numbers without rounding, so at every slot each source is less than one block away from its target, however long the mix is.

The schedule depends on what came before, so one task runs it, slot by slot: it holds a few numbers for each source, reads their
block counts and writes a row for each block. Rows take their slots in the exchange that ranks them, where the schedule's rows
meet them by source and salt. Ranks within a source are counted by salt: a source with a third of all rows is counted in many
tasks. No source and no block passes through the driver.
"""

from __future__ import annotations

import heapq
import itertools
import math
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import BLOCKS_PER_PARTITION, partitions

#: Rows of a block, and scheduled blocks that are handed on at a time.
BLOCK_ROWS, BATCH = 8, 1 << 16


def whole_weights(weights: dict[str | None, float], period: int | None = None) -> dict[str | None, int]:
    """Whole numbers in exactly the ratios of the positive weights: each source's slots in as many slots as their sum.

    With a period they are rounded to that many slots, by largest remainders; every source gets one at least, and with more
    sources than slots the period is as long as there are sources."""
    some = {s: w for s, w in weights.items() if w > 0}
    if not some:
        return {}
    if period is None:
        ratios = {s: Fraction(w) for s, w in some.items()}
        scale = math.lcm(*(r.denominator for r in ratios.values()))
        whole = {s: r.numerator * (scale // r.denominator) for s, r in ratios.items()}
        least = math.gcd(*whole.values())
        return {s: x // least for s, x in whole.items()}
    period, total = max(period, len(some)), sum(some.values())
    exact = {s: w * period / total for s, w in some.items()}
    slots = {s: max(1, int(x)) for s, x in exact.items()}
    by_rest = sorted(exact, key=lambda s: (slots[s] - exact[s], s is not None, s or ""))
    k = 0
    while sum(slots.values()) < period:
        slots[by_rest[k % len(by_rest)]] += 1
        k += 1
    while sum(slots.values()) > period:
        s = max((s for s in slots if slots[s] > 1), key=lambda s: slots[s] - exact[s])
        slots[s] -= 1
    return slots


def schedule(slots: dict[str | None, int], blocks: dict[str | None, int] | None = None) -> Iterator[tuple[str | None, int, int, int, int]]:
    """(source, block, slot, release, deadline), earliest deadline first; ties by source.

    Ends when each source has its `blocks`, or after one period. Sources that have theirs still take their slots, which are left
    out."""
    period, blocks = sum(slots.values()), slots if blocks is None else blocks
    names = sorted(slots, key=lambda s: (s is not None, s or ""))
    rates, wanted = [slots[s] for s in names], [blocks.get(s, 0) for s in names]
    waiting = [(0, i, 0) for i in range(len(names))]  # (release, source, block)
    ready: list[tuple[int, int, int, int]] = []
    slot, left = 0, sum(wanted)
    while left:
        while waiting and waiting[0][0] <= slot:
            release, i, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * period // rates[i]), i, j, release))
        deadline, i, j, release = heapq.heappop(ready)
        if j < wanted[i]:
            yield names[i], j, slot, release, deadline
            left -= 1
        heapq.heappush(waiting, ((j + 1) * period // rates[i], i, j + 1))
        slot += 1


def root_weight(rows: int) -> float:
    """The default target: the square root of a source's number of rows."""
    return math.sqrt(rows)


def scheduled(totals: DataFrame, weights: dict[str | None, float] | None, period: int | None, block_rows: int) -> DataFrame:
    """(mix_s, mix_j, mix_slot, mix_release, mix_deadline) of each block of the weighted sources, from totals (source, rows). One task: it
    holds a few numbers for each source, and takes time for each slot up to the last block."""

    names = ["mix_s", "mix_j", "mix_slot", "mix_release", "mix_deadline"]

    def run(batches):
        rows = {s: n for batch in batches for s, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)}
        targets = {s: root_weight(n) for s, n in rows.items()} if weights is None else weights
        blocks = {s: -(-n // block_rows) for s, n in rows.items() if targets.get(s, 0) > 0}
        plan = schedule(whole_weights(targets, period), blocks)
        while part := list(itertools.islice(plan, BATCH)):
            columns = zip(*part, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(next(columns), pa.string()), *(pa.array(c, pa.int64()) for c in columns)], names=names)

    return totals.repartition(1).mapInArrow(run, "mix_s string, mix_j long, mix_slot long, mix_release long, mix_deadline long")


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, id_col: str = "doc_id", source_col: str = "source", period: int | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The rows of docs with mix_block, mix_release, mix_deadline, mix_slot and mix_place: order by mix_slot, mix_place to read the mix.

    Every row stays, and every column; names that start with mix_ raise. While all sources last, any start of the order holds each
    source to its weight within one block; when one is used up, its slots stay empty. Sources without a weight (or with none above
    0) come after all others, in slot null. A null source is a source. Rows of a source take its blocks in order of a digest of their
    ids, whatever the number of partitions. Rows with equal ids are told apart by a hash of all their
    columns; rows that are equal in all are interchangeable. Only with a period are weights rounded, to whole slots of it.
    """
    spark = docs.sparkSession
    names = docs.columns
    if clash := [c for c in names if c.lower().startswith("mix_")]:
        raise ValueError(f"columns named like those of the mix: {clash}")
    rows = docs.select(*[F.col(f"`{c}`") for c in names])
    hashed = F.xxhash64(*[F.col(f"`{c}`") for c in names])
    # 60 bits of a digest of the id; salts are ranges of it, so ranks don't depend on how many there are
    spread = F.conv(F.substring(F.md5(F.coalesce(F.col(f"`{id_col}`").cast("string"), hashed.cast("string")).cast("binary")), 1, 15), 16, 10).cast("long")
    salts = partitions(spark) * BLOCKS_PER_PARTITION
    salted = rows.withColumns({"mix_source": F.col(source_col).cast("string"), "mix_salt": F.shiftright(F.shiftright(spread, 40) * salts, 20).cast("int")})
    # rows of a source in smaller salts: one row for each source and salt
    counted = salted.groupBy("mix_source", "mix_salt").agg(F.count(F.lit(1)).alias("mix_n"))
    before = counted.selectExpr("mix_source", "mix_salt", "mix_n", "sum(mix_n) OVER (PARTITION BY mix_source ORDER BY mix_salt) - mix_n AS mix_before")
    plan = scheduled(counted.groupBy("mix_source").agg(F.sum("mix_n").alias("mix_n")), weights, period, block_rows)
    # the blocks that a salt has rows of, with their slots
    spans = before.selectExpr("mix_source", "mix_salt", "mix_before", f"explode(sequence(mix_before div {block_rows}, (mix_before + mix_n - 1) div {block_rows})) AS mix_block")
    on = F.col("mix_source").eqNullSafe(F.col("mix_s")) & (F.col("mix_block") == F.col("mix_j"))
    heads = spans.join(plan, on, "left").select("mix_source", "mix_salt", "mix_before", "mix_block", "mix_slot", "mix_release", "mix_deadline", F.lit(True).alias("mix_head"))
    both = salted.withColumns({"mix_spread": spread, "mix_hash": hashed, "mix_head": F.lit(False)}).unionByName(heads, allowMissingColumns=True)
    within = Window.partitionBy("mix_source", "mix_salt").orderBy(F.desc("mix_head"), "mix_spread", F.col(f"`{id_col}`"), "mix_hash").rowsBetween(Window.unboundedPreceding, 0)
    rank = F.max("mix_before").over(within) + F.count(F.when(~F.col("mix_head"), 1)).over(within) - 1
    ranked = both.withColumn("mix_rank", rank).withColumn("mix_block", F.when(F.col("mix_head"), F.col("mix_block")).otherwise(F.floor(F.col("mix_rank") / block_rows)))
    block = Window.partitionBy("mix_source", "mix_salt", "mix_block")  # dealt as before: its rows are together
    taken = ranked.withColumns({c: F.max(c).over(block) for c in ("mix_slot", "mix_release", "mix_deadline")})
    done = taken.where("NOT mix_head").withColumn("mix_place", (F.col("mix_rank") % block_rows).cast("int"))
    return done.select(*[F.col(f"`{c}`") for c in names], "mix_block", "mix_release", "mix_deadline", "mix_slot", "mix_place")


def in_order(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The columns in order of the mix: each partition holds a range of slots, in order; written files read back as the mix."""
    n = partitions(mixed.sparkSession)
    order = [F.col("mix_slot").asc_nulls_last(), F.col("mix_place")]
    return mixed.repartitionByRange(n, *order).sortWithinPartitions(*order).select(*columns)


def contract(docs: DataFrame) -> DataFrame:
    return mix(docs.select("doc_id", "source")).select("doc_id", "source", "mix_block", "mix_release", "mix_deadline", "mix_slot", "mix_place")
