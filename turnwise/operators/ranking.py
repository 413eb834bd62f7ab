"""Running sums and exact selection by rank over rows that no task could hold."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from turnwise.operators.storing import kept

#: Ranges of values that a pass of the selection tells apart.
RANGES = 1024
#: Rows of a table that is broadcast.
HELD_ROWS = 1_000_000


def held(table: DataFrame) -> DataFrame:
    """A kept table, broadcast if it has at most HELD_ROWS rows."""
    return F.broadcast(table) if table.count() <= HELD_ROWS else table


def running_sums(rows: DataFrame, order: list[str], sums: dict[str, Column], keys: list[str] = []) -> DataFrame:  # noqa: B006
    """rows with, for each name in sums, the sum of its column over the rows before, in order, within the keys.

    Rows are dealt by ranges of keys and order; each part is summed by itself, and parts are moved by the sums of those before:
    so no task has all rows of a key. Rows that are equal in keys and order must be of one kind (their order isn't defined).
    """
    parts = kept(rows.select("*", *(c.alias(f"_v_{n}") for n, c in sums.items())).repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()))
    totals = parts.groupBy(*keys, "_part").agg(*(F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums))
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = kept(totals.select(*(F.col(k).alias(f"_k_{k}") for k in keys), F.col("_part").alias("_at"), *(F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums)))
    inside = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys], F.col("_part") == F.col("_at"))
    own = parts.select("*", *(F.coalesce(F.sum(f"_v_{n}").over(inside), F.lit(0)).alias(f"_i_{n}") for n in sums))
    return own.join(held(offsets), same).select(*rows.columns, *((F.col(f"_i_{n}") + F.col(f"_o_{n}")).alias(n) for n in sums))


def _place(x: Column, lo: Column, hi: Column, by_ratio: bool) -> Column:
    """Which of RANGES ranges between lo and hi, lo < hi, x is in; it never falls as x grows, and lo and hi are never in one with all between."""
    of = lambda part, whole: F.when(whole > 0, F.least(F.floor(F.try_divide(part, whole) * RANGES), F.lit(RANGES - 1))).when(x > lo, RANGES - 1).otherwise(0)
    linear = of(x / 2 - lo / 2, hi / 2 - lo / 2)
    if not by_ratio:
        return linear.cast("int")
    ratio = F.when(lo > 0, of(F.ln(x) - F.ln(lo), F.ln(hi) - F.ln(lo))).when(hi < 0, of(F.ln(-lo) - F.ln(-x), F.ln(-lo) - F.ln(-hi)))
    return ratio.when(x < 0, 0).when(x == 0, 1).otherwise(2).cast("int")


def selected(rows: DataFrame, keys: list[str], value: str, asked: DataFrame) -> DataFrame:
    """(keys, rank, value): the value at each rank asked for (keys, rank from 0), of the rows of the keys in ascending order.

    Each pass counts the values of RANGES ranges between the least and the greatest that are left, equal ones and ones of equal
    ratio in turn, and goes on within the one that holds the rank, until it has one value; passes are some ten at most, whatever the number of values. Counts are summed before they are
    shuffled, so no task has all rows of a key. Values are finite; ranks below 0 or beyond the last have no row.
    """
    data = rows.select(*keys, F.col(value).cast("double").alias("_x"))
    ends = data.groupBy(*keys).agg(F.min("_x").alias("lo"), F.max("_x").alias("hi"), F.count("*").alias("n"))
    open_ = kept(asked.select(*keys, F.col("rank").cast("long").alias("rank")).distinct().join(ends, keys).where("rank >= 0 and rank < n").select(*keys, "rank", "lo", "hi", F.col("rank").alias("left")))
    done = []
    while True:
        done.append(open_.where("lo = hi").select(*keys, "rank", F.col("lo").alias("value")))
        open_ = open_.where("lo < hi")
        if open_.isEmpty():
            break
        ranges = kept(open_.select(*keys, "lo", "hi").distinct())
        near = data.join(held(ranges), keys).where("_x >= lo and _x <= hi")
        place = _place(F.col("_x"), F.col("lo"), F.col("hi"), len(done) % 2 == 0)
        bins = near.groupBy(*keys, "lo", "hi", place.alias("bin")).agg(F.count("*").alias("n"), F.min("_x").alias("a"), F.max("_x").alias("b"))
        below = F.coalesce(F.sum("n").over(Window.partitionBy(*keys, "lo", "hi").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        bins = bins.withColumn("below", below)
        hit = open_.join(bins, [*keys, "lo", "hi"]).where("left >= below and left < below + n")
        open_ = kept(hit.select(*keys, "rank", F.col("a").alias("lo"), F.col("b").alias("hi"), (F.col("left") - F.col("below")).alias("left")))
    return reduce(DataFrame.union, done)


def stratified_folds(rows: DataFrame, label: str, id: str, folds: int = 5, seed: int = 0) -> DataFrame:
    """rows (one of each id) with fold: within a label, rows are dealt in turn in the order of a hash of the id, so folds have equal shares of it."""
    hashed = rows.withColumn("_h", F.xxhash64(F.lit(seed), F.col(id)))
    ranked = running_sums(hashed, ["_h", id], {"_rank": F.lit(1)}, [label])
    return ranked.withColumn("fold", (F.col("_rank") % folds).cast("int")).drop("_h", "_rank")
