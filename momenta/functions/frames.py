"""Storage forms: wide (a column per variable), array, and long (i, j, v); and the null policy."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbers(df: DataFrame, cols: Sequence[str], on_null: str = "error", keys: Sequence[str] = ()) -> DataFrame:
    """The columns as doubles after `keys`.  A null number raises (`error`), counts as 0 (`zero`), or drops its row (`drop`)."""
    if not cols:
        raise ValueError("at least one column is needed")
    out = df.select(*keys, *(F.col(c).cast("double").alias(c) for c in cols))
    if on_null == "error":
        return out.select(*keys, *(F.when(F.col(c).isNull(), F.raise_error(F.lit(f"null in column {c}"))).otherwise(F.col(c)).alias(c) for c in cols))
    if on_null == "zero":
        return out.na.fill(0.0, list(cols))
    if on_null == "drop":
        return out.na.drop("any", subset=list(cols))
    raise ValueError(f"on_null is error, zero or drop, not {on_null}")


def to_long(df: DataFrame, key: str, cols: Sequence[str], sparse: bool = False) -> DataFrame:
    """(i, j, v): j is the 1-based place in `cols`; sparse keeps only non-zero cells."""
    cells = F.array(*(F.struct(F.lit(j).alias("j"), F.col(c).cast("double").alias("v")) for j, c in enumerate(cols, 1)))
    out = df.select(F.col(key).alias("i"), F.explode(cells).alias("c")).select("i", "c.j", "c.v")
    return out.where("v is null or v <> 0") if sparse else out


def to_wide(df: DataFrame, d: int, names: Sequence[str] | None = None, fill: float | None = None) -> DataFrame:
    """One row per i with columns x1..xd; d is given, so no pass over the data finds the columns."""
    names = names or [f"x{j}" for j in range(1, d + 1)]
    pick = [F.max(F.when(F.col("j") == j, F.col("v"))).alias(n) for j, n in enumerate(names, 1)]
    out = df.groupBy("i").agg(*pick)
    return out.na.fill(fill, list(names)) if fill is not None else out


def to_rows(df: DataFrame) -> DataFrame:
    """(i, row): the values of each i in order of j, whatever the column numbers are."""
    return df.groupBy("i").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "v"))), lambda c: c["v"]).alias("row"))


def point(i: Column, j: Column, v: Column) -> Column:
    """A coordinate with its value as one struct; `.v` reads the value."""
    return F.struct(i.cast("long").alias("i"), j.cast("long").alias("j"), v.cast("double").alias("v"))


def _places(key: Column, bounds: list) -> Column:
    """How many of the sorted bounds are below the key: a binary search over a literal array."""
    held = F.array(*map(F.lit, bounds))
    halves = F.array(*(F.lit(1 << b) for b in range(len(bounds).bit_length() - 1, -1, -1)))
    return F.aggregate(halves, F.lit(0), lambda at, half: F.when(F.get(held, at + half - 1) < key, at + half).otherwise(at))


#: Sampled rows for each slot's bound, and cuts of the slot of a key that many rows share.
BOUND_ROWS, SHARED_CUTS = 60, 16


def row_numbers(df: DataFrame, order: str, slots: int | None = None) -> DataFrame:
    """`df` with row numbers i from 1 in order of a column, nulls first; rows of equal keys in any order.

    Rows fall into slots by bounds that come to the driver first (a sample's quantiles, about
    `slots` values), so the slot is a function of the row alone and every use of the frame
    agrees on it.  A bound's own key has a slot of its own, cut by a hash of the row, so a key
    that many rows share is no single task.  Slots number their own rows; the counts of the
    slots before are added.
    """
    if "i" in df.columns:
        raise ValueError("the rows have a column i already")
    slots = slots or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key, whole = F.col(order), F.xxhash64(*df.columns)
    n = df.count()
    scale = 1 << 40
    part = min(scale, scale * BOUND_ROWS * slots // max(n, 1))
    sample = df.where(key.isNotNull() & (F.pmod(whole, F.lit(scale)) < part)).groupBy(key.alias("k")).count().orderBy("k").collect()
    bounds, seen, total = [], 0, sum(r["count"] for r in sample)
    for r in sample:  # about BOUND_ROWS * slots keys at most
        if (seen + r["count"]) * slots // max(total, 1) > seen * slots // max(total, 1):
            bounds.append(r["k"])
        seen += r["count"]
    if bounds:
        below = _places(key, bounds)
        equal = F.coalesce(F.get(F.array(*map(F.lit, bounds)), below) == key, F.lit(False))
        slot, shared = F.when(key.isNull(), -1).otherwise(2 * below + equal.cast("int")), key.isNull() | equal
    else:
        slot, shared = F.when(key.isNull(), -1).otherwise(0), key.isNull()
    made = df.withColumn("_slot", F.struct(slot.cast("int").alias("at"), F.when(shared, F.pmod(F.xxhash64(whole, F.lit(1)), F.lit(SHARED_CUTS))).otherwise(F.lit(0)).cast("int").alias("cut")))
    counts = made.groupBy("_slot").agg(F.count(F.lit(1)).alias("_n"))
    # one row a slot and cut
    before = counts.select("_slot", F.coalesce(F.sum("_n").over(Window.orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    row = F.row_number().over(Window.partitionBy("_slot").orderBy(order)).cast("long") + F.col("_before")
    return made.join(F.broadcast(before), "_slot").withColumn("i", row).drop("_slot", "_before")


def increments(df: DataFrame, order: str, slots: int | None = None) -> DataFrame:
    """Row numbers i and increment steps: i mod log2(n), plus 1.

    The logarithm is made an integer by rounding, as a database of the PostgreSQL family casts
    a float; of one row or none it counts as 1.
    """
    steps = max(1, round(math.log2(max(df.count(), 1))))
    return row_numbers(df, order, slots).withColumn("incr_step", (F.col("i") % steps + 1).cast("int"))
