"""Generators and preparation of data sets."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _normal(key: Column, seed: int, salt: int) -> Column:
    """A standard normal number that depends on the key alone (Box-Muller of two hashes), whatever the partitioning."""
    unit = lambda n: (F.pmod(F.xxhash64(key, F.lit(seed), F.lit(salt), F.lit(n)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    return F.sqrt(F.lit(-2.0).cast("double") * F.log(unit(1))) * F.cos(unit(2) * (2 * math.pi))


def sparse_values(spark: SparkSession, n: int, d: int, density: float, seed: int = 42, stored_only: bool = True) -> DataFrame:
    """(i, j, v): multiples of 0.05 below 100 with the given density, else 0 (left out if stored_only)."""
    cells = spark.range(n * d).select((F.floor(F.col("id") / d) + 1).alias("i"), (F.col("id") % d + 1).cast("int").alias("j"), "id")
    draw = lambda s: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(s)), F.lit(1_000_000))
    out = cells.select("i", "j", F.when(draw(0) < density * 1_000_000, (draw(1) % 2000) / 20.0).otherwise(F.lit(0.0)).cast("double").alias("v"))
    return out.where("v <> 0") if stored_only else out


def gaussian_clusters(spark: SparkSession, n: int, d: int, k: int, spread: float = 10.0, top: float = 10.0, seed: int = 42, digits: int | None = None) -> DataFrame:
    """(i, x1..xd) around k centres drawn from U(0, top)."""
    import numpy as np

    centres = np.random.default_rng(seed).uniform(0, top, (k, d))
    rows = spark.range(1, n + 1).select(F.col("id").alias("i"), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(k)).cast("int").alias("g"))
    value = lambda j: F.element_at(F.array(*(F.lit(float(x)) for x in centres[:, j])), F.col("g") + 1) + _normal(F.col("i"), seed, j) * spread
    return rows.select("i", *((F.round(value(j), digits) if digits is not None else value(j)).alias(f"x{j + 1}") for j in range(d)))


def gaussian_columns(spark: SparkSession, n: int, d: int, seed: int = 42, batch: int = 1000) -> DataFrame:
    """(i, x1..xd): each column normal around a mean drawn anew for every batch of rows."""
    b = F.floor(F.col("id") / batch)
    mean = lambda j: F.pmod(F.xxhash64(b, F.lit(j), F.lit(seed)), F.lit(10_000)) / 1000.0
    return spark.range(n).select((F.col("id") + 1).alias("i"), *((mean(j) + _normal(F.col("id"), seed, j)).alias(f"x{j + 1}") for j in range(d)))


def clean_activity(df: DataFrame, cols: Sequence[str], label: str, positive: Sequence[int] | None = None) -> DataFrame:
    """NaN and null to 0, rows of class 0 dropped, the label last; binary if `positive` classes are named."""
    y = F.col(label).cast("int")
    kept = df.where(y.isNotNull() & (y != 0))
    mark = F.when(y.isin(*positive), 1).otherwise(0) if positive is not None else y
    return kept.select(*(F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0).cast("double")), F.lit(0.0)).alias(c) for c in cols), mark.cast("double").alias("y"))


def recoded(column: Column, codes: Mapping[str, int], other: int = 1) -> Column:
    """CASE WHEN over a map of labels."""
    out = F.lit(other)
    for name, code in codes.items():
        out = F.when(column == name, code).otherwise(out)
    return out


def widened(df: DataFrame, shift: int, most: int) -> DataFrame:
    """Long form with the columns up to `most` repeated `shift` further on."""
    return df.unionByName(df.where(F.col("j") <= most).withColumn("j", (F.col("j") + shift).cast(df.schema["j"].dataType)))


def narrowed(df: DataFrame, most: int) -> DataFrame:
    return df.where(F.col("j") <= most)


def pi_midpoint(spark: SparkSession, steps: int) -> DataFrame:
    """Pi by the midpoint rule: a distributed sum."""
    t = (F.col("id") + F.lit(0.5).cast("double")) / steps
    return spark.range(steps).agg((F.sum(F.lit(4.0).cast("double") / (t * t + 1)) / steps).alias("pi"))
