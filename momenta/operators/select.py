"""Correlation with y and selection of the columns that correlate most."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frames import numbers


def _pearson(n: Column, x: Column, y: Column, xx: Column, yy: Column, xy: Column) -> Column:
    zero = F.lit(0.0).cast("double")
    spread = F.sqrt(F.greatest(n * xx - x * x, zero)) * F.sqrt(F.greatest(n * yy - y * y, zero))
    return F.try_divide(n * xy - x * y, F.when(spread > 0, spread))


def correlation_y(df: DataFrame, cols: Sequence[str], on_null: str = "error") -> DataFrame:
    """(i, v): Pearson correlation of each column with the last one; null where a column is constant."""
    *xs, y = cols
    sums = [F.count(F.lit(1)).cast("double").alias("n"), F.sum(y).alias("y"), F.sum(F.col(y) * F.col(y)).alias("yy")]
    for k, x in enumerate(xs):
        sums += [F.sum(x).alias(f"x{k}"), F.sum(F.col(x) * F.col(x)).alias(f"xx{k}"), F.sum(F.col(x) * F.col(y)).alias(f"xy{k}")]
    one = numbers(df, cols, on_null).agg(*sums)
    cells = F.array(*(F.struct(F.lit(k + 1).alias("i"), _pearson(F.col("n"), F.col(f"x{k}"), F.col("y"), F.col(f"xx{k}"), F.col("yy"), F.col(f"xy{k}")).alias("v")) for k in range(len(xs))))
    return one.select(F.explode(cells).alias("c")).select("c.i", "c.v")


def correlation_matrix(cells: DataFrame) -> DataFrame:
    """(i, j, v): correlations of all variables of a full summary, y included; small joins of the summary with itself."""
    n = cells.where("i = 1 and j = 1").select(F.col("v").alias("n"))
    s = cells.where("j = 1 and i > 1").select(F.col("i").alias("k"), F.col("v").alias("l"))
    q = cells.where("i = j and i > 1").select(F.col("i").alias("k"), F.col("v").alias("q"))
    one = s.join(q, "k").join(F.broadcast(n))  # a summary has one n
    a, b = (one.select(F.col("k").alias(k), F.col("l").alias(f"l{k}"), F.col("q").alias(f"q{k}"), *(["n"] if k == "i" else [])) for k in "ij")
    all_ = cells.where("i > 1 and j > 1").join(a, "i").join(b, "j")
    v = _pearson(F.col("n"), F.col("li"), F.col("lj"), F.col("qi"), F.col("qj"), F.col("v"))
    return all_.select((F.col("i") - 1).alias("i"), (F.col("j") - 1).alias("j"), v.alias("v"))


def ranked(correlations: Sequence[tuple[int, float | None]], d: int, signed: bool = False) -> list[int]:
    """The d columns of largest |correlation| (or signed value), ties to the lower number, unknown ones last; in column order."""
    if not 0 <= d <= len(correlations):
        raise ValueError(f"d must be between 0 and {len(correlations)}")
    known = lambda v: v is not None and not math.isnan(v)
    size = lambda v: v if signed else abs(v)
    order = sorted(correlations, key=lambda c: (not known(c[1]), -size(c[1]) if known(c[1]) else 0.0, c[0]))
    return sorted(i for i, _ in order[:d])


def preselect(df: DataFrame, cols: Sequence[str], d: int, keep: Sequence[str] = ()) -> DataFrame:
    """The d columns that correlate most with the last one, and the last; a projection, so scans read only these."""
    best = ranked([(r["i"], r["v"]) for r in correlation_y(df, cols).collect()], d)
    return df.select(*keep, *(cols[i - 1] for i in best), cols[-1])


def preselect_long(df: DataFrame, correlations: Sequence[tuple[int, float | None]], d: int, signed: bool = True) -> DataFrame:
    """Long form: a filter on j that keeps the chosen columns' numbers, and y."""
    return df.where(F.col("j").isin(*ranked(correlations, d, signed), len(correlations) + 1))
