"""Models from a summary: small matrix algebra on the driver, whatever the data's size."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .summary import cumulative_summary, dense_summary


@dataclass(frozen=True)
class SummaryMatrix:
    """A (d+2) x (d+2) summary whose last variable is y; summaries of parts add up."""

    m: np.ndarray

    @classmethod
    def of(cls, cells: DataFrame) -> SummaryMatrix:
        rows = cells.toPandas()
        size = int(rows["i"].max()) if len(rows) else 0
        m = np.zeros((size, size))
        m[rows["i"].to_numpy() - 1, rows["j"].to_numpy() - 1] = rows["v"].to_numpy()
        return cls(m)

    @property
    def n(self) -> float:
        return float(self.m[0, 0])

    @property
    def d(self) -> int:
        return len(self.m) - 2

    def sums(self, with_y: bool = False) -> np.ndarray:
        return self.m[1 : len(self.m) - (not with_y), 0]

    def products(self, with_y: bool = False) -> np.ndarray:
        end = len(self.m) - (not with_y)
        return self.m[1:end, 1:end]

    @property
    def xy(self) -> np.ndarray:
        return self.m[1:-1, -1]

    def __add__(self, other: SummaryMatrix) -> SummaryMatrix:
        return SummaryMatrix(self.m + other.m)

    def corr(self, with_y: bool = True) -> np.ndarray:
        """Pearson correlations; NaN for constant variables."""
        n, s, q = self.n, self.sums(with_y), self.products(with_y)
        spread = np.sqrt(np.maximum(n * np.diag(q) - s * s, 0))
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(np.outer(spread, spread) > 0, (n * q - np.outer(s, s)) / np.outer(spread, spread), np.nan)


def _solve(a: np.ndarray, b: np.ndarray, singular: str) -> np.ndarray:
    try:
        if np.linalg.cond(a) > 1e15:
            raise np.linalg.LinAlgError
        return np.linalg.solve(a, b)
    except np.linalg.LinAlgError:
        if singular == "pinv":
            return np.linalg.pinv(a) @ b
        raise ValueError("collinear or constant predictors; use singular='pinv'") from None


def linreg_origin(s: SummaryMatrix, singular: str = "error") -> np.ndarray:
    """Least squares without an intercept."""
    return _solve(s.products(), s.xy, singular)


def linreg_intercept(s: SummaryMatrix, min_variance: float = 0.5, singular: str = "error") -> tuple[np.ndarray, list[int]]:
    """(coefficients, kept predictors): the intercept first; predictors of at most `min_variance` are left out."""
    variance = np.diag(s.products()) / s.n - (s.sums() / s.n) ** 2
    kept = [int(j) for j in np.flatnonzero(variance > min_variance)]
    at = [0, *(j + 1 for j in kept)]
    return _solve(s.m[np.ix_(at, at)], s.m[at, -1], singular), kept


def pca(s: SummaryMatrix, with_y: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(singular values, u, v) of the correlation matrix; each column of u has a positive largest entry."""
    u, d, vt = np.linalg.svd(s.corr(with_y))
    sign = np.where(u[np.abs(u).argmax(0), np.arange(len(u))] < 0, -1.0, 1.0)
    return d, u * sign, vt.T * sign


def relative_error(approximate: np.ndarray, accurate: np.ndarray) -> float:
    """Largest relative difference of coefficients."""
    return float(np.max(np.abs((approximate - accurate) / accurate)))


def incremental_regression(df: DataFrame, key: str, cols: list[str], size: int, start: int = 0, fit: Callable[[SummaryMatrix], np.ndarray] = linreg_origin, on_null: str = "error") -> Iterator[tuple[int, float]]:
    """(chunk, error against the full model) as chunks are added, in order; chunks without rows are passed over.

    One aggregation gives every chunk's cumulative summary; they come to the driver one after another.
    """
    exact, width = fit(SummaryMatrix.of(dense_summary(df, cols, on_null=on_null))), len(cols) + 1
    cells = cumulative_summary(df, key, cols, size, start, on_null)
    by_chunk = cells.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("i", "j", "v"))).alias("m")).orderBy("chunk")
    for chunk, m in by_chunk.toLocalIterator():
        yield chunk, relative_error(fit(SummaryMatrix(np.array([c["v"] for c in m]).reshape(width, width))), exact)


def group_matrix(cells: DataFrame, k: int | None = None) -> np.ndarray:
    """A grouped diagonal summary as a matrix, a class a row; fewer classes than `k`, if given, raise."""
    rows = cells.toPandas().pivot(index="i", columns="j", values="v").sort_index().to_numpy()
    if k is not None and len(rows) != k:
        raise ValueError(f"{len(rows)} classes, not {k}")
    return rows


def class_statistics(cells: DataFrame) -> list[dict]:
    """Per class: prior, means and variances, from a grouped diagonal summary (enough for naive Bayes)."""
    rows = group_matrix(cells)
    if not len(rows):
        return []
    d = (rows.shape[1] - 1) // 2 - 1
    total = rows[:, 0].sum()
    means = rows[:, 1 : d + 1] / rows[:, :1]
    variances = np.maximum(rows[:, d + 2 : 2 * d + 2] / rows[:, :1] - means**2, 0)
    return [{"class": r[d + 1] / r[0], "prior": r[0] / total, "means": m, "variances": v} for r, m, v in zip(rows, means, variances)]
