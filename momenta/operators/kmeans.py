"""K-means from diagonal summaries per cluster; every iteration is one aggregation."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frames import numbers

#: The loop stops when the average distance changes by no more.
EPSILON = 1e-4


@dataclass
class Clusters:
    """Weights, centroids, variances and the average distance to the centroids before the last step."""

    w: np.ndarray
    c: np.ndarray
    r: np.ndarray
    avg_distance: float

    def frame(self, spark, with_distance: bool = True) -> DataFrame:
        rows = [(k + 1, float(w), c.tolist(), r.tolist(), float(self.avg_distance)) for k, (w, c, r) in enumerate(zip(self.w, self.c, self.r))]
        out = spark.createDataFrame(rows, "cluster int, w double, c array<double>, r array<double>, avg_distance double")
        return out if with_distance else out.drop("avg_distance")


def parse_config(text: str) -> dict:
    """`name=value` pairs between commas: blanks leave names only, `incremental` is true if exactly `true`, omega is 0 if absent or empty, other names are ignored."""
    found = {"incremental": False, "omega": 0.0}
    for part in text.split(","):
        name, eq, value = part.partition("=")
        name = name.replace(" ", "")
        if eq and name == "incremental":
            found[name] = value == "true"
        elif eq and name == "omega":
            found[name] = float(value) if value else 0.0
    return found


def _square(x: Column) -> Column:
    return x * x


def assigned(df: DataFrame, cols: Sequence[str], centroids: np.ndarray) -> DataFrame:
    """`df` with cluster (from 1; ties to the lowest) and its squared distance: built-in expressions over literals."""
    away = []
    for c in centroids:
        total = _square(F.col(cols[0]) - F.lit(float(c[0])))
        for name, x in zip(cols[1:], c[1:]):
            total = total + _square(F.col(name) - F.lit(float(x)))
        away.append(total)
    least = F.array_min("_away")
    return df.withColumn("_away", F.array(*away)).withColumn("cluster", F.array_position("_away", least).cast("int")).withColumn("square", least).drop("_away")


def _statistics(rows: DataFrame, cols: Sequence[str], c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(n, l, q, sum of distances) of each cluster after an assignment to c."""
    sums = [F.count(F.lit(1)).alias("n"), F.sum(F.sqrt("square")).alias("away")]
    sums += [F.sum(x).alias(f"l{j}") for j, x in enumerate(cols)] + [F.sum(_square(F.col(x))).alias(f"q{j}") for j, x in enumerate(cols)]
    n, l, q, away = np.zeros(len(c)), np.zeros(c.shape), np.zeros(c.shape), 0.0
    for r in assigned(rows, cols, c).groupBy("cluster").agg(*sums).collect():  # k rows
        k = r["cluster"] - 1
        n[k], away = r["n"], away + r["away"]
        l[k], q[k] = [r[f"l{j}"] for j in range(len(cols))], [r[f"q{j}"] for j in range(len(cols))]
    return n, l, q, away


def updated(c: np.ndarray, r: np.ndarray, n: np.ndarray, l: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(w, c, r); an empty cluster keeps its centroid and variance."""
    some = n > 0
    c, r = c.copy(), r.copy()
    c[some] = l[some] / n[some, None]
    r[some] = np.maximum(q[some] / n[some, None] - c[some] ** 2, 0)
    return n / max(n.sum(), 1), c, r


def reseeded(w: np.ndarray, c: np.ndarray, r: np.ndarray, omega: float) -> tuple[np.ndarray, np.ndarray]:
    """Light clusters (weight under omega/k) of the lighter half move beside the heaviest ones."""
    k, order = len(w), np.argsort(w, kind="stable")
    c, r = c.copy(), r.copy()
    for i in range(k // 2):
        light, heavy = order[i], order[k - 1 - i]
        if w[light] < omega / k:
            c[light] = c[heavy] + 0.5 * np.sqrt(r[heavy])
            r[light] = 0
    return c, r


def kmeans(df: DataFrame, cols: Sequence[str], k: int, key: str, max_rounds: int = 50, incremental: bool = False, omega: float = 0.5, chunk_size: int | None = None, config: str | None = None) -> Clusters:
    """Lloyd's method from the first k rows by key.  A `config` text (see `parse_config`) replaces incremental and omega.

    Iterative: a pass per round.  Incremental: the centroids move after every chunk of
    `chunk_size` keys, from that chunk alone; serial by nature, a job per chunk.
    """
    if config is not None:
        incremental, omega = parse_config(config).values()
    rows = numbers(df, [key, *cols]).persist()
    try:
        first = rows.orderBy(key).limit(k).select(*cols).collect()
        n_all = rows.count()
        if not 0 < k <= n_all or max_rounds < 1:
            raise ValueError("k must be between 1 and the number of rows, max_rounds positive")
        c = np.array([list(x) for x in first], float)
        r, w, last, avg = np.zeros(c.shape), np.full(k, 1.0 / k), np.inf, np.inf
        if incremental:
            low, high = rows.agg(F.min(key), F.max(key)).first()
            size = chunk_size or max(1, int((high - low + 1) // 10))
            chunks = [rows.where((F.col(key) >= a) & (F.col(key) < a + size)) for a in np.arange(low, high + 1, size).tolist()]
        else:
            chunks = [rows]
        for t in range(max_rounds):
            total = 0.0
            for part in chunks:
                n, l, q, away = _statistics(part, cols, c)
                if not n.sum():
                    continue
                total += away
                w, c, r = updated(c, r, n, l, q)
                if omega and (t == 0 if incremental else t < (max_rounds - 1) // 10 + 1):
                    c, r = reseeded(w, c, r, omega)
            avg = total / n_all
            if abs(avg - last) <= EPSILON:
                break
            last = avg
        return Clusters(w, c, r, avg)
    finally:
        rows.unpersist()


def assigned_long(cells: DataFrame, centroids: DataFrame) -> DataFrame:
    """(i, cluster, square) from long cells (i, j, v) and centroids (cluster, j, c): an equi join on j and sums by row and cluster.

    Centroids are k x d numbers; Spark broadcasts them by their size.  Ties go to the lowest cluster.
    """
    away = cells.join(centroids, "j").groupBy("i", "cluster").agg(F.sum(_square(F.col("v") - F.col("c"))).alias("square"))
    return away.groupBy("i").agg(F.min(F.struct("square", "cluster")).alias("m")).select("i", F.col("m.cluster").alias("cluster"), F.col("m.square").alias("square"))


def tables(df: DataFrame, cols: Sequence[str], key: str, centroids: np.ndarray, omega: float = 0.0) -> dict[str, DataFrame]:
    """The relational form of one step: frames by name.

    CH (j, X1..Xd) centroids; XV (i, l, val) cells; YD (i, d1..dk) squared distances; YNN (i, j)
    nearest centroids; NMQ (l, j, N, M, Q) counts, sums and sums of squares of column l in
    cluster j; WCR (l, j, W, C, R) weights, means and variances; model (n, k, omega).
    """
    spark, k = df.sparkSession, len(centroids)
    rows = numbers(df, cols, keys=[key])
    ch = spark.createDataFrame([(j, *map(float, c)) for j, c in enumerate(centroids, 1)], "j int, " + ", ".join(f"X{n} double" for n in range(1, len(cols) + 1)))
    near = assigned(rows, cols, np.asarray(centroids, float))
    away = [sum((_square(F.col(name) - F.lit(float(x))) for name, x in zip(cols[1:], c[1:])), _square(F.col(cols[0]) - F.lit(float(c[0])))) for c in centroids]
    long = lambda frame, *keep: frame.select(*keep, F.inline(F.array(*(F.struct(F.lit(n).alias("l"), F.col(c).alias("val")) for n, c in enumerate(cols, 1)))))
    nmq = long(near, F.col("cluster").alias("j")).groupBy("l", "j").agg(F.count(F.lit(1)).alias("N"), F.sum("val").alias("M"), F.sum(_square(F.col("val"))).alias("Q"))
    n = rows.agg(F.count(F.lit(1)).alias("n"))
    wcr = nmq.crossJoin(F.broadcast(n.select(F.col("n").alias("all_rows")))).select("l", "j", (F.col("N") / F.col("all_rows")).alias("W"), (F.col("M") / F.col("N")).alias("C"), (F.col("Q") / F.col("N") - _square(F.col("M") / F.col("N"))).alias("R"))
    return {
        "CH": ch,
        "XV": long(rows, F.col(key).alias("i")),
        "YD": rows.select(F.col(key).alias("i"), *(a.alias(f"d{j}") for j, a in enumerate(away, 1))),
        "YNN": near.select(F.col(key).alias("i"), F.col("cluster").alias("j")),
        "NMQ": nmq,
        "WCR": wcr,
        "model": n.select("n", F.lit(k).alias("k"), F.lit(float(omega)).cast("double").alias("omega")),
    }


def library_kmeans(df: DataFrame, cols: Sequence[str], k: int = 10, max_rounds: int = 50, seed: int = 42) -> tuple[np.ndarray, float]:
    """(centres, sum of squared distances) of Spark ML's own k-means: the baseline the operator is held against."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=list(cols), outputCol="features").transform(numbers(df, cols)).select("features").persist()
    try:
        model = KMeans(k=k, maxIter=max_rounds, seed=seed).fit(rows)
        return np.array(model.clusterCenters()), float(model.summary.trainingCost)
    finally:
        rows.unpersist()
