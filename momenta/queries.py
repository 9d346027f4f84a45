"""Registered queries of the summarization operators, and their SQL.

Sums of doubles depend on the order of addition, so results are rounded well above that.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.frames import increments, point, to_long, to_wide
from .operators import kmeans as km
from .operators import models, select, summary
from .sources import files, generate
from .streaming import incremental

COLS = ["l_quantity", "price", "l_discount", "l_tax"]
DIM = 64


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem's numbers; prices in thousands."""
    return _table(spark, sf_dir, "lineitem").select("l_quantity", (F.col("l_extendedprice") / 1000).alias("price"), "l_discount", "l_tax", "l_returnflag", "l_linestatus")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_totalprice") / 1000).alias("price"), (F.col("o_custkey") % 100).cast("double").alias("c"))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings in long form: (i, j, v)."""
    e = _table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("i"), F.posexplode("embedding").alias("j", "v")).select("i", (F.col("j") + 1).alias("j"), F.col("v").cast("double").alias("v"))


def _large(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir).where(F.abs("v") > 0.15)


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").cast("double").alias("x1"), (F.col("p_retailprice") / 100).alias("x2"))


def _rounded(df: DataFrame, digits: int = 2) -> DataFrame:
    return df.withColumn("v", F.round("v", digits) + F.lit(0.0).cast("double"))


def dense_summary(spark, d):
    return _rounded(summary.dense_summary(_items(spark, d), COLS, "sql"))


def dense_summary_array(spark, d):
    return _rounded(summary.dense_summary(_items(spark, d), COLS, "arrow"))


def wide_summary(spark, d):
    """All columns of the embeddings: too many for generated sums."""
    return _rounded(summary.array_summary(_table(spark, d, "embeddings").select(F.col("embedding").alias("row")), DIM), 3)


def long_summary(spark, d):
    return _rounded(summary.long_summary(_vectors(spark, d), DIM), 3)


def sparse_summary(spark, d):
    return _rounded(summary.sparse_summary(_large(spark, d), DIM), 3)


def selfjoin_crossproduct(spark, d):
    return _rounded(summary.selfjoin_crossproduct(_large(spark, d)), 3)


def selfjoin_crossproduct_all(spark, d):
    """Over every cell; no SQL, as those of the other whole-table forms."""
    return _rounded(summary.selfjoin_crossproduct(_vectors(spark, d)), 3)


def diag_summary(spark, d):
    return _rounded(summary.diag_summary(_items(spark, d), COLS))


def sparse_diag_summary(spark, d):
    n = _table(spark, d, "embeddings").count()
    return _rounded(summary.sparse_diag_summary(_large(spark, d), DIM, n), 3)


def _classed(spark, d):
    return _items(spark, d).withColumn("class", generate.recoded(F.col("l_returnflag"), {"A": 1, "N": 2, "R": 3}, 4).cast("double"))


def group_diag_summary(spark, d):
    return _rounded(summary.group_diag_summary(_classed(spark, d), ["l_quantity", "price", "class"], 3))


def group_diag_summary_idy(spark, d):
    return _rounded(summary.group_diag_summary(_classed(spark, d), ["l_quantity", "class", "price"], 2, 2))


def chunk_summary(spark, d):
    return _rounded(summary.chunk_summary(_orders(spark, d), "k", ["price", "c"], 2, 1000))


def cumulative_summary(spark, d):
    return _rounded(summary.cumulative_summary(_orders(spark, d), "k", ["price", "c"], 1000))


def correlation_y(spark, d):
    return _rounded(select.correlation_y(_items(spark, d), ["l_quantity", "l_discount", "l_tax", "price"]), 7)


def correlation_matrix(spark, d):
    return _rounded(select.correlation_matrix(summary.dense_summary(_items(spark, d), COLS, "sql")), 7)


def preselect_topd(spark, d):
    out = select.preselect(_items(spark, d), ["l_quantity", "l_discount", "l_tax", "price"], 1)
    return out.select(*(F.col(c).alias(n) for c, n in zip(out.columns, ("x1", "y"))))


def _vector_frame(spark, name: str, values) -> DataFrame:
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], f"{name} int, v double")


def _summary(spark, d, cols=("l_quantity", "l_discount", "price")):
    return models.SummaryMatrix.of(summary.dense_summary(_items(spark, d), list(cols), "sql"))


def linreg_origin(spark, d):
    return _rounded(_vector_frame(spark, "i", models.linreg_origin(_summary(spark, d))), 6)


def linreg_intercept(spark, d):
    coefficients, _ = models.linreg_intercept(_summary(spark, d))
    return _rounded(_vector_frame(spark, "i", coefficients), 6)


def _matrix_frame(spark, m: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(i + 1, j + 1, float(v)) for (i, j), v in np.ndenumerate(m)], "i int, j int, v double")


def pca_corr(spark, d):
    """What the factors make up again: u diag(s) v', which must be the correlation matrix."""
    values, u, v = models.pca(_summary(spark, d, COLS))
    return _rounded(_matrix_frame(spark, u @ np.diag(values) @ v.T), 6)


def pca_spectrum(spark, d):
    """Sums of the singular values' powers 1 to 4, which must be the traces of the matrix's powers."""
    values = models.pca(_summary(spark, d, COLS))[0]
    return _rounded(_vector_frame(spark, "i", [(values**k).sum() for k in range(1, 5)]), 6)


def incremental_regression(spark, d):
    errors = list(models.incremental_regression(_orders(spark, d), "k", ["c", "price"], 5000))
    return spark.createDataFrame([(c, round(e, 8) + 0.0) for c, e in errors], "chunk int, error double")


CENTRES = [[5.0, 10.0], [25.0, 14.0], [45.0, 18.0]]


def kmeans_assign(spark, d):
    return km.assigned(_parts(spark, d), ["x1", "x2"], np.array(CENTRES)).select("k", "cluster", F.round("square", 6).alias("square"))


def kmeans_step(spark, d):
    n, l, q, away = km._statistics(_parts(spark, d), ["x1", "x2"], np.array(CENTRES))
    w, c, r = km.updated(np.array(CENTRES), np.zeros((3, 2)), n, l, q)
    rows = [(k + 1, round(float(w[k]), 8), *(round(float(x), 6) for x in (*c[k], *r[k]))) for k in range(3)]
    return spark.createDataFrame(rows, "cluster int, w double, c1 double, c2 double, r1 double, r2 double")


def _clusters(spark, found: km.Clusters, with_distance: bool = True) -> DataFrame:
    out = found.frame(spark, with_distance)
    cells = [F.round(F.col(x)[j], 6).alias(f"{x}{j + 1}") for x in "cr" for j in range(2)]
    return out.select("cluster", F.round("w", 6).alias("w"), *cells, *([F.round("avg_distance", 6).alias("avg_distance")] if with_distance else []))


def kmeans_fit(spark, d):
    return _clusters(spark, km.kmeans(_parts(spark, d), ["x1", "x2"], 4, "k", 10))


def kmeans_incremental(spark, d):
    return _clusters(spark, km.kmeans(_parts(spark, d), ["x1", "x2"], 4, "k", 3, True))


def kmeans_configured(spark, d):
    return _clusters(spark, km.kmeans(_parts(spark, d), ["x1", "x2"], 4, "k", 5, config="incremental=TRUE,omega=0"))


def kmeans_without_distance(spark, d):
    return _clusters(spark, km.kmeans(_parts(spark, d), ["x1", "x2"], 4, "k", 5), False)


def kmeans_library(spark, d):
    """Spark ML's k-means of the same rows; its random start has no SQL."""
    centres, cost = km.library_kmeans(_parts(spark, d), ["x1", "x2"], 10, 50)
    return spark.createDataFrame([(i, *map(float, c), cost) for i, c in enumerate(centres, 1)], "cluster int, c1 double, c2 double, cost double")


def kmeans_assign_long(spark, d):
    centroids = spark.createDataFrame([(k, j, float(x)) for k, c in enumerate(CENTRES, 1) for j, x in enumerate(c, 1)], "cluster int, j int, c double")
    return km.assigned_long(to_long(_parts(spark, d), "k", ["x1", "x2"]), centroids).select(F.col("i").alias("k"), "cluster", F.round("square", 6).alias("square"))


def _table_of_step(name: str, *rounded: str):
    def query(spark, d):
        out = km.tables(_parts(spark, d), ["x1", "x2"], "k", np.array(CENTRES), 0.5)[name]
        return out.withColumns({c: F.round(c, 6) for c in rounded})

    return query


kmeans_ch = _table_of_step("CH")
kmeans_xv = _table_of_step("XV")
kmeans_yd = _table_of_step("YD", "d1", "d2", "d3")
kmeans_ynn = _table_of_step("YNN")
kmeans_nmq = _table_of_step("NMQ", "M", "Q")
kmeans_wcr = _table_of_step("WCR", "W", "C", "R")
kmeans_model = _table_of_step("model")


def block_product(spark, d):
    """Products of all embedding columns in blocks of 24."""
    return _rounded(summary.block_product(_table(spark, d, "embeddings").select(F.col("embedding").alias("row")), DIM, 24), 3)


def csv_round_trip(spark, d):
    """lineitem's numbers written as CSV and summarized from there."""
    path = files.scratch(spark, "csv")
    files.write_csv(_items(spark, d).select(*COLS), path)
    return _rounded(summary.csv_summary(spark, path, len(COLS)))


def csv_dimensions(spark, d):
    path = files.scratch(spark, "csv")
    files.write_csv(_orders(spark, d), path)
    n, width = files.dimensions(files.read_csv(spark, path, 3))
    return spark.createDataFrame([(n, width)], "n long, d int")


def binary_round_trip(spark, d):
    """orders as a raw file of doubles, read back with seven rows past its end, where it starts over."""
    path = files.scratch(spark, "raw")
    orders = _orders(spark, d)
    files.write_binary(orders, "k", ["price", "c"], path)
    return files.read_binary(spark, path, orders.count() + 7, 2)


def tiff_pixels(spark, d):
    """A grey image of nations by regions, read back without its last row and column."""
    path, rows = files.scratch(spark, "tiff"), _table(spark, d, "nation").crossJoin(_table(spark, d, "region").select("r_regionkey"))
    cells = rows.orderBy("n_nationkey", "r_regionkey").select(((F.col("n_nationkey") * 37 + F.col("r_regionkey") * 11) % 256).alias("v")).collect()  # 125 pixels
    files.put(spark, path, files.tiff_file(len(cells) // 5, 5, bytes(r["v"] for r in cells)))
    return files.read_tiff(spark, path, len(cells) // 5 - 1, 4).drop("path")


def stored_cells(spark, d):
    """Large cells of the embeddings, stored by column and read back."""
    return files.store(_large(spark, d), files.scratch(spark, "cells"), "j")


def jdbc_table(spark, d):
    """region by way of another database (the one that Spark brings along)."""
    url = files.derby_copy(spark, _table(spark, d, "region"), "region")
    back = files.read_jdbc(spark, url, "region", driver=files.DERBY)
    return back.toDF(*(c.lower() for c in back.columns))


def preselect_signed(spark, d):
    """Cells of the column that correlates most with y, by sign, in long form."""
    rows = _parts(spark, d).select("k", "x1", (-F.col("x2")).alias("x2"), (F.col("k") % 7).cast("double").alias("x3"), (F.col("x1") * 0.3 + F.col("x2")).alias("y"))
    cols = ["x1", "x2", "x3", "y"]
    correlations = [(r["i"], r["v"]) for r in select.correlation_y(rows, cols).collect()]  # one a column
    return _rounded(select.preselect_long(to_long(rows, "k", cols), correlations, 1), 6)


def activity_clean(spark, d):
    e = _table(spark, d, "events")
    raw = e.select(F.when(F.col("event_id") % 5 == 0, F.lit(float("nan")).cast("double")).otherwise(F.col("value")).alias("a"), (F.col("user_id") % 10).cast("double").alias("b"), (F.col("event_id") % 4).alias("class"))
    return generate.clean_activity(raw, ["a", "b"], "class", [3]).select(F.col("a").alias("x1"), F.col("b").alias("x2"), "y")


def _stream(spark, d, name: str) -> DataFrame:
    """A table as a stream of files."""
    return spark.readStream.schema(_table(spark, d, name).schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{d}/{name}.parquet*")


def running_summary(spark, d):
    """A stream's n, sums and squares, which must be those of the table."""
    name = "running_" + files.scratch(spark, "s").rsplit("-", 1)[-1]
    stream = _stream(spark, d, "orders").select((F.col("o_totalprice") / 1000).alias("price"))
    incremental.running_summary(stream, ["price"], name, files.scratch(spark, "checkpoint"), once=True).awaitTermination()
    return spark.table(name).select("n", F.round("sum_price", 2).alias("sum_price"), F.round("square_price", 2).alias("square_price"))


def windowed_summary(spark, d):
    """Diagonal summaries of a stream's event-time windows of a day."""
    name = "windowed_" + files.scratch(spark, "s").rsplit("-", 1)[-1]
    windows = incremental.windowed_summary(_stream(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "value"), "ts", ["value"], "1 day", "1 day")
    incremental.kept(windows, name, files.scratch(spark, "checkpoint"), once=True).awaitTermination()
    return spark.table(name).select(F.unix_timestamp("window.start").alias("day"), "n", F.round("sum_value", 2).alias("sum_value"), F.round("square_value", 2).alias("square_value"))


def unpivot_long(spark, d):
    return to_long(_orders(spark, d), "k", ["price", "c"])


def pivot_wide(spark, d):
    return to_wide(_vectors(spark, d).where("j <= 4"), 4)


def pivot_wide_all(spark, d):
    return to_wide(_vectors(spark, d), DIM)


def rowid_incr_step(spark, d):
    return increments(_orders(spark, d).select("k"), "k")


def increment_vertical(spark, d):
    return to_long(increments(_orders(spark, d), "k").where("incr_step = 1"), "i", ["price", "c"])


def recode_label(spark, d):
    o = _table(spark, d, "orders")
    return o.select("o_orderkey", generate.recoded(F.col("o_orderpriority"), {"1-URGENT": 7, "2-HIGH": 20, "3-MEDIUM": 25}).cast("int").alias("code"))


def widen_by_duplication(spark, d):
    return generate.widened(_vectors(spark, d).where("j <= 3"), 3, 1)


def widen_by_duplication_all(spark, d):
    return generate.widened(_vectors(spark, d), DIM, DIM)


def narrow_columns(spark, d):
    return generate.narrowed(_vectors(spark, d), 2)


def _points(cells: DataFrame) -> DataFrame:
    return cells.select(point(F.col("i"), F.col("j"), F.col("v")).alias("p")).select(F.col("p.i").alias("i"), F.col("p.j").alias("j"), F.col("p.v").alias("v"))


def coordinate_points(spark, d):
    return _points(_vectors(spark, d).where("j <= 2"))


def coordinate_points_all(spark, d):
    return _points(_vectors(spark, d))


def identity_scan(spark, d):
    return _table(spark, d, "nation").select("*")


def pi_midpoint(spark, d):
    return generate.pi_midpoint(spark, 1_000_000).select(F.round("pi", 8).alias("pi"))


def class_statistics(spark, d):
    found = models.class_statistics(summary.group_diag_summary(_classed(spark, d), ["l_quantity", "price", "class"], 3))
    rows = [(float(c["class"]), round(float(c["prior"]), 8), *(round(float(x), 6) for x in (*c["means"], *c["variances"]))) for c in found]
    return spark.createDataFrame(rows, "class double, prior double, m1 double, m2 double, v1 double, v2 double")


_NAMES = (
    "dense_summary dense_summary_array wide_summary long_summary sparse_summary selfjoin_crossproduct diag_summary sparse_diag_summary group_diag_summary group_diag_summary_idy "
    "chunk_summary cumulative_summary correlation_y correlation_matrix preselect_topd linreg_origin linreg_intercept pca_corr incremental_regression kmeans_assign kmeans_step kmeans_fit "
    "kmeans_incremental kmeans_without_distance unpivot_long pivot_wide rowid_incr_step increment_vertical recode_label widen_by_duplication narrow_columns coordinate_points identity_scan "
    "pi_midpoint class_statistics pca_spectrum kmeans_configured kmeans_library kmeans_assign_long kmeans_ch kmeans_xv kmeans_yd kmeans_ynn kmeans_nmq kmeans_wcr kmeans_model block_product csv_round_trip "
    "csv_dimensions binary_round_trip tiff_pixels stored_cells jdbc_table preselect_signed activity_clean running_summary windowed_summary selfjoin_crossproduct_all pivot_wide_all widen_by_duplication_all coordinate_points_all"
).split()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: globals()[n] for n in _NAMES}


def oracle_sql() -> dict[str, str]:
    items = "(select l_quantity::double l_quantity, l_extendedprice / 1000 as price, l_discount, l_tax, case l_returnflag when 'A' then 1.0::double when 'N' then 2.0::double when 'R' then 3.0::double else 4.0::double end as class from lineitem)"
    orders = "(select o_orderkey k, o_totalprice / 1000 as price, (o_custkey % 100)::double c from orders)"
    vectors = "(select i, j::integer j, v::double v from (select vec_id i, unnest(embedding) v, unnest(range(1, len(embedding) + 1)) j from embeddings))"
    large = f"(select * from {vectors} where abs(v) > 0.15)"
    parts = "(select p_partkey k, p_size::double x1, p_retailprice / 100 as x2 from part)"

    def full(source: str, cols: list[str], digits: int, more: str = "") -> str:
        z = ["1.0::double", *cols]
        keys = f"{more}, " if more else ""
        return " union all ".join(f"select {keys}{i + 1}::integer i, {j + 1}::integer j, round(sum({a} * {b}), {digits}) v from {source}" + (f" group by {more}" if more else "") for i, a in enumerate(z) for j, b in enumerate(z))

    def pairs(source: str) -> str:
        return f"(select 0 as i, i as r, v from (select distinct i, 1.0::double v from {source}) union all select j, i, v from {source})"

    def grid(source: str) -> str:
        return (
            f"select g.a + 1 as i, h.b + 1 as j, coalesce(round(s.v, 3), 0) v from (select unnest(range(0, {DIM + 1}))::integer a) g cross join (select unnest(range(0, {DIM + 1}))::integer b) h left join "
            f"(select x.i a, y.i b, sum(x.v * y.v) v from {pairs(source)} x join {pairs(source)} y using (r) group by all) s on s.a = g.a and s.b = h.b"
        )

    def diagonal(source: str, cols: list[str], digits: int, index: str = "i", more: str = "") -> str:
        cells = ["count(*)::double", *(f"sum({c})" for c in cols), *(f"sum({c} * {c})" for c in cols)]
        keys = f"{more}, " if more else ""
        return " union all ".join(f"select {keys}{k + 1}::integer {index}, round({c}, {digits}) v from {source}" + (f" group by {more}" if more else "") for k, c in enumerate(cells))

    def grouped(order: list[str], k: int) -> str:
        return f"select r::integer i, j, v from ({diagonal(items, order, 2, 'j', 'class')}) join (select class, row_number() over (order by class) r from (select distinct class from {items})) using (class) where r <= {k}"

    def fitted(rounds: int, chunks: int, omega: float, distance: bool = True) -> str:
        """Lloyd's method step by step: the state is one row of lists; `chunks` over 1 is the incremental mode."""
        of = lambda f: "[" + ", ".join(f"coalesce({f.format(g)}, 0)" for g in range(1, 5)) + "]"
        ctes = [
            f"p as materialized (select *, (k - min(k) over ()) // greatest((max(k) over () - min(k) over () + 1) // 10, 1) h, count(*) over () total from {parts})",
            "s0 as materialized (select [0.25, 0.25, 0.25, 0.25]::double[] w, list(x1 order by k) x, list(x2 order by k) y, [0, 0, 0, 0]::double[] r, [0, 0, 0, 0]::double[] q, 0.0::double away, 'inf'::double avg, false done from (select * from p order by k limit 4))",
        ]
        at = 0
        for t in range(rounds):
            for h in range(chunks):
                only = f"where h = {h}" if chunks > 1 else ""
                begin = "0.0::double" if h == 0 else "s.away"
                ctes.append(f"n{at} as materialized (select x1, x2, list_position(d, list_min(d)) g, sqrt(list_min(d)) dd from (select x1, x2, list_transform(range(1, 5), lambda i: (x1 - s.x[i]) * (x1 - s.x[i]) + (x2 - s.y[i]) * (x2 - s.y[i])) d from p, s{at} s {only}))")
                ctes.append(f"a{at} as materialized (select count(*) m, coalesce(sum(dd), 0) dd, {of('count(*) filter (g = {})')} c, {of('sum(x1) filter (g = {})')} lx, {of('sum(x2) filter (g = {})')} ly, {of('sum(x1 * x1) filter (g = {})')} qx, {of('sum(x2 * x2) filter (g = {})')} qy from n{at})")
                new = lambda l, old: f"list_transform(range(1, 5), lambda i: case when a.c[i] > 0 then a.{l}[i] / a.c[i] else s.{old}[i] end)"
                spread = lambda l, q, old: f"list_transform(range(1, 5), lambda i: case when a.c[i] > 0 then greatest(a.{q}[i] / a.c[i] - (a.{l}[i] / a.c[i]) * (a.{l}[i] / a.c[i]), 0) else s.{old}[i] end)"
                ctes.append(
                    f"u{at} as materialized (select case when m > 0 then list_transform(a.c, lambda n: n / m) else s.w end w, {new('lx', 'x')} x, {new('ly', 'y')} y, {spread('lx', 'qx', 'r')} r, {spread('ly', 'qy', 'q')} q, {begin} + dd away, s.avg, s.done from a{at} a, s{at} s)"
                )
                source = f"u{at}"
                if omega and (t == 0 if chunks > 1 else t < (rounds - 1) // 10 + 1):
                    order = "list_transform(list_sort(list_transform(range(1, 5), lambda i: {'w': w[i], 'i': i})), lambda o: o.i)"
                    moved = lambda c, r: f"list_transform(range(1, 5), lambda i: case when i = o[1] and w[i] < {omega / 4} then {c}[o[4]] + 0.5 * sqrt({r}[o[4]]) when i = o[2] and w[i] < {omega / 4} then {c}[o[3]] + 0.5 * sqrt({r}[o[3]]) else {c}[i] end)"
                    gone = lambda r: f"list_transform(range(1, 5), lambda i: case when i in (o[1], o[2]) and w[i] < {omega / 4} then 0.0 else {r}[i] end)"
                    ctes.append(f"v{at} as materialized (select w, {moved('x', 'r')} x, {moved('y', 'q')} y, {gone('r')} r, {gone('q')} q, away, avg, done from (select *, {order} o from u{at}))")
                    source = f"v{at}"
                last = h == chunks - 1
                score = "v.away / (select max(total) from p)"
                ctes.append(
                    f"s{at + 1} as materialized (select "
                    + ", ".join(f"case when s.done then s.{c} else v.{c} end {c}" for c in ("w", "x", "y", "r", "q", "away"))
                    + (f", case when s.done then s.avg else {score} end avg, s.done or abs({score} - s.avg) <= {km.EPSILON} done" if last else ", s.avg, s.done")
                    + f" from {source} v, s{at} s)"
                )
                at += 1
        cells = ", ".join(f"round({c}[i], 6) {n}" for c, n in (("w", "w"), ("x", "c1"), ("y", "c2"), ("r", "r1"), ("q", "r2")))
        return f"with {', '.join(ctes)} select i::integer as cluster, {cells}{', round(avg, 6) avg_distance' if distance else ''} from s{at}, (select unnest(range(1, 5)) i)"

    corr = lambda x, y: f"round(corr({x}, {y}), 7)"
    away = "[" + ", ".join(f"(x1 - {a}::double) * (x1 - {a}::double) + (x2 - {b}::double) * (x2 - {b}::double)" for a, b in CENTRES) + "]"
    near = f"(select k, x1, x2, list_position(a, list_min(a))::integer as cluster, list_min(a) square from (select *, {away} a from {parts}))"
    step = "(k % greatest(round(log2(n)), 1)::bigint + 1)::integer"
    numbered = f"(select *, {step.replace('k %', 'i %')} incr_step from (select *, row_number() over (order by k) i, count(*) over () n from {orders}))"
    matrix = "m as materialized (" + " union all ".join(f"select {i} as i, {j} as j, corr({a}, {b}) v from {items}" for i, a in enumerate(COLS, 1) for j, b in enumerate(COLS, 1)) + ")"
    signed = f"(select k, x1, -x2 as x2, (k % 7)::double x3, x1 * 0.3 + x2 as y from {parts})"
    cells = lambda source: f"(select k, 1 as l, x1 val, cluster j from {source} union all select k, 2, x2, cluster from {source})"
    three = f"(select l_quantity x, l_discount z, price y from {items})"
    sums = f"(select sum(x * x) a, sum(x * z) b, sum(z * z) c, sum(x * y) p, sum(z * y) q from {three})"
    return {
        "dense_summary": full(items, COLS, 2),
        "dense_summary_array": full(items, COLS, 2),
        "wide_summary": grid(vectors),
        "long_summary": grid(vectors),
        "sparse_summary": grid(large),
        "selfjoin_crossproduct": f"select a.j i, b.j j, round(sum(a.v * b.v), 3) v from {large} a join {large} b using (i) group by all",
        "diag_summary": diagonal(items, COLS, 2),
        "sparse_diag_summary": f"select 1 as i, count(*)::double v from embeddings union all select (j + 1)::integer, coalesce(round(l, 3), 0) from (select unnest(range(1, {DIM + 1})) j) left join (select j, sum(v) l from {large} group by j) using (j) "
        f"union all select (j + {DIM + 1})::integer, coalesce(round(q, 3), 0) from (select unnest(range(1, {DIM + 1})) j) left join (select j, sum(v * v) q from {large} group by j) using (j)",
        "group_diag_summary": grouped(["l_quantity", "price", "class"], 3),
        "group_diag_summary_idy": grouped(["l_quantity", "price", "class"], 2),
        "chunk_summary": full(f"(select * from {orders} where k >= 2000 and k < 3000)", ["price", "c"], 2),
        "cumulative_summary": "select chunk, i, j, round(sum(v) over (partition by i, j order by chunk), 2) v from (" + full(f"(select *, (k // 1000)::integer chunk from {orders})", ["price", "c"], 9, "chunk") + ")",
        "correlation_y": " union all ".join(f"select {i} as i, {corr(c, 'price')} v from {items}" for i, c in enumerate(["l_quantity", "l_discount", "l_tax"], 1)),
        "correlation_matrix": " union all ".join(f"select {i} as i, {j} as j, {corr(a, b)} v from {items}" for i, a in enumerate(COLS, 1) for j, b in enumerate(COLS, 1)),
        "preselect_topd": f"select case c when 1 then l_quantity when 2 then l_discount else l_tax end x1, price y from {items} cross join (select list_position(a, list_max(a)) c from (select [abs(corr(l_quantity, price)), abs(corr(l_discount, price)), abs(corr(l_tax, price))] a from {items}))",
        "linreg_origin": f"select 0 as i, round((p * c - q * b) / (a * c - b * b), 6) v from {sums} union all select 1, round((q * a - p * b) / (a * c - b * b), 6) from {sums}",
        "linreg_intercept": f"select 0 as i, round(regr_intercept(y, x), 6) v from {three} union all select 1, round(regr_slope(y, x), 6) from {three}",
        "kmeans_assign": f"select k, cluster, round(square, 6) square from {near}",
        "kmeans_step": f"select cluster, round(count(*) / (select count(*) from part), 8) w, round(avg(x1), 6) c1, round(avg(x2), 6) c2, round(var_pop(x1), 6) r1, round(var_pop(x2), 6) r2 from {near} group by cluster",
        "pca_corr": f"with {matrix} select i, j, round(v, 6) v from m",
        "pca_spectrum": f"with {matrix}, q as materialized (select a.i, b.j, sum(a.v * b.v) v from m a join m b on a.j = b.i group by all) select 0 as i, round(sum(v), 6) v from m where i = j union all select 1, round(sum(v), 6) from q where i = j "
        "union all select 2, round(sum(q.v * m.v), 6) from q join m on q.i = m.j and q.j = m.i union all select 3, round(sum(a.v * b.v), 6) from q a join q b on a.i = b.j and a.j = b.i",
        "incremental_regression": f"with s as (select (k // 5000)::integer as chunk, sum(c * c) a, sum(c * price) b from {orders} group by 1), t as (select chunk, sum(b) over (order by chunk) / sum(a) over (order by chunk) x, sum(b) over () / sum(a) over () y from s) "
        "select chunk, round(abs((x - y) / y), 8) as error from t",
        "kmeans_fit": fitted(10, 1, 0.5),
        "kmeans_incremental": fitted(3, 11, 0.5),
        "kmeans_configured": fitted(5, 1, 0),
        "kmeans_without_distance": fitted(5, 1, 0.5, False),
        "kmeans_assign_long": f"select k, cluster, round(square, 6) square from {near}",
        "kmeans_ch": " union all ".join(f"select {j} as j, {a}::double X1, {b}::double X2" for j, (a, b) in enumerate(CENTRES, 1)),
        "kmeans_xv": f"select k i, l, val from {cells(near)}",
        "kmeans_yd": "select k i, " + ", ".join(f"round((x1 - {a}::double) * (x1 - {a}::double) + (x2 - {b}::double) * (x2 - {b}::double), 6) d{j}" for j, (a, b) in enumerate(CENTRES, 1)) + f" from {parts}",
        "kmeans_ynn": f"select k i, cluster j from {near}",
        "kmeans_nmq": f"select l, j, count(*) N, round(sum(val), 6) M, round(sum(val * val), 6) Q from {cells(near)} group by l, j",
        "kmeans_wcr": f"select l, j, round(count(*) / (select count(*) from part), 6) W, round(avg(val), 6) C, round(var_pop(val), 6) R from {cells(near)} group by l, j",
        "kmeans_model": "select count(*) n, 3 as k, 0.5::double omega from part",
        "block_product": f"select a.j i, b.j j, round(sum(a.v * b.v), 3) v from {vectors} a join {vectors} b using (i) group by all",
        "csv_round_trip": full(items, COLS, 2),
        "csv_dimensions": "select count(*) n, 3 as d from orders",
        "binary_round_trip": f"with r as (select row_number() over (order by k) - 1 as r, price, c, count(*) over () n from {orders}), w as (select * from r union all select r + n, price, c, n from r where r < 7) "
        "select r + 1 as i, 1 as j, price v from w union all select r + 1, 2, c from w",
        "tiff_pixels": "select n_nationkey::bigint i, r_regionkey::bigint j, ((n_nationkey * 37 + r_regionkey * 11) % 256)::bigint v from nation cross join region where n_nationkey < 24 and r_regionkey < 4",
        "stored_cells": large[1:-1],
        "jdbc_table": "select * from region",
        "preselect_signed": f"with b as (select list_position(a, list_max(a)) c from (select [corr(x1, y), corr(x2, y), corr(x3, y)] a from {signed})) "
        f"select k i, c::integer as j, round(case c when 1 then x1 when 2 then x2 else x3 end, 6) v from {signed}, b union all select k, 4, round(y, 6) from {signed}",
        "activity_clean": "select case when event_id % 5 = 0 then 0.0 else coalesce(value, 0) end x1, (user_id % 10)::double x2, case event_id % 4 when 3 then 1.0::double else 0.0::double end y from events where event_id % 4 <> 0",
        "running_summary": "select count(*) n, round(sum(o_totalprice / 1000), 2) sum_price, round(sum((o_totalprice / 1000) * (o_totalprice / 1000)), 2) square_price from orders",
        "windowed_summary": "select epoch(date_trunc('day', ts))::bigint as day, count(*) n, round(sum(value), 2) sum_value, round(sum(value * value), 2) square_value from events group by 1",
        "unpivot_long": f"select k i, 1 as j, price v from {orders} union all select k, 2, c from {orders}",
        "pivot_wide": f"select i, max(v) filter (j = 1) x1, max(v) filter (j = 2) x2, max(v) filter (j = 3) x3, max(v) filter (j = 4) x4 from {vectors} group by i",
        "rowid_incr_step": f"select k, i, incr_step from {numbered}",
        "increment_vertical": f"select i, 1 as j, price v from {numbered} where incr_step = 1 union all select i, 2, c from {numbered} where incr_step = 1",
        "recode_label": "select o_orderkey, case o_orderpriority when '1-URGENT' then 7 when '2-HIGH' then 20 when '3-MEDIUM' then 25 else 1 end code from orders",
        "widen_by_duplication": f"select i, j, v from {vectors} where j <= 3 union all select i, j + 3, v from {vectors} where j <= 1",
        "narrow_columns": f"select i, j, v from {vectors} where j <= 2",
        "coordinate_points": f"select i, j::bigint j, v from {vectors} where j <= 2",
        "identity_scan": "select * from nation",
        "pi_midpoint": "select round(pi(), 8) pi",
        "class_statistics": f"select class, round(count(*) / (select count(*) from {items}), 8) prior, round(avg(l_quantity), 6) m1, round(avg(price), 6) m2, round(var_pop(l_quantity), 6) v1, round(var_pop(price), 6) v2 from {items} group by class",
    }
