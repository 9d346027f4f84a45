"""Summaries: with z = [1, x1 .. xd, y], the matrix of sums of z_i z_j, in one pass.

Full summaries are frames (i, j, v) with both triangles, 1-based.  Diagonal ones are
[n, sums, sums of squares].  All plans aggregate per partition first and shuffle one
small buffer a partition; only a triangle is computed, the rest mirrored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import numbers
from ..plans.planner import choose


def _mirrored(sums: DataFrame, cells: list[tuple[int, int, str]], keys: Sequence[str] = ()) -> DataFrame:
    """Rows (keys, i, j, v) of a row of named sums, both triangles."""
    both = [(i, j, n) for i, j, n in cells] + [(j, i, n) for i, j, n in cells if i != j]
    out = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.coalesce(F.col(n), F.lit(0.0).cast("double")).alias("v")) for i, j, n in both))
    return sums.select(*keys, F.explode(out).alias("c")).select(*keys, "c.i", "c.j", "c.v")


def _triangle(z: list[Column]) -> tuple[list[Column], list[tuple[int, int, str]]]:
    sums, cells = [], []
    for a in range(len(z)):
        for b in range(a + 1):
            name = f"s{a}_{b}"
            sums.append(F.sum(z[a] * z[b]).alias(name))
            cells.append((a + 1, b + 1, name))
    return sums, cells


def dense_summary(df: DataFrame, cols: Sequence[str], plan: str | None = None, on_null: str = "error", keys: Sequence[str] = ()) -> DataFrame:
    """Full summary of `cols` (the last one is y), per group of `keys` if given."""
    plan = plan or ("sql" if keys else choose(len(cols)))
    if plan == "sql":
        z = [F.lit(1.0).cast("double"), *(F.col(c) for c in cols)]
        sums, cells = _triangle(z)
        made = numbers(df, cols, on_null, keys)
        return _mirrored(made.groupBy(*keys).agg(*sums) if keys else made.agg(*sums), cells, keys)
    if plan == "arrow":
        return array_summary(numbers(df, cols, on_null).select(F.array(*cols).alias("row")), len(cols))
    raise ValueError(f"plan is sql or arrow, not {plan}")


def array_summary(df: DataFrame, d: int, col: str = "row") -> DataFrame:
    """Full summary of an array column of d doubles: matrix products of Arrow batches, summed.  A null, a null inside or another length raises."""

    def partial(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        total = np.zeros((d + 1, d + 1))
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column(0)
            cells = column.flatten()
            if column.null_count or cells.null_count or not pc.all(pc.equal(pc.list_value_length(column), d)).as_py():
                raise ValueError(f"every row needs {d} values")
            flat = cells.to_numpy(zero_copy_only=False)
            z = np.column_stack([np.ones(len(column)), flat.reshape(-1, d)])
            total += z.T @ z
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_pydict({"i": pa.array(i.ravel() + 1, pa.int32()), "j": pa.array(j.ravel() + 1, pa.int32()), "v": pa.array(total.ravel())})

    return df.select(F.col(col).cast("array<double>").alias("row")).mapInArrow(partial, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))


def block_product(df: DataFrame, d: int, block: int = 512, col: str = "row", spread: int = 1) -> DataFrame:
    """(i, j, v): products of all pairs of columns of an array column, without a constant, for rows too wide for one matrix a task.

    Columns are cut into blocks; a pair of blocks is one product of at most `block` x `block`
    cells, kept by one task for each of `spread` parts of the rows and summed at last.
    """
    if d < 1 or block < 1 or spread < 1:
        raise ValueError("d, block and spread must be positive")
    cuts = -(-d // block)
    pairs = [(p, q) for p in range(cuts) for q in range(p + 1)]
    row = F.col(col).cast("array<double>")
    sound = row.isNotNull() & (F.size(row) == d) & ~F.exists(row, lambda x: x.isNull())
    part = lambda p: F.slice("row", F.col(p) * block + 1, block).alias(f"x{p}")
    rows = df.select(F.when(sound, row).otherwise(F.raise_error(F.lit(f"every row needs {d} values"))).alias("row"))
    rows = rows.withColumn("s", F.pmod(F.xxhash64("row"), F.lit(spread)).cast("int"))
    tiles = rows.select("row", "s", F.inline(F.array(*(F.struct(F.lit(p).alias("p"), F.lit(q).alias("q")) for p, q in pairs)))).select("p", "q", "s", part("p"), part("q"))

    def product(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def cells(at, total):
            i, j = np.indices(total.shape)
            i, j, v = i.ravel() + at[0] * block + 1, j.ravel() + at[1] * block + 1, total.ravel()
            yield pa.RecordBatch.from_pydict({"i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "v": pa.array(v)})
            if at[0] != at[1]:
                yield pa.RecordBatch.from_pydict({"i": pa.array(j, pa.int32()), "j": pa.array(i, pa.int32()), "v": pa.array(v)})

        held, total = None, None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("p", "q")])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if lo == hi:
                    continue
                at = tuple(keys[:, lo].tolist())
                x, y = (batch.column(c).slice(lo, hi - lo).flatten().to_numpy(zero_copy_only=False).reshape(hi - lo, -1) for c in ("xp", "xq"))
                if at != held:
                    if held:
                        yield from cells(held, total)
                    held, total = at, np.zeros((x.shape[1], y.shape[1]))
                total += x.T @ y
        if held:
            yield from cells(held, total)

    dealt = tiles.repartition("p", "q", "s").sortWithinPartitions("p", "q")
    return dealt.mapInArrow(product, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))


def csv_summary(spark, path: str, d: int) -> DataFrame:
    """Full summary of a CSV file of d numeric columns without a header."""
    from ..sources.files import read_csv

    return dense_summary(read_csv(spark, path, d), [f"x{k}" for k in range(1, d + 1)])


def _offset(df: DataFrame, first: int) -> DataFrame:
    return df.select("i", (F.col("j") - (first - 1)).cast("int").alias("j"), F.col("v").cast("double").alias("v"))


def long_summary(df: DataFrame, d: int, first: int = 1) -> DataFrame:
    """Full summary of a dense long table whose rows have d cells (y included) each; a missing cell raises."""
    rows = _offset(df, first).groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", "v"))).alias("cells"))
    sound = (F.size("cells") == d) & (F.transform("cells", lambda c: c["j"]) == F.sequence(F.lit(1), F.lit(d))) & ~F.exists("cells", lambda c: c["v"].isNull())
    values = F.transform("cells", lambda c: c["v"])
    return array_summary(rows.select(F.when(sound, values).otherwise(F.raise_error(F.lit("a row lacks cells"))).alias("row")), d)


def sparse_summary(df: DataFrame, d: int, first: int = 1, n_rows: int | None = None) -> DataFrame:
    """Full summary from stored cells: pairs of each row's cells, so work follows the cells stored.

    n counts rows with a stored cell, unless `n_rows` says how many there are.
    """
    cells = F.array_sort(F.collect_list(F.struct("j", "v")))
    rows = _offset(df, first).groupBy("i").agg(cells.alias("c"))
    full = F.concat(F.array(F.struct(F.lit(0).alias("j"), F.lit(1.0).cast("double").alias("v"))), F.col("c"))
    a = rows.select(full.alias("c")).select("c", F.explode("c").alias("a"))
    pairs = a.select("a", F.explode("c").alias("b")).where("b.j <= a.j")
    sums = pairs.groupBy(F.col("a.j").alias("p"), F.col("b.j").alias("q")).agg(F.sum(F.col("a.v") * F.col("b.v")).alias("v"))
    half = sums.select("p", "q", F.when((F.col("p") == 0) & F.lit(n_rows is not None), F.lit(n_rows).cast("double")).otherwise(F.col("v")).alias("v"))
    both = half.union(half.where("p <> q").select("q", "p", "v"))
    grid = df.sparkSession.range((d + 1) ** 2).select((F.floor(F.col("id") / (d + 1))).cast("int").alias("p"), (F.col("id") % (d + 1)).cast("int").alias("q"))
    n = F.lit(0.0 if n_rows is None else float(n_rows)).cast("double")
    out = grid.join(both, ["p", "q"], "left")
    return out.select((F.col("p") + 1).alias("i"), (F.col("q") + 1).alias("j"), F.coalesce("v", F.when((F.col("p") == 0) & (F.col("q") == 0), n).otherwise(F.lit(0.0))).alias("v"))


def selfjoin_crossproduct(df: DataFrame) -> DataFrame:
    """Sums of v v' over equal i, by an equi join: cross products only, no constant column."""
    a, b = df.select("i", F.col("j").alias("p"), F.col("v").alias("x")), df.select("i", F.col("j").alias("q"), F.col("v").alias("y"))
    return a.join(b, "i").groupBy(F.col("p").alias("i"), F.col("q").alias("j")).agg(F.sum(F.col("x") * F.col("y")).alias("v"))


def _diagonal(cols: Sequence[str]) -> list[Column]:
    zero = F.lit(0.0).cast("double")
    return [F.count(F.lit(1)).cast("double"), *(F.coalesce(F.sum(c), zero) for c in cols), *(F.coalesce(F.sum(F.col(c) * F.col(c)), zero) for c in cols)]


def _listed(sums: DataFrame, n: int, keys: Sequence[str] = (), name: str = "i") -> DataFrame:
    cells = F.array(*(F.struct(F.lit(k + 1).alias(name), F.col(f"s{k}").alias("v")) for k in range(n)))
    return sums.select(*keys, F.explode(cells).alias("c")).select(*keys, f"c.{name}", "c.v")


def diag_summary(df: DataFrame, cols: Sequence[str], on_null: str = "error") -> DataFrame:
    """(i, v): n, then the sums, then the sums of squares of `cols`."""
    made = _diagonal(cols)
    return _listed(numbers(df, cols, on_null).agg(*(c.alias(f"s{k}") for k, c in enumerate(made))), len(made))


def sparse_diag_summary(df: DataFrame, d: int, n_rows: int, first: int = 1) -> DataFrame:
    """Diagonal summary from stored cells; n is the number of rows, stored or not."""
    sums = _offset(df, first).groupBy("j").agg(F.sum("v").alias("l"), F.sum(F.col("v") * F.col("v")).alias("q"))
    grid = df.sparkSession.range(1, d + 1).select(F.col("id").cast("int").alias("j"))
    cells = grid.join(sums, "j", "left").select(F.explode(F.array(F.struct((F.col("j") + 1).alias("i"), F.col("l").alias("v")), F.struct((F.col("j") + 1 + d).alias("i"), F.col("q").alias("v")))).alias("c")).select("c.i", F.coalesce("c.v", F.lit(0.0)).alias("v"))
    return df.sparkSession.range(1).select(F.lit(1).alias("i"), F.lit(float(n_rows)).cast("double").alias("v")).union(cells)


def group_diag_summary(df: DataFrame, cols: Sequence[str], k: int, id_y: int | None = None) -> DataFrame:
    """(i, j, v): the diagonal summary of each class, i its rank; the first k classes by value.

    `id_y` is the 1-based place of the class column (the last by default); it moves last.
    """
    id_y = len(cols) if id_y is None else id_y
    if k < 1 or not 1 <= id_y <= len(cols):
        raise ValueError("k must be positive and id_y a column's place")
    y = cols[id_y - 1]
    order = [c for c in cols if c != y] + [y]
    made = _diagonal(order)
    sums = numbers(df, order).groupBy(F.col(y).alias("_class")).agg(*(c.alias(f"s{n}") for n, c in enumerate(made)))
    # classes, not rows: the first k come from a top-k of the grouped frame
    first = sums.orderBy("_class").limit(k)
    ranked = first.withColumn("i", F.row_number().over(Window.orderBy("_class")))
    return _listed(ranked, len(made), ["i"], "j")


def chunk_id(key: str, size: int, start: int = 0) -> Column:
    return F.floor((F.col(key) - start) / size).cast("int")


def chunk_summary(df: DataFrame, key: str, cols: Sequence[str], chunk: int, size: int, start: int = 0, on_null: str = "error") -> DataFrame:
    """Full summary of one chunk of rows by key; empty if there are none.  The filter is a range of the key, so it reaches the scan."""
    lo = start + chunk * size
    rows = df.where((F.col(key) >= lo) & (F.col(key) < lo + size)).select(*cols)
    return dense_summary(rows.withColumn("_k", F.lit(1)), cols, "sql", on_null, keys=["_k"]).drop("_k")


def cumulative_summary(df: DataFrame, key: str, cols: Sequence[str], size: int, start: int = 0, on_null: str = "error") -> DataFrame:
    """(chunk, i, j, v): the summary of all rows up to each chunk's end; partial sums, then a window over chunks."""
    rows = df.select(chunk_id(key, size, start).alias("_chunk"), *cols)
    parts = dense_summary(rows, cols, "sql", on_null, keys=["_chunk"]).withColumnRenamed("_chunk", "chunk")
    up_to = Window.partitionBy("i", "j").orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)
    return parts.select("chunk", "i", "j", F.sum("v").over(up_to).alias("v"))
