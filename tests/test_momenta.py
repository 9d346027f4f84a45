import struct

import numpy as np
import pytest

from momenta.functions.frames import increments, to_long, to_rows, to_wide
from momenta.operators import kmeans as km
from momenta.operators import models, select, summary
from momenta.plans.planner import choose
from momenta.sources import files, generate
from momenta.streaming.incremental import Accumulator


def frame(spark, x):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "k long, " + ", ".join(f"x{j} double" for j in range(1, x.shape[1] + 1)))


def oracle(x):
    z = np.column_stack([np.ones(len(x)), x])
    return z.T @ z


@pytest.fixture(scope="module")
def x():
    return np.random.default_rng(3).normal(2, 3, (203, 4))


COLS = ["x1", "x2", "x3", "x4"]


def test_full_summaries_agree(spark, x):
    df = frame(spark, x)
    for cells in (summary.dense_summary(df, COLS, "sql"), summary.dense_summary(df, COLS, "arrow"), summary.long_summary(to_long(df, "k", COLS), 4), summary.sparse_summary(to_long(df, "k", COLS, True), 4)):
        assert np.allclose(models.SummaryMatrix.of(cells).m, oracle(x))


def test_offsets_missing_cells_and_nulls(spark, x):
    df = frame(spark, x[:9])
    moved = to_long(df, "k", COLS).selectExpr("i", "j + 4 as j", "v")
    assert np.allclose(models.SummaryMatrix.of(summary.long_summary(moved, 4, first=5)).m, oracle(x[:9]))
    with pytest.raises(Exception):
        summary.long_summary(to_long(df, "k", COLS).where("not (i = 3 and j = 2)"), 4).collect()
    holes = df.selectExpr("if(k = 1, null, x1) as x1", "x2")
    with pytest.raises(Exception):
        summary.dense_summary(holes, ["x1", "x2"], "sql").collect()
    assert summary.diag_summary(holes, ["x1", "x2"], "drop").where("i = 1").first()["v"] == 8


def test_sparse_row_counts(spark):
    x = np.array([[0, 0], [1, 0], [0, 2.0]])
    cells = to_long(frame(spark, x), "k", ["x1", "x2"], sparse=True)
    assert models.SummaryMatrix.of(summary.sparse_summary(cells, 2)).n == 2
    assert models.SummaryMatrix.of(summary.sparse_summary(cells, 2, n_rows=3)).n == 3
    assert [r["v"] for r in summary.sparse_diag_summary(cells, 2, 3).orderBy("i").collect()] == [3, 1, 2, 1, 4]


def test_diagonal_groups_and_chunks(spark, x):
    df = frame(spark, x).selectExpr("*", "cast(k % 3 as double) as y")
    m = oracle(x)
    assert np.allclose([r["v"] for r in summary.diag_summary(df, COLS).orderBy("i").collect()], [*m[0], *np.diag(m)[1:]])
    for k, cols, at in ((2, ["x1", "y"], None), (5, ["y", "x1"], 1)):
        rows = summary.group_diag_summary(df, cols, k, at).collect()
        assert len(rows) == 5 * min(k, 3)
        assert {r["i"]: r["v"] for r in rows if r["j"] == 2} == pytest.approx({c + 1: x[c::3, 0].sum() for c in range(min(k, 3))})
    parts = [models.SummaryMatrix.of(summary.chunk_summary(df, "k", COLS, c, 50)).m for c in range(6)]
    assert not parts[5].size and np.allclose(sum(parts[:5]), m)
    last = summary.cumulative_summary(df, "k", COLS, 50).where("chunk = 4")
    assert np.allclose(models.SummaryMatrix.of(last).m, m)


def test_empty_input(spark):
    df = spark.createDataFrame([], "x1 double, x2 double")
    for plan in ("sql", "arrow"):
        cells = summary.dense_summary(df, ["x1", "x2"], plan).collect()
        assert all(r["v"] == 0 for r in cells)
    assert summary.diag_summary(df, ["x1"]).first()["v"] == 0


def test_models(spark, x):
    y = x[:, :3] @ [1.0, -2, 0.5] + 3
    full = np.column_stack([x[:, :3], y])
    s = models.SummaryMatrix.of(summary.dense_summary(frame(spark, full), COLS, "sql"))
    b, kept = models.linreg_intercept(s)
    assert np.allclose(b, [3, 1, -2, 0.5]) and kept == [0, 1, 2]
    assert np.allclose(models.linreg_origin(s), np.linalg.lstsq(full[:, :3], y, rcond=None)[0])
    assert np.allclose(s.corr(), np.corrcoef(full.T))
    assert models.pca(s)[0].sum() == pytest.approx(4)
    flat = models.SummaryMatrix(oracle(np.column_stack([np.ones(5), np.arange(5), np.arange(5)])))
    with pytest.raises(ValueError):
        models.linreg_origin(models.SummaryMatrix(oracle(np.array([[1, 2, 1.0], [2, 4, 2], [3, 6, 5]]))))
    assert np.isnan(flat.corr()[0, 1])


def test_selection(spark, x):
    df = frame(spark, np.column_stack([x[:, 0], np.ones(len(x)), -x[:, 3], x[:, 3]]))
    got = {r["i"]: r["v"] for r in select.correlation_y(df, COLS).collect()}
    assert got[2] is None and got[3] == pytest.approx(-1)
    assert select.preselect(df, COLS, 1).columns == ["x3", "x4"]
    assert select.ranked([(1, 0.5), (2, -0.5), (3, None)], 1) == [1]
    assert select.ranked([(1, -0.9), (2, 0.1)], 1, signed=True) == [2]
    with pytest.raises(ValueError):
        select.ranked([(1, 0.1)], 2)


def test_kmeans(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(c, 0.1, (40, 2)) for c in (0, 10)])[rng.permutation(80)]
    got = km.kmeans(frame(spark, x), ["x1", "x2"], 2, "k", 20, omega=0)
    assert sorted(np.round(got.c[:, 0])) == [0, 10] and got.w.sum() == pytest.approx(1)
    ties = km.assigned(spark.createDataFrame([(5.0,)], "x1 double"), ["x1"], np.array([[4.0], [6.0]])).first()
    assert ties["cluster"] == 1
    w, c, r = km.updated(np.array([[1.0], [2]]), np.zeros((2, 1)), np.array([0, 4.0]), np.array([[0], [8.0]]), np.array([[0], [20.0]]))
    assert c[0, 0] == 1 and r[1, 0] == 1
    assert km.reseeded(np.array([0.1, 0.9]), np.array([[0.0], [4]]), np.array([[1.0], [4]]), 0.5)[0][0, 0] == 5
    with pytest.raises(ValueError):
        km.kmeans(frame(spark, x), ["x1", "x2"], 81, "k")
    assert km.parse_config("incremental=TRUE, omega = 0.5") == {"incremental": False, "omega": 0.5}
    assert km.parse_config("") == {"incremental": False, "omega": 0.0}


def test_forms_and_sources(spark, x, tmp_path):
    df = frame(spark, x[:7])
    long = to_long(df, "k", COLS)
    assert to_wide(long, 4).orderBy("i").first()["x3"] == x[0, 2]
    assert to_rows(long).where("i = 6").first()["row"] == x[6].tolist()
    numbered = increments(df.select("k"), "k").orderBy("k").collect()
    assert [r["i"] for r in numbered] == list(range(1, 8)) and {r["incr_step"] for r in numbered} == {1, 2, 3}
    raw = tmp_path / "m.bin"
    raw.write_bytes(x[:3].astype("<f8").tobytes())
    back = files.read_binary(spark, str(raw), 5, 4).orderBy("i", "j").collect()
    assert len(back) == 20 and back[12]["v"] == x[0, 0]
    parts = sorted(files.to_binary(df, "k", COLS).collect(), key=lambda r: r["first"])
    assert b"".join(bytes(r["data"]) for r in parts) == x[:7].astype("<f8").tobytes()
    raw.write_bytes(b"123")
    with pytest.raises(Exception):
        files.read_binary(spark, str(raw), 1, 4)
    (tmp_path / "a.csv").write_text("1,2\n3,4.5\n")
    assert np.allclose(models.SummaryMatrix.of(summary.csv_summary(spark, str(tmp_path / "a.csv"), 2)).m, oracle(np.array([[1, 2], [3, 4.5]])))
    tags = [(256, 4, 3), (257, 4, 2), (258, 3, 8), (259, 3, 1), (273, 4, 8), (279, 4, 6)]
    tiff = b"II" + struct.pack("<HI", 42, 14) + bytes(range(6)) + struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", t, k, 1, v) for t, k, v in tags)
    (tmp_path / "a.tif").write_bytes(tiff)
    assert [r["v"] for r in files.read_tiff(spark, str(tmp_path / "a.tif"), width=2).orderBy("i", "j").collect()] == [0, 1, 3, 4]


def test_generators_and_streams(spark, x, tmp_path):
    share = generate.sparse_values(spark, 500, 4, 0.1).count() / 2000
    assert 0.06 < share < 0.14
    assert generate.gaussian_clusters(spark, 20, 2, 3).count() == generate.gaussian_columns(spark, 20, 2).count() == 20
    raw = spark.createDataFrame([(float("nan"), 0), (1.0, 4), (float("nan"), 1)], "a double, c int")
    assert sorted(map(tuple, generate.clean_activity(raw, ["a"], "c", [4]).collect())) == [(0.0, 0.0), (1.0, 1.0)]
    add = Accumulator(["x1", "x2"])
    df = frame(spark, x)
    for b in (0, 1, 1):
        add(df.where(f"k % 2 = {b}"), b)
    assert np.allclose(add.total().m, oracle(x[:, :2]))
    assert choose(4) == "sql" and choose(30) == "arrow" and choose(30, 0.01) == "long"


def test_whole_table_queries(spark, tmp_path):
    from momenta import queries as q

    e = np.random.default_rng(4).normal(0, 0.1, (7, q.DIM)).astype(np.float32)
    spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(e)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    y, found = e.astype(float), q.queries()
    cells = {(i, j + 1, y[i, j]) for i in range(7) for j in range(q.DIM)}
    rows = lambda name: [tuple(r) for r in found[name](spark, str(tmp_path)).collect()]
    points, wider, wide = rows("coordinate_points_all"), rows("widen_by_duplication_all"), rows("pivot_wide_all")
    assert len(points) == len(cells) and set(points) == cells
    assert len(wider) == 2 * len(cells) and set(wider) == cells | {(i, j + q.DIM, v) for i, j, v in cells}
    assert sorted(wide) == [(i, *y[i].tolist()) for i in range(7)]
    got = {(i, j): v for i, j, v in rows("selfjoin_crossproduct_all")}
    assert len(got) == q.DIM**2 and all(abs(v - (y.T @ y)[i - 1, j - 1]) <= 6e-4 for (i, j), v in got.items())


def test_row_numbers_with_payload_ties_and_nulls(spark):
    r = np.random.default_rng(8)
    keys = [*r.permutation(700).tolist(), *[350] * 400, *[None] * 30, 9, 9]
    df = spark.createDataFrame([(k, float(n), f"x{n}") for n, k in enumerate(keys)], "k long, v double, s string")
    for slots in (1, 3, 8, 16, 32):
        rows = increments(df, "k", slots).collect()
        assert sorted(x["i"] for x in rows) == list(range(1, len(keys) + 1))
        by_i = [x["k"] for x in sorted(rows, key=lambda x: x["i"])]
        assert by_i == sorted(keys, key=lambda k: (k is not None, k or 0))
        assert all(x["incr_step"] == x["i"] % 10 + 1 for x in rows)  # log2(1132) is 10.1
    assert increments(df.limit(0), "k").count() == 0
    assert [x["incr_step"] for x in increments(df.limit(1), "k").collect()] == [1]
    text = increments(df.select("s"), "s", 5).collect()
    assert [x["s"] for x in sorted(text, key=lambda x: x["i"])] == sorted(f"x{n}" for n in range(len(keys)))
    with pytest.raises(ValueError):
        increments(df.withColumnRenamed("v", "i"), "k")


def test_null_policy_of_keyed_summaries(spark):
    df = spark.createDataFrame([(0, 1.0, None), (1, 2.0, 3.0), (10, 5.0, 7.0)], "k long, x double, y double")
    for made in (lambda p: summary.chunk_summary(df, "k", ["x", "y"], 0, 10, on_null=p), lambda p: summary.cumulative_summary(df, "k", ["x", "y"], 10, on_null=p)):
        with pytest.raises(Exception):
            made("error").collect()
    n = lambda p: models.SummaryMatrix.of(summary.chunk_summary(df, "k", ["x", "y"], 0, 10, on_null=p))
    assert np.allclose(n("zero").m, oracle(np.array([[1, 0], [2, 3.0]]))) and np.allclose(n("drop").m, oracle(np.array([[2, 3.0]])))
    last = summary.cumulative_summary(df, "k", ["x", "y"], 10, on_null="drop").where("chunk = 1")
    assert np.allclose(models.SummaryMatrix.of(last).m, oracle(np.array([[2, 3.0], [5, 7]])))
    with pytest.raises(Exception):
        list(models.incremental_regression(df, "k", ["x", "y"], 10))


def test_array_rows_of_wrong_shape_raise(spark):
    for rows in ([[1.0], [2.0, 3.0, 4.0]], [[1.0, None]], [None, [1.0, 2.0]]):
        df = spark.createDataFrame([(r,) for r in rows], "row array<double>").coalesce(1)
        for made in (summary.array_summary(df, 2), summary.block_product(df, 2)):
            with pytest.raises(Exception):
                made.collect()


def test_block_product(spark):
    x = np.random.default_rng(2).normal(size=(50, 7))
    df = spark.createDataFrame([(r.tolist(),) for r in x], "row array<double>")
    for block, spread in ((3, 2), (7, 1), (100, 4), (1, 1)):
        cells = {(r["i"], r["j"]): r["v"] for r in summary.block_product(df, 7, block, spread=spread).collect()}
        assert len(cells) == 49 and np.allclose([[cells[i, j] for j in range(1, 8)] for i in range(1, 8)], x.T @ x)
    assert summary.block_product(df.limit(0), 7).count() == 0


def test_incremental_regression_passes_over_gaps(spark):
    x = np.random.default_rng(1).normal(size=(60, 2))
    df = spark.createDataFrame([(i if i < 30 else i + 1000, *map(float, r)) for i, r in enumerate(x)], "k long, a double, b double")
    got = list(models.incremental_regression(df, "k", ["a", "b"], 20))
    assert [c for c, _ in got] == [0, 1, 51, 52, 53, 54][: len(got)] and got[-1][1] == pytest.approx(0)
    exact = (x[:, 0] @ x[:, 1]) / (x[:, 0] @ x[:, 0])
    assert got[0][1] == pytest.approx(abs((x[:20, 0] @ x[:20, 1]) / (x[:20, 0] @ x[:20, 0]) / exact - 1))
    assert models.relative_error(np.array([1.0, 3.0]), np.array([2.0, 3.0])) == 0.5


def test_kmeans_forms(spark):
    x = np.random.default_rng(7).normal(size=(40, 3))
    df, c = frame(spark, x), x[:4]
    cols = ["x1", "x2", "x3"]
    near = ((x[:, None] - c[None]) ** 2).sum(2)
    t = km.tables(df, cols, "k", c, 0.25)
    assert {r["i"]: r["j"] for r in t["YNN"].collect()} == {i: int(a) + 1 for i, a in enumerate(near.argmin(1))}
    assert np.allclose([r[1:] for r in sorted(map(tuple, t["YD"].collect()))], near)
    w = {(r["l"], r["j"]): (r["W"], r["C"], r["R"]) for r in t["WCR"].collect()}
    for j in range(4):
        mine = x[near.argmin(1) == j]
        assert np.allclose([w[a + 1, j + 1] for a in range(3)], [(len(mine) / 40, m, v) for m, v in zip(mine.mean(0), mine.var(0))])
    assert t["XV"].count() == 120 and t["CH"].count() == 4 and tuple(t["model"].first()) == (40, 4, 0.25)
    centroids = spark.createDataFrame([(k + 1, j + 1, float(v)) for (k, j), v in np.ndenumerate(c)], "cluster int, j int, c double")
    long = km.assigned_long(to_long(df, "k", cols), centroids).collect()
    assert {r["i"]: r["cluster"] for r in long} == {i: int(a) + 1 for i, a in enumerate(near.argmin(1))}
    ours = km.kmeans(df, cols, 4, "k", config="omega=0")
    centres, cost = km.library_kmeans(df, cols, 4)
    assert centres.shape == (4, 3) and cost <= 1.5 * sum(ours.w[k] * 40 * ours.r[k].sum() for k in range(4))
    assert km.parse_config("omega=,incremental=true") == {"incremental": True, "omega": 0.0}


def test_generated_rows_do_not_depend_on_partitions(spark):
    made = []
    for parts in (1, 5):
        old = spark.conf.get("spark.sql.leafNodeDefaultParallelism", None)
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", parts)
        made.append([sorted(map(tuple, f.collect())) for f in (generate.gaussian_clusters(spark, 300, 2, 3), generate.gaussian_columns(spark, 300, 2), generate.sparse_values(spark, 50, 4, 0.3))])
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism") if old is None else spark.conf.set("spark.sql.leafNodeDefaultParallelism", old)
    assert made[0] == made[1]
    x = np.array(generate.gaussian_columns(spark, 4000, 1, batch=4000).select("x1").collect())
    assert abs(x.std() - 1) < 0.05


def test_sinks_and_groups(spark, x, tmp_path):
    df = frame(spark, x[:40])
    files.write_binary(df, "k", COLS, f"{tmp_path}/m.bin")
    assert (tmp_path / "m.bin").read_bytes() == x[:40].astype("<f8").tobytes()
    files.write_csv(df.drop("k"), f"{tmp_path}/csv")
    back = files.read_csv(spark, f"{tmp_path}/csv", 4)
    assert files.dimensions(back) == (40, 4) and sorted(map(tuple, back.collect())) == sorted(map(tuple, x[:40]))
    assert sorted(map(tuple, files.store(df, f"{tmp_path}/s").collect())) == sorted(map(tuple, df.collect()))
    files.remove(spark, f"{tmp_path}/s")
    assert not (tmp_path / "s").exists()
    assert files.grey_tiff(files.tiff_file(2, 3, bytes(range(6)))) == (2, 3, bytes(range(6)))
    cells = summary.group_diag_summary(df.selectExpr("x1", "cast(k % 3 as double) y"), ["x1", "y"], 5)
    assert models.group_matrix(cells).shape == (3, 5)
    with pytest.raises(ValueError):
        models.group_matrix(cells, 5)
    chosen = select.preselect_long(to_long(df, "k", COLS), [(1, -0.9), (2, 0.2), (3, 0.1)], 1)
    assert {r["j"] for r in chosen.select("j").distinct().collect()} == {2, 4}


def test_stream_summaries(spark, tmp_path):
    from momenta.queries import queries

    spark.range(100).selectExpr("id o_orderkey", "id * 10.0D o_totalprice").write.parquet(f"{tmp_path}/orders.parquet")
    assert tuple(queries()["running_summary"](spark, str(tmp_path)).first()) == (100, 49.5, 32.84)
    spark.range(50).selectExpr("timestamp_seconds(id * 7200) ts", "id * 1.0D value").write.parquet(f"{tmp_path}/events.parquet")
    got = queries()["windowed_summary"](spark, str(tmp_path)).orderBy("day").collect()
    assert [(r["day"], r["n"], r["sum_value"]) for r in got] == [(86400 * k, len(v), float(sum(v))) for k in range(5) if (v := range(12 * k, min(50, 12 * k + 12)))]


def test_short_numbers_and_timing(spark):
    from momenta.plans.timing import short, timed

    assert [short(n) for n in (1_000_000, 25_400, 1_000, 999, 7, 123_456_789)] == ["001M", "025K", "001K", "999", "007", "123M"]
    assert len(timed(spark.range(3), 2)) == 2


_ON_A_CLUSTER = """
import sys, __spark_entry__ as entry
from momenta.sources import files
from pyspark.sql import SparkSession
conf = {"spark.master": "local-cluster[2,1,1024]", "spark.executor.memory": "512m", "spark.ui.enabled": "false", "spark.driver.host": "127.0.0.1", "spark.checkpoint.dir": "file://" + sys.argv[1]}
spark = SparkSession.builder.config(map=conf).getOrCreate()
assert entry.queries()["jdbc_table"](spark, sys.argv[1]).repartition(2).count() == 7
rows = spark.createDataFrame([(1, None, 0.5, "it's"), (None, 1 << 40, None, None)], "a int, b long, c double, d string")
back = files.read_jdbc(spark, files.derby_copy(spark, rows, "t"), "t", driver=files.DERBY)
assert back.dtypes == rows.dtypes, back.dtypes
assert sorted(back.collect(), key=str) == sorted(map(tuple, rows.collect()), key=str)
assert not files.read_jdbc(spark, files.derby_copy(spark, rows.limit(0), "t"), "t", driver=files.DERBY).count()
spark.stop()
"""


def test_jdbc_table_where_executors_are_processes_of_their_own(spark, tmp_path):
    import os
    import subprocess
    import sys

    spark.range(7).selectExpr("cast(id as int) r_regionkey", "concat('R', id) r_name").write.parquet(str(tmp_path / "region.parquet"))
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    own = {k: v for k, v in os.environ.items() if not k.startswith(("PYSPARK_GATEWAY", "_PYSPARK", "SPARK_"))} | {"PYTHONPATH": root}
    done = subprocess.run([sys.executable, "-c", _ON_A_CLUSTER, str(tmp_path)], env=own, cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
