"""Nearest neighbours by a block matrix join with int8 tiles.

Every vector is made a unit vector and quantised to int8, with a scale and the norm of the
error; only these are dealt out.  Queries and candidates are dealt into blocks; each pair of
blocks is one tile.  The integer product of a tile (computed exactly in floating point)
gives every cosine up to a bound made of the two quantisation errors.  Pairs whose upper
bound reaches the k-th best lower bound survive, in their tile and then among all tiles of a
query; they are joined with the original vectors, recomputed in double precision and merged
by heaps.  The result is exact.

Equal vectors of a tile (by a 128-bit digest) are multiplied once: of each, the k + 1 smallest
ids suffice.

Defined cases: vectors that are null, zero, or hold null or non-finite components take
no part; candidates of another dimension than the query's are none; rows that share
the query's id are its own; rows that repeat an id count by the best of their scores; ties go to
the smaller id; a query with fewer candidates gets all; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, swept, tasks, tidy, written

QUERY_BLOCK, CANDIDATE_BLOCK, STRIP = 2048, 8192, 256


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two each, which changes no cosine and keeps squares from running over or under."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])


def _norms(x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x))
    for d in range(x.shape[1]):
        out += x[:, d] * x[:, d]
    return np.sqrt(out)


def _quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 values, scales and error norms of unit vectors."""
    scale = np.abs(x).max(1) / 127
    q = np.rint(x / scale[:, None]).astype(np.int8)
    return q, scale, np.sqrt(((x - q * scale[:, None]) ** 2).sum(1))


def _by_dim(v: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their vectors as a matrix) of each dimension in a column of arrays."""
    flat, ends = v.flatten().to_numpy(zero_copy_only=False), np.cumsum(pc.list_value_length(v).to_numpy(zero_copy_only=False))
    dims = np.diff(ends, prepend=0)
    for d in np.unique(dims):
        rows = np.flatnonzero(dims == d)
        yield rows, flat[(ends[rows] - d)[:, None] + np.arange(d)]


def _small(batch: pa.RecordBatch) -> dict:
    """A batch's vectors as int8, with scale, error and digest."""
    n = batch.num_rows
    q, same, scale, err = [b""] * n, [b""] * n, np.zeros(n), np.zeros(n)
    for rows, x in _by_dim(batch.column("v")):
        y = _scaled(x)
        small, scale[rows], err[rows] = _quantised(y / _norms(y)[:, None])
        for r, a, b in zip(rows.tolist(), small, x):
            q[r], same[r] = a.tobytes(), hashlib.blake2b(b.tobytes(), digest_size=16).digest()
    return {**{c: batch.column(c) for c in ("id", "dim", "asks")}, "q": pa.array(q, pa.binary()), "scale": pa.array(scale), "err": pa.array(err), "same": pa.array(same, pa.binary())}


class Side(NamedTuple):
    """Quantised vectors of a block."""

    ids: np.ndarray
    q: np.ndarray
    scale: np.ndarray
    err: np.ndarray
    same: np.ndarray

    def take(self, at) -> Side:
        return Side(*(x[at] for x in self))


def tile(queries: Side, held: Side, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(query, candidate, lower and upper bound of the cosine) of the pairs of a tile that may be among a query's k nearest."""
    held = held.take(np.argsort(held.ids, kind="stable"))
    first, inverse = np.unique(held.same, axis=0, return_index=True, return_inverse=True)[1:]
    by = np.argsort(inverse.ravel(), kind="stable")
    heads = np.searchsorted(inverse.ravel()[by], np.arange(len(first) + 1))
    smallest = [held.ids[by[a : min(b, a + k + 1)]] for a, b in zip(heads[:-1], heads[1:])]
    sizes = np.array([len(x) for x in smallest])
    listed, begin = np.concatenate(smallest), np.concatenate([[0], np.cumsum(sizes)])
    unique = held.take(first)
    # integers below 2^24 are exact in single precision
    kind = np.float32 if queries.q.shape[1] * 127 * 127 < 1 << 24 else np.float64
    qc = unique.q.astype(kind).T.copy()
    for lo in range(0, len(queries.ids), STRIP):
        s = queries.take(slice(lo, lo + STRIP))
        about = (s.q.astype(kind) @ qc).astype(np.float64) * s.scale[:, None] * unique.scale
        slack = s.err[:, None] + (1 + s.err[:, None]) * unique.err + 1e-9
        low = about - slack
        if low.shape[1] > k:
            # the (k+1)-th distinct vector: one of them may be the query's own
            least = np.partition(low, -(k + 1), axis=1)[:, -(k + 1)]
            i, j = np.nonzero(about + slack >= least[:, None])
        else:
            i, j = (x.ravel() for x in np.indices(low.shape))
        at = np.repeat(begin[j] - np.concatenate([[0], np.cumsum(sizes[j])[:-1]]), sizes[j]) + np.arange(sizes[j].sum())
        i, j = np.repeat(i, sizes[j]), np.repeat(j, sizes[j])
        other = listed[at] != s.ids[i]
        i, j, at = i[other], j[other], at[other]
        yield s.ids[i], listed[at], low[i, j], (about + slack)[i, j]


def _cosines(batch: pa.RecordBatch) -> dict:
    score = np.zeros(batch.num_rows)
    for (rows, x), (_, y) in zip(_by_dim(batch.column("x")), _by_dim(batch.column("y"))):
        x, y = _scaled(x), _scaled(y)
        dot = np.zeros(len(x))
        for d in range(x.shape[1]):
            dot += x[:, d] * y[:, d]
        score[rows] = dot / (_norms(x) * _norms(y))
    return {"query_id": batch.column("query_id"), "vec_id": batch.column("vec_id"), "score": pa.array(score)}


def _groups(batches, keys: list[str]):
    """Tables of rows that agree on the keys, from sorted batches."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        k = np.stack([rows[c].to_numpy() for c in keys])
        cuts = [0, *(np.flatnonzero((k[:, 1:] != k[:, :-1]).any(0)) + 1).tolist(), rows.num_rows]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            part = rows.slice(lo, hi - lo)
            if held and any(held[-1][c][0].as_py() != part[c][0].as_py() for c in keys):
                yield pa.concat_tables(held)
                held = []
            held.append(part)
    if held:
        yield pa.concat_tables(held)


@swept
def nearest(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k nearest rows."""
    v = F.col(vector_col).cast("array<double>")
    sound = F.col(vector_col).isNotNull() & F.col(id_col).isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.where(sound).select(F.col(id_col).cast("long").alias("id"), v.alias("v"), F.size(v).alias("dim"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    total, asking, width = rows.agg(F.count(F.lit(1)), F.count(F.when(F.col("asks"), 1)), F.coalesce(F.sum("dim"), F.lit(0))).first()
    n_c, n_q = max(1, -(-total // CANDIDATE_BLOCK)), max(1, -(-asking // QUERY_BLOCK))
    small = written(arrow_map(rows, _small, "id long, dim int, asks boolean, q binary, scale double, err double, same binary"), "quantised")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    columns = ["id", "q8", "scale", "err", "same"]
    named = small.withColumnRenamed("q", "q8")
    asks = named.where("asks").select("dim", block(n_q).alias("q"), all_of(n_c).alias("c"), F.lit(0).alias("side"), *columns)
    held = named.select("dim", all_of(n_q).alias("q"), block(n_c).alias("c"), F.lit(1).alias("side"), *columns)
    keys = ["dim", "q", "c"]

    def tiles(batches):
        for t in _groups(batches, keys):
            side, dim = t["side"].to_numpy(), t["dim"][0].as_py()
            bytes_of = lambda c, kind, n: np.frombuffer(b"".join(t[c].to_pylist()), kind).reshape(-1, n)  # noqa: B023, E731
            both = Side(t["id"].to_numpy(), bytes_of("q8", np.int8, dim), t["scale"].to_numpy(), t["err"].to_numpy(), bytes_of("same", np.uint64, 2))
            if (side == 0).any() and (side == 1).any():
                for got in tile(both.take(side == 0), both.take(side == 1), k):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in got], names=["query_id", "vec_id", "low", "up"])
        tidy()

    def survivors(batches):
        for t in _groups(batches, ["query_id"]):
            low, up = t["low"].to_numpy(), t["up"].to_numpy()
            keep = up >= (np.partition(low, -k)[-k] if len(low) > k else -np.inf)
            ids = np.unique(t["vec_id"].to_numpy()[keep])
            yield pa.RecordBatch.from_pydict({"query_id": pa.array(np.full(len(ids), t["query_id"][0].as_py(), np.int64)), "vec_id": pa.array(ids)})

    def merge(batches):
        for t in _groups(batches, ["query_id"]):
            scores: dict[int, float] = {}
            for v, x in zip(t["vec_id"].to_pylist(), t["score"].to_pylist()):
                scores[v] = max(x, scores.get(v, -2.0))
            best = heapq.nsmallest(k, ((-x, v) for v, x in scores.items()))
            n = len(best)
            yield pa.RecordBatch.from_pydict({"query_id": pa.array([t["query_id"][0].as_py()] * n, pa.int64()), "rank": pa.array(range(1, n + 1), pa.int32()), "vec_id": pa.array([b[1] for b in best], pa.int64()), "score": pa.array([-b[0] for b in best], pa.float64())})

    pair = "query_id long, vec_id long"
    found = asks.union(held).repartition(tasks(vectors, (width + 48 * total) * n_q), *keys).sortWithinPartitions(*keys, "side", "id").mapInArrow(tiles, f"{pair}, low double, up double")
    some = tasks(vectors, 32 * (k + 2) * asking * n_c)
    pairs = written(found.repartition(some, "query_id").sortWithinPartitions("query_id").mapInArrow(survivors, pair), "survivors")
    # only the survivors' original vectors are sent
    whole = pairs.join(rows.select(F.col("id").alias("vec_id"), F.col("v").alias("y"), "dim"), "vec_id").join(rows.where("asks").select(F.col("id").alias("query_id"), F.col("v").alias("x"), "dim"), ["query_id", "dim"])
    scored = arrow_map(whole.select("query_id", "vec_id", "x", "y"), _cosines, f"{pair}, score double")
    return scored.repartition(tasks(vectors, 24 * (k + 2) * asking), "query_id").sortWithinPartitions("query_id").mapInArrow(merge, "query_id long, rank int, vec_id long, score double")
