"""Shared pieces: the shared folder, Arrow batches, byte-level words, components."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from momenta.sources.files import remove, scratch, shared_dir  # noqa: F401

#: Bytes of text that one vectorised step takes at once; a longer text is a step of its own.
STEP_BYTES = 512 << 10


def written(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    if _made:
        _made[-1].append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


#: What the operators at work have written, the innermost last.
_made: list[list[tuple[SparkSession, str]]] = []


def swept(operator: Callable) -> Callable:
    """An operator that removes at its end what it has written and its result doesn't read."""

    @functools.wraps(operator)
    def run(*args, **options):
        _made.append([])
        try:
            out = operator(*args, **options)
            used = out.inputFiles() if isinstance(out, DataFrame) else []
        except BaseException:
            used = []
            raise
        finally:
            made = _made.pop()
            names = {f.rsplit("/", 2)[-2] for f in used}
            for spark, path in made:
                if path.rsplit("/", 1)[-1] not in names:
                    remove(spark, path)
                elif _made:
                    _made[-1].append((spark, path))
        return out

    return run


@functools.cache
def _libc() -> ctypes.CDLL:
    return ctypes.CDLL(None)


def tidy() -> None:
    """Give freed memory back to the system: a worker lives on beside others after its task."""
    pa.default_memory_pool().release_unused()
    if hasattr(_libc(), "malloc_trim"):
        _libc().malloc_trim(0)


def part_rows(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about `most` bytes of a column (one row at least)."""
    for lo, hi in steps(texts(batch.column(column))[1], most):
        yield batch.slice(lo, hi - lo)


def free_names(df: DataFrame, *names: str) -> tuple[str, ...]:
    """The names, each with as many underscores before it as no column of the frame has (whatever the case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
        taken.add(name.lower())
    return tuple(out)


def replaced(df: DataFrame, *names: str) -> DataFrame:
    """The frame without columns of these names, which an operator is to add."""
    return df.drop(*(c for c in df.columns if c.lower() in {n.lower() for n in names}))


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], dict | None], schema: str) -> DataFrame:
    """mapInArrow over batches; `fn` maps a batch to columns (a dict) or None."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                if out is not None:
                    yield pa.RecordBatch.from_pydict(out)
                del out
                tidy()

    return df.mapInArrow(run, schema)


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its n+1 offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def steps(offsets: np.ndarray, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `most` bytes (one row at least)."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def lookup(members: Callable[[int], bool]) -> np.ndarray:
    return np.array([members(b) for b in range(256)])


#: A-Z to a-z, other bytes as they are.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)

_RNG = np.random.default_rng(20240607)
_VALUES = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C17)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
#: Bytes that are hashed at once.
_BLOCK = 64 << 10


@functools.cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(_BLOCK, b, np.uint64)])) for b in (_BASE, _BASE_INVERSE))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


class Words:
    """Words of some texts: maximal runs of bytes that `word` marks, with 64-bit hashes.

    start, end: byte ranges; first: word range of text i is first[i]:first[i+1].
    """

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, word: np.ndarray):
        self.raw, n = LOWER[raw], len(raw)
        inside = np.empty(n + 1, bool)
        inside[:n] = word[self.raw]
        inside[n] = False
        before = np.empty(n, bool)
        before[:1] = False
        before[1:] = inside[: max(n - 1, 0)]
        cuts = offsets[(offsets < n)]
        before[cuts] = False
        after = inside[1:].copy()
        after[cuts[cuts > 0] - 1] = False
        inside = inside[:n]
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.hash = np.zeros(len(self.start), np.uint64)
        power, inverse = _powers()
        lo = 0
        while lo < len(self.start):
            a = self.start[lo]
            hi = int(np.searchsorted(self.end, a + _BLOCK, "right"))
            if hi > lo:
                raw = self.raw[a : self.end[hi - 1]]
                sums = np.zeros(len(raw) + 1, np.uint64)
                np.cumsum(_VALUES[raw] * power[: len(raw)], out=sums[1:])
                s, e = self.start[lo:hi] - a, self.end[lo:hi] - a
                self.hash[lo:hi] = (sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64)
                lo = hi
            else:  # a word longer than a block
                total, size = 0, int(self.end[lo] - a)
                for at in range(0, size, _BLOCK):
                    raw = self.raw[a + at : min(a + at + _BLOCK, self.end[lo])]
                    total += int((_VALUES[raw] * power[: len(raw)]).sum()) * pow(int(_BASE), at, 1 << 64)
                self.hash[lo] = total + size & (1 << 64) - 1
                lo += 1
        self.hash = mix(self.hash)

    def grams(self, k: int) -> np.ndarray:
        """Hash of the k words from each word on; the last k-1 of a text reach past its end."""
        n = len(self.hash)
        out = np.zeros(n, np.uint64)
        for j in range(min(k, n)):
            out[: n - j] += self.hash[j:] * np.uint64((0xD1342543DE82EF95 ** (j + 1)) % (1 << 64) | 1)
        return mix(out + np.uint64(k))


#: Most bits of an id filter (32 MB); with more ids it lets more others through.
FILTER_BITS = 1 << 28


def id_filter(ids: DataFrame) -> np.ndarray:
    """A Bloom filter of one hash over a frame of longs `id`: at most FILTER_BITS bits come to the driver."""
    n = ids.count()
    bits = min(FILTER_BITS, 1 << max(10, (16 * n).bit_length()))
    place = F.pmod(F.xxhash64("id"), F.lit(bits))
    cells = ids.select(place.alias("p")).groupBy(F.floor(F.col("p") / 64).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("b"))
    got = cells.toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[got["w"].to_numpy()] = got["b"].to_numpy()
    return out


def in_filter(cells: np.ndarray, ids: pa.Array) -> np.ndarray:
    """Which ids a filter may hold."""
    p = spark_hash(np.asarray(ids)) % np.int64(len(cells) * 64)
    return (cells[p >> 6] >> (p & 63)) & 1 == 1


def spark_hash(x: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of longs (XXH64 of their eight bytes, seed 42)."""
    p1, p2, p3, p4, p5 = (np.uint64(v) for v in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda v, r: v << np.uint64(r) | v >> np.uint64(64 - r)
    h = np.uint64(42) + p5 + np.uint64(8) ^ turn(x.astype(np.int64).view(np.uint64) * p2, 31) * p1
    h = turn(h, 27) * p1 + p4
    h ^= h >> np.uint64(33)
    h *= p2
    h ^= h >> np.uint64(29)
    h *= p3
    h ^= h >> np.uint64(32)
    return h.view(np.int64)


#: Bytes that a task of a shuffle by a plain key should get.
TASK_BYTES = 64 << 20


def tasks(df: DataFrame, size: int) -> int:
    """Tasks for `size` bytes: the session's number at least."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))


#: Rows of two numbers that one task may well get, whatever their keys.
PLAIN_ROWS = 1_000_000


def joined(rows: DataFrame, facts: DataFrame, keys: list[str], how: str = "inner", count: int | None = None) -> DataFrame:
    """`rows` with the `facts` of their keys, one row a key, where a key may have very many rows.

    Facts are written first and both sides sorted by key, so that adaptive execution sees two
    plain shuffles and cuts the rows of a hot key among tasks.  Where `count` says that all rows
    together are no burden for a task, the join is left to Spark.
    """
    if count is not None and count <= PLAIN_ROWS:
        return rows.join(facts, keys, how)
    return rows.join(written(facts, "facts").hint("merge"), keys, how)


def components(edges: DataFrame) -> DataFrame:
    """(a, b) edges of longs -> (id, label), label the smallest id reachable.

    Alternating large-star and small-star steps: rounds grow with the logarithm
    of a component's length.  Each round is written to the shared folder; only
    a count comes to the driver.
    """
    both = lambda e: e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before, count = None, edges.count()
    while True:
        # large star: larger neighbours go to the smallest of the neighbourhood
        sym = both(edges)
        low = sym.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        big = joined(sym, low, ["a"], count=2 * count).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        if 2 * count > PLAIN_ROWS:
            big = written(big, "star")
        # small star: smaller neighbours and the node itself go to the smallest
        low = big.groupBy("a").agg(F.min("b").alias("m"))
        small = joined(big, low, ["a"], count=2 * count).select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        edges = written(small, "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == before:
            break
        before, count = now, now[0]
    return both(edges).groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("label"))
