"""Token-id output: Re-Pair grammar compression of id shards with random access.

Documents are range-partitioned by id, so that shards hold consecutive ranges in
ascending order; a shard's documents are encoded and cut into blocks of about
`BLOCK_IDS` ids.  In each block the most frequent id pairs are replaced by
nonterminals, round after round, until no pair occurs `LEAST` times; a round replaces
up to `RULES` pairs at once, left to right without overlap and never across documents.
A block stores its rules, the length that each nonterminal expands to and where each
document's symbols begin, so one document is decoded without the others.

Block format: b"RPG2", then six little-endian uint64 (documents, symbols, rules, first
nonterminal, ids of the block, ids of the shard before the block), then bit-packed
arrays: keys less their smallest (and that one as int64), key present, symbols a
document, ids a document, rules, expansion lengths, symbols; and a final little-endian
crc32 of all before it.  A bit-packed array is its width (one byte) and its numbers, high
bits first, filled up to whole bytes.  Blocks are the rows of a Parquet table (shard, block,
n_ids, data): Spark's writers commit them, so lost tasks leave no half files.  Reading
checks the crc.

Defined cases: a null text is empty; a null doc_id sorts first and is read back as
null; rows that repeat an id are written each, in order of a hash of their texts; other
columns are ignored; a long text may make its block longer; an empty table gives no blocks.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, tidy, written
from .tokens import END_ID, encoder

BLOCK_IDS, RULES, LEAST = 1 << 20, 16_384, 16
#: Bytes of text a shard should hold.
SHARD_BYTES = 16 << 20
#: Shards (a row of two numbers each) up to which their offsets are broadcast.
FEW_SHARDS = 1_000_000

_MAGIC = b"RPG2"
_HEAD = struct.Struct("<6Q")
_BITS = 18


def packed_bits(x: np.ndarray) -> bytes:
    """Numbers below 2^64 in as many bits each as the largest needs."""
    width = int(x.max()).bit_length() if len(x) else 0
    kind = ">u4" if width <= 32 else ">u8"
    size = np.dtype(kind).itemsize
    parts = [bytes([width])]
    for lo in range(0, len(x) if width else 0, 1 << 16):  # a multiple of eight numbers ends with a whole byte
        bits = np.unpackbits(x[lo : lo + (1 << 16)].astype(kind).view(np.uint8).reshape(-1, size), axis=1)
        parts.append(np.packbits(bits[:, 8 * size - width :]).tobytes())
    return b"".join(parts)


def unpacked_bits(data: bytes, at: int, n: int) -> tuple[np.ndarray, int]:
    """(numbers as uint64, place after them)."""
    width, at = data[at], at + 1
    out = np.zeros(n, np.uint64)
    kind = ">u4" if width <= 32 else ">u8"
    size = np.dtype(kind).itemsize
    for lo in range(0, n if width else 0, 1 << 16):
        part = min(1 << 16, n - lo)
        raw = np.frombuffer(data, np.uint8, -(-part * width // 8), at)
        at += len(raw)
        bits = np.zeros((part, 8 * size), np.uint8)
        bits[:, 8 * size - width :] = np.unpackbits(raw, count=part * width).reshape(part, width)
        out[lo : lo + part] = np.packbits(bits, axis=1).view(kind).ravel()
    return out, at


def _sorted(keys: np.ndarray, symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, sorted keys) of pairs of symbols; a pair and its place are sorted as one number where they fit, as that is faster."""
    bits, places = (symbols - 1).bit_length(), max(len(keys) - 1, 0).bit_length()
    if 2 * bits + places > 64:
        order = np.argsort(keys)
        return order, keys[order]
    low, place = np.uint64(0xFFFFFFFF), np.uint64((1 << places) - 1)
    both = (keys >> np.uint64(32) << np.uint64(bits) | keys & low) << np.uint64(places) | np.arange(len(keys), dtype=np.uint64)
    both.sort()
    order = (both & place).astype(np.int64)
    return order, keys[order]


def compress(ids: np.ndarray, starts: np.ndarray, first: int, most: int = RULES, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, symbol starts, rules, expansion lengths) of concatenated documents; `first` is the first free symbol."""
    seq = ids.astype(np.uint32)
    head = np.zeros(len(seq) + 1, bool)  # begins a document
    head[starts] = True
    rules, lengths = np.zeros((0, 2), np.uint32), np.zeros(0, np.uint32)
    every = False
    while len(seq) > 1:
        # counts of hashed pairs bound those of the pairs: only pairs of full cells are counted one by one
        cell = (seq[:-1] * np.uint32(0x9E3779B1) ^ seq[1:] * np.uint32(0x85EBCA77)) >> np.uint32(32 - _BITS)
        inner = ~head[1 : len(seq)]
        counts = np.bincount(cell[inner], minlength=1 << _BITS)
        bound = least if every else max(least, int(np.partition(counts, -2 * most)[-2 * most]))
        at = np.flatnonzero((counts >= bound)[cell] & inner)
        keys = seq[at].astype(np.uint64) << np.uint64(32) | seq[at + 1]
        order, sorted_keys = _sorted(keys, first + len(rules))
        lead = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])) if len(keys) else np.zeros(0, int)
        size = np.diff(np.concatenate([lead, [len(keys)]]))
        best = np.argsort(-size, kind="stable")[:most]
        best = np.sort(best[size[best] >= least])
        if not len(best):
            if bound == least:
                break
            every = True  # the fullest cells had none; look at all
            continue
        every = False
        rank = np.full(len(lead), -1)
        rank[best] = np.arange(len(best))
        chosen = np.empty(len(keys), np.int64)
        chosen[order] = np.repeat(rank, size)
        at, which = at[chosen >= 0], chosen[chosen >= 0]
        # of overlapping occurrences every second one of a run is taken, from the left
        run = np.concatenate([[0], np.cumsum(at[1:] != at[:-1] + 1)])
        place = np.arange(len(at)) - np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))[run]
        at, which = at[place % 2 == 0], which[place % 2 == 0]
        pairs = sorted_keys[lead[best]]
        pairs = np.stack([(pairs >> np.uint64(32)).astype(np.uint32), pairs.astype(np.uint32)], 1)
        seq = seq.copy()
        seq[at] = (first + len(rules) + which).astype(np.uint32)
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        rules = np.concatenate([rules, pairs])
        length = lambda s: np.where(s < first, 1, lengths[np.maximum(s.astype(np.int64) - first, 0)] if len(lengths) else 1)  # noqa: B023, E731
        lengths = np.concatenate([lengths, (length(pairs[:, 0]) + length(pairs[:, 1])).astype(np.uint32)])
        seq, head = seq[keep], np.append(head[:-1][keep], head[-1])
    places = np.flatnonzero(head[: len(seq)])
    return seq, np.append(places, len(seq)), rules, lengths


def _expansions(rules: np.ndarray, lengths: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
    """Every rule's ids, concatenated, and their offsets."""
    offsets = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    flat, done = np.zeros(int(offsets[-1]), np.uint32), 0
    newest = rules.max(1).astype(np.int64) - first if len(rules) else np.zeros(0, np.int64)
    while done < len(rules):
        # the rules up to the next one that needs one of them
        later = np.flatnonzero(newest[done:] >= done)
        stop = done + int(later[0]) if len(later) else len(rules)
        if stop == done:
            raise ValueError("a rule needs a later one")
        flat[offsets[done] : offsets[stop]] = _expanded(rules[done:stop].ravel(), first, lengths, flat, offsets)
        done = stop
    return flat, offsets


def _expanded(symbols: np.ndarray, first: int, lengths: np.ndarray, flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The ids that symbols stand for."""
    rule = symbols >= first
    which = np.where(rule, symbols.astype(np.int64) - first, 0)
    size = np.where(rule, lengths[which], 1).astype(np.int64)
    ends = np.cumsum(size)
    out = np.repeat(symbols, size)
    at = np.flatnonzero(np.repeat(rule, size))
    out[at] = flat[at + np.repeat((offsets[which] - ends + size)[rule], size[rule])]
    return out


def pack(keys: list[int | None], docs: list[np.ndarray], first: int, before: int, **options) -> bytes:
    sizes = np.array([len(d) for d in docs], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    if (sizes == 0).any():
        raise ValueError("a document needs one id at least")
    seq, symbols, rules, lengths = compress(np.concatenate(docs), starts[:-1], first, **options)
    known = np.array([k is not None for k in keys], bool)
    low = min((k for k in keys if k is not None), default=0)
    offset = np.array([0 if k is None else k - low for k in keys], np.uint64)
    arrays = (offset, known, np.diff(symbols), sizes, rules.ravel(), lengths, seq)
    head = _HEAD.pack(len(docs), len(seq), len(rules), first, int(starts[-1]), before) + struct.pack("<q", low)
    data = _MAGIC + head + b"".join(map(packed_bits, arrays))
    return data + struct.pack("<I", zlib.crc32(data))


class Block:
    """A block read back; `document(i)` decodes one document alone."""

    def __init__(self, data: bytes):
        if data[:4] != _MAGIC or zlib.crc32(memoryview(data)[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("not a sound block")
        docs, symbols, rules, self.first, self.n_ids, self.before = _HEAD.unpack_from(data, 4)
        at = 4 + _HEAD.size
        (low,) = struct.unpack_from("<q", data, at)
        arrays, at = [], at + 8
        for n in (docs, docs, docs, docs, 2 * rules, rules, symbols):
            x, at = unpacked_bits(data, at, n)
            arrays.append(x)
        offset, known, counts, sizes, pairs, lengths, self.symbols = arrays
        self.keys = [low + k if p else None for k, p in zip(offset.tolist(), known.tolist())]
        self.symbol_starts, self.starts = (np.concatenate([[0], np.cumsum(x.astype(np.int64))]) for x in (counts, sizes))
        self.rules, self.lengths, self.symbols = pairs.astype(np.uint32).reshape(-1, 2), lengths.astype(np.uint32), self.symbols.astype(np.uint32)
        self.flat, self.offsets = _expansions(self.rules, self.lengths, self.first)

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        return _expanded(symbols, self.first, self.lengths, self.flat, self.offsets) if len(self.lengths) else symbols.copy()

    def document(self, i: int) -> np.ndarray:
        return self.expand(self.symbols[self.symbol_starts[i] : self.symbol_starts[i + 1]])


def write_ids(documents: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, path: str | None = None, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Encode and write `documents`; the blocks (shard, block, n_ids, data) as read back."""
    docs = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    # rows that share an id are ordered, and cut, by their texts, equal ones by their place
    docs = docs.withColumn("h", F.xxhash64("text")).withColumn("m", F.monotonically_increasing_id())
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))

    def run(batches):
        enc, first = encoder(tokenizer), None
        shard, block, before = TaskContext.get().partitionId(), 0, 0
        keys: list = []
        held: list = []
        count = 0

        def flush():
            nonlocal keys, held, count, block, before
            data = pack(keys, held, first, before)
            out = pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "block": pa.array([block], pa.int32()), "n_ids": pa.array([count], pa.int64()), "data": pa.array([data], pa.binary())})
            before, block, keys, held, count = before + count, block + 1, [], [], 0
            return out

        first = len(enc.ends)
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                for key, ids in zip(part.column("id").to_pylist(), enc.encode(part.column("text").to_pylist(), end_id)):
                    keys.append(key)
                    held.append(ids)
                    count += len(ids)
                    if count >= block_ids:
                        yield flush()
        if held:
            yield flush()
        tidy()

    dealt = docs.repartitionByRange(shards, "id", "h", "m").sortWithinPartitions("id", "h", "m").select("id", "text")
    blocks = dealt.mapInArrow(run, "shard int, block int, n_ids long, data binary")
    if path is None:
        return written(blocks, "ids")
    blocks.write.parquet(path)
    return documents.sparkSession.read.schema(blocks.schema).parquet(path)


def read_ids(blocks: DataFrame) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document in written blocks."""
    # one row a shard: as many as the writer had tasks
    sums = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    base = sums.select("shard", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))

    def run(batch: pa.RecordBatch) -> dict:
        keys, starts, sizes, sums = [], [], [], []
        for data, base in zip(batch.column("data"), batch.column("base").to_pylist()):
            b = Block(data.as_buffer().to_pybytes())
            raw = memoryview(b.expand(b.symbols).astype("<u4").tobytes())
            for key, lo, hi in zip(b.keys, b.starts[:-1].tolist(), b.starts[1:].tolist()):
                keys.append(key)
                starts.append(base + b.before + lo)
                sizes.append(hi - lo)
                sums.append(zlib.crc32(raw[4 * lo : 4 * hi]))
        return {"id": pa.array(keys, pa.int64()), "start": pa.array(starts, pa.int64()), "n_tokens": pa.array(sizes, pa.int64()), "ids_crc32": pa.array(sums, pa.int64())}

    few = (blocks.agg(F.max("shard")).first()[0] or 0) < FEW_SHARDS
    return arrow_map(blocks.join(F.broadcast(base) if few else base, "shard").select("data", "base"), run, "id long, start long, n_tokens long, ids_crc32 long")


def token_ids(documents: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write all ids, read them back: one row per document."""
    return read_ids(write_ids(documents, tokenizer, id_col, text_col)).withColumnRenamed("id", id_col)
