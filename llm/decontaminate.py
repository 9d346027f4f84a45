"""Benchmark decontamination by winnowing.

Words are runs of digits, letters and non-ASCII characters of the text with A-Z
lower-cased.  A benchmark window is `window` consecutive item words; an item with
fewer words is one window.  Fingerprints are the minimum `k`-gram hashes of every
`window - k + 1` consecutive k-grams, so any shared span of `window` words shares
one.  An item too short to be winnowed has one fingerprint, the hash of all its words, held
against as many document words from every word on.

Documents' fingerprints that pass a filter of bounded size over the benchmark's are joined with
those; the items of the join are the only ones that can occur anywhere.  Their windows go to
the executors, and each document's hits are extended to the windows around them where the text
lies, word by word (64-bit hashes of all their words).  Documents are read twice and never shuffled;
items that occur are sent in blocks of at most `BLOCK_WORDS` words, and each block beyond the first
`CHAIN` writes the documents once more.

Defined cases: null or wordless documents have no words and no hits; items with a
null id or without words are ignored; rows of items that repeat count once; an empty benchmark
hits nothing; an empty table gives no rows; a very long text is one step of its own; documents'
other columns are kept by `annotate`, but one named as its output gives way to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Words, arrow_map, id_filter, in_filter, lookup, mix, replaced, steps, swept, texts, tidy, written

WINDOW, K, BLOCK_WORDS = 10, 5, 1_000_000
#: Blocks that one pass over the documents takes, each in a worker of its own.
CHAIN = 2

_WORD = lookup(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)


def _starts(w: Words, length: int) -> np.ndarray:
    """Words from which `length` words of the same text follow."""
    counts = np.maximum(np.diff(w.first) - length + 1, 0)
    shift = np.repeat(w.first[:-1] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
    return np.arange(counts.sum()) + shift


def _winnowed(w: Words, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the selected k-grams, and all k-gram hashes; the last minimum of a window is taken."""
    grams = w.grams(k)
    at = _starts(w, window)
    if not len(at):
        return at, grams
    span = window - k + 1
    best, low = at + span - 1, grams[at + span - 1]
    for j in range(span - 2, -1, -1):
        g = grams[at + j]
        less = g < low
        low = np.where(less, g, low)
        best = np.where(less, at + j, best)
    keep = np.zeros(len(grams), bool)
    keep[best] = True
    return np.flatnonzero(keep), grams


class Index:
    """Fingerprints and windows of a block of items: sorted arrays, by window length."""

    def __init__(self, ids: list[str], items: list[str], window: int, k: int):
        self.window, self.k, self.names = window, k, sorted(set(ids))
        number = {x: i for i, x in enumerate(self.names)}
        raw, offsets = texts(pa.array(items, pa.large_string()))
        w = Words(raw, offsets, _WORD)
        sizes = np.diff(w.first)
        chosen, grams = _winnowed(w, k, window)
        self.prints = np.unique(grams[chosen])
        self.tables = {}
        item = np.repeat(np.array([number[x] for x in ids], np.int64), sizes)
        for n in sorted({min(int(s), window) for s in sizes if s}):
            full = w.grams(n)
            at = _starts(w, n) if n == window else w.first[:-1][sizes == n]
            order = np.lexsort((item[at], full[at]))
            at = at[order]
            pair = np.concatenate([[True], (full[at][1:] != full[at][:-1]) | (item[at][1:] != item[at][:-1])])
            at = at[pair]
            keys, first = np.unique(full[at], return_index=True)
            words = np.stack([w.hash[at[first] + j] for j in range(n)], 1)
            self.tables[n] = (keys, np.concatenate([first, [len(at)]]), item[at], words)

    def hits(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hit words as a mask; (text, item number) of items that occur."""
        mask = np.zeros(len(w.hash) + 1, np.int64)
        found: list[np.ndarray] = []
        for n, (keys, ends, items, words) in self.tables.items():
            at = _starts(w, n)
            if n == self.window and len(at):
                chosen, grams = _winnowed(w, self.k, n)
                seen = chosen[_in(grams[chosen], self.prints) >= 0]
                near = np.zeros(len(w.hash) + 1, bool)
                for j in range(n - self.k + 1):  # extend to every window that holds the k-gram
                    near[np.maximum(seen - j, 0)] = True
                at = at[near[at]]
            if not len(at):
                continue
            full = w.grams(n)
            row = _in(full[at], keys)
            at, row = at[row >= 0], row[row >= 0]
            same = np.ones(len(at), bool)
            for j in range(n):
                same &= w.hash[at + j] == words[row, j]
            at, row = at[same], row[same]
            np.add.at(mask, at, 1)
            np.add.at(mask, at + n, -1)
            counts = ends[row + 1] - ends[row]
            text = np.searchsorted(w.first, at, "right") - 1
            which = np.arange(counts.sum()) + np.repeat(ends[row] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
            found.append(np.unique(np.repeat(text, counts) * len(self.names) + items[which]))
        pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        return np.cumsum(mask[:-1]) > 0, pairs // max(len(self.names), 1), pairs % max(len(self.names), 1)


def _in(x: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Place of each x in the sorted keys, or -1."""
    if not len(keys):
        return np.full(len(x), -1)
    at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return np.where(keys[at] == x, at, -1)


def _prints(w: Words, n: int, window: int, k: int) -> np.ndarray:
    """Fingerprints as longs: selected k-grams, or for items under `window` words runs of their length n."""
    if n == window:
        chosen, grams = _winnowed(w, k, window)
        return mix(grams[chosen] ^ np.uint64(window)).view(np.int64)
    return mix(w.grams(n)[_starts(w, n)] ^ np.uint64(n)).view(np.int64)


def occurring(documents: DataFrame, items: DataFrame, window: int, k: int) -> DataFrame:
    """The `items` (item, text) that share a fingerprint with a document (text)."""

    def of_items(batch: pa.RecordBatch) -> dict | None:
        raw, offsets = texts(batch.column("text"))
        out: list[tuple[int, int, str]] = []
        for lo, hi in steps(offsets):
            for i in range(lo, hi):
                w = Words(raw[offsets[i] : offsets[i + 1]], offsets[i : i + 2] - offsets[i], _WORD)
                n = min(len(w.hash), window)
                name = batch.column("item")[i].as_py()
                out += [(int(x), n, name) for x in (np.unique(_prints(w, n, window, k)) if n else ())]
        ids, sizes, names = zip(*out) if out else ((), (), ())
        return {"id": pa.array(ids, pa.int64()), "n": pa.array(sizes, pa.int32()), "item": pa.array(names, pa.string())}

    prints = written(arrow_map(items, of_items, "id long, n int, item string"), "prints")
    sizes = [r["n"] for r in prints.select("n").distinct().collect()]  # at most `window` numbers
    if not sizes:
        return items.limit(0)
    wanted = documents.sparkSession.sparkContext.broadcast(id_filter(prints.select("id").distinct()))

    def of_documents(batch: pa.RecordBatch) -> dict:
        raw, offsets = texts(batch.column("text"))
        found = []
        for lo, hi in steps(offsets):
            w = Words(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], _WORD)
            for n in sizes:
                got = _prints(w, n, window, k)
                found.append(np.unique(got[in_filter(wanted.value, got)]))
        return {"id": pa.array(np.unique(np.concatenate(found)))}

    shared = arrow_map(documents.select("text"), of_documents, "id long").distinct()
    return items.join(prints.join(shared, "id").select("item").distinct(), "item", "left_semi")


def _blocks(items: DataFrame, window: int, k: int, block_words: int) -> Iterator[Index]:
    ids, held, words = [], [], 0
    for name, text in items.select("item", "text").toLocalIterator():  # a block at a time is held
        ids.append(name)
        held.append(text)
        words += len(text) // 2 + 1
        if words >= block_words:
            yield Index(ids, held, window, k)
            ids, held, words = [], [], 0
    if held:
        yield Index(ids, held, window, k)


@swept
def annotate(documents: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, k: int = K, block_words: int = BLOCK_WORDS, name: str = "contamination") -> DataFrame:
    """`documents` with a struct `name`: n_words, hits (hit words' numbers), items (ids as sorted strings)."""
    if not 1 <= k <= window:
        raise ValueError("1 <= k <= window")
    documents = replaced(documents, name)
    spark, columns = documents.sparkSession, documents.columns
    kind = T.StructType().add("n_words", "long").add("hits", T.ArrayType(T.IntegerType())).add("items", T.ArrayType(T.StringType()))
    schema = T.StructType([*documents.schema.fields, T.StructField(name, kind)])
    items = benchmark.where(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_id).cast("string").alias("item"), F.col(item_text).cast("string").alias("text"))
    found = written(occurring(documents.select(F.col(text_col).cast("string").alias("text")), items, window, k), "items")

    def step(shared, again: bool):
        def run(batches):
            index = shared.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                raw, offsets = texts(batch.column(text_col).cast(pa.string()))
                before = batch.column(name).to_pylist() if again else None
                n_words, hits, items = [], [], []
                for lo, hi in steps(offsets):
                    w = Words(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], _WORD)
                    n_words += np.diff(w.first).tolist()
                    mask, text, item = index.hits(w)
                    at = np.flatnonzero(mask)
                    owner = np.searchsorted(w.first, at, "right") - 1
                    cuts = np.searchsorted(owner, np.arange(hi - lo + 1))
                    own = np.searchsorted(text, np.arange(hi - lo + 1))
                    for i in range(hi - lo):
                        hits.append((at[cuts[i] : cuts[i + 1]] - w.first[i]).tolist())
                        items.append([index.names[x] for x in item[own[i] : own[i + 1]]])
                if before:
                    hits = [sorted({*b["hits"], *h}) for b, h in zip(before, hits)]
                    items = [sorted({*b["items"], *x}) for b, x in zip(before, items)]
                made = pa.StructArray.from_arrays([pa.array(n_words, pa.int64()), pa.array(hits, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))], names=["n_words", "hits", "items"])
                keep = {c: batch.column(c) for c in columns}
                yield pa.RecordBatch.from_arrays([*keep.values(), made], names=[*keep, name])
                tidy()

        return run

    out, done = documents, 0
    for index in _blocks(found, window, k, block_words):
        if done and done % CHAIN == 0:
            out = written(out, "contamination")
        out = out.mapInArrow(step(spark.sparkContext.broadcast(index), done > 0), schema)
        done += 1
    if not done:
        out = out.mapInArrow(step(spark.sparkContext.broadcast(Index([], [], window, k)), False), schema)
    return out


def contamination(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: its id, n_words, n_hit, n_items, items_sha256, contaminated."""
    docs = documents.select(id_col, F.col(text_col).cast("string").alias("text"))
    c = F.col("contamination")
    return annotate(docs, benchmark, **options).select(
        id_col,
        c["n_words"].alias("n_words"),
        F.size(c["hits"]).cast("long").alias("n_hit"),
        F.size(c["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(c["items"], ",").cast("binary"), 256).alias("items_sha256"),
        (F.size(c["hits"]) > 0).alias("contaminated"),
    )
