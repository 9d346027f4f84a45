"""MinHash near-dedup by a chosen-path set similarity join.

Every text is the set of its distinct word shingles (64-bit hashes of 4 words by
default).  Texts with equal sets form a class with one representative.  Each of
`TREES` independent trees branches the representatives recursively: a node's
child is named by the minwise token that its own hash function selects, so two
sets stay together at a level with probability J.  Nodes of up to `SMALL` members
are leaves; larger ones branch on, up to `DEPTH` levels.  At J = 0.8 a pair is
missed by all trees with probability 0.2^12 on the first level and 0.49^12 on the
third.

Leaves are compared exhaustively on sketches (128 one-permutation bins, a threshold
five standard deviations below the wanted similarity); what passes is confirmed on
full sets.  Leaves over `BLOCK` members are cut into blocks, and pairs of blocks
compared, so that no task holds a whole group.  The first round emits a spanning
forest of each block's candidate graph, the second all candidates between
components still apart, so a group of n near copies costs about n confirmations
and no link between different components is lost.  A block with more than `DENSE`
such candidates a member emits none: its leaf is dealt again, with full sets, in
blocks of about `TOKENS` shingles, which are compared exactly where they are and
emit a spanning forest of links.  So no step emits more than a few rows a member.

Classes rest on the size and two 64-bit sums of hashes of a set; links between classes on
the full sets of 64-bit hashes.  Keys that many rows share (a node of near copies, a class
of equal texts, the hub of a star) are joined so that adaptive execution can cut them.

Defined cases: null, empty or wordless texts have an empty set and link with
nothing; rows with null ids take part in nothing and are components of none (null);
rows that repeat an id are one vertex, which links all their texts; a very long text is
hashed in steps, its set alone is held whole; an empty table gives no rows; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, arrow_map, components, id_filter, in_filter, joined, lookup, mix, steps, swept, tasks, texts, tidy, written

TREES, DEPTH, SMALL, BLOCK, BINS = 12, 3, 64, 2048, 128
DENSE, TOKENS = 4, 500_000
#: Confirmations of one text that share a task.
SHARE = 256
#: About the bytes of a leaf's row; leaves (rows of two numbers) up to which their cuts are broadcast.
ROW_BYTES, FEW = 200, 100_000

_WORD = lookup(lambda b: b not in (0x20, *range(0x09, 0x0E)))


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, concatenated, and their offsets."""
    w = Words(raw, offsets, _WORD)
    grams, first, sets = w.grams(k), w.first.tolist(), []
    for lo, hi in zip(first[:-1], first[1:]):
        if hi - lo >= k:
            g = np.sort(grams[lo : hi - k + 1])
            sets.append(g[np.concatenate([[True], g[1:] != g[:-1]])])
        elif hi > lo:  # the whole sequence, told from longer ones by its length
            sets.append(mix(np.array([sum(int(h) * (2 * j + 3) ** 5 for j, h in enumerate(w.hash[lo:hi], 1)) + hi - lo & (1 << 64) - 1], np.uint64)))
        else:
            sets.append(np.zeros(0, np.uint64))
    counts = np.array([len(s) for s in sets], np.int64)
    return np.concatenate(sets) if sets else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum(counts)])


def _long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _features(k: int):
    def run(batch: pa.RecordBatch) -> dict:
        """What a batch's texts are dealt and compared by."""
        raw, offsets = texts(batch.column("text"))
        out: dict[str, list] = {c: [] for c in ("n", "s1", "s2", "sketch", "path")}
        for lo, hi in steps(offsets):
            tokens, at = shingle_sets(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], k)
            n = np.diff(at)
            full = np.flatnonzero(n)
            s1, s2 = np.zeros(hi - lo, np.uint64), np.zeros(hi - lo, np.uint64)
            sketch = np.zeros((hi - lo, BINS), np.uint8)
            path = np.zeros((hi - lo, TREES * DEPTH), np.int64)
            if len(full):
                heads, sizes = at[full], n[full]
                s1[full] = np.add.reduceat(mix(tokens ^ np.uint64(0xA5A5F00D)), heads)
                s2[full] = np.add.reduceat(mix(tokens * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(7)), heads)
                # the first token of each bin of the sorted set; 0 is an empty bin
                owner = np.repeat(np.arange(len(full)), sizes)
                cell = owner * BINS + (tokens >> np.uint64(57)).astype(np.int64)
                lead = np.concatenate([[True], cell[1:] != cell[:-1]])
                flat = np.zeros(len(full) * BINS, np.uint8)
                flat[cell[lead]] = 1 + (mix(tokens[lead]) % np.uint64(255)).astype(np.uint8)
                sketch[full] = flat.reshape(-1, BINS)
                for t in range(TREES):
                    node = np.full(len(full), mix(np.array([t * 7919 + 11], np.uint64))[0])
                    for d in range(DEPTH):
                        seeds = np.repeat(node, sizes)
                        node = mix(node ^ np.minimum.reduceat(mix(tokens ^ seeds), heads))
                        path[full, t * DEPTH + d] = _long(node)
            out["n"].append(n)
            out["s1"].append(_long(s1))
            out["s2"].append(_long(s2))
            out["sketch"] += [x.tobytes() for x in sketch]
            out["path"].append(path)
        paths = np.concatenate(out["path"])
        return {
            "id": batch.column("id"),
            **{c: pa.array(np.concatenate(out[c])) for c in ("n", "s1", "s2")},
            "sketch": pa.array(out["sketch"], pa.binary()),
            "path": pa.ListArray.from_arrays(pa.array(np.arange(0, paths.size + 1, TREES * DEPTH, dtype=np.int32)), pa.array(paths.ravel())),
        }

    return run


def _sets(k: int, chosen):
    def run(batch: pa.RecordBatch) -> dict | None:
        batch = batch.filter(pa.array(in_filter(chosen.value, batch.column("id"))))
        if not batch.num_rows:
            return None
        raw, offsets = texts(batch.column("text"))
        out: list[bytes] = []
        for lo, hi in steps(offsets):
            tokens, at = shingle_sets(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], k)
            out += [tokens[a:b].tobytes() for a, b in zip(at[:-1], at[1:])]
        return {"id": batch.column("id"), "tokens": pa.array(out, pa.binary())}

    return run


def _leaves(reps: DataFrame) -> DataFrame:
    """(key, members, id, n, sketch) of every leaf with two members or more."""
    at = lambda d: F.col("path")[F.col("tree") * DEPTH + d].alias(f"k{d}")
    rows = reps.select("id", "path", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")).select("id", *map(at, range(DEPTH)))
    found = []
    for d in range(DEPTH):
        count = rows.groupBy(f"k{d}").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
        # written, so that a level is dealt out once and not again for every later one
        nodes = written(joined(rows, count, [f"k{d}"]), "nodes")
        small = nodes if d == DEPTH - 1 else nodes.where(F.col("c") <= SMALL)
        found.append(small.select(F.col(f"k{d}").alias("key"), F.col("c").alias("members"), "id"))
        rows = nodes.where(F.col("c") > SMALL).drop("c", f"k{d}")
    out = found[0]
    for x in found[1:]:
        out = out.union(x)
    return out.join(reps.select("id", "n", "sketch"), "id")


def _by_block(work, schema: dict[str, pa.DataType]):
    """Calls `work(table)` for each run of equal (key, p, q); it returns rows of `schema`."""

    def run(batches):
        held: list[pa.Table] = []

        def flush(rows: pa.Table):
            got = work(rows)
            if got:
                yield pa.RecordBatch.from_pydict({c: pa.array(v, t) for (c, t), v in zip(schema.items(), zip(*got))})

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            keys = np.stack([rows[c].to_numpy() for c in ("key", "p", "q")])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), rows.num_rows]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                part = rows.slice(lo, hi - lo)
                if held and any(held[-1][c][0] != part[c][0] for c in ("key", "p", "q")):
                    yield from flush(pa.concat_tables(held))
                    held = []
                held.append(part)
        if held:
            yield from flush(pa.concat_tables(held))
        held = []
        tidy()

    return run


def _compare(share: float, every: bool, dense: float):
    """Candidates (a, b, key) of each block: a spanning forest over components, or every pair between them.

    A block with too many of the latter gives one row (null, null, key).
    """
    cut = lambda n: share - 5 * np.sqrt(share * (1 - share) / np.maximum(n, 1))

    def block(x: pa.Table) -> list[tuple[int | None, int | None, int]]:
        key = x["key"][0].as_py()
        ids = x["id"].to_numpy()
        n = x["n"].to_numpy()
        sk = np.frombuffer(b"".join(x["sketch"].to_pylist()), np.uint8).reshape(-1, BINS)
        comp = np.unique(x["comp"].to_numpy(), return_inverse=True)[1]
        side = x["side"].to_numpy()
        if comp.max() == 0:
            return []
        a_side = np.flatnonzero(side == 0)
        b_side = np.flatnonzero(side == 1) if side.any() else a_side
        parent = list(range(int(comp.max()) + 1))

        def find(v: int) -> int:
            while parent[v] != v:
                parent[v] = v = parent[parent[v]]
            return v

        pairs, found = [], []
        for i in a_side:
            js = b_side if side.any() else b_side[b_side > i]
            js = js[(comp[js] != comp[i]) & (np.minimum(n[js], n[i]) >= share * np.maximum(n[js], n[i]) - 1e-9)]
            if not len(js):
                continue
            filled = ((sk[js] != 0) | (sk[i] != 0)).sum(1)
            alike = ((sk[js] == sk[i]) & (sk[js] != 0)).sum(1) / np.maximum(filled, 1)
            ok = alike >= cut(filled)
            js, alike = js[ok], alike[ok]
            if every:
                pairs += [(int(ids[i]), int(ids[j]), key) for j in js]
                if len(pairs) > dense * len(ids):
                    return [(None, None, key)]
            elif len(js):
                # one best pair for each component met keeps this linear
                order = np.argsort(-alike, kind="stable")
                _, one = np.unique(comp[js][order], return_index=True)
                for j, s in zip(js[order][one], alike[order][one]):
                    found.append((float(-s), int(i), int(j)))
                if len(found) > 50_000:
                    found = forest(found, comp, list(range(len(parent))))
        if not every:
            pairs = [(int(ids[i]), int(ids[j]), key) for _, i, j in forest(found, comp, parent)]
        return pairs

    def forest(found, comp, parent):
        def find(v: int) -> int:
            while parent[v] != v:
                parent[v] = v = parent[parent[v]]
            return v

        kept = []
        for s, i, j in sorted(found):
            p, q = find(int(comp[i])), find(int(comp[j]))
            if p != q:
                parent[p] = q
                kept.append((s, i, j))
        return kept

    return _by_block(block, {"a": pa.int64(), "b": pa.int64(), "key": pa.int64()})


def _exact(percent: int):
    """Links (a, b) of each block by full sets: a spanning forest over its components."""

    def block(x: pa.Table) -> list[tuple[int, int]]:
        ids, side, n = x["id"].to_numpy(), x["side"].to_numpy(), x["n"].to_numpy()
        names, comp, sizes = np.unique(x["comp"].to_numpy(), return_inverse=True, return_counts=True)
        apart = side.any()
        if len(names) == 1 or (apart and side.all()):
            return []
        tokens = np.frombuffer(b"".join(v.as_buffer() for v in x["tokens"].combine_chunks()), np.uint64)
        codes = np.unique(tokens, return_inverse=True)[1]
        at = np.concatenate([[0], np.cumsum(n)])
        mark, out = np.zeros(int(codes.max()) + 1, bool), []
        # one end of every pair is outside the largest component
        for i in np.flatnonzero(comp != sizes.argmax()):
            ok = (comp != comp[i]) & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i]))
            if apart:
                ok &= side != side[i]
            if not ok.any():
                continue
            mine = codes[at[i] : at[i + 1]]
            mark[mine] = True
            both = np.add.reduceat(mark[codes], at[:-1], dtype=np.int64)
            mark[mine] = False
            for j in np.flatnonzero(ok & (100 * both >= percent * (n + n[i] - both))):
                if comp[j] != comp[i]:
                    out.append((int(ids[i]), int(ids[j])))
                    comp[comp == comp[j]] = comp[i]
        return out

    return _by_block(block, {"a": pa.int64(), "b": pa.int64()})


def _dealt(leaves: DataFrame, blocks: Column, every: bool) -> DataFrame:
    """`leaves` cut into `blocks`, in pairs of blocks (p, q); side tells which of the two a row is of."""
    cast = leaves.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    # in a forest each block is held against itself and the first one only; at last against all others
    others = F.sequence(F.lit(0), F.col("blocks") - 1) if every else F.when(F.col("own") == 0, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array_distinct(F.array(F.lit(0), F.col("own"))))
    return cast.withColumn("other", F.explode(others)).select(
        "key", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), (F.col("own") > F.col("other")).cast("int").alias("side"), *[c for c in leaves.columns if c not in ("key", "members")]
    )


def _candidates(leaves: DataFrame, share: float, every: bool, dense: float = DENSE) -> DataFrame:
    """Pairs of `leaves` (key, members, id, n, sketch, comp) worth a confirmation, with their leaf's key; null pairs for dense leaves."""
    mixed = leaves.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").select("key")
    cast = _dealt(joined(leaves, mixed, ["key"]), F.ceil(F.col("members") / BLOCK).cast("int"), every)
    # rows of blocks, each with its sketch, twice where leaves have more than one block
    dealt = cast.repartition(tasks(leaves, 2 * ROW_BYTES * leaves.count()), "key", "p", "q").sortWithinPartitions("key", "p", "q", "id")
    return dealt.mapInArrow(_compare(share, every, dense), "a long, b long, key long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "key").where("a is null or a <> b")


def _linked(leaves: DataFrame, keys: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b) links between components of the leaves `keys`, compared on full sets."""
    rows = written(leaves.join(keys, "key", "left_semi").select("key", "id", "n", "comp"), "dense")
    chosen = docs.sparkSession.sparkContext.broadcast(id_filter(rows.select("id").distinct()))
    sets = written(arrow_map(docs.where("id is not null"), _sets(k, chosen), "id long, tokens binary").where(F.octet_length("tokens") > 0), "sets")
    sizes = rows.groupBy("key").agg(F.ceil(F.sum("n") / TOKENS).cast("int").alias("cuts"))
    cast = _dealt(joined(rows, sizes, ["key"]), F.col("cuts"), True).drop("cuts", "n")
    # a row's set goes to every block of its leaf
    volume = rows.join(F.broadcast(sizes) if sizes.count() < FEW else sizes, "key").agg(F.sum(8 * F.col("n") * F.col("cuts"))).first()[0] or 0
    full = cast.join(sets, "id").withColumn("n", F.octet_length("tokens") / 8).select("key", "p", "q", "side", "id", F.col("n").cast("long").alias("n"), "comp", "tokens")
    return written(full.repartition(tasks(rows, volume), "key", "p", "q").sortWithinPartitions("key", "p", "q", "id").mapInArrow(_exact(percent), "a long, b long"), "links")


def _confirm(percent: int):
    def run(batch: pa.RecordBatch) -> dict:
        ok = []
        for x, y in zip(batch.column("x"), batch.column("y")):
            x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
            both = len(np.intersect1d(x, y, assume_unique=True))
            ok.append(100 * both >= percent * (len(x) + len(y) - both))
        return {"a": batch.column("a"), "b": batch.column("b"), "ok": pa.array(ok, pa.bool_())}

    return run


def _verified(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b, ok): pairs held against full sets.  A text of many pairs is sent once to each task that has some."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    # texts stay where they are: a filter of bounded size tells which to make sets of
    chosen = docs.sparkSession.sparkContext.broadcast(id_filter(wanted))
    sets = written(arrow_map(docs.where("id is not null"), _sets(k, chosen), "id long, tokens binary"), "sets")
    count = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / SHARE).cast("int").alias("shares"))
    dealt = pairs.join(count, "a").withColumn("share", F.pmod(F.xxhash64("b"), F.col("shares")).cast("int"))
    left = dealt.select("a", "share").distinct().join(sets.select(F.col("id").alias("a"), F.col("tokens").alias("x")), "a")
    right = dealt.join(sets.select(F.col("id").alias("b"), F.col("tokens").alias("y")), "b").select("a", "share", "b", "y")
    return written(arrow_map(right.join(left, ["a", "share"]).select("a", "b", "x", "y"), _confirm(percent), "a long, b long, ok boolean"), "confirmed")


@swept
def near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, percent: int = 80, dense: float = DENSE) -> DataFrame:
    """One row per document: its id, n_shingles, component_id (smallest id linked), kept."""
    docs = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    feats = written(arrow_map(docs, _features(k), "id long, n long, s1 long, s2 long, sketch binary, path array<long>"), "features")
    full = feats.where("n > 0 and id is not null")
    own = F.struct("n", "s1", "s2")
    if not full.groupBy("id").agg(F.min(own).alias("lo"), F.max(own).alias("hi")).where("lo <> hi").isEmpty():
        out = _of_repeated(docs, k, percent, dense)
    else:
        classes = written(full.groupBy("n", "s1", "s2").agg(F.min("id").alias("rep")), "classes")
        labels = _labels(docs, full, classes, k, percent, dense)
        member = classes.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("n", "s1", "s2", F.coalesce("label", "rep").alias("component_id"))
        # empty sets need no class, and are many in some tables
        bare = feats.where("n = 0").select("id", "n", F.col("id").alias("component_id"))
        out = joined(feats.where("n > 0"), member, ["n", "s1", "s2"], "left").select("id", "n", F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id")).union(bare)
    out = out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")
    return out.withColumn("kept", F.col(id_col) == F.col("component_id"))


def _of_repeated(docs: DataFrame, k: int, percent: int, dense: float) -> DataFrame:
    """(id, n, component_id) where an id has several texts: rows get numbers, and those of one id are linked."""
    rows = written(docs.withColumn("row", F.monotonically_increasing_id()), "rows")
    found = written(near_duplicates(rows, "row", "text", k, percent, dense).withColumnRenamed("component_id", "part").join(rows.select("row", "id"), "row"), "parts")
    some = found.where("id is not null and n_shingles > 0")
    links = joined(some, some.groupBy("id").agg(F.min("part").alias("first")), ["id"]).select(F.col("part").alias("a"), F.col("first").alias("b"))
    labels = components(links).withColumnRenamed("id", "part")
    placed = written(joined(found, labels, ["part"], "left").withColumn("part", F.coalesce("label", "part")), "placed")
    least = placed.where("id is not null").groupBy("part").agg(F.min("id").alias("component_id"))
    return joined(placed, least, ["part"], "left").select("id", F.col("n_shingles").alias("n"), F.when(F.col("n_shingles") == 0, F.col("id")).when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"))


def _labels(docs: DataFrame, full: DataFrame, classes: DataFrame, k: int, percent: int, dense: float) -> DataFrame:
    """(id, label) of the classes' representatives that are linked with others."""
    share = percent / 100
    # by the id alone, so that a text's features are dealt out once
    reps = full.join(classes.select(F.col("rep").alias("id")), "id", "left_semi").dropDuplicates(["id"])
    leaves = written(_leaves(reps), "leaves")
    first = written(_candidates(leaves.withColumn("comp", F.col("id")), share, False).select("a", "b").distinct(), "pairs")
    done = _verified(first, docs, k, percent).where("ok").select("a", "b")
    labels = components(done)
    known = leaves.join(labels, "id", "left").withColumn("comp", F.coalesce("label", "id")).drop("label")
    last = written(_candidates(known, share, True, dense), "pairs")
    crowded = last.where("a is null").select("key").distinct()
    more = last.where("a is not null").select("a", "b").distinct().join(first, ["a", "b"], "left_anti")
    found = []
    if not more.isEmpty():
        found.append(_verified(more, docs, k, percent).where("ok").select("a", "b"))
    if not crowded.isEmpty():
        found.append(_linked(known, crowded, docs, k, percent))
    return components(functools.reduce(DataFrame.union, found, done)) if found else labels
