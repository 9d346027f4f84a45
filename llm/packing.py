"""Lexical retrieval packing: windows filled with BM25 neighbours.

Documents are encoded and dealt by what they hold into shards of about `SHARD_BYTES` of
text.  All documents give each term its weight and a tree: a document is the
vector of its weighted terms, hashed to `DIM` places; a node cuts its documents in halves
along their main axis.  Neighbouring leaves fill a shard, and a leaf over a shard's size (many
copies, a large topic) is cut by a hash of id and text.  So documents that resemble each
other mostly share a shard, and equal ones always share a leaf, but a seed's best neighbour
may still be in another shard: README has the measured recall.  A shard has its own BM25 index over token ids, and all terms of
a seed are scored against all its documents: terms in more than 1 / `DENSE` of them as
rows of a matrix, others from postings.  A window begins with
the rest of the document that was cut last, or the next unused one; the index returns
the best unused neighbours for that seed, which greedily fill the window.  The last
one is cut where the window ends, so windows of `length` have no padding.  A shard's
last window is cut into powers of two, which need none either.

Defined cases: a null text is empty and has the end id alone; a null id is packed like
others; documents longer than a window fill several; repeated rows are packed each; an
empty table has no pieces.
"""

from __future__ import annotations

import pickle
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import part_rows, swept, texts, tidy, written
from .tokens import END_ID, encoder

LENGTH, SHARD_BYTES = 4096, 8 << 20
#: Text that is encoded at once, and that a packing task should get (whole shards, one after another).
ENCODE_BYTES, TASK_BYTES = 2 << 20, 64 << 20
#: BM25's k1 and b; terms in more than a DENSE-th of a shard's documents are kept as matrix rows.
K1, B, DENSE = 1.2, 0.75, 8
#: Places of a document's vector, least documents that are cut, documents that one task cuts alone, levels between two dealings.
DIM, LEAF, NODE, DEAL = 128, 4, 32_768, 5
#: Width and number of the bins along an axis.
BIN, BINS = 1024, 8192


def counted(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, count) of the distinct terms of some documents, in that order."""
    if not docs:
        return (np.zeros(0, np.int32),) * 3
    ids = np.concatenate(docs)
    small = ids.dtype.itemsize <= 2 and len(docs) < 1 << 16
    kind, shift = (np.uint32, 16) if small else (np.uint64, 32)
    key = np.repeat(np.arange(len(docs), dtype=kind) << kind(shift), [len(d) for d in docs])
    key |= ids.astype(kind)
    key.sort()
    lead = np.flatnonzero(np.concatenate([np.ones(min(1, len(key)), bool), key[1:] != key[:-1]]))
    tf = np.diff(np.append(lead, len(key))).astype(np.int32)
    key = key[lead]
    return (key >> kind(shift)).astype(np.int32), (key & kind((1 << shift) - 1)).astype(np.int32), tf


def document_frequencies(coded: DataFrame, dtype: np.dtype, vocabulary: int) -> np.ndarray:
    """In how many of all documents (column `ids`) each term is."""

    def run(batches):
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            total += np.bincount(counted(_id_arrays(batch, dtype))[1], minlength=vocabulary)
        term = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"term": pa.array(term, pa.int64()), "n": pa.array(total[term])})

    out = np.zeros(vocabulary)
    for term, n in coded.select("ids").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n")).collect():  # one a term
        out[term] = n
    return out


def _id_arrays(batch: pa.RecordBatch, dtype: np.dtype) -> list[np.ndarray]:
    raw, at = texts(batch.column("ids"))
    return [raw[lo:hi].view(dtype) for lo, hi in zip(at[:-1].tolist(), at[1:].tolist())]


class Tree:
    """Leaves of documents that resemble each other; neighbouring leaves have neighbouring numbers.

    A document is its weighted terms, hashed to DIM places, of length 127 in whole numbers: sums over documents are exact,
    whatever their order.
    """

    def __init__(self, df: np.ndarray, count: int):
        idf = np.log1p((count - df + 0.5) / (df + 0.5)).astype(np.float32)
        r = np.random.default_rng(8)
        self.place, self.signed = r.integers(0, DIM, len(df)), idf * r.choice(np.array([-1, 1], np.float32), len(df))
        self.set(None)

    def set(self, root: list | None) -> None:
        """Take over a node: [axis, bound, lower side, upper side], a leaf is None."""
        axes, bounds, sides, self.leaves = [], [], [], 0

        def number(node: list | None) -> int:
            if node is None:
                self.leaves += 1
                return -self.leaves
            k = len(axes)
            axes.append(node[0])
            bounds.append(node[1])
            sides.append(None)
            sides[k] = (number(node[2]), number(node[3]))
            return k

        self.root = number(root)
        self.axes, self.bounds, self.sides = np.array(axes, np.int16).reshape(-1, DIM), np.array(bounds, np.int64), np.array(sides, np.int64).reshape(-1, 2)

    def vectors(self, docs: list[np.ndarray]) -> np.ndarray:
        n = len(docs)
        doc, term, tf = counted(docs)
        weight = self.signed[term]
        often = np.flatnonzero(tf > 1)
        weight[often] *= 1 + np.log(tf[often])
        out = np.bincount(doc * np.int64(DIM) + self.place[term], weight, n * DIM).reshape(n, DIM)
        size = np.sqrt((out * out).sum(1))
        return np.rint(out * (127 / np.where(size, size, 1))[:, None]).astype(np.int8)

    def leaf(self, x: np.ndarray) -> np.ndarray:
        """Each vector's leaf."""
        node = np.full(len(x), self.root)
        while len(at := np.flatnonzero(node >= 0)):
            here = node[at]
            node[at] = self.sides[here, (_bins(x[at], self.axes[here]) > self.bounds[here]).astype(int)]
        return -1 - node


def _bins(x: np.ndarray, axis: np.ndarray) -> np.ndarray:
    """Places along an axis (or each vector's own): at most BINS, as 127 * 32,767 is about as much as BINS / 2 * BIN."""
    return (x.astype(np.float32) * axis).sum(1).astype(np.int64) // BIN + BINS // 2  # all sums are below 2^24: exact


def _moments(x: np.ndarray) -> np.ndarray:
    """Count, sums and products of some vectors."""
    total = np.zeros((DIM, DIM))
    for lo in range(0, len(x), 1024):  # such sums are below 2^24, exact in single precision
        part = x[lo : lo + 1024].astype(np.float32)
        total += part.T @ part
    return np.concatenate([[len(x)], x.sum(0, dtype=np.int64), total.ravel()])


def _axis(moments: np.ndarray) -> np.ndarray:
    """The main axis."""
    n, s = moments[0], moments[1 : 1 + DIM]
    return np.rint(np.linalg.eigh(moments[1 + DIM :].reshape(DIM, DIM) - np.outer(s, s) / n)[1][:, -1] * 32767).astype(np.int16)


def _cut(histogram: np.ndarray) -> np.ndarray:
    """(bin, count up to it, count after it) nearest to the middle; a count is 0 if all are in one bin."""
    below = np.cumsum(histogram)
    # an end without documents is no cut while there is another
    off = np.where((below > 0) & (below < below[-1]), np.abs(2 * below - below[-1]), np.inf)
    b = int(np.argmin(off))
    return np.array([b, below[b], below[-1] - below[b]], np.int64)


def _grow(x: np.ndarray, leaves: int) -> list | None:
    """The node of some vectors."""
    if leaves <= 1 or len(x) <= LEAF:
        return None
    axis = _axis(_moments(x))
    at = _bins(x, axis)
    bound, lower, upper = _cut(np.bincount(at, minlength=BINS)).tolist()
    if not lower or not upper:
        return None
    right = at > bound
    return [axis, bound, _grow(x[~right], leaves // 2), _grow(x[right], leaves - leaves // 2)]


def _rows(batch: pa.RecordBatch) -> np.ndarray:
    return texts(batch.column("x"))[0].view(np.int8).reshape(-1, DIM)


def grow(tree: Tree, vectors: DataFrame, count: int, leaves: int, most: int) -> None:
    """Cut all vectors (column `x`, DIM bytes) into leaves.

    A node of more than `most` vectors is cut level by level: tasks sum its moments, and then the places along its main
    axis. A smaller one is cut to its leaves by the task that gets its vectors. After `DEAL` levels the vectors of a node
    are brought together, so that a task has sums of few nodes.
    """
    tasks = lambda n: max(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // most))

    def summed(of, then, wanted: frozenset) -> dict[int, bytes]:
        """What `then` makes of each wanted leaf's sum of `of` over its vectors."""

        def part(batches):
            total: dict = {}
            for batch in batches:
                x = _rows(batch)
                leaf = tree.leaf(x)
                for k in wanted.intersection(np.unique(leaf).tolist()):
                    total[k] = total.get(k, 0) + of(k, x[leaf == k])
            for k, v in total.items():
                yield pa.RecordBatch.from_pydict({"leaf": pa.array([k], pa.int32()), "data": pa.array([v.astype(np.float64).tobytes()])})

        def whole(batches):
            total: dict = {}
            for batch in batches:
                for k, v in zip(batch.column("leaf").to_pylist(), batch.column("data").to_pylist()):
                    total[k] = total.get(k, 0) + np.frombuffer(v)
            for k, v in total.items():
                yield pa.RecordBatch.from_pydict({"leaf": pa.array([k], pa.int32()), "data": pa.array([then(v).tobytes()])})

        return dict(vectors.mapInArrow(part, "leaf int, data binary").repartition(min(len(wanted), tasks(0)), "leaf").mapInArrow(whole, "leaf int, data binary").collect())

    def subtrees(wanted: dict[int, int]) -> dict[int, bytes]:
        def mark(batches):
            for batch in batches:
                leaf = tree.leaf(_rows(batch)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(leaf), batch.column("x")], names=["leaf", "x"]).filter(pa.array(np.isin(leaf, list(wanted))))

        def whole(batches):
            own, held = None, []
            for batch in batches:
                leaf, x = batch.column("leaf").to_numpy(), _rows(batch)
                starts = [0, *(np.flatnonzero(leaf[1:] != leaf[:-1]) + 1).tolist(), len(leaf)]
                for lo, hi in zip(starts[:-1], starts[1:] if len(leaf) else ()):
                    if leaf[lo] != own and held:
                        yield done(own, held)
                        held = []
                    own = int(leaf[lo])
                    held.append(x[lo:hi])
            if held:
                yield done(own, held)

        def done(leaf: int, held: list[np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"leaf": pa.array([leaf], pa.int32()), "data": pa.array([pickle.dumps(_grow(np.concatenate(held), wanted[leaf]))])})

        return dict(vectors.mapInArrow(mark, "leaf int, x binary").repartition(min(len(wanted), tasks(count)), "leaf").sortWithinPartitions("leaf").mapInArrow(whole, "leaf int, data binary").collect())

    tree.set(None)
    root: list = [None]
    open_ = [(root, 0, count, leaves)]  # (parent, place in it, vectors, leaves) of every leaf as yet
    stuck: set[int] = set()  # places of leaves that can't be cut
    level = 0
    while large := [k for k, (_, _, n, l) in enumerate(open_) if n > most and l > 1 and k not in stuck]:
        axes = {k: np.frombuffer(v, np.int16) for k, v in summed(lambda k, x: _moments(x), _axis, frozenset(large)).items()}
        cuts = {k: np.frombuffer(v, np.int64).tolist() for k, v in summed(lambda k, x: np.bincount(_bins(x, axes[k]), minlength=BINS), _cut, frozenset(large)).items()}
        following, held = [], set()
        for k, (parent, place, n, l) in enumerate(open_):
            bound, lower, upper = cuts.get(k, (0, 0, 0))
            if lower and upper:
                parent[place] = node = [axes[k], bound, None, None]
                following += [(node, 2, lower, l // 2), (node, 3, upper, l - l // 2)]
            else:
                if k in stuck or k in cuts:
                    held.add(len(following))
                following.append((parent, place, n, l))
        open_, stuck, level = following, held, level + 1
        tree.set(root[0])
        if level % DEAL == 0:
            vectors = written(_dealt_rows(tree, vectors, tasks(count)), "vectors")
    small = {k: l for k, (_, _, n, l) in enumerate(open_) if l > 1 and n > LEAF and k not in stuck}
    if small:
        for k, data in subtrees(small).items():
            parent, place, _, _ = open_[k]
            parent[place] = pickle.loads(data)
    tree.set(root[0])


def _dealt_rows(tree: Tree, vectors: DataFrame, tasks: int) -> DataFrame:
    """The vectors in order of their leaves; those of a large leaf are dealt to several tasks."""

    def mark(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(tree.leaf(_rows(batch)).astype(np.int32)), batch.column("x"), batch.column("bytes")], names=["leaf", "x", "bytes"])

    return vectors.mapInArrow(mark, "leaf int, x binary, bytes long").repartitionByRange(tasks, "leaf", "x").drop("leaf")


def dealt(sizes: dict[int, int], shard_bytes: int) -> list[tuple[int, int, int]]:
    """(leaf, first shard, shards) of leaves and their bytes: small neighbours share a shard, large ones are cut."""
    out, shard, used = [], 0, 0
    for leaf, size in sorted(sizes.items()):
        if used and used + size > shard_bytes:
            shard, used = shard + 1, 0
        parts = max(1, -(-size // shard_bytes))
        out.append((leaf, shard, parts))
        used += size
        if parts > 1:
            shard, used = shard + parts, 0
    return out


class Bm25:
    """Index of one shard's documents over token ids: a matrix of the frequent terms, postings of the others.

    When half of its documents are used it is cut down to the others, so that a seed is
    scored against little more than what is left; weights stay those of the whole shard.
    """

    def __init__(self, docs: list[np.ndarray]):
        n = len(docs)
        sizes = np.array([len(d) for d in docs])
        doc, term, tf = counted(docs)
        df = np.bincount(term)
        # a term of one document brings no neighbours
        use = df[term] > 1
        doc, term, tf = doc[use], term[use], tf[use]
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        weight = idf[term] * tf * (K1 + 1) / (tf + (K1 * (1 - B + B * sizes / sizes.mean()))[doc])
        self.by_doc, self.doc_at = term, np.searchsorted(doc, np.arange(n + 1))
        self.alive = np.arange(n)
        frequent = np.flatnonzero((df > 1) & (df * DENSE > n))
        self.row = np.full(len(df), -1, np.int32)
        self.row[frequent] = np.arange(len(frequent))
        self.rows = np.zeros((len(frequent), n))
        often = self.row[term] >= 0
        self.rows[self.row[term[often]], doc[often]] = weight[often]
        self._post(term[~often], doc[~often], weight[~often])

    def _post(self, term: np.ndarray, doc: np.ndarray, weight: np.ndarray) -> None:
        """Postings by term; doc counts within `alive`."""
        order = np.argsort(term, kind="stable")
        self.posted_term, self.posted, self.weight = term[order], doc[order], weight[order]
        self.term_at = np.searchsorted(self.posted_term, np.arange(len(self.row) + 1))

    def _cut(self, unused: np.ndarray) -> None:
        keep = unused[self.alive]
        place = np.cumsum(keep) - 1
        self.alive, self.rows = self.alive[keep], np.ascontiguousarray(self.rows[:, keep])
        stay = keep[self.posted]
        self._post(self.posted_term[stay], place[self.posted[stay]].astype(np.int32), self.weight[stay])

    def neighbours(self, seed: int, unused: np.ndarray) -> np.ndarray:
        """Unused documents that share a term with the seed, best first, ties (to nine digits) in order of place."""
        if 2 * np.count_nonzero(unused) < len(self.alive):
            self._cut(unused)
        terms = self.by_doc[self.doc_at[seed] : self.doc_at[seed + 1]]
        if not len(terms) or not len(self.alive):
            return np.zeros(0, np.int64)
        row = self.row[terms]
        # row by row: equal documents get equal sums, and no threads of a matrix library
        score = np.zeros(len(self.alive))
        for r in row[row >= 0].tolist():
            score += self.rows[r]
        rare = terms[row < 0]
        begin, size = self.term_at[rare], self.term_at[rare + 1] - self.term_at[rare]
        at = np.repeat(begin - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum()) if len(rare) else rare
        score += np.bincount(self.posted[at], self.weight[at], len(self.alive))
        score = score.round(9)
        found = np.flatnonzero((score > 0) & unused[self.alive])
        return self.alive[found[np.argsort(-score[found], kind="stable")]]


def fill(docs: list[np.ndarray], length: int) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, size, sequence, offset) of a shard's documents, in sequence order."""
    if not docs:
        return []
    index, unused = Bm25(docs), np.ones(len(docs), bool)
    sizes = [len(d) for d in docs]
    pieces: list[tuple[int, int, int, int, int]] = []
    sequence, used, following = 0, 0, 0
    rest: tuple[int, int] | None = None  # the cut document and where it goes on
    near: list[int] = []

    def place(doc: int, at: int) -> int | None:
        """Put the document's ids from `at` on; where it is cut, if it is."""
        nonlocal sequence, used
        size = min(sizes[doc] - at, length - used)
        pieces.append((doc, at, size, sequence, used))
        used += size
        if used == length:
            sequence, used = sequence + 1, 0
        return at + size if at + size < sizes[doc] else None

    while True:
        if rest is None:
            doc, at = -1, 0
            if used:
                doc = next((d for d in near if unused[d]), -1)
            if doc < 0:
                while following < len(docs) and not unused[following]:
                    following += 1
                if following == len(docs):
                    break
                doc = following
                near = []
            unused[doc] = False
        else:
            doc, at = rest
        opens = used == 0
        cut = place(doc, at)
        rest = None if cut is None else (doc, cut)
        if rest is None and used and (opens or not near):
            near = index.neighbours(doc, unused).tolist()
        elif rest is None and used:
            near = [d for d in near if unused[d]] if len(near) < 64 else near
    if used:  # the last window: powers of two, largest first
        tail = [p for p in pieces if p[3] == sequence]
        pieces = [p for p in pieces if p[3] != sequence]
        bounds, at = [], 0
        for bit in range(used.bit_length() - 1, -1, -1):
            if used >> bit & 1:
                bounds.append((at, at + (1 << bit)))
                at += 1 << bit
        for doc, start, size, _, offset in tail:
            for i, (lo, hi) in enumerate(bounds):
                a, b = max(offset, lo), min(offset + size, hi)
                if a < b:
                    pieces.append((doc, start + a - offset, b - a, sequence + i, a - lo))
        pieces.sort(key=lambda p: (p[3], p[4]))
    return pieces


@swept
def pack(documents: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end_id: int = END_ID, shard_bytes: int = SHARD_BYTES, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and its ids, if wanted)."""
    if length & (length - 1):
        raise ValueError("length must be a power of two")
    docs = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    # rows that are equal in all are told apart by their place, so that none of the cuts below keeps a group of them whole
    docs = docs.withColumn("spread", F.xxhash64("id", "text", F.monotonically_increasing_id())).withColumn("bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 64)
    size, count = docs.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count(F.lit(1))).first()
    # twice as many leaves as shards, so that merged ones fill them
    leaves = 2 * -(-size // shard_bytes)
    tree = places = None

    def encode(batches):
        enc = encoder(tokenizer)
        for batch in batches:
            for part in part_rows(batch, "text", ENCODE_BYTES):
                ids = enc.encode(part.column("text").to_pylist(), end_id)
                yield pa.RecordBatch.from_pydict({"spread": part.column("spread"), "bytes": part.column("bytes"), "id": part.column("id"), "ids": pa.array([x.tobytes() for x in ids], pa.binary())})
                del ids, part
        tidy()

    def placed(batches):
        dtype = encoder(tokenizer).dtype
        for batch in batches:
            x = tree.vectors(_id_arrays(batch, dtype))
            yield pa.RecordBatch.from_pydict({"x": pa.array([v.tobytes() for v in x], pa.binary()), "bytes": batch.column("bytes")})
            tidy()

    def leaf_sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"leaf": pa.array(tree.leaf(_rows(batch)).astype(np.int32)), "bytes": batch.column("bytes")})

    def to_shards(batches):
        dtype = encoder(tokenizer).dtype
        for batch in batches:
            leaf = tree.leaf(tree.vectors(_id_arrays(batch, dtype)))
            shard = places[leaf, 0] + batch.column("spread").to_numpy() % places[leaf, 1]
            yield pa.RecordBatch.from_arrays([pa.array(shard), *map(batch.column, ("spread", "id", "ids"))], names=["shard", "spread", "id", "ids"])
            tidy()

    def shard_pieces(shard: int, keys: list, docs: list[np.ndarray]):
        pieces = fill(docs, length)
        for lo in range(0, len(pieces), 20_000):
            part = pieces[lo : lo + 20_000]
            doc, start, size, seq, offset = (np.array(x, np.int64) for x in zip(*part))
            raw = [docs[d][s : s + n].astype("<u4").tobytes() for d, s, n, _, _ in part]
            out = {
                "id": pa.array([keys[d] for d in doc], pa.int64()), "start": pa.array(start), "length": pa.array(size), "ids_crc32": pa.array([zlib.crc32(x) for x in raw], pa.int64()),
                "doc_tokens": pa.array([len(docs[d]) for d in doc], pa.int64()), "sequence_id": pa.array(shard * (1 << 32) + seq), "offset": pa.array(offset),
            }
            if with_ids:
                out["ids"] = pa.array(raw, pa.binary())
            yield pa.RecordBatch.from_pydict(out)

    def run(batches):
        dtype = encoder(tokenizer).dtype
        shard, keys, held = None, [], []
        for batch in batches:
            for s, key, ids in zip(batch.column("shard").to_pylist(), batch.column("id").to_pylist(), batch.column("ids")):
                if s != shard and held:
                    yield from shard_pieces(shard, keys, held)
                    keys, held = [], []
                    tidy()
                shard = s
                keys.append(key)
                held.append(np.frombuffer(ids.as_buffer().to_pybytes(), dtype))
        if held:
            yield from shard_pieces(shard, keys, held)
        tidy()

    schema = "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids
    coded = docs.mapInArrow(encode, "spread long, bytes long, id long, ids binary")
    # twice as many leaves as shards, so that merged ones fill them
    if (leaves := 2 * -(-size // shard_bytes)) > 2:
        coded, enc = written(coded, "packing"), encoder(tokenizer)
        tree = Tree(document_frequencies(coded, enc.dtype, len(enc.ends)), count)
        vectors = written(coded.select("ids", "bytes").mapInArrow(placed, "x binary, bytes long"), "vectors")
        grow(tree, vectors, count, leaves, NODE)
        sizes = dict(vectors.mapInArrow(leaf_sizes, "leaf int, bytes long").groupBy("leaf").agg(F.sum("bytes")).collect())
        places = np.ones((tree.leaves, 2), np.int64)
        for leaf, first, parts in dealt(sizes, shard_bytes):
            places[leaf] = first, parts
        coded = coded.select("spread", "id", "ids").mapInArrow(to_shards, "shard long, spread long, id long, ids binary")
    else:
        coded = coded.withColumn("shard", F.lit(0).cast("long"))
    tasks = max(int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))
    # equal ids are ordered by their rows' hash, so that a shard's order is always the same
    parted = coded.select("shard", "id", "spread", "ids").repartition(tasks, "shard").sortWithinPartitions("shard", "id", "spread")
    return parted.mapInArrow(run, schema).withColumnRenamed("id", id_col)
