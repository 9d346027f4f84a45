"""Toxicity: Levenshtein automata intersected with a lexicon trie, and context windows.

The lexicon (whole words, and word beginnings that mark a family of words) is
learned from all labelled documents: terms whose document frequency among toxic ones
is far above that among others.  Its trie is intersected with Levenshtein automata of one edit for terms of `FUZZY_FROM`
letters or more; the product is made deterministic as words call for it, so a word
costs one table lookup a letter and most die after a few.  Misspellings that clean
labelled documents use are not hits.  A hit's context window tells quotation (open
quotation marks, or a reporting verb beside it) from abuse.  A logistic model over
the counts of quoted, direct and misspelled hits gives the score.

Defined cases: null, empty and wordless texts get the score of a document without
hits; without toxic labels every score is the smoothed base rate (under a half); of a
doc_id's labels the largest counts; labels of unknown documents are ignored; a null
doc_id is not held out; labels, lang, source and doc_id are never inputs of a score; an
empty table gives no rows; other columns stay, but one named as the output gives way to it.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import PLAIN_ROWS, id_filter, in_filter, joined, mix, part_rows, replaced, steps, swept, texts, tidy, written
from .near_dedup import shingle_sets

#: Letters from which one edit is allowed.
FUZZY_FROM = 5
#: Least log ratio of a term's rates, and least share of toxic documents that have it (so a lexicon has at most a hundred times the distinct terms of one document).
LEAST_WEIGHT, RARE = 2.0, 0.01
PREFIXES = range(4, 8)
#: Labelled documents with misspellings from which on they get a weight of their own.
FEW_ODD = 5
#: Characters of context on each side of a hit; chunks remembered, and automaton states made, per worker before both start over.
CONTEXT, CACHE, STATES = 60, 150_000, 20_000

#: Terms that a task counts before it hands the counts on.
TERMS = 500_000
#: Bytes of text that are scored at once.
BATCH_BYTES = 4 << 20

_WORD = re.compile(r"[^\W\d_]+")
#: Reporting verbs of the four languages, looked for beside a hit.
_REPORT = re.compile(r"\b(said|says|wrote|quoted?|called|sagte|schrieb|zitat|genannt|dit|écrit|cité|appelé|dijo|escribió|cita|llamó)\b")


def held_out(doc_id: Column) -> Column:
    """crc32 of the id's text is a multiple of 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


class Lexicon:
    """A trie of terms with its one-edit Levenshtein product, determinised lazily.

    A state is a set of (trie node, edits left); the dead state is the empty set.
    """

    def __init__(self, words: list[str], stems: list[str], allowed: set[str] = frozenset()):
        self.next: list[dict[str, int]] = [{}]
        self.word: set[int] = set()
        self.stem: set[int] = set()
        self.fuzzy: set[int] = set()  # nodes on the way to a term that may be misspelled
        self.fuzzy_word: set[int] = set()  # ends of such terms
        self.fuzzy_stem: set[int] = set()
        self.allowed = allowed
        for terms, ends in ((words, self.word), (stems, self.stem)):
            for t in terms:
                node = 0
                for c in t:
                    node = self._child(node, c)
                ends.add(node)
                if len(t) >= FUZZY_FROM + (ends is self.stem):
                    node = 0
                    self.fuzzy.add(0)
                    for c in t:
                        node = self._child(node, c)
                        self.fuzzy.add(node)
                    (self.fuzzy_stem if ends is self.stem else self.fuzzy_word).add(node)
        self.memo: dict[str, int] = {}
        self._restart()

    def _restart(self) -> None:
        self.ids: dict[frozenset, int] = {frozenset(): 0}
        self.states: list[frozenset] = [frozenset()]
        self.moves: list[dict[str, int]] = [{}]
        self.start = self._state(frozenset({(0, 1)} if 0 in self.fuzzy else {(0, 0)}))

    def _child(self, node: int, c: str) -> int:
        if c not in self.next[node]:
            self.next[node][c] = len(self.next)
            self.next.append({})
        return self.next[node][c]

    def _state(self, members: frozenset) -> int:
        if members not in self.ids:
            self.ids[members] = len(self.states)
            self.states.append(members)
            self.moves.append({})
        return self.ids[members]

    def _move(self, state: int, c: str) -> int:
        out = set()
        for node, left in self.states[state]:
            if node in self.fuzzy_stem:
                out.add((node, left))  # any ending may follow a stem
            if (to := self.next[node].get(c)) is not None and to in self.fuzzy:
                out.add((to, left))
            if left:
                out.add((node, 0))  # c is extra
                for child in self.next[node].values():
                    if child in self.fuzzy:
                        out.add((child, 0))  # c stands for another letter
                        if (to := self.next[child].get(c)) is not None and to in self.fuzzy:
                            out.add((to, 0))  # a letter is missing before c
        out = {(n, e) for n, e in out if e or (n, 1) not in out}
        self.moves[state][c] = got = self._state(frozenset(out))
        return got

    def match(self, word: str) -> int:
        """0: no hit, 1: a whole word of the lexicon, 2: a stem's family, 3: a misspelling."""
        node = 0
        for c in word:  # the exact path
            if node in self.stem:
                return 2
            node = self.next[node].get(c, -1)
            if node < 0:
                break
        if node > 0 and node in self.word:
            return 1
        if node > 0 and node in self.stem:
            return 2
        if len(word) < FUZZY_FROM - 1 or word in self.allowed:
            return 0
        if len(self.states) > STATES:
            self._restart()
        state, moves = self.start, self.moves
        for c in word:
            to = moves[state].get(c)
            state = self._move(state, c) if to is None else to
            if not state:
                return 0
        for node, left in self.states[state]:
            if node in self.fuzzy_word or node in self.fuzzy_stem or left and any(n in self.fuzzy_word or n in self.fuzzy_stem for n in self.next[node].values()):
                return 3
        return 0

    def chunk(self, chunk: str) -> int:
        """The strongest hit among a chunk's words, remembered."""
        got = max((self.match(w) for w in _WORD.findall(chunk)), default=0, key=lambda k: (0, 3, 2, 1)[k])
        if len(self.memo) > CACHE:
            self.memo.clear()
        self.memo[chunk] = got
        return got

    def hits(self, text: str) -> tuple[list[float], list[str]]:
        """Features of a text, and its misspelled words."""
        low = text.lower()
        chunks = low.split()
        found = list(map(self.memo.get, chunks))
        if None in found:
            for i, k in enumerate(found):
                if k is None:
                    found[i] = self.chunk(chunks[i])
        if not any(found):
            return [0.0] * 6, []
        counts, kinds, odd = [0, 0, 0, 0], set(), []
        for m in _WORD.finditer(low):
            k = self.match(m[0])
            if not k:
                continue
            line = low.rfind("\n", 0, m.start()) + 1
            before = low[line : m.start()]
            near = low[max(line, m.start() - CONTEXT) : m.end() + CONTEXT]
            inside = before.count('"') % 2 == 1 or before.count("“") > before.count("”") or before.count("«") > before.count("»")
            if inside or _REPORT.search(near):
                counts[0] += 1
            else:
                counts[k] += 1
                kinds.add(m[0])
            if k == 3:
                odd.append(m[0])
        sure = counts[1] + counts[2]
        return [float(sure > 0), math.log1p(sure), math.log1p(counts[0]), math.log1p(counts[3]), math.log1p(len(kinds)), sure / (1 + math.log1p(len(chunks)))], odd


def _terms(text: str) -> set[str]:
    """Whole words (with a closing space) and beginnings of a text."""
    words = set(_WORD.findall(text.lower()))
    return {w + " " for w in words if len(w) > 2} | {w[:n] for w in words for n in PREFIXES if len(w) > n}


def _family(batches):
    """Adds three minwise shingles of each text: near copies share most of them."""
    for batch in batches:
        if not batch.num_rows:
            continue
        raw, offsets = texts(batch.column("text"))
        out = np.zeros((batch.num_rows, 3), np.int64)
        for lo, hi in steps(offsets):
            tokens, at = shingle_sets(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], 4)
            full = np.flatnonzero(np.diff(at))
            for j in range(3 if len(full) else 0):
                out[lo + full, j] = np.minimum.reduceat(mix(tokens ^ np.uint64(0x1234567 * (j + 1))), at[full]).view(np.int64)
        keep = ("doc_id", "text", "toxic")
        yield pa.RecordBatch.from_arrays([*map(batch.column, keep), *map(pa.array, out.T.copy())], names=[*keep, "f0", "f1", "f2"])
        tidy()


def _logistic(design: DataFrame, n: int, ridge: float = 1e-2, rounds: int = 30) -> np.ndarray:
    """Newton steps on the penalised likelihood of all rows (y, x, n: how many there are); the first weight is the constant.

    Every task sums its rows; the driver gets one vector and matrix of the few features a step.
    """
    d = len(design.select("x").first()[0]) + 1
    w, pull = np.zeros(d), np.full(d, ridge * n**0.5 + ridge)
    pull[0] = ridge

    def sums(w: np.ndarray):
        def run(batches):
            total = np.zeros((d, d + 1))
            for batch in batches:
                if batch.num_rows:
                    x = np.column_stack([np.ones(batch.num_rows), batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d - 1)])
                    y, count = batch.column("y").to_numpy(zero_copy_only=False).astype(float), batch.column("n").to_numpy()
                    p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
                    total[:, 1:] += (x * (count * (p * (1 - p) + 1e-9))[:, None]).T @ x
                    total[:, 0] += x.T @ (count * (y - p))
            yield pa.RecordBatch.from_pydict({"i": pa.array(np.arange(total.size)), "v": pa.array(total.ravel())})

        return run

    for _ in range(rounds):
        total = np.zeros(d * (d + 1))
        for i, v in design.mapInArrow(sums(w), "i long, v double").groupBy("i").agg(F.sum("v")).collect():
            total[i] = v
        total = total.reshape(d, d + 1)
        step = np.linalg.solve(total[:, 1:] + np.diag(pull), total[:, 0] - pull * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w.round(9)  # sums of doubles depend on the order of addition


class Model:
    def __init__(self, lexicon: tuple, weights: list[float]):
        self.lexicon, self.weights = lexicon, weights


def _labelled(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """The documents that have a label, with it.

    Up to PLAIN_ROWS labels (rows of two numbers) are broadcast; with more, documents that a filter of their ids lets
    through are shuffled.
    """
    # as text, an id is the same whatever its type
    key = F.xxhash64(F.col("doc_id").cast("string"))
    marks = written(marks.withColumn("id", key), "marks")
    n = marks.count()
    if n <= PLAIN_ROWS:
        return docs.join(F.broadcast(marks.drop("id")), "doc_id")
    cells = docs.sparkSession.sparkContext.broadcast(id_filter(marks.select("id")))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(in_filter(cells.value, batch.column("id"))))

    docs = docs.withColumn("id", key)
    docs = docs.mapInArrow(run, docs.schema)
    return joined(docs.drop("id"), marks.drop("id"), ["doc_id"], count=n)


@swept
def fit(documents: DataFrame, labels: DataFrame) -> Model:
    """Learn lexicon and weights from all labelled documents that are not held out."""
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    docs = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    rows = _labelled(docs, marks).select(F.col("doc_id").cast("string").alias("doc_id"), "text", F.col("toxic").cast("int").alias("toxic"))
    # of copies one is enough: a term that one text and its copies have is no evidence; the least id stays
    rows = written(rows.mapInArrow(_family, "doc_id string, text string, toxic int, f0 long, f1 long, f2 long"), "family")
    own = ["doc_id", "f0", "f1", "f2"]
    left = rows.select("toxic", *own)
    for f in ("f0", "f1", "f2"):
        left = left.groupBy("toxic", F.col(f).alias("same")).agg(F.min(F.struct(*own)).alias("m")).select("toxic", "m.*")
    rows = written(rows.join(left, ["toxic", *own], "left_semi").dropDuplicates(["toxic", *own]).select("text", "toxic"), "labelled")

    def rows_of(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"term": pa.array(list(counts), pa.string()), "n": pa.array(list(counts.values()), pa.int64())})

    def tally(wanted: frozenset | None):
        def run(batches):
            counts: Counter = Counter()
            for batch in batches:
                for text in batch.column("text").to_pylist():
                    terms = _terms(text or "")
                    counts.update(terms if wanted is None else terms & wanted)
                if len(counts) > TERMS:
                    yield rows_of(counts)
                    counts.clear()
            yield rows_of(counts)

        return run

    def frequency(part: DataFrame, wanted: frozenset | None, least: int) -> dict[str, int]:
        return dict(part.select("text").mapInArrow(tally(wanted), "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).where(F.col("n") >= least).collect())

    sizes = dict(rows.groupBy("toxic").count().collect())
    n_pos, n_neg = sizes.get(1, 0), sum(sizes.values()) - sizes.get(1, 0)
    least = max(3, math.ceil(RARE * n_pos))
    pos = frequency(rows.where("toxic = 1"), None, least) if n_pos else {}
    neg = frequency(rows.where("toxic <> 1"), frozenset(pos), 1) if pos else {}

    def weight(t: str) -> float:
        """Log ratio of the two rates, each a standard error on the careful side."""
        p, q = pos[t], neg.get(t, 0)
        return math.log((p - p**0.5 + 0.5) / (n_pos + 1)) - math.log((q + (q + 0.5) ** 0.5 + 0.5) / (n_neg + 1))

    good = {t for t in pos if weight(t) >= LEAST_WEIGHT}

    def longest(t: str) -> str:
        """The longest extension of a beginning that keeps nearly all its toxic documents."""
        while not t.endswith(" "):
            more = [u for u in by_start.get(t, ()) if pos[u] >= 0.97 * pos[t]]
            if not more:
                break
            t = max(more, key=lambda u: (pos[u], u))
        return t

    by_start: dict[str, list[str]] = {}
    for u in good:
        whole = u.rstrip()
        if u.endswith(" "):
            if len(whole) > PREFIXES[0]:
                by_start.setdefault(whole[: min(len(whole) - 1, PREFIXES[-1])], []).append(u)
        elif len(u) > PREFIXES[0]:
            by_start.setdefault(u[:-1], []).append(u)
    words, stems, taken = [], [], set()
    for t in sorted(good, key=lambda t: (len(t.rstrip()), t)):
        if any(t[:n] in taken for n in PREFIXES if n < len(t)):
            continue
        taken.add(t)
        u = longest(t)
        (words if u.endswith(" ") else stems).append(u.rstrip())
    words, stems = sorted(words), sorted(stems)

    def features(batches):
        own = Lexicon(words, stems)
        for batch in batches:
            if batch.num_rows:
                got = [own.hits(t or "") for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_pydict({"toxic": batch.column("toxic"), "x": pa.array([g[0] for g in got], pa.list_(pa.float64())), "odd": pa.array([sorted(set(g[1])) for g in got], pa.list_(pa.string()))})

    if not sum(sizes.values()):
        return Model((words, stems, set()), [-math.log(3), *[0.0] * 6])  # the smoothed rate of no rows: a quarter
    seen = written(rows.mapInArrow(features, "toxic int, x array<double>, odd array<string>"), "features")
    found = seen.select((F.col("toxic") == 1).cast("long").alias("bad"), F.explode("odd").alias("word")).groupBy("word").agg(F.sum("bad").alias("bad"), F.sum(1 - F.col("bad")).alias("fine"))
    # misspellings that come to the driver: of lexicon terms, and met in two clean documents or more
    allowed = {r["word"] for r in found.where("fine >= 2").where(F.col("fine") * max(n_pos, 1) > F.col("bad") * F.lit(n_neg) / 3).collect()}

    def judged(batches):
        """Features as the score will find them."""
        for batch in batches:
            x = batch.column("x").to_pylist()
            for own, odd in zip(x, batch.column("odd").to_pylist()):
                if any(w in allowed for w in odd):
                    own[3] = math.log1p(sum(w not in allowed for w in odd))
            yield pa.RecordBatch.from_pydict({"y": pc.equal(batch.column("toxic"), 1), "x": pa.array(x, pa.list_(pa.float64()))})

    # equal rows are one with a count: most documents have no hit at all
    design = written(seen.mapInArrow(judged, "y boolean, x array<double>").groupBy("y", "x").agg(F.count(F.lit(1)).alias("n")), "design")
    weights = _logistic(design, n_pos + n_neg)
    if (design.where("x[3] > 0").agg(F.sum("n")).first()[0] or 0) < FEW_ODD:  # the labels don't tell: a misspelled term is as bad as one that is not
        weights[4] = weights[2] + weights[1] / math.log(2)
    return Model((words, stems, allowed), weights.tolist())


def score(documents: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """`documents` with a column `name` (0 to 1)."""
    documents = replaced(documents, name)
    words, stems, allowed = model.lexicon
    weights, columns = np.array(model.weights), documents.columns
    shared = documents.sparkSession.sparkContext.broadcast((words, stems, allowed))  # the lexicon and the misspellings met in clean documents

    def run(batches):
        lexicon = Lexicon(*shared.value)
        for whole in batches:
            for batch in part_rows(whole, text_col, BATCH_BYTES) if whole.num_rows else ():
                x = np.array([lexicon.hits(t or "")[0] for t in batch.column(text_col).to_pylist()])
                z = np.clip(weights[0] + (x * weights[1:]).sum(1), -30, 30)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(1 / (1 + np.exp(-z)))], names=[*columns, name])
            tidy()

    schema = T.StructType([*documents.schema.fields, T.StructField(name, T.DoubleType())])
    return documents.mapInArrow(run, schema)


def rate(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, held_out, score, predicted."""
    docs = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scored = score(docs, fit(docs, labels))
    return scored.select(F.col("doc_id").alias(id_col), held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
