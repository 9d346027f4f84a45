"""Secret scans: fixed patterns, and Markov models of random strings and identifiers.

Everything on the main path is a built-in function.  The base patterns find
assignments, access keys and long hex strings.  The method adds the long tokens of what
base spans leave that a character Markov model trained on random strings explains better
than one trained on ordinary identifiers: the sum of log-likelihood ratios of its character
pairs must be at least `MIN_TOTAL` and `MIN_EACH` a pair.  Spans are code points, end exclusive.

Work is near linear in a text: places of matches are prefix sums by doubling, pieces of
text come from blocks of `BLOCK` characters, and base spans are blanked out once before
tokens are looked for.

Defined cases: a null text is empty and has no spans, and stays null in `redact`; a very long
text is one row's work; texts that repeat are scanned each; an empty table gives no rows;
other columns are kept by `annotate` and `redact`, but a column named as an output gives way to it.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_names

# The patterns of the base scan.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Both are runs of at least the wanted length: a run shorter than that holds no match.
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "random")

TOKEN = "[A-Za-z0-9+/_=-]{20,}"
MIN_TOTAL, MIN_EACH = 12.0, 0.6
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"

#: Words that the labelled sample of ordinary identifiers is put together from.
PARTS = (
    "account action address amount archive array author base batch before buffer build cache change channel char check child class client close code column "
    "config content context control count create current data date default delete depth device direction document driver email enable encode entry error event "
    "export field file filter final first format frame function global graph group handle header height image import index input insert instance interface item "
    "kernel label language layer length level library limit line list local location lock login manager map match maximum member memory message method minimum "
    "model module mount name network node number object offset option order output owner package page parameter parent path pattern payload point policy port "
    "prefix process profile project property protocol provider public query queue range read record region release remote remove report request reset "
    "resource response result return root route sample schema score script search section select sequence server service session setting shape shared signal "
    "size source stack stage start state station status step storage store stream string style suffix system table target task template test text thread time "
    "title total track transaction transform tree trigger type unit update upload user value variable vector version video view visible volume width window word "
    "worker write yellow zone"
).split()


def labelled_sample(n: int = 3000, words: list[str] | None = None, salt: str = "sample") -> Iterable[tuple[str, bool]]:
    """`n` random strings (True) and `n` identifiers (False), made from a digest of their number."""
    words = words or PARTS
    for i in range(n):
        d = hashlib.sha256(f"{salt} {i}".encode()).digest()
        yield [d.hex(), base64.b64encode(d).decode().rstrip("="), base64.b32encode(d).decode().rstrip("="), base64.urlsafe_b64encode(d).decode().rstrip("=")][i % 4], True
        some = [words[(d[j] * 256 + d[j + 1]) % len(words)] for j in range(0, 8, 2)]
        styles = ["_".join(some), "-".join(some), "/".join(some), some[0] + "".join(w.title() for w in some[1:]), "".join(w.title() for w in some), "_".join(some).upper(), "".join(some), f"{some[0]}_{some[1]}-{some[2]}_{d[9]}"]
        yield styles[i % 8], False


def train(sample: Iterable[tuple[str, bool]]) -> list[float]:
    """Log-likelihood ratios of character pairs, row by row over ALPHABET (add-one-half smoothing)."""
    n = len(ALPHABET)
    place = {c: i for i, c in enumerate(ALPHABET)}
    counts = {True: [[0.5] * n for _ in range(n)], False: [[0.5] * n for _ in range(n)]}
    for text, label in sample:
        codes = [place[c] for c in text if c in place]
        for a, b in zip(codes, codes[1:]):
            counts[label][a][b] += 1
    return [math.log(x / sum(r)) - math.log(y / sum(o)) for r, o in zip(counts[True], counts[False]) for x, y in zip(r, o)]


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value made once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _running(values: Column, both: Callable[[Column, Column], Column]) -> Column:
    """Prefix sums (or what `both` makes) of an array of numbers: log2(n) rounds, each adding what stands 1, 2, 4 .. places before."""

    def of(v: Column) -> Column:
        steps = F.transform(F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(v), F.lit(2)))).cast("int")), lambda j: F.pow(F.lit(2), j).cast("int"))
        steps = F.filter(steps, lambda j: j < F.size(v))
        return F.aggregate(steps, v, lambda held, j: F.zip_with(held, F.concat(F.array_repeat(F.lit(0), j), F.slice(held, F.lit(1), F.size(held) - j)), both))

    return _let(values, of)


_SPANS = "array<struct<start:int,kind:int,end:int,token:string>>"


def _found(text: Column, pattern: str, group: int, least: int, kind: int) -> Column:
    """Matches as structs (start, kind, end, token); the pieces between matches give their places."""

    def spans(m: Column) -> Column:
        # a match ends after all gaps and matches up to it
        ends = _running(F.zip_with(F.slice(m["gap"], F.lit(1), F.size(m["whole"])), m["whole"], lambda g, w: F.length(g) + F.length(w)), lambda x, y: x + y)
        made = F.zip_with(ends, F.arrays_zip(m["whole"].alias("w"), m["held"].alias("h")), lambda e, x: F.struct((e - F.length(x["w"])).alias("start"), F.lit(kind).alias("kind"), e.alias("end"), x["h"].alias("token")))
        return F.filter(made, lambda x: F.length(x["token"]) >= least)

    all_of = lambda n: F.regexp_extract_all(text, F.lit(pattern), F.lit(n))
    return _let(F.struct(all_of(0).alias("whole"), all_of(group).alias("held"), F.split(text, pattern, -1).alias("gap")), spans)


#: Characters of a text that are addressed at once.
BLOCK = 2048


def _filled(text: Column, spans: Column, instead: Callable[[Column, Column], Column]) -> Column:
    """The text with what each span (sorted by start) adds to those before it replaced by `instead(its struct, first new place)`."""

    def piece(blocks: Column, a: Column, b: Column) -> Column:
        """Characters a to b, b exclusive."""
        return _let(
            F.struct(a.alias("a"), b.alias("b"), F.floor(a / BLOCK).cast("int").alias("i"), F.floor(b / BLOCK).cast("int").alias("j")),
            lambda x: F.when(x["b"] <= x["a"], "")
            .when(x["i"] == x["j"], F.substring(F.get(blocks, x["i"]), x["a"] % BLOCK + 1, x["b"] - x["a"]))
            .otherwise(
                F.concat(
                    F.substring(F.get(blocks, x["i"]), x["a"] % BLOCK + 1, F.lit(BLOCK)),
                    F.array_join(F.slice(blocks, x["i"] + 2, F.greatest(x["j"] - x["i"] - 1, F.lit(0))), ""),
                    F.coalesce(F.substring(F.get(blocks, x["j"]), F.lit(1), x["b"] % BLOCK), F.lit("")),
                )
            ),
        )

    def filled(x: Column) -> Column:
        # a place before each span: where the spans before it end
        before = F.concat(F.array(F.lit(0)), F.slice(x["reach"], F.lit(1), F.size(x["reach"]) - 1))
        parts = F.zip_with(x["spans"], before, lambda m, at: F.concat(piece(x["blocks"], at, m["start"]), instead(m, F.greatest(at, m["start"]))))
        return F.concat(F.array_join(parts, ""), piece(x["blocks"], F.element_at(x["reach"], -1), F.length(text)))

    blocks = F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % BLOCK), F.lit(0))
    reach = _running(F.transform(spans, lambda m: m["end"]), lambda x, y: F.greatest(x, y))
    return _let(F.struct(blocks.alias("blocks"), spans.alias("spans"), reach.alias("reach")), filled)


def _ratio(token: Column, table: Column) -> Column:
    """Sum of the log-likelihood ratios of the token's character pairs."""
    n = len(ALPHABET)
    codes = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    pairs = F.zip_with(F.slice(codes, F.lit(1), F.length(token) - 1), F.slice(codes, F.lit(2), F.length(token) - 1), lambda x, y: F.element_at(table, (x - 1) * n + y))
    return F.aggregate(pairs, F.lit(0.0).cast("double"), lambda s, x: s + x)


def annotate(documents: DataFrame, text_col: str = "text", sample: Iterable[tuple[str, bool]] | None = None, names: tuple[str, str] = ("base_spans", "random_spans")) -> DataFrame:
    """`documents` with two columns, base spans and random spans: arrays of (start, kind, end), by start and kind."""
    base, random = names
    table = F.split(F.lit(" ".join(f"{x:.4f}" for x in train(sample or labelled_sample()))), " ").cast("array<double>")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    none = F.array().cast(_SPANS)
    low = F.lower(text)
    assigns = F.when(low.contains("passw") | low.contains("secret") | low.contains("token") | low.contains("key"), _found(text, ASSIGN, 2, 8, 0)).otherwise(none)
    access = F.when(text.contains("AKIA"), _found(text, ACCESS, 0, 16, 1)).otherwise(none)
    hexes = F.when(text.rlike(HEX), _found(text, HEX, 0, 32, 2)).otherwise(none)
    bare = lambda spans: F.transform(spans, lambda m: F.struct(m["start"].alias("start"), m["kind"].alias("kind"), m["end"].alias("end")))
    with_base = documents.withColumn(base, F.array_sort(bare(F.concat(assigns, access, hexes))))
    blank = F.when(F.size(base) > 0, _filled(text, F.col(base), lambda m, at: F.repeat(F.lit(" "), F.greatest(m["end"] - at, F.lit(0))))).otherwise(text)
    tokens = F.when(text.rlike(TOKEN), _let(blank, lambda t: _found(t, TOKEN, 0, 20, 3))).otherwise(none)
    likely = F.filter(tokens, lambda m: _ratio(m["token"], table) >= F.greatest(F.lit(MIN_TOTAL), MIN_EACH * (F.length(m["token"]) - 1)))
    return with_base.withColumn(random, F.array_sort(bare(likely)))


def _listed(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda m: F.concat_ws(":", F.element_at(kinds, m["kind"] + 1), m["start"], m["end"])), ",")


def scan(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, n_assign, n_access, n_hex, base_sha256, spans, n_random."""
    count = lambda k: F.size(F.filter("base_spans", lambda m: m["kind"] == k)).cast("long")
    return annotate(documents.select(id_col, text_col), text_col).select(
        id_col,
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_listed(F.col("base_spans")).cast("binary"), 256).alias("base_sha256"),
        _listed(F.array_sort(F.concat("base_spans", "random_spans"))).alias("spans"),
        F.size("random_spans").cast("long").alias("n_random"),
    )


def redact(documents: DataFrame, text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """`documents` with every span replaced by `mask`; overlapping spans share one.  Columns stay as they are."""
    names = free_names(documents, "base_spans", "random_spans")
    spans, text = F.array_sort(F.concat(*names)), F.col(text_col).cast("string")
    cut = _filled(text, spans, lambda m, at: F.when(at == m["start"], mask).otherwise(""))
    marked = annotate(documents, text_col, names=names)
    return marked.withColumn(text_col, F.when(F.size(spans) > 0, cut).otherwise(text)).drop(*names)
