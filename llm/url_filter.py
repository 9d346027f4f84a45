"""URL filters by a bit-parallel wildcard automaton (multiword Shift-And).

A rule is a glob over the canonical URL: "." + host (A-Z lower-cased) + path.  All
rules are laid out in one bit vector of 64-bit words, one bit a pattern character;
every character of a URL moves all of them with one shift, one or and one and:

    D = ((D << 1) | I) & B[c]  |  D & L[c]

I has the patterns' first bits, B[c] the bits whose character is c, L[c] the bits that
a wildcard lets stay on c.  A bit that ends a pattern is sticky.  Batches of URLs are
simulated together, one column of characters at a time.

`host_rule` makes the pattern of a host with all its subdomains and a path prefix.  The
longest rule that fits decides; ties go to the first in order of the list.

Defined cases: a null url, or one without "://", has an empty host and path and gets the
default verdict; repeated urls are judged each; without rules the default holds for all; an
empty table gives no rows; a batch takes a round for each byte of its longest url.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_names, replaced, steps, texts

DEFAULT = "allow"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    name: str
    verdict: str
    glob: str
    anchored: bool  # at the URL's start; else it may begin after any host character


def host_rule(rule: str, verdict: str) -> Rule:
    """`host/path`: the host and its subdomains, paths that start so.  `*` in the path is any run of characters."""
    return Rule(rule, verdict, "." + rule, False)


class Automaton:
    """Shift-And masks of all rules over bytes."""

    def __init__(self, rules: Sequence[Rule]):
        self.rules = list(rules)
        globs = [[c for i, c in enumerate(r.glob.encode()) if c != 42 or i == 0 or r.glob.encode()[i - 1] != 42] for r in self.rules]
        bits = sum(1 + sum(c != 42 for c in g) for g in globs)
        words = max(1, -(-bits // 64))
        self.start, self.init = np.zeros(words, np.uint64), np.zeros(words, np.uint64)
        self.match, self.stay = np.zeros((256, words), np.uint64), np.zeros((256, words), np.uint64)
        self.final: list[tuple[int, np.uint64]] = []
        at = 0

        def on(table: np.ndarray, bit: int) -> None:
            table[..., bit // 64] |= np.uint64(1) << np.uint64(bit % 64)

        for rule, glob in zip(self.rules, globs):
            on(self.start, at)  # the state before the first character
            if not rule.anchored:
                for c in range(256):
                    if c != 47:  # it waits through the host
                        on(self.stay[c], at)
            bit = at
            for c in glob:
                if c == 42:
                    on(self.stay, bit)
                else:
                    bit += 1
                    on(self.match[c], bit)
            on(self.stay, bit)  # the rest is free
            self.final.append((bit // 64, np.uint64(1) << np.uint64(bit % 64)))
            at = bit + 1
        order = sorted(range(len(self.rules)), key=lambda i: (-len(self.rules[i].name), i))
        self.order = np.array(order, np.int64)

    def longest(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """For each text the longest matching rule's number, or -1."""
        n = len(offsets) - 1
        state = np.repeat(self.start[None], n, 0)
        size = np.diff(offsets)
        by_size = np.argsort(-size, kind="stable")
        begins, sizes = offsets[:-1][by_size], size[by_size]
        live = n
        for t in range(int(size.max()) if n else 0):
            live = int(np.searchsorted(-sizes[:live], -t, "left"))
            c = raw[begins[:live] + t]
            d = state[:live]
            moved = d << np.uint64(1)
            moved[:, 1:] |= d[:, :-1] >> np.uint64(63)
            state[:live] = moved & self.match[c] | d & self.stay[c]
        out = np.full(n, -1)
        for i in self.order[::-1]:
            word, bit = self.final[i]
            out[by_size[(state[:, word] & bit) != 0]] = i
        return out


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without one."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def judge(pages: DataFrame, rules: Sequence[Rule], url_col: str = "url", default: str = DEFAULT) -> DataFrame:
    """`pages` with columns host, path, rule, verdict; columns of these names give way to them."""
    (given,) = free_names(pages, "canonical url")
    url = F.col(given)
    pages = replaced(pages.withColumn(given, F.col(url_col).cast("string")), "host", "path", "rule", "verdict")
    ready = pages.withColumns({"host": host(url), "path": path(url)}).withColumn(given, F.concat(F.lit("."), "host", "path"))
    columns = [c for c in ready.columns if c != given]
    automaton = Automaton(rules)  # a few masks a rule, in the closure

    def run(batches):
        names, verdicts = [r.name for r in automaton.rules] + [None], [r.verdict for r in automaton.rules] + [default]
        for batch in batches:
            if not batch.num_rows:
                continue
            raw, offsets = texts(batch.column(given))
            best = np.concatenate([automaton.longest(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]) for lo, hi in steps(offsets)])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in columns), pa.array([names[i] for i in best], pa.string()), pa.array([verdicts[i] for i in best], pa.string())], names=[*columns, "rule", "verdict"]
            )

    schema = T.StructType([*(f for f in ready.schema.fields if f.name != given), T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())])
    return ready.mapInArrow(run, schema)
