"""Licence scans: Dice coefficient over word bigrams, with size bounds.

Words are runs of digits, letters and non-ASCII characters of the text with A-Z
lower-cased.  Segments are the whole text, each paragraph (between empty lines) and
each line.  A segment and a template have the Dice coefficient 2|A & B| / (|A| + |B|)
of their sets of word bigrams.  For a coefficient of at least t the sizes must satisfy
|B| t / (2 - t) <= |A| <= |B| (2 - t) / t, which prunes templates; segments with fewer
known bigrams than the smallest template needs are never looked at.

A licence that is no segment (several paragraphs of a long text, a notice with other words
on its line) is found by windows of words: of the best window of a template both ends are
bigrams of the template, its first bigram does not come again, and it holds at most
|B| (2 - 2t) / t other bigrams, so the best end from each such start is found exactly.
Windows add to segments: one that overlaps a segment with the same template is dropped, and
so is one inside a hit of a larger template that has the window's bigrams too (the Apache
notice that begins the Apache header).

Defined cases: null, empty and one-word texts match nothing; of equal coefficients the
first template by name is the best; texts that repeat are scanned each; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, arrow_map, lookup, steps, texts
from .license_texts import TEMPLATES

MIN_DICE = 0.85

_WORD = lookup(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)


class Templates:
    def __init__(self, templates: dict[str, str], least: float):
        self.least = least
        names = sorted(templates)
        w = Words(*texts(pa.array([templates[n] for n in names])), _WORD)
        grams = w.grams(2)
        self.sets = [(n, frozenset(grams[a : b - 1].tolist())) for n, a, b in zip(names, w.first[:-1], w.first[1:]) if b - a > 1]
        self.known = np.unique(np.array(sorted(set().union(*(s for _, s in self.sets))), np.uint64))
        # |A & B| >= t (|A| + |B|) / 2 and |A| >= |B| t / (2 - t)
        self.need = min((least * (1 + least / (2 - least)) * len(s) / 2 for _, s in self.sets), default=np.inf)
        self.member = np.array([np.isin(self.known, np.array(list(s), np.uint64)) for _, s in self.sets])

    def best(self, segment: set[int]) -> list[tuple[float, str]]:
        """(coefficient, template) of the templates that a segment reaches."""
        n, out = len(segment), []
        for name, s in self.sets:
            if len(s) * self.least <= n * (2 - self.least) + 1e-9 and n * self.least <= len(s) * (2 - self.least) + 1e-9:
                dice = 2 * len(segment & s) / (n + len(s))
                if dice >= self.least:
                    out.append((dice, name))
        return out

    def windows(self, grams: np.ndarray, place: np.ndarray, shown: list[tuple[float, str, int, int]]) -> list[tuple[float, str, int, int]]:
        """(coefficient, template, first, end) of a text's windows of bigrams that add to its segments `shown`; place: where known bigrams stand in `known`, else -1."""
        lead = np.zeros(len(grams), bool)
        lead[np.unique(grams, return_index=True)[1]] = True
        listed, hits = None, []
        for k, (name, s) in enumerate(self.sets):
            # |A & B| >= t |B| / (2 - t), and |A - B| <= |B| (2 - 2 t) / t
            need, other = max(1, int(np.ceil(len(s) * self.least / (2 - self.least) - 1e-9))), len(s) * (2 - 2 * self.least) / self.least + 1e-9
            ours = (place >= 0) & self.member[k][place]
            at = np.flatnonzero(ours)
            if len(at) < need:
                continue
            # new bigrams of the text are a lower bound of the others in a window
            new = np.cumsum(lead & ~ours)
            starts = at[: len(at) - need + 1]
            starts = starts[new[at[need - 1 :]] - new[starts] <= other]
            if len(starts) and listed is None:
                listed = grams.tolist()
            mine: list[tuple[float, str, int, int]] = []
            for a in starts.tolist():
                seen, both, rest, top, end = set(), 0, 0, 0.0, a
                for p in range(a, len(listed)):
                    g = listed[p]
                    if g in seen:
                        if g == listed[a]:
                            break
                        continue
                    seen.add(g)
                    if g not in s:
                        rest += 1
                        if rest > other:
                            break
                        continue
                    both += 1
                    dice = 2 * both / (both + rest + len(s))
                    if dice > top:
                        top, end = dice, p + 1
                    if both == len(s):
                        break
                if top >= self.least:
                    if not mine or a >= mine[-1][3]:
                        mine.append((top, name, a, end))
                    elif top > mine[-1][0]:
                        mine[-1] = (top, name, a, end)
            hits += [h for h in mine if not any(n == name and h[2] < e and b < h[3] for _, n, b, e in shown)]
        sets, every = dict(self.sets), hits + shown

        def inside(hit: tuple[float, str, int, int]) -> bool:
            _, name, a, end = hit
            larger = [n for _, n, b, e in every if b <= a and end <= e and len(sets[n]) > len(sets[name])]
            return bool(larger) and any(set(listed[a:end]) & sets[name] <= sets[n] for n in larger)

        return [h for h in hits if not inside(h)]


def scan(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, least: float = MIN_DICE) -> DataFrame:
    """One row per document: its id, license (the best, or null), dice and licenses (all, comma-joined)."""
    held = Templates(templates or TEMPLATES, least)  # a few dozen texts, in the closure

    def run(batch: pa.RecordBatch) -> dict:
        raw_all, offsets = texts(batch.column("text"))
        best, dice, names = [], [], []
        for lo, hi in steps(offsets):
            raw, offs = raw_all[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            w = Words(raw, offs, _WORD)
            grams = w.grams(2)
            at = np.minimum(np.searchsorted(held.known, grams), max(len(held.known) - 1, 0))
            place = np.where(held.known[at] == grams, at, -1) if len(held.known) else np.full(len(grams), -1)
            known = np.concatenate([[0], np.cumsum(place >= 0)])
            lines = np.flatnonzero(raw == 10)
            breaks = lines[1:][lines[1:] == lines[:-1] + 1]
            # word ranges of all segments: cut at texts, at empty lines, at lines
            spans = []
            for cut in (offs, np.union1d(offs, breaks), np.union1d(offs, lines)):
                edge = np.searchsorted(w.start, cut)
                spans.append(np.stack([edge[:-1], edge[1:]], 1))
            spans = np.concatenate(spans)
            spans = spans[spans[:, 1] - spans[:, 0] > 1]
            spans = spans[known[spans[:, 1] - 1] - known[spans[:, 0]] >= held.need - 1e-9]
            spans = np.unique(spans, axis=0)
            found: dict[int, list] = {}
            for a, b in spans.tolist():
                got = held.best(set(grams[a : b - 1].tolist()))
                if got:
                    found.setdefault(int(np.searchsorted(w.first, a, "right")) - 1, []).extend((d, n, a, b - 1) for d, n in got)
            for i, (a, b) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist())):
                got = found.get(i, [])
                if b - a > 1 and known[b - 1] - known[a] >= held.need - 1e-9:
                    got = got + held.windows(grams[a : b - 1], place[a : b - 1], [(d, n, p - a, q - a) for d, n, p, q in got])
                flat = sorted((-d, n) for d, n, _, _ in got)
                best.append(flat[0][1] if flat else None)
                dice.append(-flat[0][0] if flat else None)
                names.append(",".join(sorted({n for _, n in flat})))
        return {"id": batch.column("id"), "license": pa.array(best, pa.string()), "dice": pa.array(dice, pa.float64()), "licenses": pa.array(names, pa.string())}

    docs = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return arrow_map(docs, run, "id long, license string, dice double, licenses string").withColumnRenamed("id", id_col)
