"""Exact, cached encoding with a word-level public tokenizer.

The vocabulary's pre-tokenizer drops white space and never joins across it, so
a text's ids are the concatenation of its space-separated chunks' ids; signs
that close a word are a chunk of their own.  Arrow finds the distinct chunks of
some texts; each Python worker keeps a bounded chunk -> ids table, hands only
unseen chunks to the tokenizers library, and puts the ids together by number.
`Encoder.encode` equals `Tokenizer.encode` on the whole text (tests compare
them); a null text is the empty text.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Chunks of a generation, of which a Python worker keeps two; about 150 bytes each.
CACHE_ENTRIES = 200_000
#: Appended to every document by the queries.
END_ID = 2

_MARKS = re.compile("[̀-ͯ]")
#: Signs that the vocabulary's pre-tokenizer cuts off a word as one run; the apostrophe begins contractions.
_CLOSING = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: A word of small Latin letters (they compose with nothing) and the signs that close it.
_PLAIN = re.compile("([{}]+)([{}]*)".format("".join(c for c in map(chr, range(0x250)) if c.isalpha() and c.lower() == c), re.escape(_CLOSING)))


def _byte_alphabet() -> str:
    """The printable character that byte-level vocabularies use for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return "".join(chr(b) if b in plain else chr(next(spare)) for b in range(256))


#: For text whose bytes were read as Latin-1; the space stays, as it parts words.
_BYTES = {b: c for b, c in enumerate(_byte_alphabet()) if b != 32}
#: Words that the library gets in one text, characters that are encoded together.
_AT_ONCE, _STEP = 64, 1 << 20
#: Bytes of those signs, and of small letters.
_SIGN, _SMALL = (np.isin(np.arange(256), list(signs.encode())) for signs in (_CLOSING, "abcdefghijklmnopqrstuvwxyz"))


class Encoder:
    """Encodes with `tokenizers`; ids come back as little-endian arrays."""

    def __init__(self, path: str, cache_entries: int = CACHE_ENTRIES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        vocab = self.whole.get_vocab()
        self.dtype = np.dtype("<u2" if max(vocab.values()) < 1 << 16 else "<u4")
        # For lower-case words: the same merges, words apart at spaces.  Each word's
        # last id, and no other, has the end-of-word suffix.
        self.words = Tokenizer(self.whole.model)
        self.words.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        suffix = self.words.model.end_of_word_suffix
        if not suffix:
            raise ValueError("the vocabulary marks no word ends")
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
        self.cache: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}
        self.limit = cache_entries

    @staticmethod
    def _lowered(text: str) -> str:
        # Lower-casing first only makes chunks meet in the cache; it is skipped
        # where it could change what composes (combining marks, final sigma, dotted I)
        # or make a special token of other text.
        if "<|" not in text and (text.isascii() or not (_MARKS.search(text) or "Σ" in text or "İ" in text)):
            text = text.lower()
        return text

    def _chunks(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """The chunks of some texts, and where each text's chunks end."""
        texts = [self._lowered(text) for text in texts]
        parts = [text.encode() for text in texts]
        raw = np.frombuffer(b" ".join(parts) + b" ", np.uint8)
        space = (raw == 32) | (raw == 10)
        cut = space
        if not any("<|" in text for text in texts):
            # signs between a small letter and a space are a chunk of their own, so that the word meets others in the cache
            sign = _SIGN[raw]
            edge = np.flatnonzero(sign[1:] != sign[:-1]) + 1
            if sign[0]:
                edge = edge[1:]
            begin, end = edge[::2], edge[1::2]
            cut = space.copy()
            cut[begin[_SMALL[raw[begin - 1]] & space[end]]] = True
        at = np.flatnonzero(cut)
        # chunks lie one after another once the spaces are out
        blank = space[at].astype(np.int64)
        offsets = np.concatenate([[0], at - np.cumsum(blank) + blank])
        chunks = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(raw[~space]))
        return chunks, np.searchsorted(at, np.cumsum([len(part) + 1 for part in parts]))

    def _learn(self, chunks: list[str]) -> None:
        cache = self.cache
        tails, words, rest, plain = [], {}, set(), _PLAIN.fullmatch
        for c in chunks:
            if c.isascii() and c.isalpha() and c.islower():
                words[c] = None
                continue
            m = plain(c)
            if m is None:
                rest.add(c)
                continue
            stem, tail = m.groups()
            if tail:
                tails.append((c, stem, tail))
                if tail not in cache:
                    rest.add(tail)
                if stem in cache:
                    continue
            words[stem] = None
        for key, e in zip(rest, self.whole.encode_batch_fast(list(rest), add_special_tokens=False)):
            cache[key] = np.array(e.ids, self.dtype).tobytes()
        if words:
            keys = list(words)
            texts = (" ".join(keys[at : at + _AT_ONCE]) for at in range(0, len(keys), _AT_ONCE))
            texts = [text if text.isascii() else text.encode().decode("latin-1").translate(_BYTES) for text in texts]
            ids = np.array([i for e in self.words.encode_batch_fast(texts, add_special_tokens=False) for i in e.ids], self.dtype)
            stops = ((np.flatnonzero(self.ends[ids]) + 1) * self.dtype.itemsize).tolist()
            if len(stops) != len(keys):
                raise ValueError("word ends and words differ in number")
            raw, at = ids.tobytes(), 0
            for key, stop in zip(keys, stops):
                cache[key] = raw[at:stop]
                at = stop
        for c, stem, tail in tails:
            cache[c] = cache[stem] + cache[tail]

    def _values(self, chunks: list[str]) -> list[bytes]:
        """The ids of some distinct chunks."""
        if len(self.cache) > self.limit:
            # what was not met since the last turn goes
            self.old, self.cache = self.cache, {"": b""}
        cache, old = self.cache, self.old
        found = list(map(cache.get, chunks))
        unseen = [c for c, ids in zip(chunks, found) if ids is None]
        if unseen:
            again = [c for c in unseen if c in old]
            cache.update(zip(again, map(old.__getitem__, again)))
            self._learn([c for c in unseen if c not in old])
            learnt = map(cache.__getitem__, unseen)
            found = [next(learnt) if ids is None else ids for ids in found]
        return found

    def _encoded(self, texts: list[str], end: list[bytes]) -> list[np.ndarray]:
        """One id array per text, with its `end`."""
        chunks, stops = self._chunks(texts)
        found = chunks.dictionary_encode()
        values = self._values(found.dictionary.to_numpy(zero_copy_only=False).tolist())
        # a text's end is one more chunk of it
        which = np.insert(found.indices.to_numpy(), stops, np.arange(len(values), len(values) + len(end)))
        values += end
        size = np.fromiter(map(len, values), np.int64, len(values)) // self.dtype.itemsize
        first = np.cumsum(size) - size
        size = size[which]
        stop = np.cumsum(size)
        at = np.repeat(first[which] - stop + size, size)
        at += np.arange(len(at))
        ids = np.frombuffer(b"".join(values), self.dtype)[at]
        bounds = [0, *stop[stops + np.arange(len(stops))].tolist()]
        return [ids[lo:hi] for lo, hi in zip(bounds[:-1], bounds[1:])]

    def encode(self, texts: list[str | None], end_id: int | None = None) -> list[np.ndarray]:
        """One id array per text, with `end_id` appended if given."""
        last = b"" if end_id is None else np.array([end_id], self.dtype).tobytes()
        out: list[list[np.ndarray]] = [[] for _ in texts]
        held, size = [], 0

        def done() -> None:
            for (i, _, _), ids in zip(held, self._encoded([part for _, part, _ in held], [end for _, _, end in held])):
                out[i].append(ids)
            held.clear()

        for i, text in enumerate(texts):
            parts = list(_parts(text or ""))
            for k, part in enumerate(parts, 1):
                if held and size + len(part) > _STEP:
                    done()
                    size = 0
                held.append((i, part, last if k == len(parts) else b""))
                size += len(part)
        if held:
            done()
        return [ids[0] if len(ids) == 1 else np.concatenate(ids) for ids in out]


def _parts(text: str) -> Iterator[str]:
    """A text in parts of about _STEP characters, cut at spaces."""
    lo = 0
    while len(text) - lo > _STEP:
        hi = text.rfind(" ", lo, lo + _STEP)
        hi = text.find(" ", lo + _STEP) if hi < 0 else hi
        if hi < 0:
            break
        yield text[lo:hi]
        lo = hi + 1
    yield text[lo:]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def word_bpe_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))
