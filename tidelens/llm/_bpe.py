"""Byte-level BPE of whole Arrow batches with the tokenizers library.

The library takes some microseconds for each word, mostly for its bookkeeping. Here a slice of texts
is cut into the tokenizer's own pre-tokens with numpy, equal pre-tokens are brought together, and the
library's model encodes each distinct one once; the ids are then spread back. Texts with code points
on whose class Unicode versions differ, or with a special token's string, go to the library whole.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa

from ._text import span_hashes, text_buffer

LETTER, NUMBER, SPACE, OTHER, UNSURE = range(5)
#: Code points with the Unicode property White_Space.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Most pre-tokens that a worker remembers, some 30 bytes each (twice that while it adds some).
REMEMBERED = 400_000


@functools.cache
def _classes() -> np.ndarray:
    """The class of every code point; those not settled since Unicode 3.2 are UNSURE."""
    out = np.full(0x110000, OTHER, np.uint8)
    old = unicodedata.ucd_3_2_0
    for c in range(0x110000):
        ch = chr(c)
        now, then = unicodedata.category(ch)[0], old.category(ch)
        if then[0] != now or then == "Cn":
            out[c] = UNSURE
        elif now in "LN":
            out[c] = LETTER if now == "L" else NUMBER
    out[WHITE_SPACE] = SPACE
    return out


def _byte_letters() -> list[str]:
    """The printable stand-in of every byte in byte-level BPE: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def pre_tokens(points: np.ndarray, off: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Starts (in code points) of the pre-tokens of texts that end at ``off``; each ends where the next starts."""
    n = len(points)
    start = np.ones(n, bool)
    start[1:] = kinds[1:] != kinds[:-1]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    start |= edge[:-1]
    space = kinds == SPACE
    # The last white space before a non-space stands alone, or leads the next run if it is U+0020.
    last = np.zeros(n, bool)
    last[:-1] = space[:-1] & ~space[1:] & ~edge[1:-1]
    start[last] = True
    lead = np.flatnonzero(last & (points == 0x20))
    start[lead + 1] = False
    # Contractions: a lone apostrophe that begins a pre-token, with letters after it.
    quote = np.flatnonzero((points == 0x27) & start)
    quote = quote[quote + 1 < n]
    quote = quote[(kinds[quote + 1] == LETTER) & ~edge[quote + 1]]
    if len(quote):
        padded = np.concatenate([points, np.zeros(2, points.dtype)])
        a, b = padded[quote + 1], padded[quote + 2]
        within = ~edge[np.minimum(quote + 2, n)]
        two = within & (((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l"))))
        one = np.isin(a, [ord(c) for c in "stmd"])
        size = np.where(one, 1, np.where(two, 2, 0))
        found, size = quote[size > 0], size[size > 0]
        start[found + 1] = False
        after = found + 1 + size
        inside = after < n
        after = after[inside]
        start[after] = True
    return np.flatnonzero(start)


class _Known:
    """Ids of pre-tokens by hash: sorted arrays, a large one and a small one that is merged into it now and then."""

    def __init__(self):
        self.flat = np.zeros(0, np.uint32)
        self.levels = [self._none(), self._none()]

    @staticmethod
    def _none():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in ``flat`` (-1: unknown) and number of ids of each hash."""
        place, size = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int32)
        for keys, places, sizes in self.levels:
            if len(keys):
                i = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
                hit = keys[i] == hashes
                place[hit], size[hit] = places[i[hit]], sizes[i[hit]]
        return place, size

    def add(self, hashes: np.ndarray, words: list[tuple[int, ...]]) -> None:
        sizes = np.fromiter(map(len, words), np.int32, len(words))
        places = len(self.flat) + np.cumsum(sizes, dtype=np.int64) - sizes
        self.flat = np.concatenate([self.flat, np.fromiter((i for w in words for i in w), np.uint32, int(sizes.sum()))])
        self.levels[1] = self._merged(self.levels[1], (hashes, places, sizes))
        if len(self.levels[1][0]) * 4 > len(self.levels[0][0]):
            self.levels = [self._merged(*self.levels), self._none()]

    @staticmethod
    def _merged(a, b):
        out = [np.concatenate(x) for x in zip(a, b)]
        order = np.argsort(out[0], kind="stable")
        return tuple(x[order] for x in out)

    def full(self) -> bool:
        return sum(len(x[0]) for x in self.levels) > REMEMBERED


class BatchEncoder:
    """Encodes string columns; keeps the ids of the pre-tokens seen before, up to ``REMEMBERED``."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = {b: c for b, c in enumerate(_byte_letters())}
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known = _Known()

    def _word(self, word: bytes) -> tuple[int, ...]:
        text = word.decode("latin-1")
        text = text.replace(" ", self.letters[32]) if text.isascii() and text.isprintable() else text.translate(self.letters)
        return tuple([t.id for t in self.model.tokenize(text)])

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the column's texts (unsigned 32-bit), and the n + 1 offsets of its rows."""
        buf, off = text_buffer(column)
        n = len(off) - 1
        if not len(buf):
            return np.zeros(0, np.uint32), np.zeros(n + 1, np.int64)
        raw = buf.tobytes()
        points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
        begins = np.flatnonzero((buf & 0xC0) != 0x80)  # byte place of every code point
        at = np.searchsorted(begins, off)  # offsets in code points
        kinds = _classes()[points]
        odd = np.zeros(n, bool)
        unsure = np.flatnonzero(kinds == UNSURE)
        if len(unsure):
            odd[np.searchsorted(at, unsure, "right") - 1] = True
        for s in self.special:
            place = raw.find(s)
            while place >= 0:
                odd[np.searchsorted(off, place, "right") - 1] = True
                place = raw.find(s, place + 1)
        starts = pre_tokens(points, at, kinds)
        ends = np.append(starts[1:], len(points))
        bytes_at = np.append(begins, len(buf))
        codes, distinct = pd.factorize(span_hashes(buf, bytes_at[starts], bytes_at[ends]))
        if self.known.full():
            self.known = _Known()
        place, size = self.known.find(distinct)
        new = np.flatnonzero(place < 0)
        if len(new):
            firsts = np.zeros(len(distinct), np.int64)
            firsts[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
            own = firsts[new]
            self.known.add(distinct[new], [self._word(raw[a:b]) for a, b in zip(bytes_at[starts[own]].tolist(), bytes_at[ends[own]].tolist())])
            place, size = self.known.find(distinct)
        each = size[codes].astype(np.int64)
        out_at = np.cumsum(each) - each
        total = int(each.sum())
        ids = self.known.flat[np.arange(total) + np.repeat(place[codes] - out_at, each)]
        # An empty text has no pre-token of its own: the next text's place serves.
        row_at = np.append(out_at, total)[np.searchsorted(starts, at)]
        if not odd.any():
            return ids, row_at
        parts, lengths = [], np.diff(row_at)
        for i in range(n):
            if odd[i]:
                own = np.array(self.tokenizer.encode(raw[off[i] : off[i + 1]].decode("utf-8"), add_special_tokens=False).ids, np.uint32)
                lengths[i] = len(own)
            else:
                own = ids[row_at[i] : row_at[i + 1]]
            parts.append(own)
        return np.concatenate(parts), np.concatenate([[0], np.cumsum(lengths)])


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> BatchEncoder:
    """The worker's encoder for a vocabulary file; Spark's Python workers are kept between tasks."""
    return BatchEncoder(path)
