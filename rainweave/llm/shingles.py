"""Vectorised word and n-gram hashes of whole Arrow text columns.

Words are runs of bytes other than space and 0x09-0x0D, so the UTF-8 buffer is read as it is, with no Python string per
word. A word's hash is a polynomial over its bytes, an n-gram's one over its word hashes, both finalised; it depends on
the words alone, not on their place. Two seeds give 128 bits. Work goes on in pieces of PIECE bytes, cut between words,
so memory is bounded for texts of any length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

PIECE = 1 << 20


def separators(raw: np.ndarray) -> np.ndarray:
    return (raw == 0x20) | ((raw - np.uint8(0x09)) < 5)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser: spreads every bit of the input over 64 bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _byte_values(seed: int, lower: bool) -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed * 7919 + 1))
    if lower:
        values[65:91] = values[97:123]
    return values


def _powers(seed: int, n: int) -> np.ndarray:
    base = mix(np.array([seed + 77], np.uint64)) | np.uint64(1)
    out = np.full(n, base[0], np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and the n + 1 bounds of its texts; a null text is empty."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    if data is None or not len(bounds) or bounds[-1] == bounds[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    raw = np.frombuffer(data, np.uint8)[bounds[0]:bounds[-1]]
    return raw, bounds - bounds[0]


def slices(batches, column: str = "text", most: int = 4 * PIECE):
    """The batches cut to about `most` bytes of text each; a longer text stands alone."""
    for batch in batches:
        size = np.diff(text_bytes(batch.column(column))[1])
        group = np.cumsum(size) // most
        begins = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if len(group) else []
        for at, end in zip(begins, [*begins[1:], batch.num_rows]):
            yield batch.slice(at, end - at)


class Words:
    """Word positions and hashes of a text column."""

    #: which bytes part words
    breaks = staticmethod(separators)

    def __init__(self, column: pa.Array, lower: bool = False, seeds: tuple[int, ...] = (1,)):
        self.raw, self.bounds = text_bytes(column)
        self.n_texts = len(column)
        tables = [_byte_values(s, lower) for s in seeds]
        starts, ends, hashes = [], [], [[] for _ in seeds]
        total, at = len(self.raw), 0
        while at < total:
            stop = self._cut(min(at + PIECE, total))
            s, e = self._spans(at, stop)
            starts.append(s)
            ends.append(e)
            if len(s):
                length = (e - s).astype(np.int32)
                piece = self.raw[at:stop]
                values = piece[~self.breaks(piece)]
                before = np.cumsum(length, dtype=np.int32) - length
                place = np.arange(len(values), dtype=np.int32) - np.repeat(before, length)
                for k, (seed, table) in enumerate(zip(seeds, tables)):
                    terms = table[values]
                    terms *= _powers(seed, int(length.max()))[place]
                    hashes[k].append(mix(np.add.reduceat(terms, before) + length.astype(np.uint64)))
            at = stop
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        self.starts, self.ends = join(starts, np.int64), join(ends, np.int64)
        self.hashes = [join(h, np.uint64) for h in hashes]
        self.text = np.searchsorted(self.bounds, self.starts, "right") - 1
        #: words of each text, and where they begin
        self.counts = np.bincount(self.text, minlength=self.n_texts)[:self.n_texts]
        self.first = np.concatenate(([0], np.cumsum(self.counts)))

    def _cut(self, stop: int) -> int:
        """The first place from stop on where no word is cut."""
        total = len(self.raw)
        if stop >= total:
            return total
        k = np.searchsorted(self.bounds, stop, "left")
        limit = int(self.bounds[k])
        while stop < limit:
            piece = self.breaks(self.raw[stop:min(stop + 65536, limit)])
            if piece.any():
                return stop + int(piece.argmax())
            stop += len(piece)
        return limit

    def _spans(self, at: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
        inside = ~self.breaks(self.raw[at:stop])
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        # a text's first byte begins a word even if the text before it ended with one
        edges = self.bounds[np.searchsorted(self.bounds, at, "left"):np.searchsorted(self.bounds, stop, "left")] - at
        begins[edges] |= inside[edges]
        finishes = inside.copy()
        finishes[:-1] &= ~inside[1:] | begins[1:]
        return np.flatnonzero(begins) + at, np.flatnonzero(finishes) + at + 1

    def ngrams(self, n: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all n-grams of consecutive words of one text, and the index of their first word."""
        h = self.hashes[seed]
        m = len(h) - n + 1
        if m <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.text[:m] == self.text[n - 1:])
        out = np.zeros(m, np.uint64)
        for j, p in enumerate(_powers(1000 + seed, n)):
            out += h[j:j + m] * p
        return mix(out[at]), at

    def whole(self, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each text's whole word sequence, for texts with words, and their indices."""
        texts = np.flatnonzero(self.counts)
        place = np.arange(len(self.text)) - self.first[self.text]
        power = _powers(2000 + seed, int(self.counts.max(initial=1)))
        sums = np.add.reduceat(self.hashes[seed] * power[place], self.first[texts]) if len(texts) else np.zeros(0, np.uint64)
        return mix(sums + self.counts[texts].astype(np.uint64) * np.uint64(31)), texts


_PUNCTUATION = np.array([c < 0x80 and not chr(c).isalnum() for c in range(256)])


class Terms(Words):
    """The same for maximal runs of ASCII letters, digits and all code points above 0x7F."""

    breaks = staticmethod(lambda raw: _PUNCTUATION[raw])
