"""Bounded sketches of 64-bit hashes, built per task and merged by block.

A sketch has ROWS rows of 2**width cells. A task sends, for each block of cells it touched, which cells it has met once
and which at least twice; blocks are merged as they stream by, and the merged bits go to the tasks of the next pass. Their
size depends on width and rows alone (2**width / 8 bytes a row), never on the data: a fuller sketch only passes more
hashes on. A hash met twice is never missed.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame

BLOCK = 20
ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)


def cells(hashes: np.ndarray, row: int, width: int) -> np.ndarray:
    return ((hashes * np.uint64(ODD[row])) >> np.uint64(64 - width)).astype(np.uint32)


class Shared:
    """A sketch sent to the tasks compressed, as most of its bits are alike, and unpacked once a task."""

    def __init__(self, broadcast: Broadcast, size: int, rows: int = 0):
        self.broadcast, self.size, self.rows, self._value = broadcast, size, rows, None

    @classmethod
    def of(cls, df: DataFrame, value: np.ndarray) -> Shared:
        flat = memoryview(value).cast("B")
        step = 8 << 20
        press = zstandard.ZstdCompressor(level=1).compress
        packed = [press(flat[k:k + step]) for k in range(0, len(flat), step)]
        return cls(df.sparkSession.sparkContext.broadcast(packed), len(flat), len(value) if value.ndim > 1 else 0)

    @property
    def value(self) -> np.ndarray:
        if self._value is None:
            unpack = zstandard.ZstdDecompressor().decompress
            flat, at = np.empty(self.size, np.uint8), 0
            for part in map(unpack, self.broadcast.value):
                flat[at:at + len(part)] = np.frombuffer(part, np.uint8)
                at += len(part)
            self._value = flat.reshape(self.rows, -1) if self.rows else flat
        return self._value

    def __reduce__(self):
        return Shared, (self.broadcast, self.size, self.rows)


def _gathered(parts, least: int = 2 << 20):
    """Non-empty arrays joined to at least `least` numbers each but for the last."""
    held, size = [], 0
    for part in parts:
        held.append(part)
        size += len(part)
        if size >= least:
            yield np.concatenate(held)
            held, size = [], 0
    if size:
        yield np.concatenate(held)


def _to_bytes(ascending: np.ndarray) -> bytes:
    """Ascending numbers as compressed gaps."""
    if not len(ascending):
        return b""
    gaps = np.diff(ascending, prepend=ascending[:1] * 0)
    wide = int(gaps.max()) > 0xFFFF
    return bytes([wide]) + zstandard.ZstdCompressor(level=1).compress(gaps.astype(np.uint32 if wide else np.uint16).tobytes())


def _from_bytes(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.int64)
    gaps = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint32 if data[0] else np.uint16)
    return np.cumsum(gaps, dtype=np.int64)


def _by_block(block: int, *ascending: np.ndarray) -> tuple[list, ...]:
    """Numbers of the touched blocks, and for each argument its cells in them, counted from the block's begin."""
    numbers = np.unique(ascending[0] >> np.uint32(block))
    bases = numbers << np.uint32(block)
    out = []
    for a in ascending:
        lo, hi = np.searchsorted(a, bases), np.append(np.searchsorted(a, bases[1:]), len(a)) if len(bases) else []
        out.append([_to_bytes(a[i:j] - base) for i, j, base in zip(lo, hi, bases)])
    return numbers.tolist(), *out


def build(df: DataFrame, hashes: Callable[[pa.RecordBatch], np.ndarray], width: int, rows: int = 2, twice: bool = True) -> Shared:
    """Broadcast bits, one packed array a row: cells met at least twice (or at all, with twice=False)."""
    block = min(BLOCK, width)

    def local(batches):
        for h in _gathered(map(hashes, batches)):
            out = []
            for r in range(rows):
                at = np.sort(cells(h, r, width))
                first = np.ones(len(at), bool)
                first[1:] = at[1:] != at[:-1]
                again = at[:-1][first[:-1] & ~first[1:]] if twice else at[:0]
                for b, once, more in zip(*_by_block(block, at[first], again)):
                    out.append((r, b, once, more))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.binary(), pa.binary()))],
                                  ["r", "b", "once", "again"])

    def merge(batches):
        held: dict = {}
        for batch in batches:
            for r, b, once, again in zip(*(c.to_pylist() for c in batch.columns)):
                if (r, b) not in held:
                    held[r, b] = np.zeros((2, 1 << block), bool)
                seen, repeated = held[r, b]
                new = _from_bytes(once)
                repeated[new] |= seen[new]
                seen[new] = True
                repeated[_from_bytes(again)] = True
        for (r, b), have in held.items():
            bits = zstandard.ZstdCompressor(level=1).compress(np.packbits(have[int(twice)]).tobytes())
            yield pa.record_batch([pa.array([r], pa.int32()), pa.array([b], pa.int32()), pa.array([bits], pa.binary())], ["r", "b", "bits"])

    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    merged = (df.mapInArrow(local, "r int, b int, once binary, again binary").repartition(parts, "r", "b")
              .mapInArrow(merge, "r int, b int, bits binary"))
    bits = np.zeros((rows, 1 << width >> 3), np.uint8)
    step = 1 << block >> 3
    for r, b, part in merged.collect():  # blocks of one bounded sketch, compressed
        bits[r, b * step:(b + 1) * step] = np.frombuffer(zstandard.ZstdDecompressor().decompress(part), np.uint8)
    return Shared.of(df, bits)


def holds(bits: np.ndarray, hashes: np.ndarray, width: int) -> np.ndarray:
    """Which hashes have their cell set in every row."""
    out = np.ones(len(hashes), bool)
    for r in range(len(bits)):
        left = np.flatnonzero(out)
        c = cells(hashes[left], r, width)
        out[left] = (bits[r][c >> np.uint32(3)] >> (np.uint8(7) - (c & np.uint32(7)).astype(np.uint8))) & 1 == 1
    return out


def count_levels(df: DataFrame, hashes: Callable[[pa.RecordBatch], np.ndarray], width: int) -> Shared:
    """Broadcast count-min row of one byte a cell: the floored binary logarithm of the count of hashes in it."""
    block = min(BLOCK, width)

    def local(batches):
        pack = zstandard.ZstdCompressor(level=1).compress
        for h in _gathered(map(hashes, batches)):
            at, n = np.unique(cells(h, 0, width), return_counts=True)
            numbers, where = _by_block(block, at)
            counts = np.split(n.astype(np.uint32), np.searchsorted(at >> np.uint32(block), numbers)[1:])
            yield pa.record_batch([pa.array(numbers, pa.int32()), pa.array(where, pa.binary()),
                                   pa.array([pack(c.tobytes()) for c in counts], pa.binary())], ["b", "at", "n"])

    def merge(batches):
        unpack, pack = zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor(level=1).compress
        held: dict = {}
        for batch in batches:
            for b, at, n in zip(*(c.to_pylist() for c in batch.columns)):
                held.setdefault(b, np.zeros(1 << block, np.int64))[_from_bytes(at)] += np.frombuffer(unpack(n), np.uint32)
        for b, have in held.items():
            levels = np.where(have > 0, np.log2(np.maximum(have, 1)), 0).astype(np.uint8)
            yield pa.record_batch([pa.array([b], pa.int32()), pa.array([pack(levels.tobytes())], pa.binary())], ["b", "levels"])

    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    merged = (df.mapInArrow(local, "b int, at binary, n binary").repartition(parts, "b").mapInArrow(merge, "b int, levels binary"))
    levels = np.zeros(1 << width, np.uint8)
    for b, part in merged.collect():  # likewise
        levels[b << block:(b + 1) << block] = np.frombuffer(zstandard.ZstdDecompressor().decompress(part), np.uint8)
    return Shared.of(df, levels)
