"""Vectorised text kernels: words, word hashes and rolling word-window hashes of whole Arrow batches.

Everything works on UTF-8 bytes with numpy. Hashes are polynomials modulo 2**64 over a fixed random byte
table, finished with a mixer; they do not depend on the process, so any executor can rebuild them.
"""

from __future__ import annotations

import ctypes
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard

#: Text bytes that one kernel call works on; longer documents are a call of their own.
SLICE_BYTES = 2 << 20
#: Bytes that are hashed at once inside a kernel call: bounds the 8-byte temporaries.
HASH_BYTES = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Word bytes of [^\x20\x09-\x0D]+ .
NON_SPACE = np.ones(256, dtype=bool)
NON_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: Word bytes of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ once A-Z is lower-cased.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finisher."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeded(seed: int, n: int) -> np.ndarray:
    return mix(np.uint64(seed) + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class Powers:
    """base**i and base**-i modulo 2**64 for i below a length that grows on demand."""

    def __init__(self, seed: int):
        self.base = int(seeded(seed, 1)[0]) | 1
        self.inverse = pow(self.base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    @staticmethod
    def _grown(x: np.ndarray, base: int, n: int) -> np.ndarray:
        while len(x) < n:
            x = np.concatenate([x, x * np.uint64(pow(base, len(x), 1 << 64))])
        return x

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = self._grown(self.up, self.base, n), self._grown(self.down, self.inverse, n)
        return self.up, self.down


BYTES, BYTE_POWERS = seeded(11, 256), Powers(12)
WINDOW_POWERS = {1: Powers(13), 2: Powers(14)}


class Words:
    """Words of some documents: start and end bytes, and where each document's words begin.

    buf holds the documents one after another, bounds their byte offsets. first[d]:first[d + 1] are the words of d.
    """

    def __init__(self, buf: np.ndarray, bounds: np.ndarray, classes: np.ndarray):
        self.buf, self.bounds = buf, bounds
        if len(buf):
            inside = classes[buf]
            starts = inside.copy()
            starts[1:] &= ~inside[:-1]
            ends = inside.copy()
            ends[:-1] &= ~inside[1:]
            cuts = np.unique(bounds)
            heads = cuts[cuts < len(buf)]
            starts[heads] |= inside[heads]
            tails = cuts[cuts > 0] - 1
            ends[tails] |= inside[tails]
            self.start, self.end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        else:
            self.start = self.end = np.zeros(0, dtype=np.int64)
        self.first = np.searchsorted(self.start, bounds)

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)

    def hashes(self, lower: bool = False) -> np.ndarray:
        """A hash of each word's bytes."""
        table = BYTES[LOWER] if lower else BYTES
        out, n, i = np.empty(len(self), dtype=np.uint64), len(self), 0
        while i < n:
            a = int(self.start[i])
            j = max(i + 1, int(np.searchsorted(self.end, a + HASH_BYTES, side="right")))
            b = int(self.end[j - 1])
            up, down = BYTE_POWERS.get(b - a + 1)
            sums = np.zeros(b - a + 1, dtype=np.uint64)
            np.cumsum(table[self.buf[a:b]] * up[: b - a], out=sums[1:])
            s, e = self.start[i:j] - a, self.end[i:j] - a
            out[i:j] = mix((sums[e] - sums[s]) * down[s])
            i = j
        return out

    def windows(self, hashes: np.ndarray, k: int, which: int = 1) -> np.ndarray:
        """Hashes of the k words from each position; the last k - 1 positions of a document have no meaning."""
        n = len(hashes)
        if n < k:
            return np.zeros(0, dtype=np.uint64)
        up, down = WINDOW_POWERS[which].get(n + 1)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(hashes * up[:n], out=sums[1:])
        return mix((sums[k:] - sums[:-k]) * down[: n - k + 1])

    def window_starts(self, k: int) -> np.ndarray:
        """Positions at which a window of k words lies in one document."""
        room = np.maximum(self.counts - k + 1, 0)
        return ranges(self.first[:-1], room)


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for length[0] numbers, then the same for the others."""
    total = int(length.sum())
    at = np.cumsum(length) - length
    return np.arange(total) + np.repeat(start - at, length)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and offsets; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if offsets else np.zeros(len(column) + 1, dtype=np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Batches of at most so many text bytes (or one document), each with its bytes and offsets."""
    for batch in batches:
        if not batch.num_rows:
            continue
        buf, bounds = text_bytes(batch.column(text))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + most, side="right")) - 1)
            yield batch.slice(i, j - i), buf[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]
            i = j
        del batch, buf, bounds
        give_back()


@functools.cache
def _trim():
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)


def give_back() -> None:
    """Returns freed memory to the system: idle workers stay small."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def numbers(column: pa.Array, null: int = 0) -> np.ndarray:
    """An integer column as int64."""
    return (column.fill_null(null) if column.null_count else column).to_numpy(zero_copy_only=False).astype(np.int64)


@functools.cache
def _zstd() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def pack(x: np.ndarray) -> bytes:
    return _zstd()[0].compress(np.ascontiguousarray(x).tobytes())


def unpack(x: bytes, kind) -> np.ndarray:
    return np.frombuffer(_zstd()[1].decompress(x), dtype=kind)


def pack_ids(x: np.ndarray) -> bytes:
    """Packs int64 numbers as differences."""
    return pack(np.diff(x, prepend=np.int64(0)))


def unpack_ids(x: bytes) -> np.ndarray:
    return np.cumsum(unpack(x, np.int64))


def sha256_hex(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()
