"""Words of many texts at once, as arrays of hashes: what the operators in Python share.

A word is a run of bytes other than space and the five controls from tab to carriage return. All work is on UTF-8 bytes in
numpy, some bytes at a time, so memory is bounded by CHUNK or by the longest text, whichever is larger.
"""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at a time.
CHUNK = 4 << 20
SEPARATORS = (9, 10, 11, 12, 13, 32)

_IS_WORD = np.ones(256, bool)
_IS_WORD[list(SEPARATORS)] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_KEY = 0xC2B2AE3D27D4EB4F
#: Words of more bytes are hashed by a digest.
LONG = 64
_MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mix(h: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers (the public splitmix64 finaliser)."""
    h = h.copy()
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def power(n: int, which: str = "up") -> np.ndarray:
    """The first n powers of the hash base modulo 2^64, or of its inverse."""
    have = _powers[which]
    if len(have) < n:
        base = _BASE if which == "up" else pow(_BASE, -1, 1 << 64)
        steps = np.full(max(n, 2 * len(have)), base, np.uint64)
        steps[0] = 1
        have = _powers[which] = np.multiply.accumulate(steps)
    return have[:n]


class Words:
    """Of a list of texts: h (hash of each word), first (of each text, where its words begin; one more at the end), and the bytes."""

    def __init__(self, texts: list[bytes], lower: bool = True) -> None:
        buf = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
        self.buf = buf = _LOWER[buf] if lower else buf
        word = _IS_WORD[buf]
        edge = np.flatnonzero(word[1:] != word[:-1]) + 1
        self.starts, self.ends = edge[0::2], edge[1::2]
        self._eights = np.ndarray((max(0, len(buf)),), np.uint64, np.concatenate((buf, np.zeros(8, np.uint8))), strides=(1,))
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.text_starts = np.concatenate(([0], np.cumsum(sizes))) + 1
        self.first = np.searchsorted(self.starts, self.text_starts)
        self.h = self._hash(self.ends)

    def _hash(self, ends: np.ndarray) -> np.ndarray:
        """Hashes of the bytes from each word's start to ends: eight at a time, each eight mixed in; of long words a keyed digest.

        Words of one length up to eight bytes never hash alike; others do with a chance of 2^-64 a pair.
        """
        n = ends - self.starts
        h = mix(n.astype(np.uint64) * np.uint64(_BASE) + np.uint64(_KEY))
        on = np.flatnonzero(n <= LONG)
        for k in range(0, LONG, 8):
            on = on[n[on] > k]
            if not len(on):
                break
            eight = self._eights[self.starts[on] + k] & _MASKS[np.minimum(n[on] - k, 8)]
            h[on] = mix((h[on] * np.uint64(_BASE)) ^ eight)
        for i in np.flatnonzero(n > LONG).tolist():
            h[i] = int.from_bytes(hashlib.blake2b(self.buf[self.starts[i] : ends[i]], digest_size=8, key=b"faktum").digest(), "little")
        return h

    def prefixes(self, size: int) -> np.ndarray:
        """Hashes of the words' first bytes, at most size of them."""
        return self._hash(np.minimum(self.ends, self.starts + size))


def shingles(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of width words; of the whole sequence if it is shorter, none if it is empty."""
    if not len(h):
        return h
    width = min(width, len(h))
    out = np.zeros(len(h) - width + 1, np.uint64)
    for i in range(width):
        out = out * np.uint64(_BASE) + h[i : len(h) - width + 1 + i]
    return mix(out + np.uint64(width))


def texts_of(column: pa.Array) -> list[bytes]:
    """Each text in UTF-8; null is empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def portions(batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = CHUNK) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with their texts, each of about limit bytes, or one longer text."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        start = 0
        for at in range(0, batch.num_rows, 256):
            part = texts_of(column.slice(at, 256))
            held: list[bytes] = []
            size, start = 0, at
            for i, t in enumerate(part):
                if held and size + len(t) > limit:
                    yield batch.slice(start, at + i - start), held
                    held, size, start = [], 0, at + i
                held.append(t)
                size += len(t)
            if held:
                yield batch.slice(start, at + len(part) - start), held


def grouped(batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = CHUNK) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """As portions, but short slices of a partition are put together up to limit."""
    tables: list[pa.RecordBatch] = []
    texts: list[bytes] = []
    size = 0
    for rows, own in portions(batches, text, limit):
        more = sum(map(len, own))
        if texts and size + more > limit:
            yield pa.Table.from_batches(tables).combine_chunks().to_batches()[0], texts
            tables, texts, size = [], [], 0
        tables.append(rows)
        texts += own
        size += more
    if texts:
        yield pa.Table.from_batches(tables).combine_chunks().to_batches()[0], texts
    trim()


def trim() -> None:
    """Gives freed memory back, as a Python worker lives on and its executor's other workers need it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # another C library than glibc keeps it
        ctypes.CDLL(None).malloc_trim(0)
