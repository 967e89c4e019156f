"""Words and rolling hashes of whole texts, vectorised over Arrow buffers.

A word is a run of bytes other than 0x20 and 0x09-0x0D. All functions work on
slices of a record batch, so memory is bounded by a slice or one long text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Words of more bytes than this are hashed one by one.
LONG_WORD = 64
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64 for i up to n."""
    if "up" not in _powers or _powers["up"].size <= n:
        size = max(n + 1, SLICE_BYTES + 1)
        for name, base in (("up", BASE), ("down", BASE_INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[name] = np.cumprod(p, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def slices(batch: pa.RecordBatch, column: str, most: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of rows of a string column; null counts as empty."""
    most = most or SLICE_BYTES
    col = pc.fill_null(batch.column(column).cast(pa.large_string()), "")
    if not len(col):
        return
    offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(col):
        end = int(np.searchsorted(offs, offs[row] + most, "right")) - 1
        end = min(len(col), max(end, row + 1))
        yield row, end, data[offs[row] : offs[end]], offs[row : end + 1] - offs[row]
        row = end


class Words:
    """starts, ends: bytes of each word; first: each text's first word, with the total last."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        self.data, self.offs, n = data, offs, data.size
        space = SPACE[data]
        cut = np.zeros(n + 1, bool)
        cut[offs] = True
        word = ~space
        begin, finish = word.copy(), word.copy()
        if n:
            begin[1:] &= space[:-1] | cut[1:n]
            finish[:-1] &= space[1:] | cut[1:n]
        self.starts, self.ends = np.flatnonzero(begin), np.flatnonzero(finish) + 1
        self.first = np.searchsorted(self.starts, offs)

    def __len__(self) -> int:
        return self.starts.size

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of each word's bytes; other seeds give independent ones.

        Eight bytes at a time are mixed in, by a function that is not linear, so that no
        two words of a known form collide whatever the seed; long words go through BLAKE2b.
        """
        padded = np.zeros(self.data.size // 8 * 8 + 16, np.uint8)
        padded[: self.data.size] = self.data
        eights, lengths = padded.view("<u8"), self.ends - self.starts
        out = mix(lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed * 0xD1B54A32D192ED03 + 1 & (1 << 64) - 1))
        todo, at, left = slice(None), self.starts, np.where(lengths <= LONG_WORD, lengths, 0)
        for _ in range(0, LONG_WORD, 8):
            if not left.all():  # words that have ended
                ongoing = np.flatnonzero(left)
                todo, at, left = ongoing if isinstance(todo, slice) else todo[ongoing], at[ongoing], left[ongoing]
            if not left.size:
                break
            # the eight bytes from any place lie in two aligned eights; those past the word's end are shifted out
            shift, place = (at & 7).astype(np.uint64) << np.uint64(3), at >> 3
            bytes8 = eights[place] >> shift | eights[place + 1] << (np.uint64(63) - shift) << np.uint64(1)
            bytes8 = bytes8 << (np.maximum(8 - left, 0).astype(np.uint64) << np.uint64(3))
            out[todo] = mix(out[todo] + bytes8 * np.uint64(0x9FB21C651E98DF25))
            at, left = at + 8, np.maximum(left - 8, 0)
        for i in np.flatnonzero(lengths > LONG_WORD):
            word = self.data[self.starts[i] : self.ends[i]].tobytes()
            out[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8, salt=bytes([seed])).digest(), "little")
        return out

    def windows(self, hashes: np.ndarray, k: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all k consecutive words that lie in one text, and each window's first word."""
        if len(self) < k:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        n, multiplier = len(self) - k + 1, np.uint64((0xD6E8FEB86659FD93 + 2 * salt * 0x2545F4914F6CDD1D) & (1 << 64) - 1 | 1)
        out = np.zeros(n, np.uint64)
        for j in range(k):
            out = out * multiplier + hashes[j : j + n]
        last = np.repeat(self.first[1:], self.counts())
        at = np.flatnonzero(np.arange(n) + k <= last[:n])
        return mix(out[at] + np.uint64(k)), at

    def joined(self, data: np.ndarray, first: int, end: int, keep: np.ndarray | None = None) -> bytes:
        """The words from first to end joined by one space; keep: which of them."""
        at = np.arange(first, end) if keep is None else np.arange(first, end)[keep]
        if not at.size:
            return b""
        lengths = self.ends[at] - self.starts[at] + 1
        stop = np.cumsum(lengths)
        take = np.arange(stop[-1]) + np.repeat(self.starts[at] - (stop - lengths), lengths)
        out = data[np.minimum(take, data.size - 1)].copy()
        out[stop - 1] = 0x20
        return out[:-1].tobytes()


def long_list(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    """Consecutive values as a list<long> array with these sizes."""
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values.view(np.int64), pa.int64()))


def rows_of(batch: pa.RecordBatch, names: list[str], first: int, end: int) -> list[pa.Array]:
    return [batch.column(n).slice(first, end - first) for n in names]
