"""Ragged text in numpy: Arrow string columns as flat UTF-8 bytes, words as spans, hashes of words and of runs of words.

Nothing here works row by row. A block of rows is one byte array with row offsets; a word is a pair of byte positions. Words
are hashed eight bytes at a time and runs by doubling, with a mixing step at each joint: there is no polynomial whose
structure a text could meet. Blocks are bounded by bytes, so memory follows the longest single text, not the batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Rows are taken in blocks of about so many bytes of text.
BLOCK_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


class Lane:
    """One family of 64-bit hashes; families of different seeds are independent."""

    #: Longer words are hashed by blake2b, one by one.
    LONG = 64

    def __init__(self, seed: int):
        rng = np.random.Generator(np.random.Philox(seed))
        self.a, self.b, self.c = (rng.integers(1, 1 << 63, 3, dtype=U64) << U64(1) | U64(1)).tolist()
        self.key = seed.to_bytes(8, "little")

    def join(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return mix(x * U64(self.a) + y * U64(self.b))

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The hash of each span data[starts:ends]."""
        sizes = ends - starts
        out, live, eight = mix(sizes.astype(U64) * U64(self.a) + U64(self.c)), np.flatnonzero(sizes <= self.LONG), eights(data)
        for k in range(0, self.LONG, 8):
            live = live[sizes[live] > k]
            if not len(live):
                break
            part = eight[starts[live] + k] & KEPT[np.minimum(sizes[live] - k, 8)]
            out[live] = mix((out[live] ^ part) * U64(self.b) + U64(self.c))
        for i in np.flatnonzero(sizes > self.LONG).tolist():
            out[i] = int.from_bytes(self.digest(data[starts[i] : ends[i]], 8), "little")
        return out

    def digest(self, values: np.ndarray, size: int = 16) -> bytes:
        """Strong digest of an array."""
        return hashlib.blake2b(values.tobytes(), digest_size=size, key=self.key).digest()

    def runs(self, hashes: np.ndarray, k: int) -> np.ndarray:
        """The hash of hashes[i : i + k] for every i up to len(hashes) - k, by doubling."""
        n, part, width, out, have = len(hashes), hashes, 1, None, 0
        while True:
            if k & width:
                out = part if out is None else self.join(out[: n - have - width + 1], part[have : n - width + 1])
                have += width
                if have == k:
                    return out[: n - k + 1]
            part = self.join(part[: n - 2 * width + 1], part[width:])
            width *= 2


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as a little-endian number; zeros follow the end."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray(len(data) + 1, np.dtype("<u8"), padded, 0, (1,))


#: Masks of the first n bytes of eight.
KEPT = np.array([(1 << 8 * n) - 1 for n in range(9)], U64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values (the finaliser of splitmix64)."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


LANE_A, LANE_B = Lane(11), Lane(23)


def blocks(column: pa.Array | pa.ChunkedArray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows holding about limit bytes; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, side="right")) - 1)
        end = min(end, n)
        yield at, end, raw[offs[at] : offs[end]], offs[at : end + 1] - offs[at]
        at = end


def ascii_lower(data: np.ndarray) -> np.ndarray:
    return data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)


def words(data: np.ndarray, offs: np.ndarray, apart: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words between separators (U+0020 and U+0009..U+000D): byte starts, byte ends, and word offsets by row."""
    n = len(data)
    inside = ~apart[data]
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    first = offs[:-1][offs[:-1] < n]
    before[first] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    last = offs[1:] - 1
    after[last[(last >= 0) & (offs[1:] > offs[:-1])]] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs).astype(np.int64)


def row_of(word_offs: np.ndarray) -> np.ndarray:
    """The row of each word."""
    return np.repeat(np.arange(len(word_offs) - 1), np.diff(word_offs))


def windows(lane: Lane, hashes: np.ndarray, word_offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of every run of k consecutive words of one row."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    ends = np.repeat(word_offs[1:], np.diff(word_offs))
    first = np.flatnonzero(np.arange(n) + k <= ends)
    return first, lane.runs(hashes, k)[first]


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of x[i : i + w] for every i up to len(x) - w, by doubling."""
    have, out = 1, x
    while have * 2 <= w:
        out = np.minimum(out[: len(out) - have], out[have:])
        have *= 2
    rest = w - have
    return out if not rest else np.minimum(out[: len(out) - rest], out[rest:])


def covered(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Mask of n places that lie in any starts[i] : starts[i] + length."""
    delta = np.zeros(n + 1, np.int32)
    np.add.at(delta, starts, 1)
    np.add.at(delta, starts + length, -1)
    return np.cumsum(delta[:-1]) > 0


def flat_lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column with counts[i] of the values in row i."""
    offs = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offs[1:])
    return pa.ListArray.from_arrays(pa.array(offs), pa.array(values, kind))
