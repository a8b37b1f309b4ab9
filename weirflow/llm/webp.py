"""Lossless WebP (VP8L) in numpy and plain Python: a full decoder, and an encoder for pictures of one channel.

Decoding covers prefix codes (simple and normal), back-references with the two-dimensional short distances, the colour
cache, several code groups by tile, and the inverse predictor, cross-colour, subtract-green and palette transforms. A
picture is an array of 32-bit ARGB pixels. Where only the green channel and distances take bits, and there is no cache, the
symbol, the run and the length of what begins at every bit position come from array lookups; the chain of positions is
followed, literals are put in place at once and back-references copied one by one.

The encoder takes 8-bit samples as the green channel. It weighs the palette (several samples to a pixel), the left and the
upper predictor, and back-references, by the entropy of what is left, and writes the smallest. Where samples are one
channel, a cache place costs what a literal does and there is nothing to take from red or blue: it writes neither.
"""

from __future__ import annotations

import math
import struct

import numpy as np

from . import ragged as rg

MAX_SIDE = 1 << 14
_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
_HASH = 0x1E35A7BD
#: Fixed values of the format: offsets (columns, rows) of the 120 shortest distance codes, in the order of their numbers.
_NEAR = [
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
    (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
    (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
]


class BitReader:
    def __init__(self, data: bytes, pos: int = 0):
        self.data, self.pos = data + b"\0" * 8, pos

    def read(self, n: int) -> int:
        at, self.pos = self.pos, self.pos + n
        return int.from_bytes(self.data[at >> 3 : (at >> 3) + 8], "little") >> (at & 7) & (1 << n) - 1


class BitWriter:
    def __init__(self) -> None:
        self.value, self.pos = 0, 0

    def write(self, value: int, n: int) -> None:
        self.value |= value << self.pos
        self.pos += n

    def write_all(self, values: np.ndarray, counts: np.ndarray) -> None:
        """Fields of 16 bits at most, one after another."""
        at = np.zeros(len(counts) + 1, np.int64)
        np.cumsum(counts, out=at[1:])
        at += self.pos & 7
        # Each field lies in at most three bytes; sums can't carry, as no two share a bit.
        place = at[:-1] >> 3
        wide = values.astype(np.uint64) << (at[:-1] & 7).astype(np.uint64)
        out = np.zeros((int(at[-1]) >> 3) + 4, np.int64)
        for i in range(3):
            out += np.bincount(place + i, (wide >> np.uint64(8 * i) & np.uint64(255)).astype(float), len(out)).astype(np.int64)
        self.value |= int.from_bytes(out.astype(np.uint8).tobytes(), "little") << (self.pos - (self.pos & 7))
        self.pos += int(at[-1]) - (self.pos & 7)


# Prefix codes ------------------------------------------------------------------------------------------------------


#: Numbers of 15 bits with their bits in reverse.
_BACKWARDS = sum((np.arange(1 << 15) >> i & 1) << (14 - i) for i in range(15))


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Code of each symbol as it stands in the stream, first bit lowest."""
    codes, used = np.zeros(len(lengths), np.int64), np.flatnonzero(lengths)
    order = used[np.argsort(lengths[used], kind="stable")]
    n = lengths[order]
    # Codes count up within a length; as fractions of one they follow each other.
    steps = np.int64(1) << (15 - n)
    code = np.cumsum(steps) - steps
    codes[order] = _BACKWARDS[code]
    return codes


class PrefixCode:
    """Lookup by the next bits: symbol and code length; a code of one symbol takes no bit."""

    def __init__(self, lengths: np.ndarray | None = None, only: int | None = None):
        if only is None:
            used = np.flatnonzero(lengths)
            only = int(used[0]) if len(used) == 1 else None
        self.only, self.bits = only, 0
        if only is not None:
            self.top = only
            return
        self.top = int(used[-1]) if len(used) else 0
        if not len(used) or int((1 << 15 - lengths[used]).sum()) != 1 << 15:
            raise ValueError("not a complete prefix code")
        self.bits = int(lengths[used].max())
        self.symbol, self.length = np.zeros(1 << self.bits, np.int32), np.zeros(1 << self.bits, np.int8)
        order = used[np.argsort(lengths[used], kind="stable")]
        n = lengths[order]
        # In the order of their codes, symbols fill the table one after another; a place is read with its first bit lowest.
        places = _BACKWARDS[: 1 << self.bits] if self.bits == 15 else _BACKWARDS[np.arange(1 << self.bits) << (15 - self.bits)]
        self.symbol[places] = np.repeat(order, 1 << (self.bits - n))
        self.length[places] = np.repeat(n, 1 << (self.bits - n))

    def read(self, bits: BitReader) -> int:
        if self.only is not None:
            return self.only
        at = bits.pos
        key = int.from_bytes(bits.data[at >> 3 : (at >> 3) + 4], "little") >> (at & 7) & (1 << self.bits) - 1
        bits.pos += int(self.length[key])
        return int(self.symbol[key])


def read_code(bits: BitReader, size: int) -> PrefixCode:
    lengths = np.zeros(size, np.int64)
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        first = bits.read(8 if wide else 1)
        if not two:
            return PrefixCode(only=first)
        lengths[[first, bits.read(8)]] = 1
        return PrefixCode(lengths)
    meta = np.zeros(19, np.int64)
    for i in range(4 + bits.read(4)):
        meta[_ORDER[i]] = bits.read(3)
    code, left = PrefixCode(meta), size
    if bits.read(1):
        n = 2 + 2 * bits.read(3)
        left = 2 + bits.read(n)
    at, last = 0, 8
    while at < size and left:
        left -= 1
        s = code.read(bits)
        if s < 16:
            lengths[at] = s
            last, at = s or last, at + 1
        else:
            least, width = ((3, 2), (3, 3), (11, 7))[s - 16]
            n = least + bits.read(width)
            lengths[at : at + n] = last if s == 16 else 0
            at += n
    return PrefixCode(lengths)


def huffman_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Lengths of a prefix code for the counts, of limit bits at most."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.int64)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    order = np.argsort(counts[used], kind="stable")
    floor, n = 1, len(used)
    while True:
        # Two queues, leaves and joined nodes, each in order of their counts.
        weight = np.maximum(counts[used[order]], floor).tolist()
        parent, leaf, node = [0] * (2 * n - 1), 0, n
        for new in range(n, 2 * n - 1):
            total = 0
            for _ in (0, 1):
                if leaf < n and (node >= new or weight[leaf] <= weight[node]):
                    pick, leaf = leaf, leaf + 1
                else:
                    pick, node = node, node + 1
                parent[pick] = new
                total += weight[pick]
            weight.append(total)
        depth = [0] * (2 * n - 1)
        for i in range(2 * n - 3, -1, -1):
            depth[i] = depth[parent[i]] + 1
        lengths[used[order]] = depth[:n]
        if max(depth[:n]) <= limit:
            return lengths
        floor = max(2 * floor, int(counts.sum()) >> limit)


def write_only(bits: BitWriter, symbol: int) -> None:
    """The code of one symbol under 256, which takes no bits."""
    bits.write(0b101 | symbol << 3, 11)


def write_code(bits: BitWriter, lengths: np.ndarray) -> None:
    used = np.flatnonzero(lengths)
    if len(used) <= 1:
        s = int(used[0]) if len(used) else 0
        if s > 255:  # no simple code holds it: a second symbol fills a code of one bit
            lengths = lengths.copy()
            lengths[[0, s]] = 1
        else:
            write_only(bits, s)
            return
    bits.write(0, 1)
    out: list[tuple[int, int, int]] = []
    at, ends = 0, (np.flatnonzero(lengths[1:] != lengths[:-1]) + 1).tolist()
    every = lengths.tolist()
    for end in [*ends, len(lengths)]:
        n, value = end - at, every[at]
        at = end
        if value:
            out += [(value, 0, 0)] * n
            continue
        while n >= 11:
            out.append((18, min(n, 138) - 11, 7))
            n -= min(n, 138)
        if n >= 3:
            out.append((17, n - 3, 3))
        else:
            out += [(0, 0, 0)] * n
    meta = huffman_lengths(np.bincount([s for s, _, _ in out], minlength=19), 7)
    last = max(i for i in range(19) if meta[_ORDER[i]])
    n = max(4, last + 1)
    bits.write(n - 4, 4)
    for i in range(n):
        bits.write(int(meta[_ORDER[i]]), 3)
    bits.write(0, 1)
    codes, sizes = canonical(meta).tolist(), (meta if np.count_nonzero(meta) > 1 else meta * 0).tolist()
    value = at = 0
    for s, extra, width in out:
        value |= (codes[s] & (1 << sizes[s]) - 1) << at
        at += sizes[s]
        value |= extra << at
        at += width
    bits.write(value, at)


# Entropy-coded pixels ----------------------------------------------------------------------------------------------


def _one_channel(bits: BitReader, code: PrefixCode, distance: PrefixCode, n: int, width: int) -> np.ndarray:
    """n green samples: what begins at every bit position, then the chain from the first one."""
    if code.only is not None and code.only < 256:
        return np.full(n, code.only, np.uint32)
    first = bits.pos >> 3
    raw = np.frombuffer(bits.data, np.uint8)[first : first + (n * (code.bits + (70 if code.top > 255 else 0)) >> 3) + 16]
    wide = raw[:-3].astype(np.uint32)
    for i in range(1, 4):
        wide |= raw[i : len(raw) - 3 + i].astype(np.uint32) << np.uint32(8 * i)
    at = bits.pos & 7
    mask = np.uint32((1 << code.bits) - 1)
    if code.only is None:
        # A literal's step is the length of its code; that of a copy's length code stands 16 higher.
        table = np.where(code.symbol >= 256, code.length + 16, code.length)
        step_at = table[(wide[:, None] >> np.arange(8, dtype=np.uint32) & mask).ravel()]
    else:
        step_at = np.full(8 * len(wide), 16, np.int8)

    def symbols(places: np.ndarray) -> np.ndarray:
        return code.symbol[wide[places >> 3] >> (places & 7).astype(np.uint32) & mask]

    steps, copies, left, data = step_at.tolist(), [], n, bits.data
    only, far = distance.only, (1 << distance.bits) - 1
    places: list[int] = []
    put = places.append
    while left > 0:
        before = len(places)
        for _ in range(left):
            step = steps[at]
            if step > 15:
                break
            put(at)
            at += step
        else:
            left = 0
            break
        left -= len(places) - before
        place = (first << 3) + at
        ahead = int.from_bytes(data[place >> 3 : (place >> 3) + 4], "little") >> (place & 7)
        prefix = (code.only if code.only is not None else int(code.symbol[ahead & (1 << code.bits) - 1])) - 256
        at += step - 16
        place = (first << 3) + at
        ahead = int.from_bytes(data[place >> 3 : (place >> 3) + 9], "little") >> (place & 7)
        size, used = _valued(prefix, ahead)
        ahead >>= used
        if only is None:
            prefix, used = int(distance.symbol[ahead & far]), used + int(distance.length[ahead & far])
            ahead >>= int(distance.length[ahead & far])
        else:
            prefix = only
        back, more = _valued(prefix, ahead)
        copies.append((n - left, size, back))
        left -= size
        at += used + more
    if left:
        raise ValueError("a back-reference leaves the picture")
    bits.pos = (first << 3) + at
    kept, out = np.ones(n, bool), np.zeros(n, np.uint32)
    for to, size, _ in copies:
        kept[to : to + size] = False
    if places:
        out[kept] = symbols(np.array(places))
    for to, size, d in copies:
        if d > 120:
            d -= 120
        else:
            x, y = _NEAR[d - 1]
            d = max(1, x + y * width)
        if d > to:
            raise ValueError("a back-reference leaves the picture")
        if d >= size:
            out[to : to + size] = out[to - d : to - d + size]
        else:
            out[to : to + size] = np.resize(out[to - d : to], size)
    return out


def _valued(prefix: int, ahead: int) -> tuple[int, int]:
    """The length or distance of a prefix symbol and the extra bits that follow, and how many of them it took."""
    if prefix < 4:
        return prefix + 1, 0
    extra = prefix - 2 >> 1
    return (2 + (prefix & 1) << extra) + (ahead & (1 << extra) - 1) + 1, extra


def _long(bits: BitReader, prefix: int) -> int:
    return _valued(prefix, bits.read(0 if prefix < 4 else prefix - 2 >> 1))[0]


def read_pixels(bits: BitReader, width: int, height: int, main: bool) -> np.ndarray:
    """One entropy-coded picture: width * height pixels."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    tile, groups, which = 0, 1, None
    if main and bits.read(1):
        tile = bits.read(3) + 2
        wide = (width + (1 << tile) - 1) >> tile
        picture = read_pixels(bits, wide, (height + (1 << tile) - 1) >> tile, False)
        which = (picture >> np.uint32(8) & np.uint32(0xFFFF)).astype(int).reshape(-1, wide)
        groups = int(which.max()) + 1
    sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    codes = [[read_code(bits, s) for s in sizes] for _ in range(groups)]
    n = width * height
    green, red, blue, alpha, distance = codes[0]
    if groups == 1 and not cache_bits and None not in (red.only, blue.only, alpha.only):
        return _one_channel(bits, green, distance, n, width) << np.uint32(8) | np.uint32(alpha.only << 24 | red.only << 16 | blue.only)
    out, cache, at, fresh = [0] * n, [0] * (1 << cache_bits), 0, 0
    while at < n:
        if which is not None:
            green, red, blue, alpha, distance = codes[which[at // width >> tile, at % width >> tile]]
        s = green.read(bits)
        if s < 256:
            r, b, a = red.read(bits), blue.read(bits), alpha.read(bits)
            out[at] = a << 24 | r << 16 | s << 8 | b
            at += 1
        elif s < 280:
            length, d = _long(bits, s - 256), _long(bits, distance.read(bits))
            if d > 120:
                d -= 120
            else:
                x, y = _NEAR[d - 1]
                d = max(1, x + y * width)
            if d > at or length > n - at:
                raise ValueError("a back-reference leaves the picture")
            for _ in range(length):
                out[at] = out[at - d]
                at += 1
        else:
            for p in out[fresh:at]:
                cache[(_HASH * p & 0xFFFFFFFF) >> 32 - cache_bits] = p
            fresh = at
            out[at] = cache[s - 280]
            at += 1
    return np.array(out, np.uint32)


# Transforms --------------------------------------------------------------------------------------------------------


def _channels(pixels: np.ndarray) -> np.ndarray:
    return np.stack([pixels >> np.uint32(s) & np.uint32(255) for s in (24, 16, 8, 0)]).astype(np.int64)


def _packed(channels: np.ndarray) -> np.ndarray:
    a, r, g, b = (channels & 255).astype(np.uint32)
    return a << np.uint32(24) | r << np.uint32(16) | g << np.uint32(8) | b


def _average(a: tuple, b: tuple) -> tuple:
    return tuple(x + y >> 1 for x, y in zip(a, b, strict=True))


def _clamped(x: int) -> int:
    return 0 if x < 0 else 255 if x > 255 else x


def _half(a: int, b: int) -> int:
    d = a - b
    return _clamped(a + (d // 2 if d >= 0 else -(-d // 2)))


def _select(left: tuple, top: tuple, corner: tuple) -> tuple:
    to_left = sum(abs(t - c) for t, c in zip(top, corner, strict=True))
    to_top = sum(abs(x - c) for x, c in zip(left, corner, strict=True))
    return left if to_left < to_top else top


_MODES = (
    lambda l, t, r, c: (255, 0, 0, 0),  # noqa: E741
    lambda l, t, r, c: l,  # noqa: E741
    lambda l, t, r, c: t,  # noqa: E741
    lambda l, t, r, c: r,  # noqa: E741
    lambda l, t, r, c: c,  # noqa: E741
    lambda l, t, r, c: _average(_average(l, r), t),  # noqa: E741
    lambda l, t, r, c: _average(l, c),  # noqa: E741
    lambda l, t, r, c: _average(l, t),  # noqa: E741
    lambda l, t, r, c: _average(c, t),  # noqa: E741
    lambda l, t, r, c: _average(t, r),  # noqa: E741
    lambda l, t, r, c: _average(_average(l, c), _average(t, r)),  # noqa: E741
    lambda l, t, r, c: _select(l, t, c),  # noqa: E741
    lambda l, t, r, c: tuple(_clamped(x + y - z) for x, y, z in zip(l, t, c, strict=True)),  # noqa: E741
    lambda l, t, r, c: tuple(_half(m, z) for m, z in zip(_average(l, t), c, strict=True)),  # noqa: E741
)


LEFT, UP = 1, 2


def _predict_by_rows(pixels: np.ndarray, width: int, mode: int, invert: bool) -> np.ndarray:
    """predict() for the left or the upper pixel all over: sums, or differences, along rows and down the first column (or
    down columns and along the first row)."""
    rows = _channels(pixels).reshape(4, -1, width)
    along = 2 if mode == LEFT else 1
    edge = (slice(None), slice(None), 0) if mode == LEFT else (slice(None), 0, slice(None))
    if invert:
        rows[0, 0, 0] += 255
        rows[edge] = np.cumsum(rows[edge], axis=1)
        return _packed(np.cumsum(rows, axis=along).reshape(4, -1))
    out = np.diff(rows, axis=along, prepend=0)
    out[edge] = np.diff(rows[edge], axis=1, prepend=0)
    out[0, 0, 0] -= 255
    return _packed(out.reshape(4, -1))


def predict(pixels: np.ndarray, width: int, modes: np.ndarray, tile: int, invert: bool) -> np.ndarray:
    """Residuals to pixels (invert) or pixels to residuals; modes holds one predictor for each tile."""
    if modes.min() == modes.max() in (LEFT, UP):
        return _predict_by_rows(pixels, width, int(modes.flat[0]), invert)
    own = [tuple(p) for p in _channels(pixels).T.tolist()]
    known = [(0, 0, 0, 0)] * len(own) if invert else own
    out = []
    for i, p in enumerate(own):
        y, x = divmod(i, width)
        if not i:
            guess = (255, 0, 0, 0)
        elif not y:
            guess = known[i - 1]
        elif not x:
            guess = known[i - width]
        else:
            guess = _MODES[modes[y >> tile, x >> tile]](known[i - 1], known[i - width], known[i - width + 1], known[i - width - 1])
        if invert:
            known[i] = tuple(v + g & 255 for v, g in zip(p, guess, strict=True))
        else:
            out.append(tuple(v - g & 255 for v, g in zip(p, guess, strict=True)))
    return _packed(np.array(known if invert else out, np.int64).T)


def _signed(x: np.ndarray) -> np.ndarray:
    return (x & 255 ^ 128) - 128


def cross_colour(pixels: np.ndarray, width: int, factors: np.ndarray, tile: int, invert: bool) -> np.ndarray:
    """Adds (invert) or takes off what green and red predict; factors is one pixel (red to blue, green to blue, green to red) for each tile."""
    a, r, g, b = _channels(pixels)
    y, x = np.divmod(np.arange(len(pixels)), width)
    _, rb, gb, gr = _channels(factors[y >> tile, x >> tile])
    part = lambda f, c: _signed(f) * _signed(c) >> 5
    if invert:
        r = r + part(gr, g) & 255
        b = b + part(gb, g) + part(rb, r) & 255
    else:
        b = b - part(gb, g) - part(rb, r) & 255
        r = r - part(gr, g) & 255
    return _packed(np.stack([a, r, g, b]))


def subtract_green(pixels: np.ndarray, invert: bool) -> np.ndarray:
    a, r, g, b = _channels(pixels)
    sign = 1 if invert else -1
    return _packed(np.stack([a, r + sign * g, g, b + sign * g]))


def bundle_bits(colours: int) -> int:
    """How many bits of the width a palette of so many colours saves."""
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def unbundle(pixels: np.ndarray, width: int, palette: np.ndarray) -> np.ndarray:
    """Palette places in the green channel, several to a pixel for small palettes, to colours."""
    bits, green = bundle_bits(len(palette)), pixels >> np.uint32(8) & np.uint32(255)
    if bits:
        each = 8 >> bits
        rows = green.reshape(-1, (width + (1 << bits) - 1) >> bits)
        parts = rows[:, :, None] >> (np.arange(1 << bits, dtype=np.uint32) * np.uint32(each)) & np.uint32((1 << each) - 1)
        green = parts.reshape(len(rows), -1)[:, :width].ravel()
    full = np.zeros(256, np.uint32)
    full[: len(palette)] = palette
    return full[green]


def _steps(palette: np.ndarray) -> np.ndarray:
    """A stored palette holds differences, channel by channel."""
    return _packed(np.cumsum(_channels(palette), axis=1))


# Files -------------------------------------------------------------------------------------------------------------


def decode(data: bytes) -> np.ndarray:
    """The ARGB pixels of one lossless file, (height, width)."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L" or data[20] != 0x2F:
        raise ValueError("not a lossless WebP file")
    bits = BitReader(data[20 : 20 + struct.unpack("<I", data[16:20])[0]], 8)
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("another version")
    undo, inner = [], width
    while bits.read(1):
        kind = bits.read(2)
        if kind < 2:
            tile = bits.read(3) + 2
            wide = (inner + (1 << tile) - 1) >> tile
            picture = read_pixels(bits, wide, (height + (1 << tile) - 1) >> tile, False).reshape(-1, wide)
            undo.append((cross_colour, inner, picture, tile) if kind else (predict, inner, (picture >> np.uint32(8) & np.uint32(15)).astype(int), tile))
        elif kind == 2:
            undo.append((subtract_green,))
        else:
            size = bits.read(8) + 1
            undo.append((unbundle, inner, _steps(read_pixels(bits, size, 1, False))))
            inner = (inner + (1 << bundle_bits(size)) - 1) >> bundle_bits(size)
    pixels = read_pixels(bits, inner, height, True)
    for step, *given in reversed(undo):
        pixels = step(pixels, *given) if step is unbundle else step(pixels, *given, True)
    return pixels.reshape(height, width)


def wrapped(bits: BitWriter, width: int, height: int) -> bytes:
    """The file around a stream written after the header."""
    head = (width - 1) | (height - 1) << 14 | 1 << 28
    body = b"\x2f" + struct.pack("<I", head) + bits.value.to_bytes((bits.pos + 7) // 8, "little")
    return b"RIFF" + struct.pack("<I", 12 + len(body) + len(body) % 2) + b"WEBPVP8L" + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


SHORTEST, FARTHEST, LONGEST = 8, 1 << 14, 4096
#: The share of a picture's bits that back-references must save: copies take longer to write and to read than literals.
WORTH = 1 / 8


def matches(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, length, distance) of back-references, in order and apart: repeats of eight samples or more of what came before,
    found by sorting the eights."""
    none = (np.zeros(0, np.int64),) * 3
    n = len(samples) - SHORTEST + 1
    if n < 2:
        return none
    eight = rg.eights(samples)[:n]
    # Places in the order of a hash of their eight, equal ones in order; what only looks equal is looked at.
    order = (np.sort(eight * np.uint64(_HASH << 32 | 1) >> np.uint64(40) << np.uint64(40) | np.arange(n, dtype=np.uint64)) & np.uint64((1 << 40) - 1)).astype(np.int64)
    same = eight[order]
    same = np.flatnonzero(same[1:] == same[:-1])
    if not len(same):
        return none
    distance = np.zeros(n + 1, np.int64)
    distance[order[same + 1]] = order[same + 1] - order[same]
    distance[distance > FARTHEST] = 0
    begins = np.r_[0, np.flatnonzero(distance[1:] != distance[:-1]) + 1]
    ends = np.r_[begins[1:], n + 1]
    some = distance[begins] > 0
    out, last = [], 0
    for a, b, d in zip(begins[some].tolist(), (ends[some] + SHORTEST - 1).tolist(), distance[begins[some]].tolist(), strict=True):
        a = max(a, last)
        while b - a >= SHORTEST:
            size = min(b - a, LONGEST)
            out.append((a, size, d))
            a += size
            last = a
    return tuple(np.array(out, np.int64).reshape(-1, 3).T)


def _prefixes(top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(prefix symbol, extra bits, their number) of lengths and distances up to top."""
    v = np.arange(-1, top)
    high = np.frexp(np.maximum(v, 1).astype(float))[1].astype(np.int64) - 1
    count = np.where(v < 4, 0, np.maximum(high - 1, 0))
    return np.where(v < 4, v, 2 * high + (v >> np.maximum(high - 1, 0) & 1)), v & (1 << count) - 1, count


_PREFIX, _EXTRA, _WIDTH = _prefixes(FARTHEST + 120)


#: c * log2(c) of small counts.
_CLOG = np.arange(1 << 16) * np.log2(np.maximum(np.arange(1 << 16), 1))


def _entropy(counts: np.ndarray, n: int) -> float:
    """Bits of n symbols of these counts under a prefix code, nearly: one bit each at least, unless they are all the same."""
    most = int(counts.max(initial=0))
    if most == n:
        return 0.0
    parts = _CLOG[counts] if most < len(_CLOG) else counts * np.log2(np.maximum(counts, 1))
    return max(float(n), n * math.log2(n) - float(parts.sum()))


class _Plan:
    """How a one-channel picture would be written: literals and back-references, and the bits they are likely to take."""

    def __init__(self, samples: np.ndarray):
        literal = np.bincount(samples, minlength=280)
        self.samples, self.green, self.distance, self.copies = samples, literal, np.zeros(40, np.int64), None
        self.bits = _entropy(literal, len(samples))
        place, size, back = matches(samples)
        if not len(place):
            return
        edges = np.zeros(len(samples) + 1, np.int8)
        edges[place] = 1
        edges[place + size] -= 1
        kept = np.cumsum(edges[:-1], dtype=np.int8) == 0
        back = back + 120
        length, far = (_PREFIX[size], _EXTRA[size], _WIDTH[size]), (_PREFIX[back], _EXTRA[back], _WIDTH[back])
        green, distance = np.bincount(samples[kept], minlength=280), np.bincount(far[0], minlength=40)
        literals = len(samples) - int(size.sum())
        green[256:] += np.bincount(length[0], minlength=24)
        bits = _entropy(green, literals + len(size)) + _entropy(distance, len(size)) + float(length[2].sum() + far[2].sum()) + 5 * np.count_nonzero(distance) + 60
        if bits < self.bits * (1 - WORTH):
            self.bits, self.green, self.distance, self.copies = bits, green, distance, (place, kept, length, far)

    def write(self, bits: BitWriter, alpha: int) -> None:
        """Codes and symbols; no cache, one group."""
        green, distance = huffman_lengths(self.green, 15), huffman_lengths(self.distance, 15)
        if np.count_nonzero(green) == 1 and green[256:].any():
            green[0] = 1
        write_code(bits, green)
        for constant in (0, 0, alpha):  # red, blue, alpha cost nothing
            write_only(bits, constant)
        write_code(bits, distance)
        codes, sizes = [canonical(x) if np.count_nonzero(x) > 1 else np.zeros(len(x), np.int64) for x in (green, distance)], []
        for x in (green, distance):
            sizes.append(x if np.count_nonzero(x) > 1 else np.zeros(len(x), np.int64))
        if self.copies is None:
            bits.write_all(codes[0][self.samples], sizes[0][self.samples])
            return
        place, kept, length, far = self.copies
        literals = np.flatnonzero(kept)
        values = [codes[0][self.samples[literals]], codes[0][256 + length[0]], length[1], codes[1][far[0]], far[1]]
        counts = [sizes[0][self.samples[literals]], sizes[0][256 + length[0]], length[2], sizes[1][far[0]], far[2]]
        order = np.argsort(np.concatenate([8 * literals, *(8 * place + i for i in range(4))]), kind="stable")
        bits.write_all(np.concatenate(values)[order], np.concatenate(counts)[order])


def encode_samples(samples: np.ndarray, width: int) -> bytes:
    """8-bit samples as the green channel of a picture, in the smallest of the forms that are weighed."""
    height, bits = len(samples) // width, BitWriter()
    best = _Plan(samples)
    colours, kind, inner = np.flatnonzero(np.bincount(samples, minlength=256)), None, width
    if 1 < len(colours) <= 16:
        saved = bundle_bits(len(colours))
        wide, each = (width + (1 << saved) - 1) >> saved, 8 >> saved
        places = np.zeros((height, wide << saved), np.uint8)
        places[:, :width] = np.searchsorted(colours, samples).reshape(height, width)
        bundled = _Plan((places.reshape(height, wide, -1) << (np.arange(1 << saved, dtype=np.uint8) * np.uint8(each))).sum(2).astype(np.uint8).ravel())
        if bundled.bits + 60 + 12 * len(colours) < best.bits:
            best, kind, inner = bundled, "palette", wide
    for mode in (LEFT, UP):
        step = 1 if mode == LEFT else width
        if len(samples) > step and _entropy(np.bincount(samples[step:] - samples[:-step], minlength=256), len(samples) - step) + 70 < best.bits:
            rest = (_predict_by_rows(samples.astype(np.uint32) << np.uint32(8), width, mode, False) >> np.uint32(8) & np.uint32(255)).astype(np.uint8)
            predicted = _Plan(rest)
            if predicted.bits + 70 < best.bits:
                best, kind, inner = predicted, mode, width
    if kind == "palette":
        bits.write(1, 1), bits.write(3, 2), bits.write(len(colours) - 1, 8)
        steps = _Plan(np.diff(colours, prepend=0).astype(np.uint8))
        bits.write(0, 1)
        steps.write(bits, 0)  # samples are green alone: their alpha is of no use, and one value costs no bit
    elif kind is not None:
        bits.write(1, 1), bits.write(0, 2), bits.write(7, 3)  # one mode for tiles of 512
        bits.write(0, 1)
        tiles = -(-width >> 9) * -(-height >> 9)
        _Plan(np.full(tiles, kind, np.uint8)).write(bits, 255)
    bits.write(0, 3)  # no more transforms, no colour cache, one code group
    best.write(bits, 0 if kind in (LEFT, UP) else 255)
    return wrapped(bits, width, height)
