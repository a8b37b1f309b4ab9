import base64
import hashlib
import zlib

import numpy as np
import pytest

from weirflow.llm import media, webp
from weirflow.llm.queries import QUERIES

from .helpers import corpus, frame


def payload(text):
    raw = (text or "").encode()
    return raw + b"\xff" * (576 if not raw else -len(raw) % 576)


def check(rows, texts):
    for r in rows:
        p = payload(texts[r["doc_id"]])
        assert r["n_bytes"] == len((texts[r["doc_id"]] or "").encode())
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))


def test_op7(spark, data):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    rows = QUERIES["op7_media"](spark, data).collect()
    assert len(rows) == len(texts)
    check(rows, texts)
    assert sum(r["media_bytes"] for r in rows) < 0.8 * sum(r["payload_bytes"] for r in rows)


def test_odd_texts_and_files(spark):
    rows = [*corpus(1, 20), (500, "\x00" * 576), (501, "a" * 575), (502, "\xff" * 300)]
    df = frame(spark, rows)
    stored = media.store(df)
    out = media.read(stored)
    found = out.collect()
    check(found, dict(rows))
    files = {r["doc_id"]: bytes(r["media"]) for r in stored.collect()}
    for r in found:
        assert r["media_sha256"] == hashlib.sha256(files[r["doc_id"]]).hexdigest() and r["media_bytes"] == len(files[r["doc_id"]])
        assert bytes(r["samples"]) == payload(dict(rows)[r["doc_id"]])
    by_text = {}
    for r in found:
        by_text.setdefault(dict(rows)[r["doc_id"]] or "", set()).add((r["media_sha256"], r["feature"]))
    assert all(len(x) == 1 for x in by_text.values())
    assert media.read(media.store(df.where("false"))).count() == 0
    nulls = spark.createDataFrame([(None, "x", 1), (None, "x", 1)], "doc_id long, text string, media int")
    assert media.read(media.store(nulls)).count() == 2


def test_payloads_over_one_picture():
    p = np.arange(576 * 3, dtype=np.uint8)
    old = webp.MAX_SIDE
    try:
        webp.MAX_SIDE = 2
        assert (media._pixels(media._stored(p)) == p).all()
    finally:
        webp.MAX_SIDE = old


# A small encoder of all features, for the decoder ---------------------------------------------------------------------------


def put_prefix(bits, codes, lengths, value, base=0):
    """A length or distance as prefix symbol and extra bits; with no writer, the symbol alone."""
    v = value - 1
    if v < 4:
        symbol, extra, n = v, 0, 0
    else:
        high = v.bit_length() - 1
        second = v >> high - 1 & 1
        symbol, n = 2 * high + second, high - 1
        extra = v & (1 << n) - 1
    if bits is not None:
        put(bits, codes, lengths, base + symbol)
        bits.write(extra, n)
    return base + symbol


def put(bits, codes, lengths, symbol):
    if np.count_nonzero(lengths) > 1:
        bits.write(int(codes[symbol]), int(lengths[symbol]))


def write_picture(bits, pixels, cache_bits=0, groups=None, width=0, main=False, ops=None):
    """ops: ('lit', pixel), ('cache', index) or ('copy', length, distance code value), by default a literal for each pixel.

    groups: (tile bits, array of group numbers) for the main picture.
    """
    ops = ops or [("lit", int(p)) for p in pixels]
    bits.write(1 if cache_bits else 0, 1)
    if cache_bits:
        bits.write(cache_bits, 4)
    n_groups = 1
    if main:
        bits.write(1 if groups else 0, 1)
        if groups:
            tile, which = groups
            bits.write(tile - 2, 3)
            write_picture(bits, (which.ravel().astype(np.uint32) << np.uint32(8)))
            n_groups = int(which.max()) + 1
    sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    counts = [[np.zeros(s, np.int64) for s in sizes] for _ in range(n_groups)]
    at, plan = 0, []
    for op in ops:
        g = int(groups[1][at // width >> groups[0], at % width >> groups[0]]) if groups else 0
        plan.append(g)
        if op[0] == "lit":
            p = op[1]
            for c, v in zip(counts[g], (p >> 8 & 255, p >> 16 & 255, p & 255, p >> 24), strict=False):
                c[v] += 1
            at += 1
        elif op[0] == "cache":
            counts[g][0][280 + op[1]] += 1
            at += 1
        else:
            counts[g][0][put_prefix(None, None, None, op[1], 256)] += 1
            counts[g][4][put_prefix(None, None, None, op[2])] += 1
            at += op[1]
    lengths = [[webp.huffman_lengths(c, 15) for c in cs] for cs in counts]
    for own in lengths:
        for j, x in enumerate(own):
            if np.count_nonzero(x) == 1 and np.flatnonzero(x)[0] > 255:
                x[0] = 1
            own[j] = x
            webp.write_code(bits, x)
    codes = [[webp.canonical(x) for x in own] for own in lengths]
    for op, g in zip(ops, plan, strict=True):
        c, n = codes[g], lengths[g]
        if op[0] == "lit":
            p = op[1]
            for j, v in enumerate((p >> 8 & 255, p >> 16 & 255, p & 255, p >> 24)):
                put(bits, c[j], n[j], v)
        elif op[0] == "cache":
            put(bits, c[0], n[0], 280 + op[1])
        else:
            put_prefix(bits, c[0], n[0], op[1], 256)
            put_prefix(bits, c[4], n[4], op[2])


@pytest.fixture()
def picture():
    rng = np.random.default_rng(4)
    y, x = np.mgrid[:23, :37]
    channels = np.stack([255 - (x // 9), x * 5 + y, y * 7 + x, (x * y) // 3 + rng.integers(0, 9, x.shape)]) & 255
    return webp._packed(channels.reshape(4, -1)), 37, 23


def test_a_file_of_another_encoder():
    known = base64.b64decode("UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA==")
    assert webp.decode(known).shape == (1, 1)


def test_literals_of_all_channels(picture):
    pixels, w, h = picture
    bits = webp.BitWriter()
    bits.write(0, 1)
    write_picture(bits, pixels, main=True)
    assert (webp.decode(webp.wrapped(bits, w, h)).ravel() == pixels).all()


def test_colour_cache_and_back_references(picture):
    _, w, h = picture
    rng = np.random.default_rng(5)
    ops, out, cache = [], [], [0] * 64
    place = lambda p: (0x1E35A7BD * p & 0xFFFFFFFF) >> 26
    while len(out) < w * h:
        kind, left = rng.integers(0, 4), w * h - len(out)
        if kind == 0 and len(out) > 2 * w:
            code = int(rng.choice([1, 2, 3, 5, 60, 120, 121, 130, 120 + len(out)]))
            if code > 120:
                d = code - 120
            else:
                dx, dy = webp._NEAR[code - 1]
                d = max(1, dx + dy * w)
            n = int(min(left, rng.choice([1, 3, 5, 40, 300])))
            if d > len(out):
                continue
            ops.append(("copy", n, code))
            for _ in range(n):
                out.append(out[-d])
                cache[place(out[-1])] = out[-1]
        elif kind == 1 and out and cache[place(out[int(rng.integers(len(out)))])]:
            p = out[int(rng.integers(len(out)))]
            if cache[place(p)] == 0:
                continue
            ops.append(("cache", place(p)))
            out.append(cache[place(p)])
        else:
            p = int(rng.integers(0, 1 << 32))
            ops.append(("lit", p))
            out.append(p)
            cache[place(p)] = p
    bits = webp.BitWriter()
    bits.write(0, 1)
    write_picture(bits, None, cache_bits=6, main=True, ops=ops)
    assert webp.decode(webp.wrapped(bits, w, h)).ravel().tolist() == out


def test_code_groups(picture):
    pixels, w, h = picture
    which = np.random.default_rng(1).integers(0, 3, (-(-h // 8), -(-w // 8)))
    which[0, 0] = 2
    bits = webp.BitWriter()
    bits.write(0, 1)
    write_picture(bits, pixels, groups=(3, which), width=w, main=True)
    assert (webp.decode(webp.wrapped(bits, w, h)).ravel() == pixels).all()


def test_predictor_cross_colour_and_green(picture):
    pixels, w, h = picture
    rng = np.random.default_rng(2)
    modes = rng.integers(0, 14, (-(-h // 4), -(-w // 4)))
    modes.ravel()[:14] = np.arange(14)
    factors = rng.integers(0, 1 << 24, (-(-h // 8), -(-w // 8)), dtype=np.uint32) | np.uint32(0xFF000000)
    rest = webp.predict(pixels, w, modes, 2, False)
    rest = webp.cross_colour(rest, w, factors, 3, False)
    rest = webp.subtract_green(rest, False)
    bits = webp.BitWriter()
    bits.write(1, 1), bits.write(0, 2), bits.write(0, 3)
    write_picture(bits, modes.ravel().astype(np.uint32) << np.uint32(8))
    bits.write(1, 1), bits.write(1, 2), bits.write(1, 3)
    write_picture(bits, factors.ravel())
    bits.write(1, 1), bits.write(2, 2), bits.write(0, 1)
    write_picture(bits, rest, main=True)
    assert (webp.decode(webp.wrapped(bits, w, h)).ravel() == pixels).all()


@pytest.mark.parametrize("colours", [1, 2, 3, 4, 7, 16, 17, 200])
def test_palettes(picture, colours):
    _, w, h = picture
    rng = np.random.default_rng(colours)
    palette = rng.integers(0, 1 << 32, colours, dtype=np.uint32)
    places = rng.integers(0, colours, (h, w))
    n = webp.bundle_bits(colours)
    each, wide = 8 >> n, (w + (1 << n) - 1) >> n
    padded = np.zeros((h, wide << n), np.int64)
    padded[:, :w] = places
    green = (padded.reshape(h, wide, 1 << n) << (np.arange(1 << n) * each)).sum(2).astype(np.uint32) << np.uint32(8)
    steps = webp._packed(np.diff(webp._channels(palette), axis=1, prepend=0))
    bits = webp.BitWriter()
    bits.write(1, 1), bits.write(3, 2), bits.write(colours - 1, 8)
    write_picture(bits, steps)
    bits.write(0, 1)
    write_picture(bits, green.ravel(), main=True)
    assert (webp.decode(webp.wrapped(bits, w, h)) == palette[places]).all()


@pytest.mark.parametrize("kind", ["one", "two", "fibonacci", "all"])
def test_samples_round_trip(kind):
    rng = np.random.default_rng(7)
    values = {"one": [9], "two": [0, 255], "fibonacci": None, "all": range(256)}[kind]
    if values is None:
        parts, a, b = [], 1, 1
        for i in range(22):
            parts.append(np.full(a, 10 + i))
            a, b = b, a + b
        samples = rng.permutation(np.concatenate(parts)).astype(np.uint8)
        samples = samples[: len(samples) // 576 * 576]
    else:
        samples = rng.choice(list(values), 576 * 4).astype(np.uint8)
    assert ((webp.decode(webp.encode_samples(samples, 576)).ravel() >> np.uint32(8)).astype(np.uint8) == samples).all()


def forms(data):
    """Which forms a file has: the transforms' kinds, and whether there are back-references."""
    bits = webp.BitReader(data[20:], 8)
    bits.read(32)
    kinds = []
    while bits.read(1):
        kinds.append(bits.read(2))
        if kinds[-1] == 3:
            size = bits.read(8) + 1
            webp.read_pixels(bits, size, 1, False)
        elif kinds[-1] < 2:
            tile = bits.read(3) + 2
            webp.read_pixels(bits, -(-576 >> tile), 1, False)
    bits.read(2)
    green = webp.read_code(bits, 280)
    return kinds, green.top > 255


@pytest.mark.parametrize(("kind", "want"), [("noise", ([], False)), ("text", ([], True)), ("few", ([3], False)), ("two", ([3], False)), ("slope", ([0], False)), ("columns", ([0], None)), ("one", ([], False)), ("line", ([], True))])
def test_the_encoder_takes_what_is_smallest(kind, want):
    """Each form is chosen for pictures that suit it, and all are read back as they were."""
    rng = np.random.default_rng(11)
    rows = np.arange(8)[:, None]
    words = [bytes(rng.integers(97, 123, rng.integers(2, 12)).astype(np.uint8)) for _ in range(60)]
    samples = {
        "noise": rng.integers(0, 256, 576 * 8), "text": np.frombuffer(b" ".join(words[i] for i in rng.integers(0, 60, 2000))[: 576 * 8], np.uint8),
        "few": rng.choice([3, 99, 100, 255], 576 * 8, p=[0.4, 0.3, 0.2, 0.1]), "two": (rng.random(576 * 8) < 0.1) * 200, "slope": np.cumsum(rng.integers(0, 3, (8, 576)), axis=1).ravel(),
        "columns": (rng.integers(0, 256, 576)[None, :] + rows * 3 + rng.integers(0, 2, (8, 576))).ravel(), "one": np.full(576, 255), "line": np.tile(rng.integers(0, 256, 100), 60)[: 576 * 8],
    }[kind].astype(np.uint8)
    data = webp.encode_samples(samples, 576)
    assert ((webp.decode(data).ravel() >> np.uint32(8)).astype(np.uint8) == samples).all()
    kinds, copies = forms(data)
    assert kinds == want[0] and want[1] in (None, copies)


@pytest.mark.parametrize("mode", [webp.LEFT, webp.UP])
def test_predictors_by_rows_equal_those_by_pixels(picture, mode):
    pixels, w, h = picture
    modes = np.full((1, 1), mode)
    rest = webp.predict(pixels, w, modes, 9, False)
    mixed = np.full((-(-h // 4), -(-w // 4)), mode)
    mixed[-1, -1] = 3 - mode  # another mode somewhere: pixel by pixel
    own = webp.predict(pixels, w, mixed, 2, False)
    inside = (np.arange(h)[:, None] >> 2 < mixed.shape[0] - 1) | (np.arange(w)[None, :] >> 2 < mixed.shape[1] - 1)
    assert (rest.reshape(h, w) == own.reshape(h, w))[inside].all()
    assert (webp.predict(rest, w, modes, 9, True) == pixels).all()


@pytest.mark.parametrize("far", [1, 7, 8, 100, 576, 5000])
def test_back_references_of_any_distance(far):
    rng = np.random.default_rng(far)
    samples = rng.integers(0, 256, 576 * 20).astype(np.uint8)
    for at in range(far + 3000, len(samples) - 2000, 2500):
        for i in range(at, at + 700):
            samples[i] = samples[i - far]
    place, size, back = webp.matches(samples)
    for a, n, d in zip(place.tolist(), size.tolist(), back.tolist(), strict=True):
        assert all(samples[i] == samples[i - d] for i in range(a, a + n))
    assert (np.diff(place) >= size[:-1]).all() and len(place) >= 1
    assert ((webp.decode(webp.encode_samples(samples, 576)).ravel() >> np.uint32(8)).astype(np.uint8) == samples).all()


def test_broken_files():
    with pytest.raises(ValueError):
        webp.decode(b"RIFF0000WEBPVP8 " + b"\0" * 20)
