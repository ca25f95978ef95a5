import base64
import hashlib
import random
import zlib

import numpy as np
import pytest

from ledgerloom.llm import webp
from ledgerloom.llm.webp import Writer, code_lengths, decode_image, decode_stream, load, media, media_digests, put_code, riff, store
from tests.llm.helpers import LONG, clashing, docs, rows


def lossless(pixels, transforms=(), cache_bits=0, references=(), size=None, groups=None):
    """A plain encoder for the tests. ``pixels``: (h, w, 4) ARGB. references: {position: (length, distance code)}."""
    w = Writer()
    h, wide = pixels.shape[:2]
    w.put(webp.SIGNATURE, 8)
    w.put(wide - 1, 14)
    w.put(h - 1, 14)
    w.put(1, 1)
    w.put(0, 3)
    samples = pixels.reshape(-1, 4).astype(np.uint8)
    for kind, *more in transforms:
        w.put(1, 1)
        w.put(kind, 2)
        if kind == webp.PREDICTOR:
            block, modes = more
            w.put(block - 2, 3)
            image(w, np.array([m << 8 | 255 << 24 for m in modes], np.int64), 0, {}, wide)
            samples = webp.walk_predictor(samples, wide, h, block, modes, True)
        elif kind == webp.CROSS_COLOUR:
            block, elements = more
            w.put(block - 2, 3)
            image(w, np.array(elements, np.int64), 0, {}, wide)
            samples = webp.cross_colour(samples, wide, h, block, np.array(elements, np.uint32), True)
        elif kind == webp.SUBTRACT_GREEN:
            samples = samples.copy()
            samples[:, 1] -= samples[:, 2]
            samples[:, 3] -= samples[:, 2]
        else:
            colours, where = np.unique(webp.joined(samples), return_inverse=True)
            n = len(colours)
            w.put(n - 1, 8)
            deltas = webp.channels(colours.astype(np.uint32)).astype(np.int64)
            deltas[1:] -= webp.channels(colours.astype(np.uint32)).astype(np.int64)[:-1]
            image(w, webp.joined(deltas & 255).astype(np.int64), 0, {}, n)
            pack = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            bits = 8 >> pack
            grid = where.reshape(h, wide)
            grid = np.pad(grid, ((0, 0), (0, -wide % (1 << pack))))
            green = sum(grid[:, i :: 1 << pack] << (bits * i) for i in range(1 << pack))
            wide = green.shape[1]
            samples = np.zeros((green.size, 4), np.uint8)
            samples[:, 0], samples[:, 2] = 255, green.ravel()
    w.put(0, 1)
    image(w, webp.joined(samples).astype(np.int64), cache_bits, dict(references), wide, True, groups)
    return w.bytes()


def image(w, argb, cache_bits, references, width, main=False, groups=None):
    w.put(int(cache_bits > 0), 1)
    if cache_bits:
        w.put(cache_bits, 4)
    if main:
        w.put(int(groups is not None), 1)
        if groups is not None:
            block, kinds = groups
            w.put(block - 2, 3)
            image(w, np.array([k << 8 | 255 << 24 for k in kinds], np.int64), 0, {}, -(-width >> block))
    tokens, cache, i = [], {}, 0
    while i < len(argb):
        p = int(argb[i])
        slot = (webp.CACHE_FACTOR * p & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else 0
        if i in references:
            n, code = references[i]
            tokens.append((i, "copy", n, code))
            for q in argb[i : i + n].tolist():
                if cache_bits:
                    cache[(webp.CACHE_FACTOR * q & 0xFFFFFFFF) >> (32 - cache_bits)] = q
            i += n
            continue
        if cache_bits and cache.get(slot) == p:
            tokens.append((i, "cache", slot, 0))
        else:
            tokens.append((i, "pixel", p, 0))
            cache[slot] = p
        i += 1
    across = -(-width >> groups[0]) if groups else 0
    group = lambda at: groups[1][(at // width >> groups[0]) * across + (at % width >> groups[0])] if groups else 0
    count = max(groups[1]) + 1 if groups else 1
    sizes = [webp.GREEN_SYMBOLS + (1 << cache_bits if cache_bits else 0), 256, 256, 256, webp.DISTANCE_SYMBOLS]
    counts = [[[0] * s for s in sizes] for _ in range(count)]

    def prefix(value):
        if value <= 4:
            return value - 1, 0, 0
        value -= 1
        top = value.bit_length() - 1
        second = value >> (top - 1) & 1
        return 2 * top + second, top - 1, value & ((1 << (top - 1)) - 1)

    plan = []
    for at, kind, a, b in tokens:
        g = counts[group(at)]
        if kind == "pixel":
            parts = [(0, a >> 8 & 255), (1, a >> 16 & 255), (2, a & 255), (3, a >> 24 & 255)]
            extra = []
        elif kind == "cache":
            parts, extra = [(0, webp.GREEN_SYMBOLS + a)], []
        else:
            s, bits, rest = prefix(a)
            t, bits2, rest2 = prefix(b)
            parts, extra = [(0, 256 + s), (4, t)], [(rest, bits), (rest2, bits2)]
        for c, s in parts:
            g[c][s] += 1
        plan.append((group(at), parts, extra))
    tables = []
    for g in counts:
        row = []
        for c in g:
            lengths = code_lengths(c, 12)
            put_code(w, lengths)
            one = sum(n > 0 for n in lengths) < 2
            order, codes = webp.canonical(np.array(lengths)) if any(lengths) else ([], [])
            row.append((dict(zip([int(x) for x in order], [int(x) for x in codes], strict=True)), lengths, one))
        tables.append(row)
    for g, parts, extra in plan:
        for k, (c, s) in enumerate(parts):
            codes, lengths, one = tables[g][c]
            if not one:
                w.put(codes[s] & ((1 << lengths[s]) - 1), lengths[s])
            if extra:
                w.put(*extra[k])


def picture(seed, h=24, w=20, colours=None):
    r = np.random.default_rng(seed)
    if colours:
        table = r.integers(0, 256, (colours, 4))
        return table[r.integers(0, colours, (h, w))].astype(np.uint8)
    base = np.add.outer(np.arange(h) * 3, np.arange(w) * 2)[..., None] + r.integers(0, 9, (h, w, 4))
    return (base % 256).astype(np.uint8)


@pytest.mark.parametrize("mode", range(14))
def test_each_predictor(mode):
    p = picture(mode)
    assert (decode_stream(lossless(p, [(webp.PREDICTOR, 2, [mode] * 30)])) == p).all()


@pytest.mark.parametrize("colours", [1, 2, 3, 4, 7, 16, 17, 200])
def test_palettes(colours):
    p = picture(colours, 9, 13, colours)
    assert (decode_stream(lossless(p, [(webp.PALETTE,)])) == p).all()


def test_all_transforms_together():
    p = picture(5)
    r = random.Random(3)
    elements = [255 << 24 | r.getrandbits(24) for _ in range(30)]
    got = decode_stream(lossless(p, [(webp.PREDICTOR, 2, [r.randrange(14) for _ in range(30)]), (webp.CROSS_COLOUR, 2, elements), (webp.SUBTRACT_GREEN,)]))
    assert (got == p).all()


@pytest.mark.parametrize("cache_bits", [1, 4, 11])
def test_colour_cache(cache_bits):
    p = picture(7, 20, 20, 12)
    assert (decode_stream(lossless(p, cache_bits=cache_bits)) == p).all()


def test_back_references_and_groups():
    p = picture(8, 16, 16)
    flat = p.reshape(-1, 4)
    flat[40:90] = flat[20]  # a run: distance one
    for i in range(100, 140):
        flat[i] = flat[i - 16]
    refs = {41: (49, 120 + 1), 101: (39, 1)}  # by distance, and by place: one row above
    for bits in (0, 5):
        assert (decode_stream(lossless(p, references=refs, cache_bits=bits)) == p).all()
        assert (decode_stream(lossless(p, references=refs, cache_bits=bits, groups=(2, [i % 3 for i in range(16)]))) == p).all()


def test_payloads_round_trip():
    r = random.Random(2)
    for n in (64, 128, 4096, webp.IMAGE_BYTES, webp.IMAGE_BYTES + 64):
        for payload in (bytes(n), r.randbytes(n), bytes(r.choices(b"etaoin shr", k=n))):
            assert load(store(payload)) == payload


FOREIGN = {  # written by the format's own library
    "UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA==": [[[0, 0, 0, 0]]],
    "UklGRh4AAABXRUJQVlA4TBEAAAAvAQAAAAfQ//73v/+BiOh/AAA=": [[[255, 255, 255, 255], [255, 255, 255, 255]]],
}


@pytest.mark.parametrize("data", sorted(FOREIGN))
def test_foreign_files(data):
    assert decode_image(base64.b64decode(data))[0].tolist() == FOREIGN[data]


def samples_of(kind, n, r):
    words = [bytes(r.choices(b"etaoinshrdlu", k=r.randrange(2, 9))) for _ in range(40)]
    text = b" ".join(r.choice(words) for _ in range(n))[:n]
    steady = bytes((i // 3 + i % 64 * 2) % 256 for i in range(n))
    columns = bytes((i % 64 * 37 + i // 64) % 256 for i in range(n))
    return {"text": text, "ramp": steady, "columns": columns, "few": bytes(r.choices(b"0123456789", k=n)), "two": bytes(r.choices(b"ab", k=n)), "one": b"z" * n, "noise": r.randbytes(n), "copies": (text[:700] * n)[:n]}[kind]


@pytest.mark.parametrize("kind", ["text", "ramp", "columns", "few", "two", "one", "noise", "copies"])
def test_what_the_writer_uses(kind, monkeypatch):
    """Media use transforms and references, and reading pixel by pixel gives what reading by arrays gives."""
    r, asked = random.Random(4), []
    green = webp.read_green

    def slowly(reader, width, height, code):
        at = reader.at
        fast = green(reader, width, height, code)
        end, reader.at = reader.at, at
        slow, copies = [], 0
        while len(slow) < width * height:
            s = code[0].read(reader)
            if s < 256:
                slow.append(code[3].single << 24 | code[1].single << 16 | s << 8 | code[2].single)
                continue
            copies += 1
            length = webp.count_and_bits(s - 256, reader)
            far = webp.count_and_bits(code[4].read(reader), reader)
            far = far - 120 if far > 120 else max(1, webp.DISTANCES[far - 1][0] + webp.DISTANCES[far - 1][1] * width)
            for _ in range(length):
                slow.append(slow[-far])
        assert reader.at == end and slow == fast.tolist()
        asked.append(copies)
        return fast

    monkeypatch.setattr(webp, "read_green", slowly)
    for n in (64, 640, 6400):
        payload = samples_of(kind, n, r)
        assert load(store(payload)) == payload
    assert any(asked) or kind in ("few", "two", "noise")
    whole = samples_of("text", 20_000 // 64 * 64, r)
    assert len(store(whole)) < 0.6 * len(whole)


def test_references_outside_of_the_image_raise():
    p = np.zeros((4, 16, 4), np.uint8)
    p[..., 0], p[..., 2] = 255, np.arange(64).reshape(4, 16)
    for refs in ({3: (4, 120 + 9)}, {0: (2, 1)}):
        with pytest.raises(ValueError, match="outside"):
            decode_stream(lossless(p, references=refs))
    assert (decode_stream(lossless(p)) == p).all()


def test_odd_keys(spark):
    given = spark.createDataFrame([(None, "a"), (None, "a"), (3, None)], "doc_id long, text string")
    got = media_digests(media(given)).collect()
    assert sorted(str(r["doc_id"]) for r in got) == ["3", "None", "None"] and len({r["media_sha256"] for r in got}) == 2


def test_codes_are_limited_in_length():
    fib = [1, 1]
    while len(fib) < 40:
        fib.append(fib[-1] + fib[-2])
    lengths = code_lengths(fib, 12)
    assert max(lengths) <= 12 and sum(2.0**-n for n in lengths) == 1


def test_bad_bytes_raise():
    good = store(b"hello world " * 16)
    for bad in (b"", good[:-9], b"RIFX" + good[4:], good[:20] + b"\0" + good[21:]):
        with pytest.raises(ValueError):
            decode_image(bad)
    assert riff(b"abc")[-4:] == b"abc\0"


def test_table(spark):
    got = {}
    for r in media_digests(media(clashing(docs(spark)))).collect():
        got.setdefault(r["doc_id"], []).append(r)
    for r in docs(spark).collect():
        raw = (r["text"] or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        for g in got[r["doc_id"]]:
            assert g["n_bytes"] == len(raw) and g["payload_bytes"] == len(payload)
            assert g["payload_sha256"] == hashlib.sha256(payload).hexdigest() and g["tail_crc32"] == zlib.crc32(payload[-64:])
            assert g["media_sha256"] == hashlib.sha256(store(payload)).hexdigest() and g["media_bytes"] == len(store(payload))
    assert got[1][0]["media_sha256"] == got[5][0]["media_sha256"] and got[2][0]["feature"] == got[3][0]["feature"]
    assert got[4][0]["n_bytes"] == len(LONG.encode())
    assert rows(media_digests(media(docs(spark, [])))) == []
