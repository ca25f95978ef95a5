"""Media columns: byte payloads stored as lossless WebP images, and a decoder of that format.

``decode_image`` reads any lossless image: prefix codes (simple and normal, one group or many),
back-references, colour cache, and the predictor, cross-colour, subtract-green and palette
transforms. A stream of one group of codes without a cache in which only the green samples vary is decoded for all
bit positions at once with arrays, its back-references too; anything else pixel by pixel.

``media`` stores text: its UTF-8 bytes, zero-padded to a positive multiple of 64, are the samples of grey
images 64 pixels wide. The cross-colour transform takes green out of red and blue, which leaves them zero; a
predictor (left, or top) goes first where it makes the samples' entropy smaller; images of at most 16 colours are palettes,
several pixels to one; and repeats of ``GRAM`` bytes or more become back-references. (A colour cache pays
only where other samples than green vary, so no image of ``media`` has one; the decoder reads it.) A payload of more than
``IMAGE_BYTES`` becomes several images, one file after the other, so that memory is bounded for texts of any length.

Results for odd input: null text is empty text, whose payload is 64 zero bytes; equal texts give
equal media; null and repeated keys are rows like others; an empty table gives no rows; other columns of
the input are not looked at, whatever their names. Truncated or foreign bytes raise ValueError.
"""

from __future__ import annotations

import functools
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import text_slices

#: Pixels of an image's row, and bytes of payload in an image at most.
WIDTH, IMAGE_BYTES = 64, 1 << 18
#: Shortest repeat that becomes a back-reference, longest one of a single reference, most colours of a palette.
GRAM, LONGEST_COPY, FEW_COLOURS = 8, 4096, 16
#: Bits of a sample's place in an image.
PLACE_BITS = IMAGE_BYTES.bit_length()
#: How much green the cross-colour transform takes out of red and blue, in 32nds: all of it.
ALL_GREEN = 32

# Fixed values of the lossless WebP format.
CODE_LENGTH_ORDER = [17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15]
DISTANCES = [
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2),
    (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0),
    (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4),
    (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3),
    (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4),
    (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7),
    (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
]
SIGNATURE, CACHE_FACTOR = 0x2F, 0x1E35A7BD
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
GREEN_SYMBOLS, DISTANCE_SYMBOLS, LONGEST_CODE = 256 + 24, 40, 15


# ---------------------------------------------------------------- prefix codes


def code_lengths(counts: list[int], longest: int) -> list[int]:
    """Huffman code lengths of at most ``longest`` bits; rare symbols' counts are raised until they fit."""
    used = [s for s, n in enumerate(counts) if n]
    lengths = [0] * len(counts)
    if len(used) < 2:
        for s in used:
            lengths[s] = 1
        return lengths
    floor = 1
    while True:
        # Leaves by weight, and inner nodes, whose weights rise by themselves: the two lightest are at the fronts.
        leaves = sorted((max(counts[s], floor), s) for s in used)
        weights, parent, inner, i, k = [n for n, _ in leaves], [0] * (2 * len(leaves) - 1), [], 0, 0
        for node in range(len(leaves), 2 * len(leaves) - 1):
            total = 0
            for _ in range(2):
                if k == len(inner) or i < len(leaves) and weights[i] <= inner[k]:
                    total, parent[i], i = total + weights[i], node, i + 1
                else:
                    total, parent[len(leaves) + k], k = total + inner[k], node, k + 1
            inner.append(total)
        depth = [0] * len(parent)
        for x in range(len(parent) - 2, -1, -1):
            depth[x] = depth[parent[x]] + 1
        if max(depth) <= longest:
            for (_, s), n in zip(leaves, depth, strict=False):
                lengths[s] = n
            return lengths
        floor = 2 * floor


def canonical(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols in the order of their codes, the codes' first bits as they stand in the stream)."""
    order = np.flatnonzero(lengths)
    order = order[np.argsort(lengths[order], kind="stable")]
    size = lengths[order].astype(np.int64)
    starts = np.concatenate(([0], np.cumsum(1 << (LONGEST_CODE - size))))
    if len(order) > 1 and starts[-1] != 1 << LONGEST_CODE:
        raise ValueError("prefix code is not complete")
    return order, REVERSED[starts[:-1]]


def reversed_bits(n: int) -> np.ndarray:
    """The n bits of each number below 2 ** n in reverse order."""
    x, out = np.arange(1 << n), np.zeros(1 << n, np.int64)
    for i in range(n):
        out |= (x >> i & 1) << (n - 1 - i)
    return out


REVERSED = reversed_bits(LONGEST_CODE)
backwards = functools.cache(reversed_bits)


class Code:
    """A prefix code: ``table`` has (symbol << 4 | length) for every value of the next ``bits`` bits."""

    def __init__(self, lengths: np.ndarray):
        order, _ = canonical(lengths)
        self._list: list[int] | None = None
        if len(order) < 2:
            self.only(int(order[0]) if len(order) else 0)
            return
        size = lengths[order]
        self.single, self.bits = None, int(size[-1])
        self.table = np.repeat((order << 4 | size).astype(np.int32), 1 << (self.bits - size))[backwards(self.bits)]

    def only(self, symbol: int) -> Code:
        """The code of one symbol, which takes no bits."""
        self.single, self.bits, self.table, self._list = symbol, 0, np.array([symbol << 4], np.int32), [symbol << 4]
        return self

    def read(self, r: Reader) -> int:
        if self._list is None:
            self._list = self.table.tolist()
        x = self._list[r.peek(self.bits)]
        r.skip(x & 15)
        return x >> 4


class Reader:
    """Bits of a byte string, the lowest first."""

    def __init__(self, data: bytes):
        self.data, self.at, self.end = data, 0, 8 * len(data)

    def peek(self, n: int) -> int:
        at = self.at >> 3
        return int.from_bytes(self.data[at : at + 5], "little") >> (self.at & 7) & ((1 << n) - 1)

    def skip(self, n: int) -> None:
        self.at += n
        if self.at > self.end:
            raise ValueError("image data ends early")

    def read(self, n: int) -> int:
        x = self.peek(n)
        self.skip(n)
        return x


class Writer:
    """Bits to a byte string, the lowest first."""

    def __init__(self):
        self.value = self.size = 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.size
        self.size += n

    def bytes(self) -> bytes:
        return self.value.to_bytes((self.size + 7) // 8, "little")


def read_code(r: Reader, alphabet: int) -> Code:
    if r.read(1):
        two, wide = r.read(1), r.read(1)
        found = [r.read(8 if wide else 1)] + ([r.read(8)] if two else [])
        if max(found) >= alphabet:
            raise ValueError("symbol outside of the alphabet")
        if len(set(found)) == 1:
            return Code.__new__(Code).only(found[0])
        lengths = np.zeros(alphabet, np.int64)
        lengths[found] = 1
        return Code(lengths)
    own = np.zeros(19, np.int64)
    for i in range(4 + r.read(4)):
        own[CODE_LENGTH_ORDER[i]] = r.read(3)
    code = Code(own)
    left = 2 + r.read(2 + 2 * r.read(3)) if r.read(1) else alphabet
    lengths: list[int] = []
    last, used, table, mask = 8, 0, code.table.tolist(), (1 << code.bits) - 1
    ahead = int.from_bytes(r.data[r.at >> 3 : (r.at >> 3) + 2 * alphabet + 2], "little") >> (r.at & 7)
    while len(lengths) < alphabet and left:
        left -= 1
        x = table[ahead & mask]
        n, x = x & 15, x >> 4
        ahead >>= n
        used += n
        if x < 16:
            lengths.append(x)
            last = x or last
            continue
        extra = 2 if x == 16 else 3 if x == 17 else 7
        lengths += [last if x == 16 else 0] * ((11 if x == 18 else 3) + (ahead & ((1 << extra) - 1)))
        ahead >>= extra
        used += extra
    r.skip(used)
    lengths += [0] * (alphabet - len(lengths))
    if len(lengths) > alphabet:
        raise ValueError("code lengths outside of the alphabet")
    return Code(np.array(lengths, np.int64))


def put_code(w: Writer, lengths: list[int]) -> None:
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) < 2 and max(used, default=0) < 256:
        s = used[0] if used else 0
        w.put(1, 1)
        w.put(0, 1)
        w.put(int(s > 1), 1)
        w.put(s, 8 if s > 1 else 1)
        return
    # All 16 kinds of length that are used here (0 to 12 and the three runs) get codes of 4 bits.
    w.put(0, 1)
    w.put(15, 4)
    for s in CODE_LENGTH_ORDER:
        w.put(4 if s in KINDS else 0, 3)
    w.put(0, 1)
    value = size = zeros = 0
    for n in [*lengths, 1]:
        if not n:
            zeros += 1
            continue
        while zeros:
            if zeros < 3:
                value, size, run = value | NIBBLE[0] << size, size + 4, 1
            elif zeros < 11:
                value, size, run = value | (NIBBLE[17] | zeros - 3 << 4) << size, size + 7, zeros
            else:
                run = min(zeros, 138)
                value, size = value | (NIBBLE[18] | run - 11 << 4) << size, size + 11
            zeros -= run
        value |= NIBBLE[n] << size
        size += 4
    w.put(value & ((1 << size - 4) - 1), size - 4)  # without the mark of the end


KINDS = [*range(13), 16, 17, 18]
NIBBLE = {kind: int(f"{i:04b}"[::-1], 2) for i, kind in enumerate(KINDS)}


# ---------------------------------------------------------------- decoding


def count_and_bits(symbol: int, r: Reader) -> int:
    """The value of a length or distance prefix symbol, with its extra bits."""
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + r.read(extra) + 1


def read_pixels(r: Reader, width: int, height: int, main: bool) -> np.ndarray:
    """An entropy-coded image: ARGB numbers in row order."""
    cache_bits = 0
    if r.read(1):
        cache_bits = r.read(4)
        if not 1 <= cache_bits <= 11:
            raise ValueError("size of the colour cache")
    block, groups, kinds = 0, None, 1
    if main and r.read(1):
        block = r.read(3) + 2
        across = -(-width >> block)
        groups = (read_pixels(r, across, -(-height >> block), False) >> 8 & 0xFFFF).tolist()
        kinds = max(groups) + 1
    sizes = (GREEN_SYMBOLS + (1 << cache_bits if cache_bits else 0), 256, 256, 256, DISTANCE_SYMBOLS)
    codes = [[read_code(r, n) for n in sizes] for _ in range(kinds)]
    if kinds == 1 and not cache_bits and all(c.single is not None for c in codes[0][1:4]):
        return read_green(r, width, height, codes[0])
    cache = [0] * (1 << cache_bits)
    out: list[int] = []
    total = width * height
    cached = 0
    while len(out) < total:
        n = len(out)
        code = codes[groups[(n // width >> block) * across + (n % width >> block)] if groups else 0]
        s = code[0].read(r)
        if s < 256:
            red = code[1].read(r)
            blue = code[2].read(r)
            out.append(code[3].read(r) << 24 | red << 16 | s << 8 | blue)
        elif s < GREEN_SYMBOLS:
            length = count_and_bits(s - 256, r)
            far = count_and_bits(code[4].read(r), r)
            if far > len(DISTANCES):
                far -= len(DISTANCES)
            else:
                dx, dy = DISTANCES[far - 1]
                far = max(1, dx + dy * width)
            if far > n or n + length > total:
                raise ValueError("back-reference outside of the image")
            while length:
                part = out[n - far : n - far + min(far, length)]
                out += part
                length -= len(part)
                n += len(part)
        else:
            while cached < n:
                cache[(CACHE_FACTOR * out[cached] & 0xFFFFFFFF) >> (32 - cache_bits)] = out[cached]
                cached += 1
            out.append(cache[s - GREEN_SYMBOLS])
    return np.array(out, np.uint32)


def prefix_parts(symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """(least value, extra bits) of each length or distance prefix symbol."""
    s = np.arange(symbols, dtype=np.int32)
    extra = np.where(s < 4, 0, (s - 2) >> 1)
    return np.where(s < 4, s + 1, ((2 + (s & 1)) << extra) + 1).astype(np.int32), extra.astype(np.int32)


@functools.lru_cache(64)
def nearby(width: int) -> np.ndarray:
    """The distances, in pixels, of the first prefix values."""
    return np.array([max(1, dx + dy * width) for dx, dy in DISTANCES], np.int64)


EIGHT = np.arange(8)
LEAST, EXTRA = prefix_parts(DISTANCE_SYMBOLS)


def read_green(r: Reader, width: int, height: int, code: list[Code]) -> np.ndarray:
    """Pixels of which only green varies, back-references included.

    A code's length and symbol are looked up at every bit position, for a copy its distance's as well; following
    the lengths eight codes at a time, then four, two and one, gives the positions at which codes really start.
    Copied pixels then find their sources by pointer doubling.
    """
    green, fixed, total = code[0], code[3].single << 24 | code[1].single << 16 | code[2].single, width * height
    if green.single is not None:
        if green.single > 255:
            raise ValueError("back-reference outside of the image")
        return np.full(total, fixed | green.single << 8, np.uint32)
    first = r.at >> 3
    most = green.bits + 14 + code[4].bits + 18  # of a token, so that much at most is looked at
    data = np.frombuffer(r.data, np.uint8, offset=first)[: (total * most + 7) // 8 + 1].astype(np.uint32)
    ends = np.zeros(len(data) + 3, np.uint32)
    ends[: len(data)] = data
    wide = ends[:-3] | ends[1:-2] << np.uint32(8) | ends[2:-1] << np.uint32(16) | ends[3:] << np.uint32(24)
    at_bit = (wide.astype(np.int64)[:, None] >> EIGHT).ravel()  # 25 bits from each position on
    found = green.table.take(at_bit & ((1 << green.bits) - 1))
    bits = len(found)
    copies = np.flatnonzero(found > 255 << 4 | 15)
    step = np.arange(bits + 1)
    step[:-1] += found & 15
    if len(copies):
        distance = code[4]
        behind = np.minimum(step[copies] + EXTRA[(found[copies] >> 4) - 256], bits - 1)
        far = distance.table.take(at_bit[behind] & ((1 << distance.bits) - 1))
        step[copies] = behind + (far & 15) + EXTRA[far >> 4]
    np.minimum(step[:-1], bits, out=step[:-1])
    step[-1] = bits
    steps = [step]
    for _ in range(3):
        steps.append(steps[-1].take(steps[-1]))
    at, starts, jump = r.at & 7, [], memoryview(steps[3])
    for _ in range(-(-total // 8)):
        if at >= bits:
            break
        starts.append(at)
        at = jump[at]
    where = np.array(starts, np.int64)
    for s in (steps[2], steps[1], steps[0]):
        where = np.stack((where, s.take(where)), axis=1).ravel()
    where = where[where < bits]
    token = found.take(where)
    size, token = token & 15, token >> 4
    if not len(copies):
        where, token = where[:total], token[:total]
        if len(where) < total or 8 * first + int(step[where[-1]]) > r.end:
            raise ValueError("image data ends early")
        r.at = 8 * first + int(step[where[-1]])
        return token.astype(np.uint32) << np.uint32(8) | np.uint32(fixed)
    copy = np.flatnonzero(token > 255)
    length = np.ones(len(token), np.int64)
    own = where[copy] + size[copy]
    extra = EXTRA[token[copy] - 256]
    length[copy] = LEAST[token[copy] - 256] + (at_bit[np.minimum(own, bits - 1)] & ((1 << extra.astype(np.int64)) - 1))
    after = np.cumsum(length)
    n = int(np.searchsorted(after, total)) + 1
    if n > len(token) or 8 * first + int(step[where[n - 1]]) > r.end:
        raise ValueError("image data ends early")
    if after[n - 1] != total:
        raise ValueError("back-reference outside of the image")
    r.at = 8 * first + int(step[where[n - 1]])
    copy = copy[copy < n]
    behind = np.minimum(own[: len(copy)] + extra[: len(copy)], bits - 1)
    far = code[4].table.take(at_bit[behind] & ((1 << code[4].bits) - 1))
    more = EXTRA[far >> 4].astype(np.int64)
    rest = np.minimum(behind + (far & 15), bits - 1)
    value = LEAST[far >> 4] + ((at_bit[rest]) & ((1 << more) - 1))
    value = np.where(value > len(DISTANCES), value - len(DISTANCES), nearby(width)[np.minimum(value, len(DISTANCES)) - 1])
    back = np.zeros(n, np.int64)
    back[copy] = value
    owner = np.repeat(np.arange(n), length[:n])
    source = np.arange(total) - back.take(owner)
    if source.min() < 0 or (back[copy] > after[copy] - length[copy]).any():
        raise ValueError("back-reference outside of the image")
    while True:
        further = source.take(source)
        if (further == source).all():
            break
        source = further
    return token.take(owner.take(source)).astype(np.uint32) << np.uint32(8) | np.uint32(fixed)


def channels(pixels: np.ndarray) -> np.ndarray:
    """(n, 4) bytes: alpha, red, green, blue."""
    return pixels.astype(">u4").view(np.uint8).reshape(-1, 4)


def joined(samples: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(samples.astype(np.uint8)).view(">u4").ravel().astype(np.uint32)


def predicted(mode: int, left: list[int], top: list[int], top_right: list[int], top_left: list[int]) -> list[int]:
    """A pixel's prediction from its neighbours, each four samples."""
    mean = lambda a, b: [(x + y) >> 1 for x, y in zip(a, b, strict=True)]
    clamp = lambda x: 0 if x < 0 else 255 if x > 255 else x
    if mode == 1:
        return left
    if mode == 2:
        return top
    if mode == 3:
        return top_right
    if mode == 4:
        return top_left
    if mode == 5:
        return mean(mean(left, top_right), top)
    if mode == 6:
        return mean(left, top_left)
    if mode == 7:
        return mean(left, top)
    if mode == 8:
        return mean(top_left, top)
    if mode == 9:
        return mean(top, top_right)
    if mode == 10:
        return mean(mean(left, top_left), mean(top, top_right))
    if mode == 11:
        to_left = sum(abs(t - c) for t, c in zip(top, top_left, strict=True))
        to_top = sum(abs(x - c) for x, c in zip(left, top_left, strict=True))
        return left if to_left < to_top else top
    if mode == 12:
        return [clamp(x + t - c) for x, t, c in zip(left, top, top_left, strict=True)]
    if mode == 13:
        both = mean(left, top)
        return [clamp(m + int((m - c) / 2)) for m, c in zip(both, top_left, strict=True)]
    return [255, 0, 0, 0]


def walk_predictor(samples: np.ndarray, width: int, height: int, block: int, modes: list[int], forward: bool) -> np.ndarray:
    """Residuals from samples (forward), or samples from residuals."""
    across = -(-width >> block)
    if not forward and set(modes) in ({1}, {2}):
        return summed(samples.reshape(height, width, 4), modes[0])
    given = samples.reshape(height * width, 4).tolist()
    done: list[list[int]] = []
    known = given if forward else done
    for y in range(height):
        for x in range(width):
            i = y * width + x
            if y == 0:
                p = [255, 0, 0, 0] if x == 0 else known[i - 1]
            elif x == 0:
                p = known[i - width]
            else:  # above the right edge's neighbour stands the row's own first pixel
                p = predicted(modes[(y >> block) * across + (x >> block)], known[i - 1], known[i - width], known[i - width + 1], known[i - width - 1])
            done.append([(a - b if forward else a + b) & 255 for a, b in zip(given[i], p, strict=True)])
    return np.array(done, np.uint8)


def summed(residuals: np.ndarray, mode: int) -> np.ndarray:
    """Samples from residuals of predictor 1 (left) or 2 (top) everywhere, by sums along rows or columns."""
    out = residuals.copy()
    out[0, 0, 0] = (int(out[0, 0, 0]) + 255) & 255  # the first pixel's prediction is opaque black
    if mode == 1:
        np.cumsum(out[:, 0], axis=0, dtype=np.uint8, out=out[:, 0])
        np.cumsum(out, axis=1, dtype=np.uint8, out=out)
    else:
        np.cumsum(out[0], axis=0, dtype=np.uint8, out=out[0])
        np.cumsum(out, axis=0, dtype=np.uint8, out=out)
    return out.reshape(-1, 4)


def cross_colour(samples: np.ndarray, width: int, height: int, block: int, elements: np.ndarray, forward: bool) -> np.ndarray:
    """Add (or, forward, subtract) what green tells of red and blue, and red of blue."""
    if not forward and (elements == elements[0]).all():
        return coloured(samples.reshape(-1, 4), channels(elements[:1])[0].view(np.int8).astype(np.int32))
    across = -(-width >> block)
    y, x = np.divmod(np.arange(width * height), width)
    e = channels(elements)[(y >> block) * across + (x >> block)].view(np.int8).astype(np.int32)
    signed = lambda a: a.astype(np.uint8).view(np.int8).astype(np.int32)
    out = samples.reshape(-1, 4).astype(np.int32)
    green, red = signed(out[:, 2]), out[:, 1].copy()
    sign = -1 if forward else 1
    out[:, 1] = (out[:, 1] + sign * (e[:, 3] * green >> 5)) & 255
    true_red = signed(red if forward else out[:, 1])
    out[:, 3] = (out[:, 3] + sign * ((e[:, 2] * green >> 5) + (e[:, 1] * true_red >> 5))) & 255
    return out.astype(np.uint8)


def coloured(samples: np.ndarray, element: np.ndarray) -> np.ndarray:
    """Cross-colour undone where its element is the same everywhere: what a byte adds is looked up."""
    byte = np.arange(256).astype(np.uint8).view(np.int8).astype(np.int32)
    by_green, by_green2, by_red = ((element[i] * byte >> 5).astype(np.uint8) for i in (3, 2, 1))
    out = samples.copy()
    out[:, 1] += by_green[out[:, 2]]
    out[:, 3] += by_green2[out[:, 2]]
    if element[1]:
        out[:, 3] += by_red[out[:, 1]]
    return out


def decode_stream(data: bytes) -> np.ndarray:
    """(height, width, 4) bytes, alpha, red, green, blue, of a VP8L stream."""
    r = Reader(data)
    if r.read(8) != SIGNATURE:
        raise ValueError("not a lossless WebP stream")
    width, height = r.read(14) + 1, r.read(14) + 1
    alpha = r.read(1)
    if r.read(3):
        raise ValueError("unknown version")
    transforms: list[tuple] = []
    full = width
    while r.read(1):
        kind = r.read(2)
        if any(kind == t[0] for t in transforms):
            raise ValueError("a transform occurs twice")
        if kind in (PREDICTOR, CROSS_COLOUR):
            block = r.read(3) + 2
            part = read_pixels(r, -(-width >> block), -(-height >> block), False)
            transforms.append((kind, width, block, part))
        elif kind == SUBTRACT_GREEN:
            transforms.append((kind, width))
        else:
            n = r.read(8) + 1
            table = joined(np.cumsum(channels(read_pixels(r, n, 1, False)), axis=0) & 255)
            pack = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            transforms.append((kind, width, pack, table))
            width = -(-width >> pack)
    pixels = read_pixels(r, width, height, True)
    for kind, wide, *more in reversed(transforms):
        if kind == PREDICTOR:
            modes = (more[1] >> 8 & 15).tolist()
            pixels = joined(walk_predictor(channels(pixels), wide, height, more[0], modes, False))
        elif kind == CROSS_COLOUR:
            pixels = joined(cross_colour(channels(pixels), wide, height, more[0], more[1], False))
        elif kind == SUBTRACT_GREEN:
            s = channels(pixels).copy()
            s[:, 1] += s[:, 2]
            s[:, 3] += s[:, 2]
            pixels = joined(s)
        else:
            pack, table = more
            green = pixels >> 8 & 255
            if pack:
                bits = 8 >> pack
                parts = green[:, None] >> (np.arange(1 << pack, dtype=np.uint32) * np.uint32(bits)) & np.uint32((1 << bits) - 1)
                green = parts.reshape(height, -1)[:, :wide].ravel()
            pixels = np.where(green < len(table), table[np.minimum(green, len(table) - 1)], 0).astype(np.uint32)
    if len(pixels) != full * height:
        raise ValueError("wrong number of pixels")
    out = channels(pixels).reshape(height, full, 4)
    if not alpha and (out[..., 0] != 255).any():
        out = out.copy()
        out[..., 0] = 255
    return out


def decode_image(data: bytes, at: int = 0) -> tuple[np.ndarray, int]:
    """The image of the RIFF file that begins at ``at``, and where that file ends."""
    if data[at : at + 4] != b"RIFF" or data[at + 8 : at + 12] != b"WEBP":
        raise ValueError("not a WebP file")
    end = at + 8 + int.from_bytes(data[at + 4 : at + 8], "little")
    p = at + 12
    while p + 8 <= end <= len(data):
        name, size = data[p : p + 4], int.from_bytes(data[p + 4 : p + 8], "little")
        if name == b"VP8L":
            return decode_stream(data[p + 8 : p + 8 + size]), end
        p += 8 + size + size % 2
    raise ValueError("no whole lossless image in the file")


# ---------------------------------------------------------------- encoding


def packed(codes: np.ndarray, sizes: np.ndarray) -> tuple[bytes, int]:
    """Codes of less than 64 bits written one after the other, the lowest bit first; and their bits."""
    ends = np.cumsum(sizes)
    starts = ends - sizes
    words, shift = starts >> 6, (starts & 63).astype(np.uint64)
    codes = codes.astype(np.uint64)
    out = np.zeros(int(ends[-1] >> 6) + 2, np.uint64)
    np.add.at(out, words, codes << shift)
    np.add.at(out, words + 1, codes >> np.uint64(1) >> (np.uint64(63) - shift))
    return out.astype("<u8").tobytes()[: int(ends[-1] + 7) // 8], int(ends[-1])


def repeats(x: np.ndarray) -> list[tuple[int, int, int]]:
    """[(start, length, distance)] of repeats of at least GRAM bytes, from left to right, without overlap."""
    if len(x) <= GRAM:
        return []
    wide = np.ndarray(len(x) - GRAM + 1, "<u8", x.tobytes(), strides=(1,))
    # Hashes with their places behind them are sorted, which is faster than sorting places by the bytes themselves.
    place = np.uint64((1 << PLACE_BITS) - 1)
    keys = (wide * np.uint64(0x9E3779B97F4A7C15)) & ~place | np.arange(len(wide), dtype=np.uint64)
    keys.sort()
    order = (keys & place).astype(np.int32)
    same = np.flatnonzero((keys[1:] ^ keys[:-1]) <= place)
    same = same[wide[order[same + 1]] == wide[order[same]]]
    if not len(same):
        return []
    distance = np.zeros(len(wide), np.int64)
    distance[order[same + 1]] = order[same + 1] - order[same]  # to the last place with the same bytes
    change = np.flatnonzero(np.diff(distance)) + 1
    begins, stops = np.concatenate(([0], change)), np.concatenate((change, [len(wide)]))
    kept = distance[begins] > 0
    out, end = [], 0
    for start, stop, far in zip(begins[kept].tolist(), (stops[kept] + GRAM - 1).tolist(), distance[begins[kept]].tolist(), strict=True):
        start = max(start, end)
        while stop - start >= GRAM:
            n = min(stop - start, LONGEST_COPY)
            out.append((start, n, far))
            start = end = start + n
    return out


def prefixed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(prefix symbol, extra bits' number, extra bits) of lengths or distances."""
    symbol = np.searchsorted(LEAST, values, side="right") - 1
    return symbol, EXTRA[symbol].astype(np.int64), values - LEAST[symbol]


def put_green(w: Writer, samples: np.ndarray, alpha: int) -> None:
    """The main image of green samples, the others fixed: red and blue 0."""
    w.put(0, 2)  # no colour cache, one group of codes
    copies = repeats(samples)
    if copies:
        start, length, far = (np.array(c, np.int64) for c in zip(*copies, strict=True))
        begun = np.zeros(len(samples) + 1, np.int64)
        begun[start] += 1
        begun[start + length] -= 1
        copied = np.cumsum(begun[:-1]) > 0
        literal = np.flatnonzero(~copied)
        symbol, extra, rest = prefixed(length)
        distance, extra2, rest2 = prefixed(far + len(DISTANCES))
        place = np.concatenate((literal, start))
        token = np.concatenate((samples[literal].astype(np.int64), 256 + symbol))[np.argsort(place, kind="stable")]
    else:
        token = samples.astype(np.int64)
    counts = np.bincount(token, minlength=GREEN_SYMBOLS)
    lengths = code_lengths(counts.tolist(), 12)
    put_code(w, lengths)
    for s in (0, 0, alpha):
        put_code(w, [0] * s + [1])
    lengths2 = code_lengths(np.bincount(distance, minlength=DISTANCE_SYMBOLS).tolist(), 12) if copies else [1]
    put_code(w, lengths2)
    sizes, code = coded(lengths)
    code, sizes = code[token], sizes[token]
    if copies:
        # A copy's parts go behind its symbol: its length's extra bits, the distance's symbol and its extra bits.
        sizes2, code2 = coded(lengths2)
        at = np.flatnonzero(token > 255)
        for part, n in ((rest, extra), (code2[distance], sizes2[distance]), (rest2, extra2)):
            code[at] |= part << sizes[at]
            sizes[at] += n
    if sizes.any():
        body, n = packed(code, sizes)
        w.put(int.from_bytes(body, "little"), n)


def coded(lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(bits, code) of each symbol; a code of one symbol takes no bits."""
    sizes, code = np.array(lengths, np.int64), np.zeros(len(lengths), np.int64)
    if np.count_nonzero(sizes) < 2:
        return np.zeros_like(sizes), code
    order, codes = canonical(sizes)
    code[order] = codes & ((1 << sizes[order]) - 1)
    return sizes, code


@functools.cache
def even_pixels(pixel: int, n: int) -> tuple[int, int]:
    """The bits of an image inside of a transform whose pixels are all the same; and their number."""
    w = Writer()
    put_pixels(w, np.full(n, pixel, np.uint32))
    return w.value, w.size


def put_pixels(w: Writer, argb: np.ndarray) -> None:
    """An image of literal pixels inside of a transform."""
    w.put(0, 1)
    parts = [channels(argb)[:, c] for c in (2, 1, 3, 0)]
    tables = []
    for part, n in zip(parts, (GREEN_SYMBOLS, 256, 256, 256), strict=True):
        lengths = code_lengths(np.bincount(part, minlength=n).tolist(), 12)
        put_code(w, lengths)
        tables.append(coded(lengths))
    put_code(w, [1])
    for pixel in zip(*parts, strict=True):
        for s, (sizes, code) in zip(pixel, tables, strict=True):
            w.put(int(code[s]), int(sizes[s]))


def entropy(samples: np.ndarray) -> float:
    share = np.bincount(samples.ravel(), minlength=256) / samples.size
    share = share[share > 0]
    return float(-(share * np.log2(share)).sum())


def unevenness(samples: np.ndarray) -> int:
    """How often two samples picked at random are the same, in pairs: a quick sign of a smaller entropy."""
    counts = np.bincount(samples.ravel(), minlength=256)
    return int(counts @ counts)


def encode_grey(samples: np.ndarray, width: int) -> bytes:
    """A VP8L stream of (n,) samples as red, green and blue alike, opaque; n is a multiple of ``width``."""
    height = len(samples) // width
    w = Writer()
    w.put(SIGNATURE, 8)
    w.put(width - 1, 14)
    w.put(height - 1, 14)
    w.put(0, 4)
    colours = np.flatnonzero(np.bincount(samples, minlength=256)).astype(np.uint8)
    if len(colours) <= FEW_COLOURS:
        w.put(1, 1)
        w.put(PALETTE, 2)
        w.put(len(colours) - 1, 8)
        steps = np.diff(colours, prepend=np.uint8(0))
        opaque = np.where(np.arange(len(colours)) == 0, 255, 0).astype(np.uint8)
        put_pixels(w, joined(np.stack((opaque, steps, steps, steps), axis=1)))
        pack = 3 if len(colours) <= 2 else 2 if len(colours) <= 4 else 1
        place = np.searchsorted(colours, samples).reshape(height, width >> pack, 1 << pack)
        samples = (place << (np.arange(1 << pack) * (8 >> pack))).sum(2).astype(np.uint8).ravel()
        w.put(0, 1)
        put_green(w, samples, 255)
        return w.bytes()
    grid, plain, alpha = samples.reshape(height, width), unevenness(samples), 255
    left = np.diff(grid, axis=1, prepend=np.concatenate((np.zeros((1, 1), np.uint8), grid[:-1, :1])))
    top = np.diff(grid, axis=0, prepend=np.zeros((1, width), np.uint8))
    top[0] = left[0]
    found, mode, best = max((unevenness(left), 1, left), (unevenness(top), 2, top), key=lambda x: x[0])
    if found > plain and entropy(best) < entropy(samples):
        # Where a predictor pays, it is the same in every block. The pixels are opaque, so its alpha residuals are zero.
        samples, alpha = best.ravel(), 0
        w.put(1, 1)
        w.put(PREDICTOR, 2)
        w.put(7, 3)
        w.put(*even_pixels(255 << 24 | mode << 8, -(-width >> 9) * -(-height >> 9)))
    w.put(1, 1)
    w.put(CROSS_COLOUR, 2)
    w.put(7, 3)
    w.put(*even_pixels(255 << 24 | ALL_GREEN << 8 | ALL_GREEN, -(-width >> 9) * -(-height >> 9)))
    w.put(0, 1)
    put_green(w, np.ascontiguousarray(samples), alpha)
    return w.bytes()


def riff(stream: bytes) -> bytes:
    chunk = b"VP8L" + len(stream).to_bytes(4, "little") + stream + b"\0" * (len(stream) % 2)
    return b"RIFF" + (4 + len(chunk)).to_bytes(4, "little") + b"WEBP" + chunk


def store(payload: bytes) -> bytes:
    """A payload of a positive multiple of WIDTH bytes as WebP files."""
    samples = np.frombuffer(payload, np.uint8)
    return b"".join(riff(encode_grey(samples[i : i + IMAGE_BYTES], WIDTH)) for i in range(0, len(samples), IMAGE_BYTES))


def load(media: bytes) -> bytes:
    """The payload that ``store`` was given: the pixels' samples, which must be grey and opaque."""
    at, parts = 0, []
    while at < len(media):
        pixels, at = decode_image(media, at)
        grey = pixels[..., 2]
        if not ((pixels[..., 1] == grey) & (pixels[..., 3] == grey)).all() or (pixels[..., 0] != 255).any():
            raise ValueError("not a grey image")
        parts.append(grey.tobytes())
    return b"".join(parts)


def feature(payload: bytes) -> str:
    """Of the samples: entropy in bits, mean, share of each eighth of the range, mean step to the next."""
    samples = np.frombuffer(payload, np.uint8)
    counts = np.bincount(samples, minlength=256)
    share = counts[counts > 0] / len(samples)
    entropy = float(-(share * np.log2(share)).sum()) + 0.0
    eighths = counts.reshape(8, 32).sum(1) * 1000 // len(samples)
    mean = float(counts @ np.arange(256)) / len(samples)
    step = float(np.abs(np.diff(samples.astype(np.int16))).mean())
    return f"{entropy:.4f}|{mean:.4f}|{step:.4f}|" + ",".join(map(str, eighths.tolist()))


def media(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_bytes, media binary) of every row of ``docs``. No shuffle."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "_text"):
                raw = part.column("_text").cast(pa.binary()).to_pylist()
                stored = [store(x + b"\0" * (-len(x) % WIDTH or (not x) * WIDTH)) for x in raw]
                yield pa.RecordBatch.from_pydict({"_key": part.column("_key"), "n_bytes": pa.array(map(len, raw), pa.int64()), "media": pa.array(stored, pa.binary())})

    rows = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    return rows.mapInArrow(run, f"_key {kind}, n_bytes long, media binary").withColumnRenamed("_key", key)


def media_digests(stored: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature), read back from ``media``. No shuffle."""
    kind = stored.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "media"):
                rows = []
                for m in part.column("media").to_pylist():
                    payload = load(m)
                    rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(m), hashlib.sha256(m).hexdigest(), feature(payload)))
                names = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
                columns = dict(zip(names, map(list, zip(*rows, strict=True)), strict=True)) if rows else {n: [] for n in names}
                yield pa.RecordBatch.from_pydict({"_key": part.column("_key"), "n_bytes": part.column("n_bytes"), **columns})

    schema = f"_key {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return stored.select(F.col(key).alias("_key"), "n_bytes", "media").mapInArrow(run, schema).withColumnRenamed("_key", key)
