"""Media columns: lossless WebP.

`decode` reads any lossless stream: prefix codes with meta codes, back-references, the colour cache,
and the predictor, cross-colour, subtract-green and palette transforms, and returns the pixel array.
`encode_samples` stores 8-bit samples in the green channel: repeated passages become back-references, and up to 16
different samples become a palette, several indices a pixel.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annolytics.llm.common import whole_text, written

# Fixed values of the format.
SIGNATURE = 0x2F
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
CACHE_FACTOR = 0x1E35A7BD
MAX_SIDE = 1 << 14
# Near distances by code: (columns to the left, rows up).
NEAR = (
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
)
GREEN_BASE, LENGTHS, DISTANCES, LONGEST = 256, 24, 40, 15
LEAPS = 4  # a leap of the reader passes up to 2 ** LEAPS literals
WINDOW = (1 << 20) - len(NEAR)  # farthest distance
LONGEST_COPY = 4096
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
REVERSED = np.packbits(np.unpackbits(np.arange(256, dtype=np.uint8).reshape(-1, 1), axis=1)[:, ::-1], axis=1).ravel()
TURNED = REVERSED.tolist()

# --- bits and prefix codes ------------------------------------------------------------------------


class BitReader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def read(self, n: int) -> int:
        first = self.at >> 3
        word = int.from_bytes(self.data[first : first + 5], "little")
        value = word >> (self.at & 7) & ((1 << n) - 1)
        self.at += n
        if self.at > 8 * len(self.data):
            raise ValueError("the stream ends early")
        return value

    def peek(self, n: int) -> int:
        first = self.at >> 3
        return int.from_bytes(self.data[first : first + 5], "little") >> (self.at & 7) & ((1 << n) - 1)


class BitWriter:
    def __init__(self):
        self.value, self.n = 0, 0

    def write(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n


def _in_order(used: list[tuple[int, int]]) -> Iterator[tuple[int, int, int]]:
    """(symbol, code with its first bit lowest, length) of a canonical code, from (length, symbol)."""
    first = 0  # of 16 bits, first bit highest
    for n, symbol in sorted(used):
        yield symbol, TURNED[first >> 8] | TURNED[first & 255] << 8, n
        first += 1 << 16 - n
        if first > 1 << 16:
            break
    if first != 1 << 16:
        raise ValueError("not a complete prefix code")


def _lookup(lengths: list[int]) -> tuple[list[tuple[int, int]], int]:
    """(symbol, length) by the next bits in stream order, and how many bits these are; for short codes."""
    used = [(n, symbol) for symbol, n in enumerate(lengths) if n]
    if len(used) <= 1:  # one symbol takes no bits
        return [(used[0][1] if used else 0, 0)], 0
    wide = max(used)[0]
    table = [(0, 0)] * (1 << wide)
    for symbol, code, n in _in_order(used):
        table[code :: 1 << n] = [(symbol, n)] * (1 << wide - n)
    return table, wide


class PrefixCode:
    """A canonical code; `symbol` and `length` by the next `bits` bits, first bit highest."""

    def __init__(self, lengths: np.ndarray):
        used = np.flatnonzero(lengths)
        self.lengths = lengths
        if len(used) <= 1:  # one symbol takes no bits
            self.bits, self.symbol, self.length = 0, used if len(used) else np.zeros(1, np.int64), np.zeros(1, np.int64)
        else:
            order = used[np.argsort(lengths[used], kind="stable")]
            self.bits = int(lengths[order[-1]])
            spans = 1 << (self.bits - lengths[order])
            if spans.sum() != 1 << self.bits:
                raise ValueError("not a complete prefix code")
            self.symbol, self.length = np.repeat(order, spans), np.repeat(lengths[order], spans)
        self.lookup: list[tuple[int, int]] | None = None

    def table(self) -> list[tuple[int, int]]:
        """(symbol, length) by the next `bits` bits in stream order."""
        if self.lookup is None:
            turned = REVERSED[np.arange(1 << self.bits) & 255].astype(np.int64) << 8
            turned = (turned | REVERSED[np.arange(1 << self.bits) >> 8]) >> (16 - self.bits)
            self.lookup = list(zip(self.symbol[turned].tolist(), self.length[turned].tolist(), strict=True))
        return self.lookup

    def read(self, bits: BitReader) -> int:
        if not self.bits:
            return int(self.symbol[0])
        symbol, n = self.table()[bits.peek(self.bits)]
        bits.read(n)
        return symbol


@lru_cache(maxsize=1024)
def _stated(alphabet: int, *symbols: int) -> PrefixCode:
    lengths = np.zeros(alphabet, np.int64)
    lengths[list(symbols)] = 1
    return PrefixCode(lengths)


def read_code(bits: BitReader, alphabet: int) -> PrefixCode:
    if bits.read(1):  # one or two symbols, stated
        two = bits.read(1)
        first = bits.read(8 if bits.read(1) else 1)
        return _stated(alphabet, first, bits.read(8)) if two else _stated(alphabet, first)
    lengths = np.zeros(alphabet, np.int64)
    of_lengths = [0] * len(LENGTH_ORDER)
    for place in LENGTH_ORDER[: 4 + bits.read(4)]:
        of_lengths[place] = bits.read(3)
    table, wide = _lookup(of_lengths)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    wide = (1 << wide) - 1
    # a symbol and its extra bits take 14 at most, so these bytes hold all that are left
    first, used = bits.at >> 3, bits.at & 7
    ahead = int.from_bytes(bits.data[first : first + 2 * left + 2], "little") >> used
    found, last, start = [], 8, used
    while len(found) < alphabet and left:
        left -= 1
        symbol, n = table[ahead & wide]
        ahead >>= n
        used += n
        if symbol < 16:
            found.append(symbol)
            last = symbol or last
            continue
        value, extra, least = ((last, 2, 3), (0, 3, 3), (0, 7, 11))[symbol - 16]
        n = least + (ahead & (1 << extra) - 1)
        ahead >>= extra
        used += extra
        if len(found) + n > alphabet:
            raise ValueError("too many code lengths")
        found.extend([value] * n)
    bits.read(used - start)
    lengths[: len(found)] = found
    return PrefixCode(lengths)


# --- pixels ---------------------------------------------------------------------------------------


def _green_samples(bits: BitReader, green: PrefixCode, distance: PrefixCode, n: int, width: int) -> np.ndarray:
    """n samples where only the green channel takes bits: the step from every bit position is looked up at once,
    steps are joined to leaps over several literals, and the chain of leaps is followed, with a stop at each back-reference."""
    if not green.bits:
        if green.symbol[0] >= GREEN_BASE:
            raise ValueError("a reference leaves the image")
        return np.full(n, green.symbol[0])
    first = bits.at >> 3
    raw = np.frombuffer(bits.data[first:] + b"\0\0\0", np.uint8)
    top = REVERSED[raw].astype(np.int32)  # first bit highest
    word = top[:-2] << 16 | top[1:-1] << 8 | top[2:]
    shift = np.arange(24 - green.bits, 16 - green.bits, -1, dtype=np.int32)
    window = ((word[:, None] >> shift) & ((1 << green.bits) - 1)).ravel()
    literal = np.where(green.symbol < GREEN_BASE, green.length, 0).astype(np.uint8)
    steps = np.append(literal[window], np.uint8(0))  # none at a reference, nor behind the stream
    leap = np.minimum(np.arange(len(steps)) + steps, len(window))
    passed, leaps = (steps > 0).view(np.uint8), []  # literals within a leap; leaps over 1, 2, 4, ... literals
    while len(leaps) < LEAPS:
        leaps.append(leap)
        passed, leap = passed + passed[leap], leap[leap]
    at, heads, taken, copies = bits.at & 7, [], [], []  # copies: literals before, length, distance
    made, own = 0, 0
    data, far, far_bits = bits.data, distance.symbol.tolist(), distance.length.tolist()
    unused = 16 - distance.bits
    passing, leaping, codes = memoryview(passed), memoryview(leap), memoryview(window)
    green_symbol, green_length = memoryview(green.symbol), memoryview(green.length)
    try:
        while made < n:
            literals = passing[at]
            heads.append(at)
            if made + literals >= n:  # padding follows the last pixel
                literals = n - made
                for _ in range(literals):
                    at += int(steps[at])
                taken.append(literals)
                own += literals
                break
            taken.append(literals)
            made += literals
            own += literals
            at = leaping[at]
            if literals < 1 << LEAPS:
                code = codes[at]
                at += green_length[code]
                byte = first + (at >> 3)
                ahead = int.from_bytes(data[byte : byte + 8], "little") >> (at & 7)  # a reference ends within 57 bits
                extra, least = EXTRAS[green_symbol[code] - GREEN_BASE]
                length = least + (ahead & (1 << extra) - 1)
                ahead >>= extra
                at += extra
                code = (TURNED[ahead & 255] << 8 | TURNED[ahead >> 8 & 255]) >> unused
                ahead >>= far_bits[code]
                at += far_bits[code]
                extra, least = EXTRAS[far[code]]
                back = _distance(least + (ahead & (1 << extra) - 1), width)
                at += extra
                if back > made or made + length > n:
                    raise ValueError("a reference leaves the image")
                copies.append((own, length, back))
                made += length
    except IndexError:
        raise ValueError("the stream ends early") from None
    bits.at = 8 * first + at
    if bits.at > 8 * len(bits.data):
        raise ValueError("the stream ends early")
    places = np.array(heads)[:, None]
    for leap in leaps:
        places = np.concatenate([places, leap[places]], axis=1)
    places = places[np.arange(1 << LEAPS) < np.array(taken)[:, None]]
    literals = green.symbol[window[places]].astype(np.uint8)
    if not copies:
        return literals
    own, out, done = literals.tobytes(), bytearray(), 0
    for upto, length, back in copies:
        out += own[done:upto]
        done = upto
        source = out[-back:] if back <= length else out[-back : length - back]
        out += (source * (length // len(source) + 1))[:length]
    out += own[done:]
    return np.frombuffer(bytes(out), np.uint8)


def _distance(code: int, width: int) -> int:
    if code > len(NEAR):
        return code - len(NEAR)
    dx, dy = NEAR[code - 1]
    return max(1, dx + dy * width)


def _extra(symbol: int) -> tuple[int, int]:
    """(extra bits, least value) of a length or distance symbol."""
    if symbol < 4:
        return 0, symbol + 1
    extra = (symbol - 2) >> 1
    return extra, ((2 + (symbol & 1)) << extra) + 1


EXTRAS = [_extra(symbol) for symbol in range(DISTANCES)]
EXTRA_BITS, LEAST_VALUES = np.array(EXTRAS, np.int64).T.copy()


def _prefixed(bits: BitReader, symbol: int) -> int:
    extra, least = _extra(symbol)
    return least + bits.read(extra)


def _read_pixels(bits: BitReader, width: int, height: int, main: bool, one_by_one: bool = False) -> np.ndarray:
    """Entropy-coded image: uint32 ARGB, flat.  `one_by_one` takes the loop over pixels for any stream."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    groups_at, group_bits = None, 0
    groups = 1
    if main and bits.read(1):
        group_bits = bits.read(3) + 2
        across = (width + (1 << group_bits) - 1) >> group_bits
        down = (height + (1 << group_bits) - 1) >> group_bits
        groups_at = (_read_pixels(bits, across, down, False) >> 8 & 0xFFFF).tolist()
        groups = max(groups_at) + 1
    cache_size = 1 << cache_bits if cache_bits else 0
    sizes = (GREEN_BASE + LENGTHS + cache_size, 256, 256, 256, DISTANCES)
    codes = [[read_code(bits, size) for size in sizes] for _ in range(groups)]
    n = width * height

    green, red, blue, alpha, distance = codes[0]
    if groups == 1 and not (cache_bits or red.bits or blue.bits or alpha.bits or one_by_one):
        rest = int(alpha.symbol[0]) << 24 | int(red.symbol[0]) << 16 | int(blue.symbol[0])
        return _green_samples(bits, green, distance, n, width).astype(np.uint32) << 8 | np.uint32(rest)

    pixels: list[int] = []
    cache, cached = [0] * cache_size, 0  # pixels from `cached` on have not been put in yet
    across = (width + (1 << group_bits) - 1) >> group_bits
    while len(pixels) < n:
        at = len(pixels)
        if groups_at is not None:
            y, x = divmod(at, width)
            green, red, blue, alpha, distance = codes[groups_at[(y >> group_bits) * across + (x >> group_bits)]]
        symbol = green.read(bits)
        if symbol < GREEN_BASE:
            r, b, a = red.read(bits), blue.read(bits), alpha.read(bits)
            pixels.append(a << 24 | r << 16 | symbol << 8 | b)
        elif symbol < GREEN_BASE + LENGTHS:
            length = _prefixed(bits, symbol - GREEN_BASE)
            back = _distance(_prefixed(bits, distance.read(bits)), width)
            if back > at or at + length > n:
                raise ValueError("a reference leaves the image")
            for _ in range(length):
                pixels.append(pixels[-back])
        else:
            for p in pixels[cached:]:
                cache[(CACHE_FACTOR * p & 0xFFFFFFFF) >> (32 - cache_bits)] = p
            cached = at
            pixels.append(cache[symbol - GREEN_BASE - LENGTHS])
    return np.array(pixels, np.uint32)


def _channels(pixels: np.ndarray) -> np.ndarray:
    """(n, 4): alpha, red, green, blue."""
    return pixels.astype(">u4").view(np.uint8).reshape(-1, 4).astype(np.int32)


def _packed(channels: np.ndarray) -> np.ndarray:
    return (channels & 255).astype(np.uint8).copy().view(">u4").ravel().astype(np.uint32)


def predict(mode: int, left: list[int], top: list[int], right: list[int], corner: list[int]) -> list[int]:
    """The predicted channels from the neighbours: left, above, above right, above left."""

    def mean(p, q):
        return [(a + b) >> 1 for a, b in zip(p, q, strict=True)]

    if mode == 0 or mode > 13:
        return [255, 0, 0, 0]
    if mode <= 4:
        return (left, top, right, corner)[mode - 1]
    if mode == 5:
        return mean(mean(left, right), top)
    if mode <= 9:
        return mean(*((left, corner), (left, top), (corner, top), (top, right))[mode - 6])
    if mode == 10:
        return mean(mean(left, corner), mean(top, right))
    if mode == 11:  # whichever of left and above is nearer to left + above - corner
        to_left = sum(abs(t - c) for t, c in zip(top, corner, strict=True))
        to_top = sum(abs(s - c) for s, c in zip(left, corner, strict=True))
        return left if to_left < to_top else top
    if mode == 12:
        return [min(255, max(0, s + t - c)) for s, t, c in zip(left, top, corner, strict=True)]
    halves = zip(mean(left, top), corner, strict=True)
    return [min(255, max(0, m + int((m - c) / 2))) for m, c in halves]


def _undo_predictor(pixels: np.ndarray, width: int, bits: int, modes: np.ndarray) -> np.ndarray:
    across = (width + (1 << bits) - 1) >> bits
    out = _channels(pixels).tolist()
    for i, own in enumerate(out):
        y, x = divmod(i, width)
        if not y:
            guess = out[i - 1] if x else [255, 0, 0, 0]
        elif not x:
            guess = out[i - width]
        else:  # above right of the last column is the first pixel of this row
            mode = int(modes[(y >> bits) * across + (x >> bits)])
            guess = predict(mode, out[i - 1], out[i - width], out[i - width + 1], out[i - width - 1])
        out[i] = [(a + b) & 255 for a, b in zip(own, guess, strict=True)]
    return _packed(np.array(out))


def _signed(x: np.ndarray) -> np.ndarray:
    return (x + 128 & 255) - 128


def _undo_cross_colour(pixels: np.ndarray, width: int, bits: int, factors: np.ndarray) -> np.ndarray:
    across = (width + (1 << bits) - 1) >> bits
    y, x = np.divmod(np.arange(len(pixels)), width)
    factor = _signed(_channels(factors))[(y >> bits) * across + (x >> bits)]
    c = _channels(pixels)
    green = _signed(c[:, 2])
    c[:, 1] = c[:, 1] + (factor[:, 3] * green >> 5) & 255
    c[:, 3] += (factor[:, 2] * green >> 5) + (factor[:, 1] * _signed(c[:, 1]) >> 5)
    return _packed(c)


def _undo_palette(pixels: np.ndarray, width: int, height: int, colours: np.ndarray) -> np.ndarray:
    shift = _palette_shift(len(colours))
    narrow = (width + (1 << shift) - 1) >> shift
    index = (pixels >> 8 & 255).reshape(height, narrow)
    if shift:
        size = 8 >> shift
        parts = [index >> size * k & (1 << size) - 1 for k in range(1 << shift)]
        index = np.stack(parts, axis=2).reshape(height, -1)[:, :width]
    table = np.zeros(256, np.uint32)
    table[: len(colours)] = colours
    return table[index.ravel()]


def _palette_shift(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def decode(data: bytes, one_by_one: bool = False) -> np.ndarray:
    """(height, width) uint32 ARGB of a lossless WebP file.  `one_by_one` reads each pixel in a loop."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L":
        raise ValueError("not a lossless WebP file")
    size = struct.unpack("<I", data[16:20])[0]
    bits = BitReader(data[20 : 20 + size])
    if bits.read(8) != SIGNATURE:
        raise ValueError("not a lossless stream")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    undo = []
    now = width  # a palette may narrow the image for what comes after it
    while bits.read(1):
        kind = bits.read(2)
        if kind in (PREDICTOR, CROSS_COLOUR):
            block = bits.read(3) + 2
            across, down = ((s + (1 << block) - 1) >> block for s in (now, height))
            sub = _read_pixels(bits, across, down, False, one_by_one)
            undo.append((kind, now, block, sub))
        elif kind == SUBTRACT_GREEN:
            undo.append((kind, now, 0, None))
        else:
            n = bits.read(8) + 1
            colours = _packed(np.cumsum(_channels(_read_pixels(bits, n, 1, False, one_by_one)), axis=0))
            undo.append((kind, now, 0, colours))
            shift = _palette_shift(n)
            now = (now + (1 << shift) - 1) >> shift
    pixels = _read_pixels(bits, now, height, True, one_by_one)
    for kind, wide, block, extra in reversed(undo):
        if kind == PREDICTOR:
            pixels = _undo_predictor(pixels, wide, block, extra >> 8 & 255)
        elif kind == CROSS_COLOUR:
            pixels = _undo_cross_colour(pixels, wide, block, extra)
        elif kind == SUBTRACT_GREEN:
            c = _channels(pixels)
            c[:, 1] += c[:, 2]
            c[:, 3] += c[:, 2]
            pixels = _packed(c)
        else:
            pixels = _undo_palette(pixels, wide, height, extra)
    return pixels.reshape(height, width)


# --- writing samples ------------------------------------------------------------------------------


def code_lengths(counts: np.ndarray, longest: int) -> np.ndarray:
    """Huffman lengths of at most `longest` bits; counts are flattened until they fit."""
    lengths = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    weights = counts[used].tolist()
    while True:
        leaves = sorted((w, i) for i, w in enumerate(weights))  # two queues: joined nodes come in order of weight
        leaves.append((sum(weights) + 1, 0))
        parent = [0] * (2 * len(used) - 1)
        joined, first, leaf = [], 0, 0
        for node in range(len(used), 2 * len(used) - 1):
            weight = 0
            for _ in range(2):
                w, i = leaves[leaf]
                if first < len(joined) and joined[first] < w:
                    w, i = joined[first], len(used) + first
                    first += 1
                else:
                    leaf += 1
                parent[i] = node
                weight += w
            joined.append(weight)
        depth = [0] * len(parent)
        for node in range(len(parent) - 2, -1, -1):
            depth[node] = depth[parent[node]] + 1
        if max(depth[: len(used)]) <= longest:
            lengths[used] = depth[: len(used)]
            return lengths
        weights = [w // 2 + 1 for w in weights]


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes as the stream has them, first bit lowest."""
    codes, own = [0] * len(lengths), lengths.tolist()
    used = [(n, symbol) for symbol, n in enumerate(own) if n]
    if len(used) > 1:
        for symbol, code, _ in _in_order(used):
            codes[symbol] = code
    return np.array(codes, np.int64)


def _write_single(bits: BitWriter, symbol: int) -> None:
    bits.write(1 | (symbol > 1) << 2, 3)
    bits.write(symbol, 8 if symbol > 1 else 1)


RUNS = re.compile(rb"\0{1,138}|[^\0]", re.DOTALL)  # zeros in a row, or one code length


def write_code(bits: BitWriter, lengths: np.ndarray) -> None:
    used = np.flatnonzero(lengths)
    if len(used) <= 1:
        _write_single(bits, int(used[0]) if len(used) else 0)
        return
    said: list[tuple[int, int, int]] = []  # symbol, extra value, extra bits
    for run in RUNS.findall(lengths.astype(np.uint8).tobytes()):
        n = len(run)
        if run[0]:
            said.append((run[0], 0, 0))
        elif n > 2:
            said.append((18, n - 11, 7) if n > 10 else (17, n - 3, 3))
        else:
            said.extend([(0, 0, 0)] * n)
    own = code_lengths(np.bincount([s for s, _, _ in said], minlength=19), 7)
    codes, own = canonical(own).tolist(), own.tolist()
    bits.write(0, 1)
    n = max(4, 1 + max(i for i, s in enumerate(LENGTH_ORDER) if own[s]))
    bits.write(n - 4, 4)
    for s in LENGTH_ORDER[:n]:
        bits.write(own[s], 3)
    bits.write(0, 1)
    alone = sum(n > 0 for n in own) < 2
    for s, extra, wide in said:
        bits.write(codes[s], 0 if alone else own[s])
        bits.write(extra, wide)


def wrap(stream: bytes) -> bytes:
    """RIFF container around a lossless stream."""
    chunk = b"VP8L" + struct.pack("<I", len(stream)) + stream + b"\0" * (len(stream) & 1)
    return b"RIFF" + struct.pack("<I", 4 + len(chunk)) + b"WEBP" + chunk


def header(bits: BitWriter, width: int, height: int) -> None:
    if not (1 <= width <= MAX_SIDE and 1 <= height <= MAX_SIDE):
        raise ValueError(f"an image of {width} x {height} pixels does not fit the format, which ends at {MAX_SIDE}")
    bits.write(SIGNATURE, 8)
    bits.write(width - 1, 14)
    bits.write(height - 1, 14)
    bits.write(0, 4)


LEAST_COPY = 8
HASH_FACTOR = 0x9E3779B97F4A7C15  # odd, 64 bits


def references(samples: np.ndarray) -> np.ndarray:
    """(start, length, distance) of passages of LEAST_COPY samples or more that occurred before, none overlapping.

    Each place looks at the last one with the same next LEAST_COPY samples; neighbouring places with the same
    distance are one passage, and passages are taken from the left.
    """
    n = len(samples) - LEAST_COPY + 1
    if n < 2:
        return np.zeros((0, 3), np.int64)
    key = samples.astype(np.uint64)
    for k in (1, 2, 4):  # 2, 4 and 8 samples
        key = key[:-k] << np.uint64(8 * k) | key[k:]
    bits = np.uint64(n.bit_length())
    hashes = key * np.uint64(HASH_FACTOR) >> bits << bits  # a collision costs a passage, no more
    order = (np.sort(hashes | np.arange(n, dtype=np.uint64)) & (np.uint64(1) << bits) - np.uint64(1)).astype(np.int64)
    before, after = order[:-1], order[1:]
    same = (key[after] == key[before]) & (after > before)
    back = np.zeros(n, np.int64)
    back[after[same]] = (after - before)[same]
    back[back > WINDOW] = 0
    first = np.flatnonzero(back[1:] != back[:-1]) + 1  # a run of one distance begins; the first place has none
    ends = np.append(first, n)[1:] + LEAST_COPY - 1
    some = np.flatnonzero(back[first])
    first, ends = first[some], ends[some]
    found, done = [], 0
    for start, end, distance in zip(first.tolist(), ends.tolist(), back[first].tolist(), strict=True):
        start = max(start, done)
        if end - start < LEAST_COPY:
            continue
        while end - start >= LEAST_COPY:
            length = min(end - start, LONGEST_COPY)
            found.append((start, length, distance))
            start += length
        done = start
    return np.array(found, np.int64).reshape(-1, 3)


def _prefix_symbols(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbol, extra bits, number of extra bits) of lengths or distances from 1."""
    symbol = LEAST_VALUES.searchsorted(values, "right") - 1
    return symbol, values - LEAST_VALUES[symbol], EXTRA_BITS[symbol]


def _write_codes(bits: BitWriter, green: np.ndarray, distance: np.ndarray) -> None:
    write_code(bits, green)
    for symbol in (0, 0, 255):  # red, blue, alpha: one symbol each
        _write_single(bits, symbol)
    write_code(bits, distance)


def _write_palette(bits: BitWriter, colours: np.ndarray) -> None:
    bits.write(1 | PALETTE << 1, 3)
    bits.write(len(colours) - 1, 8)
    bits.write(0, 1)  # no cache
    steps = np.diff(colours, prepend=0)
    lengths = code_lengths(np.bincount(steps, minlength=GREEN_BASE + LENGTHS), LONGEST)
    _write_codes(bits, lengths, np.zeros(DISTANCES, np.int64))
    codes, widths = canonical(lengths), lengths if np.count_nonzero(lengths) > 1 else np.zeros_like(lengths)
    for step in steps.tolist():
        bits.write(int(codes[step]), int(widths[step]))


def encode_samples(samples: np.ndarray, width: int) -> bytes:
    """A WebP file whose green channel holds `samples`, row by row; the last row is filled up
    with zeros.  Up to 16 different samples take a palette; repeated passages are referred to."""
    rows = -(-len(samples) // width)
    samples = np.concatenate([samples, np.zeros(rows * width - len(samples), np.uint8)])
    bits = BitWriter()
    header(bits, width, rows)
    colours = np.flatnonzero(np.bincount(samples, minlength=256))
    shift = _palette_shift(len(colours))
    if shift:
        _write_palette(bits, colours)
        index = np.zeros(256, np.uint8)
        index[colours] = np.arange(len(colours))
        grid, size = index[samples].reshape(rows, width), 8 >> shift
        grid = np.pad(grid, ((0, 0), (0, -width % (1 << shift))))
        parts = [grid[:, k :: 1 << shift] << size * k for k in range(1 << shift)]
        samples = np.bitwise_or.reduce(parts).ravel()
    bits.write(0, 3)  # no further transform, no cache, one group
    copies = references(samples)
    start, length, back = copies.T
    token = np.ones(len(samples), bool)
    for a, n in zip(start.tolist(), length.tolist(), strict=True):
        token[a : a + n] = False
    literals = np.flatnonzero(token)
    long_symbol, long_value, long_extra = _prefix_symbols(length)
    far_symbol, far_value, far_extra = _prefix_symbols(back + len(NEAR))
    used = np.bincount(np.concatenate([samples[literals], GREEN_BASE + long_symbol]), minlength=GREEN_BASE + LENGTHS)
    green = code_lengths(used, LONGEST)
    distance = code_lengths(np.bincount(far_symbol, minlength=DISTANCES), LONGEST)
    _write_codes(bits, green, distance)
    if np.count_nonzero(green) < 2:
        return wrap(bits.value.to_bytes(-(-bits.n // 8), "little"))
    code, far_code = canonical(green), canonical(distance)
    far_width = distance if np.count_nonzero(distance) > 1 else np.zeros_like(distance)
    value, wide = code[samples[literals]], green[samples[literals]]
    if len(copies):  # a reference: length with its extra bits, distance, the extra bits of the distance
        own = green[GREEN_BASE + long_symbol]
        fields = (
            (code[GREEN_BASE + long_symbol] | long_value << own, own + long_extra),
            (far_code[far_symbol], far_width[far_symbol]),
            (far_value, far_extra),
        )
        takes = token.astype(np.int64)
        takes[start] = len(fields)
        slot = np.cumsum(takes) - takes
        own_value, own_wide = value, wide
        value, wide = np.zeros((2, int(takes.sum())), np.int64)
        value[slot[literals]], wide[slot[literals]] = own_value, own_wide
        for k, (v, w) in enumerate(fields):
            value[slot[start] + k], wide[slot[start] + k] = v, w
    ends = bits.n + np.cumsum(wide)
    starts = ends - wide
    total = int(ends[-1])
    value = value << (starts & 31)
    words = np.bincount(starts >> 5, value & 0xFFFFFFFF, total // 32 + 2)
    words += np.bincount((starts >> 5) + 1, value >> 32, total // 32 + 2)
    body = words.astype("<u4")  # bits of different codes do not overlap, so sums are unions
    for i in range(bits.n // 32 + 1):
        body[i] |= bits.value >> 32 * i & 0xFFFFFFFF
    return wrap(body.tobytes()[: -(-total // 8)])


# --- the column -----------------------------------------------------------------------------------

UNIT = 64


def side(payload: int) -> int:
    """Width for a payload: a multiple of 64 under which the height fits."""
    return UNIT * max(1, -(-payload // (UNIT * MAX_SIDE)))


def to_payload(text: bytes) -> bytes:
    return text + b"\0" * (-len(text) % UNIT or (0 if text else UNIT))


def feature(samples: np.ndarray) -> str:
    """Mean, spread and an 8-bin histogram of the samples, as whole numbers."""
    counts, value = np.bincount(samples.ravel(), minlength=256), np.arange(256)
    mean = int(counts @ value) // samples.size
    spread = int(counts @ np.abs(value - mean)) // samples.size
    return ":".join(map(str, (mean, spread, *counts.reshape(8, -1).sum(axis=1).tolist())))


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, media: every text as a lossless image.

    Null texts count as empty and become one row of zeros; texts are stored whole (up to 256 MB);
    repeated rows stay, other columns are ignored, no rows give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column(1).to_pylist()
                payloads = [to_payload(t) for t in texts]
                media = [encode_samples(np.frombuffer(p, np.uint8), side(len(p))) for p in payloads]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(map(len, texts), pa.int64()),
                        pa.array(map(len, payloads), pa.int64()),
                        pa.array(media, pa.binary()),
                    ],
                    names=["doc_id", "n_bytes", "payload_bytes", "media"],
                )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().cast("binary").alias("body"))
    return rows.mapInArrow(run, "doc_id bigint, n_bytes bigint, payload_bytes bigint, media binary")


READ_DDL = (
    "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, "
    "media_bytes bigint, media_sha256 string, feature string"
)


def read_media(stored: DataFrame) -> DataFrame:
    """Decode a media column; payload and features come from the pixels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for n, media in zip(batch.column(2).to_pylist(), batch.column(3), strict=True):
                data = media.as_py()
                samples = (decode(data) >> 8).astype(np.uint8)
                payload = samples.tobytes()[:n]
                found.append(
                    (sha256(payload).hexdigest(), crc32(payload[-UNIT:]), len(data), sha256(data).hexdigest(),
                     feature(samples))
                )
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            made = [pa.array([f[i] for f in found], kind) for i, kind in enumerate(kinds)]
            names = [x.split()[0] for x in READ_DDL.split(", ")]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *made], names=names)

    return stored.select("doc_id", "n_bytes", "payload_bytes", "media").mapInArrow(run, READ_DDL)


def media_table(docs: DataFrame) -> DataFrame:
    """Store all texts, read the stored bytes back, and describe them."""
    return read_media(written(store_texts(docs), "media"))
