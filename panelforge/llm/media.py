"""Media columns: payloads in progressive JPEG, read back as coefficients and RGB tensors.

``encode`` stores bytes losslessly as quantised DCT coefficients (value - 128,
quantisation 1) of a 4:2:0 image and writes them in a progressive script: DC and
the low AC band by successive approximation, the high AC band by spectral
selection. ``decode`` accumulates all scans of a file into coefficient arrays,
inverse-transforms them, upsamples chroma and returns the RGB tensor.

Entropy coding is sequential inside a restart interval only, so the intervals
of all images of a batch are decoded in step: one numpy operation advances
thousands of intervals by a symbol. Batches have a bounded number of bytes.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_row

#: Payloads are padded with spaces to a multiple of this.
UNIT = 192
#: Blocks (or MCUs of an interleaved scan) of a restart interval.
INTERVAL = 4
#: Payload bytes that are coded together.
BATCH_BYTES = 2_000_000

U = np.uint64


def zigzag() -> np.ndarray:
    """Row-major position of each coefficient in scan order."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (sum(p), p[0] if sum(p) % 2 else p[1]))
    return np.array([8 * r + c for r, c in cells])


ZIGZAG = zigzag()


class Huffman:
    """A canonical code from its counts by length and its symbols."""

    def __init__(self, counts: bytes, symbols: bytes):
        self.counts, self.symbols = bytes(counts), bytes(symbols)
        self.code, self.length = np.zeros(256, np.uint64), np.zeros(256, np.int64)
        self.lut_symbol, self.lut_length = np.zeros(65536, np.int64), np.zeros(65536, np.int64)
        code, at = 0, 0
        for bits in range(1, 17):
            for _ in range(counts[bits - 1]):
                s = symbols[at]
                self.code[s], self.length[s] = code, bits
                first = code << (16 - bits)
                self.lut_symbol[first : first + (1 << (16 - bits))] = s
                self.lut_length[first : first + (1 << (16 - bits))] = bits
                code, at = code + 1, at + 1
            code <<= 1


def dc_table() -> Huffman:
    """Twelve categories with codes of four bits."""
    return Huffman(bytes([0, 0, 0, 12] + [0] * 12), bytes(range(12)))


def ac_table() -> Huffman:
    """Symbols without a run and end-of-block in five bits, all others in nine."""
    short = [0x00, *range(0x01, 0x0B)]
    long = [r << 4 | s for r in range(1, 16) for s in range(0, 11)]
    return Huffman(bytes([0, 0, 0, 0, len(short), 0, 0, 0, len(long)] + [0] * 7), bytes(short + long))


#: Bits of each magnitude up to 2047, the largest that 8-bit images have.
SIZES = np.array([m.bit_length() for m in range(2048)])


def _size(v: np.ndarray) -> np.ndarray:
    return SIZES[np.abs(v)]


def _extra(v: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where(v < 0, v + (1 << size) - 1, v).astype(np.uint64)


def pack(code: np.ndarray, length: np.ndarray, lane: np.ndarray, lanes: int) -> tuple[np.ndarray, np.ndarray]:
    """Bits of the tokens of each lane (tokens in lane order), filled with ones to bytes and stuffed.

    Returns the bytes of all lanes and where each lane ends.
    """
    bits = np.bincount(lane, length, lanes).astype(np.int64)
    size = (bits + 7) // 8
    start = np.cumsum(size) - size
    before = np.cumsum(length) - length
    first = np.searchsorted(lane, np.arange(lanes))
    lane_before = np.r_[before, before[-1:] + length[-1:]][np.minimum(first, len(before))] if len(before) else np.zeros(lanes, np.int64)
    at = start[lane] * 8 + before - lane_before[lane]
    fill = size * 8 - bits
    code = np.concatenate([code, (U(1) << fill.astype(np.uint64)) - U(1)])
    length = np.concatenate([length, fill])
    at = np.concatenate([at, start * 8 + bits])
    words = np.zeros(int(size.sum()) // 4 + 3, np.uint64)
    word, offset = at >> 5, (at & 31).astype(np.uint64)
    value = code << (U(64) - offset - length.astype(np.uint64)) if len(code) else code
    value = np.where(length > 0, value, U(0))
    # Bits of different tokens never meet, so sums of halves are unions; below 2^53 they are exact.
    total = np.bincount(word, (value >> U(32)).astype(np.float64), len(words)) + np.bincount(word + 1, (value & U(0xFFFFFFFF)).astype(np.float64), len(words))
    flat = total.astype(np.uint64).astype(">u4").view(np.uint8)[: int(size.sum())]
    stuffed = np.flatnonzero(flat == 0xFF)
    ends = np.cumsum(size)
    ends = ends + np.searchsorted(stuffed, ends)
    return np.insert(flat, stuffed + 1, 0), ends


@dataclass
class Layout:
    """A 4:2:0 image of whole MCUs for a payload."""

    payload: int
    wide: int = 0
    high: int = 0
    mcus: int = 0

    def __post_init__(self):
        need = max(1, -(-self.payload // 384))
        self.wide = max(1, int(np.ceil(np.sqrt(need))))
        self.high = -(-need // self.wide)
        self.mcus = self.wide * self.high


@lru_cache(maxsize=4096)
def mcu_order(wide: int, high: int, h: int, v: int) -> np.ndarray:
    """Raster positions of a component's blocks in the order of interleaved MCUs, a row for each MCU."""
    grid = np.arange(wide * h * high * v).reshape(high, v, wide, h)
    return grid.transpose(0, 2, 1, 3).reshape(wide * high, v * h)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


DC, AC = dc_table(), ac_table()
#: (components, first and last coefficient, high and low bit)
SCRIPT = (
    ((0, 1, 2), 0, 0, 0, 1),
    *(((c,), 1, 5, 0, 1) for c in range(3)),
    *(((c,), 6, 63, 0, 0) for c in range(3)),
    *(((c,), 1, 5, 1, 0) for c in range(3)),
    ((0, 1, 2), 0, 0, 1, 0),
)


def _dc_tokens(values: np.ndarray, part: np.ndarray, mcu: np.ndarray, high: int, low: int) -> tuple[np.ndarray, np.ndarray]:
    """values of the blocks in MCU order (mcus, blocks); part: component of each; mcu: number inside its image."""
    if high:
        return (values >> low & 1).ravel().astype(np.uint64), np.ones(values.size, np.int64)
    v = values >> low
    diff = np.empty_like(v)
    for c in np.unique(part):
        own = v[:, part == c]
        flat = own.ravel()
        d = np.diff(flat, prepend=0).reshape(own.shape)
        d[mcu % INTERVAL == 0, 0] = own[mcu % INTERVAL == 0, 0]
        diff[:, part == c] = d
    d = diff.ravel()
    size = _size(d)
    return DC.code[size] << size.astype(np.uint64) | _extra(d, size), DC.length[size] + size


def _ac_first_tokens(c: np.ndarray, low: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens (code, length, block) of blocks (n, band): runs, values and an end-of-block where zeros remain."""
    v = np.sign(c) * (np.abs(c) >> low)
    n, band = v.shape
    block, k = np.nonzero(v)
    value = v[block, k]
    run = np.diff(k, prepend=-1) - 1
    first = np.r_[True, block[1:] != block[:-1]] if len(block) else np.empty(0, bool)
    run[first] = k[first]
    size = _size(value)
    symbol = (run % 16) << 4 | size
    code = AC.code[symbol] << size.astype(np.uint64) | _extra(value, size)
    length = AC.length[symbol] + size
    repeat = run // 16
    if repeat.any():
        index = np.repeat(np.arange(len(block)), repeat + 1)
        last = np.r_[index[1:] != index[:-1], True]
        code, length, block, k = np.where(last, code[index], AC.code[0xF0]), np.where(last, length[index], AC.length[0xF0]), block[index], k[index]
    ends = np.flatnonzero(v[:, -1] == 0)
    order = np.argsort(np.concatenate([block * 2, ends * 2 + 1]), kind="stable")
    return (
        np.concatenate([code, np.full(len(ends), AC.code[0])])[order],
        np.concatenate([length, np.full(len(ends), AC.length[0])])[order],
        np.concatenate([block, ends])[order],
    )


def _ac_refine_tokens(c: np.ndarray, low: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of a refinement: each symbol is followed by the correction bits of the values it passes."""
    m = np.abs(c) >> low
    n, band = m.shape
    new, zero, old = m == 1, m == 0, m > 1
    gap = np.cumsum(new, 1) - new  # new values before: positions of one gap share the symbol that ends it
    zeros = np.cumsum(zero, 1) - zero
    base = np.zeros((n, band + 1), np.int64)  # zeros before the gap
    rows, cols = np.nonzero(new)
    base[rows, gap[rows, cols] + 1] = zeros[rows, cols]
    inside = zeros - np.take_along_axis(base, gap, 1)
    total = np.full((n, band + 1), -1, np.int64)  # zeros of the whole gap; -1: it ends the block
    total[rows, gap[rows, cols]] = inside[rows, cols]
    of_gap = np.take_along_axis(total, gap, 1)
    step = np.where(of_gap < 0, 0, np.minimum(inside // 16, of_gap // 16))
    key = lambda b, g, s, kind, k: (((b * 64 + g) * 8 + s) * 3 + kind) * 64 + k
    ob, ok = np.nonzero(old)
    parts = [(key(ob, gap[ob, ok], step[ob, ok], 2, ok), (m[ob, ok] & 1).astype(np.uint64), np.ones(len(ob), np.int64), ob)]
    run = of_gap[rows, cols]
    symbol = (run % 16) << 4 | 1
    sign = (c[rows, cols] > 0).astype(np.uint64)
    parts.append((key(rows, gap[rows, cols], run // 16, 0, 0), AC.code[symbol] << U(1) | sign, AC.length[symbol] + 1, rows))
    far = np.repeat(np.arange(len(rows)), run // 16)
    nth = np.arange(len(far)) - np.repeat(np.cumsum(run // 16) - run // 16, run // 16)
    parts.append((key(rows[far], gap[rows[far], cols[far]], nth, 0, 0), np.full(len(far), AC.code[0xF0]), np.full(len(far), AC.length[0xF0]), rows[far]))
    tail = np.flatnonzero(~new[:, -1])
    parts.append((key(tail, new[tail].sum(1), 0, 0, 0), np.full(len(tail), AC.code[0]), np.full(len(tail), AC.length[0]), tail))
    keys, code, length, block = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(keys, kind="stable")
    return code[order], length[order], block[order]


def encode(payloads: list[bytes]) -> list[bytes]:
    """A progressive JPEG for each payload."""
    layouts = [Layout(len(p)) for p in payloads]
    planes: list[list[np.ndarray]] = [[], [], []]
    for p, lay in zip(payloads, layouts):
        c = np.zeros(lay.mcus * 384, np.int64)
        c[: len(p)] = np.frombuffer(p, np.uint8).astype(np.int64) - 128
        for i, part in enumerate(np.split(c, [lay.mcus * 256, lay.mcus * 320])):
            planes[i].append(part.reshape(-1, 64))
    blocks = [np.concatenate(p) for p in planes]
    mcus = np.array([lay.mcus for lay in layouts])
    local = [np.concatenate([np.arange(m * k) for m in mcus]) for k in (4, 1, 1)]
    offset = np.cumsum(mcus) - mcus
    order = [np.concatenate([mcu_order(lay.wide, lay.high, h, h) + o * h * h for lay, o in zip(layouts, offset)]) for h in (2, 1, 1)]
    mcu = np.concatenate([np.arange(m) for m in mcus])
    scans: list[list[bytes]] = []
    for parts, first, last, high, low in SCRIPT:
        units = mcus * (4 if parts == (0,) else 1)
        lanes_of = -(-units // INTERVAL)
        lane_base = np.cumsum(lanes_of) - lanes_of
        lanes = int(lanes_of.sum())
        if first == 0:
            values = np.concatenate([blocks[c][order[c], 0] for c in parts], 1)
            code, length = _dc_tokens(values, np.repeat(parts, [4, 1, 1]), mcu, high, low)
            unit_lane = np.repeat(lane_base, mcus) + mcu // INTERVAL
            lane = np.repeat(unit_lane, values.shape[1])
        else:
            (c,) = parts
            code, length, block = (_ac_refine_tokens if high else _ac_first_tokens)(blocks[c][:, first : last + 1], low)
            lane = (np.repeat(lane_base, units) + local[c] // INTERVAL)[block]
        data, ends = pack(code, length, lane, lanes)
        # A restart marker after each interval but the last of an image.
        final = np.zeros(lanes, bool)
        final[lane_base + lanes_of - 1] = True
        nth = np.arange(lanes) - np.repeat(lane_base, lanes_of)
        marked = ends[~final]
        data = np.insert(data, np.repeat(marked, 2), np.stack([np.full(len(marked), 0xFF), 0xD0 + nth[~final] % 8], 1).ravel().astype(np.uint8))
        ends = (ends + 2 * np.cumsum(~final))[final]
        raw = data.tobytes()
        scans.append([raw[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())])
    out = []
    dht = _segment(0xC4, b"\x00" + DC.counts + DC.symbols) + _segment(0xC4, b"\x10" + AC.counts + AC.symbols)
    dqt = _segment(0xDB, b"\x00" + bytes([1] * 64))
    dri = _segment(0xDD, struct.pack(">H", INTERVAL))
    for i, (p, lay) in enumerate(zip(payloads, layouts)):
        sof = struct.pack(">BHHB", 8, lay.high * 16, lay.wide * 16, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
        file = [b"\xff\xd8", _segment(0xFE, b"payload=%d" % len(p)), dqt, _segment(0xC2, sof), dht, dri]
        for (parts, first, last, high, low), data in zip(SCRIPT, scans):
            file += [_segment(0xDA, bytes([len(parts)]) + b"".join(bytes([c + 1, 0]) for c in parts) + bytes([first, last, high << 4 | low])), data[i]]
        out.append(b"".join(file) + b"\xff\xd9")
    return out


@dataclass(frozen=True)
class Frame:
    """Size of an image and (h, v, quantisation table) of its components."""

    width: int
    height: int
    parts: tuple[tuple[int, int, int], ...]

    @property
    def most(self) -> tuple[int, int]:
        return max(h for h, _, _ in self.parts), max(v for _, v, _ in self.parts)

    @property
    def mcus(self) -> tuple[int, int]:
        hmax, vmax = self.most
        return -(-self.width // (8 * hmax)), -(-self.height // (8 * vmax))

    @lru_cache(maxsize=4096)
    def grids(self) -> tuple[list[tuple[int, int]], list[int]]:
        """Rows and columns of each component's blocks, and where its blocks begin; the last place is their number."""
        wide, high = self.mcus
        blocks = [(high * v, wide * h) for h, v, _ in self.parts]
        return blocks, [0, *np.cumsum([r * c for r, c in blocks]).tolist()]

    @lru_cache(maxsize=4096)
    def order(self, parts: tuple[int, ...], interleaved: bool) -> np.ndarray:
        """Blocks of a scan: a row for each unit of a restart interval."""
        blocks, base = self.grids()
        wide, high = self.mcus
        if interleaved:
            return np.concatenate([mcu_order(wide, high, *self.parts[c][:2]) + base[c] for c in parts], 1)
        (c,) = parts
        hmax, vmax = self.most
        h, v, _ = self.parts[c]
        rows, cols = -(-(-(-self.height * v // vmax)) // 8), -(-(-(-self.width * h // hmax)) // 8)
        return (np.arange(rows)[:, None] * blocks[c][1] + np.arange(cols) + base[c]).reshape(-1, 1)


@dataclass
class File:
    frame: Frame | None = None
    comment: bytes = b""
    quant: dict[int, bytes] = field(default_factory=dict)
    base: int = 0


def parse(raw: bytes, markers: list[int], shift: int) -> tuple[File, list[tuple]]:
    """Headers and scans of one file. markers: places of all 0xFF that begin a marker, shift: of the file in the batch.

    A scan is (components, band, table, interval, from, to).
    """
    file, scans, tables, ids, interval, at = File(), [], {}, [], 0, 2
    while True:
        if raw[at] != 0xFF:
            raise ValueError("no marker where one is due")
        kind = raw[at + 1]
        if kind == 0xD9:
            return file, scans
        size = raw[at + 2] << 8 | raw[at + 3]
        body, at = raw[at + 4 : at + 2 + size], at + 2 + size
        if kind == 0xDA:
            n = body[0]
            parts = tuple([ids.index(body[1 + 2 * i]) for i in range(n)])
            first, last, bits = body[1 + 2 * n : 4 + 2 * n]
            table = tables.get(body[2] >> 4) if first == 0 else tables.get(0x10 | body[2] & 15)
            start, at = at + shift, markers[bisect_left(markers, at + shift)] - shift
            scans.append((parts, (first, last, bits >> 4, bits & 15), table, interval, start, at + shift))
        elif kind == 0xFE:
            file.comment = body
        elif kind == 0xDB:
            while body:
                if body[0] >> 4:
                    raise ValueError("16-bit quantisation isn't supported")
                file.quant[body[0] & 15] = body[1:65]
                body = body[65:]
        elif kind == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = (body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif kind == 0xC2:
            _, height, width, n = struct.unpack_from(">BHHB", body)
            ids = [body[6 + 3 * i] for i in range(n)]
            file.frame = Frame(width, height, tuple((body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)))
        elif kind == 0xDD:
            (interval,) = struct.unpack(">H", body)
        elif 0xC0 <= kind <= 0xCF and kind != 0xC8:
            raise ValueError("only progressive Huffman files are read")


def decode(files: list[bytes]) -> list[tuple[bytes, np.ndarray]]:
    """(payload, RGB tensor of height x width x 3) of each file."""
    flat = np.frombuffer(b"".join(files), np.uint8)
    starts = np.cumsum([0] + [len(f) for f in files]).tolist()
    ff = np.flatnonzero(flat[:-1] == 0xFF)
    follow = flat[ff + 1]
    restart = (follow >= 0xD0) & (follow <= 0xD7)
    markers = ff[(follow != 0) & (follow != 0xFF) & ~restart].tolist()
    restarts = ff[restart]
    restart_list = restarts.tolist()
    stuffed = ff[follow == 0] + 1
    keep = np.ones(len(flat), bool)
    keep[stuffed] = False
    clean = np.concatenate([flat[keep], np.zeros(16, np.uint8)])
    moved = lambda p: p - np.searchsorted(stuffed, p)  # noqa: E731  a place before the stuffing was taken out
    words = np.zeros(len(clean) - 8, np.uint64)
    for i in range(8):
        words = words << U(8) | clean[i : i + len(words)]

    parsed, phases, total = [], {}, 0
    for k, raw in enumerate(files):
        file, scans = parse(raw, markers, starts[k])
        file.base = total
        total += file.frame.grids()[1][-1]
        parsed.append(file)
        for parts, band, table, interval, start, stop in scans:
            order = file.frame.order(parts, band[0] == 0)
            shape = tuple([file.frame.parts[c][:2] for c in parts]) if band[0] == 0 else ()
            inner = bisect_left(restart_list, start), bisect_left(restart_list, stop)
            # Scans of one band and one pair of bits don't depend on each other: they are decoded in step.
            phases.setdefault((band, table, shape), []).append((order, file.base, interval or len(order), start, *inner))

    coefs = np.zeros((total + 1, 64), np.int32)
    # First passes before refinements, coarse bits before fine ones.
    for (band, table, shape), scans in sorted(phases.items(), key=lambda x: (x[0][0][2] != 0, -x[0][0][3], x[0][0][0])):
        lengths = np.array([len(s[0]) for s in scans])
        order = np.concatenate([s[0] for s in scans]) + np.repeat([s[1] for s in scans], lengths)[:, None]
        interval, start, lo, hi = np.array([s[2:] for s in scans]).T
        lanes = hi - lo + 1
        of = np.repeat(np.arange(len(scans)), lanes)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        begin = np.where(nth == 0, start[of], np.append(restarts, 0)[np.maximum(lo[of] + nth - 1, 0)] + 2)
        ends = np.cumsum(lengths)
        first_unit = (ends - lengths)[of] + nth * interval[of]
        units = np.minimum(interval[of], ends[of] - first_unit)
        bit = moved(begin).astype(np.int64) * 8
        first, _, high, low = band
        if first == 0 and high:
            _dc_refine(words, bit, order, first_unit, units, low, coefs)
        elif first == 0:
            part = np.repeat(np.arange(len(shape)), [h * v if len(shape) > 1 else 1 for h, v in shape])
            _dc_first(words, bit, order.reshape(-1, 1) if len(shape) == 1 else order, part, first_unit, units, low, Huffman(*table), coefs)
        elif high:
            _ac_refine(words, bit, order[:, 0], first_unit, units, band, Huffman(*table), coefs)
        else:
            _ac_first(words, bit, order[:, 0], first_unit, units, band, Huffman(*table), coefs)
    return list(zip([_payload(f, coefs) for f in parsed], _tensors(parsed, coefs)))


def _peek(words: np.ndarray, bit: np.ndarray) -> np.ndarray:
    return words[bit >> 3] << (bit & 7).astype(np.uint64)


def _bits(w: np.ndarray, skip: np.ndarray, size: np.ndarray) -> np.ndarray:
    """size bits after the first skip bits of w; none where size is 0."""
    return ((w << skip.astype(np.uint64)) >> U(1) >> (U(63) - size.astype(np.uint64))).astype(np.int64)


def _signed(x: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where((size > 0) & (x < (1 << np.maximum(size - 1, 0))), x - (1 << size) + 1, x)


def _dc_first(words, bit, order, part, first_unit, units, low, table, coefs) -> None:
    bit = bit.copy()
    last = np.zeros((len(bit), int(part.max()) + 1), np.int64)
    for u in range(int(units.max())):
        live = np.flatnonzero(u < units)
        for k, c in enumerate(part):
            w = _peek(words, bit[live])
            code = (w >> U(48)).astype(np.int64)
            n, size = table.lut_length[code], table.lut_symbol[code]
            last[live, c] += _signed(_bits(w, n, size), size)
            coefs[order[first_unit[live] + u, k], 0] = last[live, c] << low
            bit[live] += n + size


def _dc_refine(words, bit, order, first_unit, units, low, coefs) -> None:
    width = order.shape[1]
    for u in range(int(units.max())):
        live = np.flatnonzero(u < units)
        for k in range(width):
            at = bit[live] + u * width + k
            coefs[order[first_unit[live] + u, k], 0] |= ((_peek(words, at) >> U(63)).astype(np.int32)) << low


def _ac_first(words, bit, order, first_unit, units, band, table, coefs) -> None:
    first, last, _, low = band
    unit, stop = first_unit.copy(), first_unit + units
    bit, k = bit.copy(), np.full(len(bit), first)
    spare = len(coefs) - 1
    flat = coefs.reshape(-1)
    while len(unit):
        w = _peek(words, bit)
        code = (w >> U(48)).astype(np.int64)
        n, symbol = table.lut_length[code], table.lut_symbol[code]
        run, size = symbol >> 4, symbol & 15
        ends = (size == 0) & (run < 15)
        more = np.where(ends, run, size)
        x = _bits(w, n, more)
        k += run
        valued = size > 0
        at = np.where(valued, order[np.minimum(unit, len(order) - 1)] * 64 + np.minimum(k, 63), spare * 64)
        flat[at] = np.where(valued, _signed(x, size) << low, 0)
        k += 1
        over = ends | (k > last)
        unit += np.where(ends, (1 << np.where(ends, run, 0)) + x, over)
        k[over] = first
        bit += n + more
        if (unit >= stop).any():
            live = unit < stop
            unit, stop, bit, k = unit[live], stop[live], bit[live], k[live]


def _ac_refine(words, bit, order, first_unit, units, band, table, coefs) -> None:
    first, last, _, low = band
    unit, stop = first_unit.copy(), first_unit + units
    bit, k = bit.copy(), np.full(len(bit), first)
    zeros, value, blocks = (np.zeros(len(bit), np.int64) for _ in range(3))  # to pass, to place, left of an end-of-block run
    due = np.ones(len(bit), bool)  # for a symbol
    flat = coefs.reshape(-1)
    one = 1 << low
    while len(unit):
        at = np.flatnonzero(due & (blocks == 0))
        if len(at):
            w = _peek(words, bit[at])
            code = (w >> U(48)).astype(np.int64)
            n, symbol = table.lut_length[code], table.lut_symbol[code]
            run, size = symbol >> 4, symbol & 15
            ends = (size == 0) & (run < 15)
            more = np.where(ends, run, size)
            x = _bits(w, n, more)
            blocks[at] = np.where(ends, (1 << np.where(ends, run, 0)) + x, 0)
            zeros[at] = run
            value[at] = np.where(size > 0, np.where(x > 0, one, -one), 0)
            bit[at] += n + more
            due[at] = False
        place = order[unit] * 64 + k
        c = flat[place]
        known = c != 0
        fix = known & ((_peek(words, bit) >> U(63)) > 0) & ((np.abs(c) & one) == 0)
        c = np.where(fix, c + np.where(c > 0, one, -one), c)
        bit += known
        empty = ~known & (blocks == 0)
        here = empty & (zeros == 0)
        flat[place] = np.where(here, value, c)
        due |= here
        zeros -= empty & ~here
        k += 1
        over = k > last
        unit += over
        k[over] = first
        blocks -= over & (blocks > 0)
        due |= over & (blocks == 0)
        if (unit >= stop).any():
            live = unit < stop
            unit, stop, bit, k, zeros, value, blocks, due = (a[live] for a in (unit, stop, bit, k, zeros, value, blocks, due))


def _payload(file: File, coefs: np.ndarray) -> bytes:
    """The stored bytes: coefficients plus 128, in the order of components and blocks; none without the comment."""
    if not file.comment.startswith(b"payload="):
        return b""
    size = int(file.comment[8:])
    return (coefs[file.base : file.base + -(-size // 64)].reshape(-1)[:size] + 128).astype(np.uint8).tobytes()


def _basis() -> np.ndarray:
    k, x = np.mgrid[0:8, 0:8]
    a = np.cos((2 * x + 1) * k * np.pi / 16) / 2
    a[0] /= np.sqrt(2)
    return a.astype(np.float32)


BASIS = _basis()


def _tensors(files: list[File], coefs: np.ndarray) -> list[np.ndarray]:
    """RGB tensors; files of one frame and quantisation are transformed together."""
    out: list = [None] * len(files)
    alike: dict[tuple, list[int]] = {}
    for i, f in enumerate(files):
        alike.setdefault((f.frame, tuple(sorted(f.quant.items()))), []).append(i)
    for (frame, quant), members in alike.items():
        quant = dict(quant)
        hmax, vmax = frame.most
        blocks, base = frame.grids()
        planes = []
        at = np.array([files[i].base for i in members])[:, None]
        for (h, v, q), (rows, cols), b in zip(frame.parts, blocks, base):
            scaled = np.empty((len(members) * rows * cols, 64), np.float32)
            scaled[:, ZIGZAG] = coefs[(at + np.arange(b, b + rows * cols)).ravel()] * np.frombuffer(quant[q], np.uint8).astype(np.int32)
            x = (scaled.reshape(-1, 8) @ BASIS).reshape(-1, 8, 8).transpose(0, 2, 1).reshape(-1, 8) @ BASIS
            plane = x.reshape(-1, rows, cols, 8, 8).transpose(0, 1, 4, 2, 3).reshape(-1, rows * 8, cols * 8) + np.float32(128)
            np.clip(np.rint(plane, out=plane), 0, 255, out=plane)
            if vmax > v:
                plane = np.repeat(plane, vmax // v, 1)
            if hmax > h:
                plane = np.repeat(plane, hmax // h, 2)
            planes.append(plane[:, : frame.height, : frame.width])
        if len(planes) == 1:
            rgb = np.stack(planes * 3, -1)
        else:
            y, cb, cr = planes[0], planes[1] - np.float32(128), planes[2] - np.float32(128)
            rgb = np.empty((*y.shape, 3), np.float32)
            rgb[..., 0] = y + np.float32(1.402) * cr
            rgb[..., 1] = y - np.float32(0.344136) * cb - np.float32(0.714136) * cr
            rgb[..., 2] = y + np.float32(1.772) * cb
        rgb = np.clip(np.rint(rgb, out=rgb), 0, 255, out=rgb).astype(np.uint8)
        for i, image in zip(members, rgb):
            out[i] = image
    return out


def payload_of(text: str) -> bytes:
    raw = text.encode("utf-8", "replace")
    return raw + b" " * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def feature(rgb: np.ndarray) -> str:
    """Height, width, mean and deviation of each channel, from exact sums."""
    flat = rgb.reshape(-1, 3)
    n = len(flat)
    parts = []
    for c in range(3):
        counts = np.bincount(flat[:, c], minlength=256)
        total, squares = int(counts @ LEVELS), int(counts @ LEVELS**2)
        parts.append(f"{total / n:.2f}/{max(0.0, squares / n - (total / n) ** 2) ** 0.5:.2f}")
    return f"{rgb.shape[0]}x{rgb.shape[1]}:" + ",".join(parts)


LEVELS = np.arange(256)


def _batches(texts: list[str]) -> Iterator[list[bytes]]:
    group, size = [], 0
    for t in texts:
        p = payload_of(t)
        if group and size + len(p) > BATCH_BYTES:
            yield group
            group, size = [], 0
        group.append(p)
        size += len(p)
    if group:
        yield group


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tensors: bool = False) -> DataFrame:
    """One row for each row of docs: the stored form, what was read back from it, and features.

    Columns: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32,
    media_bytes, media_sha256, feature; with ``tensors`` also media (the JPEG),
    height, width and rgb (height * width * 3 bytes). A null text counts as an
    empty one: its payload is 192 spaces. Equal texts get equal values.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    extra = ["media", "height", "width", "rgb"]

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in batches:
            texts, at = series.tolist(), 0
            for group in _batches(texts):
                files, out = encode(group), []
                for file, (payload, rgb) in zip(files, decode(files)):
                    n = len(texts[at + len(out)].encode("utf-8", "replace"))
                    row = [n, len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(file), sha256(file).hexdigest(), feature(rgb)]
                    out.append(row + [file, rgb.shape[0], rgb.shape[1], rgb.tobytes()] if tensors else row)
                at += len(out)
                yield pd.DataFrame(out, columns=names + (extra if tensors else []))

    schema = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    made = by_row(rows, run, schema + (", media binary, height int, width int, rgb binary" if tensors else ""))
    return rows.select("doc_id", made("text").alias("made")).select("doc_id", "made.*")
