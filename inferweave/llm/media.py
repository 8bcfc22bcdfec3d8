"""Progressive JPEG columns.

decode_images reads progressive JPEG: it adds up the spectral-selection and successive-approximation scans in
coefficient arrays, dequantizes, inverse-transforms in numpy, upsamples chroma and returns full-resolution RGB tensors.
Restart intervals, of one image or of many, are decoded in lockstep: each numpy step reads one symbol (or, when AC
bits are refined, one coefficient) of every interval in the batch.

encode_payloads stores bytes losslessly in the format's own unit, the quantized coefficient: a byte is a coefficient
of -127 to 128 by a fixed ranking, frequent bytes of text nearest to 0.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inferweave.llm.common import materialize, rows_of, ship_package, table

UNIT = 576
#: Blocks between restart markers: in the scan of the high band, in the others.
HIGH_RESTART, RESTART = 8, 64
#: Bytes that are frequent in text, most frequent first; the other bytes follow in order.
COMMON = b" e\xfftnhaoirsdulcgbmpfw.v,\n"
#: Bytes of payload that are handled together; the bound on a worker's arrays.
CHUNK = 2 << 20


@functools.lru_cache(maxsize=1)
def zigzag() -> np.ndarray:
    """Row-major index of the coefficients in zigzag order: diagonals, in turn upward and downward."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))
    return np.array([8 * r + c for r, c in cells])


@functools.lru_cache(maxsize=1)
def byte_values() -> tuple[np.ndarray, np.ndarray]:
    """The coefficient of each byte, and the byte of each coefficient + 127."""
    order = np.array([*COMMON, *(b for b in range(256) if b not in COMMON)])
    rank = np.arange(256)
    to_value = np.empty(256, np.int16)
    to_value[order] = (rank + 1) // 2 * np.where(rank % 2, 1, -1)
    to_byte = np.empty(256, np.uint8)
    to_byte[to_value[np.arange(256)] + 127] = np.arange(256)
    return to_value, to_byte


def code_lengths(weights: dict[int, float]) -> dict[int, int]:
    """Huffman code lengths of 16 at most in which no code is all ones."""
    floor = 0.0
    while True:
        heap = [(max(w, floor), i, (s,)) for i, (s, w) in enumerate(weights.items())] + [(0.0, -1, (-1,))]
        lengths = dict.fromkeys([*weights, -1], 0)
        heapq.heapify(heap)
        while len(heap) > 1:
            (a, i, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
            for s in x + y:
                lengths[s] += 1
            heapq.heappush(heap, (a + b, i, x + y))
        if max(lengths.values()) <= 16:
            lengths.pop(-1)  # the reserved code is one of the longest, so it can be the one of all ones
            return lengths
        floor = floor * 2 or sum(weights.values()) / 2**17


def table_bytes(weights: dict[int, float]) -> bytes:
    """Numbers of codes per length, then the symbols."""
    order = sorted((n, s) for s, n in code_lengths(weights).items())
    return bytes(sum(n == k for n, _ in order) for k in range(1, 17)) + bytes(s for _, s in order)


@functools.lru_cache(maxsize=1)
def own_tables() -> dict[str, bytes]:
    """Tables for the sizes that ranked bytes of text have."""
    size = (0, 2.0, 2.2, 2.4, 1.8, 0.5, 0.1, 0.05, 0.02)
    ac = {16 * run + s: size[s] * 0.17**run for run in range(16) for s in range(1, 9)} | {0xF0: 1e-4, 0: 0.15}
    return {"dc": table_bytes({s: 1.0 for s in range(10)}), "ac": table_bytes(ac), "refine": table_bytes({16 * run + 1: 0.3**run for run in range(16)} | {0xF0: 1e-3, 0: 0.8})}


def codes(spec: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Code and length of each symbol."""
    code, length = np.zeros(256, np.int64), np.zeros(256, np.int64)
    value, at = 0, 16
    for n in range(1, 17):
        for _ in range(spec[n - 1]):
            code[spec[at]], length[spec[at]] = value, n
            value, at = value + 1, at + 1
        value <<= 1
    return code, length


@functools.lru_cache(maxsize=64)
def lookup(spec: bytes) -> np.ndarray:
    """Of every 16 bits: length * 256 + symbol of the code at their start (0: none)."""
    out = np.zeros(1 << 16, np.int32)
    code, length = codes(spec)
    for s in np.flatnonzero(length):
        shift = 16 - int(length[s])
        out[int(code[s]) << shift : (int(code[s]) + 1) << shift] = length[s] * 256 + s
    return out


def magnitude(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Size category and the bits that follow its code."""
    a = np.abs(v)
    size = np.frexp(a.astype(np.float32))[1].astype(np.int64)
    return size, np.where(v < 0, v + (1 << size) - 1, v).astype(np.int64)


def packed(owner: np.ndarray, value: np.ndarray, bits: np.ndarray, n: int) -> list[bytes]:
    """The bits of each owner (0 to n - 1; items are in the owners' order) as stuffed bytes, the last one filled with ones."""
    total = np.bincount(owner, weights=bits, minlength=n).astype(np.int64)
    size = (total + 7) // 8
    start = np.concatenate([[0], np.cumsum(size)])
    place = np.cumsum(bits) - bits + (8 * start[:-1] - (np.cumsum(total) - total))[owner]
    fill = np.flatnonzero(total & 7)
    place = np.concatenate([place, 8 * start[:-1][fill] + total[fill]])
    bits = np.concatenate([bits, 8 - (total[fill] & 7)])
    value = np.concatenate([value, (1 << (8 - (total[fill] & 7))) - 1])
    # an item of at most 32 bits lies in two 32-bit words; the bits of a word are disjoint, so that sums put them together
    wide = value.astype(np.uint64) << (64 - (place & 31) - bits).astype(np.uint64)
    words = int(start[-1]) // 4 + 2
    word = np.bincount(place >> 5, weights=(wide >> np.uint64(32)).astype(np.float64), minlength=words) + np.bincount((place >> 5) + 1, weights=(wide & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=words)
    data = word.astype(">u4").view(np.uint8)[: int(start[-1])]
    stuffed = np.repeat(data, 1 + (data == 255))
    places = np.flatnonzero(data == 255)
    stuffed[places + np.arange(len(places)) + 1] = 0
    cuts = start + np.searchsorted(places, start)
    raw = stuffed.tobytes()
    return [raw[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


def ac_first(v: np.ndarray, interval: np.ndarray, n: int, spec: bytes) -> list[bytes]:
    """v: blocks x coefficients of the band, shifted already."""
    code, length = codes(spec)
    block, k = np.nonzero(v)
    before = np.where(np.concatenate([[True], block[1:] != block[:-1]]), -1, np.concatenate([[-1], k[:-1]])) if len(k) else k
    run = k - before - 1
    size, extra = magnitude(v[block, k].astype(np.int64))
    zrl = run // 16
    symbol = run % 16 * 16 + size
    value, bits = code[symbol] << size | extra, length[symbol] + size
    # ZRL codes before the coefficient's own
    times = zrl + 1
    ends = np.cumsum(times)
    own = np.zeros(int(ends[-1]) if len(ends) else 0, bool)
    own[ends - 1] = True
    value, bits, where = np.repeat(value, times), np.repeat(bits, times), np.repeat(block, times)
    value[~own], bits[~own] = code[0xF0], length[0xF0]
    last = np.full(len(v), -1)
    last[block] = k
    short = np.flatnonzero(last < v.shape[1] - 1)
    order = np.argsort(np.concatenate([where * 2, short * 2 + 1]), kind="stable")
    value = np.concatenate([value, np.full(len(short), code[0])])[order]
    bits = np.concatenate([bits, np.full(len(short), length[0])])[order]
    return packed(interval[np.concatenate([where, short])[order]], value, bits, n)


def ac_refine(v: np.ndarray, interval: np.ndarray, n: int, spec: bytes) -> list[bytes]:
    """The lowest bit of each coefficient, after a first scan of the others."""
    code, length = codes(spec)
    a = np.abs(v)
    width = v.shape[1]
    new, old, zero = a == 1, a > 1, a == 0
    zeros = np.cumsum(zero, axis=1)
    gap = np.cumsum(new, axis=1) - new  # the number of new ones before
    base = np.zeros_like(zeros)  # zeros before the gap began
    at_new = np.where(new, zeros, 0)
    base[:, 1:] = np.maximum.accumulate(at_new, axis=1)[:, :-1]
    passed = zeros - base
    tail = gap == gap[:, -1:] + new[:, -1:]  # after the last new one: the end-of-block code has their bits
    index = np.where(tail & ~new, 0, passed // 16)
    b_new, k_new = np.nonzero(new)
    run = passed[b_new, k_new]
    keys, values, sizes, blocks = [], [], [], []

    def put(block, g, i, second, k, value, bits):
        keys.append((((block * (width + 1) + g) * 8 + i) * 2 + second) * (width + 1) + k)
        values.append(value)
        sizes.append(bits)
        blocks.append(block)

    symbol = run % 16 * 16 + 1
    put(b_new, gap[b_new, k_new], run // 16, 0, 0 * k_new, code[symbol] << 1 | (v[b_new, k_new] > 0), length[symbol] + 1)
    for i in range(int(run.max()) // 16 if len(run) else 0):
        more = run // 16 > i
        put(b_new[more], gap[b_new, k_new][more], np.full(more.sum(), i), 0, 0 * k_new[more], np.full(more.sum(), code[0xF0]), np.full(more.sum(), length[0xF0]))
    b_old, k_old = np.nonzero(old)
    put(b_old, gap[b_old, k_old], index[b_old, k_old], 1, k_old, a[b_old, k_old].astype(np.int64) & 1, np.ones(len(b_old), np.int64))
    ended = np.flatnonzero(~new[:, -1])
    put(ended, gap[ended, -1], 0 * ended, 0, 0 * ended, np.full(len(ended), code[0]), np.full(len(ended), length[0]))
    order = np.argsort(np.concatenate(keys), kind="stable")
    return packed(interval[np.concatenate(blocks)[order]], np.concatenate(values)[order], np.concatenate(sizes)[order], n)


def dc_first(v: np.ndarray, interval: np.ndarray, n: int, spec: bytes) -> list[bytes]:
    code, length = codes(spec)
    first = np.concatenate([[True], interval[1:] != interval[:-1]])
    diff = v - np.where(first, 0, np.concatenate([[0], v[:-1]]))
    size, extra = magnitude(diff.astype(np.int64))
    return packed(interval, code[size] << size | extra, length[size] + size, n)


def dc_refine(v: np.ndarray, interval: np.ndarray, n: int, spec: bytes) -> list[bytes]:
    return packed(interval, v.astype(np.int64) & 1, np.ones(len(v), np.int64), n)


#: Scans of every component: first and last coefficient, high and low bit position, blocks between restarts, writer, table class and id.
SCANS = ((0, 0, 0, 1, RESTART, dc_first, "dc", 0x00), (1, 5, 0, 1, RESTART, ac_first, "ac", 0x10), (6, 63, 0, 0, HIGH_RESTART, ac_first, "ac", 0x10), (0, 0, 1, 0, RESTART, dc_refine, "dc", 0x00), (1, 5, 1, 0, RESTART, ac_refine, "refine", 0x11))


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def encode_payloads(payloads: list[bytes], sizes: list[int]) -> list[bytes]:
    """A progressive 4:2:0 JPEG per payload (whole units of 576 bytes); sizes are noted in a comment."""
    to_value, _ = byte_values()
    grids, blocks = [], []
    for p in payloads:
        mcus = -(-len(p) // 384)
        wide = int(np.ceil(mcus**0.5))
        high = -(-mcus // wide)
        grids.append((wide, high))
        v = np.zeros(wide * high * 384, np.int16)
        v[: len(p)] = to_value[np.frombuffer(p, np.uint8)]
        blocks.append(v.reshape(-1, 64))
    # all luma blocks come first, image by image, then blue, then red; a component of an image is a run of blocks
    runs = [(i, c) for c in range(3) for i in range(len(payloads))]
    part = lambda i, c: blocks[i][: 4 * grids[i][0] * grids[i][1]] if c == 0 else np.split(blocks[i][4 * grids[i][0] * grids[i][1] :], 2)[c - 1]
    v = np.concatenate([part(i, c) for i, c in runs])
    lengths = np.array([(4 if c == 0 else 1) * grids[i][0] * grids[i][1] for i, c in runs])
    tables = own_tables()
    data: dict[tuple[int, int], list[bytes]] = {run: [] for run in runs}
    for first, last, ah, al, restart, write, kind, _ in SCANS:
        per_run = -(-lengths // restart)
        starts = np.concatenate([[0], np.cumsum(per_run)])
        within = np.arange(len(v)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        interval = np.repeat(starts[:-1], lengths) + within // restart
        band = v[:, first : last + 1]
        if first == 0:
            band = band[:, 0] >> al
        elif not ah and al:
            band = np.sign(band) * (np.abs(band) >> al)
        pieces = write(band, interval, int(starts[-1]), tables[kind])
        for run, a, b in zip(runs, starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            data[run].append(b"".join(x if j == a else b"\xff" + bytes([0xD0 + (j - a - 1) % 8]) + x for j, x in zip(range(a, b), pieces[a:b], strict=True)))
    head = b"\xff\xd8" + segment(0xDB, b"\0" + b"\1" * 64)
    dht = b"".join(segment(0xC4, bytes([k]) + tables[name]) for k, name in ((0x00, "dc"), (0x10, "ac"), (0x11, "refine")))
    out = []
    for i, (p, n, (wide, high)) in enumerate(zip(payloads, sizes, grids, strict=True)):
        frame = struct.pack(">BHHB", 8, 16 * high, 16 * wide, 3) + b"\1\x22\0\2\x11\0\3\x11\0"
        parts = [head, segment(0xFE, f"bytes={n};payload={len(p)}".encode()), segment(0xC2, frame), dht]
        for s, (first, last, ah, al, restart, _, _, t) in enumerate(SCANS):
            if s == 0 or restart != SCANS[s - 1][4]:
                parts.append(segment(0xDD, struct.pack(">H", restart)))
            for c in range(3):
                parts += [segment(0xDA, bytes([1, c + 1, (t & 15) if t & 16 else 0, first, last, ah << 4 | al])), data[i, c][s]]
        out.append(b"".join([*parts, b"\xff\xd9"]))
    return out


class Image:
    """What the markers of one image say; scans refer to intervals of its entropy-coded data."""

    def __init__(self, data: bytes):
        self.comment, self.scans, self.quant, self.adobe = b"", [], {}, None
        tables: dict[int, bytes] = {}
        restart, at = 0, 2
        if data[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG")
        while True:
            while data[at : at + 2] == b"\xff\xff":  # fill bytes
                at += 1
            marker = data[at + 1]
            if data[at] != 0xFF:
                raise ValueError("a marker is missing")
            if marker == 0xD9:
                return
            (n,) = struct.unpack_from(">H", data, at + 2)
            body = data[at + 4 : at + 2 + n]
            at += 2 + n
            if marker == 0xFE:
                self.comment = body
            elif marker == 0xEE and body[:5] == b"Adobe":
                self.adobe = body[11]
            elif marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    self.quant[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.float32)
                    body = body[65 + 64 * wide :]
            elif marker == 0xC4:
                while body:
                    end = 17 + sum(body[1:17])
                    tables[body[0]] = body[1:end]
                    body = body[end:]
            elif marker == 0xDD:
                (restart,) = struct.unpack(">H", body)
            elif marker == 0xC2:
                _, self.height, self.width, count = struct.unpack_from(">BHHB", body)
                self.parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(count)]
                self.hmax, self.vmax = max(p[1] for p in self.parts), max(p[2] for p in self.parts)
                wide, high = -(-self.width // (8 * self.hmax)), -(-self.height // (8 * self.vmax))
                # blocks stand as a scan of one component goes through them: by rows of its own width
                self.sizes = [(-(-self.width * h // (8 * self.hmax)), -(-self.height * v // (8 * self.vmax))) for _, h, v, _ in self.parts]
                self.mcus = (wide, high)
            elif marker in (0xC0, 0xC1, 0xC3):
                raise ValueError("only progressive images are read")
            elif marker == 0xDA:
                end = SCAN_END.search(data, at).start()
                count = body[0]
                comps = tuple(next(i for i, p in enumerate(self.parts) if p[0] == body[1 + 2 * k]) for k in range(count))
                first, last, bits = body[1 + 2 * count], body[2 + 2 * count], body[3 + 2 * count]
                specs = tuple(b"" if first == 0 and bits >> 4 else tables[(16 | body[2 + 2 * k] & 15) if first else body[2 + 2 * k] >> 4] for k in range(count))
                # a scan of one component has it and its table, others have tuples
                which = (comps, specs) if count > 1 else (comps[0], specs[0])
                self.scans.append((which[0], first, last, bits >> 4, bits & 15, restart, which[1], RESTARTS.split(data[at:end])))
                at = end


    def mcu_blocks(self, comps: tuple[int, ...], starts: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """In the order of a scan of several components: each block's row (-1: outside the component) and its component in the scan."""
        wide, high = self.mcus
        y, x = (a.reshape(-1, 1) for a in np.mgrid[0:high, 0:wide])
        rows, slots = [], []
        for slot, (comp, start) in enumerate(zip(comps, starts, strict=True)):
            _, h, v, _ = self.parts[comp]
            across, down = self.sizes[comp]
            by, bx = (a.reshape(1, -1) for a in np.mgrid[0:v, 0:h])
            r, c = y * v + by, x * h + bx
            rows.append(np.where((r < down) & (c < across), start + r * across + c, -1))
            slots.append(np.full(rows[-1].shape, slot))
        return np.concatenate(rows, axis=1).reshape(-1), np.concatenate(slots, axis=1).reshape(-1)


RESTARTS, SCAN_END = re.compile(rb"\xff[\xd0-\xd7]"), re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")

PAYLOAD = re.compile(rb"bytes=(\d+);payload=(\d+)")


class Intervals:
    """Restart intervals that are read in lockstep: bit positions in one buffer, and the blocks that each fills."""

    def __init__(self, pieces: list[bytes], base: np.ndarray, blocks: np.ndarray, specs: list[bytes]):
        pieces = [p.replace(b"\xff\x00", b"\xff") for p in pieces]
        size = np.array([len(p) for p in pieces])
        self.end = np.cumsum(size) * 8
        self.p = self.end - size * 8
        raw = np.frombuffer(b"".join([*pieces, b"\xff" * 16]), np.uint8).astype(np.uint64)
        word = raw[:-7].copy()
        for i in range(1, 8):
            word = word << np.uint64(8) | raw[i : len(raw) - 7 + i]
        self.word, self.base, self.blocks = word, base, blocks
        kinds = {s: i for i, s in enumerate(dict.fromkeys(specs))}
        self.tables = np.concatenate([lookup(s) for s in kinds]) if b"" not in kinds else None
        self.table = np.array([kinds[s] for s in specs], np.int64) << 16

    def window(self, p: np.ndarray) -> np.ndarray:
        return self.word[p >> 3] << (p & 7).astype(np.uint64)


def take(window: np.ndarray, skip: np.ndarray, n: np.ndarray) -> np.ndarray:
    """n bits after skip bits of each window (n may be 0)."""
    return ((window << skip.astype(np.uint64)) >> np.uint64(1) >> (63 - n).astype(np.uint64)).astype(np.int64)


def extend(bits: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where((n > 0) & (bits < (1 << np.maximum(n - 1, 0))), bits - (1 << n) + 1, bits)


def read_dc(x: Intervals, coef: np.ndarray, ah: int, al: int) -> None:
    p, level = x.p.copy(), np.zeros(len(x.p), np.int64)
    for i in range(int(x.blocks.max(initial=0))):
        on = np.flatnonzero(x.blocks > i)
        w = x.window(p[on])
        if ah:
            coef[x.base[on] + i, 0] |= (w >> np.uint64(63)).astype(np.int16) << al
            p[on] += 1
            continue
        entry = x.tables[x.table[on] + (w >> np.uint64(48)).astype(np.int64)]
        length, size = entry >> 8, entry & 255
        level[on] += extend(take(w, length, size), size)
        p[on] += length + size
        coef[x.base[on] + i, 0] = level[on] << al


def read_dc_mixed(x: Intervals, coef: np.ndarray, rows: np.ndarray, slots: np.ndarray, ah: int, al: int) -> None:
    """A DC scan of several components. x: base is each interval's place in rows and slots, and table has a row per interval."""
    p, level = x.p.copy(), np.zeros(x.table.shape, np.int64)
    for i in range(int(x.blocks.max(initial=0))):
        on = np.flatnonzero(x.blocks > i)
        w, row, slot = x.window(p[on]), rows[x.base[on] + i], slots[x.base[on] + i]
        real = row >= 0
        if ah:
            coef[row[real], 0] |= (w[real] >> np.uint64(63)).astype(np.int16) << al
            p[on] += 1
            continue
        entry = x.tables[x.table[on, slot] + (w >> np.uint64(48)).astype(np.int64)]
        length, size = entry >> 8, entry & 255
        level[on, slot] += extend(take(w, length, size), size)
        p[on] += length + size
        coef[row[real], 0] = level[on, slot][real] << al


def read_ac(x: Intervals, coef: np.ndarray, first: int, last: int, al: int) -> None:
    flat = coef.reshape(-1)
    p, tables = x.p.copy(), x.table
    at, stop = x.base * 64 + first, (x.base + x.blocks) * 64  # place of the next coefficient; end of the interval's blocks
    skip = 64 - (last - first + 1)
    edge = x.base * 64 + last  # last place of the band in this block
    while len(p):
        w = x.window(p)
        entry = x.tables[tables + (w >> np.uint64(48)).astype(np.int64)]
        length, size, run = entry >> 8, entry & 15, entry >> 4 & 15
        more = np.where((size == 0) & (run < 15), run, size)
        bits = take(w, length, more)
        p += length + more
        some = np.flatnonzero(size)
        at += run
        flat[at[some]] = extend(bits[some], size[some]) << al
        at += 1
        eob = np.flatnonzero((size == 0) & (run < 15))
        if len(eob):
            edge[eob] += 64 * ((1 << run[eob]) + bits[eob] - 1)
            at[eob] = edge[eob] + 1
        over = np.flatnonzero(at > edge)
        at[over] += skip
        edge[over] += 64
        if len(over):
            on = at < stop
            if not on.all():
                p, tables, at, stop, edge = p[on], tables[on], at[on], stop[on], edge[on]


def refine_ac(x: Intervals, coef: np.ndarray, first: int, last: int, al: int) -> None:
    flat = coef.reshape(-1)
    n = len(x.p)
    p, tables, stop = x.p.copy(), x.table, (x.base + x.blocks) * 64
    at, edge = x.base * 64 + first, x.base * 64 + last
    run, value, ends, open_ = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
    while len(p):
        need = np.flatnonzero(~open_ & (ends == 0))
        if len(need):
            w = x.window(p[need])
            entry = x.tables[tables[need] + (w >> np.uint64(48)).astype(np.int64)]
            length, size, r = entry >> 8, entry & 15, entry >> 4 & 15
            eob = (size == 0) & (r < 15)
            more = np.where(eob, r, size)
            bits = take(w, length, more)
            p[need] += length + more
            run[need] = r
            value[need] = np.where(size > 0, np.where(bits > 0, 1, -1), 0) << al
            ends[need] = np.where(eob, (1 << r) + bits, 0)
            open_[need] = ~eob
        now = flat[at]
        known = np.flatnonzero(now)
        if len(known):
            bit = (x.window(p[known]) >> np.uint64(63)).astype(np.int16)
            flat[at[known]] = now[known] + np.sign(now[known]) * (bit << al)
            p[known] += 1
        zero = np.flatnonzero((now == 0) & open_)
        done = zero[run[zero] == 0]
        flat[at[done]] = value[done]
        open_[done] = False
        run[zero] -= 1
        at += 1
        over = np.flatnonzero(at > edge)
        if len(over):
            at[over] += 64 - (last - first + 1)
            edge[over] += 64
            ends[over] = np.maximum(ends[over] - 1, 0)
            open_[over] = False
            on = at < stop
            if not on.all():
                p, tables, stop, at, edge, run, value, ends, open_ = (a[on] for a in (p, tables, stop, at, edge, run, value, ends, open_))


def coefficients(images: list[Image]) -> list[list[np.ndarray]]:
    """Of each image and component: blocks x 64 quantized coefficients in zigzag order, all scans added up."""
    starts, total = {}, 0
    for i, image in enumerate(images):
        for c, (wide, high) in enumerate(image.sizes):
            starts[i, c] = total
            total += wide * high
    coef = np.zeros((total, 64), np.int16)
    for s in range(max((len(i.scans) for i in images), default=0)):
        kinds: dict[tuple, list] = {}
        mixed: dict[tuple, list] = {}
        for i, image in enumerate(images):
            if s < len(image.scans):
                comp, first, last, ah, al, restart, spec, pieces = image.scans[s]
                if isinstance(comp, tuple):
                    step = restart * sum(image.parts[c][1] * image.parts[c][2] for c in comp)
                    mixed.setdefault((len(comp), ah, al), []).append((*image.mcu_blocks(comp, [starts[i, c] for c in comp]), step, spec, pieces))
                    continue
                kinds.setdefault((first, last, ah, al), []).append((starts[i, comp], image.sizes[comp][0] * image.sizes[comp][1], restart, spec, pieces))
        for (count, ah, al), group in mixed.items():
            pieces, base, blocks, specs, start = [], [], [], [], 0
            for rows, _, restart, own, found in group:
                step = restart or len(rows)
                pieces += found
                base += range(start, start + len(rows), step)
                blocks += [min(step, len(rows) - b) for b in range(0, len(rows), step)]
                specs += [own] * len(found)
                start += len(rows)
            x = Intervals(pieces, np.array(base, np.int64), np.array(blocks, np.int64), [t for own in specs for t in own])
            x.table = x.table.reshape(-1, count)
            read_dc_mixed(x, coef, np.concatenate([g[0] for g in group]), np.concatenate([g[1] for g in group]), ah, al)
        for (first, last, ah, al), group in kinds.items():
            pieces, base, blocks, specs = [], [], [], []
            for start, n, restart, spec, found in group:
                step = restart or n
                pieces += found
                base += range(start, start + n, step)
                blocks += [min(step, start + n - b) for b in range(start, start + n, step)]
                specs += [spec] * len(found)
            x = Intervals(pieces, np.array(base, np.int64), np.array(blocks, np.int64), specs)
            if first == 0:
                read_dc(x, coef, ah, al)
            elif ah:
                refine_ac(x, coef, first, last, al)
            else:
                read_ac(x, coef, first, last, al)
    return [[coef[starts[i, c] : starts[i, c] + w * h] for c, (w, h) in enumerate(image.sizes)] for i, image in enumerate(images)]


@functools.lru_cache(maxsize=1)
def transform() -> np.ndarray:
    """The orthonormal cosine basis, a row per frequency."""
    k, x = np.mgrid[0:8, 0:8]
    return (np.where(k == 0, 0.125**0.5, 0.5) * np.cos((2 * x + 1) * k * np.pi / 16)).astype(np.float32)


def to_rgb(image: Image, coef: list[np.ndarray]) -> np.ndarray:
    """Height x width x 3 bytes: dequantize, inverse-transform, upsample by repetition, convert."""
    planes, basis, order = [], transform(), zigzag()
    for (_, h, v, q), c, (wide, high) in zip(image.parts, coef, image.sizes, strict=True):
        natural = np.empty((len(c), 64), np.float32)
        natural[:, order] = c * image.quant[q]
        rows = (natural.reshape(-1, 8) @ basis).reshape(-1, 8, 8)  # along each row
        cells = (rows.transpose(0, 2, 1).reshape(-1, 8) @ basis).reshape(high, wide, 8, 8)  # along each column; x, then y
        plane = cells.transpose(0, 3, 1, 2).reshape(high * 8, wide * 8) + np.float32(128)
        if image.vmax % v or image.hmax % h:
            plane = plane[np.ix_(np.arange(image.height) * v // image.vmax, np.arange(image.width) * h // image.hmax)]
        else:
            plane = np.repeat(np.repeat(plane, image.vmax // v, axis=0), image.hmax // h, axis=1)
        planes.append(np.clip(np.rint(plane[: image.height, : image.width]), 0, 255))
    if len(planes) == 1:
        return np.repeat(planes[0][:, :, None], 3, axis=2).astype(np.uint8)
    if image.adobe == 0 or (len(planes) == 4 and image.adobe != 2):  # RGB or CMYK as they are
        rgb = np.stack(planes[:3], axis=2)
    else:
        y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
        rgb = np.stack([y + np.float32(1.402) * cr, y - np.float32(0.344136) * cb - np.float32(0.714136) * cr, y + np.float32(1.772) * cb], axis=2)
    if len(planes) == 4:  # Adobe stores inks inverted
        rgb, key = (np.clip(rgb, 0, 255), planes[3]) if image.adobe is not None else (255 - rgb, 255 - planes[3])
        rgb = rgb * key[:, :, None] / 255
    return np.clip(np.rint(rgb), 0, 255).astype(np.uint8)


def decode_images(media: list[bytes]) -> list[tuple[Image, list[np.ndarray], np.ndarray]]:
    """Image, coefficients and RGB tensor of each."""
    images = [Image(m) for m in media]
    return [(i, c, to_rgb(i, c)) for i, c in zip(images, coefficients(images), strict=True)]


def read_payload(image: Image, coef: list[np.ndarray]) -> tuple[int, bytes] | None:
    """The unpadded size and the payload that encode_payloads has stored; None for images of other encoders."""
    stored = PAYLOAD.fullmatch(image.comment)
    if stored is None:
        return None
    n, size = map(int, stored.groups())
    return n, byte_values()[1][np.concatenate(coef).reshape(-1)[:size] + 127].tobytes()


def tensor_feature(rgb: np.ndarray) -> str:
    """Shape, the sum of each channel and eight brightness bins: whole numbers, equal for equal tensors."""
    sums = rgb.reshape(-1, 3).sum(axis=0, dtype=np.int64)
    bins = np.bincount(rgb[:, :, 1].reshape(-1) >> 5, minlength=8)
    return f"{rgb.shape[1]}x{rgb.shape[0]};" + ",".join(map(str, sums)) + ";" + ",".join(map(str, bins))


def grouped(rows: Iterator[tuple], size) -> Iterator[list[tuple]]:
    out, n = [], 0
    for row in rows:
        out.append(row)
        n += size(row)
        if n >= CHUNK:
            yield out
            out, n = [], 0
    if out:
        yield out


def encode_column(docs: DataFrame) -> DataFrame:
    """doc_id and media (binary) for docs (doc_id, text): the text's UTF-8 bytes, filled with 255 to whole units, as a progressive JPEG."""
    ship_package(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        for columns in rows_of(batches, "doc_id", "text"):
            rows = ((i, (t or "").encode("utf-8")) for i, t in zip(*columns, strict=True))
            for part in grouped(rows, lambda row: len(row[1])):
                payloads = [b + b"\xff" * (max(1, -(-len(b) // UNIT)) * UNIT - len(b)) for _, b in part]
                media = encode_payloads(payloads, [len(b) for _, b in part])
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in part], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "media"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, media binary")


def decode_column(media: DataFrame, tensors: bool = False) -> DataFrame:
    """What the stored bytes hold: sizes and digests of the payload and the media, and a feature; tensors adds height, width and rgb (binary, rows of RGB bytes).

    Progressive images of other encoders have no payload: its columns are null. Null media have nulls in all columns but
    doc_id. Anything else that isn't a progressive JPEG is an error.
    """
    ship_package(media.sparkSession)
    schema = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    schema += ", height int, width int, rgb binary" if tensors else ""
    names = [c.split()[0] for c in schema.split(", ")]
    types = [c.split()[1] for c in schema.split(", ")]

    def run(batches):
        import pyarrow as pa

        kinds = [{"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}[t] for t in types]
        for columns in rows_of(batches, "doc_id", "media"):
            rows = ((i, m, None if m is None else Image(m)) for i, m in zip(*columns, strict=True))
            # an image of few bytes may have many coefficients
            for part in grouped(rows, lambda row: 0 if row[1] is None else max(len(row[1]), 32 * sum(w * h for w, h in row[2].sizes))):
                out = []
                coefs = iter(coefficients([image for _, _, image in part if image is not None]))
                for i, m, image in part:
                    if image is None:
                        out.append((i, *[None] * (len(names) - 1)))
                        continue
                    coef = next(coefs)
                    rgb, stored = to_rgb(image, coef), read_payload(image, coef)
                    held = (None,) * 4 if stored is None else (stored[0], len(stored[1]), hashlib.sha256(stored[1]).hexdigest(), zlib.crc32(stored[1][-32:]))
                    row = (i, *held, len(m), hashlib.sha256(m).hexdigest(), tensor_feature(rgb))
                    out.append(row + ((*rgb.shape[:2], rgb.tobytes()) if tensors else ()))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return media.select("doc_id", "media").mapInArrow(run, schema)


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents as a progressive JPEG, written to the shared folder, and back. Null and empty texts are one unit of 255s; rows may repeat."""
    return decode_column(materialize(encode_column(table(spark, sf_dir, "documents")), "media"))
