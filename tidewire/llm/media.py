"""Media columns: progressive JPEG, encoded and decoded for many images at once with numpy.

Decoding follows the progressive process of ITU-T T.81: every scan (a spectral band at a successive-approximation bit)
is accumulated into the coefficient arrays; only then come dequantisation, the inverse transform, chroma upsampling and
the conversion to a full-resolution RGB tensor. Entropy decoding runs in lockstep: the restart intervals of all images of
a chunk are lanes, and each numpy step decodes one symbol of every lane, so work per symbol does not depend on how the
symbols are dealt over images. The decoder reads any Huffman-coded progressive file of 8 bits with one to three
components: interleaved DC scans, zero runs, end-of-band runs, refinement with new coefficients, with or without restarts.

The payload codec stores bytes losslessly in the format's unit, the quantised coefficient: byte b is coefficient
b - 126 if b >= 128, else b - 129, so that every coefficient is nonzero after the first scan of its band. Blocks are filled
component by component (luma, then both chroma planes at half resolution), the tail with blanks.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import released, text_bytes, text_chunks
from tidewire.llm.words import ranges

UNIT = 192
#: Blocks in a restart interval of the encoder.
RESTART = 8
U64 = np.uint64


def _zigzag() -> np.ndarray:
    """Natural index of each zigzag position."""
    order = sorted(((y, x) for y in range(8) for x in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    return np.array([y * 8 + x for y, x in order])


ZIGZAG = _zigzag()


def _basis(scale: int) -> np.ndarray:
    """Matrix from zigzag coefficients to samples in natural order, times scale, rounded to integers."""
    c = np.array([np.sqrt(0.125)] + [0.5] * 7)
    one = c[:, None] * np.cos((2 * np.arange(8)[None, :] + 1) * np.arange(8)[:, None] * np.pi / 16)
    return np.rint(np.einsum("uy,vx->uvyx", one, one).reshape(64, 64)[ZIGZAG] * scale)


SCALE = 1 << 11
BASIS = _basis(SCALE)


# --- Huffman tables ------------------------------------------------------------------------------------------------


def _dc_lengths() -> dict[int, int]:
    return {size: 4 for size in range(12)}


def _ac_lengths() -> dict[int, int]:
    """Code length of each run/size symbol of the encoder: short without a run, 8 bits for runs of blocks, 9 for the rest."""
    out = {}
    for run in range(16):
        for size in range(11):
            out[run << 4 | size] = 8 if size == 0 or (run == 0 and size > 8) else 4 if run == 0 else 9
    return out


def canonical(lengths: dict[int, int]) -> tuple[dict[int, int], bytes]:
    """Code of each symbol, and the table as it stands in a DHT segment."""
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    code, last, codes = 0, 0, {}
    for s in order:
        code <<= lengths[s] - last
        last = lengths[s]
        codes[s] = code
        code += 1
    if code > (1 << last) - 1:
        raise ValueError("code lengths leave no unused code")
    counts = bytes(sum(v == n for v in lengths.values()) for n in range(1, 17))
    return codes, counts + bytes(order)


DC_LENGTHS, AC_LENGTHS = _dc_lengths(), _ac_lengths()
DC_CODES, DC_TABLE = canonical(DC_LENGTHS)
AC_CODES, AC_TABLE = canonical(AC_LENGTHS)


@lru_cache(maxsize=64)
def _lookup(table: bytes) -> np.ndarray:
    """By the next 16 bits: code length times 256 plus symbol, 0 where there is no code."""
    out, code, at = np.zeros(65536, np.uint16), 0, 16
    for n in range(1, 17):
        for _ in range(table[n - 1]):
            out[code << (16 - n) : (code + 1) << (16 - n)] = n << 8 | table[at]
            code, at = code + 1, at + 1
        code <<= 1
    return out


# --- Encoder -------------------------------------------------------------------------------------------------------


def _size(v: np.ndarray) -> np.ndarray:
    """Bits of the magnitude."""
    return np.frexp(np.abs(v).astype(np.float32))[1].astype(np.int64)


def _words(v: np.ndarray, codes: dict[int, int], lengths: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Code of the size without a run, followed by the magnitude bits; and its length."""
    s = _size(v)
    code = np.array([codes[i] for i in range(11)])
    length = np.array([lengths[i] for i in range(11)])
    return code[s] << s | np.where(v < 0, v + (1 << s) - 1, v), length[s] + s


_RANGE = np.arange(-129, 130)
_AC_WORD, _AC_LENGTH = (x.astype(np.int64) for x in _words(np.sign(_RANGE) * (np.abs(_RANGE) >> 1), AC_CODES, AC_LENGTHS))
_DC_SPAN = np.arange(-256, 257)
_DC_WORD, _DC_LENGTH = (x.astype(np.int64) for x in _words(_DC_SPAN, DC_CODES, DC_LENGTHS))


def _lanes_of(blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For scans of so many blocks each: lanes of each scan, blocks of each lane, number of each lane in its scan."""
    count = -(-blocks // RESTART)
    number = ranges(np.zeros_like(count), count)
    scan = np.repeat(np.arange(len(blocks)), count)
    return count, np.minimum(RESTART, blocks[scan] - number * RESTART), number


def _pack(words: np.ndarray, lengths: np.ndarray, per_lane: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all lanes, each filled with ones to whole bytes, and the bytes of each lane. per_lane: words of each lane."""
    ends = np.cumsum(lengths)
    last = np.cumsum(per_lane) - 1
    total = ends[last] - np.concatenate([[0], ends[last[:-1]]])
    size = -(-total // 8)
    start = (np.cumsum(size) - size) * 8
    at = ends - lengths + np.repeat(start - (ends[last] - total), per_lane)
    fill = size * 8 - total
    at = np.concatenate([at, start + total])
    words = np.concatenate([words, (1 << fill) - 1])
    lengths = np.concatenate([lengths, fill])
    word, room = at >> 5, 32 - (at & 31) - lengths
    n = int(size.sum())
    cells = -(-n // 4) + 1
    low = np.maximum(-room, 0)
    packed = np.bincount(word, np.where(room >= 0, words << np.maximum(room, 0), words >> low), cells)
    over = np.flatnonzero(low)
    packed += np.bincount(word[over] + 1, (words[over] & ((1 << low[over]) - 1)) << (32 - low[over]), cells)
    return packed.astype(np.int64).astype(">u4").view(np.uint8)[:n], size


def _pack_bits(bits: np.ndarray, per_lane: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for single bits."""
    size = -(-per_lane // 8)
    out = np.ones(int(size.sum()) * 8, np.uint8)
    out[ranges((np.cumsum(size) - size) * 8, per_lane)] = bits
    return np.packbits(out), size


def _entropy(data: np.ndarray, size: np.ndarray, number: np.ndarray, lanes: np.ndarray) -> list[bytes]:
    """The coded segment of each scan: zero bytes stuffed after 0xFF, restart markers between lanes."""
    last = np.cumsum(lanes) - 1
    marked = np.ones(len(size), bool)
    marked[last] = False
    full = data == 255
    before = np.cumsum(full) - full
    marks = np.cumsum(marked) - marked
    lane = np.repeat(np.arange(len(size)), size)
    out = np.zeros(len(data) + int(full.sum()) + 2 * int(marked.sum()), np.uint8)
    out[np.arange(len(data)) + before + 2 * marks[lane]] = data
    ends = np.cumsum(size)
    stuffed = np.concatenate([[0], np.cumsum(full)])[ends]
    to = ends + stuffed + 2 * marks
    out[to[marked]] = 255
    out[to[marked] + 1] = 0xD0 + number[marked] % 8
    cut = np.concatenate([[0], to[last]])
    raw = out.tobytes()
    return [raw[a:b] for a, b in zip(cut.tolist(), cut[1:].tolist())]


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


_TABLES = _segment(0xDB, b"\0" + b"\1" * 64) + _segment(0xC4, b"\x00" + DC_TABLE + b"\x10" + AC_TABLE) + _segment(0xDD, struct.pack(">H", RESTART))


def _sos(component: int, first: int, last: int, high: int, low: int) -> bytes:
    return _segment(0xDA, bytes([1, component, 0, first, last, high << 4 | low]))


_SCANS = [(0, 0, 0, 1), (1, 63, 0, 1), (0, 0, 1, 0), (1, 63, 1, 0)]
_HEADS = [[_sos(c, *scan) for c in (1, 2, 3)] for scan in _SCANS]


def layout(units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Luma blocks across and down for payloads of so many units, and the blocks of all components together."""
    half = -(-units // 8191)
    down = -(-units // half)
    return 2 * half, down, 2 * half * down + 2 * half * -(-down // 2)


def encode_many(payloads: list[bytes], lengths: list[int]) -> list[bytes]:
    """A progressive JPEG file for each payload of a positive multiple of 192 bytes; lengths: what counts of each, kept in a comment."""
    units = np.array([len(p) // UNIT for p in payloads])
    across, down, blocks = layout(units)
    data = np.full((int(blocks.sum()), 64), 32, np.uint8)
    start = np.cumsum(blocks) - blocks
    data[ranges(start, 3 * units)] = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, 64)
    coef = data.astype(np.int16)
    coef += np.where(coef >= 128, -126, -129).astype(np.int16)
    luma, chroma = across * down, (across // 2) * -(-down // 2)
    per_scan = np.stack([luma, chroma, chroma], 1).ravel()
    lanes, held, number = _lanes_of(per_scan)
    coded = []
    dc = coef[:, 0].astype(np.int64)
    high = dc >> 1
    diff = np.diff(high, prepend=0)
    first = np.cumsum(held) - held
    diff[first] = high[first]
    coded.append(_entropy(*_pack(_DC_WORD[diff + 256], _DC_LENGTH[diff + 256], held), number, lanes))
    ac = coef[:, 1:].ravel() + 129
    coded.append(_entropy(*_pack(_AC_WORD[ac], _AC_LENGTH[ac], held * 63), number, lanes))
    coded.append(_entropy(*_pack_bits((dc & 1).astype(np.uint8), held), number, lanes))
    run = np.frexp(held.astype(np.float32))[1].astype(np.int64) - 1
    head = 8 + run
    bits = np.zeros(int((head + held * 63).sum()), np.uint8)
    lane_at = np.cumsum(head + held * 63) - (head + held * 63)
    for r in np.unique(run):
        at = np.flatnonzero(run == r)
        value = (AC_CODES[int(r) << 4] << int(r)) | (held[at] - (1 << int(r)))
        for i in range(8 + int(r)):
            bits[lane_at[at] + i] = value >> (7 + int(r) - i) & 1
    bits[ranges(lane_at + head, held * 63)] = (np.abs(coef[:, 1:]) & 1).astype(np.uint8).ravel()
    coded.append(_entropy(*_pack_bits(bits, head + held * 63), number, lanes))
    out = []
    for i, n in enumerate(lengths):
        parts = [b"\xff\xd8", _segment(0xFE, b"payload %d" % n), _TABLES, _segment(0xC2, struct.pack(">BHHB", 8, int(down[i]) * 8, int(across[i]) * 8, 3) + b"\x01\x22\x00\x02\x11\x00\x03\x11\x00")]
        for heads, scan in zip(_HEADS, coded):
            for c in range(3):
                parts += [heads[c], scan[3 * i + c]]
        out.append(b"".join([*parts, b"\xff\xd9"]))
    return out


# --- Decoder -------------------------------------------------------------------------------------------------------


@dataclass
class Image:
    width: int
    height: int
    comment: bytes = b""
    sampling: list[tuple[int, int]] = field(default_factory=list)
    quant: list[np.ndarray] = field(default_factory=list)
    #: First row of each component in the coefficient array, its blocks across and down, as padded to whole MCUs and as they count alone.
    first: list[int] = field(default_factory=list)
    padded: list[tuple[int, int]] = field(default_factory=list)
    alone: list[tuple[int, int]] = field(default_factory=list)
    scans: list[tuple] = field(default_factory=list)


def _parse(raw: bytes, base: int, row: int) -> tuple[Image, int]:
    """Headers of one file; base: its place in the chunk; row: the first free coefficient row. Returns the next free row."""
    if raw[:2] != b"\xff\xd8":
        raise ValueError("no JPEG file")
    at, quants, tables, restart, image, ids = 2, {}, {}, 0, None, []
    comment = b""
    while True:
        at = raw.find(b"\xff", at)
        if at < 0 or at + 4 > len(raw):
            break
        marker = raw[at + 1]
        if marker in (0xFF, 0x00) or 0xD0 <= marker <= 0xD8:
            at += 1 if marker == 0xFF else 2
            continue
        if marker == 0xD9:
            break
        size = raw[at + 2] << 8 | raw[at + 3]
        body, at = raw[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xDB:
            while body:
                wide = 1 + (body[0] >> 4)
                quants[body[0] & 15] = np.frombuffer(body[1 : 1 + 64 * wide], ">u2" if wide == 2 else np.uint8).astype(np.float64)
                body = body[1 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                n = 17 + sum(body[1:17])
                tables[body[0]] = body[1:n]
                body = body[n:]
        elif marker == 0xDD:
            restart = body[0] << 8 | body[1]
        elif marker == 0xFE:
            comment = body
        elif marker == 0xC2:
            _, height, width, n = struct.unpack(">BHHB", body[:6])
            image = Image(width, height)
            spec = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            hs, vs = max(s[1] for s in spec), max(s[2] for s in spec)
            for i, h, v, q in spec:
                ids.append(i)
                image.sampling.append((h, v))
                image.quant.append(quants[q])
                image.alone.append((-(-width * h // (8 * hs)), -(-height * v // (8 * vs))))
                image.padded.append((-(-width // (8 * hs)) * h, -(-height // (8 * vs)) * v))
                image.first.append(row)
                row += image.padded[-1][0] * image.padded[-1][1]
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError("no progressive Huffman file")
        elif marker == 0xDA:
            if image is None:
                raise ValueError("scan before frame")
            n = body[0]
            parts = tuple((ids.index(body[1 + 2 * i]), tables.get(body[2 + 2 * i] >> 4), tables.get(0x10 | body[2 + 2 * i] & 15)) for i in range(n))
            first, last, bits = body[1 + 2 * n : 4 + 2 * n]
            image.scans.append((parts, first, last, bits >> 4, bits & 15, restart, base + at))
    if image is None:
        raise ValueError("no frame")
    image.comment = comment
    return image, row


def _blocks(image: Image, parts: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Coefficient row and part number of each block of a scan in coded order."""
    if len(parts) == 1:
        c = parts[0][0]
        (w, h), pw = image.alone[c], image.padded[c][0]
        rows = image.first[c] + (np.arange(h)[:, None] * pw + np.arange(w)).ravel()
        return rows, np.zeros(len(rows), np.int64)
    rows, number = [], []
    across, down = image.padded[parts[0][0]][0] // image.sampling[parts[0][0]][0], image.padded[parts[0][0]][1] // image.sampling[parts[0][0]][1]
    my, mx = np.mgrid[0:down, 0:across]
    for i, (c, _, _) in enumerate(parts):
        h, v = image.sampling[c]
        for y in range(v):
            for x in range(h):
                rows.append(image.first[c] + ((my * v + y) * image.padded[c][0] + mx * h + x).ravel())
                number.append(i)
    return np.stack(rows, 1).ravel(), np.tile(np.array(number), across * down)


class _Stream:
    """The chunk's bytes without stuffing, readable at any bit."""

    def __init__(self, raw: np.ndarray):
        stuffed = np.zeros(len(raw), bool)
        stuffed[1:] = (raw[1:] == 0) & (raw[:-1] == 255)
        self.dropped = np.cumsum(stuffed)
        self.bytes = np.concatenate([raw[~stuffed], np.full(8, 255, np.uint8)])
        wide = self.bytes.astype(U64)
        n = len(wide) - 4
        self.words = wide[:n] << U64(56)
        for i in range(1, 5):
            self.words |= wide[i : n + i] << U64(56 - 8 * i)
        follows = np.append(raw[1:], np.uint8(0))
        self.marks = np.flatnonzero((raw == 255) & (follows != 0) & (follows != 255))
        plain = (follows[self.marks] & 0xF8) != 0xD0
        after = np.where(plain, np.arange(len(plain)), len(plain))
        self.end = np.minimum.accumulate(after[::-1])[::-1] if len(after) else after

    def lanes(self, at: int) -> np.ndarray:
        """Raw positions of the restart intervals of the scan that begins there."""
        i = int(np.searchsorted(self.marks, at))
        j = int(self.end[i]) if i < len(self.end) else len(self.marks)
        return np.concatenate([[at], self.marks[i:j] + 2])

    def bit(self, raw_at: np.ndarray) -> np.ndarray:
        return (raw_at - self.dropped[np.maximum(raw_at - 1, 0)]) * 8

    def peek(self, pos: np.ndarray) -> np.ndarray:
        at = np.minimum(pos >> 3, len(self.words) - 1)
        return self.words[at] << (pos & 7).astype(U64)


def _take(x: np.ndarray, skip: np.ndarray, n: np.ndarray) -> np.ndarray:
    """n bits of x after the first skip ones."""
    return (((x << skip.astype(U64)) >> U64(1)) >> (63 - n).astype(U64)).astype(np.int64)


def _dc_first(s: _Stream, luts: np.ndarray, pos: np.ndarray, at: np.ndarray, end: np.ndarray, rows: np.ndarray, part: np.ndarray, lut_of: np.ndarray, low: int, coef: np.ndarray) -> None:
    last = np.zeros((len(pos), 4), np.int64)
    lane = np.arange(len(pos))
    while len(lane):
        x = s.peek(pos)
        p = part[at]
        e = luts[lut_of[lane, p], (x >> U64(48)).astype(np.int64)].astype(np.int64)
        n, size = e >> 8, np.minimum(e & 255, 15)
        v = _take(x, n, size)
        v -= np.where((v < (1 << size >> 1)) & (size > 0), (1 << size) - 1, 0)
        pos = pos + n + size
        v += last[lane, p]
        last[lane, p] = v
        coef[rows[at], 0] = v << low
        at = at + 1
        live = (at < end) & (n > 0)
        if not live.all():
            lane, pos, at, end = lane[live], pos[live], at[live], end[live]


def _dc_refine(s: _Stream, pos: np.ndarray, at: np.ndarray, end: np.ndarray, rows: np.ndarray, low: int, coef: np.ndarray) -> None:
    n = end - at
    bit = ranges(pos, n)
    value = s.bytes[np.minimum(bit >> 3, len(s.bytes) - 1)] >> (7 - (bit & 7)) & 1
    coef[rows[ranges(at, n)], 0] |= value.astype(coef.dtype) << low


def _ac_first(s: _Stream, luts: np.ndarray, pos: np.ndarray, at: np.ndarray, end: np.ndarray, rows: np.ndarray, lut_of: np.ndarray, first: int, last: int, low: int, coef: np.ndarray) -> None:
    flat = coef.reshape(-1)
    k = np.full(len(pos), first)
    lut = luts[0] if len(luts) == 1 else None
    while len(pos):
        x = s.peek(pos)
        code = (x >> U64(48)).astype(np.int64)
        e = (lut[code] if lut is not None else luts[lut_of, code]).astype(np.int64)
        n, run, size = e >> 8, e >> 4 & 15, e & 15
        value = size > 0
        if value.all():
            bits = _take(x, n, size)
            pos = pos + n + size
            k = k + run
            bits -= np.where(bits < (1 << size >> 1), (1 << size) - 1, 0)
            ok = k <= last
            flat[rows[at[ok]] * 64 + k[ok]] = bits[ok] << low
            k = k + 1
        else:
            band = ~value & (run < 15)
            more = np.where(value, size, np.where(band, run, 0))
            bits = _take(x, n, more)
            pos = pos + n + more
            k = k + np.where(value, run, np.where(band, 0, 16))
            set_ = value & (k <= last)
            v = bits - np.where(bits < (1 << size >> 1), (1 << size) - 1, 0)
            flat[rows[at[set_]] * 64 + k[set_]] = v[set_] << low
            k = k + value
            at = at + np.where(band, (1 << run) + bits, 0)
            k = np.where(band, first, k)
        wrap = k > last
        at = at + wrap
        k = np.where(wrap, first, k)
        live = (at < end) & (n > 0)
        if not live.all():
            pos, at, end, k = pos[live], at[live], end[live], k[live]
            lut_of = lut_of[live]


def _correct(s: _Stream, pos: np.ndarray, lane_rows: np.ndarray, counts: np.ndarray, mask: np.ndarray, first: int, low: int, coef: np.ndarray) -> np.ndarray:
    """Reads a correction bit for each masked coefficient; counts: rows of mask for each lane. Returns bits read by each lane."""
    r, c = np.nonzero(mask)
    per_row = mask.sum(1)
    lane_of_row = np.repeat(np.arange(len(counts)), counts)
    read = np.bincount(lane_of_row, per_row, len(counts)).astype(np.int64)
    bit = ranges(pos, read)
    on = (s.bytes[np.minimum(bit >> 3, len(s.bytes) - 1)] >> (7 - (bit & 7)) & 1).astype(bool)
    r, c = lane_rows[r[on]], c[on] + first
    v = coef[r, c]
    step = np.where(v > 0, 1 << low, -(1 << low)).astype(coef.dtype)
    coef[r, c] = v + np.where(np.abs(v) >> low & 1, 0, step)
    return read


def _ac_refine(s: _Stream, luts: np.ndarray, pos: np.ndarray, at: np.ndarray, end: np.ndarray, rows: np.ndarray, lut_of: np.ndarray, first: int, last: int, low: int, coef: np.ndarray) -> None:
    k = np.full(len(pos), first)
    columns = np.arange(first, last + 1)
    while len(pos):
        x = s.peek(pos)
        e = luts[lut_of, (x >> U64(48)).astype(np.int64)].astype(np.int64)
        n, run, size = e >> 8, e >> 4 & 15, e & 15
        band = (size == 0) & (run < 15)
        more = np.where(band, run, np.where(size > 0, 1, 0))
        bits = _take(x, n, more)
        pos = pos + n + more
        if (b := np.flatnonzero(band)).size:
            count = np.minimum((1 << run[b]) + bits[b], end[b] - at[b])
            held = rows[ranges(at[b], count)]
            mask = coef[held, first : last + 1] != 0
            start = np.cumsum(count) - count
            mask[start] &= columns >= k[b][:, None]
            pos[b] += _correct(s, pos[b], held, count, mask, first, low, coef)
            at[b] += count
            k[b] = first
        if (b := np.flatnonzero(~band)).size:
            held = rows[at[b]]
            history = coef[held, first : last + 1] != 0
            inside = columns >= k[b][:, None]
            zeros = np.cumsum(~history & inside, axis=1)
            hit = zeros >= (run[b] + 1)[:, None]
            to = np.where(hit.any(1), first + hit.argmax(1), last + 1)
            pos[b] += _correct(s, pos[b], held, np.ones(len(b), np.int64), history & inside & (columns < to[:, None]), first, low, coef)
            new = (size[b] > 0) & (to <= last)
            coef[held[new], to[new]] = np.where(bits[b][new] > 0, 1 << low, -(1 << low))
            k[b] = to + 1
            wrap = k[b] > last
            at[b] += wrap
            k[b] = np.where(wrap, first, k[b])
        live = (at < end) & (n > 0)
        if not live.all():
            pos, at, end, k, lut_of = pos[live], at[live], end[live], k[live], lut_of[live]


def decode_many(files: list[bytes]) -> tuple[list[Image], np.ndarray]:
    """Headers of each file, and the quantised coefficients of all: a row of 64 in zigzag order for each block."""
    images, row, base = [], 0, 0
    for raw in files:
        image, row = _parse(raw, base, row)
        images.append(image)
        base += len(raw)
    coef = np.zeros((row, 64), np.int16)
    stream = _Stream(np.frombuffer(b"".join(files), np.uint8))
    for turn in range(max((len(i.scans) for i in images), default=0)):
        groups: dict[tuple, list] = {}
        for image in images:
            if turn < len(image.scans):
                parts, first, last, high, low, restart, at = image.scans[turn]
                groups.setdefault((first, last, high, low), []).append((image, parts, restart, at))
        for (first, last, high, low), members in groups.items():
            rows, part, pos, begin, stop, lut_of, luts, held = [], [], [], [], [], [], {}, 0
            for image, parts, restart, at in members:
                r, p = _blocks(image, parts)
                unit = len(r) if not restart else restart * (1 if len(parts) == 1 else sum(image.sampling[c][0] * image.sampling[c][1] for c, _, _ in parts))
                starts = stream.lanes(at)
                edge = np.minimum(np.arange(len(starts) + 1) * unit, len(r))
                begin.append(edge[:-1] + held)
                stop.append(edge[1:] + held)
                pos.append(stream.bit(starts))
                own = [luts.setdefault(t[1] if first == 0 else t[2], len(luts)) for t in parts]
                lut_of.append(np.tile((own + own[-1:] * 4)[:4], (len(starts), 1)))
                rows.append(r)
                part.append(p)
                held += len(r)
            rows, part, pos, begin, stop, lut_of = (np.concatenate(x) for x in (rows, part, pos, begin, stop, lut_of))
            some = begin < stop
            pos, begin, stop, lut_of = pos[some], begin[some], stop[some], lut_of[some]
            if first == 0 and high:
                _dc_refine(stream, pos, begin, stop, rows, low, coef)
                continue
            codes = np.stack([_lookup(t) for t in luts])
            if first == 0:
                _dc_first(stream, codes, pos, begin, stop, rows, part, lut_of, low, coef)
            elif not high:
                _ac_first(stream, codes, pos, begin, stop, rows, lut_of[:, 0], first, last, low, coef)
            else:
                _ac_refine(stream, codes, pos, begin, stop, rows, lut_of[:, 0], first, last, low, coef)
    return images, coef


def samples(images: list[Image], coef: np.ndarray) -> np.ndarray:
    """Inverse transform of every block to 8-bit samples in natural order. Small values use single precision, where all sums are whole numbers and exact."""
    quant = np.ones((1, 64))
    if any((q != 1).any() for i in images for q in i.quant):
        quant = np.empty((len(coef), 64))
        for i in images:
            for c, q in enumerate(i.quant):
                quant[i.first[c] : i.first[c] + i.padded[c][0] * i.padded[c][1]] = q
    kind = np.float32 if len(quant) == 1 and len(coef) and int(np.abs(coef).max()) < 400 else np.float64
    out = (coef.astype(kind) * quant.astype(kind)) @ BASIS.astype(kind)
    out += kind(SCALE * 128 + SCALE // 2)
    out *= kind(1 / SCALE)
    np.floor(out, out=out)
    np.clip(out, 0, 255, out=out)
    return out.astype(np.uint8)


def rgb(image: Image, blocks: np.ndarray) -> np.ndarray:
    """The full-resolution tensor (height, width, channels) of one image; blocks: samples() of the chunk."""
    planes = []
    hs, vs = max(h for h, _ in image.sampling), max(v for _, v in image.sampling)
    for c, (h, v) in enumerate(image.sampling):
        w, d = image.padded[c]
        plane = blocks[image.first[c] : image.first[c] + w * d].reshape(d, w, 8, 8).transpose(0, 2, 1, 3).reshape(d * 8, w * 8)
        if vs // v > 1:
            plane = plane.repeat(vs // v, axis=0)
        if hs // h > 1:
            plane = plane.repeat(hs // h, axis=1)
        planes.append(plane[: image.height, : image.width])
    if len(planes) < 3:
        return np.repeat(planes[0][:, :, None], 3, axis=2)
    y = planes[0].astype(np.int32) << 16
    out = np.empty((*y.shape, 3), np.uint8)
    for i, (red, blue) in enumerate(_TO_RGB):
        out[:, :, i] = np.clip((y + red[planes[2]] + blue[planes[1]] + 32768) >> 16, 0, 255)
    return out


def _to_rgb() -> list[tuple[np.ndarray, np.ndarray]]:
    """By channel: what each Cr and each Cb sample adds, in 65536ths."""
    d = np.arange(256) - 128
    return [tuple(np.rint(f * 65536 * d).astype(np.int32) for f in pair) for pair in ((1.402, 0.0), (-0.714136286, -0.344136286), (0.0, 1.772))]


_TO_RGB = _to_rgb()


def payload(image: Image, coef: np.ndarray) -> bytes:
    """The stored bytes, read back from the coefficients."""
    held = coef[image.first[0] : image.first[0] + sum(w * h for w, h in image.padded)]
    if image.alone != image.padded:
        held = np.concatenate([coef[f + (np.arange(h)[:, None] * pw + np.arange(w)).ravel()] for f, (w, h), (pw, _) in zip(image.first, image.alone, image.padded)])
    n = int(image.comment.split()[1])
    size = max(UNIT, -(-n // UNIT) * UNIT)
    flat = held.reshape(-1)[:size]
    return (flat + np.where(flat > 0, 126, 129).astype(np.int16)).astype(np.uint8).tobytes()


def pad(text: bytes) -> bytes:
    return text + b" " * (-len(text) % UNIT if text else UNIT)


# --- Spark ---------------------------------------------------------------------------------------------------------


def store(docs: DataFrame) -> DataFrame:
    """doc_id and media, a progressive JPEG file that holds the whole text; null texts are stored as empty ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches, "content", 2 << 20):
            texts = chunk.column(1).to_pylist()
            media = encode_many([pad(t) for t in texts], [len(t) for t in texts])
            yield pa.record_batch([chunk.column(0), pa.array(media, pa.binary())], ["doc_id", "media"])

    return docs.select("doc_id", text_bytes().alias("content")).mapInArrow(released(run), "doc_id long, media binary")


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
TENSORS = f"{FEATURES}, height int, width int, tensor binary"
#: Bytes of tensors after which rows are handed on.
HELD = 4 << 20


def tensors(media: DataFrame) -> DataFrame:
    """Decodes the files of a media column whole. tensor: the samples of the full-resolution RGB tensor, by row, column and channel; feature: its size, CRC-32 and the mean of each channel in thousandths. A null file gives nulls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(name, {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}[kind]) for name, kind in (f.split() for f in TENSORS.split(", "))])
        batch = lambda rows: pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
        for chunk in text_chunks(batches, "media", 2 << 20):
            files = chunk.column(1).to_pylist()
            known = [f for f in files if f is not None]
            images, coef = decode_many(known)
            blocks = samples(images, coef)
            done = iter(zip(images, known))
            rows, held = [], 0
            for doc_id, f in zip(chunk.column(0).to_pylist(), files):
                if f is None:
                    rows.append((doc_id, *(None,) * 10))
                    continue
                image, raw = next(done)
                data, tensor = payload(image, coef), rgb(image, blocks)
                height, width = tensor.shape[:2]
                means = (tensor.reshape(-1, 3).sum(0, dtype=np.int64) * 1000 // (height * width)).tolist()
                rows.append((doc_id, int(image.comment.split()[1]), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), len(raw), hashlib.sha256(raw).hexdigest(), f"{width}x{height}:{zlib.crc32(tensor):08x}:{'/'.join(map(str, means))}", height, width, tensor.tobytes()))
                held += tensor.nbytes
                if held >= HELD:
                    yield batch(rows)
                    rows, held = [], 0
            if rows:
                yield batch(rows)

    return media.select("doc_id", "media").mapInArrow(released(run), TENSORS)


def features(media: DataFrame) -> DataFrame:
    """The rows of tensors() without the tensors."""
    return tensors(media).drop("height", "width", "tensor")
