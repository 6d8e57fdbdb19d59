"""Progressive JPEG in numpy: a store of byte payloads as quantised coefficients, and a reader of progressive files.

Reading accumulates all scans (spectral selection and successive approximation) into coefficient arrays, many restart
intervals of many files in step; the arrays are inverse-transformed in exact integer arithmetic, chroma is upsampled, and
full-resolution RGB tensors result. Writing puts each payload byte p as the coefficient p + 128, so that every bit
survives; a comment segment keeps the payload's length.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

BLOCK = 64
#: Blocks of a 4:2:0 unit: four of luma, one of each chroma.
MCU_BLOCKS = 6
#: A payload byte p is stored as the coefficient p + OFFSET, which is never 0.
OFFSET = 128
#: Restart intervals handled at a time, to bound memory.
LANES = 16_384
#: Units in a row of the stored image, at most 4095 rows.
ROW_UNITS, MAX_ROWS = 32, 4095
#: The band with successive approximation; beyond it coefficients come in one scan.
LOW_END = 5


@lru_cache(maxsize=1)
def zigzag() -> np.ndarray:
    """Natural index of each zigzag position, from the rule: along anti-diagonals, in turn up and down."""
    cells = sorted(((y, x) for y in range(8) for x in range(8)), key=lambda c: (c[0] + c[1], c[0] if (c[0] + c[1]) % 2 else c[1]))
    return np.array([8 * y + x for y, x in cells])


@lru_cache(maxsize=1)
def inverse_transform() -> np.ndarray:
    """64 zigzag coefficients -> 64 samples, scaled by 2**16 and rounded, so that float64 sums of products are exact."""
    u, x = np.arange(8)[:, None], np.arange(8)[None]
    basis = np.cos((2 * x + 1) * u * np.pi / 16) * np.where(u == 0, np.sqrt(1 / 8), 0.5)
    return np.round(np.kron(basis, basis)[zigzag()] * 65536)


# ---------------------------------------------------------------- Huffman tables


@lru_cache(maxsize=1)
def own_tables() -> dict[tuple[int, int], tuple[bytes, bytes]]:
    """(class, id) -> (counts by length, symbols) of the tables that this writer uses."""
    dc = (bytes([0, 0, 0, 12] + [0] * 12), bytes(range(12)))
    short = [0x08, 0x09, 0x07, 0x00]
    rest = [s for s in [0xF0, *(16 * r + size for r in range(16) for size in range(1, 11))] if s not in short]
    ac = (bytes([1, 1, 1, 1] + [0] * 7 + [len(rest)] + [0] * 4), bytes(short + rest))
    return {(0, 0): dc, (1, 0): ac}


def codes(counts: bytes, symbols: bytes) -> list[tuple[int, int, int]]:
    """(symbol, code, length), canonical."""
    out, code, at = [], 0, 0
    for length, n in enumerate(counts, 1):
        for s in symbols[at : at + n]:
            out.append((s, code, length))
            code += 1
        at += n
        code <<= 1
    return out


@lru_cache(maxsize=64)
def encoder_table(key: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    code, length = np.zeros(256, np.uint64), np.zeros(256, np.int64)
    for s, c, n in codes(*own_tables()[key]):
        code[s], length[s] = c, n
    return code, length


@lru_cache(maxsize=64)
def decoder_table(counts: bytes, symbols: bytes) -> np.ndarray:
    """For the next 16 bits: length * 256 + symbol."""
    out = np.zeros(1 << 16, np.int32)
    for s, c, n in codes(counts, symbols):
        out[c << 16 - n : c + 1 << 16 - n] = n * 256 + s
    return out


# ---------------------------------------------------------------- writing


def _sizes(values: np.ndarray) -> np.ndarray:
    return np.frexp(np.abs(values).astype(np.float64))[1].astype(np.int64)


def pack(values: np.ndarray, lengths: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of (value, length) symbols -> one byte stream with a restart marker after each row, and the rows' ends.

    doc: the file of each row; markers count from 0 in each."""
    n = len(values)
    bits = lengths.sum(1)
    pad = -bits % 8
    values = np.concatenate([values, ((1 << pad) - 1).astype(np.uint64)[:, None]], 1)
    lengths = np.concatenate([lengths, pad[:, None]], 1)
    n_bytes = (bits + pad) // 8
    flat = lengths.ravel()
    start = np.cumsum(flat) - flat
    shifted = values.ravel() << (64 - (start & 31) - flat).astype(np.uint64)
    word = start >> 5
    first = np.concatenate([[0], np.flatnonzero(word[1:] != word[:-1]) + 1])
    words = np.zeros(int(word[-1]) + 2, np.uint64)
    words[word[first]] += np.add.reduceat(shifted >> np.uint64(32), first)
    words[word[first] + 1] += np.add.reduceat(shifted & np.uint64(0xFFFFFFFF), first)
    raw = words.astype(">u4").view(np.uint8)[: int(n_bytes.sum())]
    full = raw == 255
    at = np.arange(len(raw)) + np.cumsum(full) - full + 2 * np.repeat(np.arange(n), n_bytes)
    ends = np.cumsum(n_bytes + 2 + np.add.reduceat(np.concatenate([full, [False]]).astype(np.int64), np.cumsum(n_bytes) - n_bytes) * (n_bytes > 0))
    out = np.zeros(int(ends[-1]), np.uint8)
    out[at] = raw
    first_of_doc = np.searchsorted(doc, doc)
    out[ends - 2], out[ends - 1] = 255, 0xD0 + (np.arange(n) - first_of_doc) % 8
    return out, ends


def _symbols_ac(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a band's coefficients -> symbols: run and size, extra bits, end of block."""
    code, length = encoder_table((1, 0))
    n, width = c.shape
    index = np.arange(width)
    some = c != 0
    size = _sizes(c)
    extra = np.where(c < 0, c + (1 << size) - 1, c).astype(np.uint64)
    if some.all():
        return (code[size] << size.astype(np.uint64)) | extra, length[size] + size
    last = np.maximum.accumulate(np.where(some, index, -1), 1)
    run = index - 1 - np.concatenate([np.full((n, 1), -1), last[:, :-1]], 1)
    symbol = np.where(some, (run & 15) << 4 | size, 0)
    value = np.where(some, (code[symbol] << size.astype(np.uint64)) | extra, np.uint64(0))
    bits = np.where(some, length[symbol] + size, 0)
    end = last[:, -1:] < width - 1
    parts_v, parts_b = [value], [bits]
    longs = np.where(some, run >> 4, 0)
    if longs.any():  # up to three runs of 16 zeros before a coefficient, in slots of their own
        slots_v, slots_b = [], []
        for k in range(3):
            slots_v.append(np.where(longs > k, code[0xF0], np.uint64(0)))
            slots_b.append(np.where(longs > k, length[0xF0], 0))
        parts_v = [np.stack([*slots_v, value], 2).reshape(n, -1)]
        parts_b = [np.stack([*slots_b, bits], 2).reshape(n, -1)]
    return np.concatenate([*parts_v, np.where(end, code[0], np.uint64(0))], 1), np.concatenate([*parts_b, np.where(end, length[0], 0)], 1)


def _symbols_refine(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Last bit of a band none of whose coefficients is new: end of block, then the bits of those known."""
    assert not (np.abs(c) == 1).any(), "a coefficient would be new in a refinement scan"
    code, length = encoder_table((1, 0))
    n = len(c)
    known = c != 0
    return np.concatenate([np.full((n, 1), code[0]), (np.abs(c) & 1).astype(np.uint64)], 1), np.concatenate([np.full((n, 1), length[0]), known.astype(np.int64)], 1)


def _symbols_dc(units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Units' coefficients -> differences within the unit, by component, at half precision."""
    code, length = encoder_table((0, 0))
    dc = units[:, :, 0] >> 1
    diff = dc.copy()
    diff[:, 1:4] -= dc[:, :3]
    size = _sizes(diff)
    extra = np.where(diff < 0, diff + (1 << size) - 1, diff).astype(np.uint64)
    return (code[size] << size.astype(np.uint64)) | extra, length[size] + size


#: The scans written: components (0, 1, 2), first and last coefficient, high and low bit.
SCRIPT = [((0, 1, 2), 0, 0, 0, 1), *(((c,), 1, LOW_END, 0, 1) for c in range(3)), ((0, 1, 2), 0, 0, 1, 0), *(((c,), LOW_END + 1, 63, 0, 0) for c in range(3)), *(((c,), 1, LOW_END, 1, 0) for c in range(3))]


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([255, marker]) + (len(body) + 2).to_bytes(2, "big") + body


@lru_cache(maxsize=1)
def _fixed_segments() -> bytes:
    tables = b"".join(bytes([16 * kind + i]) + counts + symbols for (kind, i), (counts, symbols) in own_tables().items())
    return _segment(0xDB, bytes([0]) + bytes([1] * BLOCK)) + _segment(0xC4, tables) + _segment(0xDD, (1).to_bytes(2, "big"))


@lru_cache(maxsize=64)
def _scan_head(scan: tuple) -> bytes:
    parts, first, last, high, low = scan
    return _segment(0xDA, bytes([len(parts)]) + b"".join(bytes([c + 1, 0]) for c in parts) + bytes([first, last, 16 * high + low]))


def grid(units: int) -> tuple[int, int]:
    """Rows and columns of units."""
    columns = min(units, max(ROW_UNITS, -(-units // MAX_ROWS)))
    return -(-units // columns), columns


def encode(payloads: list[bytes]) -> list[bytes]:
    """Payloads (positive multiples of 192 bytes) -> progressive JPEG files."""
    shapes = [grid(-(-len(p) // (MCU_BLOCKS * BLOCK))) for p in payloads]
    counts = np.array([r * c for r, c in shapes])
    base = np.cumsum(counts) - counts
    units = np.zeros((int(counts.sum()), MCU_BLOCKS * BLOCK), np.int64)
    flat = units.reshape(-1)
    for p, b in zip(payloads, base.tolist(), strict=True):
        at = b * MCU_BLOCKS * BLOCK
        flat[at : at + len(p)] = np.frombuffer(p, np.uint8).astype(np.int64) + OFFSET
    units = units.reshape(-1, MCU_BLOCKS, BLOCK)
    doc = np.repeat(np.arange(len(payloads)), counts)
    luma = luma_order(shapes, base)
    streams: list[list[bytes]] = []
    for scan in SCRIPT:
        parts, first, last, high, low = scan
        if len(parts) == 3:
            rows, owner = units, doc
        elif parts[0] == 0:
            rows, owner = units[:, :4].reshape(-1, BLOCK)[luma], np.repeat(doc, 4)
        else:
            rows, owner = units[:, 3 + parts[0]], doc
        chunks, ends, done = [], [], 0
        for i in range(0, len(rows), LANES):
            part = rows[i : i + LANES]
            if len(parts) == 3:
                symbols = _symbols_dc(part) if not high else ((part[:, :, 0] & 1).astype(np.uint64), np.ones(part.shape[:2], np.int64))
            elif high:
                symbols = _symbols_refine(part[:, first : last + 1])
            else:
                symbols = _symbols_ac(part[:, first : last + 1] >> low)
            stream, end = pack(*symbols, owner[i : i + LANES])
            if i and owner[i - 1] == owner[i]:  # go on counting markers where a file continues
                own = np.flatnonzero(owner[i : i + LANES] == owner[i])
                stream[end[own] - 1] = 0xD0 + (own + i - np.searchsorted(owner, owner[i])) % 8
            chunks.append(stream)
            ends.append(end + done)
            done += len(stream)
        stream, end = np.concatenate(chunks).tobytes(), np.concatenate(ends)
        stops = end[np.searchsorted(owner, np.arange(len(payloads)), "right") - 1].tolist()
        streams.append([stream[a : b - 2] for a, b in zip([0, *stops[:-1]], stops, strict=True)])
    out = []
    for k, (p, (r, c)) in enumerate(zip(payloads, shapes, strict=True)):
        frame = bytes([8]) + (16 * r).to_bytes(2, "big") + (16 * c).to_bytes(2, "big") + bytes([3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
        parts = [b"\xff\xd8", _segment(0xFE, b"payload=%d" % len(p)), _segment(0xC2, frame), _fixed_segments()]
        for scan, own in zip(SCRIPT, streams, strict=True):
            parts += [_scan_head(scan), own[k]]
        out.append(b"".join([*parts, b"\xff\xd9"]))
    return out


def luma_order(shapes: list[tuple[int, int]], base: np.ndarray) -> np.ndarray:
    """Index among unit-wise luma blocks of each block in raster order, file after file."""
    out, known = [], {}
    for (r, c), b in zip(shapes, base.tolist(), strict=True):
        if (r, c) not in known:
            known[r, c] = np.arange(4 * r * c).reshape(r, c, 2, 2).transpose(0, 2, 1, 3).ravel()
        out.append(known[r, c] + 4 * b)
    return np.concatenate(out)


# ---------------------------------------------------------------- reading


@dataclass
class Component:
    id: int
    h: int
    v: int
    quant: int
    rows: int = 0  # blocks, padded to whole units
    columns: int = 0
    base: int = 0  # first block in the batch
    own_rows: int = 0  # blocks that scans of this component alone hold
    own_columns: int = 0


@dataclass
class File:
    height: int = 0
    width: int = 0
    payload: int = 0
    parts: list[Component] = field(default_factory=list)
    quants: dict[int, np.ndarray] = field(default_factory=dict)
    scans: list[tuple] = field(default_factory=list)  # (signature, from, to)


def _parse(data: bytes, start: int, end: int, marks: list[int]) -> File:
    """Segments of one file. marks: where markers other than restarts may be."""
    f, tables, restart, at = File(), {}, 0, start + 2
    while at < end:
        marker = data[at + 1]
        if marker == 0xD9:
            break
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xFE and body.startswith(b"payload="):
            f.payload = int(body[8:])
        elif marker == 0xDB:
            while body:
                wide = body[0] >> 4
                n = BLOCK * (1 + wide)
                f.quants[body[0] & 15] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(np.int64)
                body = body[1 + n :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0] >> 4, body[0] & 15] = (body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xDD:
            restart = int.from_bytes(body, "big")
        elif marker == 0xC2:
            f.height, f.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            f.parts = [Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
            h, v = max(p.h for p in f.parts), max(p.v for p in f.parts)
            for p in f.parts:
                p.columns, p.rows = -(-f.width // (8 * h)) * p.h, -(-f.height // (8 * v)) * p.v
                p.own_columns, p.own_rows = -(-(-(-f.width * p.h // h)) // 8), -(-(-(-f.height * p.v // v)) // 8)
        elif marker in (0xC0, 0xC1, 0xC3):
            raise ValueError("not a progressive JPEG")
        elif marker == 0xDA:
            n = body[0]
            index = {p.id: i for i, p in enumerate(f.parts)}
            own = tuple(index[body[1 + 2 * i]] for i in range(n))
            first, last, bits = body[1 + 2 * n : 4 + 2 * n]
            used = tuple(tables.get((0, body[2 + 2 * i] >> 4)) for i in range(n)) if first == 0 else (tables.get((1, body[2] & 15)),)
            to = marks[bisect_left(marks, at)]
            f.scans.append(((own, first, last, bits >> 4, bits & 15, used if bits >> 4 == 0 or first else (), restart), at, to))
            at = to
    return f


def _peek(stream: np.ndarray, at: np.ndarray) -> np.ndarray:
    """57 bits or more from bit positions on, at the top of 64."""
    windows = np.ndarray((len(stream) - 7,), ">u8", stream, strides=(1,))
    return windows[at >> 3].astype(np.uint64) << (at & 7).astype(np.uint64)


def _top(window: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The first n bits."""
    return (window >> (64 - n).astype(np.uint64)).astype(np.int64) * (n > 0)


def _extend(bits: np.ndarray, size: np.ndarray) -> np.ndarray:
    half = (1 << size) >> 1
    return np.where(bits < half, bits - (1 << size) + 1, bits)


def _ac_first(c: np.ndarray, stream: np.ndarray, at: np.ndarray, cursor: np.ndarray, left: np.ndarray, order: np.ndarray, table: np.ndarray, first: int, last: int, low: int) -> None:
    """All lanes take a symbol at each step. cursor: a lane's place in order, which holds block numbers."""
    k = np.full(len(at), first)
    flat = c.reshape(-1)
    while len(at):
        window = _peek(stream, at)
        entry = table[(window >> np.uint64(48)).astype(np.int64)].astype(np.int64)
        length, symbol = entry >> 8, entry & 255
        if not entry.all():
            raise ValueError("broken entropy-coded data")
        run, size = symbol >> 4, symbol & 15
        window <<= length.astype(np.uint64)
        coded = size > 0
        if coded.all():
            k += run
            flat[order[cursor] * BLOCK + k] = _extend(_top(window, size), size) << low
            k += 1
            at += length + size
            skip = None
        else:
            ends = ~coded & (run < 15)
            extra = np.where(coded, size, np.where(ends, run, 0))
            bits = _top(window, extra)
            k += np.where(ends, 0, run)
            hit = np.flatnonzero(coded)
            flat[order[cursor[hit]] * BLOCK + k[hit]] = _extend(bits[hit], size[hit]) << low
            k = np.where(ends, last + 1, k + 1)
            at += length + extra
            skip = np.where(ends, (1 << run) + bits - 1, 0)
        over = k > last
        if over.any():
            step = over.astype(np.int64) if skip is None else over + np.where(over, np.minimum(skip, left - 1), 0)
            cursor, left = cursor + step, left - step
            k[over] = first
            if (left <= 0).any():
                stay = left > 0
                at, cursor, left, k = at[stay], cursor[stay], left[stay], k[stay]


def _ac_refine(c: np.ndarray, stream: np.ndarray, at: np.ndarray, cursor: np.ndarray, left: np.ndarray, order: np.ndarray, table: np.ndarray, first: int, last: int, low: int) -> None:
    """At each step every lane reads a symbol if it needs one, then passes one coefficient."""
    n = len(at)
    k, run, new = np.full(n, first), np.zeros(n, np.int64), np.zeros(n, np.int64)
    blocks, wants = np.zeros(n, np.int64), np.ones(n, bool)  # blocks: how many more end without new coefficients
    bit, flat = 1 << low, c.reshape(-1)
    while len(at):
        ask = np.flatnonzero(wants & (blocks == 0))
        if len(ask):
            window = _peek(stream, at[ask])
            entry = table[(window >> np.uint64(48)).astype(np.int64)].astype(np.int64)
            length, r, size = entry >> 8, (entry & 255) >> 4, entry & 15
            window <<= length.astype(np.uint64)
            ends = (size == 0) & (r < 15)
            extra = np.where(ends, r, size)
            bits = _top(window, extra)
            at[ask] += length + extra
            blocks[ask] = np.where(ends, (1 << r) + bits, 0)
            run[ask] = np.where(ends, 0, r)
            new[ask] = np.where(size > 0, np.where(bits > 0, bit, -bit), 0)
            wants[ask] = False
        place = order[cursor] * BLOCK + k
        value = flat[place].astype(np.int64)
        known = value != 0
        more = (_peek(stream, at) >> np.uint64(63)).astype(np.int64)
        fix = known & (more == 1) & (np.abs(value) & bit == 0)
        flat[place[fix]] = value[fix] + np.sign(value[fix]) * bit
        at += known
        zero = ~known & (blocks == 0)
        hit = zero & (run == 0)
        put = hit & (new != 0)
        flat[place[put]] = new[put]
        wants |= hit
        run -= zero & ~hit
        k += 1
        over = k > last
        if over.any():
            cursor, left = cursor + over, left - over
            k[over] = first
            run[over], new[over] = 0, 0
            wants |= over
            blocks = np.where(over & (blocks > 0), blocks - 1, blocks)
            if (left <= 0).any():
                s = left > 0
                at, cursor, left, k, run, new, blocks, wants = at[s], cursor[s], left[s], k[s], run[s], new[s], blocks[s], wants[s]


def _dc_first(c: np.ndarray, stream: np.ndarray, at: np.ndarray, cursor: np.ndarray, left: np.ndarray, order: np.ndarray, parts: np.ndarray, tables: list[np.ndarray], low: int) -> None:
    """cursor: a lane's place in order, which holds the blocks unit by unit; parts: the component of each block of a unit."""
    predicted = np.zeros((len(at), len(tables)), np.int64)
    step, lane = 0, np.arange(len(at))
    while len(at):
        part = int(parts[step % len(parts)])
        window = _peek(stream, at)
        entry = tables[part][(window >> np.uint64(48)).astype(np.int64)].astype(np.int64)
        if not entry.all():
            raise ValueError("broken entropy-coded data")
        length, size = entry >> 8, entry & 255
        predicted[lane, part] += _extend(_top(window << length.astype(np.uint64), size), size)
        c[order[cursor + step], 0] = predicted[lane, part] << low
        at += length + size
        step += 1
        if (left <= step).any():
            s = left > step
            at, cursor, left, lane = at[s], cursor[s], left[s], lane[s]


def coefficients(files: list[bytes]) -> tuple[list[File], np.ndarray]:
    """The files' heads, and all their blocks' coefficients in zigzag order."""
    data = b"".join(files)
    raw = np.frombuffer(data + bytes(8), np.uint8)
    starts = np.cumsum([0, *map(len, files)]).tolist()
    full = np.flatnonzero(raw[:-8] == 255)
    after = raw[full + 1]
    marks = full[(after != 0) & (after != 255) & ((after < 0xD0) | (after > 0xD7))].tolist()
    restarts = full[(after >= 0xD0) & (after <= 0xD7)]
    keep = np.ones(len(raw), bool)
    keep[full[after == 0] + 1] = False
    stream = raw[keep]
    place = np.cumsum(keep) - keep  # of each raw byte in stream
    heads = [_parse(data, a, b, marks) for a, b in zip(starts[:-1], starts[1:], strict=True)]
    n = 0
    for f in heads:
        for p in f.parts:
            p.base, n = n, n + p.rows * p.columns
    c = np.zeros((n, BLOCK), np.int32)
    for level in range(max((len(f.scans) for f in heads), default=0)):
        groups: dict[tuple, list[int]] = {}
        for i, f in enumerate(heads):
            if level < len(f.scans):
                groups.setdefault((f.scans[level][0], tuple((f.parts[j].h, f.parts[j].v) for j in f.scans[level][0][0])), []).append(i)
        for (signature, sampling), members in groups.items():
            _scan(c, stream, place, restarts, [heads[i] for i in members], level, signature, sampling)
    return heads, c


@lru_cache(maxsize=4096)
def _unit_order(rows: int, columns: int, h: int, v: int) -> np.ndarray:
    return np.arange(rows * columns).reshape(rows // v, v, columns // h, h).transpose(0, 2, 1, 3).reshape(-1, h * v)


def _scan(c: np.ndarray, stream: np.ndarray, place: np.ndarray, restarts: np.ndarray, files: list[File], level: int, signature: tuple, sampling: tuple) -> None:
    own, first, last, high, low, tables, restart = signature
    alone = len(own) == 1
    order, totals = [], []
    for f in files:
        if alone:
            p = f.parts[own[0]]
            blocks = np.arange(p.own_rows * p.own_columns)
            if p.own_columns != p.columns:
                blocks = blocks // p.own_columns * p.columns + blocks % p.own_columns
            order.append(blocks + p.base)
            totals.append(len(blocks))
        else:
            both = [_unit_order(p.rows, p.columns, p.h, p.v) + p.base for p in (f.parts[j] for j in own)]
            both = np.concatenate(both, 1)
            order.append(both.ravel())
            totals.append(len(both))
    per_unit = 1 if alone else sum(h * v for h, v in sampling)
    totals = np.array(totals)
    lanes = -(-totals // restart) if restart else np.ones(len(files), np.int64)
    owner = np.repeat(np.arange(len(files)), lanes)
    index = np.arange(len(owner)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    size = restart or int(totals.max())
    left = np.minimum(size, totals[owner] - index * size) * per_unit
    cursor = (np.cumsum(totals) - totals)[owner] * per_unit + index * size * per_unit
    begin = np.array([f.scans[level][1] for f in files])
    from_marker = np.searchsorted(restarts, begin)[owner] + index - 1
    at = place[np.where(index == 0, begin[owner], restarts[np.minimum(np.maximum(from_marker, 0), max(len(restarts) - 1, 0))] + 2 if len(restarts) else begin[owner])] * 8
    order = np.concatenate(order)
    for i in range(0, len(at), LANES):
        a, cur, le = at[i : i + LANES].copy(), cursor[i : i + LANES].copy(), left[i : i + LANES].copy()
        if first == 0 and high:
            lane = np.repeat(np.arange(len(a)), le)
            j = np.arange(len(lane)) - np.repeat(np.cumsum(le) - le, le)
            bits = (_peek(stream, a[lane] + j) >> np.uint64(63)).astype(np.int32)
            c[order[cur[lane] + j], 0] |= bits << low
        elif first == 0:
            parts = np.repeat(np.arange(len(own)), [h * v if not alone else 1 for h, v in sampling])
            _dc_first(c, stream, a, cur, le, order, parts, [decoder_table(*t) for t in tables], low)
        else:
            (_ac_refine if high else _ac_first)(c, stream, a, cur, le, order, decoder_table(*tables[0]), first, last, low)


def payloads(heads: list[File], c: np.ndarray) -> list[bytes]:
    """What encode() stored."""
    out = []
    for f in heads:
        blocks = np.concatenate([c[p.base : p.base + p.rows * p.columns][_unit_order(p.rows, p.columns, p.h, p.v)] for p in f.parts], 1)
        out.append((blocks.reshape(-1)[: f.payload] - OFFSET).astype(np.uint8).tobytes())
    return out


@lru_cache(maxsize=1)
def _colour_tables() -> tuple[np.ndarray, ...]:
    """What chroma adds to red, green (two parts) and blue, in fixed point (BT.601, as JFIF has it)."""
    x = np.arange(256) - 128
    return (91881 * x + 32768) >> 16, -46802 * x, -22554 * x, (116130 * x + 32768) >> 16


def samples(c: np.ndarray, quant: np.ndarray) -> np.ndarray:
    """Blocks of zigzag coefficients -> 8x8 samples from 0 to 255; exact, as all sums stay below 2**53."""
    out = np.empty((len(c), 8, 8), np.uint8)
    for i in range(0, len(c), LANES):
        x = (c[i : i + LANES] * quant).astype(np.float64) @ inverse_transform()
        out[i : i + LANES] = np.clip(np.floor((x + 32768) / 65536) + 128, 0, 255).reshape(-1, 8, 8)
    return out


def tensors(heads: list[File], c: np.ndarray) -> list[np.ndarray]:
    """Full-resolution RGB, height x width x 3, chroma upsampled by repetition."""
    same = bool(heads) and all(len(q := f.quants) == 1 and (next(iter(q.values())) == 1).all() for f in heads)
    whole = samples(c, np.ones(BLOCK, np.int64)) if same else None
    red, green_r, green_b, blue = _colour_tables()
    out = []
    for f in heads:
        planes = []
        for p in f.parts:
            own = slice(p.base, p.base + p.rows * p.columns)
            blocks = whole[own] if same else samples(c[own], f.quants[p.quant])
            planes.append(blocks.reshape(p.rows, p.columns, 8, 8).transpose(0, 2, 1, 3).reshape(p.rows * 8, p.columns * 8))
        h, v = max(p.h for p in f.parts), max(p.v for p in f.parts)
        y = _up(planes[0], f.parts[0], h, v).astype(np.int16)
        if len(planes) == 1:
            rgb = np.repeat(y[:, :, None], 3, 2)
        else:
            cb, cr = planes[1], planes[2]
            rgb = np.empty((*y.shape, 3), np.int16)
            rgb[:, :, 0] = y + _up(red[cr].astype(np.int16), f.parts[2], h, v)
            rgb[:, :, 1] = y + _up(((green_r[cr] + green_b[cb] + 32768) >> 16).astype(np.int16), f.parts[1], h, v)
            rgb[:, :, 2] = y + _up(blue[cb].astype(np.int16), f.parts[1], h, v)
        out.append(np.clip(rgb, 0, 255).astype(np.uint8)[: f.height, : f.width])
    return out


def _up(plane: np.ndarray, p: Component, h: int, v: int) -> np.ndarray:
    return plane if (p.h, p.v) == (h, v) else plane.repeat(v // p.v, 0).repeat(h // p.h, 1)
