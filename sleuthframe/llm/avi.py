"""Media columns: motion-JPEG AVI files as binary values, decoded to timed clip rows.

The RIFF tree is read for frame rate and index (idx1, or the newer ix00
chunks; a walk over movi where neither fits), baseline JPEG frames are decoded
here (no codec library is needed), and a new clip begins where the luma
histogram changes far more than in the frames around it.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .common import picked, table

BINS = 32
#: A cut needs at least this difference (0 to 2), and FACTOR times the median of up to NEAR differences on each side.
LEAST = 0.35
FACTOR = 3.0
NEAR = 6

_z = sorted(((x, y) for x in range(8) for y in range(8)), key=lambda p: (sum(p), p[0] if sum(p) % 2 else p[1]))
ZIGZAG = np.array([x * 8 + y for x, y in _z])
_k = np.arange(8)
DCT = np.sqrt(np.where(_k == 0, 1, 2) / 8)[:, None] * np.cos((2 * _k[None, :] + 1) * _k[:, None] * np.pi / 16)


def _spec(counts: str, values: bytes) -> tuple[bytes, bytes]:
    return bytes(int(c, 16) for c in counts.split()), values


def _ac(text: str) -> bytes:
    return bytes.fromhex(text)


#: The tables of annex K of the JPEG standard, which motion-JPEG frames may leave out.
STANDARD = {
    (0, 0): _spec("0 1 5 1 1 1 1 1 1 0 0 0 0 0 0 0", bytes(range(12))),
    (0, 1): _spec("0 3 1 1 1 1 1 1 1 1 1 0 0 0 0 0", bytes(range(12))),
    (1, 0): _spec("0 2 1 3 3 2 4 3 5 5 4 4 0 0 1 7d", _ac("01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282090a161718191a25262728292a3435363738393a434445464748494a535455565758595a636465666768696a737475767778797a838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae1e2e3e4e5e6e7e8e9eaf1f2f3f4f5f6f7f8f9fa")),
    (1, 1): _spec("0 2 1 2 4 4 3 4 7 5 4 4 0 1 2 77", _ac("000102031104052131061241510761711322328108144291a1b1c109233352f0156272d10a162434e125f11718191a262728292a35363738393a434445464748494a535455565758595a636465666768696a737475767778797a82838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae2e3e4e5e6e7e8e9eaf2f3f4f5f6f7f8f9fa")),
}


class BadMedia(ValueError):
    pass


@lru_cache(maxsize=64)
def codes(counts: bytes, values: bytes) -> dict[int, tuple[int, int]]:
    """Of each value, its code and the code's length."""
    out, code, k = {}, 0, 0
    if sum(counts) != len(values):
        raise BadMedia("bad code table")
    for length, n in enumerate(counts, 1):
        if code + n > 1 << length:
            raise BadMedia("bad code table")
        for _ in range(n):
            out[values[k]] = (code, length)
            code += 1
            k += 1
        code <<= 1
    return out


@lru_cache(maxsize=64)
def lookup(counts: bytes, values: bytes) -> list[int]:
    """Of each 16 bits ahead, length << 8 | value; 0 where no code fits."""
    out = np.zeros(1 << 16, np.int64)
    for value, (code, length) in codes(counts, values).items():
        out[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | value
    return out.tolist()


@dataclass(eq=False)
class Head:
    """What precedes a frame's scan; at: where that begins."""

    width: int
    height: int
    components: list[tuple[int, int, int]]  # of each, its blocks across and down in a unit, and its quantization table's number
    quant: dict[int, np.ndarray]
    plan: list[tuple[int, tuple[bytes, bytes], tuple[bytes, bytes]]]  # of each block of a unit, the component and the tables
    across: int
    down: int
    restart: int
    at: int

    @property
    def units(self) -> int:
        return self.across * self.down

    @property
    def blocks(self) -> int:
        return self.units * len(self.plan)


Frame = tuple[Head, list[bytes]]


@lru_cache(maxsize=64)
def parse_head(data: bytes) -> Head:
    if data[:2] != b"\xff\xd8":
        raise BadMedia("no JPEG frame")
    tables: dict[tuple[int, int], tuple[bytes, bytes]] = dict(STANDARD)
    quant: dict[int, np.ndarray] = {}
    frame: list[tuple[int, int, int, int]] = []
    width = height = restart = 0
    at = 2
    while True:
        while at < len(data) and data[at] != 0xFF:
            at += 1
        while at < len(data) and data[at] == 0xFF:
            at += 1
        if at + 3 > len(data):
            raise BadMedia("JPEG frame without scan")
        kind = data[at]
        at += 1
        if kind == 0xD9:
            raise BadMedia("JPEG frame without scan")
        if 0xD0 <= kind <= 0xD8 or kind == 1:
            continue
        size = struct.unpack_from(">H", data, at)[0]
        body = data[at + 2 : at + size]
        at += size
        if kind == 0xDB:
            i = 0
            while i < len(body):
                wide, which = body[i] >> 4, body[i] & 15
                n = 128 if wide else 64
                quant[which] = np.frombuffer(body[i + 1 : i + 1 + n], ">u2" if wide else np.uint8).astype(np.int64)
                i += 1 + n
        elif kind == 0xC4:
            i = 0
            while i < len(body):
                n = sum(body[i + 1 : i + 17])
                tables[body[i] >> 4, body[i] & 15] = (body[i + 1 : i + 17], body[i + 17 : i + 17 + n])
                i += 17 + n
        elif kind in (0xC0, 0xC1):
            if body[0] != 8:
                raise BadMedia("only 8 bits a sample")
            height, width = struct.unpack_from(">HH", body, 1)
            frame = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
        elif 0xC2 <= kind <= 0xCF and kind not in (0xC8, 0xCC):
            raise BadMedia("only baseline JPEG")
        elif kind == 0xDD:
            restart = struct.unpack(">H", body[:2])[0]
        elif kind == 0xDA:
            picks = {body[1 + 2 * i]: (body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])}
            break
    if not frame or not width or not height or any(c[0] not in picks or c[3] not in quant or not c[1] or not c[2] for c in frame):
        raise BadMedia("incomplete JPEG header")
    hmax, vmax = max(c[1] for c in frame), max(c[2] for c in frame)
    across, down = -(-width // (8 * hmax)), -(-height // (8 * vmax))
    if len(frame) == 1:  # a single component isn't interleaved
        frame = [(frame[0][0], 1, 1, frame[0][3])]
        hmax = vmax = 1
        across, down = -(-width // 8), -(-height // 8)
    plan = []
    for t in {tables[kind, picks[c[0]][kind]] for c in frame for kind in (0, 1)}:
        codes(*t)
    for k, (c, h, v, _) in enumerate(frame):
        plan += [(k, tables[0, picks[c][0]], tables[1, picks[c][1]])] * (h * v)
    return Head(width, height, [(h, v, q) for _, h, v, q in frame], quant, plan, across, down, restart, at)


def parse_jpeg(data: bytes) -> Frame:
    """A frame's header and its scan without stuffing, cut at restart markers."""
    at = data.find(b"\xff\xda")
    try:
        f = parse_head(data[: at + 2 + struct.unpack_from(">H", data, at + 2)[0]])  # frames of one film have the same
    except (BadMedia, IndexError, struct.error):
        f = parse_head(data)
    end = data.rfind(b"\xff\xd9")
    scans = [data[f.at : end if end > f.at else len(data)]]
    if f.restart:
        scans = re.split(rb"\xff+[\xd0-\xd7]", scans[0])
    # Any other marker ends a scan. A block takes two bits at the least, so what a header claims is bounded by what follows it.
    scans = [re.split(rb"\xff+[\x01-\xfe]", x, maxsplit=1)[0].replace(b"\xff\x00", b"\xff") for x in scans]
    if len(scans) < (-(-f.units // f.restart) if f.restart else 1) or 2 * f.blocks > 8 * sum(map(len, scans)):
        raise BadMedia("JPEG scan too short")
    return f, scans


def segments(frame: Frame) -> list[tuple[bytes, int]]:
    """The scans with the number of units in each."""
    f, scans = frame
    if not f.restart:
        return [(scans[0], f.units)]
    return [(scans[k], min(f.restart, f.units - k * f.restart)) for k in range(-(-f.units // f.restart))]


def one_scan(f: Head, scan: bytes, units: int, out: np.ndarray) -> None:
    """Decodes a scan symbol by symbol into coefficients, a row for each block."""
    tables = [(k, lookup(*dc), lookup(*ac)) for k, dc, ac in f.plan]
    last = [0] * len(f.components)
    ahead = bits = pos = row = 0
    n = len(scan)
    for _ in range(units):
        for k, dc, ac in tables:
            block = [0] * 64
            i = 0
            while i < 64:
                while bits < 32:
                    ahead = (ahead << 8 | (scan[pos] if pos < n else 0)) & 0xFFFFFFFFFF
                    pos += 1
                    bits += 8
                if pos > n + 8:
                    raise BadMedia("JPEG scan too short")
                e = (dc if i == 0 else ac)[(ahead >> (bits - 16)) & 0xFFFF]
                if not e:
                    raise BadMedia("bad code in a JPEG scan")
                bits -= e >> 8
                s = e & 255
                if i:
                    if s == 0:
                        break
                    i += s >> 4
                    s &= 15
                    if i > 63:
                        raise BadMedia("bad run in a JPEG scan")
                elif s > 15:
                    raise BadMedia("bad code in a JPEG scan")
                if s:
                    v = (ahead >> (bits - s)) & ((1 << s) - 1)
                    bits -= s
                    if v < 1 << (s - 1):
                        v -= (1 << s) - 1
                else:
                    v = 0
                if i == 0:
                    last[k] += v
                    v = last[k]
                block[i] = v
                i += 1
            if 8 * pos - bits > 8 * n:
                raise BadMedia("JPEG scan too short")
            out[row] = block
            row += 1


def many_scans(lanes: list[tuple[Head, bytes, int, np.ndarray]]) -> list[str | None]:
    """Decodes scans side by side, a symbol of each at a time; of each what is wrong with it."""
    numbers: dict[tuple[bytes, bytes], int] = {}
    plans: dict[tuple, int] = {}
    width = max(len(f.plan) for f, *_ in lanes)
    rows: list[np.ndarray] = []
    which = np.empty(len(lanes), np.int64)
    for i, (f, *_) in enumerate(lanes):
        key = tuple(f.plan)
        if key not in plans:
            plans[key] = len(rows)
            row = np.zeros((width, 3), np.int64)
            row[: len(key)] = [(k, numbers.setdefault(dc, len(numbers)), numbers.setdefault(ac, len(numbers))) for k, dc, ac in key]
            rows.append(row)
        which[i] = plans[key]
    plan, size = np.stack(rows), np.array([len(f.plan) for f, *_ in lanes])
    look = np.concatenate([np.asarray(lookup(*t), np.uint16) for t in numbers])
    data = np.frombuffer(b"".join(x + bytes(12) for _, x, _, _ in lanes), np.uint8).astype(np.uint32)
    window = data[:-3] << 24 | data[1:-2] << 16 | data[2:-1] << 8 | data[3:]
    lens = np.array([len(x) for _, x, _, _ in lanes])
    start = np.r_[0, np.cumsum(lens + 12)[:-1]] * 8
    at, end = start.copy(), start + lens * 8
    total = np.array([u * len(f.plan) for f, _, u, _ in lanes])
    base = np.r_[0, np.cumsum(total)]
    out = np.zeros((base[-1], 64), np.int32)
    last = np.zeros((len(lanes), 1 + max(k for f, *_ in lanes for k, _, _ in f.plan)), np.int64)
    block, coef = np.zeros(len(lanes), np.int64), np.zeros(len(lanes), np.int64)
    wrong: list[str | None] = [None] * len(lanes)
    on = np.flatnonzero(total > 0)

    def fail(bad: np.ndarray, why: str) -> np.ndarray:
        for i in on[bad].tolist():
            wrong[i] = why
        return ~bad

    while len(on):
        a, c = at[on], coef[on]
        rule = plan[which[on], block[on] % size[on]]
        dc = c == 0
        e = look[(np.where(dc, rule[:, 1], rule[:, 2]) << 16) + ((window[a >> 3] >> (16 - (a & 7)).astype(np.uint32)) & 0xFFFF)].astype(np.int64)
        low = e & 255
        run = np.where(dc, 0, low >> 4)
        s = np.where(dc, low, low & 15)
        a += e >> 8
        over = (e == 0) | (s > 15)
        if over.any() or (c + run > 63).any():
            good = fail(over, "bad code in a JPEG scan") & fail(~over & (c + run > 63) & ~(low == 0), "bad run in a JPEG scan")
            on, a, c, rule, dc, low, run, s = on[good], a[good], c[good], rule[good], dc[good], low[good], run[good], s[good]
        raw = ((window[a >> 3] >> (16 - (a & 7)).astype(np.uint32)) & 0xFFFF).astype(np.int64) >> (16 - s)
        v = np.where((s > 0) & (raw < (1 << s) >> 1), raw - (1 << s) + 1, raw)
        a += s
        over = a > end[on]
        if over.any():
            good = fail(over, "JPEG scan too short")
            on, a, c, rule, dc, low, run, v = on[good], a[good], c[good], rule[good], dc[good], low[good], run[good], v[good]
        first = on[dc]
        last[first, rule[dc, 0]] += v[dc]
        v[dc] = last[first, rule[dc, 0]]
        stop = ~dc & (low == 0)
        put = ~stop
        out[base[on[put]] + block[on[put]], (c + run)[put]] = v[put]
        c = np.where(stop, 64, c + run + 1)
        done = c > 63
        at[on], coef[on] = a, np.where(done, 0, c)
        block[on] += done
        if done.any():
            on = on[block[on] < total[on]]
    for i, (_, _, _, to) in enumerate(lanes):
        to[:] = out[base[i] : base[i + 1]]
    return wrong


#: Scans decoded side by side at least, else one by one; blocks in one go.
LANES, BLOCKS = 48, 100_000


def decode_frames(frames: list[bytes], only: int | None = None) -> list[list[np.ndarray] | str]:
    """Of each frame the sample planes, luma first, each at its own resolution, or what is wrong with it; only: the number of planes made."""
    parsed: list[Frame | str] = []
    for data in frames:
        try:
            parsed.append(parse_jpeg(data))
        except (BadMedia, IndexError, KeyError, struct.error, ValueError) as e:
            parsed.append(str(e))
    out: list[list[np.ndarray] | str] = [x if isinstance(x, str) else [] for x in parsed]
    todo = [i for i, x in enumerate(parsed) if not isinstance(x, str)]
    while todo:
        some, blocks = [], 0
        while todo and (not some or blocks < BLOCKS):
            some.append(todo.pop())
            blocks += parsed[some[-1]][0].blocks
        # Frames with one header lie together.
        some.sort(key=lambda i: (id(parsed[i][0]), i))
        coefs = np.zeros((blocks, 64), np.int32)
        lanes, owner, row = [], [], 0
        for i in some:
            for scan, units in segments(parsed[i]):
                rows = units * len(parsed[i][0].plan)
                lanes.append((parsed[i][0], scan, units, coefs[row : row + rows]))
                owner.append(i)
                row += rows
        if len(lanes) >= LANES:
            for i, why in zip(owner, many_scans(lanes)):
                if why and not isinstance(out[i], str):
                    out[i] = why
        else:
            for i, lane in zip(owner, lanes):
                try:
                    if not isinstance(out[i], str):
                        one_scan(*lane)
                except BadMedia as e:
                    out[i] = str(e)
        a = row = 0
        while a < len(some):
            f = parsed[some[a]][0]
            b = a
            while b < len(some) and parsed[some[b]][0] is f:
                b += 1
            made = planes(f, coefs[row : row + (b - a) * f.blocks], only)
            for k, i in enumerate(some[a:b]):
                if not isinstance(out[i], str):
                    out[i] = [p[k] for p in made]
            a, row = b, row + (b - a) * f.blocks
    return out


def planes(f: Head, coefs: np.ndarray, only: int | None = None) -> list[np.ndarray]:
    """Of each component the planes (frames, height, width) of frames with one header."""
    hmax, vmax = max(c[0] for c in f.components), max(c[1] for c in f.components)
    whole = coefs.reshape(-1, len(f.plan), 64)
    n = len(coefs) // f.blocks
    out, at = [], 0
    for h, v, q in f.components[:only]:
        z = whole[:, at : at + h * v].reshape(-1, 64) * f.quant[q].astype(np.float64)
        at += h * v
        flat = np.zeros_like(z)
        flat[:, ZIGZAG] = z
        px = np.clip(np.rint(DCT.T @ flat.reshape(-1, 8, 8) @ DCT + 128), 0, 255).astype(np.uint8)
        plane = px.reshape(n, f.down, f.across, v, h, 8, 8).transpose(0, 1, 3, 5, 2, 4, 6).reshape(n, f.down * v * 8, f.across * h * 8)
        out.append(plane[:, : -(-f.height * v // vmax), : -(-f.width * h // hmax)])
    return out


def decode_jpeg(data: bytes) -> list[np.ndarray]:
    """The sample planes of a baseline frame, luma first, each at its own resolution."""
    got = decode_frames([data])[0]
    if isinstance(got, str):
        raise BadMedia(got)
    return got


@lru_cache(maxsize=4)
def code_table(kind: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each symbol its code and the code's length, by the standard's tables."""
    code, length = np.zeros(256, np.int64), np.zeros(256, np.int64)
    for value, (c, n) in codes(*STANDARD[kind, which]).items():
        code[value], length[value] = c, n
    return code, length


def pack_scans(coded: list[np.ndarray]) -> list[bytes]:
    """The entropy-coded scans of frames from components' coefficients (frames, units, blocks, 64) in zigzag order."""
    place, value, width = [], [], []
    frames, units = coded[0].shape[:2]
    before = np.r_[0, np.cumsum([c.shape[2] for c in coded])]
    # A unit's blocks lie one after another, those of the other components between; 256 places for each block's symbols.
    wide = 256 * before[-1]
    for k, c in enumerate(coded):
        own = c.shape[2]
        flat = c.reshape(-1, 64)
        home = (np.arange(frames * units)[:, None] * wide + (before[k] + np.arange(own)) * 256).ravel()
        bits = lambda v: np.frexp(np.abs(v).astype(np.float64))[1].astype(np.int64)
        rest = lambda v, s: np.where(v >= 0, v, v + (1 << s) - 1)
        diff = np.diff(c[..., 0].reshape(frames, -1), prepend=0, axis=1).ravel()
        code, length = code_table(0, min(k, 1))
        s = bits(diff)
        place.append(home)
        value.append(code[s] << s | rest(diff, s))
        width.append(length[s] + s)
        code, length = code_table(1, min(k, 1))
        block, at = np.nonzero(flat[:, 1:])
        v = flat[block, at + 1]
        new = np.r_[True, block[1:] != block[:-1]] if len(block) else np.zeros(0, bool)
        run = at - np.where(new, -1, np.r_[0, at[:-1]]) - 1
        for z in range(3):  # runs of sixteen zeros
            some = run >= 16 * (z + 1)
            place.append(home[block[some]] + 4 * at[some] + 1 + z)
            value.append(np.full(some.sum(), code[0xF0]))
            width.append(np.full(some.sum(), length[0xF0]))
        s = bits(v)
        symbol = (run % 16) << 4 | s
        place.append(home[block] + 4 * at + 4)
        value.append(code[symbol] << s | rest(v, s))
        width.append(length[symbol] + s)
        open_ = flat[:, 63] == 0
        place.append(home[open_] + 255)
        value.append(np.full(open_.sum(), code[0]))
        width.append(np.full(open_.sum(), length[0]))
    place = np.concatenate(place)
    order = np.argsort(place)
    frame, value, width = place[order] // (wide * units), np.concatenate(value)[order], np.concatenate(width)[order]
    total = np.bincount(frame, weights=width, minlength=frames).astype(np.int64)
    size = (total + 7) // 8
    base = np.r_[0, np.cumsum(size)]
    stop = np.cumsum(width)
    first = np.r_[0, np.cumsum(total)[:-1]]
    start = stop - width - first[frame] + base[frame] * 8
    pad = size * 8 - total
    value, width, start = np.r_[value, (1 << pad) - 1], np.r_[width, pad], np.r_[start, base[:-1] * 8 + total]
    # Each value lies in at most five bytes; no two share a bit, so sums put them together.
    value = value << (40 - width - (start & 7))
    out = np.zeros(base[-1] + 6)
    for j in range(5):
        out += np.bincount((start >> 3) + j, weights=((value >> (32 - 8 * j)) & 255).astype(np.float64), minlength=len(out))
    data = out.astype(np.uint8).tobytes()
    return [data[a:b].replace(b"\xff", b"\xff\x00") for a, b in zip(base.tolist(), base[1:].tolist())]


def encode_frames(planes: list[np.ndarray], quality: int = 4) -> list[bytes]:
    """Baseline frames without Huffman tables, as cameras write into AVI files, from planes (frames, height, width): one, or luma and two of half its width and height; sides are multiples of 8 (16 with chroma)."""
    step = np.minimum(255, quality * (1 + np.add.outer(np.arange(8), np.arange(8)) // 2))
    frames, height, width = planes[0].shape
    subs = [(1, 1)] if len(planes) == 1 else [(2, 2), (1, 1), (1, 1)]
    coded = []
    for p, (h, v) in zip(planes, subs):
        rows, cols = p.shape[1] // (8 * v), p.shape[2] // (8 * h)
        b = p.astype(np.float64).reshape(frames, rows, v, 8, cols, h, 8).transpose(0, 1, 4, 2, 5, 3, 6).reshape(-1, 8, 8)
        coded.append(np.rint(DCT @ (b - 128) @ DCT.T / step).astype(np.int64).reshape(frames, rows * cols, v * h, 64)[..., ZIGZAG])
    seg = lambda kind, body: bytes([0xFF, kind]) + struct.pack(">H", len(body) + 2) + body
    n = len(planes)
    head = (
        b"\xff\xd8"
        + seg(0xDB, b"\0" + bytes(step.reshape(64)[ZIGZAG].tolist()))
        + seg(0xC0, struct.pack(">BHHB", 8, height, width, n) + b"".join(bytes([k + 1, subs[k][0] << 4 | subs[k][1], 0]) for k in range(n)))
        + seg(0xDA, bytes([n]) + b"".join(bytes([k + 1, 0x11 * min(k, 1)]) for k in range(n)) + b"\0\x3f\0")
    )
    return [head + scan + b"\xff\xd9" for scan in pack_scans(coded)]


def encode_jpeg(planes: list[np.ndarray], quality: int = 4) -> bytes:
    return encode_frames([p[None] for p in planes], quality)[0]


def write_avi(frames: list[bytes], width: int, height: int, usec: int = 40_000) -> bytes:
    """An AVI file of the frames, with an idx1 index."""
    chunk = lambda k, b: k + struct.pack("<I", len(b)) + b + b"\0" * (len(b) % 2)
    part = lambda k, b: chunk(b"LIST", k + b)
    avih = struct.pack("<14I", usec, 0, 0, 0x10, len(frames), 0, 1, 0, width, height, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<10I", 0, 0, 0, usec, 1_000_000, 0, len(frames), 0, 0, 0) + struct.pack("<4H", 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    movi, index = b"", b""
    for x in frames:
        index += struct.pack("<4sIII", b"00dc", 0x10, 4 + len(movi), len(x))
        movi += chunk(b"00dc", x)
    body = part(b"hdrl", chunk(b"avih", avih) + part(b"strl", chunk(b"strh", strh) + chunk(b"strf", strf))) + part(b"movi", movi) + chunk(b"idx1", index)
    return chunk(b"RIFF", b"AVI " + body)


def read_avi(data: bytes) -> tuple[float, list[bytes]]:
    """Seconds a frame, and the frames of the first video stream in order."""
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise BadMedia("no AVI file")
    usec, stream, streams, fps = 0, None, 0, 0.0
    walk: list[tuple[bytes, int, int]] = []
    idx1: list[tuple[bytes, int, int]] = []
    ix: list[tuple[int, int]] = []
    movi: int | None = None
    todo = [(12, len(data))]
    i = 0
    while i < len(data):  # files above 1 GB go on in further RIFF chunks
        if data[i : i + 4] == b"RIFF" and i:
            todo.append((i + 12, min(len(data), i + 8 + struct.unpack_from("<I", data, i + 4)[0])))
        i += 8 + struct.unpack_from("<I", data, i + 4)[0] if i + 8 <= len(data) else len(data)
        i += i % 2
    if len(todo) > 1:
        todo[0] = (12, todo[1][0] - 12)
    todo.reverse()
    while todo:
        at, end = todo.pop()
        while at + 8 <= end:
            kind, size = struct.unpack_from("<4sI", data, at)
            lo, hi = at + 8, min(at + 8 + size, end)
            if kind == b"LIST":
                if data[lo : lo + 4] == b"movi" and movi is None:
                    movi = lo
                todo.append((hi + hi % 2, end))
                todo.append((lo + 4, hi))
                break
            if kind == b"avih" and size >= 4:
                usec = struct.unpack_from("<I", data, lo)[0]
            elif kind == b"strh":
                if data[lo : lo + 4] == b"vids" and stream is None and hi - lo >= 28:
                    stream = streams
                    scale, rate = struct.unpack_from("<II", data, lo + 20)
                    fps = rate / scale if scale else 0.0
                streams += 1
            elif kind == b"idx1":
                idx1 = [struct.unpack_from("<4s4xII", data, p) for p in range(lo, hi - 15, 16)]
            elif kind[:2] == b"ix" and hi - lo >= 24 and data[lo + 3] == 1:
                n, chunk_id, base = struct.unpack_from("<I4sQ", data, lo + 4)
                if chunk_id[2:] in (b"dc", b"db") and data[lo + 2] == 0:
                    ix += [(base + o, s & 0x7FFFFFFF) for o, s in (struct.unpack_from("<II", data, p) for p in range(lo + 24, min(hi, lo + 24 + 8 * n) - 7, 8))]
            elif kind[2:] in (b"dc", b"db"):
                walk.append((kind, lo, hi))
            at = hi + hi % 2
    if stream is None or movi is None:
        raise BadMedia("AVI file without video")
    seconds = 1 / fps if fps else usec / 1e6
    mine = f"{stream:02d}".encode()
    found = [data[o : o + s] for o, s in ix if o + s <= len(data)]
    if not found and idx1:
        picks = [(o, s) for k, o, s in idx1 if k[:2] == mine and k[2:] in (b"dc", b"db")]
        for base in (movi, 0):  # offsets count from movi, in some files from the start
            if picks and all(base + o + 8 + s <= len(data) and data[base + o : base + o + 2] == mine for o, s in picks):
                found = [data[base + o + 8 : base + o + 8 + s] for o, s in picks]
                break
    return seconds, found or [data[lo:hi] for k, lo, hi in walk if k[:2] == mine]


def histogram(plane: np.ndarray) -> np.ndarray:
    return np.bincount(plane.reshape(-1) // (256 // BINS), minlength=BINS) / plane.size


def cuts(hists: list[np.ndarray]) -> list[int]:
    """The frames that begin a clip, after frame 0."""
    d = np.array([np.abs(a - b).sum() for a, b in zip(hists, hists[1:])])
    out = []
    for t, x in enumerate(d):
        near = np.concatenate([d[max(0, t - NEAR) : t], d[t + 1 : t + 1 + NEAR]])
        if x >= LEAST and x >= FACTOR * (np.median(near) if len(near) else 0.0):
            out.append(t + 1)
    return out


Clip = tuple[int, int, int, float, float, str | None]


def clips_of(films: list[bytes | None]) -> list[list[Clip]]:
    """Of each file (clip, first frame, last frame, start, end in seconds, error); an undecodable frame repeats the one before it, an unreadable file is one row with the error."""
    out: list[list[Clip]] = [[] for _ in films]
    read: list[tuple[int, float, int]] = []
    frames: list[bytes] = []
    for i, data in enumerate(films):
        if data:
            try:
                seconds, own = read_avi(data)
                read.append((i, seconds, len(own)))
                frames += own
            except (BadMedia, IndexError, struct.error) as e:
                out[i] = [(0, -1, -1, 0.0, 0.0, str(e))]
    decoded = decode_frames(frames, only=1)
    at = 0
    for i, seconds, n in read:
        hists: list[np.ndarray] = []
        error = None
        for j in range(n):
            got = decoded[at + j]
            if not isinstance(got, str):
                hists.append(histogram(got[0]))
                continue
            if frames[at + j] or not hists:  # an empty frame stands for the one before it
                error = error or f"frame {j}: {got}"
            if hists:
                hists.append(hists[-1])
        at += n
        if hists:
            edges = [0, *cuts(hists), len(hists)]
            out[i] = [(k, a, b - 1, round(a * seconds, 6), round(b * seconds, 6), error) for k, (a, b) in enumerate(zip(edges, edges[1:]))]
        else:
            out[i] = [(0, -1, -1, 0.0, 0.0, error or "no frames")]
    return out


def clips(data: bytes | None) -> list[Clip]:
    return clips_of([data])[0]


#: Bytes of film decoded side by side.
GO = 4 << 20


def detect(media: DataFrame) -> DataFrame:
    """Clip rows (media_id, clip, first_frame, last_frame, start_s, end_s, error) from rows (media_id, data).

    Null or empty data give no row; what isn't a readable AVI file gives one
    row with the reason in error, as does one whose header claims more than its
    data can hold. Repeated rows give repeated results, a null media_id stays
    null; other columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.string()]
        for b in batches:
            ids, sizes = b["media_id"].to_pylist(), np.cumsum(pc.fill_null(pc.binary_length(b["data"]), 0).to_numpy(zero_copy_only=False))
            i = 0
            while i < b.num_rows:
                j = max(i + 1, int(np.searchsorted(sizes, (sizes[i - 1] if i else 0) + GO, side="right")))
                got = [(d, *c) for d, own in zip(ids[i:j], clips_of(b["data"].slice(i, j - i).to_pylist())) for c in own]
                cols = list(zip(*got)) if got else [[]] * 7
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], ["media_id", "clip", "first_frame", "last_frame", "start_s", "end_s", "error"])
                i = j

    return picked(media, media_id="long", data="binary").mapInArrow(run, "media_id long, clip int, first_frame int, last_frame int, start_s double, end_s double, error string")


WIDTH, HEIGHT = 32, 16


def shot_lengths(e: list[float]) -> list[int]:
    """One to five shots of four to seven frames, by the signs of the vector's values."""
    n = 1 + sum(e[i] > 0 for i in range(4))
    return [4 + int(e[8 + k] > 0) + 2 * int(e[12 + k] > 0) for k in range(n)]


def render_all(vectors: list[list[float] | None]) -> list[bytes | None]:
    """Of each vector of at least 32 values a small colour film: a still texture per shot, with a drift; null for shorter ones."""
    out: list[bytes | None] = [None] * len(vectors)
    luma, red, blue, of = [], [], [], []
    for i, e in enumerate(vectors):
        if e is None or len(e) < 32 or any(x is None for x in e):
            continue
        v = np.nan_to_num(np.asarray(e, float))
        texture = np.kron(np.clip(v[:32].reshape(4, 8) * 20, -12, 12), np.ones((4, 4)))
        for k, n in enumerate(shot_lengths(v.tolist())):
            level = 48 + 40 * ((2 * k) % 5)
            for t in range(n):
                luma.append(np.clip(level + np.roll(texture, t, axis=1), 0, 255))
                red.append(128 + 20 * (k % 3 - 1))
                blue.append(128 + 20 * ((k + 1) % 3 - 1))
                of.append(i)
    if of:
        chroma = [np.array(c)[:, None, None] * np.ones((HEIGHT // 2, WIDTH // 2)) for c in (red, blue)]
        frames: dict[int, list[bytes]] = {}
        for i, f in zip(of, encode_frames([np.stack(luma), *chroma])):
            frames.setdefault(i, []).append(f)
        for i, own in frames.items():
            out[i] = write_avi(own, WIDTH, HEIGHT)
    return out


def render(e: list[float] | None) -> bytes | None:
    return render_all([e])[0]


def films(vectors: DataFrame) -> DataFrame:
    """A media table (media_id, data) made of vectors (vec_id, embedding), as the test tables hold no films."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 100):
                x = b.slice(i, 100)
                yield pa.RecordBatch.from_arrays([x["vec_id"], pa.array(render_all(x["embedding"].to_pylist()), pa.binary())], ["media_id", "data"])

    return picked(vectors, vec_id="long", embedding="array<double>").mapInArrow(run, "media_id long, data binary")


def op4_avi_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(films(table(spark, sf_dir, "embeddings")))


QUERIES = {"op4_avi_clips": op4_avi_clips}
#: The shots that were filmed; DuckDB counts list positions from 1.
SQL = {
    "op4_avi_clips": """
with v as (select vec_id, embedding as e, (e[1] > 0)::int + (e[2] > 0)::int + (e[3] > 0)::int + (e[4] > 0)::int + 1 as shots from embeddings),
s as (select vec_id, k as clip, 4 + (e[9 + k] > 0)::int + 2 * (e[13 + k] > 0)::int as n from v, range(5) t(k) where k < shots),
c as (select vec_id, clip, n, sum(n) over (partition by vec_id order by clip) as stop from s)
select vec_id as media_id, clip::int as clip, (stop - n)::int as first_frame, (stop - 1)::int as last_frame,
  round((stop - n) * 0.04::double, 6) as start_s, round(stop * 0.04::double, 6) as end_s, null::varchar as error from c"""
}
