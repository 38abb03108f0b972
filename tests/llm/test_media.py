"""Motion-JPEG AVI files: round trips, indexes, shots and broken input."""

from __future__ import annotations

import struct

import numpy as np
import pytest

from sleuthframe.llm import avi


def picture(seed, colour=True):
    rng = np.random.default_rng(seed)
    smooth = lambda h, w: np.kron(rng.integers(40, 200, (h // 8, w // 8)), np.ones((8, 8)))
    return [smooth(32, 48)] + ([smooth(16, 24), smooth(16, 24)] if colour else [])


@pytest.mark.parametrize("colour", [True, False])
def test_jpeg_round_trip(colour):
    planes = picture(1, colour)
    got = avi.decode_jpeg(avi.encode_jpeg(planes, quality=1))
    assert [p.shape for p in got] == [p.shape for p in planes]
    assert max(np.abs(a - b).max() for a, b in zip(got, planes)) <= 4


def test_frames_come_back_by_index_and_by_walk():
    frames = [avi.encode_jpeg(picture(k, False)) for k in range(5)]
    data = avi.write_avi(frames, 48, 32, usec=50_000)
    assert avi.read_avi(data) == (0.05, frames)
    at = data.index(b"idx1")
    assert avi.read_avi(data[:at])[1] == frames
    broken = data[:at] + data[at:].replace(struct.pack("<I", 4), struct.pack("<I", 5), 1)
    assert avi.read_avi(broken)[1] == frames


def test_shots():
    level = lambda x: np.bincount([x], minlength=avi.BINS).astype(float)
    assert avi.cuts([level(1)] * 4 + [level(5)] * 4 + [level(9)] * 3) == [4, 8]
    assert avi.cuts([level(k % 2) for k in range(9)]) == [] and avi.cuts([]) == []


def test_rows_and_broken_files(spark):
    v = [0.1] * 16 + [(-1) ** k * 0.2 for k in range(16)]
    film = avi.render(v)
    rows = [(1, film), (1, film), (2, None), (3, b""), (4, b"no film"), (5, film[:200]), (None, film), (6, film.replace(b"\xff\xda", b"\xff\xd9", 1))]
    got = avi.detect(spark.createDataFrame(rows, "media_id long, data binary").selectExpr("*", "1 as clip")).collect()
    lengths = avi.shot_lengths(v)
    ends = np.cumsum(lengths).tolist()
    one = [(k, a, b - 1, round(a * 0.04, 6), round(b * 0.04, 6)) for k, (a, b) in enumerate(zip([0, *ends], ends))]
    assert sorted(tuple(r)[1:6] for r in got if r.media_id == 1) == sorted(one * 2)
    assert sorted(tuple(r)[1:6] for r in got if r.media_id is None) == one
    assert {r.media_id for r in got if r.error} == {4, 5, 6} and not [r for r in got if r.media_id in (2, 3)]
    assert avi.detect(spark.createDataFrame([], "media_id long, data binary")).count() == 0
    assert avi.render(None) is None and avi.render([1.0]) is None


def hand_made(levels, width, height, restart=0, claim=None):
    """A grey frame made bit by bit with tables of its own: each block is level 128 + its value, by a DC difference alone."""
    bits, last = [[]], 0
    for i, x in enumerate(levels):
        if restart and i and i % restart == 0:
            bits.append([])
            last = 0
        d = x - last
        last = x
        n = abs(d).bit_length()
        # Code of category n: n ones and a zero, as 1 code of each length 1 to 9; end of block: one zero bit.
        bits[-1] += [1] * n + [0] + [int(b) for b in (f"{d if d > 0 else d + (1 << n) - 1:0{n}b}" if n else "")] + [0]
    pack = lambda b: bytes(int("".join(map(str, (b + [1] * 7)[i : i + 8])), 2) for i in range(0, len(b) + (-len(b)) % 8, 8))
    scan = b"".join((b"" if not k else bytes([0xFF, 0xD0 + (k - 1) % 8])) + pack(b).replace(b"\xff", b"\xff\0") for k, b in enumerate(bits))
    seg = lambda kind, body: bytes([0xFF, kind]) + struct.pack(">H", len(body) + 2) + body
    w, h = claim or (width, height)
    dc, ac = bytes([0]) + bytes([1] * 9) + bytes(7) + bytes(range(9)), bytes([0x10, 1]) + bytes(15) + bytes([0])
    head = seg(0xDB, b"\0" + bytes([8] * 64)) + seg(0xC0, struct.pack(">BHHB", 8, h, w, 1) + bytes([7, 0x11, 0])) + seg(0xC4, dc) + seg(0xC4, ac)
    return b"\xff\xd8" + head + (seg(0xDD, struct.pack(">H", restart)) if restart else b"") + seg(0xDA, bytes([1, 7, 0, 0, 63, 0])) + scan + b"\xff\xd9"


@pytest.mark.parametrize("restart", [0, 1, 2, 3])
def test_frames_of_another_encoder(restart):
    levels = [5, -60, 100, 100, -128, 127]
    got = avi.decode_jpeg(hand_made(levels, 20, 16, restart))
    assert len(got) == 1 and got[0].shape == (16, 20)
    want = np.kron(np.array(levels).reshape(2, 3) + 128, np.ones((8, 8)))[:, :20]
    assert (got[0] == want).all()


def test_a_frame_that_claims_too_much_is_an_error_at_once():
    import time

    for frame in (hand_made([1] * 8, 32, 16, claim=(65_500, 65_500)), hand_made([1] * 8, 32, 16, 3, claim=(65_500, 65_500))):
        began = time.perf_counter()
        with pytest.raises(avi.BadMedia, match="too short"):
            avi.decode_jpeg(frame)
        assert time.perf_counter() - began < 0.1
        assert avi.clips(avi.write_avi([frame], 32, 16)) == [(0, -1, -1, 0.0, 0.0, "frame 0: JPEG scan too short")]


def test_side_by_side_equals_one_by_one():
    rng = np.random.default_rng(3)
    frames = [avi.encode_jpeg(picture(k, k % 3 > 0), quality=1 + k % 5) for k in range(60)] + [hand_made(rng.integers(-100, 100, 6).tolist(), 24, 16, k % 4) for k in range(40)]
    broken = []
    for k, f in enumerate(frames):
        at = int(rng.integers(len(f) // 2, len(f)))
        broken.append([f[:at], f[:at] + bytes([int(rng.integers(256))]) + f[at + 1 :], f[:at] + b"\xff\xc3" + f[at:]][k % 3])
    for some in (frames, broken, frames[:1] + broken):
        assert len(some) >= avi.LANES
        together, alone = avi.decode_frames(some), [avi.decode_frames([f])[0] for f in some]
        for a, b in zip(together, alone):
            assert isinstance(a, str) == isinstance(b, str)
            assert isinstance(a, str) or all((x == y).all() for x, y in zip(a, b))
    assert not any(isinstance(x, str) for x in avi.decode_frames(frames)) and any(isinstance(x, str) for x in avi.decode_frames(broken))


def test_noise_survives_the_coder():
    """All kinds of runs and sizes: long runs of zeros, full blocks, the largest values."""
    rng = np.random.default_rng(9)
    coefs = rng.integers(-1000, 1000, (40, 1, 64)) * (rng.random((40, 1, 64)) < rng.choice([0.02, 0.1, 0.9], (40, 1, 1)))
    scan = avi.pack_scans([coefs[None]])[0]
    f = avi.Head(320, 8, [(1, 1, 0)], {0: np.ones(64)}, [(0, avi.STANDARD[0, 0], avi.STANDARD[1, 0])], 40, 1, 0, 0)
    out = np.zeros((40, 64), np.int64)
    avi.one_scan(f, scan.replace(b"\xff\x00", b"\xff"), 40, out)
    assert (out == coefs[:, 0]).all()
