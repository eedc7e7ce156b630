import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from diskloom.functions import pictures as p


def line(data, width, done=()):
    return p.decode_line(p._Reader(bytes.fromhex(data), 0), width, list(done))


def test_hand_vectors():
    assert line("40AA0255FF", 4) == bytes.fromhex("AAAA5555")
    assert line("91017FFF", 4, [b"\1\2\3\4"]) == bytes.fromhex("017F0304")
    assert line("B10102AABBFF", 4, [b"\1\2\3\4"]) == bytes.fromhex("01AABB04")
    assert line("A1811122", 8, [bytes(8)]) == bytes.fromhex("1100000000000022")
    width, height, planes = p.decode_rbyte(bytes.fromhex("0100010000F0000F00FF"))
    assert (width, height, planes) == (1, 1, [b"\xf0", b"\x0f", b"\xff"])
    assert p.decode_rbyte88(bytes.fromhex("0102AAAA0000FF00"))[2] == [b"\xaa\xaa", b"\0\0", b"\xff\0"]


@pytest.mark.parametrize("data", ["80", "90FF", "A0", "4001", "400100", "00", "82", "B00101", "B000FF01"])
def test_faults(data):
    with pytest.raises(p.BadPicture):
        line(data, 2, [b"\0\0"])


def random_planes(r, w, h):
    out = []
    for _ in range(3):
        rows = []
        for _ in range(h):
            row = bytearray(r.choice(rows[-3:])) if rows and r.random() < 0.6 else bytearray(r.choice([0, 0, 255, r.randrange(256)]) for _ in range(w))
            for _ in range(r.randrange(3) if w else 0):
                row[r.randrange(w)] = r.randrange(4)
            rows.append(bytes(row))
        out.append(b"".join(rows))
    return out


def test_encoders_invert_decoders():
    r = random.Random(1)
    for _ in range(60):
        w, h = r.randrange(18), r.randrange(10)
        planes = random_planes(r, w, h)
        sizes = []
        for level in (0, 1, 2, 3, 8, 9, 31):
            packed = p.encode_rbyte(w, h, planes, level)
            assert p.decode_rbyte(packed) == (w, h, planes)
            sizes.append(len(packed))
        assert sizes[-1] <= sizes[0]
        assert p.decode_rbyte88(p.encode_rbyte88(w, h, planes)) == (w, h, planes)
    long = bytes([7]) * 5000
    assert p.decode_rbyte88(p.encode_rbyte88(50, 100, [long] * 3))[2] == [long] * 3


def test_padding_and_places():
    packed = p.encode_rbyte88(1, 1, [b"\1", b"\2", b"\3"])
    assert p.decode_rbyte88((packed + b"\x1a").ljust(256, b"\0"))[0] == 1
    for bad in (packed + b"\0", packed + b"\x1a", packed + b"\x1a" + bytes(600)):
        with pytest.raises(p.BadPicture):
            p.decode_rbyte88(bad)
    planes = [bytes(6)] * 3
    assert p.png_of(2, 3, planes).startswith(b"\x89PNG") and b"PLTE" in p.png_of(2, 3, planes) and b"gAMA" in p.png_of(2, 3, planes)
    assert b"PLTE" not in p.png_of(2, 3, planes, 4, 5)
    with pytest.raises(p.BadPicture):
        p.png_of(2, 3, planes, 79, 0)


def test_columns(spark):
    pixels = np.random.default_rng(0).integers(0, 256, (5, 9, 3)).astype(np.uint8)
    image = F.struct(F.lit(9).alias("width"), F.lit(5).alias("height"), F.lit(3).alias("nChannels"), F.lit(bytearray(pixels.tobytes())).alias("data"))
    df = spark.range(1).select(p.rbyte_encode(image).alias("a"), p.rbyte88_encode(image).alias("b"))
    row = df.select(p.rbyte_decode(F.col("a.data")).alias("x"), p.rbyte88_decode(F.col("b.data")).alias("y"), p.rbyte_decode(F.lit(bytearray(b"\1"))).alias("z")).first()
    assert bytes(row.x.green) == bytes(row.y.green) and row.x.width == 2 and row.x.height == 3 and row.z.error


def test_png_goes_there_and_back():
    r = random.Random(2)
    w, h = 3, 5
    planes = random_planes(r, w, h)
    bits = [np.unpackbits(np.frombuffer(q, np.uint8).reshape(h, w), axis=1) for q in planes]
    want = np.dstack([bits[1], bits[2], bits[0]]).repeat(2, axis=0) * 255
    assert (p.read_png(p.png_of(w, h, planes)) == want).all()
    placed = p.read_png(p.png_of(w, h, planes, 4, 6))
    assert placed.shape == (400, 640, 3) and (placed[12:22, 32:56] == want).all() and placed.sum() == want.sum()


@pytest.mark.parametrize("kind, depth", [(0, 1), (0, 2), (0, 4), (0, 8), (0, 16), (2, 8), (2, 16), (3, 1), (3, 4), (3, 8), (4, 8), (4, 16), (6, 8), (6, 16)])
@pytest.mark.parametrize("laced", [0, 1])
def test_png_of_every_kind(kind, depth, laced):
    import struct
    import zlib

    r = np.random.default_rng(kind * 100 + depth)
    w, h, channels = 13, 9, {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[kind]
    samples = r.integers(0, 1 << min(depth, 8), (h, w, channels))
    colours = r.integers(0, 256, (256, 3)).astype(np.uint8)
    rows, whole = b"", []
    passes = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)) if laced else ((0, 0, 1, 1),)
    step = max(1, channels * depth // 8)
    for x0, y0, dx, dy in passes:
        part = samples[y0::dy, x0::dx]
        if not part.size:
            continue
        before = None
        for y, line in enumerate(part):
            flat = line.ravel()
            if depth == 16:
                raw = bytes(v for s in flat for v in (int(s), int(r.integers(0, 256))))
            elif depth == 8:
                raw = bytes(flat.tolist())
            else:
                text = "".join(format(int(s), f"0{depth}b") for s in flat)
                raw = bytes(int(text[k : k + 8].ljust(8, "0"), 2) for k in range(0, len(text), 8))
            way = int(r.integers(0, 5))
            old = before or bytes(len(raw))

            def guess(k):
                a, b, c = raw[k - step] if k >= step else 0, old[k], old[k - step] if k >= step else 0
                e = a + b - c
                near = a if abs(e - a) <= abs(e - b) and abs(e - a) <= abs(e - c) else b if abs(e - b) <= abs(e - c) else c
                return (0, a, b, (a + b) // 2, near)[way]

            rows += bytes([way]) + bytes(raw[k] - guess(k) & 255 for k in range(len(raw)))
            before = raw
    chunk = lambda tag, body: struct.pack(">I", len(body)) + tag + body + struct.pack(">I", zlib.crc32(tag + body))
    data = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, kind, 0, 0, laced)) + chunk(b"PLTE", colours.tobytes()) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")
    shade = samples * 255 // ((1 << min(depth, 8)) - 1)
    want = colours[samples[:, :, 0]] if kind == 3 else np.repeat(shade[:, :, :1], 3, axis=2) if channels < 3 else samples[:, :, :3]
    assert (p.read_png(data) == want).all()


def test_large_images_are_scaled_down():
    flat = np.full((900, 1300, 3), 77, dtype=np.uint8)
    assert (p.scaled(flat, 577, 400) == 77).all()
    w, h, planes = p.planes_of(flat)
    assert (w, h) == ((int(1300 * 400 / 900) + 7) // 8, 200)
    ramp = np.repeat(np.linspace(0, 255, 1280).astype(np.uint8)[None, :, None], 3, axis=2).repeat(4, axis=0)
    half = p.scaled(ramp, 640, 4)[0, :, 0].astype(int)
    assert abs(half - ramp[0, :, 0].astype(int).reshape(-1, 2).mean(axis=1)).max() <= 1 and (np.diff(half) >= 0).all()
    # the filter written out for one pixel
    def cubic(x):
        x = abs(x)
        return 1.5 * x**3 - 2.5 * x**2 + 1 if x < 1 else -0.5 * x**3 + 2.5 * x**2 - 4 * x + 2 if x < 2 else 0.0
    row = np.random.default_rng(1).integers(0, 256, 30)
    got = p.scaled(np.repeat(row[None, :, None], 3, axis=2).astype(np.uint8), 7, 1)[0, :, 0]
    for k in range(7):
        centre = (k + 0.5) * 30 / 7
        w = {x: cubic((x + 0.5 - centre) / (30 / 7)) for x in range(30)}
        assert abs(int(got[k]) - min(255, max(0, round(sum(row[x] * w[x] for x in w) / sum(w.values()))))) <= 1


def test_pictures_that_end_too_soon(spark):
    planes = [b"\xf0\x0f", b"\xff\x00", b"\xaa\x55"]
    whole = p.encode_rbyte(1, 2, planes, 0)
    for cut, lines in ((len(whole), (2, 2, 2)), (len(whole) - 1, (2, 2, 1)), (len(whole) - 4, (2, 2, 0)), (8, (2, 0, 0)), (7, (1, 0, 0)), (4, (0, 0, 0))):
        width, height, found, drawn, why = p.drawn_rbyte(whole[:cut])
        assert (width, height, tuple(drawn), why is None) == (1, 2, lines, cut == len(whole))
    row = spark.createDataFrame([(bytearray(whole),), (bytearray(whole[:-1]),), (None,), (bytearray(b"\1"),)], "b binary").select(p.rbyte_png(F.col("b")).alias("x")).collect()
    assert [r.x.error is None for r in row] == [True, False, False, False] and [r.x.png is None for r in row] == [False, False, True, True]
    half = p.read_png(bytes(row[1].x.png))
    assert half.shape == (4, 8, 3) and half[2:, :, 1].sum() == 0 and half[:2, :, 1].sum() == 255 * 8
    wide = F.struct(F.lit(1).alias("width"), F.lit(2).alias("height"), F.lit(3).alias("nChannels"), F.lit(bytearray(b"\0\xff" * 6)).alias("data"))
    assert spark.range(1).select(p.rbyte_encode(wide).alias("x")).select(p.rbyte_decode(F.col("x.data")).alias("y")).first().y.green == b"\x80"
    back = spark.createDataFrame([(row[0].x.png,), (bytearray(b"x"),)], "b binary").select(p.image_of(F.col("b")).alias("i")).collect()
    assert back[0].i.width == 8 and back[0].i.height == 4 and back[1].i.width is None


def test_line_commands_up_to_a_length_are_those_of_any_length_that_fit():
    r = random.Random(4)
    for _ in range(400):
        n = r.choice([1, 7, 8, 20, 300, 600])
        old = bytes(r.choice([0, 255, r.randrange(256)]) for _ in range(n))
        row = bytearray(old)
        for _ in range(r.choice([1, 2, n])):
            row[r.randrange(n)] ^= r.randrange(1, 256)
        every = p._relative(bytes(row), old, 3, 10**6)
        for most in (1, 2, 3, n // 8 + 2, n, 2 * n + 9):
            assert [x for x in p._relative(bytes(row), old, 3, most) if len(x) <= most] == [x for x in every if len(x) <= most]


def test_pictures_lie_in_tasks_of_bounded_size(spark, monkeypatch):
    from diskloom.plans import texts

    monkeypatch.setattr(texts, "_PICTURES_A_TASK", 10)
    drawn = texts._drawn(spark, "/root/testdata/sf0.001")
    sizes = [r["count"] for r in drawn.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert len(sizes) >= sum(sizes) // 10 and max(sizes) <= 20
