"""The two compressed picture formats of planar images, PNG output, and encoders for both.

Both decoders are byte-driven state machines, so they run in Arrow-fed functions; a picture that
can't be decoded gives an error text and no planes. Planes are in the order blue, red, green; a
plane is height lines of width bytes, the leftmost pixel in the highest bit.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_WIDTH, MAX_HEIGHT, SECTOR = 80, 200, 256
PLANES_DDL = "struct<width:int,height:int,blue:binary,red:binary,green:binary,error:string>"
REST = 0xFF


class BadPicture(ValueError):
    """Why a picture can't be decoded or encoded."""


def _checked(width: int, height: int) -> None:
    if width > MAX_WIDTH:
        raise BadPicture(f"image width ({width} bytes) exceeds screen width")
    if height > MAX_HEIGHT:
        raise BadPicture(f"image height ({height} lines) exceeds screen height")


class _Reader:
    def __init__(self, data: bytes, at: int) -> None:
        self.data, self.at = data, at

    def take(self, n: int = 1) -> bytes:
        out = self.data[self.at : self.at + n]
        if len(out) < n:
            raise BadPicture("the data end within a plane")
        self.at += n
        return out

    def number(self) -> int:
        return self.take()[0]


def _mixed(source: _Reader, above: bytes, width: int) -> bytes:
    """Copies from above and literals in turn; FF copies or takes the rest."""
    line = bytearray()
    copying, first = True, True
    while True:
        n = source.number()
        lead = first and not copying and not line  # the literal count after a leading 0 is plain
        if n == REST and not (lead and not copying):
            rest = width - len(line)
            line += above[len(line) : width] if copying else source.take(max(0, rest))
            return bytes(line)
        if not copying:
            first = False
        line += above[len(line) : len(line) + n] if copying else source.take(n)
        if len(line) > width or (copying and len(line) < n):
            raise BadPicture("a drawing leaves its line")
        copying = not copying


def decode_line(source: _Reader, width: int, done: list[bytes]) -> bytes:
    """One command's line; ``done`` are the plane's lines above."""
    command = source.number()
    back = command & 15

    def above() -> bytes:
        if back > len(done):
            raise BadPicture(f"command {command:02X} reaches above the image")
        if not back and command < 0xB0:
            raise BadPicture(f"command {command:02X} with zero deflection")
        if not back:
            raise BadPicture("copying pixels that are not drawn yet")
        return done[-back]

    if command == 0x40:
        line = b""
        while True:
            value, n = source.take(2)
            if n == 0:
                raise BadPicture("a repeat count of zero")
            if n == REST:
                return line + bytes([value]) * (width - len(line))
            line += bytes([value]) * n
            if len(line) > width:
                raise BadPicture("a drawing leaves its line")
    if command < 0x80:
        return source.take(width)
    if command < 0x90:
        return above()
    if command < 0xA0:
        old, out = above(), bytearray()
        while (n := source.number()) != REST:
            out += old[len(out) : len(out) + n] + source.take()
            if len(out) > width:
                raise BadPicture("a drawing leaves its line")
        return bytes(out) + old[len(out) :]
    if command < 0xB0:
        new = bytearray(above())
        masks = np.unpackbits(np.frombuffer(source.take(width // 8), dtype=np.uint8))
        for k in np.flatnonzero(masks):
            new[k] = source.number()
        return bytes(new)
    if back == 0:  # its own line: literals only
        return _mixed(source, b"", width)
    return _mixed(source, above(), width)


def decode_rbyte(data: bytes) -> tuple[int, int, list[bytes]]:
    """(width, height, planes) of a PC-98 picture without its wrapper."""
    if len(data) < 4:
        raise BadPicture("not enough data for a picture header")
    width, height = struct.unpack("<HH", data[:4])
    _checked(width, height)
    source, planes = _Reader(data, 4), []
    for _ in range(3):
        done: list[bytes] = []
        for _ in range(height if width else 0):
            line = decode_line(source, width, done)
            if len(line) != width:
                raise BadPicture("copying pixels that are not drawn yet")
            done.append(line)
        planes.append(b"".join(done))
    return width, height, planes


def drawn_rbyte(data: bytes) -> tuple[int, int, list[bytes], list[int], str | None]:
    """(width, height, planes, lines drawn of each plane, error): what there is of a picture that may end too soon."""
    if len(data) < 4:
        raise BadPicture("not enough data for a picture header")
    width, height = struct.unpack("<HH", data[:4])
    _checked(width, height)
    source, planes, why = _Reader(data, 4), [[], [], []], None
    try:
        for done in planes:
            for _ in range(height if width else 0):
                line = decode_line(source, width, done)
                if len(line) != width:
                    raise BadPicture("copying pixels that are not drawn yet")
                done.append(line)
    except BadPicture as fault:
        why = str(fault)
    return width, height, [b"".join(p).ljust(width * height, b"\0") for p in planes], [len(p) for p in planes], why


def decode_rbyte88(data: bytes) -> tuple[int, int, list[bytes]]:
    """(width, height, planes) of a PC-88 picture: two equal bytes are followed by a count of themselves."""
    if len(data) < 2:
        raise BadPicture("not enough data for a picture header")
    vertical, width, height = data[0] >= 0x80, data[0] & 0x7F, data[1]
    _checked(width, height)
    size = width * height
    out, same, at = bytearray(), 0, 2
    while at < len(data) and len(out) < 3 * size:
        value, before = data[at], len(out)
        at += 1
        if same == 2:
            if value == 0:
                raise BadPicture("a repeat count of zero")
            out += out[-1:] * (value - 1)
            same = 0
        else:
            same = same + 1 if same and out[-1] == value else 1
            out.append(value)
        if size and len(out) // size != before // size:
            same = 0  # a plane's last pair has no count
    if len(out) > 3 * size:
        raise BadPicture("a repetition leaves the image")
    extra = data[at:]
    if extra[:1] not in (b"", b"\x1a"):
        raise BadPicture("extra bytes must begin with the end-of-file mark")
    if len(extra) > 2 * SECTOR:
        raise BadPicture("too much padding")
    if extra and len(data) % SECTOR:
        raise BadPicture("padded length must be a multiple of 256")
    if len(out) < 3 * size:
        raise BadPicture("the data end within a plane")
    planes = np.frombuffer(bytes(out), dtype=np.uint8).reshape(3, width, height) if vertical else np.frombuffer(bytes(out), dtype=np.uint8).reshape(3, height, width)
    return width, height, [p.tobytes() for p in (planes.transpose(0, 2, 1) if vertical else planes)]


def _decoder(decode):
    @F.pandas_udf(PLANES_DDL)
    def run(column: pd.Series) -> pd.DataFrame:
        rows = []
        for data in column:
            try:
                if data is None:
                    raise BadPicture("no data")
                width, height, planes = decode(bytes(data))
                rows.append((width, height, *planes, None))
            except BadPicture as why:
                rows.append((None, None, None, None, None, str(why)))
        return pd.DataFrame(rows, columns=["width", "height", "blue", "red", "green", "error"], dtype=object)

    return run


def rbyte_decode(data: Column) -> Column:
    """struct(width, height, blue, red, green, error) of a PC-98 picture."""
    return _decoder(decode_rbyte)(data)


def rbyte88_decode(data: Column) -> Column:
    """struct(width, height, blue, red, green, error) of a PC-88 picture."""
    return _decoder(decode_rbyte88)(data)


# Encoding

#: Dither tiles by level: rows that repeat downwards as far as a row is long.
_TILES = ["0", "00000001 0 00010000 0", "000001000 000000001 001000000", "0001 0 0100 0", "001 010 100", "0011 0011 1100 1100", "01 10", "011 110 101", "1101 1 0111 1", "111110111 111111110 110111111", "11101111 1 11111110 1", "1"]


def _tile(spec: str) -> np.ndarray:
    rows = spec.split()
    width = max(map(len, rows))
    full = [r * (width // len(r)) for r in rows]
    return np.array([[int(c) for c in r] for r in full], dtype=np.uint8)


def _weights(size: int, to: int) -> np.ndarray:
    """(to, size) matrix of a cubic filter (a = -1/2) as wide as the reduction, in 22-bit fixed point."""
    ratio = size / to
    wide = max(ratio, 1.0)
    out = np.zeros((to, size))
    for k in range(to):
        centre = (k + 0.5) * ratio
        first, last = max(0, int(centre - 2 * wide + 0.5)), min(size, int(centre + 2 * wide + 0.5))
        x = np.abs((np.arange(first, last) - centre + 0.5) / wide)
        own = np.where(x < 1, (1.5 * x - 2.5) * x * x + 1, np.where(x < 2, ((-0.5 * x + 2.5) * x - 4) * x + 2, 0.0))
        out[k, first:last] = own / own.sum()
    return np.trunc(out * (1 << 22) + np.where(out < 0, -0.5, 0.5)).astype(np.int64)


def scaled(pixels: np.ndarray, width: int, height: int) -> np.ndarray:
    """An (h, w, 3) image in another size, first across and then down, rounded to bytes after each."""
    half = 1 << 21
    if width != pixels.shape[1]:
        pixels = np.clip((np.einsum("kw,hwc->hkc", _weights(pixels.shape[1], width), pixels.astype(np.int64)) + half) >> 22, 0, 255).astype(np.uint8)
    if height != pixels.shape[0]:
        pixels = np.clip((np.einsum("kh,hwc->kwc", _weights(pixels.shape[0], height), pixels.astype(np.int64)) + half) >> 22, 0, 255).astype(np.uint8)
    return pixels


def planes_of(pixels: np.ndarray) -> tuple[int, int, list[bytes]]:
    """Dithered planes of an (h, w, 3) RGB image: the brighter of each two scan lines in eight colours.

    Images over 640 x 400 pixels are scaled down to fit, keeping their shape.
    """
    h, w = pixels.shape[:2]
    if w > 8 * MAX_WIDTH or h > 2 * MAX_HEIGHT:
        scale = min(8 * MAX_WIDTH / w, 2 * MAX_HEIGHT / h)
        w, h = int(w * scale), int(h * scale)
        if not w or not h:
            raise BadPicture("nothing is left of the image at 640 x 400 pixels")
        pixels = scaled(pixels, w, h)
    width, height = (w + 7) // 8, (h + 1) // 2
    upper = pixels[0::2].astype(np.int64)
    lower = upper.copy()
    lower[: h // 2] = pixels[1::2]
    best = np.where((upper.sum(axis=2) >= lower.sum(axis=2))[:, :, None], upper, lower)
    level = np.zeros((height, width * 8, 3), dtype=np.int64)
    level[:, :w] = best
    level = (level * (len(_TILES) - 1) + 128) // 255
    bits = np.zeros(level.shape, dtype=np.uint8)
    y, x = np.arange(height)[:, None], np.arange(width * 8)[None, :]
    for k, spec in enumerate(_TILES):
        tile = _tile(spec)
        bits = np.where(level == k, tile[y % tile.shape[0], x % tile.shape[1]][:, :, None], bits)
    return width, height, [np.packbits(bits[:, :, c], axis=1).tobytes() for c in (2, 0, 1)]


def _better(now: bytes, new: bytes, level: int) -> bytes:
    """The shorter line; at odd levels also an equally long one in place of a literal."""
    even = level & 1 and len(new) == len(now) and now[0] == 0
    return new if level > 0 and (len(new) < len(now) or even) else now


def _repeats(row: bytes) -> bytes:
    out, k = b"\x40", 0
    while k < len(row):
        n = 1
        while k + n < len(row) and row[k + n] == row[k]:
            n += 1
        out += bytes([row[k], REST if k + n == len(row) else n])
        k += n
    return out


def _relative(row: bytes, old: bytes, back: int, most: int) -> list[bytes]:
    """The line commands of at most ``most`` bytes that lean on a line ``back`` lines above."""
    n = len(row)
    differs = [k for k, (x, y) in enumerate(zip(row, old)) if x != y]
    out: list[bytes] = []
    if 2 * len(differs) + 2 <= most:
        one, at = bytearray([0x90 | back]), 0
        for k in differs:
            if k - at >= REST:
                return []
            one += bytes([k - at, row[k]])
            at = k + 1
        out.append(bytes(one) + bytes([REST]))
    elif any(k - at >= REST for k, at in zip(differs, [0, *(k + 1 for k in differs)])):
        return []
    if len(differs) + n // 8 + 1 <= most and (not differs or differs[-1] < n // 8 * 8):
        masks = bytearray(n // 8)
        for k in differs:
            masks[k // 8] |= 0x80 >> k % 8
        out.append(bytes([0xA0 | back]) + bytes(masks) + bytes(row[k] for k in differs))
    if len(differs) + 3 > most:  # a run of differing bytes has two counts besides its bytes
        return out
    two, at = bytearray([0xB0 | back]), 0
    while at < n:
        stop = next((k for k in range(at, n) if row[k] != old[k]), n)
        if stop == n:
            two += bytes([REST])
            break
        end = next((k for k in range(stop, n) if row[k] == old[k]), n)
        two += bytes([stop - at, REST if end == n else end - stop]) + row[stop:end]
        at = end
    return [*out, bytes(two)]


def encode_rbyte(width: int, height: int, planes: list[bytes], level: int = 9) -> bytes:
    """A PC-98 picture; level 0 is literal, above 2 it looks back at up to (level - 1) / 2 lines."""
    out = struct.pack("<HH", width, height)
    for plane in planes:
        rows = [plane[k * width : (k + 1) * width] for k in range(height)]
        for y, row in enumerate(rows):
            best = b"\0" + row
            for back in range(1, (min(level - 1 >> 1, 15) if level > 2 else 0) + 1):
                if back > y:
                    break
                old = rows[y - back]
                found = bytes([0x80 | back]) if row == old else best
                for new in _relative(row, old, back, len(found)) if len(found) > 1 else ():
                    found = _better(found, new, level)
                best = _better(best, found, level)
            if width:
                best = _better(best, _repeats(row), level)
            out += best if width else b""
    return out


def _runs(plane: bytes) -> bytes:
    out, k = bytearray(), 0
    while k < len(plane):
        n = 1
        while k + n < len(plane) and plane[k + n] == plane[k] and n < 256:
            n += 1
        out += plane[k : k + 1] if n == 1 else plane[k : k + 1] * 2 + (b"" if n == 2 and k + n == len(plane) else bytes([n - 1]))
        k += n
    return bytes(out)


def encode_rbyte88(width: int, height: int, planes: list[bytes]) -> bytes:
    """A PC-88 picture in the direction whose green plane is shorter, vertical at a tie."""
    both = []
    for vertical in (False, True):
        packed = []
        for plane in planes:
            grid = np.frombuffer(plane, dtype=np.uint8).reshape(height, width)
            packed.append(_runs((grid.T if vertical else grid).tobytes()))
        both.append((len(packed[-1]), bytes([width | (0x80 if vertical else 0), height]) + b"".join(packed)))
    return both[0][1] if both[0][0] < both[1][0] else both[1][1]


def rgb(image: Column) -> Column:
    """Rows of Spark's image source as (width, height, RGB bytes): its data are blue, green, red."""
    return F.struct(image["width"].alias("width"), image["height"].alias("height"), image["nChannels"].alias("channels"), image["data"].alias("data"))


def _encoder(kind: str, level: int):
    @F.pandas_udf("struct<data:binary,error:string>")
    def run(image: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for width, height, channels, data in zip(image["width"], image["height"], image["channels"], image["data"]):
            try:
                raw = np.frombuffer(data, dtype=np.uint8)
                raw = (raw[1::2] if len(raw) == 2 * height * width * channels else raw).reshape(height, width, channels)  # of 16-bit samples the high byte
                pixels = np.repeat(raw, 3, axis=2) if channels == 1 else raw[:, :, 2::-1]
                w, h, planes = planes_of(pixels)
                rows.append((encode_rbyte(w, h, planes, level) if kind == "rbyte" else encode_rbyte88(w, h, planes), None))
            except (BadPicture, TypeError, ValueError) as why:
                rows.append((None, str(why)))
        return pd.DataFrame(rows, columns=["data", "error"], dtype=object)

    return run


def rbyte_encode(image: Column, level: int = 9) -> Column:
    """struct(data, error): the PC-98 picture of an image column."""
    return _encoder("rbyte", level)(rgb(image))


def rbyte88_encode(image: Column) -> Column:
    return _encoder("rbyte88", 0)(rgb(image))


def _chunk(tag: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + tag + body + struct.pack(">I", zlib.crc32(tag + body))


def png_of(width: int, height: int, planes: list[bytes], x: int | None = None, y: int | None = None) -> bytes:
    """A scan-doubled PNG: palette colours, or with a place given on a transparent screen."""
    bits = [np.unpackbits(np.frombuffer(p, dtype=np.uint8).reshape(height, width), axis=1).repeat(2, axis=0) for p in planes]
    blue, red, green = bits
    cols, rows = 8 * (MAX_WIDTH if x is not None else width), 2 * (MAX_HEIGHT if y is not None else height)
    if (x or 0) + width > MAX_WIDTH or (y or 0) + height > MAX_HEIGHT or min(x or 0, y or 0) < 0:
        raise BadPicture("the place puts the image off the screen")
    top, left = 2 * (y or 0), 8 * (x or 0)
    if cols == 8 * width and rows == 2 * height:
        kind, pixels = 3, (green + 2 * red + 4 * blue).astype(np.uint8)[:, :, None]
        colours = b"".join(bytes(255 if k & m else 127 if k & 8 else 0 for m in (2, 1, 4)) for k in range(16))
        extra = _chunk(b"PLTE", colours)
    else:
        kind, extra = 6, b""
        pixels = np.zeros((rows, cols, 4), dtype=np.uint8)
        own = np.stack([red, green, blue, np.ones_like(red)], axis=2) * 255
        pixels[top : top + 2 * height, left : left + 8 * width] = own
    return _png(cols, rows, kind, pixels, extra)


def _png(cols: int, rows: int, kind: int, pixels: np.ndarray, extra: bytes) -> bytes:
    lines = np.concatenate([np.zeros((rows, 1), dtype=np.uint8), pixels.reshape(rows, -1)], axis=1).tobytes()
    head = b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", struct.pack(">IIBBBBB", cols, rows, 8, kind, 0, 0, 0)) + _chunk(b"gAMA", (45455).to_bytes(4, "big"))
    return head + extra + _chunk(b"IDAT", zlib.compress(lines)) + _chunk(b"IEND", b"")


def png_of_drawn(width: int, height: int, planes: list[bytes], lines: list[int]) -> bytes:
    """A scan-doubled PNG of a picture of which so many lines of each plane are drawn.

    Pixels without a plane are transparent, those with some of the planes half transparent.
    """
    blue, red, green = (np.unpackbits(np.frombuffer(p, dtype=np.uint8).reshape(height, width), axis=1) for p in planes)
    there = np.array([np.arange(height) < n for n in lines]).sum(axis=0)
    alpha = np.where(there == 3, 255, np.where(there == 0, 0, 127)).astype(np.uint8)
    pixels = np.dstack([red * 255, green * 255, blue * 255, np.repeat(alpha[:, None], 8 * width, axis=1)]).astype(np.uint8).repeat(2, axis=0)
    return _png(8 * width, 2 * height, 6, pixels, b"")


def rbyte_png(data: Column) -> Column:
    """struct(png, error) of a PC-98 picture: whole, or as much as is drawn before the fault."""

    @F.pandas_udf("struct<png:binary,error:string>")
    def run(column: pd.Series) -> pd.DataFrame:
        rows = []
        for raw in column:
            try:
                if raw is None:
                    raise BadPicture("no data")
                width, height, planes, lines, why = drawn_rbyte(bytes(raw))
                rows.append((png_of(width, height, planes) if why is None else png_of_drawn(width, height, planes, lines), why))
            except BadPicture as why:
                rows.append((None, str(why)))
        return pd.DataFrame(rows, columns=["png", "error"], dtype=object)

    return run(data)


def read_png(data: bytes) -> np.ndarray:
    """(h, w, 3) RGB bytes of a PNG of any kind: of 16-bit samples the high byte, of transparency nothing is kept."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise BadPicture("not a PNG")
    at, body, colours = 8, b"", None
    while at + 8 <= len(data):
        size, tag = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
        own = data[at + 8 : at + 8 + size]
        if tag == b"IHDR":
            width, height, depth, kind, _, _, laced = struct.unpack(">IIBBBBB", own)
        elif tag == b"PLTE":
            colours = np.frombuffer(own, dtype=np.uint8).reshape(-1, 3)
        elif tag == b"IDAT":
            body += own
        at += 12 + size
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[kind]
    raw, place = zlib.decompress(body), 0
    out = np.zeros((height, width, channels), dtype=np.uint8)
    step = max(1, channels * depth // 8)
    for x0, y0, dx, dy in ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)) if laced else ((0, 0, 1, 1),):
        w, h = -(-(width - x0) // dx), -(-(height - y0) // dy)
        if w <= 0 or h <= 0:
            continue
        line = -(-w * channels * depth // 8)
        before = bytearray(line)
        for y in range(h):
            way, now = raw[place], bytearray(raw[place + 1 : place + 1 + line])
            place += 1 + line
            for k in range(line) if way else ():
                a, b, c = now[k - step] if k >= step else 0, before[k], before[k - step] if k >= step else 0
                near = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
                now[k] = now[k] + (a, b, (a + b) // 2, near)[way - 1] & 255
            before = now
            samples = np.frombuffer(bytes(now), dtype=np.uint8)
            if depth == 16:
                samples = samples[::2]
            elif depth < 8:
                bits = np.unpackbits(samples).reshape(-1, depth)
                samples = (bits @ (1 << np.arange(depth)[::-1])).astype(np.uint8)[: w * channels]
                samples = samples if kind == 3 else (samples.astype(np.int64) * 255 // ((1 << depth) - 1)).astype(np.uint8)
            out[y0 + y * dy, x0 : width : dx] = samples.reshape(w, channels)
    if kind == 3:
        return colours[out[:, :, 0]]
    return np.repeat(out[:, :, :1], 3, axis=2) if channels < 3 else out[:, :, :3]


def image_of(png_bytes: Column) -> Column:
    """struct(width, height, nChannels, data) of a PNG, as the image source has it; null where it can't be read."""

    @F.pandas_udf("struct<width:int,height:int,nChannels:int,data:binary>")
    def run(column: pd.Series) -> pd.DataFrame:
        rows = []
        for raw in column:
            try:
                pixels = read_png(bytes(raw))
                rows.append((pixels.shape[1], pixels.shape[0], 3, pixels[:, :, ::-1].tobytes()))
            except (BadPicture, TypeError, KeyError, IndexError, ValueError, UnboundLocalError, struct.error, zlib.error):
                rows.append((None, None, None, None))
        return pd.DataFrame(rows, columns=["width", "height", "nChannels", "data"], dtype=object)

    return run(png_bytes)


def png(picture: Column, x: int | None = None, y: int | None = None) -> Column:
    """PNG bytes of a decoded picture, null where it has none or its place is off the screen."""

    @F.pandas_udf("binary")
    def run(p: pd.DataFrame) -> pd.Series:
        out = []
        for width, height, *planes in zip(p["width"], p["height"], p["blue"], p["red"], p["green"]):
            try:
                out.append(None if planes[0] is None else png_of(int(width), int(height), planes, x, y))
            except BadPicture:
                out.append(None)
        return pd.Series(out, dtype=object)

    return run(picture)


def png_name(path: Column, suffix: str = "_rbyte", x: int | None = None, y: int | None = None) -> Column:
    """File name of a PNG beside its source's name."""
    place = f"_{x}_{y}" if x is not None and y is not None else ""
    return F.concat(F.regexp_replace(path, r"^.*/", ""), F.lit(f"{place}{suffix}.png"))
