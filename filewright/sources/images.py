"""PNG decoding to gray, area thumbnails and difference hashes as Arrow-batched functions."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructField, StructType

SIGNATURE = b"\x89PNG\r\n\x1a\n"
MAX_PIXELS = 40_000_000
#: Channels of each colour type, and the bit depths that it may have.
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
DEPTHS = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}
GRAY = StructType([StructField("width", IntegerType()), StructField("height", IntegerType()), StructField("gray", BinaryType()), StructField("reason", StringType())])


def png_size(content: Column) -> Column:
    """struct(width, height) from the header alone; null if it is no PNG."""
    number = lambda at: F.conv(F.hex(F.substring(content, at, 4)), 16, 10).cast("int")
    ok = F.hex(F.substring(content, 1, 8)) == SIGNATURE.hex().upper()
    return F.when(ok, F.struct(number(17).alias("width"), number(21).alias("height")))


def _chunks(data: bytes):
    at = len(SIGNATURE)
    while at + 12 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if len(body) < size or zlib.crc32(kind + body) != struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("broken chunk")
        yield kind, body
        at += 12 + size


def _diagonals(lines: np.ndarray, kinds: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    """Lines with the average or Paeth filter: a pixel needs those left and above, so diagonals go at once."""
    height, row = lines.shape
    width = -(-row // step)
    given = np.zeros((height, width * step), np.int16)
    given[:, :row] = lines
    done = np.zeros((height + 1, width + 1, step), np.int16)
    done[0, 1:].reshape(-1)[:row] = above
    now, out = given.reshape(-1, step), done.reshape(-1, step)  # a diagonal is every width-th pixel of these
    average = (kinds == 3)[:, None]
    for d in range(width + height - 1):
        first, last = max(0, d - width + 1), min(height - 1, d)
        at, n = first * width + d, last - first + 1
        places = lambda start, n=n: slice(start, start + (n - 1) * width + 1, width)
        if width > 1:
            values = now[slice(first * width + d - first, first * width + d - first + (n - 1) * (width - 1) + 1, width - 1)]
        else:
            values = now[first : first + 1]
        left, up, corner = out[places(at + width + 1)], out[places(at + 1)], out[places(at)]
        p, q = up - corner, left - corner
        far_left, far_up, far_corner = np.abs(p), np.abs(q), np.abs(p + q)
        guess = np.where((far_left <= far_up) & (far_left <= far_corner), left, np.where(far_up <= far_corner, up, corner))
        guess = np.where(average[first : last + 1], (left + up) >> 1, guess)
        out[places(at + width + 2)] = (values + guess) & 255
    return done[1:, 1:].reshape(height, -1)[:, :row]


def _unfiltered(raw: np.ndarray, height: int, row: int, step: int) -> np.ndarray:
    lines = raw.reshape(height, row + 1)
    kinds, lines = lines[:, 0], lines[:, 1:]
    if kinds.max(initial=0) > 4:
        raise ValueError("unknown filter")
    out, y = np.zeros((height + 1, row), np.uint8), 0
    while y < height:
        now = out[y + 1]
        if kinds[y] >= 3:
            others = np.flatnonzero(kinds[y:] < 3)
            end = y + int(others[0]) if len(others) else height
            out[y + 1 : end + 1] = _diagonals(lines[y:end], kinds[y:end], out[y], step)
            y = end
            continue
        if kinds[y] == 1:
            for c in range(step):
                now[c::step] = np.cumsum(lines[y, c::step], dtype=np.uint64).astype(np.uint8)
        else:
            now[:] = lines[y] + out[y] if kinds[y] == 2 else lines[y]
        y += 1
    return out[1:]


def decode_gray(data: bytes, max_pixels: int = MAX_PIXELS) -> tuple[int, int, np.ndarray]:
    """Width, height and luma over white; raises ValueError with the reason if it can't be read."""
    if not data.startswith(SIGNATURE):
        raise ValueError("not a PNG")
    header = palette = alpha = None
    body = bytearray()
    for kind, part in _chunks(data):
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", part)
        elif kind == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            alpha = np.frombuffer(part, np.uint8)
        elif kind == b"IDAT":
            body += part
        elif kind == b"IEND":
            break
    if header is None:
        raise ValueError("no header")
    width, height, depth, colour, _, _, interlace = header
    if depth not in DEPTHS.get(colour, ()) or interlace or not width or not height:
        raise ValueError("unsupported")
    if width * height > max_pixels:
        raise ValueError("too many pixels")
    channels = CHANNELS[colour]
    row, step = (width * channels * depth + 7) // 8, max(1, channels * depth // 8)
    want = height * (row + 1)
    raw = zlib.decompressobj().decompress(bytes(body), want)
    if len(raw) < want:
        raise ValueError("image data ends early")
    flat = _unfiltered(np.frombuffer(raw, np.uint8), height, row, step)
    if depth == 16:
        values = flat.reshape(height, width, channels, 2)[..., 0].astype(np.int64)
    elif depth == 8:
        values = flat.reshape(height, width, channels).astype(np.int64)
    else:
        bits = np.unpackbits(flat, axis=1).reshape(height, -1, depth)[:, : width * channels]
        values = (bits @ (1 << np.arange(depth)[::-1])).reshape(height, width, channels)
        if colour == 0:
            values = values * 255 // ((1 << depth) - 1)
    opacity = np.full((height, width), 255)
    if colour == 3:
        if palette is None or values.max(initial=0) >= len(palette):
            raise ValueError("bad palette")
        index = values[..., 0]
        if alpha is not None:
            table = np.full(max(256, len(alpha)), 255)
            table[: len(alpha)] = alpha
            opacity = table[index]
        rgb = palette[index].astype(np.int64)
    elif channels in (2, 4):
        opacity, rgb = values[..., -1], values[..., :-1]
    else:
        rgb = values
        if alpha is not None and len(alpha) >= 2 * channels and depth >= 8:
            key = np.frombuffer(alpha[: 2 * channels].tobytes(), ">u2") >> (8 if depth == 16 else 0)
            opacity = np.where((values == key).all(axis=2), 0, 255)
    rgb = np.repeat(rgb, 3, axis=2) if rgb.shape[2] == 1 else rgb
    over = (rgb * opacity[..., None] + 255 * (255 - opacity[..., None]) + 127) // 255
    luma = (over @ np.array([299, 587, 114]) + 500) // 1000
    return width, height, luma.astype(np.uint8)


def encode_gray(width: int, height: int, gray: bytes) -> bytes:
    """A gray PNG with unfiltered lines."""
    lines = np.zeros((height, width + 1), np.uint8)
    lines[:, 1:] = np.frombuffer(gray, np.uint8).reshape(height, width)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 9)) + chunk(b"IEND", b"")


def resize(gray: np.ndarray, width: int, height: int) -> np.ndarray:
    """Exact area averages, halves up: every cell weighs the parts of pixels it covers, in integers."""

    def weights(n: int, m: int) -> np.ndarray:
        edge = np.arange(m + 1, dtype=np.int64) * n
        at = np.arange(n, dtype=np.int64) * m
        return np.clip(np.minimum(edge[1:, None], at + m) - np.maximum(edge[:-1, None], at), 0, None)

    h, w = gray.shape
    total = weights(h, height) @ gray.astype(np.int64) @ weights(w, width).T
    area = h * w
    return ((2 * total + area) // (2 * area)).astype(np.uint8)


def dhash(gray: np.ndarray) -> int:
    """64 bits of a 9 by 8 thumbnail, row by row: 1 where a cell is darker than the next."""
    small = resize(gray, 9, 8).astype(np.int16)
    return int.from_bytes(np.packbits(small[:, :-1] < small[:, 1:]).tobytes(), "big", signed=True)


@F.pandas_udf(GRAY)
def gray_of(content: pd.Series) -> pd.DataFrame:
    """struct(width, height, gray, reason) of PNG bytes; a file that can't be read has a reason."""
    rows = []
    for data in content:
        try:
            w, h, gray = decode_gray(bytes(data or b""))
            rows.append((w, h, gray.tobytes(), None))
        except (ValueError, zlib.error, struct.error) as why:
            rows.append((None, None, None, str(why)))
    out = pd.DataFrame(rows, columns=["width", "height", "gray", "reason"])
    return out.astype({"width": "Int32", "height": "Int32"})


@F.pandas_udf(LongType())
def dhash_of(width: pd.Series, height: pd.Series, gray: pd.Series) -> pd.Series:
    """The signed 64-bit difference hash of gray images."""
    return pd.Series([None if g is None or g != g else dhash(np.frombuffer(g, np.uint8).reshape(int(h), int(w))) for w, h, g in zip(width, height, gray, strict=True)], dtype="Int64")


@F.pandas_udf(BinaryType())
def png_of(width: pd.Series, height: pd.Series, gray: pd.Series) -> pd.Series:
    return pd.Series([None if g is None or g != g else encode_gray(int(w), int(h), bytes(g)) for w, h, g in zip(width, height, gray, strict=True)], dtype=object)
