"""Images in numpy: decoding of PNG, BMP and PNM bytes, encoding of PNG, resized sides, and the way to patches."""

from __future__ import annotations

import math
import struct
import zlib

import numpy as np

from loomline.functions import tensor

#: Channels by PNG colour type.
PNG_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def decode(content: bytes) -> np.ndarray:
    """Pixels (rows, columns, channels) of 8 bits; ValueError for other formats.

    PNG without interlacing, uncompressed BMP of 24 and 32 bits, binary PGM and PPM. JPEG files are read by Spark's image source (``decode_files``).
    """
    if content[:8] == b"\x89PNG\r\n\x1a\n":
        return _png(content)
    if content[:2] == b"BM":
        return _bmp(content)
    if content[:2] in (b"P5", b"P6"):
        return _pnm(content)
    raise ValueError("unsupported image format")


def _chunks(content: bytes):
    at = 8
    while at + 8 <= len(content):
        n, kind = struct.unpack(">I4s", content[at : at + 8])
        yield kind, content[at + 8 : at + 8 + n]
        at += 12 + n


def _png(content: bytes) -> np.ndarray:
    parts = list(_chunks(content))
    width, height, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", parts[0][1])
    if depth != 8 or interlaced or colour not in PNG_CHANNELS:
        raise ValueError("unsupported PNG")
    n = PNG_CHANNELS[colour]
    raw = np.frombuffer(zlib.decompress(b"".join(d for k, d in parts if k == b"IDAT")), dtype=np.uint8).reshape(height, 1 + width * n)
    out = np.zeros((height + 1, (width + 1) * n), dtype=np.uint8)  # a row above and a pixel to the left, both zero
    for y in range(height):
        line, above, kind = raw[y, 1:], out[y], raw[y, 0]
        if kind == 0:
            out[y + 1, n:] = line
        elif kind == 2:
            out[y + 1, n:] = line + above[n:]
        elif kind == 1:
            for c in range(n):
                out[y + 1, n + c :: n] = np.cumsum(line[c::n], dtype=np.uint8)
        elif kind in (3, 4):
            row = out[y + 1].tolist()
            up = above.tolist()
            for i, v in enumerate(line.tolist()):
                left, top, corner = row[i], up[i + n], up[i]
                guess = (left + top) // 2 if kind == 3 else min((left, top, corner), key=lambda x, p=left + top - corner: abs(p - x))
                row[i + n] = (v + guess) & 255
            out[y + 1] = row
        else:
            raise ValueError("unknown PNG filter")
    pixels = out[1:, n:].reshape(height, width, n)
    if colour == 3:
        return np.frombuffer(next(d for k, d in parts if k == b"PLTE"), dtype=np.uint8).reshape(-1, 3)[pixels[:, :, 0]]
    return pixels


def _bmp(content: bytes) -> np.ndarray:
    start, _, width, height, _, bits, packed = struct.unpack("<IIiiHHI", content[10:34])
    if bits not in (24, 32) or packed:
        raise ValueError("unsupported BMP")
    n, stride = bits // 8, -(-width * bits // 32) * 4
    rows = np.frombuffer(content, dtype=np.uint8, count=stride * abs(height), offset=start).reshape(abs(height), stride)
    pixels = rows[:, : width * n].reshape(abs(height), width, n)[:, :, 2::-1]
    return pixels[::-1] if height > 0 else pixels


def _pnm(content: bytes) -> np.ndarray:
    fields, at = [], 2
    while len(fields) < 3:
        while content[at : at + 1].isspace():
            at += 1
        if content[at : at + 1] == b"#":
            at = content.index(b"\n", at)
            continue
        stop = at
        while content[stop : stop + 1].isdigit():
            stop += 1
        fields.append(int(content[at:stop]))
        at = stop
    width, height, most = fields
    if most != 255:
        raise ValueError("unsupported PNM")
    n = 3 if content[:2] == b"P6" else 1
    return np.frombuffer(content, dtype=np.uint8, count=width * height * n, offset=at + 1).reshape(height, width, n)


def encode_png(pixels: np.ndarray) -> bytes:
    """A PNG of (rows, columns, 1 or 3 channels) bytes."""
    height, width, n = pixels.shape
    raw = np.concatenate([np.zeros((height, 1), dtype=np.uint8), pixels.reshape(height, width * n)], axis=1).tobytes()
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", width, height, 8, 2 if n == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw, 1)) + chunk(b"IEND", b"")


def to_rgb(pixels: np.ndarray) -> np.ndarray:
    """Three channels: grey is repeated, alpha dropped."""
    n = pixels.shape[2]
    return np.repeat(pixels[:, :, :1], 3, axis=2) if n < 3 else pixels[:, :, :3]


def sides(h: int, w: int, factor: int, low: int, high: int) -> tuple[int, int]:
    """Resized sides as ``geometry.resized`` has them in variant A; ValueError for too long an image."""
    if min(h, w) < 1 or max(h, w) / min(h, w) > 200:
        raise ValueError("aspect ratio above 200")
    a, b = round(h / factor) * factor, round(w / factor) * factor
    if a * b > high:
        by = math.sqrt(h * w / high)
        a, b = (max(factor, math.floor(x / by / factor) * factor) for x in (h, w))
    elif a * b < low:
        by = math.sqrt(low / (h * w))
        a, b = (math.ceil(x * by / factor) * factor for x in (h, w))
    return a, b


class Processor:
    """The way of one image to its patch matrix under a configuration."""

    def __init__(self, patch: int = 14, merge: int = 2, temporal: int = 2, min_pixels: int = 3136, max_pixels: int = 1_003_520, do_resize: bool = True, do_convert_rgb: bool = True, do_rescale: bool = True, rescale: float = 1 / 255, do_normalize: bool = True, mean: tuple[float, ...] = (0.5, 0.5, 0.5), std: tuple[float, ...] = (0.5, 0.5, 0.5)) -> None:
        self.patch, self.merge, self.temporal, self.low, self.high, self.do_resize, self.do_convert_rgb = patch, merge, temporal, min_pixels, max_pixels, do_resize, do_convert_rgb
        self.rescale = np.float32(rescale) if do_rescale else None
        self.mean, self.std = (np.array(x, dtype=np.float32) for x in (mean, std)) if do_normalize else (None, None)

    def __call__(self, pixels: np.ndarray) -> tuple[np.ndarray, tuple[int, int, int], int]:
        """Patches, grid and placeholder tokens; ValueError for what can't be cut into patches."""
        image = to_rgb(pixels) if self.do_convert_rgb else pixels
        h, w = image.shape[:2]
        block = self.patch * self.merge
        if self.do_resize:
            h, w = sides(h, w, block, self.low, self.high)
            image = tensor.resize(image, h, w)
        if h % block or w % block:
            raise ValueError("sides are no multiples of patch times merge")
        values = image.astype(np.float32)
        if self.rescale is not None:
            values = values * self.rescale
        if self.mean is not None:
            values = (values - self.mean[: values.shape[2]]) / self.std[: values.shape[2]]
        frames = tensor.with_frames(values.transpose(2, 0, 1), self.temporal)
        grid = (max(1, 1 // self.temporal), h // self.patch, w // self.patch)
        return tensor.patches(frames, self.patch, self.merge), grid, max(1, math.prod(grid) // self.merge**2)
