"""8-bit PNG files with the standard library alone."""

from __future__ import annotations

import struct
import zlib

import numpy as np

SIGNATURE = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(image: np.ndarray) -> bytes:
    """Bytes of a gray (H, W), RGB (H, W, 3) or RGBA (H, W, 4) array of uint8."""
    image = np.ascontiguousarray(image, np.uint8)
    height, width = image.shape[:2]
    channels = 1 if image.ndim == 2 else image.shape[2]
    rows = image.reshape(height, width * channels)
    raw = np.concatenate([np.zeros((height, 1), np.uint8), rows], axis=1).tobytes()
    head = struct.pack(">IIBBBBB", width, height, 8, {1: 0, 3: 2, 4: 6}[channels], 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(raw, 6)) + _chunk(b"IEND", b"")


def decode_png(data: bytes) -> np.ndarray:
    """Array of a non-interlaced 8-bit PNG, palettes resolved; ValueError for anything else."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG file")
    at, body, palette, head = 8, [], None, None
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + size]
        at += 12 + size
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body.append(part)
    if head is None or head[2] != 8 or head[6]:
        raise ValueError("only 8-bit PNG without interlacing is read")
    width, height, _, colour = head[:4]
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    stride = width * channels
    raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, stride + 1)
    out = np.zeros((height, stride), np.uint8)
    above = np.zeros(stride, np.int32)
    for y in range(height):
        line, kind = raw[y, 1:].astype(np.int32), raw[y, 0]
        if kind == 2:
            line = line + above
        elif kind in (1, 3, 4):
            line = _unfilter(line, above, kind, channels)
        above = line & 255
        out[y] = above
    image = out.reshape(height, width, channels)
    if colour == 3:
        return palette[image[..., 0]]
    return image[..., 0] if channels == 1 else image


def _unfilter(line: np.ndarray, above: np.ndarray, kind: int, step: int) -> np.ndarray:
    """Filters that look to the left: sub, average, Paeth."""
    values, up = line.tolist(), above.tolist()
    for i in range(len(values)):
        a, b = (values[i - step] if i >= step else 0), up[i]
        if kind == 1:
            p = a
        elif kind == 3:
            p = (a + b) // 2
        else:
            c = up[i - step] if i >= step else 0
            e = a + b - c
            p = min((abs(e - a), 0, a), (abs(e - b), 1, b), (abs(e - c), 2, c))[2]
        values[i] = (values[i] + p) & 255
    return np.array(values, np.int32)
