"""Pixels of PNG and BMP files in numpy; other formats need an optional decoder that may be installed."""

from __future__ import annotations

import io
import struct
import zlib

import numpy as np


def png(data: bytes) -> np.ndarray:
    """8-bit grey, RGB, palette or alpha PNG without interlacing, as an RGB array."""
    at, idat, palette, head = 8, [], None, None
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            idat.append(body)
        at += 12 + size
    w, h, depth, colour, _, _, interlaced = head
    if depth != 8 or interlaced:
        raise ValueError("only 8-bit PNG files without interlacing")
    n = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    raw = np.frombuffer(zlib.decompress(b"".join(idat)), np.uint8).reshape(h, 1 + w * n)
    out = np.zeros((h, w * n), np.uint8)
    before = np.zeros(w * n, np.int32)
    for y in range(h):
        line, kind = raw[y, 1:].astype(np.int32), raw[y, 0]
        if kind == 1:
            line = np.cumsum(line.reshape(w, n), axis=0).ravel() & 255
        elif kind == 2:
            line = (line + before) & 255
        elif kind in (3, 4):
            for i in range(w * n):
                a, b, c = (line[i - n] if i >= n else 0), before[i], (before[i - n] if i >= n else 0)
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    guess = min((a, b, c), key=lambda v, p=a + b - c: abs(p - v))
                line[i] = (line[i] + guess) & 255
        out[y] = before = line
    px = out.reshape(h, w, n)
    if colour == 3:
        return palette[px[:, :, 0]]
    return np.repeat(px[:, :, :1], 3, axis=2) if n < 3 else px[:, :, :3]


def bmp(data: bytes) -> np.ndarray:
    start, (w, h), bits = struct.unpack("<I", data[10:14])[0], struct.unpack("<ii", data[18:26]), struct.unpack("<H", data[28:30])[0]
    if bits not in (24, 32):
        raise ValueError("only 24 and 32-bit BMP files")
    n, row = bits // 8, (w * bits // 8 + 3) // 4 * 4
    px = np.frombuffer(data, np.uint8, row * abs(h), start).reshape(abs(h), row)[:, : w * n].reshape(abs(h), w, n)[:, :, 2::-1]
    return px[::-1] if h > 0 else px


def pixels(data: bytes) -> np.ndarray:
    """RGB pixels of an image file."""
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return png(data)
    if data[:2] == b"BM":
        return bmp(data)
    try:
        from PIL import Image
    except ImportError as e:
        raise ValueError("this format needs an image library that isn't installed") from e
    return np.asarray(Image.open(io.BytesIO(data)).convert("RGB"))


def grey(rgb: np.ndarray) -> np.ndarray:
    return np.round(rgb @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)
