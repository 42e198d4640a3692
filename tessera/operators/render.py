"""Review pictures: masks and boxes over an image, and their captions."""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import raster as R

# Colours of accepted and reviewed objects.
GREEN, AMBER = (46, 204, 113), (243, 156, 18)


def two_decimals(x: Column) -> Column:
    h = F.floor(x * 100 + 0.5).cast("int")
    return F.concat(F.floor(h / 100).cast("string"), F.lit("."), F.lpad((h % 100).cast("string"), 2, "0"))


def caption() -> Column:
    """Name, quality and fidelity, and the number of parts above one."""
    base = F.concat(F.col("name"), F.lit("  Q"), two_decimals(F.col("quality")), F.lit("  F"), two_decimals(F.col("fidelity")))
    return F.when(F.col("parts") > 1, F.concat(base, F.lit("  x"), F.col("parts").cast("string"))).otherwise(base)


def overlay(image: np.ndarray, boxes, results, scale: float = 1.0) -> np.ndarray:
    """Masks first (rings, state), then boxes on top, on a copy of an RGB array; coordinates are multiplied by scale."""
    out = image.copy()
    h, w = out.shape[:2]
    for rings, state in results:
        for ring in rings:
            m = R.filled(np.round(np.asarray(ring, float) * scale), w, h)
            out[m] = (0.6 * out[m] + 0.4 * np.array(GREEN if state == "accepted" else AMBER)).astype(np.uint8)
    for x0, y0, x1, y1 in boxes:
        frame = np.zeros((h, w), bool)
        R.outline(frame, np.round(np.array([(x0, y0), (x1, y0), (x1, y1), (x0, y1)]) * scale).astype(np.int64))
        out[frame] = (52, 152, 219)
    return out


def comparison(left: np.ndarray, right: np.ndarray, most: int = 2600, gap: int = 12) -> np.ndarray:
    """Two pictures beside each other, scaled down once to fit."""
    panel = (most - gap) // 2
    k = max(1, -(-max(left.shape[1], right.shape[1]) // panel))
    a, b = left[::k, ::k], right[::k, ::k]
    out = np.full((max(a.shape[0], b.shape[0]), a.shape[1] + gap + b.shape[1], 3), 255, np.uint8)
    out[: a.shape[0], : a.shape[1]] = a
    out[: b.shape[0], a.shape[1] + gap :] = b
    return out


def png(pixels: np.ndarray) -> bytes:
    """A PNG file of a grey or RGB array."""
    h, w = pixels.shape[:2]
    raw = np.zeros((h, 1 + w * (1 if pixels.ndim == 2 else 3)), np.uint8)
    raw[:, 1:] = np.ascontiguousarray(pixels, np.uint8).reshape(h, -1)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(
        b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0 if pixels.ndim == 2 else 2, 0, 0, 0),
    ) + chunk(b"IDAT", zlib.compress(raw.tobytes(), 6)) + chunk(b"IEND", b"")
