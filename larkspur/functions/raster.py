"""Raster kernels on numpy arrays (height x width x channels, 8 bit), and vectorised UDFs over raster structs."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

# Fixed values of the kernels.
NEAR_WHITE, CLEAR_ALPHA, OPAQUE_ALPHA = 240, 8, 250
ASPECT_TOLERANCE, MIN_TRANSPARENT = 0.05, 0.02
DARK_ROW, LIGHT_ROW, BORDER_COLUMNS, MIN_HALF = 90, 166, 30, 32
COARSE, COARSE_DY, COARSE_DX, REFINE = 4, 16, 4, 3
MIN_CORRELATION, MIN_OVERLAP, ALPHA_SNAP, MIN_SEPARATION, MIN_SAMPLES, MIN_OUTPUT = 0.15, 256, 0.02, 64, 64, 8


class Box(NamedTuple):
    x: int
    y: int
    width: int
    height: int


def as_array(data: bytes, width: int, height: int, channels: int) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(height, width, channels)


def _bounds(mask: np.ndarray) -> Box | None:
    rows, cols = np.flatnonzero(mask.any(1)), np.flatnonzero(mask.any(0))
    if not len(rows):
        return None
    return Box(int(cols[0]), int(rows[0]), int(cols[-1] - cols[0] + 1), int(rows[-1] - rows[0] + 1))


def content_box(r: np.ndarray, threshold: int = NEAR_WHITE) -> Box:
    """Bounds of pixels that are neither near white nor clear; the whole raster if there are none."""
    background = (r[:, :, :3] >= threshold).all(2)
    if r.shape[2] >= 4:
        background |= r[:, :, 3] <= CLEAR_ALPHA
    return _bounds(~background) or Box(0, 0, r.shape[1], r.shape[0])


def alpha_box(r: np.ndarray, clear: np.ndarray | None = None) -> Box | None:
    """Bounds of visible pixels; null without alpha or anything visible.  clear: alpha of each palette entry of an indexed raster."""
    if clear is not None:
        table = np.full(256, 255, np.uint8)
        table[: len(clear)] = clear
        alpha = table[r[:, :, 0]]
    elif r.shape[2] in (2, 4):
        alpha = r[:, :, -1]
    else:
        return None
    return _bounds(alpha > CLEAR_ALPHA)


def fit_aspect(box: Box, aspect: float, tolerance: float = ASPECT_TOLERANCE) -> Box:
    """The centred part of a box with an aspect; a box within the tolerance stays."""
    now = box.width / box.height
    if abs(now - aspect) <= aspect * tolerance:
        return box
    width = max(1, int(box.height * aspect + 0.5)) if now > aspect else box.width
    height = max(1, int(box.width / aspect + 0.5)) if now < aspect else box.height
    return Box(box.x + (box.width - width) // 2, box.y + (box.height - height) // 2, width, height)


def crop(r: np.ndarray, box: Box) -> np.ndarray:
    return r[box.y : box.y + box.height, box.x : box.x + box.width]


def restore_margins(r: np.ndarray, canvas: tuple[int, int], content: Box) -> np.ndarray:
    """The raster with the original's clear margins, scaled on each axis; four channels."""
    sx, sy = r.shape[1] / content.width, r.shape[0] / content.height
    near = lambda v: int(np.floor(v + 0.5))
    left, top = near(content.x * sx), near(content.y * sy)
    right, bottom = near((canvas[0] - content.x - content.width) * sx), near((canvas[1] - content.y - content.height) * sy)
    colour = np.repeat(r[:, :, :1], 3, 2) if r.shape[2] <= 2 else r[:, :, :3]
    alpha = r[:, :, -1:] if r.shape[2] in (2, 4) else np.full((*r.shape[:2], 1), 255, np.uint8)
    return np.pad(np.concatenate([colour, alpha], 2), ((top, bottom), (left, right), (0, 0)))


def trim_to_aspect(r: np.ndarray, original: tuple[int, int], content: Box | None) -> np.ndarray:
    """Crops to content and the original's aspect, and gives back the original's margins."""
    target = (content.width, content.height) if content else original
    box = fit_aspect(content_box(r), target[0] / target[1])
    out = crop(r, box)
    return restore_margins(out, original, content) if content else out


def transparent_share(r: np.ndarray) -> float:
    return float((r[:, :, 3] < OPAQUE_ALPHA).mean()) if r.shape[2] >= 4 else 0.0


def meaningfully_transparent(r: np.ndarray) -> bool:
    return transparent_share(r) >= MIN_TRANSPARENT


def upper_median(values: np.ndarray) -> float:
    return float(np.sort(values)[len(values) // 2])


def _border(r: np.ndarray) -> np.ndarray:
    n = min(BORDER_COLUMNS, max(1, r.shape[1] // 8))
    return np.concatenate([r[:, :n, :3], r[:, -n:, :3]], 1).astype(float)


def classify_rows(r: np.ndarray) -> np.ndarray:
    """1 for rows with a dark border, -1 for light ones, else 0, by the upper median of border pixels."""
    samples = np.sort(_border(r).mean(2), 1)
    level = samples[:, samples.shape[1] // 2]
    return np.where(level < DARK_ROW, 1, np.where(level > LIGHT_ROW, -1, 0))


def split_row(r: np.ndarray) -> int | None:
    """The first row at which dark rows above and light rows below are most; null unless both halves look it."""
    rows = classify_rows(r)
    h = len(rows)
    dark = np.r_[0, np.cumsum(rows == 1)]
    light = np.r_[0, np.cumsum(rows == -1)]
    score = dark + light[-1] - light
    allowed = np.arange(MIN_HALF, h - MIN_HALF + 1)
    if not len(allowed):
        return None
    best = int(allowed[np.argmax(score[allowed])])
    if dark[best] < best * 0.5 or light[-1] - light[best] < (h - best) * 0.5:
        return None
    return best


def luma(r: np.ndarray) -> np.ndarray:
    return (r[:, :, 0].astype(np.float32) + 2 * r[:, :, 1].astype(np.float32) + r[:, :, 2]) / 4


def gradient(lum: np.ndarray) -> np.ndarray:
    """Sum of absolute central differences; zero on the border."""
    out = np.zeros_like(lum)
    out[1:-1, 1:-1] = (np.abs(lum[1:-1, 2:] - lum[1:-1, :-2]) + np.abs(lum[2:, 1:-1] - lum[:-2, 1:-1])) / 2
    return out


def downsampled(field: np.ndarray, factor: int) -> np.ndarray:
    """Means of whole blocks; what is left over is cut off."""
    h, w = field.shape[0] // factor, field.shape[1] // factor
    return field[: h * factor, : w * factor].reshape(h, factor, w, factor).mean((1, 3))


def correlation(a: np.ndarray, b: np.ndarray, dy: int, dx: int) -> float:
    """Correlation of a with b moved by (dy, dx) where they overlap; 0 for small or flat overlaps."""
    h, w = a.shape
    x = a[max(0, dy) : h + min(0, dy), max(0, dx) : w + min(0, dx)].astype(float)
    y = b[max(0, -dy) : h + min(0, -dy), max(0, -dx) : w + min(0, -dx)].astype(float)
    if x.size < MIN_OVERLAP:
        return 0.0
    x, y = x - x.mean(), y - y.mean()
    square = (x * x).sum() * (y * y).sum()
    return float((x * y).sum() / np.sqrt(square)) if square > 0 else 0.0


def subpixel(before: float, at: float, after: float) -> float:
    """Vertex of the parabola through three values, within one step of the middle; else 0."""
    bend = before - 2 * at + after
    if abs(bend) < 1e-9:
        return 0.0
    off = 0.5 * (before - after) / bend
    return off if abs(off) <= 1 else 0.0


def estimated_shift(top: np.ndarray, bottom: np.ndarray) -> tuple[float, float, float] | None:
    """(dy, dx, correlation) that aligns two rasters: coarse grid, then fine, then by parabola; null below the least correlation."""
    a, b = gradient(luma(top)), gradient(luma(bottom))
    small = downsampled(a, COARSE), downsampled(b, COARSE)
    grid = [(correlation(*small, dy, dx), dy, dx) for dy in range(-COARSE_DY, COARSE_DY + 1) for dx in range(-COARSE_DX, COARSE_DX + 1)]
    _, cy, cx = max(grid, key=lambda g: g[0])
    fine = [(correlation(a, b, dy, dx), dy, dx) for dy in range(cy * COARSE - REFINE, cy * COARSE + REFINE + 1) for dx in range(cx * COARSE - REFINE, cx * COARSE + REFINE + 1)]
    best, dy, dx = max(fine, key=lambda g: g[0])
    if best < MIN_CORRELATION:
        return None
    along = lambda sy, sx: subpixel(correlation(a, b, dy - sy, dx - sx), best, correlation(a, b, dy + sy, dx + sx))
    return dy + along(1, 0), dx + along(0, 1), best


def background(r: np.ndarray, row_class: int, fallback: int, most: int = 6000) -> np.ndarray:
    """Upper medians of the border colours of rows of a class; the fallback with few samples."""
    own = _border(r)[classify_rows(r) == row_class]
    per_row = own.shape[1] if own.ndim == 3 else 1
    samples = own[: most // max(per_row, 1) + 1].reshape(-1, 3)
    if len(samples) < MIN_SAMPLES:
        return np.full(3, float(fallback))
    return np.sort(samples, 0)[len(samples) // 2]


def recovered_alpha(r: np.ndarray) -> np.ndarray | None:
    """Colour and alpha of a picture shown on dark above and on light below; null where that fails."""
    if r.shape[2] < 3:
        return None
    split = split_row(r)
    if split is None:
        return None
    h = min(split, r.shape[0] - split)
    top, bottom = r[split - h : split], r[split : split + h]
    shift = estimated_shift(top, bottom)
    if shift is None:
        return None
    dy, dx, _ = shift
    dark, light = background(top, 1, 0), background(bottom, -1, 255)
    gap = light - dark
    if gap.min() < MIN_SEPARATION:
        return None
    edge = lambda v: int(np.ceil(max(v, 0))) + 2
    y = np.arange(edge(dy), h - edge(-dy))
    x = np.arange(edge(dx), top.shape[1] - edge(-dx))
    if len(y) < MIN_OUTPUT or len(x) < MIN_OUTPUT:
        return None
    y0, x0 = np.floor(y - dy).astype(int), np.floor(x - dx).astype(int)
    fy, fx = (y - dy - y0)[:, None, None], (x - dx - x0)[None, :, None]
    b = bottom[:, :, :3].astype(float)
    at = lambda p, q: b[np.ix_(y0 + p, x0 + q)]
    white = (at(0, 0) * (1 - fx) + at(0, 1) * fx) * (1 - fy) + (at(1, 0) * (1 - fx) + at(1, 1) * fx) * fy
    black = top[np.ix_(y, x)][:, :, :3].astype(float)
    alpha = np.clip((1 - (white - black) / gap).mean(2), 0, 1)
    alpha = np.where(alpha < ALPHA_SNAP, 0.0, np.where(alpha > 1 - ALPHA_SNAP, 1.0, alpha))
    safe = np.where(alpha > 0, alpha, 1.0)[:, :, None]
    colour = np.clip(np.floor((black - (1 - safe) * dark) / safe + 0.5), 0, 255) * (alpha > 0)[:, :, None]
    return np.concatenate([colour, np.floor(alpha * 255 + 0.5)[:, :, None]], 2).astype(np.uint8)


def dimensions(data: bytes) -> tuple[int, int] | None:
    """(width, height) from a PNG, GIF or JPEG header."""
    if data[:4] == b"\x89PNG" and len(data) >= 24:
        return int.from_bytes(data[16:20], "big"), int.from_bytes(data[20:24], "big")
    if data[:3] == b"GIF" and len(data) >= 10:
        return int.from_bytes(data[6:8], "little"), int.from_bytes(data[8:10], "little")
    at = 2
    while data[:2] == b"\xff\xd8" and at + 9 <= len(data) and data[at] == 0xFF:
        kind = data[at + 1]
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            return int.from_bytes(data[at + 7 : at + 9], "big"), int.from_bytes(data[at + 5 : at + 7], "big")
        at += 2 + int.from_bytes(data[at + 2 : at + 4], "big")
    return None


_BOX = StructType([StructField(n, IntegerType()) for n in Box._fields])
_SIZE = StructType([StructField("width", IntegerType()), StructField("height", IntegerType())])


@F.pandas_udf(_BOX)
def content_box_of(r: pd.DataFrame) -> pd.DataFrame:
    """Content box of raster structs (data, width, height, channels)."""
    return pd.DataFrame([content_box(as_array(*row)) for row in r[["data", "width", "height", "channels"]].itertuples(index=False)], columns=Box._fields)


@F.pandas_udf(DoubleType())
def transparent_share_of(r: pd.DataFrame) -> pd.Series:
    return pd.Series([transparent_share(as_array(*row)) for row in r[["data", "width", "height", "channels"]].itertuples(index=False)])


@F.pandas_udf(_SIZE)
def dimensions_of(data: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([dimensions(bytes(d)) or (None, None) if d is not None else (None, None) for d in data], columns=["width", "height"])
