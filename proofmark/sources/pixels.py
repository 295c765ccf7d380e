"""Label images as arrays: reading, preparing for recognition, and how much ink a part holds.

Everything is numpy on arrays of bytes (height, width[, channels]). PNG files are read here; other
formats are read where an imaging library is installed, and are told apart by an honest error where none is.
"""

from __future__ import annotations

import io
import struct
import zlib

import numpy as np

# Least width for recognition, contrast, threshold, what counts as ink, size for counting ink.
MIN_WIDTH, CONTRAST, THRESHOLD, DARK, SAMPLE = 1600, 2.0, 175, 225, 120
SHARPEN = np.array([[-2, -2, -2], [-2, 32, -2], [-2, -2, -2]]) / 16
GRAY = np.array([0.299, 0.587, 0.114])
PNG = b"\x89PNG\r\n\x1a\n"


def read_png(data: bytes) -> np.ndarray:
    """Pixels (height, width, 3) of an eight-bit PNG that isn't interlaced; transparency is dropped."""
    at, parts, palette, turn = len(PNG), [], None, 1
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        at += 12 + size
        if kind == b"IHDR":
            width, height, depth, color, _, _, interlaced = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            parts.append(body)
        elif kind == b"eXIf":
            turn = orientation_of(body)
    if depth != 8 or interlaced or color not in (0, 2, 3, 4, 6):
        raise ValueError("only eight-bit PNG files without interlacing are read without an imaging library")
    n = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[color]
    raw = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(height, 1 + width * n)
    rows = np.zeros((height, width * n), np.uint8)
    above = np.zeros(width * n, np.uint8)
    for y in range(height):
        rows[y] = above = _unfiltered(int(raw[y, 0]), raw[y, 1:], above, n)
    pixels = rows.reshape(height, width, n)
    if color == 3:
        return upright(palette[pixels[:, :, 0]], turn)
    return upright(pixels[:, :, :3] if n > 2 else np.repeat(pixels[:, :, :1], 3, axis=2), turn)


def orientation_of(exif: bytes) -> int:
    """The camera's orientation (tag 0x112) in a block of picture data; 1 where it tells none."""
    order = {b"II": "<", b"MM": ">"}.get(exif[:2])
    if order is None or len(exif) < 10:
        return 1
    at = struct.unpack(order + "I", exif[4:8])[0]
    n = struct.unpack(order + "H", exif[at : at + 2])[0] if at + 2 <= len(exif) else 0
    for k in range(at + 2, min(at + 2 + 12 * n, len(exif) - 11), 12):
        if struct.unpack(order + "H", exif[k : k + 2])[0] == 0x112:
            return struct.unpack(order + "H", exif[k + 8 : k + 10])[0]
    return 1


def _unfiltered(kind: int, line: np.ndarray, above: np.ndarray, n: int) -> np.ndarray:
    """A line of a PNG without its filter: none, left, above, mean of both, or the nearest of three."""
    if kind == 0:
        return line.copy()
    if kind == 2:
        return line + above
    if kind == 1:
        return np.add.accumulate(line.reshape(-1, n), axis=0, dtype=np.uint8).reshape(-1)
    out = line.astype(np.int64)
    up = above.astype(np.int64)
    for i in range(len(out)):
        a, b, c = (out[i - n], up[i], up[i - n]) if i >= n else (0, up[i], 0)
        if kind == 3:
            guess = (a + b) // 2
        else:
            near = [(abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c)]
            guess = min(near)[2]
        out[i] = (out[i] + guess) & 255
    return out.astype(np.uint8)


def read_image(data: bytes) -> np.ndarray:
    """Upright pixels (height, width, 3) of an image file."""
    if data.startswith(PNG):
        return read_png(data)
    try:
        from PIL import Image, ImageOps
    except ImportError as e:
        raise ValueError("no imaging library is installed: only PNG files can be read") from e
    return np.asarray(ImageOps.exif_transpose(Image.open(io.BytesIO(data))).convert("RGB"))


def upright(pixels: np.ndarray, orientation: int) -> np.ndarray:
    """Pixels turned and mirrored as the camera's orientation (1 to 8) asks; other values change nothing."""
    if orientation in (5, 6, 7, 8):
        pixels = pixels.swapaxes(0, 1)
    if orientation in (2, 3, 6, 7):
        pixels = pixels[:, ::-1]
    return pixels[::-1] if orientation in (3, 4, 7, 8) else pixels


def _weights(size: int, to: int) -> np.ndarray:
    """Lanczos weights (to, size) of three lobes, widened where the image gets smaller."""
    scale = size / to
    wide = max(scale, 1.0)
    x = (np.arange(size)[None, :] + 0.5 - (np.arange(to)[:, None] + 0.5) * scale) / wide
    w = np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0)
    return w / w.sum(axis=1, keepdims=True)


def resized(pixels: np.ndarray, width: int, height: int) -> np.ndarray:
    down = np.tensordot(_weights(pixels.shape[0], height), pixels.astype(float), axes=(1, 0))
    both = np.moveaxis(np.tensordot(_weights(pixels.shape[1], width), down, axes=(1, 1)), 0, 1)
    return np.clip(np.rint(both), 0, 255).astype(np.uint8)


def upscaled(pixels: np.ndarray, least: int = MIN_WIDTH) -> np.ndarray:
    """At least so wide, in proportion; wider images stay."""
    height, width = pixels.shape[:2]
    return pixels if width >= least else resized(pixels, int(width * (least / width)), int(height * (least / width)))


def gray(pixels: np.ndarray) -> np.ndarray:
    return pixels if pixels.ndim == 2 else np.rint(pixels[:, :, :3] @ GRAY).astype(np.uint8)


def prepared(pixels: np.ndarray, threshold: int | None = None) -> np.ndarray:
    """Gray pixels for recognition: upscaled, stretched to all grays, contrast raised around the mean,
    sharpened (the border stays); black and white where a threshold is given."""
    g = gray(upscaled(pixels)).astype(float)
    low, high = g.min(), g.max()
    if high > low:
        g = np.clip(np.floor((g - low) * (255 / (high - low))), 0, 255)
    mean = float(int(g.mean() + 0.5))
    g = np.clip(np.floor(mean + CONTRAST * (g - mean)), 0, 255)
    if min(g.shape) > 2:
        h, w = g.shape
        middle = sum(SHARPEN[i, j] * g[i : h - 2 + i, j : w - 2 + j] for i in range(3) for j in range(3))
        g[1:-1, 1:-1] = np.clip(np.rint(middle), 0, 255)
    return (np.where(g > threshold, 255, 0) if threshold is not None else g).astype(np.uint8)


def crop(pixels: np.ndarray, box: tuple[float, float, float, float]) -> np.ndarray:
    """A box given in fractions (left, top, right, bottom), within the image, one pixel at least."""
    height, width = pixels.shape[:2]
    x0, y0, x1, y1 = crop_box(box, width, height)
    return pixels[y0:y1, x0:x1]


def crop_box(box: tuple[float, float, float, float], width: int, height: int) -> tuple[int, int, int, int]:
    """Pixels of a box, within the image and at least one pixel wide and high."""
    l, t, r, b = (min(1.0, max(0.0, x)) for x in box)
    x0, y0 = min(int(width * l), width - 1), min(int(height * t), height - 1)
    return x0, y0, max(x0 + 1, int(width * r)), max(y0 + 1, int(height * b))


def dark_share(pixels: np.ndarray) -> float:
    """Share of ink of an image, seen at a small size; 0 for one without pixels."""
    if 0 in pixels.shape[:2]:
        return 0.0
    return float((resized(gray(pixels), SAMPLE, SAMPLE) < DARK).mean())


# The parts of an image that both must hold ink, and how much.
LEFT, RIGHT, INK = (0.03, 0.05, 0.50, 0.92), (0.52, 0.05, 0.98, 0.92), 0.06


def side_by_side(pixels: np.ndarray) -> bool:
    """Two labels next to each other: wide enough, wider than high, ink on both halves."""
    height, width = pixels.shape[:2]
    return height > 0 and width >= 500 and width / height >= 1.05 and min(dark_share(crop(pixels, LEFT)), dark_share(crop(pixels, RIGHT))) >= INK
