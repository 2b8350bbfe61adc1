"""Pixel kernels in numpy: pure functions, called from Arrow batches inside tasks."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from .. import constants as K

BITS = 22  # fixed-point precision of the resampling coefficients


def gray_pillow(rgb: np.ndarray) -> np.ndarray:
    """8-bit luma of an (h, w, 3) image."""
    c = rgb.astype(np.int32)
    return ((c[..., 0] * 19595 + c[..., 1] * 38470 + c[..., 2] * 7471 + 0x8000) >> 16).astype(np.uint8)


def gray_cv(rgb: np.ndarray) -> np.ndarray:
    c = rgb.astype(np.int32)
    return ((c[..., 0] * 4899 + c[..., 1] * 9617 + c[..., 2] * 1868 + 8192) >> 14).astype(np.uint8)


def rows_of(height: int, part: tuple[float, float]) -> slice:
    return slice(int(height * part[0]), int(height * part[1]))


def metrics(rgb: np.ndarray) -> tuple[float, float, float]:
    """(bm, dk, hd) of an image; only the bands that they need are read."""
    h, w = rgb.shape[:2]
    share = lambda mask: float(mask.mean()) if mask.size else 0.0
    bm = share(gray_pillow(rgb[rows_of(h, K.BODY_Y)]) < K.NON_WHITE_PX)
    dark = [gray_pillow(rgb[rows_of(h, part)]) < K.DARK_PX for part in (K.DARK_TOP_Y, K.DARK_BOTTOM_Y)]
    dk = share(np.concatenate([d.ravel() for d in dark]))
    box = rgb[rows_of(h, K.AVATAR_Y), rows_of(w, K.AVATAR_X)].astype(np.int32)
    high, low = box.max(axis=-1, initial=0), box.min(axis=-1, initial=255)
    return bm, dk, share((high - low) * K.SATURATION_SCALE > high)


def _bicubic(x: np.ndarray) -> np.ndarray:
    a, x = -0.5, np.abs(x)
    near = ((a + 2) * x - (a + 3)) * x * x + 1
    far = (((x - 5) * x + 8) * x - 4) * a
    return np.where(x < 1, near, np.where(x < 2, far, 0.0))


def _lanczos(x: np.ndarray) -> np.ndarray:
    return np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0)


_FILTERS = {"bicubic": (_bicubic, 2.0), "lanczos": (_lanczos, 3.0)}


@lru_cache(maxsize=64)
def coefficients(n: int, m: int, name: str) -> np.ndarray:
    """(m, n) fixed-point weights that resample n samples to m, as the public imaging library rounds them."""
    f, support = _FILTERS[name]
    scale = n / m
    wide = max(scale, 1.0)
    out = np.zeros((m, n), np.int64)
    for k in range(m):
        center = (k + 0.5) * scale
        lo, hi = max(0, int(center - support * wide + 0.5)), min(n, int(center + support * wide + 0.5))
        w = f((np.arange(lo, hi) - center + 0.5) / wide)
        total = 0.0
        for v in w.tolist():  # summed in order, so that rounding agrees
            total += v
        w = w / total if total else w
        out[k, lo:hi] = np.trunc(w * (1 << BITS) + np.where(w < 0, -0.5, 0.5)).astype(np.int64)
    return out


def _pass(k: np.ndarray, img: np.ndarray) -> np.ndarray:
    # products in double are exact here: sums stay far below 2**53
    total = (k.astype(np.float64) @ img.astype(np.float64)).astype(np.int64)
    return np.clip((total + (1 << (BITS - 1))) >> BITS, 0, 255)


def resize(gray: np.ndarray, width: int, height: int, name: str) -> np.ndarray:
    """8-bit resampling, first along rows, then along columns; an image of the right size is copied."""
    h, w = gray.shape
    out = gray
    if w != width:
        out = _pass(coefficients(w, width, name), out.T).T
    if h != height:
        out = _pass(coefficients(h, height, name), out)
    return out.astype(np.uint8)


@lru_cache(maxsize=8)
def _cosines(n: int) -> np.ndarray:
    return 2 * np.cos(np.pi * np.outer(np.arange(n), 2 * np.arange(n) + 1) / (2 * n))


def dct2(x: np.ndarray) -> np.ndarray:
    """Unnormalised type-II transform along both axes."""
    c = _cosines(len(x))
    return c @ x.astype(np.float64) @ c.T


def phash_32(small: np.ndarray) -> int:
    """64-bit hash of a 32 x 32 image: low frequencies above their median, first bit highest."""
    low = dct2(small)[:8, :8].ravel()
    h = 0
    for bit in low > np.median(low):
        h = h << 1 | int(bit)
    return h - (1 << 64) if h >> 63 else h


def phash(gray: np.ndarray) -> int:
    """Perceptual hash of a gray image, as a signed 64-bit number."""
    return phash_32(resize(resize(gray, 256, 256, "bicubic"), 32, 32, "lanczos"))


def crop_upscaled(rgb: np.ndarray, region: tuple[float, float, float, float], scale: int = K.OCR_UPSCALE) -> np.ndarray:
    """Gray crop of a relative region (x0, x1, y0, y1), each pixel repeated."""
    h, w = rgb.shape[:2]
    g = gray_pillow(rgb[rows_of(h, region[2:]), rows_of(w, region[:2])])
    return np.repeat(np.repeat(g, scale, axis=0), scale, axis=1)


def box_mean(gray: np.ndarray, scale: int) -> np.ndarray:
    """Means of scale x scale boxes, rounded half up; odd edges are cut off."""
    h, w = gray.shape[0] // scale, gray.shape[1] // scale
    s = gray[: h * scale, : w * scale].astype(np.int64).reshape(h, scale, w, scale).sum(axis=(1, 3))
    area = scale * scale
    return ((s + area // 2) // area).astype(np.uint8)


def fixed_rows(a: np.ndarray, b: np.ndarray) -> int:
    """Leading rows that stay as they are between two frames, at most a quarter of the height."""
    cap = int(len(a) * K.FIXED_ROW_MAX)
    diff = np.abs(a[:cap].astype(np.int32) - b[:cap]).mean(axis=1)
    moved = np.flatnonzero(diff >= K.FIXED_ROW_DIFF)
    return int(moved[0]) if len(moved) else cap
