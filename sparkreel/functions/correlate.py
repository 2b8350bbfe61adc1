"""Phase correlation of two images (numpy), after the public computer-vision definition."""

from __future__ import annotations

from functools import lru_cache

import numpy as np


@lru_cache(maxsize=256)
def optimal_size(n: int) -> int:
    """Smallest number of the form 2^a 3^b 5^c that is n or more."""
    best, five = 1 << (n - 1).bit_length(), 1
    while five < best:
        three = five
        while three < best:
            two = three
            while two < n:
                two *= 2
            best = min(best, two)
            three *= 3
        five *= 5
    return best


@lru_cache(maxsize=8)
def window(rows: int, cols: int) -> np.ndarray:
    """The square root of the product of two Hann windows."""
    hann = lambda n: 0.5 * (1 - np.cos(2 * np.pi / (n - 1) * np.arange(n)))
    return np.sqrt(np.outer(hann(rows), hann(cols)))


def spectrum(img: np.ndarray, weighted: bool = True) -> np.ndarray:
    """Half spectrum of an image, windowed and padded to an optimal size."""
    rows, cols = img.shape
    x = img * window(rows, cols) if weighted else img.astype(np.float64)
    return np.fft.rfft2(x, (optimal_size(rows), optimal_size(cols)))


def peak(c: np.ndarray) -> tuple[float, float, float]:
    """(x, y, sum) of the weighted centre around the first maximum, 5 x 5, cut at the edges."""
    py, px = np.unravel_index(np.argmax(c), c.shape)
    y0, x0 = max(py - 2, 0), max(px - 2, 0)
    box = c[y0 : py + 3, x0 : px + 3]
    total = box.sum()
    ys, xs = np.arange(y0, y0 + box.shape[0]), np.arange(x0, x0 + box.shape[1])
    whole = total + np.finfo(np.float64).eps
    return float((box.sum(axis=0) * xs).sum() / whole), float((box.sum(axis=1) * ys).sum() / whole), float(total)


def shift(f1: np.ndarray, f2: np.ndarray, rows: int, cols: int) -> tuple[float, float, float]:
    """(dx, dy, response) between two spectra of images of rows x cols."""
    m, n = optimal_size(rows), optimal_size(cols)
    p = f1 * np.conj(f2)
    size = np.abs(p)
    p = np.divide(p, size, out=np.zeros_like(p), where=size > 0)
    c = np.roll(np.fft.irfft2(p, (m, n)), (-(-(-m // 2)), -(-(-n // 2))), axis=(0, 1))
    x, y, total = peak(c)
    return n / 2 - x, m / 2 - y, total


def correlate(a: np.ndarray, b: np.ndarray, weighted: bool = True) -> tuple[float, float, float]:
    """(dx, dy, response) from a to b."""
    return shift(spectrum(a, weighted), spectrum(b, weighted), *a.shape)
