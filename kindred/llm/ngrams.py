"""Hashed character n-grams with numpy."""

from __future__ import annotations

import numpy as np


def code_points(text: str | None) -> np.ndarray:
    """Lower-cased code points with one space between words and at both ends."""
    return np.frombuffer(f" {' '.join(text.lower().split())} ".encode("utf-32-le", "surrogatepass"), np.uint32) if text else np.empty(0, np.uint32)


def buckets(points: np.ndarray, sizes: tuple[int, ...], bits: int) -> np.ndarray:
    """The bucket (of 2 ** bits) of each n-gram of the given sizes, repeats included."""
    out = []
    for n in sizes:
        if len(points) < n:
            continue
        stop = len(points) - n + 1
        h = points[:stop] + np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)
        for i in range(1, n):
            h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B) + points[i : i + stop]
        h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
        out.append((h ^ (h >> np.uint32(16))) >> np.uint32(32 - bits))
    return np.concatenate(out) if out else np.empty(0, np.uint32)
