"""Runs of equal pixels in a row: components of frames and stacks without looking at a pixel twice."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Runs:
    """Runs in raster order: row, first and last column, value, and the component they belong to."""

    y: np.ndarray
    x0: np.ndarray
    x1: np.ndarray
    v: np.ndarray
    part: np.ndarray


def runs_of(image: np.ndarray, corners: bool = True) -> Runs:
    """Runs of equal values that aren't zero; ``part`` is the smallest raster position of the component of touching
    runs, 8-connected or, without ``corners``, 4-connected."""
    h, w = image.shape
    new = np.ones((h, w), dtype=bool)
    new[:, 1:] = image[:, 1:] != image[:, :-1]
    y, x0 = np.nonzero(new)
    last = np.empty_like(x0)
    last[:-1] = np.where(y[1:] == y[:-1], x0[1:] - 1, w - 1)
    if len(last):
        last[-1] = w - 1
    v = image[y, x0]
    on = v != 0
    out = Runs(y[on].astype(np.int64), x0[on].astype(np.int64), last[on].astype(np.int64), v[on].astype(np.int64), np.zeros(int(on.sum()), dtype=np.int64))
    root = joined(len(out.y), *touching(out, out, w, (1,), corners))
    out.part = out.y[root] * w + out.x0[root]
    return out


def touching(a: Runs, b: Runs, width: int, rows: tuple[int, ...], corners: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (place in a, place in b) of runs of equal value whose rows differ by one of ``rows`` and that touch, with
    ``corners`` also there. Runs of a row are in order and apart, so those that touch a run follow each other."""
    span, more = width + 4, int(corners)
    first, last = b.y * span + b.x0, b.y * span + b.x1
    one, two = [], []
    for dy in rows:
        base = (a.y + dy) * span
        low = np.searchsorted(last, base + a.x0 - more)
        n = np.maximum(0, np.searchsorted(first, base + a.x1 + more, side="right") - low)
        left = np.repeat(np.arange(len(n)), n)
        right = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
        same = a.v[left] == b.v[right]
        one.append(left[same])
        two.append(right[same])
    return np.concatenate(one), np.concatenate(two)


def joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest of 0..n-1 that each is linked to: roots are hung under smaller ones and ways shortened, round by round."""
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root
        np.minimum.at(root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while not np.array_equal(root[root], root):
            root = root[root]


def drawn(runs: Runs, values: np.ndarray, height: int, width: int) -> np.ndarray:
    """An image with each run in its value, zero elsewhere."""
    flat = np.zeros(height * width + 1, dtype=np.int64)
    start = runs.y * width + runs.x0
    np.add.at(flat, start, values)
    np.subtract.at(flat, runs.y * width + runs.x1 + 1, values)
    return np.cumsum(flat)[:-1].reshape(height, width)


def envelope(squares: np.ndarray, spacing: float = 1.0) -> np.ndarray:
    """Along the first axis, the least of ``squares`` plus the squared distance: the lower envelope of parabolas, found
    for all lines at once. Each parabola enters and leaves the envelope once, so the time doesn't depend on the distances."""
    n, lines = squares.shape
    f = squares / spacing**2
    place = np.zeros((n, lines), dtype=np.int64)  # parabolas of the envelope, left to right
    begin = np.full((n + 1, lines), np.inf)  # where each begins to be the lowest
    top = np.full(lines, -1)
    own = np.arange(lines)
    for q in range(n):
        left = own[np.isfinite(f[q])]
        while len(left):
            k = top[left]
            p = place[np.maximum(k, 0), left]
            with np.errstate(invalid="ignore"):
                cut = np.where(k >= 0, ((f[q, left] + q * q) - (f[p, left] + p * p)) / np.where(k >= 0, 2.0 * (q - p), 1.0), -np.inf)
            hidden = (k >= 0) & (cut <= begin[np.maximum(k, 0), left])
            put = left[~hidden]
            top[put] += 1
            place[top[put], put] = q
            begin[top[put], put] = cut[~hidden]
            left = left[hidden]
            top[left] -= 1
    out = np.full((n, lines), np.inf)
    at = np.zeros(lines, dtype=np.int64)
    some = top >= 0
    for q in range(n):
        while True:
            on = some & (at < top) & (begin[np.minimum(at + 1, n), own] < q)
            if not on.any():
                break
            at[on] += 1
        p = place[at, own]
        out[q] = np.where(some, (q - p) ** 2 + f[p, own], np.inf)
    return out * spacing**2


def plane_squares(mask: np.ndarray, dy: float = 1.0, dx: float = 1.0) -> np.ndarray:
    """Squared distance of each pixel of a mask to the nearest one off it, 0 off it, infinite where there is none."""
    h, w = mask.shape
    rows = np.arange(h, dtype=float)[:, None]
    above = np.maximum.accumulate(np.where(mask, -np.inf, rows), axis=0)
    below = np.minimum.accumulate(np.where(mask, np.inf, rows)[::-1], axis=0)[::-1]
    column = (np.minimum(rows - above, below - rows) * dy) ** 2
    return envelope(np.ascontiguousarray(column.T), dx).T
