"""Frame filters by tiles with halos: filters as wide as a frame is large run on pieces that fit a task, with exact seams.

A frame is cut into tiles, each with the pixels around it that its filter looks at; beyond the frame these are mirrored or zero.
Tiles are rows: those of a frame run in different tasks and are put together again only if frames are asked for.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapsegrid.functions import kernels as K
from lapsegrid.operators.segment import bounded_frames, each_frame

#: Side of a tile without its halo.
TILE = 512


def _kinds(frame: DataFrame, names: list[str]) -> str:
    own = dict(frame.dtypes)
    return ", ".join(f"{n} {own[n]}" for n in names)


def cut(frames: DataFrame, keys: list[str], halo: int, mirrored: bool, tile: int = TILE) -> DataFrame:
    """(keys, top, left, wide, high, width, px array<double>): the tiles of frames (keys, width, px), each with ``halo`` pixels on every
    side. ``wide`` and ``high`` are the frame's sides."""

    def run(key, image):
        h, w = image.shape
        at = lambda n, a, b: np.arange(a - halo, b + halo)  # noqa: ARG005, E731

        def places(n, a, b):
            k = at(n, a, b)
            if mirrored:
                k = np.mod(k, 2 * n)
                return np.where(k < n, k, 2 * n - 1 - k), np.ones(len(k), dtype=bool)
            return np.clip(k, 0, n - 1), (k >= 0) & (k < n)

        for top in range(0, h, tile):
            ys, in_y = places(h, top, min(top + tile, h))
            for left in range(0, w, tile):
                xs, in_x = places(w, left, min(left + tile, w))
                part = np.where(in_y[:, None] & in_x[None, :], image[ys[:, None], xs[None, :]], 0).astype(np.float64)
                yield (*key, top, left, w, h, part.shape[1], part.ravel())

    return each_frame(frames, keys, run, f"{_kinds(frames, keys)}, top int, left int, wide int, high int, width int, px array<double>")


def filtered(tiles: DataFrame, keys: list[str], halo: int, kernel: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Tiles of kernel(tile), an array of the tile's size, without their halos. Tiles are dealt out anew, so a frame's
    are spread over the cluster."""
    head = [*keys, "top", "left", "wide", "high"]

    def run(key, image):
        out = kernel(image)
        out = out[halo : out.shape[0] - halo, halo : out.shape[1] - halo]
        return [(*key, out.shape[1], np.ascontiguousarray(out, dtype=np.float64).ravel())]

    return each_frame(tiles.repartition(*keys, "top", "left"), head, run, f"{_kinds(tiles, head)}, width int, px array<double>")


def joined(tiles: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, width, px array<double>): frames of tiles without halos."""
    packed = tiles.groupBy(*keys, "wide", "high").agg(F.collect_list(F.struct("top", "left", "width", "px")).alias("t"))
    packed = packed.select(*keys, "wide", "high", *(F.col(f"t.{c}").alias(c) for c in ("top", "left", "width", "px")))
    bounded_frames(tiles.sparkSession)

    def build(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                out = np.zeros((batch.column("high")[k].as_py(), batch.column("wide")[k].as_py()))
                for top, left, width, px in zip(*(batch.column(c).slice(k, 1).flatten() for c in ("top", "left", "width", "px")), strict=True):
                    part = px.values.to_numpy(zero_copy_only=False).reshape(-1, width.as_py())
                    out[top.as_py() : top.as_py() + part.shape[0], left.as_py() : left.as_py() + part.shape[1]] = part
                yield pa.record_batch({**{c: batch.column(c).slice(k, 1) for c in keys}, "width": pa.array([out.shape[1]], pa.int32()), "px": pa.array([out.ravel()], pa.list_(pa.float64()))})

    return packed.mapInArrow(build, f"{_kinds(tiles, keys)}, width int, px array<double>")


def subtract_background(frames: DataFrame, keys: list[str], sigma: float = 40.0, truncate: bool = True, tile: int = TILE) -> DataFrame:
    """``kernels.subtract_background`` of frames (keys, width, px) by tiles (MAP2)."""
    halo = len(K._taps(sigma)) // 2
    return joined(filtered(cut(frames, keys, halo, True, tile), keys, halo, lambda im: K.subtract_background(im, sigma, truncate)), keys)


def correlated(frames: DataFrame, keys: list[str], pattern: np.ndarray, tile: int = TILE) -> DataFrame:
    """``kernels.ncc`` of frames (keys, width, px) with a pattern by tiles (KR8). The pattern is a value of the query; each tile is
    transformed at its own size, with what lies around it in place of zeros (overlap-save)."""
    halo = max(pattern.shape)
    return joined(filtered(cut(frames, keys, halo, False, tile), keys, halo, lambda im: K.ncc(im, pattern)), keys)


def maxima(frames: DataFrame, keys: list[str], reach: int, margin: int, tile: int = TILE) -> DataFrame:
    """(keys, x, y, score): pixels of score frames (keys, width, px), further than ``margin`` from the border, that nothing within ``reach`` rows
    and columns exceeds; plateaus are kept (WN7). Tiles look ``reach`` further, so none is found twice or missed at a seam."""
    head = [*keys, "top", "left", "wide", "high"]
    tiles = cut(frames, keys, reach, False, tile)

    def run(key, image):
        top, left, wide, high = key[-4:]
        y, x = np.indices(image.shape)
        y, x = y + top - reach, x + left - reach
        held = np.where((y >= margin) & (y < high - margin) & (x >= margin) & (x < wide - margin), image, -np.inf)
        best = np.isfinite(held) & (held >= K.sliding_max(held, reach))
        inner = np.zeros_like(best)
        inner[reach : image.shape[0] - reach, reach : image.shape[1] - reach] = True
        return [(*key[:-4], int(x[p]), int(y[p]), float(image[p])) for p in map(tuple, np.argwhere(best & inner))]

    return each_frame(tiles.repartition(*keys, "top", "left"), head, run, f"{_kinds(frames, keys)}, x int, y int, score double")
