"""Frame kernels over DataFrames: one frame per row, no shuffle.

Frames are (keys..., px array, optionally width); kernels come from
``lapsegrid.functions.kernels`` and run on Arrow batches of few frames.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lapsegrid.functions import kernels as K
from lapsegrid.operators.histogram import minimum_error


@dataclass(frozen=True)
class Settings:
    """Segmentation parameters; names of the key-value file in brackets."""

    sigma2: float = 2.0  # [sigmaGfilter], a variance
    least: int = 200  # [minVolume]
    most: int = 0  # [maxVolume], 0: none
    window: int = 5  # [clusterXY]
    least_radius: int = 15
    most_radius: int = 25
    seed_frames: int = 7  # [num_time_seeds]
    levels: int = 10  # [numLevel]
    by_levels: bool = False
    """Seeds from the inside distances of level sets (KR5) in place of the Laplacian response."""
    classes: int = 2
    """More than 2: the foreground is the brightest of so many intensity classes (KR6), not what exceeds the threshold."""
    exact: bool = False

    @staticmethod
    def read(options: dict[str, str]) -> Settings:
        get = lambda k, d: type(d)(float(options.get(k, d)))
        return Settings(get("sigmaGfilter", 2.0), get("minVolume", 200), get("maxVolume", 0), get("clusterXY", 5), get("min_rad", 15), get("max_rad", 25), get("num_time_seeds", 7), get("numLevel", 10))


#: Bytes of frames that a worker takes in at once (about two of 2048 x 2048 pixels, and one more), and of rows it gives back.
IN_BYTES, OUT_BYTES, OUT_ROWS = 32 << 20, 32 << 20, 4096


def bounded_frames(spark: SparkSession) -> None:
    """Bound the Arrow batches by IN_BYTES, whatever a frame's size; a smaller setting stays. It is read
    when a query starts, and results are lazy, so it is set on the session."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = str(spark.conf.get(key, None))
    if not (now.isdecimal() and 0 < int(now) <= IN_BYTES):
        spark.conf.set(key, str(IN_BYTES))


def images_of(batch: pa.RecordBatch, width: int | None = None) -> Iterator[np.ndarray]:
    """The frames of a batch (px, and width unless given), as views of its buffers; missing pixels are NaN."""
    px = batch.column("px")
    values, at = px.values.to_numpy(zero_copy_only=False), px.offsets.to_numpy()
    widths = [width] * batch.num_rows if width else batch.column("width").to_pylist()
    for a, b, w in zip(at[:-1].tolist(), at[1:].tolist(), widths, strict=True):
        yield values[a:b].reshape(-1, w)


def _size(value) -> int:
    return getattr(value, "nbytes", 16 * len(value) if isinstance(value, (list, tuple)) else 8)


def each_frame(frames: DataFrame, keys: list[str], kernel: Callable, schema: str, width: int | None = None) -> DataFrame:
    """Apply kernel(key values, image) -> rows of tuples to each frame. Rows are handed on when they reach
    OUT_BYTES, so a worker holds a batch of frames and that much, however many frames a task has."""
    bounded_frames(frames.sparkSession)
    picked = [*keys, "px"] + ([] if width else ["width"])
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = lambda rows: pa.record_batch([pa.array(x, f.type, from_pandas=True) for x, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)
        for batch in batches:
            out, held = [], 0
            own = zip(*(batch.column(k).to_pylist() for k in keys), strict=True) if keys else iter(() for _ in range(batch.num_rows))
            for key, image in zip(own, images_of(batch, width), strict=True):
                for row in kernel(key, image):
                    out.append(row)
                    held += sum(map(_size, row))
                if held >= OUT_BYTES or len(out) >= OUT_ROWS:
                    yield made(out)
                    out, held = [], 0
            if out:
                yield made(out)

    return frames.select(*picked).mapInArrow(run, schema)


def component_rows(frames: DataFrame, keys: list[str], kinds: str, th: int, width: int, connectivity: int = 8) -> DataFrame:
    """(keys, comp, size): components of pixels >= th, named by their first raster position."""

    def find(key, image):
        return [(*key, k - 1, n) for k, n in K.sizes(K.components(image >= th, connectivity)).items()]

    return each_frame(frames, keys, find, f"{kinds}, comp int, size int", width)


def filtered_mask(frames: DataFrame, keys: list[str], kinds: str, th: int, width: int, least: int = 0, most: int = 0, exact: bool = False) -> DataFrame:
    """(keys, n_px): foreground pixels left by the component filters."""
    return each_frame(frames, keys, lambda key, im: [(*key, int(K.keep_components(im >= th, least, most, exact).sum()))], f"{kinds}, n_px int", width)


def segment(image: np.ndarray, s: Settings = Settings(), seeded: bool = True) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Mask and, if ``seeded``, seeds of a frame: smoothing, threshold, background gate, foreground choice,
    component filters, seed response, local maxima. A frame that fails the gate is empty."""
    smooth = np.floor(K.gaussian(image, np.sqrt(s.sigma2)) + 1e-9).astype(np.int64)
    mask = K.intensity_kmeans(smooth.astype(np.float64), s.classes) == s.classes - 1 if s.classes > 2 else smooth >= minimum_error(smooth)
    share = max(mask.mean(), 1 - mask.mean())
    if share < 0.9 or share == 1.0:
        return np.zeros(image.shape, dtype=bool), []
    if mask.mean() > 0.5:
        mask = np.ones_like(mask) if s.exact else ~mask
    mask = K.keep_components(mask, s.least, s.most, s.exact)
    if not seeded:
        return mask, []
    response = K.level_response(image, mask, s.levels) if s.by_levels else K.seed_response(image, mask, s.least_radius, s.most_radius)
    return mask, K.local_maxima(response, s.window)


def segment_frames(frames: DataFrame, keys: list[str], kinds: str, settings: Settings = Settings()) -> DataFrame:
    """(keys, mask array<byte>, seeds array<struct<x,y>>): one row per frame. Where ``frame`` is one of the
    keys, only the first ``seed_frames`` frames have seeds: later ones are not counted (LM2)."""
    at = keys.index("frame") if "frame" in keys else None

    def run(key, image):
        mask, seeds = segment(image, settings, at is None or key[at] < settings.seed_frames)
        return [(*key, mask.astype(np.int8).ravel(), [{"x": x, "y": y} for x, y in seeds])]

    return each_frame(frames, keys, run, f"{kinds}, mask array<tinyint>, seeds array<struct<x:int,y:int>>")


def find_wells(image: np.ndarray, patterns: list[np.ndarray], size: int, margin: int = 70, exact: bool = False) -> list[tuple[int, int, int, float]]:
    """(x, y, type, score) of the local maxima of the better of two pattern correlations
    over a box of the well size; plateaus are kept, a margin at the border is left out."""
    scores = [K.ncc(image, p, exact) for p in patterns]
    best = np.maximum(*scores) if len(scores) == 2 else scores[0]
    held = np.full(best.shape, -1000.0)
    held[margin : best.shape[0] - margin, margin : best.shape[1] - margin] = best[margin : best.shape[0] - margin, margin : best.shape[1] - margin]
    peak = K.sliding_max(held, (size - 1) // 2)
    ys, xs = np.nonzero((held >= peak) & (held > -1000))
    return [(int(x), int(y), 1 if len(scores) == 1 or scores[0][y, x] > scores[1][y, x] else 2, float(held[y, x])) for y, x in zip(ys, xs, strict=True)]
