"""Filters by tiles against the kernels on whole frames."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lapsegrid.functions import kernels as K
from lapsegrid.operators import segment, tiles


def frames(spark, images):
    return spark.createDataFrame([(k, im.shape[1], im.ravel().tolist()) for k, im in images.items()], "k string, width int, px array<int>")


def back(frame):
    return {r.k: np.array(r.px).reshape(-1, r.width) for r in frame.collect()}


IMAGES = {"a": np.random.default_rng(0).integers(0, 900, (37, 51)), "b": np.random.default_rng(1).integers(0, 900, (8, 90)), "c": np.ones((3, 4), dtype=int)}


@pytest.mark.parametrize("tile", [5, 16, 512])
def test_background_by_tiles(spark, tile):
    got = back(tiles.subtract_background(frames(spark, IMAGES), ["k"], 2.0, tile=tile))
    for k, im in IMAGES.items():
        if min(im.shape) > 8:  # the kernel mirrors a frame once
            assert np.array_equal(got[k], K.subtract_background(im, 2.0)), k
        assert got[k].shape == im.shape


def test_correlation_and_maxima_by_tiles(spark):
    pattern = np.random.default_rng(2).integers(0, 9, (5, 5)).astype(float)
    own = {k: im for k, im in IMAGES.items() if k != "c"}
    scores = tiles.correlated(frames(spark, own), ["k"], pattern, tile=16)
    got = back(scores)
    for k, im in own.items():
        assert np.allclose(got[k], K.ncc(im, pattern), atol=1e-9)
    found = {(r.k, r.x, r.y) for r in tiles.maxima(scores, ["k"], 3, 2, tile=11).collect()}
    want = {(k, x, y) for k, im in own.items() for x, y, _, _ in segment.find_wells(im, [pattern], 7, 2)}
    assert found == want


def test_large_frame_with_a_wide_filter(spark):
    """4096 x 4096 pixels with a filter of radius 160: the same as the whole frame, seams included."""
    side = 4096
    px = F.expr(f"transform(sequence(0, {side * side - 1}), p -> cast((p * 7919L + (p div {side}) * 104729L) % 4001 as int))")
    frame = spark.range(1).select(F.lit("a").alias("k"), F.lit(side).alias("width"), px.alias("px"))
    image = np.arange(side * side, dtype=np.int64)
    image = ((image * 7919 + image // side * 104729) % 4001).reshape(side, side)
    want = K.subtract_background(image, 40.0)
    got = tiles.filtered(tiles.cut(frame, ["k"], 160, True, 1024), ["k"], 160, lambda im: K.subtract_background(im, 40.0))
    rows = got.select("top", "left", "width", F.aggregate("px", F.lit(0.0), lambda a, v: a + v).alias("total")).collect()
    assert len(rows) == 16 and len(K._taps(40.0)) == 321
    for r in rows:
        assert r.total == want[r.top : r.top + 1024, r.left : r.left + 1024].sum()
