"""A synthetic experiment through every stage: drifting wells with cells, written as TIFF files."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from lapsegrid.functions import kernels as K
from lapsegrid.operators import segment, stack
from lapsegrid.plans.experiment import Config, Experiment
from lapsegrid.sources import tiff

SIDE, SIZE, FRAMES = 128, 41, 4
CENTRES = [(32, 30), (94, 34), (30, 96), (98, 92)]  # not periodic, so a drift is plain
PATH = [(0, 0), (2, -1), (3, 1), (1, 2)]


def disc(image, x, y, r, value):
    ys, xs = np.mgrid[: image.shape[0], : image.shape[1]]
    image[(xs - x) ** 2 + (ys - y) ** 2 <= r * r] += value


def ring(size):
    image = np.zeros((size, size))
    image[:3] = image[-3:] = 100
    image[:, :3] = image[:, -3:] = 100
    return image


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    out = tmp_path_factory.mktemp("raw")
    rnd = np.random.default_rng(0)
    for t, (dx, dy) in enumerate(PATH):
        made = {k: rnd.integers(0, 3, (SIDE, SIDE)).astype(float) for k in "0123"}
        for w, (cx, cy) in enumerate(CENTRES):
            x, y = cx + dx, cy + dy
            h = SIZE // 2
            made["0"][y - h : y + h + 1, x - h : x + h + 1] += ring(SIZE)
            disc(made["2"], x - 8, y, 5, 300)
            if w % 2 == 0:
                disc(made["1"], x + 6, y + 3, 5, 400)
            disc(made["3"], x - 8, y, 5, 50)
        for k, image in made.items():
            (out / f"exp_s001t{t:02d}c{k}_ORG.tif").write_bytes(tiff.stack([image.astype(np.int64)]))
    return str(out)


def test_experiment(spark, folder, tmp_path):
    config = Config(
        {"bright": "c0_ORG", "effector": "c1_ORG", "target": "c2_ORG", "death": "c3_ORG"}, [ring(SIZE), ring(SIZE)[::-1]], 2, SIZE, 20, 15,
        sigma=30.0, settings=segment.Settings(least=20, window=3, least_radius=4, most_radius=6), count_frames=4, least_split=20,
    )
    run = Experiment(spark, folder, config, str(tmp_path))
    found = run.run()
    assert sorted((r.row, r.col, r.x, r.y) for r in found["wells"].collect()) == [(k // 2, k % 2, *c) for k, c in enumerate(CENTRES)]
    assert [(-r.px, -r.py) for r in found["shifts"].orderBy("frame").collect()] == PATH
    assert {(r.row, r.col): r.composition for r in found["compositions"].collect()} == {(0, 0): "E1T1", (0, 1): "E0T1", (1, 0): "E1T1", (1, 1): "E0T1"}
    own = found["features"].where("channel = 'target'").collect()
    assert len(own) == 4 * FRAMES and all(r.track == 1 and abs(r.x - 12) < 1 and abs(r.y - 20) < 1 and r.death > 20 and r.displacement < 1 for r in own)
    assert all(((r.assoc or 0) > 0.01) == (r.col == 0) for r in own)
    assert found["links"].count() == 6 * (FRAMES - 1)
    blocks = run.well_blocks(found, list(range(FRAMES)))
    assert blocks.count() == 4 * 49 and blocks.where("line = 0 and f1 = -1000").count() == 2
    assert found["pixel_means"].count() == found["crops"].count()
    # a second run finds its stages; one that a run didn't finish is made anew, and other settings make their own
    again = Experiment(spark, folder, config, str(tmp_path))
    assert sorted(map(tuple, again.run()["compositions"].collect())) == sorted(map(tuple, found["compositions"].collect()))
    assert again.reused == ["decoded", "frames", "wells", "shifts", "masks", "crops", "counts", "cells", "links"] and run.reused == []
    (tmp_path / f"cells-{run.fingerprint()}" / "_SUCCESS").unlink()
    third = Experiment(spark, folder, config, str(tmp_path))
    assert third.run()["links"].count() == 6 * (FRAMES - 1) and "cells" not in third.reused and "counts" in third.reused
    other = Experiment(spark, folder, replace(config, least_split=10**6), str(tmp_path))
    assert other.fingerprint() != run.fingerprint()
    gated = Experiment(spark, folder, replace(config, gate=15.0), None)
    assert gated.run()["links"].count() == 6 * (FRAMES - 1)


def test_border_repair_and_unmixing(spark):
    image = np.full((4, 5), 10)
    image[:, 0] = 0
    rows = [(1, c, t, 5, 4, image.ravel().tolist()) for c in ("a", "b") for t in (0, 1)]
    frames = spark.createDataFrame(rows, f"{stack.KINDS}, width int, height int, px array<int>")
    px = np.array(stack.repair_borders(frames).first().px).reshape(4, 5)
    assert (px[:, 0] == 8).all() and (px[:, 1:] == 10).all()
    out = stack.unmix_frames(frames, "a", "b", (1.0, 0.0, -0.5, 1.0)).where("channel = 'b' and frame = 0").first().px
    assert out == [0, 5, 5, 5, 5] * 4
    flat = stack.subtract_background(frames.withColumn("px", F.array_repeat(F.lit(9), 20)), 2.0)
    assert flat.select(F.array_max("px")).distinct().collect()[0][0] == 0


def test_config_is_checked():
    with pytest.raises(ValueError):
        Config({"bright": "x"}, [np.zeros((4, 4))])
    with pytest.raises(ValueError):
        Config({}, [np.zeros((3, 3))])
    assert K.gaussian(np.eye(3), 0).sum() == 3
