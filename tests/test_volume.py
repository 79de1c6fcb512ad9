"""Volume operators on inputs with known answers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lapsegrid.operators import volume


def test_slabs_repeat_or_blank_the_ends(spark):
    rows = spark.createDataFrame([("a", k, [10 * k]) for k in range(3)] + [("b", 0, [7])], "s string, frame int, px array<int>")
    got = {(r.s, r.frame): r.px for r in volume.slabs(rows, ["s"], "frame", 1).collect()}
    assert got == {("a", 0): [0, 0, 10], ("a", 1): [0, 10, 20], ("a", 2): [10, 20, 20], ("b", 0): [7, 7, 7]}
    blank = {(r.s, r.frame): r.px for r in volume.slabs(rows, ["s"], "frame", 1, replicate=False).collect()}
    assert blank[("a", 0)] == [None, 0, 10] and blank[("b", 0)] == [None, 7, None]


def test_stack_filter_across_frames(spark):
    rows = spark.createDataFrame([("a", k, [9 if k == 1 and p == 4 else 0 for p in range(9)]) for k in range(3)], "s string, frame int, px array<int>")
    got = volume.stack_filter(rows, ["s", "frame"], "s string, frame int", ["s"], "frame", 3, 3, 1, lambda slab: volume.dilated(slab, 1, 1), replicate=False)
    totals = {r.frame: sum(r.px) for r in got.collect()}
    assert totals == {0: 9.0, 1: 45.0, 2: 9.0}


def test_morphology_by_definition():
    rng = np.random.default_rng(2)
    slab = rng.integers(0, 50, (3, 6, 7))
    for r, rz in ((1, 0), (2, 1)):
        want_max, want_min = np.zeros((6, 7)), np.zeros((6, 7))
        for y in range(6):
            for x in range(7):
                near = [slab[1 + dz, y + dy, x + dx] for dz, dy, dx in volume.ball(r, rz) if 0 <= y + dy < 6 and 0 <= x + dx < 7]
                want_max[y, x], want_min[y, x] = max(near), min(near)
        assert (volume.dilated(slab, r, rz) == want_max).all() and (volume.eroded(slab, r, rz) == want_min).all()
    image = np.full((5, 5), 8)
    image[2, 2] = 0
    assert (volume.holes_filled(image, 1) == 8).all()
    assert volume.outline(image > 0).sum() == 4


def test_median_of_one_frame_repeats_borders():
    image = np.array([[[1, 2], [3, 4]]])
    assert volume.median_filter(image).tolist() == [[2, 2], [3, 3]]


def test_split_in_two():
    mask = np.zeros((6, 14), dtype=bool)
    mask[1:4, 1:4] = mask[1:4, 9:12] = mask[2, 4:9] = True
    label = volume.split_in_two(mask)
    assert label[1, 1] == 1 and label[3, 11] == 2 and (label[1:4, 1:4] == 1).all() and (label[1:4, 9:12] == 2).all() and not label[~mask].any()
    assert volume.split_in_two(np.zeros((2, 2), bool)).sum() == 0 and volume.split_in_two(np.eye(1, dtype=bool)).sum() == 1


@pytest.mark.parametrize(("steps", "n"), [(0, 1), (1, 2), (2, 3), (99, 4)])
def test_within_steps(steps, n):
    mask = np.array([[1, 0, 0, 0, 1], [0, 1, 1, 0, 0], [0, 0, 0, 1, 0]], dtype=bool)
    assert volume.within_steps(mask, (0, 0), steps).sum() == n
    assert volume.within_steps(mask, (0, 1), steps).sum() == 0


def test_contact(spark):
    mask = np.zeros((10, 10), dtype=bool)
    mask[0, :5] = True
    assert volume.nearest_share(mask, (3, 0)) == 3.0 and volume.nearest_share(mask & False, (0, 0)) is None
    rows = spark.createDataFrame([(1.7, 3.2), (1.8, 3.1), (None, 3.0)], "near double, area double").select(volume.contact(F.col("near"), F.col("area")).alias("c"))
    assert [r.c for r in rows.collect()] == [True, False, None]


def test_points_round_trip(spark, tmp_path):
    points = spark.createDataFrame([(0, 4, 2), (7, 0, 0)], "x int, y int, z int")
    volume.write_points(points, f"{tmp_path}/pts")
    assert sorted(map(tuple, volume.read_points(spark, f"{tmp_path}/pts").collect())) == [(0, 4, 2), (7, 0, 0)]
    (tmp_path / "odd.npts").write_text("3 5 1\n\n1 2\nx y z\n 1  1\t1 \n")
    assert sorted(map(tuple, volume.read_points(spark, f"{tmp_path}/odd.npts").collect())) == [(0, 0, 0), (0, 4, 2)]


def test_colours_and_winner(spark):
    rows = spark.createDataFrame([(0, 0), (0, 5), (3, 9), (4, 4)], "a int, b int")
    a, b = F.col("a"), F.col("b")
    w = volume.winner([a, b])
    got = rows.select(volume.composite([a, b], ["red", "green"]).alias("c"), w[0].alias("wa"), w[1].alias("wb")).collect()
    assert [tuple(r) for r in got] == [(None, 0, 0), ("green", 0, 5), ("red", 0, 9), ("red", 4, 0)]


def test_merging_keeps_other_labels(spark):
    px = spark.createDataFrame([(1, 1, 0, 0, 10), (1, 2, 4, 0, 30), (1, 3, 9, 9, 5)], "f int, label int, x int, y int, i int")
    pairs = spark.createDataFrame([(1, 2, 1)], "f int, label int, into int")
    got = {r.label: (r.area, r.cx, r.mean) for r in volume.merged(px, ["f"], pairs).collect()}
    assert got == {1: (2, 2.0, 20.0), 3: (1, 9.0, 5.0)}
