"""Components and distances of whole stacks against plain voxel walks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lapsegrid.functions import kernels as K
from lapsegrid.functions import runs as R
from lapsegrid.operators import solids


def plain_components(volume):
    """Smallest (z, y, x) place of each voxel's 26-connected component of equal values; -1 for zero."""
    out = np.full(volume.shape, -1, dtype=np.int64)
    flat = np.arange(volume.size).reshape(volume.shape)
    for start in np.argwhere(volume):
        if out[tuple(start)] >= 0:
            continue
        queue = [tuple(start)]
        out[queue[0]] = flat[queue[0]]
        for p in queue:
            lo, hi = np.maximum(np.array(p) - 1, 0), np.minimum(np.array(p) + 2, volume.shape)
            for q in np.ndindex(*(hi - lo)):
                at = tuple(lo + q)
                if volume[at] == volume[p] and out[at] < 0:
                    out[at] = flat[tuple(start)]
                    queue.append(at)
    return out


def plain_labels(volume, least=0):
    own = plain_components(volume)
    names, n = np.unique(own[own >= 0], return_counts=True)
    kept = sorted(((-c, k) for k, c in zip(names.tolist(), n.tolist(), strict=True) if c >= least))
    out = np.zeros(volume.shape, dtype=np.int64)
    for label, (_, k) in enumerate(kept, 1):
        out[own == k] = label
    return out


def stacks(spark, volumes):
    rows = [(s, 10 * z + 3, v.shape[2], v[z].ravel().tolist()) for s, v in volumes.items() for z in range(len(v))]
    return spark.createDataFrame(rows, "stack string, plane int, width int, px array<int>").repartition(5)


def back(frame, volumes):
    out = {s: [None] * len(v) for s, v in volumes.items()}
    for r in frame.collect():
        out[r.stack][(r.plane - 3) // 10] = np.array(r.px).reshape(-1, r.width)
    return {s: np.stack(v) for s, v in out.items()}


def made(seed, share=0.2):
    rng = np.random.default_rng(seed)
    return {
        "noise": (rng.random((9, 12, 17)) < share).astype(int), "values": rng.integers(0, 3, (5, 8, 9)), "empty": np.zeros((3, 4, 5), dtype=int),
        "full": np.ones((2, 3, 4), dtype=int), "one": (rng.random((1, 6, 7)) < 0.5).astype(int), None: (rng.random((4, 5, 6)) < 0.4).astype(int),
    }


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("corners", [True, False])
def test_runs_give_the_components_of_a_frame(seed, corners):
    """Against a walk from every pixel."""
    values = np.random.default_rng(seed).integers(0, 3, (14, 19)) * (np.random.default_rng(seed + 9).random((14, 19)) < 0.7)
    own = R.runs_of(values, corners)
    got = R.drawn(own, own.part + 1, *values.shape)
    steps = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (corners or not (a and b))]
    want = np.zeros(values.shape, dtype=int)
    for y, x in np.argwhere(values).tolist():
        if not want[y, x]:
            walk = [(y, x)]
            want[y, x] = y * 19 + x + 1
            for p, q in walk:
                for a, b in steps:
                    if 0 <= p + a < 14 and 0 <= q + b < 19 and values[p + a, q + b] == values[y, x] and not want[p + a, q + b]:
                        want[p + a, q + b] = want[y, x]
                        walk.append((p + a, q + b))
    assert np.array_equal(got, want)


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("r", [0, 1, 3, 30])
def test_sliding_maximum(seed, r):
    image = np.random.default_rng(seed).normal(size=(13, 22))
    want = [[image[max(0, y - r) : y + r + 1, max(0, x - r) : x + r + 1].max() for x in range(22)] for y in range(13)]
    assert np.array_equal(K.sliding_max(image, r), want)


@pytest.mark.parametrize("seed", range(4))
def test_clean_labels(seed):
    label = np.random.default_rng(seed).integers(0, 4, (12, 15))
    own = R.runs_of(label, corners=False)
    part = R.drawn(own, own.part + 1, *label.shape)
    got = K.clean_labels(label)
    for k in (1, 2, 3):
        names, n = np.unique(part[label == k], return_counts=True)
        assert np.array_equal(got == k, part == names[n.argmax()])


@pytest.mark.parametrize("bound", [1 << 20, 0])
def test_labels_of_stacks(spark, monkeypatch, bound):
    """Both ways of merging: a stack's links in one row, and contracted as tables."""
    monkeypatch.setattr(solids, "LINKS", bound)
    volumes = {k: v for k, v in made(1).items() if k is not None}
    found = back(solids.labelled(stacks(spark, volumes), ["stack"], "plane", lambda im: im, least=2), volumes)
    for name, volume in volumes.items():
        assert np.array_equal(found[name], plain_labels(volume, 2)), name


def test_component_through_fifty_frames(spark):
    """A thread that moves a pixel a frame and turns back is one component; its copy beside it another."""
    volume = np.zeros((50, 20, 60), dtype=int)
    for z in range(50):
        volume[z, 5, z if z < 40 else 79 - z] = 1
        volume[z, 9 + z % 2, 3] = 1
    found = back(solids.labelled(stacks(spark, {"a": volume}), ["stack"], "plane", lambda im: im > 0), {"a": volume})["a"]
    assert np.array_equal(found, plain_labels(volume)) and found.max() == 2 and (found == 1).sum() == 50


def test_exact_form_drops_the_smallest_large_one(spark):
    volume = np.zeros((2, 9, 12), dtype=int)
    volume[0, 0, :6] = volume[0, 2, :5] = volume[1, 4, :4] = volume[0, 6, :2] = 1
    run = lambda v, least, exact: back(solids.labelled(stacks(spark, {"a": v}), ["stack"], "plane", lambda im: im > 0, least, exact), {"a": v})["a"]
    assert run(volume, 4, False).max() == 3
    assert run(volume, 4, True).max() == 2
    volume[0, 6] = 0
    assert run(volume, 4, True).max() == 1


@pytest.mark.parametrize("spacing", [(1.0, 1.0, 1.0), (2.0, 0.357, 0.5)])
def test_distances_of_stacks(spark, monkeypatch, spacing):
    monkeypatch.setattr(solids, "TILE", 60)
    volumes = {k: v for k, v in made(2, 0.9).items() if k not in (None, "values")}
    volumes["deep"] = np.ones((30, 9, 9), dtype=int)
    volumes["deep"][4, 2, 3] = 0
    found = back(solids.distances(stacks(spark, volumes), ["stack"], "plane", lambda im: im > 0, spacing), volumes)
    for name, volume in volumes.items():
        at, off = np.argwhere(volume >= 0) * np.array(spacing), np.argwhere(volume == 0) * np.array(spacing)
        away = np.sqrt(((at[:, None] - off[None]) ** 2).sum(-1)).min(1) if len(off) else np.full(len(at), float((np.array(volume.shape) * spacing).sum()))
        assert np.allclose(found[name].ravel(), np.where(volume.ravel() > 0, away, 0.0)), name


def test_plane_distance_equals_the_shift_form():
    mask = np.random.default_rng(5).random((90, 70)) < 0.97
    assert np.allclose(np.sqrt(R.plane_squares(mask)), K.inside_distance(mask))
    assert np.isinf(R.plane_squares(np.ones((4, 5), dtype=bool))).all()


def test_names_of_working_columns_are_refused(spark):
    with pytest.raises(ValueError, match="root"):
        solids.labelled(spark.createDataFrame([], "root int, plane int, width int, px array<int>"), ["root"], "plane", lambda im: im > 0)


def test_empty_table_and_labels_by_frame(spark):
    none = spark.createDataFrame([], "stack string, plane int, width int, px array<int>")
    assert solids.labelled(none, ["stack"], "plane", lambda im: im > 0).count() == 0
    assert solids.distances(none, ["stack"], "plane", lambda im: im > 0).count() == 0
    volumes = made(4)
    rows = solids.labelled(stacks(spark, {"noise": volumes["noise"]}).withColumn("extra", F.lit(1)), ["stack"], "plane", lambda im: im > 0)
    assert rows.columns == ["stack", "plane", "width", "px"]
