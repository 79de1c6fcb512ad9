"""Sparse assignment and pixel-set distances against plain forms."""

import time
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lapsegrid.functions import kernels as K
from lapsegrid.functions import matching as M
from lapsegrid.operators import stack, tracking


def best_total(n, m, edges):
    """Greatest weight of a one-to-one choice by all orders of the larger side."""
    weight = {}
    for a, b, w in edges:
        weight[a, b] = max(w, weight.get((a, b), 0.0))
    side = max(n, m)
    return max(sum(weight.get((a, b), 0.0) for a, b in enumerate(p)) for p in permutations(range(side)))


@pytest.mark.parametrize("seed", range(40))
def test_sparse_assignment_is_the_best(seed):
    rng = np.random.default_rng(seed)
    n, m = rng.integers(1, 7, 2)
    k = int(rng.integers(1, n * m + 3))
    a, b, w = rng.integers(0, n, k), rng.integers(0, m, k), np.round(rng.random(k), 1 if seed % 2 else 6)
    at = M.assign_edges(a + 10, b - 5, w)
    assert len(set(a[at].tolist())) == len(at) == len(set(b[at].tolist()))
    assert np.isclose(w[at].sum(), best_total(n, m, zip(a.tolist(), b.tolist(), w.tolist(), strict=True)))


def test_sparse_and_dense_totals_agree():
    rng = np.random.default_rng(1)
    w = rng.random((60, 45))
    a, b = (x.ravel() for x in np.indices(w.shape))
    dense = sum(w[p] for p in K.assign(w))
    assert np.isclose(w.ravel()[M.assign_edges(a, b, w.ravel())].sum(), dense)
    w = rng.random((210, 205))
    a, b = (x.ravel() for x in np.indices(w.shape))
    assert np.isclose(w.ravel()[M.assign_edges(a, b, w.ravel())].sum(), sum(w[p] for p in K.assign(w)))


def test_five_thousand_cells_in_seconds(spark):
    """Cells that move a little: gated pairs are few, and the links are right."""
    rng = np.random.default_rng(2)
    at = rng.random((5000, 2)) * 2000
    rows = [(1, f, k, float(x), float(y), 30) for f in (0, 1) for k, (x, y) in enumerate(at + f * rng.normal(0, 1.5, at.shape))]
    cells = spark.createDataFrame(rows, "well int, frame int, cell int, x double, y double, area int")
    began = time.time()
    pairs = tracking.with_weight(tracking.with_cost(tracking.gated_candidates(cells, ["well"], 20.0)), ["well"])
    found = tracking.assignments(pairs, ["well"]).collect()
    assert time.time() - began < 60
    assert sum(r.cell == r.cell2 for r in found) > 4700


def test_gated_candidates_equal_the_filtered_ones(spark):
    rng = np.random.default_rng(3)
    rows = [(w, f, k, float(x), float(y), 9) for w in (0, 1) for f in (0, 2, 3) for k, (x, y) in enumerate(rng.integers(-50, 50, (30, 2)))] + [(0, 3, 99, None, 1.0, 9)]
    cells = spark.createDataFrame(rows, "well int, frame int, cell int, x double, y double, area int")
    own = {tuple(r) for r in tracking.gated_candidates(cells, ["well"], 15.0).select("well", "frame", "next_frame", "cell", "cell2").collect()}
    plain = tracking.link_candidates(cells, ["well"]).where((F.col("x") - F.col("x2")) ** 2 + (F.col("y") - F.col("y2")) ** 2 <= 225)
    assert own == {tuple(r) for r in plain.select("well", "frame", "next_frame", "cell", "cell2").collect()} and own


@pytest.mark.parametrize("seed", range(6))
def test_set_distances(seed):
    rng = np.random.default_rng(seed)
    label = [rng.integers(0, 5, (14, 17)) * (rng.random((14, 17)) < 0.5) for _ in range(2)]
    sets = [[np.nonzero(x == k) for k in range(1, 5) if (x == k).any()] for x in label]
    shared, away = M.set_distances(*sets)
    for i, (y, x) in enumerate(sets[0]):
        for j, (y2, x2) in enumerate(sets[1]):
            plain = tracking.overlap_of(np.stack([y, x], 1), np.stack([y2, x2], 1))
            assert (int(shared[i, j]), float(away[i, j])) == pytest.approx(plain)


def test_pair_overlaps_of_frames(spark):
    pts = lambda *p: [{"x": x, "y": y} for x, y in p]
    cells = spark.createDataFrame([("w", 0, 1, pts((0, 0), (1, 0))), ("w", 0, 2, pts((9, 9))), ("w", 2, 7, pts((1, 0), (2, 0))), ("v", 0, 1, pts((0, 0)))], "well string, frame int, cell int, pts array<struct<x:int,y:int>>")
    steps = tracking.next_frames(cells, ["well"]).where("next_frame is not null")
    found = sorted(map(tuple, stack.pair_overlaps(cells, steps, ["well"]).collect()))
    assert found == [("w", 0, 2, 1, 7, 1, 0.0), ("w", 0, 2, 2, 7, 0, pytest.approx(np.sqrt(49 + 81)))]


def test_seed_maps(spark):
    seeds = spark.createDataFrame([(1, 2, 0), (1, 2, 0), (1, 0, 1), (1, 3, 2), (2, 0, 0)], "k int, x int, y int")
    found = {r.k: r.px for r in stack.seed_maps(seeds, ["k"], 4, 3).collect()}
    assert found == {1: [0, 0, 255, 0, 255, 0, 0, 0, 0, 0, 0, 255], 2: [255] + [0] * 11}
