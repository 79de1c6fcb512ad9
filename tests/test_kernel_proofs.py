"""Kernels without SQL against plain forms: intensity classes, level sets, spectral cuts, splits in two."""

from itertools import product

import numpy as np
import pytest

from lapsegrid.functions import kernels as K
from lapsegrid.operators import volume
from lapsegrid.plans import catalogue

SF = "/root/testdata/sf0.01"


def plain_classes(values, k):
    """Lloyd's rounds, value by value, from quantile starts; nearest centre, the first of equally near ones."""
    flat = [float(v) for v in np.ravel(values)]
    centre = [float(np.quantile(flat, (j + 0.5) / k)) for j in range(k)]
    for _ in range(100):
        own = [min(range(k), key=lambda j: (abs(v - centre[j]), j)) for v in flat]
        new = [float(np.mean([v for v, o in zip(flat, own, strict=True) if o == j] or [centre[j]])) for j in range(k)]
        done = np.allclose(new, centre)
        if done:
            break
        centre = new
    rank = {j: sorted(range(k), key=lambda j: centre[j]).index(j) for j in range(k)}
    return np.array([rank[o] for o in own]).reshape(np.shape(values))


@pytest.mark.parametrize("seed", range(8))
def test_intensity_classes(seed):
    rng = np.random.default_rng(seed)
    image = rng.choice([10, 40, 200], (9, 11)) + rng.integers(0, 12, (9, 11))
    assert np.array_equal(K.intensity_kmeans(image.astype(float), 3), plain_classes(image, 3))


def parts_of(mask):
    """Components of a mask by a walk over eight neighbours."""
    left, out = {tuple(p) for p in np.argwhere(mask).tolist()}, []
    while left:
        own = [left.pop()]
        for y, x in own:
            near = {(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)} & left
            left -= near
            own += near
        out.append(own)
    return out


@pytest.mark.parametrize("seed", range(5))
def test_level_response(seed):
    rng = np.random.default_rng(seed)
    image, mask = rng.integers(0, 100, (10, 12)).astype(float), rng.random((10, 12)) < 0.8
    low, high = image[mask].min(), image[mask].max()
    want = np.zeros(image.shape)
    for j in range(4):
        level = mask & (image >= low + (high - low) * j / 4)
        off = np.argwhere(~level)
        away = np.array([[np.sqrt(((off - (y, x)) ** 2).sum(1).min()) if level[y, x] else 0.0 for x in range(12)] for y in range(10)])
        smooth = K.gaussian(away, 1.0)
        for part in parts_of(level):
            ys, xs = np.array(part).T
            want[ys, xs] += smooth[ys, xs] / smooth[ys, xs].max()
    assert np.allclose(K.level_response(image, mask, 4), want)


def cut_value(near, weight, side):
    """Normalised cut of a pixel graph: what crosses over what each side has in all."""
    cross = sum(w for i in range(len(near)) for j, w in zip(near[i], weight[i], strict=True) if w and side[i] != side[j])
    whole = [sum(w for i in range(len(near)) for w in weight[i] if side[i] == s) for s in (0, 1)]
    return cross / 2 / whole[0] + cross / 2 / whole[1] if min(whole) > 0 else np.inf


def test_spectral_cuts_are_near_the_best():
    """On small connected masks, against every way to split the pixels."""
    rng, ratios = np.random.default_rng(3), []
    while len(ratios) < 12:
        mask = rng.random((4, 6)) < 0.5
        if not 8 <= mask.sum() <= 11 or len(parts_of(mask)) != 1:
            continue
        near, weight, at = K.pixel_graph(mask)
        label = K.spectral_split(mask, 2, 2)
        own = cut_value(near, weight, (label[at[:, 0], at[:, 1]] == 2).astype(int))
        best = min(cut_value(near, weight, (0, *s)) for s in product((0, 1), repeat=len(at) - 1))
        ratios.append(own / best)
    assert max(ratios) < 2 and np.median(ratios) < 1.1, ratios


@pytest.mark.parametrize("seed", range(10))
def test_split_in_two_is_a_two_means_partition(seed):
    """Each pixel is with its nearer centre, and the split is as good as any straight cut between centres found from random starts."""
    rng = np.random.default_rng(seed)
    mask = rng.random((9, 14)) < 0.4
    label = volume.split_in_two(mask, tolerance=0.0)
    at = np.argwhere(mask)
    side = label[at[:, 0], at[:, 1]]
    assert set(side) == {1, 2} and side[0] == 1 and not label[~mask].any()
    centre = np.stack([at[side == k].mean(axis=0) for k in (1, 2)])
    away = ((at[:, None] - centre) ** 2).sum(-1)
    assert (np.abs(away[:, 0] - away[:, 1]) < 1e-9).any() or ((away.argmin(1) + 1) == side).all()
    cost, others = away[np.arange(len(at)), side - 1].sum(), []
    for _ in range(20):
        c = at[rng.choice(len(at), 2, replace=False)].astype(float)
        for _ in range(100):
            own = ((at[:, None] - c) ** 2).sum(-1).argmin(1)
            c = np.stack([at[own == k].mean(axis=0) if (own == k).any() else c[k] for k in (0, 1)])
        others.append(((at[:, None] - c) ** 2).sum(-1).min(1).sum())
    assert cost <= 1.1 * min(others)


def test_level_seed_query_keeps_the_brightest_class(spark):
    rows = catalogue.QUERIES["k_level_seeds"](spark, SF).collect()
    level = {r.vec_id: np.floor((np.array(r.embedding, dtype=float) + 1) * 1000).reshape(8, 8) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    some = 0
    for r in rows:
        mask = np.array(r.mask).reshape(8, 8) > 0
        if mask.any():
            smooth = np.floor(K.gaussian(level[r.vec_id], np.sqrt(2.0)) + 1e-9)
            brightest = plain_classes(smooth, 3) == 2
            on = brightest if brightest.mean() <= 0.5 else ~brightest
            assert max(brightest.mean(), 1 - brightest.mean()) >= 0.9 and not (mask & ~on).any()
            assert all(len(p) >= 2 for p in parts_of(mask))
            some += 1
    assert some
