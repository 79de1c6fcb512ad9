"""The queries over all rows against brute force on a small fixture with a hot user."""

import random
from datetime import datetime, timedelta
from itertools import permutations
from math import ceil, exp, hypot, log, prod, sqrt

import numpy as np
import pytest

from lapsegrid.functions import kernels as K
from lapsegrid.operators import segment, tracking
from lapsegrid.plans import catalogue
from lapsegrid.sources import manifest


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    """A folder with events: users 1 to 12, of which 7 is hot; and the seeds of each user and day, in order."""
    rnd, rows, cells = random.Random(6), [], {}
    for i in range(150):
        user, day = (7 if i % 3 == 0 else 1 + i % 12), rnd.choice([0, 1, 2, 5, 6, 8])
        x, y = rnd.randint(0, 99), rnd.randint(0, 99)
        rows.append((i, datetime(2024, 1, 1) + timedelta(days=day, seconds=i), user, x + 0.5, f'{{"k": {y}}}'))
        cells.setdefault(user, {}).setdefault(day, []).append((i, x, y, 20 + i % 30))
    folder = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, value double, props string").write.parquet(f"{folder}/events.parquet")
    return folder, cells


def weights(cells):
    """user, day -> (next day, weights by cell and cell2, costs by the same)."""
    out = {}
    for user, days in cells.items():
        order = sorted(days)
        for day, later in zip(order, order[1:], strict=False):
            cost = {
                (a, b): 10 * hypot(p[1] - q[1], p[2] - q[2]) + 100 * (max(p[3], q[3]) - min(p[3], q[3])) / max(p[3], q[3])
                for a, p in enumerate(days[day], 1) for b, q in enumerate(days[later], 1)
            }
            top = max(cost.values()) + 1e-15
            out[user, day] = later, {k: exp(-6 * (c / top) ** 2) for k, c in cost.items()}, cost
    return out


def test_links_of_all_users(spark, events):
    folder, cells = events
    want, ask = weights(cells), lambda name: catalogue.QUERIES[name](spark, folder).collect()
    after = {(r.user_id, r.frame): r.next_frame for r in ask("q_next_frame")}
    assert after == {(u, d): want[u, d][0] if (u, d) in want else -1 for u, days in cells.items() for d in days}
    pairs = sorted((u, d, n, a, b) for (u, d), (n, w, _) in want.items() for a, b in w)
    assert sorted(map(tuple, ask("q_link_candidates"))) == pairs
    for name, k in (("q_link_cost", 2), ("q_link_weight", 1)):
        got = {(r[0], r[1], r[2], r[3]): r[4] for r in ask(name)}
        assert got == pytest.approx({(u, d, a, b): x for (u, d), v in want.items() for (a, b), x in v[k].items()}, abs=2e-6)


def best_total(w):
    """The greatest total weight of a one-to-one matching, by trying all columns so far used."""
    left, right = max(a for a, _ in w), max(b for _, b in w)
    if left > right:
        w, left, right = {(b, a): x for (a, b), x in w.items()}, right, left
    if right <= 6:
        return max(sum(w[a, b] for a, b in enumerate(p, 1)) for p in permutations(range(1, right + 1), left))
    totals = {0: 0.0}
    for a in range(1, left + 1):
        step = {}
        for used, total in totals.items():
            for b in range(1, right + 1):
                if not used >> b & 1:
                    step[used | 1 << b] = max(step.get(used | 1 << b, 0.0), total + w[a, b])
        totals = step
    return max(totals.values())


def test_assignment_of_all_frame_pairs(spark, events):
    folder, cells = events
    want = {(u, d): (min(len(cells[u][d]), len(cells[u][n])), best_total(w)) for (u, d), (n, w, _) in weights(cells).items()}
    assert sum(n > 3 for n, _ in want.values()) >= 5
    got = {(r.user_id, r.frame): r for r in catalogue.QUERIES["q_assignment"](spark, folder).collect()}
    assert {k: r.n_links for k, r in got.items()} == {k: n for k, (n, _) in want.items()}
    assert {k: r.total for k, r in got.items()} == pytest.approx({k: t for k, (_, t) in want.items()}, abs=2e-6)


def test_tables_hold_every_frame(spark, tmp_path):
    rnd, rows = random.Random(7), []
    for i in range(60):
        rows.append((i, "a" if i % 3 else "b", [rnd.uniform(-1, 1) for _ in range(64)]))
    spark.createDataFrame(rows, "vec_id long, label string, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    stored = {r.vec_id: r.embedding for r in spark.read.parquet(str(tmp_path / "embeddings.parquet")).collect()}
    raw, mask = {}, {}
    for label in "ab":
        own = [[int((x + 1.0) * 1000.0 // 1) for x in stored[i]] for i, name, _ in rows if name == label]
        for f in range(40):
            raw[label, f] = sum(own[f]) / 64 if f < len(own) else -1000.0
            mask[label, f] = sum(v >= 1000 for v in own[f]) / 64 if f < len(own) else -1000.0
    got = {(r.label, r.frame): r.m for r in catalogue.QUERIES["q_frame_table"](spark, str(tmp_path)).collect()}
    assert got == pytest.approx(raw, abs=1e-6)
    table = catalogue.QUERIES["q_pixel_table"](spark, str(tmp_path)).collect()
    assert len(table) == 160
    for kind, want in (("raw", raw), ("mask", mask)):
        assert {(r.label, r.frame): r.m for r in table if r.kind == kind} == pytest.approx(want, abs=1e-6)


def test_every_seed_is_in_a_channel(spark, events):
    folder, cells = events
    want = {}
    for user, days in cells.items():
        if not any(d < 7 for d in days):
            continue
        kept = []
        for effector in (True, False):
            n = [sum((i % 4 == 0) == effector for i, *_ in days.get(d, ())) for d in range(7)]
            kept.append(min(set(n), key=lambda k: (-n.count(k), k)))  # noqa: B023
        if any(kept) and kept[0] <= 1 and kept[1] <= 5:
            want[user] = tuple(kept)
    got = {r.user_id: (r.effectors, r.targets) for r in catalogue.QUERIES["q_composition"](spark, folder).collect()}
    assert got == want
    routes = {r.route: r.n for r in catalogue.QUERIES["q_routes"](spark, folder).collect()}
    assert routes["Exp"] == len(want)
    seeds = sum(r.n for odd in (False, True) for r in catalogue._channel_counts(spark, folder, odd).collect())
    assert seeds == sum(len(v) for days in cells.values() for d, v in days.items() if d < 7)


# -- kernels whose queries have no SQL: every row against a plain version --------
SF = "/root/testdata/sf0.001"


def images(spark):
    from lapsegrid.sources.views import frames

    return {r.vec_id: np.array(r.px).reshape(8, 8) for r in frames(spark, SF).collect()}


def plain_components(mask, diagonal=True):
    """Sets of touching pixels, by size and then raster order."""
    left, out = {(y, x) for y, x in np.argwhere(mask).tolist()}, []
    while left:
        queue = [min(left)]
        left.discard(queue[0])
        for y, x in queue:
            near = {(y + dy, x + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if diagonal or not (dy and dx)} & left
            left -= near
            queue += sorted(near)
        out.append(sorted(queue))
    return sorted(out, key=lambda c: (-len(c), c))


def plain_smooth(image, sigma):
    r = max(1, ceil(4 * sigma))
    taps = [exp(-(d**2) / (2 * sigma**2)) for d in range(-r, r + 1)]
    mirror = lambda k: (k % 16) if k % 16 < 8 else 15 - k % 16
    out = np.zeros((8, 8))
    for y in range(8):
        for x in range(8):
            out[y, x] = sum(taps[dy + r] * taps[dx + r] * image[mirror(y + dy), mirror(x + dx)] for dy in range(-r, r + 1) for dx in range(-r, r + 1)) / sum(taps) ** 2
    return out


def plain_threshold(image):
    values, best = sorted(set(image.ravel().tolist())), None
    n = image.size
    for t in values[:-1]:
        low, high = image[image <= t], image[image > t]
        p0, p1, m0, m1 = len(low) / n, len(high) / n, low.mean(), high.mean()
        if m0 > 0:
            cost = round(image.mean() - p0 * (log(p0) + m0 * log(m0)) - p1 * (log(p1) + m1 * log(m1)), 6)
            best = min(best, (cost, t)) if best else (cost, t)
    return best[1] if best else values[-1]


def test_segment_query_against_a_plain_version(spark):
    rows = {r.vec_id: r for r in catalogue.QUERIES["k_segment"](spark, SF).collect()}
    kept = 0
    for i, image in images(spark).items():
        smooth = np.floor(plain_smooth(image, sqrt(2.0)) + 1e-9)
        mask = smooth >= plain_threshold(smooth)
        share = max(mask.mean(), 1 - mask.mean())
        want = np.zeros((8, 8), dtype=bool)
        if 0.9 <= share < 1:
            mask = ~mask if mask.mean() > 0.5 else mask
            for c in plain_components(mask):
                if 2 <= len(c) < 40:
                    want[tuple(np.array(c).T)] = True
        kept += want.any()
        assert np.array_equal(np.array(rows[i].mask).reshape(8, 8), want)
        assert all(want[s.y, s.x] for s in rows[i].seeds)
    assert kept > 5


def test_walk_query_against_a_plain_version(spark):
    got = {}
    for r in sorted(catalogue.QUERIES["k_walk_ends"](spark, SF).collect(), key=lambda r: (r.vec_id, r.n)):
        got.setdefault(r.vec_id, []).append((r.y, r.x))
    for i, image in images(spark).items():
        mask, seen, level, ends = image >= 1000, {(3, 3)}, [(3, 3)], []
        if not mask[3, 3]:
            assert i not in got
            continue
        for step in range(6):  # one ring after the other, each in the order of the one before
            new = []
            for y, x in level:
                own = [(y + dy, x + dx) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if 0 <= y + dy < 8 and 0 <= x + dx < 8 and step < 5]
                own = [p for p in own if mask[p] and p not in seen]
                seen.update(own)
                new += own
                if not own:
                    ends.append((y, x))
            level = new
        assert got[i] == ends


def test_split_queries_against_plain_versions(spark):
    two, spectral = {}, {}
    for name, out in (("k_split_in_two", two), ("k_spectral", spectral)):
        for r in catalogue.QUERIES[name](spark, SF).collect():
            out.setdefault(r.vec_id, []).append(r.size)
    for i, image in images(spark).items():
        mask = image >= 1000
        assert sum(two[i]) == mask.sum() and len(two[i]) == 2 and min(two[i]) > 0
        parts = [len(c) for c in plain_components(mask)]
        if mask.sum() >= 10 and len(parts) == 2:  # a graph of two parts falls apart into these
            own = sorted(len(plain_components_of_part) for plain_components_of_part in (max((c for c in plain_components(sub, diagonal=False)), key=len) for sub in masks_of(mask)))
            assert sorted(spectral[i]) == own
        assert sum(spectral.get(i, [])) <= mask.sum()


def masks_of(mask):
    """A mask for each of its components."""
    for c in plain_components(mask):
        own = np.zeros_like(mask)
        own[tuple(np.array(c).T)] = True
        yield own


def test_gated_cost(spark):
    one = {"cx": 10.0, "cy": 10.0, "cz": 1.0, "mean": 50.0, "n": 100.0, "x0": 5, "x1": 14, "y0": 5, "y1": 14, "z0": 0, "z1": 2}
    near = one | {"cx": 12.0, "mean": 60.0, "x0": 7, "x1": 16}
    for other, overlap in ((near, True), (near, False), (one | {"cx": 60.0, "x0": 55, "x1": 64}, True), (one | {"cz": 8.0, "z0": 7, "z1": 9}, True)):
        row = spark.createDataFrame([{**one, **{f"{k}_2": v for k, v in other.items()}}]).select(tracking.gated_cost("xyz", overlap)).first()[0]
        away = sqrt(sum(((one[f"c{a}"] - other[f"c{a}"]) * s) ** 2 for a, s in (("x", 0.357), ("y", 0.357), ("z", 2.0))))
        sides = [min(one[f"{a}1"], other[f"{a}1"]) - max(one[f"{a}0"], other[f"{a}0"]) for a in "xyz"]
        volumes = [prod(o[f"{a}1"] - o[f"{a}0"] + 1 for a in "xyz") for o in (one, other)]
        shared = prod(sides) / (0.5 * sum(volumes)) if overlap and min(sides) > 0 else 0.0
        gap = away**2 / 200 + (one["mean"] - other["mean"]) ** 2 / 200 + (one["n"] - other["n"]) ** 2 / 200_000
        assert row == (1e10 if away > 12 else pytest.approx((1 - shared) * (1 - exp(-gap))))


def test_files_of_the_same_name_stay_apart(spark, tmp_path):
    from lapsegrid.plans.experiment import Config, Experiment
    from lapsegrid.sources import tiff

    for k, folder in enumerate(("one", "two")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "run_s001t00c1_ORG.tif").write_bytes(tiff.stack([np.full((4, 5), 100 + k)]))
    run = Experiment(spark, str(tmp_path), Config({"bright": "c1_ORG"}, [np.ones((3, 3))]))
    assert sorted(set(r.px).pop() for r in run.frames().collect()) == [100, 101]
    plan = run.frames()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") <= 2  # once for the sums, once for the pixels, unless a table cuts the lineage


def test_seeds_of_the_first_frames_only(spark):
    rng = np.random.default_rng(0)
    y, x = np.mgrid[:64, :64]
    image = (rng.poisson(20, (64, 64)) + 400 * (((y - 30) ** 2 + (x - 30) ** 2) < 64)).astype(int)
    rows = spark.createDataFrame([(k, 64, image.ravel().tolist()) for k in range(4)], "frame int, width int, px array<int>")
    found = segment.segment_frames(rows, ["frame"], "frame int", segment.Settings(least=20, window=3, least_radius=5, most_radius=9, seed_frames=2)).orderBy("frame").collect()
    assert [len(r.seeds) for r in found] == [1, 1, 0, 0] and all(sum(r.mask) > 100 for r in found)


def test_parameter_files_are_read_whole_or_not_at_all(spark, tmp_path):
    (tmp_path / "p.txt").write_text("".join(f"k{i} {i}\n" for i in range(3000)))
    assert len(manifest.read_options(spark, str(tmp_path / "p.txt"))) == 3000
    (tmp_path / "big.txt").write_text("k 1\n" * (manifest.MOST_LINES + 1))
    with pytest.raises(ValueError):
        manifest.read_options(spark, str(tmp_path / "big.txt"))


def test_kernels_of_large_frames_equal_plain_ones():
    rng = np.random.default_rng(2)
    image = rng.integers(0, 100, (40, 50)).astype(float)
    taps = K._taps(5.0)  # more taps than are added up shift by shift
    r = len(taps) // 2
    wide = np.pad(image, ((r, r), (0, 0)), mode="symmetric")
    assert np.allclose(K._along(image, taps, 0), sum(t * wide[k : k + 40] for k, t in enumerate(taps)))
    mask = rng.random((30, 40)) < 0.9
    off = np.argwhere(~mask)
    want = np.array([[np.sqrt(((off - (y, x)) ** 2).sum(axis=1).min()) if mask[y, x] else 0.0 for x in range(40)] for y in range(30)])
    assert np.allclose(K.inside_distance(mask), want)
    assert np.array_equal(K.sliding_max(image, 2), [[image[max(0, y - 2) : y + 3, max(0, x - 2) : x + 3].max() for x in range(50)] for y in range(40)])
    y, x = np.mgrid[:70, :90]
    discs = (((y - 30) ** 2 + (x - 25) ** 2) < 400) | (((y - 34) ** 2 + (x - 60) ** 2) < 380)
    near, weight, at = K.pixel_graph(discs)
    assert len(at) > K.DENSE
    label = K.spectral_split(discs, 2)
    assert (label[(x < 38) & discs] == label[30, 25]).mean() > 0.97 and (label[(x > 48) & discs] == label[34, 60]).mean() > 0.97 and label[30, 25] != label[34, 60]
