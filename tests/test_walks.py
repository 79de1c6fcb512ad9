"""Walks and nearest structures in three dimensions against plain searches."""

import numpy as np
import pytest

from lapsegrid.operators import walks
from lapsegrid.plans import stacks


def table(spark, volume, stack="s"):
    rows = [(stack, *map(int, p)) for p in np.argwhere(volume)]
    return spark.createDataFrame(rows, "stack string, z int, y int, x int")


def plain_walk(volume, start, steps):
    """Step at which each voxel is first reached, ring by ring."""
    if not volume[start]:
        return {}
    out, ring = {start: 0}, [start]
    for step in range(1, steps + 1):
        new = []
        for p in ring:
            for d in np.ndindex(3, 3, 3):
                q = tuple(int(a + b - 1) for a, b in zip(p, d, strict=True))
                if all(0 <= a < n for a, n in zip(q, volume.shape, strict=True)) and volume[q] and q not in out:
                    out[q] = step
                    new.append(q)
        ring = new
    return out


def test_walks_and_their_ends(spark):
    volume = np.random.default_rng(3).random((7, 9, 8)) < 0.15
    starts = [tuple(map(int, p)) for p in np.argwhere(volume)[::12]] + [tuple(map(int, np.argwhere(~volume)[0]))]
    frame = spark.createDataFrame([("s", k, *p) for k, p in enumerate(starts)], "stack string, walk int, z int, y int, x int")
    reached = walks.walks(table(spark, volume), frame, ["stack"], 3)
    own = {(r.walk, r.z, r.y, r.x): r.step for r in reached.collect()}
    want = {(k, *p): s for k, at in enumerate(starts) for p, s in plain_walk(volume, at, 3).items()}
    assert own == want
    near = lambda p, q: p[0] == q[0] and max(abs(a - b) for a, b in zip(p[1:], q[1:], strict=True)) <= 1
    ends = {p for p, s in want.items() if s == 3 or not any(near(p, q) and t == s + 1 for q, t in want.items())}
    found = walks.ends(reached, ["stack"], 3).collect()
    assert {(r.walk, r.z, r.y, r.x) for r in found} == ends
    assert all((r.z - r.dz, r.y - r.dy, r.x - r.dx) == starts[r.walk] for r in found)


def test_no_step_of_a_walk_is_sent_to_the_driver(spark, monkeypatch):
    plans, kept = [], walks.kept_as
    monkeypatch.setattr(walks, "kept_as", lambda f, name: plans.append(f._jdf.queryExecution().executedPlan().toString()) or kept(f, name))
    volume = np.random.default_rng(3).random((5, 6, 6)) < 0.3
    starts = spark.createDataFrame([("s", 1, *map(int, np.argwhere(volume)[0]))], "stack string, walk int, z int, y int, x int")
    found = walks.ends(walks.walks(table(spark, volume), starts, ["stack"], 3), ["stack"], 3)
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 3 and not any("Broadcast" in p for p in plans)


def test_frame_numbers_of_a_walk_are_not_sent_to_the_driver(spark, monkeypatch):
    plans, kept = [], walks.kept_as
    monkeypatch.setattr(walks, "kept_as", lambda f, name: plans.append(f._jdf.queryExecution().executedPlan().toString()) or kept(f, name))
    found = stacks.q_volume_walks(spark, "/root/testdata/sf0.001")
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 3 and not any("Broadcast" in p for p in plans)


def test_no_structure_is_sent_to_the_driver(spark, monkeypatch):
    plans, kept = [], walks.kept_as
    monkeypatch.setattr(walks, "kept_as", lambda f, name: plans.append((name, f._jdf.queryExecution().executedPlan().toString())) or kept(f, name))
    volume = np.random.default_rng(4).random((5, 40, 40)) < 0.001
    points = spark.createDataFrame([("s", 1, 0.0, 0.0, 0.0), ("s", 2, 4.0, 20.0, 20.0), ("s", 3, 60.0, 0.0, 0.0)], "stack string, k int, z double, y double, x double")
    assert walks.nearest(points, table(spark, volume), ["stack"], "k").count() == 3
    found = [p for name, p in plans if name == "nearest"]
    again = [p for name, p in plans if name == "points"][1:]  # the first only asks which stacks there are
    assert len(found) > 1 and again and not any("Broadcast" in p for p in found + again)


@pytest.mark.parametrize("share", [0.3, 0.002])
def test_nearest_of_near_and_far_structures(spark, share):
    rng = np.random.default_rng(4)
    volume = rng.random((12, 40, 30)) < share
    volume[5, 3, 3] = True
    spacing = (2.0, 0.5, 1.0)
    points = [("s", k, *map(float, p), 0.0, 1.0, 1.0) for k, p in enumerate(rng.random((40, 3)) * volume.shape)] + [("s", 99, 500.0, -300.0, 5.0, 0.0, 0.0, 0.0), ("none", 1, 1.0, 1.0, 1.0, 0.0, 0.0, 1.0)]
    frame = spark.createDataFrame(points, "stack string, k int, z double, y double, x double, az double, ay double, ax double")
    found = {r.k: r for r in walks.nearest(frame, table(spark, volume), ["stack"], "k", spacing, ["az", "ay", "ax"]).collect()}
    assert len(found) == 41
    at = np.argwhere(volume)
    for _, k, *p, az, ay, ax in points[:-1]:
        way = (at - np.array(p)) * spacing
        away = np.round(np.sqrt((way**2).sum(1)), 9)
        best = int(np.lexsort((at[:, 2], at[:, 1], at[:, 0], away))[0])
        r = found[k]
        assert (r.z, r.y, r.x) == tuple(at[best]) and r.away == pytest.approx(away[best])
        size = np.sqrt(az * az + ay * ay + ax * ax) * away[best]
        angle = np.degrees(np.arccos(min(1.0, abs(way[best] @ np.array([az, ay, ax])) / size))) if size else 0.0
        assert r.angle == pytest.approx(angle, abs=1e-5)


def test_empty_structures(spark):
    none = spark.createDataFrame([], "stack string, z int, y int, x int")
    points = spark.createDataFrame([("s", 1, 1.0, 2.0, 3.0)], "stack string, k int, z double, y double, x double")
    assert walks.nearest(points, none, ["stack"], "k").count() == 0
    starts = spark.createDataFrame([("s", 1, 1, 2, 3)], "stack string, walk int, z int, y int, x int")
    assert walks.walks(none, starts, ["stack"], 3).count() == 0
