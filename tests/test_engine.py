"""Kernels and operators on inputs with known answers, and every registered query against its oracle."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lapsegrid.functions import kernels as K
from lapsegrid.functions import pixels as P
from lapsegrid.operators import features, histogram, segment, tables, tracking, wells
from lapsegrid.plans import catalogue
from lapsegrid.sources import manifest, tiff

SF = "/root/testdata/sf0.001"


def rows(frame, *order):
    return [tuple(r) for r in (frame.orderBy(*order) if order else frame).collect()]


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_matches_its_oracle(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    got, want = catalogue.QUERIES[name](spark, SF).toPandas(), con.sql(catalogue.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)

    def shape(df):
        df = df[sorted(df.columns)].sort_values(sorted(df.columns)).reset_index(drop=True)
        return df.astype({c: "float64" for c in df.columns if pd.api.types.is_numeric_dtype(df[c])})

    pd.testing.assert_frame_equal(shape(got), shape(want), check_dtype=False, rtol=1e-9, atol=2e-6)


@pytest.mark.parametrize("name", [n for n in catalogue.QUERIES if n not in catalogue.ORACLES])
def test_kernel_queries_run(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


# -- sources --------------------------------------------------------------
def test_manifest(spark):
    names = spark.createDataFrame([("20140425X_s003t07c3_ORG.tif",), ("calcium_s003t07c3_ORG.tif",), ("x_s004t01c9_ORG.tif",), ("20140425X_s003t07c3_ORG.png",)], "name string")
    channels = spark.createDataFrame([("death", "c3_ORG"), ("none", "")], "role string, token string")
    assert rows(manifest.zeiss(names, channels).select("block", "role", "frame", "name"), "name") == [
        (3, "death", 7, "20140425X_s003t07c3_ORG.tif"), (3, "death", 0, "calcium_s003t07c3_ORG.tif")
    ]
    names = spark.createDataFrame([("e012_w2FITC_t003.TIF",), ("exp_w2FITC_t003.TIF",)], "name string")
    channels = spark.createDataFrame([("eff", "FITC")], "role string, token string")
    assert [r.frame for r in manifest.leica(names, channels).collect()] == [12]
    assert rows(spark.range(1).select(manifest.padded_block(F.lit(7), 3), manifest.padded_block(F.lit(12), 2))) == [("007", "12")]


def test_parameter_files(spark, tmp_path):
    (tmp_path / "p.txt").write_text("K 3\nminVolume 200\nclusterXY 7\nnum_time_seeds 999\nmaxVolume 300\n")
    s = segment.Settings.read(manifest.read_options(spark, str(tmp_path / "p.txt")))
    assert (s.least, s.most, s.window, s.seed_frames, s.least_radius) == (200, 300, 7, 999, 15)
    (tmp_path / "m.txt").write_text("1 0\n0.241 0.970\n")
    assert manifest.read_mixing_matrix(spark, str(tmp_path / "m.txt")) == (1.0, 0.0, 0.241, 0.97)
    tables.write_tab(spark.createDataFrame([(1, 2.5)], "a int, b double"), str(tmp_path / "t"))
    assert rows(manifest.read_tab(spark, str(tmp_path / "t"), "a int, b double")) == [(1, 2.5)]


def test_tiff_round_trip(spark, tmp_path):
    rnd = np.random.default_rng(1)
    images = [rnd.integers(0, 65536, (5, 7)) for _ in range(3)]
    (tmp_path / "B001CH0.tif").write_bytes(tiff.stack(images))
    (tmp_path / "B001CH1.tif").write_bytes(tiff.stack([i % 256 for i in images], 8))
    got = tiff.read_frames(spark, str(tmp_path))
    assert got.count() == 6 and tiff.read_frames(spark, str(tmp_path), first=2).count() == 4
    own = got.where("path like '%CH0.tif'").orderBy("frame").collect()
    assert [np.array_equal(np.array(r.px).reshape(5, 7), i) for r, i in zip(own, images, strict=True)] == [True] * 3
    again = tiff.stacks(got.where("path like '%CH0.tif'"), ["path"]).first().content
    assert bytes(again) == tiff.stack(images)
    assert manifest.list_frames(spark, str(tmp_path)).count() == 2


def test_manifest_sink(spark, tmp_path):
    rows_ = spark.createDataFrame([(1, "a", 0, "x.tif"), (1, "a", 1, "y.tif"), (2, "b", 0, "z.tif")], "block int, role string, frame int, name string")
    manifest.write_manifest(rows_, str(tmp_path / "m"))
    assert rows(manifest.read_tab(spark, str(tmp_path / "m" / "block=1" / "role=a"), "frame int, name string"), "frame") == [(0, "x.tif"), (1, "y.tif")]


# -- pixels and histograms ------------------------------------------------
def test_unmixing(spark):
    inverse = P.inverse_mixing(1, 0, 0.241, 0.970)
    assert np.allclose(inverse, [1.028631, 0, -0.241, 1], atol=1e-6)
    frame = spark.createDataFrame([(1000, 500), (1000, 100), (0, 300)], "a int, b int")
    assert [tuple(r) for r in frame.select(*P.unmix(F.col("a"), F.col("b"), inverse)).collect()] == [(1028, 259), (1028, 0), (0, 300)]
    assert [tuple(r) for r in frame.select(*P.unmix(F.col("a"), F.col("b"), P.inverse_mixing(1, 0, 0, 1, 0.0))).collect()] == [(1000, 500), (1000, 100), (0, 300)]


def test_grid_cells(spark):
    frame = spark.createDataFrame([(0, 0), (256, 255), (2047, 2047)], "x int, y int")
    assert [tuple(r) for r in frame.select(*P.grid_cell(F.col("x"), F.col("y"), 2048, 2048, 8)).collect()] == [(0, 0), (0, 1), (7, 7)]


def test_min_error_threshold(spark):
    values = [1] * 8 + [2] * 8 + [9] * 2 + [10] * 2
    frame = spark.createDataFrame([(0, v) for v in values] + [(1, 5)] * 4, "k int, i int")
    got = histogram.min_error_threshold(histogram.histogram(frame, ["k"], F.col("i")), ["k"])
    assert rows(got, "k") == [(0, 2, -1.16361), (1, 5, None)]
    assert segment.minimum_error(np.array(values)) == 2 and segment.minimum_error(np.full(4, 5)) == 5


def test_gate_and_foreground(spark):
    frame = spark.createDataFrame([(k, int(p < n)) for k, n in ((1, 89), (2, 95), (3, 100), (4, 5)) for p in range(100)], "k int, m int")
    assert [r.bad for r in histogram.background_gate(frame, ["k"], F.col("m")).orderBy("k").collect()] == [True, False, True, False]
    assert rows(histogram.foreground_choice(frame, ["k"], F.col("m")), "k")[1] == (2, 5, 100)
    assert rows(histogram.foreground_choice(frame, ["k"], F.col("m")), "k")[3] == (4, 5, 5)


# -- kernels --------------------------------------------------------------
def strips(*sizes):
    mask = np.zeros((2 * len(sizes), 12), dtype=bool)
    for k, n in enumerate(sizes):
        mask[2 * k, :n] = True
    return mask


@pytest.mark.parametrize(
    "sizes, least, most, exact, kept",
    [((9, 5, 4, 2, 1), 3, 0, False, 18), ((9, 5, 4, 2, 1), 0, 4, True, 7), ((9, 5, 4), 0, 4, True, 0), ((2, 1), 0, 4, True, 3), ((9, 5, 4, 2, 1), 0, 4, False, 3)],
)
def test_component_filters(sizes, least, most, exact, kept):
    mask = strips(*sizes)
    out = K.keep_components(mask, least, most, exact)
    assert out.sum() == kept and not (out & ~mask).any()
    assert np.array_equal(K.keep_components(out, least), out)


def test_components_by_flood_fill():
    rnd = np.random.default_rng(3)
    for connectivity in (4, 8):
        for _ in range(30):
            mask = rnd.random((9, 11)) < 0.55
            label = K.components(mask, connectivity)
            seen = np.zeros(mask.shape, dtype=int)
            for y, x in zip(*np.nonzero(mask), strict=True):
                if not seen[y, x]:
                    queue, name = [(y, x)], y * 11 + x + 1
                    while queue:
                        a, b = queue.pop()
                        if 0 <= a < 9 and 0 <= b < 11 and mask[a, b] and not seen[a, b]:
                            seen[a, b] = name
                            queue += [(a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1) if connectivity == 8 or not i * j]
            assert np.array_equal(label, seen)


def test_clean_labels_and_maxima():
    label = np.zeros((4, 4), dtype=int)
    label[0, :3] = 1
    label[1, 3] = label[2, 3] = 1
    assert (K.clean_labels(label) > 0).sum() == 3
    image = np.ones((5, 5))
    image[2, 2] = 7
    assert K.local_maxima(image, 1) == [(2, 2)]
    wide = np.ones((7, 7))
    wide[3, 3] = wide[3, 4] = 7
    assert K.local_maxima(wide, 1) == []


def test_background_and_distance():
    assert K.subtract_background(np.full((6, 9), 77), 3).sum() == 0
    mask = np.random.default_rng(0).random((12, 10)) < 0.8
    off = np.argwhere(~mask)
    want = np.array([[np.sqrt(((off - (y, x)) ** 2).sum(1).min()) if mask[y, x] else 0 for x in range(10)] for y in range(12)])
    assert np.allclose(K.inside_distance(mask), want)


def test_drift_and_crop():
    image = np.random.default_rng(2).random((32, 32))
    for dx, dy in ((3, -2), (-5, 4), (0, 0)):
        moved = np.roll(image, (dy, dx), (0, 1))
        assert K.drift(image, moved) == (-dx, -dy)
        assert np.array_equal(K.crop(moved, 16 + dx, 16 + dy, 9), K.crop(image, 16, 16, 9))
    assert K.crop(image, 0, 0, 3)[0].sum() == 0


def test_ncc_finds_patterns():
    rnd = np.random.default_rng(5)
    image, pattern = rnd.random((60, 60)) * 0.1, rnd.random((9, 9))
    for y, x in ((15, 15), (15, 44), (44, 15)):
        image[y - 4 : y + 5, x - 4 : x + 5] = pattern
    score = K.ncc(image, pattern)
    assert np.isclose(score[15, 44], 1.0, atol=1e-6) and score.max() <= 1 + 1e-6
    found = segment.find_wells(image, [pattern, pattern[::-1]], 15, 8)
    assert {(15, 15), (44, 15), (15, 44)} <= {(x, y) for x, y, t, s in found if s > 0.99 and t == 1}


def test_spectral_split_and_kmeans():
    mask = np.zeros((16, 30), dtype=bool)
    mask[3:12, 2:13] = mask[3:12, 16:27] = True
    mask[7, 13:16] = True
    label = K.spectral_split(mask, 2)
    assert len(np.unique(label[3:12, 2:12])) == 1 and len(np.unique(label[3:12, 17:27])) == 1 and label[5, 4] != label[5, 20]
    assert K.spectral_split(mask, 1).sum() == mask.sum() and not K.spectral_split(mask[:4, :4], 2).any()
    assert K.intensity_kmeans(np.array([1.0, 1, 2, 9, 10, 30]), 3).tolist() == [0, 0, 0, 1, 1, 2]
    assert K.level_response(mask * 5.0, mask, 3)[7, 7] > 0


def test_association_weights():
    want = {1: 1.549768, 2: 0.549768, 5: 0.126157, 10: 0.01}
    for d, w in want.items():
        mask, signal = np.zeros((3, 30), dtype=bool), np.zeros((3, 30))
        mask[1, 5], signal[1, 5 + d] = True, 4
        assert np.isclose(K.association(mask, signal), w, atol=1e-6)
    by_offset = {(dx, dy): w for dx, dy, w in features.ring_weights()}
    assert np.isclose(by_offset[1, 1], 0.549768, atol=1e-6) and (10, 3) not in by_offset


def test_assignment():
    cost = np.array([[12, 40, 90], [38, 15, 80]])
    weight = np.exp(-6 * (cost / cost.max()) ** 2)
    pairs = K.assign(weight)
    assert pairs == [(0, 0), (1, 1)] and np.isclose(sum(weight[p] for p in pairs), 1.745307, atol=1e-6)
    from itertools import permutations

    rnd = np.random.default_rng(7)
    for shape in ((4, 4), (3, 5), (5, 2)):
        w = rnd.random(shape)
        a = w if shape[0] <= shape[1] else w.T
        best = max(sum(a[i, p[i]] for i in range(a.shape[0])) for p in permutations(range(a.shape[1]), a.shape[0]))
        assert np.isclose(sum(w[p] for p in K.assign(w)), best)
    assert K.assign(np.zeros((0, 3))) == []


def test_segmentation_of_a_frame():
    y, x = np.mgrid[:60, :60]
    image = 10 + 200 * (((x - 30) ** 2 + (y - 28) ** 2) <= 36)
    mask, found = segment.segment(image.astype(np.int64), segment.Settings(least=20, window=3, least_radius=4, most_radius=7))
    assert 80 < mask.sum() < 200 and found == [(30, 28)]
    assert segment.segment(np.random.default_rng(0).integers(0, 2, (40, 40)) * 100)[1] == []


# -- wells, tracks and tables ---------------------------------------------
def test_seed_windows_are_strict(spark):
    s = spark.createDataFrame([(0, x, 200) for x in (85, 86, 314, 315)], "frame int, x int, y int")
    w = spark.createDataFrame([(0, 1, 200, 200)], "frame int, well int, cx int, cy int")
    assert [r.x for r in wells.seeds_in_windows(s, w, ["frame"], 115).orderBy("x").collect()] == [86, 314]


def test_cell_numbers(spark):
    counts = {1: (2, 2, 3, 3, 2, 0, 2, 9), 2: (1, 1, 2, 2, 3, 3, 0), 3: (0, 0, 0, 0, 1, 1, 1)}
    frame = spark.createDataFrame([(w, f, n) for w, own in counts.items() for f, n in enumerate(own)], "well int, frame int, n int")
    assert rows(wells.cell_number(frame, ["well"]), "well") == [(1, 2), (2, 1)]


def test_drift_path_and_best_point(spark):
    shifts = spark.createDataFrame([(0, 0, 0), (1, 1, -2), (2, 3, 0)], "frame int, dx int, dy int").withColumn("b", F.lit(1))
    assert [(100 - r.px, 50 - r.py) for r in wells.drift_path(shifts, ["b"], "frame").orderBy("frame").collect()] == [(100, 50), (99, 52), (96, 52)]
    points = spark.createDataFrame([(1, 0, 0, 0.91, 0, 0), (2, 1, 0, 0.97, 0, 0)], "id int, x int, y int, score double, row int, col int")
    assert [wells.best_per_cell(points, F.col("score"), exact).first().id for exact in (True, False)] == [1, 2]


def test_composition(spark):
    e = spark.createDataFrame([(1, 1), (2, 1), (3, 2)], "well int, k int")
    t = spark.createDataFrame([(1, 1), (2, 3), (3, 1), (4, 6), (5, 5)], "well int, k int")
    assert [(r.well, r.composition, r.routed) for r in wells.composition(e, t, "well").orderBy("well").collect()] == [(1, "E1T1", "E1T1"), (2, "E1T3", "E1T3"), (5, "E0T5", "Exp")]


def test_displacement(spark):
    points = spark.createDataFrame([(0, 10.0, 10.0), (1, 13.0, 14.0), (2, None, None), (3, 20.0, 20.0)], "f int, x double, y double").withColumn("k", F.lit(1))
    assert [r.displacement for r in tracking.displacement(points, ["k"], "f").orderBy("f").collect()] == [5, None, None, 0]
    far = spark.createDataFrame([(0, 260.0, 260.0), (1, 263.0, 264.0)], "f int, x double, y double").withColumn("k", F.lit(1))
    assert [r.displacement for r in tracking.displacement(far, ["k"], "f", 1000).orderBy("f").collect()] == [None, 0]
    assert tracking.displacement(far, ["k"], "f").orderBy("f").first().displacement == 5


def test_link_cost_and_motion(spark):
    pair = spark.createDataFrame([(0.0, 0.0, 3.0, 4.0, 10, 8, 4, 0.0)], "x double, y double, x2 double, y2 double, area int, area2 int, overlap int, away double")
    assert np.isclose(tracking.with_overlap_cost(tracking.with_cost(pair)).first().cost, 570)
    points = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 3.0, 4.0), (1, 3, 3.0, 4.0), (2, 0, 1.0, 1.0)], "k int, t int, x double, y double")
    assert rows(tracking.motion_summary(points, ["k"], "t")) == [(1, 3, 2.5, 5.0, 5.0, 1.0)]
    assert tracking.overlap_of(np.array([[0, 0], [0, 1]]), np.array([[0, 1]])) == (1, 0.0)
    assert tracking.overlap_of(np.array([[0, 0]]), np.array([[3, 4]])) == (0, 5.0)


def test_chains_and_unlinked(spark):
    cells = spark.createDataFrame([(1, 0, 1), (1, 0, 2), (1, 2, 1), (1, 3, 1)], "k int, frame int, cell int")
    links = spark.createDataFrame([(1, 0, 2, 2, 1), (1, 2, 1, 3, 1)], "k int, frame int, cell int, next_frame int, cell2 int")
    assert rows(tracking.chains(cells, links, ["k"]), "frame", "cell") == [(1, 0, 1, 1), (1, 0, 2, 2), (1, 2, 1, 2), (1, 3, 1, 2)]
    assert rows(tracking.unlinked(cells, links, ["k"]), "frame") == [(1, 0, 1), (1, 3, 1)]


def test_chains_go_by_cell_by_cell(spark):
    rng = np.random.default_rng(8)
    cells = [(k, f, c) for k in (1, 2, None) for f in range(0, 12, 2) for c in range(1, 1 + int(rng.integers(1, 6)))]
    links = [(k, f, c, f + 2, int(d)) for k in (1, 2, None) for f in range(0, 12, 2) for c, d in zip(range(1, 7), rng.permutation(7)[:5] + 1, strict=False)]
    want = []
    for k in (1, 2, None):
        before = {(f2, d): (f, c) for q, f, c, f2, d in links if q == k and k is not None}
        track = {}
        for at in sorted((f, c) for q, f, c in cells if q == k):
            track[at] = track[before[at]] if before.get(at) in track else max(track.values(), default=0) + 1
        want += [(k, *at, n) for at, n in track.items()]
    frames = spark.createDataFrame(cells, "k int, frame int, cell int"), spark.createDataFrame(links, "k int, frame int, cell int, next_frame int, cell2 int")
    found = tracking.chains(*frames, ["k"])
    assert "collect_list" not in found._jdf.queryExecution().toString()  # no well is one row
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(size)
    spark.conf.set(size, "3")
    try:
        assert {tuple(r) for r in found.collect()} == set(want)
        assert found.count() == len(want)
    finally:
        spark.conf.set(size, old)


def test_well_block_has_49_rows(spark):
    long = spark.createDataFrame([(1, "effector", 0, "x", 0, 5.0), (1, "target", 2, "assoc", 1, 0.5), (1, "bead", 1, "mean", 0, 9.0)], "well int, part string, target int, name string, frame int, value double")
    got = rows(tables.well_block(long, ["well"], [0, 1]), "line")
    assert len(got) == 49 and got[0][2:] == (5.0, -1000.0) and got[5][2:] == (-1.0, -1.0)
    assert got[6 + 16 + 6][2:] == (-1000.0, 0.5) and got[6 + 7][2] == -2.0 and got[47][2] == 9.0 and got[48][2:] == (1.0, 2.0)
