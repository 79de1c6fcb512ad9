"""Queries of filters, labels, registration and projections whose SQL is built from weights: a separable
filter over an 8 x 8 frame is two joins with a table of weights from each row or column to each."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from lapsegrid.functions import kernels as K
from lapsegrid.functions import pixels as P
from lapsegrid.operators import features, segment, stack, tiles, volume
from lapsegrid.plans.catalogue import _INV, EIGHT, ORACLES, PAIRS, QUERIES, TH, _ball_sql, _flat, _image_rows, _stack, pair_frames, query, unmixed
from lapsegrid.sources.views import FRAME, PX, frames

DOUBLES = "vec_id long, px array<double>"


def _weights(taps) -> list[tuple[int, int, float]]:
    """(to, from, weight) of a filter along eight pixels with mirrored borders."""
    r, total = len(taps) // 2, {}
    for t in range(8):
        for d in range(-r, r + 1):
            m = (t + d) % 16
            key = t, (15 - m if m > 7 else m)
            total[key] = total.get(key, 0.0) + float(taps[d + r])
    return [(t, s, w) for (t, s), w in sorted(total.items())]


def _values(name: str, rows: list[tuple]) -> str:
    return f"{name} AS (SELECT * FROM (VALUES {', '.join('(' + ', '.join(f'{v!r}::double' if isinstance(v, float) else str(v) for v in r) + ')' for r in rows)}) AS v(t, s, w))"


def _gaussian_sql(source: str, sigma: float, value: str = "i") -> str:
    """CTEs that end in g2(vec_id, x, y, g), the smoothed ``source``."""
    return f"""{_values('gw', _weights(K._taps(sigma)))}, g1 AS (SELECT vec_id, t AS x, y, sum({value} * w) AS v FROM {source} JOIN gw ON s = x GROUP BY ALL),
g2 AS (SELECT vec_id, x, t AS y, sum(v * w) AS g FROM g1 JOIN gw ON s = y GROUP BY ALL)"""


# -- smoothing and registration --------------------------------------------
@query(f"WITH {PX}, {_gaussian_sql('px', 1.0)} SELECT vec_id, cast(x + 8 * y AS integer) AS pos, round(g, 6) AS g FROM g2")
def q_smoothed(spark, sf):
    """The Gaussian before a threshold; the parameter file gives its variance (MAP13)."""
    rows = _image_rows(spark, sf, lambda k, im: [(*k, K.gaussian(im, float(np.sqrt(1.0))).ravel())], DOUBLES)
    return rows.select("vec_id", F.posexplode("px").alias("pos", "g")).withColumn("g", F.round("g", 6))


ORACLES["k_gaussian_bg"] = f"WITH {PX}, {_gaussian_sql('px', 2.0)} SELECT vec_id, cast(sum(floor(greatest(i - g, 0.0) + 1e-9)) AS bigint) AS total FROM px JOIN g2 USING (vec_id, x, y) GROUP BY vec_id"


@query(f"""WITH {PAIRS}, um AS (SELECT vec_id, x, y, floor(greatest(0.0, i1 * {_INV[0]!r}::double + i2 * {_INV[1]!r}::double)) AS o1 FROM pr), {_gaussian_sql('um', 2.0, 'o1')}
SELECT vec_id, cast(sum(floor(greatest(o1 - g, 0.0) + 1e-9)) AS bigint) AS total FROM um JOIN g2 USING (vec_id, x, y) GROUP BY vec_id""")
def q_unmixed_background(spark, sf):
    """Unmixing, then background subtraction, in one plan; frames stay arrays (LG58)."""
    made = unmixed(spark, sf).where(F.col("channel") == "c0").select((F.col("block") * 2).cast("long").alias("vec_id"), "px")
    return segment.each_frame(made, ["vec_id"], lambda k, im: [(*k, int(K.subtract_background(im, 2.0).sum()))], "vec_id long, total long", 8)


@query(f"""WITH {PX}, w AS (SELECT cast(p % 8 AS integer) AS u, cast(p // 8 AS integer) AS v FROM unnest(range(40)) AS t(p)),
s AS (SELECT px.vec_id, w.v AS u, w.u AS v, sum(i * cos(2 * pi() * (w.u * y + w.v * x) / 8)) AS re, sum(i * sin(2 * pi() * (w.u * y + w.v * x) / 8)) AS im FROM px, w GROUP BY ALL)
SELECT vec_id, v AS row, u AS col, round(sqrt(re * re + im * im), 4) AS amplitude FROM s""")
def q_spectrum(spark, sf):
    """The amplitudes of a frame's transform, by row and column of the half plane that real frames need (MAP12)."""

    def run(k, im):
        size = np.abs(np.fft.rfft2(im))
        return [(*k, r, c, float(size[r, c])) for r in range(8) for c in range(5)]

    return _image_rows(spark, sf, run, "vec_id long, row int, col int, amplitude double").withColumn("amplitude", F.round("amplitude", 4))


@query(f"WITH {PX} SELECT vec_id, pos, i FROM px")
def q_fourier(spark, sf):
    """Forward and inverse transform of a frame give it back (MAP12)."""
    return _flat(_image_rows(spark, sf, lambda k, im: [(*k, np.round(np.fft.irfft2(np.fft.rfft2(im), im.shape)).ravel())], DOUBLES), "i", "vec_id")


@query(f"WITH {PX} SELECT a.vec_id, cast(p AS integer) AS pos, b.i FROM (SELECT DISTINCT vec_id FROM px) a, unnest(range(132)) AS t(p) JOIN px b ON b.vec_id = a.vec_id AND b.x = least(greatest(p % 11 - 1, 0), 7) AND b.y = least(greatest(p // 11 - 2, 0), 7)")
def q_edge_pad(spark, sf):
    """Padding that repeats the edge: one column before and two after, two rows before and two after (MAP9)."""
    pad = lambda im: np.pad(im, ((2, 2), (1, 2)), mode="edge").astype(np.float64)
    return _flat(_image_rows(spark, sf, lambda k, im: [(*k, pad(im).ravel())], DOUBLES), "i", "vec_id")


@query(f"""WITH {PX}, z AS (SELECT vec_id, x, y, round((i - avg(i) OVER w) / nullif(stddev_samp(i) OVER w, 0), 6) AS z FROM px WINDOW w AS (PARTITION BY vec_id))
SELECT a.vec_id, cast(p AS integer) AS pos, coalesce(z.z, 0.0) AS z FROM (SELECT DISTINCT vec_id FROM px) a, unnest(range(100)) AS t(p) LEFT JOIN z ON z.vec_id = a.vec_id AND z.x = p % 10 - 1 AND z.y = p // 10 - 1""")
def q_zscore_pad(spark, sf):
    """Standardised frames with a border of zeros (LG55)."""
    rows = frames(spark, sf).select("vec_id", stack.standardised("px").alias("px"))
    return rows.select("vec_id", F.posexplode(P.padded(F.col("px"), 8, 8, 1, 1)).alias("pos", "z")).select("vec_id", "pos", F.round(F.coalesce("z", F.lit(0.0)), 6).alias("z"))


ORACLES["k_crop"] = f"""WITH {PX}, c AS (SELECT vec_id, sum(i) AS total, sum(CASE WHEN i > 0 THEN 1 ELSE 0 END) AS n FROM px WHERE abs(x - (3 + vec_id % 3)) <= 2 AND y BETWEEN 2 AND 6 GROUP BY vec_id)
SELECT vec_id, cast(total AS bigint) AS total, cast(n AS integer) AS n_px FROM c WHERE n > 0"""

ORACLES["k_drift"] = f"""WITH {PX}, pr AS (SELECT vec_id, lag(vec_id) OVER (PARTITION BY label ORDER BY vec_id) AS before FROM embeddings),
m AS (SELECT p.vec_id, d.dx, d.dy, sum(b.i * a.i) AS v FROM pr p JOIN px b ON b.vec_id = p.before, (SELECT p % 8 AS dx, p // 8 AS dy FROM unnest(range(64)) AS t(p)) d
 JOIN px a ON a.vec_id = p.vec_id AND a.x = (b.x + d.dx) % 8 AND a.y = (b.y + d.dy) % 8 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, dy, dx) AS k FROM m)
SELECT vec_id, cast(-(CASE WHEN dx <= 4 THEN dx ELSE dx - 8 END) AS integer) AS dx, cast(-(CASE WHEN dy <= 4 THEN dy ELSE dy - 8 END) AS integer) AS dy FROM r WHERE k = 1"""

PATTERN = [(dy, dx, (1, 2, 1)[dy + 1] * (1, 2, 1)[dx + 1]) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
_SPREAD = float(np.sqrt(sum((w - 16 / 9) ** 2 for _, _, w in PATTERN)))


def _wells_sql(source: str) -> str:
    """CTEs that end in fw(vec_id, x, y, type, score): the better of two pattern correlations, and its maxima."""
    return f"""{_values('pt', PATTERN)},
c AS (SELECT a.vec_id, a.x, a.y, sum(b.i * pt.w) AS product, sum(b.i) AS s1, sum(cast(b.i AS double) * b.i) AS s2 FROM {source} a, pt JOIN {source} b ON b.vec_id = a.vec_id AND b.x = a.x + pt.s AND b.y = a.y + pt.t GROUP BY ALL),
n AS (SELECT vec_id, x, y, (product - s1 * 16 / 9.0) / (2 * {_SPREAD!r}::double * greatest(sqrt(greatest(s2 - s1 * s1 / 9.0, 0)), {_SPREAD!r}::double / 1e5)) AS h FROM c),
b AS (SELECT vec_id, x, y, CASE WHEN h > -h THEN 1 ELSE 2 END AS type, 0.5 + abs(h) AS score FROM n WHERE x BETWEEN 1 AND 6 AND y BETWEEN 1 AND 6),
fw AS (SELECT b.vec_id, b.x, b.y, b.type, round(b.score, 6) AS score FROM b JOIN b o ON o.vec_id = b.vec_id AND abs(o.x - b.x) <= 1 AND abs(o.y - b.y) <= 1 GROUP BY b.vec_id, b.x, b.y, b.type, b.score HAVING max(o.score) <= b.score)"""


ORACLES["k_ncc"] = f"WITH {PX}, {_wells_sql('px')} SELECT * FROM fw"


@query(f"""WITH {PX}, {_gaussian_sql('px', 1.0)}, sb AS (SELECT vec_id, px.x, px.y, greatest(px.i - g2.g, 0.0) AS i FROM px JOIN g2 USING (vec_id, x, y)), {_wells_sql('sb')},
r AS (SELECT *, y // 4 AS row, x // 4 AS col, row_number() OVER (PARTITION BY vec_id, y // 4, x // 4 ORDER BY score DESC, y, x) AS k FROM fw)
SELECT vec_id, cast(row AS integer) AS row, cast(col AS integer) AS col, x, y, type, score FROM r WHERE k = 1""")
def q_registered_wells(spark, sf):
    """Background subtracted without truncation, two patterns compared, the best maximum of each grid cell (MAP3, KR8, KR10, AG10)."""
    pattern = np.array([[1, 2, 1], [2, 4, 2], [1, 2, 1]], dtype=float)
    bright = frames(spark, sf).select(F.col("vec_id").cast("int").alias("block"), F.lit(0).alias("frame"), F.lit(8).alias("width"), "px")
    found = stack.register_wells(bright, [pattern, -pattern], 2, 3, 1, sigma=1.0)
    return found.select(F.col("block").cast("long").alias("vec_id"), "row", "col", "x", "y", "type", F.round("score", 6).alias("score"))


# -- seeds ----------------------------------------------------------------
def _log_taps(sigma: float) -> np.ndarray:
    taps = K._taps(sigma)
    x = np.arange(len(taps)) - len(taps) // 2
    second = taps * (x**2 / sigma**4 - 1 / sigma**2)
    return second - second.mean()


def _log_sql() -> str:
    """sr(vec_id, x, y, v): seed response of the frames for radii 2 and 3 with the mask of bright pixels."""
    parts, names = [], []
    for r in (2, 3):
        sigma = r / np.sqrt(2)
        parts += [_values(f"a{r}", _weights(K._taps(sigma))), _values(f"b{r}", _weights(_log_taps(sigma)))]
        parts.append(f"h{r} AS (SELECT vec_id, a.t AS x, y, sum(i * a.w) AS va, sum(i * b.w) AS vb FROM px JOIN a{r} a ON a.s = px.x JOIN b{r} b ON b.s = px.x AND b.t = a.t GROUP BY ALL)")
        parts.append(f"l{r} AS (SELECT vec_id, x, a.t AS y, {-float(sigma**2)!r}::double * sum(vb * a.w + va * b.w) AS v FROM h{r} h JOIN a{r} a ON a.s = h.y JOIN b{r} b ON b.s = h.y AND b.t = a.t GROUP BY ALL)")
        names.append(f"l{r}.v")
    parts.append("ds AS (SELECT f.vec_id, f.x, f.y, coalesce(min(sqrt((f.x - b.x) * (f.x - b.x) + (f.y - b.y) * (f.y - b.y))), 16.0) AS d FROM px f LEFT JOIN px b ON b.vec_id = f.vec_id AND b.i < 1000 WHERE f.i >= 1000 GROUP BY ALL)")
    parts.append(f"sr AS (SELECT px.vec_id, px.x, px.y, CASE WHEN px.i >= 1000 THEN greatest(0.0, {', '.join(names)}) * d ELSE 0.0 END AS v FROM px JOIN l2 USING (vec_id, x, y) JOIN l3 USING (vec_id, x, y) LEFT JOIN ds USING (vec_id, x, y))")
    return ", ".join(parts)


_LOG = _log_sql()


#: Largest seed response of each frame, and how many seeds it has (KR4, WN8).
ORACLES["k_log_seed"] = f"""WITH {PX}, {_LOG}, lm AS (SELECT a.vec_id, a.x, a.y FROM sr a JOIN sr b ON b.vec_id = a.vec_id AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND (a.x <> b.x OR a.y <> b.y)
 WHERE a.x BETWEEN 2 AND 5 AND a.y BETWEEN 2 AND 5 AND a.v > 0 GROUP BY a.vec_id, a.x, a.y, a.v HAVING max(b.v) < a.v)
SELECT p.vec_id, round(p.peak, 6) AS peak, cast(coalesce(n, 0) AS integer) AS n_seeds FROM (SELECT vec_id, max(v) AS peak FROM sr GROUP BY vec_id) p LEFT JOIN (SELECT vec_id, count(*) AS n FROM lm GROUP BY vec_id) USING (vec_id)"""


@query(f"WITH {PX} SELECT f.vec_id, f.pos, round(coalesce(min(sqrt((f.x - b.x) * (f.x - b.x) + (f.y - b.y) * (f.y - b.y))), 16.0), 6) AS d FROM px f LEFT JOIN px b ON b.vec_id = f.vec_id AND b.i < 1000 WHERE f.i >= 1000 GROUP BY f.vec_id, f.pos")
def q_inside_distance(spark, sf):
    """Distance of each bright pixel to the nearest dark one (LG19)."""
    rows = _image_rows(spark, sf, lambda k, im: [(*k, K.inside_distance(im >= TH).ravel())], DOUBLES)
    return rows.select("vec_id", F.posexplode("px").alias("pos", "d")).where("d > 0").withColumn("d", F.round("d", 6))


# -- the segmentation of a frame --------------------------------------------
@query(f"""WITH RECURSIVE {PX}, {_gaussian_sql('px', float(np.sqrt(2.0)))}, sm AS MATERIALIZED (SELECT vec_id, x, y, cast(x + 8 * y AS integer) AS pos, cast(floor(g + 1e-9) AS integer) AS i FROM g2),
h AS (SELECT vec_id, i AS bin, count(*) AS n FROM sm GROUP BY ALL),
w AS (SELECT vec_id, bin, sum(n) OVER o AS c, sum(n * bin) OVER o AS s, sum(n) OVER (PARTITION BY vec_id) AS ca, sum(n * bin) OVER (PARTITION BY vec_id) AS sa FROM h WINDOW o AS (PARTITION BY vec_id ORDER BY bin ROWS UNBOUNDED PRECEDING)),
r AS (SELECT vec_id, bin, c / ca AS p0, (ca - c) / ca AS p1, sa / ca AS mu, s / nullif(c, 0) AS m0, (sa - s) / nullif(ca - c, 0) AS m1 FROM w),
q AS (SELECT vec_id, bin, CASE WHEN p0 > 0 AND p1 > 0 AND m0 > 0 AND m1 > 0 THEN round(mu - p0 * (ln(p0) + m0 * ln(m0)) - p1 * (ln(p1) + m1 * ln(m1)), 6) END AS cost FROM r),
th AS (SELECT vec_id, bin AS th FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY cost NULLS LAST, CASE WHEN cost IS NULL THEN -bin ELSE bin END) AS k FROM q) WHERE k = 1),
sh AS (SELECT vec_id, avg(CASE WHEN i >= th THEN 1.0 ELSE 0.0 END) AS share FROM sm JOIN th USING (vec_id) GROUP BY vec_id),
m AS MATERIALIZED (SELECT vec_id, pos, x, y FROM sm JOIN th USING (vec_id) JOIN sh USING (vec_id) WHERE greatest(share, 1 - share) >= 0.9 AND greatest(share, 1 - share) < 1 AND (i >= th) = (share <= 0.5)),
e AS MATERIALIZED (SELECT a.vec_id, a.pos AS p, b.pos AS q FROM m a JOIN m b ON a.vec_id = b.vec_id AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1),
t AS (SELECT vec_id, p, q FROM e UNION SELECT t.vec_id, t.p, e.q FROM t JOIN e ON t.vec_id = e.vec_id AND t.q = e.p),
c AS (SELECT vec_id, p, min(q) AS comp FROM t GROUP BY vec_id, p), cs AS (SELECT vec_id, comp, count(*) AS size FROM c GROUP BY vec_id, comp)
SELECT c.vec_id, cast(c.p AS integer) AS pos FROM c JOIN cs ON cs.vec_id = c.vec_id AND cs.comp = c.comp WHERE size >= 2 AND size < 40""")
def q_segmented(spark, sf):
    """The mask pixels of the whole segmentation: smoothing, threshold, gate, choice, component filters (KR7)."""
    rows = QUERIES["k_segment"](spark, sf).select("vec_id", F.posexplode("mask").alias("pos", "v"))
    return rows.where("v > 0").select("vec_id", "pos")


# -- masks and labels ------------------------------------------------------
@query(f"WITH {PX} SELECT vec_id, pos, CASE WHEN i >= 1000 THEN 255 ELSE 0 END AS v FROM px")
def q_scaled_mask(spark, sf):
    """A mask as 0 and 255 (LG11)."""
    return frames(spark, sf).select("vec_id", F.posexplode(F.transform("px", lambda v: P.above(v, TH) * 255)).alias("pos", "v"))


@query(f"""WITH {PX}, {FRAME}, v AS (SELECT px.*, frame, CASE WHEN i >= 1000 THEN 1 ELSE 0 END AS m FROM px JOIN fr USING (vec_id, label)),
o AS (SELECT b.unnest - 1 AS dy, c.unnest - 1 AS dx FROM unnest(range(3)) b, unnest(range(3)) c)
SELECT v.vec_id, v.pos, cast(median(w.m) AS integer) AS m FROM v, o JOIN v w ON w.vec_id = v.vec_id AND w.x = least(greatest(v.x + dx, 0), 7) AND w.y = least(greatest(v.y + dy, 0), 7) GROUP BY v.vec_id, v.pos""")
def q_binary_median(spark, sf):
    """The median of a mask's neighbourhood (LG10)."""
    return _flat(_image_rows(spark, sf, lambda k, im: [(*k, volume.median_filter((im >= TH).astype(float)[None]).ravel())], DOUBLES), "m", "vec_id")


@query(f"WITH RECURSIVE {EIGHT}, b AS (SELECT vec_id, comp FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY size DESC, comp) AS k FROM cs) WHERE k = 1) SELECT c.vec_id, cast(c.p AS integer) AS pos FROM c JOIN b ON b.vec_id = c.vec_id AND b.comp = c.comp")
def q_largest_label(spark, sf):
    """Pixels of the first, that is the largest, label alone (LG22)."""
    run = lambda k, im: [(*k, p) for p in np.flatnonzero(volume.labelled(im >= TH) == 1).tolist()]
    return _image_rows(spark, sf, run, "vec_id long, pos int")


_CLOSED = f"z AS (SELECT vec_id, label, pos, x, y, CASE WHEN i >= 1100 THEN 1 ELSE 0 END AS i FROM px), d AS (SELECT vec_id, pos, x, y, m AS i FROM ({_ball_sql('max', 1).format('z')})), k AS ({_ball_sql('min', 1).format('d')})"
_LABELLED = f"""{PX}, {_CLOSED}, m AS (SELECT vec_id, pos, x, y FROM k WHERE m = 1), e AS (SELECT a.vec_id, a.pos AS p, b.pos AS q FROM m a JOIN m b ON a.vec_id = b.vec_id AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1),
t AS (SELECT vec_id, p, q FROM e UNION SELECT t.vec_id, t.p, e.q FROM t JOIN e ON t.vec_id = e.vec_id AND t.q = e.p), c AS (SELECT vec_id, p, min(q) AS comp FROM t GROUP BY vec_id, p),
cs AS (SELECT vec_id, comp, count(*) AS size FROM c GROUP BY vec_id, comp)"""


@query(f"WITH RECURSIVE {_LABELLED}, b AS (SELECT vec_id, comp, row_number() OVER (PARTITION BY vec_id ORDER BY size DESC, comp) AS label FROM cs WHERE size >= 3) SELECT c.vec_id, cast(c.p AS integer) AS pos, cast(b.label AS integer) AS label FROM c JOIN b ON b.vec_id = c.vec_id AND b.comp = c.comp")
def q_labelled(spark, sf):
    """Threshold, closing, large components, labels by size (LG20)."""
    def run(k, im):
        label = volume.labelled(im >= 1100, 1, 3).ravel()
        return [(*k, p, int(label[p])) for p in np.flatnonzero(label).tolist()]

    return _image_rows(spark, sf, run, "vec_id long, pos int, label int")


@query(f"WITH RECURSIVE {_LABELLED} SELECT vec_id, pos, 255 * m AS v FROM k")
def q_label_mask(spark, sf):
    """The labels of threshold and closing, without the size filter, as 0 and 255 (LG21, LG23)."""
    mask = lambda im: np.where(volume.labelled(im >= 1100, 1) > 0, 255.0, 0.0)
    return _flat(_image_rows(spark, sf, lambda k, im: [(*k, mask(im).ravel())], DOUBLES), "v", "vec_id")


@query(f"""WITH {PX}, s AS (SELECT vec_id, pos, i, lag(i) OVER r AS a, lead(i) OVER r AS b, lag(i) OVER c AS d, lead(i) OVER c AS e FROM px WINDOW r AS (PARTITION BY vec_id, y ORDER BY x), c AS (PARTITION BY vec_id, x ORDER BY y))
SELECT vec_id, pos, CASE WHEN i >= 1000 AND least(a, b, d, e) < 1000 THEN 4095 ELSE i END AS v FROM s""")
def q_overlay(spark, sf):
    """The outline of a mask drawn into the frame (LG34)."""
    return _flat(_image_rows(spark, sf, lambda k, im: [(*k, np.where(volume.outline(im >= TH), 4095.0, im).ravel())], DOUBLES), "v", "vec_id")


# -- projections over stacks -----------------------------------------------
@query(f"WITH {PX}, {FRAME} SELECT label, x, y, CASE WHEN max(CASE WHEN frame % 2 = 0 THEN i ELSE 0 END) >= 1200 THEN 'red' WHEN max(CASE WHEN frame % 2 = 1 THEN i ELSE 0 END) >= 1200 THEN 'green' END AS colour FROM px JOIN fr USING (vec_id, label) GROUP BY label, x, y")
def q_colour_projection(spark, sf):
    """The greatest value of two channels along a stack, as colours (LG31)."""
    rows = _stack(spark, sf).select("label", "frame", F.posexplode("px").alias("pos", "i"))
    best = [F.max(F.when(F.col("frame") % 2 == k, F.col("i")).otherwise(0)) for k in (0, 1)]
    found = rows.groupBy("label", "pos").agg(*(F.when(b >= 1200, b).otherwise(0).alias(f"m{k}") for k, b in enumerate(best)))
    return found.select("label", (F.col("pos") % 8).alias("x"), F.floor(F.col("pos") / 8).cast("int").alias("y"), volume.composite([F.col("m0"), F.col("m1")], ["red", "green"]).alias("colour"))


@query(f"WITH {PX}, {FRAME} SELECT label, frame AS z, x, y, i FROM px JOIN fr USING (vec_id, label)")
def q_stacked(spark, sf):
    """Frames one above the other as a volume's planes (LG46)."""
    rows = _stack(spark, sf).select("label", F.col("frame").alias("z"), F.posexplode("px").alias("pos", "i"))
    return rows.select("label", "z", (F.col("pos") % 8).alias("x"), F.floor(F.col("pos") / 8).cast("int").alias("y"), "i")


# -- nearest structure -----------------------------------------------------
@query(f"""WITH {PAIRS}, c AS (SELECT vec_id, avg(x) AS cx, avg(y) AS cy FROM pr WHERE i1 >= 1150 GROUP BY vec_id),
n AS (SELECT c.vec_id, p.x, p.y, p.x - c.cx AS dx, p.y - c.cy AS dy, row_number() OVER (PARTITION BY c.vec_id ORDER BY round(sqrt(pow(p.x - c.cx, 2) + pow(p.y - c.cy, 2)), 9), p.pos) AS k FROM c JOIN pr p ON p.vec_id = c.vec_id AND p.i2 >= 1150)
SELECT vec_id, x, y, round(sqrt(dx * dx + dy * dy), 6) AS away, round(CASE WHEN dx = 0 AND dy = 0 THEN 0.0 ELSE degrees(acos(least(1.0, abs(dx) / sqrt(dx * dx + dy * dy)))) END, 4) AS angle FROM n WHERE k = 1""")
def q_nearest_structure(spark, sf):
    """Nearest structure pixel of each cell's centre: its place, distance, and the angle of the way to it
    to the structure's axis, here the rows (LG38, LG40)."""
    both = pair_frames(spark, sf).select("vec_id", F.concat("px", "px2").alias("px"))

    def run(k, im):
        cell = np.argwhere(im[:8] >= 1150)
        found = volume.nearest(im[8:] >= 1150, tuple(cell.mean(axis=0)), (0.0, 1.0)) if len(cell) else None
        return [] if found is None else [(*k, found[0][1], found[0][0], found[1], found[2])]

    rows = segment.each_frame(both, ["vec_id"], run, "vec_id long, x int, y int, away double, angle double", 8)
    return rows.withColumns({"away": F.round("away", 6), "angle": F.round("angle", 4)})


@query()
def k_walk_ends(spark, sf):
    """Where walks of five steps through a mask end (LG37)."""
    run = lambda k, im: [(*k, n, x, y) for n, (y, x) in enumerate(volume.walk_ends(im >= TH, (3, 3), 5))]
    return _image_rows(spark, sf, run, "vec_id long, n int, x int, y int")


@query()
def k_level_seeds(spark, sf):
    """The segmentation with three intensity classes and seeds by level sets (KR5, KR6)."""
    s = segment.Settings(least=2, most=40, window=1, classes=3, by_levels=True, levels=4)
    return segment.segment_frames(frames(spark, sf).withColumn("width", F.lit(8)), ["vec_id"], "vec_id long", s)


# -- regions ----------------------------------------------------------------
@query(f"WITH {PX} SELECT vec_id, pos, i AS r, i AS g, i AS b FROM px")
def q_grey_to_colour(spark, sf):
    """A grey value as three equal colours (LG1)."""
    return frames(spark, sf).select("vec_id", F.posexplode("px").alias("pos", "r")).select("vec_id", "pos", "r", F.col("r").alias("g"), F.col("r").alias("b"))


@query("SELECT vec_id, cast(p AS integer) AS pos, 0 AS v FROM embeddings, unnest(range(64)) AS t(p)")
def q_empty_frames(spark, sf):
    """Frames of zeros (MAP14, LG32)."""
    return frames(spark, sf).select("vec_id", F.posexplode(P.empty(8, 8)).alias("pos", "v"))


@query(f"WITH RECURSIVE {EIGHT} SELECT vec_id, string_agg(cast(comp AS varchar), ' ' ORDER BY comp) AS labels FROM cs GROUP BY vec_id")
def q_label_list(spark, sf):
    """The labels that occur in each frame, in order, without the background (AG14)."""
    rows = segment.component_rows(frames(spark, sf), ["vec_id"], "vec_id long", TH, 8)
    return rows.groupBy("vec_id").agg(F.array_join(F.sort_array(F.collect_set("comp")), " ").alias("labels"))


QUARTERS = f"{PX}, {FRAME}, qt AS (SELECT px.*, frame, cast(pos // 16 AS integer) AS part FROM px JOIN fr USING (vec_id, label))"


def _quarters(spark, sf):
    """Each quarter of a stack's frames is a region: label, part, x, y, z, i."""
    rows = _stack(spark, sf).select("label", F.col("frame").alias("z"), F.posexplode("px").alias("pos", "i"))
    return rows.select("label", F.floor(F.col("pos") / 16).cast("int").alias("part"), (F.col("pos") % 8).alias("x"), F.floor(F.col("pos") / 8).cast("int").alias("y"), "z", "i")


@query(f"""WITH {QUARTERS} SELECT label, part, count(*) AS volume, cast(sum(i) AS bigint) AS sum, round(avg(i), 6) AS mean, min(i) AS least, max(i) AS most, round(var_samp(i), 6) AS spread,
round(avg(x), 6) AS cx, round(sum(x * i) / sum(i), 6) AS wx, min(x) AS x0, max(x) AS x1, round(avg(y), 6) AS cy, round(sum(y * i) / sum(i), 6) AS wy, min(y) AS y0, max(y) AS y1,
round(avg(frame), 6) AS cz, round(sum(frame * i) / sum(i), 6) AS wz, min(frame) AS z0, max(frame) AS z1, (max(x) - min(x) + 1) * (max(y) - min(y) + 1) * (max(frame) - min(frame) + 1) AS box_volume
FROM qt WHERE i >= 900 GROUP BY label, part""")
def q_region_features(spark, sf):
    """Feature vectors of regions in three dimensions (LG16)."""
    rows = features.region_features(_quarters(spark, sf).where("i >= 900"), ["label", "part"], "xyz")
    return rows.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in rows.dtypes))


@query(f"""WITH {QUARTERS}, bx AS (SELECT label, part, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(frame) AS z0, max(frame) AS z1 FROM qt WHERE i >= 1250 GROUP BY label, part)
SELECT a.label, a.part, greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0) + 1) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0) + 1) * greatest(0, least(a.z1, b.z1) - greatest(a.z0, b.z0) + 1) AS n
FROM bx a JOIN bx b ON b.part = a.part AND b.label = a.label + 1""")
def q_volume_overlap(spark, sf):
    """Shared volume of the boxes of like regions in neighbouring stacks (LG14)."""
    a = features.bounding_boxes(_quarters(spark, sf).where("i >= 1250"), ["label", "part"], "xyz")
    b = features.bounding_boxes(_quarters(spark, sf).where("i >= 1250"), ["label", "part"], "xyz").withColumn("label", F.col("label") - 1)
    return a.join(b, (a["label"] == b["label"]) & (a["part"] == b["part"])).select(a["label"], a["part"], features.box_overlap(a, b, "xyz").alias("n"))


@query(f"""WITH {QUARTERS}, bx AS (SELECT label, part, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(frame) AS z0, max(frame) AS z1 FROM qt WHERE i >= 1250 GROUP BY label, part)
SELECT a.label, a.part, greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) * greatest(0, least(a.z1, b.z1) - greatest(a.z0, b.z0)) AS n
FROM bx a JOIN bx b ON b.part = a.part AND b.label = a.label + 1""")
def q_volume_overlap_exact(spark, sf):
    """Shared volume of boxes whose last pixels are their ends (LG14, ``exact``)."""
    a, b = (features.bounding_boxes(_quarters(spark, sf).where("i >= 1250"), ["label", "part"], "xyz") for _ in range(2))
    b = b.withColumn("label", F.col("label") - 1)
    return a.join(b, (a["label"] == b["label"]) & (a["part"] == b["part"])).select(a["label"], a["part"], features.box_overlap(a, b, "xyz", exact=True).alias("n"))


@query(f"""WITH {PAIRS}, o AS (SELECT b.unnest - 1 AS dy, c.unnest - 1 AS dx FROM unnest(range(3)) b, unnest(range(3)) c),
md AS (SELECT v.vec_id, v.pos, cast(median(w.i1) AS integer) AS m1, cast(median(w.i2) AS integer) AS m2 FROM pr v, o JOIN pr w ON w.vec_id = v.vec_id AND w.x = least(greatest(v.x + dx, 0), 7) AND w.y = least(greatest(v.y + dy, 0), 7) GROUP BY v.vec_id, v.pos)
SELECT vec_id, pos, CASE WHEN m1 >= m2 THEN m1 ELSE 0 END AS w1, CASE WHEN m2 > m1 THEN m2 ELSE 0 END AS w2 FROM md""")
def q_unmix_median(spark, sf):
    """Of the medians of two channels' neighbourhoods the greater stays, the other is zero (LG6, LG7)."""
    both = pair_frames(spark, sf).select("vec_id", F.concat("px", "px2").alias("px"))
    run = lambda k, im: [(*k, volume.median_filter(im[None, :8]).ravel(), volume.median_filter(im[None, 8:]).ravel())]
    rows = segment.each_frame(both, ["vec_id"], run, "vec_id long, m1 array<double>, m2 array<double>", 8)
    rows = rows.select("vec_id", F.posexplode(F.arrays_zip("m1", "m2")).alias("pos", "m"))
    w1, w2 = volume.winner([F.col("m.m1").cast("int"), F.col("m.m2").cast("int")])
    return rows.select("vec_id", "pos", w1.alias("w1"), w2.alias("w2"))


@query(f"""WITH RECURSIVE {EIGHT}, sp AS (SELECT vec_id - 1 AS vec_id, x, y FROM px WHERE vec_id % 2 = 1 AND i >= 1250),
d AS (SELECT c.vec_id, c.comp, min(sqrt(pow(c.p % 8 - sp.x, 2) + pow(c.p // 8 - sp.y, 2))) AS least FROM c LEFT JOIN sp ON sp.vec_id = c.vec_id WHERE c.vec_id % 2 = 0 GROUP BY c.vec_id, c.comp)
SELECT vec_id, cast(comp AS integer) AS comp, round(least, 6) AS least, CASE WHEN least < 4 THEN 'near' ELSE 'far' END AS cls FROM d WHERE vec_id + 1 IN (SELECT vec_id FROM embeddings)""")
def q_classified(spark, sf):
    """Components by their least distance to a structure in the other channel (LG27)."""
    both = pair_frames(spark, sf).select("vec_id", F.concat("px", "px2").alias("px"))

    def run(k, im):
        label, at = K.components(im[:8] >= TH), np.argwhere(im[8:] >= 1250)
        out = []
        for c in K.sizes(label):
            own = np.argwhere(label == c)
            out.append((*k, c - 1, float(np.sqrt(((own[:, None] - at[None]) ** 2).sum(-1).min())) if len(at) else None))
        return out

    rows = segment.each_frame(both, ["vec_id"], run, "vec_id long, comp int, least double", 8)
    return rows.select("vec_id", "comp", F.round("least", 6).alias("least"), F.when(F.col("least") < 4, "near").otherwise("far").alias("cls"))


#: A plus sign, the glyph of the query.
PLUS = np.array([[0, 1, 0], [1, 1, 1], [0, 1, 0]], dtype=bool)


@query(f"""WITH {PX}, ln AS (SELECT vec_id, k AS x, cast(vec_id % 8 + floor((label % 8 - vec_id % 8) * k / 7.0 + 0.5) AS integer) AS y, floor(k / 8.0 * 2000 + (1 - k / 8.0) * 500) AS c FROM embeddings, unnest(range(8)) AS t(k))
SELECT px.vec_id, px.pos, px.i AS r, cast(greatest(px.i, coalesce(ln.c, 0)) AS integer) AS g FROM px LEFT JOIN ln ON ln.vec_id = px.vec_id AND ln.x = px.x AND ln.y = px.y""")
def q_line(spark, sf):
    """A line with a gradient across each frame, in its second channel (LG47)."""

    def run(k, im):
        own = np.stack([im, im, im], axis=-1)
        drawn = volume.with_line(own, (0, k[0] % 8), (7, k[1] % 8), (0, 2000, 0), (0, 500, 0))
        return [(k[0], drawn[..., 0].ravel(), drawn[..., 1].ravel())]

    rows = segment.each_frame(frames(spark, sf), ["vec_id", "label"], run, "vec_id long, r array<double>, g array<double>", 8)
    rows = rows.select("vec_id", F.posexplode(F.arrays_zip("r", "g")).alias("pos", "c"))
    return rows.select("vec_id", "pos", F.col("c.r").cast("int").alias("r"), F.col("c.g").cast("int").alias("g"))


@query(f"""WITH {PX}, m AS (SELECT *, least(greatest(label % 8 - 1, 0), 5) AS gx, least(greatest(vec_id % 8 - 1, 0), 5) AS gy FROM px)
SELECT vec_id, pos, CASE WHEN (x = gx + 1 AND y BETWEEN gy AND gy + 2) OR (y = gy + 1 AND x BETWEEN gx AND gx + 2) THEN 255 ELSE i END AS b FROM m""")
def q_annotated(spark, sf):
    """A glyph pasted into each frame, inside it also near the border (LG45)."""
    run = lambda k, im: [(k[0], volume.annotated(np.stack([im, im, im], axis=-1), PLUS, k[1] % 8, k[0] % 8)[..., 2].ravel())]
    rows = segment.each_frame(frames(spark, sf), ["vec_id", "label"], run, "vec_id long, b array<int>", 8)
    return rows.select("vec_id", F.posexplode("b").alias("pos", "b"))


# -- tiles ------------------------------------------------------------------
def _tiled(spark, sf):
    return frames(spark, sf).select("vec_id", F.lit(8).alias("width"), "px")


@query(f"WITH {PX}, {_gaussian_sql('px', 2.0)} SELECT vec_id, cast(x + 8 * y AS integer) AS pos, cast(floor(greatest(i - g, 0.0) + 1e-9) AS integer) AS i FROM px JOIN g2 USING (vec_id, x, y)")
def q_tiled_background(spark, sf):
    """Background subtracted by tiles of three pixels with halos of eight (MAP2)."""
    return _flat(tiles.subtract_background(_tiled(spark, sf), ["vec_id"], 2.0, tile=3), "i", "vec_id")


@query(f"""WITH {PX}, {_wells_sql('px')}, s AS (SELECT vec_id, x, y, 0.5 + h AS score FROM n WHERE x BETWEEN 1 AND 6 AND y BETWEEN 1 AND 6)
SELECT s.vec_id, s.x, s.y, round(s.score, 6) AS score FROM s JOIN s o ON o.vec_id = s.vec_id AND abs(o.x - s.x) <= 1 AND abs(o.y - s.y) <= 1 GROUP BY s.vec_id, s.x, s.y, s.score HAVING max(o.score) <= s.score""")
def q_tiled_maxima(spark, sf):
    """The maxima of a pattern's correlation, both by tiles with halos (KR8, WN7)."""
    pattern = np.array([[1, 2, 1], [2, 4, 2], [1, 2, 1]], dtype=float)
    scores = tiles.correlated(_tiled(spark, sf), ["vec_id"], pattern, tile=5)
    return tiles.maxima(scores, ["vec_id"], 1, 1, tile=3).withColumn("score", F.round("score", 6))
