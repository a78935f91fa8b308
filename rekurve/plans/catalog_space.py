"""Registered queries: pixels, contours, trajectories (2.13) and their detection and join forms."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from rekurve.operators import contours as ct, pixels as px, tracks as tr
from rekurve.plans import bindings as b
from rekurve.plans.bindings import B5, B6, B7
from rekurve.plans.registry import RD, query, rd
from rekurve.plans.session import cut_lineage

D2 = "(power(px - 3, 2) + power(py - 4, 2))"


def pix(spark, sf):
    return b.pixels(spark, sf)


def grid(spark, sf):
    return pix(spark, sf).filter("frame = 0").select("stack_id", "py", "px")


MASK = f"""gd AS (SELECT DISTINCT stack_id, py, px FROM b7), mk AS (SELECT stack_id, 'roi1' AS roi, py, px FROM gd WHERE {D2} <= 4 UNION ALL SELECT stack_id, 'roi2', py, px FROM gd WHERE sqrt{D2} >= 3 AND sqrt{D2} <= 4
 UNION ALL SELECT stack_id, 'roi3', py, px FROM gd WHERE power(px - 6, 2) + power(py - 6, 2) <= 1)"""


def masks(spark, sf):
    return px.roi_masks(grid(spark, sf), 3, 4, 8, 8, radius=2, gap=1, span=2, far=2, bg_radius=1).withColumn("roi", F.col("roi"))


@query("G23_roi_masks", f"WITH {B7}, {MASK} SELECT * FROM mk".replace("power(px - 6, 2) + power(py - 6, 2)", "power(px - 5, 2) + power(py - 6, 2)"))
def g23(spark, sf):
    return masks(spark, sf).select("stack_id", "roi", "py", "px")


MASK = MASK.replace("power(px - 6, 2) + power(py - 6, 2)", "power(px - 5, 2) + power(py - 6, 2)")
SERIES = f"SELECT stack_id, frame, {', '.join(RD(f'''avg(v) FILTER (roi = 'roi{i}')''') + f' AS roi{i}' for i in (1, 2, 3))} FROM b7 JOIN mk USING (stack_id, py, px) GROUP BY 1, 2"


@query("G01_roi_series", f"WITH {B7}, {MASK} {SERIES}")
def g01(spark, sf):
    s = px.roi_series(pix(spark, sf), masks(spark, sf), ["roi1", "roi2", "roi3"])
    return s.select("stack_id", "frame", *[rd(c).alias(c) for c in ("roi1", "roi2", "roi3")])


@query("J07_mask_join", f"WITH {B7}, {MASK} SELECT stack_id, roi, count(*) AS n, {RD('sum(v)', 4)} AS total FROM b7 JOIN mk USING (stack_id, py, px) GROUP BY 1, 2")
def j07(spark, sf):
    j = pix(spark, sf).join(masks(spark, sf), ["stack_id", "py", "px"])
    return j.groupBy("stack_id", "roi").agg(F.count(F.lit(1)).alias("n"), rd(F.sum("v"), 4).alias("total"))


@query("G02_bleach_radius", f"""WITH {B7}, pr AS (SELECT stack_id, py, px, avg(v) AS v FROM b7 WHERE frame < 5 GROUP BY 1, 2, 3), d AS (SELECT pr.stack_id, pr.py, pr.px, greatest(pr.v - b7.v, 0) AS d FROM pr JOIN b7 ON b7.stack_id = pr.stack_id AND b7.py = pr.py AND b7.px = pr.px AND frame = 5),
 g AS (SELECT stack_id, sum(d) AS t, sum(px * d) / sum(d) AS x0, sum(py * d) / sum(d) AS y0, max(d) AS top FROM d GROUP BY 1), v AS (SELECT stack_id, any_value(x0) AS x0, any_value(y0) AS y0, any_value(top) AS top, sqrt(sum(power(px - x0, 2) * d) / any_value(t)) AS sx, sqrt(sum(power(py - y0, 2) * d) / any_value(t)) AS sy FROM d JOIN g USING (stack_id) GROUP BY 1)
 SELECT stack_id, {RD('any_value(x0)')} AS x0, {RD('any_value(y0)')} AS y0, {RD('2 * sqrt(0.5 * (power(any_value(sx), 2) + power(any_value(sy), 2)))')} AS w, {RD('greatest(any_value(sx), any_value(sy)) / least(any_value(sx), any_value(sy))')} AS ellipticity,
 {RD('1 - sum(power(d - top * exp(-(power(px - x0, 2) / (2 * sx * sx) + power(py - y0, 2) / (2 * sy * sy))), 2)) / (var_pop(d) * count(*))')} AS fit_quality FROM d JOIN v USING (stack_id) GROUP BY 1""")
def g02(spark, sf):
    p = pix(spark, sf)
    pre = p.filter("frame < 5").groupBy("stack_id", "py", "px").agg(F.avg("v").alias("v"))
    r = px.bleach_radius(pre, p.filter("frame = 5").select("stack_id", "py", "px", "v"))
    return r.select("stack_id", *[rd(c).alias(c) for c in ("x0", "y0", "w", "ellipticity", "fit_quality")])


SHIFT = """mn AS (SELECT stack_id, frame, avg(v) AS m FROM b7 GROUP BY 1, 2), cv AS (SELECT b7.stack_id, b7.frame, py, px, v - m AS v FROM b7 JOIN mn USING (stack_id, frame)),
 co AS (SELECT m.stack_id, m.frame, (r.py - m.py + 12) % 8 AS iy, (r.px - m.px + 12) % 8 AS ix, sum(r.v * m.v) AS c FROM cv m JOIN cv r ON r.stack_id = m.stack_id AND r.frame = 0 GROUP BY 1, 2, 3, 4),
 sh AS (SELECT stack_id, frame, (iy - 4)::INTEGER AS dy, (ix - 4)::INTEGER AS dx FROM (SELECT *, row_number() OVER (PARTITION BY stack_id, frame ORDER BY round(c / mx, 9) DESC, iy, ix) AS rn FROM (SELECT *, max(abs(c)) OVER (PARTITION BY stack_id, frame) AS mx FROM co)) WHERE rn = 1)"""


@query("G03_drift_shifts", f"WITH {B7}, {SHIFT} SELECT * FROM sh")
def g03(spark, sf):
    return px.drift_shifts(pix(spark, sf))


@query("G03_drift_corrected", f"WITH {B7}, {SHIFT} SELECT b7.stack_id, b7.frame, (py + dy + 8) % 8 AS py, (px + dx + 8) % 8 AS px, {RD('v')} AS v FROM b7 JOIN sh USING (stack_id, frame)")
def g03c(spark, sf):
    p = pix(spark, sf)
    return px.apply_shifts(p, px.drift_shifts(p)).select("stack_id", "frame", "py", "px", rd("v").alias("v"))


@query("G04_disc_signal", f"""WITH {B7}, r AS (SELECT stack_id, frame, avg(v) FILTER (sqrt{D2} <= 1) AS raw, median(v) FILTER (sqrt{D2} > 2 AND sqrt{D2} <= 3) AS bg FROM b7 GROUP BY 1, 2) SELECT stack_id, frame, {RD('raw')} AS raw, {RD('bg')} AS bg, {RD('raw - bg')} AS corr FROM r""")
def g04(spark, sf):
    s = px.disc_signal(pix(spark, sf), 3, 4, 1.0, 1, 2)
    return s.select("stack_id", "frame", rd("raw").alias("raw"), rd("bg").alias("bg"), rd("corr").alias("corr"))


@query("G04_disc_signal_trimmed", f"""WITH {B7}, q AS (SELECT stack_id, frame, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM b7 WHERE sqrt{D2} > 2 AND sqrt{D2} <= 3 GROUP BY 1, 2)
 SELECT stack_id, frame, {RD('avg(v)')} AS bg FROM b7 JOIN q USING (stack_id, frame) WHERE sqrt{D2} > 2 AND sqrt{D2} <= 3 AND v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY 1, 2""")
def g04m(spark, sf):
    return px.disc_signal(pix(spark, sf), 3, 4, 1.0, 1, 2, "mean").select("stack_id", "frame", rd("bg").alias("bg"))


@query("G05_radial_profile", f"""WITH {B7}, c AS (SELECT stack_id, frame, py AS cy, px AS cx FROM (SELECT *, row_number() OVER (PARTITION BY stack_id, frame ORDER BY v, py, px) AS rn FROM b7) WHERE rn = 1)
 SELECT stack_id, frame, floor(sqrt(power(px - cx, 2) + power(py - cy, 2)) / 0.5)::BIGINT AS ring, {RD('avg(v)')} AS mean, count(*) AS n FROM b7 JOIN c USING (stack_id, frame) GROUP BY 1, 2, 3""")
def g05(spark, sf):
    return px.radial_profile(pix(spark, sf)).select("stack_id", "frame", F.col("ring").cast("long").alias("ring"), rd("mean").alias("mean"), "n")


@query("G06_pixel_maps", f"""WITH {B7}, n AS (SELECT stack_id, max(frame) + 1 AS n FROM b7 GROUP BY 1), g AS (SELECT stack_id, py, px, avg(v) FILTER (frame < 5) AS y0, max(v) FILTER (frame = 5) AS yb, avg(v) FILTER (frame >= n - 5) AS ye FROM b7 JOIN n USING (stack_id) GROUP BY 1, 2, 3),
 h AS (SELECT stack_id, py, px, any_value(y0) AS y0, any_value(yb) AS yb, any_value(ye) AS ye, min(frame - 5) FILTER (frame > 5 AND v / y0 >= yb / y0 + 0.5 * (ye / y0 - yb / y0))::DOUBLE AS t FROM b7 JOIN g USING (stack_id, py, px) GROUP BY 1, 2, 3)
 SELECT stack_id, py, px, {RD('least(1.0, greatest(0.0, (ye - yb) / (y0 - yb)))')} AS mobile, t AS t_half, {RD('ln(2) / t')} AS k, {RD('1 / (4 * t)')} AS d FROM h""")
def g06(spark, sf):
    m = px.pixel_maps(pix(spark, sf), 5)
    return m.select("stack_id", "py", "px", rd("mobile").alias("mobile"), "t_half", rd("k").alias("k"), rd("d").alias("d"))


@query("G07_bleach_mask", f"""WITH {B7}, g AS (SELECT stack_id, py, px, avg(v) FILTER (frame < 5) AS pre, max(v) FILTER (frame = 5) AS post FROM b7 GROUP BY 1, 2, 3), m AS (SELECT * FROM g WHERE (pre - post) / pre > 0.1) SELECT stack_id, count(*) AS area, {RD('sqrt(count(*) / 3.141592653589793) * 0.2')} AS radius FROM m GROUP BY 1""")
def g07(spark, sf):
    return px.equivalent_radius(px.bleach_mask(pix(spark, sf), 5, 0.1), 0.2).withColumn("radius", rd("radius"))


@query("G08_adaptive_signal", f"""WITH {B7}, c AS (SELECT stack_id, frame, 3 + frame % 2 AS cx, 4 AS cy, 1 + frame % 3 * 0.5 AS r FROM (SELECT DISTINCT stack_id, frame FROM b7)), d AS (SELECT stack_id, frame, v, sqrt(power(px - cx, 2) + power(py - cy, 2)) - r * 1.5 AS d FROM b7 JOIN c USING (stack_id, frame))
 SELECT stack_id, frame, {RD('avg(v) FILTER (d <= 0)')} AS damage, {RD('avg(v) FILTER (d > 0 AND d <= 1)')} AS background, count(*) FILTER (d <= 0) AS area FROM d GROUP BY 1, 2""")
def g08(spark, sf):
    p = pix(spark, sf)
    f = F.col("frame")
    c = p.select("stack_id", "frame").distinct().select("stack_id", "frame", (3 + f % 2).alias("cx"), F.lit(4).alias("cy"), (1 + f % 3 * 0.5).alias("radius"))
    return px.adaptive_signal(p, c, 1.5, 1).select("stack_id", "frame", rd("damage").alias("damage"), rd("background").alias("background"), "area")


@query("G09_otsu_area", f"""WITH {B7}, r AS (SELECT stack_id, frame, min(v) AS lo, max(v) AS hi FROM b7 GROUP BY 1, 2), h AS (SELECT stack_id, frame, least(255, floor((v - lo) / ((hi - lo) / 256))) AS bin, any_value(lo) AS lo, any_value(hi) AS hi, count(*) AS c FROM b7 JOIN r USING (stack_id, frame) GROUP BY 1, 2, 3),
 m AS (SELECT *, lo + (bin + 0.5) * ((hi - lo) / 256) AS mid FROM h), w AS (SELECT *, sum(c) OVER u AS w1, sum(c * mid) OVER u AS s1, sum(c) OVER d AS w2, sum(c * mid) OVER d AS s2 FROM m WINDOW u AS (PARTITION BY stack_id, frame ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), d AS (PARTITION BY stack_id, frame ORDER BY bin ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
 t AS (SELECT stack_id, frame, mid AS thr FROM (SELECT *, row_number() OVER (PARTITION BY stack_id, frame ORDER BY round(w1 * w2 * power(s1 / w1 - s2 / w2, 2), 6) DESC, bin) AS rn FROM w WHERE w2 > 0) WHERE rn = 1)
 SELECT stack_id, frame, {RD('any_value(thr)')} AS threshold, count(*) FILTER (v < thr) AS area FROM b7 JOIN t USING (stack_id, frame) GROUP BY 1, 2""")
def g09(spark, sf):
    return px.otsu_area(pix(spark, sf)).select("stack_id", "frame", rd("threshold").alias("threshold"), "area")


SOBEL = """nb AS (SELECT *, coalesce(lag(v) OVER r, v) AS l, coalesce(lead(v) OVER r, v) AS rr FROM b7 WINDOW r AS (PARTITION BY stack_id, frame, py ORDER BY px)), s1 AS (SELECT *, (l + 2 * v + rr) / 4 AS sx, l - rr AS dx FROM nb),
 s2 AS (SELECT *, (coalesce(lag(dx) OVER c, dx) + 2 * dx + coalesce(lead(dx) OVER c, dx)) / 4 AS gx, coalesce(lag(sx) OVER c, sx) - coalesce(lead(sx) OVER c, sx) AS gy FROM s1 WINDOW c AS (PARTITION BY stack_id, frame, px ORDER BY py)), sb AS (SELECT stack_id, frame, py, px, sqrt((gx * gx + gy * gy) / 2) AS grad FROM s2)"""
W9 = "[" + ", ".join(repr(x) for x in px.SMOOTH) + "]"


@query("G10_edge_radius", f"""WITH {B7}, {SOBEL}, e AS (SELECT stack_id, frame, i, coalesce(sum(grad) FILTER (sqrt{D2} >= 1 + i * 0.5 - 1 AND sqrt{D2} <= 1 + i * 0.5 + 1), 0) AS e FROM sb, range(0, 8) r(i) GROUP BY 1, 2, 3),
 sm AS (SELECT a.stack_id, a.frame, a.i, round(sum({W9}[o + 5] * z.e), 6) AS s FROM e a, range(-4, 5) k(o), e z WHERE z.stack_id = a.stack_id AND z.frame = a.frame AND z.i = CASE WHEN a.i + o < 0 THEN -(a.i + o) - 1 WHEN a.i + o >= 8 THEN 15 - (a.i + o) ELSE a.i + o END GROUP BY 1, 2, 3)
 SELECT stack_id, frame, (1 + i * 0.5)::DOUBLE AS radius FROM (SELECT *, row_number() OVER (PARTITION BY stack_id, frame ORDER BY s DESC, i) AS rn FROM sm) WHERE rn = 1""")
def g10(spark, sf):
    return px.edge_radius(pix(spark, sf), 3, 4, 2.0, 1.0, 5.0)


@query("G11_mask_overlap", f"""WITH {B7}, m AS (SELECT stack_id, frame, py, px FROM b7 WHERE v < 95), f AS (SELECT stack_id, frame + 1 AS frame, py, px FROM m), j AS (SELECT coalesce(a.stack_id, z.stack_id) AS stack_id, coalesce(a.frame, z.frame) AS frame, a.py AS ap, z.py AS zp FROM m a FULL JOIN f z ON a.stack_id = z.stack_id AND a.frame = z.frame AND a.py = z.py AND a.px = z.px)
 SELECT stack_id, frame, count(ap) AS area_a, count(zp) AS area_b, {RD('count(*) FILTER (ap IS NOT NULL AND zp IS NOT NULL) / count(*)')} AS iou FROM j GROUP BY 1, 2""")
def g11(spark, sf):
    m = pix(spark, sf).filter("v < 95").select("stack_id", "frame", "py", "px")
    return px.mask_overlap(m, m.withColumn("frame", F.col("frame") + 1), ["stack_id", "frame"]).withColumn("iou", rd("iou"))


@query("G11_hausdorff", f"""WITH {B7}, m AS (SELECT stack_id, frame, py, px FROM b7 WHERE v < 95), f AS (SELECT stack_id, frame + 1 AS frame, py, px FROM m), d AS (SELECT a.stack_id, a.frame, a.py AS ay, a.px AS ax, z.py AS zy, z.px AS zx, sqrt(power(a.py - z.py, 2) + power(a.px - z.px, 2)) AS d FROM m a JOIN f z USING (stack_id, frame)),
 o AS (SELECT stack_id, frame, max(d) AS h FROM (SELECT stack_id, frame, ay, ax, min(d) AS d FROM d GROUP BY 1, 2, 3, 4) GROUP BY 1, 2), p AS (SELECT stack_id, frame, max(d) AS h FROM (SELECT stack_id, frame, zy, zx, min(d) AS d FROM d GROUP BY 1, 2, 3, 4) GROUP BY 1, 2)
 SELECT stack_id, frame, {RD('greatest(o.h, p.h)')} AS hausdorff FROM o JOIN p USING (stack_id, frame)""")
def g11h(spark, sf):
    m = pix(spark, sf).filter("v < 95").select("stack_id", "frame", "py", "px")
    return px.hausdorff(m, m.withColumn("frame", F.col("frame") + 1), ["stack_id", "frame"], 8, 8).withColumn("hausdorff", rd("hausdorff"))


@query("N13_image_bleach", f"WITH {B7}, m AS (SELECT stack_id, frame, avg(v) AS m FROM b7 GROUP BY 1, 2), d AS (SELECT stack_id, frame, m - lag(m) OVER (PARTITION BY stack_id ORDER BY frame) AS d FROM m) SELECT stack_id, frame AS bleach FROM (SELECT *, row_number() OVER (PARTITION BY stack_id ORDER BY d, frame) AS rn FROM d WHERE d IS NOT NULL) WHERE rn = 1")
def n13i(spark, sf):
    return px.steepest_image_drop(pix(spark, sf))


@query("N16_temporal_gradient", f"""WITH {B7}, n AS (SELECT *, lag(v) OVER w AS p, lead(v) OVER w AS q FROM b7 WINDOW w AS (PARTITION BY stack_id, py, px ORDER BY frame)), g AS (SELECT stack_id, frame, py, px, abs(CASE WHEN p IS NULL THEN q - v WHEN q IS NULL THEN v - p ELSE (q - p) / 2 END) AS g FROM n),
 f AS (SELECT stack_id, frame FROM (SELECT stack_id, frame, row_number() OVER (PARTITION BY stack_id ORDER BY m DESC, frame) AS rn FROM (SELECT stack_id, frame, round(avg(g), 9) AS m FROM g GROUP BY 1, 2)) WHERE rn = 1)
 SELECT stack_id, frame AS bleach, py, px FROM (SELECT g.*, row_number() OVER (PARTITION BY stack_id ORDER BY round(g, 9) DESC, py, px) AS rn FROM g JOIN f USING (stack_id, frame)) WHERE rn = 1""")
def n16(spark, sf):
    return px.temporal_gradient(pix(spark, sf))


def blur_sql(sigma: float) -> str:
    k = px._kernel(sigma)
    r = len(k) // 2
    w = "[" + ", ".join(repr(float(x)) for x in k) + "]"
    return f"""kn AS (SELECT o, {w}[o + {r + 1}] AS w FROM range(-{r}, {r + 1}) t(o)), bx AS (SELECT a.stack_id, a.frame, a.py, a.px, sum(w * z.v) AS v FROM b7 a, kn, b7 z WHERE z.stack_id = a.stack_id AND z.frame = a.frame AND z.py = a.py AND z.px = least(7, greatest(0, a.px + o)) GROUP BY 1, 2, 3, 4),
 bb AS (SELECT a.stack_id, a.frame, a.py, a.px, sum(w * z.v) AS v FROM bx a, kn, bx z WHERE z.stack_id = a.stack_id AND z.frame = a.frame AND z.px = a.px AND z.py = least(7, greatest(0, a.py + o)) GROUP BY 1, 2, 3, 4)"""


@query("N17_darkest_blurred", f"WITH {B7}, {blur_sql(1.0)} SELECT stack_id, frame, py, px FROM (SELECT *, row_number() OVER (PARTITION BY stack_id, frame ORDER BY round(v, 9), py, px) AS rn FROM bb) WHERE rn = 1")
def n17(spark, sf):
    return px.darkest_blurred(pix(spark, sf))


@query("G24_subtract_background", f"WITH {B7}, {blur_sql(2.0)} SELECT b7.stack_id, b7.frame, b7.py, b7.px, {RD('greatest(0, b7.v - bb.v)')} AS corrected FROM b7 JOIN bb USING (stack_id, frame, py, px)")
def g24(spark, sf):
    return px.subtract_background(pix(spark, sf), 2.0).select("stack_id", "frame", "py", "px", rd("corrected").alias("corrected"))


@query("G22_tracking_table")
def g22(spark, sf):
    k = tr.kalman(b.tracks(spark, sf))
    pos = k.select(F.col("track_id").alias("stack_id"), "frame", F.pmod(F.col("xs"), F.lit(8.0)).alias("x"), F.pmod(F.col("ys"), F.lit(8.0)).alias("y"), "innovation")
    return px.tracking_table(pix(spark, sf), cut_lineage(pos), 1.5)


# ---- tracks ------------------------------------------------------------------------------------------------------------
STEPS = B5 + ", sd AS (SELECT *, x - lag(x) OVER p AS dx, y - lag(y) OVER p AS dy FROM b5 WINDOW p AS (PARTITION BY track_id ORDER BY frame))"


@query("G12_steps", f"WITH {STEPS} SELECT track_id, frame, {RD('sqrt(dx * dx + dy * dy)')} AS step, {RD('atan2(dy, dx)')} AS angle FROM sd")
def g12(spark, sf):
    return tr.steps(b.tracks(spark, sf)).select("track_id", "frame", rd("step").alias("step"), rd("angle").alias("angle"))


@query("G17_displacement", f"WITH {STEPS} SELECT track_id, {RD('sum(sqrt(dx * dx + dy * dy)) * 0.1')} AS path, {RD('sqrt(power(sum(dx), 2) + power(sum(dy), 2)) * 0.1')} AS net, {RD('avg(dx)')} AS mean_dx, {RD('avg(dy)')} AS mean_dy FROM sd GROUP BY 1")
def g17(spark, sf):
    return tr.displacement(b.tracks(spark, sf), 0.1).select("track_id", *[rd(c).alias(c) for c in ("path", "net", "mean_dx", "mean_dy")])


@query("G21_squared_displacement", f"WITH {STEPS} SELECT track_id, {RD('avg(dx * dx + dy * dy)', 5)} AS msd, {RD('avg(dx * dx + dy * dy) / 4', 5)} AS d FROM sd GROUP BY 1")
def g21(spark, sf):
    return tr.squared_displacement(b.tracks(spark, sf)).select("track_id", rd("msd", 5).alias("msd"), rd("d", 5).alias("d"))


def states(spark, sf):
    return b.tracks(spark, sf).withColumn("state", F.when(F.col("x") < -5, 0).when(F.col("x") < 5, 1).otherwise(2))


ST = B5 + ", ss AS (SELECT *, CASE WHEN x < -5 THEN 0 WHEN x < 5 THEN 1 ELSE 2 END AS state FROM b5), sp AS (SELECT *, lead(state) OVER (PARTITION BY track_id ORDER BY frame) AS nx FROM ss)"


@query("W06_state_pairs", f"WITH {ST} SELECT track_id, frame, state, nx AS next_state FROM sp WHERE nx IS NOT NULL")
def w06(spark, sf):
    return tr.state_pairs(states(spark, sf)).select("track_id", "frame", "state", "next_state")


@query("G14_transition_matrix", f"""WITH {ST}, c AS (SELECT state AS a, nx AS b, count(*) AS n FROM sp WHERE nx IS NOT NULL GROUP BY 1, 2), g AS (SELECT x.a::INTEGER AS a, y.b::INTEGER AS b FROM range(0, 3) x(a), range(0, 3) y(b)), w AS (SELECT state AS a, count(*) AS m FROM ss GROUP BY 1)
 SELECT g.a, g.b, {RD('(coalesce(n, 0) + 1.0) / sum(coalesce(n, 0) + 1.0) OVER (PARTITION BY g.a)')} AS prob, {RD('m / (SELECT sum(m) FROM w)')} AS weight FROM g LEFT JOIN c USING (a, b) JOIN w ON w.a = g.a""")
def g14(spark, sf):
    return tr.transition_matrix(states(spark, sf), 3).select("a", "b", rd("prob").alias("prob"), rd("weight").alias("weight"))


@query("G15_viterbi")
def g15(spark, sf):
    trans = np.full((3, 3), 0.1) + 0.7 * np.eye(3)
    return tr.viterbi(b.tracks(spark, sf), ["x", "y"], trans, np.array([[-10.0, 0], [0, 0], [10.0, 0]]), np.full((3, 2), 10.0), np.full(3, 1 / 3))


@query("G16_kalman")
def g16(spark, sf):
    return tr.kalman(b.tracks(spark, sf))


# two "frames" of detections: orders and suppliers placed by derived coordinates
J8A = "a AS (SELECT c_nationkey AS g, c_custkey AS id, c_acctbal / 10 AS x, (c_custkey * 37 % 1000)::DOUBLE AS y FROM customer), z AS (SELECT s_nationkey AS g, s_suppkey AS id, s_acctbal / 10 AS x, (s_suppkey * 91 % 1000)::DOUBLE AS y FROM supplier)"


@query("J08_nearest_candidates", f"WITH {J8A}, d AS (SELECT a.g, a.id AS id_a, z.id AS id_b, sqrt(power(a.x - z.x, 2) + power(a.y - z.y, 2)) AS d FROM a JOIN z USING (g)), k AS (SELECT *, row_number() OVER (PARTITION BY g, id_a ORDER BY d, id_b) AS ra, row_number() OVER (PARTITION BY g, id_b ORDER BY d, id_a) AS rb FROM d WHERE d <= 100) SELECT g, id_a, id_b, {RD('d')} AS dist FROM k WHERE ra = 1 AND rb = 1")
def j08(spark, sf):
    links = _links(spark, sf)
    # links made in the first round are exactly the mutually nearest pairs
    first = links.filter("round = 1")
    return first.select("g", "id_a", "id_b", rd("dist").alias("dist"))


def _links(spark, sf):
    a = b.table(spark, sf, "customer").select(F.col("c_nationkey").alias("g"), F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 10).alias("x"), (F.col("c_custkey") * 37 % 1000).cast("double").alias("y"))
    z = b.table(spark, sf, "supplier").select(F.col("s_nationkey").alias("g"), F.col("s_suppkey").alias("id"), (F.col("s_acctbal") / 10).alias("x"), (F.col("s_suppkey") * 91 % 1000).cast("double").alias("y"))
    return tr.assign_nearest(a, z, ["g"], 100.0)


@query("J08_nearest_assignment")
def j08all(spark, sf):
    return _links(spark, sf)


# ---- contours ----------------------------------------------------------------------------------------------------------
UNI = B6 + """, ce AS (SELECT object_id, frame, point_idx, x - avg(x) OVER w AS dx, y - avg(y) OVER w AS dy FROM b6 WINDOW w AS (PARTITION BY object_id, frame)), po AS (SELECT object_id, frame, point_idx, ((atan2(dy, dx) % (2 * pi())) + 2 * pi()) % (2 * pi()) AS th, sqrt(dx * dx + dy * dy) AS r FROM ce),
 pw AS (SELECT object_id, frame, th, r FROM po UNION ALL SELECT object_id, frame, th + 2 * pi(), r FROM (SELECT *, row_number() OVER (PARTITION BY object_id, frame ORDER BY th, point_idx) AS rn FROM po) WHERE rn = 1),
 sg AS (SELECT *, lead(th) OVER w AS th1, lead(r) OVER w AS r1 FROM pw WINDOW w AS (PARTITION BY object_id, frame ORDER BY th)), f0 AS (SELECT object_id, frame, min(th) AS tf, arg_min(r, th) AS rf FROM pw GROUP BY 1, 2),
 gg AS (SELECT object_id, frame, tf, rf, j, j * (2 * pi() / 64) AS a FROM f0, range(0, 64) t(j)), ur AS (SELECT gg.object_id, gg.frame, j, CASE WHEN a < tf THEN rf ELSE r + (r1 - r) * (a - th) / (th1 - th) END AS radius FROM gg ASOF LEFT JOIN sg ON gg.object_id = sg.object_id AND gg.frame = sg.frame AND gg.a >= sg.th)"""


def uniform(spark, sf):
    return ct.uniform_radius(b.contours(spark, sf), 64)


@query("G18_uniform_radius", f"WITH {UNI} SELECT object_id, frame, j, {RD('radius')} AS radius FROM ur")
def g18(spark, sf):
    return uniform(spark, sf).select("object_id", "frame", "j", rd("radius").alias("radius"))


MODES = UNI + """, md AS (SELECT object_id, frame, m, avg(radius) AS mr, (power(sum(radius * cos(j * (2 * pi() * m / 64))), 2) + power(sum(radius * sin(j * (2 * pi() * m / 64))), 2)) / (64 * 64) AS p FROM ur, range(2, 17) t(m) GROUP BY 1, 2, 3),
 rv AS (SELECT object_id, avg(mr) AS radius FROM md GROUP BY 1), vr AS (SELECT object_id, m, avg(p) AS variance FROM md GROUP BY 1, 2), sc AS (SELECT object_id, m AS mode, variance, m / radius AS q FROM vr JOIN rv USING (object_id))"""


@query("G19_mode_spectrum", f"WITH {MODES} SELECT object_id, mode, {RD('variance', 9)} AS variance, {RD('q')} AS q FROM sc")
def g19(spark, sf):
    s = ct.spectrum(ct.modes(uniform(spark, sf), 64, 2, 16))
    return s.select("object_id", F.col("mode").cast("long").alias("mode"), rd("variance", 9).alias("variance"), rd("q").alias("q"))


@query("G19_tension", f"""WITH {MODES}, g AS (SELECT object_id, sum(variance / (q * q)) / sum(1 / power(q, 4)) AS slope, avg(variance) AS mv FROM sc GROUP BY 1) SELECT object_id, {RD('any_value(slope)', 8)} AS slope, {RD('1 - sum(power(variance - slope / (q * q), 2)) / sum(power(variance - mv, 2))', 5)} AS r2 FROM sc JOIN g USING (object_id) GROUP BY 1""")
def g19t(spark, sf):
    return ct.tension(ct.spectrum(ct.modes(uniform(spark, sf), 64, 2, 16))).select("object_id", rd("slope", 8).alias("slope"), rd("r2", 5).alias("r2"))


@query("G20_bending", f"""WITH {B6}, ce AS (SELECT object_id, avg(x) AS cx, avg(y) AS cy FROM b6 GROUP BY 1), rr AS (SELECT object_id, frame, point_idx AS j, sqrt(power(x - cx, 2) + power(y - cy, 2)) AS r FROM b6 JOIN ce USING (object_id)),
 md AS (SELECT object_id, frame, m, (power(sum(r * cos(j * (2 * pi() * m / 64))), 2) + power(sum(r * sin(j * (2 * pi() * m / 64))), 2)) / 64 * CASE WHEN m = 32 THEN 1 ELSE 2 END AS p FROM rr, range(1, 33) t(m) GROUP BY 1, 2, 3),
 ps AS (SELECT object_id, m * (2 * pi() / 64) AS q, avg(p) AS psd FROM md GROUP BY 1, m, 2), s AS (SELECT object_id, sum(psd * psd * power(q, 4)) AS a, sum(psd * psd * power(q, 6)) AS b, sum(psd * psd * power(q, 8)) AS d, sum(psd * power(q, 2)) AS e, sum(psd * power(q, 4)) AS f FROM ps GROUP BY 1),
 k AS (SELECT *, (e * d - b * f) / (a * d - b * b) AS sg, (a * f - b * e) / (a * d - b * b) AS kp FROM s) SELECT object_id, {RD('CASE WHEN kp < 0 THEN e / a ELSE greatest(0, sg) END', 4)} AS tension_kt, {RD('CASE WHEN sg < 0 THEN f / d ELSE greatest(0, kp) END', 4)} AS rigidity_kt FROM k""")
def g20(spark, sf):
    return ct.bending(ct.fluctuation_psd(b.contours(spark, sf), 64)).select("object_id", rd("tension_kt", 4).alias("tension_kt"), rd("rigidity_kt", 4).alias("rigidity_kt"))
