"""Registered queries: normalization, events, alignment, ordered windows (sections 2.3, 2.4 J3, 2.5 A2/A10-A17, 2.6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rekurve.operators import align as al, bleach as bl, normalize as nz, ordered as od, shape as sh
from rekurve.plans import bindings as b
from rekurve.plans.bindings import B1, B1G, B2, B5
from rekurve.plans.registry import RD, query, rd

K = ["curve_id"]


def pick(df, ids, nums, digits=6):
    return df.select(*ids, *[rd(c, digits).alias(c) for c in nums])


def pick_sql(ids, nums, digits=6):
    return ", ".join([*ids, *[f"{RD(c, digits)} AS {c}" for c in nums]])


# ---- normalization -------------------------------------------------------------------------------------------------
HEAD2 = B2 + """, h2 AS (SELECT *, count(*) OVER (PARTITION BY curve_id) AS n FROM b2),
p2 AS (SELECT curve_id, avg(roi1) FILTER (frame < greatest(3, floor(0.1 * n))) AS pre1, avg(roi2) FILTER (frame < greatest(3, floor(0.1 * n))) AS pre2,
 min(roi2) AS ref_min, min(roi1) AS post_min, arg_min(roi1, frame) AS fp FROM h2 GROUP BY 1)"""


@query("N01_prebleach_mean", f"WITH {HEAD2} SELECT curve_id, {RD('pre1')} AS pre_roi1 FROM p2")
def n01(spark, sf):
    d = nz.pre_mean(b.roi_frames(spark, sf), "roi1")
    return d.groupBy(*K).agg(rd(F.first("pre_roi1")).alias("pre_roi1"))


@query("N02_normalize_simple", f"""WITH {HEAD2} SELECT b2.curve_id, frame, CASE WHEN pre1 > 100 AND (fp - 100) / (pre1 - 100) <= 0.85
 THEN {RD('(roi1 - 100) / (pre1 - 100)')} END AS norm, CASE WHEN pre1 <= 100 THEN 'pre-bleach not above background'
 WHEN (fp - 100) / (pre1 - 100) > 0.85 THEN 'post-bleach above 85 % of pre-bleach' END AS norm_error FROM b2 JOIN p2 USING (curve_id)""")
def n02(spark, sf):
    d = nz.normalize_simple(b.roi_frames(spark, sf), "roi1", 100.0)
    return d.select("curve_id", "frame", rd("norm").alias("norm"), "norm_error")


@query("N03_normalize_double", f"""WITH {HEAD2} SELECT b2.curve_id, frame, CASE WHEN pre1 > 0 AND pre2 > 0 AND ref_min > 0 THEN {RD('(roi1 / roi2) / (pre1 / pre2)')} END AS norm,
 CASE WHEN pre1 <= 0 OR pre2 <= 0 THEN 'pre-bleach levels must be positive' WHEN ref_min <= 0 THEN 'non-positive reference' END AS norm_error FROM b2 JOIN p2 USING (curve_id)""")
def n03(spark, sf):
    d = nz.normalize_double(b.roi_frames(spark, sf), "roi1", "roi2")
    return d.select("curve_id", "frame", rd("norm").alias("norm"), "norm_error")


@query("N04_normalize_full_scale", f"""WITH {HEAD2} SELECT b2.curve_id, frame, CASE WHEN pre1 > post_min THEN {RD('(roi1 - post_min) / (pre1 - post_min)')} END AS norm,
 CASE WHEN post_min IS NULL THEN 'no post-bleach frames' WHEN pre1 <= post_min THEN 'pre-bleach must exceed post-bleach minimum' END AS norm_error FROM b2 JOIN p2 USING (curve_id)""")
def n04(spark, sf):
    d = nz.normalize_full_scale(b.roi_frames(spark, sf), "roi1")
    return d.select("curve_id", "frame", rd("norm").alias("norm"), "norm_error")


@query("N05_normalize_mode", f"""WITH {HEAD2}, u AS (SELECT 'double' AS mode, curve_id, CASE WHEN pre1 > 0 AND pre2 > 0 AND ref_min > 0 THEN (roi1 / roi2) / (pre1 / pre2) END AS v FROM b2 JOIN p2 USING (curve_id)
 UNION ALL SELECT 'full_scale', curve_id, CASE WHEN pre1 > post_min THEN (roi1 - post_min) / (pre1 - post_min) END FROM b2 JOIN p2 USING (curve_id))
 SELECT mode, curve_id, {RD('avg(v)')} AS mean_norm FROM u GROUP BY 1, 2""")
def n05(spark, sf):
    r = b.roi_frames(spark, sf)
    parts = [nz.normalize(r, "double", roi="roi1", ref="roi2"), nz.normalize(r, "full_scale", signal="roi1")]
    out = [p.groupBy(*K).agg(rd(F.avg("norm")).alias("mean_norm")).withColumn("mode", F.lit(m)) for p, m in zip(parts, ["double", "full_scale"])]
    return out[0].unionByName(out[1])


BL2 = B2 + """, c2t AS (SELECT *, roi1 - roi3 AS c1, roi2 - roi3 AS c2, count(*) OVER (PARTITION BY curve_id) AS n FROM b2),
k2 AS (SELECT curve_id, frame AS bleach FROM (SELECT curve_id, frame, row_number() OVER (PARTITION BY curve_id ORDER BY c1, frame) AS rn FROM c2t) WHERE rn = 1)"""


@query("N06_three_region", f"""WITH {BL2}, j AS (SELECT * FROM c2t JOIN k2 USING (curve_id)),
 a AS (SELECT curve_id, avg(c1) FILTER (frame < least(5, greatest(1, bleach))) AS p1, avg(c2) FILTER (frame < least(5, greatest(1, bleach))) AS p2,
 avg(c1) FILTER (frame >= least(bleach + 1, n - 1) AND frame < least(bleach + 1, n - 1) + 3) AS q1,
 avg(c2) FILTER (frame >= least(bleach + 1, n - 1) AND frame < least(bleach + 1, n - 1) + 3) AS q2,
 max(c1) FILTER (frame = 0) AS f1, max(c2) FILTER (frame = 0) AS f2 FROM j GROUP BY 1),
 s AS (SELECT curve_id, CASE WHEN p1 > 0 THEN p1 WHEN f1 > 0 THEN f1 ELSE 1 END AS pre1, CASE WHEN p2 > 0 THEN p2 WHEN f2 > 0 THEN f2 ELSE 1 END AS pre2, q1, q2 FROM a)
 SELECT curve_id, frame, bleach, {RD('c1 / pre1')} AS normalized, {RD('''c1 / pre1 * CASE WHEN c2 = 0 THEN 1 ELSE greatest(0.5, least(2.0,
 CASE WHEN q2 > 0 THEN q2 ELSE pre2 END / c2)) END''')} AS double_normalized, {RD('(pre1 - q1) / pre1')} AS bleach_depth FROM j JOIN s USING (curve_id)""")
def n06(spark, sf):
    return pick(nz.three_region(b.roi_frames(spark, sf)), ["curve_id", "frame", "bleach"], ["normalized", "double_normalized", "bleach_depth"])


K1R = """kr AS (SELECT curve_id, frame AS bleach FROM (SELECT curve_id, frame, row_number() OVER (PARTITION BY curve_id ORDER BY roi1, frame) AS rn FROM b2) WHERE rn = 1)"""


@query("N07_double_with_floor", f"""WITH {B2}, {K1R}, f AS (SELECT curve_id, frame, bleach, greatest(roi1 - roi3, 1e-6) AS c1, greatest(roi2 - roi3, 1e-6) AS c2 FROM b2 JOIN kr USING (curve_id)),
 p AS (SELECT curve_id, avg(c1) AS p1, avg(c2) AS p2 FROM f WHERE frame < bleach AND frame >= bleach - 5 GROUP BY 1)
 SELECT curve_id, frame, {RD('c1 / p1 * (p2 / c2)', 5)} AS norm, CASE WHEN p1 IS NULL THEN 'no frame before the bleach' END AS norm_error FROM f LEFT JOIN p USING (curve_id)""")
def n07(spark, sf):
    return pick(nz.double_with_floor(b.roi_frames(spark, sf)), ["curve_id", "frame", "norm_error"], ["norm"], 5)


REF2 = BL2 + f""", a2 AS (SELECT curve_id, avg(c1) FILTER (frame < least(bleach, 5)) AS pre1, avg(c2) FILTER (frame < least(bleach, 5)) AS pre2,
 coalesce(avg(c1) FILTER (frame > bleach AND frame <= bleach + 3), min(c1)) AS post1 FROM c2t JOIN k2 USING (curve_id) GROUP BY 1),
 rr AS (SELECT curve_id, frame, bleach, CASE WHEN pre1 > 0 THEN c1 / CASE WHEN pre2 > 0 THEN greatest(0.1, least(2.0, c2 / pre2)) ELSE 1 END / pre1 END AS norm,
 CASE WHEN pre1 > 0 THEN (pre1 - post1) / pre1 END AS bleach_depth, CASE WHEN pre1 IS NULL THEN 'no frame before the bleach' WHEN pre1 <= 0 THEN 'pre-bleach not above background' END AS norm_error FROM c2t JOIN k2 USING (curve_id) JOIN a2 USING (curve_id))"""


@query("N08_reference_ratio", f"WITH {REF2} SELECT {pick_sql(['curve_id', 'frame', 'norm_error'], ['norm', 'bleach_depth'])} FROM rr")
def n08(spark, sf):
    return pick(nz.reference_ratio(b.roi_frames(spark, sf)), ["curve_id", "frame", "norm_error"], ["norm", "bleach_depth"])


@query("P12_normalization_report", f"""WITH {REF2}, g AS (SELECT curve_id, avg(norm) FILTER (frame < least(5, bleach)) AS pre_mean, max(norm) AS hi, min(norm) AS lo FROM rr GROUP BY 1)
 SELECT curve_id, {RD('pre_mean')} AS pre_mean, {RD('hi')} AS hi, {RD('lo')} AS lo, concat_ws('; ', CASE WHEN hi IS NULL THEN 'not normalized' END, CASE WHEN abs(pre_mean - 1) > 0.1 THEN 'pre-bleach not 1' END,
 CASE WHEN hi > 1.5 THEN 'above maximum' END, CASE WHEN lo < 0 THEN 'negative' END) AS warnings FROM g""")
def p12(spark, sf):
    return pick(nz.normalization_report(nz.reference_ratio(b.roi_frames(spark, sf))), ["curve_id", "warnings"], ["pre_mean", "hi", "lo"])


@query("N09_plateau", f"""WITH {B1}, g AS (SELECT curve_id, min(y) AS lo, max(y) AS hi FROM b1 GROUP BY 1)
 SELECT curve_id, frame, CASE WHEN hi - lo >= 1e-10 THEN {RD('(y - lo) / (hi - lo)')} END AS norm FROM b1 JOIN g USING (curve_id)""")
def n09(spark, sf):
    d = od.attach(b.curves(spark, sf), K, lo=F.min("y"), hi=F.max("y"))
    d = d.withColumn("norm", nz.plateau_normalize(F.col("y"), F.col("lo"), F.col("hi")))
    return pick(d, ["curve_id", "frame"], ["norm"])


MIN1 = B1 + """, m1 AS (SELECT curve_id, frame AS bleach, t AS tb, y AS yb FROM (SELECT *, row_number() OVER (PARTITION BY curve_id ORDER BY y, frame) AS rn FROM b1) WHERE rn = 1)"""
ANCH = MIN1 + """, pa AS (SELECT curve_id, coalesce(avg(y) FILTER (frame < bleach), max(y) FILTER (frame = 0)) AS pre, max(y) AS hi FROM b1 JOIN m1 USING (curve_id) GROUP BY 1),
 an AS (SELECT curve_id, frame, bleach, t - tb AS t_rel, CASE WHEN pre <> yb THEN (y - yb) / (pre - yb) WHEN pre > 0 THEN y / pre ELSE y END AS norm
 FROM b1 JOIN m1 USING (curve_id) JOIN pa USING (curve_id) WHERE frame >= bleach)"""


@query("N10_bleach_anchored", f"WITH {ANCH} SELECT {pick_sql(['curve_id', 'frame'], ['t_rel', 'norm'])} FROM an")
def n10(spark, sf):
    return pick(nz.bleach_anchored(b.curves(spark, sf)), ["curve_id", "frame"], ["t_rel", "norm"])


@query("N11_rescale_unit", f"""WITH {MIN1}, z AS (SELECT b1.curve_id, frame, bleach, y - least(0, min(y) OVER (PARTITION BY b1.curve_id)) AS z FROM b1 JOIN m1 USING (curve_id)),
 p AS (SELECT curve_id, avg(z) FILTER (frame < bleach) AS pre FROM z GROUP BY 1)
 SELECT curve_id, frame, {RD('CASE WHEN pre > 0 AND abs(pre - 1) > 1e-8 + 0.1 THEN z / pre ELSE z END')} AS norm FROM z JOIN p USING (curve_id)""")
def n11(spark, sf):
    return pick(nz.rescale_to_unit(b.curves(spark, sf)), ["curve_id", "frame"], ["norm"])


# ---- event detection -----------------------------------------------------------------------------------------------
@query("N12_bleach_minimum", f"WITH {MIN1} SELECT curve_id, bleach FROM m1")
def n12(spark, sf):
    return bl.bleach_at_minimum(b.curves(spark, sf))


@query("N13_bleach_steepest", f"""WITH {B1}, d AS (SELECT curve_id, frame, y - lag(y) OVER (PARTITION BY curve_id ORDER BY frame) AS d FROM b1)
 SELECT curve_id, frame AS bleach FROM (SELECT *, row_number() OVER (PARTITION BY curve_id ORDER BY d, frame) AS rn FROM d WHERE d IS NOT NULL) WHERE rn = 1""")
def n13(spark, sf):
    return bl.bleach_at_steepest(b.curves(spark, sf))


def robust_sql(points, min_post):
    return B1 + f""", cw AS (SELECT *, avg(y) OVER (p ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS pm, stddev_pop(y) OVER (p ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS ps,
 y - lag(y) OVER p AS d, regr_slope(y, t) OVER (p ROWS BETWEEN 1 FOLLOWING AND {points} FOLLOWING) AS slope,
 regr_intercept(y, t) OVER (p ROWS BETWEEN 1 FOLLOWING AND {points} FOLLOWING) AS icept, lead(t) OVER p AS t_next,
 count(*) OVER (PARTITION BY curve_id) AS n FROM b1 WINDOW p AS (PARTITION BY curve_id ORDER BY frame)),
 cc AS (SELECT *, row_number() OVER (PARTITION BY curve_id ORDER BY y, frame) AS ra, row_number() OVER (PARTITION BY curve_id ORDER BY d NULLS LAST, frame) AS rs FROM cw),
 rb AS (SELECT *, frame AS bleach FROM (SELECT *, frame >= 1 AND frame <= n - {min_post} - 1 AND pm - y > 0 AS ok,
 row_number() OVER (PARTITION BY curve_id ORDER BY CASE WHEN frame >= 1 AND frame <= n - {min_post} - 1 AND pm - y > 0 THEN 0 ELSE 1 END,
 CASE WHEN frame >= 1 AND frame <= n - {min_post} - 1 AND pm - y > 0 THEN (pm - y) / (ps + 1e-8) END DESC NULLS LAST, ra) AS rk FROM cc WHERE ra = 1 OR rs = 1) WHERE rk = 1)"""


@query("N14_bleach_robust", f"WITH {robust_sql(3, 2)} SELECT curve_id, bleach FROM rb")
def n14(spark, sf):
    return bl.robust_bleach(b.curves(spark, sf)).select("curve_id", "bleach")


@query("N15_bleach_drop", f"""WITH {B1}, d AS (SELECT curve_id, frame, y, lag(y) OVER (PARTITION BY curve_id ORDER BY frame) AS p FROM b1)
 SELECT curve_id, min(frame) FILTER ((p - y) / p > 0.3) AS bleach FROM d GROUP BY 1""")
def n15(spark, sf):
    return bl.bleach_at_drop(b.curves(spark, sf))


@query("N18_post_bleach", f"""WITH {robust_sql(3, 4)} SELECT b1.curve_id, b1.frame, {RD('b1.t - rb.t + 0.5 * (t_next - rb.t)')} AS t_post,
 {RD('CASE WHEN b1.frame = bleach THEN least(slope * rb.t + icept, rb.y) ELSE b1.y END', 4)} AS y_post FROM b1 JOIN rb USING (curve_id)
 WHERE b1.frame >= bleach AND bleach > 0 AND bleach < n - 2 AND t_next > rb.t""")
def n18(spark, sf):
    d = bl.post_bleach(b.curves(spark, sf))
    return d.select("curve_id", "frame", rd("t_post").alias("t_post"), rd("y_post", 4).alias("y_post"))


@query("N18_post_bleach_variant", f"""WITH {robust_sql(4, 3)}, s AS (SELECT *, least(slope * t + icept, y) AS y0 FROM rb WHERE bleach > 0 AND bleach < n - 3 AND t_next > t)
 SELECT b1.curve_id, b1.frame, {RD('b1.t - s.t + 0.5 * (t_next - s.t)')} AS t_post,
 {RD('CASE WHEN b1.frame = bleach THEN CASE WHEN y0 < 0 THEN greatest(0, s.y * 0.8) ELSE y0 END ELSE b1.y END', 4)} AS y_post FROM b1 JOIN s USING (curve_id) WHERE b1.frame >= bleach""")
def n18v(spark, sf):
    d = bl.post_bleach(b.curves(spark, sf), points=4, floor_negative=True)
    return d.select("curve_id", "frame", rd("t_post").alias("t_post"), rd("y_post", 4).alias("y_post"))


@query("N19_time_zero", f"""WITH {MIN1}, w AS (SELECT *, regr_slope(y, t) OVER (p ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS sl,
 regr_intercept(y, t) OVER (p ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS ic, lead(t) OVER p AS tn FROM b1 WINDOW p AS (PARTITION BY curve_id ORDER BY frame))
 SELECT curve_id, bleach, {RD('sl * t + ic', 4)} AS f_zero, {RD('0.5 * (tn - t)')} AS half_frame FROM w JOIN m1 USING (curve_id) WHERE frame = bleach""")
def n19(spark, sf):
    d = bl.time_zero(b.curves(spark, sf))
    return d.select("curve_id", "bleach", rd("f_zero", 4).alias("f_zero"), rd("half_frame").alias("half_frame"))


def interp_sql(points, extra=""):
    """Bracketing rows by as-of join, then the linear formula."""
    return f"""s AS (SELECT curve_id, frame, t, y, lead(t) OVER p AS t1, lead(y) OVER p AS y1 FROM src WINDOW p AS (PARTITION BY curve_id ORDER BY frame)),
 f0 AS (SELECT curve_id, t AS tf, y AS yf FROM src WHERE frame = 0),
 g AS (SELECT curve_id, tf, yf, j, j * step AS x FROM f0, lim, range(0, {points}) r(j)),
 ip AS (SELECT g.curve_id, j, x, CASE WHEN x < tf THEN yf WHEN t1 IS NULL THEN y ELSE y + (y1 - y) * (x - t) / (t1 - t) END AS yi
 FROM g ASOF LEFT JOIN s ON g.curve_id = s.curve_id AND g.x >= s.t)"""


GRID = B1 + ", src AS (SELECT curve_id, frame, t, y FROM b1), lim AS (SELECT max(t) / 49 AS step FROM src), " + interp_sql(50)


@query("J03_bracket_interpolate", f"WITH {GRID} SELECT curve_id, j, {RD('x')} AS x, {RD('yi', 4)} AS yi FROM ip")
def j03(spark, sf):
    d = al.align(b.curves(spark, sf), 50)
    return d.select("curve_id", "j", rd("x").alias("x"), rd("yi", 4).alias("yi"))


@query("N20_align", f"""WITH {ANCH}, src AS (SELECT curve_id, frame - bleach AS frame, t_rel AS t, norm AS y FROM an), lim AS (SELECT max(t) / 199 AS step FROM src), {interp_sql(200)}
 SELECT curve_id, j, {RD('x')} AS x, {RD('yi', 5)} AS yi FROM ip""")
def n20(spark, sf):
    d = od.reindex(nz.bleach_anchored(b.curves(spark, sf)), F.col("frame") - F.col("bleach"))
    a = al.align(d, 200, "t_rel", "norm")
    return a.select("curve_id", "j", rd("x").alias("x"), rd("yi", 5).alias("yi"))


@query("N21_shared_support", f"""WITH {B1}, src AS (SELECT curve_id, frame, t, y FROM b1), e AS (SELECT curve_id, max(t) AS e, count(*) AS n FROM src GROUP BY 1),
 lim AS (SELECT min(e) / (least(300, greatest(8, floor(median(n)))) - 1) AS step, least(300, greatest(8, floor(median(n)))) AS np FROM e), {interp_sql(300)}
 SELECT curve_id, j, {RD('x')} AS x, {RD('yi', 4)} AS yi FROM ip, lim WHERE j < np""")
def n21(spark, sf):
    a = al.shared_support(b.curves(spark, sf))
    return a.select("curve_id", "j", rd("x").alias("x"), rd("yi", 4).alias("yi"))


@query("A02_mean_curve", f"""WITH {GRID}, {b.GRP} SELECT coalesce(grp, 'none') AS grp, j, {RD('any_value(x)')} AS x, {RD('avg(yi)', 4)} AS mean, {RD('stddev_samp(yi)', 4)} AS sd,
 {RD('stddev_samp(yi) / sqrt(count(yi))', 4)} AS sem, count(yi) AS n FROM ip LEFT JOIN grp USING (curve_id) GROUP BY 1, 2""")
def a02(spark, sf):
    a = al.align(b.curves(spark, sf), 50).join(b.curve_groups(spark, sf), "curve_id", "left").withColumn("grp", F.coalesce("grp", F.lit("none")))
    m = al.mean_curve(a, ["grp"])
    return m.select("grp", "j", rd("x").alias("x"), *[rd(c, 4).alias(c) for c in ("mean", "sd", "sem")], "n")


@query("N22_acquisition_trend", f"""WITH {B2}, g AS (SELECT curve_id, regr_slope(roi2, frame) AS s, max(roi2) FILTER (frame = 0) AS f, -regr_slope(ln(roi2), frame) AS r, count(*) AS n FROM b2 GROUP BY 1)
 SELECT curve_id, CASE WHEN n >= 3 THEN {RD('100 * s / greatest(abs(f), 1e-12)')} END AS slope_pct, CASE WHEN n >= 3 THEN {RD('r')} END AS exp_rate, CASE WHEN n >= 3 THEN abs(100 * s / greatest(abs(f), 1e-12)) > 1 END AS flagged,
 CASE WHEN n < 3 THEN 'fewer than 3 frames' END AS reason FROM g""")
def n22(spark, sf):
    return pick(nz.acquisition_trend(b.roi_frames(spark, sf), "roi2"), ["curve_id", "flagged", "reason"], ["slope_pct", "exp_rate"])


@query("N23_detrend_linear", f"""WITH {B1}, s AS (SELECT curve_id, regr_slope(y, t) AS s FROM b1 GROUP BY 1) SELECT curve_id, frame, {RD('y - s * t')} AS detrended FROM b1 JOIN s USING (curve_id)""")
def n23(spark, sf):
    return pick(nz.detrend_linear(b.curves(spark, sf)), ["curve_id", "frame"], ["detrended"])


@query("N25_rolling_baseline", f"""WITH {B1}, w AS (SELECT curve_id, frame, y, quantile_cont(y, 0.1) OVER (PARTITION BY curve_id ORDER BY frame ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS q FROM b1)
 SELECT curve_id, frame, {RD('y - q')} AS corrected FROM w""")
def n25(spark, sf):
    return pick(nz.rolling_baseline(b.curves(spark, sf)), ["curve_id", "frame"], ["corrected"])


@query("N26_prebleach_level", f"""WITH {MIN1} SELECT curve_id, any_value(bleach) AS bleach, {RD('coalesce(avg(y) FILTER (frame < bleach AND frame >= bleach - 5), max(y) FILTER (frame = 0))')} AS pre
 FROM b1 JOIN m1 USING (curve_id) GROUP BY 1""")
def n26(spark, sf):
    return pick(bl.pre_bleach_level(b.curves(spark, sf)), ["curve_id", "bleach"], ["pre"])


@query("N27_signal_to_noise", f"WITH {B2} SELECT curve_id, frame, {RD('(roi1 - roi3) / sqrt(greatest(roi3, 1.0))')} AS snr FROM b2")
def n27(spark, sf):
    d = b.roi_frames(spark, sf).withColumn("snr", nz.signal_to_noise(F.col("roi1"), F.col("roi3")))
    return pick(d, ["curve_id", "frame"], ["snr"])


STEP5 = B5 + """, st AS (SELECT *, sqrt(power(x - lag(x) OVER p, 2) + power(y - lag(y) OVER p, 2)) AS step FROM b5 WINDOW p AS (PARTITION BY track_id ORDER BY frame)),
 md AS (SELECT track_id, median(step) AS med FROM st GROUP BY 1), ma AS (SELECT track_id, median(abs(step - med)) AS mad FROM st JOIN md USING (track_id) GROUP BY 1),
 mf AS (SELECT track_id, frame, x, y, step, med, coalesce(step > greatest(med + 5 * mad, 5.0), false) AS artifact FROM st JOIN md USING (track_id) JOIN ma USING (track_id))"""


@query("N28_motion_flags", f"WITH {STEP5} SELECT track_id, frame, {RD('step')} AS step, artifact FROM mf")
def n28(spark, sf):
    return pick(sh.motion_flags(b.tracks(spark, sf)), ["track_id", "frame", "artifact"], ["step"])


@query("N28_motion_summary", f"""WITH {STEP5} SELECT track_id, sum(artifact::INT)::BIGINT AS n_artifacts, {RD('avg(step)')} AS mean_step, {RD('max(step)')} AS max_step, {RD('any_value(med)')} AS med FROM mf GROUP BY 1""")
def n28s(spark, sf):
    d = sh.motion_flags(b.tracks(spark, sf))
    return d.groupBy("track_id").agg(F.sum(F.col("artifact").cast("int")).alias("n_artifacts"), rd(F.avg("step")).alias("mean_step"), rd(F.max("step")).alias("max_step"), rd(F.first("med")).alias("med"))


SLOPE = MIN1 + """, r AS (SELECT curve_id, frame, bleach, y, t - tb AS rt, (max(t) OVER (PARTITION BY curve_id) - tb) * 0.6 AS w0, count(*) OVER (PARTITION BY curve_id) AS n FROM b1 JOIN m1 USING (curve_id)),
 st AS (SELECT curve_id, frame AS start FROM (SELECT curve_id, frame, row_number() OVER (PARTITION BY curve_id ORDER BY abs(rt - w0), frame) AS rn FROM r WHERE frame >= bleach) WHERE rn = 1),
 g AS (SELECT curve_id, any_value(n) AS n, any_value(bleach) AS bleach, count(*) FILTER (frame >= start) AS points, coalesce(regr_slope(y, rt) FILTER (frame >= start), 0) AS slope, coalesce(regr_r2(y, rt) FILTER (frame >= start), 0) AS r2 FROM r JOIN st USING (curve_id) GROUP BY 1),
 h AS (SELECT *, n < 10 OR bleach >= n - 10 OR points < 3 AS bad FROM g), i AS (SELECT *, NOT bad AND slope < -0.001 AND r2 > 0.7 AS downward FROM h),
 ts AS (SELECT curve_id, points, CASE WHEN bad THEN 0 ELSE slope END AS slope, CASE WHEN bad THEN 0 ELSE r2 END AS r2, downward,
 CASE WHEN bad THEN 0 ELSE least(1.0, greatest(-slope, 0) / 0.001 * r2) END AS confidence, CASE WHEN n < 10 THEN 'insufficient_data' WHEN bleach >= n - 10 THEN 'no_recovery_data' WHEN points < 3 THEN 'insufficient_analysis_points'
 WHEN downward AND slope < -0.003 THEN 'exclude_strong' WHEN downward AND r2 > 0.9 THEN 'exclude_confident' WHEN downward THEN 'exclude_moderate' WHEN slope > 0 THEN 'include_good'
 WHEN abs(slope) < 0.0005 THEN 'include_stable' ELSE 'review_manual' END AS recommendation FROM i)"""


@query("N29_terminal_slope", f"WITH {SLOPE} SELECT {pick_sql(['curve_id', 'points', 'downward', 'recommendation'], ['slope', 'r2', 'confidence'])} FROM ts")
def n29(spark, sf):
    return pick(sh.terminal_slope(b.curves(spark, sf)), ["curve_id", "points", "downward", "recommendation"], ["slope", "r2", "confidence"])


@query("N30_group_slopes", f"""WITH {SLOPE}, {b.GRP} SELECT coalesce(grp, 'none') AS grp, count(*) AS total, sum(downward::INT)::BIGINT AS problems, {RD('avg(downward::INT)')} AS exclusion_rate FROM ts LEFT JOIN grp USING (curve_id) GROUP BY 1""")
def n30(spark, sf):
    d = sh.terminal_slope(b.curves(spark, sf)).join(b.curve_groups(spark, sf), "curve_id", "left")
    x = F.col("downward").cast("int")
    return d.groupBy(F.coalesce("grp", F.lit("none")).alias("grp")).agg(F.count(F.lit(1)).alias("total"), F.sum(x).alias("problems"), rd(F.avg(x)).alias("exclusion_rate"))


@query("N31_drift", f"""WITH {B5}, e AS (SELECT track_id, arg_min(x, frame) AS xa, arg_min(y, frame) AS ya, arg_max(x, frame) AS xz, arg_max(y, frame) AS yz FROM b5 GROUP BY 1)
 SELECT track_id, {RD('sqrt(power(xz - xa, 2) + power(yz - ya, 2))')} AS drift FROM e""")
def n31(spark, sf):
    return pick(sh.drift(b.tracks(spark, sf)), ["track_id"], ["drift"])


# ---- per-curve summaries -------------------------------------------------------------------------------------------
@query("A10_recruitment", f"""WITH {B1}, s AS (SELECT *, avg(y) FILTER (frame < 3) OVER (PARTITION BY curve_id) AS base, max(y) OVER (PARTITION BY curve_id) AS hi, lag(t) OVER (PARTITION BY curve_id ORDER BY frame) AS tp,
 lag(y) OVER (PARTITION BY curve_id ORDER BY frame) AS yp FROM b1)
 SELECT curve_id, {RD('any_value(hi)')} AS max_intensity, {RD('any_value(base)')} AS baseline, {RD('any_value(hi) / any_value(base)')} AS fold_increase,
 {RD('min(t) FILTER (y >= base + (hi - base) / 2)')} AS time_to_half_max, {RD('sum((t - tp) * (y + yp - 2 * base) / 2)', 4)} AS total_recruitment, {RD('any_value(hi - base)')} AS amplitude FROM s GROUP BY 1""")
def a10(spark, sf):
    d = sh.recruitment(b.curves(spark, sf))
    d = d.withColumn("total_recruitment", rd("total_recruitment", 4))
    return pick(d, ["curve_id", "total_recruitment"], ["max_intensity", "baseline", "fold_increase", "time_to_half_max", "amplitude"])


SHAPE = ["min_intensity", "max_intensity", "range", "pre_mean", "pre_sd", "pre_trend", "early_rate", "final_mean", "recovery_fraction", "time_to_half", "roughness", "asymmetry"]


@query("A11_shape_features", f"""WITH {MIN1}, j AS (SELECT *, count(*) OVER q AS n, y - 2 * lag(y, 1) OVER p + lag(y, 2) OVER p AS d2 FROM b1 JOIN m1 USING (curve_id) WINDOW p AS (PARTITION BY curve_id ORDER BY frame), q AS (PARTITION BY curve_id)),
 k AS (SELECT *, avg(y) FILTER (frame >= bleach AND frame >= n - CASE WHEN n - bleach >= 5 THEN 5 ELSE 1 END) OVER (PARTITION BY curve_id) AS fin FROM j),
 h AS (SELECT curve_id, t AS th FROM (SELECT curve_id, t, row_number() OVER (PARTITION BY curve_id ORDER BY abs(y - (yb + 0.5 * (fin - yb))), frame) AS rn FROM k WHERE frame >= bleach) WHERE rn = 1),
 g AS (SELECT curve_id, any_value(bleach) AS b, any_value(n) AS n, any_value(tb) AS tb, min(y) AS lo, max(y) AS hi, coalesce(avg(y) FILTER (frame < bleach), max(y) FILTER (frame = 0)) AS pm,
 coalesce(stddev_pop(y) FILTER (frame < bleach), 0) AS psd, CASE WHEN any_value(bleach) > 1 THEN regr_slope(y, t) FILTER (frame < bleach) ELSE 0 END AS ptrend, regr_slope(y, t) FILTER (frame >= bleach AND frame < bleach + 5) AS early,
 any_value(fin) AS fin, stddev_pop(d2) AS rough, min(t) AS t0, max(t) AS t1 FROM k GROUP BY 1),
 o AS (SELECT curve_id, lo AS min_intensity, hi AS max_intensity, hi - lo AS range, pm AS pre_mean, psd AS pre_sd, ptrend AS pre_trend, CASE WHEN n - b > 5 THEN early ELSE 0 END AS early_rate,
 CASE WHEN b < n - 1 THEN fin ELSE lo END AS final_mean, CASE WHEN b < n - 1 AND pm <> lo THEN (fin - lo) / (pm - lo) ELSE 0 END AS recovery_fraction, CASE WHEN b < n - 1 THEN th - tb END AS time_to_half,
 CASE WHEN n > 4 THEN rough ELSE 0 END AS roughness, CASE WHEN b < n - 1 AND b > 0 AND t1 > t0 THEN (tb - t0) / (t1 - t0) ELSE 0.5 END AS asymmetry FROM g JOIN h USING (curve_id))
 SELECT {pick_sql(['curve_id'], SHAPE, 5)} FROM o""")
def a11(spark, sf):
    return pick(sh.shape_features(b.curves(spark, sf)), ["curve_id"], SHAPE, 5)


QUAL = ["snr", "bleach_efficiency", "null_share", "sampling_regularity", "intensity_range", "dynamic_range", "baseline_variance", "mean_dt", "duration"]


@query("A13_quality_features", f"""WITH {MIN1}, j AS (SELECT *, t - lag(t) OVER (PARTITION BY curve_id ORDER BY frame) AS dt FROM b1 JOIN m1 USING (curve_id)),
 g AS (SELECT curve_id, count(*) AS n_points, avg(y) AS m, stddev_pop(y) AS s, avg(y) FILTER (frame < bleach) AS pm, min(y) AS lo, max(y) AS hi, avg((y IS NULL)::INT) AS null_share, stddev_pop(dt) AS sdt, avg(dt) AS mean_dt,
 var_pop(y) FILTER (frame < CASE WHEN bleach > 5 THEN bleach ELSE 5 END) AS baseline_variance, max(t) - min(t) AS duration FROM j GROUP BY 1),
 o AS (SELECT *, CASE WHEN n_points > 10 THEN m / s ELSE 1 END AS snr, CASE WHEN pm > 0 THEN (pm - lo) / pm ELSE 0 END AS bleach_efficiency, sdt / mean_dt AS sampling_regularity, hi - lo AS intensity_range, (hi - lo) / m AS dynamic_range FROM g)
 SELECT {pick_sql(['curve_id', 'n_points'], QUAL, 5)} FROM o""")
def a13(spark, sf):
    return pick(sh.quality_features(b.curves(spark, sf)), ["curve_id", "n_points"], QUAL, 5)


STAT = ["mean", "sd", "skew", "kurt", "q25", "q50", "q75", "iqr", "autocorr", "trend"]


@query("A14_statistical_features", f"""WITH {B1}, j AS (SELECT *, lag(y) OVER (PARTITION BY curve_id ORDER BY frame) AS y1 FROM b1),
 g AS (SELECT curve_id, count(y) AS n, avg(y) AS mean, stddev_pop(y) AS sd, corr(y, y1) AS ac, regr_slope(y, t) AS trend, kurtosis_pop(y) + 3 AS k4, quantile_cont(y, 0.25) AS q25, quantile_cont(y, 0.5) AS q50, quantile_cont(y, 0.75) AS q75 FROM j GROUP BY 1),
 s AS (SELECT curve_id, sum(power((y - mean) / sd, 3)) AS s3 FROM b1 JOIN g USING (curve_id) GROUP BY 1),
 o AS (SELECT curve_id, mean, sd, n * s3 / ((n - 1) * (n - 2)) AS skew, ((n + 1) * (n - 1) * k4 - 3 * power(n - 1, 2)) / ((n - 2) * (n - 3)) AS kurt, q25, q50, q75, q75 - q25 AS iqr, CASE WHEN n > 10 THEN ac ELSE 0 END AS autocorr, trend FROM g JOIN s USING (curve_id))
 SELECT {pick_sql(['curve_id'], STAT, 5)} FROM o""")
def a14(spark, sf):
    return pick(sh.statistical_features(b.curves(spark, sf)), ["curve_id"], STAT, 5)


RES = ["rmse", "max_abs", "durbin_watson", "mape", "mean_res", "sd_res"]


@query("A15_residual_diagnostics", f"""WITH {B1}, f AS (SELECT curve_id, regr_slope(y, t) AS s, regr_intercept(y, t) AS i FROM b1 GROUP BY 1), r AS (SELECT curve_id, frame, y, y - (s * t + i) AS res FROM b1 JOIN f USING (curve_id)),
 d AS (SELECT *, res - lag(res) OVER (PARTITION BY curve_id ORDER BY frame) AS dres FROM r), g AS (SELECT curve_id, sqrt(avg(res * res)) AS rmse, max(abs(res)) AS max_abs, coalesce(sum(dres * dres) / sum(res * res), 2.0) AS durbin_watson,
 avg(abs(res / (y + 1e-10))) * 100 AS mape, avg(res) AS mean_res, stddev_pop(res) AS sd_res FROM d GROUP BY 1) SELECT {pick_sql(['curve_id'], RES, 4)} FROM g""")
def a15(spark, sf):
    d = od.attach(b.curves(spark, sf), K, s=F.regr_slope("y", "t"), i=F.regr_intercept("y", "t"))
    return pick(sh.residual_diagnostics(d.withColumn("fit", F.col("s") * F.col("t") + F.col("i")), "y", "fit"), ["curve_id"], RES, 4)


@query("A16_half_time", f"""WITH {B1}, n AS (SELECT curve_id, count(*) AS n, max(y) FILTER (frame = 0) AS y0 FROM b1 GROUP BY 1), p AS (SELECT curve_id, avg(y) AS pl FROM b1 JOIN n USING (curve_id) WHERE frame >= n - 5 GROUP BY 1)
 SELECT curve_id, {RD('any_value(pl)')} AS plateau, {RD('min(t) FILTER (y >= y0 + 0.5 * (pl - y0))')} AS t_half FROM b1 JOIN n USING (curve_id) JOIN p USING (curve_id) GROUP BY 1""")
def a16(spark, sf):
    return pick(sh.half_time_summary(b.curves(spark, sf)), ["curve_id"], ["plateau", "t_half"])


@query("A17_ragged", f"WITH {B1}, n AS (SELECT curve_id, count(*) AS n FROM b1 GROUP BY 1) SELECT count(*) AS curves, count(DISTINCT n) AS lengths, count(DISTINCT n) > 1 AS ragged FROM n")
def a17(spark, sf):
    n = table_counts(spark, sf)
    return n.agg(F.count(F.lit(1)).alias("curves"), F.countDistinct("n").alias("lengths")).withColumn("ragged", F.col("lengths") > 1)


def table_counts(spark, sf):
    return b.table(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("P15_downsample", f"""WITH {B2}, n AS (SELECT curve_id, count(*) AS n FROM b2 GROUP BY 1), g AS (SELECT DISTINCT curve_id, CASE WHEN n <= 300 THEN j ELSE floor(j * (n - 1) / 299 + 1e-9)::BIGINT END AS frame
 FROM n, range(0, 300) r(j)) SELECT b2.curve_id, b2.frame, roi1 FROM b2 JOIN g USING (curve_id, frame)""")
def p15(spark, sf):
    return sh.downsample(b.roi_frames(spark, sf)).select("curve_id", "frame", "roi1")


@query("P17_clean_trace", f"""WITH {B1}, c AS (SELECT *, count(*) OVER (PARTITION BY curve_id) AS n FROM (SELECT * FROM b1 WHERE y < 400)) SELECT curve_id, frame, y FROM c WHERE n >= 5""")
def p17(spark, sf):
    d = b.curves(spark, sf).withColumn("y", F.when(F.col("y") < 400, F.col("y")).otherwise(F.lit(float("inf"))))
    return sh.clean_trace(d).select("curve_id", "frame", "y")


@query("P19_choose_signal", f"""WITH {B2}, s AS (SELECT *, CASE WHEN roi3 > 40 THEN roi1 END AS a FROM b2), c AS (SELECT curve_id, count(a) AS na, count(roi2) AS nb, count(*) AS n FROM s GROUP BY 1)
 SELECT curve_id, frame, CASE WHEN na >= greatest(4, n // 2) THEN 'a' ELSE 'roi2' END AS source, CASE WHEN na >= greatest(4, n // 2) THEN a ELSE roi2 END AS intensity FROM s JOIN c USING (curve_id) WHERE na >= greatest(4, n // 2) OR nb >= 4""")
def p19(spark, sf):
    d = b.roi_frames(spark, sf).withColumn("a", F.when(F.col("roi3") > 40, F.col("roi1")))
    return sh.choose_signal(d, "a", "roi2").select("curve_id", "frame", "source", "intensity")


# ---- window functions ----------------------------------------------------------------------------------------------
@query("W01_first_difference", f"WITH {B1} SELECT curve_id, frame, {RD('y - lag(y) OVER (PARTITION BY curve_id ORDER BY frame)')} AS d FROM b1")
def w01(spark, sf):
    return pick(od.windowed(b.curves(spark, sf), K, lambda w: {"d": F.col("y") - F.lag("y").over(w)}), ["curve_id", "frame"], ["d"])


@query("W02_second_difference", f"WITH {B1} SELECT curve_id, frame, {RD('y - 2 * lag(y, 1) OVER p + lag(y, 2) OVER p')} AS d2 FROM b1 WINDOW p AS (PARTITION BY curve_id ORDER BY frame)")
def w02(spark, sf):
    return pick(od.windowed(b.curves(spark, sf), K, lambda w: {"d2": F.col("y") - 2 * F.lag("y", 1).over(w) + F.lag("y", 2).over(w)}, before=2), ["curve_id", "frame"], ["d2"])


@query("W03_fill_forward", f"""WITH {B2}, s AS (SELECT curve_id, frame, CASE WHEN roi3 > 0 THEN roi1 END AS v FROM b2)
 SELECT curve_id, frame, last_value(v IGNORE NULLS) OVER (PARTITION BY curve_id ORDER BY frame) AS filled FROM s""")
def w03(spark, sf):
    d = b.roi_frames(spark, sf).withColumn("v", F.when(F.col("roi3") > 0, F.col("roi1")))
    return od.fill_forward(d, K, "v", "filled").select("curve_id", "frame", "filled")


@query("W04_average_rank", """WITH v AS (SELECT l_linenumber AS line, l_discount AS value, count(*) AS cnt FROM lineitem GROUP BY 1, 2)
 SELECT line, value, cnt, sum(cnt) OVER (PARTITION BY line ORDER BY value) - cnt + (cnt + 1) / 2 AS avg_rank FROM v""")
def w04(spark, sf):
    return od.value_ranks(b.samples(spark, sf).select("line", F.col("tied").alias("value")), ["line"], "value").select("line", "value", "cnt", "avg_rank")


@query("W07_five_before", f"""WITH {B1} SELECT curve_id, frame, {RD('avg(y) OVER (PARTITION BY curve_id ORDER BY frame ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)')} AS pm,
 {RD('stddev_pop(y) OVER (PARTITION BY curve_id ORDER BY frame ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)')} AS ps FROM b1""")
def w07(spark, sf):
    d = od.windowed(b.curves(spark, sf), K, lambda w: {"pm": F.avg("y").over(w.rowsBetween(-5, -1)), "ps": F.stddev_pop("y").over(w.rowsBetween(-5, -1))}, before=5)
    return pick(d, ["curve_id", "frame"], ["pm", "ps"])


@query("W08_argmin_argmax", f"""WITH {MIN1}, x AS (SELECT curve_id, frame AS peak FROM (SELECT curve_id, frame, row_number() OVER (PARTITION BY curve_id ORDER BY y DESC, frame) AS rn FROM b1) WHERE rn = 1)
 SELECT curve_id, bleach AS trough, peak FROM m1 JOIN x USING (curve_id)""")
def w08(spark, sf):
    return b.curves(spark, sf).groupBy(*K).agg(bl.earliest_min(F.col("y"), F.col("frame")).alias("trough"), F.min_by("frame", F.struct(-F.col("y"), F.col("frame"))).alias("peak"))
