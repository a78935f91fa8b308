"""Registered queries: outliers, neighbours, clusters (2.12), set operations on outliers, streaming and user functions (2.15, 2.16)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from rekurve.functions.basis import MODELS, Model, register
from rekurve.operators import cluster as cl, fit, neighbors as nb, outliers as ol
from rekurve.plans import bindings as b
from rekurve.plans.bindings import B1, B3
from rekurve.plans.catalog_tables import FEAT, feats
from rekurve.plans.registry import RD, query, rd
from rekurve.plans.session import cut_lineage, shared_scratch
from rekurve.streaming import live

IQR = FEAT + """, q AS (SELECT grp, quantile_cont(price, 0.25) AS p1, quantile_cont(price, 0.75) AS p3, quantile_cont(spread, 0.25) AS s1, quantile_cont(spread, 0.75) AS s3 FROM ft GROUP BY 1),
 iq AS (SELECT ft.*, price < p1 - 1.5 * (p3 - p1) OR price > p3 + 1.5 * (p3 - p1) AS po, coalesce(spread < s1 - 1.5 * (s3 - s1) OR spread > s3 + 1.5 * (s3 - s1), false) AS so FROM ft JOIN q USING (grp))"""


def iqr(spark, sf):
    return ol.iqr_flags(feats(spark, sf), ["price", "spread"], ["grp"])


@query("O01_iqr_fences", f"WITH {IQR} SELECT cell_id, po AS price_outlier, so AS spread_outlier, po OR so AS outlier FROM iq")
def o01(spark, sf):
    return iqr(spark, sf).select("cell_id", "price_outlier", "spread_outlier", "outlier")


@query("O02_zscore", f"WITH {FEAT} SELECT cell_id, {RD('(price - avg(price) OVER (PARTITION BY grp)) / stddev_pop(price) OVER (PARTITION BY grp)')} AS z, abs((price - avg(price) OVER (PARTITION BY grp)) / stddev_pop(price) OVER (PARTITION BY grp)) > 3 AS outlier FROM ft")
def o02(spark, sf):
    return ol.zscore_flags(feats(spark, sf), "price", ["grp"]).select("cell_id", rd("z").alias("z"), "outlier")


MADQ = FEAT + """, md AS (SELECT grp, median(price) AS med FROM ft GROUP BY 1), ma AS (SELECT grp, any_value(med) AS med, median(abs(price - med)) AS mad FROM ft JOIN md USING (grp) GROUP BY 1)"""


@query("O02_robust_z", f"WITH {MADQ} SELECT cell_id, {RD('(price - med) / (1.4826 * mad)')} AS z, abs((price - med) / (1.4826 * mad)) > 3 AS outlier FROM ft JOIN ma USING (grp)")
def o02r(spark, sf):
    return ol.robust_z_flags(feats(spark, sf), "price", ["grp"]).select("cell_id", rd("z").alias("z"), "outlier")


@query("O03_mad", f"WITH {MADQ} SELECT cell_id, {RD('0.6745 * (price - med) / mad')} AS z, abs(0.6745 * (price - med) / mad) > 3.5 AS outlier, abs(1.4826 * (price - med) / mad) > 3.5 AS outlier_reference FROM ft JOIN ma USING (grp)")
def o03(spark, sf):
    f = feats(spark, sf)
    ref = ol.mad_flags(f, "price", ["grp"], scale="reference").select("cell_id", F.col("outlier").alias("outlier_reference"))
    return ol.mad_flags(f, "price", ["grp"]).select("cell_id", rd("z").alias("z"), "outlier").join(ref, "cell_id")


@query("O04_grubbs", f"WITH {FEAT}, g AS (SELECT batch, cell_id, price, abs(price - avg(price) OVER w) / stddev_samp(price) OVER w AS g, count(*) OVER w AS n FROM ft WINDOW w AS (PARTITION BY batch)) SELECT batch, CASE WHEN n >= 3 THEN cell_id END AS cell_id, CASE WHEN n >= 3 THEN {RD('g')} END AS g, n, CASE WHEN n < 3 THEN 'fewer than 3 values' END AS reason FROM (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY g DESC, cell_id) AS rn FROM g) WHERE rn = 1")
def o04(spark, sf):
    return ol.grubbs(feats(spark, sf), "cell_id", "price", ["batch"]).select("batch", "cell_id", rd("g").alias("g"), "n", "reason")


@query("O04_grubbs_decision")
def o04d(spark, sf):
    return ol.grubbs_decision(ol.grubbs(feats(spark, sf), "cell_id", "price", ["batch"]))


@query("O05_dixon", f"""WITH {FEAT}, r AS (SELECT batch, grp, cell_id, price, row_number() OVER (PARTITION BY batch, grp ORDER BY price, cell_id) AS i, count(*) OVER (PARTITION BY batch, grp) AS n FROM ft),
 o AS (SELECT batch, grp, any_value(n) AS n, max(price) FILTER (i = 1) AS a, max(price) FILTER (i = 2) AS b, max(price) FILTER (i = n - 1) AS y, max(price) FILTER (i = n) AS z FROM r GROUP BY 1, 2),
 q AS (SELECT *, greatest((b - a) / (z - a), (z - y) / (z - a)) AS q, [0.970, 0.829, 0.710, 0.625, 0.568, 0.526, 0.493, 0.466][least(n, 10) - 2]::DOUBLE AS c FROM o WHERE n >= 3 AND z > a) SELECT batch, grp, o.n, {RD('q')} AS q, c AS critical, q > c AS outlier, CASE WHEN o.n < 3 THEN 'fewer than 3 values' WHEN q IS NULL THEN 'all values equal' END AS reason FROM o LEFT JOIN q USING (batch, grp)""")
def o05(spark, sf):
    return ol.dixon(feats(spark, sf), "cell_id", "price", ["batch", "grp"]).select("batch", "grp", "n", rd("q").alias("q"), "critical", "outlier", "reason")


@query("O06_curve_outliers", f"""WITH {FEAT}, r AS (SELECT *, CASE WHEN mobile * 1.2 > 200 THEN 'impossible: above 200 %' WHEN mobile * 1.2 > 100 THEN 'above 100 %' WHEN mobile * 1.2 < 0 THEN 'negative' END AS reason FROM ft), s AS (SELECT grp, quantile_cont(spread, 0.25) AS s1, quantile_cont(spread, 0.75) AS s3 FROM r WHERE reason IS NULL GROUP BY 1)
 SELECT cell_id, CASE WHEN reason IS NOT NULL THEN reason WHEN spread < s1 - 1.5 * (s3 - s1) OR spread > s3 + 1.5 * (s3 - s1) THEN 'statistical: spread' END AS reason FROM r LEFT JOIN s USING (grp)""")
def o06(spark, sf):
    f = feats(spark, sf).select("cell_id", "grp", "spread", (F.col("mobile") * 1.2).alias("mobile"))
    return ol.curve_outliers(f, "mobile", ["spread"], ["grp"]).select("cell_id", "reason")


@query("O07_outlier_summary", f"WITH {IQR} SELECT cell_id, po OR so AS any_outlier, concat_ws(',', CASE WHEN po THEN 'price' END, CASE WHEN so THEN 'spread' END) AS parameters FROM iq")
def o07(spark, sf):
    return ol.outlier_summary(iqr(spark, sf), "cell_id", ["price", "spread"])


@query("O08_prepare", f"WITH {FEAT}, f AS (SELECT * FROM ft WHERE spread IS NOT NULL AND bleach_qc), q AS (SELECT quantile_cont(price, [0.25, 0.5, 0.75]) AS p, quantile_cont(bal, [0.25, 0.5, 0.75]) AS b FROM f) SELECT cell_id, {RD('(price - p[2]) / (p[3] - p[1])')} AS price_scaled, {RD('(bal - b[2]) / (b[3] - b[1])')} AS bal_scaled FROM f, q")
def o08(spark, sf):
    d = ol.prepare(feats(spark, sf).dropna(subset=["spread"]), ["price", "bal"], F.col("bleach_qc"))
    return d.select("cell_id", rd("price_scaled").alias("price_scaled"), rd("bal_scaled").alias("bal_scaled"))


@query("U02_union_outliers", f"WITH {IQR}, z AS (SELECT cell_id, abs((bal - avg(bal) OVER ()) / stddev_pop(bal) OVER ()) > 1.5 AS zo FROM ft) SELECT cell_id FROM iq WHERE po OR so UNION SELECT cell_id FROM z WHERE zo")
def u02(spark, sf):
    return ol.combine(iqr(spark, sf), ol.zscore_flags(feats(spark, sf), "bal", [], 1.5), key="cell_id")


@query("U03_remove_outliers", f"WITH {IQR} SELECT cell_id, grp FROM iq WHERE NOT (po OR so)")
def u03(spark, sf):
    f = feats(spark, sf)
    return ol.remove(f, iqr(spark, sf).filter("outlier"), "cell_id").select("cell_id", "grp")


@query("O09_isolation_forest")
def o09(spark, sf):
    return ol.isolation_forest(feats(spark, sf).select("cell_id", "price", "bal", "n"), "cell_id", ["price", "bal", "n"])


@query("O10_elliptic_envelope")
def o10(spark, sf):
    return ol.elliptic_envelope(cut_lineage(feats(spark, sf).select("cell_id", "price", "bal")), ["price", "bal"]).select("cell_id", "md2", "outlier")


KNN = B3 + ", pt AS (SELECT cell_id, price, bal FROM b3), ds AS (SELECT a.cell_id, b.cell_id AS nb, sqrt(power(a.price - b.price, 2) + power(a.bal - b.bal, 2)) AS d FROM pt a JOIN pt b ON a.cell_id <> b.cell_id), nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY d, nb) - 1 AS pos FROM ds) WHERE pos < {k})"


def points(spark, sf):
    return b.cells(spark, sf).select("cell_id", "price", "bal")


@query("J09_nearest_neighbors", f"WITH {KNN.replace('{k}', '5')} SELECT cell_id, pos, nb, {RD('d', 4)} AS dist FROM nn")
def j09(spark, sf):
    return nb.knn(points(spark, sf), "cell_id", ["price", "bal"], 5).select("cell_id", F.col("pos").cast("long").alias("pos"), "nb", rd("dist", 4).alias("dist"))


@query("O11_local_outlier_factor", f"""WITH {KNN.replace('{k}', '20')}, kd AS (SELECT cell_id, max(d) AS kd FROM nn GROUP BY 1), lr AS (SELECT nn.cell_id, 1 / (avg(greatest(d, kd)) + 1e-10) AS lrd FROM nn JOIN kd ON kd.cell_id = nn.nb GROUP BY 1)
 SELECT nn.cell_id, {RD('avg(z.lrd) / any_value(a.lrd)')} AS lof FROM nn JOIN lr z ON z.cell_id = nn.nb JOIN lr a ON a.cell_id = nn.cell_id GROUP BY 1""")
def o11(spark, sf):
    return nb.local_outlier_factor(points(spark, sf), "cell_id", ["price", "bal"], 20).withColumn("lof", rd("lof"))


@query("O14_dbscan_core", f"WITH {B3}, pt AS (SELECT cell_id, price, bal FROM b3) SELECT a.cell_id, count(*) >= 5 AS core FROM pt a JOIN pt b ON power(a.price - b.price, 2) + power(a.bal - b.bal, 2) <= 900 * 900 GROUP BY 1")
def o14(spark, sf):
    return nb.dbscan(points(spark, sf), "cell_id", ["price", "bal"], 900.0, 5).select("cell_id", "core")


@query("O14_dbscan")
def o14c(spark, sf):
    p = cut_lineage(points(spark, sf))
    return nb.dbscan(p, "cell_id", ["price", "bal"], nb.eps_from_neighbors(p, "cell_id", ["price", "bal"]), 5)


@query("O12_forest_classifier")
def o12(spark, sf):
    d = cut_lineage(ol.iqr_flags(feats(spark, sf), ["price"], factor=0.5).select("cell_id", "price", "spread", "bal", "price_outlier"))
    model, auc, imp = ol.forest_classifier(d, ["price", "spread", "bal"], "price_outlier", folds=5, trees=100)
    return imp.withColumn("auc", F.lit(auc))


@query("O13_mixture")
def o13(spark, sf):
    return cl.mixture(feats(spark, sf).select("cell_id", "price", "bal"), ["price", "bal"], 4, fallback="cell_id")[0].select("cell_id", "cluster", "cluster_prob")


@query("O15_kmeans")
def o15(spark, sf):
    d, sil = cl.kmeans(feats(spark, sf).select("cell_id", "price", "bal"), ["price", "bal"], 3)
    return d.select("cell_id", "cluster").withColumn("silhouette", F.lit(sil))


@query("O16_separation", f"""WITH {FEAT}, c AS (SELECT cluster, count(*) AS n, avg(price) AS cp, avg(bal) AS cb FROM ft GROUP BY 1), s AS (SELECT cluster, any_value(c.n) AS n, any_value(cp) AS cp, any_value(cb) AS cb, sum(power(price - cp, 2) + power(bal - cb, 2)) AS ss, avg(sqrt(power(price - cp, 2) + power(bal - cb, 2))) AS sc FROM ft JOIN c USING (cluster) GROUP BY 1),
 g AS (SELECT avg(price) AS gp, avg(bal) AS gb FROM ft), t AS (SELECT sum(n) AS nn, count(*) AS k, sum(ss) AS w, sum(n * (power(cp - gp, 2) + power(cb - gb, 2))) AS bt FROM s, g), d AS (SELECT a.cluster, max((a.sc + b.sc) / sqrt(power(a.cp - b.cp, 2) + power(a.cb - b.cb, 2))) AS r FROM s a JOIN s b ON a.cluster <> b.cluster GROUP BY 1)
 SELECT k, {RD('(bt / (k - 1)) / (w / (nn - k))', 5)} AS calinski_harabasz, {RD('(SELECT avg(r) FROM d)', 4)} AS davies_bouldin FROM t""")
def o16(spark, sf):
    return cl.separation(feats(spark, sf), ["price", "bal"], "cluster").select("k", rd("calinski_harabasz", 5).alias("calinski_harabasz"), rd("davies_bouldin", 4).alias("davies_bouldin"))


@query("O16_silhouette", f"""WITH {FEAT}, z AS (SELECT cluster, price - avg(price) OVER () AS p, bal - avg(bal) OVER () AS b FROM ft), c AS (SELECT cluster, count(*) AS n, avg(p * p + b * b) AS sq, avg(p) AS cp, avg(b) AS cb FROM z GROUP BY 1),
 d AS (SELECT row_number() OVER () AS i, * FROM z), e AS (SELECT d.i, max(CASE WHEN c.cluster = d.cluster THEN c.n END) AS n, max(CASE WHEN c.cluster = d.cluster THEN d.p * d.p + d.b * d.b + c.sq - 2 * (d.p * c.cp + d.b * c.cb) END) AS own,
 min(CASE WHEN c.cluster <> d.cluster THEN d.p * d.p + d.b * d.b + c.sq - 2 * (d.p * c.cp + d.b * c.cb) END) AS other FROM d, c GROUP BY 1),
 s AS (SELECT n, greatest(0, own * n / nullif(n - 1, 0)) AS a, other AS b FROM e) SELECT {RD('avg(CASE WHEN n > 1 THEN coalesce((b - a) / nullif(greatest(a, b), 0), 0) ELSE 0 END)', 5)} AS silhouette FROM s""")
def o16b(spark, sf):
    return cl.silhouette(feats(spark, sf), ["price", "bal"], "cluster").select(rd("silhouette", 5).alias("silhouette"))


@query("O17_subpopulations")
def o17(spark, sf):
    return cl.subpopulations(feats(spark, sf).select("cell_id", "price", "bal"), "cell_id", ["price", "bal"]).select("cell_id", "outlier", "cluster", "cluster_prob")


@query("O18_kinetic_subpopulations")
def o18(spark, sf):
    return cl.kinetic_subpopulations(feats(spark, sf), "cell_id", "grp", "price", "spread")


@query("G13_state_assignment")
def g13(spark, sf):
    from rekurve.operators import tracks as tr

    s = tr.steps(b.tracks(spark, sf)).dropna(subset=["step"]).select("track_id", "frame", "step", "angle")
    return cl.mixture(s, ["step", "angle"], 4, None)[0].select("track_id", "frame", F.col("cluster").alias("state"), "cluster_prob")


# ---- streaming ---------------------------------------------------------------------------------------------------------
def event_stream(spark, sf):
    schema = b.table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


@query("Z01_live_bleach", f"WITH {B1}, d AS (SELECT curve_id, frame, y, lag(y) OVER (PARTITION BY curve_id ORDER BY frame) AS p FROM b1), k AS (SELECT curve_id, min(frame) FILTER ((p - y) / p > 0.3) AS bleach FROM d GROUP BY 1) SELECT curve_id, any_value(bleach) AS bleach, {RD('avg(y)')} AS pre_mean FROM b1 JOIN k USING (curve_id) WHERE frame < bleach GROUP BY 1")
def z01(spark, sf):
    s = event_stream(spark, sf).select(F.col("user_id").alias("curve_id"), F.expr("unix_micros(cast(ts as timestamp))").alias("us"), "event_id", F.col("value").alias("y"))
    return live.run_available(live.live_bleach(s), shared_scratch(spark, "live")).withColumn("pre_mean", rd("pre_mean"))


@query("Z02_live_positions")
def z02(spark, sf):
    schema = b.table(spark, sf, "embeddings").schema
    e = spark.readStream.schema(schema).option("pathGlobFilter", "embeddings.parquet").parquet(sf)
    s = e.select(F.col("label").cast("long").alias("track_id"), F.col("vec_id").alias("seq"), (F.col("embedding")[0].cast("double") * 100).alias("x"), (F.col("embedding")[1].cast("double") * 100).alias("y"))
    return live.run_available(live.live_positions(s), shared_scratch(spark, "live"))


@query("Z03_live_means", f"""WITH l AS (SELECT max(ts) - INTERVAL 10 MINUTE AS wm FROM events) SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type AS grp, {RD('avg(value)')} AS mean, count(*) AS n FROM events, l WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= wm GROUP BY 1, 2""")
def z03(spark, sf):
    m = live.live_means(event_stream(spark, sf).select(F.expr("cast(concat(cast(ts as string), 'Z') as timestamp)").alias("ts"), F.col("event_type").alias("grp"), "value"), "ts", "grp", "value")
    r = live.run_available(m, shared_scratch(spark, "live"))
    return r.select(F.date_format(F.to_utc_timestamp("start", F.current_timezone()), "yyyy-MM-dd").alias("day"), "grp", rd("mean").alias("mean"), "n")


# ---- user functions ----------------------------------------------------------------------------------------------------
@query("V02_model_registry")
def v02(spark, sf):
    if "hyperbolic" not in MODELS:
        register(Model("hyperbolic", lambda t, tau: t / (t + tau), lambda lo, hi: [list(np.geomspace(lo, 20 * hi, 40))]))
    c = cut_lineage(b.curves(spark, sf).select("curve_id", "t", "y"))
    return fit.profile_fit(c, ["curve_id"], "hyperbolic")


@query("V03_curve_function", f"WITH {B1} SELECT curve_id, count(*) AS n, {RD('max(y) - min(y)')} AS span FROM b1 GROUP BY 1")
def v03(spark, sf):
    from rekurve.operators.user import per_curve

    def span(pdf):
        return {"n": len(pdf), "lo": float(pdf["y"].min()), "hi": float(pdf["y"].max())}

    parts = per_curve(b.curves(spark, sf), span, "n long, lo double, hi double")
    return parts.groupBy("curve_id").agg(F.sum("n").alias("n"), rd(F.max("hi") - F.min("lo")).alias("span"))
