"""Registered queries: curve models (2.9) and fitting (2.10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rekurve.functions import models as mo, tails
from rekurve.operators import align as al, bleach as bl, fit, fit_metrics as fm, intervals as iv, normalize as nz, ordered as od, quality as ql
from rekurve.plans import bindings as b, workflows as wf
from rekurve.plans.bindings import B1
from rekurve.plans.catalog_curves import ANCH
from rekurve.plans.registry import RD, query, rd
from rekurve.plans.session import cut_lineage

K = ["curve_id"]


# ---- models: the same text runs in both engines ------------------------------------------------------------------------
def model_query(name: str, text: str, digits: int = 6):
    @query(name, f"WITH {B1} SELECT curve_id, frame, {RD(text, digits)} AS v FROM b1")
    def run(spark, sf, text=text):
        return b.curves(spark, sf).select("curve_id", "frame", rd(F.expr(text), digits).alias("v"))


model_query("M01_single", f"{mo.single('t', '0.7', '3.5', '0.1')} + {mo.plateau_form('t', '0.8', '0.7', '0.25')}")
model_query("M02_double", mo.double("t", "0.5", "2.0", "0.3", "40.0", "0.05"))
model_query("M03_triple", mo.triple("t", "0.3", "0.5", "0.3", "4.0", "0.2", "30.0", "0.05"))
model_query("M04_soumpasis", mo.soumpasis("t", "2.5", "0.8", "0.1"))
model_query("M04_soumpasis_reference", mo.soumpasis("t", "2.5", "0.8", "0.1", "reference"))
model_query("M05_reaction_diffusion", mo.reaction_diffusion("t", "0.8", "0.3", "0.1", "1.5", "0.1"))
model_query("M06_diffusion_binding", mo.two_rate_binding("t", "0.4", "1.2", "0.3", "0.1", "0.2"))
model_query("M07_two_binding_sites", mo.three_rate_binding("t", "0.4", "1.2", "0.2", "0.3", "0.1", "0.05", "0.2"))
model_query("M08_stretched", f"{mo.stretched('t', '0.7', '3.0', '0.6', '0.1')} + {mo.double_stretched('t', '0.4', '1.0', '0.9', '0.3', '9.0', '0.5', '0.1')}")
model_query("M09_power_law", mo.power_law("t", "0.7", "0.1", "0.4", "0.8"))
model_query("M10_reaction_diffusion_full", f"{mo.reaction_diffusion_full('t', '0.1', '0.8', '0.3', '0.2', '0.5', '1.2')} + {mo.reaction_diffusion_simple('t', '0.1', '0.3', '0.4', '0.2', '0.5', '1.2')}")
model_query("M11_reaction_dominant", mo.reaction_dominant("t", "0.8", "0.1", "0.25"))
model_query("M12_recruitment", f"{mo.single('t', '2.0', '4.0', '1.0')} + {mo.double('t', '1.0', '2.0', '0.5', '9.0', '1.0')} + {mo.sigmoid('t', '2.0', '0.8', '5.0', '1.0')}")
model_query("M13_expansion", " + ".join(mo.expansion("t", k, "1.0", "0.5", "0.7") for k in ("exponential", "linear", "power")))
model_query("M15_random_walk", mo.random_walk("t", "0.2", "0.8", "3.0", "0.7"))


@query("M16_spectrum_basis", f"WITH {B1} SELECT curve_id, i, {RD('avg(1 - exp(-t / power(2.0, i)))')} AS m FROM b1, range(0, 8) r(i) GROUP BY 1, 2")
def m16(spark, sf):
    d = b.curves(spark, sf).groupBy(*K).agg(*[F.avg(1 - F.exp(-F.col("t") / 2.0**i)).alias(f"m{i}") for i in range(8)])
    return d.select("curve_id", F.posexplode(F.array(*[f"m{i}" for i in range(8)])).alias("i", "m")).select("curve_id", F.col("i").cast("long").alias("i"), rd("m").alias("m"))


@query("M17_robust_losses", f"""WITH {B1}, r AS (SELECT curve_id, frame, y / 100.0 - 2 AS r FROM b1) SELECT curve_id, frame, {RD('CASE WHEN abs(r) <= 1 THEN 0.5 * r * r ELSE abs(r) - 0.5 END')} AS huber,
 {RD('CASE WHEN abs(r) <= 2 THEN 4.0 / 6 * (1 - power(1 - r * r / 4, 3)) ELSE 4.0 / 6 END')} AS tukey, {RD('2 * 0.01 * (sqrt(1 + r * r / 0.01) - 1)')} AS soft, {RD('CASE WHEN abs(r) <= 1 THEN 1 ELSE 1 / abs(r) END')} AS wh,
 {RD('CASE WHEN abs(r) <= 2 THEN power(1 - r * r / 4, 2) ELSE 0 END')} AS wt FROM r""")
def m17(spark, sf):
    r = F.col("y") / 100.0 - 2
    return b.curves(spark, sf).select("curve_id", "frame", rd(mo.huber(r)).alias("huber"), rd(mo.tukey(r, 2.0)).alias("tukey"), rd(mo.soft_l1(r)).alias("soft"), rd(mo.huber_weight(r)).alias("wh"), rd(mo.tukey_weight(r, 2.0)).alias("wt"))


@query("M18_hierarchical_forward", f"""WITH {B1}, p AS (SELECT curve_id, 1 / (1 + exp(-(avg(y) / 100 - 2))) AS m, exp(stddev_samp(y) / 500) AS k FROM b1 GROUP BY 1)
 SELECT curve_id, frame, {RD('0.1 + m * (1 - exp(-k * t))')} AS one, {RD('0.1 + m * (0.6 * (1 - exp(-(k + 0.5) * t)) + 0.4 * (1 - exp(-k * t)))')} AS two FROM b1 JOIN p USING (curve_id)""")
def m18(spark, sf):
    from rekurve.operators.ordered import attach

    d = attach(b.curves(spark, sf), K, m=lambda o: ql.inverse_logit(o(F.avg("y")) / 100 - 2), k=lambda o: F.exp(o(F.stddev_samp("y")) / 500))
    slow, fast = ql.ordered_rates(F.col("k"), F.lit(0.5))
    r = lambda k: 1 - F.exp(-k * F.col("t"))
    return d.select("curve_id", "frame", rd(0.1 + F.col("m") * r(slow)).alias("one"), rd(0.1 + F.col("m") * (0.6 * r(fast) + 0.4 * r(slow))).alias("two"))


# ---- first rounds: exact oracles ---------------------------------------------------------------------------------------
def span_sql(key: str, rows: str) -> str:
    hi = "(CASE WHEN max(t_rel) > 0 THEN max(t_rel) ELSE 1.0 END)"
    return f"sp AS (SELECT {key}, greatest(coalesce(min(t_rel) FILTER (t_rel > 0), 1e-3), {hi} * 1e-4) AS lo, {hi} AS hi FROM {rows} GROUP BY 1)"


SPAN = ANCH + ", " + span_sql("curve_id", "an")


def anchored(spark, sf):
    return nz.bleach_anchored(b.curves(spark, sf)).select("curve_id", "frame", F.col("t_rel").alias("t"), F.col("norm").alias("y"))


def geo(lo: str, hi: str, n: int) -> str:
    return f"({lo}) * power(({hi}) / ({lo}), i / {n - 1}.0)"


def profile_sql(p0: str, n0: int, p1: str | None, n1: int, basis: str, unbounded: bool = False) -> str:
    a = "coalesce(sxy / nullif(sxx, 0), 0)" if unbounded else "greatest(0, coalesce(sxy / nullif(sxx, 0), 0))"
    second = f", {p1} AS p1" if p1 else ", NULL::DOUBLE AS p1"
    return f"""WITH {SPAN}, cand AS (SELECT curve_id, i * {n1} + j AS c, {p0} AS p0{second} FROM sp, range(0, {n0}) a(i), range(0, {n1}) b(j)),
 x AS (SELECT curve_id, c, p0, p1, norm AS y, {basis} AS x FROM (SELECT curve_id, norm, t_rel AS t FROM an) JOIN cand USING (curve_id)),
 mo AS (SELECT curve_id, c, any_value(p0) AS p0, any_value(p1) AS p1, count(*) AS n, regr_sxx(y, x) AS sxx, regr_sxy(y, x) AS sxy, regr_syy(y, x) AS syy, sum(x * x) AS qx FROM x GROUP BY 1, 2),
 rs AS (SELECT *, {a} AS amp, greatest(0, syy - 2 * {a} * sxy + {a} * {a} * sxx) AS rss FROM mo WHERE sxx > 1e-9 * qx AND qx > 1e-100),
 ms AS (SELECT *, min(rss) OVER (PARTITION BY curve_id) AS ml FROM rs), bs AS (SELECT *, row_number() OVER (PARTITION BY curve_id ORDER BY rss > ml + 1e-9 * syy, c) AS rn FROM ms)
, nn AS (SELECT curve_id, count(*) AS n FROM an GROUP BY 1)
 SELECT nn.curve_id, nn.n, CASE WHEN amp > 0 THEN {RD('p0', 5)} END AS p0, {RD('rss / greatest(syy, 1e-12)', 5)} AS unexplained FROM nn LEFT JOIN bs ON bs.curve_id = nn.curve_id AND rn = 1"""


def profile_query(name: str, model: str, sql: str, unbounded: bool = False):
    @query(name, sql)
    def run(spark, sf):
        amp = (-float("inf"), float("inf")) if unbounded else (0.0, float("inf"))
        r = fit.profile_round(cut_lineage(anchored(spark, sf)), K, model, amp=amp)
        return r.select("curve_id", "n", F.when(F.col("amp") > 0, rd("_k0", 5)).alias("p0"), rd(F.col("rss") / F.greatest(F.col("sst"), F.lit(1e-12)), 5).alias("unexplained"))


profile_query("F04_fit_soumpasis_round", "soumpasis", profile_sql(geo("lo / 4", "20 * hi", 40), 40, None, 1, mo.bessel_kernel("(2 * p0 / greatest(t, 1e-12))")))
profile_query("F07_fit_anomalous_round", "anomalous", profile_sql(geo("lo", "20 * hi", 24), 24, "[0.2, 0.35, 0.5, 0.65, 0.8, 1.0][j + 1]::DOUBLE", 6, "1 - exp(-power(greatest(t, 0) / p0, p1))"))
profile_query("F08_fit_sigmoid_round", "sigmoid", profile_sql(geo("0.5 / hi", "1 / lo", 16), 16, "hi * [0.0, 0.1, 0.2, 0.35, 0.5, 0.75][j + 1]::DOUBLE", 6, "1 / (1 + exp(least(700, greatest(-700, -p0 * (t - p1)))))"))
profile_query("F09_fit_expansion_round", "expansion_power", profile_sql("0.1 * (i + 1)", 20, None, 1, "power(greatest(t, 0), p0)", True), True)
profile_query("N24_exponential_trend_round", "decay", profile_sql(geo("0.05 / hi", "1 / lo", 40), 40, None, 1, "exp(-p0 * t)"))


@query("F01_fit_single_round", profile_sql(geo("lo", "20 * hi", 40), 40, None, 1, "1 - exp(-t / p0)").replace(
    "SELECT nn.curve_id, nn.n, CASE WHEN amp > 0", f"SELECT nn.curve_id, {RD('CASE WHEN nn.n > 5 AND rss IS NOT NULL THEN nn.n * ln(greatest(rss, 1e-300) / nn.n) + 6 END', 4)} AS aic, nn.n, CASE WHEN amp > 0"))
def f01(spark, sf):
    r = fit.profile_round(cut_lineage(anchored(spark, sf)), K, "single")
    aic = F.when((F.col("n") > 5) & F.col("rss").isNotNull(), F.col("n") * F.ln(F.greatest(F.col("rss"), F.lit(1e-300)) / F.col("n")) + 6)
    return r.select("curve_id", "n", F.when(F.col("amp") > 0, rd("_k0", 5)).alias("p0"), rd(F.col("rss") / F.greatest(F.col("sst"), F.lit(1e-12)), 5).alias("unexplained"), rd(aic, 4).alias("aic"))


# first round of one, two and three rates on an 18-point lattice
EX = SPAN + """, la AS (SELECT curve_id, i, lo * power(5 * hi / lo, i / 17.0) AS tau FROM sp, range(0, 18) r(i)), ex AS (SELECT curve_id, frame, i, norm AS y, 1 - exp(-t_rel / tau) AS x FROM an JOIN la USING (curve_id)),
 cy AS (SELECT curve_id, i, count(*) AS n, covar_pop(x, y) * count(*) AS c, regr_syy(y, x) AS syy FROM ex GROUP BY 1, 2),
 gm AS (SELECT a.curve_id, a.i, b.i AS j, covar_pop(a.x, b.x) * count(*) AS g FROM ex a JOIN ex b ON a.curve_id = b.curve_id AND a.frame = b.frame AND a.i <= b.i GROUP BY 1, 2, 3),
 o1 AS (SELECT curve_id, i, syy - c * c / g AS rss, n, syy, c / g AS m FROM cy JOIN gm USING (curve_id, i) WHERE i = j AND g > 0 AND c / g >= 0),
 cr AS (SELECT g.curve_id, g.i, g.j, g.g / sqrt(a.g * b.g) AS r FROM gm g JOIN gm a ON a.curve_id = g.curve_id AND a.i = g.i AND a.j = g.i JOIN gm b ON b.curve_id = g.curve_id AND b.i = g.j AND b.j = g.j WHERE g.i < g.j AND a.g > 0 AND b.g > 0),
 sc AS (SELECT cy.curve_id, cy.i, n, syy, c / sqrt(g) AS q, sqrt(g) AS s FROM cy JOIN gm USING (curve_id, i) WHERE i = j AND g > 0),
 o2 AS (SELECT cr.curve_id, cr.i, cr.j, a.n, a.syy, (a.q - r * b.q) / (1 - r * r) AS m1, (b.q - r * a.q) / (1 - r * r) AS m2, a.syy - (a.q * (a.q - r * b.q) + b.q * (b.q - r * a.q)) / (1 - r * r) AS rss
   FROM cr JOIN sc a ON a.curve_id = cr.curve_id AND a.i = cr.i JOIN sc b ON b.curve_id = cr.curve_id AND b.i = cr.j WHERE 1 - r * r > 1e-9),
 t3 AS (SELECT x.curve_id, x.i, x.j, y.j AS k, x.r AS a, y.r AS c, z.r AS b, 1 + 2 * x.r * y.r * z.r - x.r * x.r - y.r * y.r - z.r * z.r AS det FROM cr x JOIN cr y ON y.curve_id = x.curve_id AND y.i = x.j JOIN cr z ON z.curve_id = x.curve_id AND z.i = x.i AND z.j = y.j),
 o3 AS (SELECT t3.curve_id, p.n, p.syy, ((1 - c * c) * p.q + (b * c - a) * q.q + (a * c - b) * s.q) / det AS m1, ((b * c - a) * p.q + (1 - b * b) * q.q + (a * b - c) * s.q) / det AS m2,
   ((a * c - b) * p.q + (a * b - c) * q.q + (1 - a * a) * s.q) / det AS m3, p.q AS q1, q.q AS q2, s.q AS q3 FROM t3 JOIN sc p ON p.curve_id = t3.curve_id AND p.i = t3.i JOIN sc q ON q.curve_id = t3.curve_id AND q.i = t3.j
   JOIN sc s ON s.curve_id = t3.curve_id AND s.i = t3.k WHERE det > 1e-9),
 r1 AS (SELECT curve_id, min(rss) AS rss, max(n) AS n, max(syy) AS sst FROM (SELECT curve_id, rss, n, syy FROM o1 UNION ALL SELECT curve_id, NULL, count(*), var_pop(norm) * count(*) FROM an GROUP BY 1) GROUP BY 1),
 r2 AS (SELECT curve_id, min(rss) AS rss, any_value(n) AS n, any_value(syy) AS sst FROM (SELECT curve_id, rss, n, syy FROM o2 WHERE m1 >= 0 AND m2 >= 0 UNION ALL SELECT curve_id, rss, n, sst FROM r1) GROUP BY 1),
 r3 AS (SELECT curve_id, min(rss) AS rss, any_value(n) AS n, any_value(syy) AS sst FROM (SELECT curve_id, syy - m1 * q1 - m2 * q2 - m3 * q3 AS rss, n, syy FROM o3 WHERE m1 >= 0 AND m2 >= 0 AND m3 >= 0 UNION ALL SELECT curve_id, rss, n, sst FROM r2) GROUP BY 1),
 fx AS (SELECT curve_id, 'single' AS model, 3 AS p, n, CASE WHEN rss < 0 THEN 0 ELSE rss END AS rss, sst FROM r1 UNION ALL SELECT curve_id, 'double', 5, n, CASE WHEN rss < 0 THEN 0 ELSE rss END, sst FROM r2 UNION ALL SELECT curve_id, 'triple', 7, n, CASE WHEN rss < 0 THEN 0 ELSE rss END, sst FROM r3)"""
# criteria; a model with too many parameters for the points has infinite information criteria
FX = EX + """, fk AS (SELECT *, CASE WHEN sst = 0 THEN 0 ELSE 1 - rss / sst END AS r2, CASE WHEN n <= p + 2 THEN 'inf'::DOUBLE WHEN rss > 0 THEN n * ln(rss / n) + 2 * p END AS aic,
 CASE WHEN n <= p + 2 THEN 'inf'::DOUBLE WHEN rss > 0 THEN n * ln(rss / n) + p * ln(n) END AS bic, CASE WHEN n <= p + 2 THEN 'inf'::DOUBLE WHEN rss > 0 THEN n * ln(rss / n) + 2 * p + 2.0 * p * (p + 1) / (n - p - 1) END AS aicc,
 CASE WHEN n > p + 1 THEN 1 - (1 - (CASE WHEN sst = 0 THEN 0 ELSE 1 - rss / sst END)) * (n - 1) / (n - p - 1) END AS adj_r2, CASE WHEN n > p THEN rss / (n - p) END AS red_chi2 FROM fx)"""


def lattice_fits(spark, sf, orders=(1, 2, 3)):
    return fit.exponential_round(cut_lineage(anchored(spark, sf)), K, orders)


def scored(spark, sf):
    return cut_lineage(fm.add_criteria(lattice_fits(spark, sf)))


for _o, _n, _name in ((2, "double", "F02_fit_double_round"), (3, "triple", "F03_fit_triple_round")):

    @query(_name, f"WITH {EX} SELECT curve_id, n, {RD('rss / greatest(sst, 1e-12)', 5)} AS unexplained FROM fx WHERE model = '{_n}'")
    def _round(spark, sf, o=_o):
        return lattice_fits(spark, sf, (o,)).select("curve_id", "n", rd(F.col("rss") / F.greatest(F.col("sst"), F.lit(1e-12)), 5).alias("unexplained"))


CRIT = ["r2", "adj_r2", "aic", "bic", "aicc", "red_chi2"]


@query("F13_fit_metrics", f"WITH {FX} SELECT curve_id, model, n, p, {', '.join(RD(c, 4) + ' AS ' + c for c in CRIT)} FROM fk")
def f13(spark, sf):
    return scored(spark, sf).select("curve_id", "model", "n", "p", *[rd(c, 4).alias(c) for c in CRIT])


@query("F16_best_model", f"WITH {FX} SELECT curve_id, model, {RD('aicc', 4)} AS aicc, {RD('r2', 5)} AS r2 FROM (SELECT *, row_number() OVER (PARTITION BY curve_id ORDER BY coalesce(aicc, 'inf'::DOUBLE), p, model) AS rn FROM fk) WHERE rn = 1")
def f16(spark, sf):
    return fm.choose_best(scored(spark, sf), K, "aicc").select("curve_id", "model", rd("aicc", 4).alias("aicc"), rd("r2", 5).alias("r2"))


@query("T01_model_ranks", f"WITH {FX} SELECT curve_id, model, row_number() OVER (PARTITION BY curve_id ORDER BY aic, bic, model) AS rank FROM fk")
def t01(spark, sf):
    return fm.rank_models(scored(spark, sf), K, ["aic", "bic"]).select("curve_id", "model", "rank")


@query("F17_delta_buckets", f"""WITH {FX}, d AS (SELECT curve_id, model, round(aic - min(aic) OVER (PARTITION BY curve_id), 6) AS d FROM fk) SELECT curve_id, model, CASE WHEN d IS NULL OR isnan(d) THEN NULL WHEN d < 2 THEN 'substantial support' WHEN d >= 4 AND d <= 7 THEN 'considerably less support'
 WHEN d > 10 THEN 'essentially no support' ELSE 'moderate support' END AS support FROM d""")
def f17(spark, sf):
    d = fm.with_deltas(scored(spark, sf), K, "aic")
    return d.select("curve_id", "model", ql.delta_aic_bucket(F.col("delta")).alias("support"))


@query("F18_parsimonious", f"WITH {FX} SELECT a.curve_id, CASE WHEN a.n >= 6 AND isfinite(b.bic) AND a.bic - b.bic > 10 THEN 'double' ELSE 'single' END AS model FROM fk a JOIN fk b ON a.curve_id = b.curve_id AND a.model = 'single' AND b.model = 'double'")
def f18(spark, sf):
    s = scored(spark, sf)
    return fm.parsimonious(s.filter("model = 'single'"), s.filter("model = 'double'"), K).select("curve_id", "model")


@query("F19_akaike_weights", f"""WITH {FX}, d AS (SELECT curve_id, model, CASE WHEN isfinite(min(aicc) OVER (PARTITION BY curve_id)) THEN aicc - min(aicc) OVER (PARTITION BY curve_id) END AS d FROM fk) SELECT curve_id, model, {RD('exp(-d / 2) / sum(exp(-d / 2)) OVER (PARTITION BY curve_id)', 4)} AS weight,
 coalesce(sum((d < 2)::INT) OVER (PARTITION BY curve_id) > 1, false) AS ambiguous FROM d""")
def f19(spark, sf):
    return fm.with_deltas(scored(spark, sf), K).select("curve_id", "model", rd("weight", 4).alias("weight"), "ambiguous")


@query("F20_nested_f", f"""WITH {FX} SELECT a.curve_id, {RD('CASE WHEN b.n > 5 AND b.rss > 0 THEN ((a.rss - b.rss) / 2) / (b.rss / (b.n - 5)) END', 3)} AS f_stat, b.n - 5 AS df2 FROM fk a JOIN fk b ON a.curve_id = b.curve_id AND a.model = 'single' AND b.model = 'double'""")
def f20(spark, sf):
    s = scored(spark, sf)
    return fm.f_statistic(s.filter("model = 'single'"), s.filter("model = 'double'"), K).select("curve_id", rd("f_stat", 3).alias("f_stat"), "df2")


@query("F20_nested_f_p")
def f20p(spark, sf):
    s = scored(spark, sf)
    f = fm.f_statistic(s.filter("model = 'single'"), s.filter("model = 'double'"), K).withColumn("p_value", tails.f_upper(F.col("f_stat"), F.col("df1"), F.col("df2")))
    return f.withColumn("complex", fm.prefers_complex(F.col("p_value"), F.col("d_aic"), F.col("d_bic")))


@query("F21_stepwise_model")
def f21(spark, sf):
    s = scored(spark, sf)
    return wf.nested_choice(*[s.filter(F.col("model") == m) for m in ("single", "double", "triple")], K)


@query("F24_consensus_model", f"WITH {FX}, e AS (SELECT model, aicc - min(aicc) OVER (PARTITION BY curve_id) AS e FROM fk WHERE isfinite(aicc)) SELECT model, count(*) AS curves, {RD('sum(e)', 2)} AS excess FROM e GROUP BY 1")
def f24(spark, sf):
    return fm.consensus(scored(spark, sf), K).select("model", "curves", rd("excess", 2).alias("excess"))


@query("A20_model_wins", f"""WITH {FX}, w AS (SELECT model, count(*) AS wins FROM (SELECT *, row_number() OVER (PARTITION BY curve_id ORDER BY aicc, p, model) AS rn FROM fk WHERE isfinite(aicc)) WHERE rn = 1 GROUP BY 1)
 SELECT fk.model, {RD('avg(r2)', 5)} AS mean_r2, {RD('avg(aicc) FILTER (isfinite(aicc))', 3)} AS mean_aicc, coalesce(any_value(wins), 0) AS wins FROM fk LEFT JOIN w USING (model) GROUP BY 1""")
def a20(spark, sf):
    return fm.model_wins(scored(spark, sf), K).select("model", rd("mean_r2", 5).alias("mean_r2"), rd("mean_aicc", 3).alias("mean_aicc"), "wins")


@query("F15_diffusion", f"WITH {b.B3} SELECT cell_id, {RD('4.0 / (4.0 * n)')} AS d_tau, {RD('4.0 * ln(2) / (4.0 * n)')} AS d_half, {RD('0.224 * 4.0 / n')} AS d_circular FROM b3")
def f15(spark, sf):
    n = F.col("n").cast("double")
    return b.cells(spark, sf).select("cell_id", rd(fm.diffusion_from_tau(n, 2.0)).alias("d_tau"), rd(fm.diffusion_from_half_time(n, 2.0)).alias("d_half"), rd(fm.diffusion_circular(n, 2.0)).alias("d_circular"))


COMP = """cm AS (SELECT vec_id, list_sort([embedding[1]::DOUBLE + 1, embedding[2]::DOUBLE + 2, embedding[3]::DOUBLE + 3]) AS taus, [abs(embedding[4]::DOUBLE), abs(embedding[5]::DOUBLE), abs(embedding[6]::DOUBLE)] AS amps FROM embeddings)"""


def components(spark, sf):
    e = lambda i: F.col("embedding")[i].cast("double")
    return b.table(spark, sf, "embeddings").select("vec_id", F.lit("triple").alias("model"), F.lit(0.1).alias("baseline"), F.array(*[F.abs(e(i)) for i in (3, 4, 5)]).alias("amps"), F.array_sort(F.array(*[e(i) + i + 1 for i in range(3)])).alias("taus"))


@query("T03_sorted_components", f"WITH {COMP} SELECT vec_id, i, {RD('taus[i + 1]')} AS tau FROM cm, range(0, 3) r(i)")
def t03(spark, sf):
    return components(spark, sf).select("vec_id", F.posexplode("taus").alias("i", "tau")).select("vec_id", F.col("i").cast("long").alias("i"), rd("tau").alias("tau"))


@query("F29_component_features", f"""WITH {COMP}, s AS (SELECT *, amps[1] + amps[2] + amps[3] AS tot FROM cm) SELECT vec_id, {RD('1 / taus[1]')} AS rate_constant_fast, {RD('1 / taus[2]')} AS rate_constant_medium, {RD('1 / taus[3]')} AS rate_constant_slow,
 {RD('taus[1] * ln(2)')} AS half_time_fast, {RD('amps[1] / tot * 100')} AS proportion_of_mobile_fast, {RD('amps[3] / tot * 100')} AS proportion_of_mobile_slow, {RD('(0.1 + tot) * 100')} AS plateau_pct FROM s""")
def f29(spark, sf):
    c = fm.component_features(components(spark, sf))
    cols = ["rate_constant_fast", "rate_constant_medium", "rate_constant_slow", "half_time_fast", "proportion_of_mobile_fast", "proportion_of_mobile_slow", "plateau_pct"]
    return c.select("vec_id", *[rd(x).alias(x) for x in cols])


# ---- complete fits -----------------------------------------------------------------------------------------------------
def post(spark, sf):
    return cut_lineage(bl.post_bleach(b.curves(spark, sf)).select("curve_id", "frame", "t_post", "y_post"))


def every(spark, sf, found):
    """A row at least for every curve that there is."""
    return wf.every_curve(found, b.curves(spark, sf).select("curve_id").distinct(), K)


@query("F01_fit_single")
def f01full(spark, sf):
    return every(spark, sf, fm.add_criteria(fit.profile_fit(post(spark, sf), K, "single", "t_post", "y_post")))


@query("F02_fit_double")
def f02full(spark, sf):
    return every(spark, sf, fm.add_criteria(fit.exponential_fits(post(spark, sf), K, (2,), "t_post", "y_post")))


@query("F03_fit_triple")
def f03full(spark, sf):
    return every(spark, sf, fm.add_criteria(fit.exponential_fits(post(spark, sf), K, (3,), "t_post", "y_post")))


@query("F04_fit_soumpasis")
def f04full(spark, sf):
    return every(spark, sf, fm.add_criteria(fit.profile_fit(post(spark, sf), K, "soumpasis", "t_post", "y_post")))


@query("F05_fit_reaction_diffusion")
def f05(spark, sf):
    return every(spark, sf, wf.reaction_rates(fit.exponential_fits(post(spark, sf), K, (2,), "t_post", "y_post")))


@query("F06_fit_two_site_binding")
def f06(spark, sf):
    return every(spark, sf, wf.two_site_rates(fit.exponential_fits(post(spark, sf), K, (3,), "t_post", "y_post")))


@query("F07_fit_anomalous")
def f07(spark, sf):
    f = fm.add_criteria(fit.profile_fit(post(spark, sf), K, "anomalous", "t_post", "y_post"))
    return every(spark, sf, f.withColumn("diffusion_type", ql.diffusion_type(F.col("p1"))))


@query("F07_fit_power_law")
def f07p(spark, sf):
    return every(spark, sf, fm.add_criteria(fit.profile_fit(post(spark, sf), K, "power_law", "t_post", "y_post")))


@query("F08_recruitment_models")
def f08(spark, sf):
    return wf.recruitment_models(cut_lineage(b.curves(spark, sf).select("curve_id", "t", "y")), K)


@query("F09_expansion_models")
def f09(spark, sf):
    return wf.expansion_models(cut_lineage(b.curves(spark, sf).select("curve_id", "t", "y")), K)


@query("F10_damage_experiment")
def f10(spark, sf):
    c = b.curves(spark, sf)
    ev = bl.bleach_at_minimum(c).withColumnRenamed("bleach", "damage").join(bl.bleach_at_steepest(c), K)
    return wf.damage_experiment(cut_lineage(c.join(ev, K).select("curve_id", "frame", "t", "y", "damage", "bleach")), K)


@query("F11_robust_fits")
def f11(spark, sf):
    p = post(spark, sf)
    parts = [fit.profile_fit(p, K, "single", "t_post", "y_post", robust=r) for r in ("soft_l1", "huber", "tukey")]
    return every(spark, sf, parts[0].unionByName(parts[1]).unionByName(parts[2]))


@query("F12_fit_all_models")
def f12(spark, sf):
    return every(spark, sf, wf.fit_all_models(post(spark, sf), K))


@query("F14_parameter_intervals")
def f14(spark, sf):
    p = post(spark, sf)
    return every(spark, sf, wf.single_intervals(p, fit.profile_fit(p, K, "single", "t_post", "y_post"), K, "t_post", "y_post"))


def interval_query(name: str, model: str, quantile: str = "normal"):
    @query(name)
    def run(spark, sf):
        p = post(spark, sf)
        f = fit.exponential_fits(p, K, (iv.SUMS[model],), "t_post", "y_post") if model in iv.SUMS else fit.profile_fit(p, K, model, "t_post", "y_post")
        return every(spark, sf, iv.parameter_intervals(p, f, K, model, "t_post", "y_post", quantile=quantile))


interval_query("F14_intervals_double", "double")
interval_query("F14_intervals_triple", "triple", "t")
interval_query("F14_intervals_anomalous", "anomalous")
interval_query("F14_intervals_soumpasis", "soumpasis")


def grouped_post(spark, sf):
    p = bl.post_bleach(b.curves(spark, sf)).join(b.curve_groups(spark, sf), "curve_id")
    return cut_lineage(p.select("grp", "curve_id", F.col("t_post").alias("t"), F.col("y_post").alias("y")))


GLOBAL = ANCH + f""", {b.GRP}, {span_sql("grp", "an JOIN grp USING (curve_id)")}, cand AS (SELECT grp, i, {geo('lo', '20 * hi', 40)} AS tau FROM sp, range(0, 40) r(i)), mo AS (SELECT grp, curve_id, i, any_value(tau) AS tau, regr_sxx(norm, 1 - exp(-t_rel / tau)) AS sxx, regr_sxy(norm, 1 - exp(-t_rel / tau)) AS sxy,
 regr_syy(norm, 1 - exp(-t_rel / tau)) AS syy, sum(power(1 - exp(-t_rel / tau), 2)) AS qx FROM an JOIN grp USING (curve_id) JOIN cand USING (grp) GROUP BY 1, 2, 3),
 rs AS (SELECT *, CASE WHEN sxx > 1e-9 * qx THEN greatest(0, syy - greatest(0, sxy) * greatest(0, sxy) / sxx) ELSE syy END AS rss FROM mo), tt AS (SELECT grp, i, any_value(tau) AS tau, sum(rss) AS rss FROM rs GROUP BY 1, 2)"""


@query("F22_global_single_round", f"WITH {GLOBAL} SELECT grp, {RD('tau', 5)} AS tau, {RD('rss', 3)} AS rss FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY rss, i) AS rn FROM tt) WHERE rn = 1")
def f22r(spark, sf):
    a = cut_lineage(anchored(spark, sf).join(b.curve_groups(spark, sf), "curve_id").select("grp", "curve_id", "t", "y"))
    return fit.global_profile_fit(a, ["grp"], ["curve_id"], "single", rounds=0)[0].select("grp", rd("p0", 5).alias("tau"), rd("rss", 3).alias("rss"))


@query("F22_global_fit")
def f22(spark, sf):
    return fm.add_criteria(fit.global_exponential_fit(grouped_post(spark, sf), ["grp"], ["curve_id"], 2)[0])


@query("F22_global_anomalous")
def f22a(spark, sf):
    return fit.global_profile_fit(grouped_post(spark, sf), ["grp"], ["curve_id"], "anomalous")[0]


@query("F23_unified_workflow")
def f23(spark, sf):
    return wf.unified_workflow(grouped_post(spark, sf), ["grp"], ["curve_id"])


def aligned_groups(spark, sf):
    a = nz.bleach_anchored(b.curves(spark, sf))
    d = od.reindex(a, F.col("frame") - F.col("bleach")).select("curve_id", "frame", F.col("t_rel").alias("t"), F.col("norm").alias("y"))
    return al.align(d, 60).join(b.curve_groups(spark, sf), "curve_id")


@query("F25_mean_curve_fit")
def f25(spark, sf):
    return wf.mean_curve_fits(aligned_groups(spark, sf), ["grp"], ("single", "double", "triple", "anomalous", "soumpasis", "power_law"))


@query("F25_mean_curve_fit_weighted")
def f25w(spark, sf):
    return wf.mean_curve_fits(aligned_groups(spark, sf), ["grp"], weighted=True)


@query("F26_mean_curve_comparison")
def f26(spark, sf):
    from rekurve.operators import groups as gr

    f = wf.mean_curve_fits(aligned_groups(spark, sf), ["grp"], ("single",))
    long = f.select("grp", F.explode(F.array(F.struct(F.lit("tau").alias("param"), F.col("p0").alias("v")), F.struct(F.lit("mobile_fraction").alias("param"), (F.col("amp") * 100).alias("v")))).alias("s")).select("grp", "s.*")
    c = gr.fold_change(cut_lineage(long), "param", "grp", "v")
    return c.withColumn("labels", F.concat_ws("|", ql.mean_curve_labels(mobile=F.when(F.col("param") == "mobile_fraction", F.col("difference")), kon_fold=F.when(F.col("param") == "tau", 1 / F.col("fold")))))


@query("F27_per_cell_fits")
def f27(spark, sf):
    return wf.per_cell(b.curves(spark, sf))


@query("F31_recording_metrics")
def f31(spark, sf):
    return wf.cli_metrics(b.roi_frames(spark, sf))


@query("F33_rate_spectrum")
def f33(spark, sf):
    return every(spark, sf, fit.rate_spectrum(post(spark, sf), K, "t_post", "y_post"))


@query("T04_spectrum_peaks")
def t04(spark, sf):
    return fit.spectrum_peaks(fit.rate_spectrum(post(spark, sf), K, "t_post", "y_post"), K)


@query("F35_one_call")
def f35(spark, sf):
    return wf.one_call(b.curves(spark, sf))


@query("F36_robust_methods")
def f36(spark, sf):
    return every(spark, sf, wf.robust_methods(post(spark, sf), K, "t_post", "y_post"))


@query("F37_unified_comparison")
def f37(spark, sf):
    return wf.unified_comparison(grouped_post(spark, sf), "grp", "curve_id", ["BUILDING", "MACHINERY"])


@query("F38_group_analysis")
def f38(spark, sf):
    return every(spark, sf, wf.group_analysis(post(spark, sf), K))


@query("F39_spectrum_methods")
def f39(spark, sf):
    p = post(spark, sf)
    weak = fit.rate_spectrum(p, K, "t_post", "y_post", alphas=[1e-6]).withColumn("method", F.lit("weak"))
    strong = fit.rate_spectrum(p, K, "t_post", "y_post", alphas=[1e-2]).withColumn("method", F.lit("strong"))
    auto = fit.rate_spectrum(p, K, "t_post", "y_post").withColumn("method", F.lit("corner"))
    return every(spark, sf, weak.unionByName(strong).unionByName(auto))


@query("N24_exponential_detrend")
def n24(spark, sf):
    c = cut_lineage(b.curves(spark, sf).select("curve_id", "frame", "t", "y"))
    return nz.detrend_exponential(c, fit.profile_fit(c, K, "decay"))
