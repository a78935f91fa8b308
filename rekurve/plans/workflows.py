"""Multi-step analyses built from the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from rekurve.functions import tails
from rekurve.functions.basis import MODELS
from rekurve.operators import align as al, bleach as bl, fit, fit_metrics as fm, normalize as nz, ordered as od, quality as ql
from rekurve.plans.session import cut_lineage

KEY = ["curve_id"]


def fit_all_models(post: DataFrame, keys: Sequence[str], t: str = "t_post", y: str = "y_post") -> DataFrame:
    """single, double, triple, anomalous and both reaction-diffusion readings, with criteria.

    The reaction-diffusion models are the double and triple fits under other names, so they cost no extra pass.
    """
    keys = list(keys)
    ex = cut_lineage(fit.exponential_fits(post, keys, (1, 2, 3), t, y))
    an = fit.profile_fit(post, keys, "anomalous", t, y)
    an = an.select(*keys, "model", "n", "p", "rss", "sst", "baseline", F.array("amp").alias("amps"), F.array("p0").alias("taus"), F.col("p1").alias("beta"))
    ex = ex.withColumn("beta", F.lit(None).cast("double"))
    rd = ex.filter("model = 'double'").withColumn("model", F.lit("reaction_diffusion"))
    rd2 = ex.filter("model = 'triple'").withColumn("model", F.lit("reaction_diffusion_two_sites"))
    return fm.add_criteria(ex.unionByName(an).unionByName(rd).unionByName(rd2))


def reaction_rates(fits: DataFrame, w: float = 1.0) -> DataFrame:
    """on/off rates and diffusion coefficient of double fits; the faster rate is diffusion."""
    a_d, a_b = F.get("amps", F.lit(0)), F.get("amps", F.lit(1))
    k_d, s = 1 / F.get("taus", F.lit(0)), 1 / F.get("taus", F.lit(1))
    m = a_d + a_b
    return fits.withColumns({
        "mobile_fraction": m, "k_d": k_d, "k_off": F.try_divide(s * a_b, m), "k_on": F.try_divide(s * a_d, m), "diffusion_coefficient": w * w * k_d / 4.0,
    })


def two_site_rates(fits: DataFrame, w: float = 1.0) -> DataFrame:
    """diffusion, fast site and slow site of triple fits."""
    at = lambda c, i: F.get(c, F.lit(i))
    return fits.withColumns({
        "k_diff": 1 / at("taus", 0), "k_off_1": 1 / at("taus", 1), "k_off_2": 1 / at("taus", 2), "a_diff": at("amps", 0), "a_1": at("amps", 1), "a_2": at("amps", 2),
        "diffusion_coefficient": w * w / at("taus", 0) / 4.0,
    })


def every_curve(found: DataFrame, curves: DataFrame, keys: Sequence[str], why: str = "no post-bleach part") -> DataFrame:
    """``found`` and a row of NULLs with a ``reason`` for each of ``curves`` that it lacks."""
    keys = list(keys)
    found = cut_lineage(found)
    have = F.col("reason") if "reason" in found.columns else F.lit(None).cast("string")
    missing = curves.select(*keys).join(found.select(*keys).distinct(), keys, "left_anti")
    return found.withColumn("reason", have).unionByName(missing.withColumn("reason", F.lit(why)), allowMissingColumns=True)


def predicted(t: Column | str) -> Column:
    """Value of a sum-of-exponentials fit with ``baseline, amps, taus`` at a time column."""
    name = t if isinstance(t, str) else "t"
    return F.expr(f"baseline + aggregate(zip_with(amps, taus, (a, x) -> a * (1 - exp(-({name}) / x))), 0.0D, (s, v) -> s + v)")


def single_intervals(rows: DataFrame, fits: DataFrame, keys: Sequence[str], t: str, y: str, w: float = 1.0, z: float = 1.96) -> DataFrame:
    """95 % intervals of amplitude, time constant, baseline and D from sums of Jacobian products.

    ``fits`` has ``amp, p0 (tau), baseline``; the 3x3 normal matrix is inverted in closed form.
    """
    j = rows.join(cut_lineage(fits.select(*keys, "amp", F.col("p0").alias("tau"), "baseline", "n", "rss", "p")), list(keys))
    e = F.exp(-F.col(t) / F.col("tau"))
    j = j.withColumn("_m", 1 - e).withColumn("_t", -F.col("amp") * e * F.col(t) / (F.col("tau") * F.col("tau")))
    s = lambda a, c: F.sum(F.col(a) * F.col(c)) if c else F.sum(F.col(a))
    g = j.groupBy(*keys).agg(
        F.first("amp").alias("amp"), F.first("tau").alias("tau"), F.first("baseline").alias("baseline"), F.first("n").alias("n"), F.first("rss").alias("rss"),
        s("_m", "_m").alias("a"), s("_m", "_t").alias("b"), s("_m", None).alias("c"), s("_t", "_t").alias("d"), s("_t", None).alias("e"),
    )
    # symmetric matrix [[a b c] [b d e] [c e n]]
    det = F.expr("a * (d * n - e * e) - b * (b * n - e * c) + c * (b * e - d * c)")
    var = F.expr("rss / greatest(n - 3, 1)")
    se = {k: F.sqrt(F.greatest(F.lit(0.0), F.try_divide(var * F.expr(m), det))) for k, m in {"amp": "d * n - e * e", "tau": "a * n - c * c", "baseline": "a * d - b * b"}.items()}
    cols = {}
    for k, v in se.items():
        cols[f"{k}_lo"], cols[f"{k}_hi"] = F.col(k) - z * v, F.col(k) + z * v
    out = g.withColumns(cols)
    inv = lambda c: F.when(F.col(c) > 0, w * w / (4 * F.col(c)))
    both = (F.col("tau_lo") > 0) & (F.col("tau_hi") > 0)
    return out.select(
        *keys, "amp", "amp_lo", "amp_hi", "tau", "tau_lo", "tau_hi", "baseline", "baseline_lo", "baseline_hi",
        inv("tau").alias("d"), F.when(both, inv("tau_hi")).alias("d_lo"), F.when(both, inv("tau_lo")).alias("d_hi"),
    )


def recruitment_models(df: DataFrame, keys: Sequence[str], t: str = "t", y: str = "y") -> DataFrame:
    """F8: exponential, double exponential and sigmoidal rise; ``best`` marks the smallest AIC."""
    keys = list(keys)
    ex = fit.exponential_fits(df, keys, (1, 2), t, y).select(*keys, F.concat("model", F.lit("_recruitment")).alias("model"), "n", "p", "rss", "sst", "baseline", F.get("amps", F.lit(0)).alias("amp"), (1 / F.get("taus", F.lit(0))).alias("rate"))
    sg = fit.profile_fit(df, keys, "sigmoid", t, y).select(*keys, F.lit("sigmoid_recruitment").alias("model"), "n", "p", "rss", "sst", "baseline", "amp", F.col("p0").alias("rate"))
    return mark_best(fm.add_criteria(ex.unionByName(sg)), keys)


def expansion_models(df: DataFrame, keys: Sequence[str], t: str = "t", y: str = "y") -> DataFrame:
    """exponential, linear and power-law growth of an area."""
    keys = list(keys)
    parts = [fit.profile_fit(df, keys, f"expansion_{m}", t, y, amp=(-float("inf"), float("inf")), rounds=0 if m == "linear" else None) for m in ("exponential", "linear", "power")]
    out = parts[0].unionByName(parts[1].withColumn("p", F.lit(2))).unionByName(parts[2])
    return mark_best(fm.add_criteria(out), keys)


def mark_best(fits: DataFrame, keys: Sequence[str], by: str = "aic") -> DataFrame:
    return fm.rank_models(fits, list(keys), [by]).withColumn("best", F.col("rank") == 1).drop("rank")


def damage_experiment(df: DataFrame, keys: Sequence[str], damage: str = "damage", bleach: str = "bleach", y: str = "y") -> DataFrame:
    """rise between damage and bleach, recovery after the bleach, each fitted on its own clock."""
    keys = list(keys)
    first, second = F.least(damage, bleach), F.greatest(damage, bleach)
    seg = F.when(F.col("frame") >= second, F.when(F.col(bleach) >= F.col(damage), "recovery").otherwise("recruitment")).when(F.col("frame") >= first, F.when(F.col(bleach) >= F.col(damage), "recruitment").otherwise("recovery"))
    s = df.withColumn("segment", seg).filter("segment is not null")
    s = od.attach(s, [*keys, "segment"], _t0=F.min("t")).withColumn("t_seg", F.col("t") - F.col("_t0"))
    rec = fit.profile_fit(s.filter("segment = 'recovery'"), [*keys, "segment"], "single", "t_seg", y)
    rise = fit.profile_fit(s.filter("segment = 'recruitment'"), [*keys, "segment"], "single", "t_seg", y)
    return fm.add_criteria(rec.unionByName(rise))


def nested_choice(single: DataFrame, double: DataFrame, triple: DataFrame, keys: Sequence[str], alpha: float = 0.05) -> DataFrame:
    """walk up single -> double -> triple while the nested test prefers the larger model."""
    keys = list(keys)

    def step(a, b, name):
        f = fm.f_statistic(a, b, keys)
        f = f.withColumn("p_value", tails.f_upper(F.col("f_stat"), F.col("df1"), F.col("df2")))
        return f.select(*keys, F.coalesce(fm.prefers_complex(F.col("p_value"), F.col("d_aic"), F.col("d_bic"), alpha), F.lit(False)).alias(name))

    base = single.select(*keys).join(step(single, double, "up2"), keys, "left").join(step(double, triple, "up3"), keys, "left").join(step(single, triple, "up13"), keys, "left")
    up2, up3, up13 = (F.coalesce(c, F.lit(False)) for c in ("up2", "up3", "up13"))
    return base.select(*keys, F.when(up2 & up3, "triple").when(up2, "double").when(up13, "triple").otherwise("single").alias("model"))


def unified_workflow(df: DataFrame, group: Sequence[str], curve: Sequence[str], t="t", y="y") -> DataFrame:
    """explore every model per group, take the most complex one any group needs, give all groups that fit."""
    group = list(group)
    fits = {}
    for o, name in ((1, "single"), (2, "double"), (3, "triple")):
        fits[name] = [cut_lineage(x) for x in fit.global_exponential_fit(df, group, curve, o, t, y)]
    crit = {n: fm.add_criteria(g[0]) for n, g in fits.items()}
    need = nested_choice(crit["single"], crit["double"], crit["triple"], group)
    level = F.when(F.col("model") == "single", 1).when(F.col("model") == "double", 2).otherwise(3)
    most = need.agg(F.max(level).alias("lv")).first()["lv"]  # one number decides the unified model
    name = {1: "single", 2: "double", 3: "triple"}[most or 1]
    return fits[name][1].join(need.select(*group, F.col("model").alias("own_choice")), group)


def mean_curve_fits(aligned: DataFrame, group: list[str], models: Sequence[str] = ("single", "anomalous"), weighted: bool = False) -> DataFrame:
    """fit the mean curve of each group; with ``weighted`` the points count by inverse squared SEM.

    ``models`` are names of ``basis.MODELS`` (``amp, p0, p1``) or ``double`` and ``triple`` (``amps, taus``), which are not weighted.
    """
    m = cut_lineage(al.mean_curve(aligned, group))
    if weighted:
        m = od.attach(m.filter("sem > 0"), group, _mean=F.avg(1 / (F.col("sem") * F.col("sem"))))
        m = cut_lineage(m.withColumn("_wt", 1 / (F.col("sem") * F.col("sem")) / F.col("_mean")))
    parts = [fit.profile_fit(m, group, name, "x", "mean", weight="_wt" if weighted else None) for name in models if name in MODELS]
    sums = [o for o, name in ((2, "double"), (3, "triple")) if name in models]
    if sums:
        parts.append(fit.exponential_fits(m, group, sums, "x", "mean"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return fm.add_criteria(out)


def per_cell(df: DataFrame, w: float = 1.0) -> DataFrame:
    """bleach, pre-bleach level, post-bleach fit with one or two rates, mobile fraction and quality flag."""
    b = bl.pre_bleach_level(df)
    j = df.join(b, KEY).filter(F.col("frame") >= F.col("bleach"))
    j = od.attach(j, KEY, _t0=F.min("t"), _n=F.count(F.lit(1))).withColumn("t_post", F.col("t") - F.col("_t0"))
    few = F.col("_n") < 4
    short = cut_lineage(j.filter(few).select(*KEY).distinct())
    rows = cut_lineage(j.filter(~few).select("curve_id", "t_post", "y", "pre"))
    fits = cut_lineage(fm.add_criteria(fit.exponential_fits(rows, KEY, (1, 2), "t_post", "y")))
    pick = fm.parsimonious(fits.filter("model = 'single'"), fits.filter("model = 'double'"), KEY).select(*KEY, "model")
    pre = rows.groupBy(*KEY).agg(F.first("pre").alias("pre_bleach"))
    best = fits.join(pick, [*KEY, "model"]).join(pre, KEY)
    total = F.aggregate("amps", F.lit(0.0), lambda a, x: a + x)
    out = best.withColumn("i0", F.col("baseline")).withColumn("i_inf", F.col("baseline") + total).withColumn("k", 1 / F.get("taus", F.lit(0)))
    out = out.withColumn("mobile_frac", ql.mobile_fraction(F.col("i0"), F.col("i_inf"), F.col("pre_bleach"))).withColumn("t_half", 0.6931471805599453 / F.col("k"))
    out = out.withColumn("bleach_qc", F.coalesce((F.col("r2") > 0.5) & F.col("mobile_frac").between(0, 1), F.lit(False)))
    return every_curve(out, short, KEY, "fewer than 4 frames after the bleach")


def one_call(df: DataFrame, y: str = "y", w: float = 1.0) -> DataFrame:
    """divide by the mean of the first max(2, n/10) points, fit all models, choose by AICc, derive features."""
    d = od.attach(df, KEY, _n=F.count(F.lit(1)))
    d = od.attach(d, KEY, _pre=F.avg(F.when(F.col("frame") < F.greatest(F.lit(2), F.floor(F.col("_n") / 10)), F.col(y))))
    d = d.select("curve_id", "frame", "t", (F.col(y) / F.col("_pre")).alias("norm"))
    post = cut_lineage(bl.post_bleach(d, "norm", points=4, floor_negative=True).select("curve_id", "t_post", "y_post"))
    fits = cut_lineage(fit_all_models(post, KEY))
    return every_curve(best_features(fits), df.select(*KEY).distinct(), KEY)


def best_features(fits: DataFrame, by: str = "aicc") -> DataFrame:
    best = fm.choose_best(fits, KEY, by)
    return fm.component_features(best)


def cli_metrics(rec: DataFrame, w: float = 0.72) -> DataFrame:
    """double normalization with floors, time-zero correction, one reaction-diffusion fit, single fit as fallback; a row for every curve.

    All frames after the bleach are fitted; thinning them (``shape.downsample``) is a step of its own.
    """
    every = nz.double_with_floor(rec).select("curve_id", "frame", "t", F.col("norm").alias("y"), "norm_error")
    every = cut_lineage(every)
    n = every.filter("norm_error is null").drop("norm_error")
    z = bl.time_zero(n).filter("half_frame > 0")
    post = od.reindex(n.join(z, KEY).filter(F.col("frame") >= F.col("bleach")), F.col("frame") - F.col("bleach"))
    post = od.attach(post, KEY, _t0=F.min("t")).withColumn("t_post", F.col("t") - F.col("_t0") + F.col("half_frame"))
    post = post.withColumn("y", F.when(F.col("frame") == 0, F.col("f_zero")).otherwise(F.col("y")))
    rows = cut_lineage(post.select("curve_id", "frame", "t_post", "y"))
    fits = cut_lineage(fit.exponential_fits(rows, KEY, (1, 2), "t_post", "y"))
    rd = reaction_rates(fits.filter("model = 'double'"), w).filter("mobile_fraction > 0").select(*KEY, "mobile_fraction", F.col("diffusion_coefficient").alias("diffusion"), F.try_divide(F.lit(1.0), "k_off").alias("residency"))
    one = fits.filter("model = 'single'").select(*KEY, F.get("amps", F.lit(0)).alias("m1"), (w * w / (4 * F.get("taus", F.lit(0)))).alias("d1"), F.get("taus", F.lit(0)).alias("r1"))
    j = one.join(rd, KEY, "left")
    j = j.select(*KEY, F.coalesce("mobile_fraction", "m1").alias("mobile_fraction"), F.coalesce("diffusion", "d1").alias("diffusion"), F.coalesce("residency", "r1").alias("residency"), F.when(F.col("m1").isNull(), "no fit").alias("reason"))
    why = every.groupBy(*KEY).agg(F.coalesce(F.max("norm_error"), F.lit("no frame after the bleach")).alias("why"))
    return why.join(j, KEY, "left").select(*KEY, "mobile_fraction", "diffusion", "residency", F.when(F.col("mobile_fraction").isNull(), F.coalesce("reason", "why")).alias("reason"))


def robust_methods(df: DataFrame, keys: Sequence[str], t: str, y: str) -> DataFrame:
    """the same model under each loss, ranked by AIC of the unweighted residuals."""
    keys = list(keys)
    parts = [fit.profile_fit(df, keys, "single", t, y, robust=r) for r in ("soft_l1", "huber", "tukey")]
    allf = parts[0].unionByName(parts[1]).unionByName(parts[2])
    per = cut_lineage(allf)
    rows = df.join(per.select(*keys, "model", "amp", "baseline", "p0"), keys)
    res = F.col(y) - (F.col("baseline") + F.col("amp") * (1 - F.exp(-F.col(t) / F.col("p0"))))
    rss = rows.groupBy(*keys, "model").agg(F.sum(res * res).alias("rss"))
    return mark_best(fm.add_criteria(per.drop("rss").join(rss, [*keys, "model"])), keys)


def unified_comparison(df: DataFrame, group: str, curve: str, controls: list[str], t="t", y="y", w: float = 1.0) -> DataFrame:
    """choose single or double on the pooled control by AIC, fit every group with it; one row per curve."""
    pooled = df.filter(F.col(group).isin(controls)).withColumn("pool", F.lit("control"))
    aic = {}
    for o in (1, 2):
        g = fm.add_criteria(fit.global_exponential_fit(pooled, ["pool"], [group, curve], o, t, y)[0]).first()
        aic[o] = g["aic"] if g else float("inf")
    order = min(aic, key=lambda o: (aic[o], o))
    _, fits = fit.global_exponential_fit(df, [group], [curve], order, t, y)
    total = F.aggregate("amps", F.lit(0.0), lambda a, x: a + x)
    k = lambda i: 1 / F.get("taus", F.lit(i))
    return fits.select(group, curve, "model", total.alias("mobile_fraction"), k(0).alias("k_fast"), (k(order - 1) if order > 1 else F.lit(None).cast("double")).alias("k_slow"), F.try_divide(F.get("amps", F.lit(0)), total).alias("f_fast"), (w * w * k(0) / 4).alias("d"))


def group_analysis(post: DataFrame, keys: Sequence[str], model: str | None = None, t="t_post", y="y_post") -> DataFrame:
    """per-curve parameters for one model, or for the best sum of exponentials by AIC when ``model`` is None.

    Models with one amplitude and a time constant first (``basis.MODELS``) give it as their only component.
    """
    if model in MODELS and model != "single":
        one = fm.add_criteria(fit.profile_fit(post, list(keys), model, t, y))
        return fm.component_features(one.withColumns({"amps": F.array("amp"), "taus": F.array("p0")}))
    fits = fm.add_criteria(fit.exponential_fits(post, list(keys), (1, 2, 3), t, y))
    chosen = fits.filter(F.col("model") == model) if model else fm.choose_best(cut_lineage(fits), list(keys), "aic")
    return fm.component_features(chosen)
