"""Workflows on recordings with known answers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rekurve.operators import fit, fit_metrics as fm, pixels as px, resample as rs, stats as st
from rekurve.operators.ordered import SEGMENT_CONF
from rekurve.plans import workflows as wf

K = ["curve_id"]


def table(spark, curves, names="curve_id, t, y", kinds=None):
    """Rows of ``{key: (t, y, ...)}`` with a frame number."""
    rows = [(*(k if isinstance(k, tuple) else (k,)), i, *map(float, v)) for k, cols in curves.items() for i, v in enumerate(zip(*cols))]
    keys = names.split(", ")
    schema = ", ".join(f"{n} {'string' if isinstance(v, str) else 'long' if n == 'frame' else 'double'}" for n, v in zip(keys, rows[0]))
    return spark.createDataFrame(rows, schema).repartition(4)


def rise(t, *parts):
    return sum(a * (1 - np.exp(-t / tau)) for a, tau in parts)


@pytest.fixture(scope="module")
def noise():
    return np.random.default_rng(8)


@pytest.fixture(scope="module")
def recovery(noise):
    """A bleach at frame 10, then one or two rates."""
    t = np.arange(0, 120, 0.25)
    out = {}
    for name, parts in (("one", [(0.6, 4.0)]), ("two", [(0.3, 1.0), (0.3, 20.0)])):
        y = np.where(np.arange(len(t)) < 10, 1.0, 0.2 + rise(t - t[10], *parts))
        out[name] = (t, y + noise.normal(0, 0.002, len(t)))
    return out


def test_per_cell(spark, recovery):
    short = (np.arange(12.0), np.r_[np.full(10, 1.0), 0.1, 0.3])
    got = {r.curve_id: r for r in wf.per_cell(table(spark, recovery | {"short": short}, "curve_id, frame, t, y")).collect()}
    one, two = got["one"], got["two"]
    assert one.model == "single" and two.model == "double" and one.bleach_qc and two.bleach_qc
    assert one.k == pytest.approx(1 / 4, rel=0.02) and one.t_half == pytest.approx(4 * np.log(2), rel=0.02)
    assert two.taus == pytest.approx([1, 20], rel=0.1)
    assert one.mobile_frac == pytest.approx(0.75, abs=0.01) and one.pre_bleach == pytest.approx(1, abs=0.01)
    assert got["short"].model is None and got["short"].reason == "fewer than 4 frames after the bleach"


def test_recording_metrics(spark, recovery):
    """Two components give mobile fraction, diffusion of the fast one and residency; nothing before the bleach gives a reason."""
    rec = {}
    for name, (t, y) in recovery.items():
        fade = np.exp(-t / 800)
        rec[name] = (t, 50 + 1000 * y * fade, 50 + 900 * fade, np.full(len(t), 50.0))
    t = np.arange(30.0)
    rec["late"] = (t, 60 + t, np.full(30, 900.0), np.full(30, 50.0))
    got = {r.curve_id: r for r in wf.cli_metrics(table(spark, rec, "curve_id, frame, t, roi1, roi2, roi3")).collect()}
    two = got["two"]
    assert two.mobile_fraction == pytest.approx(0.6, abs=0.02) and two.diffusion == pytest.approx(0.72**2 / 4, rel=0.15) and two.residency == pytest.approx(40, rel=0.1)
    assert got["one"].mobile_fraction == pytest.approx(0.6, abs=0.02) and got["one"].reason is None
    assert len(got) == 3 and got["late"].mobile_fraction is None and got["late"].reason == "no frame before the bleach"


def test_one_call(spark, recovery):
    flat = (np.arange(3.0), np.array([1.0, 1.0, 1.0]))
    got = {r.curve_id: r for r in wf.one_call(table(spark, recovery | {"flat": flat}, "curve_id, frame, t, y")).collect()}
    assert got["two"].rate_constant_fast == pytest.approx(1, rel=0.15) and got["two"].rate_constant_slow == pytest.approx(1 / 20, rel=0.15)
    level = recovery["two"][1][:48].mean()  # a tenth of the frames, bleached ones too; fit time starts half a frame after the bleach
    assert got["two"].mobile_fraction == pytest.approx((30 * np.exp(0.125) + 30 * np.exp(0.125 / 20)) / level, rel=0.02) and got["flat"].model is None and got["flat"].reason == "no post-bleach part"


@pytest.fixture(scope="module")
def post(spark, noise):
    t = np.geomspace(0.1, 200, 300)
    return table(spark, {n: (t, 0.1 + rise(t, *p) + noise.normal(0, 0.002, 300)) for n, p in (("one", [(0.7, 5.0)]), ("two", [(0.4, 1.0), (0.4, 30.0)]), ("three", [(0.3, 0.5), (0.3, 6.0), (0.3, 70.0)]))}, "curve_id, frame, t_post, y_post")


def test_all_models_and_analysis(spark, post):
    fits = {(r.curve_id, r.model): r for r in wf.fit_all_models(post, K).collect()}
    assert len(fits) == 18
    for name, best in (("one", "single"), ("two", "double"), ("three", "triple")):
        assert min(("single", "double", "triple"), key=lambda m: fits[name, m].bic) == best
    chosen = {r.curve_id: r for r in wf.group_analysis(post, K).collect()}
    assert chosen["two"].rate_constant_fast == pytest.approx(1, rel=0.1) and chosen["three"].model == "triple"
    stretched = {r.curve_id: r for r in wf.group_analysis(post, K, "anomalous").collect()}
    assert stretched["one"].rate_constant_fast == pytest.approx(1 / 5, rel=0.05) and stretched["one"].mobile_fraction == pytest.approx(70, abs=2)


def test_binding_rates(spark, post):
    """On and off rates of the double fit, three rates of the triple one."""
    two = {r.curve_id: r for r in wf.reaction_rates(fit.exponential_fits(post, K, (2,), "t_post", "y_post"), 2.0).collect()}["two"]
    assert two.k_d == pytest.approx(1, rel=0.1) and two.k_off == pytest.approx(0.5 / 30, rel=0.1) and two.k_on == pytest.approx(0.5 / 30, rel=0.1)
    assert two.mobile_fraction == pytest.approx(0.8, abs=0.01) and two.diffusion_coefficient == pytest.approx(1, rel=0.1)
    three = {r.curve_id: r for r in wf.two_site_rates(fit.exponential_fits(post, K, (3,), "t_post", "y_post")).collect()}["three"]
    assert [three.k_diff, three.k_off_1, three.k_off_2] == pytest.approx([2, 1 / 6, 1 / 70], rel=0.15) and [three.a_diff, three.a_1, three.a_2] == pytest.approx([0.3] * 3, abs=0.04)


def test_rate_spectrum_and_peaks(spark, post):
    s = fit.rate_spectrum(post, K, "t_post", "y_post")
    got = {r.curve_id: r for r in s.collect()}
    assert got["one"].area == pytest.approx(0.7, abs=0.03) and got["two"].area == pytest.approx(0.8, abs=0.04)
    assert all(w >= 0 for r in got.values() for w in r.weights)
    near = lambda r, tau: sum(w for w, x in zip(r.weights, r.taus) if tau / 3 < x < tau * 3)
    assert near(got["one"], 5) > 0.6 and near(got["two"], 1) > 0.3 and near(got["two"], 30) > 0.3
    peaks = {}
    for r in fit.spectrum_peaks(s, K).collect():
        peaks.setdefault(r.curve_id, []).append(r)
    assert 2 < min(peaks["one"], key=lambda r: r.peak_rank).tau < 12 and len(peaks["two"]) >= 2


def test_recruitment_and_expansion(spark, noise):
    t = np.arange(0, 60, 0.5)
    e = noise.normal(0, 0.004, len(t))
    d = table(spark, {"rise": (t, 1 + rise(t, (2, 6.0)) + e), "late": (t, 1 + 2 / (1 + np.exp(-0.5 * (t - 25))) + e)}, "curve_id, frame, t, y")
    best = {r.curve_id: r for r in wf.recruitment_models(d, K).filter("best").collect()}
    assert best["rise"].model != "sigmoid_recruitment" and best["rise"].rate == pytest.approx(1 / 6, rel=0.1)
    assert best["late"].model == "sigmoid_recruitment" and best["late"].rate == pytest.approx(0.5, rel=0.05)
    d = table(spark, {"line": (t, 3 + 0.5 * t + e), "root": (t, 3 + t**0.5 + e), "plateau": (t, 3 + 4 * (1 - np.exp(-0.1 * t)) + e)}, "curve_id, frame, t, y")
    best = {r.curve_id: r for r in wf.expansion_models(d, K).filter("best").collect()}
    assert {k: r.model for k, r in best.items()} == {"line": "expansion_linear", "root": "expansion_power", "plateau": "expansion_exponential"}
    assert best["line"].amp == pytest.approx(0.5, rel=0.01) and best["root"].p0 == pytest.approx(0.5, rel=0.02) and best["plateau"].p0 == pytest.approx(0.1, rel=0.05)


def test_damage_experiment(spark):
    t = np.arange(80.0)
    y = np.where(t < 10, 1.0, np.where(t < 40, 1 + rise(t - 10, (2, 5.0)), 0.5 + rise(t - 40, (1.5, 8.0))))
    d = table(spark, {"c": (t, y)}, "curve_id, frame, t, y").withColumns({"damage": F.lit(10), "bleach": F.lit(40)})
    got = {r.segment: r for r in wf.damage_experiment(d, K).collect()}
    assert got["recruitment"].p0 == pytest.approx(5, rel=0.01) and got["recruitment"].amp == pytest.approx(2, rel=0.01)
    assert got["recovery"].p0 == pytest.approx(8, rel=0.01) and got["recovery"].baseline == pytest.approx(0.5, abs=0.01)


def test_robust_methods(spark, noise):
    """A tenth of the points far off: every loss finds the time constant that least squares misses."""
    t = np.arange(0, 50, 0.25)
    y = 0.1 + rise(t, (0.8, 5.0)) + noise.normal(0, 0.005, len(t))
    y[5::10] += 1.5
    d = table(spark, {"c": (t, y)}, "curve_id, frame, t, y")
    plain = fit.profile_fit(d, K, "single").first()
    got = {r.model: r for r in wf.robust_methods(d, K, "t", "y").collect()}
    assert got.keys() == {"single_soft_l1", "single_huber", "single_tukey"} and sum(r.best for r in got.values()) == 1
    assert got["single_tukey"].p0 == pytest.approx(5, rel=0.05) and abs(plain.baseline - 0.1) > 0.1 > abs(got["single_tukey"].baseline - 0.1)


def groups(spark, noise):
    t = np.geomspace(0.1, 100, 120)
    return table(spark, {(g, f"{g}{c}"): (t, 0.05 * c + rise(t, *[(a + 0.02 * c, tau) for a, tau in p]) + noise.normal(0, 0.002, 120)) for g, p in (("ctrl", [(0.4, 2.0), (0.3, 25.0)]), ("mut", [(0.3, 4.0), (0.4, 40.0)])) for c in range(4)}, "grp, curve_id, frame, t, y")


def test_global_fits(spark, noise):
    """Shared rates of each group; the same whether a group fits into a task or not."""
    d = groups(spark, noise)
    found = []
    for limit in (None, "7"):
        if limit:
            spark.conf.set(SEGMENT_CONF, limit)
        try:
            two, curves = fit.global_exponential_fit(d, ["grp"], K, 2)
            one, amps = fit.global_profile_fit(d, ["grp"], K, "anomalous")
            found.append([sorted(x.collect(), key=lambda r: (r.grp, getattr(r, "curve_id", "") if "curve_id" in r else "")) for x in (two, curves, one, amps)])
        finally:
            spark.conf.unset(SEGMENT_CONF)
    two, curves, one, amps = found[0]
    assert two[0].taus == pytest.approx([2, 25], rel=0.05) and two[1].taus == pytest.approx([4, 40], rel=0.05) and [r.curves for r in two] == [4, 4]
    assert len(curves) == 8 and curves[0].amps == pytest.approx([0.4, 0.3], abs=0.02) and curves[3].baseline == pytest.approx(0.15, abs=0.02)
    for a, b in zip(*(x[0] for x in found)):
        assert a.taus == pytest.approx(b.taus, rel=1e-3) and a.rss == pytest.approx(b.rss, rel=1e-3)
    for a, b in zip(*(x[2] for x in found)):
        assert a.p0 == pytest.approx(b.p0, rel=1e-3) and a.p1 == pytest.approx(b.p1, rel=1e-3)
    assert len(amps) == 8 and all(r.amp > 0 for r in amps)


def test_unified(spark, noise):
    d = groups(spark, noise)
    got = wf.unified_workflow(d, ["grp"], K).collect()
    assert len(got) == 8 and {r.own_choice for r in got} == {"double"} and {r.model for r in got} == {"double"}
    rows = {r.curve_id: r for r in wf.unified_comparison(d, "grp", "curve_id", ["ctrl"]).collect()}
    assert len(rows) == 8 and rows["ctrl0"].k_fast == pytest.approx(1 / 2, rel=0.05) and rows["mut1"].k_slow == pytest.approx(1 / 40, rel=0.1)
    assert rows["mut0"].f_fast == pytest.approx(3 / 7, abs=0.03)


def test_mean_curves(spark, noise):
    x = np.linspace(0, 60, 120)
    rows = [("g", c, j, float(v), float(0.1 + rise(v, (0.4, 1.5), (0.4, 20.0)) + noise.normal(0, 0.004))) for c in range(6) for j, v in enumerate(x)]
    d = spark.createDataFrame(rows, "grp string, curve_id long, j int, x double, yi double")
    got = {r.model: r for r in wf.mean_curve_fits(d, ["grp"], ("single", "double", "anomalous")).collect()}
    assert got["double"].taus == pytest.approx([1.5, 20], rel=0.1) and got["double"].aic < got["anomalous"].aic < got["single"].aic
    assert wf.mean_curve_fits(d, ["grp"], weighted=True).count() == 2


def test_long_curve_in_little_memory(spark):
    """300,000 points in one task: sums of products are made slice by slice, whatever the length of the curve."""
    import resource

    from rekurve.operators.ordered import group_starts
    import pandas as pd

    t = np.geomspace(0.01, 500, 300_000)
    b = pd.DataFrame({"curve_id": 1, "t": t, "y": 0.1 + rise(t, (0.4, 2.0), (0.4, 40.0)), "_lo": t[0], "_hi": t[-1]})
    ex = fit._Exponentials((1, 2, 3), 18)
    p = fit._exponential_pass(K, "curve_id long", ex, np.inf)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    w = fit._local_round(b, group_starts(b, K), "t", "y", p)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 400_000  # KB; all products at once take 500 MB and their parts as much again
    few = fit._local_round(b.iloc[::1], np.array([0]), "t", "y", p)
    assert w.rss2[0] == pytest.approx(few.rss2[0]) and w._t2_0[0] == few._t2_0[0]


def test_choice_of_tests(spark, noise):
    rows = [(g, float(v)) for g, m in (("a", 0), ("b", 0), ("c", 2)) for v in noise.normal(m, 1, 40)]
    d = spark.createDataFrame(rows, "g string, v double")
    assert st.choose_tests(d, "g", "v").first().test == "anova"
    assert st.choose_tests(d.filter("g <> 'b'"), "g", "v").first().test == "welch_t"
    skew = spark.createDataFrame([(g, float(v)) for g, v in rows for v in [np.exp(2 * v)]], "g string, v double")
    assert st.choose_tests(skew, "g", "v").first().test == "kruskal"
    p = {(r.g1, r.g2): r for r in st.pairwise(d, "g", "v").collect()}
    assert len(p) == 3 and p["a", "c"].p_value < 1e-6 < 0.01 < p["a", "b"].p_value and {r.test for r in p.values()} == {"welch_t"}
    small = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 1.0), ("b", 2.0), ("b", 4.0)], "g string, v double")
    got = {r.g: r for r in st.shapiro(small, "g", "v").collect()}
    assert got["a"].w is None and got["a"].reason == "fewer than 3 values" and got["b"].w is not None


def test_bootstrap_forms_agree(spark):
    """Sums by matrices of draws equal a Spark aggregate of the same draws; a permutation takes exactly n1 rows."""
    d = spark.createDataFrame([("a" if i % 3 else "b", i, float(i % 17)) for i in range(200)], "g string, i long, v double").repartition(3)
    m = {(r.g, r.rep): r for r in rs.bootstrap_moments(d, ["g"], "v", ["i"], 300).collect()}
    s = {(r.g, r.rep): r.stat for r in rs.bootstrap(d, ["g"], "v", ["i"], 300, lambda c: F.struct(F.count(c).alias("n"), F.avg(c).alias("mean"), F.var_samp(c).alias("var"))).collect()}
    assert m.keys() == s.keys() and all((m[k].n, m[k].mean, m[k].var) == pytest.approx((s[k].n, s[k].mean, s[k].var)) for k in m)
    n = np.array([m["a", r].n for r in range(300)])
    assert n.mean() == pytest.approx(133, rel=0.02) and n.std() == pytest.approx(np.sqrt(133), rel=0.15)  # Poisson
    se = np.std([m["a", r].mean for r in range(300)])
    assert se == pytest.approx(d.filter("g = 'a'").agg(F.stddev_samp("v")).first()[0] / np.sqrt(133), rel=0.15)
    ones = rs.permutation_test(d.withColumn("v", F.lit(1.0)), "g", "v", "i", "a", "b", 200).collect()
    assert len(ones) == 200 and all(abs(r["diff"]) < 1e-12 for r in ones)


def test_hausdorff(spark, noise):
    h, w = 23, 31
    masks = {k: noise.random((h, w)) < p for k, p in enumerate((0.01, 0.05, 0.3, 0.9))}
    for m in masks.values():
        m[3, 4] = True
    rows = lambda of: spark.createDataFrame([(k, int(y), int(x)) for k, m in of.items() for y, x in zip(*np.nonzero(m))], "k int, py int, px int")
    other = {k: masks[(k + 1) % 4] for k in masks}
    got = {r.k: r.hausdorff for r in px.hausdorff(rows(masks), rows(other), ["k"], h, w).collect()}
    for k in masks:
        a, b = (np.argwhere(m) for m in (masks[k], other[k]))
        dist = np.sqrt(((a[:, None] - b[None]) ** 2).sum(2))
        assert got[k] == pytest.approx(max(dist.min(0).max(), dist.min(1).max()))
    one = np.zeros((1, 7), bool)
    one[0, 2] = True
    assert px._distance_to(one)[0].tolist() == [2, 1, 0, 1, 2, 3, 4]
    large = np.zeros((1024, 1024), bool)
    large[::200, ::300] = True
    d = px._distance_to(large)
    assert d.shape == large.shape and d[large].max() == 0 and d[100, 150] == pytest.approx(np.hypot(100, 150))


def test_model_without_fit_ranks_last(spark):
    """Its criteria are NULL, which is no better than those of a fit."""
    d = spark.createDataFrame([(1, "single", None, None), (1, "double", 4.0, 5.0), (1, "triple", 3.0, 6.0), (2, "single", float("inf"), 1.0), (2, "double", None, 0.0)], "curve_id int, model string, aic double, bic double")
    rank = {(r.curve_id, r.model): r["rank"] for r in fm.rank_models(d, ["curve_id"], ["aic", "bic"]).collect()}
    assert rank == {(1, "triple"): 1, (1, "double"): 2, (1, "single"): 3, (2, "single"): 1, (2, "double"): 2}
    assert {(r.curve_id, r.model) for r in wf.mark_best(d, ["curve_id"]).filter("best").collect()} == {(1, "triple"), (2, "single")}
