"""Fits recover the parameters of closed-form curves."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rekurve.functions.models import soumpasis, stretched
from rekurve.operators import fit, fit_metrics as fm
from rekurve.plans import workflows as wf

K = ["curve_id"]


def curve(spark, name, n, end, y, start=0.0):
    t = F.lit(start) + F.col("id") * ((end - start) / (n - 1))
    return spark.range(n).select(F.lit(name).alias("curve_id"), t.alias("t")).withColumn("y", F.expr(y))


def rows(df):
    return {(r["curve_id"], r["model"]): r for r in df.collect()}


@pytest.fixture(scope="module")
def exponentials(spark):
    noise = "(cast(conv(substr(md5(cast(t as string)), 1, 8), 16, 10) as double) / 4294967296 - 0.5) * 0.06"
    d = curve(spark, "single", 200, 5, "0.8 * (1 - exp(-t / 0.25))")
    d = d.unionByName(curve(spark, "double", 500, 120, "0.5 * (1 - exp(-t / 2)) + 0.3 * (1 - exp(-t / 40))"))
    d = d.unionByName(curve(spark, "rates", 1200, 80, "0.55 * (1 - exp(-t / 0.5)) + 0.30 * (1 - exp(-t / 5))"))
    d = d.unionByName(curve(spark, "triple", 800, 200, "0.1 + 0.3 * (1 - exp(-t)) + 0.3 * (1 - exp(-t / 12)) + 0.2 * (1 - exp(-t / 80))"))
    return d.unionByName(curve(spark, "noisy", 200, 5, f"0.8 * (1 - exp(-t / 0.25)) + {noise}")).cache()


def test_sums_of_exponentials(exponentials):
    r = rows(fm.add_criteria(fit.exponential_fits(exponentials, K)))
    s = r["single", "single"]
    assert s["amps"][0] == pytest.approx(0.8, abs=0.02) and s["taus"][0] == pytest.approx(0.25, rel=0.01)
    d = r["double", "double"]
    assert d["taus"] == pytest.approx([2, 40], rel=0.05) and sum(d["amps"]) == pytest.approx(0.8, abs=0.02)
    q = r["rates", "double"]
    assert q["taus"] == pytest.approx([0.5, 5.0], rel=0.01) and q["amps"] == pytest.approx([0.55, 0.30], abs=0.02)
    t = r["triple", "triple"]
    assert t["taus"] == pytest.approx([1, 12, 80], rel=0.05) and t["baseline"] == pytest.approx(0.1, abs=0.01)
    for name in ("double", "rates", "triple"):  # larger models never fit worse
        assert r[name, "single"]["rss"] >= r[name, "double"]["rss"] - 1e-9
    assert r["noisy", "single"]["bic"] < r["noisy", "triple"]["bic"]


def test_intervals_bracket_truth(exponentials):
    d = exponentials.filter("curve_id = 'noisy'")
    r = wf.single_intervals(d, fit.profile_fit(d, K, "single"), K, "t", "y").first()
    assert r["tau_lo"] < 0.25 < r["tau_hi"] and r["amp_lo"] < 0.8 < r["amp_hi"]
    assert r["d_lo"] < 1.0 < r["d_hi"] and r["d"] == pytest.approx(1 / (4 * r["tau"]))


@pytest.mark.parametrize("form,model", [("default", "soumpasis"), ("reference", "soumpasis_reference")])
def test_soumpasis(spark, form, model):
    d = curve(spark, "s", 300, 10, soumpasis("t", "0.5D", "1.0D", "0.0D", form), 0.001)
    r = fit.profile_fit(d, K, model).first()
    assert r["p0"] == pytest.approx(0.5, rel=0.02) and r["amp"] == pytest.approx(1.0, abs=0.02)


def test_soumpasis_half_recovery(spark):
    # D t_half / w^2 = 0.2236 for z = w^2 / 2Dt, with tau = w^2 / 4D
    z = soumpasis("t", "1.0D", "1.0D", "0.0D")
    got = spark.sql(f"select {z} as v from (select 4 * 0.2236D as t)").first()["v"]
    assert got == pytest.approx(0.5, abs=2e-4)


def test_stretched(spark):
    r = fit.profile_fit(curve(spark, "a", 300, 10, stretched("t", "0.7", "1.5", "0.6", "0.1"), 0.001), K, "anomalous").first()
    assert (r["p0"], r["p1"], r["amp"], r["baseline"]) == (pytest.approx(1.5, rel=0.02), pytest.approx(0.6, abs=0.01), pytest.approx(0.7, abs=0.01), pytest.approx(0.1, abs=0.01))


def test_reaction_diffusion_rates(spark):
    d = curve(spark, "rd", 2000, 100, "0.8 * (1 - 0.25 * exp(-0.05 * t) - 0.75 * exp(-2.0 * t))")
    r = wf.reaction_rates(fit.exponential_fits(d, K, (2,))).first()
    assert r["mobile_fraction"] == pytest.approx(0.8, abs=0.02) and r["k_d"] == pytest.approx(2.0, rel=0.02)
    assert r["k_on"] + r["k_off"] == pytest.approx(0.05, rel=0.02) and r["k_on"] / r["k_off"] == pytest.approx(3.0, rel=0.05)


def test_robust_fit_ignores_spikes(spark):
    d = curve(spark, "r", 300, 10, "0.8 * (1 - exp(-t)) + if(id % 25 = 7, 3.0, 0.0)".replace("id", "cast(round(t * 29.9) as int)"))
    plain = fit.profile_fit(d, K, "single").first()
    robust = fit.profile_fit(d, K, "single", robust="tukey", rounds=5).first()
    assert abs(robust["p0"] - 1) < 0.03 < abs(plain["baseline"] + plain["amp"] - 0.8)


def test_global_fit_shares_rates(exponentials):
    a = exponentials.filter("curve_id = 'double'").withColumn("grp", F.lit("g"))
    b = a.withColumn("curve_id", F.lit("other")).withColumn("y", F.expr("0.2 * (1 - exp(-t / 2)) + 0.6 * (1 - exp(-t / 40))"))
    group, curves = fit.global_exponential_fit(a.unionByName(b), ["grp"], K, 2)
    g = group.first()
    assert g["taus"] == pytest.approx([2, 40], rel=0.02) and g["curves"] == 2 and g["p"] == 8
    amps = {r["curve_id"]: r["amps"] for r in curves.collect()}
    assert amps["double"] == pytest.approx([0.5, 0.3], abs=0.01) and amps["other"] == pytest.approx([0.2, 0.6], abs=0.01)


def test_fit_does_not_depend_on_partitioning(exponentials):
    one = rows(fit.exponential_fits(exponentials.coalesce(1), K, (2,), rounds=2))
    many = rows(fit.exponential_fits(exponentials.repartition(40), K, (2,), rounds=2))
    for k in one:
        assert one[k]["rss"] == pytest.approx(many[k]["rss"], rel=1e-6, abs=1e-9) and one[k]["taus"] == pytest.approx(many[k]["taus"], rel=1e-6)


def test_fit_does_not_depend_on_other_curves(spark, exponentials):
    base = exponentials.drop("n")
    mixed = base
    for power in (-3, 3, 6):
        other = base.select(F.concat("curve_id", F.lit(f"_{power}")).alias("curve_id"), (F.col("t") * 10.0**power).alias("t"), "y")
        mixed = mixed.unionByName(other)
    alone, together = rows(fit.exponential_fits(base, K, (1, 2))), rows(fit.exponential_fits(mixed, K, (1, 2)))
    for k, r in alone.items():
        assert together[k]["taus"] == pytest.approx(r["taus"], rel=1e-6) and together[k]["amps"] == pytest.approx(r["amps"], rel=1e-6)
    for name in ("soumpasis", "anomalous", "sigmoid"):
        one, all_ = rows(fit.profile_fit(base, K, name)), rows(fit.profile_fit(mixed, K, name))
        for k, r in one.items():
            assert (all_[k]["p0"], all_[k]["amp"]) == (pytest.approx(r["p0"], rel=1e-6), pytest.approx(r["amp"], rel=1e-6))
    for power in (-3, 3, 6):  # and scales with the unit of time
        s = together[f"single_{power}", "single"]
        assert s["taus"][0] == pytest.approx(0.25 * 10.0**power, rel=1e-3)


def test_large_curves_fit_the_same(spark, exponentials, small_segments):
    d = exponentials.filter("curve_id in ('single', 'noisy')")
    spread = rows(fit.exponential_fits(d, K, (1, 2), rounds=3)), rows(fit.profile_fit(d, K, "single", rounds=3, robust="huber"))
    spark.conf.unset("spark.rekurve.segmentRows")
    local = rows(fit.exponential_fits(d, K, (1, 2), rounds=3)), rows(fit.profile_fit(d, K, "single", rounds=3, robust="huber"))
    for a, b in zip(spread, local):
        for k, r in a.items():
            assert b[k]["rss"] == pytest.approx(r["rss"], rel=1e-6, abs=1e-9)
            assert r["p0"] == pytest.approx(b[k]["p0"], rel=1e-6) if "p0" in r else r["taus"] == pytest.approx(b[k]["taus"], rel=1e-5)


def test_every_curve_keeps_its_row(spark):
    d = spark.createDataFrame([("point", 0.0, 1.0), ("flat", 0.0, 2.0), ("flat", 1.0, 2.0), ("flat", 2.0, 2.0), ("two", 1.0, 1.0), ("two", 2.0, 3.0)], "curve_id string, t double, y double")
    assert {r["curve_id"] for r in fit.profile_fit(d, K, "single").collect()} == {"point", "flat", "two"}
    got = rows(fit.exponential_fits(d, K, (1, 2)))
    assert len(got) == 6 and got["point", "single"]["rss"] is None and got["point", "single"]["n"] == 1


def test_spectrum_is_the_minimum():
    import itertools


    rng = np.random.default_rng(3)
    for _ in range(30):
        a = rng.normal(size=(9, 6))
        h, c = a.T @ a + 1e-6 * np.eye(6), rng.normal(size=6)
        x = fit.nonnegative(h, c)
        best = min(((0.5 * z @ h @ z - c @ z), i) for i, z in enumerate(_corners(h, c, itertools, np)))[0]
        assert (x >= 0).all() and 0.5 * x @ h @ x - c @ x == pytest.approx(best, rel=1e-9, abs=1e-12)
        g = h @ x - c
        assert (g >= -1e-9).all() and np.abs(g[x > 0]).max(initial=0) < 1e-9


def _corners(h, c, itertools, np):
    yield np.zeros(len(c))
    for k in range(1, len(c) + 1):
        for s in itertools.combinations(range(len(c)), k):
            z = np.zeros(len(c))
            z[list(s)] = np.linalg.solve(h[np.ix_(s, s)], c[list(s)])
            if (z >= 0).all():
                yield z


def test_delta_labels(spark):
    from rekurve.operators.quality import delta_aic_bucket

    got = [r[0] for r in spark.createDataFrame([(1.0,), (3.0,), (5.0,), (8.0,), (12.0,), (None,)], "d double").select(delta_aic_bucket(F.col("d"))).collect()]
    assert got == ["substantial support", "moderate support", "considerably less support", "moderate support", "essentially no support", None]


def test_weighted_mean_fit(spark):
    d = curve(spark, "w", 100, 10, "0.8 * (1 - exp(-t)) + if(t > 5, 0.5, 0.0)").withColumn("w", F.when(F.col("t") > 5, 1e-9).otherwise(1.0))
    r = fit.profile_fit(d, K, "single", weight="w").first()
    assert r["p0"] == pytest.approx(1.0, rel=0.01)


def test_criteria_small_samples(spark):
    d = spark.createDataFrame([(4, 3, 0.1, 1.0), (20, 3, 0.1, 1.0)], "n int, p int, rss double, sst double")
    a, b = fm.add_criteria(d).orderBy("n").collect()
    assert a["aic"] == float("inf") and a["adj_r2"] is None
    assert b["aicc"] == pytest.approx(b["aic"] + 2 * 3 * 4 / 16)


def test_nested_choice_keeps_simple(exponentials):
    f = fm.add_criteria(fit.exponential_fits(exponentials, K)).cache()
    got = {r["curve_id"]: r["model"] for r in wf.nested_choice(*[f.filter(F.col("model") == m) for m in ("single", "double", "triple")], K).collect()}
    assert got["noisy"] == "single" and got["double"] != "single"


def test_mw_calibration(spark):
    d = spark.createDataFrame([(10.0, 50.0), (100.0, 5.0), (1000.0, 0.5)], "mw double, d double")
    line = fm.calibrate_mw(d, "mw", "d")
    r = fm.predict_mw(spark.createDataFrame([(2.5,)], "d double"), line, "d").first()
    assert 10 ** r["log_mw"] == pytest.approx(200.0, rel=1e-6)


def test_subsets_against_plain_least_squares():
    """Every combination of up to three columns: amplitudes and residual sum of NumPy's solver; infinite where one is negative."""
    import itertools

    from rekurve.operators.fit import SLICE_CURVES, _best_subset, solve_subsets

    rng = np.random.default_rng(4)
    t, taus = np.linspace(0.1, 20, 50), np.geomspace(0.2, 60, 7)
    x = 1 - np.exp(-t[:, None] / taus)
    ys = np.array([0.2 + x[:, [1, 3, 5]] @ rng.uniform(0.1, 1, 3) + rng.normal(0, 0.2, 50) for _ in range(SLICE_CURVES + 3)])
    many = np.ones(len(ys))
    n, sx, gram = 50 * many, np.outer(many, x.sum(0)), np.repeat((x.T @ x)[None], len(ys), 0)
    for s in (1, 2, 3):
        combos = np.array(list(itertools.combinations(range(7), s)))
        m, rss = solve_subsets(n, ys.sum(1), (ys**2).sum(1), sx, ys @ x, gram, combos, np.inf)
        for c, y in enumerate(ys[:20]):
            for k, cols in enumerate(combos):
                a = np.column_stack([np.ones(50), x[:, cols]])
                want = np.linalg.lstsq(a, y, rcond=None)[0]
                r = np.corrcoef(x[:, cols].T) if s > 1 else np.eye(1)
                if np.linalg.det(r) < 1e-8 or abs(want[1:]).min() < 1e-6:
                    continue
                if (want[1:] < 0).any():
                    assert np.isinf(rss[c, k])
                else:
                    assert m[c, k] == pytest.approx(want[1:], rel=1e-5) and rss[c, k] == pytest.approx(((y - a @ want) ** 2).sum(), rel=1e-7)


def test_passes_form_no_products_of_rows():
    """A pass over twenty thousand points of 400 curves takes little memory: sums of products are made a slice at a time."""
    import tracemalloc

    import pandas as pd

    from rekurve.operators import fit

    t = np.tile(np.geomspace(0.1, 50, 50), 400)
    b = pd.DataFrame({"curve_id": np.repeat(np.arange(400), 50), "t": t, "y": 0.1 + 0.5 * (1 - np.exp(-t / 3)), "_lo": 0.1, "_hi": 50.0})
    p = fit.profile_pass(["curve_id"], fit.MODELS["power_law"], "curve_id long")
    tracemalloc.start()
    w = fit._local_round(b, np.arange(0, 20_000, 50), "t", "y", p)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(w) == 400 and peak < 40e6  # the columns of all rows are 23 MB, their products three times that, and as much again for parameters
