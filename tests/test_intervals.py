"""Intervals of fitted parameters: against the normal matrix of one curve, and against what the data were made from."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rekurve.functions.basis import MODELS
from rekurve.operators import fit, intervals as iv
from rekurve.operators.ordered import SEGMENT_CONF

K = ["curve_id"]
TRUE = {
    "single": {"baseline": 0.1, "amp": 0.7, "tau": 3.0},
    "double": {"baseline": 0.05, "amp1": 0.4, "tau1": 1.0, "amp2": 0.4, "tau2": 25.0},
    "triple": {"baseline": 0.1, "amp1": 0.3, "tau1": 0.5, "amp2": 0.3, "tau2": 8.0, "amp3": 0.25, "tau3": 90.0},
    "anomalous": {"baseline": 0.1, "amp": 0.7, "p0": 4.0, "p1": 0.6},
    "soumpasis": {"baseline": 0.05, "amp": 0.8, "p0": 2.0},
}


def value(model, t, p):
    if model in iv.SUMS:
        amps, taus = [v for k, v in p.items() if k.startswith("amp")], [v for k, v in p.items() if k.startswith("tau")]
        return p["baseline"] + sum(a * (1 - np.exp(-t / s)) for a, s in zip(amps, taus))
    return p["baseline"] + p["amp"] * MODELS[model].basis(t, *[v for k, v in p.items() if k.startswith("p")])


def curves(spark, model, count=40, n=400, noise=0.01):
    rng = np.random.default_rng(len(model))
    t = np.geomspace(0.05, 300, n)
    y = value(model, t, TRUE[model])
    return spark.createDataFrame([(c, float(a), float(b)) for c in range(count) for a, b in zip(t, y + rng.normal(0, noise, n))], "curve_id long, t double, y double"), t


def fitted(d, model):
    return fit.exponential_fits(d, K, (iv.SUMS[model],)) if model in iv.SUMS else fit.profile_fit(d, K, model)


@pytest.mark.parametrize("model", list(TRUE))
def test_intervals_hold_the_truth(spark, model):
    """Forty noisy curves: 95 % intervals hold the parameter in most of them, and their width is that of the scatter."""
    d, t = curves(spark, model)
    rows = iv.parameter_intervals(d, fitted(d, model), K, model).collect()
    of = {}
    for r in rows:
        of.setdefault(r.parameter, []).append(r)
    want = dict(TRUE[model])
    want["amp_total"] = sum(v for k, v in want.items() if k.startswith("amp"))
    taus = {"d" + k[3:]: 1 / (4 * v) for k, v in want.items() if k.startswith("tau")}
    want |= taus | ({"d": 1 / (4 * want["p0"])} if model == "soumpasis" else {})
    assert of.keys() == want.keys() and all(len(v) == 40 for v in of.values())
    for name, true in want.items():
        held = [r.lo <= true <= r.hi for r in of[name]]
        assert np.mean(held) >= 0.8, name
        assert 0.5 < np.mean([r.se for r in of[name]]) / np.std([r.estimate for r in of[name]]) < 2, name
        assert all(r.reason is None and r.lo <= r.estimate <= r.hi for r in of[name])


def test_against_plain_matrix(spark):
    """One curve: covariance of a double fit from numeric derivatives in NumPy; the wider quantile of t."""
    d, t = curves(spark, "double", count=1, n=30)
    f = fitted(d, "double")
    r = f.first()
    got = {x.parameter: x for x in iv.parameter_intervals(d, f, K, "double").collect()}
    wide = {x.parameter: x for x in iv.parameter_intervals(d, f, K, "double", quantile="t").collect()}
    p = np.array([r.baseline, r.amps[0], r.taus[0], r.amps[1], r.taus[1]])
    names = ["baseline", "amp1", "tau1", "amp2", "tau2"]
    j = np.stack([(value("double", t, dict(zip(names, p + h))) - value("double", t, dict(zip(names, p - h)))) / (2 * h.max()) for h in np.diag(p * 1e-6)], 1)
    cov = np.linalg.inv(j.T @ j) * r.rss / (30 - 5)
    for i, name in enumerate(names):
        assert got[name].se == pytest.approx(np.sqrt(cov[i, i]), rel=1e-4)
        assert got[name].hi - got[name].estimate == pytest.approx(1.959964 * got[name].se, rel=1e-5)
        assert wide[name].hi - wide[name].estimate == pytest.approx(2.059539 * got[name].se, rel=1e-4)  # 25 degrees of freedom
    assert got["amp_total"].se == pytest.approx(np.sqrt(cov[1, 1] + cov[3, 3] + 2 * cov[1, 3]), rel=1e-4)
    assert got["d1"].lo == pytest.approx(1 / (4 * got["tau1"].hi)) and got["d1"].hi == pytest.approx(1 / (4 * got["tau1"].lo))


def test_hot_curves_and_reasons(spark):
    d, _ = curves(spark, "single", count=3)
    odd = spark.createDataFrame([(10, 1.0, 0.5)] + [(11, float(i), 0.3) for i in range(20)] + [(12, float(i), 0.2 * i) for i in range(3)], "curve_id long, t double, y double")
    d = d.unionByName(odd)
    f = fitted(d, "single")
    key = lambda r: (r.curve_id, r.parameter)
    want = {key(r): r for r in iv.parameter_intervals(d, f, K, "single").collect()}
    assert len(want) == 6 * 5 and want[10, "tau"].reason == "no fit" and want[12, "amp"].reason == "not determined"
    assert all(want[c, "tau"].lo is None for c in (10, 12)) and want[0, "tau"].reason is None
    assert want[11, "tau"].lo is None or want[11, "tau"].lo < 0 and want[11, "d"].lo is None  # flat: any time constant will do
    spark.conf.set(SEGMENT_CONF, "7")
    try:
        for r in iv.parameter_intervals(d, fitted(d, "single"), K, "single").collect():
            assert r.curve_id == 11 or (r.se is None) == (want[key(r)].se is None) and (r.se is None or r.se == pytest.approx(want[key(r)].se, rel=1e-4))
    finally:
        spark.conf.unset(SEGMENT_CONF)
