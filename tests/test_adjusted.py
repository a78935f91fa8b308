"""Tail probabilities against closed forms, adjusted p values against a plain loop."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rekurve.functions import tails
from rekurve.operators import stats as st


def test_tails_closed_forms():
    x = np.array([0.0, 0.01, 0.3, 0.5, 0.77, 0.999, 1.0])
    assert tails.betainc(1, 1, x) == pytest.approx(x)
    assert tails.betainc(3, 1, x) == pytest.approx(x**3, rel=1e-13)
    assert tails.betainc(0.5, 0.5, x) == pytest.approx(2 / math.pi * np.arcsin(np.sqrt(x)), rel=1e-12)
    assert tails.betainc(4, 7, 0.3) == pytest.approx(sum(math.comb(10, k) * 0.3**k * 0.7 ** (10 - k) for k in range(4, 11)), rel=1e-13)
    y = np.array([0.0, 1e-3, 0.4, 2.0, 9.0, 40.0, 200.0])
    assert tails.gammaincc(1, y) == pytest.approx(np.exp(-y), rel=1e-12)
    assert tails.gammaincc(3, y) == pytest.approx(np.exp(-y) * (1 + y + y * y / 2), rel=1e-12)
    assert tails.gammaincc(0.5, y) == pytest.approx([math.erfc(math.sqrt(v)) for v in y], rel=1e-12)
    assert tails.lgamma(np.array([0.1, 0.5, 1.0, 2.5, 30.0, 1e5])) == pytest.approx([math.lgamma(v) for v in (0.1, 0.5, 1.0, 2.5, 30.0, 1e5)], rel=1e-13, abs=1e-13)
    assert tails.t_sf(np.array([1.0, -1.0, 0.0]), 1) == pytest.approx([0.25, 0.75, 0.5])
    assert tails.t_quantile(np.array([0.975, 0.5]), np.array([1.0, 8.0])) == pytest.approx([math.tan(math.pi * 0.475), 0], rel=1e-9, abs=1e-7)
    p = np.array([1e-300, 1e-9, 0.01, 0.3, 0.5, 0.9, 1 - 1e-9])
    from statistics import NormalDist

    assert tails.norm_ppf(p) == pytest.approx([NormalDist().inv_cdf(v) for v in p], rel=1e-12, abs=1e-12)
    assert np.isnan(tails.betainc(-1, 1, 0.5)) and np.isnan(tails.norm_ppf(0.0))


def plain(p, method):
    known = sorted((v, i) for i, v in enumerate(p) if v is not None)
    m, out, keep = len(known), [None] * len(p), 0.0
    if method == "holm":
        for r, (v, i) in enumerate(known):
            keep = max(keep, v * (m - r))
            out[i] = min(1.0, keep)
        return out
    keep, c = 1.0, sum(1 / k for k in range(1, m + 1)) if method == "by" else 1.0
    for r in range(m, 0, -1):
        v, i = known[r - 1]
        keep = min(keep, v * m / r * c)
        out[i] = keep
    return out


@pytest.mark.parametrize("method", ["holm", "bh", "by"])
@pytest.mark.parametrize("hot", [False, True])
def test_adjust(spark, request, method, hot):
    if hot:
        request.getfixturevalue("small_segments")
    rng = np.random.default_rng(2)
    p = [None if k % 17 == 0 else round(float(v), 2) if k % 3 else float(v) ** 6 for k, v in enumerate(rng.random(150))]
    d = spark.createDataFrame([("a", i, v) for i, v in enumerate(p)] + [("b", 0, 0.03), ("c", 0, None)], "fam string, i int, p double")
    got = {(r["fam"], r["i"]): r["p_adj"] for r in st.adjust(d, "p", method, ["fam"]).collect()}
    assert [got["a", i] for i in range(150)] == [None if v is None else pytest.approx(v, rel=1e-12) for v in plain(p, method)]
    assert got["b", 0] == pytest.approx(0.03) and got["c", 0] is None
    whole = {r["i"]: r["p_adj"] for r in st.adjust(d.filter("fam = 'a'"), "p", method).collect()}
    assert whole == {i: got["a", i] for i in range(150)}


def test_many_in_one_family(spark):
    d = spark.range(1_000_000).select(F.col("id"), (F.rand(3) * F.rand(4)).alias("p"))
    r = st.adjust(d, "p", "by").agg(F.count("p_adj").alias("n"), F.min(F.col("p_adj") >= F.col("p")).alias("ok")).first()
    assert r["n"] == 1_000_000 and r["ok"]
