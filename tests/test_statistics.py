"""Tails against published values, tests against hand-checked numbers, resampling and mixed models on known data."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rekurve.functions import tails
from rekurve.operators import resample as rs, stats as st


def value(spark, col):
    return spark.range(1).select(col.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "make,want",
    [
        (lambda: tails.t_two_sided(F.lit(2.228139), F.lit(10)), 0.05),
        (lambda: tails.t_two_sided(F.lit(12.706205), F.lit(1)), 0.05),
        (lambda: tails.f_upper(F.lit(4.102821), F.lit(2), F.lit(10)), 0.05),
        (lambda: tails.chi2_upper(F.lit(5.991465), F.lit(2)), 0.05),
        (lambda: tails.chi2_upper(F.lit(18.307038), F.lit(10)), 0.05),
        (lambda: tails.normal_two_sided(F.lit(1.959964)), 0.05),
        (lambda: tails.normal_quantile(F.lit(0.975)), 1.959963985),
        (lambda: tails.t_critical(F.lit(0.975), F.lit(10)), 2.228138852),
    ],
)
def test_tails(spark, make, want):
    assert value(spark, make()) == pytest.approx(want, abs=1e-6)


def test_tail_of_null(spark):
    assert value(spark, tails.t_two_sided(F.lit(None).cast("double"), F.lit(3))) is None


def test_shapiro_published_sample(spark):
    # weights of eleven men, the textbook example: W = 0.79
    v = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]
    r = st.shapiro(spark.createDataFrame([("a", float(x)) for x in v], "g string, v double"), "g", "v").first()
    assert r["w"] == pytest.approx(0.79, abs=0.005) and r["p_value"] == pytest.approx(0.0067, abs=0.001)


def test_shapiro_detects_skew(spark):
    nd = __import__("statistics").NormalDist()
    rows = [("normal", nd.inv_cdf((i + 0.5) / 200)) for i in range(200)] + [("skewed", math.exp(2 * nd.inv_cdf((i + 0.5) / 200))) for i in range(200)]
    p = {r["g"]: r["p_value"] for r in st.shapiro(spark.createDataFrame(rows, "g string, v double"), "g", "v").collect()}
    assert p["normal"] > 0.9 and p["skewed"] < 1e-6


def test_adjustments(spark):
    p = [0.01, 0.04, 0.03, None, 0.5]
    d = spark.createDataFrame([(i, x) for i, x in enumerate(p)], "i int, p double")
    got = {m: [r["p_adj"] for r in st.adjust(d, "p", m).orderBy("i").collect()] for m in ("bonferroni", "holm", "bh", "by")}
    assert got["bonferroni"] == pytest.approx([0.04, 0.16, 0.12, None, 1.0])
    assert got["holm"] == pytest.approx([0.04, 0.09, 0.09, None, 0.5])
    assert got["bh"] == pytest.approx([0.04, 0.16 / 3, 0.16 / 3, None, 0.5])
    assert got["by"] == pytest.approx([min(1, x * 25 / 12) if x else None for x in [0.04, 0.16 / 3, 0.16 / 3, None, 0.5]])


def test_mann_whitney_counts_wins(spark):
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 12, 40), rng.integers(2, 14, 55)
    d = spark.createDataFrame([("a", int(x)) for x in a] + [("b", int(x)) for x in b], "g string, v int")
    r = st.rank_effects(st.mann_whitney(d, "g", "v")).first()
    wins = (a[:, None] > b[None]).sum() + 0.5 * (a[:, None] == b[None]).sum()
    assert r["u1"] == pytest.approx(wins) and r["cliffs_delta"] == pytest.approx(((a[:, None] > b).sum() - (a[:, None] < b).sum()) / (40 * 55))


def test_mann_whitney_of_all_pairs_in_ranges(spark, monkeypatch):
    """Ranges of values are counted once for all pairs, a few rows at a time; no pair of groups is ranked by itself."""
    monkeypatch.setattr(st, "value_ranks", None)
    monkeypatch.setattr(st, "WINS_ROWS", 5)
    monkeypatch.setattr(st, "WINS_CELLS", 8)
    rng = np.random.default_rng(9)
    own = {g: rng.integers(lo, lo + 30, n) for g, lo, n in (("d", 0, 70), ("b", 9, 50), ("a", 25, 40), ("c", 60, 5))}
    rows = [(g, float(x)) for g, v in own.items() for x in v] + [("a", None), ("b", float("nan")), (None, 3.0)]
    got = {(r["g1"], r["g2"]): r for r in st.mann_whitney(spark.createDataFrame(rows, "g string, v double").repartition(5), "g", "v").collect()}
    assert sorted(got) == [(p, q) for p in "abcd" for q in "abcd" if p < q]
    for (p, q), r in got.items():
        x, y = own[p], own[q]
        u = (x[:, None] > y).sum() + 0.5 * (x[:, None] == y).sum()
        n, t = len(x) + len(y), np.unique(np.r_[x, y], return_counts=True)[1].astype(float)
        sd = math.sqrt(len(x) * len(y) / 12 * ((n + 1) - (t**3 - t).sum() / (n * (n - 1))))
        assert (r["n1"], r["n2"], r["u1"]) == (len(x), len(y), u) and r["z"] == pytest.approx((max(u, len(x) * len(y) - u) - len(x) * len(y) / 2 - 0.5) / sd)


def test_mixed_model_recovers_effect(spark):
    rng = np.random.default_rng(11)
    rows = []
    for j in range(40):
        shift = rng.normal(0, 1.0)
        rows += [(f"b{j}", g, float(5 + shift + (0.8 if g == "t" else 0) + rng.normal(0, 0.5))) for g in ("c", "t") for _ in range(10)]
    r = st.mixed_model(spark.createDataFrame(rows, "batch string, g string, v double"), "g", "v", "batch", "c").first()
    assert r["lo"] < 0.8 < r["hi"] and r["beta"] == pytest.approx(0.8, abs=0.12)
    # balanced batches: the restricted likelihood agrees with the analysis of variance
    y = np.array([v for *_, v in rows]).reshape(40, 2, 10)
    y = y - y.mean((0, 2))[None, :, None]
    within = ((y - y.mean((1, 2))[:, None, None]) ** 2).sum() / (800 - 40 - 1)
    between = 20 * (y.mean((1, 2)) ** 2).sum() / 39
    assert r["lam"] == pytest.approx((between / within - 1) / 20, rel=0.02) and r["sigma2"] == pytest.approx(within, rel=0.01) and r["sigma2"] == pytest.approx(0.25, rel=0.15)
    assert r["se"] == pytest.approx(math.sqrt(0.25 * 2 / 400), rel=0.1)  # within-batch comparison: batches cancel


def test_bootstrap_interval_covers_mean(spark):
    rng = np.random.default_rng(5)
    d = spark.createDataFrame([("a", i, float(x)) for i, x in enumerate(rng.normal(3, 1, 60))], "g string, i int, v double")
    boot = rs.bootstrap(d, ["g"], "v", ["i"], 400).cache()
    r = rs.bca_interval(d, boot, "g", "v").first()
    se = d.agg(F.stddev_samp("v") / math.sqrt(60)).first()[0]
    assert r["lo"] == pytest.approx(r["est"] - 1.96 * se, abs=0.5 * se) and r["hi"] == pytest.approx(r["est"] + 1.96 * se, abs=0.5 * se)


def test_bca_interval_of_moment_replicates(spark):
    """Replicates of ``bootstrap_moments`` have a column ``n``, as the groups do; same interval as with those of ``bootstrap``."""
    rng = np.random.default_rng(6)
    d = spark.createDataFrame([("ab"[i % 2], i, float(x)) for i, x in enumerate(rng.gamma(2, 1, 80))], "g string, i int, v double")
    moments = rs.bca_interval(d, rs.bootstrap_moments(d, ["g"], "v", ["i"], 200).withColumnRenamed("mean", "stat"), "g", "v").orderBy("g").collect()
    plain = rs.bca_interval(d, rs.bootstrap(d, ["g"], "v", ["i"], 200), "g", "v").orderBy("g").collect()
    assert len(moments) == 2 and [r.asDict() for r in moments] == [pytest.approx(r.asDict()) for r in plain]


def test_bootstrap_range_is_that_of_the_plain_replicates(spark):
    """Same rows as any aggregate of the same draws, without a row for each value and replicate."""
    rows = [(None if i % 3 == 2 else "ab"[i % 3], i, None if i % 7 == 0 else float(i * 37 % 101)) for i in range(90)]
    d = spark.createDataFrame([*rows, ("one", 1, 5.0)], "g string, i int, v double")
    fast = rs.bootstrap_range(d, ["g"], "v", ["i"], 60)
    plan = fast._jdf.queryExecution().optimizedPlan().toString()
    assert "explode" not in plan
    key = lambda r: (str(r.g), r.rep)
    want = sorted(rs.bootstrap(d, ["g"], "v", ["i"], 60, lambda c: F.max(c) - F.min(c)).collect(), key=key)
    assert [tuple(r) for r in sorted(fast.collect(), key=key)] == [tuple(r) for r in want] and len(want) < 4 * 60


def test_permutation_p_small_for_real_shift(spark):
    d = spark.createDataFrame([("a" if i % 2 else "b", i, float(i % 7) + (3.0 if i % 2 else 0)) for i in range(80)], "g string, i int, v double")
    p = rs.permutation_p(rs.permutation_test(d, "g", "v", "i", "a", "b", 200)).first()
    assert p["p_value"] < 0.02 and p["reps"] == 200


def test_wasserstein_of_shifted_copy(spark):
    rows = [("a", float(i)) for i in range(50)] + [("b", float(i) + 5) for i in range(50)]
    d = spark.createDataFrame(rows, "g string, v double")
    sd = np.std([r[1] for r in rows])
    assert st.wasserstein(d, "g", ["v"], "a", "b").first()["w1"] == pytest.approx(5 / sd)
