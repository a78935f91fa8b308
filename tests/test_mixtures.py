"""Mixtures of many groups at once, density fallback and silhouette, against plain forms."""

import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from rekurve.operators import cluster as cl, mixtures as mx
from rekurve.operators.ordered import SEGMENT_CONF


def plain_em(x, k, start):
    """One group, one configuration, row by row: log likelihood and shares."""
    n, d = x.shape
    x = (x - x.mean(0)) / x.std(0)
    cov = x.T @ x / n
    size, axes = np.linalg.eigh(cov)
    which = d - 1 - start % d
    axis = axes[:, which] * np.sign(axes[:, which].sum() + 1e-12)
    at = [NormalDist().inv_cdf((j + 0.5) / k) for j in range(k)]
    w, mean, cs = [1 / k] * k, [a * math.sqrt(size[which]) * axis for a in at], [cov / k + mx.RIDGE * np.eye(d)] * k
    last = -np.inf
    for _ in range(mx.MOST):
        p = np.array([[wj * math.exp(-0.5 * (r - m) @ np.linalg.inv(c) @ (r - m)) / math.sqrt((2 * math.pi) ** d * np.linalg.det(c)) for wj, m, c in zip(w, mean, cs)] for r in x])
        ll, share = np.log(p.sum(1)).sum(), p / p.sum(1, keepdims=True)
        if ll - last <= mx.SETTLED * n:
            return ll, share
        last, t = ll, share.sum(0)
        w, mean = t / n, [share[:, j] @ x / t[j] for j in range(k)]
        cs = [(share[:, j, None] * (x - mean[j])).T @ (x - mean[j]) / t[j] + mx.RIDGE * np.eye(d) for j in range(k)]
    return last, share


def planted(rng, means, n, sd=0.3):
    return np.vstack([rng.normal(m, sd, (n, 2)) for m in means])


@pytest.fixture(scope="module")
def three():
    rng = np.random.default_rng(4)
    return {"one": planted(rng, [(0, 0)], 90), "two": planted(rng, [(0, 0), (3, 2)], 60), "three": planted(rng, [(0, 0), (4, 0), (0, 5)], 50), None: planted(rng, [(1, 1), (5, 5)], 40)}


def table(spark, groups):
    return spark.createDataFrame([(i, g, float(a), float(b)) for i, (g, a, b) in enumerate((g, a, b) for g, x in groups.items() for a, b in x)], "id long, grp string, a double, b double").repartition(5)


def clusters(rows, groups):
    """By group: components, and the partition as sets of positions."""
    first, out = {}, {}
    for r in sorted(rows, key=lambda r: r.id):
        first.setdefault(r.grp, r.id)
        out.setdefault(r.grp, (r.k, {}))[1].setdefault(r.cluster, set()).add(r.id - first[r.grp])
    return {g: (k, sorted(map(sorted, c.values()))) for g, (k, c) in out.items()}


def test_against_plain_em(three):
    x = np.vstack(list(three.values()))
    at = np.cumsum([0, *map(len, three.values())])[:-1]
    cluster, prob, ks, bic = mx.fit_groups(x, at, 3, 2, None, 3)
    assert ks.tolist() == [1, 2, 3, 2]
    for g, (lo, own) in enumerate(zip(at, three.values())):
        n, found = len(own), []
        for k in (2, 3):
            for s in (0, 1):
                ll, share = plain_em(own, k, s)
                small = np.bincount(share.argmax(1), minlength=k).min() < 3
                found.append((math.inf if small else -2 * ll + (k * 5 + k - 1) * math.log(n), k, share))
        best = min(found, key=lambda f: f[0])
        if ks[g] > 1:
            assert bic[g] == pytest.approx(best[0], rel=1e-7) and ks[g] == best[1]
            assert prob[lo : lo + n] == pytest.approx(best[2].max(1), abs=1e-5) and (cluster[lo : lo + n] == best[2].argmax(1)).all()
        else:
            assert bic[g] < best[0]


def test_groups_and_hot_groups(spark, three):
    d = table(spark, three)
    want = clusters(mx.group_mixtures(d, ["grp"], ["a", "b"]).collect(), three)
    assert {g: k for g, (k, _) in want.items()} == {"one": 1, "two": 2, "three": 3, None: 2}
    assert want["three"][1] == [list(range(50)), list(range(50, 100)), list(range(100, 150))]
    spark.conf.set(SEGMENT_CONF, "100")  # two groups are now too large for a task
    try:
        assert clusters(mx.group_mixtures(d, ["grp"], ["a", "b"]).collect(), three) == want
    finally:
        spark.conf.unset(SEGMENT_CONF)


def test_gain(spark, three):
    """A further component must gain enough; otherwise the search stops."""
    d = table(spark, three)
    ks = {r.grp: r.k for r in mx.group_mixtures(d, ["grp"], ["a", "b"], gain=1e6).collect()}
    assert set(ks.values()) == {1}


def test_ten_thousand_groups(spark):
    """Many groups in one exchange: groups of even number have two components."""
    d = spark.range(40 * 10_000).select("id", (F.col("id") % 10_000).alias("grp"), F.floor(F.col("id") / 10_000).alias("i"))
    d = d.withColumn("a", F.when((F.col("grp") % 2 == 0) & (F.col("i") % 2 == 0), 8.0).otherwise(0.0) + F.randn(3)).withColumn("b", F.randn(4))
    got = mx.group_mixtures(d, ["grp"], ["a", "b"], 2).groupBy("grp").agg(F.first("k").alias("k"))
    share = got.groupBy((F.col("grp") % 2).alias("odd")).agg(F.avg((F.col("k") == 2).cast("int")).alias("two"), F.count(F.lit(1)).alias("n")).collect()
    found = {r.odd: (r.two, r.n) for r in share}
    assert found[0][1] == found[1][1] == 5000 and found[0][0] > 0.97 and found[1][0] < 0.2


def test_missing_and_small(spark):
    rows = [(1, "x", 1.0, 2.0), (2, "x", None, 1.0), (3, "x", float("nan"), 1.0), (4, "y", 1.0, float("inf")), (5, "z", 2.0, 2.0), (6, "z", 2.0, 2.0)]
    d = spark.createDataFrame(rows, "id long, grp string, a double, b double")
    got = {r.id: (r.cluster, r.k) for r in mx.group_mixtures(d, ["grp"], ["a", "b"]).collect()}
    assert got == {1: (0, 1), 2: (None, None), 3: (None, None), 4: (None, None), 5: (0, 1), 6: (0, 1)}
    assert mx.group_mixtures(d.limit(0), ["grp"], ["a", "b"]).count() == 0


def test_kinetic_subpopulations(spark):
    """Labels by falling diffusion in each group; what has no logarithm has no label."""
    rng = np.random.default_rng(9)
    rows = [(i, "ctrl" if i % 3 else "mut", float(10 ** rng.normal(1 if i % 2 else -1, 0.1)), float(10 ** rng.normal(0, 0.1))) for i in range(300)] + [(900, "ctrl", -1.0, 2.0), (901, "ctrl", None, 2.0)]
    d = spark.createDataFrame(rows, "id long, grp string, d double, r double")
    got = {r.id: r.label for r in cl.kinetic_subpopulations(d, "id", "grp", "d", "r").collect()}
    assert len(got) == 302 and got[900] is None and got[901] is None and all(got[i] == (0 if i % 2 else 1) for i in range(300))


def test_density_fallback(spark):
    """One component by BIC: a ring around a core is not normal, but density finds both."""
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (60, 2))
    d = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id long, x double, y double")
    out, k, bics = cl.mixture(d, ["x", "y"], 3, "low", fallback="id")
    rows = out.collect()
    assert len(rows) == 60 and k == len({r.cluster for r in rows} - {-1}) and all(r.cluster_prob == (0.0 if r.cluster < 0 else 1.0) for r in rows)
    assert any(r.cluster < 0 for r in rows)
    again, k, _ = cl.mixture(d, ["x", "y"], 3, "low")
    assert k == 1 and {r.cluster for r in again.collect()} == {0}


def test_silhouette(spark):
    rng = np.random.default_rng(7)
    x, c = rng.normal(50, 1, (300, 2)), rng.integers(-1, 4, 300)
    x[:, 0] += 2 * c
    c[7] = 9  # alone
    d = spark.createDataFrame([(int(k), float(a), float(b)) for k, (a, b) in zip(c, x)] + [(1, None, 2.0)], "c int, a double, b double")
    keep = c != -1
    x, c = x[keep], c[keep]
    dist = ((x[:, None] - x[None]) ** 2).sum(2)
    want = []
    for i in range(len(x)):
        mean = {k: dist[i][(c == k) & (np.arange(len(x)) != i)].mean() for k in set(c) if ((c == k) & (np.arange(len(x)) != i)).any()}
        if c[i] not in mean:
            want.append(0.0)
            continue
        a, b = mean.pop(c[i]), min(mean.values())
        want.append((b - a) / max(a, b))
    assert cl.silhouette(d, ["a", "b"], "c").first()[0] == pytest.approx(np.mean(want), abs=1e-9)
    assert cl.silhouette(d.filter("c = 1"), ["a", "b"], "c").first()[0] is None


def test_sums_of_one_group_are_those_of_many():
    from rekurve.operators import mixtures as mx

    rng = np.random.default_rng(6)
    x, k = rng.normal(size=(500, 2)) * [1, 3] + [0, 2], 3
    theta = mx.first_guess(np.cov(x.T, bias=True)[None], k, 1)
    single = mx._expected_of_one(x, theta, k)
    both = mx.expected(np.concatenate([x, x + 1]), np.repeat([0, 1], 500), np.concatenate([theta, theta]), k)
    assert np.allclose(single, both[0], rtol=1e-10)
    assert np.allclose(single, mx.expected(x, np.zeros(500, int), theta, k)[0], rtol=1e-12)
