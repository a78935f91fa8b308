"""Neighbours, clusters and outliers against brute force on small tables with copies."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rekurve.operators import cluster as cl, neighbors as nb, outliers as ol, tracks as tr


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(0, 1, (150, 2)), rng.normal(8, 0.5, (120, 2)), rng.uniform(-5, 14, (30, 2)), np.tile([[2.0, 2.0]], (40, 1))])
    return x, spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id long, x double, y double").cache()


def test_nearest_neighbours_with_small_cells(cloud):
    x, d = cloud
    got = {}
    for r in nb.knn(d, "id", ["x", "y"], 6, cell_rows=16).collect():
        got.setdefault(r["id"], []).extend([r["dist"]] * r["m"])
    dist = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(dist, np.inf)
    keys = {tuple(p): i for i, p in reversed(list(enumerate(x)))}
    assert len(got) == len(keys)
    for i in keys.values():
        assert sorted(got[i]) == pytest.approx(sorted(dist[i])[:6], abs=1e-9)


def test_local_outlier_factor(cloud):
    x, d = cloud
    lof = {r["id"]: r["lof"] for r in nb.local_outlier_factor(d.filter("id < 300"), "id", ["x", "y"], 10).collect()}
    y = x[:300]
    dist = np.sqrt(((y[:, None] - y[None]) ** 2).sum(2))
    np.fill_diagonal(dist, np.inf)
    nn = np.argsort(dist, axis=1)[:, :10]
    kd = np.sort(dist, axis=1)[:, 9]
    lrd = 1 / (np.maximum(np.take_along_axis(dist, nn, 1), kd[nn]).mean(1) + 1e-10)
    want = lrd[nn].mean(1) / lrd
    assert [lof[i] for i in range(300)] == pytest.approx(list(want), rel=1e-6)


def brute_dbscan(x, eps, m):
    close = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) <= eps
    core = close.sum(1) >= m
    lab = np.full(len(x), -1)
    c = 0
    for i in np.flatnonzero(core):
        if lab[i] >= 0:
            continue
        todo = [i]
        while todo:
            j = todo.pop()
            if lab[j] < 0 and core[j]:
                lab[j] = c
                todo += list(np.flatnonzero(close[j] & core & (lab < 0)))
        c += 1
    return core, lab, close


@pytest.mark.parametrize("eps", [0.4, 0.9, 2.0])
def test_dbscan(cloud, eps):
    x, d = cloud
    got = nb.dbscan(d, "id", ["x", "y"], eps, 5).orderBy("id").toPandas()
    core, lab, close = brute_dbscan(x, eps, 5)
    assert (got["core"].to_numpy() == core).all()
    pairs = set(zip(lab[core], got["cluster"].to_numpy()[core]))
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})  # same partition of core points
    for i in np.flatnonzero(~core):
        near = {int(got["cluster"][j]) for j in np.flatnonzero(close[i] & core)}
        assert (int(got["cluster"][i]) in near) if near else got["cluster"][i] == -1


def test_components_of_a_long_chain(spark, monkeypatch):
    """Tables shrink from round to round: all that is written stays within a few times the edges."""
    n, written, cut = 3000, [], nb.cut_lineage
    monkeypatch.setattr(nb, "cut_lineage", lambda t: written.append(cut(t)) or written[-1])
    nodes = spark.range(n + 2).select(F.format_string("%05d", "id").alias("node"))
    near = spark.range(n - 1).filter("id <> 1999").select(F.format_string("%05d", "id").alias("a"), F.format_string("%05d", F.col("id") + 1).alias("b"))
    got = {r["node"]: r["label"] for r in nb.components(near, nodes).collect()}
    assert got == {f"{i:05d}": f"{0 if i < 2000 else 2000 if i < n else i:05d}" for i in range(n + 2)}
    assert sum(t.count() for t in written) < 12 * n


def test_isolation_and_envelope_find_far_points(spark):
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(0, 1, (400, 2)), [[9, 9], [-10, 8], [9, -9]]])
    d = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id long, x double, y double").cache()
    top = [r["id"] for r in ol.isolation_forest(d, "id", ["x", "y"], contamination=0.01).orderBy(F.desc("score")).limit(3).collect()]
    assert set(top) == {400, 401, 402}
    far = {r["id"] for r in ol.elliptic_envelope(d, ["x", "y"], 0.01).filter("outlier").collect()}
    assert {400, 401, 402} <= far


def test_isolation_forest_repeats(spark, cloud):
    a, b = (ol.isolation_forest(cloud[1].repartition(n), "id", ["x", "y"], trees=20).orderBy("id").toPandas()["score"] for n in (1, 7))
    assert np.allclose(a, b)


def test_mixture_counts_components(spark):
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(0, 1, (200, 2)), rng.normal(9, 1, (200, 2))])
    d = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id long, x double, y double")
    got, k, _ = cl.mixture(d, ["x", "y"], 4)
    assert k == 2 and got.filter("id < 200").select("cluster").distinct().count() == 1
    one, k1, _ = cl.mixture(d.filter("id < 200"), ["x", "y"], 4)
    assert k1 == 1 and one.count() == 200


def test_grubbs_and_dixon(spark):
    v = [10.0, 10.1, 9.9, 10.2, 9.8, 10.0, 14.0]
    d = spark.createDataFrame([("a", i, x) for i, x in enumerate(v)], "grp string, id long, v double")
    g = ol.grubbs_decision(ol.grubbs(d, "id", "v", ["grp"])).first()
    assert g["id"] == 6 and g["outlier"] and g["critical"] == pytest.approx(2.020, abs=0.002)  # table value for n = 7
    q = ol.dixon(d, "id", "v", ["grp"]).first()
    assert q["q"] == pytest.approx(3.8 / 4.2) and q["critical"] == 0.568 and q["outlier"]


def test_assignment_is_greedy_mutual(spark):
    a = spark.createDataFrame([("f", 1, 0.0, 0.0), ("f", 2, 1.0, 0.0), ("f", 3, 50.0, 0.0)], "g string, id int, x double, y double")
    b = spark.createDataFrame([("f", 7, 0.9, 0.0), ("f", 8, 2.5, 0.0), ("f", 9, 90.0, 0.0)], "g string, id int, x double, y double")
    got = {(r["id_a"], r["id_b"]) for r in tr.assign_nearest(a, b, ["g"], 4.0).collect()}
    assert got == {(2, 7), (1, 8)}


def test_moments_of_the_nearer_half(spark):
    import numpy as np

    from rekurve.operators import outliers as ol

    rng = np.random.default_rng(8)
    for n in (1000, 1001):
        x = np.r_[rng.normal(size=(n - 300, 2)), np.tile(rng.normal(size=(3, 2)), (100, 1))]
        d = ol.mahalanobis(spark.createDataFrame(x.tolist(), "a double, b double"), ["a", "b"], np.array([0.2, -0.1]), np.array([[1.0, 0.3], [0.3, 2.0]]))
        mean, cov = ol._near_half(d, ["a", "b"], np.array([0.2, -0.1]))
        md2 = np.array([r["md2"] for r in d.collect()])
        own = np.array([(r["a"], r["b"]) for r in d.collect()])[md2 <= np.median(md2)]
        assert np.allclose(mean, own.mean(0)) and np.allclose(cov, np.cov(own.T))
