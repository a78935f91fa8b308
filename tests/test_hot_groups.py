"""Segmented plans for hot groups give the same rows as the plain ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rekurve.operators import bleach as bl, normalize as nz, ordered as od, resample as rs, shape as sh, stats as st, tracks as tr
from rekurve.operators.ordered import SEGMENT_CONF

K = ["curve_id"]


@pytest.fixture(scope="module")
def data(spark):
    # one curve holds a third of the rows; values repeat
    big = spark.range(100).select(F.lit(1).alias("curve_id"), "id")
    small = spark.range(200).select((F.col("id") % 40 + 2).cast("int").alias("curve_id"), "id")
    h = F.conv(F.substring(F.md5(F.concat_ws(":", "curve_id", "id")), 1, 6), 16, 10).cast("long")
    d = big.unionByName(small).withColumn("t", F.col("id") * 0.5).withColumn("y", (h % 23).cast("double"))
    return d.withColumn("gap", F.when(h % 3 == 0, F.col("y"))).cache()


def both(spark, fn, key):
    """Rows of fn with plain and with segmented plans, sorted by key."""
    norm = lambda df: sorted(map(repr, [tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*sorted(df.columns)).collect()]))
    spark.conf.unset(SEGMENT_CONF)
    plain = norm(fn())
    spark.conf.set(SEGMENT_CONF, "7")
    try:
        hot = norm(fn())
    finally:
        spark.conf.unset(SEGMENT_CONF)
    assert plain and plain == hot


def framed(data):
    return od.frame_index(data, K, ["t", "id"])


def test_frame_index(spark, data):
    both(spark, lambda: framed(data), "id")


def test_frame_index_with_copies(spark, data):
    both(spark, lambda: od.frame_index(data.select("y", "curve_id", "id"), [], ["y", "curve_id", "id"]), "id")


@pytest.mark.parametrize("name", ["windowed", "running", "fill", "post", "shape", "slope", "anchored", "baseline", "downsample", "quality"])
def test_ordered_operators(spark, data, name):
    fns = {
        "windowed": lambda d: od.windowed(d, K, lambda w: {"a": F.avg("y").over(w.rowsBetween(-5, -1)), "b": F.lead("y", 2).over(w)}, 5, 2),
        "running": lambda d: od.running_sum(d, K, F.col("y"), "s"),
        "fill": lambda d: od.fill_forward(d, K, "gap", "filled"),
        "post": bl.post_bleach,
        "shape": sh.shape_features,
        "slope": sh.terminal_slope,
        "anchored": nz.bleach_anchored,
        "baseline": lambda d: nz.rolling_baseline(d, window=6),
        "downsample": lambda d: sh.downsample(d, 20),
        "quality": sh.quality_features,
    }
    both(spark, lambda: fns[name](framed(data)), "id")


def test_ranks_and_quantiles(spark, data):
    both(spark, lambda: od.value_ranks(data, ["curve_id"], "y"), "y")
    both(spark, lambda: od.value_ranks(data, [], "y", ["curve_id"]), "y")
    both(spark, lambda: od.quantiles(data, ["curve_id"], "y", [0.0, 0.1, 0.5, 0.9, 1.0]).select("curve_id", *[F.col("q")[i].alias(f"q{i}") for i in range(5)]), "q0")
    both(spark, lambda: st.kruskal(data, "curve_id", "y"), "h")


def test_quantiles_match_numpy(spark, data, small_segments):
    v = np.array([r["y"] for r in data.filter("curve_id = 1").collect()])
    got = od.quantiles(data, ["curve_id"], "y", [0.1, 0.25, 0.77]).filter("curve_id = 1").first()["q"]
    assert got == pytest.approx(list(np.quantile(v, [0.1, 0.25, 0.77])))


def test_bootstrap_and_permutation(spark, data):
    two = data.withColumn("g", F.when(F.col("curve_id") < 20, "a").otherwise("b")).withColumn("rid", F.concat_ws("-", "curve_id", "id"))
    both(spark, lambda: rs.bootstrap(two, ["g"], "y", ["rid"], 5), "rep")
    both(spark, lambda: rs.permutation_test(two, "g", "y", "rid", "a", "b", 5), "rep")


def kalman_plain(z, q=(0.01, 0.1), r=1.0):
    a, h = np.array([[1, 1.0], [0, 1.0]]), np.array([[1.0, 0]])
    s, p, out = np.array([z[0], np.zeros(2)]), np.eye(2), []
    for m in z:
        s, p = a @ s, a @ p @ a.T + np.diag(q)
        k = p @ h.T / (h @ p @ h.T + r)
        s, p = s + k @ (m - s[0])[None, :], (np.eye(2) - k @ h) @ p
        out.append(s[0].copy())
    return np.array(out)


def test_kalman_in_segments(spark, data):
    d = framed(data).select(F.col("curve_id").alias("track_id"), "frame", F.col("y").alias("x"), (F.col("y") * 2 + F.col("t")).alias("y"))
    both(spark, lambda: tr.kalman(d).select("track_id", "frame", F.round("xs", 6).alias("xs"), F.round("ys", 6).alias("ys"), "flag"), "xs")
    got = tr.kalman(d).filter("track_id = 1").orderBy("frame").toPandas()
    want = kalman_plain(got[["x", "y"]].to_numpy())
    assert np.allclose(got[["xs", "ys"]].to_numpy(), want, atol=1e-6)


def test_viterbi_in_segments(spark, data, small_segments):
    trans, loc, scale, init = np.array([[0.8, 0.2], [0.3, 0.7]]), np.array([[6.0], [16.0]]), np.full((2, 1), 4.0), np.array([0.5, 0.5])
    d = framed(data).select(F.col("curve_id").alias("track_id"), "frame", "y")
    got = tr.viterbi(d, ["y"], trans, loc, scale, init).filter("track_id = 1").orderBy("frame").toPandas()["state"].to_numpy()
    obs = d.filter("track_id = 1").orderBy("frame").toPandas()["y"].to_numpy()
    e = -0.5 * ((obs[:, None] - loc[:, 0]) / 4.0) ** 2
    dp, ptr = np.log(init) + e[0], []
    for row in e[1:]:
        s = dp[:, None] + np.log(trans)
        ptr.append(s.argmax(0))
        dp = s.max(0) + row
    path = [int(dp.argmax())]
    for p in ptr[::-1]:
        path.append(int(p[path[-1]]))
    assert list(got) == path[::-1]


def test_one_shuffle_when_bounded(spark, data):
    d = bl.post_bleach(framed(data.select("curve_id", "id", "t", "y")))
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "BatchEvalPython" not in plan


def test_quantiles_of_a_whole_table_by_counts(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(od, "SELECT_ROWS", 100)
    monkeypatch.setattr(od, "SELECT_BINS", 16)
    rng = np.random.default_rng(4)
    probs = [0.0, 0.1, 0.5, 0.75, 0.999, 1.0]
    for x in (rng.normal(size=3001), rng.pareto(0.3, 2000), np.repeat([-1.0, 0.0, 5.0], 200), np.full(300, 2.0)):
        d = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),)], "v double")
        q = od.quantiles(d, [], "v", probs)
        assert not any(w in q._jdf.queryExecution().toString() for w in ("percentile", "Window"))
        assert np.allclose(q.first()["q"], np.quantile(x, probs), rtol=1e-12)
