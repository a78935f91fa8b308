"""Exact nearest neighbours, local outlier factor and density clusters.

Copies of a point collapse to one weighted point first, so no group of copies is ever paired with itself.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from rekurve.operators.ordered import frame_index
from rekurve.plans.session import cut_lineage

MAX_CELLS = 200_000  # bounds the index every task receives to a few megabytes


def distinct_points(df: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """Distinct coordinates with their number of copies and the smallest key."""
    return df.dropna(subset=list(cols)).groupBy(*[F.col(c).cast("double").alias(c) for c in cols]).agg(F.min(key).alias(key), F.count(F.lit(1)).cast("long").alias("w"))


def _topk(ids, x, w, qid, q, qw, k):
    """Per query the nearest points until their copies reach k; the query itself counts its other copies."""
    out = []
    for lo in range(0, len(q), 256):
        d = np.sqrt(((q[lo : lo + 256, None, :] - x[None]) ** 2).sum(2))
        for i, row in enumerate(d):
            me = ids == qid[lo + i]
            weight = np.where(me, w - 1, w)
            cand = np.flatnonzero(weight > 0)
            if len(cand) > k:
                kth = np.partition(row[cand], k - 1)[k - 1]
                cand = cand[row[cand] <= kth]
            cand = cand[np.lexsort((ids[cand], row[cand]))][: k]
            out.append((cand, row[cand], weight[cand]))
    return out


def knn(df: DataFrame, key: str, cols: Sequence[str], k: int, cell_rows: int = 512) -> DataFrame:
    """``key, nb, dist, m`` for distinct points: neighbours by distance (then key) whose multiplicities ``m`` sum to k.

    Points are cut into equally filled cells (strips by the first column, cells by the second).  A cell gives every point
    an upper bound of its k-th distance, and only cells the ball of that radius touches are searched after that.
    """
    cols = list(cols)
    pts = cut_lineage(distinct_points(df, key, cols))
    n = pts.count()
    per = max(cell_rows, math.ceil(n / MAX_CELLS))
    strips = max(1, math.isqrt(math.ceil(n / per)))
    second = cols[1] if len(cols) > 1 else cols[0]
    p = frame_index(pts, [], [cols[0], key], "_p").withColumn("strip", F.floor(F.col("_p") / math.ceil(n / strips)).cast("int"))
    p = frame_index(p, ["strip"], [second, key], "_p2").withColumn("cell", F.floor(F.col("_p2") / per).cast("int")).drop("_p", "_p2")
    p = cut_lineage(p)
    boxes = p.groupBy("strip", "cell").agg(F.min(cols[0]).alias("x0"), F.max(cols[0]).alias("x1"), F.min(second).alias("y0"), F.max(second).alias("y1")).toPandas()  # <= MAX_CELLS rows
    boxes = boxes.sort_values(["strip", "cell"])
    b = {c: boxes[c].to_numpy() for c in boxes.columns}
    types = {f.name: f.dataType.simpleString() for f in p.schema.fields}
    coord = ", ".join(f"`{c}` double" for c in cols)

    def own(pdf: pd.DataFrame) -> pd.DataFrame:
        x, ids, w = pdf[cols].to_numpy(float), pdf[key].to_numpy(), pdf["w"].to_numpy()
        r = []
        for cand, d, m in _topk(ids, x, w, ids, x, w, k):
            r.append(d[np.searchsorted(np.cumsum(m), k)] if m.sum() >= k else np.inf)
        return pdf[[key, "w", *cols]].assign(r=r)

    bound = p.groupBy("strip", "cell").applyInPandas(own, f"`{key}` {types[key]}, w long, {coord}, r double")

    def route(batches):
        for t in batches:
            x, y, r = t[cols[0]].to_numpy(), t[second].to_numpy(), t["r"].to_numpy() * (1 + 1e-12)
            hit = [np.flatnonzero((b["x1"] >= a - s) & (b["x0"] <= a + s) & (b["y1"] >= c - s) & (b["y0"] <= c + s)) for a, c, s in zip(x, y, r)]
            rep = np.repeat(np.arange(len(t)), [len(h) for h in hit])
            cells = np.concatenate(hit) if len(hit) else np.array([], int)
            yield t.iloc[rep][[key, "w", *cols]].assign(strip=b["strip"][cells], cell=b["cell"][cells])

    queries = bound.mapInPandas(route, f"`{key}` {types[key]}, w long, {coord}, strip int, cell int")

    def search(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(c):
            return pd.DataFrame({key: [], "nb": [], "dist": [], "w": []}).astype({"w": "int64"})
        ids = c[key].to_numpy()
        got = _topk(ids, c[cols].to_numpy(float), c["w"].to_numpy(), q[key].to_numpy(), q[cols].to_numpy(float), q["w"].to_numpy(), k)
        rep = np.repeat(np.arange(len(q)), [len(g[0]) for g in got])
        return pd.DataFrame({key: q[key].to_numpy()[rep], "nb": np.concatenate([ids[g[0]] for g in got]), "dist": np.concatenate([g[1] for g in got]), "w": np.concatenate([g[2] for g in got])})

    found = queries.groupBy("strip", "cell").cogroup(p.groupBy("strip", "cell")).applyInPandas(search, f"`{key}` {types[key]}, nb {types[key]}, dist double, w long")
    # at most k candidates per visited cell
    g = found.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("dist", "nb", "w"))).alias("c"))
    take = F.expr(
        f"aggregate(c, named_struct('left', {k}L, 'out', cast(array() as array<struct<dist:double,nb:{types[key]},m:bigint>>)), (s, e) -> named_struct('left', greatest(0L, s.left - e.w), "
        f"'out', if(s.left > 0, array_append(s.out, named_struct('dist', e.dist, 'nb', e.nb, 'm', least(s.left, e.w))), s.out)), s -> s.out)"
    )
    return g.select(key, F.posexplode(take).alias("pos", "s")).select(key, "pos", "s.nb", "s.dist", "s.m")


def local_outlier_factor(df: DataFrame, key: str, cols: Sequence[str], k: int = 20) -> DataFrame:
    """One factor per distinct point (copies share it)."""
    nn = cut_lineage(knn(df, key, cols, k))
    kd = nn.groupBy(key).agg(F.max("dist").alias("kd"))
    reach = nn.join(kd.select(F.col(key).alias("nb"), "kd"), "nb").withColumn("reach", F.greatest("dist", "kd"))
    lrd = cut_lineage(reach.groupBy(key).agg((1 / (F.sum(F.col("reach") * F.col("m")) / F.sum("m") + 1e-10)).alias("lrd")))
    j = nn.join(lrd.select(F.col(key).alias("nb"), F.col("lrd").alias("nl")), "nb")
    g = j.groupBy(key).agg((F.sum(F.col("nl") * F.col("m")) / F.sum("m")).alias("nl"))
    return g.join(lrd, key).select(key, (F.col("nl") / F.col("lrd")).alias("lof"))


def eps_from_neighbors(df: DataFrame, key: str, cols: Sequence[str], k: int = 5, share: float = 0.75) -> float:
    from rekurve.operators.ordered import quantiles

    kd = cut_lineage(knn(df, key, cols, k).groupBy(key).agg(F.max("dist").alias("kd")))  # counted several times
    return float(quantiles(kd, [], "kd", [share]).first()["q"][0])


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, label``: smallest node of each connected component.

    In each round a node goes to the first of itself and its neighbours, in an order that a hash draws anew, and on to where that one
    goes, four steps in all; edges are rewritten between the places reached.  What was linked stays linked, and the tables shrink from
    round to round by a factor.  Joins are merged, so that no table passes through the driver.
    """
    e = cut_lineage(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct())
    moves = []
    while not e.isEmpty():
        drawn = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(len(moves))).alias("h"), F.col(c).alias("id"))
        to = cut_lineage(e.groupBy("a").agg(F.min(drawn("b")).alias("first")).select(F.col("a").alias("node"), F.least(drawn("a"), "first")["id"].alias("to")))
        for _ in range(2):
            to = cut_lineage(to.join(to.select(F.col("node").alias("to"), F.col("to").alias("on")).hint("merge"), "to").select("node", F.col("on").alias("to")))
        moves.append(to)
        for c in ("a", "b"):
            e = e.join(to.select(F.col("node").alias(c), F.col("to").alias(f"{c}_to")).hint("merge"), c)
        e = cut_lineage(e.select(F.col("a_to").alias("a"), F.col("b_to").alias("b")).filter("a <> b").distinct())
    if not moves:
        return nodes.select("node", F.col("node").alias("label"))
    end = moves.pop()
    while moves:  # where a place of one round ends up in the later ones
        end = moves.pop().join(end.select(F.col("node").alias("to"), F.col("to").alias("on")).hint("merge"), "to", "left").select("node", F.coalesce("on", "to").alias("to"))
        end = cut_lineage(end)
    least = end.groupBy("to").agg(F.min("node").alias("label")).hint("merge")
    return cut_lineage(nodes.select("node").join(end.join(least, "to").select("node", "label").hint("merge"), "node", "left").select("node", F.coalesce("label", "node").alias("label")))


def dbscan(df: DataFrame, key: str, cols: Sequence[str], eps: float, min_samples: int = 5, split: int = 4) -> DataFrame:
    """``key, core, cluster`` for every row; -1 is noise, a border point joins its smallest neighbouring cluster.

    Cells are so small that all their points are neighbours: a cell with enough copies is core without any comparison,
    cells are linked through bounding boxes of their parts, and single points meet only where boxes leave it open.
    """
    cols = list(cols)
    d = len(cols)
    side = eps / math.sqrt(d)
    pts = cut_lineage(distinct_points(df, key, cols).select(key, "w", *cols, *[F.floor(F.col(c) / side).cast("long").alias(f"_c{i}") for i, c in enumerate(cols)]))
    cell = [f"_c{i}" for i in range(d)]
    reach = math.ceil(math.sqrt(d))
    size = pts.groupBy(*cell).agg(F.sum("w").alias("cw"))
    p = pts.join(size, cell)

    def spread(t: DataFrame, prefix: str = "_c") -> DataFrame:
        for i in range(d):
            t = t.withColumn(f"{prefix}{i}", F.explode(F.sequence(F.col(f"_h{i}") - reach, F.col(f"_h{i}") + reach)))
        return t

    dist2 = lambda a, b: sum(((F.col(f"{a}{i}") - F.col(f"{b}{i}")) ** 2 for i in range(d)), F.lit(0.0))
    sparse = p.filter(F.col("cw") < min_samples).select(F.col(key).alias("q"), *[F.col(c).alias(f"_q{i}") for i, c in enumerate(cols)], *[F.col(c).alias(f"_h{i}") for i, c in enumerate(cell)])
    other = pts.select(*cell, "w", *[F.col(c).alias(f"_x{i}") for i, c in enumerate(cols)])
    near = spread(sparse).join(other, cell).filter(dist2("_q", "_x") <= eps * eps)
    core_sparse = near.groupBy("q").agg(F.sum("w").alias("nw")).filter(F.col("nw") >= min_samples).select(F.col("q").alias(key))
    core = p.filter(F.col("cw") >= min_samples).select(key).unionByName(core_sparse).withColumn("core", F.lit(True))
    cp = cut_lineage(p.join(core, key, "left").withColumn("core", F.coalesce("core", F.lit(False))).withColumn("node", F.concat_ws(":", *cell)))
    corep = cp.filter("core")
    nodes = corep.select("node").distinct()
    # parts of cells with their bounding boxes
    part = F.concat_ws(":", *[F.floor((F.col(c) / side - F.col(k_)) * split) for c, k_ in zip(cols, cell)])
    boxes = corep.withColumn("part", part).groupBy("node", "part", *cell).agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(cols) for f, n in ((F.min, "lo"), (F.max, "hi"))])
    left = spread(boxes.select(F.col("node").alias("a"), F.col("part").alias("pa"), *[F.col(c).alias(f"_h{i}") for i, c in enumerate(cell)], *[F.col(f"{n}{i}").alias(f"a{n}{i}") for i in range(d) for n in ("lo", "hi")]))
    pr = left.join(boxes.select(*cell, F.col("node").alias("b"), F.col("part").alias("pb"), *[f"{n}{i}" for i in range(d) for n in ("lo", "hi")]), cell).filter("a < b")
    gap = sum((F.pow(F.greatest(F.lit(0.0), F.col(f"lo{i}") - F.col(f"ahi{i}"), F.col(f"alo{i}") - F.col(f"hi{i}")), 2) for i in range(d)), F.lit(0.0))
    wide = sum((F.pow(F.greatest(F.col(f"hi{i}") - F.col(f"alo{i}"), F.col(f"ahi{i}") - F.col(f"lo{i}")), 2) for i in range(d)), F.lit(0.0))
    pr = cut_lineage(pr.select("a", "pa", "b", "pb", (wide <= eps * eps).alias("sure"), (gap <= eps * eps).alias("maybe")).filter("maybe"))
    sure = pr.filter("sure").select("a", "b").distinct()
    open_ = pr.filter("not sure").join(sure, ["a", "b"], "left_anti")
    cpts = corep.withColumn("part", part)
    pa = cpts.select(F.col("node").alias("a"), F.col("part").alias("pa"), *[F.col(c).alias(f"_q{i}") for i, c in enumerate(cols)])
    pb = cpts.select(F.col("node").alias("b"), F.col("part").alias("pb"), *[F.col(c).alias(f"_x{i}") for i, c in enumerate(cols)])
    met = open_.join(pa, ["a", "pa"]).join(pb, ["b", "pb"]).filter(dist2("_q", "_x") <= eps * eps).select("a", "b").distinct()
    lab = components(sure.unionByName(met), nodes)
    labelled = corep.join(lab, "node").select(key, "label")
    border = cp.filter("not core").select(F.col(key).alias("q"), *[F.col(c).alias(f"_q{i}") for i, c in enumerate(cols)], *[F.col(c).alias(f"_h{i}") for i, c in enumerate(cell)])
    cl = corep.join(lab, "node").select(*cell, "label", *[F.col(c).alias(f"_x{i}") for i, c in enumerate(cols)])
    edge = spread(border).join(cl, cell).filter(dist2("_q", "_x") <= eps * eps).groupBy(F.col("q").alias(key)).agg(F.min("label").alias("label"))
    ids = frame_index(lab.select("label").distinct(), [], ["label"], "cluster")
    res = cp.select(key, *cols, "core").join(labelled.unionByName(edge), key, "left").join(ids, "label", "left").select(*cols, "core", F.coalesce("cluster", F.lit(-1)).alias("cluster"))
    casted = df.dropna(subset=cols).select(key, *[F.col(c).cast("double").alias(c) for c in cols])
    return casted.join(res, cols).select(key, "core", "cluster")
