"""Subpopulations of feature tables."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from rekurve.operators import neighbors as nb
from rekurve.operators.mixtures import group_mixtures
from rekurve.operators.ordered import quantiles
from rekurve.operators.outliers import elliptic_envelope, isolation_forest, prepare
from rekurve.plans.session import cut_lineage

# BIC gain a further component must bring, per sensitivity.
GAIN = {"low": 25.0, "medium": 10.0, "high": 2.0}


def vectors(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    v = VectorAssembler(inputCols=list(cols), outputCol="_raw").transform(df.dropna(subset=list(cols)))
    return StandardScaler(inputCol="_raw", outputCol="features", withMean=True, withStd=True).fit(v).transform(v).drop("_raw")


def mixture(df: DataFrame, cols: Sequence[str], max_k: int = 6, sensitivity: str | None = "medium", seed: int = 42, min_size: int = 3, starts: int = 2, fallback: str | None = None):
    """Gaussian mixture with the number of components by BIC: (rows with cluster and probability, k, list of BICs).

    With a sensitivity the search stops at the first component that gains too little; without one the smallest BIC wins.  Where one
    component is left, ``fallback`` (a key column) looks for density clusters on the standardized columns instead: noise is -1 with
    probability 0, everything else has probability 1.
    """
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.functions import vector_to_array

    v = cut_lineage(vectors(df, cols))
    d = len(cols)
    x = [vector_to_array("features")[i] for i in range(d)]
    r = v.agg(F.count(F.lit(1)), *[F.covar_pop(a, b) for a in x for b in x]).first()  # 1 + d * d numbers
    n, cov = r[0], np.array(r[1:], float).reshape(d, d)
    # one component is the plain normal distribution
    one = -n / 2 * (d * math.log(2 * math.pi) + np.linalg.slogdet(cov)[1] + d)
    bics = [-2 * one + (d + d * (d + 1) / 2) * math.log(n)]
    best = (None, bics[0], 1)
    for k in range(2, max_k + 1):
        if n < k * min_size:
            break
        need = GAIN[sensitivity] if sensitivity else 0.0
        params = k * (d + d * (d + 1) / 2) + k - 1
        top = None
        for start in range(starts):  # more starts only while k components do not yet convince
            m = GaussianMixture(k=k, seed=seed + start, tol=1e-3, featuresCol="features", predictionCol="cluster", probabilityCol="_p").fit(v)
            bic = -2 * m.summary.logLikelihood + params * math.log(n)
            small = min(m.summary.clusterSizes) < min_size
            if top is None or (small, bic) < (top[2], top[1]):
                top = (m, bic, small)
            if not top[2] and best[1] - top[1] > need:
                break
        bics.append(top[1])
        if not top[2] and best[1] - top[1] > need:
            best = (top[0], top[1], k)
        elif sensitivity:
            break
    if best[0] is None and fallback:
        z = [f"_z{i}" for i in range(d)]
        p = cut_lineage(v.select(fallback, *[c.alias(n) for c, n in zip(x, z)]))
        eps = nb.eps_from_neighbors(p, fallback, z)
        if eps:
            found = cut_lineage(nb.dbscan(p, fallback, z, eps).select(fallback, F.col("cluster").cast("int").alias("cluster")))
            k = found.filter("cluster >= 0").select("cluster").distinct().count()
            return v.drop("features").join(found, fallback).withColumn("cluster_prob", F.when(F.col("cluster") < 0, 0.0).otherwise(1.0)), k, bics
    if best[0] is None:
        return v.withColumn("cluster", F.lit(0)).withColumn("cluster_prob", F.lit(1.0)).drop("features"), 1, bics
    out = best[0].transform(v).withColumn("cluster_prob", F.array_max(vector_to_array("_p"))).drop("_p", "features")
    return out, best[2], bics


def kmeans(df: DataFrame, cols: Sequence[str], k: int, seed: int = 42):
    """K-means on standardized columns and its silhouette."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator

    v = cut_lineage(vectors(df, cols))
    out = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(v).transform(v)
    return out.drop("features"), ClusteringEvaluator(featuresCol="features", predictionCol="cluster").evaluate(out)


def separation(df: DataFrame, cols: Sequence[str], cluster: str) -> DataFrame:
    """Calinski-Harabasz and Davies-Bouldin from centroids and scatter; one row."""
    cols = list(cols)
    df = df.select(cluster, *cols)
    c = df.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"), *[F.avg(x).alias(f"c_{x}") for x in cols])
    d2 = sum((F.pow(F.col(x) - F.col(f"c_{x}"), 2) for x in cols), F.lit(0.0))
    s = cut_lineage(df.join(c, cluster).groupBy(cluster).agg(F.first("n").alias("n"), F.sum(d2).alias("ss"), F.avg(F.sqrt(d2)).alias("scatter"), *[F.first(f"c_{x}").alias(f"c_{x}") for x in cols]))
    tot = s.agg(F.sum("n").alias("total_n"), F.count(F.lit(1)).alias("k"), F.sum("ss").alias("within"), *[(F.sum(F.col("n") * F.col(f"c_{x}")) / F.sum("n")).alias(f"g_{x}") for x in cols])
    between = s.crossJoin(F.broadcast(tot)).agg(F.sum(F.col("n") * sum((F.pow(F.col(f"c_{x}") - F.col(f"g_{x}"), 2) for x in cols), F.lit(0.0))).alias("between"))  # one row
    a = s.select(F.col(cluster).alias("a"), F.col("scatter").alias("sa"), *[F.col(f"c_{x}").alias(f"a_{x}") for x in cols])
    b = s.select(F.col(cluster).alias("b"), F.col("scatter").alias("sb"), *[F.col(f"c_{x}").alias(f"b_{x}") for x in cols])
    gap = F.sqrt(sum((F.pow(F.col(f"a_{x}") - F.col(f"b_{x}"), 2) for x in cols), F.lit(0.0)))
    db = a.join(b, F.col("a") != F.col("b")).groupBy("a").agg(F.max(F.try_divide(F.col("sa") + F.col("sb"), gap)).alias("r")).agg(F.avg("r").alias("davies_bouldin"))  # clusters by clusters
    j = tot.crossJoin(between).crossJoin(db)  # one row each
    ch = F.try_divide(F.col("between") / (F.col("k") - 1), F.col("within") / (F.col("total_n") - F.col("k")))
    return j.select("k", ch.alias("calinski_harabasz"), "davies_bouldin")


def silhouette(df: DataFrame, cols: Sequence[str], cluster: str) -> DataFrame:
    """Mean silhouette of any labelling by squared distances; one row.  Noise (-1) and missing labels do not count.

    The mean squared distance of a row to a cluster follows from the cluster's size, centre and mean square, so rows meet one row with
    these numbers of every cluster and never each other.  A row alone in its cluster counts as 0.  NULL for fewer than two clusters.
    """
    cols = list(cols)
    d = df.select(F.col(cluster).alias("_c"), *[F.col(c).cast("double").alias(c) for c in cols]).dropna().filter("_c <> -1")
    square = lambda at: sum((F.col(c) * F.col(c) for c in at), F.lit(0.0))
    mid = d.agg(*[F.avg(c).alias(f"m_{c}") for c in cols])  # around the common centre nothing cancels
    d = d.crossJoin(F.broadcast(mid)).select("_c", *[(F.col(c) - F.col(f"m_{c}")).alias(c) for c in cols])  # one row
    one = d.groupBy("_c").agg(F.count(F.lit(1)).alias("n"), F.avg(square(cols)).alias("sq"), F.array(*[F.avg(c) for c in cols]).alias("centre"))
    all_of_them = one.agg(F.collect_list(F.struct("_c", "n", "sq", "centre")).alias("of"))
    to = lambda s: square(cols) + s["sq"] - 2 * sum((F.col(c) * s["centre"][i] for i, c in enumerate(cols)), F.lit(0.0))
    d = d.crossJoin(F.broadcast(all_of_them))  # one row, as long as there are clusters
    own = F.filter("of", lambda s: s["_c"] == F.col("_c"))[0]
    d = d.select((own["n"] > 1).alias("_some"), F.greatest(F.lit(0.0), F.try_divide(to(own) * own["n"], own["n"] - 1)).alias("_own"), F.array_min(F.transform(F.filter("of", lambda s: s["_c"] != F.col("_c")), to)).alias("_other"))
    return d.agg(F.avg(F.when(F.col("_other").isNotNull(), F.when(F.col("_some"), F.coalesce(F.try_divide(F.col("_other") - F.col("_own"), F.greatest("_own", "_other")), F.lit(0.0))).otherwise(0.0))).alias("silhouette"))


def subpopulations(df: DataFrame, key: str, cols: Sequence[str], contamination: float = 0.1) -> DataFrame:
    """Rows flagged by either method stay unclustered, the others get a mixture component."""
    scaled = [f"{c}_scaled" for c in cols]
    d = cut_lineage(prepare(df, cols))
    iso = isolation_forest(d, key, scaled, contamination=contamination).select(key, F.col("outlier").alias("o1"))
    ell = elliptic_envelope(d, scaled, contamination).select(key, F.col("outlier").alias("o2"))
    f = cut_lineage(d.join(iso, key).join(ell, key).withColumn("outlier", F.col("o1") | F.col("o2")).drop("o1", "o2"))
    got, _, _ = mixture(f.filter("not outlier"), scaled)
    return f.join(got.select(key, "cluster", "cluster_prob"), key, "left").withColumn("cluster", F.coalesce("cluster", F.lit(-1)))


def kinetic_subpopulations(df: DataFrame, key: str, group: str, diff: str, residence: str, max_k: int = 3) -> DataFrame:
    """Per group a mixture on log10 of diffusion and residence, clusters numbered by falling median diffusion.

    All groups are fitted at once.  A row whose diffusion or residence is missing or not above zero keeps its place without a label.
    """
    log = lambda c: F.when(F.col(c) > 0, F.log10(c))
    d = df.select(key, group, log(diff).alias("log_d"), log(residence).alias("log_r"))
    out = cut_lineage(group_mixtures(d, [group], ["log_d", "log_r"], max_k, starts=2))
    med = quantiles(out.filter("cluster is not null"), [group, "cluster"], "log_d", [0.5]).select(group, "cluster", F.col("q")[0].alias("m"))
    rank = med.withColumn("label", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("m"), "cluster")) - 1).select(F.col(group).alias("_g"), F.col("cluster").alias("_c"), "label")
    found = out.join(rank, F.col(group).eqNullSafe(F.col("_g")) & (F.col("cluster") == F.col("_c")), "left")
    return found.select(key, group, "label", "cluster_prob")
