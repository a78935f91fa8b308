"""Outlier flags on feature tables."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from rekurve.functions import tails
from rekurve.operators.ordered import attach, frame_index, quantiles
from rekurve.operators.resample import draw
from rekurve.plans.session import cut_lineage


def _medians(df: DataFrame, by: Sequence[str], col: str, probs=(0.5,)) -> DataFrame:
    return quantiles(df, list(by), col, list(probs))


def _join(df: DataFrame, stats: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.join(stats, list(by), "left") if by else df.crossJoin(F.broadcast(stats))  # one row without groups


def iqr_flags(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), factor: float = 1.5) -> DataFrame:
    """O1: outside the quartile fences of any column; columns without spread never flag."""
    out, flag = df, F.lit(False)
    for c in cols:
        q = _medians(df, by, c, (0.25, 0.75)).withColumnRenamed("q", f"_q_{c}")
        out = _join(out, q, by)
        lo, hi = F.col(f"_q_{c}")[0], F.col(f"_q_{c}")[1]
        one = F.coalesce((hi > lo) & ((F.col(c) < lo - factor * (hi - lo)) | (F.col(c) > hi + factor * (hi - lo))), F.lit(False))
        flag = flag | one
        out = out.withColumn(f"{c}_outlier", one)
    return out.withColumn("outlier", flag).drop(*[f"_q_{c}" for c in cols])


def zscore_flags(df: DataFrame, col: str, by: Sequence[str] = (), limit: float = 3.0) -> DataFrame:
    """O2."""
    d = attach(df, list(by), _m=F.avg(col), _s=F.stddev_pop(col))
    z = F.when(F.col("_s") > 0, (F.col(col) - F.col("_m")) / F.col("_s"))
    return d.withColumn("z", z).withColumn("outlier", F.coalesce(F.abs("z") > limit, F.lit(False))).drop("_m", "_s")


def _mad(df: DataFrame, col: str, by: Sequence[str]) -> DataFrame:
    d = _join(df, _medians(df, by, col).withColumn("_med", F.col("q")[0]).drop("q"), by).withColumn("_dev", F.abs(F.col(col) - F.col("_med")))
    return _join(d, _medians(d, by, "_dev").withColumn("_mad", F.col("q")[0]).drop("q"), by)


def robust_z_flags(df: DataFrame, col: str, by: Sequence[str] = (), limit: float = 3.0) -> DataFrame:
    """O2, robust: (x - median) / (1.4826 MAD)."""
    d = _mad(df, col, by)
    z = F.when(F.col("_mad") > 0, (F.col(col) - F.col("_med")) / (1.4826 * F.col("_mad")))
    return d.withColumn("z", z).withColumn("outlier", F.coalesce(F.abs("z") > limit, F.lit(False))).drop("_med", "_dev", "_mad")


def mad_flags(df: DataFrame, col: str, by: Sequence[str] = (), limit: float = 3.5, scale: str = "usual") -> DataFrame:
    """O3: modified z 0.6745 (x - median) / MAD; a zero MAD is replaced by sd / 1.4826.

    ``scale='reference'`` multiplies by 1.4826 instead.
    """
    d = attach(_mad(df, col, by), list(by), _sd=F.stddev_pop(col))
    mad = F.when(F.col("_mad") > 0, F.col("_mad")).otherwise(F.col("_sd") / 1.4826)
    f = 0.6745 if scale == "usual" else 1.4826
    z = F.when(mad > 0, f * (F.col(col) - F.col("_med")) / mad)
    return d.withColumn("z", z).withColumn("outlier", F.coalesce(F.abs("z") > limit, F.lit(False))).drop("_med", "_dev", "_mad", "_sd")


def grubbs(df: DataFrame, key: str, col: str, by: Sequence[str]) -> DataFrame:
    """The most extreme value of each group and its G; without a G (fewer than 3 values, or all equal) there is a ``reason``."""
    d = attach(df.select(*by, key, col), list(by), _m=F.avg(col), _s=F.stddev_samp(col), n=F.count(col))
    d = d.withColumn("reason", F.when(F.col("n") < 3, "fewer than 3 values").when(~(F.col("_s") > 0), "all values equal"))
    some = F.col("reason").isNull()
    g = d.withColumn("g", F.when(some, F.abs(F.col(col) - F.col("_m")) / F.col("_s")))
    what = F.struct(F.when(some, F.col(key)).alias(key), F.when(some, F.col(col)).alias(col), "g", "n", "reason")
    return g.groupBy(*by).agg(F.min_by(what, F.struct(F.coalesce(-F.col("g"), F.lit(1.0)), F.col(key))).alias("x")).select(*by, "x.*")


def grubbs_decision(rows: DataFrame, alpha: float = 0.05) -> DataFrame:
    n = F.col("n").cast("double")
    t = tails.t_critical(1 - alpha / (2 * n), n - 2)
    crit = (n - 1) / F.sqrt(n) * F.sqrt(t * t / (n - 2 + t * t))
    return rows.withColumn("critical", crit).withColumn("outlier", F.col("g") > F.col("critical"))


# Critical Dixon Q at 95 % for 3..10 values; larger groups use the last entry.
DIXON = {3: 0.970, 4: 0.829, 5: 0.710, 6: 0.625, 7: 0.568, 8: 0.526, 9: 0.493, 10: 0.466}


def dixon(df: DataFrame, key: str, col: str, by: Sequence[str]) -> DataFrame:
    """Gap over range at both ends of each group, from two order statistics per end.

    A group without a Q (fewer than 3 values, or all equal) keeps its row with NULL and a ``reason``.
    """
    groups = df.select(*by).distinct()
    pos = attach(frame_index(df.filter(F.col(col).isNotNull()).select(*by, key, col), list(by), [col, key]), list(by), n=F.count(F.lit(1)))
    at = lambda k, c: F.max(F.when(F.col("frame") == k, F.col(c)))
    g = pos.groupBy(*by).agg(
        F.first("n").alias("n"), at(F.lit(0), col).alias("a"), at(F.lit(1), col).alias("b"), at(F.col("n") - 2, col).alias("y"), at(F.col("n") - 1, col).alias("z"),
        at(F.lit(0), key).alias("ka"), at(F.col("n") - 1, key).alias("kz"),
    )
    g = groups.join(g, list(by), "left") if by else g
    few = F.coalesce(F.col("n"), F.lit(0)) < 3
    fine = ~few & (F.col("z") > F.col("a"))
    crit = F.lit(DIXON[10])
    for n, v in DIXON.items():
        crit = F.when(F.col("n") == n, v).otherwise(crit)
    lo, hi = (F.when(fine, F.try_divide(d, F.col("z") - F.col("a"))) for d in (F.col("b") - F.col("a"), F.col("z") - F.col("y")))
    q, at_end = F.greatest(lo, hi), F.when(lo >= hi, F.col("ka")).when(lo < hi, F.col("kz"))
    why = F.when(few, "fewer than 3 values").when(~fine, "all values equal")
    return g.select(*by, F.coalesce("n", F.lit(0)).alias("n"), q.alias("q"), at_end.alias(key), F.when(fine, crit).alias("critical"), (q > crit).alias("outlier"), why.alias("reason"))


def curve_outliers(df: DataFrame, mobile: str, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Implausible mobile fractions first, statistical fences on the rest."""
    from rekurve.operators.quality import biological_rejection

    d = df.withColumn("reason", biological_rejection(F.col(mobile)))
    rest = iqr_flags(d.filter("reason is null"), cols, by)
    hits = [F.when(F.col(f"{c}_outlier"), F.lit(c)) for c in cols]
    rest = rest.withColumn("reason", F.when(F.col("outlier"), F.concat(F.lit("statistical: "), F.concat_ws(",", *hits)))).drop(*[f"{c}_outlier" for c in cols], "outlier")
    return d.filter("reason is not null").unionByName(rest).withColumn("outlier", F.col("reason").isNotNull())


def outlier_summary(flags: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """Per row whether any parameter is flagged and which."""
    names = F.concat_ws(",", *[F.when(F.col(f"{c}_outlier"), F.lit(c)) for c in cols])
    return flags.select(key, (names != "").alias("any_outlier"), names.alias("parameters"))


def prepare(df: DataFrame, cols: Sequence[str], qc: Column | None = None) -> DataFrame:
    """Rows that pass QC without NULLs, infinities set to the median, centred by median and scaled by IQR."""
    d = cut_lineage((df.filter(qc) if qc is not None else df).dropna(subset=list(cols)))  # read several times for each column
    inf = lambda c: (F.abs(F.col(c).cast("double")) == float("inf")) | F.isnan(F.col(c).cast("double"))
    for c in cols:
        q = quantiles(d.filter(~inf(c)), [], c, [0.25, 0.5, 0.75]).withColumnRenamed("q", "_q")
        j = d.crossJoin(F.broadcast(q))  # one row
        v = F.when(inf(c), F.col("_q")[1]).otherwise(F.col(c))
        span = F.col("_q")[2] - F.col("_q")[0]
        d = j.withColumn(f"{c}_scaled", (v - F.col("_q")[1]) / F.when(span > 0, span).otherwise(1.0)).drop("_q")
    return d


# ---- isolation forest ---------------------------------------------------------------------------------------------------
def _grow(x: np.ndarray, limit: int, rng) -> list[tuple]:
    """Nodes (feature, cut, left, right, size); feature -1 marks a leaf."""
    nodes: list = []

    def build(rows, depth):
        i = len(nodes)
        nodes.append(None)
        lo, hi = x[rows].min(0), x[rows].max(0)
        open_ = np.flatnonzero(hi > lo)
        if depth >= limit or len(rows) <= 1 or not len(open_):
            nodes[i] = (-1, 0.0, -1, -1, len(rows))
            return i
        f = int(rng.choice(open_))
        cut = float(rng.uniform(lo[f], hi[f]))
        left = x[rows, f] < cut
        if left.all() or not left.any():
            nodes[i] = (-1, 0.0, -1, -1, len(rows))
            return i
        a, b = build(rows[left], depth + 1), build(rows[~left], depth + 1)
        nodes[i] = (f, cut, a, b, len(rows))
        return i

    build(np.arange(len(x)), 0)
    return nodes


def _expected(n):
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def isolation_forest(df: DataFrame, key: str, cols: Sequence[str], trees: int = 100, sample: int = 256, contamination: float = 0.1, seed: int = 7) -> DataFrame:
    """Each tree is grown in its own task on about ``sample`` rows picked by hash; all rows are then scored.

    The model is at most trees x 2 x sample nodes whatever the table size; the rows are read twice.
    """
    cols = list(cols)
    share = min(1.0, sample / max(df.count(), 1))
    # a draw of its own for every row and tree, whatever the size of the table; only the few hits become rows
    draw = lambda t: F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(key), t), 11) / F.lit(float(1 << 53))
    hits = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: draw(t) < share)
    picked = df.select(key, *cols, F.explode(hits).alias("tree"))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        t = int(pdf["tree"].iloc[0])
        x = pdf[cols].to_numpy(float)
        nodes = _grow(x, int(np.ceil(np.log2(max(sample, 2)))), np.random.default_rng(seed * 1000 + t))
        return pd.DataFrame(nodes, columns=["f", "cut", "l", "r", "n"]).assign(tree=t, i=range(len(nodes)), m=len(x))

    model = picked.groupBy("tree").applyInPandas(grow, "f int, cut double, l int, r int, n int, tree int, i int, m int").toPandas()  # fixed size
    forest = [g.sort_values("i")[["f", "cut", "l", "r", "n"]].to_numpy(float) for _, g in model.groupby("tree")]
    norm = float(_expected(model["m"].mean()))

    def score(batches):
        for b in batches:
            x = b[cols].to_numpy(float)
            total = np.zeros(len(x))
            for t in forest:
                node, depth = np.zeros(len(x), int), np.zeros(len(x))
                while True:
                    inner = t[node, 0] >= 0
                    if not inner.any():
                        break
                    go = np.where(x[np.arange(len(x)), np.maximum(t[node, 0], 0).astype(int)] < t[node, 1], t[node, 2], t[node, 3]).astype(int)
                    node, depth = np.where(inner, go, node), depth + inner
                total += depth + _expected(t[node, 4])
            yield pd.DataFrame({key: b[key], "score": 2 ** (-total / len(forest) / norm)})

    kt = {f.name: f.dataType.simpleString() for f in df.schema.fields}[key]
    s = cut_lineage(df.select(key, *cols).mapInPandas(score, f"{key} {kt}, score double"))
    cut = quantiles(s, [], "score", [1 - contamination]).select(F.col("q")[0].alias("_cut"))
    return s.crossJoin(F.broadcast(cut)).withColumn("outlier", F.col("score") > F.col("_cut")).drop("_cut")  # one row


def _cov(df: DataFrame, cols: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance: p + p*p numbers."""
    aggs = [F.avg(c) for c in cols] + [F.covar_samp(a, b) for a in cols for b in cols]
    r = list(df.agg(*aggs).first())
    p = len(cols)
    return np.array(r[:p], float), np.array(r[p:], float).reshape(p, p)


def mahalanobis(df: DataFrame, cols: Sequence[str], mean: np.ndarray, cov: np.ndarray, out: str = "md2") -> DataFrame:
    inv = np.linalg.pinv(cov)
    d = [F.col(c) - float(m) for c, m in zip(cols, mean)]
    expr = sum((d[i] * d[j] * float(inv[i, j]) for i in range(len(d)) for j in range(len(d))), F.lit(0.0))
    return df.withColumn(out, expr)


def _near_half(d: DataFrame, cols: Sequence[str], mean: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance of the rows whose ``md2`` is at most its lower median.

    Moments are added up by ranges of ``md2``, and only the range that holds the median is looked at again, more closely.
    """
    p = len(cols)
    x = [F.col(c) - float(m) for c, m in zip(cols, mean)]
    sums = [F.count(F.lit(1)), *[F.sum(a) for a in x], *[F.sum(a * z) for a in x for z in x]]
    inside, part = d, F.when(F.col("md2") > 0, F.floor(F.log2("md2") * 256)).otherwise(F.lit(-(1 << 40)))
    total, place = np.zeros(1 + p + p * p), None
    while True:
        ranges = inside.groupBy(part.alias("part")).agg(F.min("md2"), F.max("md2"), *sums).collect()  # about 4096 rows
        place = (sum(r[3] for r in ranges) - 1) // 2 if place is None else place
        for r in sorted(ranges, key=lambda r: r["part"]):
            lo, hi, own = r[1], r[2], np.array(r[3:], float)
            if place < own[0]:
                break
            place, total = place - int(own[0]), total + own
        if lo == hi:
            n, s, ss = (total + own)[0], (total + own)[1 : 1 + p], (total + own)[1 + p :].reshape(p, p)
            return mean + s / n, (ss - np.outer(s, s) / n) / (n - 1)
        inside, part = d.filter(F.col("md2").between(lo, hi)), F.least(F.floor((F.col("md2") - lo) / (hi - lo) * 4096), F.lit(4095))


def _concentrated(df: DataFrame, cols: Sequence[str], mean: np.ndarray, cov: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Moments of the half of the rows nearest to the moments before, until its volume shrinks no more: log volume, mean, covariance."""
    size = np.inf
    while True:
        mean, cov = _near_half(mahalanobis(df, cols, mean, cov).filter("md2 is not null and not isnan(md2)"), cols, mean)
        now = float(np.linalg.slogdet(cov)[1])
        if not now < size - 1e-9:
            return min(now, size), mean, cov
        size = now


def elliptic_envelope(df: DataFrame, cols: Sequence[str], contamination: float = 0.1) -> DataFrame:
    """The half of the rows with the least volume, then a quantile of the distances from its moments.

    It is sought from the moments of all rows and from the medians with squared median deviations, which far rows don't
    move; the smaller volume wins.
    """
    cols = list(cols)
    middle = [quantiles(df, [], c, [0.5]).first()["q"][0] for c in cols]
    apart = [quantiles(df.select(F.abs(F.col(c) - F.lit(m)).alias("_d")), [], "_d", [0.5]).first()["q"][0] for c, m in zip(cols, middle)]
    starts = [_cov(df, cols), (np.array(middle, float), np.diag(np.array(apart, float) ** 2))]
    _, mean, cov = min((_concentrated(df, cols, *s) for s in starts), key=lambda found: found[0])
    d = mahalanobis(df, cols, mean, cov)
    cut = quantiles(d, [], "md2", [1 - contamination]).first()["q"][0]
    return d.withColumn("outlier", F.col("md2") > cut)


def combine(*flagged: DataFrame, key: str) -> DataFrame:
    """Keys flagged by any method."""
    out = flagged[0].filter("outlier").select(key)
    for f in flagged[1:]:
        out = out.unionByName(f.filter("outlier").select(key))
    return out.distinct()


def remove(df: DataFrame, outliers: DataFrame, key: str) -> DataFrame:
    """U3."""
    return df.join(outliers.select(key), key, "left_anti")


def forest_classifier(df: DataFrame, cols: Sequence[str], label: str, folds: int = 5, trees: int = 100, seed: int = 42):
    """Random forest, cross-validated AUC, and importances: (model, auc, importance table)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.feature import Imputer, VectorAssembler
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    cols = list(cols)
    d = df.withColumn("label", F.col(label).cast("double"))
    pipe = Pipeline(stages=[
        Imputer(inputCols=cols, outputCols=[f"{c}_in" for c in cols], strategy="median"), VectorAssembler(inputCols=[f"{c}_in" for c in cols], outputCol="features"),
        RandomForestClassifier(numTrees=trees, seed=seed),
    ])
    cv = CrossValidator(estimator=pipe, estimatorParamMaps=ParamGridBuilder().build(), evaluator=BinaryClassificationEvaluator(), numFolds=folds, seed=seed)
    fitted = cv.fit(d)
    model = fitted.bestModel
    imp = [(c, float(v)) for c, v in zip(cols, model.stages[-1].featureImportances.toArray())]
    return model, float(fitted.avgMetrics[0]), df.sparkSession.createDataFrame(imp, "feature string, importance double")


def forest_scores(model, df: DataFrame, key: str) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    p = model.transform(df.withColumn("label", F.lit(0.0)))
    return p.select(key, vector_to_array("probability")[1].alias("probability"), (F.col("prediction") == 1.0).alias("outlier"))
