"""Gaussian mixtures of all groups of a table at once.

Rows of a group are brought together once; a task then runs expectation and maximization for many groups, numbers of components and
starts side by side, so ten thousand groups are one exchange.  A group too large for that stays spread over its tasks: an iteration
adds up the weighted moments that each task sees, and only these sums are shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from rekurve.operators.ordered import SEGMENT_CONF, SEGMENT_ROWS, whole_groups
from rekurve.plans.session import cut_lineage

#: Rows that a task works on at once, and added to every variance (columns have unit variance).
LOCAL_ROWS, RIDGE = 20_000, 1e-6
#: A fit has settled if an iteration gains less than this for each row; an iteration more than MOST is not made.
SETTLED, MOST = 1e-6, 500


def _sizes(k: int, d: int) -> int:
    return k * (1 + d + d * d)


def _split(theta: np.ndarray, k: int, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights, means and covariances by group and component."""
    g = len(theta)
    return theta[:, :k], theta[:, k : k + k * d].reshape(g, k, d), theta[:, k + k * d :].reshape(g, k, d, d)


def _joined(w: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
    g, k, d = mean.shape
    return np.concatenate([w, mean.reshape(g, k * d), cov.reshape(g, k * d * d)], axis=1)


def first_guess(cov: np.ndarray, k: int, start: int) -> np.ndarray:
    """Components in a row along a main axis of each group (the next one for the next start), at the quantiles of a normal distribution."""
    g, d = cov.shape[:2]
    size, axes = np.linalg.eigh(cov)
    which = d - 1 - start % d
    axis = axes[:, :, which] * np.sign(axes[:, :, which].sum(1) + 1e-12)[:, None]
    at = np.array([NormalDist().inv_cdf((j + 0.5) / k) for j in range(k)]) * (1 + 0.5 * (start // d))
    mean = at[None, :, None] * np.sqrt(np.maximum(size[:, which], RIDGE))[:, None, None] * axis[:, None, :]
    return _joined(np.full((g, k), 1 / k), mean, np.repeat((cov / k + RIDGE * np.eye(d))[:, None], k, axis=1))


def _log_parts(x: np.ndarray, seg: np.ndarray, theta: np.ndarray, k: int) -> np.ndarray:
    """The log of weight times density of every row under every component of its group."""
    d = x.shape[1]
    w, mean, cov = _split(theta, k, d)
    root = np.linalg.cholesky(cov)
    const = np.log(np.maximum(w, 1e-300)) - np.log(np.diagonal(root, axis1=2, axis2=3)).sum(2) - d / 2 * math.log(2 * math.pi)
    z = np.einsum("nkij,nkj->nki", np.linalg.inv(root)[seg], x[:, None, :] - mean[seg])
    return const[seg] - 0.5 * (z * z).sum(2)


def _weigh(x: np.ndarray, seg: np.ndarray, theta: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Log density of every row, and its share in every component."""
    p = _log_parts(x, seg, theta, k)
    top = p.max(1, keepdims=True)
    e = np.exp(p - top)
    total = e.sum(1, keepdims=True)
    return (top + np.log(total))[:, 0], e / total


def _by_group(seg: np.ndarray, values: np.ndarray, groups: int) -> np.ndarray:
    """Sums of rows that are sorted by group."""
    out = np.zeros((groups, values.shape[1]))
    if len(seg):
        at = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
        out[seg[at]] = np.add.reduceat(values, at, axis=0)
    return out


def expected(x: np.ndarray, seg: np.ndarray, theta: np.ndarray, k: int) -> np.ndarray:
    """By group: log likelihood, rows whose largest share a component has, and the weighted sums of 1, x and x x'."""
    out = np.zeros((len(theta), 1 + k + _sizes(k, x.shape[1])))
    for lo in range(0, len(x), LOCAL_ROWS):
        xs, s = x[lo : lo + LOCAL_ROWS], seg[lo : lo + LOCAL_ROWS]
        if s[0] == s[-1]:
            out[s[0]] += _expected_of_one(xs, theta[s[0]][None], k)
            continue
        ll, r = _weigh(xs, s, theta, k)
        hard = (r.argmax(1)[:, None] == np.arange(k)).astype(float)
        rx = r[:, :, None] * xs[:, None, :]
        rxx = rx[:, :, :, None] * xs[:, None, None, :]
        out += _by_group(s, np.concatenate([ll[:, None], hard, r, rx.reshape(len(xs), -1), rxx.reshape(len(xs), -1)], axis=1), len(theta))
    return out


def _expected_of_one(x: np.ndarray, theta: np.ndarray, k: int) -> np.ndarray:
    """The same for rows of a single group: sums of products are matrix products, and no row gets a copy of its group's state."""
    n, d = x.shape
    w, mean, cov = _split(theta, k, d)
    root = np.linalg.cholesky(cov[0])
    const = np.log(np.maximum(w[0], 1e-300)) - np.log(np.diagonal(root, axis1=1, axis2=2)).sum(1) - d / 2 * math.log(2 * math.pi)
    inv, p = np.linalg.inv(root), np.empty((k, n))
    for j in range(k):
        z = inv[j] @ (x - mean[0, j]).T
        p[j] = const[j] - 0.5 * np.einsum("in,in->n", z, z)
    top = p.max(0)
    hard = np.bincount(p.argmax(0), minlength=k).astype(float)
    r = np.exp(p - top, out=p)
    total = r.sum(0)
    r /= total
    xx = (x[:, :, None] * x[:, None, :]).reshape(n, d * d)
    return np.concatenate([[(top + np.log(total)).sum()], hard, r.sum(1), (r @ x).ravel(), (r @ xx).ravel()])


def maximized(sums: np.ndarray, n: np.ndarray, k: int, d: int) -> np.ndarray:
    total, sx, sxx = _split(sums[:, 1 + k :], k, d)
    safe = np.maximum(total, 1e-10)
    mean = sx / safe[:, :, None]
    cov = sxx / safe[:, :, None, None] - mean[:, :, :, None] * mean[:, :, None, :]
    cov = (cov + cov.swapaxes(2, 3)) / 2
    low, axes = np.linalg.eigh(cov)  # rounding may leave a variance below zero
    cov = np.einsum("gkij,gkj,gklj->gkil", axes, np.maximum(low, 0) + RIDGE, axes)
    return _joined(total / n[:, None], mean, cov)


def configurations(max_k: int, starts: int) -> list[tuple[int, int]]:
    return [(k, s) for k in range(2, max_k + 1) for s in range(starts)]


def chosen(n: np.ndarray, ones: np.ndarray, found: list[tuple[int, np.ndarray, np.ndarray]], d: int, need: float | None, min_size: int) -> tuple[np.ndarray, np.ndarray]:
    """By group, the configuration with the best BIC (-1: one component) and its BIC.

    ``found``: components, log likelihood and smallest component of each configuration.  Without ``need`` the smallest BIC wins; else
    components are added as long as each one gains more than ``need``.  A configuration whose smallest component is too small is out.
    """
    size = d + d * (d + 1) / 2
    best, pick, going = -2 * ones + size * np.log(n), np.full(len(n), -1), np.ones(len(n), bool)
    for k in sorted({k for k, _, _ in found}):
        own = [i for i, f in enumerate(found) if f[0] == k]
        bic = np.array([np.where((found[i][2] >= min_size) & (n >= k * min_size), -2 * found[i][1] + (k * size + k - 1) * np.log(n), np.inf) for i in own])
        at, low = bic.argmin(0), bic.min(0)
        better = going & (best - low > (need or 0.0))
        pick, best = np.where(better, np.array(own)[at], pick), np.where(better, low, best)
        if need is not None:
            going &= better
    return pick, best


def _one(cov: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Log likelihood of a single normal distribution."""
    d = cov.shape[1]
    c = cov + RIDGE * np.eye(d)
    return -n / 2 * (d * math.log(2 * math.pi) + np.linalg.slogdet(c)[1] + np.trace(np.linalg.solve(c, cov), axis1=1, axis2=2))


def fit_groups(x: np.ndarray, starts_at: np.ndarray, max_k: int, starts: int, need: float | None, min_size: int) -> tuple[np.ndarray, ...]:
    """Whole groups that lie one behind the other: cluster and its probability by row, components and BIC by group."""
    g, d = len(starts_at), x.shape[1]
    n = np.diff(np.r_[starts_at, len(x)]).astype(float)
    seg = np.repeat(np.arange(g), n.astype(int))
    mean = np.add.reduceat(x, starts_at, axis=0) / n[:, None]
    x = x - mean[seg]
    spread = np.sqrt(np.add.reduceat(x * x, starts_at, axis=0) / n[:, None])
    x = x / np.where(spread > 0, spread, 1.0)[seg]
    cov = np.add.reduceat(x[:, :, None] * x[:, None, :], starts_at, axis=0) / n[:, None, None]
    found, thetas = [], []
    for k, start in configurations(max_k, starts):
        theta, last, smallest = first_guess(cov, k, start), np.full(g, -np.inf), np.zeros(g)
        going = np.flatnonzero(n >= k)
        for _ in range(MOST):
            if not len(going):
                break
            rows = np.isin(seg, going) if len(going) < g else slice(None)
            s = np.searchsorted(going, seg[rows])
            sums = expected(x[rows], s, theta[going], k)
            gain = sums[:, 0] - last[going]
            last[going], smallest[going] = sums[:, 0], sums[:, 1 : 1 + k].min(1)
            more = gain > SETTLED * n[going]
            theta[going[more]] = maximized(sums[more], n[going[more]], k, d)
            going = going[more]
        found.append((k, last, smallest))
        thetas.append(theta)
    pick, bic = chosen(n, _one(cov, n), found, d, need, min_size)
    cluster, prob, ks = np.zeros(len(x), np.int32), np.ones(len(x)), np.ones(g, np.int32)
    for i, (k, _, _) in enumerate(found):
        own = np.flatnonzero(pick == i)
        ks[own] = k
        for lo in range(0, len(x), LOCAL_ROWS):
            at = lo + np.flatnonzero(np.isin(seg[lo : lo + LOCAL_ROWS], own))
            if len(at):
                r = _weigh(x[at], seg[at], thetas[i], k)[1]
                cluster[at], prob[at] = r.argmax(1), r.max(1)
    return cluster, prob, ks, bic


def group_mixtures(df: DataFrame, group: Sequence[str], cols: Sequence[str], max_k: int = 3, starts: int = 2, gain: float | None = None, min_size: int = 3) -> DataFrame:
    """Every row with ``cluster, cluster_prob, k, bic`` of the Gaussian mixture that its group gets.

    Columns are standardized within their group.  Each number of components from 2 to ``max_k`` is fitted from ``starts`` first guesses
    that follow from the group's own moments; without ``gain`` the smallest BIC wins, with it a further component must lower BIC by
    more than that.  A fit whose smallest component has fewer than ``min_size`` rows does not count, and a group without another
    fit is one component.  Rows with a missing or non-finite value keep their place with NULL in all four columns.
    """
    group, cols, d = list(group), list(cols), len(cols)
    spark = df.sparkSession
    fine = F.lit(True)
    for c in cols:
        v = F.col(c).cast("double")
        fine &= v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    rows = df.filter(fine)
    limit = int(spark.conf.get(SEGMENT_CONF, str(SEGMENT_ROWS)))
    large = cut_lineage(rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > limit))
    some = not large.isEmpty()
    same = lambda right: [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in group]
    usual = rows.alias("a").join(large.alias("b"), same(large), "left_anti") if some else rows
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join(f"`{c}` {t}" for c, t in types.items()) + ", cluster int, cluster_prob double, k int, bic double"

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b, at in whole_groups(batches, group, LOCAL_ROWS):
            cluster, prob, k, bic = fit_groups(b[cols].to_numpy(float), at, max_k, starts, gain, min_size)
            size = np.diff(np.r_[at, len(b)])
            yield b.assign(cluster=cluster, cluster_prob=prob, k=np.repeat(k, size), bic=np.repeat(bic, size))

    out = usual.repartition(*group).sortWithinPartitions(*group).mapInPandas(local, schema)
    if some:
        hot = cut_lineage(rows.alias("a").join(large.alias("b"), same(large), "left_semi"))
        out = out.unionByName(_spread(hot, group, cols, max_k, starts, gain, min_size, schema))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("cluster", "int"), ("cluster_prob", "double"), ("k", "int"), ("bic", "double"))]
    return out.unionByName(df.filter(~fine).select("*", *none))


def _spread(rows: DataFrame, group: list[str], cols: list[str], max_k: int, starts: int, gain: float | None, min_size: int, schema: str) -> DataFrame:
    """The same for groups that stay where their rows lie; one row of state for each of them."""
    d, plans = len(cols), configurations(max_k, starts)
    x = [F.col(c).cast("double") for c in cols]
    pairs = [(i, j) for i in range(d) for j in range(d)]
    of = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"), F.array(*[F.avg(c) for c in x]).alias("_mean"), F.array(*[F.covar_pop(x[i], x[j]) for i, j in pairs]).alias("_cov"))
    names = {c: f"_g{i}" for i, c in enumerate(group)}
    kinds = ", ".join(f"{names[f.name]} {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in names)
    state_schema = kinds + ", _n long, _mean array<double>, _sd array<double>, _theta array<double>, _last array<double>, _least array<double>, _done array<boolean>, _one double"
    keys = list(names.values())

    def begin(batches):
        for p in batches:
            if not len(p):
                continue
            cov = np.array(p["_cov"].tolist()).reshape(len(p), d, d)
            sd = np.sqrt(np.diagonal(cov, axis1=1, axis2=2))
            sd = np.where(sd > 0, sd, 1.0)
            cov = cov / (sd[:, :, None] * sd[:, None, :])
            theta = np.concatenate([first_guess(cov, k, s) for k, s in plans], axis=1) if plans else np.zeros((len(p), 0))
            m = len(p)
            yield p[[*keys, "_n", "_mean"]].assign(_sd=list(sd), _theta=list(theta), _last=[[-np.inf] * len(plans)] * m, _least=[[0.0] * len(plans)] * m, _done=[[False] * len(plans)] * m, _one=_one(cov, p["_n"].to_numpy(float)))

    def placed(p: pd.DataFrame) -> np.ndarray:
        return (p[cols].to_numpy(float) - np.array(p["_mean"].tolist())) / np.array(p["_sd"].tolist())

    def groups_of(p: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        code = np.zeros(len(p), np.int64)
        for c in keys:
            code = pd.factorize(pd.Series(code).astype(str) + "|" + pd.Series(pd.factorize(p[c], use_na_sentinel=False)[0]).astype(str))[0]
        order = np.argsort(code, kind="stable")
        return order, code[order]

    carried = [c.strip().split()[0] for c in state_schema.split(", ")]

    def partial(batches):
        for p in batches:
            if not len(p):
                continue
            order, seg = groups_of(p)
            p = p.iloc[order]
            first = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
            z, theta, sums, lo = placed(p), np.array(p["_theta"].iloc[first].tolist()), [], 0
            settled = np.array(p["_done"].iloc[first].tolist(), bool).all(0)  # nobody asks for their sums any more
            for i, (k, _) in enumerate(plans):
                sums.append(np.zeros((len(first), 1 + k + _sizes(k, d))) if settled[i] else expected(z, seg, theta[:, lo : lo + _sizes(k, d)], k))
                lo += _sizes(k, d)
            yield p[carried].iloc[first].assign(_sums=list(np.concatenate(sums, axis=1)))

    def step(p: pd.DataFrame) -> pd.DataFrame:
        total, s = np.sum(p["_sums"].tolist(), axis=0), p.iloc[0]
        n = np.array([float(s["_n"])])
        theta, last, least, done = np.array(s["_theta"], float), list(s["_last"]), list(s["_least"]), list(s["_done"])
        at = lo = 0
        for i, (k, _) in enumerate(plans):
            width, own = _sizes(k, d), total[None, at : at + 1 + k + _sizes(k, d)]
            if not done[i]:
                done[i] = bool(n[0] < k or own[0, 0] - last[i] <= SETTLED * n[0])
                last[i], least[i] = own[0, 0], own[0, 1 : 1 + k].min()
                if not done[i]:
                    theta[lo : lo + width] = maximized(own, n, k, d)[0]
            at, lo = at + own.shape[1], lo + width
        return p[carried].iloc[:1].assign(_theta=[theta], _last=[last], _least=[least], _done=[done])

    state = cut_lineage(of.withColumnsRenamed(names).mapInPandas(begin, state_schema))
    settled = None
    for _ in range(MOST if plans else 0):
        fixed = state.filter(F.forall("_done", lambda x: x))
        settled = fixed if settled is None else settled.unionByName(fixed)
        going = state.filter(F.exists("_done", lambda x: ~x))
        if going.isEmpty():
            going = None
            break
        near = rows.select(*group, *cols).join(going, [F.col(a).eqNullSafe(F.col(b)) for a, b in names.items()])
        sums = near.mapInPandas(partial, state_schema + ", _sums array<double>")
        state = cut_lineage(sums.groupBy(*keys).applyInPandas(step, state_schema))
    final = state if settled is None else settled if going is None else settled.unionByName(state.filter(F.exists("_done", lambda x: ~x)))

    def give(batches):
        for p in batches:
            if not len(p):
                continue
            n, last, least = p["_n"].to_numpy(float), np.array(p["_last"].tolist()).reshape(len(p), -1), np.array(p["_least"].tolist()).reshape(len(p), -1)
            found = [(k, last[:, i], least[:, i]) for i, (k, _) in enumerate(plans)]
            pick, bic = chosen(n, p["_one"].to_numpy(float), found, d, gain, min_size)
            z, theta = placed(p), np.array(p["_theta"].tolist()).reshape(len(p), -1)
            cluster, prob, ks, lo = np.zeros(len(p), np.int32), np.ones(len(p)), np.ones(len(p), np.int32), 0
            order, seg = groups_of(p)
            for i, (k, _) in enumerate(plans):
                at = order[pick[order] == i]
                if len(at):
                    of_group = np.unique(seg[pick[order] == i], return_inverse=True)[1]
                    first = np.flatnonzero(np.r_[True, of_group[1:] != of_group[:-1]])
                    r = _weigh(z[at], of_group, theta[at[first], lo : lo + _sizes(k, d)], k)[1]
                    cluster[at], prob[at], ks[at] = r.argmax(1), r.max(1), k
                lo += _sizes(k, d)
            yield p.drop(columns=carried).assign(cluster=cluster, cluster_prob=prob, k=ks, bic=bic)

    return rows.join(cut_lineage(final), [F.col(a).eqNullSafe(F.col(b)) for a, b in names.items()]).mapInPandas(give, schema)
