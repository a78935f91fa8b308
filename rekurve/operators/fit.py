"""Fitting millions of curves at once (section 2.10).

Given the nonlinear parameters every model is linear in its amplitudes and offset, so the best amplitudes and the
residual sum of squares follow from second moments.  A pass evaluates a set of candidates for each curve, which depend on
its own times alone, and keeps the best; the next one narrows the candidates around it.  The rows of a curve are brought
together once and all passes follow each other there.  A curve too large for that stays spread over its tasks: each adds up
the moments it sees and only these sums are shuffled, so it costs no more than its share of the scan.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from rekurve.functions.basis import MODELS, Model, rise
from rekurve.operators.ordered import SEGMENT_CONF, SEGMENT_ROWS, group_starts, whole_groups
from rekurve.plans.session import cut_lineage

LOCAL_ROWS = 20_000  # rows of whole curves that a task works on at once
SLICE_ROWS, SLICE_CURVES = 2048, 64  # rows, and curves, whose candidates are computed at once: they stay in a core's cache
TOLERANCE = 1e-6  # relative width of the last candidates
HELD_CURVES = 4096  # partial sums a task keeps before it passes them on


# ---- moments ----------------------------------------------------------------------------------------------------------
def _sums_by_key(b: pd.DataFrame, keys: list[str], values: np.ndarray) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
    codes, _ = pd.factorize(pd.MultiIndex.from_frame(b[keys])) if len(keys) > 1 else pd.factorize(b[keys[0]])
    order = np.argsort(codes, kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(codes[order]) > 0])
    first = order[starts]
    return b.iloc[first], np.add.reduceat(values[order], starts, axis=0), first


def _products(tt, yy, b, columns, pairs, weight) -> np.ndarray:
    x = columns(tt, b)
    w = np.ones(len(b)) if weight is None else weight(tt, yy, b)
    wx = x * w[:, None]
    return np.column_stack([np.ones(len(b)), w, w * yy, w * yy * yy, wx, wx * yy[:, None], wx[:, pairs[:, 0]] * x[:, pairs[:, 1]]])


def _accumulate(keys: list[str], carry: list[str], t: str, y: str, columns: Callable, pairs: np.ndarray, weight: Callable | None):
    """mapInPandas body: per curve n, sum(w), sum(wy), sum(wyy), sum(wx), sum(wxy), sum(w x_i x_j)."""

    def flush(held, rest):
        out = pd.DataFrame(list(held), columns=keys)
        for i, c in enumerate(carry):
            out[c] = [rest[k][i] for k in held]
        out["m"] = list(held.values())
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        rest: dict = {}
        for b in batches:
            if not len(b):
                continue
            vals = _products(b[t].to_numpy(float), b[y].to_numpy(float), b, columns, pairs, weight)
            rows, sums, _ = _sums_by_key(b, keys, vals)
            for key, extra, s in zip(rows[keys].itertuples(index=False, name=None), rows[carry].itertuples(index=False, name=None) if carry else itertools.repeat(()), sums):
                if key in held:
                    held[key] = held[key] + s
                else:
                    held[key], rest[key] = s, extra
            if len(held) > HELD_CURVES:
                yield flush(held, rest)
                held, rest = {}, {}
        if held:
            yield flush(held, rest)

    return run


def _merge_then(keys: list[str], solve: Callable):
    """mapInPandas body on key-sorted partial sums: add equal keys, then hand whole curves to ``solve``."""

    def run(batches):
        left = None
        for b in batches:
            if left is not None:
                b = pd.concat([left, b], ignore_index=True)
            if not len(b):
                continue
            rows, sums, _ = _sums_by_key(b, keys, np.array(b["m"].tolist()))
            rows = rows.assign(m=list(sums))
            left = rows.iloc[[-1]]  # may go on in the next batch
            if len(rows) > 1:
                yield from solve(rows.iloc[:-1].drop(columns="m"), sums[:-1])
        if left is not None:
            yield from solve(left.drop(columns="m"), np.array(left["m"].tolist()))

    return run


def _types(df: DataFrame, cols: Sequence[str]) -> str:
    t = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return ", ".join(f"`{c}` {t[c]}" for c in cols)


@dataclass
class Pass:
    """One look at the rows: candidate columns per row, and how the sums of a curve become its best candidate."""

    columns: Callable  # (times, rows) -> row x candidate column
    n_cols: int
    pairs: np.ndarray
    solve: Callable  # (one row per curve, sums ...) -> frames
    schema: str
    carry: Sequence[str] = ()
    weight: Callable | None = None
    params: Callable | None = None  # (one row per curve) -> arrays of curve x candidate; then columns are basis(times, *params)
    basis: Callable | None = None

    def solved(self, rows: pd.DataFrame, m: np.ndarray) -> Iterator[pd.DataFrame]:
        k = self.n_cols
        return self.solve(rows, m[:, 0], m[:, 1], m[:, 2], m[:, 3], m[:, 4 : 4 + k], m[:, 4 + k : 4 + 2 * k], m[:, 4 + 2 * k :])


def moment_round(df: DataFrame, keys: Sequence[str], t: str, y: str, p: Pass) -> DataFrame:
    """A pass over rows that lie anywhere, and one shuffle of partial sums."""
    keys, carry = list(keys), list(p.carry)
    part = df.select(*keys, *carry, t, y).mapInPandas(_accumulate(keys, carry, t, y, p.columns, p.pairs, p.weight), _types(df, [*keys, *carry]) + ", m array<double>")
    return part.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(_merge_then(keys, p.solved), p.schema)


def _slices(starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """Whole curves of at most SLICE_ROWS together, or pieces of one longer curve: its sums don't depend on what lies around it."""
    first = 0
    while first < len(starts):
        last = int(np.searchsorted(ends, starts[first] + SLICE_ROWS, "right"))
        if last > first:
            yield int(starts[first]), int(ends[last - 1])
        else:
            last = first + 1
            for lo in range(int(starts[first]), int(ends[first]), SLICE_ROWS):
                yield lo, min(lo + SLICE_ROWS, int(ends[first]))
        first = last


def _local_sums(b: pd.DataFrame, starts: np.ndarray, t: str, y: str, p: Pass) -> np.ndarray:
    """The sums of whole curves in memory, which lie one behind the other."""
    tt, yy, ends, k = b[t].to_numpy(float), b[y].to_numpy(float), np.r_[starts[1:], len(b)], p.n_cols
    of = np.repeat(np.arange(len(starts)), ends - starts)
    params = p.params(b.iloc[starts]) if p.params else None
    squares = bool((p.pairs[:, 0] == p.pairs[:, 1]).all()) and len(p.pairs) == k
    flat = p.pairs[:, 0] * k + p.pairs[:, 1]
    m = np.zeros((len(starts), 4 + 2 * k + len(p.pairs)))
    for lo, hi in _slices(starts, ends):  # columns of a slice at a time: a long curve takes no more memory than a short one
        t1, y1 = tt[lo:hi], yy[lo:hi]
        if params is not None:
            x = p.basis(t1[:, None], *[c[of[lo:hi]] for c in params])
        else:
            x = p.columns(t1, b.iloc[lo:hi])
        w = np.ones(hi - lo) if p.weight is None else p.weight(t1, y1, b.iloc[lo:hi])
        wy = w * y1
        first, last = of[lo], of[hi - 1] + 1
        at, to = np.maximum(starts[first:last] - lo, 0), np.minimum(ends[first:last], hi) - lo
        m[first:last, :4] += np.add.reduceat(np.column_stack([np.ones(hi - lo), w, wy, wy * y1]), at, axis=0)
        level = np.stack([w, wy])
        wx = x if p.weight is None else x * w[:, None]
        if squares:
            wx = wx * x
        for c, i, j in zip(range(first, last), at, to):
            m[c, 4 : 4 + 2 * k] += (level[:, i:j] @ x[i:j]).ravel()
            m[c, 4 + 2 * k :] += wx[i:j].sum(0) if squares else (wx[i:j].T @ x[i:j]).ravel()[flat]
    return m


def _local_round(b: pd.DataFrame, starts: np.ndarray, t: str, y: str, p: Pass) -> pd.DataFrame:
    """A pass over whole curves in memory."""
    return pd.concat(p.solved(b.iloc[starts].reset_index(drop=True), _local_sums(b, starts, t, y, p)), ignore_index=True)


def curve_span(df: DataFrame, keys: Sequence[str], t: str = "t") -> DataFrame:
    """Shortest positive and longest time of every curve (``_lo, _hi``); they set its first candidates, and nothing else does."""
    g = df.groupBy(*keys).agg(F.min(F.when(F.col(t) > 0, F.col(t))).alias("_lo"), F.max(t).alias("_hi"))
    hi = F.when(F.col("_hi") > 0, F.col("_hi")).otherwise(1.0)
    return g.select(*keys, F.greatest(F.coalesce("_lo", F.lit(1e-3)), hi * 1e-4).alias("_lo"), hi.alias("_hi"))


def _local_span(tt: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hi = np.fmax.reduceat(tt, starts)
    hi = np.where(hi > 0, hi, 1.0)
    lo = np.minimum.reduceat(np.where(tt > 0, tt, np.inf), starts)
    return np.maximum(np.where(np.isfinite(lo), lo, 1e-3), hi * 1e-4), hi


def fit_curves(df: DataFrame, keys: Sequence[str], t: str, y: str, extra: Sequence[str], first: Pass, zooms: Sequence[Pass], winner: Sequence[str]) -> DataFrame:
    """A first pass over candidates set by each curve's span, then passes around each curve's last ``winner`` columns.

    The rows are clustered by curve in one exchange, and all passes over a curve follow each other in memory.  Only a curve above
    ``spark.rekurve.segmentRows`` stays spread over its tasks: there every pass adds up moments map-side and shuffles the sums.
    """
    keys, extra, winner = list(keys), list(extra), list(winner)
    df = df.select(*keys, *extra, t, y)
    spark = df.sparkSession
    limit = int(spark.conf.get(SEGMENT_CONF, str(SEGMENT_ROWS)))
    large = cut_lineage(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > limit))
    some = not large.isEmpty()
    usual = df.join(large, keys, "left_anti") if some else df

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def fitted(b: pd.DataFrame) -> pd.DataFrame:
            new = np.zeros(len(b), bool)
            new[0] = True
            for k in keys:
                v = b[k].to_numpy()
                new[1:] |= v[1:] != v[:-1]
            starts = np.flatnonzero(new)
            size = np.diff(np.r_[starts, len(b)])
            lo, hi = _local_span(b[t].to_numpy(float), starts)
            b = b.assign(_lo=np.repeat(lo, size), _hi=np.repeat(hi, size))
            w = _local_round(b, starts, t, y, first)
            for z in zooms:
                b = b.assign(**{c: np.repeat(w[c].to_numpy(), size) for c in winner})
                w = _local_round(b, starts, t, y, z)
            return w

        for p in batches:
            held.append(p)
            if sum(map(len, held)) < LOCAL_ROWS:
                continue
            b = pd.concat(held, ignore_index=True)
            last = np.logical_and.reduce([(b[k] == b[k].iloc[-1]).to_numpy() for k in keys])
            done = len(b) - int(last[::-1].argmin() if not last.all() else len(b))
            held = [b.iloc[done:]]
            if done:
                yield fitted(b.iloc[:done])
        if held and sum(map(len, held)):
            yield fitted(pd.concat(held, ignore_index=True))

    out = usual.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, first.schema)
    if some:
        rows = cut_lineage(df.join(large.drop("_n"), keys, "left_semi"))
        rows = rows.join(cut_lineage(curve_span(rows, keys, t)), keys)
        w = moment_round(rows, keys, t, y, first)
        for z in zooms:
            w = moment_round(rows.join(cut_lineage(w.select(*keys, *winner)), keys), keys, t, y, z)
        out = out.unionByName(w)
    return out


# ---- one amplitude and offset, one or two nonlinear parameters ----------------------------------------------------------
def _profile_rss(sw, sy, syy, sx, sxy, sxx, offset: bool, amp: tuple[float, float]):
    """Amplitude within its bounds, baseline and residual sum for every curve and candidate."""
    n = sw[:, None]
    if offset:
        cxx, cxy, cyy = sxx - sx * sx / n, sxy - sx * sy[:, None] / n, (syy - sy * sy / sw)[:, None]
    else:
        cxx, cxy, cyy = sxx, sxy, syy[:, None]
    ok = (cxx > 1e-9 * sxx) & (sxx > 1e-100)
    a = np.clip(np.divide(cxy, cxx, out=np.zeros_like(cxy), where=ok), *amp)
    rss = np.where(ok, np.clip(cyy - 2 * a * cxy + a * a * cxx, 0, None), np.inf)
    base = (sy[:, None] - a * sx) / n if offset else np.zeros_like(a)
    return a, base, rss


def _first_best(rss, sst):
    """First candidate as good as the best one up to rounding, so equal fits always give the same parameters."""
    return (rss <= (rss.min(axis=1) + 1e-9 * sst)[:, None]).argmax(axis=1)


def _axes(dims: int, points: int) -> np.ndarray:
    """Moves around a winner in parts of a step, all combinations of the parameters."""
    axis = np.arange(-points, points + 1) / (points + 1)
    return np.array(list(itertools.product(*[axis] * dims)))


def _moved(model: Model, p: list[np.ndarray], steps: list[np.ndarray], axes: np.ndarray) -> list[np.ndarray]:
    """Candidates per row: steps are relative (log) or absolute."""
    out = []
    for j, v in enumerate(p):
        m = steps[j][:, None] * axes[None, :, j]
        out.append(np.clip(v[:, None] * np.exp(m) if model.log[j] else v[:, None] + m, *model.limits[j]))
    return out


def _first(model: Model, lo: np.ndarray, hi: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Candidates and first steps per row, from the span of the row's curve."""
    span, back = np.unique(lo + 1j * hi, return_inverse=True)
    cands, steps = [], []
    for s in span:
        grids = model.grid(float(s.real), float(s.imag))
        cands.append(np.array(list(itertools.product(*grids))))
        steps.append([np.log(g[1] / g[0]) if model.log[j] else np.max(np.diff(g)) for j, g in enumerate(grids)])
    c, st = np.array(cands)[back], np.array(steps)[back]
    dims = range(len(model.log))
    return [c[:, :, j] for j in dims], [st[:, j] for j in dims]


def profile_pass(keys, model: Model, types: str, offset=True, amp=(0.0, np.inf), axes=None, shrink=1.0, weight=None, carry=(), pooled=None, pooled_types="") -> Pass:
    """A pass over the first candidates (``_lo, _hi`` of each row), or over ``axes`` around columns ``_k0[, _k1]`` by steps ``_st0[, _st1]``.
    ``pooled``: group columns whose curves share the winner; then candidate sums per group come back instead."""
    dims = len(model.log)
    ks, sts = [f"_k{j}" for j in range(dims)], [f"_st{j}" for j in range(dims)]
    n_cols = len(axes) if axes is not None else len(list(itertools.product(*model.grid(1e-3, 1.0))))

    def params(rows) -> list[np.ndarray]:
        if axes is None:
            return _first(model, rows["_lo"].to_numpy(float), rows["_hi"].to_numpy(float))[0]
        return _moved(model, [rows[k].to_numpy(float) for k in ks], [rows[c].to_numpy(float) for c in sts], axes)

    def next_steps(rows) -> list[np.ndarray]:
        """By row and candidate: smaller, but as they were for one at the edge, which says that the best lies further on."""
        if axes is None:
            return [np.repeat(s[:, None], n_cols, 1) for s in _first(model, rows["_lo"].to_numpy(float), rows["_hi"].to_numpy(float))[1]]
        edge = np.abs(axes) == np.abs(axes).max(0)
        return [np.where(edge[:, j], s[:, None], s[:, None] * shrink) for j, s in enumerate(rows[c].to_numpy(float) for c in sts)]

    def columns(tt, b):
        return model.basis(tt[:, None], *params(b))

    def best(rows, n, sw, sy, syy, sx, sxy, sxx):
        a, base, rss = _profile_rss(sw, sy, syy, sx, sxy, sxx, offset, amp)
        syc = syy - sy * sy / sw if offset else syy
        p, steps, k, r = params(rows), next_steps(rows), _first_best(rss, syc), np.arange(len(rows))
        out = rows[list(keys)].copy()
        out["n"], out["sst"], out["rss"] = n.astype("int64"), syy - sy * sy / sw, rss[r, k]
        out["amp"], out["baseline"] = a[r, k], base[r, k]
        for j in range(dims):
            out[f"_k{j}"], out[f"_st{j}"] = p[j][r, k], steps[j][r, k]
        yield out

    def pool(rows, n, sw, sy, syy, sx, sxy, sxx):
        rss = _profile_rss(sw, sy, syy, sx, sxy, sxx, offset, amp)[2]
        rss = np.where(np.isfinite(rss), rss, (syy - sy * sy / sw)[:, None])
        head, tot, first = _sums_by_key(rows, list(pooled), rss)
        p, steps = params(rows), next_steps(rows)
        for i in range(len(head)):
            at = first[i]
            yield pd.DataFrame({
                **{g: [head.iloc[i][g]] * n_cols for g in pooled}, "i": range(n_cols), "rss": tot[i],
                **{f"_k{j}": p[j][at] for j in range(dims)}, **{f"_st{j}": steps[j][at] for j in range(dims)},
            })

    kcols = "".join(f", _k{j} double, _st{j} double" for j in range(dims))
    schema = f"{types}, n long, sst double, rss double, amp double, baseline double" + kcols
    if pooled:
        schema = f"{pooled_types}, i int, rss double" + kcols
    use = ["_lo", "_hi"] if axes is None else [*ks, *sts]
    diag = np.array([(i, i) for i in range(n_cols)])
    return Pass(columns, n_cols, diag, pool if pooled else best, schema, [*use, *[c for c in carry if c not in use]], weight, params, model.basis)


def _rounds(first: float, shrink: float, rounds: int | None) -> int:
    """Passes until a step of about ``first`` is below TOLERANCE."""
    return int(np.ceil(np.log(TOLERANCE / first) / np.log(shrink))) if rounds is None else rounds


def profile_round(df, keys, model: str, t="t", y="y", offset=True, amp=(0.0, np.inf)) -> DataFrame:
    """First pass only: the best of each curve's first candidates; a curve that none fits keeps its row without ``rss``."""
    first = profile_pass(keys, MODELS[model], _types(df, keys), offset, amp)
    return fit_curves(df, keys, t, y, [], first, [], []).withColumn("rss", F.when(F.col("rss") < np.inf, F.col("rss")))


def profile_fit(
    df: DataFrame, keys: Sequence[str], model: str, t: str = "t", y: str = "y", rounds: int | None = None, offset: bool = True,
    amp: tuple[float, float] = (0.0, np.inf), robust: str | None = None, scale: float | None = None, weight: str | None = None,
) -> DataFrame:
    """Best fit per curve: ``model, n, p, rss, sst, amp, baseline, p0[, p1]``; ``weight`` names a column of row weights.

    Candidates depend on the curve's own times and are narrowed until they are within TOLERANCE (or for ``rounds`` passes).
    A curve that no candidate fits (fewer than two different times) keeps its row, with NULL for what can't be known.
    ``robust`` (huber, tukey, soft_l1) reweighs every row by its residual from the previous winner during the zoom
    rounds (F11); residuals are divided by ``scale``, by default the previous root mean square.
    """
    m, keys = MODELS[model], list(keys)
    dims, points = len(m.log), 6 if len(m.log) == 1 else 3
    ks, sts = [f"_k{j}" for j in range(dims)], [f"_st{j}" for j in range(dims)]
    own = (lambda tt, yy, b: b[weight].to_numpy(float)) if weight else None
    extra, types, shrink = [weight] if weight else [], _types(df, keys), 1.5 / (points + 1)
    first = profile_pass(keys, m, types, offset, amp, weight=own, carry=extra)
    wfn = _robust_weight(m, robust, scale, dims) if robust else own
    again = ["amp", "baseline", "rss", "n"] if robust else []
    zoom = profile_pass(keys, m, types, offset, amp, axes=_axes(dims, points), shrink=shrink, weight=wfn, carry=[*again, *extra])
    passes = _rounds(0.4, shrink, rounds) + (2 if robust and rounds is not None else 0)
    best = fit_curves(df, keys, t, y, extra, first, [zoom] * passes, [*ks, *sts, *again])
    name = f"{model}_{robust}" if robust else model
    known = lambda c: F.when(F.col("rss") < np.inf, F.col(c))
    out = best.select(*keys, F.lit(name).alias("model"), "n", F.lit(dims + (2 if offset else 1)).alias("p"), known("rss").alias("rss"), "sst", known("amp").alias("amp"), known("baseline").alias("baseline"), *[known(k).alias(f"p{j}") for j, k in enumerate(ks)])
    return out if dims == 2 else out.withColumn("p1", F.lit(None).cast("double"))


def _robust_weight(m: Model, loss: str, scale: float | None, dims: int):
    def weight(tt, yy, b):
        fit = b["baseline"].to_numpy() + b["amp"].to_numpy() * m.basis(tt, *[b[f"_k{j}"].to_numpy(float) for j in range(dims)])
        rms = np.sqrt(b["rss"].to_numpy() / b["n"].to_numpy())
        r = np.abs(yy - fit) / (scale if scale else np.maximum(np.where(np.isfinite(rms), rms, 1.0), 1e-12))
        if loss == "huber":
            return np.where(r <= 1, 1.0, 1 / np.maximum(r, 1e-300))
        if loss == "tukey":
            return np.where(r <= 4.685, (1 - (r / 4.685) ** 2) ** 2, 0.0)
        return 1 / np.sqrt(1 + r * r)

    return weight


# ---- sums of exponentials -----------------------------------------------------------------------------------------------
def _gram(sxx, pairs, k):
    g = np.zeros((len(sxx), k, k))
    g[:, pairs[:, 0], pairs[:, 1]] = sxx
    g[:, pairs[:, 1], pairs[:, 0]] = sxx
    return g


def solve_subsets(n, sy, syy, sx, sxy, gram, combos: np.ndarray, max_amp: float):
    """Amplitudes and residual sums for every curve and combination of columns; infinite where one is negative.

    The correlations of each combination are factored by Cholesky, all curves and combinations at once.
    """
    k, col = gram.shape[1], combos.T
    cxx = gram - sx[:, :, None] * sx[:, None, :] / n[:, None, None]
    scale = np.sqrt(np.clip(np.diagonal(cxx, axis1=1, axis2=2), 0, None))
    fine = scale > 0
    scale = np.where(fine, scale, 1.0)
    r = (cxx / (scale[:, :, None] * scale[:, None, :])).reshape(len(n), k * k)
    q = (sxy - sx * (sy / n)[:, None]) / scale
    ok = np.logical_and.reduce([fine[:, c] for c in col])
    low, diag, z, det = {}, [], [], 1.0
    rss = np.repeat((syy - sy * sy / n)[:, None], len(combos), axis=1)
    for i in range(len(col)):
        left, v = 1.0, q[:, col[i]]
        for j in range(i):
            u = r[:, col[i] * k + col[j]]
            for h in range(j):
                u = u - low[i, h] * low[j, h]
            low[i, j] = u / diag[j]
            left = left - low[i, j] ** 2
            v = v - low[i, j] * z[j]
        if i:
            ok &= left > 0
            det = det * left
        diag.append(np.sqrt(np.maximum(left, 1e-12)))  # a determinant above its bound has no factor below that
        z.append(v / diag[i])
        rss -= z[i] ** 2
    ok &= det > 1e-9
    m = np.empty((len(col), *rss.shape))
    for i in reversed(range(len(col))):
        v = z[i]
        for j in range(i + 1, len(col)):
            v = v - low[j, i] * m[j]
        m[i] = v / diag[i]
        ok &= m[i] >= 0
    for i in range(len(col)):
        m[i] /= scale[:, col[i]]
        if max_amp < np.inf:
            ok &= m[i] <= max_amp
    return np.moveaxis(m, 0, 2), np.where(ok, np.clip(rss, 0, None), np.inf)


def _choices(groups: list[list[int]], order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(active columns, all columns) per number of active components; an inactive one keeps its place with amplitude 0."""
    out = []
    for s in range(order, 0, -1):
        act, full = [], []
        if len(groups) == 1:
            for c in itertools.combinations(groups[0], s):
                act.append(c)
                full.append((*c, *[g for g in groups[0] if g not in c][: order - s]))
        else:
            for which in itertools.combinations(range(order), s):
                others = [groups[g][len(groups[g]) // 2] for g in range(order) if g not in which]
                for c in itertools.product(*[groups[g] for g in which]):
                    act.append(c)
                    full.append((*c, *others))
        out.append((np.array(act), np.array(full)))
    return out


def _best_subset(choices, order, taus, n, sy, syy, sx, sxy, gram, max_amp, chunk=SLICE_CURVES):
    """Best combination per curve: (rss, baseline, amplitudes, time constants), fast to slow."""
    size = len(n)
    rss, level = np.full(size, np.inf), np.zeros(size)
    amps, tt = np.zeros((size, order)), np.ones((size, order))
    for lo in range(0, size, chunk):
        s = slice(lo, min(lo + chunk, size))
        row = np.arange(s.stop - s.start)
        for act, full in choices:
            m, r = solve_subsets(n[s], sy[s], syy[s], sx[s], sxy[s], gram[s], act, max_amp)
            k = r.argmin(axis=1)
            better = r[row, k] < rss[s]
            a = np.zeros((len(row), order))
            a[:, : act.shape[1]] = m[row, k]
            level[s] = np.where(better, (m[row, k] * np.take_along_axis(sx[s], act[k], axis=1)).sum(axis=1), level[s])
            rss[s] = np.where(better, r[row, k], rss[s])
            amps[s] = np.where(better[:, None], a, amps[s])
            tt[s] = np.where(better[:, None], np.take_along_axis(taus[s], full[k], axis=1), tt[s])
    o = np.argsort(tt, axis=1)
    return rss, (sy - level) / n, np.take_along_axis(amps, o, 1), np.take_along_axis(tt, o, 1)


class _Exponentials:
    """Candidate columns of one pass for all requested orders: a lattice over each curve's span, or moves around its winners."""

    def __init__(self, orders, size: int | None = None, side=3):
        self.orders, self.size = list(orders), size
        if size:
            self.groups = {o: [list(range(size))] for o in self.orders}
            self.n_cols = size
            self.pairs = np.array([(i, j) for i in range(size) for j in range(i, size)])
        else:
            self.axis = np.arange(-side, side + 1) / (side + 1)
            self.shrink = 1.6 / (side + 1)
            width, pos, owner = len(self.axis), 0, []
            self.groups = {}
            for o in self.orders:
                self.groups[o] = [list(range(pos + g * width, pos + (g + 1) * width)) for g in range(o)]
                owner += [(o, g) for g in range(o) for _ in range(width)]
                pos += o * width
            self.n_cols = pos
            self.pairs = np.array([(i, j) for i in range(pos) for j in range(i, pos) if i == j or (owner[i][0] == owner[j][0] and owner[i] != owner[j])])
        self.plans = {o: _choices(self.groups[o], o) if size or o > 1 else [(np.array([[i] for i in self.groups[o][0]]),) * 2] for o in self.orders}
        self.winner = [*[f"_t{o}_{g}" for o in self.orders for g in range(o)], "_step"]
        self.carry = ["_lo", "_hi"] if size else self.winner

    def candidates(self, b: pd.DataFrame) -> np.ndarray:
        """From the shortest time of the curve to five times the longest, or around the winners."""
        if self.size:
            lo, hi = b["_lo"].to_numpy(float)[:, None], b["_hi"].to_numpy(float)[:, None]
            return lo * (5 * hi / lo) ** (np.arange(self.size) / (self.size - 1))
        mult = np.exp(b["_step"].to_numpy(float)[:, None] * self.axis)
        return np.concatenate([b[c].to_numpy(float)[:, None] * mult for c in self.winner[:-1]], axis=1)

    def next_step(self, b: pd.DataFrame) -> np.ndarray:
        if self.size:
            return np.log(5 * b["_hi"].to_numpy(float) / b["_lo"].to_numpy(float)) / (self.size - 1)
        return b["_step"].to_numpy(float) * self.shrink

    def columns(self, tt, b):
        return rise(tt[:, None], self.candidates(b))

    def as_pass(self, solve: Callable, schema: str) -> Pass:
        return Pass(self.columns, self.n_cols, self.pairs, solve, schema, self.carry, None, lambda rows: [self.candidates(rows)], rise)


def _exponential_pass(keys, types: str, ex: _Exponentials, max_amp) -> Pass:
    keys = list(keys)

    def solve(rows, n, sw, sy, syy, sx, sxy, sxx):
        out = rows[keys].copy()
        out["n"], out["sst"] = n.astype("int64"), syy - sy * sy / n
        g, taus = _gram(sxx, ex.pairs, ex.n_cols), ex.candidates(rows)
        for o in ex.orders:
            rss, base, amps, tt = _best_subset(ex.plans[o], o, taus, n, sy, syy, sx, sxy, g, max_amp)
            out[f"rss{o}"], out[f"base{o}"] = rss, base
            for i in range(o):
                out[f"_a{o}_{i}"], out[f"_t{o}_{i}"] = amps[:, i], tt[:, i]
        out["_step"] = ex.next_step(rows)
        yield out

    schema = f"{types}, n long, sst double"
    for o in ex.orders:
        schema += f", rss{o} double, base{o} double" + "".join(f", _a{o}_{i} double, _t{o}_{i} double" for i in range(o))
    return ex.as_pass(solve, schema + ", _step double")


def _name(o: int) -> str:
    return {1: "single", 2: "double", 3: "triple"}[o]


def _long_fits(wide: DataFrame, keys, orders) -> DataFrame:
    """One row per curve and order: ``model, n, p, rss, sst, baseline, amps, taus``."""
    rows = [
        F.struct(
            F.lit(_name(o)).alias("model"), F.lit(2 * o + 1).alias("p"), F.col(f"rss{o}").alias("rss"), F.col(f"base{o}").alias("baseline"),
            F.array(*[f"_a{o}_{i}" for i in range(o)]).alias("amps"), F.array(*[f"_t{o}_{i}" for i in range(o)]).alias("taus"),
        )
        for o in orders
    ]
    long = wide.select(*keys, "n", "sst", F.explode(F.array(*rows)).alias("f"))
    known = lambda c: F.when(F.col("f.rss") < np.inf, F.col(f"f.{c}")).alias(c)
    return long.select(*keys, "f.model", "n", "f.p", known("rss"), "sst", *[known(c) for c in ("baseline", "amps", "taus")])


def exponential_round(df, keys, orders=(1, 2, 3), t="t", y="y", max_amp=np.inf, size: int = 18) -> DataFrame:
    """First pass only, on the lattice of each curve; a curve without a fit keeps its rows, with NULL."""
    first = _exponential_pass(keys, _types(df, keys), _Exponentials(orders, size), max_amp)
    return _long_fits(fit_curves(df, keys, t, y, [], first, [], []), list(keys), orders)


def exponential_fits(
    df: DataFrame, keys: Sequence[str], orders: Sequence[int] = (1, 2, 3), t: str = "t", y: str = "y", rounds: int | None = None, max_amp: float = np.inf, side: int = 3,
) -> DataFrame:
    """Sums of one to three exponentials; all orders share every pass.  Amplitudes are within [0, max_amp] and a lattice from
    the curve's shortest time to five times its longest is searched before zooming.  A curve without a fit keeps its rows, with NULL."""
    keys = list(keys)
    first, near = _Exponentials(orders, 18), _Exponentials(orders, side=side)
    types = _types(df, keys)
    passes = _rounds(0.6, near.shrink, rounds)
    wide = fit_curves(df, keys, t, y, [], _exponential_pass(keys, types, first, max_amp), [_exponential_pass(keys, types, near, max_amp)] * passes, near.winner)
    return _long_fits(wide, keys, orders)


# ---- global fits: shared nonlinear parameters per group, own amplitude and offset per curve -----------------------------
def _global(df: DataFrame, group: list[str], keys: list[str], t: str, y: str, first: Pass, zooms: list[Pass], last: Pass, winner: list[str]) -> DataFrame:
    """The ``last`` pass of every curve with its group's ``winner`` columns, which pooled passes over all curves of the group have found.

    A group that is not above ``spark.rekurve.segmentRows`` comes to a task in one exchange, and all passes follow each other there.  The
    points of a larger one stay where they are: each pass adds up moments map-side, shuffles the sums of curves and then those of groups.
    """
    df = df.select(*keys, t, y)
    spark = df.sparkSession
    limit = int(spark.conf.get(SEGMENT_CONF, str(SEGMENT_ROWS)))
    large = cut_lineage(df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > limit))
    some = not large.isEmpty()
    usual = df.join(large, group, "left_anti") if some else df
    own = [f"_own{c}" for c in winner]
    schema = last.schema + "".join(f", {c} double" for c in own)

    def best(pooled: pd.DataFrame) -> pd.DataFrame:
        return pooled.sort_values(["rss", "i"], kind="stable").drop_duplicates(group)[[*group, *winner]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b, at in whole_groups(batches, group, LOCAL_ROWS):
            b, of = b.reset_index(drop=True), np.repeat(np.arange(len(at)), np.diff(np.r_[at, len(b)]))
            curves = group_starts(b, keys)
            lo, hi = _local_span(b[t].to_numpy(float), at)
            b = b.assign(_lo=lo[of], _hi=hi[of])
            names = b.iloc[at][group].reset_index(drop=True).assign(_of=np.arange(len(at)))
            for p in (first, *zooms):
                w = names.merge(best(_local_round(b, curves, t, y, p)), on=group).set_index("_of")
                b = b.assign(**{c: w[c].to_numpy()[of] for c in winner})
            yield _local_round(b, curves, t, y, last).assign(**{o: b[c].to_numpy()[curves] for o, c in zip(own, winner)})

    out = usual.repartition(*group).sortWithinPartitions(*keys).mapInPandas(run, schema)
    if some:
        rows = cut_lineage(df.join(large.drop("_n"), group, "left_semi"))

        def pooled(data: DataFrame, p: Pass) -> DataFrame:
            g = moment_round(data, keys, t, y, p).groupBy(*group, "i").agg(F.sum("rss").alias("rss"), *[F.first(c).alias(c) for c in winner])
            return cut_lineage(g.groupBy(*group).agg(F.min_by(F.struct(*winner), F.struct("rss", "i")).alias("w")).select(*group, "w.*"))

        win = pooled(rows.join(cut_lineage(curve_span(rows, group, t)), group), first)
        for p in zooms:
            win = pooled(rows.join(win, group), p)
        found = moment_round(rows.join(win, group), keys, t, y, last)
        out = out.unionByName(found.join(win.select(*group, *[F.col(c).alias(o) for c, o in zip(winner, own)]), group))
    return out


def global_profile_fit(df, group: Sequence[str], curve: Sequence[str], model: str, t="t", y="y", rounds: int | None = None, amp=(0.0, np.inf)) -> tuple[DataFrame, DataFrame]:
    """(group table: shared parameters, total rss; curve table: amplitude, baseline) (F22); candidates follow the group's span."""
    m = MODELS[model]
    group, keys, dims = list(group), [*group, *curve], len(m.log)
    ks, sts, points = [f"_k{j}" for j in range(dims)], [f"_st{j}" for j in range(dims)], 6 if dims == 1 else 3
    types, gtypes, shrink = _types(df, keys), _types(df, group), 1.5 / (points + 1)
    first = profile_pass(keys, m, types, amp=amp, pooled=group, pooled_types=gtypes)
    zoom = profile_pass(keys, m, types, amp=amp, axes=_axes(dims, points), shrink=shrink, pooled=group, pooled_types=gtypes)
    last = profile_pass(keys, m, types, amp=amp, axes=np.zeros((1, dims)))
    fits = cut_lineage(_global(df, group, keys, t, y, first, [zoom] * _rounds(0.4, shrink, rounds), last, [*ks, *sts]))
    fits = fits.withColumn("rss", F.when(F.col("rss") < np.inf, F.col("rss")).otherwise(F.col("sst")))  # a flat curve has no amplitude
    shared = [F.first(f"_own{k}").alias(f"p{j}") for j, k in enumerate(ks)]
    table = fits.groupBy(*group).agg(*shared, F.sum("n").alias("n"), F.sum("rss").alias("rss"), F.sum("sst").alias("sst"), F.count(F.lit(1)).alias("curves"))
    return table.withColumn("model", F.lit(model)).withColumn("p", 2 * F.col("curves") + dims), fits.drop(*[f"_own{c}" for c in (*ks, *sts)])


def global_exponential_fit(df, group: Sequence[str], curve: Sequence[str], order: int, t="t", y="y", rounds: int = 8, max_amp=np.inf, side: int = 3) -> tuple[DataFrame, DataFrame]:
    """Shared rates per group for a sum of ``order`` exponentials (F22): (group table, curve table)."""
    group, keys = list(group), [*group, *curve]
    cols = [f"_t{order}_{i}" for i in range(order)]

    def pooled(ex: _Exponentials) -> Pass:
        combos = np.array(list(itertools.combinations(range(ex.n_cols), order) if ex.size else itertools.product(*ex.groups[order])))

        def solve(rows, n, sw, sy, syy, sx, sxy, sxx):
            head, _, first = _sums_by_key(rows, group, np.zeros((len(rows), 0)))
            codes = pd.MultiIndex.from_frame(rows[group]).factorize()[0]
            tot = np.zeros((len(head), len(combos)))
            for lo in range(0, len(rows), SLICE_CURVES):  # a group's curves are many, and so are the combinations of each
                c = slice(lo, lo + SLICE_CURVES)
                g, best = _gram(sxx[c], ex.pairs, ex.n_cols), np.full((len(n[c]), len(combos)), np.inf)
                for s in range(1, order + 1):  # a curve may lack a component
                    for which in itertools.combinations(range(order), s):
                        best = np.minimum(best, solve_subsets(n[c], sy[c], syy[c], sx[c], sxy[c], g, combos[:, list(which)], max_amp)[1])
                best = np.where(np.isfinite(best), best, (syy[c] - sy[c] * sy[c] / n[c])[:, None])
                np.add.at(tot, codes[c], best)
            cand, step = ex.candidates(rows.iloc[first]), ex.next_step(rows.iloc[first])
            for i in range(len(head)):
                tt = cand[i][combos]
                yield pd.DataFrame({**{c: [head.iloc[i][c]] * len(combos) for c in group}, "i": range(len(combos)), "rss": tot[i], "_step": step[i], **{c: tt[:, j] for j, c in enumerate(cols)}})

        schema = _types(df, group) + ", i int, rss double, _step double" + "".join(f", {c} double" for c in cols)
        return ex.as_pass(solve, schema)

    last = _exponential_pass(keys, _types(df, keys), _Exponentials([order], side=0), max_amp)
    zooms = [pooled(_Exponentials([order], side=side))] * rounds
    wide = cut_lineage(_global(df, group, keys, t, y, pooled(_Exponentials([order], 14)), zooms, last, [*cols, "_step"]))
    fits = _long_fits(wide, keys, [order])
    shared = wide.groupBy(*group).agg(F.array_sort(F.array(*[F.first(f"_own{c}") for c in cols])).alias("taus"))
    tot = fits.groupBy(*group).agg(F.sum("n").alias("n"), F.sum(F.coalesce("rss", "sst")).alias("rss"), F.sum("sst").alias("sst"), F.count(F.lit(1)).alias("curves"))
    table = shared.join(tot, group)
    return table.withColumn("model", F.lit(_name(order))).withColumn("p", (order + 1) * F.col("curves") + order), fits


# ---- rate spectrum ------------------------------------------------------------------------------------------------------
def nonnegative(h: np.ndarray, c: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
    """The minimum of x h x / 2 - c x over x >= 0 for a positive definite ``h``, exactly: variables enter by the steepest
    gradient and leave where a step meets zero, until no gradient asks for more.  There is one minimum; a ``start`` near it
    (any x >= 0) only saves steps."""
    n = len(c)
    x = np.zeros(n) if start is None else start
    free = x > 0
    tol = 1e-12 * max(np.abs(c).max(), 1e-300)
    for turn in range(30 * n):
        if turn or not free.any():
            g = np.where(free, -np.inf, c - h @ x)
            k = int(g.argmax())
            if g[k] <= tol:
                break
            free[k] = True
        while free.any():
            new = np.zeros(n)
            new[free] = np.linalg.solve(h[np.ix_(free, free)], c[free])
            below = free & (new <= 0)
            if not below.any():
                x = new
                break
            part = x[below] / np.maximum(x[below] - new[below], 1e-300)
            x = x + part.min() * (new - x)
            gone = below & (x <= 1e-15 * max(np.abs(x).max(), 1e-300))
            free &= ~(gone if gone.any() else below)
            x[~free] = 0
    return x


def rate_spectrum(df: DataFrame, keys: Sequence[str], t="t", y="y", size: int = 24, alphas: Sequence[float] | None = None) -> DataFrame:
    """non-negative amplitudes on a logarithmic rate lattice with Tikhonov damping.

    The damping is the corner of the curve of log residual against log norm over ``alphas`` (largest distance from the
    chord).  Columns: ``alpha, rss, taus, weights, area, mean_rate, half_time``.
    """
    keys = list(keys)
    ex = _Exponentials([1], size)
    grid = np.array(alphas if alphas is not None else np.logspace(-8, 0, 20))

    def solve(rows, n, sw, sy, syy, sx, sxy, sxx):
        g = _gram(sxx, ex.pairs, ex.n_cols) - sx[:, :, None] * sx[:, None, :] / n[:, None, None]
        c, cyy = sxy - sx * (sy / n)[:, None], syy - sy * sy / n
        unit = np.maximum(np.trace(g, axis1=1, axis2=2) / ex.n_cols, 1e-300)
        gn, cn = g / unit[:, None, None], c / unit[:, None]
        sols, fits, norms, x = [], [], [], np.zeros_like(cn)
        for a in grid:
            x = np.array([nonnegative(gi + a * np.eye(ex.n_cols), ci, xi) for gi, ci, xi in zip(gn, cn, x)])  # the last one is near
            sols.append(x)
            fits.append(np.clip(cyy - 2 * (x * c).sum(1) + np.einsum("ci,cij,cj->c", x, g, x), 1e-300, None))
            norms.append(np.clip((x * x).sum(1), 1e-300, None))
        px, py = np.log(np.array(fits)), np.log(np.array(norms))
        px, py = ((v - v.min(0)) / np.maximum(v.max(0) - v.min(0), 1e-12) for v in (px, py))
        dx, dy = px[-1] - px[0], py[-1] - py[0]
        dist = np.abs(dy * (px - px[0]) - dx * (py - py[0]))
        pick, r = dist.argmax(axis=0), np.arange(len(rows))
        x, taus = np.array(sols)[pick, r], ex.candidates(rows)
        area = x.sum(1)
        safe = np.where(area > 0, area, 1.0)
        rate = (x / taus).sum(1) / safe
        out = rows[keys].copy()
        out["alpha"], out["rss"] = grid[pick], np.array(fits)[pick, r]
        out["taus"], out["weights"] = list(taus), list(x)
        out["area"], out["mean_rate"] = area, np.where(area > 0, rate, np.nan)
        out["half_time"] = np.where(rate > 0, np.log(2) / np.where(rate > 0, rate, 1.0), np.nan)
        yield out

    schema = _types(df, keys) + ", alpha double, rss double, taus array<double>, weights array<double>, area double, mean_rate double, half_time double"
    return fit_curves(df, keys, t, y, [], ex.as_pass(solve, schema), [], [])


def spectrum_peaks(spec: DataFrame, keys: Sequence[str], floor: float = 0.01) -> DataFrame:
    """T4: local maxima of the weights above ``floor`` of the area, largest first."""
    at = "filter(transform(weights, (w, i) -> named_struct('w', w, 'tau', taus[i], 'prev', coalesce(get(weights, i - 1), 0D), 'next', coalesce(get(weights, i + 1), 0D))), s -> s.w > s.prev and s.w >= s.next and s.w > {f} * area)"
    p = spec.select(*keys, F.expr(at.replace("{f}", repr(floor))).alias("p"))
    return p.select(*keys, F.posexplode(F.expr("reverse(array_sort(transform(p, s -> named_struct('weight', s.w, 'tau', s.tau))))")).alias("peak_rank", "s")).select(*keys, "peak_rank", "s.weight", "s.tau")
