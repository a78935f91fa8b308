"""Intervals of fitted parameters for every model (F14, F15), from sums of Jacobian products."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from rekurve.functions import tails
from rekurve.functions.basis import MODELS
from rekurve.operators import fit
from rekurve.plans.session import cut_lineage

SUMS = {"single": 1, "double": 2, "triple": 3}
#: Step of a derivative relative to its parameter; a matrix with a larger condition number says nothing about single parameters.
STEP, WORST = 1e-5, 1e14


def _names(model: str) -> list[str]:
    if model in SUMS:
        k = SUMS[model]
        return ["baseline"] + [f"{p}{i + 1}" if k > 1 else p for i in range(k) for p in ("amp", "tau")]
    return ["baseline", "amp"] + [f"p{j}" for j in range(len(MODELS[model].log))]


def _columns(model: str, t: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Derivatives of the model by each of its parameters; a row of ``p`` for every time."""
    if model in SUMS:
        out = [np.ones_like(t)]
        for i in range(SUMS[model]):
            amp, tau = p[:, 1 + 2 * i], p[:, 2 + 2 * i]
            e = np.exp(-t / tau)
            out += [1 - e, -amp * e * t / (tau * tau)]
        return np.stack(out, 1)
    m, k = MODELS[model], p[:, 2:].T
    out = [np.ones_like(t), m.basis(t, *k)]
    for j in range(len(k)):
        h = STEP * np.maximum(np.abs(k[j]), 1e-12)
        up, down = k.copy(), k.copy()
        up[j], down[j] = k[j] + h, k[j] - h
        out.append(p[:, 1] * (m.basis(t, *up) - m.basis(t, *down)) / (2 * h))
    return np.stack(out, 1)


def covariances(products: np.ndarray, rss: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Covariance of the parameters of each curve from its normal matrix; NaN where the data don't determine all of them."""
    size = products.shape[1]
    scale = np.sqrt(np.einsum("cii->ci", products))
    fine = np.isfinite(products).all((1, 2)) & (scale > 0).all(1) & (n > size) & np.isfinite(rss)
    scale = np.where(fine[:, None], scale, 1.0)
    unit = np.where(fine[:, None, None], products / (scale[:, :, None] * scale[:, None, :]), np.eye(size))
    low = np.linalg.eigvalsh(unit)
    fine &= low[:, 0] > low[:, -1] / WORST
    unit = np.where(fine[:, None, None], unit, np.eye(size))
    root = np.linalg.inv(np.linalg.cholesky(unit))
    cov = np.einsum("cki,ckj->cij", root, root) / (scale[:, :, None] * scale[:, None, :])
    return np.where(fine[:, None, None], cov * (rss / np.maximum(n - size, 1))[:, None, None], np.nan)


def parameter_intervals(
    rows: DataFrame, fits: DataFrame, keys: Sequence[str], model: str, t: str = "t", y: str = "y", level: float = 0.95, quantile: str = "normal", w: float = 1.0
) -> DataFrame:
    """``*keys, model, parameter, estimate, se, lo, hi, reason``: a row for each parameter of each curve that ``fits`` has with ``model``.

    ``fits`` comes from ``fit.exponential_fits`` (``baseline, amps, taus``) or ``fit.profile_fit`` (``baseline, amp, p0[, p1]``), with
    ``rss`` and ``n``.  Besides the model's own parameters there is ``amp_total``, whose variance has the covariances of the amplitudes, and
    for each time constant a diffusion coefficient ``w * w / (4 tau)`` (``d``), whose ends are those of the time constant swapped; it has no
    interval where that of the time constant reaches zero.  ``quantile`` is ``normal`` or ``t`` with n - p degrees of freedom.

    A curve without a fit, or whose points don't determine all parameters (as many parameters as points, an amplitude of zero, two equal
    rates), keeps its rows with NULL for what can't be known and a ``reason``.  Products are summed where the rows lie and combined, so one
    curve may be as long as it likes.
    """
    keys, names = list(keys), _names(model)
    size = len(names)
    if model in SUMS:
        amps = [F.get(c, F.lit(i)) for i in range(SUMS[model]) for c in ("amps", "taus")]
        found = F.array("baseline", *amps)
    else:
        found = F.array("baseline", "amp", *[f"p{j}" for j in range(size - 2)])
    own = fits.filter(F.col("model") == model)
    known = F.col("rss").isNotNull() & F.forall("_p", lambda v: v.isNotNull())
    own = cut_lineage(own.withColumn("_p", found).select(*keys, "n", F.when(known, F.col("rss")).alias("rss"), F.when(known, F.col("_p")).alias("_p")))
    j = rows.select(*keys, t, y).join(own.filter("rss is not null"), keys)
    pairs = np.array([(a, b) for a in range(size) for b in range(a, size)])

    def columns(tt, b):
        return _columns(model, tt, np.array(b["_p"].tolist(), float).reshape(len(b), size))

    def solve(head, n, sw, sy, syy, sx, sxy, sxx):
        g = np.zeros((len(head), size, size))
        g[:, pairs[:, 0], pairs[:, 1]] = sxx
        g[:, pairs[:, 1], pairs[:, 0]] = sxx
        cov = covariances(g, head["rss"].to_numpy(float), n)
        yield head[keys].assign(_cov=list(cov.reshape(len(head), -1)))

    carried = ["_p", "rss"]
    p = fit.Pass(columns, size, pairs, solve, fit._types(rows, keys) + ", _cov array<double>", carried)
    cov = fit.moment_round(j, keys, t, y, p)
    at = {n: i for i, n in enumerate(names)}
    z = float(tails.norm_ppf(0.5 + level / 2))

    def finished(batches):
        for b in batches:
            out = []
            free, at_n = np.unique(np.maximum(b["n"].to_numpy(int) - size, 1), return_inverse=True)
            ends = (tails.t_quantile(0.5 + level / 2, free) if quantile == "t" else np.full(len(free), z))[at_n]
            for q, *key, est, c in b[[*keys, "_p", "_cov"]].assign(_q=ends)[["_q", *keys, "_p", "_cov"]].itertuples(index=False, name=None):
                est = np.full(size, np.nan) if est is None else np.array(est, float)
                c = np.full((size, size), np.nan) if c is None else np.array(c, float).reshape(size, size)
                why = "no fit" if np.isnan(est).any() else "not determined" if not np.isfinite(c).all() else None
                se = np.sqrt(np.maximum(np.diag(c), 0))
                lines = [(name, est[i], se[i], est[i] - q * se[i], est[i] + q * se[i], why) for name, i in at.items()]
                amps = [i for name, i in at.items() if name.startswith("amp")]
                total = float(np.sqrt(max(c[np.ix_(amps, amps)].sum(), 0))) if why is None else np.nan
                lines.append(("amp_total", est[amps].sum(), total, est[amps].sum() - q * total, est[amps].sum() + q * total, why))
                for name, v, s, lo, hi, _ in lines[:size]:
                    if name.startswith("tau") or (name == "p0" and model.startswith("soumpasis")):
                        d = "d" + (name[3:] if name.startswith("tau") else "")
                        both = lo > 0 and hi > 0
                        lines.append((d, w * w / (4 * v), w * w * s / (4 * v * v), w * w / (4 * hi) if both else np.nan, w * w / (4 * lo) if both else np.nan, why or (None if both else "time constant reaches zero")))
                out += [(*key, model, *line) for line in lines]
            yield pd.DataFrame(out, columns=[*keys, "model", "parameter", "estimate", "se", "lo", "hi", "reason"])

    schema = fit._types(fits, keys) + ", model string, parameter string, estimate double, se double, lo double, hi double, reason string"
    out = own.join(cov, keys, "left").select(*keys, "n", "_p", "_cov").mapInPandas(finished, schema)
    clean = [F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("estimate", "se", "lo", "hi")]
    return out.select(*keys, "model", "parameter", *clean, "reason")
