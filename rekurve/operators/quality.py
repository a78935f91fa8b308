"""Filters, checks and labels on fit and feature rows (P1-P21, F17, F28-F30 labels, A6, A25, X15)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rekurve.operators.ordered import quantiles


def reasons(*pairs: tuple[Column, str]) -> Column:
    """Texts of all conditions that hold, joined by '; '."""
    return F.concat_ws("; ", *[F.when(c, t) for c, t in pairs])


def notes(*pairs: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(c, t) for c, t in pairs]))


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf"))


def threshold_report(df: DataFrame, col: str, limit: float, by: list[str]) -> DataFrame:
    kept = F.count(F.when(F.col(col) >= limit, 1))
    return df.groupBy(*by).agg(kept.alias("kept"), (F.count(F.lit(1)) - kept).alias("removed"))


def prefit_check(df: DataFrame, keys: list[str], cols: list[str], min_points: int = 10) -> DataFrame:
    bad = [F.max((~finite(F.col(c))).cast("int")).alias(f"_{c}") for c in cols]
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *bad)
    why = reasons((F.col("n") < min_points, "too few points"), *[(F.col(f"_{c}") == 1, f"missing values in {c}") for c in cols])
    return g.select(*keys, "n", (why == "").alias("ok"), why.alias("reason"))


def fit_check(r2: Column, lo: Column, hi: Column, min_r2: float = 0.8) -> Column:
    return reasons((r2 < min_r2, "low r2"), (~finite(lo) | ~finite(hi), "interval not finite"))


#: The sentences of fit notes.
FIT_NOTES = ["Fit did not converge.", "R-squared < 0.95.", "tau_s is shorter than frame interval.", "mobile_fraction is outside (0, 1]."]


def fit_notes(converged: Column, r2: Column, tau: Column, dt: Column, mobile: Column) -> Column:
    doubts = [~converged, r2 < 0.95, tau < dt, (mobile <= 0) | (mobile > 1)]
    return notes(*zip(doubts, FIT_NOTES))


def clamp_results(df: DataFrame, mobile: str = "mobile_fraction") -> DataFrame:
    """Mobile fraction into [0, 100], its complement, and NULL for non-positive rates and half-times."""
    m = F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.col(mobile)))
    cols = {mobile: m, "immobile_fraction": 100.0 - m}
    for c in df.columns:
        if "rate_constant" in c or "half_time" in c:
            cols[c] = F.when(F.col(c) > 0, F.col(c))
    return df.withColumns(cols)


def proportions_ok(*parts: Column) -> Column:
    total = sum((F.coalesce(p, F.lit(0.0)) for p in parts), F.lit(0.0))
    return F.abs(total - 100.0) <= 5.0


def recovery_flags(mobile: Column, plateau_reached: Column) -> Column:
    """Diagnostics of a mobile percentage."""
    return notes(
        (mobile > 100, "over_recovery"), ((mobile <= 100) & (mobile > 95), "very_high_mobile"), (mobile < 10, "very_low_mobile"),
        (~plateau_reached, "plateau_not_reached"),
    )


def biological_rejection(mobile: Column) -> Column:
    return F.when(mobile > 200, "impossible: above 200 %").when(mobile > 100, "above 100 %").when(mobile < 0, "negative")


def size_category(mw: Column) -> Column:
    return F.when(mw < 30, "small").when(mw < 80, "medium").when(mw < 150, "large").otherwise("very_large")


def mobility_category(d: Column) -> Column:
    return F.when(d.isNull(), "unknown").when(d > 10, "fast").when(d > 1, "medium").when(d > 0.1, "slow").otherwise("very_slow")


def diffusion_type(beta: Column) -> Column:
    """Bins of an anomalous exponent at 0.5, 0.9 and 1.1."""
    return F.when(beta < 0.5, "strongly_subdiffusive").when(beta < 0.9, "subdiffusive").when(beta <= 1.1, "normal").otherwise("superdiffusive")


def logit(x: Column, eps: float = 1e-8) -> Column:
    c = F.least(F.greatest(x, F.lit(eps)), F.lit(1.0 - eps))
    return F.ln(c / (1.0 - c))


def inverse_logit(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def softplus(x: Column) -> Column:
    return F.log1p(F.exp(-F.abs(x))) + F.greatest(x, F.lit(0.0))


def ordered_rates(k_slow: Column, delta: Column) -> tuple[Column, Column]:
    return k_slow, k_slow + F.greatest(delta, F.lit(1e-12))


def data_quality(df: DataFrame, required: list[str], qc: str, r2: str, drift: str, with_traces: Column) -> DataFrame:
    """Messages with a severity, from one aggregation."""
    g = df.agg(
        F.count(F.lit(1)).alias("n"), *[F.count(F.when(F.col(c).isNull(), 1)).alias(f"null_{c}") for c in required],
        F.avg(F.col(qc).cast("double")).alias("pass"), F.count(F.when(F.col(drift) > 10, 1)).alias("drift"),
        F.count(F.when(with_traces, 1)).alias("traced"),
    )
    g = g.crossJoin(F.broadcast(quantiles(df, [], r2, [0.5]).select(F.col("q")[0].alias("med"))))  # one row each
    rows = [F.struct(F.lit("nulls_" + c).alias("check"), F.when(F.col(f"null_{c}") > 0, "warning").otherwise("info").alias("severity"), F.col(f"null_{c}").cast("double").alias("amount")) for c in required]
    rows += [
        F.struct(F.lit("qc_pass_rate").alias("check"), F.when(F.col("pass") < 0.5, "warning").otherwise("info").alias("severity"), F.col("pass").alias("amount")),
        F.struct(F.lit("median_r2").alias("check"), F.when(F.col("med") < 0.7, "warning").otherwise("info").alias("severity"), F.col("med").alias("amount")),
        F.struct(F.lit("high_drift").alias("check"), F.when(F.col("drift") > F.col("n") * 0.2, "warning").otherwise("info").alias("severity"), F.col("drift").cast("double").alias("amount")),
        F.struct(F.lit("cells_with_traces").alias("check"), F.when(F.col("traced") < F.col("n"), "warning").otherwise("info").alias("severity"), F.col("traced").cast("double").alias("amount")),
    ]
    return g.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def shift_label(diffusion_shift: Column, binding_shift: Column, fold: Column) -> Column:
    """Rule-based reading of two group summaries."""
    return (
        F.when(binding_shift < -15, "lost binding").when(binding_shift > 15, "enhanced binding").when(diffusion_shift > 20, "predominantly diffusive")
        .when(fold > 1.5, "faster kinetics").when(fold < 0.67, "slower kinetics").otherwise("no major change")
    )


def mean_curve_labels(mobile=None, beta=None, bound=None, kon_fold=None, koff_fold=None) -> Column:
    """Labels for a difference of two mean-curve fits; pass the differences or fold changes that exist."""
    pairs = []
    if beta is not None:
        pairs += [(beta < -0.1, "more hindered"), (beta > 0.1, "less hindered"), (beta < -0.15, "increased subdiffusion"), (beta > 0.15, "decreased subdiffusion")]
    if bound is not None:
        pairs += [(bound < -10, "reduced binding"), (bound > 10, "enhanced binding"), (bound < -15, "loss of binding"), (bound > 15, "stronger association")]
    for fold, what in ((kon_fold, "association"), (koff_fold, "dissociation")):
        if fold is not None:
            pairs += [(fold < 0.5, f"slower {what}"), (fold > 2.0, f"faster {what}")]
    if mobile is not None:
        pairs += [(mobile > 10, "increased mobility"), (mobile < -10, "decreased mobility")]
    return notes(*pairs)


def effect_label(d: Column, cuts=(0.2, 0.5, 0.8)) -> Column:
    a = F.abs(d)
    return F.when(a < cuts[0], "negligible").when(a < cuts[1], "small").when(a < cuts[2], "medium").otherwise("large")


def delta_aic_bucket(delta: Column) -> Column:
    """F17; rounded because differences of exactly 4 are common (equal residuals, two more parameters).  NULL if no model can be judged."""
    delta = F.round(delta, 6)
    # fixed values: the four labels
    label = F.when(delta < 2, "substantial support").when((delta >= 4) & (delta <= 7), "considerably less support").when(delta > 10, "essentially no support").otherwise("moderate support")
    return F.when(delta.isNotNull() & ~F.isnan(delta), label)


def mobile_fraction(i0: Column, i_inf: Column, pre: Column) -> Column:
    """share of the bleached depth that came back, in [0, 1]; NULL for a flat curve."""
    span = pre - i0
    return F.when(F.abs(span) >= 1e-10, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (i_inf - i0) / span)))


def interpret_rate(k: Column, radius: float, ref_d: float = 25.0, ref_mw: float = 27.0) -> dict[str, Column]:
    """a rate read as binding and as diffusion; NULL for non-positive rates."""
    d = radius * radius * k / 4.0
    pos = lambda c: F.when(k > 0, c)
    half = F.lit(0.6931471805599453) / k
    return {
        "k_off": pos(k), "diffusion_coefficient": pos(d), "apparent_mw": pos(ref_mw * F.pow(ref_d / d, 3)), "half_time_diffusion": pos(half),
        "half_time_binding": pos(half),
    }


def effective_diffusion(d: Column, k_on: Column, k_off: Column) -> Column:
    """M14."""
    return d / (1 + k_on / k_off)
