"""Per-curve summaries computed from ordered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rekurve.operators.bleach import earliest_min
from rekurve.operators.ordered import attach, quantiles, windowed

KEY = ["curve_id"]


def if_(cond: Column, value) -> Column:
    return F.when(cond, F.col(value) if isinstance(value, str) else value)


def closest(value: Column, target: Column, frame: Column, cond: Column) -> Column:
    """Aggregate: first frame whose value is nearest the target."""
    return F.min_by(frame, F.when(cond, F.struct(F.abs(value - target), frame)))


def terminal_slope(df: DataFrame, min_points: int = 10, window: float = 0.4, slope_limit: float = -0.001, r2_limit: float = 0.7) -> DataFrame:
    """Line through the last part of the recovery and what to do with the curve."""
    b = attach(df, KEY, b=earliest_min(F.col("y"), F.col("frame"), F.struct("frame", "t")), n=F.count(F.lit(1)), t_end=F.max_by("t", "frame"))
    rec = F.col("frame") >= F.col("b.frame")
    rt = F.col("t") - F.col("b.t")
    w0 = (F.col("t_end") - F.col("b.t")) * (1 - window)
    d = attach(b.withColumn("rt", rt).withColumn("w0", w0), KEY, start=closest(F.col("rt"), F.col("w0"), F.col("frame"), rec))
    tail = F.col("frame") >= F.col("start")
    g = d.groupBy(*KEY).agg(
        F.first("n").alias("n"), F.first("b.frame").alias("bleach"), F.count(if_(tail, "t")).alias("points"),
        F.regr_slope(if_(tail, "y"), if_(tail, "rt")).alias("slope"), F.regr_r2(if_(tail, "y"), if_(tail, "rt")).alias("r2"),
    )
    short, none, few = F.col("n") < min_points, F.col("bleach") >= F.col("n") - min_points, F.col("points") < 3
    slope, r2 = F.coalesce("slope", F.lit(0.0)), F.coalesce("r2", F.lit(0.0))
    bad = short | none | few
    down = ~bad & (slope < slope_limit) & (r2 > r2_limit)
    rec_ = (
        F.when(short, "insufficient_data").when(none, "no_recovery_data").when(few, "insufficient_analysis_points")
        .when(down & (slope < slope_limit * 3), "exclude_strong").when(down & (r2 > 0.9), "exclude_confident").when(down, "exclude_moderate")
        .when(slope > 0, "include_good").when(F.abs(slope) < abs(slope_limit) / 2, "include_stable").otherwise("review_manual")
    )
    conf = F.when(bad, 0.0).otherwise(F.least(F.lit(1.0), F.when(slope < 0, -slope).otherwise(0.0) / abs(slope_limit) * r2))
    return g.select(
        *KEY, "points", F.when(bad, 0.0).otherwise(slope).alias("slope"), F.when(bad, 0.0).otherwise(r2).alias("r2"),
        down.alias("downward"), conf.alias("confidence"), rec_.alias("recommendation"),
    )


def recruitment(df: DataFrame, baseline_frames: int = 3) -> DataFrame:
    """A10: rise over the mean of the first frames, first time at half maximum, trapezoid area."""
    d = attach(df, KEY, base=F.avg(if_(F.col("frame") < baseline_frames, "y")), hi=F.max("y"))
    d = windowed(d, KEY, lambda w: {"area": (F.col("t") - F.lag("t").over(w)) * (F.col("y") + F.lag("y").over(w) - 2 * F.col("base")) / 2})
    half = F.col("base") + (F.col("hi") - F.col("base")) / 2
    return d.groupBy(*KEY).agg(
        F.first("hi").alias("max_intensity"), F.first("base").alias("baseline"),
        (F.max("hi") / F.max(if_(F.col("base") > 0, "base"))).alias("fold_increase"),
        F.min_by("t", F.when(F.col("y") >= half, F.col("frame"))).alias("time_to_half_max"),
        F.sum("area").alias("total_recruitment"), (F.max("hi") - F.max("base")).alias("amplitude"),
    )


def shape_features(df: DataFrame) -> DataFrame:
    """Twelve curve-shape features."""
    d = windowed(df, KEY, lambda w: {"d2": F.col("y") - 2 * F.lag("y", 1).over(w) + F.lag("y", 2).over(w)}, before=2)
    d = attach(
        d, KEY, b=earliest_min(F.col("y"), F.col("frame"), F.struct("frame", "t")), n=F.count(F.lit(1)), lo=F.min("y"),
    )
    m = F.col("n") - F.col("b.frame")
    rec = F.col("frame") >= F.col("b.frame")
    last5 = rec & (F.col("frame") >= F.col("n") - F.when(m >= 5, 5).otherwise(1))
    d = attach(d, KEY, fin=F.avg(if_(last5, "y")))
    half = F.col("lo") + 0.5 * (F.col("fin") - F.col("lo"))
    pre, early = F.col("frame") < F.col("b.frame"), rec & (F.col("frame") < F.col("b.frame") + 5)
    g = d.groupBy(*KEY).agg(
        F.first("b").alias("b"), F.first("n").alias("n"), F.min("y").alias("lo"), F.max("y").alias("hi"),
        F.max(if_(F.col("frame") == 0, "y")).alias("first"), F.avg(if_(pre, "y")).alias("pm"), F.stddev_pop(if_(pre, "y")).alias("psd"),
        F.regr_slope(if_(pre, "y"), if_(pre, "t")).alias("ptrend"), F.regr_slope(if_(early, "y"), if_(early, "t")).alias("early"),
        F.first("fin").alias("fin"), F.min_by("t", F.when(rec, F.struct(F.abs(F.col("y") - half), F.col("frame")))).alias("t_half"),
        F.stddev_pop("d2").alias("rough"), F.min("t").alias("t0"), F.max("t").alias("t1"),
    )
    has_rec, has_pre = F.col("b.frame") < F.col("n") - 1, F.col("b.frame") > 0
    pm = F.coalesce("pm", "first")
    total = F.col("t1") - F.col("t0")
    return g.select(
        *KEY, F.col("lo").alias("min_intensity"), F.col("hi").alias("max_intensity"), (F.col("hi") - F.col("lo")).alias("range"),
        pm.alias("pre_mean"), F.coalesce("psd", F.lit(0.0)).alias("pre_sd"), F.coalesce("ptrend", F.lit(0.0)).alias("pre_trend"),
        F.when(F.col("n") - F.col("b.frame") > 5, F.col("early")).otherwise(0.0).alias("early_rate"),
        F.when(has_rec, F.col("fin")).otherwise(F.col("lo")).alias("final_mean"),
        F.when(has_rec & (pm != F.col("lo")), F.try_divide(F.col("fin") - F.col("lo"), pm - F.col("lo"))).otherwise(0.0).alias("recovery_fraction"),
        F.when(has_rec, F.col("t_half") - F.col("b.t")).alias("time_to_half"),
        F.when(F.col("n") > 4, F.col("rough")).otherwise(0.0).alias("roughness"),
        F.when(has_rec & has_pre & (total > 0), (F.col("b.t") - F.col("t0")) / total).otherwise(0.5).alias("asymmetry"),
    )


def quality_features(df: DataFrame) -> DataFrame:
    """Signal quality and sampling regularity."""
    d = windowed(df, KEY, lambda w: {"dt": F.col("t") - F.lag("t").over(w)})
    d = attach(d, KEY, bleach=earliest_min(F.col("y"), F.col("frame")))
    pre = F.col("frame") < F.col("bleach")
    base = F.when(F.col("bleach") > 5, pre).otherwise(F.col("frame") < 5)
    null = F.col("y").isNull() | F.isnan("y")
    g = d.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n_points"), F.avg("y").alias("m"), F.stddev_pop("y").alias("s"), F.avg(if_(pre, "y")).alias("pm"),
        F.min("y").alias("lo"), F.max("y").alias("hi"), F.avg(null.cast("double")).alias("null_share"), F.stddev_pop("dt").alias("sdt"),
        F.avg("dt").alias("mean_dt"), F.var_pop(if_(base, "y")).alias("baseline_variance"), (F.max("t") - F.min("t")).alias("duration"),
    )
    return g.select(
        *KEY, F.when(F.col("n_points") > 10, F.try_divide("m", "s")).otherwise(1.0).alias("snr"),
        F.when(F.col("pm") > 0, (F.col("pm") - F.col("lo")) / F.col("pm")).otherwise(0.0).alias("bleach_efficiency"), "null_share",
        F.when(F.col("mean_dt") > 0, F.col("sdt") / F.col("mean_dt")).alias("sampling_regularity"), (F.col("hi") - F.col("lo")).alias("intensity_range"),
        F.when(F.col("m") > 0, (F.col("hi") - F.col("lo")) / F.col("m")).otherwise(0.0).alias("dynamic_range"), "baseline_variance", "n_points",
        "mean_dt", "duration",
    )


def statistical_features(df: DataFrame) -> DataFrame:
    """Moments, adjusted shape measures, quartiles, lag-one correlation and trend."""
    d = windowed(df, KEY, lambda w: {"y1": F.lag("y").over(w)})
    g = d.groupBy(*KEY).agg(
        F.count("y").alias("n"), F.avg("y").alias("mean"), F.stddev_pop("y").alias("sd"), F.skewness("y").alias("sk"),
        F.kurtosis("y").alias("ku"), F.corr("y1", "y").alias("ac"), F.regr_slope("y", "t").alias("trend"),
    )
    n, k4 = F.col("n"), F.col("ku") + 3
    q = quantiles(df, KEY, "y", [0.25, 0.5, 0.75])
    return g.join(q, KEY, "left").select(
        *KEY, "mean", "sd", F.when((n >= 3) & (F.col("sd") > 0), F.try_divide(n * n * F.col("sk"), (n - 1) * (n - 2))).otherwise(0.0).alias("skew"),
        F.when((n >= 4) & (F.col("sd") > 0), F.try_divide((n + 1) * (n - 1) * k4 - 3 * (n - 1) * (n - 1), (n - 2) * (n - 3))).otherwise(0.0).alias("kurt"),
        F.col("q")[0].alias("q25"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q75"), (F.col("q")[2] - F.col("q")[0]).alias("iqr"),
        F.when(n > 10, F.col("ac")).otherwise(0.0).alias("autocorr"), "trend",
    )


def residual_diagnostics(df: DataFrame, y: str, fitted: str) -> DataFrame:
    """Residual size, bias and serial correlation; Durbin-Watson is 2 for a perfect fit."""
    d = df.withColumn("res", F.col(y) - F.col(fitted))
    d = windowed(d, KEY, lambda w: {"dres": F.col("res") - F.lag("res").over(w)})
    ss = F.sum(F.col("res") * F.col("res"))
    return d.groupBy(*KEY).agg(
        F.sqrt(F.avg(F.col("res") * F.col("res"))).alias("rmse"), F.max(F.abs("res")).alias("max_abs"),
        F.coalesce(F.try_divide(F.sum(F.col("dres") * F.col("dres")), ss), F.lit(2.0)).alias("durbin_watson"),
        (F.avg(F.abs(F.col("res") / (F.col(y) + 1e-10))) * 100).alias("mape"), F.avg("res").alias("mean_res"), F.stddev_pop("res").alias("sd_res"),
    )


def half_time_summary(df: DataFrame) -> DataFrame:
    """First time at or above halfway between the first value and the mean of the last five."""
    d = attach(df, KEY, n=F.count(F.lit(1)), y0=F.max(if_(F.col("frame") == 0, "y")))
    d = attach(d, KEY, yinf=F.avg(if_(F.col("frame") >= F.col("n") - 5, "y")))
    target = F.col("y0") + 0.5 * (F.col("yinf") - F.col("y0"))
    return d.groupBy(*KEY).agg(F.first("yinf").alias("plateau"), F.min_by("t", F.when(F.col("y") >= target, F.col("frame"))).alias("t_half"))


def downsample(df: DataFrame, points: int = 300) -> DataFrame:
    """The frames at the truncated positions of an even grid from first to last; all frames of shorter curves."""
    d = attach(df, KEY, n=F.count(F.lit(1)))
    step = (F.col("n") - 1) / F.lit(points - 1)
    j = F.ceil(F.col("frame") / step - 1e-9)
    hit = (j < points) & (F.floor(j * step + 1e-9) == F.col("frame"))
    return d.filter((F.col("n") <= points) | hit).drop("n")


def motion_flags(df: DataFrame, keys=("track_id",), threshold_px: float = 5.0, multiple: float = 5.0) -> DataFrame:
    """Steps above max(median + 5 MAD, threshold) per track."""
    keys = list(keys)
    d = windowed(df, keys, lambda w: {"step": F.sqrt(F.pow(F.col("x") - F.lag("x").over(w), 2) + F.pow(F.col("y") - F.lag("y").over(w), 2))})
    med = quantiles(d, keys, "step", [0.5]).select(*keys, F.col("q")[0].alias("med"))
    d = d.join(med, keys)
    mad = quantiles(d.withColumn("dev", F.abs(F.col("step") - F.col("med"))), keys, "dev", [0.5]).select(*keys, F.col("q")[0].alias("mad"))
    d = d.join(mad, keys)
    limit = F.greatest(F.col("med") + multiple * F.col("mad"), F.lit(threshold_px))
    return d.withColumn("artifact", F.coalesce(F.col("step") > limit, F.lit(False)))


def drift(df: DataFrame, keys=("track_id",)) -> DataFrame:
    """Distance between the first and last position."""
    a, z = F.min_by(F.struct("x", "y"), "frame").alias("a"), F.max_by(F.struct("x", "y"), "frame").alias("z")
    g = df.groupBy(*keys).agg(a, z)
    return g.select(*keys, F.sqrt(F.pow(F.col("z.x") - F.col("a.x"), 2) + F.pow(F.col("z.y") - F.col("a.y"), 2)).alias("drift"))


def clean_trace(df: DataFrame, t: str = "t", y: str = "y", min_points: int = 5) -> DataFrame:
    """Finite pairs only, and only curves that keep at least ``min_points``."""
    ok = df.filter(F.col(t).isNotNull() & F.col(y).isNotNull() & ~F.isnan(t) & ~F.isnan(y) & (F.abs(F.col(t)) < float("inf")) & (F.abs(F.col(y)) < float("inf")))
    return attach(ok, KEY, _n=F.count(F.lit(1))).filter(F.col("_n") >= min_points).drop("_n")


def choose_signal(df: DataFrame, primary: str, fallback: str, out: str = "intensity") -> DataFrame:
    """Primary if enough finite values, else fallback, else the curve is dropped."""
    good = lambda c: F.count(F.when(F.col(c).isNotNull() & ~F.isnan(c), 1))
    d = attach(df, KEY, _p=good(primary), _f=good(fallback), _n=F.count(F.lit(1)))
    use_p = F.col("_p") >= F.greatest(F.lit(4), F.floor(F.col("_n") / 2))
    d = d.withColumn("source", F.when(use_p, primary).when(F.col("_f") >= 4, fallback)).filter("source is not null")
    return d.withColumn(out, F.when(F.col("source") == primary, F.col(primary)).otherwise(F.col(fallback))).drop("_p", "_f", "_n")
