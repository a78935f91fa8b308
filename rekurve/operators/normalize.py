"""Normalization of recordings (N1-N11, N22-N27).  Invalid curves get ``norm_error`` and NULL values, never an exception."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rekurve.operators.bleach import earliest_min
from rekurve.operators.ordered import attach, fill_forward, windowed

KEY = ["curve_id"]


def pre_mean(df: DataFrame, *signals: str, time: str = "t") -> DataFrame:
    """Add ``pre_<signal>``: mean at negative times, else of the first max(3, 10 %) frames."""
    d = attach(df, KEY, n=F.count(F.lit(1)))
    head = F.col("frame") < F.greatest(F.lit(3), F.floor(0.1 * F.col("n")))
    negative = lambda s: F.avg(F.when(F.col(time) < 0, F.col(s)))
    early = lambda s: F.avg(F.when(head, F.col(s)))
    return attach(d, KEY, **{f"pre_{s}": lambda o, s=s: F.coalesce(o(negative(s)), o(early(s))) for s in signals}).drop("n")


def normalize_simple(df: DataFrame, signal: str, background: float, time: str = "t") -> DataFrame:
    d = pre_mean(df, signal, time=time)
    first_post = F.min_by(F.col(signal), F.when(F.col(time) >= 0, F.col("frame")))
    bad = F.max(F.when(F.col(signal).isNull() | F.isnan(signal) | (F.abs(signal) == float("inf")), 1).otherwise(0))
    d = attach(d, KEY, fp=first_post, bad=bad)
    pre = F.col(f"pre_{signal}")
    d = d.withColumn(
        "norm_error",
        F.when(F.col("bad") == 1, "non-finite signal")
        .when(pre <= background, "pre-bleach not above background")
        .when((F.col("fp") - background) / (pre - background) > 0.85, "post-bleach above 85 % of pre-bleach"),
    )
    ok = F.col("norm_error").isNull()
    return d.withColumn("norm", F.when(ok, (F.col(signal) - background) / (pre - background))).drop("fp", "bad")


def normalize_double(df: DataFrame, roi: str, ref: str, time: str = "t") -> DataFrame:
    d = attach(pre_mean(df, roi, ref, time=time), KEY, ref_min=F.min(ref))
    proi, pref = F.col(f"pre_{roi}"), F.col(f"pre_{ref}")
    d = d.withColumn(
        "norm_error",
        F.when((proi <= 0) | (pref <= 0), "pre-bleach levels must be positive").when(F.col("ref_min") <= 0, "non-positive reference"),
    )
    return d.withColumn("norm", F.when(F.col("norm_error").isNull(), (F.col(roi) / F.col(ref)) / (proi / pref))).drop("ref_min")


def normalize_full_scale(df: DataFrame, signal: str, time: str = "t") -> DataFrame:
    d = attach(pre_mean(df, signal, time=time), KEY, post_min=F.min(F.when(F.col(time) >= 0, F.col(signal))))
    span = F.col(f"pre_{signal}") - F.col("post_min")
    d = d.withColumn("norm_error", F.when(F.col("post_min").isNull(), "no post-bleach frames").when(span <= 0, "pre-bleach must exceed post-bleach minimum"))
    return d.withColumn("norm", F.when(F.col("norm_error").isNull(), (F.col(signal) - F.col("post_min")) / span)).drop("post_min")


def normalize(df: DataFrame, mode: str, **kw) -> DataFrame:
    """Pick the plan by name; there is no default mode."""
    modes = {"simple": normalize_simple, "double": normalize_double, "full_scale": normalize_full_scale}
    if mode not in modes:
        raise ValueError(f"mode must be one of {sorted(modes)}")
    return modes[mode](df, **kw)


def three_region(df: DataFrame) -> DataFrame:
    """Background-corrected, reference-corrected recording plus per-curve levels."""
    d = df.withColumn("c1", F.col("roi1") - F.col("roi3")).withColumn("c2", F.col("roi2") - F.col("roi3"))
    d = attach(d, KEY, bleach=earliest_min(F.col("c1"), F.col("frame")), n=F.count(F.lit(1)))
    head = F.col("frame") < F.least(F.lit(5), F.greatest(F.lit(1), F.col("bleach")))
    start = F.least(F.col("bleach") + 1, F.col("n") - 1)
    after = (F.col("frame") >= start) & (F.col("frame") < start + 3)
    mean_if = lambda cond, c: F.avg(F.when(cond, F.col(c)))
    d = attach(
        d, KEY,
        pre1=mean_if(head, "c1"), pre2=mean_if(head, "c2"),
        post1=mean_if(after, "c1"), post2=mean_if(after, "c2"),
        f1=F.max(F.when(F.col("frame") == 0, F.col("c1"))), f2=F.max(F.when(F.col("frame") == 0, F.col("c2"))),
    )
    safe = lambda pre, first: F.when(F.col(pre) > 0, F.col(pre)).when(F.col(first) > 0, F.col(first)).otherwise(1.0)
    d = d.withColumn("pre1", safe("pre1", "f1")).withColumn("pre2", safe("pre2", "f2"))
    d = d.withColumn("post2", F.when(F.col("post2") > 0, F.col("post2")).otherwise(F.col("pre2")))
    ratio = F.try_divide("post2", "c2")
    d = d.withColumn("corr", F.when(ratio.isNull(), 1.0).otherwise(clip(ratio, 0.5, 2.0)))
    d = d.withColumn("n0", F.col("c1") / F.col("pre1")).withColumn("d0", F.col("n0") * F.col("corr"))
    d = fill_forward(fill_forward(d, KEY, "n0", "normalized"), KEY, "d0", "double_normalized")
    return d.withColumn("bleach_depth", (F.col("pre1") - F.col("post1")) / F.col("pre1")).drop("n0", "d0", "f1", "f2", "n")


def clip(c: Column, lo, hi) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), c))


def double_with_floor(df: DataFrame, pre_frames: int = 5, floor: float = 1e-6) -> DataFrame:
    """Floors both signals and uses up to ``pre_frames`` frames before the minimum of the bleached region."""
    d = df.withColumn("c1", F.greatest(F.col("roi1") - F.col("roi3"), F.lit(floor)))
    d = d.withColumn("c2", F.greatest(F.col("roi2") - F.col("roi3"), F.lit(floor)))
    d = attach(d, KEY, bleach=earliest_min(F.col("roi1"), F.col("frame")))
    near = (F.col("frame") < F.col("bleach")) & (F.col("frame") >= F.col("bleach") - pre_frames)
    d = attach(d, KEY, p1=F.avg(F.when(near, F.col("c1"))), p2=F.avg(F.when(near, F.col("c2"))))
    d = d.withColumn("norm_error", F.when(F.col("p1").isNull() | F.col("p2").isNull(), "no frame before the bleach"))
    return d.withColumn("norm", F.col("c1") / F.col("p1") * (F.col("p2") / F.col("c2")))


def reference_ratio(df: DataFrame, pre_frames: int = 5, post_frames: int = 3) -> DataFrame:
    """Divide by the reference relative to its pre-bleach level, clipped to [0.1, 2]."""
    d = df.withColumn("c1", F.col("roi1") - F.col("roi3")).withColumn("c2", F.col("roi2") - F.col("roi3"))
    d = attach(d, KEY, bleach=earliest_min(F.col("c1"), F.col("frame")))
    head = F.col("frame") < F.least(F.col("bleach"), F.lit(pre_frames))
    post = (F.col("frame") > F.col("bleach")) & (F.col("frame") <= F.col("bleach") + post_frames)
    d = attach(
        d, KEY, pre1=F.avg(F.when(head, F.col("c1"))), pre2=F.avg(F.when(head, F.col("c2"))),
        post1=lambda o: F.coalesce(o(F.avg(F.when(post, F.col("c1")))), o(F.min("c1"))),
    )
    ratio = F.when(F.col("pre2") > 0, clip(F.coalesce(F.col("c2") / F.col("pre2"), F.lit(1.0)), 0.1, 2.0)).otherwise(1.0)
    ok = F.col("pre1") > 0
    d = d.withColumn("norm_error", F.when(F.col("pre1").isNull(), "no frame before the bleach").when(~ok, "pre-bleach not above background"))
    return d.withColumn("norm", F.when(ok, F.col("c1") / ratio / F.col("pre1"))).withColumn(
        "bleach_depth", F.when(ok, (F.col("pre1") - F.col("post1")) / F.col("pre1"))
    )


def normalization_report(normed: DataFrame) -> DataFrame:
    """One row per curve on the output of ``reference_ratio``."""
    head = F.col("frame") < F.least(F.lit(5), F.col("bleach"))
    r = normed.groupBy(*KEY).agg(F.avg(F.when(head, F.col("norm"))).alias("pre_mean"), F.max("norm").alias("hi"), F.min("norm").alias("lo"))
    return r.withColumn(
        "warnings",
        F.concat_ws("; ", F.when(F.col("hi").isNull(), "not normalized"), F.when(F.abs(F.col("pre_mean") - 1) > 0.1, "pre-bleach not 1"), F.when(F.col("hi") > 1.5, "above maximum"), F.when(F.col("lo") < 0, "negative")),
    )


def plateau_normalize(y: Column, i0: Column, i_inf: Column) -> Column:
    """NULL when start and plateau coincide."""
    return F.when(F.abs(i_inf - i0) >= 1e-10, (y - i0) / (i_inf - i0))


def bleach_anchored(df: DataFrame, y: str = "y", use_max: bool = False) -> DataFrame:
    """Minimum becomes 0, mean before it 1, time starts there; earlier frames are dropped.

    ``use_max`` is the variant that takes the curve maximum when nothing precedes the minimum.
    """
    b = attach(df, KEY, b=earliest_min(F.col(y), F.col("frame"), F.struct("frame", "t", F.col(y).alias("y"))))
    first = F.max(y) if use_max else F.max(F.when(F.col("frame") == 0, F.col(y)))
    d = attach(b, KEY, pre=lambda o: F.coalesce(o(F.avg(F.when(F.col("frame") < F.col("b.frame"), F.col(y)))), o(first)))
    span = F.col("pre") - F.col("b.y")
    if use_max:
        norm = F.when(F.abs(span) < 1e-12, F.col(y) - F.col("b.y")).otherwise(F.try_divide(F.col(y) - F.col("b.y"), span))
    else:
        norm = F.when(span != 0, F.try_divide(F.col(y) - F.col("b.y"), span)).when(F.col("pre") > 0, F.try_divide(F.col(y), F.col("pre"))).otherwise(F.col(y))
    return (
        d.withColumn("norm", norm).withColumn("t_rel", F.col("t") - F.col("b.t")).withColumn("bleach", F.col("b.frame"))
        .filter(F.col("t_rel") >= 0).drop("b")
    )


def rescale_to_unit(df: DataFrame, y: str = "y") -> DataFrame:
    """Shift negatives up, then divide by the pre-bleach mean when it is more than 10 % from 1."""
    d = attach(df, KEY, lo=F.min(y), bleach=earliest_min(F.col(y), F.col("frame")))
    d = d.withColumn("z", F.when(F.col("lo") < 0, F.col(y) - F.col("lo")).otherwise(F.col(y)))
    d = attach(d, KEY, pre=F.avg(F.when(F.col("frame") < F.col("bleach"), F.col("z"))))
    off = (F.col("pre") > 0) & (F.abs(F.col("pre") - 1) > 1e-8 + 0.1)
    return d.withColumn("norm", F.when(off, F.col("z") / F.col("pre")).otherwise(F.col("z"))).drop("lo", "z")


def acquisition_trend(df: DataFrame, y: str) -> DataFrame:
    """Linear slope in % of the first value per frame and exponential rate over all given pre-bleach frames."""
    x = F.col("frame").cast("double")
    g = df.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n"), F.regr_slope(F.col(y), x).alias("slope"), F.max(F.when(F.col("frame") == 0, F.col(y))).alias("first"),
        F.min(y).alias("lo"), (-F.regr_slope(F.ln(F.when(F.col(y) > 0, F.col(y))), x)).alias("rate"),
    )
    pct = 100 * F.col("slope") / F.greatest(F.abs("first"), F.lit(1e-12))
    enough = F.col("n") >= 3
    return g.select(
        *KEY, F.when(enough, pct).alias("slope_pct"), F.when(enough & (F.col("lo") > 0), F.col("rate")).alias("exp_rate"), F.when(enough, F.abs(pct) > 1.0).alias("flagged"),
        F.when(~enough, "fewer than 3 frames").alias("reason"),
    )


def detrend_linear(df: DataFrame, y: str = "y") -> DataFrame:
    d = attach(df, KEY, slope=F.regr_slope(F.col(y), F.col("t")))
    return d.withColumn("detrended", F.col(y) - F.col("slope") * F.col("t"))


def rolling_baseline(df: DataFrame, y: str = "y", window: int = 10, q: float = 0.1) -> DataFrame:
    h = window // 2
    d = windowed(df, KEY, lambda w: {"baseline": F.percentile(F.col(y), F.lit(q)).over(w.rowsBetween(-h, h))}, before=h, after=h)
    return d.withColumn("corrected", F.col(y) - F.col("baseline"))


def signal_to_noise(signal: Column, background: Column, sd: Column | None = None) -> Column:
    poisson = F.sqrt(F.greatest(background, F.lit(1.0)))
    return (signal - background) / (poisson if sd is None else F.when(sd != 0, sd).otherwise(poisson))


def detrend_exponential(df: DataFrame, fits: DataFrame, y: str = "y") -> DataFrame:
    """Subtract a fitted decay ``amp, p0 (rate)``; curves without one are detrended linearly."""
    lin = df.groupBy(*KEY).agg(F.regr_slope(F.col(y), F.col("t")).alias("slope"))
    j = df.join(lin, KEY).join(fits.select(*KEY, "amp", "p0"), KEY, "left")
    trend = F.when(F.col("amp") > 0, F.col("amp") * F.exp(-F.col("p0") * F.col("t"))).otherwise(F.col("slope") * F.col("t"))
    return j.withColumn("detrended", F.col(y) - trend).drop("slope", "amp", "p0")
