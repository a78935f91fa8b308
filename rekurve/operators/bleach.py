"""Bleach and damage event detection, and the post-bleach part of each curve."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rekurve.operators.ordered import attach, windowed

KEY = ["curve_id"]


def earliest_min(value: Column, frame: Column, result: Column | None = None) -> Column:
    """Aggregate: ``result`` (default the frame) at the smallest value, first frame on ties."""
    return F.min_by(frame if result is None else result, F.when(value.isNotNull(), F.struct(value, frame)))


def bleach_at_minimum(df: DataFrame, y: str = "y") -> DataFrame:
    return df.groupBy(*KEY).agg(earliest_min(F.col(y), F.col("frame")).alias("bleach"))


def bleach_at_steepest(df: DataFrame, y: str = "y") -> DataFrame:
    steps = windowed(df, KEY, lambda w: {"d": F.col(y) - F.lag(y).over(w)})
    return steps.groupBy(*KEY).agg(earliest_min(F.col("d"), F.col("frame")).alias("bleach"))


def bleach_at_drop(df: DataFrame, y: str = "y", threshold: float = 0.3) -> DataFrame:
    """First frame that lost more than ``threshold`` of the previous value; NULL when none did."""
    steps = windowed(df, KEY, lambda w: {"prev": F.lag(y).over(w)})
    lost = F.try_divide(F.col("prev") - F.col(y), F.col("prev")) > threshold
    return steps.groupBy(*KEY).agg(F.min(F.when(lost, F.col("frame"))).alias("bleach"))


def _candidate_rows(df: DataFrame, y: str, fit_points: int) -> tuple[DataFrame, dict[str, Column]]:
    """Rows with what a bleach candidate needs to know, and the aggregates that pick both candidates.

    A single windowed pass gives each row the mean and spread of its five predecessors and the line through its
    ``fit_points`` successors; the aggregates only pick rows.
    """

    def cols(w):
        ahead = w.rowsBetween(1, fit_points)
        return {
            "_pm": F.avg(y).over(w.rowsBetween(-5, -1)),
            "_ps": F.stddev_pop(y).over(w.rowsBetween(-5, -1)),
            "_d": F.col(y) - F.lag(y).over(w),
            "_slope": F.regr_slope(y, "t").over(ahead),
            "_icept": F.regr_intercept(y, "t").over(ahead),
            "_next": F.lead("t").over(w),
        }

    rows = windowed(df, KEY, cols, before=5, after=fit_points)
    what = F.struct(
        "frame", "t", F.col(y).alias("y"), F.col("_pm").alias("pm"), F.col("_ps").alias("ps"), F.col("_slope").alias("slope"), F.col("_icept").alias("icept"), F.col("_next").alias("t_next")
    )
    picks = {"_n": F.count(F.lit(1)), "_a": earliest_min(F.col(y), F.col("frame"), what), "_s": earliest_min(F.col("_d"), F.col("frame"), what)}
    return rows, picks


def _chosen(min_pre: int, min_post: int) -> Column:
    """The valid candidate with the largest drop in units of the preceding spread; the minimum if none is valid."""

    def score(c):
        drop = F.col(f"{c}.pm") - F.col(f"{c}.y")
        ok = (F.col(f"{c}.frame") >= min_pre) & (F.col(f"{c}.frame") <= F.col("_n") - min_post - 1) & (drop > 0)
        return F.when(ok, F.struct((drop / (F.col(f"{c}.ps") + 1e-8)).alias("z"), drop.alias("drop")))

    za, zs = score("_a"), score("_s")
    return F.when(zs.isNotNull() & (za.isNull() | (zs > za)), F.col("_s")).otherwise(F.col("_a"))


def robust_bleach(df: DataFrame, y: str = "y", min_pre: int = 1, min_post: int = 2, fit_points: int = 3) -> DataFrame:
    """One row per curve with the chosen bleach frame."""
    rows, picks = _candidate_rows(df, y, fit_points)
    g = rows.groupBy(*KEY).agg(*[a.alias(n) for n, a in picks.items()]).withColumn("b", _chosen(min_pre, min_post))
    return g.select(*KEY, F.col("_n").alias("n"), F.col("b.frame").alias("bleach"), F.col("b.t").alias("t_bleach"), F.col("b.y").alias("y_bleach"))


def post_bleach(df: DataFrame, y: str = "y", points: int = 3, floor_negative: bool = False) -> DataFrame:
    """Rows from the bleach on: ``t_post`` starts half a frame after it, the first value is extrapolated back.

    ``points=3`` follows the stricter guard; ``points=4, floor_negative=True`` is the variant that replaces a negative
    start by 80 % of the measured value.  Curves that cannot be segmented give no rows.
    """
    min_post = 3 if floor_negative else max(2, points + 1)
    rows, picks = _candidate_rows(df, y, points)
    d = attach(rows, KEY, **picks).withColumn("_b", _chosen(1, min_post))
    b = {f: F.col(f"_b.{f}") for f in ("frame", "t", "y", "slope", "icept", "t_next")}
    good = (b["frame"] > 0) & (b["frame"] < F.col("_n") - (3 if floor_negative else 2)) & (b["t_next"] > b["t"]) & b["slope"].isNotNull()
    start = F.least(b["slope"] * b["t"] + b["icept"], b["y"])
    if floor_negative:
        start = F.when(start < 0, F.greatest(F.lit(0.0), b["y"] * 0.8)).otherwise(start)
    kept = d.filter(good & (F.col("frame") >= b["frame"]))
    return kept.select(
        *df.columns, b["frame"].alias("bleach"), (F.col("t") - b["t"] + 0.5 * (b["t_next"] - b["t"])).alias("t_post"), F.when(F.col("frame") == b["frame"], start).otherwise(F.col(y)).alias("y_post")
    )


def time_zero(df: DataFrame, y: str = "y", points: int = 5) -> DataFrame:
    """Value at the minimum frame extrapolated from the next ``points`` frames, with the half-frame offset."""
    ahead = windowed(
        df, KEY,
        lambda w: {
            "slope": F.regr_slope(y, "t").over(w.rowsBetween(1, points)),
            "icept": F.regr_intercept(y, "t").over(w.rowsBetween(1, points)),
            "t_next": F.lead("t").over(w),
        },
        before=0, after=points,
    )
    what = F.struct("frame", "t", "slope", "icept", "t_next")
    b = ahead.groupBy(*KEY).agg(earliest_min(F.col(y), F.col("frame"), what).alias("b"))
    return b.select(
        *KEY, F.col("b.frame").alias("bleach"), (F.col("b.slope") * F.col("b.t") + F.col("b.icept")).alias("f_zero"),
        (0.5 * (F.col("b.t_next") - F.col("b.t"))).alias("half_frame"),
    )


def pre_bleach_level(df: DataFrame, y: str = "y", frames: int = 5) -> DataFrame:
    """Mean of at most ``frames`` frames before the minimum; the first value when there are none."""
    b = attach(df, KEY, bleach=earliest_min(F.col(y), F.col("frame")))
    near = (F.col("frame") < F.col("bleach")) & (F.col("frame") >= F.col("bleach") - frames)
    return b.groupBy(*KEY).agg(
        F.first("bleach").alias("bleach"),
        F.coalesce(F.avg(F.when(near, F.col(y))), F.max(F.when(F.col("frame") == 0, F.col(y)))).alias("pre"),
    )
