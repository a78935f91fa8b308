"""Bracket joins: linear interpolation of curves on grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rekurve.operators.ordered import attach, quantiles, windowed


def interpolate(df: DataFrame, keys: list[str], x: str, y: str, step: Column, points: Column, out: str = "yi", keep: list[str] = ()) -> DataFrame:
    """Values at ``x = j * step`` for ``j in 0..points-1``, held constant outside the data.

    Each sample emits the grid positions between itself and its successor, so there is no range join and only the
    rows of one window border are ever shared.  ``step`` and ``points`` may be row columns.
    """
    n = windowed(df, keys, lambda w: {"_x1": F.lead(x).over(w), "_y1": F.lead(y).over(w)}, before=0, after=1)
    lo = F.when(F.col("frame") == 0, F.lit(0)).otherwise(F.ceil(F.col(x) / step)).cast("long")
    hi = F.when(F.col("_x1").isNull(), points - 1).otherwise(F.least(F.ceil(F.col("_x1") / step) - 1, points - 1)).cast("long")
    n = n.withColumn("_lo", lo).withColumn("_hi", hi).filter("_hi >= _lo")
    g = n.select("*", F.explode(F.sequence("_lo", "_hi")).alias("j"), step.alias("_step"))
    at = F.col("j") * F.col("_step")
    inside = F.col("_x1").isNotNull() & (at >= F.col(x))
    value = F.when(inside, F.col(y) + (F.col("_y1") - F.col(y)) * (at - F.col(x)) / (F.col("_x1") - F.col(x))).otherwise(F.col(y))
    return g.select(*keys, *keep, "j", at.alias("x"), value.alias(out))


def align(df: DataFrame, points: int = 200, t: str = "t", y: str = "y", keep: list[str] = ()) -> DataFrame:
    """All curves on one grid from 0 to the largest time of any curve."""
    d = attach(df, [], _st=lambda o: o(F.max(t)) / (points - 1))
    return interpolate(d, ["curve_id"], t, y, F.col("_st"), F.lit(points), "yi", list(keep))


def shared_support(df: DataFrame, t: str = "t", y: str = "y") -> DataFrame:
    """Grid from 0 to the smallest of the curve ends with median-length points clipped to 8..300."""
    ends = df.groupBy("curve_id").agg(F.max(t).alias("end"), F.count(F.lit(1)).alias("len"))
    # one row: the limits of the common grid
    lim = quantiles(ends, [], "len", [0.5]).crossJoin(ends.agg(F.min("end").alias("_end")))
    lim = lim.select(F.least(F.lit(300), F.greatest(F.lit(8), F.floor(F.col("q")[0]))).alias("_n"), "_end")
    d = df.crossJoin(F.broadcast(lim)).filter("_end > 0")
    return interpolate(d, ["curve_id"], t, y, F.col("_end") / (F.col("_n") - 1), F.col("_n"))


def mean_curve(aligned: DataFrame, by: list[str], y: str = "yi") -> DataFrame:
    """A2: mean, SD, SEM and count per grid position."""
    return aligned.groupBy(*by, "j").agg(
        F.first("x").alias("x"), F.avg(y).alias("mean"), F.stddev_samp(y).alias("sd"),
        (F.stddev_samp(y) / F.sqrt(F.count(y))).alias("sem"), F.count(y).alias("n"),
    )
