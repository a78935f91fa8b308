"""Contours ``object_id, frame, point_idx, x, y``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rekurve.operators.align import interpolate
from rekurve.operators.ordered import attach, frame_index

PI = 3.141592653589793
BOLTZMANN = 1.380649e-23
CON = ["object_id", "frame"]


def uniform_radius(points: DataFrame, samples: int = 256) -> DataFrame:
    """Radius around the centroid at evenly spaced angles, periodic in the angle."""
    d = attach(points, CON, cx=F.avg("x"), cy=F.avg("y"))
    dx, dy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    d = d.select(*CON, "point_idx", F.pmod(F.atan2(dy, dx), F.lit(2 * PI)).alias("theta"), F.sqrt(dx * dx + dy * dy).alias("r"))
    first = d.groupBy(*CON).agg(F.min_by(F.struct("point_idx", "theta", "r"), F.struct("theta", "point_idx")).alias("f"))
    wrap = first.select(*CON, (F.col("f.point_idx") + 1_000_000_000).cast(d.schema["point_idx"].dataType).alias("point_idx"), (F.col("f.theta") + 2 * PI).alias("theta"), F.col("f.r").alias("r"))
    pts = frame_index(d.unionByName(wrap).withColumnRenamed("frame", "_img"), ["object_id", "_img"], ["theta", "point_idx"])
    out = interpolate(pts, ["object_id", "_img"], "theta", "r", F.lit(2 * PI / samples), F.lit(samples), "radius")
    return out.select("object_id", F.col("_img").alias("frame"), "j", "radius")


def modes(radius: DataFrame, samples: int, first: int, last: int) -> DataFrame:
    """Squared amplitude of each angular mode per contour."""
    ang = lambda m: F.col("j") * (2 * PI * m / samples)
    ms = list(range(first, last + 1))
    g = radius.groupBy(*CON).agg(
        F.avg("radius").alias("mean_r"),
        *[F.sum(F.col("radius") * F.cos(ang(m))).alias(f"c{m}") for m in ms], *[F.sum(F.col("radius") * F.sin(ang(m))).alias(f"s{m}") for m in ms],
    )
    power = F.array(*[F.struct(F.lit(m).alias("mode"), ((F.col(f"c{m}") * F.col(f"c{m}") + F.col(f"s{m}") * F.col(f"s{m}")) / (samples * samples)).alias("power")) for m in ms])
    return g.select(*CON, "mean_r", F.explode(power).alias("p")).select(*CON, "mean_r", "p.*")


def spectrum(mode_power: DataFrame, pixel_size: float = 1.0) -> DataFrame:
    """Time-averaged variance and wavenumber per object and mode."""
    r = mode_power.groupBy("object_id").agg((F.avg("mean_r") * pixel_size).alias("radius"))
    v = mode_power.groupBy("object_id", "mode").agg((F.avg("power") * pixel_size * pixel_size).alias("variance"), F.count(F.lit(1)).alias("frames"))
    return v.join(r, "object_id").withColumn("q", F.col("mode") / F.col("radius"))


def tension(spec: DataFrame, temperature: float = 298.15) -> DataFrame:
    """Zero-intercept fit of variance on 1/q^2 and the tension it implies."""
    ok = spec.filter("variance > 0 and q > 0").withColumn("ix", 1 / (F.col("q") * F.col("q")))
    g = ok.groupBy("object_id").agg((F.sum(F.col("ix") * F.col("variance")) / F.sum(F.col("ix") * F.col("ix"))).alias("slope"), F.count(F.lit(1)).alias("modes"), F.avg("variance").alias("_mv"))
    j = ok.join(g.filter("modes >= 3"), "object_id")
    res = F.sum(F.pow(F.col("variance") - F.col("slope") * F.col("ix"), 2))
    tot = F.sum(F.pow(F.col("variance") - F.col("_mv"), 2))
    k = BOLTZMANN * temperature
    return j.groupBy("object_id").agg(F.first("slope").alias("slope"), F.first("modes").alias("modes"), (1 - F.try_divide(res, tot)).alias("r2")).withColumn("gamma", F.when(F.col("slope") > 0, k / F.col("slope")))


def gamma_per_mode(spec: DataFrame, temperature: float = 298.15) -> DataFrame:
    return spec.filter("variance > 0 and q > 0").withColumn("gamma", BOLTZMANN * temperature / (F.col("variance") * F.col("q") * F.col("q")))


def fluctuation_psd(points: DataFrame, samples: int, pixel_size: float = 1.0) -> DataFrame:
    """Average periodogram of the radius around the common centre of all frames, by point order."""
    d = attach(points, ["object_id"], cx=F.avg("x"), cy=F.avg("y"))
    r = F.sqrt(F.pow(F.col("x") - F.col("cx"), 2) + F.pow(F.col("y") - F.col("cy"), 2)) * pixel_size
    rad = d.select(*CON, F.col("point_idx").alias("j"), r.alias("radius"))
    half = samples // 2
    m = modes(rad, samples, 1, half)
    one = F.when(F.col("mode") == half, 1).otherwise(2) if samples % 2 == 0 else F.lit(2)  # one-sided density
    p = m.withColumn("psd", F.col("power") * samples * one)
    return p.groupBy("object_id", "mode").agg(F.avg("psd").alias("psd")).withColumn("q", F.col("mode") * (2 * PI / samples))


def bending(psd: DataFrame, temperature: float = 310.0) -> DataFrame:
    """Tension and rigidity; kT/psd is linear in q^2 and q^4, weighted by psd squared so errors count as in psd."""
    k = BOLTZMANN * temperature
    d = psd.filter("psd > 0").withColumn("_w", F.col("psd") * F.col("psd")).withColumn("_y", 1 / F.col("psd"))
    q2, q4 = F.pow("q", 2), F.pow("q", 4)
    s = lambda a: F.sum(F.col("_w") * a)
    g = d.groupBy("object_id").agg(s(q2 * q2).alias("a"), s(q2 * q4).alias("b"), s(q4 * q4).alias("d"), s(q2 * F.col("_y")).alias("e"), s(q4 * F.col("_y")).alias("f"))
    det = F.col("a") * F.col("d") - F.col("b") * F.col("b")
    sg, kp = F.expr("e * d - b * f") / det, F.expr("a * f - b * e") / det
    pos = lambda c: F.greatest(F.lit(0.0), c)
    sigma = F.when(kp < 0, F.col("e") / F.col("a")).otherwise(pos(sg))
    kappa = F.when(sg < 0, F.col("f") / F.col("d")).otherwise(pos(kp))
    return g.select("object_id", (k * sigma).alias("tension"), (k * kappa).alias("rigidity"), sigma.alias("tension_kt"), kappa.alias("rigidity_kt"))
