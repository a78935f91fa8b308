"""Image stacks as pixel tables ``stack_id, frame, py, px, v``.

Only single images, image rows or image columns (bounded by the camera) are ever gathered into one value.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from rekurve.operators.bleach import earliest_min
from rekurve.operators.ordered import attach, fill_forward, quantiles, windowed

IMG = ["stack_id", "frame"]
PIX = ["stack_id", "py", "px"]


def dist2(cx, cy) -> Column:
    c = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return F.pow(F.col("px") - c(cx), 2) + F.pow(F.col("py") - c(cy), 2)


def roi_masks(grid: DataFrame, cx: int, cy: int, width: int, height: int, radius: float = 10, gap: float = 5, span: float = 20, far: int = 50, bg_radius: float = 15) -> DataFrame:
    """Bleach disc, reference ring and background disc at a clamped offset, as ``stack_id, roi, py, px``."""
    bx, by = (max(far, min(width - far, cx + far)), max(far, min(height - far, cy + far)))
    d, ring = dist2(cx, cy), F.sqrt(dist2(cx, cy))
    rois = F.array_compact(F.array(
        F.when(d <= radius**2, "roi1"), F.when((ring >= radius + gap) & (ring <= radius + span), "roi2"), F.when(dist2(bx, by) <= bg_radius**2, "roi3"),
    ))
    return grid.select("stack_id", F.explode(rois).alias("roi"), "py", "px")


def roi_series(pixels: DataFrame, masks: DataFrame, rois: list[str]) -> DataFrame:
    """G1: mean per frame and region, one column per region; NULL for an empty region."""
    j = pixels.join(masks, ["stack_id", "py", "px"])
    return j.groupBy(*IMG).pivot("roi", rois).agg(F.avg("v"))


def bleach_radius(pre: DataFrame, post: DataFrame, pixel_size: float = 1.0) -> DataFrame:
    """Centre, e^-2 radius (2 sigma), ellipticity and fit quality from moments of max(pre - post, 0).

    ``pre`` and ``post`` are single images per stack: ``stack_id, py, px, v``.
    """
    d = pre.join(post.withColumnRenamed("v", "_p"), PIX).withColumn("d", F.greatest(F.col("v") - F.col("_p"), F.lit(0.0)))
    s = lambda e: F.sum(e * F.col("d"))
    x, y = F.col("px"), F.col("py")
    g = d.groupBy("stack_id").agg(F.sum("d").alias("t"), s(x).alias("sx"), s(y).alias("sy"), F.max("d").alias("top")).filter("t > 0")
    g = g.withColumn("x0", F.col("sx") / F.col("t")).withColumn("y0", F.col("sy") / F.col("t")).select("stack_id", "t", "top", "x0", "y0")
    d = d.join(g, "stack_id")
    v = d.groupBy("stack_id").agg((s(F.pow(x - F.col("x0"), 2)) / F.first("t")).alias("vx"), (s(F.pow(y - F.col("y0"), 2)) / F.first("t")).alias("vy"))
    v = v.withColumn("sgx", F.sqrt(F.greatest("vx", F.lit(1e-12)))).withColumn("sgy", F.sqrt(F.greatest("vy", F.lit(1e-12)))).select("stack_id", "sgx", "sgy")
    d = d.join(v, "stack_id")
    model = F.col("top") * F.exp(-(F.pow(x - F.col("x0"), 2) / (2 * F.col("sgx") * F.col("sgx")) + F.pow(y - F.col("y0"), 2) / (2 * F.col("sgy") * F.col("sgy"))))
    q = d.groupBy("stack_id").agg(
        F.first("x0").alias("x0"), F.first("y0").alias("y0"), F.first("sgx").alias("sgx"), F.first("sgy").alias("sgy"),
        F.sum(F.pow(F.col("d") - model, 2)).alias("res"), (F.var_pop("d") * F.count("d")).alias("tot"),
    )
    w = 2 * F.sqrt(0.5 * (F.col("sgx") * F.col("sgx") + F.col("sgy") * F.col("sgy")))
    return q.select("stack_id", "x0", "y0", (w * pixel_size).alias("w"), (F.greatest("sgx", "sgy") / F.least("sgx", "sgy")).alias("ellipticity"), (1 - F.try_divide("res", "tot")).alias("fit_quality"))


def images(pixels: DataFrame, value: str = "v") -> DataFrame:
    """One row per image: height, width and the values in row order."""
    px = F.sort_array(F.collect_list(F.struct("py", "px", value)))
    return pixels.groupBy(*IMG).agg((F.max("py") + 1).alias("h"), (F.max("px") + 1).alias("w"), px.alias("_p")).select(*IMG, "h", "w", F.col(f"_p.{value}").alias("img"))


def _shift(ref: np.ndarray, mov: np.ndarray) -> tuple[int, int]:
    c = np.fft.fftshift(np.fft.ifft2(np.fft.fft2(ref - ref.mean()) * np.conj(np.fft.fft2(mov - mov.mean()))).real)
    # rounded, so that equal peaks always give the first position
    iy, ix = np.unravel_index(np.argmax(np.round(c / max(np.abs(c).max(), 1e-300), 9)), c.shape)
    return int(iy - c.shape[0] // 2), int(ix - c.shape[1] // 2)


def drift_shifts(pixels: DataFrame, reference: int = 0) -> DataFrame:
    """Integer shift per frame that maximizes the circular correlation with the reference frame."""
    im = images(pixels)
    ref = im.filter(F.col("frame") == reference).select("stack_id", F.col("img").alias("ref"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            s = [_shift(np.reshape(r.ref, (r.h, r.w)), np.reshape(r.img, (r.h, r.w))) for r in b.itertuples()]
            yield pd.DataFrame({"stack_id": b["stack_id"], "frame": b["frame"], "dy": [x[0] for x in s], "dx": [x[1] for x in s]})

    types = {f.name: f.dataType.simpleString() for f in pixels.schema.fields}
    return im.join(ref, "stack_id").mapInPandas(run, f"stack_id {types['stack_id']}, frame {types['frame']}, dy int, dx int")


def apply_shifts(pixels: DataFrame, shifts: DataFrame) -> DataFrame:
    """Roll every frame by its shift."""
    size = pixels.groupBy("stack_id").agg((F.max("py") + 1).alias("_h"), (F.max("px") + 1).alias("_w"))
    j = pixels.join(shifts, IMG).join(size, "stack_id")
    return j.withColumn("py", F.pmod(F.col("py") + F.col("dy"), F.col("_h")).cast("int")).withColumn("px", F.pmod(F.col("px") + F.col("dx"), F.col("_w")).cast("int")).drop("_h", "_w", "dy", "dx")


def disc_signal(pixels: DataFrame, cx, cy, radius: float, inner: float = 5, outer: float = 10, method: str = "median") -> DataFrame:
    """Mean in the disc, background in the ring (median, or mean inside the quartile fences), their difference."""
    d = pixels.withColumn("_d", F.sqrt(dist2(cx, cy)))
    ring = d.filter((F.col("_d") > radius + inner) & (F.col("_d") <= radius + outer))
    q = quantiles(ring, IMG, "v", [0.25, 0.5, 0.75])
    if method == "median":
        bg = q.select(*IMG, F.col("q")[1].alias("bg"))
    else:
        i = F.col("q")[2] - F.col("q")[0]
        bg = ring.join(q, IMG).groupBy(*IMG).agg(F.coalesce(F.avg(F.when(F.col("v").between(F.col("q")[0] - 1.5 * i, F.col("q")[2] + 1.5 * i), F.col("v"))), F.first(F.col("q")[1])).alias("bg"))
    raw = d.filter(F.col("_d") <= radius).groupBy(*IMG).agg(F.avg("v").alias("raw"))
    return raw.join(bg, IMG, "left").withColumn("bg", F.coalesce("bg", F.lit(0.0))).withColumn("corr", F.col("raw") - F.col("bg"))


def radial_profile(pixels: DataFrame, step: float = 0.5) -> DataFrame:
    """Mean in rings around the darkest pixel of each image."""
    c = pixels.groupBy(*IMG).agg(F.min_by(F.struct("py", "px"), F.struct("v", "py", "px")).alias("c"))
    d = pixels.join(c, IMG).withColumn("ring", F.floor(F.sqrt(dist2(F.col("c.px"), F.col("c.py"))) / step))
    return d.groupBy(*IMG, "ring").agg(F.avg("v").alias("mean"), F.count(F.lit(1)).alias("n"))


def pixel_maps(pixels: DataFrame, bleach: int, end_frames: int = 5, radius: float = 1.0) -> DataFrame:
    """Mobile fraction, half-time, rate and diffusion coefficient of every pixel (frames are the time)."""
    n = pixels.groupBy("stack_id").agg((F.max("frame") + 1).alias("_n"))
    d = pixels.join(n, "stack_id")
    g = d.groupBy(*PIX).agg(
        F.avg(F.when(F.col("frame") < bleach, F.col("v"))).alias("y0"), F.max(F.when(F.col("frame") == bleach, F.col("v"))).alias("yb"),
        F.avg(F.when(F.col("frame") >= F.col("_n") - end_frames, F.col("v"))).alias("ye"),
    )
    j = d.join(g, PIX)
    hit = (F.col("frame") > bleach) & (F.col("v") / F.col("y0") >= F.col("yb") / F.col("y0") + 0.5 * (F.col("ye") / F.col("y0") - F.col("yb") / F.col("y0")))
    out = j.groupBy(*PIX).agg(F.first("y0").alias("y0"), F.first("yb").alias("yb"), F.first("ye").alias("ye"), F.min(F.when(hit, F.col("frame") - bleach)).cast("double").alias("t_half"))
    mobile = F.try_divide(F.col("ye") - F.col("yb"), F.col("y0") - F.col("yb"))
    return out.select(*PIX, F.when(mobile.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), mobile))).alias("mobile"), "t_half", (0.6931471805599453 / F.col("t_half")).alias("k"), (radius * radius / (4 * F.col("t_half"))).alias("d"))


def bleach_mask(pixels: DataFrame, bleach: int, drop: float = 0.3, cell_quantile: float = 0.0) -> DataFrame:
    """Pixels that lost more than ``drop`` of their pre-bleach mean inside the cell (at least ``cell_quantile`` of the peak)."""
    g = pixels.groupBy(*PIX).agg(F.avg(F.when(F.col("frame") < bleach, F.col("v"))).alias("pre"), F.max(F.when(F.col("frame") == bleach, F.col("v"))).alias("post"))
    g = attach(g, ["stack_id"], _top=F.max("pre"))
    return g.filter((F.col("pre") > 0) & ((F.col("pre") - F.col("post")) / F.col("pre") > drop) & (F.col("pre") >= cell_quantile * F.col("_top"))).select(*PIX, "pre")


def equivalent_radius(mask: DataFrame, pixel_size: float = 1.0) -> DataFrame:
    return mask.groupBy("stack_id").agg(F.count(F.lit(1)).alias("area"), (F.sqrt(F.count(F.lit(1)) / 3.141592653589793) * pixel_size).alias("radius"))


def adaptive_signal(pixels: DataFrame, centers: DataFrame, factor: float = 1.5, ring: float = 5) -> DataFrame:
    """Mean inside ``radius * factor`` of each frame's centre and in the surrounding ring.  ``centers``: stack_id, frame, cx, cy, radius."""
    d = pixels.join(centers, IMG).withColumn("_d", F.sqrt(dist2(F.col("cx"), F.col("cy"))) - F.col("radius") * factor)
    return d.groupBy(*IMG).agg(F.avg(F.when(F.col("_d") <= 0, F.col("v"))).alias("damage"), F.avg(F.when((F.col("_d") > 0) & (F.col("_d") <= ring), F.col("v"))).alias("background"), F.count(F.when(F.col("_d") <= 0, 1)).alias("area"))


def otsu_area(pixels: DataFrame, bins: int = 256) -> DataFrame:
    """Pixels darker than the threshold with the largest between-class variance; empty frames repeat the last area."""
    r = pixels.groupBy(*IMG).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    d = pixels.join(r, IMG).withColumn("bin", F.least(F.lit(bins - 1), F.floor((F.col("v") - F.col("lo")) / width)).cast("int"))
    h = d.groupBy(*IMG, "bin").agg(F.count(F.lit(1)).alias("c"), F.first(F.col("lo") + (F.col("bin") + 0.5) * width).alias("mid"))
    w = Window.partitionBy(*IMG).orderBy("bin")  # at most ``bins`` rows per image
    up, down = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(1, Window.unboundedFollowing)
    h = h.select(
        *IMG, "bin", "mid", F.sum("c").over(up).alias("w1"), F.sum("c").over(down).alias("w2"), F.sum(F.col("c") * F.col("mid")).over(up).alias("s1"), F.sum(F.col("c") * F.col("mid")).over(down).alias("s2")
    )
    var = F.round(F.col("w1") * F.col("w2") * F.pow(F.col("s1") / F.col("w1") - F.col("s2") / F.col("w2"), 2), 6)
    t = h.filter("w2 > 0").groupBy(*IMG).agg(F.min_by("mid", F.struct(-var, F.col("bin"))).alias("threshold"))
    a = pixels.join(t, IMG).groupBy(*IMG).agg(F.first("threshold").alias("threshold"), F.count(F.when(F.col("v") < F.col("threshold"), 1)).alias("raw"))
    a = a.withColumn("found", F.when(F.col("raw") > 0, F.col("raw")))
    return fill_forward(a, ["stack_id"], "found", "area").select(*IMG, "threshold", "area")


def sobel(pixels: DataFrame) -> DataFrame:
    """Gradient magnitude with repeated borders; image rows and columns are the windows."""
    row, col = Window.partitionBy(*IMG, "py").orderBy("px"), Window.partitionBy(*IMG, "px").orderBy("py")
    nb = lambda c, w: (F.coalesce(F.lag(c).over(w), F.col(c)), F.coalesce(F.lead(c).over(w), F.col(c)))
    l, r = nb("v", row)
    d = pixels.withColumns({"sx": (l + 2 * F.col("v") + r) / 4, "dx": l - r})
    a, b = nb("dx", col)
    c, e = nb("sx", col)
    return d.withColumns({"gx": (a + 2 * F.col("dx") + b) / 4, "gy": c - e}).withColumn("grad", F.sqrt((F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")) / 2)).drop("sx", "dx", "gx", "gy")


SMOOTH = [float(w) for w in np.exp(-0.5 * np.arange(-4, 5) ** 2) / np.exp(-0.5 * np.arange(-4, 5) ** 2).sum()]


def edge_radius(pixels: DataFrame, cx, cy, r0: float, r_min: float, r_max: float) -> DataFrame:
    """Radius whose ring (one pixel to each side) holds the most gradient, after smoothing over radii."""
    # fixed values: from 3 below r0 (or r_min) in steps of one half to less than 4 above it (or r_max)
    low, high = max(r_min, r0 - 3), min(r_max, r0 + 4)
    radii = [low + 0.5 * i for i in range(max(0, math.ceil(2 * (high - low))))]
    n = len(radii)
    d = F.sqrt(dist2(cx, cy))
    g = sobel(pixels).groupBy(*IMG).agg(F.array(*[F.coalesce(F.sum(F.when((d >= r - 1) & (d <= r + 1), F.col("grad"))), F.lit(0.0)) for r in radii]).alias("e"))
    mirror = f"if(k < 0, -k - 1, if(k >= {n}, {2 * n - 1} - k, k))"
    w = "array(" + ",".join(f"{x!r}D" for x in SMOOTH) + ")"
    inner = f"get(e, {mirror.replace('k', '(i + o)')})"
    sm = F.expr(f"transform(sequence(0, {n - 1}), i -> aggregate(sequence(-4, 4), 0D, (s, o) -> s + get({w}, o + 4) * {inner}))") if n > 3 else F.col("e")
    g = g.withColumn("sm", F.transform(sm, lambda x: F.round(x, 6)))
    pos = F.array_position("sm", F.array_max("sm")) - 1
    rr = F.array(*[F.lit(r) for r in radii])
    return g.select(*IMG, F.when(F.array_max("e") > 0, F.get(rr, pos.cast("int"))).otherwise(F.lit(float(r0))).alias("radius"))


def mask_overlap(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Intersection over union and areas of two masks ``keys, py, px``."""
    j = a.withColumn("_a", F.lit(1)).join(b.withColumn("_b", F.lit(1)), [*keys, "py", "px"], "full_outer")
    s = F.count(F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), 1))
    return j.groupBy(*keys).agg(F.count("_a").alias("area_a"), F.count("_b").alias("area_b"), (s / F.count(F.lit(1))).alias("iou"))


def _distance_to(mask: np.ndarray) -> np.ndarray:
    """Distance of every pixel to the nearest set pixel: along columns first, then the lower envelope of parabolas along rows.

    All rows take their next column at the same time, each with a stack of the parabolas that are lowest so far, so the work is in
    proportion to the pixels and so is the memory.
    """
    h, w = mask.shape
    rows = np.arange(h)[:, None]
    up = np.maximum.accumulate(np.where(mask, rows, -np.inf), axis=0)
    down = np.minimum.accumulate(np.where(mask, rows, np.inf)[::-1], axis=0)[::-1]
    g2 = np.minimum(np.minimum(rows - up, down - rows) ** 2, 4.0 * (h + w) ** 2)  # columns without a set pixel: above all that is real
    g2 = g2 + np.arange(w) ** 2.0  # a parabola at q is g2[q] - 2 q x + x x
    at, begin, top, r = np.zeros((h, w), np.int64), np.full((h, w), -np.inf), np.zeros(h, np.int64), np.arange(h)
    for q in range(1, w):
        todo, meet = r, np.empty(h)
        while len(todo):
            last = at[todo, top[todo]]
            meet[todo] = (g2[todo, q] - g2[todo, last]) / (2.0 * (q - last))
            todo = todo[(meet[todo] <= begin[todo, top[todo]])]
            top[todo] -= 1
        top += 1
        at[r, top], begin[r, top] = q, meet
    out, k = np.empty((h, w)), np.zeros(h, np.int64)
    for q in range(w):
        while len(go := np.flatnonzero((k < top) & (begin[r, np.minimum(k + 1, w - 1)] <= q))):
            k[go] += 1
        out[:, q] = g2[r, at[r, k]] - 2.0 * q * at[r, k] + q * q
    return np.sqrt(np.maximum(out, 0))


def hausdorff(a: DataFrame, b: DataFrame, keys: list[str], height: int, width: int) -> DataFrame:
    """Symmetric Hausdorff distance of two masks, one image pair at a time."""
    pos = F.col("py") * width + F.col("px")
    pa = a.groupBy(*keys).agg(F.collect_set(pos).alias("pa"))
    pb = b.groupBy(*keys).agg(F.collect_set(pos).alias("pb"))
    types = {f.name: f.dataType.simpleString() for f in a.schema.fields}

    def run(batches):
        for t in batches:
            out = []
            for p, q in zip(t["pa"], t["pb"]):
                m, n = np.zeros(height * width, bool), np.zeros(height * width, bool)
                m[np.asarray(p, int)] = True
                n[np.asarray(q, int)] = True
                m, n = m.reshape(height, width), n.reshape(height, width)
                out.append(max(_distance_to(n)[m].max(), _distance_to(m)[n].max()))
            yield t[keys].assign(hausdorff=out)

    return pa.join(pb, keys).mapInPandas(run, ", ".join(f"`{k}` {types[k]}" for k in keys) + ", hausdorff double")


def temporal_gradient(pixels: DataFrame) -> DataFrame:
    """Frame with the largest mean absolute central difference, and its strongest pixel."""
    prep = windowed(pixels, PIX, lambda w: {"p": F.lag("v").over(w), "nx": F.lead("v").over(w)}, before=1, after=1)
    g = F.when(F.col("p").isNull(), F.col("nx") - F.col("v")).when(F.col("nx").isNull(), F.col("v") - F.col("p")).otherwise((F.col("nx") - F.col("p")) / 2)
    d = prep.withColumn("g", F.abs(g))
    per = d.groupBy(*IMG).agg(F.round(F.avg("g"), 9).alias("m"), F.min_by(F.struct("py", "px"), F.struct(-F.round("g", 9), F.col("py"), F.col("px"))).alias("at"))
    return per.groupBy("stack_id").agg(F.min_by(F.struct("frame", "at"), F.struct(-F.col("m"), F.col("frame"))).alias("b")).select("stack_id", F.col("b.frame").alias("bleach"), F.col("b.at.py").alias("py"), F.col("b.at.px").alias("px"))


def _kernel(sigma: float) -> np.ndarray:
    r = int(4 * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return w / w.sum()


def _blur_axis(d: DataFrame, along: str, across: str, sigma: float) -> DataFrame:
    k = _kernel(sigma)
    r = len(k) // 2
    g = d.groupBy(*IMG, across).agg(F.sort_array(F.collect_list(F.struct(along, "v"))).alias("_p")).select(*IMG, across, F.col("_p.v").alias("v"))
    types = {f.name: f.dataType.simpleString() for f in d.schema.fields}

    def run(batches):
        for b in batches:
            b["v"] = [np.convolve(np.pad(np.asarray(v, float), r, mode="edge"), k, mode="valid") for v in b["v"]]
            yield b

    out = g.mapInPandas(run, ", ".join(f"`{c}` {types[c]}" for c in [*IMG, across]) + ", v array<double>")
    return out.select(*IMG, across, F.posexplode("v").alias(along, "v"))


def blur(pixels: DataFrame, sigma: float) -> DataFrame:
    """Gaussian smoothing with repeated borders: all rows, then all columns."""
    return _blur_axis(_blur_axis(pixels.select(*IMG, "py", "px", "v"), "px", "py", sigma), "py", "px", sigma)


def subtract_background(pixels: DataFrame, sigma: float = 20.0) -> DataFrame:
    """Remove the smooth background, clipped at zero."""
    bg = blur(pixels, sigma).withColumnRenamed("v", "bg")
    return pixels.join(bg, [*IMG, "py", "px"]).withColumn("corrected", F.greatest(F.lit(0.0), F.col("v") - F.col("bg")))


def darkest_blurred(pixels: DataFrame, sigma: float = 1.0) -> DataFrame:
    """Darkest pixel of each smoothed image."""
    return blur(pixels, sigma).withColumn("v", F.round("v", 9)).groupBy(*IMG).agg(F.min_by(F.struct("py", "px"), F.struct("v", "py", "px")).alias("c")).select(*IMG, "c.py", "c.px")


def steepest_image_drop(pixels: DataFrame) -> DataFrame:
    """N13 for stacks: frame after the steepest drop of the image mean."""
    m = pixels.groupBy(*IMG).agg(F.avg("v").alias("m"))
    d = windowed(m, ["stack_id"], lambda w: {"d": F.col("m") - F.lag("m").over(w)})
    return d.groupBy("stack_id").agg(earliest_min(F.col("d"), F.col("frame")).alias("bleach"))


def tracking_table(pixels: DataFrame, positions: DataFrame, radius: float, inner: float = 1, outer: float = 3, jump: float = 10.0) -> DataFrame:
    """Per-frame signals around given positions (stack_id, frame, x, y, innovation) with a motion flag and reason."""
    d = pixels.join(positions, IMG).withColumn("_d", F.sqrt(dist2(F.col("x"), F.col("y"))))
    ring = d.filter((F.col("_d") > radius + inner) & (F.col("_d") <= radius + outer))
    bg = quantiles(ring, IMG, "v", [0.5]).select(*IMG, F.col("q")[0].alias("signal_bg"))
    s = d.filter(F.col("_d") <= radius).groupBy(*IMG).agg(F.avg("v").alias("signal_raw"), F.first("x").alias("x"), F.first("y").alias("y"), F.first("innovation").alias("innovation"))
    out = s.join(bg, IMG, "left").withColumn("signal_corr", F.col("signal_raw") - F.coalesce("signal_bg", F.lit(0.0)))
    bad = F.coalesce(F.col("innovation") > jump, F.lit(False))
    return out.withColumn("qc_motion", ~bad).withColumn("qc_reason", F.when(bad, "large_innovation").otherwise(""))
