"""Trajectories ``track_id, frame, x, y``."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from rekurve.operators.ordered import segment_rows, windowed
from rekurve.plans.session import cut_lineage

KEY = ["track_id"]


def steps(df: DataFrame) -> DataFrame:
    """Length and angle of each step; the first frame has none."""
    d = windowed(df, KEY, lambda w: {"dx": F.col("x") - F.lag("x").over(w), "dy": F.col("y") - F.lag("y").over(w)})
    return d.withColumn("step", F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))).withColumn("angle", F.atan2("dy", "dx"))


def state_pairs(df: DataFrame, state: str = "state") -> DataFrame:
    """Each state with its successor."""
    return windowed(df, KEY, lambda w: {"next_state": F.lead(state).over(w)}, before=0, after=1).filter("next_state is not null")


def transition_matrix(df: DataFrame, states: int, state: str = "state", pseudocount: float = 1.0) -> DataFrame:
    """Transition probabilities with a pseudocount, and the share of each origin state."""
    n = state_pairs(df, state).groupBy(F.col(state).alias("a"), F.col("next_state").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    spark = df.sparkSession
    cells = spark.range(states * states).select((F.col("id") / states).cast("int").alias("a"), (F.col("id") % states).cast("int").alias("b"))  # fixed size
    c = cells.join(n, ["a", "b"], "left").withColumn("c", F.coalesce("n", F.lit(0)) + pseudocount)
    w = df.groupBy(F.col(state).alias("a")).agg(F.count(F.lit(1)).alias("m"))
    w = w.withColumn("weight", F.col("m") / F.sum("m").over(Window.partitionBy()))  # one row per state
    p = c.withColumn("prob", F.col("c") / F.sum("c").over(Window.partitionBy("a")))
    return p.join(w, "a", "left").select("a", "b", "prob", F.coalesce("weight", F.lit(0.0)).alias("weight"))


def _segments(df: DataFrame) -> DataFrame:
    return df.withColumn("_seg", F.floor(F.col("frame") / segment_rows(df)).cast("long"))


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus products of two stacks of square matrices, one middle state after the other to stay within their size."""
    out = a[:, :, 0, None] + b[:, None, 0, :]
    for s in range(1, a.shape[1]):
        np.maximum(out, a[:, :, s, None] + b[:, None, s, :], out=out)
    return out


def _levels(steps: np.ndarray) -> list[np.ndarray]:
    """Products of the steps by halves: level by level pairs of neighbours, filled up with units to a power of two, up to a single matrix."""
    n, k, _ = steps.shape
    unit = np.where(np.eye(k, dtype=bool), 0.0, -np.inf)
    out = [np.concatenate([steps, np.broadcast_to(unit, ((1 << (n - 1).bit_length()) - n, k, k))])]
    while len(out[-1]) > 1:
        out.append(_product(out[-1][0::2], out[-1][1::2]))
    return out


def _best_states(levels: list[np.ndarray], entry: int, last: int, n: int) -> np.ndarray:
    """States after each of the n steps on a best path from ``entry`` to ``last``: between two known states the one in the middle is found, level by level."""
    ends = np.array([entry, last])
    for m in reversed(levels[:-1]):
        i = np.arange(len(ends) - 1)
        middle = (m[0::2][i, ends[:-1]] + m[1::2][i, :, ends[1:]]).argmax(1)
        ends = np.insert(ends, i + 1, middle)
    return ends[1 : n + 1]


def viterbi(df: DataFrame, cols: list[str], transition: np.ndarray, loc: np.ndarray, scale: np.ndarray, init: np.ndarray) -> DataFrame:
    """Most probable state path for known Gaussian states.

    A frame is a max-plus matrix from the state before to its own.  Products of halves give for every segment of a track
    the best score from each entry to each exit state; the same products over the segments fix where each starts and ends,
    and then every segment finds its states from the middle outwards.  A track of n frames takes log n vector steps.
    """
    lt, li = np.log(np.clip(transition, 1e-12, None)), np.log(np.clip(init, 1e-12, None))
    sc = np.clip(scale, 1e-6, None)
    k, dim = loc.shape
    seg = _segments(df)
    tt = {f.name: f.dataType.simpleString() for f in df.schema.fields}["track_id"]

    def steps(pdf: pd.DataFrame) -> np.ndarray:
        d = (pdf[cols].to_numpy(float)[:, None, :] - loc[None]) / sc[None]
        e = -0.5 * (d * d).sum(2) - np.log(sc).sum(1) - 0.5 * dim * np.log(2 * np.pi)
        out = lt[None] + e[:, None, :]
        if pdf["_seg"].iloc[0] == 0:
            out[0] = li + e[0]  # whatever the state before
        return out

    def matrix(pdf: pd.DataFrame) -> pd.DataFrame:
        m = _levels(steps(pdf.sort_values("frame")))[-1][0]
        return pd.DataFrame({"track_id": [pdf["track_id"].iloc[0]], "_seg": [pdf["_seg"].iloc[0]], "m": [m.ravel().tolist()]})

    mats = cut_lineage(seg.groupBy("track_id", "_seg").applyInPandas(matrix, f"track_id {tt}, _seg long, m array<double>"))

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_seg")
        levels = _levels(np.array(pdf["m"].tolist(), float).reshape(-1, k, k))
        ends = _best_states(levels, 0, int(levels[-1][0][0].argmax()), len(pdf))
        return pd.DataFrame({"track_id": pdf["track_id"].to_numpy(), "_seg": pdf["_seg"].to_numpy(), "entry": np.r_[0, ends[:-1]], "exit": ends})

    # one row per segment: frames / segment_rows rows per track
    ends = mats.groupBy("track_id").applyInPandas(chain, f"track_id {tt}, _seg long, entry int, exit int")

    def decode(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame")
        path = _best_states(_levels(steps(pdf)), int(pdf["entry"].iloc[0]), int(pdf["exit"].iloc[0]), len(pdf))
        return pd.DataFrame({"track_id": pdf["track_id"].to_numpy(), "frame": pdf["frame"].to_numpy(), "state": path})

    return seg.join(ends, ["track_id", "_seg"]).groupBy("track_id", "_seg").applyInPandas(decode, f"track_id {tt}, frame long, state int")


def kalman_gains(n: int, q_pos: float, q_vel: float, r: float, dt: float = 1.0) -> np.ndarray:
    """Gains of the constant-velocity filter; they do not depend on the data and settle quickly."""
    a, h = np.array([[1, dt], [0, 1.0]]), np.array([[1.0, 0]])
    q, p, out = np.diag([q_pos, q_vel]), np.eye(2), []
    for _ in range(n):
        p = a @ p @ a.T + q
        k = (p @ h.T) / (h @ p @ h.T + r)
        p = (np.eye(2) - k @ h) @ p
        out.append(k[:, 0])
        if len(out) > 2 and np.abs(out[-1] - out[-2]).max() < 1e-15:
            break
    return np.array(out)


def kalman(df: DataFrame, q_pos: float = 0.01, q_vel: float = 0.1, r: float = 1.0, jump: float = 10.0) -> DataFrame:
    """Filtered positions and a flag where the innovation exceeds ``jump``.

    The gains depend on the frame number only, so a segment is an affine map of the state it starts from: every segment
    is run once from zero to get its map, the maps are chained per track, and every segment is run from its true start.
    """
    longest = df.groupBy("track_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1
    gains = kalman_gains(longest, q_pos, q_vel, r)  # until they settle, or for the longest track
    a = np.array([[1, 1.0], [0, 1.0]])
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    tt, ft = types["track_id"], types["frame"]
    seg = _segments(df)

    def run(z, frames, s):
        """z: (n, 2) measurements; s: (2 components, 2 axes) state before the first of them."""
        out, inn = np.empty((len(z), 2)), np.empty(len(z))
        for i in range(len(z)):
            if frames[i] == 0:
                s = np.array([z[i], [0.0, 0.0]])
            s = a @ s
            e = z[i] - s[0]
            s = s + gains[min(int(frames[i]), len(gains) - 1)][:, None] * e[None, :]
            out[i], inn[i] = s[0], np.hypot(*e)
        return out, inn, s

    def affine(pdf):
        pdf = pdf.sort_values("frame")
        fr = pdf["frame"].to_numpy()
        z = pdf[["x", "y"]].to_numpy(float)
        b = run(z, fr, np.zeros((2, 2)))[2]
        m = np.eye(2)
        if fr[0] == 0:
            m = np.zeros((2, 2))
        else:
            for f in fr:
                kk = gains[min(int(f), len(gains) - 1)]
                m = (np.eye(2) - np.outer(kk, [1.0, 0.0])) @ a @ m
                if np.abs(m).max() < 1e-300:
                    m[:] = 0
                    break
        return pd.DataFrame({"track_id": [pdf["track_id"].iloc[0]], "_seg": [pdf["_seg"].iloc[0]], "m": [m.ravel().tolist()], "b": [b.ravel().tolist()]})

    maps = cut_lineage(seg.groupBy("track_id", "_seg").applyInPandas(affine, f"track_id {tt}, _seg long, m array<double>, b array<double>"))

    def chain(pdf):
        pdf = pdf.sort_values("_seg")
        s, out = np.zeros((2, 2)), []
        for m, b in zip(pdf["m"], pdf["b"]):
            out.append(s.ravel().tolist())
            s = np.array(m).reshape(2, 2) @ s + np.array(b).reshape(2, 2)
        return pd.DataFrame({"track_id": pdf["track_id"].to_numpy(), "_seg": pdf["_seg"].to_numpy(), "s": out})

    starts = maps.groupBy("track_id").applyInPandas(chain, f"track_id {tt}, _seg long, s array<double>")  # one row per segment

    def smooth(pdf):
        pdf = pdf.sort_values("frame")
        out, inn, _ = run(pdf[["x", "y"]].to_numpy(float), pdf["frame"].to_numpy(), np.array(pdf["s"].iloc[0]).reshape(2, 2))
        return pd.DataFrame({"track_id": pdf["track_id"].to_numpy(), "frame": pdf["frame"].to_numpy(), "x": pdf["x"].to_numpy(), "y": pdf["y"].to_numpy(), "xs": out[:, 0], "ys": out[:, 1], "innovation": inn, "flag": inn > jump})

    return seg.join(starts, ["track_id", "_seg"]).groupBy("track_id", "_seg").applyInPandas(smooth, f"track_id {tt}, frame {ft}, x double, y double, xs double, ys double, innovation double, flag boolean")


def displacement(df: DataFrame, pixel_size: float = 1.0) -> DataFrame:
    """Total path, net drift and mean shift per track."""
    s = steps(df)
    return s.groupBy(*KEY).agg((F.sum("step") * pixel_size).alias("path"), (F.sqrt(F.pow(F.sum("dx"), 2) + F.pow(F.sum("dy"), 2)) * pixel_size).alias("net"), F.avg("dx").alias("mean_dx"), F.avg("dy").alias("mean_dy"))


def squared_displacement(df: DataFrame) -> DataFrame:
    """Mean squared step and D = msd / 4."""
    s = steps(df).groupBy(*KEY).agg(F.avg(F.col("step") * F.col("step")).alias("msd"))
    return s.withColumn("d", F.col("msd") / 4)


def assign_nearest(a: DataFrame, b: DataFrame, keys: list[str], gate: float) -> DataFrame:
    """Link points of two frames (``keys, id, x, y``) that are each other's nearest free point within ``gate``.

    Candidates come from a grid with ``gate``-sized cells, so only points of neighbouring cells ever meet.  Every round
    links at least the closest pair left, and rounds go on until no candidate remains.
    """
    cell = lambda c: F.floor(F.col(c) / gate).cast("long")
    near = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    left = a.select(*keys, F.col("id").alias("id_a"), F.col("x").alias("xa"), F.col("y").alias("ya"))
    left = left.withColumn("cx", F.explode(F.transform(near, lambda d: d + F.floor(F.col("xa") / gate)))).withColumn("cy", F.explode(F.transform(near, lambda d: d + F.floor(F.col("ya") / gate))))
    right = b.select(*keys, F.col("id").alias("id_b"), F.col("x").alias("xb"), F.col("y").alias("yb"), cell("x").alias("cx"), cell("y").alias("cy"))
    d = F.sqrt(F.pow(F.col("xa") - F.col("xb"), 2) + F.pow(F.col("ya") - F.col("yb"), 2))
    cand = cut_lineage(left.join(right, [*keys, "cx", "cy"]).select(*keys, "id_a", "id_b", d.alias("dist")).filter(F.col("dist") <= gate))
    links, passed = None, 0
    while True:
        passed += 1
        best_a = cand.groupBy(*keys, "id_a").agg(F.min_by("id_b", F.struct("dist", "id_b")).alias("id_b"), F.min("dist").alias("dist"))
        best_b = cand.groupBy(*keys, "id_b").agg(F.min_by("id_a", F.struct("dist", "id_a")).alias("id_a"))
        new = cut_lineage(best_a.join(best_b, [*keys, "id_a", "id_b"]).select(*keys, "id_a", "id_b", "dist", F.lit(passed).alias("round")))
        links = new if links is None else links.unionByName(new)
        cand = cut_lineage(cand.join(new.select(*keys, "id_a"), [*keys, "id_a"], "left_anti").join(new.select(*keys, "id_b"), [*keys, "id_b"], "left_anti"))
        if cand.isEmpty():
            return links
