"""Live forms of stateful operators on Structured Streaming.

Each one has a batch counterpart with the same rows; state per key is a few numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _DropDetector(StatefulProcessor):
    """Reports the first frame that lost more than ``threshold`` of the previous value."""

    def __init__(self, threshold: float):
        self.threshold = threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("last", "seen long, value double, total double, done boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        s = self.state.get() if self.state.exists() else None
        seen, last, total, done = s if s is not None else (0, 0.0, 0.0, False)
        b = pd.concat(list(rows)).sort_values(["us", "event_id"])  # one micro-batch of one curve
        v = b["y"].to_numpy(float)
        hit = None
        if not done:
            prev = np.r_[last if seen else np.nan, v[:-1]]
            with np.errstate(divide="ignore", invalid="ignore"):
                drop = np.flatnonzero((prev - v) / prev > self.threshold)
            if len(drop):
                hit, done = int(drop[0]), True
        if hit is not None:
            n = seen + hit
            yield pd.DataFrame({"curve_id": [key[0]], "bleach": [n], "pre_mean": [float((total + v[:hit].sum()) / n)]})
        self.state.update((seen + len(v), float(v[-1]), float(total + v.sum()), done))

    def close(self) -> None:
        pass


def live_bleach(stream: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Rows ``curve_id, us, event_id, y`` in time order per curve; one row per curve when its bleach is seen."""
    out = StructType([StructField("curve_id", LongType()), StructField("bleach", LongType()), StructField("pre_mean", DoubleType())])
    return stream.groupBy("curve_id").transformWithStateInPandas(_DropDetector(threshold), outputStructType=out, outputMode="Append", timeMode="None")


class _Smoother(StatefulProcessor):
    """Constant-velocity filter; the state is frame number, position, velocity and their covariance, from which the next gain follows."""

    def __init__(self, q_pos: float, q_vel: float, r: float, jump: float):
        self.q_pos, self.q_vel, self.r, self.jump = q_pos, q_vel, r, jump

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("motion", "frame long, x double, y double, vx double, vy double, pp double, pv double, vv double")

    def handleInputRows(self, key, rows, timerValues):
        s = self.state.get() if self.state.exists() else None
        frame, x, y, vx, vy, pp, pv, vv = s if s is not None else (0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 1.0)
        b = pd.concat(list(rows)).sort_values("seq")
        out = []
        for seq, zx, zy in zip(b["seq"], b["x"], b["y"]):
            if frame == 0:
                x, y, vx, vy = zx, zy, 0.0, 0.0
            pp, pv, vv = pp + 2 * pv + vv + self.q_pos, pv + vv, vv + self.q_vel
            k = pp / (pp + self.r), pv / (pp + self.r)
            pp, pv, vv = (1 - k[0]) * pp, (1 - k[0]) * pv, vv - k[1] * pv
            px, py = x + vx, y + vy
            ex, ey = zx - px, zy - py
            x, y, vx, vy = px + k[0] * ex, py + k[0] * ey, vx + k[1] * ex, vy + k[1] * ey
            out.append((key[0], frame, x, y, float(np.hypot(ex, ey)) > self.jump))
            frame += 1
        self.state.update((frame, *map(float, (x, y, vx, vy, pp, pv, vv))))
        yield pd.DataFrame(out, columns=["track_id", "frame", "xs", "ys", "flag"])

    def close(self) -> None:
        pass


def live_positions(stream: DataFrame, q_pos: float = 0.01, q_vel: float = 0.1, r: float = 1.0, jump: float = 10.0) -> DataFrame:
    """Rows ``track_id, seq, x, y``; smoothed positions and a motion flag."""
    out = StructType([StructField("track_id", LongType()), StructField("frame", LongType()), StructField("xs", DoubleType()), StructField("ys", DoubleType()), StructField("flag", BooleanType())])
    return stream.groupBy("track_id").transformWithStateInPandas(_Smoother(q_pos, q_vel, r, jump), outputStructType=out, outputMode="Append", timeMode="None")


def live_means(stream: DataFrame, time: str, group: str, value: str, width: str = "1 day", late: str = "10 minutes") -> DataFrame:
    """Z3: mean, spread and count per group and tumbling window, emitted once a window can no longer change."""
    w = stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), group)
    g = w.agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.count(F.lit(1)).alias("n"))
    return g.select(F.col("w.start").alias("start"), group, "mean", "sd", "n")


def run_available(stream: DataFrame, path: str) -> DataFrame:
    """Process what is there now into Parquet below ``path`` and return the result as a batch table."""
    spark = stream.sparkSession
    was = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        q = stream.writeStream.format("parquet").option("checkpointLocation", f"{path}/checkpoint").option("path", f"{path}/out").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", was)
    return spark.read.schema(stream.schema).parquet(f"{path}/out")
