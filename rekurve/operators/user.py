"""User table functions on curves (V3)."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from rekurve.operators.ordered import segment_rows


def per_curve(df: DataFrame, fn: Callable[[pd.DataFrame], dict], schema: str, key: str = "curve_id") -> DataFrame:
    """Apply ``fn`` to the frames of each curve segment; a curve longer than a segment gives several rows to combine."""
    kt = {f.name: f.dataType.simpleString() for f in df.schema.fields}[key]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{key: pdf[key].iloc[0], "segment": pdf["_seg"].iloc[0], **fn(pdf.sort_values("frame"))}])

    seg = df.withColumn("_seg", F.floor(F.col("frame") / segment_rows(df)).cast("long"))
    return seg.groupBy(key, "_seg").applyInPandas(run, f"`{key}` {kt}, segment long, {schema}")
