"""Column resolution and schema checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

# Accepted name parts per standard column of a recording.
ALIASES = {
    "time": ["time", "time (s)", "seconds", "sec"],
    "roi1": ["roi1", "intensity1", "intensity of region 1", "region 1", "bleach"],
    "roi2": ["roi2", "intensity2", "intensity of region 2", "region 2", "control"],
    "roi3": ["roi3", "intensity3", "intensity of region 3", "region 3", "background"],
}
# Optional motion columns carried along when present.
STABILIZATION = ["roi_centroid_x", "roi_centroid_y", "roi_radius", "stabilization_dx", "stabilization_dy", "displacement", "motion_flag"]

_TYPES = {"STRING": T.StringType(), "INT": T.IntegerType(), "DOUBLE": T.DoubleType(), "BOOLEAN": T.BooleanType()}


def _struct(ddl: str) -> T.StructType:
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in (f.split() for f in ddl.split(", "))])


TRACES = _struct(
    "exp_id STRING, movie_id STRING, cell_id INT, frame INT, t DOUBLE, x DOUBLE, y DOUBLE, radius DOUBLE, signal_raw DOUBLE, "
    "signal_bg DOUBLE, signal_corr DOUBLE, signal_norm DOUBLE, qc_motion BOOLEAN, qc_reason STRING"
)
FEATURES = _struct(
    "exp_id STRING, movie_id STRING, cell_id INT, pre_bleach DOUBLE, I0 DOUBLE, I_inf DOUBLE, k DOUBLE, t_half DOUBLE, mobile_frac DOUBLE, "
    "r2 DOUBLE, sse DOUBLE, drift_px DOUBLE, bleach_qc BOOLEAN, roi_method STRING, outlier BOOLEAN, cluster INT, cluster_prob DOUBLE, "
    "plateau DOUBLE, amp DOUBLE, fit_method STRING, aic DOUBLE, bic DOUBLE"
)


def resolve_columns(columns: list[str], aliases: dict[str, list[str]] = ALIASES, exact: bool = False) -> dict[str, str]:
    """Standard name -> source column: first column containing an alias; with four or more columns, position fills gaps."""
    found: dict[str, str] = {}
    for std, names in aliases.items():
        for c in columns:
            low = c.strip().lower()
            if c not in found.values() and (low in names if exact else any(n in low for n in names)):
                found[std] = c
                break
    if len(found) < len(aliases) and not exact and len(columns) >= len(aliases):
        return dict(zip(aliases, columns))
    missing = [s for s in aliases if s not in found]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return found


def standardize(df: DataFrame, keep: list[str] = (), aliases: dict[str, list[str]] = ALIASES) -> DataFrame:
    """Select the standard columns under their standard names, plus ``keep`` and any stabilization columns present."""
    have = {c.lower(): c for c in df.columns}
    found = resolve_columns([c for c in df.columns if c not in keep], aliases)
    cols = [F.col(f"`{src}`").cast("double").alias(std) for std, src in found.items()]
    extra = [F.col(have[c]) for c in STABILIZATION if c in have]
    return df.select(*keep, *cols, *extra)


def with_stabilization(df: DataFrame) -> DataFrame:
    """Every stabilization column, NULL where the input lacks it."""
    have = {c.lower() for c in df.columns}
    return df.select("*", *[F.lit(None).cast("double").alias(c) for c in STABILIZATION if c not in have])


def missing_columns(spark: SparkSession, df: DataFrame, required: T.StructType) -> DataFrame:
    """One row per required column: present or not, expected and actual type."""
    have = {f.name.lower(): f.dataType.simpleString() for f in df.schema.fields}
    rows = [(f.name, f.dataType.simpleString(), have.get(f.name.lower()), f.name.lower() in have) for f in required.fields]
    return spark.createDataFrame(rows, "column_name string, expected string, actual string, present boolean")


def validate(df: DataFrame, required: T.StructType) -> tuple[bool, str]:
    have = {c.lower() for c in df.columns}
    gone = [f.name for f in required.fields if f.name.lower() not in have]
    return (not gone, "ok" if not gone else "missing columns: " + ", ".join(gone))


def long_format(df: DataFrame, cell: str, time: str, intensity: str, condition: str | None = None, batch: str | None = None) -> DataFrame:
    """Canonical long table; a missing or NULL batch becomes ``batch_0``."""
    gone = [c for c in (cell, time, intensity) if c not in df.columns]
    if gone:
        raise ValueError(f"missing columns: {', '.join(gone)}")
    cond = F.col(condition).cast("string") if condition else F.lit("all")
    b = F.col(batch).cast("string") if batch else F.lit(None).cast("string")
    return df.select(
        F.col(cell).cast("string").alias("cell_uid"), cond.alias("condition"), F.coalesce(b, F.lit("batch_0")).alias("batch"),
        F.col(time).cast("double").alias("time"), F.col(intensity).cast("double").alias("intensity"),
    )
