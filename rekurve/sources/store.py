"""Parquet/CSV tables for traces, features and experiments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def save_table(df: DataFrame, path: str, fmt: str = "parquet", by: list[str] | None = None) -> None:
    for f in ("parquet", "csv") if fmt == "both" else (fmt,):
        w = df.write.mode("overwrite")
        w = w.partitionBy(*by) if by else w
        if f == "csv":
            w = w.option("header", True)
        w.format(f).save(f"{path}.{f}")


def load_table(spark: SparkSession, path: str, fmt: str = "parquet", schema=None) -> DataFrame:
    r = spark.read.option("header", True).format(fmt)
    return (r.schema(schema) if schema is not None else r).load(f"{path}.{fmt}")


def cohort(features: DataFrame, condition=None, experiment=None, cluster=None, outlier=None, min_r2=None) -> DataFrame:
    """Rows that meet every given criterion; lists mean membership."""
    out = features
    for col, want in (("condition", condition), ("exp_id", experiment), ("cluster", cluster), ("outlier", outlier)):
        if want is not None:
            out = out.filter(F.col(col).isin(want) if isinstance(want, (list, tuple)) else F.col(col) == want)
    return out.filter(F.col("r2") >= min_r2) if min_r2 is not None else out


def traces_of(traces: DataFrame, chosen: DataFrame, keys: list[str]) -> DataFrame:
    return traces.join(chosen.select(*keys), keys, "left_semi")


def orphans(traces: DataFrame, features: DataFrame, keys: list[str]) -> DataFrame:
    """Cells that have traces but no features."""
    return traces.select(*keys).distinct().join(features, keys, "left_anti")


def delete_cascade(tables: dict[str, DataFrame], keys: dict[str, str], gone: DataFrame, key: str) -> dict[str, DataFrame]:
    """Each table without the rows that belong to the deleted parents."""
    return {n: t.join(gone.select(F.col(key).alias(keys[n])), keys[n], "left_anti") for n, t in tables.items()}


def members(groups: DataFrame, bridge: DataFrame, files: DataFrame, group: str, file: str) -> DataFrame:
    return bridge.join(groups, group).join(files, file)


def catalogue(features: DataFrame, dataset: list[str], cell: str, condition: str, experiment: str) -> DataFrame:
    return features.groupBy(*dataset).agg(
        F.count_distinct(cell).alias("n_cells"), F.count_distinct(condition).alias("n_conditions"), F.count_distinct(experiment).alias("n_experiments")
    )


def explode_curves(df: DataFrame, ids: list[str], time: str, values: str) -> DataFrame:
    """Array columns to one row per point."""
    z = df.select(*ids, F.posexplode(F.arrays_zip(F.col(time).alias("t"), F.col(values).alias("y"))).alias("frame", "p"))
    return z.select(*ids, "frame", F.col("p.t").alias("t"), F.col("p.y").alias("y"))


def collect_curves(df: DataFrame, ids: list[str], frame: str = "frame", chunk: int = 65536) -> DataFrame:
    """Points to arrays, at most ``chunk`` points per row, so that a very long curve becomes several rows."""
    g = df.groupBy(*ids, F.floor(F.col(frame) / chunk).cast("long").alias("chunk")).agg(F.sort_array(F.collect_list(F.struct(frame, "t", "y"))).alias("_p"))
    return g.select(*ids, "chunk", F.col("_p.t").alias("t"), F.col("_p.y").alias("y"))


def cell_key(batch: Column, movie: Column, cell: Column) -> Column:
    return F.concat_ws("::", batch.cast("string"), movie.cast("string"), cell.cast("string"))


def safe_id(text: Column) -> Column:
    return F.regexp_replace(text, r"[^0-9A-Za-z_]", "_")


def export_summaries(tables: dict[str, DataFrame], meta: dict, path: str) -> None:
    """Named summary tables as CSV next to a one-row JSON description."""
    for name, t in tables.items():
        t.write.mode("overwrite").option("header", True).csv(f"{path}/{name}")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(k, str(v)) for k, v in meta.items()], "key string, value string").write.mode("overwrite").json(f"{path}/metadata")
