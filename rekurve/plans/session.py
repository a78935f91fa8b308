"""Session helpers: settings used by tests and the bench, and lineage cutting."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

STAGES: list[str] = []  # paths that this process staged


def local_session(cores: str = "8", shuffle: str = "8") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("rekurve")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", shuffle)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "false")  # few cores: keep every one busy
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write to a table in the shared folder and read it back: survives lost executors, and its size is then known."""
    path = shared_scratch(df.sparkSession, "stage")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_scratch(spark: SparkSession, tag: str) -> str:
    """A fresh path below the shared folder that the cluster names in ``spark.checkpoint.dir``.

    Where none is set, a local session gets a temporary folder that goes with it; on a cluster that is an error, because executors
    would write where the driver and other executors can't read.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        sc = spark.sparkContext
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that driver and executors share: {sc.master} is no local master")
        base = getattr(sc, "_rekurve_scratch", None)
        if base is None:
            base = sc._rekurve_scratch = tempfile.mkdtemp(prefix="rekurve-")
            atexit.register(shutil.rmtree, base, ignore_errors=True)
    path = f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    STAGES.append(path)
    return path


def drop_stages(spark: SparkSession) -> int:
    """Remove the tables that this session staged so far; call it when no result that reads them is needed any more."""
    jvm, n = spark.sparkContext._jvm, 0
    while STAGES:
        path = jvm.org.apache.hadoop.fs.Path(STAGES.pop())
        n += path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return n


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the executors' Python workers, once per Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_rekurve_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    base = os.path.join(tempfile.mkdtemp(prefix="rekurve-"), "rekurve")
    sc.addPyFile(shutil.make_archive(base, "zip", root, "rekurve"))  # Spark copies it to every executor
    sc._rekurve_shipped = True
