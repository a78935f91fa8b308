"""Roles the driver tables play as inputs: the Spark form and the same rows as a SQL common table expression."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rekurve.operators.ordered import attach, frame_index, unbound


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def curves(spark, sf) -> DataFrame:
    """B1: one curve per user; t in days since the user's first event."""
    ev = table(spark, sf, "events").select(
        F.col("user_id").alias("curve_id"), "event_id", F.expr("unix_micros(cast(ts as timestamp))").alias("us"),
        F.col("value").alias("y"),
    )
    framed = attach(frame_index(ev, ["curve_id"], ["us", "event_id"]), ["curve_id"], us0=F.min("us"))
    return framed.select("curve_id", "frame", "event_id", ((F.col("us") - F.col("us0")) / 86400000000.0).alias("t"), "y")


B1 = """b1 AS (SELECT user_id AS curve_id, event_id, value AS y,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame,
  (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 86400000000.0 AS t FROM events)"""


def curve_groups(spark, sf) -> DataFrame:
    c = table(spark, sf, "customer")
    return c.select(F.col("c_custkey").alias("curve_id"), F.col("c_mktsegment").alias("grp"))


GRP = "grp AS (SELECT c_custkey AS curve_id, c_mktsegment AS grp FROM customer)"
B1G = B1 + ", " + GRP + ", b1g AS (SELECT b1.*, coalesce(grp, 'none') AS grp FROM b1 LEFT JOIN grp USING (curve_id))"


def grouped_curves(spark, sf) -> DataFrame:
    j = curves(spark, sf).join(curve_groups(spark, sf), "curve_id", "left")
    return j.withColumn("grp", F.coalesce("grp", F.lit("none")))


def roi_frames(spark, sf) -> DataFrame:
    """B2: one three-region recording per supplier."""
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
    li = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("curve_id"), *order, "l_quantity", "l_tax", "l_discount"
    )
    return frame_index(li, ["curve_id"], order).select(
        "curve_id", "frame", F.col("frame").cast("double").alias("t"), F.col("l_extendedprice").alias("roi1"),
        (F.col("l_quantity") * 1000).alias("roi2"), (F.col("l_tax") * 1000).alias("roi3"),
        F.col("l_discount").alias("disc"),
    )


B2 = """b2 AS (SELECT curve_id, frame, CAST(frame AS DOUBLE) AS t, roi1, roi2, roi3, disc FROM (SELECT l_suppkey AS curve_id,
  row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS frame,
  l_extendedprice AS roi1, l_quantity * 1000 AS roi2, l_tax * 1000 AS roi3, l_discount AS disc FROM lineitem))"""


def cells(spark, sf) -> DataFrame:
    """One feature row per customer that has orders."""
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("cell_id")).agg(
        F.avg("o_totalprice").alias("price"), F.stddev_samp("o_totalprice").alias("spread"),
        F.count(F.lit(1)).alias("n"),
    )
    c = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("cell_id"), F.col("c_acctbal").alias("bal"), F.col("c_mktsegment").alias("grp"),
        F.col("c_nationkey").alias("batch"),
    )
    return o.join(c, "cell_id").select("cell_id", "grp", "batch", "price", "spread", "n", "bal")


B3 = """b3 AS (SELECT c_custkey AS cell_id, c_mktsegment AS grp, c_nationkey AS batch, price, spread, n, c_acctbal AS bal
  FROM (SELECT o_custkey, avg(o_totalprice) AS price, stddev_samp(o_totalprice) AS spread, count(*) AS n FROM orders GROUP BY 1)
  JOIN customer ON o_custkey = c_custkey)"""


def samples(spark, sf) -> DataFrame:
    """Grouped values."""
    return table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("grp"), F.col("l_linenumber").alias("line"), F.col("l_extendedprice").alias("value"),
        F.col("l_discount").alias("tied"), F.col("l_quantity").alias("qty"), F.col("l_suppkey").alias("batch"),
        F.col("l_orderkey").alias("okey"), F.col("l_tax").alias("tax"),
    )


B4 = """b4 AS (SELECT l_returnflag AS grp, l_linenumber AS line, l_extendedprice AS value, l_discount AS tied, l_quantity AS qty,
  l_suppkey AS batch, l_orderkey AS okey, l_tax AS tax FROM lineitem)"""


def tracks(spark, sf) -> DataFrame:
    """One track per label."""
    e = table(spark, sf, "embeddings").select(F.col("label").alias("track_id"), "vec_id", "embedding")
    return frame_index(e, ["track_id"], ["vec_id"]).select(
        "track_id", "frame", (F.col("embedding")[0].cast("double") * 100).alias("x"),
        (F.col("embedding")[1].cast("double") * 100).alias("y"),
    )


B5 = """b5 AS (SELECT label AS track_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame,
  embedding[1]::DOUBLE * 100 AS x, embedding[2]::DOUBLE * 100 AS y FROM embeddings)"""


def contours(spark, sf) -> DataFrame:
    """A contour per vector, 64 points."""
    e = table(spark, sf, "embeddings").select(
        F.col("label").alias("object_id"), F.col("vec_id").alias("frame"), F.posexplode("embedding").alias("point_idx", "v")
    )
    r, a = 5 + F.col("v").cast("double"), F.col("point_idx") * (2 * 3.141592653589793 / 64)
    return e.select("object_id", "frame", "point_idx", (r * F.cos(a)).alias("x"), (r * F.sin(a)).alias("y"), r.alias("r"))


B6 = """b6 AS (SELECT object_id, frame, point_idx, r, r * cos(point_idx * (2 * 3.141592653589793 / 64)) AS x,
  r * sin(point_idx * (2 * 3.141592653589793 / 64)) AS y FROM (SELECT label AS object_id, vec_id AS frame, i - 1 AS point_idx,
  5 + embedding[i]::DOUBLE AS r FROM embeddings, range(1, 65) g(i)))"""


def pixels(spark, sf) -> DataFrame:
    """8x8 image stacks, one per label."""
    e = table(spark, sf, "embeddings").select(F.col("label").alias("stack_id"), "vec_id", "embedding")
    f = unbound(frame_index(e, ["stack_id"], ["vec_id"]))
    p = f.select("stack_id", "frame", F.posexplode("embedding").alias("i", "e"))
    return p.select(
        "stack_id", "frame", F.expr("cast(i div 8 as int)").alias("py"), F.expr("cast(i % 8 as int)").alias("px"),
        (100 * (1 + F.col("e").cast("double"))).alias("v"),
    )


B7 = """b7 AS (SELECT stack_id, frame, (i - 1) // 8 AS py, (i - 1) % 8 AS px, 100 * (1 + embedding[i]::DOUBLE) AS v FROM
  (SELECT label AS stack_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame, embedding FROM embeddings),
  range(1, 65) g(i))"""


def library(spark, sf) -> DataFrame:
    """A reference library of measured species."""
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("ref_id"), F.col("p_type").alias("cls"), F.col("p_name").alias("name"),
        F.col("p_brand").alias("compartment"), F.col("p_size").cast("double").alias("mw"),
        (F.col("p_retailprice") / 100).alias("diff_coef"), (F.col("p_partkey") % 101).cast("double").alias("mobile"),
    )


B8 = """b8 AS (SELECT p_partkey AS ref_id, p_type AS cls, p_name AS name, p_brand AS compartment, p_size::DOUBLE AS mw,
  p_retailprice / 100 AS diff_coef, (p_partkey % 101)::DOUBLE AS mobile FROM part)"""


def draws(spark, sf) -> DataFrame:
    """Posterior-style draws."""
    return table(spark, sf, "events").select(
        (F.col("event_id") % 4).alias("chain"), F.expr("event_id div 4").alias("draw"),
        F.col("event_type").alias("param"), "value", F.col("user_id").alias("cell_id"),
    )


B11 = """b11 AS (SELECT event_id % 4 AS chain, event_id // 4 AS draw, event_type AS param, value, user_id AS cell_id FROM events)"""
