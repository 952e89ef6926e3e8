"""Tables of the reference's shapes, made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def feature_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points with features, from embeddings: (video_id, frame_idx, point_id, x, y, z, vx, vy, vz, feat, blob_id, hyperblob_id)."""
    at = lambda i: F.col("embedding")[i].cast("double")
    return read(spark, sf_dir, "embeddings").select(
        F.lit("v").alias("video_id"), (F.col("vec_id") % 5).cast("int").alias("frame_idx"), F.col("vec_id").alias("point_id"),
        *[at(i).alias(c) for i, c in enumerate(("x", "y", "z", "vx", "vy", "vz"))],
        F.transform(F.slice("embedding", 7, 32), lambda c: c.cast("double")).alias("feat"), F.col("label").alias("blob_id"), (F.col("label") % 4).alias("hyperblob_id"),
    )


FEATURE_POINTS = """points AS (SELECT 'v' AS video_id, CAST(vec_id % 5 AS INTEGER) AS frame_idx, vec_id AS point_id,
 CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z,
 CAST(embedding[4] AS DOUBLE) AS vx, CAST(embedding[5] AS DOUBLE) AS vy, CAST(embedding[6] AS DOUBLE) AS vz,
 list_transform(embedding[7:38], lambda c: CAST(c AS DOUBLE)) AS feat, label AS blob_id, label % 4 AS hyperblob_id FROM embeddings)"""


def tracked_points(spark: SparkSession, sf_dir: str, hypers: bool = True) -> DataFrame:
    """Many points without features, from lineitem: video = return flag, frame = month, blob = supplier, hyperblob (if wanted) = its nation."""
    line = read(spark, sf_dir, "lineitem")
    q = F.col("l_quantity")
    points = line.select(
        F.col("l_returnflag").alias("video_id"), (F.year("l_shipdate") * 12 + F.month("l_shipdate") - 23904).alias("frame_idx"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("point_id"),
        q.alias("x"), (F.sqrt("l_extendedprice") / 10).alias("y"), (F.col("l_discount") * 100).alias("z"),
        (F.col("l_tax") * 10).alias("vx"), (F.col("l_discount") - F.col("l_tax")).alias("vy"), (F.col("l_tax") * q / 50).alias("vz"), F.col("l_suppkey").alias("blob_id"),
    )
    if not hypers:
        return points
    supplier = read(spark, sf_dir, "supplier")
    return points.join(supplier.select(F.col("s_suppkey").alias("blob_id"), F.col("s_nationkey").alias("hyperblob_id")), "blob_id", "left")


TRACKED_POINTS = """points AS (SELECT l_returnflag AS video_id, year(l_shipdate) * 12 + month(l_shipdate) - 23904 AS frame_idx, l_orderkey * 8 + l_linenumber AS point_id,
 l_quantity AS x, sqrt(l_extendedprice) / 10 AS y, l_discount * 100 AS z, l_tax * 10 AS vx, l_discount - l_tax AS vy, l_tax * l_quantity / 50 AS vz,
 l_suppkey AS blob_id, s_nationkey AS hyperblob_id FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey)"""


def label_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label maps, from orders: pixel = order, frame = quarter, gt = priority code, pred = status code; 0 is background."""
    o = read(spark, sf_dir, "orders")
    return o.select(
        F.lit("v").alias("video_id"), ((F.year("o_orderdate") - 1995) * 4 + F.quarter("o_orderdate")).alias("frame_idx"), F.col("o_orderkey").alias("px"),
        (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("gt"), (F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2) + F.col("o_custkey") % 2).cast("int").alias("pred"),
        (F.col("o_custkey") % 40).cast("int").alias("blob_id"), F.col("o_totalprice").alias("score"),
    )


LABEL_PIXELS = """pixels AS (SELECT 'v' AS video_id, (year(o_orderdate) - 1995) * 4 + quarter(o_orderdate) AS frame_idx, o_orderkey AS px,
 CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 1 AS gt, CAST(CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END + o_custkey % 2 AS INTEGER) AS pred,
 CAST(o_custkey % 40 AS INTEGER) AS blob_id, o_totalprice AS score FROM orders)"""


def stream_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Asynchronous streams, from events: (stream, entity, ts, seq, value)."""
    return read(spark, sf_dir, "events").select(F.col("event_type").alias("stream"), F.col("user_id").alias("entity"), "ts", F.col("event_id").alias("seq"), "value")


STREAM_EVENTS = "ev AS (SELECT event_type AS stream, user_id AS entity, ts, event_id AS seq, value FROM events)"
