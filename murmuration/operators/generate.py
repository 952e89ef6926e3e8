"""The generative model as tables: hyperblobs, blobs, points. Every number hangs on (seed, level, id, dimension)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmuration.operators.densities import normal
from murmuration.operators.scoring import small, uniform


def simulate(spark: SparkSession, points: int, blobs: int, hyperblobs: int, dims: int, frames: int = 1, seed: int = 0, spread: tuple[float, float, float] = (2.0, 0.5, 0.1)) -> DataFrame:
    """(video_id, frame_idx, point_id, x, y, z, vx, vy, vz, feat, blob_id, hyperblob_id): points of blobs of hyperblobs, moving with their hyperblob.

    Parameters are expressions of ids, so that nothing is joined or shuffled, whatever the number of points.
    """
    p = spark.range(points).crossJoin(spark.range(frames).select(F.col("id").cast("int").alias("frame_idx"))).withColumnRenamed("id", "point_id")
    p = p.withColumn("blob_id", (uniform(F.lit(seed), F.lit("b"), "point_id") * blobs).cast("int")).withColumn("hyperblob_id", F.col("blob_id") % hyperblobs)
    at = lambda c, k, s: s * normal(F.lit(seed), F.lit(c), k)
    axis = {c: at(f"h{c}", "hyperblob_id", spread[0]) + at(f"b{c}", "blob_id", spread[1]) + at(f"p{c}", "point_id", spread[2]) for c in "xyz"}
    v = {c: at(f"hv{c}", "hyperblob_id", 0.1) for c in "xyz"}
    feat = F.array(*[at(f"hf{i}", "hyperblob_id", 1.0) + at(f"bf{i}", "blob_id", 0.3) + at(f"pf{i}", "point_id", 0.1) for i in range(dims)]) if dims else F.array().cast("array<double>")
    return p.select(F.lit("v").alias("video_id"), "frame_idx", "point_id", *[(axis[c] + F.col("frame_idx") * v[c]).alias(c) for c in "xyz"], *[v[c].alias(f"v{c}") for c in "xyz"], feat.alias("feat"), "blob_id", "hyperblob_id")


def predicted_points(points: DataFrame, row: str, group: str, axes: tuple[str, ...], seed: int = 0) -> DataFrame:
    """(row, group, axes): for each point a new one, drawn from the normal that its group's points have along each axis.

    Draws hang on (seed, axis, row); a group of one point gives that point again. The groups' means and deviations, a row a
    group, are broadcast after a count.
    """
    m = points.groupBy(group).agg(*[F.avg(a).alias(f"_m_{a}") for a in axes], *[F.stddev_pop(a).alias(f"_s_{a}") for a in axes])
    drawn = [(F.col(f"_m_{a}") + F.col(f"_s_{a}") * normal(F.lit(seed), F.lit(a), F.col(row))).alias(a) for a in axes]
    return points.select(row, group).join(small(m), group).select(row, group, *drawn)
