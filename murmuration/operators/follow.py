"""A camera that follows a clip: smoothed poses, a framing track of fixed depth, one focal length for all frames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _smoothed(rows: DataFrame, key: list[str], order: str, values: dict[str, Column], sigma: float) -> DataFrame:
    """Columns of values smoothed at once: one window that lists the neighbours' values, one that numbers them."""
    r = int(3 * sigma + 0.5)
    w = Window.partitionBy(*key).orderBy(order)
    rows = rows.withColumn("_n", F.row_number().over(w)).withColumn("_v", F.array(*values.values()))
    near = rows.withColumn("_near", F.collect_list(F.struct("_n", "_v")).over(w.rowsBetween(-r, r)))
    weight = lambda x: F.exp(-((x["_n"] - F.col("_n")) ** 2) / (2 * sigma**2))
    total = F.aggregate("_near", F.lit(0.0), lambda a, x: a + weight(x))
    mean = lambda i: F.aggregate("_near", F.lit(0.0), lambda a, x: a + weight(x) * F.get(x["_v"], F.lit(i))) / total
    return near.select(*rows.drop("_n", "_v").columns, F.array(*[mean(i) for i in range(len(values))]).alias("_smooth"))


def nearest_rotations(m: np.ndarray) -> np.ndarray:
    """The rotation nearest to each 3 x 3 matrix, by its singular vectors."""
    u, _, vt = np.linalg.svd(m)
    u[:, :, 2] *= np.where(np.linalg.det(u @ vt) < 0, -1.0, 1.0)[:, None]
    return u @ vt


def smoothed_poses(poses: DataFrame, key: list[str], order: str, sigma: float = 5.0) -> DataFrame:
    """(key, order, rotation, translation): poses (nine and three numbers) averaged over neighbouring frames, rotations taken back to rotations.

    Poses without a rotation take no part. Rows are frames; they are averaged by one window a key.
    """
    fine = poses.where("rotation is not null and translation is not null").select(*key, order, "rotation", "translation")
    values = {f"r{i}": F.get("rotation", F.lit(i)) for i in range(9)} | {f"t{i}": F.get("translation", F.lit(i)) for i in range(3)}
    rows = _smoothed(fine, key, order, values, sigma).select(*key, order, "_smooth")
    fields, k = dict(rows.dtypes), len(key) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = b.column(k).flatten().to_numpy(zero_copy_only=False).reshape(-1, 12)
            r = nearest_rotations(m[:, :9].reshape(-1, 3, 3)).reshape(-1, 9) if len(m) else np.empty((0, 9))
            kind = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns[:k], pa.array(list(r), kind), pa.array(list(m[:, 9:]), kind)], names=[*key, order, "rotation", "translation"])

    return rows.mapInArrow(run, ", ".join(f"`{c}` {fields[c]}" for c in (*key, order)) + ", rotation array<double>, translation array<double>")


def follow(points: DataFrame, poses: DataFrame, key: list[str], order: str, size: tuple[float, float], sigma: float = 5.0, calm: float = 25.0, margin: float = 0.92, near: float = 1e-3) -> tuple[DataFrame, DataFrame]:
    """(track, focals): (key, order, x, y, z) that the camera looks at, and (key, focal), the greatest focal length that keeps all points of all frames in view.

    points (key, order, x, y, z) are in the camera's frame and go to the world by the smoothed poses. The track is the mean
    point of each frame, smoothed by `calm` along x and y, its depth the median over the clip, so that the camera never
    moves in or out. A point at (u, v) = ((x - X) / z, (y - Y) / z) allows margin * half the view / |u|; points nearer than
    `near` allow anything. Partial aggregates by frame, then a row a frame.
    """
    from murmuration.operators.quantiles import medians

    smooth = smoothed_poses(poses, key, order, sigma)
    at = lambda i: sum((F.get("rotation", F.lit(3 * i + j)) * F.col(c) for j, c in enumerate("xyz")), F.get("translation", F.lit(i)))
    world = points.join(smooth, [*key, order]).select(*key, order, *[at(i).alias(c) for i, c in enumerate("xyz")])
    means = world.groupBy(*key, order).agg(*[F.avg(c).alias(c) for c in "xyz"])
    flat = _smoothed(means, key, order, {c: F.col(c) for c in "xy"}, calm).select(*key, order, F.get("_smooth", F.lit(0)).alias("_x"), F.get("_smooth", F.lit(1)).alias("_y"))
    track = flat.join(medians(means, key, {"_z": F.col("z")}), key)
    fits = lambda c, half: F.when(F.col(c) != F.col(f"_{c}"), margin * half * F.col("z") / F.abs(F.col(c) - F.col(f"_{c}")))
    fit = F.least(fits("x", size[0] / 2), fits("y", size[1] / 2))
    focals = world.join(flat, [*key, order]).where(F.col("z") > near).groupBy(*key).agg(F.min(fit).alias("focal"))
    return track.select(*key, order, F.col("_x").alias("x"), F.col("_y").alias("y"), F.col("_z").alias("z")), focals
