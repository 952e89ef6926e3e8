"""Row-wise geometry: projections, depth, ellipses, rotations. Column expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmuration.operators.quantiles import bracketed
from murmuration.plans.session import ensure_checkpoint


def unproject(u: Column, v: Column, z: Column, fx: float, fy: float, cx: float, cy: float) -> tuple[Column, Column, Column]:
    return (u - cx) * z / fx, (v - cy) * z / fy, z


def project(x: Column, y: Column, z: Column, f: float, cx: float, cy: float) -> tuple[Column, Column]:
    """Image point; null where the depth is not over a thousandth."""
    seen = z > 1e-3
    return F.when(seen, f * x / z + cx), F.when(seen, f * y / z + cy)


def pseudo_depth(rows: DataFrame, frame: str, d: str) -> DataFrame:
    """Depth of disparities scaled by the least and greatest of the frame: 1 / (0.8 s + 0.2). A partial aggregate gives a row a frame; no frame is gathered in a task."""
    ends = rows.groupBy(frame).agg(F.min(d).alias("_lo"), F.max(d).alias("_hi"))
    s = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(d) - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + 1e-6)))
    return rows.join(ends, frame).withColumn("z", 1 / (0.8 * s + 0.2)).drop("_lo", "_hi")


def flow_velocity(pixels: DataFrame, width: int, height: int, f: float) -> DataFrame:
    """Points and velocities of pixels (frame, px, z, du, dv): the depth at the flow's target in the same frame, clamped to the image; a missing target keeps its own depth."""
    u, v = F.col("px") % width, F.floor(F.col("px") / width)
    tu, tv = F.least(F.lit(width - 1), F.greatest(F.lit(0), u + F.col("du"))), F.least(F.lit(height - 1), F.greatest(F.lit(0), v + F.col("dv")))
    a = pixels.select("frame", "px", "z", u.alias("u"), v.alias("v"), tu.alias("tu"), tv.alias("tv"), (tv * width + tu).alias("tpx"))
    b = pixels.select("frame", F.col("px").alias("tpx"), F.col("z").alias("tz_"))
    j = a.join(b, ["frame", "tpx"], "left").withColumn("tz", F.coalesce("tz_", "z"))
    p, q = (unproject(F.col(c), F.col(d), F.col(e), f, f, width / 2, height / 2) for c, d, e in (("u", "v", "z"), ("tu", "tv", "tz")))
    return j.select("frame", "px", *[x.alias(n) for x, n in zip(p, ("x", "y", "z"), strict=True)], *[(y - x).alias(n) for x, y, n in zip(p, q, ("vx", "vy", "vz"), strict=True)])


def ellipse(sxx: Column, sxy: Column, syy: Column, least: float, most: float) -> tuple[Column, Column, Column]:
    """(major, minor, angle in degrees) of a 2 x 2 covariance, half axes clipped."""
    mid, half = (sxx + syy) / 2, F.sqrt(((sxx - syy) / 2) ** 2 + sxy * sxy)
    axis = lambda e: F.greatest(F.lit(least), F.least(F.lit(most), F.sqrt(F.greatest(e, F.lit(0.0)))))
    return axis(mid + half), axis(mid - half), F.degrees(0.5 * F.atan2(2 * sxy, sxx - syy))


def quaternion(r: list[Column]) -> tuple[Column, Column, Column, Column]:
    """(x, y, z, w) of a rotation given row by row, by the largest of trace and diagonal."""
    a, b, c, d, e, f, g, h, i = r
    t = a + e + i
    s0, s1, s2, s3 = (2 * F.sqrt(F.greatest(F.lit(1e-300), x)) for x in (t + 1, 1 + a - e - i, 1 + e - a - i, 1 + i - a - e))
    cases = ((t > 0, ((h - f) / s0, (c - g) / s0, (d - b) / s0, s0 / 4)), ((a > e) & (a > i), (s1 / 4, (b + d) / s1, (c + g) / s1, (h - f) / s1)), (e > i, ((b + d) / s2, s2 / 4, (f + h) / s2, (c - g) / s2)))
    last = ((c + g) / s3, (f + h) / s3, s3 / 4, (d - b) / s3)
    return tuple(F.when(cases[0][0], cases[0][1][k]).when(cases[1][0], cases[1][1][k]).when(cases[2][0], cases[2][1][k]).otherwise(last[k]) for k in range(4))


def smoothstep(x: Column, low: float, high: float) -> Column:
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - low) / (high - low)))
    return t * t * (3 - 2 * t)


def robust_alignment(pairs: DataFrame, key: str, x: str, y: str, rounds: int = 2) -> DataFrame:
    """(key, scale, shift): y about scale x + shift, from median and MAD, then reweighted least squares with Huber weights.

    Medians come from sketches and counts, so that no task gathers a key's values: F.median keeps each different value of a key.
    What a round gives, a row a key, is cut off by checkpoint(), so that no round computes the ones before it again.
    """
    ensure_checkpoint(pairs.sparkSession)
    both = pairs.where(F.col(key).isNotNull())
    med = bracketed(both, [key], {"mx": F.col(x), "my": F.col(y)}).checkpoint()
    mad = bracketed(both.join(med, key), [key], {"dx": F.abs(F.col(x) - F.col("mx")), "dy": F.abs(F.col(y) - F.col("my"))})
    fit = med.join(mad, key).select(key, (F.col("dy") / F.greatest("dx", F.lit(1e-6))).alias("scale"), "mx", "my").select(key, "scale", (F.col("my") - F.col("scale") * F.col("mx")).alias("shift")).checkpoint()
    for _ in range(rounds):
        r = pairs.join(fit, key).withColumn("r", F.col(y) - F.col("scale") * F.col(x) - F.col("shift"))
        sigma = bracketed(r, [key], {"sigma": F.abs("r")}).select(key, (1.4826 * F.col("sigma")).alias("sigma")).checkpoint()
        w = F.when(F.abs("r") <= 1.345 * F.greatest("sigma", F.lit(1e-6)), 1.0).otherwise(1.345 * F.greatest("sigma", F.lit(1e-6)) / F.abs("r"))
        s = r.join(sigma, key).withColumn("w", w).groupBy(key).agg(F.sum("w").alias("w"), *[F.sum(F.col("w") * e).alias(n) for e, n in ((F.col(x), "sx"), (F.col(y), "sy"), (F.col(x) * F.col(x), "sxx"), (F.col(x) * F.col(y), "sxy"))])
        det = F.col("w") * F.col("sxx") - F.col("sx") * F.col("sx")
        scale = F.when(F.abs(det) > 1e-9, (F.col("w") * F.col("sxy") - F.col("sx") * F.col("sy")) / det).otherwise(1.0)
        fit = s.select(key, scale.alias("scale"), "w", "sx", "sy").select(key, "scale", ((F.col("sy") - F.col("scale") * F.col("sx")) / F.col("w")).alias("shift")).checkpoint()
    return fit


def next_frame_motion(pixels: DataFrame, width: int, height: int, f: float) -> DataFrame:
    """Points and motions of pixels (frame, px, z, du, dv) by the depth at the flow's target in the next frame; X and Y use the target as it is, the depth the target clamped to the image. Pixels without a next frame give nothing."""
    u, v = F.col("px") % width, F.floor(F.col("px") / width)
    clamp = lambda x, n: F.least(F.lit(n - 1), F.greatest(F.lit(0), x))
    a = pixels.select("frame", "px", "z", u.alias("u"), v.alias("v"), (u + F.col("du")).alias("tu"), (v + F.col("dv")).alias("tv")).withColumn("tpx", clamp(F.col("tv"), height) * width + clamp(F.col("tu"), width))
    b = pixels.select((F.col("frame") - 1).alias("frame"), F.col("px").alias("tpx"), F.col("z").alias("tz"))
    j = a.join(b, ["frame", "tpx"])
    p, q = (unproject(F.col(c), F.col(d), F.col(e), f, f, width / 2, height / 2) for c, d, e in (("u", "v", "z"), ("tu", "tv", "tz")))
    return j.select("frame", "px", *[x.alias(n) for x, n in zip(p, ("x", "y", "z"), strict=True)], *[(y - x).alias(n) for x, y, n in zip(p, q, ("vx", "vy", "vz"), strict=True)])


def look_at(ax: Column, ay: Column, az: Column, tx: Column, ty: Column, tz: Column) -> list[Column]:
    """Rows (right, down, forward) of the rotation that looks from a to t, the world's y axis down."""
    fx, fy, fz = tx - ax, ty - ay, tz - az
    n = F.sqrt(fx * fx + fy * fy + fz * fz)
    fx, fy, fz = fx / n, fy / n, fz / n
    m = F.sqrt(fz * fz + fx * fx)  # length of y x forward
    rx, rz = fz / m, -fx / m
    return [rx, F.lit(0.0), rz, fy * rz, fz * rx - fx * rz, -fy * rx, fx, fy, fz]


def turned(x: Column, y: Column, z: Column, yaw: float, pitch: float, pivot: tuple[float, float, float]) -> tuple[Column, Column, Column]:
    """A point turned about a pivot: yaw about y, then pitch about x, angles in degrees."""
    import math

    a, b = math.radians(yaw), math.radians(pitch)
    x, y, z = x - pivot[0], y - pivot[1], z - pivot[2]
    x, z = math.cos(a) * x + math.sin(a) * z, -math.sin(a) * x + math.cos(a) * z
    y, z = math.cos(b) * y - math.sin(b) * z, math.sin(b) * y + math.cos(b) * z
    return x + pivot[0], y + pivot[1], z + pivot[2]


def compressed(z: Column, centroid: Column, scale: float) -> Column:
    """Depth whose offset from the centroid is scaled."""
    return centroid + (z - centroid) * scale


def calmed(motion: DataFrame, frame: str, order: str, axes: tuple[str, str, str], most: float = 0.35) -> DataFrame:
    """Motion vectors longer than `most` become zero, but for the first such one of each frame, which the scan keeps."""
    x, y, z = (F.col(a) for a in axes)
    long = F.sqrt(x * x + y * y + z * z) > most
    first = motion.where(long).groupBy(frame).agg(F.min(order).alias("_first"))
    j = motion.join(first, frame, "left").withColumn("_zero", long & (F.col(order) != F.col("_first")))
    return j.withColumns({a: F.when(F.col("_zero"), 0.0).otherwise(F.col(a)) for a in axes}).drop("_zero", "_first")


def extent(points: DataFrame, share: float) -> DataFrame:
    """One row: the percentile of |x| and |y|, and the median depth, from which a focal length is fitted."""
    return points.agg(F.percentile(F.abs("x"), share).alias("ex"), F.percentile(F.abs("y"), share).alias("ey"), F.median("z").alias("mz"))


def painter_order(points: DataFrame, frame: list[str], depth: str, key: str) -> DataFrame:
    """Points with paint_rank: far to near within a frame, ties by key."""
    return points.withColumn("paint_rank", F.row_number().over(Window.partitionBy(*frame).orderBy(F.desc(depth), key)) - 1)


def rig(rows: DataFrame, apex: tuple[str, str, str], pivot: tuple[str, str, str], yaw: float, half: tuple[float, float], focal: float) -> DataFrame:
    """Each row's three cameras: the apex turned about the pivot by -yaw, 0 and yaw degrees, looking at the pivot, with the four corners of its image plane at distance 1.

    Adds camera (-1, 0, 1), ax, ay, az and corners (array of x, y, z; left top, right top, right bottom, left bottom).
    """
    turn = F.radians(F.col("camera") * F.lit(yaw))
    dx, dz = F.col(apex[0]) - F.col(pivot[0]), F.col(apex[2]) - F.col(pivot[2])
    out = rows.withColumn("camera", F.explode(F.array(*[F.lit(k) for k in (-1, 0, 1)])))
    out = out.withColumns({"ax": F.col(pivot[0]) + F.cos(turn) * dx + F.sin(turn) * dz, "ay": F.col(apex[1]), "az": F.col(pivot[2]) - F.sin(turn) * dx + F.cos(turn) * dz})
    r = look_at(F.col("ax"), F.col("ay"), F.col("az"), *[F.col(p) for p in pivot])
    w, h = half[0] / focal, half[1] / focal
    corner = lambda u, v: F.struct(*[(F.col(a) + r[6 + i] + u * w * r[i] + v * h * r[3 + i]).alias(n) for i, (a, n) in enumerate(zip(("ax", "ay", "az"), "xyz", strict=True))])
    return out.withColumn("corners", F.array(*[corner(u, v) for u, v in ((-1, -1), (1, -1), (1, 1), (-1, 1))]))
