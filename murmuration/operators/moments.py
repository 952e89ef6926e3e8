"""Sufficient statistics of groups, and the closed-form posteriors that need nothing else.

One hash aggregation gives counts, sums and second moments; every mean and covariance after that runs on a row a group
and never reads the points again. Partial sums are merged before the shuffle, so that a group of any size is one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AXES = ("x", "y", "z")
VELOCITY = ("vx", "vy", "vz")


def moments(points: DataFrame, keys: list[str], axes: tuple[str, ...] = AXES + VELOCITY, pairs: tuple[str, ...] = AXES) -> DataFrame:
    """n, sums of the axes and products of all pairs among `pairs`, one row for each key."""
    sums = [F.sum(a).alias(f"s_{a}") for a in axes]
    products = [F.sum(F.col(a) * F.col(b)).alias(f"s_{a}{b}") for i, a in enumerate(pairs) for b in pairs[i:]]
    return points.groupBy(*keys).agg(F.count("*").alias("n"), *sums, *products)


def scatter(a: str, b: str) -> Column:
    """Sum of (a - mean a)(b - mean b), from moments."""
    return F.col(f"s_{a}{b}") - F.col(f"s_{a}") * F.col(f"s_{b}") / F.col("n")


def niw_posterior(m: DataFrame, nu0: float, psi0: float, axes: tuple[str, ...] = AXES) -> DataFrame:
    """Normal-inverse-Wishart scale: nu = nu0 + n, psi = psi0 I + scatter about the mean."""
    terms = [(scatter(a, b) + (psi0 if a == b else 0.0)).alias(f"psi_{a}{b}") for i, a in enumerate(axes) for b in axes[i:]]
    return m.withColumns({"nu": F.col("n") + nu0}).select(*[c for c in m.columns if not c.startswith("s_")], "nu", *terms)


def normal_posterior(m: DataFrame, mean0: float, var0: float, var: float, axes: tuple[str, ...] = AXES) -> DataFrame:
    """Normal mean with a normal prior and known variances: precision-weighted means."""
    precision = F.lit(1 / var0) + F.col("n") / var
    return m.select(*[c for c in m.columns if not c.startswith("s_")], *[((mean0 / var0 + F.col(f"s_{a}") / var) / precision).alias(f"post_{a}") for a in axes], (1 / precision).alias("post_var"))


def dirichlet_mean(ids: DataFrame, points: DataFrame, id_col: str, beta: float) -> DataFrame:
    """(id, n, weight) for every id, empty ones too: (beta + n) / (L beta + N), ids outside left out."""
    counts = ids.select(id_col).distinct().join(points.groupBy(id_col).agg(F.count("*").alias("n")), id_col, "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    total = counts.agg(F.sum("n").alias("all_n"), F.count("*").alias("all_l"))  # one row
    return counts.crossJoin(F.broadcast(total)).select(id_col, "n", ((F.col("n") + beta) / (F.col("all_n") + F.col("all_l") * beta)).alias("weight"))


def feature_posterior(points: DataFrame, keys: list[str], mean0: float, var0: float, var: float) -> DataFrame:
    """(keys, dim, n, post_mean): diagonal normal posterior of each feature dimension."""
    each = points.select(*keys, F.posexplode("feat").alias("dim", "f")).groupBy(*keys, "dim").agg(F.count("*").alias("n"), F.sum("f").alias("s"))
    return each.select(*keys, "dim", "n", ((mean0 / var0 + F.col("s") / var) / (1 / var0 + F.col("n") / var)).alias("post_mean"))


def feature_variance(points: DataFrame, blob: str = "blob_id", hyperblob: str = "hyperblob_id") -> DataFrame:
    """One row: mean squared residual of features about blob means, and of blob means about hyperblob means.

    From moments: sum of squares less n times the squared mean; no second pass over the points.
    """
    dims = points.select(blob, hyperblob, F.posexplode("feat").alias("dim", "f"))
    by_blob = dims.groupBy(blob, hyperblob, "dim").agg(F.count("*").alias("n"), F.sum("f").alias("s"), F.sum(F.col("f") * F.col("f")).alias("ss"))
    blobs = by_blob.withColumn("mean", F.col("s") / F.col("n"))
    within = blobs.agg((F.sum(F.col("ss") - F.col("n") * F.col("mean") * F.col("mean")) / F.sum("n")).alias("sigma_f"))
    over = blobs.groupBy(hyperblob, "dim").agg(F.count("*").alias("k"), F.sum("mean").alias("m"), F.sum(F.col("mean") * F.col("mean")).alias("mm"))
    between = over.agg((F.sum(F.col("mm") - F.col("m") * F.col("m") / F.col("k")) / F.sum("k")).alias("sigma_f_h"))
    return within.crossJoin(F.broadcast(between))


def mean_or_global(points: DataFrame, ids: DataFrame, id_col: str, value: str) -> DataFrame:
    """Mean of each id, that of all points for ids without any."""
    means = points.groupBy(id_col).agg(F.avg(value).alias("own"))
    overall = points.agg(F.avg(value).alias("overall"))
    return ids.select(id_col).distinct().join(means, id_col, "left").crossJoin(F.broadcast(overall)).select(id_col, F.coalesce("own", "overall").alias("mean"))


def empirical_hypers(points: DataFrame, blob: str = "blob_id") -> DataFrame:
    """One row: medians over blobs of mean positions and variances, and mean points a blob, at least 1."""
    m = points.groupBy(blob).agg(F.count("*").alias("n"), *[F.avg(a).alias(f"m_{a}") for a in AXES], *[F.var_pop(a).alias(f"v_{a}") for a in AXES])
    return m.agg(*[F.median(f"m_{a}").alias(f"mu_{a}") for a in AXES], *[F.median(f"v_{a}").alias(f"var_{a}") for a in AXES], F.greatest(F.avg("n"), F.lit(1.0)).alias("nu"))


def rigid_moments(pairs: DataFrame, keys: list[str], p: tuple[str, ...], q: tuple[str, ...], weight: str | None = None) -> DataFrame:
    """Weighted sums of p, q and p x q: all that a rigid fit needs."""
    w = F.col(weight) if weight else F.lit(1.0)
    return pairs.groupBy(*keys).agg(F.sum(w).alias("w"), *[F.sum(w * F.col(c)).alias(f"s_{c}") for c in (*p, *q)], *[F.sum(w * F.col(a) * F.col(b)).alias(f"s_{a}_{b}") for a in p for b in q])


def running(points: DataFrame, key: str, order: str, value: str, fps: float) -> DataFrame:
    """Real-time budget: running sum of max(0, dt * fps - 1), and running worst value."""
    w = Window.partitionBy(key).orderBy(order)
    gap = F.greatest(F.lit(0.0), F.col("dt") * fps - 1)
    up_to = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return points.withColumn("dt", F.coalesce(F.col(value) - F.lag(value).over(w), F.lit(0.0))).withColumn("lag_frames", F.sum(gap).over(up_to)).withColumn("worst", F.max("dt").over(up_to))


def gated_prior_means(m: DataFrame, prior: DataFrame, key: str, var: float, strength: float, reach: float, axes: tuple[str, ...] = AXES) -> DataFrame:
    """Means of points pulled to a prediction (key, pred_x, ..., speed): the pull is strength / (1 + (speed / reach)^2) times the data's precision. Keys without points keep the prediction."""
    gate = strength / (1 + (F.col("speed") / reach) ** 2)
    j = prior.join(m, key, "left")
    n = F.coalesce("n", F.lit(0))
    return j.select(key, *[F.when(n > 0, (F.col(f"s_{a}") / var + gate * n / var * F.col(f"pred_{a}")) / (n / var + gate * n / var)).otherwise(F.col(f"pred_{a}")).alias(f"mean_{a}") for a in axes])


def motion_colours(blobs: DataFrame, key: str, least: int = 8, percent: float = 0.95) -> DataFrame:
    """(key, hue, value): velocities less the blobs' median (if there are at least `least`), hue by direction, value by speed over its percentile."""
    mid = blobs.agg(F.count("*").alias("k"), F.median("vx").alias("mx"), F.median("vy").alias("my"))
    j = blobs.crossJoin(F.broadcast(mid))
    dx, dy = (F.col(v) - F.when(F.col("k") >= least, F.col(c)).otherwise(0.0) for v, c in (("vx", "mx"), ("vy", "my")))
    s = j.select(key, dx.alias("dx"), dy.alias("dy"), F.sqrt(dx * dx + dy * dy).alias("speed"))
    top = s.agg(F.percentile("speed", percent).alias("top"))
    return s.crossJoin(F.broadcast(top)).select(key, F.degrees(F.atan2("dy", "dx")).alias("hue"), F.least(F.lit(1.0), F.col("speed") / F.greatest("top", F.lit(1e-9))).alias("value"))


def displacement(points: DataFrame, blob: str, frame: str, frames: int) -> DataFrame:
    """(blob, dx, dy, dz): motion summed over the first frames."""
    return points.where(F.col(frame) < frames).groupBy(blob).agg(*[F.sum(f"v{c}").alias(f"d{c}") for c in "xyz"])


def mean_covariance(points: DataFrame, hypers: DataFrame, hyper: str, blob: str, default: float) -> DataFrame:
    """(hyper, xx, xy): mean over a hyperblob's blobs of their covariances; `default` and 0 for one without."""
    b = points.groupBy(hyper, blob).agg(F.covar_samp("x", "y").alias("xy"), F.var_samp("x").alias("xx")).groupBy(hyper).agg(F.avg("xx").alias("xx"), F.avg("xy").alias("xy"))
    return hypers.join(b, hyper, "left").select(hyper, F.coalesce("xx", F.lit(default)).alias("xx"), F.coalesce("xy", F.lit(0.0)).alias("xy"))


def salient(points: DataFrame, cluster: str, centre: tuple[float, float], radius: float, least: int = 5) -> DataFrame:
    """(cluster, x, y, score) of the most salient cluster: centrality, plus motion beside the frame's mean motion, minus twice its share above a quarter.

    Clusters under a hundredth of the points, or under `least`, take no part; ties go to the smaller id.
    """
    ego = points.agg(F.avg("vx").alias("_ex"), F.avg("vy").alias("_ey"), F.count("*").alias("_all"))  # one row
    per = points.groupBy(cluster).agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.avg("vx").alias("vx"), F.avg("vy").alias("vy"), F.count("*").alias("n")).crossJoin(F.broadcast(ego))
    central = 1 - F.sqrt((F.col("x") - centre[0]) ** 2 + (F.col("y") - centre[1]) ** 2) / radius
    moving = F.sqrt((F.col("vx") - F.col("_ex")) ** 2 + (F.col("vy") - F.col("_ey")) ** 2)
    score = central + moving - 2 * F.greatest(F.lit(0.0), F.col("n") / F.col("_all") - 0.25)
    fit = per.where(F.col("n") >= F.greatest(F.lit(float(least)), 0.01 * F.col("_all"))).withColumn("score", score)
    return fit.orderBy(F.desc(F.round("score", 9)), cluster).limit(1).select(cluster, "x", "y", "score")
