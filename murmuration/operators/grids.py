"""Grids: fills, upsampling, splats, neighbour merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmuration.plans.session import ensure_checkpoint


def nearest_fill(cells: DataFrame, known: DataFrame, most: int = 1_000_000) -> DataFrame:
    """(cell, value): each cell (cell, r, c) takes the value of the nearest known one (r, c, value), ties to the least (r, c).

    The known cells are one grid's; they are broadcast after a check that they are at most `most`.
    """
    if len(known.limit(most + 1).select("r").collect()) > most:
        raise ValueError("more known cells than a grid holds")
    k = F.broadcast(known.select(F.col("r").alias("kr"), F.col("c").alias("kc"), "value"))
    d = (F.col("r") - F.col("kr")) ** 2 + (F.col("c") - F.col("kc")) ** 2
    return cells.crossJoin(k).groupBy("cell", "r", "c").agg(F.min_by("value", F.struct(d, F.col("kr"), F.col("kc"))).alias("value"))


def upsample_by_guide(fine: DataFrame, coarse: DataFrame, step: int) -> DataFrame:
    """Each fine cell (r, c, luma) takes, of the 2 x 2 coarse cells around it, the label whose luma is closest, the first on ties."""
    corners = F.array(*[F.struct(F.lit(n).alias("n"), (F.floor(F.col("r") / step) + dr).alias("cr"), (F.floor(F.col("c") / step) + dc).alias("cc")) for n, (dr, dc) in enumerate(((0, 0), (0, 1), (1, 0), (1, 1)))])
    near = fine.select("r", "c", "luma", F.explode(corners).alias("k")).select("r", "c", "luma", "k.n", "k.cr", "k.cc")
    j = near.join(coarse.select(F.col("r").alias("cr"), F.col("c").alias("cc"), "label", F.col("luma").alias("coarse_luma")), ["cr", "cc"])
    return j.groupBy("r", "c").agg(F.min_by("label", F.struct(F.abs(F.col("luma") - F.col("coarse_luma")), "n")).alias("label"))


def splat(points: DataFrame, radius: int) -> DataFrame:
    """(px, py, label): every point (u, v, z, point_id, label) covers a disc; the nearest in depth shows, ties to the smaller id."""
    offsets = [(dx, dy) for dx in range(-radius, radius + 1) for dy in range(-radius, radius + 1) if dx * dx + dy * dy <= radius * radius]
    spots = F.array(*[F.struct((F.floor("u") + dx).alias("px"), (F.floor("v") + dy).alias("py")) for dx, dy in offsets])
    return points.select("z", "point_id", "label", F.explode(spots).alias("p")).groupBy("p.px", "p.py").agg(F.min_by("label", F.struct("z", "point_id")).alias("label"))


def front_to_back(layers: DataFrame, pixel: list[str], depth: list[str], alpha: str, colour: str) -> DataFrame:
    """(pixel, coverage, colour): weights alpha times what nearer layers let through, by an ordered window."""
    before = Window.partitionBy(*pixel).orderBy(*depth).rowsBetween(Window.unboundedPreceding, -1)
    through = F.exp(F.coalesce(F.sum(F.log(1 - F.col(alpha))).over(before), F.lit(0.0)))
    w = layers.withColumn("w", F.col(alpha) * through)
    return w.groupBy(*pixel).agg(F.sum("w").alias("coverage"), (F.sum(F.col("w") * F.col(colour)) / F.sum("w")).alias("colour"))


def box_blur(cells: DataFrame, value: str) -> DataFrame:
    """Mean of each cell and its neighbours that exist, by an explode to the nine targets and one aggregation."""
    shifts = F.array(*[F.struct((F.col("r") + a).alias("r"), (F.col("c") + b).alias("c")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    sums = cells.select(F.explode(shifts).alias("p"), value).groupBy(F.col("p.r").alias("r"), F.col("p.c").alias("c")).agg(F.avg(value).alias("blurred"))
    return cells.join(sums, ["r", "c"])


def bilinear(coarse: DataFrame, rows: int, cols: int, factor: int, value: str) -> DataFrame:
    """(r, c, value) on a grid `factor` times finer, half-pixel centres, edges repeated."""
    spark = coarse.sparkSession
    fine = spark.range(rows * factor).select(F.col("id").alias("r")).crossJoin(spark.range(cols * factor).select(F.col("id").alias("c")))

    def axis(x: Column, n: int) -> tuple[Column, Column, Column]:
        s = (x + 0.5) / factor - 0.5
        lo = F.floor(s)
        clamp = lambda i: F.greatest(F.lit(0), F.least(F.lit(n - 1), i)).cast("long")
        return clamp(lo), clamp(lo + 1), s - lo

    (r0, r1, fr), (c0, c1, fc) = axis(F.col("r"), rows), axis(F.col("c"), cols)
    taps = F.array(*[F.struct(a.alias("cr"), b.alias("cc"), w.alias("w")) for a, b, w in ((r0, c0, (1 - fr) * (1 - fc)), (r0, c1, (1 - fr) * fc), (r1, c0, fr * (1 - fc)), (r1, c1, fr * fc))])
    t = fine.select("r", "c", F.explode(taps).alias("t")).select("r", "c", "t.cr", "t.cc", "t.w")
    return t.join(coarse.select(F.col("r").alias("cr"), F.col("c").alias("cc"), value), ["cr", "cc"]).groupBy("r", "c").agg(F.sum(F.col("w") * F.col(value)).alias(value))


def neighbour_links(cells: DataFrame, label: str, value: str, least: float) -> DataFrame:
    """(a, b): labels of cells side by side that differ while the labels' mean values do not, by more than `least`."""
    means = cells.where(F.col(label) > 0).groupBy(label).agg(F.avg(value).alias("m"))
    steps = F.array(F.struct(F.col("r"), (F.col("c") + 1).alias("c")), F.struct((F.col("r") + 1).alias("r"), F.col("c")))
    right = cells.select(F.col(label).alias("a"), F.explode(steps).alias("p")).select("a", "p.r", "p.c")
    pairs = right.join(cells.select("r", "c", F.col(label).alias("b")), ["r", "c"]).where("a > 0 and b > 0 and a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    j = pairs.join(means.select(F.col(label).alias("a"), F.col("m").alias("ma")), "a").join(means.select(F.col(label).alias("b"), F.col("m").alias("mb")), "b")
    return j.where(F.abs(F.col("ma") - F.col("mb")) < least).select("a", "b")


def merged_labels(links: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """(label, merged): the smallest label reachable over links. Rounds of neighbours' minima and pointer jumps, each cut by checkpoint()."""
    ensure_checkpoint(labels.sparkSession)
    state = labels.select(F.col(label).alias("v")).distinct().withColumn("root", F.col("v"))
    both = links.select("a", "b").union(links.select("b", "a"))
    before = None
    while True:
        near = both.join(state, both["b"] == state["v"]).groupBy("a").agg(F.min("root").alias("near"))
        state = state.join(near, state["v"] == near["a"], "left").select("v", F.least("root", F.coalesce("near", "root")).alias("root"))
        jump = state.select(F.col("v").alias("r"), F.col("root").alias("rr"))
        state = state.join(jump, state["root"] == jump["r"]).select("v", F.col("rr").alias("root")).checkpoint()
        now = state.agg(F.sum("root")).first()[0]
        if now == before:
            return state.select(F.col("v").alias(label), F.col("root").alias("merged"))
        before = now


def nearest(cells: DataFrame, size: tuple[int, int], to: tuple[int, int], values: list[str]) -> DataFrame:
    """(r, c, values) on a grid of another size, each cell that of floor(r * rows / new rows), floor(c * cols / new cols); labels, masks and colours stay what they are."""
    spark = cells.sparkSession
    fine = spark.range(to[0] * to[1]).select(F.floor(F.col("id") / to[1]).alias("r"), (F.col("id") % to[1]).alias("c"))
    fine = fine.select("r", "c", F.floor(F.col("r") * size[0] / to[0]).alias("sr"), F.floor(F.col("c") * size[1] / to[1]).alias("sc"))
    return fine.join(cells.select(F.col("r").alias("sr"), F.col("c").alias("sc"), *values), ["sr", "sc"]).select("r", "c", *values)


def peak(cells: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, r, c, peak): the cell of each grid whose 3 x 3 mean (edges repeated by leaving out what is missing) is largest, the first on ties."""
    shifts = F.array(*[F.struct((F.col("r") + a).alias("r"), (F.col("c") + b).alias("c")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    sums = cells.select(*keys, F.explode(shifts).alias("p"), value).groupBy(*keys, F.col("p.r").alias("r"), F.col("p.c").alias("c")).agg(F.avg(value).alias("blurred"))
    inside = cells.select(*keys, "r", "c").join(sums, [*keys, "r", "c"])
    best = F.max_by(F.struct("r", "c", "blurred"), F.struct(F.round("blurred", 9), -F.col("r"), -F.col("c")))
    return inside.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.r", "b.c", F.col("b.blurred").alias("peak"))


def top_uncovered(points: DataFrame, covered: Column, value: str, key: str, most: int, least: float) -> DataFrame:
    """(key, value): the `most` uncovered rows of highest value, ties to the smaller key, of those the ones above `least`."""
    return points.where(~covered).orderBy(F.desc(F.round(value, 9)), key).limit(most).where(F.col(value) > least).select(key, value)


def candidate(masks: DataFrame, labels: DataFrame, rows: int, cols: int, size: tuple[int, int], border: float, least_new: float) -> DataFrame:
    """(mask_id, cells, new_share): of candidate masks (mask_id, r, c) the one with the largest share of cells without a label.

    Masks of fewer or more cells than `size` allows, with more than `border` of their cells at the grid's edge, or with
    less than `least_new` uncovered are rejected; ties go to the larger, then the first. labels: (r, c, label), 0 none.
    """
    edge = (F.col("r") == 0) | (F.col("c") == 0) | (F.col("r") == rows - 1) | (F.col("c") == cols - 1)
    known = masks.join(labels.select("r", "c", "label"), ["r", "c"], "left")
    per = known.groupBy("mask_id").agg(F.count("*").alias("cells"), F.avg(edge.cast("double")).alias("edge"), F.avg((F.coalesce("label", F.lit(0)) == 0).cast("double")).alias("new_share"))
    fit = per.where(F.col("cells").between(*size) & (F.col("edge") <= border) & (F.col("new_share") >= least_new))
    return fit.orderBy(F.desc(F.round("new_share", 9)), F.desc("cells"), "mask_id").limit(1).select("mask_id", "cells", "new_share")


def augmented(labels: DataFrame, mask: DataFrame, least: int = 5) -> DataFrame:
    """(r, c, label): labels with the mask's uncovered cells painted as a new label, one above the largest; unchanged where the mask adds fewer than `least`."""
    j = labels.join(mask.select("r", "c", F.lit(True).alias("_in")).distinct(), ["r", "c"], "left").withColumn("_new", F.coalesce(F.col("_in"), F.lit(False)) & (F.col("label") == 0))
    total = j.agg((F.max("label") + 1).alias("_next"), F.count_if("_new").alias("_added"))  # one row
    return j.crossJoin(F.broadcast(total)).select("r", "c", F.when(F.col("_new") & (F.col("_added") >= least), F.col("_next")).otherwise(F.col("label")).alias("label"))
