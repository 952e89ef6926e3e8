"""Label maps: overlap tables, evaluation, identity and majority rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from murmuration.operators.scoring import small


def overlap(pixels: DataFrame, keys: list[str], a: str = "gt", b: str = "pred") -> DataFrame:
    """(keys, a, b, inter, area_a, area_b, iou) of every pair of non-zero labels, also those that never meet.

    Pixels are read once: one aggregation to (key, a, b) counts, all else on those.
    """
    counts = pixels.groupBy(*keys, a, b).agg(F.count("*").alias("inter"))
    of_a = counts.where(F.col(a) > 0).groupBy(*keys, a).agg(F.sum("inter").alias("area_a"))
    of_b = counts.where(F.col(b) > 0).groupBy(*keys, b).agg(F.sum("inter").alias("area_b"))
    pairs = of_a.join(of_b, keys).join(counts, [*keys, a, b], "left").withColumn("inter", F.coalesce("inter", F.lit(0)).cast("long"))
    return pairs.withColumn("iou", F.col("inter") / (F.col("area_a") + F.col("area_b") - F.col("inter")))


def pixel_jaccard(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Foreground against foreground: intersection over union, 0 if both are empty."""
    gt, pred = F.col("gt") > 0, F.col("pred") > 0
    both, either = F.count_if(gt & pred), F.count_if(gt | pred)
    return pixels.groupBy(*keys).agg(F.when(either > 0, both / either).otherwise(0.0).alias("jaccard"), F.count_distinct(F.when(gt, F.col("gt"))).alias("n_gt"), F.count_distinct(F.when(pred, F.col("pred"))).alias("n_pred"))


def majority(pixels: DataFrame, key: str, label: str) -> DataFrame:
    """Most frequent label of each key, ties to the smallest."""
    counts = pixels.groupBy(key, label).agg(F.count("*").alias("n"))
    return counts.groupBy(key).agg(F.max_by(F.col(label), F.struct("n", -F.col(label))).alias(label), F.max("n").alias("n"))


def cap_instances(pixels: DataFrame, label: str, most: int) -> DataFrame:
    """(label, kept): the `most` largest non-zero labels stay (ties to the smaller), the rest become 0."""
    counts = pixels.where(F.col(label) > 0).groupBy(label).agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n"), label).limit(most).select(label, F.lit(True).alias("in"))
    return counts.join(F.broadcast(top), label, "left").select(label, "n", F.when(F.col("in"), F.col(label)).otherwise(0).alias("kept"))


def priority_mask(masks: DataFrame, least: float) -> DataFrame:
    """(px, mask_id): the mask of highest score above `least` at each pixel, ties to the first."""
    return masks.where(F.col("score") > least).groupBy("px").agg(F.max_by("mask_id", F.struct("score", -F.col("mask_id"))).alias("mask_id"))


def outlier_share(points: DataFrame, frame: str, blob: str, blobs: int) -> DataFrame:
    """One row: mean, least and greatest percentage over frames of points with blob >= blobs."""
    share = points.groupBy(frame).agg((100 * F.avg((F.col(blob) >= blobs).cast("double"))).alias("p"))
    return share.agg(F.avg("p").alias("mean_pct"), F.min("p").alias("min_pct"), F.max("p").alias("max_pct"))


def reference_preservation(pixels: DataFrame, first: int, least: int) -> DataFrame:
    """Share, by frame, of the first frame's foreground blobs (at least `least` pixels there) that are seen in the foreground again."""
    inside = pixels.where("gt > 0").groupBy("frame_idx", "blob_id").agg(F.count("*").alias("n"))
    ref = inside.where((F.col("frame_idx") == first) & (F.col("n") >= least)).select("blob_id")
    total = ref.agg(F.count("*").alias("n_ref"))
    seen = inside.join(ref, "blob_id", "left_semi").groupBy("frame_idx").agg(F.count("*").alias("n_seen"))
    return seen.crossJoin(F.broadcast(total)).select("frame_idx", "n_seen", (F.col("n_seen") / F.col("n_ref")).alias("preserved"))


def matter_weighted(pixels: DataFrame, first: int) -> DataFrame:
    """Matter-weighted precision, recall, Jaccard and accuracy by frame.

    A blob is object matter if most of its pixels in the first frame are inside the mask; it weighs its share of that
    frame's pixels times the pixels it has now.
    """
    held = pixels.groupBy("frame_idx", "blob_id").agg(F.avg((F.col("gt") > 0).cast("double")).alias("inside"), F.count("*").alias("n"))
    ref = held.where(F.col("frame_idx") == first).select("blob_id", (F.col("inside") > 0.5).alias("is_object"), F.col("n").alias("weight"))
    j = held.join(ref, "blob_id").select("frame_idx", "is_object", (F.col("weight") * F.col("n") * F.col("inside")).alias("win"), (F.col("weight") * F.col("n") * (1 - F.col("inside"))).alias("wout"))
    sums = j.groupBy("frame_idx").agg(F.sum(F.when(F.col("is_object"), F.col("win")).otherwise(0.0)).alias("tp"), F.sum(F.when(F.col("is_object"), F.col("wout")).otherwise(0.0)).alias("fp"), F.sum(F.when(F.col("is_object"), 0.0).otherwise(F.col("win"))).alias("fn"), F.sum(F.when(F.col("is_object"), 0.0).otherwise(F.col("wout"))).alias("tn"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return sums.select("frame_idx", "tp", "fp", "fn", "tn", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(tp, tp + fp + fn).alias("jaccard"), ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"))


def agreement(pixels: DataFrame, a: str = "gt", b: str = "pred") -> DataFrame:
    """One row: adjusted Rand index and normalised mutual information (arithmetic mean) of two labellings."""
    t = pixels.groupBy(a, b).agg(F.count("*").cast("double").alias("n"))
    pairs = lambda c: c * (c - 1) / 2
    rows, cols = (t.groupBy(k).agg(F.sum("n").alias("m")).agg(F.sum(pairs(F.col("m"))).alias(f"pairs_{k}"), F.sum(F.col("m") * F.log("m")).alias(f"ent_{k}")) for k in (a, b))
    both = t.agg(F.sum("n").alias("n"), F.sum(pairs(F.col("n"))).alias("pairs"), F.sum(F.col("n") * F.log("n")).alias("ent"))
    x = both.crossJoin(rows).crossJoin(cols)  # one row each
    n, pa, pb = F.col("n"), F.col(f"pairs_{a}"), F.col(f"pairs_{b}")
    expected = pa * pb / pairs(n)
    ha, hb = (F.log(n) - F.col(f"ent_{k}") / n for k in (a, b))
    mi = F.log(n) + (F.col("ent") - F.col(f"ent_{a}") - F.col(f"ent_{b}")) / n
    return x.select(((F.col("pairs") - expected) / ((pa + pb) / 2 - expected)).alias("ari"), (mi / ((ha + hb) / 2)).alias("nmi"))


def births_deaths(seen: DataFrame, track: str, frame: str) -> DataFrame:
    """(frame, births, deaths): tracks in a frame but not the one before, and in it but not the next."""
    now = seen.select(track, frame).distinct()
    edge = now.agg(F.min(frame).alias("lo"), F.max(frame).alias("hi"))
    w = Window.partitionBy(track).orderBy(frame)
    flags = now.withColumn("born", F.coalesce(F.lag(frame).over(w) != F.col(frame) - 1, F.lit(True))).withColumn("dies", F.coalesce(F.lead(frame).over(w) != F.col(frame) + 1, F.lit(True)))
    flags = flags.crossJoin(F.broadcast(edge))
    return flags.groupBy(frame).agg(F.count_if(F.col("born") & (F.col(frame) > F.col("lo"))).alias("births"), F.count_if(F.col("dies") & (F.col(frame) < F.col("hi"))).alias("deaths"))


def colour_ids(rows: DataFrame, colours: list[str], white: tuple[int, ...]) -> DataFrame:
    """Instance ids of colours: white is 0, the others 1, 2, ... in their order. Distinct colours are ranked, not pixels; there are as many as instances, which is checked before they are broadcast."""
    distinct = rows.select(*colours).distinct()
    plain = [F.col(c) != w for c, w in zip(colours, white, strict=True)]
    other = plain[0]
    for p in plain[1:]:
        other = other | p
    ranked = distinct.where(other).select(*colours, F.row_number().over(Window.orderBy(*colours)).alias("instance"))
    return rows.join(small(ranked), colours, "left").withColumn("instance", F.coalesce("instance", F.lit(0)))


def persistent_iou(table: DataFrame, first: int) -> DataFrame:
    """Mean IoU over later frames of the pairs that match best in the first frame; a pair missing in a frame counts 0."""
    best = table.where(F.col("frame_idx") == first).groupBy("gt").agg(F.max_by("pred", F.struct("iou", -F.col("pred"))).alias("pred"))
    frames = table.where(F.col("frame_idx") > first).select("frame_idx").distinct()
    return best.crossJoin(F.broadcast(frames)).join(table, ["frame_idx", "gt", "pred"], "left").groupBy("gt", "pred").agg(F.avg(F.coalesce("iou", F.lit(0.0))).alias("mean_iou"))


def rasterized(points: DataFrame, model: DataFrame, blob: str, hyper: str) -> DataFrame:
    """Points with blob_label and hyper_label, 1 + id; 0 for points whose blob the model (blob, hyper; a row a blob) has not, outliers among them."""
    j = points.join(small(model.select(blob, hyper)), blob, "left")
    return j.withColumns({"blob_label": F.when(F.col(hyper).isNotNull(), F.col(blob) + 1).otherwise(0), "hyper_label": F.coalesce(F.col(hyper) + 1, F.lit(0))}).drop(hyper)


def best_mask(masks: DataFrame, pixel: str, mask: str, score: str) -> DataFrame:
    """(pixel, label): the mask of highest score at each pixel, ties to the smaller id."""
    return masks.groupBy(pixel).agg(F.max_by(mask, F.struct(F.col(score), -F.col(mask))).alias("label"))


def region_mean(pixels: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Pixels with paint, the mean of their region: partial sums, then a join of one row a region."""
    return pixels.join(pixels.groupBy(*keys).agg(F.avg(value).alias("paint")), keys)


def paint_holes(labels: DataFrame, mask: DataFrame, key: list[str], least: int) -> DataFrame:
    """(key, label, added): a mask (key) paints the pixels without a label as one above the largest, where it adds at least `least`."""
    j = labels.join(mask.select(*key, F.lit(True).alias("_in")).distinct(), key, "left").withColumn("added", F.coalesce(F.col("_in"), F.lit(False)) & (F.col("label") == 0))
    total = j.agg((F.max("label") + 1).alias("_next"), F.count_if("added").alias("_n"))
    j = j.crossJoin(F.broadcast(total)).withColumn("added", F.col("added") & (F.col("_n") >= least))
    return j.select(*key, F.when(F.col("added"), F.col("_next")).otherwise(F.col("label")).alias("label"), "added")


def merged_tracks(old: DataFrame, new: DataFrame, frame: str, track: str) -> DataFrame:
    """(frame, track) of known tracks and of new objects, whose ids follow the largest known one."""
    top = old.agg(F.coalesce(F.max(track) + 1, F.lit(0)).alias("_first"))
    shifted = new.select(frame, track).distinct().crossJoin(F.broadcast(top)).select(frame, (F.col(track) + F.col("_first")).alias(track))
    return old.select(frame, track).distinct().unionByName(shifted)


def instance_counts(pixels: DataFrame, keys: list[str], label: str) -> DataFrame:
    """(keys, instances, max_track): different labels above 0, and the largest track id, label - 1 and at least 0."""
    return pixels.groupBy(*keys).agg(F.count_distinct(F.when(F.col(label) > 0, F.col(label))).alias("instances"), F.greatest(F.lit(0), F.max(label) - 1).alias("max_track"))


def seed_instances(cells: DataFrame, colours: list[str], white: tuple[int, ...]) -> DataFrame:
    """One row: how many colours other than white the cells have."""
    plain = F.lit(True)
    for c, w in zip(colours, white, strict=True):
        plain = plain & (F.col(c) == w)
    return cells.agg(F.count_distinct(F.when(~plain, F.struct(*colours))).alias("instances"))
