"""Identities of masks over long clips, in parallel: overlaps, links of neighbouring frames, chains of links, numbers.

Overlaps of neighbouring frames are counted by Spark, each pair of frames is matched on its own, and links become chains
in two levels: within a chunk of frames by a small fold over its links, over the borders of chunks by pointer doubling.
Numbers are those that a fold over all frames in order would give: by the frame of birth, then by the mask's position.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from murmuration.operators.matching import match
from murmuration.plans.session import ensure_checkpoint, work_table

#: Frames of a chunk.
CHUNK = 64
_MASK = ["video_id", "frame_idx", "mask_pos"]


def frame_numbers(masks: DataFrame) -> DataFrame:
    """(video_id, frame_idx, t): a video's frames that have masks, counted from 0. Rows are frames."""
    frames = masks.select("video_id", "frame_idx").distinct()
    return frames.withColumn("t", F.row_number().over(Window.partitionBy("video_id").orderBy("frame_idx")) - 1)


def shared(masks: DataFrame) -> DataFrame:
    """(video_id, t, gt, pred, n): the pixels of each mask (video_id, t, mask_pos, px) of t that each mask of t + 1 has too; pred null: all of its pixels.

    Pixels are dealt once, by video and pixel, and meet those of the next frame in a window: no join whose sides Spark
    could take for small ones and broadcast. Pixels without a number meet none.
    """
    rows = masks.select("video_id", "t", "mask_pos", "px").repartition("video_id", "px").distinct()
    after = F.collect_list("mask_pos").over(Window.partitionBy("video_id", "px").orderBy("t").rangeBetween(1, 1))
    every = F.array(F.lit(None).cast(masks.schema["mask_pos"].dataType))
    met = rows.withColumn("_after", after).withColumn("pred", F.explode(F.when(F.col("px").isNull(), every).otherwise(F.concat(every, "_after"))))
    return met.groupBy("video_id", "t", F.col("mask_pos").alias("gt"), "pred").agg(F.count("*").alias("n"))


def iou(counts: DataFrame) -> DataFrame:
    """(video_id, t, gt, pred, iou) of what shared() gives."""
    sizes = counts.where("pred is null")
    own = sizes.select("video_id", "t", "gt", F.col("n").alias("n_gt"))
    other = sizes.select("video_id", (F.col("t") - 1).alias("t"), F.col("gt").alias("pred"), F.col("n").alias("n_pred"))
    j = counts.where("pred is not null").join(own, ["video_id", "t", "gt"]).join(other, ["video_id", "t", "pred"])
    return j.select("video_id", "t", "gt", "pred", (F.col("n") / (F.col("n_gt") + F.col("n_pred") - F.col("n"))).alias("iou"))


def overlaps(masks: DataFrame) -> DataFrame:
    """(video_id, t, gt, pred, iou) of the masks (video_id, t, mask_pos, px) of neighbouring frames t and t + 1 that share a pixel."""
    ensure_checkpoint(masks.sparkSession)
    return iou(shared(masks).checkpoint())


def chained(links: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(video_id, t, pos, root_t, root_pos): the first mask of the chain of each mask that a link (video_id, t, pos, next) leads to.

    A mask of t has at most one link to t + 1, and one from t - 1. Links within a chunk are folded in a group of at most
    `chunk` frames' links; a chain that enters a chunk gets there by one link, whose ends' roots are doubled over chunks.
    """
    ensure_checkpoint(links.sparkSession)
    kinds = dict(links.dtypes)
    links = links.withColumn("_chunk", F.floor((F.col("t") + 1) / chunk))
    inside = F.floor(F.col("t") / chunk) == F.col("_chunk")

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        root: dict[tuple, tuple] = {}
        out = []
        for video, t, pos, after in pdf.sort_values("t")[["video_id", "t", "pos", "next"]].itertuples(index=False):
            first = root.get((t, pos), (t, pos))
            root[t + 1, after] = first
            out.append((video, t + 1, after, *first))
        return pd.DataFrame(out, columns=["video_id", "t", "pos", "root_t", "root_pos"])

    schema = f"video_id {kinds['video_id']}, t {kinds['t']}, pos {kinds['pos']}, root_t {kinds['t']}, root_pos {kinds['pos']}"
    local = links.where(inside).groupBy("video_id", "_chunk").applyInPandas(fold, schema).checkpoint()
    # a link over a border: its later end is a root of its own chunk, and points to the root of its earlier end
    over = links.where(~inside).select("video_id", "t", "pos", (F.col("t") + 1).alias("to_t"), F.col("next").alias("to_pos"))
    over = over.join(local, ["video_id", "t", "pos"], "left")
    ends = over.select("video_id", F.col("to_t").alias("t"), F.col("to_pos").alias("pos"), F.coalesce("root_t", "t").alias("root_t"), F.coalesce("root_pos", "pos").alias("root_pos")).checkpoint()
    while True:
        further = ends.select("video_id", F.col("t").alias("root_t"), F.col("pos").alias("root_pos"), F.col("root_t").alias("_t"), F.col("root_pos").alias("_pos"))
        new = ends.join(further, ["video_id", "root_t", "root_pos"], "left").select("video_id", "t", "pos", F.coalesce("_t", "root_t").alias("root_t"), F.coalesce("_pos", "root_pos").alias("root_pos"), F.col("_t").isNotNull().alias("moved")).checkpoint()
        ends = new.drop("moved")
        if not new.where("moved").head(1):
            break
    heads = ends.select("video_id", F.col("t").alias("root_t"), F.col("pos").alias("root_pos"), F.col("root_t").alias("_t"), F.col("root_pos").alias("_pos"))
    whole = local.join(heads, ["video_id", "root_t", "root_pos"], "left").select("video_id", "t", "pos", F.coalesce("_t", "root_t").alias("root_t"), F.coalesce("_pos", "root_pos").alias("root_pos"))
    return whole.unionByName(ends)


def numbered(roots: DataFrame, id_offset: int = 0) -> DataFrame:
    """(video_id, t, pos, track_id) of the masks that begin a chain, numbered by frame, then position: frames' counts are summed up, a row a frame, masks only within their frame."""
    births = roots.groupBy("video_id", "t").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("video_id").orderBy("t").rowsBetween(Window.unboundedPreceding, -1))
    own = F.row_number().over(Window.partitionBy("video_id", "t").orderBy("pos")) - 1
    return roots.withColumn("own", own).join(births.select("video_id", "t", F.coalesce(upto, F.lit(0)).alias("before")), ["video_id", "t"]).select("video_id", "t", "pos", (F.col("before") + F.col("own") + id_offset).cast("int").alias("track_id"))


def propagate(masks: DataFrame, threshold: float = 0.5, id_offset: int = 0, chunk: int = CHUNK) -> DataFrame:
    """(video_id, frame_idx, mask_pos, track_id) of masks given as pixels (video_id, frame_idx, mask_pos, px).

    A mask takes the track of its match (best one-to-one by overlap, at least the threshold, which is above 0) among the
    masks of the frame before that has any; others are born with the next number. Repeated pixels count once. No task holds
    a video: pixels meet by pixel, masks are matched by pairs of frames, links are folded by chunks.
    """
    if threshold <= 0:
        raise ValueError("a threshold above 0")
    ensure_checkpoint(masks.sparkSession)
    frame_numbers(masks).write.parquet(path := work_table(masks.sparkSession))
    numbers = masks.sparkSession.read.parquet(path)  # a table, so that its size is known: an explode of few rows looks small
    counts = shared(masks.select(*_MASK, "px").join(numbers, ["video_id", "frame_idx"])).checkpoint()
    links = match(iou(counts), ["video_id", "t"], threshold).select("video_id", "t", F.col("gt").alias("pos"), F.col("pred").alias("next")).checkpoint()
    chains = chained(links, chunk).checkpoint()
    every = counts.where("pred is null").select("video_id", "t", F.col("gt").alias("pos")).join(numbers, ["video_id", "t"]).join(chains, ["video_id", "t", "pos"], "left").checkpoint()
    ids = numbered(every.where("root_t is null").select("video_id", "t", "pos"), id_offset)
    named = every.select("video_id", "frame_idx", F.col("pos").alias("mask_pos"), F.coalesce("root_t", "t").alias("t"), F.coalesce("root_pos", "pos").alias("pos"))
    return named.join(ids, ["video_id", "t", "pos"]).select(*_MASK, "track_id")


def composed(maps: DataFrame) -> DataFrame:
    """(video_id, chunk, local, global) from matches over the borders of chunks (video_id, chunk, local, before): `before` the local id that it continues in the chunk before, null for one that begins here.

    Ids of a video count up from 0 by the chunk that a track begins in, then by its local id there. Pointer doubling over
    chunks: as many rounds as the logarithm of the most chunks that a track passes.
    """
    ensure_checkpoint(maps.sparkSession)
    at = maps.select("video_id", "chunk", "local", F.when(F.col("before").isNotNull(), F.col("chunk") - 1).otherwise(F.col("chunk")).alias("root"), F.coalesce("before", "local").alias("name")).checkpoint()
    while True:
        further = at.select("video_id", F.col("chunk").alias("root"), F.col("local").alias("name"), F.col("root").alias("_root"), F.col("name").alias("_name"))
        new = at.join(further, ["video_id", "root", "name"], "left").select("video_id", "chunk", "local", F.coalesce("_root", "root").alias("root"), F.coalesce("_name", "name").alias("name"), (F.coalesce(F.col("_root"), F.col("root")) != F.col("root")).alias("moved")).checkpoint()
        at = new.drop("moved")
        if not new.where("moved").head(1):
            break
    ids = numbered(at.select("video_id", F.col("root").alias("t"), F.col("name").alias("pos")).distinct())
    return at.join(ids.select("video_id", F.col("t").alias("root"), F.col("pos").alias("name"), F.col("track_id").alias("global")), ["video_id", "root", "name"]).select("video_id", "chunk", "local", "global")
