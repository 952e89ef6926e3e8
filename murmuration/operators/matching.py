"""One-to-one matching and identities over frames. A group here is one frame's, or one video's, labels: tens, not rows of data."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def solve(cost: np.ndarray) -> np.ndarray:
    """Column of each row in a cheapest assignment (-1 without one), by shortest augmenting paths with potentials."""
    n, m = cost.shape
    if n > m:
        back = solve(cost.T)
        out = np.full(n, -1)
        out[back[back >= 0]] = np.flatnonzero(back >= 0)
        return out
    u, v, owner = np.zeros(n), np.zeros(m), np.full(m, -1)
    for row in range(n):
        dist, via, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        r, col, base = row, -1, 0.0
        while True:
            d = base + cost[r] - u[r] - v
            better = ~done & (d < dist)
            dist[better], via[better] = d[better], col
            col = int(np.argmin(np.where(done, np.inf, dist)))
            base = dist[col]
            done[col] = True
            if owner[col] < 0:
                break
            r = owner[col]
        seen = np.flatnonzero(done)
        for c in seen:
            if c != col:
                u[owner[c]] += base - dist[c]
            v[c] -= base - dist[c]
        u[row] += base
        while col >= 0:
            before = via[col]
            owner[col] = row if before < 0 else owner[before]
            col = before
    out = np.full(n, -1)
    out[owner[owner >= 0]] = np.flatnonzero(owner >= 0)
    return out


def linked(iou: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Pairs of the best matching with at least the threshold; a threshold of 0 keeps pairs that do not meet."""
    if not iou.size:
        return []
    return [(i, int(j)) for i, j in enumerate(solve(1 - iou)) if j >= 0 and iou[i, j] >= threshold]


def match(table: DataFrame, keys: list[str], threshold: float = 0.5) -> DataFrame:
    """(keys, gt, pred, iou): the best one-to-one matching of each group of an overlap table."""
    fields = dict(table.dtypes)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, cols = np.sort(pdf["gt"].unique()), np.sort(pdf["pred"].unique())
        iou = np.zeros((len(rows), len(cols)))
        iou[np.searchsorted(rows, pdf["gt"]), np.searchsorted(cols, pdf["pred"])] = pdf["iou"]
        pairs = linked(iou, threshold)
        out = {**{k: [pdf[k].iloc[0]] * len(pairs) for k in keys}, "gt": [rows[i] for i, _ in pairs], "pred": [cols[j] for _, j in pairs], "iou": [iou[i, j] for i, j in pairs]}
        return pd.DataFrame({k: pd.Series(v, dtype=pdf[k].dtype) for k, v in out.items()})  # typed, as there may be no pair

    schema = ", ".join(f"{k} {fields[k]}" for k in [*keys, "gt", "pred"]) + ", iou double"
    return table.select(*keys, "gt", "pred", "iou").groupBy(*keys).applyInPandas(one, schema)


def instance_metrics(table: DataFrame, matches: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_gt, n_pred, matched_iou, mean_gt_iou, recall, precision) of frames with both sides."""
    sizes = table.groupBy(*keys).agg(F.count_distinct("gt").alias("n_gt"), F.count_distinct("pred").alias("n_pred"))
    m = matches.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("iou").alias("s"))
    j = sizes.join(m, keys, "left").na.fill({"n": 0, "s": 0.0})
    return j.select(*keys, "n_gt", "n_pred", F.when(F.col("n") > 0, F.col("s") / F.col("n")).otherwise(0.0).alias("matched_iou"), (F.col("s") / F.col("n_gt")).alias("mean_gt_iou"), (F.col("n") / F.col("n_gt")).alias("recall"), (F.col("n") / F.col("n_pred")).alias("precision"))


def video_metrics(frames: DataFrame, video: list[str], metrics: list[str]) -> DataFrame:
    """Frame metrics averaged over each video, nulls as 0, with the number of frames."""
    return frames.groupBy(*video).agg(F.count("*").alias("frames"), *[F.avg(F.coalesce(F.col(m), F.lit(0.0))).alias(m) for m in metrics])


def mask_overlap(a: list[set[int]], b: list[set[int]]) -> np.ndarray:
    return np.array([[len(x & y) / max(1, len(x | y)) if x & y else 0.0 for y in b] for x in a]).reshape(len(a), len(b))


def propagate(masks: DataFrame, threshold: float = 0.5, id_offset: int = 0) -> DataFrame:
    """(video_id, frame_idx, mask_pos, track_id) of masks given as pixels (video_id, frame_idx, mask_pos, px).

    Frames are folded in order within a video: a mask takes the track of its match in the frame before, others are born
    with the next id.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        out, before, tracks, free = [], [], [], id_offset
        for frame, f in pdf.sort_values(["frame_idx", "mask_pos", "px"]).groupby("frame_idx"):
            pos, now = zip(*((p, set(g.px)) for p, g in f.groupby("mask_pos")), strict=True)
            ids = [-1] * len(now)
            for i, j in linked(mask_overlap(before, list(now)), threshold) if before else []:
                ids[j] = tracks[i]
            for j, t in enumerate(ids):
                if t < 0:
                    ids[j], free = free, free + 1
            out += [(pdf.video_id.iloc[0], frame, p, t) for p, t in zip(pos, ids, strict=True)]
            before, tracks = list(now), ids
        return pd.DataFrame(out, columns=["video_id", "frame_idx", "mask_pos", "track_id"])

    kind = dict(masks.dtypes)
    return masks.groupBy("video_id").applyInPandas(fold, f"video_id {kind['video_id']}, frame_idx {kind['frame_idx']}, mask_pos {kind['mask_pos']}, track_id int")


def align_chunk(before: list[set[int]], before_ids: list[int], first: list[set[int]], ids: list[int], threshold: float, fresh: int) -> dict[int, int]:
    """Map of a chunk's local ids to global ones: matches with the last frame before it keep theirs, the rest are new from `fresh` on."""
    out = {ids[j]: before_ids[i] for i, j in linked(mask_overlap(before, first), threshold)}
    for t in ids:
        if t not in out:
            out[t], fresh = fresh, fresh + 1
    return out


def unmatched(tracked: DataFrame, found: DataFrame, threshold: float) -> DataFrame:
    """Found masks (mask_pos, px) whose overlap with every tracked mask of the frame stays below the threshold."""
    size = lambda d, n: d.groupBy("frame_idx", F.col("mask_pos").alias(n)).agg(F.count("*").alias(f"size_{n}"))
    inter = tracked.select("frame_idx", F.col("mask_pos").alias("a"), "px").join(found.select("frame_idx", F.col("mask_pos").alias("b"), "px"), ["frame_idx", "px"]).groupBy("frame_idx", "a", "b").agg(F.count("*").alias("i"))
    high = inter.join(size(tracked, "a"), ["frame_idx", "a"]).join(size(found, "b"), ["frame_idx", "b"]).where(F.col("i") / (F.col("size_a") + F.col("size_b") - F.col("i")) >= threshold)
    return found.join(high.select("frame_idx", F.col("b").alias("mask_pos")).distinct(), ["frame_idx", "mask_pos"], "left_anti")
