"""Two-level initialisation over points that are spread over many tasks: blobs by k-means within each segment, then hyperblobs.

Segments share the blobs by quotas of their sizes. Seeding is k-means|| (Bahmani et al., 2012): in each round every segment
draws points by a keyed weighted sample, the weight the squared distance to what it has; the candidates, weighted by the
points nearest to them, are clustered on the driver. Lloyd's rounds add up partial sums, a row a blob and task. No task
holds a segment; the driver holds a few rows a blob.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmuration.operators import kernel
from murmuration.operators.scoring import small
from murmuration.plans.session import ensure_checkpoint

#: Rounds of seeding, candidates a round and blob, most rounds of Lloyd's.
SEEDINGS, OVERSAMPLING, ROUNDS = 5, 2, 30
#: Distances held at a time.
PAIRS = 1 << 22
AXES = ("x", "y", "z", "vx", "vy", "vz")

Groups = dict[tuple[str, str], np.ndarray]


def segment_quota(n: Column, total: Column, blobs: int) -> Column:
    """Blobs of a segment of n points: its share, rounded down, at least one and at most a point each."""
    return F.least(n, F.greatest(F.lit(1), F.floor(F.lit(blobs) * n / total))).cast("int")


def roi_quotas(inside: Column, outside: Column, blobs: int, ratio: float = 1.0, fixed: int | None = None) -> tuple[Column, Column]:
    """Blobs inside and outside of a region of interest.

    By share, the inside's weighted by `ratio`, at least 3 on either side; or `fixed` inside, which leaves the outside one
    at least where it has points. A side without points has none, one of fewer points than its quota a blob a point.
    """
    if fixed is not None:
        own = F.least(F.lit(fixed), inside)
        rest = F.lit(blobs) - own
        none = (outside > 0) & (rest < 1)
        own, rest = F.when(none, blobs - 1).otherwise(own), F.when(none, 1).otherwise(rest)
    else:
        share = inside / (inside + outside) * ratio
        own = F.greatest(F.lit(3), F.floor(blobs * share / (share + outside / (inside + outside))))
        rest = F.greatest(F.lit(3), F.lit(blobs) - own)
    return F.least(own, inside).cast("int"), F.least(rest, outside).cast("int")


def quotas(points: DataFrame, blobs: int, segment: str | None = None, roi: bool = False, ratio: float = 1.0, fixed: int | None = None) -> DataFrame:
    """(video_id, segment, n, quota): segments as text, '' where none is named; with roi the segment is true or false."""
    name = F.coalesce(F.col(segment).cast("string"), F.lit("")) if segment else F.lit("")
    sizes = points.groupBy(F.col("video_id").cast("string").alias("video_id"), name.alias("segment")).agg(F.count("*").alias("n"))
    video = Window.partitionBy("video_id")  # rows are segments
    if roi:
        inside, outside = (F.sum(F.when((F.col("segment") == "true") == side, F.col("n")).otherwise(0)).over(video) for side in (True, False))
        own, rest = roi_quotas(inside, outside, blobs, ratio, fixed)
        return sizes.select("video_id", "segment", "n", F.when(F.col("segment") == "true", own).otherwise(rest).alias("quota"))
    return sizes.select("video_id", "segment", "n", segment_quota(F.col("n"), F.sum("n").over(video), blobs).alias("quota"))


def _columns(points: DataFrame, segment: str | None) -> DataFrame:
    name = F.coalesce(F.col(segment).cast("string"), F.lit("")) if segment else F.lit("")
    return points.select(F.col("video_id").cast("string").alias("video_id"), name.alias("segment"), F.col("point_id").cast("long").alias("point_id"), *[F.col(c).cast("double").alias(c) for c in AXES], F.col("feat").cast("array<double>").alias("feat"))


def _groups(b: pa.RecordBatch, known: dict) -> Iterator[tuple[tuple[str, str], np.ndarray, np.ndarray]]:
    """(group, places in the batch, points) of the groups that are known."""
    video, segment = (b.column(i).to_numpy(zero_copy_only=False) for i in range(2))
    x = np.column_stack([b.column(3 + i).to_numpy() for i in range(6)])
    own: dict[tuple[str, str], list[int]] = {}
    for i, key in enumerate(zip(video.tolist(), segment.tolist(), strict=True)):
        own.setdefault(key, []).append(i)
    for key, rows in ((k, np.array(r)) for k, r in own.items()):
        if key in known:
            yield key, rows, x[rows]


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest centre, squared distance) of each row, ties to the first."""
    z, d = np.empty(len(x), np.int64), np.empty(len(x))
    block = max(1, PAIRS // max(1, len(centres)))
    middle = centres.mean(axis=0)
    c = centres - middle
    for i in range(0, len(x), block):
        y = x[i : i + block] - middle
        q = (y * y).sum(1)[:, None] - 2 * y @ c.T + (c * c).sum(1)[None]
        z[i : i + block] = q.argmin(axis=1)
        d[i : i + block] = ((y - c[z[i : i + block]]) ** 2).sum(1)
    return z, d


def _first(points: DataFrame, seed: int) -> Groups:
    """A keyed random point of each group."""
    best = points.groupBy("video_id", "segment").agg(F.min_by(F.array(*AXES), F.struct(F.xxhash64(F.lit(seed), "point_id"), "point_id")).alias("c"))
    return {(r["video_id"], r["segment"]): np.array([r["c"]]) for r in small(best).collect()}


def _sampled(points: DataFrame, centres: Groups, wanted: dict[tuple[str, str], int], seed: int, turn: int) -> Groups:
    """So many points of each group, without repeats, by weights d^2: those with the largest log(u) / d^2, u keyed by the point."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for b in batches:
            ids = b.column(2).to_numpy()
            for key, rows, x in _groups(b, wanted):
                d = nearest(x, centres[key])[1]
                u = kernel.uniform(seed, turn, (kernel.START, turn), ids[rows], 1)[:, 0]
                with np.errstate(divide="ignore"):
                    k = np.where(d > 1e-12 * max(1.0, float(d.max(initial=0.0))), np.log(u) / d, -np.inf)
                own = k, ids[rows], x
                if key in held:
                    own = tuple(np.concatenate(p) for p in zip(held[key], own, strict=True))
                order = np.lexsort((own[1], -own[0]))[: wanted[key]]
                held[key] = tuple(p[order] for p in own)
        for (video, segment), (k, i, x) in held.items():
            some = np.isfinite(k)
            n = int(some.sum())
            yield pa.RecordBatch.from_arrays([pa.array([video] * n, pa.string()), pa.array([segment] * n, pa.string()), pa.array(k[some]), pa.array(i[some]), pa.array(list(x[some]), pa.list_(pa.float64()))], names=["video_id", "segment", "k", "i", "c"])

    found = points.mapInArrow(run, "video_id string, segment string, k double, i long, c array<double>")
    rank = F.row_number().over(Window.partitionBy("video_id", "segment").orderBy(F.desc("k"), "i"))
    limit = F.element_at(F.create_map(*[x for (v, s), n in wanted.items() for x in (F.concat(F.lit(v), F.lit("\n"), F.lit(s)), F.lit(n))]), F.concat("video_id", F.lit("\n"), "segment"))
    out: Groups = dict(centres)
    for r in found.withColumn("rank", rank).where(F.col("rank") <= limit).orderBy("video_id", "segment", "rank").select("video_id", "segment", F.col("c")).collect():
        key = r["video_id"], r["segment"]
        out[key] = np.vstack([out[key], [r["c"]]])
    return out


def _folded(points: DataFrame, centres: Groups, moments: Callable[[np.ndarray, np.ndarray, np.ndarray, int], np.ndarray]) -> Groups:
    """Sums by nearest centre of each group: moments(x, f, z, k) gives k rows of numbers; tasks' rows are added up by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Groups = {}
        for b in batches:
            f = b.column(9).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) if b.num_rows else np.empty((0, 0))
            for key, rows, x in _groups(b, centres):
                m = moments(x, f[rows], nearest(x, centres[key])[0], len(centres[key]))
                total[key] = total[key] + m if key in total else m
        for (video, segment), m in total.items():
            some = np.flatnonzero(m[:, 0])
            yield pa.RecordBatch.from_arrays([pa.array([video] * len(some)), pa.array([segment] * len(some)), pa.array(some.astype(np.int32)), pa.array(list(m[some]), pa.list_(pa.float64()))], names=["video_id", "segment", "blob", "m"])

    parts = points.mapInArrow(run, "video_id string, segment string, blob int, m array<double>")
    width = len(moments(np.zeros((1, 6)), np.zeros((1, len(points.select("feat").first()[0] or []))), np.zeros(1, np.int64), 1)[0])
    sums = parts.groupBy("video_id", "segment", "blob").agg(F.array(*[F.sum(F.get("m", F.lit(i))) for i in range(width)]).alias("m")).toArrow()
    out = {key: np.zeros((len(c), width)) for key, c in centres.items()}
    for video, segment, blob, m in zip(*(sums.column(i).to_pylist() for i in range(4)), strict=True):
        out[video, segment][blob] = m
    return out


def _means(x: np.ndarray, f: np.ndarray, z: np.ndarray, k: int) -> np.ndarray:
    return np.column_stack([np.bincount(z, minlength=k), *[np.bincount(z, c, k) for c in x.T]])


def _moments(x: np.ndarray, f: np.ndarray, z: np.ndarray, k: int) -> np.ndarray:
    p, v = x[:, :3], x[:, 3:]
    parts = [np.ones((len(x), 1)), p, (p[:, :, None] * p[:, None]).reshape(len(x), 9), v, (v[:, :, None] * v[:, None]).reshape(len(x), 9), f]
    return np.column_stack([np.bincount(z, c, k) for c in np.hstack(parts).T])


def weighted_kmeans(x: np.ndarray, w: np.ndarray, k: int, seed: int, rounds: int = ROUNDS) -> np.ndarray:
    """k centres of weighted rows: k-means++ seeds, then Lloyd's rounds. Fewer different rows than k: these."""
    different, inverse = np.unique(x, axis=0, return_inverse=True)
    w = np.bincount(inverse.ravel(), w, len(different))
    if len(different) <= k:
        return different
    rng = np.random.default_rng(seed)
    centres = [different[rng.choice(len(different), p=w / w.sum())]]
    d = ((different - centres[0]) ** 2).sum(1)
    for _ in range(k - 1):
        p = w * d
        centres.append(different[rng.choice(len(different), p=p / p.sum()) if p.sum() > 0 else int(d.argmax())])
        d = np.minimum(d, ((different - centres[-1]) ** 2).sum(1))
    c = np.array(centres)
    for _ in range(rounds):
        z = nearest(different, c)[0]
        n = np.bincount(z, w, k)
        new = np.where(n[:, None] > 0, np.column_stack([np.bincount(z, w * a, k) for a in different.T]) / np.maximum(n, 1e-300)[:, None], c)
        if np.array_equal(new, c):
            break
        c = new
    return c


def centres(points: DataFrame, quota: dict[tuple[str, str], int], seed: int = 0, rounds: int = ROUNDS) -> Groups:
    """At most quota centres of each group, none without points; a group of as many different points as its quota, or fewer, has these."""
    found = _first(points, seed)
    found = {key: c for key, c in found.items() if quota.get(key, 0)}
    if not found:
        return {}
    more = {key: OVERSAMPLING * n for key, n in quota.items() if key in found}
    for turn in range(SEEDINGS):
        found = _sampled(points, found, more, seed, turn)
    weight = _folded(points, found, _means)
    now = {key: weighted_kmeans(c, weight[key][:, 0], quota[key], seed) for key, c in found.items()}
    for _ in range(rounds):
        sums = _folded(points, now, _means)
        new = {key: np.where(sums[key][:, :1] > 0, sums[key][:, 1:] / np.maximum(sums[key][:, :1], 1), c) for key, c in now.items()}
        settled = all(np.allclose(new[key], now[key], rtol=0, atol=1e-9) for key in now)
        now = new
        if settled:
            break
    full = _folded(points, now, _means)
    return {key: c[full[key][:, 0] > 0] for key, c in now.items()}


def numbered(found: Groups) -> dict[tuple[str, str], int]:
    """The number of each group's first blob: groups in order within a video, '1' and 'true' like any other name."""
    out: dict[tuple[str, str], int] = {}
    at: dict[str, int] = {}
    for key in sorted(found):
        out[key] = at.get(key[0], 0)
        at[key[0]] = out[key] + len(found[key])
    return out


def blobs_of(points: DataFrame, found: Groups, segment: str | None = None) -> DataFrame:
    """(video_id, point_id, segment, blob_id): the nearest centre of each point's segment. No shuffle."""
    first = numbered(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, rows, x in _groups(b, found):
                z = first[key] + nearest(x, found[key])[0]
                yield pa.RecordBatch.from_arrays([pa.array([key[0]] * len(rows)), b.column(2).take(pa.array(rows)), pa.array([key[1]] * len(rows)), pa.array(z.astype(np.int32))], names=["video_id", "point_id", "segment", "blob_id"])

    return _columns(points, segment).mapInArrow(run, "video_id string, point_id long, segment string, blob_id int")


def segmented(points: DataFrame, blobs: int, segment: str | None = None, roi: bool = False, ratio: float = 1.0, fixed: int | None = None, seed: int = 0, rounds: int = ROUNDS) -> Groups:
    """Centres of all segments by their quotas (of a frame's segments, a row each on the driver)."""
    ensure_checkpoint(points.sparkSession)
    rows = _columns(points, segment).checkpoint()  # read some forty times
    quota = {(r["video_id"], r["segment"]): r["quota"] for r in small(quotas(rows, blobs, "segment", roi, ratio, fixed)).collect()}
    return centres(rows, quota, seed, rounds)


def hyper_counts(sizes: dict[str, int], hypers: int, background: str | None, roi: int | None) -> dict[str, int]:
    """Hyperblobs of each segment of a video, from its points.

    With roi: so many inside, the rest outside. With a background: every other segment is one, the background as many a
    point as these have, at least one (as many as there are segments, where it is all). Else all share `hypers` alike.
    """
    if roi is not None:
        return {s: roi if s == "true" else hypers - roi for s in sizes}
    if background is not None:
        others = {s: n for s, n in sizes.items() if s != background}
        out = dict.fromkeys(others, 1)
        if background in sizes:
            out[background] = max(1, int(sizes[background] * len(others) / sum(others.values()))) if others else max(1, hypers)
        return out
    return dict.fromkeys(sizes, hypers)


def start(points: DataFrame, blobs: int, hypers: int, h: kernel.Hypers = kernel.Hypers(), segment: str | None = None, background: str | None = None, roi: int | None = None, ratio: float = 1.0, fixed: int | None = None) -> dict[str, kernel.State]:
    """The first state of every video, from one frame's points.

    segment names a column of segments; with `background` one of them stands for what has none, with `roi` the column is
    true inside a region of interest that makes up so many hyperblobs. Without a segment, and without either of these, the
    segments' blobs make up the hyperblobs together.
    """
    found = segmented(points, blobs, segment, roi is not None, ratio, fixed, h.seed)
    sums = _folded(_columns(points, segment), found, _moments) if found else {}
    first = numbered(found)
    out: dict[str, kernel.State] = {}
    for video in sorted({v for v, _ in found}):
        own = sorted(k for k in found if k[0] == video)
        m = np.vstack([sums[k] for k in own])
        n, p, pp, v, vv, f = np.split(m, np.cumsum([1, 3, 9, 3, 9]), axis=1)
        parts = {"n": n[:, 0], "x": p, "xx": pp.reshape(-1, 3, 3), "v": v, "vv": vv.reshape(-1, 3, 3), "f": f}
        place = {k[1]: first[k] + np.arange(len(found[k])) for k in own}
        if background is None and roi is None:
            groups = [(np.arange(len(m)), hypers)]
        else:
            count = hyper_counts({k[1]: int(sums[k][:, 0].sum()) for k in own}, hypers, background, roi)
            groups = [(place[s], count[s]) for s in sorted(place, key=lambda s: s != "true")]
        out[video] = kernel.begun(parts, [g for g in groups if g[1] > 0], h)
    return out
