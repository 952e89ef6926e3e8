"""Small dense problems: principal axes, normalised cut, rigid fits.

Sums over points are Spark aggregations; what is solved on a driver or in one task has a row a blob, dimension or token.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmuration.operators import blocks, cut
from murmuration.plans.session import ensure_checkpoint


def principal_axes(points: DataFrame, column: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(mean, k axes with the largest variance first); signs so that the largest component is positive. One aggregation of D^2 / 2 sums."""
    d = len(points.select(column).first()[0])
    sums = [F.count("*")] + [F.sum(F.col(column)[i]) for i in range(d)] + [F.sum(F.col(column)[i] * F.col(column)[j]) for i in range(d) for j in range(i, d)]
    row = np.array(points.agg(*sums).first(), float)
    n, s = row[0], row[1 : d + 1]
    m = np.zeros((d, d))
    m[np.triu_indices(d)] = row[d + 1 :]
    cov = (m + np.triu(m, 1).T - np.outer(s, s) / n) / max(1, n - 1)
    axes = np.linalg.eigh(cov)[1][:, ::-1][:, :k].T
    return s / n, axes * np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(1)])[:, None]


def project(points: DataFrame, column: str, mean: np.ndarray, axes: np.ndarray, name: str) -> DataFrame:
    """Coordinates along frozen axes, as columns name_0, name_1, ...: expressions, no UDF."""
    at = lambda a: sum((F.col(column)[i] * float(a[i]) for i in range(len(a))), F.lit(-float(a @ mean)))
    return points.withColumns({f"{name}_{i}": at(a) for i, a in enumerate(axes)})


def aligned(axes: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Axes with the signs that agree with an earlier basis."""
    return axes * np.where((axes * before).sum(1) >= 0, 1.0, -1.0)[:, None]


def rigid(m: dict[str, float], p: tuple[str, ...], q: tuple[str, ...], rotate_centre: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(R, t) with q about R p + t from rigid moments. Without rotate_centre, t is the difference of centroids."""
    w = m["w"]
    mp, mq = (np.array([m[f"s_{c}"] for c in x]) / w for x in (p, q))
    cross = np.array([[m[f"s_{a}_{b}"] for b in q] for a in p]) - w * np.outer(mp, mq)
    u, _, vt = np.linalg.svd(cross)
    r = vt.T @ np.diag([1, 1, np.sign(np.linalg.det(vt.T @ u.T))]) @ u.T
    return r, mq - (r @ mp if rotate_centre else mp)


def normalised_cut(features: np.ndarray, places: np.ndarray, temperature: float = 0.2, reach: float = 0.3) -> np.ndarray:
    """Soft foreground of one image's tokens: second eigenvector of the normalised Laplacian, then a two-part mixture."""
    f = features / np.maximum(np.linalg.norm(features, axis=1, keepdims=True), 1e-9)
    w = np.exp((f @ f.T - 1) / temperature) * np.exp(-((places[:, None] - places[None]) ** 2).sum(-1) / (2 * reach**2))
    d = w.sum(1)
    e = np.linalg.eigh(np.eye(len(w)) - w / np.sqrt(np.outer(d, d)))[1][:, 1] / np.sqrt(d)
    q = (e > e.mean()).astype(float)
    for _ in range(50):
        stats = []
        for r in (q, 1 - q):
            m = np.average(e, weights=r * d + 1e-12)
            stats.append((m, np.average((e - m) ** 2, weights=r * d + 1e-12) + 1e-12, (r * d).sum() / d.sum() + 1e-12))
        a, b = (np.log(p) - 0.5 * (np.log(v) + (e - m) ** 2 / v) for m, v, p in stats)
        q = 1 / (1 + np.exp(np.clip(b - a, -60, 60)))
    edge = np.abs(places - places.mean(0)).max(1) > 0.9 * np.abs(places - places.mean(0)).max()
    return 1 - q if (q * edge).sum() / max(q.sum(), 1e-9) > ((1 - q) * edge).sum() / max((1 - q).sum(), 1e-9) else q


#: Tokens of a video whose matrix of all pairs one task makes; others meet in blocks.
DENSE = 1500


def cut_tokens(tokens: DataFrame) -> DataFrame:
    """(video_id, token_id, q): the cut of each video's tokens (token_id, feat, row, col).

    A video of up to DENSE tokens is solved whole in a task; of a larger one no task holds more than some blocks
    (operators/cut.py), with time in proportion to the square of its tokens.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("token_id")
        return pd.DataFrame({"video_id": pdf.video_id, "token_id": pdf.token_id, "q": normalised_cut(np.stack(pdf.feat), pdf[["row", "col"]].to_numpy(float))})

    ensure_checkpoint(tokens.sparkSession)
    big = tokens.groupBy("video_id").count().where(F.col("count") > DENSE).select(F.col("video_id").alias("_video"), F.monotonically_increasing_id().alias("code")).checkpoint()
    if not big.head(1):
        return tokens.groupBy("video_id").applyInPandas(one, "video_id string, token_id long, q double")
    same = F.col("video_id").eqNullSafe(F.col("_video"))
    small = tokens.join(F.broadcast(big), same, "left_anti").groupBy("video_id").applyInPandas(one, "video_id string, token_id long, q double")
    q = cut.large(tokens.join(F.broadcast(big), same).select("code", "token_id", "feat", "row", "col"))
    return small.union(q.join(F.broadcast(big), "code").select(F.col("_video").cast("string"), "token_id", "q"))


def quaternion(r: np.ndarray) -> np.ndarray:
    """(x, y, z, w) of a rotation, w not negative."""
    k = np.array([[r[0, 0] - r[1, 1] - r[2, 2], 0, 0, 0], [r[0, 1] + r[1, 0], r[1, 1] - r[0, 0] - r[2, 2], 0, 0], [r[0, 2] + r[2, 0], r[1, 2] + r[2, 1], r[2, 2] - r[0, 0] - r[1, 1], 0], [r[2, 1] - r[1, 2], r[0, 2] - r[2, 0], r[1, 0] - r[0, 1], np.trace(r)]]) / 3
    q = np.linalg.eigh(k)[1][:, -1]
    return q if q[3] >= 0 else -q


def ellipsoids(rows: DataFrame, keys: list[str], cov: str, scale: float = 1.0, least: float = 1e-6) -> DataFrame:
    """(keys, half, rotation): half axes (ascending, eigenvalues at least `least`, times scale) and the quaternion (x, y, z, w) of each 3 x 3 covariance, given as nine numbers. Another length is an error."""
    fields = dict(rows.dtypes)

    def run(batches):
        for b in batches:
            half, turn = [], []
            for m in b.column(len(keys)).to_pylist():
                if m is None or len(m) != 9:
                    raise ValueError("a covariance has nine numbers")
                a = np.array(m, float).reshape(3, 3)
                e, v = np.linalg.eigh((a + a.T) / 2)
                v = v * np.sign(np.linalg.det(v))
                half.append(scale * np.sqrt(np.maximum(e, least)))
                turn.append(quaternion(v))
            kind = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(half, kind), pa.array(turn, kind)], names=[*keys, "half", "rotation"])

    return rows.select(*keys, cov).mapInArrow(run, ", ".join(f"{k} {fields[k]}" for k in keys) + ", half array<double>, rotation array<double>")


def silhouette(points: DataFrame, key: str, label: str, column: str, most: int | None = None) -> DataFrame:
    """One row: mean silhouette of the points, by Euclidean distance; null for fewer than two labels or as many as points.

    Exact, so quadratic: blocks of points, sorted by label, meet in pairs, and give a label's sums for each point of the
    other block, or, of labels that lie in one block whole, the least mean alone; a block's sums are then added in a stream.
    A point without a label counts as 0 and is no other's neighbour. More points than `most`, if given, are an error.
    """
    ensure_checkpoint(points.sparkSession)
    counts = points.groupBy(label).agg(F.count("*").alias("_n")).withColumn("_code", F.monotonically_increasing_id()).checkpoint()
    known = counts.where(F.col(label).isNotNull())
    every, total, kinds = *counts.agg(F.sum("_n")).first(), *known.agg(F.sum("_n"), F.count("*")).first()
    if most is not None and (every or 0) > most:
        raise ValueError(f"a silhouette of more than {most} points")
    if kinds < 2 or kinds == total:
        return points.sparkSession.createDataFrame([(None,)], "silhouette double")
    rows = points.join(known, label).select("_code", "_n", F.xxhash64(key).alias("_at"), F.transform(column, lambda v: v.cast("double")).alias("x"))
    cut = blocks.cut(rows, ["_code", "_at"], ["_code", "_n"], "x")
    own, size, whole = -1, -3, -2  # what a row of sums holds, if not those of one label

    def runs(b: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, code, whether all of it is here) of a block's labels."""
        start = np.concatenate([[0], np.flatnonzero(np.diff(b["_code"])) + 1])
        return start, b["_code"][start], np.diff(np.append(start, len(b["_code"]))) == b["_n"][start]

    def side(a: dict, sums: np.ndarray, b: dict) -> Iterator[tuple]:
        """Of the points of a: sums over the labels of b."""
        start, codes, full = runs(b)
        mine = a["_code"][:, None] == codes[None]
        if mine.any():
            yield a["id"], own, np.where(mine, sums, 0.0).sum(1).tobytes()
        means = np.where(mine, np.inf, sums / b["_n"][start])
        if full.any():
            yield a["id"], whole, means[:, full].min(1).tobytes()
        for k in np.flatnonzero(~full):
            yield a["id"], int(codes[k]), np.ascontiguousarray(means[:, k]).tobytes()

    def each(a: dict, b: dict) -> Iterator[tuple]:
        d = np.sqrt(blocks.squares(a["x"], b["x"]))
        yield from side(a, np.add.reduceat(d, runs(b)[0], axis=1), b)
        if a["id"] != b["id"]:
            yield from side(b, np.add.reduceat(d, runs(a)[0], axis=0).T, a)
        else:
            yield a["id"], size, a["_n"].astype(float).tobytes()

    sums = blocks.met(cut, cut.count(), each, "id long, code long, v binary").repartition("id").sortWithinPartitions("id", "code")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, now, n, a, near, mean = None, None, None, None, None, None

        def closed() -> Iterator[pa.RecordBatch]:
            if at is not None:
                low, mine = np.minimum(near, mean), a / np.maximum(1, n - 1)
                s = np.where(n > 1, (low - mine) / np.maximum(np.maximum(mine, low), 1e-300), 0.0)
                yield pa.RecordBatch.from_arrays([pa.array([float(s.sum())])], names=["s"])

        for b in batches:
            for id_, code, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                x = np.frombuffer(v.as_py(), np.float64)
                if id_ != at:
                    yield from closed()
                    at, now, n, a, near, mean = id_, None, None, np.zeros(len(x)), np.full(len(x), np.inf), np.full(len(x), np.inf)
                if code == size:
                    n = x
                elif code == own:
                    a = a + x
                elif code == whole:
                    near = np.minimum(near, x)
                else:
                    near, mean = (near, mean + x) if code == now else (np.minimum(near, mean), x)
                    now = code
        yield from closed()

    with blocks.arrow_rows(points.sparkSession, 256):
        return sums.mapInArrow(fold, "s double").agg((F.sum("s") / F.lit(float(every))).alias("silhouette")).checkpoint()
