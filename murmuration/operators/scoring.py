"""Scores of points against blobs, blobs against hyperblobs, groups against candidate motions.

The right side is a model: as many rows as it has blobs or candidates, a few thousand at most. MODEL_ROWS is checked
before it is broadcast; a larger one is an error, as every point needs every score.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MODEL_ROWS = 100_000
#: Scores held at a time in a task.
PAIRS = 1 << 22


def small(model: DataFrame) -> DataFrame:
    if len(model.select(F.lit(1)).limit(MODEL_ROWS + 1).collect()) > MODEL_ROWS:
        raise ValueError(f"the model has more than {MODEL_ROWS} rows")
    return F.broadcast(model)


def log_normal(pairs: list[tuple[Column, Column, Column]]) -> Column:
    """Sum of normal log densities of (value, mean, variance)."""
    terms = [-0.5 * (F.log(2 * math.pi * v) + (x - m) * (x - m) / v) for x, m, v in pairs]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def uniform(*key: Column | str) -> Column:
    """A number in (0, 1) that hangs on the key alone: the first 13 hex digits of its MD5. Any engine gives the same."""
    text = F.concat_ws("|", *[F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in key])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def gumbel(*key: Column | str) -> Column:
    return -F.log(-F.log(uniform(*key)))


def feature_distance(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def assign(points: DataFrame, blobs: DataFrame, score, row: str, candidate: str) -> DataFrame:
    """(row, candidate, score): the best candidate of each row, ties to the smaller one.

    score(m) is the score against a candidate, m(name) its column. The model goes to every task as one array, and each row
    takes the best of it where it is: nothing is exploded and no point is shuffled.
    """
    names = blobs.columns
    model = small(blobs).agg(F.collect_list(F.struct(*names)).alias("_model"))
    each = lambda m: F.struct(F.round(score(lambda n: m[n]), 9).alias("score"), (-m[candidate]).alias("c"))
    best = points.crossJoin(F.broadcast(model)).select(row, F.array_max(F.transform("_model", each)).alias("b"))
    return best.select(row, (-F.col("b.c")).alias(candidate), F.col("b.score").alias("score"))


@dataclass(frozen=True)
class Model:
    """Candidates in NumPy: ids, log weights, means and variances along axes, features with the factor of their squared distance."""

    ids: np.ndarray
    log_weight: np.ndarray
    mean: np.ndarray
    variance: np.ndarray
    feature: np.ndarray
    factor: float

    @staticmethod
    def of(blobs: DataFrame, candidate: str, weight: str, means: tuple[str, ...], variance: float, feature: str, factor: float) -> Model:
        """From a table of at most MODEL_ROWS rows, in order of the candidates."""
        rows = blobs.select(candidate, weight, *means, feature).limit(MODEL_ROWS + 1).toArrow()
        if rows.num_rows > MODEL_ROWS:
            raise ValueError(f"the model has more than {MODEL_ROWS} rows")
        rows = rows.combine_chunks().sort_by(candidate)
        mean = np.column_stack([rows.column(2 + i).to_numpy() for i in range(len(means))])
        return Model(rows.column(0).to_numpy(), np.log(rows.column(1).to_numpy().astype(float)), mean, np.full(mean.shape, variance), np.array(rows.column(2 + len(means)).to_pylist(), float).reshape(len(mean), -1), factor)

    def scores(self, x: np.ndarray, f: np.ndarray) -> np.ndarray:
        """Rows x candidates: log weight, normals along the axes, features; squares are of differences, so that nothing cancels."""
        out = np.broadcast_to(self.log_weight - 0.5 * np.log(2 * np.pi * self.variance).sum(1), (len(x), len(self.ids))).copy()
        for a in range(x.shape[1]):
            out -= 0.5 * (x[:, a, None] - self.mean[None, :, a]) ** 2 / self.variance[None, :, a]
        if self.factor:
            far = (f * f).sum(1)[:, None] - 2 * f @ self.feature.T + (self.feature * self.feature).sum(1)[None]
            out -= self.factor * far
        return out


def keyed_uniform(seed: int, rows: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """uniform(seed, row, id) of all pairs, as the column expression gives it."""
    md5 = hashlib.md5
    heads = [f"{seed}|{r}|".encode() for r in rows.tolist()]
    tails = [str(i).encode() for i in ids.tolist()]
    return (np.array([int(md5(h + t).hexdigest()[:13], 16) for h in heads for t in tails], float).reshape(len(heads), len(tails)) + 0.5) / float(1 << 52)


def assign_model(points: DataFrame, model: Model, row: str, axes: tuple[str, ...], feature: str, candidate: str, seed: int | None = None, sticky: str | None = None, bonus: float = 0.0) -> DataFrame:
    """(row, candidate, score): the best candidate of each row, ties to the smaller one; scores rounded to 9 places.

    seed: draws by Gumbel noise that hangs on (seed, row, candidate) instead. sticky: a column whose candidate gets a bonus.
    The model goes to the tasks with the code; points are scored in Arrow batches, PAIRS of them and candidates at a time,
    and never move.
    """
    fields = dict(points.dtypes)
    names = [row, candidate, "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = max(1, PAIRS // max(1, len(model.ids)))
        for whole in batches:
            for at in range(0, whole.num_rows, block):
                b = whole.slice(at, block)
                x = np.column_stack([b.column(1 + i).to_numpy(zero_copy_only=False) for i in range(len(axes))])
                f = b.column(1 + len(axes)).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                s = model.scores(x, f)
                if seed is not None:
                    s -= np.log(-np.log(keyed_uniform(seed, b.column(0).to_numpy(zero_copy_only=False), model.ids)))
                if sticky:
                    s += bonus * (b.column(2 + len(axes)).to_numpy(zero_copy_only=False)[:, None] == model.ids[None])
                s = np.round(s, 9)
                z = s.argmax(axis=1)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.ids[z]), pa.array(s[np.arange(len(z)), z])], names=names)

    kind = {np.dtype(np.int32): "int", np.dtype(np.int64): "long"}[model.ids.dtype]
    own = points.select(row, *[F.col(a).cast("double").alias(a) for a in axes], F.col(feature).cast("array<double>").alias("_f"), *([F.col(sticky).alias("_sticky")] if sticky else []))
    return own.mapInArrow(run, f"`{row}` {fields[row]}, `{candidate}` {kind}, score double")


def best_rotation(blobs: DataFrame, grid: DataFrame, group: str, variance: float) -> DataFrame:
    """(group, ring, k, score): the turn of the grid (cap_grid) that explains a group's velocities v about its mean ones best.

    A turn takes +z to a direction d: with w = z x d it moves x by w x x + w x (w x x) / (1 + dz). Blobs (group, x, y, z,
    vx, vy, vz) count alike; what the turn leaves of v has the given variance along each axis. Ties to the first turn.
    """
    centre = blobs.groupBy(group).agg(*[F.avg(c).alias(f"_{c}") for c in ("x", "y", "z", "vx", "vy", "vz")])
    own = blobs.join(centre, group).select(group, *[(F.col(c) - F.col(f"_{c}")).alias(c) for c in ("x", "y", "z", "vx", "vy", "vz")])
    wx, wy = -F.col("dy"), F.col("dx")
    # with w in the plane: w x x = (wy z, -wx z, wx y - wy x)
    ax, ay, az = wy * F.col("z"), -wx * F.col("z"), wx * F.col("y") - wy * F.col("x")
    bx, by, bz = wy * az, -wx * az, wx * ay - wy * ax
    k = 1 + F.col("dz")
    off = (F.col("vx") - ax - bx / k) ** 2 + (F.col("vy") - ay - by / k) ** 2 + (F.col("vz") - az - bz / k) ** 2
    s = own.crossJoin(small(grid)).groupBy(group, "ring", "k").agg(F.round(F.sum(-off / (2 * variance)), 9).alias("score"))
    return s.groupBy(group).agg(F.max_by(F.struct("ring", "k", "score"), F.struct("score", -F.col("ring"), -F.col("k"))).alias("b")).select(group, "b.ring", "b.k", "b.score")


def best_motion(blobs: DataFrame, grid: DataFrame, group: str, variance: float) -> DataFrame:
    """(group, cand, score): the translation of the grid that explains the velocities of a group's blobs best, with its log prior."""
    e = sum(((F.col(f"v{c}") - F.col(f"t{c}")) ** 2 for c in "xyz"), F.lit(0.0))
    s = blobs.crossJoin(small(grid)).groupBy(group, "cand").agg(F.round(F.sum(-e / (2 * variance)) + F.first("log_prior"), 9).alias("score"))
    return s.groupBy(group).agg(F.max_by(F.struct("cand", "score"), F.struct("score", -F.col("cand"))).alias("b")).select(group, "b.cand", "b.score")


def motion_grid(spark, steps: int, size: float) -> DataFrame:
    """Candidate translations on a grid round zero, with an unnormalised Gaussian log prior."""
    axis = lambda n: spark.range(-steps, steps + 1).select((F.col("id") * size).alias(n))
    grid = axis("tx").crossJoin(axis("ty")).crossJoin(axis("tz"))
    key = ((F.col("tx") / size + steps) * (2 * steps + 1) + (F.col("ty") / size + steps)) * (2 * steps + 1) + F.col("tz") / size + steps
    return grid.select(F.round(key).cast("int").alias("cand"), "tx", "ty", "tz", (-0.5 * (F.col("tx") ** 2 + F.col("ty") ** 2 + F.col("tz") ** 2)).alias("log_prior"))


def cap_grid(spark, most_degrees: int, step_degrees: int) -> DataFrame:
    """Directions on a spherical cap: rings of theta, ceil(2 pi sin theta / step) of phi, at least one."""
    step = math.radians(step_degrees)
    rings = spark.range(0, most_degrees // step_degrees + 1).select(F.col("id").cast("int").alias("ring"), (F.col("id") * step).alias("theta"))
    rings = rings.withColumn("phis", F.greatest(F.lit(1), F.ceil(F.round(2 * math.pi * F.sin("theta") / step, 9))).cast("int"))
    spots = rings.select("ring", "theta", "phis", F.explode(F.sequence(F.lit(0), F.col("phis") - 1)).alias("k"))
    phi = 2 * math.pi * F.col("k") / F.col("phis")
    return spots.select("ring", "k", (F.sin("theta") * F.cos(phi)).alias("dx"), (F.sin("theta") * F.sin(phi)).alias("dy"), F.cos("theta").alias("dz"))
