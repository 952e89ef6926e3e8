"""Rigid alignments of many groups of pairs at once, trimmed of what fits worst.

Pairs become moments by key (partial sums); the fits, a row a key, are solved in Arrow batches; the residuals' percentile
comes from histograms that add up (operators/quantiles.py). No group of pairs is gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmuration.operators.moments import rigid_moments
from murmuration.operators.quantiles import ranked
from murmuration.plans.session import ensure_checkpoint


def fits(w: np.ndarray, sp: np.ndarray, sq: np.ndarray, cross: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(R, t) of each row with q about R p + t: weighted least squares by the singular vectors of the centred cross moments, without reflections."""
    w = np.maximum(w, 1e-12)
    mp, mq = sp / w[:, None], sq / w[:, None]
    u, _, vt = np.linalg.svd(cross - w[:, None, None] * mp[:, :, None] * mq[:, None])
    v, ut = np.swapaxes(vt, 1, 2), np.swapaxes(u, 1, 2)
    sign = np.where(np.linalg.det(v @ ut) < 0, -1.0, 1.0)
    v[:, :, 2] *= sign[:, None]
    r = v @ ut
    return r, mq - np.einsum("nij,nj->ni", r, mp)


def rigid_fits(pairs: DataFrame, keys: list[str], p: tuple[str, ...], q: tuple[str, ...], weight: str | None = None, least: int = 4) -> DataFrame:
    """(keys, n, rotation, translation): nine and three numbers; null for keys of fewer than `least` pairs or without a finite fit."""
    count = pairs.groupBy(*keys).agg(F.count("*").alias("n"), F.min(F.col(weight) if weight else F.lit(1.0)).alias("_least"))
    m = rigid_moments(pairs, keys, p, q, weight).join(count, keys)
    fields = dict(m.dtypes)
    names = [f"s_{c}" for c in (*p, *q)] + [f"s_{a}_{b}" for a in p for b in q]
    k = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, w = (b.column(k + i).to_numpy(zero_copy_only=False).astype(float) for i in range(2))
            x = np.column_stack([b.column(k + 2 + i).to_numpy(zero_copy_only=False).astype(float) for i in range(15)]) if b.num_rows else np.empty((0, 15))
            fine = (n >= least) & np.isfinite(x).all(axis=1) & np.isfinite(w) & (w > 0)
            r, t = np.full((len(n), 9), np.nan), np.full((len(n), 3), np.nan)
            if fine.any():
                rot, shift = fits(w[fine], x[fine, :3], x[fine, 3:6], x[fine, 6:].reshape(-1, 3, 3))
                r[fine], t[fine] = rot.reshape(-1, 9), shift
            ok = np.isfinite(r).all(axis=1) & np.isfinite(t).all(axis=1)
            listed = lambda a: pa.array([row.tolist() if y else None for row, y in zip(a, ok, strict=True)], pa.list_(pa.float64()))  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays([*b.columns[:k], b.column(k), listed(r), listed(t)], names=[*keys, "n", "rotation", "translation"])

    schema = ", ".join(f"`{c}` {fields[c]}" for c in keys) + ", n long, rotation array<double>, translation array<double>"
    return m.select(*keys, "n", F.col("w").cast("double").alias("w"), *[F.col(c).cast("double").alias(c) for c in names]).mapInArrow(run, schema)


def residual(p: tuple[str, ...], q: tuple[str, ...]) -> Column:
    """Distance of q from R p + t, of columns rotation and translation; null without these."""
    off = [sum((F.get("rotation", F.lit(3 * i + j)) * F.col(p[j]) for j in range(3)), F.get("translation", F.lit(i))) - F.col(q[i]) for i in range(3)]
    return F.sqrt(sum((d * d for d in off), F.lit(0.0)))


def trimmed_rigid_fits(pairs: DataFrame, keys: list[str], p: tuple[str, ...], q: tuple[str, ...], weight: str | None = None, share: float = 0.75, least: int = 4, order: str | None = None, ties: bool = True) -> DataFrame:
    """(keys, n, kept, rotation, translation): rigid fits of each key's pairs, solved again without the pairs that fit worst.

    Kept are the residuals up to their percentile `share` (as between two values it lies below the upper one, those up to
    the lower); where fewer than `least` are kept the first fit stands. Keys of fewer than `least` pairs, with a non-finite
    coordinate or without a finite fit have none; with `order`, one of the keys, these take the last fit before them among
    the rows that share all other keys (rows here are frames), else null.
    """
    ensure_checkpoint(pairs.sparkSession)
    first = rigid_fits(pairs, keys, p, q, weight, least).checkpoint()
    far = pairs.join(first.select(*keys, "rotation", "translation"), keys).withColumn("_r", residual(p, q))
    far = far.where("_r is not null and not isnan(_r)").select(*pairs.columns, "_r").checkpoint()
    bound = ranked(far, keys, "_r", lambda n: F.floor(F.lit(share) * (n - 1) + 1e-9)).select(*keys, F.col("ranked").alias("_most"))
    again = rigid_fits(far.join(bound, keys).where("_r <= _most"), keys, p, q, weight, least)
    again = again.select(*keys, F.col("n").alias("kept"), F.col("rotation").alias("_rotation"), F.col("translation").alias("_translation"))
    out = first.join(again, keys, "left")
    better = F.col("_rotation").isNotNull()
    out = out.select(*keys, "n", F.when(better, F.col("kept")).when(F.col("rotation").isNotNull(), F.col("n")).otherwise(0).cast("long").alias("kept"), F.coalesce("_rotation", "rotation").alias("rotation"), F.coalesce("_translation", "translation").alias("translation"))
    if order is None:
        return out
    others = [k for k in keys if k != order]
    before = Window.partitionBy(*others or [F.lit(0)]).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a row a frame
    return out.select(*keys, "n", "kept", *[F.last(c, ignorenulls=True).over(before).alias(c) for c in ("rotation", "translation")])
