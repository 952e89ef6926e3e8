"""Whitening of embeddings by Chan's pairwise merge of centred moments (Chan, Golub, LeVeque, 1979).

Every partition gives the count, exact sums, mean and centred scatter of its vectors; pairs of them merge by
M = Ma + Mb + (mb - ma)(mb - ma)' na nb / (na + nb) in a treeReduce, so that nothing but a d x d matrix a branch moves. The
driver decomposes one d x d matrix. A second pass merges the whitened vectors alike and verifies that their covariance is
the identity.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmuration.llm._common import mapped

#: Vectors centred at a time; levels of the tree of merges.
BLOCK, DEPTH = 4096, 3
#: Whole numbers beyond this are cut to it, as they would not fit 64 bits.
MOST = float(1 << 62)


@dataclass
class Moments:
    """n vectors: exact sums (whole numbers of any size; None where vectors are not whole), mean, centred scatter."""

    n: int
    sums: list[int] | None
    mean: np.ndarray
    scatter: np.ndarray

    @staticmethod
    def of(x: np.ndarray) -> Moments:
        """Of the rows of a matrix; whole numbers are centred by a whole pivot first, so that no digit of them is lost."""
        pivot = x[0]
        y = (x - pivot).astype(np.float64)
        shift = y.mean(axis=0)
        y -= shift
        whole = np.issubdtype(x.dtype, np.integer)
        big = whole and np.abs(x.astype(np.float64)).max(initial=0) * len(x) >= 2**62
        sums = [int(s) for s in (x.astype(object).sum(axis=0) if big else x.sum(axis=0))] if whole else None
        return Moments(len(x), sums, pivot + shift, y.T @ y)

    def merged(self, other: Moments) -> Moments:
        """Chan's formula. Means of whole numbers come from their exact sums."""
        n = self.n + other.n
        gap = other.mean - self.mean
        sums = [a + b for a, b in zip(self.sums, other.sums, strict=True)] if self.sums is not None else None
        mean = np.array([s / n for s in sums]) if sums is not None else self.mean + gap * (other.n / n)
        return Moments(n, sums, mean, self.scatter + other.scatter + np.outer(gap, gap) * (self.n * other.n / n))


@dataclass
class Whitening:
    """Of vectors of one length: unit components (columns) by falling variance. Those without variance whiten to zero."""

    n: int
    sums: list[int]
    mean: np.ndarray
    components: np.ndarray
    variances: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0

    @staticmethod
    def of(m: Moments, components: int) -> Whitening:
        cov = m.scatter / m.n
        e, v = np.linalg.eigh((cov + cov.T) / 2)
        e, v = e[::-1][:components].copy(), v[:, ::-1][:, :components].copy()
        e[e <= max(e[:1].max(initial=0.0), 0.0) * len(cov) * np.finfo(float).eps * 16] = 0.0
        trace = float(np.trace(cov))
        return Whitening(m.n, m.sums, np.array([s / m.n for s in m.sums]), v, e, e / trace if trace > 0 else np.zeros(len(e)))

    def project(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.components * np.where(self.variances > 0, 1 / np.sqrt(np.where(self.variances > 0, self.variances, 1)), 0)


def usable(vectors: DataFrame, vec_col: str) -> DataFrame:
    """Rows whose vector is not null and holds no null or non-finite component."""
    x = F.col(vec_col)
    return vectors.where(x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))


def whole(c: np.ndarray, scale: int, shift: int) -> np.ndarray:
    """floor(scale * c) + shift as 64-bit integers; what does not fit is cut to the largest that does."""
    return np.clip(np.floor(c.astype(np.float64) * scale), -MOST, MOST).astype(np.int64) + shift


def _by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, matrix) of a list column, for each length that occurs, BLOCK rows at a time."""
    ends = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
    sizes = np.diff(ends, prepend=0)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        for i in range(0, len(rows), BLOCK):
            part = rows[i : i + BLOCK]
            yield part, flat[(ends[part] - d)[:, None] + np.arange(d)]


def merged_moments(vectors: DataFrame, vec_col: str, make: Callable[[np.ndarray], np.ndarray]) -> dict[int, Moments]:
    """Moments of make(vectors), by vector length. Only a matrix a partition and length leaves a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, Moments] = {}
        for b in batches:
            for _, c in _by_length(b.column(0)):
                if not c.shape[1]:
                    continue
                m = Moments.of(make(c))
                found[c.shape[1]] = found[c.shape[1]].merged(m) if c.shape[1] in found else m
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(found)], pa.binary())], names=["moments"])

    def merge(a: dict[int, Moments], b: dict[int, Moments]) -> dict[int, Moments]:
        return {d: a[d].merged(b[d]) if d in a and d in b else a.get(d) or b[d] for d in a.keys() | b.keys()}

    parts = mapped(vectors.select(vec_col), run, "moments binary").rdd.map(lambda r: pickle.loads(r[0]))
    return parts.treeReduce(merge, DEPTH) if parts.getNumPartitions() else {}


def fit(vectors: DataFrame, vec_col: str = "embedding", components: int = 8, scale: int = 1024, shift: int = 100_000) -> dict[int, Whitening]:
    """A whitening for each vector length, over all usable rows, its identity error measured by a second pass over them."""
    rows = usable(vectors, vec_col)
    found = {d: Whitening.of(m, components) for d, m in merged_moments(rows, vec_col, lambda c: whole(c, scale, shift)).items()}

    def whitened(c: np.ndarray) -> np.ndarray:
        return found[c.shape[1]].project(whole(c, scale, shift))

    for d, m in merged_moments(rows, vec_col, whitened).items() if found else ():
        own = found[d].variances > 0
        found[d].identity_error = float(np.abs((m.scatter / m.n)[np.ix_(own, own)] - np.eye(int(own.sum()))).max(initial=0.0))
    return found


OUT = "id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def deviations(x: np.ndarray, w: Whitening) -> pa.Array:
    """Sum over dimensions of (n x - S)^2, exact; null where it does not fit 64 bits."""
    most = float(w.n) * float(np.abs(x).max(initial=0)) + max(map(abs, w.sums), default=0)
    if most < 2**62 and (y := w.n * x - np.array(w.sums, np.int64)).size and float((y.astype(np.float64) ** 2).sum(axis=1).max()) < 2**62:
        return pa.array((y * y).sum(axis=1))
    exact = [sum((w.n * int(c) - s) ** 2 for c, s in zip(row, w.sums, strict=True)) for row in x.tolist()]
    return pa.array([e if e < 2**63 else None for e in exact], pa.int64())


def transform(vectors: DataFrame, found: dict[int, Whitening], id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 1024, shift: int = 100_000) -> DataFrame:
    """OUT: a row a usable vector and component, components numbered from 1. The fit goes to the tasks with the code, a few vectors a length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, c in _by_length(b.column(1)):
                if not c.shape[1]:
                    continue
                w, x = found[c.shape[1]], whole(c, scale, shift)
                k = len(w.variances)
                at = pa.array(np.repeat(np.arange(len(rows)), k))
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).take(pa.array(rows)).take(at),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))),
                        pa.array(np.full(len(at), w.n)),
                        deviations(x, w).take(at),
                        pa.array(w.project(x).ravel()),
                        pa.array(np.tile(w.explained, len(rows))),
                        pa.array(np.full(len(at), w.identity_error)),
                    ],
                    names=[c.split()[0] for c in OUT.split(", ")],
                )

    return mapped(usable(vectors, vec_col).select(F.col(id_col).cast("long").alias("id"), vec_col), run, OUT)


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = 8, scale: int = 1024, shift: int = 100_000) -> DataFrame:
    """Every usable vector's first components, whitened over all usable vectors: OUT.

    A component c counts as floor(scale * c) + shift. Rows whose vector is null or holds null or non-finite entries take no
    part. Vectors of different lengths are lists of their own, each with its fit; empty vectors have no component and give
    no row. Null ids stay, repeated ids and rows count and return each. Components without variance (one vector, equal
    vectors) whiten to 0, explain 0 and are left out of the identity; tied variances take any basis of theirs. deviation is
    null where it needs more than 64 bits; components that do not fit 64 bits are cut to what does. Other columns are not
    read. Empty table: empty result.
    """
    return transform(vectors, fit(vectors, vec_col, components, scale, shift), id_col, vec_col, scale, shift)
