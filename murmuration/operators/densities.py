"""Densities and draws of the model's distributions: as expressions of columns, and in NumPy for a row a blob."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmuration.operators import scoring
from murmuration.operators.kernel import floor_eigen

#: A symmetric 3 x 3 matrix as columns.
SYMMETRIC = ("xx", "xy", "xz", "yy", "yz", "zz")
Matrix = dict[str, Column]


def categorical(logits: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Index of a draw for each row, by Gumbel noise from uniforms of the same shape."""
    return (logits - np.log(-np.log(u))).argmax(axis=-1)


def categorical_log_density(values: np.ndarray, support: np.ndarray, log_p: np.ndarray) -> np.ndarray:
    """Log probability of each value; -inf outside the support; equal support rows add up."""
    same = np.all(np.isclose(values[:, None], support[None]), axis=-1) if support.ndim > 1 else values[:, None] == support[None]
    p = np.where(same, np.exp(log_p)[None], 0).sum(axis=1)
    return np.log(p, out=np.full(len(values), -np.inf), where=p > 0)


def _log_gamma(d: int, x: float) -> float:
    return d * (d - 1) / 4 * math.log(math.pi) + sum(math.lgamma(x - i / 2) for i in range(d))


def wishart_log_density(x: np.ndarray, nu: float, scale: np.ndarray) -> float:
    d = len(x)
    return float((nu - d - 1) / 2 * np.linalg.slogdet(x)[1] - np.trace(np.linalg.solve(scale, x)) / 2 - nu * d / 2 * math.log(2) - nu / 2 * np.linalg.slogdet(scale)[1] - _log_gamma(d, nu / 2))


def inverse_wishart_log_density(x: np.ndarray, nu: float, psi: np.ndarray) -> float:
    """The Wishart density of the inverse, with the Jacobian -(d + 1) log det x."""
    return wishart_log_density(np.linalg.inv(x), nu, np.linalg.inv(psi)) - (len(x) + 1) * float(np.linalg.slogdet(x)[1])


def wishart(rng: np.random.Generator, nu: float, scale: np.ndarray) -> np.ndarray:
    """Bartlett's decomposition."""
    d = len(scale)
    a = np.diag(np.sqrt(rng.chisquare(nu - np.arange(d))))
    a[np.tril_indices(d, -1)] = rng.normal(size=d * (d - 1) // 2)
    b = np.linalg.cholesky(scale) @ a
    return b @ b.T


def inverse_wishart(rng: np.random.Generator, nu: float, psi: np.ndarray) -> np.ndarray:
    return floor_eigen(np.linalg.inv(wishart(rng, nu, np.linalg.inv(psi))), 1e3)


def von_mises_fisher_log_density(x: np.ndarray, mean: np.ndarray, kappa: float) -> np.ndarray:
    """On the sphere in three dimensions."""
    return kappa * (x @ mean) + math.log(kappa) - math.log(2 * math.pi) - kappa - math.log1p(-math.exp(-2 * kappa))


def sample_covariance(x: np.ndarray) -> np.ndarray:
    """Identity for one point or none; eigenvalues at least 1e-6."""
    return np.eye(x.shape[1]) if len(x) <= 1 else floor_eigen(np.cov(x.T), 1e12)


def matrix(prefix: str) -> Matrix:
    return {k: F.col(f"{prefix}{k}") for k in SYMMETRIC}


def determinant(m: Matrix) -> Column:
    return m["xx"] * (m["yy"] * m["zz"] - m["yz"] * m["yz"]) - m["xy"] * (m["xy"] * m["zz"] - m["yz"] * m["xz"]) + m["xz"] * (m["xy"] * m["yz"] - m["yy"] * m["xz"])


def inverse(m: Matrix) -> Matrix:
    """By cofactors."""
    d = determinant(m)
    return {
        "xx": (m["yy"] * m["zz"] - m["yz"] * m["yz"]) / d, "xy": (m["xz"] * m["yz"] - m["xy"] * m["zz"]) / d, "xz": (m["xy"] * m["yz"] - m["xz"] * m["yy"]) / d,
        "yy": (m["xx"] * m["zz"] - m["xz"] * m["xz"]) / d, "yz": (m["xz"] * m["xy"] - m["xx"] * m["yz"]) / d, "zz": (m["xx"] * m["yy"] - m["xy"] * m["xy"]) / d,
    }


def trace_product(m: Matrix, a: np.ndarray) -> Column:
    """tr(A M) of a symmetric A."""
    i = {"x": 0, "y": 1, "z": 2}
    return sum((float(a[i[k[0]], i[k[1]]]) * (1 if k[0] == k[1] else 2) * m[k] for k in SYMMETRIC), F.lit(0.0))


def wishart_density(m: Matrix, nu: float, scale: np.ndarray) -> Column:
    """Log density of W(nu, scale) at m; null where m is not of full rank."""
    fixed = -nu * 3 / 2 * math.log(2) - nu / 2 * float(np.linalg.slogdet(scale)[1]) - _log_gamma(3, nu / 2)
    d = determinant(m)
    return F.when(d > 0, (nu - 4) / 2 * F.log(d) - trace_product(m, np.linalg.inv(scale)) / 2 + fixed)


def inverse_wishart_density(m: Matrix, nu: float, psi: np.ndarray) -> Column:
    """Log density of IW(nu, psi) at m; null where m is not of full rank."""
    fixed = nu / 2 * float(np.linalg.slogdet(psi)[1]) - nu * 3 / 2 * math.log(2) - _log_gamma(3, nu / 2)
    d = determinant(m)
    return F.when(d > 0, fixed - (nu + 4) / 2 * F.log(d) - trace_product(inverse(m), psi) / 2)


def normal(*key: Column | str) -> Column:
    """A standard normal that hangs on the key alone, by Box and Muller."""
    return F.sqrt(-2 * F.log(scoring.uniform(F.lit("r"), *key))) * F.cos(2 * math.pi * scoring.uniform(F.lit("a"), *key))


def chi_square(n: int, *key: Column | str) -> Column:
    """Sum of n squared normals."""
    return F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.pow(normal(*key, k), 2.0)), F.lit(0.0), lambda a, x: a + x)


def wishart_draw(nu: int, scale: np.ndarray, *key: Column | str) -> Matrix:
    """A draw of W(nu, scale), nu whole and at least 3, by Bartlett's decomposition; it hangs on the key alone."""
    low = np.linalg.cholesky(scale)
    a = [[F.sqrt(chi_square(nu - i, *key, F.lit(f"c{i}"))) if i == j else normal(*key, F.lit(f"n{i}{j}")) if i > j else F.lit(0.0) for j in range(3)] for i in range(3)]
    b = [[sum((float(low[i, k]) * a[k][j] for k in range(j, i + 1)), F.lit(0.0)) for j in range(3)] for i in range(3)]
    return {k: sum((b["xyz".index(k[0])][j] * b["xyz".index(k[1])][j] for j in range(3)), F.lit(0.0)) for k in SYMMETRIC}


def inverse_wishart_draw(rows: DataFrame, nu: int, psi: np.ndarray, *key: Column | str) -> DataFrame:
    """rows with columns xx to zz: a draw of IW(nu, psi) for each."""
    drawn = rows.withColumns({f"_w{k}": c for k, c in wishart_draw(nu, np.linalg.inv(psi), *key).items()})
    return drawn.withColumns(inverse(matrix("_w"))).drop(*[f"_w{k}" for k in SYMMETRIC])


def categorical_density(rows: DataFrame, support: DataFrame, value: str, weight: str) -> DataFrame:
    """rows with log_p: log of the share of weight that the row's value has in the support; equal values of the support add up, others have none (null)."""
    total = support.agg(F.sum(weight).alias("_total"))  # one row
    share = support.groupBy(value).agg(F.sum(weight).alias("_w")).crossJoin(F.broadcast(total)).select(value, F.log(F.col("_w") / F.col("_total")).alias("log_p"))
    return rows.join(scoring.small(share), value, "left")


def categorical_draw(rows: DataFrame, support: DataFrame, row: str, candidate: str, weight: str, seed: int) -> DataFrame:
    """(row, candidate, score): a draw of the support (candidates are numbers) for each row, by weight; it hangs on seed, row and candidate alone."""
    return scoring.assign(rows, support, lambda m: F.log(m(weight)) + scoring.gumbel(F.lit(seed), row, m(candidate)), row, candidate)
