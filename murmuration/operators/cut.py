"""The normalised cut of groups too large for a matrix of all pairs: the second eigenvector by a block Krylov method whose products make the affinities of two blocks of tokens at a time, and the two-part mixture by sums.

The driver holds matrices of some dozens of rows and columns for each such group; vectors of a group's length stay in blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql.classic.dataframe import DataFrame
from pyspark.sql import functions as F

from murmuration.operators import blocks

#: Vectors that are multiplied at once; of how many the basis is cut back to the best KEPT; products at most.
WIDTH, BASIS, KEPT, PASSES = 8, 96, 24, 400
#: Numbers in a block's features and places, about.
SIZE = blocks.SIZE
#: What a residual may be of the gap to the next eigenvalue, and what is taken for rounding.
CLOSE, ROUNDING = 1e-9, 1e-14


def affinity(x: np.ndarray, y: np.ndarray, temperature: float, reach: float) -> np.ndarray:
    """Affinities of all pairs of rows (features, then two places)."""
    f, g = (a[:, :-2] / np.maximum(np.linalg.norm(a[:, :-2], axis=1, keepdims=True), 1e-9) for a in (x, y))
    w = (f @ g.T - 1) / temperature
    for k in (-2, -1):
        w -= (x[:, None, k] - y[None, :, k]) ** 2 / (2 * reach**2)
    return np.exp(w, out=w)


def _matrix(data: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(data, np.float64).reshape(rows, -1)


def _product(state: DataFrame, count: int, temperature: float, reach: float) -> DataFrame:
    """(id, y): affinities times v, of blocks (id, code, x, n, v); a task adds up what it has of the two partitions that meet in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                a, b = (batch.column(k)[i].as_py() for k in range(2))
                (x, v), (y, w) = ((_matrix(r["x"], r["n"]), _matrix(r["v"], r["n"])) for r in (a, b))
                m = affinity(x, y, temperature, reach)
                sums[a["id"]] = sums.get(a["id"], 0) + m @ w
                if a["id"] != b["id"]:
                    sums[b["id"]] = sums.get(b["id"], 0) + m.T @ v
        for k, y in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([y.tobytes()], pa.binary())], names=["id", "y"])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, y = None, None
        for b in batches:
            for k, part in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if k != at and at is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([y.tobytes()], pa.binary())], names=["id", "y"])
                y = np.frombuffer(part, np.float64) + (y if k == at else 0)
                at = k
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([y.tobytes()], pa.binary())], names=["id", "y"])

    met = blocks.pairs(state.where(F.length("v") > 0).select("id", "code", "x", "n", "v"), count).where("a.code = b.code")
    return met.mapInArrow(run, "id long, y binary").repartition("id").sortWithinPartitions("id").mapInArrow(fold, "id long, y binary")


def _mapped(state: DataFrame, change: Callable[[dict], dict[str, np.ndarray]], names: list[str], out: list[str]) -> DataFrame:
    """Blocks with the columns `out` as `change` gives them, of id, code, n and the matrices `names`; other columns stay."""
    rest = [c for c in state.columns if c not in out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                r = {c: b.column(k)[i].as_py() for k, c in enumerate(b.schema.names) if c in ("id", "code", "n", *names)}
                got = change({k: _matrix(v, r["n"]) if k in names else v for k, v in r.items()})
                one = b.slice(i, 1)
                yield pa.RecordBatch.from_arrays([*(one.column(k) for k in range(len(rest))), *(pa.array([np.ascontiguousarray(got[c]).tobytes()], pa.binary()) for c in out)], names=[*rest, *out])

    kinds = dict(state.dtypes)
    return state.select(*rest, *[c for c in out if c in kinds]).mapInArrow(run, ", ".join([f"{c} {kinds[c]}" for c in rest] + [f"{c} binary" for c in out]))


def _sums(state: DataFrame, part: Callable[[dict], np.ndarray], names: list[str], plus: Callable = np.add) -> dict[int, np.ndarray]:
    """The sum of `part` over each group's blocks: small arrays, added in the tasks first."""

    def add(sums: dict[int, np.ndarray], code: int, v: np.ndarray) -> None:
        sums[code] = plus(sums[code], v) if code in sums else v

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for i in range(b.num_rows):
                r = {c: b.column(k)[i].as_py() for k, c in enumerate(b.schema.names)}
                add(sums, r["code"], part({k: _matrix(v, r["n"]) if k in names else v for k, v in r.items()}))
        for k, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([list(v.shape)], pa.list_(pa.int64())), pa.array([v.tobytes()], pa.binary())], names=["code", "shape", "v"])

    out: dict[int, np.ndarray] = {}
    for r in state.select("id", "code", "n", *names).mapInArrow(run, "code long, shape array<long>, v binary").collect():
        add(out, r.code, np.frombuffer(bytes(r.v), np.float64).reshape(r.shape))
    return out


def _kept(state: DataFrame, before: list[DataFrame]) -> DataFrame:
    """The state, checkpointed; the files of the one before, which nothing reads any more, go.

    It is read as an RDD of unknown size: Spark would carry its guess of a join's size, a product, through the
    checkpoints, a number with thrice the digits after each round.
    """
    new, spark = state.checkpoint(), state.sparkSession
    for old in before:
        file = old._jdf.queryExecution().logical().rdd().getCheckpointFile()
        if file.isDefined():
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file.get())
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    before[:] = [new]
    return DataFrame(spark._jsparkSession.createDataFrame(new._jdf.toJavaRDD(), new._jdf.schema()), spark)


def _orthonormal(gram: np.ndarray) -> np.ndarray:
    """M so that z M has orthonormal columns, where gram = z' z; directions that rounding makes are left out."""
    if not len(gram):
        return gram
    e, v = np.linalg.eigh((gram + gram.T) / 2)
    keep = e > max(1e-13 * e[-1], ROUNDING**2)
    return v[:, keep] / np.sqrt(e[keep])


def second_vectors(cut: DataFrame, count: int, temperature: float, reach: float) -> DataFrame:
    """Blocks (id, code, n, x, ...) with d, the sums of a token's affinities, and e, the second eigenvector of the group's normalised Laplacian over sqrt(d), of length 1 before.

    The first eigenvector is sqrt(d). Against it and each other all vectors of a block Krylov space are orthogonalised
    twice; the space is cut back to its best vectors when it has BASIS columns. A group is done when the residual of its
    Ritz vector is CLOSE times the gap to the next, or at the level of rounding; no end within PASSES products is an error.
    """
    joined = lambda left, right: left.join(right.hint("merge"), "id")
    ones = _mapped(cut, lambda r: {"v": np.ones((r["n"], 1))}, [], ["v"])
    state = joined(cut, _product(ones, count, temperature, reach).withColumnRenamed("y", "d")).checkpoint()
    total = _sums(state, lambda r: r["d"].sum(0), ["d"])
    if not all(np.isfinite(v).all() for v in total.values()):
        raise ValueError("features and places of a cut are finite numbers")

    def begin(r: dict) -> dict[str, np.ndarray]:
        return {"q": np.sqrt(r["d"] / total[r["code"]]), "z": np.random.default_rng(r["id"]).standard_normal((r["n"], WIDTH))}

    before: list[DataFrame] = []
    state = _kept(_mapped(state, begin, ["d"], ["q", "z"]), before)
    ritz = {k: np.ones((1, 1)) for k in total}  # q' A q of each group, its first row and column those of sqrt(d)
    width, best = dict.fromkeys(total, 0), {}
    for n in range(PASSES + 1):
        one = _sums(state, lambda r: r["q"].T @ r["z"], ["q", "z"])

        def clear(r: dict, one: dict = one) -> np.ndarray:
            return r["z"] - r["q"] @ one[r["code"]]

        both = _sums(state, lambda r, clear=clear: np.concatenate([r["q"].T, (z := clear(r)).T]) @ z, ["q", "z"])
        turn, more = {}, {}
        for k, t in ritz.items():
            m, w = len(t), width[k]
            two, gram = both[k][:m], both[k][m:] - both[k][:m].T @ both[k][:m]
            turn[k], more[k] = np.eye(m), (two, _orthonormal(gram))
            if w:
                t[:, m - w :] = one[k] + two
                t[m - w :] = t[:, m - w :].T
                values, vectors = np.linalg.eigh(t[1:, 1:])
                best[k] = np.append(0.0, vectors[:, -1])
                off = np.sqrt(max(0.0, vectors[-w:, -1] @ gram @ vectors[-w:, -1]))
                if len(values) > 1 and off <= max(CLOSE * (values[-1] - values[-2]), ROUNDING):
                    more[k] = two, np.zeros((len(gram), 0))
                elif m + WIDTH > BASIS and more[k][1].shape[1]:
                    turn[k], ritz[k] = np.zeros((m, KEPT + 1)), np.diag([1.0, *values[-KEPT:]])
                    turn[k][0, 0], turn[k][1:, 1:] = 1, vectors[:, -KEPT:]
        if not any(m.shape[1] for _, m in more.values()):
            return _mapped(state, lambda r: {"e": r["q"] @ best[r["code"]][:, None] / np.sqrt(r["d"])}, ["q", "d"], ["e"]).drop("q", "z").checkpoint()
        if n == PASSES:
            raise RuntimeError(f"no second eigenvector within {PASSES} products")

        def fresh(r: dict, clear: Callable = clear, more: dict = more) -> np.ndarray:
            two, m = more[r["code"]]
            return (clear(r) - r["q"] @ two) @ m

        # small directions were scaled up, and with them what rounding had left of the others
        again = _sums(state, lambda r, fresh=fresh: np.concatenate([r["q"].T, (z := fresh(r)).T]) @ z, ["q", "z"])
        last = {}
        for k, c in again.items():
            m = len(turn[k])
            last[k] = c[:m], _orthonormal(c[m:] - c[:m].T @ c[:m])
            width[k] = last[k][1].shape[1]
            ritz[k] = np.pad(ritz[k], (0, width[k]))
            if not width[k] and k in best:
                best[k] = best[k] if len(best[k]) == turn[k].shape[1] else np.eye(turn[k].shape[1])[-1]

        def grown(r: dict, fresh: Callable = fresh, last: dict = last, turn: dict = turn) -> dict[str, np.ndarray]:
            c, m = last[r["code"]]
            z = (fresh(r) - r["q"] @ c) @ m
            return {"q": np.concatenate([r["q"] @ turn[r["code"]], z], axis=1), "v": z / np.sqrt(r["d"])}

        state = _kept(_mapped(state, grown, ["q", "z", "d"], ["q", "v"]).drop("z"), before)
        y = F.coalesce("y", F.lit(b"")).alias("y")
        state = state.drop("v").join(_product(state, count, temperature, reach).hint("merge"), "id", "left").select(*[c for c in state.columns if c != "v"], y)
        state = _mapped(state, lambda r: {"z": r["y"] / np.sqrt(r["d"])}, ["y", "d"], ["z"]).drop("y")
        state = _kept(state, before)
    raise AssertionError


def mixture(state: DataFrame) -> DataFrame:
    """(code, token_id, q): the two-part mixture of the tokens by e, of which the part with less of it at the edge is the foreground; every step is sums of numbers over a group."""
    state = _mapped(state, lambda r: {"at": r["x"][:, -2:]}, ["x"], ["at"]).drop("x").checkpoint()
    first = _sums(state, lambda r: np.array([r["n"], r["e"].sum(), *r["at"].sum(0), r["d"].sum()], float), ["e", "at", "d"])
    middle, centre = {k: v[1] / v[0] for k, v in first.items()}, {k: v[2:4] / v[0] for k, v in first.items()}
    top = _sums(state, lambda r: np.abs(r["at"] - centre[r["code"]]).max(keepdims=True), ["at"], np.maximum)
    parts: dict[int, tuple] = {}

    def share(r: dict, parts: dict) -> np.ndarray:
        e = r["e"][:, 0]
        if not parts:
            return (e > middle[r["code"]]).astype(float)
        a, b = (np.log(p) - 0.5 * (np.log(v) + (e - m) ** 2 / v) for m, v, p in parts[r["code"]])
        return 1 / (1 + np.exp(np.clip(b - a, -60, 60)))

    def stats(r: dict, parts: dict) -> np.ndarray:
        q, d, e = share(r, parts), r["d"][:, 0], r["e"][:, 0] - middle[r["code"]]
        return np.array([[(w := p * d + 1e-12).sum(), (w * e).sum(), (w * e * e).sum(), (p * d).sum()] for p in (q, 1 - q)])

    for _ in range(50):
        got = _sums(state, lambda r, parts=parts: stats(r, parts), ["e", "d"])
        parts = {k: tuple((middle[k] + b / a, max(0.0, c / a - (b / a) ** 2) + 1e-12, f / first[k][4] + 1e-12) for a, b, c, f in v) for k, v in got.items()}

    def edge(r: dict) -> np.ndarray:
        return np.abs(r["at"] - centre[r["code"]]).max(1) > 0.9 * top[r["code"]][0, 0]

    sides = _sums(state, lambda r: np.array([((q := share(r, parts)) * (g := edge(r))).sum(), q.sum(), g.sum()]), ["e", "at"])
    turned = {k: a / max(b, 1e-9) > (g - a) / max(first[k][0] - b, 1e-9) for k, (a, b, g) in sides.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for code, ids, e, n in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                q = share({"code": code, "e": _matrix(e, n)}, parts)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, code)), pa.array(np.frombuffer(ids, np.int64)), pa.array(1 - q if turned[code] else q)], names=["code", "token_id", "q"])

    return state.select("code", "token_id", "e", "n").mapInArrow(run, "code long, token_id long, q double")


def large(tokens: DataFrame, temperature: float = 0.2, reach: float = 0.3) -> DataFrame:
    """(code, token_id, q): the cut of each group (code, a long) of tokens (token_id, feat, row, col)."""
    spark = tokens.sparkSession
    x = F.transform(F.concat("feat", F.array(F.col("row").cast("double"), F.col("col").cast("double"))), lambda v: v.cast("double"))
    rows = tokens.select("code", F.col("token_id").cast("long").alias("token_id"), x.alias("x"))
    cut = blocks.cut(rows, ["code", F.xxhash64("token_id")], ["code", "token_id"], "x", SIZE, apart=True)

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = [np.frombuffer(c, np.int64) for c in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([int(c[0]) for c in codes], pa.int64()), pa.array([len(c) for c in codes], pa.int64()), b.column(2), b.column(3)], names=["id", "code", "n", "token_id", "x"])

    with blocks.arrow_rows(spark, blocks.AT_A_TIME):
        cut = cut.mapInArrow(numbered, "id long, code long, n long, token_id binary, x binary").checkpoint()
        return mixture(second_vectors(cut, cut.count(), temperature, reach)).checkpoint()
