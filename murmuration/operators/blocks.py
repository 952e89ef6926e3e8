"""Points in blocks, one row a block, and all pairs of blocks: work on all pairs of points, spread over tasks and bounded in memory.

A task holds a pair of blocks and what it gives; nothing grows with the points but the number of pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from murmuration.plans.session import ensure_checkpoint

#: Numbers in a block's vectors, about, and the blocks of a partition.
SIZE, SHARE = 1 << 15, 32
#: Pairs of blocks that pass to Python at a time.
AT_A_TIME = 8


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """So many rows at most pass to Python at a time in the jobs that run meanwhile."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def vectors(column: pa.Array) -> np.ndarray:
    """Rows of lists of doubles as a matrix; lists of another length are an error."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(column) and (len(flat) % len(column) or len(set(np.diff(column.offsets.to_numpy()))) > 1):
        raise ValueError("vectors of different lengths")
    return flat.reshape(len(column), -1)


def cut(rows: DataFrame, order: list[str | Column], numbers: list[str], vector: str, size: int = SIZE, apart: bool = False) -> DataFrame:
    """(id, numbers, x): blocks of the rows in an order, long numbers and double vectors as little-endian bytes. Checkpointed.

    apart: no block has rows of two values of the first number, by which the order begins.
    """
    ensure_checkpoint(rows.sparkSession)
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(*numbers, vector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, i, held, n = TaskContext.get().partitionId(), 0, None, 0

        def block(parts: list[np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([part << 32 | i]), *[pa.array([np.ascontiguousarray(c).tobytes()], pa.binary()) for c in parts]], names=["id", *numbers, "x"])

        for b in batches:
            now = [b.column(k).to_numpy() for k in range(len(numbers))] + [vectors(b.column(len(numbers)))]
            held = now if held is None else [np.concatenate(c) for c in zip(held, now, strict=True)]
            n = max(64, size // max(1, held[-1].shape[1]))
            while len(held[-1]):
                same = int(np.searchsorted(held[0], held[0][0], "right")) if apart else len(held[-1])
                if same < n and same == len(held[-1]):
                    break
                m = min(n, same)
                yield block([c[:m] for c in held])
                held, i = [c[m:] for c in held], i + 1
        if held is not None and len(held[-1]):
            yield block(held)

    with arrow_rows(rows.sparkSession, 10_000):
        return sorted_.mapInArrow(run, ", ".join(["id long", *[f"{c} binary" for c in numbers], "x binary"])).checkpoint()


def pairs(blocks: DataFrame, count: int) -> DataFrame:
    """(a, b): structs of all pairs of the blocks, each once, and each with itself; always dealt as pairs of partitions, never broadcast."""
    tasks = blocks.sparkSession.sparkContext.defaultParallelism
    n = max(-(-count // SHARE), min(count, 2 * int(tasks**0.5 + 1)), 1)
    dealt = blocks.repartition(n, "id")
    one, other = (dealt.select(F.struct(*blocks.columns).alias(k)) for k in "ab")
    return one.join(other.hint("shuffle_replicate_nl"), F.col("a.id") <= F.col("b.id"))


def met(blocks: DataFrame, count: int, each: Callable[[dict, dict], Iterator[tuple]], schema: str) -> DataFrame:
    """What `each` gives for each pair of blocks, as rows of a schema; checkpointed. Numbers are arrays of longs, x a matrix."""
    names = blocks.columns
    kinds = [f.dataType for f in blocks.sparkSession.createDataFrame([], schema).schema.fields]
    fields = [x.split()[0] for x in schema.split(", ")]

    def opened(row: dict) -> dict:
        n = np.frombuffer(row[names[1]], np.int64)
        return {k: v if k == "id" else np.frombuffer(v, np.float64).reshape(len(n), -1) if k == "x" else np.frombuffer(v, np.int64) for k, v in row.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        types = [to_arrow_type(k) for k in kinds]
        for batch in batches:
            for i in range(batch.num_rows):
                a, b = (opened(batch.column(k)[i].as_py()) for k in range(2))
                out = list(each(a, b))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=fields)

    with arrow_rows(blocks.sparkSession, AT_A_TIME):
        return pairs(blocks, count).mapInArrow(run, schema).checkpoint()


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all pairs; those that a product cannot tell from 0 by differences."""
    mean = x.mean(0)
    x, y = x - mean, y - mean
    xx, yy = (x * x).sum(1), (y * y).sum(1)
    d = np.column_stack([-2 * x, xx, np.ones(len(x))]) @ np.column_stack([y, np.ones(len(y)), yy]).T
    low = np.flatnonzero(d < 1e-9 * max(xx.max(), yy.max()))
    for k in range(0, len(low), 1 << 15):
        i, j = np.divmod(low[k : k + (1 << 15)], len(y))
        d[i, j] = ((x[i] - y[j]) ** 2).sum(1)
    return np.maximum(d, 0, out=d)
