"""The tracker's step over points that are spread over many tasks: an iterated map and combine.

A frame's points stay where they are. Every pass that the step asks for scores them in Arrow batches against the model,
which goes to the tasks with the code (a row a blob, at most MODEL_ROWS), and gives one row of partial moments a blob and
task; Spark adds these up, and what comes back, a row a blob, makes the next round's model. All videos of a frame number
take part in the same passes. Draws hang on point ids, so that partitions change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmuration.operators import kernel
from murmuration.operators.scoring import MODEL_ROWS

#: Columns of points; `before`, the blob of the frame before (null or negative: none), may follow.
COLUMNS = ("video_id", "point_id", "x", "y", "z", "vx", "vy", "vz", "feat")
#: Scores held at a time, pairs of point and blob.
PAIRS = 1 << 22


def columns(points: DataFrame) -> DataFrame:
    own = [F.col("video_id").cast("string").alias("video_id"), F.col("point_id").cast("long").alias("point_id"), *[F.col(c).cast("double").alias(c) for c in COLUMNS[2:8]], F.col("feat").cast("array<double>").alias("feat")]
    before = F.coalesce(F.col("before").cast("int"), F.lit(-1)) if "before" in points.columns else F.lit(-1)
    return points.select(*own, before.alias("before"))


def blocks(b: pa.RecordBatch, sizes: dict[str, int]) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(video, places in the batch, ids, x, v, f, before) of the videos with a size, a block of at most PAIRS scores at a time."""
    names = b.column(0).to_numpy(zero_copy_only=False)
    ids, before = b.column(1).to_numpy(), b.column(9).to_numpy()
    x, v = (np.column_stack([b.column(k + i).to_numpy() for i in range(3)]) for k in (2, 5))
    f = b.column(8).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) if b.num_rows else np.empty((0, 0))
    for name in set(names.tolist()):
        if name in sizes:
            rows = np.flatnonzero(names == name)
            most = max(1, PAIRS // (sizes[name] + 1))
            for i in range(0, len(rows), most):
                r = rows[i : i + most]
                yield name, r, ids[r], x[r], v[r], f[r], before[r]


#: Order of a moments row: n, then what was asked for.
def _shapes(want: str, dims: int) -> list[tuple[str, tuple[int, ...]]]:
    out: list[tuple[str, tuple[int, ...]]] = [("n", ())]
    for c in "xv":
        out += [(c, (3,)), (2 * c, (3, 3))] if c in want else []
    return out + ([("f", (dims,))] if "f" in want else [])


def summed(points: DataFrame, asks: dict[str, kernel.Ask], h: kernel.Hypers) -> dict[str, dict[str, np.ndarray]]:
    """The moments that the asks of the videos want, over all tasks. One job; a row a blob comes back."""
    shapes = {name: _shapes(a.want, a.state.feat.shape[1]) for name, a in asks.items()}
    widths = {name: sum(int(np.prod(s)) for _, s in kinds) for name, kinds in shapes.items()}
    sizes = {name: len(a.state.weight) for name, a in asks.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            for name, _, ids, x, v, f, before in blocks(b, sizes):
                m = kernel.swept(asks[name], x, v, f, ids, h, before)[1]
                flat = np.concatenate([m[c].reshape(sizes[name], -1) for c, _ in shapes[name]], axis=1)
                total[name] = total[name] + flat if name in total else flat
        for name, m in total.items():
            some = np.flatnonzero(m[:, 0])
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(list(m[some]), pa.list_(pa.float64()))], names=["video_id", "blob", "m"])

    parts = columns(points).mapInArrow(run, "video_id string, blob int, m array<double>")
    sums = parts.groupBy("video_id", "blob").agg(F.array(*[F.sum(F.get("m", F.lit(i))) for i in range(max(widths.values()))]).alias("m")).toArrow()
    out = {name: np.zeros((sizes[name], widths[name])) for name in asks}
    for name, blob, m in zip(*(sums.column(i).to_pylist() for i in range(3)), strict=True):
        out[name][blob] = m[: widths[name]]
    found: dict[str, dict[str, np.ndarray]] = {}
    for name, m in out.items():
        at, found[name] = 0, {}
        for c, shape in shapes[name]:
            size = int(np.prod(shape))
            found[name][c] = m[:, at : at + size].reshape(sizes[name], *shape)
            at += size
    return found


def assigned(points: DataFrame, asks: dict[str, kernel.Ask], states: dict[str, kernel.State], h: kernel.Hypers) -> DataFrame:
    """(video_id, point_id, blob_id, hyperblob_id) by the asks' scores; -1 in both for outliers. No shuffle."""
    sizes, hyper = {name: len(a.state.weight) for name, a in asks.items()}, {name: s.hyper for name, s in states.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, rows, ids, x, v, f, before in blocks(b, sizes):
                z = kernel.swept(asks[name], x, v, f, ids, h, before)[0]
                inside = z < sizes[name]
                out = [np.where(inside, z, -1), np.where(inside, hyper[name][np.minimum(z, sizes[name] - 1)], -1)]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows)), pa.array(ids), *[pa.array(o.astype(np.int32)) for o in out]], names=["video_id", "point_id", "blob_id", "hyperblob_id"])

    return columns(points).mapInArrow(run, "video_id string, point_id long, blob_id int, hyperblob_id int")


def step(points: DataFrame, states: dict[str, kernel.State], h: kernel.Hypers = kernel.Hypers()) -> tuple[dict[str, kernel.State], DataFrame]:
    """One frame of every video that has a state: the states after it, and (video_id, point_id, blob_id, hyperblob_id).

    points are COLUMNS of one frame number, spread as they come; those of videos without a state are left out. Four passes
    over them, and one more where the assignment is read. Equal to kernel.step over the same points, but for the order of
    sums.
    """
    if any(len(s.weight) > MODEL_ROWS for s in states.values()):
        raise ValueError(f"a model of more than {MODEL_ROWS} blobs")
    runs = {name: kernel.updates(s, h) for name, s in states.items()}
    asks = {name: next(r) for name, r in runs.items()}
    done: dict[str, kernel.State] = {}
    while True:
        sums = summed(points, asks, h)
        after: dict[str, kernel.Ask] = {}
        for name, r in runs.items():
            try:
                after[name] = r.send(sums[name])
            except StopIteration as end:
                done[name] = end.value
        if not after:
            return done, assigned(points, asks, done, h)
        asks = after


def track(points: DataFrame, blobs: int = 16, hypers: int = 4, h: kernel.Hypers = kernel.Hypers(), segment: str | None = None) -> DataFrame:
    """(video_id, frame_idx, point_id, blob_id, hyperblob_id) of all points; frames in order, each spread over all tasks.

    A video's first frame starts its model (initial.start, by segments if named) and is then tracked like any other. What
    comes of a frame is written to the shared folder of spark.checkpoint.dir, from where the next one's stickiness reads it.
    """
    from murmuration.operators import initial
    from murmuration.plans.session import ensure_checkpoint, work_table

    spark = points.sparkSession
    ensure_checkpoint(spark)
    table = work_table(spark)
    states: dict[str, kernel.State] = {}
    last = None
    for (frame,) in points.select("frame_idx").distinct().orderBy("frame_idx").collect():
        here = points.where(F.col("frame_idx") == frame)
        new = {r[0] for r in here.select(F.col("video_id").cast("string")).distinct().collect()} - states.keys()
        if new:
            states |= initial.start(here.where(F.col("video_id").cast("string").isin(sorted(new))), blobs, hypers, h, segment)
        if h.stickiness and last is not None:
            before = spark.read.parquet(last).select(F.col("video_id"), "point_id", F.when(F.col("blob_id") >= 0, F.col("blob_id")).otherwise(F.lit(MODEL_ROWS + 1)).alias("before"))
            here = here.join(before, ["video_id", "point_id"], "left")
        here = columns(here).checkpoint()  # read five times
        own = {r[0] for r in here.select("video_id").distinct().collect()}
        after, rows = step(here, {name: states[name] for name in own}, h)
        states |= after
        last = f"{table}/frame_idx={frame}"
        rows.write.mode("overwrite").parquet(last)
    if last is None:
        return points.select(F.col("video_id").cast("string").alias("video_id"), F.col("frame_idx").cast("int").alias("frame_idx"), F.col("point_id").cast("long").alias("point_id"), F.lit(0).alias("blob_id"), F.lit(0).alias("hyperblob_id")).where("false")
    return spark.read.parquet(table).select("video_id", "frame_idx", "point_id", "blob_id", "hyperblob_id")
