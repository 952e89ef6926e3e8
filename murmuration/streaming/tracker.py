"""The tracker over frames: a batch fold, and the same step as a stateful streaming processor.

A frame is one row with its points as an array, so that a frame is never split; frames of a video are folded in order.
Videos are independent and run in parallel.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from murmuration.operators import kernel

OUT = "video_id string, frame_idx int, point_id long, blob_id int, hyperblob_id int"


def frames(points: DataFrame) -> DataFrame:
    """(video_id, frame_idx, points): one row a frame, points in order of id."""
    p = F.struct("point_id", "x", "y", "z", "vx", "vy", "vz", "feat")
    return points.groupBy("video_id", "frame_idx").agg(F.array_sort(F.collect_list(p)).alias("points"))


def arrays(points) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    rows = [(p if isinstance(p, dict) else p.asDict()) for p in points]
    x = np.array([[r["x"], r["y"], r["z"]] for r in rows], float).reshape(-1, 3)
    v = np.array([[r["vx"], r["vy"], r["vz"]] for r in rows], float).reshape(-1, 3)
    return np.array([r["point_id"] for r in rows], np.int64), x, v, np.array([r["feat"] for r in rows], float).reshape(len(rows), -1)


def advance(state: kernel.State | None, points, blobs: int, hypers: int, h: kernel.Hypers) -> tuple[kernel.State, np.ndarray]:
    """The next state and the frame's point ids; a first frame starts the model and is then tracked like any other."""
    ids, x, v, f = arrays(points)
    if state is None:
        state = kernel.start(x, v, f, blobs, hypers, h)
    return kernel.step(state, x, v, f, h, ids), ids


def rows(video: str, frame: int, state: kernel.State, ids: np.ndarray) -> pd.DataFrame:
    """Outliers are -1 in both columns."""
    z = state.assigned
    inside = z < len(state.weight)
    blob = np.where(inside, z, -1)
    return pd.DataFrame({"video_id": video, "frame_idx": frame, "point_id": ids, "blob_id": blob, "hyperblob_id": np.where(inside, state.hyper[np.minimum(z, len(state.hyper) - 1)], -1)})


def _folded(points: DataFrame, blobs: int, hypers: int, h: kernel.Hypers, emit, schema: str) -> DataFrame:
    """emit(video, frame, state, ids) of every frame: rows come sorted by video and frame, and a task holds one frame and one model at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, video, state, held = None, None, None, []

        def close() -> pa.RecordBatch:
            nonlocal state, video
            if now[0] != video:
                state, video = None, now[0]
            cols = [np.concatenate([c[i] for c in held]) for i in range(4)]
            if state is None:
                state = kernel.start(*cols[1:], blobs, hypers, h)
            state = kernel.step(state, *cols[1:], h, cols[0])
            return emit(video, now[1], state, cols[0])

        for b in batches:
            names, frames_ = b.column(0).to_pylist(), b.column(1).to_pylist()
            edges = [i for i in range(1, b.num_rows) if names[i] != names[i - 1] or frames_[i] != frames_[i - 1]]
            for begin, end in zip([0, *edges], [*edges, b.num_rows], strict=True):
                if begin == end:
                    continue
                if now is not None and (names[begin], frames_[begin]) != now:
                    yield close()
                    held = []
                now, c = (names[begin], frames_[begin]), b.slice(begin, end - begin)
                x, v = (np.column_stack([c.column(k + i).to_numpy(zero_copy_only=False) for i in range(3)]).astype(float) for k in (3, 6))
                held.append((c.column(2).to_numpy(zero_copy_only=False), x, v, c.column(9).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(end - begin, -1)))
        if held:
            yield close()

    rows_ = points.select("video_id", "frame_idx", F.col("point_id").cast("long").alias("point_id"), "x", "y", "z", "vx", "vy", "vz", "feat")
    return rows_.repartition("video_id").sortWithinPartitions("video_id", "frame_idx", "point_id").mapInArrow(run, schema)


def track(points: DataFrame, blobs: int = 16, hypers: int = 4, h: kernel.Hypers = kernel.Hypers()) -> DataFrame:
    """(video_id, frame_idx, point_id, blob_id, hyperblob_id) of every point; each video's frames in order."""
    kinds = pa.schema([("video_id", pa.string()), ("frame_idx", pa.int32()), ("point_id", pa.int64()), ("blob_id", pa.int32()), ("hyperblob_id", pa.int32())])
    return _folded(points, blobs, hypers, h, lambda *a: pa.RecordBatch.from_pandas(rows(*a), kinds, preserve_index=False), OUT)


MODEL = "video_id string, frame_idx int, level string, id int, parent int, weight double, mean array<double>, cov array<double>, velocity array<double>, feature array<double>"


def model_rows(video: str, frame: int, s: kernel.State) -> pa.RecordBatch:
    """A row a blob and a row a hyperblob: weight, mean, covariance (row by row), velocity or translation, feature; parent is a blob's hyperblob."""
    n, k = len(s.weight), len(s.h_mean)
    h_weight = s.h_weight if s.h_weight is not None else np.full(k, 1 / max(1, k))
    listed = lambda a, b: [x.ravel().tolist() for x in (*a, *b)]
    kind = pa.list_(pa.float64())
    cols = [
        pa.array([video] * (n + k)), pa.array([frame] * (n + k), pa.int32()), pa.array(["blob"] * n + ["hyperblob"] * k), pa.array([*range(n), *range(k)], pa.int32()), pa.array([*s.hyper.tolist(), *[None] * k], pa.int32()),
        pa.array(np.concatenate([s.weight, h_weight])), pa.array(listed(s.mean, s.h_mean), kind), pa.array(listed(s.cov, s.h_cov), kind), pa.array(listed(s.vel, s.h_trans), kind), pa.array(listed(s.feat, s.h_feat), kind),
    ]
    return pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in MODEL.split(", ")])


def models(points: DataFrame, blobs: int = 16, hypers: int = 4, h: kernel.Hypers = kernel.Hypers()) -> DataFrame:
    """The model after every frame as a table (MODEL): weights, means and covariances of blobs and hyperblobs."""
    return _folded(points, blobs, hypers, h, lambda video, frame, state, ids: model_rows(video, frame, state), MODEL)


def dense_assign(points: DataFrame, state: kernel.State, h: kernel.Hypers = kernel.Hypers(), terms: str = "pvf") -> DataFrame:
    """(video_id, frame_idx, point_id, blob_id, hyperblob_id) of any number of points against one frozen state, without a shuffle.

    The state has a row a blob and goes to the tasks with the code; points are scored in Arrow batches, blocks at a time.
    """
    if len(state.weight) > 100_000:
        raise ValueError("the state has more blobs than fit beside a batch")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = max(1, 4_000_000 // (len(state.weight) + 1))
        for b in batches:
            for i in range(0, b.num_rows, block):
                c = b.slice(i, block)
                col = lambda n, c=c: c.column(c.schema.get_field_index(n))
                x, v = (np.column_stack([col(n).to_numpy(zero_copy_only=False) for n in names]).astype(float) for names in (("x", "y", "z"), ("vx", "vy", "vz")))
                f = col("feat").flatten().to_numpy(zero_copy_only=False).reshape(c.num_rows, -1)
                z = kernel.scores(x, v, f, state, h, terms).argmax(axis=1)
                inside = z < len(state.weight)
                out = [np.where(inside, z, -1), np.where(inside, state.hyper[np.minimum(z, len(state.hyper) - 1)], -1)]
                yield pa.RecordBatch.from_arrays([col("video_id"), col("frame_idx"), col("point_id"), *[pa.array(o.astype(np.int32)) for o in out]], names=["video_id", "frame_idx", "point_id", "blob_id", "hyperblob_id"])

    return points.select("video_id", "frame_idx", "point_id", "x", "y", "z", "vx", "vy", "vz", "feat").mapInArrow(run, OUT)


class Tracker(StatefulProcessor):
    """Keeps a video's model as state; frames of a batch in order, frames not after the last one seen are late and dropped."""

    def __init__(self, blobs: int, hypers: int, h: kernel.Hypers) -> None:
        self.blobs, self.hypers, self.h = blobs, hypers, h

    def init(self, handle) -> None:
        self.state = handle.getValueState("state", "model binary, last int")

    def handleInputRows(self, key, batches, timerValues) -> Iterator[pd.DataFrame]:
        state, last = None, -1
        if self.state.exists():
            model, last = self.state.get()
            state = pickle.loads(model)
        for r in pd.concat(list(batches)).sort_values("frame_idx").itertuples():
            if r.frame_idx <= last:
                continue
            state, ids = advance(state, r.points, self.blobs, self.hypers, self.h)
            last = int(r.frame_idx)
            yield rows(key[0], last, state, ids)
        if state is not None:
            self.state.update((pickle.dumps(state), last))

    def close(self) -> None:
        pass


def track_stream(frame_rows: DataFrame, blobs: int = 16, hypers: int = 4, h: kernel.Hypers = kernel.Hypers()) -> DataFrame:
    """The same over a stream of frames(points) rows; needs the RocksDB state store."""
    return frame_rows.groupBy("video_id").transformWithStateInPandas(statefulProcessor=Tracker(blobs, hypers, h), outputStructType=OUT, outputMode="append", timeMode="None")
