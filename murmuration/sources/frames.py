"""Frame scans: image folders and archives as rows, and a replayed clip as a stream."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader


def file_number(path: Column) -> Column:
    """First run of digits in a file's stem, 0 without one."""
    stem = F.regexp_extract(path, r"([^/]*?)(\.[^./]*)?$", 1)
    return F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(stem, r"(\d+)", 1), F.lit("")), F.lit("9" * 18)).cast("long"), F.lit(0).cast("long"))


def list_frames(spark: SparkSession, folder: str, max_frames: int | None = None, skip: int = 0) -> DataFrame:
    """(frame_idx, path, length) of a folder's jpg, jpeg and png files in numeric order; the cut comes before the stride of skip + 1. File contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{jpg,jpeg,png}").load(folder).select("path", "length")
    ordered = files.withColumn("n", file_number(F.col("path"))).orderBy("n", "path").select("path", "length")
    if max_frames is not None:
        ordered = ordered.limit(max_frames)
    indexed = ordered.coalesce(1).mapInArrow(_numbered, "frame_idx long, path string, length long")  # one clip's files
    return indexed.where(F.col("frame_idx") % (skip + 1) == 0)


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = 0
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array(range(n, n + b.num_rows), pa.int64()), *b.columns], names=["frame_idx", *b.schema.names])
        n += b.num_rows


def disk_counts(spark: SparkSession, folder: str) -> DataFrame:
    """(video, images): image files in each subfolder of a folder. File contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{jpg,jpeg,png}").option("recursiveFileLookup", "true").load(folder).select("path")
    return files.groupBy(F.element_at(F.split("path", "/"), -2).alias("video")).agg(F.count("*").alias("images"))


def most_frames(clips: DataFrame, video: str, frame: str) -> DataFrame:
    """One row: frames of the longest clip, 0 without any."""
    return clips.groupBy(video).agg((F.max(frame) + 1).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).cast("long").alias("most"))


def images(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content) for a decoder that the caller brings."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.{jpg,jpeg,png}").load(folder).select("path", "content")


def archive_counts(spark: SparkSession, path: str) -> DataFrame:
    """(archive, sequence, jpg, png) of member names in ZIP archives; a member's sequence is its parent folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                members = [m for m in zipfile.ZipFile(io.BytesIO(data)).namelist() if "/" in m]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(members), pa.string()), pa.array(members, pa.string())], names=["archive", "member"])

    members = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "archive string, member string")
    ends = lambda *x: F.lower("member").rlike(r"\.(" + "|".join(x) + ")$")
    return members.groupBy("archive", F.element_at(F.split("member", "/"), -2).alias("sequence")).agg(F.count_if(ends("jpg", "jpeg")).alias("jpg"), F.count_if(ends("png")).alias("png"))


class LoopedFrames(DataSource):
    """A clip of `frames` frames replayed `loops` times as a stream of (frame_idx, loop, emit_idx, is_seam), `per_batch` at a time. Offsets are emission counts, so that a restart goes on where it stopped."""

    @classmethod
    def name(cls) -> str:
        return "looped_frames"

    def schema(self) -> str:
        return "frame_idx long, loop long, emit_idx long, is_seam boolean"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _LoopedReader(self.options)


class _LoopedReader(SimpleDataSourceStreamReader):
    def __init__(self, options) -> None:
        self.frames, self.loops, self.per_batch = (int(options.get(k, d)) for k, d in (("frames", 10), ("loops", 1), ("per_batch", 5)))

    def initialOffset(self) -> dict:
        return {"emitted": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        end = min(self.frames * self.loops, start["emitted"] + self.per_batch)
        return self.readBetweenOffsets(start, {"emitted": end}), {"emitted": end}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([(i % self.frames, i // self.frames, i, i % self.frames == 0 and i > 0) for i in range(start["emitted"], end["emitted"])])
