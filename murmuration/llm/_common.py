"""Shared helpers: the shared work folder, written tables, and joins that survive hot keys."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import TypeVar

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from murmuration.llm import files

T = TypeVar("T")

#: A key with at least this share of all rows is hot; at most 1 / HOT_SHARE keys can be.
HOT_SHARE = 1e-3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir, which driver and executors share.

    Only where neither the setting nor the context names a folder and the master is local (tests) is a temporary one
    set; on a cluster that is an error. Folders are removed when the application ends.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="murmuration-"))
        root = spark.sparkContext.getCheckpointDir()
    path = f"{root.rstrip('/')}/murmuration-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(where)
    fs.deleteOnExit(where)
    return fs.makeQualified(where).toString() if "://" not in path else path


#: Rows that pass to Python at a time where texts do.
TEXT_ROWS = 1000


def written(df: DataFrame, folder: str, name: str, rows: int | None = None) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: lineage ends there, and a lost executor loses nothing.

    rows: so many at most pass to Python at a time while this is written.
    """
    path, key, conf = f"{folder}/{name}", "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession.conf
    before = conf.get(key)
    try:
        if rows:
            conf.set(key, rows)
        df.write.mode("overwrite").parquet(path)
    finally:
        conf.set(key, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: What a Python worker keeps for the tasks of one module, and which.
_KEPT: dict[object, object] = {}
_OWNER: list[str | None] = [None]


def kept(key: object, make: Callable[[], T]) -> T:
    """make(), once for each Python worker and key, until a task of another module begins there."""
    if key not in _KEPT:
        _KEPT[key] = make()
    return _KEPT[key]


def _begin(module: str) -> None:
    if _OWNER[0] != module:
        _KEPT.clear()
        _OWNER[0] = module


def _trim() -> None:
    """Give freed memory back: the workers of an executor share a limit with its JVM."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def mapped(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """df.mapInArrow, leaving little memory behind: what other modules kept goes before, what was freed after."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _begin(function.__module__)
        yield from function(batches)
        _trim()

    return df.mapInArrow(run, schema)


def drop(spark: SparkSession, folder: str, *names: str) -> None:
    """Delete tables of the shared folder that nothing reads any more."""
    for name in names:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def join_groups(rows: DataFrame, groups: DataFrame, key: str, count: str, total: int, grows: bool = False, listed: bool = False) -> DataFrame:
    """Left join of rows with groups (one row per key; `count` says how many rows have it), even if one key has most rows.

    Two branches that the optimizer cannot merge: keys with at least HOT_SHARE of the rows are at most 1000, whatever the
    data, so those are broadcast and their rows stay where they are; the rest are dealt by the key, none of which has more
    than that share. Null keys meet nothing and stay where they are. `rows` is read twice.
    grows: the groups grow with the rows, so that the rest is merged at every size, never broadcast while it happens to be small.
    listed: the hot keys, those 1000 at most, are listed on the driver, and a filter tells the rest from them; an anti join
    would stand in the plan or not by whether there is a hot key.
    """
    values = [c for c in groups.columns if c not in (key, count)]
    least = max(2.0, total * HOT_SHARE)
    named = groups.select(F.col(key).alias("_k"), F.col(count).alias("_n"), *values)
    hot = F.broadcast(named.where(F.col("_n") >= least).drop("_n").withColumn("_hot", F.lit(True)))
    here = rows.join(hot, F.col(key) == F.col("_k"), "left").where(F.col("_hot") | F.col(key).isNull()).drop("_k", "_hot")
    rest = rows.where(F.col(key).isNotNull())
    if listed:
        keys = [r[0] for r in named.where(F.col("_n") >= least).select("_k").collect()]
        rest = rest.where(~F.col(key).isin(keys)) if keys else rest
    else:
        rest = rest.join(hot, F.col(key) == F.col("_k"), "left_anti")
    cold = named.where(F.col("_n") < least).drop("_n")
    rest = rest.join(cold.hint("merge") if grows else cold, F.col(key) == F.col("_k"), "left").drop("_k")
    return here.unionByName(rest)


#: Rows of one file whose marks are kept together.
MARKED = 1 << 20


def located(rows: DataFrame, name: str, folder: str) -> DataFrame:
    """rows with a column `name`, struct<file long, row long>: the Parquet file (by a hash of its path) that a row stands in and its number there.

    What does not come straight from Parquet files is written to the folder first.
    """

    def at(df: DataFrame) -> DataFrame:
        meta = df.metadataColumn("_metadata")
        return df.withColumn(name, F.struct(F.xxhash64(meta["file_path"]).alias("file"), meta["row_index"].alias("row")))

    try:
        return at(rows)
    except AnalysisException:
        return at(written(rows, folder, f"located_{uuid.uuid4().hex}", TEXT_ROWS))


class Marks:
    """Numbers beside rows of Parquet files, kept in files of their own: one for each MARKED rows of a file that has any.

    A task that reads the rows reads the marks of these alone. So the rows, which may hold long texts, meet their marks
    where they are, without a shuffle or a broadcast, however many marks there are.
    """

    def __init__(self, marks: DataFrame, folder: str) -> None:
        """marks: (file long, row long, mark long), at most one a row."""
        self.folder, self.size = folder, MARKED
        path, size = self._path, self.size

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, held, n = None, [], 0

            def close() -> None:
                if now is not None:
                    files.put(path(*now), np.concatenate(held, axis=1).tobytes())

            for b in batches:
                file, row, mark = (c.to_numpy() for c in b.columns)
                chunk = row // size
                edges = np.flatnonzero((file[1:] != file[:-1]) | (chunk[1:] != chunk[:-1])) + 1
                for i, j in zip([0, *edges], [*edges, len(row)], strict=True):
                    if i == j:
                        continue
                    if (int(file[i]), int(chunk[i])) != now:
                        close()
                        now, held = (int(file[i]), int(chunk[i])), []
                    held.append(np.stack([row[i:j], mark[i:j]]))
                    n += int(j - i)
            close()
            yield pa.RecordBatch.from_arrays([pa.array([n])], names=["n"])

        chunk = F.floor(F.col("row") / size)
        dealt = marks.select("file", "row", F.col("mark").cast("long").alias("mark")).repartition("file", chunk).sortWithinPartitions("file", "row")
        self.count = mapped(dealt, run, "n long").agg(F.sum("n")).first()[0] or 0
        self._held: tuple[object, np.ndarray, np.ndarray] | None = None

    def _path(self, file: int, chunk: int) -> str:
        return f"{self.folder}/{file & (1 << 64) - 1:016x}-{chunk}"

    def of(self, place: pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
        """(whether a row has a mark, the mark or 0), in a task."""
        file, row = (place.field(i).to_numpy() for i in range(2))
        chunk, has, mark = row // self.size, np.zeros(len(row), bool), np.zeros(len(row), np.int64)
        for key in {(int(f), int(c)) for f, c in np.unique(np.stack([file, chunk]), axis=1).T}:
            if self._held is None or self._held[0] != key:
                data = np.frombuffer(files.get(self._path(*key)) or b"", np.int64).reshape(2, -1)
                self._held = key, data[0], data[1]
            own = np.flatnonzero((file == key[0]) & (chunk == key[1]))
            if len(self._held[1]):
                at = np.minimum(np.searchsorted(self._held[1], row[own]), len(self._held[1]) - 1)
                hit = self._held[1][at] == row[own]
                has[own[hit]], mark[own[hit]] = True, self._held[2][at[hit]]
        return has, mark


def without(rows: DataFrame, place: str, gone: DataFrame, folder: str) -> DataFrame:
    """The located rows but those of gone (file, row), without the column `place`."""
    marks = Marks(gone.select("file", "row", F.lit(0).alias("mark")), folder)
    at = rows.columns.index(place)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = pa.array(~marks.of(b.column(at))[0])
            yield b.select([i for i in range(b.num_columns) if i != at]).filter(keep)

    return mapped(rows, run, rows.drop(place).schema)


def private(name: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
