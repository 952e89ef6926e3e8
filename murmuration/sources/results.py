"""Result files: JSON scans by layout, path partitions, metric fields, and the sinks that write them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def percent_of(path: Column) -> Column:
    """Percentage in a `subsample_12_5` path part: 12.5; null if there is none."""
    return F.try_to_number(F.nullif(F.replace(F.regexp_extract(path, r"subsample_(\d+(?:_\d+)?)(?:/|$)", 1), F.lit("_"), F.lit(".")), F.lit("")), F.lit("9999999.9999999")).cast("double")


def first_truthy(*values: Column) -> Column:
    """The first value that is neither null nor zero, else the last."""
    return F.coalesce(*[F.nullif(v, F.lit(0.0)) for v in values[:-1]], values[-1])


def read_results(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """JSON files of a folder, any depth, with path, video (file stem) and percent."""
    rows = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(folder)
    path = F.input_file_name()
    return rows.withColumn("path", path).withColumn("video", F.regexp_extract("path", r"([^/]+)\.json$", 1)).withColumn("percent", percent_of(F.col("path")))


def best_layout(results: DataFrame) -> DataFrame:
    """Results outside percentage folders if there are any, else those of the largest percentage."""
    top = results.agg(F.max(F.coalesce("percent", F.lit(1e9))).alias("top"))
    return results.crossJoin(F.broadcast(top)).where(F.coalesce("percent", F.lit(1e9)) == F.col("top")).drop("top")


def write_tracks(tracks: DataFrame, path: str, meta: dict[str, str], mode: str = "error") -> None:
    """Tracks as Parquet by video, and one JSON row of metadata beside them."""
    tracks.write.mode(mode).partitionBy("video_id").parquet(f"{path}/tracks")
    tracks.sparkSession.createDataFrame([meta]).coalesce(1).write.mode(mode).json(f"{path}/meta")


def read_meta(spark: SparkSession, path: str) -> dict:
    """Metadata of written tracks; {} if there is none."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(f"{path}/meta")
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return {}
    return spark.read.json(f"{path}/meta").first().asDict()


def write_table(rows: DataFrame, path: str, kind: str = "csv") -> bool:
    """CSV with a header, or JSON; nothing is written for an empty table."""
    if not rows.head(1):
        return False
    w = rows.write.mode("overwrite")
    (w.option("header", True).csv if kind == "csv" else w.json)(path)
    return True


def joined_artifacts(motion: DataFrame, tracks: DataFrame, frames: DataFrame) -> DataFrame:
    """Motion (frame_idx, px, ...) and tracks (frame_idx, px, ...) of one clip with the path of their frame (frame_idx, path), by position.

    Clips of different lengths or pixels, or with fewer frames than the motion has, are an error; further frames are ignored.
    """
    shape = lambda df: tuple(df.agg(F.count_distinct("frame_idx"), F.count_distinct("px"), F.count("*")).first())
    a, b = shape(motion), shape(tracks)
    if a != b:
        raise ValueError(f"motion has (frames, pixels, rows) {a}, tracks {b}")
    if frames.where(F.col("frame_idx") < a[0]).count() < a[0]:
        raise ValueError(f"fewer than {a[0]} frames")
    return motion.join(tracks, ["frame_idx", "px"]).join(frames.select("frame_idx", "path"), "frame_idx")


def video_paths(roots: dict[str, str], video: str) -> dict[str, str]:
    """Where each kind of artifact of a video lies: {video} in a root is replaced, else the name is appended."""
    return {k: r.format(video=video) if "{video}" in r else f"{r.rstrip('/')}/{video}" for k, r in roots.items()}
