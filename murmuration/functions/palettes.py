"""Colours of ids: evenly spaced hues in a seeded order, as a table to join."""

from __future__ import annotations

import colorsys
import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def distinct(n: int, seed: int = 0, saturation: float = 0.75, value: float = 0.95) -> list[tuple[int, int, int]]:
    hues = [i / max(1, n) for i in range(n)]
    random.Random(seed).shuffle(hues)
    return [tuple(round(255 * c) for c in colorsys.hsv_to_rgb(h, saturation, value)) for h in hues]


def clusters(front: int, total: int, seed: int = 0) -> list[tuple[int, int, int]]:
    """Vivid colours for ids below `front`, muted ones for the rest."""
    return distinct(front, seed) + distinct(max(0, total - front), seed + 1, 0.25, 0.6)


def table(spark: SparkSession, colours: list[tuple[int, int, int]]) -> DataFrame:
    return spark.createDataFrame([(i, *c) for i, c in enumerate(colours)], "id int, r int, g int, b int")


def paint(rows: DataFrame, id_col: str, colours: list[tuple[int, int, int]], background: tuple[int, int, int] = (40, 40, 40)) -> DataFrame:
    """Rows with r, g, b of their id; ids without a colour get the background. The palette is a constant, not data."""
    p = table(rows.sparkSession, colours).withColumnRenamed("id", id_col)
    return rows.join(F.broadcast(p), id_col, "left").na.fill(dict(zip("rgb", background, strict=True)))


def packed(id_: Column) -> list[Column]:
    """Bytes (b, g, r) of an instance id; 0 is white."""
    byte = lambda s: F.when(id_ == 0, 255).otherwise(F.shiftright(id_, s).bitwiseAND(255))
    return [byte(0).alias("b"), byte(8).alias("g"), byte(16).alias("r")]
