"""Deterministic samples: order by a hash of the key, so that any engine and any partitioning picks the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shuffled(key: str, seed: int) -> list[Column]:
    return [F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string"))), F.col(key)]


def per_group(rows: DataFrame, groups: list[str], key: str, keep: int, seed: int) -> DataFrame:
    """Exactly `keep` rows of each group (all, of smaller ones). Spark keeps `keep` a group and task before it shuffles."""
    rank = F.row_number().over(Window.partitionBy(*groups).orderBy(*shuffled(key, seed)))
    return rows.withColumn("_rank", rank).where(F.col("_rank") <= keep).drop("_rank")


def percentage(rows: DataFrame, key: str, percent: float, seed: int) -> DataFrame:
    """max(1, floor(n * percent / 100)) rows of the table, those of least hash: no sort of the table, no task that takes them all.

    The first four hex digits of the hash make 2**16 bins; the bin where the count is reached is found from the bins'
    sizes, whole bins before it stay where they are, and only its own rows are ranked.
    """
    md5, own = shuffled(key, seed)
    bin_ = F.conv(F.substring(md5, 1, 4), 16, 10).cast("int")
    sizes = {r["_bin"]: r["count"] for r in rows.groupBy(bin_.alias("_bin")).count().collect()}  # 65,536 rows at most
    left = max(1, int(sum(sizes.values()) * percent / 100))
    edge = 1 << 16
    for b in sorted(sizes):
        if sizes[b] >= left:
            edge = b
            break
        left -= sizes[b]
    at_edge = rows.where(bin_ == edge).orderBy(md5, own).limit(left)
    return rows.where(bin_ < edge).unionByName(at_edge)
