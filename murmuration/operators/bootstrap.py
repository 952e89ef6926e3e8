"""Reports over results: bootstrap intervals, comparisons, rates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def interval(rows: DataFrame, key: str, order: str, value: str, draws: int, seed: int) -> DataFrame:
    """(key, mean, lo, hi): mean and the 2.5 and 97.5 percentiles of the means of `draws` resamples.

    Draw (b, j) of a key takes value number md5(seed, key, b, j) mod n, so that the same draws come from any engine.
    Values are joined by (key, number), so that one key's resamples spread over all tasks.
    """
    fine = rows.where(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))).select(key, order, value)
    numbered = fine.withColumn("i", F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1).select(key, "i", value)
    sizes = fine.groupBy(key).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    picks = sizes.select(key, "n", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("b")).select(key, "n", "b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("j"))
    code = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.col(key), F.col("b"), F.col("j"))), 1, 13), 16, 10).cast("long")
    means = picks.select(key, "b", (code % F.col("n")).alias("i")).join(numbered, [key, "i"]).groupBy(key, "b").agg(F.avg(value).alias("m"))
    return means.groupBy(key).agg(F.percentile("m", 0.025).alias("lo"), F.percentile("m", 0.975).alias("hi")).join(sizes, key).select(key, "mean", "lo", "hi")


def compare(results: list[DataFrame], key: str) -> DataFrame:
    """All results side by side, nulls where one has no row for a key."""
    return reduce(lambda a, b: a.join(b, key, "full_outer"), results)


def summary(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Mean and population deviation, without NaN."""
    return rows.where(~F.isnan(value)).groupBy(key).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count("*").alias("n"))


def f1(rows: DataFrame, key: str, fn_rate: Column, fp_rate: Column, objects: Column, background: Column) -> DataFrame:
    recall = 1 - fn_rate
    hits, false = recall * objects, fp_rate * background
    precision = F.when(hits + false > 0, hits / (hits + false))
    return rows.select(key, precision.alias("precision"), recall.alias("recall"), F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0).alias("f1"))


def confusion(rows: DataFrame, key: str, is_object: Column, inside: Column) -> DataFrame:
    return rows.groupBy(key).agg(F.count_if(is_object & inside).alias("tp"), F.count_if(~is_object & ~inside).alias("tn"), F.count_if(~is_object & inside).alias("fp"), F.count_if(is_object & ~inside).alias("fn"))


def soft_iou(rows: DataFrame, key: str, q: str, r: str) -> DataFrame:
    both = F.sum(F.col(q) * F.col(r))
    return rows.groupBy(key).agg((both / (F.sum(q) + F.sum(r) - both + 1e-9)).alias("soft_iou"))


def trade_off(rows: DataFrame, level: str, order: str, metrics: list[str], draws: int, seed: int) -> DataFrame:
    """(level, metric, mean, lo, hi): each metric's mean and interval at each subsampling level; draws hang on level and metric."""
    stacked = rows.select(F.explode(F.array(*[F.struct(F.concat_ws("|", F.col(level).cast("string"), F.lit(m)).alias("k"), F.col(order).alias("o"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("s")).select("s.*")
    out = interval(stacked, "k", "o", "value", draws, seed)
    return out.select(F.split("k", r"\|")[0].alias(level), F.split("k", r"\|")[1].alias("metric"), "mean", "lo", "hi")
