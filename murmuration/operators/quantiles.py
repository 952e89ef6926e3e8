"""Exact order statistics by key without gathering a key's values: histograms that narrow down on a rank.

Each pass counts a key's values in BINS equal parts of what is left of their range and keeps each part's least and largest
value; the part that holds the rank is the next range. Counts add up, so one key may hold any share of the rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmuration.plans.session import ensure_checkpoint

BINS = 4096


def narrowed(rows: DataFrame, keys: list[str], targets: list[tuple[str, Callable[[Column], Column]]]) -> DataFrame:
    """(keys, n, ranked): the values of several targets (value column, rank(n)) of each key, as an array in their order.

    A target's values are doubles, not null or NaN; rank counts from 0 and may be any function of their number n, which is
    an array too. All targets share each pass over the rows; what a pass counts is only what is left of their ranges. Some
    two to four passes, as each narrows a range BINS times; what is joined to the rows is a row a key.
    """
    ensure_checkpoint(rows.sparkSession)
    value = [F.when(~F.isnan(v), v) for v in (F.col(c).cast("double") for c, _ in targets)]
    rows = rows.select(*keys, F.array(*value).alias("_v"))
    each = rows.select(*keys, F.posexplode("_v").alias("_t", "_x")).where("_x is not null") if len(targets) > 1 else rows.select(*keys, F.lit(0).alias("_t"), F.get("_v", F.lit(0)).alias("_x")).where("_x is not null")
    at = each.groupBy(*keys, "_t").agg(F.count("*").alias("n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    rank = F.lit(0)
    for i, (_, of) in enumerate(targets):
        rank = F.when(F.col("_t") == i, of(F.col("n"))).otherwise(rank)
    at = at.withColumn("_rank", F.greatest(F.lit(0), F.least(F.col("n") - 1, rank)).cast("long")).checkpoint()
    order = Window.partitionBy(*keys, "_t").orderBy("_bin")  # BINS rows a key and target
    while at.where("_lo < _hi").head(1):
        live = at.where("_lo < _hi").groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_t", F.struct("n", "_rank", "_lo", "_hi")))).alias("_m"))
        met = rows.join(live, keys) if keys else rows.crossJoin(live)
        kept = F.filter(F.transform("_v", lambda x, t: F.struct(t.alias("_t"), x.alias("_x"), F.element_at("_m", t).alias("_r"))), lambda e: e["_x"].between(e["_r"]["_lo"], e["_r"]["_hi"]))
        left = met.select(*keys, F.explode(kept).alias("_e")).select(*keys, "_e._t", "_e._x", "_e._r.*")
        span = F.col("_hi") / 2 - F.col("_lo") / 2  # halves, so that no range is infinite
        part = F.when(span > 0, F.least(F.lit(BINS - 1), F.floor((F.col("_x") / 2 - F.col("_lo") / 2) / span * BINS))).otherwise((F.col("_x") > F.col("_lo")).cast("int")).cast("int")
        counts = left.groupBy(*keys, "_t", "n", "_rank", part.alias("_bin")).agg(F.count("*").alias("_c"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
        upto = counts.withColumn("_upto", F.sum("_c").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        new = upto.where((F.col("_upto") > F.col("_rank")) & (F.col("_upto") - F.col("_c") <= F.col("_rank")))
        new = new.select(*keys, "_t", "n", "_lo", "_hi", (F.col("_rank") - F.col("_upto") + F.col("_c")).alias("_rank"))
        at = new.unionByName(at.where("_lo >= _hi")).checkpoint()
    found = at.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_t", F.struct("n", F.col("_lo").alias("ranked"))))).alias("_m"))
    own = [F.element_at("_m", F.lit(i)) for i in range(len(targets))]
    return found.select(*keys, F.array(*[o["n"] for o in own]).alias("n"), F.array(*[o["ranked"] for o in own]).alias("ranked"))


def ranked(rows: DataFrame, keys: list[str], value: str, rank: Callable[[Column], Column]) -> DataFrame:
    """(keys, n, ranked): of each key's n values (doubles, not null or NaN) the one with rank(n), counted from 0."""
    return narrowed(rows, keys, [(value, rank)]).select(*keys, F.get("n", F.lit(0)).alias("n"), F.get("ranked", F.lit(0)).alias("ranked"))


def medians(rows: DataFrame, keys: list[str], values: dict[str, Column]) -> DataFrame:
    """(keys, names): exact medians of expressions of the rows by name, of an even number of values the mean of the middle two."""
    rows = rows.select(*keys, *[v.alias(n) for n, v in values.items()])
    both = (lambda n: F.floor((n - 1) / 2)), (lambda n: F.floor(n / 2))
    found = narrowed(rows, keys, [(name, rank) for name in values for rank in both])
    at = lambda i: F.get("ranked", F.lit(i))
    return found.select(*keys, *[((at(2 * i) + at(2 * i + 1)) / 2).alias(name) for i, name in enumerate(values)])


#: Ranks are off by at most n / ACCURACY in Spark's sketches.
ACCURACY = 10_000


def bracketed(rows: DataFrame, keys: list[str], values: dict[str, Column]) -> DataFrame:
    """(keys, names): as medians(), in fewer passes: a sketch bounds each median, and only values within the bounds are counted.

    The bounds hold at most some n / 2000 different values of a key, for the sketch's error is bounded; that the median
    lies in them is checked by counts, and were it not, medians() would find it.
    """
    ensure_checkpoint(rows.sparkSession)
    rows = rows.select(*keys, *[F.when(~F.isnan(v), v).alias(n) for n, v in ((n, v.cast("double")) for n, v in values.items())])
    shares = F.array(F.lit(0.5 - 2 / ACCURACY), F.lit(0.5 + 2 / ACCURACY))
    bounds = rows.groupBy(*keys).agg(*[F.percentile_approx(n, shares, ACCURACY).alias(f"_{n}") for n in values]).checkpoint()
    found, order = bounds.select(*keys), Window.partitionBy(*keys).orderBy("_side", "_x")
    for n in values:
        v, low, high = F.col(n), F.get(f"_{n}", F.lit(0)), F.get(f"_{n}", F.lit(1))
        side = F.when(v < low, -1).when(v > high, 1).otherwise(0)
        counts = rows.where(v.isNotNull()).join(bounds.select(*keys, f"_{n}"), keys).groupBy(*keys, side.alias("_side"), F.when(side == 0, v).alias("_x")).agg(F.count("*").alias("_c"))
        upto = counts.withColumn("_upto", F.sum("_c").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("_n", F.sum("_c").over(Window.partitionBy(*keys)))
        at = lambda rank: F.max(F.when((F.col("_upto") > rank) & (F.col("_upto") - F.col("_c") <= rank), F.col("_x")))
        mid = ((at(F.floor((F.col("_n") - 1) / 2)) + at(F.floor(F.col("_n") / 2))) / 2).alias(n)
        one = upto.groupBy(*keys).agg(mid).checkpoint()
        if one.where(F.col(n).isNull()).head(1):
            one = medians(rows, keys, {n: v})
        found = found.join(one, keys, "left")
    return found
