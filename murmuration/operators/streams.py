"""Ordered and asynchronous streams: latest values, pairs of frames, rolling measures, moving averages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_slots(events: DataFrame, streams: list[str], by: str, order: list[str], stream: str = "stream", value: str = "value") -> DataFrame:
    """At every event, the latest value of every stream for the same key; rows where all streams have one are `ready`.

    One window by key: no self join.
    """
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = events.withColumns({f"last_{s}": F.last(F.when(F.col(stream) == s, F.col(value)), ignorenulls=True).over(w) for s in streams})
    ready = F.lit(True)
    for s in streams:
        ready = ready & F.col(f"last_{s}").isNotNull()
    return out.withColumn("ready", ready)


def slot_snapshots(events: DataFrame, slots: list[str], by: str, ts: str, seq: str, ttl_seconds: float | None = None, stream: str = "stream", value: str = "value") -> DataFrame:
    """(by, ts_us, seq, last_s, version_s for each slot s): at every event that fills a slot, all slots, once none is empty.

    A version counts the values that a slot has had; null values fill nothing. With a TTL a value older than that, by event
    time, counts as none. One window by key; streaming/slots.py is the same over a stream.
    """
    own = events.select(by, F.unix_micros(F.col(ts).cast("timestamp")).alias("ts_us"), F.col(seq).cast("long").alias("seq"), F.col(stream).alias("_stream"), F.col(value).cast("double").alias("_value"))
    own = own.where(F.col("_stream").isin(slots) & F.col("_value").isNotNull() & ~F.isnan("_value"))
    w = Window.partitionBy(by).orderBy("ts_us", "seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    of = lambda s, c: F.when(F.col("_stream") == s, c)
    out = own.withColumns({f"_at_{s}": F.last(of(s, F.col("ts_us")), ignorenulls=True).over(w) for s in slots} | {f"last_{s}": F.last(of(s, F.col("_value")), ignorenulls=True).over(w) for s in slots} | {f"version_{s}": F.count(of(s, F.lit(1))).over(w) for s in slots})
    for s in slots:
        out = out.where(F.col(f"_at_{s}").isNotNull() if ttl_seconds is None else F.col("ts_us") - F.col(f"_at_{s}") <= int(ttl_seconds * 1_000_000))
    return out.select(by, "ts_us", "seq", *[f"{n}_{s}" for s in slots for n in ("last", "version")])


def frame_pairs(frames: DataFrame, key: str, frame: str, values: list[str]) -> DataFrame:
    """Each frame with the one before it; the first of a key gives nothing."""
    w = Window.partitionBy(key).orderBy(frame)
    return frames.withColumns({f"prev_{c}": F.lag(c).over(w) for c in [frame, *values]}).where(F.col(f"prev_{frame}").isNotNull())


def rolling_rate(events: DataFrame, key: str, order: list[str], seconds: Column, window: int = 30) -> DataFrame:
    """Events a second over the last `window` events: (n - 1) / (last - first); 0 where no time has passed."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(-(window - 1), Window.currentRow)
    t = events.withColumn("_t", seconds)
    t = t.withColumn("_span", F.max("_t").over(w) - F.min("_t").over(w)).withColumn("_n", F.count("*").over(w))
    return t.withColumn("rate", F.when(F.col("_span") > 0, (F.col("_n") - 1) / F.col("_span")).otherwise(0.0)).drop("_t", "_span", "_n")


def staleness(lag: Column) -> Column:
    return F.when(lag <= 1, "green").when(lag <= 4, "yellow").otherwise("red")


def moving_average(rows: DataFrame, key: str, order: list[str], value: str, alpha: float) -> DataFrame:
    """(key, n, ema): exponential moving average of each key's values in order: alpha x + (1 - alpha) before."""
    ordered = F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("_v"))))
    folded = F.aggregate(F.slice("o", 2, F.size("o")), F.get("o", F.lit(0))["_v"], lambda a, x: alpha * x["_v"] + (1 - alpha) * a)
    return rows.where(F.col(value).isNotNull()).groupBy(key).agg(F.count("*").alias("n"), ordered.alias("o")).select(key, "n", folded.alias("ema"))


def smooth(rows: DataFrame, key: str, order: str, value: str, sigma: float) -> DataFrame:
    """Gaussian smoothing over order within a key, weights cut at 3 sigma and renormalised at the ends."""
    r = int(3 * sigma + 0.5)
    w = Window.partitionBy(key).orderBy(order)
    terms = [(F.lag(value, i) if i > 0 else F.lead(value, -i)).over(w) if i else F.col(value) for i in range(-r, r + 1)]
    weights = [pow(2.718281828459045, -0.5 * (i / sigma) ** 2) for i in range(-r, r + 1)]
    total = sum((F.when(t.isNotNull(), F.lit(g)).otherwise(0.0) for t, g in zip(terms, weights, strict=True)), F.lit(0.0))
    return rows.withColumn("smooth", sum((F.coalesce(t * g, F.lit(0.0)) for t, g in zip(terms, weights, strict=True)), F.lit(0.0)) / total)


def replayed(spark, frames: DataFrame, order: str, loops: int, stride: int) -> DataFrame:
    """A finite clip, `loops` times, every stride-th frame, the first of each repeat marked."""
    n = frames.agg(F.max(order) + 1).first()[0] or 0
    out = frames.crossJoin(F.broadcast(spark.range(loops).select(F.col("id").alias("loop"))))
    emit = F.col("loop") * n + F.col(order)
    return out.withColumn("emit_idx", emit).withColumn("is_seam", (F.col(order) == 0) & (F.col("loop") > 0)).where(emit % stride == 0)


def padded(frames: DataFrame, key: str, frame: str, to: int) -> DataFrame:
    """Frames of each key up to number to - 1, the last one repeated; is_pad marks the copies."""
    last = frames.groupBy(key).agg(F.max(frame).alias("_last"))
    tail = frames.join(last, key).where(F.col(frame) == F.col("_last")).withColumn("_to", F.explode(F.when(F.col("_last") + 1 < to, F.sequence(F.col("_last") + 1, F.lit(to - 1).cast("long"))).otherwise(F.array())))
    tail = tail.withColumn(frame, F.col("_to").cast(dict(frames.dtypes)[frame])).withColumn("is_pad", F.lit(True))
    return frames.withColumn("is_pad", F.lit(False)).unionByName(tail.select(*frames.columns, "is_pad"))


def sidebar(events: DataFrame, stream: str, seconds: str) -> DataFrame:
    """(stream, n, fps, lag, drift, staleness) of each stream: events a second, seconds behind the newest stream, per cent that its rate falls short of the fastest, and the colour of its lag in frames of its own."""
    per = events.groupBy(stream).agg(F.count("*").alias("n"), F.min(seconds).alias("_t0"), F.max(seconds).alias("_t1"))
    per = per.withColumn("fps", F.when(F.col("_t1") > F.col("_t0"), (F.col("n") - 1) / (F.col("_t1") - F.col("_t0"))).otherwise(0.0))
    top = per.agg(F.max("_t1").alias("_now"), F.max("fps").alias("_best"))  # one row
    per = per.crossJoin(F.broadcast(top)).withColumn("lag", F.col("_now") - F.col("_t1"))
    drift = F.when(F.col("_best") > 0, 100 * (1 - F.col("fps") / F.col("_best"))).otherwise(0.0)
    return per.select(stream, "n", "fps", "lag", drift.alias("drift"), staleness(F.col("lag") * F.col("fps")).alias("staleness"))
