"""Latest-value slots over a stream: each key has a slot a stream, and every change of one fires once all are filled.

The same as operators/streams.slot_snapshots, which is the batch form. State is a row a key and slot: the last value, when
it came and its version; it stays in the state store, so that a restarted query goes on where it was.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor


class Slots(StatefulProcessor):
    """Rows (ts_us, seq, stream, value) of a key, in order within a batch; one older than what its slot holds is late and changes nothing."""

    def __init__(self, slots: list[str], ttl_seconds: float | None) -> None:
        self.slots, self.ttl = slots, None if ttl_seconds is None else int(ttl_seconds * 1_000_000)

    def init(self, handle) -> None:
        self.state = handle.getMapState("slots", "stream string", "us long, seq long, value double, version long")

    def handleInputRows(self, key, batches: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = {k[0]: list(v) for k, v in self.state.iterator()}
        out, changed = [], set()
        for r in pd.concat(list(batches)).sort_values(["ts_us", "seq"], kind="stable").itertuples():
            if r.stream not in self.slots or pd.isna(r.value):
                continue
            old = held.get(r.stream)
            if old is not None and (r.ts_us, r.seq) <= (old[0], old[1]):
                continue
            held[r.stream] = [int(r.ts_us), int(r.seq), float(r.value), (old[3] if old else 0) + 1]
            changed.add(r.stream)
            if all(s in held and (self.ttl is None or r.ts_us - held[s][0] <= self.ttl) for s in self.slots):
                out.append((key[0], int(r.ts_us), int(r.seq), *[x for s in self.slots for x in (held[s][2], held[s][3])]))
        for s in changed:
            self.state.updateValue((s,), tuple(held[s]))
        yield pd.DataFrame(out, columns=["key", "ts_us", "seq", *[f"{n}_{s}" for s in self.slots for n in ("last", "version")]])

    def close(self) -> None:
        pass


def slot_stream(events: DataFrame, slots: list[str], by: str, ts: str, seq: str, ttl_seconds: float | None = None, stream: str = "stream", value: str = "value") -> DataFrame:
    """(by, ts_us, seq, last_s, version_s for each slot s) of a stream of events; needs the RocksDB state store."""
    own = events.select(F.col(by).alias("key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("ts_us"), F.col(seq).cast("long").alias("seq"), F.col(stream).alias("stream"), F.col(value).cast("double").alias("value"))
    schema = f"key {dict(own.dtypes)['key']}, ts_us long, seq long, " + ", ".join(f"`last_{s}` double, `version_{s}` long" for s in slots)
    return own.groupBy("key").transformWithStateInPandas(statefulProcessor=Slots(slots, ttl_seconds), outputStructType=schema, outputMode="append", timeMode="None").withColumnRenamed("key", by)
