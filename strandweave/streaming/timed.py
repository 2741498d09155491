"""Streams that wait for event time: claims for their record, samples for their delay.

State holds what is in flight and nothing else: it goes once the watermark has passed.  Rows
that come behind the watermark are an error here, not something to be dropped (``run_strict``).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from strandweave.errors import CausalityError

#: Timers need this store of state.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def unmatched_claims(claims: DataFrame, records: DataFrame, lateness: str) -> DataFrame:
    """(key, ts, state, fault) of claims (key, ts, state) that no record (key, ts, state) of the same moment bears out.

    ``state``: there is a record, in another state; given at once.  ``absent``: there is none; given once the watermark, the
    earlier one of both streams, has passed the claim.  A null state agrees with a null one.  Claims without a key or moment are absent.
    """
    own = claims.select(F.col("key").alias("key"), F.col("ts").alias("ts"), F.col("state").alias("state")).withWatermark("ts", lateness)
    met = records.select(F.col("key").alias("_key"), F.col("ts").alias("_ts"), F.col("state").alias("_state")).withWatermark("_ts", lateness)
    joined = own.join(met, (F.col("key") == F.col("_key")) & (F.col("ts") == F.col("_ts")), "leftOuter")
    fault = F.when(F.col("_ts").isNull(), "absent").when(~F.col("state").eqNullSafe(F.col("_state")), "state")
    return joined.select("key", "ts", "state", fault.alias("fault")).where("fault is not null")


class _Delay(StatefulProcessor):
    """Samples wait under the millisecond in which they are due; a timer takes them out."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "due bigint", "source array<bigint>, value array<double>")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        for frame in rows:
            source = frame["ts"].astype("datetime64[us]").astype("int64")
            due = (source + frame["delay_us"].astype("int64") + 999) // 1000
            for at in sorted(due.unique().tolist()):
                own = due == at
                held = self.waiting.getValue((at,)) if self.waiting.containsKey((at,)) else None
                old = ([], []) if held is None else (list(held[0]), list(held[1]))
                self.waiting.updateValue((at,), (old[0] + source[own].tolist(), old[1] + frame["value"][own].astype(float).tolist()))
                self.handle.registerTimer(int(at))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        source, value = self.waiting.getValue((at,))
        self.waiting.removeKey((at,))
        rows = sorted(zip(source, value, strict=True))
        yield pd.DataFrame([(key[0], s, at * 1000, v) for s, v in rows], columns=["channel", "source_us", "due_us", "value"])

    def close(self) -> None:
        pass


def delayed_bus(samples: DataFrame, delays: dict[int, int], lateness: str) -> DataFrame:
    """(channel, source_us, due_us, value): each sample (channel, ts, value) of a stream once the watermark has passed its
    moment and the channel's delay (microseconds), in whole milliseconds, rounded up.

    Channels without a delay are not delivered; a negative delay is refused.  A sample leaves the state when it is due.  The session's
    state store must be ``ROCKSDB``, as timers need it.
    """
    if any(d < 0 for d in delays.values()):
        raise CausalityError("negative delay")
    known = F.create_map(*[F.lit(x) for pair in delays.items() for x in pair]) if delays else F.lit(None).cast("map<bigint,bigint>")
    own = samples.withWatermark("ts", lateness).select(F.col("channel").cast("bigint").alias("channel"), "ts", F.col("value").cast("double").alias("value"))
    own = own.withColumn("delay_us", F.element_at(known, F.col("channel").cast("int")).cast("bigint")).where("delay_us is not null and ts is not null and value is not null")
    return own.groupBy("channel").transformWithStateInPandas(_Delay(), "channel bigint, source_us bigint, due_us bigint, value double", "append", "eventTime")


def run_strict(stream: DataFrame, spark: SparkSession, folder: str) -> tuple[DataFrame, list[int]]:
    """Runs a stream over all that is available into Parquet below ``folder``; what it wrote, and the rows of state after each batch.

    Rows that came behind the watermark raise ``CausalityError``: they are neither kept nor silently dropped.
    """
    writer = stream.writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
    query = writer.option("checkpointLocation", f"{folder}/state").start(f"{folder}/out")
    query.awaitTermination()
    states, late = [], 0
    for progress in query.recentProgress:
        for operator in progress["stateOperators"]:
            late += operator["numRowsDroppedByWatermark"]
        states.append(sum(operator["numRowsTotal"] for operator in progress["stateOperators"]))
    if late:
        raise CausalityError(f"{late} rows came behind the watermark")
    return spark.read.schema(stream.schema).parquet(f"{folder}/out"), states
