"""The change log as a stream: the batch operators per micro-batch, state where events span batches.

Sinks are idempotent by batch: each micro-batch writes a folder named by its number, so
that a batch that is run again after a lost driver replaces what it had written.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import cdc, rules
from ..operators.rules import Subscription, Trigger
from ..operators.writes import latest

LOG = "backend string, t long, i long, op string, database string, collection string, doc_id string, value double, ts_ms long"


def source(spark: SparkSession, path: str, schema: str = LOG, files_per_batch: int | None = None, databases: list[str] | None = None, collections: list[str] | None = None) -> DataFrame:
    """The log's Parquet folder as a stream; scopes are pushed into the scan, files_per_batch is the backpressure."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    log = reader.parquet(path)
    if databases:
        log = log.where(F.col("database").isin(databases))
    return log.where(F.col("collection").isin(collections)) if collections else log


def each_batch(log: DataFrame, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str):
    """Runs `work` on each micro-batch and writes its rows under out/batch=N."""

    def write(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return log.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def buffered(log: DataFrame, out: str, checkpoint: str):
    """The durable event buffer: normalised events with their keys; rejected ones are left out."""
    return each_batch(log, lambda b: cdc.normalize(b)[0], out, checkpoint)


def coalesced(log: DataFrame, out: str, checkpoint: str):
    """One event per document and micro-batch."""
    return each_batch(log, cdc.coalesce, out, checkpoint)


def triggered(log: DataFrame, triggers: list[Trigger], out: str, checkpoint: str):
    """Delivery tasks of each micro-batch."""

    def work(batch: DataFrame) -> DataFrame:
        events = cdc.typed(cdc.coalesce(batch), F.lit(False)).withColumns({"version": F.col("i"), "data": F.struct("value", "op")})
        return rules.fire(events.select("database", "collection", "doc_id", "type", "ts_ms", "version", "data"), triggers)

    return each_batch(log, work, out, checkpoint)


def subscribed(log: DataFrame, subscriptions: list[Subscription], out: str, checkpoint: str):
    """Deliveries to gateways of each micro-batch."""

    def work(batch: DataFrame) -> DataFrame:
        events = cdc.typed(batch, F.lit(False)).withColumn("data", F.struct("value", "op"))
        return rules.deliver(rules.match(events, subscriptions))

    return each_batch(log, work, out, checkpoint)


def deduplicated(log: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each event once; an event later than the watermark is dropped, which bounds the state."""
    timed = log.withColumn("at", F.timestamp_millis("ts_ms")).withWatermark("at", late)
    return timed.dropDuplicatesWithinWatermark(["backend", "t", "i", "collection", "doc_id"])


GAP = T.StructType([T.StructField("backend", T.StringType()), T.StructField("after_ms", T.LongType()), T.StructField("at_ms", T.LongType()), T.StructField("gap_ms", T.LongType())])


def gaps(log: DataFrame, threshold_ms: int = cdc.GAP_MS) -> DataFrame:
    """Silences of threshold_ms or more between consecutive events of a backend; state is the last time seen."""

    def find(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        times = sorted(t for f in frames for t in f["ts_ms"].tolist())
        out = []
        for t in times:
            if last is not None and t - last >= threshold_ms:
                out.append((key[0], last, t, t - last))
            last = t if last is None else max(last, t)
        state.update((last,))
        yield pd.DataFrame(out, columns=GAP.names)

    return log.groupBy("backend").applyInPandasWithState(find, GAP, "last long", "append", GroupStateTimeout.NoTimeout)


ALLOWED = T.StructType([T.StructField("key", T.StringType()), T.StructField("ts_ms", T.LongType()), T.StructField("allowed", T.BooleanType())])


def rate_limited(requests: DataFrame, capacity: float, per_ms: float) -> DataFrame:
    """Requests (key, ts_ms) against a token bucket for each key; state is its tokens and time."""

    def allow(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tokens, at = state.get if state.exists else (capacity, None)
        out = []
        for t in sorted(t for f in frames for t in f["ts_ms"].tolist()):
            tokens = min(capacity, tokens + (0 if at is None else max(0, t - at) * per_ms))
            at, ok = t, tokens >= 1
            tokens -= ok
            out.append((key[0], t, ok))
        state.update((tokens, at))
        yield pd.DataFrame(out, columns=ALLOWED.names)

    return requests.groupBy("key").applyInPandasWithState(allow, ALLOWED, "tokens double, at long", "append", GroupStateTimeout.NoTimeout)


def maintained(log: DataFrame, base: str, checkpoint: str):
    """An index kept up to date: each micro-batch merges its events into a new generation of the table at
    base, the latest of every document by (t, i) whatever order they come in.  Deletes stay as tombstones
    (op) so that an older event that comes later cannot revive them.  The generation is named by the batch,
    so a batch that is repeated writes the same one."""
    spark = log.sparkSession
    columns = ["doc_id", "op", "value", "t", "i"]

    def write(batch: DataFrame, number: int) -> None:
        every = batch.select(*columns)
        if number:
            every = every.unionByName(spark.read.parquet(f"{base}/generation={number - 1}").select(*columns))
        latest(every, ["doc_id"], [F.col("t"), F.col("i")]).write.mode("overwrite").parquet(f"{base}/generation={number}")

    return log.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
