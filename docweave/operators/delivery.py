"""Delivery of events and tasks: signed webhooks, event-stream frames, dispatch, settlement, heartbeats, modes.

Transport is left to the caller; each operator gives the rows that would be sent, or what becomes of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ordered import running

SEND_TIMEOUT_MS = 5000
#: Offset basis and prime of the 32-bit FNV-1a hash.
FNV_BASIS, FNV_PRIME = 2166136261, 16777619


# ------------------------------------------------------------------ webhooks


def hmac_sha256(key: str, message: Column) -> Column:
    """HMAC-SHA256 as hex, of built-in functions only."""
    import hashlib

    raw = key.encode()
    raw = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(b ^ x for b in raw)) for x in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


def webhook_requests(tasks: DataFrame, payload: Column, now_s: Column, secrets: dict[str, str], header: str = "X-Signature") -> DataFrame:
    """tasks (url, secret_ref, ...) as requests: method, body, headers, fault.

    The signature is t=<seconds>,v1=<hex HMAC-SHA256 of "<seconds>.<body>">; a task
    without a secret has none, and one whose secret is not known is a fault."""
    body = payload.cast("string")
    message = F.concat(now_s.cast("string"), F.lit("."), body)
    signature = None
    for ref, secret in secrets.items():
        value = F.concat(F.lit("t="), now_s.cast("string"), F.lit(",v1="), hmac_sha256(secret, message))
        test = F.col("secret_ref") == ref
        signature = F.when(test, value) if signature is None else signature.when(test, value)
    signature = F.lit(None).cast("string") if signature is None else signature
    unsigned = F.coalesce(F.col("secret_ref"), F.lit("")) == ""
    headers = F.map_filter(F.create_map(F.lit("Content-Type"), F.lit("application/json"), F.lit(header), F.when(~unsigned, signature)), lambda _, v: v.isNotNull())
    fault = F.when(~unsigned & signature.isNull(), "unknown_secret")
    return tasks.withColumns({"method": F.lit("POST"), "body": body, "headers": headers, "fault": fault})


def settled(attempts: DataFrame) -> DataFrame:
    """What becomes of each delivered message (code, attempt, max_attempts, initial_ms, max_ms): verdict and redeliver_in_ms.

    ack for success, term for client errors and after the last attempt (dead), nak with
    a delay, doubled each time and capped, for the rest; a null code is a lost connection."""
    last = F.col("attempt") >= F.col("max_attempts")
    verdict = F.when(F.col("code").between(200, 299), "ack").when(F.col("code").between(400, 499), "term").when(last, "dead").otherwise("nak")
    delay = F.least(F.col("initial_ms") * F.pow(F.lit(2.0), F.col("attempt") - 1), F.col("max_ms").cast("double")).cast("long")
    return attempts.withColumn("verdict", verdict).withColumn("redeliver_in_ms", F.when(F.col("verdict") == "nak", delay))


def redelivered(attempts: DataFrame) -> DataFrame:
    """The messages that are delivered again, with their next attempt."""
    found = settled(attempts).where("verdict = 'nak'")
    return found.withColumns({"attempt": F.col("attempt") + 1, "due_ms": F.col("ts_ms") + F.col("redeliver_in_ms")}).drop("verdict", "redeliver_in_ms")


def drained(messages: DataFrame, closing_ms: int, grace_ms: int) -> DataFrame:
    """Messages (started_ms, took_ms) at a shutdown: done before or within the grace time, cut off behind it, or, not yet started, given back."""
    end = F.col("started_ms") + F.col("took_ms")
    state = F.when(F.col("started_ms") >= closing_ms, "returned").when(end <= closing_ms, "done").when(end <= closing_ms + grace_ms, "drained").otherwise("cut_off")
    return messages.withColumn("state", state)


# ------------------------------------------------------------------ dispatch


def fnv32a(text: Column) -> Column:
    """The 32-bit FNV-1a hash of a text's UTF-8 bytes."""
    digits = F.hex(text.cast("binary"))
    places = F.when(F.length(digits) > 0, F.sequence(F.lit(1), F.length(digits), F.lit(2))).otherwise(F.array().cast("array<int>"))
    byte = lambda p: F.conv(F.substring(digits, p, F.lit(2)), 16, 10).cast("long")
    return F.aggregate(places, F.lit(FNV_BASIS).cast("long"), lambda h, p: (h.bitwiseXOR(byte(p)) * F.lit(FNV_PRIME).cast("long")).bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))


def worker_of(collection: Column, doc_id: Column, workers: int) -> Column:
    """The worker of a document's tasks: one document, one worker, so that its tasks keep their order."""
    return F.pmod(fnv32a(F.concat(collection, doc_id)), F.lit(workers)).cast("int")


def dispatched(tasks: DataFrame, workers: int = 16) -> DataFrame:
    """tasks with their worker; a worker's tasks meet in one partition, in order of time."""
    return tasks.withColumn("worker", worker_of(F.col("collection"), F.col("doc_id"), workers)).repartition(workers, "worker").sortWithinPartitions("worker", "ts_ms")


# ------------------------------------------------------------- subscribers


def frames(events: DataFrame, data: Column, kind: Column, event_id: Column) -> DataFrame:
    """Events as frames of a text/event-stream."""
    return events.withColumn("frame", F.concat(F.lit("id: "), event_id.cast("string"), F.lit("\nevent: "), kind, F.lit("\ndata: "), F.regexp_replace(data.cast("string"), "\n", "\ndata: "), F.lit("\n\n")))


def timely(deliveries: DataFrame, limit_ms: int = SEND_TIMEOUT_MS) -> DataFrame:
    """Deliveries (gateway, ts_ms, took_ms) that arrive: a gateway's first one that takes longer than the limit drops the gateway, with it and all that follow."""
    slow = deliveries.where(F.col("took_ms") > limit_ms).groupBy("gateway").agg(F.min("ts_ms").alias("dropped_ms"))
    found = deliveries.join(slow, "gateway", "left")
    return found.where(F.col("dropped_ms").isNull() | (F.col("ts_ms") < F.col("dropped_ms"))).drop("dropped_ms")


def heartbeats(log: DataFrame, every_ms: int) -> DataFrame:
    """Progress without a change: backend, at_ms and the place (t, i) of the last event, for every `every_ms` of silence behind it."""
    found = running(log.select("backend", "t", "i", "ts_ms"), ["backend"], [F.col("t"), F.col("i")], "next_ms", F.col("ts_ms"), "last", before=True, reverse=True)
    found = found.where(F.col("next_ms") - F.col("ts_ms") > every_ms)
    beats = F.sequence(F.col("ts_ms") + every_ms, F.col("next_ms") - 1, F.lit(every_ms).cast("long"))
    return found.select("backend", "t", "i", F.explode(beats).alias("at_ms"))


def modes(log: DataFrame, capacity: int, per_ms: int = 1000) -> DataFrame:
    """Events with how a subscriber gets them: live, or, where one of its backend's spans of per_ms holds more
    than it can queue (capacity), by catching up from the buffer."""
    span = F.floor(F.col("ts_ms") / per_ms).cast("long")
    pending = log.groupBy("backend", span.alias("span")).agg(F.count("*").alias("pending"))
    found = log.withColumn("span", span).join(pending, ["backend", "span"])
    return found.withColumn("mode", F.when(F.col("pending") > capacity, "catch_up").otherwise("live")).drop("span", "pending")


def reconnect_ms(failures: Column, initial_ms: int = 1000, max_ms: int = 30_000, factor: float = 2.0) -> Column:
    """Milliseconds before the connection attempt behind so many failures (from 1); a success starts anew."""
    return F.least(F.lit(float(initial_ms)) * F.pow(F.lit(factor), failures - 1), F.lit(float(max_ms))).cast("long")


def starting(log: DataFrame, marker: dict[str, tuple[int, int]] | None, choice: str, now_ms: int) -> DataFrame:
    """Where a reader begins: behind its marker; without one from_beginning, or from_now."""
    from .cdc import replay

    if marker:
        return replay(log, marker)
    if choice not in ("from_beginning", "from_now"):
        raise ValueError(f"bad start {choice!r}")
    return log if choice == "from_beginning" else log.where(F.col("ts_ms") >= now_ms)
