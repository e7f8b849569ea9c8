"""The change log: normalise, merge, coalesce, replay, typed events, gaps, retention."""

from __future__ import annotations

import base64
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import buffer_key, event_id
from ..plans.ordered import numbered, running

OPS = ("insert", "update", "replace", "delete")
GAP_MS = 5 * 60 * 1000
RETENTION_MS = 3600 * 1000


def normalize(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, rejected): unknown operations, and updates or replacements without a document, are rejected."""
    body = F.col("value").isNotNull() if "full_doc" not in raw.columns else F.col("full_doc").isNotNull()
    ok = F.col("op").isin(*OPS) & (~F.col("op").isin("update", "replace") | body)
    good = raw.where(ok).withColumn("event_id", event_id(F.col("t"), F.col("i"), F.col("collection"), F.col("doc_id")))
    return good.withColumn("key", buffer_key(F.col("t"), F.col("i"), F.col("event_id"))), raw.where(~F.coalesce(ok, F.lit(False)))


def merged(*logs: DataFrame) -> DataFrame:
    """Logs of several backends in one order: cluster time, then backend."""
    out = logs[0]
    for log in logs[1:]:
        out = out.unionByName(log)
    return out.orderBy("t", "i", "backend")


def concatenated(disk: DataFrame, tail: DataFrame, after: str = "") -> DataFrame:
    """Events behind a key from disk and memory, each key once."""
    return disk.unionByName(tail).where(F.col("key") > after).dropDuplicates(["key"])


def head(log: DataFrame, after: str = "") -> DataFrame:
    """First and last key, the number of events, and of those behind a key."""
    return log.agg(F.min("key").alias("first"), F.max("key").alias("head"), F.count("*").alias("events"), F.count(F.when(F.col("key") > after, 1)).alias("behind"))


def coalesce(log: DataFrame, *extra_keys: str) -> DataFrame:
    """One event for each document (and extra key): what its events, in the order of (t, i), amount to.

    An insert followed by changes stays an insert with the last body; an insert
    followed by a delete is nothing; otherwise the later event stands.  So the last
    event and the last insert or delete before it tell: no document's events are held."""
    keys = ["database", "collection", "doc_id", *extra_keys]
    columns = [c for c in log.columns if c not in keys]
    w = Window.partitionBy(*keys).orderBy("t", "i")
    bound = F.last(F.when(F.col("op").isin("insert", "delete"), F.col("op")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    found = log.select("*", F.lead("t").over(w).isNull().alias("_last"), F.coalesce(bound == "insert", F.lit(False)).alias("_inserted")).where("_last")
    found = found.where(~(F.col("_inserted") & (F.col("op") == "delete")))
    op = F.when(F.col("_inserted") & F.col("op").isin("update", "replace"), "insert").otherwise(F.col("op"))
    return found.withColumn("op", op).select(*keys, "t", "i", *[c for c in columns if c not in ("t", "i")])


def coalesce_batches(log: DataFrame, size: int = 100) -> DataFrame:
    """As coalesce, within batches of `size` events of each backend's order."""
    placed = numbered(log, ["backend"], [F.col("t"), F.col("i")], "batch")
    placed = placed.withColumns({"batch": F.floor((F.col("batch") - 1) / size).cast("long"), "source": F.col("backend")})
    return coalesce(placed, "batch", "source").drop("source")


def replay(log: DataFrame, marker: dict[str, tuple[int, int]], coalesced: bool = False) -> DataFrame:
    """Events behind each backend's place in the marker; backends without one, from the start."""
    known = {b: p for b, p in marker.items()}
    out = F.lit(True)
    for backend, (t, i) in known.items():
        behind = (F.col("t") > t) | ((F.col("t") == t) & (F.col("i") > i))
        out = F.when(F.col("backend") == backend, behind).otherwise(out)
    found = log.where(out)
    return coalesce(found) if coalesced else found


def progress(log: DataFrame) -> DataFrame:
    """The last event of each backend."""
    return log.groupBy("backend").agg(F.max(F.struct("t", "i")).alias("p")).select("backend", "p.t", "p.i")


def encode_marker(marker: dict[str, str]) -> str:
    return base64.urlsafe_b64encode(json.dumps({"p": marker}, sort_keys=True).encode()).decode()


def decode_marker(text: str) -> dict[str, str]:
    return json.loads(base64.urlsafe_b64decode(text))["p"] if text else {}


def typed(log: DataFrame, soft_deleted: Column, was_deleted: Column | None = None) -> DataFrame:
    """create, update and delete events: a hard delete is no event, an update that soft-deletes is a delete, a replacement creates.

    So does an update that revives a tombstone: was_deleted is true where the document
    was soft-deleted before, or the update sets deleted to false."""
    create = F.col("op").isin("insert", "replace")
    if was_deleted is not None:
        create = create | F.coalesce(was_deleted, F.lit(False))
    kind = F.when(F.col("op") == "delete", None).when(soft_deleted, "delete").when(create, "create").otherwise("update")
    return log.withColumn("type", kind).where("type is not null")


def gaps(log: DataFrame, threshold_ms: int = GAP_MS) -> DataFrame:
    """Events that come threshold_ms or more after the one before, by backend."""
    found = running(log, ["backend"], [F.col("t"), F.col("i")], "_before", F.col("ts_ms"), "last", before=True)
    return found.withColumn("gap_ms", F.col("ts_ms") - F.col("_before")).where(F.col("gap_ms") >= threshold_ms).drop("_before")


def unseen(log: DataFrame) -> DataFrame:
    """Events newer than every event that arrived before them, by backend."""
    found = running(log, ["backend"], [F.col("arrival")], "_seen", F.struct("t", "i"), "max", before=True)
    return found.where(F.col("_seen").isNull() | (F.struct("t", "i") > F.col("_seen"))).drop("_seen")


def retained(log: DataFrame, now_ms: int, keep_ms: int = RETENTION_MS) -> DataFrame:
    return log.where(F.col("ts_ms") >= now_ms - keep_ms)


def retained_size(log: DataFrame, size: Column, most: int) -> DataFrame:
    """The newest events of each backend whose sizes stay within `most` together."""
    return running(log, ["backend"], [F.col("t"), F.col("i")], "kept_size", size, reverse=True).where(F.col("kept_size") <= most)


def health(statuses: DataFrame) -> DataFrame:
    """The worst status of all backends: 0 healthy, 1 degraded, 2 unhealthy."""
    rank = F.when(F.col("status") == "unhealthy", 2).when(F.col("status") == "degraded", 1).otherwise(0)
    worst = F.max(rank)
    return statuses.agg(F.when(worst == 2, "unhealthy").when(worst == 1, "degraded").otherwise("healthy").alias("status"), F.count("*").alias("backends"))


def pressure(latency_ms: Column) -> Column:
    return F.when(latency_ms < 100, "none").when(latency_ms < 500, "slow_down").otherwise("pause")


def error_action(message: Column, failures: Column, most: int = 5) -> Column:
    """What to do about an error of the change stream."""
    low = F.lower(message)
    lost = F.contains(low, F.lit("resume token")) | F.contains(low, F.lit("history lost"))
    passing = low.rlike("timeout|temporar|connection|network|unavailable")
    return F.when(lost, "restart").when(failures >= most, "fatal").when(passing, "retry").otherwise("reconnect")


class CircuitBreaker:
    """Closed until `limit` failures in a row; half open after `cool_ms`; closed again by a success."""

    def __init__(self, limit: int = 5, cool_ms: int = 30_000):
        self.limit, self.cool_ms, self.failures, self.opened = limit, cool_ms, 0, None

    def state(self, now_ms: int) -> str:
        if self.opened is None:
            return "closed"
        return "half_open" if now_ms - self.opened >= self.cool_ms else "open"

    def allow(self, now_ms: int) -> bool:
        return self.state(now_ms) != "open"

    def record(self, ok: bool, now_ms: int) -> None:
        if ok:
            self.failures, self.opened = 0, None
        else:
            self.failures += 1
            if self.failures >= self.limit or self.opened is not None:
                self.opened = now_ms
