"""Operational analytics: latency summaries, log folding, rate limits, intervals; and the metadata of users and databases."""

from __future__ import annotations

import threading
import time

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# ------------------------------------------------------------------ metrics


def ranked_percentiles(results: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """value at place floor(n * share) (from 0) of each group's ascending values: exact, without interpolation.

    Values are counted first, so that a group's window holds distinct values only."""
    counted = results.groupBy(*by, value).agg(F.count("*").alias("_c"))
    up = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0) if by else Window.partitionBy(F.lit(0)).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    placed = counted.withColumns({"_upto": F.sum("_c").over(up), "_n": F.sum("_c").over(whole)})
    picks = [F.min(F.when(F.col("_upto") > F.least(F.floor(F.col("_n") * q), F.col("_n") - 1), F.col(value))).alias(name) for name, q in shares.items()]
    return placed.groupBy(*by).agg(*picks)


PERCENTILES = {"median": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}


def latency_summary(results: DataFrame, by: list[str], seconds: float) -> DataFrame:
    """Counts, success share, throughput and latencies of operation results, of each group."""
    base = results.groupBy(*by).agg(
        F.count("*").alias("operations"),
        F.sum((~F.col("success")).cast("long")).alias("errors"),
        F.round(100 * F.avg(F.col("success").cast("double")), 6).alias("success_percent"),
        F.round(F.count("*") / F.lit(seconds), 6).alias("throughput"),
        F.min("latency_ms").alias("min"),
        F.max("latency_ms").alias("max"),
        F.round(F.avg("latency_ms"), 6).alias("mean"),
    )
    ranks = ranked_percentiles(results, by, "latency_ms", PERCENTILES)
    return base.join(ranks, by) if by else base.crossJoin(ranks)  # one row each


def error_histogram(results: DataFrame) -> DataFrame:
    return results.where("error is not null").groupBy("error").agg(F.count("*").alias("n"))


def label_counts(rows: DataFrame, labels: list[str], value: str, buckets: list[float]) -> DataFrame:
    """Count, sum and cumulative bucket counts by label."""
    return rows.groupBy(*labels).agg(F.count("*").alias("count"), F.round(F.sum(value), 4).alias("sum"), *[F.sum((F.col(value) <= b).cast("long")).alias(f"le_{b:g}".replace(".", "_")) for b in buckets])


def bucket_counts(rows: DataFrame, value: str) -> DataFrame:
    """How many values are 100, 95 to 100, 85 to 95, and less."""
    v = F.col(value)
    return rows.agg(*[F.sum(c.cast("long")).alias(n) for n, c in {"full": v >= 100, "high": (v >= 95) & (v < 100), "medium": (v >= 85) & (v < 95), "low": v < 85}.items()])


def operation_mix(weights: DataFrame) -> DataFrame:
    """Cumulative bounds of weighted operations in [0, 1)."""
    w = Window.orderBy("op").rowsBetween(Window.unboundedPreceding, 0)  # a row for each kind of operation
    total = Window.partitionBy(F.lit(0))
    return weights.select("op", F.round((F.sum("weight").over(w) - F.col("weight")) / F.sum("weight").over(total), 6).alias("low"), F.round(F.sum("weight").over(w) / F.sum("weight").over(total), 6).alias("high"))


def choose(mix: list[tuple[str, float]], u: Column) -> Column:
    """The operation at u in [0, 1) of weighted ones."""
    total, at, out = sum(w for _, w in mix), 0.0, None
    for op, w in mix:
        at += w / total
        out = F.when(u < at, op) if out is None else out.when(u < at, op)
    return out.otherwise(mix[-1][0])


def chosen(operations: DataFrame, mix: list[tuple[str, float]], u: Column, known: Column) -> DataFrame:
    """operations with the one drawn at u; where no document is known yet, any but a create becomes a create."""
    return operations.withColumn("op", F.when(known, choose(mix, u)).otherwise("create"))


class Run:
    """A benchmark run: set up, workers that repeat an operation until the time is up, tear down, a summary."""

    def __init__(self, operation, workers: int = 1, seconds: float = 1.0, set_up=None, tear_down=None, clock=time.monotonic):
        self.operation, self.workers, self.seconds, self.set_up, self.tear_down, self.clock = operation, workers, seconds, set_up, tear_down, clock
        self.results: list[tuple[int, float, bool, str | None]] = []

    def _work(self, worker: int, end: float) -> None:
        while (begin := self.clock()) < end:
            try:
                self.operation(worker)
                fault = None
            except Exception as e:  # an operation's failure is a result
                fault = type(e).__name__
            self.results.append((worker, 1000.0 * (self.clock() - begin), fault is None, fault))

    def run(self) -> dict:
        if self.set_up:
            self.set_up()
        begin = self.clock()
        try:
            threads = [threading.Thread(target=self._work, args=(w, begin + self.seconds)) for w in range(self.workers)]
            for t in threads:
                t.start()
            for t in threads:
                t.join()
        finally:
            if self.tear_down:
                self.tear_down()
        errors = sum(not r[2] for r in self.results)
        return {"operations": len(self.results), "errors": errors, "seconds": self.clock() - begin}

    def frame(self, spark) -> DataFrame:
        return spark.createDataFrame(self.results, "worker int, latency_ms double, success boolean, error string")


def generated_documents(spark, n: int, fields: int = 10, size: int = 100, seed: int = 1) -> DataFrame:
    """n benchmark documents whose fields cycle through text, integer, flag, float and nested object."""
    ids = spark.range(n)
    out = []
    for i in range(fields):
        u = F.rand(seed + i)
        kind = i % 5
        text = F.substring(F.sha2(F.concat_ws("-", F.col("id").cast("string"), F.lit(str(seed + i))), 512), 1, max(1, min(128, size // fields)))
        value = [text, F.floor(u * 1_000_000).cast("long"), u < 0.5, u * 1000, F.struct(text.alias("nested_string"), F.floor(u * 1000).cast("long").alias("nested_number"))][kind]
        out.append(value.alias(f"field_{i}"))
    return ids.select(F.col("id").cast("string").alias("id"), *out)


# --------------------------------------------------------------------- logs


def fold_logs(logs: DataFrame, ts: str, keys: list[str], window_ms: int = 1000) -> DataFrame:
    """Equal records within a window as the first of them and how many there were."""
    return logs.groupBy((F.floor(F.col(ts) / window_ms) * window_ms).cast("long").alias("window"), *keys).agg(F.min(ts).alias("first_ts"), F.count("*").alias("repeated_count"))


def at_least(logs: DataFrame, level: str, order: tuple[str, ...] = ("debug", "info", "warn", "error")) -> DataFrame:
    return logs.where(F.lower("level").isin(*order[order.index(level) :]))


def islands(rows: DataFrame, by: list[str], start: str, end: str, join_within: int = 0) -> DataFrame:
    """Intervals that touch or lie within join_within of each other, merged."""
    w = Window.partitionBy(*by).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = (before.isNull() | (F.col(start) - before > join_within)).cast("long")
    numbered = rows.withColumn("_new", new).withColumn("island", F.sum("_new").over(w))
    return numbered.groupBy(*by, "island").agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count("*").alias("n"))


def token_bucket(requests: DataFrame, key: str, ts: str, capacity: float, per_ms: float) -> DataFrame:
    """Requests in order of time with whether a bucket of `capacity` tokens, refilled at per_ms, lets them pass.

    A key's requests follow one another through one task, which keeps its tokens and no
    more; a request without a time adds none."""
    rows = requests.select(F.col(key).alias("key"), F.col("event_id").cast("long").alias("id"), F.col(ts).cast("long").alias("ts"))
    rows = rows.repartition("key").sortWithinPartitions("key", "ts", "id")

    def let(batches):
        import pyarrow as pa

        began, now, tokens, at = False, None, 0.0, None
        for batch in batches:
            passed = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if not began or k != now:
                    began, now, tokens, at = True, k, float(capacity), None
                tokens = min(float(capacity), tokens + (0 if t is None or at is None else t - at) * per_ms)
                at, ok = t, tokens >= 1
                tokens -= ok
                passed.append(ok)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(passed, pa.bool_())], names=["key", "id", "ts", "allowed"])

    kind = requests.schema[key].dataType.simpleString()
    return rows.mapInArrow(let, f"key {kind}, id long, ts long, allowed boolean").withColumnRenamed("key", key)


# ----------------------------------------------------------------- metadata


def quota(databases: DataFrame, limits: DataFrame, owner: str = "owner") -> DataFrame:
    """Databases that each owner has against the limit."""
    used = databases.groupBy(owner).agg(F.count("*").alias("used"))
    return limits.join(used, owner, "left").select(owner, F.coalesce("used", F.lit(0)).cast("long").alias("used"), "max_databases", (F.coalesce("used", F.lit(0)) < F.col("max_databases")).alias("may_create"))


def list_page(rows: DataFrame, order: list[Column], limit: int = 20, offset: int = 0) -> DataFrame:
    """A page with the number of all rows on each of its rows."""
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).offset(offset).limit(min(limit, 100)).crossJoin(F.broadcast(total))  # one row


def resolve(databases: DataFrame, identifier: str) -> DataFrame:
    """By id ("id:x") or slug, with what its status lets happen."""
    test = F.col("id") == identifier[3:] if identifier.startswith("id:") else F.col("slug") == identifier
    return databases.where(test).withColumn("access", F.when(F.col("status") == "active", "ok").when(F.col("status") == "suspended", "read_only").otherwise("not_found"))


def set_slug_once(databases: DataFrame, changes: DataFrame) -> DataFrame:
    return databases.join(changes.select("id", F.col("slug").alias("new_slug")), "id", "left").withColumn("slug", F.coalesce("slug", "new_slug")).drop("new_slug")


def not_revoked(tokens: DataFrame, revoked: DataFrame, now_ms: int, grace_ms: int) -> DataFrame:
    """Tokens that no revocation older than the grace time names."""
    effective = revoked.where(F.col("revoked_at") + grace_ms <= now_ms).where(F.col("expires_at") > now_ms)
    return tokens.join(effective.select("jti"), "jti", "left_anti")


def lockouts(attempts: DataFrame, limit: int = 10, lock_ms: int = 300_000) -> DataFrame:
    """Failures that complete a run of `limit` without a success between: user, locked_from, locked_until."""
    w = Window.partitionBy("user_id").orderBy("ts_ms", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    run = attempts.withColumn("_run", F.sum(F.col("success").cast("long")).over(w))
    inside = Window.partitionBy("user_id", "_run").orderBy("ts_ms", "event_id")
    n = F.sum((~F.col("success")).cast("long")).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    return run.withColumn("_n", n).where(~F.col("success") & (F.col("_n") % limit == 0)).select("user_id", F.col("ts_ms").alias("locked_from"), (F.col("ts_ms") + lock_ms).alias("locked_until"))


def password_faults(password: Column) -> Column:
    """What a password lacks, as a list; empty if it is fine."""
    tests = {"length": F.length(password) >= 12, "upper": password.rlike("[A-Z]"), "lower": password.rlike("[a-z]"), "digit": password.rlike("[0-9]"), "special": password.rlike("[^A-Za-z0-9]")}
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in tests.items()]))
