"""Batch writes: create, replace, patch, delete, compare-and-swap, pull and push.

Each verb joins its changes with the live documents and returns the outcome of every
change (`status`); `apply` rewrites the store with what was accepted.  There is no
in-place update: a store is a DataFrame, and a write makes the next one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths
from ..model import InvalidQuery, check_collection

KEY = ["database", "fullpath"]
#: A change's place (from 1) among those of its key in the batch.
PLACE = "_n"
DAY_MS = 24 * 3600 * 1000


def with_current(changes: DataFrame, store: DataFrame) -> DataFrame:
    """changes beside what the store has at their key, as columns cur_*."""
    now = store.select(*KEY, *[F.col(c).alias(f"cur_{c}") for c in store.columns if c not in KEY], F.lit(True).alias("cur_here"))
    return changes.join(now, KEY, "left").withColumns({"cur_here": F.coalesce("cur_here", F.lit(False)), "cur_live": F.coalesce(F.col("cur_here") & ~F.col("cur_deleted"), F.lit(False))})


def placed(changes: DataFrame) -> DataFrame:
    """changes with their place among those of one key: in the order of seq, where they have it."""
    if "seq" in changes.columns:
        return changes.withColumn(PLACE, F.row_number().over(Window.partitionBy(*KEY).orderBy("seq")))
    found = changes.withColumn("_at", F.monotonically_increasing_id())
    return found.withColumn(PLACE, F.row_number().over(Window.partitionBy(*KEY).orderBy("_at"))).drop("_at")


def create(changes: DataFrame, store: DataFrame, now: int) -> DataFrame:
    """New documents at version 1; a live one in the way, or an earlier create in the batch, is a conflict; a deleted one is overwritten."""
    found = with_current(placed(changes), store)
    new = ~F.col("cur_live") & (F.col(PLACE) == 1)
    return found.withColumns({"status": F.when(new, "created").otherwise("exists"), "version": F.when(~F.col("cur_live"), F.lit(1)).otherwise(F.col("cur_version")).cast("long"), "created_at": F.lit(now).cast("long"), "updated_at": F.lit(now).cast("long")})


def replace(changes: DataFrame, store: DataFrame, now: int, precondition: Column | None = None) -> DataFrame:
    """Whole new data: created where nothing lives (whatever the precondition), else one version up.

    Changes of one key follow one another; a precondition is judged on what the store
    has, which only a key's first change still finds."""
    first = F.col(PLACE) == 1
    ok = F.lit(True) if precondition is None else F.coalesce(precondition, F.lit(False)) & first
    found = with_current(placed(changes), store)
    status = F.when(~F.col("cur_live") & first, "created").when(ok, "replaced").otherwise("precondition_failed")
    base = F.when(F.col("cur_live"), F.col("cur_version")).otherwise(F.lit(0)).cast("long")
    version = base + (F.col(PLACE) if precondition is None else F.when(F.col("cur_live"), ok.cast("long")).otherwise(1))
    return found.withColumns({"status": status, "version": version.cast("long"), "updated_at": F.lit(now).cast("long")})


def update_status(precondition: Column | None = None) -> Column:
    """Of an update or patch: a tombstone fails the precondition, nothing is not found."""
    ok = F.lit(True) if precondition is None else F.coalesce(precondition, F.lit(False))
    return F.when(~F.col("cur_here"), "not_found").when(~F.col("cur_live") | ~ok, "precondition_failed").otherwise("updated")


def patch(changes: DataFrame, store: DataFrame, fields: list[str], now: int, precondition: Column | None = None) -> DataFrame:
    """Sets the `fields` that a change has in its struct `set`; null values are stored.

    Changes of one key follow one another; under a precondition only the first can pass."""
    only = None if precondition is None else precondition & (F.col(PLACE) == 1)
    found = with_current(placed(changes), store).withColumn("status", update_status(only))
    done = F.col("status") == "updated"
    data = F.col("cur_data")
    for name in fields:
        data = data.withField(name, F.col("set")[name])
    return found.withColumns({"data": F.when(done, data).otherwise(F.col("cur_data")), "version": F.col("cur_version") + F.when(done, F.col(PLACE)).otherwise(0).cast("long"), "updated_at": F.when(done, F.lit(now)).otherwise(F.col("cur_updated_at")).cast("long")})


def delete(changes: DataFrame, store: DataFrame, now: int, retention_ms: int = DAY_MS, precondition: Column | None = None) -> DataFrame:
    """Soft deletes: data emptied, one version up, an expiry; not found where nothing lives (any more)."""
    ok = F.lit(True) if precondition is None else F.coalesce(precondition, F.lit(False))
    found = with_current(placed(changes), store)
    again = F.col(PLACE) > 1
    status = F.when(~F.col("cur_live"), "not_found").when(~ok, "precondition_failed").when(again, "not_found").otherwise("deleted")
    found = found.withColumn("status", status)
    done = F.col("status") == "deleted"
    return found.withColumns({"version": F.col("cur_version") + done.cast("long"), "deleted": done | F.coalesce("cur_deleted", F.lit(False)), "expires_at": F.when(done, F.lit(now + retention_ms)), "updated_at": F.when(done, F.lit(now)).otherwise(F.col("cur_updated_at")).cast("long")})


def purge_expired(store: DataFrame, now: int, column: str = "expires_at") -> DataFrame:
    return store.where(F.col(column).isNull() | (F.col(column) > now))


def drop_database(store: DataFrame, database: str) -> DataFrame:
    return store.where(F.col("database") != database)


def latest(versions: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key."""
    return versions.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*[c.desc() for c in order]))).where("_r = 1").drop("_r")


def rows_of(found: DataFrame, store: DataFrame) -> DataFrame:
    """Outcomes of a verb as rows of the store: what the verb set, else what the store had, else what the path tells."""
    collection = paths.parent(F.col("fullpath"))
    told = {"collection": collection, "collection_group": paths.group(collection), "parent": paths.parent(collection), "doc_id": paths.last(F.col("fullpath")), "deleted": F.lit(False)}
    gone = F.col("status") == "deleted"
    out = []
    for f in store.schema.fields:
        c = f.name
        if c in KEY:
            value = F.col(c)
        elif c in told and c != "deleted":
            value = told[c]
        elif c == "deleted":
            value = gone
        elif c == "data":
            value = F.when(~gone, F.col("data" if "data" in found.columns else "cur_data"))
        elif c == "created_at":
            value = F.coalesce(F.when(F.col("cur_live"), F.col("cur_created_at")), F.col("updated_at"))
        else:
            value = F.col(c) if c in found.columns else F.col(f"cur_{c}")
        out.append(value.cast(f.dataType).alias(c))
    return found.select(*out, *[x for x in (PLACE,) if x in found.columns])


def apply(store: DataFrame, accepted: DataFrame) -> DataFrame:
    """The store with accepted rows (of the store's columns) in place of what has their key; of several of one key the last."""
    if PLACE in accepted.columns:
        accepted = latest(accepted, KEY, [F.col(PLACE)])
    return store.join(accepted.select(*KEY).distinct(), KEY, "left_anti").select(*store.columns).unionByName(accepted.select(*store.columns))


def batch(ops: DataFrame, store: DataFrame) -> DataFrame:
    """Ordered operations (database, fullpath, seq, op, data) on each key, folded to its final state.

    create and replace set data, update needs a live document, delete empties it;
    rows: key, live, version, data, applied, failed."""
    first = store.select(*KEY, F.struct((~F.col("deleted")).alias("live"), "version", "data").alias("s"))
    lists = ops.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("seq", "op", "data"))).alias("ops"))
    data_type = store.schema["data"].dataType.simpleString()
    start = F.struct(F.coalesce("s.live", F.lit(False)).alias("live"), F.coalesce("s.version", F.lit(0)).cast("long").alias("version"), F.col("s.data").alias("data"), F.lit(0).cast("long").alias("applied"), F.lit(0).cast("long").alias("failed"))

    def step(a: Column, o: Column) -> Column:
        ok = F.when(o["op"] == "create", ~a["live"]).when(o["op"].isin("update", "delete"), a["live"]).otherwise(F.lit(True))
        gone = o["op"] == "delete"
        return F.struct(
            F.when(ok, ~gone).otherwise(a["live"]).alias("live"),
            F.when(~ok, a["version"]).when(o["op"] == "create", F.lit(1).cast("long")).otherwise(a["version"] + 1).alias("version"),
            F.when(~ok, a["data"]).when(gone, F.lit(None).cast(data_type)).otherwise(o["data"]).alias("data"),
            (a["applied"] + ok.cast("long")).alias("applied"),
            (a["failed"] + (~ok).cast("long")).alias("failed"),
        )

    return lists.join(first, KEY, "left").withColumn("out", F.aggregate("ops", start, step)).select(*KEY, "out.*")


def pull(docs: DataFrame, database: str, collection: str, checkpoint: int, limit: int) -> DataFrame:
    """A page of changes from the checkpoint on (inclusive), tombstones too."""
    found = docs.where((F.col("database") == database) & (F.col("collection") == collection) & (F.col("updated_at") >= checkpoint))
    return found.orderBy("updated_at", "doc_id").limit(limit)


def pull_after(docs: DataFrame, database: str, collection: str, updated_at: int, doc_id: str, limit: int) -> DataFrame:
    """As pull, from behind one row: never stuck where many rows share a millisecond."""
    found = docs.where((F.col("database") == database) & (F.col("collection") == collection))
    beyond = (F.col("updated_at") > updated_at) | ((F.col("updated_at") == updated_at) & (F.col("doc_id") > doc_id))
    return found.where(beyond).orderBy("updated_at", "doc_id").limit(limit)


def checkpoint(page: DataFrame, before: int) -> DataFrame:
    return page.agg(F.coalesce(F.max("updated_at"), F.lit(before)).alias("checkpoint"))


def push(changes: DataFrame, store: DataFrame) -> DataFrame:
    """Classifies client changes (action, base_version, data): accepted create, update or
    delete; conflict where the base version is not the current one; noop for a delete of nothing."""
    found = with_current(changes, store)
    stale = F.col("base_version").isNotNull() & (F.col("base_version") != F.col("cur_version"))
    outcome = (
        F.when(F.col("action") == "delete", F.when(~F.col("cur_live"), "noop").when(stale, "conflict").otherwise("delete"))
        .when(~F.col("cur_live"), "create")
        .when((F.col("action") == "create") & F.col("base_version").isNull(), "conflict")
        .when(stale, "conflict")
        .otherwise("update")
    )
    return found.withColumn("outcome", outcome)


def push_faults(collection: str) -> Column:
    """What is wrong with a pushed change (fullpath, data) of a collection: missing_document, bad_path, other_collection; null if nothing."""
    check_collection(collection)
    path = F.col("fullpath")
    return F.when(path.isNull() | F.col("data").isNull() & (F.col("action") != "delete"), "missing_document").when(~paths.is_path(path, 0), "bad_path").when(~path.startswith(collection + "/"), "other_collection")


def push_apply(changes: DataFrame, store: DataFrame, now: int, collection: str = "") -> tuple[DataFrame, DataFrame]:
    """Pushes client changes (seq, action, base_version, data): (outcome and server_version of each, the next store).

    Changes of one key follow one another.  A collection, where given, is that of every
    change: a faulty one refuses the push.  Conflicts leave the store as it is."""
    if collection and changes.where(push_faults(collection).isNotNull()).limit(1).count():
        raise InvalidQuery("a pushed change has no document, a bad path or another collection")
    kind = store.schema["data"].dataType.simpleString()
    order = [F.col("seq")] if "seq" in changes.columns else []
    lists = changes.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct(*[c.alias("seq") for c in order], F.col("action"), F.col("base_version").cast("long").alias("base"), F.col("data").cast(kind).alias("data")))).alias("ops"))
    now_at = store.select(*KEY, F.struct((~F.col("deleted")).alias("live"), "version", "data", "created_at").alias("s"))
    done = "array<struct<place:int,outcome:string,server_version:bigint>>"
    start = F.struct(F.coalesce("s.live", F.lit(False)).alias("live"), F.col("s.version").alias("version"), F.col("s.data").alias("data"), F.lit(False).alias("changed"), F.array().cast(done).alias("out"))

    def step(a: Column, o: Column) -> Column:
        stale = a["live"] & o["base"].isNotNull() & (o["base"] != a["version"])
        blind = (o["action"] == "create") & o["base"].isNull()
        outcome = F.when(o["action"] == "delete", F.when(~a["live"], "noop").when(stale, "conflict").otherwise("delete")).when(~a["live"], "create").when(blind | stale, "conflict").otherwise("update")
        took = outcome.isin("create", "update", "delete")
        return F.struct(
            F.when(took, outcome != "delete").otherwise(a["live"]).alias("live"),
            F.when(~took, a["version"]).when(outcome == "create", F.lit(1).cast("long")).otherwise(a["version"] + 1).alias("version"),
            F.when(~took, a["data"]).when(outcome == "delete", F.lit(None).cast(kind)).otherwise(o["data"]).alias("data"),
            (a["changed"] | took).alias("changed"),
            F.concat(a["out"], F.array(F.struct((F.size(a["out"]) + 1).alias("place"), outcome.alias("outcome"), a["version"].alias("server_version")))).alias("out"),
        )

    folded = lists.join(now_at, KEY, "left").withColumn("x", F.aggregate("ops", start, step)).select(*KEY, F.when(F.col("s.live"), F.col("s.created_at")).alias("was_created"), "x.*")
    outcomes = folded.select(*KEY, F.explode("out").alias("o")).select(*KEY, "o.*")
    found = folded.where("changed").select(*KEY, F.when(F.col("live"), F.lit("updated")).otherwise("deleted").alias("status"), "data", "version", F.lit(now).cast("long").alias("updated_at"), F.col("was_created").alias("cur_created_at"), F.col("was_created").isNotNull().alias("cur_live"))
    return outcomes, apply(store, rows_of(found, store))
