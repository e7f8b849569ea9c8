"""Subscriptions, triggers and access rules: events against conditions.

Rules are known to the driver; events are the data.  Each condition compiles to a
Column.  Triggers and access rules are few and evaluated in one pass without a join;
subscriptions, of which there may be many, are equi-joined by the keys that an event has.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cel import Compiler, Value, compile_condition
from ..functions.fields import Fields
from ..functions.paths import base64_url, glob_regex, rule_regex
from ..model import AlreadyExists, Filter, InvalidQuery, NotFound, Retry, Trigger

# ---------------------------------------------------------------- subscriptions


@dataclass(frozen=True)
class Subscription:
    id: str
    gateway: str
    collection: str
    filters: tuple[Filter, ...] = ()
    database: str = "default"
    include_data: bool = True

    def kind(self) -> str:
        if not self.filters:
            return "collection"
        if len(self.filters) == 1 and self.filters[0].field in ("id", "_id") and self.filters[0].op == "==":
            return "document"
        return "expression"


#: Conditions that one pass over the events evaluates; more take further passes.
CONDITIONS = 500
#: Subscriptions whose text is longer than this, in characters, are shuffled, not broadcast.
BROADCAST = 8 << 20


def match(events: DataFrame, subscriptions: Iterable[Subscription]) -> DataFrame:
    """A row per event and subscription that matches: the event's columns, gateway, subscription_id, include_data.

    An event has the keys of its document, of its collection and of the conditions that hold
    for it, and these are equi-joined with the subscriptions; so only different sets of
    filters weigh on the plan, tested where their collection is the event's, not subscriptions."""
    fields, kinds, numbers, rows = Fields(events), set(), {}, []
    for s in subscriptions:
        kind = s.kind()
        kinds.add(kind)
        if kind == "expression":
            key = f"n{numbers.setdefault((s.database, s.collection, repr(s.filters)), (len(numbers), s.filters))[0]}"
        else:
            key = f"d{s.filters[0].value}" if kind == "document" else "c"
        rows.append((s.database, s.collection, key, s.gateway, s.id, s.include_data))
    table = events.sparkSession.createDataFrame(rows, "_database string, _collection string, _of string, gateway string, subscription_id string, include_data boolean")
    if sum(len(str(x)) for row in rows for x in row) <= BROADCAST:
        table = F.broadcast(table)

    plain = [k for kind, k in (("document", F.concat(F.lit("d"), F.col("doc_id").cast("string"))), ("collection", F.lit("c"))) if kind in kinds]
    every = sorted(numbers.items(), key=lambda x: x[0])
    passes = [every[i : i + CONDITIONS] for i in range(0, len(every), CONDITIONS)] or [[]]
    out = None
    for i, part in enumerate(passes):
        scopes: dict[tuple[str, str], list[Column]] = {}
        for (database, collection, _), (n, filters) in part:
            scopes.setdefault((database, collection), []).append(F.when(fields.all(filters), F.lit(f"n{n}")))
        held = F.array().cast("array<string>")
        for (database, collection), tests in scopes.items():
            held = F.when((F.col("database") == database) & (F.col("collection") == collection), F.array(*tests)).otherwise(held)
        keyed = events.withColumn("_key", F.explode(F.concat(F.array(*plain), held) if plain and not i else held)).where("_key is not null")
        same = (F.col("database") == F.col("_database")) & (F.col("collection") == F.col("_collection")) & (F.col("_key") == F.col("_of"))
        found = keyed.join(table, same).select(*[F.col(c) for c in events.columns], "gateway", "subscription_id", "include_data")
        out = found if out is None else out.unionByName(found)
    return out


def match_keys(events: DataFrame, keys: DataFrame) -> DataFrame:
    """Events with the rows of a subscription table (database, collection, doc_id or null for all, ...)."""
    on = ["database", "collection"]
    by_doc = events.join(keys.where("doc_id is not null"), [*on, "doc_id"])
    by_collection = events.join(keys.where("doc_id is null").drop("doc_id"), on)
    return by_doc.unionByName(by_collection.select(*by_doc.columns))


def fan_out(matches: DataFrame, event_key: str) -> DataFrame:
    """Subscription ids of each event and gateway, sorted."""
    return matches.groupBy(event_key, "gateway").agg(F.array_sort(F.collect_set("subscription_id")).alias("subscription_ids"))


def deliver(matches: DataFrame) -> DataFrame:
    """Deliveries; data only for subscriptions that ask for it."""
    return matches.withColumn("data", F.when(F.col("include_data"), F.col("data")))


class Registry:
    """Subscriptions by id and gateway; an id is given once."""

    def __init__(self):
        self.by_id: dict[str, Subscription] = {}

    def subscribe(self, s: Subscription) -> None:
        if s.id in self.by_id:
            raise AlreadyExists(s.id)
        if not all(f.valid() for f in s.filters):
            raise InvalidQuery(f"bad filters of {s.id}")
        self.by_id[s.id] = s

    def unsubscribe(self, subscription_id: str) -> None:
        if self.by_id.pop(subscription_id, None) is None:
            raise NotFound(subscription_id)

    def drop_gateway(self, gateway: str) -> int:
        """A gateway that went away, or is too slow, loses its subscriptions; how many."""
        gone = [i for i, s in self.by_id.items() if s.gateway == gateway]
        for i in gone:
            del self.by_id[i]
        return len(gone)

    def all(self) -> list[Subscription]:
        return list(self.by_id.values())


def subscription_stats(subscriptions: Iterable[Subscription]) -> dict[str, int]:
    every = list(subscriptions)
    return {"total": len(every), "exact": sum(s.kind() != "expression" for s in every), "expressions": sum(s.kind() == "expression" for s in every), "gateways": len({s.gateway for s in every})}


# ---------------------------------------------------------------- triggers


def check_trigger(t: Trigger) -> None:
    if not re.fullmatch(r"[A-Za-z0-9_-]{1,128}", t.id):
        raise InvalidQuery("bad trigger id")
    if not t.events or not set(t.events) <= {"create", "update", "delete"}:
        raise InvalidQuery("events are create, update, delete")
    if not t.collection or not re.match(r"https?://[^/\s]+", t.url):
        raise InvalidQuery("a trigger has a collection and an http url")


def event_scope(events: DataFrame) -> Compiler:
    """The variable `event`: type, timestamp and the flattened document."""
    data = events.schema["data"].dataType
    names = data.names if hasattr(data, "names") else []
    document = F.struct(*[F.col("data")[n].alias(n) for n in names if n not in ("id", "collection", "version")], F.col("doc_id").alias("id"), "collection", *(["version"] if "version" in events.columns else []))
    before = [F.col("before")] if "before" in events.columns else []  # the document's data before the change
    event = F.struct(F.col("type"), F.col("ts_ms").alias("timestamp"), document.alias("document"), *before)
    return Compiler({"event": (event, events.select(event.alias("e")).schema["e"].dataType)})


def trigger_condition(t: Trigger, scope: Compiler) -> Column:
    hit = F.col("type").isin(*t.events) & F.col("collection").rlike(glob_regex(t.collection))
    if t.database != "*":
        hit = hit & (F.col("database") == t.database)
    return hit & scope.condition(t.condition) if t.condition.strip() else hit


def fire(events: DataFrame, triggers: Iterable[Trigger]) -> DataFrame:
    """A delivery task per event and trigger that fires."""
    scope = event_scope(events)
    tasks = []
    for t in triggers:
        check_trigger(t)
        task = F.struct(F.lit(t.id).alias("trigger_id"), F.lit(t.url).alias("url"), F.lit(t.retry.max_attempts).alias("max_attempts"), F.lit(t.retry.initial_ms).cast("long").alias("initial_ms"), F.lit(t.retry.max_ms).cast("long").alias("max_ms"), F.lit(t.timeout_ms).cast("long").alias("timeout_ms"))
        tasks.append(F.when(trigger_condition(t, scope), task))
    found = events.withColumn("_t", F.explode(F.array_compact(F.array(*tasks))))
    return found.select(*[F.col(c) for c in events.columns], "_t.*").withColumn("subject", subject(F.col("database"), F.col("collection"), F.col("doc_id")))


def subject(database: Column, collection: Column, doc_id: Column) -> Column:
    """db.collection.base64url(id), hashed where it would pass 1024 characters."""
    whole = F.concat_ws(".", database, collection, base64_url(doc_id.cast("binary")))
    return F.when(F.length(whole) > 1024, F.concat_ws(".", database, F.lit("hash"), F.sha2(whole, 256))).otherwise(whole)


def backoff(attempt: Column, retry: Retry) -> Column:
    """Milliseconds before the attempt after `attempt` (from 1): doubled each time, capped."""
    return F.least(F.lit(retry.initial_ms) * F.pow(F.lit(2.0), attempt - 1), F.lit(float(retry.max_ms))).cast("long")


def schedule(tasks: DataFrame) -> DataFrame:
    """A row per attempt: attempt, delay_ms before it."""
    found = tasks.withColumn("attempt", F.explode(F.sequence(F.lit(1), F.col("max_attempts").cast("int"))))
    delay = F.when(F.col("attempt") == 1, F.lit(0)).otherwise(F.least(F.col("initial_ms") * F.pow(F.lit(2.0), F.col("attempt") - 2), F.col("max_ms").cast("double")))
    return found.withColumn("delay_ms", delay.cast("long"))


def outcome(code: Column, attempt: Column, max_attempts: Column) -> Column:
    """Of a delivery: done, fatal (client errors), retry (all else) or dead after the last attempt."""
    return F.when(code.between(200, 299), "done").when(code.between(400, 499), "fatal").when(attempt >= max_attempts, "dead").otherwise("retry")


def dealt(tasks: DataFrame, workers: int = 16) -> DataFrame:
    """Tasks of one document meet in one partition, in order of time."""
    return tasks.repartition(workers, "collection", "doc_id").sortWithinPartitions("collection", "doc_id", "ts_ms")


# ---------------------------------------------------------------- access rules


@dataclass(frozen=True)
class Rule:
    """One allow of a match block: path pattern, actions -> condition; nested blocks are flattened by `rules_from`."""

    pattern: str
    allow: dict[str, str] = field(default_factory=dict)


EXPANDS = {"read": ("get", "list"), "write": ("create", "update", "delete")}


def actions_of(key: str) -> set[str]:
    out = set()
    for a in key.split(","):
        a = a.strip()
        out |= {a, *EXPANDS.get(a, ())}
    return out


def rules_from(tree: dict, prefix: str = "") -> list[Rule]:
    """Rules of nested match blocks {pattern: {"allow": .., "match": ..}}."""
    out = []
    for pattern, block in tree.items():
        path = f"{prefix}/{pattern.strip('/')}".strip("/")
        out.append(Rule(path, block.get("allow", {})))
        out += rules_from(block.get("match", {}), path)
    return out


def ranked(rules: Iterable[Rule]) -> list[Rule]:
    """At every segment fixed names come before variables, variables before the rest; longer first, then by name."""

    def rank(r: Rule):
        parts = r.pattern.strip("/").split("/")
        return [(2 if p.endswith("=**}") else 1 if p.startswith("{") else 0) for p in parts], -len(parts), r.pattern

    return sorted(rules, key=rank)


def allowed(path: Column, action: str, rules: Iterable[Rule], names: dict, functions: dict | None = None) -> Column:
    """Whether the first rule whose pattern fits the path allows the action; no rule, no access."""
    out = None
    for r in ranked(rules):
        regex, groups = rule_regex(r.pattern)
        scope = dict(names)
        from pyspark.sql.types import StringType

        for i, g in enumerate(groups):
            scope[g] = (F.regexp_extract(path, regex, i + 1), StringType())
        tests = [compile_condition(re.sub(r"\$\((\w+)\)", r"\1", c), scope, functions) for key, c in r.allow.items() if action in actions_of(key)]
        verdict = F.lit(False)
        for t in tests:
            verdict = verdict | t
        out = F.when(path.rlike(regex), verdict) if out is None else out.when(path.rlike(regex), verdict)
    return F.lit(False) if out is None else F.coalesce(out.otherwise(F.lit(False)), F.lit(False))


def exists_in(joined: Column):
    """exists(path) over a column that a join with the store has filled."""
    return lambda *_: Value(joined.isNotNull(), "bool")


def with_existing(requests: DataFrame, store: DataFrame, path: Column, name: str = "found_path") -> DataFrame:
    """requests with the path of a live document at `path`, null if none: exists() as a left join."""
    there = store.where(~F.col("deleted")).select(F.col("fullpath").alias(name)).distinct()
    return requests.join(there, path == F.col(name), "left")


def with_document(requests: DataFrame, store: DataFrame, path: Column, name: str = "resource") -> DataFrame:
    """requests with the live document at `path` as a struct (id, data): get() as a left join."""
    there = store.where(~F.col("deleted")).select(F.col("fullpath").alias("_path"), F.struct(F.col("doc_id").alias("id"), "data").alias(name))
    return requests.join(there, path == F.col("_path"), "left").drop("_path")


def assembled(requests: DataFrame, databases: DataFrame, store: DataFrame) -> DataFrame:
    """Requests (database, path, action, uid, db_admin, body) as rules see them: `request`, `resource` and `is_admin`.

    `resource` is the live document at the path, null for a create; `request.resource`
    the body of a create or update.  A database's owner is one of its administrators;
    so is who the list db_admin names it for, by id or slug.  Nobody (a null or empty uid) owns anything."""
    named = databases.select(F.col("id").alias("_id"), F.col("slug").alias("_slug"), F.col("owner").alias("_owner"))
    found = requests.join(named, (F.col("database") == F.col("_id")) | (F.col("database") == F.col("_slug")), "left")
    owner = (F.col("_owner") == F.col("uid")) & (F.col("uid") != "")
    listed = F.arrays_overlap(F.coalesce("db_admin", F.array().cast("array<string>")), F.array_compact(F.array("database", "_id", "_slug")))
    found = found.withColumn("is_admin", F.coalesce(owner, F.lit(False)) | F.coalesce(listed, F.lit(False)))
    there = store.where(~F.col("deleted")).select(F.col("database").alias("_db"), F.col("fullpath").alias("_path"), F.struct(F.col("doc_id").alias("id"), "data").alias("resource"))
    found = found.join(there, (F.coalesce("_id", "database") == F.col("_db")) & (F.col("path") == F.col("_path")) & (F.col("action") != "create"), "left")
    body = F.when(F.col("action").isin("create", "update"), F.struct(F.col("body").alias("data")))
    request = F.struct(F.struct("uid").alias("auth"), body.alias("resource"))
    return found.withColumn("request", request).drop("_id", "_slug", "_owner", "_db", "_path")


def authorized(requests: DataFrame, rules: dict[str, list[Rule]], actions: Iterable[str] = ("get", "list", "create", "update", "delete")) -> DataFrame:
    """Assembled requests with `allowed`: administrators may do all; others what their database's rules say, nothing without rules."""
    names = {n: (F.col(n), requests.schema[n].dataType) for n in ("request", "resource")}
    out = F.lit(False)
    for database, its in rules.items():
        for a in actions:
            out = F.when((F.col("database") == database) & (F.col("action") == a), allowed(F.col("path"), a, its, names)).otherwise(out)
    return requests.withColumn("allowed", F.col("is_admin") | out)
