"""Named queries over deliveries, databases, indexes, pushes, access and the durable log, each with its SQL."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import paths
from .functions.cel import CelError, compile_condition, filters_to_cel
from .model import AlreadyExists, EngineError, Filter, IndexNotReady, InvalidQuery, NotFound, Order, PermissionDenied, PreconditionFailed, Query, Trigger
from .operators import analytics, cdc, databases, delivery, query, rules, writes
from .plans import indexes
from .plans.ordered import numbered
from .queries import CHANGED, FOLD, JOINED, LOG, NOW, ORDERS, OUTCOME, QUERIES, SQL, TRIGGERS, _changes, _requests, named
from .sources import config, tables
from .streaming import changes as streams


def folder(spark: SparkSession) -> str:
    """A new folder that executors share; a temporary one only where the session runs on one machine and names none."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that executors and driver share")
        shared = "file://" + tempfile.mkdtemp(prefix="docweave-")
    return f"{shared.rstrip('/')}/docweave-{uuid.uuid4().hex}"


def literal_rows(rows: list[tuple], names: str) -> str:
    """Rows that the driver knows, as SQL."""

    def text(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).upper()
        return str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) t({names})"


def log_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.change_log(spark, sf_dir)


# --------------------------------------------------------------- the buffer

EVENT_KEY = "lpad(CAST(t AS VARCHAR), 10, '0') || '-' || lpad(CAST(i AS VARCHAR), 10, '0') || '-' || t || '-' || i || '-' || substr(sha256('users/' || doc_id), 1, 16)"
AFTER = "1704500000-"


@named(f"SELECT i, {EVENT_KEY} AS key FROM {LOG}")
def compound_key(spark, sf_dir):
    return cdc.normalize(log_of(spark, sf_dir))[0].select("i", "key")


@named(f"SELECT i, t AS seconds, i AS place FROM {LOG}")
def event_id_parse(spark, sf_dir):
    t, i = paths.cluster_time(F.col("event_id"))
    return cdc.normalize(log_of(spark, sf_dir))[0].select("i", t.alias("seconds"), i.alias("place"))


@named(f"SELECT i, {EVENT_KEY} AS key FROM {LOG} WHERE (i % 3 <> 0 OR i % 2 = 0) AND {EVENT_KEY} > '{AFTER}'")
def buffer_scan(spark, sf_dir):
    """Disk and memory hold some events both."""
    log = cdc.normalize(log_of(spark, sf_dir))[0].select("i", "key")
    return cdc.concatenated(log.where("i % 3 <> 0"), log.where("i % 2 = 0"), AFTER)


@named(f"SELECT min(key) AS first, max(key) AS head, count(*) AS events, count(CASE WHEN key > '{AFTER}' THEN 1 END) AS behind FROM (SELECT {EVENT_KEY} AS key FROM {LOG})")
def buffer_head(spark, sf_dir):
    return cdc.head(cdc.normalize(log_of(spark, sf_dir))[0], AFTER)


@named(f"SELECT i FROM {LOG} WHERE ts_ms >= 1704600000000")
def start_from_now(spark, sf_dir):
    return delivery.starting(log_of(spark, sf_dir), None, "from_now", 1_704_600_000_000).select("i")


MESSAGES = {"signup": "Resume token is gone", "view": "Connection reset", "click": "i/o timeout", "purchase": "bad document", "error": "change stream history lost"}


@named("SELECT event_id, CASE WHEN event_type IN ('signup', 'error') THEN 'restart' WHEN event_id % 7 >= 5 THEN 'fatal' WHEN event_type IN ('view', 'click') THEN 'retry' ELSE 'reconnect' END AS action FROM events")
def error_actions(spark, sf_dir):
    message = F.create_map(*[F.lit(x) for pair in MESSAGES.items() for x in pair])[F.col("event_type")]
    return tables.read(spark, sf_dir, "events").select("event_id", cdc.error_action(message, F.col("event_id") % 7).alias("action"))


@named(f"SELECT i, CASE WHEN value < 10 THEN 'delete' WHEN op IN ('insert', 'replace') OR i % 3 = 0 THEN 'create' ELSE 'update' END AS type FROM {LOG} WHERE op <> 'delete'")
def transform_revived(spark, sf_dir):
    return cdc.typed(log_of(spark, sf_dir), F.col("value") < 10, F.col("i") % 3 == 0).select("i", "type")


def _streamed(spark, sf_dir, start) -> DataFrame:
    place = folder(spark)
    log_of(spark, sf_dir).repartition(3).write.parquet(f"{place}/log")
    start(streams.source(spark, f"{place}/log", files_per_batch=1), f"{place}/out", f"{place}/state").awaitTermination()
    return spark.read.parquet(f"{place}/out")


@named(f"SELECT i, {EVENT_KEY} AS key FROM {LOG}")
def stream_buffer(spark, sf_dir):
    """The durable buffer, filled by a stream in batches of one file."""
    return _streamed(spark, sf_dir, streams.buffered).select("i", "key")


@named(f"SELECT doc_id, op, value, t, i FROM {LOG} QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY t DESC, i DESC) = 1")
def stream_index(spark, sf_dir):
    """The index that a stream keeps up to date: its last generation."""
    found = _streamed(spark, sf_dir, streams.maintained)
    return found.where(F.col("generation") == found.agg(F.max("generation")).first()[0]).select("doc_id", "op", "value", "t", "i")


@named(f"SELECT i FROM {LOG} WHERE doc_id = '7'")
def watch_scope(spark, sf_dir):
    """A stream's scope, pushed into the scan."""
    place = folder(spark)
    log = log_of(spark, sf_dir)
    log.withColumn("collection", F.when(F.col("doc_id") == "7", "watched").otherwise("other")).write.parquet(f"{place}/log")
    watched = streams.source(spark, f"{place}/log", collections=["watched"])
    streams.each_batch(watched, lambda b: b, f"{place}/out", f"{place}/state").awaitTermination()
    return spark.read.parquet(f"{place}/out").select("i")


# --------------------------------------------------------------- delivery

NEXT = f"(SELECT backend, t, i, ts_ms, lead(ts_ms) OVER (PARTITION BY backend ORDER BY t, i) AS next_ms FROM {LOG})"


@named(f"SELECT backend, t, i, unnest(generate_series(ts_ms + 600000, next_ms - 1, 600000)) AS at_ms FROM {NEXT} WHERE next_ms - ts_ms > 600000")
def heartbeat(spark, sf_dir):
    return delivery.heartbeats(log_of(spark, sf_dir), 600_000)


@named(f"SELECT backend, i, CASE WHEN count(*) OVER (PARTITION BY backend, ts_ms // 3600000) > 3 THEN 'catch_up' ELSE 'live' END AS mode FROM {LOG}")
def delivery_mode(spark, sf_dir):
    return delivery.modes(log_of(spark, sf_dir), 3, 3_600_000).select("backend", "i", "mode")


@named("SELECT event_id, CAST(least(1000 * pow(2, event_id % 9), 30000) AS BIGINT) AS wait_ms FROM events")
def reconnect_backoff(spark, sf_dir):
    return tables.read(spark, sf_dir, "events").select("event_id", delivery.reconnect_ms(1 + F.col("event_id") % 9).alias("wait_ms"))


@named("SELECT event_id, CAST(list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(string_split('users' || user_id, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda h, b: (xor(h, b) * 16777619) & 4294967295) % 16 AS INTEGER) AS worker FROM events")
def dispatch_worker(spark, sf_dir):
    return tables.read(spark, sf_dir, "events").select("event_id", delivery.worker_of(F.lit("users"), F.col("user_id").cast("string"), 16).alias("worker"))


SECRET = "0123456789abcdef"


def _pad(byte: int) -> str:
    return "".join(f"{b ^ byte:02x}" for b in SECRET.encode().ljust(64, b"\0"))


@named(f"SELECT c_custkey, CASE WHEN c_custkey % 3 = 1 THEN 't=1700000000,v1=' || sha256(unhex('{_pad(0x5C)}') || unhex(sha256(unhex('{_pad(0x36)}') || encode('1700000000.' || c_name)))) END AS signature, CASE WHEN c_custkey % 3 = 2 THEN 'unknown_secret' END AS fault FROM customer")
def webhook_signature(spark, sf_dir):
    ref = F.when(F.col("c_custkey") % 3 == 1, "main").when(F.col("c_custkey") % 3 == 2, "lost").otherwise("")
    tasks = tables.read(spark, sf_dir, "customer").withColumn("secret_ref", ref)
    found = delivery.webhook_requests(tasks, F.col("c_name"), F.lit(1_700_000_000), {"main": SECRET})
    return found.select("c_custkey", F.col("headers")["X-Signature"].alias("signature"), "fault")


ATTEMPTS = "(SELECT event_id, epoch_us(ts) // 1000 AS ts_ms, CASE event_id % 5 WHEN 0 THEN 200 WHEN 1 THEN 404 WHEN 2 THEN 503 WHEN 3 THEN NULL ELSE 301 END AS code, 1 + event_id % 3 AS attempt FROM events)"


def _attempts(spark, sf_dir):
    e = tables.operation_results(spark, sf_dir)
    k = F.col("event_id") % 5
    code = F.when(k == 0, 200).when(k == 1, 404).when(k == 2, 503).when(k == 4, 301)
    return e.select("event_id", "ts_ms", code.alias("code"), (1 + F.col("event_id") % 3).alias("attempt"), F.lit(3).alias("max_attempts"), F.lit(1000).alias("initial_ms"), F.lit(1500).alias("max_ms"))


VERDICT = "CASE WHEN code BETWEEN 200 AND 299 THEN 'ack' WHEN code BETWEEN 400 AND 499 THEN 'term' WHEN attempt >= 3 THEN 'dead' ELSE 'nak' END"


@named(f"SELECT event_id, verdict, CASE WHEN verdict = 'nak' THEN CAST(least(1000 * pow(2, attempt - 1), 1500) AS BIGINT) END AS redeliver_in_ms FROM (SELECT *, {VERDICT} AS verdict FROM {ATTEMPTS})")
def ack_nak(spark, sf_dir):
    return delivery.settled(_attempts(spark, sf_dir)).select("event_id", "verdict", "redeliver_in_ms")


@named(f"SELECT event_id, attempt + 1 AS attempt, ts_ms + CAST(least(1000 * pow(2, attempt - 1), 1500) AS BIGINT) AS due_ms FROM (SELECT *, {VERDICT} AS verdict FROM {ATTEMPTS}) WHERE verdict = 'nak'")
def redelivery(spark, sf_dir):
    return delivery.redelivered(_attempts(spark, sf_dir)).select("event_id", "attempt", "due_ms")


@named("SELECT event_id, CASE WHEN s >= 1705000000000 THEN 'returned' WHEN s + d <= 1705000000000 THEN 'done' WHEN s + d <= 1705003600000 THEN 'drained' ELSE 'cut_off' END AS state FROM (SELECT event_id, epoch_us(ts) // 1000 AS s, CAST(floor(value) AS BIGINT) * 1000000 AS d FROM events)")
def drain(spark, sf_dir):
    m = tables.operation_results(spark, sf_dir).select("event_id", F.col("ts_ms").alias("started_ms"), (F.col("latency_ms") * 1_000_000).alias("took_ms"))
    return delivery.drained(m, 1_705_000_000_000, 3_600_000).select("event_id", "state")


@named("SELECT event_id, 'id: ' || event_id || chr(10) || 'event: ' || event_type || chr(10) || 'data: ' || props || chr(10) || chr(10) AS frame FROM events")
def event_stream_frame(spark, sf_dir):
    e = tables.read(spark, sf_dir, "events")
    return delivery.frames(e, F.col("props"), F.col("event_type"), F.col("event_id")).select("event_id", "frame")


SENT = "(SELECT event_id, 'g' || (user_id % 7) AS gateway, epoch_us(ts) // 1000 AS ts_ms, CAST(floor(value) AS BIGINT) * 30 AS took_ms FROM events)"


@named(f"SELECT event_id, gateway FROM {SENT} s WHERE NOT EXISTS (SELECT 1 FROM {SENT} d WHERE d.gateway = s.gateway AND d.took_ms > 5000 AND d.ts_ms <= s.ts_ms)")
def slow_gateways(spark, sf_dir):
    e = tables.operation_results(spark, sf_dir)
    sent = e.select("event_id", F.concat(F.lit("g"), (F.col("user_id") % 7).cast("string")).alias("gateway"), "ts_ms", (F.col("latency_ms") * 30).alias("took_ms"))
    return delivery.timely(sent).select("event_id", "gateway")


# ------------------------------------------------------------------- writes


@named(f"SELECT CAST(coalesce(k, o_orderkey) AS VARCHAR) AS doc_id, CASE WHEN outcome IN ('create', 'update') THEN CAST(k AS DOUBLE) WHEN outcome = 'delete' THEN NULL ELSE total END AS total, CAST(CASE outcome WHEN 'create' THEN 1 WHEN 'update' THEN version + 1 WHEN 'delete' THEN version + 1 ELSE version END AS BIGINT) AS version, CASE outcome WHEN 'create' THEN FALSE WHEN 'update' THEN FALSE WHEN 'delete' THEN TRUE ELSE deleted END AS deleted FROM (SELECT k, d.*, CASE WHEN k IS NOT NULL THEN {OUTCOME} END AS outcome FROM {CHANGED} c FULL JOIN {ORDERS} d ON c.fullpath = 'orders/' || d.doc_id) WHERE o_orderkey IS NOT NULL OR outcome = 'create'")
def push_store(spark, sf_dir):
    """The store that a push leaves."""
    k = F.col("k")
    data = F.struct(k.alias("custkey"), F.lit("N").alias("status"), k.cast("double").alias("total"), F.lit("1-URGENT").alias("priority"))
    pushed = _changes(spark, sf_dir).withColumns({"action": F.when(k % 3 == 0, "delete").otherwise("update"), "base_version": k % 4, "data": data, "seq": k})
    _, store = writes.push_apply(pushed, tables.orders_docs(spark, sf_dir), NOW, "orders")
    return store.select("doc_id", F.col("data.total").alias("total"), "version", "deleted")


@named("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'missing_document' WHEN 1 THEN 'bad_path' WHEN 2 THEN 'other_collection' END AS fault FROM customer")
def push_validate(spark, sf_dir):
    k = F.col("c_custkey")
    path = F.when(k % 4 == 1, F.concat(F.lit("orders//"), k.cast("string"))).when(k % 4 == 2, F.concat(F.lit("orders2/"), k.cast("string"))).otherwise(F.concat(F.lit("orders/"), k.cast("string")))
    pushed = tables.read(spark, sf_dir, "customer").select("c_custkey", path.alias("fullpath"), F.when(k % 4 != 0, F.struct("c_name")).alias("data"), F.lit("update").alias("action"))
    return pushed.select("c_custkey", writes.push_faults("orders").alias("fault"))


def _twice(spark, sf_dir):
    once = _changes(spark, sf_dir).withColumn("data", F.struct(F.col("k").alias("custkey"), F.lit("N").alias("status"), F.lit(1.0).alias("total"), F.lit("-").alias("priority")))
    return once.withColumn("seq", F.lit(1)).unionByName(once.withColumn("seq", F.lit(2)))


TWICE = "(SELECT * FROM (VALUES (1), (2)) q(seq))"


@named(f"SELECT fullpath, seq, CASE WHEN (d.doc_id IS NULL OR d.deleted) AND seq = 1 THEN 'created' ELSE 'exists' END AS status FROM {JOINED} CROSS JOIN {TWICE}")
def create_twice(spark, sf_dir):
    """Of two creates of one path in a batch only the first makes a document."""
    return writes.create(_twice(spark, sf_dir), tables.orders_docs(spark, sf_dir), NOW).select("fullpath", "seq", "status")


@named(f"SELECT count(DISTINCT p) AS paths, count(*) AS documents FROM (SELECT 'orders/' || doc_id AS p FROM {ORDERS} WHERE 'orders/' || doc_id NOT IN (SELECT fullpath FROM {CHANGED}) UNION ALL SELECT fullpath FROM {CHANGED})")
def create_twice_store(spark, sf_dir):
    store = tables.orders_docs(spark, sf_dir)
    found = writes.create(_twice(spark, sf_dir), store, NOW)
    after = writes.apply(store, writes.rows_of(found.where("status = 'created'"), store))
    return after.agg(F.countDistinct("fullpath").alias("paths"), F.count("*").alias("documents"))


@named(f"SELECT fullpath, seq, CASE WHEN (d.doc_id IS NULL OR d.deleted) AND seq = 1 THEN 'created' ELSE 'replaced' END AS status, CAST(CASE WHEN d.doc_id IS NULL OR d.deleted THEN 0 ELSE d.version END + seq AS BIGINT) AS version FROM {JOINED} CROSS JOIN {TWICE}")
def replace_twice(spark, sf_dir):
    return writes.replace(_twice(spark, sf_dir), tables.orders_docs(spark, sf_dir), NOW).select("fullpath", "seq", "status", "version")


@named(f"SELECT * FROM (SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'a' ELSE 'b' END AS database, count(*) AS docs, CAST(sum(version) AS BIGINT) AS versions FROM {ORDERS} GROUP BY 1)")
def multi_database_write(spark, sf_dir):
    """Two databases of one store, the first written again after the second."""
    store = databases.Stores(folder(spark))
    docs = tables.orders_docs(spark, sf_dir).withColumn("database", F.when(F.col("doc_id").cast("long") % 3 == 0, "a").otherwise("b"))
    for name in ("a", "b"):
        store.write(docs, name)
    store.write(store.read(spark, "a"), "a")
    both = store.read(spark, "a").unionByName(store.read(spark, "b"))
    return both.groupBy("database").agg(F.count("*").alias("docs"), F.sum("version").alias("versions"))


@named(f"SELECT least(count(*), 1000) AS n, count(*) > 1000 AS more FROM {ORDERS} WHERE NOT deleted")
def page_limit_max(spark, sf_dir):
    rows, more, _ = query.page(tables.orders_docs(spark, sf_dir), Query("orders", order_by=(Order("total"),), limit=1000))
    return rows.agg(F.count("*").alias("n")).withColumn("more", F.lit(more))


@named(f"SELECT doc_id, total, version FROM {ORDERS} WHERE NOT deleted AND status = 'F' AND total > 100000 ORDER BY total, doc_id LIMIT 40")
def fluent_query(spark, sf_dir):
    found = query.Collection(tables.orders_docs(spark, sf_dir), "orders").where("status", "==", "F").where("total", ">", 100000).order_by("total").limit(40).to_df()
    return found.select("doc_id", F.col("data.total").alias("total"), "version")


# ---------------------------------------------------------------- databases


@named("SELECT s_suppkey FROM supplier WHERE s_nationkey % 3 <> 0")
def database_purge(spark, sf_dir):
    n = tables.read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.when(F.col("n_nationkey") % 3 == 0, "deleting").otherwise("active").alias("status"))
    docs = tables.read(spark, sf_dir, "supplier").withColumn("database", F.col("s_nationkey"))
    return databases.finish_deleting(n, docs)[1].select("s_suppkey")


WANTED = "(SELECT c_custkey AS seq, CAST(c_nationkey AS VARCHAR) AS owner, CASE c_custkey % 4 WHEN 1 THEN 'db-' || c_custkey WHEN 2 THEN 'Bad Slug' WHEN 3 THEN 'shared' END AS slug FROM customer)"


@named(f"SELECT seq, CASE WHEN fault IS NOT NULL THEN fault WHEN sum(CASE WHEN fault IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY owner ORDER BY seq ROWS UNBOUNDED PRECEDING) > 3 - used THEN 'over_quota' ELSE 'created' END AS status FROM (SELECT seq, owner, CASE WHEN slug = 'Bad Slug' THEN 'invalid_slug' WHEN slug IN (SELECT 'db-' || (4 * n_nationkey + 1) FROM nation) OR (slug IS NOT NULL AND row_number() OVER (PARTITION BY slug ORDER BY seq) > 1) THEN 'exists' END AS fault, CASE WHEN CAST(owner AS INTEGER) % 2 = 0 THEN 1 ELSE 0 END AS used FROM {WANTED})")
def database_create(spark, sf_dir):
    k = F.col("c_custkey")
    slug = F.when(k % 4 == 1, F.concat(F.lit("db-"), k.cast("string"))).when(k % 4 == 2, "Bad Slug").when(k % 4 == 3, "shared")
    asked = tables.read(spark, sf_dir, "customer").select(k.alias("seq"), F.col("c_nationkey").cast("string").alias("owner"), slug.alias("slug"))
    n = tables.read(spark, sf_dir, "nation")
    have = n.select(F.concat(F.lit("db-"), (4 * F.col("n_nationkey") + 1).cast("string")).alias("slug"), F.col("n_nationkey").cast("string").alias("owner"), F.when(F.col("n_nationkey") % 2 == 0, "active").otherwise("deleting").alias("status"))
    limits = n.select(F.col("n_nationkey").cast("string").alias("owner"), F.lit(3).alias("max_databases"))
    return databases.create(asked, have, limits).select("seq", "status")


BASES = "(SELECT CAST(n_nationkey AS VARCHAR) AS id, CASE WHEN n_nationkey % 5 <> 0 THEN lower(n_name) END AS slug, CASE n_nationkey % 3 WHEN 0 THEN 'active' WHEN 1 THEN 'suspended' ELSE 'deleting' END AS status FROM nation)"


def _bases(spark, sf_dir):
    k = F.col("n_nationkey")
    return tables.read(spark, sf_dir, "nation").select(k.cast("string").alias("id"), F.when(k % 5 != 0, F.lower("n_name")).alias("slug"), F.when(k % 3 == 0, "active").when(k % 3 == 1, "suspended").otherwise("deleting").alias("status"))


@named(f"SELECT id, CASE status WHEN 'active' THEN 'ok' WHEN 'suspended' THEN 'read_only' ELSE 'not_found' END AS access FROM {BASES} WHERE id = '7' OR slug = 'france'")
def database_resolve(spark, sf_dir):
    bases = _bases(spark, sf_dir)
    return analytics.resolve(bases, "id:7").unionByName(analytics.resolve(bases, "france")).select("id", "access")


@named(f"SELECT id, coalesce(slug, 'new-' || id) AS slug FROM {BASES}")
def slug_once(spark, sf_dir):
    bases = _bases(spark, sf_dir)
    return analytics.set_slug_once(bases, bases.select("id", F.concat(F.lit("new-"), "id").alias("slug"))).select("id", "slug")


@named("SELECT event_id, event_type AS level FROM events WHERE event_type IN ('purchase', 'error')")
def level_filter(spark, sf_dir):
    e = tables.read(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("level"))
    return analytics.at_least(e, "purchase", ("view", "click", "signup", "purchase", "error"))


@named("SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'create' WHEN event_id % 100 < 25 THEN 'read' WHEN event_id % 100 < 75 THEN 'update' ELSE 'delete' END AS op FROM events")
def choose_operation(spark, sf_dir):
    e = tables.read(spark, sf_dir, "events")
    return analytics.chosen(e, [("read", 1.0), ("update", 2.0), ("delete", 1.0)], F.col("event_id") % 100 / 100, F.col("event_id") % 10 != 0).select("event_id", "op")


# ------------------------------------------------------------------ indexes

SERVING = [indexes.Template("orders", (Order("status"), Order("total", "desc")), "status_total"), indexes.Template("orders", (Order("priority"),), "priority"), indexes.Template("{any}", (Order("status"),), "loose")]


@named(f"SELECT doc_id, total, version FROM {ORDERS} WHERE NOT deleted AND status = 'O' AND total < 150000 ORDER BY total DESC, doc_id LIMIT 120")
def index_serve(spark, sf_dir):
    q = Query("orders", (Filter("status", "==", "O"), Filter("total", "<", 150000)), (Order("total", "desc"),), 120)
    return indexes.serve(tables.orders_docs(spark, sf_dir), q, SERVING).select("doc_id", F.col("data.total").alias("total"), "version")


PLANS = {
    "equal": Query("orders", (Filter("status", "==", "O"),)),
    "ordered": Query("orders", (Filter("status", "==", "O"),), (Order("total", "desc"),)),
    "other": Query("customers", (Filter("status", "==", "O"),)),
    "unserved": Query("orders", (Filter("custkey", ">", 3),)),
    "ids": Query("orders", (Filter("id", "in", ["1", "2"]),)),
    "all": Query("orders"),
}


@named(literal_rows([("equal", "indexed", "status_total", 13), ("ordered", "indexed", "status_total", 17), ("other", "indexed", "loose", 14), ("unserved", "indexed", None, 0), ("ids", "ids", "priority", 3), ("all", "scan", "priority", 3)], "name, route, template, score"))
def index_explain(spark, sf_dir):
    rows = [(n, *(indexes.explain(q, SERVING)[k] for k in ("route", "template", "score"))) for n, q in PLANS.items()]
    return spark.createDataFrame(rows, "name string, route string, template string, score int")


@named("SELECT c_custkey, CAST(row_number() OVER (ORDER BY c_nationkey, c_acctbal DESC, c_name, CAST(c_custkey AS VARCHAR)) AS INTEGER) AS place FROM customer")
def order_key(spark, sf_dir):
    """Order by the bytes of index keys is order by the values."""
    c = tables.read(spark, sf_dir, "customer")
    key = indexes.order_key([(F.col("c_nationkey"), "number", "asc"), (F.col("c_acctbal"), "number", "desc"), (F.col("c_name"), "string", "asc")], F.col("c_custkey").cast("string"))
    return numbered(c.select("c_custkey", key.alias("key")), [], [F.col("key")], "place").select("c_custkey", F.col("place").cast("int"))


# ------------------------------------------------------------ access, rules

DATABASE_RULES = {"default": rules.rules_from({"customers/{cust}/orders/{id}": {"allow": {"get": "request.auth.uid == cust", "update": "request.auth.uid == cust && resource.data.total < 100000.0 && request.resource.data.total > 0.0"}}})}


@named("SELECT fullpath, action, CASE WHEN o_orderkey % 5 = 0 OR o_orderkey % 7 = 0 THEN TRUE WHEN o_orderkey % 2 = 1 THEN FALSE WHEN action = 'get' THEN TRUE ELSE o_totalprice < 100000 AND o_orderkey % 4 <> 0 END AS allowed FROM (SELECT *, 'customers/' || o_custkey || '/orders/' || o_orderkey AS fullpath, CASE WHEN o_orderkey % 3 = 0 THEN 'get' ELSE 'update' END AS action FROM orders)")
def authorize(spark, sf_dir):
    """Owners and named administrators pass; others as the rules say."""
    store = tables.customer_orders(spark, sf_dir)
    k = F.col("doc_id").cast("long")
    uid = F.when(k % 5 == 0, "boss").when(k % 2 == 0, F.split("fullpath", "/")[1]).otherwise(F.lit("nobody"))
    body = F.struct(F.when(k % 4 != 0, 1.0).otherwise(-1.0).alias("total"))
    admins = F.when(k % 7 == 0, F.array(F.lit("x"), F.lit("main-db"))).when(k % 3 == 0, F.array(F.lit("other")))
    asked = store.select("database", F.col("fullpath").alias("path"), F.when(k % 3 == 0, "get").otherwise("update").alias("action"), uid.alias("uid"), admins.alias("db_admin"), body.alias("body"))
    owned = spark.createDataFrame([("default", "main-db", "boss"), ("2", "other", "nobody")], "id string, slug string, owner string")
    found = rules.authorized(rules.assembled(asked, owned, store), DATABASE_RULES, ("get", "update"))
    return found.select(F.col("path").alias("fullpath"), "action", "allowed")


RULE_FILE = """
match:
  customers/{cust}/orders/{id}:
    allow:
      read: request.auth.uid == cust
"""


@named("SELECT 'customers/' || o_custkey || '/orders/' || o_orderkey AS fullpath, o_orderkey % 2 = 0 AS may_get, FALSE AS may_update FROM orders")
def rule_file(spark, sf_dir):
    r = _requests(spark, sf_dir)
    its = config.load_rules(RULE_FILE)
    names = {"request": (F.col("request"), r.schema["request"].dataType)}
    return r.select("fullpath", *[rules.allowed(F.col("fullpath"), a, its, names).alias(f"may_{a}") for a in ("get", "update")])


@named(f"SELECT i AS version FROM {LOG} WHERE op <> 'delete' AND value > 50 AND i % 3 = 0")
def trigger_before(spark, sf_dir):
    """A condition over the document before the change."""
    log = cdc.typed(log_of(spark, sf_dir), F.lit(False))
    events = log.select("database", "collection", "doc_id", "type", "ts_ms", F.col("i").alias("version"), F.struct("value", "op").alias("data"), F.struct((F.col("i") % 3).alias("rest")).alias("before"))
    return rules.fire(events, [Trigger("moved", ("create", "update"), "users", condition="event.before.rest == 0 && event.document.value > 50.0")]).select("version")


FILTERS = {"range": (Filter("total", ">", 5), Filter("status", "==", "F")), "in": (Filter("status", "in", ["F", 'a"b']),), "contains": (Filter("tags", "contains", "x"),), "none": ()}


@named(literal_rows([("range", 'doc.total > 5 && doc.status == "F"'), ("in", 'doc.status in ["F", "a\\"b"]'), ("contains", '"x" in doc.tags'), ("none", "true")], "name, text"))
def filter_text(spark, sf_dir):
    return spark.createDataFrame([(n, filters_to_cel(f)) for n, f in FILTERS.items()], "name string, text string")


@named(literal_rows([("total", 3), ("exact", 2), ("expressions", 1), ("gateways", 2), ("after_drop", 1)], "name, n"))
def subscription_counts(spark, sf_dir):
    r = rules.Registry()
    for s in (rules.Subscription("a", "g1", "orders"), rules.Subscription("b", "g1", "orders", (Filter("id", "==", "7"),)), rules.Subscription("c", "g2", "orders", (Filter("total", ">", 7),))):
        r.subscribe(s)
    rows = list(rules.subscription_stats(r.all()).items())
    r.drop_gateway("g1")
    return spark.createDataFrame([*rows, ("after_drop", len(r.all()))], "name string, n int")


def _fault(work) -> str:
    try:
        work()
        return "ok"
    except EngineError as e:
        return e.status
    except CelError:
        return "bad_expression"


CHECKS = {
    "limit": lambda: Query("orders", limit=1001).validate(),
    "path": lambda: Query("orders/1").validate(),
    "field": lambda: Query("orders", (Filter("a-b", "==", 1),)).validate(),
    "operator": lambda: Query("orders", (Filter("a", "~", 1),)).validate(),
    "in_scalar": lambda: Query("orders", (Filter("a", "in", 1),)).validate(),
    "order": lambda: Query("orders", order_by=(Order("a", "up"),)).validate(),
    "good": lambda: Query("orders", (Filter("a.b", "in", [1]),), (Order("a", "desc"),), 1000).validate(),
    "json": lambda: Query.from_json('{"collection": "orders", "filters": [{"field": "a", "op": "==", "value": 1}], "orderBy": [{"field": "a"}], "limit": 5}'),
    "has_any": lambda: compile_condition("hasAny(doc.a, doc.b)", {}),
    "trigger_id": lambda: rules.check_trigger(Trigger("a b", ("create",), "users")),
    "trigger_event": lambda: rules.check_trigger(Trigger("a", ("upsert",), "users")),
    "trigger_url": lambda: rules.check_trigger(Trigger("a", ("create",), "users", url="ftp://x")),
    "trigger_good": lambda: rules.check_trigger(TRIGGERS[0]),
    "duplicate": lambda: [r.subscribe(rules.Subscription("a", "g", "c")) for r in [rules.Registry()] for _ in range(2)],
    "unknown": lambda: rules.Registry().unsubscribe("a"),
    "no_state": lambda: indexes.set_state(None, None, "lost"),
    "templates": lambda: indexes.load("- collectionPattern: a//b\n  fields: [{field: x}]"),
    "templates_good": lambda: indexes.load("- collectionPattern: a/{b}/c\n  fields: [{field: x, order: desc}]"),
}
FAULTS = {"good": "ok", "json": "ok", "trigger_good": "ok", "templates_good": "ok", "has_any": "bad_expression", "duplicate": "exists", "unknown": "not_found"}


@named(literal_rows([(n, FAULTS.get(n, "invalid_query")) for n in CHECKS], "name, fault"))
def validation(spark, sf_dir):
    """What is refused, and as what."""
    return spark.createDataFrame([(n, _fault(c)) for n, c in CHECKS.items()], "name string, fault string")


@named(literal_rows([("AlreadyExists", "exists"), ("IndexNotReady", "index_not_ready"), ("InvalidQuery", "invalid_query"), ("NotFound", "not_found"), ("PermissionDenied", "permission_denied"), ("PreconditionFailed", "precondition_failed")], "name, status"))
def error_kinds(spark, sf_dir):
    kinds = (AlreadyExists, IndexNotReady, InvalidQuery, NotFound, PermissionDenied, PreconditionFailed)
    return spark.createDataFrame([(k.__name__, k.status) for k in kinds], "name string, status string")


TRIGGER_FILE = """
database: main
retryPolicy: {maxAttempts: 4, initialBackoff: 1m30s}
triggers:
  - {id: one, events: [create], collection: users, url: "http://x/y", timeout: 250ms}
  - {id: two, events: [update, delete], collection: "users/*", url: "https://x/y", retryPolicy: {maxBackoff: 2s}}
"""


@named(literal_rows([("one", "main", "create", 4, 90000, 60000, 250), ("two", "main", "update,delete", 4, 90000, 2000, 5000)], "id, database, events, attempts, initial_ms, max_ms, timeout_ms"))
def trigger_file(spark, sf_dir):
    rows = [(t.id, t.database, ",".join(t.events), t.retry.max_attempts, t.retry.initial_ms, t.retry.max_ms, t.timeout_ms) for t in config.load_triggers(TRIGGER_FILE)]
    return spark.createDataFrame(rows, "id string, database string, events string, attempts int, initial_ms int, max_ms int, timeout_ms int")


@named(literal_rows([(0, "closed"), (1, "closed"), (2, "open"), (3, "open"), (4, "half_open"), (5, "open"), (6, "half_open"), (7, "closed")], "step, state"))
def breaker_states(spark, sf_dir):
    """Two failures open it; a failure while half open does so again; a success closes it."""
    b, out = cdc.CircuitBreaker(2, 100), []
    for step, (now, ok) in enumerate([(0, True), (10, False), (20, False), (50, None), (130, None), (130, False), (250, None), (250, True)]):
        if ok is not None:
            b.record(ok, now)
        out.append((step, b.state(now)))
    return spark.createDataFrame(out, "step int, state string")


# ----------------------------------------------------------------- flagship

BATCHED = f"(SELECT doc_id, e.op AS op, e.value AS value, e.i AS i FROM (SELECT backend, batch, doc_id, {FOLD} AS e FROM (SELECT *, CAST((row_number() OVER (PARTITION BY backend ORDER BY t, i) - 1) // 100 AS BIGINT) AS batch FROM {LOG}) GROUP BY backend, batch, doc_id) WHERE NOT e.none)"
TYPED_BATCHES = f"(SELECT *, CASE WHEN op IN ('insert', 'replace') THEN 'create' ELSE 'update' END AS type FROM {BATCHED} WHERE op <> 'delete')"
SQL["flagship"] = f"SELECT i AS version, doc_id, type, trigger_id, 'default.users.' || replace(replace(rtrim(base64(encode(doc_id)), '='), '+', '-'), '/', '_') AS subject, max_attempts FROM (SELECT *, 'high' AS trigger_id, 3 AS max_attempts FROM {TYPED_BATCHES} WHERE value > 50 UNION ALL SELECT *, 'made', 5 FROM {TYPED_BATCHES} WHERE type = 'create' UNION ALL SELECT *, 'odd', 3 FROM {TYPED_BATCHES} WHERE type = 'update' AND i % 2 = 1 AND doc_id IN ('1', '2', '3'))"
assert set(SQL) <= set(QUERIES)
