"""Named queries over the driver's tables, each with equivalent SQL where SQL has it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import paths
from .functions.cel import Compiler, Value, compile_condition
from .functions.fields import Fields
from .model import Filter, Order, Query, Retry, Trigger, encode_cursor
from .operators import analytics, cdc, query, rules, writes
from .plans import indexes
from .plans.ordered import numbered
from .sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def named(sql: str = "", name: str = ""):
    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            SQL[key] = " ".join(sql.split())
        return f

    return add


NOW = 1_800_000_000_000
ORDERS = "(SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, o_orderkey, o_custkey AS custkey, o_orderstatus AS status, o_totalprice AS total, o_orderpriority AS priority, o_orderkey % 10 = 0 AS deleted, CAST(1 + o_orderkey % 3 AS BIGINT) AS version, epoch_us(o_orderdate) // 1000 AS updated_at FROM orders)"
LOG = "(SELECT 'b' || CAST(event_id % 2 AS VARCHAR) AS backend, epoch_us(ts) // 1000000 AS t, event_id AS i, CASE event_type WHEN 'signup' THEN 'insert' WHEN 'view' THEN 'update' WHEN 'click' THEN 'update' WHEN 'purchase' THEN 'replace' WHEN 'error' THEN 'delete' END AS op, CAST(user_id AS VARCHAR) AS doc_id, value, epoch_us(ts) // 1000 AS ts_ms FROM events)"


def shown(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.col("data.total").alias("total"), "version")


def orders_query(*filters: Filter, order: tuple[Order, ...] = (), limit: int = 0, after: str = "", deleted: bool = False):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        # The predicate alone, over the whole collection: a named query has no default limit.
        docs = tables.orders_docs(spark, sf_dir)
        if order or limit or after:
            return shown(query.execute(docs, Query("orders", filters, order, limit, after, deleted)))
        found = query.scan(docs, "default", "orders", deleted)
        test = Fields(docs).all(filters)
        return shown(found if test is None else found.where(test))

    return run


def simple(name: str, where: str, *filters: Filter, deleted: bool = False) -> None:
    live = "" if deleted else "NOT deleted AND "
    named(f"SELECT doc_id, total, version FROM {ORDERS} WHERE {live}{where}", name)(orders_query(*filters, deleted=deleted))


simple("filter_eq", "status = 'F'", Filter("status", "==", "F"))
simple("filter_ne", "status <> 'F'", Filter("status", "!=", "F"))
simple("filter_gt", "total > 300000", Filter("total", ">", 300000))
simple("filter_gte", "total >= 300000", Filter("total", ">=", 300000))
simple("filter_lt", "total < 50000", Filter("total", "<", 50000))
simple("filter_lte", "total <= 50000", Filter("total", "<=", 50000))
simple("filter_in", "status IN ('F', 'P')", Filter("status", "in", ["F", "P"]))
simple("id_in", "doc_id IN ('1', '5', '7', '10')", Filter("id", "in", ["1", "5", "7", "10"]))
simple("filter_and_range", "status = 'O' AND total >= 100000 AND total < 200000", Filter("status", "==", "O"), Filter("total", ">=", 100000), Filter("total", "<", 200000))
simple("filter_type_mismatch", "FALSE", Filter("total", ">", "a"))
simple("show_deleted", "status = 'F'", Filter("status", "==", "F"), deleted=True)
simple("live_only", "TRUE")


@named("SELECT CAST(p_partkey AS VARCHAR) AS doc_id, p_brand AS brand FROM part WHERE list_contains(string_split(p_name, ' '), 'cold')")
def filter_contains(spark, sf_dir):
    docs = tables.part_docs(spark, sf_dir)
    return docs.where(Fields(docs).predicate(Filter("tags", "contains", "cold"))).select("doc_id", F.col("data.brand").alias("brand"))


@named("SELECT CAST(event_id AS VARCHAR) AS doc_id FROM events WHERE CAST(json_extract_string(props, '$.k') AS DOUBLE) >= 50")
def filter_nested_json(spark, sf_dir):
    docs = tables.event_docs(spark, sf_dir)
    return docs.where(Fields(docs).predicate(Filter("k", ">=", 50))).select("doc_id")


named(f"SELECT doc_id, total, version FROM {ORDERS} WHERE NOT deleted ORDER BY status ASC NULLS FIRST, total DESC, doc_id LIMIT 500", "order_multi")(orders_query(order=(Order("status"), Order("total", "desc")), limit=500))
named(f"SELECT doc_id, total, version FROM {ORDERS} WHERE NOT deleted AND status = 'O' ORDER BY total DESC, doc_id LIMIT 20", "top_k")(orders_query(Filter("status", "==", "O"), order=(Order("total", "desc"),), limit=20))
named(f"SELECT doc_id, total, version FROM {ORDERS} WHERE NOT deleted AND (total > 150000 OR (total = 150000 AND doc_id > '5')) ORDER BY total, doc_id LIMIT 100", "keyset_asc")(orders_query(order=(Order("total"),), limit=100, after=encode_cursor([150000.0, "5"])))
named(f"SELECT doc_id, total, version FROM {ORDERS} WHERE NOT deleted AND (priority < '3-MEDIUM' OR (priority = '3-MEDIUM' AND doc_id > '300')) ORDER BY priority DESC, doc_id LIMIT 100", "keyset_desc_ties")(orders_query(order=(Order("priority", "desc"),), limit=100, after=encode_cursor(["3-MEDIUM", "300"])))


@named(f"SELECT doc_id, total, version FROM {ORDERS} WHERE NOT deleted AND doc_id = '7'")
def point_get(spark, sf_dir):
    return shown(query.get(tables.orders_docs(spark, sf_dir), "default", "orders/7"))


ASKED = ["orders/7", "orders/10", "orders/3", "orders/99999999", "orders/7"]


@named(f"SELECT CAST(p.pos AS INTEGER) AS pos, d.doc_id, d.total FROM (VALUES (0,'7'),(1,'10'),(2,'3'),(3,'99999999'),(4,'7')) p(pos, id) LEFT JOIN (SELECT * FROM {ORDERS} WHERE NOT deleted) d ON d.doc_id = p.id")
def multi_get(spark, sf_dir):
    return query.get_many(tables.orders_docs(spark, sf_dir), "default", ASKED).select("pos", "doc_id", F.col("data.total").alias("total"))


@named("SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, o_totalprice AS total FROM orders WHERE o_custkey = 7")
def subcollection_scan(spark, sf_dir):
    docs = tables.customer_orders(spark, sf_dir)
    return query.Collection(docs, "customers").collection("7", "orders").to_df().select("doc_id", F.col("data.total").alias("total"))


@named("SELECT 'default' AS database, 'customers/*/orders' AS collection_group, COUNT(*) AS docs, COUNT(DISTINCT o_custkey) AS collections FROM orders")
def collection_group_count(spark, sf_dir):
    return indexes.stats(tables.customer_orders(spark, sf_dir))


@named("SELECT DISTINCT 'customers/' || o_custkey || '/orders' AS collection FROM orders")
def distinct_collections(spark, sf_dir):
    return query.collections(tables.customer_orders(spark, sf_dir))


@named("SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), lower('ER#00000001'))")
def name_search(spark, sf_dir):
    return query.name_search(tables.read(spark, sf_dir, "customer"), "c_name", "ER#00000001").select("c_custkey", "c_name")


@named(f"SELECT doc_id, total, (SELECT COUNT(*) FROM {ORDERS} WHERE NOT deleted) > 50 AS has_more FROM {ORDERS} WHERE NOT deleted ORDER BY total, doc_id LIMIT 50")
def page_has_more(spark, sf_dir):
    docs = query.live(tables.orders_docs(spark, sf_dir)).select("doc_id", F.col("data.total").alias("total"))
    return query.has_more(docs, 50, [F.col("total").asc(), F.col("doc_id").asc()])


@named(f"SELECT 'orders/' || doc_id AS fullpath, doc_id AS id, status, CASE WHEN deleted THEN 'true' END AS deleted, CAST(version AS BIGINT) AS version FROM {ORDERS}")
def flatten_doc(spark, sf_dir):
    flat = query.flatten(tables.orders_docs(spark, sf_dir))
    j = F.col("document")
    return flat.select("fullpath", F.get_json_object(j, "$.id").alias("id"), F.get_json_object(j, "$.status").alias("status"), F.get_json_object(j, "$.deleted").alias("deleted"), F.get_json_object(j, "$.version").cast("long").alias("version"))


@named("SELECT page_id, regexp_matches(p, '^[A-Za-z0-9_.\\-]+(/[A-Za-z0-9_.\\-]+)*$') AND len(p) BETWEEN 1 AND 1024 AND len(string_split(p, '/')) % 2 = 1 AS is_collection FROM (SELECT page_id, substr(url, strpos(url, '://') + 3) AS p FROM pages)")
def path_validate(spark, sf_dir):
    p = F.expr("substring(url, instr(url, '://') + 3)")
    return tables.read(spark, sf_dir, "pages").select("page_id", paths.is_path(p, 1).alias("is_collection"))


@named(f"SELECT doc_id, CASE WHEN NOT deleted AND status = 'P' THEN 'X' ELSE status END AS status, version + CASE WHEN NOT deleted AND status = 'P' THEN 1 ELSE 0 END AS version FROM {ORDERS}")
def query_update(spark, sf_dir):
    done = query.update_where(tables.orders_docs(spark, sf_dir), Query("orders", (Filter("status", "==", "P"),)), {"status": "X"}, NOW)
    return done.select("doc_id", F.col("data.status").alias("status"), "version")


@named(f"SELECT doc_id, deleted OR total < 20000 AS deleted, version + CASE WHEN NOT deleted AND total < 20000 THEN 1 ELSE 0 END AS version FROM {ORDERS}")
def query_delete(spark, sf_dir):
    return query.delete_where(tables.orders_docs(spark, sf_dir), Query("orders", (Filter("total", "<", 20000),)), NOW).select("doc_id", "deleted", "version")


# ------------------------------------------------------------- indexes (E2)

TEMPLATES = [
    indexes.Template("customers/{c}/orders", (Order("status"),), "generic"),
    indexes.Template("customers/7/orders", (Order("status"),), "fixed"),
    indexes.Template("{a}/{b}/orders", (Order("total", "desc"),), "loose"),
    indexes.Template("users/{u}/chats", (Order("ts"),), "other"),
]
TEMPLATE_ROWS = "(VALUES ('generic', '^customers/[^/]+/orders$', 2, 3), ('fixed', '^customers/7/orders$', 3, 3), ('loose', '^[^/]+/[^/]+/orders$', 1, 3), ('other', '^users/[^/]+/chats$', 2, 3)) t(template, regex, fixed, parts)"
COLLECTIONS = "(SELECT DISTINCT 'customers/' || o_custkey || '/orders' AS collection FROM orders)"


def _matches(spark, sf_dir):
    return indexes.matches(tables.customer_orders(spark, sf_dir).select("collection").distinct(), TEMPLATES)


@named(f"SELECT collection, template, CAST(row_number() OVER (PARTITION BY collection ORDER BY fixed DESC, parts DESC, template) AS INTEGER) AS rank FROM {COLLECTIONS} JOIN {TEMPLATE_ROWS} ON regexp_matches(collection, regex)")
def template_match(spark, sf_dir):
    return _matches(spark, sf_dir).select("collection", "template", "rank")


@named(f"SELECT collection, template FROM {COLLECTIONS} JOIN {TEMPLATE_ROWS} ON regexp_matches(collection, regex) QUALIFY row_number() OVER (PARTITION BY collection ORDER BY fixed DESC, parts DESC, template) = 1")
def template_best(spark, sf_dir):
    return _matches(spark, sf_dir).where("rank = 1").select("collection", "template")


MIXED = "CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'true' WHEN 2 THEN CAST(user_id AS VARCHAR) ELSE '\"' || event_type || '\"' END"


@named("SELECT doc_id, CAST(row_number() OVER (ORDER BY tag, num NULLS FIRST, str NULLS FIRST, doc_id) AS INTEGER) AS place FROM (SELECT CAST(event_id AS VARCHAR) AS doc_id, CASE event_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END AS tag, CASE event_id % 4 WHEN 1 THEN 1.0 WHEN 2 THEN CAST(user_id AS DOUBLE) END AS num, CASE WHEN event_id % 4 = 3 THEN event_type END AS str FROM events)")
def sortkey_mixed(spark, sf_dir):
    value = F.expr("CASE event_id % 4 WHEN 0 THEN 'null' WHEN 1 THEN 'true' WHEN 2 THEN CAST(user_id AS STRING) ELSE concat('\"', event_type, '\"') END")
    e = tables.read(spark, sf_dir, "events")
    docs = tables.documents(e, F.lit("mixed"), F.col("event_id").cast("string"), F.parse_json(F.concat(F.lit('{"v":'), value, F.lit("}"))))
    keys = [k.alias(f"k{i}") for i, k in enumerate(Fields(docs).sort_keys("v"))]
    found = docs.select("doc_id", *keys)
    order = [F.col(f"k{i}") for i in range(len(keys))]
    return numbered(found, [], [*order, F.col("doc_id")], "place").select("doc_id", F.col("place").cast("int"))


named(f"SELECT doc_id, total, version FROM {ORDERS} WHERE NOT deleted AND status = 'F' AND total > 100000 AND total <= 200000 ORDER BY total DESC, doc_id LIMIT 200", "index_range_desc")(orders_query(Filter("status", "==", "F"), Filter("total", ">", 100000), Filter("total", "<=", 200000), order=(Order("total", "desc"),), limit=200))

PENDING = f"(SELECT doc_id, total * 2 AS total, CASE WHEN o_orderkey % 14 = 0 THEN 'delete' ELSE 'upsert' END AS op FROM {ORDERS} WHERE o_orderkey % 7 = 0)"


@named(f"SELECT doc_id, total FROM {ORDERS} WHERE doc_id NOT IN (SELECT doc_id FROM {PENDING}) UNION ALL SELECT doc_id, total FROM {PENDING} WHERE op <> 'delete'")
def lsm_merge_read(spark, sf_dir):
    base = tables.orders_docs(spark, sf_dir).select("doc_id", F.col("data.total").alias("total"))
    key = F.col("doc_id").cast("long")
    pending = base.where(key % 7 == 0).select("doc_id", (F.col("total") * 2).alias("total"), F.when(key % 14 == 0, "delete").otherwise("upsert").alias("op"))
    return indexes.merge_read(base, pending)


@named(f"SELECT doc_id, value, t, i FROM {LOG} QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY t DESC, i DESC) = 1")
def rebuild_latest(spark, sf_dir):
    return writes.latest(tables.change_log(spark, sf_dir), ["doc_id"], [F.col("t"), F.col("i")]).select("doc_id", "value", "t", "i")


@named("SELECT coalesce(d.name, a.name) AS name, CASE WHEN d.name IS NULL THEN 'delete' WHEN a.name IS NULL THEN 'create' WHEN a.state = 'failed' THEN 'rebuild' ELSE 'keep' END AS action FROM (SELECT CAST(n_nationkey AS VARCHAR) AS name FROM nation WHERE n_nationkey < 18) d FULL JOIN (SELECT CAST(n_nationkey AS VARCHAR) AS name, CASE WHEN n_nationkey % 5 = 0 THEN 'failed' ELSE 'healthy' END AS state FROM nation WHERE n_nationkey >= 6) a ON d.name = a.name")
def reconcile_diff(spark, sf_dir):
    n = tables.read(spark, sf_dir, "nation").withColumn("name", F.col("n_nationkey").cast("string"))
    actual = n.where("n_nationkey >= 6").select("name", F.when(F.col("n_nationkey") % 5 == 0, "failed").otherwise("healthy").alias("state"))
    return indexes.reconcile(n.where("n_nationkey < 18"), actual)


# -------------------------------------------------------------- writes (E3)

CHANGED = f"(SELECT 'orders/' || CAST(k AS VARCHAR) AS fullpath, k FROM (SELECT o_orderkey + 5 AS k FROM orders WHERE o_orderkey % 5 < 2))"
JOINED = f"{CHANGED} c LEFT JOIN {ORDERS} d ON c.fullpath = 'orders/' || d.doc_id"


def _changes(spark, sf_dir):
    o = tables.read(spark, sf_dir, "orders").where("o_orderkey % 5 < 2")
    return o.select(F.lit("default").alias("database"), F.concat(F.lit("orders/"), (F.col("o_orderkey") + 5).cast("string")).alias("fullpath"), (F.col("o_orderkey") + 5).alias("k"))


@named(f"SELECT fullpath, CASE WHEN d.doc_id IS NOT NULL AND NOT d.deleted THEN 'exists' ELSE 'created' END AS status, CAST(CASE WHEN d.doc_id IS NOT NULL AND NOT d.deleted THEN d.version ELSE 1 END AS BIGINT) AS version FROM {JOINED}")
def create_conflicts(spark, sf_dir):
    return writes.create(_changes(spark, sf_dir), tables.orders_docs(spark, sf_dir), NOW).select("fullpath", "status", "version")


@named(f"SELECT fullpath, CASE WHEN d.doc_id IS NULL OR d.deleted THEN 'created' ELSE 'replaced' END AS status, CAST(CASE WHEN d.doc_id IS NULL OR d.deleted THEN 1 ELSE d.version + 1 END AS BIGINT) AS version FROM {JOINED}")
def replace_apply(spark, sf_dir):
    return writes.replace(_changes(spark, sf_dir), tables.orders_docs(spark, sf_dir), NOW).select("fullpath", "status", "version")


@named(f"SELECT fullpath, CASE WHEN d.doc_id IS NULL THEN 'not_found' WHEN d.deleted THEN 'precondition_failed' ELSE 'updated' END AS status, CASE WHEN NOT d.deleted THEN 'Z' ELSE d.status END AS doc_status, d.version + CASE WHEN d.deleted THEN 0 ELSE 1 END AS version FROM {JOINED}")
def patch_apply(spark, sf_dir):
    changes = _changes(spark, sf_dir).withColumn("set", F.struct(F.lit("Z").alias("status")))
    return writes.patch(changes, tables.orders_docs(spark, sf_dir), ["status"], NOW).select("fullpath", "status", F.col("data.status").alias("doc_status"), "version")


@named(f"SELECT fullpath, CASE WHEN d.doc_id IS NULL OR d.deleted THEN 'not_found' ELSE 'deleted' END AS status, d.version + CASE WHEN d.deleted THEN 0 ELSE 1 END AS version, CASE WHEN NOT d.deleted THEN {NOW + writes.DAY_MS} END AS expires_at FROM {JOINED}")
def soft_delete(spark, sf_dir):
    return writes.delete(_changes(spark, sf_dir), tables.orders_docs(spark, sf_dir), NOW).select("fullpath", "status", "version", "expires_at")


@named(f"SELECT fullpath, CASE WHEN d.doc_id IS NULL THEN 'not_found' WHEN d.deleted OR d.version <> 2 THEN 'precondition_failed' ELSE 'updated' END AS status, d.version + CASE WHEN NOT d.deleted AND d.version = 2 THEN 1 ELSE 0 END AS version, CASE WHEN NOT d.deleted AND d.version = 2 THEN 'Z' ELSE d.status END AS doc_status FROM {JOINED}")
def cas_update(spark, sf_dir):
    changes = _changes(spark, sf_dir).withColumn("set", F.struct(F.lit("Z").alias("status")))
    found = writes.patch(changes, tables.orders_docs(spark, sf_dir), ["status"], NOW, F.col("cur_version") == 2)
    return found.select("fullpath", "status", "version", F.col("data.status").alias("doc_status"))


@named("SELECT event_id FROM events WHERE epoch_us(ts) // 1000 + value * 1000000 > 1705000000000")
def ttl_purge(spark, sf_dir):
    e = tables.read(spark, sf_dir, "events").select("event_id", (F.expr("unix_millis(cast(ts as timestamp))") + F.col("value") * 1000000).alias("expires_at"))
    return writes.purge_expired(e, 1705000000000).select("event_id")


PULL_FROM = 800_000_000_000


@named(f"SELECT doc_id, updated_at, deleted FROM {ORDERS} WHERE updated_at >= {PULL_FROM} ORDER BY updated_at, doc_id LIMIT 300")
def pull_page(spark, sf_dir):
    return writes.pull(tables.orders_docs(spark, sf_dir), "default", "orders", PULL_FROM, 300).select("doc_id", "updated_at", "deleted")


@named(f"SELECT coalesce(max(updated_at), {PULL_FROM}) AS checkpoint FROM (SELECT * FROM {ORDERS} WHERE updated_at >= {PULL_FROM} ORDER BY updated_at, doc_id LIMIT 300)")
def pull_checkpoint(spark, sf_dir):
    return writes.checkpoint(writes.pull(tables.orders_docs(spark, sf_dir), "default", "orders", PULL_FROM, 300), PULL_FROM)


OUTCOME = "CASE WHEN k % 3 = 0 THEN CASE WHEN d.doc_id IS NULL OR d.deleted THEN 'noop' WHEN k % 4 <> d.version THEN 'conflict' ELSE 'delete' END WHEN d.doc_id IS NULL OR d.deleted THEN 'create' WHEN k % 4 <> d.version THEN 'conflict' ELSE 'update' END"


def _pushes(spark, sf_dir):
    k = F.col("k")
    data = F.struct(k.alias("custkey"), F.lit("N").alias("status"), k.cast("double").alias("total"), F.lit("-").alias("priority"))
    return _changes(spark, sf_dir).withColumns({"action": F.when(k % 3 == 0, "delete").otherwise("update"), "base_version": k % 4, "data": data})


def _pushed(spark, sf_dir):
    return writes.push(_pushes(spark, sf_dir), tables.orders_docs(spark, sf_dir))


@named(f"SELECT fullpath, {OUTCOME} AS outcome, d.version AS server_version FROM {JOINED}")
def push_classify(spark, sf_dir):
    return _pushed(spark, sf_dir).select("fullpath", "outcome", F.col("cur_version").alias("server_version"))


@named(f"SELECT outcome, COUNT(*) AS n FROM (SELECT {OUTCOME} AS outcome FROM {JOINED}) GROUP BY outcome")
def push_apply(spark, sf_dir):
    outcomes, _ = writes.push_apply(_pushes(spark, sf_dir), tables.orders_docs(spark, sf_dir), NOW)
    return outcomes.groupBy("outcome").agg(F.count("*").alias("n"))


@named("WITH RECURSIVE o AS (SELECT user_id, CASE event_type WHEN 'signup' THEN 'create' WHEN 'error' THEN 'delete' WHEN 'view' THEN 'update' ELSE 'replace' END AS op, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events), f AS (SELECT user_id, CAST(0 AS BIGINT) AS n, FALSE AS live, CAST(0 AS BIGINT) AS version, CAST(0 AS BIGINT) AS applied FROM (SELECT DISTINCT user_id FROM events) UNION ALL SELECT f.user_id, f.n + 1, CASE WHEN o.op = 'create' THEN TRUE WHEN o.op = 'replace' THEN TRUE WHEN NOT f.live THEN FALSE ELSE o.op <> 'delete' END, CASE WHEN o.op = 'create' THEN CASE WHEN f.live THEN f.version ELSE 1 END WHEN o.op = 'replace' OR f.live THEN f.version + 1 ELSE f.version END, f.applied + CASE WHEN o.op = 'create' THEN CASE WHEN f.live THEN 0 ELSE 1 END WHEN o.op = 'replace' OR f.live THEN 1 ELSE 0 END FROM f JOIN o ON o.user_id = f.user_id AND o.n = f.n + 1) SELECT CAST(user_id AS VARCHAR) AS doc, live, version, applied FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC) = 1")
def batch_write(spark, sf_dir):
    e = tables.read(spark, sf_dir, "events")
    op = F.when(F.col("event_type") == "signup", "create").when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "view", "update").otherwise("replace")
    ops = e.select(F.lit("default").alias("database"), F.col("user_id").cast("string").alias("fullpath"), F.struct("ts", "event_id").alias("seq"), op.alias("op"), F.struct("value").alias("data"))
    empty = ops.select("database", "fullpath", F.lit(False).alias("deleted"), F.lit(0).cast("long").alias("version"), "data").limit(0)
    return writes.batch(ops, empty).select(F.col("fullpath").alias("doc"), "live", "version", "applied")


# ---------------------------------------------------------- change log (E4)


@named(f"SELECT i, t || '-' || i || '-' || substr(sha256('users/' || doc_id), 1, 16) AS event_id FROM {LOG}")
def event_id(spark, sf_dir):
    return cdc.normalize(tables.change_log(spark, sf_dir))[0].select("i", "event_id")


@named(f"SELECT backend, t, i, CAST(row_number() OVER (ORDER BY t, i, backend) AS INTEGER) AS place FROM {LOG}")
def merge_order(spark, sf_dir):
    log = tables.change_log(spark, sf_dir)
    both = cdc.merged(log.where("backend = 'b0'"), log.where("backend = 'b1'"))
    return numbered(both.select("backend", "t", "i"), [], [F.col("t"), F.col("i"), F.col("backend")], "place").withColumn("place", F.col("place").cast("int"))


FOLD = "list_reduce(list({{'op': op, 'value': value, 'i': i, 'none': FALSE}} ORDER BY t, i), lambda a, e: CASE WHEN a.none THEN e WHEN a.op = 'insert' AND e.op = 'delete' THEN {{'op': e.op, 'value': e.value, 'i': e.i, 'none': TRUE}} WHEN a.op = 'insert' AND e.op IN ('update', 'replace') THEN {{'op': 'insert', 'value': e.value, 'i': e.i, 'none': FALSE}} ELSE e END)".format()


@named(f"SELECT doc_id, e.op AS op, e.value AS value, e.i AS i FROM (SELECT doc_id, {FOLD} AS e FROM {LOG} GROUP BY doc_id) WHERE NOT e.none")
def coalesce_all(spark, sf_dir):
    return cdc.coalesce(tables.change_log(spark, sf_dir)).select("doc_id", "op", "value", "i")


@named(f"SELECT backend, batch, doc_id, e.op AS op, e.value AS value, e.i AS i FROM (SELECT backend, batch, doc_id, {FOLD} AS e FROM (SELECT *, CAST((row_number() OVER (PARTITION BY backend ORDER BY t, i) - 1) // 100 AS BIGINT) AS batch FROM {LOG}) GROUP BY backend, batch, doc_id) WHERE NOT e.none")
def coalesce_batch100(spark, sf_dir):
    return cdc.coalesce_batches(tables.change_log(spark, sf_dir)).select("backend", "batch", "doc_id", "op", "value", "i")


@named(f"SELECT backend, i, gap_ms FROM (SELECT backend, i, ts_ms - lag(ts_ms) OVER (PARTITION BY backend ORDER BY t, i) AS gap_ms FROM {LOG}) WHERE gap_ms >= {cdc.GAP_MS}")
def gap_detect(spark, sf_dir):
    return cdc.gaps(tables.change_log(spark, sf_dir)).select("backend", "i", "gap_ms")


@named(f"SELECT backend, i FROM (SELECT backend, i, t, max(t * 1000000000 + i) OVER (PARTITION BY backend ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM (SELECT *, i * 7919 % 100003 + i / 1e9 AS arrival FROM {LOG})) WHERE seen IS NULL OR t * 1000000000 + i > seen")
def subscriber_dedup(spark, sf_dir):
    log = tables.change_log(spark, sf_dir).withColumn("arrival", F.col("i") * 7919 % 100003 + F.col("i") / 1e9)
    return cdc.unseen(log).select("backend", "i")


@named(f"SELECT backend, i FROM {LOG} WHERE NOT (backend = 'b0' AND (t < 1704500000 OR (t = 1704500000 AND i <= 100)))")
def replay_after_marker(spark, sf_dir):
    return cdc.replay(tables.change_log(spark, sf_dir), {"b0": (1704500000, 100)}).select("backend", "i")


@named(f"SELECT backend, t, i FROM {LOG} QUALIFY row_number() OVER (PARTITION BY backend ORDER BY t DESC, i DESC) = 1")
def progress_marker(spark, sf_dir):
    return cdc.progress(tables.change_log(spark, sf_dir))


@named(f"SELECT i, ts_ms FROM {LOG} WHERE ts_ms >= 1705000000000 - {cdc.RETENTION_MS}")
def retention_cutoff(spark, sf_dir):
    return cdc.retained(tables.change_log(spark, sf_dir), 1705000000000).select("i", "ts_ms")


@named(f"SELECT i, CAST(kept AS BIGINT) AS kept_size FROM (SELECT i, sum(100 + i % 50) OVER (PARTITION BY backend ORDER BY t DESC, i DESC ROWS UNBOUNDED PRECEDING) AS kept FROM {LOG}) WHERE kept <= 20000")
def retention_size(spark, sf_dir):
    return cdc.retained_size(tables.change_log(spark, sf_dir), 100 + F.col("i") % 50, 20000).select("i", "kept_size")


@named(f"SELECT i, CASE WHEN value < 10 THEN 'delete' WHEN op IN ('insert', 'replace') THEN 'create' ELSE 'update' END AS type FROM {LOG} WHERE op <> 'delete'")
def transform_typed(spark, sf_dir):
    return cdc.typed(tables.change_log(spark, sf_dir), F.col("value") < 10).select("i", "type")


@named(f"SELECT CASE max(CASE WHEN doc_id = '1' THEN 2 WHEN op = 'delete' THEN 1 ELSE 0 END) WHEN 2 THEN 'unhealthy' WHEN 1 THEN 'degraded' ELSE 'healthy' END AS status, COUNT(*) AS backends FROM {LOG}")
def health_rollup(spark, sf_dir):
    s = tables.change_log(spark, sf_dir).select(F.when(F.col("doc_id") == "1", "unhealthy").when(F.col("op") == "delete", "degraded").otherwise("healthy").alias("status"))
    return cdc.health(s)


@named("SELECT event_id, CASE WHEN value < 100 THEN 'none' WHEN value < 500 THEN 'slow_down' ELSE 'pause' END AS pressure FROM events")
def backpressure(spark, sf_dir):
    return tables.read(spark, sf_dir, "events").select("event_id", cdc.pressure(F.col("value")).alias("pressure"))


# --------------------------------------------------------------- rules (E5)

SUBSCRIPTIONS = [
    rules.Subscription("doc7", "g1", "orders", (Filter("id", "==", "7"),)),
    rules.Subscription("all", "g1", "orders", include_data=False),
    rules.Subscription("big", "g2", "orders", (Filter("total", ">", 250000),)),
    rules.Subscription("final", "g2", "orders", (Filter("status", "==", "F"), Filter("priority", "in", ["1-URGENT", "2-HIGH"]))),
    rules.Subscription("elsewhere", "g3", "customers", ()),
]
SUBSCRIBED = f"(SELECT doc_id, total, 'g1' AS gateway, 'doc7' AS subscription_id FROM {ORDERS} WHERE doc_id = '7' UNION ALL SELECT doc_id, NULL, 'g1', 'all' FROM {ORDERS} UNION ALL SELECT doc_id, total, 'g2', 'big' FROM {ORDERS} WHERE total > 250000 UNION ALL SELECT doc_id, total, 'g2', 'final' FROM {ORDERS} WHERE status = 'F' AND priority IN ('1-URGENT', '2-HIGH'))"


@named(f"SELECT doc_id, gateway, subscription_id, total FROM {SUBSCRIBED}")
def sub_expr(spark, sf_dir):
    found = rules.deliver(rules.match(tables.orders_docs(spark, sf_dir), SUBSCRIPTIONS))
    return found.select("doc_id", "gateway", "subscription_id", F.col("data.total").alias("total"))


@named(f"SELECT doc_id, gateway, array_to_string(list_sort(list(subscription_id)), ',') AS subscription_ids FROM {SUBSCRIBED} GROUP BY doc_id, gateway")
def sub_fanout(spark, sf_dir):
    found = rules.fan_out(rules.match(tables.orders_docs(spark, sf_dir), SUBSCRIPTIONS), "doc_id")
    return found.select("doc_id", "gateway", F.array_join("subscription_ids", ",").alias("subscription_ids"))


KEYS = "(SELECT 's' || n_nationkey AS sub, CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE CAST(n_nationkey * 3 AS VARCHAR) END AS doc_id FROM nation)"


def _keys(spark, sf_dir):
    n = tables.read(spark, sf_dir, "nation")
    return n.select(F.lit("default").alias("database"), F.lit("orders").alias("collection"), F.when(F.col("n_nationkey") % 5 != 0, (F.col("n_nationkey") * 3).cast("string")).alias("doc_id"), F.concat(F.lit("s"), F.col("n_nationkey").cast("string")).alias("sub"))


@named(f"SELECT d.doc_id, k.sub FROM {ORDERS} d JOIN {KEYS} k ON k.doc_id = d.doc_id")
def sub_exact(spark, sf_dir):
    return rules.match_keys(tables.orders_docs(spark, sf_dir), _keys(spark, sf_dir).where("doc_id is not null")).select("doc_id", "sub")


@named(f"SELECT d.doc_id, k.sub FROM {ORDERS} d JOIN {KEYS} k ON k.doc_id IS NULL")
def sub_collection(spark, sf_dir):
    return rules.match_keys(tables.orders_docs(spark, sf_dir), _keys(spark, sf_dir).where("doc_id is null")).select("doc_id", "sub")


def _typed_events(spark, sf_dir):
    log = cdc.typed(tables.change_log(spark, sf_dir), F.lit(False))
    return log.select("database", "collection", "doc_id", "type", "ts_ms", F.col("i").alias("version"), F.struct("value", "op").alias("data"))


TRIGGERS = [
    Trigger("high", ("create", "update"), "users", condition="event.document.value > 50.0 && event.type != 'delete'"),
    Trigger("made", ("create",), "u*", retry=Retry(5, 100, 1000)),
    Trigger("nested", ("create", "update"), "users/*"),
    Trigger("odd", ("update",), "user?", condition="event.document.version % 2 == 1 && (event.document.id in ['1', '2', '3'] || event.document.missing > 3)"),
]
TYPED = f"(SELECT *, CASE WHEN op IN ('insert', 'replace') THEN 'create' ELSE 'update' END AS type FROM {LOG} WHERE op <> 'delete')"
FIRED = f"(SELECT i, doc_id, ts_ms, 'high' AS trigger_id, 3 AS max_attempts, 1000 AS initial_ms, 60000 AS max_ms FROM {TYPED} WHERE value > 50 UNION ALL SELECT i, doc_id, ts_ms, 'made', 5, 100, 1000 FROM {TYPED} WHERE type = 'create' UNION ALL SELECT i, doc_id, ts_ms, 'odd', 3, 1000, 60000 FROM {TYPED} WHERE type = 'update' AND i % 2 = 1 AND doc_id IN ('1', '2', '3'))"


@named(f"SELECT i AS version, trigger_id FROM {FIRED}")
def trigger_match(spark, sf_dir):
    return rules.fire(_typed_events(spark, sf_dir), TRIGGERS).select("version", "trigger_id")


GLOBS = {"any": "customers/*/orders", "one": "customers/?/orders", "class": "customers/[1-3]*/orders", "flat": "*"}


@named(f"SELECT collection, regexp_matches(collection, '^customers/[^/]*/orders$') AS g_any, regexp_matches(collection, '^customers/[^/]/orders$') AS g_one, regexp_matches(collection, '^customers/[1-3][^/]*/orders$') AS g_class, regexp_matches(collection, '^[^/]*$') AS g_flat FROM {COLLECTIONS}")
def trigger_glob(spark, sf_dir):
    c = tables.customer_orders(spark, sf_dir).select("collection").distinct()
    return c.select("collection", *[F.col("collection").rlike(paths.glob_regex(g)).alias(f"g_{n}") for n, g in GLOBS.items()])


@named(f"SELECT i AS version, trigger_id, max_attempts, 'default.users.' || replace(replace(rtrim(base64(encode(doc_id)), '='), '+', '-'), '/', '_') AS subject FROM {FIRED}")
def delivery_task(spark, sf_dir):
    return rules.fire(_typed_events(spark, sf_dir), TRIGGERS).select("version", "trigger_id", "max_attempts", "subject")


@named("SELECT c_custkey, 'db.customers.' || replace(replace(rtrim(base64(encode(c_name || '?>')), '='), '+', '-'), '/', '_') AS subject FROM customer")
def delivery_subject(spark, sf_dir):
    c = tables.read(spark, sf_dir, "customer")
    return c.select("c_custkey", rules.subject(F.lit("db"), F.lit("customers"), F.concat("c_name", F.lit("?>"))).alias("subject"))


@named(f"SELECT version, trigger_id, CAST(attempt AS INTEGER) AS attempt, CAST(CASE WHEN attempt = 1 THEN 0 ELSE least(initial_ms * pow(2, attempt - 2), max_ms) END AS BIGINT) AS delay_ms FROM (SELECT i AS version, trigger_id, initial_ms, max_ms, unnest(generate_series(1, max_attempts)) AS attempt FROM {FIRED})")
def retry_schedule(spark, sf_dir):
    return rules.schedule(rules.fire(_typed_events(spark, sf_dir), TRIGGERS)).select("version", "trigger_id", "attempt", "delay_ms")


@named("SELECT event_id, CASE WHEN code BETWEEN 200 AND 299 THEN 'done' WHEN code BETWEEN 400 AND 499 THEN 'fatal' WHEN attempt >= 3 THEN 'dead' ELSE 'retry' END AS outcome FROM (SELECT event_id, 200 + 100 * (event_id % 4) AS code, 1 + event_id % 3 AS attempt FROM events)")
def delivery_outcome(spark, sf_dir):
    e = tables.read(spark, sf_dir, "events")
    return e.select("event_id", rules.outcome(200 + 100 * (F.col("event_id") % 4), 1 + F.col("event_id") % 3, F.lit(3)).alias("outcome"))


@named("SELECT s, regexp_matches(s, '^orders\\.[^.]+\\.created$') AS one, regexp_matches(s, '^orders\\..+$') AS tail FROM (SELECT DISTINCT 'orders.' || o_orderstatus || '.' || CASE WHEN o_orderkey % 2 = 0 THEN 'created' ELSE 'x.created' END AS s FROM orders)")
def subject_match(spark, sf_dir):
    o = tables.read(spark, sf_dir, "orders")
    s = o.select(F.concat(F.lit("orders."), "o_orderstatus", F.lit("."), F.when(F.col("o_orderkey") % 2 == 0, "created").otherwise("x.created")).alias("s")).distinct()
    return s.select("s", F.col("s").rlike(paths.subject_regex("orders.*.created")).alias("one"), F.col("s").rlike(paths.subject_regex("orders.>")).alias("tail"))


RULES = rules.rules_from({"customers/{cust}/orders/{id}": {"allow": {"read": "request.auth.uid == cust", "write": "request.auth.uid == cust && resource.total < 100000.0"}}, "customers/7/orders/{id}": {"allow": {"get": "true"}}, "{rest=**}": {"allow": {"list": "true"}}})


def _requests(spark, sf_dir):
    docs = tables.customer_orders(spark, sf_dir)
    uid = F.when(F.col("doc_id").cast("long") % 2 == 0, F.split("fullpath", "/")[1]).otherwise(F.lit("nobody"))
    return docs.withColumn("request", F.struct(F.struct(uid.alias("uid")).alias("auth")))


@named("SELECT 'customers/' || o_custkey || '/orders/' || o_orderkey AS fullpath, CASE WHEN o_custkey = 7 THEN TRUE ELSE o_orderkey % 2 = 0 END AS may_get, CASE WHEN o_custkey = 7 THEN FALSE ELSE o_orderkey % 2 = 0 AND o_totalprice < 100000 END AS may_update, CASE WHEN o_custkey = 7 THEN FALSE ELSE o_orderkey % 2 = 0 END AS may_list FROM orders")
def rule_path_action(spark, sf_dir):
    r = _requests(spark, sf_dir)
    names = {"request": (F.col("request"), r.schema["request"].dataType), "resource": (F.col("data"), r.schema["data"].dataType)}
    return r.select("fullpath", *[rules.allowed(F.col("fullpath"), a, RULES, names).alias(f"may_{a}") for a in ("get", "update", "list")])


@named(f"SELECT 'orders/' || k AS fullpath, EXISTS (SELECT 1 FROM {ORDERS} d WHERE NOT d.deleted AND d.doc_id = CAST(k - 1 AS VARCHAR)) AS allowed FROM (SELECT o_orderkey + 1 AS k FROM orders)")
def rule_exists(spark, sf_dir):
    store = tables.orders_docs(spark, sf_dir)
    asked = store.select(F.concat(F.lit("orders/"), (F.col("doc_id").cast("long") + 1).cast("string")).alias("fullpath"))
    before = F.concat(F.lit("orders/"), (F.split("fullpath", "/")[1].cast("long") - 1).cast("string"))
    found = rules.with_existing(asked, store, before)
    ok = compile_condition("exists(before)", {"before": (F.col("found_path"), T.StringType())}, {"exists": lambda v: Value(v.column.isNotNull(), "bool")})
    return found.select("fullpath", ok.alias("allowed"))


@named(f"SELECT 'orders/' || (d.o_orderkey) AS fullpath, coalesce(p.total > 100000, FALSE) AS allowed FROM {ORDERS} d LEFT JOIN (SELECT * FROM {ORDERS} WHERE NOT deleted) p ON p.o_orderkey = d.o_orderkey - 1")
def rule_get(spark, sf_dir):
    store = tables.orders_docs(spark, sf_dir)
    before = F.concat(F.lit("orders/"), (F.split("fullpath", "/")[1].cast("long") - 1).cast("string"))
    found = rules.with_document(store.select("fullpath"), store, before)
    ok = compile_condition("resource.data.total > 100000.0", {"resource": (F.col("resource"), found.schema["resource"].dataType)})
    return found.select("fullpath", ok.alias("allowed"))


# ------------------------------------------------------ expressions (CEL)


def _cel(docs: DataFrame, **tests: str) -> list[Column]:
    c = Compiler({"doc": (F.col("data"), docs.schema["data"].dataType), "id": (F.col("doc_id"), T.StringType())})
    return [c.condition(t).alias(n) for n, t in tests.items()]


K = "CAST(json_extract_string(props, '$.k') AS DOUBLE)"


@named(f"SELECT CAST(event_id AS VARCHAR) AS doc_id, {K} > 50 AS a, TRUE AS b, FALSE AS c, {K} > 20 AND {K} <= 80 AS d, TRUE AS has_k, FALSE AS has_no FROM events")
def cel_kleene(spark, sf_dir):
    docs = tables.event_docs(spark, sf_dir)
    return docs.select("doc_id", *_cel(docs, a="doc.k > 50 || doc.no > 1", b="doc.no == 1 || true", c="doc.no == 1 && true", d="doc.k > 20 && !(doc.k > 80)", has_k="has(doc.k)", has_no="has(doc.no)"))


TAGS = "string_split(p_name, ' ')"


@named(f"SELECT CAST(p_partkey AS VARCHAR) AS doc_id, len(list_filter({TAGS}, lambda x: len(x) <= 3)) = 0 AS every_long, len(list_filter({TAGS}, lambda x: starts_with(x, 'c'))) > 0 AS some_c, len(list_filter({TAGS}, lambda x: x = 'cold')) = 1 AS one_cold, len({TAGS}) = 2 AS two, list_contains({TAGS}, 'widget') AS widget FROM part")
def cel_macros(spark, sf_dir):
    docs = tables.part_docs(spark, sf_dir)
    return docs.select("doc_id", *_cel(docs, every_long="doc.tags.all(t, size(t) > 3)", some_c="doc.tags.exists(t, t.startsWith('c'))", one_cold="doc.tags.exists_one(t, t == 'cold')", two="size(doc.tags.map(t, t + 'x').filter(t, t != '')) == 2", widget="'widget' in doc.tags"))


@named("SELECT CAST(turn AS VARCHAR) AS doc_id, conv_id, contains(text, 'the') AS has_the, ends_with(text, '.') AS stops, regexp_matches(text, '[0-9]{3}') AS digits, role = 'user' AS user, length(text) > 100 AS long FROM conversations")
def cel_strings(spark, sf_dir):
    docs = tables.messages(spark, sf_dir)
    return docs.select("doc_id", F.split("collection", "/")[1].cast("long").alias("conv_id"), *_cel(docs, has_the="doc.text.contains('the')", stops="doc.text.endsWith('.')", digits="doc.text.matches('[0-9]{3}')", user="doc.role == \"user\"", long="size(doc.text) > 100"))


@named("SELECT event_id, CAST(month(ts) - 1 AS BIGINT) AS month, CAST(dayofweek(ts) AS BIGINT) AS dow, CAST(hour(ts) AS BIGINT) AS hour, CAST(dayofyear(ts) - 1 AS BIGINT) AS doy, ts + INTERVAL 90 SECONDS > TIMESTAMP '2024-01-05 00:00:00' AS late FROM events")
def cel_time(spark, sf_dir):
    e = tables.read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    c = Compiler({"ts": (F.col("ts"), T.TimestampType())})
    values = {"month": "ts.getMonth()", "dow": "ts.getDayOfWeek()", "hour": "ts.getHours()", "doy": "ts.getDayOfYear()"}
    return e.select("event_id", *[c.value(t).alias(n) for n, t in values.items()], c.condition("ts + duration('90s') > timestamp('2024-01-05T00:00:00Z')").alias("late"))


@named("SELECT event_id, CAST(event_id // 7 AS BIGINT) AS quotient, CAST(event_id % 7 AS BIGINT) AS rest, CASE WHEN event_id % 2 = 0 THEN 'even' ELSE 'odd' END AS parity, CAST(floor(value) AS BIGINT) AS whole FROM events")
def cel_arithmetic(spark, sf_dir):
    e = tables.read(spark, sf_dir, "events")
    c = Compiler({"i": (F.col("event_id"), T.LongType()), "v": (F.col("value"), T.DoubleType())})
    values = {"quotient": "i / 7", "rest": "i % 7", "parity": "i % 2 == 0 ? 'even' : 'odd'", "whole": "int(v)"}
    return e.select("event_id", *[c.value(t).alias(n) for n, t in values.items()])


# ----------------------------------------------------------- analytics (E6)


@named("SELECT c_custkey AS owner, CAST(count(o_orderkey) AS BIGINT) AS used, 10 AS max_databases, count(o_orderkey) < 10 AS may_create FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def quota_usage(spark, sf_dir):
    owned = tables.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("owner"))
    limits = tables.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("owner"), F.lit(10).alias("max_databases"))
    return analytics.quota(owned, limits)


@named("SELECT o_orderkey, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS total FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 40")
def list_page_total(spark, sf_dir):
    o = tables.read(spark, sf_dir, "orders").where("o_orderstatus = 'O'")
    return analytics.list_page(o, [F.desc("o_orderdate"), F.asc("o_orderkey")], 20, 40).select("o_orderkey", "total")


@named("SELECT o_orderkey AS jti FROM orders WHERE o_orderkey NOT IN (SELECT event_id FROM events WHERE event_type = 'error' AND epoch_us(ts) // 1000 + 60000 <= 1705000000000 AND epoch_us(ts) // 1000 + 10000000000 > 1705000000000)")
def revoked_tokens(spark, sf_dir):
    at = F.expr("unix_millis(cast(ts as timestamp))")
    revoked = tables.read(spark, sf_dir, "events").where("event_type = 'error'").select(F.col("event_id").alias("jti"), at.alias("revoked_at"), (at + 10_000_000_000).alias("expires_at"))
    return analytics.not_revoked(tables.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("jti")), revoked, 1705000000000, 60000)


@named("SELECT user_id, ts_ms AS locked_from, ts_ms + 300000 AS locked_until FROM (SELECT *, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY user_id, run ORDER BY ts_ms, event_id) AS n FROM (SELECT user_id, event_id, epoch_us(ts) // 1000 AS ts_ms, event_type = 'purchase' AS ok, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id ROWS UNBOUNDED PRECEDING) AS run FROM events)) WHERE NOT ok AND n % 3 = 0")
def lockout(spark, sf_dir):
    e = tables.operation_results(spark, sf_dir).withColumn("success", F.col("op") == "purchase")
    return analytics.lockouts(e, 3)


RESULTS = "(SELECT event_type AS op, CAST(floor(value) AS BIGINT) AS latency_ms, event_type <> 'error' AS success FROM events)"
SUMMARY = "count(*) AS operations, CAST(sum(CASE WHEN success THEN 0 ELSE 1 END) AS BIGINT) AS errors, round(100 * avg(CASE WHEN success THEN 1.0 ELSE 0.0 END), 6) AS success_percent, round(count(*) / 300.0, 6) AS throughput, min(latency_ms) AS min, max(latency_ms) AS max, round(avg(latency_ms), 6) AS mean, " + ", ".join(f"list_sort(list(latency_ms))[least(CAST(floor(count(*) * {q}) AS BIGINT), count(*) - 1) + 1] AS {n}" for n, q in analytics.PERCENTILES.items())


@named(f"SELECT {SUMMARY} FROM {RESULTS}")
def latency_summary(spark, sf_dir):
    return analytics.latency_summary(tables.operation_results(spark, sf_dir), [], 300.0)


@named(f"SELECT op, {SUMMARY} FROM {RESULTS} GROUP BY op")
def latency_by_op(spark, sf_dir):
    return analytics.latency_summary(tables.operation_results(spark, sf_dir), ["op"], 300.0)


@named("SELECT 'E' || CAST(user_id % 5 AS VARCHAR) AS error, COUNT(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1")
def error_hist(spark, sf_dir):
    return analytics.error_histogram(tables.operation_results(spark, sf_dir))


@named("SELECT event_type, COUNT(*) AS count, round(sum(value), 4) AS sum, " + ", ".join(f"CAST(sum(CASE WHEN value <= {b} THEN 1 ELSE 0 END) AS BIGINT) AS le_{b}" for b in (10, 50, 100)) + " FROM events GROUP BY event_type")
def labelled_counters(spark, sf_dir):
    return analytics.label_counts(tables.read(spark, sf_dir, "events"), ["event_type"], "value", [10, 50, 100])


@named("SELECT (epoch_us(ts) // 1000 // 60000) * 60000 AS \"window\", event_type, min(epoch_us(ts) // 1000) AS first_ts, COUNT(*) AS repeated_count FROM events GROUP BY 1, 2")
def log_dedup(spark, sf_dir):
    e = tables.read(spark, sf_dir, "events").withColumn("ts_ms", F.expr("unix_millis(cast(ts as timestamp))"))
    return analytics.fold_logs(e, "ts_ms", ["event_type"], 60000)


@named("WITH RECURSIVE r AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS ts_ms, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS n FROM events), f AS (SELECT user_id, event_id, ts_ms, n, CAST(1 AS DOUBLE) AS tokens, TRUE AS allowed FROM r WHERE n = 1 UNION ALL SELECT r.user_id, r.event_id, r.ts_ms, r.n, least(2.0, f.tokens + (r.ts_ms - f.ts_ms) * CAST('1e-9' AS DOUBLE)) - CASE WHEN least(2.0, f.tokens + (r.ts_ms - f.ts_ms) * CAST('1e-9' AS DOUBLE)) >= 1 THEN 1 ELSE 0 END, least(2.0, f.tokens + (r.ts_ms - f.ts_ms) * CAST('1e-9' AS DOUBLE)) >= 1 FROM f JOIN r ON r.user_id = f.user_id AND r.n = f.n + 1) SELECT user_id, event_id AS id, ts_ms AS ts, allowed FROM f")
def token_bucket(spark, sf_dir):
    return analytics.token_bucket(tables.operation_results(spark, sf_dir), "user_id", "ts_ms", 2.0, 1e-9)


@named("SELECT user_id, CAST(island AS BIGINT) AS island, min(ts_ms) AS start, max(ts_ms + 3600000) AS \"end\", COUNT(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts_ms, event_id) AS island FROM (SELECT user_id, event_id, ts_ms, CASE WHEN ts_ms - lag(ts_ms + 3600000) OVER (PARTITION BY user_id ORDER BY ts_ms, event_id) <= 86400000 THEN 0 ELSE 1 END AS new FROM (SELECT user_id, event_id, epoch_us(ts) // 1000 AS ts_ms FROM events))) GROUP BY user_id, island")
def islands_merge(spark, sf_dir):
    e = tables.operation_results(spark, sf_dir).select("user_id", F.col("ts_ms").alias("s"), (F.col("ts_ms") + 3600000).alias("e"))
    return analytics.islands(e, ["user_id"], "s", "e", 86400000)


@named("SELECT CAST(sum(CASE WHEN value >= 100 THEN 1 ELSE 0 END) AS BIGINT) AS \"full\", CAST(sum(CASE WHEN value >= 95 AND value < 100 THEN 1 ELSE 0 END) AS BIGINT) AS high, CAST(sum(CASE WHEN value >= 85 AND value < 95 THEN 1 ELSE 0 END) AS BIGINT) AS medium, CAST(sum(CASE WHEN value < 85 THEN 1 ELSE 0 END) AS BIGINT) AS low FROM events")
def bucket_counts(spark, sf_dir):
    return analytics.bucket_counts(tables.read(spark, sf_dir, "events"), "value")


@named("SELECT doc_id, CASE WHEN length(text) < 12 THEN 'length,' ELSE '' END || CASE WHEN NOT regexp_matches(text, '[A-Z]') THEN 'upper,' ELSE '' END || CASE WHEN NOT regexp_matches(text, '[a-z]') THEN 'lower,' ELSE '' END || CASE WHEN NOT regexp_matches(text, '[0-9]') THEN 'digit,' ELSE '' END || CASE WHEN NOT regexp_matches(text, '[^A-Za-z0-9]') THEN 'special,' ELSE '' END AS faults FROM documents")
def password_policy(spark, sf_dir):
    faults = analytics.password_faults(F.col("text"))
    return tables.read(spark, sf_dir, "documents").select("doc_id", F.concat(F.array_join(faults, ","), F.when(F.size(faults) > 0, ",").otherwise("")).alias("faults"))


@named("SELECT op, round((sum(weight) OVER (ORDER BY op) - weight) / sum(weight) OVER (), 6) AS low, round(sum(weight) OVER (ORDER BY op) / sum(weight) OVER (), 6) AS high FROM (SELECT event_type AS op, CAST(count(*) AS DOUBLE) AS weight FROM events GROUP BY event_type)")
def op_mix_cumulative(spark, sf_dir):
    w = tables.read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("op")).agg(F.count("*").cast("double").alias("weight"))
    return analytics.operation_mix(w)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change log -> coalesced -> typed -> triggers -> delivery tasks."""
    log = cdc.coalesce_batches(tables.change_log(spark, sf_dir))
    events = cdc.typed(log, F.lit(False)).select("database", "collection", "doc_id", "type", "ts_ms", F.col("i").alias("version"), F.struct("value", "op").alias("data"))
    tasks = rules.fire(events, TRIGGERS)
    return tasks.select("version", "doc_id", "type", "trigger_id", "subject", "max_attempts")


QUERIES["flagship"] = flagship
