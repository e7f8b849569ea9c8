"""Document frames, change logs and fact tables over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import group, parent


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(rows: DataFrame, collection: Column, doc_id: Column, data: Column, at: Column | None = None, version: Column | None = None, deleted: Column | None = None, database: str = "default") -> DataFrame:
    """The canonical frame of stored documents."""
    at = F.lit(0).cast("long") if at is None else at
    return rows.select(
        F.lit(database).alias("database"),
        collection.alias("collection"),
        group(collection).alias("collection_group"),
        doc_id.alias("doc_id"),
        F.concat_ws("/", collection, doc_id).alias("fullpath"),
        parent(collection).alias("parent"),
        (F.lit(1) if version is None else version).cast("long").alias("version"),
        at.alias("created_at"),
        at.alias("updated_at"),
        (F.lit(False) if deleted is None else deleted).alias("deleted"),
        data.alias("data"),
    )


def orders_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    data = F.struct(F.col("o_custkey").alias("custkey"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("total"), F.col("o_orderpriority").alias("priority"))
    return documents(o, F.lit("orders"), F.col("o_orderkey").cast("string"), data, F.expr("unix_millis(cast(o_orderdate as timestamp))"), 1 + F.col("o_orderkey") % 3, F.col("o_orderkey") % 10 == 0)


def customer_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    data = F.struct(F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("total"))
    return documents(o, F.concat(F.lit("customers/"), F.col("o_custkey").cast("string"), F.lit("/orders")), F.col("o_orderkey").cast("string"), data)


def part_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    data = F.struct(F.split("p_name", " ").alias("tags"), F.col("p_brand").alias("brand"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"))
    return documents(p, F.lit("parts"), F.col("p_partkey").cast("string"), data)


def event_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return documents(e, F.concat(F.lit("users/"), F.col("user_id").cast("string"), F.lit("/events")), F.col("event_id").cast("string"), F.parse_json("props"), F.expr("unix_millis(cast(ts as timestamp))"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations")
    data = F.struct("role", "text")
    return documents(c, F.concat(F.lit("conversations/"), F.col("conv_id").cast("string"), F.lit("/messages")), F.col("turn").cast("string"), data)


#: The operation that an event type stands for in the change log.
OPERATION = {"signup": "insert", "view": "update", "click": "update", "purchase": "replace", "error": "delete"}


def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """backend, t, i, event_id, op, database, collection, doc_id, value, ts_ms of the events table."""
    e = read(spark, sf_dir, "events")
    op = F.create_map(*[F.lit(x) for pair in OPERATION.items() for x in pair])[F.col("event_type")]
    return e.select(
        F.concat(F.lit("b"), (F.col("event_id") % 2).cast("string")).alias("backend"),
        F.expr("unix_seconds(cast(ts as timestamp))").alias("t"),
        F.col("event_id").alias("i"),
        op.alias("op"),
        F.lit("default").alias("database"),
        F.lit("users").alias("collection"),
        F.col("user_id").cast("string").alias("doc_id"),
        F.col("value"),
        F.expr("unix_millis(cast(ts as timestamp))").alias("ts_ms"),
    )


def operation_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("op"), F.floor("value").cast("long").alias("latency_ms"), (F.col("event_type") != "error").alias("success"), F.when(F.col("event_type") == "error", F.concat(F.lit("E"), (F.col("user_id") % 5).cast("string"))).alias("error"), F.col("user_id"), F.expr("unix_millis(cast(ts as timestamp))").alias("ts_ms"), "event_id")
