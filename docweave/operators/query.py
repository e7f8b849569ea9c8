"""The document query: filter, order, limit, cursor, soft deletes."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fields import Fields, after
from ..model import DEFAULT_LIMIT, Filter, InvalidQuery, Order, Query, check_document, decode_cursor, encode_cursor


def live(docs: DataFrame) -> DataFrame:
    return docs.where(~F.col("deleted"))


def scan(docs: DataFrame, database: str, collection: str, show_deleted: bool = False) -> DataFrame:
    """All documents of one collection."""
    found = docs.where((F.col("database") == database) & (F.col("collection") == collection))
    return found if show_deleted else live(found)


def get(docs: DataFrame, database: str, path: str) -> DataFrame:
    """The document at a path: one row, or none."""
    collection, doc_id = check_document(path)
    return scan(docs, database, collection).where(F.col("doc_id") == doc_id)


def get_many(docs: DataFrame, database: str, paths: list[str]) -> DataFrame:
    """A row for each path in order (pos); null columns where nothing is there."""
    spark = docs.sparkSession
    asked = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "pos int, asked string")
    found = live(docs.where(F.col("database") == database).where(F.col("fullpath").isin(paths)))
    return asked.join(found, F.col("asked") == F.col("fullpath"), "left").drop("asked").orderBy("pos")


def orders(fields: Fields, order_by: tuple[Order, ...]) -> list[tuple[Column, str]]:
    """Sort keys with their directions; the id, ascending, is always the last."""
    keys = [(k, o.direction) for o in order_by for k in fields.sort_keys(o.field)]
    return [*keys, (F.col("doc_id"), "asc")]


def directed(keys: list[tuple[Column, str]]) -> list[Column]:
    return [k.asc_nulls_first() if d == "asc" else k.desc_nulls_last() for k, d in keys]


def execute(docs: DataFrame, q: Query) -> DataFrame:
    """The query's rows, in order where it names one.

    One plan for every route: Catalyst pushes the filters into the scan, and order
    with limit becomes a top-k without a full sort."""
    q.validate()
    return rows(docs, q, q.limit or (DEFAULT_LIMIT if q.route() == "indexed" or q.start_after else 0))


def rows(docs: DataFrame, q: Query, limit: int) -> DataFrame:
    """The rows of a valid query under a limit of the caller's (0 for none)."""
    fields = Fields(docs)
    found = scan(docs, q.database, q.collection, q.show_deleted)
    if (p := fields.all(q.filters)) is not None:
        found = found.where(p)
    keys = orders(fields, q.order_by)
    if q.start_after:
        values = decode_cursor(q.start_after)
        if len(values) != len(keys):
            raise InvalidQuery("the cursor is of another order")
        found = found.where(after([(k, d, v) for (k, d), v in zip(keys, values, strict=True)]))
    if q.order_by or limit:
        found = found.orderBy(*directed(keys))
    return found.limit(limit) if limit else found


def page(docs: DataFrame, q: Query) -> tuple[DataFrame, bool, str]:
    """Rows, whether more follow, and the cursor behind the last row."""
    size = q.limit or DEFAULT_LIMIT
    keys = [k.alias(f"_k{i}") for i, (k, _) in enumerate(orders(Fields(docs), q.order_by))]
    wide = rows(docs, q.validate(), size + 1)
    seen = wide.select(*keys).collect()  # at most size + 1 rows of sort keys
    cursor = encode_cursor(list(seen[min(size, len(seen)) - 1])) if seen else q.start_after
    return wide.limit(size), len(seen) > size, cursor


def has_more(rows: DataFrame, size: int, order: list[Column]) -> DataFrame:
    """The first `size` rows with a column that tells whether more follow."""
    wide = rows.orderBy(*order).limit(size + 1)
    from pyspark.sql import Window

    # at most size + 1 rows reach the window
    w = Window.orderBy(*order)
    return wide.select("*", F.row_number().over(w).alias("_n"), (F.count("*").over(Window.partitionBy(F.lit(1))) > size).alias("has_more")).where(F.col("_n") <= size).drop("_n")


def flatten(docs: DataFrame) -> DataFrame:
    """The user's view as JSON: data fields, id, system fields; deleted only if true."""
    names = docs.schema["data"].dataType.names
    fields = [F.col("data")[n].alias(n) for n in names if n not in ("id", "collection", "version", "updatedAt", "createdAt", "deleted")]
    system = [F.col("doc_id").alias("id"), "collection", "version", F.col("updated_at").alias("updatedAt"), F.col("created_at").alias("createdAt"), F.when(F.col("deleted"), F.lit(True)).alias("deleted")]
    return docs.select("fullpath", F.to_json(F.struct(*fields, *system)).alias("document"))


def update_where(docs: DataFrame, q: Query, changes: dict[str, Any], now: int) -> DataFrame:
    """docs with `changes` set on the rows of the query, their version one up."""
    hit = matches(docs, q)
    data = F.col("data")
    for name, value in changes.items():
        data = data.withField(name, F.lit(value))
    return docs.withColumns({"data": F.when(hit, data).otherwise(F.col("data")), "version": F.col("version") + hit.cast("long"), "updated_at": F.when(hit, F.lit(now)).otherwise(F.col("updated_at"))})


def delete_where(docs: DataFrame, q: Query, now: int) -> DataFrame:
    """docs with the rows of the query soft-deleted."""
    hit = matches(docs, q)
    return docs.withColumns({"deleted": F.col("deleted") | hit, "version": F.col("version") + hit.cast("long"), "updated_at": F.when(hit, F.lit(now)).otherwise(F.col("updated_at"))})


def matches(docs: DataFrame, q: Query) -> Column:
    p = Fields(docs).all(q.validate().filters)
    hit = (F.col("database") == q.database) & (F.col("collection") == q.collection) & ~F.col("deleted")
    return hit if p is None else hit & F.coalesce(p, F.lit(False))


def collections(docs: DataFrame) -> DataFrame:
    return docs.select("collection").distinct().orderBy("collection")


def name_search(rows: DataFrame, column: str, text: str) -> DataFrame:
    return rows.where(F.contains(F.lower(F.col(column)), F.lit(text.lower())))


class Collection:
    """Fluent queries: Collection(docs, "users").where("age", ">", 20).order_by("age").limit(5).to_df()"""

    def __init__(self, docs: DataFrame, path: str, database: str = "default", query: Query | None = None):
        self.docs, self.query = docs, query or Query(path, database=database)

    def _with(self, **changes) -> Collection:
        return Collection(self.docs, self.query.collection, self.query.database, Query(**{**self.query.__dict__, **changes}))

    def where(self, field: str, op: str, value: Any) -> Collection:
        return self._with(filters=(*self.query.filters, Filter(field, op, value)))

    def order_by(self, field: str, direction: str = "asc") -> Collection:
        return self._with(order_by=(*self.query.order_by, Order(field, direction)))

    def limit(self, n: int) -> Collection:
        return self._with(limit=n)

    def start_after(self, cursor: str) -> Collection:
        return self._with(start_after=cursor)

    def show_deleted(self) -> Collection:
        return self._with(show_deleted=True)

    def doc(self, doc_id: str) -> DataFrame:
        return get(self.docs, self.query.database, f"{self.query.collection}/{doc_id}")

    def collection(self, doc_id: str, name: str) -> Collection:
        return Collection(self.docs, f"{self.query.collection}/{doc_id}/{name}", self.query.database)

    def to_df(self) -> DataFrame:
        return execute(self.docs, self.query)

    def page(self) -> tuple[DataFrame, bool, str]:
        return page(self.docs, self.query)

    def update(self, changes: dict[str, Any], now: int) -> DataFrame:
        return update_where(self.docs, self.query, changes, now)

    def delete(self, now: int) -> DataFrame:
        return delete_where(self.docs, self.query, now)
