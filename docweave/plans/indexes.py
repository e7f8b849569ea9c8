"""Index templates: which layout serves a query, and how well.

Catalyst chooses the physical plan; a template here is a layout (partitioning and sort
order of files), and scoring tells which one prunes best.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fields import Fields
from ..functions.paths import template_regex
from ..model import DEFAULT_LIMIT, IndexNotReady, InvalidQuery, Order, Query

RANGE = (">", ">=", "<", "<=")
STATES = ("healthy", "rebuilding", "failed")
INDEX = ["database", "pattern", "template"]


@dataclass(frozen=True)
class Template:
    pattern: str
    fields: tuple[Order, ...]
    name: str = ""
    include_deleted: bool = False

    def title(self) -> str:
        return self.name or self.pattern + ":" + ",".join(f"{f.field}_{f.direction}" for f in self.fields)

    def specificity(self) -> tuple[int, int]:
        parts = self.pattern.split("/")
        return sum(not is_variable(p) for p in parts), len(parts)


def is_variable(part: str) -> bool:
    return part == "*" or bool(re.fullmatch(r"\{[^}]*\}", part))


def load(text: str) -> list[Template]:
    """Templates of a YAML list: collectionPattern, fields [{field, order}], name, includeDeleted."""
    import yaml

    out = []
    for t in yaml.safe_load(text) or []:
        fields = tuple(Order(f["field"], f.get("order", "asc")) for f in t.get("fields", []))
        out.append(Template(t.get("collectionPattern", ""), fields, t.get("name", ""), t.get("includeDeleted", False)))
    for t in out:
        if not t.fields or any(f.direction not in ("asc", "desc") for f in t.fields):
            raise InvalidQuery(f"template {t.title()} needs fields with order asc or desc")
        if len({f.field for f in t.fields}) < len(t.fields) or not all(t.pattern.split("/")):
            raise InvalidQuery(f"template {t.title()} repeats a field or has an empty segment")
    if len({t.title() for t in out}) < len(out):
        raise InvalidQuery("a template is given twice")
    return out


def score(q: Query, t: Template) -> int:
    """0 where the template cannot serve the query; else 1, 10 for each leading field with an
    equality, 3 for a range on the next one, 5 for each ordered field that follows, 1 for a
    template with no field to spare, 2 for all-ascending leading fields without an order."""
    equal = {f.field for f in q.filters if f.op == "=="}
    lead = 0
    while lead < len(t.fields) and t.fields[lead].field in equal:
        lead += 1
    leading = {f.field for f in t.fields[:lead]}
    ranged = {f.field for f in q.filters if f.op in RANGE and f.field not in leading}
    rest = list(t.fields[lead:])
    if len(ranged) > 1 or ranged and (not rest or rest[0].field not in ranged):
        return 0
    used = lead + len(ranged)
    # An order that starts with the ranged field starts at that field.
    begin = lead if ranged and q.order_by and q.order_by[0].field in ranged else used
    if tuple(t.fields[begin : begin + len(q.order_by)]) != tuple(q.order_by):
        return 0
    # With an order on the ranged field its place counts twice against a full cover.
    covered = begin + len(q.order_by) + (begin < used)
    points = 1 + 10 * lead + 5 * len(q.order_by) + 3 * len(ranged) + (covered == len(t.fields))
    if not q.order_by and all(f.direction == "asc" for f in t.fields[:used]):
        points += 2
    return points


def best(q: Query, templates: list[Template]) -> Template | None:
    """Of the templates that fit the collection and can serve q: the most specific, then best scored, then first by name."""
    fit = [(t.specificity(), score(q, t), t) for t in templates if re.match(template_regex(t.pattern), q.collection) and (t.include_deleted or not q.show_deleted)]
    fit = [x for x in fit if x[1] > 0]
    return min(fit, key=lambda x: (-x[0][0], -x[0][1], -x[1], x[2].title()))[2] if fit else None


def explain(q: Query, templates: list[Template]) -> dict:
    t = best(q, templates)
    return {"route": q.route(), "template": t.title() if t else None, "score": score(q, t) if t else 0}


def matches(collections: DataFrame, templates: list[Template]) -> DataFrame:
    """Each collection with the templates that fit it, best first (rank): the most fixed segments, then the longest."""
    spark = collections.sparkSession
    rows = [(t.title(), template_regex(t.pattern), *t.specificity()) for t in templates]
    table = F.broadcast(spark.createDataFrame(rows, "template string, regex string, fixed int, parts int"))  # the driver's own list
    found = collections.join(table, F.expr("collection rlike regex")).drop("regex")
    w = Window.partitionBy("collection").orderBy(F.desc("fixed"), F.desc("parts"), "template")
    return found.withColumn("rank", F.row_number().over(w))


def index_rows(docs: DataFrame, t: Template) -> DataFrame:
    """doc_id with the template's sort keys, for documents of its pattern, in its order."""
    fields = Fields(docs)
    found = docs.where(F.col("collection").rlike(template_regex(t.pattern)))
    if not t.include_deleted:
        found = found.where(~F.col("deleted"))
    keys = [(k.alias(f"k{i}_{j}"), f.direction) for i, f in enumerate(t.fields) for j, k in enumerate(fields.sort_keys(f.field))]
    return found.select("database", "collection", "doc_id", *[k for k, _ in keys])


def lay_out(docs: DataFrame, t: Template, partitions: int) -> DataFrame:
    """docs ranged and sorted by the template, so that file statistics prune its queries."""
    fields = Fields(docs)
    keys = [k.asc_nulls_first() if f.direction == "asc" else k.desc_nulls_last() for f in t.fields for k in fields.sort_keys(f.field)]
    return docs.repartitionByRange(partitions, F.col("collection"), *keys).sortWithinPartitions("collection", *keys, "doc_id")


def merge_read(base: DataFrame, pending: DataFrame, key: str = "doc_id") -> DataFrame:
    """A base with pending changes on top: pending upserts replace, pending deletes hide."""
    return base.join(pending.select(key), key, "left_anti").unionByName(pending.where("op <> 'delete'").select(*base.columns))


def reconcile(desired: DataFrame, actual: DataFrame) -> DataFrame:
    """What to do with each index (name; actual has state): create, delete, rebuild or keep."""
    d, a = desired.select("name", F.lit(True).alias("wanted")), actual.select("name", "state")
    found = d.join(a, "name", "full")
    action = F.when(F.col("wanted").isNull(), "delete").when(F.col("state").isNull(), "create").when(F.col("state") == "failed", "rebuild").otherwise("keep")
    return found.select("name", action.alias("action"))


def list_indexes(entries: DataFrame, states: DataFrame, database: str = "", pattern: str = "", template: str = "") -> DataFrame:
    """Indexes with an entry (database, pattern, template, doc_id): their documents and state.

    states has a row (database, pattern, template, state) for some; the others are
    healthy.  An empty name stands for all."""
    found = entries.where(_named(database, pattern, template)).groupBy(*INDEX).agg(F.count("*").alias("docs"))
    return found.join(states, INDEX, "left").select(*INDEX, F.coalesce("state", F.lit("healthy")).alias("state"), "docs")


def _named(database: str = "", pattern: str = "", template: str = "") -> Column:
    out = F.lit(True)
    for name, value in zip(INDEX, (database, pattern, template), strict=True):
        if value:
            out = out & (F.col(name) == value)
    return out


def list_databases(entries: DataFrame) -> DataFrame:
    return entries.select("database").distinct()


def delete_index(entries: DataFrame, states: DataFrame, database: str, pattern: str = "", template: str = "") -> tuple[DataFrame, DataFrame]:
    """Entries and states without one index, or without all of a database (and pattern)."""
    if not database:
        raise InvalidQuery("a database is named")
    gone = _named(database, pattern, template)
    return entries.where(~gone), states.where(~gone)


def set_state(indexes: DataFrame, states: DataFrame, state: str) -> DataFrame:
    """states with the given indexes in one state."""
    if state not in STATES:
        raise InvalidQuery(f"bad state {state!r}")
    chosen = indexes.select(*INDEX).distinct()
    return states.join(chosen, INDEX, "left_anti").select(*INDEX, "state").unionByName(chosen.withColumn("state", F.lit(state)))


def invalidate(entries: DataFrame, states: DataFrame, database: str, pattern: str = "", template: str = "") -> tuple[DataFrame, int]:
    """states with a database's indexes (of a pattern, of a template) failed, so that reconcile rebuilds them; and how many."""
    if not database:
        raise InvalidQuery("a database is named")
    chosen = list_indexes(entries, states, database, pattern, template)
    return set_state(chosen, states, "failed"), chosen.count()


def state_report(desired: list[Template], entries: DataFrame, states: DataFrame, database: str = "", pattern: str = "") -> DataFrame:
    """Desired (templates) against actual indexes: wanted, and database, state and docs where there is one."""
    rows = sorted({(t.pattern, t.title()) for t in desired if pattern in ("", t.pattern)})
    wanted = entries.sparkSession.createDataFrame(rows, "pattern string, template string").withColumn("wanted", F.lit(True))  # the driver's own list
    found = wanted.join(list_indexes(entries, states, database, pattern), ["pattern", "template"], "full")
    return found.select(*INDEX, F.coalesce("wanted", F.lit(False)).alias("wanted"), "state", "docs")


def stats(docs: DataFrame) -> DataFrame:
    return docs.groupBy("database", "collection_group").agg(F.count("*").alias("docs"), F.countDistinct("collection").alias("collections"))


#: The version and type tags of an order key.
KEY_VERSION, TAGS = "01", {"null": "00", "boolean": "01", "number": "02", "string": "03"}


def memcomparable(column: Column, kind: str, direction: str = "asc") -> Column:
    """A value's bytes as hex: order by it is order by the value, null first (last where descending).

    A number's are those of its double with the sign turned; a string's end with 0000,
    and a zero byte inside is 0001."""
    if kind == "string":
        body = F.concat(F.regexp_replace(F.regexp_replace(F.hex(column.cast("binary")), "(..)", "$1 "), "00 ", "0001 "), F.lit("0000"))
        body = F.translate(body, " ", "")
    elif kind == "boolean":
        body = F.when(column, "01").otherwise("00")
    elif kind == "number":
        x = column.cast("double") + F.lit(0.0)  # no negative zero
        bits = F.call_function("reflect", F.lit("java.lang.Double"), F.lit("doubleToLongBits"), x).cast("long")
        body = F.lpad(F.hex(F.when(x >= 0, bits.bitwiseXOR(F.lit(-(2**63)))).otherwise(F.bitwise_not(bits))), 16, "0")
    else:
        raise InvalidQuery(f"values of kind {kind} have no order key")
    body = F.when(column.isNull(), TAGS["null"]).otherwise(F.concat(F.lit(TAGS[kind]), body))
    return body if direction == "asc" else F.translate(body, "0123456789ABCDEF", "FEDCBA9876543210")


def order_key(values: list[tuple[Column, str, str]], doc_id: Column | None) -> Column:
    """The key of an index row as hex: version, (column, kind, direction) in turn, and the id with its length; a prefix without an id."""
    parts = [F.lit(KEY_VERSION), *[memcomparable(*v) for v in values]]
    if doc_id is not None:
        parts += [F.lpad(F.hex(F.octet_length(doc_id)), 4, "0"), F.hex(doc_id.cast("binary"))]
    return F.concat(*parts)


def serve(docs: DataFrame, q: Query, templates: list[Template], states: dict[str, str] | None = None) -> DataFrame:
    """The query by an index: the best template's rows within the query's bounds, in order, under its limit; then their documents.

    IndexNotReady where no template serves it or its index is not healthy.  Order is
    kept and ids whose document is gone are left out."""
    from ..operators.query import directed

    t = best(q.validate(), templates)
    if t is None or (states or {}).get(t.title(), "healthy") != "healthy":
        raise IndexNotReady(t.title() if t else q.collection)
    fields = Fields(docs)
    rows = docs.where((F.col("database") == q.database) & (F.col("collection") == q.collection))
    rows = rows if q.show_deleted else rows.where(~F.col("deleted"))
    if (p := fields.all(q.filters)) is not None:
        rows = rows.where(p)
    keys = [(k.alias(f"k{i}_{j}"), o.direction) for i, o in enumerate(q.order_by) for j, k in enumerate(fields.sort_keys(o.field))]
    entries = rows.select("fullpath", F.col("doc_id").alias("_id"), *[k for k, _ in keys])
    order = directed([(F.col(f"k{i}_{j}"), o.direction) for i, o in enumerate(q.order_by) for j, _ in enumerate(fields.sort_keys(o.field))] + [(F.col("_id"), "asc")])
    entries = entries.orderBy(*order).limit(q.limit or DEFAULT_LIMIT)  # at most MAX_LIMIT rows
    fetched = F.broadcast(entries).join(docs.where(F.col("database") == q.database), "fullpath")
    return fetched.orderBy(*order).select(*docs.columns)
