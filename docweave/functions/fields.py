"""Fields of stored documents as typed Columns, and filters over them.

A document frame has the system columns (doc_id, collection, version, created_at,
updated_at, deleted, ...) and `data`: a struct where the collection is typed, else a
VARIANT.  A filter compares values of one type only; another type, or a missing
field, does not match.
"""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import SYSTEM_FIELDS, Filter, InvalidQuery


def kind_of(value: Any) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float)):
        return "number"
    if isinstance(value, str):
        return "string"
    if isinstance(value, (list, tuple)):
        return "list"
    raise InvalidQuery(f"values of type {type(value).__name__} cannot be compared")


def type_kind(t: T.DataType) -> str:
    if isinstance(t, T.BooleanType):
        return "boolean"
    if isinstance(t, T.NumericType):
        return "number"
    if isinstance(t, T.StringType):
        return "string"
    if isinstance(t, T.ArrayType):
        return "list"
    return "variant" if isinstance(t, T.VariantType) else "other"


SPARK_TYPE = {"number": "double", "string": "string", "boolean": "boolean"}


class Fields:
    """Resolves field names over the schema of a document frame."""

    def __init__(self, df: DataFrame):
        self.schema = df.schema
        self.data = next((f.dataType for f in df.schema if f.name == "data"), None)

    def column(self, name: str) -> tuple[Column | None, T.DataType | None]:
        """The field's Column and type; None where the schema cannot have it."""
        if name in SYSTEM_FIELDS and SYSTEM_FIELDS[name] in self.schema.names:
            system = SYSTEM_FIELDS[name]
            return F.col(system), self.schema[system].dataType
        if isinstance(self.data, T.VariantType):
            return F.col("data"), self.data
        at, column = self.data, F.col("data")
        for part in name.split("."):
            if isinstance(at, T.VariantType):
                return F.try_variant_get(column, "$." + name.split(part, 1)[-1].lstrip("."), "variant"), at
            if not isinstance(at, T.StructType) or part not in at.names:
                return None, None
            column, at = column[part], at[part].dataType
        return column, at

    def typed(self, name: str, kind: str) -> Column:
        """The field as `kind`, null where it is missing or of another type."""
        column, t = self.column(name)
        if column is None:
            return F.lit(None).cast(SPARK_TYPE.get(kind, "string"))
        if isinstance(t, T.VariantType):
            part = F.try_variant_get(column, "$." + name, "variant")
            shape = F.schema_of_variant(part)
            right = {"number": ~shape.isin("STRING", "BOOLEAN", "VOID") & ~shape.startswith("OBJECT") & ~shape.startswith("ARRAY"), "string": shape == "STRING", "boolean": shape == "BOOLEAN"}[kind]
            return F.when(right, F.try_variant_get(column, "$." + name, SPARK_TYPE[kind]))
        if type_kind(t) != kind:
            return F.lit(None).cast(SPARK_TYPE.get(kind, "string"))
        return column

    def is_null(self, name: str) -> Column:
        """Whether the field is null (of a struct: missing fields are null too)."""
        column, t = self.column(name)
        if column is None:
            return F.lit(False)
        return F.coalesce(F.is_variant_null(F.try_variant_get(column, "$." + name, "variant")), F.lit(False)) if isinstance(t, T.VariantType) else column.isNull()

    def sort_keys(self, name: str) -> list[Column]:
        """Columns whose order is that of the index: null < false < true < numbers < strings."""
        column, t = self.column(name)
        if column is None:
            return []
        if not isinstance(t, T.VariantType):
            return [column]
        text, number, flag = (self.typed(name, k) for k in ("string", "number", "boolean"))
        tag = F.when(text.isNotNull(), 3).when(number.isNotNull(), 2).when(flag.isNotNull(), 1).otherwise(0)
        return [tag, F.coalesce(number, flag.cast("double")), text]

    def predicate(self, f: Filter, missing_differs: bool = False) -> Column:
        """The filter as a Column that is true or false."""
        return F.coalesce(self.test(f, missing_differs), F.lit(False))

    def test(self, f: Filter, missing_differs: bool = False) -> Column:
        """The filter as a Column that is true where it matches, else false or null: in this form it is pushed into scans."""
        if not f.valid():
            raise InvalidQuery(f"bad filter {f}")
        if f.op == "in":
            if _same_kind(f.value):
                return self.typed(f.field, kind_of(f.value[0])).isin(list(f.value))
            return reduce(lambda a, b: a | b, [self.predicate(Filter(f.field, "==", v)) for v in f.value], F.lit(False))
        if f.op == "contains":
            column, t = self.column(f.field)
            if isinstance(t, T.VariantType):
                return F.array_contains(F.try_variant_get(column, "$." + f.field, f"array<{SPARK_TYPE[kind_of(f.value)]}>"), f.value)
            if column is None or type_kind(t) != "list" or type_kind(t.elementType) != kind_of(f.value):
                return F.lit(False)
            return F.array_contains(column, f.value)
        kind = kind_of(f.value)
        if kind == "null":
            null = self.is_null(f.field)
            return {"==": null, "!=": ~null}.get(f.op, F.lit(False))
        if kind == "list":
            raise InvalidQuery("only `in` takes a list")
        x, v = self.typed(f.field, kind), F.lit(f.value)
        found = {"==": x == v, "!=": x != v, ">": x > v, ">=": x >= v, "<": x < v, "<=": x <= v}[f.op]
        return F.coalesce(found, F.lit(True)) if f.op == "!=" and missing_differs else found

    def all(self, filters) -> Column | None:
        found = [self.test(f) for f in filters]
        return reduce(lambda a, b: a & b, found) if found else None


def _same_kind(values) -> bool:
    return len(values) > 0 and len({kind_of(v) for v in values}) == 1 and kind_of(values[0]) in SPARK_TYPE


def after(keys: list[tuple[Column, str, Any]]) -> Column:
    """Rows that follow a cursor: keys are (column, asc or desc, the cursor's value).

    Ascending keys have nulls first, descending ones last, as sorting has."""
    out, equal = F.lit(False), F.lit(True)
    for column, direction, value in keys:
        if value is None:
            beyond = column.isNotNull() if direction == "asc" else F.lit(False)
        else:
            beyond = column > F.lit(value) if direction == "asc" else (column < F.lit(value)) | column.isNull()
        out = out | (equal & F.coalesce(beyond, F.lit(False)))
        equal = equal & column.eqNullSafe(F.lit(value))
    return out
