"""The expression language of rules, triggers and subscriptions, compiled to Columns.

A recursive-descent parser makes a small tree; the compiler gives each node a Column
and a kind.  An evaluation error is SQL null, so `&&` and `||` absorb errors as the
language has it (Kleene logic); a condition is true only where the whole is true.
"""

from __future__ import annotations

import re
from functools import lru_cache
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKEN = re.compile(r"""\s+|//[^\n]*|(?P<num>\d+\.\d+(?:[eE][+-]?\d+)?|0x[0-9a-fA-F]+u?|\d+(?:[eE][+-]?\d+)|\d+u?)|(?P<str>[rR]?(?:'''.*?'''|\"\"\".*?\"\"\"|"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'))|(?P<id>[A-Za-z_]\w*)|(?P<op>&&|\|\||==|!=|<=|>=|[-+*/%!<>?:.,()\[\]{}])""", re.S)
ESCAPE = {"n": "\n", "t": "\t", "r": "\r", "\\": "\\", "'": "'", '"': '"', "`": "`", "a": "\a", "b": "\b", "f": "\f", "v": "\v", "?": "?"}
LEVELS = [["||"], ["&&"], ["==", "!=", "<", "<=", ">", ">=", "in"], ["+", "-"], ["*", "/", "%"]]
MACROS = ("all", "exists", "exists_one", "map", "filter")


class CelError(ValueError):
    """The expression does not parse or name a known thing."""


@dataclass
class Node:
    op: str
    args: list
    value: Any = None


def lex(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise CelError(f"unexpected {text[at]!r} at {at}")
        at = m.end()
        if m.lastgroup:
            out.append((m.lastgroup, m.group()))
    return [*out, ("end", "")]


def unquote(s: str) -> str:
    raw = s[0] in "rR"
    s = s[1:] if raw else s
    body = s[3:-3] if s[:3] in ("'''", '"""') else s[1:-1]
    if raw:
        return body
    return re.sub(r"\\(u[0-9a-fA-F]{4}|x[0-9a-fA-F]{2}|.)", lambda m: chr(int(m[1][1:], 16)) if len(m[1]) > 1 else ESCAPE.get(m[1], m[1]), body, flags=re.S)


class Parser:
    def __init__(self, text: str):
        self.tokens, self.at = lex(text), 0

    def peek(self) -> str:
        return self.tokens[self.at][1]

    def take(self, want: str | None = None) -> tuple[str, str]:
        token = self.tokens[self.at]
        if want is not None and token[1] != want:
            raise CelError(f"expected {want!r}, found {token[1]!r}")
        self.at += 1
        return token

    def parse(self) -> Node:
        out = self.ternary()
        if self.tokens[self.at][0] != "end":
            raise CelError(f"unexpected {self.peek()!r}")
        return out

    def ternary(self) -> Node:
        test = self.binary(0)
        if self.peek() != "?":
            return test
        self.take()
        yes = self.ternary()
        self.take(":")
        return Node("?:", [test, yes, self.ternary()])

    def binary(self, level: int) -> Node:
        if level == len(LEVELS):
            return self.unary()
        left = self.binary(level + 1)
        while self.peek() in LEVELS[level] and self.tokens[self.at][0] != "str":
            op = self.take()[1]
            left = Node(op, [left, self.binary(level + 1)])
        return left

    def unary(self) -> Node:
        if self.tokens[self.at] in (("op", "!"), ("op", "-")):
            op = self.take()[1]
            return Node("not" if op == "!" else "neg", [self.unary()])
        return self.member()

    def arguments(self, close: str) -> list[Node]:
        out = []
        while self.peek() != close or self.tokens[self.at][0] == "str":
            out.append(self.ternary())
            if self.peek() != ",":
                break
            self.take()
        self.take(close)
        return out

    def member(self) -> Node:
        out = self.primary()
        while self.tokens[self.at] in (("op", "."), ("op", "["), ("op", "(")):
            op = self.take()[1]
            if op == ".":
                kind, name = self.take()
                if kind != "id":
                    raise CelError(f"expected a name, found {name!r}")
                if self.peek() == "(":
                    self.take()
                    out = Node("call", [out, *self.arguments(")")], name)
                else:
                    out = Node("select", [out], name)
            elif op == "[":
                out = Node("index", [out, self.ternary()])
                self.take("]")
            elif out.op == "name":
                out = Node("call", [None, *self.arguments(")")], out.value)
            else:
                raise CelError("only names can be called")
        return out

    def primary(self) -> Node:
        kind, text = self.take()
        if kind == "num":
            if text.lower().startswith("0x"):
                return Node("lit", [], int(text.rstrip("u"), 16))
            return Node("lit", [], float(text) if re.search(r"[.eE]", text) else int(text.rstrip("u")))
        if kind == "str":
            return Node("lit", [], unquote(text))
        if kind == "id":
            return Node("lit", [], {"true": True, "false": False, "null": None}[text]) if text in ("true", "false", "null") else Node("name", [], text)
        if text == "(":
            out = self.ternary()
            self.take(")")
            return out
        if text == "[":
            return Node("list", self.arguments("]"))
        if text == "{":
            pairs = []
            while self.peek() != "}":
                key = self.ternary()
                self.take(":")
                pairs += [key, self.ternary()]
                if self.peek() != ",":
                    break
                self.take()
            self.take("}")
            return Node("map", pairs)
        raise CelError(f"unexpected {text!r}")


@lru_cache(maxsize=1000)
def parsed(text: str) -> Node:
    """The tree of an expression; a thousand of them are kept."""
    return Parser(text).parse()


def kind_of(t: T.DataType) -> str:
    if isinstance(t, T.BooleanType):
        return "bool"
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "int"
    if isinstance(t, T.NumericType):
        return "double"
    if isinstance(t, T.StringType):
        return "string"
    if isinstance(t, T.ArrayType):
        return "list"
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        return "timestamp"
    return "variant" if isinstance(t, T.VariantType) else "map"


@dataclass
class Value:
    column: Column
    kind: str
    type: T.DataType | None = None
    path: str = ""  # of a variant


NUMERIC = ("int", "double")
VARIANT_TYPE = {"int": "double", "double": "double", "string": "string", "bool": "boolean"}
PARTS: dict[str, Callable[[Column], Column]] = {
    "getFullYear": F.year,
    "getMonth": lambda c: F.month(c) - 1,
    "getDate": F.dayofmonth,
    "getDayOfMonth": lambda c: F.dayofmonth(c) - 1,
    "getDayOfWeek": lambda c: F.dayofweek(c) - 1,
    "getDayOfYear": lambda c: F.dayofyear(c) - 1,
    "getHours": F.hour,
    "getMinutes": F.minute,
    "getSeconds": F.second,
    "getMilliseconds": lambda c: F.floor(F.date_format(c, "SSS").cast("int")),
}
DURATION = re.compile(r"(-?\d+(?:\.\d+)?)(ns|us|ms|h|m|s)")
UNIT = {"ns": 1e-9, "us": 1e-6, "ms": 1e-3, "s": 1.0, "m": 60.0, "h": 3600.0}


class Compiler:
    """Compiles with `names`: variable -> (Column, its DataType).

    `functions` adds calls: name -> a function of Values that gives a Value."""

    def __init__(self, names: dict[str, tuple[Column, T.DataType]], functions: dict[str, Callable[..., Value]] | None = None):
        self.names = {k: Value(c, kind_of(t), t) for k, (c, t) in names.items()}
        self.functions = functions or {}

    def condition(self, text: str) -> Column:
        """True where the expression is true; false where it is false or fails."""
        found = self.compile(parsed(text))
        return F.coalesce(self.as_kind(found, "bool").column, F.lit(False))

    def value(self, text: str) -> Column:
        return self.compile(parsed(text)).column

    def compile(self, n: Node) -> Value:
        return getattr(self, "on_" + {"&&": "and", "||": "or", "?:": "if", "lit": "lit", "name": "name", "select": "select", "index": "index", "call": "call", "list": "list", "map": "map", "not": "not", "neg": "neg", "in": "in", "==": "compare", "!=": "compare", "<": "compare", "<=": "compare", ">": "compare", ">=": "compare"}.get(n.op, "arithmetic"))(n)

    def on_lit(self, n: Node) -> Value:
        v = n.value
        if v is None:
            return Value(F.lit(None), "null")
        if isinstance(v, bool):
            return Value(F.lit(v), "bool", T.BooleanType())
        if isinstance(v, int):
            return Value(F.lit(v).cast("long"), "int", T.LongType())
        return Value(F.lit(v), "double", T.DoubleType()) if isinstance(v, float) else Value(F.lit(v), "string", T.StringType())

    def on_name(self, n: Node) -> Value:
        if n.value not in self.names:
            raise CelError(f"undeclared reference to {n.value!r}")
        return self.names[n.value]

    def on_select(self, n: Node) -> Value:
        return self.field(self.compile(n.args[0]), n.value)

    def field(self, v: Value, name: str) -> Value:
        if v.kind == "variant":
            return Value(v.column, "variant", v.type, f"{v.path}.{name}")
        if isinstance(v.type, T.StructType):
            if name in v.type.names:
                return Value(v.column[name], kind_of(v.type[name].dataType), v.type[name].dataType)
            return Value(F.lit(None), "null-error")
        if isinstance(v.type, T.MapType):
            return Value(F.try_element_at(v.column, F.lit(name)), kind_of(v.type.valueType), v.type.valueType)
        return Value(F.lit(None), "null-error")

    def on_index(self, n: Node) -> Value:
        v = self.compile(n.args[0])
        key = n.args[1]
        if key.op == "lit" and isinstance(key.value, str):
            return self.field(v, key.value)
        if v.kind == "variant" and key.op == "lit":
            return Value(v.column, "variant", v.type, f"{v.path}[{key.value}]")
        if v.kind == "list":
            return Value(F.get(v.column, self.compile(key).column.cast("int")), kind_of(v.type.elementType), v.type.elementType)
        if isinstance(v.type, T.MapType):
            return Value(F.try_element_at(v.column, self.compile(key).column), kind_of(v.type.valueType), v.type.valueType)
        raise CelError("only lists and maps have elements")

    def as_kind(self, v: Value, kind: str) -> Value:
        """A variant read as kind; null (an error) where it is of another."""
        if v.kind == kind or v.kind in ("null", "null-error") or kind not in VARIANT_TYPE:
            return v
        if v.kind != "variant":
            return v if {v.kind, kind} <= set(NUMERIC) else Value(F.lit(None).cast(VARIANT_TYPE[kind]), kind)
        path = "$" + v.path
        shape = F.schema_of_variant(F.try_variant_get(v.column, path, "variant"))
        right = {"string": shape == "STRING", "bool": shape == "BOOLEAN"}.get(kind, ~shape.isin("STRING", "BOOLEAN", "VOID") & ~shape.startswith("OBJECT") & ~shape.startswith("ARRAY"))
        return Value(F.when(right, F.try_variant_get(v.column, path, VARIANT_TYPE[kind])), "double" if kind == "int" else kind)

    def on_compare(self, n: Node) -> Value:
        a, b = (self.compile(x) for x in n.args)
        if "null" in (a.kind, b.kind):
            other = b if a.kind == "null" else a
            if other.kind == "variant":
                null = F.is_variant_null(F.try_variant_get(other.column, "$" + other.path, "variant"))
            else:
                null = F.lit(None).cast("boolean") if other.kind == "null-error" else other.column.isNull()
            return Value({"==": null, "!=": ~null}.get(n.op, F.lit(None).cast("boolean")), "bool")
        if a.kind == "variant" and b.kind == "variant":
            a, b = self.as_kind(a, "double"), self.as_kind(b, "double")
        elif a.kind == "variant":
            a = self.as_kind(a, b.kind)
        elif b.kind == "variant":
            b = self.as_kind(b, a.kind)
        same = a.kind == b.kind or {a.kind, b.kind} <= set(NUMERIC)
        if "null-error" in (a.kind, b.kind):
            return Value(F.lit(None).cast("boolean"), "bool")
        if not same:  # values of different kinds are unequal, and have no order
            return Value(F.lit({"==": False, "!=": True}.get(n.op)).cast("boolean"), "bool")
        x, y = a.column, b.column
        return Value({"==": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[n.op], "bool")

    def bool_(self, n: Node) -> Column:
        return self.as_kind(self.compile(n), "bool").column.cast("boolean")

    def on_and(self, n: Node) -> Value:
        return Value(self.bool_(n.args[0]) & self.bool_(n.args[1]), "bool")

    def on_or(self, n: Node) -> Value:
        return Value(self.bool_(n.args[0]) | self.bool_(n.args[1]), "bool")

    def on_not(self, n: Node) -> Value:
        return Value(~self.bool_(n.args[0]), "bool")

    def on_if(self, n: Node) -> Value:
        test = self.bool_(n.args[0])
        a, b = self.compile(n.args[1]), self.compile(n.args[2])
        return Value(F.when(test, a.column).when(~test, b.column), a.kind, a.type)

    def on_neg(self, n: Node) -> Value:
        v = self.as_kind(self.compile(n.args[0]), "double")
        return Value(-v.column, v.kind, v.type)

    def on_arithmetic(self, n: Node) -> Value:
        a, b = (self.compile(x) for x in n.args)
        if a.kind == "variant":
            a = self.as_kind(a, b.kind if b.kind != "variant" else "double")
        if b.kind == "variant":
            b = self.as_kind(b, a.kind)
        if n.op == "+" and a.kind == b.kind == "string":
            return Value(F.concat(a.column, b.column), "string", T.StringType())
        if n.op == "+" and a.kind == b.kind == "list":
            return Value(F.concat(a.column, b.column), "list", a.type)
        if n.op in "+-" and a.kind == "timestamp" and b.kind == "duration":
            return Value(F.timestamp_micros(F.unix_micros(a.column) + (b.column * (1 if n.op == "+" else -1) * 1_000_000).cast("long")), "timestamp", T.TimestampType())
        if n.op == "-" and a.kind == b.kind == "timestamp":
            return Value((F.unix_micros(a.column) - F.unix_micros(b.column)) / 1e6, "duration")
        if not {a.kind, b.kind} <= {*NUMERIC, "duration"}:
            return Value(F.lit(None), "null-error")
        x, y = a.column, b.column
        whole = a.kind == b.kind == "int"
        if n.op == "/":  # of ints: the quotient cut towards zero, an error for zero
            out = F.when(y != 0, (x - F.try_mod(x, y)) / y).cast("long") if whole else x / F.when(y != 0, y)
        else:
            out = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply, "%": F.try_mod}[n.op](x, y)
        return Value(out, "int" if whole else a.kind if a.kind == "duration" else "double")

    def on_in(self, n: Node) -> Value:
        a, b = (self.compile(x) for x in n.args)
        if b.kind == "list":
            inner = kind_of(b.type.elementType) if b.type is not None else a.kind
            return Value(F.array_contains(b.column, self.as_kind(a, inner).column), "bool")
        if b.kind == "variant":
            if a.kind == "string":
                path = "$" + b.path
                part = F.try_variant_get(b.column, path, "variant")
                listed = F.array_contains(F.try_variant_get(b.column, path, "array<string>"), a.column)
                has = F.map_contains_key(F.try_variant_get(b.column, path, "map<string,variant>"), n.args[0].value) if n.args[0].op == "lit" else F.lit(None).cast("boolean")
                return Value(F.when(F.schema_of_variant(part).startswith("OBJECT"), has).otherwise(listed), "bool")
            return Value(F.array_contains(F.try_variant_get(b.column, "$" + b.path, f"array<{VARIANT_TYPE[a.kind]}>"), a.column.cast(VARIANT_TYPE[a.kind])), "bool")
        if isinstance(b.type, T.MapType):
            return Value(F.array_contains(F.map_keys(b.column), a.column), "bool")
        if isinstance(b.type, T.StructType) and n.args[0].op == "lit":
            return Value(F.lit(n.args[0].value in b.type.names), "bool")
        raise CelError("`in` needs a list or a map")

    def on_list(self, n: Node) -> Value:
        items = [self.compile(x) for x in n.args]
        kinds = {i.kind for i in items}
        kind = "double" if kinds == set(NUMERIC) else items[0].kind if items else "string"
        spark = {"int": T.LongType(), "double": T.DoubleType(), "bool": T.BooleanType(), "string": T.StringType()}.get(kind, items[0].type if items else T.StringType())
        columns = [i.column.cast(spark) if kind in VARIANT_TYPE else i.column for i in items]
        return Value(F.array(*columns) if items else F.array().cast("array<string>"), "list", T.ArrayType(spark))

    def on_map(self, n: Node) -> Value:
        keys, values = n.args[::2], [self.compile(v) for v in n.args[1::2]]
        if not all(k.op == "lit" and isinstance(k.value, str) for k in keys):
            raise CelError("map keys are string literals")
        fields = [T.StructField(k.value, v.type or T.StringType()) for k, v in zip(keys, values, strict=True)]
        return Value(F.struct(*[v.column.alias(k.value) for k, v in zip(keys, values, strict=True)]), "map", T.StructType(fields))

    # ------------------------------------------------------------- calls

    def on_call(self, n: Node) -> Value:
        target, args, name = n.args[0], n.args[1:], n.value
        if target is None:
            if name == "has":
                return self.has(args)
            if name in self.functions:
                return self.functions[name](*[self.compile(a) for a in args])
            if name == "size":
                return self.size(self.compile(args[0]))
            return self.convert(name, args)
        if name in MACROS:
            return self.macro(name, self.compile(target), args)
        v = self.compile(target)
        if name == "size":
            return self.size(v)
        if name in PARTS:
            return Value(PARTS[name](v.column).cast("long"), "int", T.LongType())
        s = self.as_kind(v, "string").column.cast("string")
        other = [self.as_kind(self.compile(a), "string").column for a in args]
        if name in ("contains", "startsWith", "endsWith"):
            return Value({"contains": F.contains, "startsWith": F.startswith, "endsWith": F.endswith}[name](s, other[0]), "bool")
        if name == "matches":
            return Value(F.rlike(s, other[0]), "bool")
        raise CelError(f"undeclared reference to {name!r}")

    def has(self, args: list) -> Value:
        if len(args) != 1 or args[0].op != "select":
            raise CelError("has() takes a field selection")
        v = self.compile(args[0].args[0])
        if v.kind == "variant":
            return Value(F.try_variant_get(v.column, f"${v.path}.{args[0].value}", "variant").isNotNull(), "bool")
        if isinstance(v.type, T.MapType):
            return Value(F.array_contains(F.map_keys(v.column), args[0].value), "bool")
        found = self.field(v, args[0].value)
        return Value(F.lit(False) if found.kind == "null-error" else found.column.isNotNull(), "bool")

    def size(self, v: Value) -> Value:
        if v.kind == "string":
            out = F.char_length(v.column)
        elif v.kind == "variant":
            path = "$" + v.path
            shape = F.schema_of_variant(F.try_variant_get(v.column, path, "variant"))
            out = F.when(shape == "STRING", F.char_length(F.try_variant_get(v.column, path, "string"))).when(shape.startswith("ARRAY"), F.size(F.try_variant_get(v.column, path, "array<variant>"))).when(shape.startswith("OBJECT"), F.size(F.try_variant_get(v.column, path, "map<string,variant>")))
        elif isinstance(v.type, T.StructType):
            out = F.lit(len(v.type))
        else:
            out = F.when(v.column.isNotNull(), F.size(v.column))
        return Value(out.cast("long"), "int", T.LongType())

    def convert(self, name: str, args: list) -> Value:
        if len(args) != 1:
            raise CelError(f"undeclared reference to {name!r}")
        if name == "duration":
            if args[0].op != "lit" or not re.fullmatch(rf"(?:{DURATION.pattern})+", str(args[0].value)):
                raise CelError("duration() takes a literal such as \"90s\"")
            return Value(F.lit(sum(float(a) * UNIT[u] for a, u in DURATION.findall(args[0].value))), "duration")
        v = self.compile(args[0])
        if name == "dyn":
            return v
        text = F.try_variant_get(v.column, "$" + v.path, "string") if v.kind == "variant" else v.column
        if name in ("int", "uint"):
            out = F.unix_seconds(text) if v.kind == "timestamp" else text.try_cast("double").cast("long") if v.kind == "double" else text.try_cast("long")
            return Value(F.when(out >= 0, out) if name == "uint" else out, "int", T.LongType())
        if name == "double":
            return Value(text.try_cast("double"), "double", T.DoubleType())
        if name == "string":
            return Value(text.cast("string"), "string", T.StringType())
        if name == "bool":
            return Value(text.try_cast("boolean"), "bool", T.BooleanType())
        if name == "bytes":
            return Value(F.encode(text, "utf-8"), "bytes", T.BinaryType())
        if name == "timestamp":
            return Value(F.timestamp_seconds(text) if v.kind == "int" else F.try_to_timestamp(text), "timestamp", T.TimestampType())
        if name == "type":
            return Value(F.schema_of_variant(F.try_variant_get(v.column, "$" + v.path, "variant")) if v.kind == "variant" else F.lit(v.kind), "string", T.StringType())
        raise CelError(f"undeclared reference to {name!r}")

    def macro(self, name: str, v: Value, args: list) -> Value:
        if args[0].op != "name" or len(args) not in (2, 3):
            raise CelError(f"{name}() takes a variable and an expression")
        if v.kind == "variant":
            v = Value(F.try_variant_get(v.column, "$" + v.path, "array<variant>"), "list", T.ArrayType(T.VariantType()))
        if v.kind != "list":
            raise CelError(f"{name}() needs a list")
        inner = v.type.elementType

        def body(k: int):
            def run(x: Column) -> Column:
                names = {**{n: (c.column, c.type) for n, c in self.names.items()}, args[0].value: (x, inner)}
                sub = Compiler(names, self.functions)
                found = sub.compile(args[k])
                return sub.as_kind(found, "bool").column if name != "map" or k < len(args) - 1 else found.column

            return run

        if name == "all":
            return Value(F.forall(v.column, body(1)), "bool")
        if name == "exists":
            return Value(F.exists(v.column, body(1)), "bool")
        if name == "exists_one":
            return Value(F.size(F.filter(v.column, body(1))) == 1, "bool")
        if name == "filter":
            return Value(F.filter(v.column, body(1)), "list", v.type)
        source = F.filter(v.column, body(1)) if len(args) == 3 else v.column
        names = {**{n: (c.column, c.type) for n, c in self.names.items()}, args[0].value: (F.lit(None).cast(inner), inner)}
        kind = Compiler(names, self.functions).compile(args[-1])
        return Value(F.transform(source, body(len(args) - 1)), "list", T.ArrayType(kind.type or T.StringType()))


def compile_condition(text: str, names: dict[str, tuple[Column, T.DataType]], functions=None) -> Column:
    return F.lit(True) if not text.strip() else Compiler(names, functions).condition(text)


def filters_to_cel(filters, variable: str = "doc") -> str:
    """Filters as text of the language, joined by &&."""
    out = []
    for f in filters:
        path = f"{variable}.{f.field}"
        if f.op == "in":
            out.append(f"{path} in {literal(list(f.value))}")
        elif f.op == "contains":
            out.append(f"{literal(f.value)} in {path}")
        else:
            out.append(f"{path} {f.op} {literal(f.value)}")
    return " && ".join(out) or "true"


def literal(v: Any) -> str:
    if v is None or isinstance(v, bool):
        return {None: "null", True: "true", False: "false"}[v]
    if isinstance(v, (int, float)):
        return repr(v)
    if isinstance(v, (list, tuple)):
        return "[" + ", ".join(map(literal, v)) + "]"
    return '"' + str(v).replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") + '"'
