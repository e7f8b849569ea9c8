"""Paths, ids, globs and subject patterns as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_path(path: Column, parity: int | None = None) -> Column:
    """Whether a path is well-formed; parity 1 for collections, 0 for documents."""
    ok = F.length(path).between(1, 1024) & path.rlike(r"^[A-Za-z0-9_.\-]+(/[A-Za-z0-9_.\-]+)*$")
    if parity is not None:
        ok = ok & (F.size(F.split(path, "/")) % 2 == parity)
    return F.coalesce(ok, F.lit(False))


def parent(path: Column) -> Column:
    """All but the last segment; empty for one segment."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def last(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def group(collection: Column) -> Column:
    """The collection with every id segment starred."""
    parts = F.split(collection, "/")
    return F.array_join(F.transform(parts, lambda p, i: F.when(i % 2 == 1, F.lit("*")).otherwise(p)), "/")


def is_id(value: Column) -> Column:
    return F.coalesce(value.rlike(r"^[A-Za-z0-9_.\-]{1,64}$"), F.lit(False))


def is_slug(value: Column) -> Column:
    return F.coalesce(value.rlike(r"^[a-z][a-z0-9-]{2,62}$"), F.lit(False))


def template_regex(pattern: str) -> str:
    """{var} and * stand for one segment."""
    return "^" + "/".join("[^/]+" if p == "*" or re.fullmatch(r"\{[^}]*\}", p) else re.escape(p) for p in pattern.split("/")) + "$"


def rule_regex(pattern: str) -> tuple[str, list[str]]:
    """Rule paths: {var} is one segment, {var=**} the rest; names of the groups."""
    out, names = [], []
    for p in pattern.strip("/").split("/"):
        if m := re.fullmatch(r"\{(\w+)=\*\*\}", p):
            names.append(m[1])
            out.append("(.+)")
        elif m := re.fullmatch(r"\{(\w+)\}", p):
            names.append(m[1])
            out.append("([^/]+)")
        else:
            out.append(re.escape(p))
    return "^" + "/".join(out) + "$", names


def glob_regex(glob: str) -> str:
    """* and ? within a segment, [..] classes, backslash escapes."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[" and "]" in glob[i:]:
            j = glob.index("]", i)
            body = glob[i + 1 : j]
            out.append("[" + ("^" + body[1:] if body[:1] in "^!" else body).replace("\\", "\\\\") + "]")
            i = j
        elif c == "\\" and i + 1 < len(glob):
            i += 1
            out.append(re.escape(glob[i]))
        else:
            out.append(re.escape(c))
        i += 1
    return "^" + "".join(out) + "$"


def subject_regex(pattern: str) -> str:
    """Subjects of dot-separated tokens: * is one token, > one or more at the end."""
    parts = pattern.split(".")
    body = [r"[^.]+" if p == "*" else r".+" if p == ">" and i == len(parts) - 1 else re.escape(p) for i, p in enumerate(parts)]
    return "^" + r"\.".join(body) + "$"


def base64_url(value: Column) -> Column:
    return F.translate(F.rtrim(F.translate(F.base64(value), "=", " ")), "+/", "-_")


def event_id(t: Column, i: Column, collection: Column, doc: Column) -> Column:
    """Cluster time and the first 16 hex digits of the SHA-256 of the path."""
    return F.concat_ws("-", t.cast("string"), i.cast("string"), F.substring(F.sha2(F.concat_ws("/", collection, doc), 256), 1, 16))


def cluster_time(event: Column) -> tuple[Column, Column]:
    parts = F.split(event, "-")
    return parts[0].cast("long"), parts[1].cast("long")


def buffer_key(t: Column, i: Column, event: Column) -> Column:
    """Keys whose text order is the order of events."""
    return F.concat_ws("-", F.lpad(t.cast("string"), 10, "0"), F.lpad(i.cast("string"), 10, "0"), event)
