"""Queries over document collections, and what can be wrong with them."""

from __future__ import annotations

import base64
import json
import re
from dataclasses import dataclass, field
from typing import Any

OPERATORS = ("==", "!=", ">", ">=", "<", "<=", "in", "contains")
SYSTEM_FIELDS = {"id": "doc_id", "_id": "doc_id", "collection": "collection", "version": "version", "createdAt": "created_at", "updatedAt": "updated_at", "deleted": "deleted"}
PROTECTED = ("version", "updatedAt", "createdAt", "collection", "deleted")
MAX_LIMIT = 1000
#: The limit of an ordered or filtered query that names none.
DEFAULT_LIMIT = 100
MAX_PATH = 1024
MAX_ID = 64
ID = re.compile(r"[A-Za-z0-9_.\-]{1,64}")
FIELD = re.compile(r"[A-Za-z_][A-Za-z0-9_]*(\.[A-Za-z_][A-Za-z0-9_]*)*")


class EngineError(Exception):
    """Base of the engine's errors; `status` is the value of result tables' status column."""

    status = "error"


class NotFound(EngineError):
    status = "not_found"


class AlreadyExists(EngineError):
    status = "exists"


class PreconditionFailed(EngineError):
    status = "precondition_failed"


class InvalidQuery(EngineError):
    status = "invalid_query"


class IndexNotReady(EngineError):
    status = "index_not_ready"


class PermissionDenied(EngineError):
    status = "permission_denied"


@dataclass(frozen=True)
class Filter:
    field: str
    op: str
    value: Any

    def valid(self) -> bool:
        return bool(FIELD.fullmatch(self.field)) and self.op in OPERATORS and (self.op != "in" or isinstance(self.value, (list, tuple)))


@dataclass(frozen=True)
class Order:
    field: str
    direction: str = "asc"


@dataclass(frozen=True)
class Query:
    collection: str
    filters: tuple[Filter, ...] = ()
    order_by: tuple[Order, ...] = ()
    limit: int = 0
    start_after: str = ""
    show_deleted: bool = False
    database: str = "default"

    def validate(self) -> Query:
        check_collection(self.collection)
        if not 0 <= self.limit <= MAX_LIMIT:
            raise InvalidQuery(f"limit must be between 0 and {MAX_LIMIT}")
        for f in self.filters:
            if not f.valid():
                raise InvalidQuery(f"bad filter {f}")
        for o in self.order_by:
            if o.direction not in ("asc", "desc") or not FIELD.fullmatch(o.field):
                raise InvalidQuery(f"bad order {o}")
        return self

    def route(self) -> str:
        """How the query is answered: all of a collection, by ids, or by filter and order."""
        if not self.order_by and not self.filters:
            return "scan"
        if not self.order_by and all(f.field in ("id", "_id") and f.op in ("==", "in") for f in self.filters):
            return "ids"
        return "indexed"

    @classmethod
    def from_json(cls, body: str | dict) -> Query:
        d = json.loads(body) if isinstance(body, str) else body
        return cls(
            d.get("collection", ""),
            tuple(Filter(f["field"], f["op"], f.get("value")) for f in d.get("filters", ())),
            tuple(Order(o["field"], o.get("direction") or "asc") for o in d.get("orderBy", ())),
            d.get("limit", 0),
            d.get("startAfter", ""),
            d.get("showDeleted", False),
        ).validate()


def check_path(path: str) -> list[str]:
    """The segments of a document or collection path."""
    if not path or len(path) > MAX_PATH:
        raise InvalidQuery("a path has 1 to 1024 characters")
    parts = path.split("/")
    if not all(re.fullmatch(r"[A-Za-z0-9_.\-]+", p) for p in parts):
        raise InvalidQuery(f"bad path {path!r}")
    return parts


def check_collection(path: str) -> str:
    if len(check_path(path)) % 2 == 0:
        raise InvalidQuery("a collection path has an odd number of segments")
    return path


def check_document(path: str) -> tuple[str, str]:
    parts = check_path(path)
    if len(parts) % 2:
        raise InvalidQuery("a document path has an even number of segments")
    return "/".join(parts[:-1]), parts[-1]


def document_id(value: Any) -> str:
    """A given id as text; whole numbers are accepted in any form."""
    if isinstance(value, bool) or value is None:
        raise InvalidQuery("an id is a string or a whole number")
    if isinstance(value, float) and value.is_integer():
        value = int(value)
    text = str(value) if isinstance(value, (int, str)) else ""
    if not ID.fullmatch(text):
        raise InvalidQuery(f"bad id {value!r}")
    return text


def strip_protected(data: dict) -> dict:
    return {k: v for k, v in data.items() if k not in PROTECTED}


def encode_cursor(values: list) -> str:
    """Sort values and id of the last row seen, as URL-safe text."""
    return base64.urlsafe_b64encode(json.dumps(values).encode()).decode().rstrip("=")


def decode_cursor(cursor: str) -> list:
    try:
        found = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
        assert isinstance(found, list)
        return found
    except Exception as e:
        raise InvalidQuery("bad cursor") from e


@dataclass(frozen=True)
class Retry:
    max_attempts: int = 3
    initial_ms: int = 1000
    max_ms: int = 60000


@dataclass(frozen=True)
class Trigger:
    id: str
    events: tuple[str, ...]
    collection: str
    url: str = "https://example.com/hook"
    condition: str = ""
    database: str = "default"
    retry: Retry = field(default_factory=Retry)
    timeout_ms: int = 5000
