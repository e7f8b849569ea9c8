"""The eight verbs of the document service over a store held as a DataFrame."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.fields import Fields
from .model import AlreadyExists, Filter, NotFound, PreconditionFailed, Query, check_document
from .operators import query, writes


class Service:
    """One document or one query at a time; batches go to `operators.writes`.  Each write gives the next Service."""

    def __init__(self, store: DataFrame, database: str = "default"):
        self.store, self.database = store, database

    def _row(self, path: str, show_deleted: bool = False):
        collection, doc_id = check_document(path)
        return query.scan(self.store, self.database, collection, show_deleted).where(F.col("doc_id") == doc_id)

    def _next(self, store: DataFrame) -> Service:
        return Service(store, self.database)

    def get_document(self, path: str):
        found = self._row(path).first()
        if found is None:
            raise NotFound(path)
        return found

    def create_document(self, path: str, data: DataFrame, now: int) -> Service:
        """data: one row of the store's data column."""
        if self._row(path).first() is not None:
            raise AlreadyExists(path)
        return self._put(path, data, 1, now, now)

    def replace_document(self, path: str, data: DataFrame, now: int, if_match: tuple[Filter, ...] = ()) -> Service:
        before = self._row(path).first()
        if before is None:
            return self._put(path, data, 1, now, now)
        self._check(path, if_match)
        return self._put(path, data, before["version"] + 1, before["created_at"], now)

    def patch_document(self, path: str, changes: dict[str, Any], now: int, if_match: tuple[Filter, ...] = ()) -> Service:
        if self._row(path, True).first() is None:
            raise NotFound(path)
        self._check(path, if_match)
        collection, doc_id = check_document(path)
        return self._next(query.update_where(self.store, Query(collection, (Filter("id", "==", doc_id),), database=self.database), changes, now))

    def delete_document(self, path: str, now: int, if_match: tuple[Filter, ...] = ()) -> Service:
        if self._row(path).first() is None:
            raise NotFound(path)
        self._check(path, if_match)
        collection, doc_id = check_document(path)
        return self._next(query.delete_where(self.store, Query(collection, (Filter("id", "==", doc_id),), database=self.database), now))

    def execute_query(self, q: Query) -> DataFrame:
        return query.execute(self.store, q)

    def pull(self, collection: str, checkpoint: int, limit: int) -> DataFrame:
        return writes.pull(self.store, self.database, collection, checkpoint, limit)

    def push(self, changes: DataFrame) -> DataFrame:
        return writes.push(changes, self.store)

    def _check(self, path: str, if_match: tuple[Filter, ...]) -> None:
        test: Column | None = Fields(self.store).all(if_match)
        found = self._row(path)
        if (found if test is None else found.where(test)).first() is None:
            raise PreconditionFailed(path)

    def _put(self, path: str, data: DataFrame, version: int, created: int, now: int) -> Service:
        from .sources.tables import documents

        collection, doc_id = check_document(path)
        row = documents(data, F.lit(collection), F.lit(doc_id), F.col("data"), F.lit(now).cast("long"), F.lit(version), database=self.database).withColumn("created_at", F.lit(created).cast("long"))
        return self._next(writes.apply(self.store, row))
