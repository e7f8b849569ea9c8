"""Databases: creation under rules and quota, status, deletion; and where each one's documents lie."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.paths import is_slug
from ..model import NotFound


def create(requests: DataFrame, databases: DataFrame, limits: DataFrame, default_limit: int = 10) -> DataFrame:
    """Requests (seq, owner, slug or null) with their status: created, invalid_slug, exists or over_quota.

    Requests of one owner, and of one slug, count in the order of seq."""
    taken = databases.where("slug is not null").select("slug", F.lit(True).alias("_taken")).distinct()
    used = databases.where("status <> 'deleting'").groupBy("owner").agg(F.count("*").alias("_used"))
    found = requests.join(taken, "slug", "left").join(used, "owner", "left").join(limits.select("owner", "max_databases"), "owner", "left")
    first = F.row_number().over(Window.partitionBy("slug").orderBy("seq")) == 1
    found = found.withColumn("_fault", F.when(F.col("slug").isNotNull() & ~is_slug(F.col("slug")), "invalid_slug").when(F.col("slug").isNotNull() & (F.col("_taken").isNotNull() | ~first), "exists"))
    before = F.sum(F.col("_fault").isNull().cast("long")).over(Window.partitionBy("owner").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    room = F.coalesce("max_databases", F.lit(default_limit)) - F.coalesce("_used", F.lit(0))
    status = F.when(F.col("_fault").isNotNull(), F.col("_fault")).when(before > room, "over_quota").otherwise("created")
    return found.withColumn("status", status).drop("_taken", "_used", "_fault", "max_databases")


def mark_deleting(databases: DataFrame, database_id: str) -> DataFrame:
    return databases.withColumn("status", F.when(F.col("id") == database_id, "deleting").otherwise(F.col("status")))


def finish_deleting(databases: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Databases and documents without those marked, however many."""
    marked = databases.where("status = 'deleting'").select(F.col("id").alias("database")).distinct()
    return databases.where("status is null or status <> 'deleting'"), docs.join(marked, "database", "left_anti").select(*docs.columns)


@dataclass
class Stores:
    """Folders of documents by database: reads go to the replica where there is one, writes to the primary.

    A database has its own folder, and each write a new generation in it, which counts
    once it is whole; so a write never touches other databases nor what its plan reads."""

    default: str
    primary: dict[str, str] = field(default_factory=dict)
    replica: dict[str, str] = field(default_factory=dict)

    def write_path(self, database: str) -> str:
        return self.primary.get(database, self.default)

    def read_path(self, database: str) -> str:
        return self.replica.get(database) or self.write_path(database)

    def generations(self, spark: SparkSession, folder: str) -> list[int]:
        """The whole generations of a database's folder, oldest first."""
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(path):
            return []
        found = [s.getPath() for s in files.listStatus(path)]
        return sorted(int(p.getName().partition("=")[2]) for p in found if p.getName().startswith("generation=") and files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def read(self, spark: SparkSession, database: str) -> DataFrame:
        folder = f"{self.read_path(database)}/{database}"
        found = self.generations(spark, folder)
        if not found:
            raise NotFound(database)
        return spark.read.parquet(f"{folder}/generation={found[-1]}")

    def write(self, docs: DataFrame, database: str) -> None:
        """All of a database's documents (other rows of docs play no part), in folders that its queries prune by."""
        spark, folder = docs.sparkSession, f"{self.write_path(database)}/{database}"
        found = self.generations(spark, folder)
        new = found[-1] + 1 if found else 0
        docs.where(F.col("database") == database).write.mode("overwrite").partitionBy("collection_group").parquet(f"{folder}/generation={new}")
        for old in found[:-1]:  # the one before stays for readers that have begun
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/generation={old}")
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def drop(self, spark: SparkSession, database: str) -> None:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.write_path(database)}/{database}")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


class Cache:
    """Databases by id or slug, kept for a time; so is what was not found."""

    def __init__(self, load, ttl_ms: int = 60_000, missing_ms: int = 10_000, most: int = 1000):
        self.load, self.ttl_ms, self.missing_ms, self.most = load, ttl_ms, missing_ms, most
        self.kept: dict[str, tuple[int, dict | None]] = {}

    def get(self, identifier: str, now_ms: int) -> dict:
        """identifier: "id:x" or a slug; load gives the database (id, slug, ...) or None."""
        until, found = self.kept.get(identifier, (0, None))
        if until <= now_ms:
            found = self.load(identifier)
            until = now_ms + (self.ttl_ms if found else self.missing_ms)
            names = [identifier] if found is None else ["id:" + found["id"], *([found["slug"]] if found.get("slug") else [])]
            for name in names:
                self.kept.pop(name, None)
                self.kept[name] = until, found
            while len(self.kept) > self.most:  # the oldest goes
                self.kept.pop(next(iter(self.kept)))
        if found is None:
            raise NotFound(identifier)
        return found

    def forget(self, database: dict) -> None:
        for name in ("id:" + database["id"], database.get("slug")):
            self.kept.pop(name, None)
