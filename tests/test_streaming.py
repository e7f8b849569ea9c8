"""Streams against the batch operators over the same log."""

import pytest
from docweave.model import Trigger
from docweave.operators import cdc, rules
from docweave.sources import tables
from docweave.streaming import changes
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def log(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("log") / "log")
    tables.change_log(spark, "/root/testdata/sf0.001").repartitionByRange(3, "t").sortWithinPartitions("t", "i").write.parquet(path)
    return path


def test_buffer(spark, log, tmp_path):
    changes.buffered(changes.source(spark, log, files_per_batch=1), f"{tmp_path}/o", f"{tmp_path}/c").awaitTermination()
    good, _ = cdc.normalize(spark.read.parquet(log))
    assert spark.read.parquet(f"{tmp_path}/o").drop("batch").exceptAll(good.select(*spark.read.parquet(f"{tmp_path}/o").drop("batch").columns)).count() == 0


def test_triggers_in_one_batch(spark, log, tmp_path):
    t = [Trigger("t", ("create", "update"), "users", condition="event.document.value > 50.0")]
    changes.triggered(changes.source(spark, log), t, f"{tmp_path}/o", f"{tmp_path}/c").awaitTermination()
    events = cdc.typed(cdc.coalesce(spark.read.parquet(log)), F.lit(False)).withColumns({"version": F.col("i"), "data": F.struct("value", "op")})
    want = rules.fire(events, t)
    assert sorted(r.version for r in spark.read.parquet(f"{tmp_path}/o").collect()) == sorted(r.version for r in want.collect()) != []


def test_subscriptions(spark, log, tmp_path):
    s = [rules.Subscription("s", "g", "users")]
    changes.subscribed(changes.source(spark, log, files_per_batch=1), s, f"{tmp_path}/o", f"{tmp_path}/c").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/o").count() == spark.read.parquet(log).where("op <> 'delete'").count()


def memory(spark, df, name, mode="append"):
    df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


def test_gaps(spark, log):
    found = memory(spark, changes.gaps(changes.source(spark, log), 60_000), "gaps")
    assert sorted((r.backend, r.gap_ms) for r in found.collect()) == sorted((r.backend, r.gap_ms) for r in cdc.gaps(spark.read.parquet(log), 60_000).collect())


def test_duplicates(spark, log):
    twice = changes.source(spark, log).withColumn("x", F.explode(F.array(F.lit(1), F.lit(2)))).drop("x")
    assert memory(spark, changes.deduplicated(twice, "400 days"), "once").count() == spark.read.parquet(log).count()


def test_rate_limit(spark, log):
    requests = changes.source(spark, log).select(F.col("backend").alias("key"), "ts_ms")
    found = memory(spark, changes.rate_limited(requests, 2.0, 1e-8), "limited").collect()
    assert len(found) == spark.read.parquet(log).count() and 0 < sum(r.allowed for r in found) < len(found)


def test_maintained_index(spark, log, tmp_path):
    changes.maintained(changes.source(spark, log, files_per_batch=1), f"{tmp_path}/o", f"{tmp_path}/c").awaitTermination()
    last = max(int(p.name.split("=")[1]) for p in (tmp_path / "o").iterdir() if p.name.startswith("generation"))
    from docweave.operators.writes import latest

    want = latest(spark.read.parquet(log), ["doc_id"], [F.col("t"), F.col("i")]).where("op <> 'delete'")
    got = spark.read.parquet(f"{tmp_path}/o/generation={last}").where("op <> 'delete'")
    assert sorted((r.doc_id, r.i) for r in got.collect()) == sorted((r.doc_id, r.i) for r in want.collect())
