"""Running values over ranges against windows over whole groups."""

import pytest
from docweave.plans import ordered
from pyspark.sql import Window
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def rows(spark):
    # one group holds most rows, one is null; keys have nulls, few ticks hold many rows
    n = spark.range(3000)
    by = F.when(F.col("id") % 10 < 7, "hot").when(F.col("id") % 10 < 9, F.concat(F.lit("b"), F.col("id") % 3))
    t = F.when(F.col("id") % 50 != 0, F.col("id") * 7919 % 40)
    return n.select("id", by.alias("g"), t.alias("t"), F.when(F.col("id") % 4 != 0, F.col("id") * 31 % 997).alias("v"))


CASES = [("sum", False, False), ("sum", False, True), ("max", True, False), ("max", False, True), ("last", True, False), ("last", True, True)]


@pytest.mark.parametrize("by", [["g"], []])
@pytest.mark.parametrize(("fold", "before", "reverse"), CASES)
def test_running(rows, by, fold, before, reverse):
    order = [F.col("t"), F.col("id")]
    w = Window.partitionBy(*by or [F.lit(0)]).orderBy(*[c.desc() if reverse else c.asc() for c in order]).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    whole = {"sum": F.coalesce(F.sum("v").over(w), F.lit(0)), "max": F.max("v").over(w), "last": F.last("v").over(w)}[fold]
    got = ordered.running(rows, by, order, "x", F.col("v"), fold, before, reverse).select("id", "x").collect()
    assert sorted(got) == sorted(rows.select("id", whole.alias("x")).collect())


def test_numbered(spark, rows):
    got = ordered.numbered(rows, [], [F.col("t"), F.col("id")], "n").orderBy("t", "id").select("n").collect()
    assert [r[0] for r in got] == list(range(1, 3001))
    assert ordered.numbered(rows.limit(0), ["g"], [F.col("id")], "n").collect() == []
    # of equal keys, one range; struct, text and null keys
    same = spark.createDataFrame([(None, "a")] * 40 + [("x", "a")] * 40, "k string, g string")
    assert sorted(r.n for r in ordered.numbered(same, ["g"], [F.col("k")], "n").collect()) == list(range(1, 81))


def test_ranges_share_the_rows(spark, rows):
    """No range holds much more than its part, though one group holds most rows."""
    order = [F.col("t"), F.col("id")]
    cuts = ordered.marks(rows, order, 8)
    key = F.struct(F.col("t").alias("_o0"), F.col("id").alias("_o1"))
    sizes = [r["count"] for r in rows.groupBy(ordered.place(key, cuts)).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * 3000 / 8
