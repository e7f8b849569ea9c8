"""Running values over an order, however few groups share it.

A window over one group, or over none, sorts the group in one task.  Here the order is
cut into ranges, a window runs within each range, and what the ranges before amount to
is added: a row for each group and range, which is all that meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Keys sampled for each range; they choose where ranges end, never what is computed.
SAMPLED = 16


def marks(df: DataFrame, order: list[Column], parts: int) -> list[Column]:
    """At most parts - 1 keys that cut df's order into ranges of about equal size (runs a job).

    The keys of least hash are a uniform sample, the same in every run, of at most SAMPLED * parts."""
    keys = df.select(*[c.alias(f"_o{i}") for i, c in enumerate(order)])
    taken = keys.orderBy(F.xxhash64(*keys.columns)).limit(parts * SAMPLED).orderBy(*keys.columns).collect()
    cuts = list(dict.fromkeys(tuple(r) for r in taken[SAMPLED::SAMPLED]))
    return [F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(cut, keys.schema, strict=True)]) for cut in cuts]


def place(key: Column, cuts: list[Column]) -> Column:
    """How many of the ascending cuts are at most key, by halving."""
    if not cuts:
        return F.lit(0)
    every = F.array(*cuts)
    steps = F.array(*[F.lit(1 << s) for s in reversed(range(len(cuts).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda low, s: F.when(F.get(every, low + s - 1) <= key, low + s).otherwise(low))


def running(df: DataFrame, by: list[str], order: list[Column], name: str, value: Column, fold: str = "sum", before: bool = False, reverse: bool = False) -> DataFrame:
    """df with `name`: value folded (sum, max or last) over the rows of its group up to it, or before it.

    order: the group's order, ascending and nulls first, or all of it reversed; rows that
    are equal in it have no defined order.  Null groups are one group.  A sum over nothing
    is 0, a max or last null; last takes nulls as they are.  df is read three times."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = marks(df, order, parts)
    key = F.struct(*[c.alias(f"_o{i}") for i, c in enumerate(order)])
    cut = df.withColumns({"_value": F.struct(value.alias("v")) if fold == "last" else value, "_range": place(key, cuts)})
    turned = [c.desc() if reverse else c.asc() for c in order]
    latest = (F.min_by if reverse else F.max_by)("_value", key)
    whole = {"sum": F.sum("_value"), "max": F.max("_value"), "last": latest}[fold]
    over = {"sum": F.sum, "max": F.max, "last": F.last}[fold]
    first = Window.unboundedPreceding

    totals = cut.groupBy(*[F.col(b).alias(f"_b{i}") for i, b in enumerate(by)], F.col("_range").alias("_r")).agg(whole.alias("_whole"))
    groups = [f"_b{i}" for i in range(len(by))]
    ranges = Window.partitionBy(*groups or [F.lit(0)]).orderBy(F.desc("_r") if reverse else F.asc("_r"))  # a row for each range
    carried = totals.select(*groups, "_r", over("_whole").over(ranges.rowsBetween(first, -1)).alias("_carried"))

    rows = Window.partitionBy(*by, "_range").orderBy(*turned).rowsBetween(first, -1 if before else 0)
    found = cut.withColumn("_here", over("_value").over(rows))
    same = F.col("_range") == F.col("_r")
    for i, b in enumerate(by):
        same = same & F.col(b).eqNullSafe(F.col(f"_b{i}"))
    found = found.join(carried if by else F.broadcast(carried), same, "left")  # without groups a row for each range
    here, there = F.col("_here"), F.col("_carried")
    both = {"sum": F.coalesce(here, F.lit(0)) + F.coalesce(there, F.lit(0)), "max": F.greatest(here, there), "last": F.coalesce(here, there)["v"] if fold == "last" else None}[fold]
    return found.select(*[F.col(c) for c in df.columns if c != name], both.alias(name))


def numbered(df: DataFrame, by: list[str], order: list[Column], name: str) -> DataFrame:
    """df with each row's place (from 1) in its group's order."""
    return running(df, by, order, name, F.lit(1).cast("long"))
