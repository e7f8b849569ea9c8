"""Operator 3: exact top-k inner products.

Method: three-phase uniform threshold.  A score is the sum of partial scores over
`PARTS` blocks of components.  (1) Every task gathers local score lists: for each
query the k largest partial scores of each block, resolved to whole scores.  The
k-th best of all lists is a safe cutoff t, since k rows are known to reach it.
(2) The cutoffs are broadcast; a row whose score is t or more must have a partial
score of t / PARTS or more in some block, and only such entries are collected.
(3) Their remaining partial scores are added, those under t go, and the k best of
what is left are ranked.

Queries go to the tasks in blocks of at most about `QUERY_BLOCK` vectors, so what
is broadcast has a fixed bound; rows stay where they are read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import read_table

PARTS = 4
QUERY_BLOCK = 16_384
ROWS = 1024
QUERIES = 1024
NONE = -(2**62)  # no entry; its negative fits too


def whole(column) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Usable vectors of an Arrow list column by length: row numbers and floor(256 x)."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = column.cast(pa.large_list(pa.float64()))
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    flat = column.flatten()
    bad = ~np.isfinite(pc.fill_null(flat, float("nan")).to_numpy(zero_copy_only=False))
    values = pc.fill_null(flat, 0.0).to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.cumsum(np.maximum(lengths, 0))])
    faults = np.concatenate([[0], np.cumsum(bad)])
    good = (lengths >= 0) & (faults[starts[1:]] == faults[starts[:-1]])
    out = {}
    for n in np.unique(lengths[good]).tolist():
        rows = np.flatnonzero(good & (lengths == n))
        at = starts[rows][:, None] + np.arange(n)[None, :]
        out[n] = rows, np.floor(256 * values[at]).reshape(len(rows), n)
    return good, out


def exact(v: np.ndarray, q: np.ndarray) -> bool:
    """Whether sums of products stay exact in doubles."""
    return v.shape[1] * float(np.abs(v).max(initial=0)) * float(np.abs(q).max(initial=0)) < 2**53


def partials(v: np.ndarray, q: np.ndarray) -> list[np.ndarray]:
    """Partial scores (queries x rows) of each block of components."""
    if not exact(v, q):
        v, q = v.astype(np.int64), q.astype(np.int64)
    return [(q[:, b] @ v[:, b].T).astype(np.int64) for b in np.array_split(np.arange(v.shape[1]), PARTS)]


class Best:
    """The k best (score, then smaller id) of each of n queries so far."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.scores = np.full((n, k), NONE)
        self.ids = np.full((n, k), np.iinfo(np.int64).max)

    def add(self, at: slice, scores: np.ndarray, ids: np.ndarray) -> None:
        """scores, ids: a row for each query of `at`; NONE marks no entry."""
        s = np.concatenate([self.scores[at], scores], 1)
        i = np.concatenate([self.ids[at], ids], 1)
        order = np.lexsort((i, -s), axis=1)[:, : self.k]
        self.scores[at], self.ids[at] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)


def local_lists(best: Best, at: slice, parts: list[np.ndarray], ids: np.ndarray, own: np.ndarray) -> None:
    """Phase 1: rows with the largest partial scores of any block, with whole scores."""
    total = sum(parts)
    k = min(best.k, total.shape[1])
    picked = np.zeros(total.shape, bool)
    for p in parts:
        p = np.where(own, NONE, p)
        np.put_along_axis(picked, np.argpartition(-p, k - 1, axis=1)[:, :k] if k < p.shape[1] else np.broadcast_to(np.arange(k), p.shape), True, 1)
    keep(best, at, np.where(picked & ~own, total, NONE), ids)


def sufficient(best: Best, at: slice, parts: list[np.ndarray], ids: np.ndarray, own: np.ndarray, cutoff: np.ndarray) -> None:
    """Phases 2 and 3 in a task: entries that can reach the cutoff, resolved."""
    t = cutoff[:, None]
    uniform = -(-t // PARTS)
    may = np.zeros(own.shape, bool)
    for p in parts:
        may |= p >= uniform
    may &= ~own
    total = sum(parts)
    keep(best, at, np.where(may & (total >= t), total, NONE), ids)


def keep(best: Best, at: slice, scores: np.ndarray, ids: np.ndarray) -> None:
    """Adds a block's entries; each query's k best of the block are exact, ties to smaller ids (ids ascend)."""
    if scores.shape[1] > best.k:
        order = np.argsort(-scores, axis=1, kind="stable")[:, : best.k] if (scores != NONE).mean() > 0.05 else sparse_best(scores, best.k)
        best.add(at, np.take_along_axis(scores, order, 1), ids[order])
    else:
        best.add(at, scores, np.broadcast_to(ids, scores.shape))


def sparse_best(scores: np.ndarray, k: int) -> np.ndarray:
    """Columns of each row's k best entries (earlier first in a tie), where few entries are set."""
    r, c = np.nonzero(scores != NONE)
    order = np.lexsort((c, -scores[r, c], r))
    r, c = r[order], c[order]
    rank = np.arange(len(r)) - np.searchsorted(r, r)
    out = np.empty((len(scores), k), np.int64)
    blank = np.argmin(scores, 1)  # a column that is not set, if a row has fewer than k
    out[:] = blank[:, None]
    r, c, rank = r[rank < k], c[rank < k], rank[rank < k]
    out[r, rank] = c
    return out


def passed(vectors: DataFrame, queries: dict, k: int, cutoffs: dict | None) -> DataFrame:
    """One pass over all rows: (query_id, vec_id, score) of each task's k best of phase 1, or of phases 2 and 3."""
    sent = vectors.sparkSession.sparkContext.broadcast((queries, cutoffs))

    def run(batches):
        import pyarrow as pa

        queries, cutoffs = sent.value
        best = {n: Best(len(ids), k) for n, (ids, _) in queries.items()}
        for batch in batches:
            every = batch.column(0).to_numpy(zero_copy_only=False)
            known = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            for n, (rows, v) in whole(batch.column(1))[1].items():
                if n not in queries:
                    continue
                ok = known[rows]
                ids, v = every[rows[ok]].astype(np.int64), v[ok]
                order = np.argsort(ids, kind="stable")
                ids, v = ids[order], v[order]
                qids, q = queries[n]
                for i in range(0, len(ids), ROWS):
                    for j in range(0, len(qids), QUERIES):
                        at = slice(j, min(j + QUERIES, len(qids)))
                        own = qids[at][:, None] == ids[i : i + ROWS][None, :]
                        parts = partials(v[i : i + ROWS], q[at])
                        if cutoffs is None:
                            local_lists(best[n], at, parts, ids[i : i + ROWS], own)
                        else:
                            sufficient(best[n], at, parts, ids[i : i + ROWS], own, cutoffs[n][at])
        for n, b in best.items():
            has = b.scores != NONE
            q = np.broadcast_to(queries[n][0][:, None], b.scores.shape)[has]
            i, s = b.ids[has], b.scores[has]
            for a in range(0, len(q), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[a : a + 50_000]) for x in (q, i, s)], names=["query_id", "vec_id", "score"])

    return vectors.mapInArrow(run, "query_id long, vec_id long, score long")


def exact_topk(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """The k best rows of vectors for each of queries (both: vec_id, embedding).

    Score: integer inner product of floor(256 * x); result: query_id, rank, vec_id,
    score, ties to the smaller vec_id.  A row with the query's own id is no candidate.
    Rows with a null id, a null vector, or null or non-finite components take no
    part; vectors of different lengths have no score; a candidate row that is
    repeated counts as often; repeated queries are one, of different usable
    vectors the least as an array; other columns play no part.
    No usable query, or no candidate, gives no rows."""
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    usable = F.forall("embedding", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    wanted = queries.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).where("vec_id is not null").where(usable).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    blocks = max(1, -(-wanted.count() // QUERY_BLOCK))
    out = []
    for b in range(blocks):
        part = wanted.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).toArrow()
        found = {n: (part.column(0).to_numpy()[i], q) for n, (i, q) in whole(part.column(1).combine_chunks())[1].items()}
        if not found:
            continue
        lists = passed(rows, found, k, None).groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list("score"), False), k, 1).alias("t")).select("query_id", F.get("t", F.lit(0)).alias("t"))
        safe = {r["query_id"]: r["t"] for r in lists.collect() if r["t"] is not None}
        cutoffs = {n: np.array([safe.get(int(i), NONE + PARTS) for i in ids], np.int64) for n, (ids, _) in found.items()}
        out.append(passed(rows, found, k, cutoffs))
    if not out:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    every = out[0]
    for o in out[1:]:
        every = every.unionByName(o)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return every.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    return exact_topk(vectors, vectors.where("vec_id % 50 = 0"))


SQL = {
    "op3": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""
}
