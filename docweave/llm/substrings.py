"""Operator 5: removal of repeated word passages.

Method: De Bruijn compaction.  The k-word windows are the edges of a graph whose
nodes are the (k-1)-word sequences between them.  Every window is filed under its
minimiser, the least hash among its seeds of `SEED_WORDS` words, which equal windows
share; consecutive windows of one minimiser make a short path.  Paths of equal words are
one (an aggregate compacts them, whatever the number of their sources); a
path whose minimiser has no other path does not branch and is taken whole, and only
where paths of one minimiser differ are their edges compared one by one.  Then joins
compact along the graph: a repeated path that all its occurrences leave for one same
path, which all its occurrences enter from it, is joined with it, and pointers double
until every chain without branches has its head.  Each path keeps the coordinates of
its first source: a window is a repeat where its coordinates are not those of the first.
Occurrences of one chain on one diagonal to a source are a span, and the words at the
span's own and at the source's coordinates are compared by a digest before any goes.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import Powers, WordHasher, bitmap, buffers, discard, materialize, mix, read_table, signed, small_batches, space_words, span_hashes, utf8

WINDOW = 20
SEED_WORDS = 8
#: Minimisers that a task holds before it gives them out.
HELD = 1_000_000
#: Sizes of the bitmaps that spare rows a join; any size gives the same result.  The first
#: grows with what it holds, up to 64 MB.
FILTER_BITS, MOST_BITS = 26, 29
ID_BITS = 24


def minimisers(h: np.ndarray, first: np.ndarray, window: int, hasher: WordHasher) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Paths of consecutive windows of one minimiser place, for words h of texts that begin at `first`:
    the first word, the number of windows, and the minimiser's word."""
    seed = min(SEED_WORDS, window)
    grams = hasher.ngrams(h, seed)
    span = window - seed + 1
    n = len(h) - window + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3
    best, place = grams[:n].copy(), np.arange(n)
    for d in range(1, span):  # a tie goes to the earlier seed
        better = grams[d : d + n] < best
        best[better] = grams[d : d + n][better]
        place[better] = np.flatnonzero(better) + d
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    valid = text[:n] == text[window - 1 : window - 1 + n]
    new = valid.copy()
    new[1:] &= ~(valid[:-1] & (place[1:] == place[:-1]))
    start = np.flatnonzero(new)
    # a path ends before the next one begins, or where its text has no window left
    last_valid = np.flatnonzero(valid)
    ends = np.append(start[1:], n)
    counts = np.searchsorted(last_valid, ends) - np.searchsorted(last_valid, start)
    return start, counts, place[start]


def paths_of(texts: list[bytes], window: int, hasher: WordHasher):
    """Of each path of texts: minimiser hash, hash of all its words, the row, the
    first word within the row, the number of windows, the words' hashes and where it
    begins among them; a number of the path, and those of its neighbours (0 for none)."""
    h, text, _, _, first = hasher.words(texts)
    start, n, place = minimisers(h, first, window, hasher)
    seeds = hasher.ngrams(h, min(SEED_WORDS, window))
    words = span_hashes(h, start, start + n - 1 + window, hasher.grams.setdefault(2, Powers(0xA0761D6478BD642F)))
    row = text[start] if len(start) else start
    mh = mix(seeds[place] ^ np.uint64(0xE7037ED1A0B428DB))
    pid = mix(mh ^ words * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    ahead, before = np.zeros((2, len(pid)), np.uint64)
    joined = np.flatnonzero((row[1:] == row[:-1]) & (start[1:] == start[:-1] + n[:-1]))
    ahead[joined], before[joined + 1] = pid[joined + 1], pid[joined]
    return mh, words, row, start - first[row], n, h, start, pid, ahead, before


def common_minimisers(docs: DataFrame, window: int) -> DataFrame:
    """mh: hashes of minimisers that more than one path has."""
    hasher = WordHasher(space_words())

    def run(batches):
        import pyarrow as pa

        held, size = [], 0

        def flush():
            mh, n = np.unique(np.concatenate(held), return_counts=True)
            for i in range(0, len(mh), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(signed(mh[i : i + 100_000])), pa.array(n[i : i + 100_000])], names=["mh", "n"])

        for batch in batches:
            texts = utf8(batch.column(0))
            for i, j in buffers(texts):
                mh = paths_of(texts[i:j], window, hasher)[0]
                held.append(mh)
                size += len(mh)
                if size >= HELD:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    counted = docs.select("text").mapInArrow(run, "mh long, n long").groupBy("mh").agg(F.sum("n").alias("n"))
    return materialize(counted.where("n > 1").select("mh"), "minimisers")


PATH = "mh long, ch long, doc_id long, key long, start int, n int, pid long, ahead long, before long, edges binary"


def repeated_paths(docs: DataFrame, common: DataFrame, window: int) -> DataFrame:
    """Paths whose minimiser may be in common: a path that only shares its place in the bitmap is alone and comes to nothing."""
    hasher = WordHasher(space_words())
    n_bits = max(FILTER_BITS, min(MOST_BITS, common.count().bit_length() + 3))
    size = 1 << n_bits
    places = common.select(F.col("mh").bitwiseAND(size - 1).alias("p"))
    sent = docs.sparkSession.sparkContext.broadcast(bitmap(places, n_bits).tobytes())

    def run(batches):
        import pyarrow as pa

        bits = np.frombuffer(sent.value, np.uint8)
        for batch in batches:
            texts = utf8(batch.column(2))
            for i, j in buffers(texts):
                mh, ch, row, start, n, h, at, *ids = paths_of(texts[i:j], window, hasher)
                p = mh & np.uint64(size - 1)
                keep = np.flatnonzero((bits[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1)
                if not len(keep):
                    continue
                edges = hasher.ngrams(h, window, salt=1)
                blobs = [edges[a : a + k].tobytes() for a, k in zip(at[keep].tolist(), n[keep].tolist(), strict=True)]
                which = pa.array(row[keep] + i)
                yield pa.RecordBatch.from_arrays([pa.array(signed(mh[keep])), pa.array(signed(ch[keep])), batch.column(0).take(which), batch.column(1).take(which), pa.array(start[keep].astype(np.int32)), pa.array(n[keep].astype(np.int32)), *(pa.array(signed(x[keep])) for x in ids), pa.array(blobs, pa.binary())], names=[c.split()[0] for c in PATH.split(", ")])

    return materialize(docs.select("doc_id", "key", "text").mapInArrow(run, PATH), "paths")


def on_bitmap(rows: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """Rows whose first column may be in column of keys."""
    size = 1 << FILTER_BITS
    sent = rows.sparkSession.sparkContext.broadcast(bitmap(keys.select(F.col(column).bitwiseAND(size - 1).alias("p")), FILTER_BITS).tobytes())

    def run(batches):
        import pyarrow as pa

        bits = np.frombuffer(sent.value, np.uint8)
        for batch in batches:
            p = batch.column(0).to_numpy() & (size - 1)
            yield batch.filter(pa.array((bits[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1))

    return rows.mapInArrow(run, rows.schema)


def explode_edges(batches):
    import pyarrow as pa

    for batch in batches:
        mh, ch, doc, start, blobs = (batch.column(k) for k in range(5))
        hashes = [np.frombuffer(b, np.int64) for b in blobs.to_pylist()]
        n = np.array([len(x) for x in hashes], np.int64)
        if not n.sum():
            continue
        row = np.repeat(np.arange(len(n)), n)
        offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        which = pa.array(row)
        yield pa.RecordBatch.from_arrays([mh.take(which), pa.array(np.concatenate(hashes)), ch.take(which), pa.array(offset.astype(np.int32)), doc.take(which), pa.array(start.to_numpy()[row].astype(np.int64) + offset)], names=["mh", "edge", "ch", "offset", "doc_id", "at"])


def repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Repeated windows of docs (doc_id, key, text): doc_id, key, start (in words), n
    (windows), and either flags (bit i: the window at start + i is a repeat) or, of a span
    whose windows all are, flags null and check: the digest of the source's words."""
    assert window <= 60 + SEED_WORDS
    paths = repeated_paths(docs, common_minimisers(docs, window), window)
    coordinate = F.struct("doc_id", "start", "key")
    # A path's only neighbour on each side, where every occurrence has that one.
    only = lambda c: F.when((F.min(c) == F.max(c)) & (F.min(c) != 0), F.min(c)).alias(c)
    compact = materialize(paths.groupBy("mh", "ch").agg(F.min(coordinate).alias("first"), F.max("n").alias("n"), F.count("*").alias("c"), F.max("pid").alias("pid"), only("ahead"), only("before")), "compact")
    branching = materialize(compact.groupBy("mh").agg(F.count("*").alias("paths")).where("paths > 1").select("mh"), "branching")
    split = compact.join(branching, "mh").select("mh", "ch", F.col("first.doc_id").alias("doc_id"), F.col("first.start").alias("start"))
    split = materialize(split, "split")
    edges = on_bitmap(paths.select("mh", "ch", "doc_id", "start", "edges"), branching, "mh").join(split, ["mh", "ch", "doc_id", "start"]).dropDuplicates(["mh", "ch"]).select("mh", "ch", "doc_id", "start", "edges")
    edges = materialize(edges.mapInArrow(explode_edges, "mh long, edge long, ch long, offset int, doc_id long, at long"), "edges")
    earliest = materialize(edges.groupBy("mh", "edge").agg(F.min(F.struct("doc_id", "at")).alias("e"), F.count("*").alias("c")).where("c > 1").drop("c"), "earliest")
    later = edges.join(earliest, ["mh", "edge"]).where(F.struct("doc_id", "at") > F.col("e"))
    masks = materialize(later.groupBy("mh", "ch").agg(F.bit_or(F.expr("shiftleft(1L, offset)")).alias("mask")), "masks")
    known = compact.join(masks, ["mh", "ch"], "left").where("c > 1 or mask is not null").join(chains(compact.where("c > 1")), "pid", "left")
    source = [F.col("first.doc_id").alias("source_id"), F.col("first.start").alias("source_start"), F.col("first.key").alias("source_key")]
    known = materialize(known.select("mh", "ch", *source, F.coalesce("mask", F.lit(0).cast("long")).alias("mask"), F.coalesce("head", "pid").alias("head"), F.coalesce("dist", F.lit(0)).cast("long").alias("dist")), "known")
    every = F.expr("shiftleft(1L, n)") - 1
    is_first = (F.col("doc_id") == F.col("source_id")) & (F.col("start") == F.col("source_start"))
    found = paths.select("mh", "ch", "doc_id", "key", "start", "n").join(known, ["mh", "ch"]).withColumn("flags", F.when(is_first, F.col("mask")).otherwise(every)).where("flags <> 0")
    found = found.select("doc_id", "key", "start", "n", "flags", "source_id", "source_start", "source_key", "head", "dist", (F.col("flags") == every).alias("whole"))
    if docs.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").limit(1).count():  # rows of one id may be equal
        found = found.dropDuplicates(["doc_id", "key", "start"])
    found = materialize(found, "repeats")
    discard(paths, compact, branching, split, edges, earliest, masks, known)
    spans = materialize(on_chains(found.where("whole").drop("flags", "whole")), "chained")
    checks = digests(docs, spans, window)
    of_source = ["source_id", "source_key", "source_start", "n"]
    out = spans.join(checks, of_source).select("doc_id", "key", "start", "n", F.lit(None).cast("long").alias("flags"), "check")
    single = found.where("not whole").select("doc_id", "key", "start", F.col("n").cast("long").alias("n"), "flags", F.lit(None).cast("binary").alias("check"))
    out = materialize(out.unionByName(single), "spans")
    discard(found, spans, checks)
    return out


def chains(paths: DataFrame) -> DataFrame:
    """pid, head, dist: of paths (pid, n, ahead, before) that continue another one, the head of their chain and the windows before them.

    A path continues another where each is the other's only neighbour on that side."""
    ahead = paths.where("ahead is not null").select(F.col("pid").alias("head"), F.col("n").cast("long").alias("dist"), F.col("ahead").alias("pid"))
    behind = paths.where("before is not null").select("pid", F.col("before").alias("head"))
    heads = materialize(ahead.join(behind, ["pid", "head"]).select("pid", "head", "dist"), "heads")
    for _ in range(40):  # doubling: more than any text's length; no chain is a circle, for the last occurrence on one leaves it
        on = heads.select(F.col("pid").alias("head"), F.col("head").alias("further"), F.col("dist").alias("more"))
        moved = heads.join(on, "head", "left").select("pid", F.coalesce("further", "head").alias("head"), (F.col("dist") + F.coalesce("more", F.lit(0))).alias("dist"), F.col("further").isNotNull().alias("moved"))
        moved = materialize(moved, "heads")
        discard(heads)
        heads = moved
        if not heads.where("moved").limit(1).count():
            break
    return heads.drop("moved")


def on_chains(found: DataFrame) -> DataFrame:
    """Spans (doc_id, key, start, n, source_id, source_key, source_start) of occurrences of whole repeated paths: those
    of one chain that stand one behind the other, here and at their source."""
    line = ["doc_id", "key", "head", "source_id", "source_key", "at", "source_at"]
    found = found.withColumns({"at": F.col("start") - F.col("dist"), "source_at": F.col("source_start") - F.col("dist")})
    groups = found.groupBy(*line).agg(F.min("start").alias("start"), F.sum("n").alias("n"), F.max(F.col("start") + F.col("n")).alias("end"), F.min("source_start").alias("source_start"))
    groups = materialize(groups, "lines")
    columns = ["doc_id", "key", "start", "n", "source_id", "source_key", "source_start"]
    broken = groups.where("end - start <> n")  # a path between them has another source
    alone = found.join(broken.select(*line), line, "left_semi").select(*columns[:3], F.col("n").cast("long").alias("n"), *columns[4:])
    return groups.where("end - start = n").select(*columns).unionByName(alone)


def digest(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def digests(docs: DataFrame, spans: DataFrame, window: int) -> DataFrame:
    """check: the digest of the words at the source's coordinates of each span."""
    asked = spans.select("source_id", "source_key", "source_start", "n").distinct().groupBy("source_id", "source_key").agg(F.collect_list(F.struct("source_start", "n")).alias("asked"))
    asked = materialize(asked, "asked")
    place = F.xxhash64("source_id").bitwiseAND((1 << ID_BITS) - 1)
    sent = docs.sparkSession.sparkContext.broadcast(bitmap(asked.select(place.alias("p")), ID_BITS).tobytes())

    def wanted(batches):
        import pyarrow as pa

        bits = np.frombuffer(sent.value, np.uint8)
        for batch in batches:
            p = batch.column(3).to_numpy()
            hit = pa.array((bits[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1)
            yield pa.RecordBatch.from_arrays([c.filter(hit) for c in batch.columns[:3]], names=["source_id", "source_key", "text"])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ids, keys, texts, asked = (batch.column(k) for k in range(4))
            for i in range(batch.num_rows):
                words, spans = texts[i].as_py().encode().split(), asked[i].as_py()
                found = [digest(words[x["source_start"] : x["source_start"] + x["n"] + window - 1]) for x in spans]
                which = pa.array(np.full(len(spans), i))
                yield pa.RecordBatch.from_arrays([ids.take(which), keys.take(which), pa.array([x["source_start"] for x in spans], pa.int32()), pa.array([x["n"] for x in spans], pa.int64()), pa.array(found, pa.binary())], names=["source_id", "source_key", "source_start", "n", "check"])

    rows = docs.select(F.col("doc_id").alias("source_id"), F.col("key").alias("source_key"), "text")
    rows = rows.withColumn("p", place).mapInArrow(wanted, "source_id long, source_key long, text string")
    found = rows.join(asked, ["source_id", "source_key"]).select("source_id", "source_key", "text", "asked")
    found = materialize(found.mapInArrow(run, "source_id long, source_key long, source_start int, n long, check binary").distinct(), "digests")
    discard(asked)
    return found


def covered(words: list[bytes], spans: list[dict], window: int) -> np.ndarray:
    """Words that a repeated window covers; a span counts only if its words are the source's."""
    n_words = len(words)
    edge = np.zeros(n_words + 1, np.int64)
    for x in spans:
        start, flags = x["start"], x["flags"]
        if flags is None:
            end = start + x["n"] + window - 1
            if digest(words[start:end]) == x["check"]:
                edge[start] += 1
                edge[end] -= 1
        else:
            for i in range(x["n"]):
                if flags >> i & 1:
                    edge[start + i] += 1
                    edge[start + i + window] -= 1
    return np.cumsum(edge[:-1]) > 0


def kept_words(text: bytes, spans: list[dict] | None, window: int) -> tuple[int, list[bytes]]:
    """The number of words, and those that stay."""
    words = text.split()  # of bytes: exactly space and \x09-\x0d
    if not spans:
        return len(words), words
    gone = covered(words, spans, window)
    return len(words), [w for w, g in zip(words, gone.tolist(), strict=True) if not g]


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and kept (kept words, joined by one space) of docs.

    A word goes if a window of `window` consecutive words that covers it starts
    earlier too (smaller doc_id, or the same and an earlier start), judged on the
    input.  Words are runs of other than ASCII white space.  Null and empty texts
    have none; rows with null ids lose nothing and are no source; rows that share an
    id are one document, and repeated rows keep or lose the same words; other columns
    play no part; an empty table gives no rows."""
    return finish(docs, window, "kept string", lambda b: b.decode("utf-8", "replace"))


def finish(docs: DataFrame, window: int, column: str, of) -> DataFrame:
    with small_batches(docs.sparkSession):
        return removed(docs, window, column, of)


def removed(docs: DataFrame, window: int, column: str, of) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), F.col("text").cast("string").alias("text"))
    found = repeats(rows.where("doc_id is not null and text is not null"), window)
    lists = found.groupBy("doc_id", "key").agg(F.collect_list(F.struct("start", "n", "flags", "check")).alias("spans"))
    lists = materialize(lists.select(F.col("doc_id").alias("r_id"), F.col("key").alias("r_key"), "spans"), "lists")
    discard(found)
    # Rows whose id is not in a bitmap of fixed size have no repeats; only the others need the join.
    place = F.xxhash64("doc_id").bitwiseAND((1 << ID_BITS) - 1)
    sent = docs.sparkSession.sparkContext.broadcast(bitmap(lists.select(F.xxhash64("r_id").bitwiseAND((1 << ID_BITS) - 1).alias("p")), ID_BITS).tobytes())
    result = f"doc_id long, n_words long, n_removed long, {column}"

    def marked(batch):
        bits = np.frombuffer(sent.value, np.uint8)
        p = batch.column(3).to_numpy()
        return (bits[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1

    def to_join(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(marked(batch))) for c in batch.columns[:3]], names=batch.schema.names[:3])

    def rows_of(ids, texts, spans):
        import pyarrow as pa

        for at in range(0, len(ids), 500):
            part = [x[at : at + 500] for x in (texts, spans)]
            kept = [kept_words(b"" if t is None else t.encode(), s, window) for t, s in zip(*(x.to_pylist() for x in part), strict=True)]
            yield pa.RecordBatch.from_arrays([ids[at : at + 500], pa.array([n for n, _ in kept], pa.int64()), pa.array([n - len(k) for n, k in kept], pa.int64()), pa.array([of(b" ".join(k)) for _, k in kept], pa.string())], names=["doc_id", "n_words", "n_removed", column.split()[0]])

    def alone(batches):
        import pyarrow as pa

        for batch in batches:
            ids, texts = (batch.column(k).filter(pa.array(~marked(batch))) for k in (0, 2))
            yield from rows_of(ids, texts, pa.nulls(len(ids)))

    def cut(batches):
        for batch in batches:
            yield from rows_of(*batch.columns)

    placed = rows.withColumn("p", place)
    same = (F.col("doc_id") == F.col("r_id")) & (F.col("key") == F.col("r_key"))
    joined = placed.mapInArrow(to_join, "doc_id long, key long, text string").join(lists, same, "left").select("doc_id", "text", "spans")
    out = materialize(placed.mapInArrow(alone, result).unionByName(joined.mapInArrow(cut, result)), "kept")
    discard(lists)
    return out


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of without_repeats: a hash in place of the kept words."""
    return finish(read_table(spark, sf_dir, "documents"), WINDOW, "kept_sha256 string", lambda b: hashlib.sha256(b).hexdigest())


SQL = {
    "op5": """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, s, array_to_string(w[s + 1 : s + 20], ' ') AS k FROM d, unnest(range(0, greatest(len(w) - 19, 0))) AS t(s)),
repeats AS (SELECT doc_id, s FROM windows QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, s) > 1),
gone AS (SELECT DISTINCT doc_id, s + o AS i FROM repeats, unnest(range(0, 20)) AS u(o)),
words AS (SELECT doc_id, i, w[i + 1] AS x FROM d, unnest(range(0, len(w))) AS t(i)),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS k, count(*) AS n FROM words LEFT JOIN gone USING (doc_id, i) WHERE gone.doc_id IS NULL GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""
}
