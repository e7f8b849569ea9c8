"""Operator 6: exact n-gram Jaccard join of documents.

Method: signature trees.  A block's documents are leaves of a tree whose nodes
hold the OR of their leaves' token bitmaps and the range of their set sizes.  Two
trees (or one with itself) are traversed together; a pair of nodes is pruned when
the largest overlap that its bitmaps and sizes allow is too small, or when all of
its documents are already linked with each other.  Pairs of leaves that remain are
compared exactly.

Two exact counts over packed shingles decide which documents meet.  First, a
document with more shingles of its own than a link allows to differ can have no link
and takes no further part.  The rest is put into blocks, likely partners together:
which document is where changes the work, not the links.  Second, after each block's
tree is traversed with itself, a document visits every other block that holds as many of
its shingles as a link needs, and is traversed against that block's tree.

Documents with equal sets are one class; only its smallest id is compared.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import Texts, WordHasher, bitmap, buffers, connected_components, discard, materialize, mix, read_table, signed, space_words, utf8

#: Shingles that a task holds before it gives them out, of a bucket (about), of a block (about).
HELD = 1_000_000
BUCKET = 1_000_000
BLOCK = 2_000_000
#: Minimum hashes of a band, and bands: documents that share a band are put into one block.
ROWS, BANDS = 3, 8
#: A shingle of more blocks counts for every block, which can only add a visit.
SPREAD = 16
FILTER_BITS = 24
FANOUT = 8
#: Beyond so many buckets a task's packed counts would hold few shingles each; then shingles travel as rows.
PACKED = 2048
#: Bits of all leaves of a tree, at most (128 MB).
LEAF_BITS = 1 << 30


# ------------------------------------------------------------ shingles


def shingle_sets(texts: list[bytes], k: int, hasher: WordHasher) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct k-word shingles of each text, sorted by text and hash; and where each text's begin.

    A text with fewer than k words has its whole sequence as one shingle."""
    h, _, _, _, first = hasher.words(texts)
    words = np.diff(first)
    grams = hasher.ngrams(h, k)
    n = np.maximum(words - k + 1, 0)
    owner = np.repeat(np.arange(len(texts)), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[:-1], n)
    values = grams[at]
    short = np.flatnonzero((words > 0) & (words < k))
    if len(short):
        values = np.concatenate([values, [hasher.ngrams(h[first[i] : first[i + 1]], int(words[i]))[0] for i in short]])
        owner = np.concatenate([owner, short])
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[new], owner[new]
    return values, np.searchsorted(owner, np.arange(len(texts) + 1))


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n and two fingerprints of each row's set."""
    hasher = WordHasher(space_words(), lower=True)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = utf8(batch.column(1))
            for i, j in buffers(texts):
                values, cuts = shingle_sets(texts[i:j], k, hasher)
                sums = [np.concatenate([[0], np.cumsum(v, dtype=np.uint64)]).astype(np.uint64) for v in (values, mix(values + np.uint64(1)))]
                f, g = (signed(mix(s[cuts[1:]] - s[cuts[:-1]])) for s in sums)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(cuts)), pa.array(f), pa.array(g)], names=["doc_id", "n", "f", "g"])

    return docs.mapInArrow(run, "doc_id long, n long, f long, g long")


# ------------------------------------------------------ who meets whom


class Union:
    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        root = x
        while (up := self.up.get(root, root)) != root:
            root = up
        while x != root:
            self.up[x], x = root, self.up.get(x, x)
        return root

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        pairs = [(x, r) for x in list(self.up) if (r := self.find(x)) != x]
        return np.array([p[0] for p in pairs], np.int64), np.array([p[1] for p in pairs], np.int64)


def of_texts(k: int):
    """Reads (doc_id, text, ...) batches as ids, shingle hashes and where each row's begin."""
    hasher = WordHasher(space_words(), lower=True)

    def read(batch):
        texts = utf8(batch.column(1))
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for i, j in buffers(texts):
            values, cuts = shingle_sets(texts[i:j], k, hasher)
            yield ids[i:j], values, cuts

    return read


def of_sets(batch):
    """The same of (doc_id, shingles) batches."""
    ids = batch.column(0).to_numpy(zero_copy_only=False)
    every = Texts(batch.column(1))
    for i, j in buffers(every):
        blobs = every[i:j]
        cuts = np.concatenate([[0], np.cumsum([len(b) // 8 for b in blobs])])
        yield ids[i:j], np.frombuffer(b"".join(blobs), np.uint64), cuts


def may_differ(n: np.ndarray, percent: int) -> np.ndarray:
    """How many of n shingles, at most, a linked set can lack."""
    return (n + 100 * n // percent) * (100 - percent) // (100 + percent)


def survivors(rows: DataFrame, read, percent: int, shingles: int) -> DataFrame:
    """doc_id of rows that have no more shingles of their own than a link allows.

    Shingles travel packed: for each task and bucket, sorted values and the number of
    the row in the task.  A bucket's task finds the values that stand once and sends
    each source the counts by row.  Values are hashes cut to a few bits more than
    tell the corpus's shingles apart; a clash can only keep a row."""
    n_buckets = int(max(1, -(-shingles // BUCKET)))
    bits = min(60, max(24, int(shingles).bit_length() + 5))

    def scan(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        source = TaskContext.get().partitionId() << 24
        ids, values, owner, n_rows, held = [], [], [], 0, 0

        def flush():
            doc = np.concatenate(ids)
            u = np.concatenate(values) >> np.uint64(64 - bits)
            o = np.concatenate(owner)
            n = np.bincount(o, minlength=len(doc)).astype(np.int64)
            # By bucket, then value: one number has both, and a text's own order is not needed.
            space = (1 << bits) // n_buckets + 1
            both = (u % np.uint64(n_buckets)) * np.uint64(space) + u // np.uint64(n_buckets)
            order = np.argsort(both, kind="stable")
            both = both[order]
            ends = np.searchsorted(both, np.arange(n_buckets + 1).astype(np.uint64) * np.uint64(space))
            names = ["bucket", "source", "rows", "values", "owners"]
            for c in range(n_buckets):
                at = order[ends[c] : ends[c + 1]]
                if len(at):
                    steps = np.diff(both[ends[c] : ends[c + 1]], prepend=np.uint64(c * space))
                    steps = steps.astype(np.uint16 if steps.max() < 1 << 16 else np.uint32 if steps.max() < 1 << 32 else np.uint64)
                    yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([source], pa.int64()), pa.array([len(at)], pa.int32()), pa.array([steps.tobytes()], pa.binary()), pa.array([o[at].tobytes()], pa.binary())], names=names)
            yield pa.RecordBatch.from_arrays([pa.array([source % n_buckets], pa.int32()), pa.array([source], pa.int64()), pa.array([-1], pa.int32()), pa.array([doc.astype(np.int64).tobytes()], pa.binary()), pa.array([n.tobytes()], pa.binary())], names=names)

        for batch in batches:
            for doc, v, cuts in read(batch):
                for i in range(0, len(doc), 1 << 15):
                    j = min(len(doc), i + (1 << 15))
                    if n_rows + j - i > 1 << 16 or held >= HELD:
                        yield from flush()
                        source, n_rows, held = source + 1, 0, 0
                        ids, values, owner = [], [], []
                    ids.append(doc[i:j])
                    values.append(v[cuts[i] : cuts[j]])
                    owner.append(np.repeat(np.arange(n_rows, n_rows + j - i).astype(np.uint16), np.diff(cuts[i : j + 1])))
                    n_rows, held = n_rows + j - i, held + int(cuts[j] - cuts[i])
        if n_rows:
            yield from flush()

    def once(batches):
        import pyarrow as pa

        names = ["source", "kind", "a", "b"]
        now, parts = None, []

        def bucket_done():
            value = np.concatenate([p[1] for p in parts])
            order = np.argsort(value, kind="stable")
            v = value[order]
            same = np.zeros(len(v) + 1, bool)
            same[1:-1] = v[1:] == v[:-1]
            alone = np.sort(order[~(same[1:] | same[:-1])])
            ends = np.cumsum([0] + [len(p[1]) for p in parts])
            cuts = np.searchsorted(alone, ends)
            for k, (source, _, owners) in enumerate(parts):
                row, n = np.unique(owners[alone[cuts[k] : cuts[k + 1]] - ends[k]], return_counts=True)
                if len(row):
                    n = n.astype(np.uint32)
                    yield pa.RecordBatch.from_arrays([pa.array([source], pa.int64()), pa.array([1], pa.int32()), pa.array([row.tobytes()], pa.binary()), pa.array([(n.astype(np.uint8) if n.max() < 256 else n).tobytes()], pa.binary())], names=names)

        for batch in batches:
            for i in range(batch.num_rows):
                c, source, rows, values, owners = (x[i].as_py() for x in batch.columns)
                if rows < 0:
                    yield pa.RecordBatch.from_arrays([pa.array([source], pa.int64()), pa.array([0], pa.int32()), pa.array([values], pa.binary()), pa.array([owners], pa.binary())], names=names)
                    continue
                if c != now:
                    if parts:
                        yield from bucket_done()
                    now, parts = c, []
                steps = np.frombuffer(values, {2: np.uint16, 4: np.uint32, 8: np.uint64}[len(values) // rows])
                parts.append((source, np.cumsum(steps, dtype=np.int64), np.frombuffer(owners, np.uint16)))
        if parts:
            yield from bucket_done()

    def judge(batches):  # in order of source, its documents first
        import pyarrow as pa

        ids = n = lone = None

        def done():
            keep = (n > 0) & (lone <= may_differ(n, percent))
            return pa.RecordBatch.from_arrays([pa.array(ids[keep])], names=["doc_id"])

        for batch in batches:
            for _, kind, a, b in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if not kind:
                    if ids is not None:
                        yield done()
                    ids, n = np.frombuffer(a, np.int64), np.frombuffer(b, np.int64)
                    lone = np.zeros(len(ids), np.int64)
                    continue
                row = np.frombuffer(a, np.uint16).astype(np.int64)
                lone[row] += np.frombuffer(b, np.uint8 if len(b) == len(row) else np.uint32)
        if ids is not None:
            yield done()

    parts = rows.mapInArrow(scan, "bucket int, source long, rows int, values binary, owners binary").repartition(n_buckets, "bucket").sortWithinPartitions("bucket")
    counts = parts.mapInArrow(once, "source long, kind int, a binary, b binary").repartition("source").sortWithinPartitions("source", "kind")
    return materialize(counts.mapInArrow(judge, "doc_id long").distinct(), "survivors")


def shingle_rows(rows: DataFrame, read, extra: tuple[str, ...] = ()) -> DataFrame:
    """v, doc_id and the columns behind the second of rows: a row per shingle; rows that share an id are told apart by r."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        r = TaskContext.get().partitionId() << 40
        for batch in batches:
            done = 0
            for doc, values, cuts in read(batch):
                n = np.diff(cuts)
                for i in range(0, len(values), 200_000):
                    owner = np.searchsorted(cuts, np.arange(i, min(len(values), i + 200_000)), "right") - 1
                    more = [batch.column(2 + k).take(pa.array(done + owner)) for k in range(len(extra))]
                    yield pa.RecordBatch.from_arrays([pa.array(signed(values[i : i + 200_000])), pa.array(doc[owner].astype(np.int64)), pa.array(r + owner), pa.array(n[owner]), *more], names=["v", "doc_id", "r", "n", *extra])
                done += len(doc)
                r += len(doc)

    return rows.mapInArrow(run, ", ".join(["v long, doc_id long, r long, n long", *(f"{c} long" for c in extra)]))


def most_apart(percent: int) -> Column:
    """may_differ of the column n."""
    return F.expr(f"(n + 100 * n div {percent}) * {100 - percent} div {100 + percent}")


def survivors_by_rows(rows: DataFrame, read, percent: int) -> DataFrame:
    """As `survivors`, with a row per shingle: for corpora of very many buckets."""
    every = shingle_rows(rows, read)
    lone = every.groupBy("v").agg(F.count("*").alias("c"), F.min("r").alias("r")).where("c = 1").groupBy("r").agg(F.count("*").alias("lone"))
    sizes = every.select("r", "doc_id", "n").distinct()
    found = sizes.join(lone, "r", "left").where(F.coalesce("lone", F.lit(0)) <= most_apart(percent))
    return materialize(found.select("doc_id").distinct(), "survivors")


def banded(sets: DataFrame) -> DataFrame:
    """Edges (src, dst) between ids of sets (doc_id, shingles) that share a band of minimum hashes."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for doc, values, cuts in of_sets(batch):
                for b in range(BANDS):
                    sig = np.full(len(doc), b, np.uint64)
                    for r in range(ROWS):
                        low = np.minimum.reduceat(mix(values ^ np.uint64(0x9E3779B97F4A7C15 * (b * ROWS + r + 1) % 2**64)), cuts[:-1])
                        sig = mix(sig * np.uint64(31) + low)
                    yield pa.RecordBatch.from_arrays([pa.array(signed(sig)), pa.array(doc.astype(np.int64))], names=["sig", "doc_id"])

    found = materialize(sets.select("doc_id", "shingles").mapInArrow(run, "sig long, doc_id long").distinct(), "bands")
    low = materialize(found.groupBy("sig").agg(F.min("doc_id").alias("dst"), F.count("*").alias("c")).where("c > 1").drop("c"), "band-lows")
    return found.join(low, "sig").where("doc_id <> dst").select(F.col("doc_id").alias("src"), "dst").distinct()


def in_blocks(payload: DataFrame) -> DataFrame:
    """payload (doc_id, shingles) with its block, from 0; groups of likely partners stay together up to a block's size."""
    blocks = max(1, -(-total(payload) * 4 // (3 * BLOCK)))
    groups = connected_components(banded(payload))
    rows = payload.join(groups, F.col("doc_id") == F.col("id"), "left").select("doc_id", "shingles", F.coalesce("component", "doc_id").alias("g"))
    rows = grouped = materialize(rows, "grouped")
    size = rows.groupBy("g").agg(F.ceil(F.sum(F.octet_length("shingles")) / 8 / BLOCK).alias("cut"))
    rows = rows.join(materialize(size.where("cut > 1"), "large-groups"), "g", "left")
    sub = F.pmod(F.xxhash64("doc_id"), F.coalesce("cut", F.lit(1)))
    block = F.pmod(F.xxhash64("g", sub), F.lit(blocks))
    out = materialize(rows.select(block.alias("block"), "doc_id", "shingles"), "blocks")
    discard(grouped)
    return out


def routes(homes: DataFrame, percent: int) -> DataFrame:
    """doc_id, to: the other blocks that hold as many of a row's shingles as a link needs.

    Shingles travel as in `survivors`, with the blocks of their rows."""
    shingles = total(homes)
    blocks = max(1, -(-shingles * 4 // (3 * BLOCK)))
    n_buckets = int(max(1, -(-shingles // (2 * BUCKET))))  # fewer buckets, fewer partial counts
    bits = min(60, max(24, int(shingles).bit_length() + 5))
    wide = np.int64 if blocks << 16 >= 1 << 31 else np.int32
    names = ["bucket", "source", "rows", "values", "owners", "homes"]

    def scan(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        source = TaskContext.get().partitionId() << 24
        ids, values, owner, home, n_rows, held = [], [], [], [], 0, 0

        def flush():
            doc, at_home = np.concatenate(ids), np.concatenate(home).astype(np.int32)
            u, o = np.concatenate(values) >> np.uint64(64 - bits), np.concatenate(owner)
            bucket = (u % np.uint64(n_buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            ends = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
            for c in range(n_buckets):
                at = order[ends[c] : ends[c + 1]]
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([source], pa.int64()), pa.array([len(at)], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (u[at], o[at], at_home))], names=names)
            n = np.bincount(o, minlength=len(doc)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([source % n_buckets], pa.int32()), pa.array([source], pa.int64()), pa.array([-1], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (doc.astype(np.int64), n, at_home))], names=names)

        for batch in batches:
            block = batch.column(2).to_numpy()
            done = 0
            for doc, v, cuts in of_sets(batch):
                if n_rows and (n_rows + len(doc) > 1 << 16 or held >= HELD):
                    yield from flush()
                    source, n_rows, held = source + 1, 0, 0
                    ids, values, owner, home = [], [], [], []
                ids.append(doc)
                values.append(v)
                owner.append(np.repeat(np.arange(n_rows, n_rows + len(doc)).astype(np.uint16), np.diff(cuts)))
                home.append(block[done : done + len(doc)])
                done, n_rows, held = done + len(doc), n_rows + len(doc), held + len(v)
        if n_rows:
            yield from flush()

    def meet(batches):
        import pyarrow as pa

        out = ["source", "kind", "a", "b", "c"]
        now, parts = None, []

        def row(source, kind, *arrays):
            return pa.RecordBatch.from_arrays([pa.array([source], pa.int64()), pa.array([kind], pa.int32()), *(pa.array([x if isinstance(x, bytes) else x.tobytes()], pa.binary()) for x in arrays)], names=out)

        def bucket_done():
            value = np.concatenate([p[1] for p in parts])
            home = np.concatenate([p[3][p[2]] for p in parts]).astype(np.int64)
            who = np.concatenate([(k << 16) + p[2].astype(np.int64) for k, p in enumerate(parts)])
            order = np.lexsort((home, value))
            value, home, who = value[order], home[order], who[order]
            first = np.ones(len(value), bool)
            first[1:] = value[1:] != value[:-1]
            pair = first.copy()
            pair[1:] |= home[1:] != home[:-1]
            at = np.cumsum(first) - 1  # the number of each entry's value
            n_blocks = np.bincount(at[pair], minlength=at[-1] + 1)
            begin = np.concatenate([[0], np.cumsum(n_blocks)])
            its_blocks = home[pair]
            free = who[n_blocks[at] > SPREAD]
            few = np.flatnonzero((n_blocks[at] > 1) & (n_blocks[at] <= SPREAD))
            n = n_blocks[at[few]]
            to = its_blocks[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[at[few]], n)]
            asker, own = np.repeat(who[few], n), np.repeat(home[few], n)
            found, count = np.unique(asker[to != own] * blocks + to[to != own], return_counts=True)
            lone, lone_count = np.unique(free, return_counts=True)
            for k, (source, _, _, _) in enumerate(parts):
                a, b = np.searchsorted(found, [(k << 16) * blocks, ((k + 1) << 16) * blocks])
                c, d = np.searchsorted(lone, [k << 16, (k + 1) << 16])
                if b > a:
                    yield row(source, 1, (found[a:b] - (k << 16) * blocks).astype(wide), count[a:b].astype(np.uint32), b"")
                if d > c:
                    yield row(source, 2, (lone[c:d] - (k << 16)).astype(np.uint16), lone_count[c:d].astype(np.int32), b"")

        for batch in batches:
            for i in range(batch.num_rows):
                c, source, rows, a, b, h = (x[i].as_py() for x in batch.columns)
                if rows < 0:
                    yield row(source, 0, a, b, h)
                    continue
                if c != now:
                    if parts:
                        yield from bucket_done()
                    now, parts = c, []
                parts.append((source, np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint16), np.frombuffer(h, np.int32)))
        if parts:
            yield from bucket_done()

    def judge(batches):  # in order of source, its documents first
        import pyarrow as pa

        docs, met, free = None, [], None

        def done():
            ids, n, home = docs
            need = n - may_differ(n, percent) - free
            row, to = np.zeros(0, np.int64), np.zeros(0, np.int64)
            if met:
                key, back = np.unique(np.concatenate([m[0] for m in met]), return_inverse=True)
                count = np.bincount(back, np.concatenate([m[1] for m in met]))
                row, to = key // blocks, key % blocks
                hit = (count >= need[row]) & (need[row] > 0)
                row, to = row[hit], to[hit]
            other = to != home[row]
            yield pa.RecordBatch.from_arrays([pa.array(ids[row[other]]), pa.array(to[other])], names=["doc_id", "to"])
            anywhere = ids[(need <= 0) & (n > 0)]
            yield pa.RecordBatch.from_arrays([pa.array(anywhere), pa.array(np.full(len(anywhere), -1))], names=["doc_id", "to"])

        for batch in batches:
            for _, kind, a, b, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if kind == 0:
                    if docs is not None:
                        yield from done()
                    docs = np.frombuffer(a, np.int64), np.frombuffer(b, np.int64), np.frombuffer(c, np.int32)
                    met, free = [], np.zeros(len(docs[0]), np.int64)
                elif kind == 1:
                    met.append((np.frombuffer(a, wide).astype(np.int64), np.frombuffer(b, np.uint32)))
                else:
                    np.add.at(free, np.frombuffer(a, np.uint16), np.frombuffer(b, np.int32))
        if docs is not None:
            yield from done()

    parts = homes.select("doc_id", "shingles", "block").mapInArrow(scan, "bucket int, source long, rows int, values binary, owners binary, homes binary").repartition(n_buckets, "bucket").sortWithinPartitions("bucket")
    counts = parts.mapInArrow(meet, "source long, kind int, a binary, b binary, c binary").repartition("source").sortWithinPartitions("source", "kind")
    found = materialize(counts.mapInArrow(judge, "doc_id long, to long").distinct(), "routes")
    return with_prefixes(homes, found, percent)


def with_prefixes(homes: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """Visits of found (doc_id, to), those of -1 resolved: such a document's shingles are
    nearly all common.  A partner has all but `may_differ` of them, so it has one of any
    may_differ + 1: the document visits the blocks of those that the fewest blocks have."""
    common = materialize(homes.join(found.where("to < 0").select("doc_id"), "doc_id", "left_semi").select("doc_id", "shingles", F.col("block").cast("long").alias("block")), "common")
    if not common.limit(1).count():
        return found
    of_common = shingle_rows(common, of_sets, ("block",)).drop("r")
    wanted = of_common.select("v").distinct()
    held = materialize(shingle_rows(homes.select("doc_id", "shingles", F.col("block").cast("long").alias("block")), of_sets, ("block",)).join(wanted, "v", "left_semi").select("v", F.col("block").alias("to")).distinct(), "held")
    spread = held.groupBy("v").agg(F.count("*").alias("blocks"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("blocks", "v"))  # a document's own shingles
    prefix = of_common.join(spread, "v").withColumn("place", place).where(F.col("place") <= most_apart(percent) + 1)
    visits = prefix.select("v", "doc_id", "block").join(held, "v").where("to <> block").select("doc_id", "to")
    out = materialize(found.where("to >= 0").unionByName(visits).distinct(), "visits")
    discard(found, common, held)
    return out


def routes_by_rows(homes: DataFrame, percent: int) -> DataFrame:
    """As `routes`, with a row per shingle: for corpora of very many buckets."""
    every = shingle_rows(homes.select("doc_id", "shingles", F.col("block").cast("long").alias("block")), of_sets, ("block",)).drop("r")
    held = materialize(every.select("v", F.col("block").alias("to")).distinct(), "held")
    spread = held.groupBy("v").agg(F.count("*").alias("blocks")).where("blocks > 1")
    few = held.join(spread.where(F.col("blocks") <= SPREAD).select("v"), "v")
    met = every.join(few, "v").where("to <> block").groupBy("doc_id", "n", "to").agg(F.count("*").alias("c"))
    free = every.join(spread.where(F.col("blocks") > SPREAD).select("v"), "v").groupBy("doc_id").agg(F.count("*").alias("free"))
    need = F.col("n") - most_apart(percent) - F.coalesce("free", F.lit(0))
    visits = met.join(free, "doc_id", "left").where((need > 0) & (F.col("c") >= need)).select("doc_id", "to")
    anywhere = every.select("doc_id", "n").distinct().join(free, "doc_id").where(need <= 0).select("doc_id", F.lit(-1).cast("long").alias("to"))
    found = materialize(visits.unionByName(anywhere).distinct(), "routes")
    discard(held)
    return with_prefixes(homes, found, percent)


# -------------------------------------------------------------- trees


class Tree:
    """Sets in order of size and content; level 0 holds the leaves, the last one the root."""

    def __init__(self, sets: list[np.ndarray], width: int):
        n = len(sets)
        self.sizes = np.array([len(s) for s in sets])
        leaf = np.zeros((n, width // 64), np.uint64)
        for i, s in enumerate(sets):
            place = s & np.uint64(width - 1)
            np.bitwise_or.at(leaf[i], (place >> np.uint64(6)).astype(np.int64), np.uint64(1) << (place & np.uint64(63)))
        self.bits, self.low, self.high = [leaf], [self.sizes], [self.sizes]
        while len(self.bits[-1]) > 1:
            cuts = np.arange(0, len(self.bits[-1]), FANOUT)
            self.bits.append(np.bitwise_or.reduceat(self.bits[-1], cuts, axis=0))
            self.low.append(np.minimum.reduceat(self.low[-1], cuts))
            self.high.append(np.maximum.reduceat(self.high[-1], cuts))

    def labels(self, label: np.ndarray) -> list[np.ndarray]:
        """The label of all leaves under each node, -1 where they differ."""
        out = [label]
        for level in range(1, len(self.bits)):
            cuts = np.arange(0, len(out[-1]), FANOUT)
            low, high = np.minimum.reduceat(out[-1], cuts), np.maximum.reduceat(out[-1], cuts)
            out.append(np.where(low == high, low, -1))
        return out


def may_link(percent: int, bits_a, low_a, high_a, bits_b, low_b, high_b, leaf_a: bool, leaf_b: bool) -> np.ndarray:
    """Node pairs whose sizes and bitmaps allow a link.

    A link needs an overlap of percent / (100 + percent) of the sum of the sizes.
    Bits that a leaf has and the other node lacks are shingles outside the overlap;
    between inner nodes the common bits bound it only by the sizes."""
    ok = (100 * high_a >= percent * low_b) & (100 * high_b >= percent * low_a)
    most = np.minimum(high_a, high_b)
    if leaf_a:
        most = np.minimum(most, high_a - np.bitwise_count(bits_a & ~bits_b).sum(1, dtype=np.int64))
    if leaf_b:
        most = np.minimum(most, high_b - np.bitwise_count(bits_b & ~bits_a).sum(1, dtype=np.int64))
    if not leaf_a and not leaf_b:  # no common bit, no common shingle
        most = np.where(np.bitwise_count(bits_a & bits_b).sum(1, dtype=np.int64) > 0, most, 0)
    return ok & (most * (100 + percent) >= percent * (low_a + low_b))


def traverse(a: Tree, b: Tree, same: bool, label_a: np.ndarray, label_b: np.ndarray, rows: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of leaves (of a, within rows; of b) that may link and have different labels; with same, each pair once."""
    up_b = b.labels(label_b)
    x = np.asarray(rows)
    y = np.zeros(len(x), np.int64)
    for level in range(len(b.bits) - 1, -1, -1):
        if level < len(b.bits) - 1:
            k = np.minimum(FANOUT, len(b.bits[level]) - y * FANOUT)
            x = np.repeat(x, k)
            y = np.repeat(y * FANOUT, k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
        keep = up_b[level][y] != label_a[x]
        if same:  # a leaf meets earlier leaves only
            keep &= (x >= y * FANOUT**level) if level else (x > y)
        x, y = x[keep], y[keep]
        found = np.zeros(len(x), bool)
        step = max(1, 4_000_000 // a.bits[0].shape[1])
        for i in range(0, len(x), step):
            s = slice(i, i + step)
            found[s] = may_link(percent, a.bits[0][x[s]], a.sizes[x[s]], a.sizes[x[s]], b.bits[level][y[s]], b.low[level][y[s]], b.high[level][y[s]], True, level == 0)
        x, y = x[found], y[found]
    return x, y


def dual(a: Tree, b: Tree, same: bool, label_a: np.ndarray, label_b: np.ndarray, percent: int) -> np.ndarray:
    """Leaves of a that survive the traversal of pairs of inner nodes, from the roots down."""
    up_a, up_b = a.labels(label_a), b.labels(label_b)
    la, lb = len(a.bits) - 1, len(b.bits) - 1
    x, y = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while la > 0:
        if lb > max(0, la):
            k = np.minimum(FANOUT, len(b.bits[lb - 1]) - y * FANOUT)
            x, y = np.repeat(x, k), np.repeat(y * FANOUT, k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
            lb -= 1
        else:
            k = np.minimum(FANOUT, len(a.bits[la - 1]) - x * FANOUT)
            y, x = np.repeat(y, k), np.repeat(x * FANOUT, k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
            la -= 1
        keep = (up_a[la][x] != up_b[lb][y]) | (up_a[la][x] < 0)
        x, y = x[keep], y[keep]
        step = max(1, 4_000_000 // a.bits[0].shape[1])
        found = np.zeros(len(x), bool)
        for i in range(0, len(x), step):
            s = slice(i, i + step)
            found[s] = may_link(percent, a.bits[la][x[s]], a.low[la][x[s]], a.high[la][x[s]], b.bits[lb][y[s]], b.low[lb][y[s]], b.high[lb][y[s]], la == 0, lb == 0)
        x, y = x[found], y[found]
    return np.unique(x)


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """The exact test: 100 * intersection >= percent * union."""
    both = np.concatenate([x, y])
    both.sort()
    i = int((both[1:] == both[:-1]).sum())
    return 100 * i >= percent * (len(x) + len(y) - i)


def block_links(ids: np.ndarray, sets: list[np.ndarray], label: np.ndarray, home: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that join different labels: among home rows, if there are no others; else between guests and home rows.

    Of links within what others already join, none is needed."""
    guests = np.flatnonzero(~home)
    if not home.any():
        return []
    width = 64
    while width < min(1 << 16, 8 * max(map(len, sets))) and 2 * width * len(sets) <= LEAF_BITS:
        width *= 2
    forest = Union()
    out: list[tuple[int, int]] = []

    def build(rows):
        rows = rows[np.lexsort((ids[rows], [int(sets[r][0]) if len(sets[r]) else 0 for r in rows], [len(sets[r]) for r in rows]))]
        return rows, Tree([sets[r] for r in rows], width)

    order, tree = build(np.flatnonzero(home))
    asks, ask = (order, tree) if not len(guests) else build(guests)
    find = lambda rows: np.array([forest.find(int(label[r])) for r in rows], np.int64)
    alive = dual(ask, tree, not len(guests), find(asks), find(order), percent)
    for i in range(0, len(alive), 64):
        rows = alive[i : i + 64]
        x, y = traverse(ask, tree, not len(guests), find(asks), find(order), rows, percent)
        for p, q in zip(asks[x].tolist(), order[y].tolist(), strict=True):
            a, b = int(label[p]), int(label[q])
            if forest.find(a) != forest.find(b) and linked(sets[p], sets[q], percent):
                forest.join(a, b)
                out.append((int(ids[p]), int(ids[q])))
    return out


def tree_links(members: DataFrame, percent: int) -> DataFrame:
    """Links within blocks of members (block, part, doc_id, label, home, shingles); each part of a block is a task's own."""

    def run(batches):
        import pyarrow as pa

        key, held = None, []

        def done():
            ids, label, home, blobs = zip(*held, strict=True)
            found = block_links(np.array(ids), [np.frombuffer(b, np.uint64) for b in blobs], np.array(label), np.array(home), percent) if len(ids) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["src", "dst"])

        for batch in batches:
            for block, part, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (block, part) != key:
                    if held:
                        yield done()
                    key, held = (block, part), []
                held.append(row)
        if held:
            yield done()

    grouped = members.select("block", "part", "doc_id", "label", "home", "shingles").repartition("block", "part").sortWithinPartitions("block", "part", "doc_id")
    return grouped.mapInArrow(run, "src long, dst long")


# ----------------------------------------------------------- operator


def marked(ids: DataFrame) -> np.ndarray:
    """A bitmap of fixed size over a hash of the ids: what is not in it is not in ids."""
    return bitmap(ids.select(F.xxhash64("doc_id").bitwiseAND((1 << FILTER_BITS) - 1).alias("p")), FILTER_BITS)


def has_mark(sent, places: np.ndarray) -> np.ndarray:
    bits = np.frombuffer(sent, np.uint8)
    return (bits[places >> 3] >> (places & 7).astype(np.uint8)) & 1 == 1


def placed(docs: DataFrame, id_column: str = "doc_id") -> tuple[DataFrame, str]:
    """docs with a last column: each id's place in a bitmap of `marked`."""
    name = "_place"
    while name in docs.columns:
        name += "_"
    return docs.withColumn(name, F.xxhash64(F.col(id_column).cast("long")).bitwiseAND((1 << FILTER_BITS) - 1)), name


def side(sent, on_it: bool):
    """Rows with, or without, a mark, less their last column."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            hit = has_mark(sent.value, batch.column(batch.num_columns - 1).to_numpy())
            batch = batch.filter(pa.array(hit == on_it))
            yield pa.RecordBatch.from_arrays(batch.columns[:-1], names=batch.schema.names[:-1])

    return run


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of docs whose doc_id is not in ids.  Rows without a mark stay as they are; only the others need the join."""
    sent = docs.sparkSession.sparkContext.broadcast(marked(ids).tobytes())
    rows, name = placed(docs)
    free, rest = (rows.mapInArrow(side(sent, m), docs.schema) for m in (False, True))
    gone = ids.select(F.col("doc_id").alias(name))
    return free.unionByName(rest.join(gone, rest["doc_id"] == gone[name], "left_anti"))


def wanted_sets(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """doc_id and sorted shingle hashes of docs (doc_id, text) in ids."""
    sent = docs.sparkSession.sparkContext.broadcast(marked(ids).tobytes())
    read = of_texts(k)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            batch = batch.filter(pa.array(has_mark(sent.value, batch.column(2).to_numpy())))
            for doc, values, cuts in read(batch):
                yield pa.RecordBatch.from_arrays([pa.array(doc.astype(np.int64)), pa.array([values[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())], names=["doc_id", "shingles"])

    found = placed(docs)[0].mapInArrow(run, "doc_id long, shingles binary")
    return found.join(ids, "doc_id", "left_semi").where(F.octet_length("shingles") > 0)


def similarity_components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id of each row of docs (doc_id, text).

    Words are runs of other than ASCII white space, A-Z lowered; two documents link
    when 100 * intersection >= percent * union of their sets of distinct k-word
    shingles.  A text with fewer words is one shingle; null and empty texts have
    none and no link.  component_id is the smallest id in reach.  Rows that share an
    id are one document with the links of all; a row with a null id has no links and
    a null component_id; repeated rows stay; other columns play no part; an empty
    table gives no rows."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sets = materialize(sketches(docs, k), "sketches")
    known = sets.where("doc_id is not null and n > 0")
    with_rep = known.join(materialize(known.groupBy("n", "f", "g").agg(F.min("doc_id").alias("rep")), "classes"), ["n", "f", "g"])
    with_rep = materialize(with_rep.select("doc_id", "n", "rep").distinct(), "members")
    copies = materialize(with_rep.where("doc_id <> rep").select(F.col("doc_id").alias("src"), F.col("rep").alias("dst")), "same")
    alone = copies.select(F.col("src").alias("doc_id")).join(with_rep.where("doc_id = rep").select("doc_id"), "doc_id", "left_anti").distinct()
    alone = materialize(alone, "not-first")
    named = docs.where("doc_id is not null")
    shingles = known.agg(F.sum("n")).first()[0] or 0
    plain = shingles > PACKED * BUCKET
    near = survivors_by_rows(named, of_texts(k), percent) if plain else survivors(named, of_texts(k), percent, shingles)
    near = near.join(alone, "doc_id", "left_anti")
    payload = materialize(wanted_sets(named, near, k), "payload")
    homes = in_blocks(payload)
    discard(payload)
    links = tree_links(homes.select("block", F.lit(0).cast("long").alias("part"), "doc_id", F.col("doc_id").alias("label"), F.lit(True).alias("home"), "shingles"), percent)
    links = materialize(links, "links")
    visits = routes_by_rows(homes, percent) if plain else routes(homes, percent)
    if visits.limit(1).count():
        links = links.unionByName(visitors(homes, visits, links, percent))
    joined = connected_components(links.unionByName(copies))
    discard(homes, visits, copies, with_rep, alone)
    return sets.join(joined, sets["doc_id"] == joined["id"], "left").select(sets["doc_id"], F.col("n").alias("n_shingles"), F.coalesce("component", sets["doc_id"]).alias("component_id"))


def total(payload: DataFrame) -> int:
    return int(payload.agg(F.sum(F.octet_length("shingles"))).first()[0] or 0) // 8


def visitors(homes: DataFrame, visits: DataFrame, links: DataFrame, percent: int) -> DataFrame:
    """Links of documents with blocks that they visit, but those within what `links` already joins.

    A block with many guests is dealt in parts of about a block's size each."""
    labels = materialize(connected_components(links), "labels")
    askers = materialize(homes.drop("block").join(visits, "doc_id"), "askers")
    hosts = homes.join(visits.select(F.col("to").alias("block")).distinct(), "block", "left_semi").select("block", "doc_id", "shingles")
    hosts = materialize(covered_by(hosts, askers, percent), "hosts")
    label = F.coalesce("component", "doc_id").alias("label")
    parts = materialize(askers.groupBy(F.col("to").alias("to_block")).agg(F.ceil(F.sum(F.octet_length("shingles")) / 8 / BLOCK).alias("parts")), "parts")
    both = hosts.join(parts, F.col("block") == F.col("to_block")).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    both = both.join(labels, F.col("doc_id") == F.col("id"), "left").select("block", "part", "doc_id", label, F.lit(True).alias("home"), "shingles")
    guests = askers.join(parts, F.col("to") == F.col("to_block")).join(labels, F.col("doc_id") == F.col("id"), "left")
    guests = guests.select(F.col("to").alias("block"), F.pmod(F.xxhash64("doc_id"), F.col("parts")).alias("part"), "doc_id", label, F.lit(False).alias("home"), "shingles")
    both = both.unionByName(guests)
    found = materialize(tree_links(both, percent), "across")
    discard(askers, hosts, labels, parts)
    return found


def covered_by(hosts: DataFrame, askers: DataFrame, percent: int) -> DataFrame:
    """Rows of hosts (block, doc_id, shingles) with as many shingles as a link needs in a bitmap, of fixed size, of the askers' shingles."""
    size = 1 << FILTER_BITS

    def places(batches):
        import pyarrow as pa

        for batch in batches:
            for _, values, _ in of_sets(batch):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(values & np.uint64(size - 1)).astype(np.int64))], names=["p"])

    sent = hosts.sparkSession.sparkContext.broadcast(bitmap(askers.select("doc_id", "shingles").mapInArrow(places, "p long"), FILTER_BITS).tobytes())

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            keep = []
            for _, values, cuts in of_sets(pa.RecordBatch.from_arrays(batch.columns[1:], names=batch.schema.names[1:])):
                hit = np.concatenate([[0], np.cumsum(has_mark(sent.value, (values & np.uint64(size - 1)).astype(np.int64)))])
                n = np.diff(cuts)
                keep.append(np.diff(hit[cuts]) >= n - may_differ(n, percent))
            yield batch.filter(pa.array(np.concatenate(keep) if keep else np.zeros(0, bool)))

    return hosts.mapInArrow(run, hosts.schema)


def first_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Rows of docs but those whose component has a smaller id; all columns stay."""
    found = similarity_components(docs, k, percent)
    return without(docs, materialize(found.where("doc_id <> component_id").select("doc_id").distinct(), "copies"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_components(read_table(spark, sf_dir, "documents"), 3, 90)


SQL = {
    "op6": """
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i + 1 : i + 3], ' ') AS g FROM d, unnest(range(0, CASE WHEN len(w) = 0 THEN 0 ELSE greatest(len(w) - 2, 1) END)) AS t(i)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM shared JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 90 * (p.n + q.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT a, y FROM reach JOIN links ON x = b)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, (SELECT min(b) FROM reach WHERE a = d.doc_id) AS component_id FROM d LEFT JOIN n USING (doc_id)"""
}
