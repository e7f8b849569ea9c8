"""Shared pieces: the cluster's shared folder, word hashing, components.

Word hashing is vectorised: the UTF-8 bytes of a batch of texts form one
buffer, words are runs of word bytes, and the hash of a word or of k words is
a difference of prefix sums of a polynomial modulo 2**64.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts are hashed in buffers of about this many bytes (a longer text alone).
BUFFER_BYTES = 1 << 18
#: Within `small_batches`, Python gets batches of about this many bytes (a larger row alone).
BATCH_BYTES = 1 << 21


# ---------------------------------------------------------------- storage


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Only where the session names none and runs on one machine, as in tests, a new
    temporary folder is made and set; a cluster that names none is refused."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that executors and driver share")
        found = "file://" + tempfile.mkdtemp(prefix="docweave-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, tag: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    Cuts lineage, survives lost executors, and gives the planner sizes."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/docweave-{tag}-{uuid.uuid4().hex}"
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._docweave_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes the files of materialized frames that nothing will read again."""
    for df in frames:
        if path := getattr(df, "_docweave_path", None):
            jvm = df.sparkSession._jvm
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def small_batches(spark: SparkSession, size: int = BATCH_BYTES) -> Iterator[None]:
    """What runs within hands rows to Python in batches of about size bytes instead of 10,000 rows.

    A batch stands in the executor's buffers and in the worker at once, for each task."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bitmap(places: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of 2**bits (bits >= 15) places, of column p: 32,768 a row, collected as bytes."""
    p = F.col("p")
    rows = places.groupBy(F.shiftright(p, 15).alias("b")).agg(F.bitmap_construct_agg(p.bitwiseAND(32767)).alias("bits")).collect()
    out = np.zeros(1 << bits >> 3, np.uint8)
    for r in rows:
        out[int(r["b"]) << 12 : (int(r["b"]) + 1) << 12] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


# ---------------------------------------------------------------- hashing

U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit values."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _inverse(m: int) -> int:
    return pow(m, -1, 1 << 64)


class Powers:
    """Powers of an odd number and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inv = base | 1, _inverse(base | 1)
        self.up = self.down = np.ones(1, U64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            for name, b in (("up", self.base), ("down", self.inv)):
                steps = np.full(n, b, dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))
        return self.up, self.down


def space_words() -> np.ndarray:
    """Word bytes of [^\\x20\\x09-\\x0D]+."""
    t = np.ones(256, bool)
    t[[0x20, *range(0x09, 0x0E)]] = False
    return t


def alnum_words() -> np.ndarray:
    """Word bytes of ASCII letters and digits and of all non-ASCII characters."""
    t = np.zeros(256, bool)
    t[0x30:0x3A] = t[0x41:0x5B] = t[0x61:0x7B] = t[0x80:] = True
    return t


def lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[0x41:0x5B] += 32
    return t


class WordHasher:
    """Hashes the words of texts; equal words of any two texts have equal hashes."""

    def __init__(self, is_word: np.ndarray, lower: bool = False):
        self.is_word = is_word
        fold = lower_table() if lower else np.arange(256, dtype=np.uint8)
        values = mix(np.arange(1, 257, dtype=np.uint64) * U64(0x9E3779B97F4A7C15))
        self.values = values[fold]
        self.bytes = Powers(0xD1342543DE82EF95)
        self.grams = {}

    def words(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of texts (UTF-8): each word's hash, its text's number, byte start and
        end in the joined buffer; and each text's first word with one more at the end."""
        buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        lens = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        offsets = np.concatenate([[0], np.cumsum(lens + 1)])
        inside = self.is_word[buf]
        edge = np.diff(inside.astype(np.int8), prepend=0)
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        up, down = self.bytes.to(len(buf) + 1)
        sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(self.values[buf] * up[: len(buf)], out=sums[1:])
        h = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))
        first = np.searchsorted(start, offsets)
        text = np.repeat(np.arange(len(texts)), np.diff(first))
        return h, text, start, end, first

    def ngrams(self, h: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
        """Hashes of k consecutive values of h (len(h) - k + 1 of them)."""
        p = self.grams.setdefault(salt, Powers(0x2545F4914F6CDD1D + 0x9E3779B97F4A7C16 * salt))
        return span_hashes(h, np.arange(max(0, len(h) - k + 1)), np.arange(max(0, len(h) - k + 1)) + k, p)


def span_hashes(h: np.ndarray, start: np.ndarray, end: np.ndarray, p: Powers) -> np.ndarray:
    """Hashes of h[start:end] for arrays of starts and ends."""
    if not len(start):
        return np.zeros(0, np.uint64)
    up, down = p.to(len(h) + 1)
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[: len(h)], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


class Texts:
    """An Arrow string or binary column as bytes, read a slice at a time; null is empty."""

    def __init__(self, column):
        import pyarrow as pa

        self.column = column.cast(pa.binary()) if column.type in (pa.string(), pa.large_string()) else column

    def __len__(self) -> int:
        return len(self.column)

    def __getitem__(self, at: slice) -> list[bytes]:
        return [b"" if x is None else x for x in self.column[at].to_pylist()]

    def __iter__(self) -> Iterator[bytes]:
        return (b"" if (b := x.as_py()) is None else b for x in self.column)

    def lengths(self) -> list[int]:
        import pyarrow.compute as pc

        return pc.fill_null(pc.binary_length(self.column), 0).to_pylist()


def utf8(column) -> Texts:
    return Texts(column)


def buffers(texts: Texts | list[bytes], limit: int = BUFFER_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts that hold about limit bytes each."""
    i = size = 0
    for j, n in enumerate(texts.lengths() if isinstance(texts, Texts) else map(len, texts)):
        size += n
        if size >= limit:
            yield i, j + 1
            i, size = j + 1, 0
    if i < len(texts):
        yield i, len(texts)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


# ------------------------------------------------------------- components


def _forest(batches):
    """Edges of each partition as a spanning forest (bounded by its vertices)."""
    import pyarrow as pa

    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while x != root:
            parent[x], x = root, parent.get(x, x)
        return root

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    items = [(x, find(x)) for x in list(parent)]
    items = [(x, r) for x, r in items if x != r]
    for i in range(0, len(items), 50_000):
        yield pa.RecordBatch.from_pydict({"src": pa.array([x[0] for x in items[i : i + 50_000]], pa.int64()), "dst": pa.array([x[1] for x in items[i : i + 50_000]], pa.int64())})


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Components of edges (src, dst: long): rows (id, component), component
    being the smallest id in reach.  Ids without an edge are absent.

    Each partition first reduces its edges to a forest.  Then large-star and
    small-star steps, as joins and aggregates, repeat until nothing changes;
    each step's edges are written to the shared folder."""
    schema = "src long, dst long"
    e = edges.select(F.col("src").cast("long"), F.col("dst").cast("long")).where("src <> dst")
    e = materialize(e.mapInArrow(_forest, schema), "edges")
    before = None
    for _ in range(rounds):
        for large in (True, False):
            both = e.union(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
            if large:  # every larger neighbour of u is linked to u's smallest neighbour
                low = materialize(both.groupBy("src").agg(F.least(F.min("dst"), F.first("src")).alias("m")), "low")
                new = both.join(low, "src").where("dst > src").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
            else:  # u and its smaller neighbours are linked to the smallest of them
                down = e.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
                low = materialize(down.groupBy("src").agg(F.min("dst").alias("m")), "low")
                new = down.join(low, "src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).union(low.select("src", F.col("m").alias("dst")))
            new = materialize(new.where("src <> dst").distinct(), "edges")
            discard(e, low)
            e = new
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("src", "dst")), F.sum(F.hash("src", "dst").cast("long"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return e.groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("component")).unionByName(e.select(F.col("dst").alias("id"), F.col("dst").alias("component")).distinct())
