"""Operator 4: benchmark decontamination.

Method: spaced-seed hashing.  A mask picks some of the words in a window and
ignores the others, so that a substituted word spoils few seeds.  The seeds of
the test items are joined with those at every word of the training texts; each
hit gives a diagonal (place in the text less place in the item), along which the
words are compared one by one: the longest span with at least `SIMILARITY` equal
words, ends included, is the overlap.

Items go to the tasks in blocks of about `BLOCK_BYTES` of text, so what is broadcast
has a fixed bound.  Where there is more than one block, a bitmap of all items' seeds
first finds, in one pass over the texts, those with any seed of an item; only they,
written to the shared folder, are searched block by block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import WordHasher, alnum_words, bitmap, buffers, materialize, mix, read_table, utf8

#: 1 takes the word, 0 ignores it.
MASKS = ["11110111", "1101101101", "1011011101", "1110010111", "11101100111"]
#: For items shorter than the longest mask.  No overlap of such an item escapes: of up to
#: two unequal words in a span of 4 to 10, four equal ones stand in a row or with one gap.
SHORT = ["1111", "10111", "11011", "11101"]
#: For items of 1 to 4 words, by number of words: they are found where all their words stand.
WHOLE = ["1", "11", "111", "1111"]
SIMILARITY = 0.8
#: An overlap has this many words, or `SIMILARITY` of a shorter item's.
MIN_WORDS = 13
BLOCK_BYTES = 1 << 20
#: Places of a block's filter, and at most of that of all blocks (32 MB as bits).
FILTER_BITS, MOST_BITS = 22, 28
EVERY = MASKS + SHORT + WHOLE


def picks(mask: str) -> list[int]:
    return [i for i, c in enumerate(mask) if c == "1"]


def seeds(h: np.ndarray, number: int, mask: str) -> np.ndarray:
    """The hash of the picked words at every place where the mask fits."""
    n = max(0, len(h) - len(mask) + 1)
    out = np.full(n, 0x9E3779B97F4A7C15 * (number + 1) % 2**64, np.uint64)
    for k, i in enumerate(picks(mask)):
        out += h[i : i + n] * np.uint64((0xD6E8FEB86659FD93 * (2 * k + 1)) % 2**64 | 1)
    return mix(out)


def masks_of(n_words: int) -> range:
    """The numbers of the masks of an item, in EVERY."""
    if n_words >= max(map(len, MASKS)):
        return range(len(MASKS))
    if n_words > len(WHOLE):
        return range(len(MASKS), len(MASKS) + len(SHORT))
    first = len(MASKS) + len(SHORT) + n_words - 1
    return range(first, first + (n_words > 0))


class Index:
    """Seeds of items: sorted hashes, each with the places where an item has it, and a filter in front."""

    def __init__(self, ids: list, texts: list[bytes], hasher: WordHasher):
        self.ids = ids
        self.words = [hasher.words([t])[0] for t in texts]
        found = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
        self.masks = sorted({m for h in self.words for m in masks_of(len(h))})
        for item, h in enumerate(self.words):
            for number in masks_of(len(h)):
                s = seeds(h, number, EVERY[number])
                found.append((s, np.full(len(s), item), np.arange(len(s))))
        seed, item, place = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((place, item, seed))
        seed, item, self.place = seed[order], item[order], place[order]
        new = np.ones(len(seed), bool)
        new[1:] = (seed[1:] != seed[:-1]) | (item[1:] != item[:-1])
        self.begin = np.flatnonzero(new)  # a group: one seed of one item
        self.seed, self.item = seed[self.begin], item[self.begin]
        self.times = np.diff(np.append(self.begin, len(seed)))
        self.sizes = np.array([len(h) for h in self.words], np.int64)

    def filter(self) -> np.ndarray:
        bits = np.zeros(1 << FILTER_BITS, bool)
        bits[self.seed & np.uint64((1 << FILTER_BITS) - 1)] = True
        return bits


def longest_span(same: np.ndarray) -> tuple[int, int]:
    """The longest [a, b) with at least SIMILARITY of same set, both ends among them."""
    ends = np.flatnonzero(same)
    if not len(ends):
        return 0, 0
    sums = np.concatenate([[0.0], np.cumsum(np.where(same, 1 - SIMILARITY, -SIMILARITY))]).round(9)
    low = np.minimum.accumulate(np.where(same, sums[:-1], np.inf))  # of starts up to each place
    starts = np.searchsorted(-low, -sums[ends + 1])  # the first start with no greater sum
    best = int(np.argmax(ends + 1 - starts))
    return int(starts[best]), int(ends[best]) + 1


def spread(n: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... n[0] of them, then those of begin[1], ..."""
    return np.arange(n.sum()) + np.repeat(begin - np.cumsum(n) + n, n)


def diagonals(h: np.ndarray, text: np.ndarray, first: np.ndarray, index: Index, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, item and shift of every diagonal with a hit, each once.

    A pair with more hits than it has diagonals, as repetitive texts have, gives all
    its diagonals without going through its hits."""
    low = np.uint64((1 << FILTER_BITS) - 1)
    wheres, groups = [], []
    for number in index.masks:
        mask = EVERY[number]
        s = seeds(h, number, mask)
        at = np.flatnonzero(bits[s & low])
        at = at[text[at] == text[at + len(mask) - 1]]
        a = np.searchsorted(index.seed, s[at])
        n = np.searchsorted(index.seed, s[at], "right") - a
        wheres.append(np.repeat(at, n))
        groups.append(spread(n, a))
    where, group = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (wheres, groups))
    pair, which = np.unique(text[where] * len(index.ids) + index.item[group], return_inverse=True)
    t, item = pair // len(index.ids), pair % len(index.ids)
    hits = np.bincount(which, index.times[group], len(pair))
    every = np.diff(first)[t] + index.sizes[item] - 1
    many = hits > every
    few = ~many[which]
    n = index.times[group[few]]
    shift = np.repeat(where[few], n) - index.place[spread(n, index.begin[group[few]])]
    lowest = first[t] - index.sizes[item] + 1  # the least shift of each pair
    width = int(every.max(initial=0)) + 1
    found = np.unique(np.repeat(which[few], n) * width + shift - np.repeat(lowest[which[few]], n))
    found = np.concatenate([found, np.repeat(np.flatnonzero(many) * width, every[many]) + spread(every[many], np.zeros(int(many.sum()), np.int64))])
    p = found // width
    return t[p], item[p], found % width + lowest[p]


def overlaps(texts: list[bytes], index: Index, bits: np.ndarray, hasher: WordHasher) -> list[tuple]:
    """(text, item, place in the text, place in the item, words, equal words) of each overlap."""
    h, text, _, _, first = hasher.words(texts)
    if not len(h) or not len(index.seed):
        return []
    out = []
    for t, item, shift in zip(*(x.tolist() for x in diagonals(h, text, first, index, bits)), strict=True):
        words = index.words[item]
        a, b = max(0, int(first[t]) - shift), min(len(words), int(first[t + 1]) - shift)
        same = h[shift + a : shift + b] == words[a:b]
        i, j = longest_span(same)
        if j - i >= min(MIN_WORDS, math.ceil(SIMILARITY * len(words))):
            out.append((t, item, int(shift + a + i - first[t]), int(a + i), j - i, int(same[i:j].sum())))
    return out


def items_of(benchmark: DataFrame) -> tuple[DataFrame, int]:
    """Distinct items with an id and a text, and the number of their blocks."""
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("item_id is not null and text is not null").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(max(1, -(-size // BLOCK_BYTES)))
    if n > 1:
        items = materialize(items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n))), "items", ["block"])
    return items, n


def blocks(items: DataFrame, n: int) -> Iterator[Index]:
    """Indexes of the blocks of items."""
    hasher = WordHasher(alnum_words(), lower=True)
    for b in range(n):
        part = (items.where(F.col("block") == b) if n > 1 else items).select("item_id", "text").orderBy("item_id", "text").toArrow()
        if part.num_rows:
            yield Index(part.column(0).to_pylist(), list(utf8(part.column(1).combine_chunks())), hasher)


def seed_places(items: DataFrame, n: int) -> np.ndarray:
    """A bitmap over the seeds of all items."""
    size = n * BLOCK_BYTES  # about as many seeds as bytes
    bits = max(FILTER_BITS, min(MOST_BITS, size.bit_length() + 3))
    hasher = WordHasher(alnum_words(), lower=True)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for text in utf8(batch.column(0)):
                h = hasher.words([text])[0]
                found = [seeds(h, number, EVERY[number]) for number in masks_of(len(h))]
                places = np.unique(np.concatenate([np.zeros(0, np.uint64), *found]) & np.uint64((1 << bits) - 1))
                yield pa.RecordBatch.from_arrays([pa.array(places.astype(np.int64))], names=["p"])

    return bitmap(items.select("text").mapInArrow(run, "p long"), bits)


def with_seeds(docs: DataFrame, items: DataFrame, n: int, has: bool = True) -> DataFrame:
    """Rows of docs with (or without) a seed of some item, all columns kept."""
    places = seed_places(items, n)
    sent = docs.sparkSession.sparkContext.broadcast(places.tobytes())
    low = np.uint64(8 * len(places) - 1)
    hasher = WordHasher(alnum_words(), lower=True)
    column = docs.columns.index("text")

    def run(batches):
        import pyarrow as pa

        bits = np.frombuffer(sent.value, np.uint8)
        for batch in batches:
            texts = utf8(batch.column(column))
            keep = np.zeros(len(texts), bool)
            for i, j in buffers(texts):
                h, text, _, _, _ = hasher.words(texts[i:j])
                for number, mask in enumerate(EVERY):
                    p = seeds(h, number, mask) & low
                    at = np.flatnonzero((bits[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1)
                    keep[i + text[at[text[at] == text[at + len(mask) - 1]]]] = True
            yield batch.filter(pa.array(keep == has))

    return docs.mapInArrow(run, docs.schema)


RESULT = "doc_id long, item_id long, doc_start long, item_start long, n_words long, n_equal long, similarity double"


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Overlaps of docs (doc_id, text) with items of benchmark (item_id, text).

    doc_id, item_id, doc_start and item_start (in words), n_words, n_equal,
    similarity.  Words are runs of ASCII letters and digits and non-ASCII
    characters, A-Z lowered.  Texts of any length are searched whole; null and empty
    ones have none; null ids of docs stay; every repeated row of docs has its own
    overlaps; an item's repeated rows are one; other columns play no part; an empty
    table on either side gives no rows.  Items of 1 to 4 words overlap where all their
    words stand."""
    spark = docs.sparkSession
    items, n_blocks = items_of(benchmark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if n_blocks > 1:
        docs = materialize(with_seeds(docs, items, n_blocks), "seeded")
    hasher = WordHasher(alnum_words(), lower=True)
    out = spark.createDataFrame([], RESULT)

    def search(sent):
        def run(batches):
            import pyarrow as pa

            index = sent.value
            bits = index.filter()
            names = [c.split()[0] for c in RESULT.split(", ")]
            for batch in batches:
                ids, texts = batch.column(0), utf8(batch.column(1))
                for i, j in buffers(texts):
                    if found := overlaps(texts[i:j], index, bits, hasher):
                        t, item, start, at, n, same = zip(*found, strict=True)
                        cols = [ids.take(pa.array([i + x for x in t])), pa.array([index.ids[x] for x in item], pa.int64()), *(pa.array(c, pa.int64()) for c in (start, at, n, same)), pa.array([s / w for s, w in zip(same, n, strict=True)], pa.float64())]
                        yield pa.RecordBatch.from_arrays(cols, names=names)

        return run

    for k, index in enumerate(blocks(items, n_blocks)):
        found = docs.mapInArrow(search(spark.sparkContext.broadcast(index)), RESULT)
        out = found if not k else out.unionByName(found)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of docs whose text has no overlap with an item, with all their columns.

    Null and empty texts have none and stay, as do null ids; of repeated rows all stay
    or none; an empty benchmark drops nothing, an empty table gives no rows."""
    at = docs.columns.index("text")
    hasher = WordHasher(alnum_words(), lower=True)

    def clean(sent):
        def run(batches):
            import pyarrow as pa

            index = sent.value
            bits = index.filter()
            for batch in batches:
                texts = utf8(batch.column(at))
                keep = np.ones(len(texts), bool)
                for i, j in buffers(texts):
                    keep[[i + x[0] for x in overlaps(texts[i:j], index, bits, hasher)]] = False
                yield batch.filter(pa.array(keep))

        return run

    items, n_blocks = items_of(benchmark)
    rest = materialize(with_seeds(docs, items, n_blocks), "seeded") if n_blocks > 1 else docs
    for index in blocks(items, n_blocks):
        rest = rest.mapInArrow(clean(docs.sparkSession.sparkContext.broadcast(index)), docs.schema)
    return with_seeds(docs, items, n_blocks, False).unionByName(rest) if n_blocks > 1 else rest


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
