"""Operator 1: tokenising and packing into fixed windows.

Method: Karmarkar-Karp multiway differencing.  Token lists are cut into pieces;
every piece starts as a partial partition with all of its load in one window,
and the two partial partitions with the largest imbalance are merged, heavy
windows against light ones, until one is left.  Its windows are near-equal; the
window count rises whenever the heaviest exceeds the capacity.

Work is done task by task in bounded groups of pieces, without a shuffle.
"""

from __future__ import annotations

import heapq
import zlib
from array import array

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .base import buffers, read_table, utf8

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def differencing(lengths: list[int], windows: int) -> list[list[int]]:
    """Items of each window under multiway differencing."""
    heap = []
    for i, n in enumerate(lengths):
        loads, slots = np.zeros(windows, np.int64), np.full(windows, -1)
        loads[0], slots[0] = n, i
        heap.append((-n, i, loads, slots))
    heapq.heapify(heap)
    serial = len(lengths)
    # Loads are in descending order; a slot is an item, or a pair of slots numbered behind the items.
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    n_pairs = 0
    while len(heap) > 1:
        _, _, a, left = heapq.heappop(heap)
        _, _, b, right = heapq.heappop(heap)
        loads, right = a + b[::-1], right[::-1]
        slots = np.maximum(left, right)
        both = np.flatnonzero(np.minimum(left, right) >= 0)
        if len(both):
            slots[both] = np.arange(len(both)) + (len(lengths) + n_pairs)
            pairs.append((left[both], right[both]))
            n_pairs += len(both)
        order = np.argsort(-loads, kind="stable")
        loads = loads[order]
        loads -= loads[-1]
        heapq.heappush(heap, (-int(loads[0]), serial, loads, slots[order]))
        serial += 1
    if not heap:
        return []
    first, second = (np.concatenate([p[k] for p in pairs]).tolist() if pairs else [] for k in (0, 1))
    out = []
    for slot in heap[0][3].tolist():
        items, todo = [], [slot] if slot >= 0 else []
        while todo:
            x = todo.pop()
            if x < len(lengths):
                items.append(x)
            else:
                todo += (first[x - len(lengths)], second[x - len(lengths)])
        out.append(items)
    return out


def pack_group(lengths: list[int], capacity: int) -> list[list[int]]:
    """Windows of at most capacity for pieces of at most capacity each."""
    windows = max(1, -(-sum(lengths) // capacity))
    while True:
        found = differencing(lengths, windows)
        if max((sum(lengths[i] for i in w) for w in found), default=0) <= capacity:
            return [w for w in found if w]
        windows += 1


class Encoder:
    """Token ids of whole texts by a tokenizers file.

    A space before something other than white space begins a new word of the
    pre-tokenizer whatever stands around it, so texts are cut there and equal pieces are
    encoded once.  A text that holds an added token's string goes to the tokenizer
    uncut, for such strings change what is a word beside them."""

    #: Pieces that are put together at a time; ids remembered for each piece that is, on average.
    STEP, IDS = 1_000_000, 7

    def __init__(self, path: str, remembered: int):
        from tokenizers import Tokenizer

        self.remembered = remembered

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.sizes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():  # byte-level: a character of a token is a byte of text
            self.sizes[i] = len(token)
        # First bytes of characters that are never white space (0x85, U+00A0, U+1680, U+2000 and U+3000 begin with those left out).
        self.solid = np.zeros(256, bool)
        self.solid[0x21:0x7F] = self.solid[0xC3:] = True
        self.solid[[0xE1, 0xE2, 0xE3]] = False
        self.forget()

    def forget(self) -> None:
        self.numbers: dict[bytes, int] = {}
        self.pool, self.begin = array("I"), array("q", [0])

    def ids(self, text: bytes) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text.decode()], add_special_tokens=False)[0].ids, np.uint32)

    def learn(self, pieces: list[bytes]) -> None:
        """Encodes new pieces.  Those that begin a word are one text, which is cut where each piece's bytes end."""
        words = [p for p in pieces if len(p) > 1 and p[0] == 0x20 and self.solid[p[1]]]
        ids = self.ids(b"".join(words))
        cuts = 1 + np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum([len(p) for p in words])) if words else np.zeros(0, np.int64)
        others = [p for p in pieces if not (len(p) > 1 and p[0] == 0x20 and self.solid[p[1]])]
        single = [self.ids(p) for p in others]
        cuts = np.concatenate([cuts, len(ids) + np.cumsum([len(x) for x in single], dtype=np.int64)])
        self.numbers.update(zip(words + others, range(len(self.begin) - 1, len(self.begin) - 1 + len(pieces)), strict=True))
        self.begin.frombytes((len(self.pool) + cuts).astype(np.int64).tobytes())
        self.pool.frombytes(np.concatenate([ids, *single]).tobytes())

    def known(self, pieces) -> tuple[np.ndarray, np.ndarray]:
        """Ids of an Arrow array of pieces, and how many each has."""
        coded = pieces.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self.numbers) > self.remembered or len(self.pool) > self.IDS * self.remembered:
            self.forget()
        if new := [p for p in distinct if p not in self.numbers]:
            self.learn(new)
        which = np.fromiter(map(self.numbers.__getitem__, distinct), np.int64, len(distinct))[coded.indices.to_numpy()]
        begin = np.frombuffer(self.begin, np.int64)
        n = begin[which + 1] - begin[which]
        at = np.arange(n.sum()) + np.repeat(begin[which] - np.cumsum(n) + n, n)
        return (np.frombuffer(self.pool, np.uint32)[at] if len(at) else np.zeros(0, np.uint32)), n

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text."""
        import pyarrow as pa

        if not texts:
            return []
        whole = {i: self.ids(t) for i, t in enumerate(texts) if any(a in t for a in self.added)}
        plain = [b"" if i in whole else t for i, t in enumerate(texts)]
        joined = b"".join(plain)
        ends = np.cumsum([len(t) for t in plain], dtype=np.int64)
        buf = np.frombuffer(joined, np.uint8)
        edge = np.zeros(len(buf) + 1, bool)
        edge[: max(0, len(buf) - 1)] = (buf[:-1] == 0x20) & self.solid[buf[1:]]
        edge[0] = edge[ends] = True
        cuts = np.flatnonzero(edge)
        out, counts = [], []
        for i in range(0, len(cuts) - 1, self.STEP):
            part = cuts[i : i + self.STEP + 1]
            pieces = pa.Array.from_buffers(pa.large_binary(), len(part) - 1, [None, pa.py_buffer(part.astype(np.int64)), pa.py_buffer(joined)])
            ids, n = self.known(pieces)
            out.append(ids)
            counts.append(n)
        ids = np.concatenate(out) if out else np.zeros(0, np.uint32)
        upto = np.concatenate([[0], *counts]).cumsum()[np.searchsorted(cuts, ends)]
        return [whole[i] if i in whole else x for i, x in enumerate(np.split(ids, upto[:-1]))]


def encoder(path: str, remembered: int) -> Encoder:
    """The encoder of a file; kept by the Python worker."""
    import sys

    kept = sys.__dict__.setdefault("_docweave_encoders", {})
    if path not in kept:
        kept[path] = Encoder(path, remembered)
    kept[path].remembered = remembered
    return kept[path]


class Packer:
    """Collects the documents of one task and gives out packed pieces."""

    def __init__(self, first_id: int, capacity: int, piece: int, windows: int, slack: int):
        self.next_id, self.capacity, self.piece, self.windows, self.slack = first_id, capacity, piece, windows, slack
        self.rest: list[tuple] = []  # (doc_id, ids, start, end) waiting for a window
        self.load = 0
        self.rows: list[tuple] = []

    def emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, ids, start, end in pieces:
            self.rows.append((doc_id, start, end - start, zlib.crc32(ids[start:end].tobytes()), len(ids), self.next_id, offset))
            offset += end - start
        self.next_id += 1

    def add(self, doc_id, ids: np.ndarray) -> None:
        at = 0
        while len(ids) - at >= self.capacity:
            self.emit([(doc_id, ids, at, at + self.capacity)])
            at += self.capacity
        while at < len(ids):
            to = min(at + self.piece, len(ids))
            self.rest.append((doc_id, ids, at, to))
            self.load += to - at
            at = to
        full = self.windows * (self.capacity - self.slack)
        while self.load >= full:
            self.group(full)

    def take(self, tokens: int) -> list[tuple]:
        """The first pieces that wait, tokens long together; the last may be cut."""
        got, n = [], 0
        while n < tokens:
            doc_id, ids, start, end = self.rest[len(got)]
            if n + end - start > tokens:
                cut = start + tokens - n
                self.rest[len(got)] = (doc_id, ids, cut, end)
                self.rest.insert(len(got), (doc_id, ids, start, cut))
                end = cut
            got.append((doc_id, ids, start, end))
            n += end - start
        del self.rest[: len(got)]
        self.load -= n
        return got

    def group(self, tokens: int) -> None:
        """Packs tokens that leave a little free in each window, so that near-equal windows fit."""
        pieces = self.take(tokens)
        for w in pack_group([e - s for _, _, s, e in pieces], self.capacity):
            self.emit([pieces[i] for i in sorted(w)])

    def finish(self) -> None:
        """The end of a task: whole windows as ever, what is left in lengths of powers of two, which need no padding."""
        if whole := self.load // self.capacity:
            self.group(whole * (self.capacity - self.slack))
        while self.load:
            self.emit(self.take(min(1 << (self.load.bit_length() - 1), 1 << (self.capacity.bit_length() - 1))))


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1, piece: int = 256, windows: int = 256, slack: int = 12, remembered: int = 600_000, read: int = 1 << 22) -> DataFrame:
    """Packs the texts of docs (doc_id, text) into sequences of at most capacity tokens.

    One row per piece: doc_id, start (the document's ids before it), length,
    ids_crc32 (of little-endian unsigned 32-bit ids), doc_tokens, sequence_id,
    offset.  Each document is its ids by the tokenizers file, without special tokens
    added, and end_id.  Null and empty texts are the
    end id alone; a null doc_id stays null; repeated rows are packed each; other
    columns play no part.  An empty table gives no rows.

    Windows of whole documents come first; remainders, cut into pieces of at most
    `piece`, are differenced in groups of `windows` windows that leave `slack` places free
    on average.  sequence_id is unique:
    the task's number and a count within the task.

    `remembered` pieces of text keep their ids from one task to the next, and `read`
    bytes of text are encoded together: about 290 MB of a worker's memory as given, about
    100 MB with 150,000 and 1 MB, which takes two thirds more time for the same rows."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        enc = encoder(tokenizer, remembered)
        p = Packer(TaskContext.get().partitionId() << 40, capacity, piece, windows, min(slack, capacity - 1))
        schema = pa.schema([(c.split()[0], pa.int64()) for c in PIECES.split(", ")])

        def rows():
            cols = list(zip(*p.rows, strict=True))
            p.rows = []
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], schema=schema)

        for batch in batches:
            every, texts = batch.column(0).to_pylist(), utf8(batch.column(1))
            for i, j in buffers(texts, read):
                for doc_id, ids in zip(every[i:j], enc.encode(texts[i:j]), strict=True):
                    p.add(doc_id, np.append(ids, np.uint32(end_id)).astype("<u4"))
                    if len(p.rows) >= 20_000:
                        yield rows()
        p.finish()
        if p.rows:
            yield rows()

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Production packing of all documents by byte_bpe_50k.json."""
    return pack_documents(read_table(spark, sf_dir, "documents"))


def pack_documents(docs: DataFrame, **settings: int) -> DataFrame:
    """pack by byte_bpe_50k.json."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), **settings)
