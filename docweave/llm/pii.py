"""Operator 9: personal data.

Method: information-theoretic sanitisation.  E-mail, IP, card and phone spans are
the protected entities.  The corpus tells how strongly a term reveals them: with
p(K) the share of words that stand within `CONTEXT` words of an entity of kind K
and p(K|t) that share among the occurrences of t, t discloses
log2(p(K|t) / p(K)) of the -log2 p(K) bits that K carries.  Terms that disclose
at least `DISCLOSURE` of them, with at least `SUPPORT` different entities (so
that copies of one text prove nothing), are reported where they stand by an
entity of that kind, to be generalised.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import WordHasher, alnum_words, bitmap, buffers, materialize, read_table, signed, utf8
from .spans import SPAN, cut_out, digest

KINDS = ["email", "ip", "card", "phone"]
EXTRA = ["term"]
CONTEXT = 5
DISCLOSURE = 0.75
SUPPORT = 5
#: Places of the filter that spares counting words no entity stands by; any size gives the same result.
FILTER_BITS = 24

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")


def emails(text: str) -> list[tuple[int, int]]:
    out, low, at = [], 0, text.find("@")
    while at >= 0:
        s = at
        while s > low and text[s - 1] in LOCAL:
            s -= 1
        low = at + 1
        if s < at and (m := DOMAIN.match(text, at + 1)):
            out.append((s, m.end()))
            low = m.end()
        at = text.find("@", low)
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def find_personal(text: str) -> list[tuple[str, int, int]]:
    """Base spans by kind as listed and start."""
    out = [("email", s, e) for s, e in emails(text)]
    if not DIGIT.search(text):
        return out
    for m in IP.finditer(text):
        if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m.group().split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := digits(m.group())) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(digits(m.group())) <= 15]
    return out


def contexts(text: str, spans: list, hasher: WordHasher) -> list[dict]:
    """Terms by each entity: term, kind, value (both hashed), start and end in code points."""
    raw = text.encode()
    h, _, start, end, _ = hasher.words([raw])
    if not len(h):
        return []
    bytes_ = np.frombuffer(raw, np.uint8)
    point = np.concatenate([[0], np.cumsum((bytes_ & 0xC0) != 0x80)])
    digit = np.concatenate([[0], np.cumsum((bytes_ >= 48) & (bytes_ <= 57))])
    term = (digit[end] == digit[start]) & (point[end] - point[start] >= 3)
    ps, pe = point[start], point[end]
    for _, s, e in spans:
        a, b = np.searchsorted(pe, s, "right"), np.searchsorted(ps, e)
        term[a:b] = False
    out = []
    for kind, s, e in spans:
        a, b = int(np.searchsorted(pe, s, "right")), int(np.searchsorted(ps, e))
        value = hashed(canonical(kind, text[s:e]))
        for i in [*range(max(0, a - CONTEXT), a), *range(b, min(len(h), b + CONTEXT))]:
            if term[i]:
                out.append({"term": int(h[i].view(np.int64)), "kind": kind, "value": value, "start": int(ps[i]), "end": int(pe[i])})
    return out


def canonical(kind: str, s: str) -> str:
    """What tells entities of a kind apart: an address with A-Z lowered, the values of an ip's parts, else all digits."""
    if kind == "email":
        return s.lower()
    return ".".join(p.lstrip("0") or "0" for p in s.split(".")) if kind == "ip" else digits(s)


def hashed(s: str) -> int:
    return int.from_bytes(hashlib.blake2b(s.encode(), digest_size=8).digest(), "little", signed=True)


TERM = "array<struct<term:long,kind:string,value:long,start:long,end:long>>"


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, key (hash of the text), base spans, terms by them, words counted."""
    hasher = WordHasher(alnum_words(), lower=True)

    def run(batches):
        import pyarrow as pa

        span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        term = pa.list_(pa.struct([("term", pa.int64()), ("kind", pa.string()), ("value", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts = [x or "" for x in part.column(2).to_pylist()]
                base = [find_personal(x) for x in texts]
                near = [contexts(x, b, hasher) if b else [] for x, b in zip(texts, base, strict=True)]
                spans = [[{"kind": k, "start": s, "end": e} for k, s, e in b] for b in base]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(spans, span), pa.array(near, term)], names=["doc_id", "key", "base", "near"])

    return docs.select("doc_id", F.xxhash64("text").alias("key"), "text").mapInArrow(run, f"doc_id long, key long, base {SPAN}, near {TERM}")


def occurrences(docs: DataFrame, wanted: np.ndarray) -> DataFrame:
    """term, n: how often each term whose place in `wanted` is set occurs; and
    the number of all words under the term null."""
    sent = docs.sparkSession.sparkContext.broadcast(np.packbits(wanted).tobytes())
    size = len(wanted)
    hasher = WordHasher(alnum_words(), lower=True)

    def run(batches):
        import pyarrow as pa

        bits = np.unpackbits(np.frombuffer(sent.value, np.uint8)).view(bool)
        total, kept = 0, []

        def flush():
            terms, n = np.unique(np.concatenate(kept), return_counts=True) if kept else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            kept.clear()
            for i in range(0, len(terms), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(terms[i : i + 100_000]), pa.array(n[i : i + 100_000])], names=["term", "n"])

        for batch in batches:
            texts = utf8(batch.column(0))
            for i, j in buffers(texts):
                h = signed(hasher.words(texts[i:j])[0])
                total += len(h)
                kept.append(h[bits[h & (size - 1)]])
            if sum(map(len, kept)) > 2_000_000:
                yield from flush()
        yield from flush()
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([total], pa.int64())], names=["term", "n"])

    return docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def revealing(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Terms over the disclosure threshold: term, kind, disclosure."""
    near = found.select(F.explode("near").alias("x")).select("x.*")
    by_value = near.groupBy("term", "kind", "value").agg(F.count("*").alias("c"))
    pairs = materialize(by_value.groupBy("term", "kind").agg(F.sum("c").alias("near"), F.count("*").alias("support")).where(F.col("support") >= SUPPORT), "pairs")
    # Only terms with that support need counting.  They go to the tasks as a bitmap
    # of fixed size.
    place = F.col("term").bitwiseAND((1 << FILTER_BITS) - 1)
    wanted = np.unpackbits(bitmap(pairs.select(place.alias("p")), FILTER_BITS), bitorder="little").view(bool)
    counts = materialize(occurrences(docs, wanted), "terms")
    words = counts.where("term is null").agg(F.max("n")).first()[0] or 0
    kinds = {r["kind"]: r["n"] for r in near.groupBy("kind").agg(F.count("*").alias("n")).collect()}  # at most one row a kind
    share = F.create_map(*[x for k in KINDS for x in (F.lit(k), F.lit(max(kinds.get(k, 0), 1) / max(words, 1)))])[F.col("kind")]
    told = F.log2(F.least(F.col("near") / F.col("n"), F.lit(1.0)) / share) / -F.log2(F.least(share, F.lit(0.999999)))
    return pairs.join(counts, "term").select("term", "kind", told.alias("disclosure")).where(F.col("disclosure") >= DISCLOSURE)


def personal_parts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What `detect` finds, and hit_id, hit_key, extra: the revealing terms of each text that has some."""
    found = materialize(detect(docs), "personal")
    terms = materialize(revealing(docs, found), "revealing")
    near = found.where(F.size("near") > 0).select("doc_id", "key", F.explode("near").alias("x")).select("doc_id", "key", "x.*").distinct()
    hits = near.join(terms.select("term", "kind"), ["term", "kind"]).groupBy(F.col("doc_id").alias("hit_id"), F.col("key").alias("hit_key")).agg(F.sort_array(F.collect_set(F.struct(F.lit("term").alias("kind"), "start", "end"))).alias("extra"))
    return found, hits


def scan_personal(docs: DataFrame) -> DataFrame:
    """doc_id, base and extra spans (kind, start, end in code points), a row per row of docs.

    Null and empty texts have none; null ids and repeated rows stay, rows with one
    id and different texts are told apart by a hash of the text; texts are read
    whole; other columns play no part; an empty table gives no rows."""
    found, hits = personal_parts(docs)
    none = F.array().cast(SPAN)
    same = F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("key") == F.col("hit_key"))
    return found.drop("near").join(hits, same, "left").select("doc_id", "base", F.coalesce("extra", none).alias("extra"))


def sanitize_personal(docs: DataFrame) -> DataFrame:
    """docs with entities and revealing terms generalised to their kind ([EMAIL],
    [IP], [CARD], [PHONE], [TERM]) and n_chars (where present) following.

    All rows and columns stay; null and empty texts, and texts with no span, are
    as they were.  Which terms reveal is told by all of docs."""
    hits = personal_parts(docs)[1].select(F.col("hit_id").alias("_hit_id"), F.col("hit_key").alias("_hit_key"), F.col("extra").alias("_hit_terms"))
    same = F.col("doc_id").eqNullSafe(F.col("_hit_id")) & (F.xxhash64("text") == F.col("_hit_key"))
    found = docs.join(hits, same, "left").drop("_hit_id", "_hit_key")
    return cut_out(found, lambda text: (find_personal(text), []), lambda kind: f"[{kind.upper()}]", "_hit_terms")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(scan_personal(read_table(spark, sf_dir, "documents")), KINDS, EXTRA, by_start=False)
