"""Operator 7: secrets in texts.

Method: multipart credential linking.  Strong secrets (assignments, access
keys, hex strings) count alone.  Weak parts, namely account identifiers, opaque
tokens and endpoints, are interval-joined: a part's window of `WINDOW`
characters, within its scope (a block between blank lines), is matched with the
sorted starts of the complementary parts.  A weak part is reported only when
complementary parts lie in its window.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession

from .base import read_table
from .spans import cut_out, digest, find_spans

KINDS = ["assign", "access", "hex"]
EXTRA = ["identifier", "opaque", "endpoint"]
WINDOW = 400
MIN_ENTROPY = 3.5

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
LONG = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
HEX = re.compile(r"[0-9a-f]{24,}")
IDENTIFIER = re.compile(r"""(?:access_key_id|client_?id|account|user_?name|user|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{3,}""", re.I | re.A)
ENDPOINT = re.compile(r"""[a-z][a-z0-9+.-]{1,15}://[^\s"'<>()]+|(?:host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+(?::[0-9]+)?""", re.A)
BLANK = re.compile(r"\n[\x20\t]*\n")


def entropy(s: str) -> float:
    """Bits a character of the string's own letter frequencies."""
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())


def opaque(s: str) -> bool:
    classes = (any("a" <= c <= "z" for c in s), any("A" <= c <= "Z" for c in s), any("0" <= c <= "9" for c in s))
    return all(classes) and entropy(s) >= MIN_ENTROPY


def near(starts: list[int], low: int, high: int) -> bool:
    i = bisect_left(starts, low)
    return i < len(starts) and starts[i] < high


def link(text: str, parts: dict[str, list], strong_ids: list[int], strong_secrets: list[int]) -> list:
    """Weak parts with their complements within window and scope."""
    if not any(parts.values()):
        return []
    breaks = [0, *(m.end() for m in BLANK.finditer(text)), len(text) + 1]
    ids = sorted(strong_ids + [s for s, _ in parts["identifier"]])
    keys = sorted(strong_secrets + [s for s, _ in parts["opaque"]])
    out = []
    for kind, spans in parts.items():
        for s, e in spans:
            b = bisect_left(breaks, s + 1)
            low, high = max(breaks[b - 1], s - WINDOW), min(breaks[b], e + WINDOW)
            has_id, has_key = near(ids, low, high), near(keys, low, high)
            if {"identifier": has_key, "opaque": has_id, "endpoint": has_id and has_key}[kind]:
                out.append((kind, s, e))
    return out


def find_secrets(text: str) -> tuple[list, list]:
    """Base spans by start and kind, and linked weak spans that touch none of them."""
    assigns, keyed = [], ":" in text or "=" in text
    if keyed:
        assigns = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    access = [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20] if "AKIA" in text else []
    hexes, weak = [], []
    for m in LONG.finditer(text):
        runs = [("hex", h.start(), h.end()) for h in HEX.finditer(text, m.start(), m.end())]
        hexes += runs
        if not runs and opaque(m.group()):
            weak.append(m.span())
    base = sorted(assigns + access + hexes, key=lambda x: (x[1], KINDS.index(x[0])))
    parts = {"identifier": [], "opaque": weak, "endpoint": []}
    if keyed:
        parts["identifier"] = [m.span() for m in IDENTIFIER.finditer(text)]
        parts["endpoint"] = [m.span() for m in ENDPOINT.finditer(text)]
    if any(parts.values()):
        taken = sorted((s, e) for _, s, e in base)
        firsts = [s for s, _ in taken]
        furthest = list(accumulate((e for _, e in taken), max))  # the last end of the spans up to each

        def free(s: int, e: int) -> bool:
            i = bisect_left(firsts, e)
            return not i or furthest[i - 1] <= s

        parts = {k: [x for x in v if free(*x)] for k, v in parts.items()}
    return base, link(text, parts, [s for _, s, _ in access], [s for _, s, _ in assigns + hexes])


def scan_secrets(docs: DataFrame) -> DataFrame:
    """Spans of secrets: doc_id, base and extra (kind, start, end in code points).

    One row per row of docs, repeated rows and null ids included; null and empty
    texts have no spans; texts of any length are searched whole; other columns
    play no part; an empty table gives no rows."""
    return find_spans(docs, find_secrets)


def redact_secrets(docs: DataFrame) -> DataFrame:
    """docs with every reported span replaced by [SECRET], all columns kept.

    n_chars, where present, follows a changed text; null and empty texts and those
    without spans stay as they are; null ids and repeated rows stay; an empty table
    gives no rows."""
    return cut_out(docs, find_secrets, lambda kind: "[SECRET]")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(scan_secrets(read_table(spark, sf_dir, "documents")), KINDS, EXTRA, by_start=True)
