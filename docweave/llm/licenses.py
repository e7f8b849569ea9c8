"""Operator 2: licence scans.

Method: positional rare-token index.  Templates are passages of licence texts, their
notices, names and SPDX lines, each with a label and mandatory key phrases.  The index
maps a word to its postings (template, position), and a word's IDF is that over the
templates.  Of a template's words that a file has, the `LOOKUP` with the highest IDF are
looked up, and their postings intersected by relative position (place in the file less
place in the template): at least `SHARE` of them must meet within the template's slack.
There the key phrases are verified.  The score is the share of the template's words
that stand at their places.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .base import alnum_words, buffers, read_table, utf8

#: Base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Label, passage of a licence or notice, mandatory key phrases.
PASSAGES = [
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so", ["permission is hereby granted", "free of charge", "obtaining a copy of this software"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ["permission is hereby granted free of charge", "associated documentation files"]),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ["this permission notice shall be included", "substantial portions of the software"]),
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license", "2 0"]),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ["apache license", "in compliance with the license"]),
    ("apache-2.0", "subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of", ["each contributor hereby grants to you", "royalty free irrevocable copyright license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ["redistribution and use", "source and binary forms"]),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", ["redistributions of source code must retain", "this list of conditions"]),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ["neither the name of", "endorse or promote products derived from this software"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["permission to use copy modify", "hereby granted"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc-by-nd", "licensed under cc by nd 4 0", ["cc by nd"]),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution", "international license"]),
    ("cc-by-sa", "creative commons attribution sharealike 4 0 international license", ["creative commons attribution sharealike"]),
    ("cc-by-nc", "creative commons attribution noncommercial 4 0 international license", ["creative commons attribution noncommercial"]),
    ("cc0", "to the extent possible under law the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide", ["to the extent possible under law", "public domain"]),
    ("cc0", "cc0 1 0 universal public domain dedication", ["cc0 1 0 universal"]),
    ("gpl", "this work is licensed under the gnu general public license", ["gnu general public license"]),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ["this program is free software", "gnu general public license"]),
    ("gpl-2.0", "gnu general public license version 2", ["gnu general public license version 2"]),
    ("gpl-3.0", "gnu general public license version 3", ["gnu general public license version 3"]),
    ("lgpl", "licensed under the gnu lesser general public license", ["lesser general public license"]),
    ("agpl", "licensed under the gnu affero general public license", ["affero general public license"]),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", ["mozilla public license", "source code form"]),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", ["eclipse public license"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["unencumbered software", "public domain"]),
    ("bsl-1.0", "distributed under the boost software license version 1 0", ["boost software license"]),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ["in no event will the authors be held liable"]),
    ("wtfpl", "do what the fuck you want to public license", ["what the fuck you want to public license"]),
    ("reserved", "all rights reserved", ["all rights reserved"]),
]

#: Label, SPDX identifier as words, names in common use.
NAMES = [
    ("mit", "mit", ["mit licensed", "mit license", "under mit"]),
    ("apache-2.0", "apache 2 0", ["apache 2 0 license", "apache license 2 0", "apache license v2"]),
    ("bsd-2-clause", "bsd 2 clause", ["bsd 2 clause license", "simplified bsd license"]),
    ("bsd-3-clause", "bsd 3 clause", ["bsd 3 clause license", "new bsd license", "revised bsd license"]),
    ("isc", "isc", ["isc license"]),
    ("gpl-2.0", "gpl 2 0", ["gnu gpl v2", "gnu gplv2", "gpl v2 license", "gplv2 license"]),
    ("gpl-3.0", "gpl 3 0", ["gnu gpl v3", "gnu gplv3", "gpl v3 license", "gplv3 license"]),
    ("lgpl", "lgpl 2 1", ["gnu lgpl"]),
    ("lgpl", "lgpl 3 0", ["gnu lgpl v3"]),
    ("agpl", "agpl 3 0", ["gnu agpl"]),
    ("mpl-2.0", "mpl 2 0", ["mozilla public license 2 0", "mozilla public license version 2 0"]),
    ("epl-2.0", "epl 2 0", ["eclipse public license 2 0"]),
    ("cc0", "cc0 1 0", ["cc0 license"]),
    ("cc-by", "cc by 4 0", ["creative commons attribution license"]),
    ("cc-by-sa", "cc by sa 4 0", ["creative commons attribution sharealike"]),
    ("cc-by-nc", "cc by nc 4 0", ["creative commons attribution noncommercial"]),
    ("unlicense", "unlicense", ["the unlicense"]),
    ("bsl-1.0", "bsl 1 0", ["boost software license"]),
    ("zlib", "zlib", ["zlib license"]),
    ("wtfpl", "wtfpl", ["wtfpl license"]),
]


def named_templates() -> list[tuple[str, str, list[str]]]:
    """A template for each SPDX line and name; all of it is its key phrase."""
    out = []
    for label, spdx, names in NAMES:
        out += [(label, phrase, [phrase]) for phrase in (f"spdx license identifier {spdx}", *names)]
    return out


TEMPLATES = PASSAGES + named_templates()
#: Words of a template that are looked up, and the share of them that must meet.
LOOKUP, SHARE = 8, 0.6
#: A key phrase may stand this many words from where the template has it.
SLACK = 3

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


class Template:
    """A template by word numbers: its words by falling IDF, key phrases with their places."""

    def __init__(self, label: str, words: np.ndarray, phrases: list[np.ndarray], idf: dict[int, float]):
        self.label, self.words = label, words
        found = [next(j for j in range(len(words)) if np.array_equal(words[j : j + len(p)], p)) for p in phrases]
        self.phrases = list(zip(found, phrases, strict=True))
        self.by_idf = sorted(range(len(words)), key=lambda j: (-idf[int(words[j])], j))
        self.needs = frozenset(int(w) for p in phrases for w in p)
        self.least = math.ceil(SHARE * min(LOOKUP, len(words)))
        #: How far words of a passage may drift, as where a name is put in.
        self.slack = 0 if len(words) <= 6 else len(words) // 5


class Index:
    """Postings and key phrases of the templates."""

    def __init__(self, templates=None, base=None):
        rows = [(label, text.encode().split(), [p.encode().split() for p in phrases]) for label, text, phrases in (TEMPLATES if templates is None else templates)]
        plain = [(phrase.encode().split(), label) for phrase, label in (BASE if base is None else base).items()]
        every = sorted({w for _, words, _ in rows for w in words} | {w for p, _ in plain for w in p})
        self.numbers = {w: i + 1 for i, w in enumerate(every)}  # 0 is every other word
        coded = lambda words: np.array([self.numbers[w] for w in words], np.int64)
        df: dict[int, int] = defaultdict(int)
        for _, words, _ in rows:
            for w in set(words):
                df[self.numbers[w]] += 1
        idf = {w: math.log((1 + len(rows)) / n) for w, n in df.items()}
        self.templates = [Template(label, coded(words), [coded(p) for p in phrases], idf) for label, words, phrases in rows]
        self.base = [(coded(p), label) for p, label in plain]
        # Nothing is reported without a base phrase or all key phrases, so a text
        # without the longest word of any of them needs no closer look.
        self.anchors = sorted({max(p, key=len) for p, _ in plain} | {max((w for p in phrases for w in p), key=len) for _, _, phrases in rows})


class Places:
    """Where the words and phrases of the index stand in a file, each sorted."""

    def __init__(self, words: np.ndarray):
        self.words, self.of = words, {}

    def word(self, w: int) -> np.ndarray:
        if w not in self.of:
            self.of[w] = np.flatnonzero(self.words == w)
        return self.of[w]

    def phrase(self, p: np.ndarray) -> np.ndarray:
        key = tuple(p.tolist())
        if key not in self.of:
            at = self.word(key[0])
            at = at[at + len(p) <= len(self.words)]
            for j, w in enumerate(key[1:], 1):
                at = at[self.words[at + j] == w]
            self.of[key] = at
        return self.of[key]


def within(places: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Whether some place lies in [low, high]."""
    return np.searchsorted(places, high, "right") > np.searchsorted(places, low)


def aligned(t: Template, at: Places, have: set[int]) -> float:
    """The largest share of the template's words that stand together, 0 where it is not found."""
    rare = [j for j in t.by_idf if int(t.words[j]) in have][:LOOKUP]
    if len(rare) < t.least:
        return 0.0
    shifts = [at.word(int(t.words[j])) - j for j in rare]
    starts = np.unique(np.concatenate(shifts))
    starts = starts[sum(within(s, starts, starts + t.slack).astype(np.int64) for s in shifts) >= t.least]
    for j, p in t.phrases:
        if not len(starts):
            return 0.0
        starts = starts[within(at.phrase(p), starts + j - SLACK, starts + j + t.slack + SLACK)]
    if not len(starts):
        return 0.0
    stand = np.zeros(len(starts), np.int64)
    for j, w in enumerate(t.words.tolist()):
        stand += within(at.word(w), starts + j, starts + j + t.slack)
    return float(stand.max()) / len(t.words)


def scan(low: bytes, index: Index) -> tuple[int, int | None, int | None, list[str], list[str], float]:
    """n_base, first and last start, base labels, all labels, score of a lower-case text."""
    if not any(a in low for a in index.anchors):
        return 0, None, None, [], [], 0.0
    found = WORD.findall(low)
    words = np.fromiter((index.numbers.get(w, 0) for w in found), np.int64, len(found))
    have = set(np.unique(words).tolist())
    at = Places(words)
    starts, base, score = [], set(), 0.0
    for phrase, label in index.base:
        if have.issuperset(phrase.tolist()) and len(places := at.phrase(phrase)):
            starts.append(places)
            base.add(label)
            score = 1.0
    labels = set(base)
    for t in index.templates:
        if t.needs <= have and (share := aligned(t, at, have)):
            labels.add(t.label)
            score = max(score, share)
    n = sum(map(len, starts))
    return n, min((int(s[0]) for s in starts), default=None), max((int(s[-1]) for s in starts), default=None), sorted(base), sorted(labels), score


RESULT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan_licenses(docs: DataFrame, templates=None, base=None) -> DataFrame:
    """Licence labels of docs (doc_id, text), a row per row of docs.

    Words are runs of ASCII letters and digits and non-ASCII characters, A-Z
    lowered.  Null and empty texts have no words; null ids and repeated rows stay;
    texts are read whole, in time that grows with their length; other columns play no
    part; no rows give no rows."""
    index = Index(templates, base)
    is_word = alnum_words()

    def run(batches):
        import pyarrow as pa

        names = [c.split()[0] for c in RESULT.split(", ")]
        types = [pa.int64()] * 5 + [pa.string(), pa.string(), pa.float64()]
        for batch in batches:
            texts = utf8(batch.column(1))
            for i, j in buffers(texts):
                part = texts[i:j]
                buf = np.frombuffer(b"\n".join(part) + b"\n", np.uint8)
                begins = np.flatnonzero(np.diff(is_word[buf].astype(np.int8), prepend=0) == 1)
                ends = np.cumsum([len(t) + 1 for t in part])
                n_words = np.diff(np.searchsorted(begins, ends), prepend=0)
                rows = [scan(t.translate(LOWER), index) for t in part]
                cols = [batch.column(0).slice(i, j - i), pa.array(n_words, pa.int64()), *([r[k] for r in rows] for k in range(3)), [",".join(r[3]) for r in rows], [",".join(r[4]) for r in rows], [r[5] for r in rows]]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, RESULT)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read_table(spark, sf_dir, "documents"))
