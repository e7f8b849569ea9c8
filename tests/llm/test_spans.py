"""Secrets, personal data and licences against plain versions of their contracts."""

import hashlib
import random
import re

from docweave.llm import licenses, pii, secrets
from docweave.llm.spans import digest
from pyspark.sql import functions as F

ASSIGN = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def plain_secrets(t):
    out = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
    return [(k, s, e) for s, _, k, e in sorted(out)]


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0


def plain_personal(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


PIECES = ["password", "TOKEN", "api_key", "apikey", "secret", "=", ":", " ", '"', "'", "AKIA", "ABCDEFGHIJKLMNOP1234", "0123456789abcdef", "deadbeefdeadbeefdeadbeef", "x", "é", "\n", ".", "a@b.co", "@", "mail", "1.2.3.4", "999.1.1.1", "0001.2.3.4", "+1 (555) 123-4567", "+", "4111 1111 1111 1111", "4111111111111111", "-", "12", "ſecret", "toKen=abcdefg", "..", "%", "٣"]


def random_texts(n=4000):
    r = random.Random(5)
    return ["".join(r.choice(PIECES) for _ in range(r.randint(0, 25))) for _ in range(n)]


def test_base_secrets():
    for t in random_texts():
        assert secrets.find_secrets(t)[0] == plain_secrets(t), t


def test_base_personal():
    for t in random_texts():
        assert pii.find_personal(t) == plain_personal(t), t


def test_long_runs_take_no_quadratic_time():
    for t in ("1" * 200_000, "a" * 200_000 + "@", "@" * 100_000, "a" * 200_000, "1." * 100_000, "password" * 20_000, "+1" + "-" * 100_000):
        secrets.find_secrets(t)
        pii.find_personal(t)


def test_weak_parts_need_complements():
    key = "Zx9fQ2LmN8vT4bYc7Rk1WpD3"
    assert secrets.find_secrets(f"see {key} there")[1] == []
    assert secrets.find_secrets("user: bob42 lives here")[1] == []
    both = f"user: bob42 and then {key} at https://db.example.com/x"
    assert {k for k, _, _ in secrets.find_secrets(both)[1]} == {"identifier", "opaque", "endpoint"}
    apart = f"user: bob42\n\n{key}"
    assert secrets.find_secrets(apart)[1] == []
    assert secrets.find_secrets("user: bob42" + " x" * 400 + key)[1] == []


def test_weak_parts_touch_no_base_span(spark):
    """An opaque token inside a long assignment with many hex runs in it is no span of its own."""
    runs = "/".join("deadbeef" * 4 for _ in range(6))
    text = f"user: bob42 token = {runs}.Zx9fQ2LmN8vT4bYc7Rk1WpD3"
    base, extra = secrets.find_secrets(text)
    assert sum(k == "hex" for k, _, _ in base) == 6
    assert not any(s < b and e > a for k, s, e in extra for _, a, b in base)


def test_secret_rows(spark, awkward, nothing):
    rows = digest(secrets.scan_secrets(awkward), secrets.KINDS, secrets.EXTRA, True)
    assert rows.count() == awkward.count() and rows.where("n_assign + n_access + n_hex > 0").count() == 0
    assert digest(secrets.scan_secrets(nothing), secrets.KINDS, secrets.EXTRA, True).count() == 0
    docs = spark.createDataFrame([(1, "é token = abcdef0123456789abcdef0123")], "doc_id long, text string")
    r = digest(secrets.scan_secrets(docs), secrets.KINDS, secrets.EXTRA, True).first()
    want = "assign:2:36,hex:10:36"
    assert r.spans == want and r.base_sha256 == hashlib.sha256(want.encode()).hexdigest() and (r.n_assign, r.n_access, r.n_hex) == (1, 0, 1)


def test_redaction(spark, awkward):
    docs = spark.createDataFrame([(1, "a token = abcdef99 b", 20), (2, "clean", 5), (3, None, None)], "doc_id long, text string, n_chars long")
    out = {r.doc_id: (r.text, r.n_chars) for r in secrets.redact_secrets(docs).collect()}
    assert out == {1: ("a [SECRET] b", 12), 2: ("clean", 5), 3: (None, None)}
    assert secrets.redact_secrets(awkward).schema == awkward.schema


def test_personal_rows(spark, awkward, nothing):
    rows = digest(pii.scan_personal(awkward), pii.KINDS, pii.EXTRA, False)
    assert rows.count() == awkward.count()
    assert pii.scan_personal(nothing).count() == 0
    docs = spark.createDataFrame([(1, "x a@b.co 1.2.3.4"), (1, "x a@b.co 1.2.3.4"), (2, None)], "doc_id long, text string")
    found = digest(pii.scan_personal(docs), pii.KINDS, pii.EXTRA, False).orderBy("doc_id").collect()
    assert [r.spans for r in found] == ["email:2:8,ip:9:16"] * 2 + [""]


def test_revealing_terms(spark):
    r = random.Random(2)
    common = lambda n: " ".join(r.choice("alpha beta gamma delta omega sigma kappa".split()) for _ in range(n))
    rows = [(i, f"{common(40)} mailto user{i}@site.org {common(40)}") for i in range(40)] + [(100 + i, common(90)) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = pii.scan_personal(docs).select("doc_id", F.explode("extra").alias("x")).select("doc_id", "x.*").collect()
    texts = dict(rows)
    assert len(found) == 40 and {texts[f.doc_id][f.start : f.end] for f in found} == {"mailto"}


def test_entities_are_whole_addresses(spark):
    """Addresses that share their first run are different entities; case is not told apart."""
    hasher = pii.WordHasher(pii.alnum_words(), lower=True)
    value = lambda a: {x["value"] for x in pii.contexts(f"word {a} word", pii.find_personal(f"word {a} word"), hasher)}
    addresses = ["of.1@a.com", "of.2@b.com", "info@x.org", "info@y.org", "info@x.com", "-@-.-", "--@-.-"]
    assert len(set.union(*map(value, addresses))) == len(addresses)
    assert value("Info@X.org") == value("info@x.ORG")
    r = random.Random(3)
    common = lambda n: " ".join(r.choice("alpha beta gamma delta omega sigma kappa".split()) for _ in range(n))
    rows = [(i, f"{common(40)} mailto info@site{i}.org {common(40)}") for i in range(40)] + [(50, f"{common(9)} -@-.- {common(9)}")] + [(100 + i, common(90)) for i in range(40)]
    rows += [(200 + i, f"{common(40)} copied same@site.org {common(40)}") for i in range(40)]
    texts = dict(rows)
    found = pii.scan_personal(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", F.explode("extra").alias("x")).select("doc_id", "x.*").collect()
    assert len(found) == 40 and {texts[f.doc_id][f.start : f.end] for f in found} == {"mailto"}


def test_long_digit_runs(spark):
    """Parts with thousands of zeros are base matches; equal values are one entity, other values are not."""
    zeros = "0" * 5000
    rows = [(1, f"near {zeros}1.2.3.4 far"), (2, "near 1.2.3.4 far"), (3, "near 12.3.4.0 far 1.23.4.0 end"), (4, "9" * 6000 + " x +" + "1" * 6000)]
    found = {r.doc_id: r.spans for r in digest(pii.scan_personal(spark.createDataFrame(rows, "doc_id long, text string")), pii.KINDS, pii.EXTRA, False).collect()}
    assert found == {1: "ip:5:5012", 2: "ip:5:12", 3: "ip:5:13,ip:18:26", 4: ""}
    assert pii.canonical("ip", f"{zeros}1.2.3.{zeros}") == "1.2.3.0" and pii.canonical("ip", "1.23.4.0") != pii.canonical("ip", "12.3.4.0")
    assert pii.canonical("card", "4111 1111-1111 1111") == "4111111111111111"


def test_sanitised_texts(spark, awkward, nothing):
    """Entities and the corpus's revealing terms leave the texts, and nothing else does."""
    r = random.Random(4)
    common = lambda n: " ".join(r.choice("alpha beta gamma delta omega sigma kappa".split()) for _ in range(n))
    rows = [(i, f"é {common(20)} mailto user{i}@site.org {common(20)}", 7) for i in range(40)] + [(100 + i, common(90), 9) for i in range(40)]
    rows += [rows[0], (None, rows[1][1], None), (None, None, None), (300, "", 0), (301, "1.2.3.4 and +1 (555) 123-4567 or 4111 1111 1111 1111, mailto none", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long").repartition(3)
    out = pii.sanitize_personal(docs)
    assert out.schema == docs.schema
    want = []
    for i, t, n in rows:
        new = re.sub(r"mailto user\d+@site\.org", "[TERM] [EMAIL]", t) if t else t
        if i == 301:
            new = "[IP] and [PHONE] or [CARD], mailto none"
        want.append((i, new, n if new == t else len(new)))
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr)
    assert pii.sanitize_personal(awkward).schema == awkward.schema and pii.sanitize_personal(awkward).count() == awkward.count()
    assert pii.sanitize_personal(nothing).count() == 0


def plain_license(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    starts, labels = [], set()
    for p, label in licenses.BASE.items():
        p = p.split()
        at = [i for i in range(len(w)) if w[i : i + len(p)] == p]
        starts += at
        labels |= {label} if at else set()
    return len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def test_licenses(spark, awkward, nothing):
    r = random.Random(8)
    pieces = ["CC", "by", "General", "Public", "License", "all", "RIGHTS", "reserved", "é", "x", "2", ".", "-", "\n", "nc", "MIT", "Released under the"]
    texts = ["".join(r.choice(pieces) + r.choice([" ", " ", "-", ", "]) for _ in range(r.randint(0, 40))) for _ in range(1500)] + [t for t in [None, ""]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in licenses.scan_licenses(docs).collect():
        assert (row.n_words, row.n_base, row.first_word, row.last_word, row.base_labels) == plain_license(texts[row.doc_id] or ""), texts[row.doc_id]
        assert set(filter(None, row.base_labels.split(","))) <= set(filter(None, row.labels.split(","))) and 0 <= row.score <= 1
    assert licenses.scan_licenses(awkward).count() == awkward.count()
    assert licenses.scan_licenses(nothing).count() == 0


def plain_labels(t, index):
    """Labels of the method's own, by loops over every template and shift."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t).encode()
    w = [index.numbers.get(x, 0) for x in licenses.WORD.findall(low)]
    out = set()
    for x in index.templates:
        words = x.words.tolist()
        rare = [j for j in x.by_idf if words[j] in w][: licenses.LOOKUP]
        for shift in range(-len(words), len(w)):
            stands = lambda j: any(w[i] == words[j] for i in range(max(0, shift + j), min(len(w), shift + j + x.slack + 1)))
            if not any(0 <= shift + j < len(w) and w[shift + j] == words[j] for j in rare) or sum(map(stands, rare)) < x.least:
                continue
            if all(any(w[i : i + len(p)] == p.tolist() for i in range(max(0, shift + j - licenses.SLACK), shift + j + x.slack + licenses.SLACK + 1)) for j, p in x.phrases):
                out.add(x.label)
                break
    return out


def test_license_labels_against_brute_force():
    index = licenses.Index()
    r = random.Random(12)
    texts = []
    for _ in range(500):
        words = []
        for _ in range(r.randint(1, 3)):
            part = r.choice(licenses.TEMPLATES)[1].split()
            a = r.randrange(len(part)) if r.random() < 0.3 else 0
            part = part[a : r.randint(a + 1, len(part)) if r.random() < 0.3 else len(part)]
            for _ in range(r.randint(0, 3)):
                at = r.randrange(len(part) + 1)
                part = part[:at] + ["Name", "of"][: r.randint(1, 2)] + part[at + r.randint(0, 1) :]
            words += part + ["and", "x", "license"][: r.randint(0, 3)]
        texts.append(" ".join(words))
    found = 0
    for t in texts:
        _, _, _, base, labels, score = licenses.scan(t.encode().translate(licenses.LOWER), index)
        assert set(labels) == plain_labels(t, index) | set(base), t
        assert (score > 0) == bool(labels) and score <= 1
        found += bool(labels)
    assert found > 200


def test_license_names_and_near_misses():
    index = licenses.Index()
    label = lambda t: ",".join(licenses.scan(t.encode().translate(licenses.LOWER), index)[4])
    assert label("Apache-2.0 license") == "apache-2.0"
    assert label("GNU GPL v3") == "gpl-3.0"
    assert label("SPDX-License-Identifier: MIT") == "mit"
    assert label("BSD 3-Clause License") == "bsd-3-clause"
    assert label("free of charge public domain food in the public domain kitchen") == ""
    assert label("permission is hereby granted to no one; free of charge") == ""
    full = "Copyright (c) 2020 A B. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
    assert licenses.scan(full.encode().translate(licenses.LOWER), index)[4:] == (["mit"], 1.0)


def test_long_repeated_phrases_take_linear_time():
    import time

    index = licenses.Index()
    begin = time.time()
    for phrase in (b"mit license ", b"released under the mit license ", b"public domain to the extent possible under law ", b"cc by ", b"the of license copyright "):
        licenses.scan(phrase * (10_000_000 // len(phrase)), index)
    assert time.time() - begin < 120


def test_license_templates(spark):
    texts = ["foo bar. Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "Licensed under CC BY-NC 4.0.", "the mit of license", "Redistribution and use in source and binary forms, with or without modification, are permitted"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.labels for r in licenses.scan_licenses(docs).orderBy("doc_id").collect()] == ["mit", "apache-2.0", "cc-by,cc-by-nc", "", "bsd"]
