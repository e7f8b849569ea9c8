"""Near duplicates, repeated passages, benchmark passages and top-k against brute force."""

import hashlib
import random

import pytest
from docweave.llm import decontam, jaccard, substrings, topk

from .conftest import awkward_texts, words


def low(t):
    return (t or "").encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")).split()


def shingles(t, k):
    w = low(t)
    return {b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({b" ".join(w)} if w else set())


def plain_components(rows, k, percent):
    sets = [(i, shingles(t, k)) for i, t in rows]
    up = {}

    def find(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if i is not None and j is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(i), find(j)
                up[max(p, q)] = min(p, q)
    return sorted(((i, len(s), None if i is None else find(i)) for i, s in sets), key=repr)


def mutated(n=150):
    r = random.Random(11)
    out = []
    for _ in range(n):
        if out and r.random() < 0.7:
            w = r.choice(out).split()
            for _ in range(r.randint(0, max(1, len(w) // 12))):
                w[r.randrange(len(w))] = f"m{r.randrange(10_000)}"
            out.append(" ".join(w))
        else:
            out.append(words(r, r.choice([3, 8, 20, 60, 150]), 2000))
    return out


@pytest.mark.parametrize("k,percent,block,spread,bands,packed", [(3, 90, 10**6, 16, 8, 2048), (5, 80, 10**6, 16, 8, 2048), (3, 60, 400, 16, 8, 2048), (3, 70, 400, 1, 1, 2048), (2, 50, 300, 0, 8, 2048), (3, 70, 400, 1, 1, 0), (2, 50, 300, 0, 8, 0)])
def test_components(spark, k, percent, block, spread, bands, packed, monkeypatch):
    """Small blocks, few bands and a low spread put likely partners apart, shingles travel packed or as rows: no link may be lost."""
    for name, value in (("BLOCK", block), ("SPREAD", spread), ("BANDS", bands), ("PACKED", packed)):
        monkeypatch.setattr(jaccard, name, value)
    rows = list(enumerate(mutated()))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = sorted((tuple(r) for r in jaccard.similarity_components(docs, k, percent).select("doc_id", "n_shingles", "component_id").collect()), key=repr)
    assert found == plain_components(rows, k, percent)


def test_awkward_components(spark, awkward, nothing):
    rows = [(r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect()]
    found = sorted((tuple(r) for r in jaccard.similarity_components(awkward, 3, 90).select("doc_id", "n_shingles", "component_id").collect()), key=repr)
    assert found == plain_components(rows, 3, 90)
    assert jaccard.similarity_components(nothing, 3, 90).count() == 0


def test_first_of_each(spark, awkward):
    kept = jaccard.first_of_each(awkward)
    assert kept.schema.names == awkward.schema.names
    want = {i for i, _, c in plain_components([(r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect()], 5, 80) if i == c}
    assert {r.doc_id for r in kept.select("doc_id").collect()} == want | {None}


def test_ids_at_the_ends_of_their_range(spark):
    """Hash-like ids: sums of them would not fit a long."""
    r = random.Random(21)
    ids = [2**63 - 1, -(2**63), 2**62 + 5, 2**63 - 7, -(2**63) + 3, 2**62 + 9, 0, -1]
    base, other = words(r, 60), words(r, 60)
    rows = [(i, (base if k % 2 else other) + f" tail{k // 4}") for k, i in enumerate(ids)] + [(2**61, words(r, 40, 9000))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = sorted((tuple(x) for x in jaccard.similarity_components(docs, 3, 90).collect()), key=repr)
    assert found == plain_components(rows, 3, 90)
    assert {x.doc_id for x in jaccard.first_of_each(docs, 3, 90).collect()} == {i for i, _, c in plain_components(rows, 3, 90) if i == c}
    links = spark.createDataFrame([(ids[0], ids[3]), (ids[3], ids[2]), (ids[1], ids[4])], "src long, dst long")
    assert {(x.id, x.component) for x in jaccard.connected_components(links).collect()} == {(ids[0], ids[2]), (ids[3], ids[2]), (ids[2], ids[2]), (ids[1], ids[1]), (ids[4], ids[1])}


def plain_removal(rows, k):
    first, out = {}, []
    split = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in split:
        for s in range(len(w) - k + 1):
            if i is not None:
                key = tuple(w[s : s + k])
                first[key] = min(first.get(key, (i, s)), (i, s))
    for i, w in split:
        gone = set()
        for s in range(len(w) - k + 1):
            if i is not None and first[tuple(w[s : s + k])] < (i, s):
                gone |= set(range(s, s + k))
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for p, x in enumerate(w) if p not in gone)).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("window", [20, 6])
def test_repeats(spark, window):
    r = random.Random(4)
    passages = [words(r, n, 40) for n in (10, 25, 60)]
    rows = [(i, " ".join(r.choice([*passages, words(r, 7, 3), words(r, 12, 900), "a a a a a a a a", "b c b c b c b c b c"]) for _ in range(r.randint(0, 9)))) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = substrings.finish(docs, window, "h string", lambda b: hashlib.sha256(b).hexdigest()).collect()
    assert sorted((tuple(x) for x in found), key=repr) == plain_removal(rows, window)


def test_awkward_repeats(spark, awkward, nothing):
    rows = [(r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect()]
    found = substrings.finish(awkward, 20, "h string", lambda b: hashlib.sha256(b).hexdigest()).collect()
    assert sorted((tuple(x) for x in found), key=repr) == plain_removal(rows, 20)
    assert substrings.without_repeats(nothing).count() == 0


def test_repeats_take_texts_in_small_batches(spark, monkeypatch):
    r = random.Random(9)
    passage = words(r, 400, 90_000)
    rows = [(i, words(r, 1200, 90_000) + (" " + passage if i % 50 == 0 else "")) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    whole = substrings.utf8

    def within(column):
        assert column.nbytes < 3 << 20, "a batch holds far more than 2 MB"
        return whole(column)

    monkeypatch.setattr(substrings, "utf8", within)
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    assert sum(len(t) for _, t in rows) > 3 << 20
    found = substrings.finish(docs, 20, "h string", lambda b: hashlib.sha256(b).hexdigest())
    assert spark.conf.get(name) == before
    assert sorted((tuple(x) for x in found.collect()), key=repr) == plain_removal(rows, 20)


def test_benchmark_passages(spark, awkward, nothing):
    r = random.Random(6)
    items = [(i, words(r, n, 5000)) for i, n in enumerate((6, 15, 30, 60, 3))] + [(9, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    spoilt = items[3][1].split()
    for at in range(4, 60, 7):
        spoilt[at] = "other"
    rows = [(0, "clean " + words(r, 300, 5000)), (1, words(r, 40) + " " + items[2][1].upper() + ". " + words(r, 30)), (2, " ".join(spoilt)), (3, items[0][1]), (4, " ".join(items[3][1].split()[10:30])), (5, items[4][1]), (6, None), (6, ""), (1, items[1][1])]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, item_id int, similarity string")
    found = {(x.doc_id, x.item_id, x.item_start, x.n_words) for x in decontam.contaminated(docs, bench).collect()}
    assert {(d, i) for d, i, _, _ in found} == {(1, 2), (2, 3), (3, 0), (4, 3), (1, 1), (5, 4)}
    assert (1, 2, 0, 30) in found and (4, 3, 10, 20) in found and (2, 3, 0, 60) in found
    assert sorted(x.doc_id for x in decontam.drop_contaminated(docs, bench).collect()) == [0, 6, 6]
    assert decontam.contaminated(nothing, bench).count() == 0 and decontam.contaminated(docs, bench.limit(0)).count() == 0
    assert decontam.drop_contaminated(awkward, bench).count() == awkward.count()


def test_items_in_many_blocks(spark, monkeypatch):
    """Blocks of a few items give what one block gives."""
    r = random.Random(16)
    items = [(i, words(r, n, 500)) for i, n in enumerate((1, 2, 3, 4, 7, 12, 30, 60, 25, 25))] + [(3, None), (4, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(i, " ".join([words(r, 30, 500), r.choice(items[:10])[1].upper(), words(r, 20, 500)])) for i in range(40)] + [(50 + i, words(r, 60, 10**6)) for i in range(5)] + [(None, items[7][1]), (7, None), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    whole = sorted((tuple(x) for x in decontam.contaminated(docs, bench).collect()), key=repr)
    kept = sorted((tuple(x) for x in decontam.drop_contaminated(docs, bench).collect()), key=repr)
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 100)
    assert decontam.items_of(bench)[1] > 5 and len(whole) > 30 and len(kept) >= 7
    assert sorted((tuple(x) for x in decontam.contaminated(docs, bench).collect()), key=repr) == whole
    assert sorted((tuple(x) for x in decontam.drop_contaminated(docs, bench).collect()), key=repr) == kept


def test_repetitive_texts_take_no_quadratic_time():
    import time

    hasher = decontam.WordHasher(decontam.alnum_words(), lower=True)
    index = decontam.Index([0, 1], [b"a " * 200, b"a b " * 100], hasher)
    begin = time.time()
    found = decontam.overlaps([b"a " * 20_000, b"a b " * 10_000], index, index.filter(), hasher)
    assert {(t, i) for t, i, *_ in found} == {(0, 0), (1, 1)} and time.time() - begin < 30


def plain_overlaps(texts, items):
    """(text, item) pairs with an overlap on any alignment."""
    import math

    out = set()
    for t, text in enumerate(texts):
        for i, w in enumerate(items):
            need = min(decontam.MIN_WORDS, math.ceil(0.8 * len(w)))
            for shift in range(1 - len(w), len(text)):
                a, b = max(0, -shift), min(len(w), len(text) - shift)
                same = [text[shift + k] == w[k] for k in range(a, b)]
                if sum(same) and any(same[x] and same[y - 1] and 5 * sum(same[x:y]) >= 4 * (y - x) for x in range(b - a) for y in range(x + need, b - a + 1)):
                    out.add((t, i))
                    break
    return out


def test_recall_over_all_alignments():
    """Random texts that hold items with up to a fifth of the words substituted: what no seed finds is little."""
    r = random.Random(31)
    items = [words(r, r.choice([2, 4, 6, 9, 12, 15, 20, 30, 45]), 4000).split() for _ in range(30)]
    texts = []
    for _ in range(250):
        w = list(r.choice(items))
        for _ in range(r.randint(0, len(w) // 5)):
            w[r.randrange(len(w))] = "other"
        a = r.randint(0, len(w) // 4)
        texts.append(words(r, r.randint(0, 15), 4000).split() + w[a : len(w) - r.randint(0, len(w) // 4)] + words(r, r.randint(0, 15), 4000).split())
    want = plain_overlaps(texts, items)
    hasher = decontam.WordHasher(decontam.alnum_words(), lower=True)
    index = decontam.Index(list(range(len(items))), [" ".join(w).encode() for w in items], hasher)
    found = {(t, i) for t, i, *_ in decontam.overlaps([" ".join(t).encode() for t in texts], index, index.filter(), hasher)}
    assert found <= want and len(want) > 120
    print("recall", len(found) / len(want), len(want))
    assert len(found) >= 0.95 * len(want)


def test_short_items_lose_no_overlap():
    """Items of 5 to 10 words with every placing of up to three substitutions, inside a text and cut at its ends."""
    import itertools
    import math

    hasher = decontam.WordHasher(decontam.alnum_words(), lower=True)
    items = [[f"i{n}w{k}" for k in range(n)] for n in range(5, 11)] + [["x", "y", "x", "y", "x", "x"]]
    index = decontam.Index(list(range(len(items))), [" ".join(w).encode() for w in items], hasher)
    texts = []
    for w in items:
        for gone in (g for m in range(4) for g in itertools.combinations(range(len(w)), m)):
            body = ["other" if k in gone else x for k, x in enumerate(w)]
            texts += [["a", "b", *body, "c", "d"], body, ["a", *body[:-1]], [*body[1:], "c"]]
    want = set()
    for t, text in enumerate(texts):
        for i, w in enumerate(items):
            for shift in range(1 - len(w), len(text)):
                a, b = max(0, -shift), min(len(w), len(text) - shift)
                same = [text[shift + k] == w[k] for k in range(a, b)]
                spans = [(y - x) for x in range(b - a) for y in range(x + 1, b - a + 1) if same[x] and same[y - 1] and 5 * sum(same[x:y]) >= 4 * (y - x)]
                if max(spans, default=0) >= math.ceil(0.8 * len(w)):
                    want.add((t, i, shift, max(spans)))
    found = decontam.overlaps([" ".join(t).encode() for t in texts], index, index.filter(), hasher)
    assert {(t, i, at - place, n) for t, i, at, place, n, _ in found} == want and len(found) == len(want) > 500


def test_longest_span():
    import numpy as np

    r = np.random.default_rng(0)
    for _ in range(300):
        same = r.random(r.integers(1, 25)) < 0.7
        best = max((j - i for i in range(len(same)) for j in range(i + 1, len(same) + 1) if same[i] and same[j - 1] and 5 * same[i:j].sum() >= 4 * (j - i)), default=0)
        a, b = decontam.longest_span(same)
        assert b - a == best


def test_topk(spark):
    import math

    r = random.Random(9)
    v = [[r.choice([-0.5, 0.25, 0.125, 0.7]) for _ in range(6)] for _ in range(400)]
    rows = [(i, x) for i, x in enumerate(v)] + [(1000, None), (1050, [0.1, None, 0.2, 0.1, 0.1, 0.1]), (1100, [float("nan")] * 6), (1150, [float("inf")] * 6), (1200, [0.5, 0.5]), (None, v[0]), (1250, [1e12] * 6)]
    table = spark.createDataFrame([(i, x, 7) for i, x in rows], "vec_id long, embedding array<double>, score int").repartition(5)
    found = topk.exact_topk(table, table.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect()
    good = [(i, [math.floor(256 * c) for c in x]) for i, x in rows if i is not None and x and all(c is not None and math.isfinite(c) for c in x)]
    want = []
    for q, x in good:
        if q % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), i) for i, y in good if i != q and len(y) == len(x))
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:5])]
    assert [tuple(x) for x in found if x.query_id != 1250] == [w for w in sorted(want) if w[0] != 1250]


def test_topk_repeated_queries(spark):
    """Of a query id's rows one that can be asked is asked, always the same one."""
    nan, inf = float("nan"), float("inf")
    table = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    for bad in (None, [None, 1.0], [nan, 1.0], [inf, 1.0], [-inf, 1.0]):
        for rows in ([(0, bad), (0, [1.0, 0.5])], [(0, [1.0, 0.5]), (0, bad)]):
            asked = spark.createDataFrame(rows, table.schema).coalesce(1)
            assert [tuple(x) for x in topk.exact_topk(table, asked, 1).collect()] == [(0, 1, 1, 65536)], rows
    for rows in ([(0, [0.5, 1.0]), (0, [1.0, 0.5])], [(0, [1.0, 0.5]), (0, [0.5, 1.0])]):
        asked = spark.createDataFrame(rows, table.schema).coalesce(1)
        assert [tuple(x) for x in topk.exact_topk(table, asked, 1).collect()] == [(0, 1, 2, 65536)]


def test_topk_few_rows(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.exact_topk(empty, empty).count() == 0
    two = spark.createDataFrame([(0, [1.0]), (1, [1.0])], "vec_id long, embedding array<float>")
    assert [tuple(x) for x in topk.exact_topk(two, two).orderBy("query_id").collect()] == [(0, 1, 1, 65536), (1, 1, 0, 65536)]


def test_awkward_texts_hold_what_they_should():
    assert None in awkward_texts() and "" in awkward_texts()
