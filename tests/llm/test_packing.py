import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
from docweave.llm.packing import differencing, pack_documents, pack_group
from tokenizers import Tokenizer


def check(rows, texts):
    tk = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    for d, parts in by_doc.items():
        ids = np.array([*tk.encode(texts[d] or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(parts, key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    padding = total = 0
    for parts in by_seq.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
        total += at
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    return padding / max(1, total)


def test_every_id_once_and_little_padding(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    assert check(pack_documents(docs).collect(), texts) < 0.02


def test_awkward_rows(spark, awkward):
    rows = awkward.where("doc_id is not null").dropDuplicates(["doc_id"])
    texts = {r.doc_id: r.text for r in rows.select("doc_id", "text").collect()}
    check(pack_documents(rows).collect(), texts)
    every = pack_documents(awkward).collect()
    assert sum(r.length for r in every if r.doc_id is None) == sum(r.doc_tokens for r in {(r.doc_tokens, r.ids_crc32): r for r in every if r.doc_id is None and r.start == 0}.values())


def test_special_strings_and_long_runs(spark):
    """As the tokenizers file has it: the string of an added token is that token."""
    texts = {1: "a <|endoftext|> b", 2: " " * 3_000_000, 3: "a" * 300_000, 4: "x\n <|endoftext|>", 5: "a b " * 400_000}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    check(pack_documents(docs).collect(), texts)
    assert 50256 in Tokenizer.from_file(P.path("byte_bpe_50k.json")).encode(texts[1], add_special_tokens=False).ids


def test_no_rows(nothing):
    assert pack_documents(nothing).count() == 0


def test_differencing_is_even():
    r = random.Random(1)
    for k in (1, 2, 7, 33):
        lengths = [r.randint(1, 300) for _ in range(10 * k)]
        loads = [sum(lengths[i] for i in w) for w in differencing(lengths, k)]
        assert sorted(i for w in differencing(lengths, k) for i in w) == list(range(len(lengths)))
        assert max(loads) - min(loads) <= 60
    assert differencing([], 3) == []


def test_windows_rise_with_capacity():
    found = pack_group([60, 60, 60], 100)
    assert len(found) == 3 and all(len(w) == 1 for w in found)


def test_pieces_give_the_ids_of_whole_texts(monkeypatch):
    """Texts cut into pieces against whole texts by an unmodified tokenizer, with little memory too."""
    from docweave.llm.packing import Encoder

    plain = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    r = random.Random(1)
    alphabet = [" ", " ", "\n", "\t", "a", "the", "'s", "'S", "é", "漢", "🙂", "́", "1", "٣", "½", "_", "-", "\r\n", "\x1c", "\x85", "\xa0", "\u1680", "\u2003", "\u3000", "​", "İ", "<|endoftext|>", "\x00", "Ⅷ", "  "]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 40))) for _ in range(6000)] + ["", " ", " a", "a ", " " * 5000, "a" * 5000, "!?" * 3000, "漢字 " * 2000]
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    for pieces, step in ((10**6, 10**6), (50, 7)):
        monkeypatch.setattr(Encoder, "STEP", step)
        e = Encoder(P.path("byte_bpe_50k.json"), pieces)
        for i in range(0, len(texts), 11):
            assert [x.tolist() for x in e.encode([t.encode() for t in texts[i : i + 11]])] == want[i : i + 11]
    assert e.encode([]) == []
