"""Quality, page text and the pipeline: held-out accuracy, planted cases, brute force."""

import zlib

import corpus_pipeline
import numpy as np
from docweave.llm import html, quality
from docweave.llm.base import materialize
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.1"


def test_quality_on_held_out_rows(spark):
    scored = quality.op8(spark, SF)
    rows = scored.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").collect()
    assert len(rows) > 500 and np.mean([r.predicted == r.quality for r in rows]) > 0.98
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in scored.limit(500).collect())


def test_rules_compile_to_what_they_score(spark):
    r = np.random.default_rng(1)
    x = r.random((800, len(quality.FEATURES)))
    y = ((x[:, 3] > 0.5) & (x[:, 6] < 0.7)).astype(int)
    model = quality.fit_rules(x, y)
    assert np.mean((model.score(x) >= 0.5) == y) > 0.97 and len(model.rules) < 175
    df = spark.createDataFrame(x.tolist(), list(quality.FEATURES)).select(F.struct(*quality.FEATURES).alias("s"))
    assert np.allclose(np.sort([row[0] for row in df.select(model.column("s")).collect()]), np.sort(model.score(x)))


def test_quality_of_awkward_rows(spark, awkward, nothing):
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(60)] + [(None, 1), (4, None)], "doc_id long, quality int")
    model = quality.train(awkward, labels)
    scored = quality.score_quality(awkward, model)
    assert scored.count() == awkward.count() and scored.where("score between 0 and 1").count() == awkward.count()
    assert quality.score_quality(nothing, model).count() == 0
    bare = quality.train(nothing, labels.limit(0))
    assert bare.score(np.zeros((1, len(quality.FEATURES))))[0] == 0.5
    assert quality.keep_good(awkward, labels).columns == awkward.columns


ARTICLE = "Some words of the article stand here, and they go on for a while so that it is long."


def text_of(body):
    return html.extract([f"<html><head><title>t</title></head><body>{body}</body></html>"], html.models())[0]


def test_pages_as_laid_out(spark):
    import re
    from html import unescape

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    sources = {r.page_id: r.html for r in pages.collect()}
    for r in html.main_text(pages).collect():
        body = re.search(r"<article>(.*?)</article>", sources[r.page_id], re.S)[1]
        blocks = [" ".join(unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", body)]
        assert r.text == "\n\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_other_layouts():
    want = f"A title\n\n{ARTICLE}\n\n{ARTICLE} & more"
    inner = f"<h1>A title</h1><p>{ARTICLE}</p><p>{ARTICLE.replace(' ', '  ')} &amp;\n more</p>"
    comments = f'<section class="comments"><h3>Comments</h3><div class="comment"><p>{ARTICLE}</p></div></section>'
    for body in (
        f"<nav><ul><li><a href=/>Home</a></li></ul></nav><article>{inner}</article>{comments}<footer>&copy; us</footer>",
        f'<div class="header"><a href=/>Logo</a></div><div class="content">{inner}</div><div class="sidebar"><p>Related {ARTICLE}</p></div>',
        f'<div class="cookie-notice">We use cookies</div><main>{inner}</main><form><input>Search<button>Go</button></form>',
        f'<header><h2>Site</h2></header><article>{inner}</article><aside><h3>More</h3><ul><li><a href=/a>x</a></li></ul></aside><script>var a = "<p>";</script>',
    ):
        assert text_of(body) == want


def test_long_sibling_lists():
    """Each node's place among several hundred siblings, and what stands behind them, is seen."""
    paragraphs = "".join(f"<p>{i} {ARTICLE}</p>" for i in range(400))
    trail = "".join(f'<div class="ad"><a href=/{i}>Buy {i}</a></div>' for i in range(20)) + '<div class="footer">&copy; us</div>'
    page = html.Page(f"<html><body>{paragraphs}{trail}</body></html>")
    nodes, x, _ = html.measure(page)
    siblings = [v for v in nodes if v.parent and len(v.parent.children) == 421]
    place = {id(v): row[-4] for v, row in zip(nodes, x, strict=True)}
    assert len(siblings) == 421 and [place[id(v)] for v in siblings] == [k / 421 for k in range(421)]
    assert text_of(paragraphs + trail) == "\n\n".join(f"{i} {ARTICLE}" for i in range(400))


def test_broken_pages(spark, nothing):
    for source in ("", "<", "<p", "<p>a<p>b", "<!-- x", "<script>x", "a < b", "<div " * 300, "<a href='x>y", "<b>" * 5000 + "x"):
        html.extract([source], html.models())
    rows = [(1, "u", None), (1, "u", None), (None, None, "<p>x</p>"), (2, "v", "")]
    pages = spark.createDataFrame([(*r, "t", 3) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    found = html.main_text(pages).collect()
    assert len(found) == 4 and [r.n_chars for r in found if r.page_id is not None] == [0, 0, 0]
    assert html.main_text(pages.limit(0)).count() == 0


def test_pipeline_stages(spark):
    """Each stage against a plain reading of it, on its own input."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = materialize(stage(spark, docs, sf), "test")
        assert docs.columns == columns
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
        gone = set(before) - set(kept[name])
        if name == "quality":
            known = [i for i in before if i in labels]
            assert np.mean([(i not in gone) == bool(labels[i]) for i in known]) > 0.97
        elif name == "near_duplicates":
            seen = set()
            for i, t in sorted(before.items()):
                key = " ".join(t.lower().split())
                assert key not in seen or i in gone
                seen.add(key)
        elif name == "decontamination":
            for item in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
                assert not any(item.text in t for t in kept[name].values())
        else:
            assert not gone and not any("token = " in t for t in kept[name].values())
    name, stage = corpus_pipeline.STAGES[-1]
    packed = stage(spark, docs, sf)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(kept["secrets"])
