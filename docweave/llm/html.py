"""Operator 10: main text of web pages.

Method: gradient-boosted trees over DOM nodes with hierarchical decoding.  Two
models score every block element: all of its text is of the article, and none
is.  Features are subtree density, attribute tokens, depth and sibling
statistics.  Decoding chooses for each node, from the leaves up, the likeliest
of keeping all, dropping all, or deciding child by child; so no descendant
contradicts its ancestor.  The models are trained here, on pages that a seeded
generator lays out in many ways, with known labels.
"""

from __future__ import annotations

import math
import random

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .base import read_table
from .boosting import Trees
from .dom import Node, Page

SEED = 7
#: Pages that the generator lays out for training; a bound that no input changes.
TRAINING_PAGES = 900

#: Attribute tokens by what they usually mark.
TOKENS = {
    "menu": "nav navigation menu navbar breadcrumb breadcrumbs pagination pager toc topbar skip",
    "header": "header masthead banner logo brand hero top",
    "footer": "footer copyright legal colophon bottom foot",
    "side": "sidebar side aside widget related recommended more popular trending rail secondary complementary",
    "notice": "cookie cookies consent notice alert gdpr popup modal overlay newsletter subscribe paywall toast message warning",
    "advert": "ad ads advert advertisement adsense sponsor sponsored promo promotion dfp outbrain taboola",
    "share": "share sharing social tags tag meta byline author follow like buttons toolbar",
    "comment": "comment comments reply replies respond disqus discussion thread responses",
    "form": "form login signup search contact input",
    "content": "content article main post entry body story text page prose copy",
}
TAGS = ["body", "div", "section", "article", "main", "p", "nav", "header", "footer", "aside", "form", "ul ol dl menu", "li dd dt", "h1", "h2 h3 h4 h5 h6", "table tbody thead tfoot tr td th caption", "blockquote pre figure figcaption"]
GROUP = {t: i for i, names in enumerate(TAGS) for t in names.split()}
CATEGORY = {t: i for i, words in enumerate(TOKENS.values()) for t in words.split()}
ENDS = ".!?;:…"


def measure(page: Page) -> tuple[list[Node], np.ndarray, list[int]]:
    """Nodes that hold text, their features, and the characters of each."""
    n = len(page.nodes)
    number = {id(v): i for i, v in enumerate(page.nodes)}
    parent = [number[id(v.parent)] if v.parent else -1 for v in page.nodes]
    chars, linked, links, ends, blocks, paras, tags, begin = ([0] * n for _ in range(8))
    at = 0
    for text, in_links, n_links, node in page.blocks:
        i = number[id(node)]
        if not blocks[i]:
            begin[i] = at
        chars[i] += len(text)
        linked[i] += in_links
        links[i] += n_links
        ends[i] += sum(map(text.count, ENDS))
        blocks[i] += 1
        at += len(text)
    own = list(chars)
    for i, v in enumerate(page.nodes):
        tags[i] += 1
        paras[i] += v.tag == "p" and own[i] > 80
    for i in range(n - 1, 0, -1):
        p = parent[i]
        if chars[i]:
            if not blocks[p] or begin[i] < begin[p]:
                begin[p] = begin[i]
            for acc in (chars, linked, links, ends, blocks, paras):
                acc[p] += acc[i]
        tags[p] += tags[i]
    total = max(1, chars[0])
    cats = [0] * n
    above = [0] * n
    tag_above = [0] * n
    place = {id(c): k for v in page.nodes for k, c in enumerate(v.children)}
    rows, kept = [], []
    width = len(TOKENS)
    for i, v in enumerate(page.nodes):
        mask = 0
        for t in v.tokens:
            if t in CATEGORY:
                mask |= 1 << CATEGORY[t]
        cats[i] = mask
        g = GROUP.get(v.tag, 1)
        p = parent[i]
        if p >= 0:
            above[i] = above[p] | cats[p]
            tag_above[i] = tag_above[p] | 1 << GROUP.get(page.nodes[p].tag, 1)
        if not chars[i]:
            continue
        sib = v.parent.children if v.parent else [v]
        inherited = tag_above[i]
        rows.append(
            [
                *(float(g == k) for k in range(len(TAGS))),
                *(float(mask >> k & 1) for k in range(width)),
                *(float(above[i] >> k & 1) for k in range(width)),
                *(float(inherited >> k & 1) for k in (3, 4, 6, 7, 8, 9, 10)),
                float(v.depth),
                math.log1p(chars[i]),
                chars[i] / total,
                linked[i] / chars[i],
                links[i] / blocks[i],
                ends[i] / (1 + chars[i] / 100),
                chars[i] / tags[i],
                chars[i] / blocks[i],
                own[i] / chars[i],
                float(paras[i]),
                float(len(sib)),
                place.get(id(v), 0) / len(sib),
                begin[i] / total,
                chars[i] / max(1, chars[p]) if p >= 0 else 1.0,
                float(paras[p]) if p >= 0 else 0.0,
            ]
        )
        kept.append(i)
    return [page.nodes[i] for i in kept], np.array(rows, float) if rows else np.zeros((0, 1)), [chars[i] for i in kept]


def decode(page: Page, nodes: list[Node], sizes: list[int], all_in: np.ndarray, all_out: np.ndarray) -> list[int]:
    """Blocks to keep: the likeliest consistent choice over the tree."""
    number = {id(v): i for i, v in enumerate(nodes)}
    best: list[float] = [0.0] * len(nodes)
    choice: list[str] = [""] * len(nodes)
    for i in range(len(nodes) - 1, -1, -1):
        v, size = nodes[i], math.sqrt(sizes[i])
        inside, outside = size * math.log(all_in[i]), size * math.log(all_out[i])
        choice[i], best[i] = ("in", inside) if inside > outside else ("out", outside)
        parts = [number[id(c)] for c in v.children if id(c) in number]
        if parts:
            own = math.sqrt(sum(len(page.blocks[b][0]) for b in v.blocks))
            split = sum(best[c] for c in parts) + own * max(math.log(all_in[i]), math.log(all_out[i]))
            if split >= best[i]:
                choice[i], best[i] = "split", split
    keep, todo = [], [(nodes[0], None)] if nodes else []
    while todo:
        v, forced = todo.pop()
        i = number.get(id(v))
        if i is None:
            continue
        state = forced or choice[i]
        if state == "in" or state == "split" and all_in[i] > all_out[i]:
            keep += v.blocks
        if state != "out":
            todo += [(c, "in" if state == "in" else None) for c in v.children]
    return sorted(keep)


# ------------------------------------------------- training pages


def words(r: random.Random, n: int) -> str:
    syllables = "ka lo mi ter an so ve ri du pan el or un sta chi ne".split()
    out = ["".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(n)]
    for i in range(0, n, r.randint(6, 14)):
        out[i] = out[i].capitalize()
        if i:
            out[i - 1] += r.choice(".,.")
    return " ".join(out) + r.choice([".", ".", ".", "", "!"])


def attr(r: random.Random, category: str, chance: float = 0.8) -> str:
    if r.random() > chance:
        return ""
    token = r.choice(TOKENS[category].split())
    extra = r.choice(["", "", " x1", " box", "-wrap", "-list", " clearfix"])
    return f' {r.choice(["class", "class", "id"])}="{token}{extra}"'


def links(r: random.Random, n: int) -> str:
    return "<ul>" + "".join(f'<li><a href="/x">{words(r, r.randint(1, 4))[:30]}</a>{r.choice(["</li>", ""])}' for _ in range(n)) + "</ul>"


def boilerplate(r: random.Random, kind: str) -> str:
    short, long = words(r, r.randint(2, 12)), words(r, r.randint(8, 60))
    if kind == "menu":
        tag = r.choice(["nav", "nav", "div", "ul"])
        return f"<{tag}{attr(r, 'menu', 0.9 if tag != 'nav' else 0.3)}>{links(r, r.randint(2, 9))}</{tag}>"
    if kind == "header":
        tag = r.choice(["header", "header", "div"])
        inner = r.choice([f"<div>{short}</div>", f"<h2>{short}</h2><p>{words(r, 5)}</p>", links(r, 4), short])
        return f"<{tag}{attr(r, 'header', 0.95 if tag == 'div' else 0.4)}>{inner}</{tag}>"
    if kind == "footer":
        tag = r.choice(["footer", "footer", "div"])
        inner = r.choice([f"&copy; {short}", f"<p>{long}</p>", links(r, 5), f"&copy; {short} &middot; {long}", f"<p>{short}</p><p>{long}</p>"])
        return f"<{tag}{attr(r, 'footer', 0.95 if tag == 'div' else 0.3)}>{inner}</{tag}>"
    if kind == "side":
        tag = r.choice(["aside", "aside", "div", "section"])
        inner = r.choice([f"<h3>{words(r, 3)}</h3>{links(r, 5)}", f"<p>{long}</p>", f"<h3>{words(r, 3)}</h3><p>{long}</p><p>{short}</p>", short])
        return f"<{tag}{attr(r, 'side', 0.97 if tag != 'aside' else 0.4)}>{inner}</{tag}>"
    if kind == "form":
        inner = r.choice([f"<label>{short}</label><input><button>{words(r, 1)}</button>", f"<p>{long}</p><input>", f"{short}<select><option>{short}</option></select>"])
        return f"<form{attr(r, 'form', 0.4)}>{inner}</form>"
    if kind == "comment":
        n = r.randint(1, 6)
        item = r.choice(["li", "div", "article", "p"])
        body = "".join(f"<{item}{attr(r, 'comment', 0.5)}>{r.choice(['', '<b>' + words(r, 1) + '</b> '])}{f'<p>{words(r, r.randint(4, 70))}</p>' if item != 'p' else words(r, r.randint(4, 70))}</{item}>" for _ in range(n))
        tag = r.choice(["section", "div", "ol" if item == "li" else "div"])
        return f"<{tag}{attr(r, 'comment', 1.0)}>{r.choice(['', f'<h3>{words(r, 2)}</h3>'])}{body}</{tag}>"
    tag = r.choice(["div", "div", "section", "p", "aside"])
    inner = r.choice([short, long, short]) if tag == "p" else r.choice([short, long, f"<p>{long}</p>", f"<span>{short}</span>", f'<a href="/a">{short}</a>'])
    return f"<{tag}{attr(r, kind, 1.0)}>{inner}</{tag}>"


def article(r: random.Random) -> str:
    y = ' data-y="1"'
    parts = [f"<h1{y}>{words(r, r.randint(2, 14))}</h1>"] if r.random() < 0.85 else []
    for _ in range(r.choice([1, 1, 2, 3, 4, 6, 9, 14])):
        roll, text = r.random(), words(r, r.choice([1, 3, 8, 20, 40, 80, 160]))
        if roll < 0.72:
            text = r.choice([text, text, f"<b>{text}<br>", f'{text} <a href="/l">{words(r, 2)}</a> {words(r, 6)}', f"{text}<br>{words(r, 9)}"])
            parts.append(f"<p{y}>{text}{r.choice(['</p>', '</p>', ''])}")
        elif roll < 0.8:
            parts.append(f"<h2{y}>{words(r, 4)}</h2>")
        elif roll < 0.86:
            parts.append(f"<ul{y}>" + "".join(f"<li{y}>{words(r, r.randint(3, 20))}</li>" for _ in range(r.randint(2, 6))) + "</ul>")
        elif roll < 0.9:
            parts.append(f"<blockquote{y}><p{y}>{text}</p></blockquote>")
        elif roll < 0.93:
            parts.append(f"<table{y}><tr{y}><td{y}>{words(r, 3)}</td><td{y}>{words(r, 3)}</td></tr></table>")
        elif roll < 0.96:
            parts.append(f"<pre{y}>{text}</pre>")
        else:
            parts.append(f"<div{y}>{text}</div>")
    for kind in ("advert", "share", "side", "notice", "form"):
        if r.random() < 0.08:
            parts.insert(r.randint(0, len(parts)), boilerplate(r, kind))
    return "".join(parts)


def training_page(r: random.Random) -> str:
    before = [k for k in ("header", "menu", "notice", "advert", "form", "menu") if r.random() < 0.4]
    after = [k for k in ("share", "side", "comment", "advert", "form", "notice", "footer") if r.random() < 0.4]
    r.shuffle(before)
    tag = r.choice(["article", "article", "article", "main", "div", "div", "section", ""])
    inner = article(r) if r.random() > 0.03 else ""
    if tag == "div" or tag == "section":
        inner = f"<{tag}{attr(r, 'content', 0.8)}>{inner}</{tag}>"
    elif tag:
        inner = f"<{tag}{attr(r, 'content', 0.3)}>{inner}</{tag}>"
    if after and after[0] in ("share", "comment", "side") and tag and r.random() < 0.3:
        cut = inner.rindex("</")
        inner = inner[:cut] + boilerplate(r, after.pop(0)) + inner[cut:]
    main = "".join(boilerplate(r, k) for k in before) + inner + "".join(boilerplate(r, k) for k in after)
    for _ in range(r.choice([0, 0, 1, 2])):
        main = f"<div{attr(r, r.choice(['content', 'header', 'content']), 0.3)}>{main}</div>"
    return f"<html><head><title>{words(r, 4)}</title></head><body>{main}{r.choice(['</body></html>', ''])}"


def labelled(page: Page, nodes: list[Node]) -> tuple[np.ndarray, np.ndarray]:
    """Whether all, and whether none, of each node's text is of the article."""
    good, bad = {}, {}
    for text, _, _, node in page.blocks:
        side = good if node.label == "1" else bad
        v: Node | None = node
        while v is not None:
            side[id(v)] = side.get(id(v), 0) + len(text)
            v = v.parent
    return np.array([id(v) not in bad for v in nodes]), np.array([id(v) not in good for v in nodes])


def train(pages: int = TRAINING_PAGES, seed: int = SEED) -> tuple[Trees, Trees]:
    r = random.Random(seed)
    xs, ins, outs = [], [], []
    for _ in range(pages):
        page = Page(training_page(r))
        nodes, x, _ = measure(page)
        if nodes:
            a, b = labelled(page, nodes)
            xs.append(x)
            ins.append(a)
            outs.append(b)
    x = np.concatenate(xs)
    return Trees(4, 0.25).fit(x, np.concatenate(ins).astype(float)), Trees(4, 0.25).fit(x, np.concatenate(outs).astype(float))


MODELS: dict = {}


def models(pages: int = TRAINING_PAGES, seed: int = SEED) -> tuple[Trees, Trees]:
    if (pages, seed) not in MODELS:
        MODELS[pages, seed] = train(pages, seed)
    return MODELS[pages, seed]


def extract(sources: list[str], both: tuple[Trees, Trees]) -> list[str]:
    """Main text of each page; the nodes of all pages are scored together."""
    pages = [Page(s) for s in sources]
    measured = [measure(p) for p in pages]
    xs = [x for _, x, _ in measured if len(x)]
    if not xs:
        return [""] * len(sources)
    x = np.concatenate(xs)
    all_in, all_out = (np.clip(m.probability(x), 1e-6, 1 - 1e-6) for m in both)
    out, at = [], 0
    for page, (nodes, _, sizes) in zip(pages, measured, strict=True):
        keep = decode(page, nodes, sizes, all_in[at : at + len(nodes)], all_out[at : at + len(nodes)])
        out.append("\n\n".join(page.blocks[b][0] for b in keep))
        at += len(nodes)
    return out


def main_text(pages: DataFrame) -> DataFrame:
    """Main text of pages (page_id, url, html): page_id, url, text, n_chars.

    A row per row of pages, repeated rows and null ids included.  Null and empty
    html gives an empty text; pages of any length are read whole; other columns
    play no part; an empty table gives no rows."""
    both = models()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                texts = extract([x or "" for x in part.column(2).to_pylist()], both)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(read_table(spark, sf_dir, "pages"))
