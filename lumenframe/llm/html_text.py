"""Main text of web pages by boosted trees over DOM nodes.

Every block element and text segment gets the log-odds of being main text from
its features: the density of its subtree, tokens of its attributes, depth, and
how it stands among its siblings. A node is then decided whole (all in or all
out) or left mixed for its children to decide, whichever sums best over the
tree, so a node and its descendants never contradict one another.

The trees are fitted on pages that ``training_page`` writes: bounded by
``Extraction.training_pages``, with a fixed seed, so every process has the same
model. Nothing is learned from the corpus.

Defined results: a null or empty page gives the empty text; a page of any length is
read whole, in time that grows with its length, even with markup that is never closed;
repeated rows are read each; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.boosting import BoostedTrees, fit
from lumenframe.llm.dom import Node, features, parse


@dataclass(frozen=True)
class Extraction:
    """``mixed_cost``: log-odds that leaving a node to its children costs."""

    training_pages: int = 700
    seed: int = 11
    trees: int = 40
    mixed_cost: float = 1.0


# --- labelled pages -------------------------------------------------------


def words(rng: random.Random, n: int) -> str:
    out = ["".join(rng.choices("aeinorstldcumé", k=rng.randint(1, 9))) for _ in range(max(1, n))]
    for k in range(len(out)):
        if rng.random() < 0.08:
            out[k] += ","
        elif rng.random() < 0.08 or k == len(out) - 1:
            out[k] += "."
    if rng.random() < 0.1:  # prose with symbols after its words
        out = [w + rng.choice(["***", "%%%", "&amp;&amp;"]) for w in out]
    return " ".join(out).capitalize()


def anchors(rng: random.Random, n: int) -> str:
    return "".join(f'<li><a href="/{k}">{words(rng, rng.randint(1, 2))}</a></li>' for k in range(n))


def boilerplate(rng: random.Random, kind: str | None = None) -> str:
    """A piece of a page that isn't main text."""
    kind = kind or rng.choice("nav menu header footer aside ad notice form comments related share plain_links".split())
    tag = rng.choice(["div", "section", "div"])
    few, some = rng.randint(2, 6), rng.randint(4, 16)
    if kind == "nav":
        return f"<nav><ul>{anchors(rng, some)}</ul></nav>"
    if kind == "menu":
        return f'<{tag} class="{rng.choice(["menu", "navbar top", "breadcrumb", "main-menu"])}"><ul>{anchors(rng, few)}</ul></{tag}>'
    if kind == "header":
        inner = f"<h1>{words(rng, 2)}</h1>" if rng.random() < 0.3 else f"<div>{words(rng, few)}</div>"
        return rng.choice([f"<header>{inner}<p>{words(rng, few)}</p></header>", f'<div id="{rng.choice(["header", "masthead"])}">{inner}</div>'])
    if kind == "footer":
        text = f"&copy; {words(rng, few)} &middot; {words(rng, some)}"
        return rng.choice([f"<footer>{text}</footer>", f"<footer><p>{text}</p><ul>{anchors(rng, few)}</ul></footer>", f'<div class="footer"><p>{text}</p></div>'])
    if kind == "aside":
        body = "".join(f"<p>{words(rng, some)}</p>" for _ in range(rng.randint(1, 3)))
        return rng.choice([f"<aside><h3>{words(rng, 2)}</h3>{body}</aside>", f'<div class="{rng.choice(["sidebar", "widget side", "right-sidebar"])}"><h3>{words(rng, 2)}</h3>{body}<ul>{anchors(rng, few)}</ul></div>'])
    if kind == "ad":
        return f'<{tag} class="{rng.choice(["ad", "ads", "advert", "banner", "sponsored", "promo box"])}">{words(rng, rng.randint(2, 25))}</{tag}>'
    if kind == "notice":
        body = rng.choice([f"<p>{words(rng, some)}</p>", words(rng, some)])
        return f'<{tag} {rng.choice(["class", "id"])}="{rng.choice(["cookie-notice", "notice", "consent", "gdpr popup", "notification"])}">{body}<button>{words(rng, 1)}</button></{tag}>'
    if kind == "form":
        return f'<form action="/s"><label>{words(rng, 2)}</label><input name="q"><p>{words(rng, few)}</p><button>{words(rng, 1)}</button></form>'
    if kind == "comments":
        each = "".join(f'<{rng.choice(["div", "li"])} class="comment"><b>{words(rng, 1)}</b><p>{words(rng, rng.randint(3, 40))}</p></div>' for _ in range(rng.randint(1, 5)))
        return f'<{tag} {rng.choice(["class", "id"])}="{rng.choice(["comments", "comment-list", "replies", "disqus thread"])}"><h3>{words(rng, 2)}</h3>{each}</{tag}>'
    if kind == "related":
        return f'<{tag} class="{rng.choice(["related", "recommended posts", "teaser list"])}"><h3>{words(rng, 2)}</h3><ul>{anchors(rng, few)}</ul></{tag}>'
    if kind == "share":
        return f'<div class="{rng.choice(["share", "social", "tags"])}"><a href="#">{words(rng, 1)}</a> <a href="#">{words(rng, 1)}</a></div>'
    return f"<ul>{anchors(rng, some)}</ul>"


def main_blocks(rng: random.Random) -> list[str]:
    out = [f"<h1>{words(rng, rng.randint(2, 9))}</h1>"] if rng.random() < 0.9 else []
    for _ in range(rng.choice([1, 2, 3, 5, 8, 14])):
        roll, text = rng.random(), words(rng, rng.choice([1, 2, 5, 12, 40, 90, 200]))
        if roll < 0.54:
            out.append(f"<p>{text}</p>")
        elif roll < 0.59:
            out.append(f"<p>{text}\n")
        elif roll < 0.62:
            out.append(f"<p class=\"{rng.choice(['lead', 'first', 'text'])}\"><em>{words(rng, 3)}</em> {text}</p>")
        elif roll < 0.72:
            out.append(f"<p><b>{text}<br>")
        elif roll < 0.78:
            out.append(f"<h2>{words(rng, 4)}</h2><p>{text}</p>")
        elif roll < 0.84:
            out.append("<ul>" + "".join(f"<li>{words(rng, rng.randint(2, 20))}</li>" for _ in range(rng.randint(2, 5))) + "</ul>")
        elif roll < 0.88:
            out.append(f"<blockquote><p>{text}</p></blockquote>")
        elif roll < 0.92:
            out.append(f"<div>{text}</div>")
        elif roll < 0.96:
            out.append("<table>" + "".join(f"<tr><td>{words(rng, 2)}</td><td>{words(rng, 3)}</td></tr>" for _ in range(rng.randint(2, 4))) + "</table>")
        else:
            out.append(f'<p>{text} <a href="/x">{words(rng, 2)}</a> {words(rng, 6)}</p>')
    return out


#: Around each piece of main text in a labelled page; no page holds it otherwise.
MARK = "\ue000"


def marked(block: str) -> str:
    """Puts the mark at the start of each text of a block."""
    import re

    return re.sub(r">(?=[^<\s])", ">" + MARK, block)


def training_page(rng: random.Random) -> str:
    """A page whose main texts start with MARK."""
    blocks = [marked(b) for b in main_blocks(rng)]
    if rng.random() < 0.3:
        blocks.insert(rng.randint(0, len(blocks)), boilerplate(rng, rng.choice("ad share related notice aside form".split())))
    if rng.random() < 0.2:
        blocks.append(boilerplate(rng, "comments"))
    inner = "".join(blocks)
    wrap = rng.choice(["article", "article", "article", "main", "div", "div", "section", "td"])
    attr = rng.choice(["", "", ' class="content"', ' id="main"', ' class="post entry"', ' class="story-body"', ' class="article text"'])
    if wrap == "td":
        inner = f"<table><tr><td>{inner}</td></tr></table>"
    else:
        inner = f"<{wrap}{attr}>{inner}</{wrap}>"
    if rng.random() < 0.3:
        inner = f'<div class="{rng.choice(["wrap", "page", "container", "row"])}">{inner}{boilerplate(rng) if rng.random() < 0.5 else ""}</div>'
    before = "".join(boilerplate(rng, rng.choice(["nav", "menu", "header", "ad", "notice", "form", "plain_links", None])) for _ in range(rng.randint(0, 4)))
    after = "".join(boilerplate(rng, rng.choice(["footer", "footer", "comments", "related", "aside", None])) for _ in range(rng.randint(0, 4)))
    tail = "</body></html>" if rng.random() < 0.9 else ""
    return f"{page_head(rng)}{before}{rng.choice(['<!-- x -->', '', script(rng)])}{inner}{script(rng)}{after}{tail}"


def script(rng: random.Random) -> str:
    """Nothing, or an element whose content isn't markup."""
    code = ["for(i=0;i<n;i++)f(i)", "var t='</p>';", "var a='<!--', b=\"<article>\"", "a&&b||c<d"]
    return rng.choice(["", "", f"<script>{rng.choice(code)}</script>", "<style>p>a:before{content:'<b'}</style>", "<noscript><img src=x></noscript>"])


def page_head(rng: random.Random) -> str:
    """What stands before a page's body, with its optional tags or without them."""
    title = f"<title>{words(rng, 5)}</title>"
    meta = rng.choice(["", '<meta charset="utf-8">', "<meta name=viewport content='width=device-width'><link rel=stylesheet href=/s.css>"])
    inner = meta + title + "".join(script(rng) for _ in range(2))
    begin, end = rng.choice([("<!DOCTYPE html><html><head>", "</head><body>"), ("<html lang=en><head>", "<body class=home>"), ("<!doctype html>", ""), ("", "<body>"), ("<html><head>", "</head>")])
    return begin + inner + end


def labels(nodes: list[Node]) -> np.ndarray:
    """1: all main, 0: none, nan: mixed or empty. Takes the marks out of the texts."""
    main, total = np.zeros(len(nodes)), np.zeros(len(nodes))
    for k in range(len(nodes) - 1, -1, -1):
        x = nodes[k]
        if x.text:
            total[k] += len(x.text)
            if MARK in x.text:
                main[k] += len(x.text)
                x.text = x.text.replace(MARK, "")
        if x.parent >= 0:
            main[x.parent] += main[k]
            total[x.parent] += total[k]
    share = np.divide(main, total, out=np.full(len(nodes), np.nan), where=total > 0)
    return np.where((share == 0) | (share == 1), share, np.nan)


@lru_cache(maxsize=2)
def trained(how: Extraction = Extraction()) -> BoostedTrees:
    """Fitted on ``training_pages`` pages; a second or two."""
    rng = random.Random(how.seed)
    xs, ys = [], []
    for _ in range(how.training_pages):
        nodes = parse(training_page(rng))
        y = labels(nodes)
        x = features(nodes)
        known = ~np.isnan(y)
        xs.append(x[known])
        ys.append(y[known])
    return fit(np.concatenate(xs), np.concatenate(ys), how.trees)


# --- decoding -------------------------------------------------------------


def decode(nodes: list[Node], odds: np.ndarray, mixed_cost: float) -> list[str]:
    """Texts of the nodes that are in, in page order."""
    n = len(nodes)
    # A sum of log-odds ranks "all in" against "all out" at 0.
    inside, best, mixed = odds.copy(), np.zeros(n), np.zeros(n, bool)
    for k in range(n - 1, -1, -1):
        x = nodes[k]
        if x.children:
            inside[k] = odds[k] + sum(inside[c] for c in x.children)
            apart = sum(best[c] for c in x.children) - mixed_cost
            best[k] = max(inside[k], 0.0, apart)
            mixed[k] = apart > max(inside[k], 0.0)
        else:
            best[k] = max(inside[k], 0.0)
    state = np.zeros(n, np.int8)  # 1: in, 0: out, 2: left to the children
    for k, x in enumerate(nodes):
        above = state[x.parent] if x.parent >= 0 else 2
        state[k] = above if above != 2 else 2 if mixed[k] else inside[k] > 0
    return [x.text for k, x in enumerate(nodes) if x.text and state[k] == 1]


def main_text(page: str | None, model: BoostedTrees, how: Extraction = Extraction()) -> str:
    nodes = parse(page or "")
    if len(nodes) == 1:
        return ""
    return "\n\n".join(decode(nodes, np.clip(model.scores(features(nodes)), -4, 4), how.mixed_cost))


def extract(pages: DataFrame, how: Extraction = Extraction(), rows: int = 64) -> DataFrame:
    """``page_id, url, text, n_chars`` per row of ``pages``, in one narrow pass."""
    model = trained(how)
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                trees = [parse(h.as_py() or "") for h in batch.column(2)]
                odds = np.clip(model.scores(np.concatenate([features(t) for t in trees])), -4, 4)
                cuts = np.cumsum([len(t) for t in trees])[:-1]
                texts = ["\n\n".join(decode(t, o, how.mixed_cost)) if len(t) > 1 else "" for t, o in zip(trees, np.split(odds, cuts), strict=True)]
                made = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=["page_id", "url", "text", "n_chars"])

    own = pages.select("page_id", F.col("url").cast("string").alias("url"), "html")
    return own.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
