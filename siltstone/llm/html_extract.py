"""Main text of HTML pages: gradient-boosted trees over DOM-node features, decoded over the tree.

Every block element gets features: tag class, attribute tokens, text and link density of its own and of its subtree,
depth, place and likeness among its siblings, and the same of its parent. Boosted trees, fitted here on seeded
synthetic pages of many layouts with known content, give each element the log odds of belonging to the article.
The labels are then decoded together: a wrapper may hold both kinds, an article may hold boilerplate inside, but nothing
below boilerplate is content; the best consistent labelling is found by dynamic programming from the leaves.

Names say nothing on many pages. So a second model of the same kind is fitted on pages whose names and telling tags are
masked at random and whose article stands in a plain body, section or table cell; where it finds twice the text that the
first does, or the first nothing, its labelling is taken. Where neither finds any, the subtree with most text outside links is
the article, if it has any.

Defined cases: null or empty html gives an empty text; broken markup is read leniently; very long pages are read whole;
repeated rows are extracted alike; an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

import math
from functools import lru_cache
from random import Random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import free_name, table
from siltstone.llm.dom import Node, blocks, parse

SEED, TRAIN_PAGES, TREES, DEPTH, RATE, EDGES = 5, 360, 40, 4, 0.3, 16
#: Fixed word lists: what class, id and role names say.
BAD_WORDS = frozenset(
    "ad ads advert advertisement adsense banner sponsor sponsored promo promoted comment comments reply replies disqus respond cookie consent notice alert "
    "popup modal overlay newsletter subscribe signup login share sharing social related recommended recommendations trending popular more sidebar side rail widget widgets nav navbar navigation menu "
    "breadcrumb breadcrumbs pagination pager footer foot header masthead topbar toolbar search form copyright legal disclaimer tags toc skip user reader readers feedback outbrain taboola gdpr privacy complementary contentinfo".split()
)
GOOD_WORDS = frozenset("article post entry content story body main text articlebody prose markdown page blog news hentry read".split())
BAD_TAGS = frozenset("nav footer aside form header menu dialog fieldset address head option legend".split())
GOOD_TAGS = frozenset("article main".split())
TEXT_TAGS = frozenset("p blockquote pre h1 h2 h3 h4 h5 h6 figcaption".split())
LIST_TAGS = frozenset("li ul ol dl dt dd table tr td th tbody".split())


def features(root: Node) -> tuple[list[Node], np.ndarray]:
    """Elements in page order and their feature rows."""
    nodes: list[Node] = []
    todo = [root]
    while todo:
        n = todo.pop()
        nodes.append(n)
        todo += reversed(n.children)
    nodes.sort(key=lambda n: n.order)
    size = len(nodes)
    at = {n.order: i for i, n in enumerate(nodes)}
    up = np.array([at[n.parent.order] if n.parent else 0 for n in nodes])
    own = np.array([n.text for n in nodes], float)
    own_link = np.array([n.link_text for n in nodes], float)
    total, links, count, prose = own.copy(), own_link.copy(), np.ones(size), np.array([n.text if n.tag in TEXT_TAGS else 0 for n in nodes], float)
    for i in range(size - 1, 0, -1):
        p = up[i]
        total[p] += total[i]
        links[p] += links[i]
        count[p] += count[i]
        prose[p] += prose[i]
    every = max(1.0, total[0])
    seen = np.cumsum(own) - own
    basic = np.zeros((size, 20))
    place = {c.order: k for n in nodes for k, c in enumerate(n.children)}
    for i, n in enumerate(nodes):
        kin = n.parent.children if n.parent else [n]
        b = basic[i]
        b[0] = n.tag in BAD_TAGS
        b[1] = n.tag in GOOD_TAGS
        b[2] = n.tag in TEXT_TAGS
        b[3] = n.tag in LIST_TAGS
        b[4] = len(n.words & BAD_WORDS)
        b[5] = len(n.words & GOOD_WORDS)
        b[6] = n.depth
        b[7] = len(kin)
        b[8] = place.get(n.order, 0) / len(kin)
        b[9] = len(n.children)
        b[18] = n.tag in ("h1", "h2")
        b[19] = n.tag == "p"
    basic[:, 10] = np.log1p(own)
    basic[:, 11] = np.log1p(total)
    basic[:, 12] = links / np.maximum(1, total)
    basic[:, 13] = total / np.maximum(1, count)
    basic[:, 14] = total / every
    basic[:, 15] = seen / every
    basic[:, 16] = prose / np.maximum(1, total)
    basic[:, 17] = np.log1p(total[up])
    # what ancestors' names say, nearest first
    bad, good = np.zeros(size), np.zeros(size)
    for i in range(1, size):
        p = up[i]
        bad[i] = bad[p] + (basic[p, 0] or basic[p, 4] > 0)
        good[i] = good[p] + (basic[p, 1] or basic[p, 5] > 0)
    return nodes, np.column_stack([basic, bad, good, basic[up][:, [0, 1, 4, 5, 12, 14, 16]]])


class Trees:
    """Gradient-boosted regression trees with logistic loss over binned features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE):
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, EDGES + 1)[1:-1])) for j in range(x.shape[1])]
        bins = self._bins(x)
        p = np.clip(y.mean(), 0.01, 0.99)
        self.base, self.trees, self.depth = math.log(p / (1 - p)), [], depth
        self.plain: Trees | None = None  # judges pages of which this one finds nothing
        z = np.full(len(y), self.base)
        for _ in range(trees):
            q = 1 / (1 + np.exp(-z))
            g, h = y - q, q * (1 - q)
            leaf = np.zeros(len(y), int)
            split = []
            for level in range(depth):
                width, best = 2**level, np.full(2**level, -1e-9)
                feature, cut = np.zeros(width, int), np.full(width, 10**6)
                for j in range(x.shape[1]):
                    m = EDGES + 1
                    key = leaf * m + bins[:, j]
                    gs = np.bincount(key, g, width * m).reshape(width, m).cumsum(1)
                    hs = np.bincount(key, h, width * m).reshape(width, m).cumsum(1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                    gain[(hs < 2) | (ht - hs < 2)] = -1
                    k = gain.argmax(1)
                    top = gain[np.arange(width), k]
                    better = top > best + 1e-12
                    best[better], feature[better], cut[better] = top[better], j, k[better]
                split.append((feature, cut))
                leaf = 2 * leaf + (bins[np.arange(len(y)), feature[leaf]] > cut[leaf])
            n = 2**depth
            value = rate * np.bincount(leaf, g, n) / (np.bincount(leaf, h, n) + 1)
            self.trees.append((split, value))
            z += value[leaf]

    def _bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)])

    def logits(self, x: np.ndarray) -> np.ndarray:
        bins, rows = self._bins(x), np.arange(len(x))
        z = np.full(len(x), self.base)
        for split, value in self.trees:
            leaf = np.zeros(len(x), int)
            for feature, cut in split:
                leaf = 2 * leaf + (bins[rows, feature[leaf]] > cut[leaf])
            z += value[leaf]
        return z


def decode(nodes: list[Node], logits: np.ndarray, switch: float = 2.0) -> set[int]:
    """Orders of the content elements under the best labelling: wrapper -> any; content -> content or boilerplate; boilerplate -> boilerplate."""
    at = {n.order: i for i, n in enumerate(nodes)}
    weight = np.array([0.5 + math.log1p(n.text) for n in nodes])
    gain = np.clip(logits, -6, 6) * weight
    own = [n.text > 0 for n in nodes]
    best = np.zeros((len(nodes), 3))  # wrapper, content, boilerplate
    for i in range(len(nodes) - 1, -1, -1):
        n = nodes[i]
        best[i] = (-2.0 * own[i] * weight[i], gain[i], -gain[i])
        for c in n.children:
            w, y, b = best[at[c.order]]
            best[i] += (max(w, y - switch / 4, b - switch / 4), max(y, b - switch), b)
    label, out = np.zeros(len(nodes), int), set()
    for i, n in enumerate(nodes):
        if n.parent is None:
            label[i] = 0
        else:
            w, y, b = best[i]
            p = label[at[n.parent.order]]
            label[i] = 2 if p == 2 else (1 if y >= b - switch else 2) if p == 1 else int(np.argmax((w, y - switch / 4, b - switch / 4)))
        if label[i] == 1:
            out.add(n.order)
    return out


def densest(nodes: list[Node]) -> set[int]:
    """Orders of the elements with text of their own below the one that has most text outside links for its elements."""
    at = {n.order: i for i, n in enumerate(nodes)}
    own = np.array([n.text - 2.0 * n.link_text for n in nodes])
    total, count = own.copy(), np.ones(len(nodes))
    for i in range(len(nodes) - 1, 0, -1):
        p = at[nodes[i].parent.order]
        total[p] += total[i]
        count[p] += count[i]
    best = int(np.argmax(np.where(total > 0, total / np.sqrt(count), 0)))
    out, todo = set(), [nodes[best]]
    while todo:
        n = todo.pop()
        if n is not nodes[best] and n.tag in BAD_TAGS:
            continue
        if n.text and 2 * n.link_text <= n.text:
            out.add(n.order)
        todo += n.children
    return out


def extract(page: str | None, model: Trees) -> str:
    return extract_many([page], model)[0]


# Synthetic pages to fit on


def synthetic_page(r: Random) -> str:
    """A page of random layout; the elements of the article carry data-c=1, boilerplate inside it data-c=0."""
    word = lambda: "".join(r.choice("aeioubcdfglmnprst") for _ in range(r.randint(2, 9)))
    phrase = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    sentence = lambda a, b: phrase(a, b).capitalize() + "."
    link = lambda: f'<a href="/{word()}">{phrase(1, 3)}</a>'
    links = lambda a, b: "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(r.randint(a, b))) + "</ul>"
    pick = lambda *x: r.choice(x)

    def tagged(tag: str, body: str, *names: str) -> str:
        name = r.choice(names) if names and r.random() < 0.85 else ""
        key = pick("class", "class", "id")
        return f"<{tag}" + (f' {key}="{name}"' if name else "") + f">{body}</{tag}>"

    def boiler(inside: bool = False) -> str:
        k = r.randrange(9)
        mark = " data-c=0" if inside else ""
        if k == 0:
            out = tagged("div", sentence(3, 14) if r.random() < 0.7 else f"<p>{sentence(3, 14)}</p>", "ad", "ads", "advert", "banner", "sponsor", "promo")
        elif k == 1:
            out = tagged(pick("div", "section", "aside"), f"<h3>{phrase(1, 3)}</h3>" + links(2, 6), "related", "recommended", "more-links", "popular", "trending")
        elif k == 2:
            out = tagged("div", f"<p>{sentence(4, 20)}</p>", "cookie-notice", "notice", "consent", "alert", "newsletter")
        elif k == 3:
            out = f'<form action="/s"><label>{phrase(1, 2)}</label><input name="q"><p>{sentence(2, 6)}</p></form>'
        elif k == 4:
            out = tagged(pick("div", "ul"), " ".join(link() for _ in range(r.randint(2, 5))), "share", "social", "tags", "breadcrumb")
        elif k == 5:
            out = tagged("aside", f"<h4>{phrase(1, 3)}</h4><p>{sentence(5, 25)}</p>" + (links(1, 4) if r.random() < 0.5 else ""), "sidebar", "widget", "side")
        elif k == 6:
            item = lambda: tagged(pick("div", "li"), f"<b>{word()}</b> <p>{sentence(4, 30)}</p>", "comment", "reply", "comment-body", "user-comment")
            out = tagged(pick("div", "section"), f"<h3>{phrase(1, 2)}</h3>" + "".join(item() for _ in range(r.randint(1, 6))), "comments", "comment-list", "responses-comments", "reader-comments", "disqus")
        elif k == 7:
            out = tagged("div", f"{sentence(2, 8)} {link()}", "login", "subscribe", "signup", "popup", "banner")
        else:
            out = tagged("nav", links(2, 8), "menu", "toc", "pagination", "nav")
        return out.replace(">", mark + ">", 1) if inside else out

    def block() -> str:
        k = r.random()
        if k < 0.68:
            body = " ".join(sentence(3, 18) for _ in range(r.choice((1, 1, 2, 3, 5))))
            if r.random() < 0.25:
                body = body.replace(" ", f" {link()} ", 1)
            if r.random() < 0.15:
                body = f"<b>{sentence(1, 6)}<br><p data-c=1>{body}"
            return f"<p data-c=1>{body}" + ("</p>" if r.random() < 0.85 else "")
        if k < 0.78:
            return f"<h{(h := r.randint(2, 4))} data-c=1>{phrase(1, 6)}</h{h}>"
        if k < 0.86:
            return "<ul data-c=1>" + "".join(f"<li data-c=1>{sentence(3, 14)}</li>" for _ in range(r.randint(2, 6))) + "</ul>"
        if k < 0.91:
            return f"<blockquote data-c=1><p data-c=1>{sentence(5, 25)}</p></blockquote>"
        if k < 0.95:
            return "<table data-c=1>" + "".join(f"<tr data-c=1><td data-c=1>{phrase(1, 3)}</td><td data-c=1>{phrase(1, 3)}</td></tr>" for _ in range(r.randint(2, 5))) + "</table>"
        if k < 0.98:
            return f"<div data-c=1>{sentence(6, 30)}</div>"
        return f"<pre data-c=1>{phrase(3, 12)}</pre>"

    body = f"<h1 data-c=1>{phrase(1, 12)}</h1>" if r.random() < 0.85 else ""
    for _ in range(r.choice((1, 2, 3, 5, 8, 12, 20))):
        body += block()
        if r.random() < 0.06:
            body += boiler(True)
    names = pick("", ' class="article"', ' class="post-content"', ' id="content"', ' class="entry"', ' class="story-body"', ' itemprop="articleBody"')
    if r.random() < 0.25:
        body = f"<div data-c=1>{body}</div>"
    tag = pick("article", "article", "article", "main", "div", "section")
    main = f"<{tag}{names or (' class="content"' if tag in ('div', 'section') else '')} data-c=1>{body}</{tag}>"
    if r.random() < 0.3:
        main = f"<div{pick('', ' class=\"wrapper\"', ' id=\"container\"', ' class=\"row\"')}>{main}{boiler() if r.random() < 0.6 else ''}</div>"
    head = f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{phrase(2, 9)}</title><style>p{{margin:0}}</style><script>var a="</p>";</script></head><body>'
    top = (tagged("header", f"<div>{phrase(1, 3)}</div>" + links(1, 5), "header", "masthead") if r.random() < 0.4 else "") + (tagged("nav", links(3, 8), "menu", "nav") if r.random() < 0.85 else tagged("div", links(3, 8), "navbar", "menu"))
    before = "".join(boiler() for _ in range(r.choice((0, 0, 1, 1, 2))))
    after = "".join(boiler() for _ in range(r.choice((0, 0, 1, 2, 3))))
    foot = tagged(pick("footer", "footer", "footer", "div"), f"&copy; {word()}.com &middot; {sentence(2, 14)}" + (links(1, 4) if r.random() < 0.3 else ""), "footer", "copyright") if r.random() < 0.95 else ""
    return head + top + before + main + after + foot + "</body></html>"


def _marked(page: str) -> dict[int, int]:
    """Order of each element -> 1 content, 0 boilerplate, absent for wrappers of content."""
    import re

    plain = re.sub(r"<([a-z0-9]+)([^<>]*?) data-c=([01])([^<>]*)>", r'<\1\2\4 role="zz\3">', page).replace("zz1", "zzyes").replace("zz0", "zzno")
    # role attributes become word features of their own and are dropped again below
    root, _ = parse(plain)
    out: dict[int, int] = {}

    def walk(n: Node, inside: int) -> bool:
        got = 1 if "zzyes" in n.words else 0 if "zzno" in n.words else inside
        below = [walk(c, got if got == 0 or "zzno" in n.words else got) for c in n.children]
        if got == 1 or not any(below):
            out[n.order] = got
        return got == 1 or any(below)

    walk(root, 0)
    return out


def masked(page: str, r: Random) -> str:
    """The page with names that say nothing, telling tags become plain ones, and the article in another place."""
    import re

    word = lambda: "".join(r.choice("bcdfghklmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 3)))
    if r.random() < 0.8:
        page = re.sub(r' (class|id)="[^"]*"', lambda m: "" if r.random() < 0.5 else f' {m[1]}="{word()}"', page)
    for tag in ("nav", "aside", "header", "footer", "form"):
        if r.random() < 0.4:
            page = re.sub(rf"<(/?){tag}\b", r"<\1div", page)
    start, end = r.choice((("", ""), ("", ""), ("<div>", "</div>"), ("<section>", "</section>"), (f"<div id={word()}>", "</div>"), ("<table><tr><td>", "</td></tr></table>"), ("<div><div>", "</div></div>")))
    page = re.sub(r' itemprop="[^"]*"', "", page)
    for tag in ("article", "main"):
        page = re.sub(rf"<{tag}\b[^>]*>", start, page).replace(f"</{tag}>", end)
    return page


def _fitted(pages: list[str]) -> Trees:
    import re

    xs, ys = [], []
    for page in pages:
        labels = _marked(page)
        nodes, x = features(parse(re.sub(r" data-c=[01]", "", page))[0])
        keep = [i for i, n in enumerate(nodes) if n.order in labels]
        xs.append(x[keep])
        ys.append([labels[nodes[i].order] for i in keep])
    return Trees(np.concatenate(xs), np.concatenate(ys).astype(float))


@lru_cache(maxsize=2)
def train(pages: int = TRAIN_PAGES, seed: int = SEED) -> Trees:
    """The model, with the one for plain pages; the same for the same arguments."""
    r = Random(seed)
    model = _fitted([synthetic_page(r) for _ in range(pages)])
    model.plain = _fitted([masked(synthetic_page(r), r) for _ in range(pages)])
    return model


def extract_many(pages: list[str | None], model: Trees) -> list[str]:
    """extract() of each page, the trees applied to all their elements at once."""
    read = [(runs, *features(root)) for root, runs in (parse(p) for p in pages if p)]
    if not read:
        return [""] * len(pages)
    z = model.logits(np.concatenate([x for _, _, x in read]))
    ends = np.cumsum([len(x) for _, _, x in read])
    found = [blocks(runs, decode(nodes, z[e - len(x) : e])) for (runs, nodes, x), e in zip(read, ends, strict=True)]
    if model.plain:
        y = model.plain.logits(np.concatenate([x for _, _, x in read]))
        for i, ((runs, nodes, x), e) in enumerate(zip(read, ends, strict=True)):
            other = blocks(runs, decode(nodes, y[e - len(x) : e]))
            if 2 * len(found[i]) <= len(other):
                found[i] = other
            found[i] = found[i] or blocks(runs, densest(nodes))
    texts = iter(found)
    return [next(texts) if p else "" for p in pages]


def _extracted(batches, model: Trees, schema: pa.Schema, html: str):
    for batch in batches:
        column, texts = batch.column(html), []
        for a in range(0, len(column), 128):
            texts += extract_many(column.slice(a, 128).to_pylist(), model)
        yield pa.RecordBatch.from_arrays([*(c for c, n in zip(batch.columns, batch.schema.names, strict=True) if n != html), pa.array(texts, pa.string())], schema=schema)


def extract_pages(pages: DataFrame, html: str = "html", model: Trees | None = None, out: str = "text") -> DataFrame:
    """pages without `html`, with the main text in `out` (with underscores after it where pages has such a column)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StringType, StructType

    model, out = model or train(), free_name(pages.drop(html), out)
    kind = StructType([f for f in pages.schema.fields if f.name != html]).add(out, StringType())
    arrow = to_arrow_schema(kind)
    return pages.mapInArrow(lambda it: _extracted(it, model, arrow, html), kind)


def query(spark, sf_dir: str) -> DataFrame:
    """op6: page_id, url, text, n_chars for all pages."""
    return extract_pages(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
