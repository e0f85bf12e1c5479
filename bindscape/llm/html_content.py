"""Main text of web pages by a tree-structured graphical model.

The nodes of a page are its block elements.  Each has a hidden label, content or
not; a node's potential comes from hashed features of its tag, names and text, and
each parent-child pair has a potential by the child's tag.  Sum-product messages
upward and downward give every node's marginal, and the blocks of the nodes that
are more likely content than not make the text.

The model is trained on labelled pages: pages of a bounded sample that mark their
content by an ``article`` or ``main`` element, and pages of layouts with known
labels that are made here, which have notices, comments, forms and sidebars too.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from bindscape.functions.session import broadcast_if_small

SAMPLE_PAGES = 150  # pages of the table that the model is trained on, at most
MADE_PAGES = 450
TABLE_BITS = 14
EDGE_KINDS = 64
STEPS = 80
RUN_NODES = 50_000  # nodes of pages that are worked on together

# fixed values: elements of HTML
BLOCK = set("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form
frameset h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol p pre search section summary table tbody td tfoot th
thead tr ul caption label""".split())
UNSEEN = set("""script style head title noscript template svg math textarea select button iframe object canvas audio video
datalist noembed noframes applet""".split())
RAW = set("script style textarea title iframe noembed noframes xmp".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = BLOCK - {"body", "html", "label", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
            "th": {"td", "th"}, "tbody": {"tbody", "thead", "tfoot", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tr", "td", "th"}}
SCOPES = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}}
AWAY = set("nav header footer aside form menu dialog search".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)""", re.DOTALL)
# a quote opens a value only after "=", and only where another one closes it; nothing is tried twice
_ATTRIBUTES = re.compile(r"""(?:[\s/]++|(?:=[^\s/>=]*+|[^\s/>=]++)(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+))?+)*+""")
_NAME = re.compile(r"""(=[^\s/>=]*+|[^\s/>=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+)))?+""")
_KEYS = {"class", "id", "role", "hidden", "style", "data-content"}
_END = re.compile(r"</([a-zA-Z][^\s/>]*+)")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Page:
    """Block elements and text blocks of a page."""

    def __init__(self, source: str):
        self.tags, self.parents, self.depths, self.names = ["#page"], [-1], [0], [()]
        self.labels: list[int | None] = [None]
        self.blocks: list[tuple[int, str]] = []
        self.link_chars = [0]
        self._parse(source)

    def _parse(self, source: str) -> None:
        stack = [0]
        unseen: list[str] = []
        parts: list[str] = []
        links, at, lower = 0, 0, None
        last, plain, ends = source.rfind(">"), False, None

        def flush():
            if parts:
                text = " ".join(html.unescape("".join(parts)).split())
                if text:
                    self.blocks.append((stack[-1], text))
                parts.clear()

        def add(text):
            if text and not unseen:
                parts.append(text)
                if links:
                    self.link_chars[stack[-1]] += len(text)

        while True:
            found = _TAG.search(source, at)
            if found is None:
                add(source[at:])
                break
            name = found[2]
            if name is not None and last < found.end():
                # no tag ends behind this place
                add(source[at: found.end()])
                at = found.end()
                continue
            add(source[at: found.start()])
            at = found.end()
            if name is None:
                if found[0].startswith("<![CDATA[") and not unseen:
                    add(html.escape(found[0][9:].removesuffix("]]>"), False))
                continue
            name = name.lower()
            end = source.find(">", at) if plain else _ATTRIBUTES.match(source, at).end()
            if end == len(source):
                # values with ">" ran to the end of the page; from here on the first ">" ends a tag
                plain, end = True, source.find(">", at)
            attributes, at = source[at:end], end + 1
            if found[1]:
                if unseen:
                    if name in unseen:
                        del unseen[len(unseen) - 1 - unseen[::-1].index(name):]
                        continue
                    if name != "html" and not (name in BLOCK and any(self.tags[k] == name for k in stack)):
                        continue
                    unseen.clear()  # an element around them ends
                if name == "a":
                    links = 0
                elif name in BLOCK:
                    for k in range(len(stack) - 1, 0, -1):
                        if self.tags[stack[k]] == name:
                            flush()
                            del stack[k:]
                            break
                continue
            if name in VOID:
                if name == "hr":
                    flush()
                elif name == "br":
                    add(" ")
                continue
            closed = attributes.endswith("/")
            if name in UNSEEN:
                if name in RAW:
                    lower = source.lower() if lower is None and len(source.lower()) == len(source) else lower
                    end = lower.find(f"</{name}", at) if lower is not None else -1
                    if lower is None:
                        m = re.compile(f"</{name}", re.IGNORECASE).search(source, at)
                        end = m.start() if m else -1
                    at = len(source) if end < 0 else end
                if name in ("button", "select") and name in unseen:
                    del unseen[unseen.index(name):]
                if not closed or name in RAW:
                    unseen.append(name)
                continue
            if unseen:
                if name == "body" or unseen == ["head"] and name in BLOCK:
                    unseen.clear()
                elif name in BLOCK:
                    # an element whose end tag never comes holds no blocks
                    ends = {m[1].lower(): m.start() for m in _END.finditer(source)} if ends is None else ends
                    open_ended = [k for k, x in enumerate(unseen) if x in UNSEEN and x != "head" and ends.get(x, -1) < at]
                    del unseen[open_ended[0] if open_ended else len(unseen):]
                    if unseen and not closed:
                        unseen.append(name)
                if unseen:
                    continue
            if name == "a":
                links = 1
            if name not in BLOCK:
                continue
            flush()
            if name in ("html", "body"):
                if any(self.tags[k] == name for k in stack):
                    continue
            if name in CLOSES_P:
                for k in range(len(stack) - 1, 0, -1):
                    if self.tags[stack[k]] == "p":
                        del stack[k:]
                        break
                    if self.tags[stack[k]] not in ("label",):
                        break
            if name in SIBLINGS:
                stop = SCOPES.get(name, {"table"})
                for k in range(len(stack) - 1, 0, -1):
                    tag = self.tags[stack[k]]
                    if tag in stop or tag not in SIBLINGS and tag != "p" and tag != "label":
                        break
                    if tag in SIBLINGS[name]:
                        del stack[k:]
            if re.fullmatch("h[1-6]", name) and re.fullmatch("h[1-6]", self.tags[stack[-1]]):
                stack.pop()
            words, label = [], None
            if attributes.strip():
                for m in _NAME.finditer(attributes):
                    key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
                    if key not in _KEYS:
                        continue
                    if key == "data-content":
                        label = int(value == "1")
                    elif key == "style":
                        words += ["unshown"] if "none" in value and "display" in value else []
                    elif key == "hidden":
                        words.append("unshown")
                    else:
                        words += [w.lower() for w in _WORD.findall(value)]
            self.tags.append(name)
            self.parents.append(stack[-1])
            self.depths.append(self.depths[stack[-1]] + 1)
            self.names.append(tuple(words))
            self.labels.append(label)
            self.link_chars.append(0)
            if not closed:
                stack.append(len(self.tags) - 1)
            links = 0 if name in ("p", "div", "section", "article", "li") else links
        flush()

    def features(self, named: bool = True) -> list[list[int]]:
        """Table rows of each node; without ``named`` the telling tags are plain."""
        n = len(self.tags)
        own, below, children = [0] * n, [0] * n, [0] * n
        stops = [0] * n
        for k, text in self.blocks:
            own[k] += len(text)
            stops[k] += text.count(". ") + text.endswith((".", "!", "?"))
        linked = list(self.link_chars)
        for k in range(n):
            below[k] = own[k]
        for k in range(n - 1, 0, -1):
            below[self.parents[k]] += below[k]
            linked[self.parents[k]] += linked[k]
            children[self.parents[k]] += 1
        tags = self.tags if named else [{"article": "div", "main": "div"}.get(t, t) for t in self.tags]
        out = []
        for k in range(n):
            share = min(4, 4 * linked[k] // max(1, below[k]))
            size = below[k].bit_length()
            tag, up = tags[k], tags[self.parents[k]] if k else "#"
            rows = [f"t{tag}", f"u{tag},{up}", f"s{size},{share}", f"l{share}", f"o{own[k].bit_length()},{min(stops[k], 3)}",
                    f"c{tag},{min(children[k], 5)}", f"z{tag},{size // 2},{share // 2}"]
            rows += [f"w{w}" for w in set(self.names[k])]
            out.append([_row(r) for r in rows])
        return out


_ROWS: dict[str, int] = {}


def _row(name: str) -> int:
    at = _ROWS.get(name)
    if at is None:
        h = 2166136261
        for c in name.encode():
            h = (h ^ c) * 16777619 & 0xFFFFFFFF
        at = (h ^ h >> 15) * 2246822519 >> 8 & (1 << TABLE_BITS) - 1
        if len(_ROWS) < 1 << 17:
            _ROWS[name] = at
    return at


class Forest:
    """The nodes of some pages, level by level."""

    def __init__(self, pages: list[Page], named: bool = True):
        self.first = np.cumsum([0] + [len(p.tags) for p in pages])
        rows = [r for p in pages for r in p.features(named)]
        self.counts = np.array([len(r) for r in rows])
        self.rows = np.array([x for r in rows for x in r], np.int64)
        self.node = np.repeat(np.arange(len(rows)), self.counts)
        self.parent = np.concatenate([np.array(p.parents) + (lo * (np.array(p.parents) >= 0)) for p, lo in zip(pages, self.first)])
        depth = np.concatenate([np.array(p.depths) for p in pages])
        self.levels = [np.flatnonzero(depth == d) for d in range(1, depth.max() + 1)]
        self.edge = np.array([_row(f"e{t}") % EDGE_KINDS for p in pages for t in p.tags])

    def marginals(self, weights: np.ndarray, edges: np.ndarray):
        """P(label 1) of every node and P(parent label, label) of every edge."""
        n = len(self.parent)
        unary = np.zeros((n, 2))
        unary[:, 1] = np.bincount(self.node, weights=weights[self.rows], minlength=n)
        pair = edges[self.edge]  # (nodes, parent's label, own label)
        up = np.zeros((n, 2))  # message of a node to its parent
        inner = unary.copy()
        for level in reversed(self.levels):
            up[level] = np.logaddexp.reduce(pair[level] + inner[level][:, None, :], axis=2)
            np.add.at(inner, self.parent[level], up[level])
        outer = np.zeros((n, 2))  # what the rest of the tree says of a node
        joint = np.zeros((n, 2, 2))
        for level in self.levels:
            above = self.parent[level]
            rest = inner[above] + outer[above] - up[level]
            both = rest[:, :, None] + pair[level]
            outer[level] = np.logaddexp.reduce(both, axis=1)
            both = both + inner[level][:, None, :]
            joint[level] = np.exp(both - np.logaddexp.reduce(both.reshape(-1, 4), axis=1)[:, None, None])
        belief = inner + outer
        return np.exp(belief[:, 1] - np.logaddexp.reduce(belief, axis=1)), joint


class ContentModel:
    def __init__(self, weights: np.ndarray, edges: np.ndarray):
        self.weights, self.edges = weights, edges

    def texts(self, pages: list[Page]) -> list[str]:
        forest = Forest(pages)
        p, _ = forest.marginals(self.weights, self.edges)
        return ["\n".join(text for k, text in page.blocks if p[lo + k] >= 0.5) for page, lo in zip(pages, forest.first)]


def _labels(page: Page) -> np.ndarray:
    """A node's own label, or its parent's; 0 at the top."""
    out = np.zeros(len(page.tags), np.int64)
    for k in range(1, len(out)):
        out[k] = out[page.parents[k]] if page.labels[k] is None else page.labels[k]
    return out


def _mark_elements(page: Page) -> bool:
    """Label a page by its only article, or else its only main element."""
    for tag in ("article", "main"):
        if page.tags.count(tag) == 1:
            top = page.tags.index(tag)
            page.labels[top] = 1
            inside = {top}
            for k in range(top + 1, len(page.tags)):
                if page.parents[k] in inside:
                    inside.add(k)
                    if page.tags[k] in AWAY:
                        page.labels[k] = 0
            return True
    return False


def train(pages: list[tuple[Page, bool]]) -> ContentModel:
    """Gradient ascent on the labels' likelihood; pages come with ``named``."""
    weights, edges = np.zeros(1 << TABLE_BITS), np.zeros((EDGE_KINDS, 2, 2))
    edges[:, 0, 0] = edges[:, 1, 1] = 1.0
    groups = [([p for p, x in pages if x is flag], flag) for flag in (True, False)]
    work = [(Forest(some, flag), np.concatenate([_labels(p) for p in some])) for some, flag in groups if some]
    g_sum, e_sum = np.full_like(weights, 1.0), np.full_like(edges, 1.0)
    for _ in range(STEPS):
        g, e = -0.02 * weights, -0.02 * edges
        for forest, y in work:
            p, joint = forest.marginals(weights, edges)
            g += np.bincount(forest.rows, weights=(y - p)[forest.node], minlength=len(g))
            child = np.flatnonzero(forest.parent >= 0)
            np.add.at(e, (forest.edge[child], y[forest.parent[child]], y[child]), 1)
            np.add.at(e, forest.edge[child], -joint[child])
        g_sum += g * g
        e_sum += e * e
        weights += 0.5 * g / np.sqrt(g_sum)
        edges += 0.5 * e / np.sqrt(e_sum)
    return ContentModel(weights, edges)


# ---- made pages -----------------------------------------------------------

CONTENT_NAMES = "content post-body entry-content article-body story main-content text post entry articleBody page-content body-copy".split()
SIDE_NAMES = "sidebar widget related-posts right-col recommended trending tag-cloud side aside-box".split()
NOTICE_NAMES = "cookie-notice notice banner alert gdpr-consent popup modal subscribe-box newsletter paywall-notice".split()
AD_NAMES = "ad ads advert advertisement sponsored promo google-ad ad-slot banner-ad".split()
COMMENT_NAMES = "comments comment-list comment reader-comments disqus_thread responses discussion".split()
TOP_NAMES = "header site-header topbar masthead branding".split()
MENU_NAMES = "menu nav navbar navigation breadcrumbs main-nav links".split()
FOOT_NAMES = "footer site-footer bottom copyright legal".split()
NEUTRAL_NAMES = "wrapper container row col inner page layout box".split()


def made_pages(n: int, seed: int = 9) -> Iterator[str]:
    """Pages of random layouts; ``data-content`` marks what is content."""
    rng = random.Random(seed)
    syllables = "an en er in on re st te th nd ou la de qui ver sch zu ion ra mi".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))

    def sentence(lo=4, hi=22):
        return " ".join(word() for _ in range(rng.randint(lo, hi))).capitalize() + rng.choice(["."] * 8 + ["!", "?"])

    def some(names):
        return f' {rng.choice(["class", "class", "id"])}="{rng.choice(names)}"'

    def links(k):
        return "".join(f'<li><a href="/{word()}">{word()}</a></li>' for _ in range(k))

    def paragraph(tag="p"):
        text = " ".join(sentence() for _ in range(rng.randint(1, 7))) if rng.random() < 0.8 else sentence(1, 3)
        if rng.random() < 0.2:
            text = f'<a href="#">{word()} {word()}</a> ' + text
        return f"<{tag}>{'<b>' if rng.random() < 0.2 else ''}{text}{'' if rng.random() < 0.15 else f'</{tag}>'}"

    def advert():
        return f"<{'div' if rng.random() < .8 else 'aside'}{some(AD_NAMES)}>{rng.choice([sentence(), paragraph()])}</div>"

    def notice():
        return f"<div{some(NOTICE_NAMES)}>{rng.choice(['', '<p>'])}{sentence()} <button>{word()}</button></div>"

    def form():
        return f'<form action="/{word()}"{some(NOTICE_NAMES + NEUTRAL_NAMES)}><label>{word()}</label><input name="q"><p>{sentence(3, 9)}</p><button>{word()}</button></form>'

    def comments():
        each = "".join(f"<{t}{some(COMMENT_NAMES)}><p>{word()} {word()}:</p>{paragraph()}</{t}>" for t in rng.choices(["div", "li", "article"], k=rng.randint(1, 5)))
        return f'<{rng.choice(["section", "div"])}{some(COMMENT_NAMES)} data-content="0"><h3>{word()}</h3>{each}</section></div>'

    def side():
        tag = rng.choice(["aside", "div"])
        body = rng.choice([f"<ul>{links(rng.randint(3, 9))}</ul>", paragraph(), f"<h3>{word()}</h3><p>{sentence()}</p>"])
        return f"<{tag}{some(SIDE_NAMES) if tag == 'div' or rng.random() < .5 else ''}>{body}</{tag}>"

    def not_content(make):
        return lambda: make().replace(">", ' data-content="0">', 1)

    inside = [
        paragraph, lambda: f"<h2>{sentence(2, 6)}</h2>", lambda: f"<ul>{''.join(f'<li>{sentence()}</li>' for _ in range(3))}</ul>",
        lambda: f"<blockquote>{paragraph()}</blockquote>", lambda: f"<pre>{sentence()}</pre>", lambda: f"<div>{sentence()} {sentence()}</div>",
        lambda: f"<table><tr><th>{word()}</th><td>{sentence(2, 5)}</td></tr></table>",
        lambda: f"<figure><figcaption>{sentence(3, 9)}</figcaption></figure>",
        not_content(advert), not_content(side), not_content(notice), not_content(form)]
    for _ in range(n):
        top = rng.choice([f"<header{some(TOP_NAMES)}><h1>{word()}</h1><p>{sentence(3, 8)}</p></header>", f"<div{some(TOP_NAMES)}>{word()} {word()}</div>", ""])
        menu = rng.choice([f"<nav><ul>{links(rng.randint(3, 9))}</ul></nav>", f"<div{some(MENU_NAMES)}><ul>{links(5)}</ul></div>", f"<ul{some(MENU_NAMES)}>{links(6)}</ul>"])
        foot = rng.choice([f"<footer>&copy; {word()} {sentence()}</footer>", f"<div{some(FOOT_NAMES)}><p>&copy; {sentence()}</p></div>"])
        pieces = []
        for _ in range(rng.choice([1, 1, 2, 4, 8, 16])):
            pieces.append(rng.choices(inside, [12, 2, 1, 1, .5, 1, .5, .5, .7, .3, .4, .3])[0]())
        tag = rng.choice(["article", "article", "main", "div", "div", "section"])
        named = tag == "div" or rng.random() < 0.4
        title = f"<h1>{sentence(3, 9)}</h1>" if rng.random() < 0.8 else ""
        body = f'<{tag}{some(CONTENT_NAMES) if named else ""} data-content="1">{title}{"".join(pieces)}{comments() if rng.random() < 0.2 else ""}</{tag}>'
        around = [x() for x in rng.choices([advert, notice, side, form, comments], k=rng.randint(0, 4))]
        before, after = around[::2], around[1::2]
        wrap = rng.choice(["", f"<div{some(NEUTRAL_NAMES)}>"])
        yield (f"<html><head><title>{sentence()}</title></head><body>{top}{menu}{wrap}{''.join(before)}{body}{''.join(after)}"
               f"{'</div>' if wrap else ''}{foot}</body></html>")


def fit(pages: DataFrame, *, sample: int = SAMPLE_PAGES, made: int = MADE_PAGES, id_col="page_id", html_col="html") -> ContentModel:
    """Train on ``made`` pages and at most ``sample`` pages of the table, chosen by
    a hash of the id, each with its telling tags and once more without."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).alias("html"))
    ids = rows.where(F.col("html").rlike(r"(?i)<(article|main)\b") & (F.length("html") < 200_000)).select("page_id").distinct()
    ids = broadcast_if_small(ids.orderBy(F.xxhash64("page_id", F.lit(3)), "page_id").limit(sample).select(F.col("page_id").alias("id")))
    texts = rows.join(ids, rows["page_id"].eqNullSafe(ids["id"]), "left_semi").orderBy("page_id", "html").limit(sample).toPandas()["html"]
    found = [p for p in map(Page, texts) if _mark_elements(p)]
    known = [Page(x) for x in made_pages(made)]
    return train([(p, True) for p in found + known] + [(p, False) for p in found + known])


def extract(pages: DataFrame, model: ContentModel, *, id_col="page_id", url_col="url", html_col="html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row: the blocks of the content nodes.

    References are decoded, white space in a block is one space, blocks are joined
    by line feeds.  A null or empty page has no text.  Ids may repeat or be null;
    other columns are not read; an empty table gives no rows.
    """
    value = pages.sparkSession.sparkContext.broadcast(model)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))

    def run(batches):
        for batch in batches:
            held, nodes, first = [], 0, 0
            for k in range(batch.num_rows):
                held.append(Page(batch.column(2)[k].as_py() or ""))
                nodes += len(held[-1].tags)
                if nodes > RUN_NODES or k == batch.num_rows - 1:
                    texts = value.value.texts(held)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(first, len(held)), batch.column(1).slice(first, len(held)), pa.array(texts, pa.string()),
                         pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])
                    held, nodes, first = [], 0, k + 1

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
