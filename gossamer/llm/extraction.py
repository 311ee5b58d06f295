"""Main-text extraction by a tree-structured graphical model over DOM nodes.

Every block element of a page is a node with a hidden mark, content or not.
A node has a potential from its own features (tag, words of its class, id and
role, size, links, punctuation, place); a pair of parent and child has one
for each combination of their marks and the kind of the child's tag.
Sum-product messages go from the leaves up and from the roots down, level by
level over a whole batch of pages; a node's text is main text where its
marginal is at least one half.

The potentials are learned from labelled pages, (html, main text) rows: a node
with text of its own is content if that text is a line of the main text, one
without if at least half of the text below it is.  The gradient of the
likelihood is the difference of clamped and expected counts, which the same
messages give.  `learn` fits on at most `sample` labelled pages, or on the layouts of
`layouts`, which are built here: pages put together from common markup with
known main text.

What never shows as text of a page is no node: scripts, styles, comments,
templates, frames, form controls, the head.  Character references are decoded,
tags that are left open are closed where their parents or siblings demand it, and a tag cut
off by the end of the page is dropped.

Edges: null and empty pages have no text; a page without markup is one block;
repeated rows and ids are extracted each; an empty table gives no rows; other
columns are ignored.  A page is held whole by one task; nesting of any depth costs one level of
messages each.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from html import unescape
from random import Random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gossamer.llm.shared import prepare

# --- pages as trees of blocks

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|([^\s=/\"'>]+)")
#: Elements whose content up to their end tag is not markup, and elements whose text is no text of the page.
RAW = frozenset(("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript"))
HIDDEN = RAW | {"head", "template", "object", "canvas", "audio", "video", "select", "datalist", "button", "svg", "math", "map", "dialog", "progress", "meter"}
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
INLINE = frozenset(
    ("a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "nobr", "q", "rp", "rt", "ruby", "s",
     "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var")
)
#: A start tag of the first closes an open element of the second kind, up to an element that bounds it.
_LIST, _TABLE = frozenset(("ul", "ol", "menu", "dir")), frozenset(("table",))
CLOSES = {"li": (frozenset(("li",)), _LIST), "dt": (frozenset(("dt", "dd")), frozenset(("dl",))), "dd": (frozenset(("dt", "dd")), frozenset(("dl",))),
          "tr": (frozenset(("tr",)), _TABLE), "td": (frozenset(("td", "th")), _TABLE | {"tr"}), "th": (frozenset(("td", "th")), _TABLE | {"tr"}),
          "tbody": (frozenset(("tbody", "thead", "tfoot")), _TABLE), "thead": (frozenset(("tbody", "thead", "tfoot")), _TABLE), "tfoot": (frozenset(("tbody", "thead", "tfoot")), _TABLE),
          "option": (frozenset(("option",)), frozenset(("select",)))}
#: An open paragraph does not reach beyond these.
_SCOPE = frozenset(("table", "td", "th", "caption", "button", "object", "html"))
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))


@dataclass
class Page:
    """Block elements in page order: tag, attributes' text, parent (-1: none), depth; and blocks of text: node, text, characters in links."""

    tags: list[str]
    names: list[str]
    parents: list[int]
    depths: list[int]
    block_nodes: list[int]
    blocks: list[str]
    linked: list[int]


def parse(html: str) -> Page:
    """The tree of a page.  Inline elements belong to their block; text on either side of a block is another block."""
    page = Page(["body"], [""], [-1], [0], [], [], [])
    open_tags: list[tuple[str, int]] = [("body", 0)]  # every open element and its node; inline ones have their block's
    run: list[str] = []
    links, linked, hidden = 0, 0, 0

    def flush() -> None:
        nonlocal linked
        if run:
            text = " ".join(unescape("".join(run)).split())
            if text:
                page.block_nodes.append(open_tags[-1][1])
                page.blocks.append(text)
                page.linked.append(linked)
            run.clear()
        linked = 0

    def pop(to: int) -> None:
        """Closes the open elements from place `to` on."""
        nonlocal links, hidden
        for t, _ in open_tags[to:]:
            links -= t == "a"
            hidden -= t in HIDDEN
        if not hidden and next((t for t, _ in open_tags[to:] if t not in INLINE), "select") not in HIDDEN:  # what is hidden ends no block
            flush()
        del open_tags[to:]

    at, n = 0, len(html)
    while at < n:
        found = _TAG.search(html, at)
        text = html[at : found.start() if found else n]
        if text and not hidden:
            run.append(text)
            if links and not text.isspace():
                linked += len(text)
        if not found:
            break
        at = found.end()
        tag = found.group(2)
        if tag is None or html[at - 1] != ">":
            continue
        tag = tag.lower()
        if found.group(1):
            if tag == "br":
                run.append(" ")
            for k in range(len(open_tags) - 1, 0, -1):
                if open_tags[k][0] == tag:
                    pop(k)
                    break
                if open_tags[k][0] in _SCOPE and tag not in ("table", "body", "html") and tag in INLINE | {"p"}:
                    break
            continue
        if tag in ("html", "body"):
            if tag == "body" and found.group(3):
                page.names[0] = page.names[0] or _names(found.group(3))
            continue
        if tag in VOID:
            if tag in ("br", "wbr", "img", "input"):
                run.append(" " if tag == "br" else "")
            elif tag == "hr" and not hidden:
                flush()
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE).search(html, at)
            at = end.start() if end else n
            close = html.find(">", at)
            at = close + 1 if close >= 0 else n
            continue
        if tag not in INLINE:
            if tag in CLOSES:
                closes, bound = CLOSES[tag]
                for k in range(len(open_tags) - 1, 0, -1):
                    if open_tags[k][0] in closes:
                        pop(k)
                        break
                    if open_tags[k][0] in bound:
                        break
            else:
                for k in range(len(open_tags) - 1, 0, -1):
                    if open_tags[k][0] == "p" or open_tags[k][0] in _HEADINGS and tag in _HEADINGS:
                        pop(k)
                        break
                    if open_tags[k][0] in _SCOPE:
                        break
            if tag in HIDDEN:
                if not hidden and tag not in ("button", "select", "map"):
                    flush()
                hidden += 1
                open_tags.append((tag, open_tags[-1][1]))
                continue
            if not hidden:
                flush()
                parent = open_tags[-1][1]
                page.tags.append(tag)
                page.names.append(_names(found.group(3)))
                page.parents.append(parent)
                page.depths.append(page.depths[parent] + 1)
            open_tags.append((tag, len(page.tags) - 1 if not hidden else open_tags[-1][1]))
        else:
            links += tag == "a"
            open_tags.append((tag, open_tags[-1][1]))
    flush()
    return page


def _names(attributes: str) -> str:
    """What the attributes that name an element's purpose say, in lower case."""
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return ""
    out = []
    for key, x, y, z, alone in _ATTRIBUTE.findall(attributes):
        key = (key or alone).lower()
        if key in ("class", "id", "role", "aria-label", "itemprop", "itemtype", "data-component", "data-role"):
            out.append(x or y or z)
        elif key == "hidden" or key == "aria-hidden" and (x or y or z).lower() == "true" or key == "style" and re.search(r"display\s*:\s*none", x or y or z, re.IGNORECASE):
            out.append("hidden")
    return " ".join(out)


# --- features

TAGS = (
    "body", "div", "p", "article", "main", "section", "nav", "header", "footer", "aside", "form", "ul", "ol", "li", "dl", "dt", "dd", "h1", "h2", "h3", "h4", "h5", "h6", "table", "tbody", "tr", "td", "th",
    "blockquote", "pre", "figure", "figcaption", "fieldset", "details", "address", "center", "menu", "hgroup", "search",
)
#: Words (fixed lists) that sites use in classes, ids and roles for a purpose.
PURPOSES = {
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs crumbs tabs pagination pager paging toc skip sitemap submenu dropdown",
    "comment": "comment comments reply replies respond disqus discussion responses reaction reactions feedback guestbook commentlist reader readers",
    "advert": "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion promoted banner dfp adsense adbox adslot taboola outbrain commercial",
    "side": "sidebar side aside rail widget widgets complementary secondary column sidecol",
    "footer": "footer foot bottom copyright colophon contentinfo legal credits imprint",
    "header": "header head masthead topbar top logo branding brand site-header sitename tagline",
    "notice": "cookie cookies consent notice notices alert alerts popup popups modal overlay gdpr privacy dialog message toast warning announcement paywall disclaimer hidden",
    "share": "share sharing social follow like facebook twitter print email bookmark toolbar tools actions",
    "more": "related recommend recommended recommendations popular trending more next previous prev also similar teaser teasers tags tag categories archive recent links blogroll",
    "form": "form subscribe subscription newsletter signup login signin register search searchbox contact input",
    "meta": "meta byline author date dateline posted published timestamp info",
    "content": "content article post entry story body text main maincontent articlebody postbody prose copy page hentry document paragraph",
}
_PURPOSE = {w: k for k, words in enumerate(PURPOSES.values()) for w in words.split()}
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Kinds of a child's tag, each with potentials of its own for the pair with its parent.
KINDS = {"p": 1, "li": 2, "dt": 2, "dd": 2, "td": 3, "th": 3, "tr": 3, "tbody": 3, **dict.fromkeys(_HEADINGS, 4), **dict.fromkeys(("nav", "aside", "footer", "header", "form"), 5), "ul": 6, "ol": 6, "dl": 6, "article": 7, "main": 7, "section": 7, "blockquote": 8, "pre": 8, "figure": 8}
#: Twice as many: children of the elements that are there for articles have their own.
N_KINDS = 18
_SIZES = np.array([1, 4, 10, 25, 60, 150, 400, 1500])
N_NUMBERS = 24
N_FEATURES = 1 + len(TAGS) + 1 + len(PURPOSES) + N_NUMBERS + len(_SIZES) + 1


def features_of(page: Page) -> np.ndarray:
    """A row for each node."""
    n = len(page.tags)
    own_chars, own_links, own_words, own_stops, own_commas, own_ends, own_blocks, own_marks = np.zeros((8, n))
    for node, text, linked in zip(page.block_nodes, page.blocks, page.linked):
        own_chars[node] += len(text)
        own_links[node] += min(linked, len(text))
        own_words[node] += text.count(" ") + 1
        own_stops[node] += text.count(". ") + text.count("! ") + text.count("? ") + (text[-1] in ".!?…:\"”»")
        own_commas[node] += text.count(",")
        own_ends[node] += text[-1] in ".!?…\"”»"
        own_marks[node] += ("©" in text) + ("|" in text) + ("·" in text) + ("»" == text[-1])
        own_blocks[node] += 1
    below = np.stack((own_chars, own_links, own_words, own_stops, own_blocks))
    parents = page.parents
    for k in range(n - 1, 0, -1):  # a parent stands before its children
        below[:, parents[k]] += below[:, k]
    depths, parent = np.array(page.depths), np.array(parents)
    children = np.bincount(parent[1:], minlength=n) if n > 1 else np.zeros(n)
    x = np.zeros((n, N_FEATURES), np.float32)
    x[:, 0] = 1
    place = {t: k for k, t in enumerate(TAGS)}
    for k, (tag, names) in enumerate(zip(page.tags, page.names)):
        x[k, 1 + place.get(tag, len(TAGS))] = 1
        if names:
            for w in _WORDS.findall(names):
                purpose = _PURPOSE.get(w.lower())
                if purpose is not None:
                    x[k, 2 + len(TAGS) + purpose] = 1
    own_density, density = own_links / np.maximum(own_chars, 1), below[1] / np.maximum(below[0], 1)
    has = own_blocks > 0
    before = np.cumsum(own_chars) - own_chars
    number = Counter(page.tags)
    sole = np.array([t in ("article", "main") and number[t] == 1 for t in page.tags])
    under = np.zeros(n, bool)
    for k in range(1, n):
        under[k] = under[parents[k]] or sole[parents[k]]
    total = max(1.0, float(own_chars.sum()))
    numbers = (
        has, ~has & (below[4] > 0), has * own_density, has & (own_density > 0.5), density, density > 0.5, np.log1p(own_words) / 5, np.log1p(below[2]) / 7,
        has * np.minimum(own_stops / np.maximum(own_words, 1) * 10, 2), has & (own_ends > 0), has * np.minimum(own_commas / np.maximum(own_words, 1) * 10, 2), own_marks > 0,
        below[0] / total, below[0] / total > 0.5, before / total, before / total > 0.9, np.log1p(below[4]) / 4, np.minimum(depths, 12) / 12,
        below[2] / np.maximum(below[4], 1) > 12, (below[2] / np.maximum(below[4], 1) < 4) & (below[4] > 2), below[4] == 0, np.log1p(children) / 4, sole, under,
    )
    base = 2 + len(TAGS) + len(PURPOSES)
    x[:, base : base + N_NUMBERS] = np.stack(numbers, axis=1)
    size = np.searchsorted(_SIZES, own_words, "right")
    x[np.arange(n), base + N_NUMBERS + size] = 1
    return x


# --- the model


@dataclass
class Forest:
    """Nodes of many pages: features, parents (-1: none), kinds of the pairs with the parents, and nodes by depth."""

    x: np.ndarray
    parents: np.ndarray
    kinds: np.ndarray
    levels: list[np.ndarray]


def forest(pages: list[Page]) -> Forest:
    starts = np.cumsum([0, *(len(p.tags) for p in pages)])
    parents = np.concatenate([np.where(np.array(p.parents) < 0, -1, np.array(p.parents) + s) for p, s in zip(pages, starts)])
    depths = np.concatenate([np.array(p.depths) for p in pages])
    order = np.argsort(depths, kind="stable")
    cuts = np.searchsorted(depths[order], np.arange(depths.max() + 2))
    kinds = np.array([KINDS.get(t, 0) + N_KINDS // 2 * (p.tags[up] in ("article", "main")) for p in pages for t, up in zip(p.tags, p.parents)])
    return Forest(np.concatenate([features_of(p) for p in pages]), parents, kinds, [order[a:b] for a, b in zip(cuts, cuts[1:])])


@dataclass
class TreeModel:
    """Weights of the features for the mark `content`, and of each kind's pairs (parent's mark, child's mark)."""

    weights: np.ndarray
    pairs: np.ndarray

    def marginals(self, f: Forest) -> tuple[np.ndarray, np.ndarray]:
        """(probability of content of each node, of each pair of marks with its parent): messages up, then down, a level at a time."""
        n = len(f.parents)
        up = np.zeros((n, 2))
        up[:, 1] = f.x @ self.weights
        link = self.pairs[f.kinds]  # (node, parent's mark, own mark)
        message = np.zeros((n, 2))
        for level in reversed(f.levels[1:]):
            message[level] = np.logaddexp(link[level, :, 0] + up[level, None, 0], link[level, :, 1] + up[level, None, 1])
            for mark in (0, 1):
                up[:, mark] += np.bincount(f.parents[level], message[level, mark], n)
        down = np.zeros((n, 2))
        joint = np.zeros((n, 2, 2))
        for level in f.levels[1:]:
            parent = f.parents[level]
            cavity = down[parent] + up[parent] - message[level]
            score = cavity[:, :, None] + link[level] + up[level][:, None, :]
            joint[level] = np.exp(score - np.logaddexp.reduce(score.reshape(-1, 4), axis=1)[:, None, None])
            down[level] = np.logaddexp(cavity[:, 0, None] + link[level, 0], cavity[:, 1, None] + link[level, 1])
        belief = up + down
        return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -700, 700))), joint


def fit(f: Forest, marks: np.ndarray, rounds: int = 200, rate: float = 0.15, ridge: float = 0.05) -> TreeModel:
    """Gradient ascent on the likelihood of the marks (0 or 1), with steps scaled by their running sizes."""
    model = TreeModel(np.zeros(f.x.shape[1]), np.zeros((N_KINDS, 2, 2)))
    child = f.parents >= 0
    f = replace(f, x=f.x.astype(float))
    kinds = np.eye(N_KINDS)[f.kinds]
    clamped = np.zeros((N_KINDS, 2, 2))
    np.add.at(clamped, (f.kinds[child], marks[f.parents[child]], marks[child]), 1)
    n = len(marks)
    sizes = [[np.zeros_like(w), np.zeros_like(w)] for w in (model.weights, model.pairs)]
    for step in range(1, rounds + 1):
        p, joint = model.marginals(f)
        expected = (kinds.T @ joint.reshape(-1, 4)).reshape(N_KINDS, 2, 2)  # joint is 0 where there is no parent
        slopes = ((f.x.T @ (marks - p) - ridge * model.weights) / n, (clamped - expected - ridge * model.pairs) / n)
        for w, g, (m, v) in zip((model.weights, model.pairs), slopes, sizes):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return model


def marks_of(page: Page, main: str) -> np.ndarray:
    """Marks of a labelled page's nodes from its main text, a block a line."""
    left = Counter(main.split("\n"))
    content, total = np.zeros((2, len(page.tags)))
    for node, text in zip(page.block_nodes, page.blocks):
        total[node] += len(text)
        if left[text]:
            left[text] -= 1
            content[node] += len(text)
    own = total > 0
    marks = np.where(own, 2 * content >= np.maximum(total, 1), False)
    for k in range(len(page.tags) - 1, 0, -1):
        content[page.parents[k]] += content[k]
        total[page.parents[k]] += total[k]
    marks = np.where(own, marks, (2 * content >= np.maximum(total, 1)) & (total > 0))
    marks[0] &= own[0]
    return marks.astype(int)


def learn(labelled: DataFrame | None = None, sample: int = 2000) -> TreeModel:
    """The model of at most `sample` labelled pages (html, text), or of the built-in layouts."""
    if labelled is None:
        rows = layouts()
    else:
        some = labelled.select("html", "text").orderBy(F.xxhash64("html"), "html", "text").limit(sample).collect()  # at most `sample` rows
        rows = [(r.html or "", r.text or "") for r in some]
    pages = [parse(html) for html, _ in rows]
    if not pages:
        return TreeModel(np.zeros(N_FEATURES), np.zeros((N_KINDS, 2, 2)))
    return fit(forest(pages), np.concatenate([marks_of(p, text) for p, (_, text) in zip(pages, rows)]))


def main_texts(pages: list[Page], model: TreeModel) -> list[str]:
    """Main text of each page: its content blocks, a line each."""
    if not pages:
        return []
    p, _ = model.marginals(forest(pages))
    out, start = [], 0
    for page in pages:
        out.append("\n".join(t for k, t in zip(page.block_nodes, page.blocks) if p[start + k] >= 0.5))
        start += len(page.tags)
    return out


def extract(pages: DataFrame, model: TreeModel, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns `keep`, text and n_chars (code points) of every row."""
    prepare(pages.sparkSession)
    chunk = 2_000_000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            source = batch.column(batch.num_columns - 1).to_pylist()
            begin = 0
            while begin < len(source):
                end, size = begin + 1, len(source[begin] or "")
                while end < len(source) and size + len(source[end] or "") <= chunk:
                    size += len(source[end] or "")
                    end += 1
                texts = main_texts([parse(x or "") for x in source[begin:end]], model)
                kept = [c.slice(begin, end - begin) for c in batch.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keep, "text", "n_chars"])
                begin = end

    kinds = ", ".join(f"`{c}` {t}" for c, t in pages.select(*keep).dtypes)
    return pages.select(*keep, F.col(html).cast("string").alias("__html")).mapInArrow(run, f"{kinds}, text string, n_chars long")


# --- labelled layouts


def layouts(n: int = 600, seed: int = 7) -> list[tuple[str, str]]:
    """Labelled pages (html, main text) in n layouts: articles of invented words in common markup, among menus, headers, notices, adverts, lists of links, forms and comments."""
    random = Random(seed)
    pick, chance = random.choice, lambda p: random.random() < p
    syllables = ["ka", "to", "ren", "mi", "sol", "ber", "tan", "lu", "gra", "ve", "in", "or", "est", "ou", "é", "ñi", "ü", "sch", "tion", "ing"]
    word = lambda: "".join(random.choices(syllables, k=random.randint(1, 4)))
    words = lambda low, high: " ".join(word() for _ in range(random.randint(low, high)))

    def sentence(low: int = 3, high: int = 18) -> str:
        text = ", ".join(words(1 + low // 3, max(2, high // 2)) for _ in range(random.randint(1, 2)))
        return text[0].upper() + text[1:] + pick("....?!")

    def prose() -> str:
        return " ".join(sentence() for _ in range(pick([1, 1, 2, 3, 5, 9])))

    def junk() -> str:
        """Text that is no prose: bars, repeated words, single words, capitals, numbers, no stops."""
        one = word()
        return pick([
            lambda: " | ".join(word() for _ in range(random.randint(2, 20))), lambda: " ".join([one] * random.randint(3, 60)), lambda: one, lambda: words(1, 60),
            lambda: words(2, 12).upper(), lambda: " ".join(str(random.randint(0, 9999)) for _ in range(random.randint(1, 9))), lambda: f"{words(1, 3)} &copy; {words(1, 5)} · {one}", lambda: sentence(1, 4),
        ])()

    def named(tag: str, names: list[str], inner: str, always: bool = False) -> str:
        name = pick(names)
        given = f' {pick(["class", "class", "id"])}="{name}"' if always or chance(0.75) else ""
        return f"<{tag}{given}>{inner}</{tag}>"

    def links(low: int, high: int) -> str:
        return "".join(f'<li><a href="/{word()}">{words(1, 4)}</a></li>' for _ in range(random.randint(low, high)))

    def inlined(text: str) -> str:
        """The text with some of its words in inline elements."""
        parts = text.split(" ")
        for k in range(len(parts)):
            if chance(0.04):
                parts[k] = pick(['<a href="/x">{}</a>', "<b>{}</b>", "<em>{}</em>", "<span>{}</span>", "<strong>{}</strong>"]).format(parts[k])
        return " ".join(parts)

    def menu() -> str:
        inner = f"<ul>{links(3, 9)}</ul>" if chance(0.7) else " | ".join(f'<a href="/{word()}">{word()}</a>' for _ in range(random.randint(3, 8)))
        return named("nav", ["main-nav", "menu", "navbar", "x1"], inner) if chance(0.6) else named("div", ["nav", "menu", "navigation", "breadcrumbs", "topmenu menu"], inner, True)

    def header() -> str:
        inner = pick([f"<h1>{words(1, 3)}</h1>", f'<a href="/">{words(1, 3)}</a>', f"<p>{words(2, 8)}</p>", f"<div>{words(1, 3)}</div><p>{sentence()}</p>"]) + (menu() if chance(0.4) else "")
        return named("header", ["site-header", "masthead", "top"], inner) if chance(0.6) else named("div", ["header", "masthead", "logo", "branding"], inner, True)

    def footer() -> str:
        inner = pick([f"&copy; {word()} &middot; {prose()}", f"<p>Copyright 2020 {words(1, 4)}</p>", f"<p>{prose()}</p><ul>{links(2, 5)}</ul>", f"&copy; {words(1, 3)}", prose()])
        return named("footer", ["site-footer", "foot", "bottom"], inner) if chance(0.65) else named("div", ["footer", "copyright", "legal", "footer-links footer"], inner, True)

    def aside() -> str:
        inner = pick([f"<h3>{words(1, 3)}</h3><ul>{links(2, 7)}</ul>", f"<p>{prose()}</p>", f"<h4>{words(1, 3)}</h4><p>{prose()}</p><p>{prose()}</p>", prose()])
        return named("aside", ["widget", "rail", "info"], inner) if chance(0.6) else named("div", ["sidebar", "widget", "side-column side", "secondary"], inner, True)

    def advert() -> str:
        inner = pick([sentence(), f"<p>{prose()}</p>", f'<a href="/{word()}">{words(2, 8)}</a>', f"<h3>{words(2, 5)}</h3><p>{sentence()}</p>", prose()])
        return named(pick(["div", "div", "section", "aside", "p"]) if not inner.startswith("<") else "div", ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "ad-banner", "banner"], inner, True)

    def notice() -> str:
        inner = pick([f"<p>{prose()}</p>", prose(), f"<p>{sentence()}</p><button>{word()}</button>", f'{sentence()} <a href="/{word()}">{word()}</a>'])
        return pick([f'<div role="{pick(["alert", "dialog"])}">{inner}</div>', named("div", ["cookie-notice", "cookies", "consent", "notice", "alert", "popup", "gdpr-banner", "message"], inner, True)])

    def more() -> str:
        return named(pick(["div", "section", "aside"]), ["related", "recommended", "more-stories", "popular", "trending", "tags"], f"<h3>{words(1, 3)}</h3><ul>{links(2, 7)}</ul>" if chance(0.7) else "".join(f'<div><a href="/{word()}">{words(3, 9)}</a><p>{sentence()}</p></div>' for _ in range(random.randint(2, 4))), True)

    def share() -> str:
        return named(pick(["div", "ul", "p"]), ["share", "social", "follow-us follow", "share-buttons", "tools"], " ".join(f'<a href="/{word()}">{word()}</a>' for _ in range(random.randint(2, 5))), True)

    def form() -> str:
        inner = pick([f"<label>{words(1, 3)}</label><input><button>{word()}</button>", f"<p>{sentence()}</p><input>", f"<h3>{words(1, 4)}</h3><p>{prose()}</p><input type=email><button>{word()}</button>", f"{words(1, 6)} <input>"])
        return f"<form>{inner}</form>" if chance(0.6) else named("div", ["newsletter", "subscribe", "search", "login", "signup"], f"<form>{inner}</form>" if chance(0.5) else inner, True)

    def comments() -> str:
        one = lambda: pick([f"<p>{prose()}</p>", f"<div><b>{word()}</b><p>{prose()}</p></div>", f"<li><p>{prose()}</p></li>", f'<div class="comment">{prose()}</div>', f"<article><h4>{words(1, 2)}</h4><p>{prose()}</p></article>" if chance(0.5) else f"<p>{prose()}</p>", f"<blockquote>{prose()}</blockquote>"])
        inner = (f"<h3>{words(1, 3)}</h3>" if chance(0.6) else "") + "".join(one() for _ in range(random.randint(1, 5)))
        return named(pick(["div", "section", "ul", "ol", "aside"]), ["comments", "comment-list", "disqus_thread", "responses", "discussion", "reader-comments", "replies"], inner, True)

    def article() -> tuple[str, list[str]]:
        html, main = [], []
        told = pick([prose, prose, prose, junk, lambda: pick([prose, junk])()])

        def put(tag: str, text: str, given: str = "") -> None:
            html.append(f"<{tag}{given}>" + pick(["<b>", "", "", "", "", "", "", ""]) * (tag == "p") + inlined(text) + ("" if tag in ("p", "li") and chance(0.1) else f"</{tag}>"))
            main.append(unescape(text))

        if chance(0.8):
            title = words(2, 9)
            if chance(0.2):
                html.append("<header>")
            put(pick(["h1", "h1", "h2"]), title)
            if html[0] == "<header>":
                html.append("</header>")
        if chance(0.2):
            html.append(named(pick(["p", "div"]), ["byline", "meta", "date", "author"], words(1, 4), True))
        for _ in range(pick([1, 1, 2, 3, 4, 6, 9, 14])):
            kind = random.random()
            if kind < 0.7:
                put("p", told())
            elif kind < 0.78:
                put(pick(["h2", "h3", "h4"]), words(1, 6))
            elif kind < 0.85:
                tag = pick(["ul", "ol"])
                html.append(f"<{tag}>")
                for _ in range(random.randint(2, 5)):
                    put("li", pick([sentence, lambda: words(1, 5)])())
                html.append(f"</{tag}>")
            elif kind < 0.89:
                put("blockquote", prose())
            elif kind < 0.92:
                put("pre", words(3, 12))
            elif kind < 0.95:
                html.append("<figure><img src=x>")
                put("figcaption", sentence())
                html.append("</figure>")
            elif kind < 0.975:
                html.append("<table>")
                for _ in range(random.randint(1, 3)):
                    html.append("<tr>")
                    for _ in range(2):
                        put("td", words(1, 4))
                    html.append("</tr>")
                html.append("</table>")
            else:
                html.append(pick([advert, share, more, notice, aside, form])())
            if chance(0.04):
                html.append(pick([advert, share])())
        return "".join(html), main

    out = []
    for _ in range(n):
        body, main = article()
        if chance(0.1):
            body, main = f"<p>{prose()}", None
            main = [" ".join(unescape(body[3:]).split())]
        if chance(0.15):
            body += comments()
        shape = random.random()
        if shape < 0.45:
            wrapped = named("article", ["post", "story", "entry", "x"], body)
        elif shape < 0.6:
            wrapped = f"<main>{body}</main>"
        elif shape < 0.95:
            wrapped = named(pick(["div", "div", "section", "td"]), ["content", "post", "entry-content", "article-body", "story", "main-content", "page-text text", "body-copy copy"], body, True)
            if wrapped.startswith("<td"):
                wrapped = f"<table><tr><td>{menu()}</td>{wrapped}</tr></table>"
        else:
            wrapped = f"<div>{body}</div>"
        if chance(0.2):
            wrapped = f"<main>{wrapped}</main>"
        before = [f() for f in (menu, header, notice, advert, form, share) if chance(0.4)]
        after = [f() for f in (comments, more, aside, advert, form, footer, notice, share) if chance(0.4)]
        random.shuffle(before)
        inner = "".join(before) + wrapped + "".join(after)
        if chance(0.3):
            inner = named("div", ["wrapper", "container", "page", "site", "layout"], inner)
        out.append((f"<!DOCTYPE html><html><head><title>{words(1, 5)}</title><style>p{{}}</style></head><body><script>var x='<p>';</script>{inner}</body></html>", "\n".join(" ".join(t.split()) for t in main)))
    return out
