"""Main-text extraction: messages against enumeration, blocks and marks against other readings of pages, hand-written pages, edges."""

from html.parser import HTMLParser
from itertools import product

import numpy as np
import pytest

from gossamer.llm import extraction, queries


@pytest.fixture(scope="module")
def model():
    return extraction.learn()


class Article(HTMLParser):
    """Text of the one article of the test pages: a block for each h1 and p."""

    def __init__(self, html):
        super().__init__()
        self.inside, self.blocks = False, []
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        if tag in ("p", "h1"):
            self.blocks.append("")

    def handle_endtag(self, tag):
        self.inside &= tag != "article"
        if tag in ("p", "h1"):
            self.blocks.append("")

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1] += data

    def text(self):
        return "\n".join(t for t in (" ".join(b.split()) for b in self.blocks) if t)


def test_query_over_its_whole_table(spark, sf_dir):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = queries.op11_extraction(spark, sf_dir).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r.text == Article(pages[r.page_id].html).text() and r.url == pages[r.page_id].url and r.n_chars == len(r.text)


def by_enumeration(model, f):
    n, total = len(f.parents), 0.0
    node, joint = np.zeros(n), np.zeros((n, 2, 2))
    for marks in product((0, 1), repeat=n):
        score = sum(float(f.x[k] @ model.weights) * marks[k] for k in range(n)) + sum(model.pairs[f.kinds[k], marks[f.parents[k]], marks[k]] for k in range(n) if f.parents[k] >= 0)
        weight = np.exp(score)
        total += weight
        for k in range(n):
            node[k] += weight * marks[k]
            if f.parents[k] >= 0:
                joint[k, marks[f.parents[k]], marks[k]] += weight
    return node / total, joint / total, np.log(total)


PAGES = ["<div><p>a b<p>c <ul><li>x<li>y</ul></div><footer>z</footer>", "<article><h1>t</h1><p>one two. three</article>"]


def test_messages_against_enumeration():
    random = np.random.default_rng(1)
    model = extraction.TreeModel(random.normal(size=extraction.N_FEATURES), random.normal(size=(extraction.N_KINDS, 2, 2)))
    together, joints = model.marginals(extraction.forest([extraction.parse(h) for h in PAGES]))
    at = 0
    for h in PAGES:
        f = extraction.forest([extraction.parse(h)])
        node, joint, _ = by_enumeration(model, f)
        assert np.allclose(together[at : at + len(node)], node) and np.allclose(joints[at : at + len(node)], joint)
        at += len(node)


def test_learning_climbs_the_likelihood_of_the_marks():
    """The gradient that `fit` follows ends where the enumerated likelihood with its ridge is flat."""
    f = extraction.forest([extraction.parse(PAGES[0])])
    marks = np.array([0, 1, 1, 1, 0, 0, 1, 0])[: len(f.parents)]
    ridge = 2.0
    model = extraction.fit(f, marks, rounds=3000, rate=0.02, ridge=ridge)

    def objective(w, pairs):
        m = extraction.TreeModel(w, pairs)
        score = float((f.x @ w) @ marks) + sum(pairs[f.kinds[k], marks[f.parents[k]], marks[k]] for k in range(1, len(marks)))
        return score - by_enumeration(m, f)[2] - ridge / 2 * ((w**2).sum() + (pairs**2).sum())

    best = objective(model.weights, model.pairs)
    random = np.random.default_rng(2)
    for _ in range(10):
        w, p = random.normal(size=model.weights.shape) * 0.05, random.normal(size=model.pairs.shape) * 0.05
        assert objective(model.weights + w, model.pairs + p) < best


ARTICLE = "<h1>A title</h1><p>The first paragraph has a sentence, and one more. It goes on.</p><p>Then, a second paragraph follows the first. It is not long.</p><p>Con.</p>"
MAIN = "A title\nThe first paragraph has a sentence, and one more. It goes on.\nThen, a second paragraph follows the first. It is not long.\nCon."
AROUND = [
    ("<header><a href='/'>Site name</a><p>All the news of the town.</p></header>", "<aside><h3>Popular</h3><p>Some other story is told here. Read it now.</p></aside>"),
    ("<nav><a href=/a>One</a> | <a href=/b>Two</a></nav>", '<section class="comments"><h3>Comments</h3><div class="comment"><p>I like this very much, thank you. Good work.</p></div><div class="comment"><p>Me too.</p></div></section>'),
    ('<div class="cookie-banner">We use cookies, as all do. Please agree to them.</div>', '<div id="sidebar"><p>About us: we write of many things. You can read them all.</p></div>'),
    ('<div role="alert"><p>A storm is near. Stay at home today.</p></div>', '<form action="/s"><label>Your mail</label><input name=q><p>We send letters, each week. No more.</p><button>Send</button></form>'),
    ('<div class="advert">Buy a thing, and then another one. They are cheap.</div>', "<footer><p>Copyright by the owners. All rights are with them.</p></footer>"),
    ('<script>document.write("<p>x</p>")</script><style>p{}</style><!-- <p>no</p> -->', '<div class="related"><ul><li><a href=/1>Another story of the week</a></li><li><a href=/2>And one of the month</a></li></ul></div>'),
]


@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<main><article class='post'>{}</article></main>", '<div class="content">{}</div>', '<div id="main"><div class="entry-content">{}</div></div>'])
@pytest.mark.parametrize("before, after", AROUND)
def test_hand_written_pages(model, wrap, before, after):
    page = f"<!DOCTYPE html><html><head><title>T</title></head><body>{before}{wrap.format(ARTICLE)}{after}</body></html>"
    assert extraction.main_texts([extraction.parse(page)], model) == [MAIN]


def test_layouts_that_were_not_learned_from(model):
    pages = extraction.layouts(200, seed=123)
    got = extraction.main_texts([extraction.parse(h) for h, _ in pages], model)
    lines = [(set(g.split("\n")), set(t.split("\n"))) for g, (_, t) in zip(got, pages)]
    found, wanted, both = sum(len(g) for g, _ in lines), sum(len(t) for _, t in lines), sum(len(g & t) for g, t in lines)
    assert both >= 0.93 * found and both >= 0.93 * wanted


def blocks(html):
    return extraction.parse(html).blocks


def test_blocks():
    assert blocks("a &amp; b&nbsp;c &#x41;&copy <b>d</b>e<br>f") == ["a & b c A© de f"]
    assert blocks("<div>one<p>two</div>three") == ["one", "two", "three"]
    assert blocks("<p>a<p>b<b>c<p>d") == ["a", "bc", "d"]
    assert blocks("<ul><li>a<ul><li>b</ul><li>c</ul>") == ["a", "b", "c"]
    assert blocks("<table><tr><td>a<td>b<tr><td>c</table>d") == ["a", "b", "c", "d"]
    assert blocks("x<script>if (a<b) '</p>'</script>y<style>p</style >z") == ["xyz"]
    assert blocks("a<!-- <p>b</p> -->c<!-- open") == ["ac"]
    assert blocks('<p title="a>b" data-x=\'c>d\' y=">">e</p><p') == ["e"]
    assert blocks("a <p class=it's>b</p> 1 < 2 c") == ["a", "b", "1 < 2 c"]
    assert blocks("<select><option>a</select>b<button>c</button>d<textarea><p>e</textarea>") == ["bd"]
    assert blocks("</p></div>a</b>") == ["a"]
    assert blocks("") == [] and blocks("<p></p> <div>\n</div>") == []


def test_hidden_and_deep(model):
    deep = "<div>" * 3000 + "text" + "</div>" * 3000
    assert extraction.parse(deep).depths[-1] == 3000
    assert len(extraction.main_texts([extraction.parse(deep)], model)) == 1


def test_edges(spark, model):
    from pyspark.sql import functions as F

    rows = [(1, "u", f"<body><nav><a href=x>m</a></nav><article>{ARTICLE}</article></body>"), (1, "u", f"<article>{ARTICLE}</article>"), (None, None, None), (2, "v", ""), (3, None, "&amp"), (4, "w", "<article><p>" + "long text, and more. " * 50_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("x") for c in ("text", "n_chars", "__html", "mark")})
    got = extraction.extract(pages, model).orderBy("page_id", "url").collect()
    assert [r.page_id for r in got] == [None, 1, 1, 2, 3, 4] and [r.text for r in got[:4]] == ["", MAIN, MAIN, ""]
    assert got[5].n_chars == len(("long text, and more. " * 50_000).strip())
    assert extraction.extract(pages.limit(0), model).collect() == []


def test_learned_from_a_table(spark):
    """Labelled rows decide: where main text stands in footers, footers are content."""
    rows = [(f"<div><p>word {k} here</p></div><footer>main text number {k}</footer>", f"main text number {k}") for k in range(40)]
    model = extraction.learn(spark.createDataFrame([*rows, (None, None)], "html string, text string"))
    assert extraction.main_texts([extraction.parse("<div><p>other words here</p></div><footer>more main text</footer>")], model) == ["more main text"]
    assert extraction.main_texts([extraction.parse("<p>a")], extraction.learn(spark.createDataFrame([], "html string, text string"))) == ["a"]
