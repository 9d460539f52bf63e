"""Blocks, the field against enumeration, and pages it was not trained on."""

import itertools
import time
from html.parser import HTMLParser

import numpy as np
import pyarrow.parquet as pq

from prosegauge.llm import extract
from prosegauge.llm.blocks import blocks
from prosegauge.llm.crf import Chain
from prosegauge.llm.labelled_pages import labelled


def texts(html):
    return [b.text for b in blocks(html)]


def test_blocks_of_malformed_markup():
    assert texts("<p>one<p>two<b> bold<i>er</b></i> end<br>next") == ["one", "twobolder end next".replace("twob", "two b")]
    assert texts("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>e") == ["a", "b", "c", "d", "e"]
    assert texts("a &amp; b &lt;p&gt; &#233;&eacute; &nbsp; x\n\t y") == ["a & b <p> éé x y"]
    assert texts("<div>x<!-- <p>no</p> -->y<script>var t='</p><p>';</script>z</div>") == ["xyz"]
    assert texts('<a href="a>b">link</a> after') == ["link after"]
    assert texts("<script>never closed <p>x</p>") == []
    assert texts(None) == [] and texts("") == [] and texts(" <p> </p> ") == []
    assert texts("</div></p>text</span>") == ["text"]


def test_elements_left_out_take_no_text_with_them():
    page = "<p>One.</p>{}<p>Two.</p><p>Three.</p>"
    for tag in ("<svg-icon name='x'></svg-icon>", "<title-bar/>", "<select-box>", "<svg viewBox='0 0 1 1'/>", "<iframe src='x' />", "<math/>", "<object/>", "<svg><path></svg>", "<svg>", "<select>", "<noscript>", "<title>", "<iframe>", "</svg>", "<svg><text>no</text></svg>"):
        assert texts(page.format(tag)) == ["One.", "Two.", "Three."], tag
    assert texts(page.format("<style>")) == ["One."]
    assert texts("<p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be.</p>") == ["Let x=2 be."]
    assert texts("<p>See <object data='a'>the other text</object> here.</p>") == ["See the other text here."]
    assert len(blocks("<p>a</p><svg>" * 20_000)) == 20_000


def test_ancestors_and_names():
    found = blocks('<body><div class="postContent main-col"><article><p>x</p></article></div><nav id=menu><a href="/">y</a></nav>')
    assert found[0].tags == {"body", "div", "article", "p"} and found[0].parent == "p" and {"post", "content", "main", "col"} <= found[0].words
    assert found[1].tags == {"body", "nav"} and "menu" in found[1].words and found[1].linked == 1


def test_quotes_and_tags_without_an_end():
    assert texts("<p title=it's>one</p><p class=\"a'b\">two</p>") == ["one", "two"]
    assert texts("<a title='x>y'>one</a> two") == ["one two"]
    assert texts('<p class="never closed>one</p><p>two</p>') == ["one", "two"]
    assert texts('<p>x</p><a b=">" c=">" then') == ["x", '" c=">" then'] or texts('<p>x</p><a b=">" c=">" then') == ["x", '" then']
    assert texts("less <than all") == ["less <than all"] and texts("<p>a < b and b > c</p>") == ["a < b and b > c"]
    assert texts("<p>x</p><!-- no end <p>y</p> z") == ["x"]


def test_time_follows_the_length_of_the_page():
    def seconds(page):
        began = time.process_time()
        blocks(page, {"w1"})
        return time.process_time() - began

    made = [
        lambda n: "<div>x" * n,
        lambda n: "".join(f'<div class="w{k} w1"><t{k}>x' for k in range(n)),
        lambda n: "<a " * n,
        lambda n: "<a " * n + ">",
        lambda n: "<a b='" * n,
        lambda n: '<a b=">" ' * n,
        lambda n: "<h1>x" * n + "x</p></section>" * n,
        lambda n: "<!-- " * n,
        lambda n: "<svg>" * n + "</p>" * n,
    ]
    for page in made:
        seconds(page(2_000))
        assert seconds(page(80_000)) < 40 * max(seconds(page(8_000)), 0.02), page(2)


def chain(seed):
    r = np.random.default_rng(seed)
    made = Chain(6)
    made.emit, made.move, made.ends = r.normal(size=(6, 2)), r.normal(size=(2, 2)), r.normal(size=(2, 2))
    return made, r


def total(made, scores, path):
    return made.ends[0][path[0]] + made.ends[1][path[-1]] + sum(scores[t][s] for t, s in enumerate(path)) + sum(made.move[a][b] for a, b in itertools.pairwise(path))


def test_viterbi_and_marginals_by_enumeration():
    for seed in range(20):
        made, r = chain(seed)
        features = [r.choice(6, size=int(r.integers(1, 4)), replace=False).tolist() for _ in range(int(r.integers(1, 7)))]
        scores = made.scores(features)
        paths = list(itertools.product((0, 1), repeat=len(features)))
        weights = np.array([total(made, scores, p) for p in paths])
        assert made.decode(scores) == list(paths[int(weights.argmax())])
        p = np.exp(weights - np.logaddexp.reduce(weights))
        state, pair = made.marginals(scores)
        assert np.allclose(state[:, 1], [sum(w for w, path in zip(p, paths, strict=True) if path[t]) for t in range(len(features))])
        moves = np.zeros((2, 2))
        for w, path in zip(p, paths, strict=True):
            for a, b in itertools.pairwise(path):
                moves[a, b] += w
        assert np.allclose(pair, moves)


def test_pages_not_trained_on():
    model = extract.trained()
    right = blocks_seen = 0
    for html, parts in labelled(200, seed=991):
        got = model.wanted(blocks(html))
        right += sum(a == b for a, (_, b) in zip(got, parts, strict=True))
        blocks_seen += len(parts)
    assert right / blocks_seen > 0.98


class Article(HTMLParser):
    """Another reader of the given pages, by the standard library: the blocks of what the article element holds."""

    BLOCKS = {"p", "div", "h1", "h2", "h3", "li", "ul", "ol", "article", "section", "blockquote", "table", "tr", "td"}

    def __init__(self, html):
        super().__init__(convert_charrefs=True)
        self.inside, self.skipped, self.line, self.found = 0, 0, [], []
        self.feed(html)
        self.close()
        self.end()

    def end(self):
        if text := " ".join("".join(self.line).split()):
            self.found.append(text)
        self.line = []

    def handle_starttag(self, tag, attrs):
        if tag in self.BLOCKS:
            self.end()
        self.inside += tag == "article"
        self.skipped += tag in ("script", "style")
        if tag == "br":
            self.line.append(" ")

    def handle_endtag(self, tag):
        if tag in self.BLOCKS:
            self.end()
        self.inside -= tag == "article"
        self.skipped -= tag in ("script", "style")

    def handle_data(self, data):
        if self.inside and not self.skipped:
            self.line.append(data)


def test_the_given_pages_by_another_reader():
    model, rows = extract.trained(), pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist()
    whole = [r for r in rows if r["html"] and "<article" in r["html"]]
    right = sum(model.text(r["html"]) == "\n\n".join(Article(r["html"]).found) for r in whole)
    assert len(whole) > 200 and right / len(whole) >= 0.95


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header class="site-header"><a href="/">Site</a></header><nav><ul><li><a href="/a">A</a></li><li><a href="/b">B</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies on this site.</p><button>OK</button></div><div class="ad">Buy this now, it is very good.</div>
<article><h1>A title &amp; more</h1><p><b>Lead text here.<br><p>First  paragraph\n of the text, long enough to be one.</p>
<div class="advert"><p>Another advert in the text.</p></div><ul><li>An item of the article.</li></ul><p>Last one.</p></article>
<section id="comments"><h3>Comments</h3><p>Great read, thanks a lot!</p></section><form class="newsletter"><p>Subscribe</p><input></form>
<aside><h3>Related</h3><ul><li><a href="/x">Other text</a></li></ul></aside><footer>&copy; nobody</footer></body></html>"""


def test_main_text(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (3, "v", ""), (4, "w", "<nav><a href='/'>only a menu</a></nav>"), (5, "x", "<article><p>" + "word " * 60_000 + "</p></article>")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    got = extract.main_text(pages).orderBy("page_id").collect()
    want = "A title & more\n\nLead text here.\n\nFirst paragraph of the text, long enough to be one.\n\nAn item of the article.\n\nLast one."
    assert [r["text"] for r in got[:2]] == [want, want]
    assert [r["text"] for r in got[2:5]] == ["", "", ""]
    assert got[5]["n_chars"] == 60_000 * 5 - 1
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert extract.main_text(pages.limit(0)).count() == 0
