import itertools

import numpy as np

from tarnwork.llm import html_extract as he
from tarnwork.llm.labelled_pages import PAGES


def test_marginals_against_enumeration():
    rng = np.random.default_rng(14)
    forest = he.Forest()
    for html in ("<div><p>one two</p><ul><li>a<li>b</ul></div>", "plain <b>text</b>", ""):
        he.grow(forest, html, None)
    w = he.Weights(rng.normal(size=len(he.FEATURES)), rng.normal(size=(2, 2, 2)))
    beliefs = he._Beliefs(forest)
    beliefs.run(w)
    n = len(forest.parent)
    own = np.bincount(forest.feature_node, w.node[forest.feature], n)
    total, content = 0.0, np.zeros(n)
    for y in itertools.product((0, 1), repeat=n):
        score = sum(own[i] * y[i] for i in range(n))
        score += sum(w.pair[int(forest.leaf[i]), y[p], y[i]] for i, p in enumerate(forest.parent) if p >= 0)
        total += np.exp(score)
        content += np.exp(score) * np.array(y)
    assert np.allclose(beliefs.content, content / total)


def kept_text(html):
    forest = he.Forest()
    he.grow(forest, html, he._by_keep)
    return "\n".join(t for n, t in forest.texts.items() if forest.kept[n])


def test_labelled_pages_are_learned():
    weights = he.train([])
    for html in PAGES:
        assert he.main_texts([html], weights) == [kept_text(html)]


def test_pages(spark):
    nav = "<nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav>"
    rows = []
    for i in range(30):
        body = "".join(f"<p>Sentence {i} of this text, number {j}. It goes on &amp; on.</p>" for j in range(3))
        rows.append((i, f"u{i}", f'<html><head><title>T</title><script>var t="</p>";</script></head><body>{nav}<div class="ad">Buy now, it is cheap.</div><article><h1>Title {i}</h1><p><b>Open &lt;b&gt;<br>{body}</article><footer>&copy; me</footer>', "old"))
    rows += [(100, "n", None, "old"), (101, "e", "", "old"), (102, "n", "<html><body>" + nav + "</body></html>", None), (0, "u0", rows[0][2], "old")]
    rows.append((103, "long", "<article>" + "<p>A long page, with much text in it. Yes.</p>" * 30000 + "</article>", "old"))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = he.extract(pages, ["page_id", "url", "text"]).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() == {"page_id", "url", "text", "n_chars"}
    by_id = {r["page_id"]: r["text"] for r in got}
    for i in range(30):
        lines = [f"Title {i}", "Open <b>"] + [f"Sentence {i} of this text, number {j}. It goes on & on." for j in range(3)]
        assert by_id[i] == "\n".join(lines)
    assert by_id[100] == by_id[101] == by_id[102] == ""
    assert by_id[103].count("\n") == 29999
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert he.extract(pages.limit(0), ["page_id"]).count() == 0


PARTS = [f"This is part {i} of the article, which says something. It is long enough, too." for i in range(4)]


def article(between):
    return f"<html><body><nav><ul><li><a href=/>Home</a></li></ul></nav><article><h1>Title</h1><p>{PARTS[0]}</p>{between}<p>{PARTS[1]}</p><p>{PARTS[2]}</p><p>{PARTS[3]}</p></article><footer>&copy; me</footer></body></html>"


def test_silent_elements_end_where_they_should():
    weights = he.train([])
    want = "\n".join(["Title", *PARTS])
    for between in ("", "<svg/>", '<iframe src="/x" />', "<object data=x />", "<button>", "<select>", "<video src=x>", "<canvas>", "<svg><title>x</title><p>no</p></svg>", "<button><b>Go</b></button>", "<textarea>never</textarea>", "<noscript><p>Turn it on.</p></noscript>", "<script>var x = '<p>';</script>", "<!-- <p>no</p> -->", "<title>", "<template>"):
        assert he.main_texts([article(between)], weights) == [want], between


def test_tokens_of_odd_markup():
    kinds = lambda html: [(k, t, v) for k, t, v in he.tokens(html)]
    assert kinds('<a title="x > y" b>z') == [("open", "a", ' title="x > y" b'), ("text", "", "z")]
    assert kinds("a < b &lt; c") == [("text", "", "a "), ("text", "", "<"), ("text", "", " b < c")]
    assert kinds("<p don't>x</p>") == [("open", "p", " don't"), ("text", "", "x"), ("close", "p", "")]
    assert kinds('<p a="x>y</p>') == [("open", "p", ' a="x'), ("text", "", "y"), ("close", "p", "")]
    assert kinds("<!doctype html><?xml?>x<!-- never ends") == [("text", "", "x")]
    assert kinds("x<style>p{}") == [("text", "", "x")]
    assert kinds("<br/><") == [("void", "br", "/"), ("text", "", "<")]
    assert kinds("</ x>y<SCRIPT>1<2</ScRiPt >z") == [("text", "", "y"), ("text", "", "z")]


def test_broken_markup_takes_linear_time():
    import time

    weights = he.train([])
    for unit in ('<a b="x', "<a b='x\"", "<", "<div>", "<li><div>", "</p>", "<!-", "<button>", "<a", "<a'", "<script>x</script>", "< "):
        page = unit * (1_000_000 // len(unit))
        began = time.time()
        he.tokens(page)
        he.main_texts([article(page[:200_000])], weights)
        assert time.time() - began < 25, unit


def test_ends_of_comments():
    text = lambda html: [t for kind, _, t in he.tokens(html) if kind == "text"]
    for comment in ("<!-->", "<!--->", "<!-- c --!>", "<!-- c -->", "<!---->", "<!-- > -- c -->", "<!-- a <!--> ", "<!--!> b -->"):
        assert "".join(text(f"one{comment}two")).replace(" ", "") == "onetwo", comment
    assert text("one<!-- never closed <p>two") == ["one"]
    weights = he.train([])
    assert any("</p>" in html for html in PAGES)
    for html in PAGES:
        for comment in ("<!-->", "<!--->", "<!-- c --!>"):
            assert he.main_texts([html.replace("</p>", comment + "</p>")], weights) == [kept_text(html)]
